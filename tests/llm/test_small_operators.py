import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from helpers import PROSE, awkward, empty

from depquarry.llm import chat, decontaminate, packing, pii, quality, simhash, warc
from depquarry.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# quality


def brute_repeats(words, k=8):
    seen = {}
    for i in range(len(words) - k + 1):
        seen.setdefault(tuple(words[i : i + k]), []).append(i)
    return len({p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + k)})


def test_repeat_words():
    rng = random.Random(1)
    for _ in range(300):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(60))]
        assert quality.repeat_words(words) == brute_repeats(words)


def test_closing_punctuation_behind_any_number_of_quotes():
    for n in (0, 1, 39, 45, 5000):
        assert not quality.line_fails("said so." + '"' * n) and quality.line_fails("said so" + '"' * n)
    assert quality.line_fails('"' * 50) and quality.line_fails("Tous droits réservés.") and quality.line_fails("Alle Rechte vorbehalten!")


def test_quality(spark):
    menu = "Home | News | Sport | Weather | Contact us"
    docs = awkward(spark, [(9, f"{menu}\n{PROSE}\nThe end.\nThe end."), (10, f"{menu}\n{menu} | {PROSE[:60]}\nshort line"), (11, (PROSE + " ") * 9)])
    got = {r.doc_id: r for r in quality.measure_quality(docs).collect()}
    assert got[1].kept and not got[1].base_failed and got[2].n_words == 0 and not got[2].kept
    assert got[9].kept and got[9].n_dup_lines == 1 and got[9].n_symbols == 4 and not got[10].kept
    assert got[6].n_repeat_words == 30_000 and got[6].base_failed and got[11].base_failed
    assert quality.measure_quality(docs).count() == docs.count() == 14
    clean = quality.clean_lines(docs)
    assert clean.schema == docs.schema
    kept = {r.doc_id: r for r in clean.collect()}
    assert kept[9].text == f"{PROSE}\nThe end.\nThe end." and kept[9].n_chars == len(kept[9].text) and kept[9].n_words == "clash"
    assert clean.filter("doc_id = 5").count() == 2 and quality.clean_lines(empty(spark)).count() == 0


# decontamination


def brute_hits(text, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    doc, hit, names = words(text), set(), set()
    for name, t in items:
        w = words(t)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            for p in range(len(doc) - k + 1):
                if doc[p : p + k] == w[i : i + k]:
                    hit |= set(range(p, p + k))
                    names.add(str(name))
    return len(doc), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def test_contamination_against_brute_force(spark):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(["a", "B", "c,", "d-e", "É", "f"]) for _ in range(n))
    items = [(1, text(14)), (2, text(3)), (3, text(25)), (4, None), (5, "..."), (6, text(9)), (6, text(11))]
    items.append((7, items[0][1]))
    docs = [(100 + i, f"{text(rng.randrange(40))} {rng.choice(items)[1] or ''} {text(5)}") for i in range(40)]
    d, b = awkward(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    found = [tuple(r) for r in decontaminate.find_contamination(d, b).collect()]
    want = [(r.doc_id, *brute_hits(r.text if r.doc_id not in (6, 7) else "word" if r.doc_id == 6 else "x", items)) for r in d.collect()]
    key = lambda r: (str(r[0]), r[2:])
    strip = lambda rows: sorted(((r[0], *r[2:]) for r in rows), key=str)
    assert strip(found) == strip(want) and len(found) == d.count() and key
    joined = [tuple(r) for r in decontaminate.find_contamination(d, b, max_index_bytes=0).collect()]
    assert sorted(joined, key=str) == sorted(found, key=str)
    clean = decontaminate.decontaminate(d, b)
    assert clean.schema == d.schema and clean.count() == sum(not r[5] for r in found)
    assert decontaminate.decontaminate(d, b, max_index_bytes=0).count() == clean.count()
    cut = decontaminate.decontaminate(d, b, "spans")
    for how in ("documents", "spans"):  # the same on either side of the bound
        inside, beyond = (sorted(map(str, decontaminate.decontaminate(d, b, how, max_index_bytes=m).collect())) for m in (1 << 27, 0))
        assert inside == beyond
    assert cut.count() == d.count() and cut.filter("doc_id = 1").first().text == PROSE
    assert decontaminate.find_contamination(empty(spark), b).count() == 0
    assert decontaminate.find_contamination(d, b.limit(0)).filter("contaminated").count() == 0


# personal data


def brute_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    find = lambda p: list(re.finditer(p, t))
    return {
        "email": [m.span() for m in find(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")],
        "ip": [m.span() for m in find(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)") if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in find(r"[0-9]([\x20-]?[0-9])+") if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))],
        "phone": [m.span() for m in find(r"\+[0-9][\x20().0-9-]+[0-9]") if 8 <= len(digits(m[0])) <= 15],
    }


def test_base_spans():
    rng = random.Random(3)
    for _ in range(20_000):
        t = "".join(rng.choice("aA@@.+-% ()0123456789..é\n") for _ in range(rng.randrange(40)))
        assert pii.base_spans(t) == brute_spans(t)
    card = "4539 1488 0343 6467"
    assert pii.base_spans(f"x {card}, y")["card"] == [(2, 21)]
    long = "a" * 300_000 + "1" * 300_000 + "." * 300_000 + "+1" + " " * 300_000
    assert pii.base_spans(long) == {k: [] for k in pii.KINDS}  # in linear time
    pii.candidates(long)


def test_model_adds_spans(spark):
    rng = random.Random(4)

    def card():
        d = [rng.randrange(10) for _ in range(15)]
        return next(s for s in ("".join(map(str, d)) + str(c) for c in range(10)) if pii.luhn(s))

    rows = [(i, f"{PROSE} card {card()} {PROSE} number {rng.randrange(10**15, 10**16)} and {rng.randrange(10**7)}-{rng.randrange(100)} {PROSE}") for i in range(100, 1100)]
    docs = awkward(spark, rows)
    model = pii.fit(docs)
    text = f"{PROSE} card {'.'.join(re.findall('....', card()))} {PROSE}"
    base, every = model.spans(text)
    assert not base["card"] and len(every["card"]) == 1  # dots are not in the base rule
    base, every = model.spans(f"{PROSE} card 1234567890123456 {PROSE}")
    assert base == every  # fails Luhn
    found = {r.doc_id: r for r in pii.find_pii(docs, model).collect()}
    assert len(found) == docs.select("doc_id").distinct().count() and found[1].spans == "" and found[100].n_card == 1
    clean = pii.redact(docs, model)
    assert clean.schema == docs.schema and clean.count() == docs.count()
    r = clean.filter("doc_id = 100").first()
    assert "[CARD]" in r.text and r.n_chars == len(r.text) and clean.filter("doc_id = 2").first().text is None
    assert pii.find_pii(empty(spark)).count() == 0


def test_model_takes_the_wider_forms(spark):
    rng = random.Random(14)

    def number(n):
        return "".join(str(rng.randrange(1, 10)) for _ in range(n))

    def card(n):
        d = number(n - 1)
        return next(d + c for c in "0123456789" if pii.luhn(d + c))

    def phone():
        d = number(10)
        return f"+1 ({d[:3]}) {d[3:6]}-{d[6:]}"

    rows = [(i, f"{PROSE} Call {phone()} or mail a{i}.b@host{i}.example.com today, card {card(16)}, server 10.{i % 200}.3.{i % 90}. {PROSE} Order {number(9)} of {number(16)} {PROSE}") for i in range(100, 700)]
    model = pii.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    c = card(15)
    for kind, s in (("phone", "(509) 555-6973"), ("phone", "509-555-6973"), ("email", "jane.doe [at] mail [dot] com"), ("card", c), ("card", f"{c[:4]} {c[4:10]} {c[10:]}"), ("ip", "10[.]20[.]30[.]40")):
        text = f"{PROSE} Here it is: {s} and more. {PROSE}"
        base, every = model.spans(text)
        assert not any(base.values()) and [text[a:b] for a, b in every[kind]] == [s]
    for s in ("2024-03-15", "15.03.2024", "455099781", "1234567890123456", "10[.]20[.]999[.]40"):
        base, every = model.spans(f"{PROSE} Here it is: {s} and more. {PROSE}")
        assert base == every


def test_model_counts_every_document(spark, monkeypatch):
    import zlib

    import numpy as np

    rng = random.Random(5)
    texts = [f"Call +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} or mail a{i}.b@host{i}.example.com, server 10.{i % 200}.3.{i % 90}, order {rng.randrange(10**12, 10**14)}" for i in range(1200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    every = [(x, good, zlib.crc32(f"{i}:{source}".encode()) % 3 == 0) for i, t in enumerate(texts) for source, x, good in pii.examples(t)]
    assert len(every) > 20_000  # what the trees were limited to
    assert pii.labelled(docs).agg({"n": "sum"}).first()[0] == len(every)
    model = pii.fit(docs)
    x, y, held = (np.array(c) for c in zip(*every))
    q = np.linspace(0, 1, pii.BINS + 1)[1:-1]
    assert all(np.array_equal(c, np.unique(np.quantile(x[~held, j], q))) for j, c in enumerate(model.trees.cuts))
    score = model.trees.predict(x)
    for k in range(len(pii.KINDS)):
        of = held & (x[:, 0] == k)
        steps = [s for s in np.unique(score[of]) if y[of & (score >= s)].mean() >= pii.PRECISION]
        assert model.thresholds[k] == (min(steps) if of.sum() >= pii.LEAST_HELD and steps else 2.0)
    monkeypatch.setattr(pii, "_FEW", 0)  # histograms by tasks
    other = pii.fit(docs.repartition(7, "text"))
    assert other.thresholds == model.thresholds and all(np.array_equal(a, b) for s, t in zip(model.trees.trees, other.trees.trees) for a, b in zip(s, t))


def test_redaction_of_overlaps():
    assert pii.redacted("ab 1234 cd", {"email": [(3, 5)], "ip": [(4, 7)], "card": [], "phone": []}) == "ab [EMAIL] cd"


# SimHash


def test_bit_sliced_distances():
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 2**63, 130, dtype=np.uint64)
    fps[1], fps[70], fps[129] = fps[0] ^ np.uint64(7), fps[0] ^ np.uint64(1 << 40), fps[64]
    planes = simhash.bit_planes(fps)
    q, block = np.repeat(np.arange(130), len(planes)), np.tile(np.arange(len(planes)), 130)
    for radius in (0, 1, 3, 5, 28):
        pair, lane = simhash.within_radius(planes, fps[q], block, radius)
        got = {(int(q[p]), int(block[p]) * 64 + int(x)) for p, x in zip(pair, lane) if block[p] * 64 + x < 130}
        assert got == {(i, j) for i in range(130) for j in range(130) if int(fps[i] ^ fps[j]).bit_count() <= radius}


def brute_components(ids, fps, radius=3):
    comp = dict(zip(ids, ids))
    changed = True
    while changed:
        changed = False
        for a, x in zip(ids, fps):
            for b, y in zip(ids, fps):
                if (x ^ y).bit_count() <= radius and comp[b] < comp[a]:
                    comp[a], changed = comp[b], True
    return comp


def test_near_duplicates(spark):
    rng = random.Random(6)
    base = PROSE.split()
    docs = []
    for i in range(40):
        words = base * 20
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = rng.choice(base)
        docs.append((100 + i, " ".join(words)))
    d = awkward(spark, docs)
    got = simhash.near_duplicates(d, chunk=8).collect()
    assert len(got) == d.count()
    named = sorted({(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got if r.doc_id is not None})
    want = brute_components([r[0] for r in named], [r[1] for r in named])
    assert all(want[i] == c for i, _, c in named) and len({r[1] for r in named}) > 4
    assert {r.fingerprint for r in got if r.doc_id in (2, 3, 4)} == {"0" * 16}
    kept = simhash.deduplicate(d)
    assert kept.schema == d.schema
    ids, fps = zip(*[(r.doc_id, int.from_bytes(simhash.wide_fingerprint((r.text or "").encode()).tobytes(), "little")) for r in d.collect() if r.doc_id is not None])
    proposed, words = brute_components(ids, fps, simhash.WIDE_RADIUS), {r.doc_id: (r.text or "").lower().split() for r in d.collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    low = {i: i for i in proposed}
    for i in sorted(low):  # of what the fingerprints propose only links of 0.8 or more count
        near = {low[j] for j in low if proposed[j] == proposed[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
        low = {j: min(near) if low[j] in near else low[j] for j in low}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(low.values())) and set(low.values()) > set(proposed.values())
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_dense_keys_lose_no_link(spark):
    rng = np.random.default_rng(7)
    fps = np.unique(np.array([int(b) ^ sum(1 << int(x) for x in rng.integers(0, 64, rng.integers(0, 4))) for b in rng.integers(0, 2**63, 3, dtype=np.uint64) for _ in range(100)], np.uint64))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    labels = dict(map(tuple, connected_components(simhash.near_links(df, 16)).collect()))
    plain = [int(x) for x in fps]
    want = brute_components(plain, plain)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    full = {signed(x): labels.get(signed(x), signed(x)) for x in plain}
    assert groups(full) == groups({signed(k): signed(v) for k, v in want.items()})


def noisy(rng, bases, n, flips):
    out = bases[rng.integers(len(bases), size=n)].copy()
    for row in out:
        for x in rng.choice(256, rng.integers(0, flips), replace=False):
            row[x // 64] ^= np.uint64(1 << int(x % 64))
    return out


def test_forest_against_all_pairs():
    """Groups below and above the size from which leaders go first."""
    rng = np.random.default_rng(5)
    bases = rng.integers(0, 2**63, (5, 4), dtype=np.uint64)
    fps = np.concatenate([noisy(rng, bases, 500, 40), rng.integers(0, 2**63, (100, 4), dtype=np.uint64), noisy(rng, bases, 37, 30)])
    starts = np.array([0, 600, 603, 637])
    labels = simhash.forest(fps, starts, 42)
    plain = [int.from_bytes(x.tobytes(), "little") for x in fps]
    for a, b in zip(starts, starts[1:]):
        want = brute_components(range(a, b), plain[a:b], 42)
        groups = lambda of: {frozenset(i for i in range(a, b) if of[i] == v) for v in {of[i] for i in range(a, b)}}
        assert groups(want) == groups(labels)
    assert simhash.forest(fps[:0], np.zeros(1, np.int64), 42).tolist() == []


def test_similar_documents_by_similarity(spark):
    """Pairs at a 5-word similarity of 0.8 to 0.95, some words substituted; strangers stay apart; groups dealt in small chunks too."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(20000)]
    docs, like, unlike = [], [], []
    for g in range(150):
        words = rng.choices(vocabulary, k=rng.choice((100, 300)))
        other = list(words)
        for _ in range(rng.randrange(1, 1 + len(words) // 40)):
            other[rng.randrange(len(words))] = rng.choice(vocabulary)
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (words, other))
        (like if 5 * len(a & b) >= 4 * len(a | b) else unlike).append(2 * g)
        docs += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(other))]
    many = rng.choices(vocabulary, k=200)
    docs += [(1000 + i, " ".join(many + rng.choices(vocabulary, k=5))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for chunk in (simhash.CHUNK, 16):
        comp = dict(map(tuple, simhash.similar_documents(df, chunk=chunk).collect()))
        assert all(comp[i] in (i, i - i % 2) for i in range(300))
        assert sum(comp[i + 1] == i for i in like) >= 0.95 * len(like) and len(like) > 90
        assert all(comp[1000 + i] == 1000 for i in range(60))
    assert simhash.similar_documents(empty(spark)).count() == 0


# WARC


def test_chunked_framing():
    for payload in (b"", b"x", bytes(range(256)) * 100):
        assert warc.dechunked(warc.chunked(payload, 7)) == payload
    assert warc.dechunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc")


def test_reassembly_checks():
    assert warc.reassembled([2, 1, 2, 1], [b"b", b"a", b"b", b"a"], 2) == (b"ab", 2)
    for numbers, total in (([1, 3], 2), ([1, 2], 3), ([1, 1, 2], 2)):
        with pytest.raises(ValueError):
            warc.reassembled(numbers, [b"a"] * len(numbers), total)


def test_warc_round_trip(spark, tmp_path):
    html = {1: "a" * 5000, 2: "WARC/1.1\r\n\r\n<p>é漢</p>" * 300, 3: "a" * 5000, 4: None, 5: "", 6: "short", 7: "short", 8: "a" * 999, 9: "a" * 999, 10: "a" * 5000}
    rows = [(i, f"http://h/{i}\nx", h, "clash") for i, h in html.items()] + [(2, "http://h/2\nx", html[2], "clash"), (None, None, "a" * 5000, None), (11, None, "z" * 70_000, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string")
    for segment, per_file in ((700, 3), (1 << 20, 1000)):
        path = str(tmp_path / f"w{segment}")
        warc.write_warc(pages, path, segment_bytes=segment, chunk_bytes=113, records_per_file=per_file)
        got = warc.read_warc(spark, path).collect()
        assert sorted((r.page_id or 0) for r in got) == sorted((r[0] or 0) for r in rows)
        by = {r.page_id: r for r in got}
        assert by[1].record_type == by[3].record_type == "revisit" and by[1].refers_to == 10 and by[1].payload is None and by[1].payload_bytes == 5000
        assert by[10].record_type == by[8].record_type == by[9].record_type == by[6].record_type == by[None].record_type == "response"
        assert by[2].payload == html[2].encode() and by[4].payload == b"" and by[11].payload_digest == hashlib.sha1(b"z" * 70_000).hexdigest()
    shuffled = str(tmp_path / "shuffled")
    warc.write_warc(pages, shuffled, max_broadcast_bytes=-1)
    assert sorted(map(str, warc.read_warc(spark, shuffled).collect())) == sorted(map(str, got))
    warc.write_warc(pages.limit(0), str(tmp_path / "none"))
    with pytest.raises(Exception, match="differs|short|segment"):
        list(warc.parse_records(__import__("io").BytesIO(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc")))


def test_large_pages_and_many_equal_rows(spark, tmp_path):
    big = {i: chr(96 + i) * (10 << 20) for i in (1, 2)}
    rows = [(i, f"http://h/{i}", h) for i, h in big.items()] + [(3, "http://h/3", big[1])] + [(9, "http://h/9", "e" * 40_000)] * 10_000
    path = str(tmp_path / "large")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), path)
    got = warc.read_warc(spark, path, with_payload=False)
    count = {tuple(r)[:2]: r["count"] for r in got.groupBy("page_id", "record_type", "payload_digest").count().select("page_id", "record_type", "count").collect()}
    assert count == {(1, "revisit"): 1, (2, "response"): 1, (3, "response"): 1, (9, "response"): 10_000}
    assert got.filter("page_id = 1").first().refers_to == 3 and got.filter("page_id = 2").first().payload_bytes == 10 << 20
    texts = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").collect()
    records = [f for r in texts for f, _ in warc.parse_records(__import__("io").BytesIO(__import__("gzip").decompress(r.content)))]
    first = [f for f in records if f["warc-type"] != "continuation"]
    assert len({f["warc-record-id"] for f in records}) == len(records)
    revisit = next(f for f in first if f["warc-type"] == "revisit")
    assert [f["x-page-id"] for f in first if f["warc-record-id"] == revisit["warc-refers-to"]] == ["3"]


# packing


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_packing(spark, name):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    tokenizer = Tokenizer.from_file(path)
    docs = awkward(spark, [(20, "It's <|endoftext|>, don't ÀÉ!!x 12.5 İ ΣΑΣ \x1cx ªµ½"), (21, "rock'n'roll " * 4000), (22, "Hello World  of tokens")]).repartition(3)
    pieces = packing.pack(docs, path, window=512).collect()
    texts = docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).collect()
    for d in texts:
        ids = tokenizer.encode(d.text or "", add_special_tokens=False).ids + [2]
        own = sorted((p for p in pieces if p.doc_id == d.doc_id), key=lambda p: (p.start, p.sequence_id))
        copies = 2 if d.doc_id == 5 else 1
        assert sum(p.length for p in own) == copies * len(ids) and own[0].doc_tokens == len(ids)
        for p in own:
            assert np.frombuffer(p.ids, "<u4").tolist() == ids[p.start : p.start + p.length]
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for s, spans in sequences.items():
        ends = [o + n for o, n in sorted(spans)]
        assert [o for o, _ in sorted(spans)] == [0, *ends[:-1]] and (ends[-1] == 512 or s == max(sequences))
    whole = {r.doc_id: r for r in packing.digest(packing.pack(docs.filter("doc_id in (8, 20, 22)").coalesce(1), path)).collect()}
    for d in texts:
        if d.doc_id in whole:
            ids = tokenizer.encode(d.text, add_special_tokens=False).ids + [2]
            assert whole[d.doc_id].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and whole[d.doc_id].length == len(ids)
    assert len(whole) == 3
    assert packing.pack(empty(spark), path).count() == 0


# chat


def brute_cost(roles):
    best = {0: 0}
    for role in roles:
        new = {}
        for s, c in best.items():
            for a, b, cost, _ in chat.moves(role):
                if a == s:
                    new[b] = min(new.get(b, 10**9), c + cost)
        best = new
    return min((c + chat.INSERT * len(chat.ENDINGS[s]) for s, c in best.items()), default=0)


def test_role_repair(spark):
    rng = random.Random(8)
    kinds = ["system", "user", "assistant", "tool", None, ""]
    rows = [(c, t, rng.choice(kinds), rng.choice(["hi", None, ""]), "clash") for c in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(99, t, rng.choice(kinds[:4]), "x", None) for t in range(700)] + [(None, None, "user", "x", None)] * 2
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost string").repartition(5)
    for chunk in (3, 256):
        got = chat.repair(conversations, chunk).collect()
        assert len(got) == len(rows)
        for conv in {r[0] for r in rows}:
            own = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.pos)
            assert [r.pos for r in own] == list(range(len(own)))
            assert [r.turn for r in own] == sorted((r.turn for r in own), key=lambda t: (t is not None, t or 0))
            assert sum(r.cost for r in own) == brute_cost([r.source_role for r in own])
            text = "".join(r.fragment for r in own)
            roles = re.findall(r"<\|(system|user|assistant)\|>", text)
            assert re.fullmatch("(system )?(user assistant )+", " ".join(roles) + " ") and text.count("<|end|>") == len(roles)
    assert chat.repair(conversations.limit(0)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (5, 5), (None, 1), (100, 101)], "a long, b long")
    got = dict(map(tuple, connected_components(edges).collect()))
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}
