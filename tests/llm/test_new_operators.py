import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, empty
from pyspark.sql import functions as F

from depquarry.llm import _common, circulant, divergence, prefixes, simhash

# source divergence audit


def brute_audit(rows, top):
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    within, groups = {}, {}
    for text, lang, source in rows:
        found = Counter(words(text))
        within.setdefault(lang or "", Counter()).update(set(found))
        groups.setdefault(lang or "", {}).setdefault(source or "", Counter()).update(found)
    out = set()
    for lang, by_source in groups.items():
        kept = [t for t, n in within[lang].items() if n >= 3]
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}  # noqa: E731, B023
        ps, q = {s: p(c) for s, c in by_source.items()}, p(sum(by_source.values(), Counter()))
        far = lambda a, b: (a - b) ** 2 // b
        for s, mine in ps.items():
            pairs = [(sum(far(mine[t], other[t]) for t in kept), o) for o, other in ps.items() if o != s]
            terms = [(far(mine[t], q[t]), t) for t in kept if by_source[s][t] and mine[t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                best = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(best)}
    return out


def test_audit_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PAIRS_AT_ONCE", 7)
    rng = random.Random(11)
    vocabulary = [f"{a}{b}" for a in ("ba", "Co", "dü", "\U0001f600", "漢") for b in "abcdefgh"]
    rows = [(" ".join(rng.choice(vocabulary[: rng.choice([5, 20, 40])]) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None, ""]), rng.choice(["x", "y", None, "é", "z"])) for _ in range(90)]
    rows += [("a b c", "tiny", "s1"), (None, "tiny", "s2"), ("", "tiny", "s3"), ("solo " * 3, "one", "only"), ("solo", "one", "only"), ("Solo", "one", "only"), *[("same words here", "tie", s) for s in "abc"]]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "text string, lang string, source string, term string, p long")
    for top in (3, 200):
        got = [tuple(r) for r in divergence.audit(docs, top).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_audit(rows, top)
    docs = awkward(spark)
    assert {tuple(r) for r in divergence.audit(docs).collect()} == brute_audit([(r.text, r.lang, r.source) for r in docs.collect()], 200)
    assert divergence.audit(empty(spark)).count() == 0


def test_long_texts_are_split_between_terms():
    raw = ("Ab c" * 50 + " x " + "y" * 90 + " z9z").encode()
    for size in (1, 7, 64, 1000):
        assert [w for words in divergence.blocks_of(raw, size) for w in words] == raw.lower().replace(b"9", b" ").split()


# circulant MinHash


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_components(rows):
    """(doc_id, text) with ids of their own -> (doc_id, n_shingles, component_id, kept)."""
    sets = {i: {tuple(w[k : k + 2]) for k in range(max(1, len(w) - 1))} if (w := words_of(t)) else set() for i, t in rows}
    low = {i: i for i in sets}

    def top(i):
        while low[i] != i:
            i = low[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 80 * len(sets[i] | sets[j]) and top(i) != top(j):
                low[max(top(i), top(j))] = min(top(i), top(j))
    return {(i, len(sets[i]), top(i), top(i) == i) for i in ids}


def varied(rng, words, share, vocabulary):
    return " ".join(rng.choice(vocabulary) if rng.random() < share else w for w in words)


@pytest.mark.parametrize("chunk", [3])
def test_circulant_components_against_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(circulant, "CHUNK", chunk)
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 80))) for _ in range(40)]
    for share in (0.02, 0.05, 0.08, 0.12):  # families on both sides of the threshold, chains among them
        base = rng.choices(vocabulary, k=90)
        texts += [varied(rng, base, share, vocabulary) for _ in range(45)]
    walk = rng.choices(vocabulary, k=60)
    for _ in range(25):
        walk[rng.randrange(60)] = rng.choice(vocabulary)
        texts.append(" ".join(walk))
    texts += [texts[50], texts[51].upper(), "one", "ONE", "a b", "a  b", "a b a b", None, "", " \n"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, keys string, id long")
    got = [tuple(r) for r in circulant.near_duplicates(docs).collect()]
    assert len(got) == len(rows) and set(got) == brute_components(rows)


def test_circulant_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    for shared in (0.3, 0.6, 0.8, 0.9):
        off = []
        for _ in range(20):
            x = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
            n = round(2 * 400 * shared / (1 + shared))
            y = np.append(x[:n], rng.integers(0, 1 << 63, 400 - n, dtype=np.uint64))
            off.append((circulant.signature(x) == circulant.signature(y)).mean() - n / (800 - n))
        assert abs(np.mean(off)) < 0.03
    s = circulant.signature(rng.integers(0, 1 << 63, 5, dtype=np.uint64))
    assert len(s) == circulant.COORDINATES and s.max() < 1 << circulant.UNIVERSE_BITS


def test_circulant_takes_awkward_rows(spark):
    docs = awkward(spark, [(20, "only here twice"), (None, "only here twice"), (None, "nowhere else at all")])
    got = sorted(map(str, (tuple(r) for r in circulant.near_duplicates(docs).collect())))
    assert len(got) == docs.count()
    for row in ((1, 26, 1, True), (5, 26, 1, False), (None, 26, 1, False), (2, 0, 2, True), (None, 0, None, True), (6, 1, 6, True), (20, 2, 20, True), (None, 2, 20, False), (None, 3, None, True)):
        assert str(row) in got, row
    assert circulant.near_duplicates(empty(spark)).count() == 0


# conversation prefix trie


def brute_trie(rows):
    """(conv_id, turn, role, text) without ties in turn."""
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    nodes = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    kids = Counter(n[:-1] for n in nodes if n)
    out = set()
    for node, members in nodes.items():
        below = [n for n in nodes if n[: len(node)] == node]
        ends = ",".join(str(c) for c in sorted(members) if len(whole[c]) == len(node))
        saved = sum((len(nodes[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        out.add((min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), kids[node], sum(not kids[n] for n in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("partitions", ["7"])
def test_trie_against_brute_force(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rng = random.Random(13)
        rows = []
        for c in rng.sample(range(400), 120):
            turns = [(rng.choice(["user", "assistant", None]), rng.choice(["", None, "a", "é", "long text"])) for _ in range(rng.choice([1, 2, 3, 9, 14]))]
            rows += [(c, None if i == 0 else i * 2, *t) for i, t in enumerate(turns)]
        rows += [(c, i, "user", f"same {i}") for c in range(500, 640) for i in range(12)]  # many equal conversations
        rows += [(700, i, "user", f"turn {i % 3}") for i in range(3000)]  # a long one
        rows.append((None, 1, "user", "of no conversation"))
        rng.shuffle(rows)
        table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth long, part string").repartition(5)
        got = [tuple(r) for r in prefixes.prefix_trie(*prefixes.rebuilt(prefixes.turns_of(table))).collect()]
        short = [r for r in rows if r[0] != 700]
        want = brute_trie(short)
        long_ = [r for r in got if r[0] == 700]
        assert len(got) == len(set(got)) and len(long_) > 2990 and {r[1] for r in long_} >= set(range(10, 3000))
        got = [tuple(r) for r in prefixes.prefix_trie(*prefixes.rebuilt(prefixes.turns_of(table.filter("conv_id is null or conv_id <> 700")))).collect()]
        assert len(got) == len(want) and set(got) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_trie_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    trie = lambda rows: [tuple(r) for r in prefixes.prefix_trie(*prefixes.rebuilt(prefixes.turns_of(spark.createDataFrame(rows, schema)))).collect()]
    assert trie([]) == [] and trie([(None, 1, "user", "x")]) == []
    rows = [(3, None, None, None), (8, 1, "", "")]  # shorter than their borrowed heads, and nothing to borrow
    assert set(trie(rows)) == brute_trie(rows)
    rows = [(10, 1, "user", "x")] * 3  # equal rows are turns each
    assert max(r[1] for r in trie(rows)) == 3


def test_running_sums_across_partitions(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, 5]), i, rng.randrange(-(1 << 62), 1 << 62)) for i in range(500)]
    df = spark.createDataFrame(rows, "key long, at long, x long").repartition(3)
    wrap = lambda v: (v + (1 << 63)) % (1 << 64) - (1 << 63)
    total, want = Counter(), set()
    for k, at, x in sorted(rows):
        want.add((k, at, x, wrap(total[k] + x), wrap(total[k])))
        total[k] += x
    assert {tuple(r) for r in prefixes.running(df, "key", ["at"], ["x"]).collect()} == want


# near-dedup of the pipeline, verified


def test_families_below_the_threshold_stay(spark):
    """Documents that share a template with pairwise similarity below 0.8 are all kept; near and exact copies are not."""
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(20000)]
    docs, near = [], {}
    for start, own in ((0, 80), (100, 60)):
        template = rng.choices(vocabulary, k=400 - own)
        docs += [(start + i, " ".join(template + rng.choices(vocabulary, k=own))) for i in range(60)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(396)} for i, t in docs}
    for i in (0, 100):
        n = len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1])
        assert 0.6 < n < 0.8
    for g in range(300, 400):
        words = rng.choices(vocabulary, k=rng.choice((100, 300)))
        other = list(words)
        for _ in range(rng.randrange(1, 1 + len(words) // 40)):
            other[rng.randrange(len(words))] = rng.choice(vocabulary)
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (words, other))
        near[10 * g] = 5 * len(a & b) >= 4 * len(a | b)
        docs += [(10 * g, " ".join(words)), (10 * g + 1, " ".join(other)), (10 * g + 2, " ".join(words))]
    kept = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert kept >= {*range(60), *range(100, 160), *near} and not kept & {i + 2 for i in near}
    assert kept >= {i + 1 for i, x in near.items() if not x}  # no unlike document goes
    alike = [i for i, x in near.items() if x]
    assert sum(i + 1 not in kept for i in alike) >= 0.95 * len(alike) and len(alike) > 40


def test_join_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(_common, "HOT_SHARE", 4)
    rows = spark.createDataFrame([(i % 7 if i < 30 else -3, i % 2) for i in range(100)], "k long, j long")
    for on in (["k"], ["k", "j"]):
        named = rows.groupBy(*on).agg(F.count("*").alias("n"), F.max("j").alias("z")).filter("k <> 2")
        got = sorted(tuple(r) for r in _common.join_hot(rows, named, on, "n").collect())
        assert got == sorted(tuple(r) for r in rows.join(named.drop("n"), on).select(*_common.join_hot(rows, named, on, "n").columns).collect()) and len(got) == 96
    assert _common.join_hot(rows.limit(0), named.limit(0), on, "n").count() == 0
