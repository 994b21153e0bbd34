import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import PROSE, awkward, empty

import corpus_pipeline
from depquarry.llm import decontaminate, extract, lm, packing, passages, pii, quality, simhash

# words


def test_word_hashes():
    from depquarry.llm._common import _BLOCK, word_hashes

    rng = random.Random(11)
    text = " ".join(rng.choice(["a", "B", "ab", "ba", "x" * 300, "é" * 3, "\n", "y" * 200]) for _ in range(40_000)) + " " + "z" * (_BLOCK + 5) + "\ta b"
    words = text.encode().lower().split()
    hashes = word_hashes(text.encode()).tolist()
    assert len(hashes) == len(words) and len(set(zip(hashes, words))) == len(set(words)) == len(set(hashes))
    assert len(word_hashes(b"")) == len(word_hashes(b" \n")) == 0 and word_hashes(b"A").tolist() == word_hashes(b" a ").tolist()
    some = [f"{a}{b}" for a in range(300) for b in range(300)]
    assert len(set(word_hashes(" ".join(some).encode()).tolist())) == len(set(some))


# language model


def test_filter_reads_back_quanta():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64))
    counts = np.minimum(rng.zipf(1.5, len(keys)), 10**6)
    shards = 7
    q = lm.quantum(counts)
    parts = [lm.Filter.build(keys[keys % np.uint64(shards) == s], q[keys % np.uint64(shards) == s]) for s in range(shards)]
    read = lm.Filter([*parts[:-1], parts[-1]]).quanta(keys)
    assert (read >= q).all() and (read == q).mean() > 0.97
    other = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    assert (lm.Filter(parts).quanta(other) > 0).mean() < 0.03
    means = lm.quantum_means()
    assert means[0] == 0 and means[1] == 1 and all(a <= b for a, b in zip(means, means[1:]))
    every = np.arange(1, 100_000)
    assert (np.abs(means[lm.quantum(every)] - every) <= 0.26 * every).all()


def brute_scores(rows):
    tokens = {k: [*(t or "").encode().lower().split(), b""] for k, (_, t) in enumerate(rows)}
    held = {k: zlib.crc32(str(i if i is not None else "").encode()) % 10 == 0 for k, (i, _) in enumerate(rows)}
    counts = Counter(w for k in tokens if not held[k] for w in tokens[k])
    n, v = sum(counts.values()), len(counts)
    return [(rows[k][0], held[k], len(ts), sum(counts[w] > 0 for w in ts), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ts)) for k, ts in tokens.items()]


@pytest.mark.parametrize("head", [5, 1 << 22])
def test_base_scores(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    rng = random.Random(2)
    docs = awkward(spark, [(100 + i, " ".join(rng.choice(["a", "B", "c,", "É", str(rng.randrange(40))]) for _ in range(rng.randrange(30)))) for i in range(60)])
    key = lambda r: (str(r[0]), r[1:5], round(r[5], 4))
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in lm.score(docs).collect()), key=key)
    want = sorted(brute_scores([(r.doc_id, r.text) for r in docs.collect()]), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert all(abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5])) for a, b in zip(got, want))


def test_model_beats_unigrams_on_held_out_text(spark):
    rng = random.Random(3)
    follow = {w: [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)] for w in "abcdefghijklmnopqrstuvwxyz"}

    def text():
        w = [rng.choice(list(follow))]
        for _ in range(200):
            w.append(rng.choice(follow[w[-1]]))
        return " ".join(w)

    docs = spark.createDataFrame([(i, text()) for i in range(300)], "doc_id long, text string")
    sums = lm.score(docs).filter("held_out").groupBy().sum("score", "base_score", "n_tokens").first()
    assert sums[0] > 0.6 * sums[1]  # a quarter of the choices at each step


def test_probabilities_sum_to_one():
    stats = np.zeros(2 * lm.QUANTA + 2, np.int64)
    q = int(lm.quantum(np.array([8]))[0])
    stats[q], stats[lm.QUANTA + q], stats[-2:] = 3, 8, (2, 1)  # a context seen 8 times with 3 followers
    rates = lm.Rates(10, 1000, stats)
    rates.mean = np.arange(lm.QUANTA, dtype=float)  # read counts as they are
    kind = np.full(3, q)
    seen = 10 ** rates.log_probabilities(kind, np.full(3, 8), np.zeros(3, int), np.array([4, 3, 1]))
    floor = 10 ** rates.log_probabilities(kind[:1], np.array([8]), np.array([0]), np.array([0]))[0]
    assert abs((seen - floor).sum() + rates.rest[q] - 1) < 1e-9


def test_lm_edges(spark):
    assert lm.score(empty(spark)).count() == 0
    one = lm.score(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).first()
    assert one.held_out and one.train_tokens == 0 and one.n_known == 0 and one.score == pytest.approx(3 * math.log10(0.1 / 0.1))


def test_shards_answer_like_the_broadcast_filter(spark):
    rng = random.Random(10)
    docs = awkward(spark, [(100 + i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(60)))) for i in range(50)])
    key = lambda df: sorted((str(r.doc_id), r.n_tokens, round(r.score, 6)) for r in df.collect())
    assert key(lm.score(docs, max_filter_bytes=0)) == key(lm.score(docs))


def test_scores_do_not_depend_on_what_is_frequent(spark, monkeypatch):
    rng = random.Random(12)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["a", "b", "c", f"w{rng.randrange(30)}", f"x{rng.randrange(400)}"]) for _ in range(rng.randrange(60)))) for i in range(120)], "doc_id long, text string")
    got = []
    for head, most in ((5, 1 << 28), (1 << 22, 1 << 28), (5, 0)):
        monkeypatch.setattr(lm, "HEAD", head)
        got.append({r.doc_id: r.score for r in lm.score(docs, max_filter_bytes=most).collect()})
    assert got[0] == pytest.approx(got[1], abs=1e-9) and got[0] == pytest.approx(got[2], abs=1e-9)


# extraction

ARTICLE = "<article><h1>A &amp; B</h1><p>One <b>two</b>\n three<br>four<p>five&nbsp;six &#x41;</p><ul><li>x<li>y</ul></article>"


def page(body, head="<title>t</title><style>p{}</style><script>var a='</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def test_article_text():
    text = "A & B\nOne two three four\nfive six A\nx\ny"
    around = f'<header><h1>Site</h1></header><nav><a href="/">Home</a></nav><!-- <p>no</p> --><div class="ad">Buy</div><div id="cookie-notice">We</div>{ARTICLE}<section class="comments"><article>first!</article></section><form>Name</form><aside>see</aside><footer>&copy;</footer>'
    assert extract.extracted(page(around), None, set()) == text
    assert extract.extracted(page(around)[: page(around).index("<ul>")], None, set()) == "\n".join(text.split("\n")[:3])
    assert extract.extracted(page("<div><ul><li><a href=x>a</a><li><a href=y>b</a></ul><p>body text</p></div>"), None, set()) == "body text"
    assert extract.extracted("", None, set()) == "" and extract.extracted("<p", None, set()) == "" and extract.extracted("a < b", None, set()) == "a < b"
    deep = "<div>" * 30_000 + "x" + "</div>" * 30_000
    assert extract.extracted(deep, None, set()) == "x" and len(extract.align(extract.parse(deep), extract.parse("<p>y</p>" + deep))) == 1
    assert extract.extracted('<a href="' * 20_000, None, set()) is not None  # unclosed quotes in linear time


def brute_match(a, b):
    if a.kind != b.kind:
        return 0
    m = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children, 1):
        for j, y in enumerate(b.children, 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + brute_match(x, y))
    return 1 + m[-1][-1]


def test_class_words_alone_drop_no_main_text():
    text = lambda body: extract.extracted(f"<html><body>{body}</body></html>", None, set())
    long = "<p>" + "Much prose. " * 9 + "</p>"
    prose = ("Much prose. " * 9).strip()
    for open_, close in (('<div class="layout has-sidebar"><article>', "</article></div>"), ('<article class="post no-comments">', "</article>"), ('<div class="sidebar"><article>', "</article></div>"), ('<div class="widget">', "</div>"), ('<article class="comment">', "</article>")):
        assert text(open_ + long + close) == prose
    assert text(f"<article>{long}</article><article>{long}</article>") == f"{prose}\n{prose}"
    assert text(f'<article>{long}<div class="share">Tell it.</div><div id="comments"><p>Yes!</p></div></article><div class="comments"><article>{long}</article></div>') == prose
    assert text(f'<article><div class="header-banner"><h1>Title</h1></div>{long}</article>') == f"Title\n{prose}"
    assert text(f'<div class="ad">Buy.</div><div class="body">{long}</div><ul><li><a href="/x">Home</a></li></ul>') == prose


def test_alignment_is_simple_tree_matching():
    rng = random.Random(4)

    def tree(depth):
        node = extract.Node(rng.choice(["div", "p", ""]) if depth else "")
        if node.tag:
            node.children = [tree(depth - 1) for _ in range(rng.randrange(5))]
        return node

    def root():
        r = extract.Node("html")
        r.children = [tree(3) for _ in range(4)]
        return extract._measured(r)

    def leaves_only(a, b):
        return extract.align(a, b)

    for _ in range(200):
        a, b = root(), root()
        pairs = leaves_only(a, b)
        assert [p.number for p, _ in sorted(pairs, key=lambda r: r[0].number)] == sorted({p.number for p, _ in pairs})
        assert [q.number for _, q in sorted(pairs, key=lambda r: r[0].number)] == sorted({q.number for _, q in pairs})
        # as many nodes as the plain recursion matches, counted by giving every inner node a leaf of its own
        for t in (a, b):
            todo = [t]
            while todo:
                n = todo.pop()
                todo += n.children
                if n.tag:
                    mark = extract.Node("")
                    mark.kind = "mark"
                    n.children.insert(0, mark)
            extract._measured(t)
        assert 2 * sum(1 for p, _ in extract.align(a, b) if p.kind == "mark") + sum(1 for p, _ in extract.align(a, b) if p.kind != "mark") == brute_match(a, b)


def test_wrapper_drops_what_a_host_repeats(spark):
    rows = [(i, f"http://same.example/{i}", page(f"<div><div>Our great site</div><div><p>Story {i}</p><p>More {i * 7}</p></div><div>All of it is ours</div></div>"), None) for i in range(8)]
    rows += [(100 + i, f"http://copies.example/{i}", page("<div><p>The same</p></div>"), "clash") for i in range(6)]
    rows += [(200, None, None, None), (201, "no url", "", None), (201, "no url", "", None), (None, "http://x/", "<p>x</p>", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text, r.n_chars) for r in extract.extract(pages).collect()]
    assert len(got) == len(rows) and (3, "Story 3\nMore 21", 15) in got and (102, "The same", 8) in got and (200, "", 0) in got and got.count((201, "", 0)) == 2 and (None, "x", 1) in got
    assert extract.extract(pages.limit(0)).count() == 0


# passages


def words(rng, n):
    return [f"w{rng.randrange(2000)}" for _ in range(n)]


def test_chains_against_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        found = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(rng.randrange(1, 12))})
        pos, apos, size = [x[0] for x in found], [x[1] for x in found], [rng.randrange(1, 9) for _ in found]
        follows = lambda i, j: pos[i] + size[i] <= pos[j] and apos[i] + size[i] <= apos[j]
        between = lambda i, j: pos[j] - pos[i] + apos[j] - apos[i] - 2 * size[i]
        score = []
        for j in range(len(found)):
            best = max((score[i] - passages.GAP_COST * between(i, j) for i in range(j) if follows(i, j)), default=0)
            score.append(size[j] + max(0, best))
        chain = passages.chains(pos, apos, size)[0]
        total = sum(size[x] for x in chain) - sum(passages.GAP_COST * between(i, j) for i, j in zip(chain, chain[1:]))
        assert total == pytest.approx(max(score)) and all(follows(i, j) for i, j in zip(chain, chain[1:]))
        assert sorted(x for c in passages.chains(pos, apos, size) for x in c) == list(range(len(found)))


def test_stretches_put_touching_seeds_together():
    pair = np.array([0, 0, 0, 0, 1, 1])
    pos, apos, size = np.array([3, 8, 30, 5, 3, 3]), np.array([13, 18, 40, 90, 13, 14]), np.array([5, 5, 5, 5, 50, 5])
    got = [x.tolist() for x in passages.stretches(pair, pos, apos, size)]
    assert list(zip(*got)) == [(0, 3, 13, 10), (0, 5, 90, 5), (0, 30, 40, 5), (1, 3, 13, 50), (1, 3, 14, 5)]


def test_common_words():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                m[i][j] = m[i - 1][j - 1] + 1 if x == y else max(m[i - 1][j], m[i][j - 1])
        assert passages.common_words(np.array(a, np.uint64), np.array(b, np.uint64)) == m[-1][-1]


def test_passages(spark):
    rng = random.Random(7)
    shared, other = words(rng, 60), words(rng, 55)
    fuzzy = list(shared)
    fuzzy[20], fuzzy[41] = "changed", "too"
    docs = [(100 + i, " ".join(words(rng, 40) + (shared if i % 2 else fuzzy) + words(rng, 30))) for i in range(30)]
    docs += [(200 + i, " ".join(words(rng, 80) + other)) for i in range(3)] + [(300 + i, " ".join(words(rng, 150))) for i in range(10)]
    docs += [(400, " ".join(words(rng, 90)))] * 3 + [(401, docs[0][1]), (402, " ".join(shared[:30] + words(rng, 40)))]
    d = awkward(spark, docs)
    got = {}
    for r in passages.repeated_passages(d).collect():
        assert got.setdefault(r.doc_id, r) == r or r.doc_id is None
    assert passages.repeated_passages(d).count() == d.count()
    for i in range(30):
        r = got[100 + i]
        spans = [tuple(map(int, s.split(":"))) for s in r.spans.split(",")]
        assert r.group_id == 100 and r.n_links >= 1 and sum(max(0, min(b, 100) - max(a, 40)) for a, b in spans) >= 52
    assert max(got[100 + i].n_links for i in range(30)) >= 14 and got[401].class_id == 100 and got[401].spans == got[100].spans
    assert {got[200 + i].group_id for i in range(3)} == {200} and got[202].dup_words == 55
    assert all(got[300 + i].n_links == 0 and got[300 + i].spans == "" for i in range(10)) and got[400].n_links == got[402].n_links == 0
    assert got[2].class_id == got[3].class_id == got[4].class_id == 2 and got[2].n_words == 0
    assert passages.repeated_passages(empty(spark)).count() == 0


def test_passages_far_apart_in_one_pair(spark):
    rng = random.Random(8)
    head, foot = words(rng, 100), words(rng, 60)
    docs = [(i, " ".join(words(rng, 20) + head + words(rng, 300) + foot + words(rng, 20))) for i in range(2)]
    docs += [(10 + i, " ".join(words(rng, 20) + head[:60] + words(rng, 300) + foot + words(rng, 150) + head[60:])) for i in range(2)]
    got = {r.doc_id: r for r in passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i in range(2):
        found = [tuple(map(int, s.split(":"))) for s in got[i].spans.split(",")]
        assert got[i].n_links >= 1 and [any(a <= s and e <= b for a, b in found) for s, e in ((20, 120), (420, 480))] == [True, True]
        assert got[i].dup_words <= 170
        found = [tuple(map(int, s.split(":"))) for s in got[10 + i].spans.split(",")]
        assert [any(a <= s and e <= b for a, b in found) for s, e in ((20, 80), (380, 440))] == [True, True]


def test_passages_whose_seeds_go_to_holders_of_parts(spark):
    from depquarry.llm._common import word_hashes

    rng = random.Random(14)
    shared = words(rng, 90)

    def text(part, before):
        while True:
            t = " ".join(words(rng, 30) + part + words(rng, 30))
            if (passages.class_of(word_hashes(t.encode())) < 0) == before:
                return t

    docs = [(0, text(shared[:49], True)), (1, text(shared[41:], True)), (2, text(shared, False)), (3, text(shared, False))]
    got = {r.doc_id: r for r in passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [got[i].n_links for i in range(4)] == [0, 0, 1, 1] and [got[i].group_id for i in (2, 3)] == [2, 2]
    for i in (2, 3):
        a, b = map(int, got[i].spans.split(":"))
        assert a <= 30 and b >= 120


def test_exact_passages_against_brute_force(spark):
    rng = random.Random(15)
    base = words(rng, 400)
    docs = []
    for i in range(40):
        n, at = rng.choice((30, 45, 49, 50, 60, 90)), rng.randrange(300)
        docs.append((i, " ".join(words(rng, 20) + base[at : at + n] + words(rng, 20))))
    got = {r.doc_id: r for r in passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    holders: dict[tuple, list] = {}
    for i, t in docs:
        t = t.split()
        for j in range(len(t) - 49):
            holders.setdefault(tuple(t[j : j + 50]), []).append((i, j))
    met = [h for h in holders.values() if len(h) > 1]
    assert len(met) > 50
    for h in met:
        assert len({got[i].group_id for i, _ in h}) == 1
        for i, j in h:
            assert any(a <= j and j + 50 <= b for a, b in (map(int, s.split(":")) for s in got[i].spans.split(",")))


def test_passages_with_every_seventh_word_changed(spark):
    rng = random.Random(13)
    docs = []
    for i in range(20):
        shared = words(rng, 63)
        other = [f"new{rng.randrange(2000)}" if j % 7 == 6 else w for j, w in enumerate(shared)]
        docs += [(2 * i, " ".join(words(rng, 30) + shared + words(rng, 30))), (2 * i + 1, " ".join(words(rng, 30) + other + words(rng, 30)))]
    got = {r.doc_id: r for r in passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(got[2 * i].n_links == got[2 * i + 1].n_links == 1 for i in range(20)) >= 17


def test_similar_runs_against_brute_force():
    rng = random.Random(10)
    for _ in range(100):
        a, b = ([rng.randrange(6) for _ in range(60)] for _ in range(2))
        seeds = sorted({(i, j) for i in range(58) for j in range(58) if a[i : i + 3] == b[j : j + 3]})
        if not seeds:
            continue
        chain = passages.chains([s[0] for s in seeds], [s[1] for s in seeds], [3] * len(seeds), 0.01)[0]
        pos, apos, size = [seeds[x][0] for x in chain], [seeds[x][1] for x in chain], [3] * len(chain)
        x, y = np.array(a, np.uint32), np.array(b, np.uint32)
        gains = [3 + passages.common_words(x[s + 3 : e], y[t + 3 : f]) - 0.8 * max(e - s, f - t) for s, e, t, f in zip(pos, pos[1:], apos, apos[1:])]
        longest = max(pos[j] - pos[i] for i in range(len(pos)) for j in range(i, len(pos)) if sum(gains[i:j]) + 0.6 > -1e-9)
        runs = list(passages.similar_runs(x, y, pos, apos, size, 0.8))
        assert runs[0][1] - runs[0][0] == longest + 3
        for s, e, t, f, same in runs:
            assert passages.common_words(x[s:e], y[t:f]) >= same >= 0.8 * max(e - s, f - t) - 1e-6
        assert {p for p in pos} <= {p for s, e, *_ in runs for p in range(s, e)}


def found_in(spark, docs, **how):
    rows = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string"), **how).collect()
    return {r.doc_id: (r, [tuple(map(int, x.split(":"))) for x in r.spans.split(",") if x]) for r in rows}


def test_many_short_quotes_do_not_part_long_holders(spark):
    rng = random.Random(21)
    shared = words(rng, 200)
    docs = [(i, " ".join(words(rng, 30) + shared + words(rng, 30))) for i in range(2)]
    docs += [(10 + i, " ".join(words(rng, 30) + shared[85:115] + words(rng, 30))) for i in range(400)]
    got = found_in(spark, docs)
    for i in range(2):
        r, spans = got[i]
        assert (r.n_links, r.group_id) == (1, 0) and any(a <= 30 and 230 <= b for a, b in spans) and r.dup_words <= 206
    assert all(got[10 + i][0].n_links == 0 for i in range(400))


def test_short_quotes_do_not_part_a_fuzzy_passage(spark):
    rng = random.Random(23)
    shared = words(rng, 240)
    other = [f"new{i}" if i % 12 == 11 else w for i, w in enumerate(shared)]
    docs = [(i, " ".join(words(rng, 30) + part + words(rng, 30))) for i, part in enumerate((shared, other))]
    for i in range(400):
        at = rng.randrange(211)
        docs.append((10 + i, " ".join(words(rng, 30) + shared[at : at + 30] + words(rng, 30))))
    got = found_in(spark, docs)
    for i in range(2):
        r, spans = got[i]
        assert r.group_id == 0 and r.n_links >= 1 and sum(min(b, 270) - max(a, 30) for a, b in spans if b > 30 and a < 270) >= 225


def test_short_quotes_meet_few_others(spark, monkeypatch):
    """Rows of the second round grow with the holders of a line, not with their square."""
    met, aligned = [], passages._aligned
    monkeypatch.setattr(passages, "_aligned", lambda rows, *how: (met.append(rows.count()), aligned(rows, *how))[1])
    for n in (40, 160):
        rng = random.Random(24)
        line = words(rng, 45)
        docs = [(i, " ".join(words(rng, 30) + line + words(rng, 30))) for i in range(n)]
        assert all(r.n_links == 0 for r, _ in found_in(spark, docs).values())
    assert 0 < met[3] <= 6 * met[1]  # all with all: 16 times


def test_many_holders_of_a_fuzzy_passage_stay_together_among_quotes(spark):
    rng = random.Random(25)
    shared = words(rng, 240)
    docs = [(i, " ".join(words(rng, 30) + [w if rng.random() > 0.04 else f"new{i}-{j}" for j, w in enumerate(shared)] + words(rng, 30))) for i in range(20)]
    for i in range(200):
        at, n = rng.randrange(190), rng.randrange(30, 45)
        docs.append((100 + i, " ".join(words(rng, 30) + shared[at : at + n] + words(rng, 30))))
    got = found_in(spark, docs)
    assert {got[i][0].group_id for i in range(20)} == {0} and all(got[i][0].n_links for i in range(20))
    assert all(sum(min(b, 270) - max(a, 30) for a, b in got[i][1] if b > 30 and a < 270) >= 220 for i in range(20))


@pytest.mark.parametrize("seed", range(4))
def test_passage_twice_in_one_text(spark, seed):
    rng = random.Random(40 + seed)  # either text may be the anchor
    shared = words(rng, 120)
    docs = [(1, " ".join(words(rng, 50) + shared + words(rng, 50) + shared + words(rng, 50))), (2, " ".join(words(rng, 50) + shared + words(rng, 50)))]
    got = found_in(spark, docs)
    assert 240 <= got[1][0].dup_words <= 252 and 120 <= got[2][0].dup_words <= 126 and got[1][0].n_links == got[2][0].n_links == 1
    assert found_in(spark, docs[:1])[1][0].dup_words == 0  # what only one text holds links nothing


def test_repeats_of_linked_spans():
    assert passages.with_repeats([10], [70], [(200, 260, 10, 70)], 50) == [(10, 70), (200, 260)]
    assert passages.with_repeats([10], [40], [(200, 260, 10, 70)], 50) == [(10, 40)]
    assert passages.with_repeats([0], [60], [(20, 90_000, 0, 89_980)], 50) == [(0, 90_000)]
    assert passages.with_repeats([500], [560], [(100, 1000, 0, 900)], 50) == [(a, a + 60) for a in range(0, 1000, 100)]


def test_fuzzy_passages_against_brute_force(spark):
    """All pairs of holders of passages with words changed by chance: from the first to the last word that agrees there
    are 50 words or more, 0.8 of them equal or more."""

    def similar(p, q):
        same = [x for x, (a, b) in enumerate(zip(p, q)) if a == b]
        return len(same) >= 0.8 * (same[-1] + 1 - same[0]) and same[-1] + 1 - same[0] >= passages.MIN_WORDS if same else False

    rng = random.Random(31)
    docs, members = [], {}
    for g in range(60):
        shared = words(rng, rng.choice((52, 60, 100)))
        for _ in range(rng.choice((2, 3, 6, 14))):
            part = [w if rng.random() > 0.05 else f"new{rng.randrange(2000)}" for w in shared]
            members.setdefault(g, []).append((len(docs), part))
            docs.append((len(docs), " ".join(words(rng, 30) + part + words(rng, 30))))
    got = found_in(spark, docs)
    truth = found = covered = holders = 0
    for group in members.values():
        like = {(i, j) for i, p in group for j, q in group if i < j and similar(p, q)}
        truth += len(like)
        found += sum(got[i][0].group_id == got[j][0].group_id and got[i][0].n_links > 0 for i, j in like)
        for i, p in group:
            if any(i in pair for pair in like):
                holders += 1
                covered += sum(max(0, min(b, 30 + len(p)) - max(a, 30)) for a, b in got[i][1]) >= 0.8 * len(p)
        assert {got[i][0].group_id for i, _ in group} <= {i for i, _ in group}  # no group reaches into another
    print(truth, found, holders, covered)
    assert truth > 500 and found >= 0.97 * truth and covered >= 0.97 * holders


def test_a_full_sieve_changes_nothing(spark):
    rng = random.Random(17)
    docs = [(i, " ".join(words(rng, 40) + (words(random.Random(i % 5), 60) if i % 3 else []) + words(rng, 40))) for i in range(30)]
    assert found_in(spark, docs) == found_in(spark, docs, sieve_bits=1)


# the pipeline


def brute_pipeline(rows, items, model):
    import hashlib

    from tokenizers import Tokenizer

    docs = [(i, "\n".join(j[7])) for i, t in rows if (j := quality.judge(t or ""))[6]]
    fps = {}
    for i, t in sorted(docs):
        fps.setdefault(i, int.from_bytes(simhash.wide_fingerprint(t.encode()).tobytes(), "little"))
    comp = {i: i for i in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= simhash.WIDE_RADIUS:
                    comp[a] = min(comp[a], comp[b])
    first = {}
    for i, t in sorted(docs):
        first.setdefault(i, t)
    kept = {i: t for i, t in first.items() if comp[i] == i}
    index = decontaminate.WindowIndex(items)
    kept = {i: t for i, t in kept.items() if index.scan(t.encode())[1] is None}
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    out = {}
    for i, t in kept.items():
        ids = tokenizer.encode(pii.redacted(t, model(kept).spans(t)[1]), add_special_tokens=False).ids + [2]
        out[i] = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), len(ids)
    return out


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    base = PROSE.split()

    def text(n):
        return ". ".join(" ".join(rng.choice(base) + str(rng.randrange(99)) for _ in range(12)) for _ in range(n)) + "."

    rows = [(i, text(8)) for i in range(40)]
    item = " ".join(f"answer{i}" for i in range(14))
    rows += [(100, rows[0][1]), (101, rows[1][1] + " " + item), (102, "Home | a | b | c | d\n" + rows[2][1] + " more words here."), (103, "too short"), (104, f"{text(4)} a.b@example.com {text(4)}"), (105, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    step = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, step, str(tmp_path)).write.parquet(str(tmp_path / f"out{n}"))
        step = spark.read.parquet(str(tmp_path / f"out{n}"))
        assert step.columns == docs.columns, name
    assert "[EMAIL]" in step.filter("doc_id = 104").first().text
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    want = brute_pipeline(rows, [("1", item)], lambda kept: pii.Model([]))
    assert got == {i: n for i, (_, n) in want.items()}
    assert not {100, 101, 103, 105} & set(got) and 104 in got


def test_pipeline_takes_awkward_rows(spark, tmp_path):
    awkward(spark).write.parquet(str(tmp_path / "documents.parquet"))
    items = spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0) for r in rows if r.start == 0) == [0, 1]  # of the copies the smallest id, and the row without one
    docs = awkward(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == awkward(spark).columns
        assert stage(spark, empty(spark), str(tmp_path)).count() == 0
    empty(spark).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    items.limit(0).write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_registry(spark):
    import __spark_entry__ as entry

    ops = {k.split("_")[0] for k in entry.queries() if k.startswith("op")}
    assert ops == {f"op{n}" for n in range(1, 14)} and "pipeline" in entry.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "pii", "packing"]


def test_workers_drop_what_another_stage_loaded():
    from depquarry.llm import _common

    with open(packing.default_tokenizer(), encoding="utf-8") as f:
        packing.ids_by(f.read(), 2)
    _common.drop_caches("tokenizers")
    assert packing._loaded
    _common.drop_caches()
    assert not packing._loaded


def test_near_copies_are_expanded_bit_by_bit():
    rng = np.random.default_rng(1)
    fps = np.repeat(rng.integers(0, 1 << 63, (1, 4)).astype(np.uint64), 8192, axis=0)
    fps[:, 0] ^= np.uint64(1) << rng.integers(0, 64, 8192).astype(np.uint64)
    sizes = [len(i) for i, _ in simhash._pairs(simhash.bit_planes(fps), fps, np.arange(8192), np.arange(8192) // 64, np.full(8192, 127), 50)]
    assert max(sizes) <= 1 << 18  # a step had up to 2 million links


def broadcast_parts(df):
    """What the plan of ``df`` broadcasts, each as the lines of its subtree."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            yield "\n".join(lines[i:end])


def test_what_a_map_multiplies_is_not_broadcast(spark):
    rng = np.random.default_rng(5)
    rows = [(2 * i + j, *map(int, f)) for i, f in enumerate(rng.integers(-(2**62), 2**62, (300, 4))) for j in range(2)]  # so more keys are shared than fingerprints there
    low = simhash.written(spark.createDataFrame(rows, "id long, f0 long, f1 long, f2 long, f3 long"), "low")
    parts = list(broadcast_parts(simhash.wide_links(low)))
    assert parts and not any("MapInArrow" in x for x in parts)  # 48 rows a fingerprint, which Spark sizes as one


def test_written_broadcasts_nothing_large_unasked(spark, monkeypatch):
    from depquarry import storage
    from depquarry.llm import _common

    key, seen = "spark.sql.autoBroadcastJoinThreshold", []
    monkeypatch.setattr(storage, "written", lambda df, name: seen.append(_common._bytes(df.sparkSession.conf.get(key))) or df)
    before = spark.conf.get(key)
    try:
        for given, used in (("10m", 256 << 10), ("10485760b", 256 << 10), ("64k", 64 << 10), ("-1", -1)):
            spark.conf.set(key, given)
            _common.written(spark.range(1), "x")
            assert seen.pop() == used and spark.conf.get(key) == given
    finally:
        spark.conf.set(key, before)


def test_seeds_of_very_many_classes_meet_as_others(spark, monkeypatch, tmp_path):
    """Seeds that are dealt out change no result, and what is written on the way goes."""
    rng, drawn = random.Random(31), lambda n: words(rng, n)
    whole, quote = drawn(120), drawn(20)
    texts = [" ".join(drawn(20) + whole[i % 3 : 90 + i % 31] + quote + drawn(15) + whole[:60]) for i in range(14)]
    docs = spark.createDataFrame([*enumerate(texts), (50, texts[0]), (51, texts[0]), (51, texts[0]), (None, texts[1]), (52, None), (53, "a b")], "doc_id long, text string")
    monkeypatch.setattr("depquarry.storage.shared_dir", lambda _: str(tmp_path))
    got = []
    for often, how in ((1 << 20, {}), (1, {}), (1, {"sieve_bits": 14}), (1 << 20, {"sieve_bits": 14})):
        monkeypatch.setattr(passages, "OFTEN", often)
        got.append(sorted(map(repr, passages.repeated_passages(docs, **how).collect())))
    assert got[0] == got[1] == got[2] == got[3] and len(got[0]) == 20
    left = {x.name.rsplit("-", 1)[0] for x in tmp_path.iterdir()}
    assert left and not left & {"texts", "copied", "shared", "seeds", "met", "held", "holders", "anchors", "chains", "words", "places", "braces"}


def test_chunks_ask_the_shards_not_texts(spark):
    """Rows that are asked and answered grow with chunks and shuffle partitions, not with texts."""
    rng = random.Random(41)
    texts = [" ".join(words(rng, 40)) for _ in range(300)]
    rows = [(i, i, False, None if i == 7 else t) for i, t in enumerate(texts)]
    chunks = lm.written(lm._chunks(spark.createDataFrame(rows, "row long, doc_id long, held_out boolean, text string")), "chunks")
    shards, groups = 24, 6
    keys, counts = np.unique(np.concatenate([lm.token_hashes(t.encode()) for t in texts]), return_counts=True)
    q = lm.quantum(counts)
    of = keys % np.uint64(shards)
    parts = [lm.Filter.build(keys[of == s], q[of == s]) for s in range(shards)]
    filters = spark.createDataFrame([(s, bytearray(p)) for s, p in enumerate(parts)], "shard int, bits binary")
    told = {r.chunk: [x.asDict() for x in r.unigrams] for r in lm._quanta_by_shard(chunks, filters, False, shards, groups).collect()}
    found = chunks.collect()
    assert len(found) <= 8 and sum(map(len, told.values())) <= groups * len(found) and sum(len(r.text) for r in found) == 300
    whole = lm.Filter(parts)
    for r in found:
        asked = np.unique(np.concatenate([lm.token_hashes((t or "").encode()) for t in r.text]))
        assert lm._told(told[r.chunk], asked, False, shards, groups).tolist() == whole.quanta(asked).tolist()
