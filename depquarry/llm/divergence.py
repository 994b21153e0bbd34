"""Source divergence audit: how far each source's use of words lies from other sources' and from its language's.

A term is a run of letters (A-Z and a-z, and everything beyond ASCII), A-Z lower-cased. A language keeps the V terms that
``MIN_DOCS`` or more of its documents hold. Each (lang, source) group and each language gives a kept term that it holds
``count`` times p = 1 + floor(SCALE * (count + 1) / (N + V)), N being its occurrences of kept terms. The divergence of p
from q is floor((p - q)^2 / q). All arithmetic is on whole numbers.

Terms: upper-bound term search. The terms of a group fall into buckets of equal count, hence of equal p. In a bucket the
divergence is largest at the bucket's smallest probability in the language, which bounds it. Buckets are evaluated best
first until they hold ``TOP`` terms; their ``TOP``-th value then closes every bucket whose bound is strictly below it.

Pairs: most terms are in neither or one of two sources, so a pair's sum is that of two sources that share nothing (from
the buckets alone) plus a correction for every shared term, which postings (the sources of a term) compute: a task adds
up the corrections of its terms in memory and reports one row a pair.

Null text, lang or source counts as empty. Groups without terms are audited too; a language without kept terms has pairs
of value 0 and no term rows. Repeated rows count each. Ties are settled by the UTF-8 order of the item. An empty table
gives no rows. Extra columns are ignored, whatever their names. Texts are counted whole, a block at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import bytes_of, runs_of, struct, table, written

MIN_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
#: Terms that a task holds before it hands on their counts, bytes of text that are split at once, and posting pairs.
HELD_TERMS, BLOCK, PAIRS_AT_ONCE, HELD_PAIRS = 200_000, 1 << 20, 1 << 20, 300_000
_LETTERS = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def blocks_of(raw: bytes, size: int = BLOCK) -> Iterator[list[bytes]]:
    """The terms of a text, block by block."""
    at = 0
    while at < len(raw):
        part = raw[at : at + size].translate(_LETTERS)
        if at + size < len(raw):
            cut = part.rfind(b" ") + 1
            if not cut:  # a term longer than a block: take it whole
                part = raw[at:].translate(_LETTERS)
                cut = part.find(b" ") + 1 or len(part)
            part = part[:cut]
        at += len(part)
        yield part.split()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it); a row of the empty term for every group."""

    def flushed(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (count, within) in held.items():
            terms = [b"", *count]
            of = [pa.array([x] * len(terms), pa.string()) for x in (lang, source)]
            n = pa.array([0, *count.values()], pa.int64())
            yield pa.RecordBatch.from_arrays([*of, pa.array(terms, pa.binary()).cast(pa.string()), n, pa.array([within[t] for t in terms], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            keys = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
            for key, raw in zip(keys, bytes_of(batch)):
                count, within = held.setdefault(key, (Counter(), Counter()))
                before, seen = len(count), set()
                for words in blocks_of(raw):
                    count.update(words)
                    seen.update(words)
                within.update(seen)
                size += len(count) - before
                if size >= HELD_TERMS:
                    yield from flushed(held)
                    held, size = {}, 0
        yield from flushed(held)

    named = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), "text")
    partial = named.mapInArrow(run, struct(lang="string", source="string", term="string", n="long", docs="long"))
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _p(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), in decimals that cannot overflow."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", wide(count + 1) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + terms)) + 1


def _far(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _probabilities(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The groups (lang, source, terms of the lang, held by the group, p0 of a term it lacks), the kept terms of each group
    (lang, source, term, p, p0, q of the lang) and their buckets (lang, source, p, size, open, bound)."""
    counts = written(term_counts(docs), "term-counts")
    of_term = W.partitionBy("lang", "term")  # as many rows as the language has sources
    kept = counts.filter("term <> ''").select("lang", "source", "term", "n", F.sum("docs").over(of_term).alias("docs"), F.sum("n").over(of_term).alias("total"), F.min("source").over(of_term).alias("first"))
    kept = written(kept.filter(F.col("docs") >= MIN_DOCS).drop("docs"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.sum("n").alias("all"), F.sum((F.col("source") == F.col("first")).cast("long")).alias("terms"))
    held = kept.groupBy("lang", "source").agg(F.sum("n").alias("in_group"), F.count("*").alias("held"))
    none = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    groups = counts.filter("term = ''").select("lang", "source").distinct().join(held, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", none("in_group").alias("in_group"), none("held").alias("held"), none("all").alias("all"), none("terms").alias("terms"))
    p0 = F.when(F.col("terms") > 0, _p(F.lit(0).cast("long"), F.col("in_group"), F.greatest("terms", F.lit(1))))
    groups = written(groups.withColumn("p0", p0), "groups")
    scored = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", _p(F.col("n"), F.col("in_group"), F.col("terms")).alias("p"), "p0", _p(F.col("total"), F.col("all"), F.col("terms")).alias("q"))
    scored = written(scored, "scored")
    low = F.min("q")
    buckets = scored.groupBy("lang", "source", "p").agg(F.count("*").alias("size"), F.sum((F.col("p") > F.col("q")).cast("long")).alias("open"), F.when(F.col("p") > low, _far(F.col("p"), low)).alias("bound"))
    return groups, scored, written(buckets, "buckets")


def term_search(scored: DataFrame, buckets: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, term, value, rank of the ``top`` terms that a group uses more than its language."""
    of_group = W.partitionBy("lang", "source")
    best_first = of_group.orderBy(F.desc("bound"), F.desc("p"))
    alive = buckets.filter("open > 0").select("lang", "source", "p", "bound", (F.sum("open").over(best_first) - F.col("open")).alias("before"))
    alive = written(alive, "alive")
    far = scored.filter("p > q").withColumn("value", _far(F.col("p"), F.col("q")))
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(of_group.orderBy(F.desc("value"), "term"))).filter(F.col("rank") <= top)
    begun = ranked(far.join(alive.filter(F.col("before") < top).select("lang", "source", "p"), ["lang", "source", "p"]))
    kth = begun.filter(F.col("rank") == top).select("lang", "source", F.col("value").alias("kth"))
    rest = alive.join(kth, ["lang", "source"], "left").filter("kth is null or bound >= kth").select("lang", "source", "p")
    return ranked(far.join(rest, ["lang", "source", "p"])).select("lang", "source", "term", "value", "rank")


def shared_terms(scored: DataFrame) -> DataFrame:
    """lang, source, item, value: for two sources the sum over shared terms of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)."""
    cols = ["lang", "term", "source", "p", "p0"]
    far = lambda p, q: (p - q) * (p - q) // q

    def add(acc: dict, rows: list[pa.RecordBatch]) -> None:
        t = pa.Table.from_batches(rows)
        lang, term, source, p, p0 = (t.column(c).combine_chunks() for c in cols)
        at = runs_of([lang.to_numpy(zero_copy_only=False), term.to_numpy(zero_copy_only=False)])
        lang, source = (x.dictionary_encode() for x in (lang, source))
        langs, sources = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
        code = lang.indices.to_numpy().astype(np.int64) * len(sources) + source.indices.to_numpy()
        p, p0 = p.to_numpy(), p0.to_numpy()
        size = np.repeat(np.diff(at), np.diff(at))
        begin = np.repeat(at[:-1], np.diff(at))
        todo = np.append(0, np.cumsum(size))
        lo = 0
        while lo < len(code):
            hi = max(lo + 1, int(np.searchsorted(todo, todo[lo] + PAIRS_AT_ONCE, "right")) - 1)
            i = np.repeat(np.arange(lo, hi), size[lo:hi])
            j = np.arange(todo[hi] - todo[lo]) - np.repeat(todo[lo:hi] - todo[lo], size[lo:hi]) + begin[i]
            i, j = i[i != j], j[i != j]
            value = far(p[i], p[j]) - far(p[i], p0[j]) - far(p0[i], p[j]) + far(p0[i], p0[j])
            pair, of = np.unique(code[i] * (len(langs) * len(sources)) + code[j], return_inverse=True)
            total = np.zeros(len(pair), np.int64)
            np.add.at(total, of, value)
            for k, v in zip(pair.tolist(), total.tolist()):
                a, b = divmod(k, len(langs) * len(sources))
                key = (langs[a // len(sources)], sources[a % len(sources)], sources[b % len(sources)])
                acc[key] = acc.get(key, 0) + v
            lo = hi

    def reported(acc: dict) -> pa.RecordBatch:
        lang, source, item = zip(*acc)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (lang, source, item)] + [pa.array(list(acc.values()), pa.int64())], names=["lang", "source", "item", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[tuple, int] = {}
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = batch.column("lang").to_numpy(zero_copy_only=False), batch.column("term").to_numpy(zero_copy_only=False)
            last = int(runs_of(list(ends))[-2])
            if last == 0 and held and (held[-1].column("lang")[-1].as_py(), held[-1].column("term")[-1].as_py()) == (ends[0][0], ends[1][0]):
                held.append(batch)  # the same term goes on; it has a row a source at most
                continue
            if last:
                held.append(batch.slice(0, last))
            if held:
                add(acc, held)
            held = [batch.slice(last)]
            if len(acc) >= HELD_PAIRS:
                yield reported(acc)
                acc = {}
        if held:
            add(acc, held)
        if acc:
            yield reported(acc)

    n = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = scored.select(*cols).repartition(n, "lang", "term").sortWithinPartitions("lang", "term")
    return sorted_.mapInArrow(run, struct(lang="string", source="string", item="string", value="long"))


def pair_values(groups: DataFrame, scored: DataFrame, buckets: DataFrame) -> DataFrame:
    """lang, source, item, value for any two sources of a language: the divergence summed over all kept terms."""
    mine = groups.select("lang", "source", "held", "p0", "terms")
    other = groups.select("lang", F.col("source").alias("item"), F.col("held").alias("item_held"), F.col("p0").alias("q0"))
    pairs = mine.join(other, "lang").filter("source <> item")
    neither = F.when(F.col("terms") > 0, (F.col("terms") - F.col("held") - F.col("item_held")) * _far(F.col("p0"), F.col("q0"))).otherwise(F.lit(0).cast("long"))
    pairs = written(pairs.select("lang", "source", "item", "p0", "q0", neither.alias("value")), "pairs")
    of = buckets.select("lang", F.col("source").alias("of"), "p", "size")
    here = pairs.drop("value").join(of.withColumnRenamed("of", "source"), ["lang", "source"]).select("lang", "source", "item", (F.col("size") * _far(F.col("p"), F.col("q0"))).alias("value"))
    there = pairs.drop("value").join(of.withColumnRenamed("of", "item"), ["lang", "item"]).select("lang", "source", "item", (F.col("size") * _far(F.col("p0"), F.col("p"))).alias("value"))
    every = pairs.select("lang", "source", "item", "value").unionByName(here).unionByName(there).unionByName(shared_terms(scored))
    return every.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    groups, scored, buckets = _probabilities(docs)
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(groups, scored, buckets).withColumn("rank", F.row_number().over(order))
    terms = term_search(scored, buckets, top).withColumnRenamed("term", "item")
    out = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return out(pairs, "pair").unionByName(out(terms, "term"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
tok AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM tok GROUP BY ALL),
keep AS (SELECT lang, term, sum(n)::HUGEINT AS total FROM c GROUP BY ALL HAVING sum(docs) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS nl FROM keep GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c JOIN keep USING (lang, term) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(gn.n, 0) + v.v) AS p, 1 + (1000000000::HUGEINT * (k.total + 1)) // (v.nl + v.v) AS q
  FROM g JOIN v USING (lang) JOIN keep k USING (lang) LEFT JOIN gn USING (lang, source) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
f AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b USING (lang) WHERE a.source <> b.source) LEFT JOIN s USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM f QUALIFY part = 'pair' OR rank <= 200"""
