"""What the graph's queries leave on disk, and how large graphs are walked."""

import os
import random

import numpy as np
import pytest
from graphs import graph, roots, rows

from depquarry import storage
from depquarry.jobs import testgraph
from depquarry.operators import reach, symbols
from depquarry.schema import RELATIONSHIPS

SF = "/root/testdata/sf0.001"


def _shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for _, _, files in os.walk(d.toString()) for f in files if f.startswith("shuffle_")}


def test_settled_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    out = storage.settled(spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count(), "settled")
    assert not _shuffle_files(spark) - before and out.count() == 7
    path = storage._WRITTEN[out]
    storage.drop(out)
    assert not os.path.exists(path)


def test_edges_that_end_are_not_walked(spark, monkeypatch):
    """A graph over the limit whose ends are not: each layer of ends is one join, with the levels of a walk."""
    inner = [("p", "a"), ("a", "b"), ("b", "a"), ("q", "b")]
    leaves = [(x, f"{x}-{i}") for x in "ab" for i in range(30)] + [(f"a-{i}", f"h{i % 3}") for i in range(30)] + [("q", "a-1")]
    pairs = spark.createDataFrame(inner + leaves, "item string, dep string")
    starts = spark.createDataFrame([(q, q) for q in ("p", "q", "a-1", "h1", "none")], "query_id string, node string")
    want = {levels: rows(reach.walk(pairs, starts, levels), "query_id", "node", "level") for levels in (None, 2)}
    monkeypatch.setattr(reach, "walk", None)
    for levels, levelled in want.items():
        assert rows(reach.reach(pairs, starts, levels, limit=20), "query_id", "node", "level") == levelled


def test_parts_of_a_graph():
    rng = np.random.default_rng(5)
    item, dep = rng.integers(0, 60, 40), rng.integers(0, 60, 40)
    label = reach.Packed(item, dep, 60).components()
    near = {i: {i} for i in range(60)}
    for a, b in zip(item.tolist(), dep.tolist()):
        both = near[a] | near[b]
        for x in both:
            near[x] = both
    assert label.tolist() == [min(near[i]) for i in range(60)]
    turned = reach.Packed(item, dep, 60).turned()
    assert sorted(zip(np.repeat(turned.nodes, np.diff(turned.at)).tolist(), turned.to.tolist())) == sorted(zip(dep.tolist(), item.tolist()))


@pytest.mark.parametrize("limit", [1 << 24, 1])
def test_leaks_of_names_that_the_edges_do_not_know(spark, monkeypatch, limit):
    """Objects are asked for, of which the edges between libraries know nothing: nobody searches these edges."""
    monkeypatch.setattr(reach, "EDGE_LIMIT", limit)
    if limit > 1:
        monkeypatch.setattr(symbols, "meeting", None)
    g = graph(spark, {"a.o": ["s", "t"], "b.o": ["s", "none"]}, {"a.o": ["t"], "c.o": ["s"]}, {"l.a": ["a.o"], "m.a": ["b.o", "c.o"]}, {"l.a": ["m.a"], "m.a": ["l.a"]})
    assert rows(symbols.direct_leaks(g, roots(spark, "a.o", "b.o")), "object", "symbol") == [("a.o", "s"), ("b.o", "s")]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_kept_graph_is_the_same(spark):
    g = testgraph.graph(spark, SF)
    for name in random.Random(3).sample(RELATIONSHIPS, 3):
        assert rows(g.rel(name), "item", "dep") == rows(g.edges.filter(f"relationship = '{name}'"), "item", "dep")
    assert rows(g.names("symbol"), "name") == rows(g.nodes.filter("kind = 'symbol'"), "name")
    paths = [storage._WRITTEN[df] for df in g.kept.values()]
    g.forget(*g.kept)
    assert not g.kept and not any(map(os.path.exists, paths))
