"""Reachability by bits against walks and brute force, paths beside each other, names by pieces."""

import json
import random
import time

import numpy as np
import pytest
from graphs import graph, roots, rows

from depquarry.operators import names, reach, symbols, traversals
from depquarry.sources import graph_io, json_map


def brute_levels(edges, starts, levels=None):
    out, front, level = {}, set(starts), 1
    while front and (levels is None or level <= levels):
        out |= {n: level for n in front}
        front = {b for a, b in edges if a in front} - set(out)
        level += 1
    return out


def random_graph(rng, n, m):
    return {(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)}


@pytest.mark.parametrize("limit", [reach.EDGE_LIMIT, 10])
def test_reach_against_brute_force(spark, limit):
    rng = random.Random(1)
    edges = random_graph(rng, 60, 80)
    starts = {(q, f"n{rng.randrange(70)}") for q in range(150) for _ in range(rng.choice([1, 1, 3]))}
    pairs = spark.createDataFrame([*edges, (None, "n1"), ("n2", None)], "item string, dep string")
    asked = spark.createDataFrame(list(starts), "query_id long, node string")
    want = {levels: {(q, n, x) for q in range(150) for n, x in brute_levels(edges, [b for a, b in starts if a == q], levels).items()} for levels in (None, 2)}
    for levels, rows_ in want.items():
        got = [tuple(r) for r in reach.reach(pairs, asked, levels, limit).collect()]
        assert len(got) == len(set(got)) and set(got) == rows_
    wanted = [(q, f"n{rng.randrange(72)}", i) for q in range(-2, 150) for i in range(6)]
    got = sorted(tuple(r) for r in reach.reaching(pairs, asked, spark.createDataFrame(wanted, "query_id long, node string, other long"), limit).collect())
    reached = {(q, n) for q, n, _ in want[None]}
    assert got == sorted(w for w in wanted if w[:2] in reached)


def test_round_trips_against_brute_force(spark):
    rng = random.Random(2)
    edges = random_graph(rng, 150, 260) | {("own", "own"), ("a", "b")}
    want = {n: d for n in {a for a, _ in edges} if (d := brute_levels(edges, [b for a, b in edges if a == n]).get(n))}
    pairs = spark.createDataFrame(list(edges), "item string, dep string")
    got = dict(rows(reach.round_trips(pairs), "node", "hops"))
    assert got == want and got["own"] == 1
    assert reach.round_trips(pairs, limit=5) is None
    walked = traversals.walked_cycles(pairs.withColumnsRenamed({"item": "src", "dep": "dst"}))
    assert dict(rows(walked, "archive", "hops")) == want


def test_empty_graph(spark):
    pairs, asked = spark.createDataFrame([], "item string, dep string"), spark.createDataFrame([("q", "a"), ("q", None)], "query_id string, node string")
    assert rows(reach.reach(pairs, asked), "query_id", "node", "level") == [("q", "a", 1)]
    assert rows(reach.reaching(pairs, asked, asked), "node") == [("a",)]
    assert reach.reach(pairs, asked.limit(0)).count() == 0 and reach.round_trips(pairs).count() == 0


def test_long_chain_takes_seconds(spark):
    chain = [(f"lib{i}.a", f"lib{i + 1}.a") for i in range(1000)]
    g = graph(spark, {}, {}, {}, {a: [b] for a, b in chain})
    began = time.time()
    found = traversals.closure(g, roots(spark, *[f"lib{i}.a" for i in range(0, 1000, 10)]))
    assert found.count() == sum(1001 - i for i in range(0, 1000, 10)) and time.time() - began < 60
    assert found.agg({"level": "max"}).first()[0] == 1001


def test_frontier_step():
    rng = np.random.default_rng(3)
    item, dep = rng.integers(0, 40, 200), rng.integers(0, 40, 200)
    g = reach.Packed(item, dep)
    front = np.flatnonzero(rng.random(len(g.nodes)) < 0.3)
    bits = rng.integers(1, 1 << 62, len(front)).astype(np.uint64)
    want = {}
    for a, b in set(zip(item.tolist(), dep.tolist())):
        at = np.flatnonzero(g.nodes[front] == a)
        if len(at):
            want[b] = want.get(b, 0) | int(bits[at[0]])
    to, got = g.step(front, bits)
    assert dict(zip(g.nodes[to].tolist(), got.tolist())) == want


@pytest.mark.parametrize("few", [2])
def test_leaks_from_both_sides(spark, few):
    rng = random.Random(few + 7)
    objects = [f"o{i}.o" for i in range(40)]
    uses = {o: [f"s{rng.randrange(12)}" for _ in range(3)] for o in objects}
    defines = {o: [f"s{rng.randrange(12)}"] for o in objects}
    parts = {f"l{i}.a": objects[4 * i : 4 * i + 4] for i in range(10)}
    deps = {f"l{i}.a": [f"l{rng.randrange(10)}.a"] for i in range(10)}
    g = graph(spark, {k: sorted(set(v)) for k, v in uses.items()}, defines, parts, deps)
    asked = roots(spark, *parts)
    got = sorted({(r.query_id, r.symbol) for r in symbols.direct_leaks(g, asked, few_holders=few).collect()})
    edges = {(a, b) for a, bs in deps.items() for b in bs}
    held = lambda lib: {s for o in parts[lib] for s in defines[o]}
    ids = {r["name"]: r.query_id for r in asked.collect()}
    somewhere = {s for v in defines.values() for s in v}
    want = set()
    for lib in parts:
        found = set().union(*(held(x) for x in brute_levels(edges, [lib])))
        want |= {(ids[lib], s) for o in parts[lib] for s in uses[o] if s in somewhere and s not in found}
    assert got == sorted(want)
    leaked = spark.createDataFrame([(lib, s) for lib in parts for s in sorted(somewhere)], "query_id string, symbol string")
    kinds = {(r.query_id, r.symbol): r.kind for r in symbols.leak_kind(g, leaked, few).collect()}
    definers = {s: sum(s in v for v in defines.values()) for s in somewhere}
    for (lib, s), kind in kinds.items():
        around = any(lib in brute_levels(edges, [x]) for x in parts if s in held(x))
        assert kind == ("multiple" if definers[s] > 1 else "circular" if around else "simple")


def test_paths_against_tries(spark):
    rng = random.Random(9)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n, partitions in ((0, "4"), (12, "9"), (300, "5")):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        paths = [(rng.choice("xy"), tuple(rng.choice("abc") for _ in range(rng.randrange(1, 6)))) for _ in range(n)]
        df = spark.createDataFrame(paths, "tree string, path array<string>")
        want = {p for p in paths if not any(q[0] == p[0] and q[1][: len(p[1])] == p[1] and q[1] != p[1] for q in paths)}
        got = [(r.tree, tuple(r.path)) for r in traversals.absorb(df, "tree").collect()]
        assert len(got) == len(want) and set(got) == want
        nodes = {(t, i + 1, p[:i], p[i]) for t, p in paths for i in range(len(p))}
        tree = traversals.paths_to_tree(df, "tree")
        got = [(r.tree, r.depth, tuple(r.parent_path), r["name"]) for r in tree.collect()]
        assert len(got) == len(nodes) and set(got) == nodes
        assert {(r.tree, tuple(r.path)) for r in traversals.tree_paths(tree, "tree").collect()} == want
    spark.conf.set("spark.sql.shuffle.partitions", before)
    plan = traversals.absorb(df, "tree")._jdf.queryExecution().toString()
    assert "Generate" not in plan


def test_names_by_pieces(spark):
    rng = random.Random(10)
    text = lambda n: "".join(rng.choice("ab%_*é") for _ in range(n))
    universe = {text(rng.randrange(1, 30)) for _ in range(150)}
    asked = [text(rng.randrange(0, 25)) for _ in range(60)] + [x[rng.randrange(len(x)) :] for x in list(universe)[:60]] + list(universe)[:5] + ["", None]
    df = spark.createDataFrame([(x,) for x in universe], "name string")
    query = spark.createDataFrame([(i, 0, x) for i, x in enumerate(asked)], "query_id int, input_ord int, name string")
    for expand, fits in ((names.expand_file_names, str.endswith), (names.expand_symbol_names, str.__contains__)):
        want = sorted((i, f) for i, x in enumerate(asked) if x is not None for f in universe if f == x or x not in universe and fits(f, x))
        assert sorted((r.query_id, r.full_name) for r in expand(query, df).collect()) == want


def test_json_strings_of_any_split(spark, tmp_path):
    rng = random.Random(12)
    name = lambda: rng.choice(["a", "sym_1", 'q"uote', "back\\slash", 'both\\"', "[x]: {y}", "ü\n", "", "tail\\"]) + str(rng.randrange(30))
    table = {name(): [name() for _ in range(rng.choice([0, 1, 2, 20]))] for _ in range(14)}
    want = sorted((k, v) for k, vs in table.items() for v in vs)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        forms = ({}, {"indent": 4}, {"separators": (" , ", " :"), "ensure_ascii": False})
        for i, form in enumerate(forms):
            (tmp_path / f"m{i}.json").write_text(json.dumps(table, **form))
        for size in ("211",):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = json_map.json_strings(spark, {str(i): str(tmp_path / f"m{i}.json") for i in range(len(forms))}).collect()
            assert all(sorted((r.item, r.text) for r in got if r.source == str(i)) == want for i in range(len(forms)))
        (tmp_path / "list.json").write_text(json.dumps([v for _, v in want]))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
        got = json_map.json_strings(spark, {"list": str(tmp_path / "list.json"), "map": str(tmp_path / "m0.json")}).collect()
        assert sorted(r.text for r in got if r.source == "list") == sorted(v for _, v in want) and sorted((r.item, r.text) for r in got if r.source == "map") == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_dump_round_trip(spark, tmp_path):
    more = {f"m{i}.o": sorted({f"u{i % 7}", f"u{i % 5}"}) for i in range(60)}
    g = graph(spark, {"a.o": ['s"1', "t\\"], **more}, {"b.o": ["t\\"]}, {"l.a": ["a.o", "b.o"]}, {})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several part files a map
    graph_io.dump_graph(g, str(tmp_path / "dump"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "dump" / "relationship=file_to_symbol_dependencies").glob("part-*"))) > 1
    back = graph_io.load_dump(spark, str(tmp_path / "dump"))
    assert rows(back.edges, "relationship", "item", "dep") == rows(g.edges, "relationship", "item", "dep")
    assert rows(back.nodes, "kind", "name") == rows(g.nodes, "kind", "name")
    text = "".join(p.read_text() for p in sorted((tmp_path / "dump" / "relationship=archives_to_components").glob("part-*")))
    assert json.loads(text) == {"l.a": ["a.o", "b.o"]}
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "dump" / "kind=symbol").glob("part-*")))) == ['s"1', "t\\", *(f"u{i}" for i in range(7))]
