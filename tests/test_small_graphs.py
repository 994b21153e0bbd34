from graphs import graph, roots, rows

from depquarry.operators import libs, modules, symbols, traversals
from depquarry.sources.graph_io import nest_modules


def pairs(spark, *edges):
    return spark.createDataFrame(list(edges), "src string, dst string")


def test_cycles(spark):
    edges = pairs(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "f"), ("g", "a"), ("x", "y"))
    assert rows(traversals.lib_cycles_all(edges), "archive", "cycle") == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("f", "f")]
    every = spark.createDataFrame([(n, n) for n in "abcdefgxy"], "query_id string, archive string")
    got = rows(traversals.libs_cycle(edges, every), "target", "hops", "path")
    assert got == [("a", 3, ("b", "c", "a")), ("b", 3, ("c", "a", "b")), ("c", 3, ("a", "b", "c")), ("d", 2, ("e", "d")), ("e", 2, ("d", "e")), ("f", 1, ("f",))]


def test_shortest_cycles(spark):
    ring = [(f"lib{i}.a", f"lib{200 + (i - 199) % 40}.a") for i in range(200, 240)]  # 40 hops around, by numbers beyond 150
    edges = pairs(spark, *ring, ("lib1.a", "lib200.a"), ("lib210.a", "lib300.a"), ("lib300.a", "lib209.a"), ("lib301.a", "lib301.a"))
    got = dict(rows(traversals.shortest_cycles(edges), "archive", "hops"))
    short = {"lib209.a": 3, "lib210.a": 3, "lib300.a": 3, "lib301.a": 1}
    assert got == {**{f"lib{i}.a": 40 for i in range(200, 240)}, **short}


def test_closure_of_diamond_and_cycle(spark):
    g = graph(spark, {}, {}, {}, {"a": ["b", "c"], "b": ["d"], "c": ["d"], "d": ["a"]})
    got = rows(traversals.closure(g, roots(spark, "a")), "node", "level")
    assert got == [("a", 1), ("b", 2), ("c", 2), ("d", 3)]
    assert rows(traversals.closure(g, roots(spark, "a"), 2), "node") == [("a",), ("b",), ("c",)]
    again = traversals.closure(g, traversals.closure(g, roots(spark, "a")).select("query_id", traversals.F.col("node").alias("name")))
    assert again.count() == 4


def test_ambiguous_and_client_definers(spark):
    g = graph(spark, {"u.o": ["s", "t", "v"]}, {"x.o": ["s", "v"], "y.o": ["s"], "client_build/z.o": ["v", "t"]}, {"a.a": ["u.o"], "b.a": ["x.o"], "c.a": ["y.o"]}, {})
    assert rows(libs.libs_needed_good(g, roots(spark, "a.a")), "archive") == [("b.a",)]
    assert rows(libs.libs_needed_bad(g, roots(spark, "a.a")), "symbol", "candidates") == [("s", ("b.a", "c.a"))]
    assert rows(symbols.definer_count(g), "symbol", "n", "class") == [("s", 2, "multiple"), ("t", 0, "none"), ("v", 1, "unique")]


def test_self_need_test_users_and_empty_components(spark):
    g = graph(spark, {"u.o": ["s"], "v_test.o": ["s"], "w.o": ["s"]}, {"x.o": ["s"]}, {"a.a": ["x.o", "u.o"], "b.a": ["w.o"]}, {})
    assert ("a.a", "a.a") in rows(libs.lib_edges(g), "src", "dst")
    # u.o defines nothing, so it counts as outside; v_test.o does not count
    assert rows(symbols.interface(g, roots(spark, "a.a")), "symbol", "used_by") == [("s", ("u.o", "w.o"))]


def test_multiplicity(spark):
    g = graph(spark, {"u.o": ["s"]}, {"x.o": ["s"]}, {"a.a": ["u.o"]}, {})
    assert symbols.symbol_info(g, roots(spark, "a.a", "a.a", query="q"), 1).count() == 2
    assert symbols.symbol_info(g, roots(spark, "a.a", "a.a", query="q")).count() == 1
    assert symbols.direct_leaks(g, roots(spark, "a.a", "a.a", query="q")).count() == 2


def test_leak_kinds(spark):
    g = graph(
        spark,
        {"u.o": ["one", "two", "round", "libc"]},
        {"x.o": ["one"], "y.o": ["two"], "z.o": ["two"], "r.o": ["round"]},
        {"a.a": ["u.o"], "b.a": ["x.o"], "c.a": ["y.o"], "d.a": ["z.o"], "e.a": ["r.o"]},
        {"e.a": ["a.a"]},
    )
    leaked = symbols.direct_leaks(g, roots(spark, "a.a"))
    assert rows(symbols.leak_kind(g, leaked), "symbol", "kind") == [("one", "simple"), ("round", "circular"), ("two", "multiple")]


def test_prefixes_are_absorbed(spark):
    paths = spark.createDataFrame([("q", ["a"]), ("q", ["a", "b"]), ("q", ["a", "b"]), ("r", ["a"])], "query_id string, path array<string>")
    assert rows(traversals.absorb(paths, "query_id"), "query_id", "path") == [("q", ("a", "b")), ("r", ("a",))]
    tree = traversals.paths_to_tree(paths, "query_id")
    assert rows(traversals.tree_paths(tree, "query_id"), "query_id", "path") == [("q", ("a", "b")), ("r", ("a",))]
    assert rows(traversals.tree_flip(paths, "query_id"), "query_id", "path") == [("q", ("a",)), ("q", ("b", "a")), ("r", ("a",))]


FLAT = "system_pos int, system_name string, module_pos int, module_name string, group_ord int, group_title string, file_pos int, file string"


def flat(spark):
    return spark.createDataFrame([(0, "s", 0, "m", 0, "G", 0, "a.cpp"), (0, "s", 0, "m", 0, "G", 1, "gone.cpp"), (0, "s", 1, "n", 0, "G", 0, "b.cpp"), (1, "t", 0, "o", 0, "H", 0, "b.cpp")], FLAT)


def test_modules(spark):
    f = flat(spark)
    assert rows(modules.file_to_module(f), "file", "module_name") == [("a.cpp", "m"), ("b.cpp", "o"), ("gone.cpp", "m")]
    assert rows(modules.flatten_modules(nest_modules(f)), *f.columns) == rows(f, *f.columns)
    files = spark.createDataFrame([("a.cpp",), ("b.cpp",), ("new.cpp",), ("x.o",)], "name string")
    got = rows(modules.diff_modules(f, files), "status", "module_name", "file")
    assert got == [("added", "uncategorized_module", "new.cpp"), ("deleted", "m", "gone.cpp"), ("kept", "m", "a.cpp"), ("kept", "n", "b.cpp"), ("kept", "o", "b.cpp")]


def test_module_interface_and_report(spark):
    g = graph(spark, {"b.o": ["s"], "c.o": ["s"]}, {"a.o": ["s"]}, {"prog": ["a.o", "b.o"]}, {}, {"a.o": ["a.cpp"], "b.o": ["b.cpp"], "c.o": ["c.cpp"]})
    f = flat(spark)
    got = rows(modules.module_interface(g, f), "module_name", "file", "symbol", "other_file", "other_module")
    assert got == [("m", "a.cpp", "s", "b.cpp", "o"), ("m", "a.cpp", "s", "c.cpp", None)]
    buckets = spark.createDataFrame([("prog", "tools")], "name string, bucket string")
    version = spark.createDataFrame([("(no tag)", "(no branch)", "h")], "tag string, branch string, hash string")
    report = modules.module_report(g, f, version, "u/", buckets)
    assert ("a.cpp", "tools", "u/h/a.cpp", 1, 0) in rows(report, "file", "executables", "url", "n_interface", "n_dependencies")
    pages = dict(rows(modules.report_pages(report, modules.module_interface(g, f), modules.module_dependencies(g, f), f), "relative_path", "markdown"))
    assert "s/m/README.md" in pages and "- [a.cpp](u/h/a.cpp)   (tools)" in pages["s/m/README.md"]
    assert "### a.cpp" in pages["s/m/interface/0/README.md"] and "not used outside" in pages["s/n/interface/0/README.md"]


def test_validate_modules(spark):
    from depquarry.schema import MODULES

    bad = [("Bad-Name", "T", "d", [("m", "T!", None, [("g", "d", None)])])]
    systems = spark.createDataFrame(bad, MODULES).selectExpr("0 as system_pos", "*")
    assert rows(modules.validate_modules(systems), "path", "rule") == [
        ("systems/0", "pattern system_name"), ("systems/0/modules/0", "pattern module_title"), ("systems/0/modules/0", "required module_description"), ("systems/0/modules/0/groups/0", "required group_files")
    ]
