import pytest
from graphs import rows

from depquarry.functions.names import detect_type
from depquarry.operators import ingest
from depquarry.schema import BUILD_OBJECTS
from depquarry.sources import build_text, build_tree

TREE = """noise
+-all
  +-prog
  | +-main.o
  | | +-main.cpp
  | | +-a.h
  | +-libx.a
  |   +-x.o
  |   | +-x.cpp
  |   | +-a.h
  |   +-gen
  +-[libx.a]
  +-
some inline code
more of it
  +-/usr/lib/z
the end
  +-after"""


def lines(spark, text, tree="t"):
    return spark.createDataFrame([(tree, i, x) for i, x in enumerate(text.split("\n"))], "tree_id string, pos long, line string")


def test_tree(spark):
    tree = build_tree.parse_build_tree(lines(spark, TREE))
    got = {(r.name, r.pruned): r for r in tree.collect()}
    assert len(got) == 11 and tree.count() == 12 and ("after", False) not in got
    assert got["main.cpp", False].type == "source" and got["a.h", False].type == "header" and got["gen", False].type == "object"
    assert got["libx.a", True].parent_name == "all" and got["libx.a", False].end_pos == 10
    assert got["libx.a", True].inlineCode == "some inline code\nmore of it"
    records = {r._id: r for r in ingest.dedupe_build_objects(ingest.assemble_build_objects(tree)).collect()}
    assert records["prog"].objects == ["main.o"] and records["prog"].deps == ["libx.a"]
    assert records["libx.a"].objects == ["x.o", "gen"] and records["main.o"].source == "main.cpp" and records["main.o"].headers == ["a.h"]
    assert records["all"].deps == ["prog", "libx.a", "/usr/lib/z"]


def test_records_to_graph(spark):
    tree = build_tree.parse_build_tree(lines(spark, TREE))
    dump = spark.createDataFrame([("main.o", " " * 17 + "U x::f(int, long)"), ("main.o", "0000000000000010 T main"), ("main.o", "0000000000000010 T .Llocal"), ("main.o", ""), ("x.o", "0000000000000000 T x::f(int, long)"), ("gen", "0000000000000000 T g")], "object_file string, line string")
    symbols = build_text.parse_symbol_dump(dump)
    assert rows(symbols, "object_file", "symbol", "kind") == [("gen", "g", "defined"), ("main.o", "main", "defined"), ("main.o", "x::f(int, long)", "used"), ("x.o", "x::f(int, long)", "defined")]
    log = spark.createDataFrame([(0, '{"_id": "libx.a", "libdeps": ["old.a"]} tail'), (1, "no json"), (2, '{"_id": "libx.a", "libdeps": ["liby.a"]}'), (3, '{"_id": "unknown", "libdeps": []}')], "line_no long, value string")
    deps = build_text.parse_dep_lines(build_text.extract_dep_lines(log))
    graph = ingest.build_graph(build_text.build_records(tree, symbols, deps))
    assert rows(graph.rel("target_to_dependencies"), "item", "dep") == [("all", "/usr/lib/z"), ("all", "libx.a"), ("all", "prog"), ("libx.a", "liby.a"), ("prog", "libx.a")]
    assert rows(graph.rel("symbol_to_file_sources"), "item", "dep") == [("main", "main.o"), ("x::f(int, long)", "x.o")]  # gen has no child, so no symbols
    assert ("file", "liby.a") in rows(graph.nodes, "kind", "name")


def test_bad_dep_lines(spark):
    log = spark.createDataFrame([(0, "{bad}"), (1, '{"_id": "x"}')], "line_no long, value string")
    found = build_text.extract_dep_lines(log)
    assert [r.bad for r in build_text.parse_dep_lines(found, "quarantine").collect()] == [True, True]
    with pytest.raises(Exception, match="bad dependency line"):
        build_text.parse_dep_lines(found).collect()


def test_edges_of_records(spark):
    records = spark.createDataFrame(
        [("a.o", "object", "a.cpp", ["h.h", ""], ["s", ""], ["t"], None, ["ignored"], None), ("client_build/b.o", "object", "b.cpp", None, None, None, None, None, None), ("l.a", "archive", None, None, None, None, ["a.o"], ["m.a"], None)],
        BUILD_OBJECTS,
    )
    edges = ingest.generate_edges(records)
    assert edges.count() == 2 * 4 + 1 + 1 + 2
    assert rows(edges.filter("relationship = 'dependency_to_targets'"), "item", "dep") == [("a.o", "l.a"), ("m.a", "l.a")]
    assert rows(ingest.generate_edges(records, client_build=True), "item", "dep") == [("b.cpp", "client_build/b.o"), ("client_build/b.o", "b.cpp")]


def test_detect_type(spark):
    got = spark.createDataFrame([(x,) for x in ("/usr/x.h", "a.o", "b.a", "c.js", "/bin/ar", "prog")], "name string").select(detect_type(build_text.F.col("name"))).collect()
    assert [r[0] for r in got] == ["header", "object", "archive", "javascript", "system", "target"]
