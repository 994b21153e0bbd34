import pytest
from graphs import MAIN, C, F, M, S, U, fixture, roots, rows

from depquarry.operators import filegraph, libs, lookups, modules, names, symbols, traversals
from depquarry.sources import graph_io


@pytest.fixture(scope="module")
def g(spark):
    made = fixture(spark)
    return type(made)(made.edges.cache(), made.nodes.cache())


def test_names(spark, g):
    expand = lambda n: [r[0] for r in rows(names.expand_file_names(roots(spark, n), g.names("file")), "full_name")]
    assert expand("memcmp.o") == sorted([S, M, F, U])
    assert expand("program") == ["program"] and expand("string.a") == ["libstring.a"] and expand("nothing") == []
    found = lambda n: [r[0] for r in rows(names.expand_symbol_names(roots(spark, n), g.names("symbol")), "full_name")]
    assert found("str") == ["strcpy", "strlen"] and found("m") == ["malloc", "memcmp"]
    twice = names.expand_file_names(roots(spark, "memcmp.o", "cmp.o", query="q"), g.names("file"))
    assert twice.count() == 8


def test_interface(spark, g):
    get = lambda n: rows(symbols.interface(g, roots(spark, n)), "symbol", "object", "archive", "used_by")
    assert get("libmemory.a") == [("free", F, "libmemory.a", (C,)), ("malloc", M, "libmemory.a", (C,))]
    assert get("libstring.a") == [("strcpy", C, "libstring.a", (MAIN,)), ("strlen", S, "libstring.a", (MAIN,))]
    assert get("libutil.a") == [("memcmp", U, "libutil.a", tuple(sorted([S, C, M, F])))]
    assert get("program") == []


def test_leaks(spark, g):
    ignore = spark.createDataFrame([(C, F)], "query_id string, name string")
    got = rows(symbols.leaks(g, roots(spark, C), 2, ignore), "symbol", "object", "archive", "path")
    assert got == [("malloc", C, None, ("libmemory.a", M)), ("memcmp", C, None, ("libutil.a", U))]
    direct = lambda n: rows(symbols.direct_leaks(g, roots(spark, n)), "symbol")
    assert direct(C) == [("free",), ("malloc",), ("memcmp",)] and direct(MAIN) == [("strcpy",), ("strlen",)]
    assert symbols.direct_leaks(g, libs.all_archives(g)).count() == 0
    hidden = spark.createDataFrame([("malloc",)], "symbol string")
    assert rows(symbols.direct_leaks(g, roots(spark, C), exclude=hidden), "symbol") == [("free",), ("memcmp",)]
    plan = symbols.direct_leaks(g, roots(spark, C))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_leaks_end_with_their_providers(spark, g):
    providers = spark.createDataFrame([(C, "libmemory.a"), (C, "libutil.a")], "query_id string, name string")
    assert symbols.direct_leaks(g, roots(spark, C), providers).count() == 0


def test_libs(spark, g):
    assert rows(libs.lib_edges(g), "src", "dst") == [("libmemory.a", "libutil.a"), ("libstring.a", "libmemory.a"), ("libstring.a", "libutil.a"), ("program", "libstring.a")]
    assert libs.libs_needed_bad(g, libs.all_archives(g)).count() == 0
    edges = libs.lib_edges(g)
    assert traversals.libs_cycle(edges, roots(spark, "program", "libutil.a").withColumnRenamed("name", "archive").select("query_id", "archive")).count() == 0
    extra = libs.extra_libdeps(g, libs.all_archives(g)).groupBy("archive").count()
    assert rows(extra, "archive", "count") == [("libmemory.a", 3), ("libstring.a", 4), ("libutil.a", 1)]
    assert libs.extra_libdeps_precise(g).count() == 0
    nodes, lines = libs.render_d3(libs.all_extra_libdeps(g))
    assert nodes.count() == 3 and lines.count() == 8


def test_executables(spark, g):
    known = spark.createDataFrame([("program", "p")], "name string, bucket string")
    wanted = spark.createDataFrame([("q", n) for n in (U, "provides_memcmp.h", "main.cpp", "program")], "query_id string, name string")
    found = traversals.executables(g, wanted, known)
    assert [r[1] for r in rows(found, "name", "executable")] == ["program"] * 4
    assert traversals.executables(g, wanted).count() == 0
    assert rows(traversals.exec_digest(found, known), "bucket") == [("p",)] * 4


def test_file_graph(spark, g):
    got = {r for r in rows(filegraph.file_graph(g), "file", "provider", "symbols", "weight")}
    assert (U, None, None, 0) in got and (C, M, ("malloc",), 1) in got and len(got) == 9
    assert filegraph.file_graph(g, with_symbols=False).columns == ["file", "provider", "weight"]


def test_family_paths(spark, g):
    symbol = spark.createDataFrame([("q", "memcmp")], "query_id string, symbol string")
    get = lambda d, **k: [r[0] for r in rows(traversals.symbol_family_paths(g, symbol, d, **k), "path")]
    assert get(1) == [(U,)] and get(2) == [("libutil.a", U)] and get(0) == []
    assert get(3, order="reference") == [("libutil.a", "libmemory.a", U), ("libutil.a", "libstring.a", U)]
    assert get(4, order="reference") == [("libutil.a", "libstring.a", "libmemory.a", U), ("libutil.a", "program", "libstring.a", U)]
    assert get(3) == [("libmemory.a", "libutil.a", U), ("libstring.a", "libutil.a", U)]
    files = spark.createDataFrame([("q", "libmemory.a")], "query_id string, name string")
    of = lambda d: [r[0] for r in rows(traversals.file_family_paths(g, files, d, "reference"), "path")]
    assert of(2) == [("libstring.a", "libmemory.a")] and of(3) == [("libstring.a", "program", "libmemory.a")]


def test_lookups(spark, g):
    assert rows(lookups.lookup(g, "sources", roots(spark, "str")), "item", "deps") == [("strcpy", (C,)), ("strlen", (S,))]
    assert rows(lookups.lookup(g, "definitions", roots(spark, MAIN)), "item", "deps") == [(MAIN, ())]
    assert rows(lookups.graph_holds(g, "target_to_dependencies", "libutil.a"), "item") == [("libmemory.a",), ("libstring.a",)]
    assert dict(rows(lookups.graph_resolve(g, "program"), "relationship", "deps"))["archives_to_components"] == (MAIN,)
    with pytest.raises(ValueError):
        g.rel("unknown")
    assert names.filter_names(g.names("file")) is None
    with pytest.raises(ValueError):
        names.filter_names(g.names("file"), prefix="a", suffix="b")


def test_inverses_are_swaps(g):
    for there, back in (("file_to_symbol_dependencies", "symbol_to_file_dependencies"), ("file_to_symbol_definitions", "symbol_to_file_sources"), ("file_to_source", "source_to_file"), ("file_to_header_includes", "header_to_files_including")):
        assert rows(g.rel(there), "item", "dep") == rows(g.rel(back), "dep", "item")


def test_round_trips(spark, g, tmp_path):
    meta = lookups.attach_extra_info(spark, 1, "p", '{"data":["arbitrary data, possibly version information"]}')
    full = type(g)(g.edges, g.nodes, meta)
    graph_io.write_graph(full, str(tmp_path / "a"))
    back = graph_io.read_graph(spark, str(tmp_path / "a"), with_meta=True)
    assert rows(back.edges, "relationship", "item", "dep") == rows(g.edges, "relationship", "item", "dep")
    assert rows(back.nodes, "kind", "name") == rows(g.nodes, "kind", "name")
    assert back.meta.first().extra_info == meta.first().extra_info
    graph_io.export_graph_json(full, str(tmp_path / "b"))
    assert rows(graph_io.import_graph_json(spark, str(tmp_path / "b")).edges, "relationship", "item", "dep") == rows(g.edges, "relationship", "item", "dep")
    other = lookups.merge_graphs(g, type(g)(g.edges.limit(3), g.nodes.limit(2)))
    assert other.edges.count() == g.edges.count()


def test_dumped_graph(spark, tmp_path):
    (tmp_path / "file_to_source.json").write_text('{"a.cpp": ["a.o"], "b.cpp": []}')
    (tmp_path / "files.json").write_text('["a.cpp", "a.o", "a.o"]')
    got = graph_io.read_dumped_graph(spark, {"file_to_source": str(tmp_path / "file_to_source.json")}, {"files": str(tmp_path / "files.json")}, swap_sources=True)
    assert rows(got.edges, "relationship", "item", "dep") == [("source_to_file", "a.cpp", "a.o")]
    assert got.nodes.count() == 2


def test_file_queries(spark, g):
    sources = spark.createDataFrame([(C.replace(".o", ".cpp"),)], "name string")
    got = rows(modules.file_dependencies(g, sources), "symbol", "other_file")
    assert got == [("free", F.replace(".o", ".cpp")), ("malloc", M.replace(".o", ".cpp")), ("memcmp", U.replace(".o", ".cpp"))]
    assert rows(modules.file_interface(g, sources), "symbol", "other_file") == [("strcpy", "main.cpp")]
    one = spark.createDataFrame([("q", "main.cpp")], "query_id string, name string")
    assert [r[0] for r in rows(modules.file_headers(g, one), "header")] == ["provides_strcpy.h", "provides_strlen.h"]
