"""Small graphs for tests."""

from depquarry.schema import EDGES, NODES, Graph

S, C, M, F, U, MAIN = "provides_strlen_needs_memcmp.o", "provides_strcpy_needs_memcmp_malloc_free.o", "provides_malloc_needs_memcmp.o", "provides_free_needs_memcmp.o", "provides_memcmp.o", "main.o"
USES = {MAIN: ["strlen", "strcpy"], S: ["memcmp"], C: ["memcmp", "malloc", "free"], M: ["memcmp"], F: ["memcmp"]}
DEFINES = {S: ["strlen"], C: ["strcpy"], M: ["malloc"], F: ["free"], U: ["memcmp"]}
COMPONENTS = {"program": [MAIN], "libstring.a": [S, C], "libmemory.a": [M, F], "libutil.a": [U]}
DEPS = {"program": ["libstring.a"], "libstring.a": ["libutil.a", "libmemory.a"], "libmemory.a": ["libutil.a"]}


def graph(spark, uses, defines, components, deps, sources=None, headers=None, both=False):
    """``both``: declared dependencies list the components too."""
    pairs = lambda d: [(k, v) for k, vs in d.items() for v in vs]
    all_deps = pairs(deps) + (pairs(components) if both else [])
    rows = [("file_to_symbol_dependencies", a, b) for a, b in pairs(uses)] + [("symbol_to_file_dependencies", b, a) for a, b in pairs(uses)]
    rows += [("file_to_symbol_definitions", a, b) for a, b in pairs(defines)] + [("symbol_to_file_sources", b, a) for a, b in pairs(defines)]
    rows += [("archives_to_components", a, b) for a, b in pairs(components)] + [("target_to_dependencies", a, b) for a, b in all_deps]
    rows += [("dependency_to_targets", b, a) for a, b in {*all_deps, *pairs(components)}]
    rows += [("file_to_source", a, b) for a, b in pairs(sources or {})] + [("source_to_file", b, a) for a, b in pairs(sources or {})]
    rows += [("file_to_header_includes", a, b) for a, b in pairs(headers or {})] + [("header_to_files_including", b, a) for a, b in pairs(headers or {})]
    symbols = {b for a, b in pairs(uses) + pairs(defines)}
    files = {x for r in rows for x in r[1:]} - symbols
    nodes = [("symbol", x) for x in sorted(symbols)] + [("file", x) for x in sorted(files)]
    return Graph(spark.createDataFrame(rows, EDGES), spark.createDataFrame(nodes, NODES))


def fixture(spark):
    sources = {o: [o.replace(".o", ".cpp")] for o in (MAIN, S, C, M, F, U)}
    headers = {MAIN: ["provides_strlen.h", "provides_strcpy.h"], S: ["provides_memcmp.h"], C: ["provides_memcmp.h"], M: ["provides_memcmp.h"], F: ["provides_memcmp.h"], U: ["provides_memcmp.h"]}
    return graph(spark, USES, DEFINES, COMPONENTS, DEPS, sources, headers, both=True)


def roots(spark, *names, query=None):
    return spark.createDataFrame([(query if query is not None else n, i, n) for i, n in enumerate(names)], "query_id string, input_ord int, name string")


def rows(df, *cols):
    return sorted((tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.select(*cols).collect()), key=str)
