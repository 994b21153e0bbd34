"""The registered queries on the graph of ``testgraph``, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import detect_type, joined
from ..operators import filegraph, libs, lookups, modules, names, symbols, traversals
from ..schema import RELATIONSHIPS, Graph
from ..storage import remove
from ..storage import settled as written
from . import testgraph

_OBJ = "'build/' || CASE WHEN o_orderpriority = '5-LOW' THEN 'client_build/' ELSE '' END || 'o' || o_orderkey || CASE WHEN o_orderstatus = 'P' THEN '_test' ELSE '' END || '.o'"
BASE_SQL = f"""WITH RECURSIVE
obj AS (SELECT o_orderkey AS k, 'lib' || o_custkey || '.a' AS lib, 'src/o' || o_orderkey || '.cpp' AS src, {_OBJ} AS name FROM orders),
symdeps AS (SELECT DISTINCT name AS item, 'sym_' || l_partkey AS dep FROM lineitem JOIN obj ON l_orderkey = k WHERE l_quantity < 49),
symdefs AS (SELECT DISTINCT name AS item, 'sym_' || l_partkey AS dep FROM lineitem JOIN obj ON l_orderkey = k WHERE l_quantity >= 49),
headers AS (SELECT DISTINCT name AS item, p_brand || '.h' AS dep FROM lineitem JOIN obj ON l_orderkey = k JOIN part ON l_partkey = p_partkey),
deps AS (SELECT DISTINCT item, dep FROM (
  SELECT 'lib' || c_custkey || '.a' AS item, 'lib' || (c_custkey // 2) || '.a' AS dep FROM customer WHERE c_custkey > 0
  UNION ALL SELECT 'lib' || c_custkey || '.a', 'lib' || (c_custkey // 3) || '.a' FROM customer WHERE c_custkey > 0
  UNION ALL SELECT 'prog' || c_nationkey, 'lib' || c_custkey || '.a' FROM customer WHERE c_mktsegment = 'MACHINERY')),
comps AS (SELECT DISTINCT lib AS item, name AS dep FROM obj),
holders AS (SELECT dep AS item, item AS dep FROM deps UNION SELECT dep, item FROM comps),
edges AS (
  SELECT 'file_to_symbol_dependencies' AS relationship, item, dep FROM symdeps UNION ALL SELECT 'symbol_to_file_dependencies', dep, item FROM symdeps
  UNION ALL SELECT 'file_to_symbol_definitions', item, dep FROM symdefs UNION ALL SELECT 'symbol_to_file_sources', dep, item FROM symdefs
  UNION ALL SELECT 'file_to_header_includes', item, dep FROM headers UNION ALL SELECT 'header_to_files_including', dep, item FROM headers
  UNION ALL SELECT 'file_to_source', name, src FROM obj UNION ALL SELECT 'source_to_file', src, name FROM obj
  UNION ALL SELECT 'target_to_dependencies', item, dep FROM deps UNION ALL SELECT 'archives_to_components', item, dep FROM comps
  UNION ALL SELECT 'dependency_to_targets', item, dep FROM holders),
files AS (SELECT name FROM obj UNION SELECT src FROM obj UNION SELECT dep FROM headers UNION SELECT item FROM deps UNION SELECT dep FROM deps UNION SELECT item FROM comps),
syms AS (SELECT dep AS name FROM symdeps UNION SELECT dep FROM symdefs),
arch AS (SELECT DISTINCT item AS a FROM comps),
reach AS (SELECT a AS q, a AS node, 1::BIGINT AS level FROM arch UNION SELECT q, dep, level + 1 FROM reach JOIN deps ON node = item),
closed AS (SELECT q, node, min(level) AS level FROM reach GROUP BY q, node),
need AS (SELECT c.item AS archive, c.dep AS object, s.dep AS symbol FROM comps c JOIN symdeps s ON c.dep = s.item),
own AS (SELECT c.item AS archive, c.dep AS object, s.dep AS symbol FROM comps c JOIN symdefs s ON c.dep = s.item),
leaked AS (SELECT n.* FROM need n WHERE symbol IN (SELECT dep FROM symdefs)
  AND NOT EXISTS (SELECT 1 FROM own o JOIN closed ON closed.node = o.archive WHERE closed.q = n.archive AND o.symbol = n.symbol)),
definers AS (SELECT dep AS symbol, count(*) AS n, min(item) AS only_one FROM symdefs WHERE NOT contains(item, 'client_build') GROUP BY dep),
ledges AS (SELECT DISTINCT archive AS src, h.dep AS dst FROM need JOIN definers USING (symbol) JOIN holders h ON h.item = only_one WHERE n = 1),
hier AS (SELECT lower(r_name) AS system_name, lower(n_name) AS module_name, ascii(c_mktsegment) AS group_ord, c_mktsegment AS group_title, 'src/o' || o_orderkey || '.cpp' AS file
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


def _roots(spark: SparkSession, *texts: str) -> DataFrame:
    return spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "query_id int, input_ord int, name string")


def _flat(df: DataFrame, **cols: str) -> DataFrame:
    """Sets as sorted text."""
    return df.select(*[joined(F.col(c)).alias(c) if dict(df.dtypes)[c].startswith("array") else c for c in df.columns]).withColumnsRenamed(cols)


def _archives(g: Graph) -> DataFrame:
    return libs.all_archives(g)


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, sf_dir, testgraph.graph(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = BASE_SQL + sql
        return f

    return add


@_query("SELECT relationship, item, dep FROM edges")
def generate_edges(spark, sf_dir, g):
    return g.edges


@_query("SELECT 'file' AS kind, name FROM files UNION ALL SELECT 'symbol', name FROM syms")
def collect_nodes(spark, sf_dir, g):
    return g.nodes


_DETECT = "CASE WHEN ends_with(name, '.h') THEN 'header' WHEN ends_with(name, '.o') THEN 'object' WHEN ends_with(name, '.a') THEN 'archive' WHEN ends_with(name, '.js') THEN 'javascript' WHEN starts_with(name, '/') THEN 'system' ELSE 'target' END"


@_query(f"SELECT name, {_DETECT} AS type FROM files")
def detect_types(spark, sf_dir, g):
    return g.names("file").select("name", detect_type(F.col("name")).alias("type"))


_FILE_ROOTS = ("7.o", "9_test.o", "lib1.a", "lib12.a", "no such file", "99.cpp")
_VALUES = lambda xs: ", ".join(f"({i}, '{x}')" for i, x in enumerate(xs))


@_query(f"SELECT i::INT AS query_id, f.name AS full_name FROM (VALUES {_VALUES(_FILE_ROOTS)}) v(i, t) JOIN files f ON f.name = t OR (ends_with(f.name, t) AND t NOT IN (SELECT name FROM files))")
def expand_file_names(spark, sf_dir, g):
    return names.expand_file_names(_roots(spark, *_FILE_ROOTS), g.names("file")).select("query_id", "full_name")


_SYMBOL_ROOTS = ("sym_1", "m_12", "77", "none")


@_query(f"SELECT i::INT AS query_id, f.name AS full_name FROM (VALUES {_VALUES(_SYMBOL_ROOTS)}) v(i, t) JOIN syms f ON f.name = t OR (contains(f.name, t) AND t NOT IN (SELECT name FROM syms))")
def expand_symbol_names(spark, sf_dir, g):
    return names.expand_symbol_names(_roots(spark, *_SYMBOL_ROOTS), g.names("symbol")).select("query_id", "full_name")


@_query("SELECT name FROM files WHERE ends_with(name, '_test.o')")
def list_names(spark, sf_dir, g):
    return names.list_names(g.names("file"), "_test.o")


@_query("SELECT name FROM files WHERE starts_with(name, 'build/client_build/')")
def filter_names(spark, sf_dir, g):
    return names.filter_names(g.names("file"), prefix="build/client_build/")


@_query("SELECT 'children' AS lookup, a AS item, coalesce(string_agg(dep, ',' ORDER BY dep), '') AS deps, count(dep) AS n FROM arch LEFT JOIN deps ON a = item GROUP BY a")
def lookup(spark, sf_dir, g):
    found = lookups.lookup(g, "children", _archives(g))
    return found.select(F.lit("children").alias("lookup"), "item", joined(F.col("deps")).alias("deps"), F.size("deps").cast("long").alias("n"))


_LOOKUPS = ", ".join(f"('{what}', '{relationship}')" for what, (relationship, _) in lookups.LOOKUPS.items())


@_query(f"SELECT lookup, item, string_agg(dep, ',' ORDER BY dep) AS deps, count(*) AS n FROM edges JOIN (VALUES {_LOOKUPS}) v(lookup, relationship) USING (relationship) GROUP BY lookup, item")
def lookup_every(spark, sf_dir, g):
    """All eleven lookups, each of every name that has something to look up."""
    parts = []
    for what, (relationship, _) in lookups.LOOKUPS.items():
        items = g.rel(relationship).select("item").distinct().select(F.col("item").alias("query_id"), F.lit(0).alias("input_ord"), F.col("item").alias("name"))
        found = lookups.lookup(g, what, items).select(F.lit(what).alias("lookup"), "item", joined(F.col("deps")).alias("deps"), F.size("deps").cast("long").alias("n"))
        parts.append(written(found, "lookup"))
    g.forget(*g.kept)
    return reduce(DataFrame.unionAll, parts)


@_query("SELECT name AS item, coalesce(string_agg(dep, ',' ORDER BY dep), '') AS deps FROM obj LEFT JOIN symdefs ON name = item GROUP BY name")
def graph_get(spark, sf_dir, g):
    return _flat(lookups.graph_get(g, "file_to_symbol_definitions", g.rel("file_to_source").select(F.col("item").alias("name"))))


@_query("SELECT item, string_agg(dep, ',' ORDER BY dep) AS deps FROM symdeps WHERE starts_with(item, 'build/client') GROUP BY item")
def graph_get_startswith(spark, sf_dir, g):
    return _flat(lookups.graph_get_startswith(g, "file_to_symbol_dependencies", "build/client"))


@_query("SELECT item, string_agg(dep, ',' ORDER BY dep) AS deps FROM symdeps WHERE ends_with(item, '1.o') GROUP BY item")
def graph_get_endswith(spark, sf_dir, g):
    return _flat(lookups.graph_get_endswith(g, "file_to_symbol_dependencies", "1.o"))


@_query("SELECT item, string_agg(dep, ',' ORDER BY dep) AS deps FROM symdeps WHERE contains(item, '_test') GROUP BY item")
def graph_get_contains(spark, sf_dir, g):
    return _flat(lookups.graph_get_contains(g, "file_to_symbol_dependencies", "_test"))


@_query("SELECT item, string_agg(dep, ',' ORDER BY dep) AS deps FROM deps WHERE item IN (SELECT item FROM deps WHERE dep = 'lib1.a') GROUP BY item")
def graph_holds(spark, sf_dir, g):
    return _flat(lookups.graph_holds(g, "target_to_dependencies", "lib1.a"))


@_query("SELECT DISTINCT item FROM headers")
def graph_nodes(spark, sf_dir, g):
    return lookups.graph_nodes(g, "file_to_header_includes")


@_query("SELECT item, dep FROM headers")
def graph_slice(spark, sf_dir, g):
    return lookups.graph_slice(g, "file_to_header_includes")


@_query(f"SELECT relationship, coalesce(string_agg(dep, ',' ORDER BY dep), '') AS deps FROM (SELECT unnest({list(RELATIONSHIPS)}) AS relationship) LEFT JOIN (SELECT relationship, dep FROM edges WHERE item = 'lib1.a') USING (relationship) GROUP BY relationship")
def graph_resolve(spark, sf_dir, g):
    return _flat(lookups.graph_resolve(g, "lib1.a"))


@_query("SELECT relationship, item, dep FROM edges WHERE item IN (SELECT item FROM comps)")
def graph_narrow(spark, sf_dir, g):
    return lookups.graph_narrow(g, g.rel("archives_to_components").select(F.col("item").alias("name")))


@_query("SELECT src AS name, name AS object FROM obj")
def source_to_object(spark, sf_dir, g):
    return lookups.source_to_object(g, g.rel("source_to_file").select(F.lit(0).alias("query_id"), F.col("item").alias("name"))).select("name", "object")


@_query("SELECT name, src AS source FROM obj")
def object_to_source(spark, sf_dir, g):
    return lookups.object_to_source(g, g.rel("file_to_source").select(F.lit(0).alias("query_id"), F.col("item").alias("name"))).select("name", "source")


@_query("SELECT relationship, item, dep FROM edges WHERE relationship <> 'file_to_source'")
def merge_graphs(spark, sf_dir, g):
    one = g.edges.filter(~F.col("relationship").isin("file_to_source", "source_to_file"))
    two = g.edges.filter(F.col("relationship").isin("source_to_file", "target_to_dependencies"))
    return lookups.merge_graphs(Graph(one, g.nodes), Graph(two, g.nodes)).edges


@_query("SELECT relationship, item, dep FROM edges UNION SELECT 'file_to_header_includes', src, 'all.h' FROM obj")
def add_edges(spark, sf_dir, g):
    more = g.rel("source_to_file").select(F.lit("file_to_header_includes").alias("relationship"), "item", F.lit("all.h").alias("dep"))
    return lookups.add_edges(g, more.union(more.select(F.lit("unknown"), "item", "dep"))).edges


@_query("SELECT DISTINCT q AS archive, own.archive AS holder, own.symbol, own.object FROM closed JOIN own ON node = own.archive WHERE level <= 2")
def symbol_info(spark, sf_dir, g):
    return symbols.symbol_info(g, _archives(g), 2, "definition").select(F.col("query_id").alias("archive"), F.col("archive").alias("holder"), "symbol", "object").distinct()


@_query("SELECT q AS query_id, node, level FROM closed")
def closure(spark, sf_dir, g):
    return traversals.closure(g, _archives(g))


@_query("SELECT item AS name, dep AS parent FROM holders UNION ALL SELECT dep, item FROM headers UNION ALL SELECT src, name FROM obj")
def parents_of(spark, sf_dir, g):
    every = traversals.parent_pairs(g).select(F.lit(0).alias("query_id"), F.col("item").alias("name")).distinct()
    return traversals.parents_of(g, every).select("name", "parent")


@_query("SELECT archive, object, symbol FROM leaked")
def direct_leaks(spark, sf_dir, g):
    return symbols.direct_leaks(g, _archives(g)).select(F.col("query_id").alias("archive"), "object", "symbol")


@_query("SELECT archive, object, symbol, c.item || '>' || c.dep AS source_path FROM leaked JOIN symdefs d ON symbol = d.dep JOIN comps c ON c.dep = d.item")
def leaks(spark, sf_dir, g):
    return symbols.leaks(g, _archives(g), 2).select(F.col("query_id").alias("archive"), "object", "symbol", F.array_join("path", ">").alias("source_path"))


@_query("""SELECT archive, object, symbol, string_agg(DISTINCT u.item, ',' ORDER BY u.item) AS used_by, count(DISTINCT u.item) AS n_users FROM own JOIN symdeps u ON u.dep = symbol
WHERE NOT contains(u.item, '_test.o') AND NOT EXISTS (SELECT 1 FROM own p WHERE p.archive = own.archive AND p.object = u.item) GROUP BY archive, object, symbol""")
def interface(spark, sf_dir, g):
    return symbols.interface(g, _archives(g)).select("archive", "object", "symbol", joined(F.col("used_by")).alias("used_by"), F.size("used_by").cast("long").alias("n_users"))


@_query("SELECT name AS symbol, coalesce(n, 0) AS n, CASE WHEN n = 1 THEN 'unique' WHEN n > 1 THEN 'multiple' ELSE 'none' END AS class FROM syms LEFT JOIN definers ON name = symbol")
def definer_count(spark, sf_dir, g):
    return symbols.definer_count(g)


@_query("""SELECT DISTINCT archive, symbol, CASE WHEN symbol IN (SELECT symbol FROM definers WHERE n > 1) THEN 'multiple'
WHEN EXISTS (SELECT 1 FROM own o JOIN closed ON closed.q = o.archive WHERE o.symbol = leaked.symbol AND closed.node = leaked.archive) THEN 'circular' ELSE 'simple' END AS kind FROM leaked""")
def leak_kind(spark, sf_dir, g):
    return symbols.leak_kind(g, symbols.direct_leaks(g, _archives(g))).select(F.col("query_id").alias("archive"), "symbol", "kind")


_EXCLUDED = "'sym_' || p_partkey FROM part WHERE p_partkey % 3 = 0"


def _hidden(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_partkey % 3 = 0").select(F.concat(F.lit("sym_"), F.col("p_partkey").cast("string")).alias("symbol"))


@_query(f"SELECT archive, object, symbol, c.item || '>' || c.dep AS source_path FROM leaked JOIN symdefs d ON symbol = d.dep JOIN comps c ON c.dep = d.item WHERE symbol NOT IN (SELECT {_EXCLUDED})")
def leaks_exclude(spark, sf_dir, g):
    found = symbols.leaks(g, _archives(g), 2, exclude=_hidden(spark, sf_dir))
    return found.select(F.col("query_id").alias("archive"), "object", "symbol", F.array_join("path", ">").alias("source_path"))


@_query(f"""SELECT DISTINCT archive, object, symbol, u.item AS user FROM own JOIN symdeps u ON u.dep = symbol WHERE NOT contains(u.item, '_test.o')
AND NOT EXISTS (SELECT 1 FROM own p WHERE p.archive = own.archive AND p.object = u.item) AND symbol NOT IN (SELECT {_EXCLUDED})""")
def interface_exclude(spark, sf_dir, g):
    return symbols.interface(g, _archives(g), _hidden(spark, sf_dir)).select("archive", "object", "symbol", F.explode("used_by").alias("user"))


@_query("SELECT src AS archive, dst AS needed FROM ledges")
def libs_needed_good(spark, sf_dir, g):
    return libs.libs_needed_good(g, _archives(g)).select(F.col("query_id").alias("archive"), F.col("archive").alias("needed"))


@_query("""SELECT archive, object, symbol, coalesce(c, '') AS candidates FROM need JOIN definers USING (symbol)
LEFT JOIN (SELECT d.dep AS symbol, string_agg(DISTINCT h.dep, ',' ORDER BY h.dep) AS c FROM symdefs d JOIN holders h ON h.item = d.item WHERE NOT contains(d.item, 'client_build') GROUP BY d.dep) USING (symbol) WHERE n > 1""")
def libs_needed_bad(spark, sf_dir, g):
    return libs.libs_needed_bad(g, _archives(g)).select("archive", "object", "symbol", joined(F.col("candidates")).alias("candidates"))


@_query("SELECT src, dst FROM ledges")
def lib_edges(spark, sf_dir, g):
    return libs.lib_edges(g)


#: All archives and any number of hops: each pair is kept once, at its first level.
_CYCLE = """, met(q, node, hops) USING KEY (q, node) AS (SELECT src, dst, 1::BIGINT FROM ledges
UNION SELECT m.q, e.dst, min(m.hops) + 1 FROM met m JOIN ledges e ON m.node = e.src LEFT JOIN recurring.met r ON r.q = m.q AND r.node = e.dst WHERE r.q IS NULL GROUP BY m.q, e.dst) """


@_query(_CYCLE + "SELECT q AS archive, hops FROM met WHERE q = node")
def libs_cycle(spark, sf_dir, g):
    return traversals.shortest_cycles(libs.lib_edges(g))


@_query(_CYCLE + "SELECT a.q AS archive, min(b.q) AS cycle FROM met a JOIN met b ON a.q = b.node AND a.node = b.q GROUP BY a.q")
def lib_cycles_all(spark, sf_dir, g):
    return traversals.lib_cycles_all(libs.lib_edges(g))


_EXTRA = "SELECT a AS archive, deps.dep AS extra FROM arch JOIN deps ON a = deps.item WHERE EXISTS (SELECT 1 FROM own o WHERE o.archive = a AND NOT EXISTS (SELECT 1 FROM need n WHERE n.archive = a AND n.symbol = o.symbol))"


@_query(_EXTRA)
def extra_libdeps(spark, sf_dir, g):
    return libs.extra_libdeps(g, _archives(g)).select("archive", "extra")


@_query(f"SELECT 'unneeded_archives' AS relationship, archive AS source, extra AS target FROM ({_EXTRA})")
def all_extra_libdeps(spark, sf_dir, g):
    return libs.all_extra_libdeps(g).drop("edge")


@_query("SELECT item AS archive, dep AS extra FROM deps WHERE NOT EXISTS (SELECT 1 FROM own o JOIN need n ON n.symbol = o.symbol WHERE o.archive = deps.dep AND n.archive = deps.item)")
def extra_libdeps_precise(spark, sf_dir, g):
    return libs.extra_libdeps_precise(g)


@_query(f"SELECT extra AS \"to\", archive AS \"from\", 'unneeded_archives' AS relationship FROM ({_EXTRA})")
def render_d3(spark, sf_dir, g):
    return libs.render_d3(libs.all_extra_libdeps(g))[1]


@_query(f"SELECT DISTINCT archive AS id FROM ({_EXTRA})")
def render_d3_nodes(spark, sf_dir, g):
    return libs.render_d3(libs.all_extra_libdeps(g))[0]


@_query(f"SELECT archive AS source, extra AS target FROM ({_EXTRA}) WHERE ends_with(archive, '7.a')")
def results_narrow(spark, sf_dir, g):
    wanted = spark.createDataFrame([("7.a",), ("none.a",)], "name string")
    return lookups.results_narrow(libs.all_extra_libdeps(g), wanted).select("source", "target")


@_query("""SELECT name AS file, provider, symbols, coalesce(weight, 0) AS weight FROM obj LEFT JOIN (
SELECT u.item, d.item AS provider, string_agg(u.dep, ',' ORDER BY u.dep) AS symbols, count(*) AS weight FROM symdeps u JOIN symdefs d ON u.dep = d.dep
WHERE NOT contains(u.item, 'client_build') AND NOT contains(d.item, 'client_build') GROUP BY u.item, d.item) ON name = item""")
def file_graph(spark, sf_dir, g):
    return _flat(filegraph.file_graph(g))


_EXECS = ", up AS (SELECT DISTINCT item AS f, item AS node FROM (SELECT item FROM holders UNION SELECT dep FROM headers UNION SELECT src FROM obj UNION SELECT dep FROM holders) UNION SELECT f, p.dep FROM up JOIN (SELECT item, dep FROM holders UNION SELECT dep, item FROM headers UNION SELECT src, name FROM obj) p ON up.node = p.item) "


def _executables(spark, sf_dir, g):
    every = g.names("file").select(F.lit(0).alias("query_id"), "name")
    return traversals.executables(g, every, testgraph.programs(spark, sf_dir))


@_query(_EXECS + "SELECT f AS file, node AS executable FROM up WHERE starts_with(node, 'prog')")
def executables(spark, sf_dir, g):
    return _executables(spark, sf_dir, g).select(F.col("name").alias("file"), "executable")


@_query(_EXECS + "SELECT DISTINCT f AS file, 'region' || n_regionkey AS bucket FROM up JOIN nation ON node = 'prog' || n_nationkey WHERE n_regionkey > 0")
def exec_digest(spark, sf_dir, g):
    return traversals.exec_digest(_executables(spark, sf_dir, g), testgraph.programs(spark, sf_dir)).select(F.col("name").alias("file"), "bucket")


@_query(_EXECS + "SELECT f AS file, node AS executable FROM up WHERE NOT contains(node, '.')")
def undotted_executables(spark, sf_dir, g):
    every = g.names("file").select(F.lit(0).alias("query_id"), "name")
    return traversals.executables(g, every, traversals.undotted_executables(g)).select(F.col("name").alias("file"), "executable")


@_query("""SELECT DISTINCT a AS start, coalesce(h2.dep || '>', '') || coalesce(h1.dep || '>', '') || a AS path FROM arch LEFT JOIN holders h1 ON h1.item = a LEFT JOIN holders h2 ON h2.item = h1.dep""")
def file_family_paths(spark, sf_dir, g):
    roots = _archives(g).select("query_id", "name")
    return traversals.file_family_paths(g, roots, 3).select(F.col("query_id").alias("start"), F.array_join("path", ">").alias("path"))


@_query("""SELECT DISTINCT a AS start, coalesce(h1.dep || '>', '') || coalesce(h2.dep || '>', '') || a AS path FROM arch LEFT JOIN holders h1 ON h1.item = a LEFT JOIN holders h2 ON h2.item = h1.dep
WHERE h2.dep IS NOT NULL OR h1.dep IS NULL OR NOT EXISTS (SELECT 1 FROM holders o JOIN holders t ON t.item = o.dep WHERE o.item = a AND t.dep = h1.dep)""")
def file_family_paths_reference(spark, sf_dir, g):
    """Every level turned round; a container without containers is absorbed where it begins another chain."""
    found = traversals.file_family_paths(g, _archives(g).select("query_id", "name"), 3, "reference")
    return found.select(F.col("query_id").alias("start"), F.array_join("path", ">").alias("path"))


@_query("SELECT d.dep AS start, h.dep || '>' || d.item AS path FROM symdefs d JOIN holders h ON h.item = d.item")
def symbol_family_paths(spark, sf_dir, g):
    roots = g.names("symbol").select(F.col("name").alias("query_id"), F.col("name").alias("symbol"))
    return traversals.symbol_family_paths(g, roots, 2).select(F.col("query_id").alias("start"), F.array_join("path", ">").alias("path"))


@_query("SELECT d.dep AS start, d.item || '>' || h.dep AS path FROM symdefs d JOIN holders h ON h.item = d.item")
def tree_flip(spark, sf_dir, g):
    roots = g.names("symbol").select(F.col("name").alias("query_id"), F.col("name").alias("symbol"))
    return traversals.tree_flip(traversals.symbol_family_paths(g, roots, 2), "query_id").select(F.col("query_id").alias("start"), F.array_join("path", ">").alias("path"))


_TRIE = "p AS (SELECT d.dep AS start, h.dep AS a, d.item AS b FROM symdefs d JOIN holders h ON h.item = d.item) "


@_query(", " + _TRIE + "SELECT DISTINCT start, 1 AS depth, '' AS parent, a AS name FROM p UNION SELECT start, 2, a, b FROM p")
def paths_to_tree(spark, sf_dir, g):
    roots = g.names("symbol").select(F.col("name").alias("query_id"), F.col("name").alias("symbol"))
    return traversals.paths_to_tree(traversals.symbol_family_paths(g, roots, 2), "query_id").select(F.col("query_id").alias("start"), "depth", F.array_join("parent_path", ">").alias("parent"), "name")


@_query("SELECT d.dep AS start, h.dep || '>' || d.item AS path FROM symdefs d JOIN holders h ON h.item = d.item")
def tree_paths(spark, sf_dir, g):
    roots = g.names("symbol").select(F.col("name").alias("query_id"), F.col("name").alias("symbol"))
    tree = traversals.paths_to_tree(traversals.symbol_family_paths(g, roots, 2), "query_id")
    return traversals.tree_paths(tree, "query_id").select(F.col("query_id").alias("start"), F.array_join("path", ">").alias("path"))


@_query("SELECT system_name, module_name, group_ord, group_title, file FROM hier")
def flatten_modules(spark, sf_dir, g):
    from ..sources.graph_io import nest_modules

    nested = nest_modules(testgraph.modules(spark, sf_dir))
    flat = modules.flatten_modules(nested)
    return flat.select("system_name", "module_name", F.ascii("group_title").alias("group_ord"), "group_title", "file")


@_query("SELECT file, system_name FROM hier")
def file_to_system(spark, sf_dir, g):
    return modules.file_to_system(testgraph.modules(spark, sf_dir))


@_query("SELECT file, module_name FROM hier")
def file_to_module(spark, sf_dir, g):
    return modules.file_to_module(testgraph.modules(spark, sf_dir))


_SYSTEMS = "nation JOIN region ON n_regionkey = r_regionkey"


@_query(f"""SELECT 'systems/' || r_regionkey AS path, 'required system_description' AS rule, NULL::VARCHAR AS value FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)
UNION ALL SELECT 'systems/' || r_regionkey, 'pattern system_name', r_name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation) AND NOT regexp_full_match(r_name, '[_a-z0-9]*')
UNION ALL SELECT 'systems/' || r_regionkey || '/modules/' || i, rule, value FROM (SELECT r_regionkey, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1 AS i, n_name FROM {_SYSTEMS}) m,
LATERAL (SELECT unnest(['required module_description', 'required module_groups', 'pattern module_name']) AS rule, unnest([NULL, NULL, n_name]) AS value) v WHERE value IS NULL OR NOT regexp_full_match(value, '[_a-z0-9]*')""")
def validate_modules(spark, sf_dir, g):
    n, r = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    module = F.struct(F.col("n_name").alias("module_name"), F.lit("Title").alias("module_title"), F.lit(None).cast("string").alias("module_description"), F.lit(None).cast("array<struct<group_title:string,group_description:string,group_files:array<string>>>").alias("module_groups"))
    nested = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey", "r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", module.alias("m")))).alias("ms"))
    systems = nested.select(F.col("r_regionkey").alias("system_pos"), F.col("r_name").alias("system_name"), F.lit("Title").alias("system_title"), F.lit(None).cast("string").alias("system_description"), F.transform("ms", lambda x: x["m"]).alias("system_modules"))
    return modules.validate_modules(systems)


@_query("""SELECT CASE WHEN o_orderkey % 10 = 3 THEN 'deleted' ELSE 'kept' END AS status, system_name, module_name, group_title, file FROM hier JOIN orders ON file = 'src/o' || o_orderkey || '.cpp'
UNION ALL SELECT 'added', 'uncategorized_system', 'uncategorized_module', 'Uncategorized Group', dep FROM (SELECT DISTINCT dep FROM headers)""")
def diff_modules(spark, sf_dir, g):
    files = g.names("file").filter(~F.col("name").rlike("^src/o[0-9]*3[.]cpp$"))
    return modules.diff_modules(testgraph.modules(spark, sf_dir), files)


@_query("SELECT DISTINCT src AS file, dep AS header FROM obj JOIN headers ON name = item")
def file_headers(spark, sf_dir, g):
    sources = g.rel("source_to_file").select(F.lit(0).alias("query_id"), F.col("item").alias("name"))
    return modules.file_headers(g, sources).select(F.col("name").alias("file"), "header")


_FILE_IF = """fi AS (SELECT DISTINCT o.src AS file, d.dep AS symbol, u2.src AS other_file FROM obj o JOIN symdefs d ON d.item = o.name JOIN symdeps u ON u.dep = d.dep JOIN obj u2 ON u2.name = u.item WHERE u.item <> o.name AND NOT contains(u.item, '_test.o')) """
_FILE_DEP = """fd AS (SELECT DISTINCT o.src AS file, u.dep AS symbol, d2.src AS other_file FROM obj o JOIN symdeps u ON u.item = o.name JOIN symdefs d ON d.dep = u.dep JOIN obj d2 ON d2.name = d.item WHERE NOT EXISTS (SELECT 1 FROM symdefs x WHERE x.item = o.name AND x.dep = u.dep)) """


def _sources(g: Graph) -> DataFrame:
    return g.rel("source_to_file").select(F.col("item").alias("name"))


@_query(", " + _FILE_IF + "SELECT file, symbol, other_file FROM fi")
def file_interface(spark, sf_dir, g):
    return modules.file_interface(g, _sources(g))


@_query(", " + _FILE_DEP + "SELECT file, symbol, other_file FROM fd")
def file_dependencies(spark, sf_dir, g):
    return modules.file_dependencies(g, _sources(g))


@_query(", " + _FILE_IF + "SELECT a.system_name AS system, a.module_name AS module, a.file, symbol, other_file FROM fi JOIN hier a ON a.file = fi.file JOIN hier b ON b.file = other_file WHERE a.module_name <> b.module_name")
def module_interface(spark, sf_dir, g):
    return modules.module_interface(g, testgraph.modules(spark, sf_dir)).select(F.col("system_name").alias("system"), F.col("module_name").alias("module"), "file", "symbol", "other_file")


@_query(", " + _FILE_DEP + "SELECT a.system_name AS system, a.module_name AS module, a.file, symbol, other_file FROM fd JOIN hier a ON a.file = fd.file JOIN hier b ON b.file = other_file WHERE a.module_name <> b.module_name")
def module_dependencies(spark, sf_dir, g):
    return modules.module_dependencies(g, testgraph.modules(spark, sf_dir)).select(F.col("system_name").alias("system"), F.col("module_name").alias("module"), "file", "symbol", "other_file")


def _version(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("(no tag)", "main", "abc")], "tag string, branch string, hash string")


_REPORT = ", " + _FILE_IF + ", " + _FILE_DEP + """, fx AS (SELECT h.file, count(DISTINCT symbol) AS n FROM fi JOIN hier h ON h.file = fi.file JOIN hier b ON b.file = other_file WHERE h.module_name <> b.module_name GROUP BY h.file),
dx AS (SELECT h.file, count(DISTINCT symbol) AS n FROM fd JOIN hier h ON h.file = fd.file JOIN hier b ON b.file = other_file WHERE h.module_name <> b.module_name GROUP BY h.file),
up AS (SELECT DISTINCT src AS f, name AS node FROM obj UNION SELECT f, h.dep FROM up JOIN holders h ON up.node = h.item),
ex AS (SELECT f, string_agg(DISTINCT 'region' || n_regionkey, ', ' ORDER BY 'region' || n_regionkey) AS e FROM up JOIN nation ON node = 'prog' || n_nationkey WHERE n_regionkey > 0 GROUP BY f)
SELECT system_name, module_name, group_ord, group_title, hier.file, coalesce(e, '') AS executables, 'https://example.org/tree/main/' || hier.file AS url, coalesce(fx.n, 0) AS n_interface, coalesce(dx.n, 0) AS n_dependencies
FROM hier LEFT JOIN ex ON f = hier.file LEFT JOIN fx ON fx.file = hier.file LEFT JOIN dx ON dx.file = hier.file"""


@_query(_REPORT)
def module_report(spark, sf_dir, g):
    return modules.module_report(g, written(testgraph.modules(spark, sf_dir), "modules"), _version(spark), "https://example.org/tree/", testgraph.programs(spark, sf_dir))


@_query("SELECT relationship, item, dep FROM edges")
def write_graph(spark, sf_dir, g):
    """Round trip through storage."""
    from ..sources.graph_io import read_graph
    from ..sources.graph_io import write_graph as write
    from ..storage import scratch_path

    path = scratch_path(spark, "graph")
    write(g, path)
    return read_graph(spark, path).edges


@_query("SELECT relationship, item, dep FROM edges UNION ALL SELECT 'symbols', name, '' FROM syms UNION ALL SELECT 'files', name, '' FROM files")
def read_dumped_graph(spark, sf_dir, g):
    """Round trip through a dump: a JSON map a relationship, an array a node list, found by their header."""
    from ..sources.graph_io import dump_graph, load_dump
    from ..storage import scratch_path

    path = scratch_path(spark, "graph-dump")
    dump_graph(g.whole(), path)
    g.forget(*g.kept)
    back = load_dump(spark, path)
    remove(spark, path)  # what was read is written by itself
    return back.edges.unionByName(back.nodes.select(F.concat("kind", F.lit("s")).alias("relationship"), F.col("name").alias("item"), F.lit("").alias("dep")))


@_query("SELECT relationship, item, dep FROM edges")
def read_graph(spark, sf_dir, g):
    """Round trip through the JSON interchange form."""
    from ..sources.graph_io import export_graph_json, import_graph_json
    from ..storage import scratch_path

    path = scratch_path(spark, "graph-json")
    export_graph_json(g, path)
    return import_graph_json(spark, path).edges


@_query(f"SELECT DISTINCT archive, h.dep AS needed FROM need JOIN definers USING (symbol) JOIN holders h ON h.item = only_one WHERE n = 1 AND symbol NOT IN (SELECT {_EXCLUDED})")
def libs_needed_exclude(spark, sf_dir, g):
    return libs.libs_needed_good(g, _archives(g), _hidden(spark, sf_dir)).select(F.col("query_id").alias("archive"), F.col("archive").alias("needed"))


_EXTRA_INFO = '{"version_info": {"branch": "main", "hash": "abc", "tag": "(no tag)"}, "build_info": {"flags": ["-O2", "-g"], "platform": "linux"}}'


@_query("SELECT 'main' AS branch, 'abc' AS hash, '(no tag)' AS tag, '-O2 -g' AS flags, 'linux' AS platform, count(*) AS n_edges FROM edges")
def attach_extra_info(spark, sf_dir, g):
    """Through storage and through the interchange form, beside the edges."""
    from ..sources.graph_io import export_graph_json, import_graph_json, read_graph, write_graph
    from ..storage import scratch_path

    one, two = scratch_path(spark, "graph"), scratch_path(spark, "graph-json")
    every = g.whole()
    write_graph(Graph(every.edges, every.nodes, lookups.attach_extra_info(spark, 1, sf_dir, _EXTRA_INFO)), one)
    g.forget(*g.kept)
    export_graph_json(read_graph(spark, one, with_meta=True), two)
    remove(spark, one)
    back = import_graph_json(spark, two, with_meta=True)
    n = back.edges.agg(F.count("*").alias("n_edges"))
    return lookups.version_and_build_info(back.meta).select("branch", "hash", "tag", F.array_join("flags", " ").alias("flags"), "platform").join(F.broadcast(n))


_TITLES = "'System ' || r_name AS system_title, 'What # ' || lower(r_name) || '_does.' || chr(10) || 'More.' AS system_description, 'Module ' || n_name AS module_title, 'All of ' || lower(n_name) || '_code.' AS module_description, 'Files_of ' || c_mktsegment AS group_description"
_TITLED = f"""SELECT r_regionkey, n_nationkey, lower(r_name) AS system_name, lower(n_name) AS module_name, ascii(c_mktsegment) AS group_ord, c_mktsegment AS group_title, 'src/o' || o_orderkey || '.cpp' AS file, {_TITLES}
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def _through_files(spark: SparkSession, structure: DataFrame) -> DataFrame:
    from ..sources.graph_io import read_modules, write_modules
    from ..storage import scratch_path

    path = scratch_path(spark, "modules")
    write_modules(structure, path)
    return read_modules(spark, path)


@_query(f"SELECT system_name, module_name, group_title, file, system_title, system_description, module_title, module_description, group_description FROM ({_TITLED})")
def write_modules(spark, sf_dir, g):
    """Flat rows written, read back and made flat again."""
    flat = modules.flatten_modules(_through_files(spark, testgraph.modules(spark, sf_dir)))
    return flat.select("system_name", "module_name", "group_title", "file", *modules.TEXTS)


@_query(f"""SELECT dense_rank() OVER (ORDER BY r_regionkey) - 1 AS system_pos, system_name, system_title, n_modules, n_groups, n_files FROM
(SELECT r_regionkey, system_name, system_title, count(DISTINCT module_name) AS n_modules, count(DISTINCT module_name || group_title) AS n_groups, count(*) AS n_files FROM ({_TITLED}) GROUP BY ALL)""")
def read_modules(spark, sf_dir, g):
    """The nested structure as it comes from its file."""
    groups = F.flatten(F.transform("system_modules", lambda m: m["module_groups"]))
    size = lambda c: F.size(c).cast("long")
    return _through_files(spark, testgraph.modules(spark, sf_dir)).select(F.col("system_pos").cast("long").alias("system_pos"), "system_name", "system_title", size("system_modules").alias("n_modules"), size(groups).alias("n_groups"), size(F.flatten(F.transform(groups, lambda x: x["group_files"]))).alias("n_files"))


_MD = lambda c: f"ltrim(replace(replace(replace({c}, '#', ' '), '_', '\\_'), chr(10), chr(10) || chr(10)))"
_ESC = lambda c: f"replace({c}, '_', '\\_')"


def _group_page_sql(rows: str, folder: str) -> str:
    title, verb, about, nothing = (x.replace("\n", "") for x in modules._PHRASES[folder])
    other = f"'    - [' || {_ESC('o.file')} || '](../../../../' || {_ESC('o.system_name')} || '/' || {_ESC('o.module_name')} || ')' || chr(10)"
    return f"""SELECT k.system_name || '/' || k.module_name || '/{folder}/' || k.group_ord || '/README.md' AS relative_path,
chr(10) || '# {title} for ' || k.group_title || chr(10) || '{about}' || chr(10) || coalesce(t, '{nothing}' || chr(10)) AS markdown
FROM (SELECT DISTINCT system_name, module_name, group_ord, group_title FROM titled) k LEFT JOIN (
  SELECT system_name, module_name, group_ord, string_agg(chr(10) || '### ' || {_ESC('file')} || chr(10) || t, '' ORDER BY file) AS t FROM (
    SELECT system_name, module_name, group_ord, file, string_agg(chr(10) || '<div></div>' || chr(10) || chr(10) || '    ' || symbol || chr(10) || chr(10) || '- {verb}:' || chr(10) || chr(10) || t, '' ORDER BY symbol) AS t FROM (
      SELECT k.system_name, k.module_name, k.group_ord, k.file, r.symbol, string_agg({other}, '' ORDER BY o.file) AS t
      FROM {rows} r JOIN titled k ON k.file = r.file JOIN titled o ON o.file = r.other_file WHERE o.module_name <> k.module_name GROUP BY ALL) GROUP BY ALL) GROUP BY ALL) p
ON p.system_name = k.system_name AND p.module_name = k.module_name AND p.group_ord = k.group_ord"""


_PAGES = (
    _REPORT[: _REPORT.index("SELECT system_name, module_name, group_ord, group_title, hier.file")]
    + f""", titled AS ({_TITLED}),
grp AS (SELECT n_nationkey, system_name, module_name, module_title, module_description, group_ord, group_title, group_description, string_agg('- [' || {_ESC('file')} || '](https://example.org/tree/main/' || file || ')   (' || coalesce(e, '') || ')' || chr(10), '' ORDER BY file) AS files FROM titled LEFT JOIN ex ON f = file GROUP BY ALL)
SELECT system_name || '/' || module_name || '/README.md' AS relative_path, '# ' || module_title || chr(10) || {_MD('module_description')} || chr(10) || chr(10)
 || string_agg(chr(10) || '-------------' || chr(10) || chr(10) || '## ' || group_title || chr(10) || {_MD('group_description')} || chr(10) || chr(10) || '#### Files' || chr(10) || files || chr(10) || '#### [Interface](interface/' || group_ord || ')' || chr(10) || chr(10) || '#### [Dependencies](dependencies/' || group_ord || ')' || chr(10), '' ORDER BY group_ord) AS markdown
FROM grp GROUP BY system_name, module_name, module_title, module_description
UNION ALL SELECT system_name || '/README.md', '# ' || system_title || chr(10) || chr(10) || {_MD('system_description')} || chr(10) || chr(10) || '## Modules' || chr(10) || chr(10) || string_agg('### [' || module_title || '](' || {_ESC('module_name')} || ')' || chr(10) || {_MD('module_description')} || chr(10) || chr(10), '' ORDER BY n_nationkey)
FROM (SELECT DISTINCT n_nationkey, system_name, system_title, system_description, module_name, module_title, module_description FROM titled) GROUP BY system_name, system_title, system_description
UNION ALL SELECT 'README.md', '# Codebase map' || chr(10) || 'Generated pages.' || chr(10) || chr(10) || '* Build flags: -O2 -g' || chr(10) || '* Build platform: linux' || chr(10) || '* Version hash: abc' || chr(10) || '* Version branch: main' || chr(10) || '* Version tag: (no tag)' || chr(10) || '* URL: https://example.org/tree/main/' || chr(10) || chr(10)
 || string_agg('## [' || system_title || '](' || {_ESC('system_name')} || ')' || chr(10) || {_MD('system_description')} || chr(10) || chr(10), '' ORDER BY r_regionkey) FROM (SELECT DISTINCT r_regionkey, system_name, system_title, system_description FROM titled)
UNION ALL """
    + _group_page_sql("fi", "interface")
    + " UNION ALL "
    + _group_page_sql("fd", "dependencies")
)


@_query(_PAGES)
def module_pages(spark, sf_dir, g):
    flat = written(testgraph.modules(spark, sf_dir), "modules")
    version = lookups.version_and_build_info(lookups.attach_extra_info(spark, 1, sf_dir, _EXTRA_INFO))
    inside, outside = written(modules.module_interface(g, flat), "interface"), written(modules.module_dependencies(g, flat), "dependencies")
    report = written(modules.module_report(g, flat, version, "https://example.org/tree/", testgraph.programs(spark, sf_dir), inside, outside), "report")
    return modules.report_pages(report, inside, outside, flat, version, "https://example.org/tree/")
