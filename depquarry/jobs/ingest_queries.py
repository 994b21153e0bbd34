"""The registered queries of the way from a build's texts to edges, each with SQL that states the result from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest
from ..sources import build_text
from ..storage import scratch_path
from . import testbuild

_OBJ = "'build/' || CASE WHEN o_orderpriority = '5-LOW' THEN 'client_build/' ELSE '' END || 'o' || o_orderkey || CASE WHEN o_orderstatus = 'P' THEN '_test' ELSE '' END || '.o'"
TREE_SQL = f"""WITH
obj AS (SELECT o_custkey AS c, o_orderkey AS k, {_OBJ} AS name FROM orders),
brand AS (SELECT DISTINCT l_orderkey AS k, p_brand AS h FROM lineitem JOIN part ON l_partkey = p_partkey),
raw AS (
  SELECT c, a, 0 AS k, 0 AS b, '' AS h, CASE a WHEN 1 THEN 'all' WHEN 7 THEN '/usr/lib/l' || c % 7 WHEN 2 THEN 'lib' || c || '.a' WHEN 4 THEN 'lib' || c || '.a' END AS name FROM (SELECT DISTINCT c FROM obj), range(10) r(a) WHERE a <> 3
  UNION ALL SELECT c, 3, k, 0, '', name FROM obj
  UNION ALL SELECT c, 3, k, 1, '', 'src/o' || k || '.cpp' FROM obj
  UNION ALL SELECT c, 3, k, 2, h, h || '.h' FROM obj JOIN brand USING (k)),
line AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY a, k, b, h) - 1 AS pos FROM raw),
node AS (SELECT 't' || c AS tree_id, c, a, k, b, name, pos,
  CASE WHEN a = 1 THEN 0 WHEN a <> 3 THEN 1 WHEN b = 0 THEN 2 ELSE 3 END AS depth, a = 4 AS pruned,
  CASE WHEN a = 1 THEN 'target' WHEN a IN (2, 4) THEN 'archive' WHEN a = 7 THEN 'system' WHEN b = 0 THEN 'object' WHEN b = 1 THEN 'source' ELSE 'header' END AS type,
  CASE WHEN a = 1 THEN NULL WHEN a <> 3 THEN 1 WHEN b = 0 THEN 2 ELSE min(pos) FILTER (a = 3) OVER (PARTITION BY c, k) END AS parent_pos,
  CASE WHEN a = 1 THEN NULL WHEN a <> 3 THEN 'all' WHEN b = 0 THEN 'lib' || c || '.a' ELSE first(name) OVER (PARTITION BY c, a, k ORDER BY b, h) END AS parent_name,
  CASE WHEN a = 1 THEN NULL WHEN a <> 3 THEN 'target' WHEN b = 0 THEN 'archive' ELSE 'object' END AS parent_type,
  CASE WHEN a = 1 THEN NULL WHEN a = 2 THEN 1 WHEN a = 4 THEN 2 WHEN a = 7 THEN 3 WHEN b = 0 THEN dense_rank() OVER (PARTITION BY c, a ORDER BY k) ELSE row_number() OVER (PARTITION BY c, a, k ORDER BY b, h) - 1 END AS child_ordinal,
  CASE WHEN a = 1 THEN max(pos) FILTER (a = 7) OVER (PARTITION BY c) WHEN a = 2 THEN max(pos) FILTER (a = 3) OVER (PARTITION BY c) WHEN a = 3 AND b = 0 THEN max(pos) OVER (PARTITION BY c, a, k) ELSE pos END AS end_pos,
  CASE WHEN a = 4 THEN 'echo ' || c END AS inlineCode
  FROM line WHERE a IN (1, 2, 3, 4, 7)),
rec AS (SELECT n.tree_id, n.pos, n.end_pos, n.name AS _id, n.type,
  first(k.name) FILTER (k.type = 'source') AS source, string_agg(k.name, ',' ORDER BY k.pos) FILTER (n.type = 'object' AND k.type <> 'source') AS headers,
  string_agg(k.name, ',' ORDER BY k.pos) FILTER (k.type = 'object') AS objects, string_agg(k.name, ',' ORDER BY k.pos) FILTER (n.type <> 'object' AND k.type <> 'object') AS deps, count(k.name) AS n_children
  FROM node n LEFT JOIN node k ON n.tree_id = k.tree_id AND n.pos = k.parent_pos GROUP BY ALL),
one AS (SELECT * FROM rec QUALIFY row_number() OVER (PARTITION BY _id ORDER BY end_pos, pos DESC, tree_id) = 1),
sym AS (SELECT name AS object_file, 'sym_' || l_partkey AS symbol, CASE WHEN l_quantity < 49 THEN 'used' ELSE 'defined' END AS kind FROM lineitem JOIN obj ON l_orderkey = k),
decl AS (SELECT c_custkey * 4 AS line_no, 'lib' || c_custkey || '.a' AS _id, 'lib' || (c_custkey // 2) || '.a,lib' || (c_custkey // 3) || '.a' AS libdeps FROM customer WHERE c_custkey > 0
  UNION ALL SELECT c_custkey * 4 + 2, 'lib' || c_custkey || '.a', 'lib' || (c_custkey // 5) || '.a' FROM customer WHERE c_custkey > 0 AND c_custkey % 5 = 0),
last AS (SELECT _id, arg_max(libdeps, line_no) AS libdeps FROM decl GROUP BY _id),
listed AS (SELECT object_file AS _id, string_agg(DISTINCT symbol, ',' ORDER BY symbol) FILTER (kind = 'used') AS symdeps, string_agg(DISTINCT symbol, ',' ORDER BY symbol) FILTER (kind = 'defined') AS symdefs FROM sym GROUP BY object_file)
"""
_LISTS = ("headers", "objects", "deps", "symdeps", "symdefs")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = TREE_SQL + sql
        return f

    return add


def _texts(df):
    """Lists as text in their order, which counts here; an empty list is no list."""
    return df.withColumns({c: F.when(F.size(c) > 0, F.array_join(c, ",")) for c in _LISTS if c in df.columns})


@_query("SELECT tree_id, pos, depth::INT AS depth, name, pruned, type, coalesce(parent_pos, -1)::BIGINT AS parent_pos, parent_name, parent_type, coalesce(child_ordinal, 0)::INT AS child_ordinal, end_pos, inlineCode FROM node")
def parse_build_tree(spark, sf_dir):
    return testbuild.tree(spark, sf_dir).withColumns({"parent_pos": F.coalesce("parent_pos", F.lit(-1).cast("long")), "child_ordinal": F.coalesce("child_ordinal", F.lit(0))})


@_query("SELECT tree_id, pos, name, type FROM node WHERE a <> 1")
def classify_child(spark, sf_dir):
    children = testbuild.tree(spark, sf_dir).filter("parent_pos is not null").drop("type")
    return ingest.classify_child(children).select("tree_id", "pos", "name", "type")


@_query("SELECT * FROM rec")
def assemble_build_objects(spark, sf_dir):
    return _texts(ingest.assemble_build_objects(testbuild.tree(spark, sf_dir)))


@_query("SELECT * FROM one")
def dedupe_build_objects(spark, sf_dir):
    return _texts(testbuild.records(spark, sf_dir))


@_query("SELECT object_file, symbol, kind, count(*) AS n FROM sym GROUP BY ALL")
def parse_symbol_dump(spark, sf_dir):
    return testbuild.symbols(spark, sf_dir).groupBy("object_file", "symbol", "kind").agg(F.count("*").alias("n"))


@_query("SELECT name AS object_file, 'sym_' || l_partkey AS symbol, CASE WHEN l_quantity < 49 THEN 'used' ELSE 'defined' END AS kind, count(*) AS n FROM lineitem JOIN obj ON l_orderkey = k GROUP BY ALL")
def parse_symbol_dump_short(spark, sf_dir):
    """The short form: bare names, padded, with their kind beside them."""
    return build_text.parse_symbol_dump(testbuild.short_dump_lines(spark, sf_dir), "short").groupBy("object_file", "symbol", "kind").agg(F.count("*").alias("n"))


@_query("SELECT _id, symdeps, symdefs FROM one JOIN listed USING (_id) WHERE type = 'object'")
def attach_symbols(spark, sf_dir):
    found = ingest.attach_symbols(testbuild.records(spark, sf_dir), testbuild.symbols(spark, sf_dir))
    return _texts(found.filter("type = 'object' and (size(symdeps) > 0 or size(symdefs) > 0)").select("_id", "symdeps", "symdefs"))


@_query("""SELECT line_no, '{"_id": "' || _id || '", "libdeps": ["' || replace(libdeps, ',', '", "') || '"]}' AS json FROM decl""")
def extract_dep_lines(spark, sf_dir):
    return build_text.extract_dep_lines(testbuild.log_lines(spark, sf_dir))


@_query("""SELECT c % 7 AS shard, row_number() OVER (PARTITION BY c % 7 ORDER BY line_no) - 1 AS line_no, value FROM (
  SELECT line_no // 4 AS c, line_no, '{"_id": "' || _id || '", "libdeps": ["' || replace(libdeps, ',', '", "') || '"]} after' AS value FROM decl UNION ALL SELECT c_custkey, c_custkey * 4 + 1, 'cc {' || c_custkey || '}' FROM customer WHERE c_custkey > 0)""")
def read_lines(spark, sf_dir):
    """Logs as text files, a file a shard, read back with the numbers of their lines."""
    log = testbuild.log_lines(spark, sf_dir).withColumn("shard", F.floor(F.col("line_no") / 4) % 7)
    path = scratch_path(spark, "logs")
    log.repartition("shard").sortWithinPartitions("shard", "line_no").select("shard", "value").write.partitionBy("shard").text(path)
    return build_text.read_lines(spark, path).select(F.regexp_extract("file", "shard=([0-9]+)", 1).cast("long").alias("shard"), "line_no", "value")


@_query("""SELECT line_no, _id, libdeps, bad FROM (
  SELECT line_no, _id, libdeps, false AS bad FROM decl UNION ALL SELECT c_custkey * 4 + 3, NULL, NULL, true FROM customer WHERE c_custkey > 0 AND c_custkey % 3 = 0
  UNION ALL SELECT c_custkey * 4 + 3, 'lib' || c_custkey || '.a', NULL, true FROM customer WHERE c_custkey > 0 AND c_custkey % 3 = 1)""")
def parse_dep_lines_quarantine(spark, sf_dir):
    """Bad lines among the good: no JSON inside the braces, and JSON without a list."""
    log = testbuild.log_lines(spark, sf_dir).unionByName(testbuild.bad_lines(spark, sf_dir))
    return build_text.parse_dep_lines(build_text.extract_dep_lines(log), "quarantine").select("line_no", "_id", F.array_join("libdeps", ",").alias("libdeps"), "bad")


@_query("SELECT line_no, _id, libdeps FROM decl")
def parse_dep_lines(spark, sf_dir):
    return testbuild.declared(spark, sf_dir).withColumn("libdeps", F.array_join("libdeps", ","))


@_query("SELECT _id, type, coalesce(libdeps, deps) AS deps FROM one LEFT JOIN last USING (_id)")
def override_libdeps(spark, sf_dir):
    return _texts(ingest.override_libdeps(testbuild.records(spark, sf_dir), testbuild.declared(spark, sf_dir)).select("_id", "type", "deps"))


@_query("SELECT _id, type, n_children FROM one WHERE contains(_id, 'client_build')")
def filter_build_flavor(spark, sf_dir):
    return ingest.filter_build_flavor(testbuild.records(spark, sf_dir), client_build=True).select("_id", "type", "n_children")


@_query("""SELECT DISTINCT relationship, item, dep FROM (
  SELECT unnest(CASE kind WHEN 'used' THEN [{'relationship': 'file_to_symbol_dependencies', 'item': object_file, 'dep': symbol}, {'relationship': 'symbol_to_file_dependencies', 'item': symbol, 'dep': object_file}]
    ELSE [{'relationship': 'file_to_symbol_definitions', 'item': object_file, 'dep': symbol}, {'relationship': 'symbol_to_file_sources', 'item': symbol, 'dep': object_file}] END, recursive := true) FROM sym WHERE NOT contains(object_file, 'client_build')
  UNION ALL SELECT unnest([{'relationship': 'file_to_header_includes', 'item': name, 'dep': h || '.h'}, {'relationship': 'header_to_files_including', 'item': h || '.h', 'dep': name}], recursive := true) FROM obj JOIN brand USING (k) WHERE NOT contains(name, 'client_build')
  UNION ALL SELECT unnest([{'relationship': 'file_to_source', 'item': name, 'dep': 'src/o' || k || '.cpp'}, {'relationship': 'source_to_file', 'item': 'src/o' || k || '.cpp', 'dep': name}], recursive := true) FROM obj WHERE NOT contains(name, 'client_build')
  UNION ALL SELECT unnest([{'relationship': 'archives_to_components', 'item': 'lib' || c || '.a', 'dep': name}, {'relationship': 'dependency_to_targets', 'item': name, 'dep': 'lib' || c || '.a'}], recursive := true) FROM obj
  UNION ALL SELECT unnest([{'relationship': 'target_to_dependencies', 'item': _id, 'dep': d}, {'relationship': 'dependency_to_targets', 'item': d, 'dep': _id}], recursive := true)
    FROM (SELECT _id, unnest(string_split(coalesce(libdeps, deps), ',')) AS d FROM one LEFT JOIN last USING (_id) WHERE type <> 'object' AND coalesce(libdeps, deps) IS NOT NULL))""")
def generate_edges_of_records(spark, sf_dir):
    return ingest.generate_edges(testbuild.full_records(spark, sf_dir))


@_query("""SELECT kind, name FROM (
  SELECT 'symbol' AS kind, symbol AS name FROM sym WHERE NOT contains(object_file, 'client_build')
  UNION SELECT 'file', h || '.h' FROM obj JOIN brand USING (k) WHERE NOT contains(name, 'client_build') UNION SELECT 'file', 'src/o' || k || '.cpp' FROM obj WHERE NOT contains(name, 'client_build')
  UNION SELECT 'file', name FROM obj UNION SELECT 'file', _id FROM one WHERE NOT contains(_id, 'client_build')
  UNION SELECT 'file', unnest(string_split(coalesce(libdeps, deps), ',')) FROM one LEFT JOIN last USING (_id) WHERE type <> 'object' AND coalesce(libdeps, deps) IS NOT NULL)""")
def build_graph_nodes(spark, sf_dir):
    return ingest.build_graph(testbuild.full_records(spark, sf_dir)).nodes
