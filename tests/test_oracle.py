"""Registered queries against their SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CHECKED = ["generate_edges", "collect_nodes", "expand_file_names", "lookup", "closure", "direct_leaks", "interface", "libs_needed_good", "libs_needed_bad", "libs_cycle", "extra_libdeps_precise", "file_graph", "exec_digest", "file_family_paths", "flatten_modules", "diff_modules", "module_interface", "module_pages", "write_modules", "read_modules", "attach_extra_info", "parse_build_tree", "generate_edges_of_records", "build_graph_nodes", "assemble_build_objects", "expand_symbol_names", "leak_kind", "paths_to_tree", "read_dumped_graph", "read_lines", "parse_symbol_dump_short", "parse_dep_lines_quarantine", "leaks_exclude", "interface_exclude", "undotted_executables", "file_family_paths_reference", "render_d3_nodes"]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def table(df):
    cols = sorted(df.columns)
    return [tuple(None if v is None or v is pd.NA or v != v else v for v in r) for r in df[cols].itertuples(index=False)], cols


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, con, name):
    got, want = table(entry.queries()[name](spark, SF).toPandas()), table(con.sql(entry.oracle_sql()[name]).df())
    assert got[1] == want[1] and sorted(map(str, got[0])) == sorted(map(str, want[0]))


LARGER = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no tables here")
@pytest.mark.parametrize("name", ["libs_cycle", "lib_cycles_all"])
def test_cycles_of_all_archives(spark, name):
    con = duckdb.connect()
    for f in os.listdir(LARGER):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{LARGER}/{f}'")
    got, want = table(entry.queries()[name](spark, LARGER).toPandas()), table(con.sql(entry.oracle_sql()[name]).df())
    assert got[1] == want[1] and sorted(map(str, got[0])) == sorted(map(str, want[0]))
    assert sum(int(r[0].removeprefix("lib").removesuffix(".a")) >= 150 for r in got[0]) > 100


def test_every_query_of_the_graph_has_sql():
    names = {k for k in entry.queries() if not k.startswith("op") and k != "pipeline"}
    assert names <= set(entry.oracle_sql())
