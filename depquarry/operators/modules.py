"""Roll-ups along the system / module / group hierarchy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import Graph
from ..storage import settled as written
from .lookups import object_to_source, source_to_object
from .symbols import direct_leaks, interface
from .traversals import exec_digest, executables

# What counts as a source file, and where unlisted ones go.
SOURCE_SUFFIXES = (".cc", ".cpp", ".h", ".hpp", ".js", ".py")
UNCATEGORIZED = {"system_name": "uncategorized_system", "module_name": "uncategorized_module", "group_title": "Uncategorized Group"}
NAME_RULE, TITLE_RULE = "^[_a-z0-9]*$", "^[ a-zA-Z0-9]*$"


#: Columns of flat rows that only describe; an operator that needs none of them takes rows without.
TEXTS = ("system_title", "system_description", "module_title", "module_description", "group_description")


def flatten_modules(systems: DataFrame) -> DataFrame:
    """(system_pos, nested) -> (system_pos, system_name, module_pos, module_name, group_ord, group_title, file_pos, file)
    and the ``TEXTS``. What holds no file has no row."""
    system = ["system_pos", "system_name", "system_title", "system_description"]
    m = systems.select(*system, F.posexplode("system_modules").alias("module_pos", "m"))
    module = [*system, "module_pos", "m.module_name", "m.module_title", "m.module_description"]
    g = m.select(*module, F.posexplode("m.module_groups").alias("group_ord", "g"))
    names = [c.removeprefix("m.") for c in module]
    flat = g.select(*names, "group_ord", "g.group_title", "g.group_description", F.posexplode("g.group_files").alias("file_pos", "file"))
    first = ["system_pos", "system_name", "module_pos", "module_name", "group_ord", "group_title", "file_pos", "file"]
    return flat.select(*first, *TEXTS)


def with_texts(flat: DataFrame) -> DataFrame:
    """Flat rows with null for the ``TEXTS`` that they lack."""
    return flat.withColumns({c: F.lit(None).cast("string") for c in TEXTS if c not in flat.columns})


def _owner(flat: DataFrame, col: str) -> DataFrame:
    return flat.groupBy("file").agg(F.max_by(col, F.struct("system_pos", "module_pos", "group_ord", "file_pos")).alias(col))


def file_to_system(flat: DataFrame) -> DataFrame:
    """A file's system; the last place that lists it wins."""
    return _owner(flat, "system_name")


def file_to_module(flat: DataFrame) -> DataFrame:
    return _owner(flat, "module_name")


def validate_modules(systems: DataFrame) -> DataFrame:
    """(path, rule, value) of every broken rule: a missing field, or a name or title off its pattern. Other fields
    cannot enter a table of the fixed schema."""
    s = systems.select(F.concat(F.lit("systems/"), F.col("system_pos").cast("string")).alias("path"), "*")
    m = s.select("path", F.posexplode("system_modules").alias("i", "m")).select(F.concat("path", F.lit("/modules/"), F.col("i").cast("string")).alias("path"), "m.*")
    g = m.select("path", F.posexplode("module_groups").alias("i", "g")).select(F.concat("path", F.lit("/groups/"), F.col("i").cast("string")).alias("path"), "g.*")

    def broken(df: DataFrame, fields: list[str], patterns: dict[str, str]) -> DataFrame:
        rules = [F.when(F.col(c).isNull(), F.struct(F.lit(f"required {c}").alias("rule"), F.lit(None).cast("string").alias("value"))) for c in fields]
        rules += [F.when(~F.col(c).rlike(p), F.struct(F.lit(f"pattern {c}").alias("rule"), F.col(c).alias("value"))) for c, p in patterns.items()]
        return df.select("path", F.explode(F.array(*rules)).alias("v")).filter("v is not null").select("path", "v.*")

    return reduce(DataFrame.unionAll, [
        broken(s, ["system_name", "system_title", "system_description", "system_modules"], {"system_name": NAME_RULE, "system_title": TITLE_RULE}),
        broken(m, ["module_name", "module_title", "module_description", "module_groups"], {"module_name": NAME_RULE, "module_title": TITLE_RULE}),
        broken(g, ["group_title", "group_description", "group_files"], {}),
    ])


def diff_modules(flat: DataFrame, files: DataFrame) -> DataFrame:
    """(status, system_name, module_name, group_title, file): listed files that exist are kept, others deleted;
    unlisted source files are added to the uncategorized group. ``files``: (name)."""
    known = files.select(F.col("name").alias("file")).distinct()
    cols = ["system_name", "module_name", "group_title", "file"]
    kept = flat.join(known, "file", "left_semi").select(F.lit("kept").alias("status"), *cols)
    deleted = flat.join(known, "file", "left_anti").select(F.lit("deleted").alias("status"), *cols)
    source = reduce(Column.__or__, [F.col("file").endswith(x) for x in SOURCE_SUFFIXES])
    added = known.filter(source).join(flat.select("file").distinct(), "file", "left_anti").select(F.lit("added").alias("status"), *[F.lit(v).alias(k) for k, v in UNCATEGORIZED.items()], "file")
    return kept.unionAll(deleted).unionAll(added)


def file_headers(graph: Graph, sources: DataFrame, every: bool = False) -> DataFrame:
    """(query_id, name) -> (query_id, name, header): headers of a source's smallest object, or of all its objects."""
    objects = source_to_object(graph, sources)
    if not every:
        objects = objects.groupBy("query_id", "name").agg(F.min("object").alias("object"))
    return objects.join(graph.rel("file_to_header_includes").select(F.col("item").alias("object"), F.col("dep").alias("header")), "object").select("query_id", "name", "header").distinct()


def _of_objects(graph: Graph, sources: DataFrame) -> DataFrame:
    """One query per source file: its objects as names."""
    files = sources.select(F.col("name").alias("query_id"), "name").distinct()
    return source_to_object(graph, files).select("query_id", F.lit(0).alias("input_ord"), F.col("object").alias("name")).distinct()


def file_interface(graph: Graph, sources: DataFrame) -> DataFrame:
    """(name) of sources -> (file, symbol, other_file): symbols their objects define, and the sources that use them."""
    used = written(interface(graph, _of_objects(graph, sources)).select("query_id", "symbol", F.explode("used_by").alias("name")), "used-by")
    back = graph.rel("file_to_source").select(F.col("item").alias("name"), F.col("dep").alias("other_file"))
    return used.join(back, "name").select(F.col("query_id").alias("file"), "symbol", "other_file").distinct()


def file_dependencies(graph: Graph, sources: DataFrame) -> DataFrame:
    """(name) of sources -> (file, symbol, other_file): symbols their objects leak, and the sources that define them."""
    leaked = written(direct_leaks(graph, _of_objects(graph, sources)).select("query_id", "symbol").distinct(), "leaked")
    defined = graph.rel("symbol_to_file_sources").select(F.col("item").alias("query_id"), F.col("dep").alias("name"))
    # the few definitions get their sources first; two sets meet in rows that are distinct by themselves
    homes = written(object_to_source(graph, defined).select(F.col("query_id").alias("symbol"), F.col("source").alias("other_file")).distinct(), "homes")
    return leaked.join(homes, "symbol").select(F.col("query_id").alias("file"), "symbol", "other_file")


def _outside(flat: DataFrame, found: DataFrame) -> DataFrame:
    """Rows whose other file is in another module than the listed file, or in none."""
    listed = flat.select("system_name", "module_name", "group_ord", "group_title", "file").distinct()
    owner = file_to_module(flat).join(file_to_system(flat), "file").select(F.col("file").alias("other_file"), F.col("module_name").alias("other_module"), F.col("system_name").alias("other_system"))
    found = written(found.select("file", "symbol", "other_file"), "found").join(owner, "other_file", "left")
    rows = listed.join(written(found, "owned"), "file")
    return rows.filter(~F.col("other_module").eqNullSafe(F.col("module_name"))).select("system_name", "module_name", "group_ord", "group_title", "file", "symbol", "other_file", "other_module", "other_system")


def module_interface(graph: Graph, flat: DataFrame) -> DataFrame:
    """Per listed file the symbols used from outside its module, with the users; a user in no module is outside."""
    return _outside(flat, file_interface(graph, flat.select(F.col("file").alias("name")).distinct()))


def module_dependencies(graph: Graph, flat: DataFrame) -> DataFrame:
    """Per listed file the symbols it takes from outside its module, with the providers."""
    return _outside(flat, file_dependencies(graph, flat.select(F.col("file").alias("name")).distinct()))


def resource_url(base: str, meta_version: DataFrame) -> Column:
    """URL of ``file`` below the tag, else the branch, else the hash of the version row (joined in by the caller)."""
    at = F.coalesce(F.nullif("tag", F.lit("(no tag)")), F.nullif("branch", F.lit("(no branch)")), F.col("hash"))
    return F.concat(F.lit(base), at, F.lit("/"), F.col("file"))


def cleaned(text: Column) -> Column:
    """A description as markdown shows it well."""
    return F.ltrim(F.replace(F.replace(F.replace(text, F.lit("#"), F.lit(" ")), F.lit("_"), F.lit("\\_")), F.lit("\n"), F.lit("\n\n")))


def module_report(graph: Graph, flat: DataFrame, version: DataFrame, base_url: str, buckets: DataFrame, interface_rows: DataFrame | None = None, dependency_rows: DataFrame | None = None) -> DataFrame:
    """One row per (system, module, group, file): executable digest, URL, and counts of outside symbols.
    ``version`` is the one row of ``version_and_build_info``. ``interface_rows``, ``dependency_rows``: ``module_interface``
    and ``module_dependencies`` of the same, where they are at hand."""
    row = version.select("tag", "branch", "hash").first()
    listed = flat.select("system_name", "module_name", "group_ord", "group_title", "file").distinct()
    known = buckets.select("name", "bucket")
    ends = exec_digest(executables(graph, listed.select(F.col("file").alias("query_id"), F.col("file").alias("name")).distinct(), known), known)
    digest = ends.groupBy(F.col("name").alias("file")).agg(F.array_join(F.sort_array(F.collect_set("bucket")), ", ").alias("executables"))
    digest = written(digest, "digest")
    keys = ["system_name", "module_name", "group_ord", "group_title", "file"]
    interface_rows = module_interface(graph, flat) if interface_rows is None else interface_rows
    used = written(interface_rows.groupBy(*keys).agg(F.countDistinct("symbol").alias("n_interface")), "n-interface")
    dependency_rows = module_dependencies(graph, flat) if dependency_rows is None else dependency_rows
    needed = written(dependency_rows.groupBy(*keys).agg(F.countDistinct("symbol").alias("n_dependencies")), "n-dependencies")
    url = resource_url(base_url, version)
    out = listed.join(digest, "file", "left").join(used, keys, "left").join(needed, keys, "left").withColumns({c: F.lit(getattr(row, c)) for c in ("tag", "branch", "hash")})
    zero = F.lit(0).cast("long")
    return out.select(*keys, F.coalesce("executables", F.lit("")).alias("executables"), url.alias("url"), F.coalesce("n_interface", zero).alias("n_interface"), F.coalesce("n_dependencies", zero).alias("n_dependencies"))


# The phrases of report pages.
_PHRASES = {
    "interface": ("Interface", "Used By", "This interface information represents symbols that are defined in this group but used in other modules.  Does not include symbols defined in this group that are used inside this module.\n", "(not used outside this module)\n"),
    "dependencies": ("Dependencies", "Provided By", "This dependency information represents symbols that are used in this group but defined in other modules.  Does not include symbols used in this group that are defined inside this module.\n", "(no dependencies outside this module)\n"),
}


def _text(*parts: str | Column) -> Column:
    """Columns and literal texts in a row, null as empty."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts])


def _escaped(name: str | Column) -> Column:
    return F.replace(F.col(name) if isinstance(name, str) else name, F.lit("_"), F.lit("\\_"))


def _in_order(at: str, text: Column) -> Column:
    """Aggregate: texts in the order of a column, in a row."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, text.alias("text")))), lambda x: x["text"]), "")


def _group_pages(rows: DataFrame, folder: str, flat: DataFrame) -> DataFrame:
    """The interface or dependency page of every group; a file in a module links to it."""
    keys = ["system_name", "module_name", "group_ord", "group_title"]
    title, verb, about, nothing = _PHRASES[folder]
    one = F.struct("other_file", F.when(F.col("other_module").isNull(), _escaped("other_file")).otherwise(_text("[", _escaped("other_file"), "](../../../../", _escaped("other_system"), "/", _escaped("other_module"), ")")).alias("link"))
    others = F.array_join(F.transform(F.array_sort(F.collect_set(one)), lambda x: _text("    - ", x["link"], "\n")), "")
    symbols = rows.groupBy(*keys, "file", "symbol").agg(_text("\n<div></div>\n\n    ", F.col("symbol"), f"\n\n- {verb}:\n\n", others).alias("text"))
    files = symbols.groupBy(*keys, "file").agg(_text("\n### ", _escaped("file"), "\n", _in_order("symbol", F.col("text"))).alias("text"))
    texts = files.groupBy(*keys).agg(_in_order("file", F.col("text")).alias("text"))
    every = flat.select(*keys).distinct()
    match = reduce(Column.__and__, [every[k].eqNullSafe(texts[k]) for k in keys])
    path = F.concat_ws("/", "system_name", "module_name", F.lit(folder), F.col("group_ord").cast("string"), F.lit("README.md"))
    pages = every.join(texts, match, "left").select(*[every[k] for k in keys], "text")
    return pages.select(path.alias("relative_path"), _text(f"\n# {title} for ", F.col("group_title"), "\n", about, F.coalesce("text", F.lit(nothing))).alias("markdown"))


def _module_pages(report: DataFrame, flat: DataFrame) -> DataFrame:
    module = ["system_name", "module_name"]
    line = _text("- [", _escaped("file"), "](", F.col("url"), ")   (", F.col("executables"), ")\n")
    groups = report.groupBy(*module, "group_ord", "group_title").agg(_in_order("file", line).alias("files"))
    said = flat.groupBy(*module, "group_ord").agg(F.first("group_description", True).alias("about"))
    number = F.col("group_ord").cast("string")
    section = _text("\n-------------\n\n## ", F.col("group_title"), "\n", cleaned(F.col("about")), "\n\n#### Files\n", F.col("files"), "\n#### [Interface](interface/", number, ")\n\n#### [Dependencies](dependencies/", number, ")\n")
    bodies = groups.join(said, [*module, "group_ord"], "left").groupBy(*module).agg(_in_order("group_ord", section).alias("body"))
    heads = flat.groupBy(*module).agg(F.first("module_title", True).alias("title"), F.first("module_description", True).alias("about"))
    head = _text("# ", F.coalesce("title", "module_name"), "\n", cleaned(F.col("about")), "\n\n", F.col("body"))
    return bodies.join(heads, module).select(F.concat_ws("/", *module, F.lit("README.md")).alias("relative_path"), head.alias("markdown"))


def _system_pages(flat: DataFrame) -> DataFrame:
    modules = flat.groupBy("system_name", "module_name").agg(*[F.first(c, True).alias(c) for c in ("system_title", "system_description", "module_title", "module_description")], F.min("module_pos").alias("at"))
    entry = _text("### [", F.coalesce("module_title", "module_name"), "](", _escaped("module_name"), ")\n", cleaned(F.col("module_description")), "\n\n")
    systems = modules.groupBy("system_name").agg(F.first("system_title", True).alias("title"), F.first("system_description", True).alias("about"), _in_order("at", entry).alias("body"))
    return systems.select(_text(F.col("system_name"), "/README.md").alias("relative_path"), _text("# ", F.coalesce("title", "system_name"), "\n\n", cleaned(F.col("about")), "\n\n## Modules\n\n", F.col("body")).alias("markdown"))


def _project_page(flat: DataFrame, version: DataFrame, base_url: str, title: str, about: str) -> DataFrame:
    """The top page: what was built, then every system with its description."""
    v = version.withColumns({c: F.lit(None).cast(t) for c, t in (("flags", "array<string>"), ("platform", "string")) if c not in version.columns}).withColumn("file", F.lit(""))
    built = _text("* Build flags: ", F.array_join("flags", " "), "\n* Build platform: ", F.col("platform"), "\n* Version hash: ", F.col("hash"), "\n* Version branch: ", F.col("branch"), "\n* Version tag: ", F.col("tag"), "\n* URL: ", resource_url(base_url, version), "\n\n")
    systems = flat.groupBy("system_name").agg(F.first("system_title", True).alias("title"), F.first("system_description", True).alias("about"), F.min("system_pos").alias("at"))
    entry = _text("## [", F.coalesce("title", "system_name"), "](", _escaped("system_name"), ")\n", cleaned(F.col("about")), "\n\n")
    body = systems.agg(_in_order("at", entry).alias("body")).select("body", F.lit(1).alias("one"))  # one row a system
    head = v.limit(1).select(built.alias("built"), F.lit(1).alias("one"))
    return head.join(F.broadcast(body), "one").select(F.lit("README.md").alias("relative_path"), _text(f"# {title}\n{about}\n\n", F.col("built"), F.col("body")).alias("markdown"))


def report_pages(report: DataFrame, interface_rows: DataFrame, dependency_rows: DataFrame, flat: DataFrame, version: DataFrame | None = None, base_url: str = "", title: str = "Codebase map", about: str = "Generated pages.") -> DataFrame:
    """(relative_path, markdown): a page per system and module and, per group, one for its interface and one for its
    dependencies; with ``version`` (the row of ``version_and_build_info``) also the project's page."""
    flat = with_texts(flat)
    parts = [_system_pages(flat), _module_pages(report, flat), _group_pages(interface_rows, "interface", flat), _group_pages(dependency_rows, "dependencies", flat)]
    if version is not None:
        parts.append(_project_page(flat, version, base_url, title, about))
    return reduce(DataFrame.unionAll, [written(p, "pages") for p in parts])
