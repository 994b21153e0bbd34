"""Symbols used or defined by build objects, leaks and interfaces, for all names at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import is_client, is_object
from ..schema import Graph
from ..storage import drop
from ..storage import settled as written
from .reach import meeting, numbered, packed, reaching
from .traversals import closure, symbol_family_paths

FEW_HOLDERS = 64
SYMBOL_EDGES = {"dependency": "file_to_symbol_dependencies", "definition": "file_to_symbol_definitions"}


def _objects_of(graph: Graph, names: DataFrame) -> DataFrame:
    """(…, name) -> (…, archive, object): an object is itself, with no archive; others stand for their components."""
    direct = names.filter(is_object(F.col("name"))).withColumn("archive", F.lit(None).cast("string")).withColumn("object", F.col("name"))
    parts = graph.rel("archives_to_components").select(F.col("item").alias("name"), F.col("dep").alias("object"))
    through = names.filter(~is_object(F.col("name"))).withColumn("archive", F.col("name")).join(parts, "name")
    cols = [c for c in names.columns if c != "name"] + ["archive", "object"]
    return direct.select(cols).unionByName(through.select(cols))


def symbol_info(graph: Graph, names: DataFrame, depth: int | None = None, kind: str = "dependency", used: DataFrame | None = None) -> DataFrame:
    """(query_id, input_ord, name) -> (query_id, input_ord, symbol, object, archive). ``used`` (object, symbol): the edges
    of that kind that matter, all if not given.

    ``depth`` 1 takes the names alone, repeats included; None or below 1 all they reach over declared dependencies;
    deeper ones take each (query, node) once, with ``input_ord`` its level.
    """
    if depth != 1:
        reach = closure(graph, names, depth)
        names = reach.select("query_id", F.col("level").cast("int").alias("input_ord"), F.col("node").alias("name"))
    if used is None:
        used = graph.rel(SYMBOL_EDGES[kind]).select(F.col("item").alias("object"), F.col("dep").alias("symbol"))
    return _objects_of(graph, names.select("query_id", "input_ord", "name")).join(used, "object").select("query_id", "input_ord", "symbol", "object", "archive")


def symbol_providers(graph: Graph) -> DataFrame:
    """(symbol, node): what holds a definition of a symbol: the object itself, and archives it is a component of."""
    defined = graph.rel("file_to_symbol_definitions").select(F.col("item").alias("object"), F.col("dep").alias("symbol"))
    direct = defined.filter(is_object(F.col("object"))).select("symbol", F.col("object").alias("node"))
    parts = graph.rel("archives_to_components").filter(~is_object(F.col("item"))).select(F.col("item").alias("node"), F.col("dep").alias("object"))
    return direct.union(defined.join(parts, "object").select("symbol", "node")).distinct()


def _turned(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("dep").alias("item"), F.col("item").alias("dep"))


def direct_leaks(graph: Graph, names: DataFrame, ignore: DataFrame | None = None, exclude: DataFrame | None = None, few_holders: int = FEW_HOLDERS) -> DataFrame:
    """(query_id, input_ord, name) -> (query_id, symbol, object, archive): symbols used but defined nowhere in the
    closure of the names and of ``ignore`` (query_id, name), though defined by somebody.

    No closure is laid out. A symbol of ``FEW_HOLDERS`` or fewer asks for its holders: is one of them reached by the
    query? The few symbols with more ask the other way: from all their holders at once, against the edges, is one of the
    query's names met? So no symbol pairs all who need it with all who hold it. ``exclude`` (symbol) hides rows of the
    result.
    """
    known = graph.rel("symbol_to_file_sources").select(F.col("item").alias("symbol")).distinct()
    if exclude is not None:
        known = known.join(exclude.select("symbol").distinct(), "symbol", "left_anti")
    used = graph.rel(SYMBOL_EDGES["dependency"]).select(F.col("item").alias("object"), F.col("dep").alias("symbol"))
    used = written(used.join(known, "symbol", "left_semi"), "used")
    queries = numbered(names, "query_id", "q")
    each = names.join(queries, "query_id", "left").select(F.struct("query_id", "q").alias("query_id"), "input_ord", "name")
    needed = symbol_info(graph, each, 1, "dependency", used)
    needed = written(needed.select("query_id.query_id", "query_id.q", "symbol", "object", "archive"), "needed")
    drop(used)
    roots = names.select("query_id", "name")
    roots = roots if ignore is None else roots.union(ignore.select("query_id", "name"))
    roots = written(roots.join(queries, "query_id").select("q", F.col("name").alias("node")).distinct(), "roots")
    providers = written(symbol_providers(graph).join(known, "symbol", "left_semi"), "providers")
    found = _held_below(graph.rel("target_to_dependencies"), roots, needed.select("q", "symbol"), providers, few_holders)
    return needed.join(found.distinct(), ["q", "symbol"], "left_anti").select("query_id", "symbol", "object", "archive")


def _held_below(below: DataFrame, roots: DataFrame, wanted: DataFrame, providers: DataFrame, few_holders: int) -> DataFrame:
    """(q, symbol) of ``wanted`` with a provider (symbol, node) that is among the query's ``roots`` (q, node) or reached
    from one. Only roots and providers that the edges know take part in the search, by their numbers."""
    found = roots.join(providers, "node").select("q", "symbol")
    graph = packed(below)
    if graph is None:
        many = written(providers.groupBy("symbol").agg(F.count("*").alias("n")).filter(F.col("n") > few_holders).select("symbol"), "held-by-many")
        starts = roots.withColumnRenamed("q", "query_id")
        few = wanted.distinct().join(providers.join(many, "symbol", "left_anti"), "symbol").select(F.col("q").alias("query_id"), "node", "symbol")
        found = found.union(reaching(below, starts, few).select("query_id", "symbol"))
        if not many.isEmpty():
            hot = wanted.distinct().join(many, "symbol", "left_semi").join(roots, "q").select(F.col("symbol").alias("query_id"), "node", "q")
            held = providers.join(many, "symbol", "left_semi").select(F.col("symbol").alias("query_id"), "node")
            found = found.union(reaching(_turned(below), held, hot).select("q", "query_id"))
        return written(found, "found")
    edges, ids = graph
    starts = written(roots.join(ids, "node").select("q", "id"), "starts")
    if starts.isEmpty():
        return written(found, "found")
    holders = written(providers.join(ids, "node").select("symbol", "id"), "holders")
    many = written(holders.groupBy("symbol").agg(F.count("*").alias("n")).filter(F.col("n") > few_holders).select("symbol"), "held-by-many")
    asked = wanted.filter("q is not null").join(holders.join(many, "symbol", "left_anti"), "symbol").select("q", "id", "symbol")
    found = found.union(written(meeting(edges, starts, asked).select("q", "symbol"), "met"))
    if not many.isEmpty():
        hot = numbered(many, "symbol", "s")
        held = holders.join(hot, "symbol").select(F.col("s").alias("q"), "id")
        asking = wanted.join(hot, "symbol").join(starts, "q").select(F.col("s").alias("q"), "id", F.col("q").alias("asking"), "symbol")
        turned = below.sparkSession.sparkContext.broadcast(edges.value.turned())
        found = found.union(written(meeting(turned, held, asking).select("asking", "symbol"), "met"))
    found = written(found, "found")
    drop(starts, holders, many)
    return found


def leaks(graph: Graph, names: DataFrame, depth: int = 2, ignore: DataFrame | None = None, order: str = "outermost_first", exclude: DataFrame | None = None) -> DataFrame:
    """``direct_leaks`` with where each symbol comes from: (query_id, symbol, object, archive, path)."""
    found = direct_leaks(graph, names, ignore, exclude)
    symbols = found.select("symbol").distinct()
    paths = symbol_family_paths(graph, symbols.select(F.col("symbol").alias("query_id"), "symbol"), depth, order)
    return found.join(paths.select(F.col("query_id").alias("symbol"), "path"), "symbol", "left").select("query_id", "symbol", "object", "archive", "path")


def interface(graph: Graph, names: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """(query_id, input_ord, name) -> (query_id, input_ord, archive, object, symbol, used_by): symbols defined here and
    used by objects that define nothing here; users with ``_test.o`` in their name do not count."""
    own = written(symbol_info(graph, names, 1, "definition"), "own")
    users = graph.rel("symbol_to_file_dependencies").filter(~F.col("dep").contains("_test.o")).select(F.col("item").alias("symbol"), F.col("dep").alias("user"))
    inside = own.select("query_id", F.col("object").alias("user")).distinct()
    met = written(own.join(users, "symbol"), "users")
    outside = met.join(inside, ["query_id", "user"], "left_anti")
    if exclude is not None:
        outside = outside.join(exclude.select("symbol").distinct(), "symbol", "left_anti")
    return outside.groupBy("query_id", "input_ord", "archive", "object", "symbol").agg(F.sort_array(F.collect_set("user")).alias("used_by"))


def definer_count(graph: Graph) -> DataFrame:
    """(symbol, n, class): non-client definers of every symbol used or defined: unique, multiple or none."""
    definers = graph.rel("symbol_to_file_sources").filter(~is_client(F.col("dep"))).groupBy(F.col("item").alias("symbol")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    kind = F.when(n == 1, "unique").when(n > 1, "multiple").otherwise("none")
    return graph.names("symbol").select(F.col("name").alias("symbol")).join(definers, "symbol", "left").select("symbol", n.alias("n"), kind.alias("class"))


def leak_kind(graph: Graph, leaked: DataFrame, few_holders: int = FEW_HOLDERS) -> DataFrame:
    """(query_id, symbol) of ``direct_leaks``, a query being an archive's name -> (query_id, symbol, kind): multiple if
    several objects define it, circular if a providing archive's closure reaches the query's archive, else simple.

    A symbol of few providers asks each of them for the leaking archives; one of many asks from all of its providers at
    once, so that no row pairs a leaking archive with a hot symbol's provider.
    """
    leaked = written(leaked.select("query_id", "symbol").distinct(), "leaked")
    counts = definer_count(graph).filter("n > 1").select("symbol", F.lit(True).alias("many"))
    defined = graph.rel("symbol_to_file_sources").select(F.col("item").alias("symbol"), F.col("dep").alias("object"))
    holders = graph.rel("dependency_to_targets").select(F.col("item").alias("object"), F.col("dep").alias("provider"))
    providers = defined.join(holders, "object").select("symbol", "provider").distinct().join(leaked.select("symbol").distinct(), "symbol", "left_semi")
    providers = written(providers, "providers")
    around = leaked.join(providers.withColumnRenamed("provider", "query_id"), ["query_id", "symbol"], "left_semi")
    below = graph.rel("target_to_dependencies")
    found = packed(below)
    if found is None:
        held_by_many = written(providers.groupBy("symbol").agg(F.count("*").alias("n")).filter(F.col("n") > few_holders).select("symbol"), "held-by-many")
        asked = leaked.join(providers.join(held_by_many, "symbol", "left_anti"), "symbol").select(F.col("provider").alias("query_id"), F.col("query_id").alias("node"), "symbol")
        each = asked.select("query_id", F.col("query_id").alias("node")).distinct()
        around = around.union(reaching(below, each, asked).select(F.col("node").alias("query_id"), "symbol"))
        if not held_by_many.isEmpty():
            held = providers.join(held_by_many, "symbol", "left_semi").select(F.col("symbol").alias("query_id"), F.col("provider").alias("node"))
            hot = leaked.join(held_by_many, "symbol", "left_semi").select(F.col("symbol").alias("query_id"), F.col("query_id").alias("node"))
            around = around.union(reaching(below, held, hot).select(F.col("node"), F.col("query_id")))
    else:  # what the edges do not know reaches itself only
        edges, ids = found
        there = written(leaked.join(ids.withColumnRenamed("node", "query_id"), "query_id").select("symbol", "id"), "leaking")
        holders = written(providers.join(ids.withColumnRenamed("node", "provider"), "provider").select("symbol", F.col("id").alias("q")), "holders")
        many = written(holders.groupBy("symbol").agg(F.count("*").alias("n")).filter(F.col("n") > few_holders).select("symbol"), "held-by-many")
        asked = there.join(holders.join(many, "symbol", "left_anti"), "symbol").select("q", "id", "symbol")
        met = [written(meeting(edges, holders.select("q", F.col("q").alias("id")).distinct(), asked).select("id", "symbol"), "met")]
        if not many.isEmpty():
            hot = numbered(many, "symbol", "s")
            held = holders.join(hot, "symbol").select(F.col("s").alias("q"), F.col("q").alias("id"))
            met.append(written(meeting(edges, held, there.join(hot, "symbol").select(F.col("s").alias("q"), "id", "symbol")).select("id", "symbol"), "met"))
        for rows in met:
            around = around.union(rows.join(ids, "id").select("node", "symbol"))
    around = around.distinct().withColumn("around", F.lit(True))
    return leaked.join(counts, "symbol", "left").join(around, ["query_id", "symbol"], "left").select("query_id", "symbol", F.when(F.col("many"), "multiple").when(F.col("around"), "circular").otherwise("simple").alias("kind"))
