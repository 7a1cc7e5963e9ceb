"""Smells, dead code, layers, ownership and project figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import graph

# Directory names of the layers, from the top layer down.
LAYERS = {
    "presentation": ["api", "apis", "routes", "route", "routers", "router", "controllers", "controller", "views", "view", "handlers", "handler", "web", "ui", "endpoints", "endpoint", "rest", "graphql"],
    "service": ["services", "service", "logic", "core", "domain", "usecases", "usecase", "managers", "manager", "business"],
    "data": ["models", "model", "db", "database", "repositories", "repository", "dao", "store", "stores", "schema", "schemas", "entities", "entity", "orm", "migrations"],
}
# Last parts of decorators that register what they stand on.
REGISTERING = ["command", "callback", "fixture", "route", "websocket", "get", "post", "put", "delete", "patch", "head", "options", "task", "Component", "Service", "Repository", "Controller", "RestController", "Configuration", "SpringBootApplication", "Bean"]
_SMELL = ["kind", "entity_id", "name", "file", "line", "metric", "threshold"]


def _smell(df: DataFrame, kind: str, metric: Column, threshold: int) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), "entity_id", "name", "file", F.col("start_line").alias("line"), metric.cast("long").alias("metric"), F.lit(threshold).cast("long").alias("threshold")).where("metric > threshold")


def god_classes(entities: DataFrame, threshold: int = 15) -> DataFrame:
    children = entities.where("parent_id is not null").groupBy(F.col("parent_id").alias("entity_id")).agg(F.count(F.lit(1)).alias("n"))
    return _smell(entities.where("type = 'class'").join(children, "entity_id"), "god-class", F.col("n"), threshold)


def large_classes(entities: DataFrame, threshold: int = 500) -> DataFrame:
    return _smell(entities.where("type = 'class'"), "large-class", F.col("end_line") - F.col("start_line") + 1, threshold)


def high_coupling(edges: DataFrame, entities: DataFrame, threshold: int = 20) -> DataFrame:
    """Files that import more than `threshold` different targets, those outside included."""
    n = edges.where("type = 'imports'").join(entities.select(F.col("entity_id").alias("src_id"), "file"), "src_id").groupBy("file").agg(F.countDistinct("dst_id").alias("n"))
    return _smell(n.select(F.col("file").alias("entity_id"), F.col("file").alias("name"), "file", F.lit(None).cast("int").alias("start_line"), "n"), "high-coupling", F.col("n"), threshold)


def complex_functions(entities: DataFrame, threshold: int = 15) -> DataFrame:
    own = entities.where("type in ('function', 'method') and raw_source is not null")
    return _smell(own, "complex-function", T.complexity(F.col("raw_source")), threshold)


def smells(edges: DataFrame, entities: DataFrame, god: int = 15, large: int = 500, coupling: int = 20, complexity: int = 15) -> DataFrame:
    """All smells, the severest first: metric over threshold (the metric itself for a threshold of 0)."""
    parts = [god_classes(entities, god), large_classes(entities, large), high_coupling(edges, entities, coupling), complex_functions(entities, complexity)]
    out = reduce(DataFrame.unionByName, parts)
    severity = F.round(F.when(F.col("threshold") > 0, F.try_divide(F.col("metric").cast("double"), F.col("threshold"))).otherwise(F.col("metric").cast("double")), 6)
    return out.withColumn("severity", severity).orderBy(F.desc("severity"), "file", F.coalesce("line", F.lit(0)), "kind", "entity_id")


def registered(source: Column) -> Column:
    """Whether a decorator that leads the source registers it: blank and decorator lines only may stand before."""
    stripped = F.transform(T.lines(source), F.trim)
    leading = F.aggregate(
        stripped,
        F.struct(F.lit(True).alias("on"), F.lit(False).alias("hit")),
        lambda a, x: F.struct(
            (a["on"] & (x.startswith("@") | (x == ""))).alias("on"),
            (a["hit"] | (a["on"] & x.startswith("@") & F.element_at(F.split(F.regexp_extract(x, r"^\s*@\s*([\w.]+)", 1), r"\."), -1).isin(REGISTERING))).alias("hit"),
        ),
        lambda a: a["hit"],
    )
    return F.coalesce(leading, F.lit(False))


def dead_code(edges: DataFrame, entities: DataFrame, methods: bool = False) -> DataFrame:
    """Functions and classes that nothing calls or imports and that nothing calls from outside by convention."""
    types = ["function", "class"] + ["method"] * methods
    used = edges.where("type in ('calls', 'imports')").select(F.col("dst_id").alias("entity_id")).distinct()
    n = F.col("name")
    spared = n.isin("main", "__main__") | n.startswith("test_") | (n.startswith("__") & n.endswith("__"))
    own = entities.where(F.col("type").isin(types) & ~F.col("language").isin("css", "html") & ~spared & ~registered(F.col("raw_source")))
    return own.join(used, "entity_id", "left_anti").select("entity_id", "type", "name", "file", "start_line").orderBy("file", "start_line", "entity_id")


def layer_of(segment: Column) -> Column:
    s = F.lower(segment)
    return reduce(lambda a, x: a.when(s.isin(x[1]), x[0]), LAYERS.items(), F).otherwise("other")


def layer_dir(file: Column) -> Column:
    """struct(dir, layer): the path down to the first directory that names a layer, else the top directory as 'other'."""
    parts = F.split(file, "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    known = [x for v in LAYERS.values() for x in v]
    hit = F.array_position(F.transform(dirs, lambda x: F.lower(x).isin(known)), True).cast("int")
    top = F.when(F.size(dirs) > 0, F.get(dirs, F.lit(0))).otherwise(".")
    return F.when(hit > 0, F.struct(F.array_join(F.slice(dirs, 1, hit), "/").alias("dir"), layer_of(F.get(dirs, hit - 1)).alias("layer"))).otherwise(F.struct(top.alias("dir"), F.lit("other").alias("layer")))


def layers_present(files: DataFrame) -> DataFrame:
    """(layer, dir) of the files' directories."""
    return files.select(layer_dir(F.col("path")).alias("l")).select("l.layer", "l.dir").distinct()


def layer_flows(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(src_layer, dst_layer, n): imports between files of different layers."""
    e = graph.file_imports(edges, entities).select(layer_dir(F.col("src_file"))["layer"].alias("src_layer"), layer_dir(F.col("dst_file"))["layer"].alias("dst_layer"))
    return e.where("src_layer != dst_layer").groupBy("src_layer", "dst_layer").agg(F.count(F.lit(1)).alias("n"))


def layer_violations(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Imports from a lower layer into a higher one."""
    rank = lambda c: reduce(lambda a, x: a.when(F.col(c) == x[1], x[0]), enumerate(LAYERS), F)
    e = graph.file_imports(edges, entities)
    e = e.select("src_file", "dst_file", layer_dir(F.col("src_file"))["layer"].alias("src_layer"), layer_dir(F.col("dst_file"))["layer"].alias("dst_layer"))
    return e.where(rank("src_layer") > rank("dst_layer")).orderBy("src_file", "dst_file")


def ownership(blame: DataFrame) -> DataFrame:
    """(file, author, lines, percent) from blamed lines (file, author)."""
    n = blame.groupBy("file", "author").agg(F.count(F.lit(1)).alias("lines"))
    total = n.groupBy("file").agg(F.sum("lines").alias("total"))
    return n.join(total, "file").select("file", "author", "lines", F.round(F.try_divide(F.col("lines") * F.lit(100.0), F.col("total")), 1).alias("percent"))


def figures(files: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: files, entities, edges, embedded, summarized, and embedded in percent (floor)."""
    e = entities.agg(F.count(F.lit(1)).alias("entities"), F.count("embedding").alias("embedded"), F.count("summary").alias("summarized"))
    out = files.agg(F.count(F.lit(1)).alias("files")).crossJoin(e).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))  # one row each
    return out.withColumn("embedded_percent", F.when(F.col("entities") > 0, F.floor(100 * F.col("embedded") / F.col("entities"))).otherwise(0).cast("long"))


def listed_files(files: DataFrame, entities: DataFrame, language: str | None = None) -> DataFrame:
    n = entities.groupBy(F.col("file").alias("path")).agg(F.count(F.lit(1)).alias("entities"))
    own = files.where(F.col("language") == language) if language else files
    return own.join(n, "path", "left").select("path", "language", F.coalesce("loc", F.lit(0)).alias("loc"), F.coalesce("entities", F.lit(0)).alias("entities")).orderBy("path")


def brief(files: DataFrame, entities: DataFrame, edges: DataFrame, dirs: int = 6) -> DataFrame:
    """(section, key, value) of the project: counts, languages, layers' directories, hot paths, entry points."""
    row = lambda df, section, key, value: df.select(F.lit(section).alias("section"), F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"))
    counts = figures(files, entities, edges).select(F.explode(F.create_map(*[y for x in ("files", "entities", "edges") for y in (F.lit(x), F.col(x))])).alias("key", "n"))
    by_layer = layers_present(files).groupBy("layer").agg(F.array_sort(F.collect_set("dir")).alias("d"))
    over = F.when(F.size("d") > dirs, F.concat(F.lit(",+"), (F.size("d") - dirs).cast("string"))).otherwise("")
    by_layer = by_layer.select("layer", F.concat(F.array_join(F.slice("d", 1, dirs), ","), over).alias("dirs"))
    parts = [
        row(counts, "count", "key", "n"),
        row(files.groupBy("language").agg(F.count(F.lit(1)).alias("n")), "language", "language", "n"),
        row(by_layer, "layer", "layer", "dirs"),
        row(graph.hot_paths(edges, entities), "hot", "entity_id", "fan_in"),
        row(graph.entry_points(edges), "entry", "route", "handler"),
    ]
    return reduce(DataFrame.unionAll, parts)


def unsummarized(entities: DataFrame, limit: int = 20) -> DataFrame:
    """(entity_id, remaining): the next entities without a summary by id, and how many there are."""
    own = entities.where("type in ('function', 'class', 'method', 'interface') and summary is null")
    return own.select("entity_id").orderBy("entity_id").limit(min(limit, 200)).crossJoin(own.agg(F.count(F.lit(1)).alias("remaining")))  # one row


def read_baseline(entities: DataFrame, files: DataFrame) -> DataFrame:
    """(tokens): what reading the sources of all entities of these distinct files (file) would cost."""
    own = entities.join(files.select("file").distinct(), "file", "left_semi")
    return own.agg(F.coalesce(F.sum(T.estimated_tokens(F.col("raw_source"))), F.lit(0)).alias("tokens"))


def neighbour_counts(edges: DataFrame, hits: DataFrame) -> DataFrame:
    """(entity_id, callers, callees): distinct ones over calls, for each hit."""
    calls = edges.where("type = 'calls'")
    inward = calls.groupBy(F.col("dst_id").alias("entity_id")).agg(F.countDistinct("src_id").alias("callers"))
    outward = calls.groupBy(F.col("src_id").alias("entity_id")).agg(F.countDistinct("dst_id").alias("callees"))
    out = hits.select("entity_id").join(inward, "entity_id", "left").join(outward, "entity_id", "left")
    return out.select("entity_id", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("callees", F.lit(0)).alias("callees"))
