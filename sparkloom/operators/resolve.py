"""Symbol resolution: provisional edge targets become entities, by joins in the order of phases.

Each phase makes candidates (edge, priority, target, confidence) as a union of
strategies and keeps the best for each edge, so no chain of dependent joins arises.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.cut import cut
from ..schemas import EDGE_KEY

# Directories below which importable packages begin.
SOURCE_ROOTS = ["src", "packages", "lib", "app", "apps", "source", "backend", "server", "services", "internal", "pkg", "cmd"]
AMBIGUOUS = 500
# Endings and index files tried for a script import, in order.
SCRIPT_ENDINGS = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
RUST_OUTSIDE = ["std::", "core::", "alloc::", "proc_macro::", "test::"]


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join that shuffles both sides: sizes are estimated from files, so a side may be broadcast that is far too large for the driver."""
    return df.hint("merge")


def unique_names(entities: DataFrame, column: str = "name") -> DataFrame:
    """(column, id, n): how many entities have the name, and the smallest id; names of modules count as well."""
    return entities.groupBy(column).agg(F.min("entity_id").alias("id"), F.count(F.lit(1)).alias("n"))


def by_file_name(entities: DataFrame) -> DataFrame:
    """(file, name, id): one entity for each name of a file, a top-level one first, then the smallest id."""
    best = F.min(F.struct((F.col("qualified_name") != F.col("name")).alias("nested"), "entity_id"))
    return entities.where("type != 'module'").groupBy("file", "name").agg(best.alias("b")).select("file", "name", F.col("b.entity_id").alias("id"))


def best(edges: DataFrame, candidates: list[DataFrame], fallback: Column, confidence: float = 0.5) -> DataFrame:
    """edges (with a key `edge`) with dst_id and confidence of the candidate (edge, priority, id, conf) of least priority, else the fallback."""
    all_rows = reduce(DataFrame.unionByName, [c.select("edge", "priority", "id", F.col("conf").cast("double").alias("conf")) for c in candidates])
    chosen = all_rows.groupBy("edge").agg(F.min(F.struct("priority", "id", "conf")).alias("c"))
    out = edges.join(shuffled(chosen), "edge", "left")
    return out.withColumn("dst_id", F.coalesce("c.id", fallback)).withColumn("confidence", F.coalesce("c.conf", F.lit(confidence))).drop("c")


def _cand(df: DataFrame, priority: int, conf: float, target: str = "id") -> DataFrame:
    return df.select("edge", F.lit(priority).alias("priority"), F.col(target).alias("id"), F.lit(conf).alias("conf"))


def inherits(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Base classes ?inherits:<n>:<Base> of (edge, src_id, dst_id, file): of the same file .9, the only one of that name .7, else external .5."""
    e = edges.withColumn("base", F.element_at(F.split("dst_id", ":", 3), -1))
    own = entities.where("type in ('class', 'interface')")
    same = e.join(shuffled(by_file_name(own).withColumnRenamed("name", "base")), ["file", "base"])
    sole = e.join(shuffled(unique_names(own).where("n = 1").withColumnRenamed("name", "base")), "base")
    return best(e, [_cand(same, 1, 0.9), _cand(sole, 2, 0.7)], F.concat(F.lit("external:"), "base")).drop("base")


def module_names(files: DataFrame) -> DataFrame:
    """(qname, path): dotted module names of files, as they are and below source roots."""
    p = F.regexp_replace(F.regexp_replace("path", r"\.[^./]+$", ""), "/__init__$", "")
    parts = F.split(p, "/")
    skip = F.coalesce(F.array_position(F.transform(parts, lambda x: ~x.isin(SOURCE_ROOTS)), True) - 1, F.lit(0))
    skip = F.when(skip < 0, F.size(parts) - 1).otherwise(skip).cast("int")
    whole = F.array_join(parts, ".")
    below = F.array_join(F.slice(parts, skip + 1, F.size(parts)), ".")
    return files.select(F.explode(F.array_distinct(F.array(whole, below))).alias("qname"), "path").groupBy("qname").agg(F.min("path").alias("path"), F.countDistinct("path").alias("n"))


def suffix_names(files: DataFrame) -> DataFrame:
    """(qname, path): each dotted end of a module's name that belongs to one file only."""
    parts = F.split(F.regexp_replace(F.regexp_replace("path", r"\.[^./]+$", ""), "/__init__$", ""), "/")
    ends = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "."))
    return files.select(F.explode(ends).alias("qname"), "path").groupBy("qname").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("n")).where("n = 1").select("qname", "path")


def python_imports(edges: DataFrame, entities: DataFrame, files: DataFrame) -> DataFrame:
    """py:?:<dotted name>: wildcard .7, module 1.0, only suffix .8, name of a module 1.0 (.8 by suffix), else external .5."""
    e = edges.withColumn("q", F.regexp_replace("dst_id", r"^py:\?:", ""))
    e = e.withColumn("head", F.regexp_replace("q", r"\.[^.]*$", "")).withColumn("last", F.element_at(F.split("q", r"\."), -1))
    module = entities.where("type = 'module'").groupBy("file").agg(F.min("entity_id").alias("id"))
    exact = module_names(files).select("qname", "path").join(shuffled(module.withColumnRenamed("file", "path")), "path")
    suffix = suffix_names(files).join(shuffled(module.withColumnRenamed("file", "path")), "path")
    names = by_file_name(entities).select(F.col("file").alias("path"), F.col("name").alias("last"), F.col("id").alias("own"))
    on = lambda m, c: e.where("last != '*'").join(shuffled(m.withColumnRenamed("qname", c)), c)
    star = e.where("last = '*'").join(shuffled(exact.unionByName(suffix).groupBy("qname").agg(F.min("path").alias("path")).withColumnRenamed("qname", "head")), "head").withColumn("id", F.concat(F.lit("wildcard:py:"), "path"))
    parts = [_cand(star, 1, 0.7), _cand(on(exact, "q"), 2, 1.0), _cand(on(suffix, "q"), 3, 0.8), _cand(on(exact, "head").drop("id").join(shuffled(names), ["path", "last"]), 4, 1.0, "own"), _cand(on(suffix, "head").drop("id").join(shuffled(names), ["path", "last"]), 5, 0.8, "own")]
    return best(e, parts, F.concat(F.lit("external:"), "q")).drop("q", "head", "last")


def relative_imports(edges: DataFrame, entities: DataFrame, files: DataFrame) -> DataFrame:
    """py:?rel<N>:<name> of (edge, file, dst_id): N - 1 packages up from the file's own; too deep or unknown gives external:rel<N>.<name> .5."""
    n = F.regexp_extract("dst_id", r"^py:\?rel(\d+):", 1).cast("int")
    rest = F.regexp_replace("dst_id", r"^py:\?rel\d+:", "")
    dirs = F.split("file", "/")
    keep = F.size(dirs) - F.lit(1) - (n - 1)
    e = edges.withColumn("keep", keep).withColumn("rest", rest).withColumn("n", n)
    base = F.array_join(F.slice(dirs, 1, F.greatest(F.col("keep"), F.lit(0))), ".")
    e = e.withColumn("q", F.when(F.col("keep") >= 0, F.concat_ws(".", F.nullif(base, F.lit("")), F.nullif(F.col("rest"), F.lit("")))))
    e = e.withColumn("head", F.regexp_replace("q", r"\.?[^.]*$", "")).withColumn("last", F.element_at(F.split("q", r"\."), -1))
    module = entities.where("type = 'module'").groupBy("file").agg(F.min("entity_id").alias("id"))
    whole = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"\.[^./]+$", ""), "/__init__$", ""), "/", ".")
    exact = files.select(whole.alias("qname"), "path").join(shuffled(module.withColumnRenamed("file", "path")), "path")
    names = by_file_name(entities).select(F.col("file").alias("path"), F.col("name").alias("last"), F.col("id").alias("own"))
    mod = e.join(shuffled(exact.withColumnRenamed("qname", "q")), "q")
    name = e.join(shuffled(exact.drop("id").withColumnRenamed("qname", "head")), "head").join(shuffled(names), ["path", "last"])
    return best(e, [_cand(mod, 1, 1.0), _cand(name, 2, 1.0, "own")], F.concat(F.lit("external:rel"), F.col("n").cast("string"), F.lit("."), "rest")).drop("keep", "rest", "n", "q", "head", "last")


def normal_path(path: Column) -> Column:
    """A path without . and .. segments; one that leaves the root is null."""
    zero = F.array().cast("array<string>")
    step = lambda acc, x: F.when(x.isin("", "."), acc).when((x == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(acc, F.array(F.lit(""))), F.greatest(F.size(acc), F.lit(1))) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(F.split(path, "/"), zero, step, lambda acc: F.when(~F.array_contains(acc, ".."), F.array_join(acc, "/")))


def script_imports(edges: DataFrame, entities: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """ts:?:<specifier>::<name> of (edge, file, dst_id): endings and index files in order; named 1.0, default .8 (module .7), * wildcard .7, else external .5.

    aliases: prefixes of path aliases to directories; the longest that fits applies.
    """
    spec, name = F.regexp_extract("dst_id", r"^[a-z]+:\?:(.*)::[^:]*$", 1), F.regexp_extract("dst_id", r"::([^:]*)$", 1)
    e = edges.withColumn("spec", spec).withColumn("name", name)
    mapped = F.lit(None).cast("string")
    for k in sorted(aliases or {}, key=len):
        mapped = F.when(F.col("spec").startswith(k), F.concat(F.lit(aliases[k]), F.substring("spec", len(k) + 1, 4096))).otherwise(mapped)
    near = F.concat(F.regexp_replace("file", "[^/]*$", ""), F.col("spec"))
    e = e.withColumn("to", normal_path(F.when(F.col("spec").startswith("."), near).otherwise(mapped)))
    tried = e.where("to is not null").select("edge", "name", F.posexplode(F.array(*[F.concat("to", F.lit(x)) for x in SCRIPT_ENDINGS])).alias("nth", "path"))
    hit = tried.join(shuffled(files.select("path")), "path").groupBy("edge", "name").agg(F.min(F.struct("nth", "path")).alias("h")).select("edge", "name", F.col("h.path").alias("path"))
    own = by_file_name(entities).withColumnRenamed("file", "path")
    sole = entities.where("is_exported and type != 'module'").groupBy(F.col("file").alias("path")).agg(F.min("entity_id").alias("id"), F.count(F.lit(1)).alias("n")).where("n = 1")
    module = entities.where("type = 'module'").groupBy(F.col("file").alias("path")).agg(F.min("entity_id").alias("id"))
    parts = [
        _cand(hit.where("name = '*'").withColumn("id", F.concat(F.lit("wildcard:ts:"), "path")), 1, 0.7),
        _cand(hit.where("name not in ('*', 'default')").join(shuffled(own), ["path", "name"]), 2, 1.0),
        _cand(hit.where("name = 'default'").join(shuffled(sole), "path"), 3, 0.8),
        _cand(hit.where("name = 'default'").join(shuffled(module), "path"), 4, 0.7),
    ]
    return best(e, parts, F.concat(F.lit("external:"), "spec")).drop("spec", "name", "to")


def path_imports(edges: DataFrame, entities: DataFrame, files: DataFrame) -> DataFrame:
    """go, rs, java, rb, php, c and cpp imports of (edge, file, dst_id) by candidate paths in order: the module of the first .9, else external .5."""
    lang, spec = F.split("dst_id", ":", 3)[0], F.regexp_replace("dst_id", r"^[a-z]+:\?:", "")
    e = edges.withColumn("lang", lang).withColumn("spec", spec)
    here = F.regexp_replace("file", "[^/]*$", "")
    s = F.col("spec")
    slash = lambda c, sep: F.array_join(F.split(c, sep), "/")
    rust = slash(F.regexp_replace(F.regexp_replace(s, "^(crate|self|super)::", ""), r"::\{.*$", ""), "::")
    rust_up = F.regexp_replace(rust, "/[^/]*$", "")
    roots = ["", "src/"]
    tried = (
        F.when(F.col("lang") == "java", F.when(s.endswith(".*"), F.array().cast("array<string>")).otherwise(F.array(*[F.concat(F.lit(r), slash(s, r"\."), F.lit(".java")) for r in ["", "src/", "src/main/java/"]])))
        .when(F.col("lang") == "rb", F.array(*[normal_path(F.concat(d, s, F.lit(x))) for d in (here, F.lit(""), F.lit("lib/"), F.lit("app/")) for x in ("", ".rb")]))
        .when(F.col("lang") == "php", F.array(*[normal_path(F.concat(d, F.translate(s, "\\", "/"), F.lit(x))) for d in (here, F.lit(""), F.lit("src/")) for x in ("", ".php")]))
        .when(F.col("lang").isin("c", "cpp"), F.array(*[normal_path(F.concat(d, s)) for d in (here, F.lit(""), F.lit("include/"), F.lit("src/"))]))
        .when((F.col("lang") == "rs") & ~reduce(lambda a, b: a | b, [s.startswith(x) for x in RUST_OUTSIDE]), F.array(*[F.concat(F.lit(r), p, F.lit(x)) for p in (rust, rust_up) for r in reversed(roots) for x in (".rs", "/mod.rs")]))
        .otherwise(F.array().cast("array<string>"))
    )
    module = entities.where("type = 'module'").groupBy(F.col("file").alias("path")).agg(F.min("entity_id").alias("id"))
    hit = e.select("edge", F.posexplode(tried).alias("nth", "path")).join(shuffled(module), "path").select("edge", (F.col("nth") + 1).alias("priority"), "id", F.lit(0.9).alias("conf"))
    go = files.where("path like '%.go'").select(F.regexp_extract("path", "([^/]+)/[^/]*$", 1).alias("dir"), "path").groupBy("dir").agg(F.min("path").alias("path"))
    gone = e.where("lang = 'go'").withColumn("dir", F.element_at(F.split("spec", "/"), -1)).join(shuffled(go), "dir").join(shuffled(module), "path")
    return best(e, [hit, _cand(gone, 1, 0.9)], F.concat(F.lit("external:"), "spec")).drop("lang", "spec")


def calls(edges: DataFrame, entities: DataFrame, imports: DataFrame) -> DataFrame:
    """?call:<name> of (edge, file, lang, dst_id): the same file 1.0, a name the file imports (file, name, id) .9, the same Java package .85, else external .5."""
    e = edges.withColumn("name", F.regexp_replace("dst_id", r"^\?call:", "")).withColumn("dir", F.regexp_replace("file", "/[^/]*$", ""))
    same = e.join(shuffled(by_file_name(entities)), ["file", "name"])
    known = e.join(shuffled(imports.groupBy("file", "name").agg(F.min("id").alias("id"))), ["file", "name"])
    java = entities.where("language = 'java' and is_exported and type != 'module'").groupBy(F.regexp_replace("file", "/[^/]*$", "").alias("dir"), "name").agg(F.min("entity_id").alias("id"))
    package = e.where("lang = 'java'").join(shuffled(java), ["dir", "name"])
    return best(e, [_cand(same, 1, 1.0), _cand(known, 2, 0.9), _cand(package, 3, 0.85)], F.concat(F.lit("external:"), "name")).drop("name", "dir")


def method_calls(edges: DataFrame, entities: DataFrame, imports: DataFrame, bases: DataFrame, levels: int = 6) -> DataFrame:
    """?methodcall:<Type>.<name> of (edge, file, lang, dst_id): the only Type.name .9, one of the same file .9 (up to 500 of that name), inherited .8, else as calls.

    bases: (cls, base) names of classes and their bases, walked `levels` up, the nearest first.
    """
    e = edges.withColumn("q", F.regexp_replace("dst_id", r"^\?methodcall:", ""))
    e = e.withColumn("cls", F.regexp_replace("q", r"\.[^.]*$", "")).withColumn("name", F.element_at(F.split("q", r"\."), -1))
    methods = entities.where("type in ('method', 'function')")
    counted = unique_names(methods, "qualified_name").withColumnRenamed("qualified_name", "q")
    in_file = methods.groupBy(F.col("qualified_name").alias("q"), "file").agg(F.min("entity_id").alias("own"))
    parts = [_cand(e.join(shuffled(counted.where("n = 1")), "q"), 1, 0.9), _cand(e.join(shuffled(counted.where(f"n <= {AMBIGUOUS}").select("q")), "q").join(shuffled(in_file), ["q", "file"]), 2, 0.9, "own")]
    at = e.select("edge", "file", "name", "cls")
    for d in range(1, levels + 1):
        at = cut(at.join(shuffled(bases), "cls").select("edge", "file", "name", F.col("base").alias("cls")).distinct())
        if at.isEmpty():
            break
        q = at.withColumn("q", F.concat_ws(".", "cls", "name"))
        parts += [_cand(q.join(shuffled(counted.where("n = 1")), "q"), 2 + d, 0.8), _cand(q.join(shuffled(in_file), ["q", "file"]), 2 + d, 0.8, "own")]
    same = e.join(shuffled(by_file_name(entities)), ["file", "name"])
    known = e.join(shuffled(imports.groupBy("file", "name").agg(F.min("id").alias("id"))), ["file", "name"])
    parts += [_cand(same, 20, 1.0), _cand(known, 21, 0.9)]
    return best(e, parts, F.concat(F.lit("external:"), "name")).drop("q", "cls", "name")


def route_handlers(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """route:?handler:<name>: the only entity of that name, else external:route_handler:<name>; .5 and dynamic."""
    e = edges.withColumn("name", F.regexp_replace("dst_id", r"^route:\?handler:", ""))
    sole = unique_names(entities.where("type in ('function', 'method')")).where("n = 1")
    return best(e, [_cand(e.join(shuffled(sole), "name"), 1, 0.5)], F.concat(F.lit("external:route_handler:"), "name")).withColumn("is_dynamic", F.lit(True)).drop("name")


def http_calls(edges: DataFrame, resolved: DataFrame) -> DataFrame:
    """route:?http:<M>:<path>: the handler if exactly one edge of that route leads inside, else external:http_route:<M>:<path>; .5 and dynamic."""
    e = edges.withColumn("route", F.concat(F.lit("route:"), F.regexp_extract("dst_id", r"^route:\?http:([^:]*):", 1), F.lit(" "), F.regexp_replace("dst_id", r"^route:\?http:[^:]*:", "")))
    sole = resolved.where("src_id like 'route:%' and dst_id not like 'external:%'").groupBy(F.col("src_id").alias("route")).agg(F.count(F.lit(1)).alias("n"), F.min("dst_id").alias("id")).where("n = 1")
    return best(e, [_cand(e.join(shuffled(sole), "route"), 1, 0.5)], F.regexp_replace("dst_id", r"^route:\?http:", "external:http_route:")).withColumn("is_dynamic", F.lit(True)).drop("route")


def containing(calls_at: DataFrame, entities: DataFrame) -> DataFrame:
    """(edge, entity_id): the smallest function or method around a line (edge, file, line), else the file's module.

    A range of lines is cut into the fewest blocks of 2^level lines that begin at
    multiples of their size, two of a level at most. The best of each block is
    found first; a line then looks into its one block of each level.
    """
    own = entities.where("type in ('function', 'method')").select("file", F.col("start_line").cast("long").alias("lo"), (F.col("end_line").cast("long") + 1).alias("hi"), "entity_id").where("lo < hi")
    own = own.groupBy("file", "lo", "hi").agg(F.min("entity_id").alias("id"))
    low, high = "-shiftright(-lo, k)", "shiftright(hi, k)"  # whole blocks of level k within the range
    cuts = f"transform(sequence(0, CAST(log2(hi - lo) AS INT) + 1), k -> array(CASE WHEN {low} < {high} AND {low} & 1 = 1 THEN struct(k AS level, {low} AS block) END, CASE WHEN {low} < {high} AND {high} & 1 = 1 THEN struct(k AS level, {high} - 1 AS block) END))"
    blocks = own.select("file", (F.col("hi") - F.col("lo")).alias("size"), "id", F.explode(F.expr(f"filter(flatten({cuts}), x -> x IS NOT NULL)")).alias("b"))
    best_of = blocks.groupBy("file", "b.level", "b.block").agg(F.min(F.struct("size", "id")).alias("m"))
    levels = best_of.groupBy("file").agg(F.collect_set("level").alias("levels"))
    at = calls_at.select("file", "line").distinct().join(shuffled(levels), "file")
    at = at.select("file", "line", F.explode("levels").alias("level")).withColumn("block", F.expr("shiftright(CAST(line AS BIGINT), level)"))
    got = at.join(shuffled(best_of), ["file", "level", "block"]).groupBy("file", "line").agg(F.min("m").alias("m"))
    module = entities.where("type = 'module'").groupBy("file").agg(F.min("entity_id").alias("module"))
    found = calls_at.join(shuffled(got), ["file", "line"], "left").join(shuffled(module), "file", "left")
    return found.groupBy("edge").agg(F.min("m").alias("m"), F.min("module").alias("module")).select("edge", F.coalesce("m.id", "module").alias("entity_id"))


def resolve(raw: DataFrame, entities: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Raw edges (EDGES and owner file `file`) with resolved targets: bases, imports, calls, handlers, HTTP calls, in this order."""
    e = raw.withColumn("edge", F.xxhash64(*EDGE_KEY)).withColumn("lang", F.split("src_id", ":", 2)[0])
    d = F.col("dst_id")
    cols = ["src_id", "dst_id", "type", "line", "confidence", "is_dynamic"]
    take = lambda df: df.select(*[F.col(c) for c in ("edge", "file", *cols)])
    e = cut(e)
    done_inherits = cut(inherits(e.where(d.startswith("?inherits:")), entities))
    imported = [python_imports(e.where(d.startswith("py:?:")), entities, files), relative_imports(e.where(d.startswith("py:?rel")), entities, files), script_imports(e.where(d.rlike(r"^(ts|js):\?:")), entities, files, aliases), path_imports(e.where(d.rlike(r"^(go|rs|java|rb|php|c|cpp|kt|scala|html):\?:")), entities, files)]
    done_imports = cut(reduce(DataFrame.unionByName, map(take, imported)))
    table = done_imports.join(shuffled(entities.select(F.col("entity_id").alias("dst_id"), "name")), "dst_id").select("file", "name", F.col("dst_id").alias("id"))
    last = lambda c: F.element_at(F.split(c, r"[:.]"), -1)
    bases = done_inherits.select(last("src_id").alias("cls"), last("dst_id").alias("base")).distinct()
    done_calls = [calls(e.where(d.startswith("?call:")), entities, table), method_calls(e.where(d.startswith("?methodcall:")), entities, table, bases)]
    done_routes = take(route_handlers(e.where(d.startswith("route:?handler:")), entities))
    rest = e.where(~d.rlike(r"^(\?inherits:|\?call:|\?methodcall:|route:\?|[a-z]+:\?)"))
    routes = done_routes.unionByName(take(rest))
    done_http = http_calls(e.where(d.startswith("route:?http:")), routes)
    out = reduce(DataFrame.unionByName, [take(done_inherits), done_imports, *map(take, done_calls), routes, take(done_http)])
    return out.select(*cols).dropDuplicates(EDGE_KEY)


def stats(raw: DataFrame, resolved: DataFrame) -> DataFrame:
    """(inspected, resolved, external, wildcard)."""
    n = raw.agg(F.count_if(F.col("dst_id").rlike(r"^(\?|route:\?|[a-z]+:\?)")).alias("inspected"))
    d = F.col("dst_id")
    r = resolved.agg(F.count_if(~d.startswith("external:") & ~d.startswith("wildcard:")).alias("resolved"), F.count_if(d.startswith("external:")).alias("external"), F.count_if(d.startswith("wildcard:")).alias("wildcard"))
    return n.crossJoin(r)  # one row each
