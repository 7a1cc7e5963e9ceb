"""Registered queries on upkeep, resolution and change streams; their inputs follow from the test tables by rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resolve as R
from ..sources import store as S
from ..sources import walk as W
from ..streaming import changes as C
from . import adapter as A


def _old_new(spark, d):
    """Stored files, and a later listing: every seventh is gone, every fifth has changed."""
    f = A.files(spark, d)
    n = F.col("indexed")
    new = f.where(n % 7 != 0).withColumn("hash", F.when(n % 5 == 0, F.sha2(F.concat("hash", F.lit("x")), 256)).otherwise(F.col("hash")))
    return f, new


def upsert_latest(spark, d):
    old, new = _old_new(spark, d)
    both = new.withColumn("order", F.lit(1)).unionByName(new.withColumn("loc", F.lit(-1)).withColumn("order", F.lit(2)))
    return S.upsert(old, both, ["path"], "order").select("path", "hash", "loc")


def edge_insert_ignore(spark, d):
    e = A.edges(spark, d)
    new = e.withColumn("confidence", F.lit(0.1)).withColumn("line", F.when(F.col("line") == 1, F.lit(99)).otherwise(F.col("line")))
    return S.insert_or_ignore(e, new, ["src_id", "dst_id", "type", "line"]).groupBy("type", "line", F.col("confidence").cast("double").alias("confidence")).count()


def clear_file(spark, d):
    e, r = A.entities(spark, d), A.edges(spark, d)
    left, edges = S.cleared(e, r, e.where("type = 'function' and start_line % 3 = 0").select(F.col("file").alias("path")))
    return left.select(F.lit("entity").alias("kind"), "entity_id").unionAll(edges.select(F.lit("edge"), F.concat_ws("|", "src_id", "dst_id", "type", "line")))


def apply_summaries(spark, d):
    e = A.entities(spark, d)
    up = e.where("start_line % 2 = 0").select("entity_id", F.concat(F.lit("About "), "name").alias("summary"))
    return S.apply_updates(e, up, ["summary"]).select("entity_id", "summary")


def apply_embeddings(spark, d):
    e = A.entities(spark, d).withColumn("embedding_hash", F.lit("old"))
    return S.apply_updates(e, e.where("type = 'class'").select("entity_id", F.sha2("name", 256).alias("embedding_hash")), ["embedding_hash"]).select("entity_id", "embedding_hash")


def stale_files(spark, d):
    f = A.files(spark, d).where("indexed % 11 != 0").select("path", F.timestamp_seconds(F.col("indexed")).alias("indexed_at"))
    walked = A.files(spark, d).select("path", F.timestamp_seconds(F.when(F.col("indexed") % 4 == 0, F.col("indexed") + 10).otherwise(F.col("indexed") - 10)).alias("modified"))
    return S.stale(walked, f)


def walk_filter(spark, d):
    ext = F.array(*[F.lit(x) for x in ("py", "TSX", "txt", "go", "min.js", "R")])
    dirs = F.array(*[F.lit(x) for x in ("src", "node_modules", "app/build", "builds", "logs")])
    p = A.tables(spark, d, "pages")["pages"].select("page_id", F.concat(F.get(dirs, (F.col("page_id") % 5).cast("int")), F.lit("/f"), F.col("page_id").cast("string"), F.lit("."), F.get(ext, (F.col("page_id") % 6).cast("int"))).alias("path"))
    return W.kept_paths(p, W.ignore_rules("logs/\n!logs/f*.py\n"))


# Resolution: a synthetic program over parts. Part k lies in pkg/b<k mod 20>/m<k>.py and defines f<k> and class C<k> with method go.
def _program(spark, d):
    p = A.tables(spark, d, "part")["part"].select(F.col("p_partkey").alias("k"))
    s = lambda c: F.col(c).cast("string")
    file = F.concat(F.lit("src/prog/b"), (F.col("k") % 20).cast("string"), F.lit("/m"), s("k"), F.lit(".py"))
    base = p.withColumn("file", file)
    ent = lambda kind, name, qname: base.select(F.concat(F.lit("py:"), "file", F.lit(":"), qname).alias("entity_id"), F.lit(kind).alias("type"), name.alias("name"), qname.alias("qualified_name"), F.lit("python").alias("language"), "file", F.lit(True).alias("is_exported"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"))
    fk, ck, mod = F.concat(F.lit("f"), s("k")), F.concat(F.lit("C"), s("k")), F.regexp_replace(F.regexp_replace("file", r"\.py$", ""), "/", ".")
    e = ent("module", mod, mod).unionAll(ent("function", fk, fk)).unionAll(ent("class", ck, ck)).unionAll(ent("method", F.lit("go"), F.concat(ck, F.lit(".go"))))
    return base, e, base.select(F.col("file").alias("path"))


def _edges(base, dst):
    return base.select(F.col("k").alias("edge"), "file", F.lit("py").alias("lang"), F.concat(F.lit("py:"), "file", F.lit(":f"), F.col("k").cast("string")).alias("src_id"), dst.alias("dst_id"))


def _next(add: int):
    return F.col("k") + add


def resolve_imports(spark, d):
    base, e, files = _program(spark, d)
    j, k = _next(1), F.col("k")
    m = F.concat(F.lit("prog.b"), (j % 20).cast("string"), F.lit(".m"), j.cast("string"))
    dst = F.concat(F.lit("py:?:"), F.when(k % 4 == 0, m).when(k % 4 == 1, F.concat(m, F.lit(".f"), j.cast("string"))).when(k % 4 == 2, F.concat(m, F.lit(".*"))).otherwise(F.concat(F.lit("os.path"), k.cast("string"))))
    return R.python_imports(_edges(base, dst), e, files).select("edge", "dst_id", "confidence")


def resolve_relative(spark, d):
    base, e, files = _program(spark, d)
    j, k = _next(20), F.col("k")
    rest = F.concat(F.lit("m"), j.cast("string"))
    dst = F.when(k % 3 == 0, F.concat(F.lit("py:?rel1:"), rest)).when(k % 3 == 1, F.concat(F.lit("py:?rel2:b"), (j % 20).cast("string"), F.lit("."), rest, F.lit(".f"), j.cast("string"))).otherwise(F.concat(F.lit("py:?rel9:"), rest))
    return R.relative_imports(_edges(base, dst), e, files).select("edge", "dst_id", "confidence")


def resolve_inherits(spark, d):
    base, e, _ = _program(spark, d)
    k = F.col("k")
    dst = F.concat(F.lit("?inherits:0:"), F.when(k % 3 == 0, F.concat(F.lit("C"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("C"), _next(5).cast("string"))).otherwise(F.lit("Base")))
    return R.inherits(_edges(base, dst), e).select("edge", "dst_id", "confidence")


def _imported(base, e):
    return base.where("k % 2 = 0").select("file", F.concat(F.lit("f"), _next(1).cast("string")).alias("name"), F.concat(F.lit("imported:"), F.col("k").cast("string")).alias("id"))


def resolve_calls(spark, d):
    base, e, _ = _program(spark, d)
    dst = F.concat(F.lit("?call:f"), F.when(F.col("k") % 3 == 0, F.col("k")).otherwise(_next(1)).cast("string"))
    return R.calls(_edges(base, dst), e, _imported(base, e)).select("edge", "dst_id", "confidence")


def resolve_methodcalls(spark, d):
    """Every class inherits from the one three below it in its residue class of four, where there is one with a method."""
    base, e, _ = _program(spark, d)
    k = F.col("k")
    have = e.where("type != 'method' or cast(substring(split_part(qualified_name, '.', 1), 2) as long) % 4 = 0")
    dst = F.concat(F.lit("?methodcall:C"), k.cast("string"), F.lit(".go"))
    bases = base.where("k % 4 > 0").select(F.concat(F.lit("C"), k.cast("string")).alias("cls"), F.concat(F.lit("C"), (k - 1).cast("string")).alias("base"))
    return R.method_calls(_edges(base, dst), have, _imported(base, e).limit(0), bases).select("edge", "dst_id", "confidence")


def resolve_ts(spark, d):
    base, _, _ = _program(spark, d)
    k = F.col("k")
    f = base.select("k", F.when(k % 2 == 0, F.concat(F.lit("web/d"), (k % 9).cast("string"), F.lit("/c"), k.cast("string"), F.lit(".ts"))).otherwise(F.concat(F.lit("web/d"), (k % 9).cast("string"), F.lit("/c"), k.cast("string"), F.lit("/index.tsx"))).alias("file"))
    e = f.select(F.concat(F.lit("ts:"), "file", F.lit(":Main")).alias("entity_id"), F.lit("function").alias("type"), F.lit("Main").alias("name"), F.lit("Main").alias("qualified_name"), "file", F.lit(True).alias("is_exported"))
    to, name = F.concat(F.lit("../d"), ((k + 9) % 9).cast("string"), F.lit("/./c"), (k + 9).cast("string")), F.when(k % 4 < 2, "Main").when(k % 4 == 2, "default").otherwise("*")
    at = f.select(F.col("k").alias("edge"), F.concat(F.lit("web/d"), (F.col("k") % 9).cast("string"), F.lit("/x.ts")).alias("file"), F.concat(F.lit("ts:?:"), F.when(F.col("k") % 10 == 9, F.lit("react")).when(F.col("k") % 10 == 8, F.concat(F.lit("@/d"), (F.col("k") % 9).cast("string"), F.lit("/c"), F.col("k").cast("string"))).otherwise(to), F.lit("::"), name).alias("dst_id"))
    return R.script_imports(at, e, f.select(F.col("file").alias("path")), {"@/": "web/"}).select("edge", "dst_id", "confidence")


def resolve_pathstyle(spark, d):
    """One language for each k mod 6, with the file that the import means."""
    base, _, _ = _program(spark, d)
    k, s = F.col("k"), F.col("k").cast("string")
    langs = [("java", "src/main/java/a/b/C{}.java", "a.b.C{}"), ("go", "svc/g{}/main.go", "example.com/x/g{}"), ("rs", "src/n/r{}.rs", "crate::n::r{}::T"), ("rb", "lib/q{}.rb", "q{}"), ("php", "src/A/P{}.php", "A\\P{}"), ("c", "include/h{}.h", "h{}.h")]
    pick = lambda i: F.coalesce(*[F.when(k % 6 == n, F.concat(*[F.lit(x) if x else F.lit("") for x in t[i].split("{}")[:1]], s, F.lit(t[i].split("{}")[1])) if i else F.lit(t[0])) for n, t in enumerate(langs)])
    f = base.select("k", pick(1).alias("file"), pick(0).alias("lang"), pick(2).alias("spec"))
    e = f.where("k % 5 != 0").select(F.concat("lang", F.lit(":"), "file", F.lit(":m")).alias("entity_id"), F.lit("module").alias("type"), "file")
    at = f.select(F.col("k").alias("edge"), F.lit("main/x").alias("file"), F.concat("lang", F.lit(":?:"), "spec").alias("dst_id"))
    return R.path_imports(at, e, f.select(F.col("file").alias("path"))).select("edge", "dst_id", "confidence")


def route_handlers(spark, d):
    base, e, _ = _program(spark, d)
    dst = F.concat(F.lit("route:?handler:"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("f"), F.col("k").cast("string"))).otherwise("go"))
    return R.route_handlers(_edges(base, dst), e).select("edge", "dst_id", "confidence", "is_dynamic")


def http_routes(spark, d):
    base, e, _ = _program(spark, d)
    k = F.col("k")
    # of five routes one has two handlers and one has none
    at = F.when(k % 5 == 1, k - 1).otherwise(k)
    routes = base.select(F.concat(F.lit("route:GET /p/"), at.cast("string")).alias("src_id"), F.concat(F.lit("py:f"), k.cast("string")).alias("dst_id"))
    dst = F.concat(F.lit("route:?http:GET:/p/"), (k + 3).cast("string"))
    return R.http_calls(_edges(base, dst), routes).select("edge", "dst_id", "confidence", "is_dynamic")


def resolution_stats(spark, d):
    raw = resolve_imports(spark, d)
    before = raw.select(F.concat(F.lit("py:?:"), F.col("edge").cast("string")).alias("dst_id"))
    return R.stats(before, raw)


def containing_entity(spark, d):
    e = A.entities(spark, d)
    at = e.where("type = 'method'").select(F.col("entity_id").alias("edge"), "file", (F.col("start_line") + 3).alias("line"))
    return R.containing(at, e).groupBy("entity_id").count()


def _events(spark, d):
    e = A.tables(spark, d, "events")["events"]
    kinds = {"signup": "created", "purchase": "modified", "click": "modified", "view": "modified", "error": "deleted"}
    action = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in kinds.items()])
    action = F.when(F.col("event_id") % 9 == 0, "moved").otherwise(action)
    return e.select(F.concat(F.lit("src/u"), F.col("user_id").cast("string"), F.lit(".py")).alias("path"), F.concat(F.lit("src/v"), F.col("user_id").cast("string"), F.lit(".py")).alias("dest"), action.alias("action"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")


def moved_expand(spark, d):
    return C.relevant(_events(spark, d)).groupBy("path", "action", "language").count()


def debounce_sessions(spark, d):
    out = C.debounced(C.relevant(_events(spark, d)).select("path", "action", "ts"), "30 minutes")
    return out.select("path", "action", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"), "n")


def _results(spark, d):
    return _events(spark, d).select("path", F.col("event_id").alias("seq"), (F.col("event_id") % 4 == 0).alias("ok"), "action")


def change_log(spark, d):
    e = C.debounced(C.relevant(_events(spark, d)).select("path", "action", "ts"), "30 minutes")
    counts = _events(spark, d).groupBy("path").agg(F.count(F.lit(1)).alias("n_entities")).withColumn("error", F.when(F.col("n_entities") % 5 == 0, "parse"))
    return C.change_log(e, counts).groupBy("path", "action", "n_entities", "error").count()


QUERIES = {
    "hash_skip": lambda s, d: S.changed(_old_new(s, d)[1], _old_new(s, d)[0]).select("path", "hash"),
    "purge_vanished": lambda s, d: S.vanished(*_old_new(s, d)),
    "upsert_latest": upsert_latest,
    "edge_insert_ignore": edge_insert_ignore,
    "clear_file": clear_file,
    "apply_summaries": apply_summaries,
    "apply_embeddings": apply_embeddings,
    "stale_files": stale_files,
    "walk_filter": walk_filter,
    "generated_and_binary": lambda s, d: A.tables(s, d, "documents")["documents"].select("doc_id", W.generated(F.col("text")).alias("generated"), W.binary(F.col("text").cast("binary")).alias("binary"), F.sha2("text", 256).alias("hash")),
    "resolve_inherits": resolve_inherits,
    "resolve_py_import": resolve_imports,
    "resolve_relative": resolve_relative,
    "resolve_ts": resolve_ts,
    "resolve_pathstyle": resolve_pathstyle,
    "resolve_calls": resolve_calls,
    "resolve_methodcalls": resolve_methodcalls,
    "route_handlers": route_handlers,
    "http_routes": http_routes,
    "resolution_stats": resolution_stats,
    "containing_entity": containing_entity,
    "moved_expand": moved_expand,
    "debounce_sessions": debounce_sessions,
    "quarantine": lambda s, d: C.quarantine(_results(s, d)),
    "change_log": change_log,
}

_NEW = "new AS (SELECT path, language, CASE WHEN indexed % 5 = 0 THEN sha256(hash || 'x') ELSE hash END AS hash, loc, indexed FROM files WHERE indexed % 7 <> 0)"
_F = "'src/prog/b' || {0} % 20 || '/m' || {0} || '.py'"
_MOD = "'py:src/prog/b' || {0} % 20 || '/m' || {0} || '.py:src.prog.b' || {0} % 20 || '.m' || {0}"
_FN = "'py:src/prog/b' || {0} % 20 || '/m' || {0} || '.py:f' || {0}"
_N = "n AS (SELECT count(*) AS n FROM part), p AS (SELECT p_partkey AS k FROM part)"
_J = "(k + 1)"
_PY = (
    f"SELECT k AS edge, CASE WHEN k % 4 = 3 THEN 'external:os.path' || k WHEN k + 1 < n AND k % 4 = 0 THEN {_MOD.format(_J)} WHEN k + 1 < n AND k % 4 = 1 THEN {_FN.format(_J)} WHEN k + 1 < n THEN 'wildcard:py:' || {_F.format(_J)} "
    f"ELSE 'external:prog.b' || {_J} % 20 || '.m' || {_J} || CASE k % 4 WHEN 1 THEN '.f' || {_J} WHEN 2 THEN '.*' ELSE '' END END AS dst_id, CASE WHEN k % 4 = 3 OR k + 1 >= n THEN 0.5 WHEN k % 4 = 2 THEN 0.7 ELSE 1.0 END::DOUBLE AS confidence FROM p, n"
)
_EVENTS = "ev AS (SELECT 'src/u' || user_id || '.py' AS path, 'src/v' || user_id || '.py' AS dest, CASE WHEN event_id % 9 = 0 THEN 'moved' WHEN event_type = 'error' THEN 'deleted' ELSE 'modified' END AS action, ts, event_id FROM events), rel AS (SELECT path, action, ts FROM ev WHERE action <> 'moved' UNION ALL SELECT path, 'deleted', ts FROM ev WHERE action = 'moved' UNION ALL SELECT dest, 'modified', ts FROM ev WHERE action = 'moved')"
_SESSIONS = "g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY path ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM rel), s AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts) AS sid FROM g), deb AS (SELECT path, arg_max(action, epoch_us(ts)::VARCHAR || action) AS action, min(epoch_us(ts)) AS first, max(epoch_us(ts)) AS last, count(*) AS n FROM s GROUP BY path, sid)"

SQL = {
    "hash_skip": A.with_sql("SELECT new.path, new.hash FROM new LEFT JOIN files USING (path) WHERE files.hash IS NULL OR files.hash <> new.hash", _NEW),
    "purge_vanished": A.with_sql("SELECT path FROM files WHERE indexed % 7 = 0"),
    "upsert_latest": A.with_sql("SELECT path, CASE WHEN indexed % 5 = 0 AND indexed % 7 <> 0 THEN sha256(hash || 'x') ELSE hash END AS hash, loc FROM files"),
    "edge_insert_ignore": A.with_sql("SELECT type, line, confidence::DOUBLE AS confidence, count(*) AS count FROM (SELECT type, line, confidence::DOUBLE AS confidence FROM edges UNION ALL SELECT type, 99, 0.1::DOUBLE FROM edges WHERE line = 1) GROUP BY 1, 2, 3"),
    "clear_file": A.with_sql("SELECT 'entity' AS kind, entity_id FROM entities WHERE file NOT IN (SELECT f FROM gone) UNION ALL SELECT 'edge', src_id || '|' || dst_id || '|' || type || '|' || line FROM edges WHERE starts_with(src_id, 'route:') OR split_part(src_id, ':', 2) NOT IN (SELECT f FROM gone)", "gone AS (SELECT file AS f FROM entities WHERE type = 'function' AND start_line % 3 = 0)"),
    "apply_summaries": A.with_sql("SELECT entity_id, CASE WHEN start_line % 2 = 0 THEN 'About ' || name ELSE summary END AS summary FROM entities"),
    "apply_embeddings": A.with_sql("SELECT entity_id, CASE WHEN type = 'class' THEN sha256(name) ELSE 'old' END AS embedding_hash FROM entities"),
    "stale_files": A.with_sql("SELECT path FROM files WHERE indexed % 11 = 0 OR indexed % 4 = 0"),
    "walk_filter": "SELECT page_id, d || '/f' || page_id || '.' || x AS path, CASE x WHEN 'py' THEN 'python' WHEN 'TSX' THEN 'typescript' WHEN 'go' THEN 'go' WHEN 'min.js' THEN 'javascript' WHEN 'R' THEN 'r' END AS language FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'src' WHEN 1 THEN 'node_modules' WHEN 2 THEN 'app/build' WHEN 3 THEN 'builds' ELSE 'logs' END AS d, CASE page_id % 6 WHEN 0 THEN 'py' WHEN 1 THEN 'TSX' WHEN 2 THEN 'txt' WHEN 3 THEN 'go' WHEN 4 THEN 'min.js' ELSE 'R' END AS x FROM pages) WHERE x <> 'txt' AND (d IN ('src', 'builds') OR (d = 'logs' AND x = 'py'))",
    "generated_and_binary": "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 10000)) > 0 AS generated, false AS binary, sha256(text) AS hash FROM documents",
    "resolve_inherits": f"WITH {_N} SELECT k AS edge, CASE WHEN k % 3 = 0 THEN {_FN.format('k').replace(':f', ':C')} WHEN k % 3 = 1 AND k + 5 < n THEN {_FN.format('(k + 5)').replace(':f', ':C')} WHEN k % 3 = 1 THEN 'external:C' || (k + 5) ELSE 'external:Base' END AS dst_id, CASE WHEN k % 3 = 0 THEN 0.9 WHEN k % 3 = 1 AND k + 5 < n THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence FROM p, n",
    "resolve_py_import": f"WITH {_N} {_PY}",
    "resolve_relative": f"WITH {_N} SELECT k AS edge, CASE WHEN k % 3 = 0 AND k + 20 < n THEN {_MOD.format('(k + 20)')} WHEN k % 3 = 1 AND k + 20 < n THEN {_FN.format('(k + 20)')} WHEN k % 3 = 0 THEN 'external:rel1.m' || (k + 20) WHEN k % 3 = 1 THEN 'external:rel2.b' || (k + 20) % 20 || '.m' || (k + 20) || '.f' || (k + 20) ELSE 'external:rel9.m' || (k + 20) END AS dst_id, CASE WHEN k % 3 < 2 AND k + 20 < n THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence FROM p, n",
    "resolve_ts": f"WITH {_N}, t AS (SELECT k, CASE WHEN k % 10 = 8 THEN k ELSE k + 9 END AS j FROM p), f AS (SELECT k, j, 'web/d' || j % 9 || '/c' || j || CASE WHEN j % 2 = 0 THEN '.ts' ELSE '/index.tsx' END AS file FROM t) SELECT k AS edge, CASE WHEN k % 10 = 9 THEN 'external:react' WHEN j >= n THEN 'external:../d' || (k + 9) % 9 || '/./c' || (k + 9) WHEN k % 4 = 3 THEN 'wildcard:ts:' || file ELSE 'ts:' || file || ':Main' END AS dst_id, CASE WHEN k % 10 = 9 OR j >= n THEN 0.5 WHEN k % 4 = 3 THEN 0.7 WHEN k % 4 = 2 THEN 0.8 ELSE 1.0 END::DOUBLE AS confidence FROM f, n",
    "resolve_pathstyle": f"WITH {_N} SELECT k AS edge, CASE WHEN k % 5 = 0 THEN 'external:' || CASE k % 6 WHEN 0 THEN 'a.b.C' || k WHEN 1 THEN 'example.com/x/g' || k WHEN 2 THEN 'crate::n::r' || k || '::T' WHEN 3 THEN 'q' || k WHEN 4 THEN 'A\\P' || k ELSE 'h' || k || '.h' END ELSE CASE k % 6 WHEN 0 THEN 'java:src/main/java/a/b/C' || k || '.java' WHEN 1 THEN 'go:svc/g' || k || '/main.go' WHEN 2 THEN 'rs:src/n/r' || k || '.rs' WHEN 3 THEN 'rb:lib/q' || k || '.rb' WHEN 4 THEN 'php:src/A/P' || k || '.php' ELSE 'c:include/h' || k || '.h' END || ':m' END AS dst_id, CASE WHEN k % 5 = 0 THEN 0.5 ELSE 0.9 END::DOUBLE AS confidence FROM p",
    "resolve_calls": f"WITH {_N} SELECT k AS edge, CASE WHEN k % 3 = 0 THEN {_FN.format('k')} WHEN k % 2 = 0 THEN 'imported:' || k ELSE 'external:f' || (k + 1) END AS dst_id, CASE WHEN k % 3 = 0 THEN 1.0 WHEN k % 2 = 0 THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence FROM p",
    "resolve_methodcalls": f"WITH {_N} SELECT k AS edge, {_FN.format('(k - k % 4)').replace(':f', ':C')} || '.go' AS dst_id, CASE WHEN k % 4 = 0 THEN 0.9 ELSE 0.8 END::DOUBLE AS confidence FROM p",
    "route_handlers": f"WITH {_N} SELECT k AS edge, CASE WHEN k % 2 = 0 THEN {_FN.format('k')} ELSE 'external:route_handler:go' END AS dst_id, 0.5::DOUBLE AS confidence, true AS is_dynamic FROM p",
    "http_routes": f"WITH {_N} SELECT k AS edge, CASE WHEN k + 3 < n AND ((k + 3) % 5 > 1 OR (k + 3) % 5 = 0 AND k + 4 = n) THEN 'py:f' || (k + 3) ELSE 'external:http_route:GET:/p/' || (k + 3) END AS dst_id, 0.5::DOUBLE AS confidence, true AS is_dynamic FROM p, n",
    "resolution_stats": f"WITH {_N}, r AS ({_PY}) SELECT count(*) AS inspected, count(*) FILTER (WHERE starts_with(dst_id, 'py:')) AS resolved, count(*) FILTER (WHERE starts_with(dst_id, 'external:')) AS external, count(*) FILTER (WHERE starts_with(dst_id, 'wildcard:')) AS wildcard FROM r",
    "containing_entity": A.with_sql("SELECT entity_id, count(*) AS count FROM (SELECT a.entity_id AS edge, min_by(b.entity_id, lpad((b.end_line - b.start_line)::VARCHAR, 9, '0') || b.entity_id) AS entity_id FROM (SELECT * FROM entities WHERE type = 'method') a LEFT JOIN entities b ON a.file = b.file AND b.type IN ('function', 'method') AND a.start_line + 3 BETWEEN b.start_line AND b.end_line GROUP BY 1) GROUP BY 1"),
    "moved_expand": f"WITH {_EVENTS} SELECT path, action, 'python' AS language, count(*) AS count FROM rel GROUP BY 1, 2",
    "debounce_sessions": f"WITH {_EVENTS}, {_SESSIONS} SELECT * FROM deb",
    "quarantine": f"WITH {_EVENTS}, r AS (SELECT path, event_id AS seq, event_id % 4 = 0 OR action = 'deleted' AS good FROM ev), i AS (SELECT *, sum(good::INT) OVER (PARTITION BY path ORDER BY seq) AS isl FROM r), f AS (SELECT path, seq, sum((NOT good)::INT) OVER (PARTITION BY path, isl ORDER BY seq)::BIGINT AS failures FROM i) SELECT path, seq, failures, failures >= 3 AS quarantined FROM f",
    "change_log": f"WITH {_EVENTS}, {_SESSIONS}, c AS (SELECT path, count(*) AS m FROM ev GROUP BY 1) SELECT deb.path, action, coalesce(m, 0) AS n_entities, CASE WHEN m % 5 = 0 THEN 'parse' END AS error, count(*) AS count FROM deb LEFT JOIN c USING (path) GROUP BY 1, 2, 3, 4",
}
