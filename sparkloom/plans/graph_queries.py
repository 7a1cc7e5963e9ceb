"""Registered queries on the graph and its quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import quality as Q
from ..operators import retrieval as R
from ..operators import search as S
from . import adapter as A
from .cut import kept

_NATION = "tbl:nation:NATION_3"


def impact_callers(spark, d):
    e = kept(A.edges(spark, d).select("src_id", "dst_id", "type", "line"))
    return G.callers(e, e.where("type = 'calls' and dst_id like 'py:%'").agg(F.min("dst_id")).first()[0], 3)


def deps_bfs(spark, d):
    e = kept(A.edges(spark, d).select("src_id", "dst_id", "type", "line"))
    return G.dependencies(e, A.entities(spark, d), e.where("type = 'calls' and src_id like 'py:%'").agg(F.max("src_id")).first()[0], 3)


def shortest_path(spark, d):
    e = kept(A.edges(spark, d).select("src_id", "dst_id", "type", "line"))
    goal = e.where("src_id like 'py:%' and dst_id like 'py:%' and type = 'calls'").agg(F.max("dst_id")).first()[0]
    start = e.where("src_id like 'route:%'").agg(F.min("src_id")).first()[0]
    return G.shortest_path(e, start, goal, 7).select(F.array_join("path", " > ").alias("path"))


def path_labels(spark, d):
    e = A.edges(spark, d)
    first = e.where("src_id like 'route:%'").select(F.array("src_id", "dst_id").alias("path"))
    return G.path_labels(first, A.entities(spark, d))


def scc_cycles(spark, d):
    return G.cycles(G.file_imports(A.edges(spark, d), A.entities(spark, d))).select(F.array_join("members", ",").alias("members"))


def part_cycles(spark, d):
    """Cycles of k -> (7k + 3) mod N over parts, by smallest member and size."""
    p = A.tables(spark, d, "part")["part"]
    n = p.count()
    g = p.select(F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("src_file"), F.lpad(((F.col("p_partkey") * 7 + 3) % n).cast("string"), 12, "0").alias("dst_file"))
    return G.strong_components(g).groupBy("root").agg(F.count(F.lit(1)).alias("size"))


def context_pack(spark, d):
    """The best of twelve hits of a search, packed."""
    e = A.entities(spark, d)
    found = S.ranks(S.literal(e, "customer", 12), F.desc("score"), F.length("name"), "name", "entity_id").select("rank", "entity_id")
    hits = found.join(e.select("entity_id", "file"), "entity_id")
    return R.packed_context(hits, e, A.edges(spark, d), 7, 1500).select("rank", "entity_id", "file", "preview", "doc", "callers", "callees")


def read_baseline(spark, d):
    e = A.entities(spark, d)
    return Q.read_baseline(e, e.where("type = 'class'").select("file"))


def files_figures(spark, d):
    e = A.entities(spark, d).withColumn("embedding", F.lit(None).cast("array<float>"))
    return Q.figures(A.files(spark, d), e, A.edges(spark, d))


def _both(f):
    return lambda spark, d: f(A.edges(spark, d), A.entities(spark, d))


def _ents(f):
    return lambda spark, d: f(A.entities(spark, d))


QUERIES = {
    "impact_callers": impact_callers,
    "deps_bfs": deps_bfs,
    "shortest_path": shortest_path,
    "path_labels": path_labels,
    "file_import_graph": _both(G.file_imports),
    "scc_cycles": scc_cycles,
    "part_cycles": part_cycles,
    "module_graph": lambda s, d: G.module_graph(A.edges(s, d), A.entities(s, d).withColumn("type", F.when(F.col("entity_id").startswith("tbl:nation:"), "module").otherwise(F.col("type")))),
    "entity_graph": lambda s, d: G.entity_graph(A.edges(s, d), A.entities(s, d), "api/NATION_0.py")[0],
    "entity_graph_edges": lambda s, d: G.entity_graph(A.edges(s, d), A.entities(s, d), "api/NATION_0.py")[1].select("src_id", "dst_id", "type", "line"),
    "entity_context": lambda s, d: G.entity_context(A.edges(s, d), _NATION),
    "hot_paths": _both(G.hot_paths),
    "entry_points": lambda s, d: G.entry_points(A.edges(s, d)),
    "rag_degree": lambda s, d: G.degrees(A.edges(s, d)),
    "rag_neighbors": lambda s, d: G.neighbours(A.edges(s, d), A.entities(s, d), A.entities(s, d).where("type = 'class' and name < 'NATION_2'").select("entity_id")),
    "outbound_lists": lambda s, d: G.outbound(A.edges(s, d), A.entities(s, d).where("type = 'method'").select("entity_id")).select("entity_id", F.array_join("targets", ",").alias("targets")),
    "representatives": _both(G.representatives),
    "god_class": _ents(lambda e: Q.god_classes(e, 5)),
    "large_class": _ents(Q.large_classes),
    "high_coupling": _both(lambda r, e: Q.high_coupling(r, e, 8)),
    "complex_function": _ents(Q.complex_functions),
    "smells_ranked": _both(lambda r, e: Q.smells(r, e, god=5, coupling=8)),
    "dead_code": _both(Q.dead_code),
    "dead_code_methods": _both(lambda r, e: Q.dead_code(r, e, methods=True)),
    "decorator_registered": _ents(lambda e: e.where(Q.registered(F.col("raw_source"))).select("entity_id")),
    "layers_present": _ents(lambda e: Q.layers_present(e.select(F.col("file").alias("path")))),
    "layer_flows": _both(Q.layer_flows),
    "layer_violations": _both(Q.layer_violations),
    "ownership_tally": lambda s, d: Q.ownership(A.tables(s, d, "conversations")["conversations"].select(F.concat(F.lit("c"), (F.col("conv_id") % 50).cast("string")).alias("file"), F.col("role").alias("author"))),
    "project_brief": lambda s, d: Q.brief(A.files(s, d), A.entities(s, d).withColumn("embedding", F.lit(None).cast("array<float>")), A.edges(s, d)),
    "index_status": files_figures,
    "list_files": lambda s, d: Q.listed_files(A.entities(s, d).groupBy(F.col("file").alias("path"), "language").agg(F.max("end_line").alias("loc")), A.entities(s, d), "python"),
    "unsummarized_batch": _ents(Q.unsummarized),
    "neighbour_counts": _both(lambda r, e: Q.neighbour_counts(r, e.where("type = 'function'"))),
    "read_baseline_tokens": read_baseline,
    "context_pack": context_pack,
    "token_estimate": lambda s, d: A.tables(s, d, "documents")["documents"].select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"), T.truncated(F.col("text"), 5).alias("head")),
}

_LAYER = {k: ", ".join(f"'{x}'" for x in v) for k, v in Q.LAYERS.items()}
_LAYER_CASE = "CASE " + " ".join(f"WHEN lower(x) IN ({v}) THEN '{k}'" for k, v in _LAYER.items()) + " ELSE 'other' END"
_LAYERED = f"""layered AS (SELECT f, coalesce((SELECT min_by(k, i) FROM (SELECT i, {_LAYER_CASE} AS k FROM (SELECT unnest(list_slice(string_split(f, '/'), 1, len(string_split(f, '/')) - 1)) AS x, unnest(range(len(string_split(f, '/')) - 1)) AS i)) WHERE k <> 'other'), 'other') AS layer,
  coalesce((SELECT min_by(p, i) FROM (SELECT i, p, {_LAYER_CASE} AS k FROM (SELECT unnest(list_slice(string_split(f, '/'), 1, len(string_split(f, '/')) - 1)) AS x, unnest(range(len(string_split(f, '/')) - 1)) AS i), LATERAL (SELECT array_to_string(list_slice(string_split(f, '/'), 1, i + 1), '/') AS p)) WHERE k <> 'other'), CASE WHEN contains(f, '/') THEN split_part(f, '/', 1) ELSE '.' END) AS dir FROM (SELECT DISTINCT file AS f FROM entities))"""
_DECISIONS = r"len(regexp_extract_all(raw_source, '\b(?:if|elif|for|while|and|or|except|case|catch)\b|&&|\|\|'))"
_FILE_IMPORTS = "imp AS (SELECT DISTINCT a.file AS src_file, b.file AS dst_file FROM edges e JOIN entities a ON e.src_id = a.entity_id JOIN entities b ON e.dst_id = b.entity_id WHERE e.type = 'imports' AND a.file <> b.file)"
_DEGREE = "deg AS (SELECT entity_id, count(*) AS degree FROM (SELECT src_id AS entity_id FROM edges UNION ALL SELECT dst_id FROM edges WHERE dst_id <> src_id) GROUP BY 1)"
_GOD = "SELECT 'god-class' AS kind, e.entity_id, e.name, e.file, e.start_line AS line, c.n::BIGINT AS metric, 5::BIGINT AS threshold FROM entities e JOIN (SELECT parent_id, count(*) AS n FROM entities GROUP BY 1) c ON c.parent_id = e.entity_id WHERE e.type = 'class' AND c.n > 5"
_LARGE = "SELECT 'large-class' AS kind, entity_id, name, file, start_line AS line, (end_line - start_line + 1)::BIGINT AS metric, 500::BIGINT AS threshold FROM entities WHERE type = 'class' AND end_line - start_line + 1 > 500"
_COUPLING = "SELECT 'high-coupling' AS kind, file AS entity_id, file AS name, file, NULL::INT AS line, n::BIGINT AS metric, 8::BIGINT AS threshold FROM (SELECT a.file, count(DISTINCT dst_id) AS n FROM edges e JOIN entities a ON a.entity_id = e.src_id WHERE e.type = 'imports' GROUP BY 1) WHERE n > 8"
_COMPLEX = f"SELECT 'complex-function' AS kind, entity_id, name, file, start_line AS line, (1 + {_DECISIONS})::BIGINT AS metric, 15::BIGINT AS threshold FROM entities WHERE type IN ('function', 'method') AND raw_source IS NOT NULL AND 1 + {_DECISIONS} > 15"
_REGISTERED = "(raw_source LIKE '@app.command()%')"
_DEAD = "SELECT entity_id, type, name, file, start_line FROM entities e WHERE type IN ({}) AND language NOT IN ('css', 'html') AND NOT coalesce(" + _REGISTERED + ", false) AND name NOT IN ('main', '__main__') AND NOT starts_with(name, 'test_') AND NOT EXISTS (SELECT 1 FROM edges r WHERE r.dst_id = e.entity_id AND r.type IN ('calls', 'imports'))"
_TOK = "CASE WHEN coalesce(length({0}), 0) > 0 THEN greatest(1, length({0}) // 4) ELSE 0 END::BIGINT"
_HOT = "SELECT entity_id, name, file, fan_in FROM (SELECT dst_id, count(*) AS fan_in FROM edges WHERE type = 'calls' AND NOT starts_with(dst_id, 'external:') AND NOT starts_with(dst_id, 'route:') AND NOT starts_with(dst_id, 'wildcard:') GROUP BY 1 ORDER BY fan_in DESC, dst_id LIMIT 8) h JOIN entities ON dst_id = entity_id"
_ENTRY = "SELECT src_id AS route, dst_id AS handler FROM edges WHERE starts_with(src_id, 'route:') ORDER BY 1, 2 LIMIT 8"
_REACH_BACK = "walk AS (SELECT min(dst_id) AS node, 0 AS dist FROM edges WHERE type = 'calls' AND dst_id LIKE 'py:%' UNION SELECT e.src_id, w.dist + 1 FROM walk w JOIN edges e ON e.dst_id = w.node AND e.type = 'calls' WHERE w.dist < 2), near AS (SELECT node, min(dist) AS dist FROM walk GROUP BY 1)"
_REACH = "walk AS (SELECT max(src_id) AS node, 0 AS dist FROM edges WHERE type = 'calls' AND src_id LIKE 'py:%' UNION SELECT e.dst_id, w.dist + 1 FROM walk w JOIN edges e ON e.src_id = w.node AND e.type IN ('calls', 'imports') JOIN entities t ON t.entity_id = e.dst_id WHERE w.dist < 2), near AS (SELECT node, min(dist) AS dist FROM walk GROUP BY 1)"

SQL = {
    "impact_callers": A.with_sql("SELECT DISTINCT e.dst_id AS callee, e.src_id AS caller, n.dist + 1 AS dist FROM near n JOIN edges e ON e.dst_id = n.node AND e.type = 'calls'", _REACH_BACK),
    "deps_bfs": A.with_sql("SELECT e.src_id AS parent, e.dst_id AS child, e.type, e.line, n.dist + 1 AS dist, CASE WHEN t.entity_id IS NOT NULL THEN 'entity' WHEN starts_with(e.dst_id, 'wildcard:') THEN 'wildcard' WHEN starts_with(e.dst_id, 'external:') THEN 'external' ELSE 'unresolved' END AS kind FROM near n JOIN edges e ON e.src_id = n.node AND e.type IN ('calls', 'imports') LEFT JOIN entities t ON t.entity_id = e.dst_id", _REACH),
    "shortest_path": A.with_sql(
        "SELECT min(path) AS path FROM walk WHERE node = (SELECT max(dst_id) FROM edges WHERE src_id LIKE 'py:%' AND dst_id LIKE 'py:%' AND type = 'calls') AND hops = (SELECT min(hops) FROM walk WHERE node = (SELECT max(dst_id) FROM edges WHERE src_id LIKE 'py:%' AND dst_id LIKE 'py:%' AND type = 'calls')) HAVING count(*) > 0",
        "hop AS (SELECT DISTINCT src_id, dst_id FROM edges WHERE type = 'calls' AND NOT starts_with(dst_id, 'external:'))",
        "walk AS (SELECT (SELECT min(src_id) FROM edges WHERE src_id LIKE 'route:%') AS node, (SELECT min(src_id) FROM edges WHERE src_id LIKE 'route:%') AS path, 0 AS hops UNION ALL SELECT h.dst_id, min(w.path || ' > ' || h.dst_id), w.hops + 1 FROM walk w JOIN hop h ON h.src_id = w.node WHERE w.hops < 7 GROUP BY h.dst_id, w.hops)",
    ),
    "path_labels": A.with_sql("SELECT pos::INT AS pos, node, coalesce(name || ' (' || file || ':' || start_line || ')', node) AS label FROM (SELECT 0 AS pos, src_id AS node FROM edges WHERE src_id LIKE 'route:%' UNION ALL SELECT 1, dst_id FROM edges WHERE src_id LIKE 'route:%') LEFT JOIN entities ON entity_id = node"),
    "file_import_graph": A.with_sql("SELECT * FROM imp", _FILE_IMPORTS),
    "scc_cycles": A.with_sql("SELECT DISTINCT string_agg(b, ',' ORDER BY b) AS members FROM (SELECT DISTINCT x.a, x.b FROM r x JOIN r y ON x.a = y.b AND x.b = y.a) GROUP BY a HAVING count(*) > 1", _FILE_IMPORTS, "r AS (SELECT src_file AS a, dst_file AS b FROM imp UNION SELECT r.a, i.dst_file FROM r JOIN imp i ON i.src_file = r.b)"),
    "part_cycles": "WITH RECURSIVE n AS (SELECT count(*) AS n FROM part), w AS (SELECT p_partkey AS a, (p_partkey * 7 + 3) % n AS b, 1 AS s FROM part, n UNION ALL SELECT a, (b * 7 + 3) % n, s + 1 FROM w, n WHERE b <> a), r AS (SELECT a, min(least(a, b)) AS root, max(s) AS size FROM w GROUP BY a) SELECT lpad(root::VARCHAR, 12, '0') AS root, any_value(size)::BIGINT AS size FROM r WHERE size > 1 GROUP BY root",
    "module_graph": A.with_sql("SELECT m.entity_id AS source, t.entity_id AS target, CASE WHEN p.i THEN 'imports' ELSE 'calls' END AS type FROM (SELECT a.file AS sf, b.file AS df, bool_or(e.type = 'imports') AS i FROM edges e JOIN entities a ON e.src_id = a.entity_id JOIN entities b ON e.dst_id = b.entity_id WHERE a.file <> b.file GROUP BY 1, 2) p JOIN entities m ON m.file = p.sf AND (m.type = 'module' OR m.entity_id LIKE 'tbl:nation:%') JOIN entities t ON t.file = p.df AND (t.type = 'module' OR t.entity_id LIKE 'tbl:nation:%')"),
    "entity_graph": A.with_sql("SELECT entity_id, type, name, start_line FROM entities WHERE file = 'api/NATION_0.py'"),
    "entity_graph_edges": A.with_sql("SELECT src_id, dst_id, type, line FROM edges WHERE src_id IN (SELECT entity_id FROM entities WHERE file = 'api/NATION_0.py')"),
    "entity_context": A.with_sql(f"SELECT DISTINCT 'depends_on' AS direction, dst_id AS neighbour FROM edges WHERE src_id = '{_NATION}' AND type IN ('calls', 'imports') UNION SELECT 'called_by', src_id FROM edges WHERE dst_id = '{_NATION}' AND type = 'calls'"),
    "hot_paths": A.with_sql(_HOT),
    "entry_points": A.with_sql(_ENTRY),
    "rag_degree": A.with_sql("SELECT * FROM deg", _DEGREE),
    "rag_neighbors": A.with_sql("SELECT DISTINCT n AS entity_id FROM (SELECT dst_id AS n FROM edges JOIN s ON s.entity_id = src_id WHERE type IN ('calls', 'imports') UNION SELECT src_id FROM edges JOIN s ON s.entity_id = dst_id WHERE type IN ('calls', 'imports')) WHERE n IN (SELECT entity_id FROM entities)", "s AS (SELECT entity_id FROM entities WHERE type = 'class' AND name < 'NATION_2')"),
    "outbound_lists": A.with_sql("SELECT src_id AS entity_id, string_agg(dst_id, ',' ORDER BY line, dst_id) AS targets FROM (SELECT src_id, dst_id, min(line) AS line FROM edges WHERE type = 'calls' AND src_id IN (SELECT entity_id FROM entities WHERE type = 'method') GROUP BY 1, 2) GROUP BY 1"),
    "representatives": A.with_sql("SELECT dir, entity_id, degree FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY degree DESC, entity_id) AS n FROM (SELECT CASE WHEN contains(file, '/') THEN split_part(file, '/', 1) ELSE '.' END AS dir, e.entity_id, coalesce(degree, 0) AS degree FROM entities e LEFT JOIN deg USING (entity_id))) WHERE n <= 3", _DEGREE),
    "god_class": A.with_sql(_GOD),
    "large_class": A.with_sql(_LARGE),
    "high_coupling": A.with_sql(_COUPLING),
    "complex_function": A.with_sql(_COMPLEX),
    "smells_ranked": A.with_sql(f"SELECT *, round(metric::DOUBLE / threshold, 6) AS severity FROM ({_GOD} UNION ALL {_LARGE} UNION ALL {_COUPLING} UNION ALL {_COMPLEX})"),
    "dead_code": A.with_sql(_DEAD.format("'function', 'class'")),
    "dead_code_methods": A.with_sql(_DEAD.format("'function', 'class', 'method'")),
    "decorator_registered": A.with_sql(f"SELECT entity_id FROM entities WHERE {_REGISTERED}"),
    "layers_present": A.with_sql("SELECT DISTINCT layer, dir FROM layered", _LAYERED),
    "layer_flows": A.with_sql("SELECT a.layer AS src_layer, b.layer AS dst_layer, count(*) AS n FROM imp JOIN layered a ON a.f = src_file JOIN layered b ON b.f = dst_file WHERE a.layer <> b.layer GROUP BY 1, 2", _FILE_IMPORTS, _LAYERED),
    "layer_violations": A.with_sql("SELECT src_file, dst_file, a.layer AS src_layer, b.layer AS dst_layer FROM imp JOIN layered a ON a.f = src_file JOIN layered b ON b.f = dst_file WHERE (a.layer = 'data' AND b.layer IN ('service', 'presentation')) OR (a.layer = 'service' AND b.layer = 'presentation')", _FILE_IMPORTS, _LAYERED),
    "ownership_tally": "SELECT 'c' || conv_id % 50 AS file, role AS author, count(*) AS lines, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY conv_id % 50), 1)::DOUBLE AS percent FROM conversations GROUP BY conv_id % 50, role",
    "index_status": A.with_sql("SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM entities) AS entities, 0::BIGINT AS embedded, (SELECT count(summary) FROM entities) AS summarized, (SELECT count(*) FROM edges) AS edges, 0::BIGINT AS embedded_percent"),
    "list_files": A.with_sql("SELECT file AS path, language, max(end_line) AS loc, count(*) AS entities FROM entities WHERE language = 'python' GROUP BY 1, 2"),
    "unsummarized_batch": A.with_sql("SELECT entity_id, (SELECT count(*) FROM entities WHERE type IN ('function', 'class', 'method', 'interface') AND summary IS NULL) AS remaining FROM entities WHERE type IN ('function', 'class', 'method', 'interface') AND summary IS NULL ORDER BY 1 LIMIT 20"),
    "neighbour_counts": A.with_sql("SELECT entity_id, coalesce(a.n, 0) AS callers, coalesce(b.n, 0) AS callees FROM entities LEFT JOIN (SELECT dst_id, count(DISTINCT src_id) AS n FROM edges WHERE type = 'calls' GROUP BY 1) a ON a.dst_id = entity_id LEFT JOIN (SELECT src_id, count(DISTINCT dst_id) AS n FROM edges WHERE type = 'calls' GROUP BY 1) b ON b.src_id = entity_id WHERE type = 'function'"),
    "read_baseline_tokens": A.with_sql(f"SELECT sum({_TOK.format('raw_source')})::BIGINT AS tokens FROM entities WHERE file IN (SELECT file FROM entities WHERE type = 'class')"),
    "token_estimate": f"SELECT doc_id, {_TOK.format('text')} AS tokens, substring(text, 1, 20) AS head FROM documents",
}
SQL["project_brief"] = A.with_sql(
    "SELECT 'count' AS section, 'files' AS key, (SELECT count(*) FROM files)::VARCHAR AS value UNION ALL SELECT 'count', 'entities', (SELECT count(*) FROM entities)::VARCHAR UNION ALL SELECT 'count', 'edges', (SELECT count(*) FROM edges)::VARCHAR "
    "UNION ALL SELECT 'language', language, count(*)::VARCHAR FROM files GROUP BY language "
    "UNION ALL SELECT 'layer', 'other', string_agg(d, ',' ORDER BY d) FILTER (WHERE n <= 6) || CASE WHEN max(n) > 6 THEN ',+' || (max(n) - 6) ELSE '' END FROM (SELECT d, row_number() OVER (ORDER BY d) AS n FROM (SELECT DISTINCT split_part(path, '/', 1) AS d FROM files)) "
    f"UNION ALL SELECT 'hot', entity_id, fan_in::VARCHAR FROM ({_HOT}) UNION ALL SELECT 'entry', route, handler FROM ({_ENTRY})"
)
