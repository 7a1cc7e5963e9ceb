"""The relational test tables as a graph of files, entities and edges, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of lineitem that a task gets when edges are made; each gives up to two edges.
TASK_ROWS = 250_000

_FILE = "CASE n_regionkey WHEN 0 THEN 'api' WHEN 1 THEN 'app/services' WHEN 2 THEN 'models' WHEN 3 THEN 'core' ELSE 'misc' END || '/' || replace(n_name, ' ', '_') || '.py'"
_PART_FILE = "replace(p_brand, '#', '_') || '/' || replace(p_type, ' ', '_') || '.py'"
_PART = f"'py:' || {_PART_FILE} || ':' || replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS STRING)"
_CUSTOMER = f"'py:' || {_FILE} || ':' || n_name || '.' || c_name"
_SUPPLIER = f"'py:' || {_FILE} || ':' || n_name || '.' || s_name"
_NATION = "'tbl:nation:' || n_name"

FILES = """
SELECT lang || '/' || source || '/' || CAST(doc_id AS STRING) || '.txt' AS path, lang AS language, sha256_hex(text) AS hash,
  CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INT) AS loc, CAST(doc_id AS BIGINT) AS indexed
FROM documents
"""

ENTITIES = f"""
SELECT 'tbl:region:' || r_name AS entity_id, 'module' AS type, r_name AS name, r_name AS qualified_name, 'sql' AS language, 'geo/' || r_name || '.sql' AS file,
  1 AS start_line, 10 AS end_line, CAST(NULL AS STRING) AS raw_source, 'Region ' || r_name AS docstring, CAST(NULL AS STRING) AS signature,
  true AS is_exported, CAST(NULL AS STRING) AS parent_id, CAST(NULL AS STRING) AS summary FROM region
UNION ALL
SELECT {_NATION}, 'class', n_name, n_name, 'python', {_FILE}, 1, 380 + 20 * CAST(n_nationkey AS INT), 'class ' || n_name || ':' || chr(10) || '    pass',
  CAST(NULL AS STRING), 'class ' || n_name, true, 'tbl:region:' || r_name, CASE WHEN n_nationkey % 2 = 0 THEN 'A nation' END FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT {_CUSTOMER}, 'method', c_name, n_name || '.' || c_name, 'python', {_FILE}, CAST(c_custkey % 900 + 2 AS INT), CAST(c_custkey % 900 + 2 + c_custkey % 60 AS INT),
  'def ' || c_name || '(self):' || chr(10) || repeat('    if a and b:' || chr(10), CAST(c_custkey % 12 AS INT)) || '    balance = 1', 'In segment ' || c_mktsegment,
  'def ' || c_name || '(self, n: ' || n_name || ')', c_custkey % 5 <> 0, {_NATION}, CAST(NULL AS STRING) FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL
SELECT {_SUPPLIER}, 'method', s_name, n_name || '.' || s_name, 'python', {_FILE}, CAST(s_suppkey % 900 + 2 AS INT), CAST(s_suppkey % 900 + 8 AS INT),
  'def ' || s_name || '(self): return ' || n_name, CAST(NULL AS STRING), 'def ' || s_name || '(self)', true, {_NATION}, CAST(NULL AS STRING) FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL
SELECT {_PART}, 'function', replace(p_name, ' ', '_'), replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS STRING), 'python', {_PART_FILE}, CAST(p_partkey % 500 + 1 AS INT), CAST(p_partkey % 500 + 1 + p_size AS INT),
  CASE WHEN p_partkey % 7 = 0 THEN '@app.command()' || chr(10) WHEN p_partkey % 7 = 1 THEN '@cached' || chr(10) ELSE '' END || 'def f():' || chr(10) || repeat('    x = 1 if y or z else 2' || chr(10), p_size % 16),
  CASE WHEN p_size % 3 = 0 THEN 'Part of ' || p_type END, CAST(NULL AS STRING), p_size % 4 <> 0, CAST(NULL AS STRING), CASE WHEN p_partkey % 3 = 0 THEN 'Makes ' || p_name END FROM part
UNION ALL
SELECT 'py:web/pages.py:page_' || CAST(page_id AS STRING), 'function', 'page_' || CAST(page_id AS STRING), 'page_' || CAST(page_id AS STRING), 'python', 'web/pages.py', CAST(page_id * 3 + 1 AS INT), CAST(page_id * 3 + 2 AS INT),
  'def page_' || CAST(page_id AS STRING) || '():' || chr(10) || '    return 1', CAST(NULL AS STRING), CAST(NULL AS STRING), true, CAST(NULL AS STRING), CAST(NULL AS STRING) FROM pages
"""

EDGES = f"""
SELECT src_id, dst_id, type, line, confidence FROM (
SELECT {_CUSTOMER} AS src_id, {_PART} AS dst_id, 'calls' AS type, l_linenumber AS line, 1.0 AS confidence
  FROM (SELECT DISTINCT o_custkey, l_partkey, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey) c
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
UNION ALL
SELECT {_PART}, {_SUPPLIER}, 'calls', l_linenumber, 0.9
  FROM (SELECT DISTINCT l_partkey, l_suppkey, l_linenumber FROM lineitem) c JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
UNION ALL
SELECT 'tbl:nation:' || a.n_name, 'tbl:nation:' || b.n_name, 'imports', 1, 1.0 FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey * 7 + 3) % 25 OR b.n_nationkey = (a.n_nationkey * a.n_nationkey + 1) % 25
UNION ALL
SELECT 'tbl:nation:' || n_name, 'external:lib' || CAST(p_partkey % 40 AS STRING), 'imports', 2 + CAST(p_partkey % 40 AS INT), 0.5 FROM nation JOIN part ON p_partkey % 25 = n_nationkey
UNION ALL
SELECT {_PART}, 'external:size' || CAST(p_size AS STRING), 'calls', 9, 0.5 FROM part
UNION ALL
SELECT 'py:' || replace(a.p_brand, '#', '_') || '/' || replace(a.p_type, ' ', '_') || '.py:' || replace(a.p_name, ' ', '_') || '_' || CAST(a.p_partkey AS STRING),
  'py:' || replace(b.p_brand, '#', '_') || '/' || replace(b.p_type, ' ', '_') || '.py:' || replace(b.p_name, ' ', '_') || '_' || CAST(b.p_partkey AS STRING), 'imports', 3, 1.0
  FROM part a JOIN part b ON b.p_partkey = a.p_partkey * 3 + 1
UNION ALL
SELECT 'route:GET /' || lower(c_mktsegment) || '/' || CAST(c_custkey AS STRING), {_CUSTOMER}, 'calls', 1, 0.7 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'
) e GROUP BY src_id, dst_id, type, line, confidence
"""

#: EDGES without the first two parts of its union, those over lineitem.
_REST = "SELECT src_id, dst_id, type, line, confidence FROM (" + EDGES.split("UNION ALL", 2)[2].replace("'imports', 1, 1.0 FROM", "'imports' AS type, 1 AS line, 1.0 AS confidence FROM", 1).replace("|| a.n_name,", "|| a.n_name AS src_id,", 1).replace("|| b.n_name,", "|| b.n_name AS dst_id,", 1)
_REST = _REST.replace("SELECT 'py:' || replace(a.p_brand", "SELECT /*+ MERGE(b) */ 'py:' || replace(a.p_brand", 1)

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "conversations")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def _spark(spark: SparkSession, sql: str, sf_dir: str) -> DataFrame:
    """The query with its tables bound to the files of sf_dir."""
    import re

    used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", sql)]
    bound = re.sub(rf"\b(FROM|JOIN) ({'|'.join(used)})\b", r"\1 {\2}", sql.replace("sha256_hex(text)", "sha2(text, 256)"))
    return spark.sql(bound, **tables(spark, sf_dir, *used))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(spark, FILES, sf_dir)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(spark, ENTITIES, sf_dir)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EDGES; the two large parts of its union are made distinct where the join with parts has dealt them.

    A part's id ends with its key, so equal edges of a part have equal keys, and no two parts of the union have
    type, line and confidence in common. Ids that are null may be equal for several keys; with one, EDGES runs as it is.
    """
    t = tables(spark, sf_dir, "nation", "customer", "supplier", "part", "orders", "lineitem")
    part = t["part"].select(F.col("p_partkey").alias("key"), F.expr(_PART).alias("part"))
    if not part.where("key is not null and part is null").isEmpty():
        return _spark(spark, EDGES, sf_dir)
    shuffled = lambda df: df.hint("merge")  # noqa: E731  sizes of the larger tables are not known well enough to broadcast
    nation = t["nation"]
    customer = t["customer"].join(nation, F.expr("c_nationkey = n_nationkey")).select("c_custkey", F.expr(_CUSTOMER).alias("other"))
    supplier = t["supplier"].join(nation, F.expr("s_nationkey = n_nationkey")).select("s_suppkey", F.expr(_SUPPLIER).alias("other"))
    orders = t["orders"].join(shuffled(customer), F.expr("o_custkey = c_custkey")).select("o_orderkey", "other")
    line = t["lineitem"]
    into = line.join(shuffled(orders), F.expr("l_orderkey = o_orderkey")).select(F.lit(True).alias("into"), "l_partkey", "other", "l_linenumber")
    out = line.join(shuffled(supplier), F.expr("l_suppkey = s_suppkey")).select(F.lit(False).alias("into"), "l_partkey", "other", "l_linenumber")
    n = max(spark.sparkContext.defaultParallelism, -(-line.count() // TASK_ROWS))
    own = into.unionAll(out).repartition(n, "l_partkey").join(shuffled(part), F.expr("l_partkey = key")).groupBy("l_partkey", "into", "other", "part", "l_linenumber").agg(F.lit(1))
    ends = [F.when(F.col("into"), a).otherwise(F.col(b)).alias(c) for a, b, c in ((F.col("other"), "part", "src_id"), (F.col("part"), "other", "dst_id"))]
    own = own.select(*ends, F.lit("calls").alias("type"), F.col("l_linenumber").alias("line"), F.expr("CASE WHEN into THEN 1.0 ELSE 0.9 END").alias("confidence"))
    return own.unionAll(_spark(spark, _REST, sf_dir))


def with_sql(body: str, *extra: str) -> str:
    """DuckDB SQL over files, entities and edges; only the ones that are named are made."""
    import re

    parts = [f"{n} AS MATERIALIZED ({s.replace('sha256_hex(text)', 'sha256(text)')})" for n, s in (("files", FILES), ("entities", ENTITIES), ("edges", EDGES)) if re.search(rf"\b{n}\b", body + " ".join(extra))]
    return f"WITH RECURSIVE {', '.join([*parts, *extra])} {body}" if parts or extra else body
