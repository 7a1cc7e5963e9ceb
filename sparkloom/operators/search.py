"""Literal, fuzzy, vector and fused search over entities, and what ranks results."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

PREFIXES = ("py", "ts", "js", "go", "rs", "java", "rb", "php", "c", "cpp", "kt", "cs", "scala", "sh", "ex", "r", "jl", "hs", "ml", "html", "css", "sql", "tbl", "doc")


def tier(name: Column, doc: Column, query: str) -> Column:
    """100 exact, 80 prefix, 60 within the name, 20 within the docstring, else 0; case is ignored."""
    q, n = F.lit(query.lower()), F.lower(name)
    return F.when(n == q, 100.0).when(n.startswith(q), 80.0).when(n.contains(q), 60.0).when(F.coalesce(F.lower(doc).contains(q), F.lit(False)), 20.0).otherwise(0.0)


def term_hits(terms: list[str], name: Column, file: Column) -> Column:
    """How many terms are a part of the name or path, or stand within the name."""
    parts = F.array_union(T.segments(name), T.segments(file))
    return reduce(lambda a, b: a + b, [F.when(F.array_contains(parts, t) | F.lower(name).contains(t), 1).otherwise(0) for t in terms], F.lit(0))


def literal(entities: DataFrame, query: str, limit: int | None = 20) -> DataFrame:
    """(entity_id, name, file, start_line, score) by name and docstring; several terms that occur together rank higher, tests and generated files lower."""
    terms = T.significant(query)
    q = query.lower()
    n, f = F.col("name"), F.col("file")
    found = F.lower(n).contains(q) | F.coalesce(F.lower("docstring").contains(q), F.lit(False))
    score = tier(n, F.col("docstring"), query)
    if len(terms) >= 2:
        found = reduce(lambda a, b: a | b, [F.lower(n).contains(t) for t in terms], found)
        hits = term_hits(terms, n, f)
        score = score + 15.0 * hits + F.when(hits == len(terms), 10.0).otherwise(0.0)
    if not any(t in ("test", "tests", "spec", "specs", "fixture", "fixtures", "mock", "mocks") for t in T.query_terms(query)):
        score = F.when(T.is_test_path(f), score * 0.3).otherwise(score)
    score = F.when(T.is_generated_path(f), score * 0.4).otherwise(score)
    out = entities.where(found).select("entity_id", "name", "file", "start_line", F.round(score, 6).alias("score")).where("score > 0")
    order = [F.desc("score"), F.length("name"), "name", "entity_id"]
    return out.orderBy(*order).limit(limit) if limit else out


def fuzzy(entities: DataFrame, query: str, most: int = 2, limit: int = 20) -> DataFrame:
    """(entity_id, name, dist) of names within `most` edits."""
    d = F.levenshtein(F.lower("name"), F.lit(query.lower()), most)
    return entities.select("entity_id", "name", d.alias("dist")).where("dist >= 0").orderBy("dist", F.length("name"), "name", "entity_id").limit(limit)


def literal_or_fuzzy(entities: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Literal search; the fuzzy one if that is empty and the query is one term of three characters or more."""
    out = literal(entities, query, limit)
    if len(T.significant(query)) <= 1 and len(query) >= 3 and out.isEmpty():
        return fuzzy(entities, query, 2, limit)
    return out


def vector(vectors: DataFrame, query: list[float], limit: int = 20, key: str = "entity_id", column: str = "embedding") -> DataFrame:
    """(key, sim): exact cosine; null and zero vectors are passed over; equal ones go by key."""
    q = F.array(*[F.lit(float(x)) for x in query])
    sim = F.round(T.cosine(F.col(column), q), 6)
    return vectors.select(key, sim.alias("sim")).where("sim is not null").orderBy(F.desc("sim"), key).limit(limit)


def fused(ranked: dict[str, DataFrame], limit: int = 20, k: int = 60, key: str = "entity_id") -> DataFrame:
    """(key, score, sources) by reciprocal rank fusion of retrievers' (key, rank)."""
    each = [df.select(key, F.lit(name).alias("source"), (F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("s")) for name, df in sorted(ranked.items())]
    all_rows = reduce(DataFrame.unionAll, each)
    out = all_rows.groupBy(key).agg(F.round(F.sum("s"), 6).alias("score"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return out.orderBy(F.desc("score"), key).limit(limit)


def ranks(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """A rank from 1 for the rows of a limited result."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def hybrid(entities: DataFrame, vectors: DataFrame | None, text: str, query: list[float] | None, limit: int = 20, pool: int = 20, k: int = 60) -> DataFrame:
    """Fusion of the literal and the vector search; an empty text or no vector leaves one out."""
    sides = {}
    if text.strip():
        sides["literal"] = ranks(literal(entities, text, pool), F.desc("score"), F.length("name"), "name", "entity_id")
    if query is not None and vectors is not None:
        sides["vector"] = ranks(vector(vectors, query, pool), F.desc("sim"), "entity_id")
    return fused(sides, limit, k)


def lookup(entities: DataFrame, ref: str) -> DataFrame:
    """Entities by id if the text has a known prefix, else by name or qualified name, in the order of files and lines."""
    prefix, colon, _ = ref.partition(":")
    same = F.col("entity_id") == ref if colon and prefix in PREFIXES else (F.col("name") == ref) | (F.col("qualified_name") == ref)
    return entities.where(same).select("entity_id", "name", "file", "start_line").orderBy("file", "start_line", "entity_id")


def confident(hits: DataFrame, query: str) -> DataFrame:
    """(confident): whether some hit has two terms of the query or more; true for shorter queries."""
    terms = T.significant(query)
    if len(terms) < 2:
        return hits.agg(F.lit(True).alias("confident"))
    return hits.agg(F.coalesce(F.max(term_hits(terms, F.col("name"), F.col("file"))) >= 2, F.lit(False)).alias("confident"))


def diverse(hits: DataFrame, limit: int) -> DataFrame:
    """The first hits by rank, at most max(2, 60 %) of a file and max(1, a third) of tests.

    Caps applied one after the other in order of rank give what a greedy pass gives.
    """
    per_file, tests = max(2, math.ceil(0.6 * limit)), max(1, limit // 3)
    n = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("rank"))
    out = hits.withColumn("__test", T.is_test_path(F.col("file")))
    out = out.withColumn("__f", n("file")).where(F.col("__f") <= per_file)
    out = out.withColumn("__t", n("__test")).where(~F.col("__test") | (F.col("__t") <= tests))
    return out.orderBy("rank").limit(limit).drop("__test", "__f", "__t")


def merged(results: DataFrame, limit: int, key: str = "entity_id") -> DataFrame:
    """Round-robin merge of ranked results (query, rank, key): first ranks first, queries in turn, each entity once."""
    first = results.groupBy(key).agg(F.min(F.struct("rank", "query")).alias("at"))
    return first.select(key, F.col("at.rank").alias("rank"), F.col("at.query").alias("query")).orderBy("rank", "query").limit(limit)


def type_usages(entities: DataFrame, name: str, own_id: str, limit: int = 200) -> DataFrame:
    """Entities whose signature names the type."""
    out = entities.where(F.col("signature").rlike(T.words_pattern(name)) & (F.col("entity_id") != own_id))
    return out.select("entity_id", "file", "start_line").orderBy("file", "start_line", "entity_id").limit(limit)


def field_usages(entities: DataFrame, name: str, field: str, limit: int = 100) -> DataFrame:
    """Entities whose source sets the field and names the type."""
    sets = F.col("raw_source").rlike(rf"\b{T.quoted(field)}\s*[:=]") & F.col("raw_source").rlike(T.words_pattern(name))
    return entities.where(sets).select("entity_id", "file", "start_line").orderBy("file", "start_line", "entity_id").limit(limit)
