"""Embedding inputs, retrieval with graph expansion, and packing of context into token budgets."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..ship import ship
from . import graph, search

BODY = 1500
SIM, DEGREE, RECENT = 0.6, 0.3, 0.1


def embed_input() -> Column:
    """Type and qualified name, signature, docstring, the body's beginning and summary, as far as they are there."""
    there = lambda c: F.nullif(c, F.lit(""))
    head = F.concat_ws(" ", "type", "qualified_name")
    return F.concat_ws("\n", head, there(F.col("signature")), there(F.col("docstring")), there(F.substring("raw_source", 1, BODY)), there(F.col("summary")))


def drifted(entities: DataFrame, force: bool = False) -> DataFrame:
    """(entity_id, text, hash) of entities without a vector or whose input changed since."""
    out = entities.select("entity_id", embed_input().alias("text"), "embedding", "embedding_hash").withColumn("hash", F.sha2("text", 256))
    return out.where(F.lit(force) | F.col("embedding").isNull() | F.col("embedding_hash").isNull() | (F.col("embedding_hash") != F.col("hash"))).select("entity_id", "text", "hash")


def hashed_embedding(texts: list[str], width: int = 64) -> list[list[float]]:
    """A stand-in for a model: signed feature hashing of words, of unit length."""
    import zlib

    out = []
    for t in texts:
        v = np.zeros(width)
        for w in t.lower().split():
            h = zlib.crc32(w.encode())
            v[h % width] += 1 if h >> 31 else -1
        n = np.linalg.norm(v)
        out.append((v / n if n else v).astype("float32").tolist())
    return out


def embedded(inputs: DataFrame, embed: Callable[[list[str]], list[list[float]]] = hashed_embedding, batch: int = 256) -> DataFrame:
    """(entity_id, embedding, embedding_hash) of inputs (entity_id, text, hash), batch by batch on the executors."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            for i in range(0, len(d), batch):
                p = d.iloc[i : i + batch]
                yield pd.DataFrame({"entity_id": p["entity_id"], "embedding": embed(p["text"].tolist()), "embedding_hash": p["hash"]})

    ship(inputs.sparkSession)
    return inputs.select("entity_id", "text", "hash").mapInPandas(run, "entity_id string, embedding array<float>, embedding_hash string")


def retrieve(entities: DataFrame, edges: DataFrame, files: DataFrame, query: list[float], k: int = 15, pool: int = 30) -> DataFrame:
    """(entity_id, via, score): vector seeds and their neighbours by similarity, degree and recency."""
    seeds = search.vector(entities, query, pool)
    near = graph.neighbours(edges, entities, seeds).join(seeds, "entity_id", "left_anti").select("entity_id", F.lit("graph").alias("via"))
    both = seeds.select("entity_id", F.lit("vector").alias("via")).unionAll(near)
    q = F.array(*[F.lit(float(x)) for x in query])
    own = both.join(entities.select("entity_id", "file", T.cosine(F.col("embedding"), q).alias("sim")), "entity_id")
    own = own.join(graph.degrees(edges), "entity_id", "left").join(files.select(F.col("path").alias("file"), F.unix_micros(F.col("indexed_at")).alias("at")), "file", "left")
    own = own.select("entity_id", "via", F.greatest(F.coalesce("sim", F.lit(0.0)), F.lit(0.0)).alias("sim"), F.coalesce("degree", F.lit(0)).alias("degree"), "at")
    bounds = own.agg(F.max("degree").alias("top"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    degree = F.coalesce(F.try_divide(F.log1p("degree"), F.log1p("top")), F.lit(0.0))
    recent = F.coalesce(F.try_divide((F.col("at") - F.col("lo")).cast("double"), (F.col("hi") - F.col("lo")).cast("double")), F.lit(0.0))
    score = F.round(SIM * F.col("sim") + DEGREE * degree + RECENT * recent, 6)
    return own.crossJoin(bounds).select("entity_id", "via", score.alias("score")).orderBy(F.desc("score"), "entity_id").limit(k)  # bounds: one row


def block(entity: str = "") -> Column:
    """An entity as a block of a prompt: header, signature or first lines, docstring, called entities."""
    head = F.format_string("--- [%s] %s (%s:%d-%d)", "entity_id", "type", "file", "start_line", "end_line")
    body = F.when(F.coalesce("signature", F.lit("")) != "", F.trim("signature")).when(F.coalesce("raw_source", F.lit("")) != "", T.preview(F.col("raw_source"), 20, "    ...")).otherwise("(source unavailable)")
    calls = F.when(F.size("targets") > 0, F.concat(F.lit("Calls: "), F.array_join("targets", ", ")))
    return F.concat_ws("\n", head, body, F.nullif(F.trim("docstring"), F.lit("")), calls)


def within_budget(blocks: DataFrame, budget: int, tokens: Column, rank: str = "rank") -> DataFrame:
    """Blocks by rank as long as their tokens fit; the first always stays."""
    total = F.sum(tokens).over(Window.orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("total", total).where((F.col("total") <= budget) | (F.col(rank) == 1))


def packed_context(hits: DataFrame, entities: DataFrame, edges: DataFrame, limit: int = 5, max_tokens: int = 1500) -> DataFrame:
    """(rank, entity_id, file, preview, doc, callers, callees, tokens) of diverse hits (rank, entity_id, file) within a token budget."""
    top = search.diverse(hits, min(max(limit, 1), 10))
    e = entities.select("entity_id", "name", T.preview(F.col("raw_source")).alias("preview"), F.get(T.lines(F.col("docstring")), F.lit(0)).alias("doc"))
    calls = edges.where("type = 'calls'")
    near = lambda at, other, name: calls.join(top.select(F.col("entity_id").alias(at)), at, "left_semi").groupBy(F.col(at).alias("entity_id")).agg(F.slice(F.array_sort(F.collect_set(other)), 1, 8).alias(name))
    rows = top.join(e, "entity_id").join(near("dst_id", "src_id", "callers"), "entity_id", "left").join(near("src_id", "dst_id", "callees"), "entity_id", "left")
    shown = F.to_json(F.struct("entity_id", "file", "preview", "doc", "callers", "callees"))
    rows = rows.withColumn("tokens", T.estimated_tokens(shown)).withColumn("rank", F.row_number().over(Window.orderBy("rank")))
    return within_budget(rows, max(max_tokens, 100), F.col("tokens")).select("rank", "entity_id", "file", "preview", "doc", F.array_join("callers", ",").alias("callers"), F.array_join("callees", ",").alias("callees"), "tokens").orderBy("rank")


def ask(prompts: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """(id, answer) of prompts (id, prompt) by a model that is given."""
    kind = prompts.schema["id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            yield pd.DataFrame({"id": d["id"], "answer": [model(p) for p in d["prompt"]]})

    ship(prompts.sparkSession)
    return prompts.select("id", "prompt").mapInPandas(run, f"id {kind}, answer string")


def savings(read: int, sent: int) -> float | None:
    """How many times the context is smaller than reading the files."""
    return round(read / sent, 1) if sent else None


def capped(limit: int) -> tuple[int, int]:
    """Rows of a file and of tests in `limit` results."""
    return max(2, math.ceil(0.6 * limit)), max(1, limit // 3)
