"""Quality selection by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, prepare, text_or_empty, written

#: Bytes of an n-gram, and buckets of a model (a power of two).
GRAM, BUCKETS = 5, 1 << 20
#: Labelled rows, the smallest by a hash of their doc_id, from which the target model is fitted: a bound on what is broadcast.
TARGETS = 20_000
#: Pseudo-count of either model, and how many standard errors of its counts a bucket's log ratio must exceed to count.
PRIOR, ERRORS = 0.5, 3.0
CHUNK = 1024


def grams(text: bytes) -> np.ndarray:
    """Bucket of each n-gram of bytes of the lower-cased words, one space between."""
    b = np.frombuffer(b" " + b" ".join(text.lower().split()) + b" ", np.uint8).astype(np.uint64)
    n = len(b) - GRAM + 1
    if n < 1 or len(b) <= 2:
        return np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(GRAM):
        h |= b[i : i + n] << np.uint64(8 * i)
    h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS.bit_length() + 1)
    return h.astype(np.int64)


def model(docs: DataFrame, labels: DataFrame, targets: int = TARGETS) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """Counts of all n-grams of target documents and of all documents, by bucket, and the doc_ids of the targets.

    Targets are documents with a label of quality 1 and toxic 0. The counts are
    gathered over all documents: each task sums its own, tasks' sums are added up
    in pieces of the buckets, and only the sums (BUCKETS numbers) reach the driver.
    """
    good = labels.where("quality = 1 and toxic = 0 and doc_id is not null").select("doc_id").distinct()
    good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(targets)
    ids, _ = written(good, "targets")
    rows = docs.join(F.broadcast(ids.withColumn("target", F.lit(True))), "doc_id", "left").select(F.coalesce("target", F.lit(False)).alias("target"), text_or_empty().cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            for target, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                g = grams(text)
                if len(g):
                    np.add.at(sums[1], g, 1)
                    if target:
                        np.add.at(sums[0], g, 1)
        yield from _pieces(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(x, np.int64)
        for k, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["piece", "sums"])

    kind = "piece int, sums binary"
    whole = np.zeros((BUCKETS // CHUNK, 2, CHUNK), np.int64)
    for r in rows.mapInArrow(count, kind).repartition("piece").mapInArrow(add, kind).toLocalIterator():
        whole[r.piece] += np.frombuffer(r.sums, np.int64).reshape(2, CHUNK)
    both = whole.transpose(1, 0, 2).reshape(2, BUCKETS)
    return both[0], both[1], ids


def _pieces(sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    each = sums.reshape(2, -1, CHUNK).transpose(1, 0, 2)
    used = np.flatnonzero(each.any(axis=(1, 2)))
    for i in range(0, len(used), 64):
        part = used[i : i + 64]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([np.ascontiguousarray(each[k]).tobytes() for k in part], pa.binary())], ["piece", "sums"])


def log_weight(g: np.ndarray, target: np.ndarray, raw: np.ndarray, share: float, own: bool) -> float:
    """Log of target over raw likelihood of a document's n-grams, at most 0.

    The document's own counts are left out of both models, so it isn't judged by
    itself. Each bucket's log ratio is shrunk by its standard error, which falls as
    the counts grow: less the more certain it is, to nothing below ERRORS of them.
    Weights over 1 are cut to 1, so that none takes over the sample.
    """
    if not len(g):
        return 0.0
    k, n = np.unique(g, return_counts=True)
    seen, due = target[k] - (n if own else 0) + PRIOR, share * (raw[k] - n) + PRIOR
    ratio = np.log(seen / due)
    ratio *= np.maximum(0, 1 - ERRORS**2 * (1 / seen + share / due) / np.maximum(ratio**2, 1e-12))
    return float(min(0.0, (ratio * n).sum()))


def weighted(docs: DataFrame, labels: DataFrame, targets: int = TARGETS) -> DataFrame:
    """doc_id and log_weight of each row of docs."""
    spark = docs.sparkSession
    prepare(spark)
    docs = only(docs, ["doc_id", "text"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    target, raw, ids = model(docs, only(labels, ["doc_id", "quality", "toxic"]), targets)
    share = float(target.sum() / max(1, raw.sum()))
    sent = spark.sparkContext.broadcast((target.astype(np.float32), raw.astype(np.float32), share))
    rows = docs.join(F.broadcast(ids.withColumn("own", F.lit(True))), "doc_id", "left").select("doc_id", F.coalesce("own", F.lit(False)).alias("own"), text_or_empty().cast("binary").alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, raw, share = sent.value
        for b in batches:
            w = [log_weight(grams(x), target, raw, share, own) for own, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(w, pa.float64())], ["doc_id", "log_weight"])

    return rows.mapInArrow(score, f"doc_id {kind}, log_weight double")


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 17, targets: int = TARGETS) -> DataFrame:
    """The sampled rows: doc_id, log_weight, gumbel_key and kept (true).

    Sampling without replacement in proportion to the weights: the k rows with the
    largest log_weight plus Gumbel noise, which follows from doc_id and seed. k is
    the effective sample size of the weights, the square of their sum over the sum
    of their squares, unless given. A null or empty text weighs 1. Without targets
    all weights are near 1. Repeated rows have the same key and are taken in any
    order; null doc_ids are rows like others; no rows give none; other columns are
    left out.
    """
    scored = weighted(docs, labels, targets)
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 11) + F.lit(0.5)) * F.lit(2.0**-53)
    rows, _ = written(scored.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u))), "weights")
    n, total, squares = rows.agg(F.count(F.lit(1)), F.sum(F.exp("log_weight")), F.sum(F.exp(2 * F.col("log_weight")))).first()
    if not n:
        return rows.withColumn("kept", F.lit(True))
    k = min(n, round(total * total / squares) if k is None else k)
    cut, spare = _kth(rows, k)
    out = rows.where(F.col("gumbel_key") >= cut)
    if spare:  # equal keys at the cut, from repeated rows
        out = rows.where(F.col("gumbel_key") > cut).unionAll(rows.where(F.col("gumbel_key") == cut).limit(spare))
    return out.withColumn("kept", F.lit(True))


def _kth(rows: DataFrame, k: int, bins: int = 4096) -> tuple[float, int]:
    """The k-th largest key, and how many rows with just that key are wanted if not all; by counts in ever finer bins."""
    low, high = rows.agg(F.min("gumbel_key"), F.max("gumbel_key")).first()
    above = 0
    if k <= 0:
        return float("inf"), 0
    while True:
        width = (high - low) / bins
        inside = rows.where((F.col("gumbel_key") >= low) & (F.col("gumbel_key") <= high))
        place = F.least(F.floor((F.col("gumbel_key") - low) / F.lit(width or 1.0)), F.lit(bins - 1)).alias("bin")
        counts = inside.groupBy(place).agg(F.count(F.lit(1)).alias("n"), F.min("gumbel_key").alias("a"), F.max("gumbel_key").alias("b")).orderBy(F.desc("bin")).collect()
        for r in counts:
            if above + r.n >= k:
                break
            above += r.n
        if r.a == r.b:
            return r.a, k - above if above + r.n > k else 0
        low, high = r.a, r.b
