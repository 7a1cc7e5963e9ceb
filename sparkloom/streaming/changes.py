"""Change streams: filter, debounce, apply, and quarantine, for batch and streaming DataFrames alike.

Events have path, action (created, modified, deleted, moved), dest (of moves) and ts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..ship import ship
from ..sources import walk

#: Failures in a row after which a path is left alone.
QUARANTINE = 3


def relevant(events: DataFrame, rules: list[tuple[str, bool]] = []) -> DataFrame:  # noqa: B006
    """Events of source files outside excluded and ignored places; moves become a deletion and a modification."""
    pairs = F.when(F.col("action") == "moved", F.array(F.struct(F.col("path").alias("p"), F.lit("deleted").alias("a")), F.struct(F.col("dest").alias("p"), F.lit("modified").alias("a")))).otherwise(F.array(F.struct(F.col("path").alias("p"), F.when(F.col("action") == "deleted", "deleted").otherwise("modified").alias("a"))))
    out = events.select("ts", F.explode(pairs).alias("x")).select("ts", F.col("x.p").alias("path"), F.col("x.a").alias("action"))
    return walk.kept_paths(out, rules)


def debounced(events: DataFrame, gap: str = "300 milliseconds", delay: str | None = None) -> DataFrame:
    """(path, action, first, last, n): events of a path closer than gap are one, and its last action counts.

    delay sets the watermark that streams need; ties of time go by the action's name.
    """
    if delay:
        events = events.withWatermark("ts", delay)
    g = events.groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.max(F.struct("ts", "action")).alias("x"), F.min("ts").alias("first"), F.count(F.lit(1)).alias("n"))
    return g.select("path", F.col("x.action").alias("action"), "first", F.col("x.ts").alias("last"), "n")


def applied(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a stream of changes into apply(batch, id); a batch that was applied isn't again after a restart."""
    last: dict[str, int] = {"id": -1}

    def once(batch: DataFrame, number: int) -> None:
        if number > last["id"] and not batch.isEmpty():
            apply(batch, number)
        last["id"] = max(last["id"], number)

    return changes.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def quarantine(results: DataFrame, most: int = QUARANTINE) -> DataFrame:
    """(path, seq, failures, quarantined) of results (path, seq, ok, action): failures in a row; a success or deletion starts anew."""
    w = Window.partitionBy("path").orderBy("seq")
    good = F.col("ok") | (F.col("action") == "deleted")
    islands = results.withColumn("island", F.sum(good.cast("int")).over(w))
    run = Window.partitionBy("path", "island").orderBy("seq")
    n = F.sum((~good).cast("int")).over(run).cast("long")
    return islands.select("path", "seq", n.alias("failures"), (n >= most).alias("quarantined"))


def quarantine_stream(results: DataFrame, most: int = QUARANTINE) -> DataFrame:
    """The same for a stream, with the count of each path as its state."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for d in parts:
            rows = []
            for seq, ok, action in d.sort_values("seq")[["seq", "ok", "action"]].itertuples(index=False):
                n = 0 if ok or action == "deleted" else n + 1
                rows.append((key[0], seq, n, n >= most))
            yield pd.DataFrame(rows, columns=["path", "seq", "failures", "quarantined"])
        state.update((n,))

    ship(results.sparkSession)
    out = "path string, seq long, failures long, quarantined boolean"
    return results.groupBy("path").applyInPandasWithState(step, out, "n long", "append", GroupStateTimeout.NoTimeout)


def change_log(changes: DataFrame, counts: DataFrame) -> DataFrame:
    """(path, action, n_entities, error) of changes joined with what applying them gave (path, n_entities, error)."""
    return changes.join(counts, "path", "left").select("path", "action", F.coalesce("n_entities", F.lit(0)).alias("n_entities"), "error")
