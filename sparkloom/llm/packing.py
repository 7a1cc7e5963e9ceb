"""Packing documents into sequences of bounded length by swap-based local search."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, prepare, text_or_empty, written
from .tokens import word_ids

#: Pieces packed together in one task; a block ends with one underfull sequence or so.
BLOCK = 8192


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of the pieces of each row of docs: its ids and end_id, cut every `capacity`."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    last = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for b in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = words.of(text) + last
                for k, j in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[j : j + 4 * capacity]
                    at.append(i)
                    piece.append(k)
                    start.append(j // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            cols = [b.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = only(docs, ["doc_id", "text"]).select("doc_id", text_or_empty().alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Bins of items (their sizes), first filled best-fit, largest first, then improved by exchanges."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.items: list[list[int]] = []
        self.fill: list[int] = []
        free: list[tuple[int, int]] = []  # (room, bin) of bins with room
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            k = bisect_right(free, (sizes[i], -1))
            if k < len(free):
                room, b = free.pop(k)
            else:
                room, b = capacity, len(self.items)
                self.items.append([])
                self.fill.append(0)
            self.items[b].append(i)
            self.fill[b] += sizes[i]
            if room > sizes[i]:
                insort(free, (room - sizes[i], b))

    def squares(self) -> int:
        return sum(f * f for f in self.fill)

    def improve(self) -> None:
        """Exchanges between underfull bins until none makes the sum of squared fills larger.

        Bins are taken from the fullest down; each gains from bins that are no
        fuller: an item moved, one exchanged for a larger one, or two that stand in
        one bin for one smaller than both together. Every exchange makes a fuller bin
        fuller, so the sum grows and the emptiest bins become empty.
        """
        changed = True
        while changed:
            changed = False
            order = sorted((b for b in range(len(self.items)) if 0 < self.fill[b] < self.capacity), key=lambda b: (-self.fill[b], b))
            if len(order) < 2:
                return
            pool = sorted((self.sizes[i], i) for b in order for i in self.items[b])
            of = {i: b for b in order for i in self.items[b]}
            pairs = sorted(p for b in order for p in self._pairs(b))
            for a in order:
                while self.fill[a] < self.capacity:
                    best = self._best(a, pool, pairs, of)
                    if best is None:
                        break
                    _, give, take = best
                    b = of[take[0]]
                    for i in take:
                        self.items[b].remove(i)
                        self.items[a].append(i)
                        of[i] = a
                    for i in give:
                        self.items[a].remove(i)
                        self.items[b].append(i)
                        of[i] = b
                    d = sum(self.sizes[i] for i in take) - sum(self.sizes[i] for i in give)
                    self.fill[a] += d
                    self.fill[b] -= d
                    changed = True
        return

    def _pairs(self, b: int) -> Iterator[tuple[int, int, int]]:
        """Two items of a bin for each two sizes in it: (their sum, item, item). Sizes add up to `capacity` at most, so few of them differ."""
        by: dict[int, list[int]] = {}
        for i in self.items[b]:
            by.setdefault(self.sizes[i], []).append(i)
        sizes = sorted(by)
        for k, x in enumerate(sizes):
            if len(by[x]) > 1:
                yield 2 * x, by[x][0], by[x][1]
            for y in sizes[:k]:
                yield x + y, by[x][0], by[y][0]

    def _best(self, a: int, pool: list, pairs: list, of: dict) -> tuple[int, list[int], list[int]] | None:
        """The exchange that fills bin a most: (gain, items to give, items to take)."""
        room, best = self.capacity - self.fill[a], None
        for x in [None, *self.items[a]]:
            own = 0 if x is None else self.sizes[x]
            give = [] if x is None else [x]
            least = own + (best[0] if best else 0)
            for listed, size in ((pool, 1), (pairs, 2)):
                if x is None and size == 2:
                    continue
                k = bisect_right(listed, (own + room, 1 << 60))
                while k:
                    k -= 1
                    total, *take = listed[k]
                    if total <= least:
                        break
                    b = of[take[0]]
                    if b != a and self.fill[b] <= self.fill[a] and all(of[i] == b for i in take):
                        best = (total - own, give, take)
                        least = total
                        break
                if best and best[0] == room:
                    return best
        return best


def pack_block(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items of each sequence of a block."""
    bins = Bins(sizes, capacity)
    bins.improve()
    return [x for x in bins.items if x]


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, block: int = BLOCK) -> DataFrame:
    """The pieces of docs with sequence_id and offset: sequences of at most `capacity` tokens, as few as the search finds.

    A document is its ids followed by end_id; only one longer than `capacity` is
    cut. A null or empty text is end_id alone. Repeated rows are packed as often as
    they are there; equal lengths are taken in the order of doc_id and piece; other
    columns are left out; no rows give none; very long texts are many pieces. Pieces
    are dealt out to blocks of about `block` by a hash of their row number in the
    table they are written to first, so blocks are even whatever the data; each is
    packed in one task.
    """
    rows, _ = written(pieces(docs, path, capacity, end_id), "pieces")
    blocks = max(1, -(-rows.count() // block))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.select(names).sort_by([(c, "ascending") for c in ("doc_id", "piece", "ids_crc32")])
        sizes = t.column("length").to_pylist()
        seq, off = [0] * len(sizes), [0] * len(sizes)
        for s, items in enumerate(pack_block(sizes, capacity)):
            at = 0
            for i in sorted(items):
                seq[i], off[i] = (key[0].as_py() << 32) + s, at
                at += sizes[i]
        return t.append_column("sequence_id", pa.array(seq, pa.int64())).append_column("offset", pa.array(off, pa.int64()))

    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
