"""Benchmark decontamination by greedy string tiling with running Karp-Rabin matching."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, prepare, text_or_empty

#: Words of the benchmark sent to executors at once; a larger benchmark goes in blocks, each against all documents.
BLOCK_WORDS = 1_000_000
#: Window length with which the search for tiles begins.
FIRST = 32
_M = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def _grams(ids: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each window of k ids."""
    h = np.zeros(max(0, len(ids) - k + 1), np.uint64)
    for i in range(k):
        h = (h ^ ids[i : i + len(h)].astype(np.uint64)) * _M
        h ^= h >> np.uint64(29)
    return h


def tiles(p: list[int], t: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of pattern p and text t: (place in p, place in t, length), the longest first.

    Non-overlapping matches of `least` words or more; negative words match nothing.
    Each round looks for matches of at least `s` words among what is not marked yet:
    windows of the pattern by their rolling hash, compared word by word and
    lengthened as far as they go. One over 2s starts again with its length; else
    the matches are marked, longest first, earliest in the pattern and then in the
    text; of one that meets a tile, what is left goes back among the others. Then s
    is halved, down to `least`.
    """
    mark_p, mark_t = [x < 0 for x in p], [x < 0 for x in t]
    out, s = [], max(least, min(FIRST, len(p)))
    while True:
        found = [(-n, i, j) for i, j, n in _matches(p, t, mark_p, mark_t, s)]
        longest = max((-n for n, _, _ in found), default=0)
        if longest > 2 * s:
            s = longest
            continue
        heapify(found)
        while found:
            n, i, j = heappop(found)
            free = [k for k in range(-n) if not mark_p[i + k] and not mark_t[j + k]]
            if len(free) == -n:
                mark_p[i : i - n] = mark_t[j : j - n] = [True] * -n
                out.append((i, j, -n))
                continue
            for k, g in groupby(enumerate(free), lambda x: x[1] - x[0]):  # what other tiles have left of it
                part = [x for _, x in g]
                if len(part) >= s:
                    heappush(found, (-len(part), i + part[0], j + part[0]))
        if s <= least:
            return out
        s = max(least, s // 2)


def _matches(p: list[int], t: list[int], mark_p: list[bool], mark_t: list[bool], s: int) -> list[tuple[int, int, int]]:
    """Maximal matches of s unmarked words or more."""
    at: dict[int, list[int]] = {}
    for i, h in _rolled(p, mark_p, s):
        at.setdefault(h, []).append(i)
    out, reached = [], {}
    for j, h in _rolled(t, mark_t, s):
        for i in at.get(h, ()):
            if reached.get(i - j, -1) >= j + s:  # inside a match already lengthened
                continue
            n = 0
            while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and not mark_p[i + n] and not mark_t[j + n]:
                n += 1
            if n >= s:
                out.append((i, j, n))
                reached[i - j] = j + n
    return out


def _rolled(x: list[int], mark: list[bool], s: int) -> Iterator[tuple[int, int]]:
    """(place, hash) of each window of s unmarked words; the hash rolls on by one word."""
    base, mod = 1_000_003, (1 << 61) - 1
    top = pow(base, s, mod)
    h = run = 0
    for i, w in enumerate(x):
        if mark[i]:
            h = run = 0
            continue
        h = (h * base + w + 1) % mod
        run += 1
        if run > s:
            h = (h - (x[i - s] + 1) * top) % mod
        if run >= s:
            yield i - s + 1, h


def _spans(hashes: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of g begins in sorted hashes, and how often it stands there."""
    low = np.searchsorted(hashes, g, "left")
    return low, np.searchsorted(hashes, g, "right") - low


def _expanded(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


@dataclass
class Tests:
    """A bounded block of benchmark items, ready for seeding."""

    ids: list
    words: dict[bytes, int]
    items: list[np.ndarray]
    least: list[int]  # shortest tile of each item
    seeds: dict[int, tuple[np.ndarray, ...]]  # by seed length: sorted hashes, item, place; and the different pairs of the first two

    @classmethod
    def of(cls, rows: list[tuple[object, bytes]], least: int) -> Tests:
        words: dict[bytes, int] = {}
        ids, items, short, seeds = [], [], [], {}
        for key, text in rows:
            own = [words.setdefault(w, len(words)) for w in words_of(text)]
            if own:
                ids.append(key)
                items.append(np.array(own, np.int64))
                short.append(min(least, len(own)))
        for k in set(short):
            h, item, place = [], [], []
            for n, own in enumerate(items):
                if short[n] == k:
                    g = _grams(own, k)
                    h.append(g)
                    item.append(np.full(len(g), n))
                    place.append(np.arange(len(g)))
            h, item, place = map(np.concatenate, (h, item, place))
            order = np.argsort(h, kind="stable")
            h, item, place = h[order], item[order], place[order]
            once = np.append(True, (h[1:] != h[:-1]) | (item[1:] != item[:-1])) if len(h) else np.zeros(0, bool)
            seeds[k] = h, item, place, h[once], item[once]
        return cls(ids, words, items, short, seeds)

    def found(self, text: bytes, coverage: float) -> list[tuple[int, float, list[tuple[int, int, int]]]]:
        """(item, share of its words in tiles, tiles with places in the text's words) for items covered enough."""
        w = words_of(text)
        ids = np.fromiter((self.words.get(x, -1) for x in w), np.int64, len(w))
        out = []
        known = np.concatenate([[0], np.cumsum(ids < 0)])
        for k, (hashes, item, place, each, of) in self.seeds.items():
            if len(ids) < k:
                continue
            full = np.flatnonzero(known[k:] == known[:-k])  # windows of benchmark words only
            if not len(full):
                continue
            g = _grams(ids, k)[full]
            low, n = _spans(each, g)
            hit = np.flatnonzero(n)
            if not len(hit):
                continue
            seed, where = _expanded(low[hit], n[hit]), np.repeat(full[hit], n[hit])
            low, n = _spans(hashes, np.unique(g[hit]))
            places = _expanded(low, n)  # of an item's repeats, once each, however often the text repeats them
            inside = {int(i): place[places[item[places] == i]] for i in np.unique(item[places])} if len(places) else {}
            by = np.argsort(of[seed], kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(of[seed][by])) + 1):
                i = int(of[seed[part[0]]])
                p = self.items[i]
                reach = np.zeros(len(p), bool)
                for o in range(k):
                    reach[inside[i] + o] = True
                if reach.sum() < coverage * len(p):  # no tiling can cover more
                    continue
                at = np.unique((np.unique(where[part])[:, None] + np.arange(k)).ravel())
                gap = np.flatnonzero(np.diff(at) > 1) + 1
                t = np.insert(ids[at], gap, -1)
                real = np.insert(at, gap, -1)
                got = tiles(p.tolist(), t.tolist(), k)
                share = sum(m for _, _, m in got) / len(p)
                if share >= coverage:
                    out.append((i, share, [(a, int(real[b]), m) for a, b, m in got]))
        return sorted(out, key=lambda x: x[0])


def _blocks(benchmark: DataFrame, least: int) -> Iterator[Tests]:
    """The benchmark in blocks of about BLOCK_WORDS words; their number follows from a count, so what is collected at once is bounded."""
    t = only(benchmark, ["item_id", "text"]).select("item_id", text_or_empty().alias("text"))
    words = t.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-words // (6 * BLOCK_WORDS)))
    for i in range(n):
        part = t if n == 1 else t.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield Tests.of([(r.item_id, r.text.encode()) for r in part.collect()], least)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.6) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest, first_word, contaminated) for each document and item whose tiles cover enough of the item.

    A tile is a run of `least` lower-cased words or more (the whole item if it is
    shorter) that stands in both; tiles don't overlap, and their order is free, so
    reordered passages count. `coverage` is the share of the item's words that must
    lie in tiles. Null or empty texts match nothing; repeated rows and repeated
    items come back as often as they are there; empty tables give no rows; other
    columns, whatever their names, are left out. A very long text costs as much as
    it has words that stand in runs of the benchmark, however often they repeat.
    """
    prepare(docs.sparkSession)
    rows = only(docs, ["doc_id", "text"]).select("doc_id", text_or_empty().cast("binary").alias("text"))
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    out = None
    for tests in _blocks(benchmark, least):
        sent = docs.sparkSession.sparkContext.broadcast(tests)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            tests = sent.value
            for b in batches:
                at, item, share, n, longest, first = [], [], [], [], [], []
                for i, text in enumerate(b.column(1).to_pylist()):
                    for k, c, got in tests.found(text, coverage):
                        at.append(i)
                        item.append(tests.ids[k])
                        share.append(c)
                        n.append(len(got))
                        longest.append(max(m for _, _, m in got))
                        first.append(min(j for _, j, _ in got))
                if at:
                    cols = [b.column(0).take(pa.array(at, pa.int64())), pa.array(item), pa.array(share, pa.float64()), pa.array(n, pa.int64()), pa.array(longest, pa.int64()), pa.array(first, pa.int64()), pa.array([True] * len(at))]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "coverage", "n_tiles", "longest", "first_word", "contaminated"])

        part = rows.mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, coverage double, n_tiles long, longest long, first_word long, contaminated boolean")
        out = part if out is None else out.unionAll(part)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.6) -> DataFrame:
    """The rows of docs, all columns, in which no item of the benchmark is covered enough (see contaminated)."""
    prepare(docs.sparkSession)
    names = docs.columns
    place = names.index("text")
    out = docs.toDF(*[f"c{i}" for i in range(len(names))])
    for tests in _blocks(benchmark, least):
        sent = docs.sparkSession.sparkContext.broadcast(tests)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not sent.value.found((x or "").encode(), coverage) for x in b.column(place).to_pylist()], pa.bool_()))

        out = out.mapInArrow(run, out.schema)
    return out.toDF(*names)
