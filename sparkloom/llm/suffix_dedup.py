"""Removal of long repeated byte strings by suffix sorting over shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, prepare, text_or_empty, written
from .induced import MANY, MEMORY, Sorter, Tape, sorted_rows, stored

#: Bytes of the grams of which each window chooses one; a shorter gram makes fewer contexts but more chance matches.
GRAM = 32
#: Bytes of a long text whose windows are chosen at once, and of contexts after which a shard is sorted.
STRIDE, SHARD = 1 << 20, 8 << 20
#: Bytes of one gram's contexts that are compared in memory before they are sorted; beyond, they go to the shard as they come.
HELD = 16 << 20
#: Rows of copies (80 bytes each) up to which they are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 250_000
_P, _C = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
#: Bits of a gram's place in its key: of equal grams the leftmost is chosen, but where the place wraps around.
_BITS = 12
_LOW = np.uint64((1 << _BITS) - 1)


def _chosen(b: np.ndarray, base: int, span: int) -> tuple[np.ndarray, ...]:
    h, step, power = b.astype(np.uint64) + np.uint64(1), 1, _P
    while step < GRAM:
        h = h[:-step] * power + h[step:]
        power = np.uint64(int(power) ** 2 & (1 << 64) - 1)
        step *= 2
    h ^= h >> np.uint64(32)
    h *= _C
    h ^= h >> np.uint64(29)
    m = (h & ~_LOW) | ((np.arange(len(h), dtype=np.uint64) + np.uint64(base)) & _LOW)
    width, done = span - GRAM + 1, 1
    while 2 * done <= width:
        m = np.minimum(m[:-done], m[done:])
        done *= 2
    if done < width:
        m = np.minimum(m[: len(m) - (width - done)], m[width - done :])
    cut = np.flatnonzero(np.diff(m)) + 1
    lo = np.concatenate([[0], cut])
    own, lo, hi = m[lo], lo + base, np.concatenate([cut - 1, [len(m) - 1]]) + base
    return (own >> np.uint64(_BITS)).astype(np.int64), lo, hi, lo + ((own & _LOW).astype(np.int64) - lo) % (1 << _BITS)


def runs(text: bytes, span: int) -> tuple[np.ndarray, ...]:
    """(hash, lo, hi, place): windows of `span` bytes that begin at lo..hi choose the same gram, the one of least hash; its hash and place.

    Equal windows choose grams of equal hash whatever stands around them.
    """
    b = np.frombuffer(text, np.uint8)
    if len(b) < span:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    parts = [_chosen(b[i : i + STRIDE + span - 1], i, span) for i in range(0, len(b) - span + 1, STRIDE)]
    return tuple(np.concatenate(x) for x in zip(*parts)) if len(parts) > 1 else parts[0]


def _anchors(docs: DataFrame, span: int) -> DataFrame:
    """(hash, doc, place) of docs (doc, text): place is lo, the gram's place from lo, hi - lo and what is known of the hash, packed.

    A hash that occurs twice in a batch is known to repeat there, and one whose gram
    is twice within its windows may have equal ones; such rows (1) are dealt out at
    random, and one more (2) only counts for the others of its hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs, docs, places = [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h, lo, hi, at = runs(text, span)
                hs.append(h)
                docs.append(np.full(len(h), doc, np.int64))
                again = [text.find(text[i : i + GRAM], a, b + span) != i or text.find(text[i : i + GRAM], i + 1, b + span) >= 0 for a, b, i in zip(lo.tolist(), hi.tolist(), at.tolist())]
                places.append(lo << 17 | (at - lo) << 9 | (hi - lo) << 2 | np.array(again, np.int64))
            if not hs:
                continue
            h, d, p = map(np.concatenate, (hs, docs, places))
            values, first, back, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            p = p | (n[back] > 1)
            more = first[(p[first] & 1) == 1]
            h, d, p = np.concatenate([h, h[more]]), np.concatenate([d, d[more]]), np.concatenate([p, np.full(len(more), 2, np.int64)])
            for i in range(0, len(h), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)]) for x in (h, d, p)], ["hash", "doc", "place"])

    return docs.mapInArrow(run, "hash long, doc long, place long")


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, hash, place) of rows whose hash is known to repeat or does so here; rows come sorted by hash."""
    before, held = None, None  # hash of the row before, and that row if it was not given out
    for b in batches:
        h, d, p = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        if not len(h):
            continue
        same = np.concatenate([[h[0] == before], h[1:] == h[:-1]])
        keep = same.copy()
        keep[:-1] |= same[1:]
        extra = [held] if held is not None and same[0] else []
        held = None if keep[-1] else (h[-1], d[-1], p[-1])
        before = h[-1]
        keep |= (p & 3) == 1
        keep &= (p & 3) != 2
        if held is not None and ((held[2] & 3) == 1):
            held = None
        out = [np.concatenate([np.array([x[k] for x in extra if x[2] & 3 != 2], np.int64), v[keep]]) for k, v in enumerate((h, d, p))]
        if len(out[0]):
            yield pa.RecordBatch.from_arrays([pa.array(out[1]), pa.array(out[0]), pa.array(out[2])], ["doc", "hash", "place"])


_OUT = "kind int, hash long, rank long, doc long, lo long, hi long, context binary, gram long"


def _contexts(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Contexts (kind 0) of the wanted runs, each content once in a batch, and the windows (kind 1) of its later places."""
    for b in batches:
        first: dict[bytes, tuple[int, int, int]] = {}
        rows = []
        for doc, rank, text, wanted in zip(*(b.column(i).to_pylist() for i in range(4))):
            for x in wanted:
                lo, more, gram = x["place"] >> 17, x["place"] >> 2 & 127, x["place"] >> 9 & 255
                context = text[lo : lo + more + span]
                rows.append((x["hash"], rank, doc, lo, lo + more, context, gram))
                at = (rank, doc, lo)
                if context not in first or at < first[context]:
                    first[context] = at
        out: list[list] = [[] for _ in range(8)]
        given = set()
        for h, rank, doc, lo, hi, context, gram in rows:
            own = first[context] == (rank, doc, lo)
            if own and context in given:
                continue
            if own:
                given.add(context)
            for c, v in zip(out, (0 if own else 1, h, rank, doc, lo, hi, context if own else None, gram)):
                c.append(v)
        if out[0]:
            yield _batch(out)


_NAMES = ["kind", "hash", "rank", "doc", "lo", "hi", "context", "gram"]


def _batch(cols: list[list]) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.int64()] * 5, pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], _NAMES)


class Shard:
    """Contexts one behind the other as a text of symbols (a byte's value and 2; 1 behind each, 0 at the end), with their places; on disk beyond `memory`."""

    def __init__(self, memory: int = MEMORY):
        self.memory, self.size = memory, 0
        self.text, self.places = Tape(1, memory // 8), Tape(4, memory // 4)
        self.parts: list[bytes] = []
        self.rows: list[tuple[int, int, int, int]] = []

    def add(self, context: bytes, rank: int, doc: int, lo: int) -> None:
        self.parts.append(context)
        self.rows.append((self.size, rank, doc, lo))
        self.size += len(context) + 1
        if len(self.parts) >= 4096:
            self._settle()

    def _settle(self) -> None:
        if self.parts:
            size = sum(map(len, self.parts)) + len(self.parts)
            symbols = np.zeros(-(-size // 4) * 4, np.uint16)
            at = 0
            for x in self.parts:
                symbols[at : at + len(x)] = np.frombuffer(x, np.uint8)
                symbols[at : at + len(x)] += np.uint16(2)
                symbols[at + len(x)] = 1
                at += len(x) + 1
            # four symbols a number; zeros that fill the last one are left out when the text is put together
            self.text.append(np.append(np.array([size]), symbols.view(np.int64)).reshape(-1, 1))
            self.places.append(np.array(self.rows, np.int64))
            self.parts, self.rows = [], []

    def _joined(self) -> tuple[np.ndarray, ...]:
        self._settle()
        text, at = stored(self.size + 1, np.uint16, 4 * self.memory), 0
        rest = np.zeros(0, np.int64)
        for x in self.text.forward():
            rest = np.append(rest, x[:, 0])
            while len(rest) and len(rest) > -(-int(rest[0]) // 4):
                n = int(rest[0])
                text[at : at + n] = rest[1 : 1 - (-n // 4)].view(np.uint16)[:n]
                at, rest = at + n, rest[1 - (-n // 4) :]
        columns = [stored(len(self.places), np.int64, self.memory) for _ in range(4)]
        at = 0
        for x in self.places.forward():
            for k in range(4):
                columns[k][at : at + len(x)] = x[:, k]
            at += len(x)
        return text, *columns

    def repeated(self, span: int) -> Iterator[np.ndarray]:
        """(rank, doc, lo, hi): windows of `span` bytes that begin at lo..hi and are equal to one at an earlier place in the shard.

        Suffixes that follow one another and share `span` symbols or more begin with equal windows.
        """
        text, begin, rank, doc, lo = self._joined()
        later = Tape(3, self.memory)
        run, open_run, least = 0, -1, None
        blocks = Sorter(text, span, self.memory).order()
        now = next(blocks)
        while now is not None:
            follow = next(blocks, None)
            p, common = now
            joined = common >= span
            runs = run + np.cumsum(~joined)
            own = np.flatnonzero(joined | np.append(joined[1:], follow is not None and follow[1][0] >= span))
            run, now = int(runs[-1]), follow
            if not len(own):
                continue
            k = np.searchsorted(begin, p[own], "right") - 1
            end = np.append(begin[1:], self.size)[k] if len(begin) <= self.memory else np.where(k + 1 < len(begin), begin[np.minimum(k + 1, len(begin) - 1)], self.size)
            fits = (k >= 0) & (p[own] + span < end)
            own, k = own[fits], k[fits]
            rows = np.stack([runs[own], rank[k], doc[k], lo[k] + p[own] - begin[k]], axis=1)
            if least is not None and len(rows) and rows[0, 0] == open_run:
                rows = np.concatenate([least, rows])
            rows = rows[np.lexsort(rows.T[::-1])]
            if not len(rows):
                continue
            new = np.append(True, rows[1:, 0] != rows[:-1, 0])
            first = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
            later.append(rows[(rows != first).any(axis=1), 1:])
            open_run, least = int(rows[-1, 0]), first[-1:]
        before = None
        for rows in sorted_rows(later.forward(), 3, self.memory):
            for i in range(0, len(rows), MANY):
                x = rows[i : i + MANY]
                new = np.append(True, (x[1:, :2] != x[:-1, :2]).any(axis=1) | (x[1:, 2] > x[:-1, 2] + 1))
                at = np.flatnonzero(new)
                if len(x):
                    yield np.column_stack([x[at], x[np.append(at[1:], len(x)) - 1, 2]])


def _sorted_shards(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Windows (kind 1) that repeat an earlier one, from contexts sorted by hash: a shard ends with a hash when it is large enough."""
    shard, now, held = Shard(), None, 0
    own: dict[bytes, tuple[int, int, int]] = {}
    grams: dict[bytes, int] = {}

    def flushed() -> Iterator[pa.RecordBatch]:
        for x in shard.repeated(span):
            zero = np.zeros(len(x), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(zero + 1, pa.int32()), *(pa.array(v) for v in (zero, x[:, 0], x[:, 1], x[:, 2], x[:, 3])), pa.nulls(len(x), pa.binary()), pa.array(zero)], _NAMES)

    def take(all_of_them: bool) -> None:
        """The hash's contexts that may hold equal windows join the shard."""
        for c in own if all_of_them else _sharing(grams, span):
            shard.add(c, *own[c])
        own.clear()
        grams.clear()

    many = False  # the hash has more contexts than are held
    for b in batches:
        out: list[list] = [[] for _ in range(8)]
        for h, rank, doc, lo, hi, context, gram in zip(*(b.column(i).to_pylist() for i in range(1, 8))):
            if h != now:
                take(many)
                now, held, many = h, 0, False
                if shard.size >= SHARD:
                    yield from flushed()
                    shard = Shard()
            place = (rank, doc, lo)
            old = own.get(context)
            if old is None or place < old:
                own[context] = place
            if old is None:
                grams[context] = gram
                held += len(context)
            elif place != old:
                late = max(place, old)
                for c, v in zip(out, (1, h, late[0], late[1], late[2], late[2] + hi - lo, None, 0)):
                    c.append(v)
            if held > HELD:
                many, held = True, 0
                take(True)
        if out[0]:
            yield _batch(out)
    take(many)
    if shard.size:
        yield from flushed()


def _sharing(grams: dict[bytes, int], span: int) -> list[bytes]:
    """Contexts of one hash (and the place of the chosen gram) that may hold a window equal to another one of theirs.

    A window reaches some way before its gram and the rest behind it. By the
    quarter that the way before falls in, it holds one of four stretches about the
    gram, three quarters of the rest long; equal windows hold equal ones. Contexts
    with the gram at several places are taken if they, or others, can match.
    """
    quarter = -(-(span - GRAM) // 4)
    by: dict[tuple[int, bytes], bytes] = {}
    out: set[bytes] = set()
    for c, at in grams.items():
        gram = c[at : at + GRAM]
        places = [c.find(gram)]
        while (i := c.find(gram, places[-1] + 1)) >= 0:
            places.append(i)
        if len(places) > 1 and (len(grams) > 1 or _periodic(c, span)):
            out.add(c)
        for i in places:
            for j in range(4):
                low, high = i - quarter * j, i + span - quarter * (j + 1)
                if low >= 0 and i + GRAM <= high <= len(c):
                    other = by.setdefault((j, c[low:high]), c)
                    if other is not c:
                        out |= {c, other}
    return sorted(out)


def _periodic(c: bytes, span: int) -> bool:
    """Whether two windows of a context may be equal: its last window's first bytes also begin an earlier one."""
    return len(c) > span and any(c.find(c[i : i + 16], i + 1, len(c) - span + 16) >= 0 for i in range(len(c) - span))


def _applied(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Figures of each text after the bytes of its repeated windows (lo, hi) are taken out."""
    for b in batches:
        cols: list[list] = [[] for _ in range(6)]
        for doc, rank, text, windows in zip(*(b.column(i).to_pylist() for i in range(4))):
            spans: list[list[int]] = []
            for lo, hi in sorted((w["lo"], w["hi"] + span) for w in windows or ()):
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], hi)
                else:
                    spans.append([lo, hi])
            kept, at = [], 0
            for lo, hi in spans:
                kept.append(text[at:lo])
                at = hi
            rest = b"".join([*kept, text[at:]])
            for c, v in zip(cols, (doc, rank, len(text) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest)):
                c.append(v)
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc", "rank", "n_removed", "n_spans", "kept_sha256", "kept"])


def without_repeats(docs: DataFrame, span: int = 100, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 (with texts also kept, the bytes that stay) of each row of docs.

    Every byte is taken out that lies in a string of `span` bytes that also begins
    earlier: in a document of smaller doc_id, or before in the same one. Matches
    don't cross documents and are judged on the input. Null texts are empty; null
    doc_ids come last; rows of the same doc_id and text are one place; different
    texts of the same doc_id go by a hash of the text. Other columns are left out;
    no rows give none.

    A copy of an earlier text (equal by SHA-256) goes whole and takes no further
    part. Of the others, each window chooses one of its grams; only windows whose
    gram's hash occurs elsewhere too (equal windows always meet so) are brought
    together, each content once, and suffix-sorted shard by shard; a shard may be
    far larger than memory (see Sorter). Very long texts are walked through in
    strides. `span` must be over GRAM and under 128.
    """
    if not GRAM < span < 128:
        raise ValueError(f"span must be over {GRAM} and under 128")
    spark = docs.sparkSession
    prepare(spark)
    base = only(docs, ["doc_id", "text"]).select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("rank"), F.xxhash64(text_or_empty()).alias("doc"), F.sha2(text_or_empty().cast("binary"), 256).alias("sha"), text_or_empty().cast("binary").alias("text"))
    firsts, _ = written(base.groupBy("sha").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"), F.first("doc").alias("doc")), "texts")
    copied = firsts.where("n > 1").select("sha", "first")
    few = copied.count() <= BROADCAST_ROWS
    marked = base.join(F.broadcast(copied) if few else copied, "sha", "left")
    # different texts of equal 64-bit hash take another one
    clash = firsts.groupBy("doc").count().where("count > 1").select("doc", F.lit(True).alias("clash"))
    clashes = clash.count()
    if clashes:
        marked = marked.join(F.broadcast(clash) if clashes <= BROADCAST_ROWS else clash, "doc", "left").withColumn("doc", F.when(F.col("clash"), F.xxhash64(F.lit("again"), "sha")).otherwise(F.col("doc")))
    own = marked.where("first is null or rank = first").select("doc", "rank", "text")
    h, place = F.col("hash"), F.col("place")
    dealt = _anchors(own.select("doc", "text"), span).repartition(F.when(place.bitwiseAND(F.lit(3)) == 1, F.xxhash64("doc", "place")).otherwise(h))
    found, _ = written(dealt.sortWithinPartitions("hash").mapInArrow(_repeated, "doc long, hash long, place long"), "anchors")
    wanted = found.groupBy("doc").agg(F.collect_list(F.struct("hash", "place")).alias("wanted"))
    picked = own.join(wanted.hint("shuffle_hash"), "doc").select("doc", "rank", "text", "wanted")
    gathered, _ = written(picked.mapInArrow(lambda b: _contexts(b, span), _OUT), "contexts")
    shards = gathered.where("kind = 0").repartition("hash").sortWithinPartitions("hash")
    later, _ = written(shards.mapInArrow(lambda b: _sorted_shards(b, span), _OUT).select("doc", "lo", "hi"), "windows")
    windows = gathered.where("kind = 1").select("doc", "lo", "hi").unionAll(later)
    by_doc = windows.groupBy("doc").agg(F.collect_set(F.struct("lo", "hi")).alias("windows"))
    touched = own.join(by_doc.hint("shuffle_hash"), "doc").select("doc", "rank", "text", "windows")
    result = touched.mapInArrow(lambda b: _applied(b, span), "doc long, rank long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    done, _ = written(result.select("doc", "n_removed", "n_spans", "kept_sha256", *["kept"] * texts).dropDuplicates(["doc"]), "kept")
    rows = marked.select("doc_id", "doc", (F.col("rank") > F.col("first")).alias("late"), F.octet_length("text").cast("long").alias("n_bytes"), "sha", *["text"] * texts)
    rows = rows.join(done, "doc", "left")
    whole = F.coalesce("late", F.lit(False)) & (F.col("n_bytes") >= span)
    kept = [F.when(whole, F.lit("").cast("binary")).otherwise(F.coalesce("kept", "text")).alias("kept")] if texts else []
    return rows.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        *kept,
    )
