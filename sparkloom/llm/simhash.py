"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, removed, prepare, text_or_empty, written
from .components import components

#: Members of a bucket that are compared with one another in one task; larger buckets are dealt out by more masks.
BUCKET = 4096
#: Times a large bucket is dealt out anew before it is compared block by block whatever its size.
LEVELS = 6
#: Bands of least hashes and hashes in each: a pair of similarity s shares a band with probability 1 - (1 - s^DEPTH)^BANDS, 0.9998 at 0.8.
BANDS, DEPTH = 16, 4
#: Rounds in which texts are tried against heads of their buckets only, before candidates are sought among all members.
STARS = 2
#: Bits of the parity sketch of a text's shingles, and the columns of 64 bits that hold it.
PARITY = 1024
WORDS = [f"w{i}" for i in range(PARITY // 64)]
#: Bucket heads (16 bytes each) up to which they are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, shingle: int) -> int:
    """64-bit SimHash of the shingles of lower-cased words; 0 without words."""
    words = text.lower().split()  # bytes: A-Z only, and white space is \x20 and \x09-\x0D
    return _majority(_hashes(words, shingle)) if words else 0


def _hashes(words: list[bytes], shingle: int) -> np.ndarray:
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) > shingle else [b" ".join(words)]
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), grams), np.uint64)


def _majority(h: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):  # bounded memory for very long texts
        ones += np.unpackbits(h[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row of docs (doc_id, text)."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x or b"", shingle) for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select("doc_id", text_or_empty().cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def masks(radius: int, turn: int = 0) -> list[int]:
    """2^(radius+1) - 1 masks; any two words that differ in at most `radius` bits are equal under one of them.

    Bit i gets the vector m(i) of radius+1 bits; mask v keeps the bits with
    <m(i), v> = 1. `radius` differing bits give as many equations for radius+1
    unknowns, so some v other than zero drops all of them. With m(i) = i mod
    2^(radius+1) (up to 5) or (1, i) (6) each mask but one keeps 32 bits. `turn`
    permutes the bits, for other masks of the same kind.
    """
    if not 0 <= radius <= 6:
        raise ValueError("radius must be from 0 to 6")
    bits = [(i * (2 * turn + 1) * 5 + turn * 11) % 64 if turn else i for i in range(64)]
    m = [(64 + i) if radius == 6 else i % (2 << radius) for i in bits]
    return [sum(1 << i for i in range(64) if (m[i] & v).bit_count() % 2) for v in range(1, 2 << radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def dealt(rows: DataFrame, radius: int, turn: int = 0) -> DataFrame:
    """rows (fp, ...) once for each mask with the bucket's key; rows that have a key are dealt out within their bucket."""
    old = [F.col("key")] if "key" in rows.columns else []
    each = [F.xxhash64(F.lit(j), *old, F.col("fp").bitwiseAND(F.lit(_signed(x)).cast("long"))) for j, x in enumerate(masks(radius, turn))]
    rest = [c for c in rows.columns if c != "key"]
    return rows.select(F.explode(F.array(*each)).alias("key"), *rest).repartition("key").sortWithinPartitions("key", *reversed(rest))


def _runs(batches: Iterator[pa.RecordBatch], limit: int | None) -> Iterator[tuple[bool, np.ndarray]]:
    """Runs of two rows or more with equal keys, from rows sorted by key; those over `limit` come as pieces marked True."""
    rest, big = None, None
    for b in batches:
        new = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1).astype(np.int64)
        if not len(new):
            continue
        rows = new if rest is None else np.concatenate([rest, new])
        ends = np.flatnonzero(np.diff(rows[:, 0])) + 1
        cut = [0, *ends]
        if len(ends):
            first = np.concatenate([[0], ends[:-1]])
            for i in np.flatnonzero((ends - first >= 2) | ((first == 0) & (rows[0, 0] == big if big is not None else False))):
                piece = rows[first[i] : ends[i]]
                yield (big is not None and piece[0, 0] == big) or (limit is not None and len(piece) > limit), piece
        rest = rows[cut[-1] :]
        if limit is not None and (len(rest) > limit or (big is not None and rest[0, 0] == big)):
            big = rest[0, 0]
            yield True, rest
            rest = None
    if rest is not None and (len(rest) >= 2 or (big is not None and rest[0, 0] == big)):
        yield (big is not None and rest[0, 0] == big) or (limit is not None and len(rest) > limit), rest


def _near(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(x[:, None] ^ y[None, :]) <= radius


def forest(fp: np.ndarray, radius: int) -> np.ndarray:
    """For each member of a bucket the position of its component's first member, blocks of 512 rows at a time."""
    n, label = len(fp), np.arange(len(fp))
    while True:
        new = label.copy()
        for i in range(0, n, 512):
            for j in range(0, n, 8192):
                new[i : i + 512] = np.minimum(new[i : i + 512], np.where(_near(fp[i : i + 512], fp[j : j + 8192], radius), label[None, j : j + 8192], n).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links(distinct: DataFrame, radius: int, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints that join exactly those within `radius` bits of each other, directly or in steps.

    Each bucket gives a spanning forest of its links, not its pairs. A bucket over
    `bucket` members is not compared but dealt out by other masks within itself,
    again and again; what is left after LEVELS is compared in blocks.
    """
    found, rows, spare = [], distinct.select("fp"), []
    for turn in range(LEVELS):
        limit = bucket if turn < LEVELS - 1 else None

        def run(batches: Iterator[pa.RecordBatch], limit: int | None = limit) -> Iterator[pa.RecordBatch]:
            for hot, piece in _runs(batches, limit):
                key, fp = piece[:, 0], piece[:, 1]
                if hot:
                    yield pa.RecordBatch.from_arrays([pa.array(fp), pa.nulls(len(fp), pa.int64()), pa.array(key)], ["a", "b", "key"])
                    continue
                root = forest(fp.view(np.uint64), radius)
                own = np.flatnonzero(root != np.arange(len(root)))
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(fp[own]), pa.array(fp[root[own]]), pa.nulls(len(own), pa.int64())], ["a", "b", "key"])

        table, path = written(dealt(rows, radius, turn).mapInArrow(run, "a long, b long, key long"), "buckets")
        found.append(table.where("b is not null").select("a", "b"))
        spare.append(path)
        if limit is None or table.where("b is null").isEmpty():
            break
        rows = table.where("b is null").select(F.col("a").alias("fp"), "key")
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def near_components(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint and component_id for each row of docs.

    Fingerprints within `radius` bits are linked, always; a component's id is the
    smallest doc_id in it. A null or empty text has no words and fingerprint zero,
    and is linked like any other. Equal fingerprints are one node, so copies cost
    nothing; repeated rows come back as often as they are there. Null doc_ids are
    passed over for the component's id (null if it has no other). Other columns
    are left out; no rows give none.
    """
    spark = docs.sparkSession
    docs = only(docs, ["doc_id", "text"])
    prints, _ = written(fingerprints(docs, shingle), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes, radius))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named, _ = written(placed.join(lowest, "root").select("fp", "component_id"), "components")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# The pipeline's stage: near copies by shingle sets, found through the same masks.


def shingles(text: bytes, k: int) -> set[bytes]:
    words = text.lower().split()
    return set(map(b" ".join, zip(*(words[i:] for i in range(k))))) if len(words) > k else {b" ".join(words)}


def similarity(x: bytes, y: bytes, k: int) -> float:
    """Jaccard similarity of the sets of k-word shingles."""
    a, b = shingles(x, k), shingles(y, k)
    both = len(a & b)
    return both / (len(a) + len(b) - both)


_R = np.random.default_rng(3)
_TIMES, _PLUS = _R.integers(0, 1 << 64, (2, BANDS * DEPTH), np.uint64)
_TIMES |= np.uint64(1)


def bands(h: np.ndarray) -> np.ndarray:
    """Key of each band of least hashes, from the hashes of a text's shingles."""
    least = np.full(BANDS * DEPTH, _ONES)
    for i in range(0, len(h), 4096):  # bounded memory for very long texts
        least = np.minimum(least, (h[i : i + 4096, None] * _TIMES + _PLUS).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), seed=j) for j, x in enumerate(least.reshape(BANDS, DEPTH))], np.uint64).view(np.int64)


def parity(h: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of distinct hashes, and for each value of their low bits whether it is had by an odd number of them.

    Sets whose sketches differ in d bits differ in at least d members, for each
    member that both have changes both sketches alike.
    """
    own = np.unique(h)
    odd = np.bincount((own % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return len(own), np.packbits(odd.astype(bool)).view(np.int64)


def _sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc, h1, h2, the fingerprint fp, the keys of the bands, and n and WORDS of parity() of each row of docs (doc, h1, h2, text)."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            words = [x.lower().split() for x in b.column(3).to_pylist()]
            h = [_hashes(w, shingle) for w in words]
            fp = np.array([_majority(x) if w else 0 for w, x in zip(words, h)], np.uint64).view(np.int64)
            n, odd = zip(*map(parity, h))
            columns = [*b.columns[:3], pa.array(fp), pa.array([bands(x) for x in h], pa.list_(pa.int64())), pa.array(n, pa.int64()), *map(pa.array, np.stack(odd, axis=1))]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "h1", "h2", "fp", "bands", "n", *WORDS])

    kinds = "doc long, h1 long, h2 long, fp long, bands array<long>, n long, " + ", ".join(f"{w} long" for w in WORDS)
    return docs.select("doc", "h1", "h2", text_or_empty().cast("binary").alias("text")).mapInArrow(run, kinds)


def _differ(least: float) -> float:
    """Sets of n and m members whose Jaccard similarity is `least` or more differ in at most this share of n + m members."""
    return (1 - least) / (1 + least)


def _near_sets(x: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    """Whether rows (n, words) of x and y may be similar enough: no pair that is gets False."""
    n, m = x[:, 0][:, None], y[:, 0][None, :]
    most = (n + m) * share + 1e-6
    near = np.abs(n - m) <= most
    xw, yw = np.ascontiguousarray(x[:, 1:].T).view(np.uint64), np.ascontiguousarray(y[:, 1:].T).view(np.uint64)
    d = np.zeros(near.shape, np.int16)
    for w in range(4):
        d += np.bitwise_count(xw[w][:, None] ^ yw[w][None, :])
    near &= d <= most
    i, j = np.nonzero(near)
    for at in range(0, len(i), 65536):  # the other words only for pairs that are left
        p, q = i[at : at + 65536], j[at : at + 65536]
        near[p, q] = d[p, q] + np.bitwise_count(xw[4:, p] ^ yw[4:, q]).sum(axis=0, dtype=np.int64) <= most[p, q]
    return near


def _partners(table: DataFrame, most: int, least: float) -> DataFrame:
    """For each row of a bucket `most` rows of smaller roots that may be similar enough, and whether there are more.

    Within a bucket rows are sorted by root, so rows of one root are never compared.
    """
    share = _differ(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, piece in _runs(batches, None):
            root, node, sets = piece[:, 1], piece[:, 2], piece[:, 3:]
            start = np.searchsorted(root, root)
            for i in range(0, len(node), 256):
                own = slice(i, i + 256)
                have, found = np.zeros(len(node[own]), np.int64), []
                for j in range(0, int(start[own].max()), 2048):
                    near = _near_sets(sets[own], sets[j : j + 2048], share)
                    near &= np.arange(j, j + near.shape[1])[None, :] < start[own][:, None]
                    x, y = np.nonzero(near & (have[:, None] + near.cumsum(axis=1) <= most))
                    have += near.sum(axis=1)
                    found.append((x, y + j))
                if have.any():
                    x, y = (np.concatenate(v) for v in zip(*found))
                    yield pa.RecordBatch.from_arrays([pa.array(node[own][x]), pa.array(node[y]), pa.array((have > most)[x])], ["a", "b", "more"])

    dealt_out = table.select("key", "root", "node", "n", *WORDS).repartition("key").sortWithinPartitions("key", "root", "node")
    return dealt_out.mapInArrow(run, "a long, b long, more boolean")


def _keyed(rows: DataFrame, radius: int) -> DataFrame:
    """(node, root, key) of rows (node, fp, bands, root) for each mask and band."""
    each = [F.xxhash64(F.lit(j), F.col("fp").bitwiseAND(F.lit(_signed(x)).cast("long"))) for j, x in enumerate(masks(radius))]
    return rows.select("node", "root", F.explode(F.concat(F.array(*each), "bands")).alias("key"))


def _mixed(keyed: DataFrame) -> tuple[DataFrame, bool]:
    """(key, head, rows) of the buckets that hold rows of different roots, with the smallest root; and whether they may be broadcast."""
    ends = keyed.groupBy("key").agg(F.min("root").alias("head"), F.max("root").alias("high"), F.count(F.lit(1)).alias("rows"))
    mixed, _ = written(ends.where("head < high").select("key", "head", "rows"), "heads")
    return mixed, mixed.count() <= BROADCAST_ROWS


def _members(rows: DataFrame, radius: int, bucket: int) -> tuple[DataFrame, str]:
    """(key, node) of the buckets with rows of different roots; of those of over `bucket` rows each two blocks are a bucket.

    A hash deals such a bucket's rows to blocks of about `bucket` rows, so every two
    of its rows still meet, and a task holds two blocks at once, not the bucket.
    """
    keyed = _keyed(rows, radius)
    heads, few = _mixed(keyed)
    joined = keyed.join(F.broadcast(heads) if few else heads, "key").select("key", "node", F.ceil(F.col("rows") / bucket).alias("blocks"))
    own = joined.select("*", F.pmod(F.xxhash64("node"), "blocks").alias("own"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda i: i != F.col("own"))
    pairs = F.transform(others, lambda i: F.xxhash64("key", F.least("own", i), F.greatest("own", i)))
    return written(own.select(F.explode(F.when(F.col("blocks") > 1, pairs).otherwise(F.array("key"))).alias("key"), "node"), "buckets")


def without_near_copies(docs: DataFrame, shingle: int = 5, least: float = 0.8, radius: int = 4, bucket: int = 2 * BUCKET) -> DataFrame:
    """docs with one row, that of the smallest doc_id, of each group of rows linked by a similarity of `least` or more, directly or in steps.

    Similarity is the Jaccard similarity of sets of `shingle`-word shingles of
    lower-cased words, checked on the texts. Candidates are pairs that meet under a
    mask (all pairs of fingerprints within `radius` bits do) or, as pairs of
    similarity 0.8 differ in 10 bits or so, that share a band of least hashes. Those
    whose parity sketches show that they differ in too many shingles are left out
    before texts are read; that bound loses no similar pair. A row without words counts as a
    copy of any other such row. Null texts are empty; null doc_ids come last. Rows
    with the same text keep the smallest doc_id, repeated rows one; texts that share
    a doc_id are told apart. Very long texts are hashed in blocks. All columns come
    back as they are; no rows give none.

    First each text is checked against the head of its buckets (the smallest root in
    them) that most of its buckets have; a large group of copies so becomes one
    root, without pairs of its members, and buckets of one root are done. Then texts
    of the buckets that are left are checked against more and more members of
    other roots, until none is left unchecked. Of these buckets, those of over
    `bucket` texts are compared by pairs of blocks, each pair on its own: no bucket
    is cut, whatever its size.
    """
    spark = docs.sparkSession
    names = docs.columns
    plain = docs.toDF(*[c if c in ("doc_id", "text") else f"__in_{i}" for i, c in enumerate(names)])
    ident = ["doc", "h1", "h2"]
    marked = plain.select(
        "*",
        F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc"),
        F.xxhash64(text_or_empty()).alias("h1"),
        F.xxhash64(F.lit(1), text_or_empty()).alias("h2"),
    )
    copies = marked.groupBy("h1", "h2").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("rows"))
    groups, _ = written(copies.withColumn("node", F.monotonically_increasing_id()), "texts")
    named = _sketches(marked.select(*ident, "text"), shingle).join(groups.select("node", *ident), ident).drop(*ident)
    rows, p1 = written(named.dropDuplicates(["node"]), "fingerprints")
    sets = rows.select("node", "n", *WORDS)
    tried = spark.createDataFrame([], "a long, b long")
    roots = spark.createDataFrame([], "node long, root long")
    rooted = lambda x: x.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    for _ in range(STARS):
        keyed = _keyed(rooted(rows.select("node", "fp", "bands")), radius)
        heads, few = _mixed(keyed)
        met = keyed.join(F.broadcast(heads) if few else heads, "key").where("head != root")
        votes = met.groupBy("node", "head").count().toDF("a", "b", "n").join(tried, ["a", "b"], "left_anti")
        best, _ = written(votes.groupBy("a").agg(F.max(F.struct("n", -F.col("b"))).alias("m")).select("a", (-F.col("m.col2")).alias("b")), "pairs")
        if best.isEmpty():
            break
        good, _ = written(_verified(marked, groups, _possible(best, sets, least), shingle, least), "copies")
        tried, roots = tried.unionAll(best), _joined(roots, good)
    members, spare = _members(rooted(rows.select("node", "fp", "bands")), radius, bucket)
    most = 16
    while True:
        pairs = _partners(rooted(members.join(sets, "node")), most, least)
        # the first candidates over all buckets
        some = pairs.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("b"), F.max("more").alias("more"))
        some, _ = written(some.select("a", F.slice("b", 1, most).alias("b"), (F.col("more") | (F.size("b") > most)).alias("more")), "pairs")
        if some.isEmpty():
            break
        good, _ = written(_verified(marked, groups, some.select("a", F.explode("b").alias("b")), shingle, least), "copies")
        roots = _joined(roots, good)
        if some.where("more").isEmpty():
            break
        most *= 16
    least_row = F.min(F.struct(*ident)).alias("m")
    keep = rooted(groups).groupBy("root").agg(least_row).select("m.*")
    out = marked.join(keep, ident, "left_semi")
    if not groups.where("rows > 1").isEmpty():  # rows of the same doc_id and text
        twice = marked.select(*ident).groupBy(*ident).count().where("count > 1")
        if not twice.isEmpty():
            out = out.dropDuplicates(ident)
    removed(spark, p1, spare)
    return out.select(*[F.col(c if c in ("doc_id", "text") else f"__in_{i}").alias(c) for i, c in enumerate(names)])


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of the components that links (a, b) make of those of roots."""
    return components(links.unionAll(roots)) if links.count() else roots


def _possible(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that the bound of parity sketches leaves; it loses none that is similar enough."""
    a, b = sets.toDF("a", "na", *[f"a{w}" for w in WORDS]), sets.toDF("b", "nb", *[f"b{w}" for w in WORDS])
    differ = sum((F.bit_count(F.col(f"a{w}").bitwiseXOR(F.col(f"b{w}"))) for w in WORDS), F.lit(0))
    return pairs.join(a, "a").join(b, "b").where(differ <= (F.col("na") + F.col("nb")) * _differ(least) + 1e-6).select("a", "b")


def _verified(docs: DataFrame, groups: DataFrame, pairs: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs (a, b) of texts that are similar enough; groups names the row of docs of each."""
    ids = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct()
    wanted = groups.select("node", "doc", "h1", "h2").join(ids, "node", "left_semi")
    texts = docs.select("doc", "h1", "h2", text_or_empty().cast("binary").alias("t")).join(wanted, ["doc", "h1", "h2"]).select("node", "t").dropDuplicates(["node"])
    both = pairs.select("a", "b").join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select(["a", "b"]).filter(pa.array([similarity(x.as_py(), y.as_py(), shingle) >= least for x, y in zip(b.column(2), b.column(3))], pa.bool_()))

    return both.mapInArrow(run, "a long, b long")
