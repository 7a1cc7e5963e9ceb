"""Line deduplication by a deletion-neighbourhood join, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, text_or_empty, written

#: Blocks that a text is divided into, and characters up to which a block's variants are emitted.
FAN, SHORT = 8, 64
#: Rows up to which a table of line hashes (24 bytes each) is broadcast; beyond, it is shuffled.
BROADCAST_ROWS = 1_000_000


def lines_of(docs: DataFrame) -> DataFrame:
    """doc, mark (hash of the text), no (from 0) and norm (the line without white space at its ends) of each line that has a word."""
    t = text_or_empty()
    rows = docs.select(F.col("doc_id").alias("doc"), F.xxhash64(t).alias("mark"), F.posexplode(F.split(t, "\n")).alias("no", "line"))
    return rows.select("doc", "mark", "no", F.trim("line", F.lit(SPACE_CHARS)).alias("norm")).where("norm != ''")


def _hashed(lines: DataFrame) -> DataFrame:
    return lines.withColumn("h", F.struct(F.xxhash64("norm").alias("x"), F.xxhash64(F.lit(1), "norm").alias("y")))


def _semi(left: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of left that have a key; the keys are broadcast only if they were counted and are few."""
    few = keys.count() <= BROADCAST_ROWS
    return left.join(F.broadcast(keys) if few else keys, on, "left_semi")


def _side(side: str, n: Column) -> Column:
    """Hash of the first or last n/2 characters of norm."""
    h = F.floor(n / 2).cast("int")
    part = F.col("norm").substr(F.lit(1), h) if side == "p" else F.col("norm").substr(F.length("norm") - h + 1, h)
    return F.xxhash64(F.lit(side), h, part)


def _blocks(role: Column, g: Column, at: Column, mid: Column, m: Column) -> list[Column]:
    """(role, g, at, mid) for each of FAN blocks of a text: the block, and as new group the hash of all that stands before and behind it.

    Blocks are cut by the length m of the shorter text; the block of a longer one (role 2) has one more character.
    """
    cut = lambda k: F.floor(m * k / FAN).cast("int")
    more = F.when(role == 2, 1).otherwise(0)
    out = []
    for k in range(FAN):
        a, b = cut(k), cut(k + 1) + more
        key = F.xxhash64(g, F.lit(k), mid.substr(F.lit(1), a), mid.substr(b + 1, F.lit(2**30)))
        out.append(F.struct(role.alias("role"), key.alias("g"), (at + a).alias("at"), mid.substr(a + 1, b - a).alias("mid")))
    return out


def _met(rows: DataFrame) -> DataFrame:
    """rows whose group holds two texts that may be one edit apart: two of equal length (role 0), or a shorter (1) and a longer one (2)."""
    keys = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("role").alias("low"), F.max("role").alias("high"))
    alive, _ = written(keys.where("n > 1 and (low < high or low = 0)").select("g"), "groups")
    return _semi(rows, alive, "g")


def _narrowed(lines: DataFrame) -> DataFrame:
    """(h, first, role, g, at, mid): what is left of lines that agree, in their group g, on all characters outside mid.

    One edit lies within one block (of the shorter line), so lines within one edit
    agree on all but that block; long blocks are divided again and again, and
    only blocks whose surroundings occur twice go on. All steps together cost a few
    passes over a line, whatever its length.
    """
    n = F.length("norm")
    starts = [(0, "s", n), (1, "i", n), (2, "i", n - 1)]
    whole = lines.select("h", "first", "norm", F.inline(F.array(*[F.struct(F.lit(r).alias("role"), F.xxhash64(F.lit(t), m).alias("g"), m.alias("m")) for r, t, m in starts])))
    whole = whole.select("h", "first", "role", "g", F.lit(0).alias("at"), F.col("norm").alias("mid"), "m")
    done, rest = [_met(whole.where(F.col("m") <= SHORT).drop("m"))], whole.where(F.col("m") > SHORT)
    while True:
        cols = [F.col(c) for c in ("role", "g", "at", "mid", "m")]
        cut = rest.select("h", "first", F.inline(F.array(*_blocks(*cols))))
        part, _ = written(_met(cut).withColumn("m", F.length("mid") - F.when(F.col("role") == 2, 1).otherwise(0)), "blocks")
        done.append(part.where(F.col("m") <= SHORT).drop("m"))
        rest = part.where(F.col("m") > SHORT)
        if rest.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _variants(parts: DataFrame) -> DataFrame:
    """(h, first, role, at, k1, k2): a row for each character that may be deleted, with two hashes of what then stands on either side.

    Equal lines delete the character that is substituted, a longer one the one put in; a shorter one gives itself, divided at each place.
    """
    role, mid = F.col("role"), F.col("mid")
    skip = F.when(role == 1, 0).otherwise(1)
    last = F.length(mid) - skip
    places = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    sides = lambda i: (i, mid.substr(F.lit(1), i), mid.substr(i + skip + 1, F.lit(2**30)))
    each = F.transform(places, lambda i: F.struct(i.alias("i"), F.xxhash64("g", *sides(i)).alias("k1"), F.xxhash64(*sides(i), "g").alias("k2")))
    return parts.select("h", "first", "role", "at", F.inline(each)).select("h", "first", "role", (F.col("at") + F.col("i")).alias("at"), "k1", "k2")


def neighbours(lines: DataFrame) -> DataFrame:
    """For each distinct line (h, first, norm) the earliest first of another line within one edit, if that is earlier: (h, near).

    Lines emit a variant for each character that may be deleted, keyed by hashes of
    the texts before and after it and its place. Lines of equal length that agree
    differ by a substitution there; the shorter of two lines meets the longer one's
    variant with its own two parts. So each bucket holds only lines within one edit
    of each other (of the shorter line), its earliest member is found by a minimum,
    and no pairs are made. Variants are emitted only for the block of a line outside
    of which it agrees with another one (see _narrowed).
    """
    variants, _ = written(_variants(_narrowed(lines)), "variants")
    mine = F.struct("first", "h", "at")
    best = variants.groupBy("k1", "k2").agg(*[F.min(F.when(F.col("role") == r, mine)).alias(f"m{r}") for r in range(3)], F.count(F.lit(1)).alias("c"))
    best, _ = written(best.where("c > 1 and (m0 is not null or m1 is not null and m2 is not null)").drop("c"), "variants")
    few = best.count() <= BROADCAST_ROWS
    role = F.col("role")
    met = variants.join(F.broadcast(best) if few else best, ["k1", "k2"]).select("h", "first", "role", F.when(role == 0, F.col("m0")).when(role == 1, F.col("m2")).otherwise(F.col("m1")).alias("w"))
    found, _ = written(met.where(F.col("w.first") < F.col("first")).groupBy("h").agg(F.min(F.struct(F.col("w.first").alias("first"), F.col("w.h").alias("h"), F.col("w.at").alias("at"), "role")).alias("w")), "neighbours")
    wanted, _ = written(found.select("h").unionAll(found.select(F.col("w.h").alias("h"))).distinct(), "neighbours")
    texts = _semi(lines.select("h", "norm"), wanted, "h")
    pairs = found.join(texts, "h").select("h", F.col("w.first").alias("near"), F.col("w.h").alias("g"), F.col("w.at").alias("at"), F.col("w.role").alias("role"), "norm")
    pairs = pairs.join(texts.toDF("g", "other"), "g")
    # an edit distance of one at `at`: what stands before and behind the edit is the same text
    behind = lambda x, skipped: F.col(x).substr(F.col("at") + 1 + skipped, F.lit(2**30))
    role = F.col("role")
    same = (F.substring("norm", F.lit(1), F.col("at")) == F.substring("other", F.lit(1), F.col("at"))) & (behind("norm", F.when(role == 1, 0).otherwise(1)) == behind("other", F.when(role == 2, 0).otherwise(1)))
    return pairs.where(same).select("h", "near")


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc, mark, nos): the numbers of the lines of each document that repeat an earlier line."""
    texts = _hashed(lines_of(docs))
    n = F.length("norm")
    halves = F.array_distinct(F.array(*[_side(side, k) for side in "ps" for k in (n, n - 1)]))
    lines, _ = written(texts.select("doc", "mark", "no", "h", halves.alias("halves")), "lines")
    place = F.struct("doc", "no")
    distinct = lines.groupBy("h").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies"))
    firsts, _ = written(distinct.where("copies > 1").select("h", "first"), "repeated")
    # lines that share the first or last half with another, before their texts are fetched
    keyed = lines.select("h", F.explode("halves").alias("k"))
    shared, _ = written(keyed.groupBy("k").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a != b").select("k"), "halves")
    few, _ = written(_semi(keyed, shared, "k").select("h").distinct(), "candidates")
    some, _ = written(_semi(texts, few, "h").groupBy("h").agg(F.min(place).alias("first"), F.first("norm").alias("norm")), "candidates")
    near, _ = written(neighbours(some), "neighbours")
    # written, so that both sides of the join come straight from an exchange and a very frequent line can be split
    until, _ = written(firsts.unionAll(near.toDF("h", "first")).groupBy("h").agg(F.min("first").alias("stays")), "stays")
    late = lines.select("doc", "mark", "no", "h").join(until, "h").where(place > F.col("stays"))
    return late.groupBy("doc", "mark").agg(F.collect_set("no").alias("nos"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs (every row, all columns) with kept_text, n_lines and n_removed added.

    A line is removed if a line that stands earlier (smaller doc_id, or the same
    document and a smaller line number) is equal or within one edit of it (a
    character put in, left out or replaced); both are compared without white space
    at their ends and judged on the input, so what is removed counts as well. Lines
    without a word always stay and are not counted. A null text is empty; null
    doc_ids come first; rows with the same doc_id are one place, so repeated rows
    do not remove each other. No document is dropped, even if no line is left, and
    no rows give none. Lines may be of any length: each is passed over a few times,
    and its variants are emitted for one short block only. Other columns come back
    as they are; a column of docs called as one that is added stays beside it.
    """
    names = docs.columns
    plain = docs.toDF(*[c if c in ("doc_id", "text") else f"__in_{i}" for i, c in enumerate(names)])
    gone, _ = written(dropped_lines(plain.select("doc_id", "text")), "removed")
    t = text_or_empty()
    keyed = plain.withColumn("__mark", F.xxhash64(t))
    gone = gone.withColumnsRenamed({"doc": "__doc", "mark": "__gone"})
    # the smaller side is hashed: the texts need no sort
    joined = keyed.join(gone.hint("shuffle_hash"), keyed["doc_id"].eqNullSafe(gone["__doc"]) & (F.col("__mark") == F.col("__gone")), "left")
    all_lines = F.split(t, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("nos"))
    text = F.when(F.col("nos").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(all_lines, i)), "\n"))
    real = F.size(F.filter(all_lines, lambda x: F.ltrim(x, F.lit(SPACE_CHARS)) != "")).cast("long")
    return joined.select(
        *[F.col(c if c in ("doc_id", "text") else f"__in_{i}").alias(c) for i, c in enumerate(names)],
        text.alias("kept_text"), real.alias("n_lines"), F.coalesce(F.size("nos"), F.lit(0)).cast("long").alias("n_removed"),
    )
