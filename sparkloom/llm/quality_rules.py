"""Rule-based quality filter: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, fresh, text_or_empty

# Frequent function words of the four languages.
STOP_WORDS = [
    "the", "be", "to", "of", "and", "that", "have", "with", "is", "in", "it", "for", "on", "as", "was", "this",
    "der", "die", "das", "und", "ist", "in", "den", "von", "zu", "mit", "nicht", "ein", "eine", "für",
    "le", "la", "les", "de", "des", "et", "un", "une", "en", "que", "est", "pas", "pour", "au",
    "el", "los", "las", "y", "una", "por", "con", "se", "no", "es",
]
SEEN_AS = sorted({x for w in STOP_WORDS for x in (w, w.capitalize())})


@dataclass(frozen=True)
class Rule:
    """A document fails if `measure` is under `least` or over `most`; shares are compared after multiplication, so nothing is divided."""

    name: str
    part: str
    whole: str | None = None
    least: float | None = None
    most: float | None = None


#: The base rules decide base_failed.
BASE_RULES = (Rule("few_words", "n_words", least=50), Rule("repeated_words", "n_repeat_words", "n_words", most=0.5))
#: The rules of this method; each reads measures of one projection.
METHOD_RULES = (
    Rule("short_words", "word_chars", "n_words", least=2.5),
    Rule("long_words", "word_chars", "n_words", most=12),
    Rule("symbols", "n_symbols", "n_words", most=0.1),
    Rule("shouting", "n_exclaim", "n_words", most=0.3),
    Rule("upper_case", "n_upper", "word_chars", most=0.5),
    Rule("stop_words", "n_stop", least=1),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=0.7),
    Rule("unfinished_lines", "n_ellipsis_lines", "n_lines", most=0.3),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", most=0.9),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_exclaim", "n_upper", "n_stop", "n_lines", "n_ellipsis_lines", "n_bullet_lines")


def failing(rules: tuple[Rule, ...]) -> Column:
    """Whether any rule of the table fails, as one expression."""
    out = F.lit(False)
    for r in rules:
        whole = F.col(r.whole).cast("double") if r.whole else F.lit(1.0)
        part = F.col(r.part).cast("double")
        if r.least is not None:
            out = out | (part < whole * F.lit(float(r.least)))
        if r.most is not None:
            out = out | (part > whole * F.lit(float(r.most)))
    return out


def measure(docs: DataFrame) -> DataFrame:
    """docs with the columns of MEASURES added (those names must not be in docs)."""
    t, w, g, s, real = fresh(docs, "q_text", "q_words", "q_grams", "q_sorted", "q_real")
    out = docs.withColumn(t, text_or_empty())
    inner = F.trim(F.col(t), F.lit(SPACE_CHARS))
    out = out.withColumn(w, F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"[{SPACE}]+")))
    out = out.withColumn(real, F.filter(F.split(t, "\n"), lambda x: F.ltrim(x, F.lit(SPACE_CHARS)) != ""))
    out = out.withColumn(g, F.when(F.size(w) >= 3, F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(F.col(w), i + 1), F.get(F.col(w), i + 2)))).otherwise(F.array().cast("array<bigint>")))
    # only documents with a repeated window need the sort
    out = out.withColumn(s, F.when(F.size(F.array_distinct(g)) < F.size(g), F.array_sort(F.transform(F.col(g), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    less = lambda p: (F.length(t) - F.length(F.regexp_replace(t, p, ""))).cast("long")
    pat = lambda p: F.size(F.filter(real, lambda x: x.rlike(p))).cast("long")
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        less(r"[#*$%&|<>]+").alias("n_symbols"),
        (F.size(real) - F.size(F.array_distinct(real))).cast("long").alias("n_dup_lines"),
        _covered(F.col(s)).alias("n_repeat_words"),
        less("!+").alias("n_exclaim"),
        less(r"\p{Lu}+").alias("n_upper"),
        F.size(F.filter(w, lambda x: x.isin(SEEN_AS))).cast("long").alias("n_stop"),
        F.size(real).cast("long").alias("n_lines"),
        pat(r"(\.\.\.|…)[\x20\x09-\x0D]*$").alias("n_ellipsis_lines"),
        pat(r"^[\x20\x09-\x0D]*[-*•]").alias("n_bullet_lines"),
    )


def _covered(at: Column) -> Column:
    """Words in windows of three that occur at least twice, from the sorted (hash, position) of the windows (null: none).

    The sort makes a document of n words cost n log n steps; windows are compared by 64-bit hash.
    """
    hit = F.transform(at, lambda x, k: F.when(((k > 0) & (x["h"] == F.get(at, k - 1)["h"])) | F.coalesce(x["h"] == F.get(at, k + 1)["h"], F.lit(False)), x["i"]))
    places = F.array_sort(F.filter(hit, lambda i: i.isNotNull()))
    none = F.struct(F.lit(-3).alias("p"), F.lit(0).alias("n"))
    n = F.aggregate(places, none, lambda acc, p: F.struct(p.alias("p"), (acc["n"] + F.least(F.lit(3), p - acc["p"])).alias("n")), lambda acc: acc["n"])
    return F.coalesce(n, F.lit(0)).cast("long")


def quality_rules(docs: DataFrame, base: tuple[Rule, ...] = BASE_RULES, method: tuple[Rule, ...] = METHOD_RULES) -> DataFrame:
    """doc_id, the measures, base_failed and kept for each row of docs.

    Words are runs of characters outside space and \\x09-\\x0D. A null or empty text
    has no words: all measures are 0 and the base rules reject it. Rows are judged
    one by one, so repeated rows and ties change nothing and an empty table gives
    an empty result; other columns of docs, whatever their names, are left out.
    Built-in functions only: one projection, no shuffle.
    """
    rows = docs.toDF(*[c if c in ("doc_id", "text") else f"__extra_{i}" for i, c in enumerate(docs.columns)]).select("doc_id", "text")
    out = measure(rows).drop("text")
    return out.withColumn("base_failed", failing(base)).withColumn("kept", ~F.col("base_failed") & ~failing(method))


def accepted(docs: DataFrame, base: tuple[Rule, ...] = BASE_RULES, method: tuple[Rule, ...] = METHOD_RULES) -> DataFrame:
    """The rows of docs, all columns as they are, that every rule accepts."""
    names = docs.columns
    plain = docs.toDF(*[c if c == "text" else f"__in_{i}" for i, c in enumerate(names)])
    judged = measure(plain).withColumn("__keep", ~failing(base) & ~failing(method))
    # a filter would be pushed below the projection, and the measures computed again in it; a generator stays above
    judged = judged.select("*", F.explode(F.when(F.col("__keep"), F.array(F.lit(1)))).alias("__one"))
    return judged.select(*[F.col("text" if c == "text" else f"__in_{i}").alias(c) for i, c in enumerate(names)])
