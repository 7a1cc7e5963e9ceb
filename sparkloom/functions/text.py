"""Column expressions on names, paths and source text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a query.
STOPWORDS = ["a", "an", "the", "is", "are", "of", "in", "on", "for", "to", "and", "or", "it", "this", "that", "with", "as", "be", "by", "at", "how", "does", "do", "what", "where", "which", "i", "we", "you"]
# Name endings of generated files.
GENERATED = [".pb.go", "_grpc.pb.go", ".pb.ts", "_pb.ts", "_pb2.py", "_pb2_grpc.py", ".g.dart", ".g.cs", ".g.ts", ".designer.cs", ".freezed.dart", ".min.js", ".bundle.js", "_generated.go", "_generated.py", "_generated.ts", ".generated.ts", ".generated.cs"]
# Patterns of test paths and of decision points, and the parts of an identifier.
TEST_DIR = r"(?i)(^|/)(tests?|specs?|__tests__|__mocks__|mocks?|fixtures?|samples?|examples?|benchmarks?|testdata)(/|$)"
TEST_FILE = r"(^|[_./])(test|tests|spec|specs)([_.]|$)|(Test|Tests|Spec|IT)\.[A-Za-z]+$"
DECISION = r"\b(?:if|elif|for|while|and|or|except|case|catch)\b|&&|\|\|"
SEGMENT = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
# Line ends as Python's splitlines sees them.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def query_terms(query: str) -> list[str]:
    return query.lower().split()


def significant(query: str) -> list[str]:
    """Terms of two letters or more that are no stop words."""
    return [t for t in query_terms(query) if len(t) >= 2 and t not in STOPWORDS]


def segments(name: Column) -> Column:
    """Lower-case parts of an identifier or path: case changes, digits and separators divide it."""
    return F.transform(F.regexp_extract_all(name, F.lit(SEGMENT), F.lit(0)), F.lower)


def is_test_path(file: Column) -> Column:
    base = F.element_at(F.split(file, "/"), -1)
    return F.coalesce(file.rlike(TEST_DIR) | base.rlike(TEST_FILE), F.lit(False))


def is_generated_path(file: Column) -> Column:
    return F.coalesce(F.lower(file).rlike("(" + "|".join(map(re.escape, GENERATED)) + ")$"), F.lit(False))


def complexity(source: Column) -> Column:
    """One more than the decision points in the text."""
    return F.regexp_count(source, F.lit(DECISION)) + 1


def estimated_tokens(text: Column) -> Column:
    n = F.length(text)
    return F.when(F.coalesce(n, F.lit(0)) > 0, F.greatest(F.lit(1), F.floor(n / 4))).otherwise(0).cast("long")


def truncated(text: Column, tokens: int) -> Column:
    return F.substring(text, 1, 4 * tokens)


def normal_route(path: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(F.filter(F.split(F.trim(path), "/"), lambda x: x != ""), "/"))


def lines(text: Column) -> Column:
    """Lines without a last empty one."""
    cut = F.split(text, LINE_END)
    return F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)


def preview(text: Column, most: int = 8, mark: str = "...") -> Column:
    """The first lines, and a mark if there are more."""
    all_lines = lines(text)
    head = F.array_join(F.slice(all_lines, 1, most), "\n")
    return F.when(F.size(all_lines) > most, F.concat(head, F.lit("\n" + mark))).otherwise(head)


def quoted(word: str) -> str:
    """A word as a literal of a Java pattern."""
    return "\\Q" + word.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def words_pattern(word: str) -> str:
    return rf"\b{quoted(word)}\b"


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles; null for a zero vector or different widths."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), F.try_divide(dot(a, b), norm))
