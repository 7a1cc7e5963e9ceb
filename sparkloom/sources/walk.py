"""Repository listing: which files are source, and their text, as distributed scans."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

# Languages by file name extension.
EXTENSIONS = {
    ".py": "python", ".pyi": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".go": "go", ".rs": "rust", ".java": "java", ".rb": "ruby", ".php": "php", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hxx": "cpp",
    ".kt": "kotlin", ".kts": "kotlin", ".cs": "csharp", ".scala": "scala", ".sh": "bash", ".bash": "bash", ".ex": "elixir", ".exs": "elixir", ".r": "r", ".jl": "julia",
    ".hs": "haskell", ".ml": "ocaml", ".mli": "ocaml", ".html": "html", ".htm": "html", ".css": "css", ".sql": "sql",
}
# Directories that are never walked.
EXCLUDED = [".git", ".sparkloom", ".hg", ".svn", ".venv", "venv", "env", "node_modules", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", "dist", "build", "wheels", "pip-wheel-metadata", ".next", ".nuxt", ".turbo", ".tox", ".idea", ".vscode", "target", ".eggs", "eggs", "htmlcov", ".coverage"]
SNIFF, LONG_LINE = 8192, 10_000


def language(path: Column) -> Column:
    """Language by extension, null for others."""
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)))


def excluded(path: Column) -> Column:
    """Whether any directory of the path is one that is never walked."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, EXCLUDED)))


def binary(content: Column) -> Column:
    """Whether a NUL is among the first bytes."""
    return F.locate("00", F.regexp_replace(F.hex(F.substring(content, 1, SNIFF)), "(..)", "$1 ")) > 0


def generated(source: Column) -> Column:
    """Whether a line is too long to be written by hand."""
    return F.exists(T.lines(source), lambda x: F.length(x) > LONG_LINE)


def ignore_rules(text: str) -> list[tuple[str, bool]]:
    """Java patterns of a .gitignore and whether each excludes, in order; the last that matches a path decides."""
    out = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        p = line[keep:].replace("\\#", "#")
        only_dir, rooted = p.endswith("/"), "/" in p.rstrip("/")
        p = p.strip("/")
        body, i = "", 0
        while i < len(p):
            if p.startswith("**/", i):
                body, i = body + "(?:.*/)?", i + 3
            elif p.startswith("/**", i) and i + 3 == len(p):
                body, i = body + "/.*", i + 3
            elif p.startswith("**", i):
                body, i = body + ".*", i + 2
            elif p[i] == "*":
                body, i = body + "[^/]*", i + 1
            elif p[i] == "?":
                body, i = body + "[^/]", i + 1
            elif p[i] == "[" and "]" in p[i + 1 :]:
                j = p.index("]", i + 1)
                body, i = body + "[" + p[i + 1 : j].replace("!", "^", 1) + "]", j + 1
            else:
                body, i = body + re.escape(p[i]), i + 1
        out.append((("^" if rooted else "(^|/)") + body + ("/" if only_dir else "(/|$)"), not keep))
    return out


def ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    out = F.lit(False)
    for pattern, exclude in rules:
        out = F.when(path.rlike(pattern), F.lit(exclude)).otherwise(out)
    return out


def kept_paths(paths: DataFrame, rules: list[tuple[str, bool]] = [], column: str = "path") -> DataFrame:  # noqa: B006
    """Paths of known languages outside excluded and ignored places, with their language."""
    p = F.col(column)
    out = paths.withColumn("language", language(p)).where("language is not null").where(~excluded(p))
    return out.where(~ignored(p, rules)) if rules else out


def walk(spark: SparkSession, root: str, gitignore: str = "") -> DataFrame:
    """(path, language, source, hash, loc, modified, generated) of the source files under root; malformed UTF-8 is replaced.

    Nested repositories, that is directories below root with a .git of their own, are left out.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1]
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + re.escape(base) + "/", "")
    files = raw.select(rel.alias("path"), "content", F.col("modificationTime").alias("modified"))
    nested = files.where(F.col("path").rlike(r"/\.git/")).select(F.regexp_extract("path", r"^(.*?)/\.git/", 1).alias("top")).distinct()
    files = files.join(F.broadcast(nested), F.col("path").startswith(F.concat("top", F.lit("/"))), "left_anti")  # a row for each nested repository
    files = kept_paths(files, ignore_rules(gitignore)).where(~binary(F.col("content")))
    source = F.coalesce(F.try_to_utf8("content") if hasattr(F, "try_to_utf8") else F.try_validate_utf8(F.col("content").cast("string")), F.make_valid_utf8(F.col("content").cast("string")))
    out = files.withColumn("source", source).drop("content")
    return out.withColumn("hash", F.sha2("source", 256)).withColumn("loc", F.regexp_count("source", F.lit("\n")) + 1).withColumn("generated", generated(F.col("source")))
