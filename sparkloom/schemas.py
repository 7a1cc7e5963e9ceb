"""Explicit schemas of the stored tables."""

from __future__ import annotations

FILES = "path string, language string, hash string, loc int, indexed_at timestamp"
ENTITIES = (
    "entity_id string, type string, name string, qualified_name string, language string, file string, start_line int, end_line int, "
    "start_col int, end_col int, raw_source string, docstring string, signature string, is_exported boolean, is_async boolean, "
    "parent_id string, hash string, summary string, embedding array<float>, embedding_hash string"
)
EDGES = "src_id string, dst_id string, type string, line int, confidence float, is_dynamic boolean"
RAW_EDGES = f"{EDGES}, file string"
EDGE_KEY = ["src_id", "dst_id", "type", "line"]
# Id prefixes of the languages.
PREFIX = {
    "python": "py", "typescript": "ts", "javascript": "js", "go": "go", "rust": "rs", "java": "java", "ruby": "rb", "php": "php",
    "c": "c", "cpp": "cpp", "kotlin": "kt", "csharp": "cs", "scala": "scala", "bash": "sh", "elixir": "ex", "r": "r", "julia": "jl",
    "haskell": "hs", "ocaml": "ml", "html": "html", "css": "css", "sql": "sql",
}
