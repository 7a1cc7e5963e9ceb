"""One object over a store: everything a client of the engine calls, as DataFrames."""

from __future__ import annotations

import json
import subprocess
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph, quality, resolve, retrieval, search
from .sources import parse, store, walk

#: Seconds for which a staleness count is kept while the repository's head stays.
FRESH = 300


class Engine:
    """A repository and its store. Callables stand for models: embed maps texts to vectors, model a prompt to an answer."""

    def __init__(self, spark: SparkSession, db: str, repo: str | None = None, embed: Callable[[list[str]], list[list[float]]] = retrieval.hashed_embedding, model: Callable[[str], str] | None = None, read_only: bool = False):
        self.spark, self.store, self.repo, self.embed, self.model = spark, store.Store(spark, db, read_only), repo, embed, model
        self._stale: tuple[str, float, int] | None = None

    files = property(lambda self: self.store.table("files"))
    entities = property(lambda self: self.store.table("entities"))
    edges = property(lambda self: self.store.table("edges"))

    def _walked(self) -> DataFrame:
        at = Path(self.repo) / ".gitignore"
        return walk.walk(self.spark, self.repo, at.read_text() if at.exists() else "")

    def index(self, force: bool = False, embed: bool = True, aliases: dict[str, str] | None = None, paths: list[str] | None = None) -> dict[str, int]:
        """Bring the store, or only what it has of `paths`, to the repository's state. Changed files are parsed; if there are any, or aliases, edges of all are resolved anew."""
        walked = self._walked().cache()
        known = walked.select("path")
        if paths is not None:
            known = known.where(F.col("path").isin(paths)).unionAll(self.files.select("path").where(~F.col("path").isin(paths)))
        done = self.store.index(walked, parse.entities_and_edges, lambda e, raw: resolve.resolve(raw, e, known, aliases), force, paths, aliases is not None)
        walked.unpersist()
        if embed:
            self.embed_drifted()
        self._stale = None
        return done

    def reindex(self, paths: list[str] | None = None, **options) -> dict[str, int]:
        """index() of the named files, those that are no more being deleted; of all without names."""
        return self.index(paths=paths, **options)

    def embed_drifted(self, force: bool = False) -> None:
        new = retrieval.embedded(retrieval.drifted(self.entities, force), self.embed)
        self.store.commit(entities=store.apply_updates(self.entities, new, ["embedding", "embedding_hash"]))

    def vector(self, text: str) -> list[float]:
        return self.embed([text])[0]

    def search(self, query: str, limit: int = 10, mode: str = "hybrid") -> DataFrame:
        """literal, semantic or hybrid; each entity with name, file and line."""
        vectors = self.entities.where("embedding is not null")
        if mode == "literal":
            return search.literal_or_fuzzy(self.entities, query, limit)
        has = not vectors.isEmpty()
        hits = search.hybrid(self.entities, vectors if has else None, query if mode == "hybrid" else "", self.vector(query) if has else None, limit)
        return hits.join(self.entities.select("entity_id", "name", "file", "start_line"), "entity_id").orderBy(F.desc("score"), "entity_id")

    def resolve(self, ref: str) -> str | None:
        """The id a reference means: by id or name, else the best hit."""
        row = search.lookup(self.entities, ref).first() or self.search(ref, 5).first()
        return row.entity_id if row else None

    def context(self, queries: list[str], limit: int = 5, max_tokens: int = 1500) -> DataFrame:
        parts = [search.ranks(self.search(q, min(3 * limit, 30)), F.desc("score"), "entity_id").select(F.lit(i).alias("query"), "rank", "entity_id") for i, q in enumerate(queries[:5])]
        out = parts[0]
        for more in parts[1:]:
            out = out.unionAll(more)
        hits = search.merged(out, 30).join(self.entities.select("entity_id", "file"), "entity_id")
        hits = search.ranks(hits.drop("rank").join(out.groupBy("entity_id").agg(F.min(F.struct("rank", "query")).alias("o")), "entity_id"), "o").select("rank", "entity_id", "file")
        return retrieval.packed_context(hits, self.entities, self.edges, limit, max_tokens)

    def entity(self, entity_id: str) -> DataFrame:
        return graph.entity_context(self.edges, entity_id)

    def dependencies(self, ref: str, depth: int = 3) -> DataFrame:
        return graph.dependencies(self.edges, self.entities, self.resolve(ref) or ref, depth)

    def impact(self, ref: str, depth: int = 3, field: str | None = None) -> DataFrame:
        """Callers of a function, usages of a type, or of one field of it."""
        key = self.resolve(ref) or ref
        row = self.entities.where(F.col("entity_id") == key).first()
        if row is not None and field:
            return search.field_usages(self.entities, row.name, field)
        if row is not None and row.type in ("class", "interface", "type_alias"):
            return search.type_usages(self.entities, row.name, key)
        return graph.callers(self.edges, key, depth)

    def trace(self, start: str, goal: str, hops: int = 7) -> DataFrame:
        return graph.path_labels(graph.shortest_path(self.edges, self.resolve(start) or start, self.resolve(goal) or goal, hops), self.entities)

    def cycles(self) -> DataFrame:
        return graph.cycles(graph.file_imports(self.edges, self.entities))

    def smells(self, **limits: int) -> DataFrame:
        return quality.smells(self.edges, self.entities, **limits)

    def dead_code(self, methods: bool = False) -> DataFrame:
        return quality.dead_code(self.edges, self.entities, methods)

    def layers(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return quality.layers_present(self.files), quality.layer_flows(self.edges, self.entities), quality.layer_violations(self.edges, self.entities)

    def owners(self, entity_id: str) -> DataFrame:
        """Authors of an entity's lines, from the repository's history; none if that can't be read."""
        row = self.entities.where(F.col("entity_id") == entity_id).first()
        names: list[str] = []
        if row is not None and self.repo:
            done = subprocess.run(["git", "-C", self.repo, "blame", "--line-porcelain", f"-L{row.start_line},{row.end_line}", "--", row.file], capture_output=True, text=True)
            names = [x[7:] for x in done.stdout.splitlines() if x.startswith("author ")] if done.returncode == 0 else []
        blame = self.spark.createDataFrame([(row.file, n) for n in names] if row else [], "file string, author string")
        return quality.ownership(blame).orderBy(F.desc("lines"), "author")

    def brief(self) -> DataFrame:
        return quality.brief(self.files, self.entities, self.edges)

    def list_files(self, language: str | None = None) -> DataFrame:
        return quality.listed_files(self.files, self.entities, language)

    def status(self) -> dict[str, int]:
        return quality.figures(self.files, self.entities, self.edges).first().asDict() | {"stale": self.stale()}

    def stale(self) -> int:
        """Files changed since they were indexed; kept for a while as long as the repository's head is the same."""
        if not self.repo:
            return 0
        done = subprocess.run(["git", "-C", self.repo, "rev-parse", "HEAD"], capture_output=True, text=True)
        head, now = done.stdout.strip(), time.monotonic()
        if self._stale is None or self._stale[0] != head or now - self._stale[1] > FRESH:
            walked = self._walked()
            n = store.stale(walked, self.files).count() + store.vanished(self.files, walked).count()
            self._stale = (head, now, n)
        return self._stale[2]

    def unsummarized(self, limit: int = 20) -> DataFrame:
        return quality.unsummarized(self.entities, limit)

    def store_summaries(self, items: list[dict[str, str]]) -> int:
        """Set summaries (entity_id, summary), at most 200, blank ones dropped, and embed what changed."""
        good = [(x["entity_id"], x["summary"].strip()) for x in items[:200] if x.get("summary", "").strip()]
        if good:
            new = self.spark.createDataFrame(good, "entity_id string, summary string")
            self.store.commit(entities=store.apply_updates(self.entities, new, ["summary"]))
            self.embed_drifted()
        return len(good)

    def prompt(self, question: str, budget: int = 3000) -> str:
        """The question with the blocks of the entities retrieved for it, within a token budget."""
        hits = retrieval.retrieve(self.entities, self.edges, self.files, self.vector(question))
        ranked = search.ranks(hits, F.desc("score"), "entity_id")
        rows = ranked.join(self.entities, "entity_id").join(graph.outbound(self.edges, hits), "entity_id", "left")
        blocks = rows.select("rank", retrieval.block().alias("block")).withColumn("tokens", F.greatest(F.lit(1), F.floor(F.length("block") / 4)))
        kept = retrieval.within_budget(blocks, budget, F.col("tokens")).orderBy("rank").collect()  # at most 15 rows
        return "\n\n".join([*(r.block for r in kept), f"Question: {question}"])

    def ask(self, question: str) -> str:
        if self.model is None:
            raise ValueError("no model was given")
        return self.model(self.prompt(question))

    def summarize(self, most: int = 3) -> dict[str, str]:
        """A text for each top directory from its most connected entities, and one of those texts."""
        if self.model is None:
            raise ValueError("no model was given")
        rows = graph.representatives(self.edges, self.entities, most).join(self.entities.select("entity_id", "signature"), "entity_id")
        dirs = rows.groupBy("dir").agg(F.concat_ws("\n", F.array_sort(F.collect_list(F.coalesce("signature", "entity_id")))).alias("prompt")).select(F.col("dir").alias("id"), "prompt")
        texts = {r.id: r.answer for r in retrieval.ask(dirs, self.model).collect()}
        return texts | {"overview": self.model("\n\n".join(f"{k}: {v}" for k, v in sorted(texts.items())))}


def as_json(df: DataFrame) -> str:
    return json.dumps([json.loads(x) for x in df.toJSON().collect()])
