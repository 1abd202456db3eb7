"""The engine behind one object: search, index, embed, status, watch."""

from __future__ import annotations

import logging

from pyspark.sql import SparkSession

from scrollmine.config import Config, expand_home
from scrollmine.operators.filters import SearchOptions
from scrollmine.operators.rerank import rerank
from scrollmine.plans import formats
from scrollmine.plans.store import Store
from scrollmine.session import session
from scrollmine.sources.providers import EmbeddingProvider, HttpEmbedder, rerank_provider
from scrollmine.streaming.watch import watch

log = logging.getLogger(__name__)


class Engine:
    def __init__(self, config: Config | None = None, spark: SparkSession | None = None, root: str | None = None, embedder: EmbeddingProvider | None = None, ask=None):
        self.config = config or Config.load()
        self.spark = spark or session()
        self.embedder = embedder or HttpEmbedder(self.config.embeddings.ollama_url, self.config.embeddings.model, self.config.embeddings.dimensions)
        self.ask = ask
        self.store = Store(self.spark, root or self.config.data_path(), self.embedder.dimensions)

    def search(
        self,
        query: str,
        limit: int | None = None,
        after: str | None = None,
        project: str | None = None,
        file_pattern: str | None = None,
        hybrid: bool = False,
        rerank_results: bool | None = None,
        provider: str | None = None,
        filter_hybrid: bool = False,
    ) -> list[dict]:
        """The best results for a query, as dicts of the result schema.

        Filters act on keyword search; on hybrid search with filter_hybrid alone. A hybrid search without any vector
        in the store is a keyword search. With reranking, more candidates are fetched and reordered.
        """
        limit = self.config.search.default_limit if limit is None else limit
        options = SearchOptions(after, project, file_pattern)
        again = self.config.reranking.enabled if rerank_results is None else rerank_results
        fetch = max(self.config.reranking.candidates, limit) if again else limit
        if hybrid and self.store.embedding_stats()[0] == 0:
            log.warning("no embeddings yet: keyword search instead")
            hybrid = False
        if hybrid:
            found = self.store.search_hybrid(query, self.embedder.embed(query), fetch, self.config.search.rrf_k, options if filter_hybrid else None)
        else:
            found = self.store.search_keyword(query, fetch, options)
        rows = [r.asDict() for r in found.collect()]
        if not again or not rows:
            return rows[:limit]
        own = self.config.reranking
        chosen = rerank_provider(own if provider is None else type(own)(**{**vars(own), "provider": provider}), self.ask)
        return rerank(query, rows, chosen, limit, own.candidates)

    def index(self, paths: list[str] | None = None, incremental: bool = False, file: str | None = None, prune: bool = False) -> tuple[int, int]:
        """Index a file, or trees (all of them, or what changed); returns (files, chunks) in the store."""
        roots = [expand_home(p) for p in paths] if paths else self.config.index_paths()
        if file is not None:
            failed = self.store.index_file(expand_home(file))
        elif incremental:
            failed = self.store.index_incremental(roots, self.config.index.exclude, prune)
        else:
            failed = self.store.index_full(roots, self.config.index.exclude)
        for r in failed.collect():
            log.warning("%s: %s", r["file_path"], r["error"])
        stats = self.store.stats()
        return stats.file_count, stats.chunk_count

    def embed(self, incremental: bool = True, limit: int | None = None) -> tuple[int, int]:
        if not self.embedder.health_check():
            raise RuntimeError("the embedding provider doesn't answer")
        return self.store.embed(self.embedder, limit, everything=not incremental)

    def status(self, as_json: bool = False) -> str:
        write = formats.status_json if as_json else formats.status_text
        return write(self.store.stats(), self.store.embedding_stats()[0], self.store.root, str(self.config.config_path()), self.config.index_paths(), self.config.watch_paths())

    def watch(self, embed: bool = False):
        return watch(self.store, self.config.watch_paths(), self.config.watch.exclude, self.config.watch.debounce_ms, embedder=self.embedder if embed else None)
