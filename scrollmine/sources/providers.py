"""Embedding and rerank providers: offline ones, and ones over HTTP."""

from __future__ import annotations

import hashlib
import json
import os
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrollmine.functions.text import query_tokens, tokens
from scrollmine.functions.vectors import normalized
from scrollmine.operators.rerank import batch_prompt, parse_scores, single_prompt


def _post(url: str, body: dict, headers: dict | None = None, timeout: float = 120) -> Iterator[dict]:
    """The JSON values of an answer, one for each line that has one."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **(headers or {})})
    with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
        whole = answer.read().decode()
    try:
        yield json.loads(whole)
    except ValueError:
        for line in whole.splitlines():
            if line.strip():
                yield json.loads(line)


class EmbeddingProvider:
    """Texts to vectors of `dimensions` floats. Instances travel to the executors."""

    dimensions = 768

    def embed(self, text: str) -> list[float]:
        raise NotImplementedError

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [self.embed(t) for t in texts]

    def health_check(self) -> bool:
        return True

    def ensure_ready(self) -> None:
        """Make the model available, on the driver, before texts are sent."""


class _Hashes(dict):
    """The first 32 bits of words' MD5; a bounded number is remembered."""

    MOST = 300_000

    def __missing__(self, token: str) -> int:
        value = int.from_bytes(hashlib.md5(token.encode()).digest()[:4], "big")  # noqa: S324
        if len(self) < self.MOST:
            self[token] = value
        return value


_hashes = _Hashes()


class HashingEmbedder(EmbeddingProvider):
    """Feature hashing of tokens: deterministic, offline. hashed_vectors() gives the same as columns."""

    def __init__(self, dimensions: int = 768):
        self.dimensions = dimensions

    def embed(self, text: str) -> list[float]:
        found = query_tokens(text)
        places = np.fromiter(map(_hashes.__getitem__, found), np.int64, len(found)) % self.dimensions
        v = np.bincount(places, minlength=self.dimensions).astype(np.float64)
        norm = np.sqrt((v * v).sum())
        return (v / norm if norm else v).astype(np.float32).tolist()


def hashed_vectors(texts: DataFrame, id_col: str, text_col: str, dimensions: int) -> DataFrame:
    """(id, embedding) by HashingEmbedder's rule, of column functions alone, for texts with tokens.

    Tokens are counted by id and bucket before the shuffle, so at most `dimensions` rows a text travel.
    """
    bucket = (F.conv(F.substring(F.md5("t"), 1, 8), 16, 10).cast("bigint") % dimensions).cast("int")
    counts = texts.select(id_col, F.explode(tokens(text_col)).alias("t")).groupBy(id_col, bucket.alias("b")).agg(F.count("*").cast("float").alias("n"))
    maps = counts.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.coalesce(F.element_at("m", d), F.lit(0.0).cast("float")))
    return maps.select(id_col, vector.alias("v")).select(id_col, normalized("v").alias("embedding"))


class HttpEmbedder(EmbeddingProvider):
    """A local model server: POST {url}/api/embeddings with model and prompt."""

    def __init__(self, url: str = "http://localhost:11434", model: str = "nomic-embed-text", dimensions: int = 768, timeout: float = 120):
        self.url, self.model, self.dimensions, self.timeout = url.rstrip("/"), model, dimensions, timeout

    def embed(self, text: str) -> list[float]:
        answer = next(_post(f"{self.url}/api/embeddings", {"model": self.model, "prompt": text}, timeout=self.timeout))
        if not answer.get("embedding"):
            raise ValueError(f"no embedding in the answer: {str(answer)[:200]}")
        return [float(x) for x in answer["embedding"]]

    def health_check(self) -> bool:
        try:
            with urllib.request.urlopen(f"{self.url}/api/tags", timeout=self.timeout) as answer:  # noqa: S310
                return answer.status == 200
        except OSError:
            return False

    def ensure_ready(self) -> None:
        """Ask for the model, and have it fetched if the server lacks it."""
        try:
            next(_post(f"{self.url}/api/show", {"name": self.model}, timeout=self.timeout))
        except urllib.error.HTTPError:
            for step in _post(f"{self.url}/api/pull", {"name": self.model}, timeout=3600):
                if step.get("error"):
                    raise RuntimeError(step["error"]) from None


def embed_chunks(chunks: DataFrame, provider: EmbeddingProvider) -> DataFrame:
    """(chunk_id, content_hash, embedding, error) of chunks (chunk_id, content), and their bucket if they have one: a failed text has an error and no vector, and stops no other."""
    placed = ["bucket"] if "bucket" in chunks.columns else []

    def run(it):
        for pdf in it:
            rows = []
            for content in pdf["content"]:
                try:
                    v = provider.embed(content)
                    if len(v) != provider.dimensions:
                        raise ValueError(f"{len(v)} dimensions instead of {provider.dimensions}")
                    rows.append((np.asarray(v, np.float32), None))
                except Exception as e:  # noqa: BLE001  kept as that text's error
                    rows.append((None, str(e) or type(e).__name__))
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "content_hash": pdf["content_hash"], "embedding": [v for v, _ in rows], "error": [e for _, e in rows], **{c: pdf[c] for c in placed}})

    rows = chunks.select("chunk_id", F.xxhash64("content").alias("content_hash"), "content", *placed)
    return rows.mapInPandas(run, "chunk_id long, content_hash long, embedding array<float>, error string" + ", bucket int" * len(placed))


class RerankProvider:
    def scores(self, query: str, contents: list[str]) -> list[float]:
        raise NotImplementedError


class OverlapReranker(RerankProvider):
    """Offline: the share of the query's distinct tokens in a text, times ten."""

    def scores(self, query: str, contents: list[str]) -> list[float]:
        wanted = set(query_tokens(query))
        return [10.0 * len(wanted & set(query_tokens(c))) / max(1, len(wanted)) for c in contents]


class AgentReranker(RerankProvider):
    """One prompt for all candidates to an agent: `ask(prompt, model)` yields messages, dicts of type text, result or error.

    Text is gathered until a result; up to 50 messages that can't be read are passed over.
    """

    MOST_BAD = 50

    def __init__(self, ask: Callable[[str, str], Iterator[dict]] | None = None, model: str = "haiku"):
        self.ask, self.model = ask, model

    def answer(self, messages: Iterator) -> str:
        parts, bad = [], 0
        for m in messages:
            kind = m.get("type") if isinstance(m, dict) else None
            if kind == "text":
                parts.append(str(m.get("text", "")))
            elif kind == "result":
                break
            elif kind == "error" or kind is None:
                bad += 1
                if bad > self.MOST_BAD:
                    raise RuntimeError(f"more than {self.MOST_BAD} unreadable messages")
        return "".join(parts)

    def scores(self, query: str, contents: list[str]) -> list[float]:
        if self.ask is None:
            raise RuntimeError("no agent is set for the rerank provider `agent`")
        return parse_scores(self.answer(self.ask(batch_prompt(query, contents), self.model)), len(contents))


class MessagesReranker(RerankProvider):
    """A hosted messages API, a call for each candidate, `concurrency` at a time; a failed one scores 0, and if all fail so does the rerank."""

    def __init__(self, url: str = "https://api.anthropic.com/v1/messages", model: str = "claude-haiku-4-5", api_key_env: str = "ANTHROPIC_API_KEY", concurrency: int = 10, post=_post):
        self.url, self.model, self.api_key_env, self.concurrency, self.post = url, model, api_key_env, concurrency, post

    def _one(self, query: str, content: str, key: str) -> float:
        body = {"model": self.model, "max_tokens": 16, "messages": [{"role": "user", "content": single_prompt(query, content)}]}
        answer = next(iter(self.post(self.url, body, {"x-api-key": key, "anthropic-version": "2023-06-01"})))
        return parse_scores(answer["content"][0]["text"], 1)[0]

    def scores(self, query: str, contents: list[str]) -> list[float]:
        key = os.environ.get(self.api_key_env)
        if not key:
            raise RuntimeError(f"{self.api_key_env} isn't set")
        out, errors = [0.0] * len(contents), []
        with ThreadPoolExecutor(self.concurrency) as pool:
            tasks = [pool.submit(self._one, query, c, key) for c in contents]
            for i, task in enumerate(tasks):
                try:
                    out[i] = task.result()
                except Exception as e:  # noqa: BLE001  the candidate keeps 0
                    errors.append(str(e))
        if contents and len(errors) == len(contents):
            raise RuntimeError(f"all calls failed: {errors[0]}")
        return out


class GenerateReranker(RerankProvider):
    """A local model server: one prompt for all candidates to POST {url}/api/generate."""

    def __init__(self, url: str = "http://localhost:11434", model: str = "llama3.2", post=_post):
        self.url, self.model, self.post = url.rstrip("/"), model, post

    def scores(self, query: str, contents: list[str]) -> list[float]:
        answer = next(iter(self.post(f"{self.url}/api/generate", {"model": self.model, "prompt": batch_prompt(query, contents), "stream": False})))
        if "response" not in answer:
            raise ValueError("no response in the answer")
        return parse_scores(answer["response"], len(contents))


#: Names that configuration files use.
RERANK_ALIASES = {"agent": "agent", "claude-code": "agent", "messages": "messages", "anthropic": "messages", "generate": "generate", "ollama": "generate", "overlap": "overlap"}


def rerank_provider(config, ask=None) -> RerankProvider | None:
    """The provider that a RerankConfig names; None for an unknown name."""
    kind = RERANK_ALIASES.get(config.provider)
    if kind == "agent":
        return AgentReranker(ask, **{k: v for k, v in config.agent.items() if k == "model"})
    if kind == "messages":
        own = dict(config.messages)
        return MessagesReranker(**{"concurrency" if k == "max_concurrent" else k: v for k, v in own.items() if v is not None})
    if kind == "generate":
        return GenerateReranker(**{k: v for k, v in config.generate.items() if v is not None})
    return OverlapReranker() if kind == "overlap" else None
