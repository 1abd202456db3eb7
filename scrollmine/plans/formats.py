"""Results and status as text and JSON: on the driver for one query, as columns for batches."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrollmine.functions.text import snippet


def _stripped(content: str, size: int = 200) -> str:
    short = content[:size].strip()
    return f"{short}..." if len(content.encode()) > size else short


def results_text(query: str, rows: list[dict], full: bool = False) -> str:
    out = [f'Found {len(rows)} results for "{query}":\n']
    for i, r in enumerate(rows, 1):
        out.append(f"[{i}] {r['file_path']}:{r['start_line']}-{r['end_line']} (score: {r['score']:.2f})")
        if full:
            out += [f"Section: {r['section']}"] if r["section"] is not None else []
            out.append(f"{r['content']}\n")
        else:
            out.append(f"{_stripped(r['content'])}\n")
    return "\n".join(out)


def results_json(query: str, rows: list[dict]) -> str:
    found = [{"file": r["file_path"], "lines": f"{r['start_line']}-{r['end_line']}", "score": r["score"], "snippet": r["content"], "date": r["date"], "section": r["section"], "memory_type": r["memory_type"]} for r in rows]
    return json.dumps({"query": query, "results": found}, ensure_ascii=False, indent=2)


def results_tool_json(query: str, rows: list[dict]) -> str:
    found = [{"file": r["file_path"], "lines": f"{r['start_line']}-{r['end_line']}", "score": f"{r['score']:.2f}", "section": r["section"], "date": r["date"], "memory_type": r["memory_type"], "content": r["content"]} for r in rows]
    return json.dumps({"query": query, "result_count": len(rows), "results": found}, ensure_ascii=False, indent=2)


def compact_rows(results: DataFrame) -> DataFrame:
    """results (..., rank) with `header` and `snippet`: the compact text as columns."""
    header = F.format_string("[%d] %s:%d-%d (score: %.2f)", "rank", "file_path", "start_line", "end_line", "score")
    return results.withColumn("header", header).withColumn("snippet", snippet("content"))


def json_rows(results: DataFrame) -> DataFrame:
    """(query_id, json): each query's results (query_id, rank, ...) as one JSON text."""
    entry = F.struct(
        F.col("file_path").alias("file"), F.format_string("%d-%d", "start_line", "end_line").alias("lines"), "score", F.col("content").alias("snippet"), "date", "section", "memory_type"
    )
    listed = results.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", entry.alias("r")))).alias("rs"))  # a query's limit of rows
    return listed.select("query_id", F.to_json(F.struct(F.transform("rs", lambda x: x["r"]).alias("results")), {"ignoreNullFields": "false"}).alias("json"))


def coverage(embedded: int, total: int) -> str:
    return f"{embedded / total * 100:.1f}%" if total else "0.0%"


def status_text(stats, embedded: int, database: str, config_path: str, index_paths: list[str], watch_paths: list[str]) -> str:
    listed = lambda paths: "[" + ", ".join(json.dumps(p, ensure_ascii=False) for p in paths) + "]"
    out = ["Status", "======", f"Database: {database}", f"Config: {config_path}", "", f"Index paths: {listed(index_paths)}", f"Watch paths: {listed(watch_paths)}", ""]
    out += [f"Files indexed: {stats.file_count}", f"Chunks stored: {stats.chunk_count}", f"Embeddings: {embedded}/{stats.chunk_count} ({coverage(embedded, stats.chunk_count)})"]
    return "\n".join(out + ([f"Last indexed: {stats.last_indexed}"] if stats.last_indexed else []))


def status_json(stats, embedded: int, database: str, config_path: str, index_paths: list[str], watch_paths: list[str]) -> str:
    return json.dumps(
        {"file_count": stats.file_count, "chunk_count": stats.chunk_count, "embedded_count": embedded, "last_indexed": stats.last_indexed, "database_path": database, "config_path": config_path, "watch_paths": watch_paths, "index_paths": index_paths}, indent=2
    )


def status_tool_json(stats, embedded: int, total: int, database: str) -> str:
    return json.dumps({"files": stats.file_count, "chunks": stats.chunk_count, "embeddings": embedded, "embedding_coverage": coverage(embedded, total) if total else "0%", "last_indexed": stats.last_indexed, "database": database}, indent=2)
