"""A JSON-RPC server over lines of text, with three tools: search, index, status."""

from __future__ import annotations

import json
import sys
from typing import TextIO

from scrollmine.config import expand_home
from scrollmine.plans import formats

PROTOCOL, NAME, VERSION, LIMIT = "2024-11-05", "scrollmine", "0.1.0", 5


def _text(description: str, **more) -> dict:
    return {"type": "string", "description": description, **more}


TOOLS = [
    {
        "name": "search",
        "description": "Search the indexed documents by keywords and vectors, optionally reranked; returns paths, line numbers and text.",
        "inputSchema": {
            "type": "object",
            "properties": {
                "query": _text("What to search for"),
                "limit": {"type": "integer", "description": f"Most results (default: {LIMIT})", "default": LIMIT},
                "hybrid": {"type": "boolean", "description": "Use vectors too (default: true)", "default": True},
                "rerank": {"type": "boolean", "description": "Rerank the results (default: false)", "default": False},
                "after": _text("Only results from this date on (YYYY-MM-DD)"),
            },
            "required": ["query"],
        },
    },
    {"name": "index", "description": "Index the files that are new or changed.", "inputSchema": {"type": "object", "properties": {"path": _text("A folder to index instead of the configured ones")}}},
    {"name": "status", "description": "How many files, chunks and embeddings the index has, and when it was last updated.", "inputSchema": {"type": "object", "properties": {}}},
]


class Server:
    def __init__(self, engine):
        self.engine = engine

    def tool_search(self, args: dict) -> str:
        query = args.get("query")
        if not isinstance(query, str):
            raise ValueError("query is required")
        flag = lambda key, default: args[key] if isinstance(args.get(key), bool) else default
        limit = args["limit"] if isinstance(args.get("limit"), int) and not isinstance(args.get("limit"), bool) else LIMIT
        after = args.get("after") if isinstance(args.get("after"), str) else None
        rows = self.engine.search(query, limit, after=after, hybrid=flag("hybrid", True), rerank_results=flag("rerank", False))
        return formats.results_tool_json(query, rows)

    def tool_index(self, args: dict) -> str:
        path = args.get("path")
        paths = [expand_home(path)] if isinstance(path, str) else self.engine.config.index_paths()
        files, chunks = self.engine.index(paths, incremental=True)
        return f"Indexed {files} files, {chunks} chunks across {len(paths)} paths"

    def tool_status(self, args: dict) -> str:
        store = self.engine.store
        return formats.status_tool_json(store.stats(), *store.embedding_stats(), store.root)

    def call(self, params: dict) -> dict:
        # clients may know the tools with a prefix, as in x_search
        tool = {"search": self.tool_search, "index": self.tool_index, "status": self.tool_status}.get(str(params.get("name") or "").rpartition("_")[2])
        try:
            if tool is None:
                raise ValueError(f"Unknown tool: {params.get('name') or ''}")
            return {"content": [{"type": "text", "text": tool(params.get("arguments") or {})}]}
        except Exception as e:  # noqa: BLE001  a tool's failure is its answer
            return {"content": [{"type": "text", "text": f"Error: {e}"}], "isError": True}

    def handle(self, line: str) -> dict | None:
        """The answer to a line, or None for notifications and blank lines."""
        if not line.strip():
            return None
        try:
            request = json.loads(line)
        except ValueError as e:
            return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": f"Parse error: {e}"}}
        request = request if isinstance(request, dict) else {}
        method, answer = request.get("method") or "", {"jsonrpc": "2.0", "id": request.get("id")}
        if method.startswith("notifications/"):
            return None
        if method == "initialize":
            return answer | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": NAME, "version": VERSION}}}
        if method == "tools/list":
            return answer | {"result": {"tools": TOOLS}}
        if method == "tools/call":
            return answer | {"result": self.call(request.get("params") or {})}
        return answer | {"error": {"code": -32601, "message": f"Method not found: {method}"}}

    def serve(self, source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
        """One request after another, an answer a line."""
        for line in source:
            answer = self.handle(line)
            if answer is not None:
                sink.write(json.dumps(answer, ensure_ascii=False) + "\n")
                sink.flush()
