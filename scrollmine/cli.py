"""Commands: search, embed, index, status, watch, config, serve; a bare query searches."""

from __future__ import annotations

import argparse
import sys

from scrollmine.api import Engine
from scrollmine.config import Config
from scrollmine.mcp import Server
from scrollmine.plans import formats

COMMANDS = ("search", "embed", "index", "status", "watch", "config", "serve")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="scrollmine", description="Search collections of documents.")
    sub = p.add_subparsers(dest="command")
    s = sub.add_parser("search", help="search the index")
    s.add_argument("query")
    s.add_argument("-l", "--limit", type=int)
    s.add_argument("-f", "--format", choices=("compact", "full", "json"), default="compact")
    for name, text in (("--after", "least date, inclusive"), ("--project", "part of the section"), ("--file", "glob over paths"), ("--rerank-provider", "agent, messages, generate or overlap")):
        s.add_argument(name, help=text)
    s.add_argument("--hybrid", action="store_true")
    s.add_argument("--rerank", action="store_true", default=None)
    e = sub.add_parser("embed", help="make vectors")
    e.add_argument("--incremental", action="store_true")
    e.add_argument("--limit", type=int)
    i = sub.add_parser("index", help="index files")
    i.add_argument("--path")
    i.add_argument("--file")
    i.add_argument("--incremental", action="store_true")
    i.add_argument("--prune", action="store_true")
    sub.add_parser("status", help="numbers of the index").add_argument("--json", action="store_true")
    sub.add_parser("watch", help="index changes as they come")
    sub.add_parser("config", help="show the configuration").add_argument("action", choices=("show", "path"))
    sub.add_parser("serve", help="answer JSON-RPC requests on standard input")
    return p


def main(argv: list[str] | None = None, engine: Engine | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    p = parser()
    if argv and argv[0] not in COMMANDS and not argv[0].startswith("-"):
        argv = ["search", " ".join(argv)]
    a = p.parse_args(argv)
    if a.command is None:
        p.print_help()
        return 0
    if a.command == "config":
        print(Config.config_path() if a.action == "path" else Config.load().show())
        return 0
    engine = engine or Engine()
    if a.command == "search":
        rows = engine.search(a.query, a.limit, a.after, a.project, a.file, a.hybrid, a.rerank or (True if a.rerank_provider else None), a.rerank_provider)
        print(formats.results_json(a.query, rows) if a.format == "json" else formats.results_text(a.query, rows, a.format == "full"))
    elif a.command == "embed":
        done, failed = engine.embed(a.incremental, a.limit)
        print(f"Embedded {done} chunks, {failed} errors")
    elif a.command == "index":
        files, chunks = engine.index([a.path] if a.path else None, a.incremental, a.file, a.prune)
        print(f"Indexed {files} files, {chunks} chunks")
    elif a.command == "status":
        print(engine.status(a.json))
    elif a.command == "watch":
        engine.watch().awaitTermination()
    elif a.command == "serve":
        Server(engine).serve()
    return 0


if __name__ == "__main__":
    sys.exit(main())
