"""Configuration: nested dataclasses read from TOML; missing files and keys mean defaults."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path


def expand_home(path: str) -> str:
    """A leading ~/ as the home folder; nothing else is expanded."""
    return os.path.join(os.path.expanduser("~"), path[2:]) if path.startswith("~/") else path


@dataclass
class IndexConfig:
    paths: list[str] = field(default_factory=lambda: [expand_home("~/Obsidian")])
    exclude: list[str] = field(default_factory=lambda: ["**/Templates/**", "**/.obsidian/**", "**/attachments/**", "**/*.sync-conflict-*"])


@dataclass
class EmbeddingsConfig:
    ollama_url: str = "http://localhost:11434"
    model: str = "nomic-embed-text"
    dimensions: int = 768


@dataclass
class SearchConfig:
    default_limit: int = 5
    rrf_k: int = 60


@dataclass
class WatchConfig:
    paths: list[str] = field(default_factory=lambda: [expand_home("~/Obsidian")])
    exclude: list[str] = field(default_factory=lambda: ["Templates/", ".obsidian/", "attachments/", ".sync-conflict-"])
    debounce_ms: int = 1500


@dataclass
class RerankConfig:
    enabled: bool = False
    provider: str = "agent"
    candidates: int = 20
    top_k: int = 5
    agent: dict = field(default_factory=dict)
    messages: dict = field(default_factory=dict)
    generate: dict = field(default_factory=dict)


#: Sections of a provider by the names that existing files use.
_SECTIONS = {"claude_code": "agent", "anthropic": "messages", "ollama": "generate"}


@dataclass
class Config:
    index: IndexConfig = field(default_factory=IndexConfig)
    embeddings: EmbeddingsConfig = field(default_factory=EmbeddingsConfig)
    search: SearchConfig = field(default_factory=SearchConfig)
    watch: WatchConfig = field(default_factory=WatchConfig)
    reranking: RerankConfig = field(default_factory=RerankConfig)

    @staticmethod
    def config_path() -> Path:
        base = os.environ.get("XDG_CONFIG_HOME") or os.path.join(os.path.expanduser("~"), ".config")
        return Path(base) / "scrollmine" / "config.toml"

    @staticmethod
    def data_path() -> str:
        base = os.environ.get("XDG_DATA_HOME") or os.path.join(os.path.expanduser("~"), ".local", "share")
        return os.path.join(base, "scrollmine", "store")

    @classmethod
    def load(cls, path: Path | str | None = None) -> Config:
        path = Path(path) if path else cls.config_path()
        return cls.parse(path.read_text()) if path.exists() else cls()

    @classmethod
    def parse(cls, text: str) -> Config:
        data, out = tomllib.loads(text), cls()
        for section in fields(cls):
            own = getattr(out, section.name)
            for key, value in data.get(section.name, {}).items():
                key = _SECTIONS.get(key, key)
                if key in {f.name for f in fields(own)}:
                    setattr(own, key, value)
        return out

    def watch_paths(self) -> list[str]:
        return [expand_home(p) for p in self.watch.paths]

    def index_paths(self) -> list[str]:
        return [expand_home(p) for p in self.index.paths]

    def should_skip_watch(self, path: str) -> bool:
        return any(p in path for p in self.watch.exclude)

    def show(self) -> str:
        """The sections index, embeddings, search and watch, as text."""
        quoted = lambda v: f'"{v}"' if isinstance(v, str) else "[" + ", ".join(f'"{x}"' for x in v) + "]" if isinstance(v, list) else str(v)
        keys = {"index": ["paths", "exclude"], "embeddings": ["ollama_url", "model"], "search": ["default_limit", "rrf_k"], "watch": ["paths", "exclude", "debounce_ms"]}
        parts = [f'Configuration (from "{self.config_path()}"):']
        parts += [f"[{s}]\n" + "\n".join(f"{k} = {quoted(getattr(getattr(self, s), k))}" for k in own) for s, own in keys.items()]
        return "\n\n".join(parts)
