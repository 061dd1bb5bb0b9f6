"""Settings as data classes, read from JSON with ``${NAME:-default}`` taken from the environment."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field, fields, is_dataclass


class ConfigurationError(ValueError):
    """A setting is missing, of the wrong kind or does not fit the others."""


@dataclass(frozen=True)
class Chunking:
    target_tokens: int = 400
    overlap_tokens: int = 60
    max_tokens: int = 512
    min_tokens: int = 50
    preserve_page_boundary: bool = True


@dataclass(frozen=True)
class Embedding:
    model_id: str = "hashing-64"
    vector_size: int = 64
    normalize: bool = True


@dataclass(frozen=True)
class Retrieval:
    candidate_count: int = 30
    final_top_k: int = 5
    minimum_score: float = 0.25
    max_chunks_per_document: int = 3


@dataclass(frozen=True)
class Settings:
    root: str = "."
    state: str = "state"
    extensions: tuple[str, ...] = (".txt", ".md", ".docx")
    max_bytes: int = 200 * 1024 * 1024
    context_tokens: int = 4096
    model_tokens: int = 32768
    output_tokens: int = 1024
    chunking: Chunking = field(default_factory=Chunking)
    embedding: Embedding = field(default_factory=Embedding)
    retrieval: Retrieval = field(default_factory=Retrieval)

    def __post_init__(self) -> None:
        c, r = self.chunking, self.retrieval
        object.__setattr__(self, "extensions", tuple((x if x.startswith(".") else f".{x}").lower() for x in self.extensions))
        if not self.root or not self.state:
            raise ConfigurationError("root and state must be given")
        if not 1 <= self.max_bytes <= 2048 * 1024 * 1024:
            raise ConfigurationError("max_bytes must be between 1 and 2 GB")
        if c.max_tokens * r.final_top_k > self.model_tokens - self.output_tokens - 2000:
            raise ConfigurationError("max_tokens * final_top_k does not fit the model's context beside prompt and output")
        if not 0 <= c.overlap_tokens < c.target_tokens <= c.max_tokens:
            raise ConfigurationError("overlap_tokens < target_tokens <= max_tokens does not hold")
        if not 0 < r.final_top_k <= r.candidate_count:
            raise ConfigurationError("final_top_k must be between 1 and candidate_count")
        if not 0 <= r.minimum_score <= 1:
            raise ConfigurationError("minimum_score must be between 0 and 1")


def substitute(value):
    """``${NAME}`` and ``${NAME:-default}`` in all strings of a JSON value; a name that is not set is empty."""
    if isinstance(value, dict):
        return {k: substitute(v) for k, v in value.items()}
    if isinstance(value, list):
        return [substitute(v) for v in value]
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", lambda m: os.environ.get(m[1], m[2] if m[2] is not None else ""), value)
    return value


def _build(cls, data: dict):
    known = {f.name: f for f in fields(cls)}
    if unknown := set(data) - set(known):
        raise ConfigurationError(f"unknown settings: {sorted(unknown)}")
    made = {}
    for k, v in data.items():
        default = known[k].default_factory() if callable(known[k].default_factory) else known[k].default
        made[k] = _build(type(default), v) if is_dataclass(default) else tuple(v) if isinstance(default, tuple) else v
    return cls(**made)


def load_settings(path: str | None = None) -> Settings:
    """From ``path``, or the file that FOLIO_CONFIG names, or ``config/config.{FOLIO_ENV}.json``, or the defaults."""
    path = path or os.environ.get("FOLIO_CONFIG")
    if path is None and os.environ.get("FOLIO_ENV"):
        path = os.path.join("config", f"config.{os.environ['FOLIO_ENV']}.json")
    if path is None:
        return Settings()
    if not os.path.isfile(path):
        raise ConfigurationError(f"no such file: {path}")
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    if not isinstance(data, dict):
        raise ConfigurationError("the settings must be a JSON object")
    return _build(Settings, substitute(data))
