"""Settings of the pipelines, from the environment or a file of KEY=VALUE lines."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path


def read_env_file(path: str) -> dict[str, str]:
    """The settings of a file; blank lines and lines that begin with # are passed over, outer quotes dropped. A missing file has none."""
    p = Path(path)
    lines = p.read_text(encoding="utf-8").splitlines() if p.exists() else []
    pairs = (x.split("=", 1) for x in map(str.strip, lines) if x and not x.startswith("#") and "=" in x)
    return {k.strip(): v.strip().strip("\"'") for k, v in pairs}


def required(name: str, values: dict[str, str] | None = None) -> str:
    """A setting that must be there; an error names it if it is unset or empty."""
    value = (os.environ if values is None else values).get(name)
    if not value:
        raise OSError(f"{name} is not set")
    return value


@dataclass(frozen=True)
class Settings:
    """Sizes and limits that the operators default to."""

    chunk_size: int = 800
    chunk_overlap: int = 200
    chunk_reach: int = 50
    clip_tokens: int = 800
    top_k: int = 5
    fetch_k: int = 5
    grounded_above: float = 0.3
    accept_from: float = 0.6
    answer_temperature: float = 0.2
    answer_tokens: int = 600

    @classmethod
    def of(cls, values: dict[str, str]) -> Settings:
        """Settings from values by name in capitals after LECTERN_ (LECTERN_TOP_K=8); those that aren't given keep their defaults."""
        kinds = {f.name: type(f.default) for f in fields(cls)}
        return cls(**{n: kind(values[k]) for n, kind in kinds.items() if (k := f"LECTERN_{n.upper()}") in values})
