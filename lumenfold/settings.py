"""Settings: defaults, then the environment, then what is given."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    decay: float = 0.7
    theme_min_share: float = 0.2
    max_theme_topics: int = 3
    theme_expire_after: int = 4
    theme_confirm_turns: int = 2
    max_subtopics: int = 3
    min_confidence: float | None = None
    cache_hours: float = 72.0
    results: int = 3
    offline: bool = False


def _read(kind: str, text: str):
    text = text.strip()
    if kind == "bool":
        return text.lower() in ("1", "true", "yes", "on")
    if "None" in kind and text.lower() in ("", "none", "model"):
        return None
    return int(text) if kind == "int" else float(text)


def load(prefix: str = "LUMENFOLD_", environment: dict[str, str] | None = None, **given) -> Settings:
    """Settings with the given values over those of the environment over the defaults."""
    env = os.environ if environment is None else environment
    found = {f.name: _read(str(f.type), env[prefix + f.name.upper()]) for f in fields(Settings) if prefix + f.name.upper() in env}
    return Settings(**{**found, **given})
