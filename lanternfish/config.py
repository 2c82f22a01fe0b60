"""Settings from a JSON file: where the tables are, how to rank, and Spark's own settings."""

from __future__ import annotations

import json
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    tables: str = "tables"
    ranking_algo: str = "salsa"
    analyzer: str = "simple"
    batch: int = 360
    force_reindex: bool = False
    spark: dict[str, str] = field(default_factory=dict)


def load(text: str) -> Settings:
    """Settings of a JSON text; unknown names are an error, absent ones keep their defaults."""
    got = json.loads(text)
    if not isinstance(got, dict) or (odd := set(got) - set(Settings.__dataclass_fields__)):
        raise ValueError(f"settings are an object of {sorted(Settings.__dataclass_fields__)}" + (f", not {sorted(odd)}" if isinstance(got, dict) else ""))
    return Settings(**got)
