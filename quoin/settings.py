"""Settings with their defaults; `Settings.load` reads quoin.* from the session's configuration."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    provider_chain: str = ""
    classify_chain: str = ""  # empty: provider_chain
    embed_model: str = ""
    embeddings_enabled: bool = True
    embed_dim: int = 768
    min_interval_sec: float = 4.0
    prompt_version: str = "v2"
    classify_batch_size: int = 8
    embed_batch_size: int = 16
    max_notes_per_run: int = 50
    prefilter_min_score: float = 0.0
    keep_issues: int = 3
    relevance_cut: float = 0.4

    @staticmethod
    def load(spark: SparkSession) -> Settings:
        found = {}
        for f in fields(Settings):
            if (raw := spark.conf.get(f"quoin.{f.name}", None)) is not None:
                kind = type(f.default)
                found[f.name] = raw.lower() in ("1", "true", "yes") if kind is bool else kind(raw)
        return Settings(**found)
