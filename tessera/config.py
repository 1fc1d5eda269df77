"""Settings with their defaults; every field can come from the environment as TESSERA_<NAME>."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    store: str = "tessera-store"
    chunk_size: int = 2500
    chunk_overlap: int = 300
    chunk_cap: int = 5000
    largest_file: int = 1_048_576
    embed_batch: int = 64
    lock_ttl_minutes: int = 60
    auto_lock_ttl_minutes: int = 480
    sync_seconds: int = 300
    debounce_ms: int = 500
    feed_minutes: int = 60

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Config:
        env = dict(os.environ) if env is None else env
        found = {f.name: env[key] for f in fields(cls) if (key := f"TESSERA_{f.name.upper()}") in env}
        kinds = {f.name: type(f.default) for f in fields(cls)}
        return cls(**{k: kinds[k](v) for k, v in found.items()})
