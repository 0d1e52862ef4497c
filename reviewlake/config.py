"""Settings, from environment variables with one prefix."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Where tables lie and what searches are allowed; every field can be set as ``REVIEWLAKE_<FIELD>``."""

    root: str = "spark-warehouse"
    embedding_dims: int = 1536
    max_search_limit: int = 50
    pack_budget: int = 12_000
    semantic_limit: int = 20

    def __post_init__(self):
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, int) and v < 1:
                raise ValueError(f"{f.name} must be positive")

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        got = {f.name: env[f"REVIEWLAKE_{f.name.upper()}"] for f in fields(cls) if f"REVIEWLAKE_{f.name.upper()}" in env}
        return cls(**{k: type(getattr(cls, k))(v) for k, v in got.items()})
