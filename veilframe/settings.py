"""Options of an engine, with the environment variables that set them."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Inert options (language and the like) live on requests and templates."""

    pseudonym_secret: str = ""
    token_id_len: int = 6
    chunk_enabled: bool = True
    chunk_target: int = 8000
    chunk_overlap: int = 200
    chunk_max_parallel: int = 2
    llm_concurrency: int = 1
    llm_timeout_s: int = 60
    llm_temperature: float = 0.0
    llm_max_tokens: int = 512
    llm_keep_alive: str = "10m"
    llm_base_url: str = "http://localhost:11434"
    llm_fallback_urls: tuple[str, ...] = ()

    @property
    def parallelism(self) -> int:
        """Model calls at a time in one task."""
        return min(self.chunk_max_parallel, max(1, self.llm_concurrency))

    @classmethod
    def from_env(cls, prefix: str = "VEILFRAME_") -> Settings:
        """Each option from PREFIX + its name in capitals; the secret is required."""
        kinds = {bool: lambda s: s.strip().lower() in ("1", "true", "yes", "on"), tuple: lambda s: tuple(x.strip() for x in s.split(",") if x.strip())}
        got = {}
        for f in fields(cls):
            raw = os.environ.get(prefix + f.name.upper())
            if raw is not None:
                kind = type(f.default)
                got[f.name] = kinds.get(kind, kind)(raw)
        if not got.get("pseudonym_secret"):
            raise ValueError(f"{prefix}PSEUDONYM_SECRET must be set")
        return cls(**got)
