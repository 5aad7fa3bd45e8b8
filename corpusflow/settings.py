"""Engine defaults. Every operator takes them as keyword arguments, so a job can override each one."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 350
    chunk_overlap: int = 100
    min_chunk: int = 50
    retrieve: int = 15
    rerank: int = 5
    mmr_lambda: float = 0.7
    history: int = 10
    ttl_hours: int = 24
    max_file_bytes: int = 25 * 1024 * 1024
    embedding_dim: int = 64
    min_line: int = 10
    repeated_lines: int = 3


DEFAULTS = Settings()
