"""Settings from the environment, read once when asked for."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


def _env(name: str, default: str):
    return field(default_factory=lambda: os.environ.get(name, default))


@dataclass(frozen=True)
class Settings:
    model_name: str = _env("MODEL_NAME", "offline")
    output_dir: str = _env("DEFAULT_OUTPUT_DIR", "./output/")
    max_workers: int = field(default_factory=lambda: int(os.environ.get("MAX_WORKERS", "3")))
    # Fixed values of the document model.
    table_confidence: float = 0.7
    table_overlap: float = 0.5
    line_kernel: int = 40
    line_threshold: float = 0.3
    most_entities: int = 100
    most_triplets: int = 200
