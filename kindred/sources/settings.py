"""Settings from environment-style files and fixed defaults."""

from __future__ import annotations

import os
from collections.abc import MutableMapping
from dataclasses import dataclass, fields


def load_env(text: str, env: MutableMapping[str, str] | None = None) -> dict[str, str]:
    """Settings of ``KEY=value`` lines; blank lines and ``#`` lines are skipped, keys already set stay as they are."""
    env = os.environ if env is None else env
    added = {}
    for line in text.splitlines():
        key, eq, value = line.strip().partition("=")
        key = key.strip()
        if not eq or not key or key.startswith("#") or key in env:
            continue
        added[key] = env[key] = value.strip().strip("\"'")
    return added


@dataclass(frozen=True)
class WorkerSettings:
    """Defaults of an embedding worker."""

    max_tokens: int = 512
    min_batch: int = 1
    max_batch: int = 64
    initial_batch: int = 16
    latency_ms: int = 500
    heartbeat_s: int = 30
    breaker_failures: int = 5
    breaker_reset_s: int = 300
    gpu_memory_limit: float = 0.9


@dataclass(frozen=True)
class TokenizerSettings:
    max_tokens: int = 384
    name_weight: float = 1.5
    description_weight: float = 1.0
    taxonomy_weight: float = 0.8
    include_url: bool = True
    include_email: bool = False


@dataclass(frozen=True)
class OrchestratorSettings:
    batch_size: int = 10
    stale_minutes: int = 30
    token_batches: int = 5
    worker_batches: int = 3
    max_retries: int = 3
    poll_seconds: int = 60


def from_env(kind: type, env: MutableMapping[str, str], prefix: str = ""):
    """An instance of a settings class, with fields that the environment names taken from it."""
    values = {}
    for f in fields(kind):
        raw = env.get(f"{prefix}{f.name}".upper())
        if raw is not None:
            default = f.default
            values[f.name] = raw.lower() in ("1", "true", "yes") if isinstance(default, bool) else type(default)(raw)
    return kind(**values)
