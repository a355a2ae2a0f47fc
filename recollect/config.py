"""Settings with their defaults, read leniently: what cannot be read is the default."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    n_ctx: int = 8192
    max_tokens: int = 1024
    tool_max_iters: int = 2
    trigger: float = 0.9
    seed: str = "both"
    seed_topk: int = 3
    seed_max_tokens: int = 1024
    seed_min_score: float = 0.0
    seed_targeted: str = "graph"
    seed_hops: int = 2
    seed_hop_fanout: int = 2
    seed_hop_min_sim: float = 0.15
    seed_max_chunks: int = 8
    graph_max_df: float = 0.15
    graph_rank: str = "fts"
    route: str = "auto"
    route_mode: str = "keyword"
    max_chunks: int = 64
    force_answer: bool = True
    escalate: bool = True
    fence_notes: bool = True
    mode: str = "auto"
    store_max_entries: int = 50_000
    store_ttl_days: int = 0
    store_guard: int = 4096
    chunk_target: int = 1500
    digest_concurrency: int = 4
    prewarm: bool = True
    prewarm_ratio: float = 0.25
    tail_tokens: int = 2000
    tail_step_tokens: int = 1000
    recap_max_tokens: int = 1024
    pool_slots: int = 8
    evicted: str = "pointer"
    recall_tools: bool = True
    externalize_min_tokens: int = 2000
    label_tool_results: bool = True
    replay_cps: int = 800
    replay_max_ms: int = 4000
    replay_frame_chars: int = 24
    repair: str = "auto"


TRUE, FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


def read(source: Mapping[str, str] | None = None, prefix: str = "RECOLLECT_") -> Settings:
    """Settings from a mapping (the environment, or a session's spark.conf entries) with keys like RECOLLECT_N_CTX."""
    given = os.environ if source is None else source
    told: dict[str, object] = {}
    for f in fields(Settings):
        raw = given.get(prefix + f.name.upper())
        if raw is None:
            continue
        raw = raw.strip()
        kind = type(f.default)
        if kind is bool:
            if raw.lower() in TRUE + FALSE:
                told[f.name] = raw.lower() in TRUE
        elif kind is str:
            told[f.name] = raw
        else:
            try:
                value = kind(raw)
            except ValueError:
                continue
            if value >= 0:
                told[f.name] = value
    return Settings(**told)
