"""Every constant of the engine, with the values that its results depend on."""

from __future__ import annotations

from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class EmbedConfig:
    """The hashed n-gram embedder. dimension = buckets leaves its vectors unprojected, in double precision."""

    dimension: int = 256
    buckets: int = 4096
    seed: int = 42
    word_weight: float = 1.0
    gram_weight: float = 0.5
    pair_weight: float = 1.5
    name: str = "local-hash-embed"


@dataclass(frozen=True)
class GraphConfig:
    facts: bool = True
    synonymy: bool = True
    associations: bool = True
    synonymy_threshold: float = 0.80
    mention_weight: float = 1.0
    argument_weight: float = 0.8
    reciprocal: float = 0.5


@dataclass(frozen=True)
class FlowConfig:
    alpha: float = 2.0
    epsilon: float = 0.01
    step: float = 0.2
    max_rounds: int = 100
    damping: float = 0.85
    seed_threshold: float = 0.20
    max_seeds: int = 10
    fallback_seeds: int = 2
    query_aware: bool = True
    residual_floor: float = 1e-6
    push_floor: float = 1e-7
    incoming_weight: float = 0.5
    seed_weight: float = 0.2
    entity_weight: float = 0.6
    path_depth: int = 3
    path_fan_out: int = 3
    path_floor: float = 0.01


@dataclass(frozen=True)
class RetrievalConfig:
    embed: EmbedConfig = EmbedConfig()
    graph: GraphConfig = GraphConfig()
    flow: FlowConfig = FlowConfig()
    top_k: int = 5
    community_share: float = 0.4
    orphan_share: float = 0.5
    low_share: float = 0.5
    entity_cut: float = 0.2
    boundary: str = "unicode"  # how a word's edge is told: see functions.text


def load_config(path: str | None = None) -> RetrievalConfig:
    """A config from a YAML file with sections embed, graph, flow and the top-level fields. A missing file gives the defaults."""
    if path is None or not Path(path).exists():
        return RetrievalConfig()
    import yaml

    raw = yaml.safe_load(Path(path).read_text()) or {}
    parts = {"embed": EmbedConfig, "graph": GraphConfig, "flow": FlowConfig}
    known = {f.name for f in fields(RetrievalConfig)}
    made = {k: parts[k](**v) if k in parts else v for k, v in raw.items() if k in known}
    return RetrievalConfig(**made)
