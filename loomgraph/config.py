"""Settings of the engine as plain dataclasses; JSON and YAML files can hold any part of them."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path


@dataclass
class LLMConfig:
    provider: str = "replay"
    model: str = ""
    base_url: str = ""
    temperature: float = 0.1
    max_tokens: int = 4096
    top_p: float = 1.0


@dataclass
class OntologyConfig:
    reasoner: str = "closure"
    enable_reasoning: bool = True
    max_axioms: int = 100_000


@dataclass
class EmbeddingConfig:
    model: str = "hashed-ngrams"
    dimension: int = 768
    batch_size: int = 32
    walk_length: int = 80
    num_walks: int = 10
    window_size: int = 10
    embedding_dim: int = 128
    epochs: int = 10
    return_weight: float = 1.0
    inout_weight: float = 1.0
    seed: int = 42


@dataclass
class VerificationConfig:
    enable_verification: bool = True
    solver: str = "parity"
    timeout: int = 30
    soundness_threshold: float = 0.99
    gate: float = 0.8


@dataclass
class StorageConfig:
    triple_store: str = "memory"
    vector_store: str = "parquet"
    document_store: str = "parquet"


@dataclass
class ExtractionConfig:
    confidence_threshold: float = 0.7
    max_entities: int = 1000
    max_triples: int = 5000
    entity_ns: str = "http://loomgraph.local/entity/"
    property_ns: str = "http://loomgraph.local/property/"


@dataclass
class Config:
    llm: LLMConfig = field(default_factory=LLMConfig)
    ontology: OntologyConfig = field(default_factory=OntologyConfig)
    embedding: EmbeddingConfig = field(default_factory=EmbeddingConfig)
    verification: VerificationConfig = field(default_factory=VerificationConfig)
    storage: StorageConfig = field(default_factory=StorageConfig)
    extraction: ExtractionConfig = field(default_factory=ExtractionConfig)

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, data: dict) -> Config:
        return _fill(cls(), data or {})

    def save(self, path: str) -> None:
        """JSON, which every YAML reader reads too."""
        Path(path).write_text(json.dumps(self.to_dict(), indent=2))

    @classmethod
    def load(cls, path: str) -> Config:
        raw = Path(path).read_text()
        try:
            return cls.from_dict(json.loads(raw))
        except json.JSONDecodeError:
            import yaml

            return cls.from_dict(yaml.safe_load(raw))


def _fill(target, data: dict):
    known = {f.name for f in fields(target)}
    for key, value in data.items():
        if key not in known:
            raise KeyError(f"unknown setting {key!r}")
        current = getattr(target, key)
        setattr(target, key, _fill(current, value) if is_dataclass(current) else value)
    return target
