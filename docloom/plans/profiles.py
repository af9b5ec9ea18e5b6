"""Profiles: settings of a whole search by kind of collection, adjusted by six answers."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from ..functions.chunking import ChunkConfig
from .search import SearchConfig


@dataclass(frozen=True)
class Profile:
    """What a collection is chunked, searched and answered with."""

    dedup: str
    strategy: str
    chunk_size: int
    chunk_overlap: int
    min_chunk_size: int
    max_chunk_size: int
    architecture: str
    top_k: int
    k1: float
    alpha: float
    fusion: str
    rerank: bool
    temperature: float
    context_chunks: int
    context_tokens: int
    always_retrieve: bool
    rewrites: int
    history: int
    tables: bool = False
    auto_ingest: bool = False
    citations: str = "inline"

    def chunking(self) -> ChunkConfig:
        return ChunkConfig(self.strategy, self.chunk_size, self.chunk_overlap, self.min_chunk_size, self.max_chunk_size)

    def search(self) -> SearchConfig:
        kind = "hybrid" if self.architecture.startswith("hybrid") else self.architecture
        return SearchConfig(kind=kind, top_k=self.top_k, k1=self.k1, alpha=self.alpha, method="rrf" if self.fusion == "rrf" else "weighted")


# The settings of each profile, in the order of the fields above.
PROFILES = {
    "technical_documentation": Profile("exact", "recursive", 512, 100, 50, 2000, "hybrid_rerank", 15, 1.5, 0.3, "rrf", True, 0.1, 5, 4000, False, 1, 10),
    "faq_support": Profile("fuzzy", "paragraph_based", 256, 50, 30, 1000, "semantic", 5, 1.2, 0.8, "weighted_sum", False, 0.3, 3, 2000, False, 0, 15),
    "legal_compliance": Profile("exact", "recursive", 1024, 200, 100, 4000, "hybrid_rerank", 20, 1.2, 0.4, "rrf", True, 0.0, 8, 8000, True, 2, 10),
    "reports_analysis": Profile("exact", "paragraph_based", 768, 100, 50, 3000, "hybrid", 15, 1.5, 0.6, "rrf", False, 0.2, 5, 4000, False, 1, 10),
    "general": Profile("exact", "fixed_size", 512, 50, 30, 2000, "hybrid", 10, 1.5, 0.5, "rrf", False, 0.7, 5, 4000, False, 1, 10),
}
ANSWERS = ("tables", "multi_document", "long_documents", "precision", "frequent_updates", "citations")

_ADJUST = {
    "tables": lambda p: {"tables": True},
    "multi_document": lambda p: {"top_k": p.top_k + 10, "context_chunks": p.context_chunks + 3, "context_tokens": p.context_tokens + 2000, "rewrites": max(p.rewrites, 1)},
    "long_documents": lambda p: {"chunk_size": round(p.chunk_size * 1.5), "chunk_overlap": round(p.chunk_overlap * 1.5), "max_chunk_size": round(p.max_chunk_size * 1.5), "min_chunk_size": p.min_chunk_size * 2},
    "precision": lambda p: {"rerank": True, "temperature": min(p.temperature, 0.1), "alpha": max(0.1, p.alpha - 0.15), "k1": p.k1 + 0.3},
    "frequent_updates": lambda p: {"auto_ingest": True},
    "citations": lambda p: {"citations": "footnote"},
}


def build(name: str, **answers: bool) -> Profile:
    """The profile ``name`` with the adjustments of every answer that is true."""
    if unknown := set(answers) - set(ANSWERS):
        raise ValueError(f"unknown answers: {sorted(unknown)}")
    profile = PROFILES[name]
    for a in ANSWERS:
        if answers.get(a):
            profile = replace(profile, **_ADJUST[a](profile))
    return profile


SECRET = ("api_key", "token", "password")


def export_config(settings: dict, date: str, version: str = "1.0.0") -> str:
    """Settings by section as JSON, without secrets; ``date`` is given, so that exports agree."""
    clean = {k: {n: x for n, x in v.items() if n not in SECRET} | ({"api_key_set": False} if "api_key" in v else {}) if isinstance(v, dict) else v for k, v in settings.items()}
    return json.dumps({"version": version, "export_date": date, "profile": settings.get("profile", "general"), "config": clean}, indent=2, ensure_ascii=False)


def import_config(text: str, current: dict | None = None) -> dict:
    """The settings of an export; over ``current``, sections are merged by their keys and missing ones stay."""
    data = json.loads(text)
    if "version" not in data or "config" not in data:
        raise ValueError("not an exported configuration")
    new = {k: {n: x for n, x in v.items() if n != "api_key_set"} if isinstance(v, dict) else v for k, v in data["config"].items()}
    if current is None:
        return new
    return current | {k: {**current[k], **v} if isinstance(v, dict) and isinstance(current.get(k), dict) else v for k, v in new.items() if v is not None}


def summary(p: Profile) -> dict[str, str]:
    shown = asdict(p)
    return {"chunking": f"{p.strategy}, {p.chunk_size} tokens", "retrieval": p.architecture, **{k: str(shown[k]) for k in ("temperature", "citations")}}
