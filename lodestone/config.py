"""Run settings: JSON files that extend others, merged deeply; repeated and unknown keys are errors."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from pathlib import Path


def _unique(pairs: list[tuple[str, object]]) -> dict:
    out: dict = {}
    for key, value in pairs:
        if key in out:
            raise ValueError(f"the key {key!r} is repeated")
        out[key] = value
    return out


def deep_merge(base: dict, over: dict) -> dict:
    out = dict(base)
    for key, value in over.items():
        out[key] = deep_merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def load_settings(path: str | Path, seen: tuple[str, ...] = ()) -> dict:
    path = Path(path).resolve()
    if str(path) in seen:
        raise ValueError(f"{path} extends itself")
    own = json.loads(path.read_text(encoding="utf-8"), object_pairs_hook=_unique)
    parent = own.pop("extends", None)
    return deep_merge(load_settings(path.parent / parent, (*seen, str(path))), own) if parent else own


#: Names of retrievers in run settings (fixed names): what each does, and how its text leg cuts words.
RETRIEVERS = {
    "dense": ("dense", "plain"),
    "bm25": ("bm25", "plain"),
    "hybrid_rrf": ("hybrid", "plain"),
    "category_aware_dense": ("category", "plain"),
    "adaptive_category_aware_dense": ("adaptive", "plain"),
    "elasticsearch_dense": ("dense", "german"),
    "elasticsearch_hybrid_rrf": ("hybrid", "german"),
    "adaptive_category_aware_hybrid_rrf": ("adaptive_hybrid", "german"),
}
#: Retrievers that need a predicted category, and those that only one kind of index serves.
NEED_CATEGORY = ("category_aware_dense", "adaptive_category_aware_dense", "adaptive_category_aware_hybrid_rrf")
ONLY_INDEX = {"elasticsearch_dense": "elasticsearch", "elasticsearch_hybrid_rrf": "elasticsearch", "adaptive_category_aware_hybrid_rrf": "elasticsearch"}


def check_combination(retriever: str, index: str, orchestrated: bool, dense_backend: str | None = None) -> None:
    """Raise for a retriever that an index can't serve, or that lacks the category it needs."""
    if retriever not in RETRIEVERS:
        raise ValueError(f"unknown retriever {retriever!r}")
    if index not in ("faiss", "pgvector", "elasticsearch"):
        raise ValueError(f"unknown index {index!r}")
    if ONLY_INDEX.get(retriever, index) != index:
        raise ValueError(f"{retriever} needs the index {ONLY_INDEX[retriever]}, not {index}")
    if retriever == "dense" and index == "elasticsearch":
        raise ValueError("the elasticsearch index is searched by elasticsearch_dense or elasticsearch_hybrid_rrf")
    if retriever == "hybrid_rrf" and dense_backend in ("faiss", "pgvector") and dense_backend != index:
        raise ValueError(f"the dense leg's backend {dense_backend} isn't the index {index}")
    if retriever in NEED_CATEGORY and not orchestrated:
        raise ValueError(f"{retriever} needs orchestration, which predicts the category")


def duplicates_in(values: list[str], what: str) -> None:
    """Raise if a name occurs twice."""
    again = sorted({v for v in values if values.count(v) > 1})
    if again:
        raise ValueError(f"repeated {what}: {', '.join(again)}")


def differences(base: dict, other: dict, path: str = "") -> dict[str, tuple]:
    """Dotted paths at which two settings differ, with both values; None where one has nothing."""
    out: dict[str, tuple] = {}
    for key in sorted({*base, *other}):
        at = f"{path}.{key}" if path else str(key)
        a, b = base.get(key), other.get(key)
        if isinstance(a, dict) and isinstance(b, dict):
            out |= differences(a, b, at)
        elif a != b:
            out[at] = (a, b)
    return out


def resume_conflicts(before: dict, now: dict, keys: tuple[str, ...]) -> list[str]:
    """Which of the ``keys`` (dotted) a run can't be resumed over, as they have changed."""

    def at(settings: dict, key: str):
        for part in key.split("."):
            settings = settings.get(part) if isinstance(settings, dict) else None
        return settings

    return [k for k in keys if at(before, k) != at(now, k)]


def primary_k(ks: list[int], explicit: dict[str, int] | None = None, metric: str = "") -> int:
    """The cut that a metric is reported at: the one stated for it, else 5, else the largest."""
    if not ks:
        raise ValueError("no cuts")
    return (explicit or {}).get(metric) or (5 if 5 in ks else max(ks))


@dataclass(frozen=True)
class RetrievalSettings:
    retriever: str = "hybrid"
    top_k: int = 5
    fetch_k: int = 20
    rrf_k: int = 60
    k1: float = 1.5
    b: float = 0.75
    probe_k: int = 20
    minimum_category_share: float = 0.5
    minimum_category_count: int = 3
    minimum_margin: int = 1
    analyzer: str = "plain"
    metric: str = "cosine"
    dense_fetch_k: int = 0
    bm25_fetch_k: int = 0
    dense_weight: float = 1.0
    bm25_weight: float = 1.0
    validate_routing: bool = True
    rerank_top_k: int = 0
    dedupe_by: str = ""

    @classmethod
    def of(cls, settings: dict) -> RetrievalSettings:
        """``retriever`` may be a name of ``RETRIEVERS`` or what it stands for."""
        unknown = set(settings) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        settings = dict(settings)
        if settings.get("retriever") in RETRIEVERS:
            kind, analyzer = RETRIEVERS[settings["retriever"]]
            settings = {"analyzer": analyzer} | settings | {"retriever": kind}
        made = cls(**settings)
        if made.retriever not in ("dense", "bm25", "hybrid", "category", "adaptive", "adaptive_hybrid"):
            raise ValueError(f"unknown retriever {made.retriever!r}")
        if made.analyzer not in ("plain", "german"):
            raise ValueError(f"unknown analyzer {made.analyzer!r}")
        if made.fetch_k < made.top_k:
            raise ValueError("fetch_k must not be less than top_k")
        return made
