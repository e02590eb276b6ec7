"""Similarity, ranking signals and state rules as column expressions."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.model import OBJECT_TYPES, WEIGHTS


def _double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of unequal length, of no length, or null."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm), F.lit(0.0))


def cosine_to(v: Column, query: list[float]) -> Column:
    """cosine against a fixed vector, whose norm is worked out once."""
    norm = math.sqrt(sum(x * x for x in query))
    q = F.array(*map(F.lit, map(float, query)))
    own = F.sqrt(dot(v, v))
    return F.coalesce(F.when((F.size(v) == len(query)) & (own > 0) & F.lit(norm > 0), dot(v, q) / (own * F.lit(norm))), F.lit(0.0))


def graph_score(degree: Column) -> Column:
    return F.least(F.log1p(F.coalesce(degree, F.lit(0))) / 5, F.lit(1.0))


def recency(created_at: Column, as_of: Column) -> Column:
    """exp(-0.03 age in days); missing 0; future above 1."""
    return F.coalesce(F.exp(-0.03 * (F.unix_micros(as_of) - F.unix_micros(created_at)) / F.lit(8.64e10)), F.lit(0.0))


def combined(signals: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    return F.round(sum((F.lit(float(weights[k])) * c for k, c in signals.items()), F.lit(0.0)), 4)


def tier(current: Column, summary: Column, confidence: Column) -> Column:
    return F.when(current == "reflex", "reflex").when((summary != "") & (confidence > 0), "recall").otherwise("archive")


def node_size(degree: Column) -> Column:
    return F.greatest(F.lit(20), F.least(F.lit(50), 20 + 5 * degree))


def size_bucket(ratio: Column) -> Column:
    return F.when(ratio >= 0.8, "xl").when(ratio >= 0.5, "lg").when(ratio >= 0.2, "md").otherwise("sm")


def classified(kind: Column, confidence: Column) -> tuple[Column, Column]:
    """(type, confidence): an unknown type becomes idea with confidence at most 0.3; confidence within 0 and 1."""
    bounded = F.least(F.greatest(F.coalesce(confidence, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    known = F.coalesce(kind.isin(*OBJECT_TYPES), F.lit(False))
    return F.when(known, kind).otherwise("idea"), F.when(known, bounded).otherwise(F.least(bounded, F.lit(0.3)))


def rebalance(weights: dict[str, float]) -> dict[str, float]:
    """Each at least 0.05, then shares of their sum."""
    held = {k: max(v, 0.05) for k, v in weights.items()}
    total = sum(held.values())
    return {k: round(v / total, 4) for k, v in held.items()}


def valid_weights(text: str | None) -> dict[str, float]:
    """Stored weights, or the defaults where they are corrupt, negative, not numbers or all zero; missing ones take their default."""
    try:
        found = json.loads(text or "")
    except ValueError:
        return dict(WEIGHTS)
    if not isinstance(found, dict):
        return dict(WEIGHTS)
    out = {k: found.get(k, v) for k, v in WEIGHTS.items()}
    if any(isinstance(v, bool) or not isinstance(v, (int, float)) or v < 0 for v in out.values()) or not sum(out.values()):
        return dict(WEIGHTS)
    return out
