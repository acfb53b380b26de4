"""Query classes and lane weights, for one query on the driver or for a batch as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that decide a query's class, first match wins, and its lane weights.
CLASSES = (
    ("temporal", r"(?i)\b(when|yesterday|today|tomorrow|last (?:week|month|year)|next (?:week|month|year)|\d{4}-\d{2}-\d{2}|before|after|ago|recently|since|until)\b"),
    ("procedural", r"(?i)\b(how (?:do|to|did|can)|steps?|procedure|command|deploy|build|run|install|configure|setup|set up|workflow|instructions)\b"),
    ("factual", r"(?i)\b(what|who|where|which|whose|why)\b"),
)
RECENCY = r"(?i)\b(recent|recently|latest|lately|newest|last time|most recent|just now|yesterday|today|this (?:week|morning)|so far)\b"
WEIGHTS = {
    "temporal": {"vector": 0.8, "bm25": 1.2, "time": 1.4, "entity": 0.6},
    "procedural": {"vector": 0.9, "bm25": 1.3, "time": 0.5, "entity": 0.6},
    "factual": {"vector": 1.0, "bm25": 1.0, "time": 0.4, "entity": 0.6},
    "exploratory": {"vector": 1.2, "bm25": 0.8, "time": 0.6, "entity": 0.8},
}
PROCEDURAL_KINDS = ("raw_event", "procedure", "fact", "summary")
LANES = ("bm25", "entity", "time", "vector")


def plan(query: str) -> dict:
    """The plan of one query on the driver: class, hits per lane, kinds, and whether recency is asked."""
    qclass = next((name for name, words in CLASSES if re.search(words, query, re.ASCII)), "exploratory")
    return {"qclass": qclass, "k": 60 if qclass == "exploratory" else 40, "kinds": PROCEDURAL_KINDS if qclass == "procedural" else None, "recent": bool(re.search(RECENCY, query, re.ASCII))}


def classify(text: Column) -> Column:
    out = F.lit("exploratory")
    for name, words in reversed(CLASSES):
        out = F.when(text.rlike(words), name).otherwise(out)
    return out


def wants_recent(text: Column, t_min: Column | None = None, t_max: Column | None = None) -> Column:
    """Is the time lane asked: by its words, or by an explicit bound."""
    bounds = [b.isNotNull() for b in (t_min, t_max) if b is not None]
    out = text.rlike(RECENCY)
    for b in bounds:
        out = out | b
    return out


def candidate_k(qclass: Column, k: int = 40) -> Column:
    return F.when(qclass == "exploratory", int(k * 1.5)).otherwise(k)


def weight(qclass: Column, lane: Column) -> Column:
    """The weight of a lane for a class."""
    out = F.lit(1.0)
    for name, ws in WEIGHTS.items():
        for key, w in ws.items():
            out = F.when((qclass == name) & (lane == key), w).otherwise(out)
    return out


def kinds(qclass: Column) -> Column:
    """The kinds a class is restricted to, or null."""
    return F.when(qclass == "procedural", F.array(*[F.lit(k) for k in PROCEDURAL_KINDS]))
