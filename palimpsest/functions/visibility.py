"""The one visibility predicate, built from Columns and used by every lane."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scope:
    org: str | None = None
    agent: str | None = None
    user: str | None = None
    session: str | None = None


@dataclass(frozen=True)
class Filter:
    scope: Scope = Scope()
    now: int | None = None
    as_of: int | None = None
    kinds: tuple[str, ...] | None = None
    sources: tuple[int, ...] | None = None
    t_min: int | None = None
    t_max: int | None = None
    entity: str | None = None
    include_quarantined: bool = False

    @property
    def restrictive(self) -> bool:
        """Does the filter narrow anything beyond what is live."""
        return self != Filter(now=self.now, include_quarantined=self.include_quarantined)


def scope_visible(s: Scope) -> Column:
    """What a record binds must match what the query names. A session record without an owner
    is private to its session once the query names a user or a session."""
    parts = [F.col(f"scope_{f}").isNull() | (F.col(f"scope_{f}") == v) for f, v in vars(s).items() if v is not None]
    if s.user is not None or s.session is not None:
        own = F.col("scope_session").isNull() | F.col("scope_user").isNotNull()
        parts.append(own | (F.col("scope_session") == s.session) if s.session is not None else own)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def valid_now(now: int | None) -> Column:
    live = ~F.col("deleted") & F.col("invalidated_at").isNull() & F.col("superseded_by").isNull()
    return live if now is None else live & (F.col("valid_from").isNull() | (F.col("valid_from") <= now))


def valid_as_of(t: int) -> Column:
    """Validity time only: when a record was learned is not asked."""
    return ~F.col("deleted") & (F.col("invalidated_at").isNull() | (F.col("invalidated_at") > t)) & (F.col("valid_from").isNull() | (F.col("valid_from") <= t))


def vector_live() -> Column:
    return ~F.col("deleted") & ~F.col("quarantined") & F.col("invalidated_at").isNull() & F.col("superseded_by").isNull()


def visible(f: Filter) -> Column:
    parts = [scope_visible(f.scope), valid_as_of(f.as_of) if f.as_of is not None else valid_now(f.now)]
    if f.kinds is not None:
        parts.append(F.col("kind").isin(*f.kinds))
    if f.sources is not None:
        parts.append(F.col("source").isin(*f.sources))
    if f.t_min is not None:
        parts.append(F.col("t_event") >= f.t_min)
    if f.t_max is not None:
        parts.append(F.col("t_event") <= f.t_max)
    if f.entity is not None:
        parts.append(F.array_contains("entity_keys", f.entity))
    if not f.include_quarantined:
        parts.append(~F.col("quarantined"))
    return reduce(lambda a, b: a & b, parts)


def fenced() -> Column:
    """Shown as data, never as instructions."""
    return (F.col("source") <= 3) | F.coalesce("quarantined", F.lit(False))


def without(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Drop the ids of a frame before any limit."""
    return df.join(ids.select("id"), "id", "left_anti")
