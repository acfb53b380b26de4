"""Scans and point reads. Every order is total: the id comes last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions.visibility import Filter, visible


def scan(df: DataFrame, f: Filter, limit: int, exclude: DataFrame | None = None) -> DataFrame:
    """The newest visible records; excluded ids do not count towards the limit."""
    df = df.where(visible(f))
    if exclude is not None:
        df = df.join(exclude.select("id"), "id", "left_anti")
    return df.orderBy(F.desc("t_event"), "id").limit(limit)


def by_id(df: DataFrame, key: str, deleted: bool = False) -> DataFrame:
    return df.where((F.col("id") == key) & (F.lit(deleted) | ~F.col("deleted")))


def many(df: DataFrame, ids: list[str], where: Column | None = None) -> DataFrame:
    """Records of the caller's ids with their place in the caller's list (from 1)."""
    wanted = df.sparkSession.createDataFrame([(i, n) for n, i in enumerate(ids, 1)], "id string, pos long")
    found = df.join(wanted, "id")
    return found if where is None else found.where(where)


def known(records: DataFrame, erased: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids seen before, be it as records or as erased ones."""
    return ids.join(records.select("id").unionByName(erased.select("id")).distinct(), "id", "left_semi")


def session(df: DataFrame, name: str, user: str | None = None, limit: int | None = None) -> DataFrame:
    """Raw turns of exactly one session, oldest first."""
    keep = (F.col("scope_session") == name) & (F.col("kind") == "raw_event") & ~F.col("deleted") & ~F.col("quarantined")
    if user is not None:
        keep &= F.col("scope_user").isNull() | (F.col("scope_user") == user)
    out = df.where(keep).orderBy("t_event", "ingest_seq")
    return out if limit is None else out.limit(limit)


def ranked(df: DataFrame, *order: Column | str, by: str | None = None, name: str = "rank") -> DataFrame:
    """Number rows from 1, within ``by`` if given."""
    w = Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))
    return df.withColumn(name, F.row_number().over(w.orderBy(*order)).cast("long"))


def neighbours(df: DataFrame, anchors: DataFrame, f: Filter) -> DataFrame:
    """(id, before, after): the visible raw turns next to each anchor in its session.

    Anchors that the filter hides still stand between their neighbours.
    """
    turns = df.where((F.col("kind") == "raw_event") & F.col("scope_session").isNotNull())
    turns = turns.select("id", "scope_session", "t_event", "ingest_seq", visible(f).alias("shown")).join(anchors.select("id", F.lit(True).alias("anchor")), "id", "left")
    turns = turns.where("shown OR anchor")
    w = Window.partitionBy("scope_session").orderBy("t_event", "ingest_seq")
    shown = F.when(F.col("shown"), F.col("id"))
    before = F.last(shown, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(shown, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return turns.select("id", "anchor", before.alias("before"), after.alias("after")).where("anchor").drop("anchor")


def sources_of(df: DataFrame, derived: DataFrame, f: Filter) -> DataFrame:
    """(id, pos, source_id): the visible records a derived record was made from, in lineage order."""
    lines = derived.select("id", F.posexplode("lineage").alias("pos", "source_id"))
    return lines.join(df.where(visible(f)).select(F.col("id").alias("source_id")), "source_id").select("id", F.col("pos").cast("long").alias("pos"), "source_id")


def expand(df: DataFrame, links: DataFrame, seeds: DataFrame) -> DataFrame:
    """Live records one link away from the seeds, in either direction."""
    there = links.join(seeds.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    back = links.join(seeds.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
    reached = there.unionByName(back).distinct().join(seeds.select("id"), "id", "left_anti")
    return df.where(~F.col("deleted")).join(reached, "id", "left_semi")


def stats(df: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: counts of records by state, and of vectors, with the longest and a model of theirs."""
    live = ~F.col("deleted")
    counts = df.agg(
        F.count_if(live).alias("live"), F.count_if("deleted").alias("tombstones"), F.count_if((F.col("kind") == "fact") & live).alias("facts"),
        F.count_if(F.col("invalidated_at").isNotNull() & live).alias("superseded"), F.count_if("quarantined").alias("quarantined"), F.count_if(F.col("kind") == "link").alias("links"),
    )
    return counts.crossJoin(vectors.agg(F.count("*").alias("vectors"), F.max(F.size("vec")).cast("long").alias("dim"), F.max("model").alias("model")))


def stale_vectors(df: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Live records without a vector of the model, short texts first."""
    v = vectors.select("id", F.col("model").alias("has"))
    live = df.where(~F.col("deleted") & F.col("invalidated_at").isNull() & (F.col("kind") != "link"))
    return live.join(v, "id", "left").where(F.col("has").isNull() | (F.col("has") != model))
