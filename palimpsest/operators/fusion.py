"""Weighted reciprocal-rank fusion and the order in which candidates are packed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.operators.lanes import content_key, ordered, top
from palimpsest.plans import planner
from palimpsest.sources.store import Store

# Fixed values of the scoring rule.
RRF_K, TRUST = 60, 0.01
KIND_BONUS = (("fact", 1.15), ("summary", 1.05), ("pin", 1.2))
HALF_LIFE_DAYS, FACT_BOOST = 365.0, 1.25
STRONG_COSINE, FLOOR_MARGIN, FLOOR_LEAST = 0.35, 0.1, 5
# Hits of a lane in a sweep, which must see every match.
SWEEP_LIMIT = 10_000


def fuse(lanes: dict[str, DataFrame], queries: DataFrame, records: DataFrame, limit: int = 50) -> DataFrame:
    """(query_id, id, score, lanes, rank) from lanes of (query_id, id, rank)."""
    hits = reduce(DataFrame.unionByName, [df.select("query_id", "id", "rank", F.lit(n).alias("lane")) for n, df in lanes.items()])
    plans = queries.select("query_id", planner.classify(F.col("text")).alias("qclass"))
    hits = hits.join(plans, "query_id").withColumn("part", planner.weight(F.col("qclass"), F.col("lane")) / (RRF_K + F.col("rank")))
    sums = hits.groupBy("query_id", "id").agg(F.sum("part").alias("raw"), F.array_sort(F.collect_set("lane")).alias("lanes"))
    keys = records.select("id", "kind", "source", "t_event", "content")
    kind = reduce(lambda c, kb: F.when(F.col("kind") == kb[0], kb[1]).otherwise(c), KIND_BONUS, F.lit(1.0))
    bonus = F.greatest(1 + F.greatest(TRUST * (F.col("source") - 3), F.lit(0.0)), kind)
    sums = Store(records.sparkSession).save(sums)  # few: known to be, so the records need not be dealt by id
    scored = sums.join(keys, "id").withColumn("score", F.round(F.col("raw") * bonus, 9)).withColumn("content_key", content_key())
    return top(scored, limit, *ordered(F.col("score"))).select("query_id", "id", "score", F.array_join("lanes", ",").alias("lanes"), "rank")


def recency_boost(score: Column, t_event: Column, now: Column) -> Column:
    """A record of a year ago keeps half its score."""
    age = F.greatest(F.lit(0.0), (now - t_event) / F.lit(86_400_000.0))
    return score * F.pow(F.lit(0.5), age / HALF_LIFE_DAYS)


def packing_order(fused: DataFrame, records: DataFrame, now: int | None = None, judged: DataFrame | None = None) -> DataFrame:
    """(query_id, id, pack_score, place): candidates as they are packed.

    Turns that a candidate fact was made from, or whose value it replaced, are left out. Judged
    candidates (query_id, id, p) lead in the judge's order; the rest follow by boosted score.
    """
    facts = "kind", "t_event", "lineage", "demotes", "content"
    c = fused.select("query_id", "id", "score", F.col("rank").alias("input")).join(records.select("id", *facts), "id")
    # The newest candidate counts even if it is left out below.
    ref = F.lit(now) if now is not None else F.max("t_event").over(Window.partitionBy("query_id"))
    c = c.withColumn("ref", ref)
    said = c.where("kind = 'fact'").select("query_id", F.explode(F.array_union(F.coalesce("lineage", F.array().cast("array<string>")), F.coalesce("demotes", F.array().cast("array<string>")))).alias("id"), F.lit(True).alias("said")).distinct()
    c = c.join(said, ["query_id", "id"], "left").where(~((F.col("kind") == "raw_event") & F.coalesce("said", F.lit(False))))
    ref = F.col("ref")
    c = c.join(judged.select("query_id", "id", "p"), ["query_id", "id"], "left") if judged is not None else c.withColumn("p", F.lit(None).cast("double"))
    own = recency_boost(F.col("score"), F.col("t_event"), ref) * F.when(F.col("kind") == "fact", FACT_BOOST).otherwise(1.0)
    c = c.withColumn("pack_score", F.round(F.when(F.col("p").isNotNull(), recency_boost(F.col("p"), F.col("t_event"), ref)).otherwise(own), 9))
    key = F.sha2(F.coalesce("content", F.lit("")), 256)
    lead = F.col("p").isNotNull()
    w = Window.partitionBy("query_id").orderBy(F.desc(lead), F.desc("pack_score"), F.when(lead, F.col("input")), F.desc("t_event"), key, "id")
    return c.select("query_id", "id", "pack_score", F.row_number().over(w).cast("long").alias("place"))


def shortlist(first: DataFrame, then: DataFrame, most: int) -> DataFrame:
    """(query_id, id, rank): the hits of one lane, then those of another that it lacks, ``most`` per query."""
    both = first.select("query_id", "id", F.lit(0).alias("lane"), F.col("rank").alias("n")).unionByName(then.select("query_id", "id", F.lit(1).alias("lane"), F.col("rank").alias("n")))
    best = both.groupBy("query_id", "id").agg(F.min(F.struct("lane", "n")).alias("at"))
    return top(best, most, "at").select("query_id", "id", "rank")


def gate(judged: DataFrame, least: float, keep: int = 3) -> DataFrame:
    """Candidates the judge finds relevant; the best ``keep`` if it finds none."""
    q = Window.partitionBy("query_id")
    j = judged.withColumn("passed", F.max((F.col("p") >= least).cast("int")).over(q)).withColumn("n", F.row_number().over(q.orderBy(F.desc("p"), "rank")))
    return j.where((F.col("p") >= least) | ((F.col("passed") == 0) & (F.col("n") <= keep))).drop("passed", "n")


def sweep(lanes: dict[str, DataFrame]) -> DataFrame:
    """(query_id, id): matches strong enough to delete by. Lexical or entity evidence, or a cosine
    above a floor: the strong-match cosine, or the median of the scores and a margin."""
    words = lanes["bm25"].select("query_id", "id").unionByName(lanes["entity"].select("query_id", "id"))
    v = lanes["vector"]
    floor = v.groupBy("query_id").agg(
        F.when(F.count("*") >= FLOOR_LEAST, F.greatest(F.lit(STRONG_COSINE), F.percentile("score", F.lit(0.5)) + FLOOR_MARGIN)).otherwise(STRONG_COSINE).alias("floor")
    )
    return words.unionByName(v.join(floor, "query_id").where("score >= floor").select("query_id", "id")).distinct()


def fingerprint(ids: DataFrame) -> DataFrame:
    """(query_id, n, fingerprint): what a sweep would delete, to confirm before it does."""
    return ids.groupBy("query_id").agg(F.count("*").alias("n"), F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("id")), "\n"), 256), 1, 32).alias("fingerprint"))
