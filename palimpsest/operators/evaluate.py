"""Retrieval quality: binary relevance over the sessions of ranked hits."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions.text import words


def sessions(hits: DataFrame) -> DataFrame:
    """(query_id, session, rank): sessions in the order their first hit appears."""
    first = hits.groupBy("query_id", "session").agg(F.min("rank").alias("first"))
    w = Window.partitionBy("query_id").orderBy("first", "session")
    return first.select("query_id", "session", F.row_number().over(w).cast("long").alias("rank"))


def quality(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(query_id, ndcg, recall_any, recall_all) at ``k`` for gold rows (query_id, session)."""
    hit = gold.join(ranked.where(F.col("rank") <= k), ["query_id", "session"], "left")
    gain = F.coalesce(1 / F.log2(F.col("rank") + 1), F.lit(0.0))
    sums = hit.groupBy("query_id").agg(F.sum(gain).alias("dcg"), F.count("rank").alias("found"), F.count("*").alias("all"))
    best = reduce(lambda a, i: a + F.when(F.col("all") >= i, 1 / math.log2(i + 1)).otherwise(0.0), range(1, k + 1), F.lit(0.0))
    return sums.select(
        "query_id",
        F.round(F.col("dcg") / best, 6).alias("ndcg"),
        (F.col("found") > 0).cast("double").alias("recall_any"),
        (F.col("found") == F.col("all")).cast("double").alias("recall_all"),
    )


ENDINGS = ("ing", "es", "ed", "s")


def stems(c: Column) -> Column:
    """Words and what is left of them without a common ending."""
    short = lambda w: F.filter(F.array(*[F.when((F.length(w) > len(e) + 1) & w.endswith(e), F.substring(w, F.lit(1), F.length(w) - len(e))) for e in ENDINGS]), lambda x: x.isNotNull())
    return F.array_distinct(F.flatten(F.transform(words(c), lambda w: F.array_append(short(w), w))))


def answers(cases: DataFrame, contexts: DataFrame) -> DataFrame:
    """(query_id, answer): the sentence of a context that covers a query's stems best, weighted by rarity.

    ``cases`` has (query_id, query), ``contexts`` (query_id, context). The first of equals wins.
    """
    sentences = contexts.select("query_id", F.posexplode(F.split("context", r"(?<=[.!?])\s+|\n")).alias("pos", "sentence")).where("trim(sentence) <> ''")
    tokens = sentences.select("query_id", "pos", F.explode(stems(F.col("sentence"))).alias("stem"))
    count = sentences.groupBy("query_id").agg(F.count("*").alias("n"), F.min_by("sentence", "pos").alias("first"))
    df = tokens.groupBy("query_id", "stem").agg(F.count("*").alias("df"))
    asked = cases.select("query_id", F.explode(stems(F.col("query"))).alias("stem")).join(count.select("query_id", "n"), "query_id").join(df, ["query_id", "stem"], "left")
    asked = asked.select("query_id", "stem", (F.ln((F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 0.1).alias("idf"))
    whole = asked.groupBy("query_id").agg(F.sum("idf").alias("whole"))
    scores = tokens.join(asked, ["query_id", "stem"]).groupBy("query_id", "pos").agg(F.sum("idf").alias("hit")).join(whole, "query_id")
    best = scores.select("query_id", "pos", F.round(F.col("hit") / F.col("whole"), 9).alias("score")).join(sentences, ["query_id", "pos"])
    best = best.groupBy("query_id").agg(F.max_by("sentence", F.struct("score", -F.col("pos"))).alias("best"))
    return count.join(cases.select("query_id"), "query_id").join(best, "query_id", "left").select("query_id", F.trim(F.coalesce("best", "first")).alias("answer"))


def summary(results: DataFrame) -> DataFrame:
    """(suite, system, cases, accuracy, tokens) of results (suite, system, qclass, correct, tokens)."""
    return results.groupBy("suite", "system").agg(F.count("*").alias("cases"), F.round(F.avg(F.col("correct").cast("double")), 4).alias("accuracy"), F.round(F.avg("tokens"), 1).alias("tokens"))


def gate(results: DataFrame, suite: str, system: str, whole: str, plain: str) -> DataFrame:
    """(rule, ok): at most 0.02 less accurate than the whole context at a tenth of its tokens, no less
    than plain retrieval, and 0.95 of updated facts right."""
    s = summary(results.where(F.col("suite") == suite))
    pick = lambda name: s.where(F.col("system") == name).agg(F.max("accuracy").alias(f"acc_{name}"), F.max("tokens").alias(f"tok_{name}"))
    updated = results.where((F.col("suite") == suite) & (F.col("system") == system) & (F.col("qclass") == "knowledge_update")).agg(F.avg(F.col("correct").cast("double")).alias("updated"))
    one = pick(system).crossJoin(pick(whole)).crossJoin(pick(plain)).crossJoin(updated)  # a row each
    c = F.col
    rules = (
        ("accuracy", c(f"acc_{system}") >= c(f"acc_{whole}") - 0.02), ("tokens", c(f"tok_{system}") <= 0.1 * F.greatest(c(f"tok_{whole}"), F.lit(1.0))),
        ("retrieval", c(f"acc_{system}") >= c(f"acc_{plain}")), ("updates", c("updated") >= 0.95),
    )
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(ok, F.lit(True)).alias("ok")) for n, ok in rules])).alias("r")).select("r.*")
