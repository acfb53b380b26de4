"""Quarantine, taint, limits and metering as window replays over the log."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions import text as T
from palimpsest.operators.prefix import running_sum, sliding_count
from palimpsest.sources.store import Store

# Fixed values of the policies.
RATE_MS, RATE_MOST = 60_000, 120
COPY_MS, COPY_MOST, COPY_TOKENS = 600_000, 5, 12
EXPIRY_MS = 24 * 3600 * 1000


def rate(writes: DataFrame, window_ms: int = RATE_MS, most: int = RATE_MOST) -> DataFrame:
    """Row form: a write below the agent tier is held when its actor wrote more than ``most``
    such records in the window that ends with it. (A batch is not held as a whole.)"""
    actor = F.coalesce("actor_id", F.concat(F.lit("src:"), F.col("source").cast("string")))
    low = writes.where("source < 4").withColumn("actor", actor)
    return sliding_count(low, "actor", "t_ingested", window_ms).withColumn("held", F.col("recent") > most)


def copy_key(content: Column) -> Column:
    """The first words in order, without their numbers."""
    bare = F.filter(F.transform(F.array_distinct(T.words(content)), lambda t: F.regexp_replace(t, "[0-9]+$", "")), lambda t: F.length(t) > 2)
    return F.array_join(F.slice(F.array_sort(bare), 1, COPY_TOKENS), "|")


def copies(writes: DataFrame, window_ms: int = COPY_MS, most: int = COPY_MOST) -> DataFrame:
    """Low-trust writes that say the same again and again."""
    low = writes.where("source <= 2").withColumn("copy_key", copy_key(F.col("content")))
    return sliding_count(low, "copy_key", "t_ingested", window_ms).withColumn("held", F.col("recent") > most)


def taint(turns: DataFrame) -> DataFrame:
    """The least trusted tier a session has seen so far."""
    w = Window.partitionBy("prov_session").orderBy("t_event", "id").rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("taint", F.min("source").over(w))


def failures(events: DataFrame, key: str, at: str, window_ms: int, most: int) -> DataFrame:
    """Is a key blocked at each of its failures: more than ``most`` in the window."""
    return sliding_count(events, key, at, window_ms).withColumn("blocked", F.col("recent") > most)


def bucket(calls: DataFrame, key: str, at: str, per_minute: int) -> DataFrame:
    """(key, at, ..., allowed): a token bucket per key, full at first, refilled by the minute's limit.

    What a call finds depends on every call before, refused ones included, so a key's calls are
    replayed in order (ties in any order: they are alike); the state is two numbers.
    """
    out = f"{key} string, {at} long, allowed boolean"

    def f(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, held, last = None, 0.0, 0
        for b in rows:
            made = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != who:
                    who, held, last = k, float(per_minute), t
                held, last = min(float(per_minute), held + (t - last) * per_minute / 60_000), t
                made.append(held >= 1)
                held -= made[-1]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.bool_())], names=[key, at, "allowed"])

    calls = calls.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias(key), F.col(at).cast("long").alias(at))
    return calls.repartition(key).sortWithinPartitions(key, at).mapInArrow(f, out)


def rollup(usage: DataFrame, included: Column | float) -> DataFrame:
    """(org, meter, period, quantity, billable) of usage events (org, meter, at, event_id, quantity).

    Billable is what goes beyond the included quantity; over a period's events that telescopes
    to what its total exceeds it by.
    """
    free = F.lit(included) if not isinstance(included, Column) else included
    period = F.date_format(F.timestamp_millis("at"), "yyyy-MM")
    sums = usage.groupBy("org", "meter", period.alias("period")).agg(F.sum("quantity").alias("quantity"))
    return sums.withColumn("billable", F.greatest(F.lit(0), F.col("quantity") - free).cast("long"))


def admit(wants: DataFrame, limit: int, least: int = 1) -> DataFrame:
    """(org, request_id, granted): grants in order of (at, request_id) per org until the quota is used.

    A grant is what is wanted or what is left, and denied below ``least``. Wants below ``least``
    never count; of the others all are met until the first that overflows, which gets the rest if
    that is enough; nothing is left for those after it. So a running sum of wants decides.
    """
    rows = wants.withColumn("asked", F.when(F.col("want") >= least, F.col("want")).otherwise(0).cast("long"))
    rows = running_sum(Store(wants.sparkSession), rows, ["org"], ["at", "request_id"], F.col("asked"), "total")
    left = F.lit(limit).cast("long") - (F.col("total") - F.col("asked"))
    granted = F.when(F.col("asked") <= left, F.col("asked")).when(left >= least, left).otherwise(F.lit(0).cast("long"))
    return rows.select("org", "request_id", granted.alias("granted"))


def gauge(samples: DataFrame) -> DataFrame:
    """The last value of each UTC day: (org, day, value)."""
    day = F.date_format(F.timestamp_millis("at"), "yyyy-MM-dd")
    return samples.groupBy("org", day.alias("day")).agg(F.max_by("value", F.struct("at", "event_id")).alias("value"))


def quantile(buckets: DataFrame, q: float) -> DataFrame:
    """(series, value) from counts by upper bound (series, bound, n); a null bound is the open one.

    Linear within a band; the open band reports the largest bound.
    """
    w = Window.partitionBy("series").orderBy(F.col("bound").asc_nulls_last())
    b = buckets.withColumn("upto", F.sum("n").over(w)).withColumn("low", F.coalesce(F.lag("bound").over(w), F.lit(0.0))).withColumn("total", F.sum("n").over(Window.partitionBy("series")))
    b = b.where(F.col("upto") >= q * F.col("total")).withColumn("first", F.row_number().over(w)).where("first = 1")
    inside = F.col("low") + (F.col("bound") - F.col("low")) * (q * F.col("total") - (F.col("upto") - F.col("n"))) / F.col("n")
    return b.select("series", F.round(F.coalesce(inside, F.col("low")), 6).alias("value"))


def nearest(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, p50, p95): the median, and the nearest rank below 95 % of the sorted values."""
    store = Store(df.sparkSession)
    counts = store.save(df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n")))
    totals = counts.groupBy(key).agg(F.sum("n").alias("all"))
    upto = running_sum(store, counts, [key], [value], F.col("n"), "upto").join(totals, key)
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col(value)))
    middle = (at(F.floor((F.col("all") - 1) / 2)) + at(F.floor(F.col("all") / 2))) / 2
    return upto.groupBy(key).agg(middle.alias("p50"), at(F.floor(F.lit(0.95) * (F.col("all") - 1))).alias("p95"))


def hmac_sha256(key: bytes, body: Column) -> Column:
    """HMAC-SHA-256 of a text, as hex."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda n: F.unhex(F.lit(bytes(b ^ n for b in key).hex()))
    inner = F.sha2(F.concat(pad(0x36), body.cast("binary")), 256)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)


def seal(prev: Column, body: Column, key: bytes | None = None) -> Column:
    """The hash of an audit entry: it covers the hash before it, and is keyed if a key is given."""
    whole = F.concat_ws("\n", prev, body)
    return F.sha2(whole, 256) if key is None else hmac_sha256(key, whole)


def verify_chain(entries: DataFrame, key: bytes | None = None) -> DataFrame:
    """(ledger, n, ok, verified) of audit entries (ledger, n, body, prev, h): each hash fits its body and
    names the one before; an entry is verified if it and all before it are fine."""
    w = Window.partitionBy("ledger").orderBy("n")
    fits = (seal(F.col("prev"), F.col("body"), key) == F.col("h")) & (F.coalesce(F.lag("h").over(w), F.lit("")) == F.col("prev"))
    marked = entries.withColumn("ok", F.coalesce(fits, F.lit(False)))
    return marked.withColumn("verified", F.min("ok").over(w.rowsBetween(Window.unboundedPreceding, 0)))
