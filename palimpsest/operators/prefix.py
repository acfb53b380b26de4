"""Running sums over a total order, for groups that are too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.sources.store import Store


def running_sum(store: Store, df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of the same ``by`` up to each row.

    Rows are dealt by ranges of (by, order) and written, so that ranges stay as they are when a
    task is repeated. A range sums its own rows; what came before it is one number per range.
    """
    up = [*by, *order]
    ranges = df.withColumn("_v", value).repartitionByRange(*up) if up else df.withColumn("_v", value)
    ranges = store.save(ranges.withColumn("_part", F.spark_partition_id()))
    totals = store.save(ranges.groupBy(*by, "_part").agg(F.sum("_v").alias("_total")))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = store.save(totals.select(*by, "_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start")))
    own = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranges.withColumn(name, F.sum("_v").over(own))
    return local.join(starts, [*by, "_part"]).withColumn(name, F.col(name) + F.col("_start")).drop("_v", "_part", "_start")


def place(df: DataFrame, order: list[str], by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Rows numbered from 1 in a total order."""
    return running_sum(Store(df.sparkSession), df, by or [], order, F.lit(1).cast("long"), name)


def sliding_count(df: DataFrame, key: str, at: str, window: int, name: str = "recent") -> DataFrame:
    """``df`` with the number of rows of the same key in (at - window, at].

    Time is cut into pieces as long as the window, and rows are repeated in the next piece: a key
    is spread over as many groups as it has pieces. In the next piece a row counts from the start
    and leaves when the window has passed it, so a count is a running sum: a frame whose both ends
    move would be counted anew for each row.
    """
    piece = F.floor(F.col(at) / window)
    step = lambda p, t, n: F.struct(p.alias("piece"), t.cast("long").alias("at"), F.lit(n).cast("long").alias("n"))
    steps = F.filter(F.array(step(piece, F.col(at), 1), step(piece + 1, F.col(at) + window, -1)), lambda s: (s["n"] > 0) | s["piece"].isNotNull())
    rows = df.withColumn("_step", F.explode(steps)).withColumn("_piece", F.col("_step.piece"))
    group = Window.partitionBy(key, "_piece")
    upto = group.orderBy("_step.at").rangeBetween(Window.unboundedPreceding, 0)
    before = F.count(F.when(F.col("_step.n") < 0, 1)).over(group)
    return rows.withColumn(name, before + F.sum("_step.n").over(upto)).where("_step.n > 0").drop("_piece", "_step")
