"""The event log folded into records.

An event is (seq, ordinal, type, record, op): ``record`` for writes, ``op`` (op, id, new, at,
deadline, flag, expires) for mutations. Writes and mutations of one id apply in order of seq.
The fold is native: the last write of an id, then the mutations after it, by aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from palimpsest.operators.graph import connected, joints, stars
from palimpsest.sources.model import record_schema
from palimpsest.sources.store import Store

OP = "op string, id string, new string, at long, deadline long, flag boolean, expires long"


def merge(*logs: DataFrame) -> DataFrame:
    """One log of several that may overlap. Repeated events need no removal: a fold takes the first
    and last of events by their place, which copies do not change."""
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log)
    return out


def events(log: DataFrame) -> DataFrame:
    """(ns, seq, ordinal, id, kind) of each event once: it is known by (ns, seq, ordinal)."""
    rows = log.select("ns", "seq", "ordinal", "id", F.coalesce("op.op", F.lit("write")).alias("kind"))
    return rows.dropDuplicates(["ns", "seq", "ordinal"])


def writes(records: DataFrame, seq: Column) -> DataFrame:
    """Records as write events."""
    r = F.struct(*[F.col(f.name) for f in record_schema()])
    return records.select("ns", seq.cast("long").alias("seq"), F.lit(0).cast("long").alias("ordinal"), "id", r.alias("record"), F.lit(None).cast(StructType.fromDDL(OP)).alias("op"))


def ops(df: DataFrame, kind: str, seq: Column, **fields: Column) -> DataFrame:
    """Mutation events of one kind for the ids of ``df``."""
    names = {"new": "string", "at": "long", "deadline": "long", "flag": "boolean", "expires": "long"}
    op = F.struct(F.lit(kind).alias("op"), F.col("id"), *[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in names.items()])
    empty = F.lit(None).cast(record_schema())
    return df.select("ns", seq.cast("long").alias("seq"), F.lit(1).cast("long").alias("ordinal"), "id", empty.alias("record"), op.alias("op"))


def _folded(log: DataFrame, now: int, force: bool = False) -> DataFrame:
    """The live records, and whether a hard delete is still to come (doomed). Due hard deletes erase what was written before them; a later write
    survives. A supersede overwrites, a tombstone sets the end only where none is set."""
    o, place = F.col("op"), F.struct("seq", "ordinal")
    due = (o["op"] == "hard_delete") & (F.lit(force) | (F.coalesce(o["deadline"], F.lit(0)) <= now))
    # One shuffle by id: the window and the aggregate share it.
    w = Window.partitionBy("ns", "id")
    e = log.withColumn("place", place).withColumn("written", F.max(F.when(F.col("record").isNotNull(), F.col("place"))).over(w)).withColumn("erased", F.max(F.when(due, F.col("place"))).over(w))
    e = e.withColumn("doomed", F.max((o["op"] == "hard_delete") & (o["deadline"] > now)).over(w))
    e = e.where((F.col("place") >= F.col("written")) & (F.col("erased").isNull() | (F.col("erased") < F.col("written"))))
    self_made = F.coalesce(o["new"] == F.col("id"), F.lit(False))
    sup, tomb, quar = (o["op"] == "supersede") & ~self_made, o["op"] == "tombstone", o["op"] == "quarantine"
    last = lambda what, when: F.max_by(F.struct(what.alias("v")), F.when(when, F.col("place")))["v"]
    first = lambda what, when: F.min_by(F.struct(what.alias("v")), F.when(when, F.col("place")))["v"]
    state = e.groupBy("ns", "id").agg(
        F.first("record", ignorenulls=True).alias("record"),
        F.coalesce(F.max("doomed"), F.lit(False)).alias("doomed"),
        last(F.coalesce(o["at"], F.lit(now)), sup).alias("sup_at"),
        last(o["new"], sup).alias("sup_new"),
        F.max(sup).alias("sup"),
        first(F.coalesce(o["at"], F.lit(now)), tomb).alias("tomb_at"),
        F.max(tomb).alias("tomb"),
        last(F.coalesce(o["flag"], F.lit(True)), quar).alias("flag"),
        last(o["expires"], quar & F.coalesce(o["flag"], F.lit(True))).alias("expires"),
    )
    r = state.select(*[F.col(f"record.{f.name}").alias(f.name) for f in record_schema()], *[c for c in state.columns if c not in ("ns", "id", "record")])
    gone = F.col("deleted") | F.coalesce("tomb", F.lit(False))
    lapsed = F.coalesce(F.col("expires") <= now, F.lit(False))
    quarantined = F.coalesce("flag", "quarantined") & ~lapsed
    new = {
        "invalidated_at": F.coalesce("sup_at", "invalidated_at", "tomb_at"),
        "superseded_by": F.when(F.coalesce("sup", F.lit(False)), F.col("sup_new")).otherwise(F.col("superseded_by")),
        "quarantined": quarantined,
    }
    return r.where(~gone).select(*[new.get(f.name, F.col(f.name)).alias(f.name) for f in record_schema()], "doomed")


def fold(log: DataFrame, now: int, force: bool = False) -> DataFrame:
    """The live records of a log."""
    return _folded(log, now, force).drop("doomed")


def pending(log: DataFrame, now: int) -> DataFrame:
    """Hard deletes that are not due: every fold must carry them on."""
    return log.where((F.col("op.op") == "hard_delete") & (F.col("op.deadline") > now))


def carry(log: DataFrame, now: int) -> DataFrame:
    """A checkpoint of a log: folded with what came after, at ``now`` or later, it equals the whole.

    Live records are writes at the place of their last one. With them go the mutations since then
    that time has yet to settle: hard deletes not due, and quarantines, which can expire.
    """
    written = log.where(F.col("record").isNotNull()).groupBy("ns", "id").agg(F.max(F.struct("seq", "ordinal")).alias("written"))
    live = fold(log, now).join(written, ["ns", "id"])
    later = log.where(F.col("op.op") == "quarantine").unionByName(pending(log, now)).join(written, ["ns", "id"]).where(F.struct("seq", "ordinal") > F.col("written"))
    return writes(live, F.col("written.seq")).unionByName(later.select(*log.columns))


def export(log: DataFrame, now: int) -> DataFrame:
    """Lines of JSON, by time of ingestion: what is neither deleted nor about to be erased."""
    return _folded(log, now).where(~F.col("doomed")).select("t_ingested", "id", F.to_json(F.struct(*[f.name for f in record_schema()])).alias("line"))


def history(records: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, records): all versions of each start's chain, in both directions.

    ``starts`` has ids in ``start``. A start that nothing supersedes and that supersedes nothing is
    alone. Chains may be of any length, merge or run in a circle: they are components of the
    supersedence edges. Versions of a key, in order of time, lie in one range of edges or a few, so
    most chains are whole in a chunk; the rounds are for what ties chunks together, and the records
    are read for the ids of the asked chains only.
    """
    store = Store(records.sparkSession)
    edges = records.where("superseded_by IS NOT NULL").select(F.get("entity_keys", F.lit(0)).alias("key"), "t_event", F.col("id").alias("a"), F.col("superseded_by").alias("b"))
    edges = store.save(edges)  # a range's bounds are sampled first
    star = store.save(stars(edges.repartitionByRange("key", "t_event", "a").sortWithinPartitions("key", "t_event", "a")))
    ties = store.save(joints(star).where("a <> b"))
    top = connected(store, ties).toDF("b", "top")
    root = lambda df: df.join(top, "b", "left").withColumn("root", F.coalesce("top", "b"))
    asked = starts.select("start").distinct()
    own = store.save(root(star.join(asked.withColumnRenamed("start", "a"), "a")).select(F.col("a").alias("start"), "root").distinct())
    # The chunk roots of an asked chain: its root, and those that the ties put under it.
    heads = own.select("start", F.col("root").alias("b")).unionByName(own.join(top.withColumnRenamed("top", "root"), "root").select("start", "b")).distinct()
    members = star.join(store.save(heads), "b").select("start", F.col("a").alias("id"))
    members = store.save(members.unionByName(asked.select("start", F.col("start").alias("id"))).distinct())
    return members.join(records, "id")
