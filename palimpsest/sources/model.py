"""The record model, and adapters that read records from the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

#: Trust tiers and kinds: fixed values of the data model.
USER, AGENT, TOOL, WEB, IMPORT = 5, 4, 3, 2, 1
KINDS = ("raw_event", "fact", "link", "procedure", "summary", "pin")

RECORD = (
    "id string, ns string, kind string, content string, scope_org string, scope_agent string, scope_user string, "
    "scope_session string, source int, actor_id string, prov_session string, lineage array<string>, t_event long, "
    "t_ingested long, valid_from long, invalidated_at long, superseded_by string, entity_keys array<string>, "
    "embedding_version string, demotes array<string>, quarantined boolean, deleted boolean, ingest_seq long"
)
MAX_CONTENT, MAX_META, MAX_BATCH, MAX_QUERY = 10 << 20, 64 << 10, 10_000, 64 << 10
T0, DAY, MINUTE = 1_700_000_000_000, 86_400_000, 60_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def record_schema() -> StructType:
    return StructType.fromDDL(RECORD)


def shaped(df: DataFrame, **columns: Column) -> DataFrame:
    """The record columns in order; those not given are null."""
    return df.select(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in record_schema()])


def source_of_role(role: Column) -> Column:
    """The trust tier of a chat role."""
    return F.when(role == "user", USER).when(role.isin("assistant", "agent"), AGENT).otherwise(TOOL)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events from ``conversations``; some are unowned, late to be valid, deleted or quarantined."""
    c, t = F.col("conv_id"), F.col("turn")
    at = F.lit(T0) + c * DAY + t * MINUTE
    n = c * 8 + t
    return shaped(
        table(spark, sf_dir, "conversations"),
        id=F.format_string("c%06d-%04d", c, t),
        ns=F.lit("main"),
        kind=F.lit("raw_event"),
        content=F.col("text"),
        scope_org=F.concat(F.lit("o"), c % 3),
        scope_user=F.when(c % 7 != 3, F.concat(F.lit("u"), c % 10)),
        scope_session=F.when(c % 11 != 5, F.concat(F.lit("s"), c)),
        source=source_of_role(F.col("role")),
        actor_id=F.concat_ws(":", "role", (c % 10).cast("string")),
        prov_session=F.concat(F.lit("s"), c),
        t_event=at,
        t_ingested=at + 1000,
        valid_from=F.when(t == 3, at + DAY),
        entity_keys=F.array(),
        lineage=F.array(),
        quarantined=n % 29 == 0,
        deleted=n % 37 == 0,
        ingest_seq=c * 1000 + t,
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts from ``events``: per user and type, each is superseded by the next."""
    e = table(spark, sf_dir, "events").withColumn("at", F.unix_millis(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id", "event_type").orderBy("at", "event_id")
    name = lambda i: F.format_string("e%09d", i)
    e = e.withColumn("next_id", F.lead("event_id").over(w)).withColumn("next_at", F.lead("at").over(w))
    i, u = F.col("event_id"), F.col("user_id")
    return shaped(
        e,
        id=name(i),
        ns=F.lit("main"),
        kind=F.lit("fact"),
        content=F.concat(F.lit("user "), u, F.lit(" did "), F.col("event_type"), F.lit(" number "), i),
        scope_org=F.concat(F.lit("o"), u % 3),
        scope_user=F.concat(F.lit("u"), u % 10),
        source=(i % 5 + 1),
        actor_id=F.concat(F.lit("app:"), u % 10),
        lineage=F.array(),
        t_event=F.col("at"),
        t_ingested=F.col("at") + 500,
        invalidated_at=F.col("next_at"),
        superseded_by=name(F.col("next_id")),
        entity_keys=F.array(F.concat(F.col("event_type"), F.lit(".u"), u)),
        quarantined=F.lit(False),
        deleted=F.lit(False),
        ingest_seq=i + 1_000_000_000,
    ).withColumn("superseded_by", F.when(F.col("invalidated_at").isNotNull(), F.col("superseded_by")))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).unionByName(facts(spark, sf_dir))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, dim, model, vec): even numbers belong to the fact so numbered, odd ones to a message."""
    n = F.col("vec_id")
    message = F.format_string("c%06d-%04d", F.floor(n / 5), n % 5)
    return table(spark, sf_dir, "embeddings").select(
        F.when(n % 2 == 0, F.format_string("e%09d", n)).otherwise(message).alias("id"),
        F.size("embedding").cast("long").alias("dim"),
        F.when(F.col("vec_id") % 5 == 0, "old").otherwise("new").alias("model"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )


def restored(lines: DataFrame, namespace: str) -> DataFrame:
    """Records from lines of an export (value: JSON): ids are kept, the namespace is the new one."""
    rows = lines.select(F.from_json("value", record_schema()).alias("r")).select("r.*")
    return rows.where("id IS NOT NULL").withColumn("ns", F.lit(namespace))


def foreign(rows: DataFrame) -> DataFrame:
    """Rows of another system (line: JSON) as facts of the import tier."""
    g = lambda k: F.get_json_object("line", f"$.{k}")
    text = F.coalesce(*[F.nullif(g(k), F.lit("")) for k in ("memory", "text", "content", "data")])
    time = F.coalesce(*[g(k) for k in ("created_at", "timestamp", "t", "time")])
    number = time.try_cast("double")
    ms = F.when(number.isNotNull(), F.when(number < 10**12, number * 1000).otherwise(number).cast("long")).otherwise(F.unix_millis(F.try_to_timestamp(time)))
    user = F.coalesce(g("user_id"), g("metadata.user_id"))
    return rows.select(text.alias("content"), ms.alias("t_event"), user.alias("scope_user"), F.lit(IMPORT).alias("source"), F.lit("fact").alias("kind")).where("content IS NOT NULL")


def guard(df: DataFrame) -> DataFrame:
    """Reject records outside the write limits: the job fails with the reason."""
    checks = (
        (F.col("kind").isin(*KINDS), "kind outside the vocabulary"),
        (F.octet_length("content") <= MAX_CONTENT, "content over 10 MiB"),
        (F.col("source").between(IMPORT, USER), "unknown trust tier"),
    )
    fine = reduce(lambda a, b: a & b, [F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(F.lit(why)).cast("boolean")) for ok, why in checks])
    return df.where(fine)


def pin_scope(df: DataFrame, user: str) -> DataFrame:
    """A key pinned to a user cannot write for another, nor claim the user tier for another actor."""
    return df.withColumn("scope_user", F.lit(user)).withColumn(
        "source", F.when((F.col("source") == USER) & (F.coalesce("actor_id", F.lit(user)) != user), AGENT).otherwise(F.col("source")).cast("int")
    )
