"""A facade over one store of records: a folder per namespace, with an event log in versions."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions import text as T
from palimpsest.functions.visibility import Filter, Scope, visible
from palimpsest.operators import derive, fold, fusion, lanes, packing, scans
from palimpsest.plans import planner
from palimpsest.sources import model, store

BUDGET, FLAT_BUDGET = 12_000, 2000
LAYOUTS = ("sessions", "flat")
TIERS = {"user": model.USER, "assistant": model.AGENT, "agent": model.AGENT}
#: The columns of an event, and their types.
COLUMNS = ("ns", "seq", "ordinal", "id", "record", "op")
EVENT = f"ns string, seq long, ordinal long, id string, record struct<{model.RECORD}>, op struct<{fold.OP}>"
FACT = "id string, scope_user string, scope_session string, entity_key string, fact string, source int, lineage array<string>, t_event long"


def namespaces(spark: SparkSession, path: str) -> list[str]:
    return [n.removeprefix("ns=") for n in store.names(spark, path.rstrip("/")) if n.startswith("ns=")]


def has_namespace(spark: SparkSession, path: str, namespace: str) -> bool:
    return namespace in namespaces(spark, path)


class Memory:
    """Writes append events; reads fold them. The log is the only durable truth.

    ``path`` is a folder that all executors reach. One writer per namespace; readers are many. The
    log of a namespace is the folder ``v<n>`` with the largest n; a new version is written under
    another name and then renamed, so a crash at any step leaves the old one or the new one whole.

    Three seams take functions: ``embed`` (text Column to a vector Column; feature hashing without
    it, which takes no part in ranking), ``extract`` (turns to facts, like ``derive.extract``),
    and ``judge`` (query Column and text Column to a probability) for reranking.
    """

    def __init__(self, spark: SparkSession, path: str, namespace: str = "main", embed: Callable[[Column], Column] | None = None, extract: Callable[[DataFrame], DataFrame] = derive.extract, judge: Callable[[Column, Column], Column] | None = None):
        self.spark, self.path, self.namespace = spark, path.rstrip("/"), namespace
        self.embed, self.extract, self.judge = embed, extract, judge
        self.home = f"{self.path}/ns={namespace}"
        self.seq = self.log().agg(F.max("seq")).first()[0] or 0

    # the log

    def _version(self) -> int:
        return max((int(n[1:]) for n in store.names(self.spark, self.home) if n[:1] == "v" and n[1:].isdigit()), default=0)

    def _folder(self) -> str:
        return f"{self.home}/v{self._version():06d}"

    def log(self) -> DataFrame:
        folder = self._folder()
        if not store.exists(self.spark, folder):
            return self.spark.createDataFrame([], EVENT)
        return self.spark.read.schema(EVENT).parquet(folder)

    def records(self, now: int) -> DataFrame:
        return fold.fold(self.log(), now)

    def _append(self, *events: DataFrame) -> None:
        """All frames in one write: they are there together or not at all."""
        fold.merge(*events).select(*COLUMNS).write.mode("append").parquet(self._folder())

    def compact(self, now: int) -> None:
        """A new version of this namespace's log: what a fold keeps, and what time has yet to settle.

        The largest seq ever given goes with it, so numbers are never given twice.
        """
        last = self._version()
        mark = fold.ops(self.spark.createDataFrame([(self.namespace, "")], "ns string, id string"), "mark", F.lit(self.seq))
        new = f"{self.home}/new-{uuid.uuid4().hex}"
        fold.carry(self.log(), now).unionByName(mark).select(*COLUMNS).write.parquet(new)
        store.rename(self.spark, new, f"{self.home}/v{last + 1:06d}")
        self._sweep()

    def _sweep(self) -> None:
        """Delete older versions and what a crash left behind."""
        last = self._version()
        for name in store.names(self.spark, self.home):
            if name.startswith("new-") or (name[:1] == "v" and name[1:].isdigit() and int(name[1:]) < last):
                store.delete(self.spark, f"{self.home}/{name}")

    def destroy_namespace(self) -> None:
        """Remove the namespace and all it holds."""
        store.delete(self.spark, self.home)
        self.seq = 0

    # writes

    def add_events(self, rows: list[dict], now: int) -> list[str]:
        """Raw turns: content, role, user_id, session_id, agent_id, org_id, t_event."""
        if len(rows) > model.MAX_BATCH:
            raise ValueError(f"a batch holds {model.MAX_BATCH} events at most")
        for r in rows:
            if len(r["content"].encode()) > model.MAX_CONTENT:
                raise ValueError("content over 10 MiB")
            if r.get("kind", "raw_event") not in model.KINDS:
                raise ValueError(f"unknown kind {r['kind']!r}")
        if not rows:
            return []
        first = self.seq + 1
        self.seq += len(rows)
        ids = [f"{first + n:012d}-{hashlib.md5(r['content'].encode()).hexdigest()[:8]}" for n, r in enumerate(rows)]
        data = [
            (
                first + n, i, r.get("kind", "raw_event"), r["content"], r.get("org_id"), r.get("agent_id"), r.get("user_id"), r.get("session_id"),
                r.get("source") or TIERS.get(r.get("role", "user"), model.TOOL), r.get("actor_id"), r.get("t_event") or now, r.get("valid_from"),
                list(r.get("entity_keys") or ()), list(r.get("lineage") or ()), list(r.get("demotes") or ()),
            )
            for n, (i, r) in enumerate(zip(ids, rows))
        ]
        ddl = "seq long, id string, kind string, content string, scope_org string, scope_agent string, scope_user string, scope_session string, source int, actor_id string, t_event long, valid_from long, entity_keys array<string>, lineage array<string>, demotes array<string>"
        self._append(self._written(self.spark.createDataFrame(data, ddl), now))
        return ids

    def _written(self, df: DataFrame, now: int, **more: Column) -> DataFrame:
        """Write events of rows with a seq and columns named as in a record."""
        own = {c: F.col(c) for c in df.columns if c != "seq"}
        rest = {"ns": F.lit(self.namespace), "t_ingested": F.lit(now), "quarantined": F.lit(False), "deleted": F.lit(False), "ingest_seq": F.col("seq"), "prov_session": F.col("scope_session")}
        return fold.writes(model.shaped(df, **(rest | own | more)), F.col("ingest_seq"))

    def add(self, content: str, now: int, **fields) -> str:
        return self.add_events([fields | {"content": content}], now)[0]

    def observe(self, messages: list[dict], response: str, now: int, **scope) -> list[str]:
        """A whole exchange as one batch: the messages that say something, then the answer."""
        said = [scope | {"content": str(m["content"]), "role": m.get("role", "user")} for m in messages if m.get("content")]
        return self.add_events([*said, scope | {"content": response, "role": "assistant"}], now)

    def _write_facts(self, facts: DataFrame, now: int) -> DataFrame:
        """Facts (columns of FACT) consolidated with what is known and appended as one batch.

        Returns (id, copy_of): which facts are new, and which repeat another.
        """
        known = self.records(now).where((F.col("kind") == "fact") & visible(Filter(now=now)))
        known = known.select("scope_user", F.explode("entity_keys").alias("entity_key"), "id", "t_event", "lineage", F.col("content").alias("fact"))
        saved = store.Store(self.spark)
        facts = saved.save(facts)
        who = F.coalesce("scope_user", F.lit(""))
        same = lambda df: df.withColumn("scope_user", who)
        done = saved.save(derive.revise(same(facts), same(known)))
        per = done.groupBy("id").agg(F.min("copy_of").alias("copy_of"), F.array_distinct(F.flatten(F.collect_list("demotes"))).alias("demotes"))
        whole = facts.groupBy("id").agg(F.collect_set("entity_key").alias("entity_keys"), *[F.first(c).alias(c) for c in ("scope_user", "scope_session", "fact", "source", "lineage", "t_event")])
        ready = whole.join(per, "id").withColumn("n", F.row_number().over(Window.orderBy("t_event", "id")))  # a batch of facts of one call
        ready = saved.save(ready)
        new = ready.where("copy_of IS NULL").withColumn("seq", F.col("n") + self.seq).withColumn("content", F.col("fact")).withColumn("kind", F.lit("fact"))
        ends = done.where("supersedes IS NOT NULL").groupBy(F.col("supersedes").alias("old")).agg(F.max("id").alias("new")).select(F.lit(self.namespace).alias("ns"), F.col("old").alias("id"), "new")
        count = ready.count()
        if new.isEmpty():
            return ready.select("id", "copy_of")
        fields = ["seq", "id", "kind", "content", "scope_user", "scope_session", "source", "t_event", "entity_keys", "lineage", "demotes"]
        self._append(self._written(new.select(*fields), now), fold.ops(ends, "supersede", F.lit(self.seq + count + 1), new=F.col("new"), at=F.lit(now)))
        self.seq += count + 1
        return ready.select("id", "copy_of")

    def remember(self, content: str, now: int, entity_keys: list[str], **fields) -> str:
        """A fact; it supersedes the latest live fact of its keys and user that says something else.

        It is as trusted as its source, or as the least trusted turn of its session.
        """
        session, source = fields.get("session_id"), fields.get("source") or model.AGENT
        if session is not None:
            seen = scans.session(self.records(now), session).agg(F.min("source")).first()[0]
            source = min(source, seen) if seen is not None else source
        new = f"{self.seq + 1:012d}-{hashlib.md5(content.encode()).hexdigest()[:8]}"
        rows = [(new, fields.get("user_id"), session, k, content, source, list(fields.get("lineage") or ()), fields.get("t_event") or now) for k in entity_keys[:8]]
        return self._write_facts(self.spark.createDataFrame(rows, FACT), now).first().copy_of or new

    def close_session(self, session: str, now: int) -> int:
        """Extract facts from a session's turns, capped to its least trusted turn; returns how many are new."""
        turns = scans.session(self.records(now), session)
        named = turns.join(derive.names(turns), "scope_user", "left").withColumn("scope_agent", F.col("scope_user"))
        found = self.extract(turns).join(named.select("id", "scope_user", "name", "scope_session", "prov_session", "t_event"), "id")
        found = derive.capped_source(found.withColumn("source", F.lit(0)), turns)
        found = found.withColumn("fact", F.when(F.col("name").isNotNull() & F.col("fact").startswith(F.col("scope_user")), F.concat("name", F.substring(F.col("fact"), F.length("scope_user") + 1, F.length("fact")))).otherwise(F.col("fact")))
        found = derive.distinct_facts(found, ["t_event", "id"], ["scope_user"])
        # A fact of a user outlives its session.
        facts = found.select(F.concat_ws("-", "id", "pattern").alias("id"), "scope_user", F.when(F.col("scope_user").isNull(), F.col("scope_session")).alias("scope_session"), "entity_key", "fact", "source", F.array("id").alias("lineage"), "t_event")
        return self._write_facts(facts, now).where("copy_of IS NULL").count()

    def _mutate(self, ids: list[str], kind: str, **fields) -> DataFrame:
        self.seq += 1
        df = self.spark.createDataFrame([(self.namespace, i) for i in ids], "ns string, id string")
        return fold.ops(df, kind, F.lit(self.seq), **fields)

    def delete_many(self, ids: list[str], now: int, hard_after_ms: int | None = None) -> None:
        events = [self._mutate(ids, "tombstone", at=F.lit(now))]
        if hard_after_ms is not None:
            events.append(self._mutate(ids, "hard_delete", deadline=F.lit(now + hard_after_ms)))
        self._append(*events)

    def delete(self, key: str, now: int, hard_after_ms: int | None = None) -> None:
        self.delete_many([key], now, hard_after_ms)

    def quarantine(self, ids: list[str], flag: bool = True, expires: int | None = None) -> None:
        self._append(self._mutate(ids, "quarantine", flag=F.lit(flag), expires=F.lit(expires)))

    # vectors

    @property
    def model_name(self) -> str:
        return getattr(self.embed, "__name__", "custom") if self.embed else "hash"

    def _embedded(self, df: DataFrame, text: str) -> DataFrame:
        """(id, vec) of rows (id, text)."""
        return df.select("id", self.embed(F.substring(text, 1, 2000)).alias("vec")) if self.embed else lanes.dense(df.withColumn(text, F.substring(text, 1, 2000)), "id", text)

    def vectors(self) -> DataFrame:
        """(id, model, vec): the latest vector of each record."""
        folder = f"{self.home}/vectors"
        if not store.exists(self.spark, folder):
            return self.spark.createDataFrame([], "id string, model string, vec array<double>")
        rows = self.spark.read.schema("id string, model string, vec array<double>, seq long").parquet(folder)
        return rows.groupBy("id").agg(F.max_by(F.struct("model", "vec"), "seq").alias("v")).select("id", "v.*")

    def reembed(self, now: int) -> int:
        """Give every live record that lacks one a vector of the current model; returns how many."""
        todo = store.Store(self.spark).save(scans.stale_vectors(self.records(now), self.vectors(), self.model_name).select("id", "content"))
        n = todo.count()
        if n:
            self.seq += 1
            self._embedded(todo, "content").select("id", F.lit(self.model_name).alias("model"), F.col("vec").cast("array<double>"), F.lit(self.seq).cast("long").alias("seq")).write.mode("append").parquet(f"{self.home}/vectors")
        return n

    flush = reembed

    # reads

    def _asked(self, query: str) -> DataFrame:
        if len(query) > model.MAX_QUERY:
            raise ValueError("query too long")
        return self.spark.createDataFrame([(1, query)], "query_id int, text string")

    def _vector_lane(self, r: DataFrame, query: str, f: Filter, limit: int) -> DataFrame:
        mine = self.vectors().where(F.col("model") == self.model_name)
        asked = self._embedded(self.spark.createDataFrame([("1", query)], "id string, text string"), "text").select(F.lit(1).alias("query_id"), F.col("vec").cast("array<double>").alias("vec"))
        return lanes.vector(r, mine, asked, f, limit)

    def _search(self, query: str, now: int, r: DataFrame, scope: Scope, as_of: int | None, include_quarantined: bool, kinds) -> tuple[DataFrame, dict, dict]:
        q, plan = self._asked(query), planner.plan(query)
        f = Filter(scope=scope, now=now, as_of=as_of, include_quarantined=include_quarantined, kinds=kinds or plan["kinds"])
        found = {"bm25": lanes.bm25(r, q, f, plan["k"]), "entity": lanes.entity(r, q, f)}
        if plan["recent"]:
            found["time"] = lanes.recent(r, q, f, plan["k"])
        if self.embed:  # hashed vectors repeat what words say: they serve sweeps, not ranking
            found["vector"] = self._vector_lane(r, query, f, plan["k"])
        return fusion.fuse(found, q, r, max(plan["k"], 40)), found, plan

    def search(self, query: str, now: int, scope: Scope = Scope(), as_of: int | None = None, include_quarantined: bool = False, kinds: tuple[str, ...] | None = None) -> DataFrame:
        """(query_id, id, score, lanes, rank): the lanes of one query fused."""
        return self._search(query, now, store.Store(self.spark).save(self.records(now)), scope, as_of, include_quarantined, kinds)[0]

    def _order(self, query: str, now: int, r: DataFrame, **kw) -> DataFrame:
        """Candidates in packing order, the judged ones first if there is a judge."""
        fused, found, _ = self._search(query, now, r, kw.get("scope", Scope()), kw.get("as_of"), kw.get("include_quarantined", False), kw.get("kinds"))
        fused = store.Store(self.spark).save(fused)
        judged = None
        if self.judge:
            none = found["bm25"].limit(0)
            short = fusion.shortlist(found["bm25"], found.get("vector", none), 30).join(r.select("id", "content"), "id")
            judged = short.select("query_id", "id", self.judge(F.lit(query), F.col("content")).alias("p"))
        return fusion.packing_order(fused, r, kw.get("as_of"), judged)

    def pack(self, query: str, now: int, budget: int | None = None, layout: str = "sessions", with_dates: bool = True, **kw) -> str:
        """The packed context of a query: whole sessions in order, or a flat list of records."""
        if layout not in LAYOUTS:
            raise ValueError(f"a layout is one of {LAYOUTS}")
        r = store.Store(self.spark).save(self.records(now))
        order = store.Store(self.spark).save(self._order(query, now, r, **kw))
        if layout == "flat":
            items = order.join(r, "id").withColumn("text", T.render_item((F.col("source") <= 3) | F.col("quarantined")))
            items = items.withColumn("cost", T.count_tokens(F.col("text")) + 1)
            kept = packing.flat(items, budget or FLAT_BUDGET).select(F.posexplode("kept").alias("pos", "id"))
            return "\n".join([packing.HEADER, *[x.text for x in kept.join(items.select("id", "text"), "id").orderBy("pos").collect()]])
        f = Filter(scope=kw.get("scope", Scope()), now=now, as_of=kw.get("as_of"), include_quarantined=kw.get("include_quarantined", False))
        near = scans.neighbours(r, order, f)
        around = near.select(F.explode(F.array("before", "after")).alias("id")).where("id IS NOT NULL").distinct().join(order.select("id"), "id", "left_anti")
        rows = order.select("id", F.col("place").cast("int").alias("place")).unionByName(around.select("id", F.lit(None).cast("int").alias("place")))
        rows = rows.join(near, "id", "left").join(r, "id").select(F.lit(1).cast("long").alias("query_id"), "id", "kind", "content", "source", "quarantined", F.col("scope_session").alias("session"), "t_event", "ingest_seq", "before", "after", "place")
        packed = packing.sessions(rows, budget or BUDGET, with_dates).head()
        return packed.text if packed and packed.ids else ""

    def pack_messages(self, messages: list[dict], now: int, **kw) -> list[dict]:
        """The messages with the packed context of the last thing a user said, after the leading system messages."""
        said = next((m["content"] for m in reversed(messages) if m.get("role") == "user"), "")
        context = self.pack(str(said), now, **kw) if said else ""
        lead = next((n for n, m in enumerate(messages) if m.get("role") != "system"), len(messages))
        return [*messages[:lead], {"role": "system", "content": context}, *messages[lead:]] if context else list(messages)

    def find_ids(self, query: str, now: int, scope: Scope = Scope(), as_of: int | None = None, kinds: tuple[str, ...] | None = None) -> tuple[list[str], str]:
        """Ids that a sweep would delete, and their fingerprint. Every lane gives up to SWEEP_LIMIT hits."""
        q, r, f, k = self._asked(query), store.Store(self.spark).save(self.records(now)), Filter(scope=scope, now=now, as_of=as_of, kinds=kinds), fusion.SWEEP_LIMIT
        swept = fusion.sweep({"bm25": lanes.bm25(r, q, f, k), "entity": lanes.entity(r, q, f, k), "vector": self._vector_lane(r, query, f, k)})
        ids = sorted(x.id for x in swept.collect())  # three lanes of one query
        return ids, hashlib.sha256("\n".join(ids).encode()).hexdigest()[:32]

    def forget(self, query: str, now: int, fingerprint: str, scope: Scope = Scope()) -> list[str]:
        """Delete what ``find_ids`` showed; refused if that has changed since."""
        ids, mark = self.find_ids(query, now, scope)
        if mark != fingerprint:
            raise ValueError("what the query matches has changed; look again")
        if ids:
            self.delete_many(ids, now)
        return ids

    def get(self, key: str, now: int) -> DataFrame:
        return scans.by_id(self.records(now), key)

    def history(self, key: str, now: int) -> DataFrame:
        """All versions of a record, oldest first."""
        return fold.history(self.records(now), self.spark.createDataFrame([(key,)], "start string")).orderBy("t_ingested", "id")

    def session_raw_count(self, session: str, now: int, most: int = 1000) -> int:
        return scans.session(self.records(now), session, limit=most).count()

    def stats(self, now: int) -> dict:
        return scans.stats(self.records(now), self.vectors()).first().asDict() | {"namespace": self.namespace, "embedder": self.model_name, "seq": self.seq}

    def status(self) -> dict:
        return {"namespaces": namespaces(self.spark, self.path), "namespace": self.namespace, "version": self._version()}

    # export and import

    def export(self, now: int) -> DataFrame:
        return fold.export(self.log(), now)

    def export_jsonl(self, now: int, path: str) -> None:
        """Files of one record a line, in order of ingestion."""
        self.export(now).orderBy("t_ingested", "id").select("line").write.text(path)

    def import_jsonl(self, path: str, now: int) -> int:
        """Restore exported files; ids are kept, and ids already here are left as they are."""
        rows = model.restored(self.spark.read.text(path), self.namespace)
        return self._import(rows.join(self.log().select("id").distinct(), "id", "left_anti"), now)

    def import_foreign(self, path: str, now: int) -> int:
        """Facts from files of JSON lines of another system."""
        rows = model.foreign(self.spark.read.text(path).withColumnRenamed("value", "line"))
        made = F.concat_ws("-", F.lit("x"), F.substring(F.sha2(F.concat_ws("\n", "content", "scope_user", F.col("t_event").cast("string")), 256), 1, 24))
        return self._import(rows.withColumn("id", made).withColumn("t_event", F.coalesce("t_event", F.lit(now))).withColumn("lineage", F.array().cast("array<string>")).withColumn("entity_keys", F.array().cast("array<string>")), now)

    def _import(self, rows: DataFrame, now: int) -> int:
        names = [f.name for f in model.record_schema() if f.name in rows.columns and f.name not in ("ns", "ingest_seq")]
        rows = store.Store(self.spark).save(rows.dropDuplicates(["id"]).select(*names))
        n = rows.count()
        if n:
            self.seq += 1  # one batch: its records share a seq and are told apart by their ids
            self._append(self._written(rows.withColumn("seq", F.lit(self.seq).cast("long")), now))
        return n
