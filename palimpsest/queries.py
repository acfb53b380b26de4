"""The registered queries over the driver's tables, each beside its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions import dates
from palimpsest.functions import text as T
from palimpsest.functions.visibility import Filter, Scope, fenced, scope_visible, valid_as_of, valid_now, vector_live, visible
from palimpsest.functions.stem import stemmed
from palimpsest.operators import derive, evaluate, fold, fusion, lanes, packing, policy, prefix, scans
from palimpsest.plans import planner
from palimpsest.sources import model
from palimpsest.sources.model import DAY, T0
from palimpsest.sources.store import Store
from palimpsest.streaming import replay

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NOW = T0 + 70 * DAY
AS_OF = T0 + 60 * DAY
ME = Filter(scope=Scope(user="u3"), now=NOW)
SESSION = Filter(scope=Scope(user="u3", session="s13"), now=NOW)
#: The searches that the lane queries answer: id, text.
SEARCHES = (
    (1, "what is the thing of eringing with purchase"),
    (2, "recently seen click of user 7"),
    (3, "how to install signup error of u12"),
    (4, "elle que tion, latest view number 42"),
    (5, "ungheit keit und der signup"),
)

U, L = T.UPPER, T.LOWER
SPLIT = "[^a-z0-9\\x{80}-\\x{10FFFF}]+"
MSG = f"""
msg AS (SELECT printf('c%06d-%04d', conv_id, turn) AS id, 'raw_event' AS kind, text AS content, 'o' || (conv_id % 3) AS scope_org,
  CASE WHEN conv_id % 7 <> 3 THEN 'u' || (conv_id % 10) END AS scope_user, CASE WHEN conv_id % 11 <> 5 THEN 's' || conv_id END AS scope_session,
  CASE role WHEN 'user' THEN 5 WHEN 'assistant' THEN 4 WHEN 'agent' THEN 4 ELSE 3 END AS source, role || ':' || (conv_id % 10) AS actor_id,
  's' || conv_id AS prov_session, {T0} + conv_id * {DAY} + turn * 60000 AS t_event, {T0} + conv_id * {DAY} + turn * 60000 + 1000 AS t_ingested,
  CASE WHEN turn = 3 THEN {T0} + conv_id * {DAY} + turn * 60000 + {DAY} END AS valid_from, CAST(NULL AS BIGINT) AS invalidated_at,
  CAST(NULL AS VARCHAR) AS superseded_by, CAST([] AS VARCHAR[]) AS entity_keys, (conv_id * 8 + turn) % 29 = 0 AS quarantined,
  (conv_id * 8 + turn) % 37 = 0 AS deleted, conv_id * 1000 + turn AS ingest_seq FROM conversations)"""
FACT = """
ev AS (SELECT *, (epoch_us(ts) // 1000) AS at_ms, lead(event_id) OVER w AS next_id, lead((epoch_us(ts) // 1000)) OVER w AS next_at FROM events
  WINDOW w AS (PARTITION BY user_id, event_type ORDER BY (epoch_us(ts) // 1000), event_id)),
fact AS (SELECT printf('e%09d', event_id) AS id, 'fact' AS kind, 'user ' || user_id || ' did ' || event_type || ' number ' || event_id AS content,
  'o' || (user_id % 3) AS scope_org, 'u' || (user_id % 10) AS scope_user, CAST(NULL AS VARCHAR) AS scope_session, CAST(event_id % 5 + 1 AS INTEGER) AS source,
  'app:' || (user_id % 10) AS actor_id, CAST(NULL AS VARCHAR) AS prov_session, at_ms AS t_event, at_ms + 500 AS t_ingested, CAST(NULL AS BIGINT) AS valid_from,
  next_at AS invalidated_at, CASE WHEN next_id IS NOT NULL THEN printf('e%09d', next_id) END AS superseded_by,
  [event_type || '.u' || user_id] AS entity_keys, false AS quarantined, false AS deleted, event_id + 1000000000 AS ingest_seq FROM ev)"""
REC = f"{MSG}, {FACT}, rec AS (SELECT * FROM msg UNION ALL SELECT * FROM fact)"
VEC = "vec AS (SELECT CASE WHEN vec_id % 2 = 0 THEN printf('e%09d', vec_id) ELSE printf('c%06d-%04d', vec_id // 5, vec_id % 5) END AS id, CASE WHEN vec_id % 5 = 0 THEN 'old' ELSE 'new' END AS model, CAST(embedding AS DOUBLE[]) AS vec, vec_id FROM embeddings)"
LIVE = "NOT deleted AND invalidated_at IS NULL AND superseded_by IS NULL"
VALID = f"({LIVE} AND (valid_from IS NULL OR valid_from <= {NOW}))"
MINE = f"({VALID} AND (scope_user IS NULL OR scope_user = 'u3') AND (scope_session IS NULL OR scope_user IS NOT NULL) AND NOT quarantined)"
THEN = f"(NOT deleted AND (invalidated_at IS NULL OR invalidated_at > {AS_OF}) AND (valid_from IS NULL OR valid_from <= {AS_OF}))"
Q = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in SEARCHES) + ") AS v(query_id, text))"
STOP = "[" + ", ".join(f"'{w}'" for w in T.SEARCH_STOPWORDS) + "]"
TERMS = f"""
raw_terms AS (SELECT query_id, unnest(string_split_regex(text, '[ \\t\\r\\n]+')) AS w, unnest(range(len(string_split_regex(text, '[ \\t\\r\\n]+')))) AS pos FROM q),
clean_terms AS (SELECT query_id, regexp_replace(lower(w), '[^a-z0-9_\\-\\x{{80}}-\\x{{10FFFF}}]', '', 'g') AS term, pos FROM raw_terms),
qt AS (SELECT query_id, term, min(pos) AS pos FROM clean_terms WHERE term <> '' AND NOT list_contains({STOP}, term) GROUP BY ALL)"""


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def simple(name: str, f, oracle: str | None = None):
    query(name, oracle)(lambda s, d: f(model.records(s, d)))


def searches(s: SparkSession) -> DataFrame:
    return s.createDataFrame(list(SEARCHES), "query_id int, text string")


# scans -----------------------------------------------------------------------------------

simple("scan_records", lambda r: scans.ranked(r.where(visible(ME)).select("id", "t_event").orderBy(F.desc("t_event"), "id").limit(100), F.desc("t_event"), "id"),
       f"WITH {REC} SELECT id, t_event, row_number() OVER (ORDER BY t_event DESC, id) AS rank FROM rec WHERE {MINE} ORDER BY t_event DESC, id LIMIT 100")
simple("scan_all", lambda r: r.select("id", "kind", "scope_user", "source", "t_event", "deleted"), f"WITH {REC} SELECT id, kind, scope_user, source, t_event, deleted FROM rec")
simple("get_by_id", lambda r: scans.by_id(r, "c000012-0001").select("id", "content", "source"), f"WITH {REC} SELECT id, content, source FROM rec WHERE id = 'c000012-0001' AND NOT deleted")
IDS = ["e000000042", "c000003-0001", "nowhere", "c000001-0000", "e000000007"]
_ids = "w AS (SELECT unnest([" + ", ".join(f"'{i}'" for i in IDS) + f"]) AS id, unnest(range(1, {len(IDS) + 1})) AS pos)"
simple("get_many", lambda r: scans.many(r, IDS).select("pos", "id", "content"), f"WITH {REC}, {_ids} SELECT pos, id, content FROM rec JOIN w USING (id)")
simple("get_visible", lambda r: scans.many(r, IDS, visible(Filter(now=NOW))).select("pos", "id"), f"WITH {REC}, {_ids} SELECT pos, id FROM rec JOIN w USING (id) WHERE {VALID} AND NOT quarantined")
simple("rowids", lambda r: r.select("id", "ingest_seq"), f"WITH {REC} SELECT id, ingest_seq FROM rec")
simple("known_ids", lambda r: scans.known(r.where("kind = 'fact'"), r.where("kind = 'raw_event' AND deleted"), r.select("id")).select("id"), f"WITH {REC} SELECT id FROM rec WHERE kind = 'fact' OR deleted")
simple("session_records", lambda r: scans.session(r, "s13", "u3").select("id", "t_event"), f"WITH {REC} SELECT id, t_event FROM rec WHERE scope_session = 's13' AND kind = 'raw_event' AND NOT deleted AND NOT quarantined AND (scope_user IS NULL OR scope_user = 'u3')")
simple("session_count", lambda r: r.where("scope_session IS NOT NULL AND kind = 'raw_event' AND NOT deleted AND NOT quarantined").groupBy("scope_session").agg(F.least(F.count("*"), F.lit(1000)).alias("n")),
       f"WITH {REC} SELECT scope_session, least(count(*), 1000) AS n FROM rec WHERE scope_session IS NOT NULL AND kind = 'raw_event' AND NOT deleted AND NOT quarantined GROUP BY 1")


@query("jsonl_codec", f"WITH {REC} SELECT id, content, scope_user, source, t_event, deleted FROM rec")
def jsonl_codec(s, d):
    line = F.to_json(F.struct(*[f.name for f in model.record_schema()], F.lit("x").alias("unknown_key")))
    back = F.from_json(line, model.record_schema())
    return model.records(s, d).select(back.alias("r")).select("r.id", "r.content", "r.scope_user", "r.source", "r.t_event", "r.deleted")


def _log(s: SparkSession, d: str) -> DataFrame:
    """The facts as a log: writes, then supersedes, tombstones, quarantines and hard deletes, some undone by a later write."""
    plain = model.facts(s, d).withColumn("invalidated_at", F.lit(None).cast("long")).withColumn("superseded_by", F.lit(None).cast("string"))
    old = model.facts(s, d).where("superseded_by IS NOT NULL")
    n = F.col("ingest_seq") - 1_000_000_000
    w = fold.writes(plain, n * 10)
    return fold.merge(
        w,
        w,  # a retried write is one event
        fold.ops(old.select("ns", "id", "ingest_seq", "superseded_by", "invalidated_at"), "supersede", n * 10 + 5, new=F.col("superseded_by"), at=F.col("invalidated_at")),
        fold.ops(plain.where(n % 17 == 0), "tombstone", n * 10 + 6, at=F.col("t_event") + 99),
        fold.ops(plain.where(n % 13 == 0), "quarantine", n * 10 + 3, flag=F.lit(True), expires=F.when(n % 2 == 0, F.lit(NOW - 1)).otherwise(F.lit(NOW + 1))),
        fold.ops(plain.where(n % 19 == 0), "hard_delete", n * 10 + 4, deadline=F.when(n % 3 == 0, F.lit(NOW + 5)).otherwise(F.lit(NOW - 5))),
        fold.writes(plain.where(n % 38 == 0), n * 10 + 8),
    )


_n = "(ingest_seq - 1000000000)"
_again = f"{_n} % 38 = 0"
_kept = f"NOT ({_n} % 19 = 0 AND {_n} % 3 <> 0 AND NOT {_again}) AND NOT ({_n} % 17 = 0 AND NOT {_again})"
_folded = f"""SELECT id, CASE WHEN {_again} THEN NULL ELSE superseded_by END AS superseded_by, CASE WHEN {_again} THEN NULL ELSE invalidated_at END AS invalidated_at,
  ({_n} % 13 = 0 AND {_n} % 2 <> 0 AND NOT {_again}) AS quarantined FROM fact WHERE {_kept}"""


@query("fold_events", f"WITH {FACT} {_folded}")
def fold_events(s, d):
    return fold.fold(_log(s, d), NOW).select("id", "superseded_by", "invalidated_at", "quarantined")


@query("merge_events", f"WITH {FACT} SELECT count(*) + count(superseded_by) + count(CASE WHEN {_n} % 17 = 0 THEN 1 END) + count(CASE WHEN {_n} % 13 = 0 THEN 1 END) + count(CASE WHEN {_n} % 19 = 0 THEN 1 END) + count(CASE WHEN {_again} THEN 1 END) AS n FROM fact")
def merge_events(s, d):
    return fold.events(_log(s, d)).agg(F.count("*").alias("n"))


@query("merged_kinds", f"""WITH {FACT}, k AS (SELECT 'write' AS kind, {_n} AS n FROM fact UNION ALL SELECT 'write', {_n} FROM fact WHERE {_again} UNION ALL SELECT 'supersede', {_n} FROM fact WHERE superseded_by IS NOT NULL
  UNION ALL SELECT 'tombstone', {_n} FROM fact WHERE {_n} % 17 = 0 UNION ALL SELECT 'quarantine', {_n} FROM fact WHERE {_n} % 13 = 0 UNION ALL SELECT 'hard_delete', {_n} FROM fact WHERE {_n} % 19 = 0)
  SELECT printf('e%09d', n) AS id, kind, count(*) AS n FROM k GROUP BY 1, 2""")
def merged_kinds(s, d):
    return fold.events(_log(s, d)).groupBy("id", "kind").agg(F.count("*").alias("n"))


@query("replay_cut", f"WITH {FACT} {_folded}")
def replay_cut(s, d):
    """A checkpoint in mid-log, made before the deletes and quarantines run out, then the rest:
    pending ops carried on; equals the fold from scratch."""
    store = Store(s)
    log = store.save(_log(s, d))
    cut = log.agg(F.max("seq")).first()[0] // 2
    first = store.save(fold.carry(log.where(F.col("seq") <= cut), NOW - 10))
    return fold.fold(first.unionByName(log.where(F.col("seq") > cut)), NOW).select("id", "superseded_by", "invalidated_at", "quarantined")


@query("rotate", f"WITH {FACT} {_folded}")
def rotate(s, d):
    """Three rotations at growing times: each folds the checkpoint and what came since, and carries what is unsettled."""
    store = Store(s)
    log = store.save(_log(s, d))
    top = log.agg(F.max("seq")).first()[0]
    kept, last = None, 0
    for k, cut in enumerate((top // 5, top // 2, top * 9 // 10)):
        part = log.where((F.col("seq") > last) & (F.col("seq") <= cut))
        kept, last = store.save(fold.carry(part if kept is None else kept.unionByName(part), NOW - 10 + k)), cut
    return fold.fold(kept.unionByName(log.where(F.col("seq") > last)), NOW).select("id", "superseded_by", "invalidated_at", "quarantined")


@query("compact_forced", f"WITH {FACT} SELECT id FROM fact WHERE NOT ({_n} % 19 = 0 AND NOT {_again}) AND NOT ({_n} % 17 = 0 AND NOT {_again})")
def compact_forced(s, d):
    return fold.fold(_log(s, d), NOW, force=True).select("id")


@query("purge_due", f"WITH {FACT} SELECT id, {NOW - 5} AS deadline FROM fact WHERE {_n} % 19 = 0 AND {_n} % 3 <> 0")
def purge_due(s, d):
    return _log(s, d).where((F.col("op.op") == "hard_delete") & (F.col("op.deadline") <= NOW)).select("id", F.col("op.deadline").alias("deadline"))


@query("export_visible", f"WITH {FACT} SELECT id, t_ingested FROM fact WHERE {_kept} AND NOT ({_n} % 19 = 0 AND {_n} % 3 = 0)")
def export_visible(s, d):
    return fold.export(_log(s, d), NOW).select("id", "t_ingested")


@query("import_native", f"WITH {REC} SELECT id, 'restored' AS ns, content, t_event FROM rec")
def import_native(s, d):
    """Lines of an export, written as text files and restored under another namespace."""
    path = f"{Store(s).path}/export"
    model.records(s, d).select(F.to_json(F.struct(*[f.name for f in model.record_schema()])).alias("value")).write.text(path)
    return model.restored(s.read.text(path), "restored").select("id", "ns", "content", "t_event")


@query("import_foreign", "SELECT event_type || ' ' || event_id AS content, CASE WHEN event_id % 2 = 0 THEN ((epoch_us(ts) // 1000) // 1000) * 1000 ELSE (epoch_us(ts) // 1000) END AS t_event, 'u' || user_id AS scope_user, 1 AS source, 'fact' AS kind FROM events")
def import_foreign(s, d):
    e = model.table(s, d, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    text, u = F.concat_ws(" ", "event_type", F.col("event_id").cast("string")), F.concat(F.lit("u"), "user_id")
    a = F.to_json(F.struct(text.alias("memory"), F.floor(F.col("ms") / 1000).alias("created_at"), u.alias("user_id")))
    b = F.to_json(F.struct(F.lit("").alias("memory"), text.alias("data"), F.col("ms").alias("timestamp"), F.struct(u.alias("user_id")).alias("metadata")))
    return model.foreign(e.select(F.when(F.col("event_id") % 2 == 0, a).otherwise(b).alias("line")))


@query("import_nested", "SELECT 's' || conv_id AS session, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS turn, role, text AS content FROM conversations")
def import_nested(s, d):
    """Sessions as nested lists of turns, exploded to events."""
    c = model.table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return c.select(F.concat(F.lit("s"), "conv_id").alias("session"), F.posexplode("turns").alias("turn", "t")).select("session", "turn", "t.role", F.col("t.text").alias("content"))


@query("audit_log", """WITH e AS (SELECT user_id, event_id AS n, event_id % 50 <> 0 AND event_id % 83 <> 0 AS ok FROM events)
  SELECT n, ok, bool_and(ok) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS verified FROM e""")
def audit_log(s, d):
    """A sealed chain of entries per user; then every 50th body is forged and every 83rd entry is linked anew."""
    body = F.concat_ws("|", "event_type", F.col("event_id").cast("string"))
    rows = model.table(s, d, "events").groupBy(F.col("user_id").alias("ledger")).agg(F.array_sort(F.collect_list(F.struct(F.col("event_id").alias("n"), body.alias("body")))).alias("rows"))
    start = F.array().cast("array<struct<n: long, body: string, prev: string, h: string>>")

    def grow(chain, r):  # an entry is sealed over the hash before it, so a ledger is built in order
        prev = F.coalesce(F.try_element_at(chain, F.lit(-1))["h"], F.lit(""))
        return F.array_append(chain, F.struct(r["n"].alias("n"), r["body"].alias("body"), prev.alias("prev"), policy.seal(prev, r["body"]).alias("h")))

    e = rows.select("ledger", F.inline(F.aggregate("rows", start, grow)))
    e = e.withColumn("body", F.when(F.col("n") % 50 == 0, F.lit("forged")).otherwise(F.col("body"))).withColumn("prev", F.when(F.col("n") % 83 == 0, F.lit("0")).otherwise(F.col("prev")))
    return policy.verify_chain(e).select("n", "ok", "verified")


# predicates ------------------------------------------------------------------------------

simple("scope_visible", lambda r: r.where(scope_visible(SESSION.scope)).select("id"),
       f"WITH {REC} SELECT id FROM rec WHERE (scope_user IS NULL OR scope_user = 'u3') AND (scope_session IS NULL OR scope_session = 's13') AND (scope_session IS NULL OR scope_user IS NOT NULL OR scope_session = 's13')")
simple("valid_now", lambda r: r.where(valid_now(NOW)).select("id"), f"WITH {REC} SELECT id FROM rec WHERE {VALID}")
simple("valid_as_of", lambda r: r.where(valid_as_of(AS_OF)).select("id"), f"WITH {REC} SELECT id FROM rec WHERE {THEN}")
_narrow = Filter(scope=Scope(org="o1"), as_of=AS_OF, kinds=("fact", "raw_event"), sources=(5, 4, 1), t_min=T0 + 40 * DAY, t_max=T0 + 60 * DAY)
simple("record_filters", lambda r: r.where(visible(_narrow)).select("id"),
       f"WITH {REC} SELECT id FROM rec WHERE {THEN} AND (scope_org IS NULL OR scope_org = 'o1') AND kind IN ('fact', 'raw_event') AND source IN (5, 4, 1) AND t_event BETWEEN {T0 + 40 * DAY} AND {T0 + 60 * DAY} AND NOT quarantined")
simple("entity_filter", lambda r: r.where(visible(Filter(now=NOW, entity="click.u7"))).select("id"), f"WITH {REC} SELECT id FROM rec WHERE {VALID} AND NOT quarantined AND list_contains(entity_keys, 'click.u7')")
simple("exclude_ids", lambda r: scans.ranked(scans.scan(r, ME, 20, r.where("source = 5")).select("id", "t_event"), F.desc("t_event"), "id"),
       f"WITH {REC} SELECT id, t_event, row_number() OVER (ORDER BY t_event DESC, id) AS rank FROM rec WHERE {MINE} AND source <> 5 ORDER BY t_event DESC, id LIMIT 20")
simple("passes_filter", lambda r: r.select("id", visible(ME).alias("passes")), f"WITH {REC} SELECT id, {MINE} AS passes FROM rec")
simple("vector_live", lambda r: r.where(vector_live()).select("id"), f"WITH {REC} SELECT id FROM rec WHERE {LIVE} AND NOT quarantined")
simple("candidate_projection", lambda r: r.select("id", F.date_format(F.timestamp_millis("t_event"), "yyyy-MM-dd'T'HH:mm").alias("date"), F.split("actor_id", ":")[0].alias("role"), F.substring("content", 1, 2000).alias("text")),
       f"WITH {REC} SELECT id, strftime(make_timestamp(t_event * 1000), '%Y-%m-%dT%H:%M') AS date, string_split(actor_id, ':')[1] AS role, content[1:2000] AS text FROM rec")
query("resolve_source", "SELECT role, CASE role WHEN 'user' THEN 5 WHEN 'assistant' THEN 4 ELSE 3 END AS source, count(*) AS n FROM conversations GROUP BY 1, 2")(
    lambda s, d: model.table(s, d, "conversations").groupBy("role", model.source_of_role(F.col("role")).alias("source")).agg(F.count("*").alias("n")))
simple("trust_fence", lambda r: r.select("id", fenced().alias("fenced")), f"WITH {REC} SELECT id, source <= 3 OR quarantined AS fenced FROM rec")
simple("input_guards", lambda r: model.guard(r).groupBy("kind").agg(F.count("*").alias("n")), f"WITH {REC} SELECT kind, count(*) AS n FROM rec GROUP BY 1")
simple("scope_pinning", lambda r: model.pin_scope(r, "u3").groupBy("scope_user", "source").agg(F.count("*").alias("n")),
       f"WITH {REC} SELECT 'u3' AS scope_user, CASE WHEN source = 5 AND coalesce(actor_id, 'u3') <> 'u3' THEN 4 ELSE source END AS source, count(*) AS n FROM rec GROUP BY 1, 2")

# joins -----------------------------------------------------------------------------------

query("join_vectors", f"WITH {REC}, {VEC} SELECT rec.id, CAST(len(vec.vec) AS BIGINT) AS dim FROM rec JOIN vec USING (id) WHERE {LIVE} AND NOT quarantined")(
    lambda s, d: model.records(s, d).where(vector_live()).join(model.vectors(s, d), "id").select("id", "dim"))
query("left_join_missing", f"WITH {REC}, {VEC} SELECT rec.id, CAST(length(content) AS INTEGER) AS chars FROM rec LEFT JOIN vec USING (id) WHERE NOT deleted AND invalidated_at IS NULL AND (model IS NULL OR model <> 'new')")(
    lambda s, d: scans.stale_vectors(model.records(s, d), model.vectors(s, d), "new").select("id", F.length("content").alias("chars")))
simple("semi_entity", lambda r: r.join(r.select("id", F.explode("entity_keys").alias("k")).where("k LIKE 'click.%'").select("id"), "id", "left_semi").select("id"), f"WITH {REC} SELECT id FROM rec WHERE entity_keys[1] LIKE 'click.%'")


@query("link_expand", f"""WITH {REC}, l AS (SELECT id AS src, superseded_by AS dst FROM rec WHERE superseded_by IS NOT NULL), s AS (SELECT id FROM rec WHERE kind = 'fact' AND content LIKE '%signup%' AND source = 1),
  r AS (SELECT dst AS id FROM l WHERE src IN (SELECT id FROM s) UNION SELECT src FROM l WHERE dst IN (SELECT id FROM s))
  SELECT id FROM rec WHERE NOT deleted AND id IN (SELECT id FROM r) AND id NOT IN (SELECT id FROM s)""")
def link_expand(s, d):
    r = model.records(s, d)
    links = r.where("superseded_by IS NOT NULL").select(F.col("id").alias("src"), F.col("superseded_by").alias("dst"))
    return scans.expand(r, links, r.where("kind = 'fact' AND content LIKE '%signup%' AND source = 1")).select("id")


_turns = f"t AS (SELECT id, scope_session, t_event, ingest_seq, ({VALID} AND NOT quarantined) AS shown FROM rec WHERE kind = 'raw_event' AND scope_session IS NOT NULL)"
simple("adjacency", lambda r: scans.neighbours(r, r.where("kind = 'raw_event'"), Filter(now=NOW)),
       f"""WITH {REC}, {_turns} SELECT id, (SELECT max_by(b.id, (b.t_event, b.ingest_seq)) FROM t b WHERE b.scope_session = t.scope_session AND b.shown AND (b.t_event, b.ingest_seq) < (t.t_event, t.ingest_seq)) AS before,
       (SELECT min_by(b.id, (b.t_event, b.ingest_seq)) FROM t b WHERE b.scope_session = t.scope_session AND b.shown AND (b.t_event, b.ingest_seq) > (t.t_event, t.ingest_seq)) AS after FROM t""")
simple("lineage_join", lambda r: scans.sources_of(r, r.where("kind = 'raw_event'").withColumn("lineage", F.array(F.regexp_replace("id", "-....$", "-0001"), F.regexp_replace("id", "-....$", "-0000"))), Filter(now=NOW)),
       f"WITH {REC}, l AS (SELECT id, unnest([0, 1]) AS pos, unnest([id[1:7] || '-0001', id[1:7] || '-0000']) AS source_id FROM msg) SELECT l.id, CAST(pos AS BIGINT) AS pos, source_id FROM l JOIN rec ON rec.id = source_id WHERE {VALID} AND NOT quarantined")
simple("as_of_facts", lambda r: r.where((F.col("kind") == "fact") & valid_as_of(AS_OF) & (F.col("t_event") <= AS_OF)).select(F.get("entity_keys", F.lit(0)).alias("key"), "id"),
       f"WITH {REC} SELECT entity_keys[1] AS key, id FROM rec WHERE kind = 'fact' AND {THEN} AND t_event <= {AS_OF}")

# lanes -----------------------------------------------------------------------------------

BM25 = f"""{REC}, {Q}, {TERMS},
tok AS (SELECT id, [x FOR x IN string_split_regex(translate(coalesce(content, ''), '{U}', '{L}'), '{SPLIT}') IF x <> ''] AS toks FROM rec),
tot AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM tok),
post AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(toks) AS dl, unnest(toks) AS term FROM tok) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
idf AS (SELECT term, greatest(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM post, tot GROUP BY term),
bscore AS (SELECT query_id, post.id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM post JOIN idf USING (term) JOIN qt USING (term), tot GROUP BY ALL),
bm AS (SELECT query_id, rec.id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, t_event DESC, sha256(coalesce(content, '')), rec.id) AS rank FROM bscore JOIN rec USING (id) WHERE {MINE}),
bm25 AS (SELECT * FROM bm WHERE rank <= 40)"""
ENT = f"""et AS (SELECT DISTINCT query_id, regexp_replace(translate(w, '{U}', '{L}'), '[^a-z0-9_-]', '', 'g') AS segment FROM raw_terms WHERE pos < 8),
eh AS (SELECT query_id, id, any_value(t_event) AS t_event FROM (SELECT id, t_event, unnest(string_split(key, '.')) AS segment FROM (SELECT id, t_event, unnest(entity_keys) AS key FROM rec WHERE {MINE})) JOIN et USING (segment) WHERE length(segment) >= 3 GROUP BY ALL),
en AS (SELECT query_id, id, 1.0::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY t_event DESC, id) AS rank FROM eh),
entity AS (SELECT * FROM en WHERE rank <= 20)"""
TIME = f"""newest AS (SELECT id, row_number() OVER (ORDER BY t_event DESC, id) AS rank FROM rec WHERE {MINE} ORDER BY t_event DESC, id LIMIT 40),
recent AS (SELECT query_id, id, 0.0::DOUBLE AS score, rank FROM q, newest WHERE regexp_matches(text, '{planner.RECENCY}'))"""
VECTOR = f"""{VEC}, qv AS (SELECT vec_id + 1 AS query_id, vec AS asked FROM vec WHERE vec_id < 5),
vs AS (SELECT query_id, rec.id, round(list_cosine_similarity(vec, asked), 6) AS score, t_event, content FROM rec JOIN vec USING (id), qv WHERE {MINE}),
vr AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY floor(score / 1e-6 + 0.5) DESC, t_event DESC, sha256(coalesce(content, '')), id) AS rank FROM vs WHERE score >= 0.02),
vector AS (SELECT * FROM vr WHERE rank <= 40)"""


def _vector_queries(s, d):
    return model.table(s, d, "embeddings").where("vec_id < 5").select((F.col("vec_id") + 1).cast("int").alias("query_id"), F.col("embedding").cast("array<double>").alias("vec"))


def _saved(s, d) -> DataFrame:
    """The records written once, for queries that read them from several lanes."""
    return Store(s).save(model.records(s, d))


def _lanes(s, d, r: DataFrame | None = None) -> dict[str, DataFrame]:
    r, q = model.records(s, d) if r is None else r, searches(s)
    return {
        "bm25": lanes.bm25(r, q, ME, 40),
        "entity": lanes.entity(r, q, ME),
        "time": lanes.recent(r, q.where(planner.wants_recent(F.col("text"))), ME, 40),
        "vector": lanes.vector(r, model.vectors(s, d), _vector_queries(s, d), ME, 40),
    }


query("bm25_stemmed")(lambda s, d: lanes.bm25(_saved(s, d), searches(s), ME, 40, term_of=stemmed))
query("vector_ann")(lambda s, d: lanes.approximate(model.records(s, d), model.vectors(s, d), _vector_queries(s, d), ME, 40, 16, 10))
query("query_terms", f"WITH {Q}, {TERMS} SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank FROM qt")(
    lambda s, d: searches(s).select("query_id", F.posexplode(T.query_terms(F.col("text"))).alias("p", "term")).select("query_id", "term", (F.col("p") + 1).cast("long").alias("rank")))
query("bm25", f"WITH {BM25} SELECT query_id, id, score, rank FROM bm25")(lambda s, d: _lanes(s, d)["bm25"])
query("entity_lane", f"WITH {REC}, {Q}, {TERMS}, {ENT} SELECT * FROM entity")(lambda s, d: _lanes(s, d)["entity"])
query("time_lane", f"WITH {REC}, {Q}, {TIME} SELECT * FROM recent")(lambda s, d: _lanes(s, d)["time"])
query("vector_exact", f"WITH {REC}, {VECTOR} SELECT CAST(query_id AS INTEGER) AS query_id, id, score, rank FROM vector")(lambda s, d: _lanes(s, d)["vector"])

# planning and fusion ---------------------------------------------------------------------

_class = "CASE " + " ".join(f"WHEN regexp_matches(text, '{rx}') THEN '{n}'" for n, rx in planner.CLASSES) + " ELSE 'exploratory' END"
_weight = "CASE " + " ".join(f"WHEN qclass = '{c}' AND lane = '{k}' THEN {w}" for c, ws in planner.WEIGHTS.items() for k, w in ws.items()) + " ELSE 1.0 END"
PLAN = f"plan AS (SELECT query_id, text, {_class} AS qclass FROM q)"
FUSED = f"""{BM25}, {ENT}, {TIME}, {VECTOR}, {PLAN},
hit AS (SELECT query_id, id, rank, 'bm25' AS lane FROM bm25 UNION ALL SELECT query_id, id, rank, 'entity' FROM entity UNION ALL SELECT query_id, id, rank, 'time' FROM recent UNION ALL SELECT query_id, id, rank, 'vector' FROM vector),
part AS (SELECT query_id, id, sum(CAST({_weight} AS DOUBLE) / (60 + rank)) AS raw, array_to_string(list_sort(list_distinct(list(lane))), ',') AS lanes FROM hit JOIN plan USING (query_id) GROUP BY ALL),
fs AS (SELECT query_id, id, lanes, round(raw * greatest(1 + greatest(CAST(0.01 AS DOUBLE) * (source - 3), 0.0), CAST(CASE kind WHEN 'fact' THEN 1.15 ELSE 1.0 END AS DOUBLE)), 9) AS score, t_event, content, kind FROM part JOIN rec USING (id)),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, t_event DESC, sha256(coalesce(content, '')), id) AS rank FROM fs QUALIFY rank <= 50)"""


def _fused(s, d, r: DataFrame | None = None) -> DataFrame:
    r = _saved(s, d) if r is None else r
    return fusion.fuse(_lanes(s, d, r), searches(s), r, 50)


def _packing_order(s, d) -> DataFrame:
    r = _saved(s, d)
    return fusion.packing_order(Store(s).save(_fused(s, d, r)), r)


query("plan_query", f"WITH {Q}, {PLAN}, l AS (SELECT unnest(['bm25', 'entity', 'time', 'vector']) AS lane) SELECT query_id, qclass, lane, CAST({_weight} AS DOUBLE) AS weight, CASE WHEN qclass = 'exploratory' THEN 60 ELSE 40 END AS k, regexp_matches(text, '{planner.RECENCY}') AS use_time FROM plan, l")(
    lambda s, d: searches(s).withColumn("qclass", planner.classify(F.col("text"))).select("query_id", "qclass", "text", F.explode(F.array(*[F.lit(x) for x in planner.LANES])).alias("lane")).select(
        "query_id", "qclass", "lane", planner.weight(F.col("qclass"), F.col("lane")).alias("weight"), planner.candidate_k(F.col("qclass")).alias("k"), planner.wants_recent(F.col("text")).alias("use_time")))
query("classify_turns", f"SELECT {_class} AS qclass, regexp_matches(text, '{planner.RECENCY}') AS recent, count(*) AS n FROM (SELECT event_type || ' when what ' || CASE event_id % 4 WHEN 0 THEN 'run' WHEN 1 THEN 'lately' ELSE '' END AS text FROM events UNION ALL SELECT text FROM conversations) GROUP BY 1, 2")(
    lambda s, d: model.table(s, d, "events").select(F.concat(F.col("event_type"), F.lit(" when what "), F.when(F.col("event_id") % 4 == 0, "run").when(F.col("event_id") % 4 == 1, "lately").otherwise("")).alias("text"))
    .unionByName(model.table(s, d, "conversations").select("text")).groupBy(planner.classify(F.col("text")).alias("qclass"), planner.wants_recent(F.col("text")).alias("recent")).agg(F.count("*").alias("n")))
query("hybrid_search", f"WITH {FUSED} SELECT CAST(query_id AS INTEGER) AS query_id, id, score, lanes, rank FROM fused")(_fused)
simple("recency_boost", lambda r: r.select("id", F.round(fusion.recency_boost(F.lit(1.0), F.col("t_event"), F.lit(NOW)), 9).alias("boost")),
       f"WITH {REC} SELECT id, round(pow(0.5, greatest(0.0, ({NOW} - t_event) / CAST(86400000 AS DOUBLE)) / 365.0), 9) AS boost FROM rec")
query("rank_for_packing", f"""WITH {FUSED}, f2 AS (SELECT *, max(t_event) OVER (PARTITION BY query_id) AS newest FROM fused),
  f3 AS (SELECT query_id, id, t_event, content, round(score * pow(0.5, greatest(0.0, (newest - t_event) / CAST(86400000 AS DOUBLE)) / 365.0) * CASE kind WHEN 'fact' THEN 1.25 ELSE 1.0 END, 9) AS pack_score FROM f2)
  SELECT CAST(query_id AS INTEGER) AS query_id, id, pack_score, row_number() OVER (PARTITION BY query_id ORDER BY pack_score DESC, t_event DESC, sha256(coalesce(content, '')), id) AS place FROM f3""")(
    _packing_order)


def _judged(s, d) -> DataFrame:
    """The shortlist, the 30 best of BM25 and then of vectors, judged by a stub: the share of query terms a text holds."""
    r = _saved(s, d)
    ls = _lanes(s, d, r)
    terms = searches(s).select("query_id", T.query_terms(F.col("text")).alias("terms"))
    held = F.size(F.array_intersect("terms", T.tokens(F.col("content")))) / F.size("terms")
    short = fusion.shortlist(ls["bm25"], ls["vector"], 30)
    return short.join(r.select("id", "content"), "id").join(terms, "query_id").select("query_id", "id", "rank", F.round(held, 6).alias("p"))


JUDGED = f"""tl AS (SELECT query_id, list(term) AS terms FROM qt GROUP BY 1),
sl AS (SELECT query_id, id, min((lane, rank)) AS pos FROM (SELECT query_id, id, 0 AS lane, rank FROM bm25 UNION ALL SELECT CAST(query_id AS INTEGER), id, 1, rank FROM vector) GROUP BY 1, 2),
sr AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank FROM sl),
judged AS (SELECT query_id, sr.id, rank, round(len(list_intersect(terms, toks)) / len(terms), 6) AS p FROM sr JOIN tok USING (id) JOIN tl USING (query_id) WHERE rank <= 30)"""
query("rerank", f"WITH {BM25}, {VECTOR}, {JUDGED} SELECT query_id, id, p, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, rank) AS rank FROM judged")(
    lambda s, d: scans.ranked(_judged(s, d).withColumnRenamed("rank", "input"), F.desc("p"), "input", by="query_id").select("query_id", "id", "p", "rank"))
query("gate_candidates", f"WITH {BM25}, {VECTOR}, {JUDGED}, g AS (SELECT *, max(p) OVER (PARTITION BY query_id) AS best, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, rank) AS n FROM judged) SELECT query_id, id, p FROM g WHERE p >= 0.5 OR (best < 0.5 AND n <= 3)")(
    lambda s, d: fusion.gate(_judged(s, d), 0.5).select("query_id", "id", "p"))
SWEEP = """floor AS (SELECT query_id, CASE WHEN count(*) >= 5 THEN greatest(0.35, quantile_cont(score, 0.5) + 0.1) ELSE 0.35 END AS floor FROM vector GROUP BY 1),
sweep AS (SELECT query_id, id FROM bm25 UNION SELECT query_id, id FROM entity UNION SELECT vector.query_id, id FROM vector JOIN floor USING (query_id) WHERE score >= floor)"""


def _sweep(s, d) -> DataFrame:
    """What a delete by query matches: lanes at the sweep's limit, not at that of a search."""
    r, q, k = _saved(s, d), searches(s), fusion.SWEEP_LIMIT
    return fusion.sweep({"bm25": lanes.bm25(r, q, ME, k), "entity": lanes.entity(r, q, ME, k), "vector": lanes.vector(r, model.vectors(s, d), _vector_queries(s, d), ME, k)})


#: A sweep's lanes hold up to 10,000 hits, in the SQL too.
WIDE = f"{BM25}, {ENT}, {VECTOR}, {SWEEP}".replace("rank <= 40)", f"rank <= {fusion.SWEEP_LIMIT})").replace("rank <= 20)", f"rank <= {fusion.SWEEP_LIMIT})")
query("find_ids", f"WITH {WIDE} SELECT CAST(query_id AS INTEGER) AS query_id, id FROM sweep")(_sweep)
query("forget_fingerprint", f"WITH {WIDE} SELECT CAST(query_id AS INTEGER) AS query_id, count(*) AS n, sha256(string_agg(id, chr(10) ORDER BY id))[1:32] AS fingerprint FROM sweep GROUP BY 1")(
    lambda s, d: fusion.fingerprint(_sweep(s, d)))

# packing ---------------------------------------------------------------------------------

BUDGET = 300
_COST = "greatest(1, (length(content) + 3) // 4)"


def _turn_items(s, d) -> DataFrame:
    """Each conversation's visible turns, newest first, as candidates."""
    r = model.messages(s, d).where(visible(Filter(now=NOW)))
    w = Window.partitionBy("prov_session").orderBy(F.desc("t_event"), "id")
    return r.select(F.col("prov_session").alias("query_id"), F.row_number().over(w).alias("place"), "id", (T.count_tokens(F.col("content")) + 1).alias("cost"))


ITEMS = f"items AS (SELECT prov_session AS query_id, row_number() OVER (PARTITION BY prov_session ORDER BY t_event DESC, id) AS place, id, {_COST} + 1 AS cost FROM msg WHERE {VALID} AND NOT quarantined)"
_head = max(1, (len(packing.HEADER) + 3) // 4)
query("pack_flat", f"""WITH RECURSIVE {MSG}, {ITEMS}, pk AS (
  SELECT query_id, place, CASE WHEN {_head} + cost <= {BUDGET} THEN {_head} + cost ELSE {_head} END AS used, CASE WHEN {_head} + cost <= {BUDGET} THEN id ELSE '' END AS kept FROM items WHERE place = 1
  UNION ALL SELECT i.query_id, i.place, CASE WHEN used + cost <= {BUDGET} THEN used + cost ELSE used END, CASE WHEN used + cost <= {BUDGET} THEN CASE WHEN kept = '' THEN id ELSE kept || ',' || id END ELSE kept END
  FROM pk JOIN items i ON i.query_id = pk.query_id AND i.place = pk.place + 1)
  SELECT query_id, max_by(kept, place) AS kept, CAST(max_by(used, place) AS BIGINT) AS tokens_used FROM pk GROUP BY 1""")(
    lambda s, d: packing.flat(_turn_items(s, d), BUDGET).select("query_id", F.array_join("kept", ",").alias("kept"), "tokens_used"))
query("full_context", f"WITH {MSG}, {ITEMS}, u AS (SELECT *, sum(cost) OVER (PARTITION BY query_id ORDER BY place) AS used FROM items) SELECT query_id, id, CAST(used AS BIGINT) AS used FROM u WHERE used <= {BUDGET}")(
    lambda s, d: packing.until_full(_turn_items(s, d), BUDGET).select("query_id", "id", "used"))
query("plain_rag", f"WITH {BM25}, i AS (SELECT query_id, id, rank, {_COST} AS cost FROM bm25 JOIN rec USING (id) WHERE rank <= 20), u AS (SELECT *, sum(cost) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM i) SELECT query_id, id, CAST(used AS BIGINT) AS used FROM u WHERE used <= {BUDGET}")(
    lambda s, d: packing.until_full(_lanes(s, d)["bm25"].where("rank <= 20").join(model.records(s, d).select("id", T.count_tokens(F.col("content")).alias("cost")), "id").withColumnRenamed("rank", "place"), BUDGET).select("query_id", "id", "used"))


def _session_items(s, d) -> DataFrame:
    """Every turn of a query's sessions that is a candidate or next to one."""
    r = model.messages(s, d).where(visible(Filter(now=NOW)))
    w = Window.partitionBy("prov_session").orderBy("t_event", "ingest_seq")
    r = r.withColumn("before", F.lag("id").over(w)).withColumn("after", F.lead("id").over(w))
    best = Window.partitionBy("scope_org").orderBy(F.desc(F.length("content")), "id")
    query_id = F.substring("scope_org", 2, 1).cast("long")
    c = r.withColumn("n", F.row_number().over(best)).withColumn("query_id", query_id)
    picked = c.where("n <= 20")
    near = picked.select("query_id", F.explode(F.array("before", "after")).alias("id")).where("id IS NOT NULL").distinct()
    near = near.join(picked.select("query_id", "id"), ["query_id", "id"], "left_anti")
    cols = ["query_id", "id", "kind", "content", "source", "quarantined", F.col("scope_session").alias("session"), "t_event", "ingest_seq", "before", "after"]
    return picked.select(*cols, F.col("n").alias("place")).unionByName(r.join(near, "id").select(*cols, F.lit(None).cast("int").alias("place")))


def _gated_items(s, d) -> DataFrame:
    """A query per user: all turns of the user, judged by a stub (how much of a text is new words)."""
    r = model.messages(s, d).where(visible(Filter(now=NOW)) & F.col("scope_user").isNotNull())
    w = Window.partitionBy("prov_session").orderBy("t_event", "ingest_seq")
    cost = (T.count_tokens(F.col("content")) + 1).alias("cost")
    r = r.withColumn("me", F.struct("id", cost))
    r = r.withColumn("near", F.filter(F.array(F.lag("me").over(w), F.lead("me").over(w)), lambda x: x.isNotNull()))
    ws = T.tokens(F.col("content"))
    r = r.withColumn("p", F.round(F.size(F.array_distinct(ws)) / F.greatest(F.size(ws), F.lit(1)), 6)).withColumn("query_id", F.substring("scope_user", 2, 9).cast("long"))
    best = Window.partitionBy("query_id").orderBy(F.desc("p"), "id")
    # A query packs what fusion passes on, 40 candidates: the limit is the feature.
    return r.withColumn("place", F.row_number().over(best)).where("place <= 40").select("query_id", "place", "id", "p", "me.cost", F.col("prov_session").alias("session"), "near")


query("pack_gated")(lambda s, d: packing.gated(_gated_items(s, d), 600, 0.9))
query("pack_sessions")(lambda s, d: packing.sessions(_session_items(s, d), 2000))
simple("render_item", lambda r: r.select("id", T.render_item(fenced()).alias("text")),
       f"""WITH {REC}, e AS (SELECT *, replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS body,
       '<memory source="' || ['import', 'web', 'tool', 'agent', 'user'][source] || '" kind="' || kind || '" date="' || strftime(make_timestamp(t_event * 1000), '%Y-%m-%d') || '" id="' || id || '" actor="' || actor_id || '"' || CASE WHEN deleted OR superseded_by IS NOT NULL THEN ' status="superseded"' ELSE '' END AS head FROM rec)
       SELECT id, CASE WHEN source <= 3 OR quarantined THEN '{T.FENCE_OPEN}' || chr(10) || head || '>' || chr(10) || body || chr(10) || '</memory>' || chr(10) || '{T.FENCE_CLOSE}' ELSE head || '>' || chr(10) || body || chr(10) || '</memory>' END AS text FROM e""")
simple("count_tokens", lambda r: r.select("id", T.count_tokens(F.col("content")).alias("n")), f"WITH {REC} SELECT id, CAST({_COST} AS BIGINT) AS n FROM rec")
simple("one_line", lambda r: r.select("id", T.one_line(F.col("content")).alias("line")), f"WITH {REC} SELECT id, replace(replace(replace(content, chr(13) || chr(10), '\\n'), chr(10), '\\n'), chr(13), '\\n') AS line FROM rec")
simple("session_date", lambda r: r.select("id", T.session_date(F.col("t_event")).alias("date")), f"WITH {REC} SELECT id, strftime(make_timestamp(t_event * 1000), '%Y/%m/%d (%a) %H:%M') AS date FROM rec")
FOCUS = "a tion of the eringing heit in que"
_at = "coalesce(" + ", ".join(f"nullif(strpos(low, '{w}'), 0)" for w in ("eringing", "tion", "heit")) + ", 1) - 1"
query("excerpt", f"""WITH {MSG}, a AS (SELECT id, content, translate(content, '{U}', '{L}') AS low, CAST(length(content) AS INTEGER) AS n FROM msg), b AS (SELECT *, CAST(greatest(0, least({_at} - 100, n - 200)) AS INTEGER) AS st FROM a)
  SELECT id, CASE WHEN n <= 200 THEN content ELSE CASE WHEN st > 0 THEN '...' ELSE '' END || substring(content, st + 1, 200) || CASE WHEN st + 200 < n THEN '...' ELSE '' END END AS text FROM b""")(
    lambda s, d: model.messages(s, d).select("id", packing.excerpted(F.col("content"), 200, F.lit(FOCUS)).alias("text")))
_PHRASE = ("yesterday", "today", "tomorrow", "3 days ago", "2 weeks ago", "5 days from now")
_off = {"yesterday": -1, "today": 0, "tomorrow": 1, "3 days ago": -3, "2 weeks ago": -14, "5 days from now": 5}
_phrases = "[" + ", ".join(f"'{p}'" for p in _PHRASE) + "]"
_offs = "[" + ", ".join(str(_off[p]) for p in _PHRASE) + "]"
query("date_resolve", f"WITH {FACT}, p AS (SELECT id, ingest_seq, {_phrases}[ingest_seq % 6 + 1] AS ph, {_offs}[ingest_seq % 6 + 1] AS off, t_event FROM fact) SELECT id, 'we met ' || ph || ' [= ' || strftime(make_timestamp(t_event * 1000) + to_days(CAST(off AS INTEGER)), '%a %Y-%m-%d') || ']' || ' at noon' AS text FROM p")(
    lambda s, d: model.facts(s, d).select("id", dates.annotated(F.concat(F.lit("we met "), F.element_at(F.array(*[F.lit(p) for p in _PHRASE]), (F.col("ingest_seq") % 6 + 1).cast("int")), F.lit(" at noon")), F.col("t_event")).alias("text")))
query("month_arithmetic", "SELECT event_id, CAST(CAST(ts AS DATE) + to_months(CAST(event_id % 25 - 12 AS INTEGER)) AS DATE) AS day FROM events")(
    lambda s, d: model.table(s, d, "events").select("event_id", F.add_months(F.to_date("ts"), (F.col("event_id") % 25 - 12).cast("int")).alias("day")))

# text and scalars ------------------------------------------------------------------------

_FSTOP = "[" + ", ".join(f"'{w}'" for w in T.FEATURE_STOPWORDS) + "]"
FEATS = f"""w AS (SELECT id, [x FOR x IN string_split_regex(translate(coalesce(content, ''), '{U}', '{L}'), '[^a-z0-9]+') IF x <> '' AND NOT list_contains({_FSTOP}, x)] AS ws FROM rec),
f AS (SELECT id, unnest(ws) AS f FROM w UNION ALL SELECT id, unnest([ws[i] || '_' || ws[i + 1] FOR i IN range(1, len(ws))]) FROM w),
b AS (SELECT id, CAST(CAST('0x' || md5(f)[1:16] AS UBIGINT) % 384 AS INTEGER) AS bucket, sum(CASE WHEN md5(f)[1] >= '8' THEN 1.0 ELSE -1.0 END::DOUBLE * (1 + ln(1 + length(f) / CAST(6 AS DOUBLE)))) AS value FROM f GROUP BY 1, 2),
nrm AS (SELECT id, sqrt(sum(value * value)) AS l FROM b GROUP BY 1)"""
simple("hash_embed", lambda r: lanes.hash_vectors(r).select("id", "bucket", (F.round("value", 6) + 0.0).alias("value")), f"WITH {REC}, {FEATS} SELECT b.id, bucket, round(value / CASE WHEN l = 0 THEN 1 ELSE l END, 6) + 0.0 AS value FROM b JOIN nrm USING (id)")
query("cosine", "SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])), 6) AS score FROM embeddings")(
    lambda s, d: model.table(s, d, "embeddings").crossJoin(F.broadcast(model.table(s, d, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("a")))).select(
        "vec_id", F.round(T.cosine(F.col("embedding").cast("array<double>"), F.col("a").cast("array<double>")), 6).alias("score")))
_w = lambda c: f"list_distinct([x FOR x IN string_split_regex(translate({c}, '{U}', '{L}'), '[^a-z0-9]+') IF x <> ''])"
query("near_duplicate", f"WITH {MSG}, t AS (SELECT id, {_w('content')} AS a, lag({_w('content')}) OVER (PARTITION BY prov_session ORDER BY t_event, id) AS b FROM msg) SELECT id, len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) >= 0.85 AS near FROM t WHERE b IS NOT NULL")(
    lambda s, d: model.messages(s, d).withColumn("b", F.lag("content").over(Window.partitionBy("prov_session").orderBy("t_event", "id"))).where("b IS NOT NULL").select("id", T.near_duplicate(F.col("content"), F.col("b")).alias("near")))
simple("normalize_entity_key", lambda r: r.select("id", T.normalize_entity_key(F.col("content")).alias("k"), T.slug(F.col("content")).alias("s")),
       f"WITH {REC}, a AS (SELECT id, translate(trim(content), '{U}', '{L}') AS c FROM rec) SELECT id, regexp_replace(regexp_replace(regexp_replace(c, '[^a-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g')[1:120] AS k, regexp_replace(regexp_replace(c, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')[1:40] AS s FROM a")
SAYINGS = ("My name is Ada Lovelace.", "we use redis for caching", "I work at Acme", "I prefer tea over coffee.", "always run tests first", "my editor is vim", "nothing to see", "I hate meetings; truly", "my email is a@b.example")


def _said(s, d) -> DataFrame:
    text = F.element_at(F.array(*[F.lit(x) for x in SAYINGS]), (F.col("event_id") % len(SAYINGS) + 1).cast("int"))
    e = model.table(s, d, "events")
    return model.shaped(e, id=F.format_string("e%09d", "event_id"), kind=F.lit("raw_event"), content=text, scope_user=F.concat(F.lit("u"), "user_id"), t_event=F.unix_millis(F.col("ts").cast("timestamp")), prov_session=F.concat(F.lit("s"), "user_id"), source=(F.col("event_id") % 5 + 1))


_facts_of = (("user.name", "' is called Ada Lovelace'"), ("tool.caching", "' uses redis for caching'"), ("user.employer", "' works at Acme'"), ("user.pref.tea_over_coffee", "' prefers tea over coffee'"), ("policy.run", None), ("user.editor", "'''s editor is vim'"), None, ("user.avoid.meetings", "' avoids meetings'"), ("user.email", "'''s email is a@b.example'"))
_said_sql = "CASE event_id % 9 " + " ".join(f"WHEN {i} THEN " + ("'policy: run tests first'" if f[1] is None else f"'u' || user_id || {f[1]}") for i, f in enumerate(_facts_of) if f) + " END"
_key_sql = "CASE event_id % 9 " + " ".join(f"WHEN {i} THEN '{f[0]}'" for i, f in enumerate(_facts_of) if f) + " END"
query("extract_patterns", f"SELECT printf('e%09d', event_id) AS id, {_key_sql} AS entity_key, {_said_sql} AS fact FROM events WHERE event_id % 9 <> 6")(
    lambda s, d: derive.extract(_said(s, d)).select("id", "entity_key", "fact"))
_said_by = lambda who: "CASE (conv_id + turn) % 9 " + " ".join(f"WHEN {i} THEN " + ("'policy: run tests first'" if f[1] is None else f"{who} || {f[1]}") for i, f in enumerate(_facts_of) if f) + " END"
_rule = dict(zip((f[0] for f in _facts_of if f), (0, 11, 2, 12, 14, 8, 13, 15)))
_rule_sql = "CASE " + _key_sql.replace("event_id", "(conv_id + turn)") + " " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in _rule.items()) + " END"


def _turns_said(s, d) -> DataFrame:
    """Turns of which every other says something to extract."""
    say = F.element_at(F.array(*[F.lit(x) for x in SAYINGS]), ((F.col("c") + F.col("t")) % len(SAYINGS) + 1).cast("int"))
    m = model.messages(s, d).withColumn("c", F.floor(F.col("ingest_seq") / 1000)).withColumn("t", F.col("ingest_seq") % 1000)
    return m.withColumn("content", F.when(F.col("t") % 2 == 0, say).otherwise(F.col("content"))).drop("c", "t")


query("extract_turns", f"WITH m AS (SELECT *, CASE WHEN conv_id % 7 <> 3 THEN 'u' || (conv_id % 10) ELSE 'o' || (conv_id % 3) END AS who FROM conversations) SELECT printf('c%06d-%04d', conv_id, turn) AS id, CAST({_rule_sql} AS INTEGER) AS pattern, {_key_sql.replace('event_id', '(conv_id + turn)')} AS entity_key, {_said_by('who')} AS fact FROM m WHERE turn % 2 = 0 AND (conv_id + turn) % 9 <> 6")(
    lambda s, d: derive.extract(_turns_said(s, d)))
query("subject_names", "SELECT DISTINCT 'u' || user_id AS scope_user, 'Ada Lovelace' AS name FROM events WHERE event_id % 9 = 0")(lambda s, d: derive.names(_said(s, d)))
query("distinct_facts", f"SELECT min_by(printf('e%09d', event_id), ((epoch_us(ts) // 1000), event_id)) AS id, {_said_sql} AS fact FROM events WHERE event_id % 9 <> 6 GROUP BY 'u' || user_id, 2")(
    lambda s, d: derive.distinct_facts(derive.extract(_said(s, d)).join(_said(s, d).select("id", "scope_user", "t_event"), "id"), ["t_event", "id"], ["scope_user"]).select("id", "fact"))
query("close_session", f"WITH t AS (SELECT 's' || user_id AS s, min(event_id % 5 + 1) AS source FROM events GROUP BY 1) SELECT printf('e%09d', event_id) AS id, {_key_sql} AS entity_key, CAST(t.source AS INTEGER) AS source FROM events JOIN t ON s = 's' || user_id WHERE event_id % 9 <> 6")(
    lambda s, d: derive.capped_source(derive.extract(_said(s, d)).join(_said(s, d).select("id", "prov_session"), "id").withColumn("source", F.lit(0)), _said(s, d)).select("id", "entity_key", "source"))
query("consolidate")(lambda s, d: derive.consolidate(derive.extract(_said(s, d), keep=("scope_user", "t_event"))))
query("supersede_by_key", f"WITH {FACT} SELECT id, superseded_by, invalidated_at FROM fact")(
    lambda s, d: derive.supersede(model.facts(s, d).withColumn("k", F.get("entity_keys", F.lit(0))), ["k"]).select("id", "superseded_by", "invalidated_at"))
query("entity_cluster", f"WITH {FACT} SELECT entity_keys[1] AS key, count(*) AS n, max(id) AS last FROM fact WHERE {LIVE} GROUP BY 1")(
    lambda s, d: model.facts(s, d).where(valid_now(None)).groupBy(F.get("entity_keys", F.lit(0)).alias("key")).agg(F.count("*").alias("n"), F.max("id").alias("last")))
simple("ulid", lambda r: r.select("id", T.ulid_time(T.ulid(F.col("t_event"), F.substring(F.md5("id"), 1, 20))).alias("ms"), F.length(T.ulid(F.col("t_event"), F.substring(F.md5("id"), 1, 20))).alias("n")), f"WITH {REC} SELECT id, t_event AS ms, 26 AS n FROM rec")
simple("content_sha", lambda r: r.select("id", F.sha2("content", 256).alias("h")), f"WITH {REC} SELECT id, sha256(content) AS h FROM rec")
query("embed_order", f"WITH {REC}, {VEC} SELECT rec.id, row_number() OVER (ORDER BY least(length(content), 2000), rec.id) AS rank FROM rec LEFT JOIN vec USING (id) WHERE kind = 'fact' AND invalidated_at IS NULL AND (model IS NULL OR model <> 'new')")(
    lambda s, d: prefix.place(scans.stale_vectors(model.facts(s, d), model.vectors(s, d), "new").select("id", F.length(F.substring("content", 1, 2000)).alias("n")), ["n", "id"]).select("id", "rank"))
query("rendezvous", "SELECT user_id, max_by(node, md5(node || ':' || user_id)) AS node FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(['n1', 'n2', 'n3', 'n4']) AS node) GROUP BY 1")(
    lambda s, d: model.table(s, d, "events").select("user_id").distinct().select("user_id", F.array_max(F.transform(F.array(*[F.lit(f"n{i}") for i in range(1, 5)]), lambda n: F.struct(F.md5(F.concat(n, F.lit(":"), F.col("user_id").cast("string"))), n.alias("node"))))["node"].alias("node")))
query("json_fields", "SELECT event_id, json_extract_string(props, '$.k') AS k, length(props) > 0 AS any FROM events")(
    lambda s, d: model.table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), (F.length("props") > 0).alias("any")))
query("array_ops", f"WITH {FACT} SELECT scope_user, array_to_string(list_sort(list_distinct(list(entity_keys[1]))), ',') AS keys, bool_or(list_has_any(entity_keys, ['click.u7', 'view.u3'])) AS hit FROM fact GROUP BY 1")(
    lambda s, d: model.facts(s, d).groupBy("scope_user").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("entity_keys")))), ",").alias("keys"), F.bool_or(F.arrays_overlap("entity_keys", F.array(F.lit("click.u7"), F.lit("view.u3")))).alias("hit")))

# aggregates ------------------------------------------------------------------------------

query("stats", f"WITH {REC}, {VEC} SELECT count(*) FILTER (NOT deleted) AS live, count(*) FILTER (deleted) AS tombstones, count(*) FILTER (kind = 'fact' AND NOT deleted) AS facts, count(*) FILTER (invalidated_at IS NOT NULL AND NOT deleted) AS superseded, count(*) FILTER (quarantined) AS quarantined, count(*) FILTER (kind = 'link') AS links, (SELECT count(*) FROM vec) AS vectors, (SELECT max(len(vec)) FROM vec) AS dim, (SELECT max(model) FROM vec) AS model FROM rec")(
    lambda s, d: scans.stats(model.records(s, d), model.vectors(s, d)))
BOUNDS = (10.0, 25.0, 50.0, 100.0, 250.0)
_bound = "CASE " + " ".join(f"WHEN value <= {b} THEN {b}" for b in BOUNDS) + " END"


def _histogram(s, d):
    b = F.lit(None).cast("double")
    for x in reversed(BOUNDS):
        b = F.when(F.col("value") <= x, x).otherwise(b)
    return policy.quantile(model.table(s, d, "events").groupBy(F.col("event_type").alias("series"), b.alias("bound")).agg(F.count("*").alias("n")), 0.95)


query("histogram_quantile", f"""WITH h AS (SELECT event_type AS series, CAST({_bound} AS DOUBLE) AS bound, count(*) AS n FROM events GROUP BY 1, 2),
  c AS (SELECT *, sum(n) OVER w AS upto, coalesce(lag(bound) OVER w, 0.0) AS low, sum(n) OVER (PARTITION BY series) AS total FROM h WINDOW w AS (PARTITION BY series ORDER BY bound NULLS LAST)),
  f AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY bound NULLS LAST) AS k FROM c WHERE upto >= CAST(0.95 AS DOUBLE) * total)
  SELECT series, round(coalesce(low + (bound - low) * (CAST(0.95 AS DOUBLE) * total - (upto - n)) / n, low), 6) AS value FROM f WHERE k = 1""")(_histogram)
query("median_p95", "SELECT event_type, round(median(value), 6) AS p50, round(list_sort(list(value))[CAST(floor(CAST(0.95 AS DOUBLE) * (count(*) - 1)) AS INTEGER) + 1], 6) AS p95 FROM events GROUP BY 1")(
    lambda s, d: policy.nearest(model.table(s, d, "events"), "event_type", "value").select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95")))
query("groupings", f"WITH {FACT} SELECT scope_user, entity_keys[1] AS key, count(*) AS n, count(*) > 1 AS collides FROM fact GROUP BY 1, 2")(
    lambda s, d: model.facts(s, d).groupBy("scope_user", F.get("entity_keys", F.lit(0)).alias("key")).agg(F.count("*").alias("n"), (F.count("*") > 1).alias("collides")))
query("ordered_distinct", "SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2")(
    lambda s, d: scans.ranked(model.table(s, d, "events").select("user_id", "event_type", "event_id").withColumn("k", F.struct("user_id", "event_type")), "event_id", by="k").where("rank = 1").select("user_id", "event_type", F.col("event_id").alias("first")))


def _usage(s, d):
    return model.table(s, d, "events").select(F.concat(F.lit("o"), F.col("user_id") % 7).alias("org"), F.col("event_type").alias("meter"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), "event_id", (F.col("event_id") % 9 + 1).alias("quantity"), F.round("value", 2).alias("value"), "user_id")


_USAGE = "u AS (SELECT 'o' || (user_id % 7) AS org, event_type AS meter, (epoch_us(ts) // 1000) AS at_ms, ts, event_id, event_id % 9 + 1 AS quantity, round(value, 2) AS value, user_id FROM events)"
query("usage_rollup", f"WITH {_USAGE}, c AS (SELECT *, strftime(ts, '%Y-%m') AS period, sum(quantity) OVER (PARTITION BY org, meter, strftime(ts, '%Y-%m') ORDER BY at_ms, event_id ROWS UNBOUNDED PRECEDING) AS total FROM u) SELECT org, meter, period, CAST(sum(quantity) AS BIGINT) AS quantity, CAST(sum(greatest(0, total - 500) - greatest(0, total - quantity - 500)) AS BIGINT) AS billable FROM c GROUP BY 1, 2, 3")(
    lambda s, d: policy.rollup(_usage(s, d), 500))
query("usage_sum", f"WITH {_USAGE}, o AS (SELECT DISTINCT 'o' || (user_id % 9) AS org FROM events) SELECT org, CAST(coalesce(sum(quantity), 0) AS BIGINT) AS quantity FROM o LEFT JOIN u USING (org) GROUP BY 1")(
    lambda s, d: model.table(s, d, "events").select(F.concat(F.lit("o"), F.col("user_id") % 9).alias("org")).distinct().join(_usage(s, d), "org", "left").groupBy("org").agg(F.coalesce(F.sum("quantity"), F.lit(0)).alias("quantity")))
query("gauge_snapshot", f"WITH {_USAGE} SELECT org, strftime(ts, '%Y-%m-%d') AS day, max_by(value, (at_ms, event_id)) AS value FROM u GROUP BY 1, 2")(lambda s, d: policy.gauge(_usage(s, d)))
query("quota_admit", f"""WITH RECURSIVE {_USAGE}, w AS (SELECT org || '-' || meter AS org, event_id AS request_id, quantity AS want, row_number() OVER (PARTITION BY org, meter ORDER BY at_ms, event_id) AS k FROM u),
  a AS (SELECT org, request_id, k, least(want, 500) AS granted, least(want, 500) AS used FROM w WHERE k = 1
    UNION ALL SELECT w.org, w.request_id, w.k, least(w.want, 500 - used), used + least(w.want, 500 - used) FROM a JOIN w ON w.org = a.org AND w.k = a.k + 1)
  SELECT org, request_id, CAST(granted AS BIGINT) AS granted FROM a""")(
    lambda s, d: policy.admit(_usage(s, d).select(F.concat_ws("-", "org", "meter").alias("org"), "at", F.col("event_id").alias("request_id"), F.col("quantity").alias("want")), 500))
query("token_bucket")(lambda s, d: policy.bucket(_usage(s, d).select(F.col("user_id").cast("string").alias("who"), F.floor(F.col("at") / 20_000).alias("at")), "who", "at", 3))
query("set_algebra", "SELECT user_id, 'both' AS part FROM (SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'error') UNION ALL SELECT user_id, 'only' FROM (SELECT user_id FROM events WHERE event_type = 'click' EXCEPT SELECT user_id FROM events WHERE event_type = 'error')")(
    lambda s, d: (lambda a, b: a.intersect(b).withColumn("part", F.lit("both")).unionByName(a.exceptAll(b).distinct().join(b, "user_id", "left_anti").withColumn("part", F.lit("only"))))(
        model.table(s, d, "events").where("event_type = 'click'").select("user_id").distinct(), model.table(s, d, "events").where("event_type = 'error'").select("user_id").distinct()))

# policies --------------------------------------------------------------------------------

HOUR = 3_600_000
query("rate_quarantine", f"WITH {FACT}, a AS (SELECT id, count(*) OVER (PARTITION BY actor_id ORDER BY t_ingested RANGE BETWEEN {12 * HOUR - 1} PRECEDING AND CURRENT ROW) AS recent FROM fact WHERE source < 4) SELECT id, recent, recent > 5 AS held FROM a")(
    lambda s, d: policy.rate(model.facts(s, d), 12 * HOUR, 5).select("id", "recent", "held"))
_KEY = f"array_to_string(list_sort([x FOR x IN [regexp_replace(y, '[0-9]+$', '') FOR y IN {_w('content')}] IF length(x) > 2])[1:12], '|')"
query("dup_quarantine", f"WITH {FACT}, a AS (SELECT id, {_KEY} AS copy_key, count(*) OVER (PARTITION BY {_KEY} ORDER BY t_ingested RANGE BETWEEN {HOUR - 1} PRECEDING AND CURRENT ROW) AS recent FROM fact WHERE source <= 2) SELECT id, copy_key, recent, recent > 5 AS held FROM a")(
    lambda s, d: policy.copies(model.facts(s, d), HOUR, 5).select("id", "copy_key", "recent", "held"))
query("quarantine_expiry", f"WITH {FACT} SELECT id, t_ingested + {policy.EXPIRY_MS} > {NOW} AS still FROM fact WHERE source <= 2")(
    lambda s, d: model.facts(s, d).where("source <= 2").select("id", (F.col("t_ingested") + policy.EXPIRY_MS > NOW).alias("still")))
query("session_taint", f"WITH {MSG} SELECT id, min(source) OVER (PARTITION BY prov_session ORDER BY t_event, id ROWS UNBOUNDED PRECEDING) AS taint FROM msg")(lambda s, d: policy.taint(model.messages(s, d)).select("id", "taint"))
query("failure_limiter", f"WITH e AS (SELECT event_id, user_id, (epoch_us(ts) // 1000) AS at_ms FROM events WHERE event_type = 'error'), a AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY at_ms RANGE BETWEEN {24 * HOUR - 1} PRECEDING AND CURRENT ROW) AS recent FROM e) SELECT event_id, recent, recent > 2 AS blocked FROM a")(
    lambda s, d: policy.failures(_usage(s, d).where("meter = 'error'"), "user_id", "at", 24 * HOUR, 2).select("event_id", "recent", "blocked"))
_STARTS = (11, 12, 500, 777)
query("history", f"""WITH RECURSIVE {FACT}, s AS (SELECT unnest([{", ".join(f"'e{i:09d}'" for i in _STARTS)}]) AS start), h AS (SELECT start, start AS id FROM s WHERE start IN (SELECT id FROM fact)
  UNION SELECT h.start, CASE WHEN f.id = h.id THEN f.superseded_by ELSE f.id END FROM h JOIN fact f ON (f.id = h.id AND f.superseded_by IS NOT NULL) OR f.superseded_by = h.id) SELECT start, id, t_ingested FROM h JOIN fact USING (id)""")(
    lambda s, d: fold.history(model.facts(s, d), s.createDataFrame([(f"e{i:09d}",) for i in _STARTS], "start string")).select("start", "id", "t_ingested"))

GAP = 777
#: Events of the log in one of its files, about; a stream takes a quarter of the files at once.
FILE_EVENTS = 250_000


@query("replica_tail", f"SELECT printf('e%09d', event_id) AS id FROM events WHERE event_id < {GAP} AND event_id % 17 <> 0")
def replica_tail(s, d):
    """A log in several files, followed by a stream; one seq has not arrived, so readers stop before it."""
    store = Store(s)
    facts = store.save(model.facts(s, d)).withColumn("n", F.col("ingest_seq") - 1_000_000_000)
    files = max(4, -(-2 * facts.count() // FILE_EVENTS))
    log = fold.writes(facts, F.col("n") * 2).unionByName(fold.ops(facts, "tombstone", F.col("n") * 2 + 1, at=F.col("t_event")).where("seq % 34 = 1").unionByName(fold.ops(facts, "noop", F.col("n") * 2 + 1).where("seq % 34 <> 1")))
    log.where(F.col("seq") != 2 * GAP).repartition(files, "seq").write.parquet(f"{store.path}/log")
    replay.tail(replay.read_stream(s, f"{store.path}/log", log.schema, -(-files // 4)), f"{store.path}/copy", f"{store.path}/mark").awaitTermination()
    return fold.fold(replay.readable(s.read.parquet(f"{store.path}/copy").drop("batch")), NOW).select("id")


# evaluation ------------------------------------------------------------------------------

_SESSIONS = "hs AS (SELECT query_id, coalesce(prov_session, scope_user) AS session, min(rank) AS first FROM bm25 JOIN rec USING (id) GROUP BY 1, 2), rs AS (SELECT query_id, session, row_number() OVER (PARTITION BY query_id ORDER BY first, session) AS rank FROM hs)"
_hits = lambda s, d: _lanes(s, d)["bm25"].join(model.records(s, d).select("id", F.coalesce("prov_session", "scope_user").alias("session")), "id")
query("session_ranking", f"WITH {BM25}, {_SESSIONS} SELECT * FROM rs")(lambda s, d: evaluate.sessions(_hits(s, d)))
_GOLD = ((1, "s13"), (1, "u3"), (2, "u3"), (2, "s3"), (3, "s23"), (4, "u3"), (5, "s33"))
query("ndcg", f"""WITH {BM25}, {_SESSIONS}, g AS (SELECT * FROM (VALUES {", ".join(f"({a}, '{b}')" for a, b in _GOLD)}) v(query_id, session)),
  h AS (SELECT query_id, sum(coalesce(1 / log2(rank + 1), 0.0)) AS dcg, count(rank) AS found, count(*) AS n FROM g LEFT JOIN (SELECT * FROM rs WHERE rank <= 5) USING (query_id, session) GROUP BY 1)
  SELECT query_id, round(dcg / list_sum([1 / log2(i + 1) FOR i IN range(1, least(n, 5) + 1)]), 6) AS ndcg, CAST(found > 0 AS DOUBLE) AS recall_any, CAST(found = n AS DOUBLE) AS recall_all FROM h""")(
    lambda s, d: evaluate.quality(evaluate.sessions(_hits(s, d)), s.createDataFrame(list(_GOLD), "query_id int, session string"), 5))
query("answer_heuristic")(lambda s, d: evaluate.answers(searches(s).select("query_id", F.col("text").alias("query")), _contexts(s, d)))


def _contexts(s, d) -> DataFrame:
    """The texts of a query's five best hits."""
    hits = _lanes(s, d)["bm25"].where("rank <= 5").join(model.records(s, d).select("id", "content"), "id")
    return hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]), "\n").alias("context"))


def _results(s, d) -> DataFrame:
    e, i = model.table(s, d, "events"), F.col("event_id")
    system = F.element_at(F.array(F.lit("ours"), F.lit("whole"), F.lit("plain")), (i % 3 + 1).cast("int"))
    return e.select(F.col("event_type").alias("suite"), system.alias("system"), F.when(i % 2 == 0, "knowledge_update").otherwise("other").alias("qclass"), (i % 11 != 0).alias("correct"), F.when(i % 3 == 1, i % 900 + 900).otherwise(i % 90).alias("tokens"))


_RESULTS = "res AS (SELECT event_type AS suite, ['ours', 'whole', 'plain'][event_id % 3 + 1] AS system, CASE WHEN event_id % 2 = 0 THEN 'knowledge_update' ELSE 'other' END AS qclass, event_id % 11 <> 0 AS correct, CASE WHEN event_id % 3 = 1 THEN event_id % 900 + 900 ELSE event_id % 90 END AS tokens FROM events)"
query("case_accuracy", f"WITH {_RESULTS} SELECT suite, system, count(*) AS cases, round(avg(CAST(correct AS INTEGER)), 4) AS accuracy, round(avg(tokens), 1) AS tokens FROM res GROUP BY 1, 2")(lambda s, d: evaluate.summary(_results(s, d)))
query("accuracy_gate", f"""WITH {_RESULTS}, a AS (SELECT system, round(avg(CAST(correct AS INTEGER)), 4) AS acc, round(avg(tokens), 1) AS tok FROM res WHERE suite = 'click' GROUP BY 1), x AS (SELECT * FROM a WHERE system = 'ours'), y AS (SELECT * FROM a WHERE system = 'whole'), z AS (SELECT * FROM a WHERE system = 'plain')
  SELECT 'accuracy' AS rule, x.acc >= y.acc - 0.02 AS ok FROM x, y UNION ALL SELECT 'tokens', x.tok <= 0.1 * greatest(y.tok, 1) FROM x, y UNION ALL SELECT 'retrieval', x.acc >= z.acc FROM x, z
  UNION ALL SELECT 'updates', (SELECT avg(CAST(correct AS INTEGER)) FROM res WHERE suite = 'click' AND system = 'ours' AND qclass = 'knowledge_update') >= 0.95""")(
    lambda s, d: evaluate.gate(_results(s, d), "click", "ours", "whole", "plain"))
