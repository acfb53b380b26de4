"""Facts from turns: pattern extraction, names, consolidation."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions import text as T

# What a turn may say, the key of the fact, and how the fact is worded.
PATTERNS = (
    (r"(?i)\bmy name is\s+([A-Z][\w'-]*(?:\s[A-Z][\w'-]*)?)", "user.name"),
    (r"(?i)\b(?:call me|i(?:'m| am) called)\s+([A-Z][\w'-]*)", "user.name"),
    (r"(?i)\bi\s+(?:\w+\s+){0,3}?work(?:ed|ing)?\s+(?:at|for)\s+([A-Za-z0-9&.-]+)", "user.employer"),
    (r"(?i)\bmy employer is\s+([A-Za-z0-9&.-]+)", "user.employer"),
    (r"(?i)\bi\s+(?:live|moved|relocated)\s+(?:to|in)\s+([A-Za-z .'-]+?)(?:[.,;!]|$)", "user.city"),
    (r"(?i)\bwe\s+(?:deploy|ship|release)\s+(?:with|using|via)\s+(.+?)(?:[.,;!]|$)", "team.deploy_cmd"),
    (r"(?i)\bthe\s+(?:deploy|deployment)\s+command\s+is\s+(.+?)(?:[.,;!]|$)", "team.deploy_cmd"),
    (r"(?i)\bthe\s+(?:build|test|run)\s+command\s+is\s+(.+?)(?:[.,;!]|$)", "repo.build_cmd"),
    (r"(?i)\bmy editor is\s+([\w.-]+)", "user.editor"),
    (r"(?i)\b(?:i|we)\s+(?:switched|moved)\s+(?:my |our )?editor\s+to\s+([\w.-]+)", "user.editor"),
    (r"(?i)\bi\s+use\s+([\w.-]+)\s+as\s+my\s+editor", "user.editor"),
    (r"(?i)\bwe\s+use\s+(.+?)\s+(?:for|to)\s+(\w+)", "tool."),
    (r"(?i)\b(?:i|we)\s+(?:prefer|like)\s+(.+?)(?:[.,;!]|$)", "user.pref."),
    (r"(?i)\b(?:i|we)\s+(?:hate|dislike|avoid|don't like|do not like)\s+(.+?)(?:[.,;!]|$)", "user.avoid."),
    (r"(?i)\b(?:always|never)\s+([a-z].*?)(?:[.,;!]|$)", "policy."),
    (r"(?i)\bmy\s+(?:email|e-mail)\s+is\s+(\S+@\S+)", "user.email"),
    (r"(?i)\bmy\s+(?:timezone|tz)\s+is\s+([\w/+_-]+)", "user.timezone"),
    (r"(?i)\bi\s+use\s+(?:a\s+)?([\w-]+)\s+(?:laptop|machine|computer)", "user.machine"),
)
WORDING = {
    "user.name": "{s} is called {x}", "user.employer": "{s} works at {x}", "user.city": "{s} lives in {x}",
    "team.deploy_cmd": "the team deploys with {x}", "repo.build_cmd": "the build command is {x}", "user.editor": "{s}'s editor is {x}",
    "user.email": "{s}'s email is {x}", "user.timezone": "{s}'s timezone is {x}", "user.machine": "{s} uses a {x} machine",
    "tool.": "{s} uses {x} for {y}", "user.pref.": "{s} prefers {x}", "user.avoid.": "{s} avoids {x}", "policy.": "policy: {x}",
}


def _worded(key: str, s: Column, x: Column, y: Column) -> Column:
    parts, rest = [], WORDING[key]
    while rest:
        at = rest.find("{")
        if at < 0:
            parts.append(F.lit(rest))
            break
        parts += [F.lit(rest[:at])] * bool(at) + [{"s": s, "x": x, "y": y}[rest[at + 1]]]
        rest = rest[at + 3 :]
    return F.concat(*parts)


def extract(turns: DataFrame, subject: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, ..., pattern, entity_key, fact) of every pattern that a turn matches, once each, natively.
    ``keep`` names columns of the turns that go with their facts."""
    text = F.trim("content")
    who = subject if subject is not None else F.coalesce("scope_user", "scope_agent", "scope_org", F.lit("the user"))
    hits, keys, said = [], [], []
    # Patterns first, each once; what a hit says is worded after the explosion, where there are few.
    for n, (rx, key) in enumerate(PATTERNS):
        y = F.trim(F.regexp_extract(text, rx, 2)) if key == "tool." else F.lit("")
        hits.append(F.struct(F.lit(n).alias("pattern"), F.trim(F.regexp_extract(text, rx, 1)).alias("x"), y.alias("y")))
        x, y = F.col("f.x"), F.col("f.y")
        tail = {"tool.": T.slug(y), "user.pref.": T.slug(x, 24), "user.avoid.": T.slug(x, 24), "policy.": T.slug(F.split(x, r"\s+")[0], 16)}.get(key, F.lit(""))
        keys.append(T.normalize_entity_key(F.concat(F.lit(key), tail)))
        said.append(_worded(key, F.col("_who"), F.regexp_replace(x, "[.,;!]+$", ""), y))
    rows = turns.where(F.col("kind").isin("raw_event", "procedure")).select("id", *keep, who.alias("_who"), F.explode(F.filter(F.array(*hits), lambda v: v["x"] != "")).alias("f"))
    pick = lambda cs: F.coalesce(*[F.when(F.col("f.pattern") == n, c) for n, c in enumerate(cs)])
    return rows.select("id", *keep, "f.pattern", pick(keys).alias("entity_key"), pick(said).alias("fact"))


def distinct_facts(facts: DataFrame, order: list, by: list[str]) -> DataFrame:
    """The first of the facts that read alike within ``by``."""
    w = Window.partitionBy(*by, F.lower("fact")).orderBy(*order)
    return facts.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def supersede(facts: DataFrame, by: list[str]) -> DataFrame:
    """One value per key: each fact is superseded by the next one of its key."""
    w = Window.partitionBy(*by).orderBy("t_event", "id")
    return facts.withColumn("superseded_by", F.lead("id").over(w)).withColumn("invalidated_at", F.lead("t_event").over(w))


class Versions:
    """The word sets of a key's facts, asked for the first that is near a new one.

    Sets this near share a word among the first few of each, in a fixed order: only sets noted
    under such a word are compared.
    """

    def __init__(self, threshold: float):
        self.threshold, self.sets, self.same, self.by_word = threshold, [], {}, {}

    def _lead(self, words: frozenset) -> list[str]:
        most = len(words) - math.ceil(self.threshold * len(words) - 1e-9) + 1
        return sorted(words, key=lambda w: (-len(w), w))[: max(most, 1)]

    def first(self, words: frozenset) -> str | None:
        """The name of the first set added that is near ``words``; an empty set is near nothing."""
        if not words:
            return None
        at, tried = self.same.get(words), set()
        for w in self._lead(words):
            for n in self.by_word.get(w, ()):
                if at is not None and n >= at:
                    break
                if n not in tried:
                    tried.add(n)
                    if len(words & self.sets[n][0]) >= self.threshold * len(words | self.sets[n][0]):
                        at = n
        return None if at is None else self.sets[at][1]

    def add(self, words: frozenset, name: str) -> None:
        if words and words not in self.same:
            n = self.same[words] = len(self.sets)
            self.sets.append((words, name))
            for w in self._lead(words):
                self.by_word.setdefault(w, []).append(n)


def consolidate(facts: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(scope_user, entity_key, id, kept, supersedes) in order of (t_event, id) within a key.

    A near duplicate of a fact already there is dropped; a different text supersedes the latest.
    A group is the versions of one key of one user.
    """
    schema = "scope_user string, entity_key string, id string, kept boolean, supersedes string"

    def f(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, seen, latest = (), Versions(threshold), None
        for b in rows:
            kept, before = [], []
            for user, key, i, words in zip(*(b.column(n).to_pylist() for n in ("scope_user", "entity_key", "id", "words"))):
                if (user, key) != group:
                    group, seen, latest = (user, key), Versions(threshold), None
                words = frozenset(words)
                copy = seen.first(words) is not None
                kept.append(not copy)
                before.append(None if copy else latest)
                if not copy:
                    seen.add(words, i)
                    latest = i
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(kept, pa.bool_()), pa.array(before, pa.string())], names=["scope_user", "entity_key", "id", "kept", "supersedes"])

    rows = facts.select(*[F.col(c).cast("string").alias(c) for c in ("scope_user", "entity_key", "id")], "t_event", F.array_distinct(T.words(F.col("fact"))).alias("words"))
    dealt = rows.repartition("scope_user", "entity_key").sortWithinPartitions("scope_user", "entity_key", F.asc_nulls_last("t_event"), "id", "words")
    return dealt.drop("t_event").mapInArrow(f, schema)


def revise(found: DataFrame, known: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(scope_user, entity_key, id, ..., copy_of, supersedes, demotes) for new facts, set by set.

    ``found`` are facts with their columns, ``known`` the live facts of the same users (scope_user,
    entity_key, id, t_event, lineage, fact). In order of time, a near duplicate of a fact of its
    key is dropped, and any other supersedes the latest. A group is the facts of one key and user.
    """
    shared = ("scope_user", "entity_key", "id", "t_event", "lineage", "fact")
    both = known.select(*shared, F.lit(True).alias("old")).unionByName(found.select(*shared, F.lit(False).alias("old")))
    both = both.withColumn("words", F.array_distinct(T.words(F.col("fact")))).drop("fact")

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["old", "t_event", "id"], ascending=[False, True, True]).to_dict("records")
        seen = Versions(threshold)
        latest, out = None, []
        for r in rows:
            words = frozenset(r["words"])
            copy = seen.first(words) if not r["old"] else None
            if not r["old"]:
                before = None if copy or latest is None else latest["id"]
                out.append((r["scope_user"], r["entity_key"], r["id"], copy, before, [*(latest["lineage"] if latest["lineage"] is not None else ()), latest["id"]] if before else []))
            if copy is None:
                seen.add(words, r["id"])
                latest = r if latest is None or (r["t_event"], r["id"]) >= (latest["t_event"], latest["id"]) or not r["old"] else latest
        return pd.DataFrame(out, columns=["scope_user", "entity_key", "id", "copy_of", "supersedes", "demotes"])

    ddl = "scope_user string, entity_key string, id string, copy_of string, supersedes string, demotes array<string>"
    wanted = both.join(found.select("scope_user", "entity_key").distinct(), ["scope_user", "entity_key"], "left_semi")
    return wanted.groupBy("scope_user", "entity_key").applyInPandas(f, ddl)


def capped_source(facts: DataFrame, turns: DataFrame) -> DataFrame:
    """A fact is as trusted as the least trusted turn of its session."""
    least = turns.groupBy("prov_session").agg(F.min("source").alias("source"))
    return facts.drop("source").join(least, "prov_session")


def names(turns: DataFrame) -> DataFrame:
    """(scope_user, name): how users say they are called, the first time."""
    rx = [p for p, k in PATTERNS if k == "user.name"]
    said = reduce(lambda a, b: F.coalesce(a, b), [F.nullif(F.trim(F.regexp_extract("content", r, 1)), F.lit("")) for r in rx])
    return turns.where("scope_user IS NOT NULL").select("scope_user", said.alias("name"), "t_event", "id").where("name IS NOT NULL").groupBy("scope_user").agg(F.min_by("name", F.struct("t_event", "id")).alias("name"))
