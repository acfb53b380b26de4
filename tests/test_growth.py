"""Steps that must not grow faster than their input: plans without one-task windows, plain twins."""

import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest import queries
from palimpsest.functions.stem import stemmed
from palimpsest.functions.visibility import Filter
from palimpsest.llm import bpe
from palimpsest.llm._base import Recent
from palimpsest.operators import derive, fold, fusion, graph, lanes, prefix
from palimpsest.queries import QUERIES
from palimpsest.sources.store import names
from palimpsest.streaming import replay

from tests.test_core import NOW, record, records

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sliding_count_is_a_running_sum(spark):
    """A frame with two moving ends counts each of its rows again for each row: quadratic in a window's rows."""
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), r.choice([None, *range(-90, 90)]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, at long, i long").repartition(5)
    got = prefix.sliding_count(df, "k", "at", 40)
    assert {x.i: x.recent for x in got.collect()} == {i: sum(k == k2 and (at2 == at if None in (at, at2) else at - 40 < at2 <= at) for k2, at2, _ in rows) for k, at, i in rows}
    assert got.columns == ["k", "at", "i", "recent"] and not re.search(r"RangeFrame, -", plan(got))


def test_horizon_is_found_in_blocks(spark):
    """A namespace is no single group, and a run goes on over the border of two blocks."""
    b = replay.BLOCK if hasattr(replay, "BLOCK") else 65_536
    seqs = {"through": [*range(b - 3, b + 4), b + 9], "border": [b - 2, b - 1, b + 1], "whole": [2 * b - 1, 2 * b], "twice": [5, 5, 6, 8], "below": [-2, -1, 0, 1, 3]}
    log = spark.createDataFrame([(ns, s) for ns, ss in seqs.items() for s in ss], "ns string, seq long")
    assert {x.ns: x.horizon for x in replay.horizon(log).collect()} == {"through": b + 3, "border": b - 1, "whole": 2 * b, "twice": 6, "below": 1}
    assert not re.search(r"windowspecdefinition\(ns#\d+, seq#\d+L? ASC", plan(replay.horizon(log)))


def test_tailed_log_has_more_files_when_it_is_larger(spark, monkeypatch):
    """Four files whatever the size made four tasks."""
    monkeypatch.setattr(queries, "FILE_EVENTS", 100, raising=False)
    seen, read = [], replay.read_stream
    monkeypatch.setattr(replay, "read_stream", lambda s, path, *rest: seen.append(sum(n.endswith(".parquet") for n in names(s, path))) or read(s, path, *rest))
    got = [x.id for x in QUERIES["replica_tail"](spark, SMALL).collect()]
    assert sorted(got) == [f"e{i:09d}" for i in range(777) if i % 17] and seen[0] > 10


@pytest.mark.parametrize("at_once", [1, 7, 1000])
def test_history_ties_chunks_together(spark, monkeypatch, at_once):
    monkeypatch.setattr(graph, "EDGES_AT_ONCE", at_once)
    r = random.Random(at_once)
    after = {f"n{i:03}": f"n{r.randint(0, 119):03}" if r.random() < 0.7 else None for i in range(120)}
    whole = {i: {i} for i in after}
    for a, b in after.items():
        if b:
            both = whole[a] | whole[b]
            for x in both:
                whole[x] = both
    rows = records(spark, *[record(id=i, superseded_by=n, t_event=NOW + r.randint(0, 9), entity_keys=[r.choice("kl")] * r.randint(0, 1)) for i, n in after.items()])
    starts = ["n000", "n007", "n050", "n119", "none"]
    got: dict[str, set] = {}
    for x in fold.history(rows, spark.createDataFrame([(i,) for i in starts], "start string")).collect():
        assert x.id not in got.setdefault(x.start, set())
        got[x.start].add(x.id)
    assert got == {s: whole[s] for s in starts if s in whole}


def test_history_contracts_before_it_joins(spark, monkeypatch):
    """The rounds of joins run over what ties chunks together, not over all edges."""
    asked, connected = [], fold.connected
    monkeypatch.setattr(fold, "connected", lambda store, edges: asked.append(edges.count()) or connected(store, edges))
    chains = {f"{c}{i:03}": f"{c}{i + 1:03}" for c in "ab" for i in range(300)} | {"a300": None, "b300": None}
    rows = records(spark, *[record(id=i, superseded_by=n, t_event=NOW + int(i[1:]), entity_keys=[i[0]]) for i, n in chains.items()])
    assert fold.history(rows, spark.createDataFrame([("a007",)], "start string")).count() == 301
    assert asked and max(asked) < 60


def test_consolidation_equals_one_by_one(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(12)]
    facts = [(r.choice(["u", None]), r.choice("kl"), f"f{i:03}", r.randint(0, 200), " ".join(r.sample(words, r.choice([0, 1, 6, 7, 8, 9, 10, 11])))) for i in range(300)]
    want = {}
    for user, key in {f[:2] for f in facts}:
        seen, latest = [], None
        for _, _, i, _, text in sorted((f for f in facts if f[:2] == (user, key)), key=lambda f: (f[3], f[2])):
            ws = set(text.split())
            copy = any(ws and s and len(ws & s) >= 0.85 * len(ws | s) for s in seen)
            want[i] = (not copy, None if copy else latest)
            if not copy:
                seen.append(ws)
                latest = i
    got = derive.consolidate(spark.createDataFrame(facts, "scope_user string, entity_key string, id string, t_event long, fact string").repartition(4))
    assert {x.id: (x.kept, x.supersedes) for x in got.collect()} == want and sum(not k for k, _ in want.values()) > 50
    assert "FlatMapGroupsInPandas" not in plan(got)  # a call and a table for each key


def test_versions_name_the_first_that_is_near():
    r = random.Random(2)
    made, seen = derive.Versions(0.85), []
    for n in range(400):
        ws = frozenset(r.sample("abcdefghijklm", r.randint(0, 13)))
        assert made.first(ws) == next((i for s, i in seen if ws and s and len(ws & s) >= 0.85 * len(ws | s)), None)
        if n % 3:
            made.add(ws, n)
            seen.append((ws, n))


def test_facts_take_columns_of_their_turns_along(spark):
    r = records(spark, record(id="1", content="we use redis for caching; always run", scope_user="u", t_event=NOW + 3))
    got = {(x.entity_key, x.scope_user, x.t_event, x.pattern) for x in derive.extract(r, keep=("scope_user", "t_event")).collect()}
    assert got == {("tool.caching", "u", NOW + 3, 11), ("policy.run", "u", NOW + 3, 14)}


def read_back(spark, tmp_path):
    said = ["user 17 did click number 4", "running 99 clicks", "42", "ran"]
    records(spark, *[record(id=f"r{i}", content=t, scope_user="u") for i, t in enumerate(said)]).write.parquet(f"file://{tmp_path}/records")
    return spark.read.parquet(f"file://{tmp_path}/records")


def reads(df) -> int:
    return len(re.findall(r"Relation \[id#\d+,ns#", plan(df)))


def test_numbers_are_not_mapped_to_stems(spark, tmp_path):
    """Each record may have a number of its own: only words whose stem may differ reach the stemmer."""

    def term_of(c):
        return F.when(c.rlike("[0-9]"), F.raise_error(F.lit("a number")).cast("string")).otherwise(F.regexp_replace(c, "(ning|s)$", ""))

    term_of.alters = stemmed.alters
    r = read_back(spark, tmp_path)
    for text, want in (("runs", ["r1"]), ("click run", ["r0", "r1"])):
        q = spark.createDataFrame([(1, text)], "query_id int, text string")
        assert sorted(x.id for x in lanes.bm25(r, q, Filter(now=NOW), 10, term_of=term_of).collect()) == want


def test_numbers_are_found_as_they_are(spark, tmp_path):
    q = spark.createDataFrame([(1, "42 user clicked")], "query_id int, text string")
    got = lanes.bm25(read_back(spark, tmp_path), q, Filter(now=NOW), 10, term_of=stemmed)
    assert {x.id for x in got.collect()} == {"r0", "r1", "r2"}


def test_a_search_reads_records_for_its_hits_once(spark, tmp_path):
    """Terms are counted and written first; only hits meet the records, whose size is not theirs."""
    q = spark.createDataFrame([(1, "click user")], "query_id int, text string")
    assert reads(lanes.bm25(read_back(spark, tmp_path), q, Filter(now=NOW), 10)) == 1


def test_fusion_writes_its_candidates(spark, tmp_path):
    """Of known size, they need not be dealt by id together with all records."""
    r = read_back(spark, tmp_path)
    q = spark.createDataFrame([(1, "click user")], "query_id int, text string")
    got = fusion.fuse({"bm25": lanes.bm25(r, q, Filter(now=NOW), 10), "entity": lanes.entity(r, q, Filter(now=NOW))}, q, r)
    assert [x.id for x in got.collect()] == ["r0"] and reads(got) == 1


def test_codec_holds_a_word_once():
    """Words of one piece were held as words and as pieces, in every worker."""
    codec = bpe.Codec(public_tokenizers.path(bpe.VOCAB))
    said = ["alpha beta, gamma", " alpha\tbeta  gamma", "", " ", "\x1calpha", "ünï köde", "a\x85b 12 it's"]
    want = Tokenizer.from_file(public_tokenizers.path(bpe.VOCAB))
    want.no_padding(), want.no_truncation()
    assert codec.encode_batch(said) == [want.encode(t, add_special_tokens=False).ids for t in said] == codec.encode_batch(said)
    held = [w for c in vars(codec).values() if isinstance(c, Recent) for d in (c.new, c.old) for w in d]
    assert len(held) == len(set(held)) > 5
