"""Queries that must do the whole job where a search's limits or a shortcut would lose rows."""

import hashlib
import os
import random

import duckdb
import pytest

from palimpsest.operators import fold
from palimpsest.operators.graph import connected
from palimpsest.queries import QUERIES, WIDE
from palimpsest.sources.store import Store

from tests.test_core import NOW, log_of, plain_fold, record, records

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def test_sweep_sees_more_than_a_search(spark, con):
    """The registered SQL holds the limits of a search (40 and 20); a sweep takes 10,000 of every lane."""
    wide = f"WITH {WIDE} SELECT query_id, id FROM sweep"
    want: dict[int, list] = {}
    for q, i in con.execute(wide).fetchall():
        want.setdefault(q, []).append(i)
    assert max(map(len, want.values())) > 60  # more than the lanes of a search hold
    got: dict[int, list] = {}
    for r in QUERIES["find_ids"](spark, SF).collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert {q: sorted(i) for q, i in got.items()} == {q: sorted(i) for q, i in want.items()}
    marks = {r.query_id: (r.n, r.fingerprint) for r in QUERIES["forget_fingerprint"](spark, SF).collect()}
    assert marks == {q: (len(i), hashlib.sha256("\n".join(sorted(i)).encode()).hexdigest()[:32]) for q, i in want.items()}


@pytest.mark.parametrize("seed", range(3))
def test_checkpoint_and_rest_equal_the_whole(spark, seed):
    """At NOW - 2 no delete is due and no quarantine has expired; at NOW half of them have."""
    r = random.Random(seed)
    events = []
    for seq in range(1, 50):
        i = f"r{r.randint(0, 6)}"
        if seq < 8 or r.random() < 0.2:
            events.append({"seq": seq, "ordinal": 0, "id": i, "write": True, "op": None})
            continue
        kind = r.choice(["hard_delete", "tombstone", "supersede", "quarantine", "quarantine"])
        op = {"op": kind, "at": NOW + seq, "new": f"r{r.randint(0, 6)}", "deadline": NOW + r.choice([-1, 1, 1]), "flag": r.random() < 0.7, "expires": NOW + r.choice([-1, 1])}
        events.append({"seq": seq, "ordinal": 1, "id": i, "write": False, "op": op})
    log = log_of(spark, events).checkpoint()
    for cut in (12, 25, 40):
        first = fold.carry(log.where(f"seq <= {cut}"), NOW - 2)
        got = fold.fold(first.unionByName(log.where(f"seq > {cut}")), NOW).collect()
        assert {x.id: (x.invalidated_at, x.superseded_by, x.quarantined) for x in got} == plain_fold(events, NOW)


def test_replay_carries_what_is_pending(spark, monkeypatch):
    """Without the ops that the checkpoint carries, the query must lose its deletes and expiries."""
    whole = {tuple(r) for r in QUERIES["replay_cut"](spark, SF).collect()}
    assert whole == {tuple(r) for r in QUERIES["fold_events"](spark, SF).collect()}
    carry = fold.carry
    monkeypatch.setattr(fold, "carry", lambda log, now: carry(log, now).where("op IS NULL"))
    assert {tuple(r) for r in QUERIES["replay_cut"](spark, SF).collect()} != whole


def test_history_walks_the_whole_chain(spark):
    """70 versions on one side of the seed, two facts merged into one, a cycle, and a key that another chain shares."""
    chain = {f"v{i:02}": f"v{i + 1:02}" for i in range(70)} | {"v70": None, "twin": "v01", "c1": "c2", "c2": "c1", "w1": "w2", "w2": None, "alone": None, "self": "self"}
    r = records(spark, *[record(id=i, superseded_by=n, entity_keys=["k"]) for i, n in chain.items()])
    starts = ["v70", "v03", "c1", "w1", "alone", "self", "none"]
    got: dict[str, set] = {}
    for x in fold.history(r, spark.createDataFrame([(i,) for i in starts], "start string")).collect():
        got.setdefault(x.start, set()).add(x.id)
    whole = {f"v{i:02}" for i in range(71)} | {"twin"}
    assert got == {"v70": whole, "v03": whole, "c1": {"c1", "c2"}, "w1": {"w1", "w2"}, "alone": {"alone"}, "self": {"self"}}


def test_history_query_walks(spark, monkeypatch):
    asked = []
    walk = fold.history
    monkeypatch.setattr(fold, "history", lambda r, starts: asked.append(starts.count()) or walk(r, starts))
    assert QUERIES["history"](spark, SF).count() > 9 and asked == [4]


@pytest.mark.parametrize("seed", range(4))
def test_components_equal_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)] + [(100, i) for i in range(101, 160)] + [(i, i + 1) for i in range(200, 290)] + [(7, 7)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {x.a: x.b for x in connected(Store(spark), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up if root(x) != x}
