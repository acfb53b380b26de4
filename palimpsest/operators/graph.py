"""Connected components of edges (a, b), as joins and aggregates over written tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.sources.store import Store

#: Edges that are contracted in one go.
EDGES_AT_ONCE = 131_072


def stars(edges: DataFrame) -> DataFrame:
    """(a, b): edges of strings (a, b) contracted chunk by chunk: each node of a chunk, roots included,
    with the smallest node of its component there. Nodes are connected as they were.

    It is as good as the order of the edges: a component that lies within a chunk is one star.
    """
    out = pa.schema([("a", pa.string()), ("b", pa.string())])

    def star(sides: list[pa.Array]) -> pa.RecordBatch:
        up: dict[str, str] = {}

        def root(x: str) -> str:
            y = x
            while up[y] != y:
                y = up[y]
            while up[x] != y:
                up[x], x = y, up[x]
            return y

        for a, b in zip(*(s.to_pylist() for s in sides)):
            up.setdefault(a, a)
            up.setdefault(b, b)
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        return pa.RecordBatch.from_arrays([pa.array(list(up), pa.string()), pa.array([root(x) for x in up], pa.string())], schema=out)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= EDGES_AT_ONCE:
                whole = pa.Table.from_batches(held).combine_chunks()
                yield star([whole.column(0), whole.column(1)])
                held, n = [], 0
        if held:
            whole = pa.Table.from_batches(held).combine_chunks()
            yield star([whole.column(0), whole.column(1)])

    return edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").mapInArrow(f, "a string, b string")


def joints(stars: DataFrame) -> DataFrame:
    """The edges of ``stars`` that tie chunks together: those of nodes that several of them hold."""
    shared = stars.groupBy("a").agg(F.count("*").alias("n")).where("n > 1")
    return stars.join(shared.select("a"), "a", "left_semi")


def connected(store: Store, edges: DataFrame) -> DataFrame:
    """(a, b): for every node but the smallest of its component, that smallest node.

    Alternating large and small stars: the rounds grow with the log of a component's size. A
    round writes one table, and the end is reached when it leaves every edge as it was.
    """
    now = store.save(edges.select("a", "b").where("a <> b").distinct())
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(least.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = store.save(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        same = new.count() == now.count() and new.join(now, ["a", "b"], "left_anti").isEmpty()
        store.drop(now)
        now = new
        if same:
            return now
