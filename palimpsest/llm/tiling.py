"""Benchmark decontamination by greedy string tiling (operator 10).

Texts become words: runs of letters and digits, lower case. The hashes of all runs of ``SEED``
words of the documents are joined with those of the items; a shorter item is a seed as a whole.
Pairs whose shared seeds could cover enough of the item are tiled: the longest match of unmarked
words is marked again and again, found by running Karp-Rabin hashes at falling lengths; tiles do
not overlap and may stand in any order, so reordered passages count. A document is contaminated
by an item when its tiles cover ``COVERAGE`` of the item's words.

Equal texts are tiled once, under the MD5 of the text, and equal items too. Nothing is collected
or broadcast by hand: Spark sends the items' seeds to all tasks where their table is small, and
shuffles both sides where it is not.

Null and empty texts and items without words match nothing. Repeated rows are reported each by
itself, repeated items once per row. Of equally long matches the first in the document goes
first, then the first in the item.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm._base import map_rows, table, text_of
from palimpsest.sources.store import Store

NAME = "op10_decontamination"
SEED = 5
COVERAGE = 0.6
WORDS = re.compile(r"[^\W_]+")
BASE = np.array([0x9E3779B97F4A7C15], dtype=np.uint64)
#: Places of one length where a search begins, and pairs of places looked at together.
LONGEST_STEP, PAIRS_AT_ONCE = 64, 1 << 20


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def running(x: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``n`` numbers, modulo 2**64, built by doubling."""
    if len(x) < n:
        return np.empty(0, np.uint64)
    x = x.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)
    done, size, out, power, step = None, 0, x, 1, BASE
    # out: hashes of runs of ``power``; done: hashes of runs of ``size``, a prefix of the answer.
    while True:
        if n & power:
            if done is None:
                done, size = out, power
            else:
                m = len(x) - size - power + 1
                done = done[:m] * step + out[size : size + m]
                size += power
        if size == n:
            return done
        m = len(out) - power
        out = out[:m] * step + out[power:]
        step, power = step * step, power * 2


def _runs(free: np.ndarray, n: int) -> np.ndarray:
    """Starts of the runs of ``n`` free places."""
    if len(free) < n:
        return np.empty(0, np.int64)
    total = np.concatenate(([0], np.cumsum(free)))
    return np.nonzero(total[n:] - total[:-n] == n)[0]


def _starts(doc, item, free_d, free_i, n):
    """(i, j) where a match of at least ``n`` free words may begin, by running hashes."""
    at_d, at_i = _runs(free_d, n), _runs(free_i, n)
    if not len(at_d) or not len(at_i):
        return
    hash_d, hash_i = running(doc, n)[at_d], running(item, n)[at_i]
    order = np.argsort(hash_i, kind="stable")
    hash_i, at_i = hash_i[order], at_i[order]
    low, high = np.searchsorted(hash_i, hash_d, "left"), np.searchsorted(hash_i, hash_d, "right")
    hit = high > low
    at_d, low, count = at_d[hit], low[hit], (high - low)[hit]
    total = np.cumsum(count)
    a = 0
    while a < len(count):
        z = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS_AT_ONCE, "right")))
        c = count[a:z]
        i = np.repeat(at_d[a:z], c)
        j = at_i[np.repeat(low[a:z], c) + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)]
        p, q = np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        goes_on = (i > 0) & (j > 0) & free_d[p] & free_i[q] & (doc[p] == item[q])
        yield from zip(i[~goes_on].tolist(), j[~goes_on].tolist())
        a = z


def _length(doc, item, free_d, free_i, i, j) -> int:
    """How far the free words from (i, j) on are equal."""
    most, e, step = min(len(doc) - i, len(item) - j), 0, 64
    while e < most:
        z = min(most, e + step)
        same = (doc[i + e : i + z] == item[j + e : j + z]) & free_d[i + e : i + z] & free_i[j + e : j + z]
        if not same.all():
            return e + int(same.argmin())
        e, step = z, 2 * step
    return e


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(doc position, item position, length) of the greedy tiles, in the order they are marked.

    Matches of at least the step's length wait in a heap, longest first. One that has lost words to
    another tile is cut to what is left, and waits again under its new length.
    """
    free_d, free_i = np.ones(len(doc), bool), np.ones(len(item), bool)
    out: list[tuple[int, int, int]] = []
    n = max(least, min(len(item), LONGEST_STEP))
    while True:
        heap = [(-e, i, j) for i, j in _starts(doc, item, free_d, free_i, n) if (e := _length(doc, item, free_d, free_i, i, j)) >= n]
        heapify(heap)
        while heap:
            e, i, j = heappop(heap)
            free = free_d[i : i - e] & free_i[j : j - e]
            if free.all():
                free_d[i : i - e] = free_i[j : j - e] = False
                out.append((i, j, -e))
                continue
            ends = np.flatnonzero(np.diff(np.concatenate(([0], free.astype(np.int8), [0]))))
            for a, z in zip(ends[::2].tolist(), ends[1::2].tolist()):
                if z - a >= n:
                    heappush(heap, (a - z, i + a, j + a))
        if n == least:
            return out
        n = max(least, n // 2)


def tile_texts(text: str, item: list[str], seed: int = SEED) -> tuple[float, int, int, int] | None:
    """(coverage, tiles, longest tile, first word) of an item's words by a text; None without a tile."""
    number: dict[str, int] = {}
    y = np.array([number.setdefault(w, len(number) + 1) for w in item], dtype=np.int64)
    n = min(seed, len(item))
    if not n:
        return None
    x = np.array([number.get(w, 0) for w in words_of(text)], dtype=np.int64)
    # Only words under a seed can be in a tile; the rest becomes one wall each.
    at = _runs(x > 0, n)
    at = at[np.isin(running(x, n)[at], running(y, n))] if len(at) else at
    under = np.zeros(len(x) + 2, np.int64)
    np.add.at(under, at, 1)
    np.add.at(under, at + n, -1)
    under = np.cumsum(under) > 0
    spots = np.nonzero(under[:-2] | under[1:-1])[0]
    found = tiles(np.where(under[spots], x[spots], 0), y, n)
    if not found:
        return None
    return sum(t[2] for t in found) / len(y), len(found), max(t[2] for t in found), int(spots[min(t[0] for t in found)])


def seed_hashes(words: list[str], n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words, in order; they depend on ``n``."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return (running(h, n) * np.uint64(2 * n + 1)).view(np.int64)


def _items(benchmark: DataFrame, seed: int, item_col: str, text_col: str) -> DataFrame:
    """(item_id, item, words, seeds): items with words; ``item`` names equal word lists."""

    def make():
        def f(ids, texts):
            cut = [(i, w) for i, w in zip(ids, map(words_of, texts)) if w]
            return (
                [i for i, _ in cut], [xxhash.xxh3_128_digest(" ".join(w)) for _, w in cut], [w for _, w in cut],
                pa.array([seed_hashes(w, min(seed, len(w))) for _, w in cut], pa.list_(pa.int64())),
            )

        return f

    rows = benchmark.select(F.col(item_col).cast("long").alias("item_id"), text_of(text_col).alias("text"))
    return map_rows(rows, ["item_id", "text"], make, "item_id long, item binary, words array<string>, seeds array<long>")


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """Documents with the whole text as ``text`` and its MD5 as ``key``."""
    return docs.select(*[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(docs.columns)], text_of(text_col).alias("text")).withColumn("key", F.unhex(F.md5("text")))


def _doc_seeds(texts: DataFrame, lengths: list[int]) -> DataFrame:
    """(key, seeds) of rows (key, text): distinct hashes of the runs of each of ``lengths`` words."""

    def make():
        def f(keys, texts):
            cut = [words_of(t) for t in texts]
            return keys, pa.array([np.unique(np.concatenate([seed_hashes(w, n) for n in lengths])) for w in cut], pa.list_(pa.int64()))

        return f

    return map_rows(texts, ["key", "text"], make, "key binary, seeds array<long>")


def tiled(store: Store, rows: DataFrame, items: DataFrame, coverage: float, seed: int) -> DataFrame:
    """(key, item, coverage, n_tiles, longest_tile, first_word) of the contaminated texts of rows (key, text)."""
    distinct = store.save(items.groupBy("item").agg(F.first("words").alias("words"), F.first("seeds").alias("seeds")).withColumn("n", F.size("words")))
    lengths = [r[0] for r in distinct.select(F.least("n", F.lit(seed)).alias("l")).distinct().orderBy("l").collect()]  # ``seed`` of them at most
    places = store.save(distinct.select("item", "n", F.explode("seeds").alias("seed")).groupBy("item", "n", "seed").agg(F.count("*").alias("places")))
    if not lengths:
        lengths = [seed]
    hits = _doc_seeds(rows, lengths).select("key", F.explode("seeds").alias("seed")).join(places, "seed")
    # Each tile of L words has L - seed + 1 seeds, at least a share 1 / seed of its words.
    hits = hits.groupBy("key", "item", "n", "seed").agg(F.first("places").alias("places"))
    pairs = hits.groupBy("key", "item", "n").agg(F.sum("places").alias("shared")).where(F.col("shared") * F.least("n", F.lit(seed)) >= F.col("n") * (coverage - 1e-9))
    pairs = store.save(pairs.select("key", "item"))
    texts = rows.join(pairs.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    both = pairs.join(texts, "key").join(distinct.select("item", "words"), "item")

    def make():
        def f(keys, names, texts, words):
            found = [(k, i, *m) for k, i, t, w in zip(keys, names, texts, words) if (m := tile_texts(t, w, seed)) and m[0] >= coverage]
            return list(zip(*found)) or [[]] * 6

        return f

    return map_rows(both, ["key", "item", "text", "words"], make, "key binary, item binary, coverage double, n_tiles long, longest_tile long, first_word long")


def contaminations(
    docs: DataFrame,
    benchmark: DataFrame,
    coverage: float = COVERAGE,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest_tile, first_word) of contaminated documents."""
    store = Store(docs.sparkSession)
    items = store.save(_items(benchmark, seed, "item_id", "text"))
    rows = _keyed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "text")
    found = store.save(tiled(store, rows.select("key", "text"), items, coverage, seed))
    store.keep(items, found)
    out = rows.select(F.col("c0").alias("doc_id"), "key").join(found, "key").join(items.select("item_id", "item"), "item")
    return out.select("doc_id", "item_id", "coverage", "n_tiles", "longest_tile", "first_word")


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with their columns."""
    store = Store(docs.sparkSession)
    items = store.save(_items(benchmark, seed, "item_id", "text"))
    rows = _keyed(docs, text_col)
    found = store.save(tiled(store, rows.select("key", "text"), items, coverage, seed).select("key").distinct())
    store.keep(found)
    left = rows.join(found, "key", "left_anti")
    return left.select(*[F.col(f"c{n}").alias(c) for n, c in enumerate(docs.columns)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
