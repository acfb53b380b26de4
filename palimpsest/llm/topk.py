"""Exact top-k search by columnar branch and bound (operator 1).

Queries are first scored against a bounded set, the candidate of the largest norm of each of
``PILOT`` hash groups: the k-th score found there is a bar that the answer can't lie below. Then queries and candidates meet in
cells: a block of queries times a block of candidates, both bounded by rows and by components,
so that no task grows with the input or with the length of vectors. In a cell the candidates lie in vertical
layout, a row per dimension, largest dimensions first and candidates by falling norm. Scores
are accumulated block by block of dimensions; after each block the norms of what remains bound
every score from above (Cauchy-Schwarz), and candidates that no query still needs are
compacted away; once few pairs survive, only those are carried on. Bounds are never below the
true score and equal scores survive, so the result is exact. Each cell keeps k per query, and
a window merges the cells.

Vectors that are null or hold null or non-finite components, and rows with a null id, take no
part. Vectors are compared with those of their own length. Rows that share the query's id are
not its candidates; of repeated query rows the smallest vector counts; repeated candidates
are listed as often as they occur. Components and scores must fit a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm._base import table

NAME = "op1_topk_search"
K = 20
EVERY = 20
#: Most queries and candidates in a cell, and most components of either.
MOST_QUERIES, MOST_ROWS, MOST_COMPONENTS = 32_768, 65_536, 1 << 22
#: Candidates that set the first bar.
PILOT = 2048
#: Rows of queries and of candidates worked on at once, and dimensions accumulated at once.
QUERY_ROWS, TILE, BLOCK = 128, 2048, 16
#: Below this share of surviving pairs, pairs are carried on one by one.
SPARSE = 0.05


def _kind(q: np.ndarray, c: np.ndarray) -> type:
    """The smallest type in which every partial score is exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    return np.float32 if most < 2**23 else np.float64 if most < 2**51 else np.int64


def _rest(x: np.ndarray, cuts: list[int]) -> list[np.ndarray]:
    """Norms of what each row holds from each cut on, rounded up."""
    sq = np.square(x.astype(np.float64))
    return [np.sqrt(sq[:, c:].sum(axis=1)) * (1 + 1e-9) for c in cuts]


def search(q: np.ndarray, q_id: np.ndarray, c: np.ndarray, c_id: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, id, score): the k best candidates of each query, ties to smaller ids.

    Candidates whose score is below ``least`` of a query may be left out.
    """
    kind = _kind(q, c)
    by_mass = np.argsort(-np.square(c.astype(np.float64)).sum(axis=0), kind="stable")
    by_norm = np.argsort(-np.square(c.astype(np.float64)).sum(axis=1), kind="stable")
    q, c, c_id = q[:, by_mass], c[by_norm][:, by_mass], c_id[by_norm]
    dims = q.shape[1]
    cuts = list(range(0, dims, BLOCK)) or [0]
    q_rest, c_rest = _rest(q, cuts), _rest(c, cuts)
    q, columns = q.astype(kind), np.ascontiguousarray(c.T.astype(kind))
    out = []
    for a in range(0, len(q), QUERY_ROWS):
        z = min(a + QUERY_ROWS, len(q))
        n, own = z - a, q_id[a:z]
        bar = np.full(n, -np.inf) if least is None else least[a:z].astype(np.float64)
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
        for t in range(0, columns.shape[1], TILE):
            cols = np.arange(t, min(t + TILE, columns.shape[1]))
            cols = cols[(np.outer(q_rest[0][a:z], c_rest[0][cols]) + 1 >= bar[:, None]).any(axis=0)]
            part = np.zeros((n, len(cols)), dtype=kind)
            pairs = None
            for b, cut in enumerate(cuts):
                dim = slice(cut, min(cut + BLOCK, dims))
                if pairs is None:
                    part += q[a:z, dim] @ columns[dim][:, cols]
                else:
                    i, j, s = pairs
                    s = s + np.einsum("dp,dp->p", q[a:z, dim].T[:, i], columns[dim][:, j])
                    pairs = (i, j, s)
                if b + 1 == len(cuts) or not len(cols):
                    continue
                if pairs is not None:
                    top = s + q_rest[b + 1][a:z][i] * c_rest[b + 1][j] + 1 >= bar[i]
                    pairs = (i[top], j[top], s[top])
                    continue
                alive = part + np.outer(q_rest[b + 1][a:z], c_rest[b + 1][cols]) + 1 >= bar[:, None]
                if alive.mean() < SPARSE:
                    i, j = np.nonzero(alive)
                    pairs = (i, cols[j], part[i, j])
                elif (keep := alive.any(axis=0)).mean() < 0.7:
                    cols, part = cols[keep], part[:, keep]
            if pairs is None:
                score = part.astype(np.float64) if kind is not np.int64 else part
                mine = c_id[cols][None, :] == own[:, None]
                if score.shape[1] > k and kind is not np.int64:
                    score[mine] = -np.inf
                    bar = np.maximum(bar, np.partition(score, -k, axis=1)[:, -k])
                i, j = np.nonzero((score >= bar[:, None]) & ~mine)
                pairs = (i, cols[j], part[i, j])
            i, j, s = pairs
            ok = (s >= bar[i]) & (c_id[j] != own[i])
            i, ids, s = (np.concatenate(x) for x in zip(best, (i[ok], c_id[j[ok]], s[ok].astype(np.int64))))
            order = np.lexsort((ids, -s, i))
            i, ids, s = i[order], ids[order], s[order]
            place = np.arange(len(i)) - np.searchsorted(i, i, "left")
            best = tuple(x[place < k] for x in (i, ids, s))
            last = place == k - 1
            bar[i[last]] = np.maximum(bar[i[last]], s[last])
        out.append((best[0] + a, best[1], best[2]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.empty(0, np.int64) for _ in range(3))


def _cell(k: int):
    def f(rows: pa.Table) -> pa.Table:
        ids = rows["vec_id"].to_numpy()
        dims = rows["dims"][0].as_py()
        x = rows["vector"].combine_chunks()
        x = x.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dims)
        asks = rows["asks"].to_numpy(zero_copy_only=False)
        least = rows["bar"].to_numpy(zero_copy_only=False)[asks]
        q_id = ids[asks]
        i, found, score = search(x[asks], q_id, x[~asks], ids[~asks], k, least)
        return pa.table({"query_id": pa.array(q_id[i], pa.int64()), "vec_id": pa.array(found, pa.int64()), "score": pa.array(score, pa.int64())})

    return f


def _meet(q: DataFrame, c: DataFrame, across: int, down: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): at least the k best of each query, from ``across`` x ``down`` cells."""
    block = lambda parts, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    none = F.lit(float("-inf"))
    cells = c.select("*", none.alias("bar"), block(across, 1).alias("across"), every(down).alias("down"), F.lit(False).alias("asks")).unionByName(
        q.select("*", block(down, 2).alias("down"), every(across).alias("across"), F.lit(True).alias("asks"))
    )
    return cells.groupBy("dims", "across", "down").applyInArrow(_cell(k), "query_id long, vec_id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(queries: DataFrame, rows: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "vector") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products, exactly.

    Vectors are arrays of long. The two frames may be the same; nothing is collected.
    """
    spark = rows.sparkSession
    pick = lambda df: df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"), F.size(vector_col).alias("dims"))
    q, c = pick(queries).groupBy("vec_id").agg(F.min("vector").alias("vector"), F.min_by("dims", "vector").alias("dims")), pick(rows)
    n, longest = c.agg(F.count("*"), F.coalesce(F.max("dims"), F.lit(1))).first()
    m = queries.count()
    fit = max(1, MOST_COMPONENTS // max(1, longest))
    wide = min(MOST_ROWS, fit, max(2048, -(-n // (2 * spark.sparkContext.defaultParallelism))))
    across, down = max(1, -(-n // wide)), max(1, -(-m // min(MOST_QUERIES, fit)))
    norm = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    # One row of each group, combined before the shuffle: a sort with a limit would send rows of every partition to one task.
    group = F.pmod(F.xxhash64("vec_id"), F.lit(min(PILOT, fit)))
    pilot = c.groupBy(group.alias("group")).agg(F.max_by(F.struct("vec_id", "vector", "dims"), norm).alias("row")).select("row.*")
    bars = _first(_meet(q.withColumn("bar", F.lit(float("-inf"))), pilot, 1, down, k), k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("bar"))
    barred = q.join(bars, "vec_id", "left").select("vec_id", "vector", "dims", F.coalesce("bar", F.lit(float("-inf"))).alias("bar"))
    return _first(_meet(barred, c, across, down, k), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def whole(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector): components as floor(64 x); rows that take no part are left out."""
    x = F.col(vector_col)
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return df.where(F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda v: F.coalesce(fine(v.cast("double")), F.lit(False)))).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * 64)).alias("vector")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole(table(spark, sf_dir, "embeddings"))
    return top_k(rows.where(F.col("vec_id") % EVERY == 0), rows)


ORACLE = f"""
WITH v AS (
  SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
