"""Retrieval lanes over a batch of queries (query_id, text, ...): each gives (query_id, id, score, rank).

A lane filters before it limits, so a limit counts eligible rows only. Only ids, scores and
tie-break keys are shuffled; contents are joined once the few winners are known.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions import text as T
from palimpsest.functions.visibility import Filter, vector_live, visible
from palimpsest.sources.store import Store

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
FLOOR, QUANTUM = 0.02, 1e-6
ENTITY_TOKENS, ENTITY_LEAST, ENTITY_LIMIT = 8, 3, 20


def top(hits: DataFrame, limit: Column | int, *order) -> DataFrame:
    """The first ``limit`` hits of each query; the rank starts at 1."""
    w = Window.partitionBy("query_id").orderBy(*order)
    limit = F.lit(limit) if isinstance(limit, int) else limit
    return hits.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= limit)


def ordered(score: Column) -> list:
    """Total order of hits: score, recency, content, id."""
    return [F.desc(score), F.desc("t_event"), F.col("content_key"), F.col("id")]


def postings(records: DataFrame, asked: DataFrame, seen: Column) -> DataFrame:
    """(id, dl, seen, term, tf) of the words that any query asks; other words never leave the scan.

    ``asked`` maps words to terms (word, term): it is small or not; the join is left to Spark, which
    sends a small one to all. ``seen`` says of a record whether it may be a hit. Length and ``seen``
    are taken before the explosion, once a record.
    """
    rows = records.select("id", T.token_count(F.col("content")).alias("dl"), F.coalesce(seen, F.lit(False)).alias("seen"), "content")
    words = rows.select("id", "dl", "seen", F.explode(T.pieces(F.col("content"))).alias("word"))
    return words.join(asked, "word").groupBy("id", "dl", "seen", "term").agg(F.count("*").alias("tf"))


def lengths(records: DataFrame) -> DataFrame:
    """(id, dl): terms of each record. Apart from the explosion, which would count them once a term."""
    return records.select("id", T.token_count(F.col("content")).alias("dl"))


def vocabulary(records: DataFrame, asked: DataFrame, term_of) -> DataFrame:
    """(word, term): the words of the records that ``term_of`` maps to asked terms.

    Only words that it may alter are listed; its ``alters`` tells them from numbers and the like,
    of which each record may have its own.
    """
    alters = getattr(term_of, "alters", lambda c: F.lit(True))
    words = records.select(F.explode(T.pieces(F.col("content"))).alias("word")).where(alters(F.col("word"))).distinct()
    own = asked.where(~alters(F.col("term"))).select(F.col("term").alias("word"), "term")
    return words.withColumn("term", term_of(F.col("word"))).join(asked, "term", "left_semi").select("word", "term").unionByName(own)


def index(records: DataFrame) -> DataFrame:
    """(id, dl, term, tf) of all terms: to be stored beside the log and asked again and again."""
    words = records.select("id", F.explode(T.pieces(F.col("content"))).alias("term"))
    tf = words.where("term <> ''").groupBy("id", "term").agg(F.count("*").alias("tf"))
    return tf.join(lengths(records), "id").select("id", "dl", "term", "tf")


def bm25(records: DataFrame, queries: DataFrame, f: Filter, limit: Column | int, stats_scope: str = "all", stored: DataFrame | None = None, term_of=None) -> DataFrame:
    """Okapi BM25 of any query term. Statistics cover all stored records, or only the visible.

    ``stored`` is an ``index`` of the same records: then their texts are not read again for terms.
    ``term_of`` maps terms, of texts and queries alike, to what is compared, such as their stems.
    A limit that is a Column is one of ``queries``.
    """
    own = [limit.alias("most")] if isinstance(limit, Column) else []
    asked = queries.select("query_id", *own, F.explode(T.query_terms(F.col("text"))).alias("term"))
    corpus = records if stats_scope == "all" else records.where(visible(f))
    store = Store(records.sparkSession)
    if term_of is not None:
        asked = asked.withColumn("term", term_of(F.col("term"))).distinct()
    if stored is not None and term_of is not None:
        stored = stored.withColumn("term", term_of(F.col("term"))).groupBy("id", "dl", "term").agg(F.sum("tf").alias("tf"))
    terms = asked.select("term").distinct()
    # Tables that are read more than once, or whose size decides how they are joined, are written.
    if stored is not None:
        found = store.save(stored.join(terms, "term"))
        mine = found.join(records.where(visible(f)).select("id"), "id", "left_semi")
    else:
        words = terms.select(F.col("term").alias("word"), "term") if term_of is None else store.save(vocabulary(corpus, terms, term_of))
        found = store.save(postings(corpus, words, visible(f)))
        mine = found.where("seen")
    total = corpus.agg(F.count("*").alias("n"), F.avg(T.token_count(F.col("content"))).alias("avgdl"))
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    odds = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = df.crossJoin(F.broadcast(total)).select("term", F.greatest(odds, F.lit(LEAST_IDF)).alias("idf"), "avgdl")  # one row
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scores = mine.join(store.save(idf), "term").join(asked, "term").groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"), *[F.first("most").alias("most")] * bool(own))
    hits = store.save(scores).join(records.where(visible(f)).select("id", "t_event", "content"), "id").withColumn("content_key", content_key())
    return top(hits, F.col("most") if own else limit, *ordered(F.col("score"))).select("query_id", "id", "score", "rank")


def content_key() -> Column:
    """The tie-break by content: hashed only where a hit needs it, after the joins."""
    return F.sha2(F.coalesce("content", F.lit("")), 256)


def entity_terms(text: Column) -> Column:
    """What of a query may name an entity."""
    first = F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, ENTITY_TOKENS)
    clean = F.transform(first, lambda w: F.regexp_replace(T.fold(w), "[^a-z0-9_-]", ""))
    return F.array_distinct(F.filter(clean, lambda w: F.length(w) >= ENTITY_LEAST))


def entity(records: DataFrame, queries: DataFrame, f: Filter, limit: int = ENTITY_LIMIT, dedup: bool = True) -> DataFrame:
    """Records with a key segment that the query names, newest first. ``dedup=False`` repeats a
    record for every segment it matches."""
    asked = queries.select("query_id", F.explode(entity_terms(F.col("text"))).alias("segment"))
    keys = records.where(visible(f)).select("id", "t_event", F.explode("entity_keys").alias("key"))
    segments = keys.select("id", "t_event", "key", F.explode(F.array_distinct(F.split("key", r"\."))).alias("segment"))
    hits = segments.join(asked, "segment")
    if dedup:
        hits = hits.groupBy("query_id", "id").agg(F.first("t_event").alias("t_event"))
    hits = hits.withColumn("score", F.lit(1.0))
    order = [F.desc("t_event"), F.col("id")] + ([] if dedup else [F.col("key"), F.col("segment")])
    return top(hits, limit, *order).select("query_id", "id", "score", "rank")


def recent(records: DataFrame, queries: DataFrame, f: Filter, limit: int) -> DataFrame:
    """The newest visible records for the queries that ask for recency. One top list serves all."""
    newest = records.where(visible(f)).select("id", "t_event").orderBy(F.desc("t_event"), "id").limit(limit)
    both = newest.crossJoin(queries.select("query_id"))  # at most ``limit`` records for each query
    return top(both, limit, F.desc("t_event"), "id").select("query_id", "id", F.lit(0.0).alias("score"), "rank")


#: Vectors and queries that meet in one group.
MOST_VECTORS, MOST_ASKED = 65_536, 4096


def _product(limit: int, floor: float):
    """Cosines of a group's vectors and queries by one matrix product per block; each query keeps
    its ``limit`` best and what ties with them."""

    def unit(column: pa.ChunkedArray) -> np.ndarray:
        x = np.array(column.to_pylist(), dtype=np.float64)
        n = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return x / np.where(n == 0, 1.0, n)

    def f(rows: pa.Table) -> pa.Table:
        asks = rows["asks"].to_numpy(zero_copy_only=False)
        out = [[], [], []]
        if asks.any() and not asks.all():
            q, v = rows.filter(pa.array(asks)), rows.filter(pa.array(~asks))
            ids, names, x, y = np.array(v["id"].to_pylist(), dtype=object), q["query_id"].to_pylist(), unit(v["vec"]), unit(q["vec"])
            for a in range(0, len(y), 256):
                s = np.round(y[a : a + 256] @ x.T, 6)
                for i, row in enumerate(s):
                    keep = row >= floor
                    if keep.sum() > limit:
                        keep &= row >= np.partition(row, -limit)[-limit] - QUANTUM
                    out[0] += [names[a + i]] * int(keep.sum())
                    out[1] += ids[keep].tolist()
                    out[2] += row[keep].tolist()
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.float64()))], names=["query_id", "id", "score"])

    return f


def vector(records: DataFrame, vectors: DataFrame, queries: DataFrame, f: Filter, limit: int, floor: float = FLOOR) -> DataFrame:
    """Exact cosine of live records; ``queries`` has (query_id, vec). Scores within a quantum tie.

    Vectors are dealt into blocks of bounded size, and so are queries; each pair of blocks is one
    group and one matrix product. Vectors are compared with those of their own length.
    """
    live = records.where(visible(f) & vector_live())
    mine = live.select("id").join(vectors.select("id", "vec"), "id")
    n, m = mine.count(), queries.count()
    across, down = max(1, -(-n // MOST_VECTORS)), max(1, -(-m // MOST_ASKED))
    block = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    name = F.col("query_id").cast("long")
    cells = mine.select(F.lit(None).cast("long").alias("query_id"), "id", "vec", F.size("vec").alias("dims"), block("id", across).alias("across"), every(down).alias("down"), F.lit(False).alias("asks")).unionByName(
        queries.select(name.alias("query_id"), F.lit(None).cast("string").alias("id"), "vec", F.size("vec").alias("dims"), every(across).alias("across"), block("query_id", down).alias("down"), F.lit(True).alias("asks"))
    )
    hits = cells.groupBy("dims", "across", "down").applyInArrow(_product(limit, floor), "query_id long, id string, score double")
    hits = hits.join(live.select("id", "t_event", "content"), "id").withColumn("content_key", content_key())
    best = top(hits, limit, *ordered(F.floor(F.col("score") / QUANTUM + 0.5)))
    return best.select(F.col("query_id").cast(queries.schema["query_id"].dataType).alias("query_id"), "id", "score", "rank")


def approximate(records: DataFrame, vectors: DataFrame, queries: DataFrame, f: Filter, limit: int, lists: int, probes: int, sample: int = 20_000) -> DataFrame:
    """The vector lane over an inverted file: lists around centroids, ``probes`` of them searched.

    Centroids come from k-means over a sample of at most ``sample`` vectors; every vector is
    indexed. What the probed lists hold is scored exactly, so only misses differ from ``vector``.
    """
    live = records.where(visible(f) & vector_live())
    unit = F.transform("vec", lambda v: v / F.col("norm"))
    picked = vectors.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(sample)
    points = picked.withColumn("norm", T.norm(F.col("vec"))).select(unit.alias("unit")).distinct().select(array_to_vector("unit").alias("features"))
    lists = min(lists, points.count())
    if lists < 2:  # nothing to divide
        return vector(records, vectors, queries, f, limit)
    fitted = KMeans(k=lists, seed=7, maxIter=10).fit(points)
    mine = live.select("id").join(vectors.select("id", "vec"), "id")
    centers = np.array([c / (np.linalg.norm(c) or 1.0) for c in fitted.clusterCenters()])  # ``lists`` of them

    @F.pandas_udf("array<int>")
    def near(vecs: pd.Series, most: pd.Series) -> pd.Series:
        x = np.array(vecs.tolist())
        order = np.argsort(-(x @ centers.T), axis=1, kind="stable")
        return pd.Series([o[:m].tolist() for o, m in zip(order, most)])

    placed = mine.select("id", "vec", F.get(near("vec", F.lit(1)), F.lit(0)).alias("list"))
    asked = queries.select("query_id", F.col("vec").alias("asked"), F.explode(near("vec", F.lit(probes))).alias("list"))
    hits = placed.join(asked, "list").select("query_id", "id", F.round(T.cosine(F.col("vec"), F.col("asked")), 6).alias("score")).where(F.col("score") >= FLOOR)
    hits = hits.join(live.select("id", "t_event", "content"), "id").withColumn("content_key", content_key())
    return top(hits, limit, *ordered(F.floor(F.col("score") / QUANTUM + 0.5))).select("query_id", "id", "score", "rank")


WORD = re.compile("[a-z0-9]+")
LOWER = str.maketrans(T.UPPER, T.LOWER)
#: Features whose bucket and weight a task remembers.
REMEMBERED = 200_000


def _hashed(feature: str, dims: int) -> tuple[int, float]:
    h = int.from_bytes(hashlib.md5(feature.encode()).digest()[:8], "big")
    return h % dims, (1.0 if h >> 63 else -1.0) * (1.0 + math.log1p(len(feature) / 6))


def hash_vectors(df: DataFrame, id_col: str = "id", text_col: str = "content", dims: int = T.DIMENSIONS) -> DataFrame:
    """Sparse feature-hashed unit vectors: (id, bucket, value). A record's features meet in its own row."""
    stop = frozenset(T.FEATURE_STOPWORDS)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, float]] = {}
        for b in batches:
            buckets, values = [], []
            for text in b.column(1).to_pylist():
                ws = [w for w in WORD.findall((text or "").translate(LOWER)) if w not in stop]
                sums: dict[int, float] = {}
                for w in chain(ws, map("_".join, pairwise(ws))):
                    at = known.get(w)
                    if at is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        at = known[w] = _hashed(w, dims)
                    sums[at[0]] = sums.get(at[0], 0.0) + at[1]
                length = math.sqrt(math.fsum(v * v for v in sums.values())) or 1.0
                buckets.append(list(sums))
                values.append([v / length for v in sums.values()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(buckets, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], names=["id", "buckets", "values"])

    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(f, "id string, buckets array<int>, values array<double>")
    return rows.select("id", F.inline(F.arrays_zip("buckets", "values"))).toDF("id", "bucket", "value")


def dense(df: DataFrame, id_col: str = "id", text_col: str = "content", dims: int = T.DIMENSIONS) -> DataFrame:
    """(id, vec): the same vectors, all dimensions listed."""
    sparse = hash_vectors(df, id_col, text_col, dims).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "value"))).alias("m"))
    return sparse.select("id", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("vec"))
