"""MinHash near-duplicates by SuperMinHash, banding, verification and union-find (operator 5).

A document is the set of its distinct word shingles, each a 64-bit hash; equal sets form a
class, which goes on as one node, named by a 128-bit hash of the set. SuperMinHash gives each
element a permutation of the registers with ranks as integer parts; a document stops as soon
as its largest register can't fall any more. Bands of registers are bucket keys. Links are
confirmed on full sets. Groups of copies are never expanded into all pairs:

1. each representative is compared with one smallest member of its buckets;
2. in buckets that still hold several components, what is outside the largest one is compared
   with some members of it;
3. what is still apart is compared with every member of its buckets that is in another
   component, unless their parity sketches show that too few elements can be in common. A bucket
   is cut into blocks of bounded size, and each pair of blocks is one group of the join.

So every candidate pair is confirmed, refuted, or inside one component.

A link of the threshold itself is missed with probability (1 - t**rows)**bands: 7e-8 at 0.85.

Null and empty texts have an empty set and are linked with nothing. Null ids take no part in
links; such rows have a null component and are kept. Repeated rows are one document. Rows with
different texts under one doc_id belong to one component, which has the links of all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm._base import by_ids, map_rows, table, text_of
from palimpsest.operators.graph import connected
from palimpsest.sources.store import Store

NAME = "op5_near_duplicates"
WORDS, PERCENT = 3, 85
BANDS, ROWS = 28, 5
#: 64-bit words of a set's parity sketch.
SKETCH = 16
#: Members of a bucket that are compared with each other in one group.
GROUP = 512

U = np.uint64
A, B, C = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * B
    x = (x ^ (x >> U(27))) * C
    return x ^ (x >> U(31))


def shingles(text: str, n: int) -> np.ndarray:
    """The sorted distinct hashes of the runs of ``n`` words; fewer words are one run."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))
    n = min(n, len(words))
    x = h[: len(h) - n + 1]
    for i in range(1, n):
        x = x * A + h[i : len(h) - n + 1 + i]
    return np.unique(mix(x + U(n)))


def set_key(elements: np.ndarray) -> bytes:
    """The name of a set."""
    return xxhash.xxh3_128_digest(elements.tobytes())


def super_minhash(elements: np.ndarray, doc: np.ndarray, docs: int, m: int) -> np.ndarray:
    """Registers (docs x m) of the sets given as elements with their documents' positions.

    A register holds rank << 32 | fraction; rank j is the integer part of Ertl's j + r.
    """
    h = np.full((docs, m), np.iinfo(np.int64).max, dtype=np.int64)
    flat = h.reshape(-1)
    perm = None
    for j in range(m):
        if j:
            on = (h.max(axis=1) >> 32 >= j)[doc]
            if not on.any():
                break
            if not on.all():
                elements, doc = elements[on], doc[on]
                perm = perm[on] if perm is not None else None
        draw = mix(elements + np.array([j + 1], U) * A)
        k = j + ((draw & U(0xFFFFFFFF)) * U(m - j) >> U(32)).astype(np.int64)
        if j == 0:
            at = first = k
        else:
            rows = np.arange(len(k))
            if perm is None:  # only what goes beyond rank 0 needs its permutation
                perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32), (len(k), 1))
                k0 = first[on]
                perm[rows, k0], perm[:, 0] = 0, k0
            at = perm[rows, k].astype(np.int64)
            perm[rows, k], perm[:, j] = perm[:, j].copy(), at
        np.minimum.at(flat, doc * m + at, (j << 32) | (draw >> U(32)).astype(np.int64))
    return h


def band_keys(h: np.ndarray, bands: int, rows: int) -> np.ndarray:
    x = h[:, : bands * rows].reshape(len(h), bands, rows).astype(U)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U), x.shape[:2]).copy()
    for i in range(rows):
        key = mix(key * A + x[:, :, i])
    return key.view(np.int64)


def signatures(df: DataFrame, id_col: Column, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, key, bands); key identifies the set and is null for an empty one."""

    def make():
        def f(ids, texts):
            sets = [shingles(t, n) for t in texts]
            sizes = np.array([len(s) for s in sets])
            h = super_minhash(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), len(sets), bands * rows)
            keys = band_keys(h, bands, rows)
            return (
                ids,
                sizes,
                [set_key(s) if len(s) else None for s in sets],
                pa.array([k if len(s) else () for k, s in zip(keys, sets)], pa.list_(pa.int64())),
            )

        return f

    return map_rows(df, [id_col.cast("long").alias("doc_id"), text_of()], make, "doc_id long, n_shingles long, key binary, bands array<long>")


def parity(items: np.ndarray) -> np.ndarray:
    """A bit per cell: whether an odd number of elements falls into it.

    Two sketches differ in at most as many bits as the sets have elements not in common.
    """
    odd = np.bincount((items & U(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def shingle_sets(df: DataFrame, n: int) -> DataFrame:
    """(key, items, sketch) of the texts of ``df``; no row for an empty set."""

    def make():
        def f(texts):
            sets = [s for s in (shingles(t, n) for t in texts) if len(s)]
            many = lambda rows: pa.array(rows, pa.list_(pa.int64()))
            return [set_key(s) for s in sets], many([s.view(np.int64) for s in sets]), many([parity(s) for s in sets])

        return f

    return map_rows(df, ["text"], make, "key binary, items array<long>, sketch array<long>")


def _local_forest(edges: DataFrame) -> DataFrame:
    """Union-find within each partition: its edges become stars around smallest members."""

    def run(batches):
        up: dict[bytes, bytes] = {}

        def root(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x, y = root(x), root(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
        rest = [x for x in up if root(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(rest, pa.binary()), pa.array([root(x) for x in rest], pa.binary())], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a binary, b binary")


def _near(n: str, m: str, percent: int) -> Column:
    """Sets of these sizes can reach the threshold."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    side = lambda c: sets.select(F.col("key").alias(c), F.col("items").alias(f"{c}_items"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("a_items", "b_items"))
    return both.where(common * 100 >= (F.size("a_items") + F.size("b_items") - common) * percent).select("a", "b")


def _mixed(store: Store, members: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, key, n, comp) of the buckets that hold more than one component."""
    now = members.select("bucket", "key", "n").join(roots.select(F.col("a").alias("key"), F.col("b").alias("root")), "key", "left")
    now = store.save(now.select("bucket", "key", "n", F.coalesce("root", "key").alias("comp")))
    several = now.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("bucket")
    several = store.save(several)  # joins of two written tables may be split at a hot bucket
    return store.save(now.join(several, "bucket", "left_semi"))


def apart_pairs(store: Store, mixed: DataFrame, sets: DataFrame, percent: int, group: int = GROUP) -> DataFrame:
    """(a, b): pairs of a bucket in different components that may reach the threshold.

    A bucket of more than ``group`` members is cut into blocks by hash, and every member goes to
    the groups of its block with each block: no group holds more than about two blocks.
    """
    sizes = store.save(mixed.groupBy("bucket").agg(F.ceil(F.count("*") / group).cast("int").alias("blocks")))
    mine = F.pmod(F.xxhash64("key", F.lit(4)), F.col("blocks")).cast("int").alias("mine")
    placed = store.save(mixed.join(sizes, "bucket").join(sets.select("key", "sketch"), "key").select("bucket", "blocks", mine, "key", "n", "comp", "sketch"))
    rows = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("cell", F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")))
    left = rows.where("mine <= other").select("cell", "mine", F.col("key").alias("a"), "n", "sketch", "comp")
    right = rows.where("mine >= other").select("cell", F.col("mine").alias("at"), F.col("other").alias("of"), F.col("key").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("sketch_b"), F.col("comp").alias("comp_b"))
    pairs = left.join(right, "cell").where("comp <> comp_b AND mine = of AND (mine < at OR a < b)").where(_near("n", "m", percent))
    # No more elements are in common than the sketches allow; most pairs end here.
    differ = sum((F.bit_count(F.get("sketch", F.lit(i)).bitwiseXOR(F.get("sketch_b", F.lit(i)))) for i in range(SKETCH)), F.lit(0))
    both = F.col("n") + F.col("m")
    pairs = pairs.where((both - differ) * (100 + percent) >= both * (2 * percent))
    return store.save(pairs.select("a", "b").distinct())


def components(
    docs: DataFrame,
    n: int = WORDS,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
    id_col: str = "doc_id",
) -> DataFrame:
    """(doc_id, n_shingles, key, component_id, kept) of every row of ``docs``."""
    store = Store(docs.sparkSession)
    key_col = F.col(id_col).cast("long")
    signed = store.save(signatures(docs, key_col, n, bands, rows))
    named = signed.where("doc_id IS NOT NULL AND key IS NOT NULL")
    classes = store.save(named.groupBy("key").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    exploded = classes.select("key", "n", F.explode("bands").alias("bucket"))
    heads = store.save(exploded.groupBy("bucket").agg(F.min(F.struct("key", "n")).alias("head"), F.count("*").alias("size")).where("size > 1").select("bucket", "head"))
    members = store.save(exploded.join(heads, "bucket").distinct())
    ids = store.save(members.select("key").distinct().join(classes.select("key", "id"), "key").select("id").distinct())
    texts = by_ids(docs.select(key_col.alias("id"), text_of()), ids, "id", "left_semi")
    sets = store.save(shingle_sets(texts, n).groupBy("key").agg(F.first(F.struct("items", "sketch")).alias("s")).select("key", "s.*"))

    # Texts under one doc_id belong together.
    shared = named.groupBy("doc_id").agg(F.min("key").alias("b"), F.max("key").alias("high")).where("b < high").select("doc_id", "b")
    shared = named.join(shared, "doc_id").where("key > b").select(F.col("key").alias("a"), "b").distinct()

    stars = members.where(F.col("key") != F.col("head.key")).where(_near("n", "head.n", percent))
    stars = stars.groupBy("key", F.col("head.key").alias("center")).agg(F.count("*").alias("shared"))
    stars = store.save(stars.groupBy(F.col("key").alias("a")).agg(F.max_by("center", F.struct("shared", "center")).alias("b")))
    roots = connected(store, _local_forest(shared.unionByName(_confirmed(stars, sets, percent))))

    mixed = _mixed(store, members, roots)
    if not mixed.isEmpty():
        count = mixed.groupBy("bucket", "comp").agg(F.count("*").alias("size"), *[F.min(F.struct(F.xxhash64("key", F.lit(s)).alias("h"), "key", "n")).alias(f"c{s}") for s in (1, 2, 3)])
        most = store.save(count.groupBy("bucket").agg(F.max(F.struct("size", "comp", "c1", "c2", "c3")).alias("m")))
        outside = mixed.join(most, "bucket").where(F.col("comp") != F.col("m.comp"))
        pairs = outside.select(F.col("key").alias("a"), "n", F.explode(F.array_distinct(F.array(*[F.struct(f"m.c{s}.key", f"m.c{s}.n") for s in (1, 2, 3)]))).alias("c"))
        tried = store.save(pairs.where(_near("n", "c.n", percent)).select("a", F.col("c.key").alias("b")).distinct())
        roots = connected(store, _local_forest(roots.unionByName(_confirmed(tried, sets, percent))))

        mixed = _mixed(store, mixed, roots)
        if not mixed.isEmpty():
            pairs = apart_pairs(store, mixed, sets, percent)
            roots = connected(store, _local_forest(roots.unionByName(_confirmed(pairs, sets, percent))))

    member = classes.select("key", "id").join(roots.select(F.col("a").alias("key"), F.col("b").alias("root")), "key", "left").withColumn("root", F.coalesce("root", "key"))
    member = store.save(member)
    least = store.save(member.groupBy("root").agg(F.min("id").alias("component_id")))
    found = store.save(member.join(least, "root").select("key", "component_id"))
    store.keep(signed, found)
    # Rows of one doc_id share a component, be their own text empty or not.
    by_doc = named.select("doc_id", "key").join(found, "key").groupBy("doc_id").agg(F.min("component_id").alias("of_doc"))
    out = signed.select("doc_id", "n_shingles", "key").join(by_doc, "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("of_doc", "doc_id"))
    return out.select("doc_id", "n_shingles", "key", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one document, the smallest id, of each component; all columns stay.

    Of rows that repeat an id the one stays whose values come first, in the order of the columns
    that can be ordered. Rows without an id stay.
    """
    store = Store(docs.sparkSession)
    found = store.save(components(docs, n, percent, id_col=id_col).select("doc_id", "kept"))
    gone = store.save(found.where("NOT kept").select("doc_id").distinct())
    left = by_ids(docs, gone, id_col, "left_anti")
    again = store.save(found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    store.keep(gone, again)
    if again.isEmpty():
        return left
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    one = by_ids(left, again, id_col, "left_semi").groupBy(id_col).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), whole).alias("row")).select("row.*")
    return by_ids(left, again, id_col, "left_anti").unionByName(one)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents")).drop("key")
