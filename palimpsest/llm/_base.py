"""What the operators share: reading a table, Arrow mapping, caches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from palimpsest.sources.model import table  # noqa: F401

#: Rows handed to Python at once. Texts of a million characters then still fit a worker.
ROWS_AT_ONCE = 256


def map_rows(
    df: DataFrame,
    columns: list,
    make: Callable[[], Callable[..., Iterable]],
    schema: str,
    rows: int = ROWS_AT_ONCE,
) -> DataFrame:
    """Map ``df.select(columns)`` batch by batch.

    ``make()`` runs once per task and returns a function of the batch's columns (Python
    lists) that returns the output columns. Only the named columns reach Python.
    """
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for whole in batches:
            f = f or make()
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                made = f(*(c.to_pylist() for c in b.columns))
                yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(made, out.types)], schema=out)

    return df.select(*columns).mapInArrow(run, schema)


def text_of(column: str = "text"):
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)


class Recent:
    """What is known of words, in two generations: the older goes when the newer is full."""

    def __init__(self, most: int = 300_000, longest: int = 64):
        self.most, self.longest, self.new, self.old = most, longest, {}, {}

    def look(self, words: set) -> tuple[dict, list]:
        """What is known, and the words that are not."""
        new, old = self.new, self.old
        known = {w: new[w] for w in words & new.keys()}
        rest = words - known.keys()
        again = {w: old[w] for w in rest & old.keys()}
        new |= again
        known |= again
        return known, list(rest - again.keys())

    def add(self, found: dict) -> None:
        self.new.update((w, v) for w, v in found.items() if len(w) <= self.longest)
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}


#: Most ids that are broadcast: hashed, at about 32 bytes each, that is 32 MB.
MOST_IDS = 1_000_000


def by_ids(df: DataFrame, ids: DataFrame, id_col: str, how: str) -> DataFrame:
    """Semi or anti join on ids; they are broadcast only when counted to be few enough."""
    ids = ids.select(F.col(ids.columns[0]).alias(id_col))
    return df.join(F.broadcast(ids) if ids.count() <= MOST_IDS else ids, id_col, how).select(*df.columns)
