"""Tables written between steps, in a folder that every executor reaches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _files(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _files(spark, path)
    fs.delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it is not there."""
    fs, p = _files(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def rename(spark: SparkSession, path: str, new: str) -> None:
    """Move a folder to a name that must be free."""
    fs, p = _files(spark, path)
    if not fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"cannot move {path} to {new}")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, gone when the driver ends.

    Only a single-machine session may leave the setting empty: elsewhere a folder chosen here
    would be another one on each machine.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        top = f"file://{tempfile.gettempdir()}/palimpsest"
    path = f"{top.rstrip('/')}/{uuid.uuid4().hex}"
    fs, p = _files(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


class Store:
    """Written tables in one shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n, self.at = spark, shared_dir(spark), 0, {}

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n:03d}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.at[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for t in tables:
            _, path = self.at.pop(id(t), (None, None))
            if path:
                delete(self.spark, path)

    def keep(self, *tables: DataFrame) -> None:
        """Delete all tables but these."""
        left = {id(t) for t in tables}
        self.drop(*[t for k, (t, _) in list(self.at.items()) if k not in left])
