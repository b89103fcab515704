"""Reading tables and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` under sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; without it one of this machine, for a local master only."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tessera.cut.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-cut-")
        spark.conf.set("tessera.cut.dir", path)
    return path.rstrip("/")


def small(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of so many rows, so that the Python objects of a task are those of a slice."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: written once to the shared folder as Parquet and read back; for loops of joins."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what cut() wrote for these tables, which nothing still to be computed reads."""
    for df in tables:
        path = _WRITTEN.pop(df, None)
        if path:
            context = df.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def upsert(old: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of new, and those of old whose key new does not have."""
    return old.join(new, key, "left_anti").unionByName(new)


def remove(old: DataFrame, keys: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of old whose key is not among keys."""
    return old.join(keys, key, "left_anti")


def drift(pages: DataFrame, index: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and state (missing, stale, orphan) of rows on which pages and index differ."""
    a = pages.select(key, F.struct(*columns).alias("_page"))
    b = index.select(key, F.struct(*columns).alias("_index"))
    state = F.when(F.col("_index").isNull(), "missing").when(F.col("_page").isNull(), "orphan").when(~F.col("_page").eqNullSafe(F.col("_index")), "stale")
    return a.join(b, key, "full_outer").select(key, state.alias("state")).filter("state is not null")
