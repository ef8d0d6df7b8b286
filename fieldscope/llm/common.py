"""Shared helpers of the operators in this subpackage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file; operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_folder(spark: SparkSession) -> str:
    """This application's own folder within that of spark.checkpoint.dir, which all executors share.

    Where the setting is absent a folder of this machine serves local sessions only; on a cluster its absence is an error.
    """
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(shared)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """df, computed once into the shared folder, so that the rows outlive any executor, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Lowers the session's bounds on an Arrow batch, so that batches of long texts stay small on both sides; lower settings are kept.

    Spark's defaults, 10,000 rows and 64 MB, are held several times over by each task: as vectors, as messages, and by Python.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, rows + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    in_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if in_bytes(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) not in range(1, in_bytes(size) + 1):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def whole(text: str = "text"):
    """The text column with null as the empty text."""
    return F.coalesce(F.col(text), F.lit(""))


def ddl(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def sampled(df: DataFrame, column: str, share: float) -> DataFrame:
    """About this share of the rows, chosen by a 64-bit hash of the column: the same ones on every run, however small the share."""
    return df if share >= 1 else df.where(F.xxhash64(column) < F.lit(int(share * 2**64) - 2**63))


def lookup(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int, hot_keys: int = 20_000) -> DataFrame:
    """rows joined with keyed on one column; keyed has one row a key, with the number of rows that hold the key in `count`.

    Keys that hold more than total / hot_keys of the rows, of which there are fewer than hot_keys, meet their rows by broadcast, so that no
    task gets all rows of a hot key; the others by a shuffle. Where there are few rows in all, no key is hot.
    """
    if total <= 20_000:
        return rows.join(keyed.drop(count), key)
    most = max(1000, total // hot_keys)
    hot, rest = keyed.where(F.col(count) > most).drop(count), keyed.where(F.col(count) <= most).drop(count)
    columns = [*rows.columns, *(c for c in keyed.columns if c not in (key, count))]
    marked = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), key, "left")
    cold = marked.where("__hot is null").select(*rows.columns)
    return marked.where("__hot").select(*columns).unionByName(cold.join(rest, key).select(*columns))


def strings(column, at_once: int = 500):
    """The values of an Arrow column of texts, few of them at once as Python strings."""
    for at in range(0, len(column), at_once):
        yield from column.slice(at, at_once).to_pylist()


class Memo(dict):
    """A dict that computes missing values and starts anew beyond a number of entries. Long keys are not kept, so that memory stays bounded."""

    def __init__(self, compute, most: int = 500_000, longest: int = 64):
        super().__init__()
        self.compute, self.most, self.longest = compute, most, longest

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value
