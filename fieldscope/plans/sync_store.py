"""A table of clock alignments, keyed by the contents of both files: what is stored is not computed again.

Results are appended with the time of their writing; reading takes the last of each key, so runs that overlap or repeat do no harm. Failed
alignments are not stored: they are tried again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscope.plans import sync

#: Results of another version are not read.
VERSION = 1
PAIRS = "array<struct<entry:string,signal:string,offset:double,correlation:double,samples:int>>"
SCHEMA = f"key string, offset double, drift double, reference double, confidence double, level string, method string, pairs {PAIRS}, explanation string, version int, saved timestamp"
RESULT = [c.split()[0] for c in SCHEMA.split(", ") if c.split()[0] not in ("key", "version", "saved")]


def key(first: str | Column = "log_fingerprint", second: str | Column = "revlog_fingerprint") -> Column:
    return F.sha2(F.concat_ws(":", first, second), 256)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def load(spark: SparkSession, path: str) -> DataFrame:
    """key and the result last saved for it; no rows where nothing was stored yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], SCHEMA).drop("version", "saved")
    kept = spark.read.schema(SCHEMA).parquet(path).where(F.col("version") == VERSION)
    return kept.groupBy("key").agg(F.max_by(F.struct(*RESULT), "saved").alias("r")).select("key", "r.*")


def save(results: DataFrame, path: str) -> None:
    """Appends results (key and the columns of synchronize) that did not fail."""
    good = results.where("method <> 'FAILED'").select("key", *RESULT, F.lit(VERSION).alias("version"), F.current_timestamp().alias("saved"))
    good.write.mode("append").parquet(path)


def synchronize(samples: DataFrame, signals: DataFrame, files: DataFrame, path: str, hints: DataFrame | None = None) -> DataFrame:
    """Alignments of files (log_id, revlog_id, start, log_fingerprint, revlog_fingerprint), of which those not stored are computed and stored.

    Only the samples of logs and signals that take part in a missing alignment are read on.
    """
    spark = files.sparkSession
    keyed = files.withColumn("key", key())
    todo = keyed.join(load(spark, path).select("key"), "key", "left_anti")
    # Files of equal contents are aligned once.
    todo = todo.groupBy("key").agg(F.min(F.struct("log_id", "revlog_id", "start")).alias("r")).select("key", "r.*")
    own, other = samples.join(todo.select("log_id").distinct(), "log_id", "left_semi"), signals.join(todo.select("revlog_id").distinct(), "revlog_id", "left_semi")
    found = sync.synchronize(own, other, todo.select("log_id", "revlog_id", "start"), hints)
    save(todo.select("key", "log_id", "revlog_id").join(found, ["log_id", "revlog_id"]), path)
    out = keyed.select("key", "log_id", "revlog_id").join(load(spark, path), "key", "left").drop("key")
    return out.withColumns({"method": F.coalesce("method", F.lit("FAILED")), "level": F.coalesce("level", F.lit("FAILED")), "confidence": F.coalesce("confidence", F.lit(0.0)), "drift": F.coalesce("drift", F.lit(0.0)), "reference": F.coalesce("reference", F.lit(0.0))})
