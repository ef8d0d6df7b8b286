"""Streams read in several batches, with late rows and restarts, against the batch operators."""

import random

import pytest
from pyspark.sql import functions as F

from fieldscope.operators import series
from fieldscope.streaming import events, ordered

SCHEMA = "log_id string, seq long, time timestamp, value double"


@pytest.fixture
def store(spark):
    before = spark.conf.get(ordered.STORE[0])
    ordered.rocks(spark)
    yield
    spark.conf.set(ordered.STORE[0], before)


def write(spark, rows, folder, name):
    df = spark.createDataFrame(rows, "log_id string, seq long, us long, value double").select("log_id", "seq", F.timestamp_micros("us").alias("time"), "value")
    df.coalesce(1).write.parquet(f"{folder}/{name}")


def run(spark, how, folder, at, out):
    """All files there are now, one a batch; a stream that goes on where it stopped."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    q = how(stream).writeStream.format("parquet").option("checkpointLocation", at).option("path", out).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return q


def batch(spark, rows):
    df = spark.createDataFrame([(log, seq, us / 1e6, v) for log, seq, us, v in rows], "log_id string, seq long, ts double, value double")
    return sorted((r["log_id"], round(r["begin"], 6), round(r["end"], 6), r["lowest"]) for r in series.hysteresis(df, ["log_id"], 5.0, 25.0).where("closed").collect())


def streamed(spark, out):
    return sorted((r["log_id"], round(r["b"], 6), round(r["e"], 6), r["lowest"]) for r in spark.read.parquet(out).select("log_id", (F.unix_micros("begin") / 1e6).alias("b"), (F.unix_micros("end") / 1e6).alias("e"), "lowest").collect())


def test_rows_in_any_order_give_the_events_of_the_batch(spark, tmp_path, store):
    rng = random.Random(3)
    rows = [(log, i, 1_700_000_000_000_000 + i * 500_000 + rng.randint(0, 400), rng.choice([1.0, 4.0, 10.0, 30.0, float("nan")])) for log in ("a", "b") for i in range(120)]
    arriving = sorted(rows, key=lambda r: r[2] + rng.uniform(0, 8e6))  # up to eight seconds late
    for i in range(4):
        write(spark, arriving[i * 60 : (i + 1) * 60], tmp_path / "in", f"f{i}")
    end = max(r[2] for r in rows)
    write(spark, [("z", 0, end + 60_000_000, 0.0)], tmp_path / "in", "g")  # moves the watermark past all rows
    how = lambda s: ordered.hysteresis(s, "log_id", 5.0, 25.0, "10 seconds")
    run(spark, how, tmp_path / "in", str(tmp_path / "at"), str(tmp_path / "out"))
    got = streamed(spark, str(tmp_path / "out"))
    assert got == batch(spark, rows) and len(got) > 20


def test_a_restart_goes_on_and_too_late_rows_are_left_out(spark, tmp_path, store):
    s = 1_700_000_000_000_000
    first = [("a", 0, s, 4.0), ("a", 1, s + 1_000_000, 3.0), ("a", 2, s + 30_000_000, 10.0)]
    second = [("a", 3, s + 31_000_000, 2.0), ("a", 5, s + 33_000_000, 30.0), ("a", 4, s + 32_000_000, 8.0), ("a", 9, s + 2_000_000, 40.0)]  # the last is 29 s late
    third = [("b", 0, s + 90_000_000, 50.0)]
    how = lambda x: ordered.hysteresis(x, "log_id", 5.0, 25.0, "10 seconds")
    at, out = str(tmp_path / "at"), str(tmp_path / "out")
    for name, rows in (("f0", first), ("f1", second), ("f2", third)):
        write(spark, rows, tmp_path / "in", name)
        run(spark, how, tmp_path / "in", at, out)
    kept = first + second[:3]
    assert streamed(spark, out) == batch(spark, kept) == [("a", s / 1e6, s / 1e6 + 33, 2.0)]
    assert spark.read.parquet(out).first()["event"] == 1


def test_late_rows_and_windows(spark, tmp_path):
    s = 1_700_000_000_000_000
    for name, rows in (("f0", [("a", 0, s, 1.0), ("a", 1, s + 25_000_000, 5.0)]), ("f1", [("a", 2, s + 18_000_000, 3.0), ("a", 3, s + 1_000_000, 9.0)]), ("f2", [("a", 4, s + 90_000_000, 7.0)])):
        write(spark, rows, tmp_path / "in", name)
        run(spark, lambda x: events.windowed_statistics(x, ["log_id"], "10 seconds", "10 seconds"), tmp_path / "in", str(tmp_path / "at"), str(tmp_path / "out"))
    got = {r["w"] - s // 1_000_000: (r["count"], r["mean"]) for r in spark.read.parquet(str(tmp_path / "out")).select(F.unix_seconds("window.start").alias("w"), "count", "mean").collect()}
    assert got == {0: (1, 1.0), 10: (1, 3.0), 20: (1, 5.0)}  # nine came when its window was closed
