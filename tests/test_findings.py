"""Cases of the reviewer's findings of round 3."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from fieldscope.operators import asof, stats, tools
from fieldscope.plans import sync


def test_angles_at_the_threshold_are_compared_as_the_c_library_gives_them(spark):
    angles = [(str(i), f"/Drive/{m}/Measured", 0, 0.0, round(i / 100.0 + 20 * m, 2) / 100) for i in range(400) for m in (0, 1)]
    samples = spark.createDataFrame(angles, "log_id string, entry string, seq long, ts double, a double").selectExpr("log_id", "entry", "seq", "ts", "map('angle_rad', a) AS v_struct")
    got = {(r["log_id"], r["entry"]): (r["max_off"], r["desynced"]) for r in tools.steering_sync(samples).collect()}
    want = {}
    for (log, one, _, _, a), (_, two, _, _, b) in zip(angles[::2], angles[1::2]):
        mean = math.atan2(math.sin(a) + math.sin(b), math.cos(a) + math.cos(b))
        for entry, x in ((one, a), (two, b)):
            off = abs(math.atan2(math.sin(x - mean), math.cos(x - mean)))
            want[log, entry] = off, int(off > 0.1)
    assert got == want


def test_the_rows_of_a_large_group_stay_in_their_tasks(spark):
    """Fences are taken to the rows, not the rows of a group to one task."""
    df = spark.range(0, 8000, 1, 8).select((F.col("id") % 1).alias("k"), F.when(F.col("id") % 100 == 0, F.col("id") + 1e6).otherwise(F.col("id") % 7).cast("double").alias("value"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = stats.detect_anomalies(df, ["k"], split=True).groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert sum(r["n"] for r in found) == 80 and len(found) == 8


def test_a_long_series_is_cut_without_being_told_how(spark, monkeypatch):
    """Spans of about as many rows each, however uneven the times, and the same values; short series stay whole."""
    monkeypatch.setattr(asof, "LONG", 300)
    ts = F.when(F.col("id") % 2 == 0, F.col("id") * 1e-4).otherwise(F.floor(F.col("id") / 5) * 10.0)  # half in a burst, half spread with equal times
    both = spark.range(3000).select(F.when(F.col("id") % 10 == 0, "short").otherwise("long").alias("k"), ts.cast("double").alias("ts"), F.col("id").alias("seq"), (F.col("id") * 7919 % 101).cast("double").alias("value"))
    left, right = both.where("seq % 3 = 0"), both.where("seq % 3 > 0")
    rows = lambda d: sorted(d.select("k", "seq", "other_value").toPandas().astype(object).where(lambda x: x.notna(), None).itertuples(index=False, name=None))
    for how in (asof.hold, asof.lerp, lambda *a, **k: asof.forward(*a, 3.0, **k)):
        assert rows(how(left, right, ["k"], every=asof.AUTO)) == rows(how(left, right, ["k"]))
    own, other = asof._numbered(left, right, ["k"], asof.AUTO)
    sizes = {(r["k"], r[asof.SPAN]): r["count"] for r in own.select("k", asof.SPAN).unionByName(other.select("k", asof.SPAN)).groupBy("k", asof.SPAN).count().collect()}
    assert max(n for (k, _), n in sizes.items() if k == "long") <= 60 and [s for k, s in sizes if k == "short"] == [0]


def test_spans_are_dealt_among_many_tasks(spark):
    """However few partitions the session has, none of its tasks gets a share of the rows that grows with that."""
    rows = spark.range(20000).selectExpr("'a' AS k", "CAST(id AS DOUBLE) AS ts", "id AS seq", "CAST(id % 7 AS DOUBLE) AS value")
    found = asof.lerp(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1"), ["k"], every=10.0).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in found) == 10000 and max(r["count"] for r in found) < 400


def test_pairs_of_clocks_are_dealt_among_many_tasks(spark):
    """Few bytes make much work: the pairs are not left to the one task that their size would make. One without the second side's samples is told too."""
    rows = spark.range(200 * 40).select((F.col("id") % 200).cast("string").alias("log_id"), (F.floor(F.col("id") / 200) * 0.5).alias("ts"), F.sin(F.col("id") * F.col("id")).alias("value"))
    late = rows.where("log_id <> '7' or ts < 2").withColumn("ts", F.col("ts") - 1.0)
    found = sync.correlate(rows, late, ["log_id"], rate=10.0, max_lag=30).withColumn("task", F.spark_partition_id()).collect()
    assert len({r["task"] for r in found}) > 32 and len(found) == len({r["log_id"] for r in found}) == 200
    assert all(abs(r["offset"] - 1) < 0.01 and r["correlation"] > 0.99 and r["samples"] == 196 for r in found if r["log_id"] != "7")
    assert [(r["offset"], r["correlation"], r["samples"], r["middle"]) for r in found if r["log_id"] == "7"] == [(None, 0.0, 0, None)]


def test_running_sums_correlate_as_the_pieces_do():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = (np.cumsum(rng.normal(size=rng.integers(40, 400))) + 1000 for _ in range(2))
        reach, centre = int(rng.integers(1, 500)), float(rng.uniform(-45, 45))
        lags = range(max(round((2 + centre - 5) * 10) - reach, 1 - len(b)), min(round((2 + centre - 5) * 10) + reach, len(a) - 1) + 1)
        r = []
        for lag in lags:
            x, y = a[max(lag, 0) : len(b) + lag], b[max(-lag, 0) : len(a) - lag]
            r.append(np.corrcoef(x, y)[0, 1] if len(x) >= max(30, 0.3 * min(len(a), len(b))) and x.var() * y.var() > 1e-12 else -1.0)
        offset, peak = sync.best_lag_of_grids((5.0, a), (2.0, b), 10.0, reach, centre)
        if not r:
            assert math.isnan(offset) and peak == 0
            continue
        i = int(np.argmax(r))
        assert abs(peak - r[i] * (1 if 0 < i < len(r) - 1 else 0.7)) < 1e-9 and abs(offset - 3 - lags[i] / 10) <= 0.05 + 1e-9


def test_the_rows_of_a_pair_meet_across_batches():
    d = pd.DataFrame({"k": list("aaabbc"), "n": [1, 1, 2, 2, 2, 2], "v": range(6)})
    for size in (1, 2, 3, 6):
        got = sync.together([d.iloc[i : i + size] for i in range(0, 6, size)] + [d.iloc[:0]], ["k", "n"], ["v"])
        assert [(k, v.tolist()) for k, (v,) in got] == [(("a", 1), [0, 1]), (("a", 2), [2]), (("b", 2), [3, 4]), (("c", 2), [5])]
