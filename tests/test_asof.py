"""As-of joins against plain Python, in spans of time, and on one long series."""

import bisect
import random
import time

import pytest
from pyspark.sql import functions as F

from fieldscope.operators import asof, stats

K = ["log_id"]
SCHEMA = "log_id string, seq long, ts double, value double"


def sides(spark, seed=3):
    rng = random.Random(seed)
    left = [(log, i, float(rng.randint(0, 400)) / 4, rng.random()) for log in "abc" for i in range(60)]
    right = [(log, i, float(rng.randint(40, 300)) / 4, rng.random()) for log in "abd" for i in range(50)]
    return spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), left, right


def of(rows, log):
    return sorted((ts, seq, v) for x, seq, ts, v in rows if x == log)


@pytest.mark.parametrize("every", [None, 7.0, 1000.0])
def test_hold_lerp_and_forward_equal_a_search(spark, every):
    a, b, left, right = sides(spark)
    held = {(r["log_id"], r["seq"]): (r["other_ts"], r["other_value"]) for r in asof.hold(a, b, K, every).collect()}
    lerped = {(r["log_id"], r["seq"]): r["other_value"] for r in asof.lerp(a, b, K, every=every).collect()}
    ends = {(r["log_id"], r["seq"]): r["other_value"] for r in asof.lerp(a, b, K, True, every).collect()}
    near = {(r["log_id"], r["seq"]): (r["other_ts"], r["other_value"]) for r in asof.forward(a, b, K, 0.3, every).collect()}
    assert len(held) == len(lerped) == len(ends) == len(near) == len(left)
    for log, seq, ts, _ in left:
        rows = of(right, log)
        i = bisect.bisect_right(rows, (ts, 10**9, 0))
        p, n = (rows[i - 1] if i else None), (rows[i] if i < len(rows) else None)
        assert held[log, seq] == ((p[0], p[2]) if p else (None, None))
        want = p[2] if p and p[0] == ts else p[2] + (n[2] - p[2]) * (ts - p[0]) / (n[0] - p[0]) if p and n else None
        assert lerped[log, seq] == (pytest.approx(want) if want is not None else None)
        clamped = want if want is not None else p[2] if p else n[2] if n else None
        assert ends[log, seq] == (pytest.approx(clamped) if clamped is not None else None)
        first = next((r for r in rows if r[0] >= ts - 0.3), None)
        assert near[log, seq] == ((first[0], first[2]) if first and abs(first[0] - ts) <= 0.3 else (None, None))


def test_spans_keep_columns_and_statistics(spark):
    a, b, _, _ = sides(spark)
    plain, cut = (sorted(map(tuple, stats.compare(a, b, K, e).select("log_id", "n", F.round("rmse", 9), F.round("max_diff", 9)).collect())) for e in (None, 5.0))
    assert plain == cut and asof.hold(a, b, K, 5.0).columns == asof.hold(a, b, K).columns
    empty = spark.createDataFrame([], SCHEMA)
    assert asof.lerp(empty, b, K, every=5.0).count() == 0
    assert {r["other_value"] for r in asof.lerp(a, empty, K, every=5.0).collect()} == {None}


def test_one_long_series_takes_time_in_proportion(spark):
    def seconds(n):
        left = spark.range(n).select(F.lit("a").alias("log_id"), F.col("id").alias("seq"), (F.col("id") / 50).alias("ts"), F.sin(F.col("id")).alias("value"))
        right = left.withColumn("ts", F.col("ts") + 0.007)
        best = 1e9
        for _ in range(3):
            began = time.perf_counter()
            asof.lerp(left, right, K).agg(F.sum("other_value")).collect()
            asof.forward(left, right, K, 0.01).agg(F.sum("other_value")).collect()
            best = min(best, time.perf_counter() - began)
        return best

    seconds(2_000)
    short, long = seconds(25_000), seconds(100_000)
    assert long < 10 and long < 6 * max(short, 0.4)


def test_percentiles_without_a_whole_group_in_a_task(spark):
    rng = random.Random(12)
    rows = [("a", rng.gauss(0, 5)) for _ in range(3000)] + [("b", float(rng.choice([1, 1, 1, 2, 7]))) for _ in range(2000)] + [("c", 4.0), ("d", 1.0), ("d", 2.0), ("e", float("nan")), ("f", None)] + [("g", float(i % 3)) for i in range(4)]
    df = spark.createDataFrame(rows, "log_id string, value double")
    plain, split = ({r["log_id"]: r for r in stats.describe(df, K, s).collect()} for s in (False, True))
    assert plain.keys() == split.keys() == set("abcdg")
    for k, r in plain.items():
        assert all(split[k][c] == pytest.approx(r[c], rel=1e-12, abs=1e-12) for c in ("count", "min", "max", "median", "q1", "q3", "p5", "p95", "mean"))
    assert stats.exact_percentiles(df, K, (0.0, 1.0), parts=2).where("log_id = 'd'").first()["p"] == [1.0, 2.0]
    assert stats.describe(df.where("false"), K, True).count() == 0
