"""Clock alignment: pairs by name against a search of all pairs, wall clocks, offsets, drift, and what is said when nothing correlates."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldscope.model import SAMPLES
from fieldscope.operators import pairing
from fieldscope.plans import sync

K = ["log_id"]
COLUMNS = [c.strip().split(" ")[0] for c in SAMPLES.replace("map<string,double>", "map").split(", ")]
chirp = lambda t: np.sin(2 * np.pi * t * (1 + t / 2)) + t / 2
long_chirp = lambda t: np.sin(2 * np.pi * t * (0.5 + t * 0.001)) + 0.3 * np.sin(0.7 * t)


def samples(spark, *series):
    """(log, entry, times, values) as samples of doubles, (log, entry, times, None, micros) as whole numbers."""
    parts = []
    for log, entry, t, v, *wall in series:
        d = {"log_id": log, "entry": entry, "type": "int64" if wall else "double", "seq": np.arange(len(t)), "ts": np.asarray(t, float)}
        d["v_long" if wall else "v_num"] = wall[0] if wall else np.asarray(v, float)
        parts.append(pd.DataFrame(d))
    df = spark.createDataFrame(pd.concat(parts))
    kinds = dict(c.strip().split(" ", 1) for c in SAMPLES.replace("map<string,double>", "map<string;double>").split(","))
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(kinds[c].replace(";", ",")).alias(c) for c in COLUMNS))


def signals(spark, *series):
    parts = [pd.DataFrame({"revlog_id": r, "signal": s, "seq": np.arange(len(t)), "ts": np.asarray(t, float), "value": np.asarray(v, float)}) for r, s, t, v in series]
    return spark.createDataFrame(pd.concat(parts))


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "log_id string, revlog_id string, start double")


def brute_candidates(entries, signals, most=3):
    out = []
    for key, signal, hint in signals:
        kind = signal.rsplit("/", 1)[-1].lower()
        words = pairing.PATTERNS.get(kind, (kind,))
        scored = []
        for log, entry, type_ in entries:
            name, t = entry.lower(), type_.lower()
            if log == key and (t in pairing.NUMBERS or t.startswith(("double", "float"))):
                score = 0.5 * any(w in name for w in words) + 0.4 * bool(hint and hint.strip() and hint.lower() in name) + 0.1 * any(w in name for w in pairing.MECHANISMS)
                if score > 0:
                    scored.append((-round(score, 6), entry))
        out += [(key, signal, e, -s, i) for i, (s, e) in enumerate(sorted(set(scored))[:most], 1)]
    return sorted(out)


def test_candidates_equal_a_search_of_all_pairs(spark):
    rng = random.Random(5)
    parts = ["Drive", "Arm", "Left", "Right", "Shooter", "Velocity", "Voltage", "Output", "Current", "Position", "Temp", "Custom", "x"]
    entries = [(log, "/" + "/".join(rng.sample(parts, rng.randint(1, 3))), rng.choice(["double", "float[]", "INT64", "string", "boolean"])) for log in "ab" for _ in range(60)]
    kinds = ["appliedOutput", "velocity", "busVoltage", "outputCurrent", "temperature", "position", "Custom", "none"]
    wanted = [(log, f"{d}/{k}", rng.choice([None, " ", "Left", "right", "ARM"])) for log in "abc" for d in (1, 2, 3) for k in kinds]
    got = pairing.candidates(spark.createDataFrame(entries, "log_id string, entry string, type string"), spark.createDataFrame(wanted, "log_id string, signal string, hint string"), K)
    assert sorted((r["log_id"], r["signal"], r["entry"], round(r["score"], 6), r["rank"]) for r in got.collect()) == brute_candidates(entries, wanted)


def test_no_product_on_common_words(spark):
    entries = spark.range(2000).select(F.lit("a").alias("log_id"), F.format_string("/drive/velocity/%05d", "id").alias("entry"), F.lit("double").alias("type"))
    wanted = spark.range(50).select(F.lit("a").alias("log_id"), F.format_string("%d/velocity", "id").alias("signal"), F.lit(None).cast("string").alias("hint"))
    out = pairing.candidates(entries, wanted, K)
    assert out.count() == 150 and {r["entry"] for r in out.collect()} == {f"/drive/velocity/{i:05d}" for i in range(3)}


def test_places_go_by_kind_score_and_samples(spark):
    rows = [("a", "1/temperature", "e1", 0.9, 50, 50), ("a", "1/velocity", "e2", 0.5, 20, 90), ("a", "2/velocity", "e3", 0.5, 30, 40), ("a", "1/custom", "e4", 1.0, 9, 9), ("a", "1/appliedOutput", "e5", 0.1, 9, 9), ("a", "1/position", "e6", 0.1, 9, 9)]
    out = pairing.prioritized(spark.createDataFrame(rows, "log_id string, signal string, entry string, score double, n_entry long, n_signal long"), K)
    assert [r["entry"] for r in out.orderBy("place").collect()] == ["e5", "e3", "e2", "e6", "e1"]


def test_wall_clock_is_interpolated_and_clamped(spark):
    s = samples(spark, ("a", "/sys/systemTime", [10.0, 20.0, 40.0], None, [1_000_000_000, 1_010_000_000, 1_050_000_000]), ("a", "/x", [1.0], [2.0]), ("b", "/x", [1.0], [2.0]))
    points = spark.createDataFrame([("a", 990.0), ("a", 1000.0), ("a", 1005.0), ("a", 1030.0), ("a", 2000.0), ("b", 1.0)], "log_id string, wall double")
    got = {(r["log_id"], r["wall"]): r["log_ts"] for r in sync.wall_to_log(s, points).collect()}
    assert got == {("a", 990.0): 10.0, ("a", 1000.0): 10.0, ("a", 1005.0): 15.0, ("a", 1030.0): 30.0, ("a", 2000.0): 40.0, ("b", 1.0): None}


@pytest.mark.parametrize("shift", [2.5, -7.25])
def test_offset_is_recovered(spark, shift):
    t = np.arange(0, 30, 0.02)
    s = samples(spark, ("a", "/drive/output", t, chirp(t)), ("a", "/drive/flat", t, t * 0))
    r = sync.synchronize(s, signals(spark, ("r", "1/appliedOutput", t - shift, chirp(t))), files(spark, ("a", "r", None))).collect()
    assert len(r) == 1 and abs(r[0]["offset"] - shift) < 0.005 and r[0]["method"] == "CROSS_CORRELATION" and r[0]["drift"] == 0 and r[0]["reference"] == 0
    assert r[0]["confidence"] >= 0.75 and r[0]["level"] == "MEDIUM" and [p["entry"] for p in r[0]["pairs"]][:1] == ["/drive/output"]


def test_offset_beyond_the_search_is_found_from_the_wall_clock(spark):
    t = np.arange(0, 40, 0.02)
    wall = [int((1_700_000_000 + x) * 1e6) for x in (0.0, 40.0)]
    s = samples(spark, ("a", "/drive/velocity", t, chirp(t)), ("a", "SystemTime", [0.0, 40.0], None, wall), ("b", "/drive/velocity", t, chirp(t)))
    # The other clock began 5000 s before its file, and the file three seconds (by its name two) into the log.
    rev = signals(spark, ("r", "4/velocity", t[150:] + 5000 - 3, chirp(t[150:])))
    r = {x["log_id"]: x for x in sync.synchronize(s, rev, files(spark, ("a", "r", 1_700_000_002.0), ("b", "r", None))).collect()}
    assert abs(r["a"]["offset"] + 4997) < 0.005 and r["a"]["method"] == "CROSS_CORRELATION"
    assert r["b"]["method"] == "SYSTEM_TIME_ONLY" and r["b"]["offset"] == 0 and r["b"]["level"] == "LOW"  # nothing within reach of 0


def test_without_pairs_or_clocks(spark):
    t = np.arange(0, 20, 0.05)
    s = samples(spark, ("a", "/pose", t, chirp(t)), ("a", "systemtime", [5.0], None, [1_000_000_000]), ("b", "/pose", t, chirp(t)))
    rev = signals(spark, ("r", "1/velocity", t + 2, chirp(t)))
    r = {x["log_id"]: x for x in sync.synchronize(s, rev, files(spark, ("a", "r", 1000.0), ("b", "r", None))).collect()}
    assert r["a"]["method"] == "SYSTEM_TIME_ONLY" and r["a"]["offset"] == 3.0 and r["a"]["confidence"] == 0.2 and "wall clocks" in r["a"]["explanation"]
    assert r["b"]["method"] == "FAILED" and r["b"]["offset"] is None and r["b"]["level"] == "FAILED" and r["b"]["confidence"] == 0
    assert sync.synchronize(s, rev, files(spark)).count() == 0


def test_drift_of_a_long_recording(spark):
    t = np.arange(0, 1200, 0.02)
    rev = t + 5 + 1e-4 * t  # 100 ppm
    s = samples(spark, ("a", "/drive/output", t, long_chirp(t)))
    r = sync.synchronize(s, signals(spark, ("r", "1/appliedOutput", rev, long_chirp(t))), files(spark, ("a", "r", None))).first()
    assert abs(r["drift"] + 1e5) < 1e4 and "Clock drift" in r["explanation"]
    moved = rev + r["offset"] + (rev - r["reference"]) * r["drift"] / 1e9
    assert np.abs(moved - t).max() < 0.02
    none = sync.synchronize(s, signals(spark, ("r", "1/appliedOutput", t + 5, long_chirp(t))), files(spark, ("a", "r", None))).first()
    assert abs(none["drift"]) < 100 and abs(none["offset"] + 5) < 0.005


def test_most_active_window(spark):
    t = np.arange(0, 3000, 1.0)
    v = np.where((t >= 1500) & (t < 2100), np.sin(t), 0.001 * np.sin(t)) + 1e6
    df = spark.createDataFrame(pd.DataFrame({"log_id": "a", "ts": t, "value": v}))
    short = spark.createDataFrame([("b", float(i), float(i % 3)) for i in range(30)], "log_id string, ts double, value double")
    w = {r["log_id"]: (r["begin"], r["end"]) for r in sync.active_windows(df.unionByName(short), K).collect()}
    assert abs(w["a"][0] - 1500) <= 24 and w["a"][1] - w["a"][0] == 600 and w["b"][0] <= 0 and w["b"][1] > 29


def test_a_stray_time_allocates_no_grid(spark):
    offset, r = sync.best_lag([0.0, *np.arange(1, 40, 0.02), 1e12], chirp(np.arange(0, 1952)), np.arange(0, 40, 0.02), chirp(np.arange(0, 40, 0.02)))
    assert np.isfinite(r)


def test_two_halves_give_the_drift(spark):
    rows = [(1.0, 100.0, 1.03, 400.0), (1.0, 100.0, 1.5, 130.0), (1.0, 100.0, 1.0 + 1e-10, 400.0)]
    df = spark.createDataFrame(rows, "o1 double, m1 double, o2 double, m2 double")
    d = [r[0] for r in df.select(sync.drift_of(*map(F.col, ("o1", "m1", "o2", "m2")))).collect()]
    assert abs(d[0] - 1e5) < 1e-3 and d[1] is None and d[2] == 0
