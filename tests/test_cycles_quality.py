"""Cycles against a plain state machine, and what is told of the quality of data."""

import json
import random

import pytest
from pyspark.sql import functions as F

from fieldscope.operators import cycles, quality, stats
from tests.test_engine import rows_of

K = ["log_id"]
SCHEMA = "log_id string, seq long, ts double, value string"


def machine(rows, start, end, idle, since, until, case, limit=10):
    """The states one after the other."""
    same = lambda a, b: a is not None and b is not None and (a == b if case else a.lower() == b.lower())
    rows = sorted((ts, seq, v) for _, seq, ts, v in rows)
    last, found, spells = rows[-1][0], [], []
    ours = [(ts, v) for ts, _, v in rows if (since is None or ts >= since) and (until is None or ts <= until)]
    open_at = open_idle = was = turned = None
    rapid, unknown = 0, set()
    for ts, v in ours:
        if end is None:
            if same(v, start):
                if open_at is not None:
                    found.append((open_at, ts, ts - open_at, False))
                open_at = ts
        else:
            if same(v, start) and open_at is None:
                open_at = ts
            elif same(v, end) and open_at is not None:
                found.append((open_at, ts, ts - open_at, False))
                open_at = None
        if idle is not None:
            if same(v, idle) and not same(v, was):
                open_idle = ts
            elif not same(v, idle) and same(was, idle) and open_idle is not None:
                spells.append((open_idle, ts, ts - open_idle, False))
                open_idle = None
        if was is not None and not same(v, was):
            rapid += turned is not None and ts - turned < 0.1
            turned = ts
        if not any(same(v, x) for x in (start, end, idle)):
            unknown.add(v)
        was = v
    total = sum(s[2] for s in spells)
    if open_at is not None:
        stop = last if until is None else min(last, until)
        found.append((open_at, stop, stop - open_at, True))
    if open_idle is not None:
        spells.append((open_idle, last, last - open_idle, True))
    return found, spells, total, rapid, sorted(unknown)


@pytest.mark.parametrize("end,idle,since,until,case", [(None, "IDLE", None, None, True), ("SHOOT", "IDLE", 3.0, 17.0, True), ("shoot", "idle", None, 15.5, False), ("SHOOT", None, 6.0, None, True)])
def test_cycles_equal_a_state_machine(spark, end, idle, since, until, case):
    rng = random.Random(11)
    rows = [(log, i, round(rng.uniform(0, 20), 2), rng.choice(["INTAKE", "SHOOT", "IDLE", "idle", "Shoot", "JAM"])) for log in "abcd" for i in range(80)]
    rows += [("e", 0, 1.0, "JAM"), ("f", 0, 2.0, "INTAKE")]
    df = spark.createDataFrame(rows, SCHEMA)
    start = "INTAKE" if case else "intake"
    got = {r["log_id"]: r for r in cycles.analyze(df, K, start, end, idle, since, until, case, limit=200).collect()}
    assert got.keys() == set("abcdef")
    for log, r in got.items():
        found, spells, total, rapid, unknown = machine([x for x in rows if x[0] == log], start, end, idle, since, until, case)
        assert [tuple(c) for c in r["first_cycles"]] == [pytest.approx(x) for x in found]
        assert [tuple(c) for c in r["first_idle_spells"]] == [pytest.approx(x) for x in spells]
        whole = [x[2] for x in found if not x[3]]
        assert (r["cycles"], r["incomplete"], r["rapid"], r["unknown_states"]) == (len(whole), len(found) - len(whole), rapid, unknown)
        assert r["avg_seconds"] == (pytest.approx(sum(whole) / len(whole)) if whole else None) and r["max_seconds"] == (max(whole) if whole else None)
        assert r["idle_seconds"] == pytest.approx(total) and r["avg_idle_seconds"] == (pytest.approx(sum(s[2] for s in spells) / len(spells)) if spells else None)
        assert any("unfinished" in w for w in r["warnings"]) == (len(found) > len(whole)) and r["data_quality"]["n"] == sum(x[0] == log for x in rows)


def test_cycle_lists_are_limited_and_warned(spark):
    rows = [("a", i, i * 0.01, "ABCDEFGH"[i % 8]) for i in range(200)]
    r = cycles.analyze(spark.createDataFrame(rows, SCHEMA), K, "A", limit=3).first()
    assert r["cycles"] == 24 and len(r["first_cycles"]) == 3 and r["first_cycles"][0]["begin"] == 0
    assert any("198 state transitions" in w for w in r["warnings"]) and any("7 unknown states" in w for w in r["warnings"]) and r["directives"]["confidence_level"] == "high"
    assert cycles.analyze(spark.createDataFrame([], SCHEMA), K, "A", "B", "C").count() == 0


def test_quality_is_told(spark):
    num = [(i * 0.02, float("nan") if i == 3 else float(i)) for i in range(60)] + [(3.0 + i * 0.02, 1.0) for i in range(5)]
    s = rows_of(spark, ("/a", "double", "v_num", num), ("/b", "double", "v_num", [(i * 0.02, 1.0) for i in range(600)]), ("/c", "boolean", "v_bool", [(0, True)]))
    q = {r["entry"]: r for r in quality.directives(quality.measure(s.select("log_id", "entry", "ts", "seq", F.coalesce("v_num", F.col("v_bool").cast("double")).alias("value")), ["log_id", "entry"]), "compare_entries").collect()}
    assert q["/b"]["score"] == pytest.approx(1) and q["/b"]["confidence"] == "high" and q["/b"]["warnings"] == [] and q["/b"]["guidance"] == [quality.ONE_LOG, *quality.NOTES["compare_entries"][0]]
    told = " | ".join(q["/a"]["guidance"])
    assert all(x in told for x in ("Few samples (65)", "1 values are not finite", "short time")) and "gaps" not in told and q["/a"]["sample_context"] == "65 samples over 3.1 seconds"
    assert q["/c"]["score"] == 0.4 and q["/c"]["warnings"] == ["Low data quality (score 0.40): treat the results as preliminary"]
    # The worst of the channels that were touched stands for the log.
    both = quality.of_channels(s, F.col("entry").isin("/a", "/b")).first()
    assert both["n"] == 65 and both["score"] == q["/a"]["score"] and quality.of_channels(s, F.col("entry") == "/b").first()["score"] == pytest.approx(1)
    out = quality.attach(spark.createDataFrame([("a", 1.5), ("zz", 2.5)], "log_id string, rmse double"), quality.of_channels(s, F.lit(True)), K, "compare_entries")
    r = {x["log_id"]: x for x in out.collect()}
    assert r["a"]["data_quality"]["score"] == 0.4 and r["a"]["directives"]["followup"] == list(quality.NOTES["compare_entries"][1])
    assert r["zz"]["data_quality"] is None and r["zz"]["warnings"] == ["No data was measured for this result"]
    assert json.loads(quality.as_json(out.where("log_id = 'a'")).first()["result"])["data_quality"]["n"] == 1


def test_many_gaps_are_told(spark):
    points = [(t, 1.0) for i in range(30) for t in (i * 10, i * 10 + 0.02, i * 10 + 0.04, i * 10 + 0.06)]
    df = spark.createDataFrame([("a", i, float(t), v) for i, (t, v) in enumerate(points)], "log_id string, seq long, ts double, value double")
    r = quality.directives(quality.measure(df, K)).first()
    assert r["gaps"] == 29 and any("29 gaps (the longest 9940.0 ms)" in g for g in r["guidance"]) and r["confidence"] in ("low", "medium")
    assert stats.data_quality(df, K).first()["span"] == pytest.approx(290.06)
