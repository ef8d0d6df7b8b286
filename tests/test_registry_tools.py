"""Operators by name and as table functions; mechanisms, paths and errors by entry; windows of variance; export of every kind of value."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from fieldscope import registry
from fieldscope.operators import export, series, stats, tools
from tests.test_engine import make, rows_of

K = ["log_id"]


def test_operators_are_described(spark):
    rows = {r["name"]: r for r in registry.describe(spark).collect()}
    assert len(rows) == len(registry.OPERATORS) >= 30
    assert rows["compare_entries"]["tables"] == 2 and rows["find_condition"]["tables"] == 1 and rows["find_condition"]["columns"] == ["ts", "seq", "value"]
    p = {x["name"]: x for x in rows["find_condition"]["parameters"]}
    assert p["op"]["required"] and p["op"]["type"] == "str" and p["threshold"]["type"] == "float" and not {x["name"]: x for x in rows["find_peaks"]["parameters"]}["kind"]["required"]
    assert all(r["summary"] for r in rows.values() if r["name"] not in ("power_analysis", "moving_average"))
    with pytest.raises(ValueError, match="already"):
        registry.register("hold", "x", series.cycles, ())


def test_calls_are_checked_and_equal_the_operator(spark):
    df = make(spark, [(i, float(v)) for i, v in enumerate([1, 5, 2, 8, 3])])
    assert registry.call("find_peaks", df, keys=K, kind="maximum").count() == 2
    assert registry.call("compare_entries", df, df, keys=K).first()["rmse"] == 0
    for name, tables, arguments, told in (
        ("find_peak", [df], {"keys": K}, "did you mean find_peaks"), ("nothing at all", [df], {}, "no operator"), ("compare_entries", [df], {"keys": K}, "takes 2 table"), ("find_peaks", [df.drop("seq")], {"keys": K}, "lacks seq"),
        ("find_peaks", [df], {"keys": K, "hight": 3}, "no parameter hight"), ("find_condition", [df], {"keys": K, "op": "gt"}, "needs threshold"), ("find_condition", [df], {"keys": K, "op": "gt", "threshold": "5"}, "must be float"),
        ("find_peaks", [df], {"keys": K, "limit": True}, "must be int"), ("find_peaks", [df], {"keys": "log_id"}, "must be"),
    ):
        with pytest.raises(ValueError, match=told):
            registry.call(name, *tables, **arguments)


def test_table_functions_equal_the_operators(spark):
    rng = random.Random(6)
    rows = [(log, i, i + rng.random() / 2, rng.choice([1.0, 2.0, 4.5, 10.0, 30.0, float("nan")])) for log in "abc" for i in range(60)] + [("d", 0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "log_id string, seq long, ts double, value double")
    df.createOrReplaceTempView("series_of_logs")
    registry.register_functions(spark)
    got = spark.sql("SELECT * FROM hysteresis_events(TABLE(series_of_logs) PARTITION BY log_id ORDER BY (ts, seq), 5.0, 25.0)")
    want = series.hysteresis(df, K, 5.0, 25.0)
    assert got.columns == ["log_id", "event", "begin", "end", "closed", "lowest"] and sorted(map(tuple, got.collect())) == sorted(tuple(r) for r in want.select(*got.columns).collect())
    whole = df.where("not isnan(value)")
    whole.createOrReplaceTempView("whole_series")
    cut = spark.sql("SELECT log_id, seq, segment FROM setpoint_segments(TABLE(whole_series) PARTITION BY log_id ORDER BY (ts, seq), share => 0.5)")
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, series.segments_by_setpoint(whole, K, share=0.5).select("log_id", "seq", "segment").collect()))
    assert spark.sql("SELECT name FROM operators() WHERE category = 'joins'").count() == 3
    for bad, told in (("hysteresis_events(TABLE(series_of_logs) PARTITION BY log_id ORDER BY ts, 5.0, value)", ""), ("hysteresis_events(1, 5.0, 25.0)", "first argument"), ("setpoint_segments(TABLE(SELECT 1 AS x))", "lacks value")):
        with pytest.raises(Exception, match=told):
            spark.sql(f"SELECT * FROM {bad}").collect()


def test_segments_are_those_of_a_loop(spark):
    rng = random.Random(2)
    rows = [(log, i, float(i // 2), rng.choice([None, 0.0, 1.0, 1.02, 1.2, 5.0, 5.2, -3.0])) for log in ["a", "b", None] for i in range(200)]
    df = spark.createDataFrame(rows, "log_id string, seq long, ts double, value double").repartition(7)
    got = {(r["log_id"], r["seq"]): r["segment"] for r in series.segments_by_setpoint(df, K).collect()}
    for log in ["a", "b", None]:
        last, n = None, 0
        for _, seq, _, v in (r for r in rows if r[0] == log):
            if v is not None and (last is None or abs(v - last) > max(abs(last) * 0.05, 0.01)):
                last, n = v, n + 1
            assert got[log, seq] == n
    assert series.segments_by_setpoint(df.where("false"), K).count() == 0


def test_variance_of_every_window(spark):
    rng = random.Random(4)
    rows = [(log, i, rng.randint(0, 60) / 2, 1e6 + rng.gauss(0, 1 + (i % 7))) for log in "ab" for i in range(150)] + [("c", 0, 1.0, 4.0), ("a", 999, 3.0, float("nan"))]
    df = spark.createDataFrame(rows, "log_id string, seq long, ts double, value double")
    got = {r["log_id"]: (r["begin"], r["variance"]) for r in stats.high_variance_window(df, K, 5.0).collect()}
    for log in "abc":
        own = [(ts, v) for x, _, ts, v in rows if x == log and math.isfinite(v)]
        best = max(((statistics.variance(w) if len(w) > 1 else 0.0, -t) for t in {t for t, _ in own} for w in [[v for ts, v in own if t <= ts <= t + 5.0]]))
        assert got[log][0] == -best[1] and got[log][1] == pytest.approx(best[0], rel=1e-6)


def response(sp, meas):
    """Settling times and overshoot in per cent of one mechanism, setpoint by setpoint."""
    def at(t):
        for (t0, v0), (t1, v1) in zip(meas, meas[1:]):
            if t0 <= t <= t1:
                return v0 if t == t0 else v0 + (v1 - v0) * (t - t0) / (t1 - t0)
        return meas[-1][1] if t == meas[-1][0] else None

    last = since = peak = None
    settled, over, n = [], [], 0
    for t, v in sp:
        m = at(t)
        if m is None:
            continue
        if last is None or abs(v - last) > max(abs(last * 0.05), 0.01):
            if peak is not None and abs(last) > 0.001:
                over.append(peak * 100 / abs(last))
            last, since, peak, n = v, t, 0.0, n + 1
        if since is not None and abs(m - v) <= max(abs(v * 0.05), 0.01) and t - since > 0.01:
            settled.append(t - since)
            since = None
        if abs(m - last) > abs(peak):
            peak = m - last
    return n, settled, over


def test_mechanism_response(spark):
    rng = random.Random(8)
    sp = [(i * 0.1, [0.0, 10.0, 10.2, 4.0, -6.0][i // 20]) for i in range(100)]
    meas = [(-0.05 + i * 0.07, rng.uniform(-1, 1) * (1 if i % 9 else 12) + sp[min(99, int(i * 0.7))][1]) for i in range(150)]
    n, settled, over = response(sp, meas)
    r = tools.mechanism_response(make(spark, sp), make(spark, meas), K).first()
    assert (r["segments"], r["settled"]) == (n, len(settled)) and r["avg_settling"] == pytest.approx(sum(settled) / len(settled)) and r["max_settling"] == pytest.approx(max(settled))
    assert r["overshoot_percent"] == pytest.approx(sum(over) / len(over)) and len(over) > 1
    # One step from 0 to 10 that is reached late: it settles once, and has no overshoot before another step follows.
    r = tools.mechanism_response(make(spark, [(0, 0.0)] + [(i, 10.0) for i in range(1, 6)]), make(spark, list(enumerate([0.0, 2.0, 6.0, 9.8, 9.9, 10.0]))), K).first()
    assert r["avg_settling"] == 2 and r["overshoot_percent"] is None


def test_a_mechanism_by_name(spark):
    t = range(30)
    s = rows_of(
        spark, ("/Arm/GoalAngle", "double", "v_num", [(i, 10.0 if i > 3 else 0.0) for i in t]), ("/Arm/Position", "double", "v_num", [(i, min(10.0, max(0.0, i - 4.0))) for i in t]), ("/Arm/PositionSetpoint", "double", "v_num", [(0, 1.0)]),
        ("/Arm/Velocity", "double", "v_num", [(i, 0.0) for i in t]), ("/Arm/SupplyCurrent", "double", "v_num", [(i, 40.0 if 5 <= i <= 8 else 3.0) for i in t]), ("/Elevator/Position", "double", "v_num", [(0, 5.0)]),
    )
    roles = {r["role"]: r["entry"] for r in tools.mechanism_entries(s, "arm").collect()}
    assert roles == {"setpoint": "/Arm/GoalAngle", "measurement": "/Arm/Position", "velocity": "/Arm/Velocity", "current": "/Arm/SupplyCurrent"}
    r = tools.profile_by_name(s, "ARM").first()
    assert r["n"] == 30 and r["stalls"] == 1 and r["longest_stall"] == 4 and r["peak_current"] == 40 and r["segments"] == 2 and r["max_settling"] == 10
    assert tools.profile_by_name(s, "shooter").count() == 0 and tools.profile_by_name(s, "elevator").first()["rmse"] is None


def test_a_path_by_roles(spark):
    pose = lambda f: [(i, {"x": f(i), "y": 1.0}) for i in range(30)]
    s = rows_of(
        spark, ("/DriverStation/Enabled", "boolean", "v_bool", [(0, False), (5, True), (25, False)]), ("/DriverStation/Autonomous", "boolean", "v_bool", [(0, False), (5, True), (15, False)]),
        ("/Auto/TargetPose", "struct:Pose2d", "v_struct", pose(float)), ("/Drive/EstimatedPose", "struct:Pose2d", "v_struct", pose(lambda i: i + (3.0 if i >= 10 else 4.0))), ("/Auto/Setpoint", "double", "v_num", [(1, 1.0)]),
    )
    assert {r["role"]: r["entry"] for r in tools.path_entries(s).collect()} == {"setpoint": "/Auto/TargetPose", "actual": "/Drive/EstimatedPose"}
    r = tools.follow_path(s).first()
    assert r["n"] == 11 and r["max_error"] == 4 and r["rmse"] == pytest.approx(math.sqrt((5 * 16 + 6 * 9) / 11)) and tools.path_entries(s, "/Auto").count() == 1


def test_errors_by_entry(spark):
    text = lambda *at: [(t, "CAN timeout") for t in at]
    s = rows_of(spark, ("/DriverStation/Enabled", "boolean", "v_bool", [(0, True), (10, False)]), ("/m1", "string", "v_str", [*text(1, 2, 12), (3, "fine")]), ("/m2", "string", "v_str", text(-1)), ("/m3", "string", "v_str", [(1, "ok")]))
    got = {r["entry"]: (r["total"], r["while_enabled"], r["while_disabled"]) for r in tools.can_errors_by_entry(s).collect()}
    assert got == {"/m1": (3, 2, 1), "/m2": (1, 0, 1)}
    alone = tools.can_errors_by_entry(s.where("entry = '/m1'")).first()
    assert (alone["total"], alone["while_enabled"]) == (3, None)


def test_every_kind_of_value_is_exported(spark):
    s = rows_of(spark, ("/n", "double", "v_num", [(0, 1.5)]), ("/b", "boolean", "v_bool", [(1, True)]), ("/s", "string", "v_str", [(2, 'a"b')]), ("/r", "raw", "v_raw", [(3, bytearray(b"\x01\xff"))]), ("/a", "double[]", "v_arr_num", [(4, [1.0, 2.0])]), ("/t", "string[]", "v_arr_str", [(5, ["x"])]), ("/p", "struct:Pose2d", "v_struct", [(6, {"x": 3.0})]), ("/q", "structarray:X", "v_structs", [(7, [{"v": 1.0}, {"v": 2.0}])]), ("/e", "double[]", "v_arr_num", [(8, [])]))
    got = sorted((r["timestamp"], r["index"] if r["index"] is not None else -1, r["field"] or "", r["value"]) for r in export.csv_rows(s).collect())
    assert got == [(0.0, -1, "", "1.5"), (1.0, -1, "", "true"), (2.0, -1, "", 'a"b'), (3.0, -1, "", "01ff"), (4.0, 0, "", "1.0"), (4.0, 1, "", "2.0"), (5.0, 0, "", "x"), (6.0, -1, "x", "3.0"), (7.0, 0, "v", "1.0"), (7.0, 1, "v", "2.0")]
    assert "Union" not in export.csv_rows(s)._jdf.queryExecution().optimizedPlan().toString()
