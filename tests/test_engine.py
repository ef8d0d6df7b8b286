import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldscope.operators import asof, catalog, series, stats, tools
from fieldscope.plans import sync
from fieldscope.sources import dbc, revlog, structs, wpilog

K = ["log_id"]


def make(spark, points, log="a"):
    return spark.createDataFrame([(log, i, float(t), v) for i, (t, v) in enumerate(points)], "log_id string, seq long, ts double, value double")


def test_statistics_of_literals(spark):
    r = stats.describe(make(spark, list(enumerate([1.0, 2.0, 3.0, 4.0, 5.0]))), K).first()
    assert (r["count"], r["mean"], r["median"]) == (5, 3, 3) and abs(r["std_dev"] - 1.581) < 1e-3
    assert stats.describe(make(spark, [(0, 7.0)]), K).first()["std_dev"] == 0.0


def test_one_anomaly(spark):
    assert [r["value"] for r in stats.detect_anomalies(make(spark, list(enumerate([*map(float, range(1, 11)), 20.0]))), K).collect()] == [20.0]


def test_rmse(spark):
    r = stats.compare(make(spark, [(0, 10.0), (1, 10.0), (2, 10.0)]), make(spark, [(0, 9.0), (1, 11.0), (2, 10.0)]), K).first()
    assert abs(r["rmse"] - 0.816) < 1e-3 and r["max_diff"] == 1


def test_p_value(spark):
    df = spark.createDataFrame([(0.5, 30), (0.5, 2), (0.5, 10), (1.0, 20)], "r double, n long")
    p = [x[0] for x in df.select(stats.p_value(F.col("r"), F.col("n"))).collect()]
    assert abs(p[0] - 0.005) < 0.003 and p[1] == 1 and p[2] is None and p[3] == 0
    # Two-sided values of Student's t, from tables.
    df = spark.createDataFrame([(0.3961, 25), (0.5052, 25), (0.1946, 102)], "r double, n long")
    p = [x[0] for x in df.select(stats.p_value(F.col("r"), F.col("n"))).collect()]
    assert all(abs(x - y) < 2e-4 for x, y in zip(p, (0.05, 0.01, 0.05), strict=True))


def test_correlation_of_a_constant_is_null(spark):
    r = stats.time_correlate(make(spark, [(0, 1.0), (1, 2.0)]), make(spark, [(0, 5.0), (1, 5.0)]), K).first()
    assert r["r"] is None and r["p_value"] == 1


def test_hysteresis_equals_a_loop(spark):
    rng = random.Random(3)
    points = [(i, rng.uniform(0, 30)) for i in range(400)]
    begin, want = None, []
    for t, v in points:
        if begin is None and v < 5:
            begin = t
        elif begin is not None and v >= 25:
            want.append((begin, t))
            begin = None
    got = series.hysteresis(make(spark, points), K, 5, 25).where("closed").orderBy("begin").collect()
    assert [(r["begin"], r["end"]) for r in got] == want


def test_asof_equals_brute_force(spark):
    rng = random.Random(5)
    left, right = ([(t, rng.random()) for t in sorted(rng.choices(range(60), k=40))] for _ in range(2))
    hold = {r["seq"]: r["other_value"] for r in asof.hold(make(spark, left), make(spark, right), K).collect()}
    lerp = {r["seq"]: r["other_value"] for r in asof.lerp(make(spark, left), make(spark, right), K).collect()}
    for i, (t, _) in enumerate(left):
        before, after = [p for p in right if p[0] <= t], [p for p in right if p[0] > t]
        assert hold[i] == (before[-1][1] if before else None)
        want = None if not before else before[-1][1] if before[-1][0] == t else None if not after else before[-1][1] + (after[0][1] - before[-1][1]) * (t - before[-1][0]) / (after[0][0] - before[-1][0])
        assert (lerp[i] is None) == (want is None) and (want is None or abs(lerp[i] - want) < 1e-9)


def test_cycles(spark):
    df = spark.createDataFrame([("a", i, float(t), v) for i, (t, v) in enumerate([(1, "INTAKE"), (2, "SHOOT"), (5, "INTAKE"), (6, "SHOOT"), (10, "INTAKE")])], "log_id string, seq long, ts double, value string")
    got = series.cycles(df, K, "INTAKE", "SHOOT").collect()
    assert sum(r["end"] is not None for r in got) == 2 and sum(r["end"] is None for r in got) == 1


def test_stall(spark):
    both = spark.createDataFrame([("a", i, float(i), c, v) for i, (v, c) in enumerate(zip([0.1, 0.005, 0.005, 0.005, 0.005, 0.1], [5.0, 35.0, 40.0, 35.0, 35.0, 5.0], strict=True))], "log_id string, seq long, ts double, value double, v double")
    runs = series.islands(both, K, (F.col("v") < 0.01) & (F.col("value") > 30)).collect()
    assert [(r["begin"], r["end"], r["peak"]) for r in runs] == [(1.0, 5.0, 40.0)]


def test_settling(spark):
    sp, pos = make(spark, [(0, 0.0), *((t, 10.0) for t in range(1, 6))]), make(spark, list(enumerate([0.0, 2.0, 6.0, 9.8, 9.9, 10.0])))
    seg = tools.profile_mechanism(sp, pos, K)["segments"].where("target = 10").first()
    assert 1 <= seg["settling"] <= 3 and seg["overshoot"] == 0


def log_bytes():
    d = lambda x: struct.pack("<d", x)
    return wpilog.write([
        ("/DriverStation/Enabled", "boolean", [(0, b"\1"), (150_000_000, b"\0")]),
        ("/DriverStation/Autonomous", "boolean", [(0, b"\1"), (15_000_000, b"\0")]),
        ("/Robot/BatteryVoltage", "double", [(i * 1_000_000, d(6.0 if i in (3, 4) else 12.0)) for i in range(10)]),
        ("/n", "int64", [(5, struct.pack("<q", 7))]), ("/s", "string", [(6, b"CAN timeout")]), ("/a", "double[]", [(7, d(1) + d(2))]),
        ("/pose", "struct:Pose2d", [(8, struct.pack("<3d", 1, 2, math.pi))]), ("/u", "struct:Nope", [(9, b"\xab")]),
    ])


def test_wpilog_round_trip_and_tools(spark, tmp_path):
    (tmp_path / "m_Q1.wpilog").write_bytes(log_bytes())
    spark.dataSource.register(wpilog.Wpilog)
    s = spark.read.format("wpilog").load(str(tmp_path)).cache()
    by = {r["entry"]: r for r in s.collect()}
    assert by["/n"]["v_long"] == 7 and by["/s"]["v_str"] == "CAN timeout" and by["/a"]["v_arr_num"] == [1, 2] and by["/u"]["v_str"] == "ab"
    assert abs(by["/pose"]["v_struct"]["rotation_deg"] - 180) < 1e-9
    listed = wpilog.read_files(spark.read.format("binaryFile").load(str(tmp_path)))
    assert sorted(map(str, listed.collect())) == sorted(map(str, s.collect()))
    p = tools.match_phases(s).first()
    assert (p["auto_start"], p["teleop_start"], p["teleop_end"]) == (0, 15, 150)
    assert tools.power_analysis(s).first()["risk"] == "HIGH" and tools.can_health(s).first()["assessment"] == "CONCERNING"
    assert tools.battery_health(s).first()["brownouts"] == 1
    assert {r["event"] for r in tools.ds_timeline(s).collect()} >= {"ENABLED", "DISABLED", "AUTO_START", "TELEOP_START", "BROWNOUT_START", "BROWNOUT_END"}
    assert tools.report(s).first()["brownout_risk"] == "HIGH"
    assert catalog.logs_from_files(spark.read.format("binaryFile").load(str(tmp_path)).drop("content")).first()["match_number"] == 1


def rows_of(spark, *entries):
    """Samples of entries (name, type, column, [(ts, value)])."""
    from fieldscope.model import SAMPLES

    names = [c.strip().split(" ")[0] for c in SAMPLES.replace("map<string,double>", "map").split(", ")]
    out = []
    for name, kind, column, points in entries:
        for i, (t, v) in enumerate(points):
            row = {"log_id": "a", "entry": name, "type": kind, "seq": i, "ts_us": int(t * 1e6), "ts": float(t), column: v}
            out.append(tuple(row.get(c) for c in names))
    return spark.createDataFrame(out, SAMPLES)


def test_battery_score_of_literals(spark):
    volts = [(0, 12.0), (1, 12.0), (1.1, 6.0), (1.9, 11.8), (3, 12.0), (4, 8.5), (4.2, 12.0), (9, 12.0)]
    battery, current = ("/BatteryVoltage", "double", "v_num", volts), ("/PDH/TotalCurrent", "double", "v_num", [(0, 1.0)])
    r = tools.battery_health(rows_of(spark, battery, current)).first()
    mean, recovery = sum(v for _, v in volts) / 8, (0.8 + 0.2) / 2
    assert r["brownouts"] == 1 and r["warnings"] == 2 and abs(r["recovery"] - recovery) < 1e-9
    want = 100 - int((0.88 - mean / 12.6) * 150 if mean / 12.6 < 0.88 else 0) - 20 - 5 - int((10 - 6.0) * 10)
    assert r["score"] == want and r["risk"] == "CRITICAL"
    assert tools.battery_health(rows_of(spark, battery)).first()["recovery"] is None


def test_wheel_slip_of_literals(spark):
    state = lambda *v: [(t, {"speed_mps": x}) for t, x in v]
    s = rows_of(spark, ("/M0/Setpoint", "struct:S", "v_struct", state((0, 1.0), (2, 3.0))), ("/M0/Measured", "struct:S", "v_struct", state((0, 0.9), (1, 1.0), (2, -3.0), (3, 9.0))))
    r = tools.wheel_slip(s, 0.5).first()  # setpoints there: 1, 2, 3, none
    assert (r["n"], r["events"]) == (3, 1) and abs(r["max_slip"] - 0.5) < 1e-9 and abs(r["avg_slip"] - 0.2) < 1e-9


def test_auto_ends_where_the_flag_drops(spark):
    on = ("/DriverStation/Enabled", "boolean", "v_bool", [(0, False), (5, True), (20, False), (25, True)])
    flag = ("/DriverStation/Autonomous", "boolean", "v_bool", [(1, True), (18, False)])
    path = [("/s", "double", "v_num", [(t, float(t)) for t in range(30)]), ("/a", "double", "v_num", [(t, float(t) - (50 if t > 18 else 1)) for t in range(30)])]
    s = rows_of(spark, on, flag, *path)
    w = tools.auto_window(s).first()
    assert (w["auto_start"], w["auto_end"]) == (5, 18) and tools.analyze_auto(s, "/s", "/a").first()["max_error"] == 1
    assert tools.match_phases(s).first()["teleop_start"] == 25


def test_replayed_values_are_compared_whole(spark):
    big = 2**53
    s = rows_of(spark, ("RealOutputs/x", "int64", "v_long", [(0, big), (1, big + 1), (2, 5)]), ("ReplayOutputs/x", "int64", "v_long", [(0, big), (1, big), (2, 6)]))
    r = tools.replay_drift(s).first()
    assert (r["compared"], r["differing"], r["first_ts"]) == (3, 2, 1) and f"{big + 1}" in r["first_real"] and f"{big}" in r["first_replayed"]


def test_torque_has_the_sign_of_volts_or_current(spark):
    t = [i / 10 for i in range(40)]
    omega, alpha = [2 * x * x - x**3 / 3 for x in t], [4 * x - x * x for x in t]
    amps = [0.3 * a + 0.1 * w for a, w in zip(alpha, omega, strict=True)]
    side = lambda v: make(spark, list(zip(t, v, strict=False)))
    raw = tools.moi_regression(side(omega), side(amps), K, 2.0, 1.0, 1, 0.2, 0).first()
    assert abs(raw["inertia"] - 0.6) < 0.02 and abs(raw["damping"] - 0.2) < 0.02
    signed = tools.moi_regression(side(omega), side([abs(a) for a in amps]), K, 2.0, 1.0, 1, 0.2, 0, volts=side([1.0 if a >= 0 else -1.0 for a in amps])).first()
    assert abs(signed["inertia"] - raw["inertia"]) < 1e-9
    assert tools.moi_regression(side(omega[:9]), side(amps), K, 2.0, 1.0, 1, 0.2, 0).count() == 0


def test_report_of_literals(spark):
    text = ("/Log", "string", "v_str", [(i, x) for i, x in enumerate(["ok", "Error " + "x" * 200, "EXCEPTION", "a fault", "fine", "error 4", "error 5", "error 6"])])
    code = ("/Meta/GitSHA", "string", "v_str", [(0, "abc"), (1, "def")])
    r = tools.report(rows_of(spark, text, code, ("/n", "double", "v_num", [(0, 1.0)]))).first()
    assert r["errors"] == 6 and len(r["error_samples"]) == 5 and r["error_samples"][0] == "Error " + "x" * 94 + "..." and r["git_sha"] == "abc"
    assert [(t["type"], t["n"]) for t in r["top_types"]] == [("string", 2), ("double", 1)] and r["brownout_risk"] is None


def test_confidence_of_agreeing_pairs(spark):
    pairs = spark.createDataFrame([("a", 1.0, 0.9), ("a", 1.01, 0.8), ("a", 0.99, 0.7), ("a", 9.0, 0.1), ("b", 2.0, 0.9)], "log_id string, offset double, correlation double")
    r = {x["log_id"]: x for x in sync.consensus(pairs, K).collect()}
    assert r["a"]["offset"] == 1.0 and abs(r["a"]["confidence"] - (0.32 + 0.3 + 0.3 * (1 - 0.01 / 0.05))) < 1e-6
    assert abs(r["b"]["confidence"] - (0.36 + 0.1 + 0.3)) < 1e-9 and r["b"]["level"] == "MEDIUM"


def test_damaged_tail_keeps_what_came_before():
    data = log_bytes()
    whole, cut = list(wpilog.samples("x", data)), list(wpilog.samples("x", data[:-5]))
    assert cut == whole[: len(cut)] and len(cut) == len(whole) - 1
    with pytest.raises(ValueError):
        list(wpilog.records(b"nope"))


def test_a_bad_payload_in_the_middle_costs_its_record_alone():
    good = [(i * 1_000_000, struct.pack("<q", i)) for i in range(160)]
    bad = [*good[:1], (1_000_000, b"\1\2\3\4"), *good[2:]]
    rows = [("/d", "double", [(i * 1_000_000, struct.pack("<d", i)) for i in range(160)]), ("/e", "boolean", [(80_000_000, b"")])]
    plain, got = (list(wpilog.samples("x", wpilog.write([("/n", "int64", n), *rows]))) for n in (good, bad))
    at = {c: i for i, c in enumerate(wpilog.COLUMNS)}
    assert len(plain) == 320 and got == [r for r in plain if (r[at["entry"]], r[at["ts_us"]]) != ("/n", 1_000_000)]


def test_structs():
    assert structs.decode("Pose2d", b"short") is None and len(structs.LAYOUTS) == 16
    assert len(structs.decode_array("SwerveModuleState", struct.pack("<4d", 1, 2, 3, 4))) == 2
    assert struct.calcsize(structs.LAYOUTS["PoseObservation"][0]) == 88 and struct.calcsize(structs.LAYOUTS["SwerveSample"][0]) == 144


def test_dbc_bits_equal_a_loop():
    rng = random.Random(1)
    for _ in range(300):
        frame, length = bytes(rng.randrange(256) for _ in range(8)), rng.randint(1, 32)
        start = rng.randint(0, 64 - length)
        bits = [frame[i // 8] >> i % 8 & 1 for i in range(64)]
        want = sum(b << i for i, b in enumerate(bits[start : start + length]))
        assert dbc.decode(dbc.Signal(0, "s", start, length, True, False, 1, 0, ""), frame) == want
    s = dbc.parse('VERSION ""\nBO_ 33882112 M: 8 X\n SG_ out : 0|16@1- (0.5,1) [0|1] "V" X\n SG_ big : 7|16@0+ (1,0) [0|1] "" X\n')
    assert dbc.decode(s[0], b"\xfe\xff" + bytes(6)) == 0 and dbc.decode(s[1], b"\x01\x02" + bytes(6)) == 258
    chunk = struct.pack("<Ii", 2000, 33882112 + 5) + b"\xfe\xff" + bytes(6)
    assert list(revlog.signals(bytes([4, 2, 16, 0]) + chunk, s))[0] == ("5/out", 2.0, 0.0)


def test_clock_offset_is_recovered():
    t = np.arange(0, 20, 0.01)
    chirp = lambda x: np.sin(2 * np.pi * x * (1 + x / 20)) + x / 2
    offset, r = sync.best_lag(t, chirp(t), t[:-300] + 5, chirp(t[300:]))
    assert abs(offset - (-2.0)) < 0.005 and r > 0.99


def test_streamed_hysteresis_equals_batch(spark, tmp_path):
    from fieldscope.streaming import events

    points = [(i, v) for i, v in enumerate([10.0, 4.0, 6.0, 30.0, 3.0, 26.0])]
    make(spark, points).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("log_id string, seq long, ts double, value double").parquet(str(tmp_path / "in"))
    q = events.hysteresis(stream, "log_id", 5, 25).writeStream.format("memory").queryName("hyst").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["begin"], r["end"]) for r in spark.table("hyst").orderBy("begin").collect()] == [(1, 3), (4, 5)]


def test_a_short_start_record_is_skipped():
    whole = wpilog.write([("/a", "double", [(1_000_000, struct.pack("<d", 2.5))])])
    short = bytes([0b01111111]) + (0).to_bytes(4, "little") + (3).to_bytes(4, "little") + (0).to_bytes(8, "little") + b"\0\1\0"
    assert list(wpilog.samples("x", whole[:12] + short + whole[12:])) == [(*r[:3], r[3] + 1, *r[4:]) for r in wpilog.samples("x", whole)]
