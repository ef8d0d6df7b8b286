"""Files, seasons, signals and results, against literals and plain loops."""

import hashlib
import json
import random
import struct

import pytest

from fieldscope.operators import catalog, fleet, guide
from fieldscope.sources import dbc, revlog, season, structs


def test_fingerprints_equal_hashlib(spark):
    rng = random.Random(4)
    blobs = [b"", b"a", rng.randbytes(100), rng.randbytes(30), rng.randbytes(31)]
    df = spark.createDataFrame([(str(i), bytearray(b), len(b)) for i, b in enumerate(blobs)], "path string, content binary, length long")
    got = {r["path"]: r["fingerprint"] for r in fleet.fingerprint(df, 10).collect()}
    for i, b in enumerate(blobs):
        middle = b[len(b) // 2 - 5 : len(b) // 2 + 5] if len(b) > 30 else b""
        assert got[str(i)] == hashlib.sha256(str(len(b)).encode() + b[:10] + middle + b[max(0, len(b) - 10) :]).hexdigest()


def test_revlog_names(spark):
    df = spark.createDataFrame([("/a/REV_20240316_101112.revlog",), ("/a/REV_20240316_101112_drive.revlog",), ("/a/other.revlog",), ("/a/x.txt",)], "path string")
    rows = {r["filename"]: (r["start"], r["bus"]) for r in fleet.revlogs_from_files(df).collect()}
    assert rows == {"REV_20240316_101112": (1710583872.0, ""), "REV_20240316_101112_drive": (1710583872.0, "drive"), "other": (None, "")}


def test_overlap_equals_a_loop(spark):
    rng = random.Random(5)
    logs = [(i, b := rng.uniform(0, 5000), b + rng.uniform(0, 900)) for i in range(40)] + [(99, None, 3.0)]
    points = [(i, rng.uniform(-400, 6500)) for i in range(60)] + [(100, None)]
    got = fleet.overlapping(spark.createDataFrame(logs, "log int, begin double, end double"), spark.createDataFrame(points, "point int, start double"), 60.0)
    want = sorted((l, p) for l, b, e in logs for p, s in points if b is not None and s is not None and b - 60 <= s <= e + 60)
    assert sorted((r["log"], r["point"]) for r in got.collect()) == want


def test_season_files(spark, tmp_path):
    whole = {"season": 2031, "game_name": "X", "match_timing": {"auto_duration_sec": 15}, "field_geometry": {"field_length_m": 16.5, "field_width_m": 8.0}}
    (tmp_path / "a.json").write_text(json.dumps(whole))
    (tmp_path / "b.json").write_text(json.dumps(whole | {"season": 2030}))
    seasons = season.read(spark, str(tmp_path))
    assert season.info(seasons).first()["season"] == 2031 and season.info(seasons, 2030).count() == 1
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "d.json").write_text(json.dumps({"season": 1, "field_geometry": {"field_width_m": 1.0}}))
    with pytest.raises(ValueError, match="game_name, match_timing, field_geometry.field_length_m"):
        season.read(spark, str(tmp_path / "c"))


def test_motor_controller_files(spark, tmp_path):
    database = dbc.parse('BO_ 64 Status: 8 X\n SG_ Speed : 0|16@1- (0.5,0) [0|0] "rpm" X\n')
    chunk = struct.pack("<Ii", 1500, 64 | 3) + struct.pack("<h", -7) + bytes(6)
    (tmp_path / "REV_1.revlog").write_bytes(bytes([0, 2, 32]) + chunk * 2 + bytes([0, 2, 16]) + chunk[:5])  # the last record is cut
    rows = revlog.read_files(spark.read.format("binaryFile").load(str(tmp_path)), database).collect()
    assert [(r["log_id"], r["entry"], r["seq"], r["ts"], r["value"]) for r in rows] == [("REV_1", "3/Speed", i, 1.5, -3.5) for i in range(2)]
    assert fleet.list_signals(spark.createDataFrame(rows), "3", "SPEED").count() == 2


def test_a_user_offset_replaces_results(spark):
    syncs = spark.createDataFrame([("a", "can", 1.0, 2.0, 0.9, "HIGH", "X"), ("a", "two", 1.0, 2.0, 0.9, "HIGH", "X"), ("b", "can", 1.0, 2.0, 0.9, "HIGH", "X")], "log_id string, bus string, offset double, drift double, confidence double, level string, method string")
    hit = [tuple(r) for r in fleet.set_offset(syncs, "a", -4.0, "can").collect() if r["method"] == "USER_PROVIDED"]
    assert hit == [("a", "can", -4.0, 0.0, 0.5, "MEDIUM", "USER_PROVIDED")]
    assert sum(r["method"] == "USER_PROVIDED" for r in fleet.set_offset(syncs, "a", -4.0).collect()) == 2


def test_results_carry_warnings(spark):
    rows = fleet.with_warnings(spark.createDataFrame([(0.2,), (0.9,), (None,)], "score double")).collect()
    assert [json.loads(r["result"])["warnings"] for r in rows] == [["low data quality"], [], []]


def test_catalog_of_tools_and_structs(spark):
    tools = guide.catalog(spark)
    assert tools.count() == 45 and set(guide.HINTS) <= {r["name"] for r in tools.collect()}
    assert catalog.suggest_tools(tools, "estimate inertia and torque from current").first()["name"] == "moi_regression"
    sizes = {r["name"]: r["size"] for r in structs.listing(spark).collect()}
    assert sizes["Pose3d"] == 56 and sizes["PoseObservation"] == 88 and sizes["SwerveSample"] == 144 and sizes["TargetObservation"] == 40


def test_official_matches_are_looked_up(spark):
    logs = spark.createDataFrame([
        ("q", "2025VABLA", "Qualification", 12, 254, None, 1742479509.0), ("p", "vabla2", "Semifinal", 3, 254, 1742490000.0, 1.0), ("far", "VABLA", "Final", 1, 254, 1700000000.0, 1742479509.0), ("sim", "VABLA", "Qualification (sim)", 12, 254, None, 1742479509.0),
        ("practice", "VABLA", "Practice", 1, 254, None, 1742479509.0), ("noteam", "VABLA", "Qualification", 12, None, None, 1742479509.0), ("other", "VABLA", "Qualification", 13, 254, None, 1742479509.0), ("nothing", None, "Final", 1, 254, None, 1742479509.0),
    ], "log_id string, event string, match_type string, match_number int, team int, created double, modified double")
    kind = "year int, event string, match_key string, red array<int>, blue array<int>, red_score int, blue_score int, scheduled double, actual double, zone string, breakdown string"
    matches = spark.createDataFrame([
        (2025, "vabla", "qm12", [1, 254], [2, 3], 80, 95, 1742479200.0, 1742479500.0, "America/Los_Angeles", '{"red": {"autoPoints": 20, "x": 1, "bargePoints": "n/a"}, "blue": {"totalPoints": 95.0}, "green": {"autoPoints": 1}}'),
        (2025, "vabla", "qm13", [1], [254], -1, -1, 1742479200.0, None, None, None),
        (2025, "vabla2", "sf1m1", [254], [9], 50, 40, 1742488000.0, 1742489000.0, None, None), (2025, "vabla2", "sf2m1", [8], [254], 50, 40, 1742490500.0, 1742490600.0, None, None), (2025, "vabla2", "sf3m1", [8], [9], 1, 0, 1742490000.0, 1742490000.0, None, None),
    ], kind)
    r = {x["log_id"]: x for x in fleet.enriched(logs, matches).collect()}
    assert r.keys() == {"q", "p", "far", "other"}
    assert (r["q"]["year"], r["q"]["match_key"], r["q"]["alliance"], r["q"]["score"], r["q"]["opponent_score"], r["q"]["won"]) == (2025, "qm12", "red", 80, 95, False)
    assert (r["q"]["actual_local"], r["q"]["scheduled_local"]) == ("7:05 AM", "7:00 AM")
    assert r["far"]["match_key"] is None and r["far"]["won"] is None and r["other"]["won"] is None and r["other"]["alliance"] == "blue" and r["other"]["actual_local"] is None
    assert (r["p"]["match_key"], r["p"]["alliance"], r["p"]["won"]) == (None, None, None)  # by its time the file is of 1970
    near = fleet.enriched(logs.where("log_id = 'p'").drop("modified").selectExpr("*", "1742490000D as modified"), matches).first()
    assert (near["match_key"], near["alliance"], near["won"], near["actual_local"]) == ("sf2m1", "blue", False, "1:10 PM")
    points = {(x["alliance"], x["field"]): x["points"] for x in fleet.score_breakdown(matches).collect()}
    assert points == {("red", "autoPoints"): 20.0, ("red", "bargePoints"): None, ("blue", "totalPoints"): 95.0}
