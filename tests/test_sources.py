"""Files written here and read back: both flavours of motor-controller logs, cut and damaged logs, heads of logs, stored alignments."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldscope.operators import catalog, fleet
from fieldscope.plans import sync_store
from fieldscope.sources import dbc, revlog, wpilog
from tests.test_sync import chirp, samples, signals

DOUBLE = struct.Struct("<d").pack


def native(*records):
    out = b""
    for entry, payload in records:
        wide = len(payload) > 255
        out += bytes([4 if wide else 0, entry]) + len(payload).to_bytes(2 if wide else 1, "little") + payload
    return out


def firmware(can, major, minor, build):
    return struct.pack("<iBB", can, major, minor) + struct.pack(">H", build) + bytes(2)


def status(ms, can, data):
    return struct.pack("<Ii", ms, can) + data.ljust(8, b"\0")


def can_id(kind, index, device):
    return kind << 24 | index << 6 | device


STATUS_1 = struct.pack("<iB", -1500, 41) + (1234 | 160 << 12).to_bytes(3, "little")


def files_of(spark, folder, **contents):
    for name, data in contents.items():
        (folder / name.replace("__", ".")).write_bytes(data)
    return spark.read.format("binaryFile").load(str(folder))


def test_native_and_wpilog_flavours_give_the_same(spark, tmp_path):
    first = native((1, firmware(can_id(2, 0, 5), 24, 0, 300) + firmware(can_id(7, 0, 9), 1, 1, 1)), (9, b"other"), (2, status(1500, can_id(2, 1, 5), STATUS_1) + status(1600, can_id(2, 0, 5), struct.pack("<h", -5000))))
    logged = wpilog.write([("CAN/5", "raw", [(0, b"fw")]), ("NT/CAN/5/Periodic Status 1", "raw", [(1_500_000, STATUS_1), (1_550_000, b"short")]), ("CAN/5/Periodic Status 0", "raw", [(1_600_000, struct.pack("<h", -5000).ljust(8, b"\0") + b"more")]), ("/other", "double", [(1, DOUBLE(1.0))])])
    files = files_of(spark, tmp_path, REV_20260320_143052__revlog=first, REV_20260320_143053_can2__revlog=logged)
    rows = revlog.read_frames(files)
    got = {}
    for r in revlog.read_signals(rows).collect():
        got.setdefault(r["log_id"], {})[r["signal"]] = (r["ts"], round(r["value"], 9), r["unit"])
    one, two = got["REV_20260320_143052"], got["REV_20260320_143053_can2"]
    assert one == two and one["SparkMax_5/Velocity"] == (1.5, -1500.0, "rpm") and one["SparkMax_5/AppliedOutput"] == (1.6, -0.5, "duty_cycle")
    assert one["SparkMax_5/Temperature"] == (1.5, 41.0, "degC") and one["SparkMax_5/BusVoltage"] == (1.5, 12.34, "V") and one["SparkMax_5/OutputCurrent"] == (1.5, 10.0, "A")
    devices = {(r["log_id"][-1], r["device"]): (r["type"], r["can_id"], r["firmware"], r["frames"]) for r in revlog.devices(rows).collect()}
    assert {k: v for k, v in devices.items() if k[1] != "SparkMax_5"} == {("2", "MaxsplineEncoder_9"): ("MAXSpline Encoder", 9, None, 0)}
    both = revlog.devices(rows).where("device = 'SparkMax_5'").orderBy("log_id").collect()
    assert [(r["firmware"], r["frames"]) for r in both] == [("24.0.300", 2), (None, 2)]
    names = {r["filename"]: (r["bus"], r["start"]) for r in fleet.revlogs_from_files(files).collect()}
    assert names["REV_20260320_143053_can2"][0] == "can2" and names["REV_20260320_143053_can2"][1] - names["REV_20260320_143052"][1] == 1


def test_odd_motor_controller_files(spark, tmp_path):
    cut = native((2, status(1000, can_id(12, 1, 3), bytes(8)))) + bytes([0, 2, 200]) + bytes(7)
    negative = wpilog.write([("CAN/1/Periodic Status 1", "raw", [(1_000_000, STATUS_1)])])
    negative += bytes([0b01111111]) + (1).to_bytes(4, "little") + (8).to_bytes(4, "little") + (1 << 63).to_bytes(8, "little") + STATUS_1
    files = files_of(spark, tmp_path, a__revlog=b"", b__revlog=b"WPILOG", c__revlog=cut, d__revlog=negative)
    rows = revlog.read_frames(files)
    assert {(r["log_id"], r["ts"]) for r in rows.collect()} == {("c", 1.0), ("d", 1.0)}
    assert [(r["device"], r["type"]) for r in revlog.devices(rows).where("log_id = 'c'").collect()] == [("ServoHub_3", "Servo Hub")]
    assert {r["log_id"] for r in revlog.read_signals(rows).collect()} == {"d"}
    assert revlog.read_signals(rows, []).count() == 0


def test_frames_decode_as_one_by_one(spark):
    rng = random.Random(8)
    database, frames = [], []
    for m in range(6):
        for i in range(5):
            length = rng.choice([1, 3, 8, 12, 16, 32, 40, 63, 64])
            start = rng.randint(0, 64 - length)
            little = rng.random() < 0.6
            if not little:  # the highest bit of a signal that fits
                first = rng.randint(0, 64 - length)
                start = first // 8 * 8 + 7 - first % 8
            database.append(dbc.Signal(can_id(3, m, 0), f"s{i}", start, length, little, rng.random() < 0.5, rng.choice([1.0, 0.25, -2.0]), rng.choice([0.0, 3.5]), "u"))
    for i in range(60):
        data = rng.randbytes(8)
        frames.append((i, can_id(3, rng.randint(0, 7), rng.choice([0, 7])), *struct.unpack("<q", data), *struct.unpack(">q", data), data))
    df = spark.createDataFrame([f[:4] for f in frames], "id int, can int, le long, be long")
    got = {(r["id"], r["signal"]): r["value"] for r in dbc.decode_frames(df, database).collect()}
    want = {(i, s.name): dbc.decode(s, data) for i, can, _, _, data in frames for s in dbc.lookup(database, can)}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)


def test_databases():
    text = 'VERSION "2.1"\n// BO_ 1 x: 8 y\nBO_ 0x40 A: 8 X\n SG_ a : 0|8@1+ (1,0) [0|1] "V" X\nCM_ SG_ 64 a "text";\nBO_ 64 B: 8 X\n SG_ b m2 : 0|8@1+ (1,0) [0|1] "" X\n'
    assert [(s.message, s.name) for s in dbc.parse(text)] == [(64, "b")] and dbc.version(text) == "2.1" and dbc.version("") == ""
    own = dbc.parse(dbc.CONTROLLERS)
    assert len(own) == 23 and len({s.message for s in own}) == 8 and {s.message & dbc.DEVICE for s in own} == {0}


def test_cut_and_damaged_logs_are_told(spark, tmp_path):
    whole = wpilog.write([("/a", "double", [(i * 1_000_000, DOUBLE(i)) for i in range(5)]), ("/s", "string", [(9_500_000, b"x")])])
    bad = wpilog.write([("/a", "double", [(1_000_000, b"123"), (2_000_000, DOUBLE(2.0))])])
    unknown = wpilog.write([("/a", "double", [(1_000_000, DOUBLE(1.0))])]).replace(bytes([0b01111111]) + (1).to_bytes(4, "little"), bytes([0b01111111]) + (7).to_bytes(4, "little"))
    files = files_of(spark, tmp_path, whole__wpilog=whole, cut__wpilog=whole[:-4], bad__wpilog=bad, unknown__wpilog=unknown, none__wpilog=b"hello", head__wpilog=whole[:12])
    r = {x["log_id"]: x for x in wpilog.states(files).collect()}
    assert (r["whole"]["truncated"], r["whole"]["records"], r["whole"]["samples"], r["whole"]["skipped"], r["whole"]["entries"], r["whole"]["message"]) == (False, 8, 6, 0, 2, None)
    assert r["cut"]["truncated"] and r["cut"]["samples"] == 5 and r["cut"]["max_ts"] == 4.0 and "4.00 s" in r["cut"]["message"]
    assert (r["bad"]["truncated"], r["bad"]["skipped"], r["bad"]["samples"]) == (False, 1, 1) and "1 records" in r["bad"]["message"]
    assert r["unknown"]["skipped"] == 1 and not r["none"]["readable"] and r["head"]["readable"] and r["head"]["records"] == 0
    # The states agree with the samples that the reader gives.
    counts = {x["log_id"]: x["count"] for x in wpilog.read_files(files.where("path not like '%none%'")).groupBy("log_id").count().collect()}
    assert counts == {k: x["samples"] for k, x in r.items() if x["samples"]}


@pytest.fixture
def headed(tmp_path):
    number = struct.Struct("<q").pack
    told = [("NT:/FMSInfo/EventName", "string", [(1, b""), (2, b"VAALE")]), ("NT:/FMSInfo/MatchType", "int64", [(3, number(0)), (4, number(2))]), ("NT:/FMSInfo/MatchNumber", "int64", [(5, number(0)), (6, number(12))]), ("NT:/FMSInfo/StationNumber", "int64", [(7, number(2)), (8, number(2363))])]
    rest = [("/x", "double", [(i, DOUBLE(i)) for i in range(10, 3000)])]
    late = [("/FMSInfo/EventName", "string", [(5000, b"LATE")])]
    (tmp_path / "akit_25-03-21_14-05-09_vabla_qm7_sim.wpilog").write_bytes(wpilog.write(rest + late))
    (tmp_path / "frc_25-03-20_14-05-09_vabla_q42.wpilog").write_bytes(wpilog.write(told + rest))
    (tmp_path / "free name.wpilog").write_bytes(wpilog.write([("matchtype", "string", [(1, b"Semi-final")]), ("teamnumber", "int64", [(1, number(9))])]))
    (tmp_path / "frc_25-03-22_14-05-09_vabla.wpilog").write_bytes(b"damaged")
    return tmp_path


@pytest.mark.parametrize("content", [True, False])
def test_metadata_from_heads_and_names(spark, headed, content):
    files = spark.read.format("binaryFile").load(str(headed))
    files = files if content else files.drop("content")
    r = {x["filename"].split(".")[0]: x for x in catalog.metadata(files, 100).collect()}
    a, b, c, d = (r[k] for k in ("frc_25-03-20_14-05-09_vabla_q42", "akit_25-03-21_14-05-09_vabla_qm7_sim", "free name", "frc_25-03-22_14-05-09_vabla"))
    assert (a["event"], a["match_type"], a["match_number"], a["team"], a["name"]) == ("VAALE", "Qualification", 12, 2363, "VAALE Qualification 12")
    assert (b["event"], b["match_type"], b["match_number"], b["team"]) == ("VABLA", "qm (sim)", 7, 100)  # told too late in the file
    assert (c["event"], c["match_type"], c["match_number"], c["created"], c["name"]) == (None, "Semifinal", None, None, "Semifinal")
    assert (d["event"], d["match_type"], d["match_number"]) == ("VABLA", "Practice", None) and a["created"] == 1742479509.0


def test_available_logs_carry_state_and_outcome(spark, headed):
    files = spark.read.format("binaryFile").load(str(headed))
    matches = spark.createDataFrame([("VAALE", "Qualification", 12, 88)], "event string, match_type string, match_number int, score int")
    rows = catalog.available_logs(files, matches).collect()
    assert [r["filename"][:12] for r in rows[-3:]] == ["frc_25-03-22", "akit_25-03-2", "frc_25-03-20"] and len(rows) == 4
    assert [r["score"] for r in rows if r["event"] == "VAALE"] == [88] and [r["readable"] for r in rows if r["match_type"] == "Practice"] == [False]


def test_a_head_ends_early():
    number = struct.Struct("<q").pack
    told = [("eventname", "string", [(1, b"A"), (9, b"B")]), ("matchtype", "int64", [(2, number(1))]), ("matchnumber", "int64", [(3, number(4))]), ("teamnumber", "int64", [(4, number(99))])]
    assert [x[0] for x in wpilog.head(wpilog.write(told))] == ["event", "match_type", "match_number", "team"]
    assert [x[2] for x in wpilog.head(wpilog.write(told[:1]))] == ["A", "B"] and list(wpilog.head(b"")) == []


def test_the_data_source_lists_stores(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    data = wpilog.write([("/a", "double", [(1, DOUBLE(1.0))])])
    (tmp_path / "sub" / "x.wpilog").write_bytes(data)
    (tmp_path / "y.wpilog").write_bytes(data)
    (tmp_path / "z.txt").write_bytes(b"no")
    spark.dataSource.register(wpilog.Wpilog)
    for place in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}"):
        assert {r["log_id"] for r in spark.read.format("wpilog").load(place).collect()} == {"x", "y"}
    assert spark.read.format("wpilog").load(str(tmp_path / "y.wpilog")).count() == 1


def test_stored_alignments_are_not_computed_again(spark, tmp_path, monkeypatch):
    t = np.arange(0, 30, 0.02)
    s = samples(spark, ("a", "/drive/velocity", t, chirp(t)), ("b", "/drive/velocity", t, chirp(t)), ("c", "/pose", t, chirp(t)))
    rev = signals(spark, ("r", "1/velocity", t + 2, chirp(t)))
    rows = [("a", "r", None, "f1", "g"), ("c", "r", None, "f3", "g")]
    kind = "log_id string, revlog_id string, start double, log_fingerprint string, revlog_fingerprint string"
    path, asked = str(tmp_path / "store"), []
    whole = sync_store.sync.synchronize
    monkeypatch.setattr(sync_store.sync, "synchronize", lambda a, b, files, hints=None: (asked.append(sorted(r["log_id"] for r in files.collect())), whole(a, b, files, hints))[1])
    one = {r["log_id"]: r for r in sync_store.synchronize(s, rev, spark.createDataFrame(rows, kind), path).collect()}
    assert abs(one["a"]["offset"] + 2) < 0.005 and one["c"]["method"] == "FAILED" and one["c"]["offset"] is None
    two = {r["log_id"]: r for r in sync_store.synchronize(s, rev, spark.createDataFrame([*rows, ("b", "r", None, "f1", "g"), ("b", "r", None, "f2", "g")], kind), path).collect()}
    assert asked == [["a", "c"], ["b", "c"]] and two["a"] == one["a"]
    assert sync_store.load(spark, path).count() == 2
    before = {tuple(r) for r in sync_store.load(spark, path).select("key", F.round("offset", 6)).collect()}
    sync_store.save(sync_store.load(spark, path), path)  # saved twice
    assert {tuple(r) for r in sync_store.load(spark, path).select("key", F.round("offset", 6)).collect()} == before


def test_what_numbers_cannot_say_of_a_struct():
    from fieldscope.sources import structs

    seen = struct.pack(structs.LAYOUTS["PoseObservation"][0], *range(9), 2, 3.5, 1)
    value = wpilog.value("struct:PoseObservation", seen)
    assert value["v_struct"]["pose_x"] == 1 and value["v_struct"]["tagCount"] == 2 and value["v_str"] == "MEGATAG_2"
    assert wpilog.value("struct:PoseObservation", seen[:-4] + struct.pack("<i", 9))["v_str"] == "UNKNOWN(9)"
    short = wpilog.value("struct:Pose2d", b"123")
    assert short == {"v_raw": b"123", "v_str": "insufficient data for Pose2d"} and wpilog.value("struct:Pose2d", bytes(24))["v_str"] is None
    assert wpilog.value("struct:Other", b"\1")["v_str"] == "01"
