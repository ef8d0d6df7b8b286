"""Motor-controller logs: a native format of chunks, and the same frames as entries of a WPILOG file, told apart by their first bytes.

A small reader turns a file into rows of frames and firmware chunks; signals are decoded from these by joins and Spark's expressions (see
dbc.decode_frames), devices are an aggregate of the same rows.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscope.sources import dbc, wpilog

#: The names of entries that hold a device and its status frames; the types of devices by number.
DEVICE_ENTRY, STATUS_ENTRY = re.compile(r"CAN/(\d+)$"), re.compile(r"CAN/(\d+)/Periodic Status (\d+)")
TYPES = {2: "SPARK MAX", 12: "Servo Hub", 7: "MAXSpline Encoder"}
WITH_FIRMWARE, CONTROLLER = (2, 12), 2
FRAMES = "log_id string, seq long, ts double, can int, le long, be long, firmware string"


def native(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(entry id, payload) of every whole record: a byte of widths, the id, the size, the payload."""
    at = 0
    while at < len(data):
        kind = data[at]
        wi, ws = (kind & 3) + 1, (kind >> 2 & 3) + 1
        entry, size = int.from_bytes(data[at + 1 : at + 1 + wi], "little"), int.from_bytes(data[at + 1 + wi : at + 1 + wi + ws], "little")
        at += 1 + wi + ws
        if at + size > len(data):
            return
        yield entry, data[at : at + size]
        at += size


def frames(data: bytes) -> Iterator[tuple[float, int, bytes]]:
    """(seconds, CAN id, eight bytes) of periodic records, which hold 16-byte chunks."""
    for entry, payload in native(data):
        if entry == 2:
            for at in range(0, len(payload) - 15, 16):
                ms, can = struct.unpack_from("<Ii", payload, at)
                yield ms / 1000, can & 0x1FFFFFFF, payload[at + 8 : at + 16]


def signals(data: bytes, database: list[dbc.Signal]) -> Iterator[tuple[str, float, float]]:
    """(device/signal, seconds, value)."""
    known: dict[int, list[dbc.Signal]] = {}
    for ts, can, frame in frames(data):
        for s in known.setdefault(can, dbc.lookup(database, can)):
            yield f"{can & 0x3F}/{s.name}", ts, dbc.decode(s, frame)


def _native_rows(data: bytes) -> Iterator[tuple]:
    for entry, payload in native(data):
        if entry == 1:
            for at in range(0, len(payload) - 9, 10):
                can, major, minor, build = struct.unpack_from("<iBB", payload, at) + struct.unpack_from(">H", payload, at + 6)
                yield None, can, None, None, f"{major}.{minor}.{build}" if can >> 24 & 0x1F in WITH_FIRMWARE else ""
        elif entry == 2:
            for at in range(0, len(payload) - 15, 16):
                ms, can = struct.unpack_from("<Ii", payload, at)
                yield ms / 1000, can, *struct.unpack_from("<q", payload, at + 8), *struct.unpack_from(">q", payload, at + 8), None


def _wpilog_rows(data: bytes) -> Iterator[tuple]:
    names: dict[int, tuple[int, int | None]] = {}  # entry -> device, index of its status frame
    for entry, us, payload in wpilog.records(data):
        if entry == 0:
            try:
                start = wpilog.start_of(payload)
            except struct.error:
                continue
            if start and (m := STATUS_ENTRY.search(start[1])):
                names[start[0]] = int(m[1]), int(m[2])
            elif start and (m := DEVICE_ENTRY.search(start[1])):
                names[start[0]] = int(m[1]), None
            elif start:
                names.pop(start[0], None)
        elif entry in names and us < 1 << 63:  # times are signed
            device, index = names[entry]
            can = CONTROLLER << 24 | dbc.MAKER << 16 | dbc.STATUS << 10 | ((index or 0) & 0xF) << 6 | device & dbc.DEVICE
            if index is None:
                yield None, can, None, None, ""
            elif len(payload) >= 8:
                yield us / 1e6, can, *struct.unpack_from("<q", payload), *struct.unpack_from(">q", payload), None


def rows_of(data: bytes) -> Iterator[tuple]:
    """(seconds, CAN id, the bytes as a number in either order, firmware) of frames, and of firmware chunks, which have no time.

    The format is told by the file's first bytes. A record cut by the end ends the log; a firmware that is not known is empty.
    """
    if data[:6] == wpilog.MAGIC:
        try:
            yield from _wpilog_rows(data)
            return
        except ValueError:  # the sign alone makes no log
            pass
    yield from _native_rows(data)


def read_frames(files: DataFrame) -> DataFrame:
    """Frames and firmware chunks (see rows_of) of logs listed with format binaryFile: log_id, seq and the rest."""
    names = [c.split()[0] for c in FRAMES.split(", ")]

    def run(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                log, rows = path.rsplit("/", 1)[-1].removesuffix(".revlog"), []
                for seq, row in enumerate(rows_of(data.as_py())):
                    rows.append((log, seq, *row))
                    if len(rows) == 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.select("path", "content").mapInArrow(run, FRAMES)


def type_number(can: str = "can") -> Column:
    return F.shiftright(can, 24).bitwiseAND(0x1F)


def type_name(can: str = "can") -> Column:
    n = type_number(can)
    out = F.format_string("Unknown (%d)", n)
    for number, name in TYPES.items():
        out = F.when(n == number, name).otherwise(out)
    return out


def device_key(can: str = "can") -> Column:
    """Type and number of a device, as in SparkMax_3."""
    return F.concat(F.regexp_replace(F.initcap(type_name(can)), " ", ""), F.lit("_"), F.col(can).bitwiseAND(dbc.DEVICE).cast("string"))


def devices(rows: DataFrame) -> DataFrame:
    """log_id, device (type and number), type, can_id, firmware (the first that is known), frames: one row a device of read_frames' rows."""
    known = F.nullif("firmware", F.lit(""))
    keyed = rows.select("log_id", device_key().alias("device"), type_name().alias("type"), F.col("can").bitwiseAND(dbc.DEVICE).alias("can_id"), "seq", known.alias("firmware"), F.col("le").isNotNull().alias("frame"))
    return keyed.groupBy("log_id", "device", "type", "can_id").agg(F.min_by("firmware", F.when(F.col("firmware").isNotNull(), F.col("seq"))).alias("firmware"), F.count_if("frame").alias("frames"))


def read_signals(rows: DataFrame, database: list[dbc.Signal] | None = None) -> DataFrame:
    """log_id, device, signal (device/kind), seq, ts, value, unit of read_frames' rows, with the controllers' own database unless one is given."""
    database = dbc.parse(dbc.CONTROLLERS) if database is None else database
    found = dbc.decode_frames(rows.where("le is not null"), database)
    return found.select("log_id", device_key().alias("device"), F.concat(device_key(), F.lit("/"), "signal").alias("signal"), *_ordered(database), "ts", "value", "unit")


def _ordered(database: list[dbc.Signal]) -> list[Column]:
    """seq: the frame's number and the signal's place in one number."""
    most = max((sum(s.message == m for s in database) for m in {s.message for s in database}), default=1)
    return [(F.col("seq") * most + F.col("place")).alias("seq")]


def read_files(files: DataFrame, database: list[dbc.Signal]) -> DataFrame:
    """log_id, entry (number of the device/signal), seq, ts, value of logs listed with format binaryFile; the database is a small list."""
    found = dbc.decode_frames(read_frames(files).where("le is not null"), database)
    return found.select("log_id", F.concat(F.col("can").bitwiseAND(dbc.DEVICE).cast("string"), F.lit("/"), "signal").alias("entry"), *_ordered(database), "ts", "value")
