"""The WPILOG format as a Spark data source: spark.read.format("wpilog").load(path). A task reads a file; a damaged tail keeps what came before.

Files lie in any store that pyarrow opens (read_files takes those that only Spark reaches). states tells of each log whether it was cut and
how many records could not be read; metadata reads no more than the head of each file.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fieldscope.model import SAMPLES
from fieldscope.sources import structs

MAGIC = b"WPILOG"


class Cut(Exception):
    """The log ends within a record."""


def records(data: bytes, whole: bool = False) -> Iterator[tuple[int, int, bytes]]:
    """(entry id, microseconds, payload) of every whole record; with `whole` a record cut by the end raises Cut."""
    if data[:6] != MAGIC or len(data) < 12 or struct.unpack_from("<H", data, 6)[0] < 0x0100:
        raise ValueError("not a WPILOG file")
    at = 12 + struct.unpack_from("<I", data, 8)[0]
    if whole and at > len(data):
        raise Cut
    while at < len(data):
        kind = data[at]
        widths = (kind & 3) + 1, (kind >> 2 & 3) + 1, (kind >> 4 & 7) + 1
        fields, at = [], at + 1
        for w in widths:
            fields.append(int.from_bytes(data[at : at + w], "little"))
            at += w
        entry, size, ts = fields
        if at + size > len(data):
            if whole:
                raise Cut
            return
        yield entry, ts, data[at : at + size]
        at += size


def start_of(payload: bytes) -> tuple[int, str, str, str] | None:
    """(entry id, name, type, metadata) of a start record."""
    if not payload or payload[0] != 0:
        return None
    entry, at, texts = struct.unpack_from("<I", payload, 1)[0], 5, []
    for _ in range(3):
        n = struct.unpack_from("<I", payload, at)[0]
        texts.append(payload[at + 4 : at + 4 + n].decode("utf-8", "replace"))
        at += 4 + n
    return entry, *texts


def value(kind: str, p: bytes) -> dict:
    """The columns that a payload fills."""
    if kind == "boolean":
        return {"v_bool": bool(p[0])}
    if kind == "int64":
        n = struct.unpack("<q", p)[0]
        return {"v_long": n, "v_num": float(n)}
    if kind in ("float", "double"):
        return {"v_num": struct.unpack("<f" if kind == "float" else "<d", p)[0]}
    if kind in ("string", "json"):
        return {"v_str": p.decode("utf-8", "replace")}
    if kind in ("boolean[]", "int64[]", "float[]", "double[]"):
        code = {"b": "?", "i": "q", "f": "f", "d": "d"}[kind[0]]
        return {"v_arr_num": [float(x) for x in struct.unpack(f"<{len(p) // struct.calcsize(code)}{code}", p)]}
    if kind == "string[]":
        n, at, out = struct.unpack_from("<I", p)[0], 4, []
        for _ in range(n):
            size = struct.unpack_from("<I", p, at)[0]
            out.append(p[at + 4 : at + 4 + size].decode("utf-8", "replace"))
            at += 4 + size
        return {"v_arr_str": out}
    if kind == "raw":
        return {"v_raw": p}
    name = kind.split(":", 1)[-1]
    if kind.startswith("structarray:") or name.endswith("[]"):
        found = structs.decode_array(name.removesuffix("[]"), p)
        if found is not None:
            return {"v_structs": found}
    elif kind.startswith("struct:"):
        text, found = structs.text_of(name, p), structs.decode(name, p)
        if found is not None:
            return {"v_struct": found, "v_str": text}
        if text is not None:
            return {"v_raw": p, "v_str": text}
    return {"v_raw": p, "v_str": p.hex() if len(p) <= 100 else f"<{kind}: {len(p)} bytes>"}


COLUMNS = [c.strip().split(" ")[0] for c in SAMPLES.replace("map<string,double>", "map").split(", ")]


def samples(log_id: str, data: bytes, most: int | None = None) -> Iterator[tuple]:
    """Rows of the samples schema; a payload that does not fit its type is skipped, and only a record cut by the file's end ends the log."""
    entries: dict[int, tuple[str, str]] = {}
    for seq, (entry, ts, payload) in enumerate(records(data)):
        if most is not None and seq >= most:
            return
        if entry == 0:
            try:
                if start := start_of(payload):
                    entries[start[0]] = start[1:3]
            except struct.error:  # a start record that is too short names no entry
                pass
            continue
        if entry in entries:
            name, kind = entries[entry]
            try:
                v = value(kind, payload)
            except (struct.error, IndexError):
                continue
            row = {"log_id": log_id, "entry": name, "type": kind, "seq": seq, "ts_us": ts, "ts": ts / 1e6} | v
            yield tuple(row.get(c) for c in COLUMNS)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def log_name(path: str) -> str:
    return path.rsplit("/", 1)[-1].removesuffix(".wpilog")


def store_of(path: str):
    """The store of a path or URI, and the path within it."""
    from pyarrow import fs

    if re.match(r"(?!file:)[a-z][a-z0-9+.-]*:/", path, re.I):
        return fs.FileSystem.from_uri(quote(path, safe="/:@?=&%"))
    return fs.LocalFileSystem(), re.sub("^file:/+", "/", path)


class WpilogReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.most = options["path"], options.get("maxRecords")

    def partitions(self):
        from pyarrow import fs

        store, path = store_of(self.root)
        if store.get_file_info(path).type == fs.FileType.File:
            return [_File(path)]
        return [_File(f.path) for f in sorted(store.get_file_info(fs.FileSelector(path, recursive=True)), key=lambda f: f.path) if f.type == fs.FileType.File and f.path.endswith(".wpilog")]

    def read(self, partition):
        with store_of(self.root)[0].open_input_file(partition.path) as f:
            yield from samples(log_name(partition.path), f.read(), self.most and int(self.most))


class Wpilog(DataSource):
    @classmethod
    def name(cls):
        return "wpilog"

    def schema(self):
        return SAMPLES

    def reader(self, schema):
        return WpilogReader(self.options)


def read_files(files, most: int | None = None):
    """Samples of logs listed with Spark's own binaryFile format, which reaches any store that Spark does."""
    def run(batches):
        import pandas as pd

        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                yield pd.DataFrame(samples(log_name(path), bytes(data), most), columns=COLUMNS)

    return files.select("path", "content").mapInPandas(run, SAMPLES)


STATE = "path string, log_id string, readable boolean, truncated boolean, records long, samples long, skipped long, entries int, min_ts double, max_ts double, message string"


def state(data: bytes) -> tuple:
    """readable, truncated, records, samples, skipped (records that do not fit their type, or lack it), entries, min_ts, max_ts, message."""
    n = kept = skipped = 0
    low = high = None
    cut, entries = False, {}
    try:
        for entry, ts, payload in records(data, whole=True):
            n += 1
            try:
                if entry == 0:
                    if start := start_of(payload):
                        entries[start[0]] = start[2]
                    continue
                if entry not in entries:
                    skipped += 1
                    continue
                value(entries[entry], payload)
            except (struct.error, IndexError):
                skipped += 1
                continue
            kept, seconds = kept + 1, ts / 1e6
            low, high = seconds if low is None else min(low, seconds), seconds if high is None else max(high, seconds)
    except Cut:
        cut = True
    except ValueError as e:
        return False, False, 0, 0, 0, 0, None, None, str(e)
    said = [f"the log ends within a record; samples up to {high or 0:.2f} s are kept"] * cut + [f"{skipped} records could not be read"] * bool(skipped)
    return True, cut, n, kept, skipped, len(entries), low, high, "; ".join(said) or None


def states(files: DataFrame) -> DataFrame:
    """A row a log listed with format binaryFile: whether it is a log, is cut, how much of it can be read, and what to tell a user."""
    names = [c.split()[0] for c in STATE.split(", ")]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame([(path, log_name(path), *state(bytes(data))) for path, data in zip(pdf["path"], pdf["content"], strict=True)], columns=names).astype({"entries": "int32"})

    return files.select("path", "content").mapInPandas(run, STATE)


#: The parts of entries' names that tell of the match, and how many records are looked at.
FIELDS = {"eventname": "event", "matchtype": "match_type", "matchnumber": "match_number", "stationnumber": "team", "teamnumber": "team"}
HEAD_RECORDS, HEAD_BYTES = 2000, 1 << 20
HEAD = "path string, field string, seq long, v_str string, v_long long"


def head(data: bytes, most: int = HEAD_RECORDS) -> Iterator[tuple[str, int, str | None, int | None]]:
    """(field, seq, text, number) of samples that tell of the match, among the first records; ends once every field was told."""
    names: dict[int, tuple[str, str]] = {}
    told: set[str] = set()
    try:
        for seq, (entry, _, payload) in enumerate(records(data)):
            if seq > most or told == set(FIELDS.values()):
                return
            try:
                if entry == 0:
                    if start := start_of(payload):
                        field = next((f for part, f in FIELDS.items() if part in start[1].lower()), None)
                        names[start[0]] = field, start[2]
                elif entry in names and names[entry][0]:
                    field, kind = names[entry]
                    found = value(kind, payload)
                    text, number = found.get("v_str"), found.get("v_long")
                    if text or number is not None and number > (10 if field == "team" else 0):
                        told.add(field)
                        yield field, seq, text, number
            except (struct.error, IndexError):
                continue
    except ValueError:
        return


def read_heads(files: DataFrame, most: int = HEAD_RECORDS, size: int = HEAD_BYTES) -> DataFrame:
    """path and head() of the first `size` bytes of each file; from the column content where files have one, else through the path."""
    names, content = [c.split()[0] for c in HEAD.split(", ")], "content" in files.columns
    rows = files.select("path", F.substring("content", 1, size).alias("content")) if content else files.select("path")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for i, path in enumerate(pdf["path"]):
                if content:
                    data = bytes(pdf["content"].iloc[i])
                else:
                    store, place = store_of(path)
                    with store.open_input_file(place) as f:
                        data = f.read(size)
                yield pd.DataFrame([(path, *row) for row in head(data, most)], columns=names).astype({"v_long": "Int64"})

    return rows.mapInPandas(run, HEAD)


def write(records: list[tuple[str, str, list[tuple[int, bytes]]]]) -> bytes:
    """A log of entries (name, type, [(microseconds, payload)]), in time order; for tests and exports."""
    def record(entry: int, ts: int, payload: bytes) -> bytes:
        return bytes([0b01111111]) + entry.to_bytes(4, "little") + len(payload).to_bytes(4, "little") + ts.to_bytes(8, "little") + payload

    text = lambda s: struct.pack("<I", len(s.encode())) + s.encode()
    out = [MAGIC + struct.pack("<HI", 0x0100, 0)]
    out += [record(0, 0, b"\0" + struct.pack("<I", i) + text(n) + text(k) + text("")) for i, (n, k, _) in enumerate(records, 1)]
    rows = sorted((ts, i, p) for i, (_, _, values) in enumerate(records, 1) for ts, p in values)
    return b"".join(out + [record(i, ts, p) for ts, i, p in rows])
