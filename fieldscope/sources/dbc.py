"""DBC databases and CAN signals: parsing, decoding of one frame, and decoding of a table of frames by Spark's own expressions."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESSAGE = re.compile(r"^\s*BO_\s+(0[xX][0-9A-Fa-f]+|\d+)\s+(\w+)\s*:\s*(\d+)")
SIGNAL = re.compile(r'^\s*SG_\s+(\w+)\s*(?:m\d+|M)?\s*:\s*(\d+)\|(\d+)@([01])([+-])\s*\(([^,]+),([^)]+)\)\s*\[[^\]]*\]\s*"([^"]*)"')
VERSION = re.compile(r'^\s*VERSION\s+"([^"]*)"', re.M)
#: The parts of an extended id, and those of a motor controller's status frames (type, maker, class).
DEVICE, MAKER, STATUS = 0x3F, 5, 6

#: The status frames of the motor controllers, used where no database is given.
CONTROLLERS = """VERSION "1.0"
BO_ 0x02051800 Periodic_Status_0: 8 SparkMax
 SG_ AppliedOutput : 0|16@1- (0.0001,0) [-1|1] "duty_cycle"
 SG_ Faults : 16|16@1+ (1,0) [0|65535] ""
 SG_ StickyFaults : 32|16@1+ (1,0) [0|65535] ""
 SG_ IsFollower : 48|1@1+ (1,0) [0|1] ""
 SG_ IsInverted : 49|1@1+ (1,0) [0|1] ""
BO_ 0x02051840 Periodic_Status_1: 8 SparkMax
 SG_ Velocity : 0|32@1- (1,0) [-2147483648|2147483647] "rpm"
 SG_ Temperature : 32|8@1+ (1,0) [0|255] "degC"
 SG_ BusVoltage : 40|12@1+ (0.01,0) [0|40.95] "V"
 SG_ OutputCurrent : 52|12@1+ (0.0625,0) [0|255.9375] "A"
BO_ 0x02051880 Periodic_Status_2: 8 SparkMax
 SG_ Position : 0|32@1- (1,0) [-2147483648|2147483647] "rotations"
 SG_ IAccum : 32|32@1- (1,0) [-2147483648|2147483647] ""
BO_ 0x020518C0 Periodic_Status_3: 8 SparkMax
 SG_ AnalogVoltage : 0|10@1+ (0.001,0) [0|3.3] "V"
 SG_ AnalogVelocity : 10|22@1- (1,0) [-2097152|2097151] "rpm"
 SG_ AnalogPosition : 32|32@1- (1,0) [-2147483648|2147483647] "rotations"
BO_ 0x02051900 Periodic_Status_4: 8 SparkMax
 SG_ AltEncoderPosition : 0|32@1- (1,0) [-2147483648|2147483647] "rotations"
 SG_ AltEncoderVelocity : 32|32@1- (1,0) [-2147483648|2147483647] "rpm"
BO_ 0x02051940 Periodic_Status_5: 8 SparkMax
 SG_ DutyCyclePosition : 0|32@1- (1,0) [-2147483648|2147483647] "rotations"
 SG_ DutyCycleAbsolutePosition : 32|16@1+ (0.0001,0) [0|1] "rotations"
BO_ 0x02051980 Periodic_Status_6: 8 SparkMax
 SG_ DutyCycleVelocity : 0|32@1- (1,0) [-2147483648|2147483647] "rpm"
 SG_ DutyCycleFrequency : 32|16@1+ (1,0) [0|65535] "Hz"
BO_ 0x020519C0 Periodic_Status_7: 8 SparkMax
 SG_ MotorTemperature : 0|8@1+ (1,0) [0|255] "degC"
 SG_ AppliedOutputRaw : 8|16@1- (1,0) [-32768|32767] ""
 SG_ Reserved : 24|40@1+ (1,0) [0|0] ""
"""


class Signal(NamedTuple):
    message: int
    name: str
    start: int
    length: int
    little: bool
    signed: bool
    scale: float
    offset: float
    unit: str


def parse(text: str) -> list[Signal]:
    """The signals of a database; ids are decimal or hexadecimal, a later message replaces an earlier one of the same id."""
    out: dict[int, list[Signal]] = {}
    own: list[Signal] | None = None
    for line in text.splitlines():
        if m := MESSAGE.match(line):
            message = int(m[1], 0) & 0x1FFFFFFF
            own = out[message] = []
        elif own is not None and (s := SIGNAL.match(line)):
            own.append(Signal(message, s[1], int(s[2]), int(s[3]), s[4] == "1", s[5] == "-", float(s[6]), float(s[7]), s[8]))
    return [s for own in out.values() for s in own]


def version(text: str) -> str:
    found = VERSION.search(text)
    return found[1] if found else ""


def decode(signal: Signal, frame: bytes) -> float:
    """Little-endian signals count bits upwards from the start; big-endian ones run from their highest bit down each byte."""
    if signal.little:
        raw = int.from_bytes(frame, "little") >> signal.start
    else:
        first = signal.start // 8 * 8 + 7 - signal.start % 8
        raw = int.from_bytes(frame, "big") >> max(0, 8 * len(frame) - first - signal.length)
    raw &= (1 << signal.length) - 1
    if signal.signed and raw >> (signal.length - 1):
        raw -= 1 << signal.length
    return raw * signal.scale + signal.offset


def lookup(signals: list[Signal], can_id: int) -> list[Signal]:
    """Signals of the exact id, else of the id without its device number."""
    return [s for s in signals if s.message == can_id] or [s for s in signals if s.message == can_id & ~DEVICE]


def status_id(can: Column) -> Column:
    """The id of a status frame in a database, from the type and index within the id of a recorded one."""
    kind, index = F.shiftrightunsigned(can, 24).bitwiseAND(0x1F), F.shiftrightunsigned(can, 6).bitwiseAND(0xF)
    return F.shiftleft(kind, 24).bitwiseOR(F.lit(MAKER << 16 | STATUS << 10)).bitwiseOR(F.shiftleft(index, 6))


def decode_frames(frames: DataFrame, database: list[Signal], can: str = "can", little: str = "le", big: str = "be") -> DataFrame:
    """frames with signal, place (of the signal in its message), unit and value, a row for each signal of each frame that the database knows.

    A frame's id is a 29-bit number, its eight bytes are one number in either order. Its message is that of the exact id, else of the id
    without its device, else that of the status frame which type and index name.
    """
    own = F.col(can).cast("int").bitwiseAND(0x1FFFFFFF)
    known = sorted({s.message for s in database})
    message = F.lit(None).cast("int")
    for at in (status_id(own), own.bitwiseAND(~DEVICE), own):
        message = F.when(at.isin(known), at).otherwise(message) if known else message
    places: dict[int, int] = {}
    rows = []
    for s in database:
        places[s.message] = places.get(s.message, -1) + 1
        rows.append((*s, places[s.message]))
    signals = frames.sparkSession.createDataFrame(rows, "message int, signal string, start int, length int, little boolean, signed boolean, scale double, offset double, unit string, place int")
    met = frames.withColumn("message", message).join(F.broadcast(signals), "message")  # as long as the database, a list of the driver's
    first = F.expr("start div 8 * 8 + 7 - start % 8").cast("int")
    by = F.when(F.col("little"), F.col("start")).otherwise(F.greatest(F.lit(0), 64 - first - F.col("length")))
    mask = F.expr("shiftrightunsigned(-1L, 64 - length)")
    met = met.withColumns({"__word": F.when(F.col("little"), F.col(little)).otherwise(F.col(big)), "__by": by.cast("int")})
    raw = F.expr("shiftrightunsigned(__word, __by)").bitwiseAND(mask)
    met = met.withColumn("__raw", raw)
    negative = F.col("signed") & (F.col("length") < 64) & F.expr("shiftright(__raw, length - 1) <> 0")
    number = F.when(negative, F.col("__raw").bitwiseOR(F.bitwise_not(mask)).cast("double")).when(~F.col("signed") & (F.col("__raw") < 0), F.col("__raw").cast("double") + 2.0**64).otherwise(F.col("__raw").cast("double"))
    return met.select(*frames.columns, "signal", "place", "unit", (number * F.col("scale") + F.col("offset")).alias("value"))
