"""Schemas, numeric rules and the roles of channels by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = (
    "log_id string, entry string, type string, seq long, ts_us long, ts double, v_num double, v_long long, v_bool boolean, v_str string, v_raw binary, "
    "v_arr_num array<double>, v_arr_str array<string>, v_struct map<string,double>, v_structs array<map<string,double>>"
)
#: The types whose samples count as numbers.
NUMERIC_TYPES = ("double", "float", "int64")


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def has(*parts: str):
    return lambda e: _all(e, parts)


def _all(e: Column, parts) -> Column:
    lower, out = F.lower(e), F.lit(True)
    for p in parts:
        out = out & lower.contains(p)
    return out


#: Role -> predicate over the entry's name.
ROLES = {
    "enabled": has("driverstation", "enabled"),
    "autonomous": lambda e: _all(e, ("driverstation", "auto")) & ~F.lower(e).contains("command"),
    "battery": lambda e: _all(e, ("batteryvoltage",)) | _all(e, ("battery_voltage",)) | _all(e, ("voltage", "input")),
    "total_current": lambda e: _all(e, ("totalcurrent",)) | _all(e, ("total_current",)),
    "loop_time": lambda e: _all(e, ("looptime",)) | _all(e, ("loop", "time")),
    "vision_target": lambda e: _all(e, ("hastarget",)) | F.lower(e).rlike(r"[/.]tv$") | _all(e, ("targetvalid",)),
    "pose": lambda e: _all(e, ("pose",)) & ~F.lower(e).contains("target"),
    "can_utilisation": lambda e: _all(e, ("can",)) & (_all(e, ("util",)) | _all(e, ("bandwidth",)) | _all(e, ("busoff",))),
    "can_error": lambda e: _all(e, ("can",)) & (_all(e, ("error",)) | _all(e, ("fault",)) | _all(e, ("timeout",))),
    "odometry": lambda e: _all(e, ("odometry",)) | _all(e, ("estimatedpose",)),
    "vision_pose": has("vision", "pose"),
    "system_time": has("systemtime"),
}


#: Roles that an entry of an earlier pattern plays rather than one of a later, whatever their names.
ORDERED_ROLES = {
    "battery_health": ("batteryvoltage", "battery_voltage", "inputvoltage", "pdp/voltage", "pdh/voltage"),
    "report_battery": ("batteryvoltage", "battery_voltage"),
}


def entries_of(samples: DataFrame, role: str, name: str | None = None) -> DataFrame:
    """Samples of the entry that plays a role: the one named, else the first in each log, by the role's patterns and by name.

    The rows of a role are ordered by log, as what follows needs them: one scan, one shuffle.
    """
    if name is not None:
        return samples.where(F.col("entry") == name)
    if role in ORDERED_ROLES:
        rank = F.coalesce(*(F.when(F.lower("entry").contains(p), F.lit(i)) for i, p in enumerate(ORDERED_ROLES[role])))
    else:
        rank = F.when(ROLES[role](F.col("entry")), F.lit(0))
    found = samples.withColumn("__role", F.struct(rank.alias("rank"), "entry")).where("__role.rank is not null")
    first = F.min("__role").over(Window.partitionBy("log_id"))
    return found.withColumn("__first", first).where("__role = __first").drop("__role", "__first")
