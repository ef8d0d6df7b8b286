"""The operators by name: what they take, calls by name with checked arguments, and table functions for SQL.

A registered operator is a function of one or two DataFrames and parameters. describe lists them as a table; call checks names, columns and types
before a plan is made. The sequential operators are also table functions: SELECT * FROM hysteresis_events(TABLE(t) PARTITION BY log_id ORDER BY
(ts, seq), 5.0, 25.0) reads a series in order and holds one state, whatever its length.
"""

from __future__ import annotations

import difflib
import inspect
import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from fieldscope.operators import asof, cycles, quality, series, stats, tools

SERIES, SAMPLES, STATES = ("ts", "seq", "value"), ("log_id", "entry", "ts", "seq"), ("ts", "seq", "value")


class Parameter(NamedTuple):
    name: str
    type: str
    required: bool
    default: str | None


class Operator(NamedTuple):
    name: str
    category: str
    function: Callable
    columns: tuple[str, ...]

    @property
    def tables(self) -> int:
        """How many of the first parameters are tables."""
        return sum(_kind(p) == "DataFrame" and p.default is inspect.Parameter.empty for p in inspect.signature(self.function).parameters.values())

    @property
    def parameters(self) -> list[Parameter]:
        own = list(inspect.signature(self.function).parameters.values())[self.tables :]
        none = inspect.Parameter.empty
        return [Parameter(p.name, _kind(p), p.default is none, None if p.default in (none, None) else str(p.default)) for p in own]

    @property
    def summary(self) -> str:
        return (inspect.getdoc(self.function) or "").split("\n")[0]


def _kind(p: inspect.Parameter) -> str:
    return str(p.annotation).replace(" | None", "")


OPERATORS: dict[str, Operator] = {}


def register(name: str, category: str, function: Callable, columns: tuple[str, ...]) -> None:
    if name in OPERATORS:
        raise ValueError(f"operator {name} is already registered")
    OPERATORS[name] = Operator(name, category, function, columns)


for _name, _category, _function, _columns in (
    ("get_statistics", "statistics", stats.describe, ("value",)), ("detect_anomalies", "statistics", stats.detect_anomalies, ("value",)), ("compare_entries", "statistics", stats.compare, SERIES),
    ("time_correlate", "statistics", stats.time_correlate, SERIES), ("data_quality", "statistics", quality.measure, SERIES), ("high_variance_window", "statistics", stats.high_variance_window, ("ts", "value")),
    ("analyze_loop_timing", "statistics", stats.loop_timing, ("value",)), ("find_condition", "series", series.find_condition, SERIES), ("find_peaks", "series", series.find_peaks, SERIES),
    ("rate_of_change", "series", series.rate_of_change, SERIES), ("moving_average", "series", series.moving_average, SERIES), ("hysteresis", "series", series.hysteresis, SERIES), ("recovery", "series", series.recovery, SERIES),
    ("setpoint_segments", "series", series.segments_by_setpoint, SERIES), ("analyze_cycles", "series", cycles.analyze, STATES), ("hold", "joins", asof.hold, SERIES), ("interpolate", "joins", asof.lerp, SERIES), ("match_within", "joins", asof.forward, SERIES),
    ("get_match_phases", "robot", tools.match_phases, SAMPLES), ("get_ds_timeline", "robot", tools.ds_timeline, SAMPLES), ("power_analysis", "robot", tools.power_analysis, SAMPLES), ("can_health", "robot", tools.can_health, SAMPLES),
    ("can_errors_by_entry", "robot", tools.can_errors_by_entry, SAMPLES), ("analyze_swerve", "robot", tools.wheel_slip, SAMPLES), ("analyze_vision", "robot", tools.analyze_vision, SAMPLES), ("analyze_replay_drift", "robot", tools.replay_drift, SAMPLES),
    ("analyze_can_bus", "robot", tools.analyze_can_bus, SAMPLES), ("analyze_auto", "robot", tools.follow_path, SAMPLES), ("profile_mechanism", "robot", tools.profile_by_name, SAMPLES), ("predict_battery_health", "robot", tools.battery_health, SAMPLES), ("generate_report", "robot", tools.report, SAMPLES),
):
    register(_name, _category, _function, _columns)


def find(name: str) -> Operator:
    if name not in OPERATORS:
        near = difflib.get_close_matches(name, OPERATORS, 3)
        raise ValueError(f"no operator {name}" + (f"; did you mean {', '.join(near)}?" if near else ""))
    return OPERATORS[name]


def describe(spark: SparkSession) -> DataFrame:
    """name, category, summary, tables, columns (that each table needs), parameters (name, type, required, default) of every operator."""
    rows = [(o.name, o.category, o.summary, o.tables, list(o.columns), [tuple(p) for p in o.parameters]) for o in OPERATORS.values()]
    return spark.createDataFrame(rows, "name string, category string, summary string, tables int, columns array<string>, parameters array<struct<name:string,type:string,required:boolean,default:string>>")


#: What a parameter of a type takes.
TAKES = {"float": (int, float), "int": (int,), "str": (str,), "bool": (bool,), "Sequence[str]": (list, tuple), "list[str]": (list, tuple)}


def call(name: str, *tables: DataFrame, **arguments) -> DataFrame:
    """The operator's result; a wrong name, number of tables, column, parameter or type is told before anything runs."""
    o = find(name)
    if len(tables) != o.tables:
        raise ValueError(f"{name} takes {o.tables} table(s), not {len(tables)}")
    for i, t in enumerate(tables):
        if missing := [c for c in o.columns if c not in t.columns]:
            raise ValueError(f"table {i + 1} of {name} lacks {', '.join(missing)}")
    known = {p.name: p for p in o.parameters}
    if unknown := [a for a in arguments if a not in known]:
        raise ValueError(f"{name} has no parameter {', '.join(unknown)}; it has {', '.join(known)}")
    if missing := [p.name for p in known.values() if p.required and p.name not in arguments]:
        raise ValueError(f"{name} needs {', '.join(missing)}")
    for a, v in arguments.items():
        takes = TAKES.get(known[a].type)
        if takes and v is not None and (not isinstance(v, takes) or isinstance(v, bool) and bool not in takes):
            raise ValueError(f"{a} of {name} must be {known[a].type}, not {type(v).__name__}")
    return o.function(*tables, **arguments)


# Table functions. A table comes partitioned by series and ordered by time; the rows of a partition are one series.


def _constant(argument: AnalyzeArgument, name: str) -> float:
    if argument.isTable or not argument.isConstantExpression or argument.value is None:
        raise ValueError(f"{name} must be a constant number")
    return float(argument.value)


def _series_schema(table: AnalyzeArgument, *columns: str) -> StructType:
    if not table.isTable:
        raise ValueError("the first argument must be TABLE(...) PARTITION BY ... ORDER BY (ts, seq)")
    if missing := [c for c in columns if c not in table.dataType.names]:
        raise ValueError(f"the table lacks {', '.join(missing)}")
    return table.dataType


class SetpointSegments:
    """The rows of the table with the number of their segment, as series.segments_by_setpoint."""

    @staticmethod
    def analyze(table: AnalyzeArgument, least: AnalyzeArgument = None, share: AnalyzeArgument = None) -> AnalyzeResult:
        for a, name in ((least, "least"), (share, "share")):
            if a is not None:
                _constant(a, name)
        fields = _series_schema(table, "value")
        return AnalyzeResult(StructType([*fields.fields]).add("segment", LongType()))

    def __init__(self):
        self.last, self.segment = None, 0

    def eval(self, row: Row, least=0.01, share=0.05):
        v = row["value"]
        if v is not None and (self.last is None or abs(v - self.last) > max(abs(self.last) * float(share), float(least))):
            self.segment, self.last = self.segment + 1, v
        yield *row, self.segment


class HysteresisEvents:
    """begin, end, closed, lowest of the events of a series, with the other columns of the row that began it, as series.hysteresis."""

    @staticmethod
    def analyze(table: AnalyzeArgument, enter: AnalyzeArgument, leave: AnalyzeArgument) -> AnalyzeResult:
        _constant(enter, "enter"), _constant(leave, "leave")
        out = StructType([f for f in _series_schema(table, "ts", "value").fields if f.name not in ("ts", "value", "seq")])
        return AnalyzeResult(out.add("event", LongType()).add("begin", DoubleType()).add("end", DoubleType()).add("closed", BooleanType()).add("lowest", DoubleType()))

    def __init__(self):
        self.event, self.begin, self.lowest, self.first, self.last = 0, None, None, (), None

    def _row(self, end, closed):
        return *self.first, self.event, self.begin, float(end), closed, self.lowest

    def eval(self, row: Row, enter, leave):
        v, ts = row["value"], row["ts"]
        if v is None or not math.isfinite(v):
            return
        self.last = ts
        if self.begin is None:
            if v < enter:
                kept = [x for x, name in zip(row, row.__fields__, strict=True) if name not in ("ts", "value", "seq")]
                self.event, self.begin, self.lowest, self.first = self.event + 1, float(ts), float(v), tuple(kept)
        elif v >= leave:
            yield self._row(ts, True)
            self.begin = None
        else:
            self.lowest = min(self.lowest, float(v))

    def terminate(self):
        if self.begin is not None:
            yield self._row(self.last, False)


class Operators:
    """The names, categories and summaries of all operators, as a table for SQL."""

    def eval(self):
        for o in OPERATORS.values():
            yield o.name, o.category, o.summary


FUNCTIONS = {"setpoint_segments": (SetpointSegments, None), "hysteresis_events": (HysteresisEvents, None), "operators": (Operators, StructType().add("name", StringType()).add("category", StringType()).add("summary", StringType()))}


def register_functions(spark: SparkSession) -> None:
    """Makes the table functions known to SQL."""
    for name, (function, kind) in FUNCTIONS.items():
        spark.udtf.register(name, udtf(function, returnType=kind) if kind is not None else udtf(function))
