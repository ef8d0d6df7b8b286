"""Cycles of a mechanism's states: complete and unfinished ones, idle time, and what looks wrong in the states themselves.

All of it comes from one order of each series: what came before by running windows, what comes next by the same in reverse, so one shuffle and
time in proportion to the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscope.operators import quality, series
from fieldscope.operators.asof import before

#: Transitions closer than this (seconds) are rapid; more than so many, or so many unknown states, change what is said.
RAPID_SECONDS, MANY_RAPID, MANY_UNKNOWN = 0.1, 5, 5
CYCLE = "array<struct<begin:double,end:double,seconds:double,incomplete:boolean>>"


def _same(state: Column, wanted: str | None, case: bool) -> Column:
    if wanted is None:
        return F.lit(False)
    return F.coalesce(state == F.lit(wanted) if case else F.lower(state) == F.lit(wanted.lower()), F.lit(False))


def analyze(
    states: DataFrame, keys: Sequence[str], start: str, end: str | None = None, idle: str | None = None, since: float | None = None, until: float | None = None, case: bool = True, limit: int = 10, measured: bool = True
) -> DataFrame:
    """A row a series of states (ts, seq, value: text): counts, times and first `limit` of its cycles and idle spells, warnings, quality.

    Cycles run from start to start, or from start to the next end. An unfinished one ends with the series (or with `until`) and is left out of
    the times. An idle spell ends with the first other state; an unfinished one counts among the spells but not in their total. States are
    compared as they are written, or in either case.
    """
    keys = list(keys)
    own = series.time_range(states, since, until)
    fold = F.col("value") if case else F.lower("value")
    up, past = before(keys, "ts", "seq"), before(keys, "ts", "seq", end=-1)
    later = before(keys, F.desc("ts"), F.desc("seq"), end=-1)
    is_start, is_end, is_idle = (_same(F.col("value"), x, case) for x in (start, end, idle))
    own = own.withColumns({"state": fold, "is_start": is_start, "is_end": is_end, "is_idle": is_idle})
    own = own.withColumns({"was": F.lag("state").over(series.window(keys)), "was_idle": F.coalesce(F.lag("is_idle").over(series.window(keys)), F.lit(False))})
    turned = F.coalesce(F.col("was") != F.col("state"), F.lit(False))
    own = own.withColumns({"turned": turned, "begins_idle": F.col("is_idle") & ~F.col("was_idle")})
    edge = F.when(F.col("is_end"), "end").when(F.col("is_start"), "start")
    if end is None:
        begins, finish = F.col("is_start"), F.when(F.col("is_start"), F.col("ts"))
    else:
        begins, finish = F.col("is_start") & (F.coalesce(F.last(edge, ignorenulls=True).over(past), F.lit("end")) == "end"), F.when(F.col("is_end"), F.col("ts"))
    own = own.withColumns({
        "begins": begins, "finish": F.last(finish, ignorenulls=True).over(later), "leaves": F.last(F.when(~F.col("is_idle"), F.col("ts")), ignorenulls=True).over(later),
        "turned_before": F.last(F.when(F.col("turned"), F.col("ts")), ignorenulls=True).over(past),
    })
    number = lambda c: F.sum(F.col(c).cast("int")).over(up)
    own = own.withColumns({"cycle": number("begins"), "spell": number("begins_idle")})
    known = [x if case else x.lower() for x in (start, end, idle) if x is not None]
    shown = lambda when, n, stop: F.sort_array(F.collect_list(F.when(when & (n <= limit), F.struct(F.col("ts").alias("begin"), stop.alias("stop")))))
    done, quiet = F.col("begins") & F.col("finish").isNotNull(), F.col("begins_idle") & F.col("leaves").isNotNull()
    seconds, silence = F.when(done, F.col("finish") - F.col("ts")), F.when(quiet, F.col("leaves") - F.col("ts"))
    found = own.groupBy(*keys).agg(
        F.count("*").alias("in_range"), F.count(seconds).alias("cycles"), F.count_if(F.col("begins") & F.col("finish").isNull()).alias("incomplete"),
        F.avg(seconds).alias("avg_seconds"), F.min(seconds).alias("min_seconds"), F.max(seconds).alias("max_seconds"), shown(F.col("begins"), F.col("cycle"), F.col("finish")).alias("c"),
        F.coalesce(F.sum(silence), F.lit(0.0)).alias("idle_seconds"), F.count_if("begins_idle").alias("idle_spells"), F.max(F.when(F.col("begins_idle") & F.col("leaves").isNull(), F.col("ts"))).alias("open_idle"),
        shown(F.col("begins_idle"), F.col("spell"), F.col("leaves")).alias("d"),
        F.count_if(F.col("turned") & (F.col("ts") - F.col("turned_before") < RAPID_SECONDS)).alias("rapid"),
        F.sort_array(F.collect_set(F.when(F.col("value").isNotNull() & ~F.col("state").isin(known), F.col("value")))).alias("unknown"),
    )
    # The end of the series is that of all its samples, also those outside the range.
    out = states.groupBy(*keys).agg(F.count("*").alias("samples"), F.max("ts").alias("last")).join(found, keys, "left")
    bound = F.least(F.col("last"), F.lit(until)) if until is not None else F.col("last")
    spans = lambda column, tail: F.transform(F.coalesce(column, F.array().cast("array<struct<begin:double,stop:double>>")), lambda x: F.struct(x["begin"].alias("begin"), F.coalesce(x["stop"], tail).alias("end"), (F.coalesce(x["stop"], tail) - x["begin"]).alias("seconds"), x["stop"].isNull().alias("incomplete"))).cast(CYCLE)
    spent = F.col("idle_seconds") + F.coalesce(F.col("last") - F.col("open_idle"), F.lit(0.0))
    out = out.na.fill(0, ["cycles", "incomplete", "idle_seconds", "idle_spells", "rapid"])
    unknown = F.coalesce("unknown", F.array().cast("array<string>"))
    said = F.array_compact(F.array(
        F.when(F.col("rapid") > MANY_RAPID, F.format_string("%d state transitions less than 0.1 s apart: the state machine may be unstable", F.col("rapid"))),
        F.when(F.size(unknown).between(1, MANY_UNKNOWN), F.concat(F.lit("Unknown states: "), F.array_join(unknown, ", "))).when(F.size(unknown) > MANY_UNKNOWN, F.format_string("%d unknown states", F.size(unknown))),
        F.when(F.col("incomplete") > 0, F.format_string("%d unfinished cycle(s): leave them out of statistics", F.col("incomplete"))),
    ))
    out = out.select(
        *keys, "samples", "cycles", "incomplete", "avg_seconds", "min_seconds", "max_seconds", spans(F.col("c"), bound).alias("first_cycles"), "idle_seconds", "idle_spells",
        F.when(F.col("idle_spells") > 0, spent / F.col("idle_spells")).alias("avg_idle_seconds"), spans(F.col("d"), F.col("last")).alias("first_idle_spells"), "rapid", unknown.alias("unknown_states"), said.alias("warnings"),
    )
    if not measured:
        return out
    return quality.attach(out, quality.measure(states.select(*keys, "ts", "seq", F.lit(0.0).alias("value")), keys), keys, "analyze_cycles")
