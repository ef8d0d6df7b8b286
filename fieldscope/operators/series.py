"""Windows over series. A series is the rows of equal keys, in the order of (ts, seq)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldscope.model import finite


def window(keys: Sequence[str], order: Sequence[str] = ("ts", "seq")):
    return Window.partitionBy(*keys).orderBy(*order)


def time_range(df: DataFrame, start: float | None = None, end: float | None = None) -> DataFrame:
    """Inclusive at both ends."""
    df = df if start is None else df.where(F.col("ts") >= start)
    return df if end is None else df.where(F.col("ts") <= end)


def condition(op: str, threshold: float) -> Column:
    """lt, lte, gt, gte or eq (within a relative 1e-6 and an absolute 1e-9), false for NaN."""
    v, t = F.col("value"), F.lit(float(threshold))
    ops = {"lt": v < t, "lte": v <= t, "gt": v > t, "gte": v >= t, "eq": F.abs(v - t) <= max(1e-9, abs(threshold) * 1e-6)}
    names = {"<": "lt", "<=": "lte", ">": "gt", ">=": "gte", "==": "eq"}
    return F.coalesce(~F.isnan(v) & ops[names.get(op, op)], F.lit(False))


def find_condition(df: DataFrame, keys: Sequence[str], op: str, threshold: float) -> DataFrame:
    """Rows where the condition becomes true; a first row that is true counts."""
    p = df.withColumn("p", condition(op, threshold))
    return p.withColumn("before", F.coalesce(F.lag("p").over(window(keys)), F.lit(False))).where("p and not before").drop("p", "before")


def find_peaks(df: DataFrame, keys: Sequence[str], kind: str = "both", min_height: float | None = None, limit: int | None = None) -> DataFrame:
    """Rows strictly above (below) both neighbours, with kind and height (the larger difference)."""
    w = window(keys)
    n = df.where(finite(F.col("value"))).withColumn("prev", F.lag("value").over(w)).withColumn("next", F.lead("value").over(w))
    high, low = (F.col("value") > F.col("prev")) & (F.col("value") > F.col("next")), (F.col("value") < F.col("prev")) & (F.col("value") < F.col("next"))
    found = n.withColumn("kind", F.when(high, "maximum").when(low, "minimum")).where("kind is not null")
    found = found.withColumn("height", F.greatest(F.abs(F.col("value") - F.col("prev")), F.abs(F.col("value") - F.col("next")))).drop("prev", "next")
    if kind != "both":
        found = found.where(F.col("kind") == kind)
    if min_height is not None:
        found = found.where(F.col("height") >= min_height)
    if limit is not None:
        found = found.withColumn("rn", F.row_number().over(window([*keys, "kind"]))).where(F.col("rn") <= limit).drop("rn")
    return found


def rate_of_change(df: DataFrame, keys: Sequence[str], window_size: int = 1) -> DataFrame:
    """Derivative: forward, central and backward differences, or over `window_size` rows; rows without time between are left out."""
    w = window(keys)
    rows = df.where(finite(F.col("value")))
    if window_size > 1:
        v0, t0, v1, t1 = F.lag("value", window_size).over(w), F.lag("ts", window_size).over(w), F.col("value"), F.col("ts")
    else:
        v0, t0 = F.coalesce(F.lag("value").over(w), F.col("value")), F.coalesce(F.lag("ts").over(w), F.col("ts"))
        v1, t1 = F.coalesce(F.lead("value").over(w), F.col("value")), F.coalesce(F.lead("ts").over(w), F.col("ts"))
    d = rows.select("*", (v1 - v0).alias("dv"), (t1 - t0).alias("dt")).where("dt > 0")
    return d.withColumn("rate", F.col("dv") / F.col("dt")).drop("dv", "dt")


def moving_average(df: DataFrame, keys: Sequence[str], half: int) -> DataFrame:
    return df.withColumn("smooth", F.avg("value").over(window(keys).rowsBetween(-half, half)))


def gradient(df: DataFrame, keys: Sequence[str], column: str = "value", out: str = "gradient") -> DataFrame:
    """One-sided at the ends, central inside, null where hardly any time lies between."""
    w = window(keys)
    v0, t0 = F.coalesce(F.lag(column).over(w), F.col(column)), F.coalesce(F.lag("ts").over(w), F.col("ts"))
    v1, t1 = F.coalesce(F.lead(column).over(w), F.col(column)), F.coalesce(F.lead("ts").over(w), F.col("ts"))
    d = df.select("*", v0.alias("v0"), v1.alias("v1"), (t1 - t0).alias("dt"))
    return d.withColumn(out, F.when(F.col("dt") > 1e-9, (F.col("v1") - F.col("v0")) / F.col("dt"))).drop("v0", "v1", "dt")


def changes(df: DataFrame, keys: Sequence[str], column: str = "value") -> DataFrame:
    """Rows whose value differs from the one before; the first row counts."""
    w = window(keys)
    marked = df.withColumn("same", F.lag(column).over(w).eqNullSafe(F.col(column)) & (F.row_number().over(w) > 1))
    return marked.where("not same").drop("same")


def quick_changes(df: DataFrame, keys: Sequence[str], within: float, column: str = "value") -> DataFrame:
    """Changes that follow the change before in less than `within` seconds (flicker, rapid transitions); the first row is no change."""
    w = window(keys)
    moved = df.withColumn("was", F.lag(column).over(w)).where(F.col("was").isNotNull() & (F.col("was") != F.col(column))).drop("was")
    return moved.withColumn("gap", F.col("ts") - F.lag("ts").over(w)).where(F.col("gap") < within)


def hysteresis(df: DataFrame, keys: Sequence[str], enter: float, leave: float) -> DataFrame:
    """Events that begin below `enter` and end at `leave` or above: begin, end (the last row's time if still open), closed, lowest."""
    w = window(keys)
    rows = df.where(finite(F.col("value")))
    mark = F.when(F.col("value") < enter, 1).when(F.col("value") >= leave, 0)
    state = rows.withColumn("state", F.coalesce(F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    begun = state.withColumn("begun", ((F.col("state") == 1) & (F.coalesce(F.lag("state").over(w), F.lit(0)) == 0)).cast("int"))
    event = begun.withColumn("event", F.sum("begun").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("event > 0")
    low = F.when(F.col("state") == 1, F.col("value"))
    return event.groupBy(*keys, "event").agg(
        F.min("ts").alias("begin"), F.coalesce(F.min(F.when(F.col("state") == 0, F.col("ts"))), F.max("ts")).alias("end"),
        (F.min("state") == 0).alias("closed"), F.min(low).alias("lowest"),
    )


def islands(df: DataFrame, keys: Sequence[str], predicate: Column, flush: bool = False) -> DataFrame:
    """Runs of rows that satisfy the predicate: begin, end (the first row that does not), peak. Open runs only with flush."""
    w = window(keys)
    flips = df.withColumn("on", F.coalesce(predicate, F.lit(False))).withColumn("run", F.sum((F.col("on") & ~F.coalesce(F.lag("on").over(w), F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = flips.where("run > 0").groupBy(*keys, "run").agg(F.min("ts").alias("begin"), F.min(F.when(~F.col("on"), F.col("ts"))).alias("end"), F.max(F.when(F.col("on"), F.col("value"))).alias("peak"), F.max(F.when(F.col("on"), F.col("ts"))).alias("last"))
    runs = runs.withColumn("end", F.coalesce("end", "last")) if flush else runs.where("end is not null")
    return runs.drop("last", "run")


def recovery(df: DataFrame, keys: Sequence[str], drop: float, share: float, horizon: float) -> DataFrame:
    """For each fall by more than `drop`, the seconds until `share` of it is made up, within the horizon.

    Falls, which are few, meet the rows of their own and the next bucket of time, a horizon wide.
    """
    before = df.withColumn("before", F.lag("value").over(window(keys))).where(F.col("before") - F.col("value") > drop)
    bucket = F.floor(F.col("ts") / horizon)
    falls = before.withColumn("target", F.col("value") + share * (F.col("before") - F.col("value"))).withColumn("bucket", F.explode(F.array(bucket, bucket + 1)))
    later = df.select(*keys, F.col("ts").alias("t"), F.col("seq").alias("s"), F.col("value").alias("v"), bucket.alias("bucket"))
    after = "(t > ts or t = ts and s > seq)"
    met = falls.join(later, [*keys, "bucket"]).where(f"{after} and t - ts <= {float(horizon)!r}D and v >= target")
    return met.groupBy(*keys, "ts", "seq", "value", "before").agg((F.min("t") - F.col("ts")).alias("seconds"))


def jumps(df: DataFrame, keys: Sequence[str], x: str, y: str, least: float, order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Rows that lie further than `least` from the row before, with the distance."""
    w = window(keys, order)
    far = df.withColumn("distance", F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)))
    return far.where(F.col("distance") > least)


def segments_by_setpoint(df: DataFrame, keys: Sequence[str], least: float = 0.01, share: float = 0.05) -> DataFrame:
    """A new segment begins where the setpoint moves by more than max(share * last accepted, least): sequential by definition.

    Each task reads its series in order, batch by batch, and holds no more than the last accepted value of the series at hand.
    """
    keys = list(keys)

    def run(batches):
        import pyarrow as pa

        series, last, segment = None, None, 0
        for b in batches:
            out = []
            for at, v in zip(zip(*(b.column(k).to_pylist() for k in keys), strict=True), b.column("value").to_pylist(), strict=True):
                if at != series:
                    series, last, segment = at, None, 0
                if v is not None and (last is None or abs(v - last) > max(abs(last) * share, least)):
                    segment, last = segment + 1, v
                out.append(segment)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], [*b.schema.names, "segment"])

    ordered = df.repartition(*keys).sortWithinPartitions(*keys, "ts", "seq")
    return ordered.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", segment long")


def cycles(df: DataFrame, keys: Sequence[str], start: str, end: str | None = None, column: str = "value") -> DataFrame:
    """begin, end, seconds of cycles of a state series: from start to start, or from start to the next end; an unfinished one has no end."""
    w = window(keys)
    if end is None:
        return df.where(F.col(column) == start).withColumn("end", F.lead("ts").over(w)).select(*keys, F.col("ts").alias("begin"), "end", (F.col("end") - F.col("ts")).alias("seconds"))
    edges = df.where(F.col(column).isin(start, end))
    edges = edges.withColumn("was", F.lag(column).over(w)).where(F.col("was").isNull() | (F.col("was") != F.col(column))).withColumn("end", F.lead("ts").over(w))
    return edges.where(F.col(column) == start).select(*keys, F.col("ts").alias("begin"), "end", (F.col("end") - F.col("ts")).alias("seconds"))


def dead_time(df: DataFrame, keys: Sequence[str], idle: str, column: str = "value") -> DataFrame:
    """Seconds spent in the idle state, a series."""
    spans = changes(df, keys, column).withColumn("until", F.lead("ts").over(window(keys)))
    return spans.where(F.col(column) == idle).groupBy(*keys).agg(F.sum(F.col("until") - F.col("ts")).alias("seconds"), F.count("*").alias("n"))
