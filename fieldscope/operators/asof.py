"""As-of joins of two series: hold the last value, interpolate, or match within a tolerance.

Both sides are put into one sequence ordered by time and looked at through running windows: one shuffle on the series key, linear in the rows.
What comes later is looked up as what came before in the reverse order: a frame that ends at the last row is computed anew for each row.
Interpolation takes the next row by `lead`, in the same order.

A series is the work of one task. With `every` the series are cut into spans of time, so that a series with a large share of all rows becomes many
tasks; the rows next to a span's ends are brought to it through a table of one row a span. A span lasts `every` seconds; with `every=AUTO` series of
more than LONG rows are cut into PARTS**2 spans of about as many rows each, by a sketch of their times.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN, AUTO = "__span", "auto"
#: Rows of a series beyond which AUTO cuts it; the square root of the number of its spans; the least number of tasks among which spans are dealt.
LONG, PARTS, TASKS = 100_000, 16, 256


def _union(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    nothing = F.lit(None).cast(f"struct<ts:double,seq:bigint,value:{right.schema['value'].dataType.simpleString()}>")
    own = left.select(*keys, "ts", "seq", F.struct(*left.columns).alias("row"), nothing.alias("other"), F.lit(1).alias("side"))
    other = right.select(*keys, "ts", "seq", F.lit(None).cast(own.schema["row"].dataType).alias("row"), F.struct(F.col("ts").cast("double").alias("ts"), F.col("seq").cast("bigint").alias("seq"), "value").alias("other"), F.lit(0).alias("side"))
    return own.unionByName(other)


def before(keys: Sequence[str], *order, end: int = 0):
    """The frame of the rows up to this one (or the one before it), in an order of columns."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)


def edges_of(column: str, parts: int = PARTS) -> Column:
    """The edges of parts**2 ranges of about as many values each: an aggregate, from a sketch."""
    return F.percentile_approx(column, [i / parts**2 for i in range(1, parts**2)], 10_000)


def range_of(column: str, edges: str = "edges", parts: int = PARTS) -> Column:
    """The number of edges below a value, looked for among every parts-th edge first."""
    below = lambda some: F.size(F.filter(some, lambda e: e < F.col(column)))
    far = below(F.transform(F.sequence(F.lit(parts), F.lit(parts**2 - parts), F.lit(parts)), lambda i: F.element_at(edges, i)))
    # The far edge is asked for once: a column is written out wherever it is used.
    near = F.transform(F.array(far), lambda n: n * parts + below(F.slice(edges, n * parts + 1, F.lit(parts - 1))))
    return near[0]


def _numbered(left: DataFrame, right: DataFrame, keys: Sequence[str], every: float | str) -> tuple[DataFrame, DataFrame]:
    """Both sides with the number of the span of each row; it grows with time."""
    if every != AUTO:
        span = F.floor(F.col("ts") / F.lit(float(every))).alias(SPAN)
        return left.select("*", span), right.select(*keys, "ts", "seq", "value", span)
    times = left.select(*keys, F.col("ts").cast("double").alias("ts")).unionByName(right.select(*keys, F.col("ts").cast("double").alias("ts")))
    cuts = times.groupBy(*keys).agg(F.count("*").alias("n"), edges_of("ts").alias("edges")).where(F.col("n") > LONG).select(*keys, F.col("edges").alias("__edges"))
    # There are at most rows / LONG long series: their edges are broadcast, since a join by keys would make one task of a series again.
    cut = lambda d: d.join(F.broadcast(cuts), list(keys), "left").withColumn(SPAN, F.when(F.col("__edges").isNull(), 0).otherwise(range_of("ts", "__edges"))).drop("__edges")
    return cut(left).select(*left.columns, SPAN), cut(right.select(*keys, "ts", "seq", "value"))


def _spans(left: DataFrame, right: DataFrame, keys: Sequence[str], every: float | str) -> tuple[DataFrame, DataFrame]:
    """Both sides with the number of their span; right also has, in each span of left, its last row before and its first row after the span."""
    own, other = _numbered(left, right, keys, every)
    row, at = F.struct("ts", "seq", "value"), F.struct("ts", "seq")
    ends = other.groupBy(*keys, SPAN).agg(F.min_by(row, at).alias("first"), F.max_by(row, at).alias("last"))
    wanted = own.select(*keys, SPAN).distinct().withColumn("wanted", F.lit(True))
    spans = ends.join(wanted, [*keys, SPAN], "full")
    up, down = before(keys, SPAN, end=-1), before(keys, F.desc(SPAN), end=-1)
    spans = spans.withColumns({"low": F.last("last", ignorenulls=True).over(up), "high": F.last("first", ignorenulls=True).over(down)}).where("wanted")
    carried = spans.select(*keys, SPAN, F.explode(F.array_compact(F.array("low", "high"))).alias("r")).select(*keys, "r.ts", "r.seq", "r.value", SPAN)
    return own, other.unionByName(carried)


def _joined(how, left: DataFrame, right: DataFrame, keys: Sequence[str], every: float | str | None) -> DataFrame:
    if every is None:
        return how(_union(left, right, keys), list(keys))
    by = [*keys, SPAN]
    tasks = max(TASKS, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return how(_union(*_spans(left, right, keys, every), by).repartition(tasks, *by), by).drop(SPAN)


def hold(left: DataFrame, right: DataFrame, keys: Sequence[str], every: float | str | None = None) -> DataFrame:
    """left with other_ts and other_value: of the last right row at or before its time (the last of equals), null before the first."""

    def run(both, keys):
        found = both.withColumn("found", F.last("other", ignorenulls=True).over(before(keys, "ts", "side", "seq"))).where("side = 1")
        return found.select("row.*", F.col("found.ts").alias("other_ts"), F.col("found.value").alias("other_value"))

    return _joined(run, left, right, keys, every)


def lerp(left: DataFrame, right: DataFrame, keys: Sequence[str], clamp: bool = False, every: float | str | None = None) -> DataFrame:
    """left with other_value interpolated between the right rows around its time; null (or the nearest end) outside their range."""

    def run(both, keys):
        later = F.expr("lead(other) IGNORE NULLS").over(Window.partitionBy(*keys).orderBy("ts", "side", "seq"))
        both = both.withColumns({"a": F.last("other", ignorenulls=True).over(before(keys, "ts", "side", "seq")), "b": later}).where("side = 1")
        t, a, b = F.col("row.ts"), F.col("a"), F.col("b")
        between = a["value"] + (b["value"] - a["value"]) * (t - a["ts"]) / F.nullif(b["ts"] - a["ts"], F.lit(0.0))
        value = F.when(a["ts"] == t, a["value"]).when(a.isNotNull() & b.isNotNull(), F.coalesce(between, a["value"]))
        value = F.coalesce(value, F.when(a.isNull(), b["value"]).when(b.isNull(), a["value"])) if clamp else value
        return both.select("row.*", value.alias("other_value"))

    return _joined(run, left, right.withColumn("value", F.col("value").cast("double")), keys, every)


def forward(left: DataFrame, right: DataFrame, keys: Sequence[str], tolerance: float, every: float | str | None = None) -> DataFrame:
    """left with the first right row at or after ts - tolerance, if it lies within the tolerance of ts; else null."""

    def run(both, keys):
        later = before(keys, F.desc("ts"), "side", F.desc("seq"))
        found = both.withColumn("found", F.last("other", ignorenulls=True).over(later)).where("side = 1")
        near = F.abs(F.col("found.ts") - F.col("row.__ts")) <= tolerance
        return found.select("row.*", F.when(near, F.col("found.ts")).alias("other_ts"), F.when(near, F.col("found.value")).alias("other_value"))

    early = left.withColumn("__ts", F.col("ts")).withColumn("ts", F.col("ts") - tolerance)
    return _joined(run, early, right, keys, every).withColumn("ts", F.col("__ts")).drop("__ts")
