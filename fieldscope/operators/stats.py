"""Aggregates: descriptive statistics, outlier fences, agreement of two series, regression, data quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldscope.model import finite
from fieldscope.operators.asof import before, hold, lerp
from fieldscope.operators.series import window


SHARES = (0.05, 0.25, 0.5, 0.75, 0.95)


def exact_percentiles(df: DataFrame, keys: Sequence[str], shares: Sequence[float] = SHARES, parts: int = 16) -> DataFrame:
    """keys, p: exact percentiles (an array, interpolated) of the finite values of each group, of which no task sees the whole.

    Edges from a sketch cut a group's values into parts**2 ranges; counts of the ranges tell in which one a rank lies and where, and only the
    distinct values of that range are ordered. A value that many rows share is counted before it is sent. The groups are few: their edges are
    broadcast, since a join by their keys would send all rows to as many tasks.
    """
    keys, ranges = list(keys), parts * parts
    v = df.where(finite(F.col("value"))).select(*keys, F.col("value").cast("double").alias("value"))
    edges = F.percentile_approx("value", [i / ranges for i in range(1, ranges)], 10_000)
    groups = v.groupBy(*keys).agg(edges.alias("edges"), F.count("*").alias("total"))
    # The number of edges below a value, looked for among every parts-th edge first.
    below = lambda some: F.size(F.filter(some, lambda e: e < F.col("value")))
    far = F.transform(F.sequence(F.lit(parts), F.lit(ranges - parts), F.lit(parts)), lambda i: F.element_at("edges", i))
    counted = v.groupBy(*keys, "value").agg(F.count("*").alias("n")).join(F.broadcast(groups.select(*keys, "edges")), keys)
    counted = counted.withColumn("far", below(far)).withColumn("part", F.col("far") * parts + below(F.slice("edges", F.col("far") * parts + 1, F.lit(parts - 1)))).select(*keys, "part", "value", "n")
    upto = before(keys, "part", end=-1)
    sizes = counted.groupBy(*keys, "part").agg(F.sum("n").alias("held")).withColumn("earlier", F.coalesce(F.sum("held").over(upto), F.lit(0)))
    place = F.col("share") * (F.col("total") - 1)
    asked = groups.select(*keys, "total", F.posexplode(F.array(*(F.lit(float(x)) for x in shares))).alias("i", "share")).select(*keys, "i", place.alias("place"), F.explode(F.array(F.floor(place), F.ceil(place))).alias("rank"))
    asked = asked.distinct().join(sizes, keys).where("rank >= earlier and rank < earlier + held").select(*keys, "part", "i", "place", "rank", (F.col("rank") - F.col("earlier")).alias("local"))
    within = counted.join(F.broadcast(asked.select(*keys, "part").distinct()), [*keys, "part"], "left_semi")
    within = within.withColumn("c0", F.coalesce(F.sum("n").over(before([*keys, "part"], "value", end=-1)), F.lit(0)))
    found = within.join(asked, [*keys, "part"]).where("local >= c0 and local < c0 + n")
    by = F.struct("rank")
    ends = found.groupBy(*keys, "i", "place").agg(F.min_by("value", by).alias("low"), F.max_by("value", by).alias("high"), F.min("rank").alias("rank"))
    between = (F.col("rank") + 1 - F.col("place")) * F.col("low") + (F.col("place") - F.col("rank")) * F.col("high")
    value = F.when(F.col("place") == F.col("rank"), F.col("low")).otherwise(between)
    return ends.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", value.alias("v")))).alias("p")).select(*keys, F.transform("p", lambda x: x["v"]).alias("p"))


def describe(df: DataFrame, keys: Sequence[str], split: bool = False) -> DataFrame:
    """count, min, max, mean, median, std_dev (0 for one value), q1, q3, iqr, p5, p95 of the finite values. Percentiles are exact.

    One pass, in which the distinct values of a group meet in one task; with `split` several, in which they do not (see exact_percentiles).
    """
    own = df.where(finite(F.col("value")))
    p = [] if split else [F.percentile("value", F.array(*map(F.lit, SHARES))).alias("p")]
    out = own.groupBy(*keys).agg(F.count("*").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std_dev"), *p)
    out = out.join(F.broadcast(exact_percentiles(own, keys)), list(keys)) if split else out
    return out.select(*keys, "count", "min", "max", "mean", F.col("p")[2].alias("median"), "std_dev", F.col("p")[1].alias("q1"), F.col("p")[3].alias("q3"), (F.col("p")[3] - F.col("p")[1]).alias("iqr"), F.col("p")[0].alias("p5"), F.col("p")[4].alias("p95"))


def detect_anomalies(df: DataFrame, keys: Sequence[str], k: float = 1.5, split: bool = False) -> DataFrame:
    """Rows strictly outside the fences q1 - k iqr and q3 + k iqr of their series, where it has four finite values or more.

    With `split` (few series, see describe) the fences are broadcast and the rows stay where they are.
    """
    fences = describe(df, keys, split).where("count >= 4").select(*keys, (F.col("q1") - k * F.col("iqr")).alias("low"), (F.col("q3") + k * F.col("iqr")).alias("high"))
    return df.where(finite(F.col("value"))).join(F.broadcast(fences) if split else fences, list(keys)).where("value < low or value > high")


def compare(left: DataFrame, right: DataFrame, keys: Sequence[str], every: float | str | None = None) -> DataFrame:
    """n, rmse, max_diff of left against right interpolated at its times; `every`: see asof."""
    e = F.col("value") - F.col("other_value")
    return lerp(left, right, keys, every=every).where("other_value is not null").groupBy(*keys).agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.max(F.abs(e)).alias("max_diff"))


def correlation(x: str = "value", y: str = "other_value") -> Column:
    """Pearson's r, clamped; null where a side hardly varies."""
    n, spread = F.count("*"), F.var_pop(x) * F.var_pop(y)
    flat = (F.var_pop(x) * n < 1e-15 * n) | (F.var_pop(y) * n < 1e-15 * n)
    return F.when(~flat, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.covar_pop(x, y) / F.sqrt(F.nullif(spread, F.lit(0.0))))))


def normal_cdf(x: Column) -> Column:
    """A polynomial approximation of the normal distribution (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    # Fixed values of the formula.
    poly = F.lit(0.0)
    for c in (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530):
        poly = (poly + c) * t
    tail = F.exp(-x * x / 2) / 2.5066282746310002 * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def p_value(r: Column, n: Column) -> Column:
    """Two-sided, of Student's t by a normal expansion with its correction terms (Abramowitz and Stegun 26.7.4).

    1 for n <= 2 and where there is no correlation, null for n < 15, 0 for |r| = 1.
    """
    df = n - 2
    t2 = r * r * df / F.nullif(1 - r * r, F.lit(0.0))
    a = df - 0.5
    b = 48 * a * a
    z = F.sqrt(a * F.log1p(t2 / df))
    cubed = F.pow(z, 3)
    # Fixed values of the formula.
    more = 4 * F.pow(z, 7) + 33 * F.pow(z, 5) + 240 * cubed + 855 * z
    deviate = z + (cubed + 3 * z) / b - more / (10 * b * b)
    return F.when((n <= 2) | r.isNull(), 1.0).when(n < 15, None).when(F.abs(r) >= 1, 0.0).otherwise(2 * (1 - normal_cdf(deviate)))


def time_correlate(left: DataFrame, right: DataFrame, keys: Sequence[str], every: float | str | None = None) -> DataFrame:
    """n, r, p_value of left against right interpolated at its times; series with two pairs or more. `every`: see asof."""
    a, b = (d.where(finite(F.col("value"))) for d in (left, right))
    out = lerp(a, b, keys, every=every).where("other_value is not null").groupBy(*keys).agg(F.count("*").alias("n"), correlation().alias("r")).where("n >= 2")
    return out.withColumn("p_value", p_value(F.col("r"), F.col("n")))


def regression(df: DataFrame, keys: Sequence[str], y: str, a: str, b: str, relative: float = 1e-12, absolute: float = 0.0) -> DataFrame:
    """y = ca * a + cb * b through the origin: n, ca, cb, r2 (uncentred), rmse; null coefficients if a and b are collinear.

    They are where the determinant is below `relative` of the product of the squares, or below `absolute`.
    """
    terms = ((a, a), (a, b), (b, b), (y, a), (y, b), (y, y))
    sums = df.groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(F.col(p) * F.col(q)).alias(f"s{i}") for i, (p, q) in enumerate(terms)))
    aa, ab, bb, ya, yb, yy = (F.col(f"s{i}") for i in range(6))
    det = F.nullif(aa * bb - ab * ab, F.lit(0.0))
    ok = F.abs(det) >= F.greatest(relative * aa * bb, F.lit(absolute))
    out = sums.withColumn("ca", F.when(ok, (ya * bb - yb * ab) / det)).withColumn("cb", F.when(ok, (yb * aa - ya * ab) / det))
    rest = yy - F.col("ca") * ya - F.col("cb") * yb
    return out.select(*keys, "n", "ca", "cb", (1 - rest / F.nullif(yy, F.lit(0.0))).alias("r2"), F.sqrt(F.greatest(rest, F.lit(0.0)) / F.col("n")).alias("rmse"))


def data_quality(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n, rate, span, gaps (intervals over five medians), jitter, non-finite values, score and confidence of each series.

    One shuffle and one order of a series give its intervals, their median and what is counted against it.
    """
    whole = Window.partitionBy(*keys)
    steps = df.withColumn("dt", F.col("ts") - F.lag("ts").over(window(keys))).withColumn("median", F.percentile("dt", 0.5).over(whole))
    gap = F.when(F.col("dt") > 5 * F.col("median"), F.col("dt"))
    d = steps.groupBy(*keys).agg(
        F.first("median").alias("median"), F.count("*").alias("n"), F.sum((~finite(F.col("value"))).cast("long")).alias("bad"), (F.max("ts") - F.min("ts")).alias("span"),
        F.count(gap).alias("gaps"), F.coalesce(F.max(gap), F.lit(0.0)).alias("max_gap"), F.coalesce(F.sum(gap), F.lit(0.0)).alias("gap_time"), F.sum(F.pow(F.col("dt") - F.col("median"), 2)).alias("squares"),
    )
    jitter = F.when(F.col("n") > 2, F.sqrt(F.col("squares") / (F.col("n") - 2))).otherwise(0.0)
    d = d.withColumn("jitter", jitter)
    few = F.when(F.col("n") < 100, 1.0).when(F.col("n") < 500, 0.5).otherwise(0.0)
    uneven = F.when(F.col("median") > 0, F.least(F.col("jitter") / F.nullif(F.col("median"), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    score = 1 - 0.3 * F.least(F.col("gaps") / 20, F.lit(1.0)) - 0.2 * F.least(F.col("bad") / F.col("n"), F.lit(1.0)) - 0.3 * few - 0.2 * uneven
    d = d.withColumn("score", F.when(F.col("n") == 1, 0.4).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))))
    high = (F.col("score") > 0.8) & (F.col("gap_time") <= 0.1 * F.col("span"))
    confidence = F.when(high, "high").when(F.col("score") > 0.5, "medium").when(F.col("score") > 0.2, "low").otherwise("insufficient")
    rate = F.when(F.col("median") > 0, 1 / F.nullif(F.col("median"), F.lit(0.0))).otherwise(0.0)
    return d.select(*keys, "n", rate.alias("rate"), "span", "gaps", "max_gap", "gap_time", "jitter", "bad", "score", confidence.alias("confidence"))


def circular_mean(angle: str) -> Column:
    return F.atan2(F.sum(F.sin(angle)), F.sum(F.cos(angle)))


def loop_timing(df: DataFrame, keys: Sequence[str], threshold_ms: float = 20.0, unit: str = "auto") -> DataFrame:
    """Milliseconds of loop times: avg, max, min, p95, p99, violations, health. The unit is taken from the median unless given."""
    medians = df.groupBy(*keys).agg(F.percentile("value", 0.5).alias("median"))
    scale = F.when((F.col("median") >= 0.001) & (F.col("median") < 1), 1000.0).when(F.col("median") > 500, 0.001).otherwise(1.0) if unit == "auto" else F.lit({"s": 1000.0, "ms": 1.0, "us": 0.001}[unit])
    ms = df.join(medians, list(keys)).withColumn("ms", F.col("value") * scale)
    p = F.percentile("ms", F.array(F.lit(0.95), F.lit(0.99)))
    over = F.sum((F.col("ms") > threshold_ms).cast("long"))
    out = ms.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("ms").alias("avg_ms"), F.max("ms").alias("max_ms"), F.min("ms").alias("min_ms"), p.alias("p"), over.alias("violations"))
    return out.select(*keys, "n", "avg_ms", "max_ms", "min_ms", F.col("p")[0].alias("p95_ms"), F.col("p")[1].alias("p99_ms"), "violations", F.floor(100 - 100 * F.col("violations") / F.col("n")).cast("long").alias("health"))


def first_of(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by("value", F.struct("ts", "seq")).alias("value"))


def high_variance_window(df: DataFrame, keys: Sequence[str], seconds: float) -> DataFrame:
    """The begin of the window of `seconds` with the largest variance of the finite values in each series.

    Sums up to each time, of values less their mean, give every window's variance as a difference of two: linear, whatever a window holds.
    The variance that is returned is that of the best window's own values.
    """
    keys = list(keys)
    centred = df.where(finite(F.col("value"))).withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy(*keys)))
    v = F.col("value")
    at = centred.groupBy(*keys, "ts").agg(F.count("*").cast("double").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    upto = before(keys, "ts")
    sums = at.withColumns({f"{c}_upto": F.sum(c).over(upto) for c in ("n", "s", "q")}).withColumn("seq", F.lit(0).cast("long"))
    right = sums.select(*keys, "ts", "seq", F.struct(*(F.col(f"{c}_upto").alias(c) for c in ("n", "s", "q"))).alias("value"))
    left = sums.select(*keys, F.col("ts").alias("begin"), (F.col("ts") + float(seconds)).alias("ts"), "seq", *((F.col(f"{c}_upto") - F.col(c)).alias(f"{c}0") for c in ("n", "s", "q")))
    n, total, squares = (F.col(f"other_value.{c}") - F.col(f"{c}0") for c in ("n", "s", "q"))
    spread = F.when(n > 1, F.greatest((squares - total * total / n) / F.nullif(n - 1, F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    found = hold(left, right, keys).withColumn("spread", spread)
    best = found.groupBy(*keys).agg(F.max_by("begin", F.struct("spread", -F.col("begin"))).alias("begin"))
    inside = df.where(finite(F.col("value"))).join(best, keys).where((F.col("ts") >= F.col("begin")) & (F.col("ts") <= F.col("begin") + float(seconds)))
    return inside.groupBy(*keys, "begin").agg(F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("variance"))
