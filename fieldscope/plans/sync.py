"""Clock alignment of a robot's log and a motor-controller log.

Wall-clock records of the log and the other file's name give a coarse offset. Pairs of series that may hold the same quantity (see pairing) are
correlated around it; the offsets that correlate agree on a median with a confidence. Long recordings are correlated in halves too, whose
offsets differ by the drift of the clocks.

Spark prepares each pair: the most active window of the second series and the span of the first that it can meet, so a task holds a bounded
time of two series however long the logs are. numpy correlates a pair by FFT; a task reads its pairs one after another from sorted rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldscope.functions.values import number
from fieldscope.model import entries_of, finite
from fieldscope.operators import asof, pairing

RATE, MAX_LAG, OVERLAP = 100.0, 6000, 0.3
#: Seconds of a series that are correlated; its parts when the most active one is sought; samples that it needs.
WINDOW, PARTS, LEAST_SAMPLES = 600.0, 50, 10
FLAT, LEAST_OVERLAP, AT_EDGE = 1e-6, 30, 0.7
STRONG, USABLE = 0.7, 0.5
#: Drift: seconds of a recording and of a signal, samples of a half, seconds between the halves, ns a second.
LONG_RECORDING, LONG_SIGNAL, HALF_SAMPLES, APART, LEAST_DRIFT = 900.0, 600.0, 100, 60.0, 1.0
#: Rows of results that a task hands over at once; the least number of tasks that correlate.
ROWS, TASKS = 1000, 64


def grid(t, v, rate: float, longest: float) -> tuple[float, np.ndarray]:
    """The first time, and the values at equal steps from it, over `longest` seconds at most."""
    t, v = np.asarray(t, float), np.asarray(v, float)
    end = min(t[-1], t[0] + longest)
    return float(t[0]), np.interp(np.arange(t[0], end + 0.5 / rate, 1 / rate), t, v)


def best_lag(t1, v1, t2, v2, rate: float = RATE, max_lag: int = MAX_LAG, centre: float | None = None, longest: float = WINDOW + 4 * MAX_LAG / RATE) -> tuple[float, float]:
    """(seconds to add to the second clock, correlation) at the peak, refined by a parabola.

    Lags up to max_lag steps around the one that the offset `centre` means are tried; without it around that at which both series begin.
    """
    return best_lag_of_grids(grid(t1, v1, rate, longest), grid(t2, v2, rate, longest), rate, max_lag, centre)


def best_lag_of_grids(first, second, rate: float, max_lag: int, centre: float | None) -> tuple[float, float]:
    """As best_lag, of two grids. Products are summed by an FFT that is as long as these lags need, all else by running sums."""
    (s1, a), (s2, b) = first, second
    middle = 0 if centre is None else round((s2 + centre - s1) * rate)
    low, high = max(middle - max_lag, 1 - len(b)), min(middle + max_lag, len(a) - 1)
    if high < low:
        return float("nan"), 0.0
    lags = np.arange(low, high + 1)
    smaller = min(len(a), len(b))
    a, b = a - a.mean(), b - b.mean()
    # Sums that wrap around stand at other lags than these.
    n = 1 << int(max(len(a), len(b), len(a) - low, len(b) + high) - 1).bit_length()
    sab = np.fft.irfft(np.fft.rfft(a, n) * np.conj(np.fft.rfft(b, n)), n)[lags % n]
    begin, end = np.maximum(-lags, 0), np.minimum(len(b), len(a) - lags)
    m = end - begin
    running = lambda x: np.concatenate(([0.0], np.cumsum(x)))
    over = lambda x, shift: (lambda c: c[end + shift] - c[begin + shift])(running(x))
    sa, saa, sb, sbb = over(a, lags), over(a * a, lags), over(b, 0), over(b * b, 0)
    enough = m >= max(LEAST_OVERLAP, OVERLAP * smaller)
    var = np.maximum(saa / m - (sa / m) ** 2, 0) * np.maximum(sbb / m - (sb / m) ** 2, 0)
    r = np.where(enough & (var > 1e-12), (sab / m - sa * sb / m**2) / np.sqrt(np.maximum(var, 1e-12)), -1.0)
    i = int(np.argmax(r))
    peak, shift = float(r[i]), 0.0
    if 0 < i < len(r) - 1:
        left, right = r[i - 1], r[i + 1]
        bend = left - 2 * r[i] + right
        shift = 0.5 * (left - right) / bend if bend < 0 else 0.0
    else:
        peak *= AT_EDGE
    return s1 - s2 + (lags[i] + shift) / rate, peak


def active_windows(df: DataFrame, keys: Sequence[str], seconds: float = WINDOW) -> DataFrame:
    """keys, begin, end: the window of `seconds` of most variance in each series, all of a series that is not longer.

    Moments of parts of the window are counted first, so that a window sums a fixed number of them, however many its samples.
    """
    width = seconds / PARTS
    part = F.floor(F.col("ts") / F.lit(width)).alias("part")
    sums = df.where(finite(F.col("value"))).groupBy(*keys, part).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.var_pop("value"), F.lit(0.0)).alias("spread"))
    series = Window.partitionBy(*keys)
    centred = F.col("mean") - F.sum(F.col("n") * F.col("mean")).over(series) / F.sum("n").over(series)
    sums = sums.withColumns({"mean": centred, "first": F.min("part").over(series), "last": F.max("part").over(series)})
    over = series.orderBy("part").rangeBetween(0, PARTS - 1)
    n, s = F.sum("n").over(over), F.sum(F.col("n") * F.col("mean")).over(over)
    squares = F.sum(F.col("n") * (F.col("spread") + F.col("mean") * F.col("mean"))).over(over)
    variance = F.when(n >= LEAST_SAMPLES, (squares - s * s / n) / (n - 1))
    whole = F.col("last") - F.col("first") < PARTS
    ranked = sums.withColumn("variance", variance).where(~whole | (F.col("part") == F.col("first")))
    best = ranked.groupBy(*keys).agg(F.max_by("part", F.struct(F.coalesce("variance", F.lit(-1.0)), -F.col("part"))).alias("part"))
    return best.select(*keys, (F.col("part") * width).alias("begin"), ((F.col("part") + PARTS) * width).alias("end"))


def paired(a, b, centre: float, rate: float, max_lag: int):
    """(offset, correlation, samples, middle) of two prepared series (times in order, values); no offset where they are too short, flat or apart."""
    (ta, va), (tb, vb) = ((t[ok], v[ok]) for t, v in (a, b) for ok in (np.isfinite(v),))
    failed = None, 0.0, 0, None
    if min(len(ta), len(tb)) < LEAST_SAMPLES:
        return failed
    longest = WINDOW + 4 * max_lag / rate
    one, two = grid(ta, va, rate, longest), grid(tb, vb, rate, longest)
    x, y = one[1], two[1]
    if min(len(x), len(y)) < LEAST_OVERLAP or min(np.std(x, ddof=1), np.std(y, ddof=1)) < FLAT:
        return failed
    offset, r = best_lag_of_grids(one, two, rate, max_lag, centre)
    return (float(offset), float(r), min(len(x), len(y)), float(np.median(tb))) if np.isfinite(offset) and r > -0.5 else failed


def together(frames: Iterable[pd.DataFrame], keys: Sequence[str], columns: Sequence[str]) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """(key, arrays of the columns) of frames in which the rows of a key follow each other; the rows of one key and one frame are held."""
    held, last = [], None
    whole = lambda: held[0] if len(held) == 1 else [np.concatenate(c) for c in zip(*held, strict=True)]
    for d in frames:
        if d.empty:
            continue
        own, values = d[list(keys)], [d[c].to_numpy() for c in columns]
        starts = np.flatnonzero((own != own.shift()).any(axis=1))
        for i, j, key in zip(starts, [*starts[1:], len(d)], own.iloc[starts].itertuples(index=False, name=None), strict=True):
            if held and key != last:
                yield last, whole()
                held = []
            last = key
            held.append([v[i:j] for v in values])
    if held:
        yield last, whole()


PAIR = "offset double, correlation double, samples int, middle double"
HALVES = "offset_1 double, correlation_1 double, middle_1 double, offset_2 double, correlation_2 double, middle_2 double"


def correlate(first: DataFrame, second: DataFrame, keys: Sequence[str], centres: DataFrame | None = None, drift_over: float | None = None, rate: float = RATE, max_lag: int = MAX_LAG) -> DataFrame:
    """keys, offset (seconds to add to the second clock), correlation, samples, middle of the window, and the same of halves.

    centres (keys, centre) are the offsets around which to search; without one, that at which both series begin. Halves are correlated around
    the whole's offset where the second series covers more than `drift_over` seconds; without it none are.
    """
    keys = list(keys)
    reach = max_lag / rate
    begins = [d.groupBy(*keys).agg(F.min("ts").alias(n), F.max("ts").alias(f"{n}_end")) for d, n in ((first, "t1"), (second, "t2"))]
    span = begins[0].join(begins[1], keys)
    centre = F.col("t1") - F.col("t2")
    if centres is not None:
        span, centre = span.join(centres.select(*keys, "centre"), keys, "left"), F.coalesce("centre", centre)
    span = span.select(*keys, centre.alias("centre"), ((F.col("t2") + F.col("t2_end")) / 2).alias("mid"), (F.col("t2_end") - F.col("t2")).alias("covers"))
    own = second.select(*keys, "ts", F.col("value").cast("double").alias("value")).join(span, keys)
    if drift_over is None:
        own = own.withColumn("half", F.lit(0))
    else:
        half = F.when(F.col("ts") < F.col("mid"), 1).otherwise(2)
        own = own.withColumn("half", F.explode(F.when(F.col("covers") > drift_over, F.array(F.lit(0), half)).otherwise(F.array(F.lit(0)))))
    windows = active_windows(own, [*keys, "half"])
    own = own.join(windows, [*keys, "half"]).where("ts >= begin and ts < end")
    # The first series can meet the window anywhere within reach of the centre; a half is searched around an offset found within it.
    wide = F.lit(reach) * F.when(F.col("half") == 0, 1).otherwise(2)
    met = windows.join(span, keys).select(*keys, "half", "centre", (F.col("begin") + F.col("centre") - wide).alias("low"), (F.col("end") + F.col("centre") + wide).alias("high"))
    other = first.select(*keys, "ts", F.col("value").cast("double").alias("value")).join(met, keys).where("ts between low and high")

    columns = [*keys, *(c.split()[0] for c in f"{PAIR}, {HALVES}".split(", "))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for key, (part, centre, ts, value) in together(frames, keys, ("part", "centre", "ts", "value")):
            cuts = np.searchsorted(part, range(7))
            series = [(ts[i:j], value[i:j]) for i, j in itertools.pairwise(cuts)]
            whole = paired(series[0], series[3], float(centre[0]), rate, max_lag)
            row = [*key, *whole]
            for x, y in zip(series[1:3], series[4:], strict=True):
                usable = whole[0] is not None and min(len(x[0]), len(y[0])) >= HALF_SAMPLES
                offset, r, _, middle = paired(x, y, whole[0], rate, max_lag) if usable else (None, None, 0, None)
                row += [offset, r, middle]
            rows.append(row)
            if len(rows) == ROWS:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    kinds = ", ".join(f"{k} {first.schema[k].dataType.simpleString()}" for k in keys)
    # A part is one of both sides and of the whole and its halves. Sorted rows come in batches of many pairs: a pair is too little for a batch of
    # its own. They are few bytes for the work that they make, so that their number of tasks is not left to their size.
    part = lambda d, side: d.select(*keys, (F.col("half") + 3 * side).alias("part"), "centre", "ts", "value")
    tasks = max(TASKS, int(first.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = part(other, 0).unionByName(part(own, 1)).repartition(tasks, *keys).sortWithinPartitions(*keys, "part", "ts", "value")
    return rows.mapInPandas(run, f"{kinds}, {PAIR}, {HALVES}")


def consensus(pairs: DataFrame, keys: Sequence[str], least: float = 0.3, full_pairs: int = 3, spread: float = 0.05) -> DataFrame:
    """The median offset (seconds) of the pairs that correlate, with a confidence of up to 0.4 for the mean correlation, 0.3 for the number of
    pairs and 0.3 for how little their offsets deviate from the median, and its level."""
    good = pairs.where(F.col("correlation") >= least)
    medians = good.groupBy(*keys).agg(F.percentile("offset", 0.5).alias("median"), F.avg("correlation").alias("mean"), F.count("*").alias("pairs"))
    off = F.pow(F.col("offset") - F.col("median"), 2)
    out = good.join(medians, list(keys)).groupBy(*keys, "median", "mean", "pairs").agg(F.sqrt(F.sum(off) / F.greatest(F.col("pairs") - 1, F.lit(1))).alias("off"))
    score = 0.4 * F.col("mean") + 0.3 * F.least(F.col("pairs") / full_pairs, F.lit(1.0)) + 0.3 * F.greatest(F.lit(0.0), 1 - F.col("off") / spread)
    out = out.select(*keys, F.col("median").alias("offset"), F.least(F.lit(1.0), score).alias("confidence"), "pairs")
    return out.withColumn("level", confidence_level(F.col("confidence")))


def confidence_level(c: Column) -> Column:
    return F.when(c >= 0.85, "HIGH").when(c >= 0.6, "MEDIUM").when(c >= 0.3, "LOW").otherwise("FAILED")


def shifted(ts: Column, offset: Column, drift_ns_per_s: Column, reference: Column) -> Column:
    """A time on the other clock; drift counts only with a reference."""
    drift = F.when((drift_ns_per_s != 0) & (reference != 0), (ts - reference) * drift_ns_per_s / 1e9).otherwise(0.0)
    return ts + offset + drift


def wall_to_log(samples: DataFrame, points: DataFrame) -> DataFrame:
    """points (log_id, wall: epoch seconds) with log_ts: the log's own time then, between its wall-clock records (microseconds), or that of
    the nearer end outside them; null without records."""
    own = entries_of(samples, "system_time").select("log_id", "ts", "seq", F.coalesce("v_long", F.col("v_num").cast("long")).alias("wall")).where("wall is not null")
    right = own.select("log_id", (F.col("wall") / 1e6).alias("ts"), "seq", F.col("ts").alias("value"))
    left = points.withColumns({"ts": F.col("wall").cast("double"), "seq": F.lit(0).cast("long")})
    return asof.lerp(left, right, ["log_id"], clamp=True).drop("ts", "seq").withColumnRenamed("other_value", "log_ts")


def coarse_offsets(samples: DataFrame, files: DataFrame) -> DataFrame:
    """files (log_id, start: epoch seconds, first: the other clock's first time) with coarse: seconds to add to the other clock, or null."""
    known = files.where("start is not null").withColumn("wall", F.col("start"))
    found = wall_to_log(samples, known).withColumn("coarse", F.col("log_ts") - F.col("first")).drop("wall", "log_ts")
    return found.unionByName(files.where("start is null").withColumn("coarse", F.lit(None).cast("double")))


def drift_of(offset_1: Column, middle_1: Column, offset_2: Column, middle_2: Column) -> Column:
    """ns a second by which the offset grows between two halves; null where they are too close, 0 where it is negligible."""
    apart = middle_2 - middle_1
    rate = (offset_2 - offset_1) / F.nullif(apart, F.lit(0.0)) * 1e9
    return F.when(apart >= APART, F.when(F.abs(rate) >= LEAST_DRIFT, rate).otherwise(0.0))


def agreed(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, offset, drift, reference, confidence, level, pairs: what the tried pairs (place, entry, signal and correlate's columns) agree on.

    Strong pairs decide, or usable ones where none is strong; offset is null where there is none either. Drift comes from the first pair whose
    halves both correlate; its reference is the middle of the window that gave that pair's offset.
    """
    columns = ["place", "entry", "signal", "offset", "correlation", "samples", "middle", *(c.split()[0] for c in HALVES.split(", "))]
    tried = results.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("tried"))  # a few a pair of logs
    over = lambda least: F.filter("tried", lambda p: F.coalesce(p["correlation"], F.lit(0.0)) > least)
    tried = tried.withColumn("good", F.when(F.size(over(STRONG)) > 0, over(STRONG)).otherwise(over(USABLE)))
    n, sorted_offsets = F.size("good"), F.sort_array(F.transform("good", lambda p: p["offset"]))
    at = lambda i: F.try_element_at(sorted_offsets, i.cast("int"))
    tried = tried.withColumns({"n": n, "offset": F.when(n > 0, (at(F.greatest(F.floor((n + 1) / 2), F.lit(1))) + at(F.floor(n / 2) + 1)) / 2)})
    total = lambda what: F.aggregate("good", F.lit(0.0), lambda s, p: s + what(p))
    mean = total(lambda p: p["correlation"]) / F.nullif(F.col("n"), F.lit(0))
    off = F.when(F.col("n") < 2, 0.0).otherwise(F.sqrt(total(lambda p: F.pow(p["offset"] - F.col("offset"), F.lit(2.0))) / F.nullif(F.col("n") - 1, F.lit(0))))
    confidence = F.least(F.lit(1.0), 0.4 * mean + 0.3 * F.least(F.col("n") / 3, F.lit(1.0)) + 0.3 * F.greatest(F.lit(0.0), 1 - off / 0.05))
    rate = lambda p: drift_of(p["offset_1"], p["middle_1"], p["offset_2"], p["middle_2"])
    halved = F.filter("tried", lambda p: (p["correlation_1"] > USABLE) & (p["correlation_2"] > USABLE) & rate(p).isNotNull())
    tried = tried.withColumn("drifting", F.try_element_at(halved, F.lit(1)))
    drift = F.coalesce(F.when(F.col("n") > 0, rate(F.col("drifting"))), F.lit(0.0))
    out = tried.withColumns({"confidence": confidence, "drift": drift})
    reference = F.when(F.col("drift") != 0, F.col("drifting.middle")).otherwise(0.0)
    shown = F.transform("tried", lambda p: F.struct(*(p[c].alias(c) for c in ("entry", "signal", "offset", "correlation", "samples"))))
    return out.select(*keys, "offset", "drift", reference.alias("reference"), "confidence", confidence_level(F.col("confidence")).alias("level"), shown.alias("pairs"), F.col("n").alias("agreeing"))


def explained(method: str = "method") -> Column:
    more = F.when(F.col("drift") != 0, F.format_string(" Clock drift: %.1f ns/s (%.1f ms/hr).", "drift", F.col("drift") * 0.0036)).otherwise("")
    used = F.format_string("%d signal pair(s) agree on an offset of %.1f ms.", "agreeing", F.col("offset") * 1000)
    return F.when(F.col(method) == "CROSS_CORRELATION", F.concat(used, more)).when(F.col(method) == "SYSTEM_TIME_ONLY", "No pair of signals correlates; the offset is that of the wall clocks, to seconds.").otherwise("No pair of signals and no wall clock.")


def synchronize(samples: DataFrame, signals: DataFrame, files: DataFrame, hints: DataFrame | None = None, rate: float = RATE, max_lag: int = MAX_LAG) -> DataFrame:
    """One row for each of files: log_id, revlog_id, offset (seconds to add to the motor-controller clock), drift (ns a second), reference,
    confidence, level, method, pairs, explanation.

    samples: of logs. signals: revlog_id, signal (device/kind), seq, ts, value. files: the pairs to align, log_id, revlog_id, start (epoch
    seconds of the motor-controller file, or null). hints: revlog_id, device, hint (part of the names of a device's entries).
    """
    keys = ["log_id", "revlog_id"]
    spans = signals.groupBy("revlog_id").agg(F.min("ts").alias("first"))
    own = files.select(*keys, F.col("start").cast("double").alias("start")).distinct()
    coarse = coarse_offsets(samples, own.join(spans, "revlog_id")).select(*keys, "coarse")
    numbers = samples.select("log_id", "entry", "type", "seq", "ts", number().alias("value"))
    entries = numbers.groupBy("log_id", "entry", "type").agg(F.count("value").alias("n_entry"))
    heard = signals.groupBy("revlog_id", "signal").agg(F.count("value").alias("n_signal"))
    named = heard.withColumn("device", F.substring_index("signal", "/", 1))
    named = named.join(hints.select("revlog_id", "device", "hint"), ["revlog_id", "device"], "left") if hints is not None else named.withColumn("hint", F.lit(None).cast("string"))
    pairs = pairing.candidates(own.join(entries, "log_id"), own.join(named, "revlog_id"), keys)
    counted = pairs.join(entries.groupBy("log_id", "entry").agg(F.max("n_entry").alias("n_entry")), ["log_id", "entry"]).join(heard, ["revlog_id", "signal"])
    chosen = pairing.prioritized(counted.where(f"n_entry >= {LEAST_SAMPLES} and n_signal >= {LEAST_SAMPLES}"), keys).select(*keys, "entry", "signal", "place")
    by = [*keys, "entry", "signal", "place"]
    one = numbers.select("log_id", "entry", "ts", "value").join(chosen, ["log_id", "entry"]).select(*by, "ts", "value")
    two = signals.select("revlog_id", "signal", "ts", "value").join(chosen, ["revlog_id", "signal"]).select(*by, "ts", "value")
    centres = chosen.join(coarse, keys).select(*by, F.coalesce("coarse", F.lit(0.0)).alias("centre"))
    found = agreed(correlate(one, two, by, centres, LONG_RECORDING, rate, max_lag), keys)
    tried = chosen.groupBy(*keys).agg(F.count("*").alias("tried"))
    out = own.join(coarse, keys, "left").join(tried, keys, "left").join(found, keys, "left")
    crossed, known = F.col("offset").isNotNull(), F.col("coarse").isNotNull() | F.col("tried").isNotNull()
    out = out.withColumn("method", F.when(crossed, "CROSS_CORRELATION").when(known, "SYSTEM_TIME_ONLY").otherwise("FAILED"))
    coarse_only = lambda c, x: F.when(F.col("method") == "CROSS_CORRELATION", F.col(c)).when(F.col("method") == "SYSTEM_TIME_ONLY", x)
    level = F.when(F.col("method") == "SYSTEM_TIME_ONLY", "LOW").otherwise(F.coalesce("level", F.lit("FAILED")))
    return out.select(
        *keys, coarse_only("offset", F.coalesce("coarse", F.lit(0.0))).alias("offset"), F.coalesce("drift", F.lit(0.0)).alias("drift"), F.coalesce("reference", F.lit(0.0)).alias("reference"),
        F.coalesce(coarse_only("confidence", F.lit(0.2)), F.lit(0.0)).alias("confidence"), level.alias("level"), "method", "pairs", explained().alias("explanation"),
    )
