"""Quality of the data behind a result: what a user is told with every answer.

One pass over the channels that an analysis touched measures each of them (stats.data_quality); of several the worst stands for the
analysis. The measures, warnings and directives become columns beside the result's own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscope.functions.values import number_or_flag
from fieldscope.operators import stats

#: Below these samples, seconds or scores a result is called uncertain; gaps count above this share of the samples.
FEW_SAMPLES, SHORT_SECONDS, POOR_SCORE, MANY_GAPS = 100, 10.0, 0.5, 0.02
MEASURES = ["n", "rate", "span", "gaps", "max_gap", "gap_time", "jitter", "bad", "score", "confidence"]

#: What an analysis adds to its directives: guidance and follow-ups by name.
NOTES = {
    "get_statistics": ((), ("detect_anomalies: outliers that may skew these statistics", "time_correlate: relations with other entries")),
    "compare_entries": (("The RMSE has the unit of the entry; compare it with the entry's usual range",), ("get_statistics: the baseline of each entry",)),
    "detect_anomalies": ((), ("find_peaks: extremes of a signal rather than outliers",)),
    "find_peaks": ((), ("get_statistics: the baseline before peaks are interpreted",)),
    "rate_of_change": (("A derivative amplifies noise; a larger window smooths it",), ()),
    "time_correlate": (("A correlation is no cause; other variables may drive both",), ()),
    "analyze_swerve": ((), ("power_analysis: whether modules fail with the voltage",)),
    "power_analysis": ((), ("predict_battery_health: the battery as a whole",)),
    "can_health": (("Errors while disabled are normal; those while enabled count",), ()),
    "compare_matches": (("Logs compare only if they were recorded alike",), ()),
    "moi_regression": (("The estimate rests on the data and on the model's assumptions",), ()),
    "profile_mechanism": ((), ("moi_regression: the mechanism's inertia",)),
    "analyze_loop_timing": (("The health score follows the rate of violations, whatever their cause",), ()),
    "analyze_can_bus": (("Timeouts while disabled are normal; errors while enabled count",), ()),
    "predict_battery_health": (("The score is a rule of thumb; age and connectors matter too",), ()),
    "generate_report": (("A report is a summary; single analyses tell more",), ()),
}
ONE_LOG = "This rests on one log; patterns should be confirmed over several"


def measure(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and MEASURES of each series of df (ts, seq, value)."""
    return stats.data_quality(df, keys).select(*keys, *MEASURES)


def worst(measured: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of the measured series of equal keys the one of the lowest score, of equal scores that of fewer samples."""
    return measured.groupBy(*keys).agg(F.min_by(F.struct(*MEASURES), F.struct("score", "n")).alias("q")).select(*keys, "q.*")


def _texts(*conditions: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(when, text) for when, text in conditions)))


def warnings(score: Column) -> Column:
    return _texts((score < POOR_SCORE, F.format_string("Low data quality (score %.2f): treat the results as preliminary", score)))


def directives(measured: DataFrame, tool: str | None = None, one_log: bool = True) -> DataFrame:
    """measured with warnings, sample_context, guidance and followup."""
    guidance, followup = NOTES.get(tool, ((), ()))
    n, gaps = F.col("n"), F.col("gaps")
    told = _texts(
        (n < FEW_SAMPLES, F.format_string("Few samples (%d): measures are uncertain", n)),
        ((gaps > 0) & (gaps / n > MANY_GAPS), F.format_string("%d gaps (the longest %.1f ms): trends may suffer", gaps, F.col("max_gap") * 1000)),
        (F.col("bad") > 0, F.format_string("%d values are not finite: a sensor or the bus may have dropped out", F.col("bad"))),
        ((n > 0) & (F.col("span") < SHORT_SECONDS), F.format_string("A short time (%.1f s) may not stand for a whole match", F.col("span"))),
        *((F.lit(True), F.lit(g)) for g in ((ONE_LOG,) if one_log else ()) + tuple(guidance)),
    )
    return measured.withColumns({
        "warnings": warnings(F.col("score")), "sample_context": F.format_string("%d samples over %.1f seconds", n, F.col("span")),
        "guidance": told, "followup": F.array(*map(F.lit, followup)).cast("array<string>"),
    })


def attach(result: DataFrame, measured: DataFrame, keys: Sequence[str], tool: str | None = None, one_log: bool = True) -> DataFrame:
    """result with data_quality (struct), warnings (its own ones, if it has some, first) and directives (struct), by keys.

    measured: one row of MEASURES a key (see measure and worst). A result without measured data says so.
    """
    told = directives(measured, tool, one_log)
    told = told.select(*keys, F.struct(*MEASURES).alias("data_quality"), F.col("warnings").alias("__told"), F.struct(F.col("confidence").alias("confidence_level"), "sample_context", "guidance", "followup").alias("directives"))
    own = F.coalesce(F.col("warnings"), F.array().cast("array<string>")) if "warnings" in result.columns else F.array().cast("array<string>")
    none = F.array(F.lit("No data was measured for this result"))
    rest = [c for c in result.columns if c != "warnings"]
    out = result.join(told, list(keys), "left")
    return out.select(*rest, "data_quality", F.concat(own, F.coalesce("__told", none)).alias("warnings"), "directives")


def of_channels(samples: DataFrame, entries: Column, keys: Sequence[str] = ("log_id",)) -> DataFrame:
    """The worst quality of the samples' entries that a condition picks, a log: one scan and one shuffle whatever their number."""
    value = F.coalesce(number_or_flag(), F.lit(0.0))  # a sample that is no number (a state, a pose) is no dropout
    own = samples.where(entries).select(*keys, "entry", "ts", "seq", value.alias("value"))
    return worst(measure(own, [*keys, "entry"]), keys)


def as_json(result: DataFrame) -> DataFrame:
    """Each row as one JSON text: success and all its columns."""
    return result.select(F.to_json(F.struct(F.lit(True).alias("success"), *result.columns)).alias("result"))
