"""Which entries of a log may hold the same quantity as which signals of a motor-controller log.

An entry scores for a signal by what its name contains: a pattern of the signal's kind, the hint of its device, a word of a mechanism. The
names are searched once for the patterns and hints that the log's signals ask for; an index by pattern keeps the few best entries of each, and
signals look these up. So the pairs that are made are a few a signal, never entries times signals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What the names of entries contain, by the kind of a signal.
PATTERNS = {
    "appliedoutput": ("output", "dutycycle", "duty_cycle", "appliedvolts", "motoroutput", "percentoutput", "appliedoutput", "voltage"),
    "velocity": ("velocity", "speed", "rpm", "angularvelocity", "encodervelocity", "wheelspeed", "motorvelocity"),
    "position": ("position", "angle", "rotation", "encoderposition", "distance", "motorposition", "wheelposition"),
    "busvoltage": ("batteryvoltage", "busvoltage", "voltage", "batteryvolts", "supplyvoltage", "inputvoltage"),
    "outputcurrent": ("current", "amps", "motorcurrent", "stator", "supplycurrent", "outputcurrent", "statorcurrent"),
    "temperature": ("temperature", "temp", "motortemp", "controllertemp"),
}
#: Words of mechanisms; types of numbers; the order in which kinds of signals are tried; the scores' parts.
MECHANISMS = ("drive", "motor", "wheel", "arm", "shooter", "intake")
NUMBERS = ("double", "float", "int64", "int32", "int16", "int8")
PRIORITY = {"appliedoutput": 1, "velocity": 2, "outputcurrent": 3, "position": 4, "temperature": 5}
BY_PATTERN, BY_HINT, BY_MECHANISM, LAST = 0.5, 0.4, 0.1, 10


def is_number(type_: str = "type") -> Column:
    """The types of entries that can be correlated."""
    t = F.lower(type_)
    return t.isin(*NUMBERS) | t.startswith("double") | t.startswith("float")


def kind(signal: str = "signal") -> Column:
    return F.lower(F.substring_index(signal, "/", -1))


def _any(name: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | name.contains(w)
    return out


def candidates(entries: DataFrame, signals: DataFrame, keys: Sequence[str], most: int = 3, patterns: Mapping[str, Sequence[str]] = PATTERNS, mechanisms: Sequence[str] = MECHANISMS) -> DataFrame:
    """keys, signal, entry, score, rank: for each signal the `most` entries of the same keys with the highest score above 0, ties by name.

    entries: keys, entry, type. signals: keys, signal (device/kind), hint (of its device, or null). A kind without patterns is its own.
    """
    keys = list(keys)
    s = signals.select(*keys, "signal", kind().alias("kind"), F.nullif(F.lower(F.trim("hint")), F.lit("")).alias("hint")).distinct()
    name = F.lower("entry")
    e = entries.where(is_number()).select(*keys, "entry").distinct().withColumns({"name": name, "mechanism": _any(name, mechanisms)})
    own = F.create_map(*(x for k, v in patterns.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    asked = s.select(*keys, F.explode(F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("role"), F.col(c).alias("word"))) for c in ("kind", "hint"))))).alias("asked"))
    asked = asked.select(*keys, "asked", F.when(F.col("asked.role") == "kind", F.try_element_at(own, F.col("asked.word"))).alias("words"))
    asked = asked.select(*keys, F.struct("asked.role", "asked.word", F.coalesce("words", F.array("asked.word")).alias("words")).alias("asked"))
    # The kinds and hints of a log are as many as its devices and their database at most.
    hits = e.join(asked.groupBy(*keys).agg(F.collect_set("asked").alias("all")), keys)
    held = F.filter("all", lambda a: F.exists(a["words"], lambda w: F.col("name").contains(w)))
    hits = hits.select(*keys, "entry", "mechanism", F.explode(held).alias("hit")).select(*keys, "entry", "mechanism", "hit.role", "hit.word")

    def first(rows: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy(*keys, *by).orderBy(F.desc("mechanism"), "entry")
        return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")

    role = lambda r: hits.where(F.col("role") == r).withColumnRenamed("word", r).drop("role")
    by_kind, by_hint = role("kind"), role("hint")
    both = by_kind.join(by_hint.drop("mechanism"), [*keys, "entry"])
    found = []
    for rows, on, score in ((by_kind, ["kind"], BY_PATTERN), (by_hint, ["hint"], BY_HINT), (both, ["kind", "hint"], BY_PATTERN + BY_HINT), (e.where("mechanism"), [], 0.0)):
        points = F.lit(score) + F.when(F.col("mechanism"), BY_MECHANISM).otherwise(0.0)
        found.append(s.join(first(rows, *on), [*keys, *on]).select(*keys, "signal", "entry", points.alias("score")))
    scored = found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3]).groupBy(*keys, "signal", "entry").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy(*keys, "signal").orderBy(F.desc("score"), "entry"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most)


def prioritized(pairs: DataFrame, keys: Sequence[str], most: int = 5) -> DataFrame:
    """The pairs (signal, entry, score, n_entry, n_signal) that are tried, with their place: by kind, score and the lesser number of samples."""
    order = F.create_map(*(x for k, v in PRIORITY.items() for x in (F.lit(k), F.lit(v))))
    place = F.coalesce(F.try_element_at(order, kind()), F.lit(LAST))
    w = Window.partitionBy(*keys).orderBy(place, F.desc("score"), F.desc(F.least("n_entry", "n_signal")), "signal", "entry")
    return pairs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
