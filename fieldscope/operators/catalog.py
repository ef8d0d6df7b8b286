"""Listing and search over channels and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldscope.sources import wpilog


def entries(samples: DataFrame) -> DataFrame:
    return samples.groupBy("log_id", "entry", "type").agg(F.count("*").alias("sample_count"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))


def list_entries(entries: DataFrame, pattern: str | None = None) -> DataFrame:
    return (entries if pattern is None else entries.where(F.lower("entry").contains(pattern.lower()))).orderBy("log_id", "entry")


def search_entries(entries: DataFrame, type_: str | None = None, pattern: str | None = None, min_samples: int | None = None) -> DataFrame:
    """The type is matched case-sensitively, the name not."""
    out = entries if type_ is None else entries.where(F.col("type").contains(type_))
    out = out if pattern is None else out.where(F.lower("entry").contains(pattern.lower()))
    return out if min_samples is None else out.where(F.col("sample_count") >= min_samples)


def get_types(entries: DataFrame) -> DataFrame:
    return entries.groupBy("type").agg(F.countDistinct("entry").alias("n_entries"), F.sort_array(F.collect_set("entry")).alias("entries"))


def entry_info(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first, middle and last samples of each series, with its count."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("i", F.row_number().over(w.orderBy("ts", "seq")).cast("long") - 1).withColumn("n", F.count("*").over(w))
    return rows.where((F.col("i") == 0) | (F.col("i") == F.expr("n div 2")) | (F.col("i") == F.col("n") - 1))


def read_entry(df: DataFrame, offset: int = 0, limit: int = 100) -> DataFrame:
    """A page in time order; limit and offset are the feature."""
    if limit <= 0 or offset < 0:
        raise ValueError("limit must be positive and offset not negative")
    return df.orderBy("ts", "seq").offset(offset).limit(limit)


def search_strings(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.where(F.lower(column).contains(pattern.lower()))


def suggest_entries(names: DataFrame, wanted: str, column: str = "entry", most: int = 3, distance: int = 3) -> DataFrame:
    """Names within a few edits of the one wanted, nearest first."""
    d = names.select(column).distinct().withColumn("distance", F.levenshtein(F.lower(column), F.lit(wanted.lower())))
    return d.where(F.col("distance") <= distance).orderBy("distance", column).limit(most)


def suggest_tools(catalog: DataFrame, task: str, most: int = 5) -> DataFrame:
    """Tools by score: 2 for a keyword in the task, 3 for a use case of which two longer words occur, 5 for the name."""
    words = [w for w in task.lower().split() if len(w) > 3]
    text = F.lit(task.lower())
    keyword = F.aggregate("keywords", F.lit(0), lambda s, k: s + F.when(text.contains(k), 2).otherwise(0))
    known = F.array(*(F.lit(w) for w in words)).cast("array<string>")
    case = F.aggregate("use_cases", F.lit(0), lambda s, u: s + F.when(F.size(F.array_intersect(F.split(F.lower(u), " "), known)) >= 2, 3).otherwise(0))
    name = F.when(text.contains(F.regexp_replace("name", "_", " ")) | text.contains(F.col("name")), 5).otherwise(0)
    return catalog.withColumn("score", keyword + case + name).where("score > 0").orderBy(F.desc("score"), "name").limit(most)


def logs_from_files(files: DataFrame) -> DataFrame:
    """path, event, match_type, match_number, modified of log files listed with format binaryFile, newest first."""
    name = F.regexp_extract("path", r"([^/]+)\.wpilog$", 1)
    kind = F.lower(F.regexp_extract(name, r"(?i)_(qm|q|p|e|sf|qf|f)(\d+)(?:\D|$)", 1))
    return files.select("path", name.alias("filename"), F.nullif(kind, F.lit("")).alias("match_type"), F.expr(r"try_cast(regexp_extract(path, '(?i)_(qm|q|p|e|sf|qf|f)([0-9]+)([^0-9]|$)', 2) as int)").alias("match_number"), F.col("modificationTime").alias("modified")).orderBy(F.desc_nulls_last("modified"))


def with_matches(logs: DataFrame, matches: DataFrame) -> DataFrame:
    """Logs with their match's outcome by (event, match_type, match_number)."""
    return logs.join(matches, ["event", "match_type", "match_number"], "left")


#: Types of matches by what a text contains or equals, first match first, and by number.
MATCH_TYPES = (("Practice", ("practice",), ("p",)), ("Qualification", ("qual",), ("q",)), ("Elimination", ("elim",), ("e",)), ("Semifinal", ("semi",), ("sf",)), ("Quarterfinal", ("quarter",), ("qf",)), ("Final", ("final",), ()))
NUMBERED = ("Practice", "Qualification", "Elimination")
#: Fixed value: names of log files, with date, time, event and match.
LOG_NAME = r"(?i)^[a-z]+_(\d{2}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2})_([a-z0-9]+)(?:_([a-z]+)(\d+))?(?:_sim)?\.wpilog$"


def match_type(text: Column, number: Column | None = None) -> Column:
    """The type that a text names, or a number (also as the one character of a text); null for others."""
    t, out = F.lower(F.trim(text)), F.lit(None).cast("string")
    for name, parts, equal in reversed(MATCH_TYPES):
        hit = F.lit(False)
        for p in parts:
            hit = hit | t.contains(p)
        out = F.when(hit | t.isin(*equal) if equal else hit, name).otherwise(out)
    n = F.when((F.length(text) == 1) & (F.ascii(text) <= 3), F.ascii(text))
    n = n if number is None else F.coalesce(n, number.cast("int"))
    for i, name in enumerate(NUMBERED, 1):
        out = F.when(n == i, name).otherwise(out)
    return out


def metadata(files: DataFrame, team: int | None = None) -> DataFrame:
    """path, filename, event, match_type, match_number, team, created and modified (epoch seconds), name of each log file.

    files: as format binaryFile lists them, with or without content. What the head of a file tells goes before what its name tells.
    """
    heads = wpilog.read_heads(files)
    last = lambda field, what: F.max_by(what, F.when((F.col("field") == field) & what.isNotNull(), F.col("seq")))
    kind = match_type(F.col("v_str"), F.col("v_long"))
    told = heads.groupBy("path").agg(
        last("event", F.col("v_str")).alias("h_event"), last("match_type", kind).alias("h_type"), last("match_number", F.col("v_long").cast("int")).alias("h_number"), last("team", F.col("v_long").cast("int")).alias("h_team"),
    )
    name = F.element_at(F.split("path", "/"), -1)
    part = lambda i: F.nullif(F.regexp_extract("filename", LOG_NAME, i), F.lit(""))
    out = files.select("path", name.alias("filename"), F.col("modificationTime").cast("double").alias("modified")).join(told, "path", "left")
    stamp, event, code, number = (part(i) for i in (1, 2, 3, 4))
    by_name = F.when(event.isNotNull(), F.when(number.isNull(), "Practice").otherwise(F.coalesce(match_type(code), code)))
    by_name = F.concat(by_name, F.when(F.lower("filename").endswith("_sim.wpilog"), " (sim)").otherwise(""))
    created = F.unix_timestamp(F.try_to_timestamp(stamp, F.lit("yy-MM-dd_HH-mm-ss"))).cast("double")
    out = out.select(
        "path", "filename", F.coalesce("h_event", F.upper(event)).alias("event"), F.coalesce("h_type", by_name).alias("match_type"),
        F.coalesce("h_number", number.cast("int")).alias("match_number"), F.coalesce("h_team", F.lit(team).cast("int")).alias("team"), created.alias("created"), "modified",
    )
    friendly = F.concat_ws(" ", "event", "match_type", F.col("match_number").cast("string"))
    return out.withColumn("name", F.coalesce(F.nullif(friendly, F.lit("")), F.regexp_replace("filename", r"\.wpilog$", "")))


def available_logs(files: DataFrame, matches: DataFrame | None = None, team: int | None = None) -> DataFrame:
    """Log files with their metadata and state (see wpilog.states), newest first, and with the match's outcome where matches are given."""
    out = metadata(files, team)
    if "content" in files.columns:
        out = out.join(wpilog.states(files).select("path", "readable", "truncated", "records", "skipped", "min_ts", "max_ts", "message"), "path", "left")
    out = out if matches is None else with_matches(out, matches)
    return out.orderBy(F.desc_nulls_last(F.coalesce("created", "modified")), "path")
