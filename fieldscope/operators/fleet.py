"""Operators over many logs: files and their identity, overlap in time, match outcomes, motor-controller signals and clock offsets.

Joins on time intervals or on the nearest time meet on equi keys (buckets of time, words of a name), never as pairs of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldscope.operators import asof
from fieldscope.plans import sync

CHUNK = 64 * 1024


def fingerprint(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """path, fingerprint: SHA-256 over the size and the first, middle and last chunk of files read with format binaryFile.

    Files of up to three chunks are hashed without a middle.
    """
    size, content = F.col("length").cast("long"), F.col("content")
    piece = lambda at: F.substring(content, (at + 1).cast("int"), F.lit(chunk))
    last = piece(F.greatest(size - chunk, F.lit(0)))
    middle = F.when(size > 3 * chunk, piece(F.floor(size / 2) - chunk // 2)).otherwise(F.unhex(F.lit("")))
    head = F.concat(size.cast("string").cast("binary"), piece(F.lit(0)), middle, last)
    return files.select("path", F.sha2(head, 256).alias("fingerprint"))


def revlogs_from_files(files: DataFrame) -> DataFrame:
    """path, filename, start (seconds), bus of motor-controller logs named REV_yyyyMMdd_HHmmss[_bus].revlog; others have no start."""
    name = F.regexp_extract("path", r"([^/]+)\.revlog$", 1)
    stamp = F.regexp_extract(name, r"^REV_(\d{8}_\d{6})", 1)
    bus = F.regexp_extract(name, r"^REV_\d{8}_\d{6}_(.+)$", 1)
    start = F.unix_timestamp(F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("yyyyMMdd_HHmmss"))).cast("double")
    return files.where(F.col("path").endswith(".revlog")).select("path", name.alias("filename"), start.alias("start"), F.coalesce(F.nullif(bus, F.lit("")), F.lit("")).alias("bus"))


def overlapping(logs: DataFrame, points: DataFrame, tolerance: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of a log (begin, end) and a point (start) within [begin - tolerance, end + tolerance] and equal keys.

    Logs are spread over the buckets of time that they touch and points lie in one each, so a pair meets once.
    """
    width = F.lit(max(1.0, 4 * tolerance))
    bucket = lambda t: F.floor(t / width)
    spread = logs.where("begin <= end").withColumn("__bucket", F.explode(F.sequence(bucket(F.col("begin") - tolerance), bucket(F.col("end") + tolerance))))
    near = (F.col("start") >= F.col("begin") - tolerance) & (F.col("start") <= F.col("end") + tolerance)
    return spread.join(points.withColumn("__bucket", bucket(F.col("start"))), [*keys, "__bucket"]).where(near).drop("__bucket")


def match_key(kind: Column, number: Column) -> Column:
    """The key of a match within its event: qm12, sf3m1, qf2m1, f1m2."""
    n, k = number.cast("string"), F.lower(kind)
    return F.when(k.isin("q", "qm"), F.concat(F.lit("qm"), n)).when(k.isin("sf", "qf"), F.concat(k, n, F.lit("m1"))).when(k == "f", F.concat(F.lit("f1m"), n))


def nearest_match(logs: DataFrame, matches: DataFrame, within: float = 7200.0, by: str = "event") -> DataFrame:
    """logs (ts, seq) with match_key and distance of the match (ts) of the same event nearest in time, if within; ties to the earlier one."""
    none = F.lit(None).cast(matches.schema["match_key"].dataType)
    row = F.struct(*logs.columns)
    own = logs.select(by, "ts", F.lit(1).alias("__side"), F.col("seq").cast("string").alias("__tie"), row.alias("row"), F.lit(None).cast("double").alias("m"), none.alias("k"))
    other = matches.select(by, F.col("ts").cast("double").alias("ts"), F.lit(0).alias("__side"), F.col("match_key").cast("string").alias("__tie"), F.lit(None).cast(own.schema["row"].dataType).alias("row"), F.col("ts").cast("double").alias("m"), F.col("match_key").alias("k"))
    last = F.last(F.when(F.col("m").isNotNull(), F.struct("m", "k")), ignorenulls=True)
    later = asof.before([by], F.desc("ts"), F.desc("__side"), F.desc("__tie"), end=-1)
    both = own.unionByName(other).withColumn("a", last.over(asof.before([by], "ts", "__side", "__tie"))).withColumn("b", last.over(later)).where("__side = 1")
    da, db = F.col("ts") - F.col("a.m"), F.col("b.m") - F.col("ts")
    first = F.coalesce(da <= db, da.isNotNull())
    d = F.when(first, da).otherwise(db)
    near = d <= within
    return both.select("row.*", F.when(near, F.when(first, F.col("a.k")).otherwise(F.col("b.k"))).alias("match_key"), F.when(near, d).alias("distance"))


def nth_match(logs: DataFrame, matches: DataFrame, by: str = "event") -> DataFrame:
    """logs (match_number) with the match_key of the N-th match of their event in time; null beyond the last."""
    n = matches.withColumn("match_number", F.row_number().over(Window.partitionBy(by).orderBy("ts", "match_key"))).select(by, "match_number", "match_key")
    return logs.join(n, [by, "match_number"], "left")


def outcomes(logs: DataFrame, matches: DataFrame) -> DataFrame:
    """logs (event, match_key, team) with score, opponent_score, won of the team's alliance; matches hold red/blue arrays and scores."""
    sides = []
    for own, other in (("red", "blue"), ("blue", "red")):
        sides.append(matches.select("event", "match_key", F.explode(own).alias("team"), F.lit(own).alias("alliance"), F.col(f"{own}_score").alias("score"), F.col(f"{other}_score").alias("opponent_score")))
    both = sides[0].unionByName(sides[1]).withColumn("won", F.col("score") > F.col("opponent_score"))
    return logs.join(both, ["event", "match_key", "team"], "left")


#: The fields of a score that are told, by season; years that an event's name can hold; the zone of events that name none.
BREAKDOWN = (
    "autoPoints", "teleopPoints", "endgamePoints", "foulPoints", "totalPoints", "autoLeavePoints", "autoAmpNotePoints", "autoSpeakerNotePoints", "teleopAmpNotePoints", "teleopSpeakerNotePoints",
    "autoCoralPoints", "autoAlgaePoints", "teleopCoralPoints", "teleopAlgaePoints", "netAlgaePoints", "bargePoints",
)
YEARS, ZONE, CLOCK = (1992, 2100), "America/New_York", "h:mm a"


def eligible(logs: DataFrame) -> DataFrame:
    """Logs of official matches: with event, team and number, of qualifications or playoffs, neither simulated nor replayed."""
    kind = F.lower("match_type")
    official = kind.contains("qual") | kind.contains("semi") | kind.contains("final") | kind.contains("elimination")
    return logs.where((F.length("event") > 0) & F.col("match_number").isNotNull() & F.col("team").isNotNull() & official & ~kind.contains("sim") & ~kind.contains("practice") & ~kind.contains("replay"))


def season_year(event: str = "event", modified: str = "modified") -> Column:
    """The year in an event's name, else that of the file's time (epoch seconds, UTC)."""
    named = F.regexp_extract(event, r"(\d{4})", 1).try_cast("int")
    return F.coalesce(F.when(named.between(*YEARS), named), F.year(F.timestamp_seconds(modified)))


def enriched(logs: DataFrame, matches: DataFrame, within: float = 7200.0) -> DataFrame:
    """Eligible logs (log_id, event, match_type, match_number, team, created, modified) with year, match_key, alliance, score, opponent_score,
    won, and both times of the match as epoch seconds and at the event's clock; nulls where no match is found.

    matches: year, event (code in lower case), match_key, red and blue (teams), red_score, blue_score, scheduled, actual, zone. A qualification
    is found by its number, a playoff match by the team's one nearest to the log's time (of the file's name, else of the file).
    """
    code = F.lower(F.regexp_replace("event", r"^\d{4}", ""))
    own = eligible(logs).withColumns({"year": season_year(), "code": code, "ts": F.coalesce("created", "modified").cast("double")})
    sides = []
    for mine, other in (("red", "blue"), ("blue", "red")):
        sides.append(matches.select("year", F.col("event").alias("code"), "match_key", F.explode(mine).alias("team"), F.lit(mine).alias("alliance"), F.col(f"{mine}_score").alias("score"), F.col(f"{other}_score").alias("opponent_score"), "scheduled", "actual", "zone"))
    played = sides[0].unionByName(sides[1]).withColumn("won", F.when((F.col("score") >= 0) & (F.col("opponent_score") >= 0), F.col("score") > F.col("opponent_score")))
    qualifies = F.lower("match_type").contains("qual")
    numbered = own.where(qualifies).withColumn("match_key", F.concat(F.lit("qm"), F.col("match_number").cast("string")))
    key = F.concat_ws("/", F.col("year").cast("string"), "code", F.col("team").cast("string")).alias("of")
    playoff = played.where(~F.col("match_key").startswith("qm")).select(key, F.coalesce("actual", "scheduled").cast("double").alias("ts"), "match_key").where("ts is not null")
    near = nearest_match(own.where(~qualifies).withColumns({"of": key, "seq": F.lit(0).cast("long")}), playoff, within, "of").drop("of", "seq", "distance")
    found = numbered.unionByName(near.select(*numbered.columns)).join(played, ["year", "code", "team", "match_key"], "left")
    clock = lambda t: F.date_format(F.from_utc_timestamp(F.timestamp_seconds(t), F.coalesce("zone", F.lit(ZONE))), CLOCK)
    return found.select(*logs.columns, "year", "match_key", "alliance", "score", "opponent_score", "won", "scheduled", clock("scheduled").alias("scheduled_local"), "actual", clock("actual").alias("actual_local"))


def score_breakdown(matches: DataFrame, fields: tuple[str, ...] = BREAKDOWN) -> DataFrame:
    """year, event, match_key, alliance, field, points of the known fields of matches' breakdown (JSON text by alliance)."""
    parts = F.from_json("breakdown", "map<string,map<string,string>>")
    told = matches.select("year", "event", "match_key", F.explode(parts).alias("alliance", "own")).where(F.col("alliance").isin("red", "blue"))
    told = told.select("year", "event", "match_key", "alliance", F.explode("own").alias("field", "value"))
    return told.where(F.col("field").isin(*fields)).select("year", "event", "match_key", "alliance", "field", F.col("value").try_cast("double").alias("points"))


def list_signals(entries: DataFrame, device: str | None = None, signal: str | None = None) -> DataFrame:
    """Signals (entry = device/signal) whose parts contain the filters, in either case."""
    d, s = F.lower(F.substring_index("entry", "/", 1)), F.lower(F.substring_index("entry", "/", -1))
    out = entries if device is None else entries.where(d.contains(device.lower()))
    return out if signal is None else out.where(s.contains(signal.lower()))


def on_log_time(samples: DataFrame, syncs: DataFrame, keys: tuple[str, ...] = ("log_id",)) -> DataFrame:
    """Signal samples moved onto their log's clock by (offset, drift, reference); those without a result keep their time."""
    j = samples.join(syncs.select(*keys, "offset", "drift", "reference"), list(keys), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return j.withColumn("ts", sync.shifted(F.col("ts"), zero("offset"), zero("drift"), zero("reference"))).drop("offset", "drift", "reference")


def signal_page(samples: DataFrame, start: float | None = None, end: float | None = None, limit: int = 1000) -> DataFrame:
    """The first rows within the range, in time order, with min, max and mean over these rows; the limit is the feature."""
    page = samples.where((F.lit(start).isNull() | (F.col("ts") >= F.lit(start))) & (F.lit(end).isNull() | (F.col("ts") <= F.lit(end)))).orderBy("ts", "seq").limit(limit)
    whole = Window.partitionBy(F.lit(1))  # of the page alone
    return page.select("*", F.min("value").over(whole).alias("min"), F.max("value").over(whole).alias("max"), F.avg("value").over(whole).alias("mean"))


def set_offset(syncs: DataFrame, log_id: str, offset: float, bus: str | None = None) -> DataFrame:
    """syncs with the results of a log (and bus) replaced by the user's offset at medium confidence."""
    hit = (F.col("log_id") == log_id) & (F.lit(True) if bus is None else F.col("bus") == bus)
    new = {"offset": F.lit(float(offset)), "drift": F.lit(0.0), "confidence": F.lit(0.5), "level": F.lit("MEDIUM"), "method": F.lit("USER_PROVIDED")}
    return syncs.select(*(F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in syncs.columns))


def sync_status(syncs: DataFrame) -> DataFrame:
    """n, failed, mean and worst confidence of the results of each log."""
    return syncs.groupBy("log_id").agg(F.count("*").alias("n"), F.count_if(F.col("level") == "FAILED").alias("failed"), F.avg("confidence").alias("mean_confidence"), F.min("confidence").alias("worst_confidence"))


def with_warnings(df: DataFrame, score: str = "score") -> DataFrame:
    """Each row as a JSON result: success, data, warnings (of low quality)."""
    warnings = F.when(F.col(score) < 0.5, F.array(F.lit("low data quality"))).otherwise(F.array().cast("array<string>"))
    data = F.struct(*df.columns)
    return df.select(*df.columns, F.to_json(F.struct(F.lit(True).alias("success"), data.alias("data"), warnings.alias("warnings"))).alias("result"))
