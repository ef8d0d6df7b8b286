"""Analyses of one robot's log, composed from the series operators. Input: samples of the target schema (see model.SAMPLES)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldscope.functions import angles
from fieldscope.functions.values import number
from fieldscope.model import ROLES, entries_of, finite
from fieldscope.operators import asof, series, stats

#: Seconds of the phases where no season file gives them.
AUTO_SECONDS, TELEOP_SECONDS, ENDGAME_SECONDS = 15.0, 135.0, 20.0


def numbers(samples: DataFrame) -> DataFrame:
    return samples.select("log_id", "entry", "ts", "seq", number().alias("value"))


def flags(samples: DataFrame) -> DataFrame:
    return samples.select("log_id", "entry", "ts", "seq", F.coalesce("v_bool", F.col("v_num") > 0.5).alias("value"))


def _switches(samples: DataFrame) -> DataFrame:
    """Rows of the Enabled (kind 0) and Autonomous (kind 1) entries of each log: flag, the enabled state then (`on`) and before (`was`).

    One scan and one order of the rows of a log serve all that is asked of the two entries. An enabled row counts from its own time on.
    """
    kinds = F.array_compact(F.array(*(F.when(ROLES[role](F.col("entry")), F.lit(k)) for k, role in enumerate(("enabled", "autonomous")))))
    rows = samples.select("log_id", "entry", "ts", "seq", F.coalesce("v_bool", F.col("v_num") > 0.5).alias("flag"), F.explode(kinds).alias("kind"))
    own = rows.withColumn("first", F.min("entry").over(Window.partitionBy("log_id", "kind"))).where("entry = first").drop("first")
    w, on = Window.partitionBy("log_id").orderBy("ts", "kind", "seq"), F.when(F.col("kind") == 0, F.col("flag"))
    state = lambda end: F.coalesce(F.last(on, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, end)), F.lit(False))
    return own.withColumns({"on": state(0), "was": state(-1)})


def _at(condition: str):
    return F.when(F.expr(condition), F.col("ts"))


def match_phases(samples: DataFrame, endgame: float = ENDGAME_SECONDS) -> DataFrame:
    """auto_start, teleop_start, teleop_end, endgame_start of each log, from its Enabled and Autonomous entries."""
    whole = Window.partitionBy("log_id")
    s = _switches(samples).withColumn("flag_up", F.min(_at("kind = 1 and flag")).over(whole))
    s = s.withColumn("auto_end", F.min(_at("kind = 1 and not flag and ts > flag_up")).over(whole))
    up, down = "kind = 0 and flag and not was", "kind = 0 and not flag and was"
    found = s.groupBy("log_id").agg(
        F.min(_at("kind = 1 and flag and on")).alias("while_enabled"),
        F.min(_at(f"{up} and ts >= flag_up")).alias("next_enable"),
        F.min(_at(f"{up} and ts >= auto_end")).alias("re_enabled"),
        F.max(_at(down)).alias("disabled"),
        F.min("auto_end").alias("auto_end"),
        F.max_by("flag", F.when(F.expr("kind = 0 and ts <= auto_end"), F.struct("ts", "seq"))).alias("on_at_end"),
    )
    out = samples.groupBy("log_id").agg(F.max("ts").alias("max_ts")).join(found, "log_id", "left")
    start = F.coalesce("while_enabled", "next_enable")
    tele = F.coalesce("re_enabled", F.when(F.col("on_at_end"), F.col("auto_end")))
    end = F.coalesce("disabled", "max_ts")
    return out.select("log_id", start.alias("auto_start"), tele.alias("teleop_start"), end.alias("teleop_end"), F.when(tele.isNotNull(), F.greatest(tele, end - endgame)).alias("endgame_start"))


def auto_window(samples: DataFrame, seconds: float = AUTO_SECONDS) -> DataFrame:
    """auto_start, auto_end of each log that has one: from the flag (or the first enable while it is up) to where the flag drops.

    Without a drop the window lasts `seconds`.
    """
    whole = Window.partitionBy("log_id")
    s = _switches(samples).withColumns({"flag_up": F.min(_at("kind = 1 and flag")).over(whole), "direct": F.min(_at("kind = 1 and flag and on")).over(whole)})
    s = s.withColumn("flag_end", F.min(_at("kind = 1 and not flag and ts > flag_up")).over(whole))
    found = s.groupBy("log_id").agg(
        F.min("direct").alias("direct"), F.min(_at("kind = 1 and not flag and ts > direct")).alias("direct_end"),
        F.min(_at("kind = 0 and flag and ts >= flag_up and (flag_end is null or ts < flag_end)")).alias("later"), F.min("flag_end").alias("flag_end"),
    )
    start, end = F.coalesce("direct", "later"), F.when(F.col("direct").isNotNull(), F.col("direct_end")).otherwise(F.col("flag_end"))
    return found.select("log_id", start.alias("auto_start"), F.coalesce(end, start + seconds).alias("auto_end")).where("auto_start is not null")


def power_analysis(samples: DataFrame, threshold: float = 6.8) -> DataFrame:
    v = numbers(samples.where(F.lower("entry").contains("voltage")))
    first = v.groupBy("log_id").agg(F.min("entry").alias("entry"))
    out = v.join(first, ["log_id", "entry"]).where(finite(F.col("value"))).groupBy("log_id", "entry").agg(F.min("value").alias("min_v"), F.max("value").alias("max_v"), F.avg("value").alias("avg_v"), F.sum((F.col("value") < threshold).cast("long")).alias("below"))
    return out.withColumn("risk", F.when(F.col("below") > 0, "HIGH").when(F.col("min_v") < threshold + 1, "MODERATE").otherwise("LOW"))


def can_health(samples: DataFrame) -> DataFrame:
    """Errors in string samples by enabled state: GOOD without, CONCERNING below 50, POOR else; enabled ones count alone if known."""
    lower = F.lower("v_str")
    errors = samples.where(lower.contains("can") & (lower.contains("timeout") | lower.contains("error") | lower.contains("fault"))).select("log_id", "ts", "seq", "v_str")
    en = flags(entries_of(samples, "enabled")).select("log_id", "ts", "seq", F.col("value").cast("double").alias("value"))
    state = asof.hold(errors, en, ["log_id"]).withColumn("enabled", F.coalesce("other_value", F.lit(0.0)) > 0)
    known = en.select("log_id").distinct().withColumn("known", F.lit(True))
    counts = state.groupBy("log_id").agg(F.count("*").alias("total"), F.count_if("enabled").alias("while_enabled"))
    out = samples.select("log_id").distinct().join(counts, "log_id", "left").join(known, "log_id", "left").na.fill(0, ["total", "while_enabled"])
    n = F.when(F.coalesce("known", F.lit(False)), F.col("while_enabled")).otherwise(F.col("total"))
    return out.select("log_id", "total", "while_enabled", F.when(n == 0, "GOOD").when(n < 50, "CONCERNING").otherwise("POOR").alias("assessment"))


def can_errors_by_entry(samples: DataFrame) -> DataFrame:
    """Errors in each string entry that has some: total, while_enabled, while_disabled; null states where the log does not tell them."""
    lower = F.lower("v_str")
    errors = samples.where((F.col("type") == "string") & lower.contains("can") & (lower.contains("timeout") | lower.contains("error") | lower.contains("fault"))).select("log_id", "entry", "ts", "seq")
    en = flags(entries_of(samples, "enabled")).select("log_id", "ts", "seq", "value")
    known = en.select("log_id").distinct().withColumn("known", F.lit(True))
    on = F.coalesce("other_value", F.lit(False))
    counts = asof.hold(errors, en, ["log_id"]).groupBy("log_id", "entry").agg(F.count("*").alias("total"), F.count_if(on).alias("on"), F.count_if(~on).alias("off")).join(known, "log_id", "left")
    return counts.select("log_id", "entry", "total", F.when(F.col("known"), F.col("on")).alias("while_enabled"), F.when(F.col("known"), F.col("off")).alias("while_disabled"))


def compare_matches(samples: DataFrame, entry: str) -> DataFrame:
    return numbers(samples.where(F.col("entry") == entry)).where(finite(F.col("value"))).groupBy("log_id").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"))


def code_metadata(samples: DataFrame) -> DataFrame:
    #: The names under which builds record themselves.
    names = ("GitSHA", "GitBranch", "GitDirty", "BuildDate", "ProjectName", "Version")
    key = F.coalesce(*(F.when(F.col("entry").contains(n), n) for n in names))
    return samples.withColumn("key", key).where("key is not null").groupBy("log_id", "key").agg(F.min_by("v_str", F.struct("ts", "seq")).alias("value"))


def swerve_modules(samples: DataFrame, prefix: str = "module") -> DataFrame:
    """Highest and mean speed of each module."""
    m = samples.where(F.lower("entry").contains(prefix.lower()) & F.col("v_struct")["speed_mps"].isNotNull())
    speed = F.abs(F.col("v_struct")["speed_mps"])
    return m.groupBy("log_id", "entry").agg(F.max(speed).alias("max_speed"), F.avg(speed).alias("avg_speed"))


def module_pairs(samples: DataFrame) -> DataFrame:
    """Setpoint and measured entries of modules: of equal names but for these words, or any other entry below the same parent."""
    names = samples.where(F.col("v_struct")["speed_mps"].isNotNull()).select("log_id", "entry").distinct()
    parent = F.regexp_replace("entry", "/[^/]*$", "")
    s = names.where(F.lower("entry").rlike("setpoint|desired|target"))
    s = s.select("log_id", F.col("entry").alias("setpoint"), parent.alias("parent"), F.lower(F.regexp_replace("entry", "(?i)(setpoint|desired|target)", "")).alias("base"))
    m = names.select("log_id", F.col("entry").alias("measured"), parent.alias("parent"))
    bare = F.lower(F.regexp_replace("measured", "(?i)(measured|actual|state)", ""))
    like = m.where(F.lower("measured").rlike("measured|actual|state")).select("log_id", "measured", bare.alias("base"))
    pairs = s.join(like, ["log_id", "base"]).select("log_id", "setpoint", "measured")
    return pairs.unionByName(s.join(m.where(F.col("parent") != ""), ["log_id", "parent"]).where("setpoint <> measured").select("log_id", "setpoint", "measured")).distinct()


def wheel_slip(samples: DataFrame, threshold: float = 0.5) -> DataFrame:
    """How far measured speeds are from the setpoint, interpolated at their times, where that is above 0.01, for each pair of entries.

    The ratios are relative to the setpoint; events are differences above the threshold, in metres a second.
    """
    keys = ["log_id", "setpoint", "measured"]
    speed = samples.select("log_id", "entry", "ts", "seq", F.col("v_struct")["speed_mps"].alias("value")).where("value is not null")
    side = lambda name: speed.withColumnRenamed("entry", name).join(module_pairs(samples), ["log_id", name]).select(*keys, "ts", "seq", "value")
    both = asof.lerp(side("measured"), side("setpoint"), keys).where(F.abs("other_value") > 0.01)
    off = F.abs(F.abs(F.col("value")) - F.abs(F.col("other_value")))
    ratio, event = off / F.abs(F.col("other_value")), (off > threshold).cast("double")
    return both.groupBy(*keys).agg(F.max(ratio).alias("max_slip"), F.avg(ratio).alias("avg_slip"), F.sum(event).cast("long").alias("events"), F.avg(event).alias("event_rate"), F.count("*").alias("n"))


def steering_sync(samples: DataFrame, threshold_rad: float = 0.1, kind: str = "measured") -> DataFrame:
    """Samples, by index, in which a module's angle leaves the circular mean of all modules by more than the threshold."""
    a = samples.where(F.lower("entry").contains(kind) & F.col("v_struct")["angle_rad"].isNotNull()).select("log_id", "entry", "ts", "seq", F.col("v_struct")["angle_rad"].alias("angle"))
    a = a.withColumn("i", F.row_number().over(series.window(["log_id", "entry"])))
    sums = a.withColumns({"sin": angles.sine("angle"), "cos": angles.cosine("angle")}).groupBy("log_id", "i").agg(F.sum("sin").alias("sin"), F.sum("cos").alias("cos"))
    mean = sums.select("log_id", "i", angles.arctan2("sin", "cos").alias("mean"))
    d = F.col("angle") - F.col("mean")
    off = a.join(mean, ["log_id", "i"]).select("log_id", "entry", F.abs(angles.arctan2(angles.sine(d), angles.cosine(d))).alias("off"))
    return off.groupBy("log_id", "entry").agg(F.max("off").alias("max_off"), F.count_if(F.col("off") > threshold_rad).alias("desynced"))


def pose(samples: DataFrame, role: str) -> DataFrame:
    s = entries_of(samples, role)
    return s.select("log_id", "ts", "seq", F.col("v_struct")["x"].alias("x"), F.col("v_struct")["y"].alias("y")).where("x is not null")


def odometry_drift(samples: DataFrame) -> DataFrame:
    """Distance between vision poses and the odometry held at their times."""
    v, o = pose(samples, "vision_pose"), pose(samples, "odometry")
    axis = lambda a: o.select("log_id", "ts", "seq", F.col(a).alias("value"))
    x = asof.hold(v, axis("x"), ["log_id"]).drop("other_ts").withColumnRenamed("other_value", "ox")
    y = asof.hold(x, axis("y"), ["log_id"]).withColumnRenamed("other_value", "oy")
    d = F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"))
    return y.where("ox is not null").groupBy("log_id").agg(F.avg(d).alias("avg_drift"), F.max(d).alias("max_drift"), F.count("*").alias("n"))


def ds_timeline(samples: DataFrame, threshold: float = 6.8) -> DataFrame:
    """Enable changes, phase starts and brownouts: log_id, ts, category, event, in no order."""
    en = series.changes(flags(entries_of(samples, "enabled")), ["log_id"]).select("log_id", "ts", F.lit("enable").alias("category"), F.when(F.col("value"), "ENABLED").otherwise("DISABLED").alias("event"))
    p = match_phases(samples)
    phases = p.select("log_id", F.explode(F.array(F.struct(F.col("auto_start").alias("ts"), F.lit("AUTO_START").alias("event")), F.struct(F.col("teleop_start").alias("ts"), F.lit("TELEOP_START").alias("event")))).alias("e")).select("log_id", "e.ts", F.lit("phase").alias("category"), "e.event").where("ts is not null")
    b = series.hysteresis(numbers(entries_of(samples, "battery")), ["log_id"], threshold, threshold + 0.2)
    brown = b.select("log_id", F.col("begin").alias("ts"), F.lit("brownout").alias("category"), F.lit("BROWNOUT_START").alias("event")).unionByName(b.where("closed").select("log_id", F.col("end").alias("ts"), F.lit("brownout").alias("category"), F.lit("BROWNOUT_END").alias("event")))
    return en.unionByName(phases).unionByName(brown)


def analyze_vision(samples: DataFrame, flicker: float = 0.5, jump: float = 0.5) -> DataFrame:
    """Acquisition rate, flickers and pose jumps of each log."""
    f = flags(entries_of(samples, "vision_target"))
    rate = f.groupBy("log_id").agg(F.avg(F.col("value").cast("double")).alias("acquisition_rate"), F.count("*").alias("n"))
    quick = series.quick_changes(f, ["log_id"], flicker).groupBy("log_id").agg(F.count("*").alias("flickers"))
    p = pose(samples, "vision_pose")
    w = series.window(["log_id"])
    jumps = p.withColumn("d", F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))).where(F.col("d") > jump).groupBy("log_id").agg(F.count("*").alias("jumps"), F.max("d").alias("max_jump"))
    return rate.join(quick, "log_id", "left").join(jumps, "log_id", "left").na.fill(0, ["flickers", "jumps"])


def profile_mechanism(setpoint: DataFrame, position: DataFrame, keys: list[str], velocity: DataFrame | None = None, current: DataFrame | None = None, stall_current: float = 30.0, flush: bool = False) -> dict[str, DataFrame]:
    """rmse of position against setpoint, settling time and overshoot of each setpoint segment, and stalls."""
    out = {"agreement": stats.compare(setpoint, position, keys)}
    seg = series.segments_by_setpoint(setpoint, keys).groupBy(*keys, "segment").agg(F.min("ts").alias("begin"), F.min_by("value", F.struct("ts", "seq")).alias("target"))
    w = Window.partitionBy(*keys).orderBy("begin")
    seg = seg.withColumn("until", F.lead("begin").over(w)).withColumn("from", F.lag("target").over(w))
    seg = seg if flush else seg.where("until is not null or segment > 0")
    pos = position.select(*keys, F.col("ts").alias("t"), F.col("value").alias("x"))
    # Each position belongs to one segment, the last that began by then.
    held = asof.hold(pos.select(*keys, F.col("t").alias("ts"), F.lit(0).cast("long").alias("seq"), "x"), seg.select(*keys, F.col("begin").alias("ts"), F.lit(0).cast("long").alias("seq"), F.col("segment").cast("double").alias("value")), keys).withColumn("segment", F.col("other_value").cast("long"))
    j = held.join(seg, [*keys, "segment"])
    near = F.abs(F.col("x") - F.col("target")) <= F.greatest(F.abs(F.col("target")) * 0.05, F.lit(0.01))
    past = F.when(F.col("target") >= F.coalesce("from", F.lit(0.0)), F.col("x") - F.col("target")).otherwise(F.col("target") - F.col("x"))
    out["segments"] = j.groupBy(*keys, "segment", "begin", "target").agg(F.min(F.when(near & (F.col("ts") - F.col("begin") > 0.01), F.col("ts") - F.col("begin"))).alias("settling"), F.greatest(F.max(past), F.lit(0.0)).alias("overshoot"))
    if velocity is not None and current is not None:
        both = asof.lerp(velocity, current, keys)
        out["stalls"] = series.islands(both.withColumn("v", F.col("value")).withColumn("value", F.col("other_value")), keys, (F.abs(F.col("v")) < 0.01) & (F.col("other_value") > stall_current), flush)
    return out


def mechanism_response(setpoint: DataFrame, measured: DataFrame, keys: list[str]) -> DataFrame:
    """segments, settled, settling times (avg_settling, max_settling, min_settling) and overshoot_percent of each series of setpoints.

    The measured value is interpolated at the setpoints' times. A segment settles, for the first time after 10 ms, where that is within 5 % of
    the setpoint; its overshoot is the largest error in per cent of the target, and segments that another follows count.
    """
    rows = asof.lerp(setpoint.select(*keys, "ts", "seq", "value"), measured.select(*keys, "ts", "seq", "value"), keys).where("value is not null and other_value is not null")
    seg = series.segments_by_setpoint(rows, keys)
    order = F.struct("ts", "seq")
    seg = seg.withColumns({c: F.min_by(x, order).over(Window.partitionBy(*keys, "segment")) for c, x in (("begin", "ts"), ("target", "value"))})
    since, error = F.col("ts") - F.col("begin"), F.col("other_value") - F.col("target")
    near = F.abs(F.col("other_value") - F.col("value")) <= F.greatest(F.abs("value") * 0.05, F.lit(0.01))
    one = seg.groupBy(*keys, "segment", "target").agg(F.min(F.when(near & (since > 0.01), since)).alias("settling"), F.max_by(error, F.struct(F.abs(error), -F.col("ts"), -F.col("seq"))).alias("error"))
    followed = F.col("segment") < F.max("segment").over(Window.partitionBy(*keys))
    percent = F.when(followed & (F.abs("target") > 0.001), F.col("error") * 100 / F.abs("target"))
    one = one.withColumn("percent", percent)
    s = F.col("settling")
    return one.groupBy(*keys).agg(F.count("*").alias("segments"), F.count(s).alias("settled"), F.avg(s).alias("avg_settling"), F.max(s).alias("max_settling"), F.min(s).alias("min_settling"), F.avg("percent").alias("overshoot_percent"))


def mechanism_entries(samples: DataFrame, name: str) -> DataFrame:
    """log_id, role, entry: the first entries by name that hold the setpoint, measurement, velocity and current of a mechanism."""
    e = F.lower("entry")
    has = lambda *words: _or(*(e.contains(w) for w in words))
    roles = {"setpoint": has("setpoint", "goal"), "measurement": has("position", "actual") & ~has("setpoint"), "velocity": has("velocity"), "current": has("current")}
    found = samples.where(e.contains(name.lower())).withColumn("role", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(r)) for r, c in roles.items())))))
    return found.groupBy("log_id", "role").agg(F.min("entry").alias("entry"))


def _or(*conditions):
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def profile_by_name(samples: DataFrame, name: str, start: float | None = None, end: float | None = None, stall_current: float = 30.0) -> DataFrame:
    """A row a log that has the mechanism: agreement, response, number and longest of its stalls."""
    keys = ["log_id"]
    roles = mechanism_entries(samples, name)
    played = numbers(samples).join(roles, ["log_id", "entry"])
    of = lambda role: series.time_range(played.where(F.col("role") == role), start, end).select("log_id", "ts", "seq", "value")
    agreement = stats.compare(of("setpoint"), of("measurement"), keys).select("log_id", "n", "rmse")
    both = asof.lerp(of("velocity"), of("current"), keys)
    runs = series.islands(both.withColumn("v", F.col("value")).withColumn("value", F.col("other_value")), keys, (F.abs(F.col("v")) < 0.01) & (F.col("other_value") > stall_current))
    stalls = runs.groupBy("log_id").agg(F.count("*").alias("stalls"), F.max(F.col("end") - F.col("begin")).alias("longest_stall"), F.max("peak").alias("peak_current"))
    out = roles.select("log_id").distinct()
    for part in (agreement, mechanism_response(of("setpoint"), of("measurement"), keys), stalls):
        out = out.join(part, "log_id", "left")
    return out.na.fill(0, ["stalls"])


def path_entries(samples: DataFrame, prefix: str = "") -> DataFrame:
    """log_id, role (setpoint, actual), entry: the last entries by name that hold the poses of a path and of the robot."""
    e = F.lower("entry")
    wanted = _or(*(e.contains(w) for w in ("setpoint", "target", "desired")))
    actual = ~wanted & _or(*(e.contains(w) for w in ("actual", "estimated", "odometry")))
    poses = samples.where(F.col("entry").startswith(prefix) & (F.col("type").contains("Pose2d") | F.col("type").contains("Pose3d")))
    role = F.when(wanted, "setpoint").when(actual, "actual")
    return poses.withColumn("role", role).where("role is not null").groupBy("log_id", "role").agg(F.max("entry").alias("entry"))


def follow_path(samples: DataFrame, prefix: str = "", seconds: float = AUTO_SECONDS) -> DataFrame:
    """rmse, max_error (metres) and n of the robot's pose, held at the path's times, against the path within the autonomous phase."""
    poses = samples.select("log_id", "entry", "ts", "seq", "v_struct").join(path_entries(samples, prefix), ["log_id", "entry"]).where("v_struct is not null")
    of = lambda role: poses.where(F.col("role") == role).select("log_id", "ts", "seq", F.struct(F.col("v_struct")["x"].alias("x"), F.col("v_struct")["y"].alias("y")).alias("value"))
    both = asof.hold(of("setpoint"), of("actual"), ["log_id"]).where("other_value is not null").join(auto_window(samples, seconds), "log_id").where("ts between auto_start and auto_end")
    error = F.hypot(F.col("value.x") - F.col("other_value.x"), F.col("value.y") - F.col("other_value.y"))
    return both.groupBy("log_id").agg(F.sqrt(F.avg(error * error)).alias("rmse"), F.max(error).alias("max_error"), F.count("*").alias("n"))


def battery_health(samples: DataFrame, nominal: float = 12.6, brownout: float = 6.8, warning: float = 9.0) -> DataFrame:
    """Lowest and mean voltage, brownouts, warnings, mean recovery (seconds, of logs with a current), score (0 to 100) and risk of each log."""
    v = numbers(entries_of(samples, "battery_health")).where(finite(F.col("value")))
    base = v.groupBy("log_id").agg(F.min("value").alias("min_v"), F.avg("value").alias("avg_v"))
    events = lambda t, n: series.hysteresis(v, ["log_id"], t, t + 0.2).groupBy("log_id").agg(F.count("*").alias(n), F.sum(F.col("end") - F.col("begin")).alias(f"{n}_seconds"))
    out = base.join(events(brownout, "brownouts"), "log_id", "left").join(events(warning, "warnings"), "log_id", "left").na.fill(0)
    loaded = samples.where(ROLES["total_current"](F.col("entry"))).select("log_id").distinct()
    times = series.recovery(v.drop("entry"), ["log_id"], 0.5, 0.9, 2.0).groupBy("log_id").agg(F.avg("seconds").alias("recovery"))
    out = out.join(times.join(loaded, "log_id", "left_semi"), "log_id", "left")
    share = F.col("avg_v") / nominal
    whole = lambda condition, x: F.when(condition, x.cast("int")).otherwise(0)
    score = 100 - whole(share < 0.88, (0.88 - share) * 150) - 20 * F.col("brownouts") - 5 * F.greatest(F.lit(0), F.col("warnings") - F.col("brownouts"))
    score = score - whole(F.col("recovery") > 0.5, (F.col("recovery") - 0.5) * 20) - whole(F.col("min_v") < 10, (10 - F.col("min_v")) * 10)
    out = out.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int"))
    ladder = F.when(F.col("min_v") < brownout, "CRITICAL").when((F.col("min_v") < warning) | (F.col("score") < 30), "HIGH")
    return out.withColumn("risk", ladder.when(F.col("score") < 60, "MODERATE").when(F.col("score") < 80, "LOW").otherwise("MINIMAL"))


def replay_drift(samples: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """For each real output how many samples differ from their replayed partners, by value, and the first that does, with both values as JSON."""
    value = F.to_json(F.struct("v_num", "v_long", "v_bool", "v_str", "v_arr_num", "v_arr_str", "v_struct", "v_structs"))
    s = samples.select("log_id", "entry", "ts", "seq", value.alias("value"))
    real = s.where(F.col("entry").contains("RealOutputs")).withColumn("entry", F.regexp_replace("entry", "RealOutputs", "ReplayOutputs"))
    both = asof.forward(real, s.where(F.col("entry").contains("ReplayOutputs")), ["log_id", "entry"], tolerance).where("other_value is not null")
    differs = F.col("value") != F.col("other_value")
    first = F.min(F.when(differs, F.struct("ts", "seq", "value", "other_value")))
    out = both.groupBy("log_id", "entry").agg(F.count("*").alias("compared"), F.count_if(differs).alias("differing"), first.alias("first"))
    return out.select("log_id", "entry", "compared", "differing", F.col("first.ts").alias("first_ts"), F.col("first.value").alias("first_real"), F.col("first.other_value").alias("first_replayed"))


def analyze_can_bus(samples: DataFrame) -> DataFrame:
    """Utilisation, and errors (true or above 0) by enabled state; without a record of that all count as enabled."""
    u = numbers(entries_of(samples, "can_utilisation")).where(finite(F.col("value"))).groupBy("log_id").agg(F.avg("value").alias("avg_utilisation"), F.max("value").alias("max_utilisation"))
    errors = samples.where(ROLES["can_error"](F.col("entry")) & F.expr("v_bool or v_num > 0 or v_long > 0")).select("log_id", "ts", "seq")
    en = flags(entries_of(samples, "enabled")).select("log_id", "ts", "seq", "value")
    held = asof.hold(errors, en, ["log_id"]).join(en.select("log_id").distinct().withColumn("known", F.lit(True)), "log_id", "left")
    on = F.col("known").isNull() | F.coalesce("other_value", F.lit(False))
    e = held.groupBy("log_id").agg(F.count("*").alias("errors"), F.count_if(on).alias("while_enabled"))
    out = u.join(e, "log_id", "full").na.fill(0, ["errors", "while_enabled"])
    return out.withColumn("assessment", F.when(F.col("while_enabled") > 0, "ENABLED").when(F.col("errors") > 0, "DISABLED_ONLY").otherwise("NONE"))


def analyze_auto(samples: DataFrame, setpoint: str, actual: str) -> DataFrame:
    """RMSE and largest error of path following within the autonomous phase."""
    s, a = numbers(samples.where(F.col("entry") == setpoint)).drop("entry"), numbers(samples.where(F.col("entry") == actual)).drop("entry")
    both = asof.hold(s, a, ["log_id"]).join(auto_window(samples), "log_id").where("ts between auto_start and auto_end and other_value is not null")
    e = F.col("value") - F.col("other_value")
    return both.groupBy("log_id").agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.max(F.abs(e)).alias("max_error"), F.count("*").alias("n"))


def moi_regression(
    velocity: DataFrame, current: DataFrame, keys: list[str], kt: float, gear_ratio: float, motors: int = 1, alpha_threshold: float = 1.0, half: int = 2,
    volts: DataFrame | None = None, wheel_radius: float | None = None,
) -> DataFrame:
    """Torque = J alpha + b omega by least squares through the origin over samples with enough acceleration.

    The torque has the sign of the applied volts if these are given, else that of the current. Series of fewer than ten velocities, or five
    used ones, give no row.
    """
    omega = F.col("value") / wheel_radius if wheel_radius and wheel_radius > 0 else F.col("value")
    many = velocity.groupBy(*keys).agg(F.count("value").alias("__n")).where("__n >= 10").drop("__n")
    moving = velocity.where("value is not null").join(many, keys, "left_semi").withColumn("value", omega)
    g = series.gradient(series.moving_average(moving, keys, half), keys, "smooth", "alpha").select(*keys, "ts", "seq", "smooth", "alpha")
    both = asof.lerp(g, current, keys).withColumnRenamed("other_value", "amps")
    torque = F.col("amps")
    if volts is not None:
        both = asof.lerp(both, volts, keys).withColumn("sign", F.signum("other_value")).where("abs(sign) >= 0.5")
        torque = F.abs("amps") * F.col("sign")
    used = both.where(finite(F.col("alpha")) & finite(F.col("smooth")) & finite(F.col("amps")) & (F.abs("alpha") >= alpha_threshold))
    fit = stats.regression(used.withColumn("torque", torque * kt * gear_ratio * motors), keys, "torque", "alpha", "smooth", 1e-10, 1e-15)
    return fit.where("n >= 5").withColumnsRenamed({"ca": "inertia", "cb": "damping"})


def report(samples: DataFrame, most_types: int = 10, most_errors: int = 5) -> DataFrame:
    """Basics, battery, errors (their number and the first few), code and the commonest types of each log."""
    base = samples.groupBy("log_id").agg(F.count("*").alias("samples"), F.countDistinct("entry").alias("entries"), F.min("ts").alias("begin"), F.max("ts").alias("end"))
    battery = numbers(entries_of(samples, "report_battery")).groupBy("log_id").agg(F.min("value").alias("battery_min"), F.max("value").alias("battery_max"))
    found = samples.where((F.col("type") == "string") & F.lower("v_str").rlike("error|exception|fault")).select("log_id", "entry", "ts", "seq", "v_str")
    errors = found.groupBy("log_id").agg(F.count("*").alias("errors"))
    text = F.when(F.length("v_str") > 100, F.concat(F.substring("v_str", 1, 100), F.lit("..."))).otherwise(F.col("v_str"))
    few = found.withColumn("n", F.row_number().over(Window.partitionBy("log_id").orderBy("entry", "ts", "seq"))).where(F.col("n") <= most_errors)
    few = few.groupBy("log_id").agg(F.sort_array(F.collect_list(F.struct("n", text.alias("text")))).alias("e")).select("log_id", F.col("e.text").alias("error_samples"))
    code = code_metadata(samples.where(F.col("entry").rlike("GitSHA|GitBranch"))).groupBy("log_id").agg(*(F.max(F.when(F.col("key") == k, F.col("value"))).alias(n) for k, n in (("GitSHA", "git_sha"), ("GitBranch", "git_branch"))))
    types = sampled_types(samples, most_types).groupBy("log_id").agg(F.sort_array(F.collect_list(F.struct("rank", "type", "n"))).alias("t"))
    types = types.select("log_id", F.transform("t", lambda x: F.struct(x["type"].alias("type"), x["n"].alias("n"))).alias("top_types"))
    out = base
    for part in (battery, errors, few, code, types):
        out = out.join(part, "log_id", "left")
    return out.na.fill(0, ["errors"]).withColumn("brownout_risk", F.when(F.col("battery_min") < 6.8, "HIGH").when(F.col("battery_min") < 9.0, "MODERATE").when(F.col("battery_min").isNotNull(), "LOW"))


def sampled_types(samples: DataFrame, most: int = 10) -> DataFrame:
    """log_id, type, n, rank: the types of most entries in each log; a top list."""
    n = samples.groupBy("log_id", "type").agg(F.countDistinct("entry").alias("n"))
    rank = F.row_number().over(Window.partitionBy("log_id").orderBy(F.desc("n"), "type"))
    return n.withColumn("rank", rank).where(F.col("rank") <= most)
