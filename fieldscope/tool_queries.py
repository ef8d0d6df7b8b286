"""Queries that run whole analyses over the driver's tables, with equivalent SQL: events become the samples of a log a user."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldscope.functions.values import json_number
from fieldscope.model import SAMPLES
from fieldscope.operators import export, fleet, series, stats, tools
from fieldscope.plans import sync
from fieldscope.streaming import events as streams

QUERIES, ORACLE_SQL = {}, {}
DAY = 86400.0


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df, digits=6):
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def events(spark, sf_dir):
    """log_id, kind, seq, ts (seconds), value, k."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("log_id"), F.col("event_type").alias("kind"), F.col("event_id").alias("seq"), us.alias("ts_us"), (us / 1e6).alias("ts"), "value", json_number("props", "$.k").alias("k"), "props")


def samples(e, names, **columns):
    """Events as samples: entries by kind (kinds without a name are left out), value columns as given, the others null."""
    entry = F.coalesce(*(F.when(F.col("kind") == k, F.lit(n)) for k, n in names.items()), F.lit(None).cast("string"))
    have = {"log_id": F.col("log_id"), "entry": entry, "type": F.lit("double"), "seq": F.col("seq"), "ts_us": F.col("ts_us"), "ts": F.col("ts")} | columns
    schema = [c.strip().split(" ") for c in SAMPLES.replace("map<string,double>", "map<string;double>").split(",")]
    cols = [(have[n] if n in have else F.lit(None)).cast(t.replace(";", ",")).alias(n) for n, t in schema]
    return e.select(*cols).where(F.col("entry").isNotNull())


def when(kinds, value):
    return F.when(F.col("kind").isin(*kinds), value)


E = "e AS (SELECT CAST(user_id AS VARCHAR) AS log_id, event_type AS kind, event_id AS seq, epoch_us(ts) / 1e6 AS ts, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, props FROM events)"


def lerp_sql(left, right, name="j"):
    """Rows of `left` with `other`, interpolated between the rows of `right` around their times."""
    return f"""{name}_r AS (SELECT *, lead(ts) OVER w AS nts, lead(value) OVER w AS nvalue FROM {right} WINDOW w AS (PARTITION BY log_id ORDER BY ts, seq)),
{name} AS (SELECT l.*, CASE WHEN r.ts = l.ts THEN r.value WHEN r.nts IS NOT NULL THEN r.value + (r.nvalue - r.value) * (l.ts - r.ts) / (r.nts - r.ts) END AS other FROM {left} l ASOF LEFT JOIN {name}_r r ON l.log_id = r.log_id AND l.ts >= r.ts)"""


SIDES = "c AS (SELECT * FROM e WHERE kind = 'click'), v AS (SELECT * FROM e WHERE kind = 'view')"


@query(f"WITH {E} SELECT log_id, 'PDH/Voltage' AS entry, round(min(value), 6) AS min_v, round(max(value), 6) AS max_v, round(avg(value), 6) AS avg_v, CAST(count(*) FILTER (value < 6.8) AS BIGINT) AS below, CASE WHEN count(*) FILTER (value < 6.8) > 0 THEN 'HIGH' WHEN min(value) < 7.8 THEN 'MODERATE' ELSE 'LOW' END AS risk FROM e WHERE kind = 'click' GROUP BY log_id")
def power_analysis(spark, sf_dir):
    return rounded(tools.power_analysis(samples(events(spark, sf_dir), {"click": "PDH/Voltage", "view": "RIO/InputVoltage"}, v_num=F.col("value"))))


def _states(spark, sf_dir):
    names = {"view": "/DriverStation/Enabled", "signup": "/DriverStation/Autonomous", "click": "/Robot/BatteryVoltage", "purchase": "/Path/Setpoint", "error": "/Path/Actual"}
    numbers = ("click", "purchase", "error")
    return samples(events(spark, sf_dir), names, v_bool=when(("view", "signup"), F.col("value") > 50), v_num=when(numbers, F.col("value")))


PHASES = f"""WITH {E}, en AS (SELECT *, value > 50 AS up, lag(value > 50) OVER (PARTITION BY log_id ORDER BY ts, seq) AS was FROM e WHERE kind = 'view'),
au AS (SELECT l.log_id, l.ts, l.value > 50 AS auto, coalesce(r.up, false) AS enabled FROM (SELECT * FROM e WHERE kind = 'signup') l ASOF LEFT JOIN en r ON l.log_id = r.log_id AND l.ts >= r.ts),
a AS (SELECT log_id, min(ts) FILTER (auto AND enabled) AS while_enabled, min(ts) FILTER (auto) AS flag_up FROM au GROUP BY log_id),
o AS (SELECT au.log_id, min(ts) AS auto_end FROM au JOIN a ON au.log_id = a.log_id AND NOT auto AND ts > flag_up GROUP BY au.log_id),
n AS (SELECT en.log_id, min(ts) AS next_enable FROM en JOIN a ON en.log_id = a.log_id AND up AND NOT coalesce(was, false) AND ts >= flag_up GROUP BY en.log_id),
r AS (SELECT en.log_id, min(ts) AS re_enabled FROM en JOIN o ON en.log_id = o.log_id AND up AND NOT coalesce(was, false) AND ts >= auto_end GROUP BY en.log_id),
s AS (SELECT o.log_id, coalesce(en.up, false) AS on_at_end FROM o ASOF LEFT JOIN en ON o.log_id = en.log_id AND o.auto_end >= en.ts),
d AS (SELECT log_id, max(ts) AS disabled FROM en WHERE NOT up AND was GROUP BY log_id), m AS (SELECT log_id, max(ts) AS max_ts FROM e GROUP BY log_id),
t AS (SELECT m.log_id, coalesce(while_enabled, next_enable) AS auto_start, coalesce(re_enabled, CASE WHEN on_at_end THEN auto_end END) AS teleop_start, coalesce(disabled, max_ts) AS teleop_end
    FROM m LEFT JOIN a USING (log_id) LEFT JOIN o USING (log_id) LEFT JOIN n USING (log_id) LEFT JOIN r USING (log_id) LEFT JOIN s USING (log_id) LEFT JOIN d USING (log_id))"""


@query(PHASES + " SELECT log_id, round(auto_start, 6) AS auto_start, round(teleop_start, 6) AS teleop_start, round(teleop_end, 6) AS teleop_end, round(CASE WHEN teleop_start IS NOT NULL THEN greatest(teleop_start, teleop_end - 20) END, 6) AS endgame_start FROM t")
def get_match_phases(spark, sf_dir):
    return rounded(tools.match_phases(_states(spark, sf_dir)))


HYSTERESIS = """{n}_s AS (SELECT *, coalesce(last_value(CASE WHEN value < {low} THEN 1 WHEN value >= {high} THEN 0 END IGNORE NULLS) OVER (PARTITION BY log_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 0) AS state FROM c),
{n}_b AS (SELECT *, CASE WHEN state = 1 AND coalesce(lag(state) OVER (PARTITION BY log_id ORDER BY ts, seq), 0) = 0 THEN 1 ELSE 0 END AS begun FROM {n}_s),
{n}_e AS (SELECT *, sum(begun) OVER (PARTITION BY log_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS event FROM {n}_b),
{n} AS (SELECT log_id, event, min(ts) AS "begin", coalesce(min(ts) FILTER (state = 0), max(ts)) AS "end", min(state) = 0 AS closed FROM {n}_e WHERE event > 0 GROUP BY log_id, event)"""


@query(PHASES + ", c AS (SELECT * FROM e WHERE kind = 'click'), " + HYSTERESIS.format(n="b", low=6.8, high="6.8 + 0.2") + """
SELECT log_id, round(ts, 6) AS ts, 'enable' AS category, CASE WHEN up THEN 'ENABLED' ELSE 'DISABLED' END AS event FROM en WHERE was IS NULL OR was <> up
UNION ALL SELECT log_id, round(auto_start, 6), 'phase', 'AUTO_START' FROM t WHERE auto_start IS NOT NULL UNION ALL SELECT log_id, round(teleop_start, 6), 'phase', 'TELEOP_START' FROM t WHERE teleop_start IS NOT NULL
UNION ALL SELECT log_id, round("begin", 6), 'brownout', 'BROWNOUT_START' FROM b UNION ALL SELECT log_id, round("end", 6), 'brownout', 'BROWNOUT_END' FROM b WHERE closed""")
def get_ds_timeline(spark, sf_dir):
    return rounded(tools.ds_timeline(_states(spark, sf_dir)))


@query(PHASES + """, f AS (SELECT log_id, min(ts) FILTER (auto AND enabled) AS direct, min(ts) FILTER (auto) AS flag_up FROM au GROUP BY log_id),
fe AS (SELECT f.*, (SELECT min(ts) FROM au WHERE au.log_id = f.log_id AND NOT auto AND ts > flag_up) AS flag_end, (SELECT min(ts) FROM au WHERE au.log_id = f.log_id AND NOT auto AND ts > direct) AS direct_end FROM f),
fl AS (SELECT fe.*, (SELECT min(ts) FROM en WHERE en.log_id = fe.log_id AND up AND ts >= flag_up AND (flag_end IS NULL OR ts < flag_end)) AS later FROM fe),
aw AS (SELECT log_id, coalesce(direct, later) AS b, coalesce(CASE WHEN direct IS NOT NULL THEN direct_end ELSE flag_end END, coalesce(direct, later) + 15) AS x FROM fl),
l AS (SELECT * FROM e WHERE kind = 'purchase'), h AS (SELECT * FROM e WHERE kind = 'error'), j AS (SELECT l.log_id, l.ts, l.value - h.value AS d FROM l ASOF JOIN h ON l.log_id = h.log_id AND l.ts >= h.ts)
SELECT log_id, round(sqrt(avg(d * d)), 6) AS rmse, round(max(abs(d)), 6) AS max_error, count(*) AS n FROM j JOIN aw USING (log_id) WHERE ts BETWEEN b AND x GROUP BY log_id""")
def analyze_auto(spark, sf_dir):
    return rounded(tools.analyze_auto(_states(spark, sf_dir), "/Path/Setpoint", "/Path/Actual"))


@query(f"WITH {E}, c AS (SELECT * FROM e WHERE kind = 'click'), " + HYSTERESIS.format(n="b", low=6.8, high="6.8 + 0.2") + ", " + HYSTERESIS.format(n="w", low=9.0, high="9.0 + 0.2") + """,
bn AS (SELECT log_id, count(*) AS brownouts, sum("end" - "begin") AS bs FROM b GROUP BY 1), wn AS (SELECT log_id, count(*) AS warnings, sum("end" - "begin") AS ws FROM w GROUP BY 1), base AS (SELECT log_id, min(value) AS min_v, avg(value) AS avg_v FROM c GROUP BY 1),
dr AS (SELECT * FROM (SELECT *, lag(value) OVER (PARTITION BY log_id ORDER BY ts, seq) AS was FROM c) WHERE was - value > 0.5),
rt AS (SELECT dr.log_id, dr.seq, min(c.ts) - dr.ts AS seconds FROM dr JOIN c ON c.log_id = dr.log_id AND c.ts > dr.ts AND c.ts <= dr.ts + 2 AND c.value >= dr.value + 0.9 * (dr.was - dr.value) GROUP BY dr.log_id, dr.seq, dr.ts),
rc AS (SELECT log_id, avg(seconds) AS recovery FROM rt WHERE log_id IN (SELECT log_id FROM e WHERE kind = 'view') GROUP BY 1),
s AS (SELECT log_id, min_v, avg_v, coalesce(brownouts, 0) AS brownouts, coalesce(bs, 0) AS bs, coalesce(warnings, 0) AS warnings, coalesce(ws, 0) AS ws, recovery FROM base LEFT JOIN bn USING (log_id) LEFT JOIN wn USING (log_id) LEFT JOIN rc USING (log_id)),
g AS (SELECT *, CAST(greatest(0, least(100, 100 - CASE WHEN avg_v / 12.6 < 0.88 THEN trunc((0.88 - avg_v / 12.6) * 150) ELSE 0 END - 20 * brownouts - 5 * greatest(0, warnings - brownouts)
    - CASE WHEN recovery > 0.5 THEN trunc((recovery - 0.5) * 20) ELSE 0 END - CASE WHEN min_v < 10 THEN trunc((10 - min_v) * 10) ELSE 0 END)) AS INTEGER) AS score FROM s)
SELECT log_id, round(min_v, 6) AS min_v, round(avg_v, 6) AS avg_v, brownouts, round(bs, 3) AS brownouts_seconds, warnings, round(ws, 3) AS warnings_seconds, round(recovery, 3) AS recovery, score,
    CASE WHEN min_v < 6.8 THEN 'CRITICAL' WHEN min_v < 9 OR score < 30 THEN 'HIGH' WHEN score < 60 THEN 'MODERATE' WHEN score < 80 THEN 'LOW' ELSE 'MINIMAL' END AS risk FROM g""")
def predict_battery_health(spark, sf_dir):
    out = tools.battery_health(samples(events(spark, sf_dir), {"click": "/Robot/BatteryVoltage", "view": "/PDH/TotalCurrent"}, v_num=F.col("value")))
    return rounded(out.withColumns({c: F.round(c, 3) for c in ("brownouts_seconds", "warnings_seconds", "recovery")}))


def _struct(**fields):
    return F.create_map(*(x for k, v in fields.items() for x in (F.lit(k), F.col(v))))


@query(f"""WITH {E}, {SIDES}, f AS (SELECT *, value > 50 AS up, lag(value > 50) OVER (PARTITION BY log_id ORDER BY ts, seq) AS was FROM v), m AS (SELECT *, ts - lag(ts) OVER (PARTITION BY log_id ORDER BY ts, seq) AS gap FROM f WHERE was <> up),
q AS (SELECT log_id, count(*) AS flickers FROM m WHERE gap < 86400 GROUP BY 1), p AS (SELECT log_id, sqrt((value - lag(value) OVER w) ** 2 + (k - lag(k) OVER w) ** 2) AS d FROM c WINDOW w AS (PARTITION BY log_id ORDER BY ts, seq)),
x AS (SELECT log_id, count(*) AS jumps, max(d) AS max_jump FROM p WHERE d > 50 GROUP BY 1), r AS (SELECT log_id, avg(CAST(up AS INTEGER)) AS rate, count(*) AS n FROM f GROUP BY 1)
SELECT log_id, round(rate, 6) AS acquisition_rate, n, coalesce(flickers, 0) AS flickers, coalesce(jumps, 0) AS jumps, round(max_jump, 6) AS max_jump FROM r LEFT JOIN q USING (log_id) LEFT JOIN x USING (log_id)""")
def analyze_vision(spark, sf_dir):
    s = samples(events(spark, sf_dir), {"view": "/Vision/HasTarget", "click": "/Vision/Pose"}, v_bool=when(("view",), F.col("value") > 50), v_struct=when(("click",), _struct(x="value", y="k")))
    return rounded(tools.analyze_vision(s, DAY, 50.0))


@query(f"WITH {E}, {SIDES}, {lerp_sql('v', 'c')}, d AS (SELECT log_id, abs(abs(value) - abs(other)) AS d, abs(abs(value) - abs(other)) / abs(other) AS slip FROM j WHERE abs(other) > 0.01) SELECT log_id, '/Drive/Module0/Setpoint' AS setpoint, '/Drive/Module0/Measured' AS measured, round(max(slip), 4) AS max_slip, round(avg(slip), 4) AS avg_slip, count(*) FILTER (d > 50) AS events, round(avg(CASE WHEN d > 50 THEN 1.0 ELSE 0.0 END), 6) AS event_rate, count(*) AS n FROM d GROUP BY 1")
def swerve_wheel_slip(spark, sf_dir):
    s = samples(events(spark, sf_dir), {"click": "/Drive/Module0/Setpoint", "view": "/Drive/Module0/Measured"}, v_struct=_struct(speed_mps="value"))
    return rounded(tools.wheel_slip(s, 50.0).withColumns({c: F.round(c, 4) for c in ("max_slip", "avg_slip")}))


@query(f"WITH {E} SELECT log_id, '/Drive/Module-' || kind AS entry, round(max(abs(value)), 6) AS max_speed, round(avg(abs(value)), 6) AS avg_speed FROM e WHERE kind IN ('click', 'view') GROUP BY 1, 2")
def swerve_module_speeds(spark, sf_dir):
    s = samples(events(spark, sf_dir), {k: f"/Drive/Module-{k}" for k in ("click", "view")}, v_struct=_struct(speed_mps="value"))
    return rounded(tools.swerve_modules(s))


@query(f"""WITH {E}, a AS (SELECT log_id, kind, value / 100 AS angle, row_number() OVER (PARTITION BY log_id, kind ORDER BY ts, seq) AS i FROM e), m AS (SELECT log_id, i, atan2(sum(sin(angle)), sum(cos(angle))) AS mean FROM a GROUP BY 1, 2),
d AS (SELECT log_id, kind, abs(atan2(sin(angle - mean), cos(angle - mean))) AS "off" FROM a JOIN m USING (log_id, i)) SELECT log_id, '/Drive/' || kind || '/Measured' AS entry, round(max("off"), 6) AS max_off, count(*) FILTER ("off" > 0.1) AS desynced FROM d GROUP BY 1, 2""")
def swerve_steering_sync(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("angle", F.col("value") / 100)
    return rounded(tools.steering_sync(samples(e, {k: f"/Drive/{k}/Measured" for k in ("click", "view", "error", "purchase", "signup")}, v_struct=_struct(angle_rad="angle"))))


@query(f"WITH {E}, {SIDES}, d AS (SELECT c.log_id, sqrt((c.value - v.value) ** 2 + (c.k - v.k) ** 2) AS d FROM c ASOF JOIN v ON c.log_id = v.log_id AND c.ts >= v.ts) SELECT log_id, round(avg(d), 6) AS avg_drift, round(max(d), 6) AS max_drift, count(*) AS n FROM d GROUP BY 1")
def swerve_odometry_drift(spark, sf_dir):
    return rounded(tools.odometry_drift(samples(events(spark, sf_dir), {"click": "/Vision/Pose", "view": "/Odometry/Robot"}, v_struct=_struct(x="value", y="k"))))


@query(f"""WITH {E}, {SIDES}, r AS (SELECT c.log_id, c.ts, c.value > 50 AS a, v.value > 50 AS b, row_number() OVER (PARTITION BY c.log_id, c.seq ORDER BY v.ts, v.seq) AS n, v.ts AS vts FROM c JOIN v ON c.log_id = v.log_id AND v.ts >= c.ts - 86400)
SELECT log_id, 'ReplayOutputs/X' AS entry, CASE WHEN arg_min(a, ts) FILTER (a <> b) THEN '{{"v_bool":true}}' ELSE CASE WHEN count(*) FILTER (a <> b) > 0 THEN '{{"v_bool":false}}' END END AS first_real, CASE WHEN arg_min(b, ts) FILTER (a <> b) THEN '{{"v_bool":true}}' ELSE CASE WHEN count(*) FILTER (a <> b) > 0 THEN '{{"v_bool":false}}' END END AS first_replayed, count(*) AS compared, count(*) FILTER (a <> b) AS differing, round(min(ts) FILTER (a <> b), 6) AS first_ts FROM r WHERE n = 1 AND abs(vts - ts) <= 86400 GROUP BY 1""")
def analyze_replay_drift(spark, sf_dir):
    s = samples(events(spark, sf_dir), {"click": "RealOutputs/X", "view": "ReplayOutputs/X"}, v_bool=F.col("value") > 50)
    return rounded(tools.replay_drift(s, DAY))


@query(f"WITH {E}, u AS (SELECT log_id, avg(value) AS a, max(value) AS m FROM e WHERE kind = 'click' GROUP BY 1), k AS (SELECT DISTINCT log_id AS kid FROM e WHERE kind = 'view'), y AS (SELECT l.log_id, k.kid IS NULL OR coalesce(v.value > 50, false) AS held FROM (SELECT * FROM e WHERE kind = 'error' AND value > 20) l ASOF LEFT JOIN (SELECT log_id AS lid, ts AS vts, value FROM e WHERE kind = 'view') v ON l.log_id = v.lid AND l.ts >= v.vts LEFT JOIN k ON k.kid = l.log_id), x AS (SELECT log_id, count(*) AS errors, count(*) FILTER (held) AS w FROM y GROUP BY 1) SELECT log_id, round(a, 6) AS avg_utilisation, round(m, 6) AS max_utilisation, coalesce(errors, 0) AS errors, coalesce(w, 0) AS while_enabled, CASE WHEN coalesce(w, 0) > 0 THEN 'ENABLED' WHEN coalesce(errors, 0) > 0 THEN 'DISABLED_ONLY' ELSE 'NONE' END AS assessment FROM u FULL JOIN x USING (log_id)")
def analyze_can_bus(spark, sf_dir):
    return rounded(tools.analyze_can_bus(samples(events(spark, sf_dir), {"click": "/CANBus/Utilization", "error": "/CANBus/Error", "view": "/DriverStation/Enabled"}, v_num=when(("click",), F.col("value")), v_bool=F.when(F.col("kind") == "error", F.col("value") > 20).when(F.col("kind") == "view", F.col("value") > 50))))


@query(f"""WITH {E}, {SIDES}, h AS (SELECT * REPLACE (ts / 3600 AS ts) FROM c), hv AS (SELECT * REPLACE (ts / 3600 AS ts) FROM v), s AS (SELECT *, avg(value) OVER (PARTITION BY log_id ORDER BY ts, seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth FROM h),
g AS (SELECT *, (coalesce(lead(smooth) OVER w, smooth) - coalesce(lag(smooth) OVER w, smooth)) / (coalesce(lead(ts) OVER w, ts) - coalesce(lag(ts) OVER w, ts)) AS alpha FROM s WINDOW w AS (PARTITION BY log_id ORDER BY ts, seq)), {lerp_sql('g', 'hv')},
q AS (SELECT log_id, alpha AS a, smooth AS b, other * 0.5 AS y FROM j WHERE other IS NOT NULL AND abs(alpha) >= 0.05), z AS (SELECT log_id, count(*) AS n, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(y * a) AS ya, sum(y * b) AS yb FROM q GROUP BY 1)
SELECT log_id, n, round((ya * bb - yb * ab) / (aa * bb - ab * ab), 4) AS inertia, round((yb * aa - ya * ab) / (aa * bb - ab * ab), 4) AS damping FROM z WHERE n >= 5 AND log_id IN (SELECT log_id FROM c GROUP BY 1 HAVING count(*) >= 10)""")
def moi_regression(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("ts", F.col("ts") / 3600)
    side = lambda k: e.where(F.col("kind") == k).select("log_id", "ts", "seq", "value")
    return rounded(tools.moi_regression(side("click"), side("view"), ["log_id"], 0.05, 10.0, 1, 0.05).select("log_id", "n", "inertia", "damping"), 4)


@query(f"""WITH {E}, {SIDES}, {lerp_sql('c', 'v')}, p AS (SELECT *, coalesce(value < 100 AND other > 30, false) AS o FROM j), x AS (SELECT *, sum(CASE WHEN o AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY log_id ORDER BY ts, seq) AS run FROM (SELECT *, coalesce(lag(o) OVER (PARTITION BY log_id ORDER BY ts, seq), false) AS was FROM p))
SELECT log_id, round(min(ts), 6) AS "begin", round(min(ts) FILTER (NOT o), 6) AS "end", round(max(other) FILTER (o), 6) AS peak FROM x WHERE run > 0 GROUP BY log_id, run HAVING count(*) FILTER (NOT o) > 0""")
def mechanism_stalls(spark, sf_dir):
    e = events(spark, sf_dir)
    side = lambda k, f=1.0: e.where(F.col("kind") == k).select("log_id", "ts", "seq", (F.col("value") * f).alias("value"))
    return rounded(tools.profile_mechanism(side("click"), side("error"), ["log_id"], side("click", 1e-4), side("view"))["stalls"])


@query()
def mechanism_segments(spark, sf_dir):
    e = events(spark, sf_dir)
    side = lambda k: e.where(F.col("kind") == k).select("log_id", "ts", "seq", "value")
    return rounded(tools.profile_mechanism(side("click"), side("view"), ["log_id"])["segments"])


@query(f"""WITH {E}, b AS (SELECT log_id, count(*) AS samples, count(DISTINCT kind) AS entries, min(ts) AS "begin", max(ts) AS "end", min(value) FILTER (kind = 'click') AS lo, max(value) FILTER (kind = 'click') AS hi, count(*) FILTER (kind = 'error') AS errors, count(DISTINCT kind) FILTER (kind NOT IN ('error', 'view')) AS doubles, count(DISTINCT kind) FILTER (kind IN ('error', 'view')) AS strings FROM e GROUP BY 1), g AS (SELECT log_id, arg_min(props, (ts, seq)) AS sha FROM e WHERE kind = 'view' GROUP BY 1)
SELECT log_id, samples, entries, round("begin", 6) AS "begin", round("end", 6) AS "end", round(lo, 6) AS battery_min, round(hi, 6) AS battery_max, errors, CASE WHEN lo < 6.8 THEN 'HIGH' WHEN lo < 9 THEN 'MODERATE' WHEN lo IS NOT NULL THEN 'LOW' END AS brownout_risk, nullif(concat_ws(' | ', CASE WHEN errors > 0 THEN 'Fault: lost' END, CASE WHEN errors > 1 THEN 'Fault: lost' END, CASE WHEN errors > 2 THEN 'Fault: lost' END, CASE WHEN errors > 3 THEN 'Fault: lost' END, CASE WHEN errors > 4 THEN 'Fault: lost' END), '') AS samples_of_errors, sha AS git_sha, concat_ws(' ', CASE WHEN doubles > 0 THEN 'double ' || doubles END, CASE WHEN strings > 0 THEN 'string ' || strings END) AS types FROM b LEFT JOIN g USING (log_id)""")
def generate_report(spark, sf_dir):
    names = {k: k for k in ("error", "purchase", "signup")} | {"click": "/BatteryVoltage", "view": "Metadata/GitSHA"}
    text = F.when(F.col("kind") == "error", F.lit("Fault: lost")).when(F.col("kind") == "view", F.col("props"))
    kind = F.when(F.col("kind").isin("error", "view"), "string").otherwise("double")
    out = tools.report(samples(events(spark, sf_dir), names, type=kind, v_num=when(("click",), F.col("value")), v_str=text))
    types = F.array_join(F.sort_array(F.transform("top_types", lambda x: F.concat_ws(" ", x["type"], x["n"].cast("string")))), " ")
    return rounded(out.withColumns({"samples_of_errors": F.array_join("error_samples", " | "), "types": types}).drop("error_samples", "top_types", "git_branch"))


@query(f"WITH {E} SELECT log_id, CASE kind WHEN 'click' THEN 'GitSHA' ELSE 'Version' END AS key, arg_min(props, (ts, seq)) AS value FROM e WHERE kind IN ('click', 'view') GROUP BY 1, 2")
def get_code_metadata(spark, sf_dir):
    return tools.code_metadata(samples(events(spark, sf_dir), {"click": "Metadata/GitSHA", "view": "Metadata/Version"}, v_str=F.col("props")))


@query(f"WITH {E}, x AS (SELECT log_id, count(*) AS total, count(*) FILTER (coalesce(v.value > 50, false)) AS w FROM (SELECT * FROM e WHERE kind = 'error') l ASOF LEFT JOIN (SELECT log_id AS lid, ts AS vts, value FROM e WHERE kind = 'view') v ON l.log_id = v.lid AND l.ts >= v.vts GROUP BY 1), k AS (SELECT log_id, count(*) FILTER (kind = 'view') > 0 AS known FROM e GROUP BY 1) SELECT log_id, coalesce(total, 0) AS total, coalesce(w, 0) AS while_enabled, CASE WHEN CASE WHEN known THEN coalesce(w, 0) ELSE coalesce(total, 0) END = 0 THEN 'GOOD' WHEN CASE WHEN known THEN coalesce(w, 0) ELSE coalesce(total, 0) END < 50 THEN 'CONCERNING' ELSE 'POOR' END AS assessment FROM k LEFT JOIN x USING (log_id)")
def can_errors_by_state(spark, sf_dir):
    names = {"view": "/DriverStation/Enabled", "error": "messages", "click": "c", "purchase": "p", "signup": "s"}
    return tools.can_health(samples(events(spark, sf_dir), names, v_bool=when(("view",), F.col("value") > 50), v_str=when(("error",), F.lit("CAN timeout"))))


@query("SELECT CAST(vec_id AS DOUBLE) AS timestamp, CAST(i - 1 AS INTEGER) AS index, CAST(NULL AS VARCHAR) AS field, round(CAST(embedding[i] AS DOUBLE), 6) AS value FROM embeddings, unnest(range(1, 65)) t(i) WHERE embedding[i] IS NOT NULL")
def export_rows(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("double").alias("ts"), F.lit(None).cast("double").alias("v_num"), F.lit(None).cast("boolean").alias("v_bool"), F.lit(None).cast("string").alias("v_str"), F.col("embedding").cast("array<double>").alias("v_arr_num"), F.lit(None).cast("array<string>").alias("v_arr_str"), F.lit(None).cast("map<string,double>").alias("v_struct"))
    return rounded(export.csv_rows(v).withColumn("value", F.col("value").cast("double")))


@query(f"""WITH {E}, s AS (SELECT log_id, ts, coalesce(var_samp(value) OVER (PARTITION BY log_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND 864000.0 FOLLOWING), 0) AS spread FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY spread DESC, ts) AS n FROM s) SELECT log_id, round(ts, 6) AS "begin", round(spread, 2) AS variance FROM r WHERE n = 1""")
def high_variance_window(spark, sf_dir):
    return rounded(stats.high_variance_window(events(spark, sf_dir), ["log_id"], 10 * DAY).withColumn("variance", F.round("variance", 2)))


@query("""WITH d AS (SELECT DISTINCT l_discount * 10 AS r, l_quantity AS n FROM lineitem), t AS (SELECT *, CASE WHEN abs(r) < 1 AND n > 2 THEN abs(r) * sqrt((n - 2) / (1 - r * r)) END AS t, n - 2.5 AS a, 48 * (n - 2.5) ** 2 AS b FROM d), y AS (SELECT *, CASE WHEN n > 2 THEN sqrt(a * ln(1 + t * t / (n - 2))) END AS y FROM t), z AS (SELECT *, y + (y ** 3 + 3 * y) / b - (4 * y ** 7 + 33 * y ** 5 + 240 * y ** 3 + 855 * y) / (10 * b * b) AS z FROM y), k AS (SELECT *, 1 / (1 + 0.2316419 * z) AS k FROM z)
SELECT round(r, 6) AS r, round(n, 6) AS n, round(CASE WHEN n <= 2 THEN 1 WHEN n < 15 THEN NULL WHEN abs(r) >= 1 THEN 0 ELSE 2 * exp(-z * z / 2) / 2.5066282746310002 * k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429)))) END, 6) AS p_value FROM k""")
def correlation_p_value(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("r"), F.col("l_quantity").alias("n")).distinct()
    return rounded(d.withColumn("p_value", stats.p_value(F.when(F.col("n") != 2, F.col("r")), F.col("n"))))


@query("SELECT user_id, CAST(time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS TIMESTAMP) AS begin, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def windowed_statistics(spark, sf_dir):
    """The streaming aggregation over a table read whole."""
    e = table(spark, sf_dir, "events")
    out = streams.windowed_statistics(e.select("user_id", F.col("ts").cast("timestamp").alias("time"), "value"), ["user_id"], "7 days")
    return rounded(out.select("user_id", F.col("window.start").cast("timestamp_ntz").alias("begin"), F.col("count").alias("n"), "mean"))


@query(f"""WITH {E}, l AS (SELECT log_id, min(ts) AS b, min(ts) + 3600 AS x FROM e GROUP BY 1), p AS (SELECT seq, ts FROM e WHERE kind = 'purchase') SELECT log_id, seq, round(ts, 6) AS start FROM l JOIN p ON ts BETWEEN b - 300 AND x + 300""")
def overlapping_logs(spark, sf_dir):
    e = events(spark, sf_dir)
    logs = e.groupBy("log_id").agg(F.min("ts").alias("begin")).withColumn("end", F.col("begin") + 3600)
    return rounded(fleet.overlapping(logs, e.where("kind = 'purchase'").select("seq", F.col("ts").alias("start")), 300.0).select("log_id", "seq", "start"))


@query(f"""WITH {E}, v AS (SELECT * FROM e WHERE kind = 'view'), p AS (SELECT * FROM e WHERE kind = 'purchase'), a AS (SELECT v.log_id, v.seq, v.ts, p.ts AS t0, p.seq AS ak FROM v ASOF LEFT JOIN p ON v.log_id = p.log_id AND v.ts >= p.ts),
b AS (SELECT a.*, p.ts AS bt, p.seq AS bk FROM a ASOF LEFT JOIN p ON a.log_id = p.log_id AND a.ts < p.ts), d AS (SELECT *, CASE WHEN t0 IS NOT NULL AND (bt IS NULL OR ts - t0 <= bt - ts) THEN ts - t0 ELSE bt - ts END AS d, CASE WHEN t0 IS NOT NULL AND (bt IS NULL OR ts - t0 <= bt - ts) THEN ak ELSE bk END AS k FROM b)
SELECT log_id, seq, CASE WHEN d <= 172800 THEN k END AS match_key, round(CASE WHEN d <= 172800 THEN d END, 3) AS distance FROM d""")
def nearest_match(spark, sf_dir):
    e = events(spark, sf_dir)
    out = fleet.nearest_match(e.where("kind = 'view'").select("log_id", "ts", "seq"), e.where("kind = 'purchase'").select("log_id", "ts", F.col("seq").alias("match_key")), 2 * DAY, "log_id")
    return out.select("log_id", "seq", "match_key", F.round("distance", 3).alias("distance"))


@query(f"WITH {E}, n AS (SELECT log_id, seq AS match_key, row_number() OVER (PARTITION BY log_id ORDER BY ts, seq) AS n FROM e WHERE kind = 'purchase') SELECT v.log_id, CAST(v.k AS INTEGER) AS match_number, v.seq, n.match_key FROM e v LEFT JOIN n ON v.log_id = n.log_id AND v.k = n.n WHERE v.kind = 'view'")
def nth_match(spark, sf_dir):
    e = events(spark, sf_dir)
    return fleet.nth_match(e.where("kind = 'view'").select("log_id", F.col("k").cast("int").alias("match_number"), "seq"), e.where("kind = 'purchase'").select("log_id", "ts", F.col("seq").alias("match_key")), "log_id")


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'qm' || o_custkey WHEN 1 THEN 'sf' || o_custkey || 'm1' WHEN 2 THEN 'qf' || o_custkey || 'm1' ELSE 'f1m' || o_custkey END AS match_key FROM orders")
def match_keys(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("QM", "sf", "qf", "F"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", fleet.match_key(kind, F.col("o_custkey")).alias("match_key"))


@query("""WITH m AS (SELECT o_orderpriority AS event, o_orderkey AS match_key, o_custkey AS team, o_totalprice AS s, o_orderkey * 10.0 AS t, 'red' AS alliance FROM orders UNION ALL SELECT o_orderpriority, o_orderkey, o_custkey + 1, o_orderkey * 10.0, o_totalprice, 'blue' FROM orders)
SELECT o_orderpriority AS event, o_orderkey AS match_key, o_custkey + o_orderkey % 3 AS team, alliance, round(s, 2) AS score, round(t, 2) AS opponent_score, s > t AS won FROM orders LEFT JOIN m ON event = o_orderpriority AND match_key = o_orderkey AND team = o_custkey + o_orderkey % 3""")
def match_outcomes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    matches = o.select(F.col("o_orderpriority").alias("event"), F.col("o_orderkey").alias("match_key"), F.array("o_custkey").alias("red"), F.array(F.col("o_custkey") + 1).alias("blue"), F.col("o_totalprice").alias("red_score"), (F.col("o_orderkey") * 10.0).alias("blue_score"))
    logs = o.select(F.col("o_orderpriority").alias("event"), F.col("o_orderkey").alias("match_key"), (F.col("o_custkey") + F.col("o_orderkey") % 3).alias("team"))
    return rounded(fleet.outcomes(logs, matches), 2)


@query("WITH c AS (SELECT CAST(s_nationkey AS VARCHAR) AS log_id, abs(s_acctbal) / 10000 AS c FROM supplier), u AS (SELECT log_id, CASE WHEN log_id = '7' THEN 0.5 ELSE c END AS c FROM c) SELECT log_id, count(*) AS n, count(*) FILTER (c < 0.3) AS failed, round(avg(c), 6) AS mean_confidence, round(min(c), 6) AS worst_confidence FROM u GROUP BY 1")
def sync_status(spark, sf_dir):
    c = F.abs("s_acctbal") / 10000
    syncs = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("log_id"), F.lit("can").alias("bus"), F.lit(1.0).alias("offset"), F.lit(0.0).alias("drift"), c.alias("confidence"), sync.confidence_level(c).alias("level"), F.lit("CROSS").alias("method"))
    return rounded(fleet.sync_status(fleet.set_offset(syncs, "7", 2.5, "can")))


@query(f"WITH {E}, {SIDES} SELECT log_id, seq, round(ts + 5 + CASE WHEN CAST(log_id AS BIGINT) % 3 = 0 THEN 0 ELSE (ts - 1704067200) * 20000 / 1e9 END - ts, 4) AS shift FROM c WHERE CAST(log_id AS BIGINT) % 2 = 0 UNION ALL SELECT log_id, seq, 0.0 FROM c WHERE CAST(log_id AS BIGINT) % 2 = 1")
def clock_shift(spark, sf_dir):
    e = events(spark, sf_dir).where("kind = 'click'").select("log_id", "seq", "ts")
    n = F.col("log_id").cast("long")
    syncs = e.select("log_id").distinct().where(n % 2 == 0).withColumns({"offset": F.lit(5.0), "drift": F.when(n % 3 == 0, 0.0).otherwise(20000.0), "reference": F.lit(1704067200.0)})
    moved = fleet.on_log_time(e.withColumn("before", F.col("ts")), syncs)
    return moved.select("log_id", "seq", F.round(F.col("ts") - F.col("before"), 4).alias("shift"))


@query(f"WITH {E}, p AS (SELECT seq, ts, value FROM e WHERE kind = 'click' AND ts >= 1704153600 ORDER BY ts, seq LIMIT 1000) SELECT seq, round(ts, 6) AS ts, round(value, 6) AS value, round(min(value) OVER (), 6) AS min, round(max(value) OVER (), 6) AS max, round(avg(value) OVER (), 6) AS mean FROM p")
def get_revlog_data(spark, sf_dir):
    return rounded(fleet.signal_page(events(spark, sf_dir).where("kind = 'click'").select("seq", "ts", "value"), 1704153600.0))


@query("SELECT DISTINCT p_brand || '/' || p_type AS entry FROM part WHERE contains(lower(p_brand), '3') AND contains(lower(p_type), 'e')")
def list_revlog_signals(spark, sf_dir):
    return fleet.list_signals(table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("entry")).distinct(), "3", "E")


@query("""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS path, encode(text) AS b, octet_length(encode(text)) AS n FROM documents), h AS (SELECT *, hex(b) AS x FROM d)
SELECT path, sha256(encode(CAST(n AS VARCHAR)) || unhex(substr(x, 1, 131072)) || CASE WHEN n > 196608 THEN unhex(substr(x, 2 * (n // 2 - 32768) + 1, 131072)) ELSE ''::BLOB END || unhex(substr(x, 2 * greatest(n - 65536, 0) + 1, 131072))) AS fingerprint FROM h""")
def file_fingerprints(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"), F.octet_length("text").cast("long").alias("length"))
    return fleet.fingerprint(files)
