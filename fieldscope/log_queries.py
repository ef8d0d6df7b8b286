"""Queries over the driver's tables for states, quality and mechanisms, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldscope import registry
from fieldscope.operators import cycles, fleet, quality, stats, tools
from fieldscope.operators.asof import AUTO, TASKS
from fieldscope.tool_queries import DAY, HYSTERESIS, SIDES, E, events, lerp_sql, rounded, samples, table, when

QUERIES, ORACLE_SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def quality_sql(rows: str, name: str, keys: str = "log_id"):
    """n, span, gaps, max_gap, bad, score and confidence of the series in `rows`."""
    return f"""{name}_s AS (SELECT *, ts - lag(ts) OVER (PARTITION BY {keys} ORDER BY ts, seq) AS dt FROM {rows}), {name}_m AS (SELECT {keys}, median(dt) AS md FROM {name}_s GROUP BY ALL),
{name}_d AS (SELECT {keys}, count(*) AS n, max(ts) - min(ts) AS span, count(*) FILTER (dt > 5 * md) AS gaps, coalesce(max(dt) FILTER (dt > 5 * md), 0) AS max_gap, coalesce(sum(dt) FILTER (dt > 5 * md), 0) AS gap_time, CASE WHEN count(*) > 2 THEN sqrt(sum((dt - md) ** 2) / (count(*) - 2)) ELSE 0 END AS jitter, any_value(md) AS md FROM {name}_s JOIN {name}_m USING ({keys}) GROUP BY {keys}),
{name}_q AS (SELECT *, CASE WHEN n = 1 THEN 0.4 ELSE greatest(0, least(1, 1 - 0.3 * least(gaps / 20, 1) - 0.3 * CASE WHEN n < 100 THEN 1 WHEN n < 500 THEN 0.5 ELSE 0 END - 0.2 * CASE WHEN md > 0 THEN least(jitter / md, 1) ELSE 0 END)) END AS score FROM {name}_d),
{name} AS (SELECT *, CASE WHEN score > 0.8 AND gap_time <= 0.1 * span THEN 'high' WHEN score > 0.5 THEN 'medium' WHEN score > 0.2 THEN 'low' ELSE 'insufficient' END AS confidence FROM {name}_q)"""


CYCLE_SPAN = (1704326400.0, 1705968000.0)


@query(f"""WITH {E}, r AS (SELECT *, lag(kind) OVER w AS was FROM e WHERE ts BETWEEN {CYCLE_SPAN[0]} AND {CYCLE_SPAN[1]} WINDOW w AS (PARTITION BY log_id ORDER BY ts, seq)),
g AS (SELECT *, lag(kind) OVER w AS edge FROM r WHERE kind IN ('view', 'purchase') WINDOW w AS (PARTITION BY log_id ORDER BY ts, seq)), b AS (SELECT log_id, ts FROM g WHERE kind = 'view' AND coalesce(edge, 'purchase') = 'purchase'),
f AS (SELECT log_id AS f_log, ts AS f_ts FROM r WHERE kind = 'purchase'), c AS (SELECT b.*, f_ts FROM b ASOF LEFT JOIN f ON log_id = f_log AND ts <= f_ts),
x AS (SELECT log_id, count(f_ts) AS cycles, count(*) FILTER (f_ts IS NULL) AS incomplete, avg(f_ts - ts) AS av, min(f_ts - ts) AS mi, max(f_ts - ts) AS ma FROM c GROUP BY 1),
i AS (SELECT log_id, ts FROM r WHERE kind = 'error' AND was IS DISTINCT FROM 'error'), n AS (SELECT log_id AS n_log, ts AS n_ts FROM r WHERE kind <> 'error'), s AS (SELECT i.*, n_ts FROM i ASOF LEFT JOIN n ON log_id = n_log AND ts < n_ts),
l AS (SELECT log_id, count(*) AS samples, max(ts) AS last FROM e GROUP BY 1), y AS (SELECT s.log_id, coalesce(sum(n_ts - ts), 0) AS idle, count(*) AS spells, avg(coalesce(n_ts, last) - ts) AS av_idle FROM s JOIN l USING (log_id) GROUP BY 1),
t AS (SELECT log_id, ts, lag(ts) OVER (PARTITION BY log_id ORDER BY ts, seq) AS p FROM r WHERE was IS NOT NULL AND was <> kind), u AS (SELECT log_id, count(*) AS rapid FROM t WHERE ts - p < 0.1 GROUP BY 1),
k AS (SELECT log_id, array_to_string(list_sort(list(DISTINCT kind)), ', ') AS unknown FROM r WHERE kind NOT IN ('view', 'purchase', 'error') GROUP BY 1), {quality_sql('e', 'q')}
SELECT l.log_id, samples, coalesce(cycles, 0) AS cycles, coalesce(incomplete, 0) AS incomplete, round(av, 3) AS avg_seconds, round(mi, 3) AS min_seconds, round(ma, 3) AS max_seconds, round(coalesce(idle, 0), 3) AS idle_seconds, coalesce(spells, 0) AS idle_spells, round(av_idle, 3) AS avg_idle_seconds, coalesce(rapid, 0) AS rapid, coalesce(unknown, '') AS unknown, CASE WHEN unknown IS NULL THEN 0 ELSE 1 END + CASE WHEN incomplete > 0 THEN 1 ELSE 0 END + CASE WHEN coalesce(rapid, 0) > 5 THEN 1 ELSE 0 END + CASE WHEN score < 0.5 THEN 1 ELSE 0 END AS n_warnings, round(score, 6) AS score, confidence
FROM l LEFT JOIN x USING (log_id) LEFT JOIN y USING (log_id) LEFT JOIN u USING (log_id) LEFT JOIN k USING (log_id) JOIN q USING (log_id)""")
def analyze_cycles(spark, sf_dir):
    """Types of events are states: cycles from view to purchase between two dates, errors are idle."""
    states = events(spark, sf_dir).select("log_id", "ts", "seq", F.col("kind").alias("value"))
    out = cycles.analyze(states, ["log_id"], "view", "purchase", "error", *CYCLE_SPAN)
    times = {c: F.round(c, 3) for c in ("avg_seconds", "min_seconds", "max_seconds", "idle_seconds", "avg_idle_seconds")}
    return out.withColumns(times).select(
        "log_id", "samples", "cycles", "incomplete", *times, "idle_spells", "rapid", F.array_join("unknown_states", ", ").alias("unknown"), F.size("warnings").cast("long").alias("n_warnings"),
        F.round("data_quality.score", 6).alias("score"), F.col("directives.confidence_level").alias("confidence"),
    )


@query(f"""WITH {E}, {SIDES}, {lerp_sql('c', 'v')}, r AS (SELECT log_id, sqrt(avg((value - other) ** 2)) AS rmse, count(*) AS n FROM j WHERE other IS NOT NULL GROUP BY 1), b AS (SELECT log_id, kind AS entry, seq, ts FROM e WHERE kind IN ('click', 'view')), {quality_sql('b', 'q', 'log_id, entry')},
w AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY score, n) AS place FROM q)
SELECT r.log_id, r.n, round(rmse, 6) AS rmse, w.n AS samples, w.gaps, round(w.score, 6) AS score, w.confidence, 1 + CASE WHEN w.n < 100 THEN 1 ELSE 0 END + CASE WHEN w.gaps > 0 AND w.gaps / w.n > 0.02 THEN 1 ELSE 0 END + CASE WHEN w.span < 10 THEN 1 ELSE 0 END + 1 AS n_guidance, CASE WHEN w.score < 0.5 THEN 1 ELSE 0 END AS n_warnings
FROM r JOIN w USING (log_id) WHERE place = 1""")
def compare_entries_quality(spark, sf_dir):
    """RMSE of two channels with the worse quality of the two."""
    e = events(spark, sf_dir).where("kind in ('click', 'view')")
    side = lambda k: e.where(F.col("kind") == k).select("log_id", "ts", "seq", "value")
    measured = quality.worst(quality.measure(e.select("log_id", F.col("kind").alias("entry"), "ts", "seq", "value"), ["log_id", "entry"]), ["log_id"])
    out = quality.attach(stats.compare(side("click"), side("view"), ["log_id"]), measured, ["log_id"], "compare_entries")
    q = F.col("data_quality")
    return rounded(out.select("log_id", "n", "rmse", q["n"].alias("samples"), q["gaps"].alias("gaps"), q["score"].alias("score"), q["confidence"].alias("confidence"), F.size("directives.guidance").alias("n_guidance"), F.size("warnings").alias("n_warnings")))


@query(f"""WITH RECURSIVE {E}, {SIDES}, {lerp_sql('c', 'v')}, n AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY ts, seq) AS i FROM j WHERE other IS NOT NULL),
s AS (SELECT log_id, i, ts, value, other, value AS held, CAST(1 AS BIGINT) AS segment FROM n WHERE i = 1 UNION ALL SELECT n.log_id, n.i, n.ts, n.value, n.other, CASE WHEN abs(n.value - s.held) > greatest(abs(s.held) * 0.05, 0.01) THEN n.value ELSE s.held END,
    s.segment + CASE WHEN abs(n.value - s.held) > greatest(abs(s.held) * 0.05, 0.01) THEN 1 ELSE 0 END FROM s JOIN n ON n.log_id = s.log_id AND n.i = s.i + 1),
b AS (SELECT *, first_value(ts) OVER w AS b, max(segment) OVER (PARTITION BY log_id) AS last FROM s WINDOW w AS (PARTITION BY log_id, segment ORDER BY i)),
g AS (SELECT log_id, segment, any_value(held) AS target, any_value(last) AS last, min(ts - b) FILTER (abs(other - value) <= greatest(abs(value) * 0.05, 0.01) AND ts - b > 0.01) AS settling, arg_max(other - held, abs(other - held)) AS error FROM b GROUP BY 1, 2)
SELECT log_id, count(*) AS segments, count(settling) AS settled, round(avg(settling), 3) AS avg_settling, round(max(settling), 3) AS max_settling, round(min(settling), 3) AS min_settling, round(avg(CASE WHEN segment < last AND abs(target) > 0.001 THEN error * 100 / abs(target) END), 3) AS overshoot_percent FROM g GROUP BY 1""")
def mechanism_response(spark, sf_dir):
    """Clicks are setpoints, views the measured values."""
    e = events(spark, sf_dir)
    side = lambda k: e.where(F.col("kind") == k).select("log_id", "ts", "seq", "value")
    return rounded(tools.mechanism_response(side("click"), side("view"), ["log_id"]), 3)


@query(f"""WITH {E}, x AS (SELECT log_id, kind, coalesce(v.value > 50, false) AS en FROM (SELECT * FROM e WHERE kind IN ('error', 'click') AND value > 20) l ASOF LEFT JOIN (SELECT log_id AS lid, ts AS vts, value FROM e WHERE kind = 'view') v ON l.log_id = v.lid AND l.ts >= v.vts),
k AS (SELECT DISTINCT log_id AS kid FROM e WHERE kind = 'view') SELECT log_id, kind AS entry, count(*) AS total, CASE WHEN any_value(kid) IS NOT NULL THEN count(*) FILTER (en) END AS while_enabled, CASE WHEN any_value(kid) IS NOT NULL THEN count(*) FILTER (NOT en) END AS while_disabled FROM x LEFT JOIN k ON kid = log_id GROUP BY 1, 2""")
def can_errors_by_entry(spark, sf_dir):
    """Errors and clicks above 20 are messages of a fault, views the enabled state."""
    text = F.when(F.col("kind").isin("error", "click"), F.when(F.col("value") > 20, F.lit("CAN fault")).otherwise(F.lit("fine")))
    kind = F.when(F.col("kind") == "view", "boolean").otherwise("string")
    return tools.can_errors_by_entry(samples(events(spark, sf_dir), {"view": "/DriverStation/Enabled", "error": "error", "click": "click"}, type=kind, v_bool=when(("view",), F.col("value") > 50), v_str=text))


PATH_SECONDS = 10 * DAY


@query(f"""WITH {E}, {SIDES}, en AS (SELECT log_id, ts, seq, value > 50 AS up FROM e WHERE kind = 'error'), au AS (SELECT l.log_id, l.ts, l.value > 50 AS auto, coalesce(r.up, false) AS enabled FROM (SELECT * FROM e WHERE kind = 'signup') l ASOF LEFT JOIN en r ON l.log_id = r.log_id AND l.ts >= r.ts),
f AS (SELECT log_id, min(ts) FILTER (auto AND enabled) AS direct, min(ts) FILTER (auto) AS flag_up FROM au GROUP BY 1), fe AS (SELECT f.*, (SELECT min(ts) FROM au WHERE au.log_id = f.log_id AND NOT auto AND ts > flag_up) AS flag_end, (SELECT min(ts) FROM au WHERE au.log_id = f.log_id AND NOT auto AND ts > direct) AS direct_end FROM f),
fl AS (SELECT fe.*, (SELECT min(ts) FROM en WHERE en.log_id = fe.log_id AND up AND ts >= flag_up AND (flag_end IS NULL OR ts < flag_end)) AS later FROM fe),
aw AS (SELECT log_id, coalesce(direct, later) AS b, coalesce(CASE WHEN direct IS NOT NULL THEN direct_end ELSE flag_end END, coalesce(direct, later) + {PATH_SECONDS}) AS x FROM fl),
d AS (SELECT c.log_id, c.ts, sqrt((c.value - v.value) ** 2 + (c.k - v.k) ** 2) AS d FROM c ASOF JOIN v ON c.log_id = v.log_id AND c.ts >= v.ts)
SELECT log_id, round(sqrt(avg(d * d)), 6) AS rmse, round(max(d), 6) AS max_error, count(*) AS n FROM d JOIN aw USING (log_id) WHERE ts BETWEEN b AND x GROUP BY 1""")
def follow_path(spark, sf_dir):
    """Clicks are poses of a path, views those of the robot, found by their names and types."""
    names = {"error": "/DriverStation/Enabled", "signup": "/DriverStation/Autonomous", "click": "/Auto/TargetPose", "view": "/Drive/OdometryPose"}
    pose = F.when(F.col("kind").isin("click", "view"), F.create_map(F.lit("x"), F.col("value"), F.lit("y"), F.col("k")))
    kind = F.when(F.col("kind").isin("click", "view"), "struct:Pose2d").otherwise("boolean")
    return rounded(tools.follow_path(samples(events(spark, sf_dir), names, type=kind, v_bool=when(("error", "signup"), F.col("value") > 50), v_struct=pose), seconds=PATH_SECONDS))


@query(f"""WITH {E}, c AS (SELECT * FROM e), {HYSTERESIS.format(n='b', low='5', high='25')}, l AS (SELECT log_id, event, min(value) FILTER (state = 1) AS lowest FROM b_e WHERE event > 0 GROUP BY 1, 2)
SELECT log_id, CAST(event AS BIGINT) AS event, round("begin", 6) AS "begin", round("end", 6) AS "end", closed, round(lowest, 6) AS lowest FROM b JOIN l USING (log_id, event)""")
def hysteresis_by_function(spark, sf_dir):
    """The table function, from SQL, over every series."""
    registry.register_functions(spark)
    series = events(spark, sf_dir).select("log_id", "ts", "seq", "value")
    return rounded(spark.sql("SELECT * FROM hysteresis_events(TABLE({series}) PARTITION BY log_id ORDER BY (ts, seq), 5.0, 25.0)", series=series))


@query(f"""WITH {E}, n AS (SELECT *, lag(value) OVER w AS p, lead(value) OVER w AS x FROM e WINDOW w AS (PARTITION BY log_id, kind ORDER BY ts, seq)) SELECT log_id, kind, seq, round(greatest(abs(value - p), abs(value - x)), 6) AS height FROM n WHERE value > p AND value > x AND greatest(abs(value - p), abs(value - x)) >= 40""")
def peaks_by_name(spark, sf_dir):
    """An operator called by its name, with checked arguments."""
    channels = events(spark, sf_dir).withColumnRenamed("kind", "channel")
    found = registry.call("find_peaks", channels, keys=["log_id", "channel"], kind="maximum", min_height=40.0)
    return rounded(found.select("log_id", F.col("channel").alias("kind"), "seq", "height"))


LONG = f"""WITH l AS (SELECT l_returnflag AS log_id, l_orderkey AS ts, 0 AS seq, avg(l_quantity) AS value FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2), r AS (SELECT l_returnflag AS log_id, l_orderkey AS ts, 0 AS seq, avg(l_discount * 500) AS value FROM lineitem WHERE l_linenumber > 3 GROUP BY 1, 2), {lerp_sql('l', 'r')}
SELECT log_id, count(*) AS n, round(sqrt(avg((value - other) ** 2)), 6) AS rmse, round(max(abs(value - other)), 6) AS max_diff FROM j WHERE other IS NOT NULL GROUP BY 1"""


def _long(spark, sf_dir):
    """Three series, a third of all orders each: quantities of the first lines against discounts of the later ones."""
    t = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "log_id")
    # Orders have few lines each: dealt before they are averaged, among as many tasks as spans.
    dealt = lambda rows, value: rows.select("log_id", F.col("l_orderkey").cast("double").alias("ts"), value.alias("value")).repartition(TASKS, "log_id", "ts")
    side = lambda rows, value: dealt(rows, value).groupBy("log_id", "ts").agg(F.avg("value").alias("value")).withColumn("seq", F.lit(0).cast("long"))
    return side(t.where("l_linenumber <= 3"), F.col("l_quantity")), side(t.where("l_linenumber > 3"), F.col("l_discount") * 500)


@query(LONG)
def compare_long_series(spark, sf_dir):
    """Each series cut into spans of about as many rows."""
    return rounded(stats.compare(*_long(spark, sf_dir), ["log_id"], every=AUTO))


@query(LONG)
def compare_long_series_in_spans(spark, sf_dir):
    """The same, with each series cut into spans of time."""
    return rounded(stats.compare(*_long(spark, sf_dir), ["log_id"], every=1000.0))


_Q = lambda q: f"round(quantile_cont(l_extendedprice, {q}), 6)"


@query(f"SELECT l_returnflag, l_linestatus, count(*) AS count, round(min(l_extendedprice), 6) AS min, round(max(l_extendedprice), 6) AS max, {_Q(0.5)} AS median, {_Q(0.25)} AS q1, {_Q(0.75)} AS q3, {_Q(0.05)} AS p5, {_Q(0.95)} AS p95 FROM lineitem GROUP BY 1, 2")
def statistics_of_large_groups(spark, sf_dir):
    """Few groups with a large share of all rows each: no task gets the values of one."""
    t = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_extendedprice").alias("value"))
    return rounded(stats.describe(t, ["l_returnflag", "l_linestatus"], split=True).drop("mean", "std_dev", "iqr"))


@query("""WITH q AS (SELECT l_returnflag, quantile_cont(l_quantity * l_discount, 0.25) AS q1, quantile_cont(l_quantity * l_discount, 0.75) AS q3 FROM lineitem GROUP BY 1)
SELECT l_returnflag, l_orderkey, l_partkey, round(l_quantity * l_discount, 6) AS value FROM lineitem JOIN q USING (l_returnflag) WHERE l_quantity * l_discount < q1 - 1.2 * (q3 - q1) OR l_quantity * l_discount > q3 + 1.2 * (q3 - q1)""")
def anomalies_of_large_groups(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_partkey", (F.col("l_quantity") * F.col("l_discount")).alias("value"))
    return rounded(stats.detect_anomalies(t, ["l_returnflag"], 1.2, split=True).select("l_returnflag", "l_orderkey", "l_partkey", "value"))


@query("""WITH l AS (SELECT o_orderkey AS log_id, o_orderpriority AS pr, o_custkey % 50 AS n, o_custkey % 7 AS team, epoch(o_orderdate) AS ts, CASE WHEN o_orderstatus = 'F' THEN 'Qualification' WHEN o_orderstatus = 'O' THEN 'Semifinal' ELSE 'Practice' END AS kind, substr(o_orderpriority, 1, 1) AS e FROM orders),
m AS (SELECT e, CASE WHEN kind = 'Qualification' THEN 'qm' || n ELSE 'sf' || log_id || 'm1' END AS key, team, team + 1 AS other, ts, log_id % 100 AS rs, log_id % 90 AS bs, log_id FROM l WHERE log_id % 5 = 0),
d AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY e, key ORDER BY log_id) = 1),
p AS (SELECT e, key, team, 'red' AS alliance, rs AS score, bs AS opp, ts FROM d UNION ALL SELECT e, key, other, 'blue', bs, rs, ts FROM d),
q AS (SELECT l.log_id, 'qm' || n AS key, l.e, l.team FROM l WHERE kind = 'Qualification'),
s AS (SELECT l.log_id, l.e, l.team, l.ts FROM l WHERE kind = 'Semifinal'), c AS (SELECT s.log_id, s.e, s.team, p.key, abs(s.ts - p.ts) AS d, p.ts > s.ts AS later FROM s JOIN p ON s.e = p.e AND s.team = p.team AND NOT starts_with(p.key, 'qm') AND abs(s.ts - p.ts) <= 172800),
b AS (SELECT log_id, e, team, key FROM c QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY d, later, CASE WHEN later THEN key END, key DESC) = 1),
f AS (SELECT * FROM (SELECT log_id, key, e, team FROM q UNION ALL SELECT s.log_id, b.key, s.e, s.team FROM s LEFT JOIN b USING (log_id)))
SELECT f.log_id, f.key AS match_key, alliance, score, opp AS opponent_score, score > opp AS won FROM f LEFT JOIN p ON f.e = p.e AND f.team = p.team AND f.key = p.key""")
def match_enrichment(spark, sf_dir):
    """Orders are logs: filled ones qualifications, open ones playoffs; every fifth is also a match."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "Qualification").when(F.col("o_orderstatus") == "O", "Semifinal").otherwise("Practice")
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)").cast("double")
    event, n, team = F.concat(F.lit("2024e"), F.substring("o_orderpriority", 1, 1)), (F.col("o_custkey") % 50).cast("int"), (F.col("o_custkey") % 7).cast("int")
    logs = o.select(F.col("o_orderkey").alias("log_id"), event.alias("event"), kind.alias("match_type"), n.alias("match_number"), team.alias("team"), seconds.alias("created"), F.lit(None).cast("double").alias("modified"))
    key = F.when(kind == "Qualification", F.concat(F.lit("qm"), n.cast("string"))).otherwise(F.concat(F.lit("sf"), F.col("o_orderkey").cast("string"), F.lit("m1")))
    m = o.where("o_orderkey % 5 = 0").select(F.lit(2024).alias("year"), F.lower(F.substring(event, 5, 9)).alias("event"), key.alias("match_key"), F.array(team).alias("red"), F.array(team + 1).alias("blue"), (F.col("o_orderkey") % 100).alias("red_score"), (F.col("o_orderkey") % 90).alias("blue_score"), seconds.alias("scheduled"), seconds.alias("actual"), F.lit(None).cast("string").alias("zone"), "o_orderkey")
    one = m.withColumn("n", F.row_number().over(Window.partitionBy("event", "match_key").orderBy("o_orderkey"))).where("n = 1")
    return fleet.enriched(logs, one, 2 * DAY).select("log_id", "match_key", "alliance", "score", "opponent_score", "won")
