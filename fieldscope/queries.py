"""The engine's queries over the driver's tables, with equivalent SQL. A log is a user, an entry an event type, a sample a value."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldscope.functions.values import json_number
from fieldscope.operators import asof, catalog, series, stats, tools

K = ["user_id"]


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark, sf_dir, kind=None):
    """user_id, event_type, seq, ts (seconds), value."""
    e = table(spark, sf_dir, "events")
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    e = e if kind is None else e.where(F.col("event_type") == kind)
    return e.select("user_id", "event_type", F.col("event_id").alias("seq"), (us / 1e6).alias("ts"), "value")


def rounded(df, digits=6):
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


E = "e AS (SELECT user_id, event_type, event_id AS seq, epoch_us(ts) / 1e6 AS ts, value FROM events)"
QUERIES, ORACLE_SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


STATS = "count(*) AS count, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(coalesce(stddev_samp(value), 0.0), 6) AS std_dev, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.95), 6) AS p95"


@query(f"SELECT event_type, {STATS} FROM events GROUP BY event_type")
def get_statistics(spark, sf_dir):
    return rounded(stats.describe(events(spark, sf_dir), ["event_type"]))


@query(f"WITH {E} SELECT event_type, {STATS} FROM e WHERE ts BETWEEN (SELECT min(ts) + 86400 FROM e) AND (SELECT min(ts) + 864000 FROM e) GROUP BY event_type")
def statistics_time_range(spark, sf_dir):
    e = events(spark, sf_dir)
    first = e.agg(F.min("ts").alias("t0"))  # one row, so that the time stays in the plan
    near = e.join(F.broadcast(first), F.expr("ts between t0 + 86400 and t0 + 864000"))
    return rounded(stats.describe(near, ["event_type"]))


@query(f"""WITH {E}, q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(*) AS n FROM e GROUP BY event_type)
SELECT seq, e.event_type, round(value, 6) AS value, round(q1 - 1.5 * (q3 - q1), 6) AS low, round(q3 + 1.5 * (q3 - q1), 6) AS high FROM e JOIN q USING (event_type) WHERE n >= 4 AND (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))""")
def detect_anomalies(spark, sf_dir):
    return rounded(stats.detect_anomalies(events(spark, sf_dir), ["event_type"]).select("seq", "event_type", "value", "low", "high"))


def _edges(p):
    return f"WITH {E}, p AS (SELECT *, {p} AS p, lag({p}) OVER (PARTITION BY user_id ORDER BY ts, seq) AS was FROM e) SELECT user_id, seq, round(value, 6) AS value FROM p WHERE p AND NOT coalesce(was, false)"


@query(_edges("value > 100"))
def find_condition_gt(spark, sf_dir):
    return rounded(series.find_condition(events(spark, sf_dir), K, "gt", 100).select("user_id", "seq", "value"))


@query(_edges("value < 5"))
def find_condition_lt(spark, sf_dir):
    return rounded(series.find_condition(events(spark, sf_dir), K, "<", 5).select("user_id", "seq", "value"))


@query(_edges("abs(value - 4.29) <= greatest(1e-9, 4.29 * 1e-6)"))
def find_condition_eq(spark, sf_dir):
    return rounded(series.find_condition(events(spark, sf_dir), K, "eq", 4.29).select("user_id", "seq", "value"))


@query(f"""WITH {E}, n AS (SELECT *, lag(value) OVER w AS p, lead(value) OVER w AS x FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, seq))
SELECT user_id, seq, CASE WHEN value > p THEN 'maximum' ELSE 'minimum' END AS kind, round(greatest(abs(value - p), abs(value - x)), 6) AS height FROM n WHERE (value > p AND value > x) OR (value < p AND value < x)""")
def find_peaks(spark, sf_dir):
    return rounded(series.find_peaks(events(spark, sf_dir), K).select("user_id", "seq", "kind", "height"))


@query(f"""WITH {E}, n AS (SELECT *, coalesce(lead(value) OVER w, value) - coalesce(lag(value) OVER w, value) AS dv, coalesce(lead(ts) OVER w, ts) - coalesce(lag(ts) OVER w, ts) AS dt FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, seq))
SELECT user_id, seq, round(dv / dt, 6) + 0.0 AS rate FROM n WHERE dt > 0""")
def rate_of_change(spark, sf_dir):
    return rounded(series.rate_of_change(events(spark, sf_dir), K).select("user_id", "seq", "rate"))


@query(f"WITH {E}, n AS (SELECT *, value - lag(value, 5) OVER w AS dv, ts - lag(ts, 5) OVER w AS dt FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, seq)) SELECT user_id, seq, round(dv / dt, 6) + 0.0 AS rate FROM n WHERE dt > 0")
def rate_windowed(spark, sf_dir):
    return rounded(series.rate_of_change(events(spark, sf_dir), K, 5).select("user_id", "seq", "rate"))


@query(f"WITH {E} SELECT user_id, seq, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM e")
def moving_average(spark, sf_dir):
    return rounded(series.moving_average(events(spark, sf_dir), K, 2).select("user_id", "seq", "smooth"))


@query(f"""WITH {E}, n AS (SELECT *, coalesce(lead(value) OVER w, value) - coalesce(lag(value) OVER w, value) AS dv, coalesce(lead(ts) OVER w, ts) - coalesce(lag(ts) OVER w, ts) AS dt FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, seq))
SELECT user_id, seq, round(CASE WHEN dt > 1e-9 THEN dv / dt END, 6) + 0.0 AS gradient FROM n""")
def gradient(spark, sf_dir):
    return rounded(series.gradient(events(spark, sf_dir), K).select("user_id", "seq", "gradient"))


@query(f"""WITH {E}, s AS (SELECT *, ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts, seq) AS dt FROM e),
m AS (SELECT event_type, median(dt) AS median, count(*) AS n FROM s GROUP BY 1),
d AS (SELECT event_type, median, n, count(*) FILTER (dt > 5 * median) AS gaps, coalesce(sum(dt) FILTER (dt > 5 * median), 0) AS gap_time, max(s.ts) - min(s.ts) AS span,
  CASE WHEN n > 2 THEN sqrt(sum((dt - median) ** 2) / (n - 2)) ELSE 0 END AS jitter FROM s JOIN m USING (event_type) GROUP BY 1, 2, 3),
r AS (SELECT *, greatest(0, least(1, 1 - 0.3 * least(gaps / 20, 1) - 0.3 * CASE WHEN n < 100 THEN 1 WHEN n < 500 THEN 0.5 ELSE 0 END - 0.2 * CASE WHEN median > 0 THEN least(jitter / median, 1) ELSE 0 END)) AS score FROM d)
SELECT event_type, n, gaps, round(jitter, 3) AS jitter, round(score, 6) AS score, CASE WHEN score > 0.8 AND gap_time <= 0.1 * span THEN 'high' WHEN score > 0.5 THEN 'medium' WHEN score > 0.2 THEN 'low' ELSE 'insufficient' END AS confidence FROM r""")
def data_quality(spark, sf_dir):
    q = stats.data_quality(events(spark, sf_dir), ["event_type"])
    return q.select("event_type", "n", "gaps", F.round("jitter", 3).alias("jitter"), F.round("score", 6).alias("score"), "confidence")


CLICK_VIEW = f"WITH {E}, l AS (SELECT * FROM e WHERE event_type = 'click'), r AS (SELECT * FROM e WHERE event_type = 'view')"


def _click_view(spark, sf_dir):
    return events(spark, sf_dir, "click").select("user_id", "seq", "ts", "value"), events(spark, sf_dir, "view")


@query(CLICK_VIEW + " SELECT l.user_id, l.seq, round(r.value, 6) AS other_value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts")
def asof_hold(spark, sf_dir):
    return rounded(asof.hold(*_click_view(spark, sf_dir), K).select("user_id", "seq", "other_value"))


LERP = CLICK_VIEW + """, n AS (SELECT *, lead(ts) OVER w AS ts2, lead(value) OVER w AS v2 FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts, seq)),
j AS (SELECT l.user_id, l.seq, l.value, CASE WHEN n.ts = l.ts THEN n.value WHEN n.ts2 IS NOT NULL THEN n.value + (n.v2 - n.value) * (l.ts - n.ts) / (n.ts2 - n.ts) END AS other FROM l ASOF LEFT JOIN n ON l.user_id = n.user_id AND l.ts >= n.ts)"""


@query(LERP + " SELECT user_id, seq, round(other, 6) AS other_value FROM j")
def asof_lerp(spark, sf_dir):
    return rounded(asof.lerp(*_click_view(spark, sf_dir), K).select("user_id", "seq", "other_value"))


@query(LERP + " SELECT user_id, count(*) AS n, round(sqrt(avg((value - other) ** 2)), 6) AS rmse, round(max(abs(value - other)), 6) AS max_diff FROM j WHERE other IS NOT NULL GROUP BY user_id")
def compare_entries(spark, sf_dir):
    return rounded(stats.compare(*_click_view(spark, sf_dir), K))


@query(LERP + """, c AS (SELECT user_id, count(*) AS n, var_pop(value) AS vx, var_pop(other) AS vy, covar_pop(value, other) AS cxy FROM j WHERE other IS NOT NULL GROUP BY user_id HAVING count(*) >= 2)
SELECT user_id, n, round(CASE WHEN vx * n >= 1e-15 * n AND vy * n >= 1e-15 * n THEN greatest(-1, least(1, cxy / sqrt(vx * vy))) END, 6) AS r FROM c""")
def time_correlate(spark, sf_dir):
    return rounded(stats.time_correlate(*_click_view(spark, sf_dir), K).select("user_id", "n", "r"))


@query(CLICK_VIEW + """, j AS (SELECT l.user_id, l.seq, l.ts, r.ts AS t2, r.value AS v2, row_number() OVER (PARTITION BY l.seq ORDER BY r.ts, r.seq) AS rn FROM l JOIN r ON l.user_id = r.user_id AND r.ts >= l.ts - 86400)
SELECT user_id, seq, round(v2, 6) AS other_value FROM j WHERE rn = 1 AND abs(t2 - ts) <= 86400""")
def tolerance_match(spark, sf_dir):
    return rounded(asof.forward(*_click_view(spark, sf_dir), K, 86400.0).where("other_value is not null").select("user_id", "seq", "other_value"))


@query(f"""WITH {E}, s AS (SELECT *, coalesce(last_value(CASE WHEN value < 5 THEN 1 WHEN value >= 25 THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 0) AS st FROM e),
b AS (SELECT *, CASE WHEN st = 1 AND coalesce(lag(st) OVER w, 0) = 0 THEN 1 ELSE 0 END AS begun FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, seq)),
v AS (SELECT *, sum(begun) OVER (PARTITION BY user_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS event FROM b)
SELECT user_id, CAST(event AS BIGINT) AS event, round(min(ts), 6) AS begin, round(coalesce(min(ts) FILTER (st = 0), max(ts)), 6) AS end, min(st) = 0 AS closed, round(min(value) FILTER (st = 1), 6) AS lowest FROM v WHERE event > 0 GROUP BY 1, 2""".replace("AS begin", 'AS "begin"').replace("AS end", 'AS "end"').replace('THEN 1 ELSE 0 END AS "begin"', "THEN 1 ELSE 0 END AS begin"))
def hysteresis_events(spark, sf_dir):
    return rounded(series.hysteresis(events(spark, sf_dir), K, 5.0, 25.0))


@query(f"""WITH {E}, p AS (SELECT *, value > 100 AS p, coalesce(lag(value > 100) OVER w, false) AS was FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, seq)),
g AS (SELECT *, sum(CASE WHEN p AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM p)
SELECT user_id, round(min(ts), 6) AS "begin", round(min(ts) FILTER (NOT p), 6) AS "end", round(max(value) FILTER (p), 6) AS peak FROM g WHERE run > 0 GROUP BY user_id, run HAVING count(*) FILTER (NOT p) > 0""")
def stall_islands(spark, sf_dir):
    return rounded(series.islands(events(spark, sf_dir), K, F.col("value") > 100))


@query(f"""WITH {E}, d AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, seq) AS was FROM e), f AS (SELECT * FROM d WHERE was - value > 50)
SELECT f.user_id, f.seq, round(min(e.ts) - f.ts, 3) AS seconds FROM f JOIN e ON e.user_id = f.user_id AND e.ts > f.ts AND e.ts <= f.ts + 86400 AND e.value >= f.value + 0.9 * (f.was - f.value) GROUP BY f.user_id, f.seq, f.ts""")
def recovery_time(spark, sf_dir):
    return series.recovery(events(spark, sf_dir), K, 50.0, 0.9, 86400.0).select("user_id", "seq", F.round("seconds", 3).alias("seconds"))


def _quick(column, within):
    return f"""WITH {E}, c AS (SELECT *, {column} AS st, lag({column}) OVER (PARTITION BY user_id ORDER BY ts, seq) AS was FROM e), t AS (SELECT * FROM c WHERE was IS NOT NULL AND was <> st),
g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, seq) AS gap FROM t) SELECT user_id, seq, round(gap, 3) AS gap FROM g WHERE gap < {within}"""


@query(_quick("(value > 50)", 21600))
def flicker(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("on", F.col("value") > 50)
    return series.quick_changes(e, K, 21600.0, "on").select("user_id", "seq", F.round("gap", 3).alias("gap"))


@query(_quick("event_type", 3600))
def rapid_transitions(spark, sf_dir):
    return series.quick_changes(events(spark, sf_dir), K, 3600.0, "event_type").select("user_id", "seq", F.round("gap", 3).alias("gap"))


@query(f"""WITH {E} SELECT user_id, round(ts, 6) AS "begin", round(lead(ts) OVER w - ts, 3) AS seconds FROM e WHERE event_type = 'view' WINDOW w AS (PARTITION BY user_id ORDER BY ts, seq)""")
def cycles_start_to_start(spark, sf_dir):
    return series.cycles(events(spark, sf_dir), K, "view", column="event_type").select("user_id", F.round("begin", 6).alias("begin"), F.round("seconds", 3).alias("seconds"))


@query(f"""WITH {E}, s AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, seq) AS was FROM e WHERE event_type IN ('view', 'purchase')),
t AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, seq) AS until FROM s WHERE was IS NULL OR was <> event_type)
SELECT user_id, round(ts, 6) AS "begin", round(until - ts, 3) AS seconds FROM t WHERE event_type = 'view'""")
def cycles_start_to_end(spark, sf_dir):
    return series.cycles(events(spark, sf_dir), K, "view", "purchase", "event_type").select("user_id", F.round("begin", 6).alias("begin"), F.round("seconds", 3).alias("seconds"))


@query(f"""WITH {E}, s AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, seq) AS was FROM e), t AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, seq) AS until FROM s WHERE was IS NULL OR was <> event_type)
SELECT user_id, round(sum(until - ts), 3) AS seconds, count(*) AS n FROM t WHERE event_type = 'error' GROUP BY user_id""")
def dead_time(spark, sf_dir):
    return series.dead_time(events(spark, sf_dir), K, "error", "event_type").select("user_id", F.round("seconds", 3).alias("seconds"), "n")


def _timeline(spark, sf_dir):
    e = events(spark, sf_dir)
    high = series.find_condition(e, K, "gt", 100).select("user_id", "seq", F.lit("high").alias("category"))
    low = series.find_condition(e, K, "lt", 5).select("user_id", "seq", F.lit("low").alias("category"))
    return high.unionByName(low).unionByName(series.changes(e, K, "event_type").select("user_id", "seq", F.lit("state").alias("category")))


_P = f"WITH {E}, p AS (SELECT *, lag(value) OVER w AS pv, lag(event_type) OVER w AS pt FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, seq)), t AS (SELECT user_id, seq, 'high' AS category FROM p WHERE value > 100 AND NOT coalesce(pv > 100, false) UNION ALL SELECT user_id, seq, 'low' FROM p WHERE value < 5 AND NOT coalesce(pv < 5, false) UNION ALL SELECT user_id, seq, 'state' FROM p WHERE pt IS DISTINCT FROM event_type)"


@query(_P + " SELECT * FROM t")
def timeline_union(spark, sf_dir):
    return _timeline(spark, sf_dir)


@query(_P + " SELECT category, count(*) AS n FROM t GROUP BY category")
def category_counts(spark, sf_dir):
    return _timeline(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"))


@query(f"WITH {E} SELECT user_id, event_type, round(min(ts), 6) AS first, round(max(ts), 6) AS last, count(*) AS n FROM e GROUP BY ALL")
def match_phases(spark, sf_dir):
    """The span of each state of a log."""
    spans = catalog.entries(events(spark, sf_dir).select(F.col("user_id").alias("log_id"), F.col("event_type").alias("entry"), F.lit("double").alias("type"), "ts"))
    return rounded(spans.select(F.col("log_id").alias("user_id"), F.col("entry").alias("event_type"), F.col("min_ts").alias("first"), F.col("max_ts").alias("last"), F.col("sample_count").alias("n")))


@query("SELECT user_id, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean FROM events WHERE event_type = 'click' GROUP BY user_id")
def compare_logs(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("user_id").alias("log_id"), F.col("event_type").alias("entry"), "ts", "seq", F.col("value").alias("v_num"), F.lit(None).cast("long").alias("v_long"))
    return rounded(tools.compare_matches(e, "click").withColumnRenamed("log_id", "user_id"))


@query("""WITH s AS (SELECT l_returnflag, count(*) AS n, sum(l_quantity * l_quantity) AS aa, sum(l_quantity * l_discount) AS ab, sum(l_discount * l_discount) AS bb, sum(l_extendedprice * l_quantity) AS ya, sum(l_extendedprice * l_discount) AS yb, sum(l_extendedprice * l_extendedprice) AS yy FROM lineitem GROUP BY 1),
c AS (SELECT *, (ya * bb - yb * ab) / (aa * bb - ab * ab) AS ca, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS cb FROM s)
SELECT l_returnflag, n, round(ca, 4) AS ca, round(cb, 2) AS cb, round(1 - (yy - ca * ya - cb * yb) / yy, 6) AS r2, round(sqrt((yy - ca * ya - cb * yb) / n), 2) AS rmse FROM c""")
def ols_regression(spark, sf_dir):
    r = stats.regression(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity", "l_discount")
    return r.select("l_returnflag", "n", F.round("ca", 4).alias("ca"), F.round("cb", 2).alias("cb"), F.round("r2", 6).alias("r2"), F.round("rmse", 2).alias("rmse"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license')")
def search_strings(spark, sf_dir):
    return catalog.search_strings(table(spark, sf_dir, "documents"), "text", "License").select("doc_id")


@query("SELECT event_type AS type, count(DISTINCT user_id) AS n_entries FROM events GROUP BY 1")
def get_types(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.lit("x").alias("log_id"), F.col("user_id").cast("string").alias("entry"), F.col("event_type").alias("type"))
    return catalog.get_types(e).select("type", "n_entries")


@query(f"WITH {E} SELECT CAST(user_id AS VARCHAR) AS log_id, event_type AS entry, 'double' AS type, count(*) AS sample_count, round(min(ts), 6) AS min_ts, round(max(ts), 6) AS max_ts FROM e WHERE contains(event_type, 'i') GROUP BY 1, 2")
def list_entries(spark, sf_dir):
    return rounded(catalog.list_entries(_entries(spark, sf_dir), "I"))


def _entries(spark, sf_dir):
    return catalog.entries(events(spark, sf_dir).select(F.col("user_id").cast("string").alias("log_id"), F.col("event_type").alias("entry"), F.lit("double").alias("type"), "ts", "seq", "value"))


@query("SELECT CAST(user_id AS VARCHAR) AS log_id, event_type AS entry, count(*) AS sample_count FROM events WHERE contains(event_type, 'view') GROUP BY 1, 2 HAVING count(*) >= 12")
def search_entries(spark, sf_dir):
    return catalog.search_entries(_entries(spark, sf_dir), "double", "VIEW", 12).select("log_id", "entry", "sample_count")


@query(f"WITH {E}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, seq) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM e) SELECT user_id, seq, i, n, round(value, 6) AS value FROM r WHERE i IN (0, n // 2, n - 1)")
def entry_info_samples(spark, sf_dir):
    return rounded(catalog.entry_info(events(spark, sf_dir), K).select("user_id", "seq", "i", "n", "value"))


@query(f"WITH {E} SELECT seq, round(value, 6) AS value FROM e WHERE event_type = 'click' ORDER BY ts, seq LIMIT 100 OFFSET 50")
def read_entry_page(spark, sf_dir):
    return rounded(catalog.read_entry(events(spark, sf_dir, "click"), 50, 100).select("seq", "value"))


@query(f"""WITH m AS (SELECT event_type, median(value) AS m FROM events GROUP BY 1), s AS (SELECT event_type, value * CASE WHEN m >= 0.001 AND m < 1 THEN 1000 WHEN m > 500 THEN 0.001 ELSE 1 END AS ms FROM events JOIN m USING (event_type))
SELECT event_type, count(*) AS n, round(avg(ms), 6) AS avg_ms, round(max(ms), 6) AS max_ms, round(min(ms), 6) AS min_ms, round(quantile_cont(ms, 0.95), 6) AS p95_ms, round(quantile_cont(ms, 0.99), 6) AS p99_ms, count(*) FILTER (ms > 20) AS violations, CAST(floor(100 - 100 * count(*) FILTER (ms > 20) / count(*)) AS BIGINT) AS health FROM s GROUP BY 1""")
def loop_timing(spark, sf_dir):
    return rounded(stats.loop_timing(events(spark, sf_dir), ["event_type"]))


@query(f"WITH {E}, l AS (SELECT * FROM e WHERE event_type = 'error'), r AS (SELECT * FROM e WHERE event_type = 'view') SELECT l.user_id, coalesce(r.value, 0) > 50 AS enabled, count(*) AS n FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts GROUP BY 1, 2")
def can_health(spark, sf_dir):
    errors = events(spark, sf_dir, "error").select("user_id", "seq", "ts", "value")
    held = asof.hold(errors, events(spark, sf_dir, "view"), K).withColumn("enabled", F.coalesce("other_value", F.lit(0.0)) > 50)
    return held.groupBy("user_id", "enabled").agg(F.count("*").alias("n"))


@query("SELECT n_name, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def cross_log_join_lookup(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT event_type, round(atan2(sum(sin(value / 100)), sum(cos(value / 100))), 6) AS mean_angle FROM events GROUP BY 1")
def circular_mean(spark, sf_dir):
    return rounded(events(spark, sf_dir).withColumn("a", F.col("value") / 100).groupBy("event_type").agg(stats.circular_mean("a").alias("mean_angle")))


@query("""WITH p AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), d AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM p WINDOW w AS (PARTITION BY label ORDER BY vec_id)) SELECT vec_id, label, round(d, 6) AS distance FROM d WHERE d > 0.2""")
def pose_jump(spark, sf_dir):
    p = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return rounded(series.jumps(p, ["label"], "x", "y", 0.2, ["vec_id"]).select("vec_id", "label", "distance"))


@query("SELECT n_name AS name, levenshtein(lower(n_name), 'naton_1') AS distance FROM nation WHERE levenshtein(lower(n_name), 'naton_1') <= 3 ORDER BY 2, 1 LIMIT 3")
def did_you_mean(spark, sf_dir):
    return catalog.suggest_entries(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), "Naton_1", "name")


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def json_extract(spark, sf_dir):
    k = json_number("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"))


@query(f"WITH {E} SELECT user_id, round(arg_min(value, (ts, seq)), 6) AS value FROM e GROUP BY user_id")
def first_value(spark, sf_dir):
    return rounded(stats.first_of(events(spark, sf_dir), K))


@query("SELECT lang AS log_id, source AS type, count(DISTINCT doc_id) AS n, CAST(row_number() OVER (PARTITION BY lang ORDER BY count(DISTINCT doc_id) DESC, source) AS INTEGER) AS rank FROM documents GROUP BY 1, 2 QUALIFY rank <= 10")
def top_types(spark, sf_dir):
    return tools.sampled_types(table(spark, sf_dir, "documents").select(F.col("lang").alias("log_id"), F.col("source").alias("type"), F.col("doc_id").alias("entry")))


@query(f"WITH {E} SELECT event_type, count(*) AS samples, count(DISTINCT user_id) AS entries, round(min(value) FILTER (first), 6) AS battery_min, CASE WHEN min(value) FILTER (first) < 6.8 THEN 'HIGH' WHEN min(value) FILTER (first) < 9 THEN 'MODERATE' ELSE 'LOW' END AS brownout_risk FROM (SELECT *, CAST(user_id AS VARCHAR) = min(CAST(user_id AS VARCHAR)) OVER (PARTITION BY event_type) AS first FROM e) GROUP BY 1")
def power_report(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("event_type").alias("log_id"), F.concat(F.lit("batteryvoltage "), F.col("user_id")).alias("entry"), F.lit("double").alias("type"), "ts", "seq", F.col("value").alias("v_num"), F.lit(None).cast("long").alias("v_long"), F.lit(None).cast("string").alias("v_str"))
    return rounded(tools.report(e).select(F.col("log_id").alias("event_type"), "samples", "entries", "battery_min", "brownout_risk"))


@query(CLICK_VIEW.replace("WITH ", "WITH RECURSIVE ", 1) + """, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, seq) AS i FROM l),
s AS (SELECT user_id, seq, i, value AS held, CAST(1 AS BIGINT) AS segment FROM n WHERE i = 1
    UNION ALL SELECT n.user_id, n.seq, n.i, CASE WHEN abs(n.value - s.held) > greatest(abs(s.held) * 0.05, 0.01) THEN n.value ELSE s.held END, s.segment + CASE WHEN abs(n.value - s.held) > greatest(abs(s.held) * 0.05, 0.01) THEN 1 ELSE 0 END FROM s JOIN n ON n.user_id = s.user_id AND n.i = s.i + 1)
SELECT user_id, seq, segment FROM s""")
def setpoint_segments(spark, sf_dir):
    return series.segments_by_setpoint(events(spark, sf_dir, "click").select("user_id", "seq", "ts", "value"), K).select("user_id", "seq", "segment")
