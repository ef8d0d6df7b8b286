"""Queries over the driver's tables for the alignment of clocks, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldscope.operators import pairing
from fieldscope.plans import sync
from fieldscope.tool_queries import E, events, rounded, samples, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Days since the first of the year stand for seconds, 10 steps each.
DAYS, RATE, REACH = "(ts - 1704067200) / 86400", 10.0, 30
SHIFT, ROUGH = "(1 + log_id::BIGINT % 50 * 0.07)", "(1 + log_id::BIGINT % 50 * 0.07 + (log_id::BIGINT % 5 - 2) * 0.5)"


@query(f"""WITH {E}, c AS (SELECT log_id, seq, {DAYS} AS t, value, row_number() OVER (PARTITION BY log_id ORDER BY ts, seq) AS n FROM e WHERE kind = 'click'),
b AS (SELECT log_id, t - {SHIFT} AS t, value + seq % 7 AS value FROM c WHERE n > 2), w AS (SELECT log_id, floor(min(t) / 12) * 12 AS low, {ROUGH} AS centre FROM b GROUP BY log_id),
a AS (SELECT c.log_id, t, value FROM c JOIN w USING (log_id) WHERE t BETWEEN low + centre - 3 AND low + 600 + centre + 3),
s AS (SELECT log_id, centre, a0, a1, b0, b1, middle, coalesce(na, 0) AS na, nb, CAST(ceil((a1 - a0 + 0.05) / 0.1) AS BIGINT) AS ga, CAST(ceil((b1 - b0 + 0.05) / 0.1) AS BIGINT) AS gb FROM w
    JOIN (SELECT log_id, min(t) AS b0, max(t) AS b1, median(t) AS middle, count(*) AS nb FROM b GROUP BY 1) USING (log_id) LEFT JOIN (SELECT log_id, min(t) AS a0, max(t) AS a1, count(*) AS na FROM a GROUP BY 1) USING (log_id)),
g AS (SELECT *, CAST(round((b0 + centre - a0) * 10) AS BIGINT) AS m FROM s WHERE na >= 10 AND nb >= 10 AND ga >= 30 AND gb >= 30),
an AS (SELECT *, lead(t) OVER w AS nt, lead(value) OVER w AS nv FROM a WINDOW w AS (PARTITION BY log_id ORDER BY t)), bn AS (SELECT *, lead(t) OVER w AS nt, lead(value) OVER w AS nv FROM b WINDOW w AS (PARTITION BY log_id ORDER BY t)),
ai AS (SELECT g.log_id, i, a0 + i * 0.1 AS t FROM g, unnest(range(ga)) r(i)), bi AS (SELECT g.log_id, i, b0 + i * 0.1 AS t FROM g, unnest(range(gb)) r(i)),
av AS (SELECT ai.log_id, i, coalesce(value + (nv - value) * (ai.t - an.t) / nullif(nt - an.t, 0), value) AS v FROM ai ASOF JOIN an ON ai.log_id = an.log_id AND ai.t >= an.t),
bv AS (SELECT bi.log_id, i, coalesce(value + (nv - value) * (bi.t - bn.t) / nullif(nt - bn.t, 0), value) AS v FROM bi ASOF JOIN bn ON bi.log_id = bn.log_id AND bi.t >= bn.t),
l AS (SELECT g.log_id, lag, ga, gb FROM g, unnest(range(greatest(m - {REACH}, 1 - gb), least(m + {REACH}, ga - 1) + 1)) r(lag)),
r AS (SELECT l.log_id, lag, CASE WHEN count(*) >= greatest(30, 0.3 * least(max(ga), max(gb))) AND var_pop(av.v) * var_pop(bv.v) > 1e-12 THEN corr(av.v, bv.v) ELSE -1 END AS r FROM l JOIN av ON av.log_id = l.log_id JOIN bv ON bv.log_id = l.log_id AND bv.i = av.i - lag GROUP BY 1, 2),
k AS (SELECT log_id, arg_max(lag, r) AS lag, max(r) AS r, min(lag) AS first, max(lag) AS last FROM r GROUP BY 1),
p AS (SELECT k.log_id, k.lag, CASE WHEN k.lag IN (first, last) THEN k.r * 0.7 ELSE k.r END AS r, CASE WHEN k.lag IN (first, last) OR x.r - 2 * k.r + y.r >= 0 THEN 0 ELSE 0.5 * (x.r - y.r) / (x.r - 2 * k.r + y.r) END AS more
    FROM k LEFT JOIN r x ON x.log_id = k.log_id AND x.lag = k.lag - 1 LEFT JOIN r y ON y.log_id = k.log_id AND y.lag = k.lag + 1)
SELECT s.log_id, round(CASE WHEN r > -0.5 THEN a0 - b0 + (lag + more) / 10 END, 3) AS "offset", round(coalesce(CASE WHEN r > -0.5 THEN r END, 0), 3) AS correlation, CASE WHEN r > -0.5 THEN CAST(least(ga, gb) AS INTEGER) ELSE 0 END AS samples, round(CASE WHEN r > -0.5 THEN middle END, 3) AS middle FROM s LEFT JOIN p USING (log_id)""")
def clock_sync(spark, sf_dir):
    """Each log's clicks against the same ones on another clock, noisy and without the first two, searched around a rough offset."""
    from pyspark.sql import Window

    n = F.col("log_id").cast("long")
    c = events(spark, sf_dir).where("kind = 'click'").withColumn("n", F.row_number().over(Window.partitionBy("log_id").orderBy("ts", "seq"))).withColumn("ts", (F.col("ts") - 1704067200) / 86400)
    shift = 1 + n % 50 * F.lit(0.07)
    other = c.where("n > 2").select("log_id", (F.col("ts") - shift).alias("ts"), (F.col("value") + F.col("seq") % 7).alias("value"))
    centres = c.select("log_id").distinct().withColumn("centre", shift + (n % 5 - 2) * F.lit(0.5))
    found = sync.correlate(c.select("log_id", "ts", "value"), other, ["log_id"], centres, rate=RATE, max_lag=REACH)
    return rounded(found.select("log_id", "offset", "correlation", "samples", "middle"), 3)


@query(f"""WITH {E}, v AS (SELECT log_id AS v_log, ts AS wall, seq * 1.5 AS own FROM e WHERE kind = 'view'), p AS (SELECT log_id, seq, ts, value FROM e WHERE kind = 'purchase'),
a AS (SELECT p.*, wall AS a_wall, own AS a_own FROM p ASOF LEFT JOIN v ON log_id = v_log AND ts >= wall), b AS (SELECT a.*, wall AS b_wall, own AS b_own FROM a ASOF LEFT JOIN v ON log_id = v_log AND ts <= wall)
SELECT log_id, seq AS revlog_id, round(CASE WHEN a_wall IS NULL THEN b_own WHEN b_wall IS NULL OR a_wall = ts THEN a_own ELSE a_own + (b_own - a_own) * (ts - a_wall) / (b_wall - a_wall) END - value, 3) AS coarse FROM b""")
def coarse_offsets(spark, sf_dir):
    """Views are a log's wall-clock records, purchases are files that begin then."""
    e = events(spark, sf_dir)
    clocks = samples(e, {"view": "/Robot/SystemTime"}, type=F.lit("int64"), ts=F.col("seq") * 1.5, v_long=F.col("ts_us"))
    files = e.where("kind = 'purchase'").select("log_id", F.col("seq").alias("revlog_id"), F.col("ts").alias("start"), F.col("value").alias("first"))
    return rounded(sync.coarse_offsets(clocks, files).select("log_id", "revlog_id", "coarse"), 3)


KINDS = {"bolt": ("bolt", "gear"), "widget": ("widget", "gizmo")}


@query("""WITH e AS (SELECT DISTINCT p_brand AS log_id, p_type || '/' || p_name AS entry FROM part), s AS (SELECT DISTINCT p_brand AS log_id, p_size || '/' || split_part(p_name, ' ', 2) AS signal, split_part(p_name, ' ', 2) AS kind, CASE WHEN p_size % 2 = 0 THEN split_part(p_name, ' ', 1) END AS hint FROM part),
p AS (SELECT log_id, signal, entry, lower(entry) AS name, kind, hint FROM s JOIN e USING (log_id)),
c AS (SELECT log_id, signal, entry, max(CASE WHEN CASE kind WHEN 'bolt' THEN contains(name, 'bolt') OR contains(name, 'gear') WHEN 'widget' THEN contains(name, 'widget') OR contains(name, 'gizmo') ELSE contains(name, kind) END THEN 0.5 ELSE 0 END + CASE WHEN contains(name, hint) THEN 0.4 ELSE 0 END + CASE WHEN contains(name, 'economy') OR contains(name, 'promo') THEN 0.1 ELSE 0 END) AS score FROM p GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY log_id, signal ORDER BY round(score, 6) DESC, entry) AS rank FROM c WHERE score > 0) SELECT log_id, signal, entry, round(CAST(score AS DOUBLE), 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def signal_candidates(spark, sf_dir):
    """Brands are logs, types and names of parts their entries; sizes are devices, the last words of names kinds, the first ones hints."""
    p = table(spark, sf_dir, "part")
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    entries = p.select(F.col("p_brand").alias("log_id"), F.concat_ws("/", "p_type", "p_name").alias("entry"), F.lit("double").alias("type"))
    signals = p.select(F.col("p_brand").alias("log_id"), F.concat_ws("/", F.col("p_size").cast("string"), word(2)).alias("signal"), F.when(F.col("p_size") % 2 == 0, word(1)).alias("hint"))
    return rounded(pairing.candidates(entries, signals, ["log_id"], patterns=KINDS, mechanisms=("economy", "promo")))


@query(f"""WITH {E}, t AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY ts, seq) AS place FROM e WHERE kind = 'click'),
x AS (SELECT log_id, place, value / 1000 AS o, k / 100 AS c, ts AS m, k * 1e-5 / CASE WHEN seq % 3 = 0 THEN 10 ELSE 100 END * 1e9 AS rate, CASE WHEN seq % 3 = 0 THEN 10 ELSE 100 END AS apart FROM t WHERE place <= 5),
y AS (SELECT *, max(c > 0.7) OVER (PARTITION BY log_id) AS strong FROM x), g AS (SELECT * FROM y WHERE CASE WHEN strong THEN c > 0.7 ELSE c > 0.5 END),
m AS (SELECT log_id, count(*) AS n, median(o) AS median, avg(c) AS mean FROM g GROUP BY 1), d AS (SELECT log_id, n, median, mean, CASE WHEN n > 1 THEN sqrt(sum((o - median) ** 2) / (n - 1)) ELSE 0 END AS dev FROM g JOIN m USING (log_id) GROUP BY 1, 2, 3, 4),
f AS (SELECT log_id, arg_min(rate, place) AS rate, arg_min(m, place) AS m FROM x WHERE c > 0.5 AND apart >= 60 GROUP BY 1),
z AS (SELECT u.log_id, n, median, CASE WHEN n > 0 AND abs(rate) >= 1 THEN rate ELSE 0 END AS drift, m, least(1, 0.4 * mean + 0.3 * least(n / 3, 1) + 0.3 * greatest(0, 1 - dev / 0.05)) AS conf FROM (SELECT DISTINCT log_id FROM x) u LEFT JOIN d USING (log_id) LEFT JOIN f USING (log_id))
SELECT log_id, round(median, 6) AS "offset", round(coalesce(drift, 0), 3) AS drift, round(CASE WHEN drift <> 0 THEN m ELSE 0 END, 3) AS reference, round(conf, 6) AS confidence, CASE WHEN conf >= 0.85 THEN 'HIGH' WHEN conf >= 0.6 THEN 'MEDIUM' WHEN conf >= 0.3 THEN 'LOW' ELSE 'FAILED' END AS level, CAST(coalesce(n, 0) AS INTEGER) AS agreeing FROM z""")
def clock_consensus(spark, sf_dir):
    """The first five clicks of a log are tried pairs: values their offsets, k their correlations; halves lie 10 or 100 seconds apart."""
    from pyspark.sql import Window

    t = events(spark, sf_dir).where("kind = 'click'").withColumn("place", F.row_number().over(Window.partitionBy("log_id").orderBy("ts", "seq"))).where("place <= 5")
    offset, apart = F.col("value") / 1000, F.when(F.col("seq") % 3 == 0, 10).otherwise(100)
    halves = {"offset_1": F.lit(0.0), "correlation_1": F.col("k") / 100, "middle_1": F.lit(0.0), "offset_2": F.col("k") * F.lit(1e-5), "correlation_2": F.lit(0.9), "middle_2": apart.cast("double")}
    tried = t.select("log_id", "place", F.col("kind").alias("entry"), F.col("kind").alias("signal"), offset.alias("offset"), (F.col("k") / 100).alias("correlation"), F.lit(100).alias("samples"), F.col("ts").alias("middle"), *(c.alias(n) for n, c in halves.items()))
    out = sync.agreed(tried, ["log_id"])
    return out.select("log_id", F.round("offset", 6).alias("offset"), F.round("drift", 3).alias("drift"), F.round("reference", 3).alias("reference"), F.round("confidence", 6).alias("confidence"), "level", "agreeing")
