"""As-of and containment joins, resampling, windows, islands."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Window

from stratalake.functions.quantiles import quantiles
from stratalake.operators import analytics, cuts, intervals, islands
from stratalake.plans.base import SERIES, SPANS, VECTORS, Registry, series, spans, vectors

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
HOUR = 3_600_000_000
SESSIONS = f"""{SERIES}, f AS (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) > {6 * HOUR}, true)::INT AS new FROM series),
  i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS island FROM f), sess AS (SELECT user_id, island, min(us) AS t0, max(us) AS t1, count(*) AS n FROM i GROUP BY 1, 2)"""


@query(f"WITH {SESSIONS} SELECT user_id, t0, t1, n FROM sess")
def session_runs(spark, d):
    return islands.spans_of_runs(series(spark, d), ["user_id"], "us", 6 * HOUR, ["event_id"]).select("user_id", "t0", "t1", "n")


@query(f"WITH {SERIES} SELECT user_id, epoch_us(time_bucket(INTERVAL '1 hour', make_timestamp(us))) AS t0, count(*) AS n, round(sum(value), 6) AS total FROM series GROUP BY 1, 2")
def tumbling(spark, d):
    s = series(spark, d).withColumn("w", F.window(F.timestamp_micros("us"), "1 hour"))
    return s.groupBy("user_id", "w").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select("user_id", F.unix_micros("w.start").alias("t0"), "n", "total")


@query(f"""WITH {SERIES}, r AS (SELECT user_id, min(us) AS a, greatest((max(us) - {12 * HOUR} - min(us)) // {6 * HOUR}, 0) AS last FROM series GROUP BY 1), w AS (SELECT user_id, a + k * {6 * HOUR} AS t0 FROM r, generate_series(0, 2000) g(k) WHERE k <= last)
  SELECT w.user_id, t0, count(*) AS n, round(avg(value), 6) AS mean FROM w JOIN series s ON s.user_id = w.user_id AND s.us >= t0 AND s.us < t0 + {24 * HOUR} GROUP BY 1, 2 HAVING count(*) >= 2""")
def sliding_anchored(spark, d):
    rows = intervals.window_members(series(spark, d), ["user_id"], "us", 24 * HOUR, 6 * HOUR, 2)
    return rows.groupBy("user_id", "t0").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query(f"WITH {SESSIONS}, p AS (SELECT user_id, event_id, us + 1000 AS tm FROM series WHERE event_type = 'click') SELECT p.event_id, t0, t1 FROM p JOIN sess ON p.user_id = sess.user_id AND tm >= t0 AND tm <= t1 + 1")
def contain_join(spark, d):
    s = series(spark, d)
    sess = islands.spans_of_runs(s, ["user_id"], "us", 6 * HOUR, ["event_id"])
    points = s.where("event_type = 'click'").select("user_id", "event_id", (F.col("us") + 1000).alias("us"))
    return intervals.containing(points, sess, ["user_id"], "us", "t0", "t1", 1).select("event_id", "t0", "t1")


@query(f"""WITH {SERIES}, s AS (SELECT event_type, us, max(value) AS value FROM series GROUP BY 1, 2), r AS (SELECT event_type, ceil(min(us) / {HOUR})::BIGINT AS a, (max(us) // {HOUR})::BIGINT AS b FROM s GROUP BY 1), t AS (SELECT event_type, k * {HOUR} AS tm FROM r, generate_series(470000, 500000) g(k) WHERE k BETWEEN a AND b),
  p AS (SELECT t.event_type, tm, s.us AS u0, s.value AS v0 FROM t ASOF JOIN s ON t.event_type = s.event_type AND t.tm >= s.us), n AS (SELECT p.*, s.us AS u1, s.value AS v1 FROM p ASOF JOIN s ON p.event_type = s.event_type AND p.tm <= s.us)
  SELECT event_type, tm AS us, CASE WHEN tm - u0 <= u1 - tm THEN v0 ELSE v1 END AS value FROM n""")
def asof_nearest(spark, d):
    return intervals.resample(series(spark, d), ["event_type"], "us", "value", HOUR)


@query(ORACLES["asof_nearest"].replace("CASE WHEN tm - u0 <= u1 - tm THEN v0 ELSE v1 END AS value", "round(CASE WHEN u0 = u1 THEN v0 ELSE v0 + (v1 - v0) * ((tm - u0)::DOUBLE / ((tm - u0) + (u1 - tm))) END, 6) AS value"))
def resample_linear(spark, d):
    return intervals.resample(series(spark, d), ["event_type"], "us", "value", HOUR, "linear").select("event_type", "us", F.round("value", 6).alias("value"))


@query(f"WITH {SERIES} SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING), -1) AS key FROM series")
def asof_keyframe(spark, d):
    found = intervals.last_keyframe(series(spark, d), ["user_id"], F.struct("us", "event_id"), F.col("event_type") == "signup", "event_id", "key")
    return found.select("event_id", F.coalesce("key", F.lit(-1)).alias("key"))


@query(f"""WITH {SPANS}, m AS (SELECT median(price) AS m, max(price) AS top, floor(median(t1 - t0))::BIGINT AS len FROM spans), h AS (SELECT stream, t0, t1, price, len FROM spans, m WHERE price > m + 0.55 * (top - m)),
  f AS (SELECT *, coalesce(t0 > max(t1) OVER (PARTITION BY stream ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + len + 1, true)::INT AS new FROM h), i AS (SELECT *, sum(new) OVER (PARTITION BY stream ORDER BY t0, t1 ROWS UNBOUNDED PRECEDING) AS island FROM f)
  SELECT stream, min(t0) AS t0, max(t1) AS t1, max(price) AS peak, round(avg(price), 4) AS mean, count(*) AS n FROM i GROUP BY stream, island""")
def segment_merge(spark, d):
    return islands.segments(spans(spark, d), ["stream"], "t0", "t1", "price").select("stream", "t0", "t1", "peak", F.round("mean", 4).alias("mean"), "n")


@query(f"""WITH {SPANS}, f AS (SELECT *, coalesce(t0 > max(t1) OVER (PARTITION BY cust ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS new FROM spans), i AS (SELECT *, sum(new) OVER (PARTITION BY cust ORDER BY t0, t1 ROWS UNBOUNDED PRECEDING) AS island FROM f)
  SELECT cust, min(t0) AS t0, max(t1) AS t1, count(*) AS n FROM i GROUP BY cust, island""")
def merge_touching(spark, d):
    return islands.merge_spans(spans(spark, d), ["cust"], "t0", "t1").groupBy("cust", "island").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.count(F.lit(1)).alias("n")).drop("island")


TRAIL = f"""WITH {SPANS}, f AS (SELECT *, coalesce(t0 >= max(t1) OVER (PARTITION BY cust ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS new FROM spans), i AS (SELECT *, sum(new) OVER (PARTITION BY cust ORDER BY t0, t1 ROWS UNBOUNDED PRECEDING) AS island FROM f),
  trail AS (SELECT cust, island, min(t0) AS t0, max(t1) AS t1, list_sort(list(DISTINCT stream)) AS seen_by, arg_max(id, (price, -id)) AS place, arg_max(id, (t1, -id)) AS end_place FROM i GROUP BY 1, 2)"""


def _trail(spark, d):
    m = islands.merge_spans(spans(spark, d), ["cust"], "t0", "t1", strict=True)
    return m.groupBy("cust", "island").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.array_join(F.array_sort(F.collect_set("stream")), ",").alias("seen_by"), F.max_by("id", F.struct("price", -F.col("id"))).alias("place"), F.max_by("id", F.struct("t1", -F.col("id"))).alias("end_place"))


@query(f"{TRAIL} SELECT cust, t0, t1, array_to_string(seen_by, ',') AS seen_by, place, end_place FROM trail")
def trail(spark, d):
    return _trail(spark, d).drop("island")


@query(f"{TRAIL}, l AS (SELECT *, row_number() OVER (PARTITION BY cust ORDER BY t1 DESC, island DESC) AS k FROM trail) SELECT cust, t0, t1, end_place FROM l WHERE k = 1")
def last_known(spark, d):
    return _trail(spark, d).groupBy("cust").agg(F.max_by(F.struct("t0", "t1", "end_place"), F.struct("t1", "island")).alias("l")).select("cust", "l.*")


@query(f"""{TRAIL}, now AS (SELECT max(t1) AS now FROM spans), l AS (SELECT cust, max(t1) AS until FROM trail GROUP BY 1) SELECT c_custkey AS cust, CASE WHEN until IS NULL THEN 'not_seen' WHEN now - until <= 30 THEN 'seen' WHEN now - until <= 365 THEN 'believed' ELSE 'unknown' END AS status
  FROM customer LEFT JOIN l ON cust = c_custkey, now""")
def belief_status(spark, d):
    from stratalake.plans.base import load

    last, now = _trail(spark, d).groupBy("cust").agg(F.max("t1").alias("until")), spans(spark, d).agg(F.max("t1").alias("now"))
    age = F.col("now") - F.col("until")
    status = F.when(F.col("until").isNull(), "not_seen").when(age <= 30, "seen").when(age <= 365, "believed").otherwise("unknown")
    return load(spark, d, "customer").select(F.col("c_custkey").alias("cust")).join(last, "cust", "left").join(F.broadcast(now), F.lit(True)).select("cust", status.alias("status"))


@query(f"""WITH {SERIES}, w AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY us, event_id) IS DISTINCT FROM event_type AS new FROM series), i AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS island FROM w)
  SELECT user_id, event_type, min(us) AS t0, max(us) AS t1, count(*) AS n FROM i GROUP BY user_id, event_type, island""")
def consecutive_runs(spark, d):
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    found = islands._islands(series(spark, d), ["user_id"], ["us", "event_id"], ~F.lag("event_type").over(w).eqNullSafe(F.col("event_type")))
    return found.groupBy("user_id", "event_type", "island").agg(F.min("us").alias("t0"), F.max("us").alias("t1"), F.count(F.lit(1)).alias("n")).drop("island")


@query(f"WITH {SERIES}, w AS (SELECT user_id, event_type, us, lag(event_type) OVER (PARTITION BY user_id ORDER BY us, event_id) AS came FROM series) SELECT user_id, us, came, event_type AS went FROM w WHERE came <> event_type")
def trail_edges(spark, d):
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    return series(spark, d).withColumn("came", F.lag("event_type").over(w)).where("came <> event_type").select("user_id", "us", "came", F.col("event_type").alias("went"))


@query(f"WITH {SERIES} SELECT event_id, round(coalesce(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY us, event_id)), 0), 6) AS change FROM series")
def change_channel(spark, d):
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    return series(spark, d).select("event_id", F.round(F.coalesce(F.abs(F.col("value") - F.lag("value").over(w)), F.lit(0.0)), 6).alias("change"))


STEPS = f"{VECTORS}, s AS (SELECT vec_id, label, v, lag(v) OVER (PARTITION BY label ORDER BY vec_id) AS p, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos FROM vectors), c AS (SELECT *, list_cosine_similarity(v, p) AS cos FROM s)"


@query(f"""WITH {STEPS}, f AS (SELECT *, (coalesce(1 - cos >= 1.1, true))::INT AS new FROM c), i AS (SELECT *, sum(new) OVER (PARTITION BY label ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM f)
  SELECT label, min(pos) AS first, max(pos) AS last, count(*) AS n FROM i GROUP BY label, island""")
def stretches(spark, d):
    from stratalake.functions.scalar import cosine

    w = Window.partitionBy("label").orderBy("vec_id")
    s = vectors(spark, d).select("label", F.lag("v").over(w).alias("p"), "v", (F.row_number().over(w) - 1).cast("long").alias("pos")).withColumn("far", 1 - cosine(F.col("v"), F.col("p")))
    return islands.stretches(s, ["label"], "pos", F.col("far") >= 1.1).drop("island")


@query(f"""WITH {STEPS}, m AS (SELECT label, median(1 - cos) AS m FROM c GROUP BY 1) SELECT c.label, pos, round((1 - cos) / m, 6) AS change FROM c JOIN m ON c.label = m.label WHERE cos IS NOT NULL""")
def lag_change(spark, d):
    from stratalake.functions.scalar import cosine

    w = Window.partitionBy("label").orderBy("vec_id")
    s = vectors(spark, d).select("label", "v", F.lag("v").over(w).alias("p"), (F.row_number().over(w) - 1).cast("long").alias("pos")).where("p is not null").select("label", "pos", (1 - cosine(F.col("v"), F.col("p"))).alias("x"))
    return s.join(quantiles(s, "x", {"m": 0.5}, ["label"]), "label").select("label", "pos", F.round(F.col("x") / F.col("m"), 6).alias("change"))


@query(f"""WITH {SPANS}, e AS (SELECT stream, t0, row_number() OVER (PARTITION BY stream ORDER BY t0) AS k FROM (SELECT DISTINCT stream, t0 FROM spans)) SELECT a.stream, a.t0, b.t0 AS t1, b.k - a.k AS events FROM e a JOIN e b ON a.stream = b.stream AND b.k - a.k BETWEEN 1 AND 3""")
def proposals(spark, d):
    """Spans of one to three consecutive events, from one pass with leads."""
    w = Window.partitionBy("stream").orderBy("t0")
    e = spans(spark, d).select("stream", "t0").distinct()
    ahead = F.array(*(F.struct(F.lead("t0", k).over(w).alias("t1"), F.lit(k).cast("long").alias("events")) for k in (1, 2, 3)))
    return e.withColumn("ahead", ahead).select("stream", "t0", F.explode("ahead").alias("p")).select("stream", "t0", "p.*").where("t1 is not null")


@query(f"""WITH {VECTORS}, w AS (SELECT vec_id, label, v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM vectors),
  f AS (SELECT a.label, a.k - (l.lag - 1) // 2 AS k, l.lag, 1 - list_cosine_similarity(a.v, b.v) AS far FROM w a CROSS JOIN (SELECT unnest([1, 2, 4, 8]) AS lag) l JOIN w b ON b.label = a.label AND b.k = a.k - l.lag),
  m AS (SELECT lag, median(far) AS mid FROM f GROUP BY 1), s AS (SELECT label, k, sum(far / CASE WHEN mid > 0 THEN mid ELSE 1 END) AS x FROM f JOIN m USING (lag) GROUP BY 1, 2)
  SELECT vec_id, round(CASE WHEN n < 3 THEN 0 ELSE coalesce(x, 0) END, 6) AS pyramid FROM w LEFT JOIN s ON s.label = w.label AND s.k = w.k""")
def lag_pyramid(spark, d):
    """Changes at lags of 1, 2, 4 and 8 rows, each over the median at that lag, summed at the middle of the lag."""
    return analytics.lag_changes(vectors(spark, d), ["label"], "vec_id", "v").select("vec_id", F.round("pyramid", 6).alias("pyramid"))


@query(f"""WITH {VECTORS}, w AS (SELECT vec_id, label, v, lead(v) OVER o AS nv, lead(vec_id) OVER o AS nid, row_number() OVER o AS k, count(*) OVER (PARTITION BY label) AS n FROM vectors WINDOW o AS (PARTITION BY label ORDER BY vec_id)),
  s AS (SELECT label, vec_id, nid, k - row_number() OVER (PARTITION BY label ORDER BY k) AS g FROM w WHERE n > 2 AND nid IS NOT NULL AND list_cosine_similarity(v, nv) >= 0.05)
  SELECT label, min(vec_id) AS first, max(nid) AS last FROM s GROUP BY label, g""")
def frozen_runs(spark, d):
    return analytics.frozen(vectors(spark, d), ["label"], "vec_id", "v", 0.05)


FIT = """WITH v AS (SELECT value::DOUBLE AS v FROM events WHERE value IS NOT NULL), n AS (SELECT count(*) AS n FROM v), p AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k FROM v),
  e AS (SELECT v AS a, lead(v) OVER (ORDER BY k) AS b, k FROM p, n WHERE k BETWEEN floor(0.05::DOUBLE * n) AND floor(0.95::DOUBLE * n) - 1),
  r AS (SELECT min(v) AS lo, max(v) AS hi, least(256, greatest(16, count(*) // 8)) AS bins FROM v), b AS (SELECT least(floor((v - lo) / (hi - lo) * bins), bins - 1) AS bin, lo, hi, bins, count(*) AS c FROM v, r GROUP BY ALL),
  h AS (SELECT *, (sum(c) OVER (ORDER BY bin))::DOUBLE AS w0, (sum(c * bin) OVER (ORDER BY bin))::DOUBLE AS s0, (sum(c) OVER ())::DOUBLE AS w1, (sum(c * bin) OVER ())::DOUBLE AS s1 FROM b),
  cuts AS (SELECT 'knee' AS mode, arg_max((a + b) / 2, (b - a, -a)) AS cut FROM e WHERE b IS NOT NULL UNION ALL SELECT 'quantile', quantile_cont(v, 0.99) FROM v
    UNION ALL SELECT 'otsu', arg_max(lo + (bin + 1) * (hi - lo) / bins, ((s1 * w0 - s0 * w1) * (s1 * w0 - s0 * w1) / (w0 * (w1 - w0)), -bin)) FROM h WHERE w0 < w1)
  SELECT mode, count(*) AS n, round(any_value(cut), 6) AS cut, round((avg(v) FILTER (v > cut) - avg(v) FILTER (v <= cut)) / (stddev_pop(v) + 1e-12), 3) AS separation, round(count(*) FILTER (v <= cut) / count(*), 3) AS frac_below FROM v, cuts GROUP BY mode"""


@query(FIT)
def fit_cut_modes(spark, d):
    """The three ways to read a cut off the values of all events, with what tells whether they have a structure."""
    v = series(spark, d).select("value")
    modes = [cuts.fit_cut(v, "value", m).select(F.lit(m).alias("mode"), "n", F.round("cut", 6).alias("cut"), "separation", "frac_below") for m in ("knee", "quantile", "otsu")]
    return modes[0].union(modes[1]).union(modes[2])


@query(f"""WITH {VECTORS}, w AS (SELECT vec_id, v, lead(v, 1, v) OVER (PARTITION BY label ORDER BY vec_id) AS u FROM vectors), s AS (SELECT a.vec_id, arg_max(b.vec_id, (list_inner_product(a.v, b.u), -b.vec_id)) AS m FROM w a, w b GROUP BY 1)
  SELECT round(avg((vec_id = m)::INT), 6) AS rate FROM s""")
def first_hits(spark, d):
    """How often a vector is nearest to the one that follows it in its recording, among all that follow some vector."""
    w = Window.partitionBy("label").orderBy("vec_id")
    v = vectors(spark, d).select("vec_id", "v", F.coalesce(F.lead("v").over(w), "v").alias("u"))
    return analytics.first_hit_rate(v, "vec_id", "v", "u").select(F.round("rate", 6).alias("rate"))
