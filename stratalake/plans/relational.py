"""Scans, predicates, joins, aggregations, set operations and top-k."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Window

from stratalake.functions.quantiles import quantiles
from stratalake.functions.scalar import epoch_unit, epoch_us
from stratalake.operators import cuts, intervals, islands, ranking
from stratalake.plans.base import SERIES, SPANS, Registry, load, series, spans

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


@query("SELECT l_orderkey, l_linenumber, l_shipdate::VARCHAR AS shipped FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1996-03-20'")
def scan_time_range(spark, d):
    rows = load(spark, d, "lineitem").where("l_shipdate between timestamp_ntz'1996-03-01' and timestamp_ntz'1996-03-20'")
    return rows.select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("string").alias("shipped"))


@query(f"WITH {SPANS} SELECT id, stream, t0, t1 FROM spans WHERE t1 >= 9800 AND t0 <= 9900")
def scan_overlap(spark, d):
    return intervals.overlap_scan(spans(spark, d), "t0", "t1", 9800, 9900).select("id", "stream", "t0", "t1")


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey IN (3, 5, 8) AND l_quantity >= 40")
def scan_in_list(spark, d):
    return load(spark, d, "lineitem").where(F.col("l_suppkey").isin(3, 5, 8) & (F.col("l_quantity") >= 40)).select("l_orderkey", "l_linenumber", "l_suppkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 20000")
def scan_value_range(spark, d):
    return load(spark, d, "orders").where(F.col("o_totalprice").between(1000, 20000)).select("o_orderkey", "o_totalprice")


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events WHERE lower(event_type) LIKE 'pur%' AND (props::JSON->>'k')::BIGINT > 50")
def filter_json_prefix(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return load(spark, d, "events").where(F.lower("event_type").startswith("pur") & (k > 50)).select("event_id", k.alias("k"))


@query("SELECT event_id FROM events WHERE event_type IS DISTINCT FROM 'error' AND (CASE WHEN value > 100 THEN event_type END) IS NULL")
def filter_null_aware(spark, d):
    e = load(spark, d, "events").withColumn("role", F.when(F.col("value") > 100, F.col("event_type")))
    return e.where(~F.col("event_type").eqNullSafe("error") & F.col("role").isNull()).select("event_id")


@query("""WITH s AS (SELECT epoch_us(ts) AS us FROM events), u AS (SELECT 's' AS kind, us // 1000000 AS x FROM s UNION ALL SELECT 'ms', us // 1000 FROM s
  UNION ALL SELECT 'us', us FROM s UNION ALL SELECT 'ns', us * 1000 FROM s), m AS (SELECT kind, median(abs(x))::DOUBLE AS median_abs FROM u GROUP BY 1)
  SELECT kind, median_abs, CASE WHEN median_abs < 1e11 THEN 's' WHEN median_abs < 1e14 THEN 'ms' WHEN median_abs < 1e17 THEN 'us' ELSE 'ns' END AS unit,
  (CASE WHEN median_abs < 1e11 THEN 1000000000 WHEN median_abs < 1e14 THEN 1000000 WHEN median_abs < 1e17 THEN 1000 ELSE 1 END)::BIGINT AS to_ns FROM m""")
def ts_unit_detect(spark, d):
    s = load(spark, d, "events").select(epoch_us(F.col("ts")).alias("us"))
    forms = {"s": F.floor(F.col("us") / 1_000_000), "ms": F.floor(F.col("us") / 1000), "us": F.col("us"), "ns": F.col("us") * 1000}
    found = [epoch_unit(s.select(x.cast("long").alias("x")), "x").select(F.lit(k).alias("kind"), "*") for k, x in forms.items()]
    return found[0].union(found[1]).union(found[2]).union(found[3])


@query("SELECT c_custkey, count(o_orderkey) AS n, coalesce(min(o_orderkey), -1) AS first_order FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def lookup_left(spark, d):
    c, o = load(spark, d, "customer", "orders")
    per = o.groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"), F.min("o_orderkey").alias("first_order"))  # combined before the join
    return c.join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("first_order", F.lit(-1)).alias("first_order"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def lookup_semi(spark, d):
    c, o = load(spark, d, "customer", "orders")
    return c.join(o.where("o_totalprice > 100000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def lookup_anti(spark, d):
    p, l = load(spark, d, "part", "lineitem")  # noqa: E741
    return p.join(l.where("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("""SELECT c_mktsegment AS segment, n_name AS nation, count(*) AS n FROM customer FULL OUTER JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def join_full_outer(spark, d):
    c, n = load(spark, d, "customer", "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "full_outer").groupBy(F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SERIES}, a AS (SELECT event_id, user_id, us, us + 3600000000 AS us1 FROM series WHERE event_type <> 'error'), r AS (SELECT user_id, us - 1800000000 AS r0, us + 1800000000 AS r1 FROM series WHERE event_type = 'error')
  SELECT event_id FROM a WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = a.user_id AND us1 >= r0 AND us <= r1)""")
def anti_rejected(spark, d):
    s = series(spark, d)
    a = s.where("event_type <> 'error'").select("event_id", "user_id", "us", (F.col("us") + 3_600_000_000).alias("us1"))
    r = s.where("event_type = 'error'").select("user_id", (F.col("us") - 1_800_000_000).alias("r0"), (F.col("us") + 1_800_000_000).alias("r1"))
    return intervals.range_join(a, r, ["user_id"], ("us", "us1"), ("r0", "r1"), 7_200_000_000, "left_anti").select("event_id")


@query(f"""WITH {SPANS} SELECT a.id AS a, b.id AS b FROM spans a JOIN spans b ON a.cust = b.cust AND a.id < b.id AND a.t1 >= b.t0 AND a.t0 <= b.t1""")
def join_overlap(spark, d):
    s = spans(spark, d)
    a, b = s.select(F.col("id").alias("a"), "cust", "t0", "t1"), s.select(F.col("id").alias("b"), "cust", F.col("t0").alias("u0"), F.col("t1").alias("u1"))
    return intervals.range_join(a, b, ["cust"], ("t0", "t1"), ("u0", "u1"), 128).where("a < b").select("a", "b")


@query(f"""WITH {SPANS} SELECT a.id AS a, b.id AS b FROM spans a JOIN spans b ON a.cust = b.cust AND a.id <> b.id AND a.t0 <= b.t0 AND b.t1 <= a.t1""")
def join_inside(spark, d):
    s = spans(spark, d)
    a, b = s.select(F.col("id").alias("a"), "cust", "t0", "t1"), s.select(F.col("id").alias("b"), "cust", F.col("t0").alias("u0"), F.col("t1").alias("u1"))
    return intervals.range_join(a, b, ["cust"], ("t0", "t1"), ("u0", "u1"), 128).where("a <> b and t0 <= u0 and u1 <= t1").select("a", "b")


@query(f"WITH {SPANS} SELECT a.id AS a, b.id AS b FROM spans a JOIN spans b ON a.stream = b.stream AND a.cust = b.cust AND a.t1 = b.t0 AND a.id <> b.id")
def join_predecessors(spark, d):
    s = spans(spark, d)
    b = s.select(F.col("id").alias("b"), "stream", "cust", F.col("t0").alias("at"))
    return s.select(F.col("id").alias("a"), "stream", "cust", F.col("t1").alias("at")).join(b, ["stream", "cust", "at"]).where("a <> b").select("a", "b")


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(min(value), 6) AS lo, round(max(value), 6) AS hi, round(avg(value), 6) AS mean, round(median(value), 6) AS med,
  round(stddev_pop(value), 6) AS dev, round(quantile_cont(value, 0.9), 6) AS q90 FROM events GROUP BY 1""")
def group_sources(spark, d):
    v, e = F.col("value"), load(spark, d, "events")
    told = e.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.min(v), 6).alias("lo"), F.round(F.max(v), 6).alias("hi"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("dev"))
    places = quantiles(e, "value", {"med": 0.5, "q90": 0.9}, ["event_type"]).select("event_type", F.round("med", 6).alias("med"), F.round("q90", 6).alias("q90"))
    return told.join(places, "event_type")


@query("SELECT user_id, event_type, count(*) AS found_by, max(value) AS best, arg_max(event_id, (value, -event_id)) AS event_id FROM events GROUP BY 1, 2")
def best_moment(spark, d):
    return load(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("found_by"), F.max("value").alias("best"), F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("event_id"))


@query("SELECT l_returnflag AS flag, l_linestatus AS status, grouping(l_returnflag)::BIGINT AS g, sum(l_quantity)::DOUBLE AS qty, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_totals(spark, d):
    return load(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping("l_returnflag").cast("long").alias("g"), F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n")).withColumnsRenamed({"l_returnflag": "flag", "l_linestatus": "status"})


@query("SELECT n_name AS nation, c_mktsegment AS segment, round(sum(c_acctbal), 2) AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, c_mktsegment)")
def rollup_balances(spark, d):
    c, n = load(spark, d, "customer", "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).rollup(F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment")).agg(F.round(F.sum("c_acctbal"), 2).alias("bal"))


@query("SELECT floor(value / 10)::BIGINT AS bin, count(*) AS n FROM events GROUP BY 1")
def histogram(spark, d):
    return load(spark, d, "events").groupBy(F.floor(F.col("value") / 10).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'order' AS kind, o_orderkey AS id, epoch_us(o_orderdate) AS us, o_totalprice AS price, NULL::VARCHAR AS type FROM orders WHERE o_orderdate < TIMESTAMP '1995-02-01'
  UNION ALL SELECT 'event', event_id, epoch_us(ts), NULL, event_type FROM events WHERE value > 80""")
def union_between(spark, d):
    o, e = load(spark, d, "orders", "events")
    a = o.where("o_orderdate < timestamp_ntz'1995-02-01'").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), epoch_us(F.col("o_orderdate")).alias("us"), F.col("o_totalprice").alias("price"))
    b = e.where("value > 80").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), epoch_us(F.col("ts")).alias("us"), F.col("event_type").alias("type"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT o_custkey AS key FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 5000")
def set_difference(spark, d):
    o, c = load(spark, d, "orders", "customer")
    return o.select(F.col("o_custkey").alias("key")).distinct().join(c.where("c_acctbal < 5000").select(F.col("c_custkey").alias("key")), "key", "left_anti")


@query("SELECT l_suppkey AS key FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_discount > 0.09")
def set_intersection(spark, d):
    l = load(spark, d, "lineitem")  # noqa: E741
    return l.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("key")).intersect(l.where("l_discount > 0.09").select("l_suppkey"))


@query("SELECT source, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def ordered_unique(spark, d):
    return load(spark, d, "documents").groupBy("source").agg(F.min("doc_id").alias("first_doc"))


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25 OFFSET 5")
def topk_global(spark, d):
    return load(spark, d, "events").orderBy(F.desc("value"), "event_id").offset(5).limit(25).select("event_id", "value")


@query("SELECT event_type, event_id, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 7")
def topk_per_key(spark, d):
    return ranking.top_per(load(spark, d, "events"), ["event_type"], "value", "event_id", 7).select("event_type", "event_id", "value", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH RECURSIVE {SERIES}, c AS (SELECT event_type, us AS t0, us + 3600000000 AS t1, value, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, us) AS k FROM series),
  g AS (SELECT event_type, k, [t0] AS kept, [k] AS ks FROM c WHERE k = 1 UNION ALL SELECT g.event_type, c.k, CASE WHEN apart THEN kept || [t0] ELSE kept END, CASE WHEN apart THEN ks || [c.k] ELSE ks END
    FROM g JOIN c ON c.event_type = g.event_type AND c.k = g.k + 1, LATERAL (SELECT len(list_filter(kept, lambda x: abs(x - t0) <= 3600000000)) = 0 AS apart) WHERE len(kept) < 50)
  SELECT event_type, t0, t1, value, event_id FROM c JOIN (SELECT event_type, arg_max(ks, k) AS ks FROM g GROUP BY 1) USING (event_type) WHERE list_contains(ks, k) ORDER BY value DESC, event_type, t0 LIMIT 50""")
def nms_rank(spark, d):
    s = series(spark, d).select("event_type", F.col("us").alias("t0"), (F.col("us") + 3_600_000_000).alias("t1"), "value", "event_id")
    return ranking.suppress(s, ["event_type"], "t0", "t1", "value", 50)


@query("SELECT event_id, round(row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) / count(*) OVER (PARTITION BY event_type), 9) AS r FROM events")
def rank_percent(spark, d):
    return ranking.rank01(load(spark, d, "events"), ["event_type"], "value", "event_id", "r").select("event_id", F.round("r", 9).alias("r"))


@query("SELECT event_id, value FROM events WHERE value >= (SELECT quantile_cont(value, 0.97) FROM events)")
def floor_percentile(spark, d):
    return cuts.floor_at(load(spark, d, "events").select("event_id", "value"), "value", 0.97)


SPLIT = """{pre} v AS ({rows}), r AS (SELECT min(v) AS lo, max(v) AS hi FROM v), b AS (SELECT least(floor((v - lo) / (hi - lo) * 64), 63) AS bin, lo, (hi - lo) / 64 AS w, count(*) AS c FROM v, r WHERE hi - lo > 1e-5 GROUP BY ALL),
  m AS (SELECT bin, c, lo + (bin + 0.5) * w AS mid FROM b), t AS (SELECT mid, sum(c) OVER (ORDER BY bin) AS w0, sum(c * mid) OVER (ORDER BY bin) AS s0, sum(c) OVER () AS w, sum(c * mid) OVER () AS s FROM m),
  best AS (SELECT arg_max(mid, (round(w0 * (w - w0) * (s0 / w0 - (s - s0) / (w - w0)) * (s0 / w0 - (s - s0) / (w - w0)), 6), -mid)) AS mid_at FROM t WHERE w0 < w),
  g AS (SELECT avg(v) FILTER (v <= mid_at) AS ml, avg(v) FILTER (v > mid_at) AS mh, stddev_pop(v) FILTER (v <= mid_at) AS sl, stddev_pop(v) FILTER (v > mid_at) AS sh FROM v, best),
  cut AS (SELECT CASE WHEN mh - ml > sl + sh {anchor} THEN (ml + mh) / 2 END AS cut FROM g)"""


@query(SPLIT.format(pre="WITH", rows="SELECT value::DOUBLE AS v FROM events", anchor="") + " SELECT round(cut, 6) AS cut FROM cut")
def otsu_split(spark, d):
    return cuts.split(load(spark, d, "events"), "value").select(F.round("cut", 6).alias("cut"))


@query("""WITH q AS (SELECT quantile_cont(l_extendedprice, 0.05) AS a, quantile_cont(l_extendedprice, 0.95) AS b FROM lineitem), v AS (SELECT DISTINCT l_extendedprice::DOUBLE AS v FROM lineitem, q WHERE l_extendedprice BETWEEN a AND b),
  n AS (SELECT v, lead(v) OVER (ORDER BY v) AS nx FROM v) SELECT round((v + nx) / 2, 6) AS cut FROM n WHERE nx IS NOT NULL ORDER BY nx - v DESC, v LIMIT 1""")
def knee_cut(spark, d):
    return cuts.widest_gap(load(spark, d, "lineitem"), "l_extendedprice").select(F.round("cut", 6).alias("cut"))


@query(SPLIT.format(pre=f"WITH {SERIES},", rows="SELECT value::DOUBLE AS v FROM series", anchor="") + """, high AS (SELECT user_id, us, value > coalesce(cut, -1) AS hit FROM series, cut), w AS (SELECT *, lag(hit) OVER (PARTITION BY user_id ORDER BY us) AS before FROM high),
  i AS (SELECT *, sum(CASE WHEN hit AND before IS NOT TRUE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS island FROM w),
  found AS (SELECT user_id, island, min(us) AS since, max(us) AS until, count(*) AS n FROM i WHERE hit GROUP BY 1, 2), l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY until DESC) AS k FROM found), now AS (SELECT max(us) AS now FROM series)
  SELECT user_id, since, until, n, CASE WHEN (now - until) / 1e6 < 90 THEN round((now - until) / 1e6)::BIGINT || ' seconds ago' WHEN (now - until) / 1e6 < 5400 THEN round((now - until) / 6e7)::BIGINT || ' minutes ago'
  WHEN (now - until) / 1e6 < 172800 THEN round((now - until) / 3.6e9)::BIGINT || ' hours ago' ELSE round((now - until) / 8.64e10)::BIGINT || ' days ago' END AS said FROM l, now WHERE k = 1""")
def last_active_above_cut(spark, d):
    """Where was each user last active above the data's own cut, and how long ago?"""
    from stratalake.functions.scalar import ago

    s = series(spark, d)
    w = Window.partitionBy("user_id").orderBy("us")
    high = s.join(F.broadcast(cuts.split(s, "value")), F.lit(True)).select("user_id", "us", (F.col("value") > F.coalesce("cut", F.lit(-1.0))).alias("hit"))
    island = islands._islands(high, ["user_id"], ["us"], F.col("hit") & ~F.coalesce(F.lag("hit").over(w), F.lit(False)))
    found = island.where("hit").groupBy("user_id", "island").agg(F.min("us").alias("since"), F.max("us").alias("until"), F.count(F.lit(1)).alias("n"))
    last = found.groupBy("user_id").agg(F.max_by(F.struct("since", "until", "n"), "until").alias("l")).select("user_id", "l.*")
    now = s.agg(F.max("us").alias("now"))
    return last.join(F.broadcast(now), F.lit(True)).select("user_id", "since", "until", "n", ago((F.col("now") - F.col("until")) / 1e6).alias("said"))
