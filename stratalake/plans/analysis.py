"""Queries of the further operators: events, edges, paths, nesting, planning of reads, metadata."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Window

from stratalake.functions.scalar import cosine, epoch_us, iou
from stratalake.operators import analytics, intervals, islands
from stratalake.operators import vectors as vec
from stratalake.plans.base import SERIES, SPANS, VECTORS, Registry, load, series, spans, vectors
from stratalake.plans.retrieval import SCORES, _scores

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


@query(f"WITH {SERIES}, w AS (SELECT user_id, us, value, lag(value) OVER q AS p, lead(value) OVER q AS n FROM series WINDOW q AS (PARTITION BY user_id ORDER BY us)) SELECT user_id, us, value FROM w WHERE (p IS NULL OR value >= p) AND (n IS NULL OR value > n)")
def local_peaks(spark, d):
    return analytics.local_peaks(series(spark, d).select("user_id", "us", "value"), ["user_id"], "us", "value")


@query(f"WITH {SERIES}, w AS (SELECT user_id, us, value, lag(value) OVER q AS p, lead(value) OVER q AS n FROM series WINDOW q AS (PARTITION BY user_id ORDER BY us)), e AS (SELECT * FROM w WHERE (p IS NULL OR value >= p) AND (n IS NULL OR value > n)) SELECT user_id, us, value > avg(value) OVER (PARTITION BY user_id) AS coarse FROM e")
def coarse_edges(spark, d):
    return analytics.coarse(local_peaks(spark, d), ["user_id"], "value").select("user_id", "us", "coarse")


@query(f"""WITH RECURSIVE {SERIES}, ab AS (SELECT user_id, us, abs(value - lag(value) OVER q) AS a, us - lag(us) OVER q AS b FROM series WINDOW q AS (PARTITION BY user_id ORDER BY us)),
  rk AS (SELECT user_id, us, (row_number() OVER (PARTITION BY user_id ORDER BY a, us) + row_number() OVER (PARTITION BY user_id ORDER BY b, us))::DOUBLE AS score FROM ab WHERE a IS NOT NULL), pn AS (SELECT *, lag(score) OVER q AS p, lead(score) OVER q AS n FROM rk WINDOW q AS (PARTITION BY user_id ORDER BY us)),
  pk AS (SELECT user_id, us, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, us) AS k FROM pn WHERE (p IS NULL OR score >= p) AND (n IS NULL OR score > n)),
  g AS (SELECT user_id, k, [us] AS kept FROM pk WHERE k = 1 UNION ALL SELECT g.user_id, pk.k, CASE WHEN len(list_filter(kept, lambda x: abs(x - us) < 3600000000)) = 0 THEN kept || [us] ELSE kept END FROM g JOIN pk ON pk.user_id = g.user_id AND pk.k = g.k + 1)
  SELECT user_id, us, score FROM pk JOIN (SELECT user_id, arg_max(kept, k) AS kept FROM g GROUP BY 1) USING (user_id) WHERE list_contains(kept, us)""")
def fused_edges(spark, d):
    """Local maxima of summed change ranks of two channels, at least an hour apart."""
    w = Window.partitionBy("user_id")
    s = series(spark, d).withColumn("a", F.abs(F.col("value") - F.lag("value").over(w.orderBy("us")))).withColumn("b", F.col("us") - F.lag("us").over(w.orderBy("us"))).where("a is not null")
    r = s.select("user_id", "us", (F.row_number().over(w.orderBy("a", "us")) + F.row_number().over(w.orderBy("b", "us"))).cast("double").alias("score"))
    return analytics.spaced(analytics.local_peaks(r, ["user_id"], "us", "score"), ["user_id"], "us", "score", 3_600_000_000)


@query(f"""WITH RECURSIVE {SERIES}, nr AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY us) AS k, value FROM series), sm AS (SELECT event_type, k, sum(value) OVER (PARTITION BY event_type ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS s FROM nr),
  ct AS (SELECT event_type, quantile_cont(s, 0.8) AS cut FROM sm GROUP BY 1), bf AS (SELECT *, lag(s) OVER (PARTITION BY event_type ORDER BY k) AS b FROM sm), up AS (SELECT event_type, k FROM bf JOIN ct USING (event_type) WHERE s > cut AND (b IS NULL OR b <= cut)),
  nx AS (SELECT u.event_type, u.k, min(v.k) AS next FROM up u LEFT JOIN up v ON v.event_type = u.event_type AND v.k >= u.k + 6 GROUP BY ALL),
  g AS (SELECT event_type, min(k) AS k FROM up GROUP BY 1 UNION ALL SELECT g.event_type, next FROM g JOIN nx USING (event_type, k) WHERE next IS NOT NULL) SELECT event_type, k FROM g""")
def gated_events(spark, d):
    s = series(spark, d).select("event_type", F.row_number().over(Window.partitionBy("event_type").orderBy("us")).cast("long").alias("k"), "value")
    return analytics.gated_events(s, ["event_type"], "k", "value", 0.8, 6)


@query(f"""WITH {VECTORS}, u AS (SELECT label, vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 10 + 1 AS s FROM vectors), pr AS (SELECT label, vec_id, s, unnest([s, s - 1]) AS pair FROM u),
  ok AS (SELECT label, pair, count(*) FILTER (s = pair) AS na, count(*) FILTER (s > pair) AS nb FROM pr GROUP BY ALL HAVING na > 0 AND nb > 0), dr AS (SELECT label, pair, vec_id, trial, row_number() OVER (PARTITION BY label, pair, trial ORDER BY CASE WHEN trial > 0 THEN md5('0:' || trial || ':' || vec_id) ELSE s::VARCHAR END, s) <= na AS a FROM (SELECT *, unnest(range(0, 51)) AS trial FROM pr) JOIN ok USING (label, pair) WHERE trial > 0),
  al AS (SELECT label, pair, vec_id, trial, a FROM dr UNION ALL SELECT label, pair, vec_id, 0, s = pair FROM pr JOIN ok USING (label, pair)), dx AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM u),
  ms AS (SELECT label, pair, trial, i, avg(x) FILTER (a) - avg(x) FILTER (NOT a) AS m FROM al JOIN dx USING (vec_id) GROUP BY ALL), gp AS (SELECT label, pair, trial, sqrt(sum(m * m)) AS g FROM ms GROUP BY ALL), sn AS (SELECT label, pair, g AS distance FROM gp WHERE trial = 0)
  SELECT label, pair, round(distance, 6) AS distance, round((count(*) FILTER (g >= distance - 1e-12) + 1) / 51, 9) AS p FROM gp JOIN sn USING (label, pair) WHERE trial > 0 GROUP BY label, pair, distance""")
def shifted_stretches(spark, d):
    w = Window.partitionBy("label").orderBy("vec_id")
    v = vectors(spark, d).withColumn("k", (F.floor((F.row_number().over(w) - 1) / 10) + 1))
    return analytics.shifts(v, ["label"], "k", "vec_id", "v", 50).select("label", "pair", F.round("distance", 6).alias("distance"), F.round("p", 9).alias("p"))


@query()
def aligned_paths(spark, d):
    """Labels by twos, stretch by stretch of 50 rows: a table of one alignment has 2500 cells at most."""
    v = vectors(spark, d).withColumn("k", F.floor((F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1) / 50))
    v = v.select((F.floor(F.col("label") / 2) * 2**32 + F.col("k")).cast("long").alias("key"), (F.col("label") % 2).alias("side"), "vec_id", "v")
    return analytics.aligned_path(v, ["key"], "side", "vec_id", "v")


BOX = "box AS (SELECT l_orderkey AS g, l_linenumber AS k, l_quantity AS x0, round(l_tax * 100) AS y0, l_quantity + round(l_discount * 100) * 4 AS x1, round(l_tax * 100) + 4 + round(l_discount * 100) AS y1 FROM lineitem WHERE l_discount > 0)"


@query(f"""WITH {BOX}, p AS (SELECT a.g, a.k, b.k AS parent, row_number() OVER (PARTITION BY a.g, a.k ORDER BY (b.x1 - b.x0) * (b.y1 - b.y0), b.k) AS n FROM box a JOIN box b ON a.g = b.g AND (b.x1 - b.x0) * (b.y1 - b.y0) > (a.x1 - a.x0) * (a.y1 - a.y0)
  AND greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) > 0.75 * (a.x1 - a.x0) * (a.y1 - a.y0)) SELECT box.g, box.k, coalesce(p.parent, -1) AS parent FROM box LEFT JOIN p ON p.g = box.g AND p.k = box.k AND n = 1""")
def region_nesting(spark, d):
    b = load(spark, d, "lineitem").where("l_discount > 0").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("k"), F.col("l_quantity").alias("x0"), F.round(F.col("l_tax") * 100).alias("y0"), (F.col("l_quantity") + F.round(F.col("l_discount") * 100) * 4).alias("x1"), (F.round(F.col("l_tax") * 100) + 4 + F.round(F.col("l_discount") * 100)).alias("y1"))
    return analytics.smallest_enclosing(b, ["g"], "k", "x0", "y0", "x1", "y1").select("g", "k", F.coalesce("parent", F.lit(-1)).alias("parent"))


@query(f"""WITH {VECTORS}, e AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vectors), m AS (SELECT i, avg(x) AS m FROM e GROUP BY 1), c AS (SELECT vec_id, list(x - m ORDER BY i) AS v FROM e JOIN m USING (i) GROUP BY 1)
  SELECT a.vec_id, arg_min(b.vec_id, (round(list_cosine_similarity(a.v, b.v), 9), b.vec_id)) AS opposite FROM c a JOIN c b ON a.vec_id <> b.vec_id GROUP BY 1""")
def opposite_pairs(spark, d):
    return analytics.opposites(vectors(spark, d), "vec_id", "v")


@query(f"""WITH {VECTORS}, e AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vectors), m AS (SELECT i, avg(x) AS m FROM e GROUP BY 1), c AS (SELECT vec_id, list(x - m ORDER BY i) AS v FROM e JOIN m USING (i) GROUP BY 1)
  SELECT a.vec_id, arg_min(b.vec_id, (round(list_cosine_similarity(a.v, b.v), 9), b.vec_id)) AS opposite FROM c a JOIN c b ON a.vec_id <> b.vec_id GROUP BY 1""")
def opposite_pairs_all(spark, d):
    return analytics.opposites(vectors(spark, d), "vec_id", "v")


@query(f"""WITH {SCORES}, t AS (SELECT *, row_number() OVER (ORDER BY a DESC, vec_id) - 1 AS r FROM s), h AS (SELECT *, row_number() OVER (ORDER BY b DESC, vec_id) - 1 AS q FROM t WHERE r < 30) SELECT vec_id, round(0.6 * (1 - r / 29) + 0.4 * (1 - q / 29), 6) AS blend FROM h""")
def rerank_blend(spark, d):
    return analytics.rerank_blend(_scores(spark, d), "a", "b", "vec_id", 0.4, 30).select("vec_id", F.round("blend", 6).alias("blend"))


@query(f"""WITH {SCORES}, c AS (SELECT vec_id, a FROM s WHERE vec_id % 2 = 0) SELECT s.vec_id, round(coalesce(c.a, -s.a), 6) AS margin, c.a IS NULL AS fresh FROM s LEFT JOIN c USING (vec_id) WHERE s.b > 0""")
def verdict_cache(spark, d):
    s = _scores(spark, d)
    cache = s.where("vec_id % 2 = 0").select("vec_id", F.col("a").alias("margin"), F.lit(False).alias("fresh"))
    found, _ = analytics.cached_scores(s.where("b > 0").select("vec_id", "a"), cache, ["vec_id"], "margin", lambda rows: rows.withColumn("margin", -F.col("a")))
    return found.join(cache.select("vec_id", "fresh"), "vec_id", "left").select("vec_id", F.round("margin", 6).alias("margin"), F.col("fresh").isNull().alias("fresh"))


@query(f"""WITH {VECTORS}, x AS (SELECT vec_id, unnest(v) AS s, generate_subscripts(v, 1) - 1 AS c FROM vectors), t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, c) AS k FROM x), h AS (SELECT *, exp((s - max(s) OVER (PARTITION BY vec_id)) / 0.05) AS e FROM t WHERE k <= 5)
  SELECT vec_id, c::BIGINT AS c, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS w FROM h""")
def class_weights(spark, d):
    w = vectors(spark, d).select("vec_id", F.explode(analytics.class_weights(F.col("v"))).alias("e"))
    return w.select("vec_id", F.col("e.c").cast("long").alias("c"), F.round("e.w", 6).alias("w"))


@query(f"""WITH {VECTORS}, k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i, count(*) OVER (PARTITION BY label) AS n FROM vectors), e AS (SELECT label, i <= 6 AS head, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM k WHERE n >= 12 AND (i <= 6 OR i > n - 6)),
  m AS (SELECT label, head, j, avg(x) AS m FROM e GROUP BY ALL), dd AS (SELECT a.label, a.j, b.m - a.m AS x FROM m a JOIN m b ON a.label = b.label AND a.j = b.j AND a.head AND NOT b.head), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM dd GROUP BY 1)
  SELECT label, round(x / n, 6) AS head FROM dd JOIN n USING (label) WHERE j = 1""")
def motion_delta(spark, d):
    return analytics.motion(vectors(spark, d), ["label"], "vec_id", "v", 6).select("label", F.round(F.col("v")[0], 6).alias("head"))


@query(f"""WITH {VECTORS}, e AS (SELECT label, vec_id % 7 + 1 AS w, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vectors) SELECT label, round(sum(x * w) / sum(w), 6) AS head FROM e WHERE i = 1 GROUP BY 1""")
def weighted_pool(spark, d):
    m = vec.mean_vector(vectors(spark, d).withColumn("w", F.col("vec_id") % 7 + 1), ["label"], "v", "w")
    return m.select("label", F.round(F.col("v")[0], 6).alias("head"))


@query(f"""WITH {VECTORS}, c AS (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vectors WHERE vec_id BETWEEN 10 AND 14) GROUP BY 1))
  SELECT vec_id, round(list_cosine_similarity(v, c), 6) AS s FROM vectors, c WHERE vec_id NOT BETWEEN 10 AND 14 ORDER BY list_cosine_similarity(v, c) DESC, vec_id LIMIT 8""")
def clip_search(spark, d):
    """Query by example: the mean of the example's vectors, its own rows left out before the cut."""
    v = vectors(spark, d).withColumn("one", F.lit(1))
    q = vec.mean_vector(v.where("vec_id between 10 and 14"), ["one"], "v").select(F.col("v").alias("q"))
    hits = v.where("vec_id not between 10 and 14").join(F.broadcast(q), F.lit(True)).select("vec_id", cosine(F.col("v"), F.col("q")).alias("s"))
    return hits.orderBy(F.desc("s"), "vec_id").limit(8).select("vec_id", F.round("s", 6).alias("s"))


@query(f"WITH {SERIES}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM series) SELECT event_id FROM k WHERE i IN (SELECT unnest(list_transform(range(0, least(n, 9)), lambda j: CASE WHEN least(n, 9) <= 1 THEN 0 ELSE round(j * (n - 1) / (least(n, 9) - 1)) END))::BIGINT)")
def even_subsample(spark, d):
    w = Window.partitionBy("user_id")
    k = series(spark, d).select("event_id", (F.row_number().over(w.orderBy("us")) - 1).cast("long").alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    return k.where(F.array_contains(analytics.even_places(F.col("n"), 9), F.col("i"))).select("event_id")


@query(f"""WITH {SERIES}, p AS (SELECT user_id, us, event_id * 1000 AS off, (user_id * 37) % 400 + 100 AS size, event_type = 'signup' AS key FROM series), g AS (SELECT *, last_value(CASE WHEN key THEN off END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS gk FROM p),
  r AS (SELECT user_id, min(coalesce(gk, off)) AS lo, max(off + size) AS hi FROM g WHERE us BETWEEN 1704500000000000 AND 1704900000000000 GROUP BY 1) SELECT user_id, lo, hi FROM r""")
def plan_byte_span(spark, d):
    """One byte range for each stream: from the keyframe that governs the window's first packet to its last packet."""
    p = series(spark, d).select("user_id", "us", (F.col("event_id") * 1000).alias("off"), (F.col("user_id") * 37 % 400 + 100).alias("size"), (F.col("event_type") == "signup").alias("key"))
    g = intervals.last_keyframe(p, ["user_id"], F.col("us"), F.col("key"), "off", "gk").where("us between 1704500000000000 and 1704900000000000")
    return g.groupBy("user_id").agg(F.min(F.coalesce("gk", "off")).alias("lo"), F.max(F.col("off") + F.col("size")).alias("hi"))


@query(f"""WITH {SPANS}, m AS (SELECT stream, t0, t1 FROM spans WHERE price > 150000), f AS (SELECT *, coalesce(t0 > max(t1) OVER (PARTITION BY stream ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS new FROM m), i AS (SELECT *, sum(new) OVER (PARTITION BY stream ORDER BY t0, t1 ROWS UNBOUNDED PRECEDING) AS k FROM f),
  s AS (SELECT stream, k, min(t0) AS t0, max(t1) AS t1 FROM i GROUP BY 1, 2) SELECT stream, t0, t1, (sum(t1 - t0) OVER (PARTITION BY stream ORDER BY t0) - (t1 - t0) + 5 * (k - 1))::BIGINT AS x FROM s""")
def compressed_axis(spark, d):
    """Where each busy stretch begins on an axis that shows every gap as five units."""
    m = islands.merge_spans(spans(spark, d).where("price > 150000"), ["stream"], "t0", "t1").groupBy("stream", "island").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    before = F.sum(F.col("t1") - F.col("t0")).over(Window.partitionBy("stream").orderBy("t0").rowsBetween(Window.unboundedPreceding, -1))
    return m.select("stream", "t0", "t1", (F.coalesce(before, F.lit(0)) + 5 * (F.col("island") - 1)).alias("x"))


@query(f"WITH {SPANS}, q AS (SELECT *, t0 >= 9800 AND t1 <= 9830 AS within FROM spans WHERE t1 >= 9800 AND t0 <= 9830), a AS (SELECT *, bool_or(within) OVER (PARTITION BY cust) AS anyin FROM q) SELECT id FROM a WHERE within OR NOT anyin")
def atoms_of_span(spark, d):
    """Rows inside a span; where a recording has none, those that overlap it."""
    q = intervals.overlap_scan(spans(spark, d), "t0", "t1", 9800, 9830).withColumn("within", (F.col("t0") >= 9800) & (F.col("t1") <= 9830))
    return q.withColumn("anyin", F.max("within").over(Window.partitionBy("cust"))).where(F.col("within") | ~F.col("anyin")).select("id")


@query(f"WITH {SPANS} SELECT a.id AS a, b.id AS b, greatest(0, least(a.t1, b.t1) - greatest(a.t0, b.t0)) AS shared, greatest(a.t1, b.t1) - least(a.t0, b.t0) AS both FROM spans a JOIN spans b ON a.cust = b.cust AND a.id < b.id AND a.t0 < b.t1 AND b.t0 < a.t1 WHERE a.t1 > a.t0 OR b.t1 > b.t0")
def span_iou(spark, d):
    s = spans(spark, d)
    a, b = s.select(F.col("id").alias("a"), "cust", "t0", "t1"), s.select(F.col("id").alias("b"), "cust", F.col("t0").alias("u0"), F.col("t1").alias("u1"))
    j = intervals.range_join(a, b, ["cust"], ("t0", "t1"), ("u0", "u1"), 128).where("a < b and t0 < u1 and u0 < t1")
    both = F.greatest("t1", "u1") - F.least("t0", "u0")
    return j.select("a", "b", F.round(iou(F.col("t0"), F.col("t1"), F.col("u0"), F.col("u1")) * both).cast("long").alias("shared"), both.alias("both"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'F', 'P') AND o_totalprice > 0 AND length(o_orderpriority) BETWEEN 1 AND 40 AND o_custkey IS NOT NULL")
def valid_rows(spark, d):
    """Rows that pass declared checks: allowed values, bounds, lengths, required columns."""
    checks = {"status": F.col("o_orderstatus").isin("O", "F", "P"), "price": F.col("o_totalprice") > 0, "text": F.length("o_orderpriority").between(1, 40), "customer": F.col("o_custkey").isNotNull()}
    failed = F.filter(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items())), lambda x: x.isNotNull())
    return load(spark, d, "orders").withColumn("failed", failed).where(F.size("failed") == 0).select("o_orderkey")


@query("""WITH u AS (SELECT event_id, event_type, CASE event_type WHEN 'click' THEN 'GLACIER' WHEN 'error' THEN 'deep_archive' WHEN 'view' THEN 'Standard' END AS class FROM events), o(prefix, opts) AS (VALUES ('', 'root'), ('c', 'short'), ('cli', 'long'), ('pur', 'other'))
  SELECT event_id, CASE WHEN upper(class) IN ('GLACIER', 'DEEP_ARCHIVE') THEN 'cold' ELSE 'hot' END AS tier, (SELECT arg_max(opts, length(prefix)) FROM o WHERE starts_with(event_type, prefix)) AS opts FROM u""")
def storage_options(spark, d):
    """Tier by storage class, and the options of the longest matching prefix (a short list, broadcast)."""
    cls = F.create_map(*(F.lit(x) for kv in (("click", "GLACIER"), ("error", "deep_archive"), ("view", "Standard")) for x in kv))
    u = load(spark, d, "events").select("event_id", "event_type", F.try_element_at(cls, F.col("event_type")).alias("class"))
    o = spark.createDataFrame([("", "root"), ("c", "short"), ("cli", "long"), ("pur", "other")], "prefix string, opts string")
    tier = F.when(F.upper("class").isin("GLACIER", "DEEP_ARCHIVE"), "cold").otherwise("hot")
    best = u.select("event_type").distinct().join(F.broadcast(o), F.expr("startswith(event_type, prefix)")).groupBy("event_type").agg(F.max_by("opts", F.length("prefix")).alias("opts"))
    return u.join(F.broadcast(best), "event_type").select("event_id", tier.alias("tier"), "opts")


@query(r"""WITH n AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'clip_2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || '_10-20-30.mp4' WHEN doc_id % 3 = 1 THEN 'IMG_' || doc_id END AS name, CASE WHEN doc_id % 2 = 0 THEN '2023-05-06T07:08:09' END AS tag, text FROM documents)
  SELECT doc_id, sha256(text) AS sha, coalesce(epoch_us(try_strptime(nullif(regexp_extract(name, '\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2}'), ''), '%Y-%m-%d_%H-%M-%S')), epoch_us(tag::TIMESTAMP), -1) AS started FROM n""")
def capture_start(spark, d):
    """Content hash, and the start from the name's clock, else the container's tag."""
    n = load(spark, d, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("clip_2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit("_10-20-30.mp4"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("IMG_"), F.col("doc_id").cast("string"))).alias("name"),
                                           F.when(F.col("doc_id") % 2 == 0, "2023-05-06T07:08:09").alias("tag"))
    clock = F.try_to_timestamp(F.regexp_extract("name", r"\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2}", 0), F.lit("yyyy-MM-dd_HH-mm-ss"))
    return n.select("doc_id", F.sha2("text", 256).alias("sha"), F.coalesce(F.unix_micros(clock), epoch_us(F.col("tag").cast("timestamp")), F.lit(-1)).alias("started"))


@query(f"WITH {SERIES}, c AS (SELECT user_id, us, event_id, sum(floor(value)::BIGINT % 50) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) % 900 AS total FROM series) SELECT event_id, greatest(0, total - coalesce(lag(total) OVER (PARTITION BY user_id ORDER BY us), 0))::BIGINT AS delta FROM c")
def usage_deltas(spark, d):
    """Deltas of a counter that may start over."""
    w = Window.partitionBy("user_id").orderBy("us")
    c = series(spark, d).select("user_id", "us", "event_id", (F.sum(F.floor("value") % 50).over(w.rowsBetween(Window.unboundedPreceding, 0)) % 900).alias("total"))
    return c.select("event_id", F.greatest(F.lit(0), F.col("total") - F.coalesce(F.lag("total").over(w), F.lit(0))).alias("delta"))


@query(f"""WITH {SERIES}, m AS (SELECT event_type AS kind, user_id // 10 AS footage, us // {86_400_000_000} AS day, max(value) AS best, count(*) AS found_by, arg_max(event_id, (value, -event_id)) AS id, max(us) AS until FROM series GROUP BY 1, 2, 3) SELECT kind, footage, day, best, found_by, id FROM m ORDER BY until DESC, id LIMIT 60""")
def timeline(spark, d):
    """Moments counted once with their best score, newest first."""
    s = series(spark, d).groupBy(F.col("event_type").alias("kind"), F.floor(F.col("user_id") / 10).alias("footage"), F.floor(F.col("us") / 86_400_000_000).alias("day"))
    m = s.agg(F.max("value").alias("best"), F.count(F.lit(1)).alias("found_by"), F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("id"), F.max("us").alias("until"))
    return m.orderBy(F.desc("until"), "id").limit(60).select("kind", "footage", "day", "best", "found_by", "id")
