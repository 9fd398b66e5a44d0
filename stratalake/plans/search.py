"""Queries of the composed searches, clusters, graph index, latent space and SQL functions."""

from __future__ import annotations

import os
import tempfile

import pyspark.sql.functions as F
from pyspark.sql import Window

from stratalake.functions.quantiles import quantiles
from stratalake.functions.scalar import cosine
from stratalake.functions.sql import register
from stratalake.operators import clusters, graph_index, quantised, search, sequence
from stratalake.plans.base import VECTORS, Registry, load, vectors
from stratalake.plans.relational import SPLIT
from stratalake.plans.retrieval import SCORES, _scores

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def _checkpointed(spark):
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "stratalake-checkpoints"))


FAR = f"""WITH {VECTORS}, n AS (SELECT a.vec_id, 1 - max(list_cosine_similarity(a.v, b.v)) AS far FROM vectors a, vectors b WHERE a.label >= 3 AND b.label < 3 GROUP BY 1),
  o AS (SELECT 1 - list_sort(list(list_cosine_similarity(a.v, b.v)), 'DESC')[2] AS far FROM vectors a, vectors b WHERE a.label < 3 AND b.label < 3 GROUP BY a.vec_id),"""


@query(SPLIT.format(pre=FAR, rows="SELECT far AS v FROM n UNION ALL SELECT far FROM o", anchor="AND least(abs(ml), abs(mh)) < mh - ml") + " SELECT vec_id, round(far, 6) AS far FROM n, cut WHERE far >= cut")
def uncovered(spark, d):
    _checkpointed(spark)
    v = vectors(spark, d)
    return search.uncovered(v.where("label >= 3"), v.where("label < 3"), "vec_id", "v").select(F.col("key").alias("vec_id"), F.round("far", 6).alias("far"))


@query()
def spend(spark, d):
    _checkpointed(spark)
    v = vectors(spark, d)
    return search.spend(v.where("label >= 3"), v.where("label < 3"), "vec_id", "v", 6)


@query()
def density_clusters(spark, d):
    return clusters.density_clusters(vectors(spark, d), "vec_id", "v")


@query()
def graph_index_search(spark, d):
    """Every row whose id 100 divides, against all rows."""
    v = vectors(spark, d)
    return graph_index.search(graph_index.build(v, "vec_id", "v"), v.where("vec_id % 100 = 0"), "vec_id", "v", 10)


@query()
def quantised_index_search(spark, d):
    """Every row whose id 100 divides, against all rows, by stored codes in two thirds of the cells."""
    v = vectors(spark, d)
    index = quantised.build(v, "vec_id", "v")
    return quantised.cell_search(index, v.where("vec_id % 100 = 0"), "vec_id", "v", 10, -(-2 * len(index.centres) // 3))


@query()
def contrasted_search(spark, d):
    _checkpointed(spark)
    s = sequence.steps_from_vectors(vectors(spark, d)).checkpoint()
    spans = s.groupBy("rec").agg(F.max("pos").alias("m")).select("rec", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.col("m") - 2), F.lit(3).cast("long"))).alias("begin"), "m")
    return search.contrasted(s, 2, 3, 5, spans.select("rec", "begin", F.least(F.col("begin") + 2, "m").alias("end")))


@query()
def hybrid_search(spark, d):
    _checkpointed(spark)
    docs, v = load(spark, d, "documents", "embeddings")
    q = v.where("vec_id = 3").select(F.col("embedding").alias("q"))
    look = v.join(F.broadcast(q), F.lit(True)).select(F.col("vec_id").alias("doc_id"), cosine(F.col("embedding"), F.col("q")).alias("appearance"))
    words = docs.where("doc_id = 3").select("text").first()[0]  # the question: the words of one row
    return search.hybrid(docs.where("text is not null"), "doc_id", "text", words, look, dims=16)


CHAIN = f"""WITH {SCORES}, p AS (SELECT vec_id AS node, label, a, b, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM s), t AS (SELECT x.node AS n0, y.node AS n1, z.node AS n2, x.a AS f0, y.b AS f1, z.a AS f2 FROM p x JOIN p y ON x.label = y.label AND y.k = x.k + 1 JOIN p z ON z.label = y.label AND z.k BETWEEN y.k + 1 AND y.k + 2),
  one AS (SELECT n1, arg_max((n0, n2, f0, f1, f2), (round(f0 + f1 + f2, 9), -n0, -n2)) AS b FROM t GROUP BY n1 UNION SELECT n1, arg_max((n0, n2, f0, f1, f2), (round(least(f0, f1, f2), 9), -n0, -n2)) FROM t GROUP BY n1),
  f AS (SELECT n1, b[1] AS n0, b[2] AS n2, round((b[3] + b[4] + b[5]) / 3, 9) AS mean, round(least(b[3], b[4], b[5]), 9) AS low FROM one)
  SELECT n1 AS node, n0 || '-' || n1 || '-' || n2 AS path, round(0.001 * mean - (row_number() OVER (ORDER BY mean DESC, n0, n1, n2) + row_number() OVER (ORDER BY low DESC, n0, n1, n2) - 2), 6) AS score FROM f"""


@query(CHAIN)
def clause_chains(spark, d):
    """One clause, then a second, and a third during that; chains best by mean and by the weakest clause, pooled."""
    _checkpointed(spark)
    s = _scores(spark, d)
    k = s.select("label", F.col("vec_id").alias("node"), F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("k"))
    scores = s.select(F.lit(0).alias("clause"), F.col("vec_id").alias("node"), F.col("a").alias("score")).union(s.select(F.lit(1), "vec_id", "b")).union(s.select(F.lit(2), "vec_id", "a"))
    follows = k.select("label", F.col("node").alias("before"), (F.col("k") + 1).alias("k")).join(k, ["label", "k"]).select("before", "node")
    inside = k.select("label", F.col("node").alias("outer"), F.explode(F.array(F.col("k") + 1, F.col("k") + 2)).alias("k")).join(k, ["label", "k"]).select("outer", F.col("node").alias("inner"))
    return search.chains(scores, follows, inside, ["start", "then", "during"]).select("node", F.concat_ws("-", F.col("path").cast("array<string>")).alias("path"), F.round("score", 6).alias("score"))


RECALL = f"""WITH {SCORES}, p AS (SELECT vec_id, label, a, CASE WHEN vec_id % 5 > 0 THEN b END AS b, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos FROM s), e AS (SELECT label, min(pos) AS lo, max(pos) AS hi FROM p GROUP BY 1),
  c AS ((SELECT label, pos FROM p ORDER BY a DESC, vec_id LIMIT 15) UNION (SELECT label, pos FROM p WHERE b IS NOT NULL ORDER BY b DESC, vec_id LIMIT 15)), w AS (SELECT label, greatest(pos - 1, lo) AS t0, least(pos + 1, hi) AS t1 FROM c JOIN e USING (label)),
  o AS (SELECT *, max(t1) OVER (PARTITION BY label ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM w), g AS (SELECT *, sum(CASE WHEN m IS NULL OR t0 > m THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY t0, t1) AS g FROM o),
  z AS (SELECT label, min(t0) AS t0, max(t1) AS t1 FROM g GROUP BY label, g.g), h AS (SELECT z.label, z.t0, z.t1, max(a) AS a, max(b) AS b FROM z JOIN p ON p.label = z.label AND p.pos BETWEEN z.t0 AND z.t1 GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (ORDER BY a DESC, label, t0) - 1 AS ra, CASE WHEN b IS NOT NULL THEN row_number() OVER (ORDER BY b DESC NULLS LAST, label, t0) - 1 ELSE greatest(0, (count(b) OVER () - 1) / 2) END AS rb FROM h)
  SELECT label, t0, t1, round(1 / (61 + ra) + 2.5 / (61 + rb), 9) AS rrf FROM r"""


@query(RECALL)
def verified_recall(spark, d):
    _checkpointed(spark)
    p = _scores(spark, d).select("vec_id", "label", "a", F.when(F.col("vec_id") % 5 > 0, F.col("b")).alias("b"), (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long").alias("pos"))
    return search.recalled(p, "label", "pos", {"a": 1.0, "b": 2.5}, "vec_id", 15, 1).select("label", "t0", "t1", F.round("rrf", 9).alias("rrf"))


@query(SPLIT.format(pre=f"WITH {SCORES},", rows="SELECT a AS v FROM s", anchor="") + " SELECT label, array_to_string(list_transform(list(a ORDER BY vec_id), lambda x: round(x, 3)::DECIMAL(9,3)), ',') AS scores, count(*) FILTER (a > cut) AS present FROM s, cut GROUP BY label")
def explain_lanes(spark, d):
    lane = search.lanes(_scores(spark, d), "label", "vec_id", "a")
    return lane.select("label", F.array_join(F.transform("scores", lambda x: F.round(x, 3).cast("decimal(9,3)").cast("string")), ",").alias("scores"), "present")


@query(f"""WITH {VECTORS}, e AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS word FROM vectors), p AS (SELECT *, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS p FROM e), m AS (SELECT label, word, ln(avg(p)) AS lp FROM p GROUP BY 1, 2)
  SELECT label, word::BIGINT AS word, round(lp, 6) AS lp FROM m QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(lp, 9) DESC, word) <= 5""")
def head_top_words(spark, d):
    """The likeliest words of each recording: logarithm of the mean probability."""
    z = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.exp(x))
    p = vectors(spark, d).select("label", F.posexplode(F.transform("v", lambda x: F.exp(x) / z)).alias("word", "p")).groupBy("label", "word").agg(F.round(F.log(F.avg("p")), 9).alias("lp"))
    w = Window.partitionBy("label").orderBy(F.desc("lp"), "word")
    return p.withColumn("n", F.row_number().over(w)).where("n <= 5").select("label", F.col("word").cast("long").alias("word"), F.round("lp", 6).alias("lp"))


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def last_wins(spark, d):
    return search.last_wins(load(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query(f"WITH {SCORES} SELECT vec_id, round(CASE WHEN max(a) OVER w > min(a) OVER w THEN (a - min(a) OVER w) / (max(a) OVER w - min(a) OVER w) ELSE 0 END, 6) AS bar FROM s WINDOW w AS (PARTITION BY label)")
def score_bars(spark, d):
    """Scores scaled to 0..1 inside each recording; the ends are joined on the key, so no window spans a recording."""
    s = _scores(spark, d)
    ends = s.groupBy("label").agg(F.min("a").alias("lo"), F.max("a").alias("hi"))
    return s.join(ends, "label").select("vec_id", F.round(F.when(F.col("hi") > F.col("lo"), (F.col("a") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0), 6).alias("bar"))


@query("SELECT o_orderkey FROM orders WHERE epoch_us(o_orderdate) >= (SELECT quantile_cont(epoch_us(o_orderdate), 0.7) FROM orders)")
def newest_share(spark, d):
    """The latest 30 per cent by time, as held-out rows."""
    o = load(spark, d, "orders").select("o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"))
    return o.join(F.broadcast(quantiles(o, "us", {"cut": 0.7}).select("cut")), F.col("us") >= F.col("cut")).select("o_orderkey")


@query("""WITH l AS (SELECT l_orderkey, list(l_quantity::DOUBLE ORDER BY l_linenumber, l_quantity)[:4] AS q FROM lineitem GROUP BY 1), f AS (SELECT l_orderkey, len(q) AS n, CASE len(q) WHEN 1 THEN q || [q[1], q[1], q[1]] WHEN 2 THEN q || [q[2], q[2]] WHEN 3 THEN q || [q[3]] ELSE q END AS q FROM l)
  SELECT l_orderkey, n::BIGINT AS n, q[1] AS q1, q[2] AS q2, q[3] AS q3, q[4] AS q4 FROM f""")
def padded_sequences(spark, d):
    """The first four values of each sequence, the last one repeated where there are fewer."""
    s = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("double").alias("q")))), lambda e: e["q"]), 1, 4).alias("q"))
    full = s.withColumn("full", F.slice(F.concat("q", F.array_repeat(F.element_at("q", -1), 3)), 1, 4))
    return full.select("l_orderkey", F.size("q").cast("long").alias("n"), *(F.element_at("full", i).alias(f"q{i}") for i in range(1, 5)))


@query(f"WITH {SCORES} SELECT vec_id, round(a, 6) AS a FROM s WHERE a > 0.1")
def sql_functions(spark, d):
    register(spark)
    vectors(spark, d).createOrReplaceTempView("stratalake_vectors")
    return spark.sql("SELECT x.vec_id, round(vec_cosine(x.v, q.v), 6) AS a FROM stratalake_vectors x CROSS JOIN (SELECT v FROM stratalake_vectors WHERE vec_id = 3) q WHERE vec_cosine(x.v, q.v) > 0.1")
