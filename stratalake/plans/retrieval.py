"""Vector, text and sequence retrieval, corpus analytics, rank fusion."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Window

from stratalake.functions.scalar import cosine, dot, plain_name, unit
from stratalake.operators import cuts, ranking, sequence, text
from stratalake.operators import vectors as vec
from stratalake.plans.base import VECTORS, Registry, load, series, vectors
from stratalake.plans.relational import SPLIT

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
Q3 = "q AS (SELECT vec_id AS q, v AS qv FROM vectors WHERE vec_id IN (3, 7))"


def _with_query(spark, d, *ids):
    v = vectors(spark, d)
    q = v.where(F.col("vec_id").isin(*ids)).select(F.col("vec_id").alias("q"), F.col("v").alias("qv"))
    return v.join(F.broadcast(q), F.lit(True))  # a query of len(ids) rows


@query(f"WITH {VECTORS}, {Q3} SELECT q, vec_id, round(c, 6) AS c FROM (SELECT q, vec_id, list_cosine_similarity(v, qv) AS c, row_number() OVER (PARTITION BY q ORDER BY list_cosine_similarity(v, qv) DESC, vec_id) AS k FROM vectors, q) WHERE k <= 10")
def cosine_topk(spark, d):
    s = _with_query(spark, d, 3, 7).select("q", "vec_id", cosine(F.col("v"), F.col("qv")).alias("c"))
    return ranking.top_per(s, ["q"], "c", "vec_id", 10).select("q", "vec_id", F.round("c", 6).alias("c"))


@query(f"WITH {VECTORS}, n AS (SELECT a.vec_id, max(list_cosine_similarity(a.v, b.v)) AS best FROM vectors a, vectors b WHERE b.vec_id < a.vec_id GROUP BY 1) SELECT vec_id, round(best, 6) AS best FROM n")
def redundant_nearest_earlier(spark, d):
    v = vectors(spark, d)
    return vec.nearest(v, v, "vec_id", "v", 1, earlier_only=True).select(F.col("key").alias("vec_id"), F.round("cosine", 6).alias("best"))


@query(f"""WITH {VECTORS}, n AS (SELECT a.vec_id, list_sort(list(list_cosine_similarity(a.v, b.v)), 'DESC')[3] AS c FROM vectors a, vectors b WHERE a.label >= 5 AND b.label < 5 GROUP BY 1) SELECT vec_id, round(1 - c, 6) AS novelty FROM n""")
def novelty(spark, d):
    v = vectors(spark, d)
    return vec.nearest(v.where("label >= 5"), v.where("label < 5"), "vec_id", "v", 3).where("rank = 3").select(F.col("key").alias("vec_id"), F.round(1 - F.col("cosine"), 6).alias("novelty"))


NOVEL = SPLIT.format(pre=f"WITH {VECTORS}, n AS (SELECT a.vec_id, 1 - max(list_cosine_similarity(a.v, b.v)) AS far FROM vectors a, vectors b WHERE a.label >= 5 AND b.label < 5 GROUP BY 1),", rows="SELECT far AS v FROM n", anchor="{anchor}")


@query(NOVEL.format(anchor="AND least(abs(ml), abs(mh)) < mh - ml") + " SELECT vec_id FROM n, cut WHERE far >= cut")
def outliers(spark, d):
    v = vectors(spark, d)
    n = vec.nearest(v.where("label >= 5"), v.where("label < 5"), "vec_id", "v", 1).select(F.col("key").alias("vec_id"), (1 - F.col("cosine")).alias("far"))
    return n.join(F.broadcast(cuts.split(n, "far", 0.0)), F.col("far") >= F.col("cut")).select("vec_id")


@query(f"WITH {VECTORS}, p AS (SELECT a.vec_id, min(1 - list_cosine_similarity(a.v, b.v)) AS far FROM vectors a, vectors b WHERE b.vec_id < 5 GROUP BY 1) SELECT round(max(far), 6) AS radius FROM p")
def cover_radius(spark, d):
    v = vectors(spark, d)
    return vec.nearest(v, v.where("vec_id < 5"), "vec_id", "v", 1).agg(F.round(F.max(1 - F.col("cosine")), 6).alias("radius"))


@query()
def cover_greedy(spark, d):
    return vec.farthest_points(vectors(spark, d), "vec_id", "v", 5)


@query(f"""WITH {VECTORS}, u AS (SELECT label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM vectors WHERE label IN (1, 2)), e AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM u), m AS (SELECT label, i, avg(x) AS m FROM e GROUP BY 1, 2) SELECT round(sqrt(sum((a.m - b.m) * (a.m - b.m))), 6) AS apart FROM m a JOIN m b ON a.i = b.i AND a.label = 1 AND b.label = 2""")
def apart_distance(spark, d):
    """Distance of the means of two groups of unit vectors."""
    m = vec.mean_vector(vectors(spark, d).where("label in (1, 2)").withColumn("v", unit(F.col("v"))), ["label"], "v")
    pair = m.where("label = 1").select(F.col("v").alias("a")).join(m.where("label = 2").select(F.col("v").alias("b")), F.lit(True))
    gap = F.zip_with("a", "b", lambda x, y: x - y)
    return pair.select(F.round(F.sqrt(dot(gap, gap)), 6).alias("apart"))


@query(f"""WITH {VECTORS}, e AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vectors), m AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM e GROUP BY 1, 2) SELECT label, max(n) AS n, round(sqrt(sum(m * m)), 6) AS length, round(max(m) FILTER (i = 1), 6) AS head FROM m GROUP BY 1""")
def pool_mean_vectors(spark, d):
    m = vec.mean_vector(vectors(spark, d), ["label"], "v")
    return m.select("label", "n", F.round(F.sqrt(dot(F.col("v"), F.col("v"))), 6).alias("length"), F.round(F.col("v")[0], 6).alias("head"))


@query(f"""WITH {VECTORS}, e AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vectors), m AS (SELECT label, i, avg(x) AS m FROM e GROUP BY 1, 2), c AS (SELECT vec_id, i, x - m AS x FROM e JOIN m USING (label, i)), n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM c GROUP BY 1)
  SELECT vec_id, round(x / n, 6) AS head FROM c JOIN n USING (vec_id) WHERE i = 1""")
def centre_by_recording(spark, d):
    return vec.centred(vectors(spark, d), ["label"], "v").select("vec_id", F.round(F.col("v")[0], 6).alias("head"))


@query(f"""WITH {VECTORS}, s AS (SELECT vec_id, label, max(list_cosine_similarity(v, qv)) FILTER (q = 3) AS a, max(list_cosine_similarity(v, qv)) FILTER (q = 7) AS b, max(list_cosine_similarity(v, qv)) FILTER (q = 11) AS neg FROM vectors, (SELECT vec_id AS q, v AS qv FROM vectors WHERE vec_id IN (3, 7, 11)) GROUP BY 1, 2)
  SELECT vec_id, round(least(a, b) - 0.5 * neg, 6) AS score FROM s""")
def compositional_score(spark, d):
    """The weakest wanted clause less half the unwanted one; three query vectors are broadcast."""
    q = vectors(spark, d).where(F.col("vec_id").isin(3, 7, 11)).agg(*(F.max_by("v", F.when(F.col("vec_id") == k, 1)).alias(f"q{k}") for k in (3, 7, 11)))
    s = vectors(spark, d).join(F.broadcast(q), F.lit(True))
    c = {k: cosine(F.col("v"), F.col(f"q{k}")) for k in (3, 7, 11)}
    return s.select("vec_id", F.round(F.least(c[3], c[7]) - 0.5 * c[11], 6).alias("score"))


SCORES = f"{VECTORS}, s AS (SELECT vec_id, label, list_cosine_similarity(v, (SELECT v FROM vectors WHERE vec_id = 3)) AS a, list_cosine_similarity(v, (SELECT v FROM vectors WHERE vec_id = 7)) AS b FROM vectors)"


def _scores(spark, d):
    q = vectors(spark, d).where(F.col("vec_id").isin(3, 7)).agg(*(F.max_by("v", F.when(F.col("vec_id") == k, 1)).alias(f"q{k}") for k in (3, 7)))
    return vectors(spark, d).join(F.broadcast(q), F.lit(True)).select("vec_id", "label", cosine(F.col("v"), F.col("q3")).alias("a"), cosine(F.col("v"), F.col("q7")).alias("b"))


@query(f"WITH {SCORES}, m AS (SELECT avg(a) ma, stddev_pop(a) sa, avg(b) mb, stddev_pop(b) sb FROM s) SELECT vec_id, round(0.7 * (a - ma) / (sa + 1e-8) + 0.3 * (b - mb) / (sb + 1e-8), 5) AS z FROM s, m")
def zscore_blend(spark, d):
    s = _scores(spark, d)
    m = s.agg(F.avg("a").alias("ma"), F.stddev_pop("a").alias("sa"), F.avg("b").alias("mb"), F.stddev_pop("b").alias("sb"))
    return s.join(F.broadcast(m), F.lit(True)).select("vec_id", F.round(0.7 * (F.col("a") - F.col("ma")) / (F.col("sa") + 1e-8) + 0.3 * (F.col("b") - F.col("mb")) / (F.col("sb") + 1e-8), 5).alias("z"))


RRF = f"""WITH {SCORES}, t AS (SELECT vec_id, a, CASE WHEN vec_id % 3 <> 0 THEN b END AS b FROM s), r AS (SELECT vec_id, row_number() OVER (ORDER BY a DESC, vec_id) - 1 AS ra,
  CASE WHEN b IS NOT NULL THEN row_number() OVER (ORDER BY b DESC NULLS LAST, vec_id) - 1 ELSE (count(b) OVER () - 1) / 2 END AS rb FROM t)"""


@query(f"{RRF} SELECT vec_id, round(1 / (61 + ra) + 0.5 / (61 + rb), 9) AS rrf FROM r ORDER BY 1 / (61 + ra) + 0.5 / (61 + rb) DESC, vec_id LIMIT 40")
def rrf_fusion(spark, d):
    """Fusion of two rankings over a candidate list, the second one abstaining on a third of it."""
    s = _scores(spark, d).withColumn("b", F.when(F.col("vec_id") % 3 != 0, F.col("b")))
    return ranking.fuse(s, {"a": 1.0, "b": 0.5}, "vec_id").orderBy(F.desc("rrf"), "vec_id").limit(40).select("vec_id", F.round("rrf", 9).alias("rrf"))


@query(f"WITH {SCORES}, t AS (SELECT vec_id, (a + b) / 2 AS mean, least(a, b) AS low FROM s) SELECT vec_id, round(-(row_number() OVER (ORDER BY mean DESC, vec_id) + row_number() OVER (ORDER BY low DESC, vec_id) - 2) + 0.001 * mean, 6) AS fused FROM t")
def rank_fusion(spark, d):
    t = _scores(spark, d).select("vec_id", ((F.col("a") + F.col("b")) / 2).alias("mean"), F.least("a", "b").alias("low"))
    t = ranking.ranks(ranking.ranks(t, "mean", "vec_id", "r1"), "low", "vec_id", "r2")
    return t.select("vec_id", F.round(-(F.col("r1") + F.col("r2")) + 0.001 * F.col("mean"), 6).alias("fused"))


@query(f"WITH {SCORES} SELECT vec_id, round(greatest(a, CASE WHEN vec_id % 2 = 0 THEN b END), 6) AS best FROM s")
def variant_max(spark, d):
    return _scores(spark, d).select("vec_id", F.round(F.greatest("a", F.when(F.col("vec_id") % 2 == 0, F.col("b"))), 6).alias("best"))


@query(f"WITH {SCORES}, t AS (SELECT label, a, row_number() OVER (PARTITION BY label ORDER BY a DESC, vec_id) AS k FROM s) SELECT label, round(avg(a), 6) AS top5 FROM t WHERE k <= 5 GROUP BY 1")
def top5_mean(spark, d):
    return ranking.top_per(_scores(spark, d), ["label"], "a", "vec_id", 5).groupBy("label").agg(F.round(F.avg("a"), 6).alias("top5"))


@query(f"WITH {SCORES} SELECT label, round(least(max(a), max(b)), 6) AS both FROM s GROUP BY 1")
def conjunction_min_max(spark, d):
    return _scores(spark, d).groupBy("label").agg(F.round(F.least(F.max("a"), F.max("b")), 6).alias("both"))


@query(f"""WITH {SCORES}, c AS (SELECT label, arg_max(vec_id, (a, -vec_id)) AS i, arg_max(vec_id, (b, -vec_id)) AS j, max(a) AS ma, max(b) AS mb FROM s GROUP BY 1) SELECT label, round(CASE WHEN i = j THEN 0 ELSE ma * greatest(mb, 0) END, 6) AS bound FROM c""")
def role_binding(spark, d):
    best = lambda c: F.max_by("vec_id", F.struct(c, -F.col("vec_id")))
    g = _scores(spark, d).groupBy("label").agg(best("a").alias("i"), best("b").alias("j"), F.max("a").alias("ma"), F.max("b").alias("mb"))
    return g.select("label", F.round(F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.col("ma") * F.greatest("mb", F.lit(0.0))), 6).alias("bound"))


@query(f"""WITH {VECTORS}, e AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vectors), m AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM e GROUP BY 1, 2) GROUP BY 1), q AS (SELECT v AS qv FROM vectors WHERE vec_id = 3),
  p AS (SELECT label FROM m, q ORDER BY list_cosine_similarity(c, qv) DESC, label LIMIT 3), h AS (SELECT vec_id, list_cosine_similarity(v, qv) AS s FROM vectors, q WHERE label IN (SELECT label FROM p)) SELECT vec_id, round(s, 6) AS s FROM h ORDER BY h.s DESC, vec_id LIMIT 10""")
def ivf_probe(spark, d):
    """Cells nearest to the query first, then exact scores within those cells alone."""
    v = vectors(spark, d)
    q = v.where("vec_id = 3").select(F.col("v").alias("qv"))
    cells = vec.mean_vector(v, ["label"], "v").join(F.broadcast(q), F.lit(True)).orderBy(F.desc(cosine(F.col("v"), F.col("qv"))), "label").limit(3).select("label")
    hits = v.join(F.broadcast(cells), "label", "left_semi").join(F.broadcast(q), F.lit(True)).select("vec_id", cosine(F.col("v"), F.col("qv")).alias("s"))
    return hits.orderBy(F.desc("s"), "vec_id").limit(10).select("vec_id", F.round("s", 6).alias("s"))


@query()
def pq_rerank(spark, d):
    """Product quantisation: 8 codebooks of 16 learnt on a bounded sample, table look-ups over all codes, exact scores
    for the best 4k."""
    from stratalake.operators.quantised import search

    v = vectors(spark, d)
    return search(v, "vec_id", "v", v.where("vec_id = 3").first()["v"], 10)


WORDS = "string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')"


@query(f"WITH t AS (SELECT doc_id, unnest(list_distinct({WORDS})) AS term FROM documents) SELECT term, count(*) AS df FROM t WHERE term <> '' GROUP BY 1 HAVING count(*) >= 5 AND count(*) <= 0.2 * (SELECT count(*) FROM documents)")
def vocab_attested(spark, d):
    return text.attested(load(spark, d, "documents"), "text", 5, 0.2)


def _tfidf(source: str, terms: str, wanted: str) -> str:
    return f"""WITH w AS (SELECT doc_id, unnest({terms}) AS term FROM {source}), tf AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term <> '' GROUP BY 1, 2), i AS (SELECT term, ln((1.0 + (SELECT count(*) FROM {source})) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1),
  v AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN i USING (term)), n AS (SELECT doc_id, sqrt(sum(w * w)) AS len FROM v GROUP BY 1), q AS (SELECT term, (1 + ln(count(*))) * any_value(idf) AS qw FROM (SELECT unnest({wanted}) AS term) JOIN i USING (term) GROUP BY 1),
  h AS (SELECT doc_id, sum(w * qw) AS dot FROM v JOIN q USING (term) GROUP BY 1) SELECT doc_id, round(dot / (len * (SELECT sqrt(sum(qw * qw)) FROM q)), 6) AS score FROM h JOIN n USING (doc_id)"""


@query(_tfidf("documents", WORDS, "['the', 'of', 'license', 'public']"))
def tfidf_search(spark, d):
    s = text.tfidf_search(load(spark, d, "documents"), "doc_id", text.words(F.col("text")), ["the", "of", "license", "public"])
    return s.select("doc_id", F.round("score", 6).alias("score"))


PADDED = f"list_transform({WORDS.replace('text', 'source')}, lambda w: ' ' || w || ' ')"
GRAMS = f"flatten(list_transform([3, 4, 5], lambda n: flatten(list_transform({PADDED}, lambda w: CASE WHEN len(w) >= n THEN list_transform(range(1, len(w) - n + 2), lambda i: substr(w, i, n)) ELSE [] END))))"


@query(_tfidf("documents", GRAMS, "[' sr', 'src', 'rc1', 'c12', '12 ']"))
def chargram_search(spark, d):
    s = text.tfidf_search(load(spark, d, "documents"), "doc_id", text.char_grams(F.col("source")), [" sr", "src", "rc1", "c12", "12 "])
    return s.select("doc_id", F.round("score", 6).alias("score"))


STEM = "CASE WHEN len(w) > 4 THEN regexp_replace(w, '(ing|ed|es|s)$', '') ELSE w END"


@query(f"""WITH s AS (SELECT conv_id, turn, 3.0 * len(list_filter(list_transform({WORDS.replace('text', 'role')}, lambda w: {STEM}), lambda w: w IN ('the', 'user', 'th'))) + len(list_filter(list_transform({WORDS}, lambda w: {STEM}), lambda w: w IN ('the', 'user', 'th'))) AS score FROM conversations)
  SELECT conv_id, turn, score::DOUBLE AS score FROM s WHERE score > 0""")
def recall_text(spark, d):
    return text.recall(load(spark, d, "conversations"), {"role": 3.0, "text": 1.0}, "the users thing").select("conv_id", "turn", "score")


@query("""WITH q AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '-' || event_type ELSE event_type || ' -old AND user ' || user_id || '; - ' || event_type || ' page NOT a -x phone NOT ' || user_id || ' AND tail' END AS q FROM events),
  s AS (SELECT event_id, q, regexp_split_to_array(q, '\\bNOT\\b') AS s FROM q), t AS (SELECT event_id, q, s, list_transform(regexp_split_to_array(s[1], '\\bAND\\b|;'), lambda x: list_filter(regexp_split_to_array(trim(x), '\\s+'), lambda w: w <> '')) AS t FROM s),
  w AS (SELECT *, list_filter(list_transform(t, lambda ws: array_to_string(list_filter(ws, lambda w: NOT regexp_matches(w, '^-.')), ' ')), lambda x: x <> '') AS w FROM t)
  SELECT event_id, CASE WHEN len(w) > 0 THEN array_to_string(w, '|') ELSE q END AS wanted, array_to_string(list_concat(list_filter(list_transform(s[2:], lambda x: trim(x)), lambda x: x <> ''), list_transform(list_filter(flatten(t), lambda w: regexp_matches(w, '^-.')), lambda w: w[2:])), '|') AS unwanted FROM w""")
def parse_query(spark, d):
    e = load(spark, d, "events")
    long = F.concat("event_type", F.lit(" -old AND user "), F.col("user_id").cast("string"), F.lit("; - "), "event_type", F.lit(" page NOT a -x phone NOT "), F.col("user_id").cast("string"), F.lit(" AND tail"))
    q = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("-"), "event_type")).otherwise(long)
    p = e.select("event_id", text.parsed(q).alias("p"))
    return p.select("event_id", F.array_join("p.wanted", "|").alias("wanted"), F.array_join("p.unwanted", "|").alias("unwanted"))


@query("""WITH n AS (SELECT p_partkey, trim(regexp_replace(lower('The ' || p_name || '''s!'), '[^a-z0-9 ]', ' ', 'g')) AS x FROM part) SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(x, ' +', ' ', 'g'), '^(the|a|an|my) ', ''), '([^s])s$', '\\1') AS name FROM n""")
def plain_names(spark, d):
    return load(spark, d, "part").select("p_partkey", plain_name(F.concat(F.lit("The "), "p_name", F.lit("'s!"))).alias("name"))


STEPS = f"""{VECTORS}, z AS (SELECT label AS rec, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, v, ln(list_sum(list_transform(v, lambda x: exp(x)))) AS z FROM vectors), u AS (SELECT rec, pos, unnest(v) - z AS lp, generate_subscripts(v, 1) - 1 AS word FROM z),
  k AS (SELECT *, row_number() OVER (PARTITION BY rec, pos ORDER BY lp DESC, word) AS k FROM u), listed AS (SELECT * FROM k WHERE k <= 24), fl AS (SELECT rec, pos, min(lp) AS fl FROM listed GROUP BY 1, 2), voc AS (SELECT DISTINCT word FROM listed WHERE k <= 4)"""


@query(f"WITH {STEPS} SELECT fl.rec, fl.pos, voc.word::BIGINT AS word, round(coalesce(lp, fl), 6) AS lp FROM fl CROSS JOIN voc LEFT JOIN listed ON listed.rec = fl.rec AND listed.pos = fl.pos AND listed.word = voc.word")
def head_dense(spark, d):
    """Dense rows over the shared vocabulary, a missing word at its step's floor (the vocabulary is bounded by the model's)."""
    s = sequence.steps_from_vectors(vectors(spark, d))
    voc = sequence.vocabulary(s, 4)
    long = sequence.excess(s, voc).select("rec", "pos", "word", "delta")
    return s.select("rec", "pos", "floor").join(F.broadcast(voc), F.lit(True)).join(long, ["rec", "pos", "word"], "left").select("rec", "pos", F.col("word").cast("long").alias("word"), F.round(F.col("floor") + F.coalesce("delta", F.lit(0.0)), 6).alias("lp"))


@query(f"""WITH {STEPS}, dn AS (SELECT fl.rec, fl.pos, voc.word, coalesce(lp, fl) AS lp FROM fl CROSS JOIN voc LEFT JOIN listed ON listed.rec = fl.rec AND listed.pos = fl.pos AND listed.word = voc.word), m AS (SELECT word, avg(lp) AS m FROM dn GROUP BY 1),
  a AS (SELECT pos AS a, word, exp(lp) / sum(exp(lp)) OVER (PARTITION BY pos) AS q FROM dn WHERE rec = 2 AND pos BETWEEN 3 AND 5) SELECT a, rec, pos, round(sum(q * (lp - m)), 6) AS s FROM dn JOIN m USING (word) JOIN a USING (word) GROUP BY 1, 2, 3""")
def head_similarity(spark, d):
    s = sequence.steps_from_vectors(vectors(spark, d))
    return sequence.similarity(s, s.where("rec = 2 and pos between 3 and 5"), sequence.vocabulary(s, 4)).select("a", "rec", "pos", F.round("s", 6).alias("s"))


@query()
def example_search(spark, d):
    s = sequence.steps_from_vectors(vectors(spark, d))
    own = spark.createDataFrame([(2, 3, 5)], "rec long, x0 long, x1 long")
    return sequence.find(s, s.where("rec = 2 and pos between 3 and 5"), 20, exclude=own)


@query(f"""WITH {SCORES}, p AS (SELECT vec_id AS node, label, a, b, lag(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM s) SELECT y.node AS end_node, round((x.a + y.b) / 2, 6) AS score FROM p y JOIN p x ON x.node = y.before""")
def clause_chain(spark, d):
    s = _scores(spark, d)
    clauses = s.select(F.lit(0).alias("clause"), F.col("vec_id").alias("node"), F.col("a").alias("score")).union(s.select(F.lit(1), "vec_id", "b"))
    follows = s.select(F.lag("vec_id").over(Window.partitionBy("label").orderBy("vec_id")).alias("before"), F.col("vec_id").alias("node")).where("before is not null")
    return sequence.chain(clauses, follows, 2).select(F.col("end").alias("end_node"), F.round("score", 6).alias("score"))


@query(f"""WITH {STEPS}, sc AS (SELECT fl.rec, fl.pos, max(coalesce(lp, fl)) AS s FROM fl CROSS JOIN (SELECT unnest([3, 9, 17]) AS word) w LEFT JOIN listed ON listed.rec = fl.rec AND listed.pos = fl.pos AND listed.word = w.word GROUP BY 1, 2) SELECT rec, pos, round(s - avg(s) OVER (), 6) AS s FROM sc""")
def name_scores(spark, d):
    """Best spelling of a name in each step (its floor where absent), less the set's mean."""
    s = sequence.steps_from_vectors(vectors(spark, d))
    hit = F.array_max(F.transform(F.filter(F.arrays_zip("ids", "lps"), lambda e: e["ids"].isin(3, 9, 17)), lambda e: e["lps"]))
    scored = s.select("rec", "pos", F.coalesce(hit, F.col("floor")).alias("s"))
    return scored.join(F.broadcast(scored.agg(F.avg("s").alias("m"))), F.lit(True)).select("rec", "pos", F.round(F.col("s") - F.col("m"), 6).alias("s"))


@query(f"WITH {STEPS} SELECT rec, word::BIGINT AS word, round(mass, 6) AS mass FROM (SELECT rec, word, sum(exp(lp)) AS mass, row_number() OVER (PARTITION BY rec ORDER BY sum(exp(lp)) DESC, word) AS n FROM listed WHERE word NOT IN (0, 1) GROUP BY 1, 2) WHERE n <= 3")
def place_words(spark, d):
    s = sequence.steps_from_vectors(vectors(spark, d)).select("rec", F.explode(F.arrays_zip("ids", "lps")).alias("e")).where(~F.col("e.ids").isin(0, 1))
    mass = s.groupBy("rec", F.col("e.ids").cast("long").alias("word")).agg(F.sum(F.exp("e.lps")).alias("mass"))
    return ranking.top_per(mass, ["rec"], "mass", "word", 3).select("rec", "word", F.round("mass", 6).alias("mass"))


@query("""WITH e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k, user_id % 3 = 0 AS good FROM events) SELECT event_type, (max(CASE WHEN k = 1 THEN good::INT END))::DOUBLE AS p1, round(avg(good::INT) FILTER (k <= 20), 6) AS p20,
  round((sum(good::INT) FILTER (k <= 20))::DOUBLE / sum(good::INT), 6) AS recall20 FROM e GROUP BY 1""")
def eval_metrics(spark, d):
    e = series(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id"))).withColumn("good", (F.col("user_id") % 3 == 0).cast("int"))
    top = F.when(F.col("k") <= 20, F.col("good"))
    return e.groupBy("event_type").agg(F.max(F.when(F.col("k") == 1, F.col("good"))).cast("double").alias("p1"), F.round(F.avg(top), 6).alias("p20"), F.round(F.sum(top) / F.sum("good"), 6).alias("recall20"))


@query("SELECT conv_id, turn, role, length(text) AS chars, turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS step FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2")
def message_page(spark, d):
    w = Window.partitionBy("conv_id")
    m = load(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"), (F.col("turn") - F.lag("turn").over(w.orderBy("turn"))).alias("step"), F.row_number().over(w.orderBy(F.desc("turn"))).alias("k"))
    return m.where("k <= 2").drop("k")


@query("SELECT c_mktsegment AS segment, count(*) AS customers, sum(n)::BIGINT AS orders, min(lo) AS first_order FROM customer JOIN (SELECT o_custkey, count(*) AS n, min(o_orderkey) AS lo FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1")
def context_summary(spark, d):
    c, o = load(spark, d, "customer", "orders")
    per = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("lo"))
    return c.join(per, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("customers"), F.sum("n").alias("orders"), F.min("lo").alias("first_order"))


@query(r"""WITH q AS (SELECT conv_id, turn, regexp_replace(trim(text), '\s+', ' ', 'g') AS q FROM conversations WHERE text IS NOT NULL), p AS (SELECT *, list_transform(regexp_split_to_array(q, ',|\b(?:and then|then|and|AND)\b'), lambda x: trim(x)) AS p FROM q)
  SELECT conv_id, turn, array_to_string([q] || list_filter(p, lambda x: contains(x, ' ') AND lower(x) <> lower(q)), '|') AS clauses FROM p""")
def query_clauses(spark, d):
    """Every turn as a question: itself and its clauses."""
    c = load(spark, d, "conversations").where("text is not null")
    return c.select("conv_id", "turn", F.array_join(text.clauses(F.col("text")), "|").alias("clauses"))
