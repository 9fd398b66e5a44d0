"""Queries of phrases, directions, the verified and the sharp search."""

from __future__ import annotations

import uuid

import pyspark.sql.functions as F
from pyspark.sql import Window

from stratalake.operators import analytics, directions, search, sharp, text
from stratalake.plans.base import VECTORS, Registry, load, vectors
from stratalake.plans.retrieval import SCORES, _scores
from stratalake.plans.search import _checkpointed
from stratalake.sources.store import Store

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

_IN = lambda words: ", ".join(f"'{w}'" for w in words)


@query(rf"""WITH RECURSIVE t AS (SELECT row_number() OVER () AS id, conv_id, turn, regexp_extract_all(lower(text), '\w+|,|[^\w,]+') || ['.'] AS tk FROM conversations WHERE text IS NOT NULL),
  s AS (SELECT id, 1 AS i, []::VARCHAR[] AS o, []::VARCHAR[][] AS done FROM t UNION ALL
    SELECT s.id, i + 1, CASE WHEN len(o) = 0 AND NOT tk[i] IN ({_IN(text.ARTICLES)}) THEN o WHEN len(o) = 0 THEN [tk[i]] WHEN regexp_full_match(tk[i], '\s+') THEN o
        WHEN NOT regexp_matches(tk[i], '^\w') OR len(o) = 3 OR tk[i] IN ({_IN(text.ENDS)}) THEN []::VARCHAR[] ELSE o || [tk[i]] END,
      CASE WHEN len(o) = 0 OR regexp_full_match(tk[i], '\s+') THEN done WHEN NOT regexp_matches(tk[i], '^\w') THEN done || [o] WHEN len(o) = 3 OR tk[i] IN ({_IN(text.ENDS)}) THEN done || [o || [tk[i]]] ELSE done END
    FROM s JOIN t USING (id) WHERE i <= len(tk)),
  f AS (SELECT id, unnest(done) AS p, generate_subscripts(done, 1) AS k FROM s JOIN t USING (id) WHERE i = len(tk) + 1),
  b AS (SELECT id, k, p[1:coalesce(list_max(list_filter(range(1, len(p) + 1), lambda j: j > 1 AND NOT p[j] IN ({_IN(text.ENDS)}))), 0)] AS p FROM f),
  g AS (SELECT id, array_to_string(p, ' ') AS p, min(k) AS k FROM b WHERE len(p) > 1 AND NOT p[2] IN ({_IN(text.SCENE)}) GROUP BY ALL)
  SELECT conv_id, turn, coalesce(string_agg(p, '|' ORDER BY k), '') AS phrases FROM t LEFT JOIN g USING (id) GROUP BY t.id, conv_id, turn""")
def query_phrases(spark, d):
    """Every turn as a question: its phrases of an article and what it names."""
    c = load(spark, d, "conversations").where("text is not null")
    return c.select("conv_id", "turn", F.array_join(text.phrases(F.col("text")), "|").alias("phrases"))


#: Terms of documents with a vector: in at least 20 of them and at most half, their vector the mean of those.
LEAST, SHARE = 20, 0.5


def _term_vectors(spark, d):
    docs = load(spark, d, "documents").join(vectors(spark, d).select(F.col("vec_id").alias("doc_id"), "v"), "doc_id").where("text is not null")
    docs = docs.select("doc_id", "text", "v").checkpoint()  # read three times, and joined by text once
    terms = text.attested(docs, "text", LEAST, SHARE).select("term").checkpoint()
    return directions.term_means(docs, terms, "text", "v"), docs


PAIRS = f"""{VECTORS}, ed AS (SELECT doc_id, text, v, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '') AS ws FROM documents JOIN vectors ON doc_id = vec_id WHERE text IS NOT NULL),
  et AS (SELECT doc_id, v, unnest(list_distinct(ws)) AS term FROM ed), att AS (SELECT term FROM et GROUP BY 1 HAVING count(*) >= {LEAST} AND count(*) <= {SHARE} * (SELECT count(*) FROM ed)),
  ex AS (SELECT term, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM et JOIN att USING (term)), tm AS (SELECT term, i, avg(x) AS x FROM ex GROUP BY ALL), gm AS (SELECT i, avg(x) AS m FROM tm GROUP BY 1),
  tc AS (SELECT term, list(x - m ORDER BY i) AS v FROM tm JOIN gm USING (i) GROUP BY 1),
  op AS (SELECT a.term, min((round(list_cosine_similarity(a.v, b.v), 9), b.term)) AS o FROM tc a JOIN tc b ON a.term <> b.term GROUP BY 1),
  pr AS (SELECT least(term, o[2]) AS a, greatest(term, o[2]) AS b, min(o[1]) AS far FROM op WHERE o[1] <= -0.25 GROUP BY ALL),
  cx AS (SELECT DISTINCT ws[j] AS before, ws[j + 1] AS term FROM (SELECT ws, unnest(range(1, len(ws))) AS j FROM ed)),
  pairs AS (SELECT a, b, far, count(*) AS shared FROM pr JOIN cx x ON x.term = a JOIN cx y ON y.term = b AND y.before = x.before GROUP BY ALL HAVING count(*) >= 3)"""


def _pairs(spark, d):
    _checkpointed(spark)
    terms, docs = _term_vectors(spark, d)
    return directions.lexicon(terms.checkpoint(), docs, "text").checkpoint()


@query(f"WITH {PAIRS} SELECT a, b, round(far, 6) AS far, shared FROM pairs")
def directional_pairs(spark, d):
    """Words that the documents oppose to each other."""
    return _pairs(spark, d).select("a", "b", F.round("far", 6).alias("far"), "shared")


@query(f"""WITH {PAIRS}, q AS (SELECT doc_id, string_split(lower(text), ' ') AS ws FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, ws, unnest(ws) AS x, generate_subscripts(ws, 1) AS place FROM q),
  m AS (SELECT doc_id, ws, x, place, a, b, greatest(length(a), length(b)) AS size, CASE WHEN x = a THEN 0 ELSE 1 END AS way FROM w JOIN pairs ON x = a OR x = b),
  f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, a, b, way, place) = 1)
  SELECT doc_id, sha256(array_to_string(ws[1:place - 1] || [CASE WHEN way = 0 THEN b ELSE a END] || ws[place + 1:], ' ')) AS swap_sha256 FROM f""")
def directional_swaps(spark, d):
    """Every document as a question turned round."""
    docs = load(spark, d, "documents").where("text is not null")
    return directions.swapped(docs, "doc_id", "text", _pairs(spark, d)).select("doc_id", F.sha2("swap", 256).alias("swap_sha256"))


#: Recordings of 50 vectors of a label, in order; places are windows of three.
RECORDINGS = f"""{SCORES}, o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos FROM s JOIN (SELECT vec_id, v FROM vectors) USING (vec_id)), rc AS (SELECT *, pos // 50 AS rec FROM o), re AS (SELECT label, rec, min(pos) AS r0, max(pos) AS r1, count(*) AS n FROM rc GROUP BY ALL),
  rx AS (SELECT label, rec, r0, r1, pos - r0 < 6 AS head, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM rc JOIN re USING (label, rec) WHERE n >= 12 AND (pos - r0 < 6 OR r1 - pos < 6)), rm AS (SELECT label, r0, r1, i, avg(x) FILTER (NOT head) - avg(x) FILTER (head) AS x FROM rx GROUP BY ALL),
  rv AS (SELECT label, r0, r1, list(x ORDER BY i) AS v FROM rm GROUP BY ALL)"""


def _places(spark, d):
    s = _scores(spark, d).join(vectors(spark, d).select("vec_id", "v"), "vec_id")
    return s.withColumn("pos", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long")).withColumn("rec", F.floor(F.col("pos") / 50))


def _recordings(places):
    ends = places.groupBy("label", "rec").agg(F.min("pos").alias("r0"), F.max("pos").alias("r1"))
    return analytics.motion(places.select("label", "rec", "pos", "v"), ["label", "rec"], "pos", "v", 6).join(ends, ["label", "rec"]).select("label", "r0", "r1", F.col("v").alias("vec"))


@query(f"""WITH {RECORDINGS}, top AS (SELECT label, pos FROM o ORDER BY a DESC, vec_id LIMIT 120), c AS (SELECT list(x - y ORDER BY i) AS d FROM (SELECT generate_subscripts(v, 1) AS i, unnest(v) AS x FROM vectors WHERE vec_id = 3) JOIN (SELECT generate_subscripts(v, 1) AS i, unnest(v) AS y FROM vectors WHERE vec_id = 7) USING (i))
  SELECT label, r0, r1, round(list_cosine_similarity(v, d), 6) AS score FROM rv, c WHERE EXISTS (SELECT 1 FROM top WHERE top.label = rv.label AND pos BETWEEN r0 AND r1 AND pos + 2 <= r1 + 1) ORDER BY round(list_cosine_similarity(v, d), 9) DESC, label, r0 LIMIT 24""")
def motion_search(spark, d):
    """Of the recordings that hold plausible places, those that change most from the turned question to the question."""
    p = _places(spark, d)
    top = p.orderBy(F.desc("a"), "vec_id").limit(120).select("label", F.col("pos").alias("t0"), (F.col("pos") + 2).alias("t1"))
    asked = vectors(spark, d).where(F.col("vec_id").isin(3, 7)).agg(F.max_by("v", F.col("vec_id") == 3).alias("vec"), F.max_by("v", F.col("vec_id") == 7).alias("swap"))
    return directions.changing(top, _recordings(p), "label", asked, 24).select("label", "r0", "r1", F.round("score", 6).alias("score"))


BUDGET = f"greatest(greatest({search.PLACES}, least(greatest((SELECT count(*) FROM p) // {search.ROWS_A_PLACE}, {search.PLACES_BOUNDS[0]}), {search.PLACES_BOUNDS[1]})) // 2, {search.CLAUSE_PLACES})"


@query(f"""WITH {SCORES}, p AS (SELECT vec_id, label, a, b, CASE WHEN vec_id % 4 > 0 THEN a - b END AS w, CASE WHEN vec_id % 3 > 0 THEN b - a END AS dir, round((a + b) / 2, 9) AS mean, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos FROM s), e AS (SELECT label, min(pos) AS lo, max(pos) AS hi FROM p GROUP BY 1),
  k AS (SELECT label, pos, row_number() OVER (ORDER BY a DESC, vec_id) AS ka, row_number() OVER (ORDER BY b DESC, vec_id) AS kb, CASE WHEN w IS NOT NULL THEN row_number() OVER (ORDER BY w DESC NULLS LAST, vec_id) END AS kw FROM p),
  c AS (SELECT label, pos FROM k WHERE least(ka, kb, kw) <= {BUDGET}), v AS (SELECT label, greatest(pos - 2, lo) AS t0, least(pos + 2, hi) AS t1 FROM c JOIN e USING (label)),
  o AS (SELECT *, max(t1) OVER (PARTITION BY label ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM v), g AS (SELECT *, sum(CASE WHEN m IS NULL OR t0 > m THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY t0, t1) AS g FROM o),
  z AS (SELECT label, min(t0) AS t0, max(t1) AS t1 FROM g GROUP BY label, g.g), h AS (SELECT z.label, z.t0, z.t1, max(mean) AS mean, max(w) AS w, max(dir) AS dir FROM z JOIN p ON p.label = z.label AND p.pos BETWEEN z.t0 AND z.t1 GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (ORDER BY mean DESC, label, t0) - 1 AS rm, CASE WHEN w IS NOT NULL THEN row_number() OVER (ORDER BY w DESC NULLS LAST, label, t0) - 1 ELSE greatest(0, (count(w) OVER () - 1) / 2) END AS rw,
    CASE WHEN dir IS NOT NULL THEN row_number() OVER (ORDER BY dir DESC NULLS LAST, label, t0) - 1 ELSE greatest(0, (count(dir) OVER () - 1) / 2) END AS rd FROM h)
  SELECT label, t0, t1, round(mean, 6) AS mean, round(1 / (61 + rm) + 0.5 / (61 + rw) + {search.DIRECTION} / (61 + rd), 9) AS rrf FROM r ORDER BY round(1 / (61 + rm) + 0.5 / (61 + rw) + {search.DIRECTION} / (61 + rd), 9) DESC, label, t0 LIMIT 30""")
def verified_search(spark, d):
    """A question of two clauses and a direction: places by a budget that follows from the rows, ranked by clause means."""
    _checkpointed(spark)
    p = _places(spark, d).select("vec_id", "label", "pos", "a", "b", F.when(F.col("vec_id") % 4 > 0, F.col("a") - F.col("b")).alias("w"), F.when(F.col("vec_id") % 3 > 0, F.col("b") - F.col("a")).alias("dir"))
    found = search.verified(p, "label", "pos", ["a", "b"], {"w": 0.5}, "vec_id", 2, 30, "dir")
    return found.select("label", "t0", "t1", F.round("mean", 6).alias("mean"), F.round("rrf", 9).alias("rrf"))


@query(f"""WITH {VECTORS}, h AS (SELECT vec_id, v, v[1:len(v) // 2] AS r FROM vectors), m AS (SELECT a.vec_id AS key, b.vec_id AS match, list_cosine_similarity(a.r, b.r) AS rough, round(list_cosine_similarity(a.v, b.v), 9) AS score FROM h a JOIN h b ON a.vec_id % 100 = 0),
  s AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY key ORDER BY rough DESC, match) <= 150)
  SELECT key, match, round(score, 6) AS score, row_number() OVER (PARTITION BY key ORDER BY score DESC, match) AS rank FROM s QUALIFY rank <= 10""")
def sharp_search(spark, d):
    """Every row whose id 100 divides, against all rows: half of each vector makes the shortlist, the whole vectors, kept in
    a table once they are computed, rank it. Asked twice: the second time nothing is computed."""
    _checkpointed(spark)
    v = vectors(spark, d)
    rows = v.select("vec_id", F.slice("v", F.lit(1), F.floor(F.size("v") / 2).cast("int")).alias("r"))
    asked = v.where("vec_id % 100 = 0").select("vec_id", "v").join(rows, "vec_id")
    teach = lambda wanted: v.join(wanted.select("vec_id"), "vec_id", "left_semi").select("vec_id", F.col("v").alias("vec"))
    store = Store.create(spark, f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/sharp-{uuid.uuid4().hex}")
    ask = lambda: sharp.search(store, "known", rows, asked, "vec_id", "r", "v", teach, 10, 150)
    ask()
    found, fresh = ask()
    if fresh:
        raise RuntimeError(f"{fresh} rows were computed again")
    return found.select("key", "match", F.round("score", 6).alias("score"), "rank")
