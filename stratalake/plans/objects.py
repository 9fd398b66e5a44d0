"""Queries of named objects: conversations are recordings, turns are steps of the words in them, benchmark items name objects."""

from __future__ import annotations

import pyspark.sql.functions as F

from stratalake.operators import objects
from stratalake.plans.base import Registry, load
from stratalake.plans.search import _checkpointed

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

_IN = lambda words: ", ".join(f"'{w}'" for w in words)
_BEST = "list_transform(list_sort(list((-mass, text))), lambda e: e[2])"


def _steps(spark, d):
    """A turn as the words in it (with the space before them) and their logarithmic shares, most frequent first."""
    said = load(spark, d, "conversations").where("text is not null").select(F.col("conv_id").alias("rec"), F.col("turn").cast("long").alias("pos"), F.explode(F.regexp_extract_all("text", F.lit("( ?[A-Za-z]+)"))).alias("id"))
    n = said.groupBy("rec", "pos", "id").agg(F.count(F.lit(1)).alias("n"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "id")))
    s = n.groupBy("rec", "pos").agg(listed.alias("e"), F.sum("n").alias("all"))
    lps = F.transform("e", lambda e: F.log(-e["n"] / F.col("all")))
    return s.select("rec", "pos", F.array_min(lps).alias("floor"), F.transform("e", lambda e: e["id"]).alias("ids"), lps.alias("lps"))


def _named(spark, d):
    """Of each item its first two words name an object, its third is an alias, and turn 1 of a conversation its example."""
    b = load(spark, d, "benchmark").select(F.col("item_id").alias("object"), F.regexp_extract_all("text", F.lit("([A-Za-z]+)")).alias("ws")).where("size(ws) >= 3")
    return b.select("object", F.concat_ws(" ", F.col("ws")[0], F.col("ws")[1]).alias("name"), F.lit(None).cast("string").alias("describe"), F.array(F.col("ws")[2]).alias("aliases"))


NAMED = rf"""c AS (SELECT conv_id AS rec, turn::BIGINT AS pos, id, count(*) AS n FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, ' ?[A-Za-z]+')) AS id FROM conversations) GROUP BY ALL),
  ls AS (SELECT rec, pos, id, ln(n / sum(n) OVER (PARTITION BY rec, pos)) AS lp, row_number() OVER (PARTITION BY rec, pos ORDER BY n DESC, id) AS k FROM c), st AS (SELECT rec, pos, min(lp) AS floor FROM ls GROUP BY ALL), vc AS (SELECT DISTINCT id FROM c),
  b AS (SELECT * FROM (SELECT item_id AS object, regexp_extract_all(text, '[A-Za-z]+') AS ws FROM benchmark) WHERE len(ws) >= 3),
  ph AS (SELECT object, 0 AS phrase, [lower(ws[1]), lower(ws[2])] AS a FROM b UNION ALL SELECT object, 1, [lower(ws[3])] FROM b), pk AS (SELECT *, list_filter(a, lambda w: NOT w IN ({_IN(objects.STOP)})) AS k FROM ph),
  wd AS (SELECT object, phrase, unnest(ws) AS w, generate_subscripts(ws, 1) AS word FROM (SELECT object, phrase, CASE WHEN len(k) > 0 THEN k ELSE a END AS ws FROM pk)),
  sp AS (SELECT object, phrase, word, unnest([w, ' ' || w, upper(w[1]) || w[2:], ' ' || upper(w[1]) || w[2:]]) AS s FROM wd), px AS (SELECT *, unnest(list_transform(range(1, len(s) + 1), lambda n: s[1:n])) AS id FROM sp),
  wa AS (SELECT DISTINCT object, phrase, word, id FROM (SELECT object, phrase, word, s, arg_max(id, length(id)) AS id FROM px JOIN vc USING (id) GROUP BY ALL)),
  ht AS (SELECT object, phrase, word, rec, pos, max(lp) AS lp FROM wa JOIN ls USING (id) GROUP BY ALL),
  dn AS (SELECT object, phrase, word, rec, pos, coalesce(lp, floor) AS s FROM (SELECT DISTINCT object, phrase, word FROM wa) CROSS JOIN st LEFT JOIN ht USING (object, phrase, word, rec, pos)),
  rl AS (SELECT *, s - avg(s) OVER (PARTITION BY object, phrase, word) AS r FROM dn), sc AS (SELECT object, rec, pos, round(max(r), 9) AS v FROM (SELECT object, phrase, rec, pos, avg(r) AS r FROM rl GROUP BY ALL) GROUP BY ALL)"""

#: The cut of each key's own values, from rows (key columns, v).
CUTS = """{p}r AS (SELECT {k}, min(v) AS lo, max(v) AS hi FROM {v} GROUP BY ALL HAVING max(v) - min(v) > 1e-5), {p}b AS (SELECT {k}, least(floor((v - lo) / (hi - lo) * 64), 63) AS bin, lo, (hi - lo) / 64 AS w, count(*) AS c FROM {v} JOIN {p}r USING ({k}) GROUP BY ALL),
  {p}t AS (SELECT {k}, lo + (bin + 0.5) * w AS mid, sum(c) OVER i AS w0, sum(c * (lo + (bin + 0.5) * w)) OVER i AS s0, sum(c) OVER (PARTITION BY {k}) AS wh, sum(c * (lo + (bin + 0.5) * w)) OVER (PARTITION BY {k}) AS sh FROM {p}b WINDOW i AS (PARTITION BY {k} ORDER BY bin)),
  {p}a AS (SELECT {k}, arg_max(mid, (round(w0 * (wh - w0) * (s0 / w0 - (sh - s0) / (wh - w0)) * (s0 / w0 - (sh - s0) / (wh - w0)), 6), -mid)) AS at_ FROM {p}t WHERE w0 < wh GROUP BY {k}),
  {p}g AS (SELECT {k}, avg(v) FILTER (v <= at_) AS ml, avg(v) FILTER (v > at_) AS mh, stddev_pop(v) FILTER (v <= at_) AS sl, stddev_pop(v) FILTER (v > at_) AS sh FROM {v} JOIN {p}a USING ({k}) GROUP BY {k}),
  {p}cut AS (SELECT {k}, (ml + mh) / 2 AS cut FROM {p}g WHERE mh - ml > sl + sh)"""

SEEN = f"""{NAMED}, {CUTS.format(p="n", k="object", v="sc")}, pr AS (SELECT object, rec, pos, v FROM sc JOIN ncut USING (object) WHERE v > cut),
  rn AS (SELECT *, pos - row_number() OVER (PARTITION BY object, rec ORDER BY pos) AS g FROM pr), nm AS (SELECT object, rec, min(pos) AS t0, max(pos) AS t1, max(v) AS score FROM rn GROUP BY object, rec, g),
  eq AS (SELECT object, rec AS er, id, exp(lp) AS p FROM (SELECT DISTINCT object FROM b) JOIN ls ON rec = object AND pos = 1),
  li AS (SELECT * FROM (SELECT object, rec, pos, round(sum(p * (lp - floor)), 9) AS v FROM eq JOIN ls USING (id) JOIN st USING (rec, pos) WHERE rec <> er OR pos <> 1 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY object ORDER BY v DESC, rec, pos) <= 10),
  {CUTS.format(p="e", k="object", v="li")}, ex AS (SELECT object, rec, pos AS t0, pos AS t1, v AS score FROM li JOIN ecut USING (object) WHERE v > cut AND ((object, rec, pos) IN (SELECT object, rec, pos FROM pr) OR object NOT IN (SELECT object FROM wa))),
  fd AS (SELECT *, 'name' AS found_by FROM nm UNION ALL SELECT *, 'example' FROM ex WHERE (object, rec, t0, t1) NOT IN (SELECT object, rec, t0, t1 FROM nm)),
  ow AS (SELECT DISTINCT object, unnest([w, w || 's', regexp_replace(w, 's$', '')]) AS text FROM (SELECT object, lower(trim(id)) AS w FROM wa)),
  ml AS (SELECT object, rec, t0, t1, id, sum(exp(lp)) AS mass, sum(exp(lp)) FILTER (pos = t1) AS tail FROM fd JOIN ls USING (rec) WHERE pos BETWEEN t0 AND t1 AND k <= {objects.LISTED} GROUP BY ALL),
  mt AS (SELECT object, rec, t0, t1, lower(trim(id)) AS text, round(max(mass), 9) AS mass, round(max(tail), 9) AS tail FROM ml WHERE (object, id) NOT IN (SELECT object, id FROM wa) AND length(trim(id)) >= {objects.LETTERS} AND lower(trim(id)) NOT IN ({_IN(objects.STOP + objects.COLOURS)}) AND (object, lower(trim(id))) NOT IN (SELECT object, text FROM ow) GROUP BY ALL),
  pc AS (SELECT object, rec, t0, t1, string_agg(text, ',' ORDER BY mass DESC, text) AS place FROM (SELECT * FROM mt QUALIFY row_number() OVER (PARTITION BY object, rec, t0, t1 ORDER BY mass DESC, text) <= {objects.PLACE}) GROUP BY ALL),
  pe AS (SELECT object, rec, t0, t1, string_agg(text, ',' ORDER BY tail DESC, text) AS end_place FROM (SELECT * FROM mt WHERE tail IS NOT NULL QUALIFY row_number() OVER (PARTITION BY object, rec, t0, t1 ORDER BY tail DESC, text) <= {objects.PLACE}) GROUP BY ALL),
  sg AS (SELECT object, rec, t0, t1, found_by, score, coalesce(place, '') AS place, coalesce(end_place, '') AS end_place FROM fd LEFT JOIN pc USING (object, rec, t0, t1) LEFT JOIN pe USING (object, rec, t0, t1))"""


@query(f"WITH {NAMED} SELECT object, phrase, word - 1 AS word, count(*) AS spellings, string_agg(id, '|' ORDER BY id) AS ids FROM wa GROUP BY ALL")
def object_words(spark, d):
    """The pieces that may stand for each word of each name and alias."""
    pieces = _steps(spark, d).select(F.explode("ids").alias("id")).distinct().withColumn("piece", F.col("id"))
    w = objects.name_words(_named(spark, d), pieces)
    return w.groupBy("object", "phrase", F.col("word").cast("long").alias("word")).agg(F.count(F.lit(1)).alias("spellings"), F.array_join(F.array_sort(F.collect_list("id")), "|").alias("ids"))


def _sightings(spark, d, placed=True):
    _checkpointed(spark)
    steps, named = _steps(spark, d).checkpoint(), _named(spark, d)
    pieces = steps.select(F.explode("ids").alias("id")).distinct().withColumn("piece", F.col("id"))
    words = objects.name_words(named, pieces).checkpoint()
    shown = named.select("object", F.lit(0).alias("example"), F.col("object").alias("rec"), F.lit(1).cast("long").alias("pos"))
    return objects.sightings(steps, words, pieces, objects.likeness(steps, shown), placed=placed)


@query(f"WITH {SEEN} SELECT object, rec, t0, t1, found_by, round(score, 6) AS score, place, end_place FROM sg")
def object_sightings(spark, d):
    """Where each object is seen, by name with all spellings and by example, and what is there with it."""
    s = _sightings(spark, d)
    return s.select("object", "rec", "t0", "t1", F.col("by").alias("found_by"), F.round("score", 6).alias("score"), F.array_join("place", ",").alias("place"), F.array_join("end_place", ",").alias("end_place"))


def _kept(named):
    """What was known before: a confirmed example, a sighting that may be gone, and a rejected one."""
    one = lambda rec, kind, confirmed, rejected: F.struct(rec.alias("rec"), F.lit(kind).alias("kind"), F.lit(confirmed).alias("confirmed"), F.lit(rejected).alias("rejected"))
    o = F.col("object")
    rows = named.select("object", F.explode(F.array(one(o, "example", True, False), one(o + 1, "found", False, False), one(o + 2, "found", False, True))).alias("e"))
    none = F.lit(None).cast("array<string>")
    return rows.select("object", "e.rec", F.lit(1).cast("long").alias("t0"), F.lit(1).cast("long").alias("t1"), "e.kind", F.lit("owner").alias("by"), F.lit(0.0).alias("score"), none.alias("place"), none.alias("end_place"), F.lit(True).alias("apart"), "e.confirmed", "e.rejected")


REFRESHED = f"""{SEEN}, kp AS (SELECT object, object + o AS rec, 1 AS t0, 1 AS t1, o FROM b, (SELECT unnest([0, 1, 2]) AS o)),
  rf AS (SELECT object, rec, t0, t1, CASE WHEN o = 0 THEN 'example' ELSE 'found' END AS kind, sg.score IS NOT NULL OR o = 0 AS apart, coalesce(o = 0, false) AS confirmed, coalesce(o = 2, false) AS rejected, coalesce(sg.score, 0) AS score FROM kp FULL JOIN sg USING (object, rec, t0, t1))"""


@query(f"WITH {REFRESHED} SELECT object, rec, t0, t1, kind, apart, confirmed, rejected, round(score, 6) AS score FROM rf")
def object_refresh(spark, d):
    """Sightings after another look: new ones, those found again, and those that stand apart no more."""
    s = objects.refreshed(_kept(_named(spark, d)), _sightings(spark, d, placed=False))
    return s.select("object", "rec", "t0", "t1", "kind", "apart", "confirmed", "rejected", F.round("score", 6).alias("score"))


@query(f"""WITH {REFRESHED}, sh AS (SELECT object, rec, t0, t1, score FROM rf a WHERE NOT rejected AND (confirmed OR (apart AND NOT EXISTS (SELECT 1 FROM rf z WHERE z.rejected AND z.object = a.object AND z.rec = a.rec AND a.t0 <= z.t1 AND z.t0 <= a.t1)))),
  mg AS (SELECT *, max(t1) OVER (PARTITION BY object, rec ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM sh), ig AS (SELECT *, sum(CASE WHEN m IS NULL OR t0 > m THEN 1 ELSE 0 END) OVER (PARTITION BY object, rec ORDER BY t0, t1) AS g FROM mg),
  tr AS (SELECT object, rec, min(t0) AS t0, max(t1) AS t1 FROM ig GROUP BY object, rec, g) SELECT object, count(*) AS sightings, max((rec, t1))[1] AS last_rec, max((rec, t1))[2] AS last_pos FROM tr GROUP BY 1""")
def object_last_known(spark, d):
    """How often each object is believed seen, and where last."""
    b = objects.believed(objects.refreshed(_kept(_named(spark, d)), _sightings(spark, d, placed=False)))
    return b.groupBy("object").agg(F.count(F.lit(1)).alias("sightings"), F.max(F.struct("rec", "t1")).alias("m")).select("object", "sightings", F.col("m.rec").alias("last_rec"), F.col("m.t1").alias("last_pos"))
