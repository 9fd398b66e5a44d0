"""Searches put together from vectors, sequences, cuts and ranks."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from stratalake.functions.quantiles import quantiles
from stratalake.functions.scalar import unit
from stratalake.operators import cuts, islands, lsa, ranking, sequence, text
from stratalake.operators.vectors import nearest


def cut_beyond(judged: DataFrame, base: DataFrame) -> DataFrame:
    """One row, `cut`, between near and far, read off both populations of distances (column far) together."""
    return cuts.split(judged.select("far").unionByName(base.select("far")), "far", 0.0)


def neighbour_distances(df: DataFrame, key: str, vector: str, k: int = 1) -> DataFrame:
    """far: the distance of each row to its k-th nearest other row."""
    return nearest(df, df, key, vector, k + 1).where(F.col("rank") == k + 1).select((1 - F.col("cosine")).alias("far"))


def uncovered(reference: DataFrame, run: DataFrame, key: str, vector: str, k: int = 1) -> DataFrame:
    """key, far: reference rows with no partner in the run, where a partner is as near as the run's rows are to each
    other. No cut, no rows."""
    far = nearest(reference, run, key, vector, k).where(F.col("rank") == k).select("key", (1 - F.col("cosine")).alias("far")).checkpoint()
    cut = cut_beyond(far, neighbour_distances(run, key, vector, k))
    return far.join(F.broadcast(cut), F.col("far") >= F.col("cut")).select("key", "far")


def spend(df: DataFrame, held: DataFrame, key: str, vector: str, budget: int) -> DataFrame:
    """key, gain, pick: at most `budget` rows worth adding to those held, farthest first; they stop where the gain falls
    back to what the held rows call the same. A round is one pass that keeps every row's distance to all picked."""
    far = nearest(df, held, key, vector, 1).select("key", F.greatest(1 - F.col("cosine"), F.lit(0.0)).alias("far"))
    rows = df.select(F.col(key).alias("key"), unit(F.col(vector)).alias("vec")).join(far, "key", "left").fillna(float("inf"), ["far"]).checkpoint()
    picked: list = []
    while len(picked) < budget:
        best = rows.agg(F.max_by(F.struct("key", "vec", "far"), F.struct(F.round("far", 9), -F.col("key"))).alias("b")).first()["b"]
        if best is None:
            break
        picked.append((best["key"], float(best["far"]), len(picked)))
        v = F.array(*map(F.lit, best["vec"]))
        d = 1 - F.aggregate(F.zip_with("vec", v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        rows = rows.where(F.col("key") != best["key"]).withColumn("far", F.least(F.col("far"), F.greatest(d, F.lit(0.0))))
        if len(picked) % 8 == 0:
            rows = rows.checkpoint()
    out = df.sparkSession.createDataFrame(picked, "key long, gain double, pick int")
    if held.isEmpty():
        return out
    cut = cut_beyond(out.select(F.col("gain").alias("far")), neighbour_distances(held, key, vector))
    return out.join(F.broadcast(cut), F.lit(True)).where("cut is null or gain >= cut").drop("cut")


def plain_scores(scores: DataFrame, spans: DataFrame) -> DataFrame:
    """rec, begin, end, score: end-to-end alignment of the anchor (scores: a, rec, pos, s) with each span."""
    return sequence.whole(scores, spans).withColumnRenamed("s", "score")


def contrasted(steps: DataFrame, rec: int, begin: int, end: int, spans: DataFrame, union_k: int = 24) -> DataFrame:
    """rec, begin, end, score: likeness to the anchor span, less the mean likeness to the spans just before and after it,
    if each of these is no more like the anchor than the median span is."""
    vocab = sequence.vocabulary(steps, union_k)
    scored = lambda a, b: sequence.similarity(steps, steps.where((F.col("rec") == rec) & F.col("pos").between(a, b)), vocab)
    last = steps.where(F.col("rec") == rec).agg(F.max("pos")).first()[0]
    size = end - begin + 1
    sides = [(a, b) for a, b in ((max(0, begin - size), begin - 1), (end + 1, min(last, end + size))) if a <= b]
    own = scored(begin, end)
    mine = plain_scores(own, spans).checkpoint()
    if not sides:
        return mine
    near = plain_scores(own, steps.sparkSession.createDataFrame([(rec, a, b) for a, b in sides], "rec long, begin long, end long"))
    gate = quantiles(mine, "score", {"mid": 0.5}).join(near.agg(F.max("score").alias("near")), F.lit(True)).select((F.col("near") <= F.col("mid")).alias("open"))
    out = mine.withColumn("less", F.lit(0.0))
    for a, b in sides:
        s = plain_scores(scored(a, b), spans).withColumnRenamed("score", "side")
        out = out.join(s, ["rec", "begin", "end"]).withColumn("less", F.col("less") + F.col("side") / len(sides)).drop("side")
    return out.join(F.broadcast(gate), F.lit(True)).select("rec", "begin", "end", F.when(F.col("open"), F.col("score") - F.col("less")).otherwise(F.col("score")).alias("score"))


def chain_paths(scores: DataFrame, follows: DataFrame, inside: DataFrame, relations: list[str], by: str) -> DataFrame:
    """node, path, fits, score: the best chain of clauses for each end node.

    scores: clause (from 0), node, score; follows: before, node; inside: outer, inner. A clause related as `then` or
    `after` sits on a node that follows the last one; `during` on one inside it, which stays the anchor. by: the mean
    of the fits, or `min`, the weakest. A clause costs two equi-joins and a grouped maximum.
    """
    fit = lambda j: scores.where(F.col("clause") == j).select(F.col("node").alias("on"), F.col("score").alias("fit"))
    best = fit(0).select(F.col("on").alias("node"), F.array("on").alias("path"), F.array("fit").alias("fits"), F.col("fit").alias("total"))
    for j, relation in enumerate(relations):
        if j:
            if relation == "during":
                moved = best.join(inside, best["node"] == inside["outer"]).select(F.col("node"), F.col("inner").alias("on"), "path", "fits", "total")
            else:
                moved = best.withColumnRenamed("node", "before").join(follows, "before").select("node", F.col("node").alias("on"), "path", "fits", "total")
            total = F.col("total") + F.col("fit") if by == "mean" else F.least("total", "fit")
            grown = moved.join(fit(j), "on").select("node", F.concat("path", F.array("on")).alias("path"), F.concat("fits", F.array("fit")).alias("fits"), total.alias("total"))
            best = grown.groupBy("node").agg(F.max_by(F.struct("path", "fits", "total"), F.struct(F.round("total", 9), F.transform("path", lambda x: -x))).alias("b")).select("node", "b.*")
    return best.select("node", "path", "fits", (F.col("total") / (len(relations) if by == "mean" else 1)).alias("score"))


def chains(scores: DataFrame, follows: DataFrame, inside: DataFrame, relations: list[str]) -> DataFrame:
    """node, path, score: chains best by mean and those best by weakest fit, pooled and ordered by both ranks."""
    both = [chain_paths(scores, follows, inside, relations, by).select("node", "path", "fits") for by in ("mean", "min")]
    pool = both[0].unionByName(both[1]).dropDuplicates(["path"])
    pool = pool.withColumn("mean", F.round(F.aggregate("fits", F.lit(0.0), lambda s, x: s + x) / len(relations), 9)).withColumn("low", F.round(F.array_min("fits"), 9)).checkpoint()
    pool = ranking.ranks(ranking.ranks(pool, "mean", "path", "r_mean"), "low", "path", "r_low")
    return pool.select("node", "path", (F.col("mean") * 1e-3 - F.col("r_mean") - F.col("r_low")).alias("score"))


def recalled(df: DataFrame, by: str, pos: str, channels: dict[str, float], tie: str, per: int, pad: int, proposing: list[str] | None = None) -> DataFrame:
    """by, t0, t1, rrf: the best `per` places of every channel (or of those that propose), widened by pad, clamped to
    their recording and merged where they touch; each stretch has its best score of every channel, and these are fused by
    weighted ranks."""
    ends = df.groupBy(by).agg(F.min(pos).alias("_lo"), F.max(pos).alias("_hi"))
    best = None
    for c in proposing or channels:
        top = df.where(F.col(c).isNotNull()).orderBy(F.desc(c), tie).limit(per).select(by, pos)
        best = top if best is None else best.union(top)
    wide = best.distinct().join(ends, by).select(by, F.greatest(F.col(pos) - pad, "_lo").alias("t0"), F.least(F.col(pos) + pad, "_hi").alias("t1"))
    spans = islands.merge_spans(wide, [by], "t0", "t1").groupBy(by, "island").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1")).drop("island")
    each = spans.withColumn(pos, F.explode(F.sequence("t0", "t1"))).join(df.select(by, pos, *channels), [by, pos])
    held = each.groupBy(by, "t0", "t1").agg(*(F.max(c).alias(c) for c in channels)).withColumn("_tie", F.struct(by, "t0")).checkpoint()
    return ranking.fuse(held, channels, "_tie").drop("_tie")


#: Places that a search looks at in all: a share of the rows between bounds; and by clause at least. How much a direction weighs.
PLACES, ROWS_A_PLACE, PLACES_BOUNDS, CLAUSE_PLACES, DIRECTION = 48, 1500, (120, 256), 12, 2.5


def clause_budget(rows: int, clauses: int, places: int = PLACES) -> int:
    """Places for each clause: those of the search follow from the rows, and are shared by the clauses down to a floor."""
    low, high = PLACES_BOUNDS
    return max(max(places, min(max(rows // ROWS_A_PLACE, low), high)) // clauses, CLAUSE_PLACES)


def verified(df: DataFrame, by: str, pos: str, clauses: list[str], others: dict[str, float], tie: str, pad: int, keep: int, direction: str | None = None, places: int = PLACES) -> DataFrame:
    """by, t0, t1, mean, rrf: the best `keep` stretches for a question of several clauses.

    Every clause proposes places, as many as clause_budget grants, and so does every other channel (column: weight). A
    place scores by the mean of its clauses, so that it must suit them all: that mean, not a clause, is ranked. A
    direction (a column, for questions that have one) proposes nothing and weighs DIRECTION in the ranks. Null scores
    abstain; a place that lacks a clause has no mean. No rows, no stretches.
    """
    mean = sum((F.col(c) for c in clauses), F.lit(0.0)) / len(clauses)
    per = clause_budget(df.count(), len(clauses), places)
    channels = {"mean": 1.0, **others} | ({direction: DIRECTION} if direction else {})
    found = recalled(df.withColumn("mean", F.round(mean, 9)), by, pos, channels, tie, per, pad, [*clauses, *others])
    return found.orderBy(F.desc(F.round("rrf", 9)), by, "t0").limit(keep).select(by, "t0", "t1", "mean", "rrf")


def hybrid(docs: DataFrame, key: str, body: str, query: str, appearance: DataFrame, dims: int = 48, k: int = 20, stop: tuple = ()) -> DataFrame:
    """key, rrf and the three ranks of the best k rows: appearance (given: key, appearance), meaning (cosine in the latent
    space) and wording (cosine of TF-IDF), fused by ranks. A row without words abstains from the latter two."""
    words = F.filter(text.words(F.col(body)), lambda w: ~w.isin(*stop)) if stop else text.words(F.col(body))
    grams = lambda ws: F.concat(ws, F.when(F.size(ws) > 1, F.zip_with(F.slice(ws, F.lit(1), F.size(ws) - 1), F.slice(ws, F.lit(2), F.size(ws) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>")))
    asked = docs.sparkSession.createDataFrame([(0, query)], f"{key} long, {body} string")
    said = dict(asked.select(F.explode(grams(words)).alias("term")).groupBy(F.xxhash64("term")).count().collect())  # one question
    # a projection of its own: grams read the words five times, and would make them as often
    known = lsa.likeness(docs.select(key, words.alias("_words")), key, grams(F.col("_words")), said, dims)
    rows = docs.select(key).join(appearance, key, "left").join(known, key, "left")
    rows = rows.withColumns({c: F.round(c, 9) for c in ("appearance", "meaning", "wording")}).checkpoint()
    fused = ranking.fuse(rows, {"appearance": 1.0, "meaning": 1.0, "wording": 1.0}, key)
    return fused.orderBy(F.desc("rrf"), key).limit(k).select(key, "rrf", "rank_appearance", "rank_meaning", "rank_wording")


def lanes(df: DataFrame, by: str, on: str, score: str) -> DataFrame:
    """by, scores (in order), present: each recording's scores as one lane, and how many are above the common cut."""
    cut = cuts.split(df, score)
    marked = df.join(F.broadcast(cut), F.lit(True))
    return marked.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(on, score))), lambda e: e[score]).alias("scores"), F.coalesce(F.sum((F.col(score) > F.col("cut")).cast("long")), F.lit(0)).alias("present"))


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
