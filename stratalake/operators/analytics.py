"""Further sequence and corpus operators: edges, shifts, events, aligned paths, nesting, opposites, rescoring."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from stratalake.functions.quantiles import quantiles
from stratalake.functions.scalar import dot, unit
from stratalake.operators.cuts import split
from stratalake.operators.islands import _islands
from stratalake.operators.sequence import align_path
from stratalake.operators.vectors import BLOCK, mean_vector, stacked, tiles


def local_peaks(df: DataFrame, by: list[str], on: str, score: str) -> DataFrame:
    """Rows that score at least as much as the row before and more than the row after."""
    w = Window.partitionBy(*by).orderBy(on)
    marked = df.withColumn("_p", F.lag(score).over(w)).withColumn("_n", F.lead(score).over(w))
    return marked.where((F.col("_p").isNull() | (F.col(score) >= F.col("_p"))) & (F.col("_n").isNull() | (F.col(score) > F.col("_n")))).drop("_p", "_n")


def spaced(df: DataFrame, by: list[str], on: str, score: str, least: float) -> DataFrame:
    """Greedy, best first: rows at least `least` apart from better ones of their key."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, kept = pdf.sort_values([score, on], ascending=[False, True]), []
        for i, t in enumerate(pdf[on].to_numpy()):
            if not kept or np.abs(pdf[on].to_numpy()[kept] - t).min() >= least:
                kept.append(i)
        return pdf.iloc[kept]

    return df.groupBy(*by).applyInPandas(one, df.schema)


def lag_changes(df: DataFrame, by: list[str], on: str, vector: str, lags: tuple[int, ...] = (1, 2, 4, 8)) -> DataFrame:
    """Adds `pyramid`: the sum over lags of 1 - cosine with the row that many before, over the median of all rows at that
    lag (1 if that isn't positive), credited to the row (lag - 1) // 2 before the later of the two. Keys of fewer than
    three rows have 0."""
    w = Window.partitionBy(*by).orderBy(on)
    v = df.withColumn("_u", unit(F.col(vector))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    far = v.select("*", *((1 - dot(F.col("_u"), F.lag("_u", k).over(w))).alias(f"_far{k}") for k in lags))
    long = far.select(F.explode(F.array(*(F.struct(F.lit(k).alias("_lag"), F.col(f"_far{k}").alias("_far")) for k in lags))).alias("_e")).select("_e.*")
    medians = quantiles(long, "_far", {"_mid": 0.5}, ["_lag"])
    row = medians.groupBy().agg(*(F.max(F.when((F.col("_lag") == k) & (F.col("_mid") > 0), F.col("_mid"))).alias(f"_mid{k}") for k in lags))
    total = F.lit(0.0)
    for k in lags:
        credited = F.lead(f"_far{k}", (k - 1) // 2).over(w) if k > 2 else F.col(f"_far{k}")
        total = total + F.coalesce(credited / F.coalesce(F.col(f"_mid{k}"), F.lit(1.0)), F.lit(0.0))
    return far.join(F.broadcast(row), F.lit(True)).select(*df.columns, F.when(F.col("_n") < 3, F.lit(0.0)).otherwise(total).alias("pyramid"))


def frozen(df: DataFrame, by: list[str], on: str, vector: str, at: float | None = None) -> DataFrame:
    """Runs where nothing changes: keys, first and last row of each. The cosine with the next row is at least `at`, or
    at least the cut that splits these cosines if one group lies close to 1 (else there is no run). Keys of fewer than
    three rows have none."""
    w = Window.partitionBy(*by).orderBy(on)
    u = df.select(*by, on, unit(F.col(vector)).alias("_u"), F.count(F.lit(1)).over(Window.partitionBy(*by)).alias("_n"))
    same = u.select(*by, on, F.lead(on).over(w).alias("_next"), dot(F.col("_u"), F.lead("_u").over(w)).alias("_cos"), "_n").where("_n > 2 and _next is not null")
    if at is None:
        same = same.join(F.broadcast(split(same, "_cos", 1.0)), F.lit(True)).withColumn("_still", F.col("_cos") >= F.col("cut"))
    else:
        same = same.withColumn("_still", F.col("_cos") >= at)
    still = _islands(same, by, [on], ~F.coalesce(F.lag("_still").over(w), F.lit(False)) | ~F.col("_still")).where("_still")
    return still.groupBy(*by, "island").agg(F.min(on).alias("first"), F.max("_next").alias("last")).drop("island")


def changed(path: DataFrame, at: float | None = None) -> DataFrame:
    """The steps of aligned paths (see aligned_path) whose distance is at least `at`, or at least the cut that splits the
    distances if one group lies close to 0; no step without such a cut."""
    if at is not None:
        return path.where(F.col("distance") >= at)
    return path.join(F.broadcast(split(path, "distance", 0.0)), F.col("distance") >= F.col("cut")).drop("cut")


def first_hit_rate(df: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """One row, `rate`: the share of rows whose left vector is nearest to their own right vector (inner products to 12
    places, the smallest key among equal ones); null for fewer than two rows. Rows without one of their vectors, or with vectors of
    two lengths, are left out. Vectors meet in blocks, and a row's best is kept per block: nothing is collected."""
    df = df.where(F.size(left) == F.size(right)).withColumn("_dim", F.size(left))
    n = df.count()
    blocks = max(1, -(-n // BLOCK))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    own = F.pmod(F.xxhash64(key), F.lit(blocks))
    a = df.select(F.col(key).alias("key"), F.col(left).cast("array<double>").alias("vec"), own.alias("i"), every.alias("j"), "_dim")
    b = df.select(F.col(key).alias("key"), F.col(right).cast("array<double>").alias("vec"), own.alias("j"), every.alias("i"), "_dim")
    kind = dict(a.dtypes)["key"]

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(x) and len(y):
            order = y["key"].argsort().to_numpy()
            keys, others = x["key"].to_numpy(), y["key"].to_numpy()[order]
            for at, s in tiles(stacked(x["vec"]), stacked(y["vec"])[order]):
                s.round(12, out=s)  # a product of equal vectors hangs on their places
                top = s.argmax(1)
                out.append(pd.DataFrame({"key": keys[at], "match": others[top], "score": s[np.arange(len(s)), top]}))
        return pd.concat(out) if out else pd.DataFrame({"key": [], "match": [], "score": []})

    met = a.groupBy("i", "j", "_dim").cogroup(b.groupBy("i", "j", "_dim")).applyInPandas(meet, f"key {kind}, match {kind}, score double")
    best = met.groupBy("key").agg(F.min_by("match", F.struct(-F.col("score"), "match")).alias("match"))
    return best.agg(F.when(F.count(F.lit(1)) > 1, F.avg((F.col("key") == F.col("match")).cast("double"))).alias("rate"))


def coarse(df: DataFrame, by: list[str], score: str) -> DataFrame:
    """Adds `coarse`: whether the score is above its key's mean."""
    m = df.groupBy(*by).agg(F.avg(score).alias("_m"))
    return df.join(m, by).withColumn("coarse", F.col(score) > F.col("_m")).drop("_m")


def gated_events(df: DataFrame, by: list[str], on: str, score: str, q: float, least: int) -> DataFrame:
    """Events where a five-row moving sum (missing rows count as 0) over five crosses up its own quantile, at least
    `least` rows apart: key and row of each start."""
    w = Window.partitionBy(*by).orderBy(on)
    smooth = df.select(*by, on, (F.sum(score).over(w.rowsBetween(-2, 2)) / 5).alias("_s"))
    cut = quantiles(smooth, "_s", {"_cut": q}, by).drop("n")
    up = smooth.join(cut, by).withColumn("_b", F.lag("_s").over(w)).where((F.col("_s") > F.col("_cut")) & ((F.col("_b") <= F.col("_cut")) | F.col("_b").isNull())).select(*by, on)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list = []
        pdf = pdf.sort_values(on)
        for i, t in enumerate(pdf[on]):
            if not kept or t - pdf[on].iloc[kept[-1]] >= least:
                kept.append(i)
        return pdf.iloc[kept]

    return up.groupBy(*by).applyInPandas(one, up.schema)


def shifts(df: DataFrame, by: list[str], stretch: str, key: str, vector: str, trials: int = 200, seed: int = 0) -> DataFrame:
    """by, pair, distance, p: for neighbouring stretches of a key (numbered from 1 without gaps) the distance of the means of
    their vectors, scaled to length 1, and the share (k + 1) / (trials + 1) of random relabellings that part them as far.

    A trial orders the rows of a pair by a hash of seed, trial and row key, and calls the first of them, as many as the
    first stretch has, its rows. The place where that order is cut is found by counting in buckets of the hash, so neither a
    stretch nor a trial need fit in one task; vectors are summed by trial in the batches that hold them. Keys of rows are
    unique within a pair. Rows with a null vector are left out; pairs that then lack a side give no row.
    """
    on = [*by, "pair"]
    rows = df.where(F.col(vector).isNotNull()).select(*by, F.col(stretch).cast("long").alias("_s"), F.col(key).cast("string").alias("_k"), unit(F.col(vector)).alias("_v"))
    rows = rows.withColumn("pair", F.explode(F.array(F.col("_s"), F.col("_s") - 1))).withColumn("_a", F.col("_s") == F.col("pair"))
    size = rows.groupBy(*on).agg(F.count_if("_a").alias("_na"), F.count_if(~F.col("_a")).alias("_nb")).where("_na > 0 and _nb > 0")
    mark = lambda t: F.md5(F.concat_ws(":", F.lit(seed), t, F.col("_k")))
    drawn = rows.select(*on, "_k", F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("_trial")).select(*on, "_trial", mark(F.col("_trial")).alias("_h"))
    drawn = drawn.withColumn("_bucket", F.substring("_h", 1, 3))
    w = Window.partitionBy(*on, "_trial").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    upto = drawn.groupBy(*on, "_trial", "_bucket").agg(F.count(F.lit(1)).alias("_c")).withColumn("_upto", F.sum("_c").over(w)).join(size, on)
    edge = upto.where("_upto >= _na and _upto - _c < _na").select(*on, "_trial", "_bucket", (F.col("_na") - F.col("_upto") + F.col("_c")).alias("_nth"))
    last = drawn.join(edge, [*on, "_trial", "_bucket"]).withColumn("_n", F.row_number().over(Window.partitionBy(*on, "_trial").orderBy("_h"))).where("_n = _nth")
    last = last.groupBy(*on).agg(F.map_from_entries(F.collect_list(F.struct("_trial", "_h"))).alias("_last"))  # `trials` entries
    inside = F.transform(F.sequence(F.lit(1), F.lit(trials)), lambda t: mark(t) <= F.try_element_at("_last", t))
    met = rows.join(last, on).select(*on, "_v", F.concat(F.array("_a"), inside, F.array(F.lit(True))).alias("_m"))

    def sums(batches):
        for b in batches:
            out = []
            for k, g in b.groupby(on, sort=False, dropna=False):
                s = np.stack(g["_m"].to_numpy()).T.astype(float) @ np.stack(g["_v"].to_numpy())
                out += [(*k, t, x) for t, x in enumerate(s)]
            yield pd.DataFrame(out, columns=[*on, "_trial", "_sum"])

    kinds = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes if c in on)
    part = met.mapInPandas(sums, f"{kinds}, _trial int, _sum array<double>").select(*on, "_trial", F.posexplode("_sum").alias("_i", "_x"))
    total = part.groupBy(*on, "_i", "_trial").agg(F.sum("_x").alias("_x"))
    whole = total.where(F.col("_trial") == trials + 1).select(*on, "_i", F.col("_x").alias("_whole"))
    gaps = total.where(F.col("_trial") <= trials).join(whole, [*on, "_i"]).join(size, on)
    gaps = gaps.groupBy(*on, "_trial").agg(F.sqrt(F.sum(F.pow(F.col("_x") / F.col("_na") - (F.col("_whole") - F.col("_x")) / F.col("_nb"), F.lit(2)))).alias("_gap"))
    seen = gaps.groupBy(*on).agg(F.max(F.when(F.col("_trial") == 0, F.col("_gap"))).alias("distance"), F.collect_list(F.when(F.col("_trial") > 0, F.col("_gap"))).alias("_g"))
    return seen.select(*on, "distance", ((F.size(F.filter("_g", lambda x: x >= F.col("distance") - 1e-12)) + 1) / (trials + 1)).alias("p"))


def aligned_path(df: DataFrame, by: list[str], side: str, on: str, vector: str) -> DataFrame:
    """i, j, distance along the global alignment of sides 0 and 1 of each key."""
    kind = ", ".join(f"{c} {k}" for c, k in df.dtypes if c in by)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (np.stack(pdf[pdf[side] == s].sort_values(on)[vector].to_numpy()) if (pdf[side] == s).any() else np.empty((0, 1)) for s in (0, 1))
        if not len(a) or not len(b):
            return pd.DataFrame(columns=[*by, "i", "j", "distance"])
        unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        cost = 1 - unit(a) @ unit(b).T
        return pd.DataFrame([[*pdf.iloc[0][by], i, j, cost[i, j]] for i, j in align_path(cost)], columns=[*by, "i", "j", "distance"])

    return df.groupBy(*by).applyInPandas(one, f"{kind}, i long, j long, distance double")


def smallest_enclosing(df: DataFrame, by: list[str], key: str, x0: str, y0: str, x1: str, y1: str, share: float = 0.75) -> DataFrame:
    """key, parent: the smallest larger box of the same group that covers more than a share of the box; null if none."""
    area = (F.col(x1) - F.col(x0)) * (F.col(y1) - F.col(y0))
    a = df.select(*by, key, *(F.col(c).alias(f"a_{i}") for i, c in enumerate((x0, y0, x1, y1))), area.alias("a_area"))
    b = df.select(*by, F.col(key).alias("_parent"), *(F.col(c).alias(f"b_{i}") for i, c in enumerate((x0, y0, x1, y1))), area.alias("b_area"))
    zero = F.lit(0.0)
    shared = F.greatest(zero, F.least("a_2", "b_2") - F.greatest("a_0", "b_0")) * F.greatest(zero, F.least("a_3", "b_3") - F.greatest("a_1", "b_1"))
    inside = a.join(b, by).where((F.col("b_area") > F.col("a_area")) & (shared > share * F.col("a_area")))
    best = inside.groupBy(*by, key).agg(F.min_by("_parent", F.struct("b_area", "_parent")).alias("parent"))
    return df.select(*by, key).join(best, [*by, key], "left")


def opposites(df: DataFrame, key: str, vector: str, score: str | None = None) -> DataFrame:
    """key, opposite (and the cosine, if a name for it is given): the row most unlike each one after the common mean is taken away; cosines equal to nine digits go to
    the smaller key, and rows that lie in the mean are unlike nothing.

    Blocked products as in vectors.nearest: each block meets each other once, in memory bounded by a block, so the work
    grows with the square of the rows.
    """
    known = df.where(F.col(vector).isNotNull())
    mean = known.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("_mean"))
    c = known.join(F.broadcast(mean), F.lit(True)).select(F.col(key).alias("key"), F.zip_with(vector, "_mean", lambda x, y: x.cast("double") - y).alias("vec"))
    blocks = max(1, -(-known.count() // BLOCK))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    dealt = lambda own, other: c.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias(own), F.col("key").alias("key"), F.col("vec").alias("vec")).withColumn(other, each).groupBy("a", "b")
    kind = dict(c.dtypes)["key"]

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        keys, match, found = [], [], []
        if len(left) and len(right):
            order = right["key"].argsort().to_numpy()
            a, b = stacked(left["vec"]), stacked(right["vec"])[order]
            with np.errstate(invalid="ignore"):
                for x in (a, b):
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
            left_keys, right_keys = left["key"].to_numpy(), right["key"].to_numpy()[order]
            for at, s in tiles(a, b):
                np.round(s, 9, out=s)
                s[np.isnan(s)] = 2.0
                s[left_keys[at, None] == right_keys[None, :]] = np.inf
                least = s.argmin(1)  # the first of equal ones, so the smallest key
                best = s[np.arange(len(s)), least]
                ok = np.isfinite(best)
                keys.append(left_keys[at][ok])
                match.append(right_keys[least][ok])
                found.append(best[ok])
        return pd.DataFrame({n: np.concatenate(v) if v else [] for n, v in (("key", keys), ("match", match), ("cosine", found))})

    met = dealt("a", "b").cogroup(dealt("b", "a")).applyInPandas(meet, f"key {kind}, match {kind}, cosine double")
    return met.groupBy(F.col("key").alias(key)).agg(F.min_by("match", F.struct("cosine", "match")).alias("opposite"), *([F.min("cosine").alias(score)] if score else []))


def cached_scores(asked: DataFrame, cache: DataFrame, keys: list[str], score: str, judge) -> tuple[DataFrame, DataFrame]:
    """All scores of the rows asked for, and those newly judged, to be appended to the cache."""
    known = cache.select(*keys, score).dropDuplicates(keys)
    new = judge(asked.join(known, keys, "left_anti"))
    return asked.join(known, keys).unionByName(new), new


def rerank_blend(df: DataFrame, first: str, second: str, tie: str, alpha: float, head: int) -> DataFrame:
    """The best `head` rows by `first`, ordered by a blend of both scores' normalised ranks (a short list)."""
    top = df.orderBy(F.desc(first), tie).limit(head)
    place = lambda c: (F.lit(1.0) - (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(c), tie)) - 1) / F.greatest(F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) - 1, F.lit(1)))
    return top.withColumn("blend", (1 - alpha) * place(first) + alpha * place(second))


def class_weights(logits: Column, top: int = 5, temperature: float = 0.05) -> Column:
    """Softmax over the `top` best classes, as an array of (class, weight)."""
    best = F.slice(F.array_sort(F.transform(logits, lambda x, i: F.struct((-x).alias("s"), i.alias("c")))), 1, top)
    total = F.aggregate(best, F.lit(0.0), lambda a, e: a + F.exp((F.element_at(best, 1)["s"] - e["s"]) / temperature))
    return F.transform(best, lambda e: F.struct(e["c"].alias("c"), (F.exp((F.element_at(best, 1)["s"] - e["s"]) / temperature) / total).alias("w")))


def even_places(n: Column, most: int) -> Column:
    """Positions of at most `most` rows spread evenly over n."""
    m = F.least(n, F.lit(most))
    return F.transform(F.sequence(F.lit(0).cast("long"), m - 1), lambda i: F.when(m <= 1, F.lit(0)).otherwise(F.round(i * (n - 1) / (m - 1))).cast("long"))


def motion(df: DataFrame, by: list[str], on: str, vector: str, edge: int) -> DataFrame:
    """Unit difference of the mean of the last and of the first `edge` rows of each key with twice as many rows."""
    w = Window.partitionBy(*by)
    marked = df.withColumn("_i", F.row_number().over(w.orderBy(on))).withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") >= 2 * edge)
    side = F.when(F.col("_i") <= edge, 0).when(F.col("_i") > F.col("_n") - edge, 1)
    m = mean_vector(marked.withColumn("_side", side).where("_side is not null"), [*by, "_side"], vector)
    both = m.groupBy(*by).agg(F.max_by(vector, F.when(F.col("_side") == 0, 1)).alias("_a"), F.max_by(vector, F.when(F.col("_side") == 1, 1)).alias("_b"))
    d = F.zip_with("_b", "_a", lambda x, y: x - y)
    return both.withColumn("_d", d).select(*by, F.transform("_d", lambda x: x / F.greatest(F.sqrt(dot(F.col("_d"), F.col("_d"))), F.lit(1e-12))).alias(vector))
