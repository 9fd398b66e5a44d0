"""Density clusters of all rows: core distances and spanning trees of pairs of blocks, merged into one tree."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

#: Rows of a block on average, those of it whose distances are held at once, and edges a row before trees are merged in tasks.
BLOCK, PART, EDGES = 16384, 1024, 16


def spanning_tree(x: np.ndarray, least: int) -> np.ndarray:
    """Edges (distance, a, b) of the minimum spanning tree under mutual reachability, by distance."""
    sq = (x * x).sum(1)
    d = np.sqrt(np.maximum(sq[:, None] + sq[None] - 2 * x @ x.T, 0))
    core = np.partition(d, min(least, len(x)) - 1, axis=1)[:, min(least, len(x)) - 1]
    d = np.maximum(d, np.maximum(core[:, None], core[None]))
    far, came, out, inside = d[0].copy(), np.zeros(len(x), int), [], np.zeros(len(x), bool)
    inside[0] = True
    for _ in range(len(x) - 1):
        b = int(np.where(inside, np.inf, far).argmin())
        out.append((far[b], came[b], b))
        inside[b] = True
        nearer = d[b] < far
        far[nearer], came[nearer] = d[b][nearer], b
    return np.array(sorted(out), float).reshape(-1, 3)


def density_labels(x: np.ndarray, least: int) -> np.ndarray:
    """Hierarchical density clusters by excess of mass: a label for each row, -1 for noise."""
    return np.full(len(x), -1) if len(x) < 2 * least else tree_labels(spanning_tree(x, least), len(x), least)


def tree_labels(tree: np.ndarray, n: int, least: int) -> np.ndarray:
    """The labels of n rows whose spanning tree is given by distance. Joins at equal distances (to ten digits) are one, so
    that labels don't depend on the order of rows."""
    # single linkage: node n + k joins nodes at a distance
    root, kids, size = list(range(2 * n - 1)), {}, [1] * n

    def top(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for k, (dist, a, b) in enumerate(tree):
        a, b = top(int(a)), top(int(b))
        dist, parts = round(dist, 10), []
        for side in (a, b):
            more = kids.pop(side)[0] if side >= n and kids[side][1] == dist else [side]
            parts, more = (parts, more) if len(parts) >= len(more) else (more, parts)
            parts += more
        kids[n + k] = (parts, dist)
        size.append(size[a] + size[b])
        root[a] = root[b] = n + k

    def leaves(node: int) -> list[int]:
        todo, out = [node], []
        while todo:
            a = todo.pop()
            if a < n:
                out.append(a)
            else:
                todo += kids[a][0]
        return out

    # condensed: a cluster lives while one side alone has enough rows
    parent, born, mass, left = [-1], [0.0], [0.0], np.zeros(n, int)
    todo = [(2 * n - 2, 0)]
    while todo:
        node, c = todo.pop()
        if node < n:
            left[node] = c
            continue
        parts, dist = kids[node]
        lam = 1 / max(dist, 1e-12)
        big = [s for s in parts if size[s] >= least]
        if len(big) > 1:
            mass[c] += (lam - born[c]) * size[node]
            for s in big:
                parent.append(c)
                born.append(lam)
                mass.append(0.0)
                todo.append((s, len(parent) - 1))
        for s in parts:
            if size[s] < least:
                mass[c] += (lam - born[c]) * size[s] if len(big) < 2 else 0
                left[leaves(s)] = c
        if len(big) == 1:
            todo.append((big[0], c))
    below, chosen = np.zeros(len(parent)), np.zeros(len(parent), bool)
    for c in range(len(parent) - 1, 0, -1):
        chosen[c] = mass[c] >= below[c]
        below[parent[c]] += max(mass[c], below[c])
    label, name = np.full(len(parent), -1), 0
    for c in range(1, len(parent)):  # parents come first: the topmost chosen one wins
        label[c] = label[parent[c]]
        if label[c] < 0 and chosen[c]:
            label[c], name = name, name + 1
    return label[left]


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b."""
    d = a @ (-2 * b.T)
    d += (a * a).sum(1)[:, None]
    d += (b * b).sum(1)[None]
    return d


def joined(x: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Edges (squared distance, a, b) of a spanning tree of a few rows, of which squared core distances are known."""
    d = squares(x, x)
    np.maximum(d, core[:, None], out=d)
    np.maximum(d, core[None], out=d)
    far, came, out, outside, b = np.full(len(x), np.inf), np.zeros(len(x), int), np.empty((len(x) - 1, 3)), np.ones(len(x), bool), 0
    for k in range(len(x) - 1):
        outside[b], far[b] = False, np.inf
        nearer = (d[b] < far) & outside
        far[nearer], came[nearer] = d[b][nearer], b
        b = int(far.argmin())
        out[k] = far[b], came[b], b
    return out


def forest(edges: np.ndarray) -> np.ndarray:
    """The edges of a least spanning forest, by (weight, a, b)."""
    edges = edges[np.lexsort((edges[:, 2], edges[:, 1], edges[:, 0]))]
    names, ends = np.unique(edges[:, 1:], return_inverse=True)
    a, b = ends.reshape(-1, 2).T
    group, kept, alive = np.arange(len(names)), np.zeros(len(edges), bool), np.arange(len(edges))
    while True:
        alive = alive[group[a[alive]] != group[b[alive]]]
        if not len(alive):
            return edges[kept]
        first = np.full(len(names), len(edges))
        back = alive[::-1]  # the last written is the least
        for end, other in ((a, b), (b, a)):
            seen = np.full(len(names), len(edges))
            seen[group[end[back]]] = back
            first = np.minimum(first, seen)
        own = np.flatnonzero(first < len(edges))
        edge = first[own]
        kept[edge] = True
        to = np.arange(len(names))
        to[own] = np.where(group[a[edge]] == own, group[b[edge]], group[a[edge]])
        both = to[to] == np.arange(len(names))
        to = np.where(both, np.minimum(to, np.arange(len(names))), to)
        while (to[to] != to).any():
            to = to[to]
        group = to[group]


def whole_tree(rows: DataFrame, n: int, blocks: int, least: int) -> np.ndarray:
    """Edges (distance, a, b) of a spanning tree under mutual reachability of all rows (id, block, vec).

    Each two blocks meet once for core distances and once for a tree of both: an edge that a tree of some rows leaves out
    is in no need by the whole tree, so that the trees' edges hold one. They are merged in tasks down to EDGES a row, then
    here, in memory that grows with the rows.
    """
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    meet = lambda r: r.withColumn("with", each).withColumn("i", F.least("block", "with")).withColumn("j", F.greatest("block", "with")).groupBy("i", "j")

    def sides(pdf: pd.DataFrame) -> tuple:
        pdf = pdf.sort_values("id")
        return np.stack(pdf["vec"].to_numpy()), pdf["id"].to_numpy(), pdf["block"].to_numpy() == pdf["i"].iloc[0], pdf["i"].iloc[0] == pdf["j"].iloc[0]

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids, first, same = sides(pdf)
        out = []
        for own, other in ((first, first),) if same else ((first, ~first), (~first, first)):
            for lo in range(0, own.sum() if other.any() else 0, 512):
                d = squares(x[own][lo : lo + 512], x[other])
                np.maximum(d, 0, out=d)
                if d.shape[1] > least:
                    d.partition(least - 1, axis=1)
                    d = d[:, :least].copy()  # a view would keep the block
                out.append(pd.DataFrame({"id": ids[own][lo : lo + 512], "near": list(d)}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "near": []})

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids, first, same = sides(pdf)
        core = pdf.sort_values("id")["core"].to_numpy()
        cut = lambda at: np.array_split(at, max(1, -(-len(at) // PART)))
        left, right = cut(np.flatnonzero(first)), cut(np.flatnonzero(~first))
        some = [(p, q) for k, p in enumerate(left) for q in left[k + 1 :]] or [(left[0], left[0][:0])]
        out = []
        for p, q in some if same else [(p, q) for p in left for q in right]:
            at = np.concatenate([p, q])
            e = joined(x[at], core[at])
            ends = ids[at][e[:, 1:].astype(int)]
            out.append(np.column_stack([e[:, 0], ends.min(1), ends.max(1)]))
        return frame(forest(np.concatenate(out)))

    frame = lambda e: pd.DataFrame({"d": e[:, 0], "a": e[:, 1].astype(np.int64), "b": e[:, 2].astype(np.int64)})
    merged = lambda pdf: frame(forest(pdf[["d", "a", "b"]].to_numpy(float)))
    core = meet(rows).applyInPandas(near, "id long, near array<double>").groupBy("id").agg(F.element_at(F.array_sort(F.flatten(F.collect_list("near"))), least).alias("core"))
    edges, shape = meet(rows.join(core, "id")).applyInPandas(tree, "d double, a long, b long"), "d double, a long, b long"
    count = (blocks + 1) * n
    while count > EDGES * n:
        groups = -(-count // (EDGES * n))
        edges = edges.groupBy(F.pmod(F.xxhash64("a", "b"), F.lit(groups)).alias("g")).applyInPandas(merged, shape)
        count = groups * n
    found = forest(edges.toPandas()[["d", "a", "b"]].to_numpy(float))
    found[:, 0] = np.sqrt(np.maximum(np.round(found[:, 0], 12), 0))  # the rest is noise of the products
    return found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]


def whole_clusters(df: DataFrame, key: str, vector: str, least: int) -> DataFrame:
    """key, cluster of the rows that have a vector."""
    n = df.count()
    blocks = max(1, -(-n // BLOCK))
    size = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda s, x: s + x * x))
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("raw"))
    scaled = F.aggregate(F.array(F.lit(0)), F.greatest(size, F.lit(1e-300)), lambda n, _: n, lambda n: F.transform("raw", lambda x: x / n))  # the length once, not for each element
    rows = rows.select("key", scaled.alias("vec"), F.pmod(F.xxhash64("key", "raw"), F.lit(blocks)).cast("int").alias("block"))
    sizes = dict(rows.groupBy("block").count().collect())
    before = F.array(*(F.lit(sum(sizes.get(c, 0) for c in range(b))).cast("long") for b in range(blocks)))
    rows = rows.withColumn("id", F.get(before, F.col("block")) + F.row_number().over(Window.partitionBy("block").orderBy("key", "vec")) - 1)
    label = np.full(n, -1) if n < 2 * least else tree_labels(whole_tree(rows.select("id", "block", "vec"), n, blocks, least), n, least)
    shared = df.sparkSession.sparkContext.broadcast(label.astype(np.int32))  # four bytes a row

    @F.pandas_udf("int")
    def labelled(at: pd.Series) -> pd.Series:
        return pd.Series(shared.value[at.to_numpy()])

    return rows.select(F.col("key").alias(key), labelled("id").alias("cluster"))


def density_clusters(df: DataFrame, key: str, vector: str, least: int = 8, sample: int | None = None) -> DataFrame:
    """key, cluster: clusters of unit vectors, -1 for noise, by the tree of all rows.

    If a sample is asked for, the tree is that of so many rows only; a row belongs to the nearest centroid if it is no
    farther from it than that cluster's own sampled rows, and is noise otherwise."""
    if sample is None:
        none = df.where(F.col(vector).isNull()).select(key, F.lit(-1).alias("cluster"))
        return whole_clusters(df.where(F.col(vector).isNotNull()), key, vector, least).unionByName(none)
    some = df.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).limit(sample)
    x = np.array([r[0] for r in some.select(vector).toLocalIterator()], float)
    if len(x):
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    label = density_labels(x, least) if len(x) else np.empty(0, int)
    names = range(label.max() + 1) if len(label) else range(0)
    centre = np.array([x[label == c].mean(0) for c in names])
    reach = np.array([np.linalg.norm(x[label == c] - centre[c], axis=1).max() for c in names])
    shared = df.sparkSession.sparkContext.broadcast((centre, reach))  # at most sample / least rows

    @F.pandas_udf("int")
    def assigned(v: pd.Series) -> pd.Series:
        centre, reach = shared.value
        out = np.full(len(v), -1, np.int32)
        known = v.notna().to_numpy()
        if len(centre) and known.any():
            rows = np.stack(v[known].to_numpy()).astype(float)
            rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)
            d = np.sqrt(np.maximum((rows**2).sum(1)[:, None] + (centre**2).sum(1)[None] - 2 * rows @ centre.T, 0))
            near = d.argmin(1)
            out[known] = np.where(d[np.arange(len(d)), near] <= reach[near] + 1e-9, near, -1)
        return pd.Series(out)

    return df.select(key, assigned(F.col(vector).cast("array<double>")).alias("cluster"))
