"""A sharded small-world graph index: layered neighbour graphs in blocks, searched best first."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

#: Rows of a block on average, links of a node, candidates looked at when links are chosen, and nodes a layer up.
BLOCK, LINKS, LOOK, THIN = 2048, 12, 48, 16


def _unit(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def layer_links(x: np.ndarray, members: np.ndarray) -> dict[int, list[int]]:
    """Diverse near neighbours of each member among the members, both ways."""
    links: dict[int, list[int]] = {int(m): [] for m in members}
    sub = x[members]
    for i in range(len(members)):
        s = sub @ sub[i]
        s[i] = -np.inf
        look = np.argpartition(-s, min(LOOK, len(s)) - 1)[:LOOK]
        look = look[np.argsort(-s[look], kind="stable")]
        picked: list[int] = []
        for j in look[np.isfinite(s[look])]:
            if len(picked) < LINKS and (not picked or (sub[picked] @ sub[j]).max() < s[j]):
                picked.append(int(j))
        for j in look[np.isfinite(s[look])][: LINKS // 2]:  # the nearest themselves keep dense spots connected
            if int(j) not in picked:
                picked.append(int(j))
        links[int(members[i])] = [int(members[j]) for j in picked]
    for a, near in list(links.items()):
        for b in near:
            if a not in links[b] and len(links[b]) < 3 * LINKS:
                links[b].append(a)
    return links


def build(df: DataFrame, key: str, vector: str) -> DataFrame:
    """block, place, key, vec, links (an array for each layer the row is in): to be stored as a table.

    Rows are dealt into blocks by key hash; a block is one group of bounded size. Null vectors are left out.
    """
    blocks = max(1, -(-df.count() // BLOCK))
    dealt = df.where(F.col(vector).isNotNull()).select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), F.col(key).cast("long").alias("key"), F.col(vector).cast("array<float>").alias("vec"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key").reset_index(drop=True)
        x, members, layers = _unit(pdf["vec"]), np.arange(len(pdf)), []
        while True:
            layers.append(layer_links(x, members))
            if len(members) <= THIN:
                break
            members = members[::THIN]
        pdf["place"], pdf["links"] = range(len(pdf)), [[layer[i] for layer in layers if i in layer] for i in range(len(pdf))]
        return pdf[["block", "place", "key", "vec", "links"]]

    return dealt.groupBy("block").applyInPandas(one, "block long, place int, key long, vec array<float>, links array<array<int>>")


def walk(x: np.ndarray, links: list, q: np.ndarray, width: int) -> list[tuple[float, int]]:
    """Best-first search from the top layer down; the `width` best (similarity, place) at the lowest."""
    top = max(map(len, links))
    at = next(i for i, own in enumerate(links) if len(own) == top)
    for layer in range(top - 1, 0, -1):
        while True:
            near = [at, *links[at][layer]]
            best = near[int((x[near] @ q).argmax())]
            if best == at:
                break
            at = best
    s = float(x[at] @ q)
    seen, todo, best = {at}, [(-s, at)], [(s, at)]
    while todo:
        s, a = heapq.heappop(todo)
        if len(best) >= width and -s < best[0][0]:
            break
        new = [b for b in links[a][0] if b not in seen]
        seen.update(new)
        for b, t in zip(new, (x[new] @ q).tolist() if new else ()):
            if len(best) < width or t > best[0][0]:
                heapq.heappush(todo, (-t, b))
                heapq.heappush(best, (t, b))
                if len(best) > width:
                    heapq.heappop(best)
    return sorted(best, key=lambda b: (-b[0], b[1]))


def search(index: DataFrame, queries: DataFrame, key: str, vector: str, k: int, width: int = 64) -> DataFrame:
    """query, match, cosine, rank: about the k nearest rows of the index to each query (a stated set). Each block
    answers all queries, and the blocks' answers are ranked for each query."""
    blocks = index.select("block").distinct()
    asked = queries.select(F.col(key).cast("long").alias("query"), F.col(vector).cast("array<float>").alias("qv"))
    each = asked.join(F.broadcast(blocks.withColumnRenamed("block", "shard")), F.lit(True))  # one small number for each BLOCK rows

    def one(rows: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        out: list = []
        if len(rows) and len(qs):
            rows = rows.sort_values("place")
            x, q, keys, links = _unit(rows["vec"]), _unit(qs["qv"]), rows["key"].to_numpy(), [[list(y) for y in own] for own in rows["links"]]
            for name, v in zip(qs["query"], q):
                out += [(name, keys[i], s) for s, i in walk(x, links, v, max(width, k))[:k]]
        return pd.DataFrame(out, columns=["query", "match", "cosine"])

    found = index.groupBy("block").cogroup(each.groupBy("shard")).applyInPandas(one, "query long, match long, cosine double")
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "match")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
