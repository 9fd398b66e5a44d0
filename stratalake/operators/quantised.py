"""Product quantisation with exact rescoring, over all rows or inside coarse cells with stored codes."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from stratalake.functions.scalar import cosine, unit
from stratalake.operators.vectors import BLOCK

#: Rows the codebooks are learnt on at most (a documented bound; every row is coded), sub-vectors and codes.
SAMPLE, PARTS, CODES = 20_000, 8, 16

#: Codes of a sub-vector in a stored index: with 16, recall at 10 is 0.89 on the groups of the tests and 0.75 on the
#: embeddings at sf0.1 (two thirds of the cells); with 64 it is 0.95 and 0.93.
CELL_CODES = 64

#: Numbers that differences of rows and centres take at once.
HELD = 1 << 18


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Which centre is nearest to each row, HELD differences at a time."""
    step = max(1, HELD // max(1, centres.size))
    return np.concatenate([((x[lo : lo + step, None] - centres[None]) ** 2).sum(2).argmin(1) for lo in range(0, max(1, len(x)), step)])


def codebooks(rows: np.ndarray, parts: int = PARTS, codes: int = CODES, rounds: int = 10) -> np.ndarray:
    """parts x codes x width centroids, by seeded k-means in each sub-space."""
    rng, out = np.random.default_rng(7), []
    for sub in np.split(rows, parts, axis=1):
        centre = sub[rng.choice(len(sub), codes, replace=len(sub) < codes)]
        for _ in range(rounds):
            near = _nearest(sub, centre)
            centre = np.stack([sub[near == c].mean(0) if (near == c).any() else centre[c] for c in range(codes)])
        out.append(centre)
    return np.stack(out)


def search(df: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    """key, score: the k best cosines among the 4k rows whose codes promise most."""
    sample = df.orderBy(F.xxhash64(key), key).limit(SAMPLE).select(vector)
    rows = np.array([r[0] for r in sample.toLocalIterator()], float)
    books = codebooks(rows / np.linalg.norm(rows, axis=1, keepdims=True))
    q = np.array(query) / np.linalg.norm(query)
    table = np.einsum("pcw,pw->pc", books, q.reshape(len(books), -1))
    shared = df.sparkSession.sparkContext.broadcast((books, table))

    @F.pandas_udf("double")
    def promised(v):
        books, table = shared.value
        x = np.stack(v.to_numpy()).astype(float)
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).reshape(len(x), len(books), -1)
        return __import__("pandas").Series(sum(table[p][((x[:, p, None] - books[p][None]) ** 2).sum(2).argmin(1)] for p in range(len(books))))

    short = df.withColumn("_p", promised(F.col(vector))).orderBy(F.desc("_p"), key).limit(4 * k)
    return short.select(key, cosine(F.col(vector), F.array(*map(F.lit, query))).alias("score")).orderBy(F.desc("score"), key).limit(k)


@dataclass
class CellIndex:
    """Every row with its coarse cell and codes; the centres of the cells and the code books of what is left beside them."""

    rows: DataFrame  # key, vec (length one), cell, codes
    centres: np.ndarray
    books: np.ndarray

    def save(self, path: str) -> None:
        """Rows go to folders by cell, so that a search reads the cells it probes alone."""
        self.rows.write.partitionBy("cell").parquet(f"{path}/rows")
        spark = self.rows.sparkSession
        spark.createDataFrame([(self.centres.tolist(), self.books.tolist())], "centres array<array<double>>, books array<array<array<double>>>").coalesce(1).write.parquet(f"{path}/model")

    @staticmethod
    def load(spark, path: str) -> CellIndex:
        m = spark.read.parquet(f"{path}/model").first()
        return CellIndex(spark.read.parquet(f"{path}/rows"), np.array(m["centres"]), np.array(m["books"]))


def build(df: DataFrame, key: str, vector: str, cells: int | None = None) -> CellIndex | None:
    """Centres and code books are learnt on SAMPLE rows at most (those of the smallest key hashes); every row is assigned
    and coded in one pass. cells: the root of the sample's size by default. None for an empty table; vectors that are null
    are left out, and PARTS divides their length."""
    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), unit(F.col(vector)).alias("vec"))
    sample = np.array([r[0] for r in rows.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("vec").toLocalIterator()], float)
    if not len(sample):
        return None
    centres = codebooks(sample, 1, cells or math.ceil(math.sqrt(len(sample))))[0]
    near = (sample @ centres.T - (centres**2).sum(1) / 2).argmax(1)
    books = codebooks(sample - centres[near], PARTS, CELL_CODES)
    shared = df.sparkSession.sparkContext.broadcast((centres, books))

    @F.pandas_udf("cell int, codes array<int>")
    def coded(v: pd.Series) -> pd.DataFrame:
        centres, books = shared.value
        if not len(v):
            return pd.DataFrame({"cell": [], "codes": []})
        x = np.stack(v.to_numpy())
        cell = (x @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        parts = np.split(x - centres[cell], len(books), axis=1)
        codes = np.stack([_nearest(p, b) for p, b in zip(parts, books)], axis=1)
        return pd.DataFrame({"cell": cell.astype("int32"), "codes": list(codes.astype("int32"))})

    return CellIndex(rows.withColumn("_c", coded("vec")).select("key", "vec", "_c.cell", "_c.codes"), centres, books)


def cell_search(index: CellIndex, queries: DataFrame, key: str, vector: str, k: int, probes: int, shortlist: int = 16) -> DataFrame:
    """key, match, score, rank: for each query of a stated set, the k best cosines among the shortlist * k rows of the
    `probes` nearest cells whose codes promise most; equal ones by the smaller match.

    A cell is met in blocks of BLOCK rows on average, so one that holds most rows is no single task. A block passes on
    what it promises most with its exact cosine, so no vector is fetched again.
    """
    probes, wide = min(probes, len(index.centres)), shortlist * k
    shared = queries.sparkSession.sparkContext.broadcast((index.centres, index.books))

    @F.pandas_udf("array<int>")
    def nearest_cells(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        far = -(np.stack(v.to_numpy()) @ shared.value[0].T)
        return pd.Series(list(np.argsort(far, axis=1, kind="stable")[:, :probes].astype("int32")))

    q = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), unit(F.col(vector)).alias("vec")).withColumn("cell", F.explode(nearest_cells("vec")))
    sizes = dict(index.rows.groupBy("cell").count().collect())  # one row a cell, of which there are sqrt(SAMPLE) by default
    blocks = F.create_map(*(F.lit(x) for c, n in sizes.items() for x in (int(c), -(-n // BLOCK))))
    of = lambda c: F.coalesce(F.element_at(blocks, F.col(c).cast("int")), F.lit(1))
    a = q.withColumn("block", F.explode(F.sequence(F.lit(0), of("cell").cast("int") - 1)))
    b = index.rows.withColumn("cell", F.col("cell").cast("int")).withColumn("block", F.pmod(F.xxhash64("key"), of("cell")).cast("int"))
    kinds = dict(q.dtypes)["key"], dict(index.rows.dtypes)["key"]

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(x) and len(y):
            centres, books = shared.value
            codes, vec, match = np.stack(y["codes"].to_numpy()), np.stack(y["vec"].to_numpy()), y["key"].to_numpy()
            for name, v in zip(x["key"], x["vec"]):
                table = np.einsum("pcw,pw->pc", books, v.reshape(len(books), -1))
                promised = sum(t[codes[:, p]] for p, t in enumerate(table)) + v @ centres[x["cell"].iloc[0]]
                top = np.argpartition(-promised, wide)[:wide] if len(promised) > wide else np.arange(len(promised))
                out.append(pd.DataFrame({"key": name, "match": match[top], "promised": promised[top], "score": vec[top] @ v}))
        return pd.concat(out) if out else pd.DataFrame({"key": [], "match": [], "promised": [], "score": []})

    met = a.groupBy("cell", "block").cogroup(b.groupBy("cell", "block")).applyInPandas(meet, f"key {kinds[0]}, match {kinds[1]}, promised double, score double")
    w = Window.partitionBy("key")
    short = met.withColumn("_n", F.row_number().over(w.orderBy(F.desc("promised"), "match"))).where(F.col("_n") <= wide)
    return short.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "match"))).where(F.col("rank") <= k).select("key", "match", "score", "rank")
