"""Directions: words that a corpus opposes to each other, questions turned round, and recordings ranked by the way they change."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from stratalake.functions.scalar import dot, unit
from stratalake.operators import analytics, text
from stratalake.operators.intervals import containing
from stratalake.operators.lsa import lists


#: Rows of a lexicon that is met by broadcast; a larger one is joined by shuffle.
SMALL = 100_000
#: Terms whose sums a task holds, and rows that it meets at once, on average.
HELD, PART = 20_000, 1 << 16


def _met(pairs: DataFrame) -> DataFrame:
    return F.broadcast(pairs) if pairs.count() <= SMALL else pairs


def term_means(docs: DataFrame, terms: DataFrame, body: str, vector: str) -> DataFrame:
    """term, vec: the mean vector of the rows whose text has the term, for the terms given.

    Terms are dealt into blocks by hash. A row sends each block its vector once and the hashes of its words there, and sums
    are made where a block meets some PART rows, so that sums leave for each of these and not for each task that reads rows.
    A word counts as a term if their 64-bit hashes are equal; vectors are of one length.
    """
    ws = F.array_distinct(text.words(F.col(body)))
    rows = docs.where(F.col(body).isNotNull() & F.col(vector).isNotNull()).select(F.transform(ws, lambda w: F.xxhash64(w)).alias("h"), F.col(vector).cast("array<double>").alias("v"))
    parts, blocks = max(1, -(-docs.count() // PART)), max(8, -(-terms.count() // HELD))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(lo, 256) for b in batches for lo in range(0, len(b), 256)):
            size, h = lists(b.column("h"))
            at = np.repeat(np.arange(len(size)), size) * blocks + h % blocks
            order = np.argsort(at, kind="stable")
            at, first = np.unique(at[order], return_index=True)
            held = pa.ListArray.from_arrays(np.append(first, len(h)).astype(np.int32), pa.array(h[order]))
            yield pa.record_batch([pa.array(at % blocks), held, b.column("v").take(pa.array(at // blocks)), b.column("part").take(pa.array(at // blocks))], ["block", "h", "v", "part"])

    def sums(a: pa.Table, b: pa.Table) -> pa.Table:
        named = np.array([], np.int64)
        total, n = np.empty((0, 1)), np.array([], np.int64)
        if len(a) and len(b):
            order = np.argsort(b.column("h").to_numpy())
            known, names = b.column("h").to_numpy()[order], b.column("term").combine_chunks().take(pa.array(order))
            size, h = lists(a.column("h").combine_chunks())
            v = lists(a.column("v").combine_chunks())[1].reshape(len(size), -1)
            row, at = np.repeat(np.arange(len(size)), size), np.searchsorted(known, h)
            ok = known[np.minimum(at, len(known) - 1)] == h
            row, at = row[ok], at[ok]
            total, n = np.zeros((len(known), v.shape[1])), np.bincount(at, minlength=len(known))
            for lo in range(0, len(row), HELD):
                order = np.argsort(at[lo : lo + HELD], kind="stable")
                to, first = np.unique(at[lo : lo + HELD][order], return_index=True)
                total[to] += np.add.reduceat(v[row[lo : lo + HELD][order]], first)
            named = np.flatnonzero(n)
            total, n = total[named], n[named]
        names = names.take(pa.array(named)) if len(named) else pa.array([], pa.string())
        vectors = pa.ListArray.from_arrays(np.arange(0, total.size + 1, total.shape[1], dtype=np.int32), pa.array(total.ravel()))
        return pa.table([names, vectors, pa.array(n)], ["term", "sums", "n"])

    sent = rows.withColumn("part", F.pmod(F.xxhash64("h", "v"), F.lit(parts))).mapInArrow(deal, "block long, h array<long>, v array<double>, part long")
    asked = terms.select("term", F.xxhash64("term").alias("h")).withColumn("block", F.pmod("h", F.lit(blocks)))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    part = sent.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(sums, "term string, sums array<double>, n long")
    each = part.groupBy("term").agg(F.collect_list("sums").alias("sums"), F.sum("n").alias("n"))  # a list of `parts` at most
    whole = F.aggregate(F.slice("sums", F.lit(2), F.size("sums")), F.get("sums", F.lit(0)), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    return each.withColumn("sums", whole).select("term", F.transform("sums", lambda x: x / F.col("n")).alias("vec"))


def shared_contexts(docs: DataFrame, body: str, pairs: DataFrame) -> DataFrame:
    """a, b, shared: how many different words stand right before both of two terms. Terms meet their contexts by equi-joins."""
    ws = text.words(F.col(body))
    steps = F.zip_with(F.slice(ws, F.lit(1), F.size(ws) - 1), F.slice(ws, F.lit(2), F.size(ws) - 1), lambda x, y: F.struct(x.alias("before"), y.alias("term")))
    paired = pairs.select(F.explode(F.array("a", "b")).alias("term")).distinct()
    before = docs.where(F.size(ws) > 1).select(F.explode(steps).alias("s")).select("s.before", "s.term").join(_met(paired), "term").distinct()
    of = lambda side: before.select("before", F.col("term").alias(side))
    return pairs.join(of("a"), "a").join(of("b"), ["b", "before"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def lexicon(terms: DataFrame, docs: DataFrame, body: str, least: float = 0.25, contexts: int = 3) -> DataFrame:
    """a, b, far, shared: terms (term, vec) that point away from each other once what all share is taken away, by a cosine
    of -least or less, and that `contexts` words or more of docs stand before both. Each pair once, a before b.

    A term's partner is the one most unlike it. Fewer than two terms oppose nothing; null vectors take no part.
    """
    far = analytics.opposites(terms, "term", "vec", "far").where(F.col("far") <= -least)
    pairs = far.select(F.least("term", "opposite").alias("a"), F.greatest("term", "opposite").alias("b"), "far").groupBy("a", "b").agg(F.min("far").alias("far")).checkpoint()
    return pairs.join(shared_contexts(docs, body, pairs), ["a", "b"]).where(F.col("shared") >= contexts)


def swapped(questions: DataFrame, key: str, body: str, pairs: DataFrame) -> DataFrame:
    """key, swap: each question in lower case with one word turned into its opposite. Of the words that have one, the pair
    with the longest word counts, then the first in order, of its words the first (a), of that its first place. Questions without any have no row; keys
    are unique.

    A token join: words between spaces meet the pairs in both directions, and a grouped minimum chooses, so that no
    question is looked at pair by pair.
    """
    size = F.greatest(F.length("a"), F.length("b"))
    ways = pairs.select("a", "b", size.alias("size"), F.explode(F.array(F.struct(F.col("a").alias("from"), F.col("b").alias("to"), F.lit(0).alias("way")), F.struct(F.col("b").alias("from"), F.col("a").alias("to"), F.lit(1).alias("way")))).alias("w"))
    ways = ways.select("a", "b", "size", "w.*")
    asked = questions.select(key, F.lower(body).alias("body"))
    met = asked.select(key, F.posexplode(F.split("body", " ")).alias("at", "from")).where("`from` <> ''").join(_met(ways), "from")
    first = met.groupBy(key).agg(F.min_by(F.struct("at", "to"), F.struct(-F.col("size"), "a", "b", "way", "at")).alias("m"))
    return asked.join(first, key).select(key, F.array_join(F.transform(F.split("body", " "), lambda w, i: F.when(i == F.col("m.at"), F.col("m.to")).otherwise(w)), " ").alias("swap"))


def changing(places: DataFrame, recordings: DataFrame, by: str, question: DataFrame, top: int) -> DataFrame:
    """by, r0, r1, score: of the recordings that hold one of the places, the `top` whose change points most nearly from the
    swapped question to the question.

    places: by, t0, t1, the content that is plausible at all; recordings: by, r0, r1 (apart from each other), vec (unit
    change between their ends); question: one row, vec and swap. A question equal to its swap has no direction, and no rows.
    """
    line = question.select(F.zip_with("vec", "swap", lambda x, y: x.cast("double") - y.cast("double")).alias("d")).where(dot(F.col("d"), F.col("d")) > 1e-12).select(unit(F.col("d")).alias("d"))
    held = containing(places.select(by, F.col("t0").alias("at"), "t1"), recordings, [by], "at", "r0", "r1").where("t1 <= r1 + 1").select(by, "r0", "r1").distinct()
    scored = recordings.join(held, [by, "r0", "r1"]).join(F.broadcast(line), F.lit(True)).select(by, "r0", "r1", F.round(dot(F.col("vec"), F.col("d")), 9).alias("score"))
    return scored.orderBy(F.desc("score"), by, "r0").limit(top)
