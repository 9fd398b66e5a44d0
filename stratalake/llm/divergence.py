"""How far the words of one source are from those of another: exact chi-square divergences between all sources of a language.

Word counts are combined in the tasks that read the texts, then dealt by language and a hash of the term ("shards", of
bounded size however large a source or a vocabulary is). A source's counts in a shard are one sparse vector, which stays
where its block of sources is: in each round of a tournament compressed copies of the blocks move on by one place of the
ring, and a meeting of two blocks gives both directions for each of their pairs. A ring of B blocks needs half of B rounds,
after which every two blocks have met exactly once. Partial sums are added over shards; of the terms, each task keeps those
of the best ranks on a heap.

All arithmetic is on whole numbers. With N counts and V kept terms, shares are 1 + floor(10^9 (count + 1) / (N + V)); sums
of f over a vocabulary stay below (10^9 + V)^2, so 64 bits hold them while V is below 2 * 10^9.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from stratalake.llm.common import cut, ready, rows

#: A term counts in a language where at least so many of its documents hold it, and a group lists so many terms at most.
LEAST_DOCUMENTS, TOP_TERMS = 3, 200
#: Distinct (language, source, term) that a task combines before it hands them on; documents for each shard of a vocabulary
#: (a document adds its distinct words at most); sources in a block.
HELD, SHARD_DOCUMENTS, BLOCK_SOURCES = 300_000, 400, 8
#: The unit of shares.
UNIT = 10**9

#: Bytes other than ASCII letters and those of larger characters part words; A-Z become a-z.
_FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with the term), combined within tasks: several rows for one
    term may follow. A group without terms has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in groups.items():
                keys = list(n)
                if keys:
                    yield pa.record_batch([pa.array([lang] * len(keys)), pa.array([source] * len(keys)), pa.array(keys, pa.binary()).cast(pa.string()),
                                           pa.array(list(n.values()), pa.int64()), pa.array([d[k] for k in keys], pa.int64())], ["lang", "source", "term", "n", "docs"])
            groups.clear()

        groups: dict = defaultdict(lambda: (Counter(), Counter()))
        for b in batches:
            for lang, source, text in rows(b, "lang", "source", "text"):
                words = text.encode().translate(_FOLDED).split()
                n, d = groups[lang, source]
                n.update(words)
                d.update(set(words))
            if sum(len(n) for n, _ in groups.values()) > HELD:
                yield from flush()
        yield from flush()

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(n: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(UNIT * (n + 1) / total) by long division in steps of 1000: exact for totals up to 9 * 10^15."""
    rest, out = n + 1, 0
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def squares(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def packed(places: np.ndarray, counts: np.ndarray) -> bytes:
    """A sparse vector, compressed: places ascending as differences, then counts."""
    return zlib.compress(np.concatenate([np.diff(places, prepend=0), counts]).astype(np.int64).tobytes(), 1)


def unpacked(vector: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    if vector is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, counts = np.frombuffer(zlib.decompress(vector), np.int64).reshape(2, -1)
    return np.cumsum(at), counts


def shares_in(vector: bytes | None, total: int, size: int) -> tuple:
    """(places, counts, total, shares of all terms of the shard): the shares only where many terms occur."""
    places, counts = unpacked(vector)
    if 16 * len(places) < size:
        return places, counts, total, None
    n = np.zeros(size, np.int64)
    n[places] = counts
    return places, counts, total, share(n, total)


def meeting(a: tuple, b: tuple, size: int) -> tuple[int, int]:
    """Sums of f over the size terms of a shard, for a against b and for b against a."""
    if a[3] is not None and b[3] is not None:
        square = (a[3] - b[3]) ** 2
        return int((square // b[3]).sum()), int((square // a[3]).sum())
    at = np.union1d(a[0], b[0])
    shares = []
    for places, counts, total, _ in (a, b):
        n = np.zeros(len(at), np.int64)
        n[np.searchsorted(at, places)] = counts
        shares.append(np.append(share(n, total), share(np.zeros(1, np.int64), total)))
    weight = np.append(np.ones(len(at), np.int64), size - len(at))  # terms that neither has are alike
    return tuple(int((squares(p, q) * weight).sum()) for p, q in (shares, shares[::-1]))


def shard_vectors(counts: DataFrame, least: int) -> DataFrame:
    """From lang, shard, source, term, n, docs (a row for each): in each shard the kept terms, and a vector for each source
    that has any. The row without a source has the terms (compressed) and the counts of the whole language."""
    names = ["lang", "shard", "source", "total", "size", "vector", "terms"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def coded(column) -> tuple[np.ndarray, pa.Array]:
        d = column.combine_chunks().dictionary_encode()
        d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
        return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary

    def run(key: tuple, t: pa.Table) -> pa.Table:
        lang, shard = (k.as_py() for k in key)
        (term, words), (source, sources) = coded(t["term"]), coded(t["source"])
        n, docs, every = t["n"].to_numpy(), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        np.add.at(docs, term, t["docs"].to_numpy())
        np.add.at(every, term, n)
        kept = docs >= least
        out = []
        if kept.any():
            place, size = np.cumsum(kept) - 1, int(kept.sum())
            held = zlib.compress("\n".join(words.filter(pa.array(kept)).to_pylist()).encode(), 1)
            out.append((lang, shard, None, 0, size, packed(np.arange(size), every[kept]), held))
            row = np.flatnonzero(kept[term])
            row = row[np.lexsort((place[term[row]], source[row]))]
            for part in np.split(row, np.flatnonzero(np.diff(source[row])) + 1):
                out.append((lang, shard, sources[int(source[part[0]])].as_py(), int(n[part].sum()), size, packed(place[term[part]], n[part]), None))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(kinds), kinds)], names)

    return counts.groupBy("lang", "shard").applyInArrow(run, "lang string, shard int, source string, total long, size long, vector binary, terms binary")


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, block: int = BLOCK_SOURCES) -> DataFrame:
    """lang, source, part, item, value, rank: the other sources of the language by their divergence (part pair, all), and
    the terms in which a source exceeds its language most (part term, the first `top`).

    docs: text, lang, source; nulls are empty strings, hence a language and a source of their own. Every row counts as a
    document, equal rows too. Groups without terms take part with zero counts; a language without kept terms has values
    of 0; a language of one source has no pairs; an empty table gives no rows. Equal values rank by item in UTF-8 order.
    Other columns are ignored.
    """
    ready(docs.sparkSession)
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    shards = max(64, docs.count() // SHARD_DOCUMENTS)
    # dealt by language and shard once: sums and vectors are made where the rows then are
    counts = (term_counts(docs).withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int")).repartition("lang", "shard")
              .groupBy("lang", "shard", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    found = cut(shard_vectors(counts, least))
    vectors, vocabulary = found.where("source is not null").drop("terms"), found.where("source is null").drop("source", "total")

    # what is known of languages and groups: a row each
    langs = docs.select("lang").distinct().join(vocabulary.groupBy("lang").agg(F.sum("size").alias("kept")), "lang", "left").fillna(0, ["kept"])
    groups = docs.select("lang", "source").distinct().join(vectors.groupBy("lang", "source").agg(F.sum("total").alias("total")), ["lang", "source"], "left").fillna(0, ["total"])
    langs = langs.join(groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count(F.lit(1)).alias("sources")), "lang")
    langs = langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("sources") / block)).cast("int")).drop("sources")
    groups = cut(groups.join(langs, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")))

    # a block's row in a shard: its sources (those without counts there too) with their totals and compressed vectors
    members = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    blocks = members.join(vectors.select("lang", "shard", "source", "vector"), ["lang", "shard", "source"], "left").groupBy(
        "lang", "shard", "block", "blocks", "kept", "lang_total").agg(F.collect_list(F.struct("source", "total", "vector")).alias("sources"))
    blocks = cut(blocks.join(vocabulary.select("lang", "shard", "size"), ["lang", "shard"], "left").fillna(0, ["size"]))

    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    both = pairs(blocks).unionByName(terms(blocks, vocabulary, top))
    return both.withColumn("rank", F.row_number().over(ranked)).where((F.col("part") == "pair") | (F.col("rank") <= top))


def terms(blocks: DataFrame, vocabulary: DataFrame, top: int) -> DataFrame:
    """lang, source, part, item, value: of each source in each shard the `top` terms, by a heap in its task."""
    names, kinds = ["lang", "source", "part", "item", "value"], [pa.string()] * 4 + [pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for lang, sources, kept, lang_total, held, vector in rows(b, "lang", "sources", "kept", "lang_total", "terms", "vector"):
                words = zlib.decompress(held).decode().split("\n")
                q = share(unpacked(vector)[1], lang_total + kept)
                for s in sources:
                    places, n = unpacked(s["vector"])
                    p = share(n, s["total"] + kept)
                    above = np.flatnonzero(p > q[places])
                    value = squares(p[above], q[places[above]]).tolist()
                    best = heapq.nsmallest(top, ((-v, words[k]) for v, k in zip(value, places[above].tolist())))
                    out += [(lang, s["source"], "term", term, -less) for less, term in best]
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    held = blocks.join(vocabulary.drop("size"), ["lang", "shard"])
    return held.select("lang", "sources", "kept", "lang_total", "terms", "vector").mapInArrow(run, "lang string, source string, part string, item string, value long")


def pairs(blocks: DataFrame) -> DataFrame:
    """lang, source, part, item, value: both directions of every two sources of a language, by a ring of blocks."""
    # in round r the copy of block b is at place (b + r) mod blocks; with an even number the last round meets each pair twice, so half of it goes
    moving = blocks.select("lang", "shard", F.col("block").alias("peer_block"), "blocks", F.col("sources").alias("peers"),
                           F.explode(F.sequence(F.lit(0), (F.col("blocks") / 2).cast("int"))).alias("round"))
    moving = moving.where((F.col("round") * 2 != F.col("blocks")) | (F.col("peer_block") * 2 < F.col("blocks")))
    moving = moving.withColumn("block", F.pmod(F.col("peer_block") + F.col("round"), F.col("blocks"))).drop("blocks")
    met = moving.join(blocks.hint("shuffle_hash"), ["lang", "shard", "block"])
    names, kinds = ["lang", "source", "item", "value"], [pa.string()] * 3 + [pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for lang, number, size, kept, ours, theirs in rows(b, "lang", "round", "size", "kept", "sources", "peers"):
                ours, theirs = ([(s["source"], shares_in(s["vector"], s["total"] + kept, size)) for s in side] for side in (ours, theirs))
                for name, a in ours:
                    for peer, c in theirs:
                        if number or name < peer:
                            there, back = meeting(a, c, size) if size else (0, 0)
                            out += [(lang, name, peer, there), (lang, peer, name, back)]
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    partial = met.select("lang", "round", "size", "kept", "sources", "peers").mapInArrow(run, "lang string, source string, item string, value long")
    return partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
