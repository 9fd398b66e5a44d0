"""SentencePiece encoding and decoding over a lattice of pieces.

Two forms of one method: substrings of bounded length are joined to the piece table by equality, the matches are the
edges of a word's lattice, and a fold over them picks the segmentation.

`viterbi` is relational throughout, for unigram tables: explode, equi-join, group by word, and a higher-order aggregate
that keeps the best score up to each character. A byte-pair table's own segmentation is not the best-scoring path, so
`encode` folds such lattices by merges (best edge of two neighbours first, leftmost at ties), for all the distinct words
of a batch at once in arrays; substrings are joined by 64-bit hashes of code points.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from stratalake.llm.common import WORDS_KEPT, ready, rows, texts

SPACE = "▁"
SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Words folded together, and characters beyond which a word is folded alone with a heap.
TOGETHER, LONG = 20_000, 48
_PRIME = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """Pieces with ids and scores, of a byte-pair model with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = len(sp)
        self.text = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.byte = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.ids = {self.text[i]: i for i in plain}
        order = np.unique([sp.get_score(i) for i in plain], return_inverse=True)[1]
        self.rank = np.zeros(n, np.int64)
        self.rank[plain] = order + 1
        self.longest = max(len(self.text[i]) for i in plain)
        hashes = np.array([self.hash(self.text[i]) for i in plain], np.uint64)
        at = np.argsort(hashes)
        self.hashes, self.hashed = hashes[at], np.array(plain, np.int32)[at]
        self.raw = np.empty(n, object)
        self.raw[:] = [t.replace(SPACE, " ").encode() for t in self.text]
        for value, i in self.byte.items():
            self.raw[i] = bytes([value])
        for i in range(n):
            if sp.is_control(i):
                self.raw[i] = b""

    @staticmethod
    def hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_PRIME) + ord(c) + 1) & (2**64 - 1)
        return h

    def lattice(self, points: np.ndarray, left: np.ndarray) -> np.ndarray:
        """id (or -1) of the piece of each length at each character; left: characters to the end of its word."""
        out = np.full((self.longest, len(points)), -1, np.int32)
        c = points.astype(np.uint64) + np.uint64(1)
        h = np.zeros(len(points), np.uint64)
        for k in range(self.longest):
            h = h[: len(points) - k] * _PRIME + c[k:]
            inside = np.nonzero(left[: len(h)] > k)[0]
            if not len(inside):
                break
            found = np.searchsorted(self.hashes, h[inside])
            found[found == len(self.hashes)] = 0
            hit = self.hashes[found] == h[inside]
            out[k, inside[hit]] = self.hashed[found[hit]]
        return out

    def fold(self, words: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each word."""
        size = np.array([len(w) for w in words])
        ends = np.cumsum(size)
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        edges = self.lattice(points, np.repeat(ends, size) - np.arange(len(points)))
        start, length, word = np.arange(len(points)), np.ones(len(points), np.int64), np.repeat(np.arange(len(words)), size)
        done_start, done_length = [], []
        while len(start):
            both = length[:-1] + length[1:]
            pair = np.nonzero((word[:-1] == word[1:]) & (both <= self.longest))[0]
            key = np.zeros(len(start), np.int64)
            piece = edges[both[pair] - 1, start[pair]]
            key[pair[piece >= 0]] = self.rank[piece[piece >= 0]] << 32 | (2**32 - 1 - pair[piece >= 0])
            first = np.nonzero(np.append(True, word[1:] != word[:-1]))[0]
            best = np.maximum.reduceat(key, first)
            at = 2**32 - 1 - (best[best > 0] & (2**32 - 1))
            length[at] += length[at + 1]
            live = np.repeat(best > 0, np.diff(np.append(first, len(start))))
            stays = np.ones(len(start), bool)
            stays[at + 1] = False
            done_start.append(start[~live])
            done_length.append(length[~live])
            live &= stays
            start, length, word = start[live], length[live], word[live]
        start, length = np.concatenate(done_start), np.concatenate(done_length)
        order = np.argsort(start)
        start, length = start[order], length[order]
        ids = edges[length - 1, start]
        counts = np.ones(len(ids), np.int64)
        unknown = np.nonzero(ids < 0)[0]
        if len(unknown):
            spelt = [[self.byte[b] for b in chr(points[start[i]]).encode()] for i in unknown]
            counts[unknown] = [len(s) for s in spelt]
            ids = np.repeat(ids, counts)
            ids[ids < 0] = [x for s in spelt for x in s]
        upto = np.cumsum(counts)[np.searchsorted(start, ends) - 1].tolist()
        raw = ids.astype("<u4").tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *upto], upto)]

    def fold_long(self, word: str) -> bytes:
        """The same for one word, with a heap: n log n."""
        after, before, end = list(range(1, len(word) + 1)), list(range(-1, len(word))), list(range(1, len(word) + 1))
        heap: list = []

        def offer(a: int) -> None:
            b = after[a]
            if b < len(word) and (i := self.ids.get(word[a : end[b]])) is not None:
                heapq.heappush(heap, (-int(self.rank[i]), a, end[a], end[b]))

        gone = [False] * len(word)
        for a in range(len(word)):
            offer(a)
        while heap:
            _, a, mid, stop = heapq.heappop(heap)
            b = after[a]
            if gone[a] or end[a] != mid or b >= len(word) or end[b] != stop:
                continue
            gone[b], end[a], after[a] = True, stop, after[b]
            if after[a] < len(word):
                before[after[a]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        out: list[int] = []
        a = 0
        while a < len(word):
            i = self.ids.get(word[a : end[a]])
            out += [i] if i is not None else [self.byte[x] for x in word[a : end[a]].encode()]
            a = after[a]
        return np.array(out, "<u4").tobytes()


class Encoder:
    """Ids of whole texts from the ids of their words; pieces never hold a space mark after another character, so a
    text's merges stay inside its words."""

    def __init__(self, path: str):
        self.pieces, self.known = Pieces(path), {}

    def encode(self, all_texts: list[str | None]) -> list[np.ndarray]:
        words = [SEGMENT.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in all_texts]
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        new = sorted({w for ws in words for w in ws}.difference(self.known), key=len)
        short = [w for w in new if len(w) <= LONG]
        for i in range(0, len(short), TOGETHER):
            part = short[i : i + TOGETHER]
            self.known.update(zip(part, self.pieces.fold(part)))
        for w in new[len(short) :]:
            self.known[w] = self.pieces.fold_long(w)
        return [np.frombuffer(b"".join(map(self.known.__getitem__, ws)), "<u4") for ws in words]

    def decode(self, ids: np.ndarray) -> str:
        """The text: pieces joined, space marks as spaces, without the mark that encoding put in front."""
        raw = b"".join(self.pieces.raw[ids])
        return (raw[1:] if raw.startswith(b" ") else raw).decode("utf-8", "replace")


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids (array<int>) for each row of docs; null and empty texts have no ids. Other columns are ignored; very
    long words take a heap instead of arrays, with equal results."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model_path)
        for b in batches:
            found = encoder.encode([t for (t,) in rows(b, "text")])
            flat = np.concatenate(found).astype(np.int32) if found else np.empty(0, np.int32)
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(ends, pa.array(flat))], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text for rows with ids; null ids count as none."""
    ready(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model_path)
        for b in batches:
            lists = b.column(1)
            out = [encoder.decode(lists[i].values.to_numpy(zero_copy_only=False)) if lists[i].is_valid else "" for i in range(len(lists))]
            yield pa.record_batch([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian 32-bit), decoded_sha256 of each text encoded and decoded again."""
    import hashlib

    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model_path)
        for b in batches:
            out = [(len(x), zlib.crc32(x.tobytes()), hashlib.sha256(encoder.decode(x).encode()).hexdigest()) for x in encoder.encode([t for (t,) in rows(b, "text")])]
            n, crc, sha = zip(*out) if out else ((), (), ())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_ids", "ids_crc32", "decoded_sha256"])

    return texts(docs).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string")


def relational(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids: the rows of `encode` from joins and higher-order functions alone.

    Distinct words are exploded into bounded substrings, joined to the piece table by equality, grouped into a lattice,
    and folded by merges; a second join gives each occurrence its word's ids. The piece table is bounded by its model
    and broadcast. Words of more than LONG characters take the heap. Null and empty texts have no ids; rows that repeat
    get equal ids. `encode` gives the same with nothing moved, see README for the figures of both.
    """
    spark = ready(docs.sparkSession)
    p = Pieces(model_path)
    table = spark.createDataFrame([(t, int(p.rank[i]) << 32 | i) for t, i in p.ids.items()], "piece string, code long")
    # equal texts have equal ids, so only different texts of one doc_id could be mistaken for each other
    keyed = texts(docs).withColumn("key", F.struct(F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("hash")))
    marked = F.concat(F.lit(SPACE), F.replace("text", F.lit(" "), F.lit(SPACE)))
    placed = keyed.where("text <> ''").dropDuplicates(["key"]).select("key", F.posexplode(F.regexp_extract_all(marked, F.lit(SEGMENT.pattern), F.lit(0))).alias("pos", "word"))
    each = placed.select("word").distinct()
    short = each.where(F.length("word") <= LONG)
    spans = short.select("word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("begin"))
    spans = spans.select("word", "begin", F.explode(F.sequence(F.col("begin") + 1, F.least(F.col("begin") + p.longest, F.length("word")))).alias("end"))
    spans = spans.withColumn("piece", F.substring(F.col("word"), F.col("begin") + 1, F.col("end") - F.col("begin")))
    edges = spans.join(F.broadcast(table), "piece").groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct((F.col("begin") * 64 + F.col("end")).alias("k"), "code"))).alias("edges"))
    lattice = short.join(edges, "word", "left")

    code = lambda begin, end: F.coalesce(F.try_element_at("edges", begin * 64 + end), F.lit(0).cast("long"))
    before = lambda ends, i: F.coalesce(F.get(ends, i - 1), F.lit(0))

    def merge(ends, _):
        pairs = F.transform(F.slice(ends, F.lit(2), F.size(ends)), lambda e, i: F.struct(F.shiftright(code(before(ends, i), e), 32).alias("rank"), (-i).alias("left")))
        best = F.array_max(pairs)
        return F.transform(F.array(best), lambda b: F.when(b["rank"] > 0, F.filter(ends, lambda e, j: j != -b["left"])).otherwise(ends))[0]

    spelt = F.array(*(F.lit(p.byte[b]) for b in range(256)))

    def ids(e, begin):
        raw = F.encode(F.substring(F.col("word"), begin + 1, e - begin), "UTF-8")
        byte = lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("int")
        fallback = F.transform(F.sequence(F.lit(1), F.octet_length(raw)), lambda i: F.get(spelt, byte(i)))
        return F.transform(F.array(code(begin, e)), lambda c: F.when(c > 0, F.array(c.bitwiseAND(F.lit(2**32 - 1)).cast("int"))).otherwise(fallback))[0]

    folded = lattice.withColumn("ends", F.aggregate(F.sequence(F.lit(1), F.length("word")), F.sequence(F.lit(1), F.length("word")), merge))
    folded = folded.select("word", F.flatten(F.transform("ends", lambda e, i: ids(e, before(F.col("ends"), i)))).alias("part"))

    def heap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pieces(model_path)
        for b in batches:
            parts = [np.frombuffer(own.fold_long(w), "<u4").astype(np.int32).tolist() for w in b.column(0).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(parts, pa.list_(pa.int32()))], ["word", "part"])

    known = folded.unionByName(each.where(F.length("word") > LONG).mapInArrow(heap, "word string, part array<int>"))
    whole = placed.join(known, "word").groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"])).alias("ids"))
    return keyed.join(whole, "key", "left").select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


def viterbi(words: DataFrame, pieces: DataFrame, unknown: float = -100.0) -> DataFrame:
    """word, pieces (array<string>), score: the best-scoring segmentation of each distinct word, for a unigram table.

    words: column word; pieces: columns piece and score (best score of repeats counts). A character that is no piece
    costs `unknown`. At ties the segmentation whose last piece is longer wins. Null words are left out, the empty word
    has no pieces. The piece table, bounded by its model, is broadcast below Spark's own threshold or else shuffled.
    """
    table = pieces.where("piece is not null and piece <> ''").groupBy("piece").agg(F.max("score").cast("double").alias("score"))
    longest = table.agg(F.max(F.length("piece"))).first()[0] or 1
    each = words.select("word").where("word is not null").distinct()
    spans = each.withColumn("begin", F.explode(F.sequence(F.lit(1), F.greatest(F.length("word"), F.lit(1))))).withColumn(
        "size", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("begin") + 1)))))
    spans = spans.withColumn("piece", F.substring(F.col("word"), F.col("begin"), F.col("size")))
    edges = spans.join(table, "piece", "left").where("score is not null or size = 1")
    edges = edges.select("word", F.struct((F.col("begin") + F.col("size") - 1).alias("end"), F.col("size"), F.coalesce("score", F.lit(unknown)).alias("score"), "piece").alias("edge"))
    lattice = edges.groupBy("word").agg(F.array_sort(F.collect_list("edge")).alias("edges"))
    # best[i]: score and segmentation of the first i characters; edges come by end, each looks back to its begin
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("path")))

    def step(best, e):
        prior = F.element_at(best, e["end"] - e["size"] + 1)
        new = F.struct((prior["score"] + e["score"]).alias("score"), F.concat(prior["path"], F.array(e["piece"])).alias("path"))
        return F.when(F.size(best) <= e["end"], F.concat(best, F.array(new))).when(
            new["score"] >= F.element_at(best, -1)["score"], F.concat(F.slice(best, F.lit(1), F.size(best) - 1), F.array(new))).otherwise(best)

    last = F.element_at(F.aggregate("edges", start, step), -1)
    return lattice.where("word <> ''").select("word", last["path"].alias("pieces"), last["score"].alias("score")).union(
        each.where("word = ''").select("word", F.array().cast("array<string>"), F.lit(0.0)))
