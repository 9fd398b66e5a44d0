"""Byte-level BPE by higher-order functions.

A word (a match of the pattern) becomes an array of one-byte pieces; a fold merges the neighbours of the lowest rank,
leftmost first, until no two neighbours have a rank. Ranks are a literal of the plan: a perfect hash over arrays, so that a
look-up costs the same whatever the size of the vocabulary. Every distinct word is folded in the plan: frequent ones once,
beforehand, to be broadcast, and all others once each, grouped by word. Texts are dealt in blocks and hold their words as
numbers; a block meets the ids of its own words in a join, so that no word is shuffled to a document. What is shuffled is
packed: numbers by frequency, a block's own words in order, and the ids that go back to a block in one row a task.

`encode_in_plan` does without Python, and folds every rare word where it stands.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import Column, DataFrame

from stratalake.llm.common import ready, rows, texts

#: Distinct words folded beforehand, at most, and how many rows (about) they are taken from. Parameters of speed: words that
#: are not among them are folded by block, so neither changes an id.
FREQUENT, FROM_ROWS = 1 << 18, 20_000
#: Bytes of the longest word that is folded in one go; longer ones are folded by windows, of this length at first.
LONG = 128
#: Bytes beyond which a word is not folded but merged by the heap in its block's task: a fold of a megabyte didn't end in 100 s.
HUGE = 1 << 13
#: Words, and distinct words that are not frequent, at which a block of texts ends; words whose ids are put together at once.
BLOCK_WORDS, BLOCK_RARE, AT_ONCE = 1 << 20, 1 << 17, 1 << 18
#: Characters of distinct words that are not frequent, at which a block ends too: these words may be long.
BLOCK_CHARS = 1 << 24
#: Rank of neighbours that don't merge.
NONE = (1 << 31) - 1
#: Parts the entries of a literal; no one-byte character.
_PART = "Ā"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def bound(value: Column, f) -> Column:
    """f(value), the value computed once. A fold over nothing that ends with f: unlike transform, it copies neither."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, f)


def _numbers(xs) -> Column:
    return F.split(F.lit(",".join(map(str, xs))), ",").cast("array<int>")


class Slots:
    """Strings as a literal of the plan that is looked up by arithmetic: a perfect hash over arrays.

    A string's hash names a bucket, whose displacement moves all its strings to free slots; buckets are placed from the
    fullest to the emptiest. A literal is a text in the plan, split once when the plan is optimised.
    """

    def __init__(self, strings: list[str]):
        self.strings, self.slots, self.buckets = strings, max(1021, 4 * len(strings) // 3), max(64, len(strings) // 3)
        while any(self.slots % d == 0 for d in range(2, math.isqrt(self.slots) + 1)):
            self.slots += 1  # a prime: every step reaches every slot
        members: list[list[tuple[int, int, int]]] = [[] for _ in range(self.buckets)]
        for k, s in enumerate(strings):
            h = xxhash.xxh64_intdigest(s.encode(), 42)
            members[(h & 0xFFFFF) % self.buckets].append((k, h >> 20, (h >> 44) % (self.slots - 1) + 1))
        self.moves, self.held = [0] * self.buckets, [-1] * self.slots
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            for move in range(1 << 20):
                to = {(start + move * step) % self.slots: k for k, start, step in members[b]}
                if len(to) == len(members[b]) and all(self.held[t] < 0 for t in to):
                    break
            else:
                raise ValueError("two strings share a hash")
            self.moves[b] = move
            for t, k in to.items():
                self.held[t] = k

    def literal(self, **others: Column) -> Column:
        keys = F.split(F.lit(_PART.join(self.strings[k] if k >= 0 else "" for k in self.held)), _PART, -1)
        return F.struct(keys.alias("keys"), _numbers(self.held).alias("places"), _numbers(self.moves).alias("moves"), *(c.alias(n) for n, c in others.items()))

    def place(self, table: Column, string: Column) -> Column:
        """The place of a string in the list, null where it isn't there; table: the literal. The empty string is never there."""

        def slot(h: Column) -> Column:
            move = F.get(table["moves"], (h.bitwiseAND(F.lit(0xFFFFF)) % self.buckets).cast("int"))
            return ((F.shiftrightunsigned(h, 20) + move * (F.shiftrightunsigned(h, 44) % (self.slots - 1) + 1)) % self.slots).cast("int")

        return bound(bound(F.xxhash64(string), slot), lambda s: F.when((F.get(table["keys"], s) == string) & (string != ""), F.get(table["places"], s)))


class RankMap:
    """Ranks of byte strings. Bytes are characters of the same number, so that pieces are strings."""

    def __init__(self, ranks: dict[bytes, int]):
        self.pieces = sorted(ranks, key=ranks.__getitem__)
        if [ranks[p] for p in self.pieces] != list(range(len(ranks))):
            raise ValueError("ranks are not 0, 1, 2, ...")
        self.ranks = ranks
        self.slots = Slots([p.decode("latin-1") for p in self.pieces])

    def literal(self) -> Column:
        return self.slots.literal()

    def of(self, table: Column, pieces: Column) -> Column:
        """The rank of each piece, NONE where it has none; table: the literal."""
        return F.transform(pieces, lambda p: F.coalesce(self.slots.place(table, p), F.lit(NONE)))

    def fold(self, table: Column, word: Column) -> Column:
        """array<int>: the ids of a word, its neighbours merged lowest rank first, of equal ranks the leftmost."""
        of = lambda xs: self.of(table, xs)

        def merged(p: Column, r: Column, i: Column) -> Column:
            """Pieces i and i + 1 (from 1) made one; only its two neighbours' ranks are looked up anew."""
            def made(m: Column) -> Column:
                near = F.concat(F.transform(F.slice(p, F.greatest(i - 1, F.lit(1)), F.least(i - 1, F.lit(1))), lambda x: F.concat(x, m)),
                                F.transform(F.slice(p, i + 2, F.lit(1)), lambda x: F.concat(m, x)))
                return F.struct(F.concat(F.slice(p, F.lit(1), i - 1), F.array(m), F.slice(p, i + 2, F.size(p))).alias("p"),
                                F.concat(F.slice(r, F.lit(1), F.greatest(i - 2, F.lit(0))), of(near), F.slice(r, i + 2, F.size(r))).alias("r"))

            return bound(F.concat(F.get(p, i - 1), F.get(p, i)), made)

        def step(s: Column, _: Column) -> Column:
            place = lambda low: F.when(low == NONE, s).otherwise(bound(F.array_position(s["r"], low).cast("int"), lambda i: merged(s["p"], s["r"], i)))
            return F.when(F.size(s["r"]) == 0, s).otherwise(bound(F.array_min(s["r"]), place))

        def begun(p: Column) -> Column:
            near = F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), lambda a, b: F.concat(a, b))
            return F.struct(p.alias("p"), of(near).alias("r"))

        def folded(p: Column) -> Column:
            """The pieces that one-byte pieces become."""
            return F.when(F.size(p) < 2, p).otherwise(F.aggregate(F.sequence(F.lit(2), F.size(p)), bound(p, begun), step, lambda s: s["p"]))

        def by_windows(b: Column) -> Column:
            """As folded of a word's bytes, in time that grows with the length.

            A window begins with the last piece that was taken and must give that piece again. So all neighbours taken are
            what folding makes of their own bytes, and then no merge of the whole word crosses them: the first that did would
            be the first among the bytes of these two as well. What is near the cut is not taken; where a window gives
            another first piece, the word is begun again with windows twice as long, at last with one of the whole word.
            """
            n = F.octet_length(b)

            def state(done: Column, at: Column, width: Column, first: Column, ended: Column, read: Column, w: Column) -> Column:
                return F.struct(done.alias("done"), at.alias("at"), width.alias("width"), first.alias("first"), ended.alias("ended"), read.alias("read"), w.alias("w"))

            def begin(width: Column) -> Column:
                return state(F.array().cast("array<array<string>>"), F.lit(1), width, F.lit(""), F.lit(False), F.lit(b""), F.array().cast("array<string>"))

            def took(s: Column, x: Column, w: Column) -> Column:
                """The state after a window of the bytes x with the pieces w."""
                last = s["at"] + s["width"] > n
                ends = F.aggregate(w, F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("k"), F.lit(0).alias("start")),
                                   lambda c, y: F.when((c["k"] >= 2) & (c["bytes"] + F.length(y) > s["width"] / 2), c).otherwise(
                                       F.struct((c["bytes"] + F.length(y)).alias("bytes"), (c["k"] + 1).alias("k"), c["bytes"].alias("start"))))

                def on(c: Column) -> Column:
                    skip = F.when(s["first"] == "", F.lit(0)).otherwise(F.lit(1))
                    kept = F.when(last, F.size(w)).otherwise(c["k"])
                    first = F.when(last, F.lit("")).otherwise(F.get(w, c["k"] - 1))
                    return state(F.concat(s["done"], F.array(F.slice(w, skip + 1, kept - skip))), (s["at"] + c["start"]).cast("int"), s["width"], first, last, x, w)

                wrong = ((s["first"] != "") & (F.get(w, F.lit(0)) != s["first"])) | (~last & (F.size(w) < 3))
                return F.when(wrong, begin(s["width"] * 2)).otherwise(bound(ends, on))

            def window(s: Column, _: Column) -> Column:
                """A window that equals the last one, as in long runs of the same characters, is not folded again."""
                pieces = lambda x: F.when(x == s["read"], s["w"]).otherwise(bound(chars(x), folded))
                read = lambda x: bound(pieces(x), lambda w: took(s, x, w))
                return F.when(s["ended"], s).otherwise(bound(F.substring(b, s["at"], s["width"]), read))

            return F.aggregate(F.sequence(F.lit(1), n), begin(F.lit(LONG)), window, lambda s: F.when(s["ended"], F.flatten(s["done"])).otherwise(bound(chars(b), folded)))

        chars = lambda b: F.split(F.decode(b, "ISO-8859-1"), "")
        pieces = lambda b: F.when(F.octet_length(b) <= LONG, bound(chars(b), folded)).otherwise(by_windows(b))
        known = lambda b: self.slots.place(table, F.decode(b, "ISO-8859-1"))
        whole = lambda b: bound(known(b), lambda k: F.when(k.isNotNull(), F.array(k)).otherwise(bound(pieces(b), of)))
        return bound(F.encode(word, "UTF-8"), whole)


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word, neighbours by rank, then place, on a heap: for huge words, and the plain version that tests hold the fold against."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the piece that starts at a place; -1: not a start any more
    heap: list[tuple[int, int, int]] = []

    def propose(i: int) -> None:
        j = ends[i]
        if j < n and (k := ranks.get(word[i : ends[j]])) is not None:
            heapq.heappush(heap, (k, i, ends[j]))

    for i in range(n):
        propose(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        if ends[i] < 0 or ends[i] == n or ends[ends[i]] != end:
            continue
        ends[ends[i]], ends[i] = -1, end
        if end < n:
            before[end] = i
            propose(i)
        if before[i] >= 0:
            propose(before[i])
    at, out = 0, []
    while at < n:
        out.append(ranks[word[at : ends[at]]])
        at = ends[at]
    return out


def words(text: Column, pattern: str) -> Column:
    """The matches of the pattern, white space and classes as Unicode has them."""
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0))


def folded_words(docs: DataFrame, ranks: RankMap, pattern: str, frequent: int = FREQUENT, from_rows: int = FROM_ROWS) -> DataFrame:
    """word, count, ids: frequent words of a sample of the rows of docs (column text), each folded once."""
    n = docs.count()
    found = docs.sample(min(1.0, from_rows / max(n, 1)), seed=7).select(F.explode(words(F.col("text"), pattern)).alias("word"))
    often = found.groupBy("word").count().where(F.octet_length("word") <= LONG).orderBy(F.desc("count"), "word").limit(frequent)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return often.repartition(tasks, "word").select("word", "count", bound(ranks.literal(), lambda t: ranks.fold(t, F.col("word"))).alias("ids"))


def encode_in_plan(docs: DataFrame, ranks: RankMap, pattern: str, frequent: int = FREQUENT, from_rows: int = FROM_ROWS) -> DataFrame:
    """As encode, by expressions alone: frequent words are a second literal, others are folded in their rows.

    Null and empty texts have no ids; repeated rows are encoded each; an empty table gives none; other columns, whatever
    their names, are ignored. A text may have any length: its words and ids are arrays of its row.
    """
    ready(docs.sparkSession)
    docs = texts(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    often = sorted((r["word"], r["ids"]) for r in folded_words(docs, ranks, pattern, frequent, from_rows).collect() if _PART not in r["word"])
    memo = Slots([w for w, _ in often])
    held = memo.literal(ids=_numbers([k for _, ids in often for k in ids] or [0]), starts=_numbers([0, *accumulate(len(ids) for _, ids in often)]))
    split = docs.select("doc_id", words(F.col("text"), pattern).alias("words"))

    def ids(t: Column) -> Column:
        def of(w: Column) -> Column:
            start = lambda k: F.get(t["memo"]["starts"], k)
            often = bound(memo.place(t["memo"], w), lambda k: F.when(k.isNotNull(), F.slice(t["memo"]["ids"], start(k) + 1, start(k + 1) - start(k))))
            return F.coalesce(often, ranks.fold(t["ranks"], w))

        return F.flatten(F.transform("words", of))

    return split.select("doc_id", bound(F.struct(ranks.literal().alias("ranks"), held.alias("memo")), ids).alias("ids"))


def as_bytes(ids: Column, pieces: list[bytes]) -> Column:
    """The pieces of the ids, concatenated: binary. Ids without a piece and nulls add nothing."""
    held = F.split(F.lit(_PART.join(p.decode("latin-1") for p in pieces)), _PART, -1)
    return F.encode(F.array_join(bound(held, lambda t: F.transform(ids, lambda k: F.get(t, k))), ""), "ISO-8859-1")


def decode(encoded: DataFrame, ranks: RankMap) -> DataFrame:
    """Adds `decoded` (binary) to rows with `ids`: null ids give null, none give no bytes."""
    return encoded.withColumn("decoded", as_bytes(F.col("ids"), ranks.pieces))


class Numbers(dict):
    """word -> its number: the frequent ones' from the start, others' of a block in the order met."""

    def __init__(self, frequent: list[str]):
        super().__init__(zip(frequent, range(len(frequent))))
        self.first, self.rare, self.chars = len(frequent), [], 0

    def __missing__(self, word: str) -> int:
        self[word] = k = self.first + len(self.rare)
        self.rare.append(word)
        self.chars += len(word)
        return k

    def renew(self) -> None:
        for word in self.rare:
            del self[word]
        self.rare, self.chars = [], 0


class Runs:
    """Lists of numbers, one after the other in an array, to be taken by their places."""

    def __init__(self, values: np.ndarray, lengths: np.ndarray):
        self.values, self.lengths, self.starts = values, lengths, np.cumsum(lengths) - lengths

    def of(self, places: np.ndarray) -> np.ndarray:
        lengths = self.lengths[places]
        return self.values[np.repeat(self.starts[places] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())]


def _runs(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    flat, lengths = (pc.list_flatten(lists), pc.list_value_length(lists)) if len(lists) else ([], [])
    return np.asarray(flat, np.int32), np.asarray(lengths, np.int64)


def _packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers as planes of bytes, compressed."""
    return pa.compress(np.ascontiguousarray(numbers, "<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    planes = pa.decompress(packed, 4 * n, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<i4").ravel()


BLOCK = "block long, doc_ids array<long>, sizes array<int>, numbers binary, n_rare int, rare_sizes binary, rare binary"


def _blocks(docs: DataFrame, pattern: str, often: list[str]) -> DataFrame:
    """Texts in blocks: their ids, how many words each has, the words' numbers, and the words that are not in often (their
    sizes and bytes, in order). A number below len(often) is a place in it, others count on through these words."""
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        from pyspark import TaskContext

        split, numbers, block = regex.compile(pattern).findall, Numbers(shared.value), TaskContext.get().partitionId() << 32
        doc_ids, found, n = [], [], 0

        def ended() -> pa.RecordBatch:
            met = sorted(range(len(numbers.rare)), key=numbers.rare.__getitem__)
            places = np.arange(numbers.first + len(met), dtype="<i4")
            places[numbers.first + np.array(met, np.int64)] = places[numbers.first :].copy()
            rare = [numbers.rare[k].encode() for k in met]
            columns = [block, doc_ids, [len(f) for f in found], _packed(places[np.concatenate(found)]), len(rare), _packed(np.array([len(w) for w in rare], "<i4")),
                       pa.compress(b"".join(rare), "zstd", asbytes=True)]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
            return pa.record_batch([pa.array([c], k) for c, k in zip(columns, kinds)], [c.split()[0] for c in BLOCK.split(", ")])

        for b in batches:
            for name, text in rows(b, "doc_id", "text"):
                doc_ids.append(name)
                found.append(np.array(list(map(numbers.__getitem__, split(text or ""))), "<i4"))
                n += len(found[-1])
                if n >= BLOCK_WORDS or len(numbers.rare) >= BLOCK_RARE or numbers.chars >= BLOCK_CHARS or len(found) >= BLOCK_WORDS:
                    yield ended()
                    numbers.renew()
                    doc_ids, found, n, block = [], [], 0, block + 1
        if found:
            yield ended()

    return docs.mapInArrow(run, BLOCK)


def _own_words(n: int, sizes: bytes, words: bytes) -> tuple[np.ndarray, pa.Array]:
    """The sizes of a block's own words, in bytes, and the words."""
    lengths = _unpacked(sizes, n)
    ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    held = pa.decompress(words, int(ends[-1]), "zstd")
    return lengths, pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(ends), held])


def _rare(blocks: DataFrame) -> DataFrame:
    """word, block, number: each block's own words, numbered from nought."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, *packed in rows(b, "block", "n_rare", "rare_sizes", "rare"):
                lengths, words = _own_words(*packed)
                kept = np.flatnonzero(lengths <= HUGE)
                for at in range(0, len(kept), 10_000):
                    part = kept[at : at + 10_000]
                    columns = [words.take(pa.array(part)).cast(pa.string()), pa.array(np.full(len(part), k)), pa.array(part, pa.int32())]
                    yield pa.record_batch(columns, ["word", "block", "number"])

    return blocks.mapInArrow(run, "word string, block long, number int")


def _returned(folded: DataFrame) -> DataFrame:
    """From places (block, number) and ids of words: block, n, size, own. own: the n places' numbers as differences, then
    how many ids each has, then all ids, together `size` numbers, packed."""

    def dealt(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        block, number, lengths, ids = map(np.concatenate, zip(*held))
        order, runs = np.lexsort((number, block)), Runs(ids, lengths)
        starts = np.flatnonzero(np.diff(block[order], prepend=-1))
        out = []
        for at in np.split(order, starts[1:]):
            numbers = np.concatenate([np.diff(number[at], prepend=0), lengths[at], runs.of(at)])
            out.append((int(block[at[0]]), len(at), len(numbers), _packed(numbers)))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["block", "n", "size", "own"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            places, (ids, lengths) = b.column("places"), _runs(b.column("ids"))
            words, places = np.repeat(np.arange(len(lengths)), np.asarray(pc.list_value_length(places), np.int64)), pc.list_flatten(places)
            block, number = (np.asarray(pc.struct_field(places, [i]), np.int64) for i in (0, 1))
            held.append((block, number, lengths[words], Runs(ids, lengths).of(words)))
            n += len(block)
            if n >= BLOCK_WORDS:
                yield from dealt(held)
                held, n = [], 0
        if n:
            yield from dealt(held)

    return folded.select("places", "ids").mapInArrow(run, "block long, n int, size int, own binary")


def _encoded(docs: DataFrame, ranks: RankMap, pattern: str, frequent: int, from_rows: int, finish, schema: str) -> DataFrame:
    """finish(doc_id, the text's ids by parts) as rows. Blocks are dealt by name; their words, grouped, are folded once each
    and go back to the blocks they are from."""
    folded = folded_words(docs, ranks, pattern, frequent, from_rows).toArrow().sort_by([("count", "descending"), ("word", "ascending")]).combine_chunks()
    lists, merges = _runs(folded.column("ids")), docs.sparkSession.sparkContext.broadcast(ranks.ranks)
    shared, tasks = docs.sparkSession.sparkContext.broadcast(lists), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = _blocks(docs, pattern, folded.column("word").to_pylist()).repartition(tasks, "block")
    rare = _rare(blocks).repartition(tasks, "word").groupBy("word").agg(F.collect_list(F.struct("block", "number")).alias("places"))
    rare = _returned(rare.select("places", bound(ranks.literal(), lambda t: ranks.fold(t, F.col("word"))).alias("ids")))
    known = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    fields = pa.schema([(name, known[kind]) for name, kind in map(str.split, schema.split(","))])

    def own_runs(n_rare: int, sizes: bytes, words: bytes, packets: list[dict]) -> Runs:
        """The ids of a block's own words: those that came back, and the huge ones, merged here."""
        at, lengths, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for p in packets:
            numbers = _unpacked(p["own"], p["size"])
            at.append(np.cumsum(numbers[: p["n"]], dtype=np.int64))
            lengths.append(numbers[p["n"] : 2 * p["n"]].astype(np.int64))
            ids.append(numbers[2 * p["n"] :])
        own_sizes, own_words = _own_words(n_rare, sizes, words)
        for k in np.flatnonzero(own_sizes > HUGE):
            ids.append(np.array(merge(own_words[k].as_py().encode(), merges.value), np.int32))
            at.append(np.array([k]))
            lengths.append(np.array([len(ids[-1])]))
        at, lengths = np.concatenate(at), np.concatenate(lengths)
        order = np.argsort(at)
        if not np.array_equal(at[order], np.arange(n_rare)):
            raise RuntimeError("a block lacks words")
        return Runs(Runs(np.concatenate(ids), lengths).of(order), lengths[order])

    def run(block: pa.Table, own: pa.Table) -> pa.Table:
        out, packets = [], own.to_pylist()
        for r in block.to_pylist():
            rare = own_runs(r["n_rare"], r["rare_sizes"], r["rare"], packets)
            runs = Runs(np.concatenate([shared.value[0], rare.values]), np.concatenate([shared.value[1], rare.lengths]))
            at, numbers = 0, _unpacked(r["numbers"], sum(r["sizes"]))
            for name, n in zip(r["doc_ids"], r["sizes"]):
                out.append(finish(name, (runs.of(numbers[i : min(i + AT_ONCE, at + n)]) for i in range(at, at + n, AT_ONCE))))
                at += n
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), fields)], fields)

    return blocks.groupBy("block").cogroup(rare.groupBy("block")).applyInArrow(run, schema)


def encode(docs: DataFrame, ranks: RankMap, pattern: str, frequent: int = FREQUENT, from_rows: int = FROM_ROWS) -> DataFrame:
    """doc_id, ids (array<int>): the ids of each whole text, a row for each row.

    Null and empty texts have no ids; repeated rows are encoded each; an empty table gives none; other columns, whatever
    their names, are ignored. A text may have any length: memory is that of one block of texts. Neighbours of equal ranks
    merge from the left.
    """
    docs = texts(docs)
    ready(docs.sparkSession)
    finish = lambda name, parts: (name, np.concatenate([np.zeros(0, np.int32), *parts]))
    return _encoded(docs, ranks, pattern, frequent, from_rows, finish, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str, pattern: str, frequent: int = FREQUENT, from_rows: int = FROM_ROWS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian 32-bit numbers), decoded_sha256: each text encoded, and its ids
    decoded again by concatenating their pieces. Edges as in encode.
    """
    docs = texts(docs)
    ready(docs.sparkSession)
    ranks = RankMap(load_ranks(path))
    shared = docs.sparkSession.sparkContext.broadcast(Runs(np.frombuffer(b"".join(ranks.pieces), np.uint8), np.array([len(p) for p in ranks.pieces])))

    def finish(name: int, parts: Iterator[np.ndarray]) -> tuple:
        n, ids, decoded, pieces = 0, hashlib.sha256(), hashlib.sha256(), shared.value
        for part in parts:
            n += len(part)
            ids.update(part.astype("<u4").tobytes())
            decoded.update(pieces.of(part).tobytes())
        return name, n, ids.hexdigest(), decoded.hexdigest()

    return _encoded(docs, ranks, pattern, frequent, from_rows, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
