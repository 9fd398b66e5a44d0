"""Latent semantic space of weighted terms, by randomised range finding over the long form (row, term, weight), or over
blocks of the vocabulary that rows visit."""

from __future__ import annotations

import ctypes
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from stratalake.functions.scalar import dot, unit

#: Extra directions beyond those asked for, and power rounds.
EXTRA, ROUNDS = 8, 3
#: Rows for each block of the vocabulary and for each visit to blocks; terms of rows that are dealt at once, that are kept
#: in a piece, and that a product takes at once.
BLOCK, VISIT, DEALT, PIECE, HELD = 8192, 65536, 1 << 20, 1 << 20, 1 << 19


def weights(df: DataFrame, key: str, terms: Column) -> tuple[DataFrame, DataFrame]:
    """key, term, w of length-one sublinear TF-IDF rows; and term, idf."""
    n = df.count()
    tf = df.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    idf = tf.groupBy("term").agg((F.log(F.lit(1.0 + n) / (1 + F.count(F.lit(1)))) + 1).alias("idf"))
    w = tf.join(idf, "term").select(key, "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    length = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    return w.join(length, key).select(key, "term", (F.col("w") / F.col("len")).alias("w")), idf


def _gathered(w: DataFrame, by: str, vec: Column, size: int) -> DataFrame:
    """by, vec: weighted sums, a partial sum for each component before the shuffle; hot terms need no list."""
    parts = [F.sum(F.col("w") * vec[i]).alias(f"s{i}") for i in range(size)]
    return w.groupBy(by).agg(*parts).select(by, F.array(*(F.col(f"s{i}") for i in range(size))).alias("vec"))


def _gram(df: DataFrame, size: int, turn: np.ndarray | None = None) -> np.ndarray:
    """size x size, summed from one small matrix for each batch; of rows that are scaled by len and turned, if a turn is given."""

    def part(batches):
        for b in batches:
            if len(b):
                x = _lists_of(b) if turn is None else _scaled(b) @ turn
                g = (x.T @ x).ravel()
                yield pa.record_batch([pa.array(np.arange(len(g), dtype=np.int32)), pa.array(g)], ["i", "g"])

    out = np.zeros(size * size)
    for r in df.select("vec", *(["len"] if turn is not None else [])).mapInArrow(part, "i int, g double").groupBy("i").agg(F.sum("g").alias("g")).collect():  # size * size rows
        out[r["i"]] = r["g"]
    return out.reshape(size, size)


def _lists_of(b: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Vectors of one length, one a row."""
    column = b.column("vec")
    return lists(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)[1].reshape(len(b), -1)


def _scaled(b: pa.RecordBatch | pa.Table) -> np.ndarray:
    return _lists_of(b) / b.column("len").to_numpy()[:, None]


def _times(df: DataFrame, by: str, m: np.ndarray) -> DataFrame:
    """Row vectors times a small matrix."""
    rows = F.array(*(F.array(*map(F.lit, map(float, c))) for c in m.T))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return df.select(by, F.transform(rows, lambda c: dot(F.col("vec"), c)).alias("vec"))


def _orthonormal(df: DataFrame, by: str, size: int) -> DataFrame:
    values, vectors = np.linalg.eigh(_gram(df, size))
    keep = values > max(values.max(), 1e-300) * 1e-12
    scaled = np.where(keep, 1 / np.sqrt(np.where(keep, values, 1)), 0)
    return _times(df, by, vectors * scaled)


def basis(w: DataFrame, key: str, dims: int = 48) -> DataFrame:
    """term, vec: the `dims` leading right singular directions of the rows (fewer if the rank is less: zeros then)."""
    size = dims + EXTRA
    sign = F.array(*(F.when(F.xxhash64("term", F.lit(i)).bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0) for i in range(size)))
    rows = _gathered(w.withColumn("vec", sign), key, F.col("vec"), size)
    for k in range(ROUNDS):
        q = _orthonormal(rows, key, size).checkpoint()
        back = _gathered(w.join(q, key), "term", F.col("vec"), size).checkpoint()
        if k + 1 < ROUNDS:
            rows = _gathered(w.join(_orthonormal(back, "term", size), "term"), key, F.col("vec"), size).checkpoint()
    values, vectors = np.linalg.eigh(_gram(back, size))
    order = np.argsort(-values)[:dims]
    ok = values[order] > max(values.max(), 1e-300) * 1e-12
    return _times(back, "term", vectors[:, order] * np.where(ok, 1 / np.sqrt(np.where(ok, values[order], 1)), 0))


def embed(w: DataFrame, key: str, terms: DataFrame, dims: int = 48) -> DataFrame:
    """key, vec: rows in the space (not scaled)."""
    return _gathered(w.join(terms, "term"), key, F.col("vec"), dims)


def lists(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many elements each list has, and all of them; a null list has none."""
    return column.value_lengths().fill_null(0).to_numpy(), column.flatten().to_numpy()


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0, in as few bytes as the largest needs, compressed."""
    width = np.min_scalar_type(x.max()).itemsize if len(x) else 1
    raw = np.ascontiguousarray(x.astype(f"<u{width}")).view(np.uint8).reshape(len(x), width)
    return struct.pack("<BQ", width, len(x)) + pa.compress(np.ascontiguousarray(raw.T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(b: bytes) -> np.ndarray:
    width, n = struct.unpack_from("<BQ", b)
    raw = np.frombuffer(pa.decompress(b[9:], width * n, codec="zstd"), np.uint8) if n else np.empty(0, np.uint8)
    return np.ascontiguousarray(raw.reshape(width, n).T).view(f"<u{width}").ravel()


def dealt(df: DataFrame, key: str, terms: Column, blocks: int) -> DataFrame:
    """block, keys, hashes, counts, rows, tf: the different terms of some rows (keys; those without terms are left out), dealt
    to blocks of the vocabulary, which are ranges of 64-bit hashes. For each term of a block, packed: by how much its hash is
    above the one before, how many rows have it, which of the keys these are, and how often each of them has it.

    Two terms of one hash would count as one; of 10^8 terms that any two do has a chance of 3 in 10,000.
    """
    edges = np.array([-(-(b << 64) // blocks) for b in range(blocks)], np.uint64)

    def deal(held: list) -> pa.RecordBatch:
        keys, size, h = pa.concat_arrays([k for k, _, _ in held]), np.concatenate([s for _, s, _ in held]), np.concatenate([h for _, _, h in held]).view(np.uint64)
        keys, size = keys.filter(pa.array(size > 0)), size[size > 0]
        order = np.argsort(h, kind="stable")
        h, row = h[order], np.repeat(np.arange(len(size), dtype=np.uint32), size)[order]
        term = np.concatenate([[True], h[1:] != h[:-1]])[: len(h)]
        pair = np.flatnonzero(term | np.concatenate([[True], row[1:] != row[:-1]])[: len(h)])
        h, row, tf, term = h[pair], row[pair], np.diff(np.append(pair, len(h))), np.flatnonzero(term[pair])
        h, count = h[term], np.diff(np.append(term, len(pair)))
        ends, out = np.append(np.searchsorted(h, edges), len(h)), []
        starts = np.append(term, len(pair))
        for b in np.flatnonzero(np.diff(ends)).tolist():
            at, of = slice(ends[b], ends[b + 1]), slice(starts[ends[b]], starts[ends[b + 1]])
            out.append((b, _packed(np.diff(h[at], prepend=np.uint64(0))), _packed(count[at]), _packed(row[of]), _packed(tf[of])))
        every = pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32) * len(keys), pa.concat_arrays([keys] * len(out)) if out else keys[:0])
        return pa.record_batch([pa.array([x[0] for x in out], pa.int64()), every, *(pa.array([x[i] for x in out], pa.binary()) for i in range(1, 5))], ["block", "keys", "hashes", "counts", "rows", "tf"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for b in (b.slice(lo, 256) for b in batches for lo in range(0, len(b), 256)):
            held.append((b.column("key"), *lists(b.column("h"))))
            count += len(held[-1][2])
            if count >= DEALT:
                yield deal(held)
                held, count = [], 0
        if held:
            yield deal(held)
        del held
        _freed()

    rows = df.select(F.col(key).alias("key"), F.transform(terms, lambda t: F.xxhash64(t)).alias("h"))
    return rows.mapInArrow(parts, f"block long, keys array<{dict(rows.dtypes)['key']}>, hashes binary, counts binary, rows binary, tf binary")


def _sign(h: np.ndarray, i: int) -> np.ndarray:
    """The signs of terms in direction i, as `basis` draws them: xxhash64(term, i), of the term's hash."""
    p1, p2, p3, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    with np.errstate(over="ignore"):
        x = (h.view(np.uint64) + p5 + np.uint64(4)) ^ (np.uint64(i) * p1)
        x = ((x << np.uint64(23)) | (x >> np.uint64(41))) * p2 + p3
        x = (x ^ (x >> np.uint64(33))) * p2
        x = (x ^ (x >> np.uint64(29))) * p3
    return np.where((x ^ (x >> np.uint64(32))) & np.uint64(1), 1.0, -1.0)


#: What a block of the vocabulary is kept as: rows of its terms that one row alone has (of this kind there is one, with the
#: names of all rows), and rows of other terms. See `_kept`.
KEPT = "block long, names array<{key}>, square array<double>, counts binary, rows binary, tf binary, signs binary, at array<int>, told array<double>"


def _kept(t: pa.Table, n: int, size: int, asked: dict[int, int]) -> pa.Table:
    """A block as rounds need it. Rows are numbered by their place in names; the number after these is that of rows
    without a key, which count for idf alone.

    First what one row alone has of terms: the square of their weights' length for each name, and sorted by row how many terms, how often
    each, and their signs (a bit for each of `size` directions). Then the other terms (and all that the question says): for each how many rows
    have it, which, how often, signs, and the places and weights of those in the question. Weights are not yet scaled.
    """
    keys = t.column("keys").combine_chunks()
    known = keys.flatten().dictionary_encode()
    names, number = known.dictionary, known.indices.fill_null(len(known.dictionary)).to_numpy().astype(np.int32)
    start = np.append(0, np.cumsum(keys.value_lengths().to_numpy())).tolist()
    packs = [[_unpacked(b) for b in t.column(c).to_pylist()] for c in ("hashes", "counts", "rows", "tf")]
    hashes, term = np.unique(np.concatenate([np.cumsum(h, dtype=np.uint64) for h in packs[0]]), return_inverse=True)
    term = np.repeat(term.astype(np.int32), np.concatenate(packs[1]))
    row, tf = np.concatenate([number[lo:][r] for lo, r in zip(start, packs[2])]), np.concatenate(packs[3])
    del packs
    if len(number) > len(names):  # a key on several rows, or none: terms are counted together
        pair, at = np.unique(term.astype(np.int64) * (len(names) + 1) + row, return_inverse=True)
        term, row, tf = (pair // (len(names) + 1)).astype(np.int32), (pair % (len(names) + 1)).astype(np.int32), np.bincount(at, tf).astype(np.int64)
    else:
        order = np.argsort(term, kind="stable")
        term, row, tf = term[order], row[order], tf[order]
        del order
    count = np.bincount(term, minlength=len(hashes))
    idf = np.log((1.0 + n) / (1 + count)) + 1
    told, said = np.zeros(len(hashes)), np.zeros(len(hashes), bool)
    for h, c in asked.items():
        i = int(np.searchsorted(hashes, np.uint64(h % 2**64)))
        if i < len(hashes) and int(hashes[i]) == h % 2**64:
            told[i], said[i] = (1 + np.log(c)) * idf[i], True
    signs = np.zeros((len(hashes), -(-size // 8)), np.uint8)
    for i in range(size):
        signs[:, i // 8] |= (_sign(hashes.view(np.int64), i) > 0).astype(np.uint8) << np.uint8(i % 8)

    alone = (count == 1) & ~said
    own = np.flatnonzero(alone[term])
    own = own[np.argsort(row[own], kind="stable")]
    w = (1 + np.log(tf[own].astype(float))) * idf[term[own]]
    bits = lambda x: pa.compress(np.ascontiguousarray(x.T).tobytes(), codec="zstd", asbytes=True)
    out = [(names, np.bincount(row[own], w * w, len(names) + 1)[:-1], _packed(np.bincount(row[own], minlength=len(names) + 1)), None, _packed(tf[own]), bits(signs[term[own]]), None, None)]
    shared = ~alone
    some = shared[term]
    row, tf, count, signs, told, said = row[some], tf[some], count[shared], signs[shared], told[shared], said[shared]
    ends = np.append(0, np.cumsum(count))
    for lo, hi in _cuts(ends, PIECE):
        of, at = slice(ends[lo], ends[hi]), np.flatnonzero(said[lo:hi])
        out.append((None, None, _packed(count[lo:hi]), _packed(row[of]), _packed(tf[of]), bits(signs[lo:hi]), at.astype(np.int32), told[lo:hi][at]))
    kinds = [pa.list_(names.type), pa.list_(pa.float64()), *[pa.binary()] * 4, pa.list_(pa.int32()), pa.list_(pa.float64())]
    columns = [pa.concat_arrays([pa.nulls(1, kind) if x[i] is None else pa.array([x[i]], kind) if isinstance(x[i], bytes) else _one(x[i], kind) for x in out]) for i, kind in enumerate(kinds)]
    return pa.table([pa.array([t.column("block")[0].as_py()] * len(out), pa.int64()), *columns], ["block", "names", "square", "counts", "rows", "tf", "signs", "at", "told"])


def _cuts(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of terms that have `most` rows together, or little more, from where the rows of each term end (after a 0)."""
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], most)), len(ends) - 1)).tolist()
    return zip(cuts[:-1], cuts[1:])


def _one(x, kind: pa.DataType) -> pa.Array:
    """A column of one list."""
    x = x if isinstance(x, pa.Array) else pa.array(x, kind.value_type)
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)


class _Terms:
    """Terms of a block that stand together: for each pair of a term and a row the row and the weight (not yet scaled); where
    the rows of each term end (after a 0), and the question's weight of it."""

    def __init__(self, r: dict, n: int):
        self.count, tf = _unpacked(r["counts"]).astype(np.int64), _unpacked(r["tf"])
        idf = np.log((1.0 + n) / (1 + self.count)) + 1 if r["rows"] else np.log((1.0 + n) / 2) + 1
        many = 1 + np.log(tf.astype(float))
        if r["rows"]:
            self.row, self.w = _unpacked(r["rows"]).astype(np.int64), many * np.repeat(idf, self.count)
        else:  # a row for each term, and no other has it
            self.row, self.w, self.count = np.repeat(np.arange(len(self.count)), self.count), many * idf, np.ones(len(tf), np.int64)
        self.ends, self.told = np.append(0, np.cumsum(self.count)), np.zeros(len(self.count))
        if r["at"]:
            self.told[r["at"]] = r["told"]

    def signs(self, r: dict, size: int) -> Iterator[np.ndarray]:
        """For each direction the signs of the terms."""
        wide = -(-size // 8)
        raw = np.frombuffer(pa.decompress(r["signs"], wide * len(self.count), codec="zstd"), np.uint8).reshape(wide, -1) if len(self.count) else np.zeros((wide, 0), np.uint8)
        for i in range(size):
            yield ((raw[i // 8] >> np.uint8(i % 8)) & 1) * 2.0 - 1


def _blocks(t: pa.Table) -> Iterator[tuple[pa.Array, np.ndarray, list[dict]]]:
    """Of each block the names, the squares, and the rows that hold its terms."""
    for block in pc.unique(t.column("block")).to_pylist():
        own = t.filter(pc.equal(t.column("block"), block))
        first = own.filter(pc.is_valid(own.column("names")))
        yield first.column("names").combine_chunks().flatten(), lists(first.column("square").combine_chunks())[1], own.drop_columns(["names", "square"]).to_pylist()


def _vectors(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(np.ascontiguousarray(x).ravel()))


def _summed(df: DataFrame, by: list[str], size: int, *others: str) -> DataFrame:
    """Sums by key of vec, a vector of a size, and of other columns."""
    parts = df.groupBy(*by).agg(*(F.sum(F.col("vec")[i]).alias(f"_s{i}") for i in range(size)), *(F.sum(c).alias(c) for c in others))
    return parts.select(*by, F.array(*(F.col(f"_s{i}") for i in range(size))).alias("vec"), *others)


def likeness(df: DataFrame, key: str, terms: Column, asked: dict[int, int], dims: int = 48) -> DataFrame:
    """key, meaning, wording of the rows that have terms: cosines with a question, in the latent space and of the TF-IDF
    rows themselves (null meaning where the question has no term that a row has). asked: how often it says a term, by the term's hash.

    As weights, basis and embed give them, but terms stay where their block of the vocabulary is, packed. In a round a row's
    vector visits some blocks at once, which make their terms' vectors of those that come and send the rows' products with these back; what
    makes them orthonormal is a small matrix that is known afterwards. So a round moves `dims` + EXTRA numbers a row and
    visit, and none a term of a row; terms are moved once.
    """
    n, size, kind = df.count(), dims + EXTRA, dict(df.dtypes)[key]
    blocks, visits = max(4, -(-n // BLOCK)), max(4, -(-n // VISIT))
    held = dealt(df, key, terms, blocks).groupBy("block").applyInArrow(lambda t: _freed(_kept(t, n, size, asked)), KEPT.format(key=kind)).checkpoint()
    held = held.withColumn("visit", F.pmod("block", F.lit(visits)))
    _let_go(df)

    def begun(t: pa.Table) -> pa.Table:
        names = pc.unique(pa.concat_arrays([x.flatten() for x in t.column("names").chunks]).drop_null())
        vec, square, wording = np.zeros((size, len(names))), np.zeros(len(names)), np.zeros(len(names))
        for own, _, found in _blocks(t):
            at = pc.index_in(own, value_set=names).to_numpy()
            for r in found:
                x = _Terms(r, n)
                # rows without a key go to the place after the last
                total = lambda w, x=x, own=own: np.bincount(x.row, w, len(own) + 1)[:-1]
                square[at] += total(x.w * x.w)
                if r["at"]:
                    wording[at] += total(x.w * np.repeat(x.told, x.count))
                for i, s in enumerate(x.signs(r, size)):
                    vec[i, at] += total(x.w * np.repeat(s, x.count))
        return pa.table([names, _vectors(vec.T), pa.array(square), pa.array(wording)], ["key", "vec", "len", "wording"])

    def met(turn: np.ndarray, q: np.ndarray):
        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            """Of each row its product (part 0) and, in one visit, its length; without a key, the products of the terms'
            vectors (parts 1 to size) and what the question gives (the part after, if it says a term of the blocks)."""
            keys, length = b.column("key").combine_chunks(), b.column("len").to_numpy()
            m, gram, question = len(b), np.zeros((size, size)), None
            vec, square, done = np.zeros((size, m + 1)), np.zeros(m + 1), 0  # rows without a key go to the place after the last
            for part in b.to_batches():
                vec[:, done : done + len(part)] = (_scaled(part) @ turn @ q / part.column("len").to_numpy()[:, None]).T
                done += len(part)
            places = []
            for names, own, found in _blocks(a) if m else ():
                places.append((np.append(pc.index_in(names, value_set=keys).to_numpy(), m), found))
                square[places[-1][0][:-1]] += own
            sums = square * vec  # a term that one row alone has gives that row its own vector back
            gram += sums @ vec.T
            for at, found in places:
                for r in found:
                    if r["rows"]:
                        x = _Terms(r, n)
                        for lo, hi in _cuts(x.ends, HELD):
                            row, w = at[x.row[x.ends[lo] : x.ends[hi]]], x.w[x.ends[lo] : x.ends[hi]]
                            back = np.stack([np.add.reduceat(w * vec[k][row], x.ends[lo:hi] - x.ends[lo]) for k in range(size)])
                            gram += back @ back.T
                            if r["at"]:
                                question = (0 if question is None else question) + back @ x.told[lo:hi]
                            for k in range(size):
                                sums[k] += np.bincount(row, w * np.repeat(back[k], x.count[lo:hi]), m + 1)
            del vec
            out = sums[:, :m].T
            more = [gram] if question is None else [gram, question[None]]
            vec = np.vstack([out, *more]) if m else np.empty((0, size))
            extra = len(vec) - m
            first = m > 0 and b.column("visit")[0].as_py() == 0
            return pa.table([pa.concat_arrays([keys, pa.nulls(extra, keys.type)]), _vectors(vec), pa.array(np.append(np.zeros(m, np.int32), np.arange(1, extra + 1, dtype=np.int32))), pa.array(np.append(length * first, np.zeros(extra)))], ["key", "vec", "part", "len"])

        return lambda a, b: _freed(meet(a, b))

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield pa.record_batch([b.column("key"), _vectors(_scaled(b) @ turn)], ["key", "vec"])

    # a row is scaled at the end of a sum over its visits: its length is that of all of them
    first = _summed(held.groupBy("visit").applyInArrow(lambda t: _freed(begun(t)), f"key {kind}, vec array<double>, len double, wording double"), ["key"], size, "len", "wording")
    first = first.select("key", "vec", F.sqrt("len").alias("len"), (F.col("wording") / F.sqrt("len")).alias("wording")).checkpoint()
    rows, turn, point = first, np.eye(size), None
    shared = held.select("visit", "block", "names", "square", "rows", *(F.when(F.col("rows").isNotNull(), F.col(c)).alias(c) for c in ("counts", "tf")), "at", "told")  # what rounds need
    for k in range(ROUNDS):
        _let_go(df)
        values, vectors = np.linalg.eigh(_gram(rows, size, turn))
        keep = values > max(values.max(), 1e-300) * 1e-12
        q = vectors * np.where(keep, 1 / np.sqrt(np.where(keep, values, 1)), 0)
        sent = rows.select("key", "vec", "len").withColumn("visit", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(visits - 1).cast("long"))))
        sums = shared.groupBy("visit").cogroup(sent.groupBy("visit")).applyInArrow(met(turn, q), f"key {kind}, vec array<double>, part int, len double")
        total = _summed(sums, ["key", "part"], size, "len").checkpoint()
        small = {r["part"]: np.array(r["vec"]) for r in total.where("part > 0").collect()}  # size + 1 rows at most
        values, vectors = np.linalg.eigh(np.stack([small.get(i + 1, np.zeros(size)) for i in range(size)]))
        order = np.argsort(-values)[:dims] if k + 1 == ROUNDS else np.arange(size)
        ok = values[order] > max(values.max(), 1e-300) * 1e-12
        turn = vectors[:, order] * np.where(ok, 1 / np.sqrt(np.where(ok, values[order], 1)), 0)
        rows = total.where("part = 0").drop("part")
        point = small[size + 1] @ turn if size + 1 in small else None
    _let_go(df)
    if point is None:
        meaning = F.lit(None).cast("double")
    else:
        point = point / max(np.linalg.norm(point), 1e-300)
        meaning = dot(unit(F.col("vec")), F.array(*map(F.lit, map(float, point))))
    rows = rows.select("key", "vec", "len").mapInArrow(turned, f"key {kind}, vec array<double>")
    return rows.select(F.col("key").alias(key), meaning.alias("meaning")).join(first.select(F.col("key").alias(key), "wording"), key)


def _freed(out=None):
    """out, when a worker, which stays for other tasks, has given what is free back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)
    return out


def _let_go(df: DataFrame) -> None:
    """Spark deletes files of shuffles that nothing refers to once the driver has noticed."""
    df.sparkSession.sparkContext._jvm.java.lang.System.gc()
