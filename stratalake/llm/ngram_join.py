"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is the order of their 64-bit hashes. It is cut into fragments, ranges of that order, and
each document's sorted set falls into them. Two documents within the threshold differ in so few n-grams that, with more
fragments than differences, some fragment holds the same n-grams in both; equal fragments are found by an equi-join on
their hash. Families of documents tied this way are then joined exactly: overlaps are counted fragment by fragment and
summed for each pair.

Which fragments a document posts follows the prefix principle, so no pair is lost: with d the most differences that any
partner within the threshold can have, it posts its d + 1 fullest fragments (ties by position) at the level of its own
size class and at the one below, where partners of the next size class meet. Empty fragments are never posted, as they
are equal by chance. Only two sets that both have too few full fragments could need one; such sets post pairs of n-grams
instead: of the first n - ceil(threshold * n) + 2 of the order, two of which any partner has there too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from stratalake.llm.common import WordHashes, components, cut, joined_spread, mixed, ready, rows, texts, unused

#: Postings a task gathers before it combines equal ones and sends them on (16 bytes each).
POSTINGS_HELD = 3_000_000
#: Sets joined in one task: larger families go through pairs of blocks.
BLOCK_SETS, BLOCK_GRAMS = 512, 4_000_000
#: Nodes a task remembers to have posted; afterwards it starts afresh, and repeats meet in the shuffle.
NODES_KEPT = 1_000_000
#: Columns of one fragment's incidence matrix.
FRAGMENT_COLUMNS = 4096
#: What a row is known by.
ROW = ("doc_id", "nameless", "key", "h")
#: Representatives up to which their names are broadcast (some 50 bytes each); a shuffled join beyond.
BROADCAST_ROWS = 500_000


def gram_set(text: str | None, n: int, table: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; with fewer words, the whole sequence as one; without, none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = table.of(words)
    k = min(n, len(words))
    out = mixed(h[: len(h) - k + 1] + np.uint64(k))
    for i in range(1, k):
        out = mixed(out * np.uint64(3) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def identity(grams: np.ndarray) -> int:
    """One 63-bit name for equal sets (chance of any clash among 10**8 different sets: about 0.1 %)."""
    a, b = mixed(grams), mixed(grams + np.uint64(0x5851F42D4C957F2D))
    both = np.array([np.add.reduce(a), np.bitwise_xor.reduce(b), len(grams)], np.uint64)
    return int(np.bitwise_xor.reduce(mixed(both + np.arange(1, 4, dtype=np.uint64))) >> np.uint64(1))


class Levels:
    """Size classes with ratio 1 / threshold; threshold = num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.starts = num, den, [1]

    def start(self, i: int) -> int:
        while len(self.starts) <= i:
            self.starts.append(max(self.starts[-1] + 1, self.starts[-1] * self.den // self.num + 1))
        return self.starts[i]

    def of(self, size: int) -> int:
        i = 0
        while self.start(i + 1) <= size:
            i += 1
        return i

    def apart(self, both: int) -> int:
        """The most differences of two sets within the threshold whose sizes sum to `both`."""
        return (self.den - self.num) * both // (self.den + self.num)

    @lru_cache(maxsize=None)  # noqa: B019
    def cuts(self, i: int) -> np.ndarray:
        """Bounds of the fragments at level i: more fragments than any pair there can have differences."""
        top = self.start(i + 2) - 1
        m = self.apart(2 * top) + 2
        return np.array([(2**64 * j) // m for j in range(m)], np.uint64)

    @lru_cache(maxsize=200_000)  # noqa: B019
    def roles(self, size: int) -> tuple:
        """(level, fragments to post) for the own class and the class below; none where only equal sets can match."""
        i = self.of(size)
        out = [(i, self.apart(size + min(size * self.den // self.num, self.start(i + 2) - 1)))]
        if i:
            out.append((i - 1, self.apart(size + self.start(i) - 1)))
        return tuple((level, d + 1) for level, d in out if d)


def postings(grams: np.ndarray, levels: Levels) -> np.ndarray:
    """Signatures of a sorted set: its fullest fragments, and pairs of n-grams where there are too few."""
    out, n, few = [], len(grams), False
    sums = None
    for level, post in levels.roles(n):
        cuts = levels.cuts(level)
        if sums is None:
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(grams), dtype=np.uint64)))
        at = np.append(np.searchsorted(grams, cuts), n)
        count = np.diff(at)
        j = np.argsort(-count, kind="stable")[:post]
        full = j[count[j] > 0]
        few |= len(full) < post
        out.append(mixed(sums[at[full + 1]] - sums[at[full]] + mixed(full.astype(np.uint64) + np.uint64(level << 32))))
    if few:
        first = grams[: n - -(-levels.num * n // levels.den) + 2]
        a, b = np.triu_indices(len(first), 1)
        out.append(mixed(mixed(first[a]) * np.uint64(3) + first[b]))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for b in batches:
            sizes, nodes = [], []
            for (text,) in rows(b, "text"):
                g = gram_set(text, n, table)
                sizes.append(len(g))
                nodes.append(identity(g) if len(g) else None)
            kept = [b.column(b.schema.get_field_index(c)) for c in ROW]
            yield pa.record_batch([*kept, pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64())], [*ROW, "n", "node"])

    return run


def _combined(sig: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each signature once, with its smallest node; other nodes of it become edges at once (sig null)."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    first = np.append(True, sig[1:] != sig[:-1])
    head = node[first][np.cumsum(first) - 1]
    tied = ~first & (node != head)
    if tied.any():
        e = np.unique(np.stack((node[tied], head[tied])), axis=1)
        yield pa.record_batch([pa.nulls(e.shape[1], pa.int64()), pa.array(e[0]), pa.array(e[1])], ["sig", "u", "v"])
    s, u = sig[first], node[first]
    for i in range(0, len(s), 100_000):
        part = s[i : i + 100_000].view(np.int64)
        yield pa.record_batch([pa.array(part), pa.array(u[i : i + 100_000]), pa.nulls(len(part), pa.int64())], ["sig", "u", "v"])


def _postings(n: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, levels, seen, sigs, nodes, held = WordHashes(), Levels(num, den), set(), [], [], 0
        for b in batches:
            for (text,) in rows(b, "text"):
                g = gram_set(text, n, table)
                if not len(g) or (node := identity(g)) in seen:
                    continue
                if len(seen) >= NODES_KEPT:
                    seen.clear()
                seen.add(node)
                p = postings(g, levels)
                if len(p):
                    sigs.append(p)
                    nodes.append(np.full(len(p), node, np.int64))
                    held += len(p)
            if held >= POSTINGS_HELD:
                yield from _combined(np.concatenate(sigs), np.concatenate(nodes))
                sigs, nodes, held = [], [], 0
        if held:
            yield from _combined(np.concatenate(sigs), np.concatenate(nodes))

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one shuffled partition: edges of nodes that share a signature, as stars round the smallest."""
    sigs, nodes = [], []
    for b in batches:
        sigs.append(b.column(0).to_numpy(zero_copy_only=False))
        nodes.append(b.column(1).to_numpy(zero_copy_only=False))
    if not sigs:
        return
    for out in _combined(np.concatenate(sigs), np.concatenate(nodes)):
        if out.column(0).null_count:
            yield out.select(["u", "v"])
        else:
            return


def _grams(n: int):
    """The n-grams of the chosen texts; a text chosen for several equal rows is sent on once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sent = WordHashes(), set()
        names = ["family", "node", "copies", "n", "blocks"]
        for b in batches:
            first = []
            for (node,) in rows(b, "node"):
                first.append(node not in sent)
                if len(sent) >= NODES_KEPT:
                    sent.clear()
                sent.add(node)
            b = b.filter(pa.array(first, pa.bool_()))
            sets = [gram_set(t, n, table) for (t,) in rows(b, "text")]
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
            yield pa.record_batch([*(b.column(b.schema.get_field_index(c)) for c in names), pa.ListArray.from_arrays(ends, pa.array(flat))], [*names, "grams"])

    return run


def pair_overlaps(flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Shared n-grams of every pair of the k sets: counted in fragments of the n-gram order and summed."""
    k = len(size)
    owner = np.repeat(np.arange(k), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.append(True, flat[1:] != flat[:-1])
    run = np.cumsum(new) - 1
    shared = np.bincount(run) > 1
    keep = shared[run]
    owner, run = owner[keep], (np.cumsum(shared) - 1)[run[keep]]
    total = np.zeros((k, k), np.float64)
    columns = int(run[-1]) + 1 if len(run) else 0
    for lo in range(0, columns, FRAGMENT_COLUMNS):
        a, b = np.searchsorted(run, (lo, lo + FRAGMENT_COLUMNS))
        m = np.zeros((k, min(FRAGMENT_COLUMNS, columns - lo)), np.float32)
        m[owner[a:b], run[a:b] - lo] = 1
        total += m @ m.T
    return total


def _join(num: int, den: int):
    """Sorted rows of (family, bi, bj): the links inside a block, or between two."""

    def links(group: list) -> Iterator[tuple]:
        bi, bj = group[0][1], group[0][2]
        size = np.array([len(r[6]) for r in group], np.int64)
        over = pair_overlaps(np.concatenate([r[6] for r in group]), size)
        ok = den * over >= num * (size[:, None] + size[None, :] - over)
        np.fill_diagonal(ok, False)
        if bi != bj:
            mine = np.array([r[3] for r in group])
            ok &= mine[:, None] != mine[None, :]
        copies = np.array([r[5] for r in group], np.int64)
        counts = ok @ copies
        parent = list(range(len(group)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(ok)))):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
        for i in np.nonzero(counts)[0].tolist():
            yield group[i][4], group[root(i)][4], int(counts[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ended() -> Iterator[pa.RecordBatch]:
            if len(group) > 1 and (out := list(links(group))):
                u, v, c = zip(*out)
                yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(c, pa.int64())], ["u", "v", "links"])

        group: list = []
        for b in batches:
            lists = b.column(b.schema.get_field_index("grams"))
            for i, r in enumerate(rows(b, "family", "bi", "bj", "block", "node", "copies")):
                if group and group[0][:3] != r[:3]:
                    yield from ended()
                    group = []
                if group and group[-1][4] == r[4]:  # equal rows, sent by several tasks; sorted by node
                    continue
                group.append((*r, lists[i].values.to_numpy(zero_copy_only=False)))
        yield from ended()

    return run


def _linked(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """ROW columns, n, node, component, low, best, links: what jaccard_components and one_of_each need of each row.

    A row is known by its id (or, without one, its text's hash) and its text's hash, so that rows that repeat an id are
    rows of their own. node names the set; low is the smallest doc_id of the component, best its first row (rows with an
    id first, by id, then by hash), links the number of other rows linked directly.
    """
    ready(docs.sparkSession)
    base = texts(docs).withColumn("h", F.xxhash64("text")).select("doc_id", "text", "h", F.col("doc_id").isNull().alias("nameless"), F.coalesce("doc_id", "h").alias("key"))
    sets = cut(base.mapInArrow(_sets(n), "doc_id long, nameless boolean, key long, h long, n long, node long"))
    classes = cut(sets.where("node is not null").groupBy("node").agg(
        F.min(F.struct("nameless", "key", "h")).alias("rep"), F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n")))
    posted = base.select("text").mapInArrow(_postings(n, num, den), "sig long, u long, v long")
    posted = posted.repartition(F.when(F.col("sig").isNull(), F.xxhash64("u", "v")).otherwise(F.col("sig")))
    ties = cut(posted.mapInArrow(_tied, "u long, v long").distinct())
    families = components(ties)
    sizes = families.join(classes, "node")
    stats = sizes.groupBy("component").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("g")).select(
        "component", F.greatest(F.ceil(F.col("k") / BLOCK_SETS), F.ceil(F.col("g") / BLOCK_GRAMS)).cast("int").alias("blocks"), "k")
    members = cut(joined_spread(sizes, stats, "component", "k", classes.count()).select(
        F.col("component").alias("family"), "node", F.col("rep.key").alias("key"), F.col("rep.h").alias("h"), "copies", "n", "blocks"))
    few = members.count() <= BROADCAST_ROWS
    chosen = base.join(F.broadcast(members) if few else members.hint("shuffle_hash"), ["key", "h"])
    grams = chosen.select("family", "node", "copies", "n", "blocks", "text").mapInArrow(_grams(n), "family long, node long, copies long, n long, blocks int, grams array<long>")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = grams.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "family", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "node", "copies", "grams")
    found = cut(dealt.repartition("family", "bi", "bj").sortWithinPartitions("family", "bi", "bj", "node").mapInArrow(_join(num, den), "u long, v long, links long"))
    together = components(found.select("u", "v")).join(classes, "node").select("node", "component", "rep", "low")
    firsts = together.groupBy("component").agg(F.min("rep").alias("best"), F.min("low").alias("lowest"), F.count(F.lit(1)).alias("k"))
    together = joined_spread(together, firsts, "component", "k", classes.count()).select("node", "component", "best", "lowest")
    degree = found.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    known = cut(classes.join(degree, "node", "left").join(together, "node", "left").select(
        "node", "copies", F.coalesce("component", "node").alias("component"), F.coalesce("best", "rep").alias("best"), F.coalesce("lowest", "low").alias("low"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    return joined_spread(sets, known, "node", "copies", sets.count(), "left")


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links: one row for each row of docs, linked where Jaccard >= num / den.

    A set is the distinct n-word shingles of the whole text (A-Z lowered, words between ASCII white space); with fewer
    words the whole sequence. Null, empty or blank texts have the empty set: they link with nothing and are components
    of their own. component_id is the smallest doc_id reachable (null where no reachable row has one), n_links the number
    of other rows linked directly; rows with equal sets link, and rows that repeat an id are rows of their own. Very long
    texts are read whole, an empty table gives none, and other columns, whatever their names, are ignored.
    """
    return _linked(docs, n, num, den).select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("low", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def _tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges found before the shuffle pass through; postings meet by signature."""

    def posted() -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = b.column(0).is_null()
            edges = b.filter(gone)
            if edges.num_rows:
                direct.append(edges.select(["u", "v"]))
            yield b.filter(b.column(0).is_valid())

    direct: list = []
    yield from _meet(posted())
    yield from direct


def one_of_each(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """docs with one row of each component: the one with the smallest doc_id (rows without come last), and of differing
    texts under that id the one with the smaller hash. Of rows equal in id and text one stays. Rows that link with
    nothing stay, among them all rows with a null, empty or blank text. Columns, whatever their names, stay as they are.
    """
    linked = _linked(docs, n, num, den).where("node is not null")
    same = (F.col("nameless") == F.col("best.nameless")) & (F.col("key") == F.col("best.key")) & (F.col("h") == F.col("best.h"))
    marked = cut(linked.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("rows"), F.max(same).alias("kept")).where("not kept or rows > 1"))
    id_, h, kept, first = unused(docs, "row_id", "row_hash", "row_kept", "row_first")
    marked = marked.select(F.col("doc_id").alias(id_), F.col("h").alias(h), F.col("kept").alias(kept))
    marked = F.broadcast(marked) if marked.count() <= BROADCAST_ROWS else marked
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(F.col("text").cast("string")) == F.col(h))
    alone = docs.join(marked, on, "left_anti")
    again = docs.join(marked.where(kept), on).groupBy(id_, h).agg(F.first(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias(first))
    return alone.unionByName(again.select(f"{first}.*"))
