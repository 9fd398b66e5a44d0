"""Cheapest repairs of conversations, by dynamic programming over turns with ranks in place of strings.

A turn is kept, given another role or deleted, after a run of inserted turns; run and turn are one macro edit, written as a
code ("IK": insert, keep). Codes end at their only letter that isn't I, so none is the start of another, and two lists of
as many codes compare as their strings do. Hence a layer of the dynamic program (a turn) needs no strings: each state keeps
its cost, the rank of its string among those of the layer, and where it came from; the ranks of the next layer follow from
pairs (rank, code). Strings are read off the parent pointers afterwards.

Long conversations are cut into blocks. A block is solved from every state it can be entered in; ranks order all its
solutions alike, so blocks are chained by the same step as turns, on a few numbers each, and read off block by block.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from stratalake.llm.common import cut, joined_spread, ready, rows

#: Turns in a block, at most.
BLOCK = 4096
#: Costs of the edits.
REROLE, DELETE, INSERT, CLIPPED = 3, 4, 3, 3
#: What has been written so far: nothing, a system turn, a user's turn last, an assistant's turn last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Macro edits in the order of their letters. Longer runs, or runs that end where they began, only cost more.
CODES = sorted("I" * k + t for k in range(3) for t in "DKR")
#: The state after a turn of a user or an assistant is inserted or written.
_NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: What must be added at the end, by state.
_ENDINGS = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
NAMES = {USER: "user", ASSISTANT: "assistant"}


def _steps(initial: str, faulty: bool, clipped: bool) -> list[tuple[int, int, int, int]]:
    """(from, to, cost, code): the macro edits of one turn; of those between two states the cheapest, then least."""
    best: dict = {}
    for state in range(4):
        for code, edits in enumerate(CODES):
            at, cost = state, 0
            for e in edits[:-1]:
                at, cost = _NEXT[at], cost + INSERT
            if edits[-1] == "D":
                cost += DELETE
            elif faulty:
                continue
            elif edits[-1] == "R":
                at, cost = _NEXT[at], cost + REROLE + CLIPPED * clipped
            else:
                kept = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}.get(initial, {})
                if at not in kept:
                    continue
                at, cost = kept[at], cost + CLIPPED * clipped
            if (cost, code) < best.get((state, at), (1 << 30, 0)):
                best[state, at] = cost, code
    return [(a, b, *v) for (a, b), v in best.items()]


_STEPS = {(i, f, c): _steps(i, f, c) for i in ("s", "u", "a", "") for f, c in ((False, False), (False, True), (True, False))}


def layer(held: dict, steps: list[tuple[int, int, int, int]]) -> tuple[dict, dict]:
    """One step. held: (entry, state) -> (cost, rank); gives the same for the next layer, and (entry, state) -> (state before, code)."""
    found: dict = {}
    for (entry, state), (cost, rank) in held.items():
        for a, b, more, code in steps:
            if a == state:
                new = cost + more, rank, code, state
                if (entry, b) not in found or new < found[entry, b]:
                    found[entry, b] = new
    order = {key: k for k, key in enumerate(sorted({v[1:3] for v in found.values()}))}
    return {k: (v[0], order[v[1:3]]) for k, v in found.items()}, {k: (v[3], v[2]) for k, v in found.items()}


def solve(turns: list[tuple[str, bool, bool]], entries: tuple[int, ...]) -> tuple[dict, bytes]:
    """The last layer of a block, and its pointers: 16 bytes a turn, state before * 16 + code at entry * 4 + state."""
    held, back = {(e, e): (0, 0) for e in entries}, bytearray(16 * len(turns))
    for t, (initial, faulty, clipped) in enumerate(turns):
        held, came = layer(held, _STEPS[initial if initial in "sua" else "", faulty, clipped and not faulty])
        for (entry, state), (before, code) in came.items():
            back[16 * t + 4 * entry + state] = 16 * before + code
    return held, bytes(back)


def chain(blocks: list[dict]) -> tuple[int, list[tuple[int, int]], str]:
    """(cost, [(entry, exit) of each block], ending) of the cheapest repair of a conversation, from its blocks' last layers."""
    held, ways = {NOTHING: (0, 0)}, []
    for block in blocks:
        found: dict = {}
        for (entry, state), (cost, rank) in block.items():
            if entry in held:
                new = held[entry][0] + cost, held[entry][1], rank, entry
                if state not in found or new < found[state]:
                    found[state] = new
        order = {key: k for k, key in enumerate(sorted({v[1:3] for v in found.values()}))}
        held, way = {k: (v[0], order[v[1:3]]) for k, v in found.items()}, {k: v[3] for k, v in found.items()}
        ways.append(way)
    cost, _, ending, state = min((c + INSERT * len(_ENDINGS[s]), r, _ENDINGS[s], s) for s, (c, r) in held.items())
    path = []
    for way in reversed(ways):
        path.append((way[state], state))
        state = way[state]
    return cost, path[::-1], ending


def replay(turns: list[tuple[str, str]], back: bytes, entry: int, leave: int, ending: str) -> tuple[str, list[str]]:
    """The edits of a block and its repaired turns as `role:text`, read off the pointers from the end."""
    state, codes = leave, []
    for t in reversed(range(len(turns))):
        way = back[16 * t + 4 * entry + state]
        codes.append(CODES[way & 15])
        state = way >> 4
    lines = []
    for (role, text), code in zip([*turns, ("", "")], [*reversed(codes), ending]):
        for e in code:
            if e in "IR":
                state = _NEXT[state]
                lines.append(f"{NAMES[state]}:{text if e == 'R' else ''}")
            elif e == "K":
                state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
                lines.append(f"{role}:{text}")
    return "".join(reversed(codes)) + ending, lines


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with turns dropped, emptied, cut short, doubled or given to the user, as a checksum of
    `conv_id:turn` has it. Nulls of role and text, and in the checksum, are one space."""
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                             *(F.coalesce(F.col(n).cast("string"), F.lit(" ")).alias(n) for n in ("role", "text")))
    spelt = [F.coalesce(F.col(n).cast("string"), F.lit(" ")) for n in ("conv_id", "turn")]
    c = c.withColumn("kind", F.crc32(F.concat(spelt[0], F.lit(":"), spelt[1])) % 20).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return c.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("t")).drop("t")


def in_order(turns: DataFrame) -> DataFrame:
    """Turns with none (no conv_id), conv, place (from 0 in each conversation, by turn, role and text), without one task for
    a conversation. Ranges of the order are numbered each; a conversation begun in an earlier range, of which each range has
    one at most, is told by broadcast how many turns came before."""
    key, order = ["none", "conv"], ["turn", "role", "text"]
    named = turns.select(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0)).alias("conv"), *order)
    ranges = cut(named.repartitionByRange(*key, *order).withColumn("range", F.spark_partition_id()))
    before = Window.partitionBy(*key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    first = ranges.groupBy(*key, "range").agg(F.count(F.lit(1)).alias("n")).select(*key, "range", F.sum("n").over(before).alias("first")).where("first > 0")
    inside = F.row_number().over(Window.partitionBy(*key, "range").orderBy(*order)).cast("long") - 1
    return ranges.withColumn("inside", inside).join(F.broadcast(first), [*key, "range"], "left").select(
        *key, *order, (F.col("inside") + F.coalesce("first", F.lit(0))).alias("place"))


def with_repeats(turns: DataFrame) -> DataFrame:
    """Adds `repeated`: a turn before it in the conversation has its role and text. One first place goes to each text that
    occurs again, met by broadcast where the text is very frequent."""
    parts = F.concat(F.col("none").cast("string"), F.lit(" "), F.col("conv").cast("string"), F.lit(" "), F.length("role").cast("string"), F.lit(" "), F.col("role"), F.col("text"))
    turns = cut(turns.withColumn("same", F.sha2(parts, 256)))
    again = turns.groupBy("same").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1")
    return joined_spread(turns, again, "same", "k", turns.count(), "left").withColumn("repeated", F.coalesce(F.col("place") > F.col("first"), F.lit(False))).drop("same", "first")


def grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], names: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """(key, its rows) from batches sorted by key; rows are handed on one by one."""
    from itertools import groupby

    every = (r for b in batches for r in rows(b, *keys, *names))
    for key, part in groupby(every, key=lambda r: r[: len(keys)]):
        yield key, (r[len(keys) :] for r in part)


def batched(out: Iterator[tuple], names: list[str], kinds: list[pa.DataType], size: int = 64) -> Iterator[pa.RecordBatch]:
    from itertools import islice

    while part := list(islice(out, size)):
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*part), kinds)], names)


def over(df: DataFrame, keys: tuple[str, ...], names: tuple[str, ...], f: Callable[[tuple, Iterator[tuple]], tuple], schema: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """One row a key: f(key, rows) of df dealt by `keys` and sorted by keys and the first of `names`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched((f(k, part) for k, part in grouped(batches, keys, names)), list(schema), [k for _, k in schema.values()])

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, names[0]).select(*keys, *names)
    return dealt.mapInArrow(run, ", ".join(f"{n} {t}" for n, (t, _) in schema.items()))


def block_row(key: tuple, turns: Iterator[tuple]) -> tuple:
    """What a block is known by: last layer, pointers, turns, counts of faults, and its ends."""
    none, conv, block = key
    blank = repeats = clips = illegal = distinct = 0
    plain, last, initials, first_turn, last_turn = [], None, [], None, None
    states = []
    for _, turn, role, text, repeated in turns:
        kept = text.strip(" \t\n\v\f\r")
        faulty, clipped = not kept or repeated, bool(kept) and not repeated and kept[-1] not in ".!?"
        blank, repeats, clips = blank + (not kept), repeats + (bool(kept) and repeated), clips + clipped
        initial = role[:1]
        illegal += last is not None and last + initial not in ("su", "ua", "au")
        last = initial
        initials.append(initial)
        if turn is not None:
            distinct += turn != last_turn
            first_turn, last_turn = (turn if first_turn is None else first_turn), turn
        plain.append((role, text))
        states.append((initial, faulty, clipped))
    held, back = solve(states, (NOTHING,) if block == 0 else (NOTHING, SYSTEM, USER, ASSISTANT))
    ends = [v for (e, s), (c, r) in sorted(held.items()) for v in (e, s, c, r)]
    return (none, conv, block, ends, zlib.compress(back, 1), [r for r, _ in plain], [t for _, t in plain],
            [blank, repeats, clips, illegal, distinct], [initials[0], initials[-1]], [first_turn, last_turn])


def chained(key: tuple, blocks: Iterator[tuple]) -> tuple:
    """Counts and the way through the blocks of a conversation: a few numbers a block."""
    layers, totals, illegal_between, low, high, last, distinct = [], [0] * 4, 0, None, None, None, 0
    for _, ends, counts, initials, turns in blocks:
        layers.append({(e, s): (c, r) for e, s, c, r in zip(*[iter(ends)] * 4)})
        totals = [a + b for a, b in zip(totals, counts)]
        illegal_between += last is not None and last + initials[0] not in ("su", "ua", "au")
        last = initials[1]
        distinct += counts[4] - (counts[4] > 0 and turns[0] == high)
        if turns[0] is not None:
            low, high = (turns[0] if low is None else low), turns[1]
    cost, path, ending = chain(layers)
    gaps = 0 if low is None else high - low + 1 - distinct
    return (*key, gaps, *totals[:3], totals[3] + illegal_between, cost, [v for p in path for v in p], ending)


def repair(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, place, audit, repaired, last: blocks of repaired conversations in order; audit has the edits' initials, and
    repaired the turns as `role:text`, a line each. Also the counts of faults of the whole conversation and its cost.

    conv_id, turn, role, text may be null: null conversations are one, null turns come first, null roles and texts are one
    space. Turns of one number go by role and text; equal rows are turns of their own, of which all but the first repeat.
    Texts may have any length: a task holds a block. A conversation without rows isn't there; an empty table gives none;
    other columns are ignored.
    """
    ready(conversations.sparkSession)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                 *(F.coalesce(F.col(n).cast("string"), F.lit(" ")).alias(n) for n in ("role", "text")))
    turns = with_repeats(in_order(turns)).withColumn("block", (F.col("place") / block).cast("long"))
    key = {"none": ("boolean", pa.bool_()), "conv": ("long", pa.int64())}
    longs, strings = ("array<long>", pa.list_(pa.int64())), ("array<string>", pa.list_(pa.string()))
    at, one = ("long", pa.int64()), ("binary", pa.binary())
    blocks = cut(over(turns, ("none", "conv", "block"), ("place", "turn", "role", "text", "repeated"), block_row,
                      key | {"block": at, "ends": longs, "back": one, "roles": strings, "texts": strings, "counts": longs, "initials": strings, "turns": longs}))
    ways = over(blocks, ("none", "conv"), ("block", "ends", "counts", "initials", "turns"), chained,
                key | {n: at for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"path": longs, "ending": ("string", pa.string())})
    # a block is told where it is entered and left: its own two numbers of the path
    step = F.posexplode(F.transform(F.sequence(F.lit(0), (F.size("path") / 2 - 1).cast("int")), lambda k: F.slice("path", k * 2 + 1, 2)))
    told = ways.select(*[c for c in ways.columns if c != "path"], (F.size("path") / 2 - 1).cast("long").alias("final"), step.alias("block", "between"))
    told = told.withColumn("block", F.col("block").cast("long"))
    names = ["none", "conv", "block", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired", "lines"]
    kinds = [pa.bool_()] + [pa.int64()] * 8 + [pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for b in batches:
                for *known, final, (entry, leave), ending, back, roles, texts in rows(b, *names[:9], "final", "between", "ending", "back", "roles", "texts"):
                    audit, lines = replay(list(zip(roles, texts)), zlib.decompress(back), entry, leave, ending if known[2] == final else "")
                    yield (*known, audit, "\n".join(lines), len(lines))

        yield from batched(out(), names, kinds)

    both = told.join(blocks.select("none", "conv", "block", "back", "roles", "texts"), ["none", "conv", "block"])
    return both.mapInArrow(run, "none boolean, conv long, block long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired string, lines long").select(
        F.when(~F.col("none"), F.col("conv")).alias("conv_id"), F.col("block").alias("place"), *names[3:])


def summary(repaired: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row for each conv_id of conversations: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Blocks are streamed in order through a running hash; conversations that repaired has not are empty. A null conv_id is
    a conversation; repeated rows of conversations are one; empty tables give none.
    """
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def whole(key: tuple, blocks: Iterator[tuple]) -> tuple:
        audit, digest, begun = [], hashlib.sha256(), False
        for _, *known, edits, text, lines in blocks:
            audit.append(edits)
            if lines:
                digest.update(("\n" + text if begun else text).encode())
                begun = True
        return (*key, *known, "".join(audit), digest.hexdigest())

    long, text = ("long", pa.int64()), ("string", pa.string())
    named = repaired.withColumn("none", F.col("conv_id").isNull()).withColumn("conv", F.coalesce("conv_id", F.lit(0)))
    found = over(named, ("none", "conv"), ("place", *counts, "audit", "repaired", "lines"), whole,
                 {"none": ("boolean", pa.bool_()), "conv": long} | {c: long for c in counts} | {"audit": text, "repaired_sha256": text})
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().select(
        "conv_id", F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0)).alias("conv"))
    return every.join(found, ["none", "conv"], "left").select(
        "conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
