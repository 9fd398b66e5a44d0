"""Chat formatting of reply trees.

Messages point to the message they answer. Iterative self-joins double the distance to a known ancestor until every
message knows its root, its depth and the score of its path; leaves are ranked by the mean score of their branch, and
the same doubled steps, taken from the longest to the shortest, list the messages of a chosen branch. Only chosen
branches are written out, so the work is linear in the messages, a logarithm of the depth apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from stratalake.llm.common import cut, ready, rows

#: Fixed values of the template. Texts hold neither "<" nor "[" once escaped, hence none of these or other control strings.
TURN, LOSS, UNLOSS, END = "<|turn|>", "<|loss|>", "<|/loss|>", "<|end|>\n"


def escaped(c: Column) -> Column:
    """Reversible: & < [ become entities."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescaped(s: str) -> str:
    return s.replace("&#10;", "\n").replace("&#91;", "[").replace("&lt;", "<").replace("&amp;", "&")


def best_paths(messages: DataFrame, top: int = 1, distinct_ids: bool = False) -> DataFrame:
    """(tree, path, depth, id): the messages of the top-ranked root-to-leaf paths of every tree.

    messages: id, parent (null or unknown: a root) and score (null: 0). tree is the root's id, path the leaf's; leaves
    rank by the mean score of their path, then its length, then their id. Of rows with one id the one with the largest
    score, then parent, counts; rows without an id, and messages on a cycle, which reach no root, are left out. An empty
    table gives none; other columns are ignored. distinct_ids: a caller's word that no id is null or repeated, which
    saves a shuffle.
    """
    base = messages.select("id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    if not distinct_ids:
        base = base.where("id is not null").groupBy("id").agg(F.max(F.struct("score", "parent")).alias("m")).select("id", "m.parent", "m.score")
    known = base.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
    base = cut(base.join(known, "parent", "left").select("id", F.when(F.col("there"), F.col("parent")).alias("up"), "score"))
    count = base.count()
    # up: the ancestor `far` steps above (null once the root is passed); root: the topmost known; total: scores below up
    step = base.select("id", "up", F.coalesce("up", "id").alias("root"), F.lit(1).cast("long").alias("far"), F.col("score").alias("total"))
    jumps = []
    for _ in range(max(1, count).bit_length()):  # twice the depth at most; what has not arrived by then is on a cycle
        jump = step.where("up is not null").select("id", "up")
        if jump.isEmpty():
            break
        jumps.append(jump)
        above = step.select(F.col("id").alias("up"), *(F.col(c).alias(f"{c}_") for c in ("up", "root", "far", "total")))
        going = step.where("up is not null").join(above, "up").select(
            "id", F.col("up_").alias("up"), F.col("root_").alias("root"), (F.col("far") + F.col("far_")).alias("far"), (F.col("total") + F.col("total_")).alias("total"))
        step = cut(going.union(step.where("up is null").select("id", "up", "root", "far", "total")))
    done = step.where("up is null").select("id", F.col("root").alias("tree"), F.col("far").alias("length"), (F.col("total") / F.col("far")).alias("mean"))
    leaves = done.join(base.where("up is not null").select(F.col("up").alias("id")), "id", "left_anti")
    if top == 1:  # combined before the shuffle, however many leaves a tree has
        best = leaves.groupBy("tree").agg(F.max_by(F.struct("id", "length"), F.struct("mean", "length", "id")).alias("b")).select("tree", "b.*")
    else:
        ranked = Window.partitionBy("tree").orderBy(F.desc("mean"), F.desc("length"), F.desc("id"))
        best = leaves.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top).select("tree", "id", "length")
    path = cut(best.select("tree", F.col("id").alias("path"), "id", (F.col("length") - 1).alias("depth")))
    for k in reversed(range(len(jumps))):  # each message of a path is reached once: distances are sums of distinct powers of two
        more = path.join(jumps[k], "id").select("tree", "path", F.col("up").alias("id"), (F.col("depth") - (1 << k)).alias("depth"))
        path = cut(path.union(more))
    return path


def formatted(turns: DataFrame) -> DataFrame:
    """Adds `formatted`, the turn as written in the template, to rows with role and text (null: empty)."""
    role, text = (escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("role", "text"))
    role = F.replace(role, F.lit("\n"), F.lit("&#10;"))  # the first line end parts role and text
    inside = F.when(F.col("role") == "assistant", F.concat(F.lit(LOSS), text, F.lit(UNLOSS))).otherwise(text)
    return turns.withColumn("formatted", F.concat(F.lit(TURN), role, F.lit("\n"), inside, F.lit(END)))


def format_trees(messages: DataFrame, top: int = 1, distinct_ids: bool = False) -> DataFrame:
    """tree, path, place, formatted: the turns of each chosen path of every reply tree in the template; a path's
    concatenation by place is one conversation.

    messages: id, parent, score, role, text, ranked and chosen as best_paths does; of rows with one id the one that
    counts there does here too, then the largest role and text. Null roles and texts are empty. No tree or path is
    gathered: their turns are rows.
    """
    ready(messages.sparkSession)
    base = messages.select("id", "parent", F.col("score").cast("double").alias("score"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    turn = base.select("id", "role", "text") if distinct_ids else base.where("id is not null").groupBy("id").agg(F.max(F.struct(F.coalesce("score", F.lit(0.0)), "parent", "role", "text")).alias("m")).select("id", "m.role", "m.text")
    return formatted(turn.join(best_paths(base, top, distinct_ids), "id")).select("tree", "path", F.col("depth").alias("place"), "formatted")


def placed(turns: DataFrame, key: str, *order: str) -> DataFrame:
    """Adds `place`, from 0, in the order within each key, without one task for a key however many rows it has.

    Rows are dealt by ranges of key and order; a row's place is its place among the rows of its key in its range plus
    those of the ranges before, of which there is one row for each key and range.
    """
    ranges = cut(turns.repartitionByRange(key, order[0]).withColumn("range", F.spark_partition_id()))
    sizes = ranges.groupBy(key, "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    known = F.col(key).eqNullSafe(F.col("key_")) & (F.col("range") == F.col("range_"))
    sizes = sizes.select(F.col(key).alias("key_"), F.col("range").alias("range_"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy(key, "range").orderBy(*order)).cast("long") - 1
    return ranges.withColumn("inside", inside).join(sizes, known).withColumn("place", F.col("inside") + F.col("first")).drop("range", "inside", "key_", "range_", "first")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, place, formatted: the turns of each conversation in the template, whose concatenation by place is its text.

    conv_id, turn, role, text may be null: null conversations are one, null turns come first, null roles and texts are
    empty. Turns answer the one before; ties in turn go by role and text, and equal rows are turns of their own. An empty
    table gives none; other columns are ignored. A conversation is a tree of one path, which goes through format_trees;
    it is never gathered: its turns are rows.
    """
    ready(conversations.sparkSession)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    turns = placed(turns, "conv_id", "turn", "role", "text")
    # one key of a message: conversation (null kept apart) and place as a struct, so that joins spread a long conversation
    name = lambda place: F.struct(F.col("conv_id").isNull().alias("n"), F.coalesce("conv_id", F.lit(0)).alias("c"), place.alias("p"))
    messages = cut(turns.select(name(F.col("place")).alias("id"), F.when(F.col("place") > 0, name(F.col("place") - 1)).alias("parent"), F.lit(1.0).alias("score"), "role", "text"))
    return format_trees(messages, distinct_ids=True).select(F.when(~F.col("tree.n"), F.col("tree.c")).alias("conv_id"), "place", "formatted")


def read_back(written: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from formatted conversations alone.

    Turns are streamed in order through running hashes, so a conversation of any length needs constant memory; its hash
    is sequential by nature, so its turns go through one task, as its text would.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> tuple:
            return name, n, turns.hexdigest(), chars, loss.hexdigest(), size

        name, n = None, 0
        for b in batches:
            out = []
            for conv, part in rows(b, "conv_id", "formatted"):
                if n and conv != name:
                    out.append(close())
                    n = 0
                if not n:
                    name, turns, loss, chars, size = conv, hashlib.sha256(), hashlib.sha256(), 0, 0
                size += len(part)
                role, body = part.removeprefix(TURN).removesuffix(END).split("\n", 1)
                if body.startswith(LOSS):
                    body = unescaped(body[len(LOSS) : -len(UNLOSS)])
                    chars += len(body)
                    loss.update(body.encode())
                else:
                    body = unescaped(body)
                turns.update(f"{unescaped(role)}\n{body}\n".encode())
                n += 1
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
        if n:
            yield pa.record_batch([pa.array([c], k) for c, k in zip(close(), kinds)], names)

    dealt = written.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "formatted")
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
