"""Document fingerprints: a homomorphic multiset hash of a text's pieces, in DataFrame expressions only.

Paragraphs, cut further at sentence ends and after PIECE characters, are hashed to wide vectors whose sum, modulo powers
of two, is the fingerprint: it does not depend on the order of the pieces, and adding or taking away a piece adds or
subtracts its vector. Of the WORDS components, 60 hold 120 counters of 30 bits (a hash bit each), two hold hash sums
modulo 2**60, and one counts pieces. No text that Spark can hold has 2**30 pieces, so no counter runs into its neighbour.
Centred counters are a random projection of the multiset: their cosine estimates how alike two texts are.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

PIECE = 96
#: Counters of 30 bits, two to a word; a sum modulo 2**60 keeps every word.
BITS = 30
FIELD = (1 << BITS) + 1
MODULUS = 1 << 60
SEEDS, SHIFTS = (11, 29), 30
WORDS = len(SEEDS) * SHIFTS + len(SEEDS) + 1


def pieces(text: Column) -> Column:
    pattern = rf"[^\n.!?]{{0,{PIECE}}}+[\n.!?]++|[^\n.!?]{{1,{PIECE}}}+"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _summed(hashes: Column, value) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: (a + value(h)).bitwiseAND(F.lit(MODULUS - 1)))


def vectors(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the fingerprint vector of column `text` as `name` (array of WORDS longs)."""
    made = df.withColumn("_pieces", pieces(F.col(text)))
    hashed = lambda seed: F.transform("_pieces", lambda p: F.xxhash64(p, F.lit(seed)))
    made = made.withColumn("_hashes", F.array(*map(hashed, SEEDS)))
    words = []
    for k in range(len(SEEDS)):
        h = F.col("_hashes")[k]
        words += [_summed(h, lambda x, j=j: F.shiftrightunsigned(x, j).bitwiseAND(F.lit(FIELD))) for j in range(SHIFTS)]
        words.append(_summed(h, lambda x: F.shiftrightunsigned(x, 4)))
    words.append(F.size(F.col("_hashes")[0]).cast("long"))
    return made.withColumn(name, F.array(*words)).drop("_pieces", "_hashes")


def plus(a: Column, b: Column) -> Column:
    """The vector of both multisets together."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(MODULUS - 1)))


def minus(a: Column, b: Column) -> Column:
    """The vector of the multiset a without the multiset b."""
    return F.zip_with(a, b, lambda x, y: (x - y + F.lit(MODULUS)).bitwiseAND(F.lit(MODULUS - 1)))


def as_text(vector: Column) -> Column:
    """16 hex digits a word, as base64."""
    return F.base64(F.unhex(F.array_join(F.transform(vector, lambda x: F.lpad(F.hex(x), 16, "0")), "")))


def _centred(vector: Column) -> Column:
    per = SHIFTS + 1
    kept = F.concat(*(F.slice(vector, k * per + 1, SHIFTS) for k in range(len(SEEDS))))
    n = F.element_at(vector, -1)
    field = lambda s: F.transform(kept, lambda x: (F.shiftrightunsigned(x, s).bitwiseAND(F.lit((1 << BITS) - 1)) * 2 - n).cast("double"))
    return F.concat(field(0), field(BITS))


def likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Cosine of the centred counters, 0 to 1; 1 for equal vectors, 0 if one alone has no pieces."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    made = df.withColumn("_a", _centred(F.col(a))).withColumn("_b", _centred(F.col(b)))
    x, y = F.col("_a"), F.col("_b")
    norm = F.sqrt(dot(x, x) * dot(y, y))
    value = F.when(F.col(a) == F.col(b), 1.0).when(norm == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(x, y) / norm)))
    return made.withColumn(name, value.cast("double")).drop("_a", "_b")


#: Rows a bucket of neighbouring ids holds on average, and the most buckets.
BUCKET_ROWS, BUCKETS = 2000, 8192


def with_next(docs: DataFrame, made=lambda df: df, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text and carried columns of each row, and the same of the next row (next_...), by doc_id and then text;
    after the last row comes the first. Null ids come first. made adds the carried columns, which follow from the text;
    it is applied once to each row, and once more to the first row of each bucket.

    Ids are dealt into buckets by quantiles, and each bucket also receives the first row of the bucket after it, so
    neighbours meet in windows over buckets: no window spans the table.
    """
    keyed = docs.withColumn("_key", F.coalesce("doc_id", F.lit(-(2**63))))
    n = docs.count()
    if not n:
        return made(keyed).select("doc_id", "text", *carried, *(F.col(c).alias(f"next_{c}") for c in ("text", *carried)))
    wanted = min(BUCKETS, n // BUCKET_ROWS)
    bounds: list[int] = []
    if wanted > 1:
        at = [i / wanted for i in range(1, wanted)]
        bounds = sorted(set(keyed.agg(F.percentile_approx("_key", at, 20 * wanted)).first()[0]))
    bucket = F.lit(0)
    if bounds:
        array, steps = F.array(*map(F.lit, bounds)), [1 << k for k in reversed(range(len(bounds).bit_length()))]
        bucket = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda a, s: F.when(
            (a + s <= len(bounds)) & (F.get(array, F.least(a + s, F.lit(len(bounds))) - 1) <= F.col("_key")), a + s).otherwise(a))
    keyed = keyed.withColumn("_bucket", bucket)
    heads = keyed.groupBy("_bucket").agg(F.min("_key").alias("_key"))  # a row for each bucket
    heads = heads.withColumn("_to", F.coalesce(F.lag("_bucket").over(Window.orderBy("_bucket")), F.max("_bucket").over(Window.partitionBy())))
    first = keyed.drop("_bucket").join(F.broadcast(heads.select("_key", "_to")), "_key")
    first = first.groupBy("_to").agg(F.min("text").alias("text")).withColumnRenamed("_to", "_bucket")
    guest = made(first).select("_bucket", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("_key"), "text", *carried, F.lit(1).alias("_guest"))
    both = made(keyed).select("_bucket", "doc_id", "_key", "text", *carried, F.lit(0).alias("_guest")).unionByName(guest)
    order = Window.partitionBy("_bucket").orderBy("_guest", "_key", "text")
    return both.select("doc_id", "text", *carried, "_guest", *(F.lead(c).over(order).alias(f"next_{c}") for c in ("text", *carried))).where("_guest = 0").drop("_guest")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs.

    The edited text keeps all but the last floor(n / 2) code points and goes on with the first as many (or all) of the
    next row's text, by doc_id and text. Null text counts as empty; a single row is its own next; repeated rows follow
    each other; null ids come first; texts of any length are read whole; an empty table gives none. Other columns are
    ignored. A row's vector is computed once and goes along to the row before it.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    both = with_next(base, lambda df: vectors(df, "text", "v"), ("v",)).withColumnRenamed("next_v", "x")
    half = F.floor(F.length("text") / 2).cast("int")
    both = both.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    made = vectors(both, "edited", "e")
    made = made.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "v", "e", "x")
    made = likeness(likeness(made, "v", "e", "near_edited"), "v", "x", "near_next")
    return made.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("v")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"), "near_edited", "near_next")
