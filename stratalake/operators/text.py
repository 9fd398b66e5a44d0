"""Text retrieval: attested vocabulary, TF-IDF of words and character n-grams, weighted recall, query parsing."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame


def words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def char_grams(text: Column, low: int = 3, high: int = 5) -> Column:
    """n-grams of each word between its borders (marked by spaces)."""
    padded = F.transform(words(text), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    def of(n):
        return lambda w: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.concat(*(F.transform(padded, of(n)) for n in range(low, high + 1))))


def attested(df: DataFrame, text: str, least: int, share: float) -> DataFrame:
    """term, df: terms in at least `least` rows and at most a share of them."""
    n = df.count()
    return df.select(F.explode(F.array_distinct(words(F.col(text)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).where((F.col("df") >= least) & (F.col("df") <= share * n))


#: Rows whose terms one task counts and joins, on average.
TASK_ROWS = 2000


def tfidf_search(df: DataFrame, key: str, terms: Column, query_terms: list[str]) -> DataFrame:
    """key, score: cosine of sublinear TF-IDF vectors with the query's.

    Keys are unique. Rows are dealt by their key as they are, so that terms are counted where they are parted; how many
    rows hold a term is counted before any shuffle. The query is a short list whose weights ride on the IDF table, which
    is joined by term, so that lengths and products are sums of one aggregation. Terms are many times what their texts are,
    so tasks are numbered by rows, not by bytes: what one holds at once doesn't grow with the input.
    """
    n = df.count()
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_ROWS))
    seen = df.select(F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("rows"))
    idf = seen.select("term", (F.log(F.lit(1.0 + n) / (1 + F.col("rows"))) + 1).alias("idf"))
    tf = df.repartition(tasks, key).select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    counts: dict[str, int] = {}
    for t in query_terms:
        counts[t] = counts.get(t, 0) + 1
    asked = df.sparkSession.createDataFrame(list(counts.items()), "term string, qtf long")
    weights = idf.join(F.broadcast(asked), "term", "left").select("term", "idf", ((1 + F.log("qtf")) * F.col("idf")).alias("qw"))
    own = weights.agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qlen"))  # one row
    w = tf.repartition(tasks, "term").join(weights.repartition(tasks, "term"), "term").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    met = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"), F.sum(F.col("w") * F.col("qw")).alias("dot")).where("dot is not null")
    return met.join(F.broadcast(own), F.lit(True)).select(key, (F.col("dot") / (F.col("len") * F.col("qlen"))).alias("score"))


def parsed(query: Column) -> Column:
    """wanted and unwanted clauses of a query.

    What follows a NOT, up to the next one, is unwanted, as are words with a leading minus wherever they stand before it;
    the rest is parted at AND or ;. A query that wants nothing wants its own text.
    """
    sides = F.split(query, r"\bNOT\b")
    terms = F.transform(F.split(sides[0], r"\bAND\b|;"), lambda t: F.filter(F.split(F.trim(t), r"\s+"), lambda w: w != ""))
    minus = lambda w: w.rlike(r"^-.")
    wanted = F.filter(F.transform(terms, lambda ws: F.array_join(F.filter(ws, lambda w: ~minus(w)), " ")), lambda t: t != "")
    after = F.filter(F.transform(F.slice(sides, 2, F.size(sides)), lambda t: F.trim(t)), lambda t: t != "")
    words = F.transform(F.filter(F.flatten(terms), minus), lambda w: F.substring(w, F.lit(2), F.length(w)))
    return F.struct(F.when(F.size(wanted) > 0, wanted).otherwise(F.array(query)).alias("wanted"), F.concat(after, words).alias("unwanted"))


def tokens(text: Column) -> Column:
    """A text's words, and what stands between them, with commas apart: all of it, in order."""
    return F.regexp_extract_all(text, F.lit(r"\w+|,|[^\w,]+"), F.lit(0))


#: Words that part clauses.
PARTING = ("then", "and", "AND")


def clauses(query: Column) -> Column:
    """The query with single spaces, and after it its parts between commas, "and", "AND" and "then" that have two words
    or more and aren't the whole query, in order.

    Tokens are walked once: each joins the part that is open, or closes it.
    """
    whole = F.regexp_replace(F.trim(query), r"\s+", " ")

    def take(state: Column, token: Column) -> Column:
        parts = (token == ",") | token.isin(*PARTING)
        return F.struct(F.when(parts, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"]).alias("done"),
                        F.when(parts, "").otherwise(F.concat(state["open"], token)).alias("open"))

    none = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    parts = F.aggregate(F.concat(tokens(whole), F.array(F.lit(","))), none, take, lambda s: F.transform(s["done"], lambda p: F.trim(p)))
    return F.concat(F.array(whole), F.filter(parts, lambda p: p.contains(" ") & (F.lower(p) != F.lower(whole))))


# fixed values: articles, the words that end a phrase (articles among them), and heads that name the scene itself
ARTICLES = ("a", "an", "the")
ENDS = ("a", "an", "the", "and", "then", "it", "of", "to", "on", "in", "into", "onto", "from", "at")
SCENE = ("table", "robot", "arm")


def phrases(query: Column) -> Column:
    """Phrases of an article and up to three words after it, parted by white space alone, in lower case, each once, in
    order. A word of ENDS closes a phrase and is dropped from its end; phrases that name the scene, or nothing, go.

    Tokens are walked once with the phrase that is open: an article opens one; the third word, a word of ENDS or anything
    but white space closes it. What closes it isn't looked at again as an opening, if it was a word of the phrase.
    """
    nothing = F.array().cast("array<string>")

    def close(state: Column, word: Column | None) -> Column:
        taken = state["open"] if word is None else F.concat(state["open"], F.array(word))
        return F.struct(F.concat(state["done"], F.array(taken)).alias("done"), nothing.alias("open"))

    def take(state: Column, token: Column) -> Column:
        word, gap, held = token.rlike(r"^\w"), token.rlike(r"^\s+$"), F.size(state["open"])
        last = (held == 3) | token.isin(*ENDS)
        more = F.struct(state["done"].alias("done"), F.concat(state["open"], F.array(token)).alias("open"))
        return (F.when((held == 0) & word & token.isin(*ARTICLES), more).when((held == 0) | gap, state)
                .when(~word, close(state, None)).when(last, close(state, token)).otherwise(more))

    def bare(phrase: Column) -> Column:
        """A phrase without the words of ENDS at its end; the words before the last one that isn't of them stay."""
        inner = F.transform(phrase, lambda w, i: F.when((i > 0) & ~w.isin(*ENDS), i + 1).otherwise(F.lit(0)))
        return F.slice(phrase, F.lit(1), F.array_max(inner))

    none = F.struct(F.array().cast("array<array<string>>").alias("done"), nothing.alias("open"))
    found = F.aggregate(F.concat(tokens(F.lower(query)), F.array(F.lit("."))), none, take, lambda s: F.transform(s["done"], bare))
    kept = F.filter(found, lambda p: (F.size(p) > 1) & ~F.get(p, F.lit(1)).isin(*SCENE))
    return F.array_distinct(F.transform(kept, lambda p: F.array_join(p, " ")))


def stem(word: Column) -> Column:
    """Light stemming: a plural or verb ending goes from words of over four letters."""
    return F.when(F.length(word) > 4, F.regexp_replace(word, "(ing|ed|es|s)$", "")).otherwise(word)


def recall(df: DataFrame, fields: dict[str, float], query: str) -> DataFrame:
    """Rows with a score: for each distinct stem of the query, how often the fields hold it, times the field's weight."""
    wanted = df.sparkSession.range(1).select(F.array_distinct(F.transform(words(F.lit(query)), stem)).alias("w")).first()["w"]
    score = F.lit(0.0)
    for f, weight in fields.items():
        score = score + weight * F.size(F.filter(F.transform(words(F.col(f)), stem), lambda w: w.isin(wanted)))
    return df.withColumn("score", score).where("score > 0")
