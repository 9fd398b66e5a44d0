"""Named objects in sequences of sparse word lists: spellings of names, scores, sightings by name and by example, places.

Objects are a stated set (object, name, describe, aliases): each is met with every step, so the work is objects x steps,
made in the tasks that hold the steps and never shuffled; shuffles carry steps, listed words that a name asks for, and one
histogram of `cuts.BINS` bins for each object and task.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from stratalake.operators import cuts, islands
from stratalake.operators.intervals import range_join

# Words that name nothing, and colours, which don't say where something is.
STOP = """the a an and or of to in on at from into onto with for by is are was were be been being it its
this that these those there here as up down out over under near next left right top bottom front back side view
camera image video frame scene shot while then also very can could has have had not no his her their our your my
one two some any all each which what who when where how she he they them we you""".split()
COLOURS = """black white blue red green yellow gray grey brown orange pink purple beige cream tan navy teal
silver gold golden dark light bright pale colorful colourful colored coloured""".split()

#: Words of a place, words of a step that can name it, and letters that such a word has at least.
PLACE, LISTED, LETTERS = 5, 64, 3


def _capital(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.expr("substring(w, 2)"))


def name_words(objects: DataFrame, pieces: DataFrame) -> DataFrame:
    """object, phrase, word, id: the pieces that may stand for each word of each phrase of an object.

    objects: object, name, describe, aliases. A phrase is what describes the object (its name where nothing does), or an
    alias; its words are those outside STOP, or all of them if none is. Each of four spellings (as said or with a capital,
    each after a space or not) gives the longest piece that it begins with. pieces: piece (each once), id.
    Null, empty or blank phrases, and words that begin with no piece, give no rows; repeated objects give theirs once.
    """
    said = F.filter(F.concat(F.array(F.coalesce("describe", "name")), F.coalesce("aliases", F.array().cast("array<string>"))), lambda p: p.isNotNull())
    phrases = objects.select("object", F.posexplode(said).alias("phrase", "said"))
    words = phrases.withColumn("ws", F.filter(F.split(F.lower("said"), r"\s+"), lambda w: w != ""))
    words = words.withColumn("kept", F.filter("ws", lambda w: ~w.isin(STOP)))
    words = words.select("object", "phrase", F.posexplode(F.when(F.size("kept") > 0, F.col("kept")).otherwise(F.col("ws"))).alias("word", "w"))
    forms = F.array("w", F.concat(F.lit(" "), "w"), _capital(F.col("w")), F.concat(F.lit(" "), _capital(F.col("w"))))
    forms = words.select("object", "phrase", "word", F.explode(forms).alias("form"))
    begins = F.explode(F.transform(F.sequence(F.lit(1), F.length("form")), lambda n: F.col("form").substr(F.lit(1), n)))
    edges = forms.select("*", begins.alias("piece")).join(pieces.select("piece", "id"), "piece")
    longest = edges.groupBy("object", "phrase", "word", "form").agg(F.max_by("id", F.length("piece")).alias("id"))
    return longest.select("object", "phrase", "word", "id").distinct()


def _listed(steps: DataFrame, most: int | None = None) -> DataFrame:
    pairs = F.arrays_zip("ids", "lps")
    e = steps.select("rec", "pos", "floor", F.explode(pairs if most is None else F.slice(pairs, 1, most)).alias("e"))
    return e.select("rec", "pos", "floor", F.col("e.ids").alias("id"), F.col("e.lps").alias("lp"))


def name_scores(steps: DataFrame, words: DataFrame) -> DataFrame:
    """rec, pos, object, score: how much more each step says an object's name than steps do on average.

    A word is worth its best piece in the step, or the step's floor; less its mean over all steps; a phrase is worth the
    mean of its words, an object its best phrase. steps: rec, pos, floor, ids, lps (each listed one at least the floor);
    words: as `name_words` gives them. Scores are rounded to nine places, so that their cut doesn't hang on the order of
    sums. A step is its floor plus the excess of what it lists, so only listed words that a name asks for are joined.
    Steps without rec, pos or floor are left out; repeated steps count each but share their words' excess.
    """
    steps = steps.where("rec is not null and pos is not null and floor is not null")
    whole = steps.agg(F.count(F.lit(1)).alias("n"), F.avg("floor").alias("mid"))
    hits = _listed(steps).join(words, "id").groupBy("object", "phrase", "word", "rec", "pos").agg(F.max(F.col("lp") - F.col("floor")).alias("over"))
    size = words.groupBy("object", "phrase").agg(F.count_distinct("word").alias("words"))
    usual = size.join(hits.groupBy("object", "phrase").agg(F.sum("over").alias("sum")), ["object", "phrase"], "left").join(F.broadcast(whole), F.lit(True))
    usual = usual.select("object", "phrase", "words", "mid", (F.coalesce("sum", F.lit(0.0)) / F.col("n") / F.col("words")).alias("less"))
    said = hits.groupBy("object", "phrase", "rec", "pos").agg(F.sum("over").alias("over")).join(usual, ["object", "phrase"])
    said = said.groupBy("object", "rec", "pos").agg(F.max(F.col("over") / F.col("words") - F.col("less")).alias("x"))
    said = said.groupBy("rec", "pos").agg(F.map_from_entries(F.collect_list(F.struct("object", "x"))).alias("said"))  # an entry an object at most
    base = usual.groupBy("object").agg(F.max(-F.col("less")).alias("base"), F.max("mid").alias("mid"))
    base = base.agg(F.collect_list(F.struct("object", "base", "mid")).alias("all"))  # the stated set of objects
    # steps are few bytes and many scores: dealt by number, as adaptive execution would put them into too few tasks
    tasks = int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = steps.select("rec", "pos", "floor").join(said, ["rec", "pos"], "left").repartition(tasks, "rec", "pos").join(F.broadcast(base), F.lit(True))
    each = met.select("rec", "pos", "floor", "said", F.explode("all").alias("o"))
    value = F.greatest(F.col("o.base"), F.coalesce(F.try_element_at("said", F.col("o.object")), F.col("o.base")))
    return each.select("rec", "pos", F.col("o.object").alias("object"), F.round(F.col("floor") - F.col("o.mid") + value, 9).alias("score"))


def present(scores: DataFrame) -> DataFrame:
    """The scores over the cut that each object's own scores show; none where they show none."""
    return scores.join(F.broadcast(cuts.split_per(scores, ["object"], "score", few=True)), "object").where(F.col("score") > F.col("cut")).drop("cut")


def places(spans: DataFrame, steps: DataFrame, words: DataFrame, pieces: DataFrame) -> DataFrame:
    """spans (object, rec, t0, t1, each once, and what else they have) with place, end_place: the words of most mass in the
    steps of each span, and in its last one, that aren't the object's own, its plural or singular, in STOP or COLOURS, or
    short; best first, equal ones by word. Empty where there is none.

    What a stretch says is the same for all objects: words are summed once for each different stretch, and its objects are
    one row beside them. Each object then takes the first words that aren't its own; so a list is needed no further than
    by as many words as an object has. Words that can't name a place are dropped before steps meet stretches.
    """
    at = ["rec", "t0", "t1"]
    own = words.join(pieces, "id").select("object", F.lower(F.trim("piece")).alias("w")).where("w <> ''")
    own = own.select("object", F.explode(F.array("w", F.concat("w", F.lit("s")), F.regexp_replace("w", "s$", ""))).alias("text"))
    own = own.groupBy("object").agg(F.collect_set("text").alias("own"))  # the stated set of objects
    own = own.agg(F.map_from_entries(F.collect_list(F.struct("object", "own"))).alias("owned"), F.coalesce(F.max(F.size("own")), F.lit(0)).alias("most")).checkpoint()
    texts = pieces.select("id", F.lower(F.trim("piece")).alias("text"))
    texts = texts.where(F.col("text").rlike(r"^\p{L}+$") & (F.length("text") >= LETTERS) & ~F.col("text").isin(STOP + COLOURS))
    named = _listed(steps, LISTED).join(texts, "id").select("rec", "pos", "id", "text", F.exp("lp").alias("p"))
    asked = spans.select(*at).distinct().withColumn("pos", F.explode(F.sequence("t0", "t1")))
    told = asked.join(named, ["rec", "pos"])
    told = told.groupBy(*at, "text", "id").agg(F.sum("p").alias("mass"), F.sum(F.when(F.col("pos") == F.col("t1"), F.col("p"))).alias("tail"))
    told = told.groupBy(*at, "text").agg(F.round(F.max("mass"), 9).alias("mass"), F.round(F.max("tail"), 9).alias("tail"))
    w = Window.partitionBy(*at)
    told = told.withColumn("k", F.row_number().over(w.orderBy(F.desc("mass"), "text"))).withColumn("e", F.row_number().over(w.orderBy(F.desc_nulls_last("tail"), "text")))
    told = told.join(F.broadcast(own.select("most")), F.lit(True))
    first = lambda k, ok: F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct(k, "text")))), lambda e: e["text"])
    far = PLACE + F.col("most")
    told = told.groupBy(*at).agg(first("k", F.col("k") <= far).alias("place"), first("e", (F.col("e") <= far) & F.col("tail").isNotNull()).alias("end_place"))
    rest = [c for c in spans.columns if c not in at]
    there = spans.groupBy(*at).agg(F.collect_list(F.struct(*rest)).alias("of")).join(told, at, "left").join(F.broadcast(own.select("owned")), F.lit(True))
    each = there.select(*at, "place", "end_place", "owned", F.explode("of").alias("of"))
    none = F.array().cast("array<string>")
    mine = F.coalesce(F.try_element_at("owned", F.col("of.object")), none)
    best = lambda c: F.coalesce(F.slice(F.array_except(c, mine), 1, PLACE), none).alias(c)
    return each.select(*at, *(F.col(f"of.{c}").alias(c) for c in rest), best("place"), best("end_place"))


def likeness(steps: DataFrame, examples: DataFrame, top: int = 10) -> DataFrame:
    """object, example, rec, t0, t1, score: for each example (object, example, rec, pos: a step) the `top` other steps that
    share most with it: the sum over its words of its probability times what the other step exceeds its floor by."""
    long = _listed(steps)
    asked = examples.join(long.drop("floor"), ["rec", "pos"]).select("object", "example", F.col("rec").alias("_r"), F.col("pos").alias("_p"), "id", F.exp("lp").alias("p"))
    met = long.join(asked, "id").where("rec <> _r or pos <> _p")
    s = met.groupBy("object", "example", "rec", "pos").agg(F.round(F.sum(F.col("p") * (F.col("lp") - F.col("floor"))), 9).alias("score"))
    w = Window.partitionBy("object", "example").orderBy(F.desc("score"), "rec", "pos")
    return s.withColumn("k", F.row_number().over(w)).where(F.col("k") <= top).select("object", "example", "rec", F.col("pos").alias("t0"), F.col("pos").alias("t1"), "score")


def sightings(steps: DataFrame, words: DataFrame, pieces: DataFrame, matches: DataFrame | None = None, answerable: DataFrame | None = None, placed: bool = True) -> DataFrame:
    """object, rec, t0, t1, by, score, place, end_place: where objects are, by name and by example.

    By name: runs of neighbouring steps of a recording over the object's cut. By example: the matches (object, example,
    rec, t0, t1, score) over the cut of their example's scores, if the name is present in one of their steps too, or the
    object has no words at all. A span found both ways counts by name. answerable: rec; others are not reported, but count
    for means and cuts. place is named by all steps of the span, end_place by the last one; both are null if places are not asked for
    (placed), which spares meeting spans with their words. Needs a checkpoint folder; steps
    that are costly should come from a checkpoint, as they are read several times.
    """
    seen = present(name_scores(steps, words)).checkpoint()
    here = seen if answerable is None else seen.join(answerable.select("rec").distinct(), "rec", "left_semi")
    found = islands.runs(here, ["object", "rec"], "pos", 1).groupBy("object", "rec", "island").agg(F.min("pos").alias("t0"), F.max("pos").alias("t1"), F.max("score").alias("score"))
    found = found.select("object", "rec", "t0", "t1", F.lit("name").alias("by"), "score")
    if matches is not None:
        like = matches if answerable is None else matches.join(answerable.select("rec").distinct(), "rec", "left_semi")
        like = like.checkpoint()
        good = like.join(F.broadcast(cuts.split_per(like, ["object", "example"], "score", few=True)), ["object", "example"]).where("score > cut")
        named = words.select("object").distinct()
        at = here.select("object", "rec", F.col("pos").alias("_a"), F.col("pos").alias("_z"))
        sure = range_join(good.join(named, "object", "left_semi"), at, ["object", "rec"], ("t0", "t1"), ("_a", "_z"), 64)
        spans = sure.select("object", "rec", "t0", "t1", "score").unionByName(good.join(named, "object", "left_anti").select("object", "rec", "t0", "t1", "score"))
        spans = spans.groupBy("object", "rec", "t0", "t1").agg(F.max("score").alias("score"))
        spans = spans.join(found, ["object", "rec", "t0", "t1"], "left_anti")
        found = found.unionByName(spans.select("object", "rec", "t0", "t1", F.lit("example").alias("by"), "score"))
    found = found.checkpoint()
    if not placed:
        none = F.lit(None).cast("array<string>")
        return found.select("object", "rec", "t0", "t1", "by", "score", none.alias("place"), none.alias("end_place"))
    return places(found, steps, words, pieces).select("object", "rec", "t0", "t1", "by", "score", "place", "end_place")


def refreshed(kept: DataFrame, found: DataFrame) -> DataFrame:
    """The sightings kept so far (object, rec, t0, t1, kind, by, score, place, end_place, apart, confirmed, rejected) after
    another look. What is found again is scored anew and stands apart, but keeps what its owner decided; what was found
    before and isn't now stands apart no more; examples stay as they are. Rows are known by object, rec, t0 and t1."""
    key = ["object", "rec", "t0", "t1"]
    new = found.select(*key, F.lit("found").alias("kind"), "by", "score", "place", "end_place", F.lit(True).alias("now"))
    both = kept.alias("k").join(new.alias("f"), key, "full_outer")
    now = F.coalesce("f.now", F.lit(False))
    renew = lambda c: F.when(now, F.col(f"f.{c}")).otherwise(F.col(f"k.{c}")).alias(c)
    apart = F.when(now, True).when(F.col("k.kind") == "found", False).otherwise(F.col("k.apart"))
    no = F.lit(False)
    return both.select(*key, F.coalesce("k.kind", "f.kind").alias("kind"), *map(renew, ("by", "score", "place", "end_place")), apart.alias("apart"), F.coalesce("k.confirmed", no).alias("confirmed"), F.coalesce("k.rejected", no).alias("rejected"))


def believed(sightings: DataFrame) -> DataFrame:
    """object, rec, t0, t1, score: what counts for a trail. Rejected sightings don't, nor do unconfirmed ones that meet a
    rejected one of their object, or stand apart no more."""
    bad = sightings.where("rejected").select("object", "rec", F.col("t0").alias("_a"), F.col("t1").alias("_z"))
    cols = ["object", "rec", "t0", "t1", "score"]
    free = range_join(sightings.where("apart and not confirmed and not rejected").select(*cols), bad, ["object", "rec"], ("t0", "t1"), ("_a", "_z"), 64, "left_anti")
    shown = free.unionByName(sightings.where("confirmed and not rejected").select(*cols))
    merged = islands.merge_spans(shown, ["object", "rec"], "t0", "t1")
    return merged.groupBy("object", "rec", "island").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.max("score").alias("score")).drop("island")
