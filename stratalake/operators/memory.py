"""A shared memory over a store: people and sources, steps of recordings, questions by example as a work queue, tracked
names, sightings, notes, and a small grammar for questions.

Tables live in a versioned store; an update is a keyed upsert in one commit, and two workers that claim at once conflict
in the log, so one of them tries again. What is derived (trails, beliefs) is never stored.
"""

from __future__ import annotations

import re
import time
import uuid

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from stratalake.functions.scalar import plain_name
from stratalake.operators import cuts, islands, sequence
from stratalake.operators.intervals import range_join
from stratalake.operators.text import recall
from stratalake.sources.store import CommitConflict, Store

DIRECTIONS, SCOPES, KINDS = ("forward", "reverse"), ("all", "others", "after"), ("glasses", "phone", "webcam", "file")
#: Seconds after which a sighting is believed rather than seen, and a claim is taken back.
FADE, STALE = 1800, 600

SCHEMAS = {
    "people": "ts long, id string, name string",
    "sources": "ts long, id string, person string, kind string, label string",
    "footage": "ts long, rec long, source string, person string, started long",
    "steps": "ts long, id string, rec long, pos long, floor double, ids array<int>, lps array<double>",
    "queries": "ts long, id string, rec long, x0 long, x1 long, direction string, scope string, top int, status string, worker string, started long",
    "answers": "ts long, query string, rank long, rec long, begin long, end long, score double, apart boolean",
    "sightings": "ts long, id string, owner string, name string, rec long, t0 long, t1 long, by string, score double, confirmed boolean, rejected boolean",
    "notes": "ts long, id string, person string, subject string, note string",
    "messages": "ts long, id string, session string, n long, role string, text string",
}


def _columns(table: str) -> list[str]:
    return [c.split()[0] for c in SCHEMAS[table].split(", ")]


class Memory:
    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark

    def rows(self, name: str) -> DataFrame:
        t = self.store.table(name)
        return t.read() if t.schema() is not None else self.spark.createDataFrame([], SCHEMAS[name])

    def _put(self, table: str, keys: list[str], on: int | None = None, /, **row) -> None:
        row.setdefault("ts", time.time_ns())
        df = self.spark.createDataFrame([tuple(row.get(c) for c in _columns(table))], SCHEMAS[table])
        self.store.upsert(table, df, keys, ("ts",), on)

    # people, sources, steps

    def add_person(self, id: str, name: str) -> None:
        """Once; again with the same name changes nothing, with another is an error."""
        known = self.rows("people").where(F.col("id") == id).first()
        if known and known["name"] != name:
            raise ValueError(f"{id} is {known['name']}")
        if not known:
            self._put("people", ["id"], id=id, name=name)

    def add_source(self, id: str, person: str, kind: str, label: str) -> None:
        if kind not in KINDS:
            raise ValueError(f"kind is one of {KINDS}")
        if not self.rows("people").where(F.col("id") == person).first():
            raise ValueError(f"nobody is {person}")
        known = self.rows("sources").where(F.col("id") == id).first()
        if known and (known["person"], known["kind"]) != (person, kind):
            raise ValueError(f"{id} is another source")
        if not known:
            self._put("sources", ["id"], id=id, person=person, kind=kind, label=label)

    def add_footage(self, rec: int, source: str, started: int) -> None:
        s = self.rows("sources").where(F.col("id") == source).first()
        if s is None:
            raise ValueError(f"no source {source}")
        self._put("footage", ["rec"], rec=rec, source=source, person=s["person"], started=started)

    def write_steps(self, steps: DataFrame) -> int:
        """Idempotent: steps are known by recording and position; how many were new."""
        keyed = steps.select(F.lit(time.time_ns()).alias("ts"), F.concat_ws(":", "rec", "pos").alias("id"), "rec", "pos", "floor", "ids", "lps")
        return self.store.write_new("steps", keyed, "id")

    # questions

    def enqueue(self, rec: int, x0: int, x1: int, direction: str = "forward", scope: str = "all", top: int = 20) -> str:
        if direction not in DIRECTIONS or scope not in SCOPES or not 0 < top <= 1000 or not 0 <= x0 <= x1:
            raise ValueError("direction, scope, top or span")
        id = uuid.uuid4().hex
        self._put("queries", ["id"], id=id, rec=rec, x0=x0, x1=x1, direction=direction, scope=scope, top=top, status="queued")
        return id

    def _mark(self, row, on: int | None = None, /, **new) -> None:
        self._put("queries", ["id"], on, **(row.asDict() | new))

    def claim(self, worker: str) -> str | None:
        """The oldest queued question, now this worker's; None if there is none."""
        t = self.store.table("queries")
        while t.schema() is not None:
            version = t.state()["version"]
            q = t.read(version).where("status = 'queued'").orderBy("ts", "id").first()
            if q is None:
                return None
            try:  # holds for the version in which the question was seen queued, and no other
                self._mark(q, version, status="running", worker=worker, started=int(time.time()))
                return q["id"]
            except CommitConflict:
                continue
        return None

    def requeue_stale(self, now: int | None = None) -> int:
        stale = self.rows("queries").where((F.col("status") == "running") & (F.col("started") < (now or int(time.time())) - STALE)).collect()
        for q in stale:
            self._mark(q, status="queued", worker=None)
        return len(stale)

    def search(self, q) -> DataFrame:
        """Spans like the question's, its own and, by scope, others left out."""
        steps, footage = self.rows("steps"), self.rows("footage")
        own = footage.where(F.col("rec") == q["rec"]).first()
        anchor = steps.where((F.col("rec") == q["rec"]) & F.col("pos").between(q["x0"], q["x1"]))
        if q["direction"] == "reverse":
            anchor = anchor.withColumn("pos", F.lit(q["x0"] + q["x1"]) - F.col("pos"))
        if q["scope"] == "others":
            steps_in = steps.join(footage.where(F.col("person") != own["person"]).select("rec"), "rec", "left_semi")
        else:
            steps_in = steps
        example = self.spark.createDataFrame([(q["rec"], q["x0"], q["x1"])], "_r long, x0 long, x1 long")
        scores = sequence.similarity(steps, anchor, sequence.vocabulary(steps, 24)).join(steps_in.select("rec").distinct(), "rec", "left_semi")
        found = sequence.subsequences(scores).join(F.broadcast(example), (F.col("rec") == F.col("_r")) & (F.col("begin") <= F.col("x1")) & (F.col("x0") <= F.col("end")), "left_anti")
        if q["scope"] != "after":
            return sequence.suppress(found, ["rec"], "begin", "end", "score", q["top"])
        # those after the question are chosen from all that are kept, however many come before it
        best = sequence.suppress(found, ["rec"], "begin", "end", "score", None).join(footage.select("rec", "started"), "rec")
        best = best.where(F.col("started") + F.col("begin") >= own["started"] + q["x1"]).drop("started").orderBy(F.desc("score"), "rec", "begin").limit(q["top"])
        return best

    def answer(self, id: str) -> DataFrame:
        """Runs a question, replaces its earlier answers, and marks those over the cut that the scores show."""
        q = self.rows("queries").where(F.col("id") == id).first()
        if q is None:
            raise KeyError(id)
        found = self.search(q)
        rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "rec", "begin")).cast("long")  # `top` rows
        cut = cuts.split(found, "score")
        out = found.join(F.broadcast(cut), F.lit(True)).select(F.lit(time.time_ns()).alias("ts"), F.lit(id).alias("query"), rank.alias("rank"), "rec", "begin", "end", "score", F.coalesce(F.col("score") > F.col("cut"), F.lit(False)).alias("apart"))
        t = self.store.table("answers")
        while True:
            version = t.state()["version"]
            try:
                if t.schema() is None:
                    t.commit("append", t._write(out), schema=out.schema, kind="timeseries", on=version)
                else:
                    kept = t.read(version).where(F.col("query") != id)
                    t.replace(kept.unionByName(out), version) if not (kept.isEmpty() and out.isEmpty()) else None
                break
            except CommitConflict:  # another question was answered meanwhile: its rows stay
                continue
        self._mark(q, status="done")
        return self.events(id)

    def events(self, id: str) -> DataFrame:
        return self.rows("answers").where(F.col("query") == id).orderBy("rank")

    def serve(self, worker: str) -> int:
        """Answers until the queue is empty; a question that fails is marked and the next one is taken."""
        n = 0
        while (id := self.claim(worker)) is not None:
            try:
                self.answer(id)
                n += 1
            except Exception as e:  # the question, not the worker, is at fault
                self._mark(self.rows("queries").where(F.col("id") == id).first(), status=f"failed: {str(e)[:80]}")
        return n

    # tracked names

    def track(self, owner: str, name: str, words: list[int]) -> int:
        """Sightings of a name: runs of steps where it scores over the cut the scores show; rows confirmed or rejected
        before keep that. How many runs there are."""
        steps = self.rows("steps")
        hit = F.array_max(F.transform(F.filter(F.arrays_zip("ids", "lps"), lambda e: e["ids"].isin(words)), lambda e: e["lps"]))
        scored = steps.select("rec", "pos", F.coalesce(hit, F.col("floor")).alias("score"))
        present = scored.join(F.broadcast(cuts.split(scored, "score")), F.col("score") > F.col("cut"))
        runs = islands.runs(present, ["rec"], "pos", 1).groupBy("rec", "island").agg(F.min("pos").alias("t0"), F.max("pos").alias("t1"), F.max("score").alias("score"))
        new = runs.select(F.lit(time.time_ns()).alias("ts"), F.concat_ws(":", F.lit(owner), F.lit(name), "rec", "t0", "t1").alias("id"), F.lit(owner).alias("owner"), F.lit(name).alias("name"), "rec", "t0", "t1", F.lit("name").alias("by"), "score", F.lit(False).alias("confirmed"), F.lit(False).alias("rejected"))
        n = new.count()
        if n:
            self.store.upsert("sightings", new, ["id"], ("ts", "confirmed", "rejected"))
        return n

    def _decide(self, owner: str, id: str, **marks) -> None:
        row = self.rows("sightings").where((F.col("id") == id) & (F.col("owner") == owner)).first()  # another's is none
        if row is None:
            raise KeyError(id)
        self._put("sightings", ["id"], **(row.asDict() | marks))

    def confirm(self, owner: str, id: str) -> None:
        self._decide(owner, id, confirmed=True, rejected=False)

    def reject(self, owner: str, id: str) -> None:
        self._decide(owner, id, rejected=True, confirmed=False)

    def trail(self, owner: str, name: str) -> DataFrame:
        """rec, t0, t1, score, by world time: sightings merged where they overlap; unconfirmed ones that meet a rejected
        span are hidden."""
        mine = self.rows("sightings").where((F.col("owner") == owner) & (F.col("name") == name))
        bad = mine.where("rejected").select("rec", F.col("t0").alias("r0"), F.col("t1").alias("r1"))
        open_ = range_join(mine.where("not rejected and not confirmed").select("rec", "t0", "t1", "score"), bad, ["rec"], ("t0", "t1"), ("r0", "r1"), 64, "left_anti")
        shown = open_.unionByName(mine.where("confirmed").select("rec", "t0", "t1", "score"))
        merged = islands.merge_spans(shown, ["rec"], "t0", "t1", strict=True).groupBy("rec", "island").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.max("score").alias("score"))
        return merged.drop("island").join(self.rows("footage").select("rec", "person", "started"), "rec", "left").withColumn("until", F.coalesce("started", F.lit(0)) + F.col("t1"))

    def where_is(self, owner: str, name: str, now: int) -> dict:
        """status (seen, believed, not_seen) of a name and its last known place in a recording."""
        last = self.trail(owner, name).orderBy(F.desc("until"), F.desc("rec")).first()
        if last is None:
            return {"name": name, "status": "not_seen"}
        return {"name": name, "status": "seen" if now - last["until"] <= FADE else "believed", "rec": last["rec"], "until": last["until"], "age": now - last["until"]}

    # reads in world time

    def clock(self) -> DataFrame:
        """rec, person, started, ended of every recording; ended is its start plus its steps."""
        size = self.rows("steps").groupBy("rec").agg((F.max("pos") + 1).alias("size"))
        return self.rows("footage").join(size, "rec", "left").select("rec", "source", "person", "started", (F.col("started") + F.coalesce("size", F.lit(0))).alias("ended"))

    def example(self, source: str, a: int, b: int) -> tuple[int, int, int]:
        """The source's recording that holds the world times a to b, and the positions: the last one begun by a."""
        if b <= a:
            raise ValueError("an observation ends after it starts")
        r = self.clock().where((F.col("source") == source) & (F.col("started") <= a)).orderBy(F.desc("started"), F.desc("rec")).first()
        if r is None or a >= r["ended"]:
            raise ValueError(f"no recording of {source} holds {a} to {b}")
        return r["rec"], a - r["started"], min(b, r["ended"]) - r["started"] - 1

    def last_seen(self, source: str, a: int, b: int, direction: str = "reverse") -> dict | None:
        """What happened after an observation, backwards by default: the best span after it, and from its begin to the
        end of its recording; None if nothing is found."""
        id = self.enqueue(*self.example(source, a, b), direction=direction, scope="after", top=5)
        moved = self.answer(id).first()
        if moved is None:
            return None
        r = self.clock().where(F.col("rec") == moved["rec"]).first()
        return {"query": id, "rec": moved["rec"], "begin": moved["begin"], "end": moved["end"], "score": moved["score"], "until": r["ended"]}

    def timeline(self, since: int | None = None, until: int | None = None, apart_only: bool = False, limit: int = 100) -> DataFrame:
        """Moments that questions found, newest first: each span once, with its best score and how many found it."""
        found = self.rows("answers").where("apart") if apart_only else self.rows("answers")
        once = found.groupBy("rec", "begin", "end").agg(F.max("score").alias("score"), F.count_distinct("query").alias("found_by"))
        at = once.join(self.clock(), "rec").withColumn("t0", F.col("started") + F.col("begin"))
        at = at if since is None else at.where(F.col("t0") >= since)
        at = at if until is None else at.where(F.col("t0") <= until)
        return at.select("rec", "person", "t0", (F.col("started") + F.col("end")).alias("t1"), "score", "found_by").orderBy(F.desc("t0"), "rec", "t1").limit(limit)

    def between(self, owner: str, a: int, b: int) -> DataFrame:
        """The owner's sightings and all moments apart that meet the world times a to b, in order."""
        clock = self.clock().select("rec", "started")
        mine = self.rows("sightings").where((F.col("owner") == owner) & ~F.col("rejected")).select(F.lit("sighting").alias("kind"), F.col("name").alias("what"), "rec", "t0", "t1")
        moments = self.rows("answers").where("apart").select(F.lit("moment").alias("kind"), F.col("query").alias("what"), "rec", F.col("begin").alias("t0"), F.col("end").alias("t1"))
        at = mine.unionByName(moments).join(clock, "rec").select("kind", "what", "rec", (F.col("started") + F.col("t0")).alias("t0"), (F.col("started") + F.col("t1")).alias("t1"))
        return at.where((F.col("t1") >= a) & (F.col("t0") <= b)).orderBy("t0", "rec", "kind", "what")

    # conversations

    def say(self, session: str, n: int, role: str, text: str) -> None:
        """The n-th message of a session; said again it is replaced."""
        self._put("messages", ["id"], id=f"{session}:{n}", session=session, n=n, role=role, text=text)

    def messages(self, session: str, skip: int = 0, limit: int = 50) -> DataFrame:
        return self.rows("messages").where(F.col("session") == session).orderBy("n").offset(skip).limit(limit).select("n", "role", "text")

    # notes and questions in words

    def remember(self, person: str, subject: str, note: str) -> None:
        self._put("notes", ["id"], id=uuid.uuid4().hex, person=person, subject=subject, note=note)

    def recall(self, person: str, query: str) -> DataFrame:
        """The person's own notes by score (a subject's words count three times)."""
        return recall(self.rows("notes").where(F.col("person") == person), {"subject": 3.0, "note": 1.0}, query).orderBy(F.desc("score"), F.desc("ts"))

    def context(self) -> DataFrame:
        """Sources with their recordings and when they began."""
        per = self.rows("footage").groupBy("source").agg(F.count(F.lit(1)).alias("recordings"), F.min("started").alias("first"), F.max("started").alias("last"))
        return self.rows("sources").join(per, F.col("id") == F.col("source"), "left").select("id", "person", "label", F.coalesce("recordings", F.lit(0)).alias("recordings"), "first", "last")

    def ask(self, owner: str, question: str, now: int):
        """The answer of the read a question asks for; None if the grammar doesn't know it."""
        names = [r["name"] for r in self.rows("sightings").where(F.col("owner") == owner).select("name").distinct().toLocalIterator()]
        tool, arg = understood(question, names)
        if tool == "where":
            return self.where_is(owner, arg, now)
        if tool == "recall":
            return [r["note"] for r in self.recall(owner, arg).limit(5).collect()]
        return [r.asDict() for r in self.context().collect()] if tool == "context" else None

    def changes(self, table: str) -> DataFrame:
        """A stream of a table's commits: version, op, rows added."""
        entry = "version long, ts_utc double, op string, add array<struct<path: string, rows: long>>"
        log = self.spark.readStream.schema(entry).option("pathGlobFilter", "*.json").json(f"{self.store.root}/{table}/_log")
        return log.select("version", "ts_utc", "op", F.aggregate("add", F.lit(0).cast("long"), lambda a, f: a + f["rows"]).alias("rows"))


def understood(question: str, names: list[str]) -> tuple[str | None, str | None]:
    """(tool, argument): of several names that a question holds the longest counts; a statement asks nothing."""
    q = " ".join(re.sub(r"[^a-z0-9 ]", " ", question.lower()).split())
    if not (question.strip().endswith("?") or re.match(r"(where|when|what|which|who|how|did|is|are|show|find)\b", q)):
        return None, None
    held = [n for n in names if re.search(rf"\b{re.escape(n.lower())}s?\b", q)]
    if held and re.match(r"(where|when|find|did|have you seen|who)\b", q):
        return "where", max(held, key=lambda n: (len(n), n))
    if m := re.match(r"what (?:did i|do i|have i) (?:say|said|note|noted|know|told you) about (.+)", q):
        return "recall", m[1]
    if re.match(r"(what|which|show) (cameras|sources|recordings|footage)", q):
        return "context", None
    return None, None


def same_name(a, b):
    """Whether two name columns mean the same once article, case and plural are gone."""
    return plain_name(a) == plain_name(b)
