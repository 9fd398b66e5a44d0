import numpy as np
import pytest

from stratalake.operators import sequence
from stratalake.operators.memory import Memory, understood
from stratalake.sources.store import Store
from stratalake.streaming.operators import run_to_end


@pytest.fixture(scope="module")
def memory(spark, tmp_path_factory):
    m = Memory(Store.create(spark, f"{tmp_path_factory.mktemp('m')}/s"))
    m.add_person("p", "Pat")
    m.add_person("p", "Pat")
    m.add_person("o", "Oli")
    m.add_source("p1", "p", "phone", "pocket")
    m.add_source("o1", "o", "webcam", "desk")
    for rec, source in ((0, "p1"), (1, "o1"), (2, "p1")):
        m.add_footage(rec, source, 1000 * rec)
    rng = np.random.default_rng(2)
    rows = [(100 * r + i, r, (4 * rng.permutation(40) / 40).tolist()) for r in range(3) for i in range(15)]
    for i in range(3):  # recording 1 repeats steps 4 to 6 of recording 0 at 8, recording 2 backwards at 3
        rows[15 + 8 + i] = (100 + 8 + i, 1, rows[4 + i][2])
        rows[30 + 3 + i] = (200 + 3 + i, 2, rows[6 - i][2])
    steps = sequence.steps_from_vectors(spark.createDataFrame(rows, "vec_id long, label long, v array<double>"), 12)
    assert m.write_steps(steps) == 45 and m.write_steps(steps) == 0
    return m


def test_conflicts_and_validation(memory):
    for wrong in (lambda: memory.add_person("p", "Sam"), lambda: memory.add_source("x", "nobody", "phone", ""), lambda: memory.add_source("x", "p", "toaster", ""), lambda: memory.enqueue(0, 5, 4), lambda: memory.enqueue(0, 1, 2, scope="none")):
        with pytest.raises(ValueError):
            wrong()
    assert {r["id"]: r["recordings"] for r in memory.context().collect()} == {"p1": 2, "o1": 1}


def test_questions_are_queued_claimed_and_answered(spark, memory):
    a = memory.enqueue(0, 4, 6, top=3)
    b = memory.enqueue(0, 4, 6, direction="reverse", top=3)
    c = memory.enqueue(0, 4, 6, scope="others", top=3)
    assert memory.claim("w") == a
    assert memory.requeue_stale(10**10) == 1
    assert memory.serve("w") == 3 and memory.claim("w") is None
    best = {q: memory.events(q).first() for q in (a, b, c)}
    assert (best[a]["rec"], best[a]["begin"], best[a]["end"]) == (1, 8, 10)
    assert (best[b]["rec"], best[b]["begin"], best[b]["end"]) == (2, 3, 5)
    assert {r["rec"] for r in memory.events(c).collect()} == {1}
    assert not any(r["rec"] == 0 and r["begin"] <= 6 and r["end"] >= 4 for r in memory.events(a).collect())
    ops = run_to_end(memory.changes("queries"), "queue_changes").collect()
    assert len(ops) >= 6 and sorted(r["version"] for r in ops)[0] == 1


def test_names_are_private_and_decisions_stay(spark, memory):
    n = memory.track("p", "key", [0, 1, 2, 3])
    if not n:
        pytest.skip("one group")
    first = memory.rows("sightings").orderBy("id").first()
    with pytest.raises(KeyError):
        memory.reject("o", first["id"])
    memory.reject("p", first["id"])
    memory.track("p", "key", [0, 1, 2, 3])
    assert memory.rows("sightings").where("rejected").count() == 1
    assert all(not (r["rec"] == first["rec"] and r["t0"] <= first["t1"] and first["t0"] <= r["t1"]) for r in memory.trail("p", "key").collect())
    assert memory.where_is("o", "key", 5000)["status"] == "not_seen"
    memory.confirm("p", first["id"])
    assert memory.ask("p", "Where are my keys?", 10**6)["status"] == "believed"


def test_notes_are_recalled_by_their_owner_alone(memory):
    memory.remember("p", "passport", "in the blue drawer")
    memory.remember("o", "passport", "with Pat")
    assert memory.ask("p", "What did I say about passports?", 0) == ["in the blue drawer"]


@pytest.mark.parametrize(("question", "want"), [
    ("Where is my house key?", ("where", "house key")), ("where are the keys", ("where", "key")), ("I put my key away.", (None, None)),
    ("What do I know about the car", ("recall", "the car")), ("Which cameras are there?", ("context", None)), ("Why?", (None, None))])
def test_grammar(question, want):
    assert understood(question, ["key", "house key"]) == want


def test_world_time_reads(memory):
    assert memory.example("p1", 4, 7) == (0, 4, 6)
    for wrong in ((7, 4), (500, 600)):
        with pytest.raises(ValueError):
            memory.example("p1", *wrong)
    seen = memory.last_seen("p1", 4, 7)
    assert (seen["rec"], seen["begin"], seen["end"], seen["until"]) == (2, 3, 5, 2015)
    line = memory.timeline(since=1000, limit=50).collect()
    assert line and all(r["t0"] >= 1000 and r["found_by"] >= 1 for r in line)
    assert [r["t0"] for r in line] == sorted((r["t0"] for r in line), reverse=True)
    assert len({(r["rec"], r["t0"], r["t1"]) for r in line}) == len(line)
    assert {r["rec"] for r in memory.between("p", 2000, 2999).collect()} <= {2}


def test_messages_are_paged_and_replaced(memory):
    for n, t in enumerate(("hello", "hi", "where?")):
        memory.say("s1", n, "user", t)
    memory.say("s1", 1, "assistant", "hi there")
    assert [(r["n"], r["text"]) for r in memory.messages("s1", 1, 2).collect()] == [(1, "hi there"), (2, "where?")]


def test_terminal_commands(spark, tmp_path):
    from stratalake.__main__ import run

    at = f"{tmp_path}/s"
    assert run(spark, [at, "create"]) == {"created": at}
    run(spark, [at, "person", "p", "Pat"])
    run(spark, [at, "source", "c", "p", "webcam", "desk"])
    run(spark, [at, "add-footage", "0", "c", "100"])
    run(spark, [at, "remember", "p", "keys", "they hang by the door"])
    assert run(spark, [at, "recall", "p", "keys"]).first()["note"] == "they hang by the door"
    assert run(spark, [at, "footage"]).first()["recordings"] == 1
    assert run(spark, [at, "where", "p", "keys"])["status"] == "not_seen"
    assert run(spark, [at, "sql", "SELECT count(*) AS n FROM people"]).first()["n"] == 1
    assert run(spark, [at, "history", "people"]).count() == 1 and run(spark, [at, "check"]).count() == 4
    with pytest.raises(SystemExit):
        run(spark, [at, "source", "x", "p", "toaster", "y"])


def test_one_owner_for_each_question(spark, tmp_path):
    """Two workers see the same question queued; the second one's claim is a conflict, so it takes the next."""
    store = Store.create(spark, str(tmp_path / "claims"))
    m, other = Memory(store), Memory(Store.open(spark, str(tmp_path / "claims")))
    ids = {m.enqueue(0, 0, 1), m.enqueue(0, 2, 3)}
    taken, mark = [], m._mark

    def late(row, on=None, /, **new):
        if not taken:
            taken.append(other.claim("second"))
        mark(row, on, **new)

    m._mark = late
    assert {m.claim("first"), *taken} == ids
    assert m.claim("first") is None and m.rows("queries").where("status = 'running'").count() == 2
