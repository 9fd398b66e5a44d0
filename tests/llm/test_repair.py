"""Repairs equal a search over whole audit strings; damage and faults equal a plain reading of the rows."""

import hashlib
import random
import re
import zlib

import pytest

from stratalake.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def inserted(best, runs=4):
    """Every state after up to `runs` insertions: (cost, audit, lines, state)."""
    for state, (cost, audit, lines) in best.items():
        for _ in range(runs):
            yield cost, audit, lines, state
            state = "a" if state == "u" else "u"
            cost, audit, lines = cost + 3, audit + "I", (*lines, ("user:" if state == "u" else "assistant:"))


def cheapest(turns):
    """turns: (role, text, fault); the least (cost, audit, lines) with whole strings kept at every state."""
    best = {"": (0, "", ())}
    for role, text, fault in turns:
        found = {}
        for cost, audit, lines, state in inserted(best):
            other = "a" if state == "u" else "u"
            ways = [(state, cost + 4, "D", ())]
            if fault not in ("blank", "duplicate"):
                cost += 3 * (fault == "truncated")
                ways.append((other, cost + 3, "R", (("user:" if other == "u" else "assistant:") + text,)))
                if role[:1] == other or (role[:1] == "s" and state == ""):
                    ways.append((role[:1], cost, "K", (f"{role}:{text}",)))
            for to, total, edit, more in ways:
                found[to] = min(found.get(to, (1 << 30, "", ())), (total, audit + edit, (*lines, *more)))
        best = found
    return min((c, a, lines) for c, a, lines, s in inserted(best) if s in ("", "a"))


def plain(rows):
    conversations = {}
    for conv, turn, role, text in rows:
        held = conversations.setdefault(conv, [])
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            held += [(turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    out = []
    for conv, held in conversations.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns, seen = [], set()
        for _, role, text in held:
            body = re.findall(r"[^\x20\x09-\x0D]", text)
            turns.append((role, text, "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""))
            seen.add((role, text))
        numbers = [t for t, _, _ in held if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, lines = cheapest(turns)
        out.append((conv, gaps, *(sum(f == k for _, _, f in turns) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def made(n, conversations, turns, seed):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "u", "sys"], ["Hi.", "Hello there", "", "  ", "Ok!", "What?", "no end", None, "x. \t", "É."]
    return [(rng.choice(conversations), rng.choice(turns), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def repaired(df, block):
    got = repair.summary(repair.repair(repair.damaged(df), block), df)
    return sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=repr)


@pytest.mark.parametrize(("n", "convs", "turns", "block"), [(160, [1, 2, 3, None, 4, 5, 6, 7], [*range(8), None], 3), (160, list(range(60)), list(range(9)), 4096), (500, [1, 2, None], [*range(300), None], 16)])
def test_equals_whole_strings(spark, n, convs, turns, block):
    rows = made(n, convs, turns, n + block)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as block", "2 as place", "3 as none", "4 as kind")
    assert repaired(df, block) == plain(rows)


def test_one_long_conversation_of_equal_rows(spark):
    rows = [(5, k % 7, "user", "Hi.") for k in range(700)] + [(5, None, "assistant", None)] * 20 + [(6, 0, "user", "a " * 400_000 + "b.")]
    assert repaired(spark.createDataFrame(rows, SCHEMA), 64) == plain(rows)


def test_empty_table(spark):
    assert repaired(spark.createDataFrame([], SCHEMA), 8) == []


def test_blocks_hold_the_repaired_turns(spark):
    rows = made(120, [1, 2], list(range(60)), 4)
    blocks = sorted(repair.repair(spark.createDataFrame(rows, SCHEMA), 10).collect(), key=lambda r: (r.conv_id, r.place))
    for conv in (1, 2):
        lines = [x for r in blocks if r.conv_id == conv and r.lines for x in r.repaired.split("\n")]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines)) and len(lines) == sum(r.lines for r in blocks if r.conv_id == conv)


def test_codes_are_prefix_free_and_in_order():
    codes = repair.CODES
    assert codes == sorted(codes) and not any(a != b and b.startswith(a) for a in codes for b in codes)
