"""Personal data: generators with high recall propose spans, boosted trees select which of them are redacted.

Base kinds are found by fixed patterns and always kept. Further candidates (phones without country code, identity
numbers, account numbers, addresses written out) overlap freely, also with base spans; each gets format and context
features, a boosted-tree score, and is kept if the score reaches its generator's cut, calibrated to a precision on
held-out examples. The trees learn from examples made by a seeded generator, since no table labels such spans.

Patterns that a long run of fitting characters would make quadratic are anchored at their rare sign ("@", the dots of an
address, "at") and extended from there, with the same matches, so that texts of any length are scanned in linear time.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from stratalake.llm.boosting import Boosted, calibrated_cut
from stratalake.llm.common import ready, rows, texts

BASE = ("email", "ip", "card", "phone")
#: What stands before the "@" of an address, and what follows it; numbers joined by dots, of which four make an address.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Generators of further candidates; kinds in the order they are listed in after the base kinds.
GENERATORS = {
    "local_phone": re.compile(r"(?<![\w+])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?!\w)", re.A),
    "id_number": re.compile(r"(?<![\w.-])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![\w-])", re.A),
    "account": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w)", re.A),
    "written_email": None,
}
#: An address written out, from the sign for "@" on; what stands before it is one of WRITTEN, and a space perhaps.
WRITTEN_AT = re.compile(r"(?:\(at\)|\[at\]|\x20at\x20)", re.A | re.I)
WRITTEN_REST = re.compile(r"\x20?[a-z0-9-]+\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[a-z]+(?!\w)", re.A | re.I)
WRITTEN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._-"
#: The fewest digits a text needs for each generator to be tried.
LEAST_DIGITS = {"local_phone": 8, "id_number": 9, "account": 2}
KINDS = (*BASE, *GENERATORS)
#: Context words that speak for and against personal data.
FOR = re.compile(r"\b(?:call|phone|tel|mobile|fax|contact|number|text|cell|ssn|social|tax|identity|account|iban|bank|mail|write|reach|send)\b", re.I)
AGAINST = re.compile(r"\b(?:order|version|release|page|isbn|item|part|build|date|price|total|score|serial|ticket)\b", re.I)
#: Usual last parts of addresses.
ENDINGS = frozenset("com org net edu gov io info de fr es it nl uk ch at eu us ca jp".split())
PRECISION, CONTEXT = 0.98, 40
_TEN = b"0123456789"
_DIGITS = bytes(48 if 48 <= c <= 57 else 32 for c in range(256))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping [local part]@[domain]: an "@" ends the run before it, so a match starts at that run's
    start, or at the end of the match before."""
    done, at = 0, text.find("@")
    while at >= 0:
        part = text[done:at]
        start = done + len(part.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        done = m.end() if m else at + 1
        if m:
            yield start, done
        at = text.find("@", done)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping four numbers joined by dots, each at most 255: the numbers of a run by fours."""
    for run in DOTTED.finditer(text):
        if run[0].count(".") > 2:
            parts, start = run[0].split("."), run.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                end = start + sum(map(len, four)) + 3
                if all(int(p[-4:]) <= 255 and not p[:-3].strip("0") for p in four):
                    yield start, end
                start = end + 1


def written_emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses written out, from the sign for "@" leftwards to the start of its run and on to the end."""
    done, at = 0, WRITTEN_AT.search(text)
    while at:
        part = text[done : at.start()]
        part = part[: len(part) - part.endswith(" ")]
        start = done + len(part.rstrip(WRITTEN))
        m = WRITTEN_REST.match(text, at.end()) if start < done + len(part) else None
        before = text[start - 1 : start]
        if m and not (before.isascii() and (before.isalnum() or before == "_")):
            yield start, m.end()
            done = m.end()
        else:
            done = at.start() + 1  # the sign's letters may be the run before the next one
        at = WRITTEN_AT.search(text, done)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start and then kind as listed."""
    out = []
    if "@" in text:
        out += [(*s, "email") for s in emails(text)]
    digits = text.encode("utf-8", "replace").translate(_DIGITS)
    if digits.strip():
        if text.count(".") > 2:
            out += [(*s, "ip") for s in addresses(text)]
        for m in CARD.finditer(text):
            if m.end() - m.start() > 11:
                d = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append((*m.span(), "card"))
        if "+" in text:
            out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format of the span and its surroundings."""
    span, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    digits = [c for c in span if "0" <= c <= "9"]
    groups, letters = re.findall(r"[0-9]+", span), re.findall(r"[A-Za-z]+", span)
    return [
        float(list(GENERATORS).index(kind)), len(span), len(digits), len(set(digits)), len(groups), max(map(len, groups), default=0),
        min(map(len, groups), default=0), sum(c.isalpha() for c in span), span.count("-"), span.count(" "), span.count("."), span.count("("),
        float(bool(FOR.search(before))), float(bool(AGAINST.search(before))), float(bool(FOR.search(after))), float(before[-1:].isspace() or not before),
        float(bool(re.search(r"[$€£#]\s?$", before))), float(bool(re.search(r"[:=]\s?$", before))), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0,
        len(letters[-1]) if letters else 0, float(bool(letters) and letters[-1].lower() in ENDINGS), span.count("[") + span.count("_"), sum("0" <= c <= "9" for c in before + after), float(iban_valid(span)),
    ]


def iban_valid(span: str) -> bool:
    s = span.replace(" ", "")
    return len(s) > 14 and s.isalnum() and s.isascii() and s[:2].isupper() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Overlapping proposals of every generator."""
    out = []
    raw = text.encode("utf-8", "replace")
    digits = len(raw) - len(raw.translate(None, _TEN))
    for kind, pattern in GENERATORS.items():
        if pattern is not None and digits >= LEAST_DIGITS[kind]:
            out += [(*m.span(), kind) for m in pattern.finditer(text)]
    low = raw.lower()
    if b"dot" in low and b"at" in low:
        out += [(*s, "written_email") for s in written_emails(text)]
    return out


def examples(seed: int, count: int) -> tuple[list, np.ndarray]:
    """Made-up sentences with one marked span each, and whether it is personal data.

    Cues of both kinds stand right before the span or some words away, or are missing; half of those for a kind of data
    are no feature of their own, so that the trees can't lean on the list of context words alone.
    """
    rng = random.Random(seed)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdehilmnoprstu") for _ in range(rng.randint(2, 9)))
    cues = {
        "phone": ("call", "phone", "tel", "Tel.", "contact", "reach me", "my number is", "mobile", "fax", "text me on", "ring", "cell"),
        "id": ("ssn", "SSN", "social security number", "social", "tax id", "identity no.", "taxpayer"),
        "iban": ("account", "iban", "IBAN", "bank", "pay to", "transfer to", "wire", "konto"),
        "mail": ("mail", "write to", "contact", "e-mail", "send it to", "reach me at", "author", "ask"),
    }
    others = ("order", "version", "page", "item", "serial", "total", "part", "ticket", "isbn", "build", "released", "invoice", "ref", "lines", "years", "model", "table", "code")

    def iban(good: bool) -> str:
        letters = rng.choice("DE GB FR NL ES IT AT CH BE PL".split())
        body = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(rng.choice((0, 0, 4)))) + d(rng.randint(12, 20))
        for check in range(2, 99):
            s = f"{letters}{check:02d}{body}"
            if iban_valid(s) == good:
                return rng.choice([s, " ".join(s[i : i + 4] for i in range(0, len(s), 4))])
        return f"{letters}00{body}"

    made, truth = [], []
    while len(made) < count:
        sep, good = rng.choice(" .-"), rng.random() < 0.5
        kind = rng.choice(["phone", "id", "iban", "mail"])
        clear = not good and rng.random() < 0.3  # the format of personal data, and a cue against it
        if kind == "phone":
            span = rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}{sep}{d(3)}{sep}{d(4)}", f"{d(3)}{sep}{d(4)}{sep}{d(4)}"])
            if not good and not clear:
                span = rng.choice([f"{d(4)}-{d(3)}-{d(3)}", f"{d(2)} {d(4)} {d(4)}", f"{d(3)}.{d(3)}.{d(3)}", f"{d(3)} {d(3)} {d(3)}", f"{d(2)} {d(3)} {d(3)}"])
        elif kind == "id":
            span = f"{d(3)}-{d(2)}-{d(4)}" if good or clear else f"{d(3)} {d(2)} {d(4)}"
        elif kind == "iban":
            span = iban(good)
        else:
            at, dot = rng.choice([(" at ", " dot "), (" (at) ", " (dot) "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", " dot ")])
            name = rng.choice([word(), f"{word()}{rng.choice('._-')}{word()}", f"{word()[0]}{rng.choice('._-')}{word()}"])
            span = f"{name}{at}{word()}{dot}{rng.choice(sorted(ENDINGS) + ['com', 'org', 'net'] * 6)}"
            if not good:
                span = f"{word()} at {word()} dot {word()}"
        cue = rng.choice(cues[kind] if good and rng.random() < 0.85 or not good and not clear and rng.random() < 0.15 else others if not good else (word(), word()))
        between = rng.choice((" ", " ", " ", f" {word()} ", " is ", " = ", ": ", ": ", "="))
        near = lambda: d(rng.randint(1, 8)) if rng.random() < 0.15 else word()
        head = f"{rng.choice(('', near() + ' ', f'{rng.choice(others)} {near()}, '))}{cue}{between}"
        text = f"{head}{span}{rng.choice((' ', ', ', '. ', '; '))}{near()} {near()}"
        for s in candidates(text):  # a part of the data isn't the data
            made.append((text, *s))
            truth.append(float(good and s[0] <= len(head) and len(head) + len(span) <= s[1]))
    return made, np.array(truth)


@lru_cache(maxsize=1)
def model() -> tuple[Boosted, dict[str, float]]:
    """Trees, and the cut of each generator for PRECISION on held-out examples."""
    made, y = examples(1, 5000)
    trees = Boosted().fit(np.array([features(*m) for m in made]), y)
    made, y = examples(2, 5000)
    p = trees.probability(np.array([features(*m) for m in made]))
    kinds = np.array([m[3] for m in made])
    return trees, {k: max(0.5, calibrated_cut(p[kinds == k], y[kinds == k], PRECISION)) for k in GENERATORS}


def selected(text: str, base: list, trees: Boosted, cuts: dict[str, float]) -> list[tuple[int, int, str]]:
    """Candidates over the cut that no base span covers whole; of overlapping ones the longest, the best, the first."""
    found = uncovered(candidates(text), base)
    if not found:
        return []
    p = trees.probability(np.array([features(text, *c) for c in found]))
    starts: list[int] = []
    out: list = []
    for q, c in sorted(zip(p.tolist(), found), key=lambda r: (r[1][0] - r[1][1], -r[0], r[1])):
        if q >= cuts[c[2]]:
            k = bisect_left(starts, c[0])  # kept spans are apart, so neighbours decide
            if (not k or out[k - 1][1] <= c[0]) and (k == len(out) or c[1] <= out[k][0]):
                starts.insert(k, c[0])
                out.insert(k, c)
    return out


def uncovered(found: list[tuple[int, int, str]], base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Those found that lie in no base span."""
    out, k, reach = [], 0, 0
    for c in sorted(found):
        while k < len(base) and base[k][0] <= c[0]:  # the farthest end of the base spans begun by then
            reach = max(reach, base[k][1])
            k += 1
        if c[1] > reach:
            out.append(c)
    return out


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, text, base and spans (arrays of struct<start, end, kind>, in code points).

    Null text counts as empty and has no spans; texts of any length are scanned whole, in linear time. Ids may be null or
    repeated, equal texts have equal spans, spans with one start are ordered by kind and end; an empty table gives none,
    and other columns are ignored.
    """
    trees, cuts = model()
    ready(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_rows = lambda spans: [{"start": a, "end": b, "kind": k} for a, b, k in spans]
        for b in batches:
            base = [base_spans(t or "") for (t,) in rows(b, "text")]
            more = [sorted([*s, *selected(t or "", s, trees, cuts)], key=lambda x: (x[0], KINDS.index(x[2]), x[1])) for (t,), s in zip(rows(b, "text"), base)]
            yield pa.record_batch([*b.columns, pa.array(map(as_rows, base), kind), pa.array(map(as_rows, more), kind)], ["doc_id", "text", "base", "spans"])

    span = "array<struct<start: long, end: long, kind: string>>"
    return texts(docs).mapInArrow(run, f"doc_id long, text string, base {span}, spans {span}")


def digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Counts by base kind, the hash of the base spans and all spans as text, from rows with base and spans."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in kinds),
        F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, done = [], 0
    for a, b, k in sorted(spans):
        if a >= done:
            out += [text[done:a], f"[{k}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
