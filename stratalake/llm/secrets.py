"""Secret scans: fixed patterns, and probabilistic automata inferred from labelled credentials.

A prefix tree of example credentials is generalised by merging states whose outgoing frequencies are compatible within a
Hoeffding bound, and its frequencies become probabilities. A step of the tree is a character of its own where that
character stands out among its class (the fixed prefixes of a format), and its class elsewhere. A candidate, any long run
of token characters with digits, is kept if its likelihood under the automaton exceeds that under a background of ordinary
identifiers by a margin calibrated on held-out examples. The credentials are made by a seeded generator of common formats
and of made-up ones (some prefix, some alphabet), since no table labels such spans.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from stratalake.llm.common import ready, rows, texts

BASE = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
KINDS = (*BASE, "format")
#: Confidence of the merge test, examples used for inference, and the share of ordinary identifiers that may pass.
ALPHA, EXAMPLES, FALSE_SHARE = 0.05, 4000, 0.001
#: Character classes and their members; any other character is a class of its own.
CLASSES = {"vowel of hex": "ae", "consonant of hex": "bcdf", "vowel": "iou", "consonant": "ghjklmnpqrstvwxyz", "digit": "0123456789", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
CLASS_OF = {c: k for k, members in CLASSES.items() for c in members}
#: A character is a step of its own where it comes this often, and this many times its share of its class.
OWN_COUNT, OWN_RATIO = 8, 3.0
_HEX = bytes(120 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
_DIGITS = bytes(range(48, 58))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start and then kind as listed."""
    raw = text.encode("utf-8", "replace")
    low, out = raw.lower(), []
    if any(k in low for k in (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"x" * 24 in raw.translate(_HEX):
        out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


class Automaton:
    """States as {symbol: next}, visit counts, and counts of ends; scores in bits. A symbol is a class or, where it stands
    out, a character."""

    def __init__(self, words: list[str], alpha: float = ALPHA):
        self.next: list[dict] = [{}]
        self.seen: list[dict] = [{}]
        self.ends = [0]
        todo = [(0, 0, words)]
        while todo:  # the prefix tree, a state's words at once
            s, depth, here = todo.pop()
            self.ends[s] = sum(len(w) == depth for w in here)
            by: dict[str, list] = {}
            for w in here:
                if len(w) > depth:
                    by.setdefault(CLASS_OF.get(w[depth], w[depth]), []).append(w)
            for kind, group in by.items():
                share = OWN_RATIO / len(CLASSES.get(kind, "."))
                own = {c for c, n in Counter(w[depth] for w in group).items() if n >= max(OWN_COUNT, share * len(group))}
                parts: dict[str, list] = {}
                for w in group:
                    parts.setdefault(w[depth] if w[depth] in own else kind, []).append(w)
                for symbol, part in parts.items():
                    self.seen[s][symbol] = len(part)
                    self.next[s][symbol] = len(self.next)
                    todo.append((len(self.next), depth + 1, part))
                    self.next.append({})
                    self.seen.append({})
                    self.ends.append(0)
        self.spread = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()

    def _total(self, s: int) -> int:
        return self.ends[s] + sum(self.seen[s].values())

    def _compatible(self, p: int, q: int) -> bool:
        """Whether the shares of ends and of every symbol differ by less than the bound in all states reached by both."""
        todo = [(p, q)]
        while todo:
            a, b = todo.pop()
            n, m = self._total(a), self._total(b)
            bound = self.spread * (1 / math.sqrt(n) + 1 / math.sqrt(m)) if n and m else 2
            if bound > 1:  # no shares differ by more, here or below, where there are no more examples
                continue
            seen_a, seen_b, next_b = self.seen[a], self.seen[b], self.next[b]
            if abs(self.ends[a] / n - self.ends[b] / m) >= bound:
                return False
            for c in seen_a.keys() | seen_b.keys():
                if abs(seen_a.get(c, 0) / n - seen_b.get(c, 0) / m) >= bound:
                    return False
            todo += [(s, next_b[c]) for c, s in self.next[a].items() if c in next_b]
        return True

    def _fold(self, into: int, tree: int) -> None:
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            for c, n in self.seen[b].items():
                self.seen[a][c] = self.seen[a].get(c, 0) + n
                if c in self.next[a]:
                    todo.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def _merge(self) -> None:
        """Kept states grow from the root; each state next to them, a tree still, joins the first compatible one."""
        kept, known = [0], {0}
        while True:
            fringe = [(s, c) for s in kept for c in sorted(self.next[s]) if self.next[s][c] not in known]
            if not fringe:
                break
            s, c = min(fringe, key=lambda f: self.next[f[0]][f[1]])
            q = self.next[s][c]
            for p in kept:
                if self._compatible(p, q):
                    self.next[s][c] = p
                    self._fold(p, q)
                    break
            else:
                kept.append(q)
                known.add(q)
        self.total = {s: self._total(s) for s in kept}

    def bits(self, word: str) -> float:
        """log2 of the probability, a character on average; the members of a class are equally likely, unseen steps get a
        small share, and after one the scan goes on from the state that its class leads to at the start, if any."""
        total, s = 0.0, 0
        for c in word:
            kind = CLASS_OF.get(c, c)
            symbol = c if c in self.next[s] else kind
            size = 1 if symbol == c else len(CLASSES[kind])
            total += math.log2((self.seen[s].get(symbol, 0) + 0.02) / (self.total[s] + 1) / size)
            s = self.next[s].get(symbol, self.next[0].get(kind, 0))
        return (total + math.log2((self.ends[s] + 0.02) / (self.total[s] + 1))) / (len(word) + 1)


def credentials(seed: int, count: int) -> list[str]:
    """Labelled credentials: made-up keys, half of them in common formats, half with some prefix and some alphabet."""
    rng = random.Random(seed)
    upper, lower, digit = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    pick = lambda s, n: "".join(rng.choice(s) for _ in range(n))
    forms = (
        lambda: "AKIA" + pick(upper + digit, 16), lambda: "ghp_" + pick(upper + lower + digit, 36), lambda: "sk_live_" + pick(upper + lower + digit, 24),
        lambda: "xoxb-" + pick(digit, 11) + "-" + pick(digit, 11) + "-" + pick(upper + lower + digit, 24), lambda: pick(upper + lower + digit + "+/", 40),
        lambda: pick("0123456789abcdef", 32), lambda: "AIza" + pick(upper + lower + digit + "_-", 35), lambda: pick(lower + digit, rng.randint(24, 44)),
        lambda: pick(lower, rng.randint(2, 6)) + rng.choice("_-") + pick(upper + lower + digit + rng.choice(("", "_-")), rng.randint(16, 24)),
    )
    alphabets = (upper + lower + digit, upper + lower + digit + "_-", "0123456789abcdef", upper + digit, lower + digit, lower + digit)

    def any_form() -> str:
        parts = [pick(rng.choice((lower, lower, upper)), rng.randint(2, 6)) for _ in range(rng.choice((0, 1, 1, 1, 2)))]
        if len(parts) > 1 and rng.random() < 0.5:
            parts[1] = parts[1][0] + rng.choice(digit)
        sign = rng.choice("_-")
        return sign.join([*parts, pick(rng.choice(alphabets), rng.randint(18, 48))])

    return [(any_form if rng.random() < 0.5 else rng.choice(forms))() for _ in range(count)]


def ordinary(seed: int, count: int) -> list[str]:
    """Long runs of token characters that are no secrets: identifiers, paths, dates, numbers, words, slugs, codes."""
    rng = random.Random(seed)
    onsets, vowels, codas = "b c d f g h j k l m n p r s t v w br ch cl cr dr fl gr pl pr sc sh sp st str th tr sch pf kn qu schw z".split(), "a e i o u ai ea io ou".split(), ["", "", "", "n", "r", "s", "t", "l", "m", "ng", "st", "ck", "cht", "ft", "mpf", "hrt", "ll", "rg", "nd", "ff"]
    word = lambda: "".join(rng.choice(onsets) + rng.choice(vowels) + rng.choice(codas) for _ in range(rng.randint(1, 4)))
    number = lambda a, b: str(rng.randint(10**a, 10**b))
    year = lambda: str(rng.randint(1950, 2039))
    date = lambda sign: f"{year()}{sign}{rng.randint(1, 12):02d}{sign}{rng.randint(1, 28):02d}"

    def mixed(sign: str, least: int, most: int) -> str:
        """Words, and numbers among them or at their ends."""
        parts = [word() for _ in range(rng.randint(least, most))]
        for _ in range(rng.randint(1, 2)):
            k = rng.randrange(len(parts))
            parts[k] = rng.choice((parts[k] + number(0, 2), number(0, 4), year(), number(0, 1) + parts[k][0]))
        return sign.join(parts)

    forms = (
        lambda: mixed("_", 2, 6), lambda: mixed("/", 3, 8), lambda: mixed("-", 3, 8), lambda: "/" + mixed("/", 2, 5) + "/" + mixed("_", 2, 4), lambda: mixed("/", 2, 5) + "/" + mixed("-", 2, 5),
        lambda: "".join(word().title() for _ in range(rng.randint(2, 5))) + number(0, 3), lambda: mixed("_", 2, 4).upper(), lambda: mixed("-", 2, 4).upper(), lambda: word() + word() + word() + number(0, 4),
        lambda: (word() + word() + word()).upper() + number(0, 4), lambda: "".join(word().title() for _ in range(2)) + number(0, 1) + word().title() + word(), lambda: number(15, 25), lambda: date("-") + "-" + mixed("-", 1, 4),
        lambda: word().upper() + "-" + number(4, 8) + "-" + word().upper(), lambda: "=" * rng.randint(8, 20) + number(1, 9), lambda: "-".join(number(2, 4) for _ in range(rng.randint(3, 6))), lambda: date("/") + "/" + word() + "-" + word(),
        lambda: "".join(word().title() for _ in range(rng.randint(2, 4))) + number(0, 1) + rng.choice("abvx") + rng.choice(("", word().title())), lambda: word() + "".join(word().title() for _ in range(2)) + number(0, 2),
        lambda: word() + "+" + number(0, 2) + "-" + mixed("_", 2, 3), lambda: word() + "=" + number(2, 6) + "=" + word() + word(), lambda: word()[:2].upper() + "-" + number(3, 6) + "-" + word()[:2].upper() + "-" + number(3, 6),
    )
    return [w for w in (rng.choice(forms)() for _ in range(count)) if len(w) >= 16]


@lru_cache(maxsize=1)
def model() -> tuple[Automaton, Automaton, float]:
    """Automata of credentials and of ordinary runs, and the margin that FALSE_SHARE of held-out ordinary runs reach."""
    secret, plain = (Automaton(make(1, EXAMPLES)) for make in (credentials, ordinary))
    held = sorted((secret.bits(w) - plain.bits(w) for w in ordinary(2, 5 * EXAMPLES)), reverse=True)
    return secret, plain, max(0.1, held[int(FALSE_SHARE * len(held))] + 0.02)


def by_format(text: str, base: list, secret: Automaton, plain: Automaton, margin: float) -> list[tuple[int, int, str]]:
    """Candidate runs, digits and letters in them, that reach beyond the base spans and whose margin is reached. A run with
    a base span in it is a secret already, in part: it only has to look more like a credential than like ordinary text."""
    raw = text.encode("utf-8", "replace")
    if len(raw.translate(None, _DIGITS)) == len(raw):
        return []
    out, k, reach, starts = [], 0, 0, [a for a, _, _ in base]
    for m in CANDIDATE.finditer(text):
        while k < len(base) and starts[k] <= m.start():  # base spans go by start, candidates too
            reach = max(reach, base[k][1])
            k += 1
        if reach < m.end() and any(c.isdigit() for c in m[0]) and sum(c.isalpha() for c in m[0]) >= 4:
            touched = reach > m.start() or (k < len(base) and starts[k] < m.end())
            if secret.bits(m[0]) - plain.bits(m[0]) >= (0 if touched else margin):
                out.append((*m.span(), "format"))
    return out


def all_spans(text: str, base: list, learnt: tuple[Automaton, Automaton, float]) -> list[tuple[int, int, str]]:
    """The base spans and those of the automata, by start, then kind and end."""
    return sorted([*base, *by_format(text, base, *learnt)], key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, text, base and spans (arrays of struct<start, end, kind>, in code points).

    Null text counts as empty and has no spans; texts of any length are scanned whole, in linear time. Ids may be null or
    repeated, equal texts have equal spans, spans with one start are ordered by kind and end; an empty table gives none,
    and other columns are ignored.
    """
    learnt = model()
    ready(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_rows = lambda spans: [{"start": a, "end": b, "kind": k} for a, b, k in spans]
        for b in batches:
            base = [base_spans(t or "") for (t,) in rows(b, "text")]
            more = [all_spans(t or "", s, learnt) for (t,), s in zip(rows(b, "text"), base)]
            yield pa.record_batch([*b.columns, pa.array(map(as_rows, base), kind), pa.array(map(as_rows, more), kind)], ["doc_id", "text", "base", "spans"])

    span = "array<struct<start: long, end: long, kind: string>>"
    return texts(docs).mapInArrow(run, f"doc_id long, text string, base {span}, spans {span}")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with every secret in text replaced by its kind in brackets, and n_chars, where there is such a column,
    counted anew for the texts that changed. All other columns, and rows without secrets, stay as they are: null and empty
    texts, null and repeated ids, columns of any name. An empty table stays empty."""
    from stratalake.llm.pii import redacted

    learnt = model()
    ready(docs.sparkSession)
    schema, counted = docs.schema, "n_chars" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            old = b.column(at).to_pylist()
            new = []
            for t in old:
                spans = all_spans(t, base_spans(t), learnt) if t else []
                new.append(redacted(t, spans) if spans else t)
            columns = list(b.columns)
            columns[at] = pa.array(new, b.schema.field(at).type)
            if counted:
                k = b.schema.get_field_index("n_chars")
                columns[k] = pa.array([len(x) if x != y else n for x, y, n in zip(new, old, b.column(k).to_pylist())], b.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, schema)
