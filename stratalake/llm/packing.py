"""Order-preserving packing of token streams by dynamic programming.

Each task packs its rows, in stored order, block by block, without moving a row. Candidate cuts are document ends
(free), sentence ends and, in long stretches without either, fixed steps (penalised). The cost of a sequence is its
padding, a fixed cost and the penalty of the cut that ends it. The best start of a sequence that ends at b minimises
cost(a) + a over the last `limit` tokens, kept by a monotone queue; starts a power of two before b, where no padding is
due, are tried beside it.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from stratalake.llm.common import ready, rows, texts

LIMIT = 2048
#: Costs in tokens of padding: a sequence, a cut at a sentence's end, a cut elsewhere inside a document.
SEQUENCE, SENTENCE, WITHIN = 4.0, 2.0, 12.0
#: Tokens after which a block is packed and sent on, and the widest stretch without a candidate.
BLOCK, STEP = 1 << 20, 256
#: Words a worker remembers the ids of.
WORDS_KEPT = 300_000


class WordTokens(dict):
    """word bytes -> little-endian 32-bit ids; texts are joined from their words.

    The tokenizer cuts at white space and never merges across it, so a text's ids are those of its words in turn. Only
    ASCII white space is cut at here; what else counts as white space the tokenizer sees. Words of plain letters, digits
    and signs are cut further as the tokenizer's own pattern cuts them and their parts, which recur more often, are given
    to its merge table; any other word goes through the whole tokenizer.
    """

    #: Code points that lower-casing and composition treat one by one: ASCII and the accented letters of Latin-1.
    PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
    #: The tokenizer's pattern, over those code points.
    PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z\u00df-\u00f6\u00f8-\u00ff0-9]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.zeros(size + 1, bool)
        for i in range(size):
            token = self.tokenizer.id_to_token(i) or ""
            self.ends[i] = token.endswith("</w>") and token[:-4].endswith((".", "!", "?"))
        spelt = ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {c: spelt.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.merge, self.parts, self.older, self.older_parts = self.tokenizer.model.tokenize, {}, {}, {}
        self.raw = [i.to_bytes(4, "little") for i in range(size)]

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > WORDS_KEPT:  # the words before last go; those met again come back from the generation before
            self.older = dict(self)
            self.clear()
        if found := self.older.get(word):
            self[word] = found
            return found
        if word[:-1].isalpha() and (word.isalpha() or word[-1] in b".,!?;:|"):  # ASCII letters, and a sign at most: the commonest
            text, sign = (word.lower().decode(), "") if word.isalpha() else (word[:-1].lower().decode(), chr(word[-1]))
            found = self.parts.get(text) or self.part(text)
            if sign:
                found += self.parts.get(sign) or self.part(sign)
            self[word] = found
            return found
        text = word.decode()
        if self.PLAIN.fullmatch(text) and "<|" not in text:
            found = b"".join([self.parts.get(p) or self.part(p) for p in self.PARTS.findall(text.lower())])
        else:
            found = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = found
        return found

    def part(self, text: str) -> bytes:
        if len(self.parts) > WORDS_KEPT:
            self.parts, self.older_parts = {}, self.parts
        if found := self.older_parts.get(text):
            self.parts[text] = found
            return found
        spelt = text if text.isascii() else text.translate(self.bytes)
        found = self.parts[text] = b"".join([self.raw[t.id] for t in self.merge(spelt)])
        return found

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, (text or "").encode("utf-8", "replace").split())), "<u4")


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    """One for each Python worker, which keeps what it has learnt from one task to the next."""
    return WordTokens(path)


def best_cuts(at: list[int], penalty: list[float], limit: int = LIMIT) -> list[int]:
    """Chosen cuts among the candidates `at` (ascending, the last one is the end; none more than limit apart)."""
    powers = [1 << k for k in range(limit.bit_length()) if 1 << k < limit]
    large, tail = [p for p in powers if p >= 128], at[-1] - limit  # short sequences pay near the end alone
    index = {0: 0}
    starts, cost, back = [0], [0.0], [0]
    queue = deque([0])
    for i, b in enumerate(at, 1):
        while b - starts[queue[0]] > limit:
            queue.popleft()
        a = queue[0]
        best = cost[a] + limit - (b - starts[a])
        for p in large if b < tail else powers:
            j = index.get(b - p)
            if j is not None and cost[j] < best:
                best, a = cost[j], j
        total = best + penalty[i - 1] + SEQUENCE
        starts.append(b)
        cost.append(total)
        back.append(a)
        index[b] = i
        while queue and cost[queue[-1]] + starts[queue[-1]] >= total + b:
            queue.pop()
        queue.append(i)
    out, i = [], len(at)
    while i:
        out.append(starts[i])
        i = back[i]
    return out[::-1]


def candidates(docs: list[np.ndarray], ends: np.ndarray, limit: int = LIMIT) -> tuple[list[int], list[float]]:
    """Places where a sequence may end, and what a cut there costs; any place within the last sequence's reach."""
    places, fees, start = [], [], 0
    for ids in docs:
        inner = np.nonzero(ends[ids[:-1]])[0] + 1
        inner = inner[inner < len(ids)]
        places += [inner + start, [start + len(ids)]]
        fees += [np.full(len(inner), SENTENCE), [0.0]]
        start += len(ids)
    at, fee = np.concatenate(places).astype(np.int64), np.concatenate(fees)
    step = min(STEP, limit)
    wide = np.nonzero(np.diff(at, prepend=0) > step)[0]
    extra = [np.arange(at[i - 1] + step if i else step, at[i], step) for i in wide]
    extra.append(np.arange(max(start - limit, 0) + 1, start))
    more = np.setdiff1d(np.unique(np.concatenate(extra)), at)
    at, fee = np.concatenate((at, more)), np.concatenate((fee, np.full(len(more), WITHIN)))
    order = np.argsort(at, kind="stable")
    return at[order].tolist(), fee[order].tolist()


def pack_block(names: list, docs: list[np.ndarray], ends: np.ndarray, limit: int = LIMIT) -> Iterator[tuple]:
    """(doc, start, length, crc, doc tokens, sequence within the block, offset) for each piece."""
    cuts = best_cuts(*candidates(docs, ends, limit), limit)
    k = base = 0
    opened = 0
    for name, ids in zip(names, docs):
        raw, done = memoryview(ids.astype("<u4", copy=False).tobytes()), 0
        while done < len(ids):
            length = min(len(ids) - done, cuts[k] - base - done)
            yield name, done, length, zlib.crc32(raw[4 * done : 4 * (done + length)]), len(ids), k, base + done - opened
            done += length
            if base + done == cuts[k]:
                opened = cuts[k]
                k += 1
        base += len(ids)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, limit: int = LIMIT) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each row of docs is a document of its own, repeated rows and null ids included: its text's ids and then end_id, so
    that a null or empty text is the single id. Every id lies in one piece, sequences hold at most limit ids, and rows
    keep their stored order within a task. sequence_id counts within a task, whose number stands in the upper bits.
    A block's last sequences may be cut to powers of two, so no padding is lost at its end. Other columns are ignored.
    """
    ready(docs.sparkSession)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            out = list(pack_block(ids, held, tokens.ends, limit))
            if out:
                columns = list(zip(*out))
                columns[5] = [sequence + s for s in columns[5]]
                sequence = columns[5][-1] + 1
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names)

        tokens, sequence = word_tokens(tokenizer_path), TaskContext.get().partitionId() << 32
        ids, held, size = [], [], 0
        for b in batches:
            for doc, text in rows(b, "doc_id", "text"):
                ids.append(doc)
                held.append(np.append(tokens.encode(text), np.uint32(end_id)))
                size += len(held[-1])
                if size >= BLOCK:
                    yield from packed()
                    ids, held, size = [], [], 0
        if ids:
            yield from packed()

    return texts(docs).mapInArrow(run, ", ".join(f"{n} long" for n in names))
