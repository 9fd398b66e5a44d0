"""The registered queries against brute-force versions of their contracts on the smallest tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from stratalake.llm import registry
from stratalake.llm.vocabulary import tokenizer_path

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return dict(duckdb.sql(f"select doc_id, coalesce(text, '') from '{DATA}/documents.parquet' order by 1").fetchall())


def run(spark, name):
    return registry.queries()[name](spark, DATA).collect()


sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def test_op1(spark, docs):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = run(spark, "op1_sentencepiece")
    assert len(got) == len(docs)
    for r in got:
        ids = np.array(sp.encode(docs[r["doc_id"]]), "<u4")
        assert (r["n_ids"], r["ids_crc32"], r["decoded_sha256"]) == (len(ids), zlib.crc32(ids.tobytes()), sha(docs[r["doc_id"]]))


def test_op2(spark, docs):
    from tests.llm.test_ngram_join import brute

    want = brute(list(docs.items()), 3, 90, 100)
    assert sorted(map(tuple, run(spark, "op2_ngram_jaccard"))) == want


def test_op3_held_out_accuracy(spark):
    from stratalake.llm import quality

    d = "/root/testdata/sf0.01"
    labels = dict(duckdb.sql(f"select doc_id, quality from '{d}/labels.parquet'").fetchall())
    got = registry.queries()["op3_quality"](spark, d).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got)
    held = [(labels[r["doc_id"]], r["predicted"], r["score"]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 50 and np.mean([q == p for q, p, _ in held]) >= 0.95
    good, bad = [s for q, _, s in held if q], [s for q, _, s in held if not q]
    assert np.mean([g > b for g in good for b in bad]) >= 0.98
    # one coordinate by hand: the first update of follow-the-regularised-leader from zero
    w = quality.train([(1, np.array([0]), np.array([1.0]))], 2)
    assert w[0] > 0 and w[1] == 0 and w[2] > 0


def test_op4(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    got = run(spark, "op4_packing")
    by, seq = defaultdict(list), defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        seq[r["sequence_id"]].append(r)
    assert by.keys() == docs.keys()
    for k, text in docs.items():
        ids, at = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(by[k], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = total = 0
    for s in seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 0.01 * total


@pytest.mark.parametrize("seed", range(5))
def test_best_cuts_equal_brute_force(seed):
    from stratalake.llm import packing

    rng = np.random.default_rng(seed)
    at = np.cumsum(rng.integers(1, 6, 14)).tolist()
    fee = rng.choice([0.0, 2.0, 12.0], 14).tolist()
    cost = lambda n, p: packing.SEQUENCE + p + (0 if n & (n - 1) == 0 else 16 - n)
    best = {0: 0.0}
    for b, p in zip(at, fee):
        best[b] = min(best[a] + cost(b - a, p) for a in best if b - a <= 16)
    cuts, last, total = packing.best_cuts(at, fee, 16), 0, 0.0
    for c in cuts:
        total += cost(c - last, fee[at.index(c)])
        last = c
    assert last == at[-1] and total == pytest.approx(best[at[-1]])


def test_op5(spark, docs):
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    for r in run(spark, "op5_licenses"):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), docs[r["doc_id"]])
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(i, label) for p, label in phrases.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))
        assert {x for x in r["base_labels"].split(",")} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_op5_templates_align(spark):
    """Every wording is found as it stands and with words added, lost and changed; half a wording is none."""
    from stratalake.llm import licenses

    index, rng = licenses.default_index(), np.random.default_rng(2)
    labels = lambda text: licenses.scan(text, index)[5].split(",")
    for label, body, keys in licenses.TEMPLATES:
        assert label in labels(f"Some code. {body.title()}, and so on " * 2)
        assert licenses.scan("other words " + body.split()[-1], index)[5] in ("", "mit", "apache", "gpl")
        key = keys[0].split()
        at = next(i for i in range(len(body)) if body.split()[i : i + len(key)] == key)
        found = 0
        for _ in range(20):
            ws, spare = body.split(), set(range(at, at + len(key)))
            for i in sorted(rng.choice(len(ws), max(1, len(ws) // 10), replace=False).tolist(), reverse=True):
                if i not in spare:
                    ws[i : i + 1] = [[], ["other"], ["some", "more", ws[i]]][rng.integers(0, 3)]
            found += label in labels(f"Header 2024. {' '.join(ws)} end")
        assert found >= 19
    half = " ".join(licenses.TEMPLATES[8][1].split()[:9])
    assert "bsd" not in labels(half)
    assert "bsd" in labels("Redistribution and use in source and binary forms, as said before now, with or without modification, are permitted provided that the following conditions are met:")
    nine = " ".join(b + ". Then more. " for _, b, _ in licenses.TEMPLATES)
    assert set(labels(nine)) == {label for label, _, _ in licenses.TEMPLATES}


def plain_alignment(body, ws):
    """The recurrence cell by cell: worth of the best alignment that ends at each place."""
    worth = [0.0] * (len(ws) + 1)
    for w in body:
        new = [0.0]
        for j in range(1, len(ws) + 1):
            new.append(max(worth[j], worth[j - 1] + 1 if ws[j - 1] == w else 0.0, new[j - 1] - 0.25))
        worth = new
    return worth[1:]


def test_op5_finds_every_alignment(spark):
    """Labels and scores of whole texts, with several licences and common licence words, as alignments of all templates
    with whole texts give them: votes, stretches and the corpus's IDF lose nothing."""
    from stratalake.llm import licenses

    idf = licenses.corpus_idf(spark.read.parquet(f"{DATA}/documents.parquet"))
    bodies, rng = [b for _, b, _ in licenses.TEMPLATES], np.random.default_rng(5)
    wording = {label: body for label, body, _ in reversed(licenses.TEMPLATES)}
    both = "associated binary charge code compliance conditions deal distribute documentation domain except "
    texts = [" x ".join(wording[k] for k in ks) for ks in (("mit", "apache", "bsd", "mpl"), ("mit", "bsd", "cc", "unlicense"))] + [both + b for b in bodies[::3]]
    for _ in range(25):
        ws = " x ".join(bodies[k] for k in rng.permutation(len(bodies))[: rng.integers(1, 3)]).split()
        for i in sorted(rng.integers(0, len(ws), rng.integers(0, len(ws) // 2)).tolist(), reverse=True):
            ws[i : i + 1] = [[], ["license"], ["other"], ["of", "the", ws[i]]][rng.integers(0, 4)]
        texts.append(" ".join(ws))
    seen = 0
    for text in texts:
        ws, want = licenses.words(text), {}
        for label, body, keys in licenses.default_index().templates:
            reach = len(body) + int(0.4 * len(body) / 0.25)
            for end, worth in enumerate(plain_alignment(body, ws)):
                near = ws[max(0, end - reach + 1) : end + 3]
                # the phrase's end lies in reach; its start may lie before
                held = all(any(end - reach < e <= end + 2 for e in licenses.phrase_ends(ws, k)) for k in keys)
                if worth >= 0.6 * len(body) - 1e-9 and held and near:
                    want[label] = max(want.get(label, 0.0), worth / len(body))
        seen += len(want)
        for index in (licenses.default_index(), licenses.Index(idf=idf)):
            assert index.aligned(ws) == pytest.approx(want)
    assert seen > 25 and {"mit", "apache", "bsd", "mpl"} <= set(licenses.scan(texts[0], licenses.default_index())[5].split(","))


def test_op6(spark):
    conv = defaultdict(list)
    for c, t, r, x in duckdb.sql(f"select * from '{DATA}/conversations.parquet' order by conv_id, turn").fetchall():
        conv[c].append((r, x or ""))
    says = "</s>[INST] ok [/INST]"
    conv[-7] = [("user", says), ("assistant", says)]
    got = {r["conv_id"]: r for r in run(spark, "op6_chat")}
    assert got.keys() == conv.keys()
    for k, turns in conv.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert tuple(got[k])[1:5] == (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss))


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0


def test_op7(spark, docs):
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    check_spans(run(spark, "op7_pii"), docs, kinds)


def test_op9(spark, docs):
    kinds = {
        "assign": (r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?(?P<v>[A-Za-z0-9+/_.=-]+)""", lambda m: len(re.split(r"""[:=]\x20*["']?""", m, maxsplit=1)[1]) >= 6),
        "access": (r"AKIA[A-Z0-9]+", lambda m: len(m) >= 20),
        "hex": (r"[0-9a-f]+", lambda m: len(m) >= 24),
    }
    check_spans(run(spark, "op9_secrets"), docs, kinds)


def check_spans(got, docs, kinds):
    assert len(got) == len(docs)
    for r in got:
        text = docs[r["doc_id"]]
        want = sorted((m.start(), i, m.end(), k) for i, (k, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, text) if ok(m[0]))
        listed = [f"{k}:{a}:{b}" for a, _, b, k in want]
        assert [r[f"n_{k}"] for k in kinds] == [sum(w[3] == k for w in want) for k in kinds]
        assert r["base_sha256"] == sha(",".join(listed))
        assert set(listed) <= set(r["spans"].split(",")) | {""}


def test_models_separate_what_they_should():
    from stratalake.llm import pii, secrets

    secret, plain, margin = secrets.model()
    found = lambda ws: np.mean([secret.bits(s) - plain.bits(s) >= margin for s in ws])
    assert found(secrets.credentials(77, 300)) >= 0.95 and found(secrets.ordinary(78, 300)) <= 0.02
    trees, cuts = pii.model()
    text = "call (437) 555-0689 about order 12345678, iban DE89 3704 0044 0532 0130 00 or jo at mail dot org"
    assert {text[a:b] for a, b, _ in pii.selected(text, [], trees, cuts)} >= {"(437) 555-0689", "DE89 3704 0044 0532 0130 00"}
    made, y = pii.examples(9, 2000)
    p = trees.probability(np.array([pii.features(*m) for m in made]))
    assert np.mean((p >= 0.5) == y) >= 0.85


def test_op8(spark, docs):
    got = run(spark, "op8_media")
    assert len(got) == len(docs)
    for r in got:
        raw = docs[r["doc_id"]].encode()
        padded = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), sha(padded), zlib.crc32(padded[-64:]))


def test_pictures_round_trip(spark):
    from stratalake.llm import media

    rng = np.random.default_rng(1)
    for h, w in ((1, 1), (3, 5), (17, 64), (40, 33)):
        g = rng.integers(0, 256, (h, w), dtype=np.uint8)
        assert (media.decode(media.encode_pgm(g)) == g).all() and (media.decode(media.encode_bmp(g)) == g).all()
        whole = media.area_resize(g, 1, 1)[0, 0]
        assert whole == pytest.approx(g.mean()) and media.area_resize(g, h, w) == pytest.approx(g)
    assert media.decode(b"P2 # c\n2 1 255\n7 9\n").tolist() == [[7, 9]]
    assert media.decode(b"P6\n1 1\n255\n\1\2\3").tolist() == [[[1, 2, 3]]]
    up = np.repeat(np.arange(64, dtype=np.uint8)[None], 8, 0)
    assert media.difference_hash(up) == "f" * 16 and media.difference_hash(up[:, ::-1]) == "0" * 16
    df = spark.createDataFrame([(1, bytearray(media.encode_bmp(up))), (2, None), (3, bytearray(b"junk"))], "id long, data binary")
    got = {r["id"]: r for r in media.media_columns(df).collect()}
    assert (got[1]["height"], got[1]["width"], got[1]["dhash"]) == (8, 64, "f" * 16) and got[2]["tile"] is None and got[3]["dhash"] is None


def test_op10(spark, docs):
    ids, texts = list(docs), list(docs.values())
    got = {r["doc_id"]: r for r in run(spark, "op10_fingerprints")}
    assert len(got) == len(docs)
    prints = defaultdict(set)
    for i, (k, t) in enumerate(zip(ids, texts)):
        nxt = texts[(i + 1) % len(texts)]
        h = len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        r = got[k]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), sha(edited)) and 0 <= r["near_next"] <= 1
        prints[t].add(r["fingerprint"])
        if edited == t:
            assert r["near_edited"] == 1.0
    assert all(len(p) == 1 for p in prints.values()) and len({p for s in prints.values() for p in s}) == len(prints)
    assert np.mean([r["near_edited"] for r in got.values()]) > 0.3 > 0.1 > np.mean([r["near_next"] for r in got.values()])


def test_neighbours_over_buckets(spark, monkeypatch):
    from stratalake.llm import fingerprints

    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 3)
    df = spark.createDataFrame([(i * i, f"t{i}") for i in range(40)] + [(None, "first")], "doc_id long, text string").repartition(7)
    got = {r["text"]: r["next_text"] for r in fingerprints.with_next(df).collect()}
    assert got == {f"t{i}": f"t{i + 1}" for i in range(39)} | {"t39": "first", "first": "t0"}


def test_fingerprints_are_homomorphic(spark):
    import pyspark.sql.functions as F

    from stratalake.llm import fingerprints as fp

    df = spark.createDataFrame([("one.\ntwo.\nthree.\n", "three.\none.\ntwo.\n", "two.\n", "one.\nthree.\n")], "a string, b string, c string, d string")
    for c in "abcd":
        df = fp.vectors(df, c, f"v{c}")
    r = df.select(F.expr("va = vb").alias("same"), (F.col("va") == fp.plus(F.col("vc"), F.col("vd"))).alias("added"), (fp.minus(F.col("va"), F.col("vc")) == F.col("vd")).alias("removed"), F.expr("va <> vd").alias("differs")).first()
    assert all(r)


def test_viterbi_equals_brute_force(spark):
    import itertools

    from stratalake.llm.pieces import viterbi

    table = {"a": -2.0, "b": -2.5, "ab": -3.0, "ba": -4.2, "aba": -5.5, "bab": -4.0, "c": -1.0, "abc": -3.5}
    words = ["".join(w) for n in range(7) for w in itertools.product("abcx", repeat=n)][:900:3] + [""]

    def best(w):
        score = [0.0] + [-1e9] * len(w)
        for i in range(1, len(w) + 1):
            for k in range(1, 4):
                if k <= i and (s := table.get(w[i - k : i], -100.0 if k == 1 else None)) is not None:
                    score[i] = max(score[i], score[i - k] + s)
        return score[-1]

    got = viterbi(spark.createDataFrame([(w,) for w in words] + [(None,)], "word string"), spark.createDataFrame(list(table.items()), "piece string, score double")).collect()
    assert len(got) == len(set(words))
    for r in got:
        assert "".join(r["pieces"]) == r["word"] and r["score"] == pytest.approx(best(r["word"]))


def test_encoders_equal_their_libraries():
    import random

    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    from stratalake.llm import packing, pieces

    sp, t = SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model")), Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    a, b = pieces.Encoder(tokenizer_path("piece_bpe_32k.model")), packing.WordTokens(tokenizer_path("word_bpe_49k.json"))
    rng, parts = random.Random(1), [" ", "  ", "a", "th", "ing", "\n", "é", "日本", "▁", "1", "-", "==", "\t", "😀", "I", " the", "ß", "\x00", "…", "ﬁ", "　", "<s>", "'s", "'LL", "<|endoftext|>", "é", "²", "\x85"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["x" * 300, "ab" * 200, " " * 40]
    for text, ids in zip(texts, a.encode(texts)):
        assert ids.tolist() == sp.encode(text)
        assert a.decode(ids) == text.replace("▁", " ")
        assert b.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids
