"""Byte pair encoding, packing, Huffman files, quality rules, language identification and HMM scores."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from itemforge.llm import bpe, hmm, huffman, langid, packing, quality, textkit
from itemforge.llm.wordbpe import word_bpe

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [(1, "Hello world, it's fine", "en"), (2, None, "en"), (3, "", None), (None, "null id", "de"), (1, "Hello world, it's fine", "en"), (1, "other text", "fr"), (7, "  \n\t ", None), (8, "a" * 5000 + " 中文　x\x1c\x85 <|endoftext|> '\"’s", None), (9, "word " * 3000, "en")]
SIGNS = list("abc XYZ'  \n\t.,!?0129éñß€’“中文　😀\x0b\x1c\x85İΣ\x01") + ["'s", "'LL", " the", "<|endoftext|>", "  "]


@pytest.mark.parametrize("seed", range(3))
def test_encoders_equal_tokenizers(seed):
    rng = random.Random(seed)
    byte, word = bpe.ByteBpe(BYTE, fragment_bytes=1 + seed), word_bpe(WORD)
    a, b = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    for k in range(1500):
        x = "".join(rng.choices(SIGNS if k % 3 == 0 else SIGNS[:25], k=rng.randint(0, 50)))
        ids = a.encode(x, add_special_tokens=False).ids
        assert byte.encode(x.encode()).tolist() == ids and byte.decode(np.array(ids, dtype=np.uint32)).decode() == a.decode(ids, skip_special_tokens=False)
        assert word.encode(x.encode()).tolist() == b.encode(x, add_special_tokens=False).ids


def test_words_are_encoded_once(monkeypatch):
    from itemforge.llm import wordbpe

    monkeypatch.setattr(wordbpe, "REMEMBERED", 60)
    rng = random.Random(9)
    w, t = wordbpe.WordBpe(WORD), Tokenizer.from_file(WORD)
    for _ in range(30):
        texts = ["".join(rng.choices(SIGNS[: 25 if rng.random() < 0.8 else 60], k=rng.randint(0, 40))) for _ in range(rng.randint(1, 8))]
        flat, n = w.encode_many([x.encode() for x in texts])
        ids = [t.encode(x, add_special_tokens=False).ids for x in texts]
        assert n.tolist() == [len(x) for x in ids] and flat.tolist() == [i for x in ids for i in x]


def test_bpe_rows(spark, documents):
    out = bpe.bpe_decode(bpe.bpe_encode(documents(ODD), BYTE), BYTE).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in out) == sorted((i is None, i or 0, t or "") for i, t, _ in ODD)
    assert bpe.bpe_encode(documents([]), BYTE).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 2049, 5000])
def test_binary_pieces(n):
    p = packing.binary_pieces(n)
    assert sum(p) == n and all(x & (x - 1) == 0 and x <= 2048 for x in p) and p == sorted(p, reverse=True)


def test_packing(spark, documents):
    t = Tokenizer.from_file(BYTE)
    out = packing.pack_documents(documents(ODD), BYTE).collect()
    assert len({r.sequence_id for r in out}) == len(out) and all(r.offset == 0 and len(r.ids) == 4 * r.length and 1 << r.bucket == r.length for r in out)
    want = Counter((i, n) for i, x, _ in ODD for n in packing.binary_pieces(len(t.encode(x or "", add_special_tokens=False).ids) + 1))
    assert Counter((r.doc_id, r.length) for r in out) == want
    assert packing.pack_documents(documents([]), BYTE).count() == 0


@pytest.mark.parametrize("counts", [[], [5], [1, 1], [1, 2, 4, 8, 16, 32, 64, 128], list(range(1, 400)), [10**9] + [1] * 300])
def test_huffman_code(counts):
    c = np.array(counts + [0], dtype=np.int64)
    size = huffman.code_lengths(c, 9)
    used = size[c > 0]
    assert (size[c == 0] == 0).all() and (used <= 9).all() and sum(2.0 ** -int(s) for s in used) <= 1
    if len(used) > 1:
        assert math.isclose(sum(2.0 ** -int(s) for s in used), 1)
        rank = np.lexsort((used, -c[c > 0]))  # ties may take either length
        assert (np.diff(used[rank].astype(int)) >= 0).all()


@pytest.mark.parametrize("part_bytes", [1 << 25, 300])
def test_huffman_files(spark, documents, tmp_path, part_bytes, monkeypatch):
    monkeypatch.setattr(huffman, "PART_BYTES", part_bytes)
    monkeypatch.setattr(huffman, "BLOCK_IDS", 200)
    t = Tokenizer.from_file(WORD)
    for rows, name in ((ODD, "a"), ([], "b")):
        path = f"file://{tmp_path}/{name}"
        huffman.write_ids(documents(rows), path, WORD)
        out = huffman.read_ids(spark, path).orderBy("start").collect()
        want = {}
        for i, x, _ in rows:
            ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [2], dtype="<u4").tobytes()
            want.setdefault(i, []).append(ids)
        assert [r.id for r in out] == sorted((i for i, _, _ in rows), key=lambda i: (i is not None, i or 0))
        start = 0
        for r in out:
            assert r.start == start and bytes(r.ids) in want[r.id] and 4 * r.n_tokens == len(r.ids)
            start += r.n_tokens


def counts(x):
    w = re.findall(r"[^\x20\x09-\x0D]+", x or "")
    lines = [y for y in (x or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(windows)
    covered = {j for i, k in enumerate(windows) if n[k] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, documents):
    rng = random.Random(3)
    good = [" ".join(rng.choices(["the", "of", "and", "sun", "tree", "river", "stone"], k=40)) for _ in range(30)]
    bad = [" ".join(w + "$$$" for w in rng.choices(["buy", "now", "win"], k=40)) for _ in range(10)]
    rows = ODD + [(100 + i, x, "en") for i, x in enumerate(good)] + [(200 + i, x, "en") for i, x in enumerate(bad)] + [(300, "a b\nb # c\n\na b\n \nb # c\n" * 2, None)]
    labels = spark.createDataFrame([(100 + i, 1, 5) for i in range(15)] + [(200, 0, 5), (None, 1, 5), (100, 1, 5)], "doc_id long, quality int, id int")
    out = quality.quality(documents(rows), labels).collect()
    assert len(out) == len(rows)
    text = {}
    for i, x, _ in rows:
        text.setdefault(i, []).append(counts(x))
    for r in out:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got in text[r.doc_id]
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and (not r.base_failed or not r.kept)
    score = {r.doc_id: r.score for r in out}
    assert min(score[100 + i] for i in range(30)) > max(score[200 + i] for i in range(10))
    assert all(r.score == 0 for r in quality.quality(documents(rows), labels.where("false")).collect())
    assert quality.quality(documents([]), labels).count() == 0


def test_quality_score_is_the_mean_log_ratio(spark, documents):
    rows = [(1, "a b c", "en"), (2, "a b d", "en"), (3, "x y", "en")]
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    d = documents(rows)
    table = {r.bucket: (r.raw, r.target) for r in quality.bucket_counts(d, labels.selectExpr("doc_id AS id")).collect()}
    assert sum(r for r, _ in table.values()) == 3 * 8 and sum(t for _, t in table.values()) == 9
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for b, (r, t) in table.items():
        raw[b], target[b] = r, t
    ratio = np.log((target + quality.SMOOTHING) / (raw * 9 / 24 + quality.SMOOTHING))
    grams = ", ".join(g.format(h="get(wh, i)", next="get(wh, i + 1)", x="x") for g in quality.GRAMS)
    g = quality.with_words(d, "doc_id", "text").selectExpr("id", "w", "transform(w, x -> xxhash64(x)) AS wh").selectExpr("id", f"flatten(transform(w, (x, i) -> array({grams}))) AS g").collect()
    want = {r.id: float(np.mean(ratio[r.g])) for r in g}
    for r in quality.quality(d, labels).collect():
        assert abs(r.score - want[r.doc_id]) < 1e-9


def test_native_plan(spark, documents):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    plan = quality.quality(documents(ODD), labels)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapIn", plan)


def language_rows(n, seed=1):
    rng = random.Random(seed)
    make = {"en": ["th", "ing", "er", "and", "the"], "de": ["sch", "ung", "ein", "ich", "über"], "fr": ["eau", "ment", "é", "que", "les"]}
    return [(k, " ".join("".join(rng.choices(make[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(5, 60))), lang) for k in range(n) for lang in [rng.choice(list(make))]]


def test_no_language_is_left_out(spark, documents, monkeypatch):
    """More languages than LABELS: each gives fewer texts, and all are learned."""
    monkeypatch.setattr(langid, "LABELS", 2)
    rows = language_rows(600)
    out = langid.identify(documents(rows)).collect()
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in out if r.held_out]
    assert {r.lang_pred for r in held} == {"en", "de", "fr"} and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_language(spark, documents):
    rows = [*language_rows(400), (1000, None, "en"), (1001, "", None), (1002, "123 !?", "de"), (None, "the thing and the other", None)]
    out = langid.identify(documents(rows)).collect()
    truth = {i: lang for i, _, lang in rows}
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2) for r in out) and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    got = {r.doc_id: r for r in out}
    assert [got[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and got[None].lang_pred == "en"
    assert langid.identify(documents([])).count() == 0
    assert {r.lang_pred for r in langid.identify(documents([(1, "abc", None), (2, None, None)])).collect()} == {"und"}


def test_language_ignores_held_out_labels(spark, documents):
    rows = language_rows(200)
    wrong = [(i, t, "fr" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    a, b = (sorted((r.doc_id, r.lang_pred, r.score) for r in langid.identify(documents(x)).collect()) for x in (rows, wrong))
    assert a == b


def test_marginals_by_enumeration():
    from itertools import product

    rng = np.random.default_rng(0)
    emit, move, first = rng.normal(size=(5, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    p, pairs, begin, log = langid.marginals(emit, np.array([0, 5]), move, first)
    total, want = 0.0, np.zeros((5, 3))
    for y in product(range(3), repeat=5):
        s = math.exp(first[y[0]] + sum(emit[t, y[t]] for t in range(5)) + sum(move[y[t], y[t + 1]] for t in range(4)))
        total += s
        for t in range(5):
            want[t, y[t]] += s
    assert np.allclose(p, want / total) and math.isclose(log, math.log(total)) and np.allclose(begin, p[0]) and math.isclose(pairs.sum(), 4)


def test_forward_by_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)

    def dist(*shape):
        x = rng.random(shape)
        return x / x.sum(-1, keepdims=True)

    m = hmm.Model(np.array([], dtype=np.uint64), dist(3), dist(3, 3), dist(3, 7).T)
    seqs = [[1, 2, 6], [0], [5, 5, 5, 6]]
    off = np.cumsum([0, *map(len, seqs)])
    got = hmm.forward(np.concatenate(seqs), off, m)
    for g, x in zip(got, seqs, strict=True):
        total = sum(m.start[y[0]] * math.prod(m.emit[o, s] for o, s in zip(x, y, strict=True)) * math.prod(m.move[a, b] for a, b in zip(y, y[1:], strict=False)) for y in product(range(3), repeat=len(x)))
        assert math.isclose(g, math.log(total))


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(2)
    symbols = np.concatenate([rng.choice(4, 200) if k % 2 else 4 + rng.choice(4, 200) for k in range(10)]).astype(np.int32)
    off = np.arange(0, 2001, 200)
    unigram = np.full(8, 1 / 8)
    e = hmm.Expected(8, 2)
    e.start += 1
    e.move += 1 + np.eye(2)
    e.emit += rng.random((8, 2)) + 0.5
    m, seen = e.model(np.array([], dtype=np.uint64), unigram), []
    for _ in range(8):
        seen.append(hmm.forward(symbols, off, m).sum())
        e = hmm.Expected(8, 2)
        e.add(symbols, off, m)
        m = e.model(np.array([], dtype=np.uint64), unigram)
    assert seen[-1] > seen[0] + 500


def test_hmm_scores(spark, documents):
    rows = [*language_rows(300), (1000, None, None), (1001, "", None), (None, "The thing", None), (5, "Repeated THE words the", None)]
    out = hmm.score_documents(documents(rows)).collect()
    tok = [(i, (t or "").encode().lower().split()) for i, t, _ in rows]
    learn = [w for i, w in tok if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
    c = Counter(x for w in learn for x in w)
    n, v = sum(c.values()) + len(learn), len(c) + 1

    def want(i, w):
        base = sum(math.log10((k + 0.1) / (n + 0.1 * (v + 1))) for k in [*(c[x] for x in w), len(learn)])
        return (i, len(w) + 1, 1 + sum(c[x] > 0 for x in w), n, round(base, 6))

    assert sorted(map(str, (want(i, w) for i, w in tok))) == sorted(str((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))) for r in out)
    held = [r for r in out if r.held_out and r.n_tokens > 5]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert hmm.score_documents(documents([])).count() == 0
    only_held = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0][:3]
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in hmm.score_documents(documents(only_held)).collect())


def test_words_follow_the_pattern():
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab \t\n\x0b\x0c\r\x1cé中\x85\xa0", k=rng.randint(0, 40))) for _ in range(200)]
    raw = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, raw)])
    w = textkit.Words(np.frombuffer(b"".join(raw), np.uint8), off)
    for k, t in enumerate(texts):
        got = [w.data[a:b].tobytes().decode() for a, b in zip(w.start[w.offsets[k] : w.offsets[k + 1]], w.end[w.offsets[k] : w.offsets[k + 1]], strict=True)]
        assert got == re.findall(r"[^\x20\x09-\x0D]+", t)
    by = {}
    for h, a, b in zip(w.hash, w.start, w.end, strict=True):
        assert by.setdefault(w.data[a:b].tobytes(), h) == h
    assert len(set(by.values())) == len(by)


def test_digests(spark, documents):
    r = bpe.bpe_encode(documents([(1, "abc", None)]), BYTE).select(F.sha2("ids", 256).alias("h")).first()
    ids = Tokenizer.from_file(BYTE).encode("abc", add_special_tokens=False).ids
    assert r.h == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
