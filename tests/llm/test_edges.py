"""Every operator on long texts, clashing columns and empty tables, and scores against plain recursions."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from itemforge.llm import bpe, chains, hmm, huffman, jaccard, langid, packing, pq, quality, substrings, suffix, textkit
from tests.llm.test_text_operators import BYTE, ODD, WORD, language_rows

CLASH = ["id", "text_key", "ord", "row", "seed", "key", "parts", "salt", "label", "spans", "part", "number", "symbols", "count", "set_key", "member", "_word"]


def clashing(spark, rows):
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    return df.select("doc_id", "text", "lang", *[F.lit(f"x{k}").alias(c) for k, c in enumerate(CLASH)])


def operators(spark, df, tmp_path, name):
    labels = spark.createDataFrame([(1, 1, "x")], "doc_id long, quality int, id string")
    path = f"file://{tmp_path}/{name}"
    huffman.write_ids(df, path, WORD)
    return {
        1: quality.quality(df, labels), 2: huffman.read_ids(spark, path).withColumnRenamed("id", "doc_id"), 3: packing.pack_documents(df, BYTE), 4: hmm.score_documents(df), 5: suffix.drop_repeated_bytes(df),
        6: jaccard.near_duplicate_groups(df), 7: bpe.bpe_decode(bpe.bpe_encode(df, BYTE), BYTE), 8: langid.identify(df), 9: substrings.drop_repeated_words(df),
    }


def test_long_texts(spark, tmp_path):
    """Texts of more than one chunk of bytes, one of them a copy, beside empty ones."""
    r = random.Random(1)
    long = " ".join(f"{r.choice('abcdefghij')}{r.randrange(50_000)}" for _ in range(250_000))
    one = "y" * 1_200_000
    assert len(long) > textkit.CHUNK_BYTES
    rows = [(1, long), (2, long), (3, None), (4, ""), (5, "short text here"), (6, one)]
    out = operators(spark, clashing(spark, rows), tmp_path, "long")
    n = {1: 250_000, 2: 250_000, 3: 0, 4: 0, 5: 3, 6: 1}
    assert {x.doc_id: x.n_words for x in out[1].collect()} == n
    assert {x.doc_id: x.n_tokens for x in out[4].collect()} == {i: k + 1 for i, k in n.items()}
    assert all(math.isfinite(x.score) and math.isfinite(x.base_score) for x in out[4].collect())
    got = {x.doc_id: x for x in out[5].collect()}
    assert {i: x.n_removed for i, x in got.items()} == {1: len(long), 2: len(long), 3: 0, 4: 0, 5: 0, 6: len(one)}
    assert {x.doc_id: x.component_id for x in out[6].collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}
    assert {x.doc_id: x.text for x in out[7].collect()} == {i: t or "" for i, t in rows}
    assert {x.doc_id: x.n_removed for x in out[9].collect()} == {1: 0, 2: 250_000, 3: 0, 4: 0, 5: 0, 6: 0}
    langs = {x.doc_id: x.lang_pred for x in out[8].collect()}
    assert langs == {i: "en" if t else "und" for i, t in rows}
    t, w = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    tokens = {i: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for i, x in rows}
    total = Counter()
    for x in out[3].collect():
        total[x.doc_id] += x.length
        assert x.doc_tokens == tokens[x.doc_id]
    assert total == tokens
    want = {i: np.array(w.encode(x or "", add_special_tokens=False).ids + [2], dtype="<u4").tobytes() for i, x in rows}
    assert {x.doc_id: bytes(x.ids) for x in out[2].collect()} == want


def test_empty_tables(spark, tmp_path):
    for n, df in operators(spark, clashing(spark, []), tmp_path, "none").items():
        assert df.count() == 0, n


def test_null_ids_and_equal_rows_everywhere(spark, tmp_path):
    rows = [(None, "a text without an id"), (None, None), (7, "twice the same row of text"), (7, "twice the same row of text"), (8, "\n\t ")]
    for n, df in operators(spark, clashing(spark, rows), tmp_path, "odd").items():
        per = Counter(r.doc_id for r in (df.where("start = 0") if n == 3 else df).collect())
        assert per == {None: 2, 7: 2, 8: 1}, n


def test_packed_pieces_hold_every_id_once(spark, documents, tmp_path):
    t = Tokenizer.from_file(BYTE)
    out = packing.pack_documents(documents(ODD), BYTE)
    want = Counter()
    for i, x, _ in ODD:
        ids, at = t.encode(x or "", add_special_tokens=False).ids + [packing.END_ID], 0
        for n in packing.binary_pieces(len(ids)):
            want[(i, at, n, np.array(ids[at : at + n], dtype="<u4").tobytes(), len(ids))] += 1
            at += n
    assert Counter((r.doc_id, r.start, r.length, bytes(r.ids), r.doc_tokens) for r in out.collect()) == want
    packing.write_buckets(out, str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.count() == sum(want.values()) and {r.bucket: r.length for r in back.select("bucket", "length").distinct().collect()} == {b: 1 << b for b in {n.bit_length() - 1 for _, _, n, _, _ in want}}


def test_threshold_itself_is_kept(spark, documents):
    rows = [(i, " ".join(random.Random(i).choices(["sun", "tree", "river", "win$", "now$"], k=30)), None) for i in range(20)]
    labels = spark.createDataFrame([(i, 1) for i in range(5)], "doc_id long, quality int")
    scores = {r.doc_id: r.score for r in quality.quality(documents(rows), labels).where("NOT base_failed").collect()}
    edge = sorted(scores.values())[len(scores) // 2]
    kept = {r.doc_id for r in quality.quality(documents(rows), labels, threshold=edge).where("kept").collect()}
    assert kept == {i for i, s in scores.items() if s >= edge} and len(kept) < len(scores)


@pytest.mark.parametrize("labels", [1, 3, 8, 20])
@pytest.mark.parametrize("block", [3, 64])
def test_chains_equal_the_plain_recursion(labels, block, monkeypatch):
    monkeypatch.setattr(chains, "BLOCK", block)
    rng = np.random.default_rng(labels)
    size = rng.integers(0, 30, 25)
    size[4] = 150
    off = np.concatenate([[0], np.cumsum(size)])
    e, move, first = np.exp(3 * rng.normal(size=(off[-1], labels))), np.exp(rng.normal(size=(labels, labels))), np.exp(rng.normal(size=labels))
    want, moves, starts, log = np.zeros_like(e), np.zeros_like(move), np.zeros(labels), 0.0
    for a, b in zip(off, off[1:], strict=False):
        if a == b:
            continue
        alpha, beta = [first * e[a]], [np.ones(labels)]
        for t in range(a + 1, b):
            log += math.log(alpha[-1].sum())
            alpha[-1] = alpha[-1] / alpha[-1].sum()
            alpha.append((alpha[-1] @ move) * e[t])
        log += math.log(alpha[-1].sum())
        for t in range(b - 1, a, -1):
            x = move @ (e[t] * beta[0])
            beta.insert(0, x / x.sum())
        for t in range(b - a):
            x = alpha[t] * beta[t]
            want[a + t] = x / x.sum()
            if t + 1 < b - a:
                y = move * np.outer(alpha[t], e[a + t + 1] * beta[t + 1])
                moves += y / y.sum()
        starts += want[a]
    got = chains.forward_backward(e, off, move, first)
    assert np.allclose(got[0], want) and np.allclose(got[1], moves) and np.allclose(got[2], starts) and math.isclose(got[3], log)


def test_hmm_score_is_the_models_likelihood(spark, documents, monkeypatch):
    monkeypatch.setattr(hmm, "FREQUENT", 20)
    seen, real = [], hmm.train
    monkeypatch.setattr(hmm, "train", lambda *a, **k: seen.append(real(*a, **k)) or seen[-1])
    rows = [*language_rows(80), (1000, None, None), (1001, "Unknown words only here", None)]
    out = {r.doc_id: r for r in hmm.score_documents(documents(rows)).collect()}
    m = seen[0]
    texts = {i: (t or "").lower().split() for i, t, _ in rows}
    learn = Counter(x for i, w in texts.items() if zlib.crc32(str(i).encode()) % 10 for x in w)

    def known(word):
        raw = word.encode()
        w = textkit.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), lower=True)
        return int(m.symbols(w)[0][0]), bool(m.symbols(w)[1][0])

    symbol = {x: known(x) for x in {y for w in texts.values() for y in w}}
    inside, kinds = Counter(), Counter()
    for x, c in learn.items():
        if not symbol[x][1]:
            inside[symbol[x][0]] += c
            kinds[symbol[x][0]] += 1
    assert 0 < sum(symbol[x][1] for x in learn) < len(learn)
    for i, w in texts.items():
        state, log = None, 0.0
        for s in [*(symbol[x][0] for x in w), m.end]:
            state = (m.start if state is None else state @ m.move) * m.emit[s]
            log += math.log10(state.sum())
            state = state / state.sum()
        for x in w:
            s, often = symbol[x]
            if not often:
                log += math.log10((learn[x] + 0.1) / (inside[s] + 0.1 * (kinds[s] + 1)))
        assert math.isclose(out[i].score, log, rel_tol=1e-9), i


def test_language_is_the_models_mean_marginal(spark, documents, monkeypatch):
    seen, real = [], langid.train
    monkeypatch.setattr(langid, "train", lambda *a, **k: seen.append(real(*a, **k)) or seen[-1])
    rows = [*language_rows(60), (900, "the sch 123 ung eau " * 200, None)]
    out = {r.doc_id: r for r in langid.identify(documents(rows)).collect()}
    m = seen[0]
    for i, text, _ in rows:
        emit, use = [], []
        for word in text.encode().split():
            t = langid.Types(np.frombuffer(word, np.uint8), np.array([0, len(word)]))
            emit.append(m.emissions(t.feature, t.count, t.hash)[0].astype(float))
            use.append(bool(t.letter[0]))
        alpha, beta = [m.first + emit[0]], [np.zeros(len(m.labels))]
        for e in emit[1:]:
            alpha.append(np.logaddexp.reduce(alpha[-1][:, None] + m.move, axis=0) + e)
        for e in emit[:0:-1]:
            beta.insert(0, np.logaddexp.reduce(m.move + e + beta[0], axis=1))
        p = np.exp([a + b - np.logaddexp.reduce(a + b) for a, b in zip(alpha, beta, strict=True)])[use].mean(0)
        assert out[i].lang_pred == m.labels[int(p.argmax())] and abs(out[i].score - p.max()) < 1e-5


def test_equal_languages_give_the_first_by_name(spark, documents):
    """Every training text stands there once in each language, so the labels have equal weights."""
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2][:60]
    rows = [(i, f"same words {k // 2} here", ("xx", "aa")[k % 2]) for k, i in enumerate(ids)]
    assert {r.lang_pred for r in langid.identify(documents(rows)).collect()} == {"aa"}


def test_vectors_with_null_ids(spark):
    rows = [(None, [1.0, 0.0], 1), (None, [1.0, 0.1], 1), (4, [1.0, 0.05], 1), (None, None, 1), (5, [0.0, 1.0], 1)]
    out = pq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in out) == {(None, 2, 4, False): 2, (4, 2, 4, True): 1, (None, 0, None, True): 1, (5, 0, 5, True): 1}


@pytest.mark.parametrize("number", range(5))
def test_stages_on_an_empty_table_and_further_columns(spark, tmp_path, number):
    rows = [(i, " ".join(f"{random.Random(i).choice(['the', 'of', 'sun'])}{k % 17}" for k in range(30 + i)), "en", "s", 9) for i in range(12)] + [(None, None, None, None, None), (3, "", "en", None, 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(6)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    name, stage = corpus_pipeline.STAGES[number]
    assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
    more = docs.select("*", *[F.lit("x").alias(c) for c in CLASH])
    plain, out = (stage(spark, d, str(tmp_path)) for d in (docs, more))
    assert out.columns == plain.columns and out.count() == plain.count()
    if name == "packing":
        t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        assert out.agg(F.sum("length")).first()[0] == sum(len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    else:
        assert out.columns == corpus_pipeline.COLUMNS
