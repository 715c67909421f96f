"""Corpus operators on rows that they once left out or treated apart."""

from collections import Counter

import numpy as np
import pytest

from itemforge.llm import bpe, hmm, pq
from tests.llm.test_text_operators import BYTE


def linked(rows, threshold=0.93):
    """(id, links, least id reachable) by comparing all pairs."""
    link = np.zeros((len(rows), len(rows)), dtype=bool)
    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows):
            if i != j and a == b and len(v) == len(w):
                x, y = (np.array(z) / np.abs(z).max() for z in (v, w))
                link[i, j] = x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold
    root = np.arange(len(rows))
    for i, j in zip(*np.nonzero(link), strict=True):
        a, b = root[i], root[j]
        root[root == max(a, b)] = min(a, b)
    return Counter((rows[i][0], int(link[i].sum()), rows[root[i]][0]) for i in range(len(rows)))


@pytest.mark.parametrize("sample", [pq.SAMPLE, 5])
def test_embeddings_of_several_lengths(spark, sample, monkeypatch):
    monkeypatch.setattr(pq, "SAMPLE", sample)
    rng = np.random.default_rng(3)
    rows = []
    for dim, n in ((16, 60), (12, 40), (3, 20), (1, 4)):
        x = rng.normal(size=(n, dim))
        x[: n // 2] = x[n // 2 : n // 2 * 2] + rng.normal(size=(n // 2, dim)) * 0.1
        rows += [(len(rows) + k, [float(v) for v in x[k].astype(np.float32)], k % 2) for k in range(n)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in pq.near_duplicates(df).collect())
    want = linked(rows)
    assert got == want and sum(n for _, n, _ in want) > 60


def test_embeddings_of_doubles(spark):
    edge = float(np.sqrt(1 - 0.93**2))  # the cosine of the first two is below the threshold by less than a float can tell
    rows = [(0, [1.0, 0.0], 1), (1, [0.93 - 1e-9, edge], 1), (2, [1e300, 1e299], 2), (3, [2e300, 3e299], 2), (4, [1e-300, 1e-301], 3), (5, [1e-300, 2e-301], 3), (6, [0.93 + 1e-9, -edge], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in pq.near_duplicates(df).collect())
    assert got == linked(rows) == Counter([(0, 1, 0), (1, 0, 1), (2, 1, 2), (3, 1, 2), (4, 1, 4), (5, 1, 4), (6, 1, 0)])


def training(spark):
    """300 copies of one text and 90 others, as symbols."""
    n = hmm.CLASSES + 1
    texts = [[1, 2, 3, n - 1]] * 300 + [[4, 5 + k, 3 + k % 7, n - 1] for k in range(90)]
    df = spark.createDataFrame([(bytearray(np.array(t, dtype="<i4").tobytes()),) for t in texts], "symbols binary")
    return df, np.array([], dtype=np.uint64), np.full(n, 1 / n)


def test_every_training_round_counts_all_documents_alike(spark, monkeypatch):
    seen, real = [], hmm.expected_counts
    monkeypatch.setattr(hmm, "SAMPLE_ROUNDS", 1)
    monkeypatch.setattr(hmm, "expected_counts", lambda texts, model: seen.append((texts.count(), real(texts, model))) or seen[-1][1])
    df, words, unigram = training(spark)
    model = hmm.train(df, words, unigram)
    assert [n for n, _ in seen] == [390] * hmm.ROUNDS
    last = seen[-1][1].model(words, unigram)
    assert np.allclose(model.emit, last.emit) and np.allclose(model.start, last.start)
    assert all(np.isclose(e.emit.sum(), 4 * 390, rtol=1e-4) and np.isclose(e.start.sum(), 390, rtol=1e-4) for _, e in seen)


def test_first_guess_from_distinct_texts(spark, monkeypatch):
    texts = training(spark)[0]
    flat, off = hmm.sampled(texts)
    rows = {tuple(flat[a:b]) for a, b in zip(off, off[1:])}
    assert len(rows) == len(off) - 1 == 91
    monkeypatch.setattr(hmm, "SAMPLE_TOKENS", 41)
    assert len(hmm.sampled(texts)[1]) - 1 == 10


@pytest.mark.parametrize("size", [1, 40])
def test_unusual_texts_are_split_at_certain_cuts(size):
    b, rng = bpe.ByteBpe(BYTE, fragment_bytes=size), np.random.default_rng(size)
    pieces = ["Привет", "мир", "λόγος", "漢字", "かな", "🙂", "👩‍🔬", "\u00a0", "\u2009", "\u3000", "\u0085", "\u1680", " ", "  ", "\n", "'s", "'", "’", "plain", "Text", "x1", "42", "%%", "٣", "é", "e\u0301", "\ufffd", "\x00", *b.special]
    split = 0
    for _ in range(400):
        text = "".join(pieces[k] for k in rng.integers(0, len(pieces), 60))
        want = b.exact.encode(text, add_special_tokens=False).ids
        assert b.encode(text.encode()).tolist() == want
        split += len(b.fragments(text.encode(), special=True)) > 1
    assert split > 200
    calls, real = [], b.exact

    class Seen:
        def encode_batch_fast(self, texts, **k):
            calls.extend(texts)
            return real.encode_batch_fast(texts, **k)

    b.exact = Seen()
    text = "漢字 qзx Привет, мир. " * 200
    assert b.encode(text.encode()).tolist() == real.encode(text, add_special_tokens=False).ids
    parts = b.fragments(text.encode(), special=True)
    assert "".join(parts) == text and calls == [x for x in parts if b.unusual.search(x)] and len(calls) > 20
    calls.clear()
    text = "plain words stand here and there. " * 100 + "漢字 " + "more of the same. " * 100
    assert b.encode(text.encode()).tolist() == real.encode(text, add_special_tokens=False).ids
    assert 1 <= len(calls) <= 2 and "漢字" in "".join(calls) and len("".join(calls)) < 300


def test_short_texts_are_cut_too():
    b = bpe.byte_bpe(BYTE)
    text = "a text of three hundred bytes or so, which is not long at all but cut all the same. " * 4
    assert len(b.fragments(text.encode())) == 3 and "".join(b.fragments(text.encode())) == text


def test_first_states_come_from_pairs_of_all_documents(spark, monkeypatch):
    df, words, unigram = training(spark)
    group = hmm.grouped(words, np.zeros(0, np.int64), unigram)
    assert len(set(group.tolist())) == len(unigram)
    first, pairs = hmm.pair_counts(df.repartition(5), group)
    want, begins = np.zeros_like(pairs), np.zeros_like(first)
    for r in df.collect():
        g = group[np.frombuffer(bytes(r.symbols), "<i4")]
        begins[g[0]] += 1
        np.add.at(want, (g[:-1], g[1:]), 1)
    assert (pairs == want).all() and (first == begins).all() and pairs.sum() == 3 * 390
    # no round and no start looks at a part of the documents
    monkeypatch.setattr(hmm, "sampled", lambda texts: pytest.fail("a sample"))
    model = hmm.train(df, words, unigram)
    none = hmm.train(df.limit(0), words, unigram)
    for m in (model, none):
        assert np.allclose(m.emit.sum(0), 1) and np.allclose(m.move.sum(1), 1) and np.isclose(m.start.sum(), 1)


def test_pairs_tell_states_apart():
    rng = np.random.default_rng(4)
    emit = np.repeat(np.eye(2), 4, axis=0) / 4
    pairs = np.round(1e5 * emit @ np.array([[0.45, 0.05], [0.05, 0.45]]) @ emit.T)
    guess = rng.random((8, 2))
    before = hmm.fitted_pairs(pairs, guess / guess.sum(0), np.array([[0.4, 0.1], [0.1, 0.4]]), 0)[2]
    got, joint, after = hmm.fitted_pairs(pairs, guess / guess.sum(0), np.array([[0.4, 0.1], [0.1, 0.4]]), 300)
    halves = got.reshape(2, 4, 2).sum(1)
    assert after > before and min(halves.max(0)) > 0.8 and halves.argmax(0).tolist() in ([0, 1], [1, 0])
