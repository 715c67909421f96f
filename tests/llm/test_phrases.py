"""Collocations against plain counting, and the perfect hash by itself."""

import re
from collections import Counter

import numpy as np
import pytest

from itemforge.llm import collocations, textkit
from itemforge.llm.perfecthash import PerfectHash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=10, share=50, top=2000):
    """{(lang, rank): (phrase, a, l, r, n, score)} by counting every phrase of every piece."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    found = {g: c for g, c in f.items() if len(g) > 2 and c >= least}
    lost = {p for g, c in found.items() if len(g) == 4 for p in (g[:3], (g[0], *g[2:])) if 100 * c >= share * f[p]}
    out = []
    for g, a in found.items():
        if g not in lost:
            cuts = [(1_000_000 * a * a // (f[g[: k + 1]] * f[(g[0], *g[k + 1 :])]), k) for k in range(1, len(g) - 1)]
            score, k = min(cuts)
            out.append((g[0], -score, -a, " ".join(g[1:]).encode(), f[g[: k + 1]], f[(g[0], *g[k + 1 :])]))
    ranks, want = Counter(), {}
    for lang, s, a, phrase, left, right in sorted(out):
        ranks[lang] += 1
        if ranks[lang] <= top:
            want[lang, ranks[lang]] = (phrase.decode(), -a, left, right, n[lang], -s)
    return want


def got(spark, rows, parts=3, **settings):
    df = spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, w1 string, shard int").repartition(parts)
    out = collocations.collocations(df, **settings).collect()
    found = {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in out}
    assert len(found) == len(out)
    return found


def texts(seed, n=900):
    rng = np.random.default_rng(seed)
    pool = ["the", "of", "New", "York", "city", "é", "漢字", "x" * 300, "_", "-", "a b", "'s", "to", "be", "or", "not", "big", "\x00", "im", "Haus"]
    marks = [" ", " ", " ", " ", "  ", "\t", ", ", ".", "; ", "\n", "\r\n", "?! ", " \x0b ", "\x1f "]
    weight = 1 / np.arange(1, len(pool) + 1)
    rows = []
    for _ in range(n):
        words = rng.choice(pool, rng.integers(0, 60), p=weight / weight.sum())
        rows.append(("".join(w + marks[rng.integers(len(marks))] for w in words), [None, "und", "de", "en", "EN"][rng.integers(5)]))
    return rows + [(None, "de"), ("", "en"), (" .,", None), ("New York city " * 30, "fr"), ("New York city " * 30, "fr"), ("tie a. tie b. " * 10, "it")]


@pytest.mark.parametrize("seed", range(2))
def test_equals_plain_counting(spark, seed):
    rows = texts(seed)
    want = plain(rows)
    assert {k[0] for k in want} >= {"und", "de", "en", "EN", "fr", "it"} and len(want) > 150
    assert got(spark, rows) == want


def test_ranks_end_within_ties(spark):
    rows = texts(3)
    rows.append((". ".join(f"left{i} right{i}" for i in range(40) for _ in range(10)), "de"))
    for top in (1, 20):
        assert got(spark, rows, top=top, share=30, least=6) == plain(rows, 6, 30, top)


def test_small_shards_and_many_questions(spark, monkeypatch):
    for name, value in (("SHARD_KEYS", 20), ("LOOKUPS", 8), ("QUESTIONS", 5), ("COUNTERS", 3), ("RANKERS", 2)):
        monkeypatch.setattr(collocations, name, value)
    monkeypatch.setattr(textkit, "CHUNK_BYTES", 2000)
    rows = texts(4)
    assert got(spark, rows, parts=7) == plain(rows)


def test_filters_only_save_work(spark, monkeypatch):
    monkeypatch.setattr("itemforge.llm.shared.FILTER_BITS", (1 << 10, 1 << 10))
    rows = texts(5, 60)
    assert got(spark, rows, least=4) == plain(rows, 4)


def test_words_of_one_number_take_the_next_seed(spark, monkeypatch):
    tried, real = [], collocations.word_counts

    def weak(docs, seed):
        from pyspark.sql import functions as F

        tried.append(seed)
        out = real(docs, seed)
        return out.withColumn("w1", F.col("w1") % 8) if seed == 0 else out

    monkeypatch.setattr(collocations, "word_counts", weak)
    rows = texts(6, 40)
    assert got(spark, rows, least=3) == plain(rows, 3) and tried == [0, 1]


def test_nothing_to_find(spark):
    for rows in ([], [(None, None)], [("only a few words here", "en")], [("a. " * 50, "en")]):
        assert got(spark, rows) == {}


def test_exact_scores_beyond_64_bits(spark):
    big = 4_000_000_000
    df = spark.createDataFrame([(1, 1, 2, None, big, big + 1, big + 7, None, None), (1, 1, 2, 3, big, big * 2, big, big, big * 2)], "lang_key long, w1 long, w2 long, w3 long, a long, l1 long, r1 long, l2 long, r2 long")
    out = [(r.l, r.r, r.score) for r in collocations.scored(df, 1_000_000).collect()]
    assert out == [(big + 1, big + 7, 1_000_000 * big * big // ((big + 1) * (big + 7))), (big * 2, big, 500_000)]


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5000):
        high, low = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(2))
        if n > 4:
            high[:4], low[4:8] = high[0], low[4]  # keys that share one half
        table = PerfectHash.from_bytes(PerfectHash.of(high, low).to_bytes())
        slot = table.slots(high, low)
        assert sorted(slot.tolist()) == list(range(n)) and (table.high[slot] == high).all()
        assert (table.slots(high, low + np.uint64(1)) == -1).all()
        assert sum(map(len, table.levels)) <= 4 * n
    with pytest.raises(ValueError):
        PerfectHash.of(np.zeros(2, np.uint64), np.zeros(2, np.uint64))


def test_counted_keeps_half_equal_keys_apart():
    high, low = np.array([5, 5, 5, 7], np.uint64), np.array([1, 2, 1, 1], np.uint64)
    one, n = collocations.counted(high, low)
    assert sorted((int(high[i]), int(low[i]), int(c)) for i, c in zip(one, n)) == [(5, 1, 2), (5, 2, 1), (7, 1, 1)]
