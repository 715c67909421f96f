"""Substring, suffix and near-duplicate operators, components and embedding search against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from itemforge.llm import jaccard, pq, shared, substrings, suffix, textkit


def corpus(seed, n=60):
    """Texts that share passages, copies, near copies, repeats within, and odd cases."""
    r = random.Random(seed)
    word = lambda: f"{r.choice('abcdef')}{r.randrange(300)}"
    passage = [[word() for _ in range(r.choice((18, 20, 25, 40, 60)))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = [word() for _ in range(r.randint(0, 80))]
        for _ in range(r.randint(0, 2)):
            at = r.randint(0, len(w))
            w[at:at] = r.choice(passage)
        rows.append((i, " ".join(w), None))
    for k in range(12):
        i, t, _ = rows[r.randrange(n)]
        w = t.split()
        if k % 3 and w:
            w[r.randrange(len(w))] = "changed"
        rows.append((n + k, " ".join(w), None))
    rows += [(500, None, None), (501, "", None), (502, "short", None), (503, "short", None), (504, "Short", None), (505, "a b c d", None), (None, rows[0][1], None), (None, "lone text", None)]
    rows += [(600, "same row twice " * 30, None)] * 2 + [(601, "x" * 700, None), (602, "é中" * 200, None), (603, "ab" * 400 + " \x00\x00" * 120, None), (3, "a text with a repeated id " * 12, None)]
    return rows


def ranked(rows):
    """Row order of the operators: null ids last, then a text's place only matters for equal ids."""
    return sorted(set((i if i is not None else 1 << 62, t or "") for i, t, _ in rows))


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("hot", [None, 2])
def test_repeated_words(spark, documents, seed, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(shared, "HOT_SEED", hot)
    rows = [x for x in corpus(seed) if x[0] != 3 or "repeated id" not in x[1]]
    rows = [(i if i is not None else 10_000 + k, t, x) for k, (i, t, x) in enumerate(rows)] if seed == 3 else [x for x in rows if x[0] is not None]
    out = substrings.drop_repeated_words(documents(rows)).collect()
    assert len(out) == len(rows)
    seen, want = {}, {}
    for i, t in ranked(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        gone = set()
        for p in range(len(w) - 19):
            k = tuple(w[p : p + 20])
            if k in seen:
                gone.update(range(p, p + 20))
            seen.setdefault(k, (i, p))
        want[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    for r in out:
        assert (r.n_words, r.n_removed, r.kept) == want[r.doc_id]
    assert substrings.drop_repeated_words(documents([])).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("length, gram, hot", [(200, 50, None), (40, 12, None), (40, 12, 3)])
def test_repeated_bytes(spark, documents, seed, length, gram, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(shared, "HOT_SEED", hot)
    rows = corpus(seed)
    raw = [(i, (t or "").encode()) for i, t, _ in rows]
    n = Counter(b[p : p + length] for _, b in raw for p in range(len(b) - length + 1))
    want = Counter()
    for i, b in raw:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for p in range(len(b) - length + 1):
            if n[b[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[(i, len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone[:-1]]))] += 1
    out = suffix.drop_repeated_bytes(documents(rows), length, gram).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out) == want
    assert suffix.drop_repeated_bytes(documents([])).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_two_stage_order(seed):
    rng = np.random.default_rng(seed)
    length, parts, starts = 12, [], []
    base = rng.integers(97, 97 + (2, 3, 26)[seed % 3], 60).astype(np.uint8)
    for _ in range(8):
        m = int(rng.integers(1, 9))
        at = int(rng.integers(0, 40))
        parts.append(base[at : at + m + length - 1] if rng.random() < 0.6 else rng.integers(97, 99, m + length - 1).astype(np.uint8))
        starts.append(len(parts[-1]) - length + 1)
    text, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
    begins, starts = ends - [len(p) for p in parts], np.array(starts)
    order = suffix.two_stage_order(text, ends, begins, starts, length)
    end_of = np.repeat(ends, ends - begins)
    keys = [text[p : end_of[p]].tobytes()[:length] for p in order]
    assert keys == sorted(keys) and len(set(order.tolist())) == len(order)
    full = {p for b, s in zip(begins, starts, strict=True) for p in range(b, b + s)}
    assert full <= set(order.tolist())


def test_long_text_in_pieces(spark, documents, monkeypatch):
    monkeypatch.setattr(suffix, "SEGMENT", 300)
    monkeypatch.setattr(textkit, "CHUNK_BYTES", 500)
    r = random.Random(4)
    t = "".join(r.choice("abcdefgh") for _ in range(3000))
    rows = [(1, t + t[500:1400], None), (2, t[2000:2600], None)]
    data = [(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x)])) for _, x, _ in rows]
    assert sum(1 for d, o in data for _ in suffix.segments(d, o, 200)) > 5
    for d, o in data:
        got = [(base + a, c) for piece, cut, _, base in suffix.segments(d, o, 200) for x in [suffix.Contexts(piece, cut, 200, 50)] for a, c in zip(x.at, x.count, strict=True)]
        assert sorted(p for a, c in got for p in range(a, a + c)) == list(range(len(d) - 199))


def sets_of(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_groups(rows):
    ids = [(i if i is not None else 1 << 62) for i, _, _ in rows]
    s = [sets_of(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                root[find(i)] = find(j)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(ids[i], least.get(find(i), 1 << 63))
    return Counter((rows[i][0], len(s[i]), None if least[find(i)] == 1 << 62 else least[find(i)]) for i in range(len(rows)))


def near_rows(seed, n=25):
    r = random.Random(seed)
    rows = corpus(seed, 30)
    base = [f"w{r.randrange(999)}" for _ in range(90)]
    long = [f"l{r.randrange(9999)}" for _ in range(3000)]
    for k in range(6):  # large sets, some of them near copies
        w = long[: 2600 + 80 * k] if k < 4 else [f"m{r.randrange(9999)}" for _ in range(2800)] + base[:50]
        rows.append((800 + k, " ".join(w), None))
    for k in range(n):  # chains and clusters of near copies
        w = base[:]
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"n{r.randrange(50)}"
        rows.append((700 + k, " ".join(w).upper() if k % 5 == 0 else " ".join(w), None))
    return rows


@pytest.mark.parametrize("seed, block, hot", [(1, 1024, None), (2, 1024, None), (3, 6, None), (4, 3, None), (5, 1024, 3)])
def test_near_duplicates(spark, documents, seed, block, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(jaccard, "HOT_ROWS", hot)
    rows = near_rows(seed)
    out = jaccard.near_duplicate_groups(documents(rows), block=block).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == near_groups(rows)


def test_drop_near_duplicates(spark, documents):
    rows = near_rows(7)
    kept = jaccard.drop_near_duplicates(documents(rows))
    assert kept.columns == ["doc_id", "text", "lang", "id", "ord"]
    got = [(r.doc_id, r.text) for r in kept.collect()]
    s = [sets_of(t) for _, t, _ in rows]
    left = [k for k in range(len(rows)) if s[k]]
    groups = 0
    while left:  # flood each group in turn
        groups += 1
        queue = [left.pop()]
        while queue:
            i = queue.pop()
            near = [j for j in left if 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j])]
            left = [j for j in left if j not in near]
            queue += near
    assert len([x for x in got if sets_of(x[1])]) == groups
    assert len([x for x in got if not sets_of(x[1])]) == len({(i, t) for i, t, _ in rows if not sets_of(t)})
    assert jaccard.drop_near_duplicates(documents([])).count() == 0


def test_trees_find_what_a_scan_finds():
    rng = np.random.default_rng(0)
    for t in range(20):
        n = int(rng.integers(9, 120))
        base = rng.integers(40, 3000, 6)
        sets = [rng.integers(0, 1 << 40, base[k % 6]) for k in range(6)]
        rows = []
        for _ in range(n):
            x = sets[int(rng.integers(6))].copy()
            x[rng.random(len(x)) < rng.choice([0.02, 0.2, 0.9])] = rng.integers(0, 1 << 40)
            rows.append(np.unique(x[: int(len(x) * rng.uniform(0.75, 1))]).astype(np.uint64))
        x = jaccard.Sets.__new__(jaccard.Sets)
        x.hash, x.size = np.concatenate(rows), np.array([len(r) for r in rows])
        raw, off = jaccard.unpacked(*x.points())
        assert (np.add.reduceat(raw.astype(int), off[:-1]) <= x.size).all() and raw.max() <= jaccard.MOST
        p = jaccard.Points(x.size, raw, off, (4, 5))
        i, j = (k.ravel() for k in np.meshgrid(np.arange(n), np.arange(n)))
        fits = (i < j) & (5 * x.size[i] >= 4 * x.size[j]) & (5 * x.size[j] >= 4 * x.size[i])
        i, j = i[fits], j[fits]
        same = np.array([len(np.intersect1d(rows[a], rows[b])) for a, b in zip(i, j, strict=True)])
        left = p.pairs(i, j)
        assert left[9 * same >= 4 * (x.size[i] + x.size[j])].all()
        a, b = p.forest(np.arange(n))
        root = list(range(n))

        def find(k):
            while root[k] != k:
                k = root[k]
            return k

        for y, z in zip(a, b, strict=True):
            root[find(y)] = find(z)
        assert len(a) < n and all(find(y) == find(z) for y, z in zip(i[left], j[left], strict=True))


@pytest.mark.parametrize("at_once", [0, 1 << 20])
@pytest.mark.parametrize("n, m", [(40, 30), (300, 250), (120, 119)])
def test_components(spark, n, m, at_once, monkeypatch):
    monkeypatch.setattr(shared, "EDGES_AT_ONCE", at_once)
    r = random.Random(n)
    edges = [(r.randrange(-n, n), r.randrange(-n, n)) for _ in range(m)] if m != 119 else [(i, i + 1) for i in range(119)]
    got = {x.node: x.root for x in shared.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    assert got == {i: find(i) for i in root}
    assert shared.components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def test_seed_filter_has_no_false_negative(spark):
    keys = [(int(k), int(n)) for k, n in zip(np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 3000), [1, 2, 3] * 1000, strict=True)]
    f, hot = shared.seed_filter(spark.createDataFrame(keys, "key long, n long"), "t")
    k = np.array([x for x, _ in keys]).view(np.uint64)
    n = np.array([x for _, x in keys])
    assert f.holds(k)[n > 1].all() and f.holds(k)[n == 1].mean() < 0.05 and hot is None
    _, hot = shared.seed_filter(spark.createDataFrame([(1, 5), (1, 6), (2, 4), (3, 1)], "key long, n long"), "t", 4)
    assert [tuple(r) for r in hot.collect()] == [(1, 6)]


def vectors(seed, n=300, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for k in range(n // 3):  # near and exact copies, borderline ones too
        x[k] = x[k + n // 3] * (1 if k % 4 else 3) + rng.normal(size=dim) * (0, 0.1, 0.3, 0.5)[k % 4]
    rows = [(int(i), [float(v) for v in x[i].astype(np.float32)], int((i + n // 3 if i < n // 3 else i) % 3)) for i in range(n)]  # a copy has its source's label
    rows += [(n, None, 1), (n + 1, [0.0] * dim, 1), (n + 2, [float("nan")] * dim, 1), (n + 3, [None] + [1.0] * (dim - 1), 1), (n + 4, rows[5][1], None), (n + 5, [1.0] * (dim - 1), 1), (5, rows[5][1], 2), (n + 6, [float("inf")] * dim, 0)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("block", [4096, 7])
def test_embeddings(spark, seed, block, monkeypatch):
    monkeypatch.setattr(pq, "BLOCK", block)
    rows = vectors(seed)
    df = spark.createDataFrame([(i, v, lab, "x") for i, v, lab in rows], "vec_id long, embedding array<float>, label int, key string")
    out = pq.near_duplicates(df).collect()
    ok = [k for k, (_, v, lab) in enumerate(rows) if v and lab is not None and len(v) == 16 and all(a is not None and np.isfinite(a) for a in v) and any(v)]
    x = np.array([rows[k][1] for k in ok])
    x /= np.linalg.norm(x, axis=1)[:, None]
    lab = np.array([rows[k][2] for k in ok])
    link = (x @ x.T >= 0.93) & (lab[:, None] == lab[None])
    np.fill_diagonal(link, False)
    root = np.arange(len(ok))
    for i, j in zip(*np.nonzero(link), strict=True):
        a, b = root[i], root[j]
        root[root == max(a, b)] = min(a, b)
    ids = np.array([rows[k][0] for k in ok])
    want = Counter((int(ids[i]), int(link[i].sum()), int(ids[root == root[i]].min())) for i in range(len(ok)))
    want += Counter((i, 0, i) for k, (i, _, _) in enumerate(rows) if k not in ok)
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in out) == want and all(r.kept == (r.vec_id == r.component_id) for r in out)
    assert link.sum() > 50
    assert pq.near_duplicates(df.where("false")).count() == 0
    assert all(r.n_links == 0 for r in pq.near_duplicates(df.where("label IS NULL")).collect())


@pytest.mark.parametrize("words", [1, 1 << 20])
@pytest.mark.parametrize("inner", [False, True])
def test_matched_texts(spark, tmp_path, words, inner, monkeypatch):
    monkeypatch.setattr(shared, "MAP_WORDS", 1024 * words)
    texts = spark.createDataFrame([(i if i % 7 else None, str(i % 50), f"text {i}") for i in range(300)], "id long, key string, text string")
    few = shared.written(spark.createDataFrame([(i, str(i % 50), i) for i in range(0, 600, 4)], "id long, key string, x int"), "few")
    got = shared.matched(texts, few, ["id", "key"], inner)
    want = texts.join(few, ["id", "key"], "inner" if inner else "left")
    assert got.columns == want.columns and Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    shared.discard(few)


@pytest.mark.parametrize("limit", [-1, 1 << 30])
def test_substrings_whatever_the_size(spark, documents, limit, monkeypatch):
    """No plan shuffles a text that matches nothing, and results do not depend on the size of what is joined."""
    monkeypatch.setattr(shared, "BROADCAST_BYTES", limit)
    test_repeated_words(spark, documents, 1, None, monkeypatch)
    test_repeated_bytes(spark, documents, 1, 40, 12, 3, monkeypatch)
    test_near_duplicates(spark, documents, 1, 1024, 3, monkeypatch)
    plan = substrings.drop_repeated_words(documents(corpus(1)))._jdf.queryExecution().optimizedPlan().toString()
    assert "shiftleft" in plan


def thue_morse(n):
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_of_a_pattern_are_told_apart(spark, documents):
    """Two words whose polynomial hashes agree modulo 2**64 for every odd base."""
    x, y = thue_morse(2048)
    pad = [f"w{k}" for k in range(19)]
    rows = [(1, " ".join([x, *pad]), None), (2, " ".join([y, *pad]), None)]
    assert all(r.n_removed == 0 for r in substrings.drop_repeated_words(documents(rows)).collect())
    rows = [(1, " ".join([x] * 6), None), (2, " ".join([y] * 6), None)]
    assert {(r.doc_id, r.component_id) for r in jaccard.near_duplicate_groups(documents(rows)).collect()} == {(1, 1), (2, 2)}
    rows = [(1, x[:200], None), (2, y[:200], None)] + [(3, x, None), (4, y, None), (5, x[:300], None)]
    test = [(i, (t or "").encode()) for i, t, _ in rows]
    n = Counter(b[p : p + 200] for _, b in test for p in range(len(b) - 199))
    want = {i: sum(any(n[b[p : p + 200]] > 1 for p in range(max(0, q - 199), min(q, len(b) - 200) + 1)) for q in range(len(b))) for i, b in test}
    assert {r.doc_id: r.n_removed for r in suffix.drop_repeated_bytes(documents(rows)).collect()} == want
