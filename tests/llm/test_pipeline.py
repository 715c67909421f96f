"""The pipeline's stages on a small corpus, each against a brute-force version on its own input."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from itemforge.llm import langid, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output rows of every stage."""
    r = random.Random(11)
    word = {"en": ["the", "of", "sun", "tree", "river", "stone", "and"], "de": ["der", "und", "sonne", "baum", "fluss", "stein", "ein"]}
    passage = " ".join(r.choices(word["en"], k=60))
    rows = []
    for i in range(60):
        lang = r.choice(list(word))
        w = [x + str(r.randrange(40)) if r.random() < 0.4 else x for x in r.choices(word[lang], k=r.randint(30, 120))]
        rows.append((i, " ".join(w) + (" " + passage if i % 9 == 0 else ""), lang))
    rows += [(100 + k, rows[k][1] if k % 2 else rows[k][1].replace(rows[k][1].split()[3], "edit", 1), rows[k][2]) for k in range(12)]
    rows += [(200, None, "en"), (201, "", None), (202, "1 2 3 4 5 6 7 8 9 10 11 12", None), (203, "win$$$ now$$$ " * 30, "en"), (204, "same five words again here " * 20, "en"), (None, " ".join(r.choices(word["de"], k=50)), "de"), (5, " ".join(f"{x}{r.randrange(99)}" for x in r.choices(word["en"], k=40)), "en")]
    rows += [rows[7], (300, "é" * 150 + " " + "zwölf " * 3 + "ü" * 200 + "".join(f" w{k}" for k in range(30)), "de"), (301, "x" + "é" * 150 + " other" + "".join(f" v{k}" for k in range(30)), "de")]
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)] + [(203, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs, out = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = f"{d}/{len(out)}"
        stage(spark, docs, d).write.parquet(path)
        got = spark.read.parquet(path)
        out.append((name, docs, got))
        docs = got
    return d, out


def rows_of(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_columns(stages):
    assert [n for n, _, _ in stages[1]] == ["quality rules", "language ID", "near duplicates", "repeated passages", "packing"]
    assert all(o.columns == COLUMNS for _, _, o in stages[1][:-1])


def test_filters(spark, stages):
    d, out = stages
    _, before, after = out[0]
    verdict = quality.quality(before, spark.read.parquet(f"{d}/labels.parquet"), keep=COLUMNS)
    assert rows_of(after) == rows_of(verdict.where("kept")) and 203 not in {r.doc_id for r in after.collect()} and after.count() > 60
    _, before, after = out[1]
    assert rows_of(after) == rows_of(langid.identify(before, keep=COLUMNS).where(f"lang_pred <> 'und' AND score >= {corpus_pipeline.SURE}"))
    assert 202 not in {r.doc_id for r in after.collect()} and after.count() >= before.count() - 2


def test_near_duplicates(stages):
    _, before, after = stages[1][2]
    from tests.llm.test_dedup import sets_of

    rows = sorted({(r.doc_id if r.doc_id is not None else 1 << 62, r.text) for r in before.collect()})
    s = [sets_of(t) for _, t in rows]
    left, want = list(range(len(rows))), set()
    while left:
        queue, group = [left.pop(0)], []
        while queue:
            i = queue.pop()
            group.append(i)
            near = [j for j in left if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j])]
            left = [j for j in left if j not in near]
            queue += near
        want.add(rows[min(group)][0])
    got = [r.doc_id if r.doc_id is not None else 1 << 62 for r in after.collect()]
    assert set(got) == want and len(got) < len(rows)


def test_passages(stages):
    _, before, after = stages[1][3]
    raw = [(r, r.text.encode()) for r in before.collect()]
    n = Counter(b[p : p + 200] for _, b in raw for p in range(len(b) - 199))
    want = Counter()
    for r, b in raw:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for p in range(len(b) - 199):
            if n[b[p : p + 200]] > 1:
                gone[p : p + 200] = True
        text = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]]).decode("utf-8", "replace")
        if text.strip(" \t\n\x0b\x0c\r"):
            want[(r.doc_id, text, r.lang, r.source, r.n_chars if text == r.text else len(text))] += 1
    assert rows_of(after) == want and any(r.text not in {x.text for x, _ in raw} for r in after.collect())


def test_packing_covers_every_token(stages):
    _, before, after = stages[1][4]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in before.collect():
        want[r.doc_id] += len(t.encode(r.text, add_special_tokens=False).ids) + 1
    got = Counter()
    for r in after.collect():
        got[r.doc_id] += r.length
    assert got == want and after.select("sequence_id").distinct().count() == after.count()


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, stages[0]).count() == stages[1][-1][2].count()
