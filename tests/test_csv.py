"""CSV files cut at lines: what is kept, how it is numbered, over many splits, files and shapes."""

import csv
import io
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from itemforge.sources import csvlines, readers


@pytest.fixture
def splits(spark):
    """Splits of a few kilobytes, so that small files have many."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "6000")
    spark.conf.set("spark.sql.files.openCostInBytes", "500")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def ragged(n, seed=0, sep=","):
    """Lines of three cells, some of them short, long, blank, empty or quoted; the first is whole, as pandas takes a long one for rows with an index."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        k = r.randrange(12) if i else 11
        cells = [str(i), r.choice(["x", "", "NA", " y ", f'"q{sep}""{i}"""']), f"z{i}"]
        out.append("" if k == 0 else sep * 2 if k == 1 else sep.join(cells[:2]) if k == 2 else sep.join([*cells, "more"]) if k == 3 else sep.join(cells))
    return out


def by_pandas(lines, sep=","):
    """Rows as pandas reads them when it leaves out what is too long."""
    df = pd.read_csv(io.StringIO(f"a{sep}b{sep}c\n" + "\n".join(lines) + "\n"), sep=sep, engine="python", on_bad_lines="skip", dtype=str, keep_default_na=False)
    return [tuple(None if v is None or (isinstance(v, float)) or v.strip() in csvlines.MISSING else v for v in row) for row in df.itertuples(index=False)]


def test_short_lines_stay_and_long_ones_go(spark, tmp_path):
    (tmp_path / "m.csv").write_text("a,b,c\n1,2,3\n4,5\n6,7,8,9\n6,7,8\n")
    df, how = readers.read_csv(spark, str(tmp_path / "m.csv"))
    assert how == "skip" and [tuple(r) for r in df.collect()] == [("1", "2", "3"), ("4", "5", None), ("6", "7", "8")]


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_one_row_set_whatever_is_selected(spark, tmp_path, splits, sep):
    lines = ragged(3000, 1, sep)
    (tmp_path / "r.csv").write_text(f"a{sep}b{sep}c\n" + "\n".join(lines) + "\n")
    want = by_pandas(lines, sep)
    df, how = readers.read_csv(spark, str(tmp_path / "r.csv"), number="n")
    assert spark.read.text(str(tmp_path / "r.csv")).rdd.getNumPartitions() > 4
    assert how == "skip" and [tuple(r)[:3] for r in df.orderBy("n").collect()] == want and [r.n for r in df.select("n").orderBy("n").collect()] == list(range(1, len(want) + 1))
    for some in (["a"], ["c"], ["b", "n"]):
        assert df.select(*some).count() == len(want) and df.where(F.col("a").isNotNull()).select("c").count() == sum(a is not None for a, _, _ in want)
    out, how = readers.read_transactions(spark, str(tmp_path / "r.csv"))
    items = [[x.strip() for x in row if x is not None and x.strip().lower() not in ("", "nan", "none")] for row in want]
    assert how == {"shape": "wide", "read": "skip"} and [(r.row_no, r["items"]) for r in out.orderBy("row_no").collect()] == list(enumerate([i for i in items if i], 1))


def test_folder_of_parts_counts_on_by_path(spark, tmp_path, splits):
    want = []
    for part in range(6):
        lines = ragged((700, 3, 250, 900, 0, 40)[part], part)
        want += by_pandas(lines) if lines else []
        (tmp_path / f"part-{part}.csv").write_text("a,b,c\n" + "".join(f"{x}\n" for x in lines))
    df, _ = readers.read_csv(spark, str(tmp_path), number="n")
    assert [tuple(r) for r in df.select("n", "a", "b", "c").orderBy("n").collect()] == [(i, *w) for i, w in enumerate(want, 1)]


def write_folder(tmp_path):
    long = [f"{r % 37};{chr(97 + r % 9)}" for r in range(900)]
    files = {
        "wide.csv": ("a,b,c\n" + "\n".join(ragged(800, 3)), None),
        "Long.CSV": ("TID;Item\n" + "\n".join(long), None),
        "single.csv": ("basket\n" + "\n".join(f"i{r} j{r % 7}" if r % 5 else " " for r in range(500)), None),
        "breaks.csv": ('a,b,c\n1,"two\nlines",3\n4,,\n,,\n"5"" pipe",6\n7,8,9,10\n', None),
        "twice.csv": ("x,x,,x\n1,2,3,4\n,NaN,none,\n5,6,7,8\n", None),
        "header.csv": ("a,b\n", None),
        "marked.csv": ("﻿NA,nan\n1,2\nNA,nan\n,\n3,4\n", None),
        "empty.csv": ("", None),
        "notes.txt": ("a,b\n1,2\n", None),
        "with space.csv": ("a,b\r\n1,2\r\n3\r\n", None),
    }
    for name, (text, _) in files.items():
        (tmp_path / name).write_bytes(text.encode())
    return {n: t for n, (t, _) in files.items() if n.lower().endswith(".csv")}


def plain_items(text, keep_empty):
    """(row_no, items) of a wide or single file by Python's own reader."""
    lines = [x for x in csv.reader(io.StringIO(text.removeprefix("﻿"), newline=""), delimiter=csvlines.delimiter_of(text.splitlines()[:40])) if len(x) > 1 or any(c.strip() for c in x)]
    if not lines:
        return []
    good = [[c.strip() for c in x if c.strip() not in csvlines.MISSING and c.strip().lower() not in ("nan", "none")] for x in lines[1:] if len(x) <= len(lines[0])]
    if len(lines[0]) == 1:
        good = [x[0].split() if x else [] for x in good]
    return list(enumerate([g for g in good if g or keep_empty], 1))


@pytest.mark.parametrize("keep_empty", [False, True])
@pytest.mark.parametrize("sent", [50_000, 0])
def test_directory_of_every_shape(spark, tmp_path, splits, keep_empty, sent, monkeypatch):
    monkeypatch.setattr(csvlines, "FILES_SENT", sent)
    monkeypatch.setattr(csvlines, "SPLITS_SENT", sent)
    texts = write_folder(tmp_path)
    got = {}
    for r in readers.read_directory(spark, str(tmp_path), keep_empty).collect():
        got.setdefault(r.dataset_id, {"shape": set(), "read": set(), "rows": []})
        got[r.dataset_id]["shape"].add(r.shape)
        got[r.dataset_id]["read"].add(r.read)
        got[r.dataset_id]["rows"].append((r.row_no, r["items"]))
    assert set(got) == set(texts) - {"empty.csv", "header.csv"}
    for name, g in got.items():
        if name != "Long.CSV":
            assert sorted(g["rows"]) == plain_items(texts[name], keep_empty), name
    assert got["Long.CSV"]["shape"] == {"long"} and len(got["Long.CSV"]["rows"]) == 37
    first = dict(got["Long.CSV"]["rows"])[1]
    assert first == [chr(97 + r % 9) for r in range(900) if r % 37 == 0]
    assert got["single.csv"]["shape"] == {"single"} and {n for n, g in got.items() if g["read"] == {"skip"}} == {"wide.csv", "breaks.csv"}
    assert all(len(g["read"]) == len(g["shape"]) == 1 for g in got.values())


def test_names_and_widths(spark, tmp_path):
    (tmp_path / "t.csv").write_text('x,x,,"a,b"\n1,2,3,"4,""5"""\n"  ","N/A",7\n')
    df, how = readers.read_csv(spark, str(tmp_path / "t.csv"))
    assert how == "strict" and df.columns == ["x", "x.1", "Unnamed: 2", "a,b"]
    assert [tuple(r) for r in df.collect()] == [("1", "2", "3", '4,"5"'), (None, None, "7", None)]


def test_files_that_change_between_scans_are_an_error(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text("a,b\n" + "1,2\n" * 2000)
    files = csvlines.read_files(spark, str(tmp_path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        files.reads.count()  # splits are counted now
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        with pytest.raises(Exception, match="split anew"):
            files.rows.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
