"""Readers and writers on small files."""

from pyspark.sql import functions as F

from itemforge.sources import readers, sinks


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def items(df):
    return [r["items"] for r in df.orderBy("row_no").collect()]


def test_wide(spark, tmp_path):
    p = put(tmp_path, "w.csv", "a,b,c\nmilk,bread,\n,,\nNA,eggs, None \n15,,01\n")
    df, how = readers.read_csv(spark, p)
    assert how == "strict" and readers.shape_of(df.columns) == "wide"
    assert items(readers.wide_transactions(df)) == [["milk", "bread"], ["eggs"], ["15", "01"]]
    assert items(readers.wide_transactions(df, drop_empty=False)) == [["milk", "bread"], [], ["eggs"], ["15", "01"]]


def test_long(spark, tmp_path):
    p = put(tmp_path, "l.csv", "TID,Item\n2,milk\n1,bread\n1,eggs\n,x\n3, \n")
    out, how = readers.read_transactions(spark, p)
    assert how["shape"] == "long" and [sorted(x) for x in items(out)] == [["bread", "eggs"], ["milk"], []]


def test_malformed_lines_are_skipped(spark, tmp_path):
    p = put(tmp_path, "m.csv", "transaction_id,item\nT1,Milk\nT2,Bread\nT7,Bread,Milk\n")
    out, how = readers.read_transactions(spark, p)
    assert how["read"] == "skip" and items(out) == [["Milk"], ["Bread"]]


def test_single_and_delimiters(spark, tmp_path):
    p = put(tmp_path, "s.csv", "basket\nmilk bread\nmilk;eggs\n")
    df = spark.read.csv(p, header=True)
    assert items(readers.single_transactions(df, "basket")) == [["milk", "bread"], ["milk", "eggs"]]
    for sep in ";|\t":
        q = put(tmp_path, f"d{ord(sep)}.csv", f"a{sep}b\n1{sep}2\n3{sep}4\n")
        assert readers.sniff_delimiter(spark, q) == sep


def test_text_fingerprint_profile(spark, tmp_path):
    df = spark.createDataFrame([("Row 1: a, b\nnoise\nRow 2: C",)], "text string")
    assert [(r.row_no, r["items"]) for r in readers.row_text(df).orderBy("row_no").collect()] == [(1, ["a", "b"]), (2, ["C"])]
    assert df.select(readers.unique_values(F.col("text")).alias("n")).first().n == 3
    put(tmp_path, "f.csv", "a\n1\n")
    f = readers.fingerprints(spark, str(tmp_path)).first()
    assert f.dataset_id == f"f.csv:{f.dataset_hash[:12]}" and f.dataset_size_bytes == 4
    hot = spark.createDataFrame([(1, 1, 0), (2, "true" == "true" and 1, 1)], "id int, Milk int, Bread int")
    assert items(readers.one_hot(hot, "id")) == [["Milk"], ["Milk", "Bread"]]


def test_resolve_and_write(spark, tmp_path):
    files = spark.createDataFrame([("/new/a.csv", "a.csv"), ("/old/b.csv", "b.csv")], "path string, name string")
    want = spark.createDataFrame([("/old/a.csv",), ("/old/b.csv",), ("/old/c.csv",)], "data_path string")
    got = {r.data_path: r.resolved for r in readers.resolved(want, files).collect()}
    assert got == {"/old/a.csv": "/new/a.csv", "/old/b.csv": "/old/b.csv", "/old/c.csv": "/old/c.csv"}
    df = spark.createDataFrame([("x", 1), ("y", 2)], "dataset_id string, n int")
    sinks.write_artifacts(df, str(tmp_path / "out"))
    sinks.write_artifacts(df.where("dataset_id = 'x'").withColumn("n", F.lit(9)), str(tmp_path / "out"))
    assert {r.dataset_id: r.n for r in spark.read.json(str(tmp_path / "out")).collect()} == {"x": 9, "y": 2}
    sinks.publish(df, str(tmp_path / "hub"), "a")
    assert readers.read_split(spark, str(tmp_path / "hub"), "a").count() == 2
    (tmp_path / "old.json").write_text("{}")
    assert len(sinks.cleanup(spark, f"file://{tmp_path}", ("old.json", "none.json"))) == 1
