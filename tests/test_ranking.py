"""Places in groups against windows, and exact quantiles against percentiles."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from itemforge.operators import quantiles, ranking
from itemforge.sources.readers import numbered


def rows(spark, n=4000, seed=1):
    """A group with two thirds of the rows, small ones, null ones, and keys with ties and nulls."""
    r = random.Random(seed)
    data = [("hot" if i % 3 else r.choice([None, "a", "b", f"g{i % 97}"]), r.choice([None, r.randrange(30), r.randrange(10**6)]), f"t{i}") for i in range(n)]
    return spark.createDataFrame(data, "dataset_id string, k long, text string").repartition(5)


@pytest.mark.parametrize("size", [7, 300, 1 << 20])
def test_places_equal_a_window(spark, size, monkeypatch):
    monkeypatch.setattr(ranking, "RANGE_ROWS", size)
    df = rows(spark)
    for group in (["dataset_id"], [], ["dataset_id", "_even"]):
        x = df.withColumn("_even", F.length("text") % 2)
        got = ranking.place_in_order(x, [F.col("k").desc() if False else -F.col("k"), F.col("text")], group, "place")
        window = Window.partitionBy(*(group or [F.lit(0)])).orderBy(-F.col("k"), "text")
        want = x.withColumn("place", F.row_number().over(window))
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.withColumn("place", F.col("place").cast("long")).collect()))
    top = ranking.first_in_order(df, [F.col("text")], ["dataset_id"], 4)
    assert top.columns == df.columns
    each = {r.dataset_id: r.n for r in top.groupBy("dataset_id").agg(F.count("*").alias("n")).collect()}
    assert each == {r.dataset_id: min(4, r.n) for r in df.groupBy("dataset_id").agg(F.count("*").alias("n")).collect()}


def test_a_hot_group_spans_tasks(spark, monkeypatch):
    """No range, so no task of the window, holds more than a few times its rows, though one group has two thirds of them."""
    monkeypatch.setattr(ranking, "RANGE_ROWS", 200)
    df = rows(spark).select("dataset_id", "text")
    keyed = df.withColumn("_key", F.struct("dataset_id", "text"))
    limits = ranking._limits(keyed.select("_key")).first()._limits
    assert 10 < len(limits) <= 40
    hot = sum(x[0] == "hot" for x in limits)
    assert hot > len(limits) // 2


def test_equal_rows_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(ranking, "RANGE_ROWS", 5)
    same = spark.createDataFrame([("a", 1)] * 50 + [("b", 2)], "dataset_id string, k long")
    got = sorted((r.dataset_id, r.row_no) for r in numbered(same, "k", ["dataset_id"]).collect())
    assert got == [("a", i) for i in range(1, 51)] + [("b", 1)]
    assert ranking.place_in_order(same.where("false"), [F.col("k")], ["dataset_id"], "n").count() == 0


def columns(spark):
    r = random.Random(4)
    data = [(r.choice([None, r.gauss(0, 1) * 10 ** r.randrange(-9, 9)]), r.randrange(5), 7, None, r.choice([1e308, -1e308, 5e-324, 0.0, -0.0]), 2**60 + r.randrange(9) * 1024) for _ in range(2500)]
    return spark.createDataFrame(data, "a double, b int, c long, d double, e double, f long").repartition(3)


@pytest.mark.parametrize("parts", [2, 5, 1024])
def test_quantiles_equal_percentiles(spark, parts, monkeypatch):
    monkeypatch.setattr(quantiles, "PARTS", parts)
    df = columns(spark)
    shares = [0, 0.1, 0.25, 0.5, 0.999, 1]
    names = ["a", "b", "c", "d", "f"] + (["e"] if parts == 5 else [])
    got = quantiles.quantiles(df, {c: F.col(c) for c in names}, shares)
    want = df.agg(*[F.percentile(F.col(c).cast("double"), shares).alias(c) for c in names]).first().asDict()
    for c in names:
        assert got[c] == (want[c] or []) or all(math.isclose(x, y, rel_tol=1e-12) for x, y in zip(got[c], want[c], strict=True)), c
    assert quantiles.quantiles(df.where("false"), {"a": F.col("a")}, shares) == {"a": []}


def test_quantiles_of_odd_numbers(spark):
    data = [(float(x),) for x in ("nan", "inf", "-inf", "3", "1", "nan", "2")] + [(None,)]
    df = spark.createDataFrame(data, "x double")
    got = quantiles.values_at(df, {"x": F.col("x")}, {"x": range(7)})["x"]
    assert [got[i] for i in range(5)] == [-math.inf, 1, 2, 3, math.inf] and math.isnan(got[5]) and math.isnan(got[6])
