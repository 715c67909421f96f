"""Evidence as bitmaps and containment by the rarest item, against plain enumeration."""

import random

import pytest
from pyspark.sql import functions as F

from itemforge.config import MiningConfig
from itemforge.operators import evidence, mining

STEP = 9973  # rows lie in many buckets of 32,768


def baskets(spark, seed=3, n=160):
    """Rows of two data sets, as plain lists and as baskets; row numbers reach over many buckets, 0 and below."""
    r = random.Random(seed)
    plain = {d: {(i - 3) * STEP: sorted(r.sample("abcdefghij", r.randrange(1, 7))) for i in range(n)} for d in ("x", "y")}
    rows = [(d, i, item) for d, m in plain.items() for i, items in m.items() for item in items]
    return plain, spark.createDataFrame(rows, "dataset_id string, row_no long, item string").repartition(4)


@pytest.mark.parametrize("strategy", ["explode", "levels", "auto"])
def test_cells_and_rows_of_frequent_itemsets(spark, strategy):
    plain, b = baskets(spark)
    config = MiningConfig(min_support=12, max_size=4)
    found = mining.frequent_cells(b, config, strategy)
    cells = found.collect()
    want = {(d, s): rows for d, m in plain.items() for s, rows in wanted(m, 12, 4).items()}
    got: dict = {}
    for c in cells:
        assert len(c.bitmap) == 4096 and c.n == sum(x.bit_count() for x in c.bitmap) > 0
        got[c.dataset_id, tuple(c.itemset)] = got.get((c.dataset_id, tuple(c.itemset)), 0) + c.n
    assert got == {k: len(v) for k, v in want.items()} and len({c.bucket for c in cells}) > 40
    assert {(r.dataset_id, tuple(r.itemset)): r["count"] for r in evidence.support(found).collect()} == got
    long: dict = {}
    for r in evidence.rows(found).collect():
        long.setdefault((r.dataset_id, tuple(r.itemset)), []).append(r.row_no)
    assert {k: sorted(v) for k, v in long.items()} == want
    listed = mining.frequent_itemsets(b, config, evidence=True, strategy=strategy)
    assert {(r.dataset_id, tuple(r.itemset)): (r["count"], r["rows"], r["size"]) for r in listed.collect()} == {k: (len(v), v, len(k[1])) for k, v in want.items()}


def wanted(rows, least, most):
    from itertools import combinations

    out: dict = {}
    for i, items in sorted(rows.items()):
        for k in range(1, most + 1):
            for c in combinations(items, k):
                out.setdefault(c, []).append(i)
    return {k: v for k, v in out.items() if len(v) >= least}


def test_cells_of_later_rows_are_put_together(spark):
    _, b = baskets(spark)
    sets = spark.createDataFrame([("x", ["a", "b"]), ("y", ["c"]), ("x", ["a", "zz"]), ("z", ["a"]), ("x", [])], "dataset_id string, itemset array<string>")
    early, late = (b.where(F.col("row_no").bitwiseAND(1) == k) for k in (0, 1))
    whole = {(r.dataset_id, *r.itemset, r.bucket): (bytes(r.bitmap), r.n) for r in evidence.cells(b, sets).collect()}
    both = {(r.dataset_id, *r.itemset, r.bucket): (bytes(r.bitmap), r.n) for r in evidence.merged(evidence.cells(early, sets), evidence.cells(late, sets)).collect()}
    assert whole == both and {k[:-1] for k in whole} == {("x", "a", "b"), ("y", "c")}


def test_mining_holds_no_row_lists(spark):
    """Neither supports nor cells collect rows: the plans have no list of row numbers."""
    _, b = baskets(spark)
    for df in (mining.frequent_itemsets(b, strategy="levels"), mining.frequent_cells(b, strategy="explode")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list(row_no" not in plan


def test_the_source_runs_once(spark, tmp_path):
    """Baskets are packed once, whatever reads them: the dictionary, the cost and the result."""
    _, b = baskets(spark)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for x in batches:
            seen.add(x.num_rows)
            yield x

    out = mining.frequent_itemsets(b.mapInArrow(count, b.schema), MiningConfig(min_support=5))
    assert out.count() > 50 and seen.value == b.count()


def test_containment_of_many_sets(spark):
    plain, b = baskets(spark)
    r = random.Random(8)
    sets = [(d, r.sample("abcdefghijz", r.randrange(1, 6))) for d in ("x", "y", "none") for _ in range(1500)] + [("x", ["a", "a"]), ("x", [])]
    want = {}
    for d, s in sets:
        rows = [i for i, items in sorted(plain.get(d, {}).items()) if set(s) <= set(items)]
        if rows and s:
            want[d, tuple(s)] = rows
    df = spark.createDataFrame(sets, "dataset_id string, itemset array<string>")
    out = mining.containment(df, b)
    assert {(x.dataset_id, tuple(x.itemset)): x["count"] for x in out.collect()} == {k: len(v) for k, v in want.items()}
    rows = {(x.dataset_id, tuple(x.itemset)): x["rows"] for x in mining.containment(df, b, evidence=True).collect()}
    assert rows == want
