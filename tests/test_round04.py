"""Findings of round 4: claims checked in little memory."""

from __future__ import annotations

from itemforge.operators import validation


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_checks_read_short_rows_and_not_texts(spark, monkeypatch):
    """Claims hold long lists, so these are taken apart in one pass; what is shuffled and read again are rows of one label each."""
    from itemforge.plans import scoring_queries

    monkeypatch.setattr(scoring_queries, "CLAIM_ROWS", 200)
    data = "/root/testdata/sf0.001"
    b, c, totals = scoring_queries._claims_of_brands(spark, data)
    for df in (validation.errors(c, b, totals, 8), scoring_queries.validation_report(spark, data)):
        assert "variant" not in plan(df) and "first(" not in plan(df)


def test_anti_join_once_for_a_report(spark):
    """A report counts errors by itemset once, whatever it tells of them."""
    from itemforge.plans import scoring_queries

    assert plan(scoring_queries.validation_report(spark, "/root/testdata/sf0.001")).count("Join LeftAnti") == 1


def claims_of(spark, *texts):
    rows = spark.createDataFrame([("d", "llm", i, t) for i, t in texts], "dataset_id string, source string, claim_idx int, t string")
    return rows.selectExpr("dataset_id", "source", "claim_idx", "parse_json(t) AS rec")


def test_every_kind_of_label_and_claim(spark):
    c = claims_of(
        spark,
        (0, '{"itemset": ["A", " a "], "count": 2, "rows": ["Row 1", 2, "Row 2", "Row x", null, 9, "Row 0"]}'),
        (1, '{"itemset": ["a"], "count": 1, "rows": []}'),
        (2, '{"itemset": [], "count": 1, "rows": ["Row 1"]}'),
        (3, '{"itemset": ["b"], "count": 1, "rows": ["Row 1"]}'),
        (3, '{"itemset": ["b"], "count": 2, "rows": ["Row 2", "Row 3"]}'),
        (4, '{"itemset": [" "], "rows": ["Row 3"]}'),
        (5, "7"),
    )
    b = spark.createDataFrame([("d", 1, "a"), ("d", 1, "b"), ("d", 2, "b"), ("d", 3, "b")], "dataset_id string, row_no int, item string")
    totals = spark.createDataFrame([("d", 3)], "dataset_id string, total_rows int")
    found = validation.errors(c, b, totals, 1)
    got = sorted((r.claim_idx, r.type, r.row_label or "", r.detail or "") for r in found.collect())
    assert got == sorted([
        (0, "malformed_row_label", "Row x", ""), (0, "malformed_row_label", "None", ""), (0, "row_out_of_range", "Row 9", "3"), (0, "row_out_of_range", "Row 0", "3"),
        (0, "count_mismatch", "", "4"), (0, "duplicate_rows_listed", "", "4"), (0, "item_missing_in_row", "Row 2", '["a","a"]'),
        (1, "missing_rows", "", ""), (2, "empty_itemset", "", ""), (4, "missing_count", "", ""), (5, "empty_itemset", "", ""),
    ])
    r = validation.report(c, found).first()
    assert (r.total_itemsets, r.validated_itemsets, r.errors) == (6, 1, 11)
    checked = validation.listed_rows(c, totals)
    assert validation.report(checked, validation.errors_of_rows(checked, b, 1)).first() == r


def test_parts_with_other_items_are_judged_alone(spark):
    """1 and 1.0 have one JSON text but are two items, so a row of one says nothing of the other."""
    c = claims_of(spark, (0, '{"itemset": [1], "count": 1, "rows": [1]}'), (0, '{"itemset": [1.0], "count": 1, "rows": [1]}'))
    b = spark.createDataFrame([("d", 1, "1"), ("d", 1, "1.0")], "dataset_id string, row_no int, item string")
    totals = spark.createDataFrame([("d", 2)], "dataset_id string, total_rows int")
    assert validation.errors(c, b, totals, 1).collect() == []
