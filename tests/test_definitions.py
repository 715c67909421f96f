"""Cases that tell the definitions of scores, reports and claims apart from similar ones."""

from pyspark.sql import functions as F

from itemforge.functions.text import prefix_signature
from itemforge.operators import claims, generate, profiling, scoring, validation


def itemsets(spark, *rows):
    return spark.createDataFrame(rows, "dataset_id string, itemset array<string>, count long")


def test_items_with_the_mark_are_not_two_items(spark):
    truth, said = itemsets(spark, ("d", ["a|b"], 3)), itemsets(spark, ("d", ["a", "b"], 3))
    r = scoring.confusion(truth, said).first()
    assert (r.tp, r.fp, r.fn) == (0, 1, 1)
    assert scoring.count_accuracy(truth, said).count() == 0 and scoring.by_size(truth, said).agg(F.sum("tp")).first()[0] == 0
    reward = spark.createDataFrame([('[{"itemset": ["a", "b"], "count": 3}]', '[{"itemset": ["a|b"], "count": 3}]')], "t string, g string")
    assert reward.select(scoring.f1_reward(F.col("t"), F.col("g")).alias("f"), scoring.count_reward(F.col("t"), F.col("g")).alias("c")).first().asDict() == {"f": 0.0, "c": 0.0}


def test_collapse_counts_every_repeated_prefix(spark):
    texts = spark.createDataFrame([(t,) for t in ["aa", "AA ", "aa", "bb", "bb", "cc", "  ", None]], "text string")
    r = profiling.diversity(texts).first()
    assert (r.total_texts, r.template_collapse_rate, r.duplicate_full_text_count, r.most_common_prefix_count) == (6, 0.8333, 3, 3)
    assert (r.avg_chars, r.min_chars, r.max_chars, r.unique_full_text_rate, r.most_common_prefix_rate) == (2.2, 2, 3, 0.5, 0.5)
    none = profiling.diversity(texts.where("text = 'x'")).first()
    assert none.total_texts == 0 and none.unique_prefix_rate == 0 and none.duplicate_full_text_count == 0
    long = spark.createDataFrame([("İ" * 130,)], "t string").select(prefix_signature(F.col("t")).alias("p")).first().p
    assert len(long) == 120


def test_size_classes(spark):
    log = spark.createDataFrame([(f"d{n}", n, 2, 5, "h" * 8) for n in (5, 10, 11, 18, 19)], "dataset_id string, num_transactions long, actual_cols long, unique_items long, hash string")
    r = generate.generation_statistics(log).first()
    assert (r.small, r.medium, r.large, r.min_rows, r.max_cols, r.median_items) == (2, 2, 1, 5, 2, 5)
    assert [(x.num_transactions, x.share) for x in generate.shares(log.unionByName(log.where("num_transactions = 5")), "num_transactions").collect()][0] == (5, 2 / 6)
    names = {x.dataset_idx: x.filename for x in generate.dataset_names(log, 3).collect()}
    assert sorted(names) == [4, 5, 6, 7, 8] and names[4] == "ds_0004_10x2_hhhhhhhh.csv"


def test_scored_claims(spark):
    text = '[{"itemset": [" B ", "a"], "count": 2.5, "rows": [3, "Row 4x", "5", " 6 ", "seven", 8.9, null, "row 9"]}, {"itemset": ["c"], "count": 1, "evidence_rows": [1]}, {"itemset": [], "count": 1}, 7]'
    raw = spark.createDataFrame([("d", text)], "dataset_id string, raw string")
    got = claims.scoring_claims(claims.parse_claims(raw, "repair", ("dataset_id",)), ["dataset_id"]).orderBy("claim_idx").collect()
    assert [(r.itemset, r["count"], r.rows) for r in got] == [(["a", "b"], 0, ["Row 3", "Row 4x", "Row 5", "Row 6", "Row 8"]), (["c"], 1, [])]


def test_rows_that_are_no_list(spark):
    recs = ['{"itemset": ["a"], "count": 1, "rows": "Row 1", "evidence_rows": ["Row 1"]}', '{"itemset": ["a"], "count": 1, "rows": [], "evidence_rows": ["Row 1"]}', '{"itemset": ["a"], "count": 1, "rows": 0, "evidence_rows": ["Row 1"]}', '{"itemset": ["a"], "count": 1, "rows": {"x": 1}}']
    c = spark.createDataFrame([("d", "llm", i, r) for i, r in enumerate(recs)], "dataset_id string, source string, claim_idx int, r string").withColumn("rec", F.parse_json("r")).drop("r")
    baskets = spark.createDataFrame([("d", 1, "a")], "dataset_id string, row_no int, item string")
    totals = spark.createDataFrame([("d", 1)], "dataset_id string, total_rows int")
    assert sorted((r.claim_idx, r.type) for r in validation.errors(c, baskets, totals, 1).collect()) == [(0, "missing_rows"), (3, "missing_rows")]


def test_every_error_of_a_claim(spark):
    recs = [
        ("llm", '{"itemset": ["a", "b"], "count": 2, "rows": ["Row 1", "Row 2"]}'), ("llm", '{"itemset": ["a"], "rows": ["Row 1", "1", "Row x", "Row 9"]}'),
        ("apriori", '{"itemset": ["a"], "count": 2, "rows": ["Row 1", "Row 2"], "support": 0.9}'), ("apriori", '{"itemset": ["a"], "count": 2, "rows": ["Row 1", "Row 2"], "support": "x"}'), ("apriori", '{"itemset": [], "rows": [1]}'),
    ]
    c = spark.createDataFrame([("d", s, i, r) for i, (s, r) in enumerate(recs)], "dataset_id string, source string, claim_idx int, r string").withColumn("rec", F.parse_json("r")).drop("r")
    baskets = spark.createDataFrame([("d", 1, "a"), ("d", 2, "a"), ("d", 1, "b")], "dataset_id string, row_no int, item string")
    totals = spark.createDataFrame([("d", 2)], "dataset_id string, total_rows int")
    found = validation.errors(c, baskets, totals, 3)
    kinds = sorted((r.claim_idx, r.type) for r in found.collect())
    assert kinds == [(0, "below_min_support"), (0, "item_missing_in_row"), (1, "duplicate_rows_listed"), (1, "malformed_row_label"), (1, "missing_count"), (1, "row_out_of_range"), (2, "below_min_support"), (2, "support_mismatch"), (3, "below_min_support"), (3, "invalid_support_type"), (4, "empty_itemset")]
    valid = spark.createDataFrame([("d", "llm", 0, '{"itemset": ["a"], "count": 2, "rows": ["Row 1", "Row 2"]}'), ("d", "llm", 1, '{"itemset": ["b"], "count": 2, "rows": ["Row 1", "Row 2"]}')], "dataset_id string, source string, claim_idx int, r string").withColumn("rec", F.parse_json("r")).drop("r")
    r = validation.report(valid, validation.errors(valid, baskets, totals, 2)).first()
    assert (r.total_itemsets, r.validated_itemsets, r.errors, r.valid_ratio) == (2, 1, 1, 0.5)


def test_one_join_gives_what_two_give(spark):
    truth = itemsets(spark, ("d", ["a"], 3), ("d", ["b"], 4), ("d", ["c", "a"], 3), ("e", ["x"], 3), ("g", ["y"], 2))
    said = itemsets(spark, ("d", ["a"], 4), ("d", ["A "], 9), ("d", ["a", "c"], 3), ("d", ["z"], 3), ("e", ["x"], 7), ("f", ["q"], 1), ("g", ["y"], None))
    got = {r.dataset_id: r.asDict() for r in scoring.compared(truth, said).collect()}
    for r in scoring.confusion(truth, said).collect():
        assert all(got[r.dataset_id][k] == r[k] for k in ("tp", "fp", "fn"))
    for r in scoring.count_accuracy(truth, said).collect():
        assert all(got[r.dataset_id][k] == r[k] for k in ("correct_counts", "matched_claims", "count_accuracy"))
    assert got["f"]["matched_claims"] == 0 and got["f"]["count_accuracy"] == 0 and got["d"]["correct_counts"] == 2
