"""Mining, claims, validation and scoring on small fixtures with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from itemforge.config import MiningConfig
from itemforge.functions import text as tx
from itemforge.operators import claims, export, generate, ledger, mining, profiling, scoring, validation

F1 = ["bread,milk,eggs", "bread,butter", "milk,eggs,butter", "bread,milk,eggs", "bread,butter"]
F2 = ["bread,milk,eggs", "bread,butter,jam", "milk,eggs,cheese", "bread,milk,eggs,butter", "bread,eggs"]


def transactions(spark, rows, name="d"):
    return spark.createDataFrame([(name, i, r.split(",") if isinstance(r, str) else r) for i, r in enumerate(rows, 1)], "dataset_id string, row_no int, items array<string>")


def mined(spark, rows, ms=3, size=3, **k):
    out = mining.frequent_itemsets(mining.to_baskets(transactions(spark, rows)), MiningConfig(min_support=ms, max_size=size), evidence=True, **k)
    return {tuple(r.itemset): (r["count"], r.rows) for r in out.collect()}


@pytest.mark.parametrize("strategy", ["explode", "levels", "auto"])
def test_known_itemsets(spark, strategy):
    assert mined(spark, F1, strategy=strategy) == {("bread",): (4, [1, 2, 4, 5]), ("butter",): (3, [2, 3, 5]), ("eggs",): (3, [1, 3, 4]), ("milk",): (3, [1, 3, 4]), ("eggs", "milk"): (3, [1, 3, 4])}
    got = mined(spark, F2, 2, strategy=strategy)
    assert got[("bread", "eggs", "milk")] == (2, [1, 4]) and len(got) == 9


def test_canonical_and_boundaries(spark):
    got = mined(spark, [[" Milk", "milk", "BREAD "], ["bread", "Milk"], ["milk", "bread", ""]], 2)
    assert {k: v[0] for k, v in got.items()} == {("bread",): 3, ("milk",): 3, ("bread", "milk"): 3}
    assert mined(spark, [["a"], ["b"], ["c"]], 2) == {}
    assert mined(spark, F2, 2, 1).keys() == {("bread",), ("butter",), ("eggs",), ("milk",)}
    empty = spark.createDataFrame([], "dataset_id string, row_no int, items array<string>")
    assert mining.frequent_itemsets(mining.to_baskets(empty)).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_strategies_agree_with_enumeration(spark, seed):
    rng = random.Random(seed)
    rows = [[rng.choice("abcdefg") for _ in range(rng.randint(1, 6))] for _ in range(25)]
    want = {k: (len(v), v) for k, v in mining.python_itemsets(rows, 3, 4).items()}
    for strategy in ("explode", "levels"):
        assert mined(spark, rows, 3, 4, strategy=strategy) == want


def test_more_rows_never_lose_support(spark):
    once, twice = mined(spark, F2, 2), mined(spark, F2 + F2, 2)
    assert all(twice[k][0] == 2 * v[0] for k, v in once.items())


def test_thresholds_by_dataset(spark):
    t = transactions(spark, F2, "x").union(transactions(spark, F2, "y"))
    limits = spark.createDataFrame([("x", 4), ("y", 2)], "dataset_id string, min_support int")
    got = mining.frequent_itemsets(mining.to_baskets(t), thresholds=limits, strategy="explode").groupBy("dataset_id").count().collect()
    assert {r.dataset_id: r["count"] for r in got} == {"x": 2, "y": 9}


def test_label_order(spark):
    out = mining.rendered(mining.frequent_itemsets(mining.to_baskets(transactions(spark, ["a"] * 12)), evidence=True)).first()
    assert out.rows[1] == "Row 2" and out.unique_rows[:3] == ["Row 1", "Row 10", "Row 11"] and out.unique_row_count == 12


def test_rebase(spark):
    cases = [([0, 4], 50, 100, [51, 55]), ([1, 5], 50, 100, [51, 55]), ([51, 55], 50, 100, [51, 55]), ([0, 60], 50, 100, [0, 60]), ([0, 4], 0, 50, [1, 5]), ([1, 5], 5, 10, [6, 10]), ([2, 3], 40, 50, [42, 43])]
    df = spark.createDataFrame([([f"Row {x}" for x in a], s, e, [f"Row {x}" for x in w]) for a, s, e, w in cases], "r array<string>, s int, e int, w array<string>")
    for row in df.select(claims.rebased(F.col("r"), F.col("s"), F.col("e")).alias("g"), "w").collect():
        assert row.g == row.w
    odd = spark.createDataFrame([(["Row x", "Row 1"],)], "r array<string>").select(claims.rebased(F.col("r"), F.lit(50), F.lit(100)).alias("g")).first().g
    assert odd == ["Row x", "Row 51"]


@pytest.mark.parametrize("text, n, ok", [('[{"itemset":["a"],"count":3}]', 1, True), ('<think>x [1] y</think>\n[{"itemset":["a"]}]', 1, True), ('Here: [{"itemset":["a"]}] done', 1, True), ('[{"itemset":["a"', 0, False), ('{"itemset":["a"]}', 1, True), ("<think>[1]</think> none", 1, True), ("", 0, False), (None, 0, False)])
def test_json_repair(spark, text, n, ok):
    rows = claims.parse_claims(spark.createDataFrame([("d", text)], "dataset_id string, raw string"), "repair", ("dataset_id",)).collect()
    assert rows[0].parse_ok == ok and sum(r.claim_idx is not None for r in rows) == n


def test_labels_and_normal_records(spark):
    raw = '[{"items":["B"," a"],"count":2,"evidence_transactions":["row 3",3,"3","Row x",3.0]}, 5, {"itemset":[]}]'
    c = claims.parse_claims(spark.createDataFrame([("d", "m", raw)], "dataset_id string, model string, raw string"), "repair", ("dataset_id", "model"))
    got = [r.j for r in c.where(claims.is_object(F.col("rec"))).select(claims.normal_record(F.col("rec")).alias("j")).collect()]
    assert '"rows":["Row 3","Row 3","Row 3","Row x","3.0"]' in got[0] and '"itemset":["B"," a"]' in got[0]


def check(spark, claim, source="llm", ms=2):
    base = transactions(spark, F2)
    c = claims.parse_claims(spark.createDataFrame([("d", source, f"[{claim}]")], "dataset_id string, source string, raw string"), "chunk", ("dataset_id", "source")).drop("parse_ok")
    totals = spark.createDataFrame([("d", 5)], "dataset_id string, total_rows int")
    found = validation.errors(c, mining.to_baskets(base), totals, ms)
    return sorted(r.type for r in found.collect() if r.type != "llm_empty_output"), c, found


@pytest.mark.parametrize("claim, want", [
    ('{"itemset":["eggs","milk"],"count":3,"rows":["Row 1","Row 3","Row 4"]}', []),
    ('{"itemset":[],"count":3,"rows":[1]}', ["empty_itemset"]),
    ('{"itemset":["eggs"],"count":4}', ["missing_rows"]),
    ('{"itemset":["eggs"],"count":2,"rows":[1,3,4]}', ["count_mismatch"]),
    ('{"itemset":["bread","milk"],"count":3,"rows":[1,4,5]}', ["item_missing_in_row"]),
    ('{"itemset":["eggs"],"count":1,"rows":[1]}', ["below_min_support"]),
    ('{"itemset":["eggs"],"count":2,"rows":[1,9]}', ["row_out_of_range"]),
    ('{"itemset":["eggs"],"count":3,"rows":[1,1,3]}', ["count_mismatch", "duplicate_rows_listed"]),
    ('{"itemset":["eggs"],"count":null,"rows":[1,3]}', ["missing_count"]),
    ('{"itemset":["eggs"],"count":2,"rows":["1","Row x"]}', ["count_mismatch", "duplicate_rows_listed", "malformed_row_label"]),
    ('{"itemset":["eggs"],"count":"2","rows":[1,3]}', ["count_mismatch"]),
])
def test_rules(spark, claim, want):
    assert check(spark, claim)[0] == want


def test_support_rules(spark):
    base = '{"itemset":["milk"],"count":3,"rows":[1,3,4],"support":%s}'
    assert check(spark, base % "0.6", "apriori")[0] == [] and check(spark, base % "0.5", "apriori")[0] == ["support_mismatch"] and check(spark, base % '"0.6"', "apriori")[0] == ["invalid_support_type"]


def test_equal_itemsets_share_fate_and_empty_output_fails(spark):
    good = '{"itemset":["eggs"],"count":2,"rows":[1,3]}'
    _, c, found = check(spark, good + ',{"itemset":["eggs"],"count":5,"rows":[1,3]}')
    r = validation.report(c, found).first()
    assert (r.total_itemsets, r.validated_itemsets) == (2, 0)
    _, c, _ = check(spark, good, "apriori")
    assert [r.type for r in validation.empty_output(c).collect()] == ["llm_empty_output"]


def test_scores(spark):
    kind = "dataset_id string, itemset array<string>, count int"
    truth = spark.createDataFrame([("d", list(k), len(v)) for k, v in mining.python_itemsets([r.split(",") for r in F2], 2, 3).items()], kind)
    said = spark.createDataFrame([("d", ["bread"], 4), ("d", ["eggs"], 4), ("d", ["milk"], 4), ("d", ["bread", "eggs"], 1), ("d", ["jam", "tea"], 2)], kind)
    vocabulary = mining.to_baskets(transactions(spark, F2)).select("dataset_id", "item").distinct()
    m = scoring.metrics(truth, said, vocabulary).first()
    assert (m.tp, m.fp, m.fn) == (4, 1, 5) and round(m.f1, 4) == 0.5714 and m.count_accuracy == 0.75 and m.ungrounded_rate == 0.2 and not m.exact
    sizes = {r["size"]: (r.n_truth, r.n_claims, r.tp) for r in scoring.by_size(truth, said).collect()}
    assert sizes == {1: (4, 3, 3), 2: (4, 2, 1), 3: (1, 0, 0)}


def test_text_functions(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first().x

    assert one(tx.item_canon(F.lit("  Ab\t"))) == "ab" and one(tx.row_index(F.lit("row 7"))) == 7 and one(tx.row_index(F.lit("x"))) is None
    assert one(tx.safe_ratio(F.lit(1), F.lit(0))) == 0 and one(tx.after_think(F.lit("a</think>b</think>c"))) == "b</think>c"
    assert one(tx.close_trace(F.lit("FREQUENT a\nloose"))) == "FREQUENT a\n</think>\n" and one(tx.is_looping(F.lit("a\nb\nc\nd\nd\nd"))) and not one(tx.is_looping(F.lit("d\nd\nd")))
    assert one(profiling.parse_ranking(F.lit("x Response C\nFINAL RANKING:\n1. Response B\n2. Response A"))) == ["Response B", "Response A"]


def test_reasoning_text(spark):
    items = mining.frequent_itemsets(mining.to_baskets(transactions(spark, F1)), evidence=True)
    shapes = spark.createDataFrame([("d", 5, 3, 3)], "dataset_id string, n_rows int, n_cols int, min_support int")
    cot = export.reasoning(items, shapes).first().cot
    assert cot == (
        "Dataset: 5 rows, 3 cols. min_support=3.\n\nSINGLES SCAN:\n  bread=4(R1, R2, R4, R5)✓\n  butter=3(R2, R3, R5)✓\n  eggs=3(R1, R3, R4)✓\n  milk=3(R1, R3, R4)✓\n\n"
        "FREQUENT SINGLES [4]: bread, butter, eggs, milk\n\nPAIRS SCAN:\n  (eggs,milk)=3(R1, R3, R4)✓\n\nFREQUENT PAIRS [1]: {eggs,milk}\n\nTRIPLES: none meet threshold\n\nRESULT SUMMARY: 4 singles + 1 pairs + 0 triples = 5 frequent itemsets"
    )
    assert "Found 5 frequent itemsets total." in export.legacy_reasoning(items, shapes).first().cot


def test_ledger_round_trip(spark, tmp_path):
    datasets = spark.createDataFrame([("d", "d.csv", "h", 5, 9)], "dataset_id string, dataset_name string, dataset_hash string, dataset_size_rows long, dataset_size_bytes long")
    _, c, found = check(spark, '{"itemset":["eggs"],"count":2,"rows":[1,3]}')
    for _ in range(2):  # two runs
        ledger.append_runs(ledger.run_summary(datasets, c, c, validation.report(c, found), {"llm_model": "m", "min_support": 2}), str(tmp_path / "runs"))
    back = ledger.read_runs(spark, str(tmp_path / "runs"))
    assert back.count() == 2 and back.first().validation_passed
    ledger.delete_run(spark, str(tmp_path / "runs"), str(tmp_path / "less"), back.first().id)
    assert ledger.read_runs(spark, str(tmp_path / "less")).count() == 1


def test_variations(spark):
    t = transactions(spark, [f"a:{i},b:{i % 3},c:x" for i in range(40)])
    assert generate.row_subsample(t, 10).count() == 10 and generate.col_subsample(t, 2).agg(F.max(F.size("items"))).first()[0] == 2
    for kind, _ in generate.VARIATIONS:
        out = generate.vary(t, kind, 12, 2)
        rows = sorted(r.row_no for r in out.collect())
        assert rows == list(range(1, len(rows) + 1)) and sorted(map(str, out.collect())) == sorted(map(str, generate.vary(t, kind, 12, 2).collect()))
    assert generate.topped_up(t.where("row_no <= 2"), 6).count() == 6
