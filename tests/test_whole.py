"""Registered queries over all rows of their tables, where they once took a part."""

from collections import Counter

import duckdb
import pytest

from itemforge import catalog
from tests.test_queries import TABLES, rows

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def matches(spark, duck, name, sql, some=True):
    df = catalog.queries()[name](spark, DATA)
    q = duck.execute(sql)
    names = [d[0] for d in q.description]
    assert sorted(names) == sorted(df.columns)
    want = rows(names, q.fetchall())
    assert bool(want) == some and rows(df.columns, df.collect()) == want


def baskets(spark, d, supports, first=0):
    """Tables of one part for each brand, with a brand in so many orders."""
    parts = [(i, b) for i, b in enumerate(supports)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string").write.parquet(f"{d}/part.parquet")
    lines = [(first + k, i) for i, b in parts for k in range(supports[b])]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{d}/lineitem.parquet")


@pytest.mark.parametrize("folder", ["sf0.01", "other"])
def test_candidate_pairs_by_any_path(spark, tmp_path, folder):
    d = str(tmp_path / folder)
    baskets(spark, d, {"A": 100, "B": 60, "C": 59, "D": 700})
    assert sorted(r.itemset for r in catalog.queries()["candidate_pairs"](spark, d).collect()) == ["a|b", "a|d", "b|d"]


@pytest.mark.parametrize("name", ["itemset_evidence", "rendered_rows", "row_text_parse"])
def test_sources_whole(spark, duck, name):
    matches(spark, duck, name, catalog.oracle_sql()[name])


def test_set_ops_beyond_first_rows(spark, tmp_path):
    d = str(tmp_path / "t")
    baskets(spark, d, {"A": 2, "B": 1}, first=5000)
    got = sorted(tuple(r) for r in catalog.queries()["set_ops"](spark, d).collect())
    assert got == [("any", "a"), ("any", "b"), ("both", "a"), ("even only", "b")]


@pytest.mark.parametrize("name", ["claim_validation", "validation_report"])
def test_claims_whole(spark, duck, name):
    matches(spark, duck, name, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", ["chunk_merge", "json_extraction", "reward_scores", "format_gate", "itemset_differences", "ungrounded_claims", "failure_triage"])
def test_scoring_whole(spark, duck, name):
    matches(spark, duck, name, catalog.oracle_sql()[name], some=name != "failure_triage")


def test_claims_of_all_rows(spark):
    from itemforge.plans import scoring_queries

    b, c, totals = scoring_queries._claims_of_brands(spark, DATA)
    assert totals.first().total_rows == spark.read.parquet(f"{DATA}/orders.parquet").count()
    listed = c.selectExpr("size(try_variant_get(rec, '$.evidence_rows', 'array<variant>')) AS n").selectExpr("sum(n) AS n").first().n
    assert listed == b.where("row_no % 2 = 0").count() + 2 * c.count()


@pytest.mark.parametrize("name", ["noise_rows", "wide_rows", "csv_hash", "topped_up", "dataset_text", "ground_truth_json", "ordered_itemsets"])
def test_records_whole(spark, duck, name):
    matches(spark, duck, name, catalog.oracle_sql()[name])


def test_ordered_itemsets_in_order(spark, duck):
    got = [(r["size"], r["itemset"], r["count"]) for r in catalog.queries()["ordered_itemsets"](spark, DATA).collect()]
    assert len(got) == 325 and got == sorted(got, key=lambda r: (r[0], -r[2], r[1].replace("|", ",")))


def test_training_records_of_all_rows(spark, duck):
    rows_of = dict(duck.execute("SELECT o_orderpriority, count(*) FROM orders GROUP BY ALL").fetchall())
    text = {r.dataset_id: r.cot for r in catalog.queries()["reasoning_text"](spark, DATA).collect()}
    assert text.keys() == rows_of.keys() and all(text[k].startswith(f"Dataset: {n} rows,") for k, n in rows_of.items())


def test_sft_records_take_whole_data_sets_or_none(spark, tmp_path):
    d = str(tmp_path / "t")
    orders = [(1000 + i, "LOW", 1, "F") for i in range(30)] + [(5000 + i, "HIGH", 1, "F") for i in range(3000)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderpriority string, o_custkey long, o_orderstatus string").write.parquet(f"{d}/orders.parquet")
    got = catalog.queries()["sft_records"](spark, d).collect()
    assert [(r.dataset_id, r.n_itemsets) for r in got] == [("LOW", 1)]


def test_noise_draws_without_vocabulary_for_each_row(spark):
    from itemforge.operators import generate

    x = spark.createDataFrame([("d", i, [f"a:{i}", f"b:{i % 3}"]) for i in range(200)], "dataset_id string, row_no long, items array<string>")
    before, after = (Counter(tuple(r["items"]) for r in df.collect()) for df in (x, generate.add_noise(x, 0.5)))
    words = {v for row in before for v in row}
    noise = list((after - before).elements())
    assert not before - after and len(noise) == 100
    assert all(2 <= len(v) <= 5 and len(set(v)) == len(v) and set(v) <= words for v in noise)
    assert {len(v) for v in noise} == {2, 3, 4, 5} and len({w for v in noise for w in v}) > 100


@pytest.mark.parametrize("name", ["think_split", "text_signature", "diversity_report", "top_prefixes"])
def test_texts_whole(spark, duck, name):
    matches(spark, duck, name, catalog.oracle_sql()[name])


def test_tags_and_prefixes_past_the_start(spark, tmp_path):
    d, long = str(tmp_path / "t"), "word " * 10
    talk = [(1, 0, f"{long}\nmore</think> said"), (2, 1, f"{long}\nmore")]
    spark.createDataFrame(talk, "conv_id long, turn int, text string").write.parquet(f"{d}/conversations.parquet")
    got = {r.conv_id: (r.first, r.last, r.think) for r in catalog.queries()["think_split"](spark, d).collect()}
    assert got == {1: (" said", " said", f"{long}\nmore"), 2: (" answer</think> end", " end", f"{long}\nmore")}
    texts = [(1, f"{long}one"), (2, f"{long}two"), (3, f"{long * 3}one"), (4, f"{long * 3}two")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    assert catalog.queries()["diversity_report"](spark, d).first().unique_prefix_rate == 0.75
    assert len(catalog.queries()["top_prefixes"](spark, d).collect()) == 3
    assert catalog.queries()["text_signature"](spark, d).select("prefix").distinct().count() == 3


def test_queries_hold_no_filter_on_ids():
    import re

    for name, sql in catalog.oracle_sql().items():
        assert not re.search(r"(orderkey|partkey|row_no|custkey|doc_id) (<|<=|BETWEEN) \d", sql), name
