"""Directories of data sets, numbering, writers, reports, logs and the smaller functions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from itemforge.operators import claims, export, ledger, mining, profiling, ranking, scoring, validation
from itemforge.sources import readers, sinks
from itemforge.streaming import support
from tests.test_sources import put


def test_directory_of_all_shapes(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    put(d, "wide.csv", 'a,b,c\n"milk, whole",bread,\n,,\nNA,"eggs ""L""", None \n')
    put(d, "long.CSV", "TID;Item\n10;milk\n2;bread\n2;eggs\n;x\n3; \n")
    put(d, "single.csv", "basket\nmilk bread\nmilk;eggs\n")
    put(d, "bad.csv", "x,y\n1,2\n1,2,3\n4,5\n")
    put(d, "empty.csv", "")
    put(d, "notes.txt", "a,b\n1,2\n")
    got = {}
    for r in readers.read_directory(spark, str(d)).collect():
        got.setdefault(r.dataset_id, {})[r.row_no] = r["items"]
    assert got == {
        "wide.csv": {1: ["milk, whole", "bread"], 2: ['eggs "L"']}, "long.CSV": {1: ["bread", "eggs"], 2: [], 3: ["milk"]},
        "single.csv": {1: ["milk", "bread"], 2: ["milk", "eggs"]}, "bad.csv": {1: ["1", "2"], 2: ["4", "5"]},
    }
    kinds = {(r.dataset_id, r.shape, r.read) for r in readers.read_directory(spark, str(d)).select("dataset_id", "shape", "read").distinct().collect()}
    assert kinds == {("wide.csv", "wide", "strict"), ("long.CSV", "long", "strict"), ("single.csv", "single", "strict"), ("bad.csv", "wide", "skip")}
    e = {r.dataset_id: r for r in readers.evaluation_sets(spark, str(d)).collect()}
    assert e["wide.csv"].n_rows == 3 and e["wide.csv"].n_cols == 2 and e["wide.csv"].text.split("\n")[1:] == ["Row 2: ", 'Row 3: eggs "L"']
    n = {r.dataset_name: r.dataset_size_rows for r in readers.with_row_counts(readers.fingerprints(spark, str(d)), readers.read_directory(spark, str(d))).collect()}
    assert n == {"wide.csv": 2, "single.csv": 2, "bad.csv": 2}  # a file without a byte is no data set


@pytest.mark.parametrize("rows_a_range", [3, 700])
def test_numbers_without_one_window(spark, tmp_path, rows_a_range, monkeypatch):
    monkeypatch.setattr(ranking, "RANGE_ROWS", rows_a_range)
    r = random.Random(2)
    rows = [(None if i % 50 == 0 else r.randrange(40), f"{i:05d}", r.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, s string, v double").repartition(7)
    got = sorted((x.row_no, x.k, x.s) for x in readers.in_order(df, [F.col("k"), F.col("s")]).collect())
    want = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert [(k, s) for _, k, s in got] == [(k, s) for k, s, _ in want] and [n for n, _, _ in got] == list(range(1, 3001))
    assert readers.in_order(df.where("false"), [F.col("k")]).count() == 0
    path = str(tmp_path / "rows.txt")
    (tmp_path / "rows.txt").write_text("\n".join(f"line {i}" for i in range(5000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        lines = spark.read.text(path)
        assert lines.rdd.getNumPartitions() > 3
        out = readers.in_file_order(lines.where("value NOT LIKE '%7'")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    kept = [f"line {i}" for i in range(5000) if i % 10 != 7]
    assert sorted((x.row_no, x.value) for x in out) == list(enumerate(kept, 1))
    monkeypatch.setattr(profiling, "ROLLING", 11)
    one = df.where("k IS NOT NULL")
    for width in (1, 6, 7):
        got = {x.s: x.smooth for x in profiling.rolling_mean(one, "v", ["k", "s"], width).collect()}
        order = sorted((x for x in rows if x[0] is not None), key=lambda x: x[:2])
        for i, (_, s, _) in enumerate(order):
            part = [x[2] for x in order[max(0, i - width // 2) : i + (width - 1) // 2 + 1]]
            assert abs(got[s] - sum(part) / len(part)) < 1e-9


def test_mining_with_and_without_a_dictionary(spark, monkeypatch):
    r = random.Random(3)
    rows = [(f"d{i % 2}", i, f"item{r.randrange(9)}|x") for i in range(60) for _ in range(5)]
    b = spark.createDataFrame(sorted(set(rows)), "dataset_id string, row_no long, item string")
    by = {}
    for d, i, x in sorted(set(rows)):
        by.setdefault(d, {}).setdefault(i, []).append(x)
    want = {(d, k): v for d, t in by.items() for k, v in mining.python_itemsets(list(t.values()), 3, 4).items()}
    for size in (3, 4):
        for few in (100_000, 2):
            monkeypatch.setattr(mining, "DICTIONARY", few)
            for strategy in ("explode", "levels", "auto"):
                out = mining.frequent_itemsets(b, mining.MiningConfig(max_size=size), evidence=True, strategy=strategy).collect()
                assert {(x.dataset_id, tuple(x.itemset)): (x["count"], x["size"], len(x.rows)) for x in out} == {(d, k): (len(v), len(k), len(v)) for (d, k), v in want.items() if len(k) <= size}


def runs(spark, n=30):
    rows = [(f"set{i:02d}.csv", float(i * i + 1), i % 7 + 1, i % 5, "m", f"{i:012d}", json.dumps([i])) for i in range(n)]
    df = spark.createDataFrame(rows, "dataset_name string, dataset_area double, apriori_itemset_count long, llm_itemset_count long, llm_model string, dataset_hash string, payload string")
    return ledger.with_derived(df)


def test_artifacts_by_name(spark, tmp_path):
    path = str(tmp_path / "a")
    r = runs(spark, 3)
    sinks.write_named(r, path, "extractor_output")
    sinks.write_named(r.where("dataset_name = 'set01.csv'").withColumn("payload", F.lit("[9]")), path, "extractor_output")
    back = {x.artifact: x.value for x in spark.read.text(path).collect()}
    assert back == {"m_extractor_output_set00_000000000000.json": "[0]", "m_extractor_output_set01_000000000001.json": "[9]", "m_extractor_output_set02_000000000002.json": "[2]"}
    sinks.write_named(r, path, "extractor_output", "timestamp", "20260101000000")
    assert spark.read.text(path).count() == 6
    with pytest.raises(ValueError):
        sinks.write_named(r, path, "x", "append")
    assert json.loads(sinks.as_json(r.select("dataset_name")).first().json) == {"dataset_name": "set00.csv"}


def test_logs(spark, tmp_path):
    r = runs(spark, 5)
    log = sinks.timed(r, "mining", lambda df: df.write.parquet(str(tmp_path / "x"))).first()
    assert log.stage == "mining" and log.rows == 5 and log.stage_duration_ms >= 0 and log.logged_at is not None
    assert {x.llm_model: x.rows for x in sinks.stage_log(r, "s", ("llm_model",)).collect()} == {"m": 5}
    found = spark.createDataFrame([("d", "llm", i, "[]", "t", None, None) for i in range(5)], "dataset_id string, source string, claim_idx int, raw_itemset string, type string, row_label string, detail string")
    reported = spark.createDataFrame([("d", "llm", 5), ("d", "apriori", 0)], "dataset_id string, source string, errors long")
    got = {x.source: (x.errors, x.error_sample and [e.claim_idx for e in x.error_sample]) for x in sinks.validation_log(found, reported).collect()}
    assert got == {"llm": (5, [0, 1, 2]), "apriori": (0, None)}


def test_charts_and_reports(spark, tmp_path):
    charts = profiling.chart_inputs(runs(spark), [0, 100, 1000])
    assert [x.dataset_name for x in charts["grouped_counts"].collect()][:2] == ["set29.csv", "set28.csv"]
    assert sum(x.rows for x in charts["diff_bins"].collect()) == 30 and charts["percent_match_trend"].count() == 30
    sinks.summary_table(charts["summary"], str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), header=True).where("size_bin = '(0.0, 100.0]'").count() == 10
    assert profiling.window_width(100) == 10 and profiling.window_width(2) == 3
    summary = spark.createDataFrame([(3, 0.9, 0.95, 0.01)], "datasets long, avg_f1 double, json_parse_rate double, avg_ungrounded_rate double")
    assert scoring.accepted(summary).first().passed and not scoring.accepted(summary.withColumn("avg_f1", F.lit(0.5))).first().passed
    sizes = spark.createDataFrame([(1, 3, 0.5, 0.5, 0.5)], "size int, datasets long, precision double, recall double, f1 double")
    failures = spark.createDataFrame([("d", 0.1)], "dataset_id string, f1 double")
    text = sinks.markdown_report(summary, sizes, failures)
    assert "| avg_f1 | 0.9000 | >= 0.8 |" in text and "- d: F1 0.1000" in text
    raw = spark.createDataFrame([("d", "text")], "dataset_id string, raw string")
    sinks.write_evaluation(summary, failures, raw, str(tmp_path / "e"))
    assert json.loads(spark.read.text(str(tmp_path / "e/raw")).first().value) == {"dataset_id": "d", "raw": "text"} and spark.read.json(str(tmp_path / "e/summary")).count() == 1
    wide = spark.createDataFrame([("d", 1, "a", "")], "dataset_id string, row_no int, item_1 string, item_2 string")
    sinks.write_wide_csv(wide, str(tmp_path / "w"))
    assert spark.read.csv(str(tmp_path / "w"), header=True).first().item_1 == "a"


def test_rankings_written(spark, tmp_path):
    r = spark.createDataFrame([("b", 2.0, 3), ("a", 1.5, 3)], "model string, average_rank double, rankings_count long")
    sinks.write_rankings(r, str(tmp_path / "r"), query="why", mode="advice")
    got = json.loads(spark.read.text(str(tmp_path / "r")).first().value)
    assert got["query"] == "why" and [x["model"] for x in got["aggregate_rankings"]] == ["a", "b"]


def test_versions(spark, tmp_path):
    hub = str(tmp_path / "hub")
    records = spark.createDataFrame([([("user", "x"), ("assistant", "Row 1, R2")],), ([("assistant", "a, R1")],)], "messages array<struct<role:string,content:string>>")
    for version, split in (("v2", "train"), ("v2", "validation"), ("v3", "train")):
        sinks.publish_version(records, hub, version, "sft", split)
    assert {(r.config, r.split): r.rows for r in sinks.published(spark, f"{hub}/version=v2", ("sft",)).collect()} == {("sft", "train"): 2, ("sft", "validation"): 2}
    with pytest.raises(Exception):
        sinks.published(spark, f"{hub}/version=v3", ("sft",)).collect()
    assert sinks.reference_styles(readers.read_split(spark, f"{hub}/version=v2", "sft")).first().asDict() == {"records": 2, "row_labels": 1, "short_labels": 2}


def test_export_reports(spark, tmp_path):
    records = spark.createDataFrame([([("assistant", t)], (n, n * 2)) for t, n in (("same", 10), ("Same ", 20), ("other", 31))], "messages array<struct<role:string,content:string>>, metadata struct<tokens:long,n_itemsets:long>")
    s = export.export_statistics(records).first()
    assert (s.examples, s.min_tokens, s.max_tokens, s.avg_tokens, s.max_n_itemsets, s.assistant_duplicate_full_text_count) == (3, 10, 31, 20.3, 62, 1)
    sinks.write_records(records, export.export_statistics(records), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/records")).count() == 3 and spark.read.json(str(tmp_path / "r/report")).first().examples == 3
    prompts = spark.createDataFrame([("d", "t", 3, "good", 1), ("e", "t", 3, "x" * 20000, 1)], "dataset_id string, text string, min_support int, chosen string, n_itemsets int")
    rejects = spark.createDataFrame([(d, m, f"bad {m}", 1) for d in "def" for m in ("m1", "m2", "m3", "m4")], "dataset_id string, model string, rejected string, n_rejected int")
    judged = export.judged_rejects(prompts, rejects)
    assert export.skip_counts(judged).first().asDict() == {"pairs": 3, "skipped_missing": 4, "skipped_tokens": 4, "skipped_limit": 1}
    pairs = export.preference_pairs(prompts, rejects)
    p = export.pair_statistics(pairs).first()
    assert (p.pairs, p.unique_datasets, p.avg_pairs_per_dataset, p.chosen_duplicate_full_text_count, p.rejected_unique_full_text_rate) == (3, 1, 3.0, 2, 1.0)
    assert [(r.rejected_model, r.pairs) for r in export.rejected_models(pairs).collect()] == [("m1", 1), ("m2", 1), ("m3", 1)]
    texts = export.dataset_text(spark.createDataFrame([("d", 1, ["a"])], "dataset_id string, row_no int, items array<string>"))
    settings = spark.createDataFrame([("d", "d.csv", 1, "made", 3, 3, "small", "h")], "dataset_id string, filename string, n_cols int, source string, min_support int, max_size int, size_category string, hash string")
    flat = export.evaluation_records(texts, spark.createDataFrame([], "dataset_id string, ground_truth string, n_itemsets long"), settings).first()
    assert (flat.id, flat.csv_text, flat.ground_truth, flat.n_itemsets, flat.size_category) == ("d", "Row 1: a", "[]", 0, "small")


def test_reasoning_listings_are_cut(spark):
    singles = [("d", 1, [f"c{i % 3}:{i:02d}"], 7, list(range(1, 8))) for i in range(25)]
    pairs = [("d", 2, ["c0:00", f"c1:{i:02d}"], 6, list(range(1, 7))) for i in range(18)]
    sets = spark.createDataFrame(singles + pairs, "dataset_id string, size int, itemset array<string>, count long, rows array<int>")
    shapes = spark.createDataFrame([("d", 9, 3, 3)], "dataset_id string, n_rows int, n_cols int, min_support int")
    cot = export.reasoning(sets, shapes).first().cot
    assert "FREQUENT SINGLES [25]: " in cot and "(+5 more)" in cot and "FREQUENT PAIRS [18]: " in cot and "(+3 more)" in cot
    assert "=7(R1, R2, R3, R4, R5 +2more)✓" in cot and "=6(R1, R2, R3, R4 +2more)✓" in cot and cot.count("  c") == 3
    assert "TRIPLES: none meet threshold" in cot and "25 singles + 18 pairs + 0 triples = 43 frequent itemsets" in cot
    legacy = export.legacy_reasoning(sets, shapes).first().cot
    assert "43 total found" in legacy and "Singles (25 found, showing top 20):" in legacy and "... and 5 more singles" in legacy and "Pairs (18 found, showing top 18):" in legacy


def test_smaller_functions(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": [1, 2],\n "b": "c"}')
    assert readers.read_json(spark, str(tmp_path / "x.json")).first().b == "c"
    prof = spark.createDataFrame([("a", "text", 3, True), ("b", "text", 3, True), ("c", "number", 50, False)], "column string, kind string, distinct long, categorical boolean")
    assert readers.eligible(prof, 2).first().eligible and not readers.eligible(prof, 3).first().eligible
    found = readers.listing(spark, str(tmp_path), "*.json")
    rows = spark.createDataFrame([(found.first().path,), ("gone.json",)], "llm_output_path string")
    assert ledger.present(rows, found, "llm_output_path").count() == 1
    t = spark.createDataFrame([(i, ["a"]) for i in (1, 50, 51)], "row_no int, items array<string>")
    assert mining.first_chunk(t).count() == 2
    chunk = t.agg(F.array_sort(F.collect_list(F.struct("row_no", "items"))).alias("rows")).select(export.chunk_message(F.col("rows")).alias("m")).first().m
    assert json.loads(chunk) == {"Row 1": ["a"], "Row 50": ["a"], "Row 51": ["a"]}
    texts = spark.createDataFrame([("a b c",), ("a",), (None,)], "text string")
    assert export.within_tokens(texts, F.col("text"), 1, lambda x: [len(y.split()) for y in x]).count() == 2
    assert export.within_tokens(texts, F.col("text"), 0).count() == 1
    odd = spark.createDataFrame([('{"a": NaN, "a": 2}',), ("no",), ('{"b": 1}',)], "t string")
    assert [json.loads(x.j) if x.j else None for x in odd.select(claims.lenient_json(F.col("t")).alias("j")).collect()] == [{"a": 2}, None, {"b": 1}]
    chunks = spark.createDataFrame([("d", "m", 0, 0, 50, "Row 1: a")], "dataset_id string, model string, chunk_no int, start int, end int, text string")
    raw = claims.extract(chunks, lambda pdf: ['[{"itemset": ["a"], "count": 1, "evidence_rows": ["Row 1"], "rows": []}]'] * len(pdf))
    rejected = export.rejected_json(claims.parse_claims(raw)).first()
    assert json.loads(rejected.rejected) == [{"itemset": ["a"], "count": 1, "rows": ["Row 1"]}] and rejected.n_rejected == 1
    each = spark.createDataFrame([("<think>[1]</think> none [2]",)], "t string").select(claims.parse_json(F.col("t"), "each").cast("string").alias("v")).first().v
    assert each == "[2]"
    baskets = spark.createDataFrame([("d", "a"), ("d", "a"), ("d", "b")], "dataset_id string, item string")
    assert {r["item"]: r["count"] for r in support.running_support(baskets).collect()} == {"a": 2, "b": 1}
    errors = spark.createDataFrame([("d", "llm", i, "t", None, None) for i in range(5)], "dataset_id string, source string, claim_idx int, type string, row_label string, detail string")
    assert len(validation.first_errors(errors).first().errors) == 3


def test_ledger_grows_columns(spark, tmp_path):
    path = str(tmp_path / "runs")
    a = spark.createDataFrame([("1", "m")], "id string, llm_model string")
    ledger.append_runs(a, path)
    ledger.append_runs(a.withColumn("id", F.lit("2")).withColumn("temperature", F.lit(0.5)), path)
    back = {r.id: r for r in ledger.read_runs(spark, path).collect()}
    assert back["1"].temperature is None and back["2"].temperature == 0.5 and back["1"].validation_passed is None
