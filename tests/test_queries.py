"""Every registered query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from itemforge import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split() + "documents embeddings pages benchmark labels conversations".split()


#: Queries without a row on the smallest tables: rare itemsets, users without a passed run, and triage of claims that are all right
#: (``faulty_triage`` has some).
NONE_HERE = {"frequent_itemsets_upto4", "training_exclusion", "failure_triage"}


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(x):
        return round(x, 9) if isinstance(x, float) and math.isfinite(x) else x

    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    got = df.collect()
    assert got or name in NONE_HERE
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    q = duck.execute(sql)
    names = [d[0] for d in q.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, got) == rows(names, q.fetchall())


def test_faults_and_small_sets_are_seen(spark):
    """Queries on faulty claims find faults of every kind, small data sets are topped up, and records are made."""
    q = catalog.queries()
    n = [r.asDict() for r in q["faulty_metrics"](spark, DATA).collect()]
    assert all(sum(r[c] for r in n) > 0 for c in ("tp", "fp", "fn", "ungrounded")) and any(0 < r["correct_counts"] < r["matched_claims"] for r in n)
    orders = spark.read.parquet(f"{DATA}/orders.parquet")
    topped = q["topped_up"](spark, DATA)
    assert topped.count() > orders.count() and topped.groupBy("dataset_id").count().agg({"count": "min"}).first()[0] == 12
    records = q["sft_records"](spark, DATA)
    assert records.count() > orders.select("o_custkey").distinct().count() // 2 and records.where("messages < 2 OR tokens > 3500").count() == 0
    biggest = max(len(r.reasoning) if "reasoning" in r else max(len(str(x)) for x in r) for r in q["reasoning_text"](spark, DATA).collect())
    assert biggest < 1 << 20


def test_ledger_reads_only_what_it_must(spark, tmp_path):
    """The model is a folder and the time a pushed filter: the plan says so, and only that model's files are read."""
    from itemforge.operators import ledger

    df = catalog.queries()["ledger_table"](spark, DATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    part = plan[plan.index("PartitionFilters") :]
    assert "llm_model" in part[: part.index("]")] and "timestamp" in plan[plan.index("PushedFilters") :].split("ReadSchema")[0]
    runs = spark.range(60).selectExpr("CAST(id AS STRING) AS id", "timestamp'2024-01-01' AS timestamp", "concat('m', id % 3) AS llm_model")
    ledger.append_runs(runs, str(tmp_path / "ledger"))
    some = ledger.read_runs(spark, str(tmp_path / "ledger")).transform(ledger.run_filter(model="m1"))
    assert some.select("_metadata.file_path").distinct().where("file_path NOT LIKE '%llm_model=m1%'").count() == 0 and some.count() == 20


def test_streaming(spark, tmp_path):
    from itemforge.streaming.support import windowed_support

    src = spark.read.parquet(f"{DATA}/events.parquet")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = windowed_support(stream, "ts", "event_type").writeStream.format("memory").queryName("support").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("support").selectExpr("sum(count) AS n").first().n == src.count()
