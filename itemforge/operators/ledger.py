"""The run ledger: one row per run, appended to Parquet partitioned by model, and queries on it."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemforge.functions.text import null_ratio
from itemforge.operators.ranking import first_in_order
from itemforge.operators.validation import INVARIANTS

_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
# Columns of the ledger.
SCHEMA = T.StructType([T.StructField(n, t) for n, t in (
    ("id", _S), ("timestamp", T.TimestampType()), ("python_version", _S), ("data_path", _S), ("dataset_id", _S), ("dataset_name", _S), ("dataset_hash", _S),
    ("dataset_size_rows", _L), ("dataset_size_bytes", _L), ("min_support", _L), ("max_size", _L), ("llm_full", _B), ("llm_chunk_size", _L), ("llm_model", _S),
    ("apriori_itemset_count", _L), ("llm_itemset_count", _L), ("validation_passed", _B), ("apriori_valid_ratio", _D), ("llm_valid_ratio", _D),
    ("apriori_errors", _L), ("llm_errors", _L), ("run_duration_ms", _L), ("invariants", _S), ("apriori_output_path", _S), ("llm_output_path", _S),
    ("validation_report_path", _S), ("summary_path", _S), ("error_message", _S),
)])


def run_summary(datasets: DataFrame, itemsets: DataFrame, claims: DataFrame, reported: DataFrame, settings: dict) -> DataFrame:
    """One ledger row per data set, from its fingerprint, counts of itemsets and claims, and the report.

    ``settings`` gives constant columns of the ledger (min_support, llm_model, ...).
    """
    exact = itemsets.groupBy("dataset_id").agg(F.count("*").alias("apriori_itemset_count"))
    claimed = claims.groupBy("dataset_id").agg(F.count("*").alias("llm_itemset_count"))
    side = reported.groupBy("dataset_id").agg(*[F.coalesce(F.max(F.when(F.col("source") == s, F.col(c))), F.lit(0)).alias(f"{s}_{n}") for s in ("apriori", "llm") for c, n in (("valid_ratio", "valid_ratio"), ("errors", "errors"))])
    out = datasets
    for part in (exact, claimed, side):
        out = out.join(part, "dataset_id", "left")
    out = out.fillna(0, ["apriori_itemset_count", "llm_itemset_count", "apriori_errors", "llm_errors"])
    out = out.withColumn("validation_passed", (F.col("apriori_errors") + F.col("llm_errors")) == 0)
    out = out.withColumns({"timestamp": F.current_timestamp(), "id": F.uuid(), "invariants": F.to_json(F.array(*map(F.lit, INVARIANTS)))} | {k: F.lit(v) for k, v in settings.items()})
    have = set(out.columns)
    return out.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMA])


def append_runs(runs: DataFrame, path: str) -> None:
    """Append; files without a column that was added later give null for it."""
    runs.write.mode("append").partitionBy("llm_model").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All runs with the columns of the ledger and whatever later runs added; a column that a file lacks is null."""
    there = spark.read.option("mergeSchema", True).parquet(path)
    have = {f.name: f.dataType for f in there.schema}
    more = [T.StructField(n, t) for n, t in have.items() if n not in SCHEMA.fieldNames()]
    return spark.read.schema(T.StructType([*SCHEMA.fields, *more])).parquet(path)


def delete_run(spark: SparkSession, path: str, to: str, run_id: str) -> None:
    """The ledger without one run, written to another folder (Parquet files are not edited in place)."""
    read_runs(spark, path).where(F.col("id") != run_id).write.mode("overwrite").partitionBy("llm_model").parquet(to)


def run_filter(model: str | None = None, only_passed: bool = False, since: str | None = None, until: str | None = None, on: date | str | None = None, limit: int | None = None):
    """A transform for ``df.transform``: predicates that reach the scan; ``on`` overrides ``since`` and ``until``."""

    def apply(df: DataFrame) -> DataFrame:
        if model:
            df = df.where(F.col("llm_model") == model)
        if only_passed:
            df = df.where("validation_passed")
        if on:
            day = F.lit(str(on)).cast("timestamp_ntz")
            df = df.where((F.col("timestamp") >= day) & (F.col("timestamp") < day + F.expr("INTERVAL 1 DAY")))
        else:
            if since:
                df = df.where(F.col("timestamp") >= F.lit(since).cast("timestamp_ntz"))
            if until:
                df = df.where(F.col("timestamp") <= F.lit(until).cast("timestamp_ntz"))
        return df.orderBy("timestamp", "id").limit(limit) if limit else df

    return apply


def with_derived(runs: DataFrame) -> DataFrame:
    """itemset_diff, and percent_match = claimed / exact (null without exact itemsets)."""
    diff = F.col("llm_itemset_count") - F.col("apriori_itemset_count")
    return runs.withColumns({"itemset_diff": diff, "percent_match": null_ratio(F.col("llm_itemset_count"), F.col("apriori_itemset_count"))})


def failed_runs(runs: DataFrame) -> DataFrame:
    return runs.where("NOT validation_passed AND llm_itemset_count > 0 AND llm_output_path IS NOT NULL")


def statistics(runs: DataFrame, passed: Column | None = None) -> DataFrame:
    """(llm_model, runs, passed, pass_rate)."""
    ok = F.col("validation_passed") if passed is None else passed
    return runs.groupBy("llm_model").agg(F.count("*").alias("runs"), F.count_if(ok).alias("passed"), F.avg(ok.cast("int")).alias("pass_rate"))


def one_per_dataset(runs: DataFrame, latest: bool = True) -> DataFrame:
    """A whole row of each data set: the last (or first) by id, so the choice is stable."""
    pick = F.max_by if latest else F.min_by
    row = F.struct(*runs.columns)
    return runs.groupBy(F.col("dataset_id").alias("_key")).agg(pick(row, F.col("id")).alias("r")).select("r.*")


def capped(rows: DataFrame, per: list[str], order: list[str], most: int) -> DataFrame:
    """At most so many rows of each group, however large, in order; filter before, so that only accepted rows count."""
    return first_in_order(rows, [F.col(c) for c in order], per, most)


def excluding(rows: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Rows whose key was not used before (held-out sets, results already there)."""
    return rows.join(used.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def training_files(records: DataFrame) -> DataFrame:
    """(dataset_name): data sets of training records, with the id at the top or under metadata."""
    ids = [F.col(c) for c in ("dataset_id",) if c in records.columns] + ([F.col("metadata.dataset_id")] if "metadata" in records.columns else [])
    return records.select(F.split_part(F.coalesce(*ids), F.lit(":"), F.lit(1)).alias("dataset_name")).distinct()


def failed_with_truth(failed: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Failed runs joined to their data set's exact itemsets, and those without any."""
    return failed.join(truth, "dataset_id"), failed.join(truth.select("dataset_id"), "dataset_id", "left_anti")


def present(rows: DataFrame, listing: DataFrame, path_col: str) -> DataFrame:
    """Rows whose artifact is in a file listing (path)."""
    return rows.join(listing.select(F.col("path").alias(path_col)).distinct(), path_col, "left_semi")


def readiness(runs: DataFrame, prompt_there: bool, least: int = 100) -> DataFrame:
    """One row: enough valid runs, enough data sets, and a prompt."""
    n = runs.agg(F.count_if("validation_passed").alias("valid_runs"), F.countDistinct("dataset_id").alias("datasets"))
    return n.withColumn("ready", (F.col("valid_runs") >= least) & (F.col("datasets") >= least) & F.lit(prompt_there))


def batch_outcome(runs: DataFrame) -> DataFrame:
    """(succeeded, failed) by whether a run has an error message."""
    return runs.agg(F.count_if(F.col("error_message").isNull()).alias("succeeded"), F.count_if(F.col("error_message").isNotNull()).alias("failed"))
