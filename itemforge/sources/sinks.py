"""Writers: JSON artifacts, logs, wide CSV, reports and published layouts."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.operators.scoring import TARGETS
from itemforge.operators.validation import first_errors


def artifact_name(model: Column, kind: str, stem: Column, digest: Column, stamp: Column | None = None) -> Column:
    """``model_kind_stem_hash12[_stamp].json``."""
    parts = [model, F.lit(kind), stem, F.left(digest, F.lit(12))]
    return F.concat(F.concat_ws("_", *parts, *([stamp] if stamp is not None else [])), F.lit(".json"))


def write_artifacts(df: DataFrame, path: str, by: str = "dataset_id") -> None:
    """One JSON folder for each data set; a rerun replaces only the data sets that it holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).json(path)


def write_named(df: DataFrame, path: str, kind: str, mode: str = "overwrite", stamp: str | None = None) -> None:
    """JSON artifacts of runs (llm_model, dataset_name, dataset_hash, payload text), one folder ``artifact=<name>`` each.

    Mode overwrite gives a run the same name each time, so a rerun replaces its own artifacts alone; timestamp
    adds ``stamp`` (UTC, by default of now) to the name, so that every run keeps its own.
    """
    if mode not in ("overwrite", "timestamp"):
        raise ValueError(mode)
    stamp = F.lit(stamp or time.strftime("%Y%m%d%H%M%S", time.gmtime())) if mode == "timestamp" else None
    stem = F.regexp_replace("dataset_name", r"\.[^.]*$", "")
    named = df.select(artifact_name(F.col("llm_model"), kind, stem, F.coalesce("dataset_hash", F.lit("unknown")), stamp).alias("artifact"), F.col("payload").alias("value"))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("artifact").text(path)


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def stage_log(df: DataFrame, stage: str, keys: tuple[str, ...] = ("dataset_id",)) -> DataFrame:
    """(keys, stage, rows, logged_at): what a stage produced for each data set."""
    return df.groupBy(*keys).agg(F.lit(stage).alias("stage"), F.count("*").alias("rows"), F.current_timestamp().alias("logged_at"))


def timed(df: DataFrame, stage: str, write: Callable[[DataFrame], None]) -> DataFrame:
    """Run ``write`` on ``df`` and return its log: (stage, stage_duration_ms, rows, logged_at), rows counted while writing."""
    counted, seen = observed(df, f"{stage}-{time.time_ns()}")
    began = time.perf_counter()
    write(counted)
    took = int((time.perf_counter() - began) * 1000)
    return df.sparkSession.createDataFrame([(stage, took, seen.get["rows"])], "stage string, stage_duration_ms long, rows long").withColumn("logged_at", F.current_timestamp())


def validation_log(found: DataFrame, reported: DataFrame, most: int = 3) -> DataFrame:
    """(dataset_id, source, errors, error_sample): number of errors, and the first few."""
    return reported.select("dataset_id", "source", "errors").join(first_errors(found, most).withColumnRenamed("errors", "error_sample"), ["dataset_id", "source"], "left")


def observed(df: DataFrame, name: str):
    """Counts rows while ``df`` is written: (df, observation)."""
    from pyspark.sql import Observation

    o = Observation(name)
    return df.observe(o, F.count(F.lit(1)).alias("rows")), o


def write_wide_csv(wide: DataFrame, path: str) -> None:
    wide.write.mode("overwrite").partitionBy("dataset_id").csv(path, header=True)


def write_evaluation(summary: DataFrame, measured: DataFrame, raw: DataFrame, path: str) -> None:
    """Summary, results of every data set, and the raw texts."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    measured.write.mode("overwrite").json(f"{path}/results")
    raw.select(F.to_json(F.struct("dataset_id", "raw")).alias("value")).write.mode("overwrite").text(f"{path}/raw")


def markdown_report(summary: DataFrame, sizes: DataFrame, failures: DataFrame, most: int = 50) -> str:
    """The report as Markdown; what reaches the driver is one row, a row per size, and ``most`` failures."""
    s = summary.first().asDict()
    out = ["# Evaluation", "", "| metric | value | target |", "| --- | --- | --- |"]
    targets = {"avg_f1": f">= {TARGETS['f1']}", "json_parse_rate": f">= {TARGETS['parse']}", "avg_ungrounded_rate": f"<= {TARGETS['ungrounded']}"}
    out += [f"| {k} | {v:.4f} | {targets.get(k, '')} |" if isinstance(v, float) else f"| {k} | {v} | {targets.get(k, '')} |" for k, v in s.items()]
    out += ["", "| size | datasets | precision | recall | F1 |", "| --- | --- | --- | --- | --- |"]
    out += [f"| {r['size']} | {r.datasets} | {r.precision:.4f} | {r.recall:.4f} | {r.f1:.4f} |" for r in sizes.orderBy("size").collect()]
    out += ["", "Failures:", ""] + [f"- {r.dataset_id}: F1 {r.f1:.4f}" for r in failures.orderBy("f1", "dataset_id").limit(most).collect()]
    return "\n".join(out) + "\n"


def summary_table(runs: DataFrame, path: str) -> None:
    """The ledger's table of sizes, counts, matches and bins as one CSV."""
    want = ("dataset_name", "parsed_rows", "parsed_cols", "dataset_area", "apriori_itemset_count", "llm_itemset_count", "itemset_diff", "percent_match", "size_bin", "apriori_valid_ratio", "llm_valid_ratio", "apriori_errors", "llm_errors")
    if "size_bin" in runs.columns:
        runs = runs.withColumn("size_bin", F.when(F.col("size_bin").isNotNull(), F.concat(F.lit("("), F.col("size_bin.lo").cast("string"), F.lit(", "), F.col("size_bin.hi").cast("string"), F.lit("]"))))
    runs.select(*[c for c in want if c in runs.columns]).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_rankings(rankings: DataFrame, path: str, **fields: str) -> None:
    """A ranking result as one JSON record: the given fields and ``aggregate_rankings``, best first."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("average_rank", "model", "rankings_count"))), lambda r: F.struct(r.model.alias("model"), r.average_rank.alias("average_rank"), r.rankings_count.alias("rankings_count")))
    rankings.agg(*[F.lit(v).alias(k) for k, v in fields.items()], rows.alias("aggregate_rankings")).coalesce(1).write.mode("overwrite").json(path)


def write_records(records: DataFrame, statistics: DataFrame, path: str) -> None:
    """Training records as JSON with a report beside them."""
    records.write.mode("overwrite").json(f"{path}/records")
    statistics.coalesce(1).write.mode("overwrite").json(f"{path}/report")


def publish(df: DataFrame, path: str, config: str, split: str = "train") -> None:
    """A configuration and split in the layout that ``read_split`` reads; uploading is not part of this library."""
    df.write.mode("overwrite").parquet(f"{path}/config={config}/split={split}")


def publish_version(df: DataFrame, path: str, version: str, config: str, split: str = "train") -> None:
    """``publish`` under a version, so that older versions stay readable."""
    publish(df, f"{path}/version={version}", config, split)


def published(spark: SparkSession, path: str, configs: tuple[str, ...], splits: tuple[str, ...] = ("train", "validation")) -> DataFrame:
    """(config, split, rows) of what is really there: a check after publishing; a part that is missing raises."""
    parts = [spark.read.parquet(f"{path}/config={c}/split={s}").agg(F.count("*").alias("rows")).select(F.lit(c).alias("config"), F.lit(s).alias("split"), "rows") for c in configs for s in splits]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reference_styles(records: DataFrame, messages: str = "messages", chars: int = 300) -> DataFrame:
    """One row: how many records refer to rows as ``Row n``, and how many shortly as ``, Rn`` near their beginning."""
    text = F.element_at(F.col(messages), -1)["content"]
    return records.agg(F.count("*").alias("records"), F.count_if(F.contains(text, F.lit("Row "))).alias("row_labels"), F.count_if(F.contains(F.left(text, F.lit(chars)), F.lit(", R"))).alias("short_labels"))


def cleanup(spark, folder: str, names: tuple[str, ...]) -> list[str]:
    """Delete the named files of a folder on any Hadoop file system; missing ones are ignored."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    gone = []
    for n in names:
        p = jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}")
        if p.getFileSystem(conf).delete(p, False):
            gone.append(f"{folder}/{n}")
    return gone
