"""Queries on the ledger, exported records, diversity, bins, rankings and generated data, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemforge.config import MiningConfig
from itemforge.functions import budgets
from itemforge.functions.text import after_think, close_trace, dimensions, file_of_dataset, is_family, is_looping, itemset_key, ordinal_label, row_label, think_text, token_estimate
from itemforge.operators import export, generate, ledger, mining, profiling
from itemforge.plans.mining_queries import BRANDS, brands, table
from itemforge.sources import readers, tables


def _runs(s, d):
    """Events as a ledger: type is the model, user the data set, every third run passed."""
    e = table(s, d, "events")
    return e.select(F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.col("event_type").alias("llm_model"), F.concat(F.lit("user"), "user_id", F.lit(".csv:"), "event_id").alias("dataset_id"), F.col("user_id").alias("dataset"), (F.col("event_id") % 3 == 0).alias("validation_passed"), (F.col("event_id") % 5).alias("llm_itemset_count"), (F.col("event_id") % 4).alias("apriori_itemset_count"), F.when(F.col("event_id") % 11 != 0, F.concat(F.lit("out/"), "event_id")).alias("llm_output_path"), F.when(F.col("event_id") % 13 == 0, "timeout").alias("error_message"))


_RUNS = "WITH runs AS (SELECT event_id AS id, ts AS timestamp, event_type AS llm_model, 'user' || user_id || '.csv:' || event_id AS dataset_id, user_id AS dataset, event_id % 3 = 0 AS validation_passed, event_id % 5 AS llm_itemset_count, event_id % 4 AS apriori_itemset_count, CASE WHEN event_id % 11 <> 0 THEN 'out/' || event_id END AS llm_output_path, CASE WHEN event_id % 13 = 0 THEN 'timeout' END AS error_message FROM events) "


def ledger_stats(s, d):
    return ledger.statistics(_runs(s, d))


def ledger_filter_day(s, d):
    return _runs(s, d).transform(ledger.run_filter(model="click", on="2024-01-03")).select("id", "llm_model")


def ledger_filter_range(s, d):
    return _runs(s, d).transform(ledger.run_filter(only_passed=True, since="2024-01-02", until="2024-01-05", limit=50)).select("id")


def ledger_derived(s, d):
    return ledger.with_derived(_runs(s, d)).select("id", "itemset_diff", "percent_match")


def latest_per_group(s, d):
    runs = _runs(s, d).withColumn("dataset_id", F.col("dataset").cast("string"))
    return ledger.one_per_dataset(runs).select("dataset_id", "id", "llm_model")


def failed_runs(s, d):
    return ledger.failed_runs(_runs(s, d)).select("id", "llm_model")


def capped_rejects(s, d):
    return ledger.capped(ledger.failed_runs(_runs(s, d)), ["dataset"], ["llm_model", "id"], 3).select("dataset", "id")


def batch_outcome(s, d):
    return ledger.batch_outcome(_runs(s, d))


def readiness(s, d):
    return ledger.readiness(_runs(s, d), True)


def holdout_exclusion(s, d):
    return ledger.excluding(table(s, d, "documents").select("doc_id"), table(s, d, "labels"), "doc_id")


def training_exclusion(s, d):
    used = ledger.training_files(_runs(s, d).where("validation_passed AND id % 7 = 0").select("dataset_id"))
    names = _runs(s, d).select(file_of_dataset(F.col("dataset_id")).alias("dataset_name")).distinct()
    return ledger.excluding(names, used, "dataset_name")


def failed_with_truth(s, d):
    runs = ledger.failed_runs(_runs(s, d)).withColumn("dataset_id", F.col("dataset"))
    truth = table(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("dataset_id"), "c_name")
    with_, without = ledger.failed_with_truth(runs, truth)
    return with_.agg(F.count("*").alias("n")).select(F.lit("joined").alias("side"), "n").union(without.agg(F.count("*").alias("n")).select(F.lit("unmatched"), "n"))


def model_families(s, d):
    return _runs(s, d).where(is_family(F.col("llm_model"), ["click", "vie"])).groupBy("llm_model").agg(F.count("*").alias("runs"))


def message_records(s, d):
    c = table(s, d, "conversations")
    each = F.array_sort(F.collect_list(F.struct("turn", export.message("r", F.col("text")).withField("role", F.col("role")).alias("m"))))
    g = c.groupBy("conv_id").agg(each.alias("e"))
    return g.select("conv_id", F.size("e").cast("long").alias("messages"), F.array_join(F.transform("e", lambda x: x.m.role), ",").alias("roles"), F.aggregate("e", F.lit(0).cast("long"), lambda a, x: a + F.char_length(x.m.content)).alias("chars"))


def token_budget(s, d):
    return table(s, d, "conversations").withColumn("tokens", token_estimate(F.col("text"))).where("tokens <= 100").select("conv_id", "turn", "tokens")


def over_limit(s, d):
    return export.over_limit(table(s, d, "conversations"), token_estimate(F.col("text")), 100)


def _pair_sides(s, d):
    """Prompts are first turns with the answer to them; rejects are later answers of the conversation, or of one without such a prompt."""
    c = table(s, d, "conversations")
    a = c.where("role = 'assistant'")
    first = a.where("turn = 1").select("conv_id", F.col("text").alias("chosen"))
    prompts = c.where("turn = 0 AND role = 'user'").join(first, "conv_id").select(F.col("conv_id").alias("dataset_id"), "text", F.lit(3).alias("min_support"), "chosen", F.lit(1).alias("n_itemsets"))
    rejects = a.where("turn <> 1").select(F.col("conv_id").alias("dataset_id"), F.col("turn").cast("string").alias("model"), F.col("text").alias("rejected"), F.lit(1).alias("n_rejected"))
    return prompts, rejects


def preference_pairs(s, d):
    """The answer to a first turn preferred to later ones of its conversation, within a budget, at most two for each conversation."""
    out = export.preference_pairs(*_pair_sides(s, d), 600, 2)
    return out.select(F.col("metadata.dataset_id").alias("conv_id"), F.col("metadata.rejected_model").alias("turn"), F.char_length(F.col("chosen")[0].content).cast("long").alias("chosen_chars"))


def skipped_pairs(s, d):
    return export.skip_counts(export.judged_rejects(*_pair_sides(s, d), 600, 2))


def pair_statistics(s, d):
    out = export.pair_statistics(export.preference_pairs(*_pair_sides(s, d), 600, 2))
    return out.select("pairs", "unique_datasets", "avg_pairs_per_dataset", "chosen_total_texts", "chosen_max_chars", "rejected_min_chars", "rejected_duplicate_full_text_count")


def rejected_models(s, d):
    return export.rejected_models(export.preference_pairs(*_pair_sides(s, d), 600, 2))


def phase_budgets(s, d):
    p = table(s, d, "part")
    b = budgets.phase_budget(F.col("p_size"), F.when(F.col("p_partkey") % 3 == 0, 0).otherwise(F.col("p_partkey") % 90))
    return p.select("p_partkey", b.alias("b")).select("p_partkey", "b.*")


def single_budgets(s, d):
    p = table(s, d, "part")
    return p.select("p_partkey", budgets.single_budget(F.col("p_size"), F.when(F.col("p_partkey") % 3 == 0, 0).otherwise(F.col("p_partkey") % 90)).alias("budget"))


def gate_budgets(s, d):
    p = table(s, d, "part")
    b = budgets.gate_budget((F.col("p_partkey") % 4000).cast("long"), (F.col("p_size") * 40).cast("long"), 4096)
    return p.select("p_partkey", b.alias("b")).select("p_partkey", "b.*")


def think_split(s, d):
    c = table(s, d, "conversations")
    tail = F.when(F.col("turn") % 3 == 0, F.lit("")).otherwise("</think> answer</think> end")
    text = F.concat(F.lit("<think>"), F.col("text"), tail)
    return c.select("conv_id", "turn", after_think(text).alias("first"), after_think(text, last=True).alias("last"), think_text(text).alias("think"))


def trace_repair(s, d):
    c = table(s, d, "conversations")
    text = F.concat(F.lit("FREQUENT\nSCAN "), F.regexp_replace("text", "\n", " "), F.lit("\nloose end"))
    return c.select("conv_id", "turn", F.char_length(close_trace(text)).cast("long").alias("chars"), F.sha2(close_trace(text).cast("binary"), 256).alias("sha"))


def loop_detection(s, d):
    x = table(s, d, "documents")
    text = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.repeat(F.lit("\n same line "), F.lit(5)))).otherwise(F.col("text"))
    return x.select("doc_id", is_looping(text).alias("looping"))


def name_dimensions(s, d):
    p = table(s, d, "part")
    name = F.concat(F.lit("ds_"), "p_partkey", F.lit("_"), "p_size", F.lit("x"), F.col("p_partkey") % 7 + 1, F.when(F.col("p_partkey") % 2 == 0, "_0a1b2c3d.csv").otherwise(".csv"))
    r, c = dimensions(name)
    strict, _ = dimensions(name, strict=True)
    return p.select("p_partkey", r.alias("parsed_rows"), c.alias("parsed_cols"), (r * c).alias("area"), strict.alias("strict_rows"))


def diversity_report(s, d):
    return profiling.diversity(table(s, d, "documents"))


def top_prefixes(s, d):
    return profiling.top_prefixes(table(s, d, "documents"), 5)


def _sized(s, d):
    p = table(s, d, "part")
    return p.select("p_partkey", (F.col("p_size") * (F.col("p_partkey") % 17 + 1)).cast("double").alias("area"), (F.col("p_partkey") % 10).alias("diff"))


def size_bins(s, d):
    return profiling.quantile_bins(_sized(s, d), "area").groupBy(F.col("size_bin.lo").alias("lo"), F.col("size_bin.hi").alias("hi")).agg(F.count("*").alias("n"))


def bin_means(s, d):
    out = profiling.bin_means(profiling.quantile_bins(_sized(s, d), "area"), "diff")
    return out.select(F.col("size_bin.lo").alias("lo"), "rows", "avg_diff")


def explicit_bins(s, d):
    out = profiling.explicit_bins(_sized(s, d), "area", [0, 50, 100.0, 400])
    return out.select("p_partkey", F.col("size_bin.lo").alias("lo"), F.col("size_bin.hi").alias("hi"))


def rolling_match(s, d):
    x = profiling.rolling_mean(_sized(s, d), "diff", ["area", "p_partkey"], 6)
    return x.select("p_partkey", "smooth")


def rolling_match_odd(s, d):
    x = profiling.rolling_mean(_sized(s, d), "diff", ["area", "p_partkey"], 7)
    return x.select("p_partkey", "smooth")


def largest_datasets(s, d):
    return profiling.largest(_sized(s, d).withColumn("dataset_name", F.col("p_partkey").cast("string")), "area", 60).select("dataset_name", "area")


def rank_aggregation(s, d):
    """Every user ranks the kinds of events by how often they have them."""
    n = table(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    kinds = table(s, d, "events").select("event_type").distinct()
    place = readers.numbered(kinds, "event_type").select("event_type", (F.col("row_no") - 1).cast("int").alias("position"))
    n = n.join(place, "event_type").withColumn("label", F.concat(F.lit("Response "), ordinal_label(F.col("position"))))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "label")))
    lines = F.transform(order, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x.label))
    votes = n.groupBy("user_id").agg(F.concat(F.lit("Response Z is bad.\nFINAL RANKING:\n"), F.array_join(lines, "\n")).alias("text"))
    labels = profiling.label_models(place.select("position", F.col("event_type").alias("model")))
    return profiling.aggregate_rankings(votes.select(profiling.parse_ranking(F.col("text")).alias("ranking")), labels)


def _orders(s, d):
    o = table(s, d, "orders")
    return o.select(F.col("o_orderpriority").alias("dataset_id"), F.col("o_orderkey").alias("row_no"), F.array(F.concat(F.lit("status:"), "o_orderstatus"), F.concat(F.lit("cust:"), "o_custkey"), F.lit("kind:order")).alias("items"))


def _customers(s, d):
    """The orders of a customer as a data set: many small ones."""
    o = table(s, d, "orders")
    items = F.array(F.concat(F.lit("status:"), "o_orderstatus"), F.concat(F.lit("priority:"), "o_orderpriority"), F.lit("kind:order"))
    return o.select(F.col("o_custkey").cast("string").alias("dataset_id"), F.col("o_orderkey").alias("row_no"), items.alias("items"))


def ledger_table(s, d):
    """Runs appended to a ledger in two schemas, and read by model and time."""
    runs = _runs(s, d).select(F.col("id").cast("string").alias("id"), "timestamp", "llm_model", "dataset_id", "llm_itemset_count", "apriori_itemset_count", "validation_passed", "error_message")
    path = tables.new_path(s, "ledger")
    ledger.append_runs(runs.where("id % 2 = 0").drop("error_message"), path)
    ledger.append_runs(runs.where("id % 2 <> 0").withColumn("note", F.concat(F.lit("run "), "id")), path)
    out = ledger.read_runs(s, path).transform(ledger.run_filter(model="click", since="2024-01-02", until="2024-01-05"))
    return out.select("id", "llm_itemset_count", "validation_passed", "error_message", "note")


def row_subsample(s, d):
    out = generate.row_subsample(_orders(s, d), 25)
    return out.select("dataset_id", F.col("row_no").cast("long").alias("row_no"), F.get("items", 1).alias("item"))


def col_subsample(s, d):
    out = generate.col_subsample(_orders(s, d), 2)
    return out.groupBy("dataset_id").agg(F.count("*").alias("rows"), F.min(F.array_join(F.transform("items", lambda x: F.split_part(x, F.lit(":"), F.lit(1))), "|")).alias("prefixes"))


def shuffled_rows(s, d):
    out = generate.shuffled(_orders(s, d))
    return out.select("dataset_id", F.col("row_no").cast("long").alias("row_no"), F.get("items", 1).alias("item"))


def noise_rows(s, d):
    return generate.add_noise(_orders(s, d), 0.15).groupBy("dataset_id").agg(F.count("*").alias("rows"))


def variation_mix(s, d):
    return generate.mix(table(s, d, "orders").select("o_orderkey"), "o_orderkey")


def holdout_split(s, d):
    return generate.split(table(s, d, "orders").select("o_orderkey"), "o_orderkey")


def wide_rows(s, d):
    b = brands(s, d).groupBy("dataset_id", "row_no").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return generate.wide_rows(b, 4).drop("dataset_id")


def csv_hash(s, d):
    return generate.csv_text(_customers(s, d)).select("dataset_id", F.sha2("csv", 256).alias("sha"), "hash")


def generation_statistics(s, d):
    return generate.generation_statistics(_customer_log(s, d))


def _customer_log(s, d):
    """The orders of a customer as a data set."""
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("dataset_id"))
    return o.agg(F.count("*").alias("num_transactions"), (F.max(F.col("o_orderkey") % 5) + 1).alias("actual_cols"), F.countDistinct("o_orderpriority").alias("unique_items"))


def variation_counts(s, d):
    ids = table(s, d, "orders").select("o_orderkey")
    return generate.shares(generate.mix(ids, "o_orderkey"), "variation")


def source_counts(s, d):
    return generate.shares(table(s, d, "orders").select("o_orderstatus"), "o_orderstatus")


def dataset_names(s, d):
    log = _customer_log(s, d).withColumn("hash", F.sha2(F.col("dataset_id").cast("string").cast("binary"), 256))
    return generate.dataset_names(log, 7).select(F.col("dataset_id").alias("o_custkey"), F.col("dataset_idx").cast("long").alias("dataset_idx"), "filename")


def generation_log(s, d):
    return generate.generation_log(_orders(s, d))


def topped_up(s, d):
    out = generate.topped_up(_customers(s, d), 12)
    return out.select("dataset_id", F.col("row_no").cast("long").alias("row_no"), F.array_join("items", "|").alias("items"))


def generated_frequency(s, d):
    """Baskets drawn for each nation, a row for each of its customers."""
    sets = table(s, d, "customer").groupBy(F.col("c_nationkey").cast("string").alias("dataset_id")).agg(F.count("*").cast("int").alias("n_rows"))
    b = mining.to_baskets(generate.weighted_baskets(sets, [f"item{i}" for i in range(10)], 5))
    return mining.item_support(b).where("count >= 3").select("dataset_id", "item", "count")


def seeded_sample(s, d):
    return profiling.sampled(table(s, d, "orders").select("o_orderkey"), "o_orderkey", 30)


def dataset_text(s, d):
    out = export.dataset_text(_customers(s, d))
    return out.select("dataset_id", "n_rows", F.sha2("text", 256).alias("sha"))


def ground_truth_json(s, d):
    b = brands(s, d, "o_custkey")
    out = export.truth_json(mining.frequent_itemsets(b, MiningConfig(max_size=1), evidence=True, strategy="explode"))
    return out.select("dataset_id", "n_itemsets", F.regexp_replace("ground_truth", " ", "").alias("truth"))


def _records(s, d):
    t = _customers(s, d)
    shapes = t.groupBy("dataset_id").agg(F.count("*").cast("int").alias("n_rows"), F.lit(3).alias("n_cols"), F.lit(3).alias("min_support"))
    mined = mining.frequent_itemsets(mining.to_baskets(t), evidence=True, strategy="explode")
    return t, shapes, mined


def reasoning_text(s, d):
    _, shapes, mined = _records(s, d)
    return export.reasoning(mined, shapes)


def sft_records(s, d):
    t, shapes, mined = _records(s, d)
    out = export.sft_records(export.dataset_text(t), export.reasoning(mined, shapes), export.truth_json(mined), shapes, 3500)
    return out.select("dataset_id", F.size("messages").cast("long").alias("messages"), F.col("metadata.tokens").alias("tokens"), F.col("metadata.n_itemsets").alias("n_itemsets"))


def ordered_itemsets(s, d):
    mined = mining.frequent_itemsets(brands(s, d), MiningConfig(max_size=2), strategy="explode")
    return profiling.ordered(mined).select(F.col("size").cast("long").alias("size"), itemset_key(F.col("itemset")).alias("itemset"), "count")


def row_labels(s, d):
    return table(s, d, "orders").select("o_orderkey", row_label(F.col("o_orderkey") + 1).alias("label"))


QUERIES = {f.__name__: f for f in (
    ledger_table, ledger_stats, ledger_filter_day, ledger_filter_range, ledger_derived, latest_per_group, failed_runs, capped_rejects, batch_outcome, readiness, holdout_exclusion, training_exclusion, failed_with_truth,
    model_families, message_records, token_budget, over_limit, preference_pairs, skipped_pairs, pair_statistics, rejected_models, phase_budgets, single_budgets, gate_budgets, think_split, trace_repair, loop_detection, name_dimensions,
    diversity_report, top_prefixes, size_bins, bin_means, explicit_bins, rolling_match, rolling_match_odd, largest_datasets, rank_aggregation, row_subsample, col_subsample, shuffled_rows, noise_rows,
    variation_mix, holdout_split, wide_rows, csv_hash, generation_statistics, variation_counts, source_counts, dataset_names, generation_log, topped_up, generated_frequency, seeded_sample, dataset_text, ground_truth_json, reasoning_text, sft_records,
    ordered_itemsets, row_labels,
)}


def _u(*keys: str) -> str:
    text = " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"(('0x' || left(sha256({text} || ':42'), 12))::BIGINT / 281474976710656.0)"


def _choice(u: str, options) -> str:
    out, total = "CASE", 0.0
    for name, share in options[:-1]:
        total += share
        out += f" WHEN {u} < {total!r} THEN '{name}'"
    return f"{out} ELSE '{options[-1][0]}' END"


_LOG = "SELECT o_custkey AS k, count(*) AS r, max(o_orderkey % 5) + 1 AS c, count(DISTINCT o_orderpriority) AS u FROM orders GROUP BY o_custkey"
_ORDERS = "SELECT o_orderpriority AS dataset_id, o_orderkey AS row_no, 'status:' || o_orderstatus AS a, 'cust:' || o_custkey AS b FROM orders"
_CUSTOMERS = "SELECT CAST(o_custkey AS VARCHAR) AS dataset_id, o_orderkey AS row_no, 'status:' || o_orderstatus AS a, 'priority:' || o_orderpriority AS b FROM orders"
_PROMPT_CHARS = len(export.SYSTEM_PROMPT) + len("Find all frequent itemsets with minimum support count = 3 in this dataset:") + 2
_PAIRS = f"WITH p AS (SELECT q.conv_id, q.text, f.text AS chosen FROM conversations q JOIN conversations f ON f.conv_id = q.conv_id AND f.turn = 1 AND f.role = 'assistant' WHERE q.turn = 0 AND q.role = 'user'), j AS (SELECT o.conv_id, CAST(o.turn AS VARCHAR) AS model, o.text AS rejected, chosen, CASE WHEN chosen IS NULL THEN 'missing' WHEN ({_PROMPT_CHARS} + length(p.text)) // 4 + greatest(length(chosen) // 4, length(o.text) // 4) > 600 THEN 'tokens' END AS skip FROM conversations o LEFT JOIN p ON p.conv_id = o.conv_id WHERE o.role = 'assistant' AND o.turn <> 1), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, skip IS NULL ORDER BY model) AS r FROM j) "
_EST = "WITH e AS (SELECT p_partkey, CAST(CASE WHEN p_partkey % 3 = 0 OR p_partkey % 90 = 0 THEN p_size * 3 ELSE p_partkey % 90 END AS BIGINT) AS s FROM part), f AS (SELECT *, least(s * (s - 1) // 4, 50) AS p FROM e), g AS (SELECT *, least(p // 3, 20) AS t FROM f) "
_SIZED = "SELECT p_partkey, CAST(p_size * (p_partkey % 17 + 1) AS DOUBLE) AS area, p_partkey % 10 AS diff FROM part"
_BINS = f"WITH x AS ({_SIZED}), q AS (SELECT list_sort(list_distinct(quantile_cont(area, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM x), b AS (SELECT x.*, e[i] AS lo, e[i + 1] AS hi FROM x, q, range(1, 6) r(i) WHERE i < len(e) AND area <= e[i + 1] AND (area > e[i] OR (i = 1 AND area = e[1]))) "
_NORMAL = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_SIG = f"WITH s AS (SELECT length(text) AS chars, lower({_NORMAL}) AS whole, left(lower({_NORMAL}), 120) AS prefix FROM documents WHERE {_NORMAL} <> '') "
_THINK = "CASE WHEN turn % 3 = 0 THEN '' ELSE '</think> answer</think> end' END"

SQL = {
    "ledger_stats": _RUNS + "SELECT llm_model, count(*) AS runs, count(*) FILTER (validation_passed) AS passed, avg(CAST(validation_passed AS INT)) AS pass_rate FROM runs GROUP BY llm_model",
    "ledger_filter_day": _RUNS + "SELECT id, llm_model FROM runs WHERE llm_model = 'click' AND timestamp >= TIMESTAMP '2024-01-03' AND timestamp < TIMESTAMP '2024-01-04'",
    "ledger_filter_range": _RUNS + "SELECT id FROM runs WHERE validation_passed AND timestamp >= TIMESTAMP '2024-01-02' AND timestamp <= TIMESTAMP '2024-01-05' ORDER BY timestamp, id LIMIT 50",
    "ledger_derived": _RUNS + "SELECT id, llm_itemset_count - apriori_itemset_count AS itemset_diff, llm_itemset_count / nullif(apriori_itemset_count, 0) AS percent_match FROM runs",
    "latest_per_group": _RUNS + "SELECT CAST(dataset AS VARCHAR) AS dataset_id, max(id) AS id, arg_max(llm_model, id) AS llm_model FROM runs GROUP BY dataset",
    "failed_runs": _RUNS + "SELECT id, llm_model FROM runs WHERE NOT validation_passed AND llm_itemset_count > 0 AND llm_output_path IS NOT NULL",
    "capped_rejects": _RUNS + "SELECT dataset, id FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY llm_model, id) AS r FROM runs WHERE NOT validation_passed AND llm_itemset_count > 0 AND llm_output_path IS NOT NULL) WHERE r <= 3",
    "batch_outcome": _RUNS + "SELECT count(*) FILTER (error_message IS NULL) AS succeeded, count(*) FILTER (error_message IS NOT NULL) AS failed FROM runs",
    "readiness": _RUNS + "SELECT count(*) FILTER (validation_passed) AS valid_runs, count(DISTINCT dataset_id) AS datasets, count(*) FILTER (validation_passed) >= 100 AND count(DISTINCT dataset_id) >= 100 AS ready FROM runs",
    "holdout_exclusion": "SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)",
    "training_exclusion": _RUNS + "SELECT DISTINCT split_part(dataset_id, ':', 1) AS dataset_name FROM runs EXCEPT SELECT split_part(dataset_id, ':', 1) FROM runs WHERE validation_passed AND id % 7 = 0",
    "failed_with_truth": _RUNS + ", f AS (SELECT * FROM runs WHERE NOT validation_passed AND llm_itemset_count > 0 AND llm_output_path IS NOT NULL), t AS (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) SELECT 'joined' AS side, count(*) AS n FROM f JOIN t ON dataset = c_custkey UNION ALL SELECT 'unmatched', count(*) FROM f WHERE dataset NOT IN (SELECT c_custkey FROM t)",
    "model_families": _RUNS + "SELECT llm_model, count(*) AS runs FROM runs WHERE llm_model LIKE '%click%' OR llm_model LIKE '%vie%' GROUP BY llm_model",
    "message_records": "SELECT conv_id, count(*) AS messages, string_agg(role, ',' ORDER BY turn) AS roles, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id",
    "token_budget": "SELECT conv_id, turn, length(text) // 4 AS tokens FROM conversations WHERE length(text) // 4 <= 100",
    "over_limit": "SELECT count(*) AS records, count(*) FILTER (length(text) // 4 > 100) AS over_limit, max(length(text) // 4) AS longest FROM conversations",
    "preference_pairs": _PAIRS + "SELECT conv_id, model AS turn, length(chosen) AS chosen_chars FROM k WHERE skip IS NULL AND r <= 2",
    "skipped_pairs": _PAIRS + "SELECT count(*) FILTER (skip IS NULL AND r <= 2) AS pairs, count(*) FILTER (skip = 'missing') AS skipped_missing, count(*) FILTER (skip = 'tokens') AS skipped_tokens, count(*) FILTER (skip IS NULL AND r > 2) AS skipped_limit FROM k",
    "pair_statistics": _PAIRS + ", a AS (SELECT * FROM k WHERE skip IS NULL AND r <= 2), n AS (SELECT count(*) AS n FROM a WHERE trim(rejected) <> '' GROUP BY lower(trim(regexp_replace(rejected, '\\s+', ' ', 'g')))) SELECT count(*) AS pairs, count(DISTINCT conv_id) AS unique_datasets, round(count(*) / greatest(count(DISTINCT conv_id), 1), 2) AS avg_pairs_per_dataset, count(*) FILTER (trim(chosen) <> '') AS chosen_total_texts, max(length(chosen)) AS chosen_max_chars, min(length(rejected)) AS rejected_min_chars, (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM n) AS rejected_duplicate_full_text_count FROM a",
    "rejected_models": _PAIRS + ", a AS (SELECT * FROM k WHERE skip IS NULL AND r <= 2) SELECT model AS rejected_model, count(*) AS pairs, count(*) / (SELECT count(*) FROM a) AS share FROM a GROUP BY model",
    "generated_frequency": f"""WITH s AS (SELECT CAST(c_nationkey AS VARCHAR) AS dataset_id, count(*) AS n FROM customer GROUP BY c_nationkey), r AS (SELECT dataset_id, unnest(range(1, n + 1)) AS row_no FROM s), e AS (SELECT *, unnest(range(0, 5)) AS i FROM r),
        d AS (SELECT dataset_id, row_no, CASE WHEN {_u('dataset_id', 'row_no', 'i', chr(39) + 'r' + chr(39))} < 0.7 THEN [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 5, 6, 7, 8, 9][floor({_u('dataset_id', 'row_no', 'i', chr(39) + 'a' + chr(39))} * 18)::INT + 1] ELSE floor({_u('dataset_id', 'row_no', 'i', chr(39) + 'b' + chr(39))} * 10)::INT END AS k FROM e)
        SELECT dataset_id, 'item' || k AS item, count(DISTINCT row_no) AS count FROM d GROUP BY ALL HAVING count(DISTINCT row_no) >= 3""",
    "phase_budgets": _EST + "SELECT p_partkey, greatest(300, least(floor((s * 20 + p * 25 + t * 30 + 100) * 1.5)::BIGINT, 3000)) AS think_tokens, greatest(300, least(floor((s + p + t) * 60 * 1.5)::BIGINT, 3000)) AS json_tokens, greatest(512, least(floor((s * 20 + p * 25 + t * 30 + 100) * 1.5)::BIGINT + floor((s + p + t) * 60 * 1.5)::BIGINT, 6000)) AS total_tokens, s + p + t AS estimated_itemsets FROM g",
    "single_budgets": _EST + "SELECT p_partkey, greatest(512, least(floor((s * 15 + p * 20 + t * 25 + 80 + (s + p + t) * 60) * 1.5)::BIGINT, 6000)) AS budget FROM g",
    "gate_budgets": """WITH a AS (SELECT p_partkey, greatest(1024, 4096 - p_partkey % 4000 - 64) AS available, greatest(1792, floor(p_size * 40 * 2.3::DOUBLE)::BIGINT) AS requested FROM part), b AS (SELECT *, least(available, requested) AS total FROM a),
        c AS (SELECT *, CASE WHEN total >= 1536 THEN least(1800, total - least(greatest(768, floor(total * 0.52::DOUBLE)::BIGINT), total - 512)) ELSE total - greatest(512, total // 2) END AS think FROM b) SELECT p_partkey, available, requested, total, think, total - think AS json FROM c""",
    "think_split": f"SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '<think>' || text ELSE ' answer</think> end' END AS first, CASE WHEN turn % 3 = 0 THEN '<think>' || text ELSE ' end' END AS last, CASE WHEN turn % 3 <> 0 THEN text END AS think FROM conversations",
    "trace_repair": "WITH t AS (SELECT conv_id, turn, 'FREQUENT' || chr(10) || 'SCAN ' || replace(text, chr(10), ' ') || chr(10) || '</think>' || chr(10) AS x FROM conversations) SELECT conv_id, turn, length(x) AS chars, sha256(x) AS sha FROM t",
    "loop_detection": r"WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(CASE WHEN doc_id % 4 = 0 THEN text || repeat(chr(10) || ' same line ', 5) ELSE text END, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents) SELECT doc_id, len(l) >= 6 AND len(list_distinct(l[-3:])) = 1 AS looping FROM l",
    "name_dimensions": "SELECT p_partkey, CAST(p_size AS BIGINT) AS parsed_rows, p_partkey % 7 + 1 AS parsed_cols, p_size * (p_partkey % 7 + 1) AS area, CASE WHEN p_partkey % 2 = 1 THEN CAST(p_size AS BIGINT) END AS strict_rows FROM part",
    "diversity_report": _SIG + ", w AS (SELECT count(*) AS n FROM s GROUP BY whole), p AS (SELECT count(*) AS n FROM s GROUP BY prefix), t AS (SELECT count(*) AS n, round(avg(chars), 1) AS a, CAST(min(chars) AS BIGINT) AS lo, CAST(max(chars) AS BIGINT) AS hi FROM s) SELECT n AS total_texts, a AS avg_chars, lo AS min_chars, hi AS max_chars, round((SELECT count(*) FROM w) / n, 4) AS unique_full_text_rate, round((SELECT count(*) FROM p) / n, 4) AS unique_prefix_rate, round((SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM p WHERE n > 1) / t.n, 4) AS template_collapse_rate, (SELECT max(n) FROM p) AS most_common_prefix_count, round((SELECT max(n) FROM p) / t.n, 4) AS most_common_prefix_rate, (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM w) AS duplicate_full_text_count FROM t",
    "top_prefixes": _SIG + "SELECT prefix, count(*) AS count FROM s GROUP BY prefix ORDER BY count DESC, prefix LIMIT 5",
    "size_bins": _BINS + "SELECT lo, hi, count(*) AS n FROM b GROUP BY ALL",
    "bin_means": _BINS + "SELECT lo, count(*) AS rows, avg(diff) AS avg_diff FROM b GROUP BY lo",
    "explicit_bins": f"WITH x AS ({_SIZED}) SELECT p_partkey, CASE WHEN area < 0 OR area > 400 THEN NULL WHEN area <= 50 THEN 0.0 WHEN area <= 100 THEN 50.0 ELSE 100.0 END AS lo, CASE WHEN area < 0 OR area > 400 THEN NULL WHEN area <= 50 THEN 50.0 WHEN area <= 100 THEN 100.0 ELSE 400.0 END AS hi FROM x",
    "rolling_match": f"WITH x AS ({_SIZED}) SELECT p_partkey, avg(diff) OVER (ORDER BY area, p_partkey ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS smooth FROM x",
    "rolling_match_odd": f"WITH x AS ({_SIZED}) SELECT p_partkey, avg(diff) OVER (ORDER BY area, p_partkey ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS smooth FROM x",
    "largest_datasets": f"WITH x AS ({_SIZED}) SELECT CAST(p_partkey AS VARCHAR) AS dataset_name, area FROM x ORDER BY area DESC, dataset_name LIMIT 60",
    "rank_aggregation": "WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT event_type, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM n) SELECT event_type AS model, round(avg(r), 2) AS average_rank, count(*) AS rankings_count FROM r GROUP BY event_type",
    "row_subsample": f"WITH o AS ({_ORDERS}), r AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY {_u('dataset_id', 'row_no')}, row_no) AS k FROM o) SELECT dataset_id, row_number() OVER (PARTITION BY dataset_id ORDER BY row_no) AS row_no, b AS item FROM r WHERE k <= 25",
    "col_subsample": f"WITH o AS ({_ORDERS}), p AS (SELECT DISTINCT dataset_id, unnest(['status', 'cust', 'kind']) AS prefix FROM o), c AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY {_u('dataset_id', 'prefix')}, prefix) AS k FROM p), j AS (SELECT dataset_id, string_agg(prefix, '|' ORDER BY CASE prefix WHEN 'status' THEN 1 WHEN 'cust' THEN 2 ELSE 3 END) AS prefixes FROM c WHERE k <= 2 GROUP BY dataset_id) SELECT dataset_id, count(*) AS rows, min(prefixes) AS prefixes FROM o JOIN j USING (dataset_id) GROUP BY dataset_id",
    "shuffled_rows": f"WITH o AS ({_ORDERS}) SELECT dataset_id, row_number() OVER (PARTITION BY dataset_id ORDER BY {_u('dataset_id', 'row_no')}, row_no) AS row_no, b AS item FROM o",
    "noise_rows": f"WITH o AS ({_ORDERS}) SELECT dataset_id, count(*) + greatest(1, floor(count(*) * 0.15::DOUBLE)::BIGINT) AS rows FROM o GROUP BY dataset_id",
    "variation_mix": f"SELECT o_orderkey, {_choice(_u('o_orderkey', chr(39) + 'v' + chr(39)), generate.VARIATIONS)} AS variation, {_choice(_u('o_orderkey', chr(39) + 's' + chr(39)), generate.SIZES)} AS size_class FROM orders",
    "holdout_split": f"SELECT o_orderkey, CASE WHEN {_u('o_orderkey')} < 0.1 THEN 'validation' ELSE 'train' END AS split FROM orders",
    "wide_rows": f"WITH b AS ({BRANDS}), l AS (SELECT row_no, list(item ORDER BY item) AS i FROM b GROUP BY row_no) SELECT row_no, i[1] AS item_1, coalesce(i[2], '') AS item_2, coalesce(i[3], '') AS item_3, coalesce(i[4], '') AS item_4 FROM l",
    "csv_hash": f"WITH o AS ({_CUSTOMERS}), c AS (SELECT dataset_id, 'item_1,item_2,item_3' || chr(10) || string_agg(a || ',' || b || ',kind:order', chr(10) ORDER BY row_no) AS csv FROM o GROUP BY dataset_id) SELECT dataset_id, sha256(csv) AS sha, left(sha256(csv), 8) AS hash FROM c",
    "generation_statistics": f"WITH l AS ({_LOG}) SELECT count(*) AS datasets, min(r) AS min_rows, max(r) AS max_rows, avg(r) AS mean_rows, median(r) AS median_rows, min(c) AS min_cols, max(c) AS max_cols, avg(c) AS mean_cols, median(c) AS median_cols, min(u) AS min_items, max(u) AS max_items, avg(u) AS mean_items, median(u) AS median_items, count(*) FILTER (r <= 10) AS small, count(*) FILTER (r > 10 AND r <= 18) AS medium, count(*) FILTER (r > 18) AS large FROM l",
    "variation_counts": f"WITH v AS (SELECT {_choice(_u('o_orderkey', chr(39) + 'v' + chr(39)), generate.VARIATIONS)} AS variation FROM orders) SELECT variation, count(*) AS datasets, count(*) / (SELECT count(*) FROM v) AS share FROM v GROUP BY variation",
    "source_counts": "SELECT o_orderstatus, count(*) AS datasets, count(*) / (SELECT count(*) FROM orders) AS share FROM orders GROUP BY o_orderstatus",
    "dataset_names": f"WITH l AS (SELECT *, row_number() OVER (ORDER BY k) + 7 AS i FROM ({_LOG})) SELECT k AS o_custkey, i AS dataset_idx, 'ds_' || CASE WHEN i < 10000 THEN lpad(CAST(i AS VARCHAR), 4, '0') ELSE CAST(i AS VARCHAR) END || '_' || r || 'x' || c || '_' || left(sha256(CAST(k AS VARCHAR)), 8) || '.csv' AS filename FROM l",
    "generation_log": f"WITH o AS ({_ORDERS}) SELECT dataset_id, count(*) AS num_transactions, CAST(3 AS INT) AS actual_cols, 3 * count(*) AS total_items, count(DISTINCT a) + count(DISTINCT b) + 1 AS unique_items FROM o GROUP BY dataset_id",
    "topped_up": f"""WITH o AS (SELECT dataset_id, row_no, a || '|' || b || '|kind:order' AS items, row_number() OVER (PARTITION BY dataset_id ORDER BY row_no) AS r, count(*) OVER (PARTITION BY dataset_id) AS n FROM ({_CUSTOMERS})),
        k AS (SELECT dataset_id, n, unnest(range(1, 13 - n)) AS k FROM (SELECT DISTINCT dataset_id, n FROM o WHERE n < 12)), p AS (SELECT *, 1 + floor({_u('dataset_id', 'k')} * n)::BIGINT AS r FROM k)
        SELECT dataset_id, CAST(row_no AS BIGINT) AS row_no, items FROM o UNION ALL SELECT p.dataset_id, p.n + p.k, items FROM p JOIN o ON o.dataset_id = p.dataset_id AND o.r = p.r""",
    "dataset_text": f"WITH o AS ({_CUSTOMERS}) SELECT dataset_id, count(*) AS n_rows, sha256(string_agg('Row ' || row_no || ': ' || a || ', ' || b || ', kind:order', chr(10) ORDER BY row_no)) AS sha FROM o GROUP BY dataset_id",
    "ground_truth_json": f"""WITH t AS (SELECT o_custkey AS dataset_id, item, count(*) AS n, string_agg('"Row' || row_no || '"', ',' ORDER BY 'Row ' || row_no) AS r FROM ({BRANDS}) JOIN orders ON o_orderkey = row_no GROUP BY ALL HAVING count(*) >= 3)
        SELECT dataset_id, count(*) AS n_itemsets, '[' || string_agg('{{"itemset":["' || item || '"],"count":' || n || ',"rows":[' || r || ']}}', ',' ORDER BY item) || ']' AS truth FROM t GROUP BY dataset_id""",
    "ledger_table": _RUNS + "SELECT CAST(id AS VARCHAR) AS id, llm_itemset_count, validation_passed, CASE WHEN id % 2 <> 0 THEN error_message END AS error_message, CASE WHEN id % 2 <> 0 THEN 'run ' || id END AS note FROM runs WHERE llm_model = 'click' AND timestamp >= TIMESTAMP '2024-01-02' AND timestamp <= TIMESTAMP '2024-01-05'",
    "ordered_itemsets": f"WITH b AS ({BRANDS}), i AS (SELECT CAST(1 AS BIGINT) AS size, item AS itemset, count(*) AS count FROM b GROUP BY item HAVING count(*) >= 3 UNION ALL SELECT 2, x.item || '|' || y.item, count(*) FROM b x JOIN b y ON x.row_no = y.row_no AND x.item < y.item GROUP BY ALL HAVING count(*) >= 3) SELECT * FROM i ORDER BY size, count DESC, replace(itemset, '|', ',')",
    "seeded_sample": "SELECT o_orderkey FROM orders ORDER BY sha256(o_orderkey || ':42'), o_orderkey LIMIT 30",
    "row_labels": "SELECT o_orderkey, 'Row ' || (o_orderkey + 1) AS label FROM orders",
}
