"""Training records from exact itemsets and failed claims: reasoning text, chat messages, pairs, budgets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemforge.functions.text import row_label, token_estimate
from itemforge.operators.claims import normal_record
from itemforge.operators.generate import shares
from itemforge.operators.profiling import diversity

# The instructions that the records carry.
SYSTEM_PROMPT = (
    "You are a frequent itemset extractor. Given CSV transaction data and a "
    "minimum support count, identify all itemsets whose items co-occur in at "
    "least that many rows.\n\n"
    "Rules:\n"
    "1. Scan single items, pairs, and triples (up to size 3)\n"
    "2. Count = number of distinct rows containing ALL items in the itemset\n"
    "3. Only report itemsets with count >= min_support\n"
    "4. Canonicalize items: lowercase, trimmed, sorted alphabetically\n"
    "5. Row references: \"Row N\" format, 1-based indexing\n\n"
    "Think step by step inside <think> tags, then output ONLY a JSON array:\n"
    '[{"itemset": ["item1", "item2"], "count": N, "rows": ["Row 1", "Row 3"]}]'
)
SFT_TOKENS, PAIR_TOKENS, PAIRS_PER_DATASET = 1800, 3800, 3


def user_message(text: Column, min_support: Column) -> Column:
    return F.concat(F.lit("Find all frequent itemsets with minimum support count = "), min_support.cast("string"), F.lit(" in this dataset:\n\n"), text)


def chunk_message(rows: Column) -> Column:
    """Rows of a chunk as JSON, keyed by label: an array of structs (row_no, items)."""
    return F.to_json(F.map_from_entries(F.transform(rows, lambda r: F.struct(row_label(r.row_no), r["items"]))))


def dataset_text(transactions: DataFrame) -> DataFrame:
    """(dataset_id, text, n_rows): lines ``Row n: a, b`` in row order."""
    line = F.concat(row_label(F.col("row_no")), F.lit(": "), F.array_join("items", ", "))
    rows = F.sort_array(F.collect_list(F.struct("row_no", line.alias("line"))))
    return transactions.groupBy("dataset_id").agg(F.array_join(F.transform(rows, lambda r: r.line), "\n").alias("text"), F.count("*").alias("n_rows"))


def truth_json(itemsets: DataFrame) -> DataFrame:
    """(dataset_id, ground_truth): JSON array of itemset, count and labels in text order."""
    rec = F.struct(F.col("itemset"), F.col("count"), F.sort_array(F.transform("rows", row_label)).alias("rows"))
    ordered = F.sort_array(F.collect_list(F.struct("size", "itemset", rec.alias("rec"))))
    return itemsets.groupBy("dataset_id").agg(F.to_json(F.transform(ordered, lambda x: x.rec)).alias("ground_truth"), F.count("*").alias("n_itemsets"))


def _evidence(rows: Column, shown: int) -> Column:
    head = F.array_join(F.transform(F.slice(rows, 1, shown), lambda r: F.concat(F.lit("R"), F.substring(r, 5, 20))), ", ")
    return F.when(F.size(rows) > shown, F.concat(head, F.lit(" +"), (F.size(rows) - shown).cast("string"), F.lit("more"))).otherwise(head)


def _listing(values: Column, shown: int) -> Column:
    head = F.array_join(F.slice(values, 1, shown), ", ")
    return F.when(F.size(values) > shown, F.concat(head, F.lit(" (+"), (F.size(values) - shown).cast("string"), F.lit(" more)"))).otherwise(head)


def reasoning(itemsets: DataFrame, shapes: DataFrame) -> DataFrame:
    """(dataset_id, cot): the compact reasoning text.

    ``itemsets``: as mined with evidence; ``shapes``: (dataset_id, n_rows, n_cols, min_support).
    Singles stand by column prefix, pairs and triples by falling count; ties are in itemset order.
    """
    labels = F.sort_array(F.transform("rows", row_label))
    x = itemsets.select("dataset_id", "size", "itemset", "count", labels.alias("rows")).join(shapes, "dataset_id")
    name = F.get("itemset", 0)
    mark = F.when(F.col("count") >= F.col("min_support"), "✓").otherwise("✗")
    single = F.concat(name, F.lit("="), F.col("count").cast("string"), F.lit("("), _evidence(F.col("rows"), 5), F.lit(")"), mark)
    items = F.array_join("itemset", ",")
    larger = F.concat(F.lit("  ("), items, F.lit(")="), F.col("count").cast("string"), F.lit("("), _evidence(F.col("rows"), 4), F.lit(")✓"))
    x = x.withColumns({"col": F.split_part(name, F.lit(":"), F.lit(1)), "line": F.when(F.col("size") == 1, single).otherwise(larger), "word": F.when(F.col("size") == 1, name).otherwise(F.concat(F.lit("{"), items, F.lit("}"))), "order": F.when(F.col("size") == 1, 0).otherwise(-F.col("count"))})
    each = F.sort_array(F.collect_list(F.struct("size", "order", "itemset", "col", "line", "word", "count")))
    g = x.groupBy("dataset_id").agg(F.first("n_rows").alias("n_rows"), F.first("n_cols").alias("n_cols"), F.first("min_support").alias("ms"), each.alias("all"))
    g = shapes.join(g.select("dataset_id", "all"), "dataset_id", "left").withColumn("all", F.coalesce("all", F.filter(F.array(F.lit(None).cast(g.schema["all"].dataType.elementType)), lambda v: v.isNotNull())))

    def of(k: int) -> Column:
        return F.filter("all", lambda v: v["size"] == k)

    ones, twos, threes = of(1), of(2), of(3)
    cols = F.array_distinct(F.transform(ones, lambda v: v.col))
    grouped = F.transform(cols, lambda c: F.concat(F.lit("  "), F.array_join(F.transform(F.filter(ones, lambda v: v.col == c), lambda v: v.line), " | ")))
    frequent = F.transform(F.filter(ones, lambda v: v["count"] >= F.col("min_support")), lambda v: v.word)

    def n(c: Column) -> Column:
        return F.size(c).cast("string")

    head = F.concat(F.lit("Dataset: "), F.col("n_rows").cast("string"), F.lit(" rows, "), F.col("n_cols").cast("string"), F.lit(" cols. min_support="), F.col("min_support").cast("string"), F.lit(".\n"))
    part1 = F.when(F.size(ones) > 0, F.concat(F.lit("SINGLES SCAN:\n"), F.array_join(grouped, "\n"), F.lit("\n\nFREQUENT SINGLES ["), n(frequent), F.lit("]: "), _listing(frequent, 20))).otherwise("SINGLES SCAN: none meet threshold")
    part2 = F.when(F.size(twos) > 0, F.concat(F.lit("\nPAIRS SCAN:\n"), F.array_join(F.transform(twos, lambda v: v.line), "\n"), F.lit("\n\nFREQUENT PAIRS ["), n(twos), F.lit("]: "), _listing(F.transform(twos, lambda v: v.word), 15))).otherwise("\nPAIRS SCAN: none meet threshold")
    part3 = F.when(F.size(threes) > 0, F.concat(F.lit("\nTRIPLES SCAN:\n"), F.array_join(F.transform(threes, lambda v: v.line), "\n"))).when(F.size(frequent) >= 3, "\nTRIPLES: none meet threshold")
    total = F.concat(F.lit("\nRESULT SUMMARY: "), n(ones), F.lit(" singles + "), n(twos), F.lit(" pairs + "), n(threes), F.lit(" triples = "), n(F.col("all")), F.lit(" frequent itemsets"))
    return g.select("dataset_id", F.concat_ws("\n", head, part1, part2, part3, total).alias("cot"))


def legacy_reasoning(itemsets: DataFrame, shapes: DataFrame, most: int = 40) -> DataFrame:
    """(dataset_id, cot): the older text, up to ``most`` itemsets listed with up to 15 labels each."""
    labels = F.array_sort(F.transform("rows", row_label))
    refs = F.when(F.size(labels) > 15, F.concat(F.array_join(F.slice(labels, 1, 15), ", "), F.lit(" (+"), (F.size(labels) - 15).cast("string"), F.lit(" more)"))).otherwise(F.array_join(labels, ", "))
    words = F.concat(F.lit("["), F.array_join(F.transform("itemset", lambda i: F.concat(F.lit('"'), i, F.lit('"'))), ", "), F.lit("]"))
    line = F.concat(F.lit("- "), words, F.lit(": "), refs, F.lit(" → "), F.col("count").cast("string"), F.lit(" ✓"))
    x = itemsets.select("dataset_id", "size", F.struct((-F.col("count")).alias("o"), "itemset", line.alias("line")).alias("v"))
    by = x.groupBy("dataset_id", "size").agg(F.array_sort(F.collect_list("v")).alias("v"))
    g = by.groupBy("dataset_id").agg(F.array_sort(F.collect_list(F.struct("size", "v"))).alias("sizes")).withColumn("total", F.aggregate("sizes", F.lit(0), lambda a, s: a + F.size(s.v)))
    g = shapes.join(g, "dataset_id").withColumn("long", F.col("total") > most)
    start = F.struct(F.lit(0).alias("shown"), F.lit("").alias("text"))

    def step(a: Column, s: Column) -> Column:
        label = F.when(s["size"] == 1, "Singles").when(s["size"] == 2, "Pairs").when(s["size"] == 3, "Triples").otherwise(F.concat(F.lit("Size-"), s["size"].cast("string")))
        budget = F.greatest(F.lit(3), F.floor((most - a.shown) / F.greatest(F.lit(1), F.size("sizes") - s["size"] + 1)).cast("int"))
        k = F.when(F.col("long"), F.least(budget, F.size(s.v))).otherwise(F.size(s.v))
        title = F.when(F.col("long"), F.concat(label, F.lit(" ("), F.size(s.v).cast("string"), F.lit(" found, showing top "), k.cast("string"), F.lit("):"))).otherwise(F.concat(label, F.lit(" (count≥"), F.col("min_support").cast("string"), F.lit("):")))
        rest = F.when(F.col("long") & (F.size(s.v) > k), F.concat(F.lit("\n  ... and "), (F.size(s.v) - k).cast("string"), F.lit(" more "), F.lower(label))).otherwise("")
        return F.struct((a.shown + k).alias("shown"), F.concat(a.text, title, F.lit("\n"), F.array_join(F.transform(F.slice(s.v, F.lit(1), k), lambda v: v.line), "\n"), rest, F.lit("\n\n")).alias("text"))

    body = F.aggregate("sizes", start, step).text
    head = F.concat(F.lit("Dataset: "), F.col("n_rows").cast("string"), F.lit(" rows × "), F.col("n_cols").cast("string"), F.lit(" columns, min_support="), F.col("min_support").cast("string"), F.lit("\n\n"))
    note = F.when(F.col("long"), F.concat(F.lit("Scanning for frequent items and combinations... ("), F.col("total").cast("string"), F.lit(" total found)\n\n"))).otherwise("")
    return g.select("dataset_id", F.concat(head, note, body, F.lit("Found "), F.col("total").cast("string"), F.lit(" frequent itemsets total.")).alias("cot"))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def answer(cot: Column, truth: Column) -> Column:
    return F.concat(F.lit("<think>\n"), cot, F.lit("\n</think>\n"), truth)


def sft_records(texts: DataFrame, cots: DataFrame, truths: DataFrame, shapes: DataFrame, max_tokens: int = SFT_TOKENS) -> DataFrame:
    """(dataset_id, messages, ground_truth, metadata) within the token budget."""
    x = texts.join(cots, "dataset_id").join(truths, "dataset_id").join(shapes.select("dataset_id", "min_support"), "dataset_id")
    user, reply = user_message(F.col("text"), F.col("min_support")), answer(F.col("cot"), F.col("ground_truth"))
    tokens = token_estimate(F.concat(F.lit(SYSTEM_PROMPT), user, reply))
    x = x.withColumn("tokens", tokens).where(F.col("tokens") <= max_tokens)
    messages = F.array(message("system", F.lit(SYSTEM_PROMPT)), message("user", user), message("assistant", reply))
    return x.select("dataset_id", messages.alias("messages"), "ground_truth", F.struct("min_support", "n_rows", "n_itemsets", "tokens").alias("metadata"))


def rejected_json(claims: DataFrame) -> DataFrame:
    """(dataset_id, model, rejected, n_rejected) from parsed claims (..., claim_idx, rec)."""
    each = F.array_sort(F.collect_list(F.struct("claim_idx", normal_record(F.col("rec")).alias("j"))))
    g = claims.where("rec IS NOT NULL").groupBy("dataset_id", "model").agg(each.alias("e"))
    return g.select("dataset_id", "model", F.concat(F.lit("["), F.array_join(F.transform("e", lambda v: v.j), ", "), F.lit("]")).alias("rejected"), F.size("e").alias("n_rejected"))


# Why a failed answer gives no pair.
SKIPS = ("missing", "tokens", "limit")


def judged_rejects(prompts: DataFrame, rejects: DataFrame, max_tokens: int = PAIR_TOKENS, per_dataset: int = PAIRS_PER_DATASET) -> DataFrame:
    """Every reject with its prompt and ``skip``: missing (no prompt of its data set), tokens (over the budget), limit (the data set has its pairs), or null.

    The budget is the prompt plus the longer answer; the cap counts accepted pairs, by model name.
    """
    x = rejects.join(prompts, "dataset_id", "left").withColumn("user", user_message(F.col("text"), F.col("min_support")))
    tokens = token_estimate(F.concat(F.lit(SYSTEM_PROMPT), F.col("user"))) + F.greatest(token_estimate(F.col("chosen")), token_estimate(F.col("rejected")))
    x = x.withColumn("tokens", tokens)
    x = x.withColumn("skip", F.when(F.col("chosen").isNull(), SKIPS[0]).when(F.col("tokens") > max_tokens, SKIPS[1]))
    w = Window.partitionBy("dataset_id", F.col("skip").isNull()).orderBy("model")
    return x.withColumn("skip", F.when(F.col("skip").isNull() & (F.row_number().over(w) > per_dataset), SKIPS[2]).otherwise(F.col("skip")))


def skip_counts(judged: DataFrame) -> DataFrame:
    """One row: pairs made, and rejects left out for each reason."""
    return judged.agg(F.count_if(F.col("skip").isNull()).alias("pairs"), *[F.count_if(F.col("skip") == k).alias(f"skipped_{k}") for k in SKIPS])


def preference_pairs(prompts: DataFrame, rejects: DataFrame, max_tokens: int = PAIR_TOKENS, per_dataset: int = PAIRS_PER_DATASET) -> DataFrame:
    """(prompt, chosen, rejected, metadata): ``prompts`` (dataset_id, text, min_support, chosen, n_itemsets), ``rejects`` (dataset_id, model, rejected, n_rejected)."""
    x = judged_rejects(prompts, rejects, max_tokens, per_dataset).where("skip IS NULL")
    meta = F.struct("dataset_id", F.col("model").alias("rejected_model"), F.lit("real_failure").alias("rejected_type"), F.col("n_itemsets").alias("n_itemsets_gt"), F.col("n_rejected").alias("n_itemsets_rejected"))
    return x.select(F.array(message("system", F.lit(SYSTEM_PROMPT)), message("user", F.col("user"))).alias("prompt"), F.array(message("assistant", F.col("chosen"))).alias("chosen"), F.array(message("assistant", F.col("rejected"))).alias("rejected"), meta.alias("metadata"))


def _side(texts: DataFrame, name: str) -> DataFrame:
    """Diversity of a column of texts, its columns named after the side."""
    d = diversity(texts)
    return d.select(*[F.col(c).alias(f"{name}_{c}") for c in d.columns])


def _beside(parts: list[DataFrame]) -> DataFrame:
    """One row of several one-row tables: laid over each other and taken together, so nothing is joined."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def export_statistics(records: DataFrame) -> DataFrame:
    """One row on exported records: examples, tokens, itemsets, and how much the answers differ."""
    m = F.col("metadata")
    stats = [f(m[c]).alias(f"{n}_{c}") for c in ("tokens", "n_itemsets") for f, n in ((F.min, "min"), (F.max, "max"), (lambda x: F.round(F.avg(x), 1), "avg"))]
    return _beside([records.agg(F.count("*").alias("examples"), *stats), _side(records.select(F.element_at("messages", -1).content.alias("text")), "assistant")])


def pair_statistics(pairs: DataFrame) -> DataFrame:
    """One row on exported pairs: pairs, data sets, pairs a data set, and how much either side differs."""
    n, sets = F.count("*"), F.countDistinct("metadata.dataset_id")
    base = pairs.agg(n.alias("pairs"), sets.alias("unique_datasets"), F.round(n / F.greatest(sets, F.lit(1)), 2).alias("avg_pairs_per_dataset"))
    return _beside([base, *[_side(pairs.select(F.col(c)[0].content.alias("text")), c) for c in ("chosen", "rejected")]])


def rejected_models(pairs: DataFrame) -> DataFrame:
    """(rejected_model, pairs, share), the most first."""
    out = shares(pairs.select(F.col("metadata.rejected_model").alias("rejected_model")), "rejected_model")
    return out.withColumnRenamed("datasets", "pairs")


def evaluation_records(texts: DataFrame, truths: DataFrame, settings: DataFrame) -> DataFrame:
    """Evaluation sets as flat records: ``settings`` (dataset_id, filename, n_cols, source, min_support, max_size, size_category, hash)."""
    x = settings.join(texts.select("dataset_id", F.col("text").alias("csv_text"), "n_rows"), "dataset_id").join(truths, "dataset_id", "left")
    return x.select(
        F.col("dataset_id").alias("id"), "filename", "csv_text", F.coalesce("ground_truth", F.lit("[]")).alias("ground_truth"), "n_rows", "n_cols", F.coalesce("n_itemsets", F.lit(0).cast("long")).alias("n_itemsets"), "source", "min_support", "max_size", "size_category", "hash",
    )


def within_tokens(records: DataFrame, text: Column, most: int, tokenizer=None) -> DataFrame:
    """Records of at most so many tokens, estimated or counted by ``tokenizer`` (texts -> counts) in a pandas UDF."""
    if tokenizer is None:
        return records.where(token_estimate(text) <= most)
    @F.pandas_udf("long")
    def count(s: pd.Series) -> pd.Series:
        return pd.Series(tokenizer(s.fillna("").tolist()))

    return records.where(count(text) <= most)


def over_limit(records: DataFrame, tokens: Column, most: int) -> DataFrame:
    return records.agg(F.count("*").alias("records"), F.count_if(tokens > most).alias("over_limit"), F.max(tokens).alias("longest"))
