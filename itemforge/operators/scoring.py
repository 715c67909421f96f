"""Scores of claimed against exact itemsets, by data set, by size and over all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemforge.functions.text import item_canon, itemset_set, safe_ratio, set_key
from itemforge.operators.claims import field, is_list, is_object, number, parse_json

GROUP = ["dataset_id"]


def keyed(itemsets: DataFrame, group: list[str] = GROUP) -> DataFrame:
    return itemsets.select(*group, set_key(itemset_set(F.col("itemset"))).alias("key"), F.size("itemset").alias("size"), "count")


def matched(truth: DataFrame, claims: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """(group, key, in_truth, in_claims): itemsets of both sides, each once."""
    a = keyed(truth, group).select(*group, "key").distinct().withColumn("in_truth", F.lit(True))
    b = keyed(claims, group).select(*group, "key").distinct().withColumn("in_claims", F.lit(True))
    both = a.join(b, [*group, "key"], "full_outer")
    return both.select(*group, "key", F.coalesce("in_truth", F.lit(False)).alias("in_truth"), F.coalesce("in_claims", F.lit(False)).alias("in_claims"))


def with_rates(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and exactness from tp, fp, fn."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    exact = (fp == 0) & (fn == 0) & (tp > 0)
    return counts.select("*", safe_ratio(tp, tp + fp).alias("precision"), safe_ratio(tp, tp + fn).alias("recall"), safe_ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), exact.alias("exact"))


def confusion(truth: DataFrame, claims: DataFrame, group: list[str] = GROUP) -> DataFrame:
    m = matched(truth, claims, group)
    return m.groupBy(*group).agg(F.count_if(F.col("in_truth") & F.col("in_claims")).alias("tp"), F.count_if(~F.col("in_truth")).alias("fp"), F.count_if(~F.col("in_claims")).alias("fn"))


def count_accuracy(truth: DataFrame, claims: DataFrame, tolerance: int = 1, group: list[str] = GROUP) -> DataFrame:
    """Share of claims on true itemsets (repeated ones count again) whose count is close enough."""
    a = keyed(truth, group).groupBy(*group, "key").agg(F.max("count").alias("true_count"))
    both = keyed(claims, group).join(a, [*group, "key"])
    n = both.groupBy(*group).agg(F.count_if(F.abs(F.col("count") - F.col("true_count")) <= tolerance).alias("good"), F.count("*").alias("all"))
    return n.select(*group, F.col("good").alias("correct_counts"), F.col("all").alias("matched_claims"), safe_ratio(F.col("good"), F.col("all")).alias("count_accuracy"))


def ungrounded(claims: DataFrame, vocabulary: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """(group, claims, ungrounded, ungrounded_rate): claims with an item that the data do not hold."""
    numbered = claims.select(*group, F.monotonically_increasing_id().alias("claim"), "itemset")
    items = numbered.select(*group, "claim", F.explode("itemset").alias("item")).select(*group, "claim", item_canon(F.col("item")).alias("item"))
    bad = items.join(vocabulary.select(*group, "item"), [*group, "item"], "left_anti").select(*group, "claim").distinct()
    n, b = claims.groupBy(*group).agg(F.count("*").alias("claims")), bad.groupBy(*group).agg(F.count("*").alias("ungrounded"))
    out = n.join(b, group, "left").withColumn("ungrounded", F.coalesce("ungrounded", F.lit(0)))
    return out.select(*group, "claims", "ungrounded", safe_ratio(F.col("ungrounded"), F.col("claims")).alias("ungrounded_rate"))


def by_size(truth: DataFrame, claims: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """(group, size, n_truth, n_claims, tp, ...): size is the length of the list as given."""
    a = keyed(truth, group).select(*group, "size", "key").distinct().withColumn("t", F.lit(1))
    b = keyed(claims, group).select(*group, "size", "key").distinct().withColumn("c", F.lit(1))
    n = a.join(b, [*group, "size", "key"], "full_outer").groupBy(*group, "size").agg(F.count("t").alias("n_truth"), F.count("c").alias("n_claims"), F.count_if(F.col("t").isNotNull() & F.col("c").isNotNull()).alias("tp"))
    p, r = safe_ratio(F.col("tp"), F.col("n_claims")), safe_ratio(F.col("tp"), F.col("n_truth"))
    return n.select(*group, "size", "n_truth", "n_claims", "tp", p.alias("precision"), r.alias("recall"), safe_ratio(2 * F.col("tp"), F.col("n_claims") + F.col("n_truth")).alias("f1"))


def compared(truth: DataFrame, claims: DataFrame, tolerance: int = 1, group: list[str] = GROUP) -> DataFrame:
    """``confusion`` and ``count_accuracy`` by one join, so that either side is computed once."""
    a = keyed(truth, group).groupBy(*group, "key").agg(F.max("count").alias("true_count"), F.lit(True).alias("in_truth"))
    b = keyed(claims, group).groupBy(*group, "key").agg(F.collect_list(F.struct("count")).alias("said"))
    both = a.join(b, [*group, "key"], "full_outer")
    hit = F.col("in_truth").isNotNull() & F.col("said").isNotNull()
    close = F.filter("said", lambda c: F.abs(c["count"] - F.col("true_count")) <= tolerance)
    n = both.groupBy(*group).agg(
        F.count_if(hit).alias("tp"), F.count_if(F.col("in_truth").isNull()).alias("fp"), F.count_if(F.col("said").isNull()).alias("fn"),
        F.coalesce(F.sum(F.when(hit, F.size(close))), F.lit(0)).alias("correct_counts"), F.coalesce(F.sum(F.when(hit, F.size("said"))), F.lit(0)).alias("matched_claims"),
    )
    return n.withColumn("count_accuracy", safe_ratio(F.col("correct_counts"), F.col("matched_claims")))


def metrics(truth: DataFrame, claims: DataFrame, vocabulary: DataFrame, tolerance: int = 1) -> DataFrame:
    """One row for each data set with truth or claims."""
    out = with_rates(compared(truth, claims, tolerance)).join(ungrounded(claims, vocabulary), GROUP, "left")
    return out.fillna(0, ["ungrounded_rate", "claims", "ungrounded"])


def summary(measured: DataFrame) -> DataFrame:
    """Averages over the data sets, one row. ``measured`` may carry parse_ok, think and seconds."""
    have = set(measured.columns)
    extra = [F.avg(F.col(c).cast("double")).alias(n) for c, n in (("parse_ok", "json_parse_rate"), ("think", "think_rate"), ("seconds", "avg_seconds")) if c in have]
    return measured.agg(F.count("*").alias("datasets"), *[F.avg(c).alias(f"avg_{c}") for c in ("precision", "recall", "f1", "count_accuracy", "ungrounded_rate")], F.avg(F.col("exact").cast("double")).alias("exact_rate"), *extra)


def size_averages(sized: DataFrame) -> DataFrame:
    """Averages by size over the data sets that have the size."""
    return sized.groupBy("size").agg(F.count("*").alias("datasets"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))


# Below this F1, or above this share of ungrounded claims, a data set is worth a look.
LOW_F1, MOST_UNGROUNDED = 0.5, 0.1


def triage(measured: DataFrame) -> DataFrame:
    """Data sets worth a look: low F1, unparsed, or ungrounded."""
    parse = F.col("parse_ok") if "parse_ok" in measured.columns else F.lit(True)
    return measured.where((F.col("f1") < LOW_F1) | ~parse | (F.col("ungrounded_rate") > MOST_UNGROUNDED))


# Acceptance targets.
TARGETS = {"f1": 0.80, "parse": 0.90, "ungrounded": 0.05}


def accepted(s: DataFrame) -> DataFrame:
    ok = (F.col("avg_f1") >= TARGETS["f1"]) & (F.col("json_parse_rate") >= TARGETS["parse"]) & (F.col("avg_ungrounded_rate") <= TARGETS["ungrounded"])
    return s.withColumn("passed", ok)


def differences(expected: DataFrame, predicted: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """(group, key, problem): missing, extra, wrong_count or wrong_rows; equal itemsets are left out."""
    a = expected.select(*group, set_key(itemset_set(F.col("itemset"))).alias("key"), F.col("count").alias("n"), F.array_sort("rows").alias("r"))
    b = predicted.select(*group, set_key(itemset_set(F.col("itemset"))).alias("key"), F.col("count").alias("m"), F.array_sort("rows").alias("q"))
    kind = F.when(F.col("m").isNull(), "missing").when(F.col("n").isNull(), "extra").when(F.col("n") != F.col("m"), "wrong_count").when(F.col("r") != F.col("q"), "wrong_rows")
    return a.join(b, [*group, "key"], "full_outer").select(*group, "key", kind.alias("problem")).where("problem IS NOT NULL")


# --- rewards of single completions --------------------------------------------------------------

# Steps of the format reward, length and bonus of the reasoning reward, and its words.
FULL_FORMAT, HALF_FORMAT, ANY_JSON = 1.0, 0.5, 0.2
THINKING_CHARS, THINKING_BONUS, THINKING_MARKS = 300, 0.2, "→|count|singles|pairs|✓"


def _records(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def _has(x: Column, name: str) -> Column:
    return F.coalesce(F.schema_of_variant(x).rlike(rf"(^OBJECT<|, )`?{name}`?:"), F.lit(False))


def format_reward(text: Column) -> Column:
    """1 for records with itemset, count and rows; 0.5 with itemset only; 0.2 for other JSON; 0 for none."""
    v = parse_json(text, "reward")
    items = _records(v)
    full = F.forall(items, lambda x: is_object(x) & _has(x, "itemset") & _has(x, "count") & _has(x, "rows"))
    half = F.forall(items, lambda x: is_object(x) & _has(x, "itemset"))
    return F.when(v.isNull(), 0.0).when(~is_list(v) | (F.size(items) == 0), ANY_JSON).when(full, FULL_FORMAT).when(half, HALF_FORMAT).otherwise(ANY_JSON)


def _sets(v: Column, canonical: bool) -> Column:
    def key(x: Column) -> Column:
        items = F.transform(field(x, "itemset"), lambda y: F.try_variant_get(y, "$", "string"))
        return set_key(itemset_set(items) if canonical else F.array_sort(F.array_distinct(items)))

    return F.array_distinct(F.transform(F.filter(_records(v), lambda x: is_object(x) & _has(x, "itemset")), key))


def f1_reward(text: Column, truth: Column, canonical: bool = False) -> Column:
    """F1 of the itemsets as written (or canonical); with an empty truth 1 for no claim and 0 else."""
    v, t = parse_json(text, "reward"), F.try_parse_json(truth)
    p, g = _sets(v, canonical), _sets(t, canonical)
    tp = F.size(F.array_intersect(p, g))
    return F.when(t.isNull() | v.isNull(), 0.0).when(F.size(g) == 0, F.when(F.size(p) == 0, 1.0).otherwise(0.0)).otherwise(safe_ratio(2 * tp, F.size(p) + F.size(g)))


def count_reward(text: Column, truth: Column) -> Column:
    """Share of claims on true itemsets with exactly the true count."""
    v, t = parse_json(text, "reward"), F.try_parse_json(truth)

    def pair(x: Column) -> Column:
        items = F.transform(F.coalesce(field(x, "itemset"), F.array().cast("array<variant>")), lambda y: F.try_variant_get(y, "$", "string"))
        return F.struct(set_key(F.array_sort(F.array_distinct(items))).alias("key"), number(F.try_variant_get(x, "$.count", "variant")).alias("n"))

    p = F.transform(F.filter(_records(v), is_object), pair)
    g = F.transform(F.filter(_records(t), lambda x: is_object(x) & _has(x, "itemset")), pair)
    hit = F.filter(p, lambda x: F.exists(g, lambda y: y.key == x.key))
    good = F.filter(hit, lambda x: F.exists(g, lambda y: (y.key == x.key) & y.n.eqNullSafe(x.n)))
    return F.when(t.isNull() | v.isNull(), 0.0).otherwise(safe_ratio(F.size(good), F.size(hit)))


def thinking_reward(text: Column) -> Column:
    """Grows with the length of the reasoning to 1 at 300 characters, 0.2 more with a mark of structure."""
    both = F.contains(text, F.lit("<think>")) & F.contains(text, F.lit("</think>"))
    think = F.split_part(F.element_at(F.split(text, "<think>", 2), -1), F.lit("</think>"), F.lit(1))
    score = F.least(F.lit(1.0), F.char_length(think) / THINKING_CHARS)
    more = F.least(F.lit(1.0), score + THINKING_BONUS)
    return F.when(both, F.when(F.lower(think).rlike(THINKING_MARKS), more).otherwise(score)).otherwise(0.0)


def format_gate(samples: DataFrame, col: str = "generated") -> DataFrame:
    """(samples, passed, pass_share): both think tags, a JSON list, and ``column:value`` items in its first records."""
    text = F.col(col)
    v = parse_json(text, "gate")
    lists = F.filter(_records(v), lambda x: is_object(x) & field(x, "itemset").isNotNull())
    tagged = F.exists(F.slice(lists, 1, 5), lambda x: F.exists(field(x, "itemset"), lambda y: F.coalesce(F.contains(F.try_variant_get(y, "$", "string"), F.lit(":")), F.lit(False))))
    ok = F.contains(text, F.lit("<think>")) & F.contains(text, F.lit("</think>")) & v.isNotNull() & F.coalesce(tagged, F.lit(False))
    return samples.agg(F.count("*").alias("samples"), F.count_if(ok).alias("passed"), safe_ratio(F.count_if(ok), F.count("*")).alias("pass_share"))

