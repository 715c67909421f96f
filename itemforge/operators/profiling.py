"""Diversity of texts, size bins, trends and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemforge.functions.text import normal_text, prefix_signature, safe_ratio
from itemforge.operators.quantiles import quantiles
from itemforge.operators.ranking import place_in_order


def _signatures(texts: DataFrame, col: str, chars: int) -> DataFrame:
    t = texts.select(F.col(col).alias("text")).where(normal_text(F.col("text")) != "")
    return t.select(F.char_length("text").alias("chars"), F.lower(normal_text(F.col("text"))).alias("whole"), prefix_signature(F.col("text"), chars).alias("prefix"))


def diversity(texts: DataFrame, col: str = "text", chars: int = 120) -> DataFrame:
    """One row on texts that are not blank: number, lengths, different texts and prefixes, collapse, extra copies.

    ``template_collapse_rate`` is the share of texts under any prefix that occurs more than once;
    ``duplicate_full_text_count`` counts the copies beyond the first of each text. Each kind of
    signature is counted by one aggregate, and the three rows are laid over each other.
    """
    s = _signatures(texts, col, chars)
    n = s.agg(F.count("*").alias("total_texts"), F.round(F.avg("chars"), 1).alias("avg_chars"), F.min("chars").cast("long").alias("min_chars"), F.max("chars").cast("long").alias("max_chars"))
    more = F.when(F.col("n") > 1, F.col("n"))
    whole = s.groupBy("whole").agg(F.count("*").alias("n")).agg(F.count("*").alias("wholes"), F.sum(more - 1).alias("duplicate_full_text_count"))
    prefix = s.groupBy("prefix").agg(F.count("*").alias("n")).agg(F.count("*").alias("prefixes"), F.sum(more).alias("repeated"), F.max("n").alias("most_common_prefix_count"))
    laid = n.unionByName(whole, allowMissingColumns=True).unionByName(prefix, allowMissingColumns=True)
    one = laid.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in laid.columns])

    def rate(c: str, name: str) -> Column:
        return safe_ratio(F.col(c), F.col("total_texts"), 4).alias(name)

    return one.select(
        "total_texts", "avg_chars", "min_chars", "max_chars", rate("wholes", "unique_full_text_rate"), rate("prefixes", "unique_prefix_rate"), rate("repeated", "template_collapse_rate"),
        "most_common_prefix_count", rate("most_common_prefix_count", "most_common_prefix_rate"), "duplicate_full_text_count",
    )


def top_prefixes(texts: DataFrame, k: int = 5, col: str = "text", chars: int = 120) -> DataFrame:
    """(prefix, count): the most frequent ones, ties by prefix."""
    return _signatures(texts, col, chars).groupBy("prefix").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "prefix").limit(k)


def bin_of(x: Column, edges: Column) -> Column:
    """Struct (lo, hi) of the right-closed bin of x, the lowest edge included; null outside. ``edges`` ascend."""
    at = F.filter(F.sequence(F.lit(1), F.size(edges) - 1), lambda i: (x <= F.get(edges, i)) & ((x > F.get(edges, i - 1)) | ((i == 1) & (x == F.get(edges, 0)))))
    i = F.get(at, 0)
    return F.when(i.isNotNull(), F.struct(F.get(edges, i - 1).alias("lo"), F.get(edges, i).alias("hi")))


def explicit_bins(df: DataFrame, col: str, edges: list[float], name: str = "size_bin") -> DataFrame:
    edges = sorted({float(e) for e in edges})
    if len(edges) < 2:
        raise ValueError("at least two edges are needed")
    return df.withColumn(name, bin_of(F.col(col), F.array(*map(F.lit, edges))))


def quantile_edges(df: DataFrame, col: str, q: int = 5) -> list[float]:
    """Distinct exact quantiles with linear interpolation; q + 1 numbers at most."""
    return sorted(set(quantiles(df, {"x": F.col(col)}, [i / q for i in range(q + 1)])["x"]))


def quantile_bins(df: DataFrame, col: str, q: int = 5, name: str = "size_bin") -> DataFrame:
    """Bins of about equal counts; of equal width if the quantiles collapse; null without values."""
    edges = quantile_edges(df, col, q)
    if not edges:
        return df.withColumn(name, F.lit(None).cast("struct<lo:double,hi:double>"))
    if len(edges) < 2:
        w = max(1.0, abs(edges[0]) * 0.001)
        edges = [edges[0] - w + 2 * w * i / q for i in range(q + 1)]
    return explicit_bins(df, col, edges, name)


def bin_means(df: DataFrame, *values: str, name: str = "size_bin") -> DataFrame:
    return df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("rows"), *[F.avg(v).alias(f"avg_{v}") for v in values])


def window_width(n: int) -> int:
    return max(3, int(n**0.5))


#: Rows of a range in which rolling means are taken at a time.
ROLLING = 100_000


def rolling_mean(df: DataFrame, value: str, order: list[str], width: int, group: list[str] | None = None, name: str = "smooth") -> DataFrame:
    """Centred mean over ``width`` rows, fewer at the ends; an even width has one row more before than after.

    Without groups rows are numbered and dealt to ranges of ``ROLLING`` rows, each with the few rows of its
    neighbours that its windows reach, so no task holds all rows.
    """
    before, after = width // 2, (width - 1) // 2
    if group:
        return df.withColumn(name, F.avg(value).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(-before, after)))
    n = place_in_order(df, [F.col(c) for c in order], [], "_n")
    first, last = F.floor((F.col("_n") - after) / ROLLING), F.floor((F.col("_n") + before) / ROLLING)
    each = n.withColumn("_range", F.explode(F.sequence(first, last)))
    w = Window.partitionBy("_range").orderBy("_n").rowsBetween(-before, after)
    return each.withColumn(name, F.avg(value).over(w)).where(F.floor(F.col("_n") / ROLLING) == F.col("_range")).drop("_n", "_range")


def largest(df: DataFrame, by: str, n: int = 60, tie: str = "dataset_name") -> DataFrame:
    return df.orderBy(F.desc(by), tie).limit(n)


def sampled(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by a seeded hash of their key."""
    return df.orderBy(F.sha2(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"), 256), key).limit(n)


def ordered(itemsets: DataFrame) -> DataFrame:
    """Size, then count (largest first), then text."""
    return itemsets.orderBy("size", F.desc("count"), F.array_join("itemset", ","))


def chart_inputs(runs: DataFrame, edges: list[float] | None = None, top: int = 60) -> dict[str, DataFrame]:
    """What the charts of a ledger show, as tables: counts of the largest data sets, means by size bin, the trend over size.

    ``runs``: dataset_name, dataset_area, apriori_itemset_count, llm_itemset_count, itemset_diff, percent_match.
    """
    binned = explicit_bins(runs, "dataset_area", edges) if edges else quantile_bins(runs, "dataset_area")
    sized = runs.where("dataset_area IS NOT NULL AND percent_match IS NOT NULL")
    trend = rolling_mean(sized.select("dataset_name", "dataset_area", "percent_match"), "percent_match", ["dataset_area", "dataset_name"], window_width(sized.count()))
    return {
        "grouped_counts": largest(runs.select("dataset_name", "dataset_area", "apriori_itemset_count", "llm_itemset_count"), "dataset_area", top),
        "diff_bins": bin_means(binned, "itemset_diff"),
        "percent_match_bins": bin_means(binned, "percent_match"),
        "percent_match_trend": trend,
        "summary": binned,
    }


# --- rankings -----------------------------------------------------------------------------------


# The heading of a vote, and how it names the answers.
RANKING, NUMBERED, NAMED = "FINAL RANKING:", r"\d+\.\s*(Response [A-Z])", r"(Response [A-Z])"


def parse_ranking(text: Column) -> Column:
    """Labels in order: numbered ones after ``FINAL RANKING:``, else any there, else any in the text."""
    tail = F.when(F.contains(text, F.lit(RANKING)), F.element_at(F.split(text, RANKING, 2), 2))
    numbered = F.regexp_extract_all(tail, F.lit(NUMBERED), F.lit(1))
    plain = F.regexp_extract_all(tail, F.lit(NAMED), F.lit(1))
    return F.when(F.size(numbered) > 0, numbered).when(tail.isNotNull(), plain).otherwise(F.regexp_extract_all(text, F.lit(NAMED), F.lit(1)))


def label_models(models: DataFrame) -> DataFrame:
    """(position from 0, model) -> (label, model): Response A, Response B, ..."""
    return models.select(F.concat(F.lit("Response "), F.char(F.col("position") + 65)).alias("label"), "model")


def aggregate_rankings(rankings: DataFrame, labels: DataFrame) -> DataFrame:
    """(model, average_rank, rankings_count): mean position over all votes, best first. ``rankings``: (ranking array)."""
    each = rankings.select(F.posexplode("ranking").alias("i", "label"))
    mean = F.round(F.avg(F.col("i") + 1), 2)
    return each.join(labels, "label").groupBy("model").agg(mean.alias("average_rank"), F.count("*").alias("rankings_count")).orderBy("average_rank", "model")
