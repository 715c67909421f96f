"""Derived data sets: subsamples, noise, shuffles and weighted baskets, all drawn by hashes.

A draw is a function of the row's key and a seed, so a rerun, a retry or another partitioning gives
the same rows. ``transactions``: (dataset_id, row_no, items).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemforge.functions.text import safe_ratio, short_hash
from itemforge.operators.quantiles import quantiles
from itemforge.operators.ranking import first_in_order, place_in_order
from itemforge.sources.readers import numbered

# Shares of the kinds of variation and of the sizes, and size ranges of rows.
VARIATIONS = (("row_subsample", 0.25), ("col_subsample", 0.20), ("combined_subsample", 0.25), ("shuffle_only", 0.15), ("add_noise", 0.15))
SIZES = (("small", 0.4), ("medium", 0.4), ("large", 0.2))
NOISE_RATIO = 0.15
MOST_ITEMS = 15


def uniform(*keys: Column, seed: int = 42) -> Column:
    """A number in [0, 1) from a hash of the keys (SHA-256, so that other engines can repeat it)."""
    text = F.concat_ws(":", *[k.cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.left(F.sha2(text.cast("binary"), 256), F.lit(12)), 16, 10).cast("double") / float(1 << 48)


def choice(u: Column, options) -> Column:
    """The option in whose cumulative share ``u`` falls."""
    out, total = None, 0.0
    for name, share in options[:-1]:
        total += share
        out = (F.when if out is None else out.when)(u < total, name)
    return out.otherwise(options[-1][0])


def renumbered(df: DataFrame, *order: Column | str) -> DataFrame:
    """``row_no`` from 1 in each data set, of any size, in the order of columns."""
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    return place_in_order(df, by, ["dataset_id"], "_row_no").withColumn("row_no", F.col("_row_no")).drop("_row_no")


def row_subsample(transactions: DataFrame, rows: int | Column, seed: int = 42) -> DataFrame:
    """So many rows of each data set, in their order, numbered anew."""
    by = [uniform(F.col("dataset_id"), F.col("row_no"), seed=seed), F.col("row_no")]
    return renumbered(first_in_order(transactions, by, ["dataset_id"], rows), "row_no")


def prefixes(transactions: DataFrame) -> DataFrame:
    each = transactions.select("dataset_id", F.explode("items").alias("item")).where(F.contains("item", F.lit(":")))
    return each.select("dataset_id", F.split_part("item", F.lit(":"), F.lit(1)).alias("prefix")).distinct()


def with_prefixes(transactions: DataFrame, chosen: DataFrame) -> DataFrame:
    """Only items whose column prefix is chosen (dataset_id, prefix); rows left empty go."""
    each = transactions.select("dataset_id", "row_no", F.posexplode("items").alias("i", "item")).withColumn("prefix", F.split_part("item", F.lit(":"), F.lit(1)))
    kept = each.join(chosen, ["dataset_id", "prefix"], "left_semi").groupBy("dataset_id", "row_no").agg(F.array_sort(F.collect_list(F.struct("i", "item"))).alias("v"))
    return renumbered(kept.select("dataset_id", "row_no", F.transform("v", lambda x: x.item).alias("items")), "row_no")


def col_subsample(transactions: DataFrame, cols: int, seed: int = 42) -> DataFrame:
    """Items of so many column prefixes."""
    by = [uniform(F.col("dataset_id"), F.col("prefix"), seed=seed), F.col("prefix")]
    chosen = first_in_order(prefixes(transactions), by, ["dataset_id"], cols)
    return with_prefixes(transactions, chosen)


def combined_subsample(transactions: DataFrame, rows: int, cols: int, seed: int = 42) -> DataFrame:
    return row_subsample(col_subsample(transactions, cols, seed), rows, seed)


def shuffled(transactions: DataFrame, seed: int = 42) -> DataFrame:
    return renumbered(transactions, uniform(F.col("dataset_id"), F.col("row_no"), seed=seed), "row_no")


def add_noise(transactions: DataFrame, ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """max(1, rows * ratio) more rows of two to five items of the data set's vocabulary, at random places.

    Data sets with fewer than three different items stay as they are.
    """
    vocabulary = transactions.select("dataset_id", F.explode("items").alias("item")).distinct()
    shape = transactions.groupBy("dataset_id").agg(F.count("*").alias("rows")).join(vocabulary.groupBy("dataset_id").agg(F.count("*").alias("words")), "dataset_id").where("words >= 3")
    more = shape.withColumn("k", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.col("rows") * ratio).cast("int")))))
    width = F.least(F.lit(5), F.col("words")) - 1
    more = more.withColumn("n", (2 + F.floor(uniform(F.col("dataset_id"), F.col("k"), F.lit("n"), seed=seed) * width)).cast("int"))

    def draw(chosen: Column, j: Column) -> Column:
        """Floyd's sampling: a place up to the j-th last, or that one itself if the place is taken."""
        last = F.col("words") - F.col("n") + j
        place = F.floor(uniform(F.col("dataset_id"), F.col("k"), j, seed=seed) * (last + 1))
        return F.concat(chosen, F.array(F.when(F.array_contains(chosen, place), last).otherwise(place)))

    places = F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), F.array().cast("array<bigint>"), draw)
    ranked = place_in_order(vocabulary, [F.col("item")], ["dataset_id"], "_at").select("dataset_id", "item", (F.col("_at") - 1).cast("long").alias("_i"))
    drawn = more.withColumn("_i", F.explode(places)).join(ranked, ["dataset_id", "_i"])
    place = uniform(F.col("dataset_id"), F.col("k"), F.lit("p"), seed=seed) * F.col("rows")
    rows = drawn.groupBy("dataset_id", "k", "rows").agg(F.collect_list("item").alias("items")).select("dataset_id", place.alias("at"), "items")
    return renumbered(transactions.select("dataset_id", F.col("row_no").cast("double").alias("at"), "items").unionByName(rows), "at").select("dataset_id", "row_no", "items")


def topped_up(transactions: DataFrame, least: int, seed: int = 42) -> DataFrame:
    """Small data sets repeat drawn rows until they have ``least``."""
    n = transactions.groupBy("dataset_id").agg(F.count("*").alias("n"))
    need = n.where(F.col("n") < least).select("dataset_id", "n", F.explode(F.sequence(F.lit(1), F.lit(least) - F.col("n"))).alias("k"))
    need = need.withColumn("pick", (1 + F.floor(uniform(F.col("dataset_id"), F.col("k"), seed=seed) * F.col("n"))).cast("int"))
    small = transactions.join(n.where(F.col("n") < least).select("dataset_id"), "dataset_id", "left_semi")
    ranked = place_in_order(small, [F.col("row_no")], ["dataset_id"], "pick").withColumn("pick", F.col("pick").cast("int"))
    more = need.join(ranked, ["dataset_id", "pick"]).select("dataset_id", (F.col("n") + F.col("k")).alias("row_no"), "items")
    return transactions.select("dataset_id", F.col("row_no").cast("long").alias("row_no"), "items").unionByName(more)


def vary(transactions: DataFrame, kind: str, rows: int, cols: int, seed: int = 42) -> DataFrame:
    """One kind of variation, then shuffled."""
    if kind == "col_subsample":
        out = row_subsample(col_subsample(transactions, cols, seed), rows, seed)
    elif kind == "combined_subsample":
        out = combined_subsample(transactions, rows, cols, seed)
    elif kind == "add_noise":
        out = add_noise(row_subsample(transactions, rows - 2, seed), NOISE_RATIO, seed)
    elif kind in ("row_subsample", "shuffle_only"):
        out = row_subsample(transactions, rows, seed)
    else:
        raise ValueError(kind)
    return shuffled(out, seed)


def mix(ids: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """Adds kind and size class of a variation to each id."""
    return ids.withColumns({"variation": choice(uniform(F.col(id_col), F.lit("v"), seed=seed), VARIATIONS), "size_class": choice(uniform(F.col(id_col), F.lit("s"), seed=seed), SIZES)})


def weighted_baskets(datasets: DataFrame, pool: list[str], width: int, repeat: float = 0.7, seed: int = 42) -> DataFrame:
    """Rows of data sets (dataset_id, n_rows): ``width`` draws each, with share ``repeat`` from the pool with its first four items weighing three; repeated draws count once."""
    heavy = [p for i, p in enumerate(pool) for _ in range(3 if i < 4 else 1)]
    rows = datasets.withColumn("row_no", F.explode(F.sequence(F.lit(1), F.col("n_rows"))))
    each = F.array(*[F.lit(i) for i in range(width)])

    def draw(i: Column) -> Column:
        keys = (F.col("dataset_id"), F.col("row_no"), i)
        a = F.get(F.array(*map(F.lit, heavy)), F.floor(uniform(*keys, F.lit("a"), seed=seed) * len(heavy)).cast("int"))
        b = F.get(F.array(*map(F.lit, pool)), F.floor(uniform(*keys, F.lit("b"), seed=seed) * len(pool)).cast("int"))
        return F.when(uniform(*keys, F.lit("r"), seed=seed) < repeat, a).otherwise(b)

    return rows.select("dataset_id", "row_no", F.array_distinct(F.transform(each, draw)).alias("items"))


def split(rows: DataFrame, key: str, held: int = 10, seed: int = 42) -> DataFrame:
    """Adds ``split``: one in ``held`` rows is ``validation``, the others ``train``."""
    return rows.withColumn("split", F.when(uniform(F.col(key), seed=seed) < 1 / held, "validation").otherwise("train"))


def wide_rows(transactions: DataFrame, most: int = MOST_ITEMS) -> DataFrame:
    """(dataset_id, row_no, item_1 .. item_n): at most ``most`` items, padded with blanks."""
    cut = F.slice("items", 1, most)
    padded = F.concat(cut, F.array_repeat(F.lit(""), F.lit(most) - F.size(cut)))
    return transactions.select("dataset_id", "row_no", *[F.get(padded, i).alias(f"item_{i + 1}") for i in range(most)])


def csv_text(transactions: DataFrame, most: int = MOST_ITEMS) -> DataFrame:
    """(dataset_id, csv, hash): the wide file as text, as wide as its widest row, with a short hash of it."""
    w = F.least(F.lit(most), F.max(F.size("items")).over(Window.partitionBy("dataset_id")))
    quoted = F.transform(F.slice("items", 1, most), lambda x: F.when(x.rlike('[,"]'), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(x))
    line = F.array_join(F.concat(quoted, F.array_repeat(F.lit(""), F.col("w") - F.size(quoted))), ",")
    x = transactions.withColumn("w", w).select("dataset_id", "row_no", "w", line.alias("line"))
    g = x.groupBy("dataset_id").agg(F.first("w").alias("w"), F.array_sort(F.collect_list(F.struct("row_no", "line"))).alias("v"))
    head = F.array_join(F.transform(F.sequence(F.lit(1), F.col("w")), lambda i: F.concat(F.lit("item_"), i.cast("string"))), ",")
    g = g.select("dataset_id", F.concat(head, F.lit("\n"), F.array_join(F.transform("v", lambda v: v.line), "\n")).alias("csv"))
    return g.withColumn("hash", short_hash(F.col("csv"), 8))


def generation_log(transactions: DataFrame) -> DataFrame:
    """(dataset_id, num_transactions, actual_cols, total_items, unique_items)."""
    each = transactions.select("dataset_id", "row_no", F.size("items").alias("n"), F.explode_outer("items").alias("item"))
    return each.groupBy("dataset_id").agg(F.countDistinct("row_no").alias("num_transactions"), F.max("n").alias("actual_cols"), F.count("item").alias("total_items"), F.countDistinct("item").alias("unique_items"))


# Largest row counts of a small and of a medium data set.
SMALL_ROWS, MEDIUM_ROWS = 10, 18


def generation_statistics(log: DataFrame) -> DataFrame:
    """One row on generated data sets (num_transactions, actual_cols, unique_items): spread of sizes, and how many are small, medium and large.

    The medians are exact, found by histograms before the row is made; null without data sets.
    """
    r = F.col("num_transactions")
    sizes = (("rows", "num_transactions"), ("cols", "actual_cols"), ("items", "unique_items"))
    middle = {name: (q or [None])[0] for name, q in quantiles(log, {name: F.col(c) for name, c in sizes}, [0.5]).items()}
    spread = [x.alias(f"{n}_{name}") for name, c in sizes for n, x in (("min", F.min(c)), ("max", F.max(c)), ("mean", F.avg(c)), ("median", F.lit(middle[name]).cast("double")))]
    return log.agg(F.count("*").alias("datasets"), *spread, F.count_if(r <= SMALL_ROWS).alias("small"), F.count_if((r > SMALL_ROWS) & (r <= MEDIUM_ROWS)).alias("medium"), F.count_if(r > MEDIUM_ROWS).alias("large"))


def shares(log: DataFrame, by: str) -> DataFrame:
    """(by, datasets, share): how many data sets each variation, or each source, gave; the most first."""
    n = log.groupBy(by).agg(F.count("*").alias("datasets"))
    total = log.agg(F.count("*").alias("_total"))
    return n.join(F.broadcast(total)).select(by, "datasets", safe_ratio(F.col("datasets"), F.col("_total")).alias("share")).orderBy(F.desc("datasets"), by)


def dataset_names(log: DataFrame, existing: int = 0, order: str = "dataset_id") -> DataFrame:
    """Adds dataset_idx, which runs on from ``existing``, and filename ``ds_0001_RxC_hash.csv`` (num_transactions, actual_cols, hash)."""
    n = numbered(log, order).withColumn("dataset_idx", F.col("row_no") + existing).drop("row_no")
    number = F.when(F.col("dataset_idx") < 10_000, F.lpad(F.col("dataset_idx").cast("string"), 4, "0")).otherwise(F.col("dataset_idx").cast("string"))
    name = F.concat(F.lit("ds_"), number, F.lit("_"), F.col("num_transactions").cast("string"), F.lit("x"), F.col("actual_cols").cast("string"), F.lit("_"), F.left("hash", F.lit(8)), F.lit(".csv"))
    return n.withColumn("filename", name)
