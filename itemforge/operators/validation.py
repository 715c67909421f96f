"""Checks of itemset claims against the rows, as one table of errors and a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemforge.functions.text import itemset_canon, row_index, row_label, safe_ratio
from itemforge.operators.claims import as_text, field, is_integer, is_number, listed, number
from itemforge.operators.ranking import first_in_order
from itemforge.sources.tables import written

# Names of the errors.
TYPES = (
    "empty_itemset", "missing_rows", "malformed_row_label", "missing_count", "count_mismatch", "below_min_support",
    "unparseable_row_index", "row_out_of_range", "item_missing_in_row", "invalid_support_type", "support_mismatch", "duplicate_rows_listed", "llm_empty_output",
)
INVARIANTS = (
    "count == number of unique evidence rows",
    "each evidence row exists and contains all items",
    "support matches count/total_rows (Apriori)",
    "no itemset below min_support retained",
    "no malformed row labels",
)
KEYS = ["dataset_id", "source", "claim_idx"]


def listed_rows(claims: DataFrame, totals: DataFrame) -> DataFrame:
    """What the checks read of claims (dataset_id, source, claim_idx, rec variant): a row for each label that a claim lists, one for a claim that lists
    none; ``head`` marks one row of each claim. ``row_no`` is null and ``malformed`` the label where that holds no number. ``totals``: (dataset_id, total_rows).

    Written once to the shared folder: lists are taken apart in one pass, claim by claim, and what is read again are short rows.
    """
    rec, items, count, support = F.col("rec"), F.col("items"), F.col("count"), F.col("support")
    c = claims.join(totals, "dataset_id", "left").withColumn("total_rows", F.coalesce("total_rows", F.lit(0)))
    c = c.select(
        *KEYS, "total_rows", field(rec, "itemset").alias("items"), listed(rec, "rows", "evidence_rows").alias("listed"),
        F.try_variant_get("rec", "$.count", "variant").alias("count"), F.try_variant_get("rec", "$.support", "variant").alias("support"),
        F.coalesce(F.schema_of_variant("rec").contains("support:"), F.lit(False)).alias("has_support"), raw_itemset(rec).alias("raw_itemset"),
    )
    c = c.withColumn("complete", items.isNotNull() & F.col("listed").isNotNull())
    c = c.select(
        *KEYS, "raw_itemset", itemset_canon(F.transform("items", as_text)).alias("canon"), "total_rows", items.isNotNull().alias("named"), "complete", F.when(F.col("complete"), F.size("listed")).otherwise(0).alias("n_labels"),
        (count.isNull() | F.is_variant_null("count")).alias("null_count"), is_number(count).alias("counted"), is_integer(count).alias("whole"), number(count).alias("n"),
        "has_support", is_number(support).alias("supported"), number(support).alias("support"), F.when(F.col("complete"), F.col("listed")).alias("listed"),
    )
    each = c.select(*[x for x in c.columns if x != "listed"], F.posexplode_outer("listed").alias("at", "label"))
    each = each.withColumn("head", F.coalesce("at", F.lit(0)) == 0).withColumn("label", F.when(F.col("at").isNotNull(), as_text(F.col("label"))))
    each = each.withColumn("row_no", row_index(F.col("label")).cast("long")).withColumn("malformed", F.when(F.col("row_no").isNull(), F.col("label")))
    return written(each.drop("at", "label"), "claim-rows")


def raw_itemset(rec: Column) -> Column:
    """An itemset as written."""
    return F.to_json(F.coalesce(F.try_variant_get(rec, "$.itemset", "variant"), F.parse_json(F.lit("null"))))


def errors(claims: DataFrame, baskets: DataFrame, totals: DataFrame, min_support: int) -> DataFrame:
    """(dataset_id, source, claim_idx, raw_itemset, type, row_label, detail) of claims (dataset_id, source, claim_idx, rec variant)."""
    return errors_of_rows(listed_rows(claims, totals), baskets, min_support)


def errors_of_rows(checked: DataFrame, baskets: DataFrame, min_support: int) -> DataFrame:
    """``errors`` of what ``listed_rows`` gives.

    Claims of the same key, itemset as written and items are parts of one claim (a long list of rows comes in several texts): their rows
    are taken together, each once for every part that lists it, and their counts are added.
    One aggregate gives the errors that a claim shows by itself, one anti-join against the rows the items that a
    row lacks; rows stand singly, so no task holds all of a claim. An empty itemset or missing rows end the checks of a claim.
    """
    base, key = [*KEYS, "raw_itemset"], [*KEYS, "raw_itemset", "canon"]
    heads = checked.where("head")
    parts = heads.groupBy(*key).agg(
        F.bool_or("named").alias("named"), F.bool_or("complete").alias("ok"), F.sum("n_labels").alias("n_labels"), F.bool_or("null_count").alias("null_count"), F.bool_and("counted").alias("counted"),
        F.bool_and("whole").alias("whole"), F.sum("n").alias("n"), F.bool_or("has_support").alias("has_support"), F.bool_and("supported").alias("supported"), F.max("support").alias("support"), F.max("total_rows").alias("total_rows"),
    )
    rows, outside = checked.select(*key, "total_rows", "row_no").distinct(), (F.col("row_no") < 1) | (F.col("row_no") > F.col("total_rows"))
    within, out = rows.where(~outside), rows.where(outside)
    sizes = within.unionByName(out).groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.count("*").alias("distinct"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    whole = parts.join(sizes, same, "left").withColumn("distinct", F.coalesce("distinct", F.lit(0)).cast("int"))

    ok, n, distinct = F.col("ok"), F.col("n"), F.col("distinct")
    wrong = ~(F.col("counted") & n.eqNullSafe(distinct.cast("double")))
    exact = ok & (F.col("source") == "apriori") & F.col("has_support") & F.col("whole")
    expected = safe_ratio(distinct, F.col("total_rows"))
    none = F.lit(None)

    def error(kind: str, row=none, detail=none):
        return F.struct(F.lit(kind).alias("type"), row.cast("string").alias("row_label"), detail.cast("string").alias("detail"))

    single = [
        (~F.col("named"), error("empty_itemset")),
        (F.col("named") & ~ok, error("missing_rows")),
        (ok & F.col("null_count"), error("missing_count")),
        (ok & ~F.col("null_count") & wrong, error("count_mismatch", detail=distinct)),
        (ok & F.col("counted") & (n < min_support), error("below_min_support", detail=n)),
        (ok & (F.col("n_labels") != distinct), error("duplicate_rows_listed", detail=distinct)),
        (exact & ~F.col("supported"), error("invalid_support_type")),
        (exact & F.col("supported") & (F.abs(F.col("support") - expected) > 1e-6), error("support_mismatch", detail=expected)),
    ]
    once = F.filter(F.array(*[F.when(cond, e) for cond, e in single]), lambda e: e.isNotNull())
    of_claims = whole.select(*base, F.explode(once).alias("e")).select(*base, "e.*")
    of_labels = checked.where("malformed IS NOT NULL").select(*base, error("malformed_row_label", F.col("malformed")).alias("e")).select(*base, "e.*")
    beyond = out.select(*base, error("row_out_of_range", row_label(F.col("row_no")), F.col("total_rows")).alias("e")).select(*base, "e.*")

    asked = within.select(*key, "row_no", F.explode_outer("canon").alias("item")).where("item IS NOT NULL")
    missing = asked.join(baskets.select("dataset_id", "row_no", "item"), ["dataset_id", "row_no", "item"], "left_anti")
    missing = missing.groupBy(*key, "row_no").agg(F.array_sort(F.collect_list("item")).alias("items"))
    of_rows = missing.select(*base, F.lit("item_missing_in_row").alias("type"), row_label(F.col("row_no")).alias("row_label"), F.to_json("items").alias("detail"))
    return of_claims.unionByName(of_labels).unionByName(beyond).unionByName(of_rows).unionByName(empty_output(heads))


def empty_output(claims: DataFrame) -> DataFrame:
    """Data sets with exact itemsets but no claim of a model: nothing claimed must not pass as nothing wrong."""
    n = claims.groupBy("dataset_id").agg(F.count_if(F.col("source") == "apriori").alias("exact"), F.count_if(F.col("source") == "llm").alias("claimed"))
    hit = n.where("exact > 0 AND claimed = 0")
    none = F.lit(None)
    return hit.select("dataset_id", F.lit("llm").alias("source"), none.cast("int").alias("claim_idx"), none.cast("string").alias("raw_itemset"), F.lit("llm_empty_output").alias("type"), none.cast("string").alias("row_label"), F.col("exact").cast("string").alias("detail"))


def report(claims: DataFrame, found: DataFrame) -> DataFrame:
    """(dataset_id, source, total_itemsets, validated_itemsets, errors, valid_ratio).

    ``claims``: with ``rec``, or what ``listed_rows`` gives. A claim is valid if no claim with the same itemset as written has an error.
    """
    named = claims.where("head") if "head" in claims.columns else claims.withColumn("raw_itemset", raw_itemset(F.col("rec")))
    by = ["dataset_id", "source", "raw_itemset"]
    claimed = named.select(*KEYS, "raw_itemset").distinct().groupBy(*by).agg(F.count("*").alias("claimed"))
    both = claimed.join(found.groupBy(*by).agg(F.count("*").alias("n")), by, "full_outer")
    out = both.groupBy("dataset_id", "source").agg(F.sum("claimed").alias("total_itemsets"), F.sum(F.when(F.col("n").isNull(), F.col("claimed"))).alias("validated_itemsets"), F.sum("n").alias("errors"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total_itemsets", "validated_itemsets", "errors")]
    return out.select("dataset_id", "source", *zero, safe_ratio(F.col("validated_itemsets"), F.col("total_itemsets"), 6).alias("valid_ratio"))


def verdict(reported: DataFrame) -> DataFrame:
    """(dataset_id, validation_passed): no errors in either source."""
    return reported.groupBy("dataset_id").agg((F.sum("errors") == 0).alias("validation_passed"))


def first_errors(found: DataFrame, n: int = 3) -> DataFrame:
    """(dataset_id, source, errors): the first few errors, for a log; no more than these are ever gathered."""
    names = ["claim_idx", "type", "row_label", "detail"]
    few = first_in_order(found.select("dataset_id", "source", *names), [F.col(c) for c in names], ["dataset_id", "source"], n)
    return few.groupBy("dataset_id", "source").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("errors"))
