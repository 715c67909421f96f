"""Itemset claims: JSON in model text -> records -> normalised, re-based and merged claims.

Text arrives as a column and is untrusted.  It is parsed to VARIANT, so records of any shape can
stand side by side; types are tested on the value, never by casting.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemforge.functions.text import after_think, item_canon, row_index, strip

KEYS = ["dataset_id", "model"]
#: Characters at the start of a row's label by which long lists are sorted piece by piece: ``Row`` and three digits.
PIECE_CHARS = 7


def parsed(text: Column) -> Column:
    return F.try_parse_json(text)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_list(v: Column) -> Column:
    return F.coalesce(_kind(v).startswith("ARRAY"), F.lit(False))


def is_object(v: Column) -> Column:
    return F.coalesce(_kind(v).startswith("OBJECT"), F.lit(False))


def is_number(v: Column) -> Column:
    """Numbers and, as in Python, booleans."""
    return F.coalesce(_kind(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)"), F.lit(False))


def is_integer(v: Column) -> Column:
    return F.coalesce(_kind(v).isin("BIGINT", "BOOLEAN"), F.lit(False))


def number(v: Column) -> Column:
    b = F.try_variant_get(v, "$", "boolean")
    return F.when(_kind(v) == "BOOLEAN", b.cast("double")).when(is_number(v), F.try_variant_get(v, "$", "double"))


def as_text(v: Column) -> Column:
    """A scalar as Python would print it."""
    s = F.try_variant_get(v, "$", "string")
    whole = F.coalesce(_kind(v).rlike("^(DECIMAL|DOUBLE|FLOAT)"), F.lit(False)) & s.rlike(r"^-?\d+$")
    return F.when(v.isNull() | F.is_variant_null(v), "None").when(_kind(v) == "BOOLEAN", F.initcap(s)).when(whole, F.concat(s, F.lit(".0"))).otherwise(s)


def field(v: Column, *names: str) -> Column:
    """The first of the fields that is a non-empty list."""
    got = [F.try_variant_get(v, f"$.{n}", "array<variant>") for n in names]
    return F.coalesce(*[F.when(F.size(g) > 0, g) for g in got])


def truthy(v: Column) -> Column:
    """Whether Python would take a value for true."""
    kind = F.coalesce(_kind(v), F.lit("VOID"))
    text = F.try_variant_get(v, "$", "string")
    return F.when(kind.startswith("ARRAY"), F.size(F.try_variant_get(v, "$", "array<variant>")) > 0).when(kind.startswith("OBJECT"), kind != "OBJECT<>").when(kind == "STRING", text != "").when(is_number(v), number(v) != 0).otherwise(kind != "VOID")


def listed(v: Column, *names: str) -> Column:
    """The first of the fields that is not empty or false, if it is a list; null if it is anything else."""
    got = [F.try_variant_get(v, f"$.{n}", "variant") for n in names]
    out = F.when(F.lit(False), F.lit(None))
    for g in got:
        out = out.when(F.coalesce(truthy(g), F.lit(False)), F.when(is_list(g), F.try_variant_get(g, "$", "array<variant>")))
    return out


def _bracket(text: Column, lazy: bool = False) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?s)\[.*?\]" if lazy else r"(?s)\[.*\]", 0), F.lit(""))


def _list_of(text: Column) -> Column:
    v = parsed(text)
    return F.when(is_list(v), v)


def parse_json(text: Column, mode: str = "repair") -> Column:
    """VARIANT found in a text, or null.

    chunk: the text itself, else its widest bracket. repair: after the first closing think tag the
    text, then its widest bracket, then that of the whole text; lists only. each: both texts, direct
    and bracket in turn, lists only. gate: after the last tag direct, narrowest bracket, widest
    bracket, then the whole text; lists only. reward: widest bracket after the first tag, any value.
    """
    answer = strip(after_think(text))
    if mode == "chunk":
        return F.coalesce(parsed(text), parsed(_bracket(text)))
    if mode == "repair":
        return F.coalesce(_list_of(answer), _list_of(_bracket(answer)), _list_of(_bracket(text)))
    if mode == "each":
        return F.coalesce(_list_of(answer), _list_of(_bracket(answer)), _list_of(text), _list_of(_bracket(text)))
    if mode == "gate":
        answer = strip(after_think(text, last=True))
        return F.coalesce(_list_of(answer), _list_of(_bracket(answer, lazy=True)), _list_of(_bracket(answer)), _list_of(_bracket(text)))
    if mode == "reward":
        return parsed(_bracket(answer))
    raise ValueError(mode)


def lenient_json(text: Column) -> Column:
    """Standard JSON for texts that only Python's parser accepts (repeated keys, NaN); a pandas UDF for the rest that ``try_parse_json`` rejects."""
    @F.pandas_udf("string")
    def again(s: pd.Series) -> pd.Series:
        import json

        def one(x):
            try:
                return json.dumps(json.loads(x, parse_constant=lambda _: None), ensure_ascii=False)
            except (TypeError, ValueError):
                return None

        return s.map(one)

    return F.coalesce(F.when(parsed(text).isNotNull(), text), again(text))


def parse_claims(raw: DataFrame, mode: str = "repair", keep: tuple[str, ...] = ("dataset_id", "model", "chunk_no", "start", "end")) -> DataFrame:
    """(..., raw) -> (..., parse_ok, claim_idx, rec variant): one row per list element, and one with a null ``rec`` for a text without any."""
    v = raw.select(*keep, parse_json(F.col("raw"), mode).alias("v"))
    items = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array().cast("array<variant>"))
    return v.select(*keep, F.col("v").isNotNull().alias("parse_ok"), F.posexplode_outer(items).alias("claim_idx", "rec"))


def across_chunks(parsed_claims: DataFrame, keys: list[str]) -> DataFrame:
    """(..., claim_idx long, rec) of claims (..., chunk_no, claim_idx, rec): claims with the same itemset as written are parts of one, under the number of the first."""
    c = parsed_claims.withColumn("_at", F.shiftleft(F.col("chunk_no").cast("long"), 32) + F.col("claim_idx")).withColumn("_as", F.to_json(F.try_variant_get("rec", "$.itemset", "variant")))
    first = c.where("_as IS NOT NULL").groupBy(*keys, "_as").agg(F.min("_at").alias("_first"))
    return c.join(first, [*keys, "_as"], "left").select(*keys, F.coalesce("_first", "_at").alias("claim_idx"), "rec")


def row_labels(rows: Column) -> Column:
    """``Row n`` for labels and numbers; anything else as it is printed."""

    def one(r: Column) -> Column:
        s = as_text(r)
        return F.coalesce(F.concat(F.lit("Row "), row_index(s).cast("string")), s)

    return F.transform(rows, one)


def rebased(rows: Column, start: Column, end: Column) -> Column:
    """Row labels of a chunk of rows start+1..end, made absolute.

    With a row 0 and all within 0..length-1 they count from 0; without one, all within 1..length and
    the chunk lying beyond its own length, they count from 1. Labels without a number stay.
    """
    index = F.filter(F.transform(rows, lambda r: F.get(F.split(r, r"\s+"), 1).try_cast("int")), lambda i: i.isNotNull())
    length, first = end - start, start + 1
    zero = F.array_contains(index, 0) & F.forall(index, lambda i: (i >= 0) & (i < length))
    one = ~F.array_contains(index, 0) & F.forall(index, lambda i: (i >= 1) & (i <= length)) & F.exists(index, lambda i: i < first) & (first > length)
    shift = F.when(F.size(index) == 0, 0).when(zero, first).when(one, start).otherwise(0)

    def move(r: Column, shift: Column) -> Column:
        i = F.get(F.split(r, r"\s+"), 1).try_cast("int")
        return F.when(r.startswith("Row ") & i.isNotNull(), F.concat(F.lit("Row "), (i + shift).cast("string"))).otherwise(r)

    # bound once for a list: inside the inner function alone it would be found anew for every row
    return F.flatten(F.transform(F.array(shift), lambda k: F.transform(rows, lambda r: move(r, k))))


def chunk_claims(raw: DataFrame) -> DataFrame:
    """Claims of single chunks: (dataset_id, model, chunk_no, itemset, rows), canonical items, absolute rows."""
    c = parse_claims(raw, "chunk").where(is_object(F.col("rec")))
    c = c.withColumn("items", field(F.col("rec"), "itemset")).where("items IS NOT NULL")
    rows = F.coalesce(row_labels(field(F.col("rec"), "evidence_rows", "rows")), F.array().cast("array<string>"))
    itemset = F.array_sort(F.transform("items", lambda x: item_canon(as_text(x))))
    return c.select(*KEYS, "chunk_no", itemset.alias("itemset"), rebased(rows, F.col("start"), F.col("end")).alias("rows"))


def merged_pieces(claims: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(..., itemset, piece, n, rows): evidence of all chunks together, each row once; the rows of an itemset in pieces, by their first
    ``PIECE_CHARS`` characters. Pieces in order, and the rows of each, are in text order."""
    each = claims.select(*keys, "itemset", F.explode("rows").alias("row")).withColumn("piece", F.substring("row", 1, PIECE_CHARS))
    return each.groupBy(*keys, "itemset", "piece").agg(F.sort_array(F.collect_set("row")).alias("rows")).withColumn("n", F.size("rows").cast("long"))


def merge_chunks(claims: DataFrame, min_support: int, keys: list[str] = KEYS) -> DataFrame:
    """(..., itemset, count, rows): evidence of all chunks together, each row once, in text order, with enough support."""
    merged = merged_pieces(claims, keys).groupBy(*keys, "itemset").agg(F.sum("n").alias("count"), F.sort_array(F.collect_list(F.struct("piece", "rows"))).alias("pieces"))
    return merged.where(F.col("count") >= min_support).select(*keys, "itemset", "count", F.flatten("pieces.rows").alias("rows"))


def merge_chunk_texts(claims: DataFrame, min_support: int, keys: list[str] = KEYS) -> DataFrame:
    """(..., itemset, count, rows): as ``merge_chunks``, with the rows as one text, joined by commas piece by piece before they meet."""
    texts = merged_pieces(claims, keys).select(*keys, "itemset", "n", F.struct("piece", F.array_join("rows", ",").alias("text")).alias("part"))
    merged = texts.groupBy(*keys, "itemset").agg(F.sum("n").alias("count"), F.sort_array(F.collect_list("part")).alias("parts"))
    return merged.where(F.col("count") >= min_support).select(*keys, "itemset", "count", F.array_join("parts.text", ",").alias("rows"))


def scored_labels(rows: Column) -> Column:
    """Labels ``Row n...`` as they are, numbers and texts of whole numbers as labels; anything else goes."""

    def one(r: Column) -> Column:
        s, kind = as_text(r), F.coalesce(_kind(r), F.lit("VOID"))
        whole = F.when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(r, "$", "double").cast("long").cast("string")).when(kind == "STRING", strip(s).try_cast("long").cast("string"))
        return F.when(kind.isin("BIGINT", "BOOLEAN"), F.concat(F.lit("Row "), s)).when((kind == "STRING") & s.rlike(r"^Row \d"), s).otherwise(F.concat(F.lit("Row "), whole))

    return F.filter(F.transform(rows, one), lambda x: x.isNotNull())


def scoring_claims(parsed_claims: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(..., claim_idx, itemset, count, rows) for scoring: objects with a non-empty itemset.

    Items are canonical and sorted (blank and repeated ones stay), rows are those of ``rows`` alone, each
    label once and without those that are no row, and a count that is no integer is 0.
    """
    c = parsed_claims.where(is_object(F.col("rec"))).withColumn("items", field(F.col("rec"), "itemset")).where("items IS NOT NULL")
    n = F.try_variant_get("rec", "$.count", "variant")
    rows = F.coalesce(scored_labels(F.try_variant_get("rec", "$.rows", "array<variant>")), F.array().cast("array<string>"))
    return c.select(*keys, "claim_idx", F.array_sort(F.transform("items", lambda x: item_canon(as_text(x)))).alias("itemset"), F.when(is_integer(n), number(n).cast("long")).otherwise(F.lit(0)).alias("count"), F.array_sort(F.array_distinct(rows)).alias("rows"))


def normal_record(rec: Column) -> Column:
    """JSON text of a record with the usual names of its fields."""
    itemset = F.coalesce(field(rec, "itemset"), field(rec, "items"), F.array().cast("array<variant>"))
    rows = F.coalesce(row_labels(field(rec, "rows", "evidence_rows", "evidence_transactions")), F.array().cast("array<string>"))
    count = F.coalesce(F.try_variant_get(rec, "$.count", "long"), F.lit(0))
    return F.to_json(F.struct(F.transform(itemset, as_text).alias("itemset"), count.alias("count"), rows.alias("rows")))


def extract(chunks: DataFrame, extractor) -> DataFrame:
    """Hook for a model: ``extractor`` maps batches of (dataset_id, model, chunk_no, start, end, text) to raw text."""

    def run(batches):
        for pdf in batches:
            yield pdf.drop(columns="text").assign(raw=extractor(pdf))

    return chunks.mapInPandas(run, "dataset_id string, model string, chunk_no int, start int, end int, raw string")
