"""Queries on baskets, supports, itemsets and sources, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.config import MiningConfig
from itemforge.functions.text import item_canon, itemset_key, prefix_signature, short_hash
from itemforge.operators import mining
from itemforge.sources import readers, tables


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def brands(spark: SparkSession, d: str, group: str | None = None) -> DataFrame:
    """(dataset_id, row_no, item): the brands of an order, in one data set or one for each value of an order column.

    Items are dealt by row once; dropping repeated ones, the join with the orders and the packing of rows need no other shuffle.
    """
    x = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    x = x.select(F.col("l_orderkey").alias("row_no"), item_canon(F.col("p_brand")).alias("item")).repartition("row_no").distinct()
    if group is None:
        return x.select(F.lit("all").alias("dataset_id"), "row_no", "item")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_no"), F.col(group).alias("dataset_id"))
    return x.join(o, "row_no").select("dataset_id", "row_no", "item")


BRANDS = "SELECT DISTINCT l_orderkey AS row_no, lower(trim(p_brand)) AS item FROM lineitem JOIN part ON l_partkey = p_partkey"
GROUPED = f"SELECT o_orderpriority AS dataset_id, row_no, item FROM ({BRANDS}) JOIN orders ON o_orderkey = row_no"


def itemset_sql(source: str, ms: str = "3", size: int = 3) -> str:
    """Itemsets of up to ``size`` items over (dataset_id, row_no, item)."""
    parts = []
    for k in range(1, size + 1):
        names = [f"t{i}" for i in range(k)]
        joins = "".join(f" JOIN b {n} ON {n}.dataset_id = t0.dataset_id AND {n}.row_no = t0.row_no AND {p}.item < {n}.item" for p, n in zip(names, names[1:], strict=False))
        key = " || '|' || ".join(f"{n}.item" for n in names)
        parts.append(f"SELECT t0.dataset_id, CAST({k} AS BIGINT) AS size, {key} AS itemset, count(*) AS count FROM b t0{joins} GROUP BY ALL HAVING count(*) >= {ms}")
    return f"WITH b AS ({source}) " + " UNION ALL ".join(parts)


def keyed(itemsets: DataFrame, *more: str) -> DataFrame:
    return itemsets.select("dataset_id", F.col("size").cast("long").alias("size"), itemset_key(F.col("itemset")).alias("itemset"), "count", *more)


def item_support(s, d):
    return mining.item_support(brands(s, d)).where("count >= 3").select("item", "count")


def pair_support(s, d):
    return keyed(mining.frequent_itemsets(brands(s, d), MiningConfig(max_size=2))).where("size = 2").select("itemset", "count")


def triple_support(s, d):
    return keyed(mining.frequent_itemsets(brands(s, d), strategy="levels")).where("size = 3").select("itemset", "count")


def frequent_itemsets_upto3(s, d):
    return keyed(mining.frequent_itemsets(brands(s, d), strategy="explode")).select("size", "itemset", "count")


def frequent_itemsets_auto(s, d):
    return keyed(mining.frequent_itemsets(brands(s, d))).select("size", "itemset", "count")


def frequent_itemsets_upto4(s, d):
    return keyed(mining.frequent_itemsets(brands(s, d), MiningConfig(min_support=8, max_size=4), strategy="explode")).where("size = 4").select("itemset", "count")


def itemsets_by_dataset(s, d):
    return keyed(mining.frequent_itemsets(brands(s, d, "o_orderpriority"), MiningConfig(max_size=2), strategy="explode"))


def itemsets_with_thresholds(s, d):
    t = s.createDataFrame([("1-URGENT", 5), ("2-HIGH", 50), ("5-LOW", 100)], "dataset_id string, min_support int")
    return keyed(mining.frequent_itemsets(brands(s, d, "o_orderpriority"), MiningConfig(max_size=2), strategy="explode", thresholds=t))


def itemsets_brute_force(s, d):
    return keyed(mining.brute_force(brands(s, d, "o_orderpriority"), 40, 2))


def fpgrowth_itemsets(s, d):
    out = mining.by_fpgrowth(brands(s, d), 3, 2)
    return out.select(F.col("size").cast("long").alias("size"), itemset_key(F.col("itemset")).alias("itemset"), "count")


def itemset_evidence(s, d):
    out = mining.frequent_itemsets(brands(s, d), MiningConfig(max_size=2), evidence=True, strategy="explode")
    return keyed(out, F.array_join("rows", ",").alias("rows")).drop("dataset_id")


def rendered_rows(s, d):
    out = mining.rendered(mining.frequent_itemsets(brands(s, d), MiningConfig(max_size=1), evidence=True, strategy="explode"))
    return out.select(itemset_key(F.col("itemset")).alias("itemset"), F.array_join("rows", ",").alias("rows"), F.array_join("unique_rows", ",").alias("unique_rows"), "unique_row_count")


def support_fraction(s, d):
    rows = table(s, d, "orders").select(F.lit("all").alias("dataset_id"), F.col("o_orderkey").alias("row_no"))
    out = mining.with_support(mining.frequent_itemsets(brands(s, d), MiningConfig(max_size=1), strategy="explode"), rows)
    return out.select(itemset_key(F.col("itemset")).alias("itemset"), "count", "total", "support")


def candidate_pairs(s, d):
    ones = mining.frequent_itemsets(brands(s, d), MiningConfig(min_support=60, max_size=1), strategy="explode")
    return mining.candidates(ones.select("dataset_id", "itemset")).select(itemset_key(F.col("itemset")).alias("itemset"))


def closure_check(s, d):
    """Pairs both of whose items have at least the mean support of an item."""
    b = brands(s, d)
    pairs = mining.frequent_itemsets(b, MiningConfig(max_size=2), strategy="explode")
    mean = mining.item_support(b).agg(F.avg("count").alias("mean"))
    ones = pairs.where("size = 1").join(F.broadcast(mean), F.col("count") >= F.col("mean"))
    return mining.closed(pairs.where("size = 2").select("dataset_id", "itemset"), ones).select(itemset_key(F.col("itemset")).alias("itemset"))


def containment_count(s, d):
    wanted = s.createDataFrame([("all", ["brand#1", "brand#2"]), ("all", ["brand#3"]), ("all", ["brand#4", "brand#5", "brand#6"])], "dataset_id string, itemset array<string>")
    return mining.containment(wanted, brands(s, d)).select(itemset_key(F.col("itemset")).alias("itemset"), "count")


def association_rules(s, d):
    out = mining.association_rules(mining.frequent_itemsets(brands(s, d), MiningConfig(max_size=2), strategy="explode"))
    return out.select(F.array_join("antecedent", "|").alias("antecedent"), "consequent", "count", "confidence")


def wide_items(s, d):
    """Cells of customers; the segment of every fifth is a word for a missing value, of every seventh blank, of every eleventh null."""
    k = F.col("c_custkey")
    segment = F.when(k % 5 == 0, " NaN ").when(k % 7 == 0, " ").when(k % 11 != 0, F.col("c_mktsegment"))
    c = table(s, d, "customer").withColumn("c_mktsegment", segment)
    items = readers.cell_items(["c_name", "c_mktsegment", "c_nationkey"])
    return c.select("c_custkey", F.posexplode(items).alias("place", "item")).select("c_custkey", F.col("place").cast("long").alias("place"), "item")


def colval_items(s, d):
    c = table(s, d, "customer")
    return c.select("c_custkey", F.explode(readers.tagged_items(c, ["c_mktsegment", "c_nationkey"])).alias("item"))


def long_transactions(s, d):
    out = readers.long_transactions(table(s, d, "events").select("user_id", "event_type"), "user_id", "event_type")
    return out.select(F.col("row_no").cast("long").alias("row_no"), F.array_join(F.array_sort(F.array_distinct("items")), ",").alias("items"), F.size("items").cast("long").alias("n_items"))


def single_column_items(s, d):
    p = table(s, d, "part")
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(";", "p_name", "p_brand")).otherwise(F.col("p_name"))
    return p.select("p_partkey", F.array_join(readers.single_items(text), ",").alias("items"))


def row_text_parse(s, d):
    o = table(s, d, "orders")
    line = F.concat(F.lit("Row "), F.col("o_orderkey").cast("string"), F.lit(": "), F.col("o_orderstatus"), F.lit(", "), F.col("o_orderpriority"))
    text = o.groupBy("o_custkey").agg(F.array_join(F.collect_list(line), "\n").alias("text"))
    out = readers.row_text(text, "text", ("o_custkey",))
    return out.select("o_custkey", F.col("row_no").cast("long").alias("row_no"), F.array_join("items", "|").alias("items"))


def profile_columns(s, d):
    c = table(s, d, "customer").select("c_name", "c_nationkey", "c_mktsegment")
    return readers.profile(c).select("column", "kind", "distinct", "categorical")


def vocabulary_items(s, d):
    return readers.vocabulary(table(s, d, "part"), ["p_brand", "p_type"])


def unique_item_counts(s, d):
    return brands(s, d, "o_orderpriority").groupBy("dataset_id").agg(F.countDistinct("item").alias("unique_items"), F.count("*").alias("total_items"))


def fingerprint(s, d):
    return table(s, d, "documents").select("doc_id", short_hash(F.col("text")).alias("hash12"), F.octet_length("text").cast("long").alias("bytes"))


def json_props(s, d):
    e = table(s, d, "events").select("event_type", F.from_json("props", "k long").k.alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.min("k").alias("least"), F.max("k").alias("most"))


def chunk_assignment(s, d):
    o = readers.numbered(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", ["o_orderstatus"])
    return o.select("o_orderkey", F.col("row_no").cast("long").alias("row_no"), F.floor((F.col("row_no") - 1) / 50).cast("long").alias("chunk"))


def text_signature(s, d):
    return table(s, d, "documents").select("doc_id", prefix_signature(F.col("text")).alias("prefix"))


def set_ops(s, d):
    b = brands(s, d)
    even, odd = (b.where(f"row_no % 2 = {r}").select("item").distinct() for r in (0, 1))
    out = [even.intersect(odd).select(F.lit("both").alias("op"), "item"), even.subtract(odd).select(F.lit("even only").alias("op"), "item"), odd.subtract(even).select(F.lit("odd only").alias("op"), "item"), even.union(odd).distinct().select(F.lit("any").alias("op"), "item")]
    return readers.union_all(out)


def evidence_cells(s, d):
    """Rows of itemsets of up to two brands, as bitmaps, by bucket of row numbers."""
    out = mining.frequent_cells(brands(s, d), MiningConfig(max_size=2))
    return out.select(itemset_key(F.col("itemset")).alias("itemset"), "bucket", "n")


def containment_many(s, d):
    """How many orders of its customer hold the first three brands of every fifth order."""
    b = brands(s, d, "o_custkey")
    wanted = b.where("row_no % 5 = 0").groupBy("dataset_id", "row_no").agg(F.slice(F.array_sort(F.collect_set("item")), 1, 3).alias("itemset"))
    out = mining.containment(wanted.select("dataset_id", "itemset"), b)
    return out.select("dataset_id", itemset_key(F.col("itemset")).alias("itemset"), "count")


def _csv(s, lines, header: str) -> str:
    """A folder of CSV parts with lines as they are, in the order of ``at``; each part has the header."""
    path = tables.new_path(s, "csv")
    plain = {"header": True, "sep": "\u0001", "quote": "\u0000", "escapeQuotes": False, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    lines.orderBy("at").select(F.col("line").alias(header)).write.options(**plain).csv(path)
    return path


def csv_tables(s, d):
    """Tables written as CSV of three shapes and read again: ragged wide lines of orders, long ones of events, single cells of parts."""
    o, k = table(s, d, "orders"), F.col("o_orderkey") % 6
    cells = [F.col("o_orderkey").cast("string"), F.concat(F.lit('"'), "o_orderpriority", F.lit(',""x"""')), F.when(k == 5, "NA").otherwise(F.col("o_orderstatus"))]
    line = F.when(k == 1, F.concat_ws(",", *cells[:2])).when(k == 2, F.concat_ws(",", *cells, F.lit("more"))).when(k == 3, F.lit(",,")).otherwise(F.concat_ws(",", *cells))
    wide = _csv(s, o.select(F.col("o_orderkey").alias("at"), line.alias("line")), "key,priority,status")
    e = table(s, d, "events")
    long = _csv(s, e.select(F.struct("user_id", "event_id").alias("at"), F.concat_ws(";", F.col("event_id").cast("string"), F.concat(F.lit(" "), "event_type"), F.col("user_id").cast("string")).alias("line")), "n;Item;TID")
    single = _csv(s, table(s, d, "part").select(F.col("p_partkey").alias("at"), F.when(F.col("p_partkey") % 4 == 0, " ").otherwise(F.col("p_name")).alias("line")), "basket")
    out = [readers.read_transactions(s, path, name) for name, path in (("wide", wide), ("long", long), ("single", single))]
    return readers.union_all([t.select("dataset_id", F.lit(how["shape"]).alias("shape"), F.lit(how["read"]).alias("read"), F.col("row_no").cast("long").alias("row_no"), F.array_join("items", "|").alias("items")) for t, how in out])


QUERIES = {f.__name__: f for f in (
    evidence_cells, containment_many, csv_tables, item_support, pair_support, triple_support, frequent_itemsets_upto3, frequent_itemsets_auto, frequent_itemsets_upto4, itemsets_by_dataset, itemsets_with_thresholds, itemsets_brute_force,
    fpgrowth_itemsets, itemset_evidence, rendered_rows, support_fraction, candidate_pairs, closure_check, containment_count, association_rules, wide_items, colval_items, long_transactions,
    single_column_items, row_text_parse, profile_columns, vocabulary_items, unique_item_counts, fingerprint, json_props, chunk_assignment, text_signature, set_ops,
)}

ALL = f"SELECT 'all' AS dataset_id, row_no, item FROM ({BRANDS})"
_UPTO3 = f"SELECT size, itemset, count FROM ({itemset_sql(ALL)})"
_PAIRS = f"WITH i AS ({itemset_sql(ALL, size=2)}) "

SQL = {
    "evidence_cells": f"""WITH b AS ({BRANDS}), e AS (SELECT item AS itemset, row_no FROM b UNION ALL SELECT x.item || '|' || y.item, x.row_no FROM b x JOIN b y ON x.row_no = y.row_no AND x.item < y.item),
        f AS (SELECT itemset FROM e GROUP BY itemset HAVING count(*) >= 3) SELECT itemset, CASE WHEN row_no > 0 THEN 1 + (row_no - 1) // 32768 ELSE 0 END AS bucket, count(*) AS n FROM e JOIN f USING (itemset) GROUP BY ALL""",
    "containment_many": f"""WITH b AS (SELECT o_custkey AS dataset_id, row_no, item FROM ({BRANDS}) JOIN orders ON o_orderkey = row_no), l AS (SELECT dataset_id, row_no, list(item ORDER BY item) AS i FROM b GROUP BY ALL),
        w AS (SELECT DISTINCT dataset_id, i[1:3] AS w FROM l WHERE row_no % 5 = 0) SELECT dataset_id, array_to_string(w, '|') AS itemset, count(*) AS count FROM w JOIN l USING (dataset_id) WHERE list_has_all(i, w) GROUP BY ALL""",
    "csv_tables": """WITH o AS (SELECT *, o_orderkey % 6 AS k FROM orders WHERE o_orderkey % 6 NOT IN (2, 3)), p AS (SELECT *, row_number() OVER (ORDER BY p_partkey) AS r FROM part WHERE p_partkey % 4 <> 0)
        SELECT 'wide' AS dataset_id, 'wide' AS shape, 'skip' AS read, row_number() OVER (ORDER BY o_orderkey) AS row_no, o_orderkey || '|' || o_orderpriority || ',"x"' || CASE WHEN k IN (1, 5) THEN '' ELSE '|' || o_orderstatus END AS items FROM o
        UNION ALL SELECT 'long', 'long', 'strict', row_number() OVER (ORDER BY user_id), string_agg(event_type, '|' ORDER BY event_id) FROM events GROUP BY user_id
        UNION ALL SELECT 'single', 'single', 'strict', r, replace(p_name, ' ', '|') FROM p""",
    "item_support": f"SELECT item, count(*) AS count FROM ({BRANDS}) GROUP BY item HAVING count(*) >= 3",
    "pair_support": f"SELECT itemset, count FROM ({itemset_sql(ALL, size=2)}) WHERE size = 2",
    "triple_support": f"SELECT itemset, count FROM ({itemset_sql(ALL)}) WHERE size = 3",
    "frequent_itemsets_upto3": _UPTO3,
    "frequent_itemsets_auto": _UPTO3,
    "frequent_itemsets_upto4": f"SELECT itemset, count FROM ({itemset_sql(ALL, '8', 4)}) WHERE size = 4",
    "itemsets_by_dataset": itemset_sql(GROUPED, size=2),
    "itemsets_with_thresholds": f"SELECT * FROM ({itemset_sql(GROUPED, '1', 2)}) WHERE count >= CASE dataset_id WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 50 WHEN '5-LOW' THEN 100 END",
    "itemsets_brute_force": itemset_sql(GROUPED, "40", 2),
    "fpgrowth_itemsets": f"SELECT size, itemset, count FROM ({itemset_sql(ALL, size=2)})",
    "itemset_evidence": f"""WITH b AS ({BRANDS}), e AS (
        SELECT 1 AS size, item AS itemset, row_no FROM b UNION ALL
        SELECT 2, x.item || '|' || y.item, x.row_no FROM b x JOIN b y ON x.row_no = y.row_no AND x.item < y.item)
        SELECT CAST(size AS BIGINT) AS size, itemset, count(*) AS count, string_agg(CAST(row_no AS VARCHAR), ',' ORDER BY row_no) AS rows FROM e GROUP BY size, itemset HAVING count(*) >= 3""",
    "rendered_rows": f"""WITH b AS ({BRANDS})
        SELECT item AS itemset, string_agg('Row ' || row_no, ',' ORDER BY row_no) AS rows, string_agg('Row ' || row_no, ',' ORDER BY 'Row ' || row_no) AS unique_rows, count(*) AS unique_row_count FROM b GROUP BY item HAVING count(*) >= 3""",
    "support_fraction": f"SELECT item AS itemset, count(*) AS count, (SELECT count(*) FROM orders) AS total, count(*) / (SELECT count(*) FROM orders) AS support FROM ({BRANDS}) GROUP BY item HAVING count(*) >= 3",
    "candidate_pairs": f"WITH f AS (SELECT item FROM ({BRANDS}) GROUP BY item HAVING count(*) >= 60) SELECT a.item || '|' || b.item AS itemset FROM f a JOIN f b ON a.item < b.item",
    "closure_check": _PAIRS + ", o AS (SELECT itemset FROM i WHERE size = 1 AND count >= (SELECT avg(count) FROM i WHERE size = 1)) SELECT itemset FROM i WHERE size = 2 AND split_part(itemset, '|', 1) IN (SELECT itemset FROM o) AND split_part(itemset, '|', 2) IN (SELECT itemset FROM o)",
    "containment_count": f"""WITH b AS ({BRANDS}), w(itemset) AS (VALUES ('brand#1|brand#2'), ('brand#3'), ('brand#4|brand#5|brand#6')), i AS (SELECT itemset, unnest(string_split(itemset, '|')) AS item FROM w),
        h AS (SELECT itemset, row_no, count(*) AS n FROM i JOIN b USING (item) GROUP BY ALL) SELECT itemset, count(*) AS count FROM h WHERE n = len(string_split(itemset, '|')) GROUP BY itemset""",
    "association_rules": _PAIRS + """, r AS (SELECT split_part(itemset, '|', 1) AS antecedent, split_part(itemset, '|', 2) AS consequent, count FROM i WHERE size = 2 UNION ALL SELECT split_part(itemset, '|', 2), split_part(itemset, '|', 1), count FROM i WHERE size = 2)
        SELECT antecedent, consequent, r.count, r.count / s.count AS confidence FROM r JOIN i s ON s.size = 1 AND s.itemset = antecedent""",
    "wide_items": "WITH c AS (SELECT *, c_custkey % 5 = 0 OR c_custkey % 7 = 0 OR c_custkey % 11 = 0 AS gone FROM customer) SELECT c_custkey, CAST(0 AS BIGINT) AS place, c_name AS item FROM c UNION ALL SELECT c_custkey, 1, c_mktsegment FROM c WHERE NOT gone UNION ALL SELECT c_custkey, CASE WHEN gone THEN 1 ELSE 2 END, CAST(c_nationkey AS VARCHAR) FROM c",
    "colval_items": "SELECT c_custkey, lower('c_mktsegment:' || c_mktsegment) AS item FROM customer UNION ALL SELECT c_custkey, 'c_nationkey:' || c_nationkey FROM customer",
    "long_transactions": "SELECT row_number() OVER (ORDER BY user_id) AS row_no, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS items, count(*) AS n_items FROM events GROUP BY user_id",
    "single_column_items": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || ',' || p_brand ELSE replace(p_name, ' ', ',') END AS items FROM part",
    "row_text_parse": "SELECT o_custkey, o_orderkey AS row_no, o_orderstatus || '|' || o_orderpriority AS items FROM orders",
    "profile_columns": """SELECT 'c_name' AS "column", 'text' AS kind, count(DISTINCT c_name) AS "distinct", count(DISTINCT c_name) <= 100 AS categorical FROM customer UNION ALL
        SELECT 'c_nationkey', 'number', count(DISTINCT c_nationkey), count(DISTINCT c_nationkey) <= 10 FROM customer UNION ALL SELECT 'c_mktsegment', 'text', count(DISTINCT c_mktsegment), count(DISTINCT c_mktsegment) <= 100 FROM customer""",
    "vocabulary_items": "SELECT DISTINCT lower('p_brand:' || p_brand) AS item FROM part UNION SELECT DISTINCT lower('p_type:' || p_type) FROM part",
    "unique_item_counts": f"SELECT dataset_id, count(DISTINCT item) AS unique_items, count(*) AS total_items FROM ({GROUPED}) GROUP BY dataset_id",
    "fingerprint": "SELECT doc_id, left(sha256(text), 12) AS hash12, CAST(strlen(text) AS BIGINT) AS bytes FROM documents",
    "json_props": "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, min(k) AS least, max(k) AS most FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type",
    "chunk_assignment": "SELECT o_orderkey, r AS row_no, (r - 1) // 50 AS chunk FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS r FROM orders)",
    "text_signature": r"SELECT doc_id, left(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 120) AS prefix FROM documents",
    "set_ops": f"""WITH b AS ({BRANDS}), e AS (SELECT DISTINCT item FROM b WHERE row_no % 2 = 0), o AS (SELECT DISTINCT item FROM b WHERE row_no % 2 = 1)
        SELECT 'both' AS op, item FROM (SELECT * FROM e INTERSECT SELECT * FROM o) UNION ALL SELECT 'even only', item FROM (SELECT * FROM e EXCEPT SELECT * FROM o)
        UNION ALL SELECT 'odd only', item FROM (SELECT * FROM o EXCEPT SELECT * FROM e) UNION ALL SELECT 'any', item FROM (SELECT * FROM e UNION SELECT * FROM o)""",
}
