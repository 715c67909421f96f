"""Readers of basket files: CSV of three shapes, prompt text, JSON, fingerprints and listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itemforge.functions.text import is_missing, strip, tagged
from itemforge.operators.ranking import place_in_order
from itemforge.sources.csvlines import CsvFiles, delimiter_of, read_files, shape_of


def sniff_delimiter(spark: SparkSession, path: str, lines: int = 40) -> str:
    """Delimiter of a CSV file by its first lines that are not blank; a comma if they do not tell."""
    return delimiter_of([r.value for r in spark.read.text(path).limit(lines).collect()])


def _in_folder_order(files: CsvFiles) -> DataFrame:
    """``rows`` counted on from file to file, by path."""
    before = files.reads.select("path", (F.sum("rows").over(Window.orderBy("path")) - F.col("rows")).alias("_before"))  # a row a file
    return files.rows.join(before, "path").withColumn("row", F.col("row") + F.col("_before")).drop("_before")


def read_csv(spark: SparkSession, path: str, sep: str | None = None, number: str | None = None) -> tuple[DataFrame, str]:
    """All columns as strings, words for a missing cell as null, and how it was read: strict, or skip if lines with too many cells were left out.

    Short lines are filled with nulls. ``number`` names a further column: rows from 1 in the order of the file, or of the
    files of a folder by path, which should share the header of the first. Which rows there are does not
    depend on the columns that are used.
    """
    files = read_files(spark, path, sep=sep)
    known = files.reads.agg(F.min_by("names", "path").alias("names"), F.max(F.col("read") == "skip").alias("skip")).first()
    names = known.names or []
    columns = [F.get("cells", i).alias(n) for i, n in enumerate(names)]
    rows = _in_folder_order(files).select(*columns, F.col("row").alias(number)) if number else files.rows.select(*columns)
    return rows, "skip" if known.skip else "strict"


def in_file_order(df: DataFrame, name: str = "row_no") -> DataFrame:
    """Adds numbers from 1 in the order in which ``df`` scans one file (no shuffle may stand between).

    Rows count up within their partition; the partitions' sizes, one small row each, give what comes before. Spark
    scans several files in an order of its own: use ``read_csv`` with ``number`` there.
    """
    ids = df.withColumn("_id", F.monotonically_increasing_id())
    sizes = ids.groupBy(F.shiftright("_id", 33).alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    out = ids.withColumn("_part", F.shiftright("_id", 33)).join(F.broadcast(before), "_part")
    return out.withColumn(name, F.col("_id").bitwiseAND((1 << 33) - 1) + F.col("_before") + 1).drop("_id", "_part", "_before")


def in_order(df: DataFrame, order: list[Column], name: str = "row_no") -> DataFrame:
    """Adds numbers from 1 in the order of some columns."""
    return place_in_order(df, order, [], name)


def numbered(df: DataFrame, order: str | None = None, group: list[str] | None = None) -> DataFrame:
    """Row numbers from 1 in the order of a column (in each group), or in file order without one."""
    if order is None:
        return in_file_order(df)
    return place_in_order(df, [F.col(order)], group or [], "row_no")


def long_transactions(df: DataFrame, id_col: str, item_col: str, compat: bool = False) -> DataFrame:
    """(row_no, items): items by id, rows in id order; ids that are numbers in numeric order.

    Null ids go. Null items go too, or are the item ``nan`` with ``compat``. A transaction whose
    items are all blank stays, empty.
    """
    item = F.coalesce(strip(F.col(item_col)), F.lit("nan")) if compat else strip(F.col(item_col))
    g = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.filter(F.collect_list(item), lambda x: x != "").alias("items"))
    return place_in_order(g, [F.col("_id").try_cast("double"), F.col("_id")], [], "row_no").select("row_no", "items")


def cell_items(columns: list[str]) -> Column:
    cells = F.array(*[F.col(f"`{c}`").cast("string") for c in columns])
    return F.transform(F.filter(cells, lambda x: ~is_missing(x)), strip)


def wide_transactions(df: DataFrame, columns: list[str] | None = None, drop_empty: bool = True, order: str | None = None) -> DataFrame:
    """(src_row, row_no, items): the cells of a row that hold something; rows left empty go unless told otherwise."""
    cols = columns or [c for c in df.columns if c != order]
    n = numbered(df.select(cell_items(cols).alias("items"), *([order] if order else [])), order).withColumnRenamed("row_no", "src_row")
    if not drop_empty:
        return n.select("src_row", F.col("src_row").alias("row_no"), "items")
    n = n.select("src_row", "items").where(F.size("items") > 0)
    return (place_in_order(n, [F.col("src_row")], [], "row_no") if order else in_file_order(n)).select("src_row", "row_no", "items")


def single_items(c: Column) -> Column:
    """Items of one cell: split at ; , | or tab if there is one, at blanks else."""
    parts = F.when(c.rlike(r"[;,|\t]"), F.split(c, r"[;,|\t]")).otherwise(F.split(c, r"\s+"))
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def single_transactions(df: DataFrame, col: str, compat: bool = False, order: str | None = None) -> DataFrame:
    text = F.coalesce(F.col(col), F.lit("nan")) if compat else F.coalesce(F.col(col), F.lit(""))
    n = df.select(single_items(text).alias("items"), *([order] if order else [])).where(F.size("items") > 0)
    return numbered(n, order).select("row_no", "items")


def _transactions(rows: DataFrame, keep_empty: bool) -> DataFrame:
    """(dataset_id, row_no, items, shape) of rows of files of any shape: ``dataset_id`` in them says whose they are."""
    plain, long = rows.where("shape <> 'long'"), rows.where("shape = 'long'")
    flat = plain.withColumn("items", F.when(F.col("shape") == "single", single_items(F.coalesce(F.get("cells", 0), F.lit("")))).otherwise(F.transform(F.filter("cells", lambda x: ~is_missing(x)), strip)))
    flat = flat.withColumn("row_no", F.col("row"))
    if not keep_empty:  # a single cell may hold separators alone, which the rows were not counted without
        bare = flat.where(F.size("items") == 0).groupBy("dataset_id").agg(F.sort_array(F.collect_list("row")).alias("bare"))
        flat = flat.where(F.size("items") > 0).join(F.broadcast(bare), "dataset_id", "left")
        flat = flat.withColumn("row_no", F.col("row") - F.coalesce(F.size(F.filter("bare", lambda x: x < F.col("row"))), F.lit(0)))
    item = strip(F.expr("get(cells, item_at)"))
    each = long.select("dataset_id", "shape", F.expr("get(cells, id_at)").alias("id"), F.struct(F.col("row"), item.alias("x")).alias("v")).where("id IS NOT NULL")
    each = each.groupBy("dataset_id", "shape", "id").agg(F.array_sort(F.collect_list("v")).alias("v"))
    each = each.withColumn("items", F.filter(F.transform("v", lambda v: v.x), lambda x: x != ""))
    each = place_in_order(each.drop("v"), [F.col("id").try_cast("double"), F.col("id")], ["dataset_id"], "row_no")
    want = ("dataset_id", "row_no", "items", "shape")
    return flat.select(*want).unionByName(each.select(*want))


def read_transactions(spark: SparkSession, path: str, dataset_id: str | None = None) -> tuple[DataFrame, dict]:
    """(dataset_id, row_no, items) of one CSV file of any shape and size, or of a folder of its parts, and how it was read."""
    files = read_files(spark, path, keep_empty=False)
    known = files.reads.agg(F.min_by("shape", "path").alias("shape"), F.max(F.col("read") == "skip").alias("skip")).first()
    rows = _in_folder_order(files).withColumn("dataset_id", F.lit(dataset_id or path.rsplit("/", 1)[-1]))
    return _transactions(rows, False).drop("shape"), {"shape": known.shape or "wide", "read": "skip" if known.skip else "strict"}


def read_directory(spark: SparkSession, path: str, keep_empty: bool = False) -> DataFrame:
    """(dataset_id, row_no, items, shape, read) of every *.csv file of a folder, in one job; the file's name is the data set.

    Each file has its own delimiter, quoting, header and shape; a large one is read by many tasks. Rows are
    numbered in each data set: in file order (rows left empty go, unless ``keep_empty``), or for the long
    shape in the order of ids. Lines with too many cells are left out and ``read`` is then skip.
    """
    files = read_files(spark, path, "*.[cC][sS][vV]", keep_empty)
    reads = files.reads.select(F.col("name").alias("dataset_id"), "read")
    out = _transactions(files.rows.withColumn("dataset_id", F.col("name")), keep_empty)
    return out.join(reads, "dataset_id").select("dataset_id", "row_no", "items", "shape", "read")


def evaluation_sets(spark: SparkSession, path: str) -> DataFrame:
    """(dataset_id, rows, text, n_rows, n_cols) of every *.csv file of a folder: empty rows stay, text has lines ``Row n: a, b``."""
    t = read_directory(spark, path, keep_empty=True)
    rows = F.array_sort(F.collect_list(F.struct("row_no", "items")))
    lines = F.transform("rows", lambda r: F.concat(F.lit("Row "), r.row_no.cast("string"), F.lit(": "), F.array_join(r["items"], ", ")))
    g = t.groupBy("dataset_id").agg(rows.alias("rows"), F.max(F.size("items")).alias("n_cols"))
    return g.select("dataset_id", "rows", F.array_join(lines, "\n").alias("text"), F.size("rows").alias("n_rows"), "n_cols")


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, name, bytes) of the files below a folder."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return f.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"))


def with_row_counts(prints: DataFrame, transactions: DataFrame) -> DataFrame:
    """Fingerprints with dataset_size_rows, the transactions of the data set of that name (0 without any)."""
    n = transactions.groupBy(F.col("dataset_id").alias("dataset_name")).agg(F.count("*").alias("dataset_size_rows"))
    return prints.join(n, "dataset_name", "left").withColumn("dataset_size_rows", F.coalesce("dataset_size_rows", F.lit(0).cast("long")))


def fingerprints(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """(dataset_id, dataset_name, dataset_hash, dataset_size_bytes): id is name:first 12 digits of SHA-256."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    name, sha = F.element_at(F.split("path", "/"), -1), F.sha2("content", 256)
    return f.select(F.concat(name, F.lit(":"), F.left(sha, F.lit(12))).alias("dataset_id"), name.alias("dataset_name"), sha.alias("dataset_hash"), F.col("length").alias("dataset_size_bytes"))


def resolved(paths: DataFrame, files: DataFrame, col: str = "data_path") -> DataFrame:
    """Adds ``resolved``: the path if it is there, else a file of that name, else the path itself."""
    there = files.select(F.col("path").alias(col), F.col("path").alias("_p"))
    named = files.groupBy("name").agg(F.min("path").alias("_q"))
    out = paths.withColumn("name", F.element_at(F.split(col, "/"), -1)).join(there, col, "left").join(named, "name", "left")
    return out.withColumn("resolved", F.coalesce("_p", "_q", col)).drop("name", "_p", "_q")


def profile(df: DataFrame, most_text: int = 100, most_number: int = 10) -> DataFrame:
    """(column, kind, distinct, categorical): one aggregate over all columns."""
    n = df.agg(*[F.countDistinct(f"`{c}`").alias(c) for c in df.columns])
    rows = [F.struct(F.lit(c).alias("column"), F.lit("text" if t == "string" else "number").alias("kind"), F.col(f"`{c}`").alias("distinct")) for c, t in df.dtypes]
    out = n.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.withColumn("categorical", F.when(F.col("kind") == "text", F.col("distinct") <= most_text).otherwise(F.col("distinct") <= most_number))


def eligible(profiled: DataFrame, least: int = 3) -> DataFrame:
    """One row: whether a source has enough categorical columns."""
    return profiled.agg((F.count_if("categorical") >= least).alias("eligible"))


def tagged_items(df: DataFrame, columns: list[str]) -> Column:
    """``column:value`` items of a row, nulls left out."""
    return F.filter(F.array(*[tagged(c, F.col(f"`{c}`")) for c in columns]), lambda x: x.isNotNull())


def vocabulary(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(F.explode(tagged_items(df, columns)).alias("item")).distinct()


def row_text(df: DataFrame, col: str = "text", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, row_no, items) of prompt text: lines ``Row n: a, b``."""
    lines = df.select(*keys, F.explode(F.split(col, "\n")).alias("line"))
    hit = lines.where(F.col("line").rlike(r"^\s*Row \d+:"))
    n = F.regexp_extract("line", r"^\s*Row (\d+):", 1).cast("int")
    items = F.filter(F.transform(F.split(F.regexp_replace("line", r"^\s*Row \d+:", ""), ","), strip), lambda x: x != "")
    return hit.select(*keys, n.alias("row_no"), items.alias("items"))


def unique_values(text: Column) -> Column:
    """Different values, in lower case, after the first colon of each line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit(":")))
    values = F.flatten(F.transform(lines, lambda x: F.split(F.element_at(F.split(x, ":", 2), 2), ",")))
    return F.size(F.array_distinct(F.filter(F.transform(values, lambda v: F.lower(strip(v))), lambda v: v != "")))


def one_hot(df: DataFrame, id_col: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Extension: (row_no, items) of indicator columns; true are 1, 1.0, true, yes, y, x."""
    cols = [c for c in df.columns if c != id_col and c not in excluded]
    cells = [F.when(F.lower(strip(F.col(f"`{c}`").cast("string"))).isin("1", "1.0", "true", "yes", "y", "x"), F.lit(c)) for c in cols]
    return numbered(df.select(id_col, F.filter(F.array(*cells), lambda x: x.isNotNull()).alias("items")), id_col)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def read_split(spark: SparkSession, path: str, config: str, split: str = "train") -> DataFrame:
    """One configuration and split of a published data set: config=/split= folders of Parquet."""
    return spark.read.parquet(f"{path}/config={config}/split={split}")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
