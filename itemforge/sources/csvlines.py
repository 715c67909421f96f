"""CSV files of any delimiter, header and width as one scan of lines.

Lines are read as text and cut into cells in the JVM, by the delimiter of their own file, so which rows there
are never depends on the columns that a query selects, and a file of many splits is read by many tasks. Row
numbers come from the lines that were kept in the splits before, summed by file and place in it. Only
a file whose cells hold line breaks cannot be cut at lines; such files are parsed whole, each by one task.
"""

from __future__ import annotations

import csv
import io
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itemforge.functions.text import is_missing, strip

# What a header may call its parts, the delimiters tried, and words for a missing cell.
ID_NAMES = ("transaction_id", "tid", "trans_id", "t_id")
ITEM_NAMES = ("item", "product", "sku")
DELIMITERS = ",;\t|"
MISSING = ("", "NA", "N/A", "#N/A", "NULL", "null", "NaN", "nan", "None")

#: Lines of a file that its delimiter is found by.
HEAD_LINES = 40
#: Files, and splits, whose few numbers are sent to every task; with more of them both sides are shuffled.
FILES_SENT, SPLITS_SENT = 50_000, 1_000_000
#: Bytes that Spark makes a split of at least, whatever the parallelism, unless a file is smaller.
LEAST_SPLIT = 4 << 20


def shape_of(columns: list[str]) -> str:
    """long (an id and an item column), single (one column) or wide."""
    low = [c.strip().lower() for c in columns]
    if any(c in ID_NAMES for c in low) and any(c in ITEM_NAMES for c in low):
        return "long"
    return "single" if len(columns) == 1 else "wide"


def delimiter_of(lines: list[str]) -> str:
    """The delimiter of a file by its first lines; a comma if they do not tell."""
    try:
        return csv.Sniffer().sniff("\n".join(x for x in lines if x.strip()), DELIMITERS).delimiter
    except csv.Error:
        return ","


def unique_names(names: list[str]) -> list[str]:
    """Header cells as column names: nameless ones are numbered, and repeated ones too."""
    out: list[str] = []
    for i, n in enumerate(names):
        n = n if n.strip() else f"Unnamed: {i}"
        k, name = 0, n
        while name in out:
            k += 1
            name = f"{n}.{k}"
        out.append(name)
    return out


def header_of(lines: list[str], sep: str | None = None) -> dict:
    """Delimiter, names and shape by a file's first lines, at least one of which is not blank."""
    header = next(x for x in lines if x.strip())
    sep = sep or delimiter_of(lines)
    names = unique_names(next(csv.reader([header.removeprefix("\ufeff")], delimiter=sep), [""]))
    low = [n.strip().lower() for n in names]
    shape = shape_of(names)
    at = [next((low.index(c) for c in wanted if c in low), None) if shape == "long" else None for wanted in (ID_NAMES, ITEM_NAMES)]
    return {"sep": sep, "header": header, "names": names, "shape": shape, "id_at": at[0], "item_at": at[1]}


def quoted(sep: Column) -> Column:
    """A delimiter as a regular expression."""
    return F.concat(F.lit("\\Q"), sep, F.lit("\\E"))


#: A cell in quotes from its start on: what stands in them, quotes doubled.
_CLOSED = '^"([^"]*+(?:""[^"]*+)*+)"'


def raw_cells(line: Column, sep: Column) -> Column:
    """Cells as they stand, quotes included; a delimiter inside quotes does not cut."""
    other = F.concat(F.lit("[^"), F.when(sep == "\t", F.lit("\\t")).otherwise(F.concat(F.lit("\\"), sep)), F.lit("]*+"))
    cell = F.concat(quoted(sep), F.lit('("[^"]*+(?:""[^"]*+)*+"'), other, F.lit("|"), other, F.lit(")"))
    return F.when(F.contains(line, F.lit('"')), F.regexp_extract_all(F.concat(sep, line), cell, F.lit(1))).otherwise(F.split(line, quoted(sep), -1))


def unquoted(cell: Column) -> Column:
    inner, rest = F.regexp_extract(cell, _CLOSED, 1), F.regexp_replace(cell, _CLOSED, "")
    return F.when(F.startswith(cell, F.lit('"')) & cell.rlike(_CLOSED), F.concat(F.replace(inner, F.lit('""'), F.lit('"')), rest)).otherwise(cell)


def is_open(cells: Column) -> Column:
    """Whether a cell's quotes are not closed on its line."""
    return F.exists(cells, lambda c: F.startswith(c, F.lit('"')) & ~c.rlike(_CLOSED))


def plain_name() -> Column:
    """The scanned file's name; Spark gives it as a part of a URL."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def lines_of(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, name, block, line) of the files, without lines that are blank whatever the delimiter."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    meta = [F.col("_metadata.file_path").alias("path"), plain_name().alias("name"), F.col("_metadata.file_block_start").alias("block")]
    return reader.text(path).select(*meta, F.col("value").alias("line")).where(F.col("line").rlike(r"\S|\t"))


_HEAD = "sep string, header string, names array<string>, shape string, id_at int, item_at int"


def heads_of(lines: DataFrame, sep: str | None = None) -> DataFrame:
    """(path, name, sep, header, names, shape, id_at, item_at) of each file that has a line."""
    first = lines.where("block = 0").withColumn("at", F.monotonically_increasing_id())
    first = first.withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy("at"))).where(F.col("k") <= HEAD_LINES)
    each = first.groupBy("path", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x.line).alias("lines"))

    def read(frames):
        import pandas as pd

        for f in frames:
            heads = pd.DataFrame([header_of(list(x), sep) for x in f["lines"]], columns=["sep", "header", "names", "shape", "id_at", "item_at"])
            yield pd.concat([f[["path", "name"]], heads], axis=1).astype({"id_at": "Int32", "item_at": "Int32"})

    return each.mapInPandas(read, f"path string, name string, {_HEAD}")


@dataclass
class CsvFiles:
    """Files as ``rows``: (path, name, shape, id_at, item_at, cells, row), and by file ``reads``: (path, name, shape, names, rows, read).

    ``row`` counts a file's rows from 1 in their order. ``read`` is skip where lines with more cells than the
    header were left out, else strict.
    """

    rows: DataFrame
    reads: DataFrame


def read_files(spark: SparkSession, path: str, glob: str | None = None, keep_empty: bool = True, sep: str | None = None) -> CsvFiles:
    """All rows of the CSV files at a path; without ``keep_empty`` rows whose cells are all missing go before rows are counted.

    Blank lines go, short lines stay (their cells are fewer), lines with more cells than the header go, the first one too
    (it makes no column an index). Words for a missing cell are null cells. A file with nothing but its header has no rows, one without a line is not there.
    """
    lines = lines_of(spark, path, glob).withColumn("scanned", F.monotonically_increasing_id())
    files = len(lines.inputFiles())
    few = files <= FILES_SENT
    heads = heads_of(lines.drop("scanned"), sep).persist()
    states = _states(lines.drop("name").join(F.broadcast(heads) if few else heads, "path"), keep_empty)
    if few:  # the scan's order is still there: rows count up in their task
        counted, kept, start = states.withColumn("at", F.monotonically_increasing_id()), states.where("kept").withColumn("at", F.monotonically_increasing_id()), F.min("at")
    else:  # lines have met their file's header by a shuffle: order each split again
        counted, start = states, F.lit(0).cast("long")
        kept = states.where("kept").withColumn("at", F.row_number().over(Window.partitionBy("path", "block").orderBy("scanned")).cast("long") - 1)
    counted = counted.groupBy("path", "block").agg(start.alias("first"), F.count_if("kept").alias("n"), F.count_if("long").alias("bad"), F.max("open").alias("open"))
    # rows kept before a split: in its task, whose numbers the second scan counts on, and in its file
    task, file = Window.partitionBy(F.shiftright("first", 33)).orderBy("first"), Window.partitionBy("path")
    base = F.shiftleft(F.shiftright("first", 33), 33) + F.sum("n").over(task) - F.col("n") if few else F.lit(0).cast("long")
    before = F.sum("n").over(file.orderBy("block")) - F.col("n")
    splits = counted.select("path", "block", "n", "bad", base.alias("base"), before.alias("before"), F.max("open").over(file).alias("broken")).persist()
    size = int(str(lines._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    sent = F.broadcast(splits) if files + size // LEAST_SPLIT <= SPLITS_SENT else splits
    rows = kept.join(sent.drop("n", "bad"), ["path", "block"], "left").where(~F.coalesce("broken", F.lit(False)))
    lost = F.when(F.col("before").isNull(), F.raise_error(F.lit("the files were split anew while they were read")).cast("long"))
    rows = rows.withColumn("row", F.coalesce(lost, F.col("at") - F.col("base") + F.col("before"))).where("row > 0")  # 0 is the header
    rows = rows.select(*_ROWS[:-2], F.transform(F.transform("raw", unquoted), lambda c: F.when(~strip(c).isin(*MISSING), c)).alias("cells"), "row")
    by_file = splits.groupBy("path").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.max("broken").alias("broken"))
    whole = _whole_files(spark, path, glob, by_file.where("broken").select("path"), keep_empty, sep)
    reads = by_file.where("NOT broken").join(heads, "path").select(*_READS, (F.col("n") - 1).alias("rows"), F.when(F.col("bad") > 0, "skip").otherwise("strict").alias("read"))
    again = whole.groupBy("path").agg(*[F.first(c).alias(c) for c in _READS[1:]], F.max("row").alias("rows"), F.first("read").alias("read"))
    return CsvFiles(rows.unionByName(whole.where("row > 0").select(*_ROWS)), reads.unionByName(again))


_ROWS = ["path", "name", "shape", "id_at", "item_at", "cells", "row"]
_READS = ["path", "name", "shape", "names"]


def _states(lines: DataFrame, keep_empty: bool) -> DataFrame:
    """Adds raw, long, open and kept. A file's header is kept, so that it is the first row."""
    cut = lines.withColumn("raw", raw_cells(F.col("line"), F.col("sep")))
    full = F.lit(True) if keep_empty else F.exists(F.transform("raw", unquoted), lambda c: ~is_missing(c)) | ((F.col("block") == 0) & (F.col("line") == F.col("header")))
    blank = ~F.col("line").rlike(r"\S") & (F.col("sep") != "\t")  # between tabs there are cells
    return cut.withColumns({"long": F.size("raw") > F.size("names"), "open": is_open(F.col("raw"))}).withColumn("kept", ~F.col("long") & full & ~blank)


def _whole_files(spark: SparkSession, path: str, glob: str | None, broken: DataFrame, keep_empty: bool, sep: str | None) -> DataFrame:
    """The rows of files whose cells hold line breaks; row 0 stands for a file itself."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob) if glob else spark.read.format("binaryFile")
    files = reader.load(path).select(F.col("_metadata.file_path").alias("path"), plain_name().alias("name"), "content").join(broken, "path", "left_semi")

    def parse(frames):
        import pandas as pd

        for f in frames:
            for where, name, raw in zip(f["path"], f["name"], f["content"], strict=True):
                text = bytes(raw).decode("utf-8-sig", "replace")
                head = header_of(text.splitlines()[:HEAD_LINES], sep)
                lines = [x for x in csv.reader(io.StringIO(text, newline=""), delimiter=head["sep"]) if len(x) > 1 or any(c.strip() for c in x)]
                names = unique_names(lines[0])
                if names != head["names"]:  # a line break in the header
                    shown = io.StringIO()
                    csv.writer(shown).writerow([n.replace("\n", " ").replace("\r", " ") for n in names])
                    head = header_of([shown.getvalue()], ",") | {"names": names}
                good = [[None if c.strip() in MISSING else c for c in x] for x in lines[1:] if len(x) <= len(names)]
                read = "strict" if len(good) == len(lines) - 1 else "skip"
                if not keep_empty:
                    good = [x for x in good if any(c is not None and c.strip().lower() not in ("", "nan", "none") for c in x)]
                same = {"path": where, "name": name, "read": read, **{k: head[k] for k in ("names", "shape", "id_at", "item_at")}}
                yield pd.DataFrame([{"cells": x, "row": i, **same} for i, x in enumerate([[], *good])]).astype({"id_at": "Int32", "item_at": "Int32"})

    return files.mapInPandas(parse, "cells array<string>, row long, path string, name string, read string, names array<string>, shape string, id_at int, item_at int")
