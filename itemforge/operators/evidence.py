"""Which rows hold an itemset, as bitmaps of row numbers in buckets.

A cell is (data set, itemset, bucket): one bit for each of 32,768 row numbers, so 4 KB however many
rows there are. Single items' cells come from one aggregate over the baskets; an itemset's cells are the AND of its
items' cells, bucket by bucket, for any number of items. Nothing holds all rows of an itemset but
``listed``, which is for reports on data sets whose row lists fit a cell.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["dataset_id", "itemset"]


def item_cells(baskets: DataFrame) -> DataFrame:
    """(dataset_id, item, bucket, bitmap) of baskets (dataset_id, row_no, item)."""
    bucket = F.bitmap_bucket_number("row_no").alias("bucket")
    return baskets.groupBy("dataset_id", "item", bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position("row_no")).alias("bitmap"))


def cells(baskets: DataFrame, itemsets: DataFrame) -> DataFrame:
    """(dataset_id, itemset, bucket, bitmap, n) of the wanted itemsets (dataset_id, itemset); buckets without a row are left out.

    Itemsets are arrays of different items; an itemset that no row holds, or of no items, has no cell.
    """
    wanted = itemsets.select(*KEYS).distinct()
    needed = wanted.select(*KEYS, F.explode("itemset").alias("item"))
    useful = baskets.join(needed.select("dataset_id", "item").distinct(), ["dataset_id", "item"], "left_semi")
    each = needed.join(item_cells(useful), ["dataset_id", "item"])
    both = each.groupBy(*KEYS, "bucket").agg(F.count("*").alias("items"), F.bitmap_and_agg("bitmap").alias("bitmap"))
    out = both.where(F.col("items") == F.size("itemset")).select(*KEYS, "bucket", "bitmap", F.bitmap_count("bitmap").alias("n"))
    return out.where("n > 0")


def support(found: DataFrame) -> DataFrame:
    """(dataset_id, itemset, count) of cells."""
    return found.groupBy(*KEYS).agg(F.sum("n").alias("count"))


def merged(*parts: DataFrame) -> DataFrame:
    """Cells of several tables, say of rows that came later, as one: bits of a cell are put together."""
    all_ = parts[0].select(*KEYS, "bucket", "bitmap")
    for p in parts[1:]:
        all_ = all_.union(p.select(*KEYS, "bucket", "bitmap"))
    both = all_.groupBy(*KEYS, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    return both.withColumn("n", F.bitmap_count("bitmap"))


def numbers(bucket: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, row number) of every bit that is set; ``bits`` has a line of bytes for each cell."""
    cell, at = np.nonzero(np.unpackbits(bits, axis=1, bitorder="little"))
    b = bucket[cell]
    return cell, np.where(b > 0, (b - 1) * 32768 + at + 1, b * 32768 - at)


def rows(found: DataFrame) -> DataFrame:
    """(dataset_id, itemset, row_no): cells as rows, one for each bit."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                bits = np.frombuffer(b"".join(part.column("bitmap").to_pylist()), np.uint8).reshape(part.num_rows, -1)
                cell, row = numbers(np.asarray(part.column("bucket")), bits)
                order = np.lexsort((row, cell))
                at = pa.array(cell[order])
                yield pa.RecordBatch.from_arrays([part.column(c).take(at) for c in KEYS] + [pa.array(row[order])], [*KEYS, "row_no"])

    kinds = {f.name: f.dataType.simpleString() for f in found.schema}
    return found.select(*KEYS, "bucket", "bitmap").mapInArrow(run, f"dataset_id {kinds['dataset_id']}, itemset {kinds['itemset']}, row_no long")


def listed(found: DataFrame) -> DataFrame:
    """(dataset_id, itemset, count, rows): all row numbers of an itemset as one ascending array, for reports."""
    return rows(found).groupBy(*KEYS).agg(F.count("*").alias("count"), F.array_sort(F.collect_list("row_no")).alias("rows"))
