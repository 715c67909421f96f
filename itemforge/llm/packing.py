"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are the binary digits of n (with as many
pieces of the longest length as fit): each piece is a sequence of its own, so no sequence crosses
documents and no token is padding. Pieces of equal length form a bucket; a training step reads
batches from one bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemforge.llm import textkit as tk
from itemforge.llm.bpe import byte_bpe
from itemforge.llm.shared import pick

SEQUENCE = 2048
END_ID = 1


def binary_pieces(n: int, longest: int = SEQUENCE) -> list[int]:
    """Lengths, in order, of the pieces of a document of n tokens."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_documents(docs: DataFrame, vocabulary: str, longest: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every document with ``end_id`` last, cut into pieces of power-of-two length.

    Returns (id, start, length, ids binary of little-endian unsigned 32-bit ids, doc_tokens,
    sequence_id, offset, bucket): a piece is its sequence, offset is 0, bucket is log2 of the
    length. One pass, no shuffle; sequence_id is the piece's partition and place, so it is unique
    and the same whenever the same files are read again. A null or empty text is the end id alone;
    repeated rows are packed each on its own; no rows give no sequences.
    """
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    src = pick(docs, id_col, text_col).toDF("id", "text")
    kind = docs.schema[id_col].dataType.simpleString()

    def pack(batches):
        import pyarrow as pa

        bpe = byte_bpe(vocabulary)
        end = np.array([end_id], dtype=np.uint32)
        for b in batches:
            data, off = tk.column_bytes(b.column("text"))
            for i, j in tk.chunks(off):
                ids = [np.concatenate([bpe.encode(data[off[k] : off[k + 1]].tobytes()), end]) for k in range(i, j)]
                cut = [binary_pieces(len(x), longest) for x in ids]
                count = np.array([len(c) for c in cut], dtype=np.int64)
                length = np.array([n for c in cut for n in c], dtype=np.int64)
                total = np.repeat([len(x) for x in ids], count).astype(np.int64)
                before = np.concatenate([[0], np.cumsum(length)])
                doc_first = np.concatenate([[0], np.cumsum([len(x) for x in ids])])[:-1]
                start = before[:-1] - np.repeat(doc_first, count)
                flat = np.concatenate(ids).astype("<u4").view(np.uint8)
                key = b.column("id").slice(i, j - i).take(pa.array(np.repeat(np.arange(j - i), count)))
                yield pa.RecordBatch.from_arrays([key, pa.array(start), pa.array(length), tk.binary_array(flat, 4 * before), pa.array(total)], ["id", "start", "length", "ids", "doc_tokens"])

    pieces = src.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(pack, f"id {kind}, start long, length long, ids binary, doc_tokens long")
    return pieces.select(
        F.col("id").alias(id_col), "start", "length", "ids", "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.log2("length").cast("int").alias("bucket"),
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write packed pieces, one folder for each sequence length, replacing what is there.

    Equal pieces and pieces with a null id are written as they are; without pieces there is no folder.
    """
    pieces.write.mode("overwrite").partitionBy("bucket").parquet(path)
