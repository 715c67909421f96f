"""Token ids as canonical, length-limited Huffman code.

Counts of all ids over the whole corpus give the code lengths (package-merge, at most 16 bits);
lengths alone define the canonical code, so the code book is one small table.  The file format is a
folder of Parquet files:

* ``codebook``: (symbol int, bits int), the length of each symbol's code;
* ``blocks``: one row for each independent block of whole documents in ascending id order:
  part, block (order of the blocks), first (ids before the block in its part), ids and n_tokens (of
  each document), at (first byte of each document), payload (the code, most significant bit first,
  each document beginning on a byte), marks (unsigned 32-bit bit offsets within its document of
  every 128th id: checkpoints from which decoding can start).

Decoding looks 16 bits up in a table and follows all checkpoints of a batch side by side.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.llm import textkit as tk
from itemforge.llm.shared import ROW_GROUP, pick, table_bytes, written
from itemforge.llm.wordbpe import word_bpe

LIMIT = 16
STEP = 128
BLOCK_IDS = 1 << 16
LANE_IDS = 1 << 18
PART_BYTES = 32 << 20
MOST_PARTS = 20_000


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for symbols never seen."""
    seen = np.flatnonzero(counts > 0)
    out = np.zeros(len(counts), dtype=np.uint8)
    n = len(seen)
    if n == 0:
        return out
    if n == 1:
        out[seen] = 1
        return out
    if n > 1 << limit:
        raise ValueError("more symbols than codes of this length")
    order = seen[np.argsort(counts[seen], kind="stable")]
    weight = counts[order].astype(np.int64)
    level, leaf_flags = weight, [np.ones(n, dtype=bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weight, pairs])
        at = np.argsort(both, kind="stable")
        leaf_flags.append(at < n)
        level = both[at]
    take = 2 * n - 2
    size = np.zeros(n, dtype=np.uint8)
    for flags in reversed(leaf_flags):
        leaves = int(flags[:take].sum())
        size[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = size
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by ascending (length, symbol)."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code = last = 0
    for s in order:
        code <<= int(lengths[s]) - last
        last = int(lengths[s])
        codes[s] = code
        code += 1
    return codes


def lookup_tables(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length for every value of the next ``limit`` bits."""
    codes = canonical_codes(lengths)
    symbol = np.zeros(1 << limit, dtype=np.int32)
    size = np.ones(1 << limit, dtype=np.uint8)
    seen = np.flatnonzero(lengths)
    first = (codes[seen] << (limit - lengths[seen]).astype(np.uint64)).astype(np.int64)
    width = (1 << (limit - lengths[seen].astype(np.int64))).astype(np.int64)
    at = tk.spread(first, width)
    symbol[at] = np.repeat(seen, width)
    size[at] = np.repeat(lengths[seen], width)
    return symbol, size


def encode_documents(ids: np.ndarray, n_tokens: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Code of many documents: payload, first byte of each (and the end), marks, marks before each."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    before = ends - size
    last = np.cumsum(n_tokens)
    first = last - n_tokens
    total = np.concatenate([[0], ends])
    bits = total[last] - total[first]
    at = np.concatenate([[0], np.cumsum((bits + 7) // 8)])
    within = before - np.repeat(total[first], n_tokens)
    pos = np.repeat(8 * at[:-1], n_tokens) + within
    word, shift = pos >> 5, (pos & 31).astype(np.uint64)
    value = codes[ids] << (np.uint64(64) - shift - size.astype(np.uint64))
    out = np.zeros(int(at[-1]) // 4 + 3, dtype=np.uint64)
    if len(ids):
        s, _ = tk.runs(word)
        out[word[s]] += np.add.reduceat(value >> np.uint64(32), s)
        out[word[s] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), s)
    payload = out.astype(">u4").tobytes()[: int(at[-1])]
    count = -(-n_tokens // STEP)
    marks = within[tk.spread(first, n_tokens)[_every(n_tokens)]] if len(ids) else np.empty(0, np.int64)
    return payload, at, marks.astype("<u4"), np.concatenate([[0], np.cumsum(count)])


def _every(n_tokens: np.ndarray) -> np.ndarray:
    """Whether an id's place in its document is a multiple of STEP."""
    first = np.cumsum(n_tokens) - n_tokens
    return (np.arange(int(n_tokens.sum())) - np.repeat(first, n_tokens)) % STEP == 0


def decode_documents(payload: np.ndarray, at: np.ndarray, n_tokens: np.ndarray, marks: np.ndarray, symbol: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Ids of many documents; every checkpoint is a lane and all lanes advance together."""
    count = -(-n_tokens // STEP)
    lane_doc = np.repeat(np.arange(len(n_tokens)), count)
    lane_no = tk.spread(np.zeros(len(count), np.int64), count)
    todo = np.minimum(STEP, n_tokens[lane_doc] - lane_no * STEP)
    pos = 8 * at[lane_doc] + marks.astype(np.int64)
    order = np.argsort(-todo, kind="stable")
    pos, left = pos[order], todo[order]
    p = np.concatenate([payload, np.zeros(3, np.uint8)]).astype(np.int32)
    next24 = (p[:-2] << 16) | (p[1:-1] << 8) | p[2:]
    grid = np.zeros((STEP, len(order)), dtype=np.int32)
    for t in range(int(left[0]) if len(left) else 0):
        k = int(np.searchsorted(-left, -t, side="left"))
        q = pos[:k]
        v = (next24[q >> 3] >> (8 - (q & 7)).astype(np.int32)) & 0xFFFF
        grid[t, :k] = symbol[v]
        q += size[v]
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.arange(len(order))
    flat = grid.T[back]
    return flat[np.arange(STEP)[None, :] < todo[:, None]].astype(np.uint32)


def tokenize(docs: DataFrame, vocabulary: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_tokens, low, high): ids of each document with the end id, as planes of low and high bytes."""
    src = pick(docs, id_col, text_col).toDF("id", "text")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        bpe = word_bpe(vocabulary)
        if bpe.size > 1 << 16:
            raise ValueError("a vocabulary of at most 65536 ids is needed")
        for b in batches:
            data, off = tk.column_bytes(b.column("text"))
            for i, j in tk.chunks(off):
                ids, n = bpe.encode_many([data[off[k] : off[k + 1]].tobytes() for k in range(i, j)])
                n = n + 1
                cut = np.concatenate([[0], np.cumsum(n)])
                flat = np.full(cut[-1], end_id, dtype=np.uint32)
                inner = np.ones(len(flat), dtype=bool)
                inner[cut[1:] - 1] = False
                flat[inner] = ids
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), pa.array(n), tk.binary_array((flat & 255).astype(np.uint8), cut), tk.binary_array((flat >> 8).astype(np.uint8), cut)], ["id", "n_tokens", "low", "high"])

    return src.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, low binary, high binary")


def _flat_ids(b) -> tuple[np.ndarray, np.ndarray]:
    low, off = tk.column_bytes(b.column("low"))
    high, _ = tk.column_bytes(b.column("high"))
    return low.astype(np.uint32) | (high.astype(np.uint32) << 8), off


def count_ids(tokens: DataFrame, size: int) -> np.ndarray:
    """Occurrences of every id over the whole table: summed in each task, then by Spark; at most ``size`` rows reach the driver."""

    def count(batches):
        import pyarrow as pa

        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                total += np.bincount(_flat_ids(b.slice(at, 256))[0], minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["symbol", "n"])

    out = np.zeros(size, dtype=np.int64)
    for r in tokens.select("low", "high").mapInArrow(count, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect():
        out[r.symbol] = r.n
    return out


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id`` to each and write the format at ``path``, ids ascending.

    Null ids come first; rows with equal ids stand side by side in the order of their codes' hashes; a
    null or empty text is the end id alone; an empty table gives an empty code book and no block.
    Further columns are ignored. Parts are ranges of ids by approximate quantiles; an id that spans
    several of them is split by the hash, so its rows do not have to meet in one task. ``id_col``
    holds integers.
    """
    spark = docs.sparkSession
    tokens = written(tokenize(docs, vocabulary, end_id, id_col, text_col), "ids")
    kind = tokens.schema["id"].dataType.simpleString()
    lengths = code_lengths(count_ids(tokens, word_bpe(vocabulary).size))
    codes = canonical_codes(lengths)
    spark.createDataFrame([(int(s), int(lengths[s])) for s in np.flatnonzero(lengths)], "symbol int, bits int").coalesce(1).write.parquet(f"{path}/codebook")

    bounds = id_bounds(tokens)

    def encode(batches):
        import zlib

        import pyarrow as pa

        for b in batches:
            for i, j in tk.chunks(np.concatenate([[0], np.cumsum(np.asarray(b.column("n_tokens")))]), 1 << 19):
                part = b.slice(i, j - i)
                ids, _ = _flat_ids(part)
                payload, at, marks, before = encode_documents(ids, np.asarray(part.column("n_tokens")), lengths, codes)
                tie = np.array([zlib.crc32(payload[x:y]) for x, y in zip(at, at[1:], strict=False)], dtype=np.int64)
                key = np.asarray(part.column("id").cast(pa.int64()).fill_null(-(1 << 63)))
                first, last = np.searchsorted(bounds, key, side="left"), np.searchsorted(bounds, key, side="right")
                place = first + ((tie * (last - first + 1)) >> 32)
                yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(tie), part.column("id"), part.column("n_tokens"), tk.binary_array(np.frombuffer(payload, np.uint8), at), tk.binary_array(marks.view(np.uint8), 4 * before)], ["part", "tie", "id", "n_tokens", "code", "marks"])

    def blocks(batches):
        import pyarrow as pa

        held: list = []
        part, number, first, size = None, 0, 0, 0

        def block():
            nonlocal number, first, size, held
            t = pa.Table.from_batches(held).combine_chunks()
            code, at = tk.column_bytes(t.column("code"))
            marks, _ = tk.column_bytes(t.column("marks"))
            whole = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([first], pa.int64())]
            lists = [pa.array([t.column("id").to_pylist()], pa.list_(t.schema.field("id").type)), pa.array([t.column("n_tokens").to_pylist()], pa.list_(pa.int64())), pa.array([at[:-1].tolist()], pa.list_(pa.int64()))]
            out = pa.RecordBatch.from_arrays([*whole, *lists, pa.array([code.tobytes()], pa.binary()), pa.array([marks.tobytes()], pa.binary())], ["part", "block", "first", "ids", "n_tokens", "at", "payload", "marks"])
            first, number, size, held = first + size, number + 1, 0, []
            return out

        for b in batches:
            parts, n = np.asarray(b.column("part")), np.asarray(b.column("n_tokens"))
            starts, ends = tk.runs(parts)
            for s, e in zip(starts, ends, strict=True):
                if parts[s] != part:
                    if held:
                        yield block()
                    part, number, first = int(parts[s]), 0, 0
                for i, j in tk.chunks(np.concatenate([[0], np.cumsum(n[s:e])]), BLOCK_IDS):
                    held.append(b.slice(s + i, j - i))
                    size += int(n[s + i : s + j].sum())
                    if size >= BLOCK_IDS:
                        yield block()
        if held:
            yield block()

    coded = tokens.mapInArrow(encode, f"part int, tie long, id {kind}, n_tokens long, code binary, marks binary")
    ordered = coded.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "id", "tie", "n_tokens", "code")
    made = ordered.mapInArrow(blocks, f"part int, block int, first long, ids array<{kind}>, n_tokens array<long>, at array<long>, payload binary, marks binary")
    made.write.option("parquet.block.size", ROW_GROUP).parquet(f"{path}/blocks")


def id_bounds(tokens: DataFrame) -> np.ndarray:
    """Ids that part the table into ranges of about ``PART_BYTES`` each; repeated where one id spans several."""
    n = int(np.clip(table_bytes(tokens) // PART_BYTES, 1, MOST_PARTS))
    if n == 1:
        return np.empty(0, np.int64)
    got = tokens.agg(F.percentile_approx(F.col("id").cast("long"), [k / n for k in range(1, n)], 10 * n).alias("q")).first().q
    return np.array(got or [], dtype=np.int64)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Decode a folder of ``write_ids``: (id, start, n_tokens, ids binary of little-endian unsigned 32-bit ids).

    ``start`` counts the ids of all documents before. What reaches the driver is the code book and
    one total for each part. A null id comes back as null and first, repeated ids as rows of their own, a
    document that was null or empty as its end id; an empty folder gives no rows. Documents of any length
    are decoded from their checkpoints alike.
    """
    book = spark.read.schema("symbol int, bits int").parquet(f"{path}/codebook").collect()
    lengths = np.zeros(max([r.symbol for r in book], default=0) + 1, dtype=np.uint8)
    for r in book:
        lengths[r.symbol] = r.bits
    symbol, size = lookup_tables(lengths)
    table = spark.read.parquet(f"{path}/blocks")
    kind = table.schema["ids"].dataType.elementType.simpleString()
    total = {r.part: r.n for r in table.groupBy("part").agg(F.sum(F.expr("aggregate(n_tokens, 0L, (s, x) -> s + x)")).alias("n")).collect()}
    base, before = {}, 0
    for part in sorted(total):
        base[part], before = before, before + total[part]

    def decode(batches):
        import pyarrow as pa

        for b in batches:
            load = np.array([sum(x) for x in b.column("n_tokens").to_pylist()], dtype=np.int64)
            for i, j in tk.chunks(np.concatenate([[0], np.cumsum(load)]), LANE_IDS):
                s = b.slice(i, j - i)
                payload, byte = tk.column_bytes(s.column("payload"))
                marks, _ = tk.column_bytes(s.column("marks"))
                per = np.array([len(x) for x in s.column("n_tokens").to_pylist()], dtype=np.int64)
                n = np.asarray(s.column("n_tokens").flatten()).astype(np.int64)
                at = np.asarray(s.column("at").flatten()).astype(np.int64) + np.repeat(byte[:-1], per)
                ids = decode_documents(payload, at, n, marks.view("<u4"), symbol, size)
                cut = np.concatenate([[0], np.cumsum(n)])
                first = np.array([base[p] for p in s.column("part").to_pylist()], dtype=np.int64) + np.asarray(s.column("first"))
                lead = np.concatenate([[0], np.cumsum(per)])[:-1]
                start = cut[:-1] - np.repeat(cut[lead], per) + np.repeat(first, per)
                yield pa.RecordBatch.from_arrays([s.column("ids").flatten(), pa.array(start), pa.array(n), tk.binary_array(ids.astype("<u4").view(np.uint8), 4 * cut)], ["id", "start", "n_tokens", "ids"])

    return table.mapInArrow(decode, f"id {kind}, start long, n_tokens long, ids binary")
