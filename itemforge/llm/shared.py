"""Spark helpers of the corpus operators: written tables, checked broadcasts, seed filters, components."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.llm.textkit import mix

#: A table is sent to every executor only if its files are no larger than this; else it is shuffled.
BROADCAST_BYTES = 8 << 20
#: Bytes of a row group of a written table: writers and readers hold one in memory.
ROW_GROUP = 8 << 20
#: Bits of a seed filter or key map: 16 a key, within these bounds (at most 32 MB a worker).
FILTER_BITS = (1 << 16, 1 << 28)
#: Words of 64 bits in a key map that Spark broadcasts as a table.
MAP_WORDS = 1 << 20
#: A key of more rows than this is dealt over several tasks.
HOT_SEED = 4000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.

    Where it is unset a local master gets a temporary folder; on a cluster, whose machines do not share
    one, that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="itemforge-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a Parquet table in the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **{"parquet.block.size": ROW_GROUP}).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_folder", None):
            spark = t.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate; for a table read from files, their size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small_or_shuffled(df: DataFrame) -> DataFrame:
    """Mark a written table for broadcast if its checked size allows; otherwise Spark shuffles both sides."""
    return F.broadcast(df) if table_bytes(df) <= BROADCAST_BYTES else df


def matched(texts: DataFrame, few: DataFrame, keys: list[str], inner: bool = False) -> DataFrame:
    """``texts`` joined on ``keys`` to a written table, left or inner, without shuffling texts that match nothing.

    A bitmap of the keys' hashes in ``few`` (a table of at most ``MAP_WORDS`` words, whatever the data is) is
    broadcast: texts whose bit is unset pass by in the scan, and only the others are shuffled to meet ``few``.
    The plan is the same at every size.
    """
    how = "inner" if inner else "left"
    words = 1 << int(np.clip(few.count() // 4, 1 << 10, MAP_WORDS) - 1).bit_length()

    def place(df: DataFrame) -> DataFrame:
        h = F.xxhash64(*keys)
        return df.withColumns({"_word": F.pmod(F.shiftright(h, 6), F.lit(words)), "_bit": h.bitwiseAND(63).cast("int")})

    bits = place(few.select(*keys)).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    marked = place(texts).join(F.broadcast(bits), "_word", "left")
    hit = F.coalesce(F.expr("getbit(_bits, _bit)") == 1, F.lit(False))
    some = marked.where(hit).select(*texts.columns).join(few, keys, how)
    if inner:
        return some
    rest = marked.where(~hit).select(*texts.columns)
    new = [f for f in few.schema if f.name not in keys]
    return some.unionByName(rest.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in new]))


def dealt(rows: DataFrame, hot: DataFrame | None, key: str) -> DataFrame:
    """Adds ``parts``: in how many parts the row's key is dealt, 1 for a key that is not hot."""
    if hot is None:
        return rows.withColumn("parts", F.lit(1))
    return rows.join(small_or_shuffled(hot.withColumnRenamed("key", key)), key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))


#: Bytes of an Arrow batch, and rows that the Parquet reader decodes at a time: texts are long, the JVM and
#: Python hold a batch at once, and arrays of half a megabyte would go straight to the JVM's old generation.
BATCH_BYTES = 1 << 20
READ_ROWS = 64


def ship(spark: SparkSession) -> None:
    """Ready a session: small batches, and the package sent to executors that do not find it on their own path."""
    import itemforge

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    root = Path(itemforge.__file__).resolve().parent.parent
    seen = {Path(p or ".").resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]}
    if root in seen or getattr(spark.sparkContext, "_itemforge_shipped", False):
        return
    made = shutil.make_archive(f"{tempfile.mkdtemp()}/itemforge", "zip", root, "itemforge")
    spark.sparkContext.addPyFile(made)
    spark.sparkContext._itemforge_shipped = True


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns, clashing names included, cannot interfere."""
    return df.select(*[F.col(n) for n in names])


def carried(id_col: str, keep: list[str] | None) -> Column:
    """The id, or all columns to keep, as one column that an operator hands through."""
    return F.struct(*[F.col(c) for c in keep]) if keep else F.col(id_col)


def released(id_col: str, keep: list[str] | None, name: str = "id") -> list[Column]:
    return [F.col(f"{name}.{c}") for c in keep] if keep else [F.col(name).alias(id_col)]


# --- filter of repeated seeds -------------------------------------------------------------------


class SeedFilter:
    """A Bloom filter with two probes. It only saves work: false positives drop out later."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    @staticmethod
    def probes(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        top = np.uint64(64 - (bits.bit_length() - 1))
        return keys >> top, (keys * np.uint64(0xBF58476D1CE4E5B9)) >> top

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), dtype=bool)
        for p in self.probes(keys, self.bits):
            out &= (self.words[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def key_filter(keys: DataFrame, count: int) -> SeedFilter:
    """A filter holding every ``key`` of a written table; executors build it in 64 segments, the driver joins bitmaps of bounded size."""
    bits = 1 << int(np.clip(16 * max(count, 1), *FILTER_BITS) - 1).bit_length()
    segment = bits // 64

    def build(batches):
        import pyarrow as pa

        maps: dict[int, np.ndarray] = {}
        for b in batches:
            p = np.asarray(b.column("place")).astype(np.int64)
            for s in np.unique(p // segment):
                at = p[p // segment == s] - s * segment
                m = maps.setdefault(int(s), np.zeros(segment, dtype=bool))
                m[at] = True
        for s, m in maps.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(m, bitorder="little").tobytes()], pa.binary())], ["segment", "bitmap"])

    def probe(batches):
        import pyarrow as pa

        for b in batches:
            k = np.asarray(b.column("key")).view(np.uint64)
            for p in SeedFilter.probes(k, bits):
                yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int64))], ["place"])

    words = np.zeros(bits // 8, dtype=np.uint8)
    if count:
        places = keys.select("key").mapInArrow(probe, "place long")
        parts = places.repartition(16, F.floor(F.col("place") / segment)).mapInArrow(build, "segment int, bitmap binary")
        for r in parts.toLocalIterator():
            at = r.segment * (segment // 8)
            words[at : at + segment // 8] |= np.frombuffer(r.bitmap, np.uint8)
    return SeedFilter(words, bits)


def seed_filter(keys: DataFrame, name: str, hot_rows: int | None = None) -> tuple[SeedFilter, DataFrame | None]:
    """``keys`` (key long, n long): a filter holding every key whose n sum to two or more, and the hot keys.

    A key of more than ``hot_rows`` rows is hot: (key, parts) tells in how many parts of at most half that
    many rows it is dealt. The hot keys are a written table (None without any), joined to the rows
    like any other. Counting is a map-side combined aggregate, so a hot key is no hot task.
    """
    hot_rows = hot_rows or HOT_SEED
    repeated = written(keys.groupBy("key").agg(F.sum("n").alias("n")).where("n >= 2"), name)
    count, most = repeated.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    hot = None
    if most > hot_rows:
        hot = written(repeated.where(F.col("n") > hot_rows).select("key", F.ceil(F.col("n") / max(1, hot_rows // 2)).cast("int").alias("parts")), f"{name}-hot")
    found = key_filter(repeated, count)
    discard(repeated)
    return found, hot


# --- connected components -----------------------------------------------------------------------


#: Edges (16 bytes each) whose components one executor task finds at once instead of in rounds.
EDGES_AT_ONCE = 1 << 20


def joined_up(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) of the edges u - v."""
    node, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(node))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return node, node[root]
        least = np.minimum(x, y)
        np.minimum.at(root, x, least)
        np.minimum.at(root, y, least)
        while (root[root] != root).any():
            root = root[root]


def components(edges: DataFrame, name: str) -> DataFrame:
    """(a long, b long) -> (node, root): root is the smallest node reachable. Nodes without edges are absent.

    Alternating large-star and small-star rounds until nothing changes; each round is a written table, so
    an executor can be lost at any time. Minimum by node is a map-side combined aggregate; the join back is
    a plain equi-join that adaptive execution may split on a hub. At most ``EDGES_AT_ONCE`` edges, counted
    first, fit one task, which gives the same without rounds.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()

    last = state(e)
    if last[0] == 0:
        return e.selectExpr("u AS node", "v AS root")
    if last[0] <= EDGES_AT_ONCE:
        def at_once(batches):
            import pyarrow as pa

            t = pa.Table.from_batches(list(batches))
            if t.num_rows:
                node, root = joined_up(np.asarray(t.column("u")), np.asarray(t.column("v")))
                for i in range(0, len(node), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(node[i : i + (1 << 16)]), pa.array(root[i : i + (1 << 16)])], ["node", "root"])

        out = written(e.repartition(1).mapInArrow(at_once, "node long, root long"), f"{name}-roots")
        discard(e)
        return out

    def with_roots(stars: DataFrame) -> DataFrame:
        return stars.selectExpr("u AS node", "v AS root").union(stars.selectExpr("v AS node", "v AS root").distinct())

    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, f"{name}-l")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = e, written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), f"{name}-s")
        now = state(e)
        discard(before, large)
        if now == last:
            return with_roots(e)
        last = now
