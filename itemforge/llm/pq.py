"""Embedding near-duplicates by product quantisation.

Unit vectors are assigned to a coarse inverted list (k-means centroid); their residuals are stored
as codes of eight subspaces.  A query probes every list that can hold a neighbour within the
threshold: a neighbour across the bisecting plane of two centroids is at least as far as that
plane.  In a list, distances come from the query's lookup table (asymmetric); an entry survives when
its table distance is at most the threshold distance plus its own quantisation error, which loses
nothing; survivors are ranked by exact cosine in double precision.

Centroids and codebooks are fitted on a bounded sample (``SAMPLE`` vectors, those with the smallest
hashes), for each vector length on its own; a length that the sample lacks has one list. There are lists
enough that the commonest label has about ``PER_LIST`` vectors in each, since a label searches only its own
part of a list. Every vector is indexed.  Equal vectors of a label are one entry with a multiplicity, and a
list of more than ``BLOCK`` entries is split into blocks, so no group grows with the data.  Links
are not written out: each block yields counts and a spanning forest of what it found.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemforge.llm.shared import components, pick, small_or_shuffled, written

SAMPLE = 20_000
SUBSPACES = 8
CODES = 256
BLOCK = 4096
PER_LIST = 2000
QUERIES_AT_ONCE = 64


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm; empty centroids are moved to random points."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(rounds):
        at = nearest(x, c)[0]
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), len(c))])
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (c * c).sum(1)[None, :] - 2 * x @ c.T
    at = d.argmin(1)
    return at, np.sqrt(np.maximum(d[np.arange(len(x)), at] + (x * x).sum(1), 0))


def scaled(v: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, so that squares of their components stay in range."""
    v = v.astype(np.float64)
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1])


def units(v: np.ndarray) -> np.ndarray:
    v = scaled(v)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


class Index:
    def __init__(self, sample: np.ndarray, lists: int, threshold: float):
        self.dim = sample.shape[1]
        self.coarse = kmeans(sample, lists, 8)
        self.delta = float(np.sqrt(2 * (1 - threshold))) + 1e-6
        at, _ = nearest(sample, self.coarse)
        rest = sample - self.coarse[at]
        self.parts = np.array_split(np.arange(self.dim), min(SUBSPACES, self.dim))
        self.books = [kmeans(rest[:, p], CODES, 6) for p in self.parts]
        c = self.coarse
        self.between = np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(-1), 1e-18))

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and quantisation error of unit vectors."""
        at, _ = nearest(x, self.coarse)
        rest = x - self.coarse[at]
        code = np.empty((len(x), len(self.parts)), dtype=np.uint8)
        lost = np.zeros(len(x))
        for m, (p, book) in enumerate(zip(self.parts, self.books, strict=True)):
            code[:, m], e = nearest(rest[:, p], book)
            lost += e * e
        return at, code, np.sqrt(lost)

    def probes(self, x: np.ndarray) -> np.ndarray:
        """Whether a list can hold a vector within the threshold distance of each unit vector."""
        d2 = (self.coarse**2).sum(1)[None, :] - 2 * x @ self.coarse.T
        at = d2.argmin(1)
        plane = (d2 - d2[np.arange(len(x)), at][:, None]) / (2 * self.between[at])
        return plane <= self.delta

    def tables(self, q: np.ndarray, cell: int) -> np.ndarray:
        """Squared distances of the queries' residuals to every code: (query, subspace, code)."""
        rest = q - self.coarse[cell]
        out = np.full((len(q), len(self.parts), CODES), np.inf, dtype=np.float32)
        for m, (p, book) in enumerate(zip(self.parts, self.books, strict=True)):
            r = rest[:, p]
            out[:, m, : len(book)] = np.maximum((r * r).sum(1)[:, None] - 2 * r @ book.T + (book * book).sum(1)[None], 0)
        return out


class Block:
    """Entries of one block of a list, and what links have joined them so far."""

    def __init__(self, index: Index, cell: int, key, code, lost, vec, copies, threshold: float):
        self.index, self.cell, self.key, self.code, self.lost, self.copies, self.threshold = index, cell, key, code, lost, copies, threshold
        self.vec = scaled(vec)
        self.norm = np.sqrt((self.vec * self.vec).sum(1))
        self.root = np.arange(len(key))

    def search(self, key: np.ndarray, vec: np.ndarray) -> tuple[list, list, list]:
        """Rows (query, linked representative or None, number of vectors linked)."""
        q = scaled(vec)
        norm = np.sqrt((q * q).sum(1))
        table = self.index.tables(q / norm[:, None], self.cell)
        d2 = np.zeros((len(q), len(self.key)), dtype=np.float32)
        for m in range(self.code.shape[1]):
            d2 += table[:, m][:, self.code[:, m]]
        a, b, n = [], [], []
        close = np.sqrt(d2) <= self.index.delta + self.lost[None, :] + 1e-4
        for i in np.flatnonzero(close.any(1)):
            s = np.flatnonzero(close[i])
            cosine = (self.vec[s] * q[i]).sum(1) / (self.norm[s] * norm[i])
            s = s[(cosine >= self.threshold) & (self.key[s] != key[i])]
            if len(s) == 0:
                continue
            a.append(int(key[i])), b.append(None), n.append(int(self.copies[s].sum()))
            groups = np.unique(self.root[s])
            for r in groups:
                a.append(int(key[i])), b.append(int(self.key[r])), n.append(0)
            if len(groups) > 1:
                self.root[np.isin(self.root, groups)] = groups[0]
        return a, b, n


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept): one row per row of ``vectors``.

    Two vectors of one non-null label link when their cosine in double precision is at least
    ``threshold``. Vectors that are null, zero, or hold null or non-finite components link with nothing;
    the others link with those of their length. Floats are kept as such, other numbers as doubles. Equal vectors link (also rows repeated
    with one id). component_id is the smallest id reachable; null ids stay alone in it unless linked.
    Further columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    number, kept_as = ("float", "<f4") if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else ("double", "<f8")
    src = pick(vectors, id_col, vec_col, label_col).toDF("id", "vec", "label").withColumn("vec", F.col("vec").cast(f"array<{number}>"))
    good = "vec IS NOT NULL AND label IS NOT NULL AND NOT exists(vec, x -> x IS NULL OR isnan(x) OR abs(x) = float('inf')) AND exists(vec, x -> x <> 0)"
    rows = src.withColumn("key", F.when(F.expr(good), F.xxhash64("label", "vec")))
    classes = written(rows.where("key IS NOT NULL").groupBy("key", "label", "vec").agg(F.count("*").alias("copies")), "classes")
    sample = [r.vec for r in classes.select("key", "vec").orderBy(F.xxhash64("key"), "key").limit(SAMPLE).collect()]
    single = rows.select("id", "key")
    if not sample:
        return single.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    sampled: dict[int, list] = {}
    for v in sample:
        sampled.setdefault(len(v), []).append(v)
    by_label = classes.groupBy(F.size("vec").alias("dim"), "label").count()
    sizes = by_label.groupBy("dim").agg(F.max("count").alias("count")).orderBy(F.desc("count"), "dim").limit(SAMPLE).collect()
    lists = {n.dim: int(np.clip(n["count"] // PER_LIST, 8, 1024)) for n in sizes}
    indexes = spark.sparkContext.broadcast({dim: Index(units(np.array(x)), lists.get(dim, 8), threshold) for dim, x in sampled.items()})

    def index_of(dim: int) -> Index:
        return indexes.value.get(dim) or Index(np.zeros((1, dim)), 1, threshold)

    def assign(batches):
        import pyarrow as pa

        def of_one_length(batch):
            size = np.asarray(batch.column("vec").value_lengths())
            for dim in np.unique(size):
                whole = batch if (size == dim).all() else batch.take(pa.array(np.flatnonzero(size == dim)))
                ix = index_of(int(dim))
                for at in range(0, whole.num_rows, 2048):
                    yield ix, whole.slice(at, 2048)

        for b in batches:
            for ix, s in of_one_length(b):
                v = np.asarray(s.column("vec").flatten(), dtype=kept_as).reshape(s.num_rows, ix.dim)
                u = units(v)
                cell, code, lost = ix.assign(u)
                yes = ix.probes(u)
                who, where = np.nonzero(yes)
                n, m = s.num_rows, len(who)
                take = np.concatenate([np.arange(n), who])
                pick_ = pa.array(take)
                raw = pa.array([r.tobytes() for r in v], pa.binary())
                codes = pa.array([r.tobytes() for r in code] + [None] * m, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n + m, ix.dim, np.int32)), pa.array(np.concatenate([cell, where]).astype(np.int32)), s.column("label").take(pick_), pa.array(np.repeat([0, 1], [n, m]).astype(np.int32)), s.column("key").take(pick_), codes, pa.array(np.concatenate([lost, np.zeros(m)])), raw.take(pick_), s.column("copies").take(pick_)],
                    ["dim", "cell", "label", "role", "key", "code", "lost", "vec", "copies"],
                )

    label_kind = src.schema["label"].dataType.simpleString()
    listed = written(classes.mapInArrow(assign, f"dim int, cell int, label {label_kind}, role int, key long, code binary, lost double, vec binary, copies long"), "listed")
    big = listed.where("role = 0").groupBy("label", "dim", "cell").count().where(F.col("count") > BLOCK).select("label", "dim", "cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    big = small_or_shuffled(written(big, "large-lists"))
    placed = listed.join(big, ["label", "dim", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.when(F.col("role") == 0, F.array(F.pmod(F.col("key"), F.col("blocks")).cast("int"))).otherwise(F.expr("sequence(0, blocks - 1)"))
    placed = placed.withColumn("block", F.explode(block)).repartition("label", "dim", "cell", "block").sortWithinPartitions("label", "dim", "cell", "block", "role")

    def search(batches):
        import pyarrow as pa

        now, held, block = None, [], None
        for b in batches:
            tag = list(zip(b.column("label").to_pylist(), b.column("dim").to_pylist(), b.column("cell").to_pylist(), b.column("block").to_pylist(), b.column("role").to_pylist(), strict=True))
            at = 0
            while at < len(tag):
                end = at + 1
                while end < len(tag) and tag[end] == tag[at]:
                    end += 1
                s, (group, role) = b.slice(at, end - at), (tag[at][:4], tag[at][4])
                at = end
                if group != now:
                    now, held, block = group, [], None
                if role == 0:
                    held.append(s)
                    continue
                if not held:
                    continue
                if block is None:
                    t = pa.Table.from_batches(held)
                    vec = np.frombuffer(b"".join(t.column("vec").to_pylist()), kept_as).reshape(-1, group[1])
                    code = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(len(vec), -1)
                    block = Block(index_of(group[1]), group[2], np.asarray(t.column("key")), code, np.asarray(t.column("lost")).astype(np.float32), vec, np.asarray(t.column("copies")), threshold)
                keys = np.asarray(s.column("key"))
                vecs = np.frombuffer(b"".join(s.column("vec").to_pylist()), kept_as).reshape(-1, group[1])
                for i in range(0, len(keys), QUERIES_AT_ONCE):
                    x, y, n = block.search(keys[i : i + QUERIES_AT_ONCE], vecs[i : i + QUERIES_AT_ONCE])
                    if x:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])

    found = written(placed.select("label", "dim", "cell", "block", "role", "key", "code", "lost", "vec", "copies").mapInArrow(search, "a long, b long, n long"), "found")
    links = found.where("b IS NULL").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
    root = components(found.where("b IS NOT NULL").select("a", "b"), "pq-edges").select(F.col("node").alias("key"), "root")
    stats = classes.select("key", "copies").join(links, "key", "left").join(root, "key", "left").select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "key").alias("root"))
    whole = written(single.join(stats, "key", "left"), "members")
    least = whole.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("least"))
    out = whole.join(least, "root", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.expr("id <=> component_id").alias("kept"))
