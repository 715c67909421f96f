"""Sort-means clustering of integer vectors: exact, and without most distances.

Each round orders the other centroids by their distance from each centroid. A vector first measures
its previous centroid and then scans the others in that one's order, until the next lies strictly
beyond twice the distance measured first: by the triangle inequality none from there on is as
near. All distances are squares of integers, so nothing is rounded and ties are seen as such.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemforge.llm.shared import discard, pick, written

CLUSTERS, ROUNDS, COMPONENTS, SCALE = 16, 3, 64, 64
#: Components are held within these bounds, so that a squared distance fits 64 bits.
BOUND = 1 << 27
#: Parts in which the sums of a cluster are added before they meet.
TREE = 64


def integer_components(x: Column, components: int, scale: int) -> tuple[Column, Column]:
    """Whether a vector counts, and its components as integers floor(scale * x)."""
    x = x.cast("array<double>")
    fine = (F.size(x) == components) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    held = F.transform(x, lambda v: F.floor(F.least(F.greatest(v * scale, F.lit(float(-BOUND))), F.lit(float(BOUND)))).cast("int"))
    return F.coalesce(fine, F.lit(False)), held


def squares(points: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    away = points - centroid
    return np.einsum("ij,ij->i", away, away)


def nearest(points: np.ndarray, previous: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each point, ties to the smaller number, scanning from its previous cluster."""
    cluster, distance = previous.copy(), np.zeros(len(points), np.int64)
    for i in np.unique(previous).tolist():
        rows = np.flatnonzero(previous == i)
        first = squares(points[rows], centroids[i])
        best, who = first.copy(), np.full(len(rows), i, previous.dtype)
        between = squares(centroids, centroids[i])
        left = np.arange(len(rows))
        for j in np.argsort(between, kind="stable").tolist():
            if j == i:
                continue
            left = left[first[left] > (between[j] - 1) >> 2]  # between[j] > 4 * first ends the scan
            if not len(left):
                break
            d = squares(points[rows[left]], centroids[j])
            nearer = (d < best[left]) | ((d == best[left]) & (j < who[left]))
            best[left[nearer]], who[left[nearer]] = d[nearer], j
        cluster[rows], distance[rows] = who, best
    return cluster, distance


def batch_points(column, components: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64).reshape(-1, components)


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vectors`` (id, v, cluster) with the cluster and distance under these centroids."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            cluster, distance = nearest(batch_points(b.column("v"), centroids.shape[1]), np.asarray(b.column("cluster")), centroids)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(cluster), pa.array(distance)], ["id", "v", "cluster", "distance"])

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.select("id", "v", "cluster").mapInArrow(run, f"id {kind}, v array<int>, cluster int, distance long")


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after a round: floor(sum / count) by component, exact; those without vectors stay."""
    k, components = centroids.shape

    def run(batches):
        import pyarrow as pa

        n, total = np.zeros(k, np.int64), np.zeros((k, components), np.int64)
        for b in batches:
            points, cluster = batch_points(b.column("v"), components), np.asarray(b.column("cluster"))
            n += np.bincount(cluster, minlength=k)
            for j in np.unique(cluster).tolist():
                total[j] += points[cluster == j].sum(axis=0)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array(total[at].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    def added(sums: DataFrame, *keys: str) -> DataFrame:
        each = [F.sum(F.get("total", i).cast("decimal(38,0)")) for i in range(components)]
        return sums.groupBy(*keys).agg(F.sum("n").alias("n"), F.array(*each).alias("total"))

    sums = vectors.select("v", "cluster").mapInArrow(run, "cluster int, n long, total array<long>")
    out = centroids.copy()
    tree = added(sums.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(TREE))), "cluster", "part")
    for r in added(tree, "cluster").collect():  # one row a cluster
        out[r.cluster] = [int(x) // r.n for x in r.total]
    return out


def sort_means(df: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance) of every vector, centroids) after ``rounds`` rounds and a last assignment.

    Vectors with another number of components, or with a null or non-finite one, are left out, null
    vectors too; components are floor(scale * x), held within 2**27. The start is the vectors with the
    smallest SHA-256 of ``1:<id>``; null ids come last there, equal ids in the order of their vectors,
    and equal vectors are centroids of their own. Fewer vectors than clusters make fewer centroids, an
    empty table none. Equal rows are vectors each; further columns are ignored.

    Each round's vectors with their cluster are a written table (about a byte a component), so a lost
    executor costs no more than its part of a round; the driver holds the centroids only.
    """
    fine, held = integer_components(F.col(vec_col), components, scale)
    vectors = written(pick(df, id_col, vec_col).where(fine).select(F.col(id_col).alias("id"), held.alias("v"), F.lit(0).alias("cluster")), "vectors")
    chance = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    start = vectors.orderBy(chance.asc_nulls_last(), "v").limit(clusters).select("v").collect()
    centroids = np.array([r.v for r in start], dtype=np.int64).reshape(len(start), components)
    if not len(start):
        return vectors.select("id", "cluster", F.lit(0).cast("long").alias("distance")), centroids
    for r in range(rounds + 1):
        before, vectors = vectors, written(assigned(vectors, centroids), f"assigned-{r}")
        discard(before)
        if r < rounds:
            centroids = moved(vectors, centroids)
    return vectors.select("id", "cluster", "distance"), centroids


def clustering(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", **settings) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that ``sort_means`` takes."""
    found, centroids = sort_means(df, id_col=id_col, vec_col=vec_col, **settings)
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    part = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    rows = [(j, str(part.get(j, 0)), str(sum(part.values())), digest[j]) for j in range(len(digest))]
    of = df.sparkSession.createDataFrame(rows, "cluster int, c string, t string, centroid_sha256 string")  # a row a cluster
    fits = [F.least(F.col(a).cast("decimal(38,0)"), most).cast("long").alias(b) for a, b in (("c", "cluster_inertia"), ("t", "inertia"))]
    out = found.join(F.broadcast(of.select("cluster", *fits, "centroid_sha256")), "cluster")
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
