"""Exact quantiles without sorting or holding a column: selection by rank in ever finer histograms.

Each round is one aggregate over the rows, combined where they lie: how many values fall into each part of the
ranges in which the wanted ranks are, and the least and largest of them. The part that holds a rank is its
next range, until its values are all alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of a range in a round. Ranges end at values that exist, so every round tells at least its ends apart.
PARTS = 1024


def values_at(df: DataFrame, columns: dict[str, Column], ranks: dict[str, Sequence[int]]) -> dict[str, dict[int, float]]:
    """For each named column its values at some ranks from 0, nulls left out, NaN last as the largest."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), c.cast("double").alias("x")) for k, c in columns.items()])).alias("v")).select("v.*").where("x IS NOT NULL")
    found: dict[str, dict[int, float]] = {k: {} for k in columns}
    ends = {r.k: (r.lo, r.hi) for r in rows.groupBy("k").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}
    open_: dict[tuple[str, int], tuple[float, float, int]] = {(k, r): (*ends[k], 0) for k, wanted in ranks.items() for r in wanted if k in ends}
    while True:
        for (k, r), (lo, hi, _) in list(open_.items()):
            if lo == hi or (lo != lo and hi != hi):
                found[k][r] = lo
                del open_[k, r]
        if not open_:
            return found
        ranges = sorted({(k, lo, hi) for (k, _), (lo, hi, _) in open_.items()}, key=str)
        part = None
        for i, (k, lo, hi) in enumerate(ranges):
            share = F.try_divide(F.col("x") / 2 - lo / 2, F.lit(hi / 2 - lo / 2))
            share = F.coalesce(F.nanvl(share, F.lit(0.5)), F.lit(0.5))
            inner = F.least(F.greatest(F.floor(share * PARTS), F.lit(0)), F.lit(PARTS - 1))
            at = F.when(F.col("x") == lo, -1).when(F.col("x") == hi, PARTS).otherwise(inner)  # the ends are parts of their own
            here = (F.col("k") == k) & (F.col("x") >= lo) & (F.col("x") <= hi)
            part = (F.when if part is None else part.when)(here, F.struct(F.lit(i).alias("i"), at.cast("int").alias("at")))
        seen: dict[int, list] = {}
        for r in rows.withColumn("part", part).where("part IS NOT NULL").groupBy("part").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect():
            seen.setdefault(r.part.i, []).append((r.part.at, r.n, r.lo, r.hi))
        index = {x: i for i, x in enumerate(ranges)}
        for (k, r), (lo, hi, before) in list(open_.items()):
            for _, n, low, high in sorted(seen[index[k, lo, hi]]):
                if r < before + n:
                    open_[k, r] = (low, high, before)
                    break
                before += n


def quantiles(df: DataFrame, columns: dict[str, Column], shares: Sequence[float]) -> dict[str, list[float]]:
    """For each named column its exact quantiles, linear between neighbouring ranks; no numbers for a column without values."""
    counts = df.agg(*[F.count(c.cast("double")).alias(k) for k, c in columns.items()]).first().asDict()
    spots = {k: [q * (n - 1) for q in shares] for k, n in counts.items() if n}
    ranks = {k: sorted({r for p in at for r in (int(p), min(int(p) + 1, counts[k] - 1))}) for k, at in spots.items()}
    found = values_at(df, {k: columns[k] for k in ranks}, ranks) if ranks else {}
    out: dict[str, list[float]] = {k: [] for k in columns}
    for k, at in spots.items():
        for p in at:
            low, high = found[k][int(p)], found[k][min(int(p) + 1, counts[k] - 1)]
            out[k].append(low if low == high or p == int(p) else (int(p) + 1 - p) * low + (p - int(p)) * high)
    return out
