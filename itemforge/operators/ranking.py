"""Places inside groups of any size: no task sees a group whole.

A window over a group is one task for it, however large it is. Here rows are dealt to ranges of the whole order
(group, then key), so that a large group spans many ranges and small ones share one; a row's place is its
place in its range and group, moved on by how many rows of the group lie in the ranges before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemforge.sources.tables import written

#: Rows of a range, about, and keys drawn for each range to find its limits.
RANGE_ROWS, DRAWN = 1 << 20, 16
#: Steps of the search among the limits: so many halvings find one of 2**24.
STEPS = 24


def _limits(keyed: DataFrame) -> DataFrame:
    """One row: the limits between ranges, from about ``DRAWN`` keys a range. Which keys are drawn changes no place."""
    total = keyed.agg(F.count("*").alias("_n"))
    ranges = F.ceil(F.col("_n") / RANGE_ROWS)
    draw = F.greatest(F.lit(1), F.floor(F.col("_n") / (ranges * DRAWN)))
    drawn = keyed.withColumn("_one", F.lit(0)).join(F.broadcast(total.withColumn("_one", F.lit(0))), "_one").where((ranges > 1) & (F.pmod(F.xxhash64("_key", F.lit(7)), draw) == 0))
    keys = drawn.agg(F.array_sort(F.collect_list("_key")).alias("_keys"), F.max(ranges).alias("_ranges"))
    step = F.greatest(F.lit(1), F.ceil(F.size("_keys") / F.coalesce("_ranges", F.lit(1)))).cast("int")
    return keys.select(F.lit(0).alias("_one"), F.filter("_keys", lambda x, i: (i > 0) & (i % step == 0)).alias("_limits"))


def place_in_order(df: DataFrame, order: list[Column], group: list[str], name: str) -> DataFrame:
    """Adds ``name``: places from 1 in the order of some columns, in each group (over all rows without any).

    Equal keys stand in the order of a hash of the whole row, so that many of them span ranges too; rows that are
    equal in everything take neighbouring places. Nulls come first. ``df`` is written once to the shared folder, as it is
    read to count, to draw limits, to count ranges, and for the result, and rankings of rankings would grow fourfold each.
    """
    df = written(df, "ranked")
    plain = [F.col(f"`{f.name}`") for f in df.schema if f.dataType.typeName() not in ("map", "variant")]
    key = F.struct(*[F.col(f"`{g}`").alias(f"g{i}") for i, g in enumerate(group)], *[c.alias(f"o{i}") for i, c in enumerate(order)], F.xxhash64(*plain).alias("tie"))
    keyed = df.withColumn("_key", key)
    halves = F.array(*[F.lit(1 << k) for k in range(STEPS - 1, -1, -1)])
    at = F.aggregate(halves, F.lit(0), lambda a, n: F.when((a + n <= F.size("_limits")) & (F.get("_limits", a + n - 1) <= F.col("_key")), a + n).otherwise(a))
    dealt = keyed.withColumn("_one", F.lit(0)).join(F.broadcast(_limits(keyed.select("_key"))), "_one").withColumn("_range", at).drop("_limits")
    group = group or ["_one"]
    sizes = dealt.groupBy("_range", *group).agg(F.count("*").alias("_n"))
    before = sizes.select("_range", *group, (F.sum("_n").over(Window.partitionBy(*group).orderBy("_range")) - F.col("_n")).alias("_before"))
    within = dealt.withColumn("_place", F.row_number().over(Window.partitionBy("_range", *group).orderBy("_key")))
    same = [F.col("w._range") == F.col("b._range"), *[F.col(f"w.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group]]
    out = within.alias("w").join(before.alias("b"), same)
    return out.select(*[F.col(f"w.`{c}`") for c in df.columns], (F.col("w._place") + F.col("b._before")).alias(name))


def first_in_order(df: DataFrame, order: list[Column], group: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group (all rows are one group without any)."""
    return place_in_order(df, order, group, "_place_in_order").where(F.col("_place_in_order") <= n).drop("_place_in_order")
