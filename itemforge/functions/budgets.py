"""Token budgets as integer expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# The numbers of all three budgets below (tokens an item, a pair and a triple take, shares and limits).


def _estimates(cols: Column, values: Column) -> tuple[Column, Column, Column]:
    """Expected singles, pairs and triples of a data set."""
    singles = F.when(values == 0, cols * 3).otherwise(values).cast("long")
    pairs = F.least(F.floor(singles * (singles - 1) / 4).cast("long"), F.lit(50))
    return singles, pairs, F.least(F.floor(pairs / 3).cast("long"), F.lit(20))


def _clamp(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.floor(x).cast("long"), F.lit(high)))


def phase_budget(cols: Column, values: Column) -> Column:
    """Struct of think, json and total tokens, and the expected itemsets."""
    s, p, t = _estimates(cols, values)
    think, found = s * 20 + p * 25 + t * 30 + 100, s + p + t
    a, b = F.floor(think * 1.5).cast("long"), F.floor(found * 60 * 1.5).cast("long")
    return F.struct(_clamp(a, 300, 3000).alias("think_tokens"), _clamp(b, 300, 3000).alias("json_tokens"), _clamp(a + b, 512, 6000).alias("total_tokens"), found.alias("estimated_itemsets"))


def single_budget(cols: Column, values: Column) -> Column:
    """One budget for both phases."""
    s, p, t = _estimates(cols, values)
    return _clamp((s * 15 + p * 20 + t * 25 + 80 + (s + p + t) * 60) * 1.5, 512, 6000)


def gate_budget(prompt: Column, target: Column, max_length: int) -> Column:
    """Struct of the budgets of a guarded generation, from prompt and target tokens."""
    room = F.greatest(F.lit(1024), F.lit(max_length) - prompt - 64).cast("long")
    asked = F.greatest(F.lit(1792), F.floor(target * 2.3).cast("long")).cast("long")
    total = F.least(room, asked)
    wide = total >= 1536
    json = F.least(F.greatest(F.lit(768), F.floor(total * 0.52).cast("long")), total - 512)
    think = F.when(wide, F.least(F.lit(1800), total - json)).otherwise(total - F.greatest(F.lit(512), F.floor(total / 2).cast("long")))
    return F.struct(room.alias("available"), asked.alias("requested"), total.alias("total"), think.cast("long").alias("think"), (total - think).cast("long").alias("json"))
