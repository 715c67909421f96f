"""Column functions on items, labels and texts. All are built-in expressions: no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands between the items of an itemset where it is shown as text.
KEY = "|"
SPACE = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode white space included (``trim`` knows blanks only)."""
    return F.regexp_replace(c, SPACE, "")


def item_canon(c: Column) -> Column:
    """An item in its canonical form: stripped and in lower case."""
    return F.lower(strip(c.cast("string")))


def itemset_canon(c: Column) -> Column:
    """Sorted canonical items without blank ones; repeated items stay."""
    return F.array_sort(F.filter(F.transform(c, item_canon), lambda x: x != ""))


def itemset_set(c: Column) -> Column:
    """Sorted canonical items, each once: the form in which itemsets are compared when scoring."""
    return F.array_sort(F.array_distinct(F.transform(c, item_canon)))


def itemset_key(c: Column) -> Column:
    """An itemset as shown in results; items that hold the mark make it ambiguous, so nothing is joined on it."""
    return F.concat_ws(KEY, c)


def set_key(c: Column) -> Column:
    """An itemset as JSON text: different itemsets have different keys, whatever their items hold."""
    return F.to_json(c)


def row_label(n: Column) -> Column:
    return F.concat(F.lit("Row "), n.cast("string"))


def row_index(label: Column) -> Column:
    """Row number of a label ``Row 3`` or ``3``; null if there is none."""
    named = F.regexp_extract(label, r"(?i)^row\s+(\S+)", 1)
    return F.when(F.lower(label).startswith("row "), named.try_cast("int")).otherwise(label.try_cast("int"))


def tagged(name: str, value: Column) -> Column:
    """``column:value`` in lower case; null for a null value."""
    return F.lower(F.concat(F.lit(f"{name}:"), strip(value.cast("string"))))


def is_missing(c: Column) -> Column:
    """Cells that hold no item: null, blank, and the usual words for a missing value."""
    return c.isNull() | F.lower(strip(c)).isin("", "nan", "none")


def safe_ratio(a: Column, b: Column, digits: int | None = None) -> Column:
    """a / b, and 0 where b is 0 or null."""
    out = F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return out if digits is None else F.round(out, digits)


def null_ratio(a: Column, b: Column) -> Column:
    """a / b, and null where b is 0."""
    return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))


def normal_text(c: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def prefix_signature(c: Column, chars: int = 120) -> Column:
    return F.left(F.lower(normal_text(c)), F.lit(chars))


def token_estimate(c: Column) -> Column:
    """About four characters a token."""
    return F.floor(F.char_length(c) / 4).cast("long")


def after_think(c: Column, last: bool = False) -> Column:
    """What follows the first (or last) closing think tag; the whole text without one."""
    if last:
        return F.substring_index(c, "</think>", -1)
    return F.when(F.contains(c, F.lit("</think>")), F.element_at(F.split(c, "</think>", 2), 2)).otherwise(c)


def think_text(c: Column) -> Column:
    """Text between think tags; null without both."""
    return F.when(c.rlike(r"(?s)<think>.*?</think>"), F.regexp_extract(c, r"(?s)<think>(.*?)</think>", 1))


# Marks of a line that still means something in a truncated trace.
MARKS = ("✓", "✗", "##", "RESULT", "FREQUENT", "SCAN")


def close_trace(c: Column) -> Column:
    """A truncated trace cut after its last marked line, with the closing tag; a closed one ends in a line break."""
    lines = F.split(c, "\n")
    good = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.get(lines, i - 1).rlike("|".join(MARKS)))
    last = F.coalesce(F.element_at(F.when(F.size(good) > 0, good), -1), F.size(lines))
    cut = F.concat(F.array_join(F.slice(lines, F.lit(1), last), "\n"), F.lit("\n</think>\n"))
    return F.when(~F.contains(c, F.lit("</think>")), cut).when(c.endswith("\n"), c).otherwise(F.concat(c, F.lit("\n")))


def solid_lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")


def is_looping(c: Column, repeats: int = 3) -> Column:
    """Whether the last ``repeats`` non-blank lines are equal, in a text of twice as many at least."""
    lines = solid_lines(c)
    tail = F.slice(lines, F.greatest(F.lit(1), F.size(lines) - repeats + 1), F.lit(repeats))
    return (F.size(lines) >= 2 * repeats) & (F.size(F.array_distinct(tail)) == 1)


def dimensions(name: Column, strict: bool = False) -> tuple[Column, Column]:
    """Rows and columns from a name that ends in ``RxC``, a short hash and ``.csv`` allowed after it unless strict."""
    end = r"(?:\.csv)?$" if strict else r"(?:_[0-9a-f]+)?(?:\.csv)?$"
    pattern = rf"(\d+)x(\d+){end}"
    return tuple(F.when(name.rlike(pattern), F.regexp_extract(name, pattern, i)).try_cast("long") for i in (1, 2))


def file_of_dataset(dataset_id: Column) -> Column:
    """File name in ``name:hash``."""
    return F.split_part(dataset_id, F.lit(":"), F.lit(1))


def is_family(model: Column, names: list[str]) -> Column:
    """Whether a model's name holds one of the given parts."""
    return model.rlike("|".join(f"\\Q{n}\\E" for n in names))


def ordinal_label(i: Column) -> Column:
    """0 -> A, 1 -> B, ..."""
    return F.char(i + 65)


def short_hash(c: Column, digits: int = 12) -> Column:
    return F.left(F.sha2(c.cast("binary"), 256), F.lit(digits))
