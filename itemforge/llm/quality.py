"""Quality rules: base counts and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Two multinomials over hashed n-grams are estimated from all documents: the raw corpus, and the
trusted target (documents labelled as good).  A document's score is the mean over its n-grams of
log P_target - log P_raw; it is kept when the score reaches a fixed threshold, so the verdict is
deterministic and independent of any sample.  N-grams are words, pairs of neighbouring words, and
the last three characters of each word.

The main path has no Python, pandas, Arrow or RDD code: the corpus is scanned once to count buckets
(map-side combined, ``BUCKETS`` rows at most) and once to score.  No text is shuffled but, where the
trusted ids are too many to be broadcast, that of the documents that may be trusted.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemforge.llm.shared import carried, matched, pick, released, written

#: Hashed buckets (a power of two); this bounds the table that reaches the driver and each task.
BUCKETS = 1 << 16
#: Occurrences added to a bucket's count in the target and to what the raw corpus lets expect there, so
#: that a bucket says nothing until it could have said something.
SMOOTHING = 5.0
#: A document is kept when its mean log ratio is at least this: it must look half again as likely in
#: the raw corpus as in the trusted one, n-gram by n-gram, to be dropped (exp(-0.4) = 0.67).
THRESHOLD = -0.4
WHITE = r" \t\n\u000B\u000C\r"


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row.

    A plain projection may be inlined into the lambda functions that use it and then be computed
    for each element; a generator of one element is never inlined.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, w): w holds the words; null texts have none."""
    src = pick(docs, id_col, text_col).toDF("id", "text")
    text = F.coalesce("text", F.lit(""))
    bare = F.expr(f"trim(BOTH '{WHITE}' FROM coalesce(text, ''))")
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t-\r]+"))
    return once(src.select("id", text.alias("text"), words.alias("split")).select("id", "text", "split"), "w", F.col("split")).drop("split")


MASK = BUCKETS - 1
#: Buckets of the n-grams that begin at word i, from the hash of the word, that of the next word (null
#: at the end) and the word: the word, the pair, and the word's end.
GRAMS = (f"cast({{h}} & {MASK} AS int)", f"hash({{h}}, {{next}}) & {MASK}", f"hash(right({{x}}, 3)) & {MASK}")


def bucket_counts(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, raw, target): occurrences in all documents and in those whose id is in ``trusted`` (id)."""
    ids = written(trusted.where("id IS NOT NULL").distinct().withColumn("good", F.lit(1)), "trusted")
    flagged = matched(pick(docs, id_col, text_col).toDF("id", "text"), ids, ["id"])
    words = with_words(flagged.select(F.col("good").alias("id"), "text"), "id", "text").withColumnRenamed("id", "good")
    each = words.select("good", "w", F.posexplode("w").alias("i", "x"))
    each = each.select("good", "x", F.expr("xxhash64(x)").alias("h"), F.expr("nullif(xxhash64(get(w, i + 1)), xxhash64(cast(NULL AS string)))").alias("next"))
    grams = ", ".join(g.format(h="h", next="next", x="x") for g in GRAMS)
    each = each.select("good", F.explode(F.expr(f"array({grams})")).alias("bucket"))
    return each.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("good").alias("target"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """log P_target - log P_raw of each bucket, smoothed; all zero without a trusted document."""
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.collect():
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not target.sum():
        return np.zeros(BUCKETS)

    expected = raw * (target.sum() / raw.sum())
    return np.log((target + SMOOTHING) / (expected + SMOOTHING))


#: Words in 5-word windows found twice or more, from h, the hashes of all windows in order. Sorting
#: (hash, place) puts equal windows side by side; their places, sorted, are covered left to right.
REPEATED = """
CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE
transform(array(sort_array(transform(h, (x, i) -> struct(x, i)))), s ->
  aggregate(
    sort_array(transform(
      filter(sequence(0, size(s) - 1), k -> get(s, k - 1).x <=> get(s, k).x OR get(s, k + 1).x <=> get(s, k).x),
      k -> get(s, k).i)),
    named_struct('n', 0L, 'e', 0),
    (a, p) -> named_struct('n', a.n + (p + 5 - greatest(p, a.e)), 'e', p + 5),
    a -> a.n))[0] END
"""


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Counts, base verdict, score and verdict of every document.

    Returns (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    score). Base: failed with fewer than 10 words, or with more than a fifth of the words in
    repeated 5-word windows. A null or empty text has no words, score 0, and fails the base. Rows
    with null or repeated ids are judged each on its own. Without any trusted label every score is
    0. Columns beyond the two named (and doc_id, quality of ``labels``) are ignored; with ``keep`` the
    named columns of ``docs`` come first instead of the id alone.
    """
    trusted = labels.where("quality = 1").select(F.col("doc_id").alias("id"))
    table = log_ratios(bucket_counts(docs, trusted, id_col, text_col))
    d = with_words(docs.select(carried(id_col, keep).alias("id"), F.col(text_col).alias("text")), "id", "text")
    d = once(d, "wh", F.expr("transform(w, x -> xxhash64(x))"))
    d = once(d, "h", F.expr("slice(transform(wh, (x, i) -> xxhash64(x, get(wh, i + 1), get(wh, i + 2), get(wh, i + 3), get(wh, i + 4))), 1, greatest(0, size(wh) - 4))"))
    d = once(d, "lines", F.expr(r"filter(split(text, '\n'), x -> trim(BOTH '" + WHITE + "' FROM x) <> '')"))
    d = d.withColumn("t", F.from_json(F.lit(json.dumps(table.tolist())), "array<double>"))  # folded to one literal
    each = " + ".join(f"get(t, {g.format(h='get(wh, i)', next='get(wh, i + 1)', x='x')})" for g in GRAMS)
    d = d.select(
        "id",
        F.size("w").cast("long").alias("n_words"),
        F.expr("cast(char_length(array_join(w, '')) AS bigint)").alias("word_chars"),
        F.expr("cast(char_length(text) - char_length(regexp_replace(text, '[#*$%&|<>]+', '')) AS bigint)").alias("n_symbols"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) AS bigint)").alias("n_dup_lines"),
        F.expr(REPEATED).alias("n_repeat_words"),
        F.expr(f"aggregate(transform(w, (x, i) -> {each}), 0D, (s, x) -> s + x) / greatest(1, 3 * size(w))").alias("score"),
    )
    failed = F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")
    d = d.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    return d.select(*released(id_col, keep), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
