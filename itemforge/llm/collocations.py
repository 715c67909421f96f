"""Phrases whose words stand together more often than apart, by language, with exact counts.

Candidates grow level by level: a pair counts only if both words are frequent, a triple only if both of its
pairs are, so no frequent phrase is lost. A minimal perfect hash gives every candidate a slot; it comes
in shards of bounded size, each with the keys of its slots. The scan sends the keys that it finds, counted
by piece of text, to the tasks that hold their shard; these verify the key, count into an array by slot, and
the arrays are added in a tree. The counts of a phrase's cuts are then read by slot.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from itemforge.llm import textkit as tk
from itemforge.llm.perfecthash import PerfectHash
from itemforge.llm.shared import SeedFilter, discard, key_filter, small_or_shuffled, written

LEAST, SHARE, TOP, SCALE = 10, 50, 2000, 1_000_000
UNKNOWN = "und"
#: Keys that a shard of the perfect hash holds about, and tasks that count for a shard side by side.
SHARD_KEYS, COUNTERS = 1 << 17, 4
#: Keys looked up at a time, and questions that a task answers about.
LOOKUPS, QUESTIONS = 1 << 16, 1 << 19
#: Parts in which a language's phrases are ranked before they meet.
RANKERS = 64
#: Bytes as they count: A-Z in lower case, and what ends a piece as a line feed.
PIECES = tk.LOWER.copy()
PIECES[[*b".,;:!?", *range(0x0A, 0x0E)]] = 0x0A
#: The parts of a phrase of three that an answer is about: itself, and left and right of each cut.
ITSELF, LEFT1, RIGHT1, LEFT2, RIGHT2 = range(5)


def other_bytes(seed: int) -> np.ndarray:
    """An order of the bytes that are no white space, another for each seed: words stay apart, their hashes change."""
    out = np.arange(256, dtype=np.uint8)
    if seed:
        solid = out[~tk.SPACE]
        out[~tk.SPACE] = np.random.default_rng(seed).permutation(solid)
    return out


def language_key(lang: str, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")


def phrase_key(*words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for a phrase, from its words' 64 each."""
    out = []
    for salt in (0x2545F4914F6CDD1D, 0xD1342543DE82EF95):
        x = np.full(len(words[0]), salt * len(words) & 0xFFFFFFFFFFFFFFFF, np.uint64)
        for w in words:
            x = tk.mix((x ^ w) * np.uint64(salt))
        out.append(x)
    return out[0], out[1]


class Phrases:
    """Words of some texts by language, which neighbours share a piece, and keys of one to three in a row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lang: np.ndarray, seed: int):
        self.data, self.offsets = PIECES[data], offsets
        self.words = tk.Words(other_bytes(seed)[self.data], offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.words.offsets))
        self.lang = lang[self.row]
        self.word = tk.mix(self.words.hash + self.lang)
        ends = np.concatenate([[0], np.cumsum(self.data == 0x0A)])
        self.joined = (ends[self.words.start[1:]] == ends[self.words.end[:-1]]) & (self.row[1:] == self.row[:-1])

    def at(self, where: np.ndarray, size: int) -> list[np.ndarray]:
        """The words of the phrases of so many words that start at ``where``."""
        return [self.word[where + i] for i in range(size)]

    def starts(self, size: int, filters: list[SeedFilter]) -> np.ndarray:
        """Where phrases start whose every part, as far as there are filters by size, passes them."""
        fine = np.ones(len(self.word), dtype=bool)
        for k in range(1, size + 1):
            if k > 1:
                fine = fine[:-1] & fine[1:] & self.joined if k == 2 else fine[:-1] & fine[1:]
            if k <= len(filters):
                where = np.flatnonzero(fine)
                fine[where] = filters[k - 1].holds(phrase_key(*self.at(where, k))[0])
        return np.flatnonzero(fine)


def counted(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one of each, how many) of equal keys; two that share their high half alone stay apart."""
    _, first, back, n = np.unique(high, return_index=True, return_inverse=True, return_counts=True)
    other = np.flatnonzero(low != low[first][back])
    n -= np.bincount(back[other], minlength=len(n))
    return np.concatenate([first, other]), np.concatenate([n, np.ones(len(other), n.dtype)])


def signed(a: np.ndarray):
    import pyarrow as pa

    return pa.array(a.view(np.int64))


def pieces(batches, seed: int):
    """(phrases, dictionary of languages, first row) of batches of (text, lang), about a megabyte at a time."""
    import pyarrow as pa

    for b in batches:
        data, off = tk.column_bytes(b.column("text"))
        langs = b.column("lang").dictionary_encode()
        names = np.array([language_key(x, seed) for x in langs.dictionary.to_pylist()], np.uint64)
        lang = names[np.asarray(langs.indices.cast(pa.int64()))] if len(names) else np.empty(0, np.uint64)
        for i, j in tk.chunks(off):
            yield Phrases(data[off[i] : off[j]], off[i : j + 1] - off[i], lang[i:j], seed), langs, i


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, word, w1, lang_key, n): every word of every language, w1 standing for it."""

    def run(batches):
        import pyarrow as pa

        for x, langs, i in pieces(batches, seed):
            w = x.words
            again = tk.Words(other_bytes(seed + (1 << 32))[x.data], x.offsets).hash
            one, n = counted(x.word, again)
            size = w.end[one] - w.start[one]
            text = tk.binary_array(x.data[tk.spread(w.start[one], size)], np.concatenate([[0], np.cumsum(size)]), string=True)
            lang = langs.dictionary.take(langs.indices.take(pa.array(x.row[one] + i)))
            yield pa.RecordBatch.from_arrays([lang, text, signed(x.word[one]), signed(x.lang[one]), pa.array(n)], ["lang", "word", "w1", "lang_key", "n"])

    each = docs.mapInArrow(run, "lang string, word string, w1 long, lang_key long, n long")
    return each.groupBy("lang", "word", "w1", "lang_key").agg(F.sum("n").alias("n"))


def all_words(docs: DataFrame) -> tuple[DataFrame, int]:
    """``word_counts`` and its seed: the first for which no two words, or languages, stand under one number."""
    seed = 0
    while True:
        found = written(word_counts(docs, seed), "words")
        if found.groupBy("w1").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
            return found, seed
        discard(found)
        seed += 1


def grown(docs: DataFrame, size: int, filters: list[SeedFilter], seed: int, least: int) -> DataFrame:
    """(lang_key, w1..) of the phrases of so many words that may be frequent: their parts pass, and so often they were seen."""
    names = [f"w{i + 1}" for i in range(size)]

    def run(batches):
        import pyarrow as pa

        for x, _, _ in pieces(batches, seed):
            where = x.starts(size, filters)
            one, n = counted(*phrase_key(*x.at(where, size)))
            where = where[one]
            yield pa.RecordBatch.from_arrays([signed(x.lang[where]), *[signed(w) for w in x.at(where, size)], pa.array(n)], ["lang_key", *names, "n"])

    each = docs.mapInArrow(run, "lang_key long, " + ", ".join(f"{w} long" for w in names) + ", n long")
    return each.groupBy("lang_key", *names).agg(F.sum("n").alias("n")).where(F.col("n") >= least).drop("n")


def parts_of(w: list[np.ndarray]) -> list[list[np.ndarray]]:
    """A phrase and the parts of its cuts, in the order of ITSELF, LEFT1, RIGHT1, LEFT2, RIGHT2."""
    return [w] if len(w) == 1 else [w, w[:1], w[1:]] if len(w) == 2 else [w, w[:1], w[1:], w[:2], w[2:]]


def shard_of(high: np.ndarray, shards: int) -> np.ndarray:
    return ((high >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def words_in(batch, size: int) -> list[np.ndarray]:
    return [np.asarray(batch.column(f"w{i + 1}")).view(np.uint64) for i in range(size)]


def grouped(batches, keys: list[str]):
    """(key, slice of a batch) of neighbouring rows with equal keys."""
    for b in batches:
        cols = [np.asarray(b.column(k)) for k in keys]
        new = np.ones(b.num_rows, dtype=bool)
        if b.num_rows:
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
        cut = [*np.flatnonzero(new).tolist(), b.num_rows]
        for i, j in zip(cut, cut[1:], strict=False):
            yield tuple(int(c[i]) for c in cols), b.slice(i, j - i)


def hashed(candidates: list[DataFrame], shards: int) -> DataFrame:
    """(shard, hash): a perfect hash of the candidates' keys in each shard."""

    def keys(size: int):
        def run(batches):
            import pyarrow as pa

            for b in batches:
                high, low = phrase_key(*words_in(b, size))
                yield pa.RecordBatch.from_arrays([pa.array(shard_of(high, shards)), signed(high), signed(low)], ["shard", "high", "low"])

        return run

    def build(batches):
        import pyarrow as pa

        def done(shard, held):
            high, low = (np.concatenate([np.asarray(b.column(c)) for b in held]).view(np.uint64) for c in ("high", "low"))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([PerfectHash.of(high, low).to_bytes()], pa.binary())], ["shard", "hash"])

        last, held = None, []
        for (shard,), b in grouped(batches, ["shard"]):
            if held and shard != last:
                yield done(last, held)
                held = []
            last = shard
            held.append(b)
        if held:
            yield done(last, held)

    each = [c.mapInArrow(keys(k), "shard int, high long, low long") for k, c in enumerate(candidates, 1)]
    rows = each[0].union(each[1]).union(each[2])
    return rows.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(build, "shard int, hash binary")


def found_keys(docs: DataFrame, filters: list[SeedFilter], seed: int, shards: int) -> DataFrame:
    """(shard, part, packed): keys of the phrases that may be candidates with their number in a piece of text, by shard."""

    def run(batches):
        import pyarrow as pa

        for at, (x, _, _) in enumerate(pieces(batches, seed)):
            high, low, n = [], [], []
            for size in (1, 2, 3):
                a, b = phrase_key(*x.at(x.starts(size, filters[:size]), size))
                one, c = counted(a, b)
                high.append(a[one])
                low.append(b[one])
                n.append(c)
            high, low, n = (np.concatenate(v) for v in (high, low, n))
            shard = shard_of(high, shards)
            order = np.argsort(shard, kind="stable")
            a, z = tk.runs(shard[order])
            packed = [b"".join([high[k].tobytes(), low[k].tobytes(), n[k].astype("<i4").tobytes()]) for k in (order[i:j] for i, j in zip(a, z, strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(shard[order[a]]), pa.array(np.full(len(a), at % COUNTERS, np.int32)), pa.array(packed, pa.binary())], ["shard", "part", "packed"])

    return docs.mapInArrow(run, "shard int, part int, packed binary")


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(raw) // 20
    return np.frombuffer(raw, "<u8", n), np.frombuffer(raw, "<u8", n, 8 * n), np.frombuffer(raw, "<i4", n, 16 * n)


def slot_counts(found: DataFrame, hashes: DataFrame, shards: int) -> DataFrame:
    """(shard, hash, counts): how often each slot's key was found, as one array a shard.

    A shard's keys go to ``COUNTERS`` tasks, which hold its hash and count into an array; then the arrays
    of a shard are added.
    """

    def count(batches):
        import pyarrow as pa

        here, table, total, waiting, load = None, None, None, [], 0

        def flush():
            high, low, n = (np.concatenate(v) for v in zip(*waiting, strict=True))
            slot = table.slots(high, low)
            known = slot >= 0  # what only passed the filters has no slot
            total.__iadd__(np.bincount(slot[known], weights=n[known], minlength=len(table)).astype(np.int64))

        def row():
            return pa.RecordBatch.from_arrays([pa.array([here[0]], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["shard", "packed"])

        for key, b in grouped(batches, ["shard", "part"]):
            if key != here:
                if waiting:
                    flush()
                if table is not None:
                    yield row()
                here, waiting, load, table = key, [], 0, None
            for raw in b.column("packed"):
                if table is None:  # a shard's hash comes first
                    table = PerfectHash.from_bytes(raw.as_py())
                    total = np.zeros(len(table), np.int64)
                    continue
                waiting.append(unpacked(raw.as_py()))
                load += len(waiting[-1][0])
                if load >= LOOKUPS:
                    flush()
                    waiting, load = [], 0
        if waiting:
            flush()
        if table is not None:
            yield row()

    def add(batches):
        import pyarrow as pa

        here, table, total = None, None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([here], pa.int32()), pa.array([table], pa.binary()), pa.array([total.tobytes()], pa.binary())], ["shard", "hash", "counts"])

        for (shard,), b in grouped(batches, ["shard"]):
            if shard != here:
                if table is not None:
                    yield row()
                here, table, total = shard, None, None
            for raw in b.column("packed"):
                raw = raw.as_py()
                if table is None:
                    table, total = raw, 0
                else:
                    total = total + np.frombuffer(raw, "<i8")
        if table is not None:
            yield row()

    first, later = F.lit(0).alias("turn"), F.lit(1).alias("turn")
    each = hashes.select("shard", F.explode(F.sequence(F.lit(0), F.lit(COUNTERS - 1))).alias("part"), first, F.col("hash").alias("packed"))
    rows = each.union(found.select("shard", "part", later, "packed"))
    sums = rows.repartition(shards * COUNTERS, "shard", "part").sortWithinPartitions("shard", "part", "turn").mapInArrow(count, "shard int, packed binary")
    tree = hashes.select("shard", first, F.col("hash").alias("packed")).union(sums.select("shard", later, "packed"))
    return tree.repartition(shards, "shard").sortWithinPartitions("shard", "turn").mapInArrow(add, "shard int, hash binary, counts binary")


def answers(candidates: list[DataFrame], slots: DataFrame, shards: int) -> DataFrame:
    """(lang_key, w1, w2, w3, a, l1, r1, l2, r2): counts of the candidates of two and three words and of their cuts' parts, read by slot.

    Questions go to the shard of the part that they are about; a shard with many is held by several tasks.
    """
    names = ["lang_key", "w1", "w2", "w3"]

    def ask(size: int):
        def run(batches):
            import pyarrow as pa

            for b in batches:
                w = words_in(b, size)
                w3 = b.column("w3") if size == 3 else pa.nulls(b.num_rows, pa.int64())
                for about, part in enumerate(parts_of(w)):
                    high, low = phrase_key(*part)
                    yield pa.RecordBatch.from_arrays([b.column("lang_key"), b.column("w1"), b.column("w2"), w3, pa.array(np.full(len(high), about, np.int32)), pa.array(shard_of(high, shards)), signed(high), signed(low)], [*names, "about", "shard", "high", "low"])

        return candidates[size - 1].mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", about int, shard int, high long, low long")

    def answer(batches):
        import pyarrow as pa

        table = counts = None
        for _, b in grouped(batches, ["shard", "part", "turn"]):
            if b.column("hash")[0].is_valid:
                table, counts = PerfectHash.from_bytes(b.column("hash")[0].as_py()), np.frombuffer(b.column("counts")[0].as_py(), "<i8")
                continue
            slot = table.slots(*(np.asarray(b.column(c)).view(np.uint64) for c in ("high", "low")))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], b.column("about"), pa.array(np.where(slot >= 0, counts[slot], 0))], [*names, "about", "count"])

    asked = ask(2).union(ask(3))
    load = asked.groupBy("shard").agg((F.floor(F.count("*") / QUESTIONS) + 1).cast("int").alias("parts"))
    load = written(load, "questions")
    few = small_or_shuffled(load)
    part = F.pmod(F.xxhash64("w1", "w2", "w3"), F.col("parts")).cast("int").alias("part")
    rows = asked.join(few, "shard").select("shard", part, F.lit(1).alias("turn"), *names, "about", "high", "low", F.lit(None).cast("binary").alias("hash"), F.lit(None).cast("binary").alias("counts"))
    none = [F.lit(None).cast("long").alias(c) for c in names]
    held = slots.join(few, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("turn"), *none, F.lit(None).cast("int").alias("about"), F.lit(None).cast("long").alias("high"), F.lit(None).cast("long").alias("low"), "hash", "counts")
    met = held.union(rows).repartition("shard", "part").sortWithinPartitions("shard", "part", "turn")
    got = met.mapInArrow(answer, ", ".join(f"{c} long" for c in names) + ", about int, count long")
    return got.groupBy(*names).agg(*[F.max(F.when(F.col("about") == k, F.col("count"))).alias(c) for k, c in enumerate(("a", "l1", "r1", "l2", "r2"))])


def whole(expression: str) -> str:
    return f"CAST({expression} AS DECIMAL(38, 0))"


def scored(phrases: DataFrame, scale: int) -> DataFrame:
    """Adds l, r and score: those of the cut with the lowest floor(scale * a * a / (l * r)), the first of such."""
    cuts = [F.expr(f"{whole('a')} * a * {scale} div ({whole(l)} * {r})") for l, r in (("l1", "r1"), ("l2", "r2"))]
    out = phrases.withColumns({"s1": cuts[0], "s2": F.when(F.col("w3").isNotNull(), cuts[1])})
    second = F.coalesce(F.col("s2") < F.col("s1"), F.lit(False))
    return out.select("lang_key", "w1", "w2", "w3", "a", *[F.when(second, F.col(f"{c}2")).otherwise(F.col(f"{c}1")).alias(n) for c, n in (("l", "l"), ("r", "r"), ("s", "score"))])


def leaders(phrases: DataFrame, top: int) -> DataFrame:
    """The phrases of each language that reach the score and count of its ``top``-th, with all their equals.

    Ranked are the different (score, a) with their number, first in parts, so no task sees a language whole.
    """
    order = [F.desc("score"), F.desc("a")]
    steps = phrases.groupBy("lang_key", "score", "a").agg(F.count("*").alias("c")).withColumn("_part", F.pmod(F.xxhash64("score", "a"), F.lit(RANKERS)))
    steps = steps.withColumn("_k", F.row_number().over(Window.partitionBy("lang_key", "_part").orderBy(*order))).where(F.col("_k") <= top)
    steps = steps.withColumn("_before", F.sum("c").over(Window.partitionBy("lang_key").orderBy(*order)) - F.col("c")).where(F.col("_before") < top)
    limits = written(steps.groupBy("lang_key").agg(F.min(F.struct("score", "a")).alias("_limit")), "limits")
    return phrases.join(small_or_shuffled(limits), "lang_key").where(F.struct("score", "a") >= F.col("_limit")).drop("_limit")


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP, scale: int = SCALE, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two or three words of each language.

    Texts are in lower case (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends, and these into words at blanks
    and tabs; phrases do not leave a piece. n are the language's words, a the phrase's occurrences (at least
    ``least``), l and r those of the two parts of the cut that scores lowest (the first of equal ones), score
    floor(scale * a * a / (l * r)). A phrase of two inside a candidate of three with at least ``share`` percent of its
    occurrences is dropped. Phrases are ranked by score, a, and text in byte order.

    A null text has no words, a null language is ``und`` and the same as that one; a language without a
    candidate, and an empty table, give no rows. Equal rows count each; only the two columns are read.
    """
    docs = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"))
    words, seed = all_words(docs)
    frequent = written(words.where(F.col("n") >= least).select("lang_key", "w1", "word"), "frequent")
    totals = written(words.groupBy("lang", "lang_key").agg(F.sum("n").alias("n")), "totals")
    discard(words)

    def filtered(table: DataFrame, size: int) -> tuple[SeedFilter, int]:
        def run(batches):
            import pyarrow as pa

            for b in batches:
                yield pa.RecordBatch.from_arrays([signed(phrase_key(*words_in(b, size))[0])], ["key"])

        n = table.count()
        return key_filter(table.select(*[f"w{i + 1}" for i in range(size)]).mapInArrow(run, "key long"), n), n

    tables, filters, total = [frequent], [], 0
    for size in (1, 2, 3):
        if size > 1:
            tables.append(written(grown(docs, size, filters, seed, least), f"candidates-{size}"))
        made, n = filtered(tables[-1], size)
        filters.append(made)
        total += n
    shards = max(1, -(-total // SHARD_KEYS))
    hashes = written(hashed([t.select([c for c in t.columns if c != "word"]) for t in tables], shards), "hashes")
    slots = written(slot_counts(found_keys(docs, filters, seed, shards), hashes, shards), "slots")
    phrases = written(answers(tables, slots, shards).where(F.col("a") >= least), "phrases")
    discard(hashes, slots, *tables[1:])
    inner = phrases.where(F.col("w3").isNotNull())
    lost = inner.where(f"100 * a >= {share} * l2").select("w1", "w2").union(inner.where(f"100 * a >= {share} * r1").select("w2", "w3")).distinct()
    twos = phrases.where(F.col("w3").isNull())
    kept = twos.join(lost.withColumnRenamed("w3", "w2"), ["w1", "w2"], "left_anti").select(phrases.columns).union(inner)
    best = leaders(scored(kept, scale), top)
    for i in (1, 2, 3):
        best = best.join(frequent.select(F.col("w1").alias(f"w{i}"), F.col("word").alias(f"word{i}")), f"w{i}", "left" if i == 3 else "inner")
    best = best.join(small_or_shuffled(totals), "lang_key").withColumn("phrase", F.concat_ws(" ", "word1", "word2", "word3"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = best.withColumn("_k", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANKERS))).orderBy(*order))).where(F.col("_k") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

