"""Language-model scoring with a hidden Markov model.

Symbols are the ``FREQUENT`` commonest training words, ``CLASSES`` classes of all other words (by
their last three bytes) and the end of a text.  A rare word's probability in a state is its class's
probability times its share of the class, (c + 0.1) / (class count + 0.1 * (class words + 1)), where
c comes from a count table of every training word.

Every text is written once as symbols.  Latent states are trained by Baum-Welch over all of these: in each of
``ROUNDS`` rounds every task adds up expected counts over its training documents (each a whole chain), the
sums are added by block of symbols, and the re-estimated model starts the next round.  The start of the
first round comes from all training documents too: their neighbouring symbols are counted in one pass, as ``GROUPS``
groups (the commonest words, the classes of all others and the end), and the hidden Markov model of these counts of pairs,
whose size is fixed, is fitted by expectation maximization, from the likeliest of ``STARTS`` random guesses.  No count or parameter comes from a sample.  In scoring the scaled
forward recursion runs over the whole text and its likelihood is exact.

The model's size is bounded by its parameters, not by the corpus: counts of rare words are never
broadcast. Their logarithms are fetched by a join on the word and summed by document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemforge.llm import textkit as tk
from itemforge.llm.chains import forward_backward
from itemforge.llm.shared import pick, written

STATES = 8
FREQUENT = 1 << 16
CLASSES = 256
ROUNDS = 2
GROUPS = 1 << 10
STARTS, START_ROUNDS, PAIR_ROUNDS = 6, 15, 50
#: Bounds of ``sampled``, a look at a corpus that training does not take.
SAMPLE = 1500
SAMPLE_TOKENS = 1 << 18
SAMPLE_ROUNDS = 15
ADD = 0.1
SMOOTHING = 0.05
BLOCK = 1024
AT_ONCE = 1 << 18
HELD = 1 << 19


def document_number(id_col: str = "id") -> Column:
    """crc32 of the id as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def word_class(w: tk.Words) -> np.ndarray:
    last = np.zeros(len(w), dtype=np.uint64)
    for k in (1, 2, 3):
        at = w.end - k
        last = last * np.uint64(257) + np.where(at >= w.start, w.data[np.maximum(at, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return (tk.mix(last) % np.uint64(CLASSES)).astype(np.int32)


@dataclass
class Model:
    words: np.ndarray  # sorted hashes of the frequent words
    start: np.ndarray  # of a text, by state
    move: np.ndarray  # state by state
    emit: np.ndarray  # symbol by state

    @property
    def end(self) -> int:
        return len(self.words) + CLASSES

    def symbols(self, w: tk.Words) -> tuple[np.ndarray, np.ndarray]:
        """Symbol of each word, and whether the word is frequent."""
        if not len(self.words):
            return word_class(w), np.zeros(len(w), dtype=bool)
        at = np.minimum(np.searchsorted(self.words, w.hash), len(self.words) - 1)
        known = self.words[at] == w.hash
        return np.where(known, at, len(self.words) + word_class(w)).astype(np.int32), known

    def texts(self, w: tk.Words, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols with an end after each text, and offsets by text."""
        off = w.offsets + np.arange(len(w.offsets))
        out = np.full(off[-1], self.end, dtype=np.int32)
        is_end = np.zeros(off[-1], dtype=bool)
        is_end[off[1:] - 1] = True
        out[~is_end] = symbols
        return out, off


def forward(symbols: np.ndarray, off: np.ndarray, m: Model) -> np.ndarray:
    """Natural log-likelihood of each text (at least one symbol each) by the scaled forward recursion."""
    size = np.diff(off)
    order = np.argsort(-size, kind="stable")
    at, left = off[:-1][order], size[order]
    emit = m.emit.astype(np.float64)
    a = m.start * emit[symbols[at]]
    scale = a.sum(1)
    a /= scale[:, None]
    total = np.log(scale)
    active = np.searchsorted(-left, -np.arange(1, int(left[0]) if len(left) else 1), side="left")
    for t, k in enumerate(active, 1):
        b = (a[:k] @ m.move) * emit[symbols[at[:k] + t]]
        scale = b.sum(1)
        b /= scale[:, None]
        a = b
        total[:k] += np.log(scale)
    out = np.empty(len(size))
    out[order] = total
    return out


class Expected:
    """Expected counts of starts, moves and emissions."""

    def __init__(self, symbols: int, states: int):
        self.start, self.move, self.emit = np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states))

    def add(self, symbols: np.ndarray, off: np.ndarray, m: Model) -> None:
        """Forward-backward over texts, each a chain."""
        if not len(symbols):
            return
        g, moves, starts, _ = forward_backward(m.emit.astype(np.float32)[symbols], off, m.move, m.start)
        self.start += starts
        self.move += moves
        by = np.argsort(symbols, kind="stable")
        lead, _ = tk.runs(symbols[by])
        self.emit[symbols[by][lead]] += np.add.reduceat(g[by], lead)

    def model(self, words: np.ndarray, unigram: np.ndarray) -> Model:
        """Re-estimated model; every state is smoothed towards the unigram distribution."""
        k = len(self.start)
        mass = self.emit.sum() / k
        emit = self.emit + SMOOTHING * mass * unigram[:, None]
        move = self.move + 1e-3 * self.move.sum() / k / k + 1e-9
        start = self.start + 1e-3 * self.start.sum() / k + 1e-9
        return Model(words, start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0, keepdims=True))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, class, n) over ``docs`` (text binary): summed in each task first, then by Spark."""

    def run(batches):
        import pyarrow as pa

        words, classes, counts, held = [], [], [], 0

        def merged():
            w, c, n = np.concatenate(words), np.concatenate(classes), np.concatenate(counts)
            u, first, inverse = np.unique(w, return_index=True, return_inverse=True)
            return u, c[first], np.bincount(inverse, weights=n).astype(np.int64)

        def batch():
            u, c, n = merged()
            words.clear(), classes.clear(), counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c), pa.array(n)], ["word", "class", "n"])

        for b in batches:
            data, off = tk.column_bytes(b.column("text"))
            for i, j in tk.chunks(off):
                w = tk.Words(data[off[i] : off[j]], off[i : j + 1] - off[i], lower=True)
                u, first, n = np.unique(w.hash, return_index=True, return_counts=True)
                words.append(u), classes.append(word_class(w)[first]), counts.append(n)
                held += len(u)
                if held > HELD:
                    u, c, n = merged()
                    words[:], classes[:], counts[:] = [u], [c], [n]
                    held = len(u)
                    if held > HELD // 2:
                        yield batch()
                        held = 0
        if words:
            yield batch()

    return docs.select("text").mapInArrow(run, "word long, class int, n long").groupBy("word").agg(F.min("class").alias("class"), F.sum("n").alias("n"))


def frequent_words(counts: DataFrame) -> list[tuple[int, int, int]]:
    """(word, n, class), by word, of the commonest words: all above a count, ``FREQUENT`` at most.

    The count comes from a histogram on a fine logarithmic scale, so no more rows than wanted and a
    bounded histogram reach the driver.
    """
    step = F.floor(F.log(F.col("n")) * 1000).cast("long")
    total, least = 0, None
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():
        total += r.words
        if total > FREQUENT:
            break
        least = r.step
    if least is None:
        return []
    return sorted((r.word % (1 << 64), r.n, r["class"]) for r in counts.where(step >= least).collect())


def flat_symbols(column) -> tuple[np.ndarray, np.ndarray]:
    raw, off = tk.column_bytes(column)
    return raw.view("<i4"), off // 4


def added(texts: DataFrame, run, kind: str) -> dict[int, np.ndarray]:
    """Sums by part of what ``run`` makes of the symbols in each task: rows (part, numbers of ``kind``). One task adds each part."""

    def add(batches):
        import pyarrow as pa

        total: dict[int, np.ndarray] = {}
        for b in batches:
            for part, sums in zip(b.column("part").to_pylist(), b.column("sums").to_pylist(), strict=True):
                x = np.frombuffer(sums, kind).astype(np.float64)
                total[part] = total[part] + x if part in total else x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["part", "sums"])

    summed = texts.select("symbols").mapInArrow(run, "part int, sums binary").repartition("part").mapInArrow(add, "part int, sums binary")
    return {r.part: np.frombuffer(r.sums, np.float64) for r in summed.collect()}


def expected_counts(texts: DataFrame, model: Model) -> Expected:
    """One round of Baum-Welch counts over ``texts`` (symbols); what reaches the driver is one model's size."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(model)
    symbols, states = model.emit.shape

    def run(batches):
        import pyarrow as pa

        m, total = shared.value, Expected(symbols, states)
        for b in batches:
            flat, off = flat_symbols(b.column("symbols"))
            for i, j in tk.chunks(off, AT_ONCE):
                total.add(flat[off[i] : off[j]], off[i : j + 1] - off[i], m)
        small = np.concatenate([total.start, total.move.ravel()])
        parts = [small.astype("<f4").tobytes()] + [total.emit[a : a + BLOCK].astype("<f4").tobytes() for a in range(0, symbols, BLOCK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["part", "sums"])

    out = Expected(symbols, states)
    for part, x in added(texts, run, "<f4").items():
        if part == 0:
            out.start, out.move = x[:states].copy(), x[states:].reshape(states, states).copy()
        else:
            a = (part - 1) * BLOCK
            out.emit[a : a + BLOCK] = x.reshape(-1, states)
    shared.unpersist()
    return out


def grouped(words: np.ndarray, classes: np.ndarray, unigram: np.ndarray) -> np.ndarray:
    """The group of each symbol: the commonest words have their own, all others that of their class, the end the last."""
    own = np.argsort(-unigram[: len(words)], kind="stable")[: GROUPS - CLASSES - 1]
    out = np.concatenate([classes, np.arange(CLASSES), [GROUPS - 1]]).astype(np.int64)
    out[own] = CLASSES + np.arange(len(own))
    return out


def pair_counts(texts: DataFrame, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often a text of ``texts`` (symbols) begins with each group, and how often each follows each, over all texts."""
    shared = texts.sparkSession.sparkContext.broadcast(group.astype(np.int32))

    def run(batches):
        import pyarrow as pa

        of, first, pairs = shared.value, np.zeros(GROUPS, np.int64), np.zeros(GROUPS * GROUPS, np.int64)
        for b in batches:
            flat, off = flat_symbols(b.column("symbols"))
            for i, j in tk.chunks(off, AT_ONCE):
                g, at = of[flat[off[i] : off[j]]], np.unique(off[i : j + 1] - off[i])
                first += np.bincount(g[at[:-1]], minlength=GROUPS)
                inner = np.ones(len(g), dtype=bool)
                inner[at[:-1]] = False
                here = np.flatnonzero(inner)
                pairs += np.bincount(g[here - 1].astype(np.int64) * GROUPS + g[here], minlength=GROUPS * GROUPS)
        blocks = pairs.reshape(-1, 16 * GROUPS)
        parts = {0: first} | {k + 1: x for k, x in enumerate(blocks) if x.any()}
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in parts.values()], pa.binary())], ["part", "sums"])

    got = added(texts, run, "<i8")
    pairs = np.zeros((GROUPS // 16, 16 * GROUPS))
    for part, x in got.items():
        if part:
            pairs[part - 1] = x
    shared.unpersist()
    return got.get(0, np.zeros(GROUPS)), pairs.reshape(GROUPS, GROUPS)


def fitted_pairs(pairs: np.ndarray, emit: np.ndarray, joint: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(emissions, weight of a state before another, log-likelihood) that expectation maximization reaches for counts of pairs from a first guess.

    A pair (a, b) has the probability of ``emit @ joint @ emit.T`` at (a, b).
    """
    for _ in range(rounds):
        ratio = pairs / np.maximum(emit @ joint @ emit.T, 1e-300)
        left, right = ratio @ emit, ratio.T @ emit
        both = emit * (left @ joint.T + right @ joint)
        joint = joint * (emit.T @ left)
        emit, joint = both / both.sum(0), joint / joint.sum()
    return emit, joint, float((pairs * np.log(np.maximum(emit @ joint @ emit.T, 1e-300))).sum())


def sampled(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and offsets of a bounded number of different texts, those with the smallest hashes; for a look, not for training."""
    hashed = texts.select("symbols", F.xxhash64("symbols").alias("hash"))
    rows = hashed.select("hash", (F.length("symbols") / 4).alias("n")).distinct().orderBy("hash", "n").limit(SAMPLE).collect()
    keep, tokens = [], 0
    for r in rows:
        if tokens + r.n <= SAMPLE_TOKENS:
            tokens += r.n
            keep.append(r.hash)
    if not keep:
        return np.empty(0, np.int32), np.zeros(1, np.int64)
    got = hashed.where((F.col("hash") <= keep[-1]) & F.col("hash").isin(keep)).groupBy("hash").agg(F.first("symbols").alias("symbols")).orderBy("hash").collect()
    parts = [np.frombuffer(bytes(r.symbols), "<i4") for r in got]
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def first_guess(texts: DataFrame, words: np.ndarray, classes: np.ndarray, unigram: np.ndarray, states: int, seed: int) -> tuple[Model, bool]:
    """The model that the first round starts from, its states told apart by which groups follow which in all of ``texts``; whether there is a text."""
    rng = np.random.default_rng(seed)
    group = grouped(words, classes, unigram)
    weight = np.bincount(group, weights=unigram, minlength=GROUPS)
    joint = (np.eye(states) * 0.9 + 0.1 / states) / states
    first, pairs = pair_counts(texts, group)
    starts = []
    for _ in range(STARTS if pairs.any() else 1):
        emit = weight[:, None] * (0.5 + rng.random((GROUPS, states)))
        starts.append(fitted_pairs(pairs, emit / emit.sum(0), joint, START_ROUNDS if pairs.any() else 0))
    emit, joint, _ = max(starts, key=lambda x: x[2])
    if pairs.any():
        emit, joint, _ = fitted_pairs(pairs, emit, joint, PAIR_ROUNDS)
    guess = Expected(len(unigram), states)
    mass = joint.sum(0)
    likely = emit * mass + 1e-12
    guess.start = first @ (likely / likely.sum(1, keepdims=True))
    guess.move = joint.copy()
    guess.emit = (emit / np.maximum(weight, 1e-300)[:, None])[group] * unigram[:, None] * mass
    return guess.model(words, unigram), bool(first.any())


def train(texts: DataFrame, words: np.ndarray, unigram: np.ndarray, states: int = STATES, seed: int = 5, classes: np.ndarray | None = None) -> Model:
    """``texts``: a table of symbols (little-endian 32-bit) of every training document; ``classes``: those of ``words``; see the module's description."""
    model, some = first_guess(texts, words, np.zeros(len(words), np.int64) if classes is None else classes, unigram, states, seed)
    for _ in range(ROUNDS if some else 0):
        model = expected_counts(texts, model).model(words, unigram)
    return model


def score_documents(docs: DataFrame, states: int = STATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on documents whose crc32(id as text) mod 10 is not 0 and score all.

    Returns (id, held_out, n_tokens, n_known, train_tokens, base_score, score). Words are lower-cased
    (A-Z); each text ends with one end token, so a null or empty text has one token. Null ids count
    as empty id texts (and so are held out), repeated rows count as often as they stand there;
    without a training document every word is unknown and the states are alike. Further columns are
    ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    src = pick(docs, id_col, text_col).toDF("id", "text").select("id", document_number().alias("number"), F.col("text").cast("binary").alias("text"))
    learn = src.where("number % 10 <> 0")
    counts = written(count_words(learn), "words")
    n_docs = learn.count()
    n_words, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, distinct = n_words + n_docs, v + (n_docs > 0)
    top = frequent_words(counts)
    words = np.array([w for w, _, _ in top], dtype=np.uint64)
    often = np.array([n for _, n, _ in top], dtype=np.float64)
    inside, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        inside[r["class"]], kinds[r["class"]] = r.n, r.v
    for _, n, c in top:
        inside[c] -= n
        kinds[c] -= 1
    unigram = np.concatenate([often, inside, [n_docs]]) + ADD
    unigram /= unigram.sum()
    class_log = np.log10(inside + ADD * (kinds + 1))
    base_log = np.log10(tokens + ADD * (distinct + 1))
    freq_log = np.log10(often + ADD) - base_log
    end_log = float(np.log10(n_docs + ADD) - base_log)
    coder = Model(words, np.empty(0), np.empty((0, 0)), np.empty((0, 0)))

    def encode(batches):
        """Symbols of each text, what its rare words say in total, and the rare words to be looked up."""
        import pyarrow as pa
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for b in batches:
            data, off = tk.column_bytes(b.column("text"))
            for i, j in tk.chunks(off):
                w = tk.Words(data[off[i] : off[j]], off[i : j + 1] - off[i], lower=True)
                symbols, known = coder.symbols(w)
                who = np.repeat(np.arange(j - i), np.diff(w.offsets))
                rare = np.flatnonzero(~known)
                lost = np.bincount(who[rare], weights=class_log[symbols[rare] - len(words)], minlength=j - i)
                base = end_log + np.bincount(who[known], weights=freq_log[symbols[known]], minlength=j - i) - base_log * np.bincount(who[rare], minlength=j - i)
                flat, cut = coder.texts(w, symbols)
                order = np.lexsort((w.hash[rare], who[rare]))
                own, text = w.hash[rare][order], who[rare][order]
                lead = np.ones(len(own), dtype=bool)
                lead[1:] = (own[1:] != own[:-1]) | (text[1:] != text[:-1])
                at = np.flatnonzero(lead)
                times = np.diff(np.append(at, len(own)))
                lists_at = np.searchsorted(text[at], np.arange(j - i + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(lists_at), pa.array(x)) for x in (own[at].view(np.int64), times.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), b.column("number").slice(i, j - i), pa.array(row + np.arange(j - i)), pa.array(np.diff(cut)), pa.array(base.astype(np.float64)), pa.array(lost.astype(np.float64)), tk.binary_array(flat.astype("<i4").view(np.uint8), 4 * cut), *lists], ["id", "number", "row", "n_tokens", "base", "lost", "symbols", "rare", "times"])
                row += j - i

    table = written(src.mapInArrow(encode, f"id {kind}, number long, row long, n_tokens long, base double, lost double, symbols binary, rare array<long>, times array<int>"), "symbols")
    model = train(table.where("number % 10 <> 0").select("symbols"), words, unigram, states, classes=np.array([c for _, _, c in top], dtype=np.int64))
    shared = src.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        import pyarrow as pa

        m, keep = shared.value, ["id", "number", "row", "n_tokens", "base"]
        for b in batches:
            flat, off = flat_symbols(b.column("symbols"))
            for i, j in tk.chunks(off, 4 * AT_ONCE):
                like = forward(flat[off[i] : off[j]], off[i : j + 1] - off[i], m) / np.log(10)
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(like - np.asarray(part.column("lost")))], [*keep, "like"])

    scored = table.select("id", "number", "row", "n_tokens", "base", "lost", "symbols").mapInArrow(score, f"id {kind}, number long, row long, n_tokens long, base double, like double")
    each = table.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    got = each.join(counts.select("word", F.col("n")), "word", "left")
    sums = got.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(ADD))).alias("more"), F.sum(F.when(F.col("n").isNull(), F.col("times")).otherwise(0)).alias("unknown"))
    more, unknown = F.coalesce("more", F.lit(0.0)), F.coalesce("unknown", F.lit(0))
    out = scored.join(sums, "row", "left")
    return out.select(
        F.col("id").alias(id_col), (F.col("number") % 10 == 0).alias("held_out"), "n_tokens", (F.col("n_tokens") - unknown - F.lit(0 if n_docs else 1)).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("like") + more).alias("score"),
    )
