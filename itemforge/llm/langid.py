"""Language identification by a linear-chain conditional random field.

Every word of a text is labelled with a language; transitions between neighbouring words are
learned, so code-switched text is followed word by word. Features of a word are its first one to
three and last one to four bytes, its byte trigrams (with word edges), the word itself, and a lexicon
entry: the language to which nearly all its occurrences in the training sample belong. Marginals come
from scaled forward-backward; a document's language is the one with the largest mean marginal over
its words, and that mean is the score.

The model is fitted on a bounded sample of different labelled texts: of each language those with the
smallest hashes, at most ``PER_LABEL`` of them and no more once ``LABEL_BYTES`` are reached. No language is left
out: where there are more than ``LABELS`` of them each gives fewer texts, one at least.  Their whole texts are used; one executor task fits the model, and
only the weights that occur reach the driver.  A chain is a whole text, in training and in
prediction. Prediction is one pass without a shuffle.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itemforge.llm import textkit as tk
from itemforge.llm.chains import forward_backward
from itemforge.llm.hmm import document_number
from itemforge.llm.shared import carried, pick, released

PER_LABEL = 300
LABEL_BYTES = 1 << 20
LABELS = 256
BUCKETS = 1 << 18
ROUNDS = 25
RATE = 0.3
DECAY = 1e-6
LEXICON_SHARE = 0.9
UNKNOWN = "und"
#: Log weight below the best label at which a word's evidence against a label ends.
LEAST = -200.0


@dataclass
class Crf:
    labels: list[str]
    used: np.ndarray  # buckets that have weights
    weights: np.ndarray  # of each of them by label
    move: np.ndarray  # label by label
    first: np.ndarray
    lexicon: np.ndarray  # sorted word hashes
    entry: np.ndarray  # label of each

    def table(self) -> np.ndarray:
        """Weights of all buckets."""
        out = np.zeros((BUCKETS, len(self.labels)), dtype=np.float32)
        out[self.used] = self.weights
        return out

    def emissions(self, feature: np.ndarray, count: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Score of every label for words given by their features (``count`` of them each)."""
        if not hasattr(self, "_all"):
            self._all = self.table()
        begin = np.concatenate([[0], np.cumsum(count)])[:-1]
        out = np.add.reduceat(self._all[feature], begin, axis=0) if len(count) else np.zeros((0, len(self.labels)), np.float32)
        if len(self.lexicon) and len(word):
            at = np.minimum(np.searchsorted(self.lexicon, word), len(self.lexicon) - 1)
            hit = np.flatnonzero(self.lexicon[at] == word)
            out[hit] += self._all[lexicon_bucket(self.entry[at[hit]])]
        return out


def lexicon_bucket(label: np.ndarray) -> np.ndarray:
    return (tk.mix(label.astype(np.uint64) + np.uint64(77)) % np.uint64(BUCKETS)).astype(np.int64)


class Types:
    """The different words of a range of texts, with their features."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = tk.Words(data, offsets, lower=True)
        w = self.words
        self.hash, one, self.inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        start, end = w.start[one], w.end[one]
        size = end - start
        # each different word between blanks, so that trigrams see its edges
        text = np.full(int((size + 2).sum()), 0x20, dtype=np.uint8)
        base = np.concatenate([[0], np.cumsum(size + 2)])[:-1]
        text[tk.spread(base + 1, size)] = w.data[tk.spread(start, size)]
        p = tk.prefix_hash(text)
        b, e = base + 1, base + 1 + size
        parts = [self.hash]
        for k in (1, 2, 3):
            parts.append(tk.span_hash(p, b, np.minimum(b + k, e)) + np.uint64(k))
        for k in (1, 2, 3, 4):
            parts.append(tk.span_hash(p, np.maximum(e - k, b), e) + np.uint64(10 + k))
        fixed = np.stack(parts, 1)
        grams = tk.spread(base, size)
        tri = tk.span_hash(p, grams, np.minimum(grams + 3, len(text))) + np.uint64(20)
        self.count = fixed.shape[1] + size
        lead = np.concatenate([[0], np.cumsum(self.count)])[:-1]
        flat = np.empty(int(self.count.sum()), dtype=np.uint64)
        flat[tk.spread(lead, np.full(len(lead), fixed.shape[1]))] = fixed.ravel()
        flat[tk.spread(lead + fixed.shape[1], size)] = tri
        self.feature = (tk.mix(flat) % np.uint64(BUCKETS)).astype(np.int64)
        letter = (text >= 0x80) | ((text | 0x20) >= 97) & ((text | 0x20) <= 122)
        self.letter = np.add.reduceat(letter, base) > 0 if len(base) else np.empty(0, bool)


def marginals(emit: np.ndarray, off: np.ndarray, move: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Marginals of each word, expected transitions, expected first labels, log partition of all texts (``off``: their offsets)."""
    top = emit.max(1, keepdims=True) if len(emit) else emit
    e = np.exp(np.maximum(emit - top, LEAST).astype(np.float64))
    p, pairs, begin, log = forward_backward(e, off, np.exp(move.astype(np.float64)), np.exp(first.astype(np.float64)))
    return p, pairs, begin, log + float(top.sum())


def text_sums(m: Crf, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the marginals over a text's words with a letter, and the number of these words."""
    emits, uses, total = [], [], 0
    for piece, cut in tk.cut_rows(data, off):
        t = Types(piece, cut)
        if len(t.words):
            emits.append(m.emissions(t.feature, t.count, t.hash)[t.inverse])
            uses.append(t.letter[t.inverse])
    n, k = len(off) - 1, len(m.labels)
    if not emits:
        return np.zeros((n, k)), np.zeros(n, dtype=np.int64)
    words = tk.words_before(data, off)
    p, _, _, _ = marginals(np.concatenate(emits), words, m.move, m.first)
    use = np.concatenate(uses)
    who = np.repeat(np.arange(n), np.diff(words))[use]
    return np.stack([np.bincount(who, weights=p[use, c], minlength=n) for c in range(k)], 1), np.bincount(who, minlength=n)


def fit(texts: list[bytes], truth: list[int], labels: list[str]) -> Crf:
    """Conditional log-likelihood by AdaGrad over the whole sample."""
    off = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
    t = Types(np.frombuffer(b"".join(texts), np.uint8), off)
    k, words = len(labels), t.words
    gold = np.repeat(np.array(truth), np.diff(words.offsets))
    seen = np.zeros((len(t.hash), k))
    np.add.at(seen, (t.inverse, gold), 1)
    share = seen.max(1) / np.maximum(seen.sum(1), 1)
    sure = (share >= LEXICON_SHARE) & (seen.sum(1) >= 3)
    extra = np.zeros(len(t.hash), dtype=np.int64)
    feature, count = t.feature, t.count
    if sure.any():  # the lexicon's feature is one more of these words
        extra[sure] = 1
        lead = np.concatenate([[0], np.cumsum(count + extra)])[:-1]
        grown = np.empty(int((count + extra).sum()), dtype=np.int64)
        grown[tk.spread(lead, count)] = feature
        grown[lead[sure] + count[sure]] = lexicon_bucket(seen.argmax(1)[sure])
        feature, count = grown, count + extra
    begin = np.concatenate([[0], np.cumsum(count)])[:-1]
    owner = np.repeat(np.arange(len(count)), count)
    used, feature = np.unique(feature, return_inverse=True)
    size = np.diff(words.offsets)
    firsts_seen = np.bincount(np.array(truth)[size > 0], minlength=k)
    same = np.bincount(gold, minlength=k) - firsts_seen
    weights, move, first = np.zeros((len(used), k), np.float32), np.zeros((k, k)), np.zeros(k)
    g2 = [np.full_like(x, 1e-8) for x in (weights, move, first)]
    n = max(1, len(gold))
    for _ in range(ROUNDS):
        emit = np.add.reduceat(weights[feature], begin, axis=0)[t.inverse]
        p, pairs, starts, _ = marginals(emit, words.offsets, move, first)
        by_type = -np.stack([np.bincount(t.inverse, weights=p[:, c], minlength=len(t.hash)) for c in range(k)], 1)
        by_type += seen
        grad = np.stack([np.bincount(feature, weights=by_type[owner, c], minlength=len(used)) for c in range(k)], 1).astype(np.float32) / n
        for x, g, s in zip((weights, move, first), (grad, (np.diag(same) - pairs) / n, (firsts_seen - starts) / n), g2, strict=True):
            g = g - DECAY * x
            s += g * g
            x += RATE * g / np.sqrt(s)
    return Crf(labels, used, weights, move, first, t.hash[sure], seen.argmax(1)[sure])


def train(docs: DataFrame) -> Crf | None:
    """``docs``: text binary, lang. None if there is no labelled text with a word."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").withColumn("hash", F.xxhash64("text"))
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n")).collect()}
    if not sizes:
        return None
    labels = sorted(sizes)
    portions = -(-len(labels) // LABELS)
    scale = 1 << 40  # twice the share of different texts that gives PER_LABEL, and all of a few
    share = F.create_map(*[F.lit(x) for v in labels for x in (v, int(min(scale, -(-scale * 2 * (PER_LABEL + 50) // max(1, sizes[v])))))])
    some = known.where(F.pmod("hash", F.lit(scale)) < share[F.col("lang")]).groupBy("lang", "hash").agg(F.first("text").alias("text"))
    by = Window.partitionBy("lang").orderBy(F.pmod("hash", F.lit(scale)), "hash")
    before = F.coalesce(F.sum(F.length("text")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = some.select("lang", "text", F.row_number().over(by).alias("n"), before.alias("before")).where((F.col("n") <= max(1, PER_LABEL // portions)) & (F.col("before") < max(1, LABEL_BYTES // portions)))

    def run(batches):
        import pyarrow as pa

        rows = sorted((bytes(t), lang) for b in batches for t, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True))
        rows = [r for r in rows if r[0].split()]
        if rows:
            model = fit([r[0] for r in rows], [labels.index(r[1]) for r in rows], labels)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    got = chosen.select("lang", "text").repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(got[0].model) if got else None


def identify(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Returns (id, held_out, lang_pred, score) for every row of ``docs``.

    Training rows are those of ``labelled`` (``docs`` itself by default) whose crc32(id as text) mod 4
    is not 2 and whose language is not null. A null text and one without a letter get ``und`` with
    score 0, and so does every text if there is no training row; of languages with equal marginals the
    first by name is taken. Null ids count as an empty text, repeated rows are predicted each alike; further columns are ignored, or with ``keep`` the named
    ones are returned in place of the id.
    """
    src = docs.select(carried(id_col, keep).alias("id"), F.col(text_col).alias("text"), document_number(id_col).alias("number"))
    base = docs if labelled is None else labelled
    learn = pick(base, id_col, text_col, lang_col).toDF("id", "text", "lang").where(document_number() % 4 != 2)
    model = train(learn.select(F.col("text").cast("binary").alias("text"), "lang"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = src.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for b in batches:
            data, off = tk.column_bytes(b.column("text"))
            letter = np.asarray(b.column("letter"))
            for i, j in tk.chunks(off):
                n = j - i
                best, score = np.full(n, -1), np.zeros(n)
                if m is not None and off[j] > off[i]:
                    total, words = text_sums(m, data[off[i] : off[j]], off[i : j + 1] - off[i])
                    best = np.where(words > 0, total.argmax(1), -1)
                    score = np.where(words > 0, np.minimum(1.0, total.max(1) / np.maximum(words, 1)), 0.0)
                best[~letter[i:j]] = -1
                score[best < 0] = 0.0
                names = np.array([*(m.labels if m else []), UNKNOWN], dtype=object)
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, n), b.column("held_out").slice(i, n), pa.array(names[best].tolist(), pa.string()), pa.array(score)], ["id", "held_out", "lang_pred", "score"])

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    out = src.select("id", (F.col("number") % 4 == 2).alias("held_out"), letter.alias("letter"), F.col("text").cast("binary").alias("text")).mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double")
    return out.select(*released(id_col, keep), "held_out", "lang_pred", "score")
