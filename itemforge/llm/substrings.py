"""Substring dedup by seed and extend.

Every window of ``WINDOW`` words holds an anchor: of its ``GRAM``-word grams the one with the smallest
hash (winnowing), so equal windows hold the same anchor at the same place.  Documents are joined on
anchors that occur at least twice.  Around a joined anchor the match is extended word by word to the
left and to the right, for all its occurrences at once: those that agree so far form a class, and each
further word splits the classes; an occurrence that is alone in its class extends no further.  Two
occurrences that are in one class after some words to the left and in one after the words to the right
that complete a window share that window.  Every window is reached from its own anchor, so neighbouring
windows that match merge into maximal repeats, however long.  All but the first occurrence go.

An anchor of more than ``HOT_SEED`` occurrences is dealt over several tasks; each keeps the first
occurrence of every window it sees, and those meet again by anchor and window.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemforge.llm import textkit as tk
from itemforge.llm.shared import dealt, discard, matched, pick, seed_filter, written

WINDOW = 20
GRAM = 8
LAST = (1 << 63) - 1
#: Bytes of word hashes that a task extends at a time.
EXTEND_BYTES = 1 << 22


class Windows:
    """Windows of a range of rows, grouped by the anchor that each holds."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, gram: int):
        w = tk.Words(data, offsets)
        n = max(0, len(w) - window + 1)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(w.offsets))
        grams = tk.gram_hash(w.hash, gram)
        choice = tk.window_choice(grams, window - gram + 1)[:n]
        p = np.flatnonzero(row[:n] == row[window - 1 : window - 1 + n])
        s, e = tk.runs(choice[p])
        cut = np.flatnonzero(np.diff(p) > 1) + 1  # an anchor is never shared over a gap, but be safe
        s = np.union1d(s, cut[cut < len(p)]) if len(p) else s
        e = np.append(s[1:], len(p)) if len(p) else e
        self.word = w.hash
        self.seed = grams[choice[p[s]]] if len(p) else np.empty(0, np.uint64)
        self.first = p[s] if len(p) else np.empty(0, np.int64)
        self.anchor = choice[p[s]] if len(p) else np.empty(0, np.int64)
        self.count = e - s
        self.row = row[self.first]
        self.place = self.first - w.offsets[self.row]


def grown(classes: np.ndarray, word: np.ndarray, fits: np.ndarray) -> np.ndarray:
    """Classes (-1: none) split by one more word; members without that word, or left alone, drop out."""
    out = np.full(len(classes), -1, dtype=np.int64)
    m = np.flatnonzero((classes >= 0) & fits)
    if not len(m):
        return out
    order = m[np.lexsort((word[m], classes[m]))]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (classes[order][1:] != classes[order][:-1]) | (word[order][1:] != word[order][:-1])
    number = np.cumsum(new) - 1
    many = np.bincount(number)[number] > 1
    out[order[many]] = number[many]
    return out


def shared_windows(group: np.ndarray, words: np.ndarray, begin: np.ndarray, left: np.ndarray, right: np.ndarray, window: int, gram: int):
    """(words to the left, members, class) of every window that occurrences of an anchor share.

    ``group``: the anchor of each member; its words stand at begin - left .. begin + gram + right - 1.
    """
    spare = window - gram
    to_right = [group]
    for k in range(spare):
        fits = right > k
        to_right.append(grown(to_right[-1], words[np.where(fits, begin + gram + k, 0)], fits))
    now = group
    for k in range(spare + 1):
        if k:
            fits = left >= k
            now = grown(now, words[np.where(fits, begin - k, 0)], fits)
        # the window with k words to the left: in one class on either side
        both = grown(now, to_right[spare - k].view(np.uint64), (left >= k) & (right >= spare - k) & (to_right[spare - k] >= 0))
        m = np.flatnonzero(both >= 0)
        if len(m):
            yield k, m, both[m]


def seeds(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(key, n): seeds and how often each occurs, summed within a batch."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            data, off = tk.column_bytes(b.column("text"))
            for i, j in tk.chunks(off):
                x = Windows(data[off[i] : off[j]], off[i : j + 1] - off[i], window, gram)
                key, n = np.unique(x.seed, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    return docs.select("text").mapInArrow(run, "key long, n long")


def ranks(*columns: np.ndarray) -> np.ndarray:
    """Rank of each row by the columns; equal rows share one."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), dtype=bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def removed_windows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(ord, text_key, spans): runs s..e of windows of a document that occur earlier."""
    wanted, hot = seed_filter(seeds(docs, window, gram), "seeds")

    def members(batches):
        """Occurrences of repeated anchors, each with the hashes of the words that its windows cover."""
        import pyarrow as pa

        for b in batches:
            data, off = tk.column_bytes(b.column("text"))
            ord_, key = np.asarray(b.column("ord")), np.asarray(b.column("text_key"))
            for i, j in tk.chunks(off):
                x = Windows(data[off[i] : off[j]], off[i : j + 1] - off[i], window, gram)
                m = np.flatnonzero(wanted.holds(x.seed))
                at, size = x.row[m] + i, x.count[m] + window - 1
                words = x.word[tk.spread(x.first[m], size)].view(np.uint8)
                left = (x.anchor[m] - x.first[m]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x.seed[m].view(np.int64)), pa.array(ord_[at]), pa.array(key[at]), pa.array(x.place[m]), pa.array(left), tk.binary_array(words, 8 * np.concatenate([[0], np.cumsum(size)]))], ["seed", "ord", "text_key", "place", "left", "words"])

    def extend(batches):
        import pyarrow as pa

        for parts in tk.whole_groups(batches, ["seed", "salt"], "words", EXTEND_BYTES):
            t = pa.Table.from_batches(parts).combine_chunks()
            raw, off = tk.column_bytes(t.column("words"))
            seed, salt, ord_, text, place = (np.asarray(t.column(c)) for c in ("seed", "salt", "ord", "text_key", "place"))
            left = np.asarray(t.column("left")).astype(np.int64)
            size = np.diff(off) // 8
            group = np.cumsum(np.concatenate([[0], (seed[1:] != seed[:-1]) | (salt[1:] != salt[:-1])]).astype(np.int64)) if len(seed) else seed
            rank = ranks(ord_, text, place)
            gone = []
            for k, m, same in shared_windows(group, raw.view(np.uint64), off[:-1] // 8 + left, left, size - left - gram, window, gram):
                first = np.full(int(same.max()) + 1, len(seed))
                np.minimum.at(first, same, rank[m])
                late = rank[m] != first[same]
                gone.append(np.stack([m[late], place[m[late]] + left[m[late]] - k]))
            who, at = np.concatenate(gone, axis=1) if gone else np.empty((2, 0), np.int64)
            order = np.lexsort((at, who))
            who, at = who[order], at[order]
            cut = np.ones(len(who), dtype=bool)
            cut[1:] = (who[1:] != who[:-1]) | (at[1:] != at[:-1] + 1)
            s = np.flatnonzero(cut)
            e = np.append(s[1:], len(who)) - 1 if len(s) else s
            none = pa.nulls(len(s), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ord_[who[s]]), pa.array(text[who[s]]), pa.array(at[s]), pa.array(at[e]), none, none], ["ord", "text_key", "s", "e", "seed", "key"])
            dealt_out = np.flatnonzero(salt >= 0)
            if not len(dealt_out):
                continue
            # what is left of a hot anchor's windows, one by one, to meet the other parts'
            keys = tk.gram_hash(raw.view(np.uint64), window)
            n = size[dealt_out] - window + 1
            own, start = np.repeat(dealt_out, n), tk.spread(place[dealt_out], n)
            key = keys[tk.spread(off[dealt_out] // 8, n)]
            taken = (own << 32) + (start - place[own])
            stay = ~np.isin(taken, (who << 32) + (at - place[who]))
            own, start, key = own[stay], start[stay], key[stay]
            yield pa.RecordBatch.from_arrays([pa.array(ord_[own]), pa.array(text[own]), pa.array(start), pa.array(start), pa.array(seed[own]), pa.array(key.view(np.int64))], ["ord", "text_key", "s", "e", "seed", "key"])

    rows = docs.select("ord", "text_key", "text").mapInArrow(members, "seed long, ord long, text_key long, place long, left int, words binary")
    salt = F.when(F.col("parts") == 1, -1).otherwise(F.pmod(F.xxhash64("ord", "text_key"), F.col("parts"))).cast("int")
    rows = dealt(rows, hot, "seed").select("seed", salt.alias("salt"), "ord", "text_key", "place", "left", "words")
    rows = rows.repartition("seed", "salt").sortWithinPartitions("seed", "salt")
    found = written(rows.mapInArrow(extend, "ord long, text_key long, s long, e long, seed long, key long"), "windows")
    runs = found.where("key IS NULL").select("ord", "text_key", "s", "e")
    if hot is not None:
        left = found.where("key IS NOT NULL")
        first = left.groupBy("seed", "key").agg(F.min(F.struct("ord", "text_key", "s")).alias("first"))
        late = left.join(first, ["seed", "key"]).where(F.struct("ord", "text_key", "s") != F.col("first"))
        runs = runs.union(late.select("ord", "text_key", "s", "e"))
    out = written(runs.groupBy("ord", "text_key").agg(F.collect_set(F.struct("s", "e")).alias("spans")), "spans")
    discard(found, *([hot] if hot is not None else []))
    return out


def drop_repeated_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word covered by a window of words that also starts earlier.

    Returns (id, n_words, n_removed, kept): kept is the remaining words joined by one blank. Earlier
    means a smaller id, then, for rows that share an id, a smaller hash of the text, then an earlier
    start; rows equal in id and text are one document and leave each other alone. Null ids come
    last. Null and empty texts have no words. ``id_col`` holds integers; further columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    src = pick(docs, id_col, text_col).toDF("id", "text").select("id", F.coalesce(F.col("id").cast("long"), F.lit(LAST)).alias("ord"), F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text"))
    both = matched(src, removed_windows(src, window, gram), ["ord", "text_key"])

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            data, off = tk.column_bytes(b.column("text"))
            for i, j in tk.chunks(off):
                part = b.slice(i, j - i)
                w = tk.Words(data[off[i] : off[j]], off[i : j + 1] - off[i])
                edge = np.zeros(len(w) + 1, dtype=np.int64)
                lists = part.column("spans")
                n = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
                flat = lists.flatten()
                base = np.repeat(w.offsets[:-1], n)
                np.add.at(edge, base + np.asarray(flat.field("s")), 1)
                np.add.at(edge, base + np.asarray(flat.field("e")) + window, -1)
                keep = np.cumsum(edge[:-1]) == 0
                gone = np.concatenate([[0], np.cumsum(~keep)])[w.offsets]
                text, cuts = tk.join_words(w, keep)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(w.offsets)), pa.array(np.diff(gone)), tk.binary_array(text, cuts, string=True)], ["id", "n_words", "n_removed", "kept"])

    out = both.select("id", "text", "spans").mapInArrow(cut, f"id {kind}, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("id", id_col)
