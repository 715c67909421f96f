"""Suffix-array dedup of byte strings of a fixed length by two-stage sorting.

Which strings of ``LENGTH`` bytes occur more than once is read off a suffix array: equal strings
stand side by side, and the common prefix of neighbours tells them apart.  Sorting is in two stages:
only suffixes smaller than their successor are sorted directly; the order of all others is induced by
one scan over the first-byte buckets, since a suffix larger than its successor is ordered by its
first byte and its successor's rank.

One suffix array of a corpus cannot be built in one place, so suffixes are first dealt to groups that
keep equal strings together: of the 50-byte grams in a string, the one with the smallest hash is its
seed, and equal strings hold the same seed at the same place.  Consecutive strings with one seed form
a context.  Only contexts whose seed occurs at least twice are sorted; equal contexts of a task are
sent once with their number, and one that occurs several times is sorted with a twin, so that its
suffixes stand beside their copies too.  Contexts are known by a 128-bit digest.  A seed of more than
``HOT_SEED`` contexts is dealt over several tasks, which pass on one copy of each string they hold; those
meet again by the string's digest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemforge.llm import textkit as tk
from itemforge.llm.shared import carried, dealt, discard, matched, released, seed_filter, small_or_shuffled, written

LENGTH = 200
GRAM = 50
SEGMENT = 1 << 20
SORT_BYTES = 1 << 19
AT_ONCE = 1 << 13
#: Different contexts and texts that a task remembers to send each once.
SEEN = 1 << 18


class Contexts:
    """Runs of strings with one seed in a range of rows: seed, row, first start, number of starts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
        n = len(data) - length + 1
        if n <= 0:
            self.seed, self.at, self.count, self.row = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
            return
        p = tk.prefix_hash(data)
        at = np.arange(len(data) - gram + 1)
        grams = tk.span_hash(p, at, at + gram)
        choice = tk.window_choice(grams, length - gram + 1)
        last = offsets[1:] - length  # last start of each row
        good = np.zeros(n + 1, dtype=np.int64)
        whole = last >= offsets[:-1]
        np.add.at(good, offsets[:-1][whole], 1)
        np.add.at(good, last[whole] + 1, -1)
        start = np.flatnonzero(np.cumsum(good)[:n] > 0)
        row = np.searchsorted(offsets, start, side="right") - 1
        tag = choice[start]
        if len(start):
            new = np.flatnonzero((np.diff(tag) != 0) | (np.diff(row) != 0)) + 1
            s = np.concatenate([[0], new])
            e = np.concatenate([new, [len(start)]])
        else:
            s = e = np.empty(0, np.int64)
        self.seed, self.at, self.count, self.row = grams[tag[s]] if len(s) else np.empty(0, np.uint64), start[s], e - s, row[s]


def segments(data: np.ndarray, offsets: np.ndarray, length: int):
    """(bytes, offsets, first row, place of the first byte in its row); a long text comes in overlapping pieces."""
    for i, j in tk.chunks(offsets):
        a, b = offsets[i], offsets[j]
        if j - i > 1 or b - a <= 2 * SEGMENT:
            yield data[a:b], offsets[i : j + 1] - a, i, 0
            continue
        for at in range(a, b - length + 1, SEGMENT):
            end = min(b, at + SEGMENT + length - 1)
            yield data[at:end], np.array([0, end - at]), i, at - a


def two_stage_order(text: np.ndarray, ends: np.ndarray, begins: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Order of the suffixes at begins[i] .. begins[i]+starts[i]-1 of each context i, by ``length`` bytes at least.

    A context is text[begins[i]:ends[i]], all of them side by side; a suffix ends with its context.
    Positions after the starts are sorted along as far as induction needs them.
    """
    n = len(text)
    rise = np.zeros(n, dtype=np.int8)
    rise[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    rise[ends - 1] = -1  # the empty suffix is the smallest
    told = np.where(rise != 0, np.arange(n), n)
    told = np.minimum.accumulate(told[::-1])[::-1]
    small = rise[told] > 0  # smaller than the successor
    next_small = np.where(small, np.arange(n), n)
    next_small = np.minimum.accumulate(next_small[::-1])[::-1]
    stop = np.minimum(next_small[begins + starts - 1], ends - 1)
    inside = np.zeros(n + 1, dtype=np.int8)
    np.add.at(inside, begins, 1)
    np.add.at(inside, stop + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    head = np.zeros(n, dtype=bool)
    head[begins] = True

    # first stage: sort directly
    direct = np.flatnonzero(inside & small)
    padded = np.concatenate([text, np.zeros(length, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, length)[direct]
    room = np.repeat(ends, ends - begins)[direct] - direct
    short = np.flatnonzero(room < length)
    for a in range(0, len(short), AT_ONCE):
        s = short[a : a + AT_ONCE]
        rows[s] *= np.arange(length)[None, :] < room[s, None]
    direct = direct[np.argsort(np.ascontiguousarray(rows).view(f"S{length}").ravel(), kind="stable")]
    by_byte = np.searchsorted(text[direct], np.arange(257))

    # second stage: induce
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]

    def before(p: np.ndarray) -> np.ndarray:
        q = p[~head[p]] - 1
        return q[~small[q]]

    def pass_on(q: np.ndarray) -> None:
        if len(q):
            q = q[np.argsort(text[q], kind="stable")]
            s, e = tk.runs(text[q])
            for a, b in zip(s, e, strict=True):
                waiting[text[q[a]]].append(q[a:b])

    tails = ends - 1
    pass_on(tails[inside[tails] & ~small[tails]])
    out = []
    for c in range(256):
        larger = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, np.int64)
        parts = [larger]
        while len(larger):
            larger = before(larger)
            larger = larger[text[larger] == c]
            parts.append(larger)
        parts.append(direct[by_byte[c] : by_byte[c + 1]])
        bucket = np.concatenate(parts)
        out.append(bucket)
        q = before(bucket)
        pass_on(q[text[q] > c])
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Common prefix, up to ``length`` bytes, of each suffix in ``order`` with the one before it; 0 for the first."""
    out = np.zeros(len(order), dtype=np.int64)
    if len(order) < 2:
        return out
    view = np.lib.stride_tricks.sliding_window_view(text, length)
    for a in range(1, len(order), AT_ONCE):
        at = order[a - 1 : a + AT_ONCE]
        rows = view[at]
        differ = rows[1:] != rows[:-1]
        out[a : a + len(differ)] = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    return out


def repeated_starts(text: np.ndarray, begins: np.ndarray, ends: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, repeated, first of its kind) of every start, in suffix order, by adjacent common prefixes."""
    order = two_stage_order(text, ends, begins, starts, length)
    full = np.zeros(len(text) + 1, dtype=np.int64)
    np.add.at(full, begins, 1)
    np.add.at(full, begins + starts, -1)
    order = order[np.cumsum(full[:-1])[order] > 0]
    same = common_prefixes(text, order, length) >= length
    repeated = same.copy()
    repeated[:-1] |= same[1:]
    return order, repeated, ~same


def seeds(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for b in batches:
            data, off = tk.column_bytes(b.column("text"))
            for piece, cut, _, _ in segments(data, off, length):
                key, n = np.unique(Contexts(piece, cut, length, gram).seed, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    return docs.select("text").mapInArrow(run, "key long, n long")


def repeated_spans(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(text_key, spans): runs s..e of starts, within each text, of strings that also start elsewhere."""
    wanted, hot = seed_filter(seeds(docs, length, gram), "byte-seeds")
    names = ["seed", "context", "starts", "copies", "bytes", "text_key", "at"]

    def contexts(batches):
        """Rows with bytes or copies go to the sort; rows with text_key place a context in a text."""
        import pyarrow as pa

        copies: dict[bytes, list] = {}
        known: set[int] = set()

        def rest():
            late = [(k, *v) for k, v in copies.items() if v[1] > 0]
            copies.clear()
            known.clear()
            if late:
                context, seed, n = zip(*late, strict=True)
                m = len(late)
                yield pa.RecordBatch.from_arrays([pa.array(seed, pa.int64()), pa.array(context, pa.binary()), pa.nulls(m, pa.int64()), pa.array(n, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], names)

        for b in batches:
            data, off = tk.column_bytes(b.column("text"))
            keys = np.asarray(b.column("text_key"))
            for piece, cut, first_row, base in segments(data, off, length):
                x = Contexts(piece, cut, length, gram)
                m = np.flatnonzero(wanted.holds(x.seed))
                if not len(m):
                    continue
                at, count, seed = x.at[m], x.count[m], x.seed[m].view(np.int64)
                context = tk.digests(piece, at, count + length - 1)
                row = x.row[m] + first_row
                place = at - cut[x.row[m]] + base
                seed_list, new = seed.tolist(), []
                for i, c in enumerate(context):
                    if c in copies:
                        copies[c][1] += 1
                    else:
                        copies[c] = [seed_list[i], 0]
                        new.append(i)
                new = np.array(new, dtype=np.int64)
                size = count[new] + length - 1
                raw = piece[tk.spread(at[new], size)]
                k = len(new)
                whole = pa.array(context, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(seed[new]), whole.take(pa.array(new)), pa.array(count[new]), pa.array(np.ones(k, np.int64)), tk.binary_array(raw, np.concatenate([[0], np.cumsum(size)])), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names)
                fresh = np.array([t not in known for t in keys[row].tolist()], dtype=bool) if base == 0 else np.ones(len(row), dtype=bool)
                f = np.flatnonzero(fresh)
                k = len(f)
                yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), whole.take(pa.array(f)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(keys[row[f]]), pa.array(place[f])], names)
                known.update(keys[row].tolist())
                if len(copies) > SEEN or len(known) > SEEN:
                    yield from rest()
        yield from rest()

    def sort(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for parts in tk.whole_groups(batches, ["seed", "salt"], "bytes", SORT_BYTES):
            t = pa.Table.from_batches(parts).combine_chunks()
            digest = t.column("context").combine_chunks().dictionary_encode()
            inverse, ids = np.asarray(digest.indices), digest.dictionary
            total = np.bincount(inverse, weights=np.asarray(t.column("copies")).astype(np.int64), minlength=len(ids)).astype(np.int64)
            has = np.flatnonzero(np.asarray(t.column("bytes").is_valid()))
            one = has[np.unique(inverse[has], return_index=True)[1]]  # bytes of each context once
            twin = np.repeat(one, np.minimum(total[inverse[one]], 2))  # and twice if it occurs again
            s = t.take(pa.array(twin))
            raw, off = tk.column_bytes(s.column("bytes"))
            starts = np.asarray(s.column("starts")).astype(np.int64)
            own = inverse[twin]
            order, repeated, lead = repeated_starts(raw, off[:-1], off[1:], starts, length)
            yes = np.zeros(len(raw) + 1, dtype=bool)
            yes[order[repeated]] = True
            edge = np.diff(np.concatenate([[False], yes]).astype(np.int8))
            a, e = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0) - 1
            # a run never leaves its context: the last length-1 bytes of a context are no starts
            who = np.searchsorted(off, a, side="right") - 1
            first = np.ones(len(own), dtype=bool)
            first[1:] = own[1:] != own[:-1]
            a, e, who = (y[first[who]] for y in (a, e, who))  # a twin says what the first says
            k = len(a)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(own[who])), pa.array(a - off[who]), pa.array(e - off[who]), pa.nulls(k, pa.binary())], ["context", "s", "e", "string"])
            hot_part = np.asarray(s.column("salt")) >= 0
            if hot_part.any():
                who = np.searchsorted(off, order, side="right") - 1
                mark = np.flatnonzero(hot_part[who] & first[who])
                # each kind once for the other parts; its place only if it stands alone in this one
                kind = np.cumsum(lead) - 1
                once = mark[np.unique(kind[mark], return_index=True)[1]]
                string = tk.digests(raw, order[once], np.full(len(once), length))
                alone = pa.array(~repeated[once])
                place = pa.array(order[once] - off[who[once]], mask=repeated[once])
                context = pc.if_else(alone, ids.take(pa.array(own[who[once]])), None)
                yield pa.RecordBatch.from_arrays([context, place, pa.nulls(len(once), pa.int64()), pa.array(string, pa.binary())], ["context", "s", "e", "string"])

    made = written(docs.select("text_key", "text").mapInArrow(contexts, "seed long, context binary, starts long, copies long, bytes binary, text_key long, at long"), "contexts")
    rows = dealt(made.where("seed IS NOT NULL").select("seed", "context", "starts", "copies", "bytes"), hot, "seed")
    salt = F.when(F.col("parts") == 1, -1).otherwise(F.pmod(F.xxhash64("context"), F.col("parts"))).cast("int")
    rows = rows.select("seed", salt.alias("salt"), "context", "starts", "copies", "bytes").repartition("seed", "salt").sortWithinPartitions("seed", "salt")
    found = written(rows.mapInArrow(sort, "context binary, s long, e long, string binary"), "repeats")
    ranges = found.where("string IS NULL").select("context", "s", "e")
    if hot is not None:
        each = found.where("string IS NOT NULL")
        twice = each.groupBy("string").count().where("count > 1").select("string")
        ranges = ranges.union(each.where("context IS NOT NULL").join(twice, "string").select("context", "s", F.col("s").alias("e")))
    # one array of runs for each context, so that a context with many places and many runs is no product
    runs = written(ranges.groupBy("context").agg(F.collect_set(F.struct("s", "e")).alias("runs")), "runs")
    places = made.where("text_key IS NOT NULL").select("context", "text_key", "at").distinct()
    moved = F.transform("runs", lambda r: F.struct((F.col("at") + r.s).alias("s"), (F.col("at") + r.e).alias("e")))
    out = written(places.join(small_or_shuffled(runs), "context").groupBy("text_key").agg(F.flatten(F.collect_list(moved)).alias("spans")), "byte-spans")
    discard(made, found, runs, *([hot] if hot is not None else []))
    return out


def drop_repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Remove every byte covered by a string of ``length`` bytes that also starts anywhere else.

    Texts are UTF-8 bytes; strings are judged on the input. Returns (id, n_bytes, n_removed,
    n_spans, kept binary): a cut may fall inside a character. Equal rows are copies of each other,
    and so lose what is long enough; null and empty texts and texts shorter than ``length`` lose
    nothing. Null or repeated ids do not matter; further columns are ignored, or with ``keep`` the
    named ones are returned in place of the id.
    """
    src = docs.select(carried(id_col, keep).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    src = src.select("id", F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text"))
    both = matched(src, repeated_spans(src, length, gram), ["text_key"])

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            data, off = tk.column_bytes(b.column("text"))
            for i, j in tk.chunks(off):
                part = b.slice(i, j - i)
                raw, cuts = data[off[i] : off[j]], off[i : j + 1] - off[i]
                lists = part.column("spans")
                n = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
                flat = lists.flatten()
                base = np.repeat(cuts[:-1], n)
                edge = np.zeros(len(raw) + 1, dtype=np.int64)
                np.add.at(edge, base + np.asarray(flat.field("s")), 1)
                np.add.at(edge, base + np.asarray(flat.field("e")) + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                first = gone.copy()
                first[1:] &= ~gone[:-1]
                starts = cuts[:-1][np.diff(cuts) > 0]
                first[starts] = gone[starts]
                lost = np.concatenate([[0], np.cumsum(gone)])[cuts]
                count = np.concatenate([[0], np.cumsum(first)])[cuts]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(cuts)), pa.array(np.diff(lost)), pa.array(np.diff(count)), tk.binary_array(raw[~gone], cuts - lost)], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    out = both.select("id", "text", "spans").mapInArrow(cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(*released(id_col, keep), "n_bytes", "n_removed", "n_spans", "kept")
