"""N-gram Jaccard join with count vectors in an R-tree.

A document's set is its distinct five-word shingles.  Shingles are hashed into groups (``GROUPS``, and
more for large sets, one for five to ten members, since coarse counts of large sets all look alike)
and a set's counts by group are a point.  Groups are ranges of a hash, so a fine point folds to a
coarse one.  The overlap of two sets is at most the sum over coordinates of
the smaller count; an R-tree node, whose box has an upper corner, bounds all its points alike.  Pairs
that the bound leaves are verified on the sets themselves.

To search locally, points are first dealt to groups that keep every linked pair together: in any order
of all members, two sets with Jaccard 0.8 share one among the first fifth of their members (plus one),
so each point goes to one tree for each such member that occurs in at least two different sets.  The order is
by hash, with members that very many texts hold last; which those are is estimated from one text in
``SHARE``, as any order gives the same links.  A tree yields a spanning forest of its surviving pairs,
not the pairs.  The forests' components are clusters; every link lies inside one, and each cluster's sets
are compared exactly.  Clusters of more than ``BLOCK`` sets are split into blocks that share a few pivots,
and then whatever the pivots did not join is compared with every block.

Equal sets count once, wherever in the corpus they are. Sets are known by a 64-bit hash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemforge.llm import textkit as tk
from itemforge.llm.shared import SeedFilter, components, dealt, discard, key_filter, matched, pick, seed_filter, written

SHINGLE = 5
GROUPS = 32
MOST_GROUPS = 8192
PER_GROUP = 10
MOST = 15
NODE = 32
SMALL = 8
#: A member's points are dealt to blocks beyond this many; texts that hold a common member; share of texts looked at.
HOT_ROWS = 4000
COMMON = 40
SHARE = 16
BLOCK = 1024
BLOCK_MEMBERS = 300_000
PIVOTS = 8
SEEN = 1 << 18
AT_ONCE = 1 << 18
LAST = (1 << 63) - 1


class Sets:
    """Shingle sets of a range of rows: sorted hashes, offsets by row, set hash, size."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE):
        w = tk.Words(data, offsets, lower=True)
        rows = len(offsets) - 1
        grams = tk.gram_hash(w.hash, shingle)
        size = np.maximum(np.diff(w.offsets) - shingle + 1, 0)
        few = np.flatnonzero((np.diff(w.offsets) > 0) & (size == 0))
        size[few] = 1
        off = np.concatenate([[0], np.cumsum(size)])
        first = w.offsets[:-1].copy()
        h = np.empty(off[-1], dtype=np.uint64)
        many = np.ones(rows, dtype=bool)
        many[few] = False
        at = np.repeat(many, size)
        h[at] = grams[tk.spread(first[many], size[many])]
        for r in few:
            own = w.hash[w.offsets[r] : w.offsets[r + 1]]
            h[off[r]] = tk.mix(tk.gram_hash(own, len(own)) + np.uint64(len(own)))[0]
        for r in range(rows):
            h[off[r] : off[r + 1]].sort()
        new = np.ones(len(h), dtype=bool)
        new[1:] = h[1:] != h[:-1]
        new[off[:-1][size > 0]] = True
        self.hash = h[new]
        self.offsets = np.concatenate([[0], np.cumsum(new)])[off]
        self.size = np.diff(self.offsets)
        self.key = np.zeros(rows, dtype=np.uint64)
        full = np.flatnonzero(self.size)
        if len(full):
            total = np.add.reduceat(tk.mix(self.hash), self.offsets[full])
            self.key[full] = tk.mix(total + self.size[full].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def points(self) -> tuple[np.ndarray, np.ndarray]:
        """Counts by group of every set in 4 bits, ``MOST`` at most, one set after the other, and offsets in bytes."""
        bits = group_bits(self.size)
        off = np.concatenate([[0], np.cumsum(1 << bits)])
        row = np.repeat(np.arange(len(self.size)), self.size)
        group = (tk.mix(self.hash) >> (64 - bits[row]).astype(np.uint64)).astype(np.int64)
        n = np.bincount(off[row] + group, minlength=off[-1])
        n = np.minimum(n, MOST).astype(np.uint8)
        return n[0::2] << 4 | n[1::2], off // 2

    def prefix(self, similarity: tuple[int, int], common: SeedFilter | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The first members, of which linked sets share one, by hash with common ones last: flat, number by row."""
        a, b = similarity
        n = np.where(self.size > 0, self.size + (-a * self.size) // b + 1, 0)
        if common is None or not common.words.any():
            return self.hash[tk.spread(self.offsets[:-1], n)], n
        last = common.holds(self.hash)
        row = np.repeat(np.arange(len(self.size)), self.size)
        before = np.concatenate([[0], np.cumsum(~last)])
        rare = before[:-1] - before[self.offsets[:-1]][row]
        rares = (before[self.offsets[1:]] - before[self.offsets[:-1]])[row]
        place = np.where(last, rares + np.arange(len(row)) - self.offsets[:-1][row] - rare, rare)
        return self.hash[place < n[row]], n


def group_bits(size: np.ndarray) -> np.ndarray:
    """log2 of the number of groups for sets of a size."""
    least, most = GROUPS.bit_length() - 1, MOST_GROUPS.bit_length() - 1
    return np.clip(np.ceil(np.log2(np.maximum(size, 1) / PER_GROUP)), least, most).astype(np.int64)


def unpacked(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts from 4 bits each, and offsets."""
    out = np.empty(2 * len(raw), dtype=np.uint16)
    out[0::2], out[1::2] = raw >> 4, raw & 15
    return out, 2 * off


def folded(points: np.ndarray, groups: int) -> np.ndarray:
    """Points (one a row) with fewer groups."""
    return points.reshape(len(points), groups, -1).sum(2, dtype=np.int32)


def may_link(over: np.ndarray, total: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """Whether an overlap is enough: a/b of the union, so (a + b) * overlap >= a * sum of sizes."""
    a, b = similarity
    return (a + b) * over >= a * total


class Tree:
    """A packed R-tree of points with sizes; a node's box is told by its upper corner.

    What counts beyond ``MOST`` leave out, a set's size less its counts, may overlap with anything and is added
    to every bound.
    """

    def __init__(self, size: np.ndarray, corner: np.ndarray, similarity: tuple[int, int]):
        order = np.lexsort((corner[:, 0], corner[:, 1] // 4, size))
        self.order, self.similarity = order, similarity
        self.size, self.corner = size[order], corner[order]
        self.extra = self.size - self.corner.sum(1, dtype=np.int64)
        at = np.arange(0, len(order), NODE)
        self.node_low = np.minimum.reduceat(self.size, at)
        self.node_high = np.maximum.reduceat(self.size, at)
        self.node_corner = np.maximum.reduceat(self.corner, at, axis=0)
        self.node_extra = np.maximum.reduceat(self.extra, at)

    def search(self, size: int, q: np.ndarray, open_: np.ndarray) -> np.ndarray:
        """Places (in the input) of open points that may link with a point; ``open_`` is by place."""
        a, b = self.similarity
        extra = size - int(q.sum(dtype=np.int64))
        nodes = np.flatnonzero((b * self.node_high >= a * size) & (a * self.node_low <= b * size))
        nodes = nodes[may_link(np.minimum(self.node_corner[nodes], q).sum(1, dtype=np.int64) + self.node_extra[nodes] + extra, self.node_low[nodes] + size, self.similarity)]
        if not len(nodes):
            return nodes
        at = (nodes[:, None] * NODE + np.arange(NODE)).ravel()
        at = at[at < len(self.order)]
        at = at[open_[self.order[at]]]
        at = at[(b * self.size[at] >= a * size) & (a * self.size[at] <= b * size)]
        return self.order[at[may_link(np.minimum(self.corner[at], q).sum(1, dtype=np.int64) + self.extra[at] + extra, self.size[at] + size, self.similarity)]]


class Points:
    """Sets' sizes and points of several resolutions."""

    def __init__(self, size: np.ndarray, raw: np.ndarray, off: np.ndarray, similarity: tuple[int, int]):
        self.size, self.similarity = size, similarity
        self.groups = np.diff(off)
        self.extra = size - np.diff(np.concatenate([[0], np.cumsum(raw, dtype=np.int64)])[off])
        self.place = np.zeros(len(size), dtype=np.int64)
        self.by: dict[int, np.ndarray] = {}
        for g in np.unique(self.groups).tolist():
            rows = np.flatnonzero(self.groups == g)
            self.place[rows] = np.arange(len(rows))
            self.by[g] = raw[tk.spread(off[rows], self.groups[rows])].reshape(-1, g)

    def at(self, rows: np.ndarray, groups: int) -> np.ndarray:
        """Points of the rows, all of one resolution of their own, with so many groups."""
        g = int(self.groups[rows[0]])
        return folded(self.by[g][self.place[rows]], groups)

    def pairs(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the bound leaves each pair; it is taken at the coarser resolution of the two."""
        out = np.zeros(len(i), dtype=bool)
        tag = self.groups[i] * (2 * MOST_GROUPS) + self.groups[j]
        for t in np.unique(tag):
            own = np.flatnonzero(tag == t)
            g = int(min(self.groups[i[own[0]]], self.groups[j[own[0]]]))
            for k in range(0, len(own), max(1, (1 << 21) // g)):
                x = own[k : k + max(1, (1 << 21) // g)]
                over = np.minimum(self.at(i[x], g), self.at(j[x], g)).sum(1, dtype=np.int64) + self.extra[i[x]] + self.extra[j[x]]
                out[x] = may_link(over, self.size[i[x]] + self.size[j[x]], self.similarity)
        return out

    def forest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest of all pairs among the rows that may link.

        Sets that link have at most a factor of two between their groups: a tree of each resolution
        holds its own points and the folded ones of the next.
        """
        trees, where = {}, {}
        for g in sorted(set(self.groups[rows].tolist())):
            parts = [x for x in (rows[self.groups[rows] == h] for h in (g, 2 * g)) if len(x)]
            member = np.concatenate(parts)
            trees[g] = (member, Tree(self.size[member], np.concatenate([self.at(x, g) for x in parts]), self.similarity), np.ones(len(member), dtype=bool))
            for k, r in enumerate(member.tolist()):
                where.setdefault(r, []).append((g, k))
        a, b, done = [], [], set()

        def close(r: int) -> None:
            done.add(r)
            for g, k in where[r]:
                trees[g][2][k] = False

        for s in rows.tolist():
            if s in done:
                continue
            close(s)
            queue = [s]
            while queue:
                i = queue.pop()
                for g, _ in where[i]:
                    member, tree, open_ = trees[g]
                    got = member[tree.search(int(self.size[i]), self.at(np.array([i]), g)[0], open_)]
                    if g < self.groups[i]:
                        got = got[self.groups[got] == g]
                    for r in got.tolist():
                        close(r)
                        a.append(i), b.append(r)
                        queue.append(r)
        return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def exact_forest(sets: list[np.ndarray], similarity: tuple[int, int], queries: int | None = None) -> tuple[list[int], list[int]]:
    """A spanning forest of all linked pairs; with ``queries`` only pairs with one of the first sets are asked for."""
    a, b = similarity
    n = len(sets)
    size = np.array([len(x) for x in sets], dtype=np.int64)
    flat = np.concatenate(sets)
    _, token = np.unique(flat, return_inverse=True)
    token = token.astype(np.int32)
    off = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(int(token.max()) + 1, dtype=bool)
    left, right = [], []

    def linked(i: int, among: np.ndarray) -> np.ndarray:
        among = among[(b * size[among] >= a * size[i]) & (a * size[among] <= b * size[i])]
        if not len(among):
            return among
        own = token[off[i] : off[i + 1]]
        mark[own] = True
        out = []
        for x, y in tk.chunks(np.concatenate([[0], np.cumsum(size[among])]), AT_ONCE):
            some = among[x:y]
            hit = mark[token[tk.spread(off[some], size[some])]]
            over = np.add.reduceat(hit.astype(np.int32), np.cumsum(size[some]) - size[some])
            out.append(some[(a + b) * over.astype(np.int64) >= a * (size[some] + size[i])])
        mark[own] = False
        return np.concatenate(out)

    if queries is not None:
        for i in range(queries):
            for j in linked(i, np.arange(n)):
                if j != i:
                    left.append(i), right.append(int(j))
        return left, right
    open_ = np.ones(n, dtype=bool)
    for s in range(n):
        if not open_[s]:
            continue
        open_[s] = False
        queue = [s]
        while queue:
            i = queue.pop()
            got = linked(i, np.flatnonzero(open_))
            open_[got] = False
            left.extend([i] * len(got))
            right.extend(got.tolist())
            queue.extend(got.tolist())
    return left, right


def common_members(docs: DataFrame) -> SeedFilter:
    """A filter of the members that more than ``COMMON`` texts hold, by one text in ``SHARE``."""
    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(SHARE)) == 0)

    def members(batches):
        import pyarrow as pa

        known: set[int] = set()
        for b in batches:
            data, off = tk.column_bytes(b.column("text"))
            for i, j in tk.chunks(off):
                x = Sets(data[off[i] : off[j]], off[i : j + 1] - off[i])
                key, n = np.unique(x.hash[np.repeat(_fresh(x.key, known), x.size)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    counted = some.mapInArrow(members, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") * SHARE > COMMON)
    keys = written(counted.select("key"), "common")
    out = key_filter(keys, keys.count())
    discard(keys)
    return out


def sets_of(docs: DataFrame, similarity: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(ord, text_key, set_key, size) of each document, and one row of each set: with its point, its prefix, and the least document that has it."""
    common = common_members(docs)
    names = ["ord", "text_key", "set_key", "size", "point", "members"]

    def run(batches):
        import pyarrow as pa

        known: set[int] = set()
        for b in batches:
            data, off = tk.column_bytes(b.column("text"))
            for i, j in tk.chunks(off):
                x = Sets(data[off[i] : off[j]], off[i : j + 1] - off[i])
                m, fresh = j - i, _fresh(x.key, known)
                points, cut = x.points()
                flat, n = x.prefix(similarity, common)
                key = pa.array(x.key.view(np.int64), mask=x.size == 0)
                once = [pa.array(np.where(fresh, np.arange(m), 0), mask=~fresh)]
                heavy = [tk.binary_array(points, cut).take(once[0]), tk.binary_array(flat.view(np.uint8), 8 * np.concatenate([[0], np.cumsum(n)])).take(once[0])]
                yield pa.RecordBatch.from_arrays([b.column("ord").slice(i, m), b.column("text_key").slice(i, m), key, pa.array(x.size), *heavy], names)

    made = written(docs.select("ord", "text_key", "text").mapInArrow(run, "ord long, text_key long, set_key long, size long, point binary, members binary"), "sets")
    least = F.min(F.struct("ord", "text_key")).alias("m")
    each = made.where("set_key IS NOT NULL").groupBy("set_key").agg(least, F.first("size").alias("size"), F.first("point", True).alias("point"), F.first("members", True).alias("members"))
    one = written(each.select("set_key", "m.ord", "m.text_key", "size", "point", "members"), "one-of-each")
    members = written(made.select("ord", "text_key", "set_key", "size"), "members")
    discard(made)
    return members, one


def dealt_points(one: DataFrame) -> tuple[DataFrame, bool]:
    """(member, parts, set_key, size, point): a set's point for each member that it goes to, and whether any member is hot (several parts)."""

    def members(batches):
        import pyarrow as pa

        for b in batches:
            raw, _ = tk.column_bytes(b.column("members"))
            key, n = np.unique(raw.view(np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    wanted, hot = seed_filter(one.select("members").mapInArrow(members, "key long, n long"), "shingles", HOT_ROWS)

    def points(batches):
        import pyarrow as pa

        for b in batches:
            raw, off = tk.column_bytes(b.column("members"))
            flat = raw.view(np.uint64)
            row = np.repeat(np.arange(b.num_rows), np.diff(off) // 8)
            yes = wanted.holds(flat)
            flat, row = flat[yes], row[yes]
            size = np.diff(tk.column_bytes(b.column("point"))[1])
            for i, j in tk.chunks(np.concatenate([[0], np.cumsum(size[row] + 32)])):
                at = pa.array(row[i:j])
                yield pa.RecordBatch.from_arrays([pa.array(flat[i:j].view(np.int64)), *[b.column(c).take(at) for c in ("set_key", "size", "point")]], ["member", "set_key", "size", "point"])

    rows = one.select("set_key", "size", "point", "members").mapInArrow(points, "member long, set_key long, size long, point binary")
    return dealt(rows, hot, "member"), hot is not None


def _fresh(keys: np.ndarray, known: set[int]) -> np.ndarray:
    """Whether a task meets a set for the first time (as far as it remembers)."""
    out = np.zeros(len(keys), dtype=bool)
    for i, k in enumerate(keys.tolist()):
        if k not in known:
            known.add(k)
            out[i] = True
    if len(known) > SEEN:
        known.clear()
    return out


def candidate_edges(points: DataFrame, hot: bool, similarity: tuple[int, int]) -> DataFrame:
    """(a, b): spanning forests of the pairs that the bound leaves, enough to give their components.

    A hot member's points are dealt to blocks, each a tree, and a few pivots go to all of them.  Near copies
    are joined by the pivots; only what is not joined to most of a member's points goes to all its
    blocks then, so no task holds more than a block and that.
    """
    if not hot:
        return forests(points.select("member", F.lit(-1).cast("long").alias("salt"), "set_key", "size", "point"), similarity)
    points = written(points, "points")
    own, every = F.pmod(F.xxhash64("set_key"), F.col("parts")), F.expr("sequence(0L, parts - 1L)")
    pivot = F.pmod(F.xxhash64("set_key", F.lit(1)), F.greatest(F.lit(1), (F.col("parts") * (HOT_ROWS // 2) / PIVOTS).cast("long"))) == 0
    first = F.when(F.col("parts") == 1, F.array(F.lit(-1).cast("long"))).when(pivot, every).otherwise(F.array(own))
    edges = written(forests(points.select("member", F.explode(first).alias("salt"), "set_key", "size", "point"), similarity), "forests")
    root = components(edges, "pivots").withColumnRenamed("node", "set_key")
    large = points.where("parts > 1")
    joined = written(large.select("member", "set_key").join(root, "set_key", "left").select("member", "set_key", F.coalesce("root", "set_key").alias("root")), "hot-roots")
    main = joined.groupBy("member", "root").count().groupBy("member").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
    asked = written(joined.join(main, "member").where("root <> main").select("member", "set_key", F.lit(True).alias("asked")), "hot-asked")
    if asked.isEmpty():
        return edges
    some = large.join(asked.select("member").distinct(), "member", "left_semi").join(asked, ["member", "set_key"], "left")
    again = some.select("member", F.explode(F.when(F.col("asked"), every).otherwise(F.array(own))).alias("salt"), "set_key", "size", "point")
    return edges.union(forests(again, similarity))


def forests(points: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(a, b): a spanning forest of the pairs in each tree, (member, salt), that the bound leaves."""

    def forest(batches):
        import pyarrow as pa

        for held in tk.whole_groups(batches, ["member", "salt"], "point", 1 << 21):
            t = pa.Table.from_batches(held).combine_chunks()
            token, key, salt = np.asarray(t.column("member")), np.asarray(t.column("set_key")), np.asarray(t.column("salt"))
            order = np.lexsort((key, salt, token))
            token, key, salt = token[order], key[order], salt[order]
            new = np.ones(len(token), dtype=bool)
            new[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]) | (key[1:] != key[:-1])
            order, token, key, salt = order[new], token[new], key[new], salt[new]
            count = np.asarray(t.column("size"))[order]
            raw, off = unpacked(*tk.column_bytes(t.column("point")))
            length = np.diff(off)[order]
            x = Points(count, raw[tk.spread(off[order], length)], np.concatenate([[0], np.cumsum(length)]), similarity)
            head = np.ones(len(token), dtype=bool)
            head[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
            start = np.flatnonzero(head)
            size = np.diff(np.append(start, len(token)))
            group = np.repeat(np.arange(len(start)), size)
            small = (size <= SMALL)[group]
            p, q = similarity
            a, b = [], []
            for d in range(1, SMALL):
                i = np.flatnonzero(small[:-d] & (group[d:] == group[:-d])) if len(group) > d else np.empty(0, np.int64)
                i = i[(q * count[i + d] >= p * count[i]) & (q * count[i] >= p * count[i + d])]
                i = i[x.pairs(i, i + d)]
                a.append(i), b.append(i + d)
            for g in np.flatnonzero(size > SMALL):
                y, z = x.forest(np.arange(start[g], start[g] + size[g]))
                a.append(y), b.append(z)
            a = np.concatenate(a) if a else np.empty(0, np.int64)
            b = np.concatenate(b) if b else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key[a]), pa.array(key[b])], ["a", "b"])

    src = points.select("member", "salt", "set_key", "size", "point")
    return src.repartition("member", "salt").sortWithinPartitions("member", "salt").mapInArrow(forest, "a long, b long")


def verified_edges(docs: DataFrame, clusters: DataFrame, similarity: tuple[int, int], block: int) -> DataFrame:
    """(a, b): links enough to give the components. ``clusters``: (set_key, cluster, ord, text_key, size)."""
    sizes = clusters.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / BLOCK_MEMBERS)).cast("int").alias("blocks"), F.count("*").alias("sets"))
    placed = written(clusters.join(sizes, "cluster"), "clusters")
    own = F.pmod("set_key", "blocks").cast("int")

    def compare(queries: bool):
        def run(batches):
            import pyarrow as pa

            for parts in tk.whole_groups(batches, ["cluster", "block"], "text", 1 << 20):
                t = pa.Table.from_batches(parts).combine_chunks()
                data, off = tk.column_bytes(t.column("text"))
                cluster, at, key = np.asarray(t.column("cluster")), np.asarray(t.column("block")), np.asarray(t.column("set_key"))
                role = np.asarray(t.column("role"))
                x = Sets(data, off)
                order = np.lexsort((key, role, at, cluster))
                cut = np.flatnonzero((np.diff(cluster[order]) != 0) | (np.diff(at[order]) != 0)) + 1
                a, b = [], []
                for g in np.split(order, cut):
                    g = g[np.concatenate([[True], (np.diff(key[g]) != 0) | (np.diff(role[g]) != 0)])]
                    if len(g) < 2:
                        continue
                    sets = [x.hash[x.offsets[r] : x.offsets[r + 1]] for r in g]
                    i, j = exact_forest(sets, similarity, int((role[g] == 0).sum()) if queries else None)
                    a.append(key[g[i]]), b.append(key[g[j]])
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

        return run

    def texts(rows: DataFrame, queries: bool) -> DataFrame:
        got = matched(docs.select("ord", "text_key", "text"), rows, ["ord", "text_key"], inner=True)
        got = got.select("cluster", F.explode("at").alias("block"), "role", "set_key", "text")
        return got.repartition("cluster", "block").sortWithinPartitions("cluster", "block").mapInArrow(compare(queries), "a long, b long")

    if placed.where("blocks > 1").isEmpty():
        return written(texts(written(placed.select("ord", "text_key", "cluster", "set_key", F.array(F.lit(0)).alias("at"), F.lit(0).alias("role")), "placed"), False), "links")
    # pivots: the sets with the smallest hashes of their keys go to every block of their cluster
    large = placed.where("blocks > 1")
    pivot = large.where(F.pmod(F.xxhash64("set_key"), F.greatest(F.lit(1), F.ceil(F.col("sets") / PIVOTS))) == 0).select("set_key", F.lit(True).alias("pivot"))
    first = placed.join(pivot, "set_key", "left").select("ord", "text_key", "cluster", "set_key", F.when(F.col("pivot"), F.expr("sequence(0, blocks - 1)")).otherwise(F.array(own)).alias("at"), F.lit(0).alias("role"))
    links = written(texts(written(first, "placed"), False), "links")
    root = components(links, "blocks").withColumnRenamed("node", "set_key")
    joined = large.join(root, "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    main = joined.groupBy("cluster", "root").count().groupBy("cluster").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
    asked = joined.join(main, "cluster").where("root <> main")
    ask = asked.select("ord", "text_key", "cluster", "set_key", F.expr("sequence(0, blocks - 1)").alias("at"), F.lit(0).alias("role"))
    some = asked.select("cluster").distinct()
    all_ = large.join(some, "cluster", "left_semi").select("ord", "text_key", "cluster", "set_key", F.array(own).alias("at"), F.lit(1).alias("role"))
    return links.union(written(texts(written(ask.union(all_), "asked"), True), "more-links"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns by which a document is known: its id (null ones last) and a hash of its text."""
    return docs.select("*", F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("ord"), F.xxhash64(text_col).alias("text_key"))


def grouped(docs: DataFrame, similarity: tuple[int, int], block: int, id_col: str, text_col: str) -> DataFrame:
    """(ord, text_key, size, root, least): every row's group and the smallest (ord, text_key) in it; a written table."""
    src = keyed(pick(docs, id_col, text_col).toDF("id", "text"), "id", "text").select("ord", "text_key", F.col("text").cast("binary").alias("text"))
    members, one = sets_of(src, similarity)
    near = components(candidate_edges(*dealt_points(one), similarity), "near").select(F.col("node").alias("set_key"), F.col("root").alias("cluster"))
    clusters = written(near.join(one.select("set_key", "ord", "text_key", "size"), "set_key").select("set_key", "cluster", "ord", "text_key", "size"), "near-sets")
    discard(one)
    root = components(verified_edges(src, clusters, similarity, block), "links").withColumnRenamed("node", "set_key")
    whole = written(members.join(root, "set_key", "left").select("ord", "text_key", "size", F.coalesce("root", "set_key").alias("root")), "grouped")
    discard(clusters)
    least = whole.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("ord", "text_key")).alias("least"))
    return whole.join(least, "root", "left").select("ord", "text_key", "size", "root", F.coalesce("least", F.struct("ord", "text_key")).alias("least"))


def near_duplicate_groups(docs: DataFrame, similarity: tuple[int, int] = (4, 5), block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): component_id is the smallest id reachable by links.

    Words are lower-cased (A-Z). A document with fewer words than a shingle has its whole sequence
    as the one member; null and empty texts have an empty set and link with nothing. Rows with equal
    sets link. Null ids count as larger than all others and are returned as they are; repeated ids
    are rows of their own. ``id_col`` holds integers; further columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def out(name: str, alias: str):
        return F.expr(f"nullif({name}, {LAST}L)").cast(kind).alias(alias)

    groups = grouped(docs, similarity, block, id_col, text_col)
    return groups.select(out("ord", id_col), F.col("size").alias("n_shingles"), out("least.ord", "component_id"))


def drop_near_duplicates(docs: DataFrame, similarity: tuple[int, int] = (4, 5), block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all their columns, less all but one of each group of near duplicates.

    The one with the smallest id stays (with repeated ids, the one whose text has the smaller hash);
    of rows equal in id and text one stays. Documents without a word stay.
    """
    groups = written(grouped(docs, similarity, block, id_col, text_col), "groups")
    stay = groups.where(F.struct("ord", "text_key") == F.col("least"))
    stay = written(stay.groupBy("ord", "text_key").agg(F.count("*").alias("rows")), "stay")
    whole = keyed(docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    kept = matched(whole, stay, ["ord", "text_key"], inner=True)
    once = kept.where("rows = 1").select("row")
    if not stay.where("rows > 1").isEmpty():
        once = once.union(kept.where("rows > 1").groupBy("ord", "text_key").agg(F.first("row").alias("row")).select("row"))
    return once.select("row.*")
