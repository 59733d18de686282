"""SimHash fingerprints and all pairs within a few bits, by a Gray-order hierarchical index.

Fingerprints within k bits agree in at least one of k + 1 segments of their bits, so each distinct
fingerprint is routed by each of its segments, and a pair is found where it agrees. Inside a route
fingerprints are sorted by Gray rank; runs of neighbours form nodes that hold the bits all of them
share, upper nodes take over what their children share, and a search adds up differences on the way
down and leaves a node as soon as they exceed k.

Links can be asked to hold for the texts instead: then two texts are linked if their shingle sets are
similar enough, which is always counted on the sets. Pairs to count come from two sides: the index,
where a sketch of one smallest hash per bin agrees, and shared rare shingles. Similar sets have a
shingle in common among the first of each in any order common to all sets (a prefix); the rarest go
first, so that few other texts share them. The second side finds every pair; the first, and pairs of
neighbours, connect large groups beforehand, so that pairs inside them needn't be counted."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from flowlab.llm.frames import components, partitions_for, removed, short_shuffles, stored
from flowlab.llm.text import LOWER, SPACE, U64, buffer_of, mix, slices, words_in
from flowlab.tables import ship, unpack

P1, P2, P3, P4, P5 = (U64(p) for p in (  # fixed values of XXH64
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
FINGERPRINTS = "doc_id long, fp long, sketch binary, node long, size int"
# Bins of a sketch, one byte each; zero stands for an empty bin.
BINS = 256
# Fan-out of index nodes, rows that a routing task gets, and the size from which a route is split.
FAN, TASK_ROWS, HOT = 16, 1 << 15, 1 << 16
PAIRS_AT_ONCE, SKETCHES_AT_ONCE = 1 << 16, 1 << 14
# Least and most buckets (as powers of two) in which shingles are counted to tell rare ones, and
# shingles a bucket; they steer the work only. Buckets of a piece that is added up in one task.
RARITY_BITS, RARITY_SHARE, RARITY_PIECE = (16, 23), 16, 1 << 16
# Prefix rows that a task gets, without and with their sketches; bits of a filter per wanted set, most bits
# (as a power of two), and bits of a piece of it.
PREFIX_ROWS, SKETCHED_ROWS, FILTER_BITS, MOST_BITS, FILTER_PIECE = 1 << 19, 1 << 17, 16, 31, 1 << 19
# Rounds in which a token may give forests of its likely pairs before all that are left are looked at, how
# many pairs a row a token gives at once, and forests of a token that has more.
MATCHINGS, PAIRS_LEFT, FORESTS = 8, 4, 2
# A round is followed by another if at least one in so many of its pairs is similar.
WORTHWHILE = 50
POSTINGS = "token long, node long, size int, place int"


def _rotl(x, r):
    return x << U64(r) | x >> U64(64 - r)


def xxh64_spans(data, starts, sizes, seed=42):
    """XXH64 of many spans of a byte array at once."""
    padded = np.zeros(len(data) + 40, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 32, "<u8", padded, strides=(1,))
    four = np.ndarray(len(data) + 32, "<u4", padded, strides=(1,))
    seed = U64(seed)
    h = np.full(len(starts), seed + P5, U64)
    at, left = starts.astype(np.int64), sizes.astype(np.int64)

    def lane(acc, word):
        return _rotl(acc + word * P2, 31) * P1

    if (big := np.flatnonzero(sizes >= 32)).size:
        lanes = [(int(seed) + x) & (1 << 64) - 1 for x in (int(P1) + int(P2), int(P2), 0, -int(P1))]
        v = [np.full(len(big), x, U64) for x in lanes]
        live, pos, rest = np.arange(len(big)), at[big].copy(), left[big].copy()
        while live.size:
            for k in range(4):
                v[k][live] = lane(v[k][live], eight[pos[live] + 8 * k])
            pos[live] += 32
            rest[live] -= 32
            live = live[rest[live] >= 32]
        whole = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
        for k in range(4):
            whole = (whole ^ lane(U64(0), v[k])) * P1 + P4
        h[big] = whole
        at[big], left[big] = pos, rest
    h += sizes.astype(U64)
    for _ in range(3):
        i = np.flatnonzero(left >= 8)
        if not i.size:
            break
        h[i] = _rotl(h[i] ^ lane(U64(0), eight[at[i]]), 27) * P1 + P4
        at[i] += 8
        left[i] -= 8
    i = np.flatnonzero(left >= 4)
    h[i] = _rotl(h[i] ^ four[at[i]].astype(U64) * P1, 23) * P2 + P3
    at[i] += 4
    left[i] -= 4
    for _ in range(3):
        i = np.flatnonzero(left > 0)
        if not i.size:
            break
        h[i] = _rotl(h[i] ^ padded[at[i]].astype(U64) * P5, 11) * P1
        at[i] += 1
        left[i] -= 1
    h = (h ^ h >> U64(33)) * P2
    h = (h ^ h >> U64(29)) * P3
    return h ^ h >> U64(32)


def shingle_hashes(column, width):
    """Hashes of the word shingles of each text and how many it has (none without words)."""
    data, offsets = buffer_of(column)
    data = LOWER[data]
    starts, ends, counts = words_in(data, offsets)
    size = ends - starts
    # words joined by single blanks: each byte moves by the number of words before its own
    place = np.cumsum(size + 1) - size - 1
    joined = np.full(int((size + 1).sum()), 32, np.uint8)
    joined[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = data[~SPACE[data]]
    n = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    first = np.repeat(np.cumsum(counts) - counts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    last = first + np.repeat(np.minimum(counts, width), n) - 1
    begin = place[first]
    return xxh64_spans(joined, begin, place[last] + size[last] - begin), n


def shingle_sets(column, width):
    """Sorted distinct shingle hashes of each text, how many it has, and a hash that names the set."""
    h, n = shingle_hashes(column, width)
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, n = h[fresh], np.bincount(row[fresh], minlength=len(n))
    ends = np.cumsum(n)
    names = [xxhash.xxh64_intdigest(h[e - k: e].tobytes()) for e, k in zip(ends, n)]
    return h, n, np.array(names, U64).view(np.int64)


def sketches(h, n):
    """One smallest hash per bin of each text's shingle hashes, cut to a byte."""
    row = np.repeat(np.arange(len(n)), n)
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(row[order] * BINS + (h[order] & U64(BINS - 1)).astype(np.int64), kind="stable")]
    key = row[order] * BINS + (h[order] & U64(BINS - 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(key, prepend=-1))
    out = np.zeros((len(n), BINS), np.uint8)
    out.reshape(-1)[key[first]] = h[order[first]] % U64(255 * BINS) // U64(BINS) + U64(1)
    return out


def similarity(drawn, i, j):
    """Estimated share of common shingles of pairs of sketches; two texts without words are equal."""
    out = np.empty(len(i))
    for k in range(0, len(i), SKETCHES_AT_ONCE):
        a, b = drawn[i[k: k + SKETCHES_AT_ONCE]], drawn[j[k: k + SKETCHES_AT_ONCE]]
        either = ((a | b) > 0).sum(1)
        out[k: k + len(a)] = np.where(either == 0, 1.0, ((a == b) & (a > 0)).sum(1) / np.maximum(either, 1))
    return out


def fingerprints(docs, width=3, sketch_width=None):
    """doc_id and the 64-bit fingerprint of every text: a bit is set if it is in more than half of
    the shingle hashes. Texts without words, and null ones, have fingerprint zero. With
    ``sketch_width`` there are also a sketch, the name and the size of the set of shingles of that
    many words."""
    def work(batches):
        for batch in batches:
            for first, texts in slices(batch.column("text")):
                h, n = shingle_hashes(texts, width)
                fp = np.zeros(len(texts), U64)
                there = np.flatnonzero(n)
                if len(there):
                    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    total = np.add.reduceat(bits, (np.cumsum(n) - n)[there], axis=0, dtype=np.int64)
                    fp[there] = np.packbits(2 * total > n[there, None], axis=1, bitorder="little").view("<u8")[:, 0]
                sketch = name = size = [None] * len(texts)
                if sketch_width:
                    h, size, name = shingle_sets(texts, sketch_width)
                    sketch = [x.tobytes() for x in sketches(h, size)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(texts)), pa.array(fp.view(np.int64)),
                     pa.array(sketch, pa.binary()), pa.array(name, pa.int64()), pa.array(size, pa.int32())],
                    names=["doc_id", "fp", "sketch", "node", "size"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, FINGERPRINTS)


def gray_rank(x):
    """Position of a bit pattern in the reflected Gray code."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> U64(shift)
    return x


class GrayIndex:
    """Tree over fingerprints in Gray order; ``order`` maps its positions to the given ones."""

    def __init__(self, fps, fan=FAN):
        self.order = np.argsort(gray_rank(fps), kind="stable")
        self.leaves = fps[self.order]
        self.fan, self.levels = fan, []
        ones = zeros = None
        low, high = self.leaves, self.leaves  # bits set in all / in any row below a node
        while len(low) > 1:
            cut = np.arange(0, len(low), fan)
            low, high = np.bitwise_and.reduceat(low, cut), np.bitwise_or.reduceat(high, cut)
            self.levels.append((~(low ^ high), low))
        self.levels.reverse()
        # a node keeps only what its parent doesn't already hold
        self.nodes, above = [], None
        for shared, value in self.levels:
            own = shared if above is None else shared & ~np.repeat(above, fan)[: len(shared)]
            self.nodes.append((own, value))
            above = shared
        self.above = above

    def pairs(self, most, must=U64(0)):
        """Yield arrays (i, j), i < j in Gray order, of rows within ``most`` bits that agree in ``must``."""
        n = len(self.leaves)
        step = max(1, PAIRS_AT_ONCE // FAN)
        for a in range(0, n, step):
            yield from self._search(np.arange(a, min(a + step, n)), most, must)

    def _search(self, query, most, must):
        if not self.nodes:
            return
        frontier = [(query, np.zeros(len(query), np.int64), np.zeros(len(query), np.uint8), 0)]
        while frontier:
            q, node, spent, level = frontier.pop()
            if len(q) > PAIRS_AT_ONCE:  # depth first, so that little waits
                half = len(q) // 2
                frontier += [(q[:half], node[:half], spent[:half], level), (q[half:], node[half:], spent[half:], level)]
                continue
            if level < len(self.nodes):
                own, value = self.nodes[level]
                diff = (self.leaves[q] ^ value[node]) & own[node]
                total = spent + np.bitwise_count(diff)
                # rows of a node stand in one run, so a node before the query has only earlier rows
                keep = (total <= most) & ((diff & must) == 0) & ((node + 1) * self.fan ** (len(self.nodes) - level) > q)
                q, node, spent = q[keep], node[keep], total[keep]
            if not len(q):
                continue
            size = len(self.nodes[level + 1][0]) if level + 1 < len(self.nodes) else len(self.leaves)
            child = (node[:, None] * self.fan + np.arange(self.fan)).reshape(-1)
            q, spent = np.repeat(q, self.fan), np.repeat(spent, self.fan)
            keep = child < size
            q, child, spent = q[keep], child[keep], spent[keep]
            if level + 1 < len(self.nodes):
                frontier.append((q, child, spent, level + 1))
                continue
            diff = (self.leaves[q] ^ self.leaves[child]) & ~self.above[child // self.fan]
            keep = (child > q) & (spent + np.bitwise_count(diff) <= most) & ((diff & must) == 0)
            if keep.any():
                yield q[keep], child[keep]


def forest(index, most, must, agree=None):
    """Links that connect what all pairs within ``most`` bits connect: at most one per row, as two
    arrays of positions. ``agree(i, j)`` can turn pairs down; pairs already connected aren't asked."""
    root = np.arange(len(index.leaves))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in index.pairs(most, must):
        if agree is not None:
            apart = np.flatnonzero(root[i] != root[j])
            i, j = i[apart], j[apart]
            good = agree(index.order[i], index.order[j])
            i, j = i[good], j[good]
        while True:
            a, b = root[i], root[j]
            apart = np.flatnonzero(a != b)
            if not len(apart):
                break
            pairs = np.unique(np.stack([np.minimum(a, b)[apart], np.maximum(a, b)[apart]], 1), axis=0)
            for x, y in pairs.tolist():
                x, y = find(x), find(y)
                if x != y:
                    root[max(x, y)] = min(x, y)
            while (root[root] != root).any():
                root = root[root]
    tied = np.flatnonzero(root != np.arange(len(root)))
    return index.order[root[tied]], index.order[tied]


def _segments(mask, parts):
    """Cut the set bits of a mask into nearly equal runs."""
    bits = [b for b in range(64) if mask >> b & 1]
    cut = [round(len(bits) * k / parts) for k in range(parts + 1)]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(cut, cut[1:])]


def _signed(mask):
    return mask - (1 << 64) if mask >> 63 else mask


def _routes(nodes, masks):
    """A row per node and mask: the route is the mask and the fingerprint's bits under it."""
    return nodes.select("node", "fp", "sketch", F.explode(F.array(*[
        F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits"))
        for m in masks])).alias("r")).select("node", "fp", "sketch", "r.mask", "r.bits")


def near_links(nodes, most=3, similar=None):
    """Links (u, v) whose components are those of all pairs of ``nodes`` (node, fp, sketch; each node
    once) within ``most`` bits and, if asked, with sketches that similar. A route that many nodes
    share is split again by segments of the other bits, which loses nothing: within the route, too,
    close pairs agree in one of ``most`` + 1 segments."""
    every = (1 << 64) - 1
    masks = _segments(every, most + 1)
    nodes = stored(nodes.select("node", "fp", "sketch"), "nodes")
    tasks = max(1, -(-nodes.count() * (most + 1) // TASK_ROWS))
    routed = _routes(nodes, masks)
    sizes = routed.groupBy("mask", "bits").agg(F.count(F.lit(1)).alias("n"))
    hot = stored(sizes.where(F.col("n") > HOT).drop("n"), "hot")
    if hot.isEmpty():
        return _linked(routed, most, similar, tasks)
    finer = None
    for mask in masks:
        own = routed.join(hot, ["mask", "bits"]).where(F.col("mask") == _signed(mask))
        part = _routes(own, [mask | m for m in _segments(every & ~mask, most + 1)])
        finer = part if finer is None else finer.union(part)
    cold = routed.join(hot, ["mask", "bits"], "left_anti")
    return _linked(cold, most, similar, tasks).union(_linked(finer, most, similar, tasks * (most + 1)))


def _linked(routed, most, similar, tasks):
    def work(batches):
        columns, drawn = [[], [], []], []
        for batch in batches:
            for column, name in zip(columns, ("mask", "fp", "node")):
                column.append(np.asarray(batch.column(name)))
            if similar is not None:
                drawn += [np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column("sketch")]
        if not columns[0]:
            return
        mask, fp, node = map(np.concatenate, columns)
        mask, fp = mask.view(U64), fp.view(U64)
        drawn = np.stack(drawn) if drawn else None
        for m in np.unique(mask):
            at = np.flatnonzero(mask == m)
            index = GrayIndex(_led(fp[at], m))
            agree = None if similar is None else (
                lambda i, j, at=at: similarity(drawn, at[i], at[j]) >= similar)
            u, v = forest(index, most, _led(np.array([m]), m)[0], agree)
            yield pa.RecordBatch.from_arrays([pa.array(node[at[x]]) for x in (u, v)], names=["u", "v"])

    if similar is None:
        routed = routed.withColumn("sketch", F.lit(None).cast("binary"))
    return routed.repartition(tasks, "mask", "bits").mapInArrow(work, "u long, v long").distinct()


def _led(x, mask):
    """Rotate so that the mask's top bit leads: equal bits under a mask are then neighbours in Gray order."""
    r = _turn(mask)
    return _rotl(x, r) if r else x.copy()


def _turn(mask):
    return (64 - int(mask).bit_length()) % 64


# ---- pairs of texts with similar shingle sets

def _fresh_sets(batches, width):
    """Shingle sets of the texts of a task, (hashes, sizes, names), each set once."""
    seen = set()
    for batch in batches:
        for _, texts in slices(batch.column("text")):
            h, n, names = shingle_sets(texts, width)
            new = np.zeros(len(n), bool)
            for k, name in enumerate(names.tolist()):
                if n[k] and name not in seen:
                    seen.add(name)
                    new[k] = True
            yield h[np.repeat(new, n)], n[new], names[new]


def _rarity(docs, width, shingles):
    """Counts of shingles by bucket, and the shift from a hash to its bucket."""
    bits = min(max(int(shingles // RARITY_SHARE).bit_length(), RARITY_BITS[0]), RARITY_BITS[1])
    shift = U64(64 - bits)

    def count(batches):
        total = np.zeros(1 << bits, np.int64)
        for h, _, _ in _fresh_sets(batches, width):
            bucket, n = np.unique(h >> shift, return_counts=True)
            total[bucket] += n
        counts = np.minimum(total, 65535).astype("<u2")
        for piece, at in enumerate(range(0, len(counts), RARITY_PIECE)):
            packed = pa.compress(counts[at: at + RARITY_PIECE].tobytes(), codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([packed])], names=["piece", "counts"])

    def add_up(rows):
        import pandas as pd

        total = np.zeros(RARITY_PIECE, np.int64)
        for packed in rows["counts"]:
            total += np.frombuffer(pa.decompress(packed, 2 * RARITY_PIECE, codec="zstd", asbytes=True), "<u2")
        return pd.DataFrame({"piece": rows["piece"].iloc[:1], "counts": [np.minimum(total, 65535).astype("<u2").tobytes()]})

    parts = docs.select("text").mapInArrow(count, "piece int, counts binary").groupBy("piece").applyInPandas(
        add_up, "piece int, counts binary").collect()
    counts = np.zeros(1 << bits, np.uint16)
    for r in parts:
        counts[r["piece"] * RARITY_PIECE: (r["piece"] + 1) * RARITY_PIECE] = np.frombuffer(r["counts"], "<u2")
    return counts, shift


def _columns(batches, names):
    got = [[] for _ in names]
    for batch in batches:
        for column, name in zip(got, names):
            column.append(np.asarray(batch.column(name)))
    return [np.concatenate(column) for column in got] if got[0] else None


def postings(docs, width, similar, shingles):
    """A stored table (token, node, size, place) of the prefixes of all shingle sets: a set's rarest
    shingles, as many that sets this similar must share one. Tokens of a single set are left out."""
    shipped = ship(docs.sparkSession, _rarity(docs, width, shingles))

    def prefixes(batches):
        counts, shift = unpack(shipped)
        for h, n, names in _fresh_sets(batches, width):
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((h, counts[h >> shift], row))
            place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            keep = place < np.repeat(n - np.ceil(similar * n - 1e-9).astype(np.int64) + 1, n)
            at = row[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[order][keep].view(np.int64)), pa.array(names[at]), pa.array(n[at].astype(np.int32)),
                 pa.array(place[keep].astype(np.int32))], names=["token", "node", "size", "place"])

    def shared(batches):
        columns = _columns(batches, ["token", "node", "size", "place"])
        if columns is None:
            return
        order = np.lexsort((columns[1], columns[0]))
        token, node, size, place = (x[order] for x in columns)
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, node, size, place = token[new], node[new], size[new], place[new]
        same = np.zeros(len(token) + 1, bool)
        same[1:-1] = token[1:] == token[:-1]
        keep = same[1:] | same[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (token, node, size, place)],
                                         names=["token", "node", "size", "place"])

    tasks = max(partitions_for(docs.sparkSession), int(shingles * (1 - similar)) // PREFIX_ROWS)
    return stored(docs.select("text").mapInArrow(prefixes, POSTINGS).repartition(tasks, "token")
                  .mapInArrow(shared, POSTINGS), "postings")


def _possible(i, j, size, place, similar):
    """Which pairs of posting rows of a token have sets that can be similar: by their sizes, and by what is
    left of both behind the token, if it is the first that they share."""
    least = np.ceil(similar / (1 + similar) * (size[i] + size[j]) - 1e-9)
    keep = np.minimum(size[i] - place[i], size[j] - place[j]) >= least
    return keep & (np.minimum(size[i], size[j]) >= similar * np.maximum(size[i], size[j]) - 1e-9)


def _distinct_pairs(i, j, node, root=None):
    """Pairs of posting rows as distinct pairs of nodes, with their roots if given, the smaller node first."""
    i, j = np.where(node[i] < node[j], i, j), np.where(node[i] < node[j], j, i)
    columns = [node[i], node[j]] if root is None else [node[i], node[j], root[i], root[j]]
    return np.unique(np.stack(columns, 1), axis=0).T


def _posted_pairs(table, similar, tasks):
    """Distinct pairs (u, v) of neighbours by size among the rows of a token that can be similar."""
    def work(batches):
        columns = _columns(batches, ["token", "node", "size", "place"])
        if columns is None:
            return
        order = np.lexsort((columns[1], columns[2], columns[0]))
        token, node, size, place = (x[order].astype(np.int64) for x in columns)
        i = np.flatnonzero(token[1:] == token[:-1])
        i = i[_possible(i, i + 1, size, place, similar)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in _distinct_pairs(i, i + 1, node)], names=["u", "v"])

    return table.repartition(tasks, "token").mapInArrow(work, "u long, v long").distinct()


def _apart_pairs(apart, drawn, similar, every):
    """Distinct pairs (u, v, u_root, v_root, more) that share a token, have different roots, and that neither
    sizes and places nor sketches prove too unlike. A token with more than ``PAIRS_LEFT`` of them a row only
    gives forests of those that look most alike, and sets ``more``, so that no group gives more pairs than a
    few for each of its rows; with ``every`` it gives all."""
    tasks = max(partitions_for(apart.sparkSession), apart.count() // SKETCHED_ROWS)
    names = ["token", "node", "size", "place", "root"]

    def work(batches):
        columns, sketch = [[] for _ in names], []
        for batch in batches:
            for column, name in zip(columns, names):
                column.append(np.asarray(batch.column(name)).astype(np.int64))
            sketch.append(np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS))
        if not sketch:
            return
        columns, sketch = [np.concatenate(c) for c in columns], np.concatenate(sketch)
        order = np.lexsort((columns[1], columns[4], columns[0]))
        (token, node, size, place, root), sketch = (c[order] for c in columns), sketch[order]
        # partners of a row stand behind the run of its root, up to the end of its token
        cut = token[1:] != token[:-1]
        start = _run_ends(cut | (root[1:] != root[:-1]))
        n = _run_ends(cut) - start
        group = np.cumsum(np.append(0, cut))
        first = np.flatnonzero(np.append(True, cut))
        rows = np.diff(np.append(first, len(token)))

        def likely(a, b):
            i = np.repeat(np.arange(a, b), n[a:b])
            j = np.arange(len(i)) - np.repeat(np.cumsum(n[a:b]) - n[a:b], n[a:b]) + np.repeat(start[a:b], n[a:b])
            keep = _possible(i, j, size, place, similar)
            i, j = i[keep], j[keep]
            keep = _alike(sketch, i, j, size[i] + size[j], similar)
            return i[keep], j[keep]

        def batch_of(i, j, more):
            pairs = _distinct_pairs(i, j, node, root)
            return pa.RecordBatch.from_arrays([*(pa.array(c) for c in pairs), pa.array(np.full(pairs.shape[1], more))],
                                              names=["u", "v", "u_root", "v_root", "more"])

        i, j = np.empty(0, np.int64), np.empty(0, np.int64)
        large = np.zeros(len(rows), bool)
        for a, b in _runs_of(n, 4 * PAIRS_AT_ONCE):
            x, y = likely(a, b)
            if every:
                yield batch_of(x, y, False)
                continue
            i, j = np.append(i, x), np.append(j, y)
            large |= np.bincount(group[i], minlength=len(rows)) > PAIRS_LEFT * rows
            # of tokens whose rows are all there the pairs go; a large token keeps forests only
            over = large[group[i]]
            kept = np.flatnonzero(over)[_forests(root[i[over]], root[j[over]], similarity(sketch, i[over], j[over]))]
            done = np.ones(len(i), bool) if b == len(token) else group[i] < group[b]
            forest = np.zeros(len(i), bool)
            forest[kept] = True
            yield batch_of(i[done & ~over], j[done & ~over], False)
            yield batch_of(i[done & forest], j[done & forest], True)
            wait = ~done & (forest | ~over)
            i, j = i[wait], j[wait]

    sketched = apart.join(drawn.select("node", "sketch"), "node").select(*names, "sketch")
    return sketched.repartition(tasks, "token").mapInArrow(
        work, "u long, v long, u_root long, v_root long, more boolean").groupBy("u", "v", "u_root", "v_root").agg(
        F.max("more").alias("more"))


def _runs_of(n, most):
    """Ranges of rows with about ``most`` of ``n`` together, a row at least."""
    total, a = np.cumsum(n), 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def _forests(a, b, weight):
    """Places of the edges of a heaviest forest between the nodes ``a`` and ``b``, then of one of what is left,
    up to ``FORESTS`` in all."""
    names, ends = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), return_inverse=True)
    ends, order = ends.reshape(2, -1), np.argsort(-weight, kind="stable")
    # of the edges between the same two nodes only the heaviest can be in a forest
    order = order[np.sort(np.unique(ends[0][order] * len(names) + ends[1][order], return_index=True)[1])]
    taken = []
    for _ in range(FORESTS):
        root, left = list(range(len(names))), []

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for at, x, y in zip(order.tolist(), ends[0][order].tolist(), ends[1][order].tolist()):
            x, y = find(x), find(y)
            if x == y:
                left.append(at)
            else:
                root[x] = y
                taken.append(at)
        order = np.array(left, np.int64)
    return np.array(taken, np.int64)


def _run_ends(cut):
    """For each row the end of its run, when runs end where ``cut`` is set."""
    ends = np.append(np.flatnonzero(cut) + 1, len(cut) + 1)
    return ends[np.searchsorted(ends, np.arange(len(cut) + 1), "right")]


def _filter(nodes):
    """Bits set at the leading bits of every node's mixed number, and how many bits lead: what isn't set
    there is surely none of the nodes. The size follows the nodes, up to 2**MOST_BITS bits."""
    bits = min(max((FILTER_BITS * max(nodes.count(), 1)).bit_length(), 20), MOST_BITS)
    shift = U64(64 - bits)

    def work(batches):
        pieces = {}
        for batch in batches:
            at = mix(np.asarray(batch.column("node")).view(U64)) >> shift
            for piece in np.unique(at // U64(FILTER_PIECE)).tolist():
                own = pieces.setdefault(piece, np.zeros(FILTER_PIECE, bool))
                own[(at[at // U64(FILTER_PIECE) == piece] % U64(FILTER_PIECE)).astype(np.int64)] = True
        packed = [pa.compress(np.packbits(p).tobytes(), codec="zstd", asbytes=True) for p in pieces.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.int32()), pa.array(packed, pa.binary())], names=["piece", "bits"])

    def either(rows):
        import pandas as pd

        total = np.zeros(FILTER_PIECE // 8, np.uint8)
        for packed in rows["bits"]:
            total |= np.frombuffer(pa.decompress(packed, FILTER_PIECE // 8, codec="zstd", asbytes=True), np.uint8)
        return pd.DataFrame({"piece": rows["piece"].iloc[:1], "bits": [pa.compress(total.tobytes(), codec="zstd", asbytes=True)]})

    out = np.zeros((1 << bits) // 8, np.uint8)
    # an iterator outlives its query, and shuffle files may go with the query
    packed = stored(nodes.mapInArrow(work, "piece int, bits binary").groupBy("piece").applyInPandas(either, "piece int, bits binary"), "filter")
    for r in packed.toLocalIterator():
        at = r["piece"] * FILTER_PIECE // 8
        out[at: at + FILTER_PIECE // 8] = np.frombuffer(pa.decompress(bytes(r["bits"]), FILTER_PIECE // 8, codec="zstd", asbytes=True), np.uint8)
    removed(nodes.sparkSession, packed)
    return out, shift


def _sets(docs, nodes, width):
    """A stored table (node, hashes) of the shingle sets of some nodes (a stored table, each once)."""
    shipped = ship(docs.sparkSession, _filter(nodes))

    def work(batches):
        bits, shift = unpack(shipped)
        for h, n, names in _fresh_sets(batches, width):
            at = mix(names.view(U64)) >> shift
            keep = (bits[(at >> U64(3)).astype(np.int64)] >> (U64(7) - (at & U64(7))).astype(np.uint8) & 1).astype(bool)
            offsets = np.append(0, np.cumsum(n[keep])).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[keep]), pa.ListArray.from_arrays(
                    pa.array(offsets), pa.array(h[np.repeat(keep, n)].view(np.int64)))], names=["node", "hashes"])

    sets = docs.select("text").mapInArrow(work, "node long, hashes array<long>").join(nodes, "node", "left_semi")
    return stored(sets.groupBy("node").agg(F.first("hashes").alias("hashes")), "sets")


def _alike(drawn, i, j, both, similar):
    """Which pairs of sketches don't prove their sets too unlike: a bin whose smallest hashes differ has a
    shingle that only one of both sets has, and bins share no shingles, so sets of a and b shingles with d
    such bins have at most (a + b - d) / (a + b + d) in common. ``both`` is a + b."""
    d = np.zeros(len(i), np.int64)
    for k in range(0, len(i), SKETCHES_AT_ONCE):
        d[k: k + SKETCHES_AT_ONCE] = (drawn[i[k: k + SKETCHES_AT_ONCE]] != drawn[j[k: k + SKETCHES_AT_ONCE]]).sum(1)
    return both - d >= similar * (both + d) - 1e-9


def _likely(pairs, drawn, similar):
    """Pairs without those that the sketches prove too unlike. ``drawn`` has the nodes' sketch and size."""
    def work(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("a", "b"))
            at = np.arange(batch.num_rows)
            yield batch.select(kept).filter(pa.array(
                _alike(np.concatenate([a, b]), at, at + len(at), np.asarray(batch.column("both")), similar)))

    left, right = (drawn.select(F.col("node").alias(x), F.col("sketch").alias(y), F.col("size").alias(f"_{x}")) for x, y in ("ua", "vb"))
    kept = pairs.columns
    joined = pairs.join(left, "u").join(right, "v").select(*kept, "a", "b", (F.col("_u") + F.col("_v")).cast("long").alias("both"))
    return joined.mapInArrow(work, pairs.schema)


def _similar_pairs(pairs, sets, similar):
    """A stored table of those pairs of sets that are similar enough, counted on the sets."""
    left, right = (sets.select(F.col("node").alias(x), F.col("hashes").alias(f"_{x}")) for x in "uv")
    both = F.size(F.array_intersect("_u", "_v"))
    return stored(pairs.join(left, "u").join(right, "v").select(*pairs.columns, (
        both / (F.size("_u") + F.size("_v") - both) >= similar).alias("ok")).where("ok").drop("ok"), "similar")


def _nodes_of(pairs):
    return stored(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct(), "needed")


def _left_apart(table, roots, tasks):
    """A stored table of the prefix rows of tokens that still stand in several components. ``roots`` tells the
    component of a row's ``root`` (node, root)."""
    known = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    now = table.join(known, table["root"] == known["_node"], "left").select(
        "token", "node", "size", "place", F.coalesce("_root", "root").alias("root"))

    def work(batches):
        columns = _columns(batches, ["token", "node", "size", "place", "root"])
        if columns is None:
            return
        order = np.lexsort((columns[4], columns[0]))
        columns = [c[order] for c in columns]
        token, root = columns[0], columns[4]
        first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        keep = np.repeat(np.minimum.reduceat(root, first) < np.maximum.reduceat(root, first), np.diff(np.append(first, len(token))))
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], names=["token", "node", "size", "place", "root"])

    return stored(now.repartition(tasks, "token").mapInArrow(work, POSTINGS + ", root long"), "apart")


def similar_links(docs, rows, nodes, width, most, similar):
    """Links (u, v) whose components are those of all pairs of shingle sets that are similar enough.

    Pairs of the index and neighbours by size come first. Then, in rounds, the tokens that still stand in
    several components give their likely pairs between these, all of them or, if they are many, forests of
    those that look most alike; what is found similar merges, so that a family of alike texts becomes one
    component without all its pairs being counted. The last round counts every likely pair that is still
    apart, so none is missed."""
    spark = docs.sparkSession
    shingles = int(rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    table = postings(docs, width, similar, shingles)
    tasks = max(partitions_for(spark), table.count() // PREFIX_ROWS)
    near = near_links(nodes, most, similar).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    drawn, every = stored(nodes.select("node", "sketch", "size"), "drawn"), False
    asked = stored(_likely(near.union(_posted_pairs(table, similar, tasks)).distinct(), drawn, similar), "pairs")
    needed = _nodes_of(asked)
    sets = _sets(docs, needed, width)
    links = _similar_pairs(asked, sets, similar)
    removed(spark, sets, needed, asked)
    apart = _left_apart(table.withColumn("root", F.col("node")), components(links), tasks)
    removed(spark, table)
    held, known = [], None
    for k in range(MATCHINGS + 1):
        pairs = stored(_apart_pairs(apart, drawn, similar, every or k == MATCHINGS), "pairs")
        met, more = pairs.agg(F.count(F.lit(1)), F.max("more")).first()
        if not met:
            removed(spark, pairs)
            break
        # texts are read again only for sets that no round has asked for before
        needed = _nodes_of(pairs)
        missing = needed if known is None else stored(needed.join(known, "node", "left_anti"), "needed")
        if known is None or not missing.isEmpty():
            held.append(_sets(docs, missing, width))
            sets = held[0] if len(held) == 1 else sets.unionByName(held[-1])
            known = sets.select("node")
        found = _similar_pairs(pairs, sets, similar)
        links = links.union(found.select("u", "v"))
        removed(spark, pairs, *{id(t): t for t in (needed, missing)}.values())
        if not more:
            break
        # rounds go on while they merge
        every = found.count() * WORTHWHILE < met
        merged = components(found.select(F.col("u_root").alias("u"), F.col("v_root").alias("v")))
        fresh = _left_apart(apart, merged, tasks)
        removed(spark, apart)
        apart = fresh
    removed(spark, drawn, apart, *held)
    return links


def near_components(docs, width=3, most=3, similar=None, sketch_width=5):
    """Fingerprint and component of every row of ``docs`` (doc_id, text).

    Two rows are linked if their fingerprints differ in at most ``most`` bits or, with ``similar``, if
    at least that share of their distinct shingles of ``sketch_width`` words is common to both; then
    ``most`` only says which pairs are looked at first. ``component_id`` is the smallest doc_id that
    can be reached. Rows with null text or no words have fingerprint zero and are linked like any
    other (without words, to each other), repeated rows stay, other columns are ignored."""
    spark = docs.sparkSession
    with short_shuffles(spark):
        rows = fingerprints(docs, width, sketch_width if similar is not None else None)
        rows = stored(rows if similar is not None else rows.withColumn("node", F.col("fp")), "rows")
        first = rows.groupBy("node").agg(F.min("doc_id").alias("_first"), F.min("fp").alias("fp"),
                                         F.min("sketch").alias("sketch"), F.min("size").alias("size"))
        links = near_links(first, most) if similar is None else similar_links(
            docs, rows, first, sketch_width, most, similar)
        found = components(links).withColumnRenamed("node", "_node")
    ids = first.select("node", "_first")
    # from nodes to the smallest doc_id of their component
    roots = ids.join(found, ids["node"] == found["_node"], "left").select(
        "node", "_first", F.coalesce("root", "node").alias("root"))
    smallest = roots.groupBy("root").agg(F.min("_first").alias("component_id"))
    named = roots.join(smallest, "root").select("node", "component_id")
    return rows.select("doc_id", "fp", "node").join(named, "node").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
