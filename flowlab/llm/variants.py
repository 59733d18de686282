"""Spelling variants: words one letter apart, found in a trie of letter counts, and their usual forms.

A word is described by how often each of a few groups of letters occurs in it. Words are leaves of a
trie whose levels are these counts, group by group. A search walks it depth first with a budget of one
surplus and one deficit, since an inserted, deleted or replaced letter changes at most one group's count
upwards and one downwards; words at the leaves it reaches are compared letter by letter.

The trie is shared out by its upper levels: a route is the run of first counts, cut off at a small
number, so that there are a fixed number of routes. Every word stands in its own route and searches
those its budget can reach. A route with many words is cut by its next levels, and if that is not enough
its words are dealt over several blocks, each of which gets all searches of the route."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from flowlab.llm.frames import partitions_for, removed, stored
from flowlab.llm.text import LOWER, buffer_of, edges_of, hash_spans, slices
from flowlab.tables import ship, unpack

# One letter in SHIFTED (by checksum of document and run) loses a code point; words have at least these
# code points and occurrences.
SHIFTED, SHORTEST, RAREST = 97, 5, 3
# Letters from frequent to rare; group k has the k-th from either end, and code points above by remainder.
LETTERS = "etaoinshrdlcumwfgypbvkjxqz"
GROUPS = len(LETTERS) // 2
# Levels of a route and of a finer one below it, and the count from which they make no difference.
LEVELS, TOP = 4, 4
ROUTES = (TOP + 1) ** LEVELS
# Words of a block; search states and pairs of words held at once; letters compared as a matrix.
BLOCK, STATES, PAIRS, WIDTH = 1 << 15, 1 << 17, 1 << 16, 48
# Distinct words that a task adds up before it hands them on.
HELD = 500_000

GROUP = np.zeros(256, np.int64)
GROUP[0xC0:] = np.arange(0x40) % GROUPS
for _k in range(GROUPS):
    for _c in (LETTERS[_k], LETTERS[-1 - _k]):
        GROUP[[ord(_c), ord(_c.upper())]] = _k

CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, CRC >> 1 ^ np.uint32(0xEDB88320), CRC >> 1)  # fixed polynomial of CRC-32


def crc32_spans(data, starts, ends, before):
    """CRC-32 of spans of bytes, each carried on from the checksum ``before`` it."""
    state, size = ~before.astype(np.uint32), ends - starts
    order = np.argsort(-size, kind="stable")
    at, left, got = starts[order], size[order], state[order]
    short = np.searchsorted(-left, -64, "left")  # longer ones go through zlib
    for k in range(int(left[short]) if short < len(left) else 0):
        live = short + np.searchsorted(-left[short:], -k, "left")
        part = got[short:live]
        got[short:live] = CRC[(part ^ data[at[short:live] + k]) & np.uint32(255)] ^ part >> np.uint32(8)
    out = np.empty_like(got)
    out[order] = ~got
    for k in order[:short]:
        out[k] = zlib.crc32(data[starts[k]: ends[k]].tobytes(), int(before[k]))
    return out


def letter_runs(column, ids):
    """(word, occurrences) of the runs of letters of an array of texts. ``ids`` are the documents' ids as
    text; runs whose checksum divides evenly come without one of their code points."""
    data, offsets = buffer_of(column)
    data = LOWER[data]
    inside = (data >= 97) & (data <= 122) | (data == 0xC3)
    inside[1:] |= data[:-1] == 0xC3  # the second byte of U+00C0 to U+00FF
    starts, ends = edges_of(inside, offsets)
    if not len(starts):
        return
    row = np.searchsorted(offsets, starts, "right") - 1
    before = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    sums = crc32_spans(data, starts, ends, before[row])
    odd = sums % np.uint32(SHIFTED) == 0
    for k in np.flatnonzero(odd).tolist():
        run = data[starts[k]: ends[k]].tobytes().decode()
        at = int(sums[k]) % len(run)
        yield run[:at] + run[at + 1:], 1
    starts, ends = starts[~odd], ends[~odd]
    if not len(starts):
        return
    _, first, n = np.unique(hash_spans(data, starts, ends), return_index=True, return_counts=True)
    raw = data.tobytes()
    for a, b, count in zip(starts[first].tolist(), ends[first].tolist(), n.tolist()):
        yield raw[a:b].decode(), count


def word_counts(docs, shortest=SHORTEST, rarest=RAREST):
    """Words of all texts with their numbers of occurrences: word, n."""
    def work(batches):
        held = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                              names=["word", "n"])

        for batch in batches:
            ids = ["" if i is None else i for i in batch.column("doc_id").to_pylist()]
            for first, texts in slices(batch.column("text")):
                for word, n in letter_runs(texts, ids[first: first + len(texts)]):
                    if len(word) >= shortest:
                        held[word] += n
            if len(held) > HELD:
                yield out()
                held.clear()
        yield out()

    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(work, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= rarest)


def letter_counts(words):
    """How often each group of letters occurs in each word (Latin-1 bytes)."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    row = np.repeat(np.arange(len(words)), size)
    flat = np.frombuffer(b"".join(words), np.uint8)
    return np.bincount(row * GROUPS + GROUP[flat], minlength=len(words) * GROUPS).reshape(-1, GROUPS)


def _code(counts):
    """A number for the first counts of a route."""
    code = 0
    for c in counts:
        code = code * (TOP + 1) + min(c, TOP)
    return code


def route_of(counts, hot):
    upper = _code(counts[:LEVELS])
    return ROUTES * (1 + upper) + _code(counts[LEVELS: 2 * LEVELS]) if upper in hot else upper


def reachable(counts, hot):
    """Routes in which a word with these counts can have a neighbour."""
    out = set()
    stack = [((), 0, 0)]
    while stack:
        done, surplus, deficit = stack.pop()
        if len(done) == LEVELS and _code(done) not in hot or len(done) == 2 * LEVELS:
            out.add(route_of(done, hot))
            continue
        c = counts[len(done)]
        stack.append(((*done, c), surplus, deficit))
        if not surplus:
            stack.append(((*done, c + 1), 1, deficit))
        if not deficit and c:
            stack.append(((*done, c - 1), surplus, 1))
    return out


class CountTrie:
    """Trie of count vectors; level by level the nodes' counts and where their children start."""

    def __init__(self, counts):
        self.order = np.lexsort(counts.T[::-1])
        counts = counts[self.order]
        differs = counts[1:] != counts[:-1]
        first = np.where(differs.any(1), differs.argmax(1), GROUPS)
        self.values, self.children, starts = [], [], None
        for level in range(GROUPS):
            here = np.append(0, 1 + np.flatnonzero(first <= level))
            if starts is not None:
                self.children.append(np.append(np.searchsorted(here, starts), len(here)))
            self.values.append(counts[here, level])
            starts = here
        self.children.append(np.append(starts, len(counts)))

    def search(self, counts):
        """Yield arrays (query, word): words at leaves that differ in at most one surplus and one deficit."""
        n = len(counts)
        step = max(1, STATES // max(1, len(self.values[0])))
        stack = []
        for a in range(0, n, step):
            b, width = min(n, a + step), len(self.values[0])
            stack.append((np.repeat(np.arange(a, b), width), np.tile(np.arange(width), b - a),
                          np.zeros((b - a) * width, bool), np.zeros((b - a) * width, bool), 0))
            while stack:
                q, node, surplus, deficit, level = stack.pop()
                if len(q) > STATES:  # depth first, so that little waits
                    half = len(q) // 2
                    stack += [(q[:half], node[:half], surplus[:half], deficit[:half], level),
                              (q[half:], node[half:], surplus[half:], deficit[half:], level)]
                    continue
                d = self.values[level][node] - counts[q, level]
                keep = (d + surplus <= 1) & (deficit - d <= 1)
                q, node, d = q[keep], node[keep], d[keep]
                surplus, deficit = surplus[keep] | (d > 0), deficit[keep] | (d < 0)
                first = self.children[level][node]
                size = self.children[level][node + 1] - first
                total = np.cumsum(size)
                at = np.arange(total[-1] if len(total) else 0) + np.repeat(first - (total - size), size)
                q = np.repeat(q, size)
                if level + 1 < GROUPS:
                    stack.append((q, at, np.repeat(surplus, size), np.repeat(deficit, size), level + 1))
                elif len(q):
                    for k in range(0, len(q), PAIRS):
                        yield q[k: k + PAIRS], self.order[at[k: k + PAIRS]]


def _padded(words):
    """Letters of the words as a matrix; longer words stand in part, their sizes tell."""
    return np.array([w[:WIDTH] for w in words], f"S{WIDTH}").view(np.uint8).reshape(len(words), WIDTH)


def one_apart(a, b):
    """Does exactly one inserted, deleted or replaced letter lead from one word to the other?"""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def verified(left, right, i, j):
    """Which pairs of words (lists with their sizes and letters) are one letter apart."""
    (words, size, letters), (others, sizes, letters2) = left, right
    m, n = size[i], sizes[j]
    out = np.zeros(len(i), bool)
    for k in np.flatnonzero(np.maximum(m, n) > WIDTH).tolist():
        out[k] = one_apart(words[i[k]], others[j[k]])
    at = np.flatnonzero((m == n) & (m <= WIDTH))
    out[at] = (letters[i[at]] != letters2[j[at]]).sum(1) == 1
    at = np.flatnonzero((np.abs(m - n) == 1) & (np.maximum(m, n) <= WIDTH))
    if len(at):
        x, y = letters[i[at]], letters2[j[at]]
        longer = (m > n)[at, None]
        long, short = np.where(longer, x, y), np.where(longer, y, x)
        first = (long != short).argmax(1)
        out[at] = ~((long[:, 1:] != short[:, :-1]) & (np.arange(WIDTH - 1) >= first[:, None])).any(1)
    return out


def _columns(words):
    return words, np.fromiter(map(len, words), np.int64, len(words)), _padded(words)


def near_pairs(words):
    """All pairs of words (a stored table: word, n; each word once) one letter apart, each pair once:
    u, u_n, v, v_n."""
    spark = words.sparkSession

    def codes(batches):
        for batch in batches:
            counts = letter_counts([w.encode("latin-1") for w in batch.column("word").to_pylist()])
            held = Counter((_code(c[:LEVELS]), _code(c[LEVELS: 2 * LEVELS])) for c in counts.tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k in held], pa.int32()) for i in (0, 1)] + [pa.array(list(held.values()), pa.int64())],
                names=["upper", "lower", "n"])

    # at most ROUTES ** 2 rows, whatever the words
    sizes = words.select("word").mapInArrow(codes, "upper int, lower int, n long").groupBy("upper", "lower").agg(
        F.sum("n").alias("n")).collect()
    uppers = Counter()
    for r in sizes:
        uppers[r["upper"]] += r["n"]
    hot = frozenset(u for u, n in uppers.items() if n > BLOCK)
    blocks = {ROUTES * (1 + r["upper"]) + r["lower"]: -(-r["n"] // BLOCK) for r in sizes if r["upper"] in hot and r["n"] > BLOCK}
    shipped = ship(spark, (hot, blocks))

    def deal(batches):
        hot, blocks = unpack(shipped)
        known = {}
        for batch in batches:
            words, n = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            rows = [[] for _ in range(5)]

            def add(*row):
                for column, x in zip(rows, row):
                    column.append(x)

            for word, count, vector in zip(words, n, map(tuple, letter_counts([w.encode("latin-1") for w in words]).tolist())):
                upper = vector[: 2 * LEVELS]
                if upper not in known:
                    own = route_of(upper, hot)
                    known[upper] = own, [r for r in reachable(upper, hot) if r >= own]
                own, others = known[upper]
                add(own, zlib.crc32(word.encode()) % blocks.get(own, 1), False, word, count)
                for route in others:
                    for block in range(blocks.get(route, 1)):
                        add(route, block, True, word, count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(rows, (pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.int64()))],
                names=["route", "block", "asks", "word", "n"])

    def search(batches):
        hot, _ = unpack(shipped)
        held, trie, here = [], None, None  # words of a block come before its searches
        for batch in batches:
            route, block, asks = (np.asarray(batch.column(c)) for c in ("route", "block", "asks"))
            words, n = batch.column("word").to_pylist(), np.asarray(batch.column("n"))
            cut = 1 + np.flatnonzero((route[1:] != route[:-1]) | (block[1:] != block[:-1]) | (asks[1:] != asks[:-1]))
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(words)]):
                if a == b:
                    continue
                part = [w.encode("latin-1") for w in words[a:b]]
                if not asks[a]:
                    if here != (route[a], block[a]) or trie is not None:
                        held, trie, here = [], None, (route[a], block[a])
                    held.append((part, n[a:b]))
                    continue
                if here != (route[a], block[a]):
                    continue  # nothing stands there
                if trie is None:
                    kept = [w for p, _ in held for w in p]
                    kept_n = np.concatenate([x for _, x in held])
                    trie, right = CountTrie(letter_counts(kept)), _columns(kept)
                counts = letter_counts(part)
                home = np.array([route_of(c, hot) == route[a] for c in counts.tolist()])
                left = _columns(part)
                for i, j in trie.search(counts):
                    good = verified(left, right, i, j)
                    i, j = i[good], j[good]
                    # words of one route search each other; one of both finds is enough
                    once = np.array([not home[x] or part[x] < kept[y] for x, y in zip(i.tolist(), j.tolist())], bool)
                    i, j = i[once], j[once]
                    if len(i):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([part[x].decode("latin-1") for x in i.tolist()], pa.string()), pa.array(n[a:b][i]),
                             pa.array([kept[y].decode("latin-1") for y in j.tolist()], pa.string()), pa.array(kept_n[j])],
                            names=["u", "u_n", "v", "v_n"])

    dealt = words.mapInArrow(deal, "route int, block int, asks boolean, word string, n long")
    return (dealt.repartition(4 * partitions_for(spark), "route", "block").sortWithinPartitions("route", "block", "asks")
            .mapInArrow(search, "u string, u_n long, v string, v_n long"))


def _roots(forms):
    """The last form reached from each word that has one (word, form): every round follows the form's
    form, so chains halve. Occurrences double from form to form, which bounds the rounds."""
    spark = forms.sparkSession
    state = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        after = stored(state.join(ahead, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        removed(spark, state)
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        state = after
        path = after.scratch_path
        state = after.select("word", "root")
        state.scratch_path = path


def spelling_variants(docs, shortest=SHORTEST, rarest=RAREST):
    """Words of all texts of ``docs`` (doc_id, text; other columns are ignored) with their near words.

    Runs of letters (A-Z, a-z, U+00C0 to U+00FF) are lower-cased in A-Z and some lose a code point, by a
    checksum of ``doc_id:run`` (null ids: empty). Returns word, form (its near word with the most
    occurrences, ties to the smallest, if it has at least twice the word's), root (where forms lead), n,
    n_near, form_n. Null and empty texts have no words, repeated rows count again, an empty table gives
    no rows."""
    words = stored(word_counts(docs, shortest, rarest), "words")
    pairs = stored(near_pairs(words), "near")
    both = pairs.select(F.col("u").alias("word"), F.col("v").alias("other"), F.col("v_n").alias("m")).union(
        pairs.select("v", "u", "u_n"))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    has_form = -F.col("best.m") >= 2 * F.col("n")
    rows = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has_form, F.col("best.other")).alias("form"), F.when(has_form, -F.col("best.m")).alias("form_n")), "forms")
    removed(words.sparkSession, pairs)
    roots = _roots(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
