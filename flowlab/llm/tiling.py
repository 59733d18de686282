"""Benchmark decontamination by greedy string tiling.

Running hashes over windows of tokens find where a document and a benchmark item share a seed;
seeds on one diagonal join to matches, and the longest match whose tokens are free on both sides
becomes a tile, again and again. The share of an item's tokens under tiles decides, in whatever
order its passages stand in the document."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from flowlab.llm.frames import stored
from flowlab.llm.text import LOWER, U64, buffer_of, combine, edges_of, hash_spans, slices
from flowlab.tables import ship, unpack

# Tokens of a seed, hence the shortest tile; an item with fewer tokens is one seed.
SEED = 5
# Share of an item's tokens that must stand under tiles.
COVERAGE = 0.5
# Bytes of benchmark text that a pass over the documents looks for.
BLOCK_BYTES = 4 << 20

TOKEN = np.zeros(256, bool)
TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
FOUND = ("doc_id long, item_id long, coverage double, item_tokens int, "
         "tiles array<struct<doc_at:int,item_at:int,length:int>>")


def tokens_of(column):
    """Hashes of the tokens (runs of letters, digits and non-ASCII, A-Z lower-cased) of each text."""
    data, offsets = buffer_of(column)
    data = LOWER[data]
    starts, ends = edges_of(TOKEN[data], offsets)
    return hash_spans(data, starts, ends), np.diff(np.searchsorted(starts, offsets))


def window_hashes(h, width):
    """Hash of each window of ``width`` tokens."""
    out = h[: max(len(h) - width + 1, 0)]
    for k in range(1, width):
        out = combine(out, h[k: len(h) - width + 1 + k])
    return out


class Seeds:
    """All seeds of a block of items, sorted by hash, per width."""

    def __init__(self, items):
        self.ids, self.tokens, found = [], [], {}
        for item, tokens in items:
            if not len(tokens):
                continue
            width = min(SEED, len(tokens))
            hashes = window_hashes(tokens, width)
            found.setdefault(width, []).append((hashes, np.full(len(hashes), len(self.ids)), np.arange(len(hashes))))
            self.ids.append(item)
            self.tokens.append(tokens)
        self.tables = []
        for width, parts in found.items():
            h, item, at = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h, kind="stable")
            likely = np.zeros(1 << 20, bool)
            likely[h >> U64(44)] = True
            self.tables.append((width, h[order], item[order], at[order], likely))

    def matches(self, h, row):
        """Pairs (row, item, token in the text, token in the item) of equal seeds within a row."""
        for width, seeds, item, at, likely in self.tables:
            if len(h) < width:
                continue
            own = window_hashes(h, width)
            spot = np.flatnonzero(likely[own >> U64(44)])
            spot = spot[row[spot] == row[spot + width - 1]]
            low, high = np.searchsorted(seeds, own[spot], "left"), np.searchsorted(seeds, own[spot], "right")
            n = high - low
            which = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            spot = np.repeat(spot, n)
            yield width, row[spot], item[which], spot, at[which]


def tiles_of(spots, ats, width):
    """Greedy tiles from the seeds of one text and item: (text token, item token, length), in the
    order taken. The longest match comes first, ties go by place."""
    order = np.lexsort((spots, spots - ats))
    spots, ats = spots[order], ats[order]
    fresh = np.ones(len(spots), bool)
    fresh[1:] = (np.diff(spots) != 1) | (np.diff(spots - ats) != 0)
    first = np.flatnonzero(fresh)
    length = np.diff(np.append(first, len(spots))) + width - 1
    heap = [(-n, s, a) for n, s, a in zip(length.tolist(), spots[first].tolist(), ats[first].tolist())]
    heapq.heapify(heap)
    in_text, in_item, tiles = set(), set(), []
    while heap:
        n, s, a = heapq.heappop(heap)
        n = -n
        free = [k for k in range(n) if s + k not in in_text and a + k not in in_item]
        if len(free) == n:
            tiles.append((s, a, n))
            in_text.update(range(s, s + n))
            in_item.update(range(a, a + n))
            continue
        run = []  # what is left of the match goes back as shorter matches
        for k in [*free, None]:
            if run and k != run[-1] + 1 if k is not None else run:
                if len(run) >= width:
                    heapq.heappush(heap, (-len(run), s + run[0], a + run[0]))
                run = []
            if k is not None:
                run.append(k)
    return tiles


def _blocks(benchmark):
    """The benchmark in blocks of bounded size, each as (item_id, token hashes) rows."""
    items = stored(benchmark.select(F.col("item_id").cast("long").alias("item_id"),
                                    F.coalesce("text", F.lit("")).alias("text")), "benchmark")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    number = max(1, -(-total // BLOCK_BYTES))
    for k in range(number):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(number)) == k).toArrow()
        column = own.column("text").combine_chunks()
        h, n = tokens_of(column) if len(column) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        ends = np.cumsum(n)
        yield Seeds([(i, h[e - c: e]) for i, e, c in zip(own.column("item_id").to_pylist(), ends, n)])


def _found(batch, seeds, coverage):
    """(row, item, coverage, item tokens, tiles) of the pairs of a batch's texts and the items of a block."""
    for first, column in slices(batch.column("text")):
        h, n = tokens_of(column)
        row, start = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
        for width, rows, items, spots, ats in seeds.matches(h, row):
            if not len(rows):
                continue
            order = np.lexsort((items, rows))
            rows, items, spots, ats = rows[order], items[order], spots[order], ats[order]
            cut = np.flatnonzero((np.diff(rows) != 0) | (np.diff(items) != 0)) + 1
            for a, b in zip([0, *cut], [*cut, len(rows)]):
                r, i = int(rows[a]), int(items[a])
                size = len(seeds.tokens[i])
                # no tiling covers more than the item tokens that stand in any seed
                if len(np.unique(ats[a:b])) + width - 1 < coverage * size and (
                        width * len(np.unique(ats[a:b])) < coverage * size):
                    continue
                tiles = tiles_of(spots[a:b] - start[r], ats[a:b], width)
                share = sum(t[2] for t in tiles) / size
                if share >= coverage:
                    yield first + r, seeds.ids[i], share, size, tiles


def contaminated(docs, benchmark, coverage=COVERAGE):
    """Pairs of a document and a benchmark item whose tiles cover at least ``coverage`` of the item.

    Returns doc_id, item_id, coverage, item_tokens and the tiles (token places and length). All
    documents are read once per block of the benchmark. Null texts have no tokens, and texts and
    items without tokens match nothing; repeated rows are reported as often as they stand there;
    other columns are ignored."""
    spark = docs.sparkSession
    found = None
    for seeds in _blocks(benchmark):
        shipped = ship(spark, seeds)

        def work(batches, shipped=shipped):
            seeds = unpack(shipped)
            for batch in batches:
                out = list(_found(batch, seeds, coverage))
                if out:
                    r, item, share, size, tiles = zip(*out)
                    tiles = [[{"doc_at": s, "item_at": t, "length": k} for s, t, k in own] for own in tiles]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(r)), pa.array(item, pa.int64()), pa.array(share),
                         pa.array(size, pa.int32()), pa.array(tiles, pa.list_(pa.struct([
                             ("doc_at", pa.int32()), ("item_at", pa.int32()), ("length", pa.int32())])))],
                        names=["doc_id", "item_id", "coverage", "item_tokens", "tiles"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, FOUND)
        found = part if found is None else found.unionByName(part)
    return found


def clean(docs, benchmark, coverage=COVERAGE):
    """The rows of ``docs`` (with all columns) whose text no benchmark item is found in, as
    ``contaminated`` finds them. Every row is judged by its own text where it stands, so nothing is
    shuffled; null texts and texts without tokens stay."""
    spark = docs.sparkSession
    for seeds in _blocks(benchmark):
        shipped = ship(spark, seeds)

        def work(batches, shipped=shipped):
            seeds = unpack(shipped)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[r for r, *_ in _found(batch, seeds, coverage)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(work, docs.schema)
    return docs
