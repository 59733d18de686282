"""Best-fit packing by exact-complement hashing.

Pieces of documents are counted by length: that table has at most as many rows as a sequence has
tokens, whatever the size of the corpus, so the plan is made from it alone. Combinations of up to
four lengths that fill a sequence exactly are consumed in bulk, the rest is placed best-fit; ranks
of pieces among those of equal length then turn the plan into places."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlab.llm.encoding import worker_encoder
from flowlab.llm.frames import partitions_for, stored
from flowlab.llm.text import slices
from flowlab.tables import ship, unpack

# Bytes of text that are encoded together; half of what the encoder takes elsewhere, since the pipeline's workers
# come here with memory of the stages before.
PACKED_BYTES = 1 << 20

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


def pieces_of(docs, tokenizer, end_id=0, capacity=2048):
    """Token pieces of every document: its ids and the end id, cut into pieces of ``capacity``
    tokens with the short piece in front. Null texts count as empty and have the end id alone."""
    def work(batches):
        encoder = worker_encoder(tokenizer, "blank_led")
        pa.default_memory_pool().release_unused()
        for batch in batches:
            for first, texts in slices(batch.column("text"), PACKED_BYTES):
                ids, counts = encoder.encode(texts)
                keys, rows = batch.column("doc_id").slice(first, len(texts)), []
                at = 0
                for row, n in enumerate(counts.tolist()):
                    own = np.append(ids[at: at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    raw = memoryview(own.tobytes())
                    cuts = [0, *range(len(own) % capacity or capacity, len(own) + 1, capacity)]
                    rows += [(row, p, a, b - a, zlib.crc32(raw[4 * a: 4 * b]))
                             for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                row, piece, start, length, crc = map(np.array, zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(row)).cast(pa.int64()), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, PIECES)


def plan(counts, capacity):
    """Sequences for ``counts`` (length -> pieces): a list of (lengths, how many such sequences)."""
    c = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        c[length] = n
    made = []

    def take(*lengths):
        """Consume as many exact sequences of these lengths as there are pieces for."""
        need = {x: lengths.count(x) for x in lengths}
        n = min(int(c[x]) // k for x, k in need.items())
        if n > 0:
            for x, k in need.items():
                c[x] -= n * k
            made.append((lengths, n))

    if c[capacity]:
        take(capacity)
    for longest in range(capacity - 1, 0, -1):
        gap = capacity - longest
        if c[longest]:
            take(longest, gap)
        if c[longest]:
            for a in np.flatnonzero(c[: gap // 2 + 1]):
                if c[longest] == 0:
                    break
                if c[gap - a]:
                    take(longest, int(gap - a), int(a))
        if c[longest]:
            for a in np.flatnonzero(c[: gap // 3 + 1]):
                rest = gap - a
                here = np.arange(a, rest // 2 + 1)
                for b in here[(c[here] > 0) & (c[rest - here] > 0)]:
                    take(longest, int(rest - b), int(b), int(a))
                    if c[longest] == 0:
                        break
                if c[longest] == 0:
                    break
    # best fit of what is left, longest first; open sequences are held by their gap
    open_by_gap = {}
    for length in np.flatnonzero(c)[::-1].tolist():
        n = int(c[length])
        while n:
            gap = min((g for g in open_by_gap if g >= length), default=None)
            if gap is None:
                each = min(capacity // length, n)
                new = n // each
                _add(open_by_gap, capacity - each * length, ((length,) * each, new))
                n -= new * each
                continue
            lengths, there = open_by_gap[gap].pop()
            used = min(n, there)
            if there > used:
                open_by_gap[gap].append((lengths, there - used))
            if not open_by_gap[gap]:
                del open_by_gap[gap]
            _add(open_by_gap, gap - length, (lengths + (length,), used))
            n -= used
    return made + [kind for kinds in open_by_gap.values() for kind in kinds]


def _add(groups, gap, kind):
    groups.setdefault(gap, []).append(kind)


def runs_of(made):
    """The plan by length and rank: rows (length, first rank, first sequence, offset), sorted."""
    used, rows, sequence = {}, [], 0
    for lengths, n in made:
        offset = 0
        for length in lengths:
            rows.append((length, used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + n
            offset += length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def best_fit(pieces, capacity=2048):
    """Give every row of ``pieces`` (doc_id, piece, start, length, ...) a sequence_id and an offset.

    Ranks among equal lengths are counted per lane first, so no length, however common, meets in
    one task; the plan has a few rows per length."""
    spark = pieces.sparkSession
    lanes = partitions_for(spark)
    lane = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(lanes))
    table = stored(pieces.withColumn("_lane", lane), "pieces")
    counts = table.groupBy("length", "_lane").agg(F.count(F.lit(1)).alias("_n"))
    # lengths x lanes rows, at most ``capacity`` times the partitions
    before = Window.partitionBy("length").orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_lane", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    runs = ship(spark, runs_of(plan(by_length, capacity)))
    rank = F.row_number().over(Window.partitionBy("length", "_lane").orderBy("doc_id", "piece"))
    ranked = (table.withColumn("_rank", rank).join(offsets, ["length", "_lane"])
              .withColumn("_rank", F.col("_rank") - 1 + F.col("_before")).drop("_before", "_lane"))
    names = [c for c in pieces.columns]

    def place(batches):
        rows = unpack(runs)
        width = int(rows[:, 1].max(initial=0)) + 1
        starts = rows[:, 0].astype(np.uint64) * np.uint64(width) + rows[:, 1].astype(np.uint64)
        for batch in batches:
            length = np.asarray(batch.column("length")).astype(np.int64)
            rank = np.asarray(batch.column("_rank")).astype(np.int64)
            key = length.astype(np.uint64) * np.uint64(width) + np.minimum(rank, width - 1).astype(np.uint64)
            at = np.searchsorted(starts, key, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names]
                + [pa.array(rows[at, 2] + rank - rows[at, 1]), pa.array(rows[at, 3])],
                names=names + ["sequence_id", "offset"])

    schema = pieces.schema.simpleString()[len("struct<"):-1].replace(":", " ")
    return ranked.select(*names, "_rank").mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack(docs, tokenizer, end_id=0, capacity=2048):
    """Pack all documents (doc_id, text) into sequences of at most ``capacity`` tokens.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Repeated
    rows are packed as often as they stand there, null texts as the end id alone, an empty table
    gives an empty result; other columns are ignored."""
    return best_fit(pieces_of(docs, tokenizer, end_id, capacity), capacity)
