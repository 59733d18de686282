"""Shards of nearly equal bytes: minimax contiguous partition.

Groups of equal texts are atomic and stand in the order of their smallest doc_id. The smallest
capacity with which greedy filling needs no more than the given number of shards is found by
search over capacities, and the cuts of the greedy filling at that capacity are the shards.
Everything is DataFrame code."""

from __future__ import annotations

import bisect

from pyspark.sql import functions as F

from flowlab.llm.frames import running, stored

# Group ends that the driver holds of one look at them.
BINS = 1 << 16


def sized(docs):
    """doc_id, size, text_crc32 and a digest that equal texts share; a null text counts as empty."""
    body = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    return docs.select("doc_id", (F.octet_length(body) + 8).cast("long").alias("size"),
                       F.crc32(body).alias("text_crc32"), F.sha2(body, 256).alias("_digest"))


def in_group_order(rows):
    """The rows with the smallest doc_id of their group, and with running sums of bytes and rows
    in the order of groups. Null ids sort before all others."""
    rows = stored(rows, "sized")
    # a table of its own, so that the join below deals out both sides and can split a hot group
    first = stored(rows.groupBy("_digest").agg(F.min("doc_id").alias("_first")), "firsts")
    grouped = rows.join(first, "_digest")
    # the digest keeps groups whole when ids repeat; a range may end inside a group
    return running(grouped, ["_first", "_digest", "doc_id"], {"_bytes": F.col("size"), "_rows": F.lit(1)}, "ordered")


def group_ends(ordered):
    """Bytes up to the end of each group, written in that order so that a look at a narrow range
    reads only the row groups around it."""
    ends = ordered.groupBy("_digest").agg(F.max(F.col("_bytes") + F.col("size")).alias("end"),
                                          F.sum("size").alias("bytes"))
    return stored(ends.repartitionByRange("end").sortWithinPartitions("end"), "ends")


class Ends:
    """What the driver knows of the group ends: a bounded summary that is refined where it matters.

    ``known`` are exact group ends in ascending order; ``more[j]`` says that further ends lie
    between known[j - 1] and known[j]. At most BINS ends are fetched at a time."""

    def __init__(self, table, total):
        self.table, self.total = table, total
        self.known, self.more = [], []
        self.refine([(0, total)])

    def refine(self, ranges):
        """Fetch the largest end of each of the equal bins that the ranges (low, high] are cut into."""
        share = max(2, BINS // len(ranges))
        number, inside = F.lit(None).cast("long"), F.lit(False)
        for k, (low, high) in enumerate(ranges):
            within = (F.col("end") > low) & (F.col("end") <= high)
            width = -(-(high - low) // share)
            number = F.when(within, F.lit(k * share) + F.floor((F.col("end") - low - 1) / width)).otherwise(number)
            inside = inside | within
        found = (self.table.where(inside).groupBy(number.alias("bin"))
                 .agg(F.max("end").alias("end"), F.count(F.lit(1)).alias("n")).collect())
        fresh = {r["end"]: r["n"] > 1 for r in found}
        old = {e: m for e, m in zip(self.known, self.more)}
        both = sorted({**old, **fresh}.items())
        self.known, self.more = [e for e, _ in both], [m for _, m in both]

    def last(self, limit):
        """Bounds of the last group end not beyond the limit."""
        j = bisect.bisect_right(self.known, limit)
        low = self.known[j - 1] if j else 0
        return low, limit if j < len(self.known) and self.more[j] else low

    def fill(self, capacity, shards, side, at=0):
        """Greedy cuts from ``at`` on with the lower (0) or upper (1) bounds of group ends."""
        cuts = []
        while at < self.total and len(cuts) < shards:
            step = self.last(min(at + capacity, self.total))[side]
            if step <= at:
                break
            at = step
            cuts.append(at)
        return cuts, at >= self.total


def smallest_capacity(ends, shards, largest):
    """The smallest sufficient capacity, by binary search with greedy checks. The lower bounds of
    ends prove that a capacity suffices, the upper bounds that it doesn't; where neither does,
    the ends around the cuts in question are fetched in more detail."""
    low, high = max(largest, -(-ends.total // shards)), -(-ends.total // shards) + largest
    while True:
        proven = bisect.bisect_left(range(low, high), True, key=lambda c: ends.fill(c, shards, 0)[1]) + low
        possible = bisect.bisect_left(range(low, proven), True, key=lambda c: ends.fill(c, shards, 1)[1]) + low
        if possible == proven:
            return proven
        low, high = possible, proven
        least, most = ends.fill(low, shards, 0)[0], ends.fill(high, shards, 1)[0]
        wide = []
        for a, b in zip(least, most):
            i, j = bisect.bisect_left(ends.known, a), bisect.bisect_left(ends.known, b)
            i, j = max(i, 1), min(j, len(ends.known) - 1)
            if any(ends.more[i: j + 1]):
                span = (ends.known[i - 1], ends.known[j])
                if wide and span[0] < wide[-1][1]:
                    wide[-1] = (wide[-1][0], max(span[1], wide[-1][1]))
                else:
                    wide.append(span)
        if ends.more[0]:
            wide.append((0, ends.known[0])) if not wide or wide[0][0] >= ends.known[0] else None
        ends.refine(sorted(wide))


def balanced_cuts(ends, capacity, shards):
    """Cuts within the capacity, each as near to an equal share of the rest as what follows allows."""
    cuts, at = [], 0
    for left in range(shards - 1, 0, -1):
        if at >= ends.total:
            break
        share = at + (ends.total - at) // (left + 1)
        j = bisect.bisect_right(ends.known, share)
        near = sorted(ends.known[max(j - 1, 0): j + 1], key=lambda e: abs(e - share))
        greedy = ends.fill(capacity, 1, 0, at)[0]
        at = next(e for e in near + greedy if at < e <= at + capacity and ends.fill(capacity, left, 0, e)[1])
        cuts.append(at)
    return cuts


def minimax_shards(docs, shards=24):
    """Put every row of ``docs`` (doc_id, text) into one of ``shards`` contiguous shards.

    Returns doc_id, size, text_crc32, shard and slot, the place in its shard from 0. Rows with
    equal texts share a shard. Null texts count as empty, repeated rows keep a slot each, an
    empty table gives an empty result, and other columns are ignored."""
    ordered = in_group_order(sized(docs))
    ends = group_ends(ordered)
    total, largest = ends.agg(F.coalesce(F.max("end"), F.lit(0)), F.max("bytes")).first()
    cuts = []
    if total:
        summary = Ends(ends, total)
        cuts = balanced_cuts(summary, smallest_capacity(summary, shards, largest), shards)
    # a row lies behind every cut that the bytes before it reach; there are fewer cuts than shards
    shard = sum([F.when(F.col("_bytes") >= F.lit(int(c)), 1).otherwise(0) for c in cuts], F.lit(0))
    placed = ordered.withColumn("shard", shard.cast("int"))
    starts = placed.groupBy("shard").agg(F.min("_rows").alias("_start"))
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_rows") - F.col("_start")).cast("long").alias("slot"))
