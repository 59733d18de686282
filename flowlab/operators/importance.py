"""Permutation importance: how much macro F1 falls when one feature is shuffled."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from flowlab.operators.forest import Guesses
from flowlab.operators.metrics import classification_summary, confusion_counts
from flowlab.operators.sampling import order_key, rank_by_key
from flowlab.session import dropped, materialised
from flowlab.tables import ref, settled, ship, tick, ticks, unpack, value_of

# Rows whose values a task sends at a time, and blocks of ranks that they are sent to.
SENT_ROWS, BLOCKS = 1 << 18, 256
# Values that a block of ranks may receive.
BLOCK_VALUES = 1 << 25


def shuffle_steps(features, repeats, rows, seed=0):
    """{(feature, repeat): (factor, offset)}: rank r hands its value on to the row of rank
    (factor * r + offset) mod rows, a permutation since factor and rows have no common divisor."""
    steps = {}
    for feature in features:
        for repeat in range(repeats):
            factor, offset = step_seeds(feature, repeat, seed)
            factor %= max(rows, 1)
            while math.gcd(factor, max(rows, 1)) != 1:
                factor += 1
            steps[feature, repeat] = factor, offset % max(rows, 1)
    return steps


def step_seeds(feature, repeat, seed=0):
    """Two large numbers per shuffle, from the md5 of seed, feature and repeat."""
    digest = hashlib.md5(f"{seed}:{feature}:{repeat}".encode()).hexdigest()
    return int(digest[:15], 16), int(digest[15:30], 16)


def shuffled_copies(df, ids, features, repeats, seed=0):
    """Every row once per (feature, repeat), with that feature's values shuffled.

    Rows get one random rank. A rank's values are sent to the ranks that receive them, so only
    the receiving rank, the number of the shuffle and the value are multiplied and joined with the
    rows once, rank and number as one long."""
    rows = df.count()
    # both sides of the join read the ranks, so they are found and written once
    base = materialised(rank_by_key(df.withColumn("_key", order_key("stay", ids)), "_key", name="_rank",
                                    rows=rows).withColumn("_rank", F.col("_rank") - 1).drop("_key"), "ranked")
    steps = shuffle_steps(features, repeats, rows, seed)
    # a product of two ranks may need more than 64 bits
    rank, n = F.col("_rank").cast("decimal(19,0)"), F.lit(max(rows, 1)).cast("decimal(19,0)")
    runs = len(steps)
    sent = F.inline(F.array(*[
        F.struct((((rank * F.lit(factor).cast("decimal(18,0)") + F.lit(offset)) % n).cast("bigint") * runs + run).alias("_slot"),
                 ref(feature).cast("double").alias("_moved"))
        for run, ((feature, _), (factor, offset)) in enumerate(steps.items())]))
    named = F.array(*[F.struct(F.lit(feature).alias("feature"), F.lit(repeat).alias("repeat")) for feature, repeat in steps])
    out = base.select(sent).join(base, F.expr(f"_slot div {runs}") == F.col("_rank")).drop("_rank")
    out = out.withColumn("_run", F.get(named, (F.col("_slot") % runs).cast("int"))).select(
        "_run.feature", "_run.repeat", "_moved", *ticks(df.columns))
    return out.withColumns({
        f: F.when(F.col("feature") == F.lit(f), F.col("_moved")).otherwise(ref(f).cast("double"))
        for f in features}).drop("_moved")


def receivers(rank, factor, offset, n):
    """(factor * rank + offset) mod n for an array of ranks, without products beyond 64 bits (n below 2**39)."""
    high, low = divmod(int(factor), 1 << 16)
    return (((rank * high % n) << 16) + rank * low + offset) % n


def _sorted_parts(place, shift, blocks, records):
    """The records in the order of their place's block: the blocks that have some, and their bytes."""
    block = place >> shift
    order = np.argsort(block.astype(np.uint16) if blocks <= 1 << 16 else block, kind="stable")
    n = np.bincount(block, minlength=blocks)
    there = np.flatnonzero(n)
    offsets = np.append(0, n[there].cumsum()) * records.itemsize
    packed = pa.Array.from_buffers(pa.binary(), len(there), [None, pa.py_buffer(offsets.astype(np.int32)),
                                                             pa.py_buffer(np.ascontiguousarray(records[order]))])
    return pa.array(there, pa.int32()), packed


def _gathered(batches):
    """Batches of at least ``SENT_ROWS`` rows, but for the last one."""
    held = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= SENT_ROWS:
            yield pa.Table.from_batches(held)
            held = []
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def forest_counts(df, ids, features, label, model, repeats=3, seed=0):
    """Confusion counts (feature, repeat, label, prediction, n) of a forest for the rows as they are (feature and
    repeat null) and for every shuffle of ``shuffled_copies``.

    Shuffling values shuffles their bins, so a value is sent as one byte: the ranks are cut into blocks, and
    a block receives its rows and, per shuffle, the bins with the places they go to. Nothing is sorted, no shuffled
    row is written out, and rows that are alike to the forest are scored once per block."""
    spark, p = df.sparkSession, len(features)
    names = [r[0] for r in df.select(ref(label)).distinct().collect() if r[0] is not None]  # one per class
    code = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in names]), ref(label)), F.lit(0)) if names else F.lit(0)
    shipped = ship(spark, model)

    def cut(batches):
        model = unpack(shipped)
        for batch in batches:
            if batch.num_rows:
                x = np.stack([batch.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in range(p)], axis=1)
                flat = pa.py_buffer(np.ascontiguousarray(model.binned(x)))
                offsets = pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * p)
                yield pa.RecordBatch.from_arrays([batch.column(p), batch.column(p + 1), pa.Array.from_buffers(
                    pa.binary(), len(x), [None, offsets, flat])], names=["key", "code", "bins"])

    keyed = materialised(df.select(*ticks(features), order_key("stay", ids).alias("key"), code.cast("int").alias("code"))
                         .mapInArrow(cut, "key string, code int, bins binary"), "keyed")
    rows = keyed.count()
    ranked = materialised(rank_by_key(keyed, "key", name="rank", rows=rows).select(
        (F.col("rank") - 1).alias("rank"), "code", "bins"), "ranked")
    dropped(keyed)
    steps = shuffle_steps(features, repeats, rows, seed)
    runs = [(features.index(feature), *step) for (feature, _), step in steps.items()]
    most = max(1, BLOCK_VALUES // (len(runs) + p))
    shift = min(max(16, math.ceil(math.log2(max(rows, 1) / BLOCKS))), int(math.log2(most)), 24)
    blocks, row = -(-rows // (1 << shift)), np.dtype([("at", "<u4"), ("code", "<i4"), ("bins", "u1", (p,))])

    def send(batches):
        for table in _gathered(batches):
            rank = table.column("rank").to_numpy()
            records = np.empty(len(rank), row)
            records["at"], records["code"] = rank & (1 << shift) - 1, table.column("code").to_numpy()
            records["bins"] = np.frombuffer(b"".join(table.column("bins").to_pylist()), np.uint8).reshape(-1, p)
            block, packed = _sorted_parts(rank, shift, blocks, records)
            yield pa.RecordBatch.from_arrays([block, pa.array(np.full(len(block), -1, np.int32)), packed], names=["block", "run", "packed"])
            for run, (f, factor, offset) in enumerate(runs):
                to = receivers(rank, factor, offset, rows)
                moved = (to & (1 << shift) - 1).astype(np.uint32) << 8 | records["bins"][:, f]
                block, packed = _sorted_parts(to, shift, blocks, moved)
                yield pa.RecordBatch.from_arrays([block, pa.array(np.full(len(block), run, np.int32)), packed],
                                                 names=["block", "run", "packed"])

    def count(table):
        guesses = Guesses(unpack(shipped))
        k = len(guesses.model.classes)
        parts = [[] for _ in range(len(runs) + 1)]
        for run, packed in zip(table.column("run").to_pylist(), table.column("packed")):
            parts[run + 1].append(np.frombuffer(packed.as_buffer(), np.uint32 if run >= 0 else row))
        own = np.concatenate(parts[0])
        own = own[np.argsort(own["at"])]
        bins, found = np.ascontiguousarray(own["bins"]), []
        for run in range(-1, len(runs)):
            there = bins
            if run >= 0:
                there = bins.copy()
                for moved in parts[run + 1]:
                    there[moved >> 8, runs[run][0]] = moved & 255
            n = np.bincount(own["code"] * k + guesses.of(there))
            cell = np.flatnonzero(n)
            found.append(np.stack([np.full(len(cell), run), cell // k, cell % k, n[cell]]))
        return pa.table(dict(zip(("run", "code", "guess", "n"), np.concatenate(found, axis=1))))

    sent = ranked.mapInArrow(send, "block int, run int, packed binary").repartition(max(blocks, 1), "block")
    counts = settled(sent.groupBy("block").applyInArrow(count, "run bigint, code bigint, guess bigint, n bigint")
                     .groupBy("run", "code", "guess").agg(F.sum("n").alias("n")))
    texts = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(r).alias("repeat")) for f, r in steps])
    classes, labels = (F.array(*[F.lit(c) for c in some]) for some in (model.classes, [None, *names]))
    out = counts.withColumn("_run", F.expr("if(run < 0, null, run)")).select(
        F.get(texts, F.col("_run").cast("int")).alias("_run"), F.get(labels, F.col("code").cast("int")).alias("label"),
        F.get(classes, F.col("guess").cast("int")).alias("prediction"), "n")
    return out.select("_run.feature", "_run.repeat", "label", "prediction", "n")


def permutation_importance(df, ids, features, label, score, repeats=3, seed=0, forest=None):
    """Mean and population deviation of the macro F1 drop per feature, largest first.

    ``score(DataFrame)`` adds a ``prediction`` column; all shuffled copies are
    scored in one pass. The predictions of a ``forest`` are counted by its bins instead."""
    features = list(features)
    if forest is not None:
        counts = forest_counts(df, ids, features, label, forest, repeats, seed)
        base = classification_summary(counts.where("feature is null"))
        counts = counts.where("feature is not null")
    else:
        # read once per pass below, so written once
        df = materialised(df.select(*ids, *ticks(features), tick(label)))
        base = classification_summary(confusion_counts(score(df), label))
        shuffled = score(shuffled_copies(df, ids, features, repeats, seed))
        counts = confusion_counts(shuffled, label, by=["feature", "repeat"])
    runs = classification_summary(counts, by=["feature", "repeat"])
    drop = value_of(base, "macro_f1") - F.col("macro_f1")
    return (runs.select("feature", drop.alias("drop")).groupBy("feature").agg(
        F.avg("drop").alias("permutation_mean"), F.stddev_pop("drop").alias("permutation_std"))
        .orderBy(F.col("permutation_mean").desc(), "feature"))
