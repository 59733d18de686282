"""Quality classifier by importance resampling.

Two generative models over hashed words, word pairs and runs of four bytes, one of target texts
and one of all texts, give every document a log importance weight; Gumbel noise turns the largest k of weight plus
noise into a sample without replacement in proportion to the weights."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from flowlab.llm.frames import running, stored
from flowlab.llm.text import U64, buffer_of, byte_runs, combine, hashed_words, mix, slices, sums_per_row
from flowlab.tables import ship, unpack

# Kinds of n-grams, and hash buckets of each kind.
KINDS, BUCKETS = 3, 1 << 16
# Target documents that the target model is counted on, at most.
TARGET_ROWS = 20_000
# Share of target documents whose weight may lie below the cut that determines k.
MISSED = 0.001
# Pseudo-counts by which both models are drawn together in every bucket: counts of n-grams come in
# clumps (copies, long texts), so a few missing ones say little.
PRIOR = 10.0


def ngram_buckets(column):
    """For words, word pairs and byte runs: the bucket of each n-gram in text order, and the n-grams
    per text. Each kind has its own BUCKETS."""
    data, offsets = buffer_of(column)
    shift = U64(64 - BUCKETS.bit_length() + 1)
    h, counts = hashed_words(column)
    inner = np.ones(len(h), bool)
    ends = np.cumsum(counts)
    inner[ends[ends > 0] - 1] = False
    pairs = combine(h[:-1], h[1:])[inner[:-1]] if len(h) else h
    runs, n = byte_runs(data, offsets, 4)
    for k, (x, n) in enumerate(((h, counts), (pairs, np.maximum(counts - 1, 0)), (mix(runs), n))):
        yield (x >> shift).astype(np.int64) + k * BUCKETS, n


def log_ratio(docs, labels, rows=TARGET_ROWS):
    """log p_target - log p_raw of every bucket; one pass over all texts counts both models."""
    target = (labels.where((F.col("quality") > 0) & F.col("doc_id").isNotNull())
              .select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
              .orderBy(F.xxhash64("doc_id")).limit(rows).withColumn("target", F.lit(True)))
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(target), "doc_id", "left")

    def count(batches):
        raw, good = np.zeros(KINDS * BUCKETS, np.int64), np.zeros(KINDS * BUCKETS, np.int64)
        for batch in batches:
            flags = np.asarray(batch.column("target").fill_null(False))
            for first, column in slices(batch.column("text")):
                for bucket, n in ngram_buckets(column):
                    raw += np.bincount(bucket, minlength=len(raw))
                    good += np.bincount(bucket[np.repeat(flags[first: first + len(column)], n)], minlength=len(raw))
        there = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(there), pa.array(raw[there]), pa.array(good[there])], names=["bucket", "raw", "good"])

    # partial counts per task, then one row per bucket
    sums = marked.mapInArrow(count, "bucket long, raw long, good long").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect()
    raw, good = np.zeros((KINDS, BUCKETS)), np.zeros((KINDS, BUCKETS))
    for r in sums:
        raw[divmod(r["bucket"], BUCKETS)] = r["raw"]
        good[divmod(r["bucket"], BUCKETS)] = r["good"]
    expected = raw * (good.sum(1, keepdims=True) / np.maximum(raw.sum(1, keepdims=True), 1))
    ratio = np.log(good + PRIOR) - np.log(expected + PRIOR)
    return ratio.reshape(-1), target


def weights_of(docs, ratio, key=None):
    """doc_id and log importance weight of every document; texts without words have weight zero. A
    ``key`` column (long) comes along."""
    shipped = ship(docs.sparkSession, ratio)
    also = [key] if key else []

    def work(batches):
        ratio = unpack(shipped)
        for batch in batches:
            for first, column in slices(batch.column("text")):
                total = sum(sums_per_row(ratio[bucket], n) for bucket, n in ngram_buckets(column))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(column)), pa.array(total),
                     *[batch.column(c).slice(first, len(column)) for c in also]], names=["doc_id", "log_weight", *also])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *also).mapInArrow(
        work, ", ".join(["doc_id long, log_weight double", *[f"{c} long" for c in also]]))


def resample(docs, labels, seed=17, k=None, rows=TARGET_ROWS, missed=MISSED, key=None):
    """Sample the documents that look like the labelled good ones.

    Without ``k`` it is the number of documents whose weight reaches the ``missed`` quantile of the
    labelled target documents, so that what looks like the target fits in. Noise follows from
    seed and doc_id; ties of the key go by doc_id.

    Returns doc_id, log_weight, gumbel_key and kept for every row of ``docs`` (doc_id, text).
    Null texts count as empty, repeated rows share their noise, other columns are ignored; without
    labelled target documents everything is kept. ``key`` names a column (long) that tells rows
    apart: it is returned too, decides ties, and gives rows without doc_id their noise."""
    ratio, target = log_ratio(docs, labels, rows)
    weighted = stored(weights_of(docs, ratio, key), "weights")
    if k is None:
        of_target = weighted.join(F.broadcast(target), "doc_id")  # at most ``rows`` ids
        cut = of_target.agg(F.percentile("log_weight", missed)).first()[0]
        k = weighted.count() if cut is None else weighted.where(F.col("log_weight") >= cut).count()
    also = [key] if key else []
    noise = F.xxhash64("doc_id", F.lit(seed))
    if key:
        noise = F.when(F.col("doc_id").isNull(), F.xxhash64(F.col(key), F.lit(seed), F.lit("row"))).otherwise(noise)
    half = F.shiftrightunsigned(noise, 11)
    uniform = (half.cast("double") + 0.5) / float(1 << 53)
    keyed = weighted.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform)))
    ranked = running(keyed, [F.desc("gumbel_key"), F.asc("doc_id"), *[F.asc(c) for c in also]], {"_rank": F.lit(1)}, "keys")
    return ranked.select(*also, "doc_id", "log_weight", "gumbel_key", (F.col("_rank") < k).alias("kept"))
