"""How many test rows also occur in the training rows, and what that is worth."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from flowlab.operators.metrics import classification_summary
from flowlab.tables import all_of, ref, settled

# Copies from which a record of the test side is dealt over several tasks of a join, and the share of
# the test side that is needed besides (so that there are at most twice as many such records).
HOT_ROWS, HOT_SHARE = 100_000, 50_000


def record_sides(df, key_columns, is_train="is_train", carry=()):
    """Per distinct record: copies among the training and among the test rows.

    One map-side aggregate instead of a join: a record that fills a third of the
    table reaches its reducer as one row per task. Missing equals missing."""
    train = ref(is_train)
    return df.groupBy(*[ref(c) for c in [*key_columns, *carry]]).agg(
        F.count_if(train).alias("n_train"), F.count_if(~train).alias("n_test"))


def leaked_share(df, key_columns, is_train="is_train"):
    """Test rows, leaked test rows and their share."""
    leaked = F.sum(F.when(F.col("n_train") > 0, F.col("n_test")).otherwise(0))
    return record_sides(df, key_columns, is_train).agg(
        F.sum("n_test").alias("n_test"), leaked.alias("n_leaked")).select(
        "n_test", "n_leaked",
        F.coalesce(F.try_divide("n_leaked", "n_test"), F.lit(0.0)).alias("leaked_share"))


def _same(left_names, right_names):
    return all_of([ref(a).eqNullSafe(ref(b)) for a, b in zip(left_names, right_names)])


def heavy_hitters(df, key, capacity):
    """key, n: every 64-bit ``key`` that more than one in ``capacity`` rows have, with at least its number
    of rows less one in ``capacity``; keys below may be among them.

    Every task keeps a summary of at most ``capacity`` counters (Misra-Gries): when there are more, the
    count of the first one too many is taken off all and empty ones go. Counters of a key are added up over
    the tasks; what each task took off adds up to no more than one in ``capacity`` of all rows."""
    def summarise(batches):
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for pdf in batches:
            new, n = np.unique(pdf["key"].to_numpy(np.int64), return_counts=True)
            keys, place = np.unique(np.append(keys, new), return_inverse=True)
            counts = np.bincount(place, np.append(counts, n), minlength=len(keys)).astype(np.int64)
            if len(keys) > capacity:
                counts -= np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1]
                keys, counts = keys[counts > 0], counts[counts > 0]
        yield pd.DataFrame({"key": keys, "n": counts})

    return (df.select(key.alias("key")).mapInPandas(summarise, "key bigint, n bigint")
            .groupBy("key").agg(F.sum("n").alias("n")))


def flag_leaked(test, train, key_columns, flag="leaked", hot_rows=HOT_ROWS):
    """Row-level flag: does the test row occur among the training rows?

    The training side is reduced to distinct records first. The join runs on a
    64-bit hash, and all columns are compared as well, so a hash collision cannot
    count. Records with many copies on the test side are found by a summary of bounded
    size; their rows are dealt over several parts of the join by number, and only
    their training records are repeated, once a part."""
    names = [f"_k{i}" for i in range(len(key_columns))]
    known = train.select(*[ref(c).alias(n) for c, n in zip(key_columns, names)]).distinct().withColumn(
        "_mark", F.xxhash64(*names)).withColumn("_hit", F.lit(True))
    probe = test.withColumn("_probe", F.xxhash64(*[ref(c) for c in key_columns]))
    rows = test.count()
    hot_rows = max(hot_rows, rows // HOT_SHARE)
    capacity = max(1, 2 * rows // hot_rows)
    # less than 2 * rows / hot_rows keys can have half as many rows, which is at most 2 * HOT_SHARE
    often = settled(heavy_hitters(probe, F.col("_probe"), capacity).where(2 * F.col("n") >= hot_rows).select(
        F.col("key").alias("_often"), F.ceil(F.col("n") / hot_rows + 1).cast("int").alias("_parts")))
    if often.isEmpty():
        probe, known = probe.withColumn("_part", F.lit(0)), known.withColumn("_part", F.lit(0))
    else:
        seat = F.pmod(F.monotonically_increasing_id(), F.coalesce("_parts", F.lit(1))).cast("int")
        probe = probe.join(often, F.col("_probe") == F.col("_often"), "left").withColumn("_part", seat).drop("_often", "_parts")
        known = known.join(often, F.col("_mark") == F.col("_often"), "left").withColumn(
            "_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_often", "_parts")
    known = known.withColumnRenamed("_part", "_seat")
    same = (F.col("_probe") == F.col("_mark")) & (F.col("_part") == F.col("_seat")) & _same(key_columns, names)
    return (probe.join(known, same, "left")
            .withColumn(flag, F.coalesce("_hit", F.lit(False)))
            .drop("_probe", "_part", "_mark", "_seat", "_hit", *names))


def scored_segments(scored, key_columns, label="label", prediction="prediction",
                    is_train="is_train"):
    """Confusion counts of the test rows, split into leaked and unseen records.

    A prediction depends on the features only, so all copies of a record carry
    the same one and the counts per record are enough."""
    sides = record_sides(scored, key_columns, is_train, carry=[prediction])
    return (sides.where("n_test > 0")
            .groupBy(ref(label).alias("label"), ref(prediction).alias("prediction"),
                     (F.col("n_train") > 0).alias("leaked"))
            .agg(F.sum("n_test").alias("n")))


def segment_metrics(segments, n_classes=None):
    """Accuracy and macro F1 overall, on leaked and on unseen rows.

    Overall macro F1 averages the classes that occur; on a segment it averages all
    ``n_classes``. An empty segment has no rows and no scores."""
    overall = classification_summary(
        segments.groupBy("label", "prediction").agg(F.sum("n").alias("n")))
    parts = classification_summary(segments, by=["leaked"], n_classes=n_classes)
    named = parts.withColumn("segment", F.when(F.col("leaked"), "leaked").otherwise("unseen"))
    keep = ["segment", "n", "accuracy", "macro_f1"]
    both = overall.select(F.explode(F.array(F.lit("leaked"), F.lit("unseen"))).alias("segment"))
    return both.join(named, "segment", "left").fillna(0, ["n"]).select(*keep).unionByName(
        overall.withColumn("segment", F.lit("overall")).select(*keep))


def leakage_summary(segments):
    """Leaked share, memorisation gap and its contribution to overall accuracy."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    seen = F.col("leaked")

    def accuracy(side):
        return F.try_divide(F.sum(F.when(side, hit)), F.sum(F.when(side, F.col("n"))))

    row = segments.agg(
        F.sum("n").alias("n_test"),
        F.coalesce(F.sum(F.when(seen, F.col("n"))), F.lit(0)).alias("n_leaked"),
        accuracy(F.lit(True)).alias("accuracy_overall"),
        accuracy(seen).alias("accuracy_leaked"), accuracy(~seen).alias("accuracy_unseen"))
    share = F.try_divide("n_leaked", "n_test")
    gap = F.col("accuracy_leaked") - F.col("accuracy_unseen")
    return row.select("*", share.alias("leaked_share"), gap.alias("gap"),
                      (gap * share).alias("contribution"))
