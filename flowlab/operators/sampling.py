"""Exact, repeatable sampling: class quotas, splits, caps, ranks and shuffles.

Every draw is 'the k rows with the smallest md5 of seed and row id', so it can be
repeated anywhere. Picking the k smallest never sorts a class as a whole: the hash
is uniform, so counting rows per leading hex digits narrows a class down to a
short run of hashes around its k-th smallest, and the rows are then marked by
comparing their hash with the cut-off, without a shuffle of the table itself."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlab.tables import SMALL_ROWS, local_table, ref, settled, ticks

# Hex digits of the first count (256 runs per class) and of every further one.
FIRST_DIGITS = 2
DIGITS_PER_PASS = 3
# Stop narrowing once the run holding the cut-off has at most this many rows.
RUN_ROWS = 65_536
MD5_DIGITS = 32


def order_key(seed, ids):
    """Sortable draw order of a row: md5 of seed and id, then the id itself."""
    texts = [ref(c).cast("string") for c in ids]
    return F.concat_ws(":", F.md5(F.concat_ws(":", F.lit(str(seed)), *texts)), *texts)


def with_stable_id(df, name="row_id"):
    """Id of a row in a Parquet table: its file and its position in that file."""
    return df.withColumn(name, F.concat_ws(
        "#", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string")))


def class_counts(df, label):
    return (df.where(ref(label).isNotNull()).groupBy(ref(label).alias("label"))
            .agg(F.count(F.lit(1)).alias("n")))


def sample_quotas(counts, n, floor=50):
    """Rows to draw per class (label, n, take) for a sample of about ``n`` rows:
    proportional, but at least ``floor`` rows of every class, or all of a smaller one."""
    if n is None:
        return counts.withColumn("take", F.col("n"))
    everything = F.sum("n").over(Window.partitionBy())  # one row per class
    share = F.bround(F.col("n") * (F.lit(float(n)) / everything)).cast("bigint")
    wanted = F.greatest(share, F.least(F.lit(floor).cast("bigint"), F.col("n")))
    return counts.withColumn("take", F.least(F.col("n"), wanted))


def split_quotas(counts, test_size):
    """Training rows per class of a stratified split: the training total is
    N - ceil(N * test_size), shared out proportionally with largest remainders;
    ties go to the class that sorts first."""
    whole = Window.partitionBy()  # one row per class
    total = F.sum("n").over(whole)
    train = total - F.ceil(total * F.lit(float(test_size)))
    exact = (counts.withColumn("total", total).withColumn("train", train)
             .withColumn("product", F.col("n").cast("decimal(19,0)") * F.col("train").cast("decimal(19,0)"))
             .withColumn("base", F.expr("product div total"))
             .withColumn("rest", F.expr("product % total")))
    place = F.row_number().over(whole.orderBy(F.col("rest").desc(), "label"))
    short = F.col("train") - F.sum("base").over(whole)
    return exact.select(
        "label", "n", (F.col("base") + F.when(place <= short, 1).otherwise(0)).alias("take"))


def mark_smallest(df, label, quota, key, flag, among=None, others=False):
    """Add boolean ``flag``: is the row among the ``take`` smallest keys of its class?

    ``quota`` turns class counts (label, n) into (label, n, take); ``among`` limits
    the classes that get one, ``others`` is the flag of the remaining rows."""
    keyed = df.withColumn("_key", key)
    drawn = keyed.where(ref(label).isNotNull() if among is None else among)
    # one pass: rows per class and leading digits give the class counts, the quotas
    # and the run of keys that holds each cut-off
    parts = (drawn.groupBy(ref(label).alias("_class"), F.substring("_key", 1, FIRST_DIGITS).alias("_bucket"))
             .agg(F.count(F.lit(1)).alias("_n")))
    quotas = quota(parts.groupBy(F.col("_class").alias("label")).agg(F.sum("_n").alias("n")))
    upto = Window.partitionBy("_class").orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    place = F.greatest(F.lit(1), F.least("take", "n"))
    runs = (parts.withColumn("_upto", F.sum("_n").over(upto))
            .join(quotas, F.col("_class") == F.col("label"))
            .where((F.col("_upto") >= place) & (F.col("_upto") - F.col("_n") < place))
            .select("label", "n", "take", "_bucket", "_n", (F.col("_upto") - F.col("_n")).alias("_before")))
    rows = runs.limit(SMALL_ROWS + 1).collect()
    if len(rows) > SMALL_ROWS:
        return _mark_by_rank(keyed, drawn, label, quotas, flag, others)
    cuts = [(r["label"], "~" if r["take"] >= r["n"] else "", None) for r in rows
            if r["take"] >= r["n"] or r["take"] <= 0]
    cuts += _cutoffs(drawn, label, [(r["label"], r["_bucket"], int(r["take"] - r["_before"]), r["_n"])
                                    for r in rows if 0 < r["take"] < r["n"]])
    label_type = df.schema[label].dataType.simpleString()
    table = local_table(df.sparkSession, cuts, f"_class {label_type}, _cut string, _ties bigint")
    marked = keyed.join(table, ref(label) == F.col("_class"), "left")
    hit = F.coalesce(F.col("_key") <= F.col("_cut"), F.lit(others))
    helpers = ["_key", "_class", "_cut", "_ties"]
    if all(ties is None for *_, ties in cuts):
        return marked.withColumn(flag, hit).drop(*helpers)
    # an id that repeats at a cut-off: only as many of its rows as the quota has room for
    tied = F.coalesce(F.col("_ties").isNotNull() & (F.col("_key") == F.col("_cut")), F.lit(False))
    place = F.row_number().over(Window.partitionBy("_class").orderBy(F.xxhash64(*ticks(df.columns))))
    return (marked.where(~tied).withColumn(flag, hit).drop(*helpers)
            .unionByName(marked.where(tied).withColumn(flag, place <= F.col("_ties")).drop(*helpers)))


def _cutoffs(keyed, label, runs):
    """(label, cut-off key, ties) from runs (label, key prefix, place in the run, rows). Ties is how
    many rows with the cut-off key itself there is room for, or null if that is all of them."""
    if not runs:
        return []
    spark = keyed.sparkSession
    label_type = keyed.schema[label].dataType.simpleString()
    schema = f"_class {label_type}, _prefix string, _need bigint"
    width = FIRST_DIGITS
    # equal keys stay in one run whatever its width
    while max(n for *_, n in runs) > RUN_ROWS and width < MD5_DIGITS:
        width += DIGITS_PER_PASS
        bucket = F.substring("_key", 1, width)
        upto = Window.partitionBy("_class").orderBy("_bucket").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        counts = (_inside(keyed, label, local_table(spark, [r[:3] for r in runs], schema))
                  .groupBy("_class", "_need", bucket.alias("_bucket"))
                  .agg(F.count(F.lit(1)).alias("_n"))
                  .withColumn("_upto", F.sum("_n").over(upto))
                  .where("_upto >= _need and _upto - _n < _need"))
        runs = [(r["_class"], r["_bucket"], r["_need"] - (r["_upto"] - r["_n"]), r["_n"])
                for r in counts.collect()]
    upto = Window.partitionBy("_class").orderBy("_key").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    last = (_inside(keyed, label, local_table(spark, [r[:3] for r in runs], schema))
            .groupBy("_class", "_need", "_key").agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_upto", F.sum("_n").over(upto))
            .where("_upto >= _need and _upto - _n < _need"))
    return [(r["_class"], r["_key"], None if r["_upto"] == r["_need"] else r["_need"] - (r["_upto"] - r["_n"]))
            for r in last.collect()]


def _inside(keyed, label, runs):
    return keyed.join(runs, ref(label) == F.col("_class")).where(
        F.col("_key").startswith(F.col("_prefix")))


def _mark_by_rank(keyed, drawn, label, quotas, flag, others):
    """Same result for label columns with very many classes: rank within classes."""
    table = quotas.select(F.col("label").alias("_class"), F.col("take").alias("_take"))
    ranked = rank_by_key(drawn, "_key", by=[label], name="_rank").join(table, ref(label) == F.col("_class"))
    cut = ranked.groupBy("_class").agg(F.coalesce(
        F.max(F.when(F.col("_rank") <= F.col("_take"), F.col("_key"))), F.lit("")).alias("_cut"))
    marked = keyed.join(cut, ref(label) == F.col("_class"), "left")
    return marked.withColumn(flag, F.coalesce(F.col("_key") <= F.col("_cut"), F.lit(others))).drop(
        "_key", "_class", "_cut")


def rank_by_key(df, key, by=(), name="rank", rows=None):
    """1-based rank of rows by a uniform hash key, within ``by`` groups.

    Ranks are bucket offset + rank in the bucket, with buckets from the leading hex
    digits of the key, so no window task holds more than about RUN_ROWS rows per group."""
    if rows is None:
        rows = df.count()
    digits = max(0, math.ceil(math.log(max(rows, 1) / RUN_ROWS, 16)))
    groups = [ref(c) for c in by]
    if digits == 0:
        return df.withColumn(name, F.row_number().over(
            Window.partitionBy(*groups).orderBy(key)).cast("bigint"))
    bucketed = df.withColumn("_bucket", F.substring(key, 1, digits))
    names = [f"_by{i}" for i in range(len(by))]
    sizes = (bucketed.groupBy(*[g.alias(n) for g, n in zip(groups, names)], "_bucket")
             .agg(F.count(F.lit(1)).alias("_n")))
    before = Window.partitionBy(*names).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = settled(sizes.select(
        *names, F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    same = F.col("_bucket") == F.col("_b")
    for g, n in zip(groups, names):
        same = same & g.eqNullSafe(F.col(n))
    inside = F.row_number().over(Window.partitionBy(*groups, "_bucket").orderBy(key))
    return (bucketed.join(offsets, same)
            .withColumn(name, F.col("_offset") + inside)
            .drop("_bucket", "_b", "_offset", *names))


def stratified_sample(df, label, ids, n, floor=50, seed=0):
    """About ``n`` rows, every class in proportion but with at least ``floor`` rows."""
    if n is None:
        return df
    marked = mark_smallest(df, label, lambda counts: sample_quotas(counts, n, floor),
                           order_key(seed, ids), "_drawn")
    return marked.where("_drawn").drop("_drawn")


def stratified_split(df, label, ids, test_size, seed=0, flag="is_train"):
    """Mark every row as training or test row; both parts keep the class mix.
    Rows without a label belong to neither part and are left out."""
    labelled = df.where(ref(label).isNotNull())
    return mark_smallest(labelled, label, lambda counts: split_quotas(counts, test_size),
                         order_key(f"split{seed}", ids), flag)


def cap_per_class(df, label, ids, cap, seed=0):
    """At most ``cap`` rows of every class, all rows of smaller ones."""
    labelled = df.where(ref(label).isNotNull())
    marked = mark_smallest(labelled, label, lambda counts: at_most(counts, cap), order_key(seed, ids), "_kept")
    return marked.where("_kept").drop("_kept")


def undersample(df, label, ids, target, keep, seed=0):
    """Cut one class down to exactly ``keep`` rows if it has more; others stay whole."""
    marked = mark_smallest(df, label, lambda counts: at_most(counts, keep), order_key(seed, ids), "_kept",
                           among=ref(label) == F.lit(target), others=True)
    return marked.where("_kept").drop("_kept")


def at_most(counts, cap):
    return counts.withColumn("take", F.least(F.col("n"), F.lit(cap).cast("bigint")))


def take_rows(df, chosen, ids):
    """Keep the rows whose id is in ``chosen``."""
    return df.join(chosen.select(*ids), list(ids), "left_semi")


def permute_column(df, column, ids, seed=0):
    """Shuffle one column over the whole table and leave the others in place: row
    ranks by two independent hash orders pair every row with another row's value."""
    rows = df.count()
    stays = rank_by_key(df.withColumn("_key", order_key("stay", ids)), "_key",
                        name="_rank", rows=rows).drop("_key", column)
    moves = rank_by_key(df.select(*ids, ref(column)).withColumn("_key", order_key(f"move{seed}", ids)),
                        "_key", name="_rank", rows=rows).select("_rank", ref(column))
    return stays.join(moves, "_rank").drop("_rank").select(*df.columns)
