"""Exact order statistics and rank sums that never sort one group in one task.

An order statistic is found by histograms that get finer level by level. The first level cuts values by
their order of magnitude, the following ones cut the cell that holds the wanted rank evenly between its
smallest and largest value, until a cell is a single value. A level is one pass that counts rows per
cell on the map side; nothing is approximated and no number of cells grows with the rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlab.session import dropped, materialised
from flowlab.tables import SMALL_ROWS, ref, settled, spread, tick, ticks

# Rows up to which a built-in aggregate may hold all values of a group.
ROWS_PER_BUCKET = 1_000_000
# Cells of the first level per doubling of a value, and of every following level.
OCTAVE, CELLS = 64, 4096
# Above the largest code of a finite double (powers from -1074 to 1024).
BEYOND = 1200 * OCTAVE


def long_form(df, keep, features):
    """keep..., feature, value with one row per present value."""
    cells = [F.struct(F.lit(f).alias("feature"), ref(f).cast("double").alias("value")) for f in features]
    return df.select(*keep, F.inline(F.array(*cells))).where("value is not null")


def magnitude(value):
    """A whole number that grows with the value: its sign and the cell of its order of magnitude."""
    size = F.when(F.abs(value) == float("inf"), F.lit(BEYOND)).otherwise(
        F.floor(F.log2(F.when(F.abs(value) == float("inf"), F.lit(1.0)).otherwise(F.abs(value))) * OCTAVE)) + BEYOND
    return F.when(value == 0, 0).when(value > 0, size).otherwise(-size).cast("int")


def _held(df):
    """A table evaluated once: local and marked for broadcast if it is small, else written."""
    small = settled(df, SMALL_ROWS)
    return materialised(df, "ranks") if small is df else small


def _cells(values, keys, cell):
    """Per key and cell: the rows in it and before it, its smallest and largest value."""
    before = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    return (values.groupBy(*keys, cell.alias("cell"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
            .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))


def _holds(rank="rank"):
    return (F.col(rank) > F.col("before")) & (F.col(rank) <= F.col("before") + F.col("n"))


def order_statistics(values, keys, ranks):
    """keys..., rank, value: the ``ranks`` smallest values per key of a long table (keys..., value).

    ``ranks`` are columns over ``total``, the number of values of a key, counted from 1; a rank beyond
    the total gives no row. Ties take their ranks one after the other. Missing keys are keys."""
    keys = list(keys)
    same = [F.col(k).eqNullSafe(F.col("_" + k)) for k in keys]
    renamed = [F.col(k).alias("_" + k) for k in keys]
    first = _held(_cells(values, keys, magnitude(F.col("value"))))
    totals = first.groupBy(*keys).agg(F.sum("n").alias("total"))
    wanted = totals.select(*renamed, F.explode(F.array(*ranks)).alias("wanted")).distinct()
    found = _held(first.join(wanted, same).where(_holds("wanted")).select(
        *keys, F.col("wanted").alias("rank"), (F.col("wanted") - F.col("before")).alias("inside"), "low", "high"))
    while not found.where("low < high").isEmpty():
        open_cells = _held(found.where("low < high").select(*renamed, F.col("low").alias("_low"), F.col("high").alias("_high")).distinct())
        part = values.join(open_cells, [*same, F.col("value").between(F.col("_low"), F.col("_high"))])
        # values of a cell have one sign and nearly one magnitude, so the width can't overflow
        share = (F.col("value") - F.col("_low")) / (F.col("_high") - F.col("_low"))
        finer = _cells(part, [*keys, "_low", "_high"], F.least(F.floor(share * CELLS), F.lit(CELLS - 1)).cast("int"))
        finer = finer.select(*renamed, "_low", "_high", "n", "before", F.col("low").alias("_from"), F.col("high").alias("_to"))
        inside = [*same, F.col("low") == F.col("_low"), F.col("high") == F.col("_high")]
        found = _held(found.join(finer, inside, "left").where("_from is null or (inside > before and inside <= before + n)").select(
            *keys, "rank", (F.col("inside") - F.coalesce("before", F.lit(0))).alias("inside"),
            F.coalesce("_from", "low").alias("low"), F.coalesce("_to", "high").alias("high")))
    return found.select(*keys, "rank", F.col("low").alias("value"))


def group_medians(df, features, group=None, rows_per_bucket=ROWS_PER_BUCKET):
    """Exact median per group and feature: group, feature, median.

    Tables of at most ``rows_per_bucket`` rows use the built-in aggregate, which holds all values of a
    group; larger ones the two middle order statistics."""
    rows = df.count()
    keep = [] if group is None else [ref(group).alias("group")]
    keys = [] if group is None else ["group"]
    if rows <= rows_per_bucket:
        cells = [F.struct(F.lit(f).alias("feature"), F.median(ref(f).cast("double")).alias("median"))
                 for f in features]
        return (df.groupBy(*keep).agg(F.array(*cells).alias("cells"))
                .select(*keys, F.inline("cells")))
    middle = [F.floor((F.col("total") + k) / 2).cast("bigint") for k in (1, 2)]
    found = order_statistics(long_form(df, keep, features), [*keys, "feature"], middle)
    return found.groupBy(*keys, "feature").agg(F.avg("value").alias("median"))


def pair_rank_sums(df, label, base, features, rows_per_bucket=ROWS_PER_BUCKET):
    """Per class and feature: how often a class value beats a base value, ties half.

    Values are first reduced to counts (class, feature, value), which one scan of the rows gives. The
    number of base values below is a running count over a feature's values: they are cut into ranges of
    about ``rows_per_bucket`` values, counted inside their range, and the counts of whole lower ranges are
    added. Result: class, feature, n, n_base, wins2 (twice the wins, an exact whole number), lowest,
    highest."""
    values = long_form(spread(df.select(tick(label), *ticks(features))), [ref(label).alias("class")], features)
    is_base = F.col("class") == F.lit(base)
    # written once: drawing the ranges reads them before they are dealt
    counts = materialised(values.groupBy("class", "feature", "value").agg(F.count(F.lit(1)).alias("n")), "counts")
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-df.count() // rows_per_bucket))
    # written once: the ranges must not be drawn anew; equal values are in one range
    table = materialised(counts.withColumn("base", F.when(is_base, F.col("n")).otherwise(0))
                         .repartitionByRange(ranges, "feature", "value").withColumn("range", F.spark_partition_id()), "values")
    dropped(counts)
    # sums up to a value take in all classes' rows of that value
    ordered = Window.partitionBy("feature", "range").orderBy("value")
    upto = F.sum("base").over(ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    equal = F.sum("base").over(ordered.rangeBetween(Window.currentRow, Window.currentRow))
    lower = Window.partitionBy("feature").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per feature and range
    under = settled(table.groupBy("feature", "range").agg(F.sum("base").alias("n")).select(
        "feature", "range", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("under")))
    ranked = table.withColumns({"upto": upto, "equal": equal}).where(~is_base).join(under, ["feature", "range"])
    # base values below plus base values not above = twice the wins
    twice = 2 * (F.col("under") + F.col("upto")) - F.col("equal")
    return _with_base(
        ranked.groupBy("class", "feature")
        .agg(F.sum("n").alias("n"), F.sum(F.col("n") * twice).alias("wins2"),
             F.min("value").alias("lowest"), F.max("value").alias("highest")),
        table.where("base > 0").groupBy("feature").agg(
            F.sum("base").alias("n_base"), F.min("value").alias("base_low"),
            F.max("value").alias("base_high")))


def _with_base(sums, base):
    return sums.join(base, "feature").select(
        "class", "feature", "n", "n_base", "wins2",
        F.least("lowest", "base_low").alias("lowest"),
        F.greatest("highest", "base_high").alias("highest"))
