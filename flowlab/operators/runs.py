"""Analytics over experiment run tables: plans, resume, upsert, pivots, bests, gains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlab.functions.scalars import GAMMA_KERNELS, gamma_label, ordinal
from flowlab.tables import all_of, ref, value_of


def runs_todo(plan, done, keys):
    """Planned runs without a result."""
    return plan.join(done.select(*keys).distinct(), list(keys), "left_anti")


def upsert_runs(old, new, keys):
    """New rows replace old rows with the same key; other old rows stay."""
    kept = old.join(new.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def union_drift(frames):
    """Stack run tables whose columns differ; absent columns are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def grid_plan(axes, components="components", kernel="kernel", gamma="gamma"):
    """All combinations of the value lists in the one-row table ``axes``.

    Runs without components have no kernel, and only some kernels have a gamma, so
    those combinations collapse before they are spelled out, not afterwards. An
    axis value list explodes inside a row; nothing is joined."""
    plan = axes
    others = [c for c in axes.columns if c not in (components, kernel, gamma)]
    plan = plan.select(*others, kernel, gamma, F.explode(components).alias(components))
    none = F.array(F.lit("none"))
    plan = plan.select(*others, components, gamma, F.explode(
        F.when(F.col(components) > 0, F.col(kernel)).otherwise(none)).alias(kernel))
    no_gamma = F.array(F.lit(None).cast("double"))
    plan = plan.select(*others, components, kernel, F.explode(
        F.when(F.col(kernel).isin(*GAMMA_KERNELS), F.col(gamma)).otherwise(no_gamma)).alias(gamma))
    for c in others:
        plan = plan.withColumn(c, F.explode(c))
    return plan.withColumn("gamma_label", gamma_label(F.col(kernel), F.col(gamma)))


def full_grid(axes):
    """Every combination of the value lists in a one-row table."""
    plan = axes
    for c in axes.columns:
        plan = plan.withColumn(c, F.explode(c))
    return plan


def best_per_group(df, group, metric, ties=()):
    """The row with the largest metric per group; on ties the first by ``ties``.

    A struct minimum is combined map-side, so a hot group costs one row per task."""
    rest = [c for c in df.columns if c not in group]
    first = F.min(F.struct((-ref(metric)).alias("_m"), *[ref(c).alias(f"_t{i}") for i, c in enumerate(ties)],
                           F.struct(*[ref(c) for c in rest]).alias("_row")))
    found = df.where(ref(metric).isNotNull()).groupBy(*[ref(c) for c in group]).agg(first.alias("_best"))
    return found.select(*[ref(c) for c in group],
                        *[F.col("_best._row").getField(c).alias(c) for c in rest])


def pivot_metric(df, rows, column, values, metric, agg="avg", digits=None):
    """rows x column table of an aggregated metric, columns in the given order."""
    measure = getattr(F, agg)(ref(metric))
    out = df.groupBy(*[ref(c) for c in rows]).pivot(column, list(values)).agg(measure)
    if digits is None:
        return out
    return out.select(*[ref(c) for c in rows], *[F.round(ref(str(v)), digits).alias(str(v)) for v in values])


def complete_pivot(df, rows, column, values, metric):
    """Pivot restricted to complete rows, with mean, lowest, highest and span."""
    cells = [ref(str(v)) for v in values]
    wide = pivot_metric(df, rows, column, values, metric).where(
        all_of([c.isNotNull() for c in cells]))
    mean = reduce(lambda a, b: a + b, cells) / len(cells)
    low, high = F.least(*cells), F.greatest(*cells)
    return wide.withColumns({"mean": mean, "lowest": low, "highest": high, "span": high - low})


def pivot_delta(df, rows, column, base, other, metric):
    """Change of a metric from one column value to another."""
    wide = pivot_metric(df, rows, column, [base, other], metric)
    return wide.select(*[ref(c) for c in rows], ref(base).alias("base"), ref(other).alias("other"),
                       (ref(other) - ref(base)).alias("delta"))


def best_reduced(grid, metric="macro_f1", by=("classifier",)):
    """Best setting per classifier among the runs with components."""
    reduced = grid.where("components > 0")
    return best_per_group(reduced, list(by), metric, ties=["kernel", "components", "test_size"])


def best_vs_baseline(grid, metric="macro_f1"):
    """Best reduced run next to the unreduced run of the same classifier and test
    size; the first baseline run is taken if there are several."""
    best = best_reduced(grid, metric).select(
        "classifier", "test_size", "kernel", "components", F.col(metric).alias("best"))
    base = (grid.where("components = 0").groupBy("classifier", "test_size")
            .agg(F.max(metric).alias("baseline")))
    return best.join(base, ["classifier", "test_size"])


def gain_same_split(grid, metric="macro_f1"):
    return best_vs_baseline(grid, metric).withColumn("gain", F.col("best") - F.col("baseline"))


def gain_of_best(grid, metric="macro_f1", by=("classifier",)):
    """Best reduced minus best unreduced run, whatever their test sizes."""
    value = ref(metric)
    return grid.groupBy(*by).agg(
        F.max(F.when(F.col("components") > 0, value)).alias("best"),
        F.max(F.when(F.col("components") == 0, value)).alias("baseline")).withColumn(
        "gain", F.col("best") - F.col("baseline"))


def gain_over_mean(grid, metric="macro_f1"):
    """Best setting per classifier next to the mean unreduced score, which may be
    missing."""
    mean = grid.where("components = 0").groupBy("classifier").agg(F.avg(metric).alias("baseline"))
    best = best_reduced(grid, metric).select(
        "classifier", "kernel", "components", "test_size", F.col(metric).alias("best"))
    return best.join(mean, "classifier", "left").withColumn("gain", F.col("best") - F.col("baseline"))


def gain_stability(gains, group="classifier", gain="gain"):
    """Mean gain over repeated samples and whether its sign never changes."""
    return gains.groupBy(ref(group)).agg(
        F.count(ref(gain)).alias("samples"), F.avg(ref(gain)).alias("mean_gain"),
        (F.min(F.signum(ref(gain))) == F.max(F.signum(ref(gain)))).alias("same_sign"))


def pick_protocol(df, column="sample", preferred="full"):
    """Rows of the most complete protocol: most rows, then the preferred one, then
    the first by name."""
    counts = df.groupBy(ref(column).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    winner = counts.orderBy(F.col("n").desc(), (F.col("key") == preferred).desc(), "key").limit(1)
    text = F.when(ref(column).cast("string") == preferred, "Full dataset").otherwise(
        F.concat(F.format_number(ref(column).cast("string").try_cast("bigint"), 0),
                 F.lit("-flow stratified sample")))
    return df.where(ref(column).cast("string") == value_of(winner, "key")).withColumn("protocol", text)


def custom_order(df, orders):
    """Add sort ranks for columns with a fixed value order: {column: [values]}."""
    return df.withColumns({f"{c}_rank": ordinal(ref(c), values) for c, values in orders.items()})


def top_rows(df, order, k):
    return df.orderBy(*order).limit(k)


def pick_list_top(df, column, picks, order):
    """First row per picked value, in the order of the list."""
    place = ordinal(ref(column), picks)
    first = F.row_number().over(Window.partitionBy(ref(column)).orderBy(*order))
    return (df.withColumn("place", place).where("place is not null")
            .withColumn("_first", first).where("_first = 1").drop("_first"))


def parameter_counts(df, group, parameter, unset="-"):
    """Number of distinct settings per group; more than one means it was tuned."""
    set_value = F.when(ref(parameter) != unset, ref(parameter))
    return df.groupBy(*[ref(c) for c in group]).agg(
        F.countDistinct(set_value).alias("settings"), F.count(F.lit(1)).alias("runs"),
        (F.countDistinct(set_value) > 1).alias("tuned"))


def relabelled(df, column, text):
    """Wrap a value in a text: value -> 'Kernel PCA (value)' for text 'Kernel PCA (%s)'."""
    return df.withColumn(column, F.format_string(text, ref(column)))


def sheet_tables(runs, kernels, classifiers, names):
    """The four tables of a kernel x classifier run sheet."""
    from flowlab.functions.scalars import display_name

    ordered = custom_order(runs, {"kernel": kernels, "classifier": classifiers})
    best = best_per_group(runs, ["classifier"], "macro_f1", ["test_size", "kernel"])
    return {
        "runs": ordered.select("test_size", "kernel", "classifier", "accuracy", "macro_f1"),
        "detail": ordered,
        "best": best.withColumn("name", display_name(F.col("classifier"), names)),
        "kernel_by_classifier": pivot_metric(runs, ["classifier"], "kernel", kernels, "macro_f1", digits=4),
    }
