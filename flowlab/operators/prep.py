"""Preprocessing whose statistics come from the training rows only."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlab.tables import number, ref, settled, tick, ticks


def column_statistics(train, features, filled=False):
    """Mean and population deviation of every feature, as plain Python numbers: one
    aggregate over the training rows, a few values per feature.

    With ``filled`` the deviation is the one after missing values were replaced by
    the mean: they then add rows, but nothing to the squared distances."""
    cells = [f"struct(avg({t}) AS mean, stddev_pop({t}) AS spread, count({t}) AS n)" for t in ticks(features)]
    row = train.selectExpr("count(1) AS rows", *cells).first()
    means, spreads = {}, {}
    for c, cell in zip(features, row[1:]):
        means[c], spread = cell["mean"], cell["spread"]
        spreads[c] = spread * (cell["n"] / row["rows"]) ** 0.5 if filled and spread else spread
    return means, spreads


def fill_values(train, features, strategy="mean"):
    """Replacement for missing values; a feature without any value gets 0."""
    if strategy == "mean":
        values, _ = column_statistics(train, features)
    elif strategy == "median":
        from flowlab.operators.quantiles import group_medians

        rows = group_medians(train, features).collect()
        values = {r["feature"]: r["median"] for r in rows}
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    return {c: 0.0 if values.get(c) is None else float(values[c]) for c in features}


def replaced(df, texts):
    """Replace columns by SQL texts: {column: text}; all other columns stay."""
    return df.selectExpr(*[f"{texts[c]} AS {tick(c)}" if c in texts else tick(c) for c in df.columns])


def _filled(c, value):
    return f"coalesce(cast({tick(c)} AS double), {number(value)})"


def _scaled(text, mean, spread):
    return f"({text} - {number(mean)}) / {number(spread)}" if spread else number(0)


def impute(df, fills):
    """Replace missing values by fixed numbers."""
    return replaced(df, {c: _filled(c, v) for c, v in fills.items()})


def scale(df, means, spreads):
    """(x - mean) / population deviation; a constant feature becomes 0."""
    return replaced(df, {c: _scaled(tick(c), m, spreads[c]) for c, m in means.items()})


def prepare(train, frames, features, scaled=True, strategy="mean"):
    """Impute, and optionally standardise, several frames with statistics of ``train``."""
    if strategy == "mean":
        means, spreads = column_statistics(train, features, filled=True)
        fills = {c: 0.0 if m is None else float(m) for c, m in means.items()}
    else:
        fills = fill_values(train, features, strategy)
        means, spreads = column_statistics(impute(train, fills), features) if scaled else (None, None)
    if not scaled:
        return [impute(f, fills) for f in frames]
    centres = fills if strategy == "mean" else means
    texts = {c: _scaled(_filled(c, fills[c]), centres[c], spreads[c]) for c in features}
    return [replaced(f, texts) for f in frames]


def vector_of(df, features, name="features"):
    """Assemble feature columns into one vector column."""
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(features), outputCol=name).transform(df)


def label_codes(df, label):
    """Sorted class vocabulary with codes 0..K-1."""
    names = df.where(ref(label).isNotNull()).select(ref(label).alias("label")).distinct()
    code = F.dense_rank().over(Window.partitionBy().orderBy("label")) - 1  # one row per class
    return names.select("label", code.cast("int").alias("code"))


def encode_label(df, label, codes=None, name="code"):
    """Add the class code. The vocabulary is broadcast once its size is known."""
    table = settled(label_codes(df, label) if codes is None else codes)
    table = table.select(F.col("label").alias("_class"), F.col("code").alias(name))
    return df.join(table, ref(label) == F.col("_class"), "left").drop("_class")


def class_weights(df, label):
    """Balanced weights: N / (K * rows of the class). Rows without a label belong to no class."""
    counts = df.where(ref(label).isNotNull()).groupBy(ref(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy()  # one row per class
    return counts.select("label", "n", (
        F.sum("n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("n"))).alias("weight"))


def with_class_weight(df, label, name="weight"):
    table = settled(class_weights(df, label)).select(
        F.col("label").alias("_class"), F.col("weight").alias(name))
    return df.join(table, ref(label) == F.col("_class")).drop("_class")


def ablation_sets(features, drop_lists):
    """Feature lists per named drop list; names that are not there are ignored."""
    return {name: [f for f in features if f not in set(gone)] for name, gone in drop_lists.items()}


def downcast(df, features):
    return replaced(df, {c: f"cast({tick(c)} AS float)" for c in features})
