"""Whole experiments: compositions of the operators, one run table each.

The driver loops over runs (models, reductions, feature sets); the rows of a run
are only ever handled by executors. What comes back per run are confusion counts."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from flowlab.operators import (importance, leakage, metrics, models, neighbors, prep, reduce,
                               runs, sampling, separability)
from flowlab.operators.discriminant import lda_reduce
from flowlab.operators.audit import dedupe, duplicate_share_features
from flowlab.session import materialised
from flowlab.tables import local_table, ref, settled, tick

RUN_METRICS = ("accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_precision",
               "weighted_recall", "weighted_f1")


def score_run(scored, label):
    """Confusion counts of a run, evaluated once, and the seconds that took. They are
    at most classes x classes rows."""
    start = time.time()
    counts = settled(metrics.confusion_counts(scored, label))
    return counts, time.time() - start


def summarise(counts, classes=None):
    """Metric numbers of a run, with recall and F1 of the given classes."""
    return metrics.run_metrics(counts, classes=classes).first().asDict()


def attempt(record, work):
    """A run that fails keeps its row, with the error as status, and stops nothing."""
    try:
        record.update(work())
        record["status"] = "ok"
    except Exception as error:  # any failure of one run is that run's result
        record.update({m: None for m in RUN_METRICS})
        record["status"] = f"{type(error).__name__}: {str(error)[:200]}"
    return record


RUN_SCHEMA = ("model string, split string, test_size double, sample string, n_train bigint, n_test bigint, "
              + ", ".join(f"{m} double" for m in RUN_METRICS)
              + ", fit_seconds double, pred_seconds double, flows_per_sec bigint, status string")


def append_run(spark, path, record, schema):
    """Add one finished run to a run table on disk: what ran before a crash is kept."""
    spark.createDataFrame([record], schema).coalesce(1).write.mode("append").parquet(path)


def saved_runs(spark, path, schema):
    """The run table on disk, or an empty one if no run was saved yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _run_schema(classes):
    """The run columns with recall and F1 of every class."""
    return RUN_SCHEMA + "".join(f", {tick(f'{m}::{c}')} double" for m in ("recall", "f1") for c in classes)


def compare_classifiers(df, label, ids, features, names=None, test_sizes=(0.2, 0.4, 0.6), sample=None,
                        floor=50, done=None, options=None, seed=0, table=None):
    """Every model on every test size, on the same splits, with recall and F1 of every
    class. Runs found in ``done`` (a run table) are skipped; new rows replace old rows of
    the same run. With ``table`` (a path) every run is appended there when it ends, and
    a restarted study skips the runs that ended well; the last row of a run counts."""
    spark = df.sparkSession
    options = options or {}
    names = models.SWEEP if names is None else names
    unknown = [n for n in names if n not in models.REGISTRY]
    if unknown:
        raise ValueError(f"unknown models: {unknown}")
    drawn = sampling.stratified_sample(df, label, ids, sample, floor, seed)
    key = str(sample or "full")
    every_class = models.class_list(drawn, label)
    schema = _run_schema(every_class)
    rows = []
    if table is not None:
        rows = [r.asDict() for r in saved_runs(spark, table, schema).where(
            (F.col("sample") == key) & (F.col("status") == "ok")).toLocalIterator()]
    finished = {(r["model"], r["test_size"]) for r in rows}
    if done is not None:
        finished |= {(r["model"], r["test_size"]) for r in
                     done.where(F.col("sample") == key).select("model", "test_size").collect()}
    for test_size in test_sizes:
        todo = [n for n in names if (n, test_size) not in finished]
        if not todo:
            continue
        parts = materialised(sampling.stratified_split(drawn, label, ids, test_size))
        train, test = parts.where("is_train"), parts.where("not is_train")
        sizes = parts.agg(F.count_if("is_train").alias("train"), F.count_if(~F.col("is_train")).alias("test")).first()
        classes = models.class_list(train, label)
        # filled and scaled once per split, for all models that want it so
        ready = {scaled: prep.prepare(train, [train, test], features, scaled)
                 for scaled in {models.REGISTRY[n].scaled for n in todo}}
        for name in todo:
            percent = round((1 - test_size) * 100)
            record = {"model": name, "split": f"{percent}/{round(test_size * 100)}", "test_size": test_size,
                      "sample": key, "n_train": sizes["train"], "n_test": sizes["test"],
                      "fit_seconds": None, "pred_seconds": None, "flows_per_sec": None}

            def work(name=name, ready=ready, sizes=sizes, classes=classes):
                start = time.time()
                scored = models.fit_predict(name, *ready[models.REGISTRY[name].scaled], label, ids, features,
                                            classes, prepared=True, **options.get(name, {}))
                fit = time.time() - start
                counts, seconds = score_run(scored, label)
                summary = summarise(counts, every_class)
                summary.pop("n")
                return {**summary, "fit_seconds": round(fit, 2),
                        "pred_seconds": round(seconds, 2),
                        "flows_per_sec": int(sizes["test"] / seconds) if seconds > 0 else 0}

            rows.append(attempt(record, work))
            if table is not None:
                append_run(spark, table, rows[-1], schema)
    fresh = spark.createDataFrame(rows, schema)
    return fresh if done is None else runs.upsert_runs(done, fresh, ["model", "split", "sample"])


GRID_SCHEMA = ("test_size double, method string, kernel string, gamma_label string, gamma double, classifier string, "
               "components int, n_train bigint, n_test bigint, " + ", ".join(f"{m} double" for m in RUN_METRICS)
               + ", clf_seconds double, reduction_seconds double, status string")


def reduction_grid(df, label, ids, features, plan, classifiers, sample=None, floor=50, seed=0,
                   options=None, landmarks=reduce.LANDMARKS, table=None):
    """Reduce, then classify, for every (test size, method, kernel, gamma, components)
    of ``plan``; ``method`` is none, kpca, pca or lda. Each reduction is computed
    once, kept, and shared by all classifiers. The split does not change with the seed.
    With ``table`` (a path) every run is appended there when it ends."""
    spark = df.sparkSession
    options = options or {}
    drawn = sampling.stratified_sample(df, label, ids, sample, floor, seed)
    rows = []
    by_size = {}
    for step in plan:
        by_size.setdefault(step["test_size"], []).append(step)
    for test_size, steps in by_size.items():
        parts = materialised(sampling.stratified_split(drawn, label, ids, test_size))
        train, test = parts.where("is_train"), parts.where("not is_train")
        n_train, n_test = train.count(), test.count()
        classes = models.class_list(train, label)
        train, test = prep.prepare(train, [train, test], features)
        for step in steps:
            kernel, gamma = step.get("kernel", "none"), step.get("gamma")
            method, k = step["method"], step["components"]
            start = time.time()
            record = {"test_size": test_size, "method": method, "kernel": kernel, "components": k,
                      "gamma_label": gamma_text(kernel, gamma),
                      "gamma": (gamma if gamma is not None else 1.0 / len(features)) if kernel in reduce.KERNELS
                      and kernel not in ("linear", "cosine") else None,
                      "n_train": n_train, "n_test": n_test}
            try:
                frames, names = _reduced(method, train, test, label, ids, features, kernel, k, gamma, landmarks)
            except Exception as error:  # the runs of a failed reduction fail with it
                for clf in classifiers:
                    rows.append({**record, "classifier": clf, **{m: None for m in RUN_METRICS},
                                 "clf_seconds": None, "reduction_seconds": None,
                                 "status": f"{type(error).__name__}: {str(error)[:200]}"})
                continue
            frames = [f.persist() for f in frames]
            took = time.time() - start
            for clf in classifiers:
                def work(clf=clf, frames=frames, names=names):
                    begin = time.time()
                    scored = models.fit_predict(clf, *frames, label, ids, names, classes, prepared=True,
                                                **options.get(clf, {}))
                    counts, _ = score_run(scored, label)
                    summary = summarise(counts)
                    return {**{m: round(summary[m], 4) for m in RUN_METRICS},
                            "clf_seconds": round(time.time() - begin, 1)}

                rows.append(attempt({**record, "classifier": clf, "clf_seconds": None,
                                     "reduction_seconds": round(took, 1)}, work))
                if table is not None:
                    append_run(spark, table, rows[-1], GRID_SCHEMA)
            for f in frames:
                f.unpersist()
    return spark.createDataFrame(rows, GRID_SCHEMA)


def gamma_text(kernel, gamma):
    """Driver-side twin of the gamma_label column function for one plan step."""
    if kernel not in ("poly", "rbf", "sigmoid"):
        return "-"
    return "default" if gamma is None else f"{gamma:g}"


def _reduced(method, train, test, label, ids, features, kernel, k, gamma, landmarks):
    """(train, test) with the reduced columns, and their names."""
    if method == "none" or not k:
        return [train, test], list(features)
    if method == "kpca":
        frames, model = reduce.kernel_pca(train, [train, test], label, ids, features, kernel, k, gamma, landmarks)
        width = model.weights.shape[1]
    elif method == "pca":
        frames, model = reduce.pca(train, [train, test], features, k)
        width = min(k, len(features))
    elif method == "lda":
        frames, model = lda_reduce(train, [train, test], label, features, k)
        width = min(k, len(model.classes) - 1, model.scalings.shape[1])
    else:
        raise ValueError(f"unknown method: {method}")
    out, names = [], []
    for f in frames:
        wide, names = reduce.spread_axes(f.select(*ids, ref(label), "projected"), "projected", width)
        out.append(wide.drop("projected"))
    return out, names


def feature_study(df, label, ids, features, base, sample=None, floor=2_000, repeats=3,
                  model="random_forest", options=None, seed=0):
    """Redundant pairs, permutation importance of a forest on held-out rows, and class
    signatures, as three tables; of all rows, or of a stratified sample if its size is given."""
    drawn = materialised(sampling.stratified_sample(df, label, ids, sample, floor, seed))
    pairs = separability.correlation_pairs(drawn, features)
    parts = materialised(sampling.stratified_split(drawn, label, ids, 0.3))
    train, test = prep.prepare(parts.where("is_train"), [parts.where("is_train"), parts.where("not is_train")],
                               features, scaled=False)
    fitted = models.fit_model(model, train, label, ids, features, **(options or {}))
    ranking = importance.permutation_importance(test, ids, features, label, fitted.predict, repeats, seed, fitted.forest)
    impurity = local_table(df.sparkSession, list(zip(features, fitted.importances(features))),
                           "feature string, impurity double")
    signatures = separability.signatures(drawn, label, ids, features, base, seed=seed)
    return {"redundant": pairs, "importance": ranking.join(impurity, "feature"), "signatures": signatures}


def imbalance_study(df, label, ids, features, majority, names=("decision_tree", "random_forest", "lightgbm"),
                    strategies=neighbors.STRATEGIES, keep=200_000, target=5_000, test_size=0.4, sample=None,
                    floor=2_000, options=None, seed=0):
    """Every model with every way of rebalancing the training rows; one long table of
    (model, strategy, class, recall, f1) plus the summary metrics of the run."""
    spark = df.sparkSession
    options = options or {}
    drawn = sampling.stratified_sample(df, label, ids, sample, floor, seed)
    parts = materialised(sampling.stratified_split(drawn, label, ids, test_size))
    train, test = prep.prepare(parts.where("is_train"), [parts.where("is_train"), parts.where("not is_train")],
                               features, scaled=False)
    keep_columns = [*ids, *features, label]
    train, test = (prep.downcast(f, features).select(*[ref(c) for c in keep_columns]).persist() for f in (train, test))
    classes = models.class_list(train, label)
    rows = []
    for strategy in strategies:
        balanced = neighbors.resample(strategy, train, label, ids, features, majority, keep, target, seed).persist()
        n_train = balanced.count()
        for name in names:
            start = time.time()
            scored = models.fit_predict(name, balanced, test, label, ids, features, classes, prepared=True,
                                        class_weight=strategy == "class_weight", **options.get(name, {}))
            fit = time.time() - start
            counts, _ = score_run(scored, label)
            summary = summarise(counts)
            for c in metrics.per_class_report(counts).toLocalIterator():
                rows.append((name, strategy, n_train, c["class"], c["recall"], c["f1"], summary["accuracy"],
                             summary["macro_f1"], summary["weighted_f1"], round(fit, 1)))
        balanced.unpersist()
    train.unpersist()
    test.unpersist()
    return spark.createDataFrame(
        rows, "model string, strategy string, n_train bigint, class string, recall double, f1 double, "
              "accuracy double, macro_f1 double, weighted_f1 double, fit_seconds double")


ABLATION_SCHEMA = ("feature_set string, n_features int, model string, accuracy double, macro_f1 double, "
                   "weighted_f1 double, fit_seconds double")


def _evaluate(parts, label, ids, features, name, classes, options):
    start = time.time()
    scored = models.fit_predict(name, parts.where("is_train"), parts.where("not is_train"), label, ids,
                                features, classes, **options.get(name, {}))
    counts, _ = score_run(scored, label)
    summary = summarise(counts)
    return (summary["accuracy"], summary["macro_f1"], summary["weighted_f1"], round(time.time() - start, 1))


def ablation_study(df, label, ids, features, drop_lists, names, test_size=0.4, sample=None, floor=50,
                   options=None, seed=0):
    """The same models without certain features."""
    spark = df.sparkSession
    drawn = sampling.stratified_sample(df, label, ids, sample, floor, seed)
    parts = materialised(sampling.stratified_split(drawn, label, ids, test_size))
    classes = models.class_list(parts, label)
    rows = [(title, len(columns), name, *_evaluate(parts, label, ids, columns, name, classes, options or {}))
            for title, columns in prep.ablation_sets(features, drop_lists).items() for name in names]
    return spark.createDataFrame(rows, ABLATION_SCHEMA)


def duplicate_effect_study(df, label, ids, features, names, test_size=0.4, sample=None, floor=50,
                           options=None, seed=0):
    """The same models with copies kept and with copies removed."""
    spark = df.sparkSession
    keys = [*features, label]
    rows = []
    for condition, table in (("duplicates removed", _one_copy(df, keys, ids)), ("duplicates kept", df)):
        drawn = sampling.stratified_sample(table, label, ids, sample, floor, seed)
        share = duplicate_share_features(drawn, features).first()["share"] if condition == "duplicates kept" else 0.0
        parts = materialised(sampling.stratified_split(drawn, label, ids, test_size))
        classes = models.class_list(parts, label)
        for name in names:
            rows.append((condition, name, share, *_evaluate(parts, label, ids, features, name, classes,
                                                            options or {})))
    return spark.createDataFrame(rows, "condition string, model string, duplicate_share double, accuracy double, "
                                       "macro_f1 double, weighted_f1 double, fit_seconds double")


def _one_copy(df, keys, ids):
    """One row per record, with the smallest id of its copies, so that it is repeatable."""
    if not ids:
        return dedupe(df, keys)
    first = F.min(F.struct(*[ref(c) for c in ids]))
    return df.groupBy(*[ref(c) for c in keys]).agg(first.alias("_id")).select(
        *[ref(c) for c in keys], *[F.col("_id").getField(c).alias(c) for c in ids])


def leakage_study(df, label, ids, features, score, test_size=0.4, seed=0):
    """Split, find test records that also occur in training, score, and compare
    leaked with unseen rows. ``score(train, rows)`` adds a prediction to the rows."""
    parts = materialised(sampling.stratified_split(df, label, ids, test_size, seed))
    # records are compared as they came: once imputed, a missing value equals the mean
    raw = {f"raw_{f}": ref(f) for f in features}
    scored = score(parts.where("is_train"), parts.withColumns(raw))
    return leakage.scored_segments(scored, [*raw, label], label)


def baseline(df, label, ids, features, test_size=0.4, model="sgd", options=None):
    """The starting point the other studies are measured against: copies kept, means
    taken from all rows, hinge loss, weighted averages."""
    fills = prep.fill_values(df, features)
    parts = materialised(sampling.stratified_split(prep.impute(df, fills), label, ids, test_size))
    scored = models.fit_predict(model, parts.where("is_train"), parts.where("not is_train"), label, ids, features,
                                prepared=True, **(options or {}))
    counts = metrics.confusion_counts(scored, label)
    return metrics.classification_summary(counts).select(
        "n", "accuracy", "weighted_precision", "weighted_recall", "weighted_f1")
