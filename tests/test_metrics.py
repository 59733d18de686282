import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlab.operators import leakage, metrics, prep

# A published confusion matrix (rows = true, columns = predicted); its report says
# accuracy 0.9982, macro precision 0.8920, macro recall 0.8524, macro F1 0.8648.
MATRIX = """
429323 58 8 4 51 7 5 0 0 1 176 0 1 1 4
71 320 0 0 0 0 0 0 0 0 0 0 0 0 0
8 0 25594 0 1 0 0 0 0 0 0 0 0 0 0
1 0 0 2048 5 2 0 0 0 0 0 0 0 0 0
62 0 0 6 34496 0 0 0 0 0 5 0 0 1 0
6 0 1 0 0 1031 6 0 0 0 0 0 0 0 2
3 0 0 1 0 6 1063 0 0 0 1 0 1 0 0
3 0 0 0 0 0 0 1184 0 0 0 0 0 0 0
1 0 0 0 0 0 0 0 1 0 0 0 0 0 0
3 0 0 0 0 0 0 0 0 4 0 0 0 0 0
267 0 0 0 5 0 0 0 0 0 17891 0 1 0 0
1 0 0 0 0 0 0 0 0 0 0 643 0 0 0
1 0 0 0 0 0 0 0 0 0 0 0 221 0 72
0 0 0 1 0 0 0 0 0 0 0 0 0 3 0
1 0 0 0 0 0 1 0 0 0 0 0 70 0 58
"""


@pytest.fixture(scope="module")
def counts(spark):
    m = np.array([[int(v) for v in line.split()] for line in MATRIX.strip().splitlines()])
    rows = [(f"c{i:02d}", f"c{j:02d}", int(m[i, j])) for i in range(15) for j in range(15) if m[i, j]]
    return spark.createDataFrame(rows, "label string, prediction string, n long")


def test_published_report(counts):
    s = metrics.classification_summary(counts).first()
    assert (s["n"], round(s["accuracy"], 4)) == (514_812, 0.9982)
    assert round(s["macro_precision"], 4) == 0.8920
    assert round(s["macro_recall"], 4) == 0.8524
    assert round(s["macro_f1"], 4) == 0.8648
    assert round(s["weighted_f1"], 4) == 0.9982
    assert abs(s["weighted_recall"] - s["accuracy"]) < 1e-12


def test_published_class_rows(counts):
    r = {x["class"]: x for x in metrics.per_class_report(counts).collect()}
    assert [round(r["c08"][k], 4) for k in ("precision", "recall", "f1")] == [1.0, 0.5, 0.6667]
    assert [round(r["c14"][k], 4) for k in ("precision", "recall", "f1")] == [0.4265, 0.4462, 0.4361]
    assert r["c00"]["support"] == 429_639


def test_zero_division_and_absent_classes(spark):
    counts = spark.createDataFrame([("a", "a", 3), ("b", "a", 1), ("b", "c", 1)],
                                   "label string, prediction string, n long")
    r = {x["class"]: x for x in metrics.per_class_report(counts).collect()}
    assert (r["b"]["precision"], r["b"]["recall"], r["c"]["recall"]) == (0.0, 0.0, 0.0)
    present = metrics.classification_summary(counts).first()["macro_f1"]
    every = metrics.classification_summary(counts, n_classes=6).first()["macro_f1"]
    assert abs(present - 2 * every) < 1e-12


def test_dense_matrix_has_zeros(spark):
    scored = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "label string, prediction string")
    cells = metrics.confusion_matrix(metrics.confusion_counts(scored), scored.select("label")).collect()
    assert len(cells) == 9 and sum(c["n"] for c in cells) == 3


def test_class_weights_average_to_one(spark):
    df = spark.createDataFrame([("a",)] * 90 + [("b",)] * 10, "label string")
    assert abs(prep.with_class_weight(df, "label").agg(F.avg("weight")).first()[0] - 1) < 1e-12


def test_scaler_uses_population_spread_and_training_rows_only(spark):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "x double, y double")
    test = spark.createDataFrame([(100.0, 7.0)], "x double, y double")
    a, b = prep.prepare(train, [train, test], ["x", "y"])
    x = [r["x"] for r in a.collect()]
    filled = np.array([1.0, 3.0, 2.0])
    assert np.allclose(x, (filled - 2) / filled.std())
    assert np.isclose(b.first()["x"], 98 / filled.std()) and b.first()["y"] == 0.0


def test_median_strategy(spark):
    train = spark.createDataFrame([(1.0,), (2.0,), (30.0,), (None,)], "x double")
    assert prep.fill_values(train, ["x"], "median") == {"x": 2.0}
    out, = prep.prepare(train, [train], ["x"], scaled=False, strategy="median")
    assert sorted(r["x"] for r in out.collect()) == [1.0, 2.0, 2.0, 30.0]


def test_leak_treats_missing_as_equal_and_ignores_other_columns(spark):
    rows = [(1, None, "a", True), (2, None, "a", False), (3, 2.0, "a", False), (4, 2.0, "b", True)]
    df = spark.createDataFrame(rows, "id long, x double, label string, is_train boolean")
    flagged = leakage.flag_leaked(df.where("not is_train"), df.where("is_train"), ["x", "label"])
    assert {r["id"]: r["leaked"] for r in flagged.collect()} == {2: True, 3: False}
    share = leakage.leaked_share(df, ["x", "label"]).first()
    assert (share["n_test"], share["n_leaked"], share["leaked_share"]) == (2, 1, 0.5)


def test_hot_records_get_the_same_flag(spark):
    rows = [(i, None if i % 3 == 0 else float(i % 5), "a" if i % 2 else "b", i % 4 == 0) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, x double, label string, is_train boolean")
    train = df.where("is_train and (x is null or x < 3)")
    plain, split = ({r["id"]: r["leaked"] for r in leakage.flag_leaked(
        df.where("not is_train"), train, ["x", "label"], hot_rows=h).collect()} for h in (100_000, 100))
    assert plain == split and len(plain) == 675 and set(plain.values()) == {True, False}


def test_segment_without_rows_has_no_scores(spark):
    df = spark.createDataFrame([(1.0, "a", "a", True), (2.0, "a", "b", False)],
                               "x double, label string, prediction string, is_train boolean")
    segments = leakage.scored_segments(df, ["x", "label"])
    found = {r["segment"]: (r["n"], r["accuracy"], r["macro_f1"]) for r in leakage.segment_metrics(segments, 2).collect()}
    assert found.keys() == {"overall", "unseen", "leaked"}
    assert found["leaked"] == (0, None, None) and found["unseen"][0] == 1
    summary = leakage.leakage_summary(segments).first()
    assert summary["accuracy_leaked"] is None and summary["n_leaked"] == 0


def test_thousands_of_hot_records_are_found_and_dealt_out(spark):
    """5,000 records with 10 copies each among 30,000 single ones: all are hot, and flags stay right."""
    df = spark.range(80_000).selectExpr(
        "id", "cast(if(id < 50000, id % 5000, id) as double) AS x", "id % 7 = 0 AS is_train").repartition(6)
    found = leakage.heavy_hitters(df, F.col("x").cast("bigint"), 20_000)
    counts = {r["key"]: r["n"] for r in found.collect()}
    assert all(6 <= counts[k] <= 10 for k in range(5_000)) and all(n <= 1 for k, n in counts.items() if k >= 5_000)
    train = df.where("x % 3 = 0")
    got = leakage.flag_leaked(df, train, ["x"], hot_rows=5)
    assert got.count() == 80_000 and got.columns == [*df.columns, "leaked"]
    assert got.where("leaked <> (x % 3 = 0)").count() == 0


def test_summary_keeps_what_more_than_one_in_capacity_rows_have(spark):
    df = spark.range(30_000).selectExpr("if(id % 3 = 0, 7, if(id % 10 = 1, 8, id)) AS k").repartition(5)
    got = {r["key"]: r["n"] for r in leakage.heavy_hitters(df, F.col("k"), 20).collect()}
    assert 8_500 <= got[7] <= 10_000 and 500 <= got[8] <= 3_000
    assert leakage.heavy_hitters(df.where("false"), F.col("k"), 20).count() == 0
