import pytest
from pyspark.sql import functions as F

from flowlab.functions import scalars as S
from flowlab.operators import audit, runs
from flowlab.sources import flows, results


def test_repeated_header_and_odd_bytes(spark, tmp_path):
    (tmp_path / "one.csv").write_bytes(
        b" id, Length,Other , Length, Label\n1,10,7,11,Web Attack \x96 XSS\n2,Infinity,x,12, BENIGN \n")
    (tmp_path / "two.csv").write_bytes(b"Other,id, Label, Length\nNaN,3,A  B,1d\n")
    raw = flows.read_flow_csv(spark, [str(tmp_path / "one.csv"), str(tmp_path / "two.csv")])
    assert raw.columns == ["id", "Length", "Other", "Label", flows.FILE_COLUMN]
    clean = flows.clean_flows(raw, "Label", ["Length", "Other"], ["id"])
    rows = {r["id"]: r for r in clean.collect()}
    assert (rows["1"]["Length"], rows["1"]["Other"], rows["1"]["Label"]) == (10.0, 7.0, "Web Attack - XSS")
    assert (rows["2"]["Length"], rows["2"]["Other"], rows["2"]["Label"]) == (None, None, "BENIGN")
    assert (rows["3"]["Length"], rows["3"]["Other"], rows["3"]["Label"]) == (None, None, "A B")
    assert dict(clean.dtypes)["Length"] == "float"


def test_missing_sources_are_all_reported(spark):
    expected = flows.expected_sources(spark, {"mon": ("m.csv", "01_m.csv"), "tue": ("t.csv", "02_t.csv"), "wed": ("w.csv",)})
    present = spark.createDataFrame([("01_m.csv",), ("t.csv",), ("02_t.csv",)], "name string")
    got = {r["source"]: r["name"] for r in audit.complete_sources(expected, present).collect()}
    assert got == {"mon": "01_m.csv", "tue": "t.csv", "wed": None}


def test_source_sizes(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes(b"x" * 2_000_000)
    row = flows.source_check(spark, {"mon": ("m.csv",)}, str(tmp_path)).first()
    assert (row["name"], row["mb"]) == ("m.csv", 2.0)


AUDIT = """[4] Exact duplicate rows (dropped: they leak across the split)
    256,684 of 2,830,743  (9.07%)
       BENIGN                             124,901
       DoS Hulk                            58,224

[5] Final class distribution
    label                                  rows     share
    BENIGN                            2,148,196  83.4556%
    DoS Hulk                            172,849   6.7150%
    Heartbleed                               11   0.0004%
    TOTAL                             2,574,059

    classes: 15   imbalance ratio: 195,291 : 1

[6] Writing Parquet
"""


def test_report_text_becomes_tables(spark):
    reports = spark.createDataFrame([("r", AUDIT)], "report string, text string")
    rows = {r["class"]: (r["removed"], r["kept"]) for r in results.parse_report_classes(reports).collect()}
    assert rows == {"BENIGN": (124_901, 2_148_196), "DoS Hulk": (58_224, 172_849), "Heartbleed": (0, 11)}
    t = results.parse_report_totals(reports).first()
    assert (t["total"], t["classes"], t["ratio"], t["removed"], t["raw"]) == (2_574_059, 15, 195_291, 256_684, 2_830_743)


@pytest.mark.parametrize("value, text", [(1_400_000, "1.4M"), (85_700, "85.7k"), (2_000, "2k"), (950, "950"), (0, "0")])
def test_compact_numbers(spark, value, text):
    assert spark.range(1).select(S.compact_number(F.lit(value))).first()[0] == text


@pytest.mark.parametrize("share, text", [(0.1323, "13.2%"), (0.0004, "<0.1%"), (0.0, "0%")])
def test_percent_texts(spark, share, text):
    assert spark.range(1).select(S.percent_text(F.lit(share))).first()[0] == text


@pytest.mark.parametrize("kernel, gamma, text", [
    ("linear", 0.5, "-"), ("none", None, "-"), ("rbf", None, "default"), ("rbf", 0.05, "0.05"), ("poly", 0.001, "0.001"), ("sigmoid", 1.0, "1")])
def test_gamma_labels(spark, kernel, gamma, text):
    assert spark.range(1).select(S.gamma_label(F.lit(kernel), F.lit(gamma).cast("double"))).first()[0] == text


def test_split_tags(spark):
    row = spark.range(1).select(S.split_tag(F.lit(0.4)), S.split_file_tag(F.lit(0.2)), S.short_class(F.lit("Web Attack - Sql Injection"))).first()
    assert tuple(row) == ("60/40", "80_20", "Sql Injecti")


def test_default_grid_sizes(spark):
    axes = spark.createDataFrame(
        [([0.2, 0.4, 0.6], ["LR", "SGD", "DT", "RF", "NB", "KNN", "SVM"], ["linear", "poly", "rbf", "sigmoid", "cosine"], [0, 5, 10, 15], [None])],
        "test_size array<double>, classifier array<string>, kernel array<string>, components array<int>, gamma array<double>")
    plan = runs.grid_plan(axes)
    assert plan.count() == plan.distinct().count() == 336
    tuned = runs.grid_plan(axes.withColumn("gamma", F.array(F.lit(0.1), F.lit(None).cast("double"))))
    assert tuned.count() == 3 * 7 * (1 + 3 * (2 + 3 * 2))
    assert runs.full_grid(axes.select("test_size", F.slice("classifier", 1, 5).alias("classifier"), "kernel")).count() == 75


def test_upsert_replaces_and_keeps(spark):
    old = spark.createDataFrame([("a", 1, 0.1), ("b", 1, 0.2)], "model string, sample int, f1 double")
    new = spark.createDataFrame([("b", 1, 0.9, "ok"), ("c", 1, 0.3, "ok")], "model string, sample int, f1 double, status string")
    rows = {r["model"]: r["f1"] for r in runs.upsert_runs(old, new, ["model", "sample"]).collect()}
    assert rows == {"a": 0.1, "b": 0.9, "c": 0.3}


def test_ties_take_the_first_setting(spark):
    df = spark.createDataFrame([("g", "z", 1.0), ("g", "a", 1.0), ("g", "b", None)], "g string, k string, m double")
    assert runs.best_per_group(df, ["g"], "m", ["k"]).first()["k"] == "a"


def test_sign_stability(spark):
    gains = spark.createDataFrame([("SVM", 0.073), ("SVM", 0.158), ("SVM", 0.064), ("LR", 0.01), ("LR", -0.02)], "classifier string, gain double")
    got = {r["classifier"]: (r["same_sign"], round(r["mean_gain"], 4)) for r in runs.gain_stability(gains).collect()}
    assert got == {"SVM": (True, 0.0983), "LR": (False, -0.005)}


def test_headers_of_one_folder_may_differ(spark, tmp_path):
    (tmp_path / "one.csv").write_text("id,A,Label\n1,10,x\n")
    (tmp_path / "two.csv").write_text("A, id,Label\n20,2,y\n")
    rows = flows.read_flow_csv(spark, [str(tmp_path)]).select("id", "A", "Label").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("1", "10", "x"), ("2", "20", "y")]
