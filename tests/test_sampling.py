import hashlib

import pytest
from pyspark.sql import functions as F

from flowlab.operators import sampling

# Published class sizes of the cleaned flow table, in label order.
SIZES = [2148196, 1953, 128016, 10282, 172849, 5228, 5374, 5933, 11, 36, 90819, 3219, 1470, 21, 652]
# Published test supports at test size 0.2 and 0.4 (all rows), in the same order.
SUPPORT_20 = [429639, 391, 25603, 2056, 34570, 1046, 1075, 1187, 2, 7, 18164, 644, 294, 4, 130]


def names():
    return [f"c{i:02d}" for i in range(len(SIZES))]


@pytest.fixture(scope="module")
def flows(spark):
    rows = spark.createDataFrame(list(zip(names(), SIZES)), "label string, n long")
    return rows.select("label", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).select("label").cache()


@pytest.mark.parametrize("n, floor, expected", [
    (10_000, 50, 10_336), (100_000, 50, 100_089), (400_000, 50, 400_055),
    (300_000, 2_000, 310_160), (400_000, 2_000, 408_831)])
def test_published_sample_sizes(flows, n, floor, expected):
    assert sampling.sample_quotas(sampling.class_counts(flows, "label"), n, floor).agg(F.sum("take")).first()[0] == expected


def test_published_split_supports(flows):
    got = {r["label"]: r["n"] - r["take"] for r in sampling.split_quotas(sampling.class_counts(flows, "label"), 0.2).collect()}
    assert sum(got.values()) == 514_812
    assert [got[c] for c in names()] == SUPPORT_20
    assert sum(r["n"] - r["take"] for r in sampling.split_quotas(sampling.class_counts(flows, "label"), 0.4).collect()) == 1_029_624


def people(spark, n=4000):
    return spark.range(n).select(
        "id", F.when(F.col("id") % 10 < 7, "a").when(F.col("id") % 10 < 9, "b").otherwise("c").alias("label"))


def by_hash(ids, seed):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


@pytest.mark.parametrize("run_rows", [65_536, 40])
def test_narrowing_finds_the_same_rows(spark, monkeypatch, run_rows):
    monkeypatch.setattr(sampling, "RUN_ROWS", run_rows)
    monkeypatch.setattr(sampling, "DIGITS_PER_PASS", 1)
    monkeypatch.setattr(sampling, "FIRST_DIGITS", 1)
    df = people(spark)
    drawn = sampling.stratified_sample(df, "label", ["id"], 500, 100, seed=7)
    expected = set()
    for label, share in (("a", 350), ("b", 100), ("c", 100)):
        ids = [r["id"] for r in df.where(F.col("label") == label).collect()]
        expected |= set(by_hash(ids, 7)[:share])
    assert {r["id"] for r in drawn.collect()} == expected


def test_many_classes_fall_back_to_ranks(spark, monkeypatch):
    df = people(spark)
    usual = {r["id"] for r in sampling.stratified_sample(df, "label", ["id"], 500, 100).collect()}
    monkeypatch.setattr(sampling, "SMALL_ROWS", 2)
    monkeypatch.setattr(sampling, "RUN_ROWS", 50)
    assert {r["id"] for r in sampling.stratified_sample(df, "label", ["id"], 500, 100).collect()} == usual


def test_split_covers_everything_once(spark):
    parts = sampling.stratified_split(people(spark), "label", ["id"], 0.3)
    assert parts.count() == 4000
    assert parts.where("not is_train").count() == 1200
    assert parts.where("not is_train").select("label").distinct().count() == 3


def test_sample_of_nothing_asked_is_everything(spark):
    assert sampling.stratified_sample(people(spark), "label", ["id"], None).count() == 4000


def test_rows_without_label_are_not_drawn(spark):
    df = people(spark).withColumn("label", F.when(F.col("label") != "c", F.col("label")))
    assert sampling.stratified_split(df, "label", ["id"], 0.5).where("label is null").count() == 0


@pytest.mark.parametrize("run_rows", [65_536, 30])
def test_rank_is_a_numbering(spark, monkeypatch, run_rows):
    monkeypatch.setattr(sampling, "RUN_ROWS", run_rows)
    df = people(spark, 1000).withColumn("key", sampling.order_key(0, ["id"]))
    ranked = sampling.rank_by_key(df, "key", by=["label"])
    for label in "abc":
        rows = ranked.where(F.col("label") == label).orderBy("key").select("rank").collect()
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))


def test_permuted_column_keeps_its_values(spark):
    df = people(spark, 500).withColumn("x", F.col("id") * 2)
    out = sampling.permute_column(df, "x", ["id"], seed=1)
    rows = out.collect()
    assert sorted(r["x"] for r in rows) == [2 * i for i in range(500)]
    assert sum(r["x"] != 2 * r["id"] for r in rows) > 450
    assert out.columns == df.columns


def test_undersample_only_above_the_limit(spark):
    df = people(spark)
    assert sampling.undersample(df, "label", ["id"], "a", 2800).count() == 4000
    cut = sampling.undersample(df, "label", ["id"], "a", 100)
    assert {r["label"]: r["count"] for r in cut.groupBy("label").count().collect()} == {"a": 100, "b": 800, "c": 400}


def test_cap_keeps_small_classes(spark):
    out = sampling.cap_per_class(people(spark), "label", ["id"], 500).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in out} == {"a": 500, "b": 500, "c": 400}


def test_quota_holds_when_ids_repeat(spark):
    rows = [(1, "a", i) for i in range(6)] + [(2, "b", 0), (3, "b", 1)]
    df = spark.createDataFrame(rows, "id int, label string, x int")
    kept = sampling.cap_per_class(df, "label", ["id"], 3).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in kept} == {"a": 3, "b": 2}
    parts = sampling.stratified_split(df, "label", ["id"], 0.5).groupBy("is_train").count().collect()
    assert {r["is_train"]: r["count"] for r in parts} == {True: 4, False: 4}
