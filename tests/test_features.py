import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowlab.operators import audit, importance, neighbors, prep, quantiles, separability
from flowlab.tables import tree_sum


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    n = 3000
    pdf = pd.DataFrame({
        "id": np.arange(n), "label": rng.choice(["base", "x", "y"], n, p=[0.7, 0.2, 0.1]),
        "a": rng.normal(size=n), "b": rng.integers(0, 5, n).astype(float), "k": np.ones(n)})
    pdf.loc[pdf.label == "x", "a"] += 1.0
    pdf["copy"] = pdf["a"]
    pdf["near"] = pdf["a"] * 3 + 1e9 + rng.normal(size=n) * 1e-3
    pdf["gap"] = pdf["b"].where(rng.random(n) > 0.3)
    return pdf, spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None),
                                      "id long, label string, a double, b double, k double, copy double, near double, gap double").repartition(5).cache()


def brute_auc(pos, neg):
    return np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 100])
def test_medians_are_exact_in_ranges(table, rows_per_bucket):
    pdf, df = table
    got = {(r["group"], r["feature"]): r["median"] for r in
           quantiles.group_medians(df, ["a", "b", "k", "gap"], "label", rows_per_bucket).collect()}
    for label, part in pdf.groupby("label"):
        for f in ("a", "b", "k", "gap"):
            assert got[(label, f)] == pytest.approx(part[f].median(), abs=1e-12)
    whole = {r["feature"]: r["median"] for r in quantiles.group_medians(df, ["a"], None, rows_per_bucket).collect()}
    assert whole["a"] == pytest.approx(pdf["a"].median(), abs=1e-12)


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 100])
def test_auc_is_exact_in_ranges(table, rows_per_bucket):
    pdf, df = table
    sums = quantiles.pair_rank_sums(df, "label", "base", ["a", "b", "k", "gap"], rows_per_bucket)
    got = {(r["class"], r["feature"]): r["auc"] for r in separability._auc(sums).collect()}
    assert ("x", "k") not in got
    for label in ("x", "y"):
        for f in ("a", "b", "gap"):
            pos, neg = (pdf[pdf.label == c][f].dropna().to_numpy() for c in (label, "base"))
            assert got[(label, f)] == pytest.approx(brute_auc(pos, neg), abs=1e-12)


def test_auc_of_negated_feature_is_the_complement(table):
    _, df = table
    both = df.withColumn("minus", -F.col("a"))
    got = {(r["class"], r["feature"]): r["auc"] for r in
           separability.feature_auc(both, "label", ["a", "minus"], "base").collect()}
    for label in ("x", "y"):
        assert got[(label, "a")] + got[(label, "minus")] == pytest.approx(1.0)


def test_capped_auc_equals_the_full_one_when_the_cap_is_not_reached(table):
    _, df = table
    capped, _, _ = separability.capped_auc(df, "label", ["id"], ["a", "b"], "base", 10_000)
    full = separability.feature_auc(df, "label", ["a", "b"], "base")
    one, two = ({(r["class"], r["feature"]): (r["n"], r["auc"]) for r in t.collect()} for t in (capped, full))
    assert one == two


def test_signature_ties_go_to_the_last_name(table):
    _, df = table
    rows = [r for r in separability.signatures(df, "label", ["id"], ["a", "copy", "k"], "base").collect()
            if r["class"] == "x"]
    assert [r["feature"] for r in sorted(rows, key=lambda r: r["rank"])] == ["copy", "a"]


def test_correlation_survives_large_offsets_and_gaps(table):
    pdf, df = table
    rows = separability.correlation_pairs(df, ["a", "b", "k", "copy", "near", "gap"], 0.9).collect()
    got = {(r["feature_a"], r["feature_b"]): r for r in rows}
    assert got[("a", "copy")]["identical"] and got[("a", "copy")]["abs_corr"] == pytest.approx(1.0)
    assert got[("b", "gap")]["abs_corr"] == pytest.approx(1.0) and not got[("b", "gap")]["identical"]
    assert got[("a", "near")]["abs_corr"] == pytest.approx(np.corrcoef(pdf.a, pdf.near - 1e9)[0, 1], abs=1e-6)
    assert not any("k" in pair for pair in got)
    assert rows[0]["identical"]


def test_constant_rule_counts_missing_as_a_value(spark):
    df = spark.createDataFrame([(0.0, None, 1.0, 2.0), (None, None, 1.0, 3.0)],
                               "half double, none double, one double, two double")
    assert {r["column"] for r in audit.constant_columns(df, df.columns).collect()} == {"none", "one"}
    assert audit.drop_constant(df, df.columns).columns == ["half", "two"]


def test_distinct_measurements(table):
    _, df = table
    row = audit.distinct_measurements(df, ["a", "b", "copy", "gap"]).first()
    assert (row["features"], row["copies"], row["measurements"]) == (4, 1, 3)


def test_duplicates_add_up(spark):
    df = spark.createDataFrame([("a", 1)] * 5 + [("a", 2)] + [("b", 1)] * 2, "label string, x int")
    total = audit.conservation(df, "label").first()
    assert (total["raw"], total["duplicates"], total["kept"]) == (8, 5, 3)
    per = {r["label"]: r["duplicates"] for r in audit.duplicate_profile(df, "label").collect()}
    assert per == {"a": 4, "b": 1, "TOTAL": 5}
    once = audit.dedupe(df)
    assert once.count() == 3 and audit.dedupe(once).count() == 3


def test_tree_sum_adds_all_rows(spark):
    df = spark.range(10_000).repartition(70)
    total = tree_sum(df, ["id"], lambda pdf: {"all": np.array([pdf["id"].sum(), len(pdf)])})["all"]
    assert list(total) == [49_995_000, 10_000]


def vectors(spark, n, seed, start=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6))
    x[: n // 3] = x[0]                       # a third of the rows are copies
    rows = [(start + i, [float(v) for v in row], f"c{i % 3}") for i, row in enumerate(x)]
    return x, spark.createDataFrame(rows, "id long, vector array<double>, label string")


def test_nearest_neighbours_in_blocks(spark):
    q, queries = vectors(spark, 90, 1)
    b, base = vectors(spark, 240, 2, start=1000)
    expected = set()
    for i, row in enumerate(q):
        distance = np.sqrt(((b - row) ** 2).sum(axis=1))
        for place, j in enumerate(np.lexsort((np.arange(len(b)), distance))[:5], 1):
            expected.add((i, place, 1000 + int(j)))
    for settings in (dict(), dict(shipped_values=10, block_rows=50)):
        near = neighbors.knn_join(queries, base, 5, carry="label", **settings)
        rows = near.collect()
        assert {(r["query"], r["rank"], r["neighbour"]) for r in rows} == expected
        assert all(r["carry"] == f"c{(r['neighbour'] - 1000) % 3}" for r in rows)


def test_vote_ties_go_to_the_smallest_class(spark):
    near = spark.createDataFrame([(1, "b"), (1, "a"), (2, "b"), (2, "b"), (2, "a")], "query long, carry string")
    assert {r["query"]: r["prediction"] for r in neighbors.knn_vote(near).collect()} == {1: "a", 2: "b"}


def test_synthetic_rows_lie_between_two_rows_of_their_class(spark):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b), "rare") for a, b in rng.normal(size=(12, 2))]
    rows += [(float(a), float(b), "big") for a, b in rng.normal(size=(200, 2))]
    df = spark.createDataFrame(rows, "a double, b double, label string")
    out = neighbors.smote(df, "label", ["a", "b"], target=100)
    assert {r["label"]: r["count"] for r in out.groupBy("label").count().collect()} == {"rare": 100, "big": 200}
    real = np.array([r[:2] for r in rows if r[2] == "rare"])
    for r in out.where("synthetic").collect():
        point = np.array([r["a"], r["b"]])
        detour = [np.linalg.norm(point - p) + np.linalg.norm(point - q) - np.linalg.norm(p - q)
                  for p in real for q in real if not np.array_equal(p, q)]
        assert min(detour) < 1e-9
    again = neighbors.smote(df, "label", ["a", "b"], target=100)
    assert out.exceptAll(again).count() == 0


def test_synthetic_rows_follow_their_draws(spark, monkeypatch):
    """Many classes, equal rows, parts of a class in several tasks: row for row as by hand."""
    import hashlib

    monkeypatch.setattr(neighbors, "FILL_ROWS", 4)
    rng = np.random.default_rng(11)
    rows = [(float(a), float(b), int(c)) for a, b, c in zip(rng.integers(0, 6, 300), rng.normal(size=300).round(1), rng.integers(0, 25, 300))]
    out = neighbors.smote(spark.createDataFrame(rows, "a double, b double, c int").repartition(5), "c", ["a", "b"], target=30, seed=4)
    by = {c: sorted((a, b) for a, b, d in rows if d == c) for c in {r[2] for r in rows}}
    k = min(5, min(len(v) for v in by.values() if len(v) < 30) - 1)
    want = []
    for c, points in by.items():
        x = np.array(points)
        for j in range(30 - len(x)):
            d = hashlib.md5(f"4|{c}|{j}".encode()).hexdigest()
            start, pick, step = int(d[:8], 16) % len(x), int(d[8:16], 16) % k, int(d[16:24], 16) / 2 ** 32
            distance = np.sqrt(((x - x[start]) ** 2).sum(1))
            near = [i for i in np.lexsort((np.arange(len(x)), distance)) if i != start][pick]
            want.append((*(x[start] + step * (x[near] - x[start])).tolist(), c))
    got = sorted((r["a"], r["b"], r["c"]) for r in out.where("synthetic").collect())
    assert np.allclose(np.array(got), np.array(sorted(want)), atol=1e-12) and len(got) == len(want) > 300


def test_a_single_row_cannot_be_interpolated(spark):
    df = spark.createDataFrame([(1.0, "rare")] + [(float(i), "big") for i in range(50)], "a double, label string")
    with pytest.raises(ValueError):
        neighbors.smote(df, "label", ["a"], target=10)


def test_shuffling_an_unused_feature_costs_nothing(table):
    _, df = table
    rule = lambda d: d.withColumn("prediction", F.when(F.col("a") > 0.5, "x").otherwise("base"))
    rows = importance.permutation_importance(df.select("id", "label", "a", "b"), ["id"], ["a", "b"], "label", rule, 3).collect()
    got = {r["feature"]: r["permutation_mean"] for r in rows}
    assert got["b"] == 0.0 and got["a"] > 0.01 and rows[0]["feature"] == "a"


def test_signatures_use_the_whole_base_class(spark):
    # 20,000 low values come first in any sample size up to the old cap; all 25,000 rows must count
    df = spark.range(25_010).select(
        F.col("id"), F.when(F.col("id") < 25_000, F.col("id") % 5_000).otherwise(F.lit(10_000)).cast("double").alias("a"),
        F.when(F.col("id") < 25_000, "base").otherwise("x").alias("label"))
    row = separability.signatures(df, "label", ["id"], ["a"], "base").first()
    assert (row["separation"], row["class_is"], row["median_base"], row["n"]) == (1.0, "higher", 2499.5, 10)


def test_missing_labels_have_no_class_weight(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "label string")
    assert {r["label"]: r["weight"] for r in prep.class_weights(df, "label").collect()} == {"a": 0.75, "b": 1.5}


@pytest.mark.parametrize("settings", [dict(block_rows=20), dict(block_rows=1_000)])
def test_pivot_cells_give_all_nearest_rows(spark, settings, monkeypatch):
    """Clusters far apart, hot cells dealt over tasks, ties at the k-th place, fewer rows than k, carried lists."""
    monkeypatch.setattr(neighbors, "QUERY_ROWS", 15)
    monkeypatch.setattr(neighbors, "BASE_ROWS", 16)
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(6, 4)) * 1e4
    b = np.concatenate([centre[rng.integers(0, 6, 150)] + rng.normal(size=(150, 4)), np.zeros((60, 4)),
                        rng.integers(0, 3, (90, 4)).astype(float)])
    q = np.concatenate([centre[rng.integers(0, 6, 40)] + rng.normal(size=(40, 4)), np.zeros((20, 4)), np.full((3, 4), 1e9)])
    base = spark.createDataFrame([(f"b{j:03d}", v.tolist(), [j, j + 1]) for j, v in enumerate(b)],
                                 "id string, vector array<double>, label array<long>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "id long, vector array<double>")
    want = set()
    for i, row in enumerate(q):
        distance = np.sqrt(((b - row) ** 2).sum(axis=1))
        for place, j in enumerate(np.lexsort((np.arange(len(b)), distance))[:4], 1):
            want.add((i, place, f"b{j:03d}", float(distance[j]), (int(j), int(j) + 1)))
    near = neighbors.knn_join(queries, base, 4, carry="label", shipped_values=0, **settings)
    assert {(r["query"], r["rank"], r["neighbour"], r["distance"], tuple(r["carry"])) for r in near.collect()} == want
    few = neighbors.knn_join(queries, base.where("id < 'b002'"), 4, shipped_values=0, **settings)
    assert few.count() == 2 * len(q)
    assert neighbors.knn_join(queries, base.where("false"), 4, shipped_values=0, **settings).count() == 0
    assert neighbors.knn_join(queries.where("false"), base, 4, shipped_values=0, **settings).count() == 0


def test_base_rows_go_only_to_cells_they_can_be_near_to(spark):
    """Two far clusters: no base row of one meets the queries of the other."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(100, 3)), 1e6 + rng.normal(size=(100, 3))])
    pivots = x[[0, 100]]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    cells = neighbors._smallest_reaches(rows, spark.sparkContext.broadcast(pivots), 5)
    assert sorted(r["n"] for r in cells) == [100, 100] and all(len(r["least"]) == 5 for r in cells)
    bound = neighbors._farthest(pivots, cells, cells, 5)
    most = {r["cell"]: r["most"] for r in cells}
    low, _ = neighbors.pivot_distances(x, pivots)
    sent = low <= np.array([most[c] + bound[c] for c in (0, 1)])
    assert sent[:100, 0].all() and sent[100:, 1].all() and not sent[:100, 1].any() and not sent[100:, 0].any()


def test_order_statistics_of_awkward_values(spark):
    """Both signs, zeros, denormals, values next to each other, infinities, ties and a missing key."""
    base = 1.0 + np.arange(40) * np.finfo(float).eps
    x = np.concatenate([base, -base, [0.0, -0.0] * 5, [5e-324, 1e-323, 1.5e-323, 2e-323], [1.7e308, -1.7e308, np.inf, -np.inf],
                        np.full(30, 3.5), 10.0 ** np.arange(-300, 300, 25)])
    rows = [(key, float(v)) for key in ("a", None) for v in x] + [("one", 2.5)]
    values = spark.createDataFrame(rows, "key string, value double").repartition(4)
    wanted = [1, 2, 13, 40, 41, 80, 85, 100, len(x), len(x) + 1]
    got = quantiles.order_statistics(values, ["key"], [F.lit(r).cast("bigint") for r in wanted]).collect()
    sorted_x = np.sort(x)
    want = {(key, r): float(sorted_x[r - 1]) for key in ("a", None) for r in wanted if r <= len(x)} | {("one", 1): 2.5}
    assert {(r["key"], r["rank"]): r["value"] for r in got} == want and len(got) == len(want)
    assert quantiles.order_statistics(values.where("false"), ["key"], [F.lit(1)]).count() == 0


def test_shuffled_copies_rank_once_and_send_two_numbers(spark):
    from flowlab.operators import importance

    df = spark.range(60).selectExpr("id", "cast(id as double) AS u", "cast(id * 2 as double) AS v").repartition(8)
    out = importance.shuffled_copies(df, ["id"], ["u", "v"], 2)
    assert out.columns == ["feature", "repeat", "id", "u", "v"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "_slot" in plan
    rows = out.collect()
    assert len(rows) == 240
    for feature, other in (("u", "v"), ("v", "u")):
        for repeat in (0, 1):
            mine = [r for r in rows if (r["feature"], r["repeat"]) == (feature, repeat)]
            factor = {"u": 1.0, "v": 2.0}
            assert sorted(r[feature] for r in mine) == [factor[feature] * i for i in range(60)]
            assert all(r[other] == factor[other] * r["id"] for r in mine)
            assert any(r[feature] != factor[feature] * r["id"] for r in mine)


def test_cells_of_one_task_share_the_base_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = spark.createDataFrame([(k, rng.normal(size=24).tolist()) for k in range(300)], "id long, vector array<double>")
    queries = spark.createDataFrame([(k, rng.normal(size=24).tolist()) for k in range(200)], "id long, vector array<double>")
    sent, kind = [], type(base)
    real = kind.sortWithinPartitions

    def counted(self, *columns, **settings):
        sent.append(self.count())
        return real(self, *columns, **settings)

    monkeypatch.setattr(kind, "sortWithinPartitions", counted)
    got = neighbors.knn_join(queries, base, 3, shipped_values=0, block_rows=3)
    assert len(sent) == 1 and 0 < sent[0] <= 200 + 300 * spark.sparkContext.defaultParallelism
    want = neighbors.knn_join(queries, base, 3)
    columns = ["query", "neighbour", "rank"]
    assert sorted(got.select(columns).collect()) == sorted(want.select(columns).collect())


def test_ranks_of_large_tables_are_multiplied_whole():
    n = (1 << 38) + 7
    rank = np.array([0, 1, n // 2, n - 1])
    factor, offset = n - 12345, n - 3
    assert importance.receivers(rank, factor, offset, n).tolist() == [(factor * int(r) + offset) % n for r in rank]


@pytest.mark.parametrize("blocks", [1, 7])
def test_importance_of_a_forest_by_its_bins(spark, monkeypatch, blocks):
    """Counts by bins equal those of scored copies, without a copy of any row being written or scored."""
    from flowlab.operators import models

    rng = np.random.default_rng(5)
    u, v = rng.integers(0, 8, 700).astype(float), rng.normal(size=700).round(2)
    label = np.where(rng.random(700) < 0.1, "z", np.where(u > 4, "x", "y"))
    rows = [(int(i), float(a), float(b), str(c) if i % 50 else None, 0.0) for i, (a, b, c) in enumerate(zip(u, v, label))]
    df = spark.createDataFrame(rows, "id long, u double, v double, label string, w double").repartition(5)
    names = ["v", "u", "w"]
    fitted = models.fit_model("random_forest", df.where("label <> 'z'"), "label", ["id"], names, trees=7, max_depth=6)
    wanted = importance.permutation_importance(df, ["id"], names, "label", fitted.predict, 2).collect()
    counts = importance.confusion_counts(fitted.predict(importance.shuffled_copies(df, ["id"], names, 2)), by=["feature", "repeat"]).collect()
    plain = importance.confusion_counts(fitted.predict(df)).collect()
    monkeypatch.setattr(importance, "shuffled_copies", None)
    monkeypatch.setattr(importance, "SENT_ROWS", 100)
    monkeypatch.setattr(importance, "BLOCK_VALUES", 9 * 700 // blocks)
    found = importance.permutation_importance(df, ["id"], names, "label", None, 2, forest=fitted.forest).collect()
    assert [r["feature"] for r in found] == [r["feature"] for r in wanted]
    for a, b in zip(found, wanted):
        assert list(a)[1:] == pytest.approx(list(b)[1:], abs=1e-12)
    by_bins = importance.forest_counts(df, ["id"], names, "label", fitted.forest, 2).collect()
    assert {tuple(r) for r in by_bins} == {tuple(r) for r in counts} | {(None, None, *r) for r in plain}


def test_rank_sums_take_no_list_of_a_values_classes(spark, monkeypatch):
    """Wins counted pair by pair, with ties across classes, missing labels and values, in several ranges."""
    from pyspark.sql import functions

    monkeypatch.delattr(functions, "collect_list")
    rng = np.random.default_rng(6)
    rows = [("abc"[i % 3] if i % 11 else None, float(v) if i % 13 else None, -0.0 if v % 2 else 0.0)
            for i, v in enumerate(rng.integers(0, 9, 400))]
    df = spark.createDataFrame(rows, "label string, u double, z double")
    found = {(r["class"], r["feature"]): r for r in quantiles.pair_rank_sums(df, "label", "a", ["u", "z"], 50).collect()}
    assert set(found) == {(c, f) for c in "bc" for f in "uz"}
    for (c, f), r in found.items():
        at = 1 if f == "u" else 2
        own, base = ([x[at] for x in rows if x[0] == k and x[at] is not None] for k in (c, "a"))
        assert (r["n"], r["n_base"]) == (len(own), len(base))
        assert r["wins2"] == sum((x > y) + (x >= y) for x in own for y in base)
        assert (r["lowest"], r["highest"]) == (min(own + base), max(own + base))
