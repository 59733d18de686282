"""Families of texts that are alike only in part, and documents judged by the benchmark in place."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlab.llm import frames, simhash, tiling


def family(n, seed, size=60, copies=1):
    """Texts with about half to nine tenths of their words in common, each changed at its own places."""
    rng = random.Random(seed)
    base = [f"w{seed}x{k}" for k in range(size)]
    out = []
    for i in range(n):
        words = list(base)
        start, length = rng.randrange(size), rng.randint(1, size // 3)
        for k in range(start, min(size, start + length)):
            words[k] = f"own{i}y{k}"
        out += [" ".join(words)] * copies
    return out


def shingles(text):
    w = text.split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def plain_components(texts, similar):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similar * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("rounds", [8, 0])
def test_components_of_alike_families(spark, rounds, monkeypatch):
    monkeypatch.setattr(simhash, "MATCHINGS", rounds)
    texts = family(120, 1) + family(60, 2, 30) + family(15, 3, 200, 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_components(docs, 3, 8, 0.8, 5).collect()}
    assert got == dict(enumerate(plain_components(texts, 0.8)))


def test_a_family_is_merged_without_all_its_pairs(spark, monkeypatch):
    """400 texts, mostly 0.6 to 0.8 alike: far fewer pairs than 400 * 399 / 2 are looked at."""
    seen, real = [], simhash._similar_pairs

    def counted(pairs, sets, similar):
        seen.append(pairs.count())
        return real(pairs, sets, similar)

    monkeypatch.setattr(simhash, "_similar_pairs", counted)
    docs = spark.createDataFrame(list(enumerate(family(400, 9))), "doc_id long, text string").repartition(4)
    simhash.near_components(docs, 3, 8, 0.8, 5).collect()
    assert sum(seen) < 400 * 399 / 2 / 4


def test_filter_has_every_node(spark):
    rng = np.random.default_rng(0)
    nodes = rng.integers(-2**63, 2**63 - 1, 3_000)
    table = spark.createDataFrame([(int(x),) for x in nodes], "node long").repartition(3)
    bits, shift = simhash._filter(table)

    def there(x):
        at = simhash.mix(x.view(np.uint64)) >> shift
        return bits[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7)).astype(np.int64)) & 1

    assert there(nodes).all() and there(rng.integers(-2**63, 2**63 - 1, 3_000)).mean() < 0.1


def test_clean_keeps_what_is_not_reported(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    hit = {r["doc_id"] for r in tiling.contaminated(docs, items).collect()}
    rows = docs.unionByName(docs.limit(3)).collect()
    kept = tiling.clean(docs.unionByName(docs.limit(3)), items).collect()
    assert hit and Counter(kept) == Counter(r for r in rows if r["doc_id"] not in hit)
    odd = spark.createDataFrame([(None, None), (1, ""), (None, " \n")], "doc_id long, text string")
    assert tiling.clean(odd, items).count() == 3
    assert tiling.clean(odd, items.where("false")).count() == 3
    assert tiling.clean(odd.where("false"), items).count() == 0


def test_components_in_one_task_and_in_rounds(spark, monkeypatch):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(5)
    one = {r["node"]: r["root"] for r in frames.components(df).collect()}
    monkeypatch.setattr(frames, "ONE_TASK", 0)
    assert one == {r["node"]: r["root"] for r in frames.components(df).collect()}
    assert all(one[1001 + i] == 1000 for i in range(40)) and frames.components(df.where("false")).count() == 0


def test_a_large_group_gives_a_few_pairs_a_row(spark):
    n = 120
    apart = spark.createDataFrame([(7, k, 100, 0, k) for k in range(n)], "token long, node long, size int, place int, root long")
    drawn = spark.createDataFrame([(k, bytearray([1] * 250 + [1 + k % 3] * 6)) for k in range(n)], "node long, sketch binary")
    few = simhash._apart_pairs(apart.repartition(3), drawn, 0.8, False).collect()
    assert n - 1 <= len(few) <= simhash.FORESTS * (n - 1) and all(r["more"] and r["u"] < r["v"] for r in few)
    # the most alike go first, and the forest holds the group together
    assert sum((r["u"] - r["v"]) % 3 == 0 for r in few) >= n - 3
    edges = spark.createDataFrame([(r["u"], r["v"]) for r in few], "u long, v long")
    assert {r["root"] for r in frames.components(edges).collect()} == {0}
    every = simhash._apart_pairs(apart, drawn, 0.8, True).collect()
    assert {(r["u"], r["v"]) for r in every} == {(u, v) for v in range(n) for u in range(v)} and not any(r["more"] for r in every)
    # sketches that prove sets unlike, and sets of one component
    unlike = drawn.select("node", F.expr("unhex(repeat(lpad(hex(node + 1), 2, '0'), 256))").alias("sketch"))
    assert simhash._apart_pairs(apart, unlike, 0.8, True).count() == 0
    assert simhash._apart_pairs(apart.withColumn("root", F.lit(0).cast("long")), drawn, 0.8, True).count() == 0


def test_forests_connect_what_all_edges_connect():
    rng = np.random.default_rng(1)
    a, b, weight = rng.integers(0, 40, 300), rng.integers(0, 40, 300) + 40, rng.random(300)
    taken = simhash._forests(a, b, weight)
    assert len(taken) <= simhash.FORESTS * 79 and len(set(taken.tolist())) == len(taken) and np.argmax(weight) in taken

    def parts(edges):
        root = list(range(80))
        for _ in range(80):
            for x, y in edges:
                root[x] = root[y] = min(root[x], root[y])
        return root

    assert parts(list(zip(a, b))) == parts(list(zip(a[taken], b[taken])))
    assert len(simhash._forests(a[:0], b[:0], weight[:0])) == 0
