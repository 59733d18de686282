"""Multiset fingerprints against a plain version of the vectors, on awkward rows."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlab.llm import multiset, queries

TEXTS = [None, "", "\n", " \n\t", "one", "two words", "A. B, c\nA. B, c\n\nlast one", "last one\n\nA. B, c\nA. B, c",
         "first. \n second, third;  fourth\n", "long text. " * 9_000, "é世🙂. " * 40, "x" * 70_000]
CLASH = "_key long, _range int, text2 string, vector string, next_text string, _guest boolean, n_chars int"


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i * 7 - 3, t) for i, t in enumerate(TEXTS)] + [(4, TEXTS[6]), (4, TEXTS[6]), (None, "no id"), (None, "nor here")]
    return spark.createDataFrame([(i, t, 1, 2, "x", "y", "z", True, 3) for i, t in rows], f"doc_id long, text string, {CLASH}")


def plain_order(df):
    """Rows by descending id, those without one last, equal ids by Spark's hash of the text."""
    rows = df.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    return sorted(((r["doc_id"], r["t"], r["h"]) for r in rows.collect()),
                  key=lambda r: (r[0] is None, -(r[0] or 0), r[2]))


def edit(own, after):
    half = len(own) // 2
    return own[:len(own) - half] + after[:half]


def test_edited_texts_and_equality(spark, awkward):
    order = plain_order(awkward)
    want = sorted(((i, len(t), hashlib.sha256(edit(t, order[(k + 1) % len(order)][1]).encode()).hexdigest())
                   for k, (i, t, _) in enumerate(order)), key=str)
    rows = multiset.edited_likeness(awkward).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows), key=str) == want
    assert all(0 <= r[c] <= 1 for r in rows for c in ("near_edited", "near_next"))
    # fingerprints are equal just where the bags of paragraphs are
    bags = {}
    for i, t, _ in order:
        bags.setdefault(tuple(sorted(t.split("\n"))) if t else (), set()).add(i)
    found = {}
    for r in rows:
        found.setdefault(r["fingerprint"], set()).add(r["doc_id"])
    assert sorted(map(str, bags.values())) == sorted(map(str, found.values()))


def test_lanes_against_plain_sums(spark, awkward):
    rows = awkward.where("length(text) < 100").select(
        "text", multiset.vector("text").alias("v"),
        F.expr("transform(split(coalesce(text, ''), '\\n'), p -> sha2(p, 256))").alias("ds")).collect()
    hashed = {}
    clauses = sorted({c for r in rows for c in re.split(r"(?<=[.!?;:,]) +|\n", r["text"]) if c})
    table = spark.createDataFrame([(c,) for c in clauses], "c string")
    for r in table.select("c", F.expr("transform(sequence(0, 3), s -> xxhash64(c, s))").alias("h")).collect():
        bits = [(h >> i & 1, h >> 32 + i & 1) for h in r["h"] for i in range(32)]
        hashed[r["c"]] = np.array([2 * b - 1 for pair in bits for b in pair])
    for r in rows:
        parts = [c for c in re.split(r"(?<=[.!?;:,]) +|\n", r["text"]) if c]
        want = sum((hashed[c] for c in parts), np.zeros(multiset.LIKE, int)) % (1 << multiset.LIKE_BITS)
        assert r["v"][multiset.EQUAL:] == want.tolist()
        assert len(r["v"]) == multiset.EQUAL + multiset.LIKE and (any(r["v"][:multiset.EQUAL]) or r["text"] == "")


def test_insert_delete_and_written_form(spark):
    df = spark.createDataFrame([("a. b\nc", "d, e\nf", "d, e\na. b\nf\nc")], "x string, y string, z string").select(
        *[multiset.vector(c).alias(c) for c in "xyz"])
    both = multiset.added(F.col("x"), F.col("y"))
    r = df.select((both == F.col("z")).alias("add"), (multiset.removed(F.col("z"), F.col("y")) == F.col("x")).alias("cut"),
                  (multiset.read(multiset.written(F.col("z"))) == F.col("z")).alias("text"),
                  multiset.likeness(F.col("x"), F.col("z")).alias("near")).first()
    assert r["add"] and r["cut"] and r["text"] and 0.3 < r["near"] < 1


def test_one_row_only_null_ids_and_no_rows(spark):
    one = spark.createDataFrame([(5, "abcd. efg")], "doc_id long, text string")
    r = multiset.edited_likeness(one).first()
    assert r["edited_sha256"] == hashlib.sha256(edit("abcd. efg", "abcd. efg").encode()).hexdigest() and r["near_next"] == 1.0
    assert multiset.edited_likeness(one.where("false")).count() == 0
    assert multiset.edited_likeness(one.withColumn("doc_id", F.lit(None).cast("long"))).count() == 1


def test_query_tells_edited_from_next(spark, sf):
    rows = queries.QUERIES["op13_multiset_hash"](spark, sf).toPandas()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert (rows["near_edited"] > rows["near_next"]).mean() > 0.9
    assert 0.4 < rows["near_edited"].mean() < 0.6 and rows["near_next"].mean() < 0.1
