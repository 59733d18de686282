"""From raw documents to packed sequences: quality rules, quality classifier, near-duplicates,
benchmark decontamination, packing. Every stage is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlab.llm import importance, packing, quality_rules, simhash, tiling
from flowlab.llm.frames import scratch, stored
from flowlab.llm.queries import table, tokenizer

# Two documents are near-duplicates from this share of common five-word shingles on; most pairs that
# similar differ in at most this many bits of their fingerprints, and are looked at first.
SIMILAR, BITS = 0.8, 8
# Column of the row key inside a stage.
ROW = "_row_key"


def _keyed(docs):
    """The documents with a key per row, written once: ids can be null or stand at several rows."""
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "keyed")


def _only(keyed, kept, how="left_semi"):
    """The rows whose keys are kept (or, with an anti join, are not), with all their columns."""
    return keyed.join(kept.select(ROW), ROW, how).drop(ROW)


def _by_row(keyed):
    """Row key, as doc_id, and text."""
    return keyed.select(F.col(ROW).alias("doc_id"), "text")


def rules(spark, docs, sf_dir):
    """Documents that pass the quality rules; every row is judged by its own text."""
    return quality_rules.passing(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def classifier(spark, docs, sf_dir):
    """Rows that the importance sample holds. Rows with one id share their noise, rows without an id
    have their own; each is weighed by its own text."""
    keyed = _keyed(docs)
    verdict = importance.resample(keyed, table(spark, sf_dir, "labels"), key=ROW)
    return _only(keyed, verdict.where("kept"))


def near_duplicates(spark, docs, sf_dir):
    """One row of each group of copies and near-copies: that with the smallest id, and of repeated ids
    the first row; rows without an id come last."""
    keyed = _keyed(docs)
    groups = simhash.near_components(_by_row(keyed), width=3, most=BITS, similar=SIMILAR, sketch_width=5)
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(ROW).alias(ROW))
    places = keyed.select(ROW, place.alias("place"))
    first = (groups.select(F.col("doc_id").alias(ROW), "component_id").join(places, ROW)
             .groupBy("component_id").agg(F.min("place").alias("place")))
    return _only(keyed, first.select(f"place.{ROW}"))


def decontaminate(spark, docs, sf_dir):
    """Rows whose text holds no benchmark item; every row is judged by its own text."""
    return tiling.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark, docs, sf_dir):
    """The places of all token pieces in sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("packing", packed),
]

# A fitted classifier, fingerprints and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages from ``documents`` on; each result is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
