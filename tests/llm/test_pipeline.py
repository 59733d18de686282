"""Every stage of the pipeline takes effect, and the pipeline equals its stages in a row."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from flowlab.llm import queries


def test_stages(spark, sf):
    docs = queries.table(spark, sf, "documents")
    columns, before = docs.columns, docs.count()
    labels = {r["doc_id"]: r["quality"] for r in queries.table(spark, sf, "labels").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf).cache()
        assert after.columns == columns, name
        n = after.count()
        good = lambda df: {r["doc_id"] for r in df.select("doc_id").collect() if labels.get(r["doc_id"]) == 1}
        if name in ("quality_rules", "quality_classifier"):
            assert len(good(after)) >= 0.9 * len(good(docs)), name
        if name in ("quality_rules", "near_duplicates", "decontamination"):
            assert n < before, name
        docs, before = after, n
    texts = [r["text"] for r in docs.select("text").collect()]
    assert len(texts) == len(set(texts))
    items = [r["text"] for r in queries.table(spark, sf, "benchmark").collect()]
    assert not any(item in text for item in items for text in texts)
    name, stage = corpus_pipeline.STAGES[-1]
    placed = stage(spark, docs, sf)
    assert placed.select("doc_id").distinct().count() == docs.count()


def test_run_on_no_documents(spark, sf, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        queries.table(spark, sf, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def odd_rows(spark, sf):
    """Documents with null ids, repeated ids and repeated rows; columns are those of ``documents``."""
    docs = queries.table(spark, sf, "documents").where("n_chars > 400").orderBy("doc_id").limit(60)
    null = F.lit(None).cast("long")
    columns = docs.columns
    own = docs.withColumn("text", F.concat(F.lit("copied or not, this row is another one: "), F.reverse("text")))
    return docs.unionByName(docs).unionByName(own.withColumn("doc_id", null)).unionByName(
        own.withColumn("doc_id", F.col("doc_id") % 2)).select(columns)


def test_stages_on_odd_ids(spark, sf):
    rows = odd_rows(spark, sf).collect()
    docs = spark.createDataFrame(rows, queries.table(spark, sf, "documents").schema)
    texts, stages = Counter(r["text"] for r in rows), dict(corpus_pipeline.STAGES)
    # noise aside, nothing tells a row without an id from another: some stay
    kept = stages["quality_classifier"](spark, docs, sf).collect()
    assert not Counter(kept) - Counter(rows) and any(r["doc_id"] is None for r in kept)
    # of each text one row stays, with the smallest id
    kept = stages["near_duplicates"](spark, docs, sf).collect()
    assert not Counter(kept) - Counter(rows) and max(Counter(r["text"] for r in kept).values()) == 1
    assert all(r["doc_id"] is not None for r in kept)
    alone = docs.where("doc_id is null")
    assert stages["near_duplicates"](spark, alone, sf).count() == len(
        {r["text"] for r in stages["near_duplicates"](spark, alone.unionByName(alone), sf).collect()}) > 0
    # every row is judged by its own text, whatever its id
    item = max((r["text"] for r in queries.table(spark, sf, "benchmark").collect()), key=len)
    held = F.lit(" before " + item + " after")
    marked = docs.limit(40).withColumn("text", held).withColumn("doc_id", F.lit(None).cast("long"))
    clean = stages["decontamination"](spark, docs, sf).collect()
    assert any(r["doc_id"] is None for r in clean)
    mixed = docs.unionByName(marked).unionByName(docs.limit(1).withColumn("text", held))
    assert Counter(stages["decontamination"](spark, mixed, sf).collect()) == Counter(clean)
    placed = stages["packing"](spark, docs, sf)
    assert placed.where("piece = 0").count() == sum(texts.values())
