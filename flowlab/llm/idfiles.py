"""Token ids as files: ids ranked by frequency, byte-aligned variable-length numbers.

Every number takes one to four bytes in a data stream; two bits in a separate control stream say
how many, so a control byte describes four numbers. Frequent ids have small ranks and mostly take
one byte. Decoding looks control bytes up in a table and needs no loop over numbers.

A file set is a folder with ``blocks`` (Parquet rows of whole documents in ascending doc_id order:
shard, block, first id within the shard, doc ids, id counts, control bytes, data bytes) and
``ranks`` (rank, id)."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlab.llm.encoding import ENCODED_BYTES, worker_encoder
from flowlab.llm.frames import partitions_for, stored
from flowlab.llm.text import slices
from flowlab.tables import ship, unpack

# A block is closed when it has this many ids.
BLOCK_IDS = 1 << 18
# Bytes of each of the four numbers that a control byte describes.
SIZES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1

ENCODED = "doc_id long, n long, ids binary"
BLOCKS = "shard int, block int, first long, doc_ids array<long>, counts array<long>, control binary, data binary"


def pack_numbers(values):
    """Control and data bytes of an array of numbers below 2**32."""
    values = np.ascontiguousarray(values, "<u4")
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    code = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    code[: len(values)] = size - 1
    control = code[0::4] | code[1::4] << 2 | code[2::4] << 4 | code[3::4] << 6
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


def unpack_numbers(control, data, n):
    """The numbers that ``pack_numbers`` wrote."""
    size = SIZES[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    values = np.zeros((n, 4), np.uint8)
    values[np.arange(4) < size[:, None]] = np.frombuffer(data, np.uint8)
    return values.view("<u4").reshape(-1)


def encoded(docs, tokenizer, end_id, splitter):
    """Every document's ids and the end id as little-endian numbers; null texts count as empty."""
    def work(batches):
        encoder = worker_encoder(tokenizer, splitter)
        kind = np.dtype("<u2" if encoder.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        for batch in batches:
            for first, texts in slices(batch.column("text"), ENCODED_BYTES):
                ids, counts = encoder.encode(texts)
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id).astype(kind)
                # 64-bit offsets are not needed: a slice has one long text or about two megabytes
                offsets = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]) * kind.itemsize
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(texts)).cast(pa.int64()),
                     pa.array(counts + 1, pa.int64()),
                     pa.BinaryArray.from_buffers(pa.binary(), len(texts), [
                         None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids)])],
                    names=["doc_id", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, ENCODED)


def numbers_of(ids, n):
    """Ids of one row: the width follows from the bytes."""
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4")


def frequencies(table):
    """How often each id occurs: one partial count per id and task, then a sum per id."""
    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for n, ids in zip(batch.column("n").to_pylist(), batch.column("ids")):
                own = np.bincount(numbers_of(ids.as_buffer(), n), minlength=len(total))
                own[: len(total)] += total
                total = own
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["id", "n"])

    return table.select("n", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs, path, tokenizer, end_id=1, splitter="words"):
    """Encode ``docs`` (doc_id, text) and write the file set below ``path``.

    Documents stand in ascending doc_id order, null ids first; repeated ids keep all their rows."""
    spark = docs.sparkSession
    table = stored(encoded(docs, tokenizer, end_id, splitter), "ids")
    # one row per id of the vocabulary: bounded by the tokenizer
    ids = [r["id"] for r in frequencies(table).orderBy(F.desc("n"), "id").collect()]
    spark.createDataFrame(pa.table({"rank": pa.array(range(len(ids)), pa.int64()), "id": pa.array(ids, pa.int64())})
                          ).coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(max(ids, default=0) + 1, np.uint32)
    rank[ids] = np.arange(len(ids))
    ranks = ship(spark, rank)

    def blocks(batches):
        rank, shard = unpack(ranks), TaskContext.get().partitionId()
        state = {"block": 0, "first": 0}
        keys, counts, values, held = [], [], [], 0

        def closed():
            control, data = pack_numbers(np.concatenate(values))
            row = {"shard": [shard], "block": [state["block"]], "first": [state["first"]], "doc_ids": [keys],
                   "counts": [counts], "control": [control], "data": [data]}
            state["block"] += 1
            state["first"] += held
            return pa.RecordBatch.from_pydict(row, pa.schema([
                ("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                ("counts", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())]))

        for batch in batches:
            for key, n, own in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(),
                                   batch.column("ids")):
                keys.append(key)
                counts.append(n)
                values.append(rank[numbers_of(own.as_buffer(), n)])
                held += n
                if held >= BLOCK_IDS:
                    yield closed()
                    keys, counts, values, held = [], [], [], 0
        if held:
            yield closed()

    (table.repartitionByRange(partitions_for(spark), "doc_id").sortWithinPartitions("doc_id")
     .mapInArrow(blocks, BLOCKS).write.parquet(f"{path}/blocks"))


def read(spark, path):
    """The file set as blocks with the ids before each block in all files (column ``start``).

    There is one offset per shard, so the offsets stay as few as the files."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    totals = blocks.groupBy("shard").agg(
        F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("_total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    return (blocks.join(F.broadcast(offsets), "shard")
            .withColumn("start", F.col("first") + F.col("_before")).drop("_before", "first"))


def documents(spark, path):
    """Every document's ids from the files: doc_id, start, n_tokens, ids_crc32 and ids (binary)."""
    ranks = ship(spark, np.array([r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()],
                                 "<u4"))

    def work(batches):
        ids_of = unpack(ranks)
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.array(row["counts"], np.int64)
                ids = ids_of[unpack_numbers(row["control"], row["data"], int(counts.sum()))]
                ends = np.cumsum(counts)
                raw = memoryview(ids.tobytes())
                each = [bytes(raw[4 * a: 4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends - counts),
                     pa.array(counts), pa.array([zlib.crc32(x) for x in each], pa.int64()),
                     pa.array(each, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return read(spark, path).mapInArrow(
        work, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
