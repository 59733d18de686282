"""Language-model scores from a probabilistic suffix tree over words.

States are contexts of no word, one word or two words. A context becomes a state if the words that
follow it diverge enough from what its longest shorter state predicts: the test adds up, over the
context's occurrences, the log ratio of both predictions with the occurrence itself left out of all
counts. Each state's distribution is smoothed towards that of its suffix, and every token of a text
is scored in the longest state that its past ends with.

The tree is never in one place. Texts are kept in blocks of tokens; a block asks for the totals of
its distinct words, pairs and triples, each counted once per block, so a frequent one is one row of
a block like any other. Requests are cut by ranges of hashes into shards, a shard adds up what all
blocks say and answers in the order asked. Four rounds of that give the counts of words, of pairs,
states of one word with the counts of triples, and states of two words."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from flowlab.llm.frames import partitions_for, removed, scratch, stored
from flowlab.llm.text import U64, combine, hashed_words, slices
from flowlab.tables import ship, unpack

# Tokens of a block, and requested keys that a shard gets, roughly.
BLOCK_TOKENS, SHARD_TOKENS = 1 << 20, 1 << 20
END, START = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)
WORD, PAIR, TRIPLE, GAIN = 0, 1, 2, 3
# Session settings while scoring: rows are blocks of some megabytes, so one at a time is enough for a
# Python worker; a round's shuffle files go once its answers are a table.
SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1",
            "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
# Bytes of a key behind the bits that its shard implies: words are told apart by nearly all 64 bits,
# the rest by 40 bits within a shard, whose size doesn't depend on the corpus.
KEY_BYTES = {WORD: 7, PAIR: 5, TRIPLE: 5, GAIN: 5}

BLOCKS = ("block long, doc_ids array<long>, held array<boolean>, counts array<long>, words binary, codes binary, "
          "n_train long, docs_train long")
REQUESTS = "kind int, shard int, block long, keys binary, amounts binary"
SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
          "score double")


@dataclass(frozen=True)
class Tree:
    """Parameters: a state of one word or of two needs this many occurrences and this divergence (in
    nats, over all of its occurrences); smoothing adds so many occurrences of the shorter state's
    distribution."""

    least: int = 16
    least_two: int = 16
    divergence: float = 3.0
    smooth_one: float = 1000.0
    smooth_two: float = 50.0


def blocks_of(docs):
    """Texts as blocks: distinct word hashes from frequent to rare, and for each token its place among
    them, so that most places are small numbers."""
    def work(batches):
        part, number = TaskContext.get().partitionId(), 0
        ids, held, counts, hashes, size = [], [], [], [], 0

        def block():
            h = np.concatenate(hashes)
            words, codes, seen = np.unique(np.append(h, START), return_inverse=True, return_counts=True)
            order = np.argsort(-seen, kind="stable")
            place = np.empty(len(order), "<u4")
            place[order] = np.arange(len(order))
            n, out = np.array(counts, np.int64), np.array(held, bool)
            return pa.RecordBatch.from_pydict(
                {"block": [part << 24 | number], "doc_ids": [ids], "held": [held], "counts": [counts],
                 "words": [planes(np.diff(words[order], prepend=U64(0)), 8)], "codes": [planes(place[codes[:-1]], 4)],
                 "n_train": [int(n[~out].sum())], "docs_train": [int((~out).sum())]},
                pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
                           ("counts", pa.list_(pa.int64())), ("words", pa.binary()), ("codes", pa.binary()),
                           ("n_train", pa.int64()), ("docs_train", pa.int64())]))

        for batch in batches:
            for first, column in slices(batch.column("text")):
                h, n = hashed_words(column)
                hashes.append(np.insert(h, np.cumsum(n), END))
                counts += (n + 1).tolist()
                ids += batch.column("doc_id").slice(first, len(column)).to_pylist()
                held += batch.column("held").slice(first, len(column)).to_pylist()
                size += len(hashes[-1])
                if size >= BLOCK_TOKENS:
                    yield block()
                    number += 1
                    ids, held, counts, hashes, size = [], [], [], [], 0
        if ids:
            yield block()

    return docs.mapInArrow(work, BLOCKS)


# ---- requests and answers

def planes(values, width):
    """Numbers byte by byte, first the lowest bytes of all, then the next: high bytes repeat, and pack
    well. Eight bytes in front hold the size of what is packed."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1)[:, :width].T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def totals_packed(values):
    """Planes of as many bytes as the largest total needs, behind one byte that says how many."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return bytes([width]) + planes(values, width)


def bits_packed(flags):
    """Eight flags a byte, behind one byte that says how many bits of the last one are unused."""
    return bytes([-len(flags) % 8]) + np.packbits(flags).tobytes()


def from_bits(raw):
    return np.unpackbits(np.frombuffer(raw, np.uint8, offset=1), count=8 * (len(raw) - 1) - raw[0]).astype(bool)


def from_planes(packed, width, kind):
    raw = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
    n = len(raw) // width
    out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.view(kind).reshape(-1)


def requests(kind, block, keys, amounts, shards):
    """Rows that ask for the totals of sorted distinct keys, and add this block's amounts to them. Keys
    are kept as steps from one to the next."""
    bits = shards.bit_length() - 1
    cut = np.searchsorted(keys, np.arange(1, shards, dtype=U64) << U64(64 - bits)) if bits else []
    width = KEY_BYTES[kind]
    short = (keys << U64(bits)) >> U64(64 - 8 * width)
    for shard, (a, b) in enumerate(zip([0, *cut], [*cut, len(keys)])):
        if b > a:
            yield {"kind": kind, "shard": shard, "block": block, "keys": planes(np.diff(short[a:b], prepend=U64(0)), width),
                   "amounts": planes(amounts[a:b], amounts.itemsize)}


def answered(asked, divergence):
    """A stored table of answers by shard, and from it one row per block: the answers to its requests,
    shard by shard, and how many different words with a positive total the shards have seen. Counts are
    answered by their totals, gains by whether the total reaches the divergence that a state needs."""
    def add_up(rows):
        kind = int(rows["kind"].iloc[0])
        real = kind == GAIN
        keys = [np.cumsum(from_planes(k, KEY_BYTES[kind], "<u8")) for k in rows["keys"]]
        amounts = np.concatenate([from_planes(x, 4 if real else 8, "<f4" if real else "<i8") for x in rows["amounts"]])
        unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, amounts.astype(np.float64), minlength=len(unique))
        total = total.astype("<f4") >= divergence if real else total.astype("<i8")
        pack = bits_packed if real else totals_packed
        ends = np.cumsum([len(k) for k in keys])
        return pd.DataFrame({
            "kind": rows["kind"], "shard": rows["shard"], "block": rows["block"],
            "totals": [pack(x) for x in np.split(total[inverse], ends[:-1])],
            "positive": [int((total > 0).sum()) if kind == WORD else 0] + [0] * (len(rows) - 1)})

    # stored, so that the requests are gone before the answers are put together
    rows = stored(asked.groupBy("kind", "shard").applyInPandas(
        add_up, "kind int, shard int, block long, totals binary, positive long"), "tree-answers")
    return rows, rows.groupBy("block").agg(
        F.collect_list(F.struct("kind", "shard", "totals")).alias("answers"), F.sum("positive").alias("positive"))


def answers_of(answers, kind):
    """A block's totals of one kind (for gains: flags) in the order of its keys."""
    rows = sorted((r["shard"], r["totals"]) for r in answers or () if r["kind"] == kind)
    if kind == GAIN:
        return np.concatenate([from_bits(raw) for _, raw in rows] or [np.zeros(0, bool)])
    return np.concatenate([from_planes(raw[1:], raw[0], "<i8") for _, raw in rows] or [np.zeros(0, "<i8")])


# ---- what a block knows

class Block:
    """Tokens of a block with their contexts; positions before a text's first token hold START."""

    def __init__(self, row):
        self.row = row
        # words of equal frequency stand in the order of their hashes, so steps are smaller numbers
        by_frequency = np.cumsum(from_planes(row["words"], 8, "<u8"))
        order = np.argsort(by_frequency)
        self.words = by_frequency[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.codes = place[from_planes(row["codes"], 4, "<u4")]
        self.counts = np.array(row["counts"], np.int64)
        self.start = np.cumsum(self.counts) - self.counts
        self.train = np.repeat(~np.array(row["held"], bool), self.counts)
        begin = int(np.searchsorted(self.words, START))
        self.before = np.empty_like(self.codes)
        self.before[1:] = self.codes[:-1]
        self.before[self.start] = begin
        self.begin = begin

    def paired(self):
        """Number the block's distinct pairs."""
        pair = combine(self.words[self.before], self.words[self.codes])
        self.pairs, self.pair = np.unique(pair, return_inverse=True)
        return self

    def sums(self, index, size, weights=None):
        """Training tokens (or their weights) per index."""
        return np.bincount(index[self.train], None if weights is None else weights[self.train], minlength=size)

    def word_round(self, shards):
        return requests(WORD, self.row["block"], self.words, self.sums(self.codes, len(self.words)), shards)

    def pair_round(self, shards):
        return requests(PAIR, self.row["block"], self.pairs, self.sums(self.pair, len(self.pairs)), shards)

    def counted(self, words, pairs, tree, n, v, docs):
        """Take in the counts of words and pairs."""
        self.tree = tree
        self.word_total = answers_of(words, WORD)
        self.pair_total = answers_of(pairs, PAIR)
        self.of_word = self.word_total[self.codes].astype(np.float64)
        self.root = (self.of_word + 1) / (n + v + 1)
        self.root_without = np.maximum(self.of_word, 1) / (n + v)
        as_context = self.word_total.astype(np.float64)
        as_context[self.begin] = docs
        self.context = as_context[self.before]
        self.of_pair = self.pair_total[self.pair].astype(np.float64)
        self.one_without = self._smooth(self.of_pair - 1, self.context - 1, tree.smooth_one, self.root_without)
        # contexts that occur often enough in the training texts
        self.candidates = np.flatnonzero(as_context >= tree.least)
        # two words of context: the pair that ends before the token; a text's first token has none
        self.past = np.empty_like(self.pair)
        self.past[1:] = self.pair[:-1]
        self.deep = np.ones(len(self.codes), bool)
        self.deep[self.start] = False
        self.past[self.start] = 0
        self.deep &= self.pair_total[self.past] >= tree.least_two
        at = np.flatnonzero(self.deep)
        self.deep_at = at
        self.triples, self.triple = np.unique(
            combine(self.pairs[self.past[at]], self.words[self.codes[at]]), return_inverse=True)
        self.deep_pairs, self.deep_pair = np.unique(self.past[at], return_inverse=True)
        return self

    @staticmethod
    def _smooth(count, context, weight, shorter):
        return (np.maximum(count, 0) + weight * shorter) / (np.maximum(context, 0) + weight)

    def state_round(self, shards):
        block = self.row["block"]
        gain = np.log(self.one_without / self.root_without)
        total = self.sums(self.before, len(self.words), gain)[self.candidates]
        yield from requests(GAIN, block, self.words[self.candidates], total.astype("<f4"), shards)
        train = self.train[self.deep_at]
        yield from requests(TRIPLE, block, self.triples,
                            np.bincount(self.triple[train], minlength=len(self.triples)), shards)

    def one_word_states(self, answers):
        """Take in which words are states, and the counts of triples."""
        state = np.zeros(len(self.words), bool)
        state[self.candidates] = answers_of(answers, GAIN)
        self.one = state[self.before]
        self.of_triple = answers_of(answers, TRIPLE)[self.triple].astype(np.float64)
        return self

    def deep_round(self, shards):
        at = self.deep_at
        shorter = np.where(self.one, self.one_without, self.root_without)[at]
        longer = self._smooth(self.of_triple - 1, self.pair_total[self.past[at]] - 1, self.tree.smooth_two, shorter)
        train = self.train[at]
        total = np.bincount(self.deep_pair[train], np.log(longer / shorter)[train], minlength=len(self.deep_pairs))
        yield from requests(GAIN, self.row["block"], self.pairs[self.deep_pairs], total.astype("<f4"), shards)

    def probabilities(self, answers):
        """Of every token, in the longest state that its past ends with."""
        p = np.where(self.one, self._smooth(self.of_pair, self.context, self.tree.smooth_one, self.root), self.root)
        at = self.deep_at
        state = answers_of(answers, GAIN)[self.deep_pair]
        at = at[state]
        p[at] = self._smooth(self.of_triple[state], self.pair_total[self.past[at]].astype(np.float64),
                             self.tree.smooth_two, p[at])
        return p


def score(docs, held_out, tree=Tree()):
    """Score every text of ``docs`` (doc_id, text), learning from those where ``held_out`` is false.

    ``held_out`` is a boolean column of ``docs``; null counts as false. Returns doc_id, held_out,
    n_tokens, n_known, train_tokens, base_score (add-one word model) and score, in log10. A null
    text is an empty one and has the end token alone; repeated rows count and stay as often as they
    stand there; other columns are ignored; an empty table gives an empty result."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                        F.coalesce(held_out, F.lit(False)).alias("held"))
    tables = []

    def bucketed(df, name):
        """Stored by block, so that later joins on it move nothing but answers."""
        path, label = scratch(spark, f"tree-{name}"), f"llm_tree_{name}_{uuid.uuid4().hex}"
        (df.write.format("parquet").option("compression", "zstd").option("path", path)
         .bucketBy(buckets, "block").saveAsTable(label))
        table = spark.table(label)
        table.scratch_path, table.label = path, label
        tables.append(table)
        return table

    buckets = partitions_for(spark)
    blocks = bucketed(blocks_of(texts), "blocks")
    n, docs_train, tokens = blocks.agg(
        F.coalesce(F.sum("n_train"), F.lit(0)), F.coalesce(F.sum("docs_train"), F.lit(0)),
        F.coalesce(F.sum(F.expr("aggregate(counts, 0L, (total, n) -> total + n)")), F.lit(0))).first()
    shards = 1 << max(0, int(tokens) // SHARD_TOKENS).bit_length()
    known = {"n": n, "docs": docs_train, "tree": tree, "shards": shards}
    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)

    def step(state, rounds, schema):
        shipped = ship(spark, known)

        def work(batches):
            k = unpack(shipped)
            for batch in batches:
                for at in range(batch.num_rows):
                    row = batch.slice(at, 1).to_pylist()[0]
                    block = Block(row)
                    if rounds > 0:
                        block.paired()
                    if rounds > 1:
                        block.counted(row["words_of"], row["pairs_of"], k["tree"], k["n"], k["v"], k["docs"])
                    if rounds > 2:
                        block.one_word_states(row["states_of"])
                    if rounds > 3:
                        yield scored(block, block.probabilities(row["deep_of"]), k["n"], k["v"])
                        continue
                    asked = (block.word_round, block.pair_round, block.state_round, block.deep_round)[rounds](k["shards"])
                    yield pa.RecordBatch.from_pylist(list(asked), pa.schema([
                        ("kind", pa.int32()), ("shard", pa.int32()), ("block", pa.int64()),
                        ("keys", pa.binary()), ("amounts", pa.binary())]))

        return state.mapInArrow(work, schema)

    try:
        state = blocks
        for rounds, name in enumerate(("words_of", "pairs_of", "states_of", "deep_of")):
            by_shard, by_block = answered(step(state, rounds, REQUESTS), tree.divergence)
            answers = bucketed(by_block, name)
            removed(spark, by_shard)
            if rounds == 0:
                known["v"] = answers.agg(F.coalesce(F.sum("positive"), F.lit(0))).first()[0]
            state = state.join(answers.select("block", F.col("answers").alias(name)), "block", "left")
        result = stored(step(state, 4, SCORES), "scores")
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    for table in tables:
        spark.sql(f"DROP TABLE {table.label}")
    removed(spark, *tables)
    return result


def scored(block, p, n, v):
    """Result rows of a block's texts."""
    sums = lambda x: np.add.reduceat(x, block.start)  # noqa: E731  every text has an end token
    return pa.RecordBatch.from_arrays(
        [pa.array(block.row["doc_ids"], pa.int64()), pa.array(block.row["held"], pa.bool_()), pa.array(block.counts),
         pa.array(sums((block.of_word > 0).astype(np.int64))), pa.array(np.full(len(block.counts), n, np.int64)),
         pa.array(sums(np.log10(block.root))), pa.array(sums(np.log10(p)))],
        names=[f.split()[0] for f in SCORES.split(", ")])
