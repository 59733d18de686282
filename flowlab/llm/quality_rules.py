"""Quality rules: counts that need no model, and a calibrated logistic regression on hashed word
and character n-grams, scored against a fixed threshold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from flowlab.llm.text import (
    SPACE, U64, buffer_of, byte_runs, combine, edges_of, hash_spans, mix, slices, sums_per_row, words_in)
from flowlab.tables import ship, unpack

# Labelled rows that the model is fitted on, at most (a fifth of them for the calibration).
FIT_ROWS = 4_000
# A text is kept if its calibrated probability of being good is at least this.
THRESHOLD = 0.5
# Feature groups: words, word pairs, pairs of bytes, runs of four bytes; each has its own buckets.
BUCKETS = (1 << 15, 1 << 15, 1 << 16, 1 << 16)
GROUP_START = np.cumsum((0, *BUCKETS))
SCALE = 20.0  # of relative frequencies, for the conditioning of the fit
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

SCORED = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, quality double, kept boolean")


def _bucket(h, size):
    return (h >> U64(64 - int(size).bit_length() + 1)).astype(np.int64)


class Texts:
    """Words, pairs and byte runs of a slice of texts."""

    def __init__(self, column):
        self.data, self.offsets = buffer_of(column)
        self.rows = len(column)
        self.starts, self.ends, self.counts = words_in(self.data, self.offsets)
        self.words = hash_spans(self.data, self.starts, self.ends)

    def features(self):
        """For each group the bucket of every n-gram in text order, and the n-grams per row."""
        yield _bucket(self.words, BUCKETS[0]), self.counts
        pairs = combine(self.words[:-1], self.words[1:])
        inner = np.ones(len(self.words), bool)
        ends = np.cumsum(self.counts)
        inner[ends[(ends > 0)] - 1] = False
        yield _bucket(pairs[inner[:-1]], BUCKETS[1]) if len(self.words) else np.zeros(0, np.int64), \
            np.maximum(self.counts - 1, 0)
        for width, size in ((2, BUCKETS[2]), (4, BUCKETS[3])):
            runs, n = byte_runs(self.data, self.offsets, width)
            if width == 4:
                runs = (runs * np.uint32(2654435769)) >> np.uint32(33 - int(size).bit_length())
            yield runs.astype(np.int64), n

    def base(self):
        """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every text."""
        word_byte = ~SPACE[self.data]
        spans = np.diff(self.offsets)
        chars = sums_per_row(word_byte & ((self.data & 0xC0) != 0x80), spans)
        symbols = sums_per_row(SYMBOLS[self.data], spans)
        return self.counts, chars, symbols, self._dup_lines(word_byte), self._repeat_words()

    def _dup_lines(self, word_byte):
        starts, ends = edges_of(self.data != 10, self.offsets)
        total = np.concatenate([[0], np.cumsum(word_byte)])
        some = total[ends] > total[starts]
        starts, ends = starts[some], ends[some]
        row = np.searchsorted(self.offsets, starts, "right") - 1
        key = combine(mix(row.astype(U64)), hash_spans(self.data, starts, ends))
        first = np.unique(key, return_index=True)[1]
        return np.bincount(row, minlength=self.rows) - np.bincount(row[first], minlength=self.rows)

    def _repeat_words(self):
        n = len(self.words)
        if n < 3:
            return np.zeros(self.rows, np.int64)
        row = np.repeat(np.arange(self.rows), self.counts)
        whole = row[:-2] == row[2:]
        at = np.flatnonzero(whole)
        key = combine(combine(combine(mix(row[at].astype(U64)), self.words[at]), self.words[at + 1]), self.words[at + 2])
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        for step in range(3):
            covered[at[twice] + step] = True
        return sums_per_row(covered, self.counts)


def sparse_rows(texts):
    """Per text the bucket numbers over all groups and their scaled relative frequencies."""
    columns, values, rows = [], [], []
    for (bucket, n), start in zip(texts.features(), GROUP_START):
        row = np.repeat(np.arange(texts.rows), n)
        key, count = np.unique(row * (1 << 20) + bucket, return_counts=True)
        rows.append(key >> 20)
        columns.append((key & (1 << 20) - 1) + start)
        values.append(SCALE * count / n[key >> 20])
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return row[order], np.concatenate(columns)[order], np.concatenate(values)[order]


def linear_scores(texts, weights):
    """Weighted sum of all features of every text, without building them."""
    total = np.zeros(texts.rows)
    for (bucket, n), start in zip(texts.features(), GROUP_START):
        total += SCALE * sums_per_row(weights[start + bucket].astype(np.float64), n) / np.maximum(n, 1)
    return total


def logistic_fit(rows, columns, values, y, size, penalty=1e-3, steps=60, memory=8):
    """Weights and intercept of an L2-penalised logistic regression, by L-BFGS."""
    n = len(y)
    sign = np.where(y, 1.0, -1.0)

    def loss(w):
        z = np.bincount(rows, values * w[columns], minlength=n) + w[-1]
        m = sign * z
        p = -sign / (1 + np.exp(np.clip(m, -500, 500))) / n
        g = np.append(np.bincount(columns, values * p[rows], minlength=size), p.sum())
        g[:-1] += penalty * w[:-1]
        return np.logaddexp(0, -m).mean() + penalty / 2 * (w[:-1] ** 2).sum(), g

    w = np.zeros(size + 1)
    value, g = loss(w)
    past = []
    for _ in range(steps):
        q, a = g.copy(), []
        for s, t in reversed(past):
            a.append(s @ q / (s @ t))
            q -= a[-1] * t
        if past:
            q *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1])
        for (s, t), x in zip(past, reversed(a)):
            q += s * (x - t @ q / (s @ t))
        step = 1.0
        while True:
            new = w - step * q
            after, h = loss(new)
            if after <= value - 1e-4 * step * (g @ q) or step < 1e-8:
                break
            step /= 2
        if value - after < 1e-7:
            break
        if (new - w) @ (h - g) > 1e-12:
            past = (past + [(new - w, h - g)])[-memory:]
        w, value, g = new, after, h
    return w[:-1], w[-1]


def calibration(z, y, steps=50):
    """Slope and intercept of the probability over scores of rows that the fit has not seen."""
    good, bad = int(y.sum()), int((~y).sum())
    target = np.where(y, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -500, 500)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - target) * z).sum() + 1e-3 * (a - 1), (p - target).sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum()]])
        step = np.linalg.solve(h + 1e-9 * np.eye(2), g)
        step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
    return a, b


def fit(docs, labels, rows=FIT_ROWS):
    """Fit on at most ``rows`` labelled documents, those with the smallest hashed ids.

    Features are made where the texts are; the fit is one task over that bounded sample. Returns
    (weights, intercept, slope, shift), or None if the sample lacks one of the two labels."""
    chosen = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
              .select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") > 0).alias("good"))
              .orderBy(F.xxhash64("doc_id"), "doc_id", "good").limit(rows))
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def featurise(batches):
        for batch in batches:
            for first, column in slices(batch.column("text")):
                row, columns, values = sparse_rows(Texts(column))
                cut = np.searchsorted(row, np.arange(len(column) + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(column)), batch.column("good").slice(first, len(column)),
                     pa.array([columns[a:b].astype("<i4").tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                     pa.array([values[a:b].astype("<f4").tobytes() for a, b in zip(cut, cut[1:])], pa.binary())],
                    names=["doc_id", "good", "columns", "values"])

    def train(batches):
        got = [(r["doc_id"], r["good"], np.frombuffer(r["columns"], "<i4"), np.frombuffer(r["values"], "<f4"))
               for batch in batches for r in batch.to_pylist()]
        got.sort(key=lambda r: r[0])
        got = got[:rows]
        good = np.array([r[1] for r in got], bool)
        size = int(GROUP_START[-1])
        held = np.arange(len(got)) % 5 == 0
        if len(got) < 10 or any(len(set(good[part].tolist())) < 2 for part in (held, ~held)):
            return
        fitted = [r for r, h in zip(got, held) if not h]
        row = np.repeat(np.arange(len(fitted)), [len(r[2]) for r in fitted])
        w, b = logistic_fit(row, np.concatenate([r[2] for r in fitted]),
                            np.concatenate([r[3] for r in fitted]).astype(np.float64), good[~held], size)
        z = np.array([r[3].astype(np.float64) @ w[r[2]] + b for r, h in zip(got, held) if h])
        slope, shift = calibration(z, good[held])
        yield pa.RecordBatch.from_pydict({"weights": [w.astype("<f4").tobytes()], "intercept": [float(b)],
                                          "slope": [float(slope)], "shift": [float(shift)]})

    features = sample.mapInArrow(featurise, "doc_id long, good boolean, columns binary, values binary")
    model = (features.repartition(1)
             .mapInArrow(train, "weights binary, intercept double, slope double, shift double").collect())
    if not model:
        return None
    m = model[0]
    return np.frombuffer(m["weights"], "<f4"), m["intercept"], m["slope"], m["shift"]


def judged(column, model, threshold):
    """The five counts, base verdict, quality (None without a model) and verdict of a string array."""
    texts = Texts(column)
    counts = texts.base()
    words, repeated = counts[0], counts[4]
    failed = (words < 50) | (100 * repeated > 50 * words)
    if model is None:
        return counts, failed, None, ~failed
    weights, intercept, slope, shift = model
    z = slope * (linear_scores(texts, weights) + intercept) + shift
    quality = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    return counts, failed, quality, ~failed & (quality >= threshold)


def score(docs, model, threshold=THRESHOLD):
    """Counts, probability of being good and verdict for every row of ``docs`` (doc_id, text).

    A text fails the base rule with fewer than 50 words, or if more than half of its words stand in
    repeated three-word windows. Null texts count as empty and fail. Without a model quality is
    null and the base rule decides alone. Repeated rows stay, other columns are ignored."""
    shipped = ship(docs.sparkSession, model)

    def work(batches):
        model = unpack(shipped)
        for batch in batches:
            for first, column in slices(batch.column("text")):
                counts, failed, quality, kept = judged(column, model, threshold)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(column)), *[pa.array(x.astype(np.int64)) for x in counts],
                     pa.array(failed), pa.nulls(len(column), pa.float64()) if quality is None else pa.array(quality),
                     pa.array(kept)], names=[f.split()[0] for f in SCORED.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, SCORED)


def passing(docs, model, threshold=THRESHOLD):
    """The rows of ``docs`` that are kept, with all their columns: a filter without a shuffle."""
    shipped = ship(docs.sparkSession, model)

    def work(batches):
        model = unpack(shipped)
        for batch in batches:
            kept = [judged(column, model, threshold)[3] for _, column in slices(batch.column("text"))]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(work, docs.schema)


def quality_rules(docs, labels, rows=FIT_ROWS, threshold=THRESHOLD):
    """Fit on the labelled documents and judge all of them."""
    return score(docs, fit(docs, labels, rows), threshold)
