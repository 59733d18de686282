"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids meet.

Both tokenizers give character offsets of their tokens. These are the coarse cuts; where tokens are
smaller than a character (parts of a multibyte character, byte fallback) the decoded bytes of the
tokens refine them, so that every token has a range of bytes. Byte offsets at which tokens of both end
cut the tokens into groups; tokens whose ranges overlap are linked.

A text is cut at blanks at which both tokenizers surely start a token, so a group never crosses a cut.
Pieces repeat, and each distinct piece is encoded and aligned once per worker. Corpus counts of linked
ids are added up from counts of pieces; a second pass looks them up."""

from __future__ import annotations

import hashlib
import os
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from flowlab.llm.encoding import _SURE
from flowlab.llm.frames import removed, stored
from flowlab.llm.text import buffer_of, hash_spans, slices, sums_per_row
from flowlab.tables import ship, unpack

# Pieces that a worker remembers before it starts anew, and id pairs whose counts (17 bytes each) are
# sent to the workers at once; more pairs are sent in several rounds, by ranges of B ids.
REMEMBERED, MAX_PAIRS = 800_000, 4_000_000
# Characters of pieces that are encoded in a row.
RUN_CHARS = 1 << 14
# A pair of ids as one number.
B_BITS = 20
RESULT = ("n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def pieces(data, offsets):
    """Starts and ends of pieces: a text's start, and each blank behind a byte other than a blank and
    before a sure non-blank. Neither tokenizer joins tokens there: A starts a token at such a blank, and
    B has no piece with a blank behind anything but blanks."""
    n = len(data)
    start = np.zeros(n + 1, bool)
    if n > 2:
        start[1: n - 1] = (data[:-2] != 32) & (data[1:-1] == 32) & _SURE[data[2:]]
        last = offsets[1:][offsets[1:] > 0] - 1  # a blank that ends a text has its neighbour in the next one
        start[last] = False
    start[offsets] = True
    starts = np.flatnonzero(start[:n])
    return starts, np.append(starts[1:], n)


def byte_alphabet():
    """Characters that stand for bytes in a byte-level vocabulary: visible Latin-1 for itself, the
    other bytes in order from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def ends_of(first, last, sizes, starts, piece_starts):
    """Byte offsets at which tokens end. ``first`` and ``last`` are the tokens' characters, ``sizes`` their
    decoded bytes, ``starts`` the bytes before each character (and after the last), ``piece_starts`` the
    byte at which each token's piece starts. A token that fills its characters ends with them; others lie
    inside a character and go as far as the decoded bytes of their piece so far."""
    total = np.cumsum(sizes)
    fresh = np.ones(len(sizes), bool)
    fresh[1:] = piece_starts[1:] != piece_starts[:-1]
    before = np.maximum.accumulate(np.where(fresh, total - sizes, 0))
    inside = piece_starts + total - before
    return np.where(starts[last] - starts[first] == sizes, starts[last], inside)


def linked(a_ends, b_ends, a_starts, b_starts):
    """Positions of all tokens whose ranges overlap, as two arrays; tokens of each side cover the bytes."""
    low = np.searchsorted(b_ends, a_starts, "right")
    n = np.searchsorted(b_starts, a_ends, "left") - low
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def written(ids, ends):
    """Numbers below 100,000 in decimal, each with one byte behind it, as one byte array and its row of
    each byte."""
    power = 10 ** np.arange(4, -1, -1)
    cells = np.empty((len(ids), 6), np.uint8)
    cells[:, :5] = ids[:, None] // power % 10 + 48
    cells[:, 5] = ends
    keep = np.ones(cells.shape, bool)
    keep[:, :4] = ids[:, None] >= power[:4]
    return cells[keep].tobytes()


def _table(tokens):
    """Bytes of all tokens in a row and where each starts."""
    return np.frombuffer(b"".join(tokens), np.uint8), np.append(0, np.cumsum(list(map(len, tokens))))


class Aligner:
    """What a worker knows of pieces: their groups, linked ids and whether their bytes came back."""

    def __init__(self, path_a, path_b):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings are ordinary text here
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        decoded = {i: bytes(letters[c] for c in token) for token, i in vocabulary.items()}
        self.bytes_a = _table([decoded.get(i, b"") for i in range(max(decoded) + 1)])
        self.bytes_b = _table([bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i)
                               else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.vocab_size())])
        self.forget()

    def forget(self):
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.texts = []
        self.numbers = np.zeros((0, 4), np.int64)  # A tokens, B tokens, groups, links
        self.good = np.zeros(0, bool)
        self.codes = np.zeros(0, np.int64)  # linked ids, piece by piece

    def learn(self, new):
        """Encode and align pieces. Those that start and end as inside a text are encoded in a row (a
        written U+2581 is a blank to B, and stands alone); each piece starts with a blank, which B adds by
        itself to the first."""
        plain = [len(p) > 1 and p[-1] != " " and "▁" not in p and _SURE[p[1].encode()[0]] for p in new]
        runs, run, size = [], [], 0
        for k, fine in enumerate(plain):
            if not fine:
                runs.append([k])
                continue
            run.append(k)
            size += len(new[k])
            if size > RUN_CHARS:
                runs.append(run)
                run, size = [], 0
        runs += [run] * bool(run)
        order = [k for r in runs for k in r]
        texts = ["".join([new[k] for k in r]) for r in runs]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        base = np.cumsum(lengths) - lengths
        ids_a, spans_a, ids_b, spans_b = [], [], [], []
        coded = self.b.encode([t[1:] for t in texts], return_type="offset_mapping", num_threads=1)
        for x, y, at in zip(self.a.encode_batch(texts, add_special_tokens=False), coded, base.tolist()):
            ids_a += x.ids
            spans_a.append(np.array(x.offsets, np.int64).reshape(-1, 2) + at)
            ids_b += y["ids"]
            # B's offsets leave out the blank it added
            spans = np.array(y["offsets"], np.int64).reshape(-1, 2) + 1 + at
            spans[:1, 0] = at
            spans_b.append(spans)
        pieces_in = [new[k] for k in order]
        whole = "".join(pieces_in)
        raw = np.frombuffer(whole.encode(), np.uint8)
        starts = np.append(np.flatnonzero(raw & 0xC0 != 0x80), len(raw))
        chars = np.fromiter(map(len, pieces_in), np.int64, len(pieces_in))
        first_char = np.cumsum(chars) - chars
        sides = [self.side(np.array(ids, np.int64), np.concatenate(spans), table, starts, first_char, raw)
                 for ids, spans, table in ((ids_a, spans_a, self.bytes_a), (ids_b, spans_b, self.bytes_b))]
        good = sides[0][-1] & sides[1][-1]
        n = len(pieces_in)
        (a, ends_a, piece_a), (b, ends_b, piece_b) = (tuple(x[good[piece]] for x in (ids, ends, piece))
                                                      for ids, ends, piece, _ in sides)
        # ranges of bytes with the pieces that are left out taken away
        first_byte = starts[first_char]
        start_a, start_b = (np.maximum(np.append(0, e[:-1]), first_byte[x])[: len(e)] for e, x in ((ends_a, piece_a), (ends_b, piece_b)))
        i, j = linked(ends_a, ends_b, start_a, start_b)
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        piece_ends = starts[first_char + chars]
        # behind a token: a comma inside a side, a bar behind side A, and behind B a new group or piece
        behind_a = np.where(np.append(group_a[1:] != group_a[:-1], True)[: len(a)], 124, 44)
        last_b = np.append(group_b[1:] != group_b[:-1], True)[: len(b)]
        behind_b = np.where(last_b, np.where(ends_b == piece_ends[piece_b], 10, 59), 44)
        side = np.repeat([0, 1], [len(a), len(b)])
        rank = np.lexsort((side, np.concatenate([group_a, group_b])))
        text = written(np.concatenate([a, b])[rank], np.concatenate([behind_a, behind_b])[rank]).decode().split("\n")
        numbers = np.stack([np.bincount(piece_a, minlength=n), np.bincount(piece_b, minlength=n),
                            np.bincount(piece_b[last_b], minlength=n), np.bincount(piece_a[i], minlength=n)], axis=1)
        texts = [""] * n
        for k, t in zip(np.flatnonzero(good).tolist(), text):
            texts[k] = t
        return order, texts, numbers, good, a[i] << B_BITS | b[j]

    @staticmethod
    def side(ids, spans, table, starts, first_char, raw):
        """Ids, ends and pieces of one tokenizer's tokens, and which pieces come back byte for byte."""
        flat, at = table
        sizes = at[ids + 1] - at[ids]
        piece = np.searchsorted(first_char, spans[:, 0], "right") - 1
        first_byte, n = starts[first_char], len(first_char)
        length = np.diff(np.append(first_byte, len(raw)))
        good = np.bincount(piece, sizes, n).astype(np.int64) == length
        ends = ends_of(spans[:, 0], spans[:, 1], sizes, starts, first_byte[piece])
        keep = good[piece]
        spot = np.repeat(at[ids[keep]] - (np.cumsum(sizes[keep]) - sizes[keep]), sizes[keep]) + np.arange(int(sizes[keep].sum()))
        wrong = flat[spot] != raw[np.repeat(good, length)]
        bad = np.repeat(np.arange(n), np.where(good, length, 0))[wrong]
        good[bad] = False
        return ids, ends, piece, good

    def places(self, column):
        """Place of every piece of all texts of an array, and pieces per text."""
        data, offsets = buffer_of(column)
        starts, ends = pieces(data, offsets)
        unique, index, inverse = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, unique), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[at] != unique if len(self.keys) else np.ones(len(unique), bool))
        if len(new):
            raw = data.tobytes()
            order, texts, numbers, good, codes = self.learn(
                [raw[starts[k]: ends[k]].decode("utf-8", "replace") for k in index[new]])
            keys = np.concatenate([self.keys, unique[new[order]]])
            place = np.concatenate([self.place, len(self.texts) + np.arange(len(new))])
            rank = np.argsort(keys, kind="stable")
            self.keys, self.place = keys[rank], place[rank]
            self.texts += texts
            self.numbers = np.concatenate([self.numbers, numbers])
            self.good = np.concatenate([self.good, good])
            self.codes = np.concatenate([self.codes, codes])
            at = np.searchsorted(self.keys, unique)
        return self.place[at][inverse], np.diff(np.searchsorted(starts, offsets))


def worker_aligner(path_a, path_b):
    """The aligner of this Python worker; workers are reused by later tasks, and so is what it knows."""
    module = sys.modules.setdefault("_flowlab_worker", types.ModuleType("_flowlab_worker"))
    made = module.__dict__.setdefault("aligners", {})
    if (path_a, path_b) not in made:
        made[path_a, path_b] = Aligner(path_a, path_b)
    return made[path_a, path_b]


def _batches(batches, aligner):
    """Slices of the rows with the places of their pieces, pieces per row, and whether a row has tokens."""
    for batch in batches:
        for first, texts in slices(batch.column("text")):
            sizes = np.asarray(pc.binary_length(texts), np.int64)
            place, n = aligner.places(pc.binary_join_element_wise(pa.scalar("", texts.type), texts, pa.scalar(" ", texts.type)))
            good = (sizes > 0) & (sums_per_row(~aligner.good[place], n) == 0)
            yield batch.slice(first, len(texts)), place, n, good


def pair_counts(texts, path_a, path_b):
    """How many links of the corpus hold each pair of ids: a, b, n."""
    def work(batches):
        aligner = worker_aligner(path_a, path_b)
        totals = np.zeros(0, np.int64)

        def flush():
            links = aligner.numbers[: len(totals), 3]
            codes, inverse = np.unique(aligner.codes[: int(links.sum())], return_inverse=True)
            n = np.bincount(inverse, np.repeat(totals, links), minlength=len(codes)).astype(np.int64)
            codes, n = codes[n > 0], n[n > 0]
            return pa.RecordBatch.from_arrays(
                [pa.array((codes >> B_BITS).astype(np.int32)), pa.array((codes & (1 << B_BITS) - 1).astype(np.int32)), pa.array(n)],
                names=["a", "b", "n"])

        for _, place, n, good in _batches(batches, aligner):
            seen = np.bincount(place[np.repeat(good, n)], minlength=len(aligner.texts))
            seen[: len(totals)] += totals
            totals = seen
            if len(totals) > REMEMBERED:  # what is known goes before the next slice
                yield flush()
                totals = np.zeros(0, np.int64)
                aligner.forget()
        yield flush()

    found = texts.select("text").mapInArrow(work, "a int, b int, n long")
    return found.groupBy("a", "b").agg(F.sum("n").alias("n"))


def aligned(texts, path_a, path_b, shipped):
    """Results of every row; counts are those of the shipped pairs (sorted codes, counts, best or not)."""
    names = [f.split()[0] for f in RESULT.split(", ")]

    def work(batches):
        codes, counts, best = unpack(shipped)
        aligner = worker_aligner(path_a, path_b)
        scores = np.zeros((0, 2), np.int64)  # links that are best, sum of counts, by piece
        for rows, place, n, good in _batches(batches, aligner):
            if len(scores) < len(aligner.texts):
                links = aligner.numbers[:, 3]
                new = aligner.codes[int(links[: len(scores)].sum()):]
                at = np.minimum(np.searchsorted(codes, new), max(len(codes) - 1, 0))
                there = codes[at] == new if len(codes) else np.zeros(len(new), bool)
                each = np.zeros((len(new), 2), np.int64)
                each[there, 0], each[there, 1] = best[at[there]], counts[at[there]]
                scores = np.concatenate([scores, sums_per_row(each, links[len(scores):])])
            sums = sums_per_row(np.concatenate([aligner.numbers[place], scores[place]], axis=1), n) * good[:, None]
            at, digests = 0, []
            for size, ok in zip(n.tolist(), good.tolist()):
                groups = ";".join(map(aligner.texts.__getitem__, place[at: at + size].tolist())) if ok else None
                digests.append(hashlib.sha256(groups.encode()).hexdigest() if ok else "")
                at += size
            if len(aligner.texts) > REMEMBERED:
                aligner.forget()
                scores = np.zeros((0, 2), np.int64)
            kept = [rows.column(c) for c in rows.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                kept + [pa.array(s) for s in sums.T] + [pa.array(digests, pa.string())],
                names=[c for c in rows.schema.names if c != "text"] + names)

    keys = ", ".join(f"{c} long" for c in texts.columns if c != "text")
    return texts.mapInArrow(work, f"{keys}, {RESULT}")


def _rounds(sizes, most):
    """Cut B ids (with their numbers of pairs, in order) into ranges of at most ``most`` pairs."""
    cuts, held = [], 0
    for b, n in sizes:
        if held + n > most and held:
            cuts.append(b)
            held = 0
        held += n
    return list(zip([0, *cuts], [*cuts, 1 << 31]))


def align(docs, path_a, path_b, max_pairs=MAX_PAIRS):
    """Alignment of both tokenizers over every row of ``docs`` (doc_id, text; other columns are ignored).

    ``path_a`` is a byte-level vocabulary of the tokenizers library, which gets a blank before the text;
    ``path_b`` a sentencepiece model with byte fallback, which adds one itself. Returns doc_id, n_a, n_b,
    n_groups, n_links, n_best (links whose count is their B id's highest, ties included), count_sum (of
    counts over links) and groups_sha256. Null and empty texts, and texts that either tokenizer doesn't
    give back byte for byte, have no tokens: zeros and an empty digest, and they count nowhere. Repeated
    rows and ids stay and each row counts; an empty table gives no rows."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pairs = stored(pair_counts(texts, path_a, path_b), "pairs")
    top = pairs.groupBy("b").agg(F.max("n").alias("top"), F.count(F.lit(1)).alias("size"))
    # at most one row per id of B's vocabulary
    rounds = _rounds([(r["b"], r["size"]) for r in top.orderBy("b").collect()], max_pairs)
    marked = pairs.join(top, "b").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))
    if len(rounds) > 1:
        texts = stored(texts.withColumn("_row", F.monotonically_increasing_id()), "texts")
    parts = []
    for low, high in rounds:
        got = marked.where((F.col("b") >= low) & (F.col("b") < high)).toArrow()
        code = np.asarray(got.column("a"), np.int64) << B_BITS | np.asarray(got.column("b"), np.int64)
        order = np.argsort(code)
        parts.append(aligned(texts, path_a, path_b, ship(spark, (
            code[order], np.asarray(got.column("n"), np.int64)[order], np.asarray(got.column("best"))[order]))))
    removed(spark, pairs)
    if len(parts) == 1:
        return parts[0]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    same = [F.first(c).alias(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    return (whole.groupBy("_row").agg(*same, F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"),
                                      F.first("groups_sha256").alias("groups_sha256")).drop("_row"))
