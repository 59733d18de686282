"""Token alignment against whole texts encoded at once and a byte-by-byte version."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from flowlab.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
CLASH = "n_a int, n_best string, a string, b int, _row string"
TEXTS = [None, "", " ", "  two  blanks ", "one", "naïve café — “quoted” 世界🙂 🙂🙂", "a\n\nb \n c\t d e　f", "<|endoftext|> <s> </s> <unk> <0x0A>",
         "don't we'll I'm 12345 3.14159", "under▁score ▁▁ x", "́combining É", "ⴰⴱⴲ ꙮ \U00010348  x", "end. Start\nend.\nStart", "\r\nx\r\n",
         "word " * 4_000, "é" * 3_000, "\x00 \x01", "x" * 20_000 + " tail", "   lead", "tail   ", "a  b   c    d"]


def tables():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(x): x for x in shown}
    for x in range(256):
        if x not in shown:
            letters[chr(256 + len(letters) - len(shown))] = x
    def bytes_a(i):
        return bytes(letters[c] for c in a.id_to_token(i))
    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()
    return a, b, bytes_a, bytes_b


def plain(rows):
    a, b, bytes_a, bytes_b = tables()
    seen, counts = [], Counter()
    for i, text in rows:
        ids = [], []
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        parts = [bytes_a(x) for x in ids[0]], [bytes_b(x) for x in ids[1]]
        if not text or any(b"".join(p) != (" " + text).encode() for p in parts):
            seen.append((i, [], [], [], []))
            continue
        ends = []
        for part in parts:
            at, e = 0, []
            for x in part:
                at += len(x)
                e.append(at)
            ends.append(e)
        links, y = [], 0
        for x, end in enumerate(ends[0]):
            first = end - len(parts[0][x])
            while ends[1][y] <= first:
                y += 1
            z = y
            while z < len(ends[1]) and ends[1][z] - len(parts[1][z]) < end:
                links.append((ids[0][x], ids[1][z]))
                z += 1
        cuts, groups, p, q = sorted(set(ends[0]) & set(ends[1])), [], 0, 0
        for c in cuts:
            u, v = ends[0].index(c, p) + 1, ends[1].index(c, q) + 1
            groups.append(f"{','.join(map(str, ids[0][p:u]))}|{','.join(map(str, ids[1][q:v]))}")
            p, q = u, v
        counts.update(links)
        seen.append((i, *ids, groups, links))
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return Counter((i, len(x), len(y), len(groups), len(links), sum(counts[p] == top[p[1]] for p in links),
                    sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if x else "")
                   for i, x, y, groups, links in seen)


def found(df):
    return Counter((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"])
                   for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    return [(i * 2, t) for i, t in enumerate(TEXTS)] + [(10, TEXTS[5]), (10, TEXTS[5]), (None, "no id"), (10, None)]


@pytest.fixture(scope="module")
def awkward(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y", 2, "z") for i, t in rows], f"doc_id long, text string, {CLASH}")


def test_against_whole_texts(awkward, rows):
    want = plain(rows)
    assert found(alignment.align(awkward, A, B)) == want
    assert sum(n for r, n in want.items() if r[1] == 0) == 4  # two nulls, the empty one and the one with U+2581


def test_counts_sent_in_rounds(awkward, rows, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 3)
    assert found(alignment.align(awkward, A, B, max_pairs=40)) == plain(rows)


def test_no_rows(awkward):
    assert alignment.align(awkward.where("false"), A, B).count() == 0
    assert found(alignment.align(awkward.where("text = ''"), A, B)) == plain([(2, "")])


def test_offsets_inside_characters():
    """Tokens of " 世x y": a blank, two bytes and one byte of a character, x; then a blank and y."""
    starts, first_piece = np.array([0, 1, 4, 5, 6, 7]), np.array([0, 0, 0, 0, 5, 5])
    sizes = np.array([1, 2, 1, 1, 1, 1])
    for first, last in (([0, 1, 1, 2, 3, 4], [1, 2, 2, 3, 4, 5]), ([0, 1, 1, 2, 3, 4], [1, 1, 2, 3, 4, 5])):
        ends = alignment.ends_of(np.array(first), np.array(last), sizes, starts, first_piece)
        assert ends.tolist() == [1, 3, 4, 5, 6, 7]


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert found(queries.QUERIES["op12_token_alignment"](spark, sf)) == plain([tuple(r) for r in docs])
