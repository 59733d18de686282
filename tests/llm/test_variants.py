"""Spelling variants against a plain version that tries every edit of every word."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from flowlab.llm import queries, variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")
CLASH = "word string, n int, form string, root string, block int, route string"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(rows, shortest=5, rarest=3):
    counts = Counter()
    for i, text in rows:
        for run in map(low, RUN.findall(text or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= shortest and k >= rarest}
    letters = sorted({c for w in n for c in w})
    form, near = {}, {}
    for w in n:
        edits = {w[:i] + w[i + 1:] for i in range(len(w))}
        edits |= {w[:i] + c + w[i + d:] for i in range(len(w) + 1) for d in (0, 1) for c in letters}
        near[w] = (edits & n.keys()) - {w}
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    bases = ["".join(rng.choice("aeiounrstlàéß") for _ in range(rng.randint(5, 9))) for _ in range(25)] + ["aaaaa", "aaaaaa", "Ängström"]
    words = []
    for base in bases:
        for _ in range(12):
            w = base
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice("aeé") + w[at:], w[:at] + rng.choice("ont") + w[at + 1:]])
            words += [w] * rng.choice([1, 3, 6, 12, 40])
    rng.shuffle(words)
    long = "x" * 400
    texts = [" ".join(words[k::20]) for k in range(20)] + [f"{long}a {long}b {long}a {long}a {long}b {long}b {long}b"] * 2
    out = [(k * 5, t) for k, t in enumerate(texts)] + [
        (None, "Wörter ohne Id WÖRTER wÖrter wörter"), (1, None), (2, ""), (3, " \n\t 123 ×÷ ŁÓDŹ ×÷×÷× ×÷×÷× ×÷×÷×"), (15, texts[3]), (15, texts[3])]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "f", "r", 2, "q") for i, t in rows], f"doc_id long, text string, {CLASH}")


def found(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_against_all_edits(spark, rows):
    want = plain(rows)
    assert len(want) > 100 and sum(f is not None for _, f, *_ in want) > 30
    assert any(f is not None and f != r for _, f, r, *_ in want)
    assert found(variants.spelling_variants(frame(spark, rows))) == want


def test_split_routes_give_the_same(spark, rows, monkeypatch):
    monkeypatch.setattr(variants, "BLOCK", 3)
    monkeypatch.setattr(variants, "STATES", 64)
    monkeypatch.setattr(variants, "PAIRS", 16)
    assert found(variants.spelling_variants(frame(spark, rows))) == plain(rows)


def test_no_rows_and_no_words(spark):
    df = frame(spark, [(1, "abcde abcde"), (2, None)])
    assert variants.spelling_variants(df).count() == 0
    assert variants.spelling_variants(df.where("false")).count() == 0
    assert found(variants.spelling_variants(df, rarest=1)) == plain([(1, "abcde abcde"), (2, None)], rarest=1)


def test_checksums_and_trie_search():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5_000).astype(np.uint8)
    starts = np.sort(rng.integers(0, 4_800, 300))
    ends = starts + rng.integers(0, 180, 300)
    before = np.array([zlib.crc32(str(k).encode()) for k in range(300)], np.uint32)
    want = [zlib.crc32(data[a:b].tobytes(), int(c)) for a, b, c in zip(starts, ends, before)]
    assert variants.crc32_spans(data, starts, ends, before).tolist() == want
    counts = rng.integers(0, 3, (200, variants.GROUPS))
    counts[100:] = counts[:100]
    counts[np.arange(100, 150), rng.integers(0, variants.GROUPS, 50)] += 1
    trie = variants.CountTrie(counts)
    got = {(i, j) for a, b in trie.search(counts) for i, j in zip(a.tolist(), b.tolist())}
    d = counts[None] - counts[:, None]
    near = (np.maximum(d, 0).sum(2) <= 1) & (np.maximum(-d, 0).sum(2) <= 1)
    assert got == set(zip(*(x.tolist() for x in np.nonzero(near))))


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert found(queries.QUERIES["op11_spelling_variants"](spark, sf)) == plain([tuple(r) for r in docs])
