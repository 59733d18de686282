"""Encoding whole texts with a public tokenizer, each distinct piece of text once per worker.

The tokenizer is the slow part, and texts repeat their words. A text is cut where the tokenizer
itself always cuts, equal pieces are recognised by a 64-bit hash, and only pieces that the worker
has not met go through the library. Ids are those of encoding the whole text."""

from __future__ import annotations

import os
import sys
import types

import numpy as np

from flowlab.llm.text import SPACE, buffer_of, edges_of, hash_spans

# Bytes of text that are encoded together: what is new in them is merged into what is known once.
ENCODED_BYTES = 2 << 20
# Pieces that go through the library together.
TOGETHER = 8_192
# Pieces that a worker remembers (about 30 bytes each) before it starts anew.
REMEMBERED = 1_500_000

# A byte-level tokenizer starts a token at each ASCII blank before something that is surely no
# white space: a visible ASCII character or the first byte of a longer character, except for the
# lead bytes under which Unicode has white space.
_SURE = np.zeros(256, bool)
_SURE[0x21:0x7F] = True
_SURE[0xC3:0xF5] = True
_SURE[[0xE1, 0xE2, 0xE3]] = False


def blank_led_pieces(data, offsets):
    """Pieces that start at a text's start or at a blank before a sure non-blank; they cover all."""
    n = len(data)
    start = np.zeros(n + 1, bool)
    if n > 1:
        start[: n - 1] = (data[:-1] == 32) & _SURE[data[1:]]
        # a blank that ends a text has its neighbour in the next one
        last = offsets[1:][offsets[1:] > 0] - 1
        start[last] = False
    start[offsets] = True
    starts = np.flatnonzero(start[:n])
    return starts, np.append(starts[1:], n)


def words(data, offsets):
    """Words between ASCII white space, which the tokenizer drops."""
    return edges_of(~SPACE[data], offsets)


SPLITTERS = {"blank_led": blank_led_pieces, "words": words}


class Encoder:
    """``encode`` gives the ids of all texts of a string array in one array, and their counts."""

    def __init__(self, path, splitter):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text here
        self.split = SPLITTERS[splitter]
        self.forget()

    def forget(self):
        self.keys = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def encode(self, column):
        data, offsets = buffer_of(column)
        starts, ends = self.split(data, offsets)
        unique, index, inverse = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        places = self.places(unique, data, starts[index], ends[index])
        place = places[inverse]
        size = self.size[place]
        total = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        ids = self.ids[np.repeat(self.first[place] - total[:-1], size) + np.arange(total[-1])]
        return ids, np.diff(total[np.searchsorted(starts, offsets)])

    def places(self, unique, data, starts, ends):
        if len(self.keys) > REMEMBERED:
            self.forget()
        at = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == unique[inside]
        new = np.flatnonzero(~known)
        if len(new):
            raw, sizes, ids = data.tobytes(), [], [self.ids]
            # the library's results are some hundred bytes a piece, so only a few are there at a time
            for a in range(0, len(new), TOGETHER):
                some = new[a: a + TOGETHER]
                pieces = [raw[x:y].decode("utf-8", "replace") for x, y in zip(starts[some].tolist(), ends[some].tolist())]
                encoded = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
                sizes += map(len, encoded)
                ids.append(np.array([i for e in encoded for i in e], np.uint32))
            size = np.array(sizes, np.int64)
            first = len(self.ids) + np.cumsum(size) - size
            self.ids = np.concatenate(ids)
            keys = np.concatenate([self.keys, unique[new]])
            order = np.argsort(keys, kind="stable")
            self.keys = keys[order]
            self.first = np.concatenate([self.first, first])[order]
            self.size = np.concatenate([self.size, size])[order]
            at = np.searchsorted(self.keys, unique)
        return at


def worker_encoder(path, splitter):
    """The encoder of this Python worker; workers are reused by later tasks, and so is what it knows."""
    module = sys.modules.setdefault("_flowlab_worker", types.ModuleType("_flowlab_worker"))
    made = module.__dict__.setdefault("encoders", {})
    if (path, splitter) not in made:
        made[path, splitter] = Encoder(path, splitter)
    return made[path, splitter]
