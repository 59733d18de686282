import numpy as np
import pyarrow as pa

from flowlab.llm import encoding
from flowlab.llm.queries import tokenizer


def test_few_pieces_go_through_the_library_at_a_time(monkeypatch):
    """The library's results are large, so new pieces go through it in parts; ids are those of whole texts."""
    texts = ["one two three four five six", "", "seven eight nine  ten\n eleven café 中文 two one", "x"]
    made = encoding.Encoder(tokenizer("byte_bpe_50k.json"), "blank_led")
    whole = [made.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    sizes, library = [], made.tokenizer

    class Counted:
        def encode_batch_fast(self, pieces, **options):
            sizes.append(len(pieces))
            return library.encode_batch_fast(pieces, **options)

    made.tokenizer = Counted()
    monkeypatch.setattr(encoding, "TOGETHER", 3, raising=False)
    for _ in range(2):  # the second time all pieces are known
        ids, counts = made.encode(pa.array(texts))
        assert [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])] == whole
    assert max(sizes) <= 3 and sum(sizes) >= 10
