"""The word encoder of packing: the tokenizer's ids, whatever it remembers, in little memory."""

import sys

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from gaugeflow.llm import packing

FILE = public_tokenizers.path("word_bpe_49k.json")


def test_ids_are_the_tokenizer_s_before_and_after_words_are_forgotten(monkeypatch):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghij,.ÄéĀ漢7-"), rng.integers(1, 9))) for _ in range(3000)]
    texts = ["", " ", "\n\t", *(" ".join(rng.choice(words, 40)) for _ in range(200))]
    plain = Tokenizer.from_file(FILE)
    plain.encode_special_tokens = True
    expected = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for most, learned in ((1_000_000, 20_000), (100, 7)):
        monkeypatch.setattr(packing, "REMEMBERED", most)
        monkeypatch.setattr(packing, "LEARNED", learned)
        encoder = packing.WordEncoder(FILE)
        for _ in range(2):
            assert list(encoder.packed(texts, 1000)) == expected


def test_remembered_words_take_few_bytes():
    encoder = packing.WordEncoder(FILE)
    before = set(vars(encoder)) - {"tokenizer", "ends_word"}
    list(encoder.packed([" ".join(f"w{i}" for i in range(50_000))]))

    def held(x):
        if isinstance(x, np.ndarray):
            return x.nbytes
        return sys.getsizeof(x) + (sum(sys.getsizeof(a) + sys.getsizeof(b) for a, b in x.items()) if isinstance(x, dict) else 0)

    assert sum(held(getattr(encoder, name)) for name in before) < 64 * 50_000  # a dict of strings and bytes: over 150 each
