"""Token numbers and decoded texts equal the tokenizer library's, however the text is cut."""

import hashlib
import random

import numpy as np
import pytest

from terrane.llm import bpe
from terrane.llm.registry import word_vocabulary


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.load(word_vocabulary())


def texts():
    random.seed(2)
    letters = "aàeéiou'sstrenßΣİﬁ́́1234!!\"'.,#<|endoftext|>日本  \u0085 "
    pieces = ["<|endoftext|>", "don't", "'re", "é", "1", "日本", "…", "the", "<|", "\n"]
    for k in range(60):
        n = random.choice([10, 60, 300])
        yield "".join(random.choice(letters) for _ in range(n))
        yield "".join(random.choice("thernationing") for _ in range(n))
        yield "".join(random.choice("abc'!é") for _ in range(random.randint(1, 4))) * (n // 2)
        yield "".join(random.choice(pieces) for _ in range(n // 4))


def test_tree_and_words_equal_the_library(tokenizer):
    words, decoder = bpe.WordTable(tokenizer, room=50), bpe.Decoder(tokenizer)
    assert words.direct
    for text in texts():
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert words.encode(text).tolist() == want
        assert decoder.text(np.array(want)) == tokenizer.decode(want, skip_special_tokens=False)
        for piece in (7, 33, 128):
            assert bpe.encode_tree(tokenizer, text, piece).tolist() == want, (text, piece)


def test_every_row_of_a_table(odd_docs, tokenizer):
    for piece in (bpe.PIECE, 16):
        found = bpe.encode(odd_docs, word_vocabulary(), columns=("doc_id", "text"), keep_ids=True, piece=piece).collect()
        assert len(found) == 11
        for r in found:
            want = tokenizer.encode(r.text or "", add_special_tokens=False).ids
            assert r.ids == want and r.n_tokens == len(want)
            assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode(odd_docs.limit(0), word_vocabulary()).count() == 0
