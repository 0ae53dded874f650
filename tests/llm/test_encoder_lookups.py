"""The encoder looks up each different part of a group of texts once, and gives the library's ids."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tapeline.llm import token_store

PATH = public_tokenizers.path("word_bpe_49k.json")


class Counted(dict):
    looked_up = 0

    def get(self, *key):
        self.looked_up += 1
        return super().get(*key)


@pytest.mark.parametrize("end", ["", " don't"])
def test_each_different_part_is_looked_up_once(end):
    texts = [f"Some words, again and again {i % 7}!{end}" for i in range(2000)]
    encoder = token_store.Encoder(PATH)
    encoder.runs, encoder.words = Counted(), Counted()
    got = encoder.encode([x.encode() for x in texts], 2)
    library = Tokenizer.from_file(PATH)
    want = {x: np.array([*library.encode(x, add_special_tokens=False).ids, 2], "<u4").tobytes() for x in set(texts)}
    assert got == [want[x] for x in texts]
    assert encoder.runs.looked_up + encoder.words.looked_up < 20


def test_parts_of_awkward_texts():
    rng = random.Random(11)
    texts = ["".join(rng.choices("aZ9 ,'|\t\n\r\x0b\x0c\x1c\x85éß日 　", k=rng.randrange(12))).encode() for _ in range(500)] + [b"", b" ", b"a"]
    parts, index, first = token_store._parts(texts, token_store.WORD_KINDS)
    own = [parts[i] for i in index.to_pylist()]
    assert [own[a:b] for a, b in zip(first[:-1], first[1:], strict=True)] == [x.split() for x in texts]
    parts, index, first = token_store._parts([], token_store.RUN_KINDS)
    assert (parts, index.to_pylist(), first.tolist()) == ([], [], [0])
