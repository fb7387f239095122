"""Encoding of every simple letter, and of long words without forced boundaries, against the installed library."""

import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from leafspark.llm import bpe


@pytest.fixture(scope="module")
def both():
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.Codec(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)


def test_every_simple_letter(both):
    codec, library = both
    for c in map(chr, (*range(0x250), *range(0x2000, 0x2030), 0x20AC)):
        for text in (c, f"ab{c}cd", f"{c}{c} x{c}"):
            assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids, hex(ord(c))


def test_long_words(both):
    codec, library = both
    for text in ("x" * 5000, "lowerlowest" * 400, "étéétaitéte" * 300, "abcab" * 999 + "!" * 700):
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids
    began = time.thread_time()
    assert codec.digests("x" * 200_000)[0] > 1000
    assert time.thread_time() - began < 20


def test_memory_is_bounded_by_bytes(both):
    codec, _ = both
    memo = bpe._Memo(lambda k: k * 2, 10_000)
    for i in range(1000):
        memo[str(i)]
    assert memo.size <= 10_000 and len(memo) < 50
    assert memo["y" * 5000] == "y" * 10_000 and "y" * 5000 not in memo
