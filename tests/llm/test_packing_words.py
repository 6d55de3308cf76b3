"""The encoder of packing: the library's ids, and a memo that stays small."""

import tracemalloc

import pyarrow as pa
import pytest
from public_tokenizers import path as vocabulary
from tokenizers import Tokenizer

from newsloom.llm import packing

NAME = vocabulary("word_bpe_49k.json")
ODD = [
    "Word, word WORD's <|endoftext|>x", None, "", "  ", "a\0b \0 \0", "\0", "a\x1cb \x1f", "é é İ ς 中文",
    "x" * 300, " a b\x85c\xa0", "#" * 600,
]


@pytest.mark.parametrize("most", [packing.MEMO_WORDS, 2])
def test_ids_are_those_of_the_library(most, monkeypatch):
    monkeypatch.setattr(packing, "MEMO_WORDS", most)
    tokenizer = Tokenizer.from_file(NAME)
    encode = packing.word_encoder(NAME)
    for texts in (ODD, [t for t in ODD if t and "\0" not in t and "\x1c" not in t], ODD[::-1], []):
        want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert [ids.tolist() for ids in encode(pa.array(texts, pa.string()))] == want


def test_a_remembered_word_takes_few_bytes():
    n = 50_000
    texts = pa.array([" ".join(f"word{i:07}" for i in range(k, k + 1000)) for k in range(0, n, 1000)])
    encode = packing.word_encoder(NAME)
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes()
        encode(texts)
        taken = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    finally:
        tracemalloc.stop()
    # A dictionary from words to ids took more than 150 bytes each.
    assert n * 15 < taken < n * 100
