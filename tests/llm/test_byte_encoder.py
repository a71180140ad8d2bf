"""op3's encoder against the library of the vocabulary."""

import random

import pytest

from trove.llm import bpe
from trove.llm.common import tokenizer_path, vocabulary_bytes

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return bpe.ByteEncoder(bpe.load(vocabulary_bytes(PATH)))


def _library(texts):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(PATH)
    return [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_many_texts_as_the_library_encodes_them(encoder):
    rng = random.Random(3)
    bits = ["word", "Ünïque", "it's", "we'll", "'re", "don't've", "12,345.67", "--", "...", "(a)", "x=1;", "\n", "\n\n", "\t", "\r\n", " ", "   ", "€9",
            "日本", "<|endoftext|>", "<|end", "oftext|>", "’tis", "é", " ", "\0", "\1", "a\x0bb", "ab" * 40]
    texts = ["", " ", "\n", "a", " a", "a ", "a\n", "\na", "a b", "a b\n\n", "\n\na b", "a\n b", "a \nb", "a  b", "\0 a", "a \0", "\1", "a \1 b", "<|endoftext|>", "'s 's"]
    texts += ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    texts += [" ".join(rng.choices(["plain", "words", "it's", "été", "x\ny", "12"], k=rng.randint(1, 60))) for _ in range(500)]
    want = _library(texts)
    assert [x.tolist() for x in encoder.encode_all(texts)] == want
    assert [encoder.encode(t).tolist() for t in texts] == want
    assert encoder.encode_all([]) == [] and [x.tolist() for x in encoder.encode_all([""])] == [[]]


def test_distinct_words_are_merged_once_a_call(encoder, monkeypatch):
    calls = []
    merge = encoder.merge
    monkeypatch.setattr(encoder, "merge", lambda text: calls.append(text) or merge(text))
    texts = [f"same words again and again, new{i} too" for i in range(50)]
    got = [x.tolist() for x in encoder.encode_all(texts)]
    assert len(calls) == 1 and calls[0].count("again,") == 1 and got == _library(texts)


def test_a_long_run_of_white_space(encoder):
    texts = ["a b", "x " + "\n" * 1_000_000 + "a b", "\n\t" * 300_000 + "a", " " * 500_000 + "b", "c " + "y" * 20_000]
    want = _library(texts)
    assert [x.tolist() for x in encoder.encode_all(texts)] == want and encoder.encode(texts[2]).tolist() == want[2]
    words = ["so " + "\n\t" * 300_000 + "a", "so on"]                  # spaced plainly, with a run inside a word
    assert [x.tolist() for x in encoder.encode_all(words)] == _library(words)
