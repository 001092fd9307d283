"""The chunk encoder gives the ids that the tokenizer gives for whole texts."""

import random
import sys

import pyarrow as pa
import pytest

from querywright.llm.tokens import ChunkEncoder, public_path

PARTS = ["a", "B", "é", " ", "  ", "\n", "\t", " \n", "\x0b", "\x0c", "\x01", "1", "22", ",", "...", "'s", "<|endoftext|>", "\x1c", "\xa0", "̈", "漢", "🙂", "\x00", "\r"]


@pytest.mark.parametrize(("name", "drops_space"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
@pytest.mark.parametrize("most", [1_000_000, 5])
def test_ids_of_whole_texts(name, drops_space, most):
    dice = random.Random(5)
    texts = ["", None, " ", *("".join(dice.choice(PARTS) for _ in range(dice.randint(0, 14))) for _ in range(3000))]
    encoder = ChunkEncoder(public_path(name), drops_space, most)
    got = [ids.tolist() for i in range(0, len(texts), 500) for ids in encoder.encode(texts[i : i + 500])]
    assert got == [e.ids for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


LATIN = ["'s", "'re", "'ll", "'", "''", "r", "e", "S", "ll", "é", "Ñ", "¿", "İ", "Ɓ", "Ⱥ", "ǅ", "ß", "²", "½", "7", "42", ".", "-", "]", "^", "\\", "\xad", "́", "<|endoftext|>", "</w>", " ", "\n", "\x0b", "\x85"]


@pytest.mark.parametrize("most", [1_000_000, 5])
def test_ids_of_latin_words(most):
    dice = random.Random(6)
    texts = ["'s", "", "it's we'll I'D they're 'start ''s", *("".join(dice.choice(LATIN) for _ in range(dice.randint(0, 16))) for _ in range(4000)), *map(chr, range(1, 0x260))]
    encoder = ChunkEncoder(public_path("word_bpe_49k.json"), True, most)
    got = [ids.tolist() for i in range(0, len(texts), 700) for ids in encoder.encode(texts[i : i + 700])]
    assert got == [e.ids for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert got[:50] == [ids.tolist() for ids in encoder.encode(pa.array(texts[:50], pa.large_string()))]


def test_words_cost_no_python_object_each():
    """New words are cut, told apart and looked up in arrays: a call a batch, whatever the number of words."""
    encoder = ChunkEncoder(public_path("word_bpe_49k.json"), True)
    letters = "abcdefghijklmnopqrst"

    def calls(n):
        words = [letters[k % 20] + letters[k // 20 % 20] + letters[k // 400 % 20] + letters[k // 8000] for k in range(n)]
        seen = 0

        def count(frame, event, arg):
            nonlocal seen
            seen += event in ("call", "c_call")

        texts = pa.array([" ".join(words)])
        sys.setprofile(count)
        try:
            ids = encoder.encode(texts)[0]
        finally:
            sys.setprofile(None)
        assert len(ids) >= n
        return seen

    calls(10)
    assert calls(20_000) < calls(100) + 500
