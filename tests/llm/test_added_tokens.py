"""Literal added tokens in texts, against the library's tokenizer as it comes from its file."""

import numpy as np

from chirplake.llm import packing, queries


def test_literal_added_tokens():
    from tokenizers import Tokenizer

    rng = np.random.default_rng(11)
    some = ["end <|endoftext|> next", "<|startoftext|>", "a<|endoftext|>b<|endoftext|><|startoftext|>", "<|ENDOFTEXT|> <|endoftext", "plain", ""]
    parts = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "don't", "É", "Σ", " ", "\n", "word.", "<|EndOfText|>"]
    some += ["".join(rng.choice(parts, rng.integers(1, 12))) for _ in range(2000)]
    plain = Tokenizer.from_file(queries.WORD_TOKENIZER).encode_batch(some, add_special_tokens=False)
    got = [np.frombuffer(g, "<u4").tolist() for g in packing.WordTokenizer(queries.WORD_TOKENIZER).ids(some)]
    assert got[0] == [806, 49407, 1131] and got == [e.ids for e in plain]
