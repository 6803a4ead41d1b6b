"""Added tokens that stand in a text are encoded as the library does by default."""

import numpy as np

from veridock.llm import token_store
from veridock.llm.queries import tokenizer_path


def test_added_tokens_equal_the_library():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tok, enc = Tokenizer.from_file(path), token_store.encoder(path)
    for text in ("one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|>b and  c", "<|endoftext|><|endoftext|> x", "plain <|endof text|>"):
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text
    assert np.frombuffer(enc.encode("<|endoftext|>"), "<u4").tolist() == [50256]
