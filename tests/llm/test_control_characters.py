"""Control characters have ids and prefix counts as the library gives them."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stratalog.llm.bpe import WordBpe

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def made():
    return WordBpe(VOCABULARY), Tokenizer.from_file(VOCABULARY)


@pytest.mark.parametrize("code", [*range(32), 127])
def test_control_character(made, code):
    bpe, library = made
    c = chr(code)
    for text in (c, f"ab{c}cd", f"{c}7{c}{c}x!", f"AB{c}don't", f"é{c}b"):
        ids = lambda t: library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == ids(text)
        steps, width = bpe.prefix_steps(text)
        assert np.cumsum(np.frombuffer(steps, f"<i{width}")).tolist() == [len(ids(text[: k + 1])) for k in range(len(text))]
