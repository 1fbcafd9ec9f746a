"""Word memos stay bounded and change no ids; workers let go of what other operators kept."""

import numpy as np
import public_tokenizers
import pytest

from stratalog.llm import bpe, common

TEXTS = ["", " ", "\n\n a\tb ", "Word word WORD's it's don't 12345 <|endoftext|> x", "naïve café ŝtrange 漢字 😀 " * 20, "x" * 300, "one two three four " * 200]


@pytest.mark.parametrize("size", [1, 7, 1 << 18])
@pytest.mark.parametrize("memo", [1, 400, 1 << 24])
def test_slices_and_small_memos_keep_ids(monkeypatch, size, memo):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.WordBpe(path)
    monkeypatch.setattr(bpe, "SLICE_BYTES", size)
    monkeypatch.setattr(bpe, "MEMO_BYTES", memo)
    together = own.encode_all(TEXTS)
    for text, said in zip(TEXTS * 2, together * 2):
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == said == np.asarray(ids, "<u4").tobytes()
        steps, width = own.prefix_steps(text)
        steps = np.frombuffer(steps, np.int8 if width == 1 else "<i4")
        assert len(steps) == len(text) and steps.sum() == len(ids)
    assert own.prefix_steps_all(TEXTS) == [own.prefix_steps(t) for t in TEXTS]


def test_memo_has_two_generations_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_BYTES", 3 * (2 + bpe.ENTRY_BYTES) - 1)
    made = []
    memo = bpe._Memo(lambda keys: made.extend(keys) or keys)
    assert memo.all([b"a", b"b"]) == [b"a", b"b"] and memo.all([b"a", b"c"]) == [b"a", b"c"] and made == [b"a", b"b", b"c"]
    assert not memo.young and set(memo.old) == {b"a", b"b", b"c"}
    assert memo.all([b"a"]) == [b"a"] and made == [b"a", b"b", b"c"] and set(memo.young) == {b"a"}
    long = b"w" * (bpe.LONG_WORD + 1)
    assert memo.all([long]) == [long] and long not in memo.young


def test_random_texts_equal_the_library():
    """Clitics, special strings, controls, odd spaces, marks that compose, and letters whose lower case is longer."""
    import random

    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, own, rng = Tokenizer.from_file(path), bpe.WordBpe(path), random.Random(3)
    pieces = "don't|'s|'re|'r|'ve|'ll|''s|x's's|'sam|I'M|'RE|<|endoftext|>|日本語|\u3000|\xa0|\x85|\x1c|\x01|é|İ|Ÿ|ß|ſ|²½|12|&&&|\u0301|ﬁ|Σς|🙂|\u200b|ŉ|'| |\n|\t |a|B|cat|ª|º".split("|") + ["<|endoftext|>", "<|end", "a<|b"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))) for _ in range(1500)] + [chr(c) for c in range(0x400)]
    ids = lambda t: library.encode(t, add_special_tokens=False).ids
    for text, got, (steps, width) in zip(texts, own.encode_all(texts), own.prefix_steps_all(texts)):
        assert np.frombuffer(got, "<u4").tolist() == ids(text), text
        assert np.cumsum(np.frombuffer(steps, f"<i{width}")).tolist() == [len(ids(text[: k + 1])) for k in range(len(text))], text


def test_worker_lets_go_of_other_operators():
    common.memory_of("one")["x"] = 1
    assert common.memory_of("one") == {"x": 1}
    assert common.memory_of("two") == {} and common.memory_of("one") == {}
