from fractions import Fraction

import pytest
from hypothesis import given
from hypothesis import strategies as st

from stratalog.functions.values import Atom, NumericOverflow, NumericType, Pair, canonical_number, holds, key_of, number_text, parse_number, text_of, value_of

numbers = st.one_of(st.integers(-(2**63), 2**63 - 1), st.floats(allow_nan=False, allow_infinity=False)).map(canonical_number)
values = st.recursive(st.one_of(numbers, st.text(st.characters(codec="utf-8")).map(Atom)), lambda inner: st.lists(inner, max_size=3).map(tuple), max_leaves=8)


@given(numbers, numbers)
def test_number_keys_sort_exactly(a, b):
    assert (key_of(a) < key_of(b)) == (Fraction(a) < Fraction(b))


@given(values)
def test_keys_read_back(v):
    assert value_of(key_of(v)) == v


def test_order_of_kinds():
    mixed = [Atom("b"), (Atom("a"),), Atom("a"), 10, 2.5, ()]
    assert sorted(mixed, key=key_of) == [2.5, 10, Atom("a"), Atom("b"), (), (Atom("a"),)]


def test_numbers():
    assert canonical_number(2.0) == 2 and isinstance(canonical_number(2.0), int)
    assert parse_number("-3") == -3 and parse_number("2.5e3") == 2500
    assert number_text(1e-5) == "1e-5" and number_text(0.5) == "0.5"
    for bad, error in ((float("nan"), NumericType), (float("inf"), NumericOverflow), (2**63, NumericOverflow)):
        with pytest.raises(error):
            canonical_number(bad)


def test_text_and_types():
    assert text_of((1, (Atom("A b"),), ())) == "[1, ['A b'], []]" and text_of(Pair(1, 2)) == "cons(1, 2)"
    assert holds((1, 2), ("list", "int")) and not holds((1, Atom("b")), ("list", "int")) and not holds(Pair(1, 2), ("list", "any"))
