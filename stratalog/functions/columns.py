"""Exact numbers and sortable keys as Spark expressions; no Python runs on the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.functions.values import ATOM, CONS, NIL, NUMBER

#: A number of a mixed column: the nearest double, and what an integer has beyond it. It sorts and compares exactly.
REAL = T.StructType([T.StructField("near", T.DoubleType()), T.StructField("rest", T.LongType())])

_LEAST = -(1 << 63)
_EXACT = T.DecimalType(38, 0)


def let(c: Column, *steps: Callable[[Column], Column], inside: bool = False) -> Column:
    """The steps one after another on a value, each result of which stands in the plan once, however often the next uses it.

    Spark can't hand expressions with a lambda inside a lambda to Python functions, so steps don't hold others, and
    ``inside`` a lambda the expressions are written out.
    """
    for f in steps:
        c = f(c) if inside else F.element_at(F.transform(F.array(c), f), 1)
    return c


def _with(s: Column, *kept: str, **made: Column) -> Column:
    return F.struct(*[s[k].alias(k) for k in kept], *[v.alias(k) for k, v in made.items()])


def _exactly(near: Column) -> Column:
    """A whole double up to 2^63 as a decimal; a plain cast goes through its shortest text."""
    return F.when(near < F.lit(float(1 << 63)), near.cast("long").cast(_EXACT)).otherwise(F.lit(1 << 62).cast(_EXACT) * 2)


def _real(near: Column, rest: Column) -> Column:
    return F.struct(near.alias("near"), rest.cast("long").alias("rest"))


def _int_as_real(x: Column) -> Column:
    rest = F.when(x.between(-(1 << 53), 1 << 53), F.lit(0)).otherwise((x.cast(_EXACT) - _exactly(x.cast("double"))).cast("long"))
    return F.when(x.isNotNull(), _real(x.cast("double"), rest))


def _double_as_real(x: Column) -> Column:
    # minus nought is nought
    return F.when(x.isNotNull(), _real(x + F.lit(0.0), F.lit(0)))


def real_of_int(c: Column, inside: bool = False) -> Column:
    return let(c, _int_as_real, inside=inside)


def real_of_double(c: Column, inside: bool = False) -> Column:
    return let(c, _double_as_real, inside=inside)


def _whole(r: Column) -> Column:
    near = r["near"]
    return (near == F.floor(near)) & ((F.abs(near) < F.lit(float(1 << 63))) | (near == F.lit(float(_LEAST))) | (near == F.lit(float(1 << 63))) & (r["rest"] < 0))


def is_whole(c: Column, inside: bool = False) -> Column:
    """Whether a real is an integer of 64 bits."""
    return let(c, _whole, inside=inside)


def int_of_real(c: Column, inside: bool = False) -> Column:
    """The integer of a whole real; null for others."""
    return let(c, lambda r: F.when(_whole(r), (_exactly(r["near"]) + r["rest"].cast(_EXACT)).cast("long")), inside=inside)


def _bytes(c: Column) -> Column:
    return F.unhex(F.lpad(F.hex(c), 16, "0"))


def _byte(b: int) -> Column:
    return F.lit(bytes([b]))


def _power(e: Column) -> Column:
    return F.pow(F.lit(2.0), e.cast("double"))


def _guessed(r: Column) -> Column:
    return _with(r, "near", "rest", size=F.abs(r["near"]), guess=F.floor(F.log2(F.abs(r["near"]))).cast("int"))


def _exponent(s: Column) -> Column:
    low = F.when(s["size"] < _power(s["guess"]), F.lit(1)).otherwise(F.lit(0))
    high = F.when((s["guess"] < 1023) & (s["size"] >= _power(s["guess"] + 1)), F.lit(1)).otherwise(F.lit(0))
    return _with(s, "near", "rest", "size", e=s["guess"] - low + high)


def _bits(s: Column) -> Column:
    tiny = (s["size"] / F.lit(2.0**-1074)).cast("long")
    normal = F.shiftleft((s["e"] + 1023).cast("long"), 52) + ((s["size"] / _power(s["e"]) - 1.0) * float(1 << 52)).cast("long")
    return _with(s, "near", "rest", bits=F.when(s["size"] == 0.0, F.lit(0).cast("long")).when(s["size"] < F.lit(2.0**-1022), tiny).otherwise(normal))


def _key(s: Column) -> Column:
    sorting = F.when(s["near"] < 0, F.bitwise_not(s["bits"]).bitwiseAND(F.lit((1 << 63) - 1))).otherwise(s["bits"].bitwiseOR(F.lit(_LEAST)))
    return F.concat(_byte(NUMBER), _bytes(sorting), _bytes(s["rest"].bitwiseXOR(F.lit(_LEAST))))


def key_of_real(c: Column, inside: bool = False) -> Column:
    """The tag, the double's bits as they sort when read without sign, and the rest."""
    return let(c, _guessed, _exponent, _bits, _key, inside=inside)


def keys_of_numbers(c: Column, kind: str) -> Column:
    """The keys of a list's numbers, one pass over the list a step."""
    first = {"int": [_int_as_real], "number": [_double_as_real], "real": []}[kind]
    for step in [*first, _guessed, _exponent, _bits, _key]:
        c = F.transform(c, step)
    return c


def key_of_atom(c: Column) -> Column:
    return F.concat(_byte(ATOM), F.encode(F.replace(c, F.lit("\0"), F.lit("\0\1")), "UTF-8"), F.lit(b"\0\0"))


def key_of_list(keys: Column) -> Column:
    """From the keys of a list's elements."""
    joined = F.aggregate(keys, F.lit(b""), lambda acc, k: F.concat(acc, _byte(CONS), k))
    return F.concat(joined, _byte(NIL))


def tag_is(key: Column, tag: int) -> Column:
    return F.substring(key, 1, 1) == _byte(tag)


def real_of_key(key: Column, inside: bool = False) -> Column:
    """The number of a key; null for keys of other values."""
    long_at = lambda k, at: F.conv(F.hex(F.substring(k, at, 8)), 16, -10).cast("long")

    def read(k: Column) -> Column:
        return F.when(tag_is(k, NUMBER), F.struct(long_at(k, 2).alias("raw"), long_at(k, 10).bitwiseXOR(F.lit(_LEAST)).alias("rest")))

    def bits(s: Column) -> Column:
        raw = s["raw"]
        return _with(s, "raw", "rest", bits=F.when(raw < 0, raw.bitwiseXOR(F.lit(_LEAST))).otherwise(F.bitwise_not(raw).bitwiseAND(F.lit((1 << 63) - 1))))

    def size(s: Column) -> Column:
        e, m = F.shiftright(s["bits"], 52).cast("int"), s["bits"].bitwiseAND(F.lit((1 << 52) - 1)).cast("double")
        return _with(s, "raw", "rest", size=F.when(e == 0, m * F.lit(2.0**-1074)).otherwise((m / float(1 << 52) + 1.0) * _power(e - 1023)))

    def real(s: Column) -> Column:
        return F.when(s["raw"].isNotNull(), _real(F.when(s["raw"] < 0, s["size"]).otherwise(-s["size"]), s["rest"]))

    return let(key, read, bits, size, real, inside=inside)


def atom_text(c: Column) -> Column:
    said = c
    for a, b in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        said = F.replace(said, F.lit(a), F.lit(b))
    return F.when(c.rlike(r"\A[a-z_][A-Za-z0-9_]*\z"), c).otherwise(F.concat(F.lit("'"), said, F.lit("'")))
