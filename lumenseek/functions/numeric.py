"""Hashes and dense vectors as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def poly_hash32(text: Column) -> Column:
    """The 31-polynomial over UTF-16 units, wrapped to a signed 32-bit int (as a long)."""
    codes = F.filter(F.split(text, ""), lambda c: c != "")

    def unit(acc: Column, code: Column) -> Column:
        x = (acc * 31 + code).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
        return F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x)

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        high, low = F.shiftright(code, 10) + 0xD7C0, code.bitwiseAND(F.lit(0x3FF)) + 0xDC00
        return F.when(code > 0xFFFF, unit(unit(acc, high), low)).otherwise(unit(acc, code))

    return F.aggregate(codes, F.lit(0).cast("long"), step)


def poly_hash(text: Column) -> Column:
    """poly_hash32 in base 36, with a minus sign if negative."""
    return F.lower(F.conv(poly_hash32(text).cast("string"), 10, -36))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column) -> Column:
    """v over its length; a zero vector stays."""
    scaled = lambda w, n: F.transform(w, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))
    return bound(v, lambda w: bound(norm(w), lambda n: scaled(w, n)))


def cosine(a: Column, b: Column) -> Column:
    """0 for zero vectors; raises where lengths differ."""
    n = norm(a) * norm(b)
    same = F.assert_true(F.size(a) == F.size(b), F.lit("vectors of different dimensions"))
    return F.when(same.isNull(), F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def similarity(distance: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + distance)


def mock_embedding(text: Column, dims: int) -> Column:
    """A unit vector that depends on the text's hash alone, to test with."""
    steps = F.sequence(F.lit(0), F.lit(dims - 1))
    return bound(poly_hash32(text).cast("double"), lambda h: normalized(F.transform(steps, lambda i: (F.sin(h + i) + F.cos((h + i) / F.lit(2.0))) / F.lit(2.0))))
