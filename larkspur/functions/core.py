"""Column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = "。．. ;；,，"
WHITE = " \t\n\x0b\f\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it and wherever the optimiser moves it."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def strip_of(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def strip_ends(c: Column, chars: str = WHITE) -> Column:
    """strip, or strip_of, of long texts: trimming by a set of characters walks the whole text, so only those are trimmed that begin or end with one of them."""

    def trimmed(t: Column) -> Column:
        held = F.lit(False)
        for x in chars:
            held = held | F.startswith(t, F.lit(x)) | F.endswith(t, F.lit(x))
        return F.when(held, F.btrim(t, F.lit(chars))).otherwise(t)

    return let(c, trimmed)


def replaced(c: Column, chars: str, by: str | list[str]) -> Column:
    """F.translate for few characters, which it looks up one by one in the text; a replacement scans bytes. No text of `by` may hold one of the characters."""
    for x, y in zip(chars, by, strict=True):
        c = F.replace(c, F.lit(x), F.lit(y))
    return c


def odd_space(c: Column) -> Column:
    """Whether there is white space other than single spaces."""
    return has_any(c, ["  ", *WHITE[1:]])


def ascii_only(c: Column) -> Column:
    """Whether every character is one byte."""
    return F.octet_length(c) == F.length(c)


def collapse(c: Column) -> Column:
    """Runs of white space become one space; only texts with what isn't one already are changed."""
    single = lambda t: F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, " {2,}", " ")).otherwise(t)
    return strip_ends(let(c, lambda t: F.when(odd_space(t), let(replaced(t, WHITE[1:], " " * 5), single)).otherwise(t)))


def first_nonblank(*cols: Column) -> Column:
    """The first that isn't null or blank, trimmed."""
    return F.coalesce(*[F.when(strip(c) != "", strip(c)) for c in cols])


def has_any(c: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(c, F.lit(p))
    return out


def lookup(pairs: list[tuple[str, str]]) -> Column:
    """A constant map; of equal keys the first counts."""
    first = dict(reversed(pairs))
    return F.map_from_arrays(F.array(*[F.lit(k) for k in first]), F.array(*[F.lit(v) for v in first.values()]))
