"""Word shingles in DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_words(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it and wherever the optimiser moves it."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def shingle_at(words: Column, at: Column, size: int) -> Column:
    """A hash of `size` words from place `at` (from 0); the words are read in place, as cutting them out costs more than hashing them."""
    return F.xxhash64(*[F.get(words, at + k) for k in range(size)])


def places(words: Column, size: int) -> Column:
    """0 to the last place where a shingle begins; none for fewer words."""
    return F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>"))


def shingles(words: Column, size: int) -> Column:
    return let(words, lambda w: F.transform(places(w, size), lambda i: shingle_at(w, i, size)))
