"""General Column helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"(?U)\S+"
# Fixed value: the characters that (?U)\s matches.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, also where body uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strings(values: Iterable[str]) -> Column:
    return F.array(*map(F.lit, values))


def replace(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, pattern, by)


def strip(text: Column) -> Column:
    """Without white space at either end (trim() removes spaces only)."""
    return F.btrim(text, F.lit(SPACES))


def strip_characters(text: Column, characters: str) -> Column:
    return F.btrim(text, F.lit(characters))


def is_one_of(word: Column, values: Iterable[str]) -> Column:
    """Looked up in a hash set, other than in an array of literals."""
    return word.isin(*values)


def split_words(text: Column) -> Column:
    """Words between white space; none for blank text."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def first_by(items: Column, key: Callable[[Column], Column]) -> Column:
    """Items whose key no earlier item has, in order."""
    return let(items, lambda x: let(F.transform(x, key), lambda keys: F.filter(x, lambda _, i: F.array_position(keys, F.get(keys, i)) == i + 1)))


def normalise(text: Column) -> Column:
    """Lower-case words (letters, digits, underscores) joined by a space."""
    return strip(replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def clamp(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
