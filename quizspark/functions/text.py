"""Cleaning, sentence splitting and sentence predicates as Column functions; everything is narrow, a document stays one row."""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import lexicon as L
from .columns import SPACES, first_by, let, replace, split_words, strings, strip, strip_characters


# Links in the order they go, each with what a match holds.
LINKS = ((r"\[\[?\p{Nd}+\]?\([^)]*\)\]?", "["), (r"\[https?://[^\]]+\]", "["), (r"(?U)https?://\S+", "://"))
# Fixed value: [ \t]+ but for a single space, which stays what it is.
GAPS = r"\t[ \t]*| [ \t]+"

# Noise, what replaces it and what a match holds, in this order.
NOISE = (
    (r"\[Slide \p{Nd}+[^\]]*\]", " ", ("[Slide ",)),
    (r"(?U)https?://\S+", "", ("://",)),
    (r"(?mU)^#+\s+", " ", ("#",)),
    (r"\[[^\]]{0,60}\]", "", ("[",)),
    (r"\(\p{Nd}+\)", "", ("(",)),
    (r"(?U)\d+\s*[×x]\s*\d+[\d\s×x]+", " ", (r"(?U)[×x]\s*\d",)),
    (r"\.{3,}", ".", ("...",)),
    (r"-{2,}", " ", ("--",)),
    (r"(?U):(?!\s)", ": ", (":",)),
    (GAPS, " ", ("\t", "  ")),
    (r"\n{2,}", "\n\n", ("\n\n\n",)),
)

# Fixed value: a range that holds the bullets; a test for many characters is slow.
BULLET_RANGE = "[·–-☆]"

# Fixed value: white space between a sentence's last mark and the next one's beginning.
SENTENCE_END = r"(?U)\s(?<=[.!?]\s)\s*(?=[A-Z\"(\[])"

# Fixed value: what a sentence with symbols or an equation holds, or any character beyond Latin.
SYMBOLIC = r"[+<=>|~¦©¬®°±×÷ĉŷ]|[^\x00-\x{24F}]"

# Limits of the sentence predicates.
SYMBOL_SHARE, EQUATION_SHARE, HEADING_WORDS, HEADING_CAPITALS, LAYER_SHARE, NUMBER_SHARE, PREFIX = 0.015, 0.3, 15, 0.45, 0.35, 0.4, 70


def where_held(text: Column, signs: tuple[str, ...], pattern: str, by: str) -> Column:
    """The replacement in texts that hold one of the signs. Each match holds one, and to look for it is cheaper. A pattern is a sign, too."""
    held = lambda t, s: F.rlike(t, F.lit(s)) if s.startswith("(?") else F.contains(t, F.lit(s))
    return let(text, lambda t: F.when(reduce(or_, (held(t, s) for s in signs)), replace(t, pattern, by)).otherwise(t))


def remove_links(text: Column) -> Column:
    for pattern, sign in LINKS:
        text = where_held(text, (sign,), pattern, "")
    return text


def normalise_space(text: Column) -> Column:
    return strip(where_held(where_held(text, ("\t", "  "), GAPS, " "), ("\n\n\n",), r"\n{3,}", "\n\n"))


def from_text(text: Column) -> Column:
    """Plain text as a source: links out, white space normalised."""
    return normalise_space(remove_links(F.coalesce(text, F.lit(""))))


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


# Marks, and characters that normalisation replaces although they stand alone.
_MAY_COMPOSE = r"[\p{M}\u0340\u0341\u0374\u037E\u0387\u0958-\u095F\u1100-\u11FF\u1F71-\u1FFD\u2000\u2001\u2126\u212A\u212B\u2329\u232A\uF900-\uFAFF\uFB1D-\uFB4F\x{1D15E}-\x{1D1C0}\x{2F800}-\x{2FA1F}]"


def fix_encoding(text: Column, compose: bool = True) -> Column:
    """Composed characters, straight quotes, spaced dashes. Only texts that may compose leave the JVM."""
    if compose:
        text = F.coalesce(_nfc(F.when(F.rlike(text, F.lit(_MAY_COMPOSE)), text)), text)
    text = F.translate(text, "\u2018\u2019\u201c\u201d\u00a0", "''\"\" ")
    return F.replace(text, F.lit("\u2014"), F.lit(" \u2014 "))


def strip_noise(text: Column) -> Column:
    for pattern, by, signs in NOISE:
        text = where_held(text, signs, pattern, by)
    return strip(text)


def clean_fragment(text: Column) -> Column:
    """Without leading bullets and list labels and without a trailing list number."""
    text = F.ltrim(strip(text), F.lit(L.BULLETS + " "))
    text = let(text, lambda t: F.when(F.rlike(F.substring(t, 1, 4), F.lit(r"\A[(\[]?[a-zA-Z0-9]{1,2}[.)\]]")), replace(t, r"(?U)\A[(\[]?[a-zA-Z0-9]{1,2}[.)\]]\s+", "")).otherwise(t))
    return let(text, lambda t: strip(F.when(_ends_in_number(t), replace(t, r"(?U)\s+\d+\.\s*\z", "")).otherwise(t)))


def _ends_in_number(text: Column) -> Column:
    """Whether a digit and a period end the text, but for white space."""
    return F.rlike(F.substring(F.rtrim(text, F.lit(SPACES)), -2, 2), F.lit(r"\A\p{Nd}\.\z"))


def expand_bullets(paragraph: Column) -> Column:
    """The points of a paragraph; the whole paragraph if it has no bullet or nothing remains."""
    points = F.filter(F.transform(F.split(paragraph, rf"(?U)(?<=[^•])\s*[{L.SPLITTING_BULLETS}]\s*"), clean_fragment), lambda p: p != "")
    some = let(points, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(paragraph)))
    return F.when(F.rlike(paragraph, F.lit(BULLET_RANGE)) & F.rlike(paragraph, F.lit(f"[{L.BULLETS}]")), some).otherwise(F.array(paragraph))


def protect_abbreviations(text: Column) -> Column:
    """Periods of abbreviations and of single capitals become <DOT>; an abbreviation is lower-cased."""
    escaped = {a: a.replace(".", r"\.") for a in L.ABBREVIATIONS}

    def other_cases(done: Column) -> Column:
        for abbreviation, pattern in escaped.items():
            done = replace(done, rf"(?iuU)\b{pattern}\.", f"{abbreviation}<DOT>")
        return done

    # The period is looked for first, and what is before it only then. No two abbreviations share a period, so their order is of no matter.
    any_of = rf"\.(?<=\b(?:{'|'.join(escaped.values())})\.)"
    lower = where_held(text, (".",), rf"(?U){any_of}", "<DOT>")
    done = let(lower, lambda t: F.when(F.rlike(t, F.lit(rf"(?iuU){any_of}")), other_cases(t)).otherwise(t))
    return replace(done, r"(?U)([A-Z])(?<=\b[A-Z])\.\s", "$1<DOT> ")


def split_sentences(text: Column) -> Column:
    """array<string> in document order: paragraphs, then bullets, then sentence ends."""
    paragraphs = F.filter(F.transform(F.split(text, "\n\n+"), strip), lambda p: p != "")
    chunks = F.flatten(F.transform(paragraphs, expand_bullets))
    parts = F.flatten(F.transform(chunks, lambda c: F.split(protect_abbreviations(c), SENTENCE_END)))
    return F.filter(F.transform(parts, lambda p: clean_fragment(F.replace(p, F.lit("<DOT>"), F.lit(".")))), lambda p: p != "")


def letter_share(s: Column) -> Column:
    return F.length(replace(s, r"\P{L}+", "")) / F.greatest(F.length(s), F.lit(1))


def is_math_heavy(s: Column, words: Column) -> Column:
    symbols = F.regexp_count(s, F.lit(r"[\p{Sm}\p{So}\p{Mn}\x{1D400}-\x{1D7FF}\x{0D80}-\x{0DFF}]")) / F.greatest(F.length(s), F.lit(1))
    listed = F.rlike(s, F.lit(rf"[\x{{1D400}}-\x{{1D7FF}}\x{{0D80}}-\x{{0DFF}}{L.MATH_SYMBOLS}]"))
    equations = F.regexp_count(s, F.lit("[=+×÷]")) / F.greatest(F.size(words), F.lit(1)) > EQUATION_SHARE
    return F.rlike(s, F.lit(SYMBOLIC)) & ((symbols > SYMBOL_SHARE) | listed | (F.rlike(s, F.lit(r"(?U)\d+\s*[=+\-×÷/]\s*\d+")) & equations))


def is_heading(s: Column, words: Column) -> Column:
    n = F.size(words)
    bare = F.transform(words, lambda w: strip_characters(F.lower(w), '.,;:!?"'))
    verbless = ~F.arrays_overlap(bare, strings(L.HEADING_VERBS))
    capitals = F.regexp_count(s, F.lit(r"(?U)\p{Lu}(?<!\S.)")) / F.greatest(n, F.lit(1))
    short = (n <= HEADING_WORDS) & (capitals > HEADING_CAPITALS)
    long = (n > 8) & ~F.rlike(s, F.lit(r"[.!?]\z")) & (capitals > 0.55) & (F.length(s) - F.length(F.replace(s, F.lit(","), F.lit(""))) >= 2)
    quoted = s.contains('"') & (n <= 12)
    return (short | long | quoted | s.endswith("]")) & verbless


def is_numbered(s: Column) -> Column:
    return F.rlike(s, F.lit(r"(?U)\s+\d+\.\s*\z")) | F.rlike(s, F.lit(r"(?U)\A\d+\.\s+[a-z]"))


def is_architecture(words: Column) -> Column:
    named = F.filter(words, lambda w: F.rlike(w, F.lit(r"(?U)\A[\d×x\-]+\z")) | w.isin(*L.LAYER_NAMES))
    return F.size(named) / F.greatest(F.size(words), F.lit(1)) > LAYER_SHARE


def is_numeric(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: F.rlike(replace(w, "[.,]", ""), F.lit(r"\A\p{Nd}+\z")))) > F.size(words) * NUMBER_SHARE


def is_good_sentence(s: Column) -> Column:
    def judge(words: Column) -> Column:
        sized = F.size(words).between(L.MIN_WORDS, L.MAX_WORDS)
        distinct = F.size(F.array_distinct(F.transform(words, F.lower))) >= L.MIN_DISTINCT_WORDS
        bad = is_math_heavy(s, words) | is_heading(s, words) | is_numbered(s) | is_architecture(words) | is_numeric(words)
        return sized & (letter_share(s) >= L.MIN_LETTER_SHARE) & distinct & ~bad

    return let(split_words(s), judge)


def prefix_key(s: Column) -> Column:
    return F.substring(strip(F.lower(s)), 1, PREFIX)


def good_sentences(text: Column) -> Column:
    """array<string>: the good sentences of a cleaned text, the first of each 70-character beginning."""
    return first_by(F.filter(split_sentences(text), is_good_sentence), prefix_key)


def indexed(sentences: Column) -> Column:
    """array<struct<n_sentences, sent_idx, sentence>>."""
    return let(sentences, lambda all_: F.transform(all_, lambda s, i: F.struct(F.size(all_).alias("n_sentences"), i.alias("sent_idx"), s.alias("sentence"))))
