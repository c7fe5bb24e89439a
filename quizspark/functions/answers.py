"""Answer candidates of a sentence as Column functions: array<struct<answer, type, source, score>> in insertion order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .columns import clamp, first_by, is_one_of, let, replace, split_words, strip, strip_characters

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Patterns of answers.
SUCH_AS = r"(?iU)such as\s+(.+?)(?:\.|,\s+(?:and|but|or)\s+\w+|\s+–|\s+—|\s*$)"
INCLUDING = r"(?iU)including\s+(.+?)(?:\.|,\s+(?:and|but)\s+[a-z]|\s*$)"
PARENTHESES = r"\(([^)]{3,60})\)"
KNOWN_AS = r"(?iU)(?:known|referred to|called)\s+as\s+([^,.;]+)"
DASH = r"(?U)[–—-]\s+([^–—.,;]{5,80})"
DECADE = r"(?iU)\bthe\s+\d{4}s\b"
DATE = rf"(?iU)\b(?:{'|'.join(L.MONTHS)})(?:\s+\d{{1,2}})?(?:,\s*\d{{4}})?\b"
YEAR = r"(?U)\b(?:1[5-9]\d{2}|20[0-3]\d)\b"
PERCENT = r"(?U)\b\d+(?:\.\d+)?\s*%"

CANDIDATES = "array<struct<span:string,type:string,source:string,confidence:double>>"


def _spans(found: Column, kind: str, source: str) -> Column:
    return F.transform(found, lambda x: F.struct(x.alias("span"), F.lit(kind).alias("type"), F.lit(source).alias("source"), F.lit(0.0).alias("confidence"))).cast(CANDIDATES)


def _first(s: Column, pattern: str) -> Column:
    """The first match's group as an array of one, or of none."""
    return F.slice(F.regexp_extract_all(s, F.lit(pattern), F.lit(1)), 1, 1)


def split_list(items: Column) -> Column:
    items = replace(replace(items, r"(?iU),?\s+and\s+", ", "), r"(?iU),?\s+or\s+", ", ")
    return F.filter(F.transform(F.split(items, ","), lambda p: replace(strip(p), r"[.,;]+\z", "")), lambda p: F.length(p) >= 2)


def such_as(s: Column) -> Column:
    return _spans(F.flatten(F.transform(_first(s, SUCH_AS), split_list)), "PROPER_NOUN", "PATTERN")


def including(s: Column) -> Column:
    """At least two items: the first three, and these joined unless too long."""

    def pick(items: Column) -> Column:
        three = F.slice(items, 1, 3)
        joined = F.array_join(three, ", ")
        return F.when(F.size(items) < 2, F.array().cast("array<string>")).otherwise(F.concat(three, F.when(F.length(joined) <= 80, F.array(joined)).otherwise(F.array().cast("array<string>"))))

    return _spans(F.flatten(F.transform(_first(s, INCLUDING), lambda m: let(split_list(m), pick))), "CONCEPT", "PATTERN")


def parentheses(s: Column) -> Column:
    return _spans(F.transform(F.regexp_extract_all(s, F.lit(PARENTHESES), F.lit(1)), strip), "PROPER_NOUN", "PATTERN")


def known_as(s: Column) -> Column:
    return _spans(F.transform(_first(s, KNOWN_AS), strip), "CONCEPT", "PATTERN")


def dash_definition(s: Column) -> Column:
    return _spans(F.transform(_first(s, DASH), strip), "CONCEPT", "PATTERN")


def bare(word: Column) -> Column:
    return strip_characters(word, PUNCTUATION)


def subject(s: Column) -> Column:
    """Words before the first verb (all, if there is none), without leading function words."""

    def before_verb(words: Column) -> Column:
        at = F.array_position(F.transform(words, lambda w: is_one_of(F.lower(bare(w)), L.ANSWER_VERBS)), F.lit(True))
        return F.filter(F.transform(F.when(at > 0, F.slice(words, 1, F.greatest(at - 1, F.lit(0)).cast("int"))).otherwise(words), bare), lambda w: w != "")

    phrase = let(let(split_words(s), before_verb), lambda words: F.array_join(_from_first_good(words), " "))
    return _spans(F.filter(F.array(phrase), lambda p: F.length(p) >= 3), "CONCEPT", "SUBJECT")


def _from_first_good(words: Column) -> Column:
    good = F.array_position(F.transform(words, lambda w: ~is_one_of(F.lower(w), L.BAD_LEADS)), F.lit(True))
    return F.when(good > 0, F.slice(words, good.cast("int"), F.size(words))).otherwise(F.array().cast("array<string>"))


def rules(s: Column) -> Column:
    """Decades, month dates, years that no earlier span holds, percentages."""
    whole = lambda p: F.regexp_extract_all(s, F.lit(p), F.lit(0))
    dated = F.array_distinct(F.concat(whole(DECADE), whole(DATE)))
    years = F.array_distinct(whole(YEAR))
    fresh = let(dated, lambda d: F.concat(d, F.filter(years, lambda y: ~F.exists(d, lambda x: F.contains(x, y)))))
    return F.concat(_spans(fresh, "DATE", "RULE"), _spans(whole(PERCENT), "NUMBER", "RULE"))


def trim(span: Column) -> Column:
    """Without leading function words, trailing ones and outer punctuation."""

    def cut(words: Column) -> Column:
        tail = F.array_position(F.transform(F.reverse(words), lambda w: ~is_one_of(F.lower(w), L.BAD_TAILS)), F.lit(True))
        return F.when(tail > 0, F.slice(words, 1, (F.size(words) - tail + 1).cast("int"))).otherwise(F.array().cast("array<string>"))

    kept = let(let(split_words(span), _from_first_good), cut)
    return strip_characters(F.array_join(kept, " "), ".,;:!?()-– ")


def has_verb(words: Column, verbs: list[str]) -> Column:
    return F.exists(words, lambda w: is_one_of(F.lower(bare(w)), verbs))


def is_valid(span: Column) -> Column:
    def judge(words: Column) -> Column:
        stop = lambda w: is_one_of(F.lower(w), L.ANSWER_STOP_WORDS)
        content = F.exists(words, lambda w: F.rlike(w, F.lit(r"\A\p{L}{3,}\z")) & ~stop(w))
        junk = (F.size(words) == 1) & is_one_of(F.lower(F.get(words, F.lit(0))), L.JUNK_ANSWERS)
        lead = is_one_of(F.lower(F.get(words, F.lit(0))), L.BAD_LEADS)
        return (F.length(span) >= 2) & ~has_verb(words, L.ANSWER_VERBS) & ~F.coalesce(lead, F.lit(True)) & content & ~F.coalesce(junk, F.lit(False))

    return let(split_words(span), judge)


def score(span: Column, kind: Column, confidence: Column, sentence: Column) -> Column:
    """The order of additions is part of the definition: the cut at 0.25 is reached from above by some sums only."""
    sure = F.least(F.lit(1.0), confidence)
    base = F.lit(0.35) + F.when(kind.isin("PERSON", "ORGANIZATION", "LOCATION"), 0.40 * sure).when(kind.isin("DATE", "NUMBER"), 0.30).when(kind == "PROPER_NOUN", 0.25 * sure).when(kind == "CONCEPT", 0.20).otherwise(0.0)
    n = F.size(split_words(span))
    base = base + F.when(n.between(2, 6), 0.20).when((n == 1) & (F.length(span) >= 5), 0.08).when(n > 8, -0.10).otherwise(0.0)
    capital = F.rlike(span, F.lit(r"\A\p{Lu}")) & ~F.startswith(sentence, span)
    return clamp(base + F.when(capital, 0.05).otherwise(0.0))


def accepted(s: Column, spans: Column) -> Column:
    """Trimmed, valid, first of equal spans, scored 0.25 or more: array<struct<answer, type, source, score>>."""
    trimmed = F.filter(F.transform(spans, lambda c: c.withField("span", trim(c["span"]))), lambda c: is_valid(c["span"]))
    graded = F.transform(first_by(trimmed, lambda c: c["span"]), lambda c: F.struct(c["span"].alias("answer"), c["type"].alias("type"), c["source"].alias("source"), score(c["span"], c["type"], c["confidence"], s).alias("score")))
    return F.transform(F.filter(graded, lambda c: c["score"] >= 0.25), lambda c: c.withField("score", F.bround(c["score"], 4)))


def without_overlaps(answers: Column) -> Column:
    """Answers that no longer answer contains, whatever the case."""
    return let(answers, lambda a: F.filter(a, lambda x: ~F.exists(a, lambda y: (F.lower(x["answer"]) != F.lower(y["answer"])) & F.contains(F.lower(y["answer"]), F.lower(x["answer"])) & (F.length(y["answer"]) >= F.length(x["answer"])))))


def best(answers: Column, k: int) -> Column:
    """The k best by score, then length, then insertion."""
    keyed = F.transform(answers, lambda a, i: F.struct((-a["score"]).alias("s"), (-F.length(a["answer"])).alias("l"), i.alias("i"), a.alias("a")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda x: x["a"])


def extract(s: Column, entities: Column | None = None, k: int = 3) -> Column:
    """Patterns, named entities (if a model gave any), subject, rules; then overlaps out, the k best."""
    named = entities if entities is not None else F.array().cast(CANDIDATES)
    spans = F.concat(such_as(s), including(s), parentheses(s), known_as(s), dash_definition(s), named, subject(s), rules(s))
    return best(without_overlaps(accepted(s, spans)), k)
