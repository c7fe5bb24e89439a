"""Question forms, scores, labels and filters as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .answers import has_verb
from .columns import clamp, let, normalise, replace, split_words, strip, word_set

LETTERS = ("A", "B", "C", "D")

# Patterns of question words, and the beginnings that tell types of questions apart.
QUESTION_START = r"(?U)\A(what|who|when|where|which|how|why)\b"
QUESTION_STEM = r"(?U)\A(what|who|when|where|which|how|why)\s+(is|are|was|were|does|do|did|has|have)?\s*"
FACTUAL, ANALYTICAL = ("who", "when", "where", "which"), ("why", "how", "explain", "in what")
# Most overlap of stem and answer, least overlap of options that are too similar.
GIVEN_AWAY, TOO_SIMILAR = 0.65, 0.40


def highlight(answer: Column, sentence: Column) -> Column:
    """Model input: the first occurrence of the answer marked, or the answer appended."""
    at = F.instr(F.lower(sentence), F.lower(answer))
    n = F.length(answer)
    marked = F.concat(F.substring(sentence, F.lit(1), at - 1), F.lit("<hl> "), F.substring(sentence, at, n), F.lit(" <hl>"), F.substring(sentence, at + n, F.length(sentence)))
    return F.concat(F.lit("generate question: "), F.when(at > 0, marked).otherwise(F.concat(sentence, F.lit(" <hl> "), answer, F.lit(" <hl>"))))


def clean(raw: Column) -> Column:
    q = replace(strip(raw), r"(?iU)\Aquestion:\s*", "")
    q = replace(strip(q), r"\A[\"']+|[\"']+\z", "")
    q = F.concat(F.upper(F.substring(q, 1, 1)), F.substring(q, F.lit(2), F.length(q)))
    return replace(F.concat(replace(q, r"[.!?]+\z", ""), F.lit("?")), r"\?{2,}", "?")


def starts_with_any(text: Column, prefixes) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(text, F.lit(p))
    return out


def is_valid(question: Column, answer: Column) -> Column:
    q = F.lower(question)
    verbatim = F.contains(q, F.lower(answer)) & (F.size(split_words(answer)) > 3)
    return (F.size(split_words(question)) >= 4) & F.endswith(question, F.lit("?")) & starts_with_any(q, L.QUESTION_WORDS) & ~verbatim


def template(answer: Column, kind: Column) -> Column:
    out = F.concat(F.lit(L.DEFAULT_TEMPLATE[0]), answer, F.lit(L.DEFAULT_TEMPLATE[1]))
    for name, (before, after) in L.TEMPLATES.items():
        out = F.when(kind == name, F.concat(F.lit(before), answer, F.lit(after))).otherwise(out)
    return out


def question(answer: Column, kind: Column, raw: Column | None = None) -> Column:
    """The model's question if it is valid, else the template of the type."""
    if raw is None:
        return template(answer, kind)
    cleaned = clean(F.coalesce(raw, F.lit("")))
    return F.when(is_valid(cleaned, answer), cleaned).otherwise(template(answer, kind))


def score(question: Column, answer: Column, answer_score: Column, kind: Column) -> Column:
    q = F.lower(question)
    expected = F.lit("what")
    for name, word in L.EXPECTED_WORD.items():
        expected = F.when(kind == name, F.lit(word)).otherwise(expected)
    total = 0.50 + F.when(starts_with_any(q, L.QUESTION_WORDS), 0.15).otherwise(0.0) + F.when(F.endswith(question, F.lit("?")), 0.05).otherwise(0.0)
    total = total + F.when(F.size(split_words(question)) < 5, -0.15).otherwise(0.0) + F.when(F.length(question) > 120, -0.10).otherwise(0.0)
    total = total + F.when(F.startswith(q, expected), 0.10).otherwise(0.0) + F.when(~F.contains(q, F.lower(answer)), 0.05).otherwise(0.0)
    return F.bround(clamp(total + answer_score * 0.10), 4)


def _jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)))


def word_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of the normalised words."""
    return let(F.struct(word_set(a).alias("a"), word_set(b).alias("b")), lambda s: _jaccard(s["a"], s["b"]))


def stem(question: Column) -> Column:
    """Without question word, auxiliary verb and question mark."""
    body = replace(F.lower(question), QUESTION_STEM, "")
    return strip(replace(body, r"\?+\z", ""))


def gives_away(question: Column, answer: Column) -> Column:
    return word_overlap(stem(question), F.lower(answer)) > GIVEN_AWAY


def too_similar(options: Column) -> Column:
    """No pair of the four options (an array) differs in most of its words."""

    def of(sets: Column) -> Column:
        out = F.lit(True)
        for i in range(4):
            for j in range(i + 1, 4):
                out = out & (_jaccard(F.get(sets, F.lit(i)), F.get(sets, F.lit(j))) >= TOO_SIMILAR)
        return out

    return let(F.transform(options, word_set), of)


def is_good(question: Column, answer: Column, options: Column) -> Column:
    body = replace(replace(F.lower(question), QUESTION_START, ""), r"\A[ ?]+|[ ?]+\z", "")
    shown = F.contains(body, F.lower(answer)) & (F.size(split_words(answer)) >= 3)
    return (F.size(split_words(question)) >= 5) & F.endswith(strip(question), F.lit("?")) & ~gives_away(question, answer) & ~too_similar(options) & ~shown


def explanation(answer: Column, sentence: Column) -> Column:
    """The first clause of over 15 characters that holds the answer, else the whole sentence."""
    clauses = F.filter(F.split(sentence, r"(?U)(?<=[.!?])\s+|;"), lambda c: F.contains(F.lower(c), F.lower(answer)) & (F.length(strip(c)) > 15))
    clause = F.concat(replace(strip(F.get(clauses, F.lit(0))), r"[.,;]+\z", ""), F.lit("."))
    return F.concat(F.lit("According to the text: "), F.coalesce(clause, strip(sentence)))


def question_type(question: Column) -> Column:
    q = F.lower(question)
    return F.when(starts_with_any(q, FACTUAL), "factual").when(starts_with_any(q, ANALYTICAL), "analytical").otherwise("conceptual")


def reading_grade(text: Column) -> Column:
    """Flesch-Kincaid grade, not below 0; syllables are runs of vowels, one a word at least."""
    ends = F.greatest(F.lit(1), F.regexp_count(text, F.lit("[.!?]+")))

    def of(words: Column) -> Column:
        syllables = F.aggregate(words, F.lit(0), lambda n, w: n + F.greatest(F.lit(1), F.regexp_count(w, F.lit("[aeiouAEIOU]+"))))
        n = F.size(words)
        return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 0.39 * (n / ends) + 11.8 * (syllables / F.greatest(n, F.lit(1))) - 15.59))

    return let(split_words(text), of)


def difficulty(question: Column, kind: Column) -> Column:
    q = F.lower(question)
    hard = starts_with_any(q, L.HARD_PHRASES) | (kind.isin(*L.HARD_TYPES) & (reading_grade(question) > 12))
    easy = kind.isin(*L.EASY_TYPES) & starts_with_any(q, L.EASY_WORDS)
    return F.when(hard, "hard").when(easy, "easy").otherwise("medium")


def question_key(question: Column) -> Column:
    return normalise(question)


def shuffled(question: Column, options: Column) -> Column:
    """Options in an order that depends on the question and each option only."""
    keyed = F.transform(options, lambda o, i: F.struct(F.md5(F.concat(question, F.lit("|"), o).cast("binary")).alias("k"), i.alias("i"), o.alias("o")))
    return F.transform(F.array_sort(keyed), lambda x: x["o"])


def shape(text: Column) -> Column:
    """struct(bucket, proper, digits) of a span."""
    n = F.size(split_words(text))
    return F.struct(F.when(n <= 2, 0).when(n <= 5, 1).otherwise(2).alias("bucket"), F.rlike(text, F.lit(r"(?U)\A\s*\p{Lu}")).alias("proper"), F.rlike(text, F.lit(r"\p{Nd}")).alias("digits"))


def alike(c: Column, a: Column) -> Column:
    return (F.abs(c["bucket"] - a["bucket"]) <= 1) & (c["proper"] == a["proper"]) & (c["digits"] == a["digits"])


def same_shape(candidate: Column, answer: Column) -> Column:
    near = let(F.struct(shape(candidate).alias("c"), shape(answer).alias("a")), lambda s: alike(s["c"], s["a"]))
    return near & ~has_verb(split_words(candidate), L.DISTRACTOR_VERBS)


def domain(sentence: Column) -> Column:
    """The domain with most keys in the text; the first of equal ones, ai_general if there is none."""
    text = F.lower(sentence)
    counts = []
    for k, (name, keys) in enumerate(L.DOMAIN_KEYS.items()):
        n = F.lit(0)
        for key in keys:
            n = n + F.contains(text, F.lit(key)).cast("int")
        counts.append(F.struct(n.alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name")))
    top = F.greatest(*counts)
    return F.when(top["n"] > 0, top["name"]).otherwise("ai_general")
