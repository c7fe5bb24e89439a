"""Cleaning, splitting, predicates: hand-computed values and properties."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quizspark.functions import lexicon as L
from quizspark.functions import text as T
from quizspark.functions.columns import split_words, strip
from quizspark.operators.rank import select_sentences
from quizspark.operators.sentences import sentences


def values(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_sources(spark):
    got = values(spark, ["[[1](http://a.b)] x  y\t z\n\n\n\nw [https://q.r] http://s.t/u?v end ", None], T.from_text(F.col("s")))
    assert got == [("x y z\n\nw end",), ("",)]


def test_encoding(spark):
    got = values(spark, ["‘a’ “b” c—d e f", "é", "plain"], T.fix_encoding(F.col("s")))
    assert got == [("'a' \"b\" c — d e f",), ("é",), ("plain",)]


def test_noise(spark):
    got = values(spark, ["# Head\n[Slide 3: x] a (12) 6×6 ×256 b.... c--d e:f [ref 7]\n\n\n\nend"], T.strip_noise(F.col("s")))
    assert got == [("Head\n a b. c d e: f \n\nend",)]


def test_bullets(spark):
    assert values(spark, ["Head • A • B", "no bullets", "– x", "•"], T.expand_bullets(F.col("s"))) == [(["Head", "A", "B"],), (["no bullets"],), (["x"],), (["•"],)]
    got = values(spark, ["• Point A", "1. First item", "dr. Smith went home", "BoW, which stands for Bag of Words 2."], T.clean_fragment(F.col("s")))
    assert [g[0] for g in got] == ["Point A", "First item", "Smith went home", "BoW, which stands for Bag of Words"]


def test_abbreviations(spark):
    got = values(spark, ["Dr. A. B. Smith vs. me, e.g. here. écol. x"], T.protect_abbreviations(F.col("s")))
    assert got == [("dr<DOT> A<DOT> B<DOT> Smith vs<DOT> me, e.g<DOT> here. écol. x",)]


def test_split(spark):
    got = values(spark, ["One is here. Two (x)! \"Three\"? four. (Five) Mr. Six went. ok\n\nNext paragraph.", "", "   "], T.split_sentences(F.col("s")))
    assert got == [(["One is here.", "Two (x)!", "\"Three\"? four.", "(Five) mr. Six went. ok", "Next paragraph."],), ([],), ([],)]


GOOD = "The quick fox has jumped over the lazy dog today."


@pytest.mark.parametrize(
    ("sentence", "good"),
    [
        (GOOD, True),
        ("Too short to keep.", False),
        ("word " * 71, False),
        ("a1 2 3 4 5 6 7 8 9 10 11 is", False),
        ("is is is is is was was was", False),
        ("The copyright © of the book is held by us all.", False),
        ("The value 𝑥 is what we want to know here.", False),
        ("Deep Learning For Computer Vision And Robots", False),
        ("This is the second point of the list 2.", False),
        ("3. this is a list item that goes on.", False),
        ("13×13 55×55 27×27 is what layers have here now", False),
    ],
)
def test_quality(spark, sentence, good):
    assert values(spark, [sentence], T.is_good_sentence(F.col("s"))) == [(good,)]


def test_dedup_keeps_the_first_of_a_beginning(spark):
    long = "The committee of the region has agreed on the plan for the harbour of " + "the northern town"
    docs = spark.createDataFrame([(1, f"{GOOD} {long} one day. {GOOD} {long} some other day. It is what we said to them there."), (2, None), (3, "")], "doc_id long, text string")
    out = [(r.sent_idx, r.n_sentences, r.sentence) for r in sentences(docs).orderBy("sent_idx").collect()]
    assert out == [(0, 3, GOOD), (1, 3, f"{long} one day."), (2, 3, "It is what we said to them there.")]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab. \n•–A1(\"é", max_size=60), min_size=1, max_size=20))
def test_sentences_are_stripped_and_not_empty(spark, texts):
    for (parts,) in values(spark, texts, T.split_sentences(F.col("s"))):
        assert all(p and p == p.strip() for p in parts)


def test_words_of_blank_text(spark):
    assert values(spark, ["", " \n", "a  b"], split_words(F.col("s"))) == [([],), ([],), (["a", "b"],)]


def test_cheaper_forms_equal_the_plain_ones(spark):
    """White space of every kind, abbreviations in any case, gaps, bullets, capitals and numbers, beside the plain definitions."""
    odd = "\t\n\x0b\f\r \x85\xa0       　"
    texts = [odd, f"{odd}a{odd}b​c{odd}", "Dr. X. met mr. Y vs. e.g. st.al. ETC. and NO. 5 rest. co", "al.e.g.I.E. Sept. xal. ál.", "\t a  b\t\tc d \t", "Éa Öb 𝐀c ǅd xÀ À", "1, 2.5 .3 a1 ١٢. 7×7 x 3x 4×4", "", "A. B. C.D. éA. x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", split_words(F.col("t")).alias("w"), strip(F.col("t")).alias("s"), T.protect_abbreviations(F.col("t")).alias("p"), T.strip_noise(F.col("t")).alias("n"))
    plain, spaces = F.col("t"), r"(?U)\A\s+|\s+\z"
    for a in L.ABBREVIATIONS:
        plain = F.regexp_replace(plain, rf"(?iuU)\b{a.replace('.', chr(92) + '.')}\.", f"{a}<DOT>")
    noise = F.col("t")
    for pattern, by in ((r"(?U)\d+\s*[×x]\s*\d+[\d\s×x]+", " "), (r"[ \t]+", " "), (r"\n{2,}", "\n\n"), (spaces, "")):
        noise = F.regexp_replace(noise, pattern, by)
    want = df.select("*", F.filter(F.split("t", r"(?U)\s+"), lambda w: w != "").alias("w2"), F.regexp_replace("t", spaces, "").alias("s2"), F.regexp_replace(plain, r"(?U)\b([A-Z])\.\s", "$1<DOT> ").alias("p2"), noise.alias("n2"))
    for r in want.collect():
        assert (r.w, r.s, r.p, r.n) == (r.w2, r.s2, r.p2, r.n2), r


def test_sentences_are_made_once(spark, sf):
    """Short and long documents were selected apart, and each of the two evaluated all sentences."""
    chosen = select_sentences(sentences(spark.read.parquet(f"{sf}/documents.parquet")))
    assert chosen._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
