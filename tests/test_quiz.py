"""Ranking, answers, questions, distractors, items, evaluation, exports."""

from __future__ import annotations

import csv
import hashlib
import json
import math
import re
from difflib import SequenceMatcher

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quizspark.functions import answers as A
from quizspark.functions import lexicon as L
from quizspark.functions import questions as Q
from quizspark.operators import distract, export, metrics, rank
from quizspark.operators.answers import extract_answers, generate_questions, question_rows
from quizspark.operators.sentences import sentences
from quizspark.plans.facts import facts
from quizspark.plans.pipeline import QuizPipeline
from quizspark.plans.queries import QUERIES
from quizspark.sources import providers


def values(spark, rows, *columns):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, s string" if not isinstance(rows[0], tuple) else "i int, s string, t string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def spans(spark, sentence, extractor):
    return [s["span"] for s in values(spark, [sentence], extractor(F.col("s")))[0][0]]


def test_surface_scores(spark):
    sized = ["w " * n for n in (4, 8, 40, 41, 100)]
    assert [round(v[0], 6) for v in values(spark, sized, rank.length_score(F.col("s")))] == [0.75, 1.0, 1.0, 0.98, 0.4]
    assert [round(v[0], 6) for v in values(spark, ["the quick brown fox jumps", "single"], rank.entity_bonus(F.col("s")))] == [0.05, 0.0]


def test_centrality_equals_pairwise_cosines(spark, sf):
    sents = sentences(spark.read.parquet(f"{sf}/documents.parquet")).where("n_sentences between 2 and 40").cache()
    vectors: dict = {}
    for r in rank.tfidf(sents).collect():
        vectors.setdefault((r.doc_id, r.sent_idx), {})[r.term] = r.w
    got = {(r.doc_id, r.sent_idx): r.centrality for r in rank.centrality(sents).collect()}
    by: dict = {}
    for r in sents.collect():
        by.setdefault(r.doc_id, []).append(r.sent_idx)
    for doc, idx in list(by.items())[:30]:
        for i in idx:
            a = vectors.get((doc, i), {})
            mean = sum(sum(w * vectors.get((doc, j), {}).get(t, 0.0) for t, w in a.items()) for j in idx if j != i) / (len(idx) - 1)
            assert math.isclose(got[doc, i], mean, abs_tol=1e-9)


def test_rank_edges(spark):
    docs = spark.createDataFrame([(1, 0, 1, "Only one sentence is here.")] + [(2, i, 3, "is the of") for i in range(3)], "doc_id long, sent_idx int, n_sentences int, sentence string")
    out = {(r.doc_id, r.sent_idx): r.score for r in rank.rank_sentences(docs, 2).collect()}
    assert out == {(1, 0): 1.0, (2, 0): 0.5, (2, 1): 0.5}


def test_answer_generators(spark):
    assert spans(spark, "tools such as hammers, saws, and drills.", A.such_as) == ["hammers", "saws"]
    assert spans(spark, "such as OpenAI, DeepMind and Meta", A.such_as) == ["OpenAI", "DeepMind", "Meta"]
    assert spans(spark, "fields including one thing, two things.", A.including) == ["one thing", "two things", "one thing, two things"]
    assert spans(spark, "it is known as artificial general intelligence, or AGI.", A.known_as) == ["artificial general intelligence"]
    assert spans(spark, "x (AGI) y (ab) z (a long one)", A.parentheses) == ["AGI", "a long one"]
    assert spans(spark, "in March 2019 we", A.rules) == ["March", "2019"]
    assert spans(spark, "on January 5, 2020 it", A.rules) == ["January 5, 2020"]
    assert spans(spark, "it may be 12.5 % in the 1990s", A.rules) == ["the 1990s", "may", "12.5 %"]
    assert spans(spark, "The artificial intelligence is here", A.subject) == ["artificial intelligence"]
    assert spans(spark, "no listed word at all", A.subject) == ["no listed word at all"]


def test_validity_and_score(spark):
    assert [v[0] for v in values(spark, ["1956", "1990s", "42%", "method", "the end", "deep learning", "what is it"], A.is_valid(F.col("s")))] == [False, False, False, False, False, True, False]
    scored = values(spark, [("a b c d e f g h i", "x"), ("deep learning", "deep learning is"), ("Deep", "So Deep")], A.score(F.col("s"), F.lit("PROPER_NOUN"), F.lit(0.0), F.col("t")))
    assert scored[0][0] < 0.25 and scored[1][0] == pytest.approx(0.55) and scored[2][0] == pytest.approx(0.40)


def test_at_most_k_answers_and_no_overlaps(spark, sf):
    out = extract_answers(facts(spark, sf), 3).collect()
    by: dict = {}
    for r in out:
        by.setdefault((r.doc_id, r.sent_idx), []).append(r)
    assert by and all(len(v) <= 3 for v in by.values())
    for v in by.values():
        low = [r.answer.lower() for r in v]
        assert not any(a != b and a in b for a in low for b in low) and all(0.25 <= r.score <= 1 for r in v)


def test_questions(spark):
    assert values(spark, ["", "question: \"who is it\"", "what??  "], Q.clean(F.col("s"))) == [("?",), ("Who is it?",), ("What?",)]
    assert values(spark, [("Paris", "We saw paris today"), ("Rome", "x")], Q.highlight(F.col("s"), F.col("t"))) == [("generate question: We saw <hl> paris <hl> today",), ("generate question: x <hl> Rome <hl>",)]
    assert round(values(spark, ["What is the process of photosynthesis?"], Q.reading_grade(F.col("s")))[0][0], 4) == 6.4167


@pytest.mark.parametrize(
    ("question", "answer", "good"),
    [
        ("What is alpha beta gamma?", "alpha beta gamma", False),
        ("Where is New York located?", "New York", False),
        ("When did this occur — specifically in January 5?", "January 5", True),
        ("When did this occur — specifically in January 5, 2020?", "January 5, 2020", False),
    ],
)
def test_item_filter(spark, question, answer, good):
    options = F.array(F.lit(answer), F.lit("one thing"), F.lit("two others"), F.lit("three more"))
    assert spark.range(1).select(Q.is_good(F.lit(question), F.lit(answer), options)).first()[0] == good


def ratio(a, b):
    return SequenceMatcher(None, a.lower(), b.lower()).ratio()


def alike(a, b):
    x, y = set(a.lower().split()), set(b.lower().split())
    return len(x & y) / len(x | y) if x | y else 1.0


def plainly_fresh(text, answer, others):
    return text.lower().strip() != answer.lower().strip() and ratio(text, answer) <= 0.75 and all(alike(text, o) <= 0.70 and ratio(text, o) <= 0.80 for o in others)


def plain_swaps(answer):
    words = answer.split()
    return [" ".join([*words[:i], o, *words[i + 1 :]]) for i, w in enumerate(words) for o in L.WORD_SWAPS.get(w.lower(), ())]


def plain_variants(answer):
    if re.fullmatch("[0-9]{4}", answer.strip()):
        return [str(int(answer) + d) for d in (5, 10, -5, 15)]
    if re.fullmatch(r"[0-9]+(\.[0-9]+)?\s*%", answer.strip()):
        return [f"{int(max(0, float(answer.strip().rstrip('%')) + d))}%" for d in (10, -10, 25, -25)]
    fresh = []
    for s in plain_swaps(answer):
        if len(fresh) < 4 and plainly_fresh(s, answer, fresh):
            fresh.append(s)
    last = answer.split()[-1].lower() if answer.split() else "approach"
    return fresh if len(fresh) == 4 else [f"{q} {last}" for q in ("traditional", "alternative", "classical")]


def plain_pick(answer, offered):
    taken = []
    for text in [*offered, *plain_variants(answer)]:
        if len(taken) < 3 and plainly_fresh(text, answer, taken):
            taken.append(text)
    return taken


def test_sequence_ratio_is_not_symmetric():
    over = lambda a, b, limit: distract.Resemblance(b).above(a, limit)
    assert over("diet", "tide", 0.4) and not over("tide", "diet", 0.4) and not over("1956", "1961", 0.75)


@given(st.text(alphabet="abc 1%", min_size=1, max_size=12), st.lists(st.text(alphabet="abcde ", min_size=1, max_size=8), max_size=12))
def test_picks_match_a_plain_choice(answer, offered):
    assert distract.pick(answer, offered, plain_variants(answer)) == plain_pick(answer, offered)


ANSWERS = ["1956", " 0003 ", "42%", "42.5 %", "7%", "steel", "Deep Learning", "neural network theory", "artificial intelligence", "", "  ", "machine machine", "Natural Deep network", "1956 AD"]


def test_variants(spark):
    df = spark.createDataFrame([(a,) for a in ANSWERS], "answer string")
    for r in df.select("answer", distract.variants(F.col("answer")).alias("v"), distract.distractors(F.col("answer"), F.array().cast("array<string>")).alias("d")).collect():
        assert list(distract.swapped(r.answer)) == plain_swaps(r.answer)
        if not plain_swaps(r.answer):
            assert r.v == plain_variants(r.answer), r
        assert r.d == plain_pick(r.answer, []), r


def test_distractors_of_facts_match_a_plain_choice(spark, sf):
    """The query's answers, pools and banks as Spark gives them (each has its own SQL); shape, order of the layers and choice written out."""
    from quizspark.functions.columns import split_words
    from quizspark.plans.queries import _pool

    questions = distract.type_pool(*_pool(spark, sf))
    verb_free = F.filter("bank", lambda c: ~distract.has_verb(split_words(c), L.DISTRACTOR_VERBS))
    rows = questions.withColumn("bank", distract.bank(F.col("answer"), F.col("type"), F.col("sentence"))).withColumn("free", verb_free)
    rows = rows.select("doc_id", "sent_idx", "ans_rank", "answer", "pool", "bank", "free").collect()

    def shape(t):
        n = len(t.split())
        return 0 if n <= 2 else 1 if n <= 5 else 2, t.lstrip()[:1].isupper(), any(c.isdigit() for c in t)

    got = {(r.doc_id, r.sent_idx, r.ans_rank): r.distractors for r in QUERIES["distractor_greedy"](spark, sf).collect()}
    assert len(got) == len(rows) > 1_000
    verbs = {w.lower() for w in L.DISTRACTOR_VERBS}
    for r in rows:
        a = shape(r.answer)
        same = [c for c in [*r.pool, *r.bank] if abs(shape(c)[0] - a[0]) <= 1 and shape(c)[1:] == a[1:] and not any(w.strip(".,;:!?").lower() in verbs for w in c.split())]
        assert got[r.doc_id, r.sent_idx, r.ans_rank] == "|".join(plain_pick(r.answer, [*same, *r.free])), r


def test_items_are_padded_to_four_options(spark):
    from quizspark.operators import assemble

    rows = [(1, 0, k, "s", "steel", "CONCEPT", 0.5, f"What is it {k}?", 0.5, ["iron", "gold", "tin"][:k]) for k in range(4)]
    q = spark.createDataFrame(rows, "doc_id long, sent_idx int, ans_rank int, sentence string, answer string, type string, score double, question string, question_score double, distractors array<string>")
    for r in assemble.build(q).collect():
        want = ["steel", *["iron", "gold", "tin"][: r.ans_rank], *[f"None of the above ({k})" for k in (1, 2, 3)][r.ans_rank :]]
        assert sorted(r.options.values()) == sorted(want) and r.options[r.answer] == "steel" and list(r.options) == list("ABCD")
    orders = {tuple(assemble.build(q, seed).orderBy("ans_rank").first().options.values()) for seed in range(8)}
    assert len(orders) > 2


@pytest.fixture(scope="module")
def items(spark, sf):
    return QuizPipeline(max_questions=4).from_sentences(facts(spark, sf)).cache()


def test_items(items):
    rows = items.collect()
    assert rows
    for r in rows:
        assert sorted(r.options) == list("ABCD") and r.options[r.answer] == r.answer_text and len(set(r.options.values())) == 4
        assert 1 <= r.q_idx <= 4 and 0 <= r.score <= 1 and r.explanation.startswith("According to the text: ") and r.answer_text in r.explanation


def test_items_dont_depend_on_partitions(spark, sf, items):
    again = QuizPipeline(max_questions=4).from_sentences(facts(spark, sf).repartition(7, "sentence"))
    assert sorted(map(repr, again.collect())) == sorted(map(repr, items.collect()))


def test_evaluation(spark, items):
    row = metrics.stats(items).first()
    assert row.total == items.count() and 0 <= row.quality_score <= 100 and row.extractive_rate == 1.0
    assert metrics.stats(items.limit(0)).count() == 0
    maps = metrics.distributions(items).first()
    assert sum(maps.type_dist.values()) == row.total and maps.wh_word_dist == {"when": row.total}
    answers = items.select("doc_id", "q_idx", F.col("answer").alias("letter"))
    assert {(r.percent, r.grade) for r in metrics.quiz_score(items, answers).collect()} == {(100, "excellent")}


def test_exports(spark, items, tmp_path):
    one = items.where("q_idx = 1").orderBy("doc_id").limit(3)
    for fmt in ("text", "json", "csv", "anki", "gift"):
        export.write(one, str(tmp_path / fmt), fmt)
    doc = one.first().doc_id
    rows = [r for f in (tmp_path / "csv" / f"doc_id={doc}").glob("*.csv") for r in csv.reader(f.open())]
    assert rows[0] == list(export.CSV_COLUMNS) and rows[1][1] == one.first().question
    assert json.loads(export.json_rows(one).first().value)["answer_text"] == one.first().answer_text
    anki = (next((tmp_path / "anki" / f"doc_id={doc}").glob("*.txt"))).read_text().splitlines()
    assert tuple(anki[:3]) == export.ANKI_HEADER and anki[3].count("\t") == 1


def test_metadata_of_empty_documents(spark):
    docs = spark.createDataFrame([(1, None), (2, "x"), (3, "")], "doc_id long, text string")
    sents = sentences(docs).select("doc_id", "sent_idx", "sentence")
    none = QuizPipeline().run(docs)
    meta = {r.doc_id: r.status for r in metrics.run_metadata(docs, sents, question_rows(sents), none).collect()}
    assert meta == {1: "Empty text", 2: "No sentences after preprocessing", 3: "Empty text"}


def test_providers(spark):
    sents = spark.createDataFrame([(1, 0, "Ada Lovelace was born in London town.")], "doc_id long, sent_idx int, sentence string")

    def tagger():
        return lambda rows: [[{"word": "Ada Love ##lace", "entity_group": "PER", "score": 0.99}, {"word": "x", "entity_group": "LOC", "score": 0.9}] for _ in rows]

    def broken():
        raise RuntimeError("no model")

    tagged = extract_answers(providers.with_entities(sents, tagger), entities="entities").where("source = 'NER'").collect()
    assert [(r.answer, r.type, r.score) for r in tagged] == [("Ada Lovelace", "PERSON", 0.946)] or [r.answer for r in tagged] == ["Ada Lovelace"]
    plain = extract_answers(sents).collect()
    assert extract_answers(providers.with_entities(sents, broken), entities="entities").collect() == plain
    asked = providers.with_raw_questions(extract_answers(sents), lambda: lambda rows: ["question: who wrote the first program" for _ in rows])
    assert {r.question for r in generate_questions(asked, "raw").collect()} == {"Who wrote the first program?"}
    vectors = providers.with_vectors(extract_answers(sents), lambda: lambda rows: [[1.0, 0.0] for _ in rows])
    assert vectors.count() == len({r.answer for r in plain})


def brute_similar(rows, k=3):
    def dot(a, b):
        return sum(float(x) * float(y) for x, y in zip(a, b, strict=True))

    out = {}
    for v, x, label in rows:
        cosines = [(-dot(x, y) / math.sqrt(dot(x, x) * dot(y, y)), str(w)) for w, y, other in rows if other == label and dot(x, x) * dot(y, y) > 0]
        out[v] = "|".join(w for _, w in sorted(c for c in cosines if 0.20 <= -c[0] <= 0.82)[:k])
    return out


def test_every_vector_is_ranked(spark, sf):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = QUERIES["embedding_rank"](spark, sf).collect()
    assert len(got) == len(rows) and {r.vec_id: r.best for r in got} == brute_similar(rows)


def test_blocks_dont_change_ranks(spark):
    rows = [(i, [float(i % 7), float(i % 3), 1.0], 0) for i in range(60)] + [(60, [0.0, 0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "key long, vector array<float>, label int")
    spans = df.select("label", F.col("key").cast("string").alias("answer"), "vector")
    for block in (7, 1024):
        got = {r.key: "|".join(r.best) for r in distract.rank_similar(df, spans, "label", block=block).collect()}
        assert got == {v: b for v, b in brute_similar(rows).items() if b}


def test_whole_pools(spark, monkeypatch):
    rows = [(1, i, 0, f"Answer {i}", "DATE") for i in range(9)] + [(2, 0, 0, "Alone", "DATE")]
    asked = spark.createDataFrame(rows, "doc_id long, sent_idx int, ans_rank int, answer string, type string")
    monkeypatch.setattr("quizspark.plans.queries._pool", lambda spark, d: (asked, asked))
    got = {(r.doc_id, r.sent_idx): (r.n, r.pool) for r in QUERIES["type_pool"](spark, "").collect()}
    digest = lambda pool: (len(pool), hashlib.md5("|".join(pool).encode()).hexdigest())
    assert got == {(1, i): digest([f"Answer {j}" for j in range(9) if j != i]) for i in range(9)} | {(2, 0): digest([])}


def test_models_take_part_in_the_pipeline(spark):
    """Stub models: entities give answers, raw questions are asked, vectors order and limit the pool."""
    sents = spark.createDataFrame([(1, 0, "Ada Lovelace was a friend of Charles Babbage"), (1, 1, "Alan Turing was a peer of Grace Hopper")], "doc_id long, sent_idx int, sentence string")
    people = ("Ada Lovelace", "Charles Babbage", "Alan Turing", "Grace Hopper")

    def entities():
        return lambda rows: [[{"word": p, "entity_group": "PER", "score": 0.9} for p in people if p in s] for (s,) in rows]

    def questioner():
        return lambda rows: [f"question: who was it that the {len(a)} letter name stands for here" for a, _ in rows]

    def embedder():
        at = {"Ada Lovelace": [1.0, 0.0], "Charles Babbage": [0.8, 0.6], "Alan Turing": [0.5, 0.9], "Grace Hopper": [1.0, 0.01]}
        return lambda rows: [at.get(a, [0.0, 1.0]) for (a,) in rows]

    pipe = QuizPipeline(entities=entities, questioner=questioner, embedder=embedder)
    asked = pipe.questions(sents)
    got = {r.answer: r for r in asked.collect()}
    assert set(people) <= set(got)
    assert got["Charles Babbage"].source == "NER"
    assert all(r.question == f"Who was it that the {len(a)} letter name stands for here?" for a, r in got.items())
    answers = asked.select("doc_id", "sent_idx", "ans_rank", "answer", "type")
    pools = {r.answer: r.pool for r in distract.type_pool(asked, answers, providers.with_vectors(answers, embedder)).collect()}
    assert [p for p in pools["Ada Lovelace"] if p in people] == [p for p in ("Charles Babbage", "Alan Turing") if p in got]  # 0.8, 0.49; 1.0 is too near
    assert pipe.from_sentences(sents).count() >= 0


def test_questions_of_distractors_are_made_once(spark, sf):
    """The spans of a document came from a second evaluation of all questions; the questions' own serve as well."""
    plan = QUERIES["distractor_greedy"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("o_orderpriority#") and sum("FileScan parquet" in line and "o_orderkey" in line for line in plan.split("\n")) == 1
    answers = ["May 5", "steel timber", "Deep Learning", "may 5", "is big", "ab", "42%", "Alan Turing", "1956", "neural networks"]
    rows = [(k % 3 or None, k, k % 2, f"the text has {a}", a, ("DATE", "CONCEPT", "PROPER_NOUN")[k % 3]) for k, a in enumerate(answers * 3)]
    questions = spark.createDataFrame(rows, "doc_id long, sent_idx int, ans_rank int, sentence string, answer string, type string")
    got, want = (sorted(map(str, distract.with_distractors(questions, a).collect())) for a in (None, questions.drop("sentence")))
    assert got == want and len(got) == 30
