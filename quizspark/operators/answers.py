"""Sentences to answers and questions. Narrow: a sentence's candidates are made and judged inside its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import questions as Q
from ..functions.columns import first_by


def extract_answers(sents: DataFrame, max_per_sentence: int = 3, entities: str | None = None) -> DataFrame:
    """(doc_id, sent_idx, sentence, ans_rank, answer, type, source, score). entities: a column of model spans (see sources.providers)."""
    found = A.extract(F.col("sentence"), F.col(entities) if entities else None, max_per_sentence)
    return sents.select("doc_id", "sent_idx", "sentence", F.posexplode(found).alias("ans_rank", "a")).select("doc_id", "sent_idx", "sentence", "ans_rank", "a.answer", "a.type", "a.source", "a.score")


def generate_questions(answers: DataFrame, raw: str | None = None) -> DataFrame:
    """answers with question and question_score; per sentence the first of equal questions. raw: a column of model questions."""
    made = answers.withColumn("question", Q.question(F.col("answer"), F.col("type"), F.col(raw) if raw else None))
    made = made.withColumn("question_score", Q.score(F.col("question"), F.col("answer"), F.col("score"), F.col("type")))
    keep = [c for c in answers.columns if c not in ("doc_id", "sent_idx", "sentence")] + ["question", "question_score"]
    # Answers of a sentence are few (the k best), so their questions are compared inside an array, keyed by the sentence.
    grouped = made.groupBy("doc_id", "sent_idx").agg(F.first("sentence").alias("sentence"), F.array_sort(F.collect_list(F.struct("ans_rank", *(c for c in keep if c != "ans_rank")))).alias("q"))
    return grouped.select("doc_id", "sent_idx", "sentence", F.inline(first_by(F.col("q"), lambda q: F.lower(q["question"]))))


def question_rows(sents: DataFrame, max_per_sentence: int = 3, entities: Column | None = None) -> DataFrame:
    """Answers and template questions of sentences in one projection, without a shuffle: the model-free path."""
    s = F.col("sentence")

    def ask(a: Column, i: Column) -> Column:
        q = Q.question(a["answer"], a["type"])
        return F.struct(i.alias("ans_rank"), a["answer"].alias("answer"), a["type"].alias("type"), a["source"].alias("source"), a["score"].alias("score"), q.alias("question"), Q.score(q, a["answer"], a["score"], a["type"]).alias("question_score"))

    found = F.transform(A.extract(s, entities, max_per_sentence), ask)
    return sents.select("doc_id", "sent_idx", "sentence", F.inline(first_by(found, lambda q: F.lower(q["question"]))))
