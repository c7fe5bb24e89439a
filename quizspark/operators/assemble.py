"""Questions and distractors to multiple-choice items; caps and duplicates per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import questions as Q
from ..functions.columns import let, strings, strip


def first_questions(questions: DataFrame) -> DataFrame:
    """The first of each normalised question of a document, whatever becomes of it later."""
    return _placed(questions).where("__asks and __place = 1").drop("__place", "__asks")


def _placed(questions: DataFrame) -> DataFrame:
    stripped = questions.withColumn("question", strip(F.col("question"))).withColumn("answer", strip(F.col("answer")))
    asks = F.coalesce((F.col("question") != "") & (F.col("answer") != ""), F.lit(False))
    place = F.row_number().over(Window.partitionBy("doc_id", "__asks", Q.question_key(F.col("question"))).orderBy("sent_idx", "ans_rank"))
    return stripped.withColumn("__asks", asks).withColumn("__place", place)


def build(questions: DataFrame, seed: int | None = None) -> DataFrame:
    """questions (with distractors) as items: options, letter, explanation, labels. seed: another order of the options."""
    padding = F.array(*(F.lit(f"None of the above ({k})") for k in (1, 2, 3)))
    padded = let(F.slice("distractors", 1, 3), lambda x: F.concat(x, F.slice(padding, F.size(x) + 1, 3 - F.size(x))))
    order = Q.shuffled(F.col("question") if seed is None else F.concat(F.lit(f"{seed}|"), F.col("question")), F.concat(F.array("answer"), padded))

    def placed(o: Column) -> Column:
        letter = F.get(strings(Q.LETTERS), (F.array_position(o, F.col("answer")) - 1).cast("int"))
        return F.struct(F.map_from_arrays(strings(Q.LETTERS), o).alias("options"), letter.alias("letter"))

    # New columns get names of their own first: inside lambdas, a select's own aliases would hide input columns.
    labels = {
        "__o": let(order, placed),
        "__explanation": Q.explanation(F.col("answer"), F.col("sentence")),
        "__type": Q.question_type(F.col("question")),
        "__difficulty": Q.difficulty(F.col("question"), F.col("type")),
    }
    items = questions.withColumns(labels).withColumnsRenamed({"answer": "answer_text", "type": "answer_type", "score": "answer_score", "question_score": "score", "sentence": "source_sentence", "__explanation": "explanation", "__type": "type", "__difficulty": "difficulty"})
    return items.select("doc_id", "sent_idx", "ans_rank", "question", F.col("__o.options").alias("options"), F.col("__o.letter").alias("answer"), "answer_text", "explanation", "type", "difficulty", "score", "answer_type", "source_sentence")


def good(items: DataFrame) -> DataFrame:
    return items.where(Q.is_good(F.col("question"), F.col("answer_text"), F.map_values("options")))


def cap(items: DataFrame, max_questions: int) -> DataFrame:
    """Of the first 2 * max_questions good items of a document the best by score; q_idx counts from 1."""
    early = items.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id").orderBy("sent_idx", "ans_rank"))).where(F.col("__n") <= 2 * max_questions)
    best = early.withColumn("q_idx", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "__n"))).where(F.col("q_idx") <= max_questions)
    return best.select("doc_id", "q_idx", "question", "options", "answer", "answer_text", "explanation", "type", "difficulty", "score", "answer_type", "source_sentence")


def assemble(questions: DataFrame, answers: DataFrame | None = None, max_questions: int = 30, vectors: DataFrame | None = None, seed: int | None = None) -> DataFrame:
    """Items of questions. answers: spans for distractors, with vectors only; else the questions' own serve, in the pass that finds repeats."""
    from .distract import own_spans, with_distractors

    if answers is not None:
        asked = first_questions(questions)
    else:
        asked = own_spans(_placed(questions.withColumn("__answer", F.col("answer"))), "__answer").where("__asks and __place = 1").drop("__place", "__asks", "__answer")
    return cap(good(build(with_distractors(asked, answers, vectors), seed)), max_questions)
