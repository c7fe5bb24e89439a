"""Documents to quiz items: the stages composed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.answers import extract_answers, generate_questions, question_rows
from ..operators.assemble import assemble
from ..operators.rank import select_sentences
from ..operators.sentences import sentences
from ..sources.providers import Factory, with_entities, with_raw_questions, with_vectors


@dataclass(frozen=True)
class QuizPipeline:
    """Everything is keyed by document; a document's rows meet only in its own windows.

    entities, questioner, embedder: optional model factories (see sources.providers); without one its model-free branch applies.
    seed: another order of the options.
    """

    max_questions: int = 20
    max_sentences: int = 30
    answers_per_sentence: int = 3
    ranking: bool = True
    seed: int | None = None
    entities: Factory | None = None
    questioner: Factory | None = None
    embedder: Factory | None = None

    def select(self, docs: DataFrame) -> DataFrame:
        return select_sentences(sentences(docs), self.max_sentences, self.ranking)

    def questions(self, sents: DataFrame) -> DataFrame:
        if self.entities:
            sents = with_entities(sents.select("doc_id", "sent_idx", "sentence"), self.entities)
        if not self.questioner:
            return question_rows(sents, self.answers_per_sentence, F.col("entities") if self.entities else None)
        answers = extract_answers(sents, self.answers_per_sentence, "entities" if self.entities else None)
        return generate_questions(with_raw_questions(answers, self.questioner), "raw").drop("raw")

    def from_sentences(self, sents: DataFrame) -> DataFrame:
        """sents: (doc_id, sent_idx, sentence)."""
        questions = self.questions(sents)
        if not self.embedder:
            return assemble(questions, max_questions=self.max_questions, seed=self.seed)
        answers = questions.select("doc_id", "sent_idx", "ans_rank", "answer", "type")
        return assemble(questions, answers, self.max_questions, with_vectors(answers, self.embedder), self.seed)

    def run(self, docs: DataFrame) -> DataFrame:
        return self.from_sentences(self.select(docs))
