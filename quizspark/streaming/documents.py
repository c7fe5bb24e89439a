"""Micro-batches of documents to sentences and questions. These stages keep no state between documents, so a stream of whole
documents gives the rows a batch gives; ranking and assembly need a document's rows together and run in foreachBatch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.answers import question_rows
from ..operators.sentences import sentences
from ..plans.pipeline import QuizPipeline


def stream_questions(docs: DataFrame) -> DataFrame:
    return question_rows(sentences(docs).select("doc_id", "sent_idx", "sentence"))


def stream_items(docs: DataFrame, path: str, checkpoint: str, pipeline: QuizPipeline | None = None, **trigger) -> StreamingQuery:
    """Writes each micro-batch's items under path by batch number, so a repeated batch replaces its own rows."""
    pipeline = pipeline or QuizPipeline()

    def write(batch: DataFrame, number: int) -> None:
        pipeline.run(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
