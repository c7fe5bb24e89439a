"""A corpus pipeline over `documents`: five stages, each on all that the one before it kept.

1. toxicity: documents scored 0.5 or more go. The model learns from `labels` and the stage's own documents.
2. near_dedup: one document of each near-duplicate group stays (five-word shingles, similarity 0.8).
3. decontamination: documents that hold 80 % of a benchmark item's shingles go.
4. secrets: secrets in texts are replaced by a mark; every document stays.
5. packing: the texts as token pieces in sequences of at most 4096, a row per piece.

Every stage takes any table with doc_id and text; stages 1 to 4 return its columns as they are, whatever they are called. Null and empty
texts and rows without an id pass stages 1 to 4 (stage 3 drops the rows without an id if one of them holds an item) and are packed as
a single end id. Repeated rows stay or go together, so ties need no rule. Texts may be of any length. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizspark.llm import toxicity
from quizspark.llm.common import materialise, table
from quizspark.llm.decontam import drop_contaminated
from quizspark.llm.neardup import keep_one
from quizspark.llm.packing import pack_best_fit
from quizspark.llm.queries import tokenizer_path
from quizspark.llm.secrets import redact_secrets


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts score the bias alone. Without labels of both kinds nothing is known and all documents stay."""
    model = toxicity.fit(toxicity.learn(docs, table(spark, sf_dir, "labels"), "toxic", F.lit(True)))
    return toxicity.keep_clean(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of a group stays, with all its rows; documents without words and rows without an id stay."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that share an id go together; an empty benchmark removes nothing."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A text is changed where it holds a secret, n_chars with it; null texts stay null."""
    return redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each row; a null or empty text is one piece, the end id.

    Executors still hold what earlier stages grew to, so a worker remembers fewer chunks than by default, at some more time.
    """
    return pack_best_fit(docs, tokenizer_path(), known_chunks=200_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("secrets", redact),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, batch_rows=10_000)
    return docs


#: A learned classifier, tokens of a vocabulary file and best-fit placement are beyond SQL; tests hold run() against brute force.
ORACLE_SQL: str | None = None
