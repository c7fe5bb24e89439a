"""Documents to sentences. No shuffle: a document's sentences are made, judged and deduplicated inside its row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) without links and noise."""
    plain = docs.select(F.col(id_col).alias("doc_id"), T.from_text(F.col(text_col)).alias("text"))
    return plain.select("doc_id", T.fix_encoding(F.col("text")).alias("text")).select("doc_id", T.strip_noise(F.col("text")).alias("text"))


def all_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sent_idx, sentence) before any judgement."""
    return cleaned(docs, id_col, text_col).select("doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("sent_idx", "sentence"))


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_sentences, sent_idx, sentence): good sentences in order, indexed after deduplication."""
    return cleaned(docs, id_col, text_col).select("doc_id", F.inline(T.indexed(T.good_sentences(F.col("text")))))
