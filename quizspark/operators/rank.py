"""Sentence ranking: TF-IDF centrality and surface cues, per document.

Centrality is the mean cosine to the document's other sentences. With unit vectors v and their sum S it is
(v . S - v . v) / (n - 1), so no sentence meets another. All keys begin with the document: the rows are dealt and ordered by it once,
and whole documents are then ranked in Arrow batches, where counts and sums of terms are taken over many documents at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.columns import is_one_of, let, split_words


# Weights of centrality and of the cues, in the order they are added.
CENTRALITY, POSITION, LENGTH, DENSITY, ENTITY, DEFINITION = 0.45, 0.15, 0.15, 0.10, 0.10, 0.05


def content_words(s: Column) -> Column:
    """Words of two or more characters that are no stop words."""
    return F.filter(F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)), lambda w: ~is_one_of(w, L.RANK_STOP_WORDS))


def terms(s: Column) -> Column:
    """The content words, and pairs of neighbours among them."""
    pairs = lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1)))
    return let(content_words(s), lambda w: F.concat(w, pairs(w)))


def _weights(sents: DataFrame) -> DataFrame:
    """A row per term of a sentence: (doc_id, sent_idx, n_sentences, term, w). Dealt by document once."""
    dealt = sents.repartition("doc_id").select("doc_id", "sent_idx", "n_sentences", F.explode(terms(F.col("sentence"))).alias("term"))
    tf = dealt.groupBy("doc_id", "sent_idx", "n_sentences", "term").agg(F.count("term").alias("tf"))
    df = F.count("term").over(Window.partitionBy("doc_id", "term"))
    raw = tf.withColumn("w", (1 + F.log("tf")) * (F.log((1 + F.col("n_sentences")) / (1 + df)) + 1))
    return raw.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id", "sent_idx"))))


def tfidf(sents: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, term, w): unit vectors of 1 + ln(tf) times ln((1 + n) / (1 + df)) + 1."""
    return _weights(sents).select("doc_id", "sent_idx", "term", "w")


def centrality(sents: DataFrame) -> DataFrame:
    """sents with centrality (0 without terms or other sentences) and n_terms, the number of its distinct terms."""
    return _ranked(sents).select("doc_id", "sent_idx", "n_sentences", "sentence", "centrality", "n_terms")


def position_bonus(index: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - index * 0.03)


def length_score(s: Column) -> Column:
    n = F.size(split_words(s))
    return F.when(n.between(8, 40), 1.0).when(n < 8, 0.5 + 0.5 * (n / 8)).otherwise(F.greatest(F.lit(0.4), 1.0 - (n - 40) * 0.02))


def info_density(s: Column) -> Column:
    content = lambda w: F.rlike(w, F.lit(r"\A\p{L}+\z")) & ~is_one_of(w, L.RANK_STOP_WORDS)
    return let(split_words(F.lower(s)), lambda w: F.when(F.size(w) == 0, 0.0).otherwise(F.size(F.filter(w, content)) / F.size(w)))


def entity_bonus(s: Column) -> Column:
    """Case doesn't matter to the pattern, so any run of two or more words of letters counts."""
    pattern = r"(?iU)\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b|\b\d{4}\b|\b\d+(?:\.\d+)?\s*%|\b(?:such as|including|for example)\b"
    return F.least(F.lit(0.20), F.regexp_count(s, F.lit(pattern)) * 0.05)


def definition_bonus(s: Column) -> Column:
    return F.when(F.rlike(s, F.lit(rf"(?iU)\b(?:{L.DEFINITION_CUES})\b")), 0.15).otherwise(0.0)


def scored(sents: DataFrame) -> DataFrame:
    """sents with score: the weighted cues over the document's maximum; 1.0 for an only sentence, 0.5 if no term exists."""
    return _ranked(sents).select("doc_id", "sent_idx", "n_sentences", "sentence", "score")


def _ranked(sents: DataFrame, over: int = 0) -> DataFrame:
    """sents with centrality, n_terms, score and place (from 1, by score, then index); these are null in documents of at most `over` sentences.

    Rows of a document with the same index and number of sentences count as one sentence.
    """
    s, kinds = F.col("sentence"), dict(sents.dtypes)
    cues = (position_bonus(F.col("sent_idx")), length_score(s), info_density(s), entity_bonus(s), definition_bonus(s))
    where_ranked = lambda c: F.when(F.col("n_sentences") > over, c) if over else c
    dealt = sents.select("doc_id", "sent_idx", "n_sentences", "sentence").repartition("doc_id").sortWithinPartitions("doc_id", "sent_idx", "n_sentences", F.desc("sentence"))
    known = dealt.select("*", where_ranked(content_words(s)).alias("words"), *(where_ranked(c).cast("double").alias(f"cue{k}") for k, c in enumerate(cues)))
    schema = "".join(f"{c} {kinds[c]}, " for c in ("doc_id", "sent_idx", "n_sentences", "sentence"))
    return known.mapInArrow(_whole_documents(over), schema + "centrality double, n_terms long, score double, place int")


def _whole_documents(over: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []  # of documents whose last row may be still to come
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0)
            if waiting and ids[-1] == waiting[0].column(0)[0]:
                waiting.append(b)
                continue
            start = int(_runs(ids)[1][-1])
            yield from _rank(pa.Table.from_batches([*waiting, b.slice(0, start)]), over)
            waiting = [b.slice(start)]
        if waiting:
            yield from _rank(pa.Table.from_batches(waiting), over)

    return run


def _runs(*columns: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's run of equal values, and the first row of each run."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        new[1:] |= np.diff(c.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)) != 0
    return np.cumsum(new) - 1, np.flatnonzero(new)


def _rank(rows: pa.Table, over: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "sent_idx", "n_sentences", "sentence"]
    ranked = pc.fill_null(pc.greater(rows.column("n_sentences"), over), False)
    short, rows = rows.filter(pc.invert(ranked)).select(names), rows.filter(ranked)
    none = lambda n, kind: pa.nulls(n, kind)
    n = short.num_rows
    yield from pa.table([*short.columns, none(n, pa.float64()), none(n, pa.int64()), none(n, pa.float64()), none(n, pa.int32())], names=[*names, "centrality", "n_terms", "score", "place"]).to_batches()
    if not rows.num_rows:
        return
    sentence, first = _runs(*(rows.column(c) for c in names[:3]))
    indexed, _ = _runs(*(rows.column(c) for c in names[:2]))
    kept = rows.take(pa.array(first))
    doc, starts = _runs(kept.column("doc_id"))
    indexed, size = indexed[first], kept.column("n_sentences").to_numpy()
    central, n_terms = _centrality(rows.column("words"), sentence, doc, indexed, size)
    cues = [kept.column(f"cue{k}").to_numpy() for k in range(5)]
    raw = CENTRALITY * central + POSITION * cues[0] + LENGTH * cues[1] + DENSITY * cues[2] + ENTITY * cues[3] + DEFINITION * cues[4]
    with np.errstate(all="ignore"):
        share = raw / np.fmax.reduceat(raw, starts)[doc]
    share = np.where(np.isfinite(share), share, 0.0)
    score = np.where(size == 1, 1.0, np.where(np.maximum.reduceat(n_terms, starts)[doc] == 0, 0.5, share))
    order = np.lexsort((kept.column("sent_idx").to_numpy(), -score, doc))
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order)) - starts[doc[order]] + 1
    columns = [*kept.select(names).columns, pa.array(central), pa.array(n_terms, pa.int64()), pa.array(score), pa.array(place)]
    yield from pa.table(columns, names=[*names, "centrality", "n_terms", "score", "place"]).to_batches()


def _centrality(words: pa.ChunkedArray, sentence: np.ndarray, doc: np.ndarray, indexed: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean cosine and number of distinct terms of each sentence. words: of each row; sentence: the row's; the others: of each sentence."""
    lists = words.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    word, known = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
    row = np.repeat(np.arange(len(lengths)), lengths)
    near = np.flatnonzero(row[1:] == row[:-1])
    term = np.concatenate([word, known * (word[near] + 1) + word[near + 1]])  # words, then pairs of neighbours
    term = np.unique(term, return_inverse=True)[1]
    n = int(term.max(initial=0)) + 1
    cell, tf = np.unique(sentence[np.concatenate([row, row[near]])] * n + term, return_counts=True)
    of, term = np.divmod(cell, n)
    _, at, df = np.unique(doc[of] * n + term, return_inverse=True, return_counts=True)
    w = (1 + np.log(tf)) * (np.log((1 + size[of]) / (1 + df[at])) + 1)
    w /= np.sqrt(np.bincount(indexed[of], w * w, minlength=int(indexed[-1]) + 1))[indexed[of]]
    total = np.bincount(at, w, minlength=len(df))[at]
    summed = np.bincount(of, w * total - w * w, minlength=len(doc))
    return np.where(size > 1, summed / np.maximum(size - 1, 1), 0.0), np.bincount(of, minlength=len(doc))


def rank_sentences(sents: DataFrame, top_k: int, threshold: float = 0.0) -> DataFrame:
    """The top_k sentences of each document by score, then index, if over the threshold: (doc_id, sent_idx, sentence, score)."""
    return _ranked(sents).where((F.col("place") <= top_k) & (F.col("score") >= threshold)).select("doc_id", "sent_idx", "sentence", "score")


def select_sentences(sents: DataFrame, max_sentences: int = 30, ranking: bool = True, threshold: float = 0.05) -> DataFrame:
    """Documents of more sentences are ranked, others kept whole: (doc_id, sent_idx, sentence). sents is evaluated once."""
    if not ranking:
        return sents.where(F.col("sent_idx") < max_sentences).select("doc_id", "sent_idx", "sentence")
    best = F.col("place").isNull() | ((F.col("place") <= max_sentences) & (F.col("score") >= threshold))
    return _ranked(sents, max_sentences).where(best).select("doc_id", "sent_idx", "sentence")
