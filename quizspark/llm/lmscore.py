"""Stupid-backoff language-model scores of every document under the n-gram counts of all other documents.

For a word with history, S = c(h w) / c(h) with the longest history for which h w occurs in another document, times ALPHA for
each word the history was shortened by; at the end c(w) / N, with UNSEEN in place of a count of 0. A document's own
occurrences are taken off all counts (and off N), so no document vouches for itself. Its score is the sum of ln S.

The relational plan, with relations packed into sorted columns instead of a row per n-gram (rows of 64-bit hashes would be
several times the input on disk):
1. Records are dealt into parts of about PART bytes by a hash of their place in the files, so equal ids or texts don't meet in
   one part. A part's distinct n-grams with their counts (the map-side aggregate of the exploded n-grams) go to the hash range
   they belong to, a block for each part and range.
2. The count tables are partitioned by hash range: a range merges its blocks, sums counts and answers each block with the
   corpus counts of its n-grams. However frequent an n-gram, it comes once from a part, so no range is hot.
3. A part joins the answers to its documents' n-grams and sums per document.
The texts are shuffled once, compressed (steps 1 and 3 share the exchange). Blocks without n-grams are not sent. All shuffles
have as many partitions as the measured bytes ask for.

n-grams meet as 64-bit hashes. Words: A-Z lower-cased, cut at ASCII white space. Nulls and texts without words: no words, score
0. Repeated rows are documents of their own; a null id is an id like others, ids are of any type. Ties don't arise. A very long text
makes its part as much larger. An empty table gives an empty result. Other columns are ignored, whatever they are called.

Limit: parts and ranges both grow with the corpus, so a block shrinks as the square of it: some 2,000 n-grams at 12 GB, two at 12 TB,
where merging the blocks of groups of parts first would be needed at the price of a second shuffle of the blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, materialise, quoted, text_bytes, with_place
from .shingles import WordHashes, mix, words

ALPHA = 0.4
UNSEEN = 0.5
PART = 12 << 20
RANGE = 2_000_000
PARTS_A_TASK = 2


class Words:
    """The words of a part's documents in one array; n-grams are made from it for one n at a time, to save memory."""

    def __init__(self, part: pa.Table):
        known, found, unzip = WordHashes(200_000), [], zstandard.ZstdDecompressor().decompress
        for t in part.column("text"):
            found.append(known.of(words(unzip(t.as_buffer())) if t.is_valid else []))
        self.sizes = np.array([len(f) for f in found], dtype=np.int64)
        self.hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(found), dtype=np.int32), self.sizes)
        self.place = (np.arange(len(self.hashes)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)).astype(np.int32)

    def grams(self, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For n = 1 to order: where a document's n-grams end, and their hashes."""
        last = np.zeros(len(self.hashes), np.uint64)
        for n in range(1, order + 1):
            if n > 1:
                last = np.append(np.zeros(min(1, len(last)), np.uint64), last[:-1])  # of the n - 1 words before
            last = mix((last + self.hashes) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n))
            ends = np.flatnonzero(self.place >= n - 1).astype(np.int32)
            yield ends, last[ends]


def _zip(batches: Batches) -> Batches:
    """Texts as zstandard frames: the shuffle's own codec leaves half as much again."""
    for b in batches:
        pack = zstandard.ZstdCompressor(level=1).compress
        texts = pa.array([None if t is None else pack(t) for t in text_bytes(b.column(1))], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), texts, b.column(2)], names=["doc_id", "text", "part"])


def squeeze(x: np.ndarray) -> bytes:
    """Ascending 64-bit values as differences of as few bytes as all of them need, or counts likewise."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    data = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes, n: int) -> np.ndarray:
    width = data[0]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:], max_output_size=width * n), np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def _edges(ranges: int) -> np.ndarray:
    return np.array([i * 2**64 // ranges for i in range(ranges)], dtype=np.uint64)


def _ask(order: int, ranges: int) -> Callable:
    def run(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        rows, edges = [], _edges(ranges)
        for n, (_, found) in enumerate(Words(part).grams(order)):
            values, counts = np.unique(found, return_counts=True)
            bounds = np.append(np.searchsorted(values, edges), len(values))
            for r in np.flatnonzero(np.diff(bounds)):
                v, c = values[bounds[r] : bounds[r + 1]], counts[bounds[r] : bounds[r + 1]]
                rows.append((key[0].as_py(), n, int(r), len(v), squeeze(np.diff(v, prepend=edges[r])), squeeze(c.astype(np.uint64))))
        return pa.table(dict(zip(("part", "n", "range", "size", "grams", "counts"), zip(*rows, strict=True) if rows else [[]] * 6, strict=True)), schema=_ASKED)

    return run


_ASKED = pa.schema([("part", pa.int64()), ("n", pa.int32()), ("range", pa.int64()), ("size", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())])
_ANSWERED = pa.schema([("part", pa.int64()), ("n", pa.int32()), ("range", pa.int64()), ("size", pa.int64()), ("totals", pa.binary())])


def _answer(blocks: pa.Table) -> pa.Table:
    """The blocks of one range and one n. Their n-grams count from the range's edge."""
    sizes = blocks.column("size").to_pylist()
    values = np.concatenate([np.cumsum(unsqueeze(g, n), dtype=np.uint64) for g, n in zip(blocks.column("grams").to_pylist(), sizes, strict=True)])
    counts = np.concatenate([unsqueeze(c, n) for c, n in zip(blocks.column("counts").to_pylist(), sizes, strict=True)])
    _, at = np.unique(values, return_inverse=True)
    totals = np.bincount(at, weights=counts).astype(np.uint64)[at]  # exact below 2**53
    cut = np.split(totals, np.cumsum(sizes)[:-1])
    return pa.table([blocks.column("part"), blocks.column("n"), blocks.column("range"), blocks.column("size"), pa.array([squeeze(t) for t in cut], pa.binary())], schema=_ANSWERED)


def counts_of_others(flat: np.ndarray, doc: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """For each n-gram, of document doc: its corpus count (totals: of the distinct ones, ascending) less its document's."""
    order = np.argsort(flat, kind="stable")  # equal n-grams stay in document order, so those of one document are a run
    flat = flat[order]
    fresh = np.ones(len(flat), dtype=bool)
    np.not_equal(flat[1:], flat[:-1], out=fresh[1:])
    del flat
    sizes = np.diff(np.append(np.flatnonzero(fresh), len(fresh)))
    doc = doc[order]
    fresh[1:] |= doc[1:] != doc[:-1]
    del doc
    runs = np.diff(np.append(np.flatnonzero(fresh), len(fresh)))
    counts = np.repeat(totals.astype(np.int64), sizes)
    counts -= np.repeat(runs, runs)
    out = np.empty(len(order), dtype=np.int64)
    out[order] = counts
    return out


def _sum(order: int) -> Callable:
    def run(part: pa.Table, answers: pa.Table) -> pa.Table:
        w, others = Words(part), []
        for n, (ends, found) in enumerate(w.grams(order)):
            mine = answers.filter(pa.compute.equal(answers.column("n"), n)).sort_by("range")
            totals = [unsqueeze(t, s) for t, s in zip(mine.column("totals").to_pylist(), mine.column("size").to_pylist(), strict=True)]
            counts = np.zeros(len(w.hashes), dtype=np.int64)
            if totals:
                counts[ends] = counts_of_others(found, w.doc[ends], np.concatenate(totals))
            others.append(counts)
        out, single = scores(w.place, others)
        n_single, log_ratio = (np.bincount(w.doc, weights=x, minlength=len(w.sizes)) for x in (single, out))
        return pa.table({"doc_id": part.column("doc_id"), "n_words": w.sizes, "n_single": n_single.astype(np.int64), "log_ratio": log_ratio})

    return run


def scores(place: np.ndarray, others: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """place: of each word in its document; others: counts in other documents of the n-grams that end there, n = 1, 2, ...

    Returns ln S of each word, without the 1 / N of those scored without history, and whether it is one of these.
    """
    out, single = np.zeros(len(place)), np.ones(len(place), dtype=bool)
    for n in range(len(others) - 1, -1, -1):
        at = np.flatnonzero(single & (others[n] > 0)) if n else np.flatnonzero(single)
        shorter = np.log(ALPHA) * (np.minimum(place[at], len(others) - 1) - n)
        count = others[n][at]
        out[at] = shorter + (np.log(count / np.maximum(others[n - 1][at - 1], 1)) if n else np.log(np.where(count > 0, count, UNSEEN)))
        if n:
            single[at] = False
    return out, single


def score_documents(docs: DataFrame, order: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns doc_id, n_words, log_score and word_score (log_score by word; 0 without words) for every row."""
    given = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    records = with_place(given, "place")
    total = records.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + F.count(F.lit(1))).first()[0]
    parts, ranges = -(-total // PART) or 1, -(-total // (6 * RANGE)) or 1
    tasks = -(-parts // PARTS_A_TASK)
    dealt = records.select("doc_id", "text", F.pmod(F.xxhash64("place.file", "place.row"), F.lit(parts)).alias("part"))
    dealt = dealt.mapInArrow(_zip, f"doc_id {kind}, text binary, part long").repartition(tasks, "part")
    asked = dealt.groupBy("part").applyInArrow(_ask(order, ranges), "part long, n int, range long, size long, grams binary, counts binary")
    answered = asked.repartition(order * -(-ranges // PARTS_A_TASK), "n", "range").groupBy("n", "range").applyInArrow(_answer, "part long, n int, range long, size long, totals binary")
    back = answered.repartition(tasks, "part").groupBy("part")
    summed = dealt.groupBy("part").cogroup(back).applyInArrow(_sum(order), f"doc_id {kind}, n_words long, n_single long, log_ratio double")
    scores = materialise(summed)
    n = scores.agg(F.sum("n_words")).first()[0] or 0
    others = F.greatest(F.lit(1), F.lit(n) - F.col("n_words"))
    score = F.col("log_ratio") - F.col("n_single") * F.log(others)
    return scores.select("doc_id", "n_words", score.alias("log_score"), F.when(F.col("n_words") > 0, score / F.col("n_words")).otherwise(0.0).alias("word_score"))
