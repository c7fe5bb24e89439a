"""Best-fit packing of tokenised documents into fixed-length sequences, planned on the length histogram.

1. Tokenise: one pass over the texts; a document's ids plus the end id are cut into pieces of at most `capacity`.
   Only piece descriptions (no ids) leave the pass. Each piece carries its rank among the pieces of its length in
   its input partition, so no row is ever sorted or shuffled to rank it.
2. Plan: the histogram has at most `capacity` rows, whatever the input. Best-fit decreasing over counts: all pieces
   of a length are placed together, each step fills a whole class of equally filled sequences.
3. Place: global rank = offset of (length, partition) + local rank; the plan maps (length, rank) to a slot. The plan
   has an entry for each run of equal sequences, so its size depends on `capacity`, not on the number of documents.

A text's ids are the ids of its whitespace-separated chunks: the tokenizer's normaliser works character by character
and its pre-tokenizer never joins across white space. Chunks repeat, so each is encoded once for each worker and memory.

Nulls and empty texts: a single end id, one piece of length 1. Repeated rows are packed one by one; pieces of one length are
interchangeable, so ties need no rule. Ids are of any type, a null one stays null. Very long texts are cut into pieces as they
are read, one text's ids are held at a time. An empty table gives an empty result. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import bisect
import functools
import os
import string
import zlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Batches, batch, materialise, quoted, released, text_bytes

END_ID = 1
_PUNCTUATION = string.punctuation.encode()
_PIECES = "piece int, start long, length long, ids_crc32 long, part int, local_rank long"
_PLACED = "piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class ChunkIds:
    """Chunk bytes -> its ids as little-endian 32-bit bytes. With `most` entries it becomes the old generation and starts anew;
    what is met again moves over, so frequent chunks stay and memory is bounded.

    A chunk of Latin-1 letters with ASCII punctuation behind it is two pre-tokens, and case doesn't matter to its letters. Both are
    chunks themselves, so one table serves for all. New letter runs are encoded many at once: joined by spaces, each ends at the
    first id that closes a word.
    """

    def __init__(self, tokenizer_json: str, most: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(tokenizer_json)
        self.encode, self.most = tokenizer.encode_batch_fast, most
        vocab = tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _lacks(self, chunk: bytes) -> bool:
        """Whether the chunk is in neither generation; from the old one it moves over."""
        if chunk in self.known:
            return False
        if (ids := self.old.get(chunk)) is None:
            return True
        self.known[chunk] = ids
        return False

    def learn(self, chunks: Iterable[bytes]) -> None:
        """chunks: distinct ones that neither generation has."""
        runs, other, split = {}, {}, []
        for c in chunks:
            stem = c.rstrip(_PUNCTUATION)
            run = stem.lower()
            if not run.isalpha():  # as ASCII
                text = run.decode().lower()
                if not (text.isalpha() and max(text) < "\u0100"):
                    other[c] = None
                    continue
                run = text.encode()
            if len(run) >= 200:
                other[c] = None
            elif run == c:
                runs[c] = None
            else:
                split.append((c, run, len(stem)))
                if self._lacks(run):
                    runs[run] = None
                if len(stem) < len(c) and self._lacks(rest := c[len(stem) :]):
                    other[rest] = None
        names = list(other)
        for i in range(0, len(names), 4096):
            part = names[i : i + 4096]
            for c, e in zip(part, self.encode([c.decode() for c in part], add_special_tokens=False), strict=True):
                self.known[c] = np.asarray(e.ids, dtype="<u4").tobytes()
        names = list(runs)
        for i in range(0, len(names), 4096):
            part = names[i : i + 4096]
            ids = np.asarray(self.encode([b" ".join(part).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
            ends, data, at = ((np.flatnonzero(self.closes[ids]) + 1) * 4).tolist(), ids.tobytes(), 0
            for run, end in zip(part, ends, strict=True):
                self.known[run] = data[at:end]
                at = end
        known = self.known
        for c, run, n in split:
            known[c] = known[run] + known[c[n:]] if n < len(c) else known[run]

    def ids(self, text: bytes) -> bytes:
        return self.all_ids([text])[0]

    def all_ids(self, texts: list[bytes]) -> list[bytes]:
        cut = [t.split() for t in texts]
        new = set().union(*cut).difference(self.known)  # of an exact dict: by looking up, not by walking through it
        met = [c for c in new if c in self.old]
        self.known.update((c, self.old[c]) for c in met)
        if new := new.difference(met):
            self.learn(new)
        out = [b"".join(map(self.known.__getitem__, chunks)) for chunks in cut]
        if len(self.known) > self.most:
            self.old, self.known = self.known, {}
        return out


@functools.lru_cache(maxsize=1)
def chunk_ids(tokenizer_json: str, most: int) -> ChunkIds:
    """One for each Python worker, which serves many tasks."""
    return ChunkIds(tokenizer_json, most)


def _tokenise(tokenizer_json, capacity: int, known_chunks: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        schema = pa.schema([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("local_rank", pa.int64())])
        cache, seen, end, step = chunk_ids(tokenizer_json.value, known_chunks), [0] * (capacity + 1), np.array([END_ID], "<u4").tobytes(), 4 * capacity
        part = TaskContext.get().partitionId()
        for b in batches:
            rows: list[tuple] = []
            docs: list[int] = []
            for doc, ids in enumerate(_by_mb(cache, text_bytes(b.column(1)))):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    piece = ids[at : at + step]
                    n = len(piece) // 4
                    rows.append((k, at // 4, n, zlib.crc32(piece), part, seen[n]))
                    docs.append(doc)
                    seen[n] += 1
            made = batch(schema, *(zip(*rows, strict=True) if rows else [[]] * 6))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(docs, pa.int64())), *made.columns], names=["doc_id", *schema.names])

    return run


def _by_mb(cache: ChunkIds, texts: list[bytes | None]) -> Iterable[bytes]:
    """Ids of each text; about a MB of texts at a time, so that new chunks are encoded together."""
    some, size = [], 0
    for t in texts:
        some.append(t or b"")
        size += len(some[-1])
        if size >= 1 << 20:
            yield from cache.all_ids(some)
            some, size = [], 0
    yield from cache.all_ids(some)


def plan_best_fit(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over counts. Entries (length, first rank, first sequence, offset): ranks from the entry's first one
    up to the next entry's take consecutive sequences at that offset. Returns the entries by (length, rank), and the sequences."""
    free: dict[int, list[tuple[int, int]]] = {}  # room left -> runs (first sequence, count)
    rooms: list[int] = []  # keys of free in order
    entries: list[tuple[int, int, int, int]] = []
    opened = 0
    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count = free[room].pop()
                if not free[room]:
                    del free[room], rooms[at]
            else:
                room, each = capacity, capacity // length
                first, count = opened, -(-left // each)
                opened += count
            # The room that remains is the smallest that fits, so best fit fills a sequence with this length before the next one.
            each = room // length
            full = min(count, left // each)
            runs = [(first, full, each)] if full else []
            if full < count and left - full * each:
                runs.append((first + full, 1, left - full * each))
            used = 0
            for start, n, times in runs:
                for t in range(times):
                    entries.append((length, rank, start, capacity - room + t * length))
                    rank += n
                left -= n * times
                used += n
                if rest := room - times * length:
                    _give(free, rooms, rest, start, n)
            if used < count:
                _give(free, rooms, room, first + used, count - used)
    return np.array(sorted(entries), dtype=np.int64).reshape(-1, 4), opened


def _give(free: dict, rooms: list[int], room: int, first: int, count: int) -> None:
    if room not in free:
        free[room] = []
        bisect.insort(rooms, room)
    free[room].append((first, count))


def _place(plan) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        chunk_ids.cache_clear()  # the texts are tokenised; the worker lives on and serves other stages
        entries = plan.value
        keys = (entries[:, 0] << 44) | entries[:, 1]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            e = entries[np.searchsorted(keys, (length << 44) | rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(e[:, 2] + rank - e[:, 1]), pa.array(e[:, 3])], names=names)

    return run


def pack_best_fit(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", known_chunks: int = 900_000) -> DataFrame:
    """Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. capacity is below 2**18.

    known_chunks: chunks a worker remembers in each of two generations; fewer need less memory and more time, the result is the same.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:  # a vocabulary file of fixed size, read on the driver and broadcast
        tokenizer = spark.sparkContext.broadcast(f.read())
    given = docs.select(F.col(quoted(id_col)), F.col(quoted(text_col)).cast("string"))
    kind = given.schema[0].dataType.simpleString()
    pieces = materialise(given.mapInArrow(released(_tokenise(tokenizer, capacity, known_chunks)), f"doc_id {kind}, {_PIECES}"))
    parts = materialise(pieces.groupBy("length", "part").agg(F.count("*").alias("n")))
    histogram = {r[0]: r[1] for r in parts.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    plan = spark.sparkContext.broadcast(plan_best_fit(histogram, capacity)[0])
    offsets = parts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = pieces.join(offsets.hint("merge"), ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local_rank")).alias("rank"))
    return ranked.mapInArrow(released(_place(plan)), f"doc_id {kind}, {_PLACED}")
