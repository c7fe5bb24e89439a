"""The pages that share most terms with each question, exactly, without a row per shared term.

Pages are dealt into blocks by a hash of their id. The pages of a batch are packed where they are read, a row for each block, and a block
is put together from these: the sorted places of each of its terms. Questions are packed into blocks too. Both are written once to the
shared folder, and every pair of blocks meets in a product that reads them from there, so what is moved and kept grows with the input
only; the work grows with the number of pairs of blocks. There, a frequent term is a row of flags, a bit a page. The rows of a question's
terms are added bit by bit, 64 pages at a time, and the digits of these sums lead to the largest. The few pages of its rare terms are
counted one by one. Only the best pages of a question leave a task.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise

# A term that more than one page in so many holds has a row of flags; questions that are counted together, with at most so
# many words of flags and places.
FREQUENT, TOGETHER, AT_ONCE = 256, 64, 1 << 18


def best_pages(questions: DataFrame, pages: DataFrame, hits: int, question_block: int = 32768, page_block: int = 16384) -> DataFrame:
    """(q_id, page_id, shared, n, size): for each question at least its `hits` pages of most shared terms, ties to the smaller id.

    questions: (q_id, terms), pages: (page_id, terms) and any size, a number that is passed on. n: the question's number of terms. Rows
    of one id add up. Every task gives its best, so there can be more rows than `hits`, and they need one more ranking.
    """
    sized = pages if "size" in pages.columns else pages.withColumn("size", F.lit(0))
    page, question = dict(pages.dtypes)["page_id"], dict(questions.dtypes)["q_id"]
    blocks = lambda df, n: F.lit(max(1, -(-df.count() // n)))
    block = lambda df, name, n: F.pmod(F.xxhash64(name), blocks(df, n)).cast("int")
    dealt = sized.select(block(pages, "page_id", page_block).alias("j"), "page_id", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"), F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    kind = f"j int, ids array<{page}>, words array<string>, places binary, sizes array<long>"
    packed = dealt.mapInArrow(_pack, kind).groupBy("j").applyInArrow(_merge, kind)
    asked = questions.where(F.size("terms") > 0).select(block(questions, "q_id", question_block).alias("i"), "q_id", "terms")
    posed = asked.groupBy("i").applyInArrow(_pose, f"i int, q_ids array<{question}>, ns array<int>, asked array<string>, codes binary")
    left, right = materialise(packed, 8192, 1), materialise(posed, 8192, 1)
    pairs = left.hint("shuffle_replicate_nl").crossJoin(right)
    return pairs.mapInArrow(_meet(hits), f"q_id {question}, page_id {page}, shared long, n int, size long")


def _strings(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct strings, a number for each string of the lists, and the lists' lengths."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), lengths


def _first(value: object) -> tuple:
    """Ids in order, null before all others."""
    return value is not None, value


def _block(j: int, ids: list, words: pa.Array, codes: np.ndarray, places: np.ndarray, sizes: np.ndarray, schema: tuple[pa.DataType, ...]) -> dict[str, pa.Array]:
    """One row from the place of each word's page. places: the number of places of each word, then these, each as its difference to the one before."""
    n = np.bincount(codes, minlength=len(words)).astype(np.int32)
    pairs = codes.astype(np.int64)
    pairs *= max(1, len(ids))
    pairs += places
    pairs.sort()
    pairs %= max(1, len(ids))
    at = pairs.astype(np.int32)
    del pairs
    return {
        "j": pa.array([j], pa.int32()),
        "ids": pa.array([ids], pa.list_(schema[0])),
        "words": pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string())),
        "places": pa.array([zlib.compress(n.tobytes() + np.diff(at, prepend=np.int32(0)).tobytes(), 1)], pa.binary()),
        "sizes": pa.array([sizes.tolist()], pa.list_(pa.int64())),
    }


def _unpacked(places: bytes, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of places of each word, and all places."""
    raw = np.frombuffer(zlib.decompress(places), np.int32)
    return raw[:n_words], np.cumsum(raw[n_words:], dtype=np.int32)


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block that the pages of a batch are dealt to."""
    for pages in batches:
        js = pages.column("j").to_numpy(zero_copy_only=False)
        order = np.argsort(js, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(js[order])) + 1):
            if len(rows):
                own = pages.take(pa.array(rows))
                values = own.column("page_id").to_pylist()
                ids = sorted(set(values), key=_first)
                place = {v: k for k, v in enumerate(ids)}
                at = np.array([place[v] for v in values], np.int32)
                words, codes, lengths = _strings(own.column("terms"))
                sizes = np.zeros(len(ids), np.int64)
                np.add.at(sizes, at, own.column("size").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_pydict(_block(int(js[rows[0]]), ids, words, codes, np.repeat(at, lengths), sizes, (own.column("page_id").type,)))


def _merge(key: tuple, parts: pa.Table) -> pa.Table:
    """One row from those of the batches."""
    values = parts.column("ids").to_pylist()
    ids = sorted({v for own in values for v in own}, key=_first)
    place = {v: k for k, v in enumerate(ids)}
    maps = [np.array([place[v] for v in own], np.int32) for own in values]
    words, codes, lengths = _strings(parts.column("words").combine_chunks())
    ends = np.cumsum(lengths, dtype=np.int64)
    coded, at, sizes = [np.array([], codes.dtype)], [np.array([], np.int32)], np.zeros(len(ids), np.int64)
    for k, m in enumerate(maps):
        held, places = _unpacked(parts.column("places")[k].as_py(), int(lengths[k]))
        coded.append(np.repeat(codes[ends[k] - lengths[k] : ends[k]], held))
        # Differences run through all words of a row, so their sums are the places.
        at.append(m[places] if len(places) else np.array([], np.int32))
        np.add.at(sizes, m, np.array(parts.column("sizes")[k].as_py(), np.int64))
    return pa.table(_block(key[0].as_py(), ids, words, np.concatenate(coded), np.concatenate(at), sizes, (parts.schema.field("ids").type.value_type,)))


def _pose(key: tuple, questions: pa.Table) -> pa.Table:
    """One row. codes: the number of terms of each question, then the terms as numbers of `asked`."""
    column = questions.column("q_id").combine_chunks()
    values = column.to_pylist()
    rows: dict = {}
    for k, v in enumerate(values):
        rows.setdefault(v, []).append(k)
    order = np.array([k for own in rows.values() for k in own], np.int64)
    terms = questions.column("terms").combine_chunks().take(pa.array(order))
    words, codes, lengths = _strings(terms)
    firsts = np.cumsum([0, *map(len, rows.values())])[:-1]
    return pa.table(
        {
            "i": pa.array([key[0].as_py()], pa.int32()),
            "q_ids": pa.array([list(rows)], pa.list_(column.type)),
            "ns": pa.array([lengths[firsts].tolist()], pa.list_(pa.int32())),
            "asked": pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string())),
            "codes": pa.array([zlib.compress(np.add.reduceat(lengths, firsts).astype(np.int32).tobytes() + codes.astype(np.int32).tobytes(), 1)], pa.binary()),
        }
    )


def _sums(rows: np.ndarray) -> list[np.ndarray]:
    """How many of the rows have each bit, in binary: the lowest digits of all bits, the next ones and so on."""
    digits = []
    while len(rows):
        carried = [rows[:0]]
        while len(rows) > 1:
            n = max(1, len(rows) // 3)
            a, b, c = rows[:n], rows[n : 2 * n], rows[2 * n : 3 * n]
            odd = a ^ b
            carried.append(a & b | odd & c if len(c) else a & b)
            rows = np.concatenate([odd ^ c, rows[3 * n :]]) if len(c) else odd
        digits.append(rows[0])
        rows = np.concatenate(carried)
    return digits


def _ones(words: np.ndarray) -> np.ndarray:
    """The bits set in each word; of signed numbers NumPy would count those of the absolute value."""
    return np.bitwise_count(words.view(np.uint64)).astype(np.int64)


def _most(digits: list[np.ndarray], hits: int) -> np.ndarray:
    """Flags of each question's `hits` bits of largest counts over 0, ties to the smaller; a few more of the last count may be set."""
    above, level = np.zeros_like(digits[0]), np.full_like(digits[0], -1)
    some = np.zeros(len(above), bool)
    for digit in reversed(digits):
        higher = level & digit
        enough = _ones(above | higher).sum(axis=1) >= hits
        some |= enough
        above = np.where(enough[:, None], above, above | higher)
        level = np.where(enough[:, None], higher, level & ~digit)
    held = _ones(level)
    room = hits - _ones(above).sum(axis=1)
    level[(np.cumsum(held, axis=1) - held >= room[:, None]) | ~some[:, None]] = 0
    return above | level


class Block:
    """A block of pages, made ready for some questions' words (numbers of its words)."""

    def __init__(self, n_pages: int, n_words: int, places: bytes, wanted: np.ndarray):
        self.n_pages = n_pages
        self.held, self.places = _unpacked(places, n_words)
        self.begins = np.cumsum(self.held, dtype=np.int64) - self.held
        self.held, self.row, self.rows = self.held.copy(), np.zeros(n_words, np.int64), np.zeros(n_words, np.int64)
        flags = []
        for w in wanted[self.held[wanted] * FREQUENT > n_pages]:
            self.row[w], left = len(flags), self.places[self.begins[w] : self.begins[w] + self.held[w]]
            # Where rows of an id add up, a page may hold a word twice: the second time has a row of its own, and so on.
            while len(left) * FREQUENT > n_pages and len(once := left[(new := np.append(True, left[1:] != left[:-1]))]) * FREQUENT > n_pages:
                own = np.zeros(-(-n_pages // 64) * 64, np.uint8)
                own[once] = 1
                flags.append(np.packbits(own, bitorder="little").view("<i8"))
                left = left[~new]
            self.rows[w], self.held[w] = len(flags) - self.row[w], len(left)
            self.places[self.begins[w] : self.begins[w] + len(left)] = left
        self.flags = np.stack([*flags, np.zeros(-(-n_pages // 64), np.int64)])  # the last row has none

    def best(self, words: np.ndarray, lengths: np.ndarray, hits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(question, place, count) of the pages that hold most of a question's words, ties to the smaller place. A page must hold one."""
        ends = np.cumsum(lengths)
        total = lambda n: np.diff(np.append(0, np.cumsum(n[words]))[np.append(0, ends)])
        n_rows, size = total(self.rows), self.flags.shape[1]
        cost = n_rows * size + total(self.held)
        rows = _ranges(self.row[words], self.rows[words])
        row_begins = np.cumsum(n_rows) - n_rows
        order, done = np.argsort(n_rows, kind="stable"), 0
        while done < len(order):
            # Questions of like numbers of rows go together; the last row fills up.
            own = order[done : done + TOGETHER]
            own = own[: max(1, AT_ONCE // max(1, int(cost[own].max())))]
            done += len(own)
            nth = np.arange(int(n_rows[own].max()))[:, None]
            filled = nth < n_rows[own]
            table = np.full(filled.shape, len(self.flags) - 1)
            table[filled] = rows[(nth + row_begins[own])[filled]]
            rare = words[_ranges((ends - lengths)[own], lengths[own])]
            yield self._together(own, table, rare, np.repeat(np.arange(len(own)), lengths[own]), hits)

    def _together(self, own: np.ndarray, table: np.ndarray, rare: np.ndarray, of: np.ndarray, hits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A page without places left of rare words is among the first by flags alone, or not among the best."""
        n, digits = self.n_pages, _sums(self.flags[table])
        found = np.repeat(of, self.held[rare]) * n + self.places[_ranges(self.begins[rare], self.held[rare])]
        first = np.array([], np.int64)
        if digits:
            q, at = np.nonzero(flags := _most(digits, hits))
            r, bit = np.nonzero(np.unpackbits(flags[q, at].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            first = q[r] * n + at[r] * 64 + bit
        both = np.sort(np.concatenate([found * 2 + 1, first * 2]))
        begins = np.flatnonzero(np.diff(both >> 1, prepend=-1))
        q, place = np.divmod(both[begins] >> 1, n)
        count = np.add.reduceat(both & 1, begins) if len(begins) else begins
        for k, digit in enumerate(digits):
            count = count + ((digit[q, place >> 6] >> (place & 63) & 1) << k)
        top = int(count.max(initial=0)) + 1
        ranked = np.sort((q * top + top - 1 - count) * n + place)
        q, place = np.divmod(ranked, n)
        q, less = np.divmod(q, top)
        firsts = np.searchsorted(q, q)
        keep = np.arange(len(q)) - firsts < hits
        return own[q[keep]], place[keep], (top - 1 - less)[keep]


def _ranges(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each beginning on, as many as its length."""
    return np.repeat(begins - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


def _meet(hits: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows hold a block of pages and one of questions each. What a task knows of a block of questions is ranked again after each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[pa.Array, pa.Array, pa.Table]] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                i, row = batch.column("i")[k].as_py(), batch.slice(k, 1)
                new = _found(row, hits)
                if i not in known:
                    known[i] = row.column("q_ids").flatten(), row.column("ns").flatten(), new
                else:
                    known[i] = *known[i][:2], _ranked(pa.concat_tables([known[i][2], new]), hits)
        for q_ids, ns, best in known.values():
            rows = best.column("row")
            yield from pa.table({"q_id": q_ids.take(rows), "page_id": best.column("page_id"), "shared": best.column("shared"), "n": ns.take(rows), "size": best.column("size")}).to_batches()

    return run


def _found(row: pa.RecordBatch, hits: int) -> pa.Table:
    """(row, page_id, shared, size) of one pair of blocks; row: the question's place in its block."""
    asked, found, shared = [], [], []
    ids, words, terms, sizes = (row.column(c).flatten() for c in ("ids", "words", "asked", "sizes"))
    lengths, codes = np.split(np.frombuffer(zlib.decompress(row.column("codes")[0].as_py()), np.int32), [len(row.column("q_ids")[0])])
    numbers = pc.fill_null(pc.index_in(terms, value_set=words), -1).to_numpy(zero_copy_only=False)
    block = Block(len(ids), len(words), row.column("places")[0].as_py(), np.unique(numbers[numbers >= 0]))
    own, held = numbers[codes], np.repeat(np.arange(len(lengths)), lengths)[numbers[codes] >= 0]
    for q, places, n in block.best(own[own >= 0], np.bincount(held, minlength=len(lengths)), hits):
        asked.append(q)
        found.append(places)
        shared.append(n)
    joined = lambda parts: pa.array(np.concatenate(parts).astype(np.int64) if parts else np.array([], np.int64))
    at = joined(found)
    return pa.table({"row": joined(asked), "page_id": ids.take(at), "shared": joined(shared), "size": sizes.take(at)})


def _ranked(found: pa.Table, hits: int) -> pa.Table:
    """The first `hits` rows of each question, in order."""
    smallest = pc.rank(found.column("page_id").combine_chunks(), null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False)
    row, shared = (found.column(c).to_numpy() for c in ("row", "shared"))
    order = np.lexsort((smallest, -shared, row))
    begins = np.flatnonzero(np.diff(row[order], prepend=-1))
    nth = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
    return found.take(pa.array(order[nth < hits]))
