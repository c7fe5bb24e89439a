"""Spans of a text as Column expressions: array<struct<start, kind, end, value>>, code points, end exclusive.

Time is linear in the text and nearly so in the number of spans: places come from running sums over arrays (in two levels, so no
fold copies a long array at each step), and pieces of a text from its chunks, not by walking to them from its beginning.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
CHUNK = 1024
_STEP = 64


def none() -> Column:
    return F.array().cast(SPAN)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, also where body uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _until(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def running(x: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each place of an array of ints >= 0: op over all places before it, from 0. op: addition or maximum.

    Blocks of _STEP places are summed up first; then each place of a block starts from what the blocks before it give.
    """

    def fold(places: Column, value: Callable[[Column], Column], start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(places, first, lambda acc, i: F.struct(op(acc["at"], value(i)).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])

    def within(n: Column, b: Column) -> Column:
        return F.sequence(b * _STEP, F.least(b * _STEP + (_STEP - 1), n - 1))

    def blocks(x: Column) -> Column:
        n = F.size(x)
        every = _until(F.ceil(n / _STEP).cast("int"))
        sums = F.transform(every, lambda b: F.aggregate(within(n, b), F.lit(0), lambda s, i: op(s, F.get(x, i))))
        starts = let(sums, lambda s: fold(_until(F.size(s)), lambda b: F.get(s, b), F.lit(0)))
        return let(starts, lambda s: F.flatten(F.transform(every, lambda b: fold(within(n, b), lambda i: F.get(x, i), F.get(s, b)))))

    return let(x, lambda x: F.when(F.size(x) > _STEP, blocks(x)).otherwise(fold(_until(F.size(x)), lambda i: F.get(x, i), F.lit(0))))


def matches(text: Column, patterns: Sequence[tuple[str, int, Column | None]]) -> Column:
    """Leftmost non-overlapping matches of each (pattern, kind, hint); a pattern never matches the empty string.

    Matches and the pieces between them alternate, so running sums of their lengths place them. hint: a cheap condition
    without which there is no match.
    """

    def cut(pattern: str, kind: int, hint: Column | None) -> Column:
        there = F.rlike(text, F.lit(pattern)) if hint is None else hint & F.rlike(text, F.lit(pattern))
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.when(there, F.struct(F.lit(kind).alias("kind"), F.split(text, pattern, -1).alias("p"), found.alias("m")))

    def placed(c: Column) -> Column:
        between = F.slice(c["p"], 1, F.size(c["m"]))
        before = running(F.zip_with(between, c["m"], lambda a, b: F.length(a) + F.length(b)), lambda a, b: a + b)

        def span(z: Column) -> Column:
            start = z["at"] + F.length(z["p"])
            return F.struct(start.alias("start"), c["kind"].alias("kind"), (start + F.length(z["m"])).alias("end"), z["m"].alias("value"))

        return F.transform(F.arrays_zip(before.alias("at"), between.alias("p"), c["m"].alias("m")), span)

    cuts = F.filter(F.array(*(cut(*each) for each in patterns)), lambda c: c.isNotNull())
    return F.flatten(F.transform(cuts, placed)).cast(SPAN)


def render(spans: Column, kinds: Sequence[str]) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def chunks(text: Column) -> Column:
    """The text in chunks of CHUNK code points, for piece()."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))


def piece(chunks: Column, begin: Column, end: Column) -> Column:
    """Code points begin to end (exclusive) of a text given as its chunks; places outside the text hold nothing."""
    def part(c: Column) -> Column:
        at = F.greatest(begin - c * CHUNK, F.lit(0))
        return F.substring(F.coalesce(F.get(chunks, c), F.lit("")), at + 1, F.least(end - c * CHUNK, F.lit(CHUNK)) - at)

    low, high = F.floor(F.greatest(begin, F.lit(0)) / CHUNK).cast("int"), F.floor((end - 1) / CHUNK).cast("int")
    return F.when(end > F.greatest(begin, F.lit(0)), F.array_join(F.transform(F.sequence(low, F.greatest(low, high)), part), "")).otherwise("")


def _rewritten(text: Column, spans: Column, put: Callable[[Column, Column], Column]) -> Column:
    """text with each span, by start, replaced by put(span, end of all spans before it)."""

    def of(v: Column) -> Column:
        at = running(F.transform(v["spans"], lambda s: s["end"]), F.greatest)

        def all_pieces(at: Column) -> Column:
            out = F.transform(v["spans"], lambda s, i: F.concat(piece(v["chunks"], F.get(at, i), s["start"]), put(s, F.get(at, i))))
            last = F.array_max(F.transform(v["spans"], lambda s: s["end"]))
            return F.concat(F.array_join(out, ""), piece(v["chunks"], last, F.length(text)))

        return let(at, all_pieces)

    given = F.struct(F.array_sort(spans).alias("spans"), chunks(text).alias("chunks"))
    return F.when(F.size(spans) > 0, let(given, of)).otherwise(text)


def blank(text: Column, spans: Column, mark: str = "\x00") -> Column:
    """text with every character of the spans replaced by the mark, so all others keep their places."""
    return _rewritten(text, spans, lambda s, at: F.repeat(F.lit(mark), s["end"] - F.greatest(at, s["start"])))


def replace(text: Column, spans: Column, mark: Callable[[Column], Column]) -> Column:
    """text with each span replaced; a span that begins inside an earlier one extends it without a second mark."""
    return _rewritten(text, spans, lambda s, at: F.when(s["start"] >= at, mark(s)).otherwise(""))


def apart(ranked: Column) -> Column:
    """Of spans, best first, those that overlap no better one that is kept.

    Spans are cut into clusters that don't overlap each other (by start, where a start is at or after all ends before it); a
    cluster is settled alone, so the work grows with the largest cluster and not with the text.
    """
    by_start = F.array_sort(F.transform(ranked, lambda s, i: F.struct(s["start"].alias("start"), i.alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))

    def settle(v: Column) -> Column:
        ends = running(F.transform(v, lambda s: s["end"]), F.greatest)
        first = let(ends, lambda e: F.filter(_until(F.size(v)), lambda i: F.get(v, i)["start"] >= F.get(e, i)))

        def clusters(f: Column) -> Column:
            bounds = F.transform(f, lambda lo, k: F.struct(lo.alias("lo"), F.coalesce(F.get(f, k + 1), F.size(v)).alias("hi")))
            return F.flatten(F.transform(bounds, lambda b: best(F.transform(F.sequence(b["lo"], b["hi"] - 1), lambda i: F.get(v, i)))))

        return let(first, clusters)

    def best(cluster: Column) -> Column:
        ordered = F.array_sort(F.transform(cluster, lambda s: F.struct(s["rank"].alias("rank"), s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"))))

        def take(kept: Column, s: Column) -> Column:
            span = F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"))
            return F.when(F.exists(kept, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])), kept).otherwise(F.array_append(kept, span))

        return F.aggregate(ordered, none(), take)

    return F.when(F.size(ranked) > 0, let(by_start, settle)).otherwise(none())
