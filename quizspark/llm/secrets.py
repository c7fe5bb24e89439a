"""Secret scans: three formats, and sliding-window Shannon entropy per character class over candidate strings.

Formats (base spans): assignments to a secret's name, access key ids, long runs of lower-case hex digits.
Entropy (added spans): a candidate is a run of 20 or more characters of a key alphabet that has a letter and a digit. Candidates
are sought in the text with the base spans blanked out, so base spans always stay and none overlaps one. Over a candidate's
characters a window of WINDOW slides. It carries the count of each character; the one that leaves and the one that enters
change two counts and so the sum of c * log2(c) over the counts c, nothing is counted again. Windows over the threshold of the
candidate's class (hex digits; letters of one case and digits; of both; with other characters) make a span, from the first such
window to the last. An allow list suppresses candidates (identifiers, checksums named as such) and spans whose value, what
follows the last equals sign inside, holds a placeholder.

All of it is Column expressions in one projection of the scan: no shuffle, no Python. Null texts count as empty; empty tables give
empty results; rows are independent, so ties, repeated rows and ids of any type (or none) need no rule. The time is linear in the
text, however long, see spans.py. redact_secrets keeps all columns, whatever they are called.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .common import quoted, unused

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}+"
WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
#: Character classes, the first that fits counts, and their thresholds in bits a character of a window of WINDOW. Random windows have
#: about 3.4 (hex digits), 3.8 (letters of one case and digits) and 4.1 bits (of both cases); words have less than 3.5.
CLASSES = ((r"^[0-9a-fA-F]+$", 2.9), (r"^(?:[0-9a-z]+|[0-9A-Z]+)$", 3.65), (r"^[0-9A-Za-z]+$", 3.75), ("", 3.75))
#: Marks of a span that is no secret.
PLACEHOLDER = r"(?i)(?:example|placeholder|changeme|your[-_]|xxxx|0{8}|1234567)[^=]*=*$"
#: Candidates that are no secrets.
ALLOWED = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^[a-z]++(?:[-_/][a-z]++){2,}+[-_/]?[0-9]{0,4}$",
    r"^[0-9+/=_-]+$",
)
#: What stands right before candidates that are no secrets.
ALLOWED_BEFORE = r"(?i)(commit|revision|checksum|integrity|md5|sha-?[0-9]{1,3}|uuid)[-\s:=/\"']*$"


def base_spans(text: Column) -> Column:
    found = S.matches(text, ((ASSIGN, 0, None), (ACCESS, 1, text.contains("AKIA")), (HEX, 2, None)))
    return F.filter(found, lambda s: (s["kind"] != 0) | (F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 8))


def threshold(value: Column) -> Column:
    """Bits a character from which a window of the value is suspect."""
    out = F.lit(CLASSES[-1][1])
    for pattern, bits in reversed(CLASSES[:-1]):
        out = F.when(F.rlike(value, F.lit(pattern)), bits).otherwise(out)
    return out


def _entropy_range(value: Column) -> Column:
    """struct(first, last): begin of the first and end of the last window over the threshold; first is null if there is none."""
    most = WINDOW * (math.log2(WINDOW) - threshold(value))
    letters = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return S.let(F.struct(letters.alias("letters"), most.alias("most")), lambda v: _slide(v["letters"], v["most"]))


def _slide(letters: Column, most: Column) -> Column:
    """letters: the place of each character in the alphabet."""
    gain = F.array(*[F.lit((c + 1) * math.log2(c + 1) - (c * math.log2(c) if c else 0.0)) for c in range(WINDOW + 1)])
    start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"), F.lit(0.0).alias("sum"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    def step(acc: Column, i: Column) -> Column:
        moved = F.struct(F.get(letters, i).alias("enters"), F.when(i >= WINDOW, F.get(letters, i - WINDOW)).otherwise(-1).alias("leaves"))
        return S.let(moved, lambda m: slid(acc, i, m["enters"], m["leaves"]))

    def slid(acc: Column, i: Column, enters: Column, leaves: Column) -> Column:
        without = F.when(leaves >= 0, acc["sum"] - F.get(gain, F.get(acc["counts"], leaves) - 1)).otherwise(acc["sum"])
        seen = F.get(acc["counts"], enters) - (enters == leaves).cast("int")
        counts = F.when(enters == leaves, acc["counts"]).otherwise(F.transform(acc["counts"], lambda c, k: F.when(k == enters, c + 1).when(k == leaves, c - 1).otherwise(c)))
        return S.let(
            without + F.get(gain, seen),
            lambda t: F.struct(
                counts.alias("counts"),
                t.alias("sum"),
                F.when(acc["first"].isNull() & (i >= WINDOW - 1) & (t <= most + 1e-9), i - (WINDOW - 1)).otherwise(acc["first"]).alias("first"),
                F.when((i >= WINDOW - 1) & (t <= most + 1e-9), i + 1).otherwise(acc["last"]).alias("last"),
            ),
        )

    return F.aggregate(F.sequence(F.lit(0), F.size(letters) - 1), start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def entropy_spans(text: Column, base: Column) -> Column:
    found = S.matches(S.blank(text, base), ((CANDIDATE, 3, None),))

    def hot_value(h: Column) -> Column:
        return F.substring(h["s"]["value"], h["r"]["first"] + 1, h["r"]["last"] - h["r"]["first"])

    def among(v: Column) -> Column:
        def suspect(s: Column) -> Column:
            out = F.rlike(s["value"], F.lit("[0-9]")) & F.rlike(s["value"], F.lit("[A-Za-z]"))
            for rule in ALLOWED:
                out = out & ~F.rlike(s["value"], F.lit(rule))
            return out & ~F.rlike(S.piece(v["chunks"], s["start"] - 24, s["start"]), F.lit(ALLOWED_BEFORE))

        hot = F.transform(F.filter(v["found"], suspect), lambda s: F.struct(s.alias("s"), _entropy_range(s["value"]).alias("r")))
        return F.transform(
            F.filter(hot, lambda h: h["r"]["first"].isNotNull() & ~F.rlike(hot_value(h), F.lit(PLACEHOLDER))),
            lambda h: F.struct((h["s"]["start"] + h["r"]["first"]).alias("start"), F.lit(3).alias("kind"), (h["s"]["start"] + h["r"]["last"]).alias("end"), hot_value(h).alias("value")),
        )

    return S.let(found, lambda f: F.when(F.size(f) > 0, S.let(F.struct(f.alias("found"), S.chunks(text).alias("chunks")), among)).otherwise(S.none()))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns the id, the text (null: empty), base and added spans for every row."""
    given = docs.select(F.col(quoted(id_col)), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text"))
    based = given.withColumn("base", base_spans(F.col("text")))
    return based.withColumn("added", entropy_spans(F.col("text"), F.col("base")))


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with all spans of the text replaced; other columns stay, n_chars (if there) follows the text."""
    given, base, found = (unused(docs.columns, name) for name in ("given", "base", "found"))
    text = F.coalesce(F.col(given), F.lit(""))
    out = docs.withColumn(given, F.col(quoted(text_col)).cast("string")).withColumn(base, base_spans(text))
    out = out.withColumn(found, F.concat(base, entropy_spans(text, F.col(base))))
    out = out.withColumn(text_col, F.when(F.size(found) > 0, S.replace(text, F.col(found), lambda s: F.lit(mark))).otherwise(F.col(given)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(found) > 0, F.length(quoted(text_col)).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*map(quoted, docs.columns))
