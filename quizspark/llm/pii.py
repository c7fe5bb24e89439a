"""Personal data: four validated formats, and boosted trees over the spans that high-recall generators propose.

Formats (base spans): email, ip, card (Luhn) and phone with a plus sign. They always stay.
Method (added spans): generators propose overlapping candidates: grouped digits, spelled-out addresses, account numbers,
colon-separated hex, and inside longer runs of digits the groups shaped like a phone, a card or a social security number.
They read the text with the base spans blanked out, so what stands next to one is still proposed and none overlaps one.
Each has format features (lengths, digits, groups, separators, checksums) and context features (words before it, what
touches it). Boosted trees score them, a calibrated threshold selects; from the best scored down, a candidate stays if it
overlaps none that stays.

The trees are fitted on a fixed set of made-up examples (examples(): true formats and look-alikes such as dates, prices,
versions, part numbers, in and out of context; neighbours(): true formats next to other digits), half of it for calibration;
the rows' features come from the same Column expressions that score documents, so both agree by construction. The model
doesn't depend on the corpus.

All of it is Column expressions in one projection of the scan: no shuffle, no Python on rows. Null texts count as empty; empty
tables give empty results; rows are independent, so ties between rows, repeated rows and ids of any type (or none) need no rule.
Of candidates with equal scores the earlier, then the longer one comes first. The time is nearly linear in the text, however
long, see spans.py. redact_pii keeps all columns, whatever they are called.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from . import spans as S
from .common import quoted, unused

KINDS = ("email", "ip", "card", "phone", "contact")
# Possessive groups never backtrack, and a run is tried from its first character only: same matches, in linear time.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CARD_HINT = r"[0-9](?:[\x20-]?[0-9]){11}"

#: High-recall generators.
GENERATORS = (
    r"[(+]?[0-9](?:[\x20().\-/]{0,2}[0-9]){5,}+",
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,}+(?:\x20?[\[(]at[\])]\x20?|\x20at\x20|\x20@\x20)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]++)++",
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){10,30}+",
    r"(?<![0-9A-Za-z])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){5,7}+",
    r"(?<![0-9])(?:[(][0-9]{3}[)][\x20.-]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])",
    r"(?<![0-9])[0-9]{4}(?:[\x20-][0-9]{4}){3}(?![0-9])",
    *(rf"\+[0-9]++(?:[\x20().-]{{1,3}}+[0-9]++){{{k}}}" for k in range(6)),
)
#: From here on generators find shapes inside runs; from PLUS on, a plus sign, k more groups and a phone's number of digits.
SHAPES, PLUS = 4, 7
#: Words before a candidate that speak for personal data, and against it.
FOR = r"(?i)\b(?:phone|call|tel|telephone|mobile|cell|fax|contact|reach|ssn|social security|passport|iban|account|card|visa|mail|email|e-mail|address|host|mac|whatsapp)\b[^.!?\n]{0,12}$"
AGAINST = r"(?i)\b(?:order|item|isbn|version|v|invoice|part|serial|model|page|pages|on|since|in|price|cost|total|population|ratio|score|id|ticket|ref|build|release|year|room|at about)\b[^.!?\n]{0,12}$"


def base_spans(text: Column) -> Column:
    found = S.matches(text, ((EMAIL, 0, text.contains("@")), (IP, 1, None), (CARD, 2, F.rlike(text, F.lit(CARD_HINT))), (PHONE, 3, text.contains("+"))))

    def valid(s: Column) -> Column:
        ip = F.when(s["kind"] == 1, F.forall(F.split(s["value"], r"\."), _at_most_255))
        card = ip.when(s["kind"] == 2, digits(s["value"], 12, 19) & luhn(s["value"]))
        return card.when(s["kind"] == 3, digits(s["value"], 9, 15)).otherwise(True)

    return F.filter(found, valid)


def _at_most_255(part: Column) -> Column:
    kept = F.regexp_replace(part, "^0+", "")
    return F.when(F.length(kept) > 3, False).otherwise(F.concat(F.lit("0"), kept).cast("int") <= 255)


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def digits(value: Column, least: int, most: int) -> Column:
    return F.length(only_digits(value)).between(least, most)


def luhn(value: Column) -> Column:
    """Whether the digits pass: from the right, every second one doubled, its digits summed."""
    drawn = F.reverse(F.split(only_digits(value), ""))
    doubled = F.transform(drawn, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, 2 * d.cast("int") - 9).otherwise(2 * d.cast("int"))))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def features(chunks: Column, span: Column) -> Column:
    """chunks: of the text the span stands in."""
    return S.let(F.struct(span.alias("s"), S.piece(chunks, span["start"] - 40, span["start"]).alias("before"), S.piece(chunks, span["end"], span["end"] + 1).alias("after")), lambda v: _features(v["s"], v["before"], v["after"]))


def _features(span: Column, before: Column, after: Column) -> Column:
    value = span["value"]
    groups = F.filter(F.split(value, "[^0-9]+"), lambda g: g != "")
    size = F.length(value)
    number = F.length(only_digits(value))

    def flag(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False)).cast("int")

    named = {
        "generator": F.least(span["kind"], F.lit(PLUS)),
        "length": size,
        "digits": number,
        "letters": F.length(F.regexp_replace(value, "[^A-Za-z]", "")),
        "groups": F.size(groups),
        "first_group": F.coalesce(F.length(F.get(groups, F.lit(0))), F.lit(0)),
        "last_group": F.coalesce(F.length(F.get(groups, F.size(groups) - 1)), F.lit(0)),
        "dots": size - F.length(F.replace(value, F.lit("."), F.lit(""))),
        "slashes": size - F.length(F.replace(value, F.lit("/"), F.lit(""))),
        "hyphens": size - F.length(F.replace(value, F.lit("-"), F.lit(""))),
        "plus": flag(value.startswith("+")),
        "brackets": size - F.length(F.replace(value, F.lit("("), F.lit(""))),
        "dated": flag(F.rlike(value, F.lit(r"^(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|^[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2}"))),
        "luhn": flag(number.between(12, 19) & luhn(value)),
        "word_before": flag(F.rlike(before, F.lit(FOR))),
        "word_against": flag(F.rlike(before, F.lit(AGAINST))),
        "glued": flag(F.rlike(before, F.lit(r"[A-Za-z0-9$€£#_.,:/-]$"))) + flag(F.rlike(after, F.lit("[A-Za-z0-9_%:/]"))),
    }
    return F.struct(*(c.cast("int").alias(n) for n, c in named.items()))


def candidates(text: Column) -> Column:
    """Proposed spans; kind is the generator's number."""
    digits_close = F.rlike(text, F.lit(r"[0-9][^0-9A-Za-z]{0,2}[0-9][^0-9A-Za-z]{0,2}[0-9]"))
    hint = (digits_close, F.rlike(text, F.lit(r"(?:\bat\b|\x20@\x20)")), F.rlike(text, F.lit("[A-Z]{2}[0-9]{2}")), F.rlike(text, F.lit("[0-9A-Fa-f]:[0-9A-Fa-f]")))
    shaped = F.rlike(text, F.lit(r"[0-9][)\x20.-]{1,2}[0-9]{2,4}[\x20.-][0-9]{4}"))
    hint += (*(shaped,) * (PLUS - SHAPES), *(F.rlike(text, F.lit(r"\+[0-9]")),) * (len(GENERATORS) - PLUS))
    found = S.matches(text, [(p, k, h) for k, (p, h) in enumerate(zip(GENERATORS, hint, strict=True))])
    return F.filter(found, lambda s: (s["kind"] < PLUS) | digits(s["value"], 9, 15))


def examples(seed: int = 7, each: int = 60) -> list[tuple[str, int]]:
    """Made-up sentences with one candidate, and whether it is personal data."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    w = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(3, 8)))
    h = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    yes = (
        lambda: f"({d(3)}) {d(3)}-{d(4)}",
        lambda: f"{r.randint(2, 9)}{d(2)}-{d(3)}-{d(4)}",
        lambda: f"{r.randint(2, 9)}{d(2)}.{d(3)}.{d(4)}",
        lambda: f"{d(3)}-{d(2)}-{d(4)}",
        lambda: f"{w()}.{w()} at {w()} dot com",
        lambda: f"{w()} [at] {w()} [dot] {r.choice(('com', 'org', 'net'))}",
        lambda: f"{w()}{d(2)} @ {w()}.com",
        lambda: f"{r.choice(('DE', 'FR', 'GB', 'ES'))}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)}",
        lambda: f"{r.choice(('DE', 'NL', 'IT'))}{d(20)}",
        lambda: ":".join(h(2) for _ in range(6)),
        lambda: ":".join(h(4) for _ in range(8)),
    )
    no = (
        lambda: f"20{d(2)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
        lambda: f"{r.randint(1, 28)}/{r.randint(1, 12)}/19{d(2)}",
        lambda: f"{d(6)}",
        lambda: f"{d(r.randint(7, 20))}",
        lambda: f"{r.randint(1, 9)}.{d(2)}.{d(2)}.{d(3)}",
        lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}",
        lambda: f"{d(3)} {d(3)}",
        lambda: f"{d(16)} {d(16)}",
        lambda: d(r.randint(20, 60)),
        lambda: f"19{d(2)}-20{d(2)}",
        lambda: f"{d(2)} {d(2)} {d(2)} {d(2)}",
        lambda: f"{w()} at {w()}.{w().capitalize()}",
        lambda: f"{r.choice(('AB', 'XK', 'PN'))}{d(2)}{d(12)}",
        lambda: ":".join(d(2) for _ in range(6)),
    )
    pro = ("call me on ", "phone ", "tel: ", "contact ", "my mobile is ", "iban ", "account ", "email ", "address ", "ssn ", "")
    con = ("order ", "version ", "page ", "on ", "isbn ", "part ", "total ", "since ", "id ", "", "was ", "of ")
    out = [(f"{w()} {w()} {r.choice(pro)}{make()} {w()} {w()}.", 1) for make in yes for _ in range(each)]
    out += [(f"{w()} {w()} {r.choice(con)}{make()} {w()} {w()}.", 0) for make in no for _ in range(each)]
    out += [(f"{w()} {r.choice(con[:9])}{r.choice(no)()}{w()} {w()}", 0) for _ in range(each)]
    r.shuffle(out)
    return out


def neighbours(seed: int = 11, each: int = 60) -> list[tuple[str, str]]:
    """Made-up sentences with personal data right next to other digits, and the personal data (or none): all else is none."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    w = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(3, 8)))
    yes = (
        lambda: f"+1 ({d(3)}) {d(3)}-{d(4)}",
        lambda: f"+{r.randint(20, 99)} {d(2)} {d(r.randint(6, 8))}",
        lambda: f"+{r.randint(200, 999)}-{d(3)}-{d(3)}-{d(3)}",
        lambda: f"+{r.randint(20, 99)}{d(10)}",
        lambda: f"({d(3)}) {d(3)}-{d(4)}",
        lambda: f"{r.randint(2, 9)}{d(2)}-{d(3)}-{d(4)}",
        lambda: f"{d(3)}-{d(2)}-{d(4)}",
        lambda: _card(f"{r.randint(3, 5)}{d(14)}"),
    )
    other = (
        lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        lambda: f"20{d(2)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
        lambda: f"{r.randint(1, 28)}/{r.randint(1, 12)}/19{d(2)}",
        lambda: d(r.randint(8, 12)),
    )
    pro = ("call me on ", "phone ", "tel: ", "contact ", "ssn ", "card ", "", "")
    con = ("order ", "total ", "values ", "", "was ", "of ")
    out = []
    for make in yes:
        for i in range(each):
            value, more = make(), r.choice(other)()
            out.append((f"{w()} {w()} {r.choice(pro)}{value} {more} {w()}." if i % 3 else f"{w()} {w()} {more} {value} {w()}.", value))
    for _ in range(4 * each):
        out.append((f"{w()} {w()} {r.choice(con)}{' '.join(d(r.randint(2, 5)) for _ in range(r.randint(4, 9)))} {w()}.", ""))
        out.append((f"{w()} {w()} {r.choice(con)}{d(2)} {d(3)} {d(3)} {d(4)} {d(3)} {w()}.", ""))
    r.shuffle(out)
    return out


def _card(head: str) -> str:
    """The digits and the last one that makes them pass, in groups of four."""
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(head)))
    whole = f"{head}{-total % 10}"
    return " ".join(whole[i : i + 4] for i in range(0, 16, 4))


_FITTED: list[boosting.Boosted] = []


def fit(spark: SparkSession) -> boosting.Boosted:
    """The model of the fixed examples (about 2,500 rows). It is the same each time, so a process fits it once."""
    if not _FITTED:
        made = [(t, y, None) for t, y in examples()] + [(t, 1, v) for t, v in neighbours()]
        rows = spark.createDataFrame([(i, *e) for i, e in enumerate(made)], "i int, text string, label int, private string").withColumn("base", base_spans(F.col("text")))
        spans = rows.select("i", "label", "text", "private", F.explode(S.let(S.blank(F.col("text"), F.col("base")), candidates)).alias("s"))
        spans = spans.withColumn("label", F.when(F.col("private").isNull(), F.col("label")).otherwise((F.col("s.value") == F.col("private")).cast("int")))
        found = spans.select("i", "label", features(S.chunks(F.col("text")), F.col("s")).alias("f")).orderBy("i", "f").collect()
        each = [(r["f"].asDict(), r["label"]) for r in found]
        model = boosting.fit([f for f, _ in each[::2]], [y for _, y in each[::2]])
        _FITTED.append(boosting.calibrated(model, [f for f, _ in each[1::2]], [y for _, y in each[1::2]], precision=0.98))
    return _FITTED[0]


def added_spans(text: Column, base: Column, model: boosting.Boosted) -> Column:
    def among(v: Column) -> Column:
        scored = F.transform(v["found"], lambda s: F.struct(S.let(features(v["chunks"], s), model.probability).alias("p"), s.alias("s")))
        likely = F.filter(scored, lambda c: c["p"] >= model.threshold)
        ranked = F.array_sort(F.transform(likely, lambda c: F.struct((-c["p"]).alias("p"), c["s"]["start"].alias("start"), (-c["s"]["end"]).alias("back"), c["s"]["kind"].alias("by"), c["s"]["value"].alias("value"))))
        spans = F.transform(ranked, lambda c: F.struct(c["start"].alias("start"), F.lit(4).alias("kind"), (-c["back"]).alias("end"), c["value"].alias("value")))
        return S.let(spans, S.apart)

    found = S.let(S.blank(text, base), candidates)
    return S.let(found, lambda f: F.when(F.size(f) > 0, S.let(F.struct(f.alias("found"), S.chunks(text).alias("chunks")), among)).otherwise(S.none()))


def scan_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns the id, the text (null: empty), base and added spans for every row."""
    model = fit(docs.sparkSession)
    given = docs.select(F.col(quoted(id_col)), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text"))
    based = given.withColumn("base", base_spans(F.col("text")))
    return based.withColumn("added", added_spans(F.col("text"), F.col("base"), model))


def redact_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets; other columns stay."""
    model, names = fit(docs.sparkSession), F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    given, base, found = (unused(docs.columns, name) for name in ("given", "base", "found"))
    text = F.coalesce(F.col(given), F.lit(""))
    out = docs.withColumn(given, F.col(quoted(text_col)).cast("string")).withColumn(base, base_spans(text))
    out = out.withColumn(found, F.concat(base, added_spans(text, F.col(base), model)))
    new = S.replace(text, F.col(found), lambda s: F.get(names, s["kind"]))
    return out.withColumn(text_col, F.when(F.size(found) > 0, new).otherwise(F.col(given))).select(*map(quoted, docs.columns))
