"""Items as text, JSON, CSV, flash cards and quiz-import lines: a row per item, written by Spark's own writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.questions import LETTERS

CSV_COLUMNS = ("#", "Question", "A", "B", "C", "D", "Answer", "Answer Text", "Explanation", "Type", "Difficulty", "Score")
ANKI_HEADER = ("#separator:Tab", "#html:true", "#notetype:Basic")


def _option(letter: str) -> Column:
    return F.coalesce(F.col("options")[letter], F.lit(""))


def _title(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, F.lit(2), F.length(c))))


def text_rows(items: DataFrame) -> DataFrame:
    mark = lambda x: F.when(F.col("answer") == x, "  ✓").otherwise("")
    head = F.format_string("Q%02d  [%s]  Difficulty: %s  Score: %.2f", F.col("q_idx"), _title(F.col("type")), _title(F.col("difficulty")), F.col("score"))
    lines = [F.lit("─" * 64), head, F.lit(""), F.col("question"), F.lit(""), *(F.concat(F.lit(f"   {x}.  "), _option(x), mark(x)) for x in LETTERS)]
    explained = F.when(F.coalesce("explanation", F.lit("")) != "", F.concat(F.lit("\n\n   💡 "), F.col("explanation"))).otherwise("")
    return items.select("doc_id", "q_idx", F.concat(F.concat_ws("\n", *lines), explained, F.lit("\n")).alias("value"))


def json_rows(items: DataFrame) -> DataFrame:
    out = F.struct("question", "options", "answer", "answer_text", "explanation", "type", "difficulty", F.round("score", 3).alias("score"))
    return items.select("doc_id", "q_idx", F.to_json(out).alias("value"))


def csv_rows(items: DataFrame) -> DataFrame:
    values = (F.col("q_idx"), F.col("question"), *map(_option, LETTERS), F.col("answer"), F.col("answer_text"), F.col("explanation"), F.col("type"), F.col("difficulty"), F.round("score", 3))
    return items.select("doc_id", *(v.alias(n) for n, v in zip(CSV_COLUMNS, values, strict=True)))


def anki_rows(items: DataFrame) -> DataFrame:
    """Tabs and markup in texts are not escaped."""
    front = F.concat_ws("<br>", F.concat(F.lit("<b>"), F.col("question"), F.lit("</b>")), *(F.concat(F.lit(f"{x}. "), _option(x)) for x in LETTERS))
    explained = F.when(F.coalesce("explanation", F.lit("")) != "", F.concat(F.lit("<br><br><i>"), F.col("explanation"), F.lit("</i>"))).otherwise("")
    back = F.concat(F.lit("<b>Answer: "), F.col("answer"), F.lit(". "), F.coalesce(F.try_element_at("options", F.col("answer")), F.lit("")), F.lit("</b>"), explained)
    return items.select("doc_id", "q_idx", F.concat_ws("\t", front, back).alias("value"))


def gift_rows(items: DataFrame) -> DataFrame:
    """The characters ~ = # { } in texts are not escaped."""
    n = F.col("q_idx").cast("string")
    sign = lambda x: F.when(F.col("answer") == x, "  =").otherwise("  ~")
    lines = [F.concat(F.lit("// Question "), n), F.concat(F.lit("::"), _title(F.col("type")), F.lit(" Q"), n, F.lit("::[html]"), F.col("question"), F.lit("{")), *(F.concat(sign(x), _option(x)) for x in LETTERS), F.lit("}"), F.lit("")]
    return items.select("doc_id", "q_idx", F.concat_ws("\n", *lines).alias("value"))


def write(items: DataFrame, path: str, fmt: str) -> None:
    """fmt: text, json, csv, anki or gift. A folder for each document; rows of a document in order."""
    rows = {"text": text_rows, "json": json_rows, "csv": csv_rows, "anki": anki_rows, "gift": gift_rows}[fmt](items)
    order = "#" if fmt == "csv" else "q_idx"
    rows = rows.repartition("doc_id").sortWithinPartitions("doc_id", order)
    if fmt == "csv":
        rows.write.partitionBy("doc_id").option("header", True).option("quote", '"').option("escape", '"').csv(path)
        return
    if fmt == "anki":
        header = rows.select("doc_id").distinct().select("doc_id", F.lit(0).alias("q_idx"), F.lit("\n".join(ANKI_HEADER)).alias("value"))
        rows = rows.unionByName(header).repartition("doc_id").sortWithinPartitions("doc_id", "q_idx")
    rows.drop("q_idx").write.partitionBy("doc_id").text(path)
