"""Inputs as documents: files by suffix or magic bytes, words of PDF pages, shapes of slides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import strip
from ..functions.text import from_text, normalise_space
from .office import PdfFactory, pdf_words, presentation_shapes


def file_kind(path: Column, content: Column) -> Column:
    """pdf, pptx or text: by suffix, then by the first bytes."""
    name = F.lower(path)
    by_name = F.when(name.endswith(".pdf"), "pdf").when(name.endswith(".pptx") | name.endswith(".ppt"), "pptx")
    head = F.hex(F.substring(content, 1, 4))
    return F.coalesce(by_name, F.when(head == "25504446", "pdf").when(head.startswith("504B"), "pptx").otherwise("text"))


def read_files(spark: SparkSession, path: str, pdf: PdfFactory | None = None) -> DataFrame:
    """(path, kind, content, text, status): text files without their bad bytes, presentations, and PDF files if a provider is given.

    Files of no bytes give no row; rich files that can't be read or hold nothing have the status "no text".
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    kinds = files.withColumn("kind", file_kind(F.col("path"), F.col("content")))
    given = lambda kind: kinds.where(F.col("kind") == kind).select(F.col("path").alias("doc_id"), "content")
    rich = from_slides(presentation_shapes(given("pptx")))
    if pdf:
        rich = rich.unionByName(from_pdf_words(pdf_words(given("pdf"), pdf)))
    joined = kinds.join(rich.select(F.col("doc_id").alias("path"), F.col("text").alias("found")), "path", "left")
    plain = from_text(F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit("")))
    text = F.when(F.col("kind") == "text", plain).otherwise(F.col("found"))
    status = F.when(F.col("text") != "", "ok").when(F.col("text") == "", "Empty text").when((F.col("kind") == "pdf") & F.lit(pdf is None), "needs a provider").otherwise("no text")
    return joined.withColumn("text", text).withColumn("status", status).select("path", "kind", "content", "text", "status")


def from_pdf_words(words: DataFrame) -> DataFrame:
    """words: (doc_id, page, text, x0, top) to (doc_id, text): words in bands of ten points, left to right; pages by blank lines."""
    word = F.struct(F.bround(F.col("top") / 10).alias("band"), "x0", "text")
    pages = words.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(word)), lambda w: w["text"]), " ").alias("t"))
    kept = pages.where(strip(F.col("t")) != "").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", strip(F.col("t")).alias("t")))).alias("p"))
    return kept.select("doc_id", normalise_space(F.array_join(F.transform("p", lambda p: p["t"]), "\n\n")).alias("text"))


def from_slides(shapes: DataFrame) -> DataFrame:
    """shapes: (doc_id, slide, top, is_title, paragraphs) to (doc_id, text): title first, then shapes from the top; slides by blank lines."""
    lines = F.filter(F.transform("paragraphs", strip), lambda p: p != "")
    shaped = shapes.select("doc_id", "slide", F.coalesce("top", F.lit(0)).alias("top"), "is_title", F.array_join(lines, "\n").alias("t")).where("t <> ''")
    titled = F.when(F.col("is_title"), F.concat(F.lit("[Slide "), F.col("slide").cast("string"), F.lit(": "), F.col("t"), F.lit("]"))).otherwise(F.col("t"))
    piece = F.struct((~F.col("is_title")).alias("after"), "top", titled.alias("t"))
    slides = shaped.groupBy("doc_id", "slide").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["t"]), "\n").alias("t"))
    joined = slides.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("slide", "t"))).alias("s"))
    return joined.select("doc_id", normalise_space(F.array_join(F.transform("s", lambda s: s["t"]), "\n\n")).alias("text"))
