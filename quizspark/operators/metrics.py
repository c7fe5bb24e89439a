"""Evaluation of items, run metadata, quiz scores, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import questions as Q
from ..functions.columns import split_words

WH_ORDER = ("what", "who", "when", "where", "why", "how", "which")


def wh_word(question: Column) -> Column:
    out = F.lit("other")
    for w in reversed(WH_ORDER):
        out = F.when(F.startswith(F.lower(question), F.lit(w)), w).otherwise(out)
    return out


def counts(items: DataFrame, *keys: str) -> DataFrame:
    return items.groupBy(*keys).agg(F.count("*").alias("n"))


def option_variance(options: Column) -> Column:
    """Population variance of the word counts of non-empty options; null for fewer than two."""
    sizes = F.transform(F.filter(F.map_values(options), lambda o: o != ""), lambda o: F.size(split_words(o)).cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    mean = total(sizes) / F.greatest(F.size(sizes), F.lit(1))
    return F.when(F.size(sizes) >= 2, total(F.transform(sizes, lambda x: (x - mean) * (x - mean))) / F.greatest(F.size(sizes), F.lit(1)))


def stats(items: DataFrame, *keys: str) -> DataFrame:
    """One row for each group (for all without keys; none for no items): averages, rates and the quality score of 0 to 100."""
    text, source = F.lower("answer_text"), F.lower("source_sentence")
    extractive = ((text != "") & (source != "") & F.contains(source, text)).cast("double")
    measured = items.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.avg(F.coalesce("score", F.lit(0.5))).alias("a"),
        F.coalesce(F.avg(extractive), F.lit(0.0)).alias("e"),
        F.coalesce(F.avg(option_variance(F.col("options"))), F.lit(0.0)).alias("v"),
        (1 - F.count_distinct(Q.question_key(F.col("question"))) / F.greatest(F.count("*"), F.lit(1))).alias("d"),
    )
    quality = F.col("a") * 40 + (1 - F.col("d")) * 20 + F.least(F.lit(1.0), F.col("v") / 5) * 20 + F.col("e") * 20
    return measured.where("total > 0").select(
        *keys, "total", F.round("a", 3).alias("avg_score"), F.round(quality, 1).alias("quality_score"), F.round("e", 3).alias("extractive_rate"), F.round("d", 3).alias("duplicate_rate"), F.round("v", 2).alias("avg_option_length_variance")
    )


def distributions(items: DataFrame, *keys: str) -> DataFrame:
    """type_dist, difficulty_dist and wh_word_dist as maps, of one pass."""
    labelled = items.select(*keys, F.explode(F.array(*(F.struct(F.lit(n).alias("kind"), c.alias("value")) for n, c in (("type", F.col("type")), ("difficulty", F.col("difficulty")), ("wh", wh_word(F.col("question"))))))).alias("x"))
    counted = labelled.groupBy(*keys, "x.kind", "x.value").agg(F.count("*").alias("n"))
    maps = [F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("value", "n"))))).alias(name) for k, name in (("type", "type_dist"), ("difficulty", "difficulty_dist"), ("wh", "wh_word_dist"))]
    return counted.groupBy(*keys).agg(*maps)


def run_metadata(docs: DataFrame, sentences: DataFrame, answers: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: raw_chars, total_sentences (selected), total_answers, total_questions, type_dist, diff_dist (maps, empty without items), avg_score, status."""
    from ..functions.text import from_text

    out = docs.select(F.col(id_col).alias("doc_id"), F.length(from_text(F.col(text_col))).alias("raw_chars"))
    for frame, name in ((sentences, "total_sentences"), (answers, "total_answers"), (items, "total_questions")):
        out = out.join(frame.groupBy("doc_id").agg(F.count("*").alias(name)), "doc_id", "left")
    out = out.join(items.groupBy("doc_id").agg(F.avg("score").alias("avg_score")), "doc_id", "left").na.fill(0, ["total_sentences", "total_answers", "total_questions"]).na.fill(0.0, ["avg_score"])
    dist = distributions(items, "doc_id").select("doc_id", "type_dist", F.col("difficulty_dist").alias("diff_dist"))
    empty = F.create_map().cast("map<string,bigint>")
    out = out.join(dist, "doc_id", "left").withColumns({c: F.coalesce(c, empty) for c in ("type_dist", "diff_dist")})
    status = F.when(F.col("raw_chars") == 0, "Empty text").when(F.col("total_sentences") == 0, "No sentences after preprocessing").otherwise("ok")
    return out.withColumn("status", status)


def filter_items(items: DataFrame, types: list[str] | None = None, difficulties: list[str] | None = None) -> DataFrame:
    for column, wanted in (("type", types), ("difficulty", difficulties)):
        items = items.where(F.col(column).isin(wanted)) if wanted else items
    return items


def review(items: DataFrame, responses: DataFrame) -> DataFrame:
    """Each answered item with the chosen letter and whether it is right."""
    chosen = responses.select("doc_id", "q_idx", F.col("letter").alias("chosen"))
    return items.join(chosen, ["doc_id", "q_idx"]).withColumn("correct", F.col("chosen") == F.col("answer"))


def quiz_score(items: DataFrame, responses: DataFrame) -> DataFrame:
    """(doc_id, answered, correct, percent, grade) of the answered items."""
    totals = review(items, responses).groupBy("doc_id").agg(F.count("chosen").alias("answered"), F.count_if(F.col("correct")).alias("correct"))
    percent = F.floor(100 * F.col("correct") / F.greatest(F.col("answered"), F.lit(1)))
    return totals.withColumn("percent", percent).withColumn("grade", F.when(percent >= 80, "excellent").when(percent >= 60, "good").otherwise("practice"))


def quality_band(quality: Column) -> Column:
    return F.when(quality >= 70, "high").when(quality >= 50, "medium").otherwise("low")
