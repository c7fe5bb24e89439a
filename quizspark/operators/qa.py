"""Question answering over documents and pages by relevance of words; a reading model is an optional provider."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.columns import let, strings, strip, word_set
from ..sources.providers import Factory, with_model_answers
from .search import best_pages

# Fixed value: model answers that score less carry a note.
LOW_CONFIDENCE = 0.05
# Least relevance of a page, and how many of the best pages are context.
LEAST_RELEVANCE, CONTEXT_HITS = 0.2, 3
# Fixed value: characters of context from pages.
WEB_CHARACTERS = 5000


def query_terms(question: Column, common: tuple[str, ...]) -> Column:
    return F.array_except(word_set(question), strings(common))


def relevance(terms: Column, text: Column) -> Column:
    """Share of the terms that the text holds; null without terms."""
    return F.try_divide(F.size(F.array_intersect(terms, word_set(text))), F.size(terms))


def split_at_ends(text: Column) -> Column:
    return F.split(text, r"(?U)(?<=[.!?])\s+")


def sections(questions: DataFrame, docs: DataFrame, most: int = 5) -> DataFrame:
    """(q_id, doc_id, question, context): a document's sentences that share most terms with the question, best first.

    questions: (q_id, doc_id, question), each about one document. Nothing in common, or no sentence: the document's beginning.
    """
    pairs = questions.join(docs.select("doc_id", "text"), "doc_id").where(strip(F.col("text")) != "")
    terms = query_terms(F.col("question"), L.SECTION_COMMON_WORDS)

    def pick(t: Column) -> Column:
        sents = F.filter(F.transform(split_at_ends(F.col("text")), strip), lambda s: F.length(s) > 20)
        scored = F.transform(sents, lambda s, i: F.struct((-F.size(F.array_intersect(t, word_set(s)))).alias("n"), i.alias("i"), s.alias("s")))
        best = F.slice(F.array_sort(F.filter(scored, lambda x: x["n"] < 0)), 1, most)
        return F.substring(F.array_join(F.transform(best, lambda x: x["s"]), " "), 1, 2500)

    context = let(terms, pick)
    return pairs.select("q_id", "doc_id", "question", context.alias("c"), F.substring("text", 1, 2000).alias("start")).select("q_id", "doc_id", "question", F.when(F.col("c") != "", F.col("c")).otherwise(F.col("start")).alias("context"))


def page_hits(questions: DataFrame, pages: DataFrame, hits: int = 4, characters: int | None = None) -> DataFrame:
    """(q_id, question, page_id, url, text, relevance, hit, before): the best pages of each question by shared terms, ties to the smaller id.

    before: the characters of the question's better hits. characters: so many of a text are returned (None: all); whole texts are searched
    and counted, so a context that is cut to no more stays the same. Stands in for a web search. Frequent terms are in most questions and pages, so no
    row is made for a shared term (see search). The texts join last, once the hits are known.
    """
    asked = questions.select("q_id", query_terms(F.col("question"), L.PAGE_COMMON_WORDS).alias("terms"))
    words = pages.select("page_id", word_set(F.col("text")).alias("terms"), F.length("text").alias("size"))
    shared = best_pages(asked, words, hits).select("q_id", "page_id", (F.col("shared") / F.col("n")).alias("relevance"), "size")
    ranked = Window.partitionBy("q_id").orderBy(F.desc("relevance"), "page_id")
    best = shared.withColumn("hit", F.row_number().over(ranked)).where(F.col("hit") <= hits)
    best = best.withColumn("before", F.coalesce(F.sum("size").over(Window.partitionBy("q_id").orderBy("hit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    text = F.col("text") if characters is None else F.substring("text", 1, characters)
    named = best.drop("size").join(questions.select("q_id", "question"), "q_id")
    return named.join(pages.select("page_id", "url", text.alias("text")), "page_id").select("q_id", "question", "page_id", "url", "text", "relevance", "hit", "before")


def web_context(found: DataFrame, least: float = LEAST_RELEVANCE, hits: int = CONTEXT_HITS) -> DataFrame:
    """(q_id, web): texts of the first hits over the threshold, joined by blank lines, cut to 5000 characters."""
    kept = found.where(_kept(least, hits) & (F.col("before") < WEB_CHARACTERS))
    return kept.groupBy("q_id").agg(_web(F.lit(True)).alias("web"))


def _kept(least: float, hits: int) -> Column:
    return (F.col("hit") <= hits) & (F.col("relevance") > least)


def _web(kept: Column) -> Column:
    """The texts of the rows kept, as an aggregate; '' if there are none. What lies beyond the cut behind the better hits is not moved."""
    text = F.substring("text", F.lit(1), F.greatest(F.lit(0), WEB_CHARACTERS - F.col("before")).cast("int"))
    texts = F.array_sort(F.collect_list(F.when(kept, F.struct("hit", text.alias("text")))))
    return F.substring(F.array_join(F.transform(texts, lambda x: x["text"]), "\n\n"), 1, WEB_CHARACTERS)


def keyword_answer(question: Column, context: Column) -> Column:
    """The first sentence of 20 or more characters that holds the largest share of the question's words, if over a tenth."""

    def best(words: Column) -> Column:
        sents = F.filter(split_at_ends(context), lambda s: F.length(s) >= 20)
        scored = F.transform(sents, lambda s, i: F.struct((-F.size(F.array_intersect(words, word_set(s)))).alias("n"), i.alias("i"), s.alias("s")))
        return let(F.get(F.array_sort(scored), F.lit(0)), lambda x: F.when(-x["n"] / F.greatest(F.size(words), F.lit(1)) > 0.1, x["s"]).otherwise(L.NO_ANSWER))

    return F.coalesce(let(word_set(question), best), F.lit(L.NO_ANSWER))


def answer(questions: DataFrame, docs: DataFrame | None = None, pages: DataFrame | None = None, reader: Factory | None = None) -> DataFrame:
    """(q_id, question, answer, sources, used_web, score): document sections first, then pages.

    reader: an optional reading model (see sources.providers); where it gives nothing, and without one, keyword answers apply and score 0.
    """
    out = questions.select("q_id", "question")
    out = out.join(sections(questions, docs).select("q_id", F.col("context").alias("doc")), "q_id", "left") if docs is not None else out.withColumn("doc", F.lit(None).cast("string"))
    if pages is not None:
        found = page_hits(questions, pages, characters=WEB_CHARACTERS)
        sources = F.transform(F.array_sort(F.collect_list(F.struct("hit", "url"))), lambda x: x["url"])
        out = out.join(found.groupBy("q_id").agg(_web(_kept(LEAST_RELEVANCE, CONTEXT_HITS)).alias("web"), sources.alias("sources")), "q_id", "left")
    else:
        out = out.withColumn("web", F.lit(None).cast("string")).withColumn("sources", F.lit(None).cast("array<string>"))
    context = strip(F.concat_ws(" ", F.when(F.col("doc") != "", F.col("doc")), F.when(F.col("web") != "", F.col("web"))))
    out = out.withColumn("context", context)
    if reader:
        out = with_model_answers(out, reader)
    else:
        out = out.withColumn("model_answer", F.lit(None).cast("struct<answer:string,score:double>"))
    model, read = F.col("model_answer"), (F.col("context") != "") & F.col("model_answer").isNotNull()
    note = F.concat(F.lit("\n\n*(Low confidence — "), F.format_string("%d%%", F.bround(100 * model["score"]).cast("int")), F.lit(". The answer may not be clear from available context.)*"))
    said = F.when(model["score"] < LOW_CONFIDENCE, F.concat(model["answer"], note)).otherwise(model["answer"])
    text = F.when(F.col("context") == "", L.NOTHING_FOUND).when(read, said).otherwise(keyword_answer(F.col("question"), F.col("context")))
    score = F.when(read, model["score"]).otherwise(0.0)
    return out.select("q_id", "question", text.alias("answer"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), (F.coalesce("web", F.lit("")) != "").alias("used_web"), score.alias("score"))
