"""One query per operator, over whole tables. Oracles are in oracles.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import lexicon as L
from ..functions import questions as Q
from ..functions import text as T
from ..functions.columns import split_words
from ..operators import answers as OA
from ..operators import assemble as OM
from ..operators import distract as OD
from ..operators import export as OX
from ..operators import metrics as OE
from ..operators import qa, rank
from ..operators.sentences import all_sentences, sentences
from ..sources.documents import file_kind, from_pdf_words, from_slides
from ..sources.web import domain, is_skipped, page_text
from .facts import bullet_documents, facts, table
from .pipeline import QuizPipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query
def source_kind(spark, d):
    """Kinds of files named and headed in different ways, made from the part table."""
    p = table(spark, d, "part").select("p_partkey")
    name = F.concat(F.lit("file"), F.col("p_partkey").cast("string"), F.get(F.array(*map(F.lit, (".pdf", ".PPTX", ".txt", "", ".ppt"))), (F.col("p_partkey") % 5).cast("int")))
    head = F.get(F.array(*map(F.lit, ("%PDF-1.7", "PK..", "plain"))), (F.col("p_partkey") % 3).cast("int"))
    return p.select("p_partkey", file_kind(name, head.cast("binary")).alias("kind"))


@query
def normalise_text(spark, d):
    return _documents(spark, d).select("doc_id", T.from_text(F.col("text")).alias("text"))


@query
def fix_encoding(spark, d):
    return _documents(spark, d).select("doc_id", T.fix_encoding(F.col("text")).alias("text"))


@query
def noise_strip(spark, d):
    docs = _documents(spark, d).select("doc_id", F.concat(F.lit("# Head\n[Slide 3: a:b] see https://x.org/y (12) 13×13 ×256 wait.... a--b c:d\n\n\n\n"), F.col("text")).alias("text"))
    return docs.select("doc_id", T.strip_noise(F.col("text")).alias("text"))


@query
def bullet_expand(spark, d):
    paragraphs = bullet_documents(spark, d).select("doc_id", F.explode(F.split("text", "\n\n+")).alias("p"))
    return paragraphs.select("doc_id", F.explode(T.expand_bullets(F.col("p"))).alias("point"))


@query
def abbrev_protect(spark, d):
    return _documents(spark, d).select("doc_id", T.protect_abbreviations(F.col("text")).alias("text"))


@query
def sentence_split(spark, d):
    return all_sentences(_documents(spark, d))


@query
def sentence_split_bullets(spark, d):
    return all_sentences(bullet_documents(spark, d))


@query
def sentence_quality(spark, d):
    s, w = F.col("sentence"), split_words(F.col("sentence"))
    flags = {
        "n_words": F.size(w),
        "letter_share": F.round(T.letter_share(s), 6),
        "math": T.is_math_heavy(s, w),
        "heading": T.is_heading(s, w),
        "numbered": T.is_numbered(s),
        "architecture": T.is_architecture(w),
        "numeric": T.is_numeric(w),
        "good": T.is_good_sentence(s),
    }
    return all_sentences(_documents(spark, d)).select("doc_id", "sent_idx", *(c.alias(n) for n, c in flags.items()))


@query
def sentence_dedup(spark, d):
    return sentences(_documents(spark, d)).select("doc_id", "sent_idx", "n_sentences", "sentence")


@query
def surface_scores(spark, d):
    s = F.col("sentence")
    return sentences(_documents(spark, d)).select(
        "doc_id", "sent_idx", F.round(rank.position_bonus(F.col("sent_idx")), 6).alias("position"), F.round(rank.length_score(s), 6).alias("length"), F.round(rank.info_density(s), 6).alias("density"), F.round(rank.entity_bonus(s), 6).alias("entity"), F.round(rank.definition_bonus(s), 6).alias("definition")
    )


@query
def tfidf_weights(spark, d):
    return rank.tfidf(sentences(_documents(spark, d))).select("doc_id", "sent_idx", "term", F.round("w", 6).alias("w"))


@query
def sentence_centrality(spark, d):
    return rank.centrality(sentences(_documents(spark, d))).select("doc_id", "sent_idx", F.round("centrality", 6).alias("centrality"))


@query
def sentence_rank_topk(spark, d):
    return rank.rank_sentences(sentences(_documents(spark, d)), 5).select("doc_id", "sent_idx", F.round("score", 6).alias("score"))


@query
def sentence_selection(spark, d):
    return rank.select_sentences(sentences(_documents(spark, d)), 30).select("doc_id", "sent_idx")


def _spans(spark, d, extractor: Callable[[Column], Column]) -> DataFrame:
    return facts(spark, d).select("doc_id", "sent_idx", F.explode(extractor(F.col("sentence"))).alias("a")).select("doc_id", "sent_idx", "a.span", "a.type")


@query
def list_answers(spark, d):
    return _spans(spark, d, A.such_as)


@query
def including_answers(spark, d):
    return _spans(spark, d, A.including)


@query
def paren_answers(spark, d):
    return _spans(spark, d, A.parentheses)


@query
def known_as_answers(spark, d):
    return _spans(spark, d, A.known_as)


@query
def dash_answers(spark, d):
    return _spans(spark, d, A.dash_definition)


@query
def date_answers(spark, d):
    return _spans(spark, d, A.rules)


@query
def subject_answers(spark, d):
    found = sentences(_documents(spark, d)).select("doc_id", "sent_idx", F.explode(A.subject(F.col("sentence"))).alias("a"))
    return found.select("doc_id", "sent_idx", F.col("a.span").alias("subject"), A.trim(F.col("a.span")).alias("trimmed"), A.is_valid(A.trim(F.col("a.span"))).alias("valid"))


@query
def answer_overlap(spark, d):
    s = F.col("sentence")
    spans = F.concat(A.such_as(s), A.including(s), A.parentheses(s), A.known_as(s), A.dash_definition(s), A.rules(s))
    kept = facts(spark, d).select("doc_id", "sent_idx", F.explode(A.without_overlaps(A.accepted(s, spans))).alias("a"))
    return kept.select("doc_id", "sent_idx", "a.answer", "a.type", "a.source", "a.score")


@query
def answer_topk(spark, d):
    return OA.extract_answers(facts(spark, d)).drop("sentence")


@query
def answer_topk_documents(spark, d):
    chosen = rank.select_sentences(sentences(_documents(spark, d)))
    return OA.extract_answers(chosen).groupBy("type", "source").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("avg_score"))


def _questions(spark, d) -> DataFrame:
    return OA.question_rows(facts(spark, d))


@query
def highlight_input(spark, d):
    return OA.extract_answers(facts(spark, d)).select("doc_id", "sent_idx", "ans_rank", Q.highlight(F.col("answer"), F.col("sentence")).alias("input"))


@query
def question_clean(spark, d):
    """Raw model outputs in different states, made from facts."""
    raw = F.concat(F.get(F.array(*map(F.lit, ("question: ", "  'who ", '"Which ', ""))), (F.col("sent_idx") % 4).cast("int")), F.lower("sentence"), F.get(F.array(*map(F.lit, ("??", "'", "!", " "))), (F.col("sent_idx") % 3).cast("int")))
    cleaned = facts(spark, d).select("doc_id", "sent_idx", Q.clean(raw).alias("question"))
    return cleaned.withColumn("valid", Q.is_valid(F.col("question"), F.lit("the order of the")))


@query
def question_template(spark, d):
    kinds = F.array(*map(F.lit, ("PERSON", "LOCATION", "DATE", "NUMBER", "ORGANIZATION", "CONCEPT")))
    named = table(spark, d, "supplier").select("s_suppkey", "s_name", F.get(kinds, (F.col("s_suppkey") % 6).cast("int")).alias("type"))
    q = named.withColumn("question", Q.question(F.col("s_name"), F.col("type")))
    return q.withColumn("score", Q.score(F.col("question"), F.col("s_name"), F.lit(0.6), F.col("type")))


@query
def question_score(spark, d):
    return _questions(spark, d).select("doc_id", "sent_idx", "ans_rank", "question", "question_score")


@query
def question_dedup(spark, d):
    """The grouped form, fed with one raw question for all answers of a sentence."""
    answers = OA.extract_answers(facts(spark, d)).withColumn("raw", F.concat(F.lit("When was segment "), F.col("sent_idx").cast("string"), F.lit(" mentioned")))
    return OA.generate_questions(answers, "raw").select("doc_id", "sent_idx", "ans_rank", "question", "question_score")


@query
def domain_detect(spark, d):
    """Concept banks for whole documents, each behind a phrase with different keys."""
    keys = F.array(*map(F.lit, ("train a model", "deep neural layer", "a word and its token", "pixel photo vision", "logic agent", "nothing", "model text image")))
    return _documents(spark, d).select("doc_id", Q.domain(F.concat(F.get(keys, (F.col("doc_id") % 7).cast("int")), F.lit(" "), F.coalesce("text", F.lit("")))).alias("domain"))


@query
def shape_match(spark, d):
    pairs = facts(spark, d).join(table(spark, d, "region"), F.col("r_regionkey") == F.pmod(F.col("sent_idx"), F.lit(5)))
    span = F.array_join(F.slice(split_words(F.col("sentence")), 5, F.pmod(F.col("sent_idx"), F.lit(7)).cast("int") + 1), " ")
    return pairs.select("doc_id", "sent_idx", Q.same_shape(span, F.col("r_name")).alias("same"), F.round(Q.word_overlap(span, F.col("sentence")), 6).alias("overlap"))


def _pool(spark, d) -> tuple[DataFrame, DataFrame]:
    questions = _questions(spark, d)
    return questions, questions.select("doc_id", "sent_idx", "ans_rank", "answer", "type")


@query
def type_pool(spark, d):
    """The whole pools, as their size and hash."""
    pooled = OD.type_pool(*_pool(spark, d))
    return pooled.select("doc_id", "sent_idx", "ans_rank", F.size("pool").alias("n"), F.md5(F.array_join("pool", "|").cast("binary")).alias("pool"))


@query
def bank_distractors(spark, d):
    questions = _questions(spark, d)
    return questions.select("doc_id", "sent_idx", "ans_rank", F.array_join(OD.bank(F.col("answer"), F.col("type"), F.col("sentence")), "|").alias("bank"))


@query
def distractor_greedy(spark, d):
    return OD.with_distractors(_questions(spark, d)).select("doc_id", "sent_idx", "ans_rank", "answer", F.array_join("distractors", "|").alias("distractors"))


@query
def morph_variants(spark, d):
    parts = table(spark, d, "part").select("p_partkey", F.get(F.array(*map(F.lit, ("1956", "42.5%", "Deep Learning", "neural network theory", "steel"))), (F.col("p_partkey") % 5).cast("int")).alias("answer"))
    return parts.withColumn("variants", F.array_join(OD.distractors(F.col("answer"), F.array().cast("array<string>")), "|"))


def _similar(e: DataFrame, asked: DataFrame) -> DataFrame:
    """The three best spans of each asked vector; equal rows have equal keys."""
    key = F.xxhash64("vec_id", "label", "embedding").alias("key")
    spans = e.select("label", F.col("vec_id").cast("string").alias("answer"), F.col("embedding").alias("vector"))
    best = OD.rank_similar(asked.select(key, "label", F.col("embedding").alias("vector")).dropDuplicates(["key"]), spans, "label")
    return asked.select("vec_id", key).join(best, "key", "left").select("vec_id", F.coalesce(F.array_join("best", "|"), F.lit("")).alias("best"))


@query
def embedding_rank(spark, d):
    """Similar vectors of the embeddings table as a stub embedder's spans: every vector against all of its label."""
    e = table(spark, d, "embeddings")
    return _similar(e, e)


@query
def fk_grade(spark, d):
    return sentences(_documents(spark, d)).select("doc_id", "sent_idx", F.round(Q.reading_grade(F.col("sentence")), 9).alias("grade"))


@query
def difficulty_type(spark, d):
    q = _questions(spark, d)
    return q.select("doc_id", "sent_idx", "ans_rank", Q.question_type(F.col("question")).alias("question_type"), Q.difficulty(F.col("question"), F.col("type")).alias("difficulty"))


@query
def explanation(spark, d):
    return _questions(spark, d).select("doc_id", "sent_idx", "ans_rank", Q.explanation(F.col("answer"), F.col("sentence")).alias("explanation"))


@query
def stem_overlap(spark, d):
    q = _questions(spark, d)
    return q.select("doc_id", "sent_idx", "ans_rank", Q.stem(F.col("question")).alias("stem"), F.round(Q.word_overlap(Q.stem(F.col("question")), F.lower("answer")), 6).alias("overlap"))


def _fixed_options(spark, d) -> DataFrame:
    q = OM.first_questions(_questions(spark, d))
    return q.withColumn("distractors", F.array(F.lit("April 1"), F.concat(F.lit("early "), F.lower("answer")), F.lit("the tenth of June")))


@query
def option_similarity(spark, d):
    q = _fixed_options(spark, d)
    return q.select("doc_id", "sent_idx", "ans_rank", Q.too_similar(F.concat(F.array("answer"), F.col("distractors"))).alias("similar"))


@query
def option_order(spark, d):
    items = OM.build(_fixed_options(spark, d))
    return items.select("doc_id", "sent_idx", "ans_rank", F.array_join(F.map_values("options"), "|").alias("options"), "answer")


@query
def mcq_quality_filter(spark, d):
    return OM.good(OM.build(_fixed_options(spark, d))).select("doc_id", "sent_idx", "ans_rank", "question", "answer", "answer_text", "type", "difficulty", "score")


@query
def mcq_topk(spark, d):
    return OM.cap(OM.good(OM.build(_fixed_options(spark, d))), 3).select("doc_id", "q_idx", "question", "answer", "score")


def _items(spark, d) -> DataFrame:
    """Items with fixed options, so that SQL can follow."""
    return OM.cap(OM.good(OM.build(_fixed_options(spark, d))), 20)


@query
def mcq_pipeline(spark, d):
    out = QuizPipeline().from_sentences(facts(spark, d))
    return out.withColumn("options", F.array_join(F.map_values("options"), "|"))


@query
def mcq_pipeline_documents(spark, d):
    """The whole pipeline over raw documents; few questions survive without a model, as the filter wants."""
    return QuizPipeline().run(_documents(spark, d)).withColumn("options", F.array_join(F.map_values("options"), "|"))


@query
def mcq_stats(spark, d):
    return OE.stats(_items(spark, d), "doc_id")


@query
def mcq_stats_total(spark, d):
    return OE.stats(_items(spark, d))


@query
def mcq_distributions(spark, d):
    maps = OE.distributions(_items(spark, d), "doc_id")
    each = [maps.select("doc_id", F.lit(n).alias("kind"), F.explode(n).alias("value", "n")) for n in ("type_dist", "difficulty_dist", "wh_word_dist")]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query
def mcq_meta(spark, d):
    f = facts(spark, d)
    docs = f.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent_idx", "sentence"))), lambda x: x["sentence"]), " ").alias("text"))
    shown = {c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws(":", e["key"], e["value"])), ",") for c in ("type_dist", "diff_dist")}
    return OE.run_metadata(docs, f, _questions(spark, d), _items(spark, d)).withColumns({"avg_score": F.round("avg_score", 6), **shown})


def _responses(items: DataFrame) -> DataFrame:
    """Letters picked by a rule; every seventh question is left out."""
    letter = F.get(F.array(*map(F.lit, "ABCD")), F.pmod(F.col("doc_id") + F.col("q_idx"), F.lit(4)).cast("int"))
    return items.where(F.pmod(F.col("doc_id") + F.col("q_idx"), F.lit(7)) != 0).select("doc_id", "q_idx", letter.alias("letter"))


@query
def quiz_score(spark, d):
    items = _items(spark, d)
    return OE.quiz_score(items, _responses(items))


@query
def answer_review(spark, d):
    items = _items(spark, d)
    return OE.review(items, _responses(items)).select("doc_id", "q_idx", "chosen", "answer", "correct")


@query
def item_filter(spark, d):
    return OE.filter_items(_items(spark, d), ["factual"], ["easy"]).select("doc_id", "q_idx", "type", "difficulty")


@query
def quality_bands(spark, d):
    return OE.stats(_items(spark, d), "doc_id").select("doc_id", OE.quality_band(F.col("quality_score")).alias("band"))


@query
def export_text_rows(spark, d):
    return OX.text_rows(_items(spark, d))


@query
def export_json_rows(spark, d):
    fields = "struct<question:string,options:map<string,string>,answer:string,answer_text:string,explanation:string,type:string,difficulty:string,score:double>"
    parsed = OX.json_rows(_items(spark, d)).select("doc_id", "q_idx", F.from_json("value", fields).alias("j"))
    return parsed.select("doc_id", "q_idx", "j.question", F.col("j.options")["A"].alias("a"), F.col("j.options")["D"].alias("d"), "j.answer", "j.answer_text", "j.explanation", "j.type", "j.difficulty", "j.score")


@query
def export_csv_rows(spark, d):
    return OX.csv_rows(_items(spark, d))


@query
def export_anki_rows(spark, d):
    return OX.anki_rows(_items(spark, d))


@query
def export_gift_rows(spark, d):
    return OX.gift_rows(_items(spark, d))


def _asked(spark, d) -> DataFrame:
    """User turns as questions, each about the document of its conversation's number."""
    c = table(spark, d, "conversations").where("role = 'user'")
    return c.groupBy((F.col("conv_id") * 1000 + F.col("turn")).alias("q_id"), F.col("conv_id").alias("doc_id")).agg(F.min("text").alias("question"))


@query
def query_terms(spark, d):
    q = _asked(spark, d)
    return q.select("q_id", F.size(qa.query_terms(F.col("question"), L.PAGE_COMMON_WORDS)).alias("for_pages"), F.size(qa.query_terms(F.col("question"), L.SECTION_COMMON_WORDS)).alias("for_sections"))


@query
def qa_sections(spark, d):
    return qa.sections(_asked(spark, d), _documents(spark, d)).select("q_id", "doc_id", "context")


@query
def qa_keyword_fallback(spark, d):
    found = qa.sections(_asked(spark, d), _documents(spark, d))
    return found.select("q_id", qa.keyword_answer(F.col("question"), F.col("context")).alias("answer"))


@query
def page_domain(spark, d):
    return table(spark, d, "pages").select("page_id", domain(F.col("url")).alias("domain"), is_skipped(F.col("url")).alias("skipped"), is_skipped(F.regexp_replace("url", "example", "netflix")).alias("skipped_netflix"))


@query
def page_fetch(spark, d):
    return page_text(table(spark, d, "pages"))


def _plain_pages(spark, d) -> DataFrame:
    """Pages with their tags blanked, which SQL can do too."""
    return table(spark, d, "pages").select("page_id", "url", F.regexp_replace("html", "<[^>]*>", " ").alias("text"))


@query
def page_relevance(spark, d):
    return qa.page_hits(_asked(spark, d), _plain_pages(spark, d)).select("q_id", "page_id", F.round("relevance", 6).alias("relevance"), "hit")


@query
def web_context(spark, d):
    return qa.web_context(qa.page_hits(_asked(spark, d), _plain_pages(spark, d), characters=qa.WEB_CHARACTERS))


@query
def qa_answer(spark, d):
    out = qa.answer(_asked(spark, d), _documents(spark, d), page_text(table(spark, d, "pages")))
    return out.withColumn("sources", F.array_join("sources", "|"))


@query
def pdf_words(spark, d):
    """Line items as words of pages: the order is the document, the supplier's remainder the page."""
    words = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_suppkey") % 2).cast("int").alias("page"), F.concat(F.col("l_returnflag"), F.col("l_partkey").cast("string")).alias("text"), F.col("l_partkey").cast("double").alias("x0"), (F.col("l_quantity") * 3).cast("double").alias("top"))
    return from_pdf_words(words)


@query
def slides(spark, d):
    """Orders as slides of a customer: the priority is the title, the other columns are shapes."""
    o = table(spark, d, "orders").withColumn("slide", F.pmod("o_orderkey", F.lit(3)).cast("int") + 1)
    title = o.groupBy(F.col("o_custkey").alias("doc_id"), "slide").agg(F.min("o_orderpriority").alias("t")).select("doc_id", "slide", F.lit(5).alias("top"), F.lit(True).alias("is_title"), F.array("t").alias("paragraphs"))
    body = o.select(F.col("o_custkey").alias("doc_id"), "slide", F.col("o_orderkey").cast("int").alias("top"), F.lit(False).alias("is_title"), F.array(F.col("o_orderstatus"), F.lit("  "), F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))).alias("paragraphs"))
    return from_slides(title.unionByName(body))
