"""The queries op1 to op10 and the pipeline: thin digests over the operators' real outputs, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pii, quality, secrets, toxicity
from . import spans as S
from .common import table
from .decontam import find_contained
from .lmscore import score_documents
from .neardup import near_duplicates
from .packing import pack_best_fit
from .sharding import external_shuffle
from .topk import top_k_inner_products


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _remainder(by: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(by))


def _predicted(scores: DataFrame, held_out) -> DataFrame:
    return scores.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, held_out = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), _remainder(5) == 0
    model = toxicity.fit(toxicity.learn(docs, labels, "toxic", ~held_out))
    return _predicted(toxicity.score_toxicity(docs, model), held_out)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = external_shuffle(table(spark, sf_dir, "documents"), shards=16)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return out.select("doc_id", "size", crc.alias("text_crc32"), "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = score_documents(table(spark, sf_dir, "documents"), order=3)
    return scores.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"), F.round("word_score", 3).alias("word_score"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, held_out = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), _remainder(3) == 1
    model = quality.fit(quality.with_roles(toxicity.learn(docs, labels, "quality", ~held_out, max_rows=quality.MAX_ROWS)))
    return _predicted(quality.score_quality(docs, model), held_out)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _digest(scanned: DataFrame, kinds: tuple[str, ...], based: int) -> DataFrame:
    """Counts and hash of the base spans (kinds before `based`), and all spans."""
    counts = [S.count(F.col("base"), k).alias(f"n_{kinds[k]}") for k in range(based)]
    base = F.sha2(S.render(F.col("base"), kinds).cast("binary"), 256)
    return scanned.select("doc_id", *counts, base.alias("base_sha256"), S.render(F.concat("base", "added"), kinds).alias("spans"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(secrets.scan_secrets(table(spark, sf_dir, "documents")), secrets.KINDS, 3)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(pii.scan_pii(table(spark, sf_dir, "documents")), pii.KINDS, 4)


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_sharding": op2_sharding,
    "op3_lmscore": op3_lmscore,
    "op4_topk": op4_topk,
    "op5_quality": op5_quality,
    "op6_decontamination": op6_decontamination,
    "op7_secrets": op7_secrets,
    "op8_pii": op8_pii,
    "op9_neardup": op9_neardup,
    "op10_packing": op10_packing,
}

OP6_SQL = r"""
WITH items AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 5) AS width FROM items WHERE len(w) > 0),
item_grams AS (SELECT DISTINCT item_id, width, array_to_string(w[i:i + width - 1], ' ') AS gram
               FROM (SELECT *, unnest(range(1, len(w) - width + 2)) AS i FROM sized)),
totals AS (SELECT item_id, width, count(*) AS n_item FROM item_grams GROUP BY ALL),
docs AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
doc_grams AS (SELECT DISTINCT doc_id, width, array_to_string(w[i:i + width - 1], ' ') AS gram
              FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM docs, (SELECT DISTINCT width FROM sized)))
SELECT doc_id, item_id, count(*) AS n_shared, n_item
FROM doc_grams JOIN item_grams USING (width, gram) JOIN totals USING (item_id, width)
GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 80 * n_item
"""

OP3_SQL = r"""
WITH words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT doc_id, i, w[i] AS g1, CASE WHEN i > 1 THEN array_to_string(w[i - 1:i], ' ') END AS g2, CASE WHEN i > 2 THEN array_to_string(w[i - 2:i], ' ') END AS g3 FROM places),
own1 AS (SELECT doc_id, g1 AS g, count(*) AS n FROM grams GROUP BY ALL), own2 AS (SELECT doc_id, g2 AS g, count(*) AS n FROM grams WHERE i > 1 GROUP BY ALL),
own3 AS (SELECT doc_id, g3 AS g, count(*) AS n FROM grams WHERE i > 2 GROUP BY ALL),
other1 AS (SELECT doc_id, g, sum(n) OVER (PARTITION BY g) - n AS c FROM own1), other2 AS (SELECT doc_id, g, sum(n) OVER (PARTITION BY g) - n AS c FROM own2),
other3 AS (SELECT doc_id, g, sum(n) OVER (PARTITION BY g) - n AS c FROM own3),
sizes AS (SELECT doc_id, len(w) AS n_words, sum(len(w)) OVER () - len(w) AS rest FROM words),
counted AS (SELECT x.doc_id, x.i, a.c AS c1, b.c AS c2, t.c AS c3, p.c AS before1, q.c AS before2
            FROM grams x JOIN other1 a ON a.doc_id = x.doc_id AND a.g = x.g1 LEFT JOIN other2 b ON b.doc_id = x.doc_id AND b.g = x.g2
            LEFT JOIN other3 t ON t.doc_id = x.doc_id AND t.g = x.g3 LEFT JOIN grams y ON y.doc_id = x.doc_id AND y.i = x.i - 1
            LEFT JOIN other1 p ON p.doc_id = y.doc_id AND p.g = y.g1 LEFT JOIN other2 q ON q.doc_id = y.doc_id AND q.g = y.g2),
scored AS (SELECT c.doc_id, CASE WHEN c3 > 0 THEN ln(c3 / before2) WHEN c2 > 0 THEN ln(c2 / before1) + ln(0.4) * CASE WHEN i > 2 THEN 1 ELSE 0 END
           ELSE ln(CASE WHEN c1 > 0 THEN c1 ELSE 0.5 END / greatest(rest, 1)) + ln(0.4) * least(i - 1, 2) END AS s
           FROM counted c JOIN sizes USING (doc_id))
SELECT doc_id, any_value(n_words) AS n_words, round(coalesce(sum(s), 0), 3) AS log_score, round(coalesce(avg(s), 0), 3) AS word_score FROM sizes LEFT JOIN scored USING (doc_id) GROUP BY doc_id
"""

OP4_SQL = """
WITH valid AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
          FROM valid q JOIN valid c ON q.vec_id % 50 = 0 AND c.r <> q.r AND len(c.v) = len(q.v))
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM pairs QUALIFY rank <= 5
"""

OP9_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g FROM (SELECT *, unnest(range(1, greatest(len(w), 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.v FROM reached r JOIN edges e ON e.u = r.b)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM documents d JOIN reached r ON r.a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""

ORACLES: dict[str, str] = {
    "op3_lmscore": OP3_SQL,
    "op4_topk": OP4_SQL,
    "op6_decontamination": OP6_SQL,
    "op9_neardup": OP9_SQL,
}
