"""Benchmark decontamination: size-partitioned MinHash containment search, confirmed by exact shingle containment.

Items are short, documents long, so their Jaccard similarity says little; what matters is the share of an item's shingles
that a document holds. The minima of an item under a random hash are a uniform sample of its shingles without replacement,
so a document that holds a share t of the item holds each of them with probability t, however long the document is.

1. Items are partitioned by size (powers of two of the number n of distinct shingles). The class decides two things:
   how many minima sign an item, and how many places a document must have to be searched for it at all. A document may lack
   n - need of the shingles, need = ceil(percent * n / 100). One more minimum than that can't all be missed; and k minima
   are all missed with probability (1 - t)**k, so where it is fewer, k = ceil(ln(MISSED) / ln(1 - t)) are enough.
   A class signs its items by the smaller of both numbers, taken for its largest size: at 80 % up to 63 shingles by the first
   rule (nothing can be missed), from 64 by the 13 smallest of the second.
2. Documents' shingles are joined to the signatures: a document that holds any of them and is long enough is a candidate.
3. Candidates' full sets: distinct shingles common to both, over the item's. Exact; the threshold decides.

Words are runs of letters and digits, lower-cased; shingles are `shingle` words. A text of fewer words is one shingle of all
its words and is sought as such; items without words match nothing. Texts are compared as words, never as prefixes or windows.

Nulls and empty texts hold nothing. Rows without an id are searched and reported with a null id. Rows that share a document's id
count as one document, texts that share an item's id as one item (their shingles of the same width together), so ties and repeated
rows change nothing. Ids are of any type. Very long texts are cut into blocks of BLOCK places before any shingle is made. An
empty table on either side gives an empty result. Other columns are ignored, whatever they are called; drop_contaminated keeps them.

The signatures are broadcast only if there are at most BROADCAST_ROWS of them; beyond, both sides are shuffled. All steps are
DataFrame functions; shingles meet as 64-bit hashes only to find candidates, and as words in step 3.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, quoted, unused

MISSED = 1e-9
BLOCK = 4096
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def least_held(n: Column, percent: int) -> Column:
    """How many of n shingles make percent of them."""
    return F.ceil(n * percent / 100).cast("long")


def minima_of(size_class: Column, percent: int) -> Column:
    """How many minima sign an item of 2**size_class to 2**(size_class + 1) - 1 shingles."""
    largest = F.pow(F.lit(2), size_class + 1) - 1
    every = largest - least_held(largest, percent) + 1
    enough = math.ceil(math.log(MISSED) / math.log(1 - percent / 100)) if percent < 100 else 1
    return F.least(every, F.lit(float(enough))).cast("int")


def _shingles(texts: DataFrame, widths: list[int], keys: list[str], spelled: bool) -> DataFrame:
    """texts: keys, words. A row for each place and width: keys, width, gram (a hash of the words), and the words if spelled."""

    def grams(width: int) -> Column:
        n = F.size("words") - (width - 1)
        places = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda at: F.struct(F.lit(width).alias("width"), F.slice("words", at, F.least(F.lit(BLOCK + width - 1), F.size("words") - at + 1)).alias("words")))

    def of(width: int) -> Column:
        def gram(i: Column) -> Column:
            words = F.slice("b.words", i, width)
            return F.struct(F.xxhash64(words).alias("gram"), F.array_join(words, " ").alias("spelled")) if spelled else F.xxhash64(words)

        return F.transform(F.sequence(F.lit(1), F.size("b.words") - (width - 1)), gram)

    blocks = texts.select(*keys, F.explode(F.concat(*map(grams, widths))).alias("b"))
    each = of(widths[-1])
    for width in widths[:-1]:
        each = F.when(F.col("b.width") == width, of(width)).otherwise(each)
    out = blocks.select(*keys, F.col("b.width").alias("width"), F.explode(each).alias("gram"))
    return out.select(*keys, "width", "gram.*") if spelled else out


def _item_shingles(items: DataFrame, shingle: int) -> DataFrame:
    """items: item_id, words. Distinct item_id, width, gram, spelled, with n, the number of shingles of the item at this width."""
    worded = items.where(F.size("words") > 0).withColumn("own", F.least(F.size("words"), F.lit(shingle)))
    grams = _shingles(worded, list(range(1, shingle + 1)), ["item_id", "own"], True).where("width = own").drop("own").distinct()
    sizes = grams.groupBy("item_id", "width").agg(F.count("*").alias("n"))
    return grams.join(sizes.withColumnsRenamed({"item_id": "of", "width": "at"}), F.col("item_id").eqNullSafe(F.col("of")) & (F.col("width") == F.col("at"))).drop("of", "at")


def signatures(known: DataFrame, percent: int) -> DataFrame:
    """(item_id, width, gram, need): the minima of each item, as many as its size class takes."""
    kept = F.struct(F.xxhash64(F.lit(17), "gram").alias("at"), F.col("gram").alias("gram"))
    item = known.groupBy("item_id", "width").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(kept)).alias("ordered"))  # one item's shingles
    classed = item.withColumn("size_class", F.floor(F.log2("n")).cast("int"))
    minima = F.slice("ordered", F.lit(1), minima_of(F.col("size_class"), percent))
    smallest = least_held(F.pow(F.lit(2), F.col("size_class")).cast("long"), percent)  # the least that any item of the class needs
    return classed.select("item_id", "width", F.explode(minima).alias("m"), smallest.alias("need")).select("item_id", "width", F.col("m.gram").alias("gram"), "need")


def find_contained(docs: DataFrame, items: DataFrame, percent: int = 80, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Returns doc_id, item_id, n_shared, n_item for every document that holds at least percent of an item's distinct shingles."""
    worded = items.select(F.col(quoted(item_id_col)).alias("item_id"), words_of(F.col(quoted(item_text_col))).alias("words"))
    known = materialise(_item_shingles(worded, shingle))
    signed = materialise(signatures(known, percent))
    widths = sorted(r[0] for r in signed.select("width").distinct().collect()) or [shingle]  # at most `shingle` numbers
    small = signed.count() <= BROADCAST_ROWS
    given = docs.select(F.col(quoted(id_col)).alias("doc_id"), words_of(F.col(quoted(text_col))).alias("words"))
    # Rows of one id count together, so how many places a document has is asked only of all its rows.
    grams = _shingles(given, widths, ["doc_id"], False).select("doc_id", "gram")  # one number, the fastest key; widths differ in their hashes
    met = grams.join(F.broadcast(signed) if small else signed, "gram").groupBy("doc_id", "item_id", "width").agg(F.max("need").alias("need"))
    candidates = materialise(met)
    ids = candidates.select(F.col("doc_id").alias("id")).distinct()
    again = given.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    places = again.groupBy("doc_id").agg(*(F.sum(F.greatest(F.size("words") - (w - 1), F.lit(0))).alias(f"w{w}") for w in widths))
    places = places.select(F.col("doc_id").alias("id"), F.explode(F.array(*(F.struct(F.lit(w).alias("at"), F.col(f"w{w}").alias("places")) for w in widths))).alias("p")).select("id", "p.*")
    long_enough = candidates.join(places, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("width") == F.col("at")) & (F.col("places") >= F.col("need")), "left_semi")
    pairs = long_enough.select(F.col("doc_id").alias("id"), F.col("item_id").alias("of"), F.col("width").alias("at"))
    wanted = known.join(pairs.select("of", "at").distinct(), F.col("item_id").eqNullSafe(F.col("of")) & (F.col("width") == F.col("at")), "left_semi")
    shared = _shingles(again, widths, ["doc_id"], True).join(wanted, ["width", "gram", "spelled"]).groupBy("doc_id", "item_id", "width", "n").agg(F.countDistinct("gram").alias("n_shared"))
    checked = shared.join(pairs, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("item_id").eqNullSafe(F.col("of")) & (F.col("width") == F.col("at")), "left_semi")
    return checked.where(100 * F.col("n_shared") >= percent * F.col("n")).select("doc_id", "item_id", "n_shared", F.col("n").alias("n_item"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without those that hold an item. Rows without an id stay unless a row without an id holds one."""
    bad = unused(docs.columns, "bad")
    ids = find_contained(docs, items, id_col=id_col, **options).select(F.col("doc_id").alias(bad)).distinct()
    return docs.join(ids, F.col(quoted(id_col)).eqNullSafe(F.col(bad)), "left_anti")
