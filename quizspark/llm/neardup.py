"""Near-duplicate detection: one-permutation MinHash with optimal densification, banded buckets, star-shaped edges.

Documents are linked when the Jaccard similarity of their shingle sets reaches the threshold; every link is confirmed
on the full sets (as sorted 64-bit shingle hashes). Components of the links are the groups.

1. Sketch: the sorted distinct hashes of a document fall into `bins` equal ranges; the first hash of a range is its
   minimum. An empty range takes the value of the filled range that comes first in its own random order (optimal
   densification), so ranges stay independent for short texts too. `rows` values make a band.
2. Rows with equal sets are one class, which removes groups of exact copies before any pair. A class is a node, named by the
   smallest record number among its rows; that row's text stands for it, so classes of one id are never mixed up.
3. Nodes that share a band are a bucket. Each node gets one edge to the smallest node of its bucket: as many edges as
   members. An edge is confirmed by intersecting both sets.
4. Exactness: where candidates that hang together (a cluster) still fall into several components, the members of all but its
   largest component meet the others block by block. Blocks hold bounded numbers of shingles and meet only where their
   set sizes allow a link; a cell of two blocks counts intersections over its shingles and returns links, never pairs.

With bins = 240, rows = 6 a pair at similarity 0.8 shares no band with probability (1 - 0.8**6)**40 < 6e-6.

Hot groups: exact copies meet only in partial aggregates and in a salted join; members of a large bucket are dealt by (bucket,
salt) with about SALTED to a part; the joins that remain on a bucket or an id move a few numbers a row and are left to the
splitting of skewed partitions at run time. Rows without words or id take no part in any join.

Nulls and texts without words: an empty set, linked with nothing. Rows without an id: no component, never linked. Rows that
share an id are one document: each text is compared by its own set, and all of them belong to one group (texts without words
excepted). Ids are of any type with an order; the smallest names the group, so ties don't arise. Repeated rows give repeated
result rows. An empty table gives an empty result. Very long texts: a set is 8 bytes a shingle, one text at a time. Other
columns are ignored, whatever they are called.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, batch, materialise, quoted, released, text_bytes, unused
from .shingles import WordHashes, mix, shingle_set, words

SALTED = 256
_SALTS = 16


def one_permutation(hashes: np.ndarray, edges: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The signature of sorted distinct hashes. edges: where the ranges begin; order[i]: the rank of each range for range i."""
    at = np.searchsorted(hashes, edges)
    filled = np.diff(at, append=len(hashes)) > 0
    out = hashes[np.minimum(at, len(hashes) - 1)]
    if not filled.all():
        have, lack = np.flatnonzero(filled), np.flatnonzero(~filled)
        out[lack] = out[have[np.argmin(order[np.ix_(lack, have)], axis=1)]]
    return out


def ranges(bins: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    edges = np.array([i * 2**64 // bins for i in range(bins)], dtype=np.uint64)
    rng = np.random.default_rng(seed)
    return edges, np.argsort(rng.random((bins, bins)), axis=1).argsort(axis=1).astype(np.int16)


def _sketch(shingle: int, bins: int, rows: int, seed: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        schema = pa.schema([("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))])
        known, (edges, order) = WordHashes(250_000), ranges(bins, seed)
        salt = mix(np.arange(1, bins // rows + 1, dtype=np.uint64))
        for b in batches:
            sizes, keys, bands = [], [], []
            for text in text_bytes(b.column(3)):
                s = shingle_set(known.of(words(text)), shingle)
                sizes.append(len(s))
                if not len(s):
                    keys.append(None)
                    bands.append(None)
                    continue
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                signature, out = one_permutation(s, edges, order).reshape(-1, rows), salt
                for j in range(rows):
                    out = mix(out + signature[:, j])
                bands.append(out.view(np.int64))
            made = batch(schema, sizes, keys, bands)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *made.columns], names=["row", "doc_id", "text_key", *schema.names])

    return run


def _sets(shingle: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        schema, known = pa.schema([("node", pa.int64()), ("hashes", pa.binary())]), WordHashes(250_000)
        for b in batches:
            yield batch(schema, b.column(0), [shingle_set(known.of(words(t)), shingle).tobytes() for t in text_bytes(b.column(1))])

    return run


def _confirm(percent: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch(schema, b.column(0), b.column(1)).filter(pa.array(keep, pa.bool_()))

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (u, v): alternating large-star and small-star steps until nothing changes."""
    edges, before = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large.union(edges.join(least, "u").select("u", F.col("m").alias("v")).where("u <> v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v")))
        edges = materialise(small.distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _open_clusters(members: DataFrame, candidates: DataFrame, roots: DataFrame) -> DataFrame:
    """(cluster, node, n, root, rest) for the nodes of buckets of over two members that hold several components.

    rest: the node is outside the largest component of its cluster. Two members were compared in full already.
    """
    labelled = members.where("members > 2").select("bucket", "node", "n", "members").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    salts = F.ceil(F.col("members") / SALTED).cast("int")
    labelled = labelled.withColumn("salt", F.pmod(F.xxhash64("node"), salts).cast("int"))
    parts = labelled.groupBy("bucket", "salt").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("members").alias("members"))
    mixed = parts.groupBy("bucket").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("members").alias("members")).where("lo <> hi")
    mixed = mixed.select("bucket", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    nodes = labelled.join(mixed, ["bucket", "salt"]).groupBy("node").agg(F.first("n").alias("n"), F.first("root").alias("root"))
    clusters = components(candidates.select("u", "v")).select("node", F.col("root").alias("cluster"))
    nodes = materialise(nodes.join(clusters, "node", "left").withColumn("cluster", F.coalesce("cluster", "node")))
    largest = nodes.groupBy("cluster", "root").count().groupBy("cluster").agg(F.max(F.struct("count", "root")).alias("top"), F.count("*").alias("roots"))
    nodes = nodes.join(largest.where("roots > 1").select("cluster", F.col("top.root").alias("top")), "cluster")
    return nodes.select("cluster", "node", "n", "root", (F.col("root") != F.col("top")).alias("rest"))


def _cells(nodes: DataFrame, sets: DataFrame, percent: int, most: int = 1 << 17) -> DataFrame:
    """Links between components of a cluster. A block holds about `most` shingles of sets whose sizes are within the threshold's ratio."""
    ratio = math.log(100 / percent) or 1.0
    sized = nodes.withColumn("step", F.floor(F.log("n") / ratio).cast("int"))
    blocks = sized.groupBy("cluster", "step", "rest").agg(F.ceil(F.greatest(F.sum("n") / most, F.count("*") / 512)).cast("int").alias("blocks"))
    blocks = materialise(blocks)
    own = sized.join(blocks, ["cluster", "step", "rest"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("blocks")
    own = materialise(own.join(sets, "node"), 64)
    left = own.where("rest").join(blocks.select("cluster", F.col("step").alias("to_step"), F.col("rest").alias("to_rest"), "blocks"), "cluster").where("abs(step - to_step) <= 1")
    left = left.select("cluster", F.col("step").alias("a"), F.col("block").alias("i"), F.col("to_rest").alias("side"), F.col("to_step").alias("b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), "node", "root", "n", "hashes")
    own = own.select(*(F.col(c).alias(c) for c in own.columns))  # other columns than the left side's
    right = own.join(blocks.where("rest").select("cluster", F.col("step").alias("from_step"), "blocks"), "cluster").where("abs(step - from_step) <= 1")
    right = right.select("cluster", F.col("from_step").alias("a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.col("rest").alias("side"), F.col("step").alias("b"), F.col("block").alias("j"), "node", "root", "n", "hashes")
    once = "not side or a < b or (a = b and i <= j)"  # blocks of the rest meet once
    key = ["cluster", "a", "i", "side", "b", "j"]
    return left.where(once).groupBy(*key).cogroup(right.where(once).groupBy(*key)).applyInArrow(_meet(percent), "u long, v long").distinct()


def _meet(percent: int) -> Callable:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        if left.num_rows and right.num_rows:
            lists = [np.frombuffer(x, np.uint64) for x in right.column("hashes").to_pylist()]
            hashes, owner = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            order = np.argsort(hashes, kind="stable")
            hashes, owner = hashes[order], owner[order]
            node, root, n = (right.column(c).to_numpy() for c in ("node", "root", "n"))
            for u, r, x in zip(*(left.column(c).to_pylist() for c in ("node", "root", "hashes")), strict=True):
                x = np.frombuffer(x, np.uint64)
                lo, hi = np.searchsorted(hashes, x, "left"), np.searchsorted(hashes, x, "right")
                width = hi - lo
                at = np.repeat(lo - np.cumsum(width) + width, width) + np.arange(width.sum())
                both = np.bincount(owner[at], minlength=len(lists))
                near = (100 * both >= percent * (len(x) + n - both)) & (root != r)
                _, one = np.unique(root[near], return_index=True)  # one link to a component is enough
                found += [(u, v) for v in node[near][one].tolist()]
        return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    return run


def _salted(rows: DataFrame, by: str) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(_SALTS)).cast("int"))


def _every_salt(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))


def _same_id(whole: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (u, v) that join the classes of rows with one id."""
    several = whole.select("doc_id", "set_key", F.xxhash64("set_key").alias("k"))
    split = several.groupBy("doc_id").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo <> hi").select("doc_id")
    rows = materialise(several.join(split, "doc_id").select("doc_id", "set_key").distinct().join(classes.select("set_key", "node"), "set_key").select("doc_id", "node"))
    least = rows.groupBy("doc_id").agg(F.min("node").alias("u"))
    return rows.join(least, "doc_id").where("node <> u").select("u", F.col("node").alias("v")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bins: int = 240, rows: int = 6, seed: int = 23, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns doc_id, n_shingles, component_id (smallest id of the group) and kept for every row of docs."""
    given = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    numbered = given.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text_key", "text")
    kind = given.schema["doc_id"].dataType.simpleString()
    sketch = f"row long, doc_id {kind}, text_key long, n_shingles long, set_key binary, bands array<long>"
    sketches = materialise(numbered.mapInArrow(released(_sketch(shingle, bins, rows, seed)), sketch))
    whole = sketches.where("set_key is not null and doc_id is not null")
    first = F.min(F.struct("row", "doc_id", "text_key", "n_shingles", "bands"))
    classes = whole.groupBy("set_key").agg(first.alias("s"), F.min("doc_id").alias("least"), F.count("*").alias("same"))
    classes = materialise(classes.select("set_key", F.col("s.row").alias("node"), F.col("s.n_shingles").alias("n"), F.col("s.doc_id").alias("doc_id"), F.col("s.text_key").alias("text_key"), "least", "same", F.col("s.bands").alias("bands")))
    in_bands = classes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = in_bands.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("centre"), F.count("*").alias("members")).where("members > 1")
    members = materialise(in_bands.join(materialise(shared), "bucket"))
    wanted = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "text_key")
    texts = given.join(wanted, ["doc_id", "text_key"]).groupBy("doc_id", "text_key", "node").agg(F.min("text").alias("text"))
    sets = materialise(texts.select("node", "text").mapInArrow(released(_sets(shingle)), "node long, hashes binary"))

    def confirm(pairs: DataFrame) -> DataFrame:
        """pairs: u, un, v, vn; sizes alone rule out many."""
        near = pairs.where(100 * F.least("un", "vn") >= percent * F.greatest("un", "vn")).select("u", "v").distinct()
        a = sets.select(F.col("node").alias("u"), F.col("hashes").alias("x"))
        b = sets.select(F.col("node").alias("v"), F.col("hashes").alias("y"))
        return materialise(near.join(b, "v").join(a, "u").select("u", "v", "x", "y").mapInArrow(released(_confirm(percent)), "u long, v long"))

    candidates = members.where("node <> centre.node").select(F.col("centre.node").alias("u"), F.col("centre.n").alias("un"), F.col("node").alias("v"), F.col("n").alias("vn"))
    links = confirm(candidates).union(_same_id(whole, classes))
    roots = components(links)
    rest = _open_clusters(members, candidates, roots)
    more = materialise(_cells(rest, sets, percent))
    if not more.isEmpty():
        roots = components(links.union(more))
    return _labelled(sketches, classes, roots)


def _labelled(sketches: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """Every row with the smallest id of its group. Rows of classes that stand alone meet nothing."""
    roots = roots.union(roots.select("root", "root").distinct())  # a group's own root too
    rooted = _salted(classes.select("set_key", "node", "least").join(roots, "node"), "node")
    groups = _every_salt(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    linked = rooted.join(groups, ["root", "salt"]).select("set_key", "component_id")
    copies = classes.where("same > 1").join(roots, "node", "left_anti").select("set_key", F.col("least").alias("component_id"))
    keyed = _every_salt(linked.union(copies))
    inside = _salted(sketches.where("set_key is not null and doc_id is not null").select("row", "doc_id", "n_shingles", "set_key"), "row").join(keyed, ["set_key", "salt"], "left")
    outside = sketches.where("set_key is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = inside.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).union(outside)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the near-duplicates of a smaller id. Rows that share an id stay together; rows without one stay."""
    gone = unused(docs.columns, "gone")
    ids = near_duplicates(docs, id_col=id_col, **options).where("kept = false").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(ids, F.col(quoted(id_col)) == F.col(gone), "left_anti")
