"""Counterfactual-regularised toxicity classifier over word and subword evidence.

Score = sigmoid(bias + sum of g(word) over the distinct words of the whole text), g(word) = sum of the weights of the
word's features: the word itself, its beginnings and its character n-grams, so made-up variants share evidence.

Fit, on the driver, from a bounded sample of labelled rows (MAX_ROWS, by hash order; their features are extracted on
executors): features whose presence depends on the label (G-test) get weights by logistic regression with an L2 penalty and
a counterfactual one: for each labelled sentence that holds an identity term, the term is swapped with the others of its
set, and the squared change of the score is penalised. So a group's mention alone can't raise a score.

The fit counts a row's features as the score does: how many of its distinct words have the feature, without a limit. So the
fitted score of a labelled row is its score.

Nulls, empty texts and texts without words score sigmoid(bias). Labels that are null are not learned from; different
labels of one document count each. With no labels, or labels of one kind, every score is the smoothed label rate (0.5 without any).
Ties: features of equal evidence are ordered by their hash. Repeated rows are scored each; an empty table gives an empty result.
Ids are of any type. Very long texts: the distinct words of one text at a time are held. Other columns are ignored, whatever
they are called; keep_clean keeps them. Memory: a weight table of at most MAX_FEATURES, a bounded word cache.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, types as T
from pyspark.sql import functions as F

from .common import Batches, batch, each, numbered, quoted, release, released

MAX_ROWS = 10_000
MAX_FEATURES = 1_500
G_LEAST = 12.0
COUNTERFACTUAL = 4.0

#: Sets of terms that can stand for one another, in English, Spanish, French and German.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("girl", "boy"),
    ("she", "he"),
    ("her", "his"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("black", "white", "asian", "latino", "arab", "african"),
    ("immigrants", "natives", "refugees", "citizens"),
    ("old", "young"),
    ("disabled", "deaf", "blind"),
    ("mujeres", "hombres"),
    ("mujer", "hombre"),
    ("ella", "él"),
    ("ellas", "ellos"),
    ("niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos", "católicos"),
    ("inmigrantes", "nativos", "refugiados", "ciudadanos"),
    ("negros", "blancos", "asiáticos", "latinos", "árabes", "africanos"),
    ("femmes", "hommes"),
    ("femme", "homme"),
    ("elle", "il"),
    ("elles", "ils"),
    ("filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées", "catholiques"),
    ("immigrés", "natifs", "réfugiés", "citoyens"),
    ("noirs", "blancs", "asiatiques", "arabes", "africains"),
    ("frauen", "männer"),
    ("frau", "mann"),
    ("sie", "er"),
    ("mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten", "katholiken"),
    ("einwanderer", "einheimische", "flüchtlinge", "bürger"),
    ("schwarze", "weiße", "asiaten", "araber", "afrikaner"),
)
_SWAPS = {w: tuple(dict.fromkeys(x for group in IDENTITY_TERMS if w in group for x in group if x != w)) for group in IDENTITY_TERMS for w in group}
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def distinct_words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features(word: str) -> list[int]:
    """Hashes of the word, its beginnings of 4 to 6 letters and its inner n-grams of 5."""
    found = {f"={word}"} | {f"^{word[:k]}" for k in (4, 5, 6) if len(word) > k} | {word[i : i + 5] for i in range(1, len(word) - 4)}
    return [xxhash.xxh3_64_intdigest(x) >> 1 for x in found]


@dataclass
class Model:
    bias: float
    weights: dict[int, float] = field(default_factory=dict)

    def word(self, word: str) -> float:
        return sum(self.weights.get(x, 0.0) for x in features(word))


def counterfactuals(text: str | None) -> Iterable[tuple[str, str]]:
    """(term, other term) for each identity term of each sentence; a sentence's distinct words change by just that."""
    for sentence in _SENTENCE.split(text or ""):
        present = distinct_words(sentence)
        for term in present & _SWAPS.keys():
            for other in _SWAPS[term]:
                if other not in present:
                    yield term, other


class WordFeatures(dict):
    """Word -> its features, some 600 bytes. Cleared when it has `most` entries, to bound memory."""

    most = 60_000

    def __missing__(self, word: str) -> list[int]:
        if len(self) >= self.most:
            self.clear()
        self[word] = found = features(word)
        return found


def _count(batches: Batches) -> Batches:
    """(feature, rows of label 1, rows) of a partition, in parts of bounded size."""
    schema = pa.schema([("feature", pa.int64()), ("pos", pa.int64()), ("df", pa.int64())])
    known, pos, df = WordFeatures(), Counter(), Counter()
    for b in batches:
        for label, text in zip(b.column(0).to_pylist(), each(b.column(1)), strict=True):
            found = {x for w in distinct_words(text) for x in known[w]}
            df.update(found)
            if label == 1:
                pos.update(found)
            if len(df) > 250_000:
                yield batch(schema, list(df), [pos[x] for x in df], list(df.values()))
                pos, df = Counter(), Counter()
    yield batch(schema, list(df), [pos[x] for x in df], list(df.values()))


def _extract(chosen) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        schema = pa.schema([("label", pa.int32()), ("features", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("swaps", pa.list_(pa.string()))])
        known, wanted = WordFeatures(), chosen.value
        for b in batches:
            rows = []
            for label, text in zip(b.column(0).to_pylist(), each(b.column(1)), strict=True):
                counts = Counter(x for w in distinct_words(text) for x in known[w] if x in wanted)
                rows.append((label, list(counts), list(counts.values()), sorted({f"{a} {c}" for a, c in counterfactuals(text)})))
            yield batch(schema, *(zip(*rows, strict=True) if rows else [[]] * 4))

    return run


def fit(labelled: DataFrame, counterfactual: float = COUNTERFACTUAL) -> Model:
    """labelled: label (0 or 1), text; at most MAX_ROWS rows. The driver gets MAX_FEATURES features and the rows' share of these."""
    n, n1 = labelled.agg(F.count("label"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if n1 in (0, n):
        rate = (n1 + 1) / (n + 2)
        return Model(math.log(rate / (1 - rate)))
    counted = labelled.mapInArrow(released(_count), "feature long, pos long, df long").groupBy("feature").agg(F.sum("pos").alias("p"), F.sum("df").alias("df")).where("df >= 5")

    def term(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    p, df = F.col("p"), F.col("df")
    g = 2 * (term(p, df * n1 / n) + term(df - p, df * (n - n1) / n) + term(n1 - p, (n - df) * n1 / n) + term(n - n1 - df + p, (n - df) * (n - n1) / n))
    best = counted.select("feature", g.alias("g")).where(F.col("g") >= G_LEAST).orderBy(F.desc("g"), "feature").limit(MAX_FEATURES).collect()
    of_terms = {x for w in _SWAPS for x in features(w)}  # a fixed list
    chosen = labelled.sparkSession.sparkContext.broadcast({r[0] for r in best} | of_terms)
    rows = labelled.mapInArrow(released(_extract(chosen)), "label int, features array<long>, counts array<int>, swaps array<string>").toArrow()
    model = _fit_rows(rows, sorted(chosen.value), counterfactual)
    del rows
    release()
    return model


def _fit_rows(rows: pa.Table, names: list[int], counterfactual: float) -> Model:
    """Features that no row and no swap holds would get the weight 0, so they get no column."""
    pairs = Counter(s for swap in rows.column("swaps").to_pylist() for s in swap)
    y = np.asarray(rows.column("label").to_pylist(), dtype=np.float32)
    found = [rows.column(c).combine_chunks() for c in ("features", "counts")]
    flat, counts = (np.asarray(f.flatten()) for f in found)
    starts = np.concatenate([[0], np.cumsum(np.asarray(found[0].value_lengths()))])
    names = np.intersect1d(names, np.concatenate([flat, *(features(w) for pair in pairs for w in pair.split())]))
    x = Evidence(starts, np.searchsorted(names, flat).astype(np.int32), counts.astype(np.float32), len(names))
    del flat, counts, found, rows
    change = np.zeros((len(pairs), len(names)), dtype=np.float32)
    for k, pair in enumerate(pairs):
        for w, sign in zip(pair.split(), (-1, 1), strict=True):
            for f in features(w):
                change[k, np.searchsorted(names, f)] += sign
    w, b = _newton(x, y, change, np.array(list(pairs.values()), dtype=np.float32), counterfactual)
    return Model(float(b), {int(name): float(v) for name, v in zip(names, w, strict=True) if v})


@dataclass
class Evidence:
    """The rows' feature counts: those of row i are at starts[i] to starts[i + 1]. Dense only a block of rows at a time."""

    starts: np.ndarray
    columns: np.ndarray
    counts: np.ndarray
    width: int

    def blocks(self, rows: int = 1_024) -> Iterable[tuple[slice, np.ndarray]]:
        """(place, counts of the block's rows, a last column of ones)."""
        for first in range(0, len(self.starts) - 1, rows):
            at = self.starts[first : first + rows + 1]
            dense = np.zeros((len(at) - 1, self.width + 1), dtype=np.float32)
            dense[:, -1] = 1
            inside = slice(at[0], at[-1])
            dense[np.repeat(np.arange(len(at) - 1), np.diff(at)), self.columns[inside]] = self.counts[inside]
            yield slice(first, first + len(dense)), dense


def _newton(x: Evidence, y, change, times, counterfactual: float, l2: float = 1e-4, steps: int = 12) -> tuple[np.ndarray, float]:
    """Newton's method on the mean log loss + L2 + mean squared score change over the counterfactual pairs."""
    n, k = len(y), x.width
    share = counterfactual * times / max(1.0, float(times.sum()))
    still = np.zeros((k + 1, k + 1))
    still[:k, :k] = 2 * (change.T * share) @ change
    still[np.arange(k), np.arange(k)] += 2 * l2
    w = np.zeros(k + 1)
    w[k] = math.log((y.sum() + 1) / (n - y.sum() + 1))
    for _ in range(steps):
        slope, curve = still @ w, still.copy()
        for place, block in x.blocks():
            p = 1 / (1 + np.exp(-np.clip(block @ w.astype(np.float32), -30, 30)))
            slope += (p - y[place]) @ block / n
            curve += (block.T * (p * (1 - p) / n)) @ block
        curve[k, k] += 1e-9
        step = np.linalg.solve(curve, slope)
        w -= step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-3:
            break
    return w[:k], w[k]


class WordWeights(dict):
    """Word -> its weight. Cleared when it has `most` entries, to bound memory."""

    def __init__(self, model: Model, most: int = 250_000):
        super().__init__()
        self.model, self.most = model, most

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = self.model.word(word)
        return value

    def score(self, text: str | None) -> float:
        total = self.model.bias + math.fsum(map(self.__getitem__, distinct_words(text)))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, total))))


def _score(model: Model) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        known = WordWeights(model)
        for b in batches:
            scores = [known.score(t) for t in each(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=[b.schema.names[0], "score"])

    return run


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns the id and a score in (0, 1) for every row."""
    given = docs.select(F.col(quoted(id_col)), F.col(quoted(text_col)).cast("string"))
    return given.mapInArrow(released(_score(model)), T.StructType([given.schema[0], T.StructField("score", T.DoubleType())]))


def _keep(model: Model, at: int, threshold: float) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        known = WordWeights(model)
        for b in batches:
            yield b.filter(pa.array([known.score(t) < threshold for t in each(b.column(at))], pa.bool_()))

    return run


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs whose text scores below the threshold, in the same pass; all columns stay. The text is a string column.

    A model without weights (no labels, labels of one kind, no telling feature) knows nothing of any text: all documents stay.
    """
    if not model.weights:
        return docs
    given = numbered(docs)
    return given.mapInArrow(released(_keep(model, docs.columns.index(text_col), threshold)), given.schema).toDF(*docs.columns)


def learn(docs: DataFrame, labels: DataFrame, label: str, allowed, max_rows: int = MAX_ROWS) -> DataFrame:
    """(label, text) of at most max_rows labelled documents for which `allowed` holds, by hash order of the id.

    Of rows that share an id, the text of the smallest hash is learned from; different labels of a document give a row each.
    """
    chosen = labels.where(F.col(quoted(label)).isNotNull() & F.col("doc_id").isNotNull() & allowed).select(F.col("doc_id").alias("of"), F.col(quoted(label)).cast("int").alias("label"))
    chosen = chosen.distinct().orderBy(F.xxhash64("of"), "of", "label").limit(max_rows)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    met = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("of"))  # max_rows ids at most
    place = F.row_number().over(Window.partitionBy("of", "label").orderBy(F.xxhash64("text")))  # cut to one before the shuffle, too
    return met.withColumn("place", place).where("place = 1").select("label", "text")
