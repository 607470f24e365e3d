"""A toxicity classifier with counterfactual regularisation.

Logistic regression on the distinct words of a text and their beginnings. Each labelled text has a counterfactual: where it
mentions a group, a copy in which identity terms are swapped; where it mentions none, a term is placed into it, and into a
copy the term that takes its place. The squared change of the score's logit within such a pair is penalised, so that the
words that name a group, and what they begin with, don't carry weight of their own and neutral mentions aren't flagged.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common

#: Most labelled documents to learn from: those of the smallest hashes.
TRAIN_ROWS = 20_000
FEATURES, MIN_DOCS = 4000, 3
SWAP_PENALTY, RIDGE = 1.0, 2e-5
ROUNDS = 400
KNOWN_WORDS = 100_000
BEGINNINGS, END = range(3, 9), "$"
SIGNS = ".,;:!?\"'()[]{}<>*_-#~`«»“”„’‘…"
#: Terms that name a group, each with the one that takes its place.
IDENTITY_TERMS = {
    "women": "men", "men": "women", "woman": "man", "man": "woman", "gay": "straight", "straight": "gay", "black": "white", "white": "black",
    "muslim": "christian", "christian": "jewish", "jewish": "muslim", "muslims": "christians", "christians": "jews", "jews": "muslims",
    "immigrants": "citizens", "citizens": "immigrants", "transgender": "cisgender", "cisgender": "transgender",
    "frauen": "männer", "männer": "frauen", "femmes": "hommes", "hommes": "femmes", "mujeres": "hombres", "hombres": "mujeres",
}


def features_of(raw: str) -> tuple[str, ...]:
    """Features of a raw word, in lower case without the signs around it: the word, with a mark at its end, and its beginnings."""
    word = raw.strip(SIGNS)
    return (word + END, *[word[:k] for k in BEGINNINGS if k <= len(word)]) if word else ()


class _Features(dict):
    """Features of raw words that have been met."""

    def __missing__(self, raw: str) -> tuple[str, ...]:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        out = features_of(raw)
        if len(raw) <= 64:
            self[raw] = out
        return out


_features = _Features()
common.remember("toxicity", _features)


def features(text: str) -> set[str]:
    """The distinct features of a whole text."""
    return set().union(*map(_features.__getitem__, set(text.lower().split())))


def swapped(text: str, terms: dict[str, str]) -> set[str] | None:
    """The features after swapping identity terms; None if there are none."""
    words = [w.strip(SIGNS) for w in text.lower().split()]
    if not any(w in terms for w in words):
        return None
    return features(" ".join(terms.get(w, w) for w in words))


def counterfactual(text: str, terms: dict[str, str]) -> tuple[set[str], set[str]]:
    """The features that only one, and only the other, of a text's pair has: the text and its copy with identity terms
    swapped, or, if it holds none, the text with a term (chosen by the text's features) and with the one in its place."""
    own = features(text)
    if not terms:
        return set(), set()
    other = swapped(text, terms)
    if other is None:
        names = sorted(terms)
        term = names[xxhash.xxh3_64_intdigest("\0".join(sorted(own))) % len(names)]
        own, other = own | features(term), own | features(terms[term])
    return own - other, other - own


def learnable(doc_id: Column, folds: int = 5, held_out: int = 0) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) != held_out


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, toxic) of at most `rows` labelled documents outside the held-out fold."""
    common.long_rows(docs.sparkSession)
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(learnable(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.join(F.broadcast(known), "doc_id").select("text", "toxic")


def telling(learnt: DataFrame, n_toxic: int, n_clean: int, most: int = FEATURES, terms: dict[str, str] = IDENTITY_TERMS) -> list[str]:
    """The features whose presence tells most about the label - log ratio of their shares, times the root of their
    documents - and those of the identity terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.serve("toxicity")
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(common.texts_of(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                found[toxic].update(features(text))
        names = list(found[0].keys() | found[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in found)], ["feature", "clean", "toxic"])

    counts = learnt.mapInArrow(run, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    share = (F.col("toxic") + 0.5) / (n_toxic + 1) / ((F.col("clean") + 0.5) / (n_clean + 1))
    told = F.abs(F.log(share)) * F.sqrt(F.col("clean") + F.col("toxic"))
    best = counts.where(F.col("clean") + F.col("toxic") >= MIN_DOCS).select("feature", told.alias("told")).orderBy(F.desc("told"), "feature").limit(most)
    named = set().union(*(features(t) for t in terms))
    return sorted(named.union(r["feature"] for r in best.select("feature").collect()))


def examples(learnt: DataFrame, columns: list[str], terms: dict[str, str] = IDENTITY_TERMS) -> DataFrame:
    """(toxic, place, words, more, less) of each text: a hash of its features, the places in columns of its features, and
    of those that only one and only the other of its counterfactual pair has."""
    chosen = learnt.sparkSession.sparkContext.broadcast({f: n for n, f in enumerate(columns)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.serve("toxicity")
        known = chosen.value
        for batch in batches:
            found: list[list] = [[], [], []]
            for text in common.texts_of(batch.column(0)):
                for out, names in zip(found, (features(text), *counterfactual(text, terms)), strict=True):
                    out.append(sorted(known[f] for f in names & known.keys()))
            place = [xxhash.xxh3_64_intdigest(np.array(w + [-1] + m + [-1] + n, np.int32).tobytes()) >> 1 for w, m, n in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(place, pa.int64()), *(pa.array(x, pa.list_(pa.int32())) for x in found)], ["toxic", "place", "words", "more", "less"])

    return learnt.mapInArrow(run, "toxic int, place long, words array<int>, more array<int>, less array<int>")


class Ones:
    """Sparse rows of 0 and 1, as places of the ones: a column of lists."""

    def __init__(self, column: pa.ChunkedArray | pa.Array, width: int):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        self.n, self.width = len(column), width
        self.cols = column.flatten().to_numpy().astype(np.int64)
        self.row = np.repeat(np.arange(self.n), np.diff(column.offsets.to_numpy()))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.cols], self.n)

    def turned_dot(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, g[self.row], self.width)


def fit(toxic: np.ndarray, words: Ones, more: Ones, less: Ones, penalty: float = SWAP_PENALTY, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights of the features and the intercept, by Adam on the mean logistic loss, ridge and swap penalty: the mean
    over the pairs that differ of the squared change of the logit."""
    y = np.asarray(toxic, np.float64)
    share = (y.sum() + 0.5) / (len(y) + 1)
    pairs = len(np.union1d(more.row, less.row))
    w, b = np.zeros(words.width), float(np.log(share / (1 - share)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        err = (1 / (1 + np.exp(-np.clip(words.dot(w) + b, -40, 40))) - y) / len(y)
        g, gb = words.turned_dot(err) + RIDGE * w, err.sum()
        if pairs:
            d = 2 * penalty * (more.dot(w) - less.dot(w)) / pairs
            g += more.turned_dot(d) - less.turned_dot(d)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.1 * (1 - t / (rounds + 1))
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-9)
    return w, float(b)


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, penalty: float = SWAP_PENALTY, report: dict[str, int] | None = None) -> tuple[dict[str, float], float]:
    """Fit on a bounded sample. Without both classes there are no weights, and the score is the class's share.

    The rows are put in order, so that the fit doesn't depend on how they are dealt. report, if given, is told the number
    of texts, and of pairs whose scores could differ.
    """
    learnt = common.materialize(sample(docs, labels, rows), "labelled")
    n = {r["toxic"]: r["count"] for r in learnt.groupBy("toxic").count().collect()}
    if report is not None:
        report |= {"texts": sum(n.values()), "pairs": 0}
    if not n.get(0) or not n.get(1):
        share = (n.get(1, 0) + 0.5) / (sum(n.values()) + 1)
        return {}, float(np.log(share / (1 - share)))
    columns = telling(learnt, n[1], n[0])
    table = examples(learnt, columns).toArrow()
    table = table.take(pa.array(np.lexsort((table["place"].to_numpy(), table["toxic"].to_numpy()))))
    words, more, less = (Ones(table[x], len(columns)) for x in ("words", "more", "less"))
    if report is not None:
        report["pairs"] = len(np.union1d(more.row, less.row))
    weights, intercept = fit(table["toxic"].to_numpy(), words, more, less, penalty)
    return dict(zip(columns, weights.tolist(), strict=True)), intercept


def with_scores(docs: DataFrame, weights: dict[str, float], intercept: float, columns: list[str]) -> DataFrame:
    """The columns named, and score; each text is scored whole. Null and empty texts score by the intercept alone."""
    common.long_rows(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast((weights, intercept))
    kept = docs.select(*columns, F.col("text").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.serve("toxicity")
        table, b = model.value
        none: frozenset[str] = frozenset()
        known: dict[str, frozenset[str]] = {}  # of each word the features that have a weight
        for batch in batches:
            z = []
            for text in common.texts_of(batch.column(batch.num_columns - 1)):
                if len(known) > 3 * KNOWN_WORDS:
                    known.clear()
                words = set(text.lower().split())
                found = set()
                for w in words:
                    hits = known.get(w)
                    if hits is None:
                        hits = frozenset(f for f in features_of(w) if f in table) or none
                        if len(w) <= 64:
                            known[w] = hits
                    if hits:
                        found |= hits
                z.append(b + math.fsum(map(table.__getitem__, found)))
            score = 1 / (1 + np.exp(-np.clip(np.array(z, np.float64), -700, 700)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64())], [*batch.schema.names[:-1], "score"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields[:-1], T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Score every document after learning from labels outside the held-out fold.

    Needs docs (doc_id, text) and labels (doc_id, toxic); other columns are ignored, and so are labels that are neither
    0 nor 1 or have no doc_id. One row per row of docs: doc_id, held_out, score, predicted. A null doc_id is not held
    out. An empty table gives no rows; without labels of both classes every score is the labels' share.
    """
    weights, intercept = learn(docs, labels, rows)
    scored = with_scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), weights, intercept, ["doc_id"])
    return scored.select("doc_id", F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
