"""Language identification by unigram models over a public vocabulary, with all segmentations summed.

A language gives each piece of a fixed vocabulary a probability. A word's probability is the sum over all ways to cut it
into pieces of the product of their probabilities, computed by a forward pass; a text's is the product over its words.
The probabilities are learnt by expectation maximisation, with the same sum over segmentations, from a bounded sample of
texts for each language.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common

#: Most texts to learn a language from: those of the smallest hashes.
TRAIN_ROWS = 400
#: Signs after which a letter run is cut when it is learnt from: its probability stays in range.
STRETCH = 60
ROUNDS = 3
#: The count that every piece has besides, and the probability of a sign that no piece covers.
ADDED, UNKNOWN = 0.05, 1e-9
START = "▁"
KNOWN_PARTS = 400_000
#: Signs of a word up to which words are scored together: products of so many probabilities stay in range.
BATCHED = 30
#: Parts of texts that are looked up together.
GATHER = 20_000
UNDETERMINED = "und"

_letters = regex.compile(r"\p{L}+").findall


def vocabulary(path: str) -> list[str]:
    """The letter pieces of a sentencepiece model, in lower case: those that words are made of."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in pieces if p.strip(START) and all(c.isalpha() for c in p.lstrip(START)) and p.count(START) <= 1)


def words_of(part: str) -> list[str]:
    """Letter runs in lower case, each with the mark of a word's start."""
    if part.isalpha():
        return [START + part.lower()]
    if part[:-1].isalpha():
        return [START + part[:-1].lower()]
    return [START + w for w in _letters(part.lower())]


def parts_of(text: str) -> list[str]:
    """A text in lower case, cut at white space and at the commonest signs, none of which is a letter."""
    text = text.lower()
    for sign in ".,;:!?|":
        if sign in text:
            text = text.replace(sign, " ")
    return text.split()


def forward(word: str, pieces: dict[str, tuple[float, ...]], longest: int, unknown: tuple[float, ...]) -> list[float]:
    """Natural logarithms of the word's probability in each language, summed over all segmentations."""
    n, k = len(word), len(unknown)
    ways: list[list[float]] = [[1.0] * k]
    scale = 0.0
    for end in range(1, n + 1):
        now = [0.0] * k
        for start in range(max(0, end - longest), end):
            p = pieces.get(word[start:end])
            if p is None:
                if start < end - 1:
                    continue
                p = unknown
            before = ways[start]
            for lang in range(k):
                now[lang] += before[lang] * p[lang]
        ways.append(now)
        if max(now) < 1e-120:  # all that later steps look at grows alike
            scale += math.log(1e120)
            for x in range(max(0, end - longest), end + 1):
                ways[x] = [y * 1e120 for y in ways[x]]
    return [math.log(max(x, 1e-300)) - scale for x in ways[n]]


class Model:
    """Piece probabilities by language, laid out for many words at a time."""

    def __init__(self, pieces: dict[str, tuple[float, ...]], languages: int):
        self.pieces, self.longest, self.unknown = pieces, max(map(len, pieces), default=1), (UNKNOWN,) * languages
        self.rows = np.array([*pieces.values(), self.unknown]).reshape(-1, languages)
        #: A piece's row; -1 for what only begins pieces.
        self.place = {p[:n]: -1 for p in pieces for n in range(1, len(p))}
        self.place |= {p: n for n, p in enumerate(pieces)}

    def logs(self, words: list[str]) -> np.ndarray:
        """forward() of each word (words x languages)."""
        out = np.zeros((len(words), self.rows.shape[1]))
        for a in range(0, len(words), 4096):
            out[a : a + 4096] = self._logs(words[a : a + 4096])
        return out

    def _logs(self, words: list[str]) -> np.ndarray:
        get, edges = self.place.get, []
        add, unknown = edges.append, len(self.pieces)
        for n, word in enumerate(words):
            size = len(word)
            if size > BATCHED:
                continue
            for start in range(size):
                head = (n << 10 | start << 5) << 20
                row = get(word[start], -1)
                add(head | (start + 1) << 50 | (row if row >= 0 else unknown))
                for end in range(start + 2, size + 1):
                    row = get(word[start:end])
                    if row is None:
                        break
                    if row >= 0:
                        add(head | end << 50 | row)
        ways = np.zeros((len(words), BATCHED + 1, self.rows.shape[1]))
        ways[:, 0] = 1
        arcs = np.sort(np.array(edges, np.int64))  # by end, then by word
        end, word, start, row = arcs >> 50, arcs >> 30 & 0xFFFFF, arcs >> 25 & 31, arcs & 0xFFFFF
        bounds = np.searchsorted(end, np.arange(BATCHED + 2))
        for e in range(1, BATCHED + 1):
            some = slice(bounds[e], bounds[e + 1])
            if bounds[e] < bounds[e + 1]:
                at = word[some]
                first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                ways[at[first], e] = np.add.reduceat(ways[at, start[some]] * self.rows[row[some]], first)
        sizes = np.array([len(w) for w in words])
        out = np.log(np.maximum(ways[np.arange(len(words)), np.minimum(sizes, BATCHED)], 1e-300))
        for n in np.flatnonzero(sizes > BATCHED):
            out[n] = forward(words[n], self.pieces, self.longest, self.unknown)
        return out


def learn_pieces(words: Counter, vocab: list[str], rounds: int = ROUNDS, signs: int | None = None) -> dict[str, float]:
    """Piece probabilities of one language by expectation maximisation over its words (with `signs`, of at most so many) and
    their counts. Letter runs of more than STRETCH signs count as several words of that length."""
    long = [w for w in words if len(w) > STRETCH]
    if long:
        words = Counter(words)
        for w in long:
            times = words.pop(w)
            if signs is None or len(w) <= signs:
                for a in range(0, len(w), STRETCH):
                    words[w[a : a + STRETCH]] += times
    words = Counter({w: n for w, n in words.items() if signs is None or len(w) <= signs})
    place = {p[:n]: -1 for p in vocab for n in range(1, len(p))} | {p: n for n, p in enumerate(vocab)}
    names = list(words)
    lattices = [Lattice(names[a : a + 8192], place, len(vocab)) for a in range(0, len(names), 8192)]
    times = np.array([words[w] for w in names], np.float64)
    prob = np.full(len(vocab), 1 / max(len(vocab), 1))
    for _ in range(rounds):
        found = np.zeros(len(vocab) + 1)
        for k, lattice in enumerate(lattices):
            found += lattice.expected(np.append(prob, UNKNOWN), times[k * 8192 : (k + 1) * 8192])
        prob = (found[:-1] + ADDED) / (found[:-1].sum() + ADDED * len(vocab))
    return dict(zip(vocab, prob.tolist(), strict=True))


class Lattice:
    """All pieces at all places of some words: arcs from start to end, by which segmentations are summed."""

    def __init__(self, words: list[str], place: dict[str, int], unknown: int):
        get, arcs = place.get, []
        for n, word in enumerate(words):
            size = len(word)
            for start in range(size):
                row = get(word[start], -1)
                arcs.append((n, start, start + 1, row if row >= 0 else unknown))
                for end in range(start + 2, size + 1):
                    row = get(word[start:end])
                    if row is None:
                        break
                    if row >= 0:
                        arcs.append((n, start, end, row))
        self.word, self.start, self.end, self.row = np.array(arcs, np.int64).reshape(-1, 4).T
        self.sizes, self.rows = np.array([len(w) for w in words]), unknown + 1

    def _sums(self, prob: np.ndarray, ways: np.ndarray, at: np.ndarray, other: np.ndarray, steps: range) -> np.ndarray:
        order = np.lexsort((self.word, at))
        bounds = np.searchsorted(at[order], np.arange(ways.shape[1] + 1))
        for k in steps:
            some = order[bounds[k] : bounds[k + 1]]
            if len(some):
                word = self.word[some]
                first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                ways[word[first], k] += np.add.reduceat(ways[word, other[some]] * prob[self.row[some]], first)
        return ways

    def expected(self, prob: np.ndarray, times: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the words, given how often they occur."""
        n, most = len(self.sizes), int(self.sizes.max(initial=0))
        ahead, back = np.zeros((n, most + 1)), np.zeros((n, most + 1))
        ahead[:, 0] = 1
        self._sums(prob, ahead, self.end, self.start, range(1, most + 1))
        back[np.arange(n), self.sizes] = 1
        self._sums(prob, back, self.start, self.end, range(most, -1, -1))
        whole = ahead[np.arange(n), self.sizes]
        share = np.where(whole > 0, times / np.where(whole > 0, whole, 1), 0)
        return np.bincount(self.row, share[self.word] * ahead[self.word, self.start] * prob[self.row] * back[self.word, self.end], self.rows)


def learnable(doc_id: Column, folds: int = 4, held_out: int = 2) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) != held_out


def training_ids(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, lang) of the `rows` smallest hashes of each language outside the held-out fold.

    A histogram of the hashes' leading bits tells up to which of them the rows lie, so that no task ranks more of a
    language than about the rows it keeps.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).where("lang is not null and doc_id is not null").where(learnable(F.col("doc_id")))
    ids = ids.distinct().withColumn("hash", F.xxhash64("doc_id")).withColumn("bin", F.shiftright("hash", 48))
    counts = ids.groupBy("lang", "bin").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("bin")) - F.col("n")
    cuts = counts.withColumn("before", before).where(F.col("before") < rows).groupBy("lang").agg(F.max("bin").alias("cut"))
    order = Window.partitionBy("lang").orderBy("hash", "doc_id")
    return ids.join(cuts, "lang").where("bin <= cut").withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows).select("doc_id", "lang")


def learn(docs: DataFrame, vocab_path: str, rows: int = TRAIN_ROWS, types: int | None = None, signs: int | None = None) -> tuple[list[str], dict[str, tuple[float, ...]]]:
    """Languages and their piece probabilities, from at most `rows` texts of each language outside the held-out fold.

    All words of these texts count; with `types` only so many of the commonest of each language, with `signs` only those
    of at most so many signs (the mark of the word's start is one).
    """
    common.long_rows(docs.sparkSession)
    sample = common.materialize(training_ids(docs, rows), "language-sample")
    sample = F.broadcast(sample) if sample.count() <= common.BROADCAST_IDS else sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.serve("langid")
        counts: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), common.texts_of(batch.column(1)), strict=True):
                counts.update((lang, w) for p in parts_of(text) for w in words_of(p))
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())], ["lang", "word", "n"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(sample, "doc_id").select("lang", "text")
    counted = text.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    top = counted if types is None else counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("rank") <= types)
    words: dict[str, Counter] = {}
    for r in top.select("lang", "word", "n").toArrow().to_pylist():
        words.setdefault(r["lang"], Counter())[r["word"]] = r["n"]
    langs = sorted(words)
    vocab = vocabulary(vocab_path)
    learnt = [learn_pieces(Counter(dict(sorted(words[x].items()))), vocab, signs=signs) for x in langs]
    return langs, {p: tuple(m[p] for m in learnt) for p in vocab}


def with_languages(docs: DataFrame, langs: list[str], pieces: dict[str, tuple[float, ...]], columns: list[str], other: float | None = None) -> DataFrame:
    """The columns named, lang_pred and score (the posterior of the predicted language, all languages alike before).

    Texts that are null or have no letter, and all texts if nothing was learnt, are `und` with score 0. With `other`, that
    is the probability beforehand that a text is in none of the languages, but in one that has all pieces alike; a text
    that this explains best is `und` too, with that posterior.
    """
    before = np.zeros(len(langs))
    if other is not None and langs:
        langs, pieces = [*langs, UNDETERMINED], {p: (*x, 1 / len(pieces)) for p, x in pieces.items()}
        before = np.log([(1 - other) / (len(langs) - 1)] * (len(langs) - 1) + [other])
    common.long_rows(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(pieces)
    k = len(langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.serve("langid")
        model = Model(table.value, k) if k else None
        at: dict[str, int] = {}
        rows = np.zeros((KNOWN_PARTS, k + 1))  # of each part: sums of logarithms by language, and the number of words

        def sums(parts: list[str]) -> np.ndarray:
            if len(at) + len(parts) > KNOWN_PARTS:
                at.clear()
            where = list(map(at.get, parts))
            if None in where:
                new = list(dict.fromkeys(p for p, n in zip(parts, where, strict=True) if n is None))
                words = [words_of(p) for p in new]
                logs = model.logs([w for ws in words for w in ws])
                total = np.zeros((len(new), k + 1))
                owner = np.repeat(np.arange(len(new)), [len(ws) for ws in words])
                np.add.at(total[:, :k], owner, logs)
                total[:, k] = [len(ws) for ws in words]
                rows[len(at) : len(at) + len(new)] = total
                at.update(zip(new, range(len(at), len(at) + len(new)), strict=True))
                where = list(map(at.__getitem__, parts))
            return rows[where]

        for batch in batches:
            pred, score = [], []
            totals = np.zeros((batch.num_rows, k + 1))
            held: list[str] = []
            owners: list[tuple[int, int]] = []  # (row of the batch, its parts that are held)

            def settle() -> None:
                if held and k:  # noqa: B023
                    starts = np.cumsum([0, *(n for _, n in owners[:-1])])  # noqa: B023
                    for (n, _), total in zip(owners, np.add.reduceat(sums(held), starts), strict=True):  # noqa: B023
                        totals[n] += total  # noqa: B023
                held.clear()  # noqa: B023
                owners.clear()  # noqa: B023

            for n, text in enumerate(common.texts_of(batch.column(batch.num_columns - 1))):
                parts = parts_of(text)
                for a in range(0, len(parts), GATHER):
                    some = parts[a : a + GATHER]
                    held.extend(some)
                    owners.append((n, len(some)))
                    if len(held) >= GATHER:
                        settle()
            settle()
            for total in totals:
                if total[k] > 0:
                    total[:k] += before
                    best = int(total[:k].argmax())
                    pred.append(langs[best])
                    score.append(float(1 / np.exp(np.clip(total[:k] - total[best], -700, 0)).sum()))
                else:
                    pred.append(UNDETERMINED)
                    score.append(0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    kept = docs.select(*columns, F.col("text").cast("string").alias("_text"))
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def with_letters(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns named, of the texts that have a letter: those that with_languages names a language for if any was learnt."""
    common.long_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.serve("langid")
        for batch in batches:
            on = [n for n, text in enumerate(common.texts_of(batch.column(batch.num_columns - 1))) if any(words_of(p) for p in parts_of(text))]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1]).take(pa.array(on, pa.int64()))

    kept = docs.select(*columns, F.col("text").cast("string").alias("_text"))
    return kept.mapInArrow(run, T.StructType(kept.schema.fields[:-1]))


def identify(docs: DataFrame, vocab_path: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """Predict the language of every document after learning from the others' lang outside the held-out fold.

    Needs columns doc_id, text and lang; others are ignored. One row per row of docs: doc_id, held_out, lang_pred, score.
    A null doc_id is not held out. Repeated rows are predicted each; learning counts a doc_id once for each lang that it
    has, with all its texts. Texts may be of any length. Where no piece of the vocabulary covers a letter, all languages
    give it the same small probability. An empty table gives no rows.
    """
    langs, pieces = learn(docs, vocab_path, rows)
    named = with_languages(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), langs, pieces, ["doc_id"])
    return named.select("doc_id", F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
