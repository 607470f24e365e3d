"""Quality selection by importance resampling.

Two generative models over hashed word unigrams and bigrams are counted: one of target text (a bounded sample of
documents labelled as good), one of all raw text. A document's weight is the ratio of its probabilities under the two;
adding Gumbel noise to the logarithms and keeping the largest k draws k documents without replacement in proportion to
their weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common, hyperminhash

#: Hash buckets of n-grams, and the count added to each.
BUCKETS, ADDED = 10_000, 1.0
#: Most documents that the target model is counted on: those of the smallest hashes.
TARGET_ROWS = 100_000
SHARE = 0.5
SEED = 17
BINS = 4096
#: Up to so many rows of one bin are sorted on the driver instead of counted again.
FINE = 10_000


def ngrams(text: bytes) -> np.ndarray:
    """Buckets of all word unigrams and bigrams, repeated as often as they occur."""
    words = hyperminhash.words_of(text)
    h = np.fromiter(map(hyperminhash._words.__getitem__, words), np.uint64, len(words))
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ h[1:]
    pairs = (pairs ^ (pairs >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (np.concatenate([h, pairs ^ (pairs >> np.uint64(29))]) % np.uint64(BUCKETS)).astype(np.int64)


def bucket_counts(docs: DataFrame) -> DataFrame:
    """(bucket, raw, target) over all rows of docs (text, is_target)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text, good in zip(common.bytes_of(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                n = np.bincount(ngrams(text), minlength=BUCKETS)
                raw += n
                if good:
                    target += n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(raw), pa.array(target)], ["bucket", "raw", "target"])

    counted = docs.select("text", "is_target").mapInArrow(run, "bucket long, raw long, target long")
    return counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_weights(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(doc_id, n_ngrams, log_weight) of each row; texts without words weigh 0."""
    table = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [ngrams(x) for x in common.bytes_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(g) for g in grams], pa.int64()), pa.array([float(table.value[g].sum()) for g in grams], pa.float64())], ["doc_id", "n_ngrams", "log_weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_ngrams long, log_weight double")


def gumbel(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise from a hash of the key."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    return -F.log(-F.log(u))


def cutoff(keyed: DataFrame, k: int) -> tuple[float, int] | None:
    """The k-th of (key, doc_id) from the largest, found by histograms of ever narrower ranges; None if all are kept.

    Only the counts of a histogram reach the driver in a round. Where many rows share one key, the search goes on among
    their doc_ids.
    """
    rows = keyed.select("key", F.coalesce("doc_id", F.lit(-(1 << 62))).alias("doc_id"))
    n, lo, hi = rows.agg(F.count("*"), F.min("key"), F.max("key")).first()
    if k >= n:
        return None
    if k <= 0:
        return float("inf"), 0
    above = 0
    while lo < hi:
        if n <= FINE:
            found = rows.where(F.col("key").between(lo, hi)).collect()
            r = sorted(found, key=lambda r: (r["key"], r["doc_id"]), reverse=True)[k - above - 1]
            return r["key"], r["doc_id"]
        step = (hi - lo) / BINS
        # Where doubles lie too close for steps there are at most a few thousand of them between.
        fine = lo + step == lo or hi - step == hi
        bin_ = F.col("key") if fine else F.least(F.floor((F.col("key") - lo) / step), F.lit(BINS - 1))
        above, n, lo, hi = _bin_of(rows.where(F.col("key").between(lo, hi)), bin_, "key", above, k)
    tied, key = rows.where(F.col("key") == lo), lo
    lo, hi = tied.agg(F.min("doc_id"), F.max("doc_id")).first()
    while lo < hi:
        step = -(-(hi - lo + 1) // BINS)
        bin_ = F.floor((F.col("doc_id").cast("decimal(20,0)") - F.lit(lo).cast("decimal(20,0)")) / F.lit(step).cast("decimal(20,0)"))
        above, _, lo, hi = _bin_of(tied.where(F.col("doc_id").between(lo, hi)), bin_, "doc_id", above, k)
    return key, lo


def _bin_of(rows: DataFrame, bin_: Column, of: str, above: int, k: int) -> tuple[int, int, float, float]:
    """The rows above the bin that holds the k-th row from the largest, its own rows, and its ends."""
    counts = rows.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min(of).alias("lo"), F.max(of).alias("hi")).collect()
    for r in sorted(counts, key=lambda r: r["bin"], reverse=True):
        if above + r["n"] >= k:
            return above, r["n"], r["lo"], r["hi"]
        above += r["n"]
    raise ValueError("fewer rows than counted")


def resample(docs: DataFrame, labels: DataFrame, share: float = SHARE, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Draw a share of the documents by importance towards those of quality 1.

    Needs docs (doc_id, text) and labels (doc_id, quality); other columns are ignored. One row per row of docs: doc_id,
    n_ngrams, log_weight, gumbel_key, selected. ceil(share * rows) are selected, ties by larger doc_id; rows that agree
    in key and doc_id are selected together. Texts that are null, empty or have no words weigh as much as under either
    model (0). Without a target document all weights are 0. An empty table gives no rows.
    """
    common.long_rows(docs.sparkSession)
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows).withColumn("is_target", F.lit(True))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = bucket_counts(text.join(F.broadcast(good), "doc_id", "left")).collect()  # BUCKETS rows
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    ratio = np.log((target + ADDED) / (target.sum() + ADDED * BUCKETS)) - np.log((raw + ADDED) / (raw.sum() + ADDED * BUCKETS))
    weighed = log_weights(text, ratio if target.any() else np.zeros(BUCKETS))
    keyed = common.materialize(weighed.withColumn("key", F.col("log_weight") + gumbel(F.col("doc_id"))), "weights")
    n = keyed.count()
    cut = cutoff(keyed, -int(-share * n // 1)) if n else None
    order = F.coalesce("doc_id", F.lit(-(1 << 62)))
    chosen = F.lit(True) if cut is None else (F.col("key") > cut[0]) | ((F.col("key") == cut[0]) & (order >= cut[1]))
    return keyed.select("doc_id", "n_ngrams", "log_weight", F.col("key").alias("gumbel_key"), chosen.alias("selected"))
