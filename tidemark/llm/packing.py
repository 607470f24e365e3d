"""Best-two-fit packing of token sequences into rows of a fixed length.

A bin is filled greedily: the longest piece that fits comes next, until none fits. Then its smallest piece is taken out
and two unpacked pieces take its place if together they are longer than it and fit the expanded gap; of all such pairs
the one that leaves the least gap is chosen.

Lengths are integers up to the capacity, so all that the method needs to know of the data is how many pieces have each
length: a histogram with at most `capacity` entries, however large the input. The plan is made from it on the driver,
a bin pattern at a time with all its repetitions; the pieces then find their places by their rank among pieces of the
same length, in parallel. The plan is exact: it packs every piece of the input.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, groupby, pairwise
from pathlib import Path
from struct import pack

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import bpe, common

CAPACITY = 2048
END_OF_DOCUMENT = 0
#: Signs that are split at once.
SPAN = 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("plan_length", "first_rank", "last_rank", "uses", "first_sequence", "first_offset")])

#: A space between two signs that are no white space begins a word, whatever stands before it.
_edge = re.compile(r"(?<=\S) (?=\S)").search


class MergedTexts(bpe.SplitEncoder):
    """The same ids as bpe.Automaton, as bytes of little-endian 32-bit numbers, split and merged in compiled code.

    Ids are in the order of merging and serve as ranks. The compiled splitter fails on white space of a million signs, so
    it gets spans of at most SPAN signs; only a longer stretch without a place to cut it is split by SplitEncoder.
    """

    def __init__(self, data: bytes):
        x, signs = json.loads(data), bpe.byte_signs()
        specials = {t["content"]: t["id"] for t in x.get("added_tokens", [])}
        ranks = {bytes(signs[c] for c in token): i for token, i in x["model"]["vocab"].items() if i not in specials.values() and all(c in signs for c in token)}
        core = tiktoken.Encoding("texts", pat_str=bpe.PRE_SPLIT, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.merge, self.whole = core.encode_single_piece, core.encode_ordinary
        super().__init__(specials)

    def word(self, word: bytes) -> bytes:
        ids = self.merge(word)
        return pack(f"<{len(ids)}I", *ids)

    def join(self, found: Iterable[bytes]) -> bytes:
        return b"".join(found)

    def special(self, text: str) -> bytes:
        return pack("<I", self.specials[text])

    def _span(self, text: str) -> bytes:
        if len(text) > SPAN:
            return super()._plain(text)
        ids = self.whole(text)
        return pack(f"<{len(ids)}I", *ids)

    def _plain(self, text: str) -> bytes:
        if len(text) <= SPAN:
            return self._span(text)
        cuts = [0]
        while len(text) - cuts[-1] > SPAN and (edge := _edge(text, cuts[-1] + SPAN // 2)):
            cuts.append(edge.start())
        return self.join(self._span(text[a:b]) for a, b in pairwise([*cuts, len(text)]))


_encoders: dict[int, MergedTexts] = {}
common.remember("packing", _encoders)


def encoder(data: bytes) -> MergedTexts:
    key = zlib.crc32(data)
    if key not in _encoders:
        _encoders[key] = MergedTexts(data)
    return _encoders[key]


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Cut every document into pieces: its ids and the id 0, pieces of `capacity`, of which the first may be shorter.

    Columns: doc_id, piece, start, length, ids_crc32. A null or empty text is a piece of length 1.
    """
    common.long_rows(docs.sparkSession)
    data = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.serve("packing")
        enc = encoder(data.value)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for n, text in enumerate(common.texts_of(batch.column(1))):
                ids = enc.encode(text) + pack("<I", END_OF_DOCUMENT)
                size = len(ids) // 4
                cuts = [0, *range(size % capacity or capacity, size + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    row.append(n)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Bin patterns with their repetitions, for so many pieces of each length. Patterns list lengths, longest first."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan = []
    while left.any():
        used: dict[int, int] = {}
        gap, fits = capacity, capacity
        while gap > 0:  # greedily, each length as often as it fits
            there = np.flatnonzero(left[1 : min(gap, fits) + 1])
            if not len(there):
                break
            length = int(there[-1]) + 1
            n = min(gap // length, int(left[length]))
            used[length] = n
            gap -= n * length
            fits = length - 1
        if gap and len(used) + sum(used.values()) > 2:
            small = min(used)
            free = left.copy()
            for length, n in used.items():
                free[length] -= n
            if pair := _tighter_pair(free, small, gap + small):
                used[small] -= 1
                for length in pair:
                    used[length] = used.get(length, 0) + 1
        used = {k: n for k, n in used.items() if n}
        times = min(int(left[k]) // n for k, n in used.items())
        for k, n in used.items():
            left[k] -= n * times
        plan.append(([k for k in sorted(used, reverse=True) for _ in range(used[k])], times))
    return plan


def _tighter_pair(free: np.ndarray, small: int, gap: int) -> tuple[int, int] | None:
    """The two free lengths whose sum is largest, over `small` and at most `gap`; the more even pair first."""
    there = np.flatnonzero(free[: gap + 1] > 0)
    there = there[there > 0]
    if not len(there):
        return None
    partner = np.searchsorted(there, gap - there, "right") - 1  # the longest that fits beside each
    twice = (partner >= 0) & (there[partner] == there) & (free[there] < 2)
    partner = np.where(twice, partner - 1, partner)
    total = np.where(partner >= 0, there + there[partner], -1)
    best = int(total.max())
    if best <= small:
        return None
    k = int(np.flatnonzero(total == best)[-1])
    return int(there[k]), int(there[partner[k]])


def _places(plan: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """For each length of a pattern: the ranks that its repetitions take, how often the length is in each, the first
    sequence, and the offset of the first. Patterns list equal lengths side by side, so a row each is enough."""
    ranks: dict[int, int] = {}
    out, sequence = [], 0
    for lengths, times in plan:
        offset = 0
        for length, same in groupby(lengths):
            uses = len(list(same))
            first = ranks.get(length, 0)
            out.append((length, first, first + uses * times - 1, uses, sequence, offset))
            ranks[length] = first + uses * times
            offset += uses * length
        sequence += times
    return out


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each piece (columns as of pieces_of) its sequence_id and offset.

    `pieces` is read three times, so it should be a written table. Pieces of full length are sequences of their own
    beyond the planned ones. An empty table gives no rows; repeated rows are packed as often as they occur.
    """
    spark = pieces.sparkSession
    salts = common.partitions(spark)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity entries at most
    plan = plan_bins({k: n for k, n in histogram.items() if k < capacity}, capacity)
    planned = sum(times for _, times in plan)
    # Ranks among pieces of one length: the pieces of the salts before, then those before it in its own salt.
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("own", F.row_number().over(own) - 1).join(before, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "salt")
    rows = _places(plan) + [(capacity, 0, histogram.get(capacity, 0) - 1, 1, planned, 0)]
    # A pattern uses up a length, and no more than sqrt(2 * capacity) lengths fit into it: bounded by the capacity.
    places = spark.createDataFrame(rows, PLAN)
    placed = ranked.join(F.broadcast(places), (F.col("length") == F.col("plan_length")) & F.col("rank").between(F.col("first_rank"), F.col("last_rank")))
    nth = F.col("rank") - F.col("first_rank")
    sequence, offset = F.col("first_sequence") + F.expr("(rank - first_rank) div uses"), F.col("first_offset") + nth % F.col("uses") * F.col("length")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), offset.alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack whole documents; one row per piece.

    Needs columns doc_id and text; others are ignored. Nulls in doc_id stay; null text is empty.
    """
    return pack_pieces(common.materialize(pieces_of(docs, tokenizer_path, capacity), "pieces"), capacity)


def lengths_of(plan: list[tuple[list[int], int]]) -> list[int]:
    """All lengths in a plan, each as often as it is packed (for checks)."""
    return sorted(chain.from_iterable(lengths * times for lengths, times in plan))
