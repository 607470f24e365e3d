"""Near-duplicate documents by HyperMinHash sketches.

A document's set holds its distinct 5-word shingles. Their hashes fall into 128 buckets; of the smallest in each bucket
the sketch stores the number of leading zeros and the bits that follow the first one, in 16 bits. Empty buckets borrow
from others when bands are made, so that short documents band like long ones. Bands of 4 registers propose pairs; the
share of equal registers, less the collisions expected by chance from the two cardinalities, estimates the Jaccard
index and drops pairs far below the threshold; the rest are confirmed on full sets. At an index of 0.75, 32 bands miss
a pair with probability (1 - 0.75^4)^32 = 5e-6.

Documents with equal sets are one node from the start. In buckets of many documents pairs are first proposed around
pivots only, and in buckets of more than a block first within blocks: after the links found there are closed into
components, only documents of different components still meet, and the largest component's blocks never meet each other,
so a group of near copies costs rows in proportion to its size. What may still be linked then - documents of one cluster
of near sketches in different components - meets once more, sketches first, texts only of documents with such a partner,
until a link connects them. So no link between components is lost, and no task emits more pairs than it has rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import buckets, common
from tidemark.llm.components import components

WORDS = 5
THRESHOLD = 75
REGISTERS, BANDS, ROWS = 128, 32, 4
MANTISSA = 10
#: Standard deviations below the threshold at which an estimate drops a pair.
DEVIATIONS = 4.5
#: Documents of one block when large groups are settled.
SETTLE_BLOCK = 256
#: Word hashes that a worker remembers.
KNOWN_WORDS = 300_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHashes()
common.remember("hyperminhash", _words)


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return text.lower().split()


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles: one of the whole sequence if it is shorter, none without words."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if len(h) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))], np.uint64)
    out = np.zeros(len(h) - WORDS + 1, np.uint64)
    for k in range(WORDS):
        out = (out ^ h[k : len(h) - WORDS + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """128 registers of 16 bits: 6 bits of leading zeros plus one, 10 bits after the first one; 0 where the bucket is empty."""
    regs = np.zeros(REGISTERS, np.uint16)
    if not len(hashes):
        return regs
    bits = REGISTERS.bit_length() - 1
    which = hashes >> np.uint64(64 - bits)
    first = np.flatnonzero(np.append(True, which[1:] != which[:-1]))  # hashes are sorted: the smallest of each bucket
    rest = (hashes[first] << np.uint64(bits)) | np.uint64(1 << (bits - 1))
    zeros = 63 - np.floor(np.log2(rest.astype(np.float64))).astype(np.int64)
    zeros -= (rest >> (63 - zeros).astype(np.uint64)) == 0  # the logarithm may round up
    after = rest << (zeros + 1).astype(np.uint64)
    regs[which[first].astype(np.int64)] = ((zeros + 1).astype(np.uint64) << np.uint64(MANTISSA) | after >> np.uint64(64 - MANTISSA)).astype(np.uint16)
    return regs


@cache
def _probes() -> np.ndarray:
    """For each register the order in which it asks others."""
    return np.stack([np.random.default_rng(1000 + i).permutation(REGISTERS) for i in range(REGISTERS)])


def densified(regs: np.ndarray) -> np.ndarray:
    """Sketches (one per row) with empty registers filled from the first register that is not, in an order of their own."""
    out = regs.copy()
    for row in np.flatnonzero((regs == 0).any(axis=1)):
        full = regs[row] != 0
        if full.any():
            empty = np.flatnonzero(~full)
            asked = _probes()[empty]
            out[row, empty] = regs[row, asked[np.arange(len(empty)), full[asked].argmax(axis=1)]]
    return out


def bands(regs: np.ndarray) -> np.ndarray:
    """The 32 band hashes of each sketch."""
    x = densified(regs).astype(np.uint64).reshape(len(regs), BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = np.broadcast_to(h, (len(regs), BANDS)).copy()
    for k in range(ROWS):
        h = (h ^ x[:, :, k]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


@cache
def _collisions() -> np.ndarray:
    """The chance that a register agrees for two unrelated sets of 2^i and 2^j elements, from the densities of their minima."""
    edge = 0.5 ** np.arange(1, 60)
    at = (edge[:, None] * (1 + (np.arange(32) + 0.5) / 32)).ravel()
    cell, width = np.repeat(edge, 32) * 2.0**-MANTISSA, np.repeat(edge, 32) / 32
    n = np.maximum(2.0 ** np.arange(32) / REGISTERS, 1)
    density = n[:, None] * np.exp((n[:, None] - 1) * np.log1p(-at))
    return np.minimum(1, (density[:, None] * density[None] * cell * width).sum(-1))


def jaccard(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected estimates for pairs of sketches, and the registers that each rests on."""
    used = ((x | y) != 0).sum(axis=-1)
    same = ((x == y) & (x != 0)).sum(axis=-1)
    chance = _collisions()[np.log2(np.maximum(nx, 1)).astype(int), np.log2(np.maximum(ny, 1)).astype(int)]
    return np.maximum(0, same - chance * (used - same)) / np.maximum(used, 1), used


def _near(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Pairs that the estimate doesn't rule out; the ratio of the sizes bounds the index too."""
    est, used = jaccard(x, y, nx, ny)
    t = THRESHOLD / 100
    return (est >= t - DEVIATIONS * np.sqrt(t * (1 - t) / np.maximum(used, 1))) & (100 * np.minimum(nx, ny) >= THRESHOLD * np.maximum(nx, ny))


def sketches(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, print (of the whole set; null without words), registers."""
    common.long_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.serve("hyperminhash")
        for batch in batches:
            n, prints, regs = [], [], []
            for text in common.bytes_of(batch.column(1)):
                h = shingles(text)
                n.append(len(h))
                prints.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                regs.append(sketch(h).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "n_shingles", "print", "registers"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, print binary, registers binary")


def _registers(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def band_rows(nodes: DataFrame) -> DataFrame:
    """(bucket, id) for each band of each node's sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.serve("hyperminhash")
        for batch in batches:
            if batch.num_rows:
                keys = bands(_registers(batch.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["bucket", "id"])

    return nodes.select("id", "registers").mapInArrow(run, "bucket long, id long")


def propose(members: DataFrame) -> DataFrame:
    """Pairs (a, b) that share a bucket and may reach the threshold, from bucket members with registers, n_shingles and
    component (rows of one are linked already).

    In small buckets all pairs. In large ones those around pivots - a row that no earlier pivot has come near to is the
    next pivot - and of the rows around two pivots one pair that comes near, if there is one: the pairs connect what all
    pairs that may reach the threshold would connect.
    """

    def small(table: pa.Table, starts: np.ndarray, regs: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        own, whole = table.column("own").to_numpy(), table.column("lo").to_numpy() == table.column("hi").to_numpy()
        for i, j in buckets.small_pairs(starts):
            ok = whole[i] | (own[i] != own[j])
            i, j = i[ok], j[ok]
            ok = _near(regs[i], regs[j], n[i], n[j])
            yield i[ok], j[ok]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.serve("hyperminhash")
        for table, starts in buckets.whole_groups(batches):
            ids, n, regs = table.column("id").to_numpy(), table.column("n_shingles").to_numpy(), _registers(table.column("registers"))
            part = table.column("component").to_numpy()
            found = list(small(table, starts, regs, n))
            for a, b in buckets.large_groups(starts):
                found.extend(_forest(np.arange(a, b), regs, n))
            if found:
                i, j = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
                i, j = i[part[i] != part[j]], j[part[i] != part[j]]
                pairs = np.unique(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])], 1), axis=0)
                if len(pairs):
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return buckets.together(members.select("bucket", "lo", "hi", "own", "id", "component", "n_shingles", "registers")).mapInArrow(run, "a long, b long").where("a <> b").distinct()


def _near_one(first: int, rows: np.ndarray, regs: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), bool)
    for k in range(0, len(rows), 4096):
        some = rows[k : k + 4096]
        out[k : k + 4096] = _near(regs[first][None], regs[some], n[first], n[some])
    return out


def _forest(rows: np.ndarray, regs: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of near rows around pivots, and between the rows of two pivots until all that is near is connected."""
    groups, left = [], rows
    while len(left):
        first, left = left[0], left[1:]
        ok = _near_one(first, left, regs, n)
        yield np.full(int(ok.sum()), first), left[ok]
        groups.append(np.append(first, left[ok]))
        left = left[~ok]
    if len(groups) > 1:
        owner = np.concatenate([np.full(len(g), k) for k, g in enumerate(groups)])
        order = np.concatenate(groups)
        part = np.arange(len(groups))  # what is connected by now
        for k, g in enumerate(groups[:-1]):
            for i in g:  # rows of pivots that aren't connected with this one yet
                others = (owner > k) & (part[owner] != part[k])
                if not others.any():
                    break
                ok = _near_one(i, order[others], regs, n)
                at, first = np.unique(part[owner[others][ok]], return_index=True)
                if len(at):
                    yield np.full(len(at), i), order[others][ok][first]
                    part[np.isin(part, at)] = part[k]


def with_partners(members: DataFrame) -> DataFrame:
    """The rows (bucket, lo, hi, own, id, component) of settling that have a near sketch of another component in their
    blocks, from the same with n_shingles and registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.serve("hyperminhash")
        for table, starts in buckets.whole_groups(batches, 2 * SETTLE_BLOCK):
            n, regs, part = table.column("n_shingles").to_numpy(), _registers(table.column("registers")), table.column("component").to_numpy()
            on = np.zeros(len(n), bool)
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                for i in range(a, b - 1):
                    j = np.flatnonzero(part[i + 1 : b] != part[i]) + i + 1
                    j = j[_near_one(i, j, regs, n)]
                    on[j] = True
                    on[i] |= len(j) > 0
            yield from table.select(names).filter(pa.array(on)).to_batches()

    names = ["bucket", "lo", "hi", "own", "id", "component"]
    return buckets.together(members.select(*names, "n_shingles", "registers")).mapInArrow(run, "bucket long, lo int, hi int, own int, id long, component long")


def settle(members: DataFrame) -> DataFrame:
    """Links (a, b) that connect rows of different components, from (bucket, lo, hi, own, id, component, text).

    Each two rows of a task whose components no link has connected yet are estimated, and confirmed on full sets if they
    may reach the threshold, the likeliest first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.serve("hyperminhash")
        for table, starts in buckets.whole_groups(batches, 2 * SETTLE_BLOCK):
            ids, component = table.column("id").to_numpy(), table.column("component").to_numpy()
            found = []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                sets = [shingles(x or b"") for x in table.column("text").slice(a, b - a).cast(pa.binary()).to_pylist()]
                regs, n = np.stack([sketch(x) for x in sets]), np.array([len(x) for x in sets])
                _, part = np.unique(component[a:b], return_inverse=True)
                forest = buckets.Forest(int(part.max()) + 1)
                pairs = []
                for i in range(b - a - 1):
                    j = np.flatnonzero(part[i + 1 :] != part[i]) + i + 1
                    j = j[_near_one(i, j, regs, n)]
                    pairs.extend(zip(jaccard(regs[i][None], regs[j], n[i], n[j])[0].tolist(), [i] * len(j), j.tolist(), strict=True))
                for _, i, j in sorted(pairs, reverse=True):
                    if forest.root(part[i]) != forest.root(part[j]) and _linked(sets[i], sets[j]):
                        forest.join(int(part[i]), int(part[j]))
                        found.append((ids[a + i], ids[a + j]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["a", "b"])

    return buckets.together(members.select("bucket", "lo", "hi", "own", "id", "component", "text")).mapInArrow(run, "a long, b long")


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= THRESHOLD * (len(x) + len(y) - both)


def confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.serve("hyperminhash")
        last: tuple[bytes, np.ndarray] = (b"", shingles(b""))
        for batch in batches:
            ok = []
            for x, y in zip(common.bytes_of(batch.column(2)), common.bytes_of(batch.column(3)), strict=True):
                if x != last[0]:
                    last = (x, shingles(x))
                ok.append(_linked(last[1], shingles(y)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    common.long_rows(docs.sparkSession)
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    needed = common.semi_join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), ids, "doc_id")
    left = needed.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = needed.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def large_buckets(rows: DataFrame) -> DataFrame:
    """(bucket) of the buckets in which only pairs around pivots were looked at."""
    return common.materialize(rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > buckets.SMALL).select("bucket"), "large")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Link documents whose shingle sets have a Jaccard index of at least 0.75, and close the links into groups.

    Needs columns doc_id and text; others are ignored. One row per row of docs: doc_id, n_shingles, component_id (the
    smallest doc_id reachable), kept (doc_id is component_id). Texts that are null, empty or have no words link with
    nothing. Rows of one doc_id are one document, with the links of each of its rows. Rows with a null doc_id link with
    nothing: component_id null, kept. An empty table gives no rows.
    """
    drawn = common.materialize(sketches(docs), "sketches")
    keyed = drawn.where("doc_id is not null and print is not null")
    equal = keyed.groupBy("print").agg(F.min("doc_id").alias("node"), F.min("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    nodes = common.materialize(equal, "nodes")
    rows = band_rows(nodes.select(F.col("node").alias("id"), "registers"))
    payload = nodes.select(F.col("node").alias("id"), "n_shingles", "registers")
    rows = common.materialize(rows, "bands")
    cold, hot = buckets.counted(rows, buckets.BLOCK)
    members = cold.withColumns({"own": F.lit(0), "lo": F.lit(0), "hi": F.lit(0)})
    if hot is not None:  # within blocks first
        hot = common.materialize(hot, "hot")
        own = F.pmod(F.xxhash64("id", "bucket"), F.ceil(F.col("n") / F.lit(buckets.BLOCK)).cast("int")).cast("int")
        members = members.unionByName(hot.withColumns({"own": own, "lo": own, "hi": own}))
    members = common.materialize(members, "members")
    pairs = common.materialize(propose(members.withColumn("component", F.col("id")).join(payload, "id")), "pairs")
    links = common.materialize(confirm(pairs, docs), "confirmed")
    # A doc_id of several rows holds their nodes together.
    again = keyed.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    tied = keyed.join(again, "doc_id", "left_semi").join(nodes.select("print", "node"), "print").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    links = links.unionByName(tied)
    found = components(links)

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))

    if hot is not None:  # then rows of different components, across blocks
        across = common.materialize(buckets.dealt(common.materialize(placed(hot), "hot-components"), buckets.BLOCK, "component"), "across")
        more = common.materialize(propose(across.join(payload, "id")), "more-pairs")
        if more.take(1):
            pairs = pairs.unionByName(more)
            links = links.unionByName(common.materialize(confirm(more, docs), "more-confirmed"))
            found = components(links)
    # Large buckets whose members aren't one component yet: their members meet once more, in clusters of all near pairs.
    apart = placed(rows.join(F.broadcast(large), "bucket") if (large := large_buckets(rows)).count() <= common.BROADCAST_IDS else rows.join(large, "bucket"))
    mixed = apart.groupBy("bucket").agg((F.min("component") != F.max("component")).alias("mixed")).where("mixed").select("bucket")
    rest = common.materialize(apart.join(mixed, "bucket", "left_semi").select("id", "component").distinct(), "apart")
    if rest.take(1):
        near = components(pairs.unionByName(links)).select(F.col("node").alias("id"), F.col("component").alias("bucket"))
        met = common.materialize(buckets.blocks(rest.join(near, "id"), SETTLE_BLOCK, "component"), "met")
        text = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
        met = common.materialize(with_partners(met.join(payload, "id")), "partners")
        links = links.unionByName(common.materialize(settle(met.join(common.semi_join(text, met.select("id"), "id"), "id")), "settled"))
        found = components(links)
    named = nodes.select("print", "node").join(found, "node", "left").select("print", F.coalesce("component", "node").alias("component_id"))
    own = drawn.join(named, "print", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return own.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
