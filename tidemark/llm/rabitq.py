"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector o is padded and rotated at random; its code holds the signs of the rotated coordinates, one bit each, and
is stored with the correction factor c = <sign(Po), Po> / sqrt(D), the inner product of the vector and its own code.
For another vector q, <sign(Po), Pq> / (sqrt(D) c) estimates <o, q> without bias, with an error that stays within
e * sqrt((1 - c^2) / c^2) / sqrt(D - 1) but for a probability that falls as exp(-e^2 / 2). Bands of code bits propose
pairs; the estimates of both directions and their bounds decide which of them are computed exactly in double precision.

Bands have k bits, so that a bucket keeps about 16 vectors of a label; at the threshold a bit differs with probability
p = acos(t) / pi, and so many bands are taken that a pair at the threshold is missed with probability 0.0005 at most.
Pairs above it are missed less. A pair that shares several bands is looked at in the first one only.

Vectors follow their codes: the codes alone are dealt to all bands, and only rows with a pair there that first meets in
that band, and whose codes differ in few enough bits, are joined with their vectors. Dense groups are taken out before:
vectors within half the threshold's angle of a pivot are linked with each other whatever they are, so the members of such
a core are counted, not compared, and its blocks don't meet each other; a group of copies that differ a little costs rows
in proportion to its size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import buckets, common
from tidemark.llm.components import components
from tidemark.llm.vectors import as_matrix, by_length

THRESHOLD = 0.93
MISS = 0.0005
#: Deviations at which a bound rules out a pair.
SURE = 4.0
#: Deviations of the number of differing code bits at which codes alone rule out a pair.
CODES_SURE = 5.0
#: What is kept off half the threshold's angle, so that rounding links no pair below the threshold.
MARGIN = 1e-6
SEED = 20240521


def bands_for(largest_label: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(bits of a band, bands) for so many vectors of one label."""
    bits = min(24, max(6, round(math.log2(max(largest_label, 2) / 16))))
    share = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - share))


@cache
def rotation(dim: int, code_bits: int) -> np.ndarray:
    """A random matrix (code_bits x dim) whose columns are orthonormal: padding and rotation in one."""
    size = max(dim, code_bits)
    q, r = np.linalg.qr(np.random.default_rng(SEED + dim).standard_normal((size, dim)))
    return (q * np.sign(np.diag(r)))[:code_bits]


def codes(vectors: DataFrame, bits: int, bands: int) -> DataFrame:
    """One row per row: vec_id, label, and for vectors that take part print, dim, code, factor and the vector (double, as bytes)."""
    size = bits * bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(1).to_pylist()
            prints, dims, code, factor, raw = ([None] * len(labels) for _ in range(5))
            for rows, x in by_length(batch.column(2), np.array([label is not None for label in labels], bool)):
                unit = x / np.abs(x).max(1, keepdims=True)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                turned = unit @ rotation(x.shape[1], size).T
                packed, factors = np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / math.sqrt(size)
                for k, n in enumerate(rows.tolist()):
                    raw[n], dims[n], code[n], factor[n] = x[k].tobytes(), x.shape[1], packed[k].tobytes(), float(factors[k])
                    prints[n] = xxhash.xxh3_128_digest(raw[n] + str(labels[n]).encode())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.binary()), pa.array(dims, pa.int32()), pa.array(code, pa.binary()), pa.array(factor, pa.float64()), pa.array(raw, pa.binary())], ["vec_id", "label", "print", "dim", "code", "factor", "vector"])

    columns = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding"))
    return columns.mapInArrow(run, "vec_id long, label string, print binary, dim int, code binary, factor double, vector binary")


def _keys(code: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """Band keys (rows x bands) from packed codes."""
    on = np.unpackbits(code, axis=1)[:, : bits * bands].reshape(len(code), bands, bits)
    return (on.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(-1, dtype=np.uint32)


def _matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return as_matrix(column, kind)


def band_rows(nodes: DataFrame, bits: int, bands: int) -> DataFrame:
    """(bucket, band, id) for each band of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = _keys(_matrix(batch.column(3), np.uint8), bits, bands)
            place = np.array([xxhash.xxh3_64_intdigest(f"{label}\0{dim}") for label, dim in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)], np.uint64)
            band = np.broadcast_to(np.arange(bands, dtype=np.uint64), keys.shape)
            h = (place[:, None] ^ (band << np.uint64(32) | keys)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64).ravel()), pa.array(band.astype(np.int32).ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), bands))], ["bucket", "band", "id"])

    return nodes.select("id", "label", "dim", "code").mapInArrow(run, "bucket long, band int, id long")


def open_rows(members: DataFrame, bits: int, bands: int, threshold: float = THRESHOLD) -> DataFrame:
    """The bucket members that have a pair to look at, from members with codes and cores: one that first meets in this band,
    isn't within a core, and whose codes differ in no more bits than CODES_SURE deviations from what the threshold allows."""
    size = bits * bands
    share = math.acos(threshold) / math.pi
    most = size * share + CODES_SURE * math.sqrt(size * share * (1 - share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in buckets.whole_groups(batches):
            own, core, band = (table.column(n).to_numpy() for n in ("own", "core", "band"))
            whole = table.column("lo").to_numpy() == table.column("hi").to_numpy()
            code = _matrix(table.column("code"), np.uint8)
            keys = _keys(code, bits, bands)
            on = np.zeros(len(own), bool)
            for i, j in buckets.small_pairs(starts):
                ok = (core[i] != core[j]) & (whole[i] | (own[i] != own[j]))
                i, j = i[ok], j[ok]
                ok = (keys[i] == keys[j]).argmax(1) == band[i]
                i, j = i[ok], j[ok]
                ok = np.bitwise_count(code[i] ^ code[j]).sum(1) <= most
                on[i[ok]] = on[j[ok]] = True
            for a, b in buckets.large_groups(starts):
                lo, hi = table.column("lo")[a].as_py(), table.column("hi")[a].as_py()
                signs = np.unpackbits(code[a:b], axis=1)[:, :size].astype(np.float32) * 2 - 1
                for i, j, same in buckets.tiles(a, b, own, lo, hi):
                    ok = (core[i][:, None] != core[j][None]) & (signs[i - a] @ signs[j - a].T >= size - 2 * most)
                    if same:
                        ok &= i[:, None] != j[None]
                    for k in range(int(band[a])):
                        ok &= keys[i, k][:, None] != keys[j, k][None]
                    on[i[ok.any(1)]] = True
                    on[j[ok.any(0)]] = True
            yield from table.select(names).filter(pa.array(on)).to_batches()

    names = ["bucket", "lo", "hi", "own", "id", "band", "core"]
    return buckets.together(members.select(*names, "code")).mapInArrow(run, "bucket long, lo int, hi int, own int, id long, band int, core long")


def compare(members: DataFrame, bits: int, bands: int, threshold: float = THRESHOLD) -> DataFrame:
    """From bucket members with codes and vectors: (id, n_links, root): how many vectors each is linked to by pairs that
    this task has confirmed, copies counted, and the smallest id of its linked set in the task. Pairs of one core are left out."""
    size = bits * bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in buckets.whole_groups(batches):
            ids, copies, own, core = (table.column(n).to_numpy() for n in ("id", "copies", "own", "core"))
            band, whole = table.column("band").to_numpy(), table.column("lo").to_numpy() == table.column("hi").to_numpy()
            code = _matrix(table.column("code"), np.uint8)
            keys = _keys(code, bits, bands)
            signs = (np.unpackbits(code, axis=1)[:, :size].astype(np.float32) * 2 - 1) / math.sqrt(size)
            factor = table.column("factor").to_numpy()
            error = SURE * np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(max(size - 1, 1))
            unit, turned = _units(table, size)
            links, forest = np.zeros(len(ids), np.int64), buckets.Forest(len(ids))

            def confirm(i: np.ndarray, j: np.ndarray) -> None:
                for k in range(0, len(i), buckets.CHUNK):
                    a, b = i[k : k + buckets.CHUNK], j[k : k + buckets.CHUNK]
                    ok = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold  # noqa: B023
                    a, b = a[ok], b[ok]
                    np.add.at(links, a, copies[b])  # noqa: B023
                    np.add.at(links, b, copies[a])  # noqa: B023
                    up = forest.up  # noqa: B023
                    for x, y in zip(a.tolist(), b.tolist(), strict=True):
                        if up[x] != up[y]:
                            forest.join(x, y)  # noqa: B023

            for i, j in buckets.small_pairs(starts):
                ok = (core[i] != core[j]) & (whole[i] | (own[i] != own[j]))
                i, j = i[ok], j[ok]
                ok = (keys[i] == keys[j]).argmax(1) == band[i]
                i, j = i[ok], j[ok]
                estimate = (np.einsum("ij,ij->i", signs[i], turned[j]) / factor[i] + np.einsum("ij,ij->i", signs[j], turned[i]) / factor[j]) / 2
                ok = estimate + np.maximum(error[i], error[j]) >= threshold
                confirm(i[ok], j[ok])
            for a, b in buckets.large_groups(starts):
                lo, hi = table.column("lo")[a].as_py(), table.column("hi")[a].as_py()
                for i, j, same in buckets.tiles(a, b, own, lo, hi):
                    ok = core[i][:, None] != core[j][None]
                    if same:
                        ok = np.triu(ok, 1)
                    for k in range(int(band[a])):
                        ok &= keys[i, k][:, None] != keys[j, k][None]
                    if ok.any():
                        estimate = (signs[i] @ turned[j].T / factor[i][:, None] + (signs[j] @ turned[i].T / factor[j][:, None]).T) / 2
                        x, y = np.nonzero(ok & (estimate + np.maximum(error[i][:, None], error[j][None]) >= threshold))
                        confirm(i[x], j[y])
            some = np.flatnonzero(links)
            roots = ids[[forest.root(i) for i in some]] if len(some) else ids[:0]
            # One row for each id and root: what a task reports stays in proportion to the rows that it has read.
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(roots)], ["id", "n_links", "root"])

    cols = ["bucket", "lo", "hi", "own", "id", "band", "core", "copies", "code", "factor", "dim", "vector"]
    return buckets.together(members.select(*cols)).mapInArrow(run, "id long, n_links long, root long")


def _units(table: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision (short ones padded) and their rotations."""
    dims = table.column("dim").to_numpy()
    unit, turned = np.zeros((len(dims), int(dims.max()))), np.zeros((len(dims), size), np.float32)
    raw = table.column("vector")
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        x = _matrix(raw.take(pa.array(at)), np.float64)
        x = x / np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        unit[at, :dim] = x
        turned[at] = x @ rotation(int(dim), size).T
    return unit, turned


def cores(nodes: DataFrame, rows: DataFrame, block: int, threshold: float = THRESHOLD) -> DataFrame | None:
    """(id, core): vectors within half the threshold's angle of a pivot, the core's name; None if no bucket is large.

    Pivots are the smallest ids of the first band's large buckets. Then vectors in no core yet that share any large bucket
    with a core's members are held against the core that most of them are in. Any two members of a core are linked.
    """
    _, hot = buckets.counted(rows, block)
    if hot is None:
        return None
    hot = common.materialize(hot, "hot")
    vector = nodes.select("id", "vector")
    pivots = hot.where("band = 0").groupBy("bucket").agg(F.min("id").alias("core"))
    first = near_pivots(hot.where("band = 0").join(_few(pivots), "bucket").select("id", "core"), vector, threshold)
    taken = common.materialize(first, "first-cores")
    common_ = hot.join(taken, "id").groupBy("bucket", "core").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "core")).alias("m"))
    asked = hot.join(taken.select("id"), "id", "left_anti").join(_few(common_.select("bucket", F.col("m.core").alias("core"))), "bucket").select("id", "core").distinct()
    later = near_pivots(asked, vector, threshold).groupBy("id").agg(F.min("core").alias("core"))
    return common.materialize(taken.unionByName(later), "cores")


def _few(df: DataFrame) -> DataFrame:
    """A list of large buckets, broadcast where it is short."""
    df = common.materialize(df, "list")
    return F.broadcast(df) if df.count() <= common.BROADCAST_IDS else df


def near_pivots(asked: DataFrame, vector: DataFrame, threshold: float) -> DataFrame:
    """The rows (id, core) whose vectors lie within half the threshold's angle of each other."""
    bar = math.cos(math.acos(threshold) / 2 - MARGIN)
    # Few pivots (one for each large bucket), each asked by many: their vectors go to the rows.
    pivot = _few(vector.join(_few(asked.select(F.col("core").alias("id")).distinct()), "id", "left_semi").select(F.col("id").alias("core"), F.col("vector").alias("pivot")))
    both = asked.join(vector, "id").join(pivot, "core").where(F.octet_length("vector") == F.octet_length("pivot")).select("id", "core", "vector", "pivot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [n for n, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)) if _cosine(x, y) >= bar]
            yield batch.select([0, 1]).take(pa.array(near, pa.int64()))

    return both.mapInArrow(run, "id long, core long")


def _cosine(x: bytes, y: bytes) -> float:
    a, b = np.frombuffer(x), np.frombuffer(y)
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Link vectors of one label whose cosine is at least the threshold, and close the links into groups.

    Needs columns vec_id, label and embedding; others are ignored. One row per row: vec_id, n_links (other vectors
    linked directly), component_id (smallest vec_id reachable, itself included), kept (vec_id is component_id). Vectors
    that are null, empty, zero or hold null or non-finite parts, and those without a label, link with nothing; nor do
    vectors of different lengths. Equal vectors of a label are compared as one and count each. Rows with a null vec_id
    link with nothing: component_id null, kept. Rows of one vec_id are one vector if they are equal, else each has its
    own n_links and they share a group. An empty table gives no rows.
    """
    largest = vectors.where("label is not null").groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    bits, bands = bands_for(largest, threshold)
    drawn = common.materialize(codes(vectors, bits, bands), "codes")
    live = drawn.where("print is not null and vec_id is not null")
    first = live.groupBy("print").agg(F.min("vec_id").alias("node"), F.count_distinct("vec_id").alias("copies"), F.first(F.struct("label", "dim", "code", "factor", "vector")).alias("of"))
    # A node is named by its smallest vec_id, or, where rows of one vec_id differ, by a hash below 0.
    again = live.groupBy("vec_id").agg(F.count_distinct("print").alias("prints")).where("prints > 1").select("vec_id", F.lit(True).alias("several"))
    hashed = -F.conv(F.substring(F.hex("print"), 1, 15), 16, 10).cast("long") - 1
    named = first.join(again.withColumnRenamed("vec_id", "node"), "node", "left").withColumn("id", F.when(F.col("several"), hashed).otherwise(F.col("node")))
    nodes = common.materialize(named.select("print", "node", "copies", "id", "of.*"), "nodes")
    rows = common.materialize(band_rows(nodes, bits, bands), "bands")
    core = cores(nodes, rows, buckets.BLOCK, threshold)
    rows = rows.withColumn("core", F.col("id")) if core is None else rows.join(core, "id", "left").withColumn("core", F.coalesce("core", "id"))
    members = buckets.blocks(rows) if core is None else buckets.blocks(common.materialize(rows, "placed"), buckets.BLOCK, "core")
    asking = common.materialize(open_rows(members.join(nodes.select("id", "code"), "id"), bits, bands, threshold), "open")
    payload = nodes.select("id", "copies", "code", "factor", "dim", "vector")
    found = common.materialize(compare(asking.join(payload, "id"), bits, bands, threshold), "links")
    if core is not None:  # each member is linked to all others of its core
        sizes = core.join(nodes.select("id", "copies"), "id")
        whole = sizes.groupBy("core").agg(F.sum("copies").alias("n"))
        within = sizes.join(_few(whole), "core").select("id", (F.col("n") - F.col("copies")).alias("n_links"), F.col("core").alias("root"))
        found = common.materialize(found.unionByName(within), "all-links")
    counts = found.groupBy("id").agg(F.sum("n_links").alias("others"))
    # Nodes that hold rows of one vec_id belong together.
    shared = live.join(again, "vec_id", "left_semi").join(nodes.select("print", "id"), "print").select("vec_id", "id")
    tied = shared.join(shared.groupBy("vec_id").agg(F.min("id").alias("b")), "vec_id").select(F.col("id").alias("a"), "b")
    links = found.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(tied).distinct()
    groups = components(links).join(nodes.select(F.col("id").alias("node_id"), F.col("node").alias("least")), F.col("node") == F.col("node_id"))
    least = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    named = groups.join(least, "component").select(F.col("node_id").alias("id"), "component_id")
    per_print = nodes.join(counts, "id", "left").join(named, "id", "left").select("print", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component_id", "node").alias("component_id"))
    out = drawn.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("print")).alias("print")).join(per_print, "print", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
