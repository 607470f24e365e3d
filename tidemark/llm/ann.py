"""Nearest neighbours by inner product, with multiprobe p-stable hashing.

Vectors are scaled to a bound M and get one more coordinate, sqrt(M^2 - |x|^2), so that the largest inner product is the
smallest distance. A table hashes a vector by Gaussian projections (orthogonal within the table), cut into slots of a
fixed width with an edge at their median; together the slots name a bucket. A query visits perturbed buckets in the order
of their estimated success: a neighbour's projection is taken as Gaussian around the query's own times the likeness, the
cosine that its k-th neighbour is expected to reach. The candidates of all tables are merged and ranked by exact inner
products in double precision.

That happens on two levels. A table over all rows deals them into cells of near vectors, as many as make blocks of a
bounded size (a cell of more rows is dealt into several blocks by a hash of the id); vectors lie in bands of norms, each
with a bound of its own, so that one very long vector doesn't press all others together. A query is sent to the cells in
which its neighbours are expected. In each block the rows, less their mean, are hashed by TABLES further tables, whose
buckets the queries probe: many queries are looked up together, and each bucket is multiplied with all that visit it, in
single precision. What comes within rounding of a query's best is ranked in double precision. Of equal vectors a block
keeps the k + 1 of the smallest ids, as no query can return others. Thus neither a table of all buckets nor more than one
copy of a vector is ever shuffled.

The likeness is read off for each query: its products with a sample of rows, at the rank that a k-th neighbour has
there (and one further, to be careful). Within a block, the nearest of some guide rows correct the estimate, so that dense
groups are probed where they lie; and the chance from which on a bucket is visited, one for all queries and tables of a
block, is settled by what some guides, asked as queries, would have missed. With `exact`, every bucket whose bound reaches the k-th product found is visited
as well, and no neighbour is missed; on vectors without structure those are nearly all buckets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common
from tidemark.llm.vectors import as_binary, as_matrix, by_length, norms

#: Tables of a block, their fewest and most projections, and the width of a slot; two middle slots hold nearly all projections.
TABLES, FEWEST, PROJECTIONS, WIDTH = 16, 9, 12, 8.0
#: Rows of a bucket from which on a block takes more projections.
FULL = 64
#: Share of the neighbours that is looked for in a block's buckets, and (estimated) in the cells that a query is sent to.
TARGET, CELL_TARGET = 0.93, 0.995
#: Most guides of a block that are asked which chances find the target's share. In tables of more rows than the sample, so
#: many of its rows are compared with all others instead (of which a block must hold ENOUGH neighbours).
ASKS, ASKED, ENOUGH = 256, 512, 100
#: Rows from which likeness and cells are estimated: those of the smallest hashes.
SAMPLE_ROWS = 4096
#: Most rows of a block, and the rows from which on there are blocks enough for every task, up to SHARES: each block gets a
#: copy of nearly every query.
BLOCK, SPREAD, SHARES = 524_288, 4096, 16
#: Most projections of the cells, and most bands of norms (each half as long as the one before; the last takes the rest).
CELL_PROJECTIONS, BANDS = 12, 16
#: Rows of a block that tell where neighbours lie (twice as many in blocks beyond LARGE rows), the nearest of them that are
#: asked, and the least spread assumed.
GUIDES, LARGE, NEAR, LEAST_SPREAD = 512, 65_536, 16, 0.02
#: Rows of a block that tell a query's first bar.
BARS = 2048
#: Rows of a block that tell the medians, and rows hashed at once.
MEDIANS, ROWS = 16_384, 32_768
#: So many times k candidates of a block are compared at least, or all if they are fewer.
AT_LEAST = 4
#: Queries whose cells or chances are estimated at once, those that are looked up together, and products made at once.
QUERIES, TOGETHER, PRODUCTS = 64, 8192, 1 << 21
#: Rows of a block up to which it is marked who was compared with whom.
MARKED = 16_384
SEED = 911

FOUND = "query_id long, compared long, minus array<double>, vec_id array<long>"


def precision(vectors: DataFrame) -> type:
    """What holds the vectors' parts exactly."""
    kind = vectors.schema["embedding"].dataType
    return np.float32 if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else np.float64


def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector as bytes in its own precision, dim, norm) of the vectors that take part."""
    kind = precision(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in by_length(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), as_binary(x.astype(kind)), pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array(norms(x))], ["vec_id", "vector", "dim", "norm"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null").mapInArrow(run, "vec_id long, vector binary, dim int, norm double")


class Table:
    """Projections of vectors with one more coordinate, their slots, and the chances of slots."""

    def __init__(self, dim: int, projections: int, seed: int):
        lines = np.random.default_rng([SEED, dim, seed]).standard_normal((dim + 1, projections))
        if 0 < projections <= dim + 1:
            lines = np.linalg.qr(lines)[0] * math.sqrt(dim + 1)
        self.lines, self.edges = lines, np.zeros(projections)

    def fit(self, full: np.ndarray) -> None:
        """Put an edge at the median of each projection of these rows."""
        if len(full):
            self.edges = np.median(full @ self.lines, axis=0)

    def slots(self, full: np.ndarray) -> np.ndarray:
        """Slots 0 to 3 (rows x projections); the outer ones are open."""
        return (np.clip(np.floor((full @ self.lines - self.edges) / WIDTH), -2, 1) + 2).astype(np.int64)

    def names(self, full: np.ndarray) -> np.ndarray:
        slots = self.slots(full)
        return (slots << 2 * np.arange(slots.shape[1])).sum(1)

    def logs(self, centre: np.ndarray, spread: np.ndarray, names: np.ndarray) -> np.ndarray:
        """The logarithm of the chance that a neighbour, whose projections lie around a centre (queries x projections) with a
        spread, is in each of the named buckets (queries x names)."""
        k = self.lines.shape[1]
        at = _normal((np.array([-WIDTH, 0.0, WIDTH], centre.dtype) - (centre - self.edges.astype(centre.dtype))[:, :, None]) / spread[:, None, None].astype(centre.dtype))
        share = np.diff(at, axis=-1, prepend=0.0, append=1.0)
        logs = np.log(np.maximum(share, 1e-30)).astype(np.float32).reshape(len(centre), 4 * k)
        slots = names[:, None] >> 2 * np.arange(k) & 3
        hot = np.zeros((len(names), 4 * k), np.float32)
        hot[np.arange(len(names))[:, None], 4 * np.arange(k) + slots] = 1
        # What the second slots add up to, and how the others differ from them: most of those are in no name.
        second = 4 * np.arange(k) + 1
        others = np.setdiff1d(np.flatnonzero(hot.any(0)), second)
        return (logs[:, others] - logs[:, others // 4 * 4 + 1]) @ hot[:, others].T + logs[:, second].sum(1, keepdims=True)

    def chances(self, centre: np.ndarray, spread: np.ndarray, names: np.ndarray) -> np.ndarray:
        """The same chances, relative to each query's likeliest bucket."""
        out = self.logs(centre, spread, names)
        return np.exp(out - out.max(1, keepdims=True))


def likeliest(chance: np.ndarray, target: float) -> np.ndarray:
    """Which buckets a query visits (queries x names): the likeliest first, until they hold the target."""
    ranked = -np.sort(-chance, axis=1)
    sums = np.cumsum(ranked, 1, dtype=np.float64)
    last = (sums < target * sums[:, -1:]).sum(1)  # the place of the bucket that reaches it
    return chance >= ranked[np.arange(len(chance)), np.minimum(last, chance.shape[1] - 1)][:, None]


def _normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function (Abramowitz and Stegun 7.1.26, error under 2e-7)."""
    z = np.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-z * z) / 2
    return np.where(x >= 0, 1 - tail, tail)


def filled(x: np.ndarray, bound: float) -> np.ndarray:
    """Rows scaled to the bound, with the coordinate that makes them as long as it."""
    x = x / bound
    return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))])


def first_copies(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """The rows that are among the k + 1 of the smallest ids of their vector: each query finds k others among them."""
    words = x.view(np.uint32).reshape(len(x), -1)
    odd = np.random.default_rng(SEED).integers(1, 1 << 62, words.shape[1], np.uint64) | np.uint64(1)
    key = np.zeros(len(x), np.uint64)
    for c in range(words.shape[1]):
        key += words[:, c] * odd[c]
    order = np.lexsort((ids, key))
    begin = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
    end = np.append(begin[1:], len(x))
    keep = np.ones(len(x), bool)
    for g in np.flatnonzero(end - begin > k + 1).tolist():  # equal keys: compare the vectors themselves
        rows = order[begin[g] : end[g]]
        if (words[rows] == words[rows[0]]).all():
            keep[rows[k + 1 :]] = False
        else:
            kind = np.unique(words[rows], axis=0, return_inverse=True)[1].reshape(-1)
            for same in range(kind.max() + 1):
                keep[rows[kind == same][k + 1 :]] = False
    return np.flatnonzero(keep)


class Index:
    """The rows of one block: their exact vectors, and the buckets of all tables."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, expected: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int, tables: int = TABLES, target: float = TARGET, asked: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        kept = first_copies(ids, x, k)
        self.ids, self.x = (ids, x) if len(kept) == len(ids) else (ids[kept], x[kept])
        n, dim = self.x.shape
        self.mean = self.x.mean(0, dtype=np.float64)
        self.longest, self.bound = 0.0, 0.0
        for a in range(0, n, ROWS):
            part = self.x[a : a + ROWS].astype(np.float64)
            self.longest = max(self.longest, float(norms(part).max()))
            part -= self.mean
            if (part := part[(part != 0).any(1)]).size:
                self.bound = max(self.bound, float(norms(part).max()))
        self.bound = self.bound or 1.0
        #: The rows in single precision, and by what they were divided.
        plain = self.x.dtype == np.float32 and 1e-9 < self.longest < 1e9
        self.scale = 1.0 if plain else self.longest
        self.single = self.x if plain else (self.x / self.scale).astype(np.float32)
        self.margin = np.float32((dim + 8) * 2.0**-22 * self.longest / self.scale)
        some = self._full(np.unique(np.linspace(0, n - 1, MEDIANS).astype(np.int64)))
        self.rest = float(some[:, -1].mean())
        self.step = min(PROJECTIONS, max(FEWEST, int(math.log2(n / FULL)) if n > FULL else 0))
        self.tables = [Table(dim, self.step, t) for t in range(tables)]
        for table in self.tables:
            table.fit(some)
        named = np.empty((tables, n), np.int32)
        for a in range(0, n, ROWS):
            full = self._full(np.arange(a, min(n, a + ROWS)))
            for t, table in enumerate(self.tables):
                named[t, a : a + ROWS] = table.names(full)
        #: Of each table its buckets' names, the rows in their order, and where each bucket begins.
        self.buckets: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for t in range(tables):
            order = np.argsort(named[t], kind="stable").astype(np.int32)
            names, begin = np.unique(named[t][order], return_index=True)
            self.buckets.append((names.astype(np.int64), order, np.append(begin, n)))
        self.lines = np.hstack([t.lines for t in self.tables]).astype(np.float32)
        self.some = np.unique(np.linspace(0, n - 1, GUIDES * (1 + (n > LARGE))).astype(np.int64))
        full = self._full(self.some)
        self.apart, self.guides = full[:, :-1].astype(np.float32), (full @ self.lines).astype(np.float32)
        self.bars = np.unique(np.linspace(0, n - 1, BARS).astype(np.int64))
        self.least = self._least(expected, named, k, target, asked)

    def _full(self, rows: np.ndarray) -> np.ndarray:
        return filled(self.x[rows] - self.mean, self.bound)

    def _least(self, expected: Callable[[np.ndarray, np.ndarray], np.ndarray], named: np.ndarray, k: int, target: float, asked: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> float:
        """The logarithm of the chance from which on a bucket is visited: the largest at which so large a share of the
        neighbours of the asked rows (ids, vectors, products of the k-th neighbours) is found; where they have few here, of
        some guides, each k that reach its expected product."""
        found = self._chances(*asked[:2], expected, named, k, asked[2]) if asked else np.zeros(0)
        if len(found) < ENOUGH:
            asks = self.some[:: max(1, len(self.some) // ASKS)]
            found = self._chances(self.ids[asks], self.x[asks].astype(np.float64), expected, named, k)
        return float(np.sort(found)[int((1 - target) * len(found))]) - 1e-4 if len(found) else -np.inf  # room for rounding

    def _chances(self, ids: np.ndarray, vectors: np.ndarray, expected: Callable[[np.ndarray, np.ndarray], np.ndarray], named: np.ndarray, k: int, known: np.ndarray | None = None) -> np.ndarray:
        """For each neighbour of these queries the logarithm of its likeliest bucket's chance."""
        m = min(k, len(self.ids))
        chances = [np.zeros(0)]
        for a in range(0, len(ids), 8):
            own, q = ids[a : a + 8], vectors[a : a + 8]
            kth = expected(own, q)
            products = np.empty((len(q), len(self.ids)))
            for b in range(0, len(self.ids), ROWS):
                products[:, b : b + ROWS] = np.where(own[:, None] == self.ids[None, b : b + ROWS], -np.inf, q @ self.x[b : b + ROWS].T.astype(np.float64))
            if known is None:
                bar = np.minimum(np.maximum(np.partition(products, -m, axis=1)[:, -m], kth), products.max(1))
            else:
                bar = known[a : a + 8] - 1e-9 * np.abs(known[a : a + 8])
            ask, row = np.nonzero((products >= bar[:, None]) & (products > -np.inf))
            centre, spread = self._around(own, q, kth)
            found = np.full(len(ask), -np.inf)
            for t, (names, _, _) in enumerate(self.buckets):
                found = np.maximum(found, self._logs(t, centre, spread)[ask, np.searchsorted(names, named[t][row])])
            chances.append(found)
        return np.concatenate(chances)

    def _logs(self, t: int, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
        return self.tables[t].logs(centre[:, t * self.step : (t + 1) * self.step], spread, self.buckets[t][0])

    def around(self, own: np.ndarray, unit: np.ndarray, likeness: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the projections of each query's neighbours lie (queries x projections), and how widely.

        Around the likeness times the query's own, but for what those of the guides that come nearest have in common
        beyond that - as in a dense group - as far as it is more than chance.
        """
        unit, near_by = unit.astype(np.float32), likeness.astype(np.float32)[:, None]
        alone = unit @ self.lines[:-1]
        plain = np.float32(self.rest) * self.lines[-1]
        m = min(NEAR, max(2, len(self.some) // 16))
        if len(self.some) <= m:
            return near_by * alone + plain, np.sqrt(np.maximum(1 - likeness**2 - self.rest**2, LEAST_SPREAD**2))
        cos = unit @ self.apart.T
        hidden = np.where(own[:, None] == self.ids[self.some][None], -np.inf, cos)
        near = np.argpartition(-hidden, m - 1, axis=1)[:, :m]
        left = self.guides[near] - np.take_along_axis(cos, near, 1)[:, :, None] * alone[:, None] - plain
        common_ = left.mean(1)
        within = ((left - common_[:, None]) ** 2).mean((1, 2)) * m / (m - 1)
        kept = np.maximum(0, 1 - within / m / np.maximum((common_**2).mean(1), 1e-12))
        return near_by * alone + plain + kept[:, None] * common_, np.sqrt(np.maximum(within * (1 + kept / m), LEAST_SPREAD**2))

    def _around(self, own: np.ndarray, q: np.ndarray, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same. kth: the product that a query's k-th neighbour may reach."""
        length = norms(q)
        unit = q / length[:, None]
        likeness = np.clip(np.nan_to_num((kth / length - unit @ self.mean) / self.bound), 0, 0.995)
        parts = [self.around(own[a : a + QUERIES], unit[a : a + QUERIES], likeness[a : a + QUERIES]) for a in range(0, len(q), QUERIES)]
        return np.concatenate([c for c, _ in parts]), np.concatenate([s for _, s in parts])

    def together(self) -> int:
        """How many queries may be looked up at once."""
        return TOGETHER if len(self.ids) > MARKED else max(QUERIES, min(TOGETHER, (1 << 26) // len(self.ids)))

    def search(self, own: np.ndarray, q: np.ndarray, kth: np.ndarray, k: int, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each query how many, the ids and the products of its k best candidates, one query after another, and how many
        were compared (in blocks of more than MARKED rows those of two buckets count twice)."""
        look = Look(self, own, q, k)
        centre, spread = self._around(own, q, kth)
        for t in range(len(self.tables)):
            hits = [np.flatnonzero(self._logs(t, centre[a : a + 512], spread[a : a + 512]) >= self.least) + a * len(self.buckets[t][0]) for a in range(0, len(q), 512)]
            look.visit(t, *np.divmod(np.concatenate(hits), len(self.buckets[t][0])))
        others = len(self.ids) - np.isin(own, self.ids)
        few = np.flatnonzero((look.compared() < np.minimum(AT_LEAST * k, others)) | (look.found() < np.minimum(k, others)))
        if len(few):
            look.visit(0, np.repeat(few, len(self.buckets[0][0])), np.tile(np.arange(len(self.buckets[0][0])), len(few)))
        if exact:
            # Not "at least the bar": a bound that isn't a number excludes nothing.
            row, bucket = np.nonzero(~(self.reach(q) < look.kth()[:, None]))
            look.visit(0, row, bucket)
        return look.best()

    def reach(self, q: np.ndarray) -> np.ndarray:
        """What no product of a query with a row of each bucket of the first table exceeds, with room for rounding."""
        _, order, begin = self.buckets[0]
        size = np.diff(begin)
        place = np.empty(len(order), np.int64)
        place[order] = np.repeat(np.arange(len(size)), size)
        centre = np.zeros((len(size), self.x.shape[1]))
        np.add.at(centre, place, self.x / size[place][:, None])
        radius, most = np.zeros(len(size)), np.zeros(len(size))
        np.maximum.at(radius, place, np.linalg.norm(self.x - centre[place], axis=1))
        np.maximum.at(most, place, np.linalg.norm(self.x.astype(np.float64), axis=1))
        length = np.linalg.norm(q, axis=1)[:, None]
        return np.minimum(q @ centre.T + length * radius, length * most) + 1e-9 * length * most.max()


class Look:
    """Queries that are looked up together in a block, and the candidates that may be among each one's k best."""

    def __init__(self, index: Index, own: np.ndarray, q: np.ndarray, k: int):
        self.index, self.own, self.q, self.k = index, own, q, k
        self.single = (q / norms(q)[:, None]).astype(np.float32)
        n, some = len(index.ids), index.bars
        #: The least product (of the single vectors) that may be among the best: at first what enough of the guides reach.
        rank = max(k, -(-AT_LEAST * k * len(some) // n))
        self.bar = np.full(len(q), -np.inf, np.float32)
        if rank < len(some):
            for a in range(0, len(q), 512):
                products = np.where(own[a : a + 512, None] == index.ids[some][None], -np.inf, self.single[a : a + 512] @ index.single[some].T)
                self.bar[a : a + 512] = np.partition(products, -rank, axis=1)[:, -rank] - 2 * index.margin
        self.row, self.at, self.product = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        self.marks = np.zeros((len(q), n), bool) if n <= MARKED else None
        self.counts = np.zeros(len(q), np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def visit(self, t: int, rows: np.ndarray, buckets: np.ndarray) -> None:
        """Compare queries with the buckets of a table."""
        if not len(rows):
            return
        index = self.index
        _, order, begin = index.buckets[t]
        size = np.diff(begin)
        by = np.argsort(buckets, kind="stable")
        rows, buckets = rows[by], buckets[by]
        if self.marks is None:
            self.counts += np.bincount(rows, size[buckets], len(self.q)).astype(np.int64)
        first = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1]))
        for a, b in zip(first.tolist(), np.append(first[1:], len(buckets)).tolist(), strict=True):
            whole = order[begin[buckets[a]] : begin[buckets[a] + 1]]
            for c in range(0, len(whole), ROWS):
                at = whole[c : c + ROWS]
                x = index.single[at].T
                step = max(1, PRODUCTS // len(at))
                for d in range(a, b, step):
                    asks = rows[d : min(d + step, b)]
                    products = self.single[asks] @ x
                    if self.marks is not None:
                        self.marks[asks[:, None], at] = True
                    hit = np.flatnonzero(products >= self.bar[asks][:, None])
                    if len(hit):
                        i, j = np.divmod(hit, len(at))
                        self.new.append((asks[i], at[j], products.ravel()[hit]))
                        self.held += len(hit)
                    if self.held > PRODUCTS // 2:
                        self._keep()
        if self.held > 2 * len(self.row):
            self._keep()

    def _keep(self) -> None:
        """Add the new candidates, each once, and keep those that reach their query's k-th best, but for rounding."""
        if not self.new:
            return
        new, self.new, self.held = self.new, [], 0
        row, at = np.concatenate([self.row, *(x[0] for x in new)]), np.concatenate([self.at, *(x[1] for x in new)])
        product = np.concatenate([self.product, *(x[2] for x in new)])
        other = np.flatnonzero((self.own[row] != self.index.ids[at]) & (product >= self.bar[row]))
        row, at, product = row[other], at[other], product[other]
        _, once = np.unique(row * len(self.index.ids) + at, return_index=True)
        once = once[np.lexsort((-product[once], row[once]))]
        self.row, self.at, self.product = row[once], at[once], product[once]
        begin = np.searchsorted(self.row, np.arange(len(self.q) + 1))
        full = np.flatnonzero(np.diff(begin) >= self.k)
        self.bar[full] = np.maximum(self.bar[full], self.product[begin[full] + self.k - 1] - 2 * self.index.margin)
        good = np.flatnonzero(self.product >= self.bar[self.row])
        self.row, self.at, self.product = self.row[good], self.at[good], self.product[good]

    def compared(self) -> np.ndarray:
        if self.marks is None:
            return self.counts
        out = self.marks.sum(1)
        for a in range(0, len(out), QUERIES):
            i, j = np.nonzero(self.own[a : a + QUERIES, None] == self.index.ids[None])
            np.subtract.at(out, i + a, self.marks[i + a, j])
        return out

    def found(self) -> np.ndarray:
        self._keep()
        return np.bincount(self.row, minlength=len(self.q))

    def kth(self) -> np.ndarray:
        """What the k-th best product found is at least (-inf: fewer were found)."""
        number, _, products, _ = self.best()
        ends = np.cumsum(number)
        out = np.full(len(self.q), -np.inf)
        full = np.flatnonzero(number >= self.k)
        out[full] = products[ends[full] - 1]
        return out

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        self._keep()
        exact = np.empty(len(self.row))
        for a in range(0, len(exact), ROWS):
            exact[a : a + ROWS] = np.einsum("ij,ij->i", self.q[self.row[a : a + ROWS]], self.index.x[self.at[a : a + ROWS]].astype(np.float64))
        exact = np.nan_to_num(exact, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        ids = self.index.ids[self.at]
        order = np.lexsort((ids, -exact, self.row))
        row = self.row[order]
        order = order[np.arange(len(row)) - np.searchsorted(row, row) < self.k]
        return np.bincount(self.row[order], minlength=len(self.q)), ids[order], exact[order], self.compared()


class Cells:
    """The table that deals all rows of one dimension into cells, a band of norms at a time."""

    def __init__(self, dim: int, rows: int, longest: float, ids: np.ndarray, sample: np.ndarray, k: int, tasks: int):
        self.longest, self.ids, self.sample = longest, ids, sample
        blocks = max(rows / BLOCK, min(tasks, SHARES, rows / SPREAD))
        bits = min(CELL_PROJECTIONS, max(0, math.ceil(math.log2(max(blocks, 1)))))
        #: Where a k-th neighbour among all rows stands in the sample, and one further.
        self.rank = math.ceil(k * len(ids) / rows) + 1
        self.tables: dict[int, Table] = {}
        self.rests: dict[int, float] = {}
        bands = self.band(norms(sample))
        for band in range(BANDS):
            full = filled(sample[bands == band], self.bound(band))
            self.tables[band] = Table(dim, bits, 1 << 16)
            self.tables[band].fit(full)
            self.rests[band] = float(full[:, -1].mean()) if len(full) else 0.0

    def band(self, length: np.ndarray) -> np.ndarray:
        return np.clip(np.floor(np.log2(np.maximum(self.longest / length, 1))), 0, BANDS - 1).astype(np.int64)

    def bound(self, band: int) -> float:
        return self.longest / 2.0**band

    def names(self, x: np.ndarray) -> np.ndarray:
        """Each row's cell: its name in the band's table, and the band."""
        bands = self.band(norms(x))
        out = np.zeros(len(x), np.int64)
        for band in np.unique(bands).tolist():
            at = bands == band
            out[at] = self.tables[band].names(filled(x[at], self.bound(band))) << 8 | band
        return out

    def expected(self, own: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The product that each query's k-th neighbour may reach; -inf where the sample is too small to tell."""
        products = np.where(own[:, None] == self.ids[None], -np.inf, q @ self.sample.T)
        if self.rank > products.shape[1]:
            return np.full(len(q), -np.inf)
        return np.partition(products, -self.rank, axis=1)[:, -self.rank]

    def visits(self, q: np.ndarray, kth: np.ndarray, cells: np.ndarray, sizes: np.ndarray, need: int, whole: bool) -> np.ndarray:
        """The cells that each query is sent to (queries x cells): in each band the likeliest, and rows enough to choose from."""
        if whole:
            return np.ones((len(q), len(cells)), bool)
        length = norms(q)
        unit = q / length[:, None]
        chance = np.zeros((len(q), len(cells)))
        out = np.zeros((len(q), len(cells)), bool)
        for band in np.unique(cells & 255).tolist():
            at = np.flatnonzero(cells & 255 == band)
            likeness = np.clip(np.nan_to_num(kth / length / self.bound(band)), 0, 0.995)
            table, rest = self.tables[band], self.rests[band]
            spread = np.sqrt(np.maximum(1 - likeness**2 - rest**2, LEAST_SPREAD**2))
            chance[:, at] = table.chances(likeness[:, None] * (unit @ table.lines[:-1]) + rest * table.lines[-1], spread, cells[at] >> 8)
            out[:, at] = likeliest(chance[:, at], CELL_TARGET)
        few = np.flatnonzero((out * sizes).sum(1) < need)
        if len(few):  # few rows altogether: further cells, the likeliest first
            order = np.argsort(-(chance[few] + out[few]), axis=1, kind="stable")
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            more = np.zeros((len(few), len(cells)), bool)
            np.put_along_axis(more, order, before < need, 1)
            out[few] |= more
        return out


def search(vectors: DataFrame, query_ids: str = "vec_id % 20 = 0", k: int = 20, tables: int = TABLES, target: float = TARGET, exact: bool = True) -> DataFrame:
    """The k nearest candidates of each query, or all if they are fewer: query_id, rank, vec_id, score, compared (the
    candidates that the query was compared with exactly).

    Needs columns vec_id and embedding; others are ignored. Queries are the rows that `query_ids` selects, candidates
    all rows but those of the query's own vec_id; vectors of other lengths aren't compared. Nearest first, ties to the
    smaller vec_id; equal rows count once. Vectors that are null, empty, zero or hold null or non-finite parts, and rows
    with a null vec_id, take no part. Without queries or candidates there are no rows. Without `exact`, about the target's
    share of the neighbours is found.
    """
    spark = vectors.sparkSession
    kind = precision(vectors)
    rows = prepared(vectors)
    known = _known(rows)
    if any(r["most"] > 1 for r in known):
        # Copies of a row would take each other's candidates' places.
        rows = common.materialize(rows.distinct(), "vectors")
        known = _known(rows)
    found = None
    for r in known:
        one = _search(rows.where(F.col("dim") == r["dim"]), r["dim"], r["n"], r["longest"], r["most"], kind, query_ids, k, tables, target, exact)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, compared long")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[pa.RecordBatch] = []  # of the query that the next batch may go on with
        for batch in batches:
            if batch.num_rows:
                both = pa.concat_batches([*left, batch])
                ids = both.column(0).to_numpy()
                last = int(np.searchsorted(ids, ids[-1]))
                if last:
                    yield _ranked(both.slice(0, last), k)
                left = [both.slice(last)]
        if left:
            yield _ranked(left[0], k)

    return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double, compared long")


def _ranked(found: pa.RecordBatch, k: int) -> pa.RecordBatch:
    """The k best of each query's lists (rows by query_id)."""
    own, begin, at = np.unique(found.column(0).to_numpy(), return_index=True, return_inverse=True)
    minus, ids = found.column(2).flatten().to_numpy(), found.column(3).flatten().to_numpy()
    query = np.repeat(at, np.diff(found.column(2).offsets.to_numpy()))
    order = np.lexsort((ids, minus, query))
    query, minus, ids = query[order], minus[order], ids[order]
    new = np.append(True, (query[1:] != query[:-1]) | (minus[1:] != minus[:-1]) | (ids[1:] != ids[:-1]))[: len(query)]
    query, minus, ids = query[new], minus[new], ids[new]
    rank = np.arange(len(query)) - np.searchsorted(query, query) + 1
    query, minus, ids, rank = (x[rank <= k] for x in (query, minus, ids, rank))
    compared = np.add.reduceat(found.column(1).to_numpy(), begin)
    return pa.RecordBatch.from_arrays([pa.array(own[query]), pa.array(rank.astype(np.int32)), pa.array(ids), pa.array(-minus), pa.array(compared[query])], ["query_id", "rank", "vec_id", "score", "compared"])


def _known(rows: DataFrame) -> list:
    """Of each dimension how many rows there are, their largest norm, and most rows of one vec_id."""
    of_id = rows.groupBy("dim", "vec_id").agg(F.count("*").alias("n"), F.max("norm").alias("norm"))
    return sorted(of_id.groupBy("dim").agg(F.sum("n").alias("n"), F.max("norm").alias("longest"), F.max("n").alias("most")).collect())


def _search(rows: DataFrame, dim: int, n: int, longest: float, most: int, kind: type, query_ids: str, k: int, tables: int, target: float, exact: bool) -> DataFrame:
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(SAMPLE_ROWS).select("vec_id", "vector").toArrow()
    shared = spark.sparkContext.broadcast(Cells(dim, n, longest, sample["vec_id"].to_numpy(), as_matrix(sample["vector"], kind).astype(np.float64), k, common.partitions(spark)))

    asked = _asked(rows, sample, k, kind) if n > SAMPLE_ROWS else None

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared.value.names(as_matrix(batch.column(1), kind).astype(np.float64)))], ["id", "vector", "cell"])

    dealt = rows.select("vec_id", "vector").mapInArrow(deal, "id long, vector binary, cell long")
    # At most 2^CELL_PROJECTIONS cells in each band.
    sizes = {r["cell"]: r["n"] for r in dealt.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    cells = np.array(sorted(sizes), np.int64)
    size = np.array([sizes[c] for c in cells.tolist()], np.int64)
    parts = -(-size // BLOCK)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, QUERIES):
                batch = whole.slice(a, QUERIES)
                own, q = batch.column(0).to_numpy(), as_matrix(batch.column(1), kind).astype(np.float64)
                kth = shared.value.expected(own, q)
                row, at = np.nonzero(shared.value.visits(q, kth, cells, size, k + most, exact))
                times = parts[at]
                part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row = np.repeat(row, times)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(np.repeat(cells[at], times)), pa.array(part.astype(np.int32)), pa.array(kth[row])], ["id", "vector", "cell", "part", "kth"])

    hot = [F.lit(x) for c, p in zip(cells.tolist(), parts.tolist(), strict=True) if p > 1 for x in (c, p)]
    part = F.coalesce(F.pmod(F.xxhash64("id"), F.try_element_at(F.create_map(*hot), F.col("cell"))).cast("int"), F.lit(0)) if hot else F.lit(0)
    base = dealt.select("id", "vector", "cell", part.alias("part"), F.lit(None).cast("double").alias("kth"))
    asking = rows.where(query_ids).select("vec_id", "vector").mapInArrow(probe, "id long, vector binary, cell long, part int, kth double")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index = None, None
        ids: list[np.ndarray] = []
        vectors: list[np.ndarray] = []
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def answers(index: Index) -> Iterator[pa.RecordBatch]:
            own, x, kth = (np.concatenate(w) for w in zip(*waiting, strict=True))
            waiting.clear()
            for a in range(0, len(own), step := index.together()):
                part = own[a : a + step]
                yield _lists(part, *index.search(part, x[a : a + step].astype(np.float64), kth[a : a + step], k, exact))

        for batch in batches:
            if not batch.num_rows:
                continue
            own, x = batch.column(0).to_numpy(), as_matrix(batch.column(1), kind)
            cell, part_, asks = batch.column(2).to_numpy(), batch.column(3).to_numpy(), batch.column(4).is_valid().to_numpy(zero_copy_only=False)
            kth = batch.column(4).to_numpy(zero_copy_only=False)
            new = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (part_[1:] != part_[:-1]) | (asks[1:] != asks[:-1])))
            for a, b in zip(new, np.append(new[1:], len(own)), strict=True):
                if (cell[a], part_[a]) != now:
                    if waiting:
                        yield from answers(index)
                    now, index, ids, vectors = (cell[a], part_[a]), None, [], []
                if not asks[a]:
                    ids.append(own[a:b].copy())
                    vectors.append(x[a:b].copy())
                elif ids or index:
                    if index is None:
                        index = Index(np.concatenate(ids), np.concatenate(vectors), shared.value.expected, k, tables, target, asked.value if asked else None)
                        ids, vectors = [], []
                    waiting.append((own[a:b].copy(), x[a:b].copy(), kth[a:b].copy()))
                    if sum(len(w[0]) for w in waiting) >= index.together():
                        yield from answers(index)
        if waiting:
            yield from answers(index)

    both = base.unionByName(asking).repartition("cell", "part").sortWithinPartitions("cell", "part", F.col("kth").asc_nulls_first(), "id")
    return both.select("id", "vector", "cell", "part", "kth").mapInArrow(compare, FOUND)


def _asked(rows: DataFrame, sample: pa.Table, k: int, kind: type) -> Broadcast:
    """Some rows of the sample, and the products that their k-th neighbours among all rows reach."""
    some = np.unique(np.linspace(0, sample.num_rows - 1, ASKED).astype(np.int64))
    own, q = sample["vec_id"].to_numpy()[some], as_matrix(sample["vector"], kind)[some].astype(np.float64)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.full((len(own), k), -np.inf)
        for batch in batches:
            for a in range(0, batch.num_rows, SAMPLE_ROWS):
                part = batch.slice(a, SAMPLE_ROWS)
                products = np.where(own[:, None] == part.column(0).to_numpy()[None], -np.inf, q @ as_matrix(part.column(1), kind).astype(np.float64).T)
                top = np.partition(np.hstack([top, np.nan_to_num(products, nan=-np.inf, posinf=np.inf, neginf=-np.inf)]), -k, axis=1)[:, -k:]
        yield pa.RecordBatch.from_arrays([pa.array([top.tobytes()], pa.binary())], ["top"])

    # One row for each task that read rows.
    tops = rows.select("vec_id", "vector").mapInArrow(best, "top binary").toArrow()["top"]
    top = np.full((len(own), k), -np.inf)
    for one in tops:
        top = np.partition(np.hstack([top, np.frombuffer(one.as_py()).reshape(len(own), k)]), -k, axis=1)[:, -k:]
    return rows.sparkSession.sparkContext.broadcast((own, q, top.min(1)))


def _lists(own: np.ndarray, number: np.ndarray, ids: np.ndarray, products: np.ndarray, compared: np.ndarray) -> pa.RecordBatch:
    ends = pa.array(np.append(0, np.cumsum(number)).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(own), pa.array(compared.astype(np.int64)), pa.ListArray.from_arrays(ends, pa.array(-products)), pa.ListArray.from_arrays(ends, pa.array(ids))], ["query_id", "compared", "minus", "vec_id"])
