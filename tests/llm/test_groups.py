"""Near-duplicates, components and vector search against brute force."""

import random
import time

import numpy as np
import pytest

from tidemark.llm import ann, buckets, hyperminhash, queries, rabitq
from tidemark.llm.components import components


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    pairs = [(n, n + 1) for n in range(100, 140)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(7, 7), (None, 3), (5, 4), (4, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    real = [(a, b) for a, b in pairs if a is not None and a != b]
    want = roots({x for p in real for x in p}, real)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_documents(rows):
    sets = {}
    for n, text in rows:
        words = (text or "").encode().lower().split()
        sets.setdefault(n, []).append({tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    ids = [n for n in sets if n is not None]
    pairs = [(a, b) for a in ids for b in ids if a < b and any(x and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b])]
    return roots(ids, pairs)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    words = [f"w{n}" for n in range(3000)]
    rows, n = [], 0
    for size in [3, 6, 12, 40, 150, 600] * 4:
        base = [rng.choice(words) for _ in range(size)]
        for edits in (0, 0, 1, 2, size // 30, size // 8):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((n, (" " if n % 2 else "\n\t").join(copy).upper() if n % 3 else " ".join(copy)))
            n += 1
    passage = " ".join(rng.choice(words) for _ in range(60))  # that many share
    for _ in range(80):
        rows.append((n, " ".join(rng.choice(words) for _ in range(200)) + " " + passage))
        n += 1
    base = [rng.choice(words) for _ in range(300)]  # a group of near copies
    for _ in range(90):
        copy = list(base)
        for _ in range(4):
            copy[rng.randrange(300)] = rng.choice(words)
        rows.append((n, " ".join(copy)))
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, None), (n + 4, "one"), (n + 5, "ONE"), (n + 6, "É"), (n + 7, "é"), (n + 8, "long " * 30000)]
    return rows


@pytest.mark.parametrize("block", [2048, 16])
def test_near_duplicates_equal_brute_force(spark, texts, monkeypatch, block):
    monkeypatch.setattr(hyperminhash.buckets, "BLOCK", block)
    original = buckets.blocks
    monkeypatch.setattr(hyperminhash.buckets, "blocks", lambda rows: original(rows, block))
    docs = spark.createDataFrame([(*r, 1, 2, 3, b"x") for r in texts], "doc_id long, text string, n int, bucket int, component int, registers binary")
    got = hyperminhash.near_duplicates(docs).collect()
    want = brute_documents(texts)
    assert len(got) == len(texts)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_with_repeated_and_null_ids(spark):
    a, b = "a b c d e f g h", "q r s t u v w x"
    rows = [(5, a), (5, b), (2, a), (9, b), (2, a), (None, a), (None, None), (7, "lonely")]
    got = hyperminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, -1), (2, 2), (2, 2), (5, 2), (5, 2), (7, 7), (9, 2)]
    assert all(r.kept for r in got if r.doc_id is None)
    assert hyperminhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketches_estimate_the_index():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2))
    for shared in (0, 1000, 3000):
        own = np.unique(np.concatenate([base[:shared], rng.integers(0, 1 << 63, 4000 - shared, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]))
        index = shared / (len(base) + len(own) - shared)
        est, used = hyperminhash.jaccard(hyperminhash.sketch(base), hyperminhash.sketch(own), np.int64(len(base)), np.int64(len(own)))
        assert used == 128 and abs(est - index) < 0.15
    assert not hyperminhash.sketch(np.zeros(0, np.uint64)).any()


def test_sketch_registers_hold_zeros_and_mantissa():
    # In bucket 3, a hash whose remaining bits are 0001 0110...: three zeros, then the bits after the first one.
    h = np.array([(3 << 57) | (0b0001011 << 50)], np.uint64)
    assert hyperminhash.sketch(h)[3] == (4 << 10) | (0b0110000000 << 0)


def embeddings(rng):
    rows, n = [], 0
    for label in (0, 1, None):
        for _ in range(120):
            rows.append((n, rng.standard_normal(24).tolist(), label))
            n += 1
    for size in (2, 5, 70):
        base = rng.standard_normal(24)
        for k in range(size):
            rows.append((n, (base * (1 + k) + 0.1 * (1 + k) * rng.standard_normal(24) * (k % 3)).tolist(), 1 if k % 7 else 0))
            n += 1
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 24, 1), (n + 3, [float("nan")] * 24, 1), (n + 4, [1.0, None], 1), (n + 5, [1e300] * 24, 1), (n + 6, [1e-300] * 24, 1), (n + 7, [1.0, 2.0], 1), (n + 8, [2.0, 4.0], 1)]
    return rows


def test_vector_links_equal_brute_force(spark):
    rows = embeddings(np.random.default_rng(8))
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, bucket int, code int")
    ok = {n: (np.array(x) / np.abs(x).max(), label) for n, x, label in rows if x and None not in x and np.isfinite(x).all() and np.any(x) and label is not None}
    pairs = [(a, b) for a in ok for b in ok if a < b and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and ok[a][0] @ ok[b][0] / np.linalg.norm(ok[a][0]) / np.linalg.norm(ok[b][0]) >= 0.93]
    links = dict.fromkeys((r[0] for r in rows), 0)
    for p in pairs:
        for x in p:
            links[x] += 1
    want = roots(links, pairs)
    got = rabitq.near_duplicates(frame).collect()
    assert len(pairs) > 800 and len(got) == len(rows)
    assert {r.vec_id: r.n_links for r in got} == links
    assert {r.vec_id: r.component_id for r in got} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_vector_copies_and_hot_buckets(spark, monkeypatch):
    original = buckets.blocks
    monkeypatch.setattr(rabitq.buckets, "blocks", lambda rows: original(rows, 20))
    rng = np.random.default_rng(3)
    base = rng.standard_normal(16)
    near = [(base + 0.02 * rng.standard_normal(16)).tolist() for _ in range(130)]
    rows = [(n, x, 4) for n, x in enumerate(near)] + [(500 + n, base.tolist(), 4) for n in range(50)] + [(500, base.tolist(), 4), (None, base.tolist(), 4)]
    got = rabitq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(got) == len(rows)
    assert all(r.n_links == 179 and r.component_id == 0 for r in got if r.vec_id is not None)
    assert rabitq.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_estimates_are_unbiased_and_within_their_bounds():
    rng = np.random.default_rng(6)
    turn = rabitq.rotation(64, 256)
    assert np.allclose(turn.T @ turn, np.eye(64))
    x, y = (z / np.linalg.norm(z, axis=1, keepdims=True) for z in rng.standard_normal((2, 4000, 64)))
    y = (x + y) / np.linalg.norm(x + y, axis=1, keepdims=True)
    px, py = x @ turn.T, y @ turn.T
    factor = np.abs(px).sum(1) / 16
    est = (np.sign(px) * py).sum(1) / 16 / factor
    real = (x * y).sum(1)
    assert abs((est - real).mean()) < 0.003
    assert (np.abs(est - real) <= rabitq.SURE * np.sqrt(1 - factor**2) / factor / np.sqrt(255)).mean() > 0.999


def brute_search(rows, k=20):
    ok = {n: np.array(x) for n, x, *_ in rows if n is not None and x and None not in x and np.isfinite(x).all() and np.any(x)}
    return {q: sorted((-float((ok[q] * x).sum()), n) for n, x in ok.items() if n != q and len(x) == len(ok[q]))[:k] for q in ok if q % 20 == 0}


def test_search_finds_the_nearest(spark):
    rng = np.random.default_rng(1)
    rows = [(n, (rng.standard_normal(32) * (1 + n % 3)).tolist(), 5) for n in range(1500)] + [(n, [1.0] * 32, 5) for n in range(1500, 1560)]
    rows += [(2000, None, 1), (2020, [0.0] * 32, 1), (2040, [float("inf")] * 32, 1), (None, [1.0] * 32, 1), (2060, [1.0, 2.0], 1), (2061, [2.0, 1.0], 1), (1520, [1.0] * 32, 5)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")).collect()
    want = brute_search(rows)
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == {q for q, x in want.items() if x}
    hits = total = 0
    for q, rows_ in found.items():
        rows_.sort()
        assert [r[0] for r in rows_] == list(range(1, len(rows_) + 1))
        assert [(-r[2], r[1]) for r in rows_] == sorted((-r[2], r[1]) for r in rows_) and q not in {r[1] for r in rows_}
        hits += len({r[1] for r in rows_} & {n for _, n in want[q]})
        total += len(want[q])
    assert hits / total >= 0.9
    equal = [r[1] for r in found[1500] if 1500 < r[1] < 1560]
    assert len(equal) > 3 and equal == list(range(1501, 1501 + len(equal)))  # ties to the smaller id
    assert [r[1] for r in found[2060]] == [2061]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def found_by(frame):
    found = {}
    for r in ann.search(frame).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    return found


def test_search_finds_the_nearest_in_hot_groups_and_among_unequal_norms(spark):
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(rng.standard_normal((6000, 64)))
    for g in range(2):
        x[g * 1900 : (g + 1) * 1900] = unit(unit(rng.standard_normal(64)) + 0.0125 * rng.standard_normal((1900, 64)))
    for vectors in (x, x * np.exp(rng.standard_normal((6000, 1)))):
        rows = [(int(n), v.tolist()) for n, v in zip(rng.permutation(6000), vectors, strict=True)]
        want = {q: {n for _, n in best} for q, best in brute_search(rows).items()}
        assert found_by(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == want


def test_search_of_few_rows_finds_all_candidates(spark):
    rng = np.random.default_rng(9)
    few = [(n * 20, rng.standard_normal(64).tolist()) for n in range(12)]
    some = [(n * 20, rng.standard_normal(48).tolist()) for n in range(100, 160)]
    copies = [(n * 10, rng.standard_normal(32).tolist()) for n in range(400, 430)]
    rows = few + some + copies
    want = {q: {n for _, n in best} for q, best in brute_search(rows).items()}
    assert {len(want[n]) for n, _ in few} == {11}
    assert found_by(spark.createDataFrame(rows + 40 * copies[:1], "vec_id long, embedding array<double>")) == want


def hits_and_share(frame, rows):
    """Recall of the index without its exact step, and the share of the candidates that a query was compared with."""
    want = {q: {n for _, n in best} for q, best in brute_search(rows).items()}
    found, compared = {}, {}
    for r in ann.search(frame, exact=False).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
        compared[r.query_id] = r.compared
    assert all(len(found[q]) == len(x) for q, x in want.items())
    return sum(len(found[q] & x) for q, x in want.items()) / sum(map(len, want.values())), sum(compared.values()) / len(compared) / (len(rows) - 1)


def test_the_index_compares_an_ever_smaller_share(spark):
    shares = []
    for n in (500, 2000, 8000):
        rows = [(k, x.tolist()) for k, x in enumerate(np.random.default_rng(2).standard_normal((n, 64)))]
        recall, share = hits_and_share(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), rows)
        assert recall >= 0.9
        shares.append(share)
    assert shares[0] < 0.65 and shares[0] > shares[1] > shares[2] and shares[2] < 0.45


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_the_registered_search_on_driver_tables(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    want = {q: {n for _, n in best} for q, best in brute_search(rows).items()}
    vectors = {n: np.array(x) for n, x in rows}
    got = queries.op10_ann(spark, f"/root/testdata/{sf}").collect()
    assert sum(r.vec_id in want[r.query_id] for r in got) / sum(map(len, want.values())) >= 0.9
    assert len(got) == sum(map(len, want.values()))
    assert all(abs(r.score - vectors[r.query_id] @ vectors[r.vec_id]) < 1e-12 for r in got)
    assert sum(r.compared for r in got) / len(got) / (len(rows) - 1) < 0.65


def test_the_index_in_hot_groups_and_beside_a_long_vector(spark):
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(rng.standard_normal((6000, 64)))
    for g in range(2):
        x[g * 1900 : (g + 1) * 1900] = unit(unit(rng.standard_normal(64)) + 0.0125 * rng.standard_normal((1900, 64)))
    ids = rng.permutation(6000)
    long = x.copy()
    long[5000] *= 1e6
    for vectors in (x, x * np.exp(rng.standard_normal((6000, 1))), long):
        rows = [(int(n), v.tolist()) for n, v in zip(ids, vectors, strict=True)]
        recall, share = hits_and_share(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), rows)
        assert recall >= 0.9 and share < 0.5


def test_a_block_costs_less_than_multiplying_all():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((60_000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, real = np.arange(len(x)), x.astype(np.float64)
    own = ids[::20]
    some = rng.permutation(ids)[: ann.SAMPLE_ROWS]
    cells = ann.Cells(64, len(x), 1.0, ids[some], real[some], 20, 1)
    index = ann.Index(ids, x, cells.expected, 20)
    kth = cells.expected(own, real[own])
    began = time.process_time()
    number, found, products, compared = index.search(own, real[own], kth, 20)
    took = time.process_time() - began
    began = time.process_time()
    want = []
    for q in own:
        p = real @ real[q]
        p[q] = -np.inf
        want.append(set(np.argpartition(-p, 20)[:20].tolist()))
    assert took < time.process_time() - began
    assert (number == 20).all() and sum(len(w & set(f.tolist())) for w, f in zip(want, found.reshape(-1, 20), strict=True)) >= 0.9 * 20 * len(own)
    assert np.abs(products - np.einsum("ij,ij->i", real[np.repeat(own, 20)], real[found])).max() < 1e-12
    assert compared.mean() < 0.4 * len(x)


def test_a_query_goes_to_a_bounded_number_of_blocks():
    x = np.random.default_rng(8).standard_normal((ann.SAMPLE_ROWS, 64))
    cells = ann.Cells(64, 15_000_000, float(np.linalg.norm(x, axis=1).max()), np.arange(len(x)), x, 20, 600)
    assert len(np.unique(cells.tables[0].names(ann.filled(x, cells.longest)))) <= 32


def test_copies_of_vectors_are_not_compared_again(spark):
    x = np.random.default_rng(3).standard_normal((50, 64))
    rows = [(n, x[n % 50].tolist()) for n in range(8000)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), exact=False).collect()
    assert len(got) == 400 * 20
    for r in got:  # the smallest ids of the query's own vector
        first = [n for n in range(r.query_id % 50, 8000, 50) if n != r.query_id]
        assert r.vec_id == first[r["rank"] - 1]
        assert r.compared <= 4 * 50 * 21


def test_vectors_of_repeated_and_null_ids(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(5, a, 1), (5, b, 1), (2, a, 1), (9, [0.05, 1.0, 0.0], 1), (2, a, 1), (None, a, 1), (7, c, 1), (8, c, 2)]
    got = rabitq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id or -1) for r in got) == [(-1, 0, -1), (2, 1, 2), (2, 1, 2), (5, 1, 2), (5, 1, 2), (7, 0, 7), (8, 0, 8), (9, 1, 2)]
    assert all(r.kept for r in got if r.vec_id is None)


def test_dense_groups_cost_rows_in_proportion(spark):
    for n in (2000, 20_000):
        rows = spark.range(n).selectExpr("1L AS bucket", "id", "IF(id < 3, id, 100L) AS known", f"{n}L AS n")
        met = buckets.dealt(rows, 100, "known")
        assert met.count() <= 2.1 * n
        assert met.where("lo = hi").select("id").distinct().count() == 3  # only the others' blocks meet themselves
        assert buckets.dealt(rows.withColumn("known", rows.n), 100, "known").count() == 0
        pairs = {(r.lo, r.hi) for r in met.select("lo", "hi").distinct().collect()}
        assert pairs == {(0, 0)} | {(0, k) for k in range(1, -(-(n - 3) // 100) + 1)}


def test_blocks_of_known_groups_let_all_others_meet(spark):
    rng = random.Random(5)
    rows = [(b, n, rng.choice([1000 + b, 1000 + b, 2000 + b, None])) for b, size in ((1, 90), (2, 7), (3, 41), (4, 1)) for n in range(100 * b, 100 * b + size)]
    met = buckets.blocks(spark.createDataFrame(rows, "bucket long, id long, grp long"), 10, "grp").collect()
    held = {}
    for r in met:
        held.setdefault((r.bucket, r.lo, r.hi), []).append(r)
    together = {(min(x.id, y.id), max(x.id, y.id)) for (_, lo, hi), rs in held.items() for x in rs for y in rs if x.id != y.id and (lo == hi or x.own != y.own)}
    want = {(x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[1] < y[1] and (x[2] is None or x[2] != y[2])}
    assert want <= together


@pytest.mark.parametrize("spread", [0.02, 0.055])
def test_vector_cores_equal_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(buckets, "BLOCK", 20)
    rng = np.random.default_rng(12)
    rows, n = [], 0
    for size in (90, 60, 8):
        base = rng.standard_normal(16)
        for _ in range(size):
            x = base / np.linalg.norm(base) + spread * rng.standard_normal(16)
            rows += [(n, x.tolist(), 1)] + [(n + 1000, x.tolist(), 1)] * (n % 9 == 0)
            n += 1
    rows += [(n + k, rng.standard_normal(16).tolist(), 1) for k in range(60)]
    rows += [(0, rows[0][1], 1), (9001, rows[0][1], 2), (None, rows[0][1], 1)]
    own = {}
    for k, x, label in rows:
        if k is not None:
            own.setdefault(k, set()).add((tuple(x), label))
    one = {k: [(np.array(x) / np.linalg.norm(x), label) for x, label in v] for k, v in own.items()}
    near = lambda a, b: any(p[1] == q[1] and p[0] @ q[0] >= 0.93 for p in one[a] for q in one[b])
    pairs = [(a, b) for a in one for b in one if a < b and near(a, b)]
    got = rabitq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(got) == len(rows) and len(pairs) > 300
    assert {r.vec_id: r.component_id for r in got if r.vec_id is not None} == roots(one, pairs)
    links = dict.fromkeys(one, 0)
    for p in pairs:
        for x in p:
            links[x] += 1
    assert {r.vec_id: r.n_links for r in got if r.vec_id is not None} == links


def test_documents_of_large_buckets_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(buckets, "BLOCK", 16)
    monkeypatch.setattr(buckets, "SMALL", 8)
    monkeypatch.setattr(hyperminhash, "SETTLE_BLOCK", 12)
    rng = random.Random(3)
    words = [f"w{n}" for n in range(4000)]
    rows = []
    for edits, size in ((4, 70), (7, 60), (9, 50)):  # around the threshold, links join some and not others
        base = [rng.choice(words) for _ in range(250)]
        for _ in range(size):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(250)] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    want = brute_documents(rows)
    got = hyperminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert 5 < len(set(want.values())) < 120
    assert {r.doc_id: r.component_id for r in got} == want
