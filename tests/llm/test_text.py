"""Tokenising, packing, sharding and sampling."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe, dsir, packing, queries, sharding

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["Hello world, it's   a test.\n\n  New line ", "", None, "a" * 3000, "日本語 🙂 \x1c\x1f naïve", "x <|endoftext|> y<|endoftext|>", "  ", " \n \t end ", "word " * 5000, "don't I'll they've 12 ²½ ٣"]
#: Columns of names that the operators use themselves.
CLASHING = {"ids": 1, "length": 2, "piece": 3, "salt": 4, "bucket": 5, "n": 6, "print": 7, "component": 8, "registers": 9, "key": 10, "is_target": 11, "own": 12, "score": 13, "slot": 14, "shard": 15}


@pytest.fixture(scope="module")
def auto():
    return bpe.automaton(open(PATH, "rb").read())


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(n, x, *CLASHING.values()) for n, x in enumerate(TEXTS)] + [(0, TEXTS[0], *CLASHING.values()), (None, "no id", *CLASHING.values()), (None, None, *CLASHING.values())]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} int" for c in CLASHING))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aehtion sTHE \n\t'.,12"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_ids_equal_the_library_and_decode(auto, library, text):
    ids = auto.encode(text)
    assert list(ids) == library(text)
    assert auto.decode(ids) == text


def test_small_automaton_accepts_only_what_bpe_makes():
    vocab = {c: n for n, c in enumerate("abc")} | {"aa": 3, "ab": 4, "aab": 5, "bc": 6}
    merges = [("a", "a"), ("a", "b"), ("aa", "b"), ("b", "c")]

    def slow(word):
        parts = list(word)
        for a, b in merges:
            k = 0
            while k < len(parts) - 1:
                if (parts[k], parts[k + 1]) == (a, b):
                    parts[k : k + 2] = [a + b]
                k += 1
        return [vocab[p] for p in parts]

    auto = bpe.Automaton(vocab, merges)
    rng = random.Random(5)
    for _ in range(2000):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        assert list(auto.word(word.encode())) == slow(word), word


def test_round_trip_digests(spark, docs, library):
    got = bpe.round_trip(docs, PATH).collect()
    assert len(got) == docs.count()
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    for n, text in enumerate(TEXTS):
        ids = library(text)
        assert by_id[n].n_tokens == len(ids)
        assert by_id[n].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert by_id[n].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0


def test_encode_then_decode_frames(docs):
    encoded = bpe.encode_documents(docs, PATH)
    back = {r.doc_id: r.text for r in bpe.decode_ids(encoded, PATH).collect()}
    assert all(back[n] == (text or "") for n, text in enumerate(TEXTS))


def check_packing(rows, texts_by_id, library, capacity):
    ids = {k: [*library(t), 0] for k, t in texts_by_id.items()}
    sequences = {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return sequences


def test_packing_is_whole_and_gapless(docs, library):
    kept = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = packing.pack_documents(kept, PATH).collect()
    sequences = check_packing(rows, dict(enumerate(TEXTS)), library, packing.CAPACITY)
    total = sum(len(library(t)) + 1 for t in TEXTS)
    assert sum(r.length for r in rows) == total
    assert len(sequences) <= -(-total // packing.CAPACITY) + 1
    for n, text in enumerate(TEXTS):
        own = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == n)
        assert [p for p, _, _ in own] == list(range(len(own)))
        assert all(length == packing.CAPACITY for _, _, length in own[1:])
        assert sum(length for _, _, length in own) == len(library(text)) + 1


def test_packing_of_repeats_nulls_and_nothing(docs):
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0
    rows = packing.pack_documents(docs, PATH).collect()
    assert sum(r.doc_id is None for r in rows) == 2 and len([r for r in rows if r.doc_id == 0]) == 2


def little_endian(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def test_packing_splits_and_merges_whole_texts_at_once(library):
    enc = packing.encoder(open(PATH, "rb").read())
    held = len(enc.young) + len(enc.old)
    text = " ".join(f"wordof{chr(97 + n % 26)}{chr(97 + n // 26 % 26)} it's {n}," for n in range(2000))
    assert enc.encode(text) == little_endian(library(text))
    assert len(enc.young) + len(enc.old) == held  # a worker holds no words of such texts, however many there are


@pytest.mark.parametrize("text", [" " * 1_200_000 + "x", "a b" * 50_000 + "\n " * 300_000 + "<|endoftext|> end", "é" * 150_000])
def test_packing_of_long_stretches(library, text):
    assert packing.encoder(open(PATH, "rb").read()).encode(text) == little_endian(library(text))


def test_packing_cuts_long_texts_only_where_words_begin(library, monkeypatch):
    monkeypatch.setattr(packing, "SPAN", 7)
    enc, rng = packing.encoder(open(PATH, "rb").read()), random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choices("ab  \n'st.1é\u00a0\x1c\x85", k=rng.randint(1, 40)))
        assert enc.encode(text) == little_endian(library(text)), text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 49), max_size=120))
def test_plan_packs_each_length_as_often_as_it_occurs(lengths):
    counts = {k: lengths.count(k) for k in set(lengths)}
    plan = packing.plan_bins(counts, 50)
    assert packing.lengths_of(plan) == sorted(lengths)
    assert all(sum(x) <= 50 for x, _ in plan)


def test_two_smaller_pieces_take_the_place_of_the_smallest():
    # Greedily 60 + 30 leave a gap of 10; 21 + 19 fill it better than 30.
    plan = packing.plan_bins({60: 1, 30: 1, 21: 1, 19: 1}, 100)
    assert sorted(map(sorted, (x for x, _ in plan))) == [[19, 21, 60], [30]]


def test_sharding(spark, docs):
    big = spark.range(4000).selectExpr("id as doc_id", "if(id % 3 = 0, null, repeat('é', int(id % 50))) as text", "1 as shard", "2 as salt")
    tree, grown = sharding.topology(40), sharding.topology(41)
    rows = sharding.assign(big, tree, grown).collect()
    assert len(rows) == 4000
    texts = {n: "" if n % 3 == 0 else "é" * (n % 50) for n in range(4000)}
    slots = {}
    for r in rows:
        assert r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        assert 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(slots) == 40 and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert 40 < sum(r.grown_shard == 40 for r in rows) < 200
    assert max(map(len, slots.values())) < 160
    again = sharding.assign(docs, tree).collect()
    assert len(again) == docs.count() and len({r.shard for r in again if r.doc_id is None}) == 1
    assert sharding.assign(docs.limit(0), tree, grown).count() == 0


def test_weights_move_rows_only_into_the_heavier_subtree(spark):
    tree = sharding.topology(8, 8)
    heavier = [sharding.Shard(s.region, s.rack, s.number, 2.0 if s.number == 3 else 1.0) for s in tree]
    rows = sharding.assign(spark.range(3000).selectExpr("id as doc_id", "'' as text"), tree, heavier).collect()
    moved = [r for r in rows if r.shard != r.grown_shard]
    region = {s.number: s.region for s in tree}
    assert moved and all(region[r.grown_shard] == region[3] for r in moved)
    share = sum(r.grown_shard == 3 for r in rows) / len(rows)
    assert abs(share - 2 / 9) < 0.03


def test_resampling_prefers_the_target(spark):
    good, bad = "the quick brown fox jumps over it", "zq xv kk zz qq jj vv"
    docs = spark.createDataFrame([(n, good if n % 2 else bad, 1) for n in range(200)] + [(200, None, 1), (201, "", 1), (None, good, 1), (3, good, 1)], "doc_id long, text string, key int")
    labels = spark.createDataFrame([(n, n % 2, 0) for n in range(100)], "doc_id long, quality int, text int")
    rows = dsir.resample(docs, labels).collect()
    assert len(rows) == 204
    chosen = [r for r in rows if r.selected]
    assert abs(len(chosen) - 102) <= 1
    assert sum(r.doc_id is not None and r.doc_id % 2 for r in chosen) > 90
    ranked = sorted((r.gumbel_key for r in rows), reverse=True)
    assert min(r.gumbel_key for r in chosen) >= ranked[len(chosen) - 1]
    assert dsir.resample(docs.limit(0), labels).count() == 0
    assert {r.log_weight for r in dsir.resample(docs, labels.limit(0)).collect()} == {0.0}


def test_cutoff_is_exact_beyond_one_histogram(spark, monkeypatch):
    monkeypatch.setattr(dsir, "FINE", 5)
    keyed = spark.range(5000).selectExpr("cast(id % 1000 as double) / 7 as key", "id as doc_id")
    order = sorted(((n % 1000) / 7, n) for n in range(5000))[::-1]
    for k in (1, 7, 1234, 4999):
        assert dsir.cutoff(keyed, k) == pytest.approx(order[k - 1])
    assert dsir.cutoff(keyed, 5000) is None


def test_cutoff_among_many_equal_keys(spark):
    keyed = spark.range(30_000).selectExpr("IF(id < 20000, 1.5D, CAST(id AS DOUBLE)) AS key", "id * 3 AS doc_id")
    order = sorted(((r.key, r.doc_id) for r in keyed.collect()), reverse=True)
    for k in (1, 9_999, 10_000, 10_001, 22_345, 29_999):
        assert dsir.cutoff(keyed, k) == order[k - 1]


def test_resampling_equals_brute_force(spark, sf_dir):
    import xxhash

    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.quality == 1}
    mask, mul = (1 << 64) - 1, lambda a, b: a * b & (1 << 64) - 1

    def grams(text):
        h = [xxhash.xxh3_64_intdigest(w) for w in text.lower().split()]
        out = [x % dsir.BUCKETS for x in h]
        for x, y in zip(h, h[1:], strict=False):
            z = mul(x, 0x9E3779B97F4A7C15) ^ y
            z = mul(z ^ z >> 31, 0xBF58476D1CE4E5B9)
            out.append((z ^ z >> 29 & mask) % dsir.BUCKETS)
        return out

    raw, target = [dsir.ADDED] * dsir.BUCKETS, [dsir.ADDED] * dsir.BUCKETS
    all_ = {n: grams(t) for n, t in docs.items()}
    for n, gs in all_.items():
        for g in gs:
            raw[g] += 1
            target[g] += n in good
    ratio = np.log(np.array(target) / sum(target)) - np.log(np.array(raw) / sum(raw))
    got = {r.doc_id: r for r in queries.op2_dsir(spark, sf_dir).collect()}
    noise = {r.doc_id: r.u for r in spark.createDataFrame([(n,) for n in docs], "doc_id long").selectExpr("doc_id", "xxhash64(doc_id, 17) AS u").collect()}
    keys = {}
    for n, gs in all_.items():
        u = (((noise[n] & mask) >> 11) + 0.5) * 2.0**-53
        keys[n] = ratio[gs].sum() - np.log(-np.log(u))
        assert got[n].n_ngrams == len(gs) and abs(got[n].log_weight - ratio[gs].sum()) < 1e-6 and abs(got[n].gumbel_key - keys[n]) < 1e-6
    best = sorted(docs, key=lambda n: (got[n].gumbel_key, n), reverse=True)[: -(-len(docs) // 2)]
    assert {n for n, r in got.items() if r.selected} == set(best)


def test_the_tree_draws_are_recomputed(spark, sf_dir):
    rows = queries.op5_sharding(spark, sf_dir).collect()
    ids = spark.createDataFrame([(r.doc_id,) for r in rows], "doc_id long")

    def draws(names):
        cols = ", ".join(f"xxhash64(doc_id, '{x}') AS `{x}`" for x in names)
        return {r.doc_id: {x: -np.log((((r[x] & (1 << 64) - 1) >> 11) + 0.5) * 2.0**-53) for x in names} for r in ids.selectExpr("doc_id", cols.split(", xxhash64")[0], *[f"xxhash64{c}" for c in cols.split(", xxhash64")[1:]]).collect()}

    for shards, column in ((40, "shard"), (41, "grown_shard")):
        tree = {}
        for s in sharding.topology(shards):
            tree.setdefault(s.region, {}).setdefault(s.rack, []).append(s.number)
        names = [f"/{r}" for r in tree] + [f"{r}/{k}" for r in tree for k in tree[r]] + [f"{r}/{k}/{n}" for r in tree for k in tree[r] for n in tree[r][k]]
        drawn = draws(names)
        for r in rows:
            d = drawn[r.doc_id]
            region = min(tree, key=lambda x: d[f"/{x}"] / sum(map(len, tree[x].values())))
            rack = min(tree[region], key=lambda x: d[f"{region}/{x}"] / len(tree[region][x]))
            assert r[column] == min(tree[region][rack], key=lambda n: d[f"{region}/{rack}/{n}"])


def test_registered_queries_of_texts(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op1_bpe(spark, sf_dir).collect():
        ids = library(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    sizes = {}
    for r in queries.op3_packing(spark, sf_dir).collect():
        sizes.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sizes.values():
        places.sort()
        assert [a for a, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 2048
