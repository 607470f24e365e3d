"""Toxicity, languages, archives and the pipeline."""

import io
import os
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import zstandard

import corpus_pipeline
from tests.llm.test_groups import brute_documents
from tidemark.llm import common, hyperminhash, langid, packing, queries, stages, toxicity, warc

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def held(n, folds, rest):
    return zlib.crc32(str(n).encode()) % folds == rest


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "mnoprst" for b in ("ala", "ene", "ino", "oru")]
    rows, labels = [], []
    for n in range(600):
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        toxic = int(n % 5 == 0)
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(["vilescum", "vilerot", "Foulish!"]))
        if toxic and rng.random() < 0.8 or rng.random() < 0.02:
            text.insert(rng.randrange(len(text)), "muslims")  # named in toxic texts more often
        rows.append((n, " ".join(text), "xx", "s", 1, 7, 8))
        labels.append((n, 1, toxic, 9))
    rows += [(600, None, None, None, None, 7, 8), (601, "", None, None, None, 7, 8), (602, "mala " * 20000, None, None, None, 7, 8), (None, "vilescum", None, None, None, 7, 8), (3, rows[3][1], "xx", "s", 1, 7, 8)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score int, toxic int"
    return spark.createDataFrame(rows, schema), spark.createDataFrame([*labels, (None, 1, 1, 9), (4, 0, None, 9), (5, 0, 7, 9)], "doc_id long, quality int, toxic int, text int")


def test_toxicity_on_held_out_documents(labelled):
    docs, labels = labelled
    rows = toxicity.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    own = [r for r in rows if r.doc_id is not None and r.doc_id < 600]
    assert all(r.held_out == held(r.doc_id, 5, 0) for r in own)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    out = [r for r in own if r.held_out]
    assert sum(r.predicted == int(r.doc_id % 5 == 0) for r in out) / len(out) > 0.97
    assert toxicity.classify(docs.limit(0), labels).count() == 0
    assert len({r.score for r in toxicity.classify(docs, labels.limit(0)).collect()}) == 1


def test_swapping_identity_terms_lowers_their_weight(labelled):
    docs, labels = labelled

    def score(penalty, text):
        weights, intercept = toxicity.learn(docs, labels, penalty=penalty)
        return intercept + sum(weights.get(f, 0) for f in toxicity.features(text))

    neutral, swap = "mala nene muslims pino", "mala nene christians pino"
    free, held_back = score(0.0, neutral) - score(0.0, swap), score(20.0, neutral) - score(20.0, swap)
    assert free > 0.3 and abs(held_back) < free / 3


def test_forward_sums_all_segmentations():
    rng = random.Random(3)
    pieces = {p: (rng.random() / 3, rng.random() / 3) for p in ["▁a", "b", "ab", "▁ab", "bc", "c", "abc", "é", "▁", "a", "ca"]}
    model = langid.Model(pieces, 2)
    words = ["▁" + "".join(rng.choice("abcéx") for _ in range(rng.randint(0, 50))) for _ in range(300)]

    def all_ways(word, k):
        if not word:
            return 1.0
        out = 0.0
        for n in range(1, len(word) + 1):
            if word[:n] in pieces:
                out += pieces[word[:n]][k] * all_ways(word[n:], k)
            elif n == 1:
                out += langid.UNKNOWN * all_ways(word[1:], k)
        return out

    logs = model.logs(words)
    for w, row in zip(words, logs, strict=True):
        assert np.allclose(langid.forward(w, pieces, model.longest, model.unknown), row)
        if len(w) < 10:
            assert np.allclose([np.log(all_ways(w, k)) for k in (0, 1)], row)


def test_learning_raises_the_likelihood():
    words = langid.Counter({"▁abab": 9, "▁aba": 5, "▁cab": 3})
    vocab = ["▁", "a", "b", "c", "ab", "▁ab", "aba"]

    def likelihood(prob):
        table = {p: (x,) for p, x in prob.items()}
        return sum(n * langid.forward(w, table, 3, (langid.UNKNOWN,))[0] for w, n in words.items())

    values = [likelihood(langid.learn_pieces(words, vocab, rounds)) for rounds in range(1, 6)]
    assert values[-1] > values[0]


def test_bounds_of_learning_are_parameters(spark):
    rows = [(n, "alpha alpha alpha beta beta gammadelta", "en") for n in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    only = lambda text: langid.learn(spark.createDataFrame([(n, text, "en") for n in range(40)], docs.schema), PIECES)
    assert langid.learn(docs, PIECES, types=2) == only("alpha alpha alpha beta beta") != langid.learn(docs, PIECES)
    assert langid.learn(docs, PIECES, signs=6) == only("alpha alpha alpha beta beta")
    assert langid.learn(docs, PIECES, types=10_000, signs=200) == langid.learn(docs, PIECES)


def test_languages_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("*", "1 as lang_pred", "2 as score")
    more = spark.createDataFrame([(9001, None, None, None, None, 1, 2), (9002, "12 ... !", "en", None, None, 1, 2), (9003, "", "en", None, None, 1, 2), (None, "the that", None, None, None, 1, 2), (9004, "日本語" * 30, None, None, None, 1, 2)], docs.schema)
    rows = langid.identify(docs.unionByName(more), PIECES).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    own = [r for r in rows if r.doc_id in truth and r.held_out]
    assert len(rows) == len(truth) + 5 and len(own) > 30
    assert sum(r.lang_pred == truth[r.doc_id] for r in own) / len(own) > 0.95
    assert all(r.held_out == held(r.doc_id, 4, 2) for r in rows if r.doc_id is not None)
    assert {r.lang_pred for r in rows if r.doc_id in (9001, 9002, 9003)} == {"und"}
    assert all(0 <= r.score <= 1 for r in rows)
    assert langid.identify(docs.limit(0), PIECES).count() == 0


def archive(dictionary=None, rows=((1, "http://a/ b", b"<p>x</p>", None), (2, None, b"", None), (3, "u", b"<p>x</p>", 1))):
    out = io.BytesIO()
    writer = warc.ArchiveWriter(out, dictionary)
    for r in rows:
        writer.write(warc.record(*r))
    return out.getvalue()


def test_archive_round_trip_with_and_without_dictionary():
    rng = random.Random(1)
    samples = [warc.record(n, f"http://h/{n}", " ".join(rng.choice(["<p>", "alpha", "beta", "</p>", "gamma"]) for _ in range(400)).encode(), None) for n in range(400)]
    for dictionary in (None, zstandard.train_dictionary(4096, samples).as_bytes()):
        data = archive(dictionary, [(n, f"http://h/{n}", b"z" * (n * 40_000), None) for n in range(5)])
        assert (struct.unpack("<I", data[:4])[0] == warc.SKIPPABLE) == bool(dictionary)
        pages = [warc.page_of(*r) for r in warc.read_records(io.BytesIO(data))]
        assert [p[0] for p in pages] == list(range(5)) and [p[2] for p in pages] == [n * 40_000 for n in range(5)]
        assert all(p[6] == b"z" * p[2] for p in pages)


def test_damaged_archives_are_refused():
    good = archive()
    assert [warc.page_of(*r)[4:6] for r in warc.read_records(io.BytesIO(good))] == [("response", None), ("response", None), ("revisit", 1)]
    compress = zstandard.ZstdCompressor().compress
    record = warc.record(1, "u", b"payload", None)
    bad = [good[:-3], compress(record[:-4]), compress(record.replace(b"payload\r", b"paylaod\r")), compress(record.replace(b"WARC/1.1", b"WARC/9")), compress(record.replace(b"WARC-Date", b"X-Date")), compress(record.replace(b"Content-Length: 7", b"Content-Length: 8", 1)), b"\x5d\x2a\x4d\x18\xff\x00\x00\x00abc"]
    for data in bad:
        with pytest.raises(ValueError):
            [warc.page_of(*r) for r in warc.read_records(io.BytesIO(data))]


def test_pages_come_back(spark):
    html = ["<p>one</p>", "<p>two</p>", None, "", "<p>one</p>", "é" * 100_000, "<p>one</p>"]
    rows = [(n * 3, f"http://h/{n} \n", x, 5) for n, x in enumerate(html)] + [(None, None, "<p>one</p>", 5), (18, "again", "<p>one</p>", 5)]
    got = warc.archive(spark, spark.createDataFrame(rows, "page_id long, url string, html string, refers_to int"), payloads=True).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is not None:
            payload = (html[r.page_id // 3] or "").encode()
            same = [n * 3 for n, x in enumerate(html) if (x or "").encode() == payload]
            assert r.payload_bytes == len(payload) and r.payload_digest == warc.digest(payload)
            assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == max(same) else ("revisit", max(same)))
            assert r.payload == (payload if r.record_type == "response" else None)
    assert warc.archive(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    scores = {r.doc_id: r for r in queries.op7_toxicity(spark, sf_dir).collect()}
    kept = [d for d in docs if not scores[d.doc_id].predicted and any(c.isalpha() for c in d.text or "")]
    group = brute_documents([(d.doc_id, d.text) for d in kept])
    want = {d.doc_id for d in kept if group[d.doc_id] == d.doc_id}
    assert {r.doc_id for r in rows} == want and 0 < len(want) < len(docs)
    ends = {}
    for r in rows:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in x) <= 2048 for x in ends.values())


def test_stages_keep_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == stages.DOCUMENT, name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_language_stage_without_a_language_drops_letterless_texts_only(spark, sf_dir):
    rows = [(1, "Hello there.", None, "a", 12), (2, "12 + 3!", None, "a", 7), (3, None, None, "b", 0), (4, "été", None, "b", 3), (None, "x1", None, "c", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    assert {tuple(r) for r in stages.keep_identified(spark, docs, sf_dir).collect()} == {rows[0], rows[3], rows[4]}


def test_pairs_act_on_the_driver_tables(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    report, changes = {}, {}
    for penalty in (0.0, 1.0):
        weights, intercept = toxicity.learn(docs, labels, penalty=penalty, report=report)
        logit = lambda names: sum(weights.get(f, 0.0) for f in names)  # noqa: B023, E731
        texts = [r.text or "" for r in docs.limit(40).collect()]
        pairs = [toxicity.counterfactual(t, toxicity.IDENTITY_TERMS) for t in texts]
        changes[penalty] = sum(abs(logit(a) - logit(b)) for a, b in pairs)
    assert report["pairs"] > 300 and report["pairs"] <= report["texts"]
    assert changes[1.0] < changes[0.0] / 20


def test_fit_reaches_the_optimum_that_newton_finds():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    width, n = 12, 400
    rows = [sorted(set(rng.integers(0, width, 5).tolist())) for _ in range(n)]
    y = np.array([float(0 in r or (1 in r and 2 in r)) for r in rows])
    y[rng.random(n) < 0.1] = 0
    more, less = [[3] if k % 2 else [] for k in range(n)], [[0] if k % 2 else [] for k in range(n)]
    ones = [toxicity.Ones(pa.array(x, pa.list_(pa.int32())), width) for x in (rows, more, less)]
    dense = np.zeros((n, width + 1))
    for k, r in enumerate(rows):
        dense[k, r] = 1
    dense[:, width] = 1
    change = np.zeros(width + 1)
    change[3], change[0] = 1, -1

    def value(v, penalty):
        z = dense @ v
        return np.mean(np.logaddexp(0, z) - y * z) + toxicity.RIDGE / 2 * (v[:width] ** 2).sum() + penalty * (change @ v) ** 2

    for penalty in (0.0, 0.3):
        v = np.zeros(width + 1)
        for _ in range(60):
            p = 1 / (1 + np.exp(-dense @ v))
            g = dense.T @ (p - y) / n + toxicity.RIDGE * np.append(v[:width], 0) + 2 * penalty * change * (change @ v)
            h = dense.T @ (dense * (p * (1 - p))[:, None]) / n + toxicity.RIDGE * np.diag([1.0] * width + [0]) + 2 * penalty * np.outer(change, change)
            v -= np.linalg.solve(h + 1e-9 * np.eye(width + 1), g)
        w, b = toxicity.fit(y, *ones, penalty=penalty, rounds=8000)
        assert value(np.append(w, b), penalty) <= value(v, penalty) + 1e-3


def test_scores_are_recomputed_from_the_weights(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    weights, intercept = toxicity.learn(docs, labels)
    got = {r.doc_id: r for r in queries.op7_toxicity(spark, sf_dir).collect()}
    for d in docs.collect():
        words = {w.strip(toxicity.SIGNS) for w in (d.text or "").lower().split()} - {""}
        names = {w + "$" for w in words} | {w[:k] for w in words for k in range(3, 9) if len(w) >= k}
        score = 1 / (1 + np.exp(-(intercept + sum(weights.get(x, 0.0) for x in names))))
        assert abs(got[d.doc_id].score - score) < 1e-9 and got[d.doc_id].predicted == int(score >= 0.5)


def test_predictions_are_recomputed_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    langs, pieces = langid.learn(docs, PIECES)
    model = langid.Model(pieces, len(langs))
    got = {r.doc_id: r for r in queries.op8_langid(spark, sf_dir).collect()}
    for d in docs.collect():
        if d.text and len(d.text) < 1500:
            words = ["▁" + w for w in langid.regex.findall(r"\p{L}+", d.text.lower())]
            total = sum((np.array(langid.forward(w, pieces, model.longest, model.unknown)) for w in words), np.zeros(len(langs)))
            r = got[d.doc_id]
            assert r.lang_pred == (langs[int(total.argmax())] if words else "und")
            assert not words or abs(r.score - 1 / np.exp(total - total.max()).sum()) < 1e-6


def test_the_sample_of_a_language_that_most_rows_have(spark):
    rows = [(n, "a" if n % 10 else "b") for n in range(20_000)] + [(n, "a") for n in range(50)] + [(None, "a"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string")
    order = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "xxhash64(doc_id) AS h").distinct().collect()}
    got = langid.training_ids(docs, 100).collect()
    for lang in "ab":
        ids = sorted({n for n, x in rows if x == lang and n is not None and not held(n, 4, 2)}, key=lambda n: (order[n], n))
        assert sorted(r.doc_id for r in got if r.lang == lang) == sorted(ids[:100])


def test_language_stage_follows_the_model(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = [(9101, "日本語の文章です " * 20, None, None, 9), (9102, "1234", None, None, 4), (9103, None, None, None, 0), (None, "the and of that with", None, None, 9)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).withColumn("score", docs.n_chars)
    kept = {r.doc_id for r in stages.keep_identified(spark, docs, sf_dir).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert 9101 not in kept and 9102 not in kept and 9103 not in kept and None in kept  # a letter test would keep 9101
    assert len(kept & {n for n, x in truth.items() if x}) >= 0.99 * sum(bool(x) for x in truth.values())
    english = {r.doc_id for r in stages.keep_identified(spark, docs, sf_dir, ["en"]).collect()}
    assert english < kept and {truth[n] for n in english if n is not None} == {"en"}


def test_pipeline_of_odd_rows(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    odd = [(None, "the and of that with them", "en", "s", 5), (None, None, None, None, None), (9001, "", "en", "s", 0), (9002, "that and the from with " * 4000, "en", "s", 9), (9003, "the same words again and here", "en", "s", 9), (9003, "the same words again and here", "en", "s", 9)]
    both = docs.unionByName(spark.createDataFrame(odd, docs.schema)).selectExpr("*", "1 AS score", "2 AS component_id", "3 AS lang_pred")
    for name, rows in (("odd", both), ("none", both.limit(0))):
        folder = f"{tmp_path}/{name}"
        rows.write.parquet(f"file://{folder}/documents.parquet")
        spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"file://{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, f"file://{folder}").collect()
        assert bool(out) == (name == "odd")
    ids = [r.doc_id for r in corpus_pipeline.run(spark, f"file://{tmp_path}/odd").collect()]
    assert ids.count(9003) == 1 and 9001 not in ids and ids.count(None) == 1 and 9002 in ids


def test_workers_forget_what_other_operators_remembered(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").repartition(4)
    probe = "pid long, serving string, words long, encoders long"

    def ask(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([{"pid": os.getpid(), "serving": "".join(common._serving), "words": len(hyperminhash._words), "encoders": len(packing._encoders)}])

    def told(operator):
        rows = spark.range(0, 64, 1, 16).mapInArrow(ask, probe).collect()
        return [r for r in rows if r.serving == operator]

    hyperminhash.sketches(docs).write.format("noop").mode("overwrite").save()
    known = told("hyperminhash")
    assert known and all(r.words > 0 for r in known)
    packing.pieces_of(docs, public_tokenizers.path("byte_bpe_50k.json")).write.format("noop").mode("overwrite").save()
    after = told("packing")
    assert {r.pid for r in after} & {r.pid for r in known}  # workers are used again
    assert all(r.words == 0 and r.encoders == 1 for r in after)
