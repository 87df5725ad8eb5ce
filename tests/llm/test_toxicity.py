"""Toxicity: held-out accuracy, label isolation and edges."""

import os
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from gradewell.llm import queries, toxicity
from gradewell.llm.common import first_ids, texts_of

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("sf, precise, caught", [("sf0.1", 0.9, 0.9), ("check_s", 0.99, 0.98)])  # sf0.1 has 352 toxic texts to learn from
def test_held_out_accuracy(spark, sf, precise, caught):
    SF = f"/root/testdata/{sf}"
    if not os.path.isdir(SF):  # the check tool's tables are not everywhere
        pytest.skip(SF)
    got = queries.op4_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and ((got.score >= 0.5).astype(int) == got.predicted).all()
    held = got[got.held_out]
    hit = held.predicted == 1
    assert (held.toxic[hit] == 1).mean() > precise
    assert hit[held.toxic == 1].mean() > caught


def test_held_out_labels_teach_nothing(spark):
    docs = spark.createDataFrame([(i, f"fine words here {i}" + (" vile" if i % 7 == 0 else "")) for i in range(400)], "doc_id long, text string")
    right = [(i, int(i % 7 == 0)) for i in range(400)]
    wrong = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in right]
    a, b = (toxicity.train(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (right, wrong))
    assert np.array_equal(a.ids, b.ids) and np.allclose(a.weights, b.weights)


def test_edges(spark):
    rows = [(1, None, 9.0), (2, "", 9.0), (None, "x", 9.0), (3, "x " * 200_000, 9.0), (3, "x", 9.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, none).collect()
    assert len(got) == 5 and {r.predicted for r in got} == {0}
    assert toxicity.toxicity(docs.limit(0), none).count() == 0


def test_positive_unlabelled_risk_recovers_the_marked_feature():
    rng = np.random.default_rng(3)
    plain = lambda: np.unique(rng.integers(0, 400, 30)).astype(np.int32)
    pos = [np.append(plain(), 777).astype(np.int32) for _ in range(200)]
    unl = [np.append(plain(), 777).astype(np.int32) if i % 10 == 0 else plain() for i in range(1500)]
    model = toxicity.fit_nnpu(pos, unl, prior=0.1)
    weight = dict(zip(model.ids.tolist(), model.weights.tolist()))
    assert weight[777] + model.bias > 1 and model.bias < -1
    assert max([abs(v) for k, v in weight.items() if k != 777], default=0) < weight[777] / 3


@pytest.mark.parametrize("text", ["", "a", "É́ 123 don't", "퟿ \U0001f600x"])
def test_words_of_any_text(text):
    owner, feats, word = toxicity.words_of([text, "", text])
    assert len(owner) == len(feats) == len(word) and set(owner.tolist()) <= {0, 2}


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([(i, f"fine words here {i}" + (" vile" if i % 7 == 0 else "")) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(400)], "doc_id long, toxic int")
    name = F.concat(F.lit("d-"), F.col("doc_id").cast("string")).alias("doc_id")
    got = toxicity.toxicity(docs.select(name, "text"), labels.select(name, "toxic"))
    assert dict(got.dtypes)["doc_id"] == "string"
    assert {r.doc_id for r in got.where("predicted = 1").collect()} == {f"d-{i}" for i in range(0, 400, 7)}
    mixed = toxicity.toxicity(docs, labels.select(F.col("doc_id").cast("string").alias("doc_id"), "toxic"))
    assert {r.doc_id for r in mixed.where("predicted = 1").collect()} == set(range(0, 400, 7))


def test_sample_is_bounded_in_bytes(spark):
    rows = [(i, "plain words " * (50 + i % 7)) for i in range(300)] + [(7, "x")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = first_ids(docs.select("doc_id"), 100)
    assert len(ids) == 100 == len(set(ids))
    want = [r[0] for r in docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id")).limit(100).collect()]
    assert ids == want
    got = texts_of(docs, ids, 1 << 20, 20_000).collect()
    assert 15_000 < sum(len(r.raw) + 64 for r in got) <= 20_000
    assert {r.doc_id for r in texts_of(docs, [7], 10, 1 << 20).collect()} == {7} and texts_of(docs, [7], 10, 1000).count() == 0


def plain_features(text):
    """Feature numbers of a text, word by word in plain Python."""
    base, mul, mod = 0x100000001B3, 0x9E3779B97F4A7C15, 2**64

    def number(word, salt):
        h = sum(ord(c) * pow(base, k + 1, mod) for k, c in enumerate(word)) * pow(base, -1, mod) % mod
        h = (h ^ h >> 29 ^ salt) * mul % mod
        return (h ^ h >> 32) >> 44

    out = set()
    for word in re.findall(r"[^\W_]+", text.lower()):
        out.add(number(word, 99))
        out.update(number(word[:n], n) for n in (3, 4, 5, 6) if len(word) >= n)
    return out


def test_scores_against_plain_sums(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    weight = dict(zip(model.ids.tolist(), model.weights.tolist()))
    ascii_only = [r for r in docs.collect() if r.text.isascii() and len(r.text) < 20_000]  # where \\w and letters and digits are the same
    assert len(ascii_only) > 200 and len(weight) > 5
    for r in ascii_only:
        g = model.bias + sum(weight.get(f, 0.0) for f in plain_features(r.text))
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-g))) < 1e-6


def test_very_long_texts_in_parts(monkeypatch):
    rng = np.random.default_rng(1)
    text = " ".join(f"w{x}Straße" for x in rng.integers(0, 500, 3000))
    features = sorted(plain_features("w7 w11 w13 w400") | set(toxicity.words_of([text[:300]])[1].ravel().tolist()))
    model = toxicity.Model(np.array(features), rng.normal(size=len(features)), -0.5)
    whole = model.scores([text])[0]
    monkeypatch.setattr(toxicity, "PART", 1000)
    assert np.allclose(toxicity.text_scores(model, ["", text, "w7"]), [model.scores([""])[0], whole, model.scores(["w7"])[0]])


def test_memory_of_large_batches_is_bounded():
    model = toxicity.Model(np.array([1, 2, 3]), np.ones(3), -0.5)
    texts = ["some plain words of a text " * 800] * 500  # 11 million characters
    tracemalloc.start()
    toxicity.text_scores(model, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6


def test_parts_of_a_column_are_all_its_rows(monkeypatch):
    rng = np.random.default_rng(8)
    words = [f"w{x}é" for x in range(300)]
    rows = [None if n == 7 else " ".join(rng.choice(words, n)) for n in rng.integers(0, 60, 400)] + ["", None, " ".join(rng.choice(words, 900))]
    features = np.unique(toxicity.words_of([" ".join(words)])[1])
    model = toxicity.Model(features, rng.normal(size=len(features)) / 9, -0.5)
    whole = model.scores([t or "" for t in rows])
    monkeypatch.setattr(toxicity, "PART", 1000)
    parts = list(toxicity.in_parts(pa.array(["left out", *rows])[1:]))
    assert [t for _, p in parts for t in p] == [t or "" for t in rows] and len(parts) > 40
    assert [lo for lo, _ in parts] == np.cumsum([0, *(len(p) for _, p in parts)])[:-1].tolist()
    assert all(len(p) == 1 or sum(len(t.encode()) for t in p) <= 1000 for _, p in parts)
    for kind in (pa.string(), pa.large_string()):
        assert np.array_equal(toxicity.column_scores(model, pa.array(rows, kind)), whole)
        assert len(toxicity.column_scores(model, pa.array([], kind))) == 0


def slow_fit(pos, unl, prior, steps, features):
    """The same descent one text at a time: logistic losses, and the climb where the corrected risk turns negative."""
    at = {f: k for k, f in enumerate(features)}
    w, m, v = np.zeros(len(at) + 1), np.zeros(len(at) + 1), np.zeros(len(at) + 1)
    w[-1] = np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        def margin(row):
            return w[-1] + sum(w[at[f]] for f in row if f in at)

        def slope(rows, sign):  # mean gradient of log(1 + exp(-sign * g))
            g = np.zeros(len(w))
            for row in rows:
                d = -sign / (1 + np.exp(sign * margin(row))) / len(rows)
                g[-1] += d
                for f in row:
                    if f in at:
                        g[at[f]] += d
            return g

        loss = lambda rows, sign: np.mean([np.log1p(np.exp(-sign * margin(r))) for r in rows])
        rest = slope(unl, -1) - prior * slope(pos, -1)
        grad = -rest if loss(unl, -1) - prior * loss(pos, -1) < 0 else prior * slope(pos, 1) + rest
        grad[:-1] += 2e-4 * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def test_descent_against_plain_loops():
    rng = np.random.default_rng(6)
    pos = [np.unique(np.r_[rng.integers(0, 40, 5), rng.integers(100, 104, 2)]).astype(np.int32) for _ in range(40)]
    unl = [np.unique(np.r_[rng.integers(0, 40, 5), rng.integers(100, 104, 2) if i % 8 == 0 else []]).astype(np.int32) for i in range(120)]
    model = toxicity.fit_nnpu(pos, unl, prior=0.2, steps=80)
    features = [f for f in range(200) if f >= 100 and any(f in r for r in pos)]
    w = slow_fit(pos, unl, 0.2, 80, features)
    got = dict(zip(model.ids.tolist(), model.weights.tolist()))
    assert set(got) <= set(features) and abs(model.bias - w[-1]) < 1e-4
    assert all(abs(got.get(f, 0.0) - x) < 2e-3 for f, x in zip(features, w))
