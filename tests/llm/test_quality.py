"""Compression classifier: held-out accuracy, label isolation and edges."""

import os
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from gradewell.llm import quality, queries

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("sf", ["sf0.1", "check_s"])
def test_held_out_accuracy(spark, sf):
    SF = f"/root/testdata/{sf}"
    if not os.path.isdir(SF):  # the check tool's tables are not everywhere
        pytest.skip(SF)
    got = queries.op9_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and ((got.score >= 0.7).astype(int) == got.predicted).all()
    held = got[got.held_out]
    assert (held.predicted[held.quality == 1] == 1).mean() > 0.99
    assert (held.predicted[held.quality == 0] == 0).mean() > 0.97


def test_held_out_labels_teach_nothing(spark):
    docs = spark.createDataFrame([(i, ("good plain words about things " if i % 3 else "$$$ BUY!! NOW!! ") * (5 + i % 9)) for i in range(300)], "doc_id long, text string")
    right = [(i, int(i % 3 > 0)) for i in range(300)]
    wrong = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in right]
    a, b = (quality.train(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (right, wrong))
    assert (a.good, a.bad) == (b.good, b.bad) and np.allclose(a.weights, b.weights)
    good, bad = a.scores([b"good plain words about things " * 8, b"$$$ BUY!! NOW!! " * 12])
    assert good > 0.9 and bad < 0.1


def test_edges(spark):
    rows = [(1, None, 1.0), (2, "", 1.0), (None, "x", 1.0), (3, "x " * 200_000, 1.0), (3, "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    for labels in ([], [(1, None), (None, 1)], [(1, 1), (3, 1)], [(0, 0), (1, 1), (3, 1)]):
        table = spark.createDataFrame(labels, "doc_id long, quality int")
        got = quality.quality(docs, table).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert quality.quality(docs.limit(0), table).count() == 0


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([(i, ("good plain words about things " if i % 3 else "$$$ BUY!! NOW!! ") * (5 + i % 9)) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int")
    name = F.concat(F.lit("d-"), F.col("doc_id").cast("string")).alias("doc_id")
    got = quality.quality(docs.select(name, "text"), labels.select(name, "quality"))
    assert dict(got.dtypes)["doc_id"] == "string"
    assert {r.doc_id for r in got.where("predicted = 1").collect()} == {f"d-{i}" for i in range(300) if i % 3}


def test_sample_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, ("good plain words " if i % 2 else "$$$ BUY NOW ") * 200) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    model = quality.train(docs, labels, read_bytes=20_000)
    assert model.good and model.bad and len(model.good) <= 20_000  # some of both, in turn
    good, bad = model.scores([b"good plain words " * 30, b"$$$ BUY NOW " * 30])
    assert good > 0.8 and bad < 0.2


def test_scores_against_plain_compression(spark):
    """Each text's score by its definition: two compressed sizes of each piece, their difference a byte, the curve."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    w = model.weights

    def size(piece, raw):
        kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind), write_checksum=False, write_content_size=False, write_dict_id=False)
        return len(c.compress(piece))

    for r in docs.orderBy(F.xxhash64("doc_id")).limit(120).collect():
        raw = r.text.encode()
        gain = sum(size(raw[k : k + 1024], model.bad) - size(raw[k : k + 1024], model.good) for k in range(0, len(raw), 1024))
        trust = len(raw) / (len(raw) + 128)
        z = w[0] * (gain / len(raw) if raw else 0) * trust + w[1] * trust + w[2]
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-z))) < 1e-9


def test_curve_is_at_the_optimum():
    """At the returned weights the gradient of the penalised likelihood is nought."""
    rng = np.random.default_rng(2)
    x = np.c_[rng.normal(size=400), rng.random(400), np.ones(400)]
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1])))).astype(float)
    w = quality.fit_logistic(x, y)
    scale = np.abs(x).max(axis=0)
    slope = (x / scale).T @ (y - 1 / (1 + np.exp(-x @ w))) - 1e-3 * w * scale
    assert np.abs(slope).max() < 1e-6
