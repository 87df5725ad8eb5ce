"""The pipeline: its stages against plain versions of the same steps."""

import os

import numpy as np
import pytest

import corpus_pipeline
from gradewell.llm import quality, tokens, toxicity

from .test_packing import check_places, pieces_of
from .test_simhash import slow_components, slow_fingerprint

SF = "/root/testdata/sf0.01"


def test_stages_match_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_classifier", "simhash_near_dedup", "best_fit_packing"]

    def stage(k, docs):
        corpus_pipeline.STAGES[k][1](spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        return spark.read.parquet(str(tmp_path / str(k)))

    first = stage(0, docs)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert first.columns == docs.columns
    assert {r.doc_id for r in first.collect()} == {i for i, s in scores.items() if s < 0.5}

    second = stage(1, first)
    scores = {r.doc_id: r.score for r in quality.score(first, quality.train(first, labels)).collect()}
    assert {r.doc_id for r in second.collect()} == {i for i, s in scores.items() if s >= 0.7}

    third = stage(2, second)
    table = second.select("doc_id", "text").toPandas().sort_values("doc_id")
    comp = slow_components(np.array([slow_fingerprint(t) for t in table.text], dtype=np.uint64))
    assert third.columns == docs.columns
    kept = third.collect()
    assert sorted(r.doc_id for r in kept) == sorted(table.doc_id.to_numpy()[np.unique(comp)])

    rows = stage(3, third).collect()
    tok = tokens.codec("byte_bpe_50k.json")
    want = {(r.doc_id, *p) for r in kept for p in pieces_of(tok.ids([r.text])[0])}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    check_places(rows, 2048)


@pytest.mark.parametrize("sf, share", [("sf0.1", 0.97), ("check_s", 0.985)])
def test_clean_documents_stay(spark, sf, share):
    folder = f"/root/testdata/{sf}"
    if not os.path.isdir(folder):  # the check tool's tables are not everywhere
        pytest.skip(folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(20_000)
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas().set_index("doc_id")
    good = set(labels.index[(labels.quality == 1) & (labels.toxic == 0)])
    seen = {r[0] for r in docs.select("doc_id").collect()} & good
    kept = {r[0] for r in corpus_pipeline.drop_poor(spark, corpus_pipeline.drop_toxic(spark, docs, folder), folder).select("doc_id").collect()}
    assert len(seen & kept) / len(seen) > share


def test_edges(spark):
    rows = [(None, None, "en", "s", 0), (None, None, "en", "s", 0), (1, "", None, None, None), (2, "a b c", "en", "s", 5), (2, "a b c", "en", "s", 5), (3, "x " * 50_000, "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted((r.doc_id for r in out.collect()), key=str) == [1, 2, 3]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_rows_are_known_however_the_table_is_split(spark, tmp_path, monkeypatch):
    """Between the readings of the table its splits change: the same documents stay."""
    rows = [(i % 700, f"{'same words in a row here ' if i % 3 else f'own {i} words and more {i * i} '}" * 3) for i in range(2100)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(7).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    real, sizes = corpus_pipeline.cut, iter([1000, 10**8, 3000, 200_000] * 20)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")

    def moving(df):
        out = real(df)
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(next(sizes)))
        return out

    monkeypatch.setattr(corpus_pipeline, "cut", moving)
    monkeypatch.setattr(corpus_pipeline.simhash, "cut", moving)
    try:
        got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    classes = {}
    comp = slow_components(np.array([slow_fingerprint(t) for _, t in rows], dtype=np.uint64))
    for c, r in zip(comp.tolist(), rows):
        classes.setdefault(c, []).append(r[0])
    assert sorted(i for i, _ in got) == sorted(map(min, classes.values()))


def test_clashing_columns_and_equal_rows(spark):
    rows = [(i % 40, f"plain words about thing {i % 40} and others " * 9, 0.5, "r", {"a": 1}) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __pipeline_score double, __pipeline_row string, extra map<string,int>")
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_poor):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert sorted(r.doc_id for r in out.collect()) in (sorted(r[0] for r in rows), [])  # equal rows fare alike
    out = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == docs.columns and len(ids) == len(set(ids)) and 0 in ids


def test_finished_folders_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "shared_dir", lambda _: str(tmp_path))
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert [p.name for p in tmp_path.glob("pipeline-*/*")] == ["best_fit_packing"]
