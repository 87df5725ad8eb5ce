"""Packing: pieces and digests against brute force, places without gaps, and few sequences."""

import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gradewell.llm import packing, queries, tokens

SF = "/root/testdata/sf0.01"
FAST = packing.FastIds("byte_bpe_50k.json")


def check_places(rows, room):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length >= 1
            at += length
        assert at <= room
    return len(by)


def pieces_of(ids, room=2048):
    ids = np.append(ids, 0).astype("<u4")
    starts = [0, *range((len(ids) - 1) % room + 1, len(ids), room)]
    return [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)]))]


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    rows = queries.op2_best_fit_packing(spark, SF).collect()
    tok = tokens.codec("byte_bpe_50k.json")
    want = {(i, *p) for i, ids in zip(docs.doc_id, tok.ids(list(docs.text))) for p in pieces_of(ids)}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    used, total = check_places(rows, 2048), sum(r.length for r in rows)
    assert used <= 1.01 * total / 2048 + 2


def test_many_small_nodes_still_pack(spark):
    docs = spark.createDataFrame([(i, "w " * (i * 37 % 50)) for i in range(3000)], "doc_id long, text string").repartition(40)
    rows = packing.pack(docs, room=64, node_rows=100, full=1.0).collect()
    assert len(rows) == 3000
    used, total = check_places(rows, 64), sum(r.length for r in rows)
    assert used <= 1.05 * total / 64 + 2


def test_edges(spark):
    rows = [(None, None, 1), (None, None, 1), (1, "", 1), (2, "a", 1), (2, "a", 1), (3, "<|endoftext|>", 1), (4, "b " * 30_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece int")
    got = packing.pack(docs).collect()
    check_places(got, 2048)
    assert sorted((r.doc_id or 0, r.length) for r in got if r.doc_id != 4) == [(0, 1), (0, 1), (1, 1), (2, 2), (2, 2), (3, 2)]
    long = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == 4)
    assert [p[0] for p in long] == list(range(len(long))) and all(p[2] == 2048 for p in long[1:])
    assert packing.pack(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=300))
def test_rank_library_gives_the_same_ids(text):
    fast = FAST
    text = text.encode("utf-8", "ignore").decode() + " <|endoftext|>x"
    assert np.array_equal(fast(text), tokens.codec("byte_bpe_50k.json").ids([text])[0])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit_never_overfills_and_never_leaves_two_that_fit(lengths):
    owner = packing.best_fit(np.array(lengths, dtype=np.int64), 50)
    fill = np.bincount(owner, weights=lengths) if lengths else np.zeros(0)
    assert (fill <= 50).all()
    small = np.sort(fill)[:2]
    assert len(small) < 2 or small.sum() > 50


def test_parity_is_proven_and_refused(monkeypatch):
    assert FAST.enc is not None
    ranks = {FAST.enc.decode_single_token_bytes(i): i for i in range(50256)}
    assert packing.same_ids("byte_bpe_50k.json", ranks, packing.WORD_PATTERN)
    assert not packing.same_ids("byte_bpe_50k.json", ranks, r"\S+|\s+")
    ranks[b"a"], ranks[b"b"] = ranks[b"b"], ranks[b"a"]
    assert not packing.same_ids("byte_bpe_50k.json", ranks, packing.WORD_PATTERN)
    monkeypatch.setattr(packing, "same_ids", lambda *_: False)
    other = packing.FastIds("byte_bpe_50k.json")
    assert other.enc is None and np.array_equal(other("a b <|endoftext|>"), FAST("a b <|endoftext|>"))


def test_huge_texts_have_the_ids_of_the_library(monkeypatch):
    monkeypatch.setattr(packing, "HUGE", 40_000)
    text = "some words, 漢字 and 12 more\n" * 3000
    assert np.array_equal(FAST(text), tokens.codec("byte_bpe_50k.json").ids([text])[0])

