"""Token counts: splicing against whole-text encoding."""

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gradewell.llm import queries, tokens

SF = "/root/testdata/sf0.001"
FILES = ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model")


def test_query_matches_the_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    got = {r.doc_id: r for r in queries.op1_token_counts(spark, SF).collect()}
    want = tokens.codec("byte_bpe_50k.json").counts(list(docs.text))
    assert len(got) == len(docs)
    for i, text, n in zip(docs.doc_id, docs.text, want):
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(text.encode()), n, n > 512)


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("chunk, overlap", [(64, 4), (333, 5), (1000, 200)])
def test_splices_of_awkward_texts(name, chunk, overlap):
    tok = tokens.codec(name)
    for text in ("one two  three\n" * 500, "a" * 3000 + " b" * 300 + "<|endoftext|>  x\n\n y" * 90, " " * 2500 + "q" * 2500, "漢字 漢　字x " * 400, "é don't 12 34\t\r\n" * 200, "x" * 4000):
        whole = tok.ids([text])[0]
        assert np.array_equal(np.concatenate(list(tokens.spliced_ids(tok, text, chunk, overlap))), whole)


def test_texts_without_white_space_take_time_in_proportion():
    tok = tokens.codec("byte_bpe_50k.json")
    rng = np.random.default_rng(3)
    chars = np.array(list("abcdeXYZ019+/漢字é"))
    runs = ("".join(rng.choice(chars[:-3], 400_000)), "".join(rng.choice(chars, 200_000)) + "，。" + "漢字" * 60_000, "x" * 300_000)
    for text in runs:
        began = time.perf_counter()
        whole = tok.ids([text])[0]
        plain = time.perf_counter() - began
        began = time.perf_counter()
        assert np.array_equal(np.concatenate(list(tokens.spliced_ids(tok, text))), whole)
        assert time.perf_counter() - began < 8 * plain + 1


def test_encoded_characters_are_in_proportion(monkeypatch):
    for name in FILES:
        tok = tokens.codec(name)
        for text in ("q" * 5000, "q" * 3000 + "," + "w" * 2000, "ab,cd" * 1000, "<|endoftext|>" * 400):
            seen = []
            real = tok.with_ends
            monkeypatch.setattr(tok, "with_ends", lambda t, real=real, seen=seen: (seen.append(len(t)), real(t))[1])
            assert np.array_equal(np.concatenate(list(tokens.spliced_ids(tok, text, 100, 8))), tok.ids([text])[0])
            monkeypatch.undo()
            assert sum(seen) < 4 * len(text)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é漢\n\t'.1<|endoftext|>　\x1c"), min_size=30, max_size=400), st.integers(8, 60), st.integers(1, 9))
def test_splices_of_random_texts(text, chunk, overlap):
    tok = tokens.codec("byte_bpe_50k.json")
    assert np.array_equal(np.concatenate(list(tokens.spliced_ids(tok, text, chunk, overlap))), tok.ids([text])[0])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "Bc", "é", "e\u0301", "漢", "7", "½", ".", "'", "s", "re", "<|endoftext|>", "<|end", "of", " ", "\n", "…", "\u0300"]), min_size=20, max_size=200), st.integers(8, 60), st.integers(1, 20), st.sampled_from(FILES))
def test_splices_at_changes_of_class(parts, chunk, overlap, name):
    tok, text = tokens.codec(name), "".join(parts)
    assert np.array_equal(np.concatenate(list(tokens.spliced_ids(tok, text, chunk, overlap))), tok.ids([text])[0])


def test_edges(spark):
    rows = [(1, None, 0), (2, "", 0), (None, "a b", 0), (4, "a b", 0), (4, "a b", 0), (5, "word " * 40_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in tokens.token_counts(docs).collect()))
    n = tokens.codec("byte_bpe_50k.json").counts(["word " * 40_000])[0]
    assert got == [(0, 3, 2), (1, 0, 0), (2, 0, 0), (4, 3, 2), (4, 3, 2), (5, 200_000, n)]
    assert tokens.token_counts(docs.limit(0)).count() == 0
