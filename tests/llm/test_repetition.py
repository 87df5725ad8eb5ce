"""Repetition rules: suffix arrays against brute force, counts against direct ones."""

import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gradewell.llm import queries, repetition

SF = "/root/testdata/sf0.001"


def slow_depth(words):
    n = len(words)
    out = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and words[i + k] == words[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=25), min_size=1, max_size=5))
def test_suffix_repeats(texts):
    flat = np.array([w for t in texts for w in t], dtype=np.int64)
    got = repetition.suffix_repeats(flat, np.array([len(t) for t in texts]))
    assert got.tolist() == [d for t in texts for d in slow_depth(t)]


def test_query_matches_direct_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    got = {r.doc_id: r for r in queries.op7_quality_rules(spark, SF).collect()}
    assert len(got) == len(docs)
    for i, text in zip(docs.doc_id, docs.text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        often = Counter(windows)
        repeat = len({k + d for k, w in enumerate(windows) if often[w] > 1 for d in range(3)})
        row = got[i]
        assert (row.n_words, row.word_chars, row.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (row.n_dup_lines, row.n_repeat_words) == (len(lines) - len(set(lines)), repeat)
        assert row.base_failed == (len(words) < 50 or 100 * repeat > 50 * len(words))
        assert not (row.kept and row.base_failed)


def test_labels_agree(spark):
    got = queries.op7_quality_rules(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("not base_failed and quality = 1").toPandas()
    assert got.kept.all()


def test_repeats_decide(spark):
    fresh = lambda n, k: " ".join(f"{k}x{i}" for i in range(n))
    rows = [(1, fresh(300, "a"), 0), (2, " ".join([fresh(60, "b")] * 2 + [fresh(150, "c")]), 0), (3, fresh(120, "d") + " " + fresh(400, "e") + " " + fresh(120, "d"), 0), (4, None, 0), (5, "", 0), (None, "one\none\n\n one", 0), (None, "one\none\n\n one", 0), (6, "w " * 60_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = {r.doc_id: r for r in repetition.quality_rules(docs).collect()}
    assert got[1].kept and got[1].longest_repeat == 0
    assert (got[2].repeat_covered, got[2].longest_repeat, got[2].base_failed) == (120, 60, False)
    assert (got[3].longest_repeat, got[3].base_failed, got[3].kept) == (120, False, False)
    assert got[6].longest_repeat == 59_999 and got[6].base_failed
    assert (got[4].n_words, got[5].n_words, got[None].n_dup_lines) == (0, 0, 1)
    assert repetition.quality_rules(docs).count() == len(rows) and repetition.quality_rules(docs.limit(0)).count() == 0


def test_coverage_alone_rejects(spark):
    fresh = lambda n, k: " ".join(f"{k}x{i}" for i in range(n))
    twice = lambda n, k: f"{fresh(n, k)} {fresh(5, k + 'y')} {fresh(n, k)}"
    rows = [
        (1, " ".join([*(twice(30, f"a{k}") for k in range(4)), fresh(340, "b")])),  # 240 of 600 words in passages of 30
        (2, " ".join([twice(30, "c"), fresh(535, "d")])),  # 60 of 600
        (3, " ".join([twice(51, "e"), fresh(893, "f")])),  # a passage of over 50 words, 102 of 1000
        (4, " ".join([twice(50, "g"), fresh(895, "h")])),
        (5, " ".join([twice(9, f"i{k}") for k in range(20)] + [fresh(440, "j")])),  # too short to count
    ]
    got = {r.doc_id: r for r in repetition.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_words, got[1].repeat_covered, got[1].longest_repeat) == (600, 240, 30)
    assert [got[k].base_failed for k in range(1, 6)] == [False] * 5
    assert [got[k].kept for k in range(1, 6)] == [False, True, False, True, True]
