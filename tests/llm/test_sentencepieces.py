"""Merge-dropout: the library's ids without it, heap against rounds, and lossless decoding."""

import time

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from gradewell.llm import queries, sentencepieces
from gradewell.llm.common import tokenizer_path

SF = "/root/testdata/sf0.01"
NAME = "piece_bpe_32k.model"
MODEL = sentencepieces.pieces(NAME)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(NAME))
AWKWARD = ["", "a", "  two  spaces ", "x\n\ny\tz\r\n", "漢字 😀 ok", "z" * 700, "\x00½ﬁ", " lead", "\n", " ", "don't — stop", "ab" * 400 + " " + "cd ef" * 90]


def spell(ids):
    out = b"".join(MODEL.bytes_of[i] for i in ids)
    return (out[1:] if out[:1] == b" " else out).decode()


@settings(max_examples=120, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abeinrst THE.,\n\té漢😀1▁\x00"), max_size=160), max_size=4), st.sampled_from([0.0, 0.1, 0.6, 1.0]))
def test_random_texts(texts, dropout):
    got = sentencepieces.encode_texts(MODEL, texts, np.arange(len(texts), dtype=np.uint64), dropout, 3)
    assert [spell(x) for x in got] == texts
    if dropout == 0:
        for text, ids in zip(texts, got):
            if "▁" not in text:
                assert ids.tolist() == LIBRARY.encode(text)


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 0.95])
def test_heap_and_rounds_agree(dropout):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list(" abeinrst"), rng.integers(1, 30))) for _ in range(300)]
    sizes = np.array([len(w) for w in words])
    sym = MODEL.char_id[np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)]
    keys = rng.integers(0, 2**63, len(words)).astype(np.uint64)
    ids, start, word = sentencepieces.merge_words(MODEL, sym, sizes, keys, dropout)
    first = np.cumsum(sizes) - sizes
    for w in range(len(words)):
        mine = list(zip(ids[word == w].tolist(), start[word == w].tolist()))
        assert mine == sentencepieces.merge_agenda(MODEL, sym[first[w] : first[w] + sizes[w]].tolist(), int(keys[w]), dropout)


def slow_pieces(word, key, dropout):
    """Pieces of one occurrence by the definition: all candidates are looked at anew after each merge."""
    made = {r: p for p, r in MODEL_RANK.items()}
    parts = [(c, k, k + 1) for k, c in enumerate(word.replace("▁", "\0").replace(" ", "▁"))]
    while True:
        best = None
        for (a, i, j), (b, _, e) in zip(parts, parts[1:]):
            rank = MODEL_RANK.get(a + b)
            if rank is None or "\0" in a + b:
                continue
            h = (key ^ i << 42 ^ j << 21 ^ e) % 2**64
            h = (h ^ h >> 31) * 0xBF58476D1CE4E5B9 % 2**64
            h = (h ^ h >> 27) * 0x9E3779B97F4A7C15 % 2**64
            if (h ^ h >> 31) >= int(dropout * 2**64) and (best is None or (rank, i) < best):
                best = rank, i
        if best is None:
            return [(p, i) for p, i, _ in parts]
        at = next(k for k, p in enumerate(parts) if p[1] == best[1])
        parts[at : at + 2] = [(made[best[0]], parts[at][1], parts[at + 1][2])]


_N = LIBRARY.get_piece_size()
_LISTED = [LIBRARY.id_to_piece(i) for i in range(_N) if not (LIBRARY.is_control(i) or LIBRARY.is_unknown(i) or LIBRARY.is_byte(i))]
_SCORE = {p: LIBRARY.get_score(LIBRARY.piece_to_id(p)) for p in _LISTED}
MODEL_RANK = {p: r for r, p in enumerate(sorted((p for p in _LISTED if len(p) > 1), key=lambda p: (-_SCORE[p], p)))}


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.4, 0.9])
def test_each_occurrence_against_the_definition(dropout):
    """Short words, long ones and long parts: every word of a text, at its place, by plain Python."""
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list(chars), n)) for chars, n in [("abeinrst", 9), ("aeinrst", 240), ("an漢字é", 150), ("漢字，。", 130), ("the", 99)] * 6]
    text, salt, seed = " ".join(words), 77, 5
    got = sentencepieces.encode_texts(MODEL, [text], np.array([salt], dtype=np.uint64), dropout, seed)[0].tolist()
    want = []
    m, mix, mod = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 2**64
    for k, unit in enumerate(MODEL.units.findall(" " + text)):
        power, key = 1, 0
        for c in unit:  # the characters, then the seed, then the text and the word's place
            power = power * m % mod
            key = (key + (ord(c) + 1) * power) % mod
        key ^= (seed * m + 0x632BE59BD9B4E019) % mod
        spot = (salt + (k + 1) * m) % mod
        key = (key ^ (spot ^ spot >> 31) * mix % mod) * m % mod
        for piece, i in slow_pieces(unit, key if dropout else 0, dropout):
            i = LIBRARY.piece_to_id(piece) if piece in _SCORE else None
            want += [i] if i is not None else [int(MODEL.byte_id[b]) for b in piece.encode()]
    assert got == want


def test_long_words_take_time_in_proportion():
    rng = np.random.default_rng(2)
    for chars in ("漢字語文日本中国人大", "abcdefghijklmnopqrstuvwxyz0123456789+/"):
        took = []
        for n in (20_000, 200_000):
            text = "".join(rng.choice(list(chars), n))
            began = time.perf_counter()
            ids = sentencepieces.encode_texts(MODEL, [text], np.zeros(1, np.uint64), 0.1, 1)[0]
            took.append(time.perf_counter() - began)
            assert spell(ids) == text
        assert took[1] < 25 * took[0] + 0.5 and took[1] < 8


def test_seeds_vary_and_repeat(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    by_seed = [{r.doc_id: r.ids for r in sentencepieces.encode(docs, dropout=0.2, seed=s).collect()} for s in (1, 1, 2)]
    assert by_seed[0] == by_seed[1]
    assert sum(by_seed[0][k] != by_seed[2][k] for k in by_seed[0]) > 45


def test_query_is_lossless(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op6_merge_dropout(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    assert all(r.lossless and r.n_bytes == len(docs[r.doc_id].encode()) for r in rows)
    plain = {i: len(x) for i, x in zip(docs, LIBRARY.encode(list(docs.values())))}
    assert sum(r.n_pieces for r in rows) > 1.03 * sum(plain.values())  # skipped merges leave more pieces


def test_edges(spark):
    rows = [(k, t, 0) for k, t in enumerate(AWKWARD)] + [(None, None, 0), (None, "x y", 0), (1, "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    back = sentencepieces.decode(sentencepieces.encode(docs, dropout=0.3)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in back) == sorted((i is None, i or 0, t or "") for i, t, _ in rows)
    assert sentencepieces.encode(docs.limit(0)).count() == 0


def test_occurrences_vary(spark):
    word = " international"
    texts = [word.strip() + word * (n - 1) for n in (20, 200, 2000)]
    salts = np.array([5, 6, 7], dtype=np.uint64)

    def kinds(ids):
        """Segmentations of the word's occurrences."""
        out, now, size = set(), [], 0
        for i in ids:
            now.append(int(i))
            size += len(MODEL.bytes_of[i])
            if size == len(word):
                out.add(tuple(now))
                now, size = [], 0
        assert not now
        return out

    found = [len(kinds(x)) for x in sentencepieces.encode_texts(MODEL, texts, salts, 0.1, 1)]
    assert 4 < found[0] < found[1] < found[2]
    docs = spark.createDataFrame([(k, f"{k} {texts[1]}") for k in range(40)], "doc_id long, text string").coalesce(1)
    one = [tuple(r.ids) for r in sentencepieces.encode(docs, dropout=0.1).collect()]
    assert len({x[-60:] for x in one}) == 40  # the same words at the same places, in other texts
    assert [len(kinds(x)) for x in sentencepieces.encode_texts(MODEL, texts, salts, 0.0, 1)] == [1, 1, 1]


@pytest.mark.parametrize("dropout", [0.1, 0.5, 0.9, 1.0])
def test_shared_merges_are_those_of_each_occurrence(dropout, monkeypatch):
    rng = np.random.default_rng(6)
    words = ["international", "the", "of", "undertaking", "漢字", "an" * 60, "x", "responsibilities"]
    texts = [" ".join(rng.choice(words, 3000)) for _ in range(3)] + ["", "the", "x x x"]
    salts, merged, plain = np.arange(len(texts), dtype=np.uint64), [], sentencepieces.merge_words
    monkeypatch.setattr(sentencepieces, "merge_words", lambda model, symbols, *rest, **more: merged.append(len(symbols)) or plain(model, symbols, *rest, **more))
    got = sentencepieces.encode_texts(MODEL, texts, salts, dropout, 4)
    done = sum(merged)
    monkeypatch.setattr(sentencepieces, "SHARED", 1 << 60)
    want = sentencepieces.encode_texts(MODEL, texts, salts, dropout, 4)
    assert [x.tolist() for x in got] == [x.tolist() for x in want] and [spell(x) for x in got] == texts
    if dropout == 0.1:  # words of up to 96 characters; each longer one has its own merges
        assert done - sum(len(w) + 1 for t in texts for w in t.split() if len(w) > 96) < 0.2 * sum(len(w) + 1 for t in texts for w in t.split() if len(w) <= 96)


def test_merges_by_hash():
    rng = np.random.default_rng(1)
    pairs = np.concatenate([MODEL.keys, rng.choice(MODEL.keys, 1000) + rng.integers(-3, 4, 1000), rng.integers(0, MODEL.size**2, 5000)])
    which, at = MODEL.merge_of(pairs)
    found = dict(zip(which.tolist(), zip(MODEL.rank[at].tolist(), MODEL.made[at].tolist())))
    assert (MODEL.slots == -2).any() and found == {i: MODEL.merges[p] for i, p in enumerate(pairs.tolist()) if p in MODEL.merges}
