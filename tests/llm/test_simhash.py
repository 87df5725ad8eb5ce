"""SimHash: fingerprints and components against brute force."""

import numpy as np
import pytest
import xxhash

from gradewell.llm import queries, simhash

SF = "/root/testdata/sf0.001"


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(fps):
    """Smallest index reachable over pairs of at most 3 differing bits."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    comp = np.arange(len(fps))
    while True:
        new = np.array([comp[row].min() for row in near])
        if (new == comp).all():
            return comp
        comp = new


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas().sort_values("doc_id")
    got = queries.op10_simhash_near_dedup(spark, SF).toPandas().sort_values("doc_id")
    want = [slow_fingerprint(t) for t in docs.text]
    assert list(got.fingerprint) == [f"{v:016x}" for v in want]
    comp = slow_components(np.array(want, dtype=np.uint64))
    assert list(got.component_id) == list(docs.doc_id.to_numpy()[comp])


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "One two", "x"), (5, "oNE  TWO", "x"), (None, "one two", "x"), (7, "É", "x"), (8, "é", "x"), (8, "é", "x"), (9, "a b c " * 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {(r.doc_id, r.component) for r in simhash.near_duplicates(docs).collect()}
    assert {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (None, 4), (7, 7), (8, 8)} <= got
    assert simhash.near_duplicates(docs).count() == len(rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [None, 40])
def test_dense_groups_keep_every_link(spark, hot):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    flip = lambda x: x ^ (np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64))
    values = np.unique(np.concatenate([base] + [flip(flip(base)) for _ in range(15)] + [flip(flip(base[:1].repeat(300)))]))
    comp = slow_components(values)
    assert (simhash.trie_links(values, np.array([0, len(values)])) == comp).all()
    fps = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    found = simhash.components(simhash.hamming_links(fps, hot_rows=hot)).toPandas()
    root = dict(zip(found.node, found.root))
    got = [root.get(int(v), int(v)) for v in values.view(np.int64)]
    assert len(set(zip(got, comp))) == len(set(got)) == len(set(comp))


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (1, 0)]
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def test_hot_fingerprints(spark):
    """Half the rows without words, a sixth copies: joined by broadcast and by key alike."""
    rows = [(i, None if i % 2 else "the same words again" if i % 3 == 0 else f"own words {i} " * 4) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((r.doc_id, r.fp, r.component) for r in simhash.near_duplicates(docs).collect())
    assert sorted((r.doc_id, r.fp, r.component) for r in simhash.near_duplicates(docs, hot_rows=100).collect()) == want
    comp = slow_components(np.array([slow_fingerprint(t) for _, t in rows], dtype=np.uint64))
    assert [c for _, _, c in want] == comp.tolist()
