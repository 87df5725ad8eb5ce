"""SimHash fingerprints and their near-duplicate join by a binary trie.

``fingerprints``   text -> 64-bit SimHash.
``trie_links``     all pairs of a sorted block of fingerprints within a Hamming budget, by walking
                   pairs of trie nodes together and pruning once the budget is exceeded.
``hamming_links``  the distributed join: two fingerprints that differ in at most ``k`` bits agree on
                   at least one of ``k + 1`` bit blocks, so the trie of each block value is one unit
                   of work.  A block value that holds too many fingerprints is dealt over pairs of
                   salts, so no task grows with it and no link is lost.
``components``     connected components of the links by alternating stars, in DataFrame joins.
``near_duplicates`` document -> (fingerprint, component).
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, parts

FLAT = 1 << 17  # shingle hashes whose bits are counted at once


def _bit_counts(hashes: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Number of set bits in each of 64 places for consecutive runs of ``hashes``."""
    counts = np.zeros((len(sizes), 64), dtype=np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for at in range(0, len(hashes), FLAT):
        own = owner[at : at + FLAT]
        bits = np.unpackbits(hashes[at : at + FLAT].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        counts[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    return counts


def simhash_values(texts, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """Fingerprints (uint64) of an iterable of UTF-8 byte texts; None counts as empty."""
    import xxhash

    digest, hashes, sizes = xxhash.xxh64_intdigest, [], []
    out = []

    def flush():
        if sizes:
            flat = np.fromiter(hashes, dtype=np.uint64, count=len(hashes))
            n = np.array(sizes, dtype=np.int64)
            ones = _bit_counts(flat, sizes) * 2 > n[:, None]
            out.append(np.packbits(ones, axis=1, bitorder="little").view(np.uint64).ravel())
            hashes.clear()
            sizes.clear()

    for text in texts:
        words = text.lower().split() if text else []  # bytes: only A-Z change, only ASCII white space splits
        before = len(hashes)
        if len(words) >= shingle:
            hashes.extend(map(digest, map(b" ".join, zip(*(words[i:] for i in range(shingle)))), repeat(seed)))
        elif words:
            hashes.append(digest(b" ".join(words), seed))
        sizes.append(len(hashes) - before)
        if len(hashes) >= 4 * FLAT:
            flush()
    flush()
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(id_col, fp)``: the SimHash of each row's whole text as a signed long.

    Words are runs outside ASCII white space with A-Z lower-cased; shingles of ``shingle`` words are
    joined by spaces and hashed by XXH64.  A bit is set if it is set in over half of the hashes.
    Texts with fewer words hash as one shingle; null and wordless texts get 0.  Rows stay as they
    are: repeated rows and null ids each give a row.
    """

    def run(batches):
        for batch in batches:
            fp = simhash_values(batch.column(1).to_pylist(), shingle, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    slim = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("text"))
    kind = slim.schema[0].dataType.simpleString()
    return slim.mapInArrow(run, f"`{id_col}` {kind}, fp long")


# ---------------------------------------------------------------- the trie join


def _join_labels(lab: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merge the sets of i and j in the label array (label = smallest index of a set)."""
    while len(i):
        a, b = lab[i], lab[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(lab, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = lab[lab]
            if np.array_equal(up, lab):
                break
            lab = up
    return lab


def _pairs_of(lo1, hi1, lo2, hi2):
    """All index pairs of cross node pairs, as two flat arrays."""
    n1, n2 = hi1 - lo1, hi2 - lo2
    size = n1 * n2
    which = np.repeat(np.arange(len(size)), size)
    k = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    return lo1[which] + k // n2[which], lo2[which] + k % n2[which]


def trie_links(values: np.ndarray, starts: np.ndarray, budget: int = 3, bits: int = 64, leaf: int = 24, room: int = 1 << 20):
    """Walk the tries of runs of sorted ``values`` and merge what is within ``budget`` bits.

    ``starts`` are the offsets of the runs (plus the end): each run is a trie of its own, and its
    values are sorted.  A frontier of node pairs descends bit by bit: a node with itself gives its
    two children with themselves and with each other, two different nodes give four pairs of
    children; a pair whose differing bits exceed the budget is dropped.  Small pairs are settled by
    counting bits.  Only ``room`` node pairs are worked on at a time.

    Returns a label for each value: the smallest index in its component of the run.
    """
    n = len(values)
    lab = np.arange(n)
    lo, hi = starts[:-1], starts[1:]
    keep = hi - lo > 1
    lo, hi = lo[keep], hi[keep]
    if not len(lo):
        return lab
    ones = {}

    def split(d, lo, hi):
        if d not in ones:
            ones[d] = np.r_[0, np.cumsum((values >> np.uint64(bits - 1 - d)) & np.uint64(1)).astype(np.int64)]
        c = ones[d]
        return hi - (c[hi] - c[lo])

    # the second pair of bounds is the first for a node with itself
    stack = [(0, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        d, lo1, hi1, lo2, hi2, diff = stack.pop()
        if len(lo1) > room:
            for at in range(0, len(lo1), room):
                stack.append((d, *(x[at : at + room] for x in (lo1, hi1, lo2, hi2, diff))))
            continue
        size = (hi1 - lo1) * (hi2 - lo2)
        small = (size <= leaf) | (d >= bits)
        if small.any():
            s = np.flatnonzero(small)
            total = np.cumsum(size[s])
            cuts = np.r_[0, np.searchsorted(total, np.arange(4 * room, total[-1], 4 * room)), len(s)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a < b:
                    k = s[a:b]
                    i, j = _pairs_of(lo1[k], hi1[k], lo2[k], hi2[k])
                    near = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
                    lab = _join_labels(lab, i[near], j[near])
            big = ~small
            lo1, hi1, lo2, hi2, diff = lo1[big], hi1[big], lo2[big], hi2[big], diff[big]
        if not len(lo1):
            continue
        m1, m2 = split(d, lo1, hi1), split(d, lo2, hi2)
        own = lo1 == lo2
        more = diff + 1
        grown = [
            (lo1, m1, lo2, m2, diff, True),
            (m1, hi1, m2, hi2, diff, True),
            (lo1, m1, m2, hi2, more, True),
            (m1, hi1, lo2, m2, more, ~own),
        ]
        nxt = []
        for a, b, c, e, x, only in grown:
            ok = (b > a) & (e > c) & (x <= budget) & only & ~((a == c) & (b - a < 2))
            nxt.append((a[ok], b[ok], c[ok], e[ok], x[ok]))
        stack.append((d + 1, *(np.concatenate(x) for x in zip(*nxt))))
    return lab


def hamming_links(fps: DataFrame, budget: int = 3, bits: int = 64, task_rows: int = 200_000, hot_rows: int | None = None) -> DataFrame:
    """Links ``(a, b)``, b < a as unsigned values, that connect all fingerprints within ``budget`` bits.

    ``fps`` has one long column ``fp`` without repeats.  The links span the graph of near pairs: two
    fingerprints within the budget are always connected by links, and every link lies inside a
    component.  A dense group of n fingerprints gives n - 1 links, never n * n.

    Blocks: ``m`` of them, of which ``m - budget`` must agree; m grows with the number of rows so
    that a block value holds few of them.  A block value with over ``hot_rows`` rows is dealt over
    all pairs of s salts: each of its rows goes to s tasks of two salts' rows each, so every pair of
    rows meets in one of them.
    """
    from itertools import combinations

    spark = fps.sparkSession
    n = fps.count()
    m = budget + (1 if n <= 1 << 24 else 2 if n <= 1 << 31 else 3)
    edges = [bits * i // m for i in range(m + 1)]
    tables = list(combinations(range(m), m - budget))
    orders = []  # per table the bit places, those that may differ first
    for table in tables:
        fixed = [p for b in table for p in range(edges[b], edges[b + 1])]
        orders.append(fixed)
    rows = n * len(tables)
    limit = hot_rows or min(20_000, max(512, rows // 512))

    def masked(fixed):
        mask = sum(1 << p for p in fixed)
        return mask - (1 << 64) if mask >> 63 else mask

    keyed = fps.select(
        "fp",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(masked(fixed)).cast("long")) for fixed in orders])).alias("tab", "val"),
    )
    hot = cut(keyed.groupBy("tab", "val").count().where(F.col("count") > limit))
    n_hot = hot.count()
    if n_hot:
        salts = hot.select("tab", "val", F.ceil(F.col("count") / (limit / 2)).cast("int").alias("s"))
        if n_hot <= 50_000:  # checked bound: about 1 MB; beyond it the join shuffles
            salts = F.broadcast(salts)
        keyed = keyed.join(salts, ["tab", "val"], "left").withColumn("own", F.when(F.col("s").isNotNull(), F.pmod(F.xxhash64("fp"), F.col("s"))))
        keyed = keyed.withColumn(
            "task",
            F.explode(
                F.when(F.col("s").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
                    F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda x: F.least(x.cast("long"), F.col("own")) * (1 << 31) + F.greatest(x.cast("long"), F.col("own")) + 1)
                )
            ),
        )
        rows += sum(r[0] for r in hot.agg(F.sum(F.col("count") * F.ceil(F.col("count") / (limit / 2)))).collect())
    else:
        keyed = keyed.withColumn("task", F.lit(0).cast("long"))

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        tab, val, task, fp = (t.column(c).to_numpy() for c in ("tab", "val", "task", "fp"))
        raw = fp.view(np.uint64)
        turned = raw.copy()
        for k, fixed in enumerate(orders):
            at = tab == k
            if at.any():
                x, y, to = raw[at], np.zeros(int(at.sum()), np.uint64), bits
                free = [p for p in reversed(range(bits)) if p not in set(fixed)]
                for p in free + fixed:  # bits that may differ come first
                    to -= 1
                    y |= ((x >> np.uint64(p)) & np.uint64(1)) << np.uint64(to)
                turned[at] = y
        order = np.lexsort((turned, task, val, tab))
        tab, val, task, turned, raw = (x[order] for x in (tab, val, task, turned, raw))
        new = np.flatnonzero(np.r_[True, (tab[1:] != tab[:-1]) | (val[1:] != val[:-1]) | (task[1:] != task[:-1])])
        lab = trie_links(turned, np.r_[new, len(turned)], budget, bits)
        far = np.flatnonzero(lab != np.arange(len(lab)))
        a, b = raw[far], raw[lab[far]]
        for at in range(0, len(far), 100_000):
            x, y = a[at : at + 100_000], b[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y).view(np.int64)), pa.array(np.minimum(x, y).view(np.int64))], names=["a", "b"])

    dealt = keyed.select("fp", "tab", "val", "task").repartition(parts(spark, rows, task_rows), "tab", "val", "task")
    return dealt.mapInArrow(run, "a long, b long")


# ---------------------------------------------------------------- components


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of ``links``: root is the smallest node (signed) it reaches.

    Large-star and small-star steps alternate until the set of links no longer changes.  Each step is
    a grouped minimum (summed before the shuffle) and an equi-join whose inputs were written before,
    so that adaptive execution can split the partition of a node with very many links.
    Null ends and loops are ignored; repeated links count once.
    """
    e = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())

    def state(x):
        return tuple(x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = state(e)
    while now[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = cut(both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        e = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        last, now = now, state(e)
        if last == now:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 3, hot_rows: int = 50_000) -> DataFrame:
    """``(id_col, fp, component)`` for every row of ``docs``.

    Rows are linked if their fingerprints differ in at most ``budget`` bits; ``component`` is the
    smallest id reachable over links (a document reaches itself).  Null ids are ignored in that
    minimum, and a component without any other id has a null one.  Null and wordless texts share the
    fingerprint 0 and are linked like any other.  An empty table gives an empty result.  Fingerprints
    of over ``hot_rows`` rows are joined by broadcast (beyond 100,000 of those, by key).
    """
    own = cut(fingerprints(docs, id_col, text_col, shingle))
    low = cut(own.groupBy("fp").agg(F.min(id_col).alias("low"), F.count("*").alias("n")))
    found = cut(components(hamming_links(low.select("fp"), budget)))
    roots = cut(found.join(low.select(F.col("fp").alias("node"), "low"), "node").groupBy("root").agg(F.min("low").alias("best")))
    known = cut(found.join(roots, "root").select(F.col("node").alias("fp"), "best"))
    by_fp = cut(low.join(known, "fp", "left").select("fp", "n", F.when(F.col("best").isNotNull(), F.col("best")).otherwise(F.col("low")).alias("component")))
    # a fingerprint of very many rows would be one task of the join: those are few (at most rows / hot_rows) and go to every task
    hot = by_fp.where(F.col("n") > hot_rows).drop("n")
    if 0 < hot.count() <= 100_000:
        rest = own.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(by_fp.where(F.col("n") <= hot_rows).drop("n"), "fp")
        return rest.select(F.col(id_col), "fp", "component").unionByName(own.join(F.broadcast(hot), "fp").select(F.col(id_col), "fp", "component"))
    return own.join(by_fp.drop("n"), "fp").select(F.col(id_col), "fp", "component")


def hex_fingerprint(col: str = "fp"):
    """16 lower-case hex digits of a fingerprint column."""
    return F.lower(F.lpad(F.hex(F.col(col)), 16, "0"))
