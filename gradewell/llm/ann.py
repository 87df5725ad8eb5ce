"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking.

Coarse centroids in two levels split the vectors into cells of a few rows in small tables, up to
``max_cells`` in large ones; what is left of a vector after its centroid is quantised in ``m`` parts
of 256 codewords each.  A query looks into the cells whose centroid is near enough, scores their codes
by tables of its inner products with all codewords (asymmetric distances), and all that may be among
the best, by the measured error of the codes, are scored exactly on the original vectors.

Two figures say what is near enough.  A query's floor is its k-th best score in a sample of a quarter
of the rows, ``guide_rows`` at most, which the k-th best of all rows can't be below.  How far a centroid may lie under that floor is
calibrated: a bounded set of queries is answered by brute force over all rows, and the distance that
covers the wanted share of their true neighbours is taken.

Rows lie in a line by cell, cut into groups of equal size, so a cell with a third of all rows is many
groups' work, and neighbouring cells share a group.  A task holds the rows of one group at a time and
streams the queries past them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, parts

PAIRS, STRIP = 1 << 20, 1 << 15  # codes scored by one call, and in one strip of it that stays in the cache


def _sums(x: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and vector sum of each of k groups of rows."""
    order = np.argsort(own, kind="stable")
    size = np.bincount(own, minlength=k)
    total = np.zeros((k, x.shape[1]), dtype=x.dtype)
    some = np.flatnonzero(size)
    if len(some):
        total[some] = np.add.reduceat(x[order], (np.cumsum(size) - size)[some], axis=0)
    return size, total


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids of x; an empty cell is moved to the point farthest from its own."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        d = (c * c).sum(1) - 2 * (x @ c.T)
        own = d.argmin(1)
        size, total = _sums(x, own, len(c))
        full = size > 0
        c[full] = total[full] / size[full, None]
        far = np.argsort(-(d[np.arange(len(x)), own] + (x * x).sum(1)), kind="stable")
        c[~full] = x[far[: int((~full).sum())]]
    return c


class Index:
    """Centroids in two levels and codebooks; what the tasks need to encode rows and to score codes.

    ``coarse`` are the cells' centroids, those of one upper cell side by side; ``first`` are the upper
    cells' beginnings (and the end), ``upper`` their centroids, ``spread`` the mean distance of a
    cell's rows from its centroid.
    """

    def __init__(self, coarse: np.ndarray, first: np.ndarray, upper: np.ndarray, books: np.ndarray, spread: np.ndarray | None = None):
        self.coarse, self.upper, self.books = (a.astype(np.float32) for a in (coarse, upper, books))
        self.first = first
        self.spread = np.zeros(len(coarse), np.float32) if spread is None else spread.astype(np.float32)

    def cells(self, x: np.ndarray, look: int = 6) -> np.ndarray:
        """The nearest cell of each row among those of its ``look`` nearest upper cells."""
        out = np.empty(len(x), dtype=np.int32)
        half, high = (self.coarse * self.coarse).sum(1) / 2, (self.upper * self.upper).sum(1) / 2
        for at in range(0, len(x), 8192):
            part = x[at : at + 8192]
            far = high - part @ self.upper.T
            look = min(look, len(self.upper))
            near = np.argpartition(far, look - 1, axis=1)[:, :look]
            rows, ups = np.repeat(np.arange(len(part)), look), near.ravel()
            order = np.argsort(ups, kind="stable")
            rows, ups = rows[order], ups[order]
            best, cell = np.full(len(part), np.inf, np.float32), np.zeros(len(part), np.int32)
            cuts = np.searchsorted(ups, np.arange(len(self.upper) + 1))
            for u, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                lo, hi = self.first[u], self.first[u + 1]
                if a < b and lo < hi:
                    r = rows[a:b]
                    d = half[lo:hi] - part[r] @ self.coarse[lo:hi].T
                    k = d.argmin(1)
                    d = d[np.arange(len(r)), k]
                    new = d < best[r]
                    best[r[new]], cell[r[new]] = d[new], lo + k[new]
            out[at : at + 8192] = cell
        return out

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        m, width = self.books.shape[0], self.books.shape[2]
        rest = (x - self.coarse[cell]).reshape(len(x), m, width)
        codes = np.empty((len(x), m), dtype=np.uint8)
        for j in range(m):
            half = (self.books[j] ** 2).sum(1) / 2
            codes[:, j] = (half - rest[:, j] @ self.books[j].T).argmin(1)
        return codes

    def nearness(self, q: np.ndarray, cells=slice(None)) -> np.ndarray:
        """Of queries and cells: the inner product with the centroid, and some of the cell's spread."""
        return q @ self.coarse[cells].T + np.linalg.norm(q, axis=1)[:, None] * (self.spread[cells] / 4)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of each query with all codewords: [queries, m * codewords]."""
        m, words, width = self.books.shape
        return np.einsum("jkw,qjw->qjk", self.books, q.reshape(len(q), m, width), optimize=True).reshape(len(q), m * words)


def fit(sample: np.ndarray, cells: int, m: int = 16, rounds: int = 8, seed: int = 7, book_rows: int = 16_384) -> Index:
    """Index of a sample; the number of dimensions is padded by zeros to a multiple of m by the caller."""
    upper = _kmeans(sample, max(1, round(np.sqrt(cells))), rounds, seed)
    own = ((upper * upper).sum(1) / 2 - sample @ upper.T).argmin(1)
    groups = np.split(np.argsort(own, kind="stable"), np.cumsum(np.bincount(own, minlength=len(upper)))[:-1])
    share = cells / len(sample)
    coarse = [_kmeans(sample[g], max(1, round(share * len(g))), rounds, seed + 1) if len(g) else sample[:0] for g in groups]
    first = np.cumsum([0, *map(len, coarse)])
    index = Index(np.concatenate(coarse), first, upper, np.zeros((m, 1, sample.shape[1] // m)))
    cell = index.cells(sample)
    away = sample - index.coarse[cell]
    size = np.bincount(cell, minlength=len(index.coarse))
    spread = np.bincount(cell, weights=np.linalg.norm(away, axis=1), minlength=len(size)) / np.maximum(size, 1)
    if len(size) * 2 > len(sample):  # so few rows a cell that those of the sample say little of the others
        spread[:] = 0
    rest = away[:book_rows].reshape(min(len(away), book_rows), m, -1)
    books = [_kmeans(np.ascontiguousarray(rest[:, j]), min(256, len(rest)), rounds, seed + j) for j in range(m)]
    return Index(index.coarse, first, upper, np.stack(books), spread)


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as an array of doubles (all of length dims, no nulls)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _exact(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows with queries (one each, or one for all), each summed the same way wherever its row stands."""
    return (v * q).sum(axis=1)


def _first_k(owner: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each owner's k largest scores, ties to smaller ids, by owner and best first."""
    order = np.lexsort((ids, -scores, owner))
    own = owner[order]
    head = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    rank = np.arange(len(own)) - np.repeat(head, np.diff(np.r_[head, len(own)]))
    return order[rank < k]


def code_error(index: Index, sample: np.ndarray, queries: int = 64, rows: int = 4000) -> float:
    """Standard deviation of the inner products' error that the codes make, per unit of the query's length."""
    x, q = sample[-rows:], sample[:queries]
    cell = index.cells(x)
    codes = index.encode(x, cell)
    lost = x - index.coarse[cell] - np.concatenate([index.books[j][codes[:, j]] for j in range(codes.shape[1])], axis=1)
    norm = np.linalg.norm(q, axis=1)
    return float(((lost @ q.T) / np.where(norm > 0, norm, 1)).std())


def floors(q: np.ndarray, q_ids: np.ndarray, guide: np.ndarray, guide_ids: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best score among the guide rows of other ids, less rounding; -inf if there are fewer."""
    out = np.full(len(q), -np.inf)
    for at in range(0, len(q), 256):
        s = q[at : at + 256] @ guide.T
        s[q_ids[at : at + 256, None] == guide_ids[None, :]] = -np.inf
        if s.shape[1] >= k:
            best = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k].astype(np.float64)
            out[at : at + 256] = best - 1e-5 * np.linalg.norm(q[at : at + 256], axis=1) * np.abs(guide).max(initial=1.0)
    return out


def top_k(found: DataFrame, by: str, k: int) -> DataFrame:
    """The ``k`` best rows of each ``by`` as ``rank`` 0 and on: a group limit before and after one shuffle."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    vectors: DataFrame,
    is_query,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    m: int = 16,
    sample_rows: int = 65_536,
    max_cells: int = 8192,
    guide_rows: int = 16_384,
    rerank: float = 3.5,
    recall: float = 0.97,
    calibrate: int = 128,
    block_rows: int = 65_536,
    stats: dict | None = None,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found by inner product, best first.

    ``is_query`` is a column that marks the queries; candidates are all rows but the query's own
    (rows with the query's id are left out).  Vectors that are null, empty, zero, of another length
    than most, or hold null or non-finite components take no part, nor do rows with a null id.  A
    query with fewer candidates than ``k`` gets all of them.  Scores are exact, in double precision,
    on the original vectors; ties go to the smaller id.  Repeated rows are candidates each; of a query
    id with several vectors, the least one asks.

    The index is fitted on at most ``sample_rows`` rows in hash order of their ids; all rows are
    indexed, in a cell for every two rows up to ``max_cells`` (and one for eight sampled rows in large tables).
    ``calibrate`` queries find how far below a query's floor a cell may lie so that a ``recall`` share
    of true neighbours is looked at; a query's cells always hold at least ``k`` other rows where there
    are so many.  Reranked is what scores within ``rerank`` standard errors of the codes below the
    floor.  ``stats``, if given, gets the number of cells, the calibrated distance and the share of all
    rows whose codes a query scores, measured on the same queries.
    """
    spark = vectors.sparkSession
    types = dict(vectors.dtypes)
    kind, listed = types[id_col], types[vec_col] if types[vec_col] in ("array<float>", "array<double>") else "array<double>"
    schema = f"query_id {kind}, rank int, vec_id {kind}, score double"
    raw = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast(listed).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = raw.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(finite & F.exists("v", lambda x: x != 0))
    widths = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("count"), F.count_if("q").alias("asks")).orderBy(F.desc("count"), "n").limit(1).collect()
    if not widths or not widths[0][2]:
        return spark.createDataFrame([], schema)
    dims, n, asking = widths[0]
    rows = rows.where(F.size("v") == dims)
    padded = -(-dims // m) * m

    def pad(x):
        return np.pad(x.astype(np.float32), ((0, 0), (0, padded - dims)))

    def sample_of(chosen, total, limit):
        """At most ``limit`` of about ``total`` rows, one of each id, in hash order: a cut of the hashes first, so little is ordered."""
        rank = F.xxhash64("id")
        cut_at = min(1.0, 1.1 * (limit + 1000) / total) * 2.0**64 - 2.0**63
        few = chosen.where(rank <= int(min(cut_at, 2.0**63 - 1024))) if cut_at < 2.0**63 - 1024 else chosen
        got = few.groupBy("id").agg(F.min("v").alias("v")).orderBy(rank, "id").limit(limit).toArrow()
        return got.column("id").to_numpy(zero_copy_only=False), _vectors(got.column("v"), dims)

    sample_ids, sample = sample_of(rows, n, sample_rows)
    sample = pad(sample)
    cells = int(min(max_cells, max(1, n // 2), max(1, len(sample) // (8 if n > sample_rows else 2))))
    index = fit(sample, cells, m)
    margin = rerank * code_error(index, sample)
    few = min(guide_rows, n // 4)
    guide, guide_ids = sample[:few], sample_ids[:few]

    def encode(batches):
        for batch in batches:
            x = pad(_vectors(batch.column(1), dims))
            cell = index.cells(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(cell), _binary(index.encode(x, cell))], names=["id", "v", "q", "cell", "code"])

    coded = cut(rows.select("id", "v", "q").mapInArrow(encode, f"id {kind}, v {listed}, q boolean, cell int, code binary"))
    sizes = np.zeros(len(index.coarse), dtype=np.int64)
    for r in coded.groupBy("cell").count().collect():  # at most max_cells rows
        sizes[r[0]] = r[1]

    # brute force for a few queries: how far the cells of their true neighbours lie below their floors
    test_ids, tests = sample_of(rows.where("q"), asking, calibrate)

    def true_best(batches):
        best = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, test_ids.dtype), np.zeros(0, np.int32)]  # test, score, id, cell
        for batch in batches:
            ids, v, cell = batch.column(0).to_numpy(zero_copy_only=False), _vectors(batch.column(1), dims), batch.column(2).to_numpy()
            for t in range(len(tests)):
                s = _exact(v, tests[t])
                s[ids == test_ids[t]] = -np.inf
                top = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k]) if len(s) > k else np.arange(len(s))
                top = top[np.isfinite(s[top])]
                best = [np.concatenate(x) for x in zip(best, (np.full(len(top), t), s[top], ids[top], cell[top]))]
            keep = _first_k(best[0], best[1], best[2], k)
            best = [x[keep] for x in best]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], names=["t", "score", "vec_id", "cell"])

    wide = index.nearness(pad(tests))
    near = top_k(coded.select("id", "v", "cell").mapInArrow(true_best, f"t long, score double, vec_id {kind}, cell int"), "t", k).select("t", "cell").toArrow()  # calibrate * k rows
    low = floors(pad(tests), test_ids, guide, guide_ids, k)
    t, c = near.column("t").to_numpy(), near.column("cell").to_numpy()
    gaps = (wide[t, c] - low[t]) / np.linalg.norm(tests, axis=1)[t]
    gaps = gaps[np.isfinite(gaps)]
    gap = float(np.quantile(gaps, 1 - recall, method="lower")) if len(gaps) else -np.inf
    if stats is not None:
        edge = (low + gap * np.linalg.norm(tests, axis=1))[:, None]
        stats.update(cells=len(sizes), gap=gap, margin=margin, share=float(((wide >= edge) @ sizes).mean() / n))

    # rows in a line by cell; a group is a stretch of it
    start = np.cumsum(sizes) - sizes
    per = int(min(block_rows, max(512, -(-n // (4 * parts(spark, n, block_rows))))))
    lo_group, hi_group = start // per, (start + np.maximum(sizes, 1) - 1) // per
    groups = int(-(-n // per))

    def probe(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids, x = batch.column(0).to_numpy(zero_copy_only=False), pad(_vectors(batch.column(1), dims))
                norm = np.linalg.norm(x, axis=1).astype(np.float64)
                low = floors(x, ids, guide, guide_ids, k)
                score = index.nearness(x)
                score[:, sizes == 0] = -np.inf
                edge = low + gap * norm
                for i in np.flatnonzero((score >= edge[:, None]) @ sizes < min(n, 8 * (k + 1))):  # down to the last cell of those that hold enough rows
                    order = np.argsort(-score[i], kind="stable")[: int((sizes > 0).sum())]
                    edge[i] = score[i, order[min(len(order) - 1, int((np.cumsum(sizes[order]) < min(n, 8 * (k + 1))).sum()))]]
                edge -= 1e-4 * (norm + np.where(np.isfinite(edge), np.abs(edge), 0))
                owner, group = [], []
                for i in range(len(x)):
                    hit = np.flatnonzero(score[i] >= edge[i] - 1e-5 * norm[i])
                    step = np.bincount(lo_group[hit], minlength=groups + 1) - np.bincount(hi_group[hit] + 1, minlength=groups + 1)
                    g = np.flatnonzero(np.cumsum(step[:-1]) > 0)
                    owner.append(np.full(len(g), i))
                    group.append(g)
                owner = np.concatenate(owner)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(group)), batch.column(0).take(pa.array(owner)), batch.column(1).take(pa.array(owner)), pa.array(edge[owner]), pa.array(low[owner])], names=["g", "id", "v", "edge", "low"])

    places = spark.createDataFrame([(int(c), int(start[c]), int(sizes[c])) for c in np.flatnonzero(sizes)], "cell int, start long, size long")  # at most max_cells rows
    spot = F.col("start") + F.pmod(F.xxhash64("id", F.lit(5)), F.col("size"))
    candidates = coded.join(F.broadcast(places), "cell").select(F.floor(spot / per).cast("long").alias("g"), F.lit(False).alias("asks"), "id", "v", "cell", "code", F.lit(None).cast("double").alias("edge"), F.lit(None).cast("double").alias("low"))
    queries = coded.where("q").groupBy("id").agg(F.min("v").alias("v")).repartition(parts(spark, asking, 5000), "id")
    asked = queries.mapInArrow(probe, f"g long, id {kind}, v {listed}, edge double, low double")
    asked = asked.select("g", F.lit(True).alias("asks"), "id", "v", F.lit(None).cast("int").alias("cell"), F.lit(None).cast("binary").alias("code"), "edge", "low")

    def answer(batches):
        held: list[pa.RecordBatch] = []  # candidates of the group in hand
        state = None  # (group, its arrays)

        def load(group):
            t = pa.Table.from_batches(held)
            cell, ids = t.column("cell").to_numpy(), t.column("id").to_numpy(zero_copy_only=False)
            order = np.argsort(cell, kind="stable")
            codes = np.frombuffer(b"".join(t.column("code").to_pylist()), dtype=np.uint8).reshape(len(t), m)[order]
            cell = cell[order]
            new = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            flat = np.ascontiguousarray((codes + (np.arange(m, dtype=np.int32) * index.books.shape[1])[None, :]).T)
            return group, cell[new], np.r_[new, len(cell)], flat, ids[order], _vectors(t.column("v"), dims)[order]

        def ask(part):
            _, cell, first, flat, ids, v = state
            qid, qv = part.column("id").to_numpy(zero_copy_only=False), _vectors(part.column("v"), dims)
            edge, low = part.column("edge").to_numpy(), part.column("low").to_numpy()
            x = pad(qv)
            norm = np.linalg.norm(qv, axis=1)
            size = np.diff(first)
            look = index.nearness(x, cell) >= edge[:, None]
            pairs = np.cumsum(look @ size)
            at = 0
            while at < len(qid):
                end = max(at + 1, min(at + 256, int(np.searchsorted(pairs, (pairs[at - 1] if at else 0) + PAIRS, side="right"))))
                i, c = np.nonzero(look[at:end])
                if len(i):
                    table = index.tables(x[at:end]).ravel()
                    base = (x[at:end] @ index.coarse[cell].T)[i, c]
                    span = size[c]
                    row = np.repeat(first[c] - (np.cumsum(span) - span), span) + np.arange(int(span.sum()))
                    q = np.repeat(i, span)
                    rough, shift = np.repeat(base, span), (q * (m * index.books.shape[1])).astype(np.int32)
                    spot, term = np.empty(STRIP, np.int32), np.empty(STRIP, np.float32)
                    for a in range(0, len(row), STRIP):
                        r, n_r = row[a : a + STRIP], min(STRIP, len(row) - a)
                        for j in range(m):
                            np.take(flat[j], r, out=spot[:n_r], mode="clip")
                            spot[:n_r] += shift[a : a + STRIP]
                            np.take(table, spot[:n_r], out=term[:n_r], mode="clip")
                            rough[a : a + STRIP] += term[:n_r]
                    q += at
                    may = np.flatnonzero((rough >= (low - margin * norm)[q]) & (ids[row] != qid[q]))
                    q, row = q[may], row[may]
                    score = _exact(v[row], qv[q])
                    over = np.flatnonzero(score >= low[q])  # the k-th best of all rows is no lower
                    q, row, score = q[over], row[over], score[over]
                    best = _first_k(q, score, ids[row], k)
                    yield pa.RecordBatch.from_arrays([pa.array(qid[q[best]]), pa.array(ids[row[best]]), pa.array(score[best])], names=["query_id", "vec_id", "score"])
                at = end

        group = None
        for batch in batches:
            gs, asks = batch.column("g").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            if not len(gs):
                continue
            cuts = np.flatnonzero(np.r_[True, (gs[1:] != gs[:-1]) | (asks[1:] != asks[:-1])])
            for a, b in zip(cuts, [*cuts[1:], len(gs)]):
                part = batch.slice(a, b - a)
                if gs[a] != group:
                    group, held, state = gs[a], [], None
                if not asks[a]:
                    held.append(part)
                elif held:
                    if state is None:
                        state = load(group)
                    yield from ask(part)

    both = candidates.unionByName(asked).repartition(parts(spark, n, per), "g").sortWithinPartitions("g", "asks")
    found = both.mapInArrow(answer, f"query_id {kind}, vec_id {kind}, score double")
    return top_k(found, "query_id", k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def measured_recall(found: DataFrame, vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", queries: int = 100) -> float:
    """Share of the true ``k`` nearest of some queries (the first in hash order) that ``found`` holds."""
    some = vectors.where(is_query).select(F.col(id_col).alias("query_id"), F.col(vec_col).cast("array<double>").alias("qv")).orderBy(F.xxhash64("query_id")).limit(queries)
    rest = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    dot = F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    pairs = rest.join(F.broadcast(some), F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", dot.alias("s"))
    true = pairs.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), "vec_id"))), 1, k).alias("top")).select("query_id", F.explode("top").alias("e")).select("query_id", F.col("e.vec_id").alias("vec_id"))
    hit = true.join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count()
    return hit / max(1, true.count())
