"""Quality by compression: zstandard dictionaries of good and of bad text.

A text is compressed piece by piece with a dictionary built from good labelled texts and with one
built from bad ones.  How much smaller the good dictionary makes it, per byte of text, is its
normalised size difference; a logistic curve fitted on labelled texts that neither dictionary has
seen turns that into a calibrated score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import texts_of
from .toxicity import held_out

SHORT = 128  # bytes of a text whose difference counts half
PIECE = 1024  # bytes compressed at once: short enough that the dictionary counts everywhere


class Model:
    """Two dictionaries, and the weights of the calibration (of difference, length and 1)."""

    def __init__(self, good: bytes, bad: bytes, level: int = 3, weights=(0.0, 0.0, 0.0)):
        self.good, self.bad, self.level, self.weights = good, bad, level, np.asarray(weights, dtype=float)

    def differences(self, texts) -> np.ndarray:
        """(size with the bad dictionary - size with the good one) / bytes, 0 for an empty text."""
        import zstandard

        def compressor(raw: bytes):
            trained = raw[:4] == b"\x37\xa4\x30\xec"
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=self.level)
            return zstandard.ZstdCompressor(level=self.level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress

        out = np.zeros(len(texts))
        if not self.good or not self.bad:
            return out
        good, bad = compressor(self.good), compressor(self.bad)
        for i, text in enumerate(texts):
            if text:
                view = memoryview(text)
                gain = 0
                for at in range(0, len(text), PIECE):
                    piece = view[at : at + PIECE]
                    gain += len(bad(piece)) - len(good(piece))
                out[i] = gain / len(text)
        return out

    def scores(self, texts) -> np.ndarray:
        x = evidence(self.differences(texts), np.array([len(t) if t else 0 for t in texts]))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -50, 50)))


def evidence(differences: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Inputs of the calibration: a difference counts the less, the shorter its text, down to the base rate."""
    trust = lengths / (lengths + SHORT)
    return np.stack([differences * trust, trust, np.ones(len(trust))], axis=1)


def build_dictionary(texts: list[bytes], size: int, budget: int) -> bytes:
    """A trained dictionary of pieces of the texts (at most ``budget`` bytes of them), every text a bit at a time."""
    import zstandard

    pieces, total, k = [], 0, 0
    while total < budget:
        more = [t[k : k + PIECE] for t in texts if len(t) > k]
        if not more:
            break
        for p in more:
            if total < budget:
                pieces.append(p)
                total += len(p)
        k += PIECE
    try:
        return zstandard.train_dictionary(min(size, max(256, total // 8)), pieces).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself serves
        return b"".join(pieces)[-size:]


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-3) -> np.ndarray:
    """Weights of P(y = 1) over the columns of x, the last of which is 1, by Newton's method."""
    if not len(x) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return np.r_[np.zeros(max(2, x.shape[1] - 1 if x.ndim == 2 else 2)), np.log(share / (1 - share))]
    scale = np.abs(x).max(axis=0)
    scale[scale == 0] = 1
    a, w = x / scale, np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w / scale


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, label_col: str = "quality", max_texts: int = 2500, max_calibration: int = 6000, max_bytes: int = 1 << 18, size: int = 112_640, budget: int = 6_000_000, read_bytes: int = 48 << 20) -> Model:
    """Fit on bounded samples of labelled rows outside the held-out fold, in hash order of their ids.

    At most ``max_texts`` texts of each label, of at most ``max_bytes`` each and ``read_bytes`` in all,
    build the dictionaries from ``budget`` bytes of each (copies once); at most ``max_calibration``
    other rows calibrate.  With texts of one label only, every score is the share of good labels.  Ids
    may have any type; those of the labels are read as the documents'.  Null ids and labels teach
    nothing; of several labels of an id, the lowest counts.
    """
    kind = docs.schema["doc_id"].dataType
    labels = labels.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    seen = labels.where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out("doc_id", folds, fold)).groupBy("doc_id").agg(F.min("y").alias("y"))
    share = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2))
    rank = F.xxhash64("doc_id")

    def sample(where, n):
        return {r[0]: int(r[1] == 1) for r in seen.where(where).select("doc_id", "y").orderBy(rank, "doc_id").limit(n).collect()}

    good, bad, other = sample((share == 0) & (F.col("y") == 1), max_texts), sample((share == 0) & (F.col("y") != 1), max_texts), sample(share == 1, max_calibration)
    label = good | bad

    model = Model(b"", b"")
    if label:
        by_turn = sorted([(k / len(x), i) for x in (good, bad) for k, i in enumerate(x)], key=lambda t: t[0])
        got = texts_of(docs, [i for _, i in by_turn], max_bytes, read_bytes).collect()  # at most read_bytes
        first = {}
        for r in got:
            key = (label[r.doc_id], bytes(r.raw))
            first[key] = min(first.get(key, r.doc_id), r.doc_id)
        kinds = [[raw for (y, raw), _ in sorted(first.items(), key=lambda kv: (kv[1], kv[0])) if y == want] for want in (1, 0)]
        if all(kinds):
            model = Model(*(build_dictionary(k, size, budget) for k in kinds))
    if not other:
        other = label
    if other:
        fresh = Model(model.good, model.bad)

        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fresh.differences(raw := batch.column(1).to_pylist())), pa.array([len(t) for t in raw], pa.int64())], names=["doc_id", "d", "n"])

        got = texts_of(docs, list(other), max_bytes, 1 << 28).mapInArrow(run, f"doc_id {kind.simpleString()}, d double, n long").toArrow()  # three numbers a row
        y = np.array([other[i] for i in got.column("doc_id").to_pylist()], dtype=float)
        d, n = (got.column(c).to_numpy().astype(float) for c in ("d", "n"))
        order = np.lexsort((n, y, d))  # the same sums whatever order the rows came in
        model.weights = fit_logistic(evidence(d[order], n[order]), y[order])
    return model


def with_score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "_score") -> DataFrame:
    """The rows of ``docs`` with all their columns and the score of each."""

    def run(batches):
        for batch in batches:
            texts = batch.column(text_col).cast(pa.binary()).to_pylist()
            yield batch.append_column(name, pa.array(model.scores(texts)))

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, score)`` of each row's whole text, 0 to 1; null texts score as empty ones.

    Rows keep their count, whatever repeats; ids may be null and of any type; texts of any length are
    compressed a piece at a time; no other column is read.
    """

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1).to_pylist()))], names=[id_col, "score"])

    slim = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, score double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row; see ``train`` and ``score``."""
    out = score(docs, train(docs, labels))
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
