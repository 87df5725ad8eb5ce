"""Toxicity by non-negative positive-unlabelled learning.

The learner sees confirmed toxic texts (P) and a sample of other texts without labels (U), some of
which are toxic too.  With the class prior ``pi`` the risk of a linear model g is

    pi * R_P(g, +1) + max(0, R_U(g, -1) - pi * R_P(g, -1))

with the logistic loss; where the second term turns negative, the step climbs out of it instead (the
non-negative correction that keeps the model from overfitting U).  Features are the presence of
words and word beginnings of three to six letters, hashed, in numpy over whole batches of texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import first_ids, texts_of

BITS = 20
LENGTHS = (3, 4, 5, 6)
PART = 1 << 20  # characters whose words are held at once: the arrays of their words take about 45 times as many bytes
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
_ALNUM: list[np.ndarray] = []


def _letters(codes: np.ndarray) -> np.ndarray:
    if not _ALNUM:
        _ALNUM.append(np.array([chr(c).isalnum() for c in range(0x10000)] + [True]))
    return _ALNUM[0][np.minimum(codes, 0x10000)]


def words_of(texts: list[str]):
    """Hashes of lower-cased words and of their beginnings.

    Returns (owner, feats, word): the text of each word, an array [words, len(LENGTHS) + 1] of
    feature ids (the last column is the whole word; shorter words repeat it), and a 64-bit hash.
    """
    flat = "\n".join(t.lower() for t in texts) + "\n"
    codes = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.array([len(t.lower()) for t in texts], dtype=np.int64)
    inside = np.r_[False, _letters(codes), False]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    lo, hi = edge[::2], edge[1::2]
    power = np.cumprod(np.full(len(codes) + 1, _BASE, dtype=np.uint64))
    total = np.r_[np.uint64(0), np.cumsum(codes.astype(np.uint64) * power[:-1])]
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    back = np.cumprod(np.full(len(codes) + 1, inverse, dtype=np.uint64))[lo]

    def upto(end, salt):
        h = (total[end] - total[lo]) * back
        h = (h ^ (h >> np.uint64(29)) ^ np.uint64(salt)) * _MUL
        return h ^ (h >> np.uint64(32))

    word = upto(hi, 99)
    feats = np.empty((len(lo), len(LENGTHS) + 1), dtype=np.int32)
    whole = (word >> np.uint64(64 - BITS)).astype(np.int32)
    for k, n in enumerate(LENGTHS):
        ok = hi - lo >= n
        feats[:, k] = np.where(ok, (upto(np.minimum(lo + n, hi), n) >> np.uint64(64 - BITS)).astype(np.int32), whole)
    feats[:, -1] = whole
    owner = np.searchsorted(np.cumsum(lengths + 1), lo, side="right")
    return owner, feats, word


def _per_text(texts: list[str]):
    """Per text its distinct feature ids (sorted), and two sketches of its five-word shingles."""
    owner, feats, word = words_of(texts)
    flat = np.unique((owner[:, None] << BITS | feats).ravel())
    ids, own = (flat & ((1 << BITS) - 1)).astype(np.int32), flat >> BITS
    shingle = word.copy()
    for k in range(1, 5):
        shingle[: len(word) - k] = shingle[: len(word) - k] * _BASE + word[k:]
    same = np.r_[owner[4:] == owner[:-4], np.zeros(min(4, len(owner)), bool)] if len(owner) > 4 else np.zeros(len(owner), bool)
    low = np.full((len(texts), 2), np.iinfo(np.int64).max)
    for k, salt in enumerate((1, 2)):
        h = ((shingle ^ np.uint64(salt)) * _MUL >> np.uint64(1)).astype(np.int64)
        np.minimum.at(low[:, k], owner[same], h[same])
    return np.split(ids, np.searchsorted(own, np.arange(1, len(texts)))), low


def held_out(id_col: str, folds: int, fold: int):
    """True where crc32 of the id as text leaves ``fold``; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


class Model:
    """A sparse linear model over hashed features; ``bias`` is the score of a text without any."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, bias: float):
        self.ids, self.weights, self.bias = ids.astype(np.int32), weights.astype(np.float32), float(bias)

    def long_score(self, text: str) -> float:
        """Score of one text of any length: a part at a time, cut between words."""
        text = text.lower()
        hits: set[int] = set()
        at = 0
        while at < len(text):
            end = at + PART
            while end < len(text) and text[end].isalnum():
                end += 1
            _, feats, _ = words_of([text[at:end]])
            hits.update(np.intersect1d(feats, self.ids).tolist())
            at = end
        weight = dict(zip(self.ids.tolist(), self.weights.tolist()))
        g = sum((weight[i] for i in sorted(hits)), self.bias)  # added up as in ``scores``
        return float(1 / (1 + np.exp(-np.clip(g, -50, 50))))

    def scores(self, texts: list[str]) -> np.ndarray:
        table = np.zeros(1 << BITS, dtype=np.float32)
        table[self.ids] = self.weights
        g = np.full(len(texts), self.bias)
        owner, feats, _ = words_of(texts)
        hit = table[feats] != 0
        flat = np.unique((np.broadcast_to(owner[:, None], feats.shape)[hit].astype(np.int64) << BITS) | feats[hit])
        np.add.at(g, flat >> BITS, table[flat & ((1 << BITS) - 1)])
        return 1 / (1 + np.exp(-np.clip(g, -50, 50)))


def _distinct(rows: list, sketches: np.ndarray) -> list[int]:
    """Rows whose sketches no earlier row has: copies and near copies count once."""
    seen: set[int] = set()
    kept = []
    for i, pair in enumerate(sketches.tolist()):
        if not (set(pair) & seen) or pair[0] == np.iinfo(np.int64).max:
            kept.append(i)
        seen.update(pair)
    return kept


def fit_nnpu(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, steps: int = 400, rate: float = 0.05, decay: float = 2e-4, beta: float = 0.0, max_features: int = 20_000) -> Model:
    """Train on per-text arrays of distinct feature ids.

    Features: those that at least three positive texts have, more often than unlabelled texts by
    four standard errors and by a factor (a feature of toxic texts alone has the factor 1 / prior; at
    least 2 and 0.35 / prior are asked for).  Adam on the whole sample; no randomness.
    """
    prior = float(min(max(prior, 1e-4), 0.9))
    if not pos or not unl:
        return Model(np.zeros(0, np.int32), np.zeros(0), -8.0)
    dp, du = np.zeros(1 << BITS, dtype=np.int64), np.zeros(1 << BITS, dtype=np.int64)
    for count, rows in ((dp, pos), (du, unl)):
        for r in rows:  # a text has each feature once
            count[r] += 1
    fp, fu = dp / len(pos), du / len(unl)
    error = np.sqrt((fu + 1 / len(unl)) / len(pos) + (fu + 1 / len(unl)) / len(unl))
    z = (fp - fu) / error
    good = np.flatnonzero((dp >= 3) & (fp > max(2.0, 0.35 / prior) * fu) & (z > 4))
    good = np.sort(good[np.argsort(-z[good], kind="stable")][:max_features])
    column = np.full(1 << BITS, -1, dtype=np.int32)
    column[good] = np.arange(len(good))

    def sparse(rows):
        c = [x[x >= 0] for x in map(column.__getitem__, rows)]
        return np.concatenate(c) if c else np.zeros(0, np.int64), np.repeat(np.arange(len(rows)), [len(x) for x in c])

    (cp, rp), (cu, ru) = sparse(pos), sparse(unl)
    w = np.zeros(len(good) + 1)  # the last is the bias
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))

    def back(c, r, d):
        return np.r_[np.bincount(c, weights=d[r], minlength=len(good)), d.sum()]

    for t in range(1, steps + 1):
        gp = np.bincount(rp, weights=w[cp], minlength=len(pos)) + w[-1]
        gu = np.bincount(ru, weights=w[cu], minlength=len(unl)) + w[-1]
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        rest = back(cu, ru, sig(gu) / len(unl)) - prior * back(cp, rp, sig(gp) / len(pos))
        if negative < -beta:
            grad = -rest
        else:
            grad = prior * back(cp, rp, -sig(-gp) / len(pos)) + rest
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    keep = np.abs(w[:-1]) > 1e-3
    return Model(good[keep], w[:-1][keep], w[-1])


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, label_col: str = "toxic", max_positive: int = 3000, max_unlabelled: int = 9000, max_bytes: int = 1 << 20, budget: int = 128 << 20) -> Model:
    """Fit on a bounded sample of rows outside the held-out fold.

    At most ``max_positive`` labelled toxic texts and ``max_unlabelled`` other texts (by the hash
    order of their ids) of at most ``max_bytes`` each and ``budget`` bytes in all are read for the
    fit, copies once.  The prior is the share of toxic labels outside the held-out fold.  Ids may have
    any type; those of the labels are read as the documents'.  Null ids and labels teach nothing;
    with no toxic label the model finds nothing toxic.
    """
    kind = docs.schema["doc_id"].dataType
    labels = labels.select(F.col("doc_id").cast(kind).alias("doc_id"), label_col)
    seen = labels.where(F.col("doc_id").isNotNull() & ~held_out("doc_id", folds, fold))
    n, toxic = seen.agg(F.count(label_col), F.coalesce(F.sum((F.col(label_col) == 1).cast("int")), F.lit(0))).first()
    pos = first_ids(seen.where(F.col(label_col) == 1).select("doc_id"), max_positive)
    unl = first_ids(docs.where(F.col("doc_id").isNotNull() & ~held_out("doc_id", folds, fold)).select("doc_id"), max_unlabelled)
    if not pos or not unl:
        return Model(np.zeros(0, np.int32), np.zeros(0), -8.0)
    # confirmed and unlabelled texts in turn, so that a budget that runs out leaves some of both
    by_turn = sorted([(k / len(pos), i) for k, i in enumerate(pos)] + [(k / len(unl), i) for k, i in enumerate(unl)], key=lambda t: t[0])
    text = texts_of(docs, list(dict.fromkeys(i for _, i in by_turn)), max_bytes, budget, least=0).select("doc_id", F.col("raw").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for lo, texts in in_parts(batch.column(1)):
                feats, low = _per_text(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), pa.array(feats, pa.list_(pa.int32())), pa.array(low[:, 0]), pa.array(low[:, 1])], names=["doc_id", "feats", "s1", "s2"])

    got = text.mapInArrow(run, f"doc_id {kind.simpleString()}, feats array<int>, s1 long, s2 long").toArrow().sort_by([("doc_id", "ascending"), ("s1", "ascending"), ("s2", "ascending")])
    ids = got.column("doc_id").to_pylist()
    flat, ends = got.column("feats").combine_chunks(), None
    flat, ends = flat.flatten().to_numpy(), flat.offsets.to_numpy()
    sketches = np.stack([got.column("s1").to_numpy(), got.column("s2").to_numpy()], axis=1)

    def rows(chosen):
        mine = set(chosen)
        at = np.array([i for i, d in enumerate(ids) if d in mine], dtype=np.int64)
        at = at[_distinct(at.tolist(), sketches[at])]
        return [flat[ends[i] : ends[i + 1]] for i in at]

    return fit_nnpu(rows(pos), rows(unl), toxic / n if n else 0.0)


def in_parts(column: pa.Array):
    """(first row, texts) of a column, a null as an empty text: runs of rows of at most ``PART`` bytes, or one row of more."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(), dtype=np.int64)
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PART, side="right")))
        yield lo, [t or "" for t in column.slice(lo, hi - lo).to_pylist()]
        lo = hi


def text_scores(model: Model, texts: list[str]) -> np.ndarray:
    """Scores of texts, about ``PART`` characters at a time."""
    out = np.zeros(len(texts))
    group, size = [], 0
    for i, t in enumerate([*texts, None]):
        if t is None or size + len(t) > PART:
            out[group] = model.scores([texts[k] for k in group]) if group else 0
            group, size = [], 0
        if t is not None and len(t) > PART:
            out[i] = model.long_score(t)
        elif t is not None:
            group.append(i)
            size += len(t)
    return out


def column_scores(model: Model, column: pa.Array) -> pa.Array:
    """Scores of a column of texts, of which a part at a time is in Python's own strings."""
    return pa.array(np.concatenate([np.zeros(0), *(text_scores(model, texts) for _, texts in in_parts(column))]))


def with_score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "_score") -> DataFrame:
    """The rows of ``docs`` with all their columns and the score of each."""

    def run(batches):
        for batch in batches:
            yield batch.append_column(name, column_scores(model, batch.column(text_col)))

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, score)`` of each row's whole text, 0 to 1; null texts score as empty ones.

    Rows keep their count, whatever repeats; ids may be null and of any type; very long texts are
    scored in parts, with the same score as in one; no other column is read.
    """

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), column_scores(model, batch.column(1))], names=[id_col, "score"])

    slim = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row; see ``train`` and ``score``."""
    out = score(docs, train(docs, labels))
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
