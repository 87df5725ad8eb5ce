"""From pictures to bins: measures, scores by stored coefficients, decision, policy, route; a failure goes to review.

Measuring is one Arrow stage over pictures; all after it are expressions on its columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import decide
from . import kernels as K
from .learning import LinearModel
from .raster import leaf_mask, measure_pictures, vein_asymmetry


def decide_measured(measured: DataFrame, nodes: dict[str, LinearModel], variety: str, floor: float = decide.FLOOR_TREE) -> DataFrame:
    """``measured`` with the nodes' probabilities, ``label``, ``conf``, ``accept``, ``reason`` and ``bin``.

    ``measured`` has the measures as columns, a ``variety`` column and ``error``; unknown measures are
    imputed by the models.  A row with an error, without a leaf or under the floor goes to review
    with its reason; no row is dropped.
    """
    p = measured.withColumns({k: m.probability() for k, m in nodes.items()})
    chain = decide.chained("p_band", "p_wrap", "p_left")
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(F.coalesce(F.col("area"), F.lit(0.0)) < 200, "no leaf")
    out = p.withColumns({"label": chain["label"], "conf": chain["conf"]}).withColumn("reason", reason)
    out = out.withColumn("accept", F.col("reason").isNull() & decide.plain_policy("conf", "label", floor)["accept"])
    out = out.withColumn("reason", F.coalesce("reason", F.when(~F.col("accept"), F.format_string("confidence %.2f under %.2f", F.col("conf"), F.lit(floor)))))
    return decide.route(out, decide.bins_table(measured.sparkSession), variety, "label", "accept")


def decide_pictures(images: DataFrame, nodes: dict[str, LinearModel], variety: str = "variety", tape: str | None = None, floor: float = decide.FLOOR_TREE) -> DataFrame:
    """The decision on each picture of ``(path, h, w, rgb, variety)``: measured, scored, decided, routed.

    A picture that can't be read or measured is a row with its error, in the review bin.
    """
    # the variety travels beside the pixels: measures come back by path
    sides = images.select("path", F.col(variety).alias("variety"))
    measured = measure_pictures(images, tape).join(sides, "path")
    return decide_measured(measured, nodes, "variety", floor)


def marks_between(marked: np.ndarray, clean: np.ndarray, limit: float = 12.0, least: int = 9) -> np.ndarray:
    """Pixels that a person marked: where two pictures of the same leaf differ in colour by more than ``limit``, in parts of ``least`` pixels."""
    apart = np.sqrt(((K.to_lab(marked) - K.to_lab(clean)) ** 2).sum(axis=2)) > limit
    lab = K.label8(apart)
    size = np.bincount(lab.ravel())
    good = np.flatnonzero(size >= least)
    return np.isin(lab, good[good > 0])


def calibrate_specks(greener: np.ndarray, where: np.ndarray, marks: np.ndarray, limits) -> list[dict]:
    """Of each limit on the greenness: precision, recall and F1 of its pixels against the marked ones (0 where undefined)."""
    out = []
    for limit in limits:
        found, real = (greener > limit) & where, marks & where
        hit = int((found & real).sum())
        p, r = hit / max(1, int(found.sum())), hit / max(1, int(real.sum()))
        out.append({"limit": float(limit), "found": int(found.sum()), "precision": p, "recall": r, "f1": 2 * p * r / (p + r) if hit else 0.0})
    return out


def vein_batch(images: DataFrame, labels: DataFrame, classes: list[str], done: DataFrame | None = None) -> DataFrame:
    """(path, label, vein_asym, error) of the pictures of some classes that are not done yet."""
    todo = images.join(labels.where(F.col("label").isin(*classes)), "path")
    if done is not None:
        todo = todo.join(done.select("path"), "path", "left_anti")
    fields = pa.schema([("path", pa.string()), ("label", pa.string()), ("vein_asym", pa.float64()), ("error", pa.string())])

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                row = {"path": r["path"], "label": r["label"], "vein_asym": None, "error": None}
                try:
                    rgb = np.frombuffer(r["rgb"], np.uint8).reshape(r["h"], r["w"], 3)
                    lab = K.to_lab(rgb)
                    row["vein_asym"] = vein_asymmetry(lab[..., 0], leaf_mask(rgb, lab)[0])
                except Exception as e:  # a picture that fails is a row with its reason
                    row["error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=fields)

    return todo.select("path", "label", "h", "w", "rgb").mapInArrow(run, "path string, label string, vein_asym double, error string")
