"""Learning: node models as coefficient tables, out-of-fold scores, calibrators, bootstrap.

A fitted model is a small table of medians, means, deviations and weights, so scoring is a projection.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import logit, sigmoid
from .aggregates import exact_percentiles
from .ordered import running


@dataclass
class LinearModel:
    """Impute, scale, weigh: a logistic node."""

    names: list[str]
    median: dict[str, float] = field(default_factory=dict)
    mean: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)
    weight: dict[str, float] = field(default_factory=dict)
    intercept: float = 0.0

    def z(self, name: str) -> Column:
        x = F.coalesce(F.col(name).cast("double"), F.lit(self.median[name]))
        return (x - self.mean[name]) / self.scale[name] if self.scale[name] > 0 else F.lit(0.0)

    def probability(self) -> Column:
        total = F.lit(self.intercept)
        for n in self.names:
            total = total + self.weight[n] * self.z(n)
        return sigmoid(total)

    def table(self, spark) -> DataFrame:
        rows = [(n, self.median[n], self.mean[n], self.scale[n], self.weight[n]) for n in self.names] + [("(intercept)", None, None, None, self.intercept)]
        return spark.createDataFrame(rows, "feature string, median double, mean double, scale double, weight double")


def fit_logistic(df: DataFrame, names: list[str], label: str, balanced: bool = True, iterations: int = 200) -> LinearModel:
    """L2 logistic regression on median-imputed, standardised features, classes weighted to equal totals.

    The penalty is that of a unit inverse strength on summed losses: 1 / (sum of weights) on Spark's
    mean loss.  Columns without any value are dropped.  With one class, or no rows, the model is constant.
    """
    rows = df.where(F.col(label).isNotNull())
    n, p = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col(label) == 1).cast("int")), F.lit(0))).first()
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in names])).alias("e")).select("e.*")
    mids = {r["name"]: float(r["q"][0]) for r in exact_percentiles(long, ["name"], "v", [0.5]).collect()}  # one row per feature
    model = LinearModel([c for c in names if c in mids], {c: mids[c] for c in names if c in mids})
    full = rows.select(F.col(label).cast("double").alias("_y"), *[F.coalesce(F.col(c).cast("double"), F.lit(model.median[c])).alias(c) for c in model.names])
    if not model.names or p in (0, n):
        model.mean = model.scale = model.weight = {c: 0.0 for c in model.names}
        share = (p + 0.5) / (n + 1)
        model.intercept = math.log(share / (1 - share))
        return model
    moments = full.agg(*[x for c in model.names for x in (F.avg(c).alias(f"a_{c}"), F.stddev_pop(c).alias(f"d_{c}"))]).first()
    model.mean, model.scale = {c: moments[f"a_{c}"] for c in model.names}, {c: moments[f"d_{c}"] for c in model.names}
    w = F.when(F.col("_y") == 1, n / (2 * p)).otherwise(n / (2 * (n - p))) if balanced else F.lit(1.0)
    ready = full.select("_y", w.alias("_w"), *[((F.col(c) - model.mean[c]) / model.scale[c] if model.scale[c] > 0 else F.lit(0.0)).alias(c) for c in model.names])
    vectors = VectorAssembler(inputCols=model.names, outputCol="_x").transform(ready)
    fit = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=iterations, tol=1e-9).fit(vectors)
    model.weight = dict(zip(model.names, (float(v) for v in fit.coefficients)))
    model.intercept = float(fit.intercept)
    return model


def fit_nodes(df: DataFrame, names: dict[str, list[str]], label: str = "truth") -> dict[str, LinearModel]:
    """Three nodes of the chain: band against the rest; wrap against sides, bands excluded; left against right."""
    c = F.col(label)
    return {
        "p_band": fit_logistic(df.where(c.isNotNull()).withColumn("_t", (c == "band").cast("int")), names["p_band"], "_t"),
        "p_wrap": fit_logistic(df.where(c.isin("wrap", "left", "right")).withColumn("_t", (c == "wrap").cast("int")), names["p_wrap"], "_t"),
        "p_left": fit_logistic(df.where(c.isin("left", "right")).withColumn("_t", (c == "left").cast("int")), names["p_left"], "_t"),
    }


def score_nodes(df: DataFrame, nodes: dict[str, LinearModel]) -> DataFrame:
    return df.withColumns({k: m.probability() for k, m in nodes.items()})


def out_of_fold(df: DataFrame, fold: str, folds: int, fit: Callable[[DataFrame], object], score: Callable[[DataFrame, object], DataFrame]) -> DataFrame:
    """Every row scored by the model of the other folds.  Each fold is one job; rows never move between folds."""
    out = None
    for k in range(folds):
        part = score(df.where(F.col(fold) == k), fit(df.where(F.col(fold) != k)))
        out = part if out is None else out.unionByName(part)
    return out


def nested_calibration(df: DataFrame, fold: str, folds: int, fit: Callable[[DataFrame], object], score: Callable[[DataFrame, object], DataFrame], calibrate: Callable[[DataFrame], Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Every row scored and calibrated by what never saw it.

    For each outer fold the other folds are scored out of fold among themselves, ``calibrate`` learns
    from that, and the model of all of them scores the outer fold.
    """
    out = None
    for k in range(folds):
        train, test = df.where(F.col(fold) != k), df.where(F.col(fold) == k)
        inner = None
        for j in range(folds):
            if j != k:
                part = score(train.where(F.col(fold) == j), fit(train.where(F.col(fold) != j)))
                inner = part if inner is None else inner.unionByName(part)
        part = calibrate(inner)(score(test, fit(train)))
        out = part if out is None else out.unionByName(part)
    return out


def dealt_group_folds(df: DataFrame, group: str, label: str, k: int) -> DataFrame:
    """(group, fold): within each stratum (a group's most frequent class, the least of equals) groups are dealt over the folds.

    Larger groups are dealt first, equals by the MD5 of their key, in turns that go back and forth
    (0 to k - 1, then k - 1 to 0), each stratum beginning one fold on, so every class is spread evenly
    whatever the number of groups; ranks are taken in ranges of the order (``running``), never in one task.
    """
    per = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n")).groupBy(group).agg(F.sum("n").alias("_n"), F.min_by(label, F.struct((-F.col("n")).alias("a"), F.col(label).alias("b"))).alias("_s"))
    strata = [r[0] for r in per.select("_s").distinct().orderBy(F.col("_s").cast("string").asc_nulls_first()).collect()]  # as many as there are classes
    out = None
    for i, s in enumerate(strata):
        mine = per.where(F.col("_s").eqNullSafe(F.lit(s))).select(group, F.col("_n").cast("double").alias("_n"), F.md5(F.col(group).cast("string")).alias("_h"))
        ranked = running(mine, "_n", [], ties=("_h", group), ascending=False)
        at, turn = F.pmod(F.col("rank") - 1, F.lit(k)), F.pmod(F.floor((F.col("rank") - 1) / k), F.lit(2))
        part = ranked.select(group, F.pmod(F.when(turn == 0, at).otherwise(k - 1 - at) + i, F.lit(k)).cast("int").alias("fold"))
        out = part if out is None else out.unionByName(part)
    return df.select(group, F.lit(0).alias("fold")).limit(0) if out is None else out


def stratified_group_folds(df: DataFrame, group: str, label: str, k: int, most: int = 100_000) -> DataFrame:
    """(group, fold): groups dealt greedily, the most uneven first, each to the fold where classes stay most even.

    The greedy rule needs all groups' class counts on the driver: up to ``most`` groups.  Beyond that
    many, ``dealt_group_folds`` keeps the classes even.
    """
    counts = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n")).groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct(label, "n"))).alias("c"))
    rows = counts.limit(most + 1).collect()
    if len(rows) > most:
        return dealt_group_folds(df, group, label, k)
    labels = sorted({x for r in rows for x in r["c"]}, key=str)
    total = {x: sum(r["c"].get(x, 0) for r in rows) for x in labels}
    load = [dict.fromkeys(labels, 0) for _ in range(k)]

    def spread(values):
        m = sum(values) / len(values)
        return sum((v - m) ** 2 for v in values)

    placed = []
    for r in sorted(rows, key=lambda r: (-spread([r["c"].get(x, 0) for x in labels]), str(r[group]))):
        def cost(f, r=r):
            return (sum(spread([(load[g][x] + (r["c"].get(x, 0) if g == f else 0)) / total[x] for g in range(k)]) for x in labels), sum(load[f].values()), f)

        best = min(range(k), key=cost)
        for x in labels:
            load[best][x] += r["c"].get(x, 0)
        placed.append((r[group], best))
    return df.sparkSession.createDataFrame(placed, f"`{group}` {dict(df.dtypes)[group]}, fold int") if placed else counts.select(group, F.lit(0).alias("fold"))


def isotonic(measured: DataFrame, conf: str, ok: str) -> tuple[list[float], list[float]]:
    """Knots of the non-decreasing calibrator, values held within 0 and 1."""
    m = IsotonicRegression(featuresCol=conf, labelCol="_y", isotonic=True).fit(measured.select(F.col(conf).cast("double").alias(conf), F.col(ok).cast("double").alias("_y")))
    return [float(x) for x in m.boundaries], [min(max(float(x), 0.0), 1.0) for x in m.predictions]


def interpolated(conf: str, knots: tuple[list[float], list[float]]) -> Column:
    """The value of a piecewise linear function, constant beyond its knots."""
    xs, ys = knots
    t = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in zip(xs, ys)])
    c = F.col(conf)
    low = F.filter(t, lambda p: p["x"] <= c)
    high = F.filter(t, lambda p: p["x"] > c)
    a, b = F.get(low, F.size(low) - 1), F.get(high, F.lit(0))
    line = a["y"] + (b["y"] - a["y"]) * (c - a["x"]) / F.nullif(b["x"] - a["x"], F.lit(0.0))
    return F.when(F.size(low) == 0, F.lit(ys[0])).when(F.size(high) == 0, F.lit(ys[-1])).otherwise(line)


def platt(measured: DataFrame, conf: str, ok: str) -> LinearModel:
    """Logistic calibrator on the logit of confidence; constant where all outcomes agree."""
    return fit_logistic(measured.select(logit(conf).alias("_logit"), F.col(ok).cast("int").alias("_ok")), ["_logit"], "_ok", balanced=False)


def by_bins(df: DataFrame, bins: DataFrame, conf: str, name: str) -> DataFrame:
    """The bin calibrator: measured accuracy of the bin, 0 without enough rows."""
    from .calibration import bin_lookup

    return bin_lookup(df, bins, conf, name).withColumn(name, F.coalesce(name, F.lit(0.0)))


def bootstrap(df: DataFrame, outcomes: list[str], samples: int = 2000, seed: int = 0) -> DataFrame:
    """(sample, n, one column per outcome): means of outcomes over resampled rows, paired across outcomes.

    Rows are counted per pattern of their outcomes first (0/1 outcomes have few), so the work is
    patterns times samples, not rows times samples.  A pattern of c rows is drawn a number of times
    that has mean and variance c, as a Poisson(1) draw of each of its rows has in sum: round half to
    even of c + sqrt(c) * z, at least 0, where z is the standardised sum of ten twelve-bit numbers of
    the MD5 of seed, pattern and sample.
    """
    per = df.groupBy(*outcomes).agg(F.count(F.lit(1)).cast("double").alias("_c"))
    name = F.concat_ws(",", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("int").cast("string"), F.lit("-")) for c in outcomes], F.col("sample").cast("string"))
    each = per.select(*[F.col(c).cast("double").alias(c) for c in outcomes], "_c", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample")).withColumn("_h", F.md5(name))
    total = sum((F.conv(F.substring("_h", 3 * k + 1, 3), 16, 10).cast("double") for k in range(10)), F.lit(0.0))
    z = (total / 4096.0 - (10 * 4095 / 8192.0)) / math.sqrt(10 / 12)
    drawn = each.withColumn("_t", F.greatest(F.bround(F.col("_c") + F.sqrt("_c") * z, 0), F.lit(0.0)))
    return drawn.groupBy("sample").agg(F.sum("_t").cast("long").alias("n"), *[F.try_divide(F.sum(F.col("_t") * F.coalesce(F.col(c), F.lit(0.0))), F.sum("_t")).alias(c) for c in outcomes])


def interval(samples: DataFrame, value: Column, name: str = "value") -> DataFrame:
    """(low, high, mean) at 95 % of a statistic over bootstrap samples."""
    s = samples.select(value.alias(name)).where(F.col(name).isNotNull())
    return s.agg(F.percentile(name, 0.025).alias("low"), F.percentile(name, 0.975).alias("high"), F.avg(name).alias("mean"))


def choose_family(measured: dict[str, tuple[float, float]], noise: float = 3.5, forced: str | None = None) -> str:
    """Of families with (accuracy in points, calibration error): the more accurate if apart by the noise, else the better calibrated."""
    if forced:
        return forced
    (a, (acc_a, ece_a)), (b, (acc_b, ece_b)) = sorted(measured.items())
    if abs(acc_a - acc_b) >= noise:
        return a if acc_a > acc_b else b
    return a if ece_a <= ece_b else b


def boosted(df: DataFrame, names: list[str], label: str, rounds: int = 20, seed: int = 0):
    """Gradient-boosted trees, one against the rest for several classes (labels are 0, 1, ...)."""
    x = VectorAssembler(inputCols=names, outputCol="_x", handleInvalid="keep").transform(df)
    return OneVsRest(classifier=GBTClassifier(featuresCol="_x", maxIter=rounds, seed=seed), featuresCol="_x", labelCol=label).fit(x)


def cross_exam(a: DataFrame, b: DataFrame, fit: Callable, judge: Callable[[DataFrame, object], float]) -> dict[str, float]:
    """Train on one session, examine on the other, both ways."""
    return {"a_to_b": judge(b, fit(a)), "b_to_a": judge(a, fit(b))}


def ablation(sets: dict[str, list[str]], run: Callable[[list[str]], float], background: str | None = None) -> dict[str, float]:
    """The figure of each set of columns; a set of background alone is the control that must lose to every other."""
    figures = {name: run(columns) for name, columns in sets.items()}
    if background is not None and any(v <= figures[background] for k, v in figures.items() if k != background):
        raise ValueError(f"the control {background} explains as much as {', '.join(k for k, v in figures.items() if k != background and v <= figures[background])}")
    return figures


def pooled(runs: list[DataFrame]) -> DataFrame:
    """The decisions of repeated trainings as one table with ``run`` (from 0): figures are taken over all of them."""
    out = None
    for k, d in enumerate(runs):
        part = d.withColumn("run", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def best_of(figures: DataFrame, partition: str, family: str, value: str) -> DataFrame:
    """(partition, family, value) of the better family of each partition (the least name of equals): an optimistic figure, since the examined rows choose."""
    best = F.min_by(F.struct(family, value), F.struct((-F.col(value)).alias("v"), F.col(family)))
    return figures.groupBy(partition).agg(best.alias("_b")).select(partition, F.col(f"_b.{family}").alias(family), F.col(f"_b.{value}").alias(value))
