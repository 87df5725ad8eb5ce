"""Scoring by coefficient tables, chained decisions, policies, routing and explanation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import renormalise, sigmoid
from ..sources.shared import kept
from .aggregates import exact_percentiles

CLASSES = ("band", "wrap", "left", "right")
# Floors of the plain policy, and the bins of each (variety, class); 9 is review.
FLOOR_TREE, FLOOR_FLAT, REVIEW = 0.60, 0.90, 9
BIN_ROWS = tuple((v, c, 4 * k + i + 1) for k, v in enumerate(("north", "south")) for i, c in enumerate(CLASSES))


def impute_scale(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` with ``z_<name>``: nulls become the median, then centred by the mean and divided by the population deviation.

    Medians are exact; both statistics are one row each and are broadcast.  A constant column gives 0.
    """
    slim = kept(df.select(*names))  # medians and moments read it, the rows' other columns do not
    long = slim.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in names])).alias("e")).select("e.*")
    mids = exact_percentiles(long, ["name"], "v", [0.5])
    med = mids.agg(*[F.max(F.when(F.col("name") == c, F.get("q", F.lit(0)))).alias(f"_m_{c}") for c in names])
    filled = lambda d: d.crossJoin(F.broadcast(med)).withColumns({f"_f_{c}": F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")) for c in names})
    full = filled(df)
    stats = filled(slim).agg(*[x for c in names for x in (F.avg(f"_f_{c}").alias(f"_a_{c}"), F.stddev_pop(f"_f_{c}").alias(f"_d_{c}"))])
    out = full.crossJoin(F.broadcast(stats)).withColumns({f"z_{c}": F.when(F.col(f"_d_{c}") > 0, (F.col(f"_f_{c}") - F.col(f"_a_{c}")) / F.nullif(F.col(f"_d_{c}"), F.lit(0.0))).otherwise(0.0) for c in names})
    return out.select(*df.columns, *[f"z_{c}" for c in names])


def linear(coefficients: dict[str, float], intercept: float) -> Column:
    """The linear score of a coefficient table."""
    z = F.lit(float(intercept))
    for name, w in coefficients.items():
        z = z + float(w) * F.col(name)
    return z


def node(coefficients: dict[str, float], intercept: float) -> Column:
    return sigmoid(linear(coefficients, intercept))


def chained(p_band: str, p_wrap: str, p_left: str) -> dict[str, Column]:
    """The chained decision: class and confidence along the branches taken.

    The first two questions need over one half (exactly one half says no); the third takes the
    larger side, left on a tie.
    """
    b, w, x = F.col(p_band), F.col(p_wrap), F.col(p_left)
    side, sure = F.when(x >= 1 - x, "left").otherwise("right"), F.greatest(x, 1 - x)
    label = F.when(b > 0.5, "band").when(w > 0.5, "wrap").otherwise(side)
    conf = F.when(b > 0.5, b).when(w > 0.5, (1 - b) * w).otherwise((1 - b) * (1 - w) * sure)
    return {"label": label, "conf": conf}


def soft_chain(p_band: str, p_wrap: str, p_left: str) -> Column:
    """Probabilities of all classes, in the order of ``CLASSES``."""
    b, w, x = F.col(p_band), F.col(p_wrap), F.col(p_left)
    rest = (1 - b) * (1 - w)
    return F.array(b, (1 - b) * w, rest * x, rest * (1 - x))


def second_best(probabilities: str, winner: str) -> Column:
    """The most probable class but the winner (the earlier on a tie)."""
    pairs = F.transform(F.col(probabilities), lambda p, i: F.struct((-p).alias("p"), i.alias("i"), F.element_at(F.array(*map(F.lit, CLASSES)), i + 1).alias("c")))
    return F.get(F.array_sort(F.filter(pairs, lambda e: e["c"] != F.col(winner))), 0)["c"]


def grid(p_without: str, p_wrap_if_without: str, p_left_if_with: str) -> dict[str, Column]:
    """Two questions, the second by the first's answer: probabilities and the branch (a tie is 'without')."""
    s, w, x = F.col(p_without), F.col(p_wrap_if_without), F.col(p_left_if_with)
    return {"p_band": s * (1 - w), "p_wrap": s * w, "p_left": (1 - s) * x, "p_right": (1 - s) * (1 - x), "branch": F.when(s >= 1 - s, "without").otherwise("with")}


def zero_rule(probabilities: str, left: str, right: str) -> Column:
    """No damage on either side rules both side classes out; if nothing is left, all stays as it was."""
    none = (F.col(left) == 0) & (F.col(right) == 0)
    p = F.col(probabilities)
    ruled = F.transform(p, lambda x, i: F.when(i >= 2, 0.0).otherwise(x))
    return F.when(F.coalesce(none, F.lit(False)), renormalise(ruled, p)).otherwise(p)


def plain_policy(conf: str, label: str, floor: float = FLOOR_TREE, own: dict[str, float] | None = None) -> dict[str, Column]:
    """Accept from a floor on, some classes from one of their own; a rejected one of those is a veto."""
    own = own or {}
    bar = F.lit(floor)
    for name, value in own.items():
        bar = F.when(F.col(label) == name, F.lit(value)).otherwise(bar)
    accept = F.coalesce(F.col(conf) >= bar, F.lit(False))
    return {"accept": accept, "veto": ~accept & F.col(label).isin(*own) if own else F.lit(False)}


def prudent_policy(acc_variety: str, acc_class: str, ceiling: str, threshold: float = 0.90, margin: float = 0.04) -> dict[str, Column]:
    """Accept if both measured accuracies together hold the bar (unknown: reject); veto classes that never reach it."""
    bar = threshold + margin
    veto = F.coalesce(F.col(ceiling) < bar, F.lit(False))
    accept = F.coalesce(F.col(acc_variety) * F.col(acc_class) >= bar, F.lit(False)) & ~veto
    return {"accept": accept, "veto": veto}


def bins_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BIN_ROWS), "variety string, label string, bin int")


def route(df: DataFrame, bins: DataFrame, variety: str, label: str, accept: str) -> DataFrame:
    """``df`` with ``bin``: that of (variety, class) if accepted and known, else review."""
    table = F.broadcast(bins.select(F.col("variety").alias("_v"), F.col("label").alias("_l"), F.col("bin").alias("_bin")))  # one row per class and variety
    out = df.join(table, (F.col(variety) == F.col("_v")) & (F.col(label) == F.col("_l")), "left")
    return out.withColumn("bin", F.when(F.col(accept), F.coalesce("_bin", F.lit(REVIEW))).otherwise(REVIEW).cast("int")).drop("_v", "_l", "_bin")


def contributions(names: list[str], weights: dict[str, float], sign: Column | None = None, top: int = 6) -> Column:
    """The ``top`` terms w * z by absolute value, the earlier name on ties: array of (feature, value).

    ``sign`` turns a two-class model towards the winner.
    """
    turn = F.lit(1.0) if sign is None else sign
    terms = F.array(*[F.struct((-F.abs(w * F.col(f"z_{n}"))).alias("k"), F.lit(n).alias("feature"), (turn * w * F.col(f"z_{n}")).alias("value")) for n, w in ((n, float(weights[n])) for n in names)])
    return F.transform(F.slice(F.array_sort(terms), 1, top), lambda e: F.struct(e["feature"].alias("feature"), e["value"].alias("value")))


def evidence(rules: list[tuple[Column, str, list[Column]]]) -> Column:
    """Sentences of the rules that hold, in order: (condition, format, arguments)."""
    return F.array_compact(F.array(*[F.when(cond, F.format_string(text, *args)) for cond, text, args in rules]))


def outcome(truth_bin: str, bin_: str) -> Column:
    """NO_LABEL without a true bin, SPECIAL for review, else HIT or ERROR."""
    return F.when(F.coalesce(F.col(truth_bin), F.lit(0)) == 0, "NO_LABEL").when(F.col(bin_) == REVIEW, "SPECIAL").when(F.col(truth_bin) == F.col(bin_), "HIT").otherwise("ERROR")


def acceptance(spark: SparkSession, measured: DataFrame, expected: list[tuple[str, float, float]]) -> DataFrame:
    """(name, expected, measured, ok): each expected figure against the measured one within its tolerance; absent fails."""
    want = spark.createDataFrame(expected, "name string, expected double, tolerance double")
    out = F.broadcast(want).join(measured.select("name", F.col("value").alias("measured")), "name", "left")
    return out.select("name", "expected", "measured", F.coalesce(F.abs(F.col("measured") - F.col("expected")) <= F.col("tolerance"), F.lit(False)).alias("ok"))
