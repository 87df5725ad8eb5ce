"""Confidence against measured accuracy: bins, cumulative curves, lookups, sweeps, cuts.

Scored tables have a confidence, a 0/1 outcome and a position that breaks ties.  Curves and bin tables
are small (a bin list, or at most 60 points per curve), so lookups broadcast them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import kept
from .aggregates import exact_percentiles
from .ordered import running

# Bin edges of the two calibration tables, and the supports and margins of the rules.
BINS = (0.0, 0.5, 0.7, 0.85, 0.95, 1.01)
BINS_KEPT = (0.0, 0.5, 0.6, 0.7, 0.8, 0.9, 1.01)
MIN_BIN, MIN_CURVE, MIN_CLASS, POINTS = 10, 20, 25, 60
THRESHOLD, MARGIN, NO_CUT = 0.90, 0.04, 1.01


def bin_of(conf: str, edges: tuple[float, ...]) -> Column:
    """Number of the half-open bin of a confidence; null outside."""
    out = None
    for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        inside = (F.col(conf) >= lo) & (F.col(conf) < hi)
        out = F.when(inside, F.lit(k)) if out is None else out.when(inside, F.lit(k))
    return out


def bin_table(df: DataFrame, conf: str, ok: str, edges: tuple[float, ...] = BINS, least: int = MIN_BIN) -> DataFrame:
    """(bin, lo, hi, n, frac, said, accuracy) of the bins with at least ``least`` rows.

    ``frac`` is the share of all rows; the last upper edge is given as 1 at most.
    """
    per = df.withColumn("bin", bin_of(conf, edges)).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(conf).alias("said"), F.avg(F.col(ok).cast("double")).alias("accuracy"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # over a few bins
    lo, hi = (F.element_at(F.array(*[F.lit(float(e)) for e in x]), F.col("bin") + 1) for x in (edges[:-1], [min(e, 1.0) for e in edges[1:]]))
    out = per.withColumn("_all", total).where(F.col("bin").isNotNull() & (F.col("n") >= least))
    return out.select(F.col("bin").cast("long").alias("bin"), lo.alias("lo"), hi.alias("hi"), "n", (F.col("n") / F.col("_all")).alias("frac"), "said", "accuracy")


def bin_table_all(spark: SparkSession, df: DataFrame, conf: str, ok: str, edges: tuple[float, ...] = BINS_KEPT) -> DataFrame:
    """(lo, hi, n, accuracy) of every bin; accuracy is null in an empty one."""
    frame = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:]))], "bin int, lo double, hi double")
    per = df.withColumn("bin", bin_of(conf, edges)).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(ok).cast("double")).alias("accuracy"))
    return frame.join(per, "bin", "left").select("lo", "hi", F.coalesce("n", F.lit(0)).alias("n"), "accuracy")


def ece(bins: DataFrame) -> DataFrame:
    """Expected calibration error of a bin table: sum of frac * |said - accuracy|."""
    return bins.agg(F.sum(F.col("frac") * F.abs(F.col("said") - F.col("accuracy"))).alias("ece"))


def ece_quantile(df: DataFrame, conf: str, ok: str, bins: int = 10) -> DataFrame:
    """(n_bins, ece) over bins between exact quantiles of the confidence; the outer edges are open.

    Equal edges make empty bins, which don't count.
    """
    df = kept(df.select(conf, ok))
    edges = exact_percentiles(df, [], conf, [k / bins for k in range(1, bins)]).select(F.col("q").alias("_e"))
    place = F.size(F.filter("_e", lambda e: e <= F.col(conf)))
    per = df.crossJoin(F.broadcast(edges)).groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.avg(conf).alias("said"), F.avg(F.col(ok).cast("double")).alias("acc"))
    return per.agg(F.count(F.lit(1)).alias("n_bins"), (F.sum(F.col("n") * F.abs(F.col("said") - F.col("acc"))) / F.sum("n")).alias("ece"))


def _sampled(ranked: DataFrame, total: str, points: int, least: int) -> Column:
    """Whether a rank (from 1) is one of ``points`` evenly spaced from rank min(least, total) to the last."""
    first = F.least(F.lit(least).cast("long"), F.col(total))
    at = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.floor(first - 1 + i * ((F.col(total) - first).cast("double") / (points - 1))) + 1)
    return F.array_contains(at, F.col("rank"))


def cumulative_curve(df: DataFrame, conf: str, ok: str, position: str, points: int = POINTS, least: int = MIN_CURVE) -> DataFrame:
    """(conf, accuracy, coverage): of the rows at least as confident, how many are right and how many they are."""
    ranked = running(df.withColumn("_ok", F.col(ok).cast("long")), conf, ["_ok"], ties=(position,), ascending=False)
    chosen = ranked.where(_sampled(ranked, "total", points, least))
    return chosen.select(F.col(conf).alias("conf"), (F.col("run__ok") / F.col("rank")).alias("accuracy"), (F.col("rank") / F.col("total")).alias("coverage"))


def class_curves(df: DataFrame, label: str, conf: str, ok: str, position: str, support: int = MIN_CLASS, points: int = POINTS, least: int = MIN_CURVE) -> DataFrame:
    """The cumulative curve of each predicted class with enough rows.

    A class is ordered in 256 confidence ranges, so that the window of a large class is many tasks' work.
    """
    low = F.floor(F.col(conf) * 255).cast("int")
    rows = kept(df.select(label, conf, position, (-low).alias("_b"), F.col(ok).cast("long").alias("_ok")))
    totals = rows.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"), F.sum("_ok").alias("_s"))
    before = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    start = totals.select(label, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"), F.sum("_n").over(Window.partitionBy(label)).alias("total"))
    inside = Window.partitionBy(label, "_b").orderBy(F.col(conf).desc(), F.col(position))
    ranked = rows.join(start, [label, "_b"]).where(F.col("total") >= support)
    ranked = ranked.withColumn("rank", F.col("_n0") + F.row_number().over(inside)).withColumn("_run", F.col("_s0") + F.sum("_ok").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    chosen = ranked.where(_sampled(ranked, "total", points, least))
    return chosen.select(F.col(label).alias("label"), F.col(conf).alias("conf"), (F.col("_run") / F.col("rank")).alias("accuracy"), (F.col("rank") / F.col("total")).alias("coverage"))


def curve_of_bins(bins: DataFrame) -> DataFrame:
    """(conf, coverage, accuracy) of a bin table from the top bin down: running shares and hits (a few rows)."""
    w = Window.orderBy(F.desc("lo")).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy(F.desc("lo")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kept = bins.where((F.col("n") > 0) & F.col("accuracy").isNotNull())
    return kept.select(F.col("lo").alias("conf"), (F.sum("n").over(w) / F.sum("n").over(everything)).alias("coverage"), (F.sum(F.col("n") * F.col("accuracy")).over(w) / F.sum("n").over(w)).alias("accuracy"))


def _listed(table: DataFrame, *columns: str) -> DataFrame:
    """A small table as one row with one array, to be broadcast."""
    return F.broadcast(table.agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("_table")))


def bin_lookup(df: DataFrame, bins: DataFrame, conf: str, name: str) -> DataFrame:
    """``df`` with the accuracy of its confidence's bin; 1 and above belong to a bin that ends at 1; null without a bin."""
    c = F.col(conf)
    hit = F.filter("_table", lambda b: ((b["lo"] <= c) & (c < b["hi"])) | ((c >= 1) & (b["hi"] >= 1)))
    return df.crossJoin(_listed(bins, "lo", "hi", "accuracy")).withColumn(name, F.get(hit, 0)["accuracy"]).drop("_table")


def curve_lookup(df: DataFrame, curve: DataFrame, conf: str, name: str) -> DataFrame:
    """``df`` with the accuracy of the curve point of most coverage among those at least as confident.

    A confidence above every point gets the point of full coverage (the last), as the rule has it; an
    empty curve gives null.
    """
    # points sorted by coverage: the last that is confident enough, else the last of all
    above = F.filter("_table", lambda p: p["conf"] >= F.col(conf))
    pick = F.when(F.size(above) > 0, F.get(above, F.size(above) - 1)).otherwise(F.get("_table", F.size("_table") - 1))
    return df.crossJoin(_listed(curve, "coverage", "conf", "accuracy")).withColumn(name, pick["accuracy"]).drop("_table")


def set_cut_lookup(df: DataFrame, measured: DataFrame, conf: str, inside_conf: str, ok: str, position: str, name: str, least: int = MIN_CURVE, margin: float = 0.0, block: int = 256, most: int = 65_536) -> DataFrame:
    """``df`` with the accuracy of all measured rows at least as confident, of at least ``least`` rows.

    The measured rows become one step per distinct confidence, with running counts.  Up to ``most``
    steps go to every task in blocks of ``block``: a row finds its block, then its step.  Beyond that,
    a row finds its place by an ordered union with the steps in confidence ranges.  Neither compares
    all pairs.  A null confidence gets null.
    """
    rows = kept(measured.select(F.col(inside_conf).alias("_c"), F.col(position).alias("_p"), F.col(ok).cast("long").alias("_ok"))).where("_c IS NOT NULL")
    top = rows.orderBy(F.desc("_c"), "_p").limit(least)  # the fewest rows that a figure may rest on
    first = top.agg(F.avg("_ok").alias("_acc0"), F.count(F.lit(1)).alias("_r0")).where("_r0 > 0")
    per = rows.groupBy("_c").agg(F.count(F.lit(1)).alias("_n"), F.sum("_ok").alias("_s"))
    steps = running(per, "_c", ["_n", "_s"], ascending=False).select("_c", F.col("run__n").alias("_r"), F.col("run__s").alias("_s"), "rank", "total")
    steps = kept(steps)
    accuracy = lambda h: F.when(h.isNull() | (h["_r"] < F.col("_r0")), F.col("_acc0")).otherwise(h["_s"] / h["_r"])
    if steps.count() <= most:
        # blocks upwards in confidence; the last step of each is its greatest
        blocks = steps.groupBy(F.floor((F.col("total") - F.col("rank")) / block).alias("_k")).agg(F.array_sort(F.collect_list(F.struct("_c", "_r", "_s"))).alias("e"))
        table = blocks.agg(F.array_sort(F.collect_list(F.struct("_k", F.array_max("e")["_c"].alias("top"), "e"))).alias("_blocks"))
        mine = F.get(F.filter("_blocks", lambda b: b["top"] >= F.col(conf)), F.lit(0))["e"]
        hit = F.get(F.filter(mine, lambda e: e["_c"] >= F.col(conf)), F.lit(0))
        out = df.crossJoin(F.broadcast(table.crossJoin(first)))  # one row of at most ``most`` steps
        return out.withColumn(name, F.when(F.col(conf).isNotNull(), accuracy(hit) - margin)).drop("_blocks", "_acc0", "_r0")
    probe = df.select(F.col(conf).alias("_c")).where(F.col(conf).isNotNull()).distinct()
    both = steps.select("_c", "_r", "_s").unionByName(probe.select("_c", F.lit(None).cast("long").alias("_r"), F.lit(None).cast("long").alias("_s")))
    both = kept(both.groupBy("_c").agg(F.max("_r").alias("_r"), F.max("_s").alias("_s")).withColumn("_b", -F.floor(F.col("_c") * 4095).cast("int")))
    # per range of confidence the last step above it, then inside the range
    tops = both.where("_r IS NOT NULL").groupBy("_b").agg(F.max(F.struct("_r", "_s")).alias("_t"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    frame = both.select("_b").distinct().join(tops, "_b", "left")  # at most 4096 rows
    start = frame.select("_b", F.max("_t").over(before).alias("_t0"))
    inside = Window.partitionBy("_b").orderBy(F.desc("_c")).rowsBetween(Window.unboundedPreceding, 0)
    here = F.max(F.when(F.col("_r").isNotNull(), F.struct("_r", "_s"))).over(inside)
    found = both.join(F.broadcast(start), "_b").select("_c", F.coalesce(here, F.col("_t0")).alias("_h")).crossJoin(F.broadcast(first))
    return df.join(found.select(F.col("_c").alias(conf), (accuracy(F.col("_h")) - margin).alias(name)), conf, "left")


def threshold_sweep(df: DataFrame, conf: str, ok: str, thresholds: tuple[float, ...]) -> DataFrame:
    """(threshold, n, decides, accuracy, defers) of each confidence threshold, in one pass over the rows."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[x for k, t in enumerate(thresholds) for x in (F.count_if(F.col(conf) >= t).alias(f"n{k}"), F.count_if((F.col(conf) >= t) & (F.col(ok).cast("int") == 1)).alias(f"h{k}"))])
    each = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"n{k}").alias("n"), F.col(f"h{k}").alias("h")) for k, t in enumerate(thresholds)])
    out = row.select("_n", F.explode(each).alias("e")).select("_n", "e.*").where("n > 0")
    return out.select("threshold", "n", (F.col("n") / F.col("_n")).alias("decides"), (F.col("h") / F.col("n")).alias("accuracy"), (1 - F.col("n") / F.col("_n")).alias("defers"))


def reject_sweep(df: DataFrame, conf: str, ok: str, position: str, fractions: tuple[float, ...]) -> DataFrame:
    """Set the least sure fraction aside: (fraction, kept, decides, accuracy), keeping max(1, round(n * (1 - f))).

    Among equal confidences, the earlier position is kept.
    """
    ranked = running(df.withColumn("_ok", F.col(ok).cast("long")), conf, ["_ok"], ties=(position,), ascending=False)
    f = F.explode(F.array(*[F.lit(float(x)) for x in fractions]))
    kept = F.greatest(F.lit(1).cast("long"), F.bround(F.col("total") * (1 - F.col("fraction")), 0).cast("long"))
    total = ranked.agg(F.max("total").alias("total")).where("total > 0").select("total", f.alias("fraction")).withColumn("kept", kept)
    return ranked.select("rank", "run__ok").join(F.broadcast(total), F.col("rank") == F.col("kept")).select("fraction", "kept", (F.col("kept") / F.col("total")).alias("decides"), (F.col("run__ok") / F.col("kept")).alias("accuracy"))


def reject_sweep_ascending(df: DataFrame, conf: str, ok: str, position: str, rates: tuple[int, ...]) -> DataFrame:
    """The other rule of ties: sort upwards and drop the first round(n * r / 100): (rate, dropped, error, floor).

    ``error`` of what is left is null if nothing is; ``floor`` is the confidence at the cut, else 1.
    """
    ranked = running(df.withColumn("_ok", F.col(ok).cast("long")), conf, ["_ok"], ties=(position,), ascending=True)
    totals = ranked.agg(F.max("total").alias("n"), F.max_by("run__ok", "rank").alias("hits")).where("n > 0")
    cut = totals.select("n", "hits", F.explode(F.array(*[F.lit(int(r)).cast("long") for r in rates])).alias("rate")).withColumn("dropped", F.bround(F.col("n") * F.col("rate") / 100, 0).cast("long"))
    step = ranked.select("rank", F.col("run__ok").alias("below"), F.col(conf).alias("c"), F.col("_ok").alias("one"))
    # the row after the cut tells the floor and, with its own outcome taken off, the hits among the dropped
    out = F.broadcast(cut).join(step, F.col("rank") == F.col("dropped") + 1, "left")
    gone = F.coalesce(F.col("below") - F.col("one"), F.col("hits"))
    left = F.col("n") - F.col("dropped")
    return out.select("rate", "dropped", F.when(left > 0, 1 - (F.col("hits") - gone) / left).alias("error"), F.coalesce("c", F.lit(1.0)).alias("floor"))


def operating_point(curve: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """(cut, coverage, accuracy) of the point of most coverage whose accuracy holds with the margin; none: 1.01, 0, 0."""
    good = F.when(F.col("accuracy") >= threshold + margin, F.struct("coverage", "conf", "accuracy"))
    best = curve.agg(F.max(good).alias("b"))
    return best.select(F.coalesce("b.conf", F.lit(NO_CUT)).alias("cut"), F.coalesce("b.coverage", F.lit(0.0)).alias("coverage"), F.coalesce("b.accuracy", F.lit(0.0)).alias("accuracy"))


def class_ceilings(curves: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """(label, ceiling, vetoed): the best accuracy of a class's curve, vetoed if it never reaches the bar."""
    return curves.groupBy("label").agg(F.max("accuracy").alias("ceiling")).select("label", "ceiling", (F.col("ceiling") < threshold + margin).alias("vetoed"))
