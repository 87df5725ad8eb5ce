"""Operators on short ordered series, one per key (a profile, a day series): runs, gaps, filters, periods."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, key: str, pos: str, longest: int | None = None) -> DataFrame:
    """(key, first, last, length, middle) of each run of consecutive positions, but for those over ``longest``."""
    run = F.col(pos) - F.row_number().over(Window.partitionBy(key).orderBy(pos))
    out = df.withColumn("_g", run).groupBy(key, "_g").agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count(F.lit(1)).alias("length"))
    out = out.select(key, "first", "last", "length", ((F.col("first") + F.col("last")) / 2).alias("middle"))
    return out if longest is None else out.where(F.col("length") <= longest)


def edge_runs(df: DataFrame, key: str, pos: str, value: str, share: float) -> DataFrame:
    """(key, head, tail, base, margin): positions below ``share`` of the maximum at each end; base is the longer end (tie: end)."""
    top = df.groupBy(key).agg(F.max(value).alias("_top"), F.min(pos).alias("_p0"), F.max(pos).alias("_p1"))
    high = df.join(top, key).where(F.col(value) >= share * F.col("_top"))
    ends = high.groupBy(key, "_p0", "_p1").agg((F.min(pos) - F.col("_p0")).alias("head"), (F.col("_p1") - F.max(pos)).alias("tail"))
    return ends.select(key, "head", "tail", F.when(F.col("head") > F.col("tail"), "start").otherwise("end").alias("base"), F.abs(F.col("head") - F.col("tail")).alias("margin"))


def fill_gaps(df: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """Null values on the line between the nearest known ones; constant before the first and after the last."""
    w = Window.partitionBy(key).orderBy(pos)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(pos).alias("p"), F.col(value).alias("x")))
    out = df.withColumn("_a", F.last(known, ignorenulls=True).over(back)).withColumn("_b", F.first(known, ignorenulls=True).over(ahead))
    line = F.col("_a.x") + (F.col("_b.x") - F.col("_a.x")) * (F.col(pos) - F.col("_a.p")) / F.nullif(F.col("_b.p") - F.col("_a.p"), F.lit(0))
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_a").isNull(), F.col("_b.x")).when(F.col("_b").isNull(), F.col("_a.x")).otherwise(line)
    return out.withColumn(value, filled).drop("_a", "_b")


def moving_median(df: DataFrame, key: str, pos: str, value: str, reach: int) -> DataFrame:
    """(key, pos, mid): median of the values up to ``reach`` rows around, the end values repeated beyond the ends."""
    w = Window.partitionBy(key).orderBy(pos)
    everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    around = [F.coalesce(F.lag(value, k).over(w), F.first(value).over(everything)) if k > 0 else F.coalesce(F.lead(value, -k).over(w), F.last(value).over(everything)) for k in range(-reach, reach + 1) if k]
    listed = F.sort_array(F.array(*[c.cast("double") for c in [*around, F.col(value)]]))
    return df.select(key, pos, F.element_at(listed, reach + 1).alias("mid"))


def smooth(df: DataFrame, key: str, pos: str, value: str, weights: tuple[float, ...]) -> DataFrame:
    """(key, pos, smooth): weighted mean of neighbours, a missing one replaced by the value itself."""
    w = Window.partitionBy(key).orderBy(pos)
    half = len(weights) // 2
    total = None
    for k, a in enumerate(weights):
        at = k - half
        x = F.col(value) if at == 0 else F.coalesce(F.lag(value, -at).over(w) if at < 0 else F.lead(value, at).over(w), F.col(value))
        total = a * x if total is None else total + a * x
    return df.select(key, pos, total.alias("smooth"))


def gaussian_weights(sigma: float, reach: int) -> tuple[float, ...]:
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    return tuple(x / sum(raw) for x in raw)


def comb_strength(df: DataFrame, key: str, pos: str, first: float = 55.0, last: float = 110.0, step: float = 0.5, least: int = 4) -> DataFrame:
    """(key, period, strength): modulus of the mean unit vector of the positions' phases, for every candidate period.

    Keys with fewer than ``least`` positions have none.  The periods of a row are an array, so the
    rows grow by a fixed factor and are summed before any shuffle.
    """
    periods = F.sequence(F.lit(0), F.lit(round((last - first) / step)))
    angle = lambda p: 2 * math.pi * F.col(pos) / p
    each = df.select(key, pos, F.explode(F.transform(periods, lambda k: first + step * k)).alias("period"))
    out = each.groupBy(key, "period").agg(F.count(F.lit(1)).alias("_n"), F.avg(F.cos(angle(F.col("period")))).alias("_c"), F.avg(F.sin(angle(F.col("period")))).alias("_s"))
    return out.where(F.col("_n") >= least).select(key, "period", F.hypot("_c", "_s").alias("strength"))


def dominant_period(strengths: DataFrame, key: str, harmonic: float = 0.85) -> DataFrame:
    """(key, period, strength): the strongest period, or the candidate nearest to its double if that is nearly as strong.

    Of equal strengths the shorter period counts.  Twice any candidate is at or beyond the last one,
    so the nearest is always the last.
    """
    best = strengths.groupBy(key).agg(
        F.min_by(F.struct("period", "strength"), F.struct((-F.col("strength")).alias("s"), F.col("period"))).alias("b"),
        F.max_by(F.struct("period", "strength"), "period").alias("l"),
    )
    double = F.col("l.strength") >= harmonic * F.col("b.strength")
    return best.select(key, F.when(double, F.col("l.period")).otherwise(F.col("b.period")).alias("period"), F.when(double, F.col("l.strength")).otherwise(F.col("b.strength")).alias("strength"))


def mean_spectrum(strengths: DataFrame, session: str, key: str, least: int = 3) -> DataFrame:
    """(session, period, strength): spectra of a session averaged, where it has at least ``least`` series."""
    return strengths.groupBy(session, "period").agg(F.avg("strength").alias("strength"), F.count_distinct(key).alias("_n")).where(F.col("_n") >= least).select(session, "period", "strength")
