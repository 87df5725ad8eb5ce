"""Aggregates: details to parents, medians, agreement of labels, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept


def median(c: str) -> Column:
    """Exact, interpolated; for groups whose distinct values fit one buffer (else ``exact_percentiles``)."""
    return F.percentile(F.col(c).cast("double"), 0.5)


def exact_percentiles(df: DataFrame, groups: list[str], value: str, shares: list[float], accuracy: int = 10_000) -> DataFrame:
    """(groups, n, q): exact interpolated percentiles per group, for groups of any size.

    The built-in exact percentile holds all distinct values of a group in one buffer.  Here a sketch of
    bounded size brackets each percentile between two values; one pass counts what lies below the
    bracket, and only the few values inside it are ordered.  The sketch's rank error is at most
    n / accuracy, and the bracket is twice that wide on either side, so the wanted ranks are in it.
    Null values don't count; a group without values has none of its own rows here.
    """
    rows = kept(df.select(*groups, F.col(value).cast("double").alias("_v"))).where(F.col("_v").isNotNull())
    room = 2 / accuracy
    ends = [x for q in shares for x in (max(0.0, q - room), min(1.0, q + room))]
    sketch = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", ends, accuracy).alias("_e"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    small = F.col("_n") <= 4 * accuracy  # a bounded group is ordered whole
    low = [F.when(small | F.lit(q - room <= 0), F.col("_lo")).otherwise(F.get("_e", F.lit(2 * k))) for k, q in enumerate(shares)]
    high = [F.when(small | F.lit(q + room >= 1), F.col("_hi")).otherwise(F.get("_e", F.lit(2 * k + 1))) for k, q in enumerate(shares)]
    sketch = sketch.select(*groups, "_n", F.array(*low).alias("_a"), F.array(*high).alias("_b"))
    if groups:
        named = sketch.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], "_n", "_a", "_b")
        same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)]
        both = rows.join(named, same)
    else:
        both = rows.crossJoin(F.broadcast(sketch))  # one row
    marks = F.array(*[F.when(F.col("_v") < F.get("_a", F.lit(k)), -1).when(F.col("_v") <= F.get("_b", F.lit(k)), F.lit(k + 1)).otherwise(0) for k in range(len(shares))])
    # per share: how many are below (-1), and the counts of the values inside
    each = both.select(*groups, "_n", "_v", F.posexplode(marks).alias("_k", "_m")).where("_m <> 0")
    counts = each.groupBy(*groups, "_k", "_n", F.when(F.col("_m") > 0, F.col("_v")).alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*groups, "_k").orderBy(F.col("_x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    cum = counts.withColumn("_cum", F.sum("_c").over(w))
    place = F.element_at(F.array(*[F.lit(float(q)) for q in shares]), F.col("_k") + 1) * (F.col("_n") - 1)
    cum = cum.withColumn("_h", place).withColumn("_r", F.floor("_h"))
    last = F.least(F.col("_r") + 2, F.col("_n"))
    found = cum.groupBy(*groups, "_k", "_n", "_h", "_r").agg(F.min(F.when((F.col("_cum") >= F.col("_r") + 1) & F.col("_x").isNotNull(), F.col("_x"))).alias("_x0"), F.min(F.when((F.col("_cum") >= last) & F.col("_x").isNotNull(), F.col("_x"))).alias("_x1"))
    value_at = F.col("_x0") + (F.col("_x1") - F.col("_x0")) * (F.col("_h") - F.col("_r"))
    per = found.groupBy(*groups, F.col("_n").alias("n")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", value_at.alias("x")))), lambda e: e["x"]).alias("q"))
    return per


def largest(value: str, columns: list[str], *ties: Column) -> Column:
    """Struct of ``columns`` of the row with the largest value; of equals the least by ``ties``."""
    return F.min_by(F.struct(*columns), F.struct((-F.col(value)).alias("v"), *[t.alias(f"t{i}") for i, t in enumerate(ties)]))


def conditional_sums(kinds: str, values: list[str], measure: str, prefix: str) -> list[Column]:
    """Count, sum and share of a measure per kind, as columns."""
    total = F.sum(measure)
    out = []
    for v in values:
        mine = F.col(kinds) == v
        s = F.coalesce(F.sum(F.when(mine, F.col(measure))), F.lit(0.0))
        out += [F.count_if(mine).alias(f"{prefix}_{v}_n"), s.alias(f"{prefix}_{v}_sum"), F.try_divide(s, total).alias(f"{prefix}_{v}_share")]
    return out


def majority_share(df: DataFrame, label: str) -> DataFrame:
    """(label, n, share) of the most frequent label (the least of equals): the baseline."""
    counts = df.groupBy(label).count()
    best = counts.agg(F.sum("count").alias("total"), F.min_by(F.struct(label, "count"), F.struct((-F.col("count")).alias("c"), F.col(label))).alias("m"))
    return best.select(F.col(f"m.{label}").alias("label"), F.col("m.count").alias("n"), (F.col("m.count") / F.col("total")).alias("share"))


def confusion(df: DataFrame, truth: str, said: str, labels: list[str]) -> DataFrame:
    """(truth, said, n) for every pair of labels, zero cells kept."""
    spark = df.sparkSession
    cells = spark.createDataFrame([(a, b) for a in labels for b in labels], "truth string, said string")
    counts = df.groupBy(F.col(truth).alias("truth"), F.col(said).alias("said")).agg(F.count(F.lit(1)).alias("n"))
    return cells.join(counts, ["truth", "said"], "left").select("truth", "said", F.coalesce("n", F.lit(0)).alias("n"))


def _marginals(df: DataFrame, truth: str, said: str) -> DataFrame:
    """(label, n_true, n_said, n_hit): one row per label, from one grouped count."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(said).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("t").alias("label"), F.col("n").alias("n_true"), F.lit(0).cast("long").alias("n_said"), F.lit(0).cast("long").alias("n_hit")),
                F.struct(F.col("s").alias("label"), F.lit(0).cast("long").alias("n_true"), F.col("n").alias("n_said"), F.when(F.col("t") == F.col("s"), F.col("n")).otherwise(0).cast("long").alias("n_hit")),
            )
        ).alias("e")
    ).select("e.*")
    return sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("n_true", "n_said", "n_hit")])


def kappa(df: DataFrame, truth: str, said: str) -> DataFrame:
    """(n, accuracy, expected, kappa) of two labellings; kappa is 0 where chance explains everything."""
    total = _marginals(df, truth, said).agg(F.sum("n_true").alias("n"), F.sum("n_hit").alias("hit"), F.sum(F.col("n_true") * F.col("n_said")).alias("cross"))
    po, pe = F.col("hit") / F.col("n"), F.col("cross") / (F.col("n") * F.col("n"))
    return total.where("n > 0").select("n", po.alias("accuracy"), pe.alias("expected"), F.when(pe < 1, (po - pe) / F.nullif(1 - pe, F.lit(0.0))).otherwise(0.0).alias("kappa"))


def class_report(df: DataFrame, truth: str, said: str) -> DataFrame:
    """Precision, recall and F1 of each label; 0 where undefined."""
    m = _marginals(df, truth, said)
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    p, r = ratio(F.col("n_hit"), F.col("n_said")), ratio(F.col("n_hit"), F.col("n_true"))
    return m.select("label", F.col("n_true").alias("support"), p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def balanced_accuracy(df: DataFrame, truth: str, ok: str) -> DataFrame:
    """(n_classes, balanced): mean recall over the true classes."""
    per = df.groupBy(truth).agg(F.avg(F.col(ok).cast("double")).alias("r"))
    return per.agg(F.count(F.lit(1)).alias("n_classes"), F.avg("r").alias("balanced"))


def auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """Mann-Whitney AUC by rank sums, ties counted half.

    Works on counts per distinct score: positives below are a running sum over score values, taken in
    ranges so that no task orders all of them.
    """
    per = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.sum(1 - F.col(positive).cast("long")).alias("q"))
    from .ordered import running

    ranked = running(per, "s", ["q"], ties=("p",), ascending=True)
    total = ranked.agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), F.sum(F.col("p") * (F.col("run_q") - F.col("q") / 2)).alias("wins"))
    return total.select("n_pos", "n_neg", F.try_divide(F.col("wins"), (F.col("n_pos") * F.col("n_neg")).cast("double")).alias("auc"))


def fingerprint(df: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """First 16 hex digits of the SHA-256 over a group's values in order, each followed by a bar.

    One digest over the values in order needs a group's values in one row: for groups of up to some
    ten million values.
    """
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("string").alias("v")))), lambda e: F.concat(e["v"], F.lit("|")))
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.substring(F.sha2(F.array_join(listed, ""), 256), 1, 16).alias("fingerprint"))


def robust_z(df: DataFrame, group: str, value: str) -> DataFrame:
    """``df`` with the group's median and 1.4826 MAD, and the robust z of each row (null where MAD is 0)."""
    mid = exact_percentiles(df, [group], value, [0.5]).select(group, F.get("q", F.lit(0)).alias("mid"))
    dev = df.join(mid, group).withColumn("dev", F.abs(F.col(value) - F.col("mid")))
    mad = exact_percentiles(dev, [group], "dev", [0.5]).select(group, (1.4826 * F.get("q", F.lit(0))).alias("mad"))
    return dev.join(mad, group).withColumn("z", F.try_divide(F.col(value) - F.col("mid"), F.col("mad"))).drop("dev")


def weighted(value: str, weight: str) -> Column:
    """sum(weight * value) / sum(weight), null without weight."""
    return F.try_divide(F.sum(F.col(weight) * F.col(value)), F.sum(weight))


def residual_accuracy(total: Column, share: Column, accuracy: Column) -> Column:
    """Accuracy of the rest, if ``share`` of all has ``accuracy`` and all have ``total``."""
    return F.when(1 - share > 1e-9, (total - share * accuracy) / (1 - share))
