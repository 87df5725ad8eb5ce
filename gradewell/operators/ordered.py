"""Ranks and running sums over one global order, without one task that sees all rows.

Rows are dealt into ranges of the whole order, ties included, by a sample of them; a range holds about
``RANGE_ROWS`` rows, however values are spread.  Range totals (one row per range) give the sums before
each range; inside a range a window does the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept

RANGE_ROWS = 200_000


def running(df: DataFrame, order: str, sums: list[str], ties: tuple[str, ...] = (), ascending: bool = True, range_rows: int = RANGE_ROWS, bounds: tuple[float, float] | None = None) -> DataFrame:
    """``df`` with ``rank`` (long, from 1), ``total`` (rows) and ``run_<c>`` for each column to sum.

    The order is by ``order``, then ``ties`` ascending; rows that are equal in all of them have no
    defined order among each other.  Rows of a null order value are left out.  Columns beside those
    named here are not carried along.  ``bounds``, limits of the order values, are no longer needed:
    the rows themselves give the ranges.

    The few columns are written to the shared folder with the number of their range, since totals and
    rows both read them.
    """
    # unknown values go after the writing: a filter before it would work the order column out twice
    rows = kept(df.select(*dict.fromkeys([order, *ties, *sums]))).where(F.col(order).isNotNull())
    n = rows.count()
    by = [F.col(order).asc() if ascending else F.col(order).desc(), *[F.asc(t) for t in ties]]
    parts = -(-n // range_rows)
    if parts <= 1:
        whole = Window.partitionBy(F.lit(0)).orderBy(*by)
        upto = whole.rowsBetween(Window.unboundedPreceding, 0)
        return rows.select("*", F.row_number().over(whole).cast("long").alias("rank"), F.lit(n).cast("long").alias("total"), *[F.sum(c).over(upto).alias(f"run_{c}") for c in sums])
    dealt = kept(rows.repartitionByRange(parts, *by).withColumn("_b", F.spark_partition_id()))
    totals = dealt.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in sums])
    # one row per range from here: one small window over the range totals
    before = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    start = totals.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_s0_{c}") for c in sums])
    inside = Window.partitionBy("_b").orderBy(*by)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(start), "_b")  # n / range_rows rows
    out = out.withColumn("rank", (F.col("_n0") + F.row_number().over(inside)).cast("long")).withColumn("total", F.lit(n).cast("long"))
    for c in sums:
        out = out.withColumn(f"run_{c}", F.col(f"_s0_{c}") + F.sum(c).over(upto))
    return out.drop("_b", "_n0", *[f"_s0_{c}" for c in sums])
