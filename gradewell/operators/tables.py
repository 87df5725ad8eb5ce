"""Keyed tables: cleaning, one row per key, eligibility, merges.  DataFrame in, DataFrame out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class MissingData(ValueError):
    """A requested column has no value at all."""


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the last in ``order`` wins, as in a keyed reading of a file."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def best_per_group(df: DataFrame, group: str, value: str, *ties: str) -> DataFrame:
    """One row per group: the least ``value``, then the least of ``ties``.

    Spark plans the rank filter as a partial and a final group limit, so at most one row per group
    and task is shuffled.  A null value sorts last; a group of nulls keeps its first row by ties.
    """
    w = Window.partitionBy(group).orderBy(F.col(value).asc_nulls_last(), *[F.asc(t) for t in ties])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_row_if_unknown(df: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """``best_per_group`` as a loop over rows would do it: a first row of unknown value is never replaced."""
    first = F.min_by(F.col(value).isNull(), F.col(order)).over(Window.partitionBy(group))
    rank = F.when(first, F.lit(0.0)).otherwise(F.coalesce(F.col(value), F.lit(float("inf"))))
    return best_per_group(df.withColumn("_v", rank), group, "_v", order).drop("_v")


def without_doubtful(df: DataFrame, doubtful: DataFrame, key: str, state: str, prefixes: tuple[str, ...]) -> DataFrame:
    """Rows whose key has no doubtful entry in a state that begins with one of ``prefixes``."""
    hit = reduce(lambda a, b: a | b, [F.col(state).startswith(p) for p in prefixes])
    return df.join(doubtful.where(hit).select(key), key, "left_anti")


def eligible(df: DataFrame, flags: DataFrame, key: str, condition: Column) -> DataFrame:
    """Rows whose key has an entry in ``flags`` that meets the condition; no entry is a rejection."""
    return df.join(flags.where(condition).select(key), key, "left_semi")


def first_wins(key: str, names: list[str], *tables: DataFrame) -> DataFrame:
    """Per key of the first table, each column from the first table that has both the column and a row.

    An empty value of that row still wins: presence counts, not content.  Keys must be unique.
    """
    out = tables[0].select(key).withColumn("_r0", F.lit(True))
    renamed = []
    for i, t in enumerate(tables):
        cols = [c for c in names if c in t.columns]
        renamed.append(cols)
        slim = t.select(key, *[F.col(c).alias(f"_{i}_{c}") for c in cols], F.lit(True).alias(f"_p{i}"))
        out = out.join(slim, key, "left")
    picks = []
    for c in names:
        have = [i for i, cols in enumerate(renamed) if c in cols]
        chain = None
        for i in have:
            chain = F.when(F.col(f"_p{i}"), F.col(f"_{i}_{c}")) if chain is None else chain.when(F.col(f"_p{i}"), F.col(f"_{i}_{c}"))
        picks.append((F.lit(None).cast("string") if chain is None else chain).alias(c))
    return out.select(key, *picks)


def overlay(df: DataFrame, corrections: DataFrame, key: str, column: str, corrected: str) -> DataFrame:
    """``column`` with the corrections of some keys laid over it."""
    fix = corrections.select(key, F.col(corrected).alias("_fix"))
    return df.join(fix, key, "left").withColumn(column, F.coalesce("_fix", column)).drop("_fix")


def completeness(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, n_rows, n_known, empty) of each column, in one pass."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in names])
    return row.select("_n", F.posexplode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_known")) for c in names])).alias("_k", "e")).select(
        F.col("e.column").alias("column"), F.col("_n").alias("n_rows"), F.col("e.n_known").alias("n_known"), (F.col("e.n_known") == 0).alias("empty")
    )


def require_complete(df: DataFrame, names: list[str]) -> DataFrame:
    """``df``, or an error that names its columns without any value."""
    empty = [r["column"] for r in completeness(df, names).where("empty").collect()]
    if empty:
        raise MissingData(f"no value at all in {', '.join(empty)}")
    return df


def even_sample(df: DataFrame, group: str, order: str, wanted: int) -> DataFrame:
    """At most ``wanted`` rows per group, evenly spaced in order: ranks trunc(i * (n - 1) / (m - 1)), m = min(wanted, n)."""
    w = Window.partitionBy(group)
    ranked = df.withColumn("_k", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    m = F.least(F.lit(wanted).cast("long"), F.col("_n"))
    # rank k is wanted if some i gives it: the least i with i * (n - 1) >= k * (m - 1) does or none
    i = F.ceil(F.col("_k") * (m - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    hit = F.when(m == 1, F.col("_k") == 0).otherwise((F.floor(i * (F.col("_n") - 1) / F.greatest(m - 1, F.lit(1))) == F.col("_k")) & (i < m))
    return ranked.where(hit).drop("_k", "_n")


def pending(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of ``todo`` whose key is not done: what a resumed run has left."""
    return todo.join(done.select(key), key, "left_anti")


def recode(column: str, groups: dict[str, tuple[str, ...]], other: str | None = None) -> Column:
    """A label by the group that lists it; others become ``other`` (None: stay)."""
    out = None
    for name, members in groups.items():
        hit = F.col(column).isin(*members)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.col(column) if other is None else F.lit(other))


def by_prefix(df: DataFrame, *prefixes: str, without: tuple[str, ...] = ()) -> list[str]:
    """Names of the columns that begin so, in order, but for some."""
    return [c for c in df.columns if c.startswith(prefixes) and c not in without]


def folds_of(partition: DataFrame) -> DataFrame:
    """(fold, id) of a partition document: an array of folds, each with its list of test ids."""
    return partition.select(F.posexplode("folds").alias("fold", "f")).select(F.col("fold").cast("long").alias("fold"), F.explode("f.test").alias("id"))


def hash_folds(df: DataFrame, key: str, k: int) -> DataFrame:
    """A fold from 0 to k - 1 for each key, by its MD5: groups never straddle folds."""
    value = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
    return df.withColumn("fold", F.pmod(value, F.lit(k)).cast("long"))
