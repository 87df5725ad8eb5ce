"""Sinks: tables, resumable appends, logs, partition documents, masks, meshes, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import _glob, stl_of


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """Overwrite a CSV table.  The commit makes it appear whole or not at all; unknown values are empty."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).option("emptyValue", "").csv(path)


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the Parquet sink does not hold yet; how many those were.

    What a run that was stopped has written stays and is skipped by the next one.
    """
    spark = df.sparkSession
    if _glob(spark, f"{path}/*.parquet"):
        df = df.join(spark.read.parquet(path).select(key), key, "left_anti")
    df = df.persist()
    n = df.count()
    if n:
        df.write.mode("append").parquet(path)
    df.unpersist()
    return n


def write_document(spark: SparkSession, path: str, document: dict) -> None:
    """One JSON document (a model's metadata, a curve) as a file: written beside its place, then renamed over it."""
    jvm = spark.sparkContext._jvm
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".part")
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = store.create(part, True)
    out.write(bytearray(json.dumps(document, ensure_ascii=False, indent=1).encode()))
    out.close()
    store.delete(target, False)
    store.rename(part, target)


def first_new(df: DataFrame, path: str, key: str, n: int, order: str) -> DataFrame:
    """The first ``n`` rows in order whose key the Parquet sink does not hold yet: a bounded step of a resumed run."""
    if _glob(df.sparkSession, f"{path}/*.parquet"):
        df = df.join(df.sparkSession.read.parquet(path).select(key), key, "left_anti")
    return df.orderBy(order).limit(n)


class Report:
    """Lines of a report: shown as they come, and kept for its file; ``step`` heads a part with its number."""

    def __init__(self, show=print):
        self.lines, self.steps, self.show = [], 0, show

    def line(self, text: str = "") -> None:
        self.lines.append(text)
        self.show(text)

    def step(self, title: str) -> None:
        self.steps += 1
        self.line(f"== {self.steps}. {title}")

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(i, t) for i, t in enumerate(self.lines)], "i int, value string").coalesce(1).orderBy("i").select("value").write.mode("overwrite").text(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON record per line; unknown fields are left out."""
    df.write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append to a log with semicolons; each file has its own header."""
    df.write.mode("append").option("header", True).option("sep", ";").csv(path)


def partition_document(folds: DataFrame, name: str, seed: int) -> DataFrame:
    """The partition document of (fold, id): sorted test ids per fold, counts and the fingerprint of all ids.

    The document is one JSON record by its format, so all ids (of groups, not rows) are in one row:
    for up to some ten million groups.
    """
    lists = folds.groupBy("fold").agg(F.sort_array(F.collect_set(F.col("id").cast("string"))).alias("test"))
    row = lists.agg(F.array_sort(F.collect_list(F.struct("fold", "test"))).alias("f"))
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("f", lambda e: e["test"]))))
    mark = F.substring(F.sha2(F.concat(F.array_join(ids, "|"), F.lit("|")), 256), 1, 16)
    return row.select(
        F.lit(name).alias("nombre"), F.size("f").alias("n_splits"), F.lit(seed).alias("random_state"), F.size(F.flatten(F.transform("f", lambda e: e["test"]))).alias("n_filas"),
        F.size(ids).alias("n_grupos"), mark.alias("huella_grupos"), F.transform("f", lambda e: F.struct(e["test"].alias("test"))).alias("folds"),
    )


def write_meshes(triangles: DataFrame, key: str, corners: str = "corners") -> DataFrame:
    """(key, stl): the binary STL of each key's triangles."""
    import numpy as np
    import pandas as pd

    def build(k, pdf):
        t = np.array([[list(c) for c in row] for row in pdf[corners]])
        return pd.DataFrame({key: [k[0]], "stl": [stl_of(t)]})

    return triangles.groupBy(key).applyInPandas(build, f"`{key}` {dict(triangles.dtypes)[key]}, stl binary")


def markdown(df: DataFrame, title: str, rows: int = 200) -> str:
    """A small report table as Markdown (at most ``rows`` rows are read)."""
    got = df.limit(rows).collect()
    show = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else json.dumps(v) if isinstance(v, (list, dict)) else str(v)
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(show(v) for v in r) + " |" for r in got)]) + "\n"


def figures_in(spark: SparkSession, text: str, patterns: dict[str, str]) -> DataFrame:
    """(name, value): numbers picked out of a report's text by patterns with one group."""
    import re

    found = [(k, float(m[1]) if (m := re.search(p, text)) else None) for k, p in patterns.items()]
    return spark.createDataFrame(found, "name string, value double")
