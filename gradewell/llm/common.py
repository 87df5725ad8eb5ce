"""Helpers shared by the text operators: cutting lineage, partition counts, tokenizer files."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    It is ``spark.checkpoint.dir`` of the session.  Only where that is unset and the master is local
    (tests on one machine) a folder of this machine is taken; on a cluster that is an error.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if set_dir:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(set_dir)
        return set_dir
    if not sc.getCheckpointDir():
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir is unset: set it to a folder that the driver and the executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gradewell-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return it without its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parts(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    """Tasks for ``rows`` rows: one per ``rows_per_task``, at least the session's parallelism."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // rows_per_task))


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; an absolute path is returned as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def first_ids(docs: DataFrame, limit: int) -> list:
    """The first ``limit`` distinct ids of ``(doc_id)`` in hash order.

    The hashes are cut off first, at a share that leaves somewhat more than ``limit`` ids, so that few
    ids move; only where ids repeat so much that too few are left, all are taken.
    """
    rank, n = F.xxhash64("doc_id"), docs.count()
    share = 1.2 * (limit + 500) / max(n, 1)
    for few in (docs.where(rank <= int(min(share * 2.0**64 - 2.0**63, 2.0**62))), docs) if share < 0.7 else (docs,):
        got = [r[0] for r in few.distinct().orderBy(rank, "doc_id").limit(limit).collect()]
        if len(got) == limit:
            break
    return got


def texts_of(docs: DataFrame, ids: list, max_bytes: int, budget: int, least: int = 1) -> DataFrame:
    """``(doc_id, raw)`` of rows with these ids: texts of ``least`` to ``max_bytes`` bytes, ``budget`` bytes in all.

    ``ids`` is a bounded list.  Their lengths are read first; texts are taken in the order of ``ids``
    while they fit (of repeated ids all rows; a row counts as 64 bytes more, so rows are bounded too).
    """
    kind = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("raw")).where(F.octet_length("raw").between(least, max_bytes))

    def mine(chosen):
        return rows.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in chosen], T.StructType([T.StructField("doc_id", kind)]))), "doc_id")  # bounded by ids

    sizes = {r[0]: r[1] for r in mine(ids).groupBy("doc_id").agg(F.sum(F.octet_length("raw") + 64)).collect()}
    chosen, used = [], 0
    for i in ids:
        if i in sizes and used + sizes[i] <= budget:
            chosen.append(i)
            used += sizes[i]
    return mine(chosen)
