"""The corpus pipeline: toxicity, quality, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read
again as the next one's docs.  All but the last return the columns of ``documents``.  Labels are
read from ``sf_dir``; a model is fitted on the documents that reach its stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.llm import packing, quality, simhash, toxicity
from gradewell.llm.common import cut, shared_dir


def _free(docs: DataFrame, name: str) -> str:
    """A working column's name that ``docs`` does not have."""
    while name in docs.columns:
        name += "_"
    return name


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _keep(docs: DataFrame, scored: Callable, model, threshold: float, above: bool) -> DataFrame:
    """Rows of ``docs`` on the wanted side of the threshold, scored by the model where they lie (no join)."""
    name = _free(docs, "__pipeline_score")
    good = F.col(name) >= threshold if above else F.col(name) < threshold
    return scored(docs, model, name=name).where(good).drop(name)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5.

    Each row is judged by its whole text, of any length: repeated rows and ids fare alike, null ids
    are judged like others, null texts as empty ones (which are kept: nothing in them is toxic).
    Without toxic labels all rows stay; an empty table stays empty; other columns pass as they are.
    """
    model = toxicity.train(docs, _labels(spark, sf_dir))
    return _keep(docs, toxicity.with_score, model, 0.5, above=False)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.7.

    Each row is judged by its whole text, of any length: repeated rows and ids fare alike, null ids
    are judged like others.  Null and empty texts all have the score of a text that says nothing, the
    base rate of the calibration, and stay or go together.  An empty table stays empty; other columns
    pass as they are.
    """
    model = quality.train(docs, _labels(spark, sf_dir))
    return _keep(docs, quality.with_score, model, 0.7, above=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each SimHash class (of repeated ids, one row; null ids last).

    Null and wordless texts are one class.  Rows are known by id and a hash of their content, so it
    does not matter how the table is split when it is read again; of equal rows one stays.
    """
    row = _free(docs, "__pipeline_row")
    content = [F.to_json(c) if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes]
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(*content).alias("h1"), F.xxhash64(F.lit(1), *content).alias("h2"))
    tagged = docs.withColumn(row, key)
    classes = simhash.near_duplicates(tagged.select(row, "text"), row)
    best = cut(classes.where(F.col(row) == F.col("component")).groupBy(row).agg(F.count("*").alias("n")))
    kept = tagged.join(best.where("n = 1").select(row), row, "left_semi")
    if best.where("n > 1").limit(1).count():
        kept = kept.unionByName(tagged.join(best.where("n > 1").select(row), row, "left_semi").dropDuplicates([row]))
    return kept.drop(row)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the remaining documents in sequences of at most 2048 tokens.

    Null and empty texts are one end token; repeated rows and null ids are packed each; longer texts
    are cut into pieces; an empty table gives no rows.
    """
    return packing.pack(docs, "byte_bpe_50k.json", room=2048, end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_classifier", drop_poor),
    ("simhash_near_dedup", drop_near_duplicates),
    ("best_fit_packing", pack),
]

ORACLE_SQL = None  # trained models and tokenizers are beyond SQL: tests/llm holds a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    A stage's folder goes once the next one is written; the last one holds the result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store, last = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            store.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{last}"), True)
        last = name
    return docs
