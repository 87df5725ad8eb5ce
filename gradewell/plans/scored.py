"""The scored relation that stands for graded items: documents, their features, scores and truth.

Each document is an item, its source the session and its language the variety.  Features are shares of
characters; three nodes with fixed coefficients give the chain's probabilities (rounded to nine
digits, so that later comparisons do not depend on the last bit of an exponential); labels, where
there are any, give the true class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import half_even
from ..operators import decide

FEATURES = ("f_upper", "f_symbol", "f_space", "f_line", "f_size")
# fixed coefficients of the three nodes: (feature weights, intercept)
NODES = {
    "p_band": ({"f_upper": 6.0, "f_symbol": 4.0, "f_line": -30.0}, -2.0),
    "p_wrap": ({"f_symbol": -8.0, "f_size": 9.0, "f_space": 4.0}, -5.5),
    "p_left": ({"f_space": 40.0, "f_upper": -1.0}, -5.5),
}


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n, features...) of every document: one pass, no shuffle."""
    t = F.coalesce(F.col("text"), F.lit(""))
    n = F.char_length(t)
    share = lambda count: count / (n + 1e-6)
    without = lambda c: n - F.char_length(F.replace(t, F.lit(c), F.lit("")))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(
        "doc_id", "lang", "source", n.cast("long").alias("n"),
        share(F.regexp_count(t, F.lit("[A-Z]"))).alias("f_upper"), share(F.regexp_count(t, F.lit("[#*$%&|!]"))).alias("f_symbol"), share(without(" ")).alias("f_space"), share(without("\n")).alias("f_line"), (F.ln(1.0 + n) / 10).alias("f_size"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``features`` with the nodes' probabilities, the decision, its confidence and the truth of labelled documents."""
    f = features(spark, sf_dir)
    for name, (weights, intercept) in NODES.items():
        f = f.withColumn(name, half_even(decide.node(weights, intercept), 9))
    chain = decide.chained("p_band", "p_wrap", "p_left")
    f = f.withColumn("said", chain["label"]).withColumn("conf", half_even(chain["conf"], 9))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    truth = (
        F.when(F.col("toxic").isNull(), F.lit(None))
        .when(F.col("quality") == 0, "band")
        .when(F.col("toxic") == 1, F.when(F.col("doc_id") % 2 == 0, "left").otherwise("right"))
        .otherwise("wrap")
    )
    return f.join(labels, "doc_id", "left").withColumn("truth", truth).withColumn("ok", F.when(F.col("truth").isNotNull(), F.col("truth") == F.col("said")))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored documents that have a truth."""
    return scored(spark, sf_dir).where("truth IS NOT NULL")


def _less(pattern: str) -> str:
    return f"(n - length(regexp_replace(t, '{pattern}', '', 'g'))) / (n + 1e-6)"


def _node(weights, intercept) -> str:
    z = " + ".join([f"CAST({intercept} AS DOUBLE)", *(f"CAST({w} AS DOUBLE) * {c}" for c, w in weights.items())])
    return f"round_even(1.0 / (1.0 + exp(-({z}))), 9)"


FEATURES_SQL = f"""
feat0 AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n FROM documents),
feat AS (SELECT doc_id, lang, source, n, {_less('[A-Z]')} AS f_upper, {_less('[#*$%&|!]')} AS f_symbol,
  {_less(' ')} AS f_space, {_less(chr(10))} AS f_line, ln(1.0 + n) / 10 AS f_size FROM feat0)"""

SCORED_SQL = f"""{FEATURES_SQL},
nodes AS (SELECT *, {', '.join(f'{_node(*v)} AS {k}' for k, v in NODES.items())} FROM feat),
chain AS (SELECT *,
  CASE WHEN p_band > 0.5 THEN 'band' WHEN p_wrap > 0.5 THEN 'wrap' WHEN p_left >= 1 - p_left THEN 'left' ELSE 'right' END AS said,
  round_even(CASE WHEN p_band > 0.5 THEN p_band WHEN p_wrap > 0.5 THEN (1 - p_band) * p_wrap
    ELSE (1 - p_band) * (1 - p_wrap) * greatest(p_left, 1 - p_left) END, 9) AS conf FROM nodes),
scored AS (SELECT chain.*, quality, toxic, CASE WHEN toxic IS NULL THEN NULL WHEN quality = 0 THEN 'band'
    WHEN toxic = 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'left' ELSE 'right' END ELSE 'wrap' END AS truth,
  CASE WHEN toxic IS NULL THEN NULL ELSE said = (CASE WHEN quality = 0 THEN 'band'
    WHEN toxic = 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'left' ELSE 'right' END ELSE 'wrap' END) END AS ok
  FROM chain LEFT JOIN labels USING (doc_id)),
judged AS (SELECT *, CASE WHEN ok THEN 1 ELSE 0 END AS hit FROM scored WHERE truth IS NOT NULL)"""
