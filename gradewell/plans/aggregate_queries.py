"""Queries that aggregate: details to parents, medians, agreement of labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import half_even
from ..operators import aggregates, decide
from .registry import query, table
from .scored import SCORED_SQL, judged


@query("""
SELECT l_orderkey, count(*) AS n, count_if(l_returnflag = 'R') AS n_r, round_even(coalesce(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 0), 6) AS q_r,
  round_even(coalesce(sum(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN l_quantity END), 0), 6) AS q_no,
  coalesce(max(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 0) AS max_left, coalesce(max(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 0) AS max_right,
  round_even((coalesce(max(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 0) - coalesce(max(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 0))
   / (coalesce(max(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 0) + coalesce(max(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 0) + 1e-6), 6) AS pen_asym
FROM lineitem GROUP BY 1""")
def detail_to_parent(spark, sf_dir):
    """Conditional counts, sums and maxima of details, one row per parent."""
    li = table(spark, sf_dir, "lineitem")
    r, left, right, q = F.col("l_returnflag") == "R", F.col("l_linestatus") == "O", F.col("l_linestatus") == "F", F.col("l_quantity")
    big = lambda c: F.coalesce(F.max(F.when(c, q)), F.lit(0.0))
    some = lambda c: half_even(F.coalesce(F.sum(F.when(c, q)), F.lit(0.0)))
    out = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(r).alias("n_r"), some(r).alias("q_r"), some((F.col("l_returnflag") == "N") & left).alias("q_no"), big(left).alias("max_left"), big(right).alias("max_right"))
    return out.withColumn("pen_asym", half_even((F.col("max_left") - F.col("max_right")) / (F.col("max_left") + F.col("max_right") + 1e-6)))


@query("""
SELECT l_orderkey, l_partkey, l_returnflag, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_quantity DESC, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_returnflag) AS n FROM lineitem WHERE l_returnflag <> 'A') WHERE n = 1""")
def largest_defect(spark, sf_dir):
    """The largest detail of each parent with its own columns; one kind does not count."""
    li = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'A'")
    cols = ["l_partkey", "l_returnflag", "l_quantity"]
    best = aggregates.largest("l_quantity", cols, F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_extendedprice"), F.col("l_returnflag"))
    return li.groupBy("l_orderkey").agg(best.alias("b")).select("l_orderkey", *[f"b.{c}" for c in cols])


@query("""
SELECT l_linestatus, """ + ", ".join(f"count_if(l_returnflag = '{v}') AS t_{v}_n, round_even(coalesce(sum(CASE WHEN l_returnflag = '{v}' THEN l_quantity END), 0), 6) AS t_{v}_sum, round_even(coalesce(sum(CASE WHEN l_returnflag = '{v}' THEN l_quantity END), 0) / sum(l_quantity), 6) AS t_{v}_share" for v in "ANR") + """
FROM lineitem GROUP BY 1""")
def type_zone_pivot(spark, sf_dir):
    """Counts, sums and shares by type within zone."""
    out = table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(*aggregates.conditional_sums("l_returnflag", ["A", "N", "R"], "l_quantity", "t"))
    return out.select(*[half_even(c).alias(c) if c.endswith(("_sum", "_share")) else c for c in out.columns])


@query("SELECT c_mktsegment, count(*) AS n, round_even(quantile_cont(CAST(c_acctbal AS DOUBLE), 0.5), 6) AS mid FROM customer GROUP BY 1")
def group_median(spark, sf_dir):
    """Exact median per group."""
    m = aggregates.exact_percentiles(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal", [0.5])
    return m.select("c_mktsegment", "n", half_even(F.get("q", F.lit(0))).alias("mid"))


@query("""
SELECT l_returnflag, """ + ", ".join(f"round_even(quantile_cont(l_extendedprice, {q}), 6) AS p{round(100 * q)}" for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + """,
 min(l_extendedprice) AS low, max(l_extendedprice) AS high, round_even(avg(l_quantity), 6) AS mean, round_even(stddev_pop(l_quantity), 6) AS sd, round_even(stddev_pop(l_quantity) / avg(l_quantity), 6) AS cv
FROM lineitem GROUP BY 1""")
def percentile_report(spark, sf_dir):
    """Interpolated percentiles and the usual moments (population deviation)."""
    shares = [0.05, 0.25, 0.5, 0.75, 0.95]
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity")
    places = aggregates.exact_percentiles(li, ["l_returnflag"], "l_extendedprice", shares).select("l_returnflag", *[F.get("q", F.lit(k)).alias(f"p{round(100 * q)}") for k, q in enumerate(shares)])
    out = li.groupBy("l_returnflag").agg(F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), F.avg("l_quantity").alias("mean"), F.stddev_pop("l_quantity").alias("sd"))
    out = out.join(places, "l_returnflag").withColumn("cv", F.col("sd") / F.col("mean"))
    return out.select("l_returnflag", "low", "high", *[half_even(c).alias(c) for c in ("p5", "p25", "p50", "p75", "p95", "mean", "sd", "cv")])


@query(f"WITH {SCORED_SQL} SELECT truth AS label, n, round_even(n / sum(n) OVER (), 6) AS share FROM (SELECT truth, count(*) AS n FROM judged GROUP BY 1) QUALIFY row_number() OVER (ORDER BY n DESC, truth) = 1")
def majority_baseline(spark, sf_dir):
    """Share of the most frequent class."""
    return aggregates.majority_share(judged(spark, sf_dir), "truth").withColumn("share", half_even("share"))


@query(f"WITH {SCORED_SQL} SELECT truth, count(*) AS n, sum(hit)::BIGINT AS k, round_even(avg(hit), 6) AS accuracy FROM judged GROUP BY 1")
def accuracy_by_class(spark, sf_dir):
    """k of n per true class."""
    return judged(spark, sf_dir).groupBy("truth").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("k"), half_even(F.avg(F.col("ok").cast("double"))).alias("accuracy"))


@query(f"WITH {SCORED_SQL} SELECT count(*) AS n_classes, round_even(avg(r), 6) AS balanced FROM (SELECT truth, avg(hit) AS r FROM judged GROUP BY 1)")
def balanced_accuracy(spark, sf_dir):
    """Mean recall."""
    return aggregates.balanced_accuracy(judged(spark, sf_dir), "truth", "ok").withColumn("balanced", half_even("balanced"))


@query(f"""WITH {SCORED_SQL}, l(c) AS (VALUES ('band'), ('wrap'), ('left'), ('right')), cells AS (SELECT a.c AS truth, b.c AS said FROM l a, l b)
SELECT cells.truth, cells.said, count(doc_id) AS n FROM cells LEFT JOIN judged j ON j.truth = cells.truth AND j.said = cells.said GROUP BY 1, 2""")
def confusion_matrix(spark, sf_dir):
    """All cells of truth against decision, zeros kept."""
    return aggregates.confusion(judged(spark, sf_dir), "truth", "said", list(decide.CLASSES))


@query(f"""WITH {SCORED_SQL}, t AS (SELECT truth AS c, count(*) AS a FROM judged GROUP BY 1), s AS (SELECT said AS c, count(*) AS b FROM judged GROUP BY 1),
e AS (SELECT (SELECT count(*) FROM judged) AS n, (SELECT avg(hit) FROM judged) AS po, (SELECT sum(a * b) FROM t JOIN s USING (c)) / ((SELECT count(*) FROM judged) * (SELECT count(*) FROM judged)) AS pe)
SELECT n, round_even(po, 6) AS accuracy, round_even(pe, 6) AS expected, round_even(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) ELSE 0 END, 6) AS kappa FROM e""")
def cohen_kappa(spark, sf_dir):
    """Agreement beyond chance."""
    k = aggregates.kappa(judged(spark, sf_dir), "truth", "said")
    return k.select("n", *[half_even(c).alias(c) for c in ("accuracy", "expected", "kappa")])


@query(f"""WITH {SCORED_SQL}, l AS (SELECT truth AS label FROM judged UNION SELECT said FROM judged),
m AS (SELECT label, (SELECT count(*) FROM judged WHERE truth = label) AS t, (SELECT count(*) FROM judged WHERE said = label) AS s, (SELECT count(*) FROM judged WHERE said = label AND truth = label) AS h FROM l),
r AS (SELECT label, t, coalesce(h / nullif(s, 0), 0) AS p, coalesce(h / nullif(t, 0), 0) AS q FROM m)
SELECT label, t AS support, round_even(p, 6) AS precision, round_even(q, 6) AS recall, round_even(coalesce(2 * p * q / nullif(p + q, 0), 0), 6) AS f1 FROM r""")
def class_report(spark, sf_dir):
    """Precision, recall and F1 per class."""
    r = aggregates.class_report(judged(spark, sf_dir), "truth", "said")
    return r.select("label", "support", *[half_even(c).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH {SCORED_SQL}, r AS (SELECT hit, rank() OVER (ORDER BY conf) + (count(*) OVER (PARTITION BY conf) - 1) / 2 AS rk FROM judged),
s AS (SELECT sum(hit)::BIGINT AS n_pos, (count(*) - sum(hit))::BIGINT AS n_neg, sum(CASE WHEN hit = 1 THEN rk END) AS rs FROM r)
SELECT n_pos, n_neg, round_even((rs - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg), 6) AS auc FROM s""")
def auc_mann_whitney(spark, sf_dir):
    """How well confidence tells right from wrong."""
    return aggregates.auc(judged(spark, sf_dir), "conf", "ok").withColumn("auc", half_even("auc"))


@query("SELECT source, count(*) AS n, substr(sha256(string_agg(CAST(doc_id AS VARCHAR) || '|', '' ORDER BY doc_id)), 1, 16) AS fingerprint FROM documents GROUP BY 1")
def fingerprint(spark, sf_dir):
    """Fingerprint of each source's ids in order."""
    return aggregates.fingerprint(table(spark, sf_dir, "documents"), "source", "doc_id", "doc_id")


@query(f"""WITH {SCORED_SQL}, g AS (SELECT lang, avg(hit) AS acc, count(*) AS n, avg(CASE WHEN conf >= 0.6 THEN 1.0 ELSE 0 END) AS cov FROM judged GROUP BY 1)
SELECT round_even(sum(n * acc) / sum(n), 6) AS by_count, round_even(sum(cov * acc) / sum(cov), 6) AS by_coverage FROM g""")
def weighted_combo(spark, sf_dir):
    """Accuracy of several groups, weighted by their size and by their coverage."""
    g = judged(spark, sf_dir).groupBy("lang").agg(F.avg(F.col("ok").cast("double")).alias("acc"), F.count(F.lit(1)).alias("n"), F.avg((F.col("conf") >= 0.6).cast("double")).alias("cov"))
    return g.agg(half_even(aggregates.weighted("acc", "n")).alias("by_count"), half_even(aggregates.weighted("acc", "cov")).alias("by_coverage"))


@query(f"""WITH {SCORED_SQL}, g AS (SELECT lang, avg(hit) AS total, avg(CASE WHEN conf >= 0.6 THEN 1.0 ELSE 0 END) AS f, coalesce(avg(CASE WHEN conf >= 0.6 THEN hit END), 0) AS acc FROM judged GROUP BY 1)
SELECT lang, round_even(f, 6) AS share, round_even(CASE WHEN 1 - f > 1e-9 THEN (total - f * acc) / (1 - f) END, 6) AS residual FROM g""")
def residual_accuracy(spark, sf_dir):
    """Accuracy of what is deferred, from the whole and the accepted part."""
    sure = F.col("conf") >= 0.6
    g = judged(spark, sf_dir).groupBy("lang").agg(F.avg(F.col("ok").cast("double")).alias("total"), F.avg(sure.cast("double")).alias("f"), F.coalesce(F.avg(F.when(sure, F.col("ok").cast("double"))), F.lit(0.0)).alias("acc"))
    return g.select("lang", half_even("f").alias("share"), half_even(aggregates.residual_accuracy(F.col("total"), F.col("f"), F.col("acc"))).alias("residual"))


@query("""
WITH m AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS mid FROM lineitem GROUP BY 1),
d AS (SELECT l.*, mid, abs(l_extendedprice - mid) AS dev FROM lineitem l JOIN m USING (l_returnflag)),
s AS (SELECT l_returnflag, 1.4826 * quantile_cont(dev, 0.5) AS mad FROM d GROUP BY 1),
z AS (SELECT d.*, mad, (l_extendedprice - mid) / mad AS z FROM d JOIN s USING (l_returnflag))
SELECT l_returnflag, round_even(any_value(mid), 6) AS mid, round_even(any_value(mad), 6) AS mad, count_if(abs(z) > 1) AS n1, count_if(abs(z) > 2) AS n2, round_even(max(z), 6) AS top FROM z GROUP BY 1""")
def robust_z(spark, sf_dir):
    """Outliers by median and MAD."""
    z = aggregates.robust_z(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice"), "l_returnflag", "l_extendedprice")
    return z.groupBy("l_returnflag").agg(half_even(F.first("mid")).alias("mid"), half_even(F.first("mad")).alias("mad"), F.count_if(F.abs("z") > 1).alias("n1"), F.count_if(F.abs("z") > 2).alias("n2"), half_even(F.max("z")).alias("top"))


@query(f"""WITH {SCORED_SQL}, k AS (SELECT *, doc_id % 11 = 3 AS disputed FROM judged)
SELECT count(*) AS n_all, sum(hit)::BIGINT AS k_all, round_even(avg(hit), 6) AS acc_all, count_if(NOT disputed) AS n_clear, sum(CASE WHEN NOT disputed THEN hit ELSE 0 END)::BIGINT AS k_clear,
  round_even(sum(CASE WHEN NOT disputed THEN hit ELSE 0 END) / count_if(NOT disputed), 6) AS acc_clear FROM k""")
def rescoring_without_disputed(spark, sf_dir):
    """The same decisions scored with and without disputed labels."""
    clear = F.col("doc_id") % 11 != 3
    out = judged(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_all"), F.count_if("ok").alias("k_all"), F.count_if(clear).alias("n_clear"), F.count_if(clear & F.col("ok")).alias("k_clear"))
    return out.select("n_all", "k_all", half_even(F.col("k_all") / F.col("n_all")).alias("acc_all"), "n_clear", "k_clear", half_even(F.col("k_clear") / F.col("n_clear")).alias("acc_clear"))


@query(f"""WITH {SCORED_SQL}, s AS (SELECT ('0x' || substr(md5(source), 1, 8))::UBIGINT % 5 AS seed, avg(hit) AS acc FROM judged GROUP BY 1)
SELECT count(*) AS n_seeds, round_even(avg(acc), 6) AS mean, round_even(min(acc), 6) AS low, round_even(max(acc), 6) AS high FROM s""")
def range_over_seeds(spark, sf_dir):
    """Mean and range of accuracy over repetitions (here: folds)."""
    from ..operators.tables import hash_folds

    s = hash_folds(judged(spark, sf_dir), "source", 5).groupBy("fold").agg(F.avg(F.col("ok").cast("double")).alias("acc"))
    return s.agg(F.count(F.lit(1)).alias("n_seeds"), half_even(F.avg("acc")).alias("mean"), half_even(F.min("acc")).alias("low"), half_even(F.max("acc")).alias("high"))


@query(f"""WITH {SCORED_SQL}, g AS (SELECT truth, count(DISTINCT source) AS groups FROM judged GROUP BY 1) SELECT min(groups) AS fewest, least(5, min(groups)) AS folds FROM g""")
def fold_count(spark, sf_dir):
    """How many folds the rarest class's groups allow."""
    g = judged(spark, sf_dir).groupBy("truth").agg(F.count_distinct("source").alias("groups"))
    return g.agg(F.min("groups").alias("fewest"), F.least(F.lit(5).cast("long"), F.min("groups")).alias("folds"))
