"""Queries that learn: nodes, out-of-fold scores, calibrators, intervals, folds, exams.  Where there is no SQL, rows only: those fits are beyond it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import half_even
from ..operators import aggregates, calibration, decide, learning, tables
from .registry import query, table
from .scored import FEATURES, SCORED_SQL, judged

NAMES = {"p_band": ["f_upper", "f_symbol", "f_line"], "p_wrap": ["f_symbol", "f_size", "f_space"], "p_left": ["f_space", "f_upper"]}


@query()
def fit_nodes(spark, sf_dir):
    """Coefficient tables of the three nodes."""
    nodes = learning.fit_nodes(judged(spark, sf_dir), NAMES)
    out = None
    for k, m in nodes.items():
        t = m.table(spark).withColumn("node", F.lit(k))
        out = t if out is None else out.unionByName(t)
    return out


@query()
def oof_scores(spark, sf_dir):
    """Each labelled document decided by nodes that never saw its source."""
    rows = tables.hash_folds(judged(spark, sf_dir).drop(*NAMES, "said", "conf", "ok"), "source", 3)
    scored = learning.out_of_fold(rows, "fold", 3, lambda d: learning.fit_nodes(d, NAMES), learning.score_nodes)
    chain = decide.chained("p_band", "p_wrap", "p_left")
    out = scored.withColumn("said", chain["label"]).withColumn("conf", chain["conf"])
    return out.select("doc_id", "fold", "truth", "said", half_even("conf").alias("conf"))


_BLOCKS = """u AS (SELECT conf, sum(hit) AS s, count(*) AS n FROM judged GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY conf) AS i FROM u),
c AS (SELECT *, sum(s) OVER (ORDER BY i) AS cs, sum(n) OVER (ORDER BY i) AS cn FROM o),
m AS (SELECT a.i AS j, b.i AS k, (b.cs - a.cs + a.s) * 1.0 / (b.cn - a.cn + a.n) AS mean FROM c a JOIN c b ON b.i >= a.i),
low AS (SELECT j, k, min(mean) OVER (PARTITION BY j ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM m),
iso AS (SELECT k AS i, max(v) AS v FROM low GROUP BY 1)"""


@query(f"WITH {SCORED_SQL}, {_BLOCKS} SELECT doc_id, judged.conf AS conf, round_even(least(greatest(iso.v, 0), 1), 6) AS calibrated FROM judged JOIN c ON c.conf = judged.conf JOIN iso USING (i)")
def isotonic_calibration(spark, sf_dir):
    """Confidence through the non-decreasing calibrator."""
    j = judged(spark, sf_dir)
    return j.select("doc_id", "conf", half_even(learning.interpolated("conf", learning.isotonic(j, "conf", "ok"))).alias("calibrated"))


@query()
def platt_calibration(spark, sf_dir):
    """Confidence through the logistic calibrator."""
    from ..functions.scalars import logit

    j = judged(spark, sf_dir)
    m = learning.platt(j, "conf", "ok")
    return j.withColumn("_logit", logit("conf")).select("doc_id", "conf", half_even(m.probability()).alias("calibrated"))


_BOOT = """b AS (SELECT hit, CASE WHEN conf >= 0.6 THEN hit ELSE 0 END AS sure_hit, CASE WHEN conf >= 0.6 THEN 1 ELSE 0 END AS sure FROM judged),
per AS (SELECT hit, sure_hit, sure, CAST(count(*) AS DOUBLE) AS c FROM b GROUP BY ALL),
h AS (SELECT *, md5('7,' || hit || ',' || sure_hit || ',' || sure || ',' || sample) AS h FROM per, range(0, 2000) t(sample)),
z AS (SELECT *, list_sum(list_transform(range(0, 10), lambda k: CAST(CAST(('0x' || substr(h, CAST(3 * k + 1 AS INTEGER), 3)) AS BIGINT) AS DOUBLE))) AS total FROM h),
t AS (SELECT *, greatest(round_even(c + sqrt(c) * (total / 4096.0 - 40950 / 8192.0) / sqrt(10.0 / 12), 0), 0) AS t FROM z),
s AS (SELECT sample, sum(t * hit) / sum(t) AS hit, sum(t * sure_hit) / sum(t) AS sure_hit, sum(t * sure) / sum(t) AS sure FROM t GROUP BY 1),
f AS (SELECT 'accuracy' AS figure, hit AS v FROM s UNION ALL SELECT 'accuracy_sure', sure_hit / nullif(sure, 0) FROM s UNION ALL SELECT 'difference', sure_hit / nullif(sure, 0) - hit FROM s)"""


@query(f"WITH {SCORED_SQL}, {_BOOT} SELECT figure, round_even(quantile_cont(v, 0.025), 6) AS low, round_even(avg(v), 6) AS mean, round_even(quantile_cont(v, 0.975), 6) AS high FROM f WHERE v IS NOT NULL GROUP BY 1")
def bootstrap_ci(spark, sf_dir):
    """95 % intervals of accuracy, of accuracy above a floor, and of their paired difference, over 2,000 samples."""
    j = judged(spark, sf_dir).select(F.col("ok").cast("int").alias("hit"), ((F.col("conf") >= 0.6) & F.col("ok")).cast("int").alias("sure_hit"), (F.col("conf") >= 0.6).cast("int").alias("sure"))
    s = learning.bootstrap(j, ["hit", "sure_hit", "sure"], samples=2000, seed=7)
    above = F.try_divide(F.col("sure_hit"), F.col("sure"))
    figures = s.select(F.explode(F.array(*[F.struct(F.lit(n).alias("figure"), v.alias("v")) for n, v in (("accuracy", F.col("hit")), ("accuracy_sure", above), ("difference", above - F.col("hit")))])).alias("e")).select("e.*").where("v IS NOT NULL")
    q = F.percentile("v", [0.025, 0.975])
    return figures.groupBy("figure").agg(q.alias("q"), F.avg("v").alias("m")).select("figure", half_even(F.get("q", F.lit(0))).alias("low"), half_even("m").alias("mean"), half_even(F.get("q", F.lit(1))).alias("high"))


@query()
def family_choice(spark, sf_dir):
    """Two families of columns examined out of fold, and the one that the rule takes."""
    rows = tables.hash_folds(judged(spark, sf_dir).withColumn("good", (F.col("truth") != "band").cast("int")), "source", 2)
    figures = {}
    for name, columns in (("shape", ["f_size", "f_space", "f_line"]), ("all", list(FEATURES))):
        oof = learning.out_of_fold(rows, "fold", 2, lambda d, c=columns: learning.fit_logistic(d, c, "good"), lambda d, m: d.withColumn("p", m.probability()))
        hit = ((F.col("p") > 0.5).cast("int") == F.col("good")).cast("double")
        row = oof.agg(F.avg(hit), F.abs(F.avg(F.greatest("p", 1 - F.col("p"))) - F.avg(hit))).first()
        figures[name] = (100 * row[0], row[1])
    chosen = learning.choose_family(figures)
    return spark.createDataFrame([(k, round(a, 4), round(e, 6), k == chosen) for k, (a, e) in figures.items()], "family string, accuracy double, ece double, chosen boolean")


_FOLDS = """g AS (SELECT source, truth, count(*) AS n FROM judged GROUP BY 1, 2),
s AS (SELECT source, sum(n) AS n, arg_min(truth, (-n, truth)) AS stratum FROM g GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY n DESC, md5(source), source) - 1 AS k, dense_rank() OVER (ORDER BY stratum) - 1 AS i FROM s)"""


@query(f"WITH {SCORED_SQL}, {_FOLDS} SELECT source, CAST(((CASE WHEN (k // 3) % 2 = 0 THEN k % 3 ELSE 2 - k % 3 END) + i) % 3 AS INTEGER) AS fold FROM r")
def stratified_folds(spark, sf_dir):
    """Sources dealt over three folds, evenly within each stratum of classes."""
    return learning.dealt_group_folds(judged(spark, sf_dir), "source", "truth", 3)


def _sessions(j):
    """Two sessions of the judged documents, by the first digit of their source's MD5."""
    return j.withColumn("session", F.when(F.substring(F.md5("source"), 1, 1) < "8", "a").otherwise("b"))


_EXAM = f"""x AS (SELECT *, CASE WHEN substr(md5(source), 1, 1) < '8' THEN 'a' ELSE 'b' END AS session FROM judged),
bins(lo, hi) AS (VALUES (0.0, 0.5), (0.5, 0.7), (0.7, 0.85), (0.85, 0.95), (0.95, 1.01)),
learnt AS (SELECT session, lo, hi, avg(hit) AS acc FROM x JOIN bins ON conf >= lo AND conf < hi GROUP BY 1, 2, 3 HAVING count(*) >= 10)"""


@query(f"""WITH {SCORED_SQL}, {_EXAM} SELECT l.way, count(*) AS n, round_even(avg(hit), 6) AS accuracy, round_even(avg((p - hit) * (p - hit)), 6) AS brier FROM (
 SELECT CASE x.session WHEN 'a' THEN 'b_to_a' ELSE 'a_to_b' END AS way, x.hit, coalesce(learnt.acc, 0) AS p FROM x LEFT JOIN learnt ON learnt.session <> x.session AND conf >= learnt.lo AND conf < learnt.hi) l GROUP BY 1""")
def cross_session_exam(spark, sf_dir):
    """The bin calibrator of one session examined on the other, both ways: Brier score and accuracy."""
    rows = _sessions(judged(spark, sf_dir))
    sides = {s: rows.where(F.col("session") == s) for s in "ab"}
    fit = lambda d: calibration.bin_table(d, "conf", "ok")
    hit = F.col("ok").cast("double")
    judge = lambda d, bins: learning.by_bins(d, bins, "conf", "p").agg(F.count(F.lit(1)).alias("n"), half_even(F.avg(hit)).alias("accuracy"), half_even(F.avg((F.col("p") - hit) ** 2)).alias("brier"))
    both = learning.cross_exam(sides["a"], sides["b"], fit, judge)
    return both["a_to_b"].select(F.lit("a_to_b").alias("way"), "*").unionByName(both["b_to_a"].select(F.lit("b_to_a").alias("way"), "*"))


@query(f"""WITH {SCORED_SQL}, bins(lo, hi) AS (VALUES (0.0, 0.5), (0.5, 0.7), (0.7, 0.85), (0.85, 0.95), (0.95, 1.01)),
learnt AS (SELECT lo, hi, avg(hit) AS acc FROM judged JOIN bins ON conf >= lo AND conf < hi GROUP BY 1, 2 HAVING count(*) >= 10)
SELECT doc_id, conf, round_even(coalesce(acc, 0), 6) AS calibrated FROM judged LEFT JOIN learnt ON conf >= lo AND conf < hi""")
def bin_calibration(spark, sf_dir):
    """Confidence through the bin calibrator: the measured accuracy of its bin, 0 without enough rows."""
    j = judged(spark, sf_dir)
    return learning.by_bins(j, calibration.bin_table(j, "conf", "ok"), "conf", "p").select("doc_id", "conf", half_even("p").alias("calibrated"))


_SETS = {"symbols": ("f_symbol",), "shape": ("f_size", "f_space"), "background": ("noise",)}


@query(f"""WITH {SCORED_SQL}, x AS (SELECT *, CAST(CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 6)) AS BIGINT) AS DOUBLE) / 16777216 AS noise, truth = 'band' AS pos FROM judged),
v AS ({' UNION ALL '.join(f"SELECT '{k}' AS family, pos, {' + '.join(f'round_even({c}, 9)' for c in cols)} AS v FROM x" for k, cols in _SETS.items())}),
r AS (SELECT family, pos, rank() OVER w + (count(*) OVER (PARTITION BY family, v) - 1) / 2.0 AS r FROM v WINDOW w AS (PARTITION BY family ORDER BY v)),
a AS (SELECT family, count_if(pos) AS p, count_if(NOT pos) AS q, sum(CASE WHEN pos THEN r END) AS s FROM r GROUP BY 1)
SELECT family, round_even(abs((s - p * (p + 1) / 2.0) / (p * q) - 0.5), 6) AS figure FROM a""")
def feature_ablation(spark, sf_dir):
    """How far sets of columns tell classes apart (area under the curve off one half); noise alone is the control."""
    noise = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 6), 16, 10).cast("double") / 16777216
    x = judged(spark, sf_dir).withColumn("noise", noise).withColumn("pos", F.col("truth") == "band")

    def run(columns):
        total = sum((half_even(c, 9) for c in columns[1:]), half_even(columns[0], 9))
        return aggregates.auc(x.withColumn("v", total), "v", "pos").select(half_even(F.abs(F.col("auc") - 0.5)).alias("figure"))

    out = None
    for family, figure in learning.ablation({k: list(v) for k, v in _SETS.items()}, run).items():
        row = figure.select(F.lit(family).alias("family"), "figure")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"""WITH {SCORED_SQL}, fold AS (SELECT *, CAST(CAST(('0x' || substr(md5(source), 1, 8)) AS BIGINT) % 3 AS INTEGER) AS f FROM judged),
e AS (SELECT f, 'chain' AS family, avg(hit) AS v FROM fold GROUP BY 1 UNION ALL SELECT f, 'plain', avg(CASE WHEN truth = 'wrap' THEN 1.0 ELSE 0 END) FROM fold GROUP BY 1)
SELECT CAST(f AS BIGINT) AS fold, arg_min(family, (-round_even(v, 6), family)) AS family, max(round_even(v, 6)) AS accuracy FROM e GROUP BY 1""")
def best_of_two(spark, sf_dir):
    """Of two families the better one on each partition: the optimistic figure."""
    rows = tables.hash_folds(judged(spark, sf_dir), "source", 3)
    figure = lambda name, ok: rows.groupBy("fold").agg(half_even(F.avg(ok.cast("double"))).alias("accuracy")).withColumn("family", F.lit(name))
    return learning.best_of(figure("chain", F.col("ok")).unionByName(figure("plain", F.col("truth") == "wrap")), "fold", "family", "accuracy")


@query(f"WITH {SCORED_SQL}, p AS (SELECT said, hit FROM judged, range(0, 6) t(run)) SELECT said, count(*) AS n, round_even(avg(hit), 6) AS accuracy FROM p GROUP BY 1")
def pooled_trainings(spark, sf_dir):
    """Six trainings of the same model, whose seed changes nothing, pooled: six times the decisions, the same figures."""
    j = judged(spark, sf_dir).select("doc_id", "said", "ok")
    return learning.pooled([j] * 6).groupBy("said").agg(F.count(F.lit(1)).alias("n"), half_even(F.avg(F.col("ok").cast("double"))).alias("accuracy"))


@query("""WITH t AS (SELECT c_custkey AS id, c_acctbal AS a, c_acctbal / 2 + c_nationkey * 10 AS b, 100.0 + c_nationkey AS sd, c_mktsegment AS name FROM customer)
SELECT id, round_even((a - b) / (sd + 1e-6), 6) AS by_sd, round_even(abs((a - b) / (sd + 1e-6)), 6) AS by_sd_size, round_even((a - b) / (abs(a) + abs(b) + 1e-6), 6) AS by_sum,
 CASE WHEN name = 'BUILDING' THEN 'houses' WHEN starts_with(name, 'AUTO') THEN 'car ' || replace(substr(name, 5), '_', ' ') ELSE replace(name, '_', ' ') END AS pretty,
 CASE WHEN a > 0 THEN round_even(2 * sqrt(a / pi()) * 0.1 * 25.4, 6) END AS diameter FROM t""")
def side_contrasts(spark, sf_dir):
    """Side contrasts over a deviation or over both sides, names for readers, units."""
    from ..functions import scalars

    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("a"), (F.col("c_acctbal") / 2 + F.col("c_nationkey") * 10).alias("b"), (100.0 + F.col("c_nationkey")).alias("sd"), F.col("c_mktsegment").alias("name"))
    by_sd, by_sum = scalars.contrast("a", "b", "sd"), scalars.contrast("a", "b")
    return t.select("id", half_even(by_sd["signed"]).alias("by_sd"), half_even(by_sd["size"]).alias("by_sd_size"), half_even(by_sum["signed"]).alias("by_sum"), scalars.pretty_name("name", {"BUILDING": "houses"}, {"AUTO": "car "}).alias("pretty"), F.when(F.col("a") > 0, half_even(scalars.diameter_mm("a", F.lit(0.1)))).alias("diameter"))
