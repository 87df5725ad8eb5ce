"""Learning operators: recovery of known models, isolation of folds, calibrators, intervals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradewell.operators import learning


def sample(spark, n=600, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    y = (rng.random(n) < 1 / (1 + np.exp(-(2 * x[:, 0] - 1)))).astype(int)
    rows = [(i, float(a) if i % 17 else None, float(b), int(c), f"g{i % 40}") for i, ((a, b), c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, y int, g string")


def test_logistic_finds_the_signal(spark):
    df = sample(spark)
    m = learning.fit_logistic(df, ["a", "b"], "y", balanced=False)
    assert m.weight["a"] > 1.2 and abs(m.weight["b"]) < 0.4 and m.intercept < -0.4
    assert m.table(spark).count() == 3
    again = learning.fit_logistic(df, ["a", "b"], "y", balanced=False)
    assert again.weight == m.weight  # nothing is random: another seed gives the same model
    none = learning.fit_logistic(df.withColumn("c", F.lit(None).cast("double")), ["a", "c"], "y")
    assert none.names == ["a"]
    one = learning.fit_logistic(df.where("y = 1"), ["a"], "y")
    assert df.select(one.probability().alias("p")).agg(F.min("p")).first()[0] > 0.99


def test_optimum_has_no_gradient(spark):
    """Balanced weights and a penalty of 1 / n: the gradient of the summed loss plus half the squared norm vanishes."""
    df = sample(spark)
    m = learning.fit_logistic(df, ["a", "b"], "y")
    n, p = df.count(), df.where("y = 1").count()
    w = F.when(F.col("y") == 1, n / (2 * p)).otherwise(n / (2 * (n - p)))
    r = w * (m.probability() - F.col("y"))
    g = df.agg(F.sum(r), *[F.sum(r * m.z(c)) for c in m.names]).first()
    assert abs(g[0]) < 1e-2
    assert all(abs(g[k + 1] + m.weight[c]) < 1e-2 for k, c in enumerate(m.names))


def test_folds_keep_groups_together(spark):
    df = sample(spark)
    folds = learning.stratified_group_folds(df, "g", "y", 4)
    assert folds.count() == 40
    per = df.join(folds, "g").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y")).collect()
    assert len(per) == 4 and max(r.n for r in per) <= 1.4 * min(r.n for r in per) and max(r.y for r in per) - min(r.y for r in per) < 0.1
    assert learning.stratified_group_folds(df, "g", "y", 4, most=10).groupBy("g").count().where("count > 1").count() == 0


def test_dealt_folds_are_stratified(spark):
    """A rare class is in every fold, however many groups there are."""
    rows = [(f"g{i}", "rare" if i % 50 == 0 else "wide" if i % 2 else "other") for i in range(600) for _ in range(1 + i % 4)]
    df = spark.createDataFrame(rows, "g string, y string")
    folds = learning.dealt_group_folds(df, "g", "y", 5)
    assert folds.count() == 600 and folds.select("g").distinct().count() == 600
    per = df.join(folds, "g").groupBy("fold", "y").count().collect()
    assert len(per) == 15
    by = {}
    for r in per:
        by.setdefault(r.y, []).append(r["count"])
    assert max(by["wide"]) <= 1.05 * min(by["wide"]) and max(by["rare"]) <= 3 * min(by["rare"])
    many = learning.stratified_group_folds(df, "g", "y", 5, most=100)
    assert {(r.g, r.fold) for r in many.collect()} == {(r.g, r.fold) for r in folds.collect()}
    assert learning.dealt_group_folds(df.limit(0), "g", "y", 5).count() == 0


def test_pooling_and_best_of(spark):
    one = spark.createDataFrame([(1, True), (2, False)], "id int, ok boolean")
    both = learning.pooled([one, one])
    assert both.count() == 4 and {r.run for r in both.collect()} == {0, 1}
    figures = spark.createDataFrame([(0, "a", 0.5), (0, "b", 0.75), (1, "a", 0.5), (1, "b", 0.5)], "p int, f string, v double")
    assert sorted(tuple(r) for r in learning.best_of(figures, "p", "f", "v").collect()) == [(0, "b", 0.75), (1, "a", 0.5)]
    sets = {"x": ["x"], "noise": ["n"]}
    assert learning.ablation(sets, lambda c: 0.9 if c == ["x"] else 0.5, background="noise")["x"] == 0.9
    with pytest.raises(ValueError):
        learning.ablation(sets, lambda c: 0.5, background="noise")


def test_out_of_fold_never_sees_its_fold(spark):
    df = sample(spark).withColumn("fold", F.col("id") % 3)
    seen = []

    def fit(train):
        seen.append({r.fold for r in train.select("fold").distinct().collect()})
        return len(seen)

    out = learning.out_of_fold(df, "fold", 3, fit, lambda d, m: d.withColumn("m", F.lit(m)))
    assert seen == [{1, 2}, {0, 2}, {0, 1}] and out.count() == df.count()
    assert out.groupBy("fold").agg(F.count_distinct("m").alias("k")).where("k <> 1").count() == 0


def test_nested_calibration_is_clean(spark):
    df = sample(spark, 90).withColumn("fold", F.col("id") % 3)
    fits, calibrations = [], []

    def folds_in(d):
        return frozenset(r.fold for r in d.select("fold").distinct().collect())

    def fit(train):
        fits.append(folds_in(train))
        return ",".join(map(str, sorted(fits[-1])))

    def calibrate(inner):
        calibrations.append(folds_in(inner))
        return lambda d, seen=sorted(calibrations[-1]): d.withColumn("calibrated_by", F.lit(",".join(map(str, seen))))

    out = learning.nested_calibration(df, "fold", 3, fit, lambda d, m: d.withColumn("scored_by", F.lit(m)), calibrate)
    assert out.count() == 90 and calibrations == [{1, 2}, {0, 2}, {0, 1}]
    for r in out.select("fold", "scored_by", "calibrated_by").distinct().collect():
        assert str(r.fold) not in r.scored_by and str(r.fold) not in r.calibrated_by


def test_calibrators(spark):
    rows = [(i / 200, int((i * 7919) % 200 < i)) for i in range(200)]
    df = spark.createDataFrame(rows, "conf double, ok int")
    knots = learning.isotonic(df, "conf", "ok")
    assert knots[1] == sorted(knots[1]) and 0 <= min(knots[1]) and max(knots[1]) <= 1
    got = [r.p for r in df.select("conf", learning.interpolated("conf", knots).alias("p")).orderBy("conf").collect()]
    assert got == sorted(got)
    const = learning.platt(df.withColumn("ok", F.lit(1)), "conf", "ok")
    assert all(abs(w) == 0 for w in const.weight.values())


def test_bootstrap_interval(spark):
    df = spark.range(400).select("id", (F.col("id") % 4 > 0).cast("int").alias("a"), (F.col("id") % 2).cast("int").alias("b"))
    s = learning.bootstrap(df, ["a", "b"], samples=400, seed=3)
    low, high, mean = learning.interval(s, F.col("a")).first()
    assert abs(mean - 0.75) < 0.005 and 0.69 < low < 0.73 < 0.77 < high < 0.81
    paired = learning.interval(s, F.col("a") - F.col("b")).first()
    assert paired.high - paired.low < 0.12
    n = s.agg(F.avg("n"), F.stddev("n")).first()
    assert abs(n[0] - 400) < 5 and abs(n[1] - 20) < 3


def test_family_rule():
    assert learning.choose_family({"a": (90.0, 0.09), "b": (88.0, 0.02)}) == "b"
    assert learning.choose_family({"a": (90.0, 0.09), "b": (86.0, 0.02)}) == "a"
    assert learning.choose_family({"a": (90.0, 0.09), "b": (86.5, 0.02)}) == "a"
    assert learning.choose_family({"a": (1.0, 0.1), "b": (2.0, 0.1)}, forced="b") == "b"


def test_boosted_trees_and_exams(spark):
    df = sample(spark, 200).na.fill(0.0).withColumn("c", (F.col("y") + (F.col("b") > 1).cast("int")).cast("double"))
    model = learning.boosted(df, ["a", "b"], "c", rounds=2)
    assert len(model.models) == df.select("c").distinct().count()
    judge = lambda d, m: d.agg(F.avg(((m.probability() > 0.5).cast("int") == F.col("y")).cast("double"))).first()[0]
    both = learning.cross_exam(df.where("id < 100"), df.where("id >= 100"), lambda d: learning.fit_logistic(d, ["a"], "y"), judge)
    assert min(both.values()) > 0.65
    figures = learning.ablation({"signal": ["a"], "background": ["b"]}, lambda c: judge(df, learning.fit_logistic(df, c, "y")))
    assert figures["signal"] > figures["background"]
