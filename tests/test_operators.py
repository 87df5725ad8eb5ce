"""Edge cases of the relational operators: ties, unknowns, boundaries, supports."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradewell.functions import scalars
from gradewell.operators import aggregates, decide, ordered, series, tables
from gradewell.operators import calibration as cal


def one(spark, column, **values):
    cols = ", ".join(values) or "x"
    types = {bool: "boolean", int: "long", float: "double", str: "string", type(None): "double"}
    schema = ", ".join(f"{k} {types[type(v)]}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("r")).first().r if cols else None


def test_numbers_and_paths(spark):
    cases = {"1.5": 1.5, " 1.5 ": 1.5, "": None, "nan": None, "x": None, "-2e3": -2000.0, "0": 0.0}
    for text, want in cases.items():
        assert one(spark, scalars.clean_double("t"), t=text) == want
    assert one(spark, scalars.basename("p"), p="a/b\\c d.jpg") == "c d.jpg"
    assert (one(spark, scalars.stem("p"), p="a/b.tar.gz"), one(spark, scalars.folder("p"), p="a/b/c.x")) == ("b.tar", "a/b")
    assert one(spark, scalars.decimal_comma("x"), x=1.25) == "1,25"
    assert one(spark, scalars.number_in("t", r"kappa\s+([0-9.]+)"), t="kappa  0.7 of") == 0.7


def test_ratios_and_angles(spark):
    assert one(spark, scalars.asymmetry("l", "r"), l=None, r=1.0) is None
    assert one(spark, scalars.guarded_ratio("p", "w"), p=3.0, w=1.0) is None and one(spark, scalars.guarded_ratio("p", "w"), p=3.0, w=2.0) == 1.5
    assert one(spark, scalars.lerp("x", 14.7, 0.0, 16.9, 1.0), x=20.0) == 1 and one(spark, scalars.lerp("x", 14.7, 0.0, 16.9, 1.0), x=None) is None
    assert [one(spark, scalars.fold_axis("a"), a=a) for a in (95.0, 90.0, -95.0)] == [-85, 90, 85]
    assert [one(spark, scalars.shortest_turn("a"), a=a) for a in (181.0, 180.0, -190.0)] == [-179, 180, 170]
    assert math.isclose(one(spark, scalars.logit("p"), p=1.0), math.log((1 - 1e-6) / 1e-6))
    assert one(spark, scalars.renormalise(F.array(F.lit(0.0), F.lit(0.0)))) == [0, 0]
    assert [one(spark, scalars.code_to_bin("c"), c=c) for c in (0, 1, 9, 10, 15)] == [9, 1, 9, 9, 9]
    assert one(spark, scalars.bit_text("c"), c=5) == "0101" and one(spark, scalars.code_of(scalars.bits_of("c")), c=11) == 11
    places = one(spark, scalars.arc_places(3, 2.0, 90.0, 90.0))
    assert [(round(p.x, 9), round(p.y, 9)) for p in places] == [(2, 0), (0, 2), (-2, 0)]


def test_dedup_ties_and_unknowns(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.5), ("a", 3, None), ("b", 1, None), ("b", 2, 0.1)], "g string, pos int, v double")
    assert {(r.g, r.pos) for r in tables.best_per_group(df, "g", "v", "pos").collect()} == {("a", 1), ("b", 2)}
    assert {(r.g, r.pos) for r in tables.first_row_if_unknown(df, "g", "v", "pos").collect()} == {("a", 1), ("b", 1)}
    assert {(r.g, r.pos) for r in tables.last_per_key(df, "g", "pos").collect()} == {("a", 3), ("b", 2)}


def test_semi_join_after_argmin_loses_the_item(spark):
    photos = spark.createDataFrame([("leaf", "p1", 0.2), ("leaf", "p2", 0.3)], "leaf string, path string, v double")
    has = spark.createDataFrame([("p2",)], "path string")
    assert tables.best_per_group(photos, "leaf", "v", "path").join(has, "path", "left_semi").count() == 0


def test_flags_doubts_and_merges(spark):
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    flags = spark.createDataFrame([("a", "0", "0"), ("b", "0", "1"), ("b", "", "0")], "k string, edge string, base string")
    assert [r.k for r in tables.eligible(items, flags, "k", (F.col("edge") == "0") & (F.col("base") == "0")).collect()] == ["a"]
    doubt = spark.createDataFrame([("a", "omitted_20260904"), ("b", "settled")], "k string, state string")
    assert sorted(r.k for r in tables.without_doubtful(items, doubt, "k", "state", ("omitted_", "pending")).collect()) == ["b", "c"]
    one_, two = spark.createDataFrame([("a", "")], "k string, v string"), spark.createDataFrame([("a", "x"), ("b", "y")], "k string, v string")
    assert {r.k: r.v for r in tables.first_wins("k", ["v"], items, one_, two).collect()} == {"a": "", "b": "y", "c": None}
    with pytest.raises(tables.MissingData, match="w"):
        tables.require_complete(items.withColumn("w", F.lit(None).cast("double")), ["k", "w"])


@pytest.mark.parametrize("n, wanted", [(1, 3), (2, 1), (5, 3), (10, 10), (17, 4), (3, 9)])
def test_even_sample(spark, n, wanted):
    m = min(n, wanted)
    want = sorted({0 if m == 1 else i * (n - 1) // (m - 1) for i in range(m)})
    assert sorted(r.o for r in tables.even_sample(spark.range(n).selectExpr("'g' AS g", "id AS o"), "g", "o", wanted).collect()) == want


def test_running_matches_a_plain_window(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.choice([0.1, 0.5, 0.50001, 0.9, 1.0])), int(rng.integers(0, 2))) for i in range(300)]
    df = spark.createDataFrame(rows, "pos long, conf double, ok long")
    for up in (True, False):
        want = sorted(rows, key=lambda r: (r[1] if up else -r[1], r[0]))
        for bounds in (None, (0.0, 1.0)):
            got = sorted(ordered.running(df, "conf", ["ok"], ("pos",), up, bounds=bounds).collect(), key=lambda r: r["rank"])
            assert [(r.pos, r.run_ok, r.total) for r in got] == [(p, sum(o for _, _, o in want[: k + 1]), 300) for k, (p, _, _) in enumerate(want)]


def test_bins_and_supports(spark):
    rows = [(0.2, 1)] * 9 + [(0.6, 1)] * 10 + [(1.0, 0)] * 12
    df = spark.createDataFrame(rows, "conf double, ok int")
    bins = {r.lo: r for r in cal.bin_table(df, "conf", "ok").collect()}
    assert set(bins) == {0.5, 0.95} and bins[0.95].hi == 1.0 and bins[0.5].frac == 10 / 31
    probe = spark.createDataFrame([(0.2,), (0.5,), (1.0,), (1.2,)], "conf double")
    assert [r.a for r in cal.bin_lookup(probe, cal.bin_table(df, "conf", "ok"), "conf", "a").orderBy("conf").collect()] == [None, 1.0, 0.0, 0.0]
    assert [r.n for r in cal.bin_table_all(spark, df, "conf", "ok").orderBy("lo").collect()] == [9, 0, 10, 0, 0, 12]
    many = spark.createDataFrame([("x", 0.5 + i / 100, i % 2, i) for i in range(24)] + [("y", 0.5 + i / 100, i % 2, i) for i in range(25)], "label string, conf double, ok int, pos int")
    assert {r.label for r in cal.class_curves(many, "label", "conf", "ok", "pos").collect()} == {"y"}


def test_curve_lookup_beyond_the_curve(spark):
    curve = spark.createDataFrame([(0.9, 0.95, 0.3), (0.6, 0.8, 0.7), (0.2, 0.6, 1.0)], "conf double, accuracy double, coverage double")
    probe = spark.createDataFrame([(0.1,), (0.6,), (0.7,), (0.95,)], "conf double")
    assert [r.m for r in cal.curve_lookup(probe, curve, "conf", "m").orderBy("conf").collect()] == [0.6, 0.8, 0.95, 0.6]
    assert cal.curve_lookup(probe, curve.limit(0), "conf", "m").where("m IS NOT NULL").count() == 0
    assert cal.operating_point(curve, 0.9, 0.04).first().cut == 0.9 and cal.operating_point(curve, 0.99, 0.0).first().cut == 1.01


def test_half_even_cuts(spark):
    df = spark.createDataFrame([(i, i / 5, 1) for i in range(5)], "pos long, conf double, ok int")
    kept = {r.fraction: r.kept for r in cal.reject_sweep(df, "conf", "ok", "pos", (0.5, 0.9, 1.0)).collect()}
    assert kept == {0.5: 2, 0.9: 1, 1.0: 1}  # 2.5 -> 2, 0.5 -> 0 -> 1
    down = {r.rate: (r.dropped, r.error) for r in cal.reject_sweep_ascending(df, "conf", "ok", "pos", (10, 30, 100)).collect()}
    assert down == {10: (0, 0.0), 30: (2, 0.0), 100: (5, None)}


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_exact_percentiles(spark, accuracy):
    rng = np.random.default_rng(2)
    groups = {"ties": rng.integers(0, 4, 700).astype(float), "wide": rng.lognormal(0, 3, 900), "one": np.array([5.0]), "two": np.array([1.0, 2.0]), None: np.arange(10.0)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("ties", None), ("empty", None)]
    shares = [0.0, 0.05, 0.5, 0.731, 1.0]
    got = {r.g: (r.n, r.q) for r in aggregates.exact_percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", shares, accuracy).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g][0] == len(vs) and np.allclose(got[g][1], np.quantile(vs, shares), rtol=1e-12)
    whole = aggregates.exact_percentiles(spark.createDataFrame(rows, "g string, v double"), [], "v", [0.5], accuracy).first()
    assert math.isclose(whole.q[0], np.quantile(np.concatenate(list(groups.values())), 0.5))


def test_agreement(spark):
    same = spark.createDataFrame([("a", "a", 1), ("a", "a", 1)], "t string, s string, ok int")
    assert aggregates.kappa(same, "t", "s").first().kappa == 0
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "t string, s string")
    report = {r.label: (r.support, r.precision, r.recall) for r in aggregates.class_report(df, "t", "s").collect()}
    assert report == {"a": (2, 0.5, 0.5), "b": (1, 0.5, 1.0), "c": (1, 0.0, 0.0)}
    assert aggregates.confusion(df, "t", "s", ["a", "b", "c"]).count() == 9
    scores = spark.createDataFrame([(0.1, 0), (0.5, 1), (0.5, 0), (0.9, 1)], "s double, p int")
    assert aggregates.auc(scores, "s", "p").first().auc == 0.875
    assert aggregates.auc(scores.where("p = 1"), "s", "p").first().auc is None


def test_chain_boundaries(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0.5), (0.51, 0.9, 0.9), (0.2, 0.51, 0.1), (0.0, 0.0, 0.3)], "b double, w double, x double")
    c = decide.chained("b", "w", "x")
    assert [(r.label, round(r.conf, 6)) for r in df.select(c["label"].alias("label"), c["conf"].alias("conf")).collect()] == [("left", 0.125), ("band", 0.51), ("wrap", 0.408), ("right", 0.7)]
    q = df.select("b", decide.soft_chain("b", "w", "x").alias("q"), c["label"].alias("label"))
    assert all(abs(sum(r.q) - 1) < 1e-12 for r in q.collect())
    assert [r.s for r in q.select(decide.second_best("q", "label").alias("s")).collect()][1] == "wrap"


def test_zero_rule(spark):
    rows = [(0.0, 0.0), (0.0, 1.0), (0.0, None)]
    df = spark.createDataFrame(rows, "l double, r double").withColumn("p", F.array(*map(F.lit, (0.2, 0.3, 0.4, 0.1)))).withColumn("s", F.array(*map(F.lit, (0.0, 0.0, 0.4, 0.6))))
    got = df.select(decide.zero_rule("p", "l", "r").alias("p"), decide.zero_rule("s", "l", "r").alias("s")).collect()
    assert [round(x, 9) for x in got[0].p] == [0.4, 0.6, 0, 0] and got[0].s == [0, 0, 0.4, 0.6]
    assert got[1].p == got[2].p == [0.2, 0.3, 0.4, 0.1]


def test_policies_and_routes(spark):
    df = spark.createDataFrame([("north", "band", 0.6), ("north", "band", 0.5999), ("south", "right", 1.0), ("east", "wrap", 0.9), ("north", "left", None)], "variety string, label string, conf double")
    p = decide.plain_policy("conf", "label", 0.6, {"left": 0.8})
    out = decide.route(df.withColumn("accept", p["accept"]).withColumn("veto", p["veto"]), decide.bins_table(spark), "variety", "label", "accept")
    assert [(r.bin, r.veto) for r in out.orderBy("variety", F.desc("conf")).collect()] == [(9, False), (1, False), (9, False), (9, True), (8, False)]
    df = spark.createDataFrame([(0.99, 0.96, 0.97), (0.99, None, 0.97), (0.99, 0.96, 0.90), (0.9, 0.9, None)], "v double, c double, top double")
    p = decide.prudent_policy("v", "c", "top")
    assert [(r.a, r.b) for r in df.select(p["accept"].alias("a"), p["veto"].alias("b")).collect()] == [(True, False), (False, False), (False, True), (False, False)]
    df = spark.createDataFrame([(0, 3), (None, 9), (2, 9), (2, 2), (2, 3)], "t int, b int")
    assert [r.o for r in df.select(decide.outcome("t", "b").alias("o")).collect()] == ["NO_LABEL", "NO_LABEL", "SPECIAL", "HIT", "ERROR"]


def test_impute_constant_and_missing(spark):
    df = spark.createDataFrame([(1.0, 5.0), (None, 5.0), (3.0, None)], "a double, b double")
    got = decide.impute_scale(df, ["a", "b"]).collect()
    assert [round(r.z_a, 6) for r in got] == [-1.224745, 0, 1.224745] and {r.z_b for r in got} == {0.0}


def test_contributions(spark):
    z = spark.createDataFrame([(1.0, -2.0, 2.0)], "z_a double, z_b double, z_c double")
    top = z.select(decide.contributions(["a", "b", "c"], {"a": 1.0, "b": 1.0, "c": 1.0}, F.lit(-1.0), 2).alias("c")).first().c
    assert [(e.feature, e.value) for e in top] == [("b", 2.0), ("c", -2.0)]


def test_series(spark):
    d = spark.createDataFrame([("k", i, v) for i, v in enumerate([None, 1.0, None, None, 4.0, None])], "k string, p int, v double")
    assert [r.v for r in series.fill_gaps(d, "k", "p", "v").orderBy("p").collect()] == [1, 1, 2, 3, 4, 4]
    m = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate([9, 1, 2, 8])], "k string, p int, v double")
    assert [r.mid for r in series.moving_median(m, "k", "p", "v", 1).orderBy("p").collect()] == [9, 2, 2, 8]
    e = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate([0, 0, 10, 10, 0])], "k string, p int, v double")
    assert series.edge_runs(e, "k", "p", "v", 0.18).first().asDict() == {"k": "k", "head": 2, "tail": 1, "base": "start", "margin": 1}
    marks = spark.createDataFrame([("k", 60.0 * i) for i in range(5)] + [("few", 1.0)], "k string, p double")
    best = series.dominant_period(series.comb_strength(marks, "k", "p"), "k").collect()
    assert [(r.k, r.period, round(r.strength, 9)) for r in best] == [("k", 60.0, 1.0)]


def test_running_in_many_ranges(spark):
    """Ranges by a sample of the order, ties included: a value that half the rows share is many ranges."""
    rng = np.random.default_rng(2)
    rows = [(i, 0.5 if i % 2 else float(rng.random()), int(rng.integers(0, 2))) for i in range(2000)]
    df = spark.createDataFrame(rows, "pos long, conf double, ok long").repartition(4)
    for up in (True, False):
        want = sorted(rows, key=lambda r: (r[1] if up else -r[1], r[0]))
        got = sorted(ordered.running(df, "conf", ["ok"], ("pos",), up, range_rows=150).collect(), key=lambda r: r["rank"])
        assert [r.pos for r in got] == [p for p, _, _ in want] and {r.total for r in got} == {2000}
        assert [r.run_ok for r in got] == np.cumsum([o for _, _, o in want]).tolist()


def test_set_cut_lookup_both_ways(spark):
    rng = np.random.default_rng(3)
    rows = [(i, round(float(rng.random()), 3), int(rng.integers(0, 2))) for i in range(1500)]
    df = spark.createDataFrame(rows + [(9999, None, 1)], "pos long, conf double, ok int")
    by = sorted(rows, key=lambda r: (-r[1], r[0]))
    first = np.mean([o for _, _, o in by[:20]])

    def want(c):
        above = [o for _, x, o in rows if x >= c]
        return np.mean(above) if len(above) >= 20 else first

    probe = spark.createDataFrame([(0.0,), (0.3,), (0.5004,), (0.99,), (1.5,), (None,)], "conf double")
    for most, block in ((65_536, 16), (65_536, 256), (10, 256)):
        got = {r.conf: r.a for r in cal.set_cut_lookup(probe, df, "conf", "conf", "ok", "pos", "a", most=most, block=block).collect()}
        assert got[None] is None and len(got) == 6
        assert all(abs(got[c] - want(c)) < 1e-12 for c in got if c is not None)
