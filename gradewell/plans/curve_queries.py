"""Queries on calibration: bins, curves, sweeps, cuts and lookups; and on series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import half_even
from ..operators import calibration as cal
from ..operators import series
from ..sources.shared import kept
from .registry import query, table
from .scored import SCORED_SQL, judged


def rounded(df, *keep):
    """All double columns rounded, but for some."""
    return df.select(*[half_even(c).alias(c) if t == "double" and c not in keep else c for c, t in df.dtypes])


def _case(edges) -> str:
    return "CASE " + " ".join(f"WHEN conf >= {a} AND conf < {b} THEN {k}" for k, (a, b) in enumerate(zip(edges[:-1], edges[1:]))) + " END"


def _values(edges, top=None) -> str:
    return ", ".join(f"({k}, CAST({a} AS DOUBLE), CAST({min(b, top) if top else b} AS DOUBLE))" for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])))


BINS_SQL = f"""edges(bin, lo, hi) AS (VALUES {_values(cal.BINS, 1.0)}),
binned AS (SELECT {_case(cal.BINS)} AS bin, count(*) AS n, avg(conf) AS said, avg(hit) AS accuracy FROM judged GROUP BY 1),
bins AS (SELECT CAST(bin AS BIGINT) AS bin, lo, hi, n, n / (SELECT count(*) FROM judged) AS frac, said, accuracy FROM binned JOIN edges USING (bin) WHERE n >= {cal.MIN_BIN})"""

POINTS_SQL = "(SELECT DISTINCT CAST(floor(least({0}, n) - 1 + i * ((n - least({0}, n))::DOUBLE / 59)) AS BIGINT) + 1 AS rank{1} FROM {2}, range(0, 60) t(i))"
CURVE_SQL = f"""ranked AS (SELECT conf, hit, row_number() OVER w AS rank, sum(hit) OVER (w ROWS UNBOUNDED PRECEDING) AS run, count(*) OVER () AS n
  FROM judged WINDOW w AS (ORDER BY conf DESC, doc_id)),
curve AS (SELECT conf, run / rank AS accuracy, rank / n AS coverage FROM ranked JOIN {POINTS_SQL.format(cal.MIN_CURVE, '', '(SELECT count(*) AS n FROM judged)')} p USING (rank))"""
CLASS_SQL = f"""cranked AS (SELECT said AS label, conf, row_number() OVER w AS rank, sum(hit) OVER (w ROWS UNBOUNDED PRECEDING) AS run, count(*) OVER (PARTITION BY said) AS n
  FROM judged WINDOW w AS (PARTITION BY said ORDER BY conf DESC, doc_id)),
ccurves AS (SELECT label, conf, run / rank AS accuracy, rank / n AS coverage FROM cranked JOIN {POINTS_SQL.format(cal.MIN_CURVE, ', label', '(SELECT DISTINCT label, n FROM cranked)')} p USING (label, rank) WHERE n >= {cal.MIN_CLASS})"""


@query(f"WITH {SCORED_SQL}, {BINS_SQL} SELECT bin, lo, hi, n, round_even(frac, 6) AS frac, round_even(said, 6) AS said, round_even(accuracy, 6) AS accuracy FROM bins")
def calib_bins(spark, sf_dir):
    """Fixed bins with enough rows: what confidence says and what is true."""
    return rounded(cal.bin_table(judged(spark, sf_dir), "conf", "ok"), "lo", "hi")


@query(f"""WITH {SCORED_SQL}, edges(bin, lo, hi) AS (VALUES {_values(cal.BINS_KEPT)}), b AS (SELECT {_case(cal.BINS_KEPT)} AS bin, count(*) AS n, avg(hit) AS accuracy FROM judged GROUP BY 1)
SELECT lo, hi, coalesce(n, 0) AS n, round_even(accuracy, 6) AS accuracy FROM edges LEFT JOIN b USING (bin)""")
def bins_keep_empty(spark, sf_dir):
    """Fixed bins, the empty ones too."""
    return rounded(cal.bin_table_all(spark, judged(spark, sf_dir), "conf", "ok"), "lo", "hi")


@query(f"WITH {SCORED_SQL}, {BINS_SQL} SELECT round_even(sum(frac * abs(said - accuracy)), 6) AS ece FROM bins")
def ece_fixed(spark, sf_dir):
    """Expected calibration error over fixed bins."""
    return rounded(cal.ece(cal.bin_table(judged(spark, sf_dir), "conf", "ok")))


@query(f"""WITH {SCORED_SQL}, e AS (SELECT quantile_cont(conf, [{', '.join(str(k / 10) for k in range(1, 10))}]) AS q FROM judged),
b AS (SELECT len(list_filter(q, lambda x: x <= conf)) AS b, count(*) AS n, avg(conf) AS said, avg(hit) AS acc FROM judged, e GROUP BY 1)
SELECT count(*) AS n_bins, round_even(sum(n * abs(said - acc)) / sum(n), 6) AS ece FROM b""")
def ece_quantile(spark, sf_dir):
    """Expected calibration error over deciles of confidence."""
    return rounded(cal.ece_quantile(judged(spark, sf_dir), "conf", "ok"))


@query(f"WITH {SCORED_SQL}, {CURVE_SQL} SELECT conf, round_even(accuracy, 6) AS accuracy, round_even(coverage, 6) AS coverage FROM curve")
def cumulative_accuracy(spark, sf_dir):
    """Accuracy of all that is at least as confident."""
    return rounded(cal.cumulative_curve(judged(spark, sf_dir), "conf", "ok", "doc_id"), "conf")


@query(f"WITH {SCORED_SQL}, {BINS_SQL} SELECT lo AS conf, round_even(sum(n) OVER w / sum(n) OVER (), 6) AS coverage, round_even(sum(n * accuracy) OVER w / sum(n) OVER w, 6) AS accuracy FROM bins WINDOW w AS (ORDER BY lo DESC ROWS UNBOUNDED PRECEDING)")
def bin_cumulative(spark, sf_dir):
    """The cumulative curve from bins alone."""
    return rounded(cal.curve_of_bins(cal.bin_table(judged(spark, sf_dir), "conf", "ok")), "conf")


@query(f"WITH {SCORED_SQL}, {CLASS_SQL} SELECT label, conf, round_even(accuracy, 6) AS accuracy, round_even(coverage, 6) AS coverage FROM ccurves")
def class_curves(spark, sf_dir):
    """The cumulative curve of each decided class."""
    return rounded(cal.class_curves(judged(spark, sf_dir), "said", "conf", "ok", "doc_id"), "conf")


SWEEP = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


@query(f"""WITH {SCORED_SQL}, t(threshold) AS (VALUES {', '.join(f'(CAST({x} AS DOUBLE))' for x in SWEEP)}), s AS (SELECT threshold, count_if(conf >= threshold) AS n, sum(CASE WHEN conf >= threshold THEN hit ELSE 0 END) AS h, count(*) AS a FROM judged, t GROUP BY 1)
SELECT threshold, n, round_even(n / a, 6) AS decides, round_even(h / n, 6) AS accuracy, round_even(1 - n / a, 6) AS defers FROM s WHERE n > 0""")
def threshold_sweep(spark, sf_dir):
    """How much each threshold decides, and how well."""
    return rounded(cal.threshold_sweep(judged(spark, sf_dir), "conf", "ok", SWEEP), "threshold")


RANKED = "r AS (SELECT *, row_number() OVER (ORDER BY conf {0}, doc_id) AS rk, count(*) OVER () AS n FROM judged)"


@query(f"""WITH {SCORED_SQL}, {RANKED.format('DESC')}, f(fraction) AS (VALUES (CAST(0.0 AS DOUBLE)), (0.1), (0.2), (0.3), (0.999)),
k AS (SELECT fraction, greatest(1, CAST(round_even(n * (1 - fraction), 0) AS BIGINT)) AS kept, n FROM f, (SELECT count(*) AS n FROM judged))
SELECT fraction, kept, round_even(kept / k.n, 6) AS decides, round_even(sum(hit) / kept, 6) AS accuracy FROM k JOIN r ON rk <= kept GROUP BY fraction, kept, k.n""")
def reject_sweep(spark, sf_dir):
    """Setting the least sure aside (of equals the later)."""
    return rounded(cal.reject_sweep(judged(spark, sf_dir), "conf", "ok", "doc_id", (0.0, 0.1, 0.2, 0.3, 0.999)), "fraction")


@query(f"""WITH {SCORED_SQL}, {RANKED.format('ASC')}, f(rate) AS (VALUES (0), (5), (10), (20), (30), (50), (100)),
k AS (SELECT CAST(rate AS BIGINT) AS rate, CAST(round_even(n * rate / 100, 0) AS BIGINT) AS dropped, n FROM f, (SELECT count(*) AS n FROM judged))
SELECT rate, dropped, round_even(1 - sum(hit) / nullif(count(rk), 0), 6) AS error, coalesce(min(conf), 1.0) AS floor FROM k LEFT JOIN r ON rk > dropped GROUP BY rate, dropped""")
def reject_sweep_asc(spark, sf_dir):
    """Dropping the least sure from below (of equals the earlier), with the confidence at the cut."""
    return rounded(cal.reject_sweep_ascending(judged(spark, sf_dir), "conf", "ok", "doc_id", (0, 5, 10, 20, 30, 50, 100)), "floor")


@query(f"""WITH {SCORED_SQL}, {RANKED.format('ASC')} SELECT rate, coalesce((SELECT conf FROM r WHERE rk = round_even((SELECT count(*) FROM judged) * rate / 100, 0) + 1), 1.0) AS floor
FROM (VALUES (CAST(1 AS BIGINT)), (10), (25), (100)) t(rate)""")
def floor_for_rate(spark, sf_dir):
    """The confidence floor that defers a given share."""
    return cal.reject_sweep_ascending(judged(spark, sf_dir), "conf", "ok", "doc_id", (1, 10, 25, 100)).select("rate", "floor")


@query(f"""WITH {SCORED_SQL}, {RANKED.format('DESC')}, f(fraction) AS (VALUES (CAST(0.9 AS DOUBLE)), (0.7), (0.5), (0.3), (0.1)),
k AS (SELECT fraction, greatest(1, CAST(round_even(n * (1 - fraction), 0) AS BIGINT)) AS kept FROM f, (SELECT count(*) AS n FROM judged))
SELECT round_even(1 - fraction, 6) AS coverage, round_even(sum(hit) / kept, 6) AS accuracy FROM k JOIN r ON rk <= kept GROUP BY fraction, kept""")
def coverage_curve(spark, sf_dir):
    """Accuracy at fixed coverages."""
    s = cal.reject_sweep(judged(spark, sf_dir), "conf", "ok", "doc_id", (0.9, 0.7, 0.5, 0.3, 0.1))
    return rounded(s.select((1 - F.col("fraction")).alias("coverage"), "accuracy"))


@query(f"""WITH {SCORED_SQL}, {CURVE_SQL}, good AS (SELECT * FROM curve WHERE accuracy >= 0.34)
SELECT coalesce(max_by(conf, coverage), 1.01) AS cut, round_even(coalesce(max(coverage), 0), 6) AS coverage, round_even(coalesce(max_by(accuracy, coverage), 0), 6) AS accuracy FROM good""")
def operating_point(spark, sf_dir):
    """The cut of most coverage that holds the bar (a low one here: 0.30 and a margin)."""
    return rounded(cal.operating_point(cal.cumulative_curve(judged(spark, sf_dir), "conf", "ok", "doc_id"), 0.30, 0.04), "cut")


@query(f"WITH {SCORED_SQL}, {CLASS_SQL} SELECT label, round_even(max(accuracy), 6) AS ceiling, max(accuracy) < 0.94 AS vetoed FROM ccurves GROUP BY 1")
def class_ceiling_veto(spark, sf_dir):
    """Classes that never reach the bar."""
    return rounded(cal.class_ceilings(cal.class_curves(judged(spark, sf_dir), "said", "conf", "ok", "doc_id")))


@query(f"""WITH {SCORED_SQL}, {BINS_SQL} SELECT s.doc_id, s.conf, round_even((SELECT min(accuracy) FROM bins b WHERE (b.lo <= s.conf AND s.conf < b.hi) OR (s.conf >= 1 AND b.hi >= 1)), 6) AS measured FROM scored s""")
def bin_lookup(spark, sf_dir):
    """Measured accuracy of each item by its bin; none for a bin that was dropped."""
    from .scored import scored

    s = scored(spark, sf_dir)
    out = cal.bin_lookup(s, cal.bin_table(s.where("truth IS NOT NULL"), "conf", "ok"), "conf", "measured")
    return rounded(out.select("doc_id", "conf", "measured"), "conf")


@query(f"""WITH {SCORED_SQL}, {CURVE_SQL} SELECT s.doc_id, s.conf,
  round_even(coalesce((SELECT arg_max(accuracy, coverage) FROM curve c WHERE c.conf >= s.conf), (SELECT arg_max(accuracy, coverage) FROM curve)), 6) AS measured FROM scored s""")
def curve_lookup(spark, sf_dir):
    """Measured accuracy of the set that an item belongs to; above every point: of the whole."""
    from .scored import scored

    s = kept(scored(spark, sf_dir).select("doc_id", "conf", "ok", "truth"))  # scored once for the curve and the lookup
    out = cal.curve_lookup(s, cal.cumulative_curve(s.where("truth IS NOT NULL"), "conf", "ok", "doc_id"), "conf", "measured")
    return rounded(out.select("doc_id", "conf", "measured"), "conf")


@query(f"""WITH {SCORED_SQL}, {CURVE_SQL} SELECT s.doc_id, s.conf,
  round_even((SELECT run / rank FROM ranked WHERE rank = greatest(least({cal.MIN_CURVE}, (SELECT count(*) FROM judged)), (SELECT count(*) FROM judged j WHERE j.conf >= s.conf))), 6) AS measured FROM scored s""")
def set_cut_lookup(spark, sf_dir):
    """Measured accuracy of all at least as confident, of 20 at least."""
    from .scored import scored

    s = kept(scored(spark, sf_dir).select("doc_id", "conf", "ok", "truth"))  # scored once for the steps and the lookup
    out = cal.set_cut_lookup(s, s.where("truth IS NOT NULL"), "conf", "conf", "ok", "doc_id", "measured")
    return rounded(out.select("doc_id", "conf", "measured"), "conf")


DAILY_SQL = "daily AS (SELECT event_type, date_diff('day', TIMESTAMP '2024-01-01', ts) AS pos, count(*) AS n, sum(value) AS v FROM events GROUP BY 1, 2)"


def daily(spark, sf_dir):
    """Events per type and day: the series of these queries."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long").alias("pos")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))


@query(f"""WITH {DAILY_SQL}, t AS (SELECT event_type, avg(n) AS m FROM daily GROUP BY 1), a AS (SELECT event_type, pos FROM daily JOIN t USING (event_type) WHERE n > m),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY event_type ORDER BY pos) AS g FROM a)
SELECT event_type, min(pos) AS first, max(pos) AS last, count(*) AS length, (min(pos) + max(pos)) / 2 AS middle FROM g GROUP BY event_type, g HAVING count(*) <= 4""")
def islands(spark, sf_dir):
    """Short runs of days above the series' mean."""
    d = daily(spark, sf_dir)
    above = d.join(d.groupBy("event_type").agg(F.avg("n").alias("m")), "event_type").where("n > m")
    return series.islands(above, "event_type", "pos", longest=4)


@query(f"""WITH {DAILY_SQL}, m AS (SELECT event_type, max(n) AS top, min(pos) AS p0, max(pos) AS p1 FROM daily GROUP BY 1),
h AS (SELECT d.event_type, min(pos) AS a, max(pos) AS b, any_value(p0) AS p0, any_value(p1) AS p1 FROM daily d JOIN m USING (event_type) WHERE n >= 0.9 * top GROUP BY 1)
SELECT event_type, a - p0 AS head, p1 - b AS tail, CASE WHEN a - p0 > p1 - b THEN 'start' ELSE 'end' END AS base, abs((a - p0) - (p1 - b)) AS margin FROM h""")
def edge_runs(spark, sf_dir):
    """Runs below a share of the maximum at both ends, and which end has the longer one."""
    return series.edge_runs(daily(spark, sf_dir), "event_type", "pos", "n", 0.9)


@query(f"""WITH {DAILY_SQL}, holes AS (SELECT event_type, pos, CASE WHEN pos % 4 = 1 THEN NULL ELSE n::DOUBLE END AS x FROM daily),
w AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS p0, last_value(x IGNORE NULLS) OVER b AS x0,
  first_value(CASE WHEN x IS NOT NULL THEN pos END IGNORE NULLS) OVER f AS p1, first_value(x IGNORE NULLS) OVER f AS x1 FROM holes
  WINDOW b AS (PARTITION BY event_type ORDER BY pos ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY event_type ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_type, pos, round_even(CASE WHEN x IS NOT NULL THEN x WHEN p0 IS NULL THEN x1 WHEN p1 IS NULL THEN x0 ELSE x0 + (x1 - x0) * (pos - p0) / (p1 - p0) END, 6) AS x FROM w""")
def gap_fill(spark, sf_dir):
    """Gaps filled on the line between their neighbours, constant at the ends."""
    d = daily(spark, sf_dir).select("event_type", "pos", F.when(F.col("pos") % 4 != 1, F.col("n").cast("double")).alias("x"))
    return rounded(series.fill_gaps(d, "event_type", "pos", "x"))


@query(f"""WITH {DAILY_SQL}, e AS (SELECT event_type, min(pos) AS p0, max(pos) AS p1, arg_min(n, pos) AS x0, arg_max(n, pos) AS x1 FROM daily GROUP BY 1),
pad AS (SELECT event_type, pos, n FROM daily UNION ALL SELECT event_type, p0 - i, x0 FROM e, range(1, 3) t(i) UNION ALL SELECT event_type, p1 + i, x1 FROM e, range(1, 3) t(i)),
m AS (SELECT event_type, pos, quantile_cont(n::DOUBLE, 0.5) OVER (PARTITION BY event_type ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS mid FROM pad)
SELECT d.event_type, d.pos, round_even(m.mid, 6) AS mid FROM daily d JOIN m USING (event_type, pos)""")
def moving_median(spark, sf_dir):
    """Median of five, the ends replicated."""
    return rounded(series.moving_median(daily(spark, sf_dir), "event_type", "pos", "n", 2))


@query(f"""WITH {DAILY_SQL}, s AS (SELECT event_type, pos, n, lag(n) OVER w AS a, lead(n) OVER w AS b FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY pos))
SELECT event_type, pos, round_even((0.25 * coalesce(a, n) + 0.5 * n + 0.25 * coalesce(b, n)), 6) AS smooth FROM s""")
def smooth_profile(spark, sf_dir):
    """A small binomial smoothing of a profile."""
    return rounded(series.smooth(daily(spark, sf_dir), "event_type", "pos", "n", (0.25, 0.5, 0.25)))
