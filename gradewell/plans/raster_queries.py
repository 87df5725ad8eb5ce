"""Queries on rasters: embeddings seen as pictures of 8 x 8, their bright pixels as masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import half_even
from ..operators import raster, series
from .registry import query, table

SIDE, LEVEL = 8, 0.1

PIX = f"""pix AS (SELECT vec_id AS id, (k - 1) // {SIDE} AS y, (k - 1) % {SIDE} AS x, CAST(embedding[k] AS DOUBLE) AS v FROM embeddings, range(1, {SIDE * SIDE + 1}) t(k)),
lit AS (SELECT * FROM pix WHERE v > {LEVEL})"""
AXES = """m AS (SELECT id, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, var_samp(y) AS c, covar_samp(x, y) AS b FROM lit GROUP BY 1 HAVING count(*) > 1),
e0 AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) AS l FROM m),
e1 AS (SELECT *, CASE WHEN abs(b) < 1e-12 THEN CASE WHEN a >= c THEN 1.0 ELSE 0.0 END ELSE b END AS vx, CASE WHEN abs(b) < 1e-12 THEN CASE WHEN a >= c THEN 0.0 ELSE 1.0 END ELSE l - a END AS vy FROM e0),
axes AS (SELECT id, n, mx, my, CASE WHEN vy < 0 THEN -1 ELSE 1 END * vx / sqrt(vx * vx + vy * vy) AS ex, CASE WHEN vy < 0 THEN -1 ELSE 1 END * vy / sqrt(vx * vx + vy * vy) AS ey FROM e1),
framed AS (SELECT l.*, (x - mx) * ex + (y - my) * ey AS t, -(x - mx) * ey + (y - my) * ex AS s FROM lit l JOIN axes USING (id))"""


def lit(spark, sf_dir):
    return raster.pixels(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", SIDE).where(F.col("v") > LEVEL)


@query(f"""WITH {PIX} SELECT id, count(*) AS area, round_even(count(*) / 64, 6) AS coverage, min(y)::INTEGER AS y0, max(y)::INTEGER AS y1, min(x)::INTEGER AS x0, max(x)::INTEGER AS x1,
  round_even(count(*) / ((max(y) - min(y) + 1) * (max(x) - min(x) + 1)), 6) AS fill, min(y) = 0 OR min(x) = 0 OR max(y) = 7 OR max(x) = 7 AS touches FROM lit GROUP BY 1""")
def mask_metrics(spark, sf_dir):
    """Area, box and border contact of masks."""
    m = raster.mask_metrics(lit(spark, sf_dir), SIDE, SIDE)
    return m.withColumns({c: half_even(c) for c in ("coverage", "fill")})


@query(f"WITH {PIX}, {AXES} SELECT id, n, round_even(mx, 6) AS mx, round_even(my, 6) AS my, round_even(abs(ex), 4) AS ex, round_even(ey, 4) AS ey FROM axes")
def axis_profile(spark, sf_dir):
    """Centroid and main axis from the covariance."""
    a = raster.axes(lit(spark, sf_dir))
    return a.select("id", "n", half_even("mx").alias("mx"), half_even("my").alias("my"), half_even(F.abs("ex"), 4).alias("ex"), half_even("ey", 4).alias("ey"))


@query(f"""WITH {PIX}, {AXES}, g AS (SELECT *, min(round_even(t, 6)) OVER (PARTITION BY id) AS t0, max(round_even(t, 6)) OVER (PARTITION BY id) AS t1 FROM framed),
z AS (SELECT id, CASE WHEN round_even(t, 6) > t1 - 0.1305 * (t1 - t0) THEN 'base' WHEN round_even(t, 6) < t0 + 0.0775 * (t1 - t0) THEN 'tip' WHEN abs(round_even(s, 6)) < 0.9 / 2 THEN 'vein' WHEN s > 0 THEN 'left' ELSE 'right' END AS zone FROM g)
SELECT id, zone, count(*) AS n FROM z GROUP BY 1, 2""")
def zone_assign(spark, sf_dir):
    """Pixels by zone of the leaf's frame: base, tip, vein, left, right."""
    on = lit(spark, sf_dir)
    f = raster.in_frame(on, raster.axes(on)).withColumns({"t": half_even("t"), "s2": half_even("s")})
    ends = f.groupBy("id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    b = raster.bands(F.col("t1") - F.col("t0"), F.lit(None).cast("double"), F.lit(1.5))
    z = f.join(ends, "id").withColumn("zone", F.when(F.abs("s2") >= b["vein"] / 2, raster.zone(F.col("t"), F.col("s"), F.col("t0"), F.col("t1"), b["tip"], b["base"], F.lit(0.0))).otherwise(raster.zone(F.col("t"), F.col("s"), F.col("t0"), F.col("t1"), b["tip"], b["base"], F.lit(1e9))))
    return z.groupBy("id", "zone").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PIX}, m AS (SELECT id, count(*) AS n, avg(v) AS mean, stddev_pop(v) + 1e-6 AS sd FROM lit GROUP BY 1)
SELECT id, any_value(n) AS n, round_even(any_value(mean), 6) AS mean, round_even(any_value(sd), 6) AS sd, round_even(avg(CASE WHEN v < mean - 1.5 * sd THEN 1.0 ELSE 0 END), 6) AS dark, round_even(avg(CASE WHEN v > mean + 1.5 * sd THEN 1.0 ELSE 0 END), 6) AS light FROM lit JOIN m USING (id) GROUP BY 1""")
def region_stats(spark, sf_dir):
    """Moments and tails of a region's values."""
    r = raster.region_stats(lit(spark, sf_dir))
    return r.select("id", "n", *[half_even(c).alias(c) for c in ("mean", "sd", "dark", "light")])


@query(f"""WITH RECURSIVE {PIX}, reach(id, y, x, y0, x0) AS (SELECT id, y, x, y, x FROM lit UNION SELECT l.id, l.y, l.x, r.y0, r.x0 FROM reach r JOIN lit l ON l.id = r.id AND abs(l.y - r.y) <= 1 AND abs(l.x - r.x) <= 1),
roots AS (SELECT id, y, x, min(y0 * 8 + x0) AS root FROM reach GROUP BY 1, 2, 3), part AS (SELECT id, root, count(*) AS area, avg(y) AS cy, avg(x) AS cx FROM roots GROUP BY 1, 2)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY root) AS part, area, round_even(cy, 6) AS cy, round_even(cx, 6) AS cx FROM part""")
def components8(spark, sf_dir):
    """8-connected parts with area and centroid."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double") > LEVEL).alias("m"))
    return raster.components(e, "vec_id", "m", SIDE, SIDE).withColumns({c: half_even(c) for c in ("cy", "cx")})


@query(f"""WITH {PIX}, n AS (SELECT p.id, p.y, p.x, count(l.id) AS n, 9 - CASE WHEN p.y IN (0, 7) THEN 3 ELSE 0 END - CASE WHEN p.x IN (0, 7) THEN 3 ELSE 0 END + CASE WHEN p.y IN (0, 7) AND p.x IN (0, 7) THEN 1 ELSE 0 END AS full_n
  FROM pix p LEFT JOIN lit l ON l.id = p.id AND abs(l.y - p.y) <= 1 AND abs(l.x - p.x) <= 1 GROUP BY 1, 2, 3)
SELECT id, count_if(n > 0) AS dilated, count_if(n = full_n) AS eroded FROM n GROUP BY 1 HAVING count_if(n > 0) > 0""")
def erode_dilate(spark, sf_dir):
    """Sizes of the mask after a 3 x 3 dilation and erosion."""
    n = raster.neighbours(lit(spark, sf_dir), SIDE, SIDE)
    edge = lambda c: F.col(c).isin(0, SIDE - 1)
    cells = F.when(edge("y"), 2).otherwise(3) * F.when(edge("x"), 2).otherwise(3)
    return n.groupBy("id").agg(F.count(F.lit(1)).alias("dilated"), F.count_if(F.col("n") == cells).alias("eroded"))


@query("""WITH p AS (SELECT vec_id AS id, k, CAST(embedding[k] AS DOUBLE) AS x, CAST(embedding[k + 32] AS DOUBLE) AS y FROM embeddings, range(1, 33) t(k)),
q AS (SELECT id, x * coalesce(lead(y) OVER w, first_value(y) OVER f) - coalesce(lead(x) OVER w, first_value(x) OVER f) * y AS c FROM p WINDOW w AS (PARTITION BY id ORDER BY k), f AS (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT id, round_even(abs(sum(c)) / 2, 6) AS area FROM q GROUP BY 1""")
def shoelace(spark, sf_dir):
    """Area of a closed contour of 32 points."""
    pts = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.struct(F.get("embedding", k).cast("double").alias("x"), F.get("embedding", k + 32).cast("double").alias("y")))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), half_even(raster.shoelace(pts)).alias("area"))


_COMB = """pos AS (SELECT user_id, epoch_us(ts) / 60000000.0 - 28401120 AS pos FROM events WHERE event_type = 'purchase'),
per AS (SELECT 55 + 0.5 * i AS period FROM range(0, 111) t(i)),
comb AS (SELECT user_id, CAST(period AS DOUBLE) AS period, sqrt(avg(cos(2 * pi() * pos / period)) * avg(cos(2 * pi() * pos / period)) + avg(sin(2 * pi() * pos / period)) * avg(sin(2 * pi() * pos / period))) AS strength, count(*) AS n FROM pos, per GROUP BY 1, 2 HAVING count(*) >= 4)"""


def comb(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    minutes = F.unix_micros(F.col("ts").cast("timestamp")) / 60000000.0 - 28401120
    return series.comb_strength(e.select("user_id", minutes.alias("pos")), "user_id", "pos")


@query(f"WITH {_COMB} SELECT user_id, period, round_even(strength, 5) AS strength FROM comb")
def comb_strength(spark, sf_dir):
    """How strongly positions follow each candidate period."""
    return comb(spark, sf_dir).withColumn("strength", half_even("strength", 5))


@query(f"""WITH {_COMB}, r AS (SELECT user_id, period, round_even(strength, 5) AS strength FROM comb),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY strength DESC, period) AS k FROM r), l AS (SELECT user_id, period, strength FROM r WHERE period = 110)
SELECT b.user_id, CASE WHEN l.strength >= 0.85 * b.strength THEN l.period ELSE b.period END AS period, CASE WHEN l.strength >= 0.85 * b.strength THEN l.strength ELSE b.strength END AS strength FROM b JOIN l USING (user_id) WHERE k = 1""")
def dominant_period(spark, sf_dir):
    """The strongest period, unless its double is nearly as strong."""
    return series.dominant_period(comb(spark, sf_dir).withColumn("strength", half_even("strength", 5)), "user_id")
