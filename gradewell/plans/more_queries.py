"""Further queries: nested details, scalar functions, sets, and the profile of a mask."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.scalars import half_even
from ..operators import aggregates, raster
from .raster_queries import AXES, PIX, lit
from .registry import query, table

DETAIL = "d AS (SELECT l_orderkey AS leaf, l_returnflag AS kind, l_linestatus AS zone, l_quantity AS area FROM lineitem)"


def details(spark, sf_dir):
    """Each order's lines as an array of defects."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("leaf")).agg(F.collect_list(F.struct(F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("zone"), F.col("l_quantity").alias("area"))).alias("defects"))


@query(f"WITH {DETAIL} SELECT leaf, count(*) AS n, count_if(kind = 'R') AS n_r, round_even(sum(area), 6) AS area, round_even(coalesce(sum(CASE WHEN zone = 'O' THEN area END), 0), 6) AS area_left, max(area) AS largest FROM d GROUP BY 1")
def reaggregate_detail(spark, sf_dir):
    """Aggregates recomputed from the stored child rows, not from the pictures."""
    d = details(spark, sf_dir).select("leaf", F.explode("defects").alias("e")).select("leaf", "e.*")
    return d.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "R").alias("n_r"), half_even(F.sum("area")).alias("area"), half_even(F.coalesce(F.sum(F.when(F.col("zone") == "O", F.col("area"))), F.lit(0.0))).alias("area_left"), F.max("area").alias("largest"))


@query(f"""WITH {DETAIL}, r AS (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY area DESC, kind, zone) AS k FROM d)
SELECT leaf, string_agg(kind || '/' || zone, ' ' ORDER BY k) FILTER (k <= 3) AS top, count_if(area > 25) AS big, round_even(sum(area) FILTER (kind <> 'A'), 6) AS rest FROM r GROUP BY 1""")
def defect_arrays(spark, sf_dir):
    """Array functions over a nested defect list: the three largest, a count, a filtered sum."""
    order = F.array_sort(F.transform("defects", lambda e: F.struct((-e["area"]).alias("a"), e["kind"], e["zone"])))
    rest = F.filter("defects", lambda e: e["kind"] != "A")
    return details(spark, sf_dir).select(
        "leaf", F.array_join(F.transform(F.slice(order, 1, 3), lambda e: F.concat_ws("/", e["kind"], e["zone"])), " ").alias("top"),
        F.size(F.filter("defects", lambda e: e["area"] > 25)).cast("long").alias("big"),
        F.when(F.size(rest) > 0, half_even(F.aggregate(rest, F.lit(0.0), lambda a, e: a + e["area"]))).alias("rest"),
    )


@query("""WITH m AS (SELECT c_mktsegment, quantile_cont(CAST(c_acctbal AS DOUBLE), 0.5) AS mid FROM customer WHERE c_acctbal > 0 GROUP BY 1)
SELECT c_custkey, round_even(coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, mid), 6) AS scale, round_even(c_acctbal / mid, 6) AS ratio FROM customer LEFT JOIN m USING (c_mktsegment)""")
def scale_lookup(spark, sf_dir):
    """An item's own scale, else the median of its folder."""
    c = table(spark, sf_dir, "customer")
    own = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    mid = aggregates.exact_percentiles(c.where("c_acctbal > 0"), ["c_mktsegment"], "c_acctbal", [0.5]).select("c_mktsegment", F.get("q", F.lit(0)).alias("mid"))
    return c.join(mid, "c_mktsegment", "left").select("c_custkey", half_even(F.coalesce(own, "mid")).alias("scale"), half_even(F.col("c_acctbal") / F.col("mid")).alias("ratio"))


@query("""WITH a AS (SELECT DISTINCT lang AS label FROM documents), b AS (SELECT DISTINCT lower(substr(n_name, 1, 2)) AS label FROM nation)
SELECT label, 'both' AS side FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT label, 'first' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT label, 'second' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def label_sets(spark, sf_dir):
    """Labels of two sources: common and one-sided."""
    a = table(spark, sf_dir, "documents").select(F.col("lang").alias("label"))
    b = table(spark, sf_dir, "nation").select(F.lower(F.substring("n_name", 1, 2)).alias("label"))
    side = lambda d, n: d.select("label", F.lit(n).alias("side"))
    return side(a.intersect(b), "both").unionByName(side(a.subtract(b), "first")).unionByName(side(b.subtract(a), "second"))


@query("SELECT max(o_orderkey) + 1 AS next_number, lpad(CAST((max(o_orderkey) + 1) % 100 AS VARCHAR), 2, '0') AS name FROM orders")
def next_number(spark, sf_dir):
    """The next free number, and a zero-padded name."""
    n = table(spark, sf_dir, "orders").agg((F.max("o_orderkey") + 1).alias("next_number"))
    return n.withColumn("name", F.lpad((F.col("next_number") % 100).cast("string"), 2, "0"))


@query("""SELECT page_id, regexp_extract(u, '[^/]+$', 0) AS base, regexp_replace(regexp_extract(u, '[^/]+$', 0), '[.][^.]*$', '') AS stem, regexp_replace(u, '/?[^/]*$', '') AS folder,
 array_to_string(string_split(u, '/')[3:4], '/') AS first_parts, starts_with(url, 'https') AS secure, contains(url, 'blog') AS blog FROM (SELECT *, regexp_replace(url, '[?#].*$', '') AS u FROM pages)""")
def path_parts(spark, sf_dir):
    """Parts of paths."""
    p = table(spark, sf_dir, "pages").withColumn("u", F.regexp_replace("url", "[?#].*$", ""))
    return p.select("page_id", scalars.basename("u").alias("base"), scalars.stem("u").alias("stem"), scalars.folder("u").alias("folder"), F.array_join(F.slice(F.split("u", "/"), 3, 2), "/").alias("first_parts"), F.col("url").startswith("https").alias("secure"), F.col("url").contains("blog").alias("blog"))


@query("""WITH a AS (SELECT event_id, value - 245 AS d FROM events), m AS (SELECT event_id, d, ((d % 180) + 180) % 180 AS h, ((d % 360) + 360) % 360 AS f FROM a)
SELECT event_id, round_even(CASE WHEN h > 90 THEN h - 180 ELSE h END, 6) AS axis, round_even(CASE WHEN f > 180 THEN f - 360 ELSE f END, 6) AS turn, round_even(sqrt(d * d + 9), 6) AS reach,
 round_even(0.035 + 0.085 * least(greatest((d - 14.7) / (16.9 - 14.7), 0), 1), 6) AS tip, round_even(degrees(atan2(3, d)), 6) AS angle FROM m""")
def angle_functions(spark, sf_dir):
    """Folded angles, shortest turns, clamped interpolation."""
    d = F.col("value") - 245
    return table(spark, sf_dir, "events").select(
        "event_id", half_even(scalars.fold_axis(d)).alias("axis"), half_even(scalars.shortest_turn(d)).alias("turn"), half_even(F.hypot(d, F.lit(3.0))).alias("reach"),
        half_even(scalars.lerp(d, 14.7, 0.035, 16.9, 0.12)).alias("tip"), half_even(F.degrees(F.atan2(F.lit(3.0), d))).alias("angle"),
    )


@query(r"""SELECT conv_id, turn, try_cast(regexp_extract(text, '([0-9]+(?:[.][0-9]+)?)', 1) AS DOUBLE) AS number, replace(CAST(turn AS VARCHAR) || '.5', '.', ',') AS comma, upper(role) AS who, length(trim(text)) AS n FROM conversations""")
def text_figures(spark, sf_dir):
    """Numbers out of texts, decimal commas, trimming."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", scalars.number_in("text", "([0-9]+(?:[.][0-9]+)?)").alias("number"), F.replace(F.concat(F.col("turn").cast("string"), F.lit(".5")), F.lit("."), F.lit(",")).alias("comma"), F.upper("role").alias("who"), F.char_length(F.trim("text")).cast("long").alias("n"))


@query(f"""WITH {PIX}, {AXES}, f AS (SELECT id, round_even(t, 6) AS t, s FROM framed), e AS (SELECT id, min(t) AS t0, max(t) AS t1 FROM f GROUP BY 1),
b AS (SELECT f.id, s, CAST(least(greatest(coalesce(floor((t - t0) / nullif(t1 - t0, 0) * 6), 0), 0), 5) AS INTEGER) AS bin FROM f JOIN e USING (id))
SELECT id, bin, count(*) AS n, round_even(CASE WHEN count(*) > 3 THEN max(s) - min(s) ELSE 0 END, 5) AS width FROM b GROUP BY 1, 2""")
def width_profile(spark, sf_dir):
    """Widths across the axis in steps along it."""
    on = lit(spark, sf_dir)
    f = raster.in_frame(on, raster.axes(on)).withColumn("t", half_even("t"))
    return raster.width_profile(f, bins=6).withColumn("width", half_even("width", 5))


@query("""WITH s AS (SELECT d.doc_id, l.toxic, d.n_chars FROM documents d JOIN labels l USING (doc_id)), p AS (SELECT a.n_chars AS x, b.n_chars AS y FROM s a, s b WHERE a.toxic = 1 AND b.toxic = 0)
SELECT (SELECT count(*) FROM s WHERE toxic = 1) AS n_pos, (SELECT count(*) FROM s WHERE toxic = 0) AS n_neg, round_even(avg(CASE WHEN x > y THEN 1.0 WHEN x = y THEN 0.5 ELSE 0 END), 6) AS auc FROM p""")
def pairwise_auc(spark, sf_dir):
    """The share of pairs in the right order, ties half, by ranks instead of pairs."""
    s = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return aggregates.auc(s.withColumn("one", F.col("toxic") == 1), "n_chars", "one").withColumn("auc", half_even("auc"))
