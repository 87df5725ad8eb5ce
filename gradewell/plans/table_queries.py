"""Queries on keyed tables: cleaning, one row per key, eligibility, merges, samples, folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import tables
from .registry import query, table


@query("""
SELECT CAST(page_id AS BIGINT) AS page_id, try_cast(regexp_extract(url, '([0-9]+)', 1) AS DOUBLE) AS first_number,
  try_cast(regexp_extract(url, '[^/]*$', 0) AS DOUBLE) AS tail_number
FROM pages""")
def safe_cast(spark, sf_dir):
    """Numbers of texts that mostly are none: unreadable and empty become null."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", scalars.number_in("url", "([0-9]+)").alias("first_number"), scalars.clean_double(F.regexp_extract("url", "[^/]*$", 0)).alias("tail_number"))


@query("""
SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k,
  try_cast(json_extract_string(props, '$.none') AS DOUBLE) AS absent
FROM events""")
def safe_cast_json(spark, sf_dir):
    """Numbers inside a JSON text."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", scalars.clean_double(F.get_json_object("props", "$.k")).alias("k"), scalars.clean_double(F.get_json_object("props", "$.none")).alias("absent"))


@query("""
SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS n FROM orders) WHERE n = 1""")
def dedup_argmin(spark, sf_dir):
    """One order per customer: the cheapest, the first key of equals."""
    return tables.best_per_group(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("""
WITH o AS (SELECT *, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS v FROM orders),
f AS (SELECT o_custkey, arg_min(v IS NULL, o_orderkey) AS blind FROM o GROUP BY 1)
SELECT o_custkey, o_orderkey, v AS price FROM (
  SELECT o.*, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN blind THEN 0 ELSE coalesce(v, 'inf'::DOUBLE) END, o_orderkey) AS n
  FROM o JOIN f USING (o_custkey)) WHERE n = 1""")
def dedup_argmin_unknown(spark, sf_dir):
    """The same as a loop over rows does it: a first row of unknown value is never replaced."""
    o = table(spark, sf_dir, "orders").withColumn("price", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
    return tables.first_row_if_unknown(o, "o_custkey", "price", "o_orderkey").select("o_custkey", "o_orderkey", "price")


@query("SELECT doc_id, lang, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def anti_doubtful(spark, sf_dir):
    """Documents without a doubtful entry."""
    doubt = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "pending_review").otherwise("settled").alias("state"))
    return tables.without_doubtful(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), doubt, "doc_id", "state", ("pending", "skipped_"))


@query("""
WITH best AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS n FROM orders WHERE o_orderstatus <> 'P')
SELECT o_custkey, o_orderkey, o_totalprice FROM best b WHERE n = 1
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = b.o_orderkey AND l_returnflag = 'R')""")
def semi_eligible_after_argmin(spark, sf_dir):
    """Eligible orders, the best per customer, and only then those with features: a best one without them is lost."""
    o = table(spark, sf_dir, "orders")
    good = tables.eligible(o, o.select("o_orderkey", "o_orderstatus"), "o_orderkey", F.col("o_orderstatus") != "P")
    best = tables.best_per_group(good, "o_custkey", "o_totalprice", "o_orderkey")
    has = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return best.join(has, "o_orderkey", "left_semi").select("o_custkey", "o_orderkey", "o_totalprice")


@query("""
WITH s AS (SELECT source, avg(n_chars) AS mean_chars, count(*) AS n_docs FROM documents GROUP BY source)
SELECT d.doc_id, l.quality, l.toxic, s.n_docs, round_even((d.n_chars - s.mean_chars) / (d.n_chars + s.mean_chars + 1e-6), 6) AS asym
FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN s USING (source)""")
def left_feature_chain(spark, sf_dir):
    """A chain of left joins: what is missing is null, nothing is lost."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    s = d.groupBy("source").agg(F.avg("n_chars").alias("mean_chars"), F.count(F.lit(1)).alias("n_docs"))
    out = d.join(table(spark, sf_dir, "labels"), "doc_id", "left").join(s, "source", "left")
    return out.select("doc_id", "quality", "toxic", "n_docs", scalars.half_even(scalars.asymmetry("n_chars", "mean_chars")).alias("asym"))


@query("""
WITH c AS (SELECT c_nationkey AS k, min(c_name) AS name, max(c_acctbal) AS bal FROM customer WHERE c_nationkey % 2 = 0 GROUP BY 1),
s AS (SELECT s_nationkey AS k, min(s_name) AS name, max(s_acctbal) AS bal, count(*) AS n FROM supplier WHERE s_nationkey % 3 > 0 GROUP BY 1)
SELECT n_nationkey AS k, CASE WHEN c.k IS NOT NULL THEN c.name WHEN s.k IS NOT NULL THEN s.name END AS name,
  CASE WHEN c.k IS NOT NULL THEN c.bal WHEN s.k IS NOT NULL THEN s.bal END AS bal, s.n AS n
FROM nation LEFT JOIN c ON c.k = n_nationkey LEFT JOIN s ON s.k = n_nationkey""")
def first_wins_merge(spark, sf_dir):
    """Per nation the columns of the first table that has a row for it."""
    base = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    c = table(spark, sf_dir, "customer").where("c_nationkey % 2 = 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.min("c_name").alias("name"), F.max("c_acctbal").alias("bal"))
    s = table(spark, sf_dir, "supplier").where("s_nationkey % 3 > 0").groupBy(F.col("s_nationkey").alias("k")).agg(F.min("s_name").alias("name"), F.max("s_acctbal").alias("bal"), F.count(F.lit(1)).alias("n"))
    return tables.first_wins("k", ["name", "bal", "n"], base, c, s)


@query("""
WITH p AS (SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/\\\\]+$', 0) AS base FROM pages)
SELECT p.page_id, d.doc_id, p.base FROM p JOIN documents d ON p.base = CAST(d.doc_id AS VARCHAR)""")
def basename_join(spark, sf_dir):
    """Pages and documents by the last part of a path."""
    p = table(spark, sf_dir, "pages").select("page_id", scalars.basename(F.regexp_replace("url", "[?#].*$", "")).alias("base"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("base"))
    return p.join(d, "base").select("page_id", "doc_id", "base")


@query("""
WITH fix(doc_id, q2) AS (SELECT doc_id, 1 - quality FROM labels WHERE doc_id % 37 = 5)
SELECT l.doc_id, CAST(coalesce(fix.q2, l.quality) AS INTEGER) AS quality, l.toxic FROM labels l LEFT JOIN fix USING (doc_id)""")
def correction_overlay(spark, sf_dir):
    """Labels with corrections laid over them."""
    labels = table(spark, sf_dir, "labels")
    fixes = labels.where("doc_id % 37 = 5").select("doc_id", (1 - F.col("quality")).alias("q2"))
    return tables.overlay(labels, fixes, "doc_id", "quality", "q2").select("doc_id", "quality", "toxic")


@query("""
SELECT l_orderkey, round_even((l - r) / (l + r + 1e-6), 6) AS asym, round_even(abs(l - r), 6) AS diff FROM (
  SELECT l_orderkey, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS l, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS r
  FROM lineitem GROUP BY 1)""")
def asymmetry(spark, sf_dir):
    """Left against right, null where a side is unknown."""
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*[F.sum(F.when(F.col("l_linestatus") == v, F.col("l_quantity"))).alias(n) for v, n in (("O", "l"), ("F", "r"))])
    return s.select("l_orderkey", scalars.half_even(scalars.asymmetry("l", "r")).alias("asym"), scalars.half_even(F.abs(F.col("l") - F.col("r"))).alias("diff"))


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round_even(CASE WHEN l_quantity > 10 THEN l_extendedprice / l_quantity END, 9) AS unit,
  round_even(l_tax / (l_discount + 1e-6), 6) AS quot FROM lineitem""")
def guarded_ratio(spark, sf_dir):
    """Ratios only where the denominator is large enough, and quotients with an epsilon."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", scalars.half_even(scalars.guarded_ratio("l_extendedprice", "l_quantity", 10), 9).alias("unit"), scalars.half_even(scalars.quotient("l_tax", "l_discount")).alias("quot"))


@query("""
WITH j AS (SELECT d.doc_id, l.quality, l.toxic, CASE WHEN l.toxic > 1 THEN 1 END AS never FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT * FROM (VALUES ('doc_id', (SELECT count(*) FROM j), (SELECT count(doc_id) FROM j)), ('quality', (SELECT count(*) FROM j), (SELECT count(quality) FROM j)),
  ('toxic', (SELECT count(*) FROM j), (SELECT count(toxic) FROM j)), ('never', (SELECT count(*) FROM j), (SELECT count(never) FROM j))) v("column", n_rows, n_known),
  LATERAL (SELECT n_known = 0 AS empty)""")
def completeness_check(spark, sf_dir):
    """How many values each column has, and which has none."""
    j = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("never", F.when(F.col("toxic") > 1, 1))
    return tables.completeness(j, ["doc_id", "quality", "toxic", "never"])


@query("""
SELECT 'old' AS session, o_orderstatus, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01' GROUP BY 2
UNION ALL SELECT 'new', o_orderstatus, count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 2""")
def union_sessions(spark, sf_dir):
    """Sessions stacked by name, then counted."""
    o = table(spark, sf_dir, "orders")
    cut = F.lit("1995-01-01").cast("timestamp_ntz")
    old = o.where(F.col("o_orderdate") < cut).select(F.lit("old").alias("session"), "o_orderstatus")
    new = o.where(F.col("o_orderdate") >= cut).select("o_orderstatus", F.lit("new").alias("session"))
    return old.unionByName(new).groupBy("session", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_minus_done(spark, sf_dir):
    """What a resumed run has left to do."""
    return tables.pending(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("""
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM documents),
w AS (SELECT DISTINCT source, CASE WHEN least(7, n) = 1 THEN 0 ELSE CAST(floor(i * (n - 1) / (least(7, n) - 1)) AS BIGINT) END AS k
  FROM (SELECT DISTINCT source, n FROM r), range(0, 7) t(i) WHERE i < least(7, n))
SELECT doc_id, source FROM r JOIN w USING (source, k)""")
def even_sample(spark, sf_dir):
    """Seven evenly spaced documents of each source."""
    return tables.even_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 7)


@query("SELECT fold, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM (SELECT doc_id, CAST(('0x' || substr(md5(source), 1, 8))::UBIGINT % 5 AS BIGINT) AS fold FROM documents) GROUP BY fold")
def group_folds(spark, sf_dir):
    """Folds by the hash of a group: sources never straddle folds."""
    f = tables.hash_folds(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 5)
    return f.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query("SELECT CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::UBIGINT % 5 AS BIGINT) AS fold, CAST(doc_id AS VARCHAR) AS id FROM documents")
def fold_explode(spark, sf_dir):
    """A partition document (folds of sorted test ids) read back as rows."""
    f = tables.hash_folds(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 5)
    lists = f.groupBy("fold").agg(F.sort_array(F.collect_set(F.col("doc_id").cast("string"))).alias("test"))
    doc = lists.agg(F.transform(F.array_sort(F.collect_list(F.struct("fold", "test"))), lambda e: F.struct(e["test"].alias("test"))).alias("folds"))
    return tables.folds_of(doc)


@query("""
SELECT s_suppkey, n_name, r_name, CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN 'near' WHEN r_name = 'AFRICA' THEN 'far' ELSE r_name END AS zone
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def label_recode(spark, sf_dir):
    """Labels recoded by groups, others left."""
    out = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return out.select("s_suppkey", "n_name", "r_name", tables.recode("r_name", {"near": ("ASIA", "EUROPE"), "far": ("AFRICA",)}).alias("zone"))


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def last_row_wins(spark, sf_dir):
    """A keyed reading: of rows with one key the last stays."""
    return tables.last_per_key(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")
