"""Queries that score, decide, route and explain."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.scalars import half_even
from ..operators import calibration as cal
from ..operators import decide
from .curve_queries import BINS_SQL, CLASS_SQL, rounded
from .registry import query, table
from .scored import FEATURES, SCORED_SQL, features, judged, scored

NAMES = list(FEATURES)
_IMPUTED = "SELECT doc_id, lang, " + ", ".join(f"CASE WHEN n % 7 = 0 THEN NULL ELSE {c} END AS {c}" for c in NAMES) + " FROM feat"
SCALE_SQL = f"""x AS ({_IMPUTED}), med AS (SELECT {', '.join(f'quantile_cont({c}, 0.5) AS m_{c}' for c in NAMES)} FROM x),
fl AS (SELECT doc_id, lang, {', '.join(f'coalesce({c}, m_{c}) AS {c}' for c in NAMES)} FROM x, med),
st AS (SELECT {', '.join(f'avg({c}) AS a_{c}, stddev_pop({c}) AS d_{c}' for c in NAMES)} FROM fl),
z AS (SELECT doc_id, lang, {', '.join(f'CASE WHEN d_{c} > 0 THEN ({c} - a_{c}) / d_{c} ELSE 0 END AS z_{c}' for c in NAMES)} FROM fl, st)"""


def scaled(spark, sf_dir):
    """Features with gaps, imputed by medians and standardised."""
    f = features(spark, sf_dir)
    holes = f.select("doc_id", "lang", *[F.when(F.col("n") % 7 != 0, F.col(c)).alias(c) for c in NAMES])
    return decide.impute_scale(holes, NAMES)


@query(f"WITH {SCORED_SQL}, {SCALE_SQL} SELECT doc_id, {', '.join(f'round_even(z_{c}, 6) AS z_{c}' for c in NAMES)} FROM z")
def impute_scale(spark, sf_dir):
    """Median imputation, then standardisation by the population deviation."""
    return rounded(scaled(spark, sf_dir).select("doc_id", *[f"z_{c}" for c in NAMES]))


@query(f"WITH {SCORED_SQL} SELECT doc_id, p_band, p_wrap, p_left, said, conf FROM scored")
def chained_decision(spark, sf_dir):
    """Three questions in a chain: class and confidence."""
    return scored(spark, sf_dir).select("doc_id", "p_band", "p_wrap", "p_left", "said", "conf")


_SOFT = """soft AS (SELECT *, p_band AS q0, (1 - p_band) * p_wrap AS q1, (1 - p_band) * (1 - p_wrap) * p_left AS q2, (1 - p_band) * (1 - p_wrap) * (1 - p_left) AS q3 FROM scored)"""


@query(f"""WITH {SCORED_SQL}, {_SOFT}, u AS (SELECT doc_id, said, unnest([{{'c': 'band', 'i': 0, 'q': q0}}, {{'c': 'wrap', 'i': 1, 'q': q1}}, {{'c': 'left', 'i': 2, 'q': q2}}, {{'c': 'right', 'i': 3, 'q': q3}}]) AS e FROM soft),
s AS (SELECT doc_id, e.c AS second FROM u WHERE e.c <> said QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY e.q DESC, e.i) = 1)
SELECT doc_id, said, second, round_even(q0, 6) AS q_band, round_even(q1, 6) AS q_wrap, round_even(q2, 6) AS q_left, round_even(q3, 6) AS q_right FROM soft JOIN s USING (doc_id)""")
def soft_chain(spark, sf_dir):
    """Probabilities of all classes, and the second choice."""
    s = scored(spark, sf_dir).withColumn("q", decide.soft_chain("p_band", "p_wrap", "p_left")).withColumn("second", decide.second_best("q", "said"))
    return rounded(s.select("doc_id", "said", "second", *[F.get("q", i).alias(f"q_{c}") for i, c in enumerate(decide.CLASSES)]))


@query(f"""WITH {SCORED_SQL} SELECT doc_id, CASE WHEN p_wrap >= 1 - p_wrap THEN 'without' ELSE 'with' END AS branch, round_even(p_wrap * (1 - p_band), 6) AS p_wrap_, round_even(p_wrap * p_band, 6) AS p_band_,
  round_even((1 - p_wrap) * p_left, 6) AS p_left_, round_even((1 - p_wrap) * (1 - p_left), 6) AS p_right_ FROM scored""")
def grid_classifier(spark, sf_dir):
    """Two questions, the second by the first's answer."""
    s = scored(spark, sf_dir).withColumn("other", 1 - F.col("p_band"))
    g = decide.grid("p_wrap", "other", "p_left")
    return rounded(s.select("doc_id", g["branch"].alias("branch"), *[g[f"p_{c}"].alias(f"p_{c}_") for c in decide.CLASSES]))


@query(f"""WITH {SCORED_SQL}, v AS (SELECT *, round_even(1.0 / (1.0 + exp(-(CAST(-1.0 AS DOUBLE) + CAST(8.0 AS DOUBLE) * f_space + CAST(20.0 AS DOUBLE) * f_line))), 9) AS p_south FROM scored)
SELECT doc_id, CASE WHEN p_south > 0.5 THEN 'south' ELSE 'north' END AS variety, greatest(p_south, 1 - p_south) AS conf_variety, CASE WHEN p_south > 0.5 THEN p_wrap ELSE p_band END AS p_quality FROM v""")
def two_stage(spark, sf_dir):
    """A variety first, then the quality model of the predicted variety."""
    s = scored(spark, sf_dir).withColumn("p_south", half_even(decide.node({"f_space": 8.0, "f_line": 20.0}, -1.0), 9))
    south = F.col("p_south") > 0.5
    return s.select("doc_id", F.when(south, "south").otherwise("north").alias("variety"), F.greatest("p_south", 1 - F.col("p_south")).alias("conf_variety"), F.when(south, F.col("p_wrap")).otherwise(F.col("p_band")).alias("p_quality"))


@query(f"""WITH {SCORED_SQL}, {_SOFT}, r AS (SELECT *, f_symbol = 0 AND f_line = 0 AS none, q0 + q1 AS left_over FROM soft)
SELECT doc_id, none AND left_over > 0 AS ruled, round_even(CASE WHEN none AND left_over > 0 THEN q0 / left_over ELSE q0 END, 6) AS q_band,
  round_even(CASE WHEN none AND left_over > 0 THEN q1 / left_over ELSE q1 END, 6) AS q_wrap, round_even(CASE WHEN none AND left_over > 0 THEN 0 ELSE q2 END, 6) AS q_left,
  round_even(CASE WHEN none AND left_over > 0 THEN 0 ELSE q3 END, 6) AS q_right FROM r""")
def zero_rule_renorm(spark, sf_dir):
    """No damage on either side: both side classes are out."""
    s = scored(spark, sf_dir).withColumn("q", decide.soft_chain("p_band", "p_wrap", "p_left")).withColumn("r", decide.zero_rule("q", "f_symbol", "f_line"))
    ruled = (F.col("f_symbol") == 0) & (F.col("f_line") == 0) & (F.get("q", 0) + F.get("q", 1) > 0)
    return rounded(s.select("doc_id", ruled.alias("ruled"), *[F.get("r", i).alias(f"q_{c}") for i, c in enumerate(decide.CLASSES)]))


@query(f"WITH {SCORED_SQL} SELECT doc_id, said, conf, conf >= CASE WHEN said = 'left' THEN 0.8 WHEN said = 'right' THEN 0.5 ELSE 0.6 END AS accept, conf < CASE WHEN said = 'left' THEN 0.8 WHEN said = 'right' THEN 0.5 ELSE 0.6 END AND said IN ('left', 'right') AS veto FROM scored")
def policy_plain(spark, sf_dir):
    """Accept from a floor on; some classes have their own."""
    p = decide.plain_policy("conf", "said", 0.6, {"left": 0.8, "right": 0.5})
    return scored(spark, sf_dir).select("doc_id", "said", "conf", p["accept"].alias("accept"), p["veto"].alias("veto"))


@query(f"""WITH {SCORED_SQL}, {BINS_SQL}, {CLASS_SQL}, top AS (SELECT label, max(accuracy) AS ceiling FROM ccurves GROUP BY 1),
m AS (SELECT s.doc_id, s.said, (SELECT min(accuracy) FROM bins b WHERE b.lo <= s.conf AND s.conf < b.hi OR s.conf >= 1 AND b.hi >= 1) AS acc FROM scored s)
SELECT doc_id, said, coalesce(acc * 0.99 >= 0.3 + 0.04, false) AND NOT coalesce(ceiling < 0.3 + 0.04, false) AS accept, coalesce(ceiling < 0.3 + 0.04, false) AS veto FROM m LEFT JOIN top ON said = label""")
def policy_prudent(spark, sf_dir):
    """Accept by measured accuracy; classes that never reach the bar are vetoed (a low bar here)."""
    s, j = scored(spark, sf_dir), judged(spark, sf_dir)
    out = cal.bin_lookup(s, cal.bin_table(j, "conf", "ok"), "conf", "acc").withColumn("acc_variety", F.lit(0.99))
    tops = cal.class_ceilings(cal.class_curves(j, "said", "conf", "ok", "doc_id")).select(F.col("label").alias("said"), "ceiling")
    out = out.join(F.broadcast(tops), "said", "left")  # one row per class
    p = decide.prudent_policy("acc_variety", "acc", "ceiling", 0.3, 0.04)
    return out.select("doc_id", "said", p["accept"].alias("accept"), p["veto"].alias("veto"))


_BINS = ", ".join(f"('{v}', '{c}', {b})" for v, c, b in decide.BIN_ROWS)
_VARIETY = "CASE lang WHEN 'en' THEN 'north' WHEN 'de' THEN 'south' ELSE 'other' END"
ROUTE_SQL = f"""dest(variety, said, dest) AS (VALUES {_BINS}), routed AS (SELECT s.*, {_VARIETY} AS variety, conf >= 0.6 AS accept, CAST(CASE WHEN conf >= 0.6 THEN coalesce(dest, 9) ELSE 9 END AS INTEGER) AS bin
  FROM scored s LEFT JOIN dest d ON d.variety = {_VARIETY} AND d.said = s.said)"""


def routed(spark, sf_dir, rows=None):
    """Decided documents with variety, acceptance and bin."""
    s = scored(spark, sf_dir) if rows is None else rows
    s = s.withColumn("variety", F.when(F.col("lang") == "en", "north").when(F.col("lang") == "de", "south").otherwise("other"))
    s = s.withColumn("accept", decide.plain_policy("conf", "said", decide.FLOOR_TREE)["accept"])
    return decide.route(s, decide.bins_table(spark), "variety", "said", "accept")


@query(f"WITH {SCORED_SQL}, {ROUTE_SQL} SELECT doc_id, variety, said, accept, bin FROM routed")
def route_bin(spark, sf_dir):
    """Accepted items to the bin of variety and class, the rest and the unknown to review."""
    return routed(spark, sf_dir).select("doc_id", "variety", "said", "accept", "bin")


_W = {c: w for c, w in zip(NAMES, (0.9, -0.7, 0.4, -1.1, 0.6))}


@query(f"""WITH {SCORED_SQL}, {SCALE_SQL}, t AS (SELECT doc_id, unnest([{', '.join(f"{{'f': '{c}', 'v': CAST({w} AS DOUBLE) * z_{c}}}" for c, w in _W.items())}]) AS e, CASE WHEN lang = 'en' THEN 1.0 ELSE -1.0 END AS turn FROM z)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY abs(e.v) DESC, e.f) AS place, e.f AS feature, round_even(turn * e.v, 6) AS value FROM t QUALIFY place <= 3""")
def contributions_top(spark, sf_dir):
    """The features that pull a decision most, turned towards the winner."""
    z = scaled(spark, sf_dir)
    sign = F.when(F.col("lang") == "en", 1.0).otherwise(-1.0)
    out = z.select("doc_id", F.posexplode(decide.contributions(NAMES, _W, sign, top=3)).alias("place", "e"))
    return rounded(out.select("doc_id", (F.col("place") + 1).cast("long").alias("place"), F.col("e.feature").alias("feature"), F.col("e.value").alias("value")))


@query(f"""WITH {SCORED_SQL} SELECT doc_id, array_to_string(list_filter([CASE WHEN f_symbol > 0.02 THEN format('{{:.1f}} % symbols', round_even(100 * f_symbol, 1)) END,
  CASE WHEN f_upper > 0.5 THEN 'mostly capitals' END, CASE WHEN n < 200 THEN format('only {{}} characters', n) END], lambda x: x IS NOT NULL), '; ') AS evidence FROM scored""")
def evidence_sentences(spark, sf_dir):
    """Sentences of the measurements that stand out."""
    rules = [
        (F.col("f_symbol") > 0.02, "%.1f %% symbols", [F.bround(100 * F.col("f_symbol"), 1)]),
        (F.col("f_upper") > 0.5, "mostly capitals", []),
        (F.col("n") < 200, "only %d characters", [F.col("n")]),
    ]
    return scored(spark, sf_dir).select("doc_id", F.array_join(decide.evidence(rules), "; ").alias("evidence"))


@query(f"""WITH {SCORED_SQL}, {ROUTE_SQL} SELECT doc_id, '{{"id":' || doc_id || ',"scores":{{"class":"' || said || '","sure":' || CAST(CAST(round_even(conf * 10000, 0) AS INTEGER) AS VARCHAR) || '}},"decides":{{"bin":' || bin || ',"review":' || CASE WHEN bin = 9 THEN 'true' ELSE 'false' END || '}}}}' AS record FROM routed""")
def decision_json(spark, sf_dir):
    """The nested record of each decision as JSON."""
    r = routed(spark, sf_dir)
    rec = F.struct(
        F.col("doc_id").alias("id"),
        F.struct(F.col("said").alias("class"), F.bround(F.col("conf") * 10000, 0).cast("int").alias("sure")).alias("scores"),
        F.struct("bin", (F.col("bin") == 9).alias("review")).alias("decides"),
    )
    return r.select("doc_id", F.to_json(rec).alias("record"))


OUTCOME_SQL = f"""{ROUTE_SQL}, truth AS (SELECT r.*, CAST(t.dest AS INTEGER) AS truth_bin FROM routed r LEFT JOIN dest t ON t.variety = r.variety AND t.said = r.truth),
result AS (SELECT *, CASE WHEN coalesce(truth_bin, 0) = 0 THEN 'NO_LABEL' WHEN bin = 9 THEN 'SPECIAL' WHEN truth_bin = bin THEN 'HIT' ELSE 'ERROR' END AS outcome FROM truth)"""


def judged_routes(spark, sf_dir, rows=None):
    """Routed documents with the bin of their truth and the outcome; truth comes after the decision."""
    r = routed(spark, sf_dir, rows)
    t = F.broadcast(decide.bins_table(spark).select(F.col("variety").alias("_v"), F.col("label").alias("_l"), F.col("bin").alias("truth_bin")))
    out = r.join(t, (F.col("variety") == F.col("_v")) & (F.col("truth") == F.col("_l")), "left").drop("_v", "_l")
    return out.withColumn("outcome", decide.outcome("truth_bin", "bin"))


@query(f"WITH {SCORED_SQL}, {OUTCOME_SQL} SELECT variety, outcome, count(*) AS n FROM result GROUP BY 1, 2")
def outcome_class(spark, sf_dir):
    """Outcomes of routing against the truth."""
    return judged_routes(spark, sf_dir).groupBy("variety", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CAST(user_id % 16 AS INTEGER) AS code, (user_id % 2)::INTEGER AS b0, (user_id // 2 % 2)::INTEGER AS b1, (user_id // 4 % 2)::INTEGER AS b2, (user_id // 8 % 2)::INTEGER AS b3, lpad(bin((user_id % 16)::BIGINT), 4, '0') AS bits, CAST(CASE WHEN user_id % 16 BETWEEN 1 AND 9 THEN user_id % 16 ELSE 9 END AS INTEGER) AS bin, user_id % 16 AS back FROM events")
def code_bits(spark, sf_dir):
    """Four-bit codes, their bits, text and bins; invalid codes go to review."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 16).cast("int").alias("code")).withColumn("b", scalars.bits_of("code"))
    return e.select("event_id", "code", *[F.get("b", k).alias(f"b{k}") for k in range(4)], scalars.bit_text("code").alias("bits"), scalars.code_to_bin("code").alias("bin"), scalars.code_of("b").alias("back"))


_EXPECTED = [("accuracy", 0.5, 0.5), ("kappa", 0.9, 0.01), ("items", 1000.0, 900.0), ("missing", 1.0, 1.0)]


@query(f"""WITH {SCORED_SQL}, m(name, measured) AS (SELECT 'accuracy', round_even(avg(hit), 6) FROM judged UNION ALL SELECT 'kappa', 0.25 UNION ALL SELECT 'items', count(*)::DOUBLE FROM judged),
e(name, expected, tolerance) AS (VALUES {', '.join(f"('{n}', CAST({x} AS DOUBLE), CAST({t} AS DOUBLE))" for n, x, t in _EXPECTED)})
SELECT name, expected, CAST(measured AS DOUBLE) AS measured, coalesce(abs(measured - expected) <= tolerance, false) AS ok FROM e LEFT JOIN m USING (name)""")
def acceptance_table(spark, sf_dir):
    """Measured figures against expected ones within tolerances."""
    row = judged(spark, sf_dir).agg(half_even(F.avg(F.col("ok").cast("double"))).alias("a"), F.count(F.lit(1)).cast("double").alias("n"))
    measured = row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in (("accuracy", F.col("a")), ("kappa", F.lit(0.25)), ("items", F.col("n")))])).alias("e")).select("e.*")
    return decide.acceptance(spark, measured, _EXPECTED)


@query(f"""WITH {SCORED_SQL}, {OUTCOME_SQL} SELECT said, count(*) AS n, count_if(accept) AS accepted, round_even(count_if(accept) / count(*), 6) AS decides,
  count_if(truth IS NOT NULL) AS n_judged, round_even(avg(CASE WHEN ok THEN 1.0 WHEN NOT ok THEN 0 END), 6) AS accuracy,
  round_even(avg(CASE WHEN accept AND ok THEN 1.0 WHEN accept AND NOT ok THEN 0 END), 6) AS accuracy_accepted, count_if(outcome = 'HIT') AS hits FROM result GROUP BY 1""")
def flagship_report(spark, sf_dir):
    """The whole run: features, chain, policy, routing, truth, and the figures of each class."""
    r = judged_routes(spark, sf_dir)
    ok = F.col("ok").cast("double")
    out = r.groupBy("said").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("accept").alias("accepted"), F.count_if(F.col("truth").isNotNull()).alias("n_judged"),
        half_even(F.avg(ok)).alias("accuracy"), half_even(F.avg(F.when(F.col("accept"), ok))).alias("accuracy_accepted"), F.count_if(F.col("outcome") == "HIT").alias("hits"),
    )
    return out.select("said", "n", "accepted", half_even(F.col("accepted") / F.col("n")).alias("decides"), "n_judged", "accuracy", "accuracy_accepted", "hits")
