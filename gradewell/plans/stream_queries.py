"""Queries of the control loop: streams run over what is there, against their batch form in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import half_even
from ..operators import decide
from ..sources.shared import scratch
from ..streaming import cell
from .decision_queries import OUTCOME_SQL, judged_routes
from .registry import query, table
from .scored import SCORED_SQL


def event_stream(spark, sf_dir):
    """The events table as a stream."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, since a source is a folder or one


_CODE = "CASE WHEN event_id % 23 = 0 THEN 15 ELSE user_id % 8 + 1 END"
STREAM_SQL = f"""q AS (SELECT c_custkey AS item, c_mktsegment AS segment, CAST(c_nationkey % 9 + 1 AS INTEGER) AS truth_bin FROM customer WHERE c_custkey % 5 > 0),
d AS (SELECT event_id, user_id AS item, segment, item IS NOT NULL AS known, truth_bin, round_even(value / 500, 6) AS conf, {_CODE} AS code FROM events LEFT JOIN q ON user_id = item),
r AS (SELECT event_id, item, segment, known, conf, truth_bin, conf >= 0.6 AS accept, CAST(CASE WHEN known AND conf >= 0.6 AND code BETWEEN 1 AND 9 THEN code ELSE 9 END AS INTEGER) AS bin FROM d)"""


def decided_stream(spark, sf_dir):
    """Each event's item looked up in the queue, decided by its confidence, routed; truth joins after the decision."""
    c = table(spark, sf_dir, "customer").where("c_custkey % 5 > 0")
    queue = c.select(F.col("c_custkey").alias("item"), F.col("c_mktsegment").alias("segment"))
    truth = c.select(F.col("c_custkey").alias("item"), (F.col("c_nationkey") % 9 + 1).cast("int").alias("truth_bin"))
    e = event_stream(spark, sf_dir).select("event_id", F.col("user_id").alias("item"), half_even(F.col("value") / 500).alias("conf"), F.when(F.col("event_id") % 23 == 0, 15).otherwise(F.col("user_id") % 8 + 1).alias("code"))
    d = cell.with_queue(e, queue, "item")
    accept = decide.plain_policy("conf", "segment", decide.FLOOR_TREE)["accept"]
    d = d.withColumn("accept", accept).withColumn("bin", F.when(F.col("accept"), F.col("code")).otherwise(decide.REVIEW))
    return cell.safe_bin(d).join(truth, "item", "left").select("event_id", "item", "segment", "known", "conf", "accept", "bin", "truth_bin")


@query(f"WITH {STREAM_SQL} SELECT event_id, item, segment, known, conf, accept, bin, truth_bin FROM r")
def stream_decisions(spark, sf_dir):
    """Stream-static lookup, decision and routing, appended exactly once."""
    out = scratch(spark, "stream-decisions")
    cell.run_to_folder(decided_stream(spark, sf_dir), f"{out}/rows", f"{out}/state")
    return spark.read.schema("event_id long, item long, segment string, known boolean, conf double, accept boolean, bin int, truth_bin int").parquet(f"{out}/rows")


@query(f"WITH {SCORED_SQL}, {OUTCOME_SQL} SELECT count(*) AS items, count_if(coalesce(said = truth, false)) AS class_ok, count_if(coalesce(bin = truth_bin, false)) AS bin_ok, count_if(accept) AS accepted, count_if(outcome = 'ERROR') AS errors, count_if(truth_bin IS NULL) AS unlabelled FROM result")
def stream_scoreboard(spark, sf_dir):
    """The counters of a run."""
    return cell.scoreboard(judged_routes(spark, sf_dir))


@query("""
WITH s AS (SELECT user_id AS cell, event_id, event_type, ts, date_trunc('hour', ts) AS hour FROM events)
SELECT hour, event_type, count(*) AS n, round_even(sum(value), 4) AS total FROM s JOIN events USING (event_id, event_type) GROUP BY 1, 2""".replace("JOIN events USING (event_id, event_type)", "JOIN (SELECT event_id, value FROM events) USING (event_id)"))
def stream_hourly(spark, sf_dir):
    """Windowed counts by hour with a watermark, in the streaming engine's complete form."""
    out = scratch(spark, "stream-hourly")
    e = event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "2 hours")
    w = e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    rows = w.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", half_even("total", 4).alias("total"))
    last = {}

    def keep(batch, epoch):
        last["path"] = f"{out}/epoch={epoch}"
        batch.write.mode("overwrite").parquet(last["path"])

    rows.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    schema = "hour timestamp_ntz, event_type string, n long, total double"
    return spark.read.schema(schema).parquet(last["path"]) if last else spark.createDataFrame([], schema)


@query()
def handshake_state(spark, sf_dir):
    """The four-phase handshake over signals made of events, as keyed state.  Rows only: a state machine is beyond SQL."""
    out = scratch(spark, "handshake")
    e = event_stream(spark, sf_dir)
    signal = F.when(F.col("event_type").isin("view", "signup"), "item").when(F.col("event_type").isin("click", "purchase"), "code").otherwise("clear")
    s = e.select(F.col("user_id").alias("cell"), signal.alias("signal"), F.when(signal == "item", F.col("event_id")).otherwise(F.col("event_id") % 12).alias("value"), "ts")
    cell.run_to_folder(cell.handshake(s), f"{out}/rows", f"{out}/state")
    return spark.read.schema(cell.ORDER).parquet(f"{out}/rows")


@query("""WITH r AS (SELECT c_custkey AS id, c_acctbal AS orden, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS turn FROM customer)
SELECT id, orden, turn, CAST(turn % 9 AS INTEGER) AS place FROM r""")
def feeder_queue(spark, sf_dir):
    """The ordered queue dealt over nine places in turn."""
    q = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("orden"))
    return cell.feed(q, spark, 9, 0)


@query("""WITH i AS (SELECT CAST(i % 9 AS INTEGER) AS place, md5(CAST(i AS VARCHAR)) AS h FROM range(0, 450) t(i))
SELECT row_number() OVER (ORDER BY h, place) - 1 AS turn, place FROM i""")
def feeder_pattern(spark, sf_dir):
    """Without a queue: fifty items for each of nine places, in an order that looks random."""
    return cell.feed(None, spark, 9, 50)


@query("""WITH w AS (SELECT event_id AS cell, CAST(ts AS TIMESTAMP) AS asked, user_id FROM events WHERE event_type = 'signup'),
h AS (SELECT w.cell, w.asked, min(CASE WHEN e.ts BETWEEN w.asked AND w.asked + INTERVAL 36000 SECOND AND e.event_type = 'purchase' THEN CAST(e.ts AS TIMESTAMP) END) AS hit FROM w LEFT JOIN events e ON e.user_id = w.user_id GROUP BY 1, 2)
SELECT cell, epoch_us(coalesce(hit, asked + INTERVAL 36000 SECOND)) AS seen_at, hit IS NOT NULL AS met FROM h""")
def wait_for_signal(spark, sf_dir):
    """How long after each signup its user's signal turns to 'purchase', within ten hours."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    asks = e.where("event_type = 'signup'").select(F.col("user_id").alias("cell"), F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("name"), "event_id", F.col("ts").alias("asked"))
    wanted = asks.select(F.col("cell"), F.lit("state").alias("signal"), F.lit(1).alias("value"), "asked", F.lit(36000.0).alias("seconds")).distinct()
    signals = e.select(F.col("user_id").alias("cell"), F.lit("state").alias("signal"), F.when(F.col("event_type") == "purchase", "1").otherwise("bad").alias("value"), "ts")
    out = cell.wait_until(signals, wanted)
    return asks.join(out, ["cell", "asked"]).select(F.col("event_id").alias("cell"), F.unix_micros("at").alias("seen_at"), "met")
