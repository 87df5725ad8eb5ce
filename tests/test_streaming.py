"""The control loop: lookups, once-only orders, restarts, the handshake and its timeouts."""

import datetime as dt

from pyspark.sql import functions as F

from gradewell.streaming import cell

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def stream(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_unknown_and_invalid_go_to_review(spark):
    events = spark.createDataFrame([("a", 1), ("b", 12), ("x", 2), ("c", None)], "id string, bin int")
    queue = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    got = {r.id: (r.bin, r.known) for r in cell.safe_bin(cell.with_queue(events, queue, "id")).collect()}
    assert got == {"a": (1, True), "b": (9, True), "x": (9, False), "c": (9, True)}


def test_stale_signals_count_once(spark, tmp_path):
    schema = "id string, epoch int, ts timestamp"
    write(spark, [("a", 1, at(0)), ("a", 1, at(1)), ("b", 1, at(2))], schema, tmp_path / "in")
    write(spark, [("a", 1, at(3)), ("a", 2, at(4))], schema, tmp_path / "in")
    once = cell.once_per_epoch(stream(spark, schema, tmp_path / "in"), ["id", "epoch"], "ts")
    cell.run_to_folder(once, str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted((r.id, r.epoch) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_restart_goes_on_where_it_stopped(spark, tmp_path):
    schema = "id int"
    seen = []
    for part in ([(1,), (2,)], [(3,)]):
        write(spark, part, schema, tmp_path / "in")
        cell.run_batches(stream(spark, schema, tmp_path / "in"), lambda b, e: seen.extend(r.id for r in b.collect()), str(tmp_path / "state"))
    assert sorted(seen) == [1, 2, 3]
    log = cell.log_batch(str(tmp_path / "log"))
    for _ in range(2):  # a repeated epoch replaces itself
        log(spark.createDataFrame([(1,)], schema), 5)
    assert spark.read.json(str(tmp_path / "log")).count() == 1


def test_scoreboard(spark):
    rows = [("w", "w", 2, 2, True, "HIT"), ("w", "b", 2, 1, True, "ERROR"), ("b", None, 9, None, False, "NO_LABEL")]
    r = cell.scoreboard(spark.createDataFrame(rows, "said string, truth string, bin int, truth_bin int, accept boolean, outcome string")).first()
    assert (r["items"], r.class_ok, r.bin_ok, r.accepted, r.errors, r.unlabelled) == (3, 1, 1, 2, 1, 1)


def test_phases():
    s = ("idle", 0, 0.0, 0)
    assert cell.step(*s, "code", 3, 1.0)[4] is None  # a code without an item
    s = cell.step(*s, "item", 7, 10.0)[:4]
    taken = cell.step(*s, "code", 3, 11.0)
    assert taken == ("acked", 7, 13.0, 3, "taken")  # not before the minimum stop
    assert cell.step(*taken[:4], "code", 4, 14.0)[4] is None  # still valid: not read again
    assert cell.step(*taken[:4], "clear", 0, 15.0) == ("idle", 0, 15.0, 0, "closed")


def test_handshake(spark, tmp_path):
    schema = "cell long, signal string, value long, ts timestamp"
    rows = [(1, "item", 7, at(0)), (1, "code", 3, at(5)), (1, "code", 3, at(6)), (1, "clear", 0, at(8)), (1, "item", 8, at(20)), (1, "code", 14, at(30)), (1, "clear", 0, at(31)), (2, "item", 9, at(0))]
    write(spark, rows, schema, tmp_path / "in")
    write(spark, [(3, "item", 1, at(5000))], schema, tmp_path / "in")
    write(spark, [(3, "clear", 0, at(9000))], schema, tmp_path / "in")
    out = cell.handshake(stream(spark, schema, tmp_path / "in"))
    cell.run_to_folder(out, str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.schema(cell.ORDER).parquet(str(tmp_path / "out")).select("cell", "item", "code", "state", F.unix_seconds("at").alias("at"))
    t0 = int(T0.timestamp())
    rows = sorted((r.cell, r["at"] - t0, r.item, r.code, r.state) for r in got.collect())
    assert rows[:5] == [(1, 5, 7, 3, "taken"), (1, 8, 7, 3, "closed"), (1, 30, 8, 9, "taken"), (1, 31, 8, 9, "closed"), (2, 900, 9, 9, "timeout")]
    assert (3, 5900, 1, 9, "timeout") in rows


def test_a_stop_takes_effect_between_batches(spark, tmp_path):
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    handle = lambda batch, epoch: seen.append(sorted(r.id for r in batch.collect()))
    assert cell.run_batches(stream(), handle, str(tmp_path / "state"), stop=lambda: len(seen) >= 2) is False
    assert len(seen) == 2
    assert cell.run_batches(stream(), handle, str(tmp_path / "state")) is True
    assert sorted(sum(seen, [])) == list(range(30)) and len(seen) == 3


def test_waiting_for_a_signal(spark):
    at = lambda s: f"2024-01-01 00:00:{s:02d}"
    signals = spark.createDataFrame([(1, "x", "0", at(1)), (1, "x", "7", at(5)), (1, "x", "7", at(9)), (2, "x", "junk", at(3))], "cell int, signal string, value string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    wanted = spark.createDataFrame([(1, "x", 7, at(0), 20.0), (1, "x", 7, at(6), 2.0), (2, "x", 0, at(0), 10.0), (3, "x", 1, at(0), 1.0)], "cell int, signal string, value int, asked string, seconds double").withColumn("asked", F.col("asked").cast("timestamp"))
    got = {(r.cell, r.asked.second): (r.at.second, r.met) for r in cell.wait_until(signals, wanted).collect()}
    assert got == {(1, 0): (5, True), (1, 6): (8, False), (2, 0): (3, True), (3, 0): (1, False)}
