"""The control loop as streams: events looked up, decided, routed and logged; a handshake as keyed state.

A stream of items joins a static queue (a miss goes to review), is decided by the same expressions as
a batch, and is written by micro-batches that can be repeated without doubling.  The handshake of an
agent and a cell is a state machine per cell over signal events, with event-time timeouts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.decide import REVIEW
from ..operators.ordered import running

LEAF_WAIT_S, ACK_WAIT_S, MIN_STOP_S = 900, 60, 3.0  # fixed values of the cell


def with_queue(events: DataFrame, queue: DataFrame, key: str) -> DataFrame:
    """Events with their queue row; an unknown item is kept, without one (``known`` is false)."""
    q = queue.withColumn("known", F.lit(True))
    return events.join(q, key, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def safe_bin(df: DataFrame, bin_col: str = "bin", known: str = "known") -> DataFrame:
    """Unknown items, unknown and invalid codes go to review; nothing is dropped."""
    valid = F.col(known) & F.col(bin_col).between(1, REVIEW)
    return df.withColumn(bin_col, F.when(F.coalesce(valid, F.lit(False)), F.col(bin_col)).otherwise(REVIEW).cast("int"))


def once_per_epoch(events: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """One order per item and epoch: a stale signal read again within the allowed lateness does not count."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def run_to_folder(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there and append it to a Parquet folder, exactly once across restarts."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, stop: Callable[[], bool] | None = None) -> bool:
    """Hand each micro-batch to ``handle(batch, epoch)``; whether all that is there was handled.

    ``stop`` (a flag) is looked at before each batch: a batch in hand is always finished, what follows
    stays for the next run, which goes on where this one stopped.
    """

    class Stopped(Exception):
        pass

    def guarded(batch: DataFrame, epoch: int) -> None:
        if stop is not None and stop():
            raise Stopped
        handle(batch, epoch)

    query = stream.writeStream.foreachBatch(guarded).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException as error:
        if "Stopped" not in str(error):
            raise
        return False
    return True


def feed(queue: DataFrame | None, spark: SparkSession, places: int, per_place: int, order: str = "orden", place: str = "place") -> DataFrame:
    """What the feeder lays where: the ordered queue, dealt over the places in turn; without one, a random pattern.

    With a queue each row gets ``turn`` (from 0, by ``order``) and ``place`` = turn mod places.  The
    pattern has ``per_place`` items for each place, in an order that the MD5 of their number gives:
    random to the eye, the same at each run.
    """
    if queue is not None:
        ranked = running(queue, order, [], ties=tuple(c for c in queue.columns if c != order)).drop("total")
        return ranked.withColumn("turn", F.col("rank") - 1).withColumn(place, F.pmod(F.col("turn"), F.lit(places)).cast("int")).drop("rank")
    items = spark.range(places * per_place).select(F.pmod(F.col("id"), F.lit(places)).cast("int").alias(place), F.md5(F.col("id").cast("string")).alias("_h"))
    ranked = running(items, "_h", [], ties=(place,)).select((F.col("rank") - 1).alias("turn"), place)
    return ranked


def wait_until(signals: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cell, signal, asked, at, met) of each wait ``wanted`` (cell, signal, value, asked, seconds): the first time that the signal has the value.

    ``met`` is false, and ``at`` the end of the wait, where the value does not come within its
    seconds; signals that can't be read as numbers count as 0.
    """
    value = F.coalesce(F.col("value").try_cast("int"), F.lit(0))
    s = signals.select("cell", "signal", value.alias("_v"), "ts")
    due = F.col("asked") + F.make_dt_interval(secs=F.col("seconds"))
    w = wanted.withColumn("_due", due)
    hit = w.join(s, ["cell", "signal"], "left").groupBy("cell", "signal", "asked", "value", "_due").agg(F.min(F.when((F.col("_v") == F.col("value")) & F.col("ts").between(F.col("asked"), F.col("_due")), F.col("ts"))).alias("_at"))
    return hit.select("cell", "signal", "asked", F.coalesce("_at", "_due").alias("at"), F.col("_at").isNotNull().alias("met"))


def log_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A batch handler that writes its rows under their epoch: a repeated epoch replaces itself."""

    def handle(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/epoch={epoch}")

    return handle


def scoreboard(decided: DataFrame) -> DataFrame:
    """Running counts: items, right class, right bin, accepted, errors, unlabelled."""
    truth = F.col("truth_bin").isNotNull()
    return decided.agg(
        F.count(F.lit(1)).alias("items"), F.count_if(F.coalesce(F.col("said") == F.col("truth"), F.lit(False))).alias("class_ok"), F.count_if(F.coalesce(F.col("bin") == F.col("truth_bin"), F.lit(False))).alias("bin_ok"),
        F.count_if("accept").alias("accepted"), F.count_if(F.col("outcome") == "ERROR").alias("errors"), F.count_if(~truth).alias("unlabelled"),
    )


# ---------------------------------------------------------------- handshake

ORDER = "cell long, item long, code int, state string, at timestamp"
STATE = "phase string, item long, since double, code int"


def step(phase: str, item: int, since: float, code: int, signal: str, value: int, at: float):
    """One signal against the state: (phase, item, since, code, result or None).

    Phases: idle - an item stands before the camera - a code is valid - done, back to idle when the
    code is withdrawn.  A code counts once: while it stays valid it is not read again, and one that
    comes before the minimum stop waits for nothing but is taken at the stop's end.
    """
    if signal == "item" and phase in ("idle", "waiting"):
        return "waiting", value, at, 0, None
    if signal == "code" and phase == "waiting":
        return "acked", item, max(at, since + MIN_STOP_S), value, "taken"
    if signal == "clear" and phase == "acked":
        return "idle", 0, at, 0, "closed"
    return phase, item, since, code, None


def handshake(signals: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """(cell, item, code, state, at) of a signal stream (cell, signal, value, ts).

    ``taken``: a code accepted (1 to 9, any other counts as 9); ``closed``: the handshake is over;
    ``timeout``: an item without a code after 900 s, or a code not withdrawn after 60 s, both of event
    time.  Signals of a batch are taken in time order; state ends with its timeout.
    """
    stream = signals.select("cell", "signal", "value", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", lateness)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        phase, item, since, code = state.get if state.exists else ("idle", 0, 0.0, 0)
        out = []
        limit = {"waiting": LEAF_WAIT_S, "acked": ACK_WAIT_S}
        if state.hasTimedOut:
            if phase in limit:
                out.append((key[0], item, REVIEW if phase == "waiting" else code, "timeout", since + limit[phase]))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "signal"])
            for signal, value, ts in zip(rows["signal"], rows["value"], rows["ts"]):
                at = ts.timestamp()
                if phase in limit and at > since + limit[phase]:
                    out.append((key[0], item, REVIEW if phase == "waiting" else code, "timeout", since + limit[phase]))
                    phase, item, since, code = "idle", 0, at, 0
                value = int(value)
                before = (item, code)
                phase, item, since, code, result = step(phase, item, since, code, signal, value if signal != "code" or 1 <= value <= 9 else REVIEW, at)
                if result:
                    who, what = (item, code) if result == "taken" else before
                    out.append((key[0], who, what, result, max(at, since) if result == "taken" else at))
            state.update((phase, item, since, code))
            if phase in limit:
                due = int((since + limit[phase]) * 1000)
                state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        frame = pd.DataFrame(out, columns=["cell", "item", "code", "state", "at"])
        frame["at"] = pd.to_datetime((frame["at"].astype("float64") * 1e6).round().astype("int64"), unit="us")
        yield frame.astype({"cell": "int64", "item": "int64", "code": "int32"})

    return stream.groupBy("cell").applyInPandasWithState(run, ORDER, STATE, "append", GroupStateTimeout.EventTimeTimeout)
