"""Collection of batch results as keyed state: what came, what came late, what never came.

Requests and results arrive as files, in any order and over any number of runs.  Each
custom id has a state and timers, both in the checkpoint, so a restarted collection goes on
where the last one ended.  Statuses of the rows that come out:

collected  the first result of a request, created up to ``within`` after the submission
late       the first result of a request, created later (an id reported missing may still be late)
missing    a request without a result ``within`` after the submission
unknown    a result without a request ``within`` after its creation
repeated   any further result of an id

Time is that of the records (submission and creation), so a replay gives the same rows.
Records that are older than the newest one by more than ``remember`` are left out, and states
are forgotten then: they hold the ids of that span alone.  Results without an id are left out;
a null response is a result; a second request of an id changes nothing.  Columns other than
the ones named are not read.  Empty inputs give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from commlens.session import scratch

RECORD = "custom_id string, uid string, response string, is_result boolean, at timestamp, ms long"
OUTCOME = "custom_id string, uid string, status string, response string, delay_ms long"
STATE = "uid string, submitted long, status string, response string, created long, last long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Collector(StatefulProcessor):
    """The state of one custom id.

    The watermark lags ``remember`` behind the newest record, so a timer for the time t is set
    ``remember`` earlier.
    """

    def __init__(self, within_ms: int, remember_ms: int):
        self.within, self.remember = within_ms, remember_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("request", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        uid, submitted, status, response, created, last = self.state.get() or (None,) * 6
        for r in sorted(rows, key=lambda r: (r.ms, r.is_result, r.uid or "", r.response or "")):
            last = r.ms if last is None else max(last, r.ms)
            if r.is_result and created is not None:
                yield self._row(key, uid, "repeated", r.response, r.ms, submitted)
                continue
            if not r.is_result and submitted is not None:
                continue
            if r.is_result:
                response, created = r.response, r.ms
            else:
                uid, submitted = r.uid, r.ms
            if created is None or submitted is None:
                status = "open"
            else:
                status = "collected" if created <= submitted + self.within else "late"
                yield self._row(key, uid, status, response, created, submitted)
        # one timer at a time: an id that is still open is looked at again when its time is up
        first = created if submitted is None else submitted
        self.handle.registerTimer(first + self.within - self.remember if status == "open" else last)
        self.state.update((uid, submitted, status, response, created, last))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.state.get()
        if held is None:
            return
        uid, submitted, status, response, created, last = held
        at = expiredTimerInfo.getExpiryTimeInMs()
        first = created if submitted is None else submitted
        if status == "open" and at >= first + self.within - self.remember:
            status = "unknown" if submitted is None else "missing"
            self.state.update((uid, submitted, status, response, created, last))
            self.handle.registerTimer(last)
            yield self._row(key, uid, status, response, created, submitted)
        elif at >= last:
            self.state.clear()

    def _row(self, key, uid, status, response, created, submitted) -> Row:
        delay = None if created is None or submitted is None else created - submitted
        return Row(custom_id=key[0], uid=uid, status=status, response=response, delay_ms=delay)


def records(requests: DataFrame, results: DataFrame) -> DataFrame:
    """One table of both kinds: requests (custom_id, uid, submitted), results (custom_id, response, created).

    Rows without an id or a time are left out.
    """
    none = F.lit(None).cast("string")
    asked = requests.select(F.col("custom_id").cast("string"), F.col("uid").cast("string"), none.alias("response"), F.lit(False).alias("is_result"), F.col("submitted").alias("at"))
    came = results.select(F.col("custom_id").cast("string"), none.alias("uid"), F.col("response").cast("string"), F.lit(True).alias("is_result"), F.col("created").alias("at"))
    both = asked.unionByName(came).where("custom_id IS NOT NULL AND at IS NOT NULL").withColumn("at", F.col("at").cast("timestamp"))
    return both.withColumn("ms", F.unix_millis("at"))


def outcomes(rows: DataFrame, within_s: int = 86_400, remember_s: int = 30 * 86_400) -> DataFrame:
    """The outcomes (``OUTCOME``) of a stream of ``RECORD`` rows."""
    if remember_s < within_s:
        raise ValueError("an id must be remembered at least as long as it is waited for")
    known = rows.withWatermark("at", f"{remember_s} seconds")
    return known.groupBy("custom_id").transformWithState(Collector(within_s * 1000, remember_s * 1000), OUTCOME, "append", "EventTime")


def collect_new(spark: SparkSession, source: str, path: str, checkpoint: str, within_s: int = 86_400, remember_s: int = 30 * 86_400) -> StreamingQuery:
    """Append the outcomes of the record files that are new below ``source``, and stop.

    ``source`` is a Parquet folder of ``records``.  State lies in RocksDB on the executors and,
    after every batch, in ``checkpoint``.
    """
    rows = spark.readStream.schema(RECORD).parquet(source)
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:  # a stream keeps the settings that it starts with
        out = outcomes(rows, within_s, remember_s).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        return out.outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, before)


def collect_all(requests: DataFrame, results: DataFrame, within_s: int = 86_400, remember_s: int = 30 * 86_400) -> DataFrame:
    """The outcomes of tables that are there already, through the same state."""
    spark = requests.sparkSession
    folder = scratch(spark)
    records(requests, results).write.parquet(f"{folder}/in")
    collect_new(spark, f"{folder}/in", f"{folder}/out", f"{folder}/state", within_s, remember_s).awaitTermination()
    return spark.read.schema(OUTCOME).parquet(f"{folder}/out")
