"""Continuous publication of the reports.

Departures are scheduled ahead, so their own times say little about how late a record
is. By default each batch is therefore compared with the stored departures of the days it is about, what is new is
appended to that table, and each report is computed by the batch functions over the part
of it its `as_of` needs: no record comes too late. `unique_departures` removes repeats in a stream's state, for a
horizon of ingest time. The compat streams keep a watermark on the departure time and state for all windows, with
complete output.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone
from functools import reduce
from uuid import uuid4

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from headway.functions.clock import instant
from headway.model import Settings
from headway.operators.awt import global_awt, max_awt, min_awt, ordered_awt, trains_per_window, with_awt
from headway.operators.dedup import REPEAT_KEYS, complete_order, dedup_departures
from headway.operators.filters import around, realtime_only, with_epoch
from headway.plans.reports import awt_range, last_hour_awt, progress_range, train_progress

AWT_VIEWS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "ordered_awt": ordered_awt,
    "global_awt": global_awt,
    "min_awt": min_awt,
    "max_awt": max_awt,
}


# --- streaming plans ---------------------------------------------------------

def with_watermark(df: DataFrame, ts: str = "timestamp", delay: str = "1 minutes") -> DataFrame:
    return df.withWatermark(ts, delay)


def unique_departures(
    departures: DataFrame, horizon: str = "8 hours", keys=None, salt_on: tuple[str, ...] = (), salts: int = 16
) -> DataFrame:
    """Records without their repeats, remembered for `horizon` of ingest time (`ingest_ts`).

    keys: what makes two records repeats; all columns but `ingest_ts` and `salt_on` if
    None. A departure that is announced again with a change is then kept, and the report
    takes the first record of it.

    Rows more than `horizon` behind the newest ingest time are refused; `StreamJob` counts and reports them.

    A record that is repeated very often would send all its repeats to one task. With
    `salt_on` (columns that differ between repeats, such as partition and offset) a first
    stage removes repeats within `salts` groups, so the second stage sees at most that
    many copies of one record.
    """
    keys = list(keys or [c for c in departures.columns if c != "ingest_ts" and c not in salt_on])
    df = departures.withWatermark("ingest_ts", horizon)
    if salt_on:
        df = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_on), F.lit(salts)))
        df = df.dropDuplicatesWithinWatermark([*keys, "_salt"]).drop("_salt")
    return df.dropDuplicatesWithinWatermark(keys)


def awt_stream(departures: DataFrame, settings: Settings = Settings(), keys=("station",), decimals: int = 1) -> DataFrame:
    """All windows with their waiting times, on departure time (compat mode)."""
    delayed = with_watermark(departures, "timestamp", f"{settings.watermark_minutes} minutes")
    unique = delayed.dropDuplicates(list(REPEAT_KEYS))
    windows = trains_per_window(
        unique, keys, "timestamp", settings.window_minutes, settings.slide_minutes, method="expand"
    )
    return with_awt(windows, settings.window_minutes, decimals)


def global_awt_stream(windows: DataFrame) -> DataFrame:
    """Mean over the stations of each window of `awt_stream`, as a second aggregation in the same stream."""
    return windows.groupBy(F.window(F.window_time("window"), "1 second")).agg(
        F.count("station").alias("number_of_stations"), F.avg("awt").alias("global_awt"),
        F.max("window.end").alias("window_end"),
    ).drop("window")


def stops_stream(departures: DataFrame, as_of=None, settings: Settings = Settings()) -> DataFrame:
    """Stops around the trigger time, repeats removed before the time filter (compat mode).

    A departure first seen outside the range never appears, and state is never dropped.
    """
    unique = departures.dropDuplicates(list(REPEAT_KEYS))
    near = around(with_epoch(realtime_only(unique)), as_of, settings.around_seconds)
    stop = ("train", "station", "departure", "mode", "mission", "terminus")
    # An aggregate, as complete output needs one; repeats are gone, so `records` is 1 but for stops of equal times.
    counted = near.groupBy(*stop).agg(F.count(F.lit(1)).alias("records"))
    return counted.select(*stop).orderBy("train", "departure", "station")


def console_sink(df: DataFrame, order_by: str = "awt", trigger_seconds: int = 2, output_mode: str = "complete"):
    """Writer that prints the whole ordered result at each trigger."""
    return (
        df.orderBy(order_by).writeStream.format("console").option("truncate", False)
        .outputMode(output_mode).trigger(processingTime=f"{trigger_seconds} seconds")
    )


# --- tables and views ----------------------------------------------------------

DAY_FORMAT = "yyyy-MM-dd"


class DepartureTable:
    """Unique departures on shared storage, by service day and in order of time within a day's files.

    A batch owns the partitions `(service_day, batch)` it writes, so a repeated batch replaces its own rows and nothing
    else. What is stored is what tells repeats: a batch is compared with the days that its own rows are of, so no state
    is kept, nothing is too late, and a restart forgets nothing. `compact` puts the batches of past days together,
    `expire` removes days that no report needs any more.

    keys: what makes two records repeats; all columns but `ingest_ts` if None. order_by: which of the repeats within
    one batch is kept. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, columns: str, keys=None, order_by=("ingest_ts",)):
        self.spark, self.path = spark, path.rstrip("/")
        self.columns = columns
        names = StructType.fromDDL(columns).names
        self.keys = list(keys or [c for c in names if c != "ingest_ts"])
        self.order_by = [c for c in order_by if c in names]

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """Stores the rows of a batch that neither it nor an earlier one has already.

        Rows of the batch's own number don't count as stored, so a batch that is run again, after a failure before its
        end was noted, stores the same rows again.
        """
        rows = batch.select(*StructType.fromDDL(self.columns).names, F.date_format("timestamp", DAY_FORMAT).alias("service_day"))
        unique = dedup_departures(rows, self.keys, complete_order(rows, self.order_by)).persist()
        try:
            days = [r[0] for r in unique.select("service_day").distinct().collect()]
            stored = self.read(days).filter(F.col("batch") != batch_id) if days else None
            new = unique if stored is None else unique.alias("b").join(
                stored.select(*self.keys).alias("s"), _same("b", "s", self.keys), "left_anti"
            )
            self._write(new.withColumn("batch", F.lit(batch_id).cast("long")))
        finally:
            unique.unpersist()

    def _write(self, rows: DataFrame) -> None:
        (
            rows.hint("rebalance", "service_day").sortWithinPartitions("service_day", "batch", "timestamp")
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("service_day", "batch").parquet(self.path)
        )

    def read(self, days: list[str | None] | None = None) -> DataFrame:
        """Stored rows, of some service days (None: of rows without timestamp) or of all; only their folders are listed."""
        schema = f"{self.columns}, service_day string, batch bigint"
        names = "*" if days is None else "{" + ",".join(d or "__HIVE_DEFAULT_PARTITION__" for d in days) + "}"
        places = _list(self.spark, f"{self.path}/service_day={names}")
        if not places:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*places)

    def between(self, start, end) -> DataFrame:
        """Rows with `timestamp` in `[start, end]`; within the files of these days, statistics skip other times."""
        lo, hi = instant(start), instant(end)
        days = F.sequence(F.to_date(lo), F.to_date(hi), F.expr("interval 1 day"))
        listed = self.spark.sql("SELECT 1").select(F.transform(days, lambda d: F.date_format(d, DAY_FORMAT))).first()[0]
        return self.read(listed).filter(F.col("timestamp").between(lo, hi))

    def _folders(self) -> dict[str, list[int]]:
        """The batches of each stored day."""
        found: dict[str, list[int]] = {}
        for folder in _list(self.spark, f"{self.path}/service_day=*/batch=*"):
            day, batch = folder.split("/")[-2:]
            found.setdefault(day.partition("=")[2], []).append(int(batch.partition("=")[2]))
        return found

    def compact(self, before, least_batches: int = 2) -> None:
        """Puts the batches of all days before `before` that have some number of them into one folder a day, in one job.

        The new folders are written before the old ones go, so a reader in between sees repeats, which reports
        remove, but never too little. Run it from one place at a time.
        """
        last = self._day(before)
        many = {day: own for day, own in self._folders().items() if day < last and len(own) >= least_batches}
        if not many:
            return
        rows = self.read(list(many))
        unique = dedup_departures(rows, self.keys, complete_order(rows, [*self.order_by, "batch"]))
        self._write(unique.withColumn("batch", F.lit(min(0, *(b for own in many.values() for b in own)) - 1).cast("long")))
        for day, own in many.items():
            for batch in own:
                _delete(self.spark, f"{self.path}/service_day={day}/batch={batch}")

    def expire(self, before) -> None:
        """Removes the days before `before`."""
        last = self._day(before)
        for day in self._folders():
            if day < last:
                _delete(self.spark, f"{self.path}/service_day={day}")

    def _day(self, at) -> str:
        return self.spark.sql("SELECT 1").select(F.date_format(instant(at), DAY_FORMAT)).first()[0]


def _same(left: str, right: str, keys: list[str]) -> Column:
    """Equality of two aliased frames in all keys, NULLs being equal."""
    equal = [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]
    return reduce(lambda a, b: a & b, equal)


def _list(spark: SparkSession, pattern: str, by_age: bool = False) -> list[str]:
    """Paths that match, by name or the oldest first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = list(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or [])
    if by_age:
        found.sort(key=lambda status: status.getModificationTime())
    return [status.getPath().toString() for status in found]


def _delete(spark: SparkSession, place: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class ViewPublisher:
    """`foreachBatch` function that replaces named views with results of the batch.

    The batch is written to shared storage once, to a place of its own, and the views are the results over what is
    read back, so they stay readable after the batch is gone. The last `keep` places stay, those of a former run
    among them: readers of former results are not disturbed for so many batches. on_empty: `keep` leaves the old views
    in place for an empty batch, `replace` publishes the empty result.
    """

    def __init__(self, spark: SparkSession, folder: str, views: dict[str, Callable[[DataFrame], DataFrame]],
                 on_empty: str = "keep", keep: int = 30):
        self.spark, self.folder, self.views, self.on_empty, self.keep = spark, folder.rstrip("/"), views, on_empty, keep
        self.places = _list(spark, f"{self.folder}/*-*", by_age=True)

    def __call__(self, batch: DataFrame, batch_id: int = 0) -> bool:
        place = f"{self.folder}/{batch_id}-{uuid4().hex}"
        seen = Observation()
        batch.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(place)
        self.places.append(place)
        table = self.spark.read.schema(batch.schema).parquet(place)
        published = self.on_empty != "keep" or seen.get["rows"] > 0
        if published:
            self.publish(table, place)
        while len(self.places) > self.keep:
            _delete(self.spark, self.places.pop(0))
        return published

    def publish(self, table: DataFrame, place: str) -> None:
        for name, result in self.views.items():
            result(table).createOrReplaceTempView(name)


class CatalogPublisher(ViewPublisher):
    """Publishes the results in a database of the catalog, for all sessions that share it.

    Each result is written whole to a place of the batch; then the view of its name is replaced by one on that place.
    Sessions look a view up whenever they read it, so they find the former result or the new one, never a part of one
    and never a former one from their caches.
    """

    def __init__(self, spark: SparkSession, folder: str, views: dict[str, Callable[[DataFrame], DataFrame]],
                 database: str, on_empty: str = "keep", keep: int = 30):
        super().__init__(spark, folder, views, on_empty, keep)
        self.database = database

    def publish(self, table: DataFrame, place: str) -> None:
        for name, result in self.views.items():
            own = f"{place}/_results/{name}"
            result(table).write.parquet(own)
            self.spark.sql(f"CREATE OR REPLACE VIEW `{self.database}`.`{name}` AS SELECT * FROM parquet.`{own}`")


class ReportPublisher:
    """`foreachBatch` function of the default mode: store what is new in the batch, then publish both reports.

    `as_of` is called for each batch and gives its instant (now if None). With `database` the results are in
    that database of the catalog, for other sessions as well, else they are views of this session.
    """

    def __init__(self, spark: SparkSession, table: DepartureTable, folder: str, stations: DataFrame,
                 fitted: DataFrame | None = None, settings: Settings = Settings(), as_of: Callable | None = None,
                 on_empty: str = "keep", keys=("station",), order_by=("ingest_ts", "batch"), database: str | None = None):
        self.spark, self.table, self.stations, self.fitted, self.settings = spark, table, stations, fitted, settings
        self.as_of = as_of or (lambda: datetime.now(timezone.utc))
        self.keys, self.order_by = keys, list(order_by)
        trains = {"trains_progression": lambda df: df}
        if database:
            self.awt = CatalogPublisher(spark, f"{folder}/awt", AWT_VIEWS, database, on_empty)
            self.progress = CatalogPublisher(spark, f"{folder}/progress", trains, database, on_empty)
        else:
            self.awt = ViewPublisher(spark, f"{folder}/awt", AWT_VIEWS, on_empty)
            self.progress = ViewPublisher(spark, f"{folder}/progress", trains, on_empty)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.table.append(batch, batch_id)
        now, s = self.as_of(), self.settings

        def waiting() -> None:
            hour = self.table.between(*awt_range(now, s))
            self.awt(last_hour_awt(hour, now, s, self.keys, self.order_by), batch_id)

        def trains() -> None:
            near = self.table.between(*progress_range(now, s))
            accurate = self.fitted is not None
            self.progress(train_progress(near, self.stations, self.fitted, now, s, self.order_by, accurate=accurate), batch_id)

        # Side by side: each is small, and what they wait for is not the same.
        with ThreadPoolExecutor(2) as pool:
            for report in [pool.submit(inheritable_thread_target(f)) for f in (waiting, trains)]:
                report.result()


# --- running -------------------------------------------------------------------

class LateRows(StreamingQueryListener):
    """Counts the rows that stateful steps refuse as late, over all batches, by the id of the query."""

    def __init__(self):
        self.dropped: Counter = Counter()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for operator in event.progress.stateOperators:
            self.dropped[str(event.progress.id)] += operator.numRowsDroppedByWatermark

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


class StreamJob:
    """A set of named streaming queries that start and stop together.

    on_late: what happens when a query refuses rows as late. `fail` ends the job with an error, `report` only counts
    them in `late_rows`.
    """

    def __init__(self, starters: dict[str, Callable[[], StreamingQuery]], on_late: str = "fail"):
        if on_late not in ("fail", "report"):
            raise ValueError(f"unknown policy for late rows {on_late!r}")
        self.starters, self.on_late, self.listener = starters, on_late, LateRows()
        self.running: dict[str, StreamingQuery] = {}

    def start(self) -> "StreamJob":
        self.stop()
        SparkSession.active().streams.addListener(self.listener)
        for name, starter in self.starters.items():
            self.running[name] = starter()
        return self

    def stop(self) -> None:
        for query in self.running.values():
            query.stop()
        if self.running:
            SparkSession.active().streams.removeListener(self.listener)
        self.running = {}

    def late_rows(self) -> int:
        """Rows refused as late since the start."""
        return sum(max(self.listener.dropped[str(q.id)], late_metrics(q)) for q in self.running.values())

    def await_termination(self, timeout: float | None = None) -> None:
        """Waits until all queries have ended. When one fails, the others are stopped and its error is raised at once."""
        end = None if timeout is None else time.monotonic() + timeout
        while True:
            active = [q for q in self.running.values() if q.isActive]
            failed = next((q for q in self.running.values() if not q.isActive and q.exception()), None)
            late = self.late_rows() if self.on_late == "fail" else 0
            if failed or late:
                for query in active:
                    query.stop()
                raise failed.exception() if failed else RuntimeError(f"{late} rows were refused as late")
            if not active or end is not None and time.monotonic() > end:
                return
            active[0].awaitTermination(0.2)

    def process_all(self) -> None:
        for query in self.running.values():
            query.processAllAvailable()


def batch_sink(df: DataFrame, function: Callable[[DataFrame, int], object], checkpoint: str,
               output_mode: str = "append", trigger_seconds: int | None = None) -> StreamingQuery:
    """Starts `function` as `foreachBatch` sink; without a trigger period it runs once over what is there."""
    writer = df.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda batch, batch_id: function(batch, batch_id) and None)
    if trigger_seconds is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{trigger_seconds} seconds").start()


def default_job(spark: SparkSession, departures: DataFrame, publisher: ReportPublisher, folder: str,
                trigger_seconds: int | None = None) -> StreamJob:
    """The default mode as one query: one source, one decoding, both reports; repeats are told by what is stored."""
    return StreamJob({
        "reports": lambda: batch_sink(departures, publisher, f"{folder}/checkpoint", "append", trigger_seconds)
    })


def late_metrics(query: StreamingQuery) -> int:
    """Rows dropped behind the watermark in the batches that `recentProgress` keeps; `LateRows` counts all."""
    return sum(
        operator["numRowsDroppedByWatermark"]
        for progress in query.recentProgress
        for operator in progress["stateOperators"]
    )
