"""Times the headline queries; prints one JSON line.

Each query runs once to warm up and is then timed over whole results, written to the
`noop` sink so that nothing is collected. BENCH_SF_DIR and BENCH_CPUS choose tables and cores; BENCH_QUERIES names the
queries to time. The slowest of ten batches of the streaming job over a live-like feed is given beside them; it isn't in
the total.
"""

from __future__ import annotations

import json
import os
import time

from headway.model import session
from headway.plans.queries import registered

HEADLINE = (
    "decode_json", "parse_board_xml", "dedup_first", "awt_panes", "awt_panes_by_station",
    "awt_last_window_latest", "awt_ordered", "awt_global", "next_stop_events", "next_stop_lineitem",
    "train_progress_coarse", "accurate_position", "accurate_position_spline", "positions_track", "station_paths",
    "spline_knots", "cubic_position", "ancestors_from_parents", "line_membership", "map_layers_with_rail", "distinct_track_points",
    "path_lengths", "stream_awt", "stream_awt_windows", "stream_panes", "stream_legs", "stream_late_rows",
)


def slowest_live_batch(spark, folder: str, batches: int = 10) -> float:
    """Seconds of the slowest of ten successive batches of the default streaming job, after two to warm up.

    The feed is as a live one: each poll, a minute after the one before, holds the departures of the next two hours.
    """
    from datetime import datetime, timedelta
    from uuid import uuid4

    from pyspark.sql import functions as F

    from headway.model import Settings, shared_folder
    from headway.plans import table_feed as feed
    from headway.plans.queries import AS_OF, STREAM_COLUMNS
    from headway.streaming import jobs

    run = f"{shared_folder(spark)}/live-{uuid4().hex}"
    start = datetime.fromisoformat(AS_OF)
    events = spark.read.parquet(f"{folder}/events.parquet")
    polls = [start + timedelta(minutes=n) for n in range(batches + 2)]
    for now in polls:
        seen = events.filter(F.col("ts").between(F.lit(now - timedelta(minutes=5)), F.lit(now + timedelta(hours=2))))
        seen.coalesce(1).write.mode("append").parquet(f"{run}/feed")
    raw = spark.readStream.schema(feed.EVENTS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{run}/feed")
    departures = feed.as_departures(raw.withColumn("ingest_ts", F.col("_metadata.file_modification_time")), "ingest_ts")
    clock = iter(polls)
    publisher = jobs.ReportPublisher(
        spark, jobs.DepartureTable(spark, f"{run}/departures", STREAM_COLUMNS), run, feed.supplier_stations(spark, folder),
        settings=Settings(), as_of=lambda: str(next(clock)), order_by=["event_id"],
    )
    job = jobs.default_job(spark, departures, publisher, run).start()
    job.await_termination()
    took = [p["durationMs"]["triggerExecution"] / 1000 for q in job.running.values() for p in q.recentProgress if p["numInputRows"]]
    job.stop()
    return round(max(took[2:]), 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = os.environ.get("BENCH_QUERIES")
    queries = registered()
    times: dict[str, float] = {}
    for name in wanted.split(",") if wanted else HEADLINE:
        for _ in range(2):
            begin = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - begin, 3)
    total = round(sum(times.values()), 3)
    if not wanted:
        times["slowest_live_batch"] = slowest_live_batch(spark, folder)
    print(json.dumps({
        "metric": "total time of the headline queries", "value": total, "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
