"""Headline queries: prints one JSON line with their times."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from podweave.operators.admission import admit  # noqa: E402
from podweave.operators.asof import latest_registration  # noqa: E402
from podweave.operators.batching import batch_pieces  # noqa: E402
from podweave.operators.chunks import add_chunk  # noqa: E402
from podweave.operators.parsing import parse_lines  # noqa: E402
from podweave.plans.queries import QUERIES  # noqa: E402
from podweave.plans.tables import event_lines, scratch  # noqa: E402

HEADLINE = [
    "volume_by_namespace", "parsed_lines", "parsed_documents", "events_enriched", "event_batches", "document_batches",
    "document_batch_contents", "admitted_events", "admitted_hot_stream", "batch_registration_asof", "rendered_lines",
    "frame_payloads", "frame_roundtrip", "pipeline_verdicts", "scanned_directory",
]


def parse_rate(spark: SparkSession, sf_dir: str, files: int) -> int:
    """Lines per second of the parser alone, on stored lines in several files: the tables' lines ten times."""
    home = scratch(spark, "bench")
    event_lines(spark, sf_dir).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(10)))).select(
        "path", "line").repartition(files).write.parquet(home)
    lines, best = spark.read.parquet(home), float("inf")
    for _ in range(3):
        begun = time.time()
        parse_lines(lines).write.format("noop").mode("overwrite").save()
        best = min(best, time.time() - begun)
    return round(lines.count() / best)


def steady_rates(spark: SparkSession, sf_dir: str, files: int) -> dict[str, int]:
    """Rows per second of admission, batching and the as-of join alone, on stored slim rows: the events ten times over, one
    copy behind the other, in several files."""
    home = scratch(spark, "bench-slim")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    size = events.count()
    rows = events.select("user_id", "event_type", F.octet_length("props").cast("bigint").alias("bytes"),
                         F.explode(F.sequence(F.lit(0), F.lit(9))).alias("copy"), "event_id")
    rows = rows.withColumn("event_id", F.col("event_id") + F.col("copy") * size).withColumns(
        {"clock_ms": 2 * F.col("event_id"), "cost": F.lit(1), "hot": F.lit(0)})
    add_chunk(rows, "event_id", 1 << 17).repartition(files).write.parquet(home)
    stored = spark.read.parquet(home)
    signed = stored.where("event_type = 'signup'").select("user_id", "chunk", "event_id", "clock_ms")
    work = {
        "admission": lambda: admit(stored, ["user_id"], "chunk", "event_id", "clock_ms", "cost", 3, 5),
        "admission_one_overloaded_stream": lambda: admit(stored, ["hot"], "chunk", "event_id", "clock_ms", "cost", 50, 100),
        "admission_one_overloaded_stream_default_burst": lambda: admit(stored, ["hot"], "chunk", "event_id", "clock_ms", "cost", 50),
        "batching": lambda: batch_pieces(stored, ["user_id"], "chunk", "event_id", "bytes"),
        "batching_one_stream": lambda: batch_pieces(stored, ["hot"], "chunk", "event_id", "bytes"),
        "asof": lambda: latest_registration(stored.select("user_id", "chunk", "event_id"), signed, ["user_id"], "chunk", "event_id"),
    }
    rates = {}
    for name, run in work.items():
        begun = time.time()
        run().write.format("noop").mode("overwrite").save()
        rates[name] = round(10 * size / (time.time() - begun))
        print(name, rates[name], "rows/s", file=sys.stderr, flush=True)
    return rates


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    started = time.time()
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("podweave-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    start_up = time.time() - started
    # One untimed run starts the JVM's compiler and the Python workers; the rate below is that of the run after it.
    QUERIES["volume_by_namespace"](spark, sf_dir).collect()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        begun = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - begun, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    rate = parse_rate(spark, sf_dir, 2 * int(cpus))
    steady = steady_rates(spark, sf_dir, 2 * int(cpus)) if not sys.argv[1:] else {}
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(json.dumps({
        "metric": "total time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1], "spark_start_up_sec": round(start_up, 1),
        "parse_lines_per_sec_steady": rate, "rows_per_sec_steady": steady,
        "parse_events_per_sec": round(events / times["volume_by_namespace"]) if "volume_by_namespace" in times else None,
        "admit_events_per_sec": round(events / times["admitted_events"]) if "admitted_events" in times else None,
    }))


if __name__ == "__main__":
    main()
