"""What only shows in tables larger than the given ones, on rows made for it."""

import glob

from pyspark.sql import functions as F

from podweave.plans import queries


def events(spark, home, ids, users=7, partitions=1):
    """An events table of these ids."""
    ids = spark.createDataFrame([(i,) for i in ids], "event_id bigint")
    ids.repartition(partitions).select(
        "event_id", F.expr("timestamp_seconds(1704067200 + event_id % 1000)").cast("timestamp_ntz").alias("ts"),
        (F.col("event_id") % users).alias("user_id"), F.expr("element_at(array('view', 'error', 'signup'), cast(event_id % 3 + 1 AS int))").alias("event_type"),
        F.lit(1.0).alias("value"), F.concat(F.lit('{"k": '), F.col("event_id").cast("string"), F.lit("}")).alias("props"),
    ).write.parquet(f"{home}/events.parquet")
    return str(home)


def test_times_of_day_beyond_64_bits(spark, tmp_path):
    ids = [0, 499, 500, 1_164_000, 1_170_000, 6_000_001, 36_000_000, 10**12]
    found = {r.event_id: r.time_of_day for r in queries.times_of_day(spark, events(spark, tmp_path, ids)).collect()}

    def time_of_day(nanos):
        seconds, micros = divmod(nanos // 1000 % 86_400_000_000, 10**6)
        return f"{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}.{micros:06d}"

    assert found == {i: time_of_day((i - 500) * 7919000000123) for i in ids}


def test_a_pod_has_one_log_file_however_its_events_lie(spark, tmp_path):
    home = events(spark, tmp_path, range(400), partitions=6)
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))  # a task per file of the table
    try:
        tree = queries._log_tree(spark, home, "test")
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(glob.glob(f"{tree}/**/*.log", recursive=True)) == 7
