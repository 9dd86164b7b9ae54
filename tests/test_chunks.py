import random

from pyspark.sql import functions as F

from podweave.operators.asof import latest_registration
from podweave.operators.chunks import add_chunk, number_rows
from podweave.operators.registry import build_registry, join_registry


def test_number_rows_is_consecutive_also_with_ties(spark):
    rng = random.Random(5)
    rows = [(rng.choice([0, 0, 0, 7, 8]), f"p{i:04d}") for i in range(500)]
    got = number_rows(spark.createDataFrame(rows, "a bigint, b string"), "a", "b", name="n")
    assert [(r.a, r.b) for r in sorted(got.collect(), key=lambda r: r.n)] == sorted(rows)
    assert sorted(r.n for r in got.collect()) == list(range(1, 501))


def test_registry_goes_on_behind_a_known_one(spark):
    events = spark.createDataFrame([("/b_p_u/c/0.log", 3), ("/a_p_u/c/0.log", 5), ("/b_p_u/c/0.log", 9)], "path string, at bigint")
    first = build_registry(events, "at")
    assert {r.path: r.stream_id for r in first.collect()} == {"/b_p_u/c/0.log": 1, "/a_p_u/c/0.log": 2}
    more = events.union(spark.createDataFrame([("/z_p_u/c/0.log", 1)], "path string, at bigint"))
    assert [(r.path, r.stream_id, r.namespace) for r in build_registry(more, "at", known=first).collect()] == [
        ("/z_p_u/c/0.log", 3, "z")]
    assert {r.stream_id for r in join_registry(events, first).collect()} == {1, 2}


def test_asof_over_chunks(spark):
    rng = random.Random(9)
    rows = [("hot" if i % 3 else f"k{i % 7}", i, rng.random() < 0.05) for i in range(400)]
    expected, last = {}, {}
    for key, seq, is_reg in rows:
        if is_reg:
            last[key] = f"pod{seq}"
        else:
            expected[key, seq] = last.get(key)
    df = add_chunk(spark.createDataFrame(rows, "key string, seq bigint, reg boolean"), "seq", 25)
    regs = df.where("reg").select("key", "chunk", "seq", F.concat(F.lit("pod"), F.col("seq")).alias("pod"))
    got = latest_registration(df.where("not reg"), regs, ["key"], "chunk", "seq").collect()
    assert {(r.key, r.seq): r.pod for r in got} == expected
