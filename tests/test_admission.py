"""Admission against a plain loop, and the cases of the limiter's contract."""

import random

import pytest
from pyspark.sql import functions as F

from podweave.operators.admission import Outcomes, admit, ceiled, outcome, spend
from podweave.operators.chunks import add_chunk, few_chunks, long_streams, sparse_streams, wide_chunks


def admit_in_order(rows, rate, burst):
    """Independent loop: (key, seq, clock, cost, reset) in order -> {(key, seq): admitted}."""
    burst = min(burst, 4_194_303)
    buckets, found = {}, {}
    for key, seq, clock, cost, reset in sorted(rows):
        if reset:
            buckets[key] = [burst, clock]
            continue
        bucket = buckets.setdefault(key, [burst, clock])
        if cost > burst:
            found[key, seq] = False
            continue
        elapsed = clock - bucket[1] if clock >= bucket[1] else 0
        level = bucket[0] + rate * elapsed / 1000.0
        level = int(burst if level > burst else level)
        found[key, seq] = level >= cost
        if level >= cost:
            buckets[key] = [level - cost, clock]
    return found


def run(spark, rows, rate, burst, span=10**6, chunk_rows=0):
    df = spark.createDataFrame(rows, "key string, seq bigint, clock bigint, cost bigint, reset boolean")
    df = add_chunk(df, "seq", span).withColumn("extra", F.col("seq").cast("string"))
    verdicts = admit(df, ["key"], "chunk", "seq", "clock", "cost", rate, burst, "reset", chunk_rows)
    out = verdicts.collect()
    assert all(r.extra == str(r.seq) for r in out)
    return {(r.key, r.seq): r.admitted for r in out}


@pytest.mark.parametrize("span", [5, 60, 10**6])
@pytest.mark.parametrize("rate, burst, step", [(3, 5, 100), (10, 40, 30), (100, 5, 21), (10_000, 50, 3)])
def test_chunks_do_not_change_the_verdicts(spark, span, rate, burst, step):
    rng = random.Random(rate + span)
    rows = []
    for key, n in (("hot", 300), ("warm", 40), ("one", 1)):
        clock = 1000
        for seq in range(n):
            clock += rng.choice([0, 1, step, step * 2, -5])
            rows.append((key, seq, clock, rng.choice([0, 1, 1, 2, 8]), rng.random() < 0.03))
    want = admit_in_order(rows, rate, burst)
    assert run(spark, rows, rate, burst, span) == want
    if span == 5:
        assert run(spark, rows, rate, burst, span, 100) == run(spark, rows, rate, burst, span, 1000) == want


def test_sparse_streams_stay_in_one_chunk(spark):
    rows = [("hot", i) for i in range(200)] + [("sparse", i) for i in range(0, 200, 20)]
    df = add_chunk(spark.createDataFrame(rows, "key string, seq bigint"), "seq", 10)
    assert {r.key for r in long_streams(df, ["key"], "chunk").collect()} == {"hot", "sparse"}
    few = few_chunks(df, ["key"], "chunk", sparse_streams(df, ["key"], "chunk", 100))
    assert few.columns == df.columns and {r.key for r in long_streams(few, ["key"], "chunk").collect()} == {"hot"}
    assert few.where("key = 'hot'").exceptAll(df).count() == 0 and few.count() == df.count()


def test_lasting_overload_of_equal_costs(spark):
    """The bucket never fills up again and its phase never changes: the states meet only along the chunks."""
    rows = [("hot", i, 1000 + i, 64, False) for i in range(120)]
    assert run(spark, rows, 10_000, 640, 30) == admit_in_order(rows, 10_000, 640)


@pytest.mark.parametrize("rate, burst", [(1, 5), (3, 40), (1000, 7), (10_000, 50)])
def test_outcomes_tell_every_end(rate, burst):
    rng = random.Random(rate + burst)
    for _ in range(40):
        clock, rows = 1000, []
        for _ in range(rng.randrange(1, 120)):
            clock += rng.choice([0, 1, 7, 300, 1500, -3])
            rows.append((rng.choice([0, 1, 1, 1, 2, 6, burst + 1]), clock, rng.random() < 0.01))
        made = Outcomes(rate, burst)
        made.MERGE = rng.choice([1, 7, 64])
        made.add(*zip(*rows))
        for state in [None, *((rng.randrange(burst + 1), 1000 - rng.choice([0, 1, 999, 5000, -2])) for _ in range(20))]:
            _, want = spend(state, *zip(*rows), rate, burst)
            got = outcome(state or (-1, -1), made.table(), rate, burst)
            assert got == want or got is None and min(c for _, c, _ in rows) < max(state[1], rows[0][1])


@pytest.mark.parametrize("cost, per_ms", [([1], 1), ([1], 20), ([64], 1), ([1, 2, 97], 3), ([1], 0), ([50_000, 1, 7, 50_001], 1)])
@pytest.mark.parametrize("rate, burst", [(10_000, 50_000), (1200, 50_000), (7, 3000)])
def test_outcomes_of_large_buckets(cost, per_ms, rate, burst):
    rng = random.Random(rate)
    rows = [(rng.choice(cost), 1000 + (i // per_ms if per_ms else 0), False) for i in range(1500)]
    made = Outcomes(rate, burst)
    made.add(*zip(*rows[:700]))
    made.table()
    made.add(*zip(*rows[700:]))
    table = made.table()
    assert table[4] == sorted(set(table[4]))
    for tokens in [*range(0, burst + 1, burst // 60), burst]:
        state = (tokens, 1000 - rng.choice([0, 1, 17]))
        assert outcome(state, table, rate, burst) == spend(state, *zip(*rows), rate, burst)[1]


def test_tables_do_not_grow_with_the_burst():
    """Neighbouring levels that see the same verdicts are one range."""
    costs, resets = [1] * 4000, [False] * 4000
    for per_ms in (1, 20):
        clocks = [1000 + i // per_ms for i in range(4000)]
        sizes = []
        for burst in (50_000, 4_194_303):
            made = Outcomes(10_000, burst)
            made.add(costs, clocks, resets)
            sizes.append(len(made.table()[4]))
            assert len(made.least) < 200
        assert max(sizes) <= 20


def test_chunks_of_a_large_bucket(spark):
    rows = [("hot", i, 1000 + i // 20, 1 + i % 97, i == 2500) for i in range(4000)]
    assert run(spark, rows, 10_000, 50_000, 300) == admit_in_order(rows, 10_000, 50_000)


@pytest.mark.parametrize("chunks", [12, 48])
def test_the_input_is_read_a_fixed_number_of_times(spark, chunks):
    rows = [("hot", i, 1000 + i, 1, False) for i in range(480)]
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    schema = "key string, seq bigint, clock bigint, cost bigint, reset boolean"
    df = add_chunk(spark.createDataFrame(rows, schema).mapInArrow(count, schema), "seq", 480 // chunks)
    got = admit(df, ["key"], "chunk", "seq", "clock", "cost", 1, 5, "reset", 0).collect()
    assert {(r.key, r.seq): r.admitted for r in got} == admit_in_order(rows, 1, 5)
    assert read.value <= 3 * len(rows)


def verdicts(spark, requests, rate, burst):
    rows = [("k", i, clock, cost, reset) for i, (clock, cost, reset) in enumerate(requests)]
    got = run(spark, rows, rate, burst)
    return [got[k] for k in sorted(got)]


def test_burst_then_refill(spark):
    requests = [(0, 1, False)] * 6 + [(21, 1, False)] * 3
    assert verdicts(spark, requests, 100, 5) == [True] * 5 + [False] + [True, True, False]


def test_more_than_burst_is_refused(spark):
    assert verdicts(spark, [(0, 6, False), (0, 5, False)], 10, 5) == [False, True]


def test_fraction_is_lost_on_success_and_kept_on_refusal(spark):
    # 50 ms at 10/s is half a token: lost whenever a request passes, kept while they are refused.
    assert verdicts(spark, [(0, 5, False), (50, 0, False), (100, 1, False)], 10, 5) == [True, True, False]
    assert verdicts(spark, [(0, 5, False), (50, 1, False), (100, 1, False)], 10, 5) == [True, False, True]


def test_clock_going_back_stores_the_earlier_time(spark):
    assert verdicts(spark, [(1000, 4, False), (500, 1, False), (600, 1, False)], 10, 5) == [True, True, True]


def test_cost_zero_moves_the_clock(spark):
    assert verdicts(spark, [(0, 5, False), (90, 0, False), (180, 1, False)], 10, 5) == [True, True, False]


def test_registration_gives_a_full_bucket(spark):
    assert verdicts(spark, [(0, 5, False), (0, 1, False), (0, 0, True), (0, 5, False)], 10, 5) == [True, False, True]


def test_burst_has_a_ceiling(spark):
    big = 4_194_303
    assert verdicts(spark, [(0, big, False)], 1, 10**7) == [True]
    assert verdicts(spark, [(0, big + 1, False)], 1, 10**7) == [False]


@pytest.mark.parametrize("missing", ["clock_ms", "cost"])
def test_a_request_without_clock_or_cost_is_an_error(spark, missing):
    requests = spark.createDataFrame([("k", 0, 1, 10, 1, False)], "k string, chunk bigint, seq bigint, clock_ms bigint, cost bigint, reset boolean")
    requests = requests.withColumn(missing, F.lit(None).cast("bigint"))
    with pytest.raises(Exception, match=f"no {missing}"):
        admit(requests, ["k"], "chunk", "seq", "clock_ms", "cost", 1, 5, "reset").collect()
    kept = admit(requests.withColumns({"reset": F.lit(True), "clock_ms": F.lit(1).cast("bigint")}),
                 ["k"], "chunk", "seq", "clock_ms", "cost", 1, 5, "reset")
    assert kept.count() == 0


def test_a_burst_over_the_ceiling_warns():
    with pytest.warns(UserWarning, match="over the ceiling"):
        assert ceiled(10**7) == 4_194_303


def test_a_stream_of_many_chunks_has_few_tables(spark):
    rng, clock, rows = random.Random(5), 0, []
    for seq in range(400):
        clock += rng.choice([0, 3, 20, -4])
        rows.append(("hot", seq, clock, rng.choice([0, 1, 2, 8]), rng.random() < 0.02))
    rows += [(None, seq, seq * 5, 2, False) for seq in range(90)]
    df = add_chunk(spark.createDataFrame(rows, "key string, seq bigint, clock bigint, cost bigint, reset boolean"), "seq", 3)
    wide = wide_chunks(df, ["key"], "chunk", 40)
    assert wide.where("key = 'hot'").select("_low").distinct().count() <= 41 and wide.where("key IS NULL").count() == 0
    assert wide_chunks(df, ["key"], "chunk", 134) is None
    verdicts = admit(df, ["key"], "chunk", "seq", "clock", "cost", 50, 30, "reset", 0, most_chunks=40).collect()
    assert {(r.key, r.seq): r.admitted for r in verdicts if r.key} == admit_in_order(rows[:400], 50, 30)
    assert all(r.chunk == r.seq // 3 for r in verdicts) and len(verdicts) == len(rows) - sum(r[4] for r in rows)
