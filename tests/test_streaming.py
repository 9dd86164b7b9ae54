"""Streaming admission against the batch form, and delivery that fails and is repeated."""



from podweave.operators.admission import admit
from podweave.operators.chunks import add_chunk
from podweave.streaming.admission import admit_stream
from podweave.streaming.delivery import start


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"k{i % 3}", i, 1000 + i * 7, i % 4, i % 41 == 5) for i in range(240)]
    schema = "key string, seq bigint, clock bigint, cost bigint, reset boolean"
    df = spark.createDataFrame(rows, schema)
    expected = admit(add_chunk(df, "seq", 50), ["key"], "chunk", "seq", "clock", "cost", 90, 6, "reset").collect()
    df.where("seq < 100").coalesce(1).write.parquet(str(tmp_path / "in"))
    got = []
    for at in (0, 1):
        stream = admit_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")),
                              ["key"], "seq", "clock", "cost", 90, 6, "reset")
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        query.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        if at == 0:
            df.where("seq >= 100").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.key, r.seq, r.admitted) for r in got} == {(r.key, r.seq, r.admitted) for r in expected}
    assert len(got) == len(expected)


def test_a_failed_batch_comes_again_under_its_id(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    seen = []

    def handle(rows, delta):
        seen.append((delta, rows.count()))
        if len(seen) == 1:
            raise RuntimeError("sink is away")

    for _ in range(2):
        query = start(spark.readStream.schema("id bigint").parquet(str(tmp_path / "in")), handle, str(tmp_path / "state"))
        if not seen or len(seen) == 1:
            try:
                query.awaitTermination()
            except Exception as error:
                assert "sink is away" in str(error)
    assert seen == [(0, 5), (0, 5)]
