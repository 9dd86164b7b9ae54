"""The registered queries: every operator over the whole given tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from podweave.functions.bytes import be_bytes, be_int64, be_uint, payload_bytes, trim_eol, trim_escaped_eol
from podweave.functions.lines import FORMATS, LineFormat, detect_format, json_string_field
from podweave.functions.paths import pod_metadata
from podweave.functions.rendering import is_stderr, render_line, stream_label
from podweave.functions.timestamps import NANOS, civil_to_ns, format_time_of_day, is_leap, rfc3339_to_ns
from podweave.operators.admission import admit
from podweave.operators.asof import latest_registration
from podweave.operators.batching import assign_batches, batch_pieces, batch_sizes, collect_batches
from podweave.operators.chunks import add_chunk
from podweave.operators.frames import (
    NAMES,
    check_frames,
    decode_events,
    decode_registers,
    encode_batches,
    encode_registry,
    split_frames,
)
from podweave.operators.offsets import complete_lines, with_offsets
from podweave.operators.parsing import malformed_lines, parse_all, parse_lines
from podweave.operators.registry import build_registry, join_registry
from podweave.plans.collect import collect_batch_table, collect_events, collect_frames
from podweave.plans.receive import judge_batches, receive
from podweave.plans.tables import (
    SPAN,
    by_path,
    document_lines,
    event_lines,
    page_lines,
    rename_log_files,
    scratch,
    table,
    write_log_files,
)
from podweave.settings import BURST
from podweave.sources.capture import read_capture, write_capture
from podweave.sources.logdir import listing, read_logs, stream_segments
from podweave.sources.tail import stream_logs
from podweave.sources.textsink import render, stream_text, write_text
from podweave.streaming.admission import admit_stream
from podweave.streaming.delivery import start

RENDERED = ("is_stderr", "stream_id", "timestamp_ns", "payload")


def text() -> Column:
    return F.col("payload").cast("string").alias("payload")


# --- parsing ---------------------------------------------------------------------------------------------------------


def parsed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_lines(event_lines(spark, sf_dir)).select(
        "event_id", "path", "format", "timestamp_ns", "stream", "is_partial", text()
    )


def malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return malformed_lines(event_lines(spark, sf_dir)).select("event_id", "path", "format", "line")


def known_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with one of five tags: F is whole, P is a part, any other makes the line malformed; the byte behind
    the tag is skipped, whatever it is."""
    tag = F.element_at(F.array(*map(F.lit, ("F", "P", "X", "f", "FP"))), (F.col("event_id") % 5 + 1).cast("int"))
    stamp = F.expr("""date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")""")
    lines = table(spark, sf_dir, "events").select(
        "event_id", F.concat(stamp, F.lit("Z stdout "), tag, F.lit(" "), "event_type").alias("line"))
    return parse_all(lines).select("event_id", "timestamp_ns", "is_partial", text())


#: A user's own format: ``key=value`` pairs between semicolons, the time in front.
PAIRS = LineFormat(
    "pairs", lambda line: line.startswith("at="),
    lambda line: F.struct(
        F.regexp_extract(line, "^at=([^;]*);", 1).alias("time"),
        F.when(F.regexp_extract(line, ";level=([a-z]+);", 1) == "warn", "stderr").when(line.isNotNull(), "stdout").alias("stream"),
        F.when(line.isNotNull(), False).alias("is_partial"),
        F.nullif(F.regexp_extract(line, ";msg=(.*)$", 1), F.lit("")).cast("binary").alias("payload")))


def own_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines of a user's format, every seventh without a message, among CRI lines."""
    at = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    level = F.when(F.col("o_orderstatus") == "F", "warn").otherwise("info")
    message = F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.concat(F.lit("price "), F.col("o_custkey").cast("string")))
    line = F.when(F.col("o_orderkey") % 3 == 0, F.concat(at, F.lit(" stderr F order "), F.col("o_orderkey").cast("string"))).otherwise(
        F.concat(F.lit("at="), at, F.lit(";level="), level, F.lit(";msg="), message))
    lines = table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line"))
    return parse_lines(lines, formats=(PAIRS, *FORMATS)).select("o_orderkey", "format", "timestamp_ns", "stream", text())


def line_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = event_lines(spark, sf_dir).withColumn("format", detect_format(F.col("line")))
    lines = lines.withColumn("bytes", payload_bytes(F.col("line")))
    return lines.groupBy("format").agg(F.count("*").alias("lines"), F.sum("bytes").alias("bytes"))


def json_fields_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("line")
    return page_lines(spark, sf_dir).select(
        "page_id", *(json_string_field(line, k).alias(k) for k in ("log", "stream", "time", "missing"))
    )


def parsed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_lines(document_lines(spark, sf_dir)).withColumn("bytes", payload_bytes(F.col("payload")))
    return parsed.select("doc_id", "format", "timestamp_ns", "stream", "bytes", F.md5("payload").alias("payload_md5"))


def trimmed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line ends, real and written out, behind every document."""
    ending = F.element_at(
        F.array(*(F.lit(e) for e in ("\r\n", "\n\n\r", "\\n", "\\r\\n", "\\n\\n", ""))),
        (F.col("doc_id") % 6 + 1).cast("int"),
    )
    data = F.concat("text", ending).cast("binary")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        payload_bytes(data).alias("bytes"),
        F.md5(trim_eol(data)).alias("trimmed"),
        F.md5(trim_escaped_eol(data)).alias("unescaped"),
    )


def ns_from_rfc3339(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.expr("""date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")""")
    behind = F.element_at(
        F.array(*(F.lit(e) for e in ("Z", ".5Z", ".123456789+05:30", "-07:00", ".000001", "+0530", ".Z", ""))),
        (F.col("event_id") % 8 + 1).cast("int"),
    )
    texts = table(spark, sf_dir, "events").select("event_id", F.concat(stamp, behind).alias("text"))
    return texts.withColumn("timestamp_ns", rfc3339_to_ns(F.col("text")))


def ns_from_civil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates shifted beyond their month and day: the calendar rolls over."""
    year, month, day = F.year("o_orderdate"), F.month("o_orderdate"), F.day("o_orderdate") + 40
    key = F.col("o_orderkey")
    nanos = civil_to_ns(year, month, day, key % 30, key % 70, key % 80, key % 1_000_000_000)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", nanos.alias("timestamp_ns"), is_leap(year).alias("leap")
    )


def ns_from_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order years with any month of two digits, as text: 0 is January's start, 13 the next January, above there is none."""
    year, month = F.year("o_orderdate"), F.col("o_orderkey") % 100
    stamp = F.format_string("%04d-%02d-05T06:07:08Z", year, month)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", rfc3339_to_ns(stamp).alias("timestamp_ns"),
        civil_to_ns(year, month, F.lit(5), F.lit(6), F.lit(7), F.lit(8), F.lit(0)).alias("civil_ns"))


def pod_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_lines(spark, sf_dir).select("event_id", pod_metadata(F.col("path")).alias("pod")).select(
        "event_id", "pod.*"
    )


def pods_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses read as paths: every default is met."""
    return table(spark, sf_dir, "pages").select("page_id", pod_metadata(F.col("url")).alias("pod")).select(
        "page_id", "pod.*"
    )


# --- registry --------------------------------------------------------------------------------------------------------


def stream_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_registry(parse_lines(event_lines(spark, sf_dir)), "event_id")


def growing_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reads: the streams of the first keep their ids, those that the second brings go on behind."""
    lines = event_lines(spark, sf_dir)
    read = F.when(F.col("path").contains("/ns0_") | F.col("path").contains("/ns3_"), 1).otherwise(2)
    first = _landed(build_registry(lines.where(read == 1), "event_id"), "registry")
    more = build_registry(lines, "event_id", known=first)
    return first.withColumn("read", F.lit(1)).unionByName(more.withColumn("read", F.lit(2)))


def _landed(df: DataFrame, name: str) -> DataFrame:
    """Store a table once in the shared folder, for the steps behind it to read the columns they need."""
    home = scratch(df.sparkSession, name)
    df.write.parquet(home)
    return df.sparkSession.read.parquet(home)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _landed(collect_events(event_lines(spark, sf_dir)), "events")


def events_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    joined = join_registry(events, build_registry(events, "event_id"))
    return joined.select("event_id", "stream_id", "timestamp_ns", "is_stderr", text(), *NAMES)


def volume_by_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: lines to events to volume per namespace and output stream."""
    events = collect_events(event_lines(spark, sf_dir))
    events = events.withColumn("namespace", pod_metadata(F.col("path"))["namespace"])
    return events.groupBy("namespace", "stream").agg(
        F.count("*").alias("events"),
        F.sum("payload_bytes").alias("bytes"),
        F.min("timestamp_ns").alias("first_ns"),
        F.max("timestamp_ns").alias("last_ns"),
    )


# --- batches ---------------------------------------------------------------------------------------------------------


def event_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collect_batch_table(_events(spark, sf_dir), order="event_id")


def event_batches_per_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read of 1000 arrivals ends every open batch."""
    events = _events(spark, sf_dir).withColumn("delta", F.call_function("div", "event_id", F.lit(1000)))
    return collect_batch_table(events, order="event_id", delta="delta")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(
        "source", "doc_id", F.expr("replace(text, chr(10), ' ')").cast("binary").alias("payload")
    )
    return add_chunk(documents.withColumn("payload_bytes", payload_bytes(F.col("payload"))), "doc_id", 100)


def _document_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_pieces(_documents(spark, sf_dir), ["source"], "chunk", "doc_id", "payload_bytes")


def document_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long payloads: the byte limit cuts."""
    return batch_sizes(_document_pieces(spark, sf_dir), ["source"])


def _assigned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, pieces = _documents(spark, sf_dir), _document_pieces(spark, sf_dir)
    return assign_batches(documents, pieces, ["source"], "chunk", "doc_id")


def document_batch_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned_documents(spark, sf_dir).select("source", "doc_id", "batch_id")


def document_batch_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches as ordered arrays, shown as the list of ids and the digest of the payloads in order."""
    batches = collect_batches(_assigned_documents(spark, sf_dir), ["source"], "doc_id", F.struct("doc_id", "payload"))
    ids = F.transform("events.doc_id", lambda i: i.cast("string"))
    payloads = F.transform("events.payload", lambda p: p.cast("string"))
    return batches.select(
        "source", "batch_id", "event_count",
        F.array_join(ids, ",").alias("doc_ids"), F.md5(F.array_join(payloads, "|")).alias("payload_md5"),
    )


# --- admission -------------------------------------------------------------------------------------------------------


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "events").select(
        "user_id", "event_id", (2 * F.col("event_id")).alias("clock_ms"), F.lit(1).cast("bigint").alias("cost"),
        (F.col("event_type") == "signup").alias("registers"),
    )
    return add_chunk(requests, "event_id", 4 * SPAN)


def admitted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = admit(_requests(spark, sf_dir), ["user_id"], "chunk", "event_id", "clock_ms", "cost", 3, 5)
    return verdicts.select("event_id", "user_id", "admitted")


def admitted_after_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signup registers its stream anew: a full bucket."""
    verdicts = admit(
        _requests(spark, sf_dir), ["user_id"], "chunk", "event_id", "clock_ms", "cost", 2, 4, reset="registers"
    )
    return verdicts.select("event_id", "user_id", "admitted")


def admitted_hot_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in one stream, a cost that differs: the chunks' start states have to be found."""
    requests = _requests(spark, sf_dir).withColumns({"conn": F.lit("all"), "cost": F.col("event_id") % 5 + 1})
    requests = add_chunk(requests, "event_id", SPAN)
    verdicts = admit(requests, ["conn"], "chunk", "event_id", "clock_ms", "cost", 1200, 300, chunk_rows=SPAN)
    return verdicts.select("event_id", "admitted")


def admitted_overload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in one stream that may pass one a second: five hundred times too many, all through."""
    requests = add_chunk(_requests(spark, sf_dir).withColumns({"conn": F.lit("all"), "cost": F.lit(1)}), "event_id", SPAN // 8)
    verdicts = admit(requests, ["conn"], "chunk", "event_id", "clock_ms", "cost", 1, 5, chunk_rows=SPAN // 8)
    return verdicts.select("event_id", "admitted")


def admitted_default_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in one stream, far more than its rate, after a burst of the default size."""
    requests = _requests(spark, sf_dir).withColumns({"conn": F.lit("all"), "cost": F.col("event_id") % 97 + 1})
    requests = add_chunk(requests, "event_id", SPAN // 8)
    verdicts = admit(requests, ["conn"], "chunk", "event_id", "clock_ms", "cost", 1000, BURST, chunk_rows=SPAN // 8)
    return verdicts.select("event_id", "admitted")


def admitted_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = _landed(event_batches(spark, sf_dir), "batches").withColumn("clock_ms", F.col("last_order") * 2)
    verdicts = admit(
        add_chunk(batches, "last_order", 4 * SPAN), ["path"], "chunk", "last_order", "clock_ms", "event_count", 30, 100
    )
    return verdicts.select("path", "batch_id", "event_count", "admitted")


def admitted_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same verdicts from a stream that stops half way and goes on from its checkpoint."""
    home = scratch(spark, "admitted")
    requests = table(spark, sf_dir, "events").select(
        "user_id", "event_id", (2 * F.col("event_id")).alias("clock_ms"), F.lit(1).cast("bigint").alias("cost")
    )
    half = requests.agg(F.expr("max(event_id) div 2")).first()[0]
    # A session of its own: the number of state partitions is fixed with the first trigger; one per core is enough.
    session = spark.newSession()
    partitions = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    session.conf.set("spark.sql.shuffle.partitions", str(partitions))
    for part in (requests.where(F.col("event_id") <= half), requests.where(F.col("event_id") > half)):
        part.write.mode("append").parquet(f"{home}/in")
        stream = session.readStream.schema(requests.schema).parquet(f"{home}/in")
        verdicts = admit_stream(stream, ["user_id"], "event_id", "clock_ms", "cost", 3, 5)
        query = verdicts.writeStream.format("parquet").option("path", f"{home}/out")
        query.option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{home}/out").select("event_id", "user_id", "admitted")


def batch_registration_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = add_chunk(table(spark, sf_dir, "events"), "event_id", SPAN)
    batches = events.where("event_type <> 'signup'").select("user_id", "chunk", "event_id")
    registrations = events.where("event_type = 'signup'").select(
        "user_id", "chunk", "event_id", F.col("event_id").alias("registered_at"), F.col("props").alias("pod_name")
    )
    return latest_registration(batches, registrations, ["user_id"], "chunk", "event_id").drop("chunk")


def registration_asof_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a batch: a sign-up is its own latest registration."""
    events = add_chunk(table(spark, sf_dir, "events"), "event_id", SPAN)
    registrations = events.where("event_type = 'signup'").select(
        "user_id", "chunk", "event_id", F.col("event_id").alias("registered_at"))
    batches = events.select("user_id", "chunk", "event_id")
    return latest_registration(batches, registrations, ["user_id"], "chunk", "event_id").drop("chunk")


# --- rendering and frames --------------------------------------------------------------------------------------------


def rendered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    joined = join_registry(events, build_registry(events, "event_id"))
    return joined.select("event_id", render_line(*(F.col(c) for c in RENDERED)).alias("line"))


def times_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Where the nanoseconds leave 64 bits, whole days are taken off them.
    wide = F.expr("cast((event_id - 500) AS decimal(19, 0)) * 7919000000123")
    nanos = F.coalesce(F.expr("try_multiply(event_id - 500, 7919000000123)"), (wide % (86_400 * NANOS)).cast("bigint"))
    return table(spark, sf_dir, "events").select(
        "event_id", format_time_of_day(nanos).alias("time_of_day"),
        stream_label(is_stderr(F.when(F.col("event_type") == "error", "stderr").otherwise("stdout"))).alias("stream"),
    )


def big_endian_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("l_orderkey") * 1_000_003 - F.col("l_linenumber") * 4_000_000_000
    data = F.concat(be_bytes(key, 8), be_bytes(F.col("l_partkey"), 4), be_bytes(F.col("l_linenumber"), 2))
    read = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", data.alias("data"))
    return read.select(
        "l_orderkey", "l_linenumber", F.hex("data").alias("bytes"), be_int64(F.col("data"), 1).alias("signed"),
        be_uint(F.col("data"), 9, 4).alias("part"), be_uint(F.col("data"), 13, 2).alias("line"),
        be_uint(F.col("data"), 13, 4).alias("beyond"),
    )


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _landed(collect_frames(_events(spark, sf_dir), "node-1", "event_id", order="event_id"), "frames")


def frame_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir).select(
        "seq", F.col("type").cast("bigint").alias("type"), F.octet_length("payload").cast("bigint").alias("bytes"),
        F.md5(F.hex("payload")).alias("payload_md5"),
    )


def batches_sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The errors among every ten events as one batch: ten without an error are an empty batch, and give no frame."""
    event = F.struct(F.col("event_id").alias("timestamp_ns"), F.lit(True).alias("is_stderr"), F.col("props").cast("binary").alias("payload"))
    ten = F.floor(F.col("event_id") / 10).cast("bigint").alias("stream_id")
    batches = table(spark, sf_dir, "events").groupBy(ten).agg(
        F.sort_array(F.collect_list(F.when(F.col("event_type") == "error", event))).alias("events"))
    return encode_batches(batches).select(
        "stream_id", F.octet_length("payload").cast("bigint").alias("bytes"), F.md5(F.hex("payload")).alias("payload_md5"))


def frame_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, batches, _ = split_frames(_frames(spark, sf_dir))
    return decode_events(batches).select("seq", "idx", "stream_id", "timestamp_ns", "is_stderr", text(), "error")


def register_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    registers, _, _ = split_frames(_frames(spark, sf_dir))
    return decode_registers(registers).drop("conn")


def _document_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of the document batches; the stream id is the rank of the source's first document."""
    assigned = _assigned_documents(spark, sf_dir)
    event = F.struct(F.col("doc_id").alias("timestamp_ns"), (F.col("doc_id") % 2 == 1).alias("is_stderr"), "payload")
    batches = collect_batches(assigned, ["source"], "doc_id", event)
    return encode_batches(batches.withColumn("stream_id", F.crc32(F.col("source").cast("binary"))))


def oversized_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size guard on the documents' frames: a batch with one long line can be over the limit."""
    return check_frames(_document_frames(spark, sf_dir)).select(
        "source", "batch_id", F.octet_length("payload").cast("bigint").alias("bytes"), "error"
    )


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a batch frame of its own; by its id sound, cut short, followed by more bytes, or of another type."""
    events = table(spark, sf_dir, "events").select(
        "event_id", F.col("event_id").alias("stream_id"),
        F.array(F.struct(F.col("event_id").alias("timestamp_ns"), F.lit(False).alias("is_stderr"),
                         F.col("props").cast("binary").alias("payload"))).alias("events"),
    )
    way = F.col("event_id") % 5
    data = F.col("payload")
    return encode_batches(events).withColumn(
        "payload",
        F.when(way == 1, F.substring(data, F.lit(1), F.octet_length(data) - 1))
        .when(way == 2, F.substring(data, F.lit(1), F.lit(7)))
        .when(way == 3, F.concat(data, F.unhex(F.lit("FF00")))).otherwise(data),
    ).withColumn("type", F.when(way == 4, 9).otherwise(F.col("type"))).drop("stream_id")


def damaged_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damaged frames split and decoded: events, and the reasons where there are none."""
    _, batches, bad = split_frames(_damaged(spark, sf_dir))
    good = decode_events(batches).select("event_id", "stream_id", text(), "error")
    return good.unionByName(bad.select("event_id", "error"), allowMissingColumns=True)


def damaged_registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as register frames, every third cut inside its last name."""
    named = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_custkey").alias("stream_id"), F.col("c_mktsegment").alias("namespace"),
        F.col("c_name").alias("pod_name"), F.col("c_custkey").cast("string").alias("pod_uid"),
        F.col("c_mktsegment").alias("container_name"),
    )
    data = F.col("payload")
    cut = F.when(F.col("c_custkey") % 3 == 0, F.substring(data, F.lit(1), F.octet_length(data) - 1)).otherwise(data)
    return decode_registers(encode_registry(named).drop("stream_id").withColumn("payload", cut))


def pipeline_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collector to receiver: files' lines to frames, frames to verdicts with the pod's identity."""
    frames = _frames(spark, sf_dir).withColumn("clock_ms", F.col("seq"))
    verdicts, _ = judge_batches(frames, rate=30, burst=100, span=SPAN)
    return verdicts.select("seq", "stream_id", "event_count", "admitted", *NAMES)


def pipeline_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _frames(spark, sf_dir).withColumn("clock_ms", F.col("seq"))
    events, _ = receive(frames, rate=30, burst=100, span=SPAN)
    return render(events).select("line")


def pipeline_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the receiver refuses: the documents' frames over the limit, and every event as a frame of its own, by its id
    cut short, shorter than its header, or of another type."""
    frames = _document_frames(spark, sf_dir).select(
        F.concat(F.lit("documents/"), "source").alias("conn"), F.col("batch_id").alias("seq"), "type", "payload")
    damaged = _damaged(spark, sf_dir).select(F.lit("events").alias("conn"), F.col("event_id").alias("seq"), "type", "payload")
    _, quarantine = judge_batches(frames.unionByName(damaged).withColumn("clock_ms", F.col("seq")), span=SPAN)
    return quarantine.withColumn("type", F.col("type").cast("bigint"))


# --- sources and sinks -----------------------------------------------------------------------------------------------


def _log_tree(spark: SparkSession, sf_dir: str, name: str, lines: DataFrame | None = None) -> str:
    home = scratch(spark, name).removeprefix("file:")
    write_log_files(by_path(event_lines(spark, sf_dir) if lines is None else lines), home, "event_id")
    return home


def scanned_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as log files and read back: events with the pod's identity from the real paths."""
    events = collect_events(read_logs(spark, _log_tree(spark, sf_dir, "scan")))
    return events.select("timestamp_ns", "stream", "is_partial", text(), pod_metadata(F.col("path")).alias("pod")).select(
        "timestamp_ns", "stream", "is_partial", "payload", "pod.namespace", "pod.pod_name", "pod.pod_uid",
        "pod.container_name",
    )


def file_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte offsets of all complete lines: per pod the lines and the bytes, the end of each file's last line."""
    # Landed, as the offsets read the lines twice and a directory of many small files is slow to read.
    lines = _landed(read_logs(spark, _log_tree(spark, sf_dir, "offsets")), "lines")
    lines = complete_lines(with_offsets(lines))
    ends = F.col("offset") + F.octet_length("line") + 1
    files = lines.groupBy("path").agg(F.count("*").alias("lines"), F.max(ends).cast("bigint").alias("bytes"))
    pod = pod_metadata(F.col("path"))["pod_name"].alias("pod_name")
    return files.groupBy(pod).agg(F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"))


def fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two directories read as one stream of lines."""
    half = event_lines(spark, sf_dir)
    first = _log_tree(spark, sf_dir, "one", half.where(F.col("path").contains("/ns0_")))
    second = _log_tree(spark, sf_dir, "two", half.where(~F.col("path").contains("/ns0_")))
    events = parse_lines(read_logs(spark, first, second))
    return events.groupBy(pod_metadata(F.col("path"))["namespace"].alias("namespace")).agg(F.count("*").alias("events"))


def _stream_to(spark: SparkSession, stream: DataFrame, home: str) -> None:
    def handle(rows: DataFrame, delta: int) -> None:
        rows.select("path", "line").write.mode("overwrite").parquet(f"{home}/out/delta={delta}")

    start(stream, handle, f"{home}/state").awaitTermination()


def tail_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first part lies there when the stream starts and is skipped; what is appended afterwards is read, over a restart."""
    home, lines = scratch(spark, "tail").removeprefix("file:"), event_lines(spark, sf_dir)
    logs = f"{home}/logs"
    by_pod = by_path(lines)
    write_log_files(by_pod.where("arrival_ms % 6 = 0"), logs, "event_id")
    _stream_to(spark, stream_logs(spark, logs), home)
    write_log_files(by_pod.where("arrival_ms % 6 = 2"), logs, "event_id", append=True)
    _stream_to(spark, stream_logs(spark, logs), home)
    write_log_files(by_pod.where("arrival_ms % 6 = 4"), logs, "event_id", append=True)
    _stream_to(spark, stream_logs(spark, logs), home)
    events = parse_lines(spark.read.parquet(f"{home}/out"))
    return events.select("delta", "timestamp_ns", "stream", text()).drop("delta")


def rotated_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files overwritten by others between two triggers are read from their start, both times."""
    home, lines = scratch(spark, "rotated").removeprefix("file:"), event_lines(spark, sf_dir)
    logs = f"{home}/logs"
    by_pod = by_path(lines)
    write_log_files(by_pod, logs, "event_id")
    _stream_to(spark, stream_logs(spark, logs, "earliest"), home)
    write_log_files(by_pod.where("arrival_ms % 8 = 0"), logs, "event_id")
    _stream_to(spark, stream_logs(spark, logs, "earliest"), home)
    events = parse_lines(spark.read.parquet(f"{home}/out"))
    return events.groupBy("timestamp_ns", "stream").agg(F.count("*").alias("times_read"))


def renamed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that go on growing, are renamed, replaced by new ones, and at last removed: every line is read once, under the
    name its file had first."""
    home, lines = scratch(spark, "renamed").removeprefix("file:"), event_lines(spark, sf_dir)
    logs = f"{home}/logs"
    by_pod = by_path(lines)
    write_log_files(by_pod.where("arrival_ms % 6 = 0"), logs, "event_id")
    _stream_to(spark, stream_logs(spark, logs, "earliest"), home)
    write_log_files(by_pod.where("arrival_ms % 6 = 2"), logs, "event_id", append=True)
    rename_log_files(logs, ".1")
    write_log_files(by_pod.where("arrival_ms % 6 = 4"), logs, "event_id")
    _stream_to(spark, stream_logs(spark, logs, "earliest"), home)
    rename_log_files(logs, None)
    _stream_to(spark, stream_logs(spark, logs, "earliest"), home)
    events = parse_lines(spark.read.parquet(f"{home}/out"))
    return events.select(F.regexp_replace("path", "/[0-9]+[.]log$", "").alias("folder"), "timestamp_ns", "stream", text()).withColumn(
        "folder", F.regexp_replace("folder", "^.*/logs", ""))


#: What a trigger takes of closed segments: as many files as there are, but so many bytes.
SEGMENT_BYTES = 64 << 20


def segment_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed files through Spark's own file stream."""
    home = scratch(spark, "segments").removeprefix("file:")
    write_log_files(by_path(event_lines(spark, sf_dir)), f"{home}/logs", "event_id")
    with listing(spark):
        _stream_to(spark, stream_segments(spark, f"{home}/logs", max_bytes_per_trigger=SEGMENT_BYTES), home)
    events = parse_lines(spark.read.parquet(f"{home}/out"))
    return events.select("timestamp_ns", "stream", text())


def capture_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames written as capture files, read back and decoded."""
    home = scratch(spark, "capture")
    write_capture(_frames(spark, sf_dir), home, 500)
    _, batches, _ = split_frames(read_capture(spark, home))
    events = decode_events(batches.drop("error"))
    return events.select("conn", "seq", "idx", "stream_id", "timestamp_ns", "is_stderr", text(), "error")


def capture_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from one part, of which every task reads some frames."""
    home = scratch(spark, "split")
    write_capture(_frames(spark, sf_dir), home, 1 << 40)
    _, batches, _ = split_frames(read_capture(spark, home, split_bytes=1 << 16))
    events = decode_events(batches.drop("error"))
    return events.select("conn", "seq", "idx", "stream_id", "timestamp_ns", "is_stderr", text(), "error")


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = scratch(spark, "text")
    events = _events(spark, sf_dir)
    write_text(join_registry(events, build_registry(events, "event_id")), home)
    return spark.read.option("lineSep", "\n").text(home).withColumnRenamed("value", "line")


def text_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text sink behind a stream."""
    home = scratch(spark, "textstream")
    events = _events(spark, sf_dir)
    joined = join_registry(events, build_registry(events, "event_id")).select(*RENDERED)
    joined.write.parquet(f"{home}/in")
    stream = spark.readStream.schema(joined.schema).parquet(f"{home}/in")
    stream_text(stream, f"{home}/out", f"{home}/state").awaitTermination()
    return spark.read.option("lineSep", "\n").text(f"{home}/out").withColumnRenamed("value", "line")


QUERIES = {
    "volume_by_namespace": volume_by_namespace,
    "parsed_lines": parsed_lines,
    "malformed_lines": malformed,
    "line_formats": line_formats,
    "known_tags": known_tags,
    "own_format": own_format,
    "json_fields_of_pages": json_fields_of_pages,
    "parsed_documents": parsed_documents,
    "trimmed_documents": trimmed_documents,
    "ns_from_rfc3339": ns_from_rfc3339,
    "ns_from_civil": ns_from_civil,
    "ns_from_months": ns_from_months,
    "pod_metadata": pod_names,
    "pods_of_pages": pods_of_pages,
    "stream_registry": stream_registry,
    "growing_registry": growing_registry,
    "events_enriched": events_enriched,
    "event_batches": event_batches,
    "event_batches_per_read": event_batches_per_read,
    "document_batches": document_batches,
    "document_batch_of_each": document_batch_of_each,
    "document_batch_contents": document_batch_contents,
    "admitted_events": admitted_events,
    "admitted_after_registration": admitted_after_registration,
    "admitted_hot_stream": admitted_hot_stream,
    "admitted_overload": admitted_overload,
    "admitted_default_burst": admitted_default_burst,
    "admitted_batches": admitted_batches,
    "admitted_stream": admitted_stream,
    "batch_registration_asof": batch_registration_asof,
    "registration_asof_ties": registration_asof_ties,
    "rendered_lines": rendered_lines,
    "times_of_day": times_of_day,
    "big_endian_numbers": big_endian_numbers,
    "frame_payloads": frame_payloads,
    "batches_sent": batches_sent,
    "frame_roundtrip": frame_roundtrip,
    "register_roundtrip": register_roundtrip,
    "oversized_frames": oversized_frames,
    "damaged_frames": damaged_frames,
    "damaged_registers": damaged_registers,
    "pipeline_verdicts": pipeline_verdicts,
    "pipeline_events": pipeline_events,
    "pipeline_quarantine": pipeline_quarantine,
    "scanned_directory": scanned_directory,
    "file_offsets": file_offsets,
    "fan_in": fan_in,
    "tail_stream": tail_stream,
    "rotated_stream": rotated_stream,
    "renamed_stream": renamed_stream,
    "segment_stream": segment_stream,
    "capture_roundtrip": capture_roundtrip,
    "capture_split": capture_split,
    "text_files": text_files,
    "text_stream": text_stream,
}
