"""The same queries as SQL for the checker's database, written from the rules and not from the Spark code."""

STREAM_NAME = "(CASE WHEN event_type = 'error' THEN 'stderr' ELSE 'stdout' END)"
STAMP = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')"

LINES = rf"""
lines AS (
  SELECT event_id,
    '/var/log/pods/ns' || cast(user_id % 5 AS varchar) || '_pod_' || cast(user_id AS varchar) || '_u'
      || cast(user_id AS varchar) || '/web/0.log' AS path,
    event_id * 2 AS arrival_ms,
    CASE
      WHEN event_id % 10 = 0 THEN '{{"log":"' || event_type || ' ' || replace(props, '"', '\"') || '\n","stream":"'
        || {STREAM_NAME} || '","time":"' || {STAMP} || '789Z"}}'
      WHEN event_id % 10 = 8 THEN {STAMP} || 'Z stdlog F ' || event_type
      WHEN event_id % 10 = 7 THEN {STAMP} || '+05:30 stdout F ' || event_type || ' ' || props
      ELSE {STAMP} || '123Z ' || {STREAM_NAME} || (CASE WHEN event_id % 10 = 9 THEN ' P ' ELSE ' F ' END)
        || event_type || ' ' || props || (CASE WHEN event_id % 10 = 6 THEN chr(13) ELSE '' END)
    END AS line
  FROM events)"""


def json_field(key: str, line: str = "line") -> str:
    pattern = rf'"{key}"[^:]*:[^"]*"([^"\\]*(?:\\.[^"\\]*)*)"'
    return f"CASE WHEN regexp_matches({line}, '{pattern}', 's') THEN regexp_extract({line}, '{pattern}', 1, 's') END"


CRI = r"^([^ ]*) (stdout|stderr) ([FP]).(.*)$"


def cri_field(group: int) -> str:
    return f"CASE WHEN regexp_matches(line, '{CRI}', 's') THEN regexp_extract(line, '{CRI}', {group}, 's') END"


def nanos(text: str) -> str:
    """Valid calendar dates only; the fraction padded to nine digits, a full offset taken off."""
    rest = f"regexp_replace(substr({text}, 20), '^\\.[0-9]*', '')"
    fraction = f"regexp_extract(substr({text}, 20), '^\\.([0-9]*)', 1)"
    shift = (
        f"CASE WHEN regexp_matches({rest}, '^[+-][0-9]{{2}}.[0-9]{{2}}') THEN "
        f"(CASE WHEN {rest} LIKE '-%' THEN -1 ELSE 1 END) * (cast(substr({rest}, 2, 2) AS bigint) * 3600 "
        f"+ cast(substr({rest}, 5, 2) AS bigint) * 60) ELSE 0 END"
    )
    return (
        f"CASE WHEN length({text}) >= 20 THEN "
        f"(epoch_us(strptime(substr({text}, 1, 19), '%Y-%m-%dT%H:%M:%S')) // 1000000 - ({shift})) * 1000000000 "
        f"+ cast(rpad(substr({fraction}, 1, 9), 9, '0') AS bigint) END"
    )


def parsed(lines: str, keep: str) -> str:
    return rf"""
raw AS (
  SELECT *, CASE WHEN line LIKE '{{%' THEN 'json' ELSE 'cri' END AS format,
    CASE WHEN line LIKE '{{%' THEN {json_field("time")} ELSE {cri_field(1)} END AS t,
    CASE WHEN line LIKE '{{%' THEN {json_field("stream")} ELSE {cri_field(2)} END AS stream,
    CASE WHEN line LIKE '{{%' THEN false ELSE {cri_field(3)} = 'P' END AS is_partial,
    CASE WHEN line LIKE '{{%' THEN
      regexp_replace(regexp_replace(rtrim({json_field("log")}, chr(13) || chr(10)), '\\n$', ''), '\\r$', '')
      ELSE rtrim({cri_field(4)}, chr(13) || chr(10)) END AS payload
  FROM {lines}),
parsed AS (
  SELECT {keep}, format, {nanos("t")} AS timestamp_ns, stream, is_partial, payload
  FROM raw WHERE stream IN ('stdout', 'stderr') AND t IS NOT NULL AND payload IS NOT NULL)"""


EVENTS = LINES + "," + parsed("lines", "event_id, path, arrival_ms")


def pod(path: str) -> str:
    part = lambda i: f"nullif(string_split({path}, '/')[{i}], '')"
    rest = f"substr({part(-3)}, strpos({part(-3)}, '_') + 1)"
    has = f"contains(coalesce({part(-3)}, ''), '_')"
    full = f"({has} AND contains({rest}, '_'))"
    uid = f"string_split({rest}, '_')[-1]"
    return (
        f"CASE WHEN {has} THEN string_split({part(-3)}, '_')[1] ELSE 'default' END AS namespace, "
        f"CASE WHEN {full} THEN substr({rest}, 1, length({rest}) - length({uid}) - 1) "
        f"ELSE coalesce({part(-1)}, 'unknown') END AS pod_name, "
        f"CASE WHEN {full} THEN {uid} ELSE 'unknown' END AS pod_uid, "
        f"coalesce({part(-2)}, 'unknown') AS container_name"
    )


REGISTRY = f"""
firsts AS (SELECT path, min(event_id) AS first_seen FROM parsed GROUP BY path),
registry AS (
  SELECT row_number() OVER (ORDER BY first_seen, path) AS stream_id, path, first_seen, {pod("path")} FROM firsts)"""

RENDER = """'[' || stream || '] StreamID: ' || cast(stream_id AS varchar) || ' | Time: '
  || strftime(make_timestamp(timestamp_ns // 1000), '%H:%M:%S.%f') || ' | Msg: ' || payload"""


def batches(source: str, key: str, order: str, size: str) -> str:
    """Greedy cut as a recursion along each stream; key is a column list."""
    same = " AND ".join(f"d.{k.strip()} = f.{k.strip()}" for k in key.split(","))
    d_key = ", ".join(f"d.{k.strip()}" for k in key.split(","))
    full = "(f.cnt >= 64 OR f.bytes >= 57344)"
    return f"""
d AS (SELECT {key}, {order} AS o, {size} AS n, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn
      FROM {source}),
f({key}, rn, o, n, batch_id, cnt, bytes) AS (
  SELECT {key}, rn, o, n, 0::bigint, 1::bigint, n::bigint FROM d WHERE rn = 1
  UNION ALL
  SELECT {d_key}, d.rn, d.o, d.n, CASE WHEN {full} THEN f.batch_id + 1 ELSE f.batch_id END,
    CASE WHEN {full} THEN 1 ELSE f.cnt + 1 END, CASE WHEN {full} THEN d.n ELSE f.bytes + d.n END
  FROM f JOIN d ON {same} AND d.rn = f.rn + 1),
batches AS (
  SELECT {key}, batch_id, min(o) AS first_order, max(o) AS last_order, count(*) AS event_count,
    cast(sum(n) AS bigint) AS payload_bytes
  FROM f GROUP BY {key}, batch_id)"""


EVENT_BATCHES = EVENTS + "," + batches("parsed", "path", "event_id", "strlen(payload)")


def admission(source: str, key: str, order: str, clock: str, cost: str, rate: int, burst: int, reset: str = "false") -> str:
    """Token bucket as a recursion along each key: (tokens, last) and the verdict, null on a reset row."""
    level = f"cast(floor(least({burst}, a.tokens + {rate} * greatest(0, q.clock - a.last) / 1000.0)) AS bigint)"
    return f"""
q AS (SELECT {key} AS k, {order} AS o, {clock} AS clock, {cost} AS cost, {reset} AS is_reset,
        row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM {source}),
a(k, rn, o, tokens, last, admitted) AS (
  SELECT k, rn, o, CASE WHEN NOT is_reset AND cost <= {burst} THEN {burst} - cost ELSE {burst} END::bigint,
    clock::bigint, CASE WHEN is_reset THEN NULL ELSE cost <= {burst} END
  FROM q WHERE rn = 1
  UNION ALL
  SELECT q.k, q.rn, q.o,
    CASE WHEN q.is_reset THEN {burst} WHEN {level} >= q.cost THEN {level} - q.cost ELSE a.tokens END,
    CASE WHEN q.is_reset OR {level} >= q.cost THEN q.clock ELSE a.last END,
    CASE WHEN q.is_reset THEN NULL ELSE {level} >= q.cost END
  FROM a JOIN q ON q.k = a.k AND q.rn = a.rn + 1)"""


def be(n: str, width: int) -> str:
    return f"lpad(to_hex({n}), {2 * width}, '0')"


FRAMES = EVENT_BATCHES + "," + REGISTRY + f""",
frame_events AS (
  SELECT f.path, f.batch_id, row_number() OVER (PARTITION BY f.path, f.batch_id ORDER BY f.o) - 1 AS idx,
    p.timestamp_ns, p.stream = 'stderr' AS is_stderr, p.payload,
    {be("p.timestamp_ns", 8)} || (CASE WHEN p.stream = 'stderr' THEN '01' ELSE '00' END) || {be("strlen(p.payload)", 4)}
      || hex(encode(p.payload)) AS data
  FROM f JOIN parsed p ON p.event_id = f.o),
batch_frames AS (
  SELECT 2 * any_value(b.last_order) + 1 AS seq, 2 AS type, any_value(r.stream_id) AS stream_id,
    {be("any_value(r.stream_id)", 4)} || {be("count(*)", 4)} || string_agg(e.data, '' ORDER BY e.idx) AS data
  FROM batches b JOIN registry r USING (path) JOIN frame_events e ON e.path = b.path AND e.batch_id = b.batch_id
  GROUP BY b.path, b.batch_id),
register_frames AS (
  SELECT 2 * first_seen AS seq, 1 AS type, stream_id, {be("stream_id", 4)}
    || {" || ".join(f"{be(f'strlen({c})', 2)} || hex(encode({c}))"
                    for c in ("namespace", "pod_name", "pod_uid", "container_name"))} AS data
  FROM registry)"""

FRAME_EVENTS = """SELECT 2 * b.last_order + 1 AS seq, e.idx, r.stream_id, e.timestamp_ns, e.is_stderr, e.payload
  FROM frame_events e JOIN batches b ON b.path = e.path AND b.batch_id = e.batch_id JOIN registry r ON r.path = e.path"""

PIPELINE = FRAMES + "," + """
sent AS (
  SELECT r.stream_id, 2 * b.last_order + 1 AS seq, b.event_count, r.namespace, r.pod_name, r.pod_uid, r.container_name,
    b.path, b.batch_id
  FROM batches b JOIN registry r USING (path)),""" + admission(
    "(SELECT stream_id, seq, event_count, false AS reg FROM sent UNION ALL "
    "SELECT stream_id, seq, 0, true FROM register_frames)",
    "stream_id", "seq", "seq", "event_count", 30, 100, "reg",
)

DOCUMENTS = batches("documents", "source", "doc_id", "strlen(replace(text, chr(10), ' '))")

REQUESTS = "(SELECT user_id, event_id, event_type, 2 * event_id AS clock FROM events)"


def with_(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes.strip()}\n{select}"


JSON_TEXT = r"""replace(replace(replace(text, chr(10), ' '), '\', '\\'), '"', '\"')"""
HTML_TEXT = r"""replace(replace(replace(replace(html, '\', '\\'), '"', '\"'), chr(13), '\r'), chr(10), '\n')"""
DOCUMENT_LINES = rf"""
lines AS (
  SELECT doc_id, CASE WHEN doc_id % 2 = 0
    THEN '{{"log":"' || {JSON_TEXT} || '\n","stream":"stdout","time":"2026-06-27T20:13:09.5Z"}}'
    ELSE '2026-06-27T20:13:09-07:00 stderr F ' || replace(text, chr(10), ' ') END AS line
  FROM documents)"""
PAGE_LINES = rf"""
lines AS (
  SELECT page_id, '{{"time":"2026-01-01T00:00:00Z","log":"' || {HTML_TEXT} || '","stream":"stderr"}}' AS line FROM pages)"""

TAIL = """CASE doc_id % 6 WHEN 0 THEN chr(13) || chr(10) WHEN 1 THEN chr(10) || chr(10) || chr(13) WHEN 2 THEN '\\n'
  WHEN 3 THEN '\\r\\n' WHEN 4 THEN '\\n\\n' ELSE '' END"""

ORACLE = {
    "volume_by_namespace": with_(EVENTS, """
SELECT string_split(string_split(path, '/')[5], '_')[1] AS namespace, stream, count(*) AS events,
  cast(sum(strlen(payload)) AS bigint) AS bytes, min(timestamp_ns) AS first_ns, max(timestamp_ns) AS last_ns
FROM parsed GROUP BY ALL"""),
    "parsed_lines": with_(EVENTS, """
SELECT event_id, path, format, timestamp_ns, stream, is_partial, payload FROM parsed"""),
    "malformed_lines": with_(LINES, """
SELECT event_id, path, 'cri' AS format, line FROM lines WHERE line LIKE '%Z stdlog F %'"""),
    "line_formats": with_(LINES, """
SELECT CASE WHEN line LIKE '{%' THEN 'json' ELSE 'cri' END AS format, count(*) AS lines,
  cast(sum(strlen(line)) AS bigint) AS bytes FROM lines GROUP BY ALL"""),
    "json_fields_of_pages": with_(PAGE_LINES, f"""
SELECT page_id, {json_field("log")} AS log, {json_field("stream")} AS stream, {json_field("time")} AS time,
  {json_field("missing")} AS missing FROM lines"""),
    "parsed_documents": with_(DOCUMENT_LINES + "," + parsed("lines", "doc_id"), """
SELECT doc_id, format, timestamp_ns, stream, strlen(payload) AS bytes, md5(payload) AS payload_md5 FROM parsed"""),
    "trimmed_documents": f"""
SELECT doc_id, strlen(t) AS bytes, md5(rtrim(t, chr(13) || chr(10))) AS trimmed,
  md5(regexp_replace(regexp_replace(t, '\\\\n$', ''), '\\\\r$', '')) AS unescaped
FROM (SELECT doc_id, text || {TAIL} AS t FROM documents)""",
    "ns_from_rfc3339": f"""
SELECT event_id, text, {nanos("text")} AS timestamp_ns FROM (
  SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || (CASE event_id % 8 WHEN 0 THEN 'Z' WHEN 1 THEN '.5Z'
    WHEN 2 THEN '.123456789+05:30' WHEN 3 THEN '-07:00' WHEN 4 THEN '.000001' WHEN 5 THEN '+0530' WHEN 6 THEN '.Z'
    ELSE '' END) AS text FROM events)""",
    "ns_from_civil": """
SELECT o_orderkey, (epoch_us(o_orderdate::timestamp) // 1000000 + 40 * 86400 + (o_orderkey % 30) * 3600
    + (o_orderkey % 70) * 60 + o_orderkey % 80) * 1000000000 + o_orderkey % 1000000000 AS timestamp_ns,
  day(last_day(make_date(year(o_orderdate), 2, 1))) = 29 AS leap
FROM orders""",
    "pod_metadata": with_(LINES, f"SELECT event_id, {pod('path')} FROM lines"),
    "pods_of_pages": f"SELECT page_id, {pod('url')} FROM pages",
    "stream_registry": with_(EVENTS + "," + REGISTRY, "SELECT * FROM registry"),
    "events_enriched": with_(EVENTS + "," + REGISTRY, """
SELECT event_id, stream_id, timestamp_ns, stream = 'stderr' AS is_stderr, payload, namespace, pod_name, pod_uid,
  container_name FROM parsed JOIN registry USING (path)"""),
    "event_batches": with_(EVENT_BATCHES, "SELECT * FROM batches"),
    "event_batches_per_read": with_(
        EVENTS + ", reads AS (SELECT *, event_id // 1000 AS delta FROM parsed),"
        + batches("reads", "path, delta", "event_id", "strlen(payload)"), "SELECT * FROM batches"),
    "document_batches": with_(DOCUMENTS, "SELECT * FROM batches"),
    "document_batch_of_each": with_(DOCUMENTS, "SELECT source, o AS doc_id, batch_id FROM f"),
    "document_batch_contents": with_(DOCUMENTS, """
SELECT f.source, batch_id, count(*) AS event_count, string_agg(cast(o AS varchar), ',' ORDER BY o) AS doc_ids,
  md5(string_agg(replace(text, chr(10), ' '), '|' ORDER BY o)) AS payload_md5
FROM f JOIN documents ON doc_id = o GROUP BY f.source, batch_id"""),
    "admitted_events": with_(admission(REQUESTS, "user_id", "event_id", "clock", "1", 3, 5),
                             "SELECT o AS event_id, k AS user_id, admitted FROM a"),
    "admitted_after_registration": with_(
        admission(REQUESTS, "user_id", "event_id", "clock", "1", 2, 4, "event_type = 'signup'"),
        "SELECT o AS event_id, k AS user_id, admitted FROM a WHERE admitted IS NOT NULL"),
    "admitted_hot_stream": with_(
        admission("(SELECT 'all' AS conn, event_id, 2 * event_id AS clock, event_id % 5 + 1 AS cost FROM events)",
                  "conn", "event_id", "clock", "cost", 1200, 300),
        "SELECT o AS event_id, admitted FROM a"),
    "admitted_overload": with_(
        admission("(SELECT 'all' AS conn, event_id, 2 * event_id AS clock FROM events)", "conn", "event_id", "clock", "1", 1, 5),
        "SELECT o AS event_id, admitted FROM a"),
    "admitted_default_burst": with_(
        admission("(SELECT 'all' AS conn, event_id, 2 * event_id AS clock FROM events)", "conn", "event_id", "clock",
                  "event_id % 97 + 1", 1000, 50000),
        "SELECT o AS event_id, admitted FROM a"),
    "admitted_batches": with_(
        EVENT_BATCHES + "," + admission("batches", "path", "last_order", "last_order * 2", "event_count", 30, 100),
        "SELECT path, batch_id, event_count, admitted FROM a JOIN batches ON path = k AND last_order = o"),
    "batch_registration_asof": """
SELECT b.user_id, b.event_id, r.event_id AS registered_at, r.props AS pod_name
FROM (SELECT * FROM events WHERE event_type <> 'signup') b
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') r
  ON b.user_id = r.user_id AND b.event_id >= r.event_id""",
    "rendered_lines": with_(EVENTS + "," + REGISTRY, f"""
SELECT event_id, {RENDER} AS line FROM parsed JOIN registry USING (path)"""),
    "times_of_day": f"""
SELECT event_id, strftime(make_timestamp((n - ((n % 1000) + 1000) % 1000) // 1000), '%H:%M:%S.%f') AS time_of_day,
  {STREAM_NAME} AS stream FROM (SELECT *, (event_id - 500) * 7919000000123 AS n FROM events)""",
    "big_endian_numbers": f"""
SELECT l_orderkey, l_linenumber, upper({be("n", 8)} || {be("l_partkey", 4)} || {be("l_linenumber", 2)}) AS bytes,
  n AS signed, cast(l_partkey AS bigint) AS part, cast(l_linenumber AS bigint) AS line, NULL::bigint AS beyond
FROM (SELECT *, l_orderkey::bigint * 1000003 - l_linenumber::bigint * 4000000000 AS n FROM lineitem)""",
    "frame_payloads": with_(FRAMES, """
SELECT seq::bigint AS seq, type::bigint AS type, strlen(data) // 2 AS bytes, md5(data) AS payload_md5
FROM (SELECT seq, type, data FROM batch_frames UNION ALL SELECT seq, type, data FROM register_frames)"""),
    "frame_roundtrip": with_(FRAMES, f"SELECT *, NULL::varchar AS error FROM ({FRAME_EVENTS})"),
    "register_roundtrip": with_(EVENTS + "," + REGISTRY, """
SELECT 2 * first_seen AS seq, stream_id, namespace, pod_name, pod_uid, container_name, NULL::varchar AS error
FROM registry"""),
    "oversized_frames": with_(DOCUMENTS, """
SELECT source, batch_id, 8 + 13 * event_count + payload_bytes AS bytes,
  CASE WHEN 8 + 13 * event_count + payload_bytes > 65536 THEN 'payload larger than the frame limit' END AS error
FROM batches"""),
    "damaged_frames": """
SELECT event_id, CASE WHEN event_id % 5 NOT IN (2, 4) THEN event_id END AS stream_id,
  CASE WHEN event_id % 5 IN (0, 3) THEN props END AS payload,
  CASE event_id % 5 WHEN 1 THEN 'unexpected end of payload' WHEN 2 THEN 'unexpected end of payload'
    WHEN 4 THEN 'unknown frame type' END AS error
FROM events""",
    "damaged_registers": """
SELECT c_custkey, CASE WHEN ok THEN c_custkey END AS stream_id, CASE WHEN ok THEN c_mktsegment END AS namespace,
  CASE WHEN ok THEN c_name END AS pod_name, CASE WHEN ok THEN cast(c_custkey AS varchar) END AS pod_uid,
  CASE WHEN ok THEN c_mktsegment END AS container_name,
  CASE WHEN NOT ok THEN 'unexpected end of payload' END AS error
FROM (SELECT *, c_custkey % 3 <> 0 AS ok FROM customer)""",
    "pipeline_verdicts": with_(PIPELINE, """
SELECT seq, stream_id, event_count, admitted, namespace, pod_name, pod_uid, container_name
FROM sent JOIN a ON k = stream_id AND o = seq"""),
    "pipeline_events": with_(PIPELINE, f"""
SELECT {RENDER.replace("stream ||", "CASE WHEN is_stderr THEN 'stderr' ELSE 'stdout' END ||")} AS line
FROM sent JOIN a ON k = stream_id AND o = seq
  JOIN frame_events e ON e.path = sent.path AND e.batch_id = sent.batch_id WHERE admitted"""),
    "scanned_directory": with_(EVENTS, f"""
SELECT timestamp_ns, stream, is_partial, payload, {pod("path")} FROM parsed"""),
    "file_offsets": with_(LINES, """
SELECT 'pod_' || regexp_extract(path, '_u([0-9]+)/', 1) AS pod_name, count(*) AS lines,
  cast(sum(strlen(line) + 1) AS bigint) AS bytes FROM lines GROUP BY ALL"""),
    "fan_in": with_(EVENTS, """
SELECT regexp_extract(path, '(ns[0-9]+)_', 1) AS namespace, count(*) AS events FROM parsed GROUP BY ALL"""),
    "tail_stream": with_(EVENTS, """
SELECT timestamp_ns, stream, payload FROM parsed WHERE arrival_ms % 6 <> 0"""),
    "rotated_stream": with_(EVENTS, """
SELECT timestamp_ns, stream, cast(sum(CASE WHEN arrival_ms % 8 = 0 THEN 2 ELSE 1 END) AS bigint) AS times_read
FROM parsed GROUP BY ALL"""),
    "renamed_stream": with_(EVENTS, """
SELECT regexp_replace(path, '/[0-9]+[.]log$', '') AS folder, timestamp_ns, stream, payload FROM parsed"""),
    "segment_stream": with_(EVENTS, "SELECT timestamp_ns, stream, payload FROM parsed"),
    "capture_roundtrip": with_(FRAMES, f"""
SELECT 'node-1' AS conn, seq, idx, stream_id, timestamp_ns, is_stderr, payload, NULL::varchar AS error FROM ({FRAME_EVENTS})"""),
    "capture_split": with_(FRAMES, f"""
SELECT 'node-1' AS conn, seq, idx, stream_id, timestamp_ns, is_stderr, payload, NULL::varchar AS error FROM ({FRAME_EVENTS})"""),
    "known_tags": """
SELECT event_id, CASE WHEN event_id % 5 IN (0, 1, 4) THEN epoch_us(date_trunc('second', ts)) * 1000 END AS timestamp_ns,
  CASE WHEN event_id % 5 IN (0, 1, 4) THEN event_id % 5 = 1 END AS is_partial,
  CASE WHEN event_id % 5 IN (0, 1) THEN event_type WHEN event_id % 5 = 4 THEN ' ' || event_type END AS payload
FROM events""",
    "own_format": """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'cri' ELSE 'pairs' END AS format,
  epoch_us(o_orderdate::timestamp) * 1000 AS timestamp_ns,
  CASE WHEN o_orderkey % 3 = 0 OR o_orderstatus = 'F' THEN 'stderr' ELSE 'stdout' END AS stream,
  CASE WHEN o_orderkey % 3 = 0 THEN 'order ' || o_orderkey ELSE 'price ' || o_custkey END AS payload
FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 7 <> 0""",
    "growing_registry": with_(LINES, f"""
SELECT row_number() OVER (ORDER BY read, first_seen, path) AS stream_id, path, first_seen, {pod("path")}, read
FROM (SELECT path, min(event_id) AS first_seen,
  CASE WHEN contains(path, '/ns0_') OR contains(path, '/ns3_') THEN 1 ELSE 2 END AS read FROM lines GROUP BY path)"""),
    "batches_sent": f"""
SELECT stream_id, 8 + count(*) * 13 + sum(strlen(props))::bigint AS bytes,
  md5({be("any_value(stream_id)", 4)} || {be("count(*)", 4)} || string_agg({be("event_id", 8)} || '01' || {be("strlen(props)", 4)}
    || hex(encode(props)), '' ORDER BY event_id)) AS payload_md5
FROM (SELECT *, event_id // 10 AS stream_id FROM events WHERE event_type = 'error') GROUP BY stream_id""",
    "ns_from_months": """
SELECT o_orderkey, CASE WHEN m <= 13 THEN ns END AS timestamp_ns, CASE WHEN m <= 13 THEN ns END AS civil_ns
FROM (SELECT o_orderkey, o_orderkey % 100 AS m,
  (epoch_us(make_timestamp(year(o_orderdate) + (o_orderkey % 100 = 13)::int,
    CASE o_orderkey % 100 WHEN 0 THEN 1 ELSE least((o_orderkey % 100 - 1) % 12 + 1, 12) END, 5, 6, 7, 8.0))) * 1000 AS ns
  FROM orders)""",
    "registration_asof_ties": """
SELECT b.user_id, b.event_id, r.event_id AS registered_at
FROM events b ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') r
  ON b.user_id = r.user_id AND b.event_id >= r.event_id""",
    "pipeline_quarantine": with_(DOCUMENTS, """
SELECT 'documents/' || source AS conn, batch_id AS seq, 2::bigint AS type, 8 + 13 * event_count + payload_bytes AS bytes,
  'payload larger than the frame limit' AS error
FROM batches WHERE 8 + 13 * event_count + payload_bytes > 65536
UNION ALL
SELECT 'events', event_id, CASE event_id % 5 WHEN 4 THEN 9 ELSE 2 END,
  CASE event_id % 5 WHEN 1 THEN 20 + strlen(props) WHEN 2 THEN 7 ELSE 21 + strlen(props) END,
  CASE event_id % 5 WHEN 4 THEN 'unknown frame type' ELSE 'unexpected end of payload' END
FROM events WHERE event_id % 5 IN (1, 2, 4)"""),
}
ORACLE["admitted_stream"] = ORACLE["admitted_events"]
ORACLE["text_files"] = ORACLE["text_stream"] = with_(
    EVENTS + "," + REGISTRY, f"SELECT {RENDER} AS line FROM parsed JOIN registry USING (path)"
)
