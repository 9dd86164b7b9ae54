"""SQL of the registered queries for DuckDB, over whole tables. What SQL cannot express has none and is tested."""

ORACLE: dict[str, str] = {}

ORACLE["op2_quality_rules"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
w AS (
  SELECT doc_id, i, words[i] || chr(31) || words[i + 1] || chr(31) || words[i + 2] AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
spots AS (
  SELECT DISTINCT doc_id, i + step AS at
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM w), (VALUES (0), (1), (2)) AS steps(step)
  WHERE n > 1),
repeats AS (SELECT doc_id, count(*) AS n FROM spots GROUP BY doc_id),
lines AS (
  SELECT doc_id, source, i, line, lower(regexp_replace(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      '[\x20\x09-\x0D]+', ' ', 'g')) AS plain, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE n > 0 GROUP BY doc_id),
frequent AS (
  SELECT source, plain FROM lines WHERE n > 0 GROUP BY source, plain HAVING count(DISTINCT doc_id) > 20),
removed AS (
  SELECT doc_id, sum(n) AS n FROM lines JOIN frequent ON lines.plain = frequent.plain
    AND lines.source IS NOT DISTINCT FROM frequent.source
  GROUP BY doc_id),
counts AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
    coalesce(removed.n, 0)::BIGINT AS n_removed_words
  FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN removed USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_removed_words <= 50 * n_words AS kept
FROM counts
"""

ORACLE["op3_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
k AS (
  SELECT doc_id, source, size,
    -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '~' || coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / (1.0 + 3.0 * (1.0 - least(1.0, (coalesce(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')), 0))::DOUBLE
        / greatest(size, 1)))) AS sample
  FROM d),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM totals),
shares AS (SELECT *, [5.0, 2.0, 1.0][(place - 1) % 3 + 1]::DOUBLE AS share, 3 * source_size AS cap FROM placed),
levels AS (
  SELECT *, cap / share AS ratio,
    (sum(source_size) OVER () - (sum(cap) OVER (ORDER BY cap / share, place) - cap))
      / sum(share) OVER (ORDER BY cap / share, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM shares),
plan AS (
  SELECT source, source_size, CASE WHEN ratio <= level THEN cap::DOUBLE ELSE share *
    (SELECT level FROM levels WHERE ratio > level ORDER BY ratio, place LIMIT 1) END AS target FROM levels),
epochs AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM plan),
sums AS (
  SELECT k.*, source_size, target, epochs,
    sum(size) OVER (PARTITION BY k.source ORDER BY sample, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2 AS middle
  FROM k JOIN epochs ON k.source IS NOT DISTINCT FROM epochs.source)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN middle <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sums
"""

ORACLE["op6_ngram_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, gram FROM (
    SELECT doc_id, unnest(CASE WHEN len(words) >= 3
      THEN list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))
      WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS gram FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s AS a JOIN s AS b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  JOIN n AS na ON na.doc_id = a.doc_id JOIN n AS nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 90 * (na.n + nb.n - count(*))),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(reach.other) AS component_id
FROM d JOIN reach ON reach.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

ORACLE["op8_embedding_dups"] = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)) >= 0.95),
reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.other),
named AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM named LEFT JOIN counts USING (vec_id)
"""

ORACLE["op10_tool_calls"] = r"""
WITH RECURSIVE calls AS (
  SELECT conv_id, conv_id::VARCHAR || ':' || turn::VARCHAR AS call_id, turn AS position,
    CASE WHEN regexp_matches(text, '[^\x00-\x7F]') THEN 'translate' ELSE 'reply' END AS name,
    CASE WHEN turn >= 2 THEN conv_id::VARCHAR || ':' || (turn - 2)::VARCHAR END AS after, text,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
    CASE WHEN contains(text, chr(10)) THEN split_part(text, chr(10), 1) END AS title
  FROM conversations WHERE role = 'user'),
results AS (
  SELECT CASE WHEN turn >= 1 THEN conv_id::VARCHAR || ':' || (turn - 1)::VARCHAR END AS call_id, count(*) AS n_results,
    min({'position': turn, 'content': text}).content AS content
  FROM conversations WHERE role = 'assistant' GROUP BY 1),
ids AS (SELECT call_id, count(*) AS same, min({'position': position, 'after': after}).after AS after FROM calls GROUP BY call_id),
walk(call_id, depth) AS (
  SELECT call_id, 0::BIGINT FROM ids WHERE after IS NULL OR after NOT IN (SELECT call_id FROM ids)
  UNION ALL
  SELECT ids.call_id, depth + 1 FROM ids JOIN walk ON ids.after = walk.call_id),
linked AS (
  SELECT calls.*, walk.depth, same, coalesce(n_results, 0) AS n_results, content,
    ids.after IS NOT NULL AND ids.after NOT IN (SELECT call_id FROM ids) AS unknown
  FROM calls JOIN ids USING (call_id) LEFT JOIN walk USING (call_id) LEFT JOIN results USING (call_id)),
told AS (
  SELECT *, array_to_string(list_filter([
      CASE WHEN same > 1 THEN 'duplicate id' END, CASE WHEN unknown THEN 'unknown reference' END,
      CASE WHEN depth IS NULL THEN 'circle' END, CASE WHEN n_results = 0 THEN 'no result' END,
      CASE WHEN n_results > 1 THEN 'several results' END, CASE WHEN text IS NULL THEN 'missing text' END,
      CASE WHEN title IS NULL AND name = 'translate' THEN 'missing title' END,
      CASE WHEN words IS NULL AND name = 'reply' THEN 'missing words' END], lambda x: x IS NOT NULL), ', ') AS problems
  FROM linked)
SELECT conv_id, call_id, position, depth, n_results, problems = '' AS valid, problems,
  '{"arguments":{' || array_to_string(list_filter(['"text":' || to_json(text)::VARCHAR, '"title":' || to_json(title)::VARCHAR,
      '"words":' || words::VARCHAR], lambda x: x IS NOT NULL), ',') || '},"id":' || to_json(call_id)::VARCHAR || ',"name":"' || name
    || '","result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS json
FROM told
UNION ALL
SELECT NULL, call_id, NULL, NULL, n_results, false, 'no call', NULL
FROM results WHERE call_id IS NULL OR call_id NOT IN (SELECT call_id FROM ids)
"""

#: The table of CRC-32 as a list in the column `tab`, and the CRC-32 of a text by it.
CRC_TABLE = """
crc_steps(i, k, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) AS t(i)
  UNION ALL
  SELECT i, k + 1, xor(c >> 1, (c & 1) * 3988292384) FROM crc_steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM crc_steps WHERE k = 8)"""
CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 2 * strlen({0}), 2),
  lambda i: ('0x' || substr(hex({0}), i, 2))::BIGINT)), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])))"""

_KINDS = [
    ("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+", "true", 0.9, "mail|email|contact|write"),
    ("ip", "[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)",
     "len(list_filter(string_split(m, '.'), lambda x: ltrim(x, '0') = '' OR coalesce(try_cast(x AS BIGINT), 256) <= 255)) = 4",
     0.6, "ip|host|server|address|login"),
    ("card", "[0-9]([\\x20-]?[0-9])+", """length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1),
      lambda i: CASE WHEN i % 2 = 1 THEN substr(digits, -i, 1)::INT ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][substr(digits, -i, 1)::INT + 1] END)) % 10 = 0""",
     0.7, "card|visa|mastercard|credit|payment"),
    ("phone", "\\+[0-9][\\x20().0-9-]+[0-9]", "length(digits) BETWEEN 9 AND 15", 0.6, "phone|tel|call|mobile|fax"),
    ("iban", "[A-Z]{2}[0-9]{2}([A-Z0-9]{11,30}|(\\x20[A-Z0-9]{4}){2,7}(\\x20[A-Z0-9]{1,3})?)",
     """free AND length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0::BIGINT, list_transform(string_split(
      substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9'
      THEN ascii(c) - 48 ELSE ascii(c) - 55 END::BIGINT)), lambda a, c: (a * CASE WHEN c > 9 THEN 100 ELSE 10 END + c) % 97) = 1""",
     0.8, "iban|account|konto|compte|cuenta|bank"),
    ("ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}",
     "free AND NOT regexp_matches(m, '^(000|666|9)') AND NOT regexp_matches(m, '-00-') AND NOT regexp_matches(m, '0000$')",
     0.4, "ssn|social|security"),
    ("tel", "\\(?[0-9]{3}\\)?[\\x20.-][0-9]{3}-[0-9]{4}", "free AND NOT regexp_matches(before, '\\+[0-9][\\x20().0-9-]*$')",
     0.3, "phone|tel|telephone|call|mobile|fax"),
]


def _personal_data() -> str:
    kinds = ",\n".join(f"""k{i} AS (
  SELECT doc_id, {i} AS place, '{name}' AS kind, pieces[j] AS before, pieces[j + 1] AS after, matches[j] AS m,
    list_sum(list_transform(pieces[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(matches[1:j - 1], lambda x: length(x))), 0) AS start
  FROM (
    SELECT doc_id, pieces, matches, unnest(range(1, len(matches) + 1)) AS j
    FROM (SELECT doc_id, regexp_split_to_array(body, '{pattern}') AS pieces, regexp_extract_all(body, '{pattern}') AS matches FROM d))),
c{i} AS (
  SELECT doc_id, place, kind, start, start + length(m) AS past, {min(1.0, round(score + 0.3, 3))} AS high, {score} AS low,
    regexp_matches(lower(right(before, 50)), '(?:^|[^a-z])(?:{near})(?:[^a-z]|$)')
      OR regexp_matches(lower(left(after, 50)), '(?:^|[^a-z])(?:{near})(?:[^a-z]|$)') AS near
  FROM (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS digits,
    NOT regexp_matches(before, '[A-Za-z0-9]$') AND NOT regexp_matches(after, '^[A-Za-z0-9]') AS free FROM k{i})
  WHERE {check})""" for i, (name, pattern, check, score, near) in enumerate(_KINDS))
    union = " UNION ALL ".join(f"SELECT * FROM c{i}" for i in range(len(_KINDS)))
    counts = ", ".join(f"count(*) FILTER (kind = '{x[0]}') AS n_{x[0]}" for x in _KINDS[:4])
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
{kinds},
s AS (
  SELECT *, kind || ':' || start::BIGINT::VARCHAR || ':' || past::BIGINT::VARCHAR AS span FROM ({union})
  WHERE place < 4 OR CASE WHEN near THEN high ELSE low END >= 0.5),
joined AS (
  SELECT doc_id, {counts}, string_agg(span, ',' ORDER BY place, start) FILTER (place < 4) AS base,
    string_agg(span, ',' ORDER BY place, start) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card,
  coalesce(n_phone, 0)::BIGINT AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN joined USING (doc_id)
"""


ORACLE["op11_personal_data"] = _personal_data()

ORACLE["op12_spelling_variants"] = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM documents) GROUP BY doc_id, run),
drawn AS (
  SELECT run, n, {CRC.format("drawn_of")} AS h FROM (SELECT *, coalesce(doc_id::VARCHAR, '') || ':' || run AS drawn_of FROM runs), crc),
w AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n
    FROM drawn) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
pairs AS (
  SELECT a.word, b.word AS other, b.n FROM cuts AS a JOIN cuts AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM cuts AS a JOIN w AS b ON a.rest = b.word
  UNION
  SELECT b.word, a.word, a.n FROM cuts AS a JOIN w AS b ON a.rest = b.word),
near AS (SELECT word, count(*) AS n_near, min(struct_pack(o := -n, word := other)) AS best FROM pairs GROUP BY word),
forms AS (
  SELECT w.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.o >= 2 * n THEN best.word END AS form,
    CASE WHEN -best.o >= 2 * n THEN -best.o END::BIGINT AS form_n FROM w LEFT JOIN near USING (word)),
ways(word, up) AS (
  SELECT word, word FROM forms
  UNION ALL
  SELECT ways.word, forms.form FROM ways JOIN forms ON ways.up = forms.word WHERE forms.form IS NOT NULL)
SELECT forms.word, forms.form, ways.up AS root, forms.n, forms.n_near, forms.form_n
FROM forms JOIN ways USING (word) JOIN forms AS last ON ways.up = last.word WHERE last.form IS NULL
"""

_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"

ORACLE["op13_merkle_manifest"] = f"""
WITH RECURSIVE {CRC_TABLE},
leaves AS (
  SELECT doc_id, source, leaf, other, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
  FROM (
    SELECT doc_id, source, {_LEAF.format("text")} AS leaf,
      CASE WHEN {CRC.format("doc_id::VARCHAR")} % 2 = 0 THEN {_LEAF.format("replace(text, chr(10), '')")} ELSE {_LEAF.format("text")} END AS other
    FROM documents, crc)),
nodes(source, level, i, n, h) AS (
  SELECT source, 0, i, count(*) OVER (PARTITION BY source), leaf FROM leaves
  UNION ALL
  SELECT source, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY source, level, i // 3, n),
subroots AS (SELECT source, level, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM nodes WHERE n = 1),
tops(level, i, n, h) AS (
  SELECT 0, i, count(*) OVER (), h FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 3, n),
-- all levels as one: those of the sources below those of the whole
rows AS (
  SELECT source, level, i, i // 3 AS run, h, n FROM nodes
  UNION ALL
  SELECT s.source, s.level + 1 + t.level, t.i, t.i // 3, t.h, t.n FROM subroots AS s, tops AS t),
runs AS (SELECT source, level, run, list(h ORDER BY i) AS hs FROM rows WHERE n > 1 GROUP BY source, level, run),
path(doc_id, source, leaf, first, level, i, folded, siblings) AS (
  SELECT doc_id, leaves.source, leaf, leaves.i, 0, leaves.i, other, ''
  FROM leaves
  UNION ALL
  SELECT p.doc_id, p.source, p.leaf, p.first, p.level + 1, CASE WHEN p.level = s.level THEN s.i ELSE p.i // 3 END,
    CASE WHEN p.level = s.level THEN p.folded ELSE sha256(coalesce(array_to_string(list_transform(hs, lambda h, k: CASE WHEN k = p.i % 3 + 1 THEN p.folded ELSE h END), ''), '')) END,
    p.siblings || CASE WHEN p.level = s.level THEN '' ELSE coalesce(array_to_string(list_filter(hs, lambda h, k: k <> p.i % 3 + 1), ''), '') END
  FROM path AS p JOIN subroots AS s ON s.source IS NOT DISTINCT FROM p.source
  LEFT JOIN runs AS r ON r.source IS NOT DISTINCT FROM p.source AND r.level = p.level AND r.run = p.i // 3
  WHERE p.level = s.level OR r.hs IS NOT NULL)
SELECT doc_id, leaf, s.h AS subroot, t.h AS root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = t.h AS verified
FROM path AS p JOIN subroots AS s ON s.source IS NOT DISTINCT FROM p.source, (SELECT h, level FROM tops WHERE n = 1) AS t
WHERE p.level = s.level + 1 + t.level
"""
