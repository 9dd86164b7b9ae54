"""Quality rules, mixing and tool calls: plain Python versions on small tables."""

import json
from collections import Counter, defaultdict

import pytest
from llm_cases import EXTRA, TEXTS, edge_documents, prose, words
from pyspark.sql import functions as F

from podweave.llm import mixing, quality_rules, tool_calls


def plain_counts(text):
    text = text or ""
    own = words(text)
    grams = Counter(tuple(own[k: k + 3]) for k in range(len(own) - 2))
    covered = {k + j for k in range(len(own) - 2) if grams[tuple(own[k: k + 3])] > 1 for j in range(3)}
    full = [x for x in text.split("\n") if words(x)]
    return len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text), len(full) - len(set(full)), len(covered)


def plain_judge(rows, limit):
    hosts = defaultdict(int)
    plain = [[" ".join(words(x)).lower() for x in (t or "").split("\n")] for _, t, _, _ in rows]
    for (_, _, _, host), lines in zip(rows, plain, strict=True):
        for line in {x for x in lines if x}:
            hosts[host, line] += 1
    out = []
    for (key, text, _, host), lines in zip(rows, plain, strict=True):
        counts = plain_counts(text)
        gone = [k for k, x in enumerate(lines) if x and hosts[host, x] > limit]
        lost = sum(len(lines[k].split(" ")) for k in gone)
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        out.append((key, *counts, lost, gone, failed, not failed and 100 * lost <= 50 * counts[0]))
    return out


@pytest.fixture(scope="module")
def hosts():
    shared = "This Line   is everywhere, 20 times"
    rows = [(k, f"{shared}\n{prose(50 + k, 80)}\n{'menu entry ' * (k % 4 * 10)}", "en", f"h{k % 2}") for k in range(20)]
    footer = "\n".join(f"{prose(900 + j, 14)} {j}" for j in range(8))
    return [*rows, *((100 + k, f"{prose(300 + k, 60)}\n{footer}", "en", "h0") for k in range(8)), *TEXTS]


def test_quality_rules(spark, hosts):
    got = quality_rules.judge(edge_documents(spark, hosts), max_documents=5).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_judge(hosts, 5), key=str)
    assert any(x.n_removed_words for x in got) and any(not x.kept and not x.base_failed for x in got)


def test_lines_are_cut_out(spark, hosts):
    rows = hosts[:20]
    documents = edge_documents(spark, rows)
    judged = quality_rules.judge(documents, max_documents=5)
    got = {x.doc_id: x for x in quality_rules.without_lines(documents, judged).collect()}
    want = {x[0]: x for x in plain_judge(rows, 5) if x[-1]}
    assert got.keys() == want.keys() and want
    for key, row in got.items():
        lines = rows[key][1].split("\n")
        assert row.text == "\n".join(x for k, x in enumerate(lines) if k not in want[key][7]) and row.gone == "gone"


def plain_targets(sizes):
    names = sorted((x for x in sizes if x is not None), key=lambda x: x.encode()) + [None] * (None in sizes)
    share = {x: (5, 2, 1)[k % 3] for k, x in enumerate(names)}
    target, capped, left = {}, set(), float(sum(sizes.values()))
    while True:
        rest = [x for x in names if x not in capped]
        target |= {x: left * share[x] / sum(share[y] for y in rest) for x in rest}
        over = [x for x in rest if target[x] > 3 * sizes[x]]
        if not over:
            return target
        for x in over:
            target[x] = 3.0 * sizes[x]
            capped.add(x)
            left -= target[x]


def test_targets_and_shares(spark):
    rows = [(k, prose(k, 20 + k % 50), "en", ["a", "b", "Z", "é", None][min(4, k % 7)] if k else "tiny") for k in range(300)]
    got = mixing.mix(edge_documents(spark, rows)).collect()
    sizes = defaultdict(int)
    source = {k: s for k, _, _, s in rows}
    for x in got:
        assert x["size"] == len(words(rows[x.doc_id][1])) and x.taken == x["size"] * x.copies and x.copies <= 3
        sizes[source[x.doc_id]] += x["size"]
    want, taken = plain_targets(sizes), defaultdict(int)
    for x in got:
        assert x.target == pytest.approx(want[source[x.doc_id]]) and x.source_size == sizes[source[x.doc_id]]
        taken[source[x.doc_id]] += x.taken
    for name, target in want.items():
        assert abs(taken[name] - target) <= 70 / 2 + 1
    again = mixing.mix(edge_documents(spark, rows).repartition(7)).collect()
    assert sorted(got) == sorted(again)


def test_slices_find_the_same_prefix_as_sorting(spark, monkeypatch):
    rows = [(k, prose(k, 5 + k % 30), "en", "ab"[k % 5 == 0]) for k in range(400)]
    documents = edge_documents(spark, rows)
    whole = sorted(mixing.mix(documents).collect())
    monkeypatch.setattr(mixing, "SLICE", 7)
    assert sorted(mixing.mix(documents).collect()) == whole


def test_heavier_documents_are_taken_more_often(spark):
    rows = [(k, prose(k, 20), "en", "abc"[k % 3]) for k in range(1500)]
    got = mixing.mix(edge_documents(spark, rows), weight=F.when(F.col("doc_id") % 2 == 0, 6.0).otherwise(1.0)).collect()
    share = lambda odd: sum(x.copies for x in got if x.doc_id % 3 == 2 and x.doc_id % 2 == odd)
    assert share(0) > 2 * share(1)


def test_mixed_documents_are_the_mix(spark):
    documents = edge_documents(spark)
    mixed = mixing.mixed_documents(documents)
    assert mixed.columns == documents.columns
    got = Counter((x.doc_id, len(words(x.text))) for x in mixed.collect())
    want = Counter()
    for x in mixing.mix(documents).collect():
        want[x.doc_id, x["size"]] += x.copies
    assert got == +want
    assert {x.row for x in mixed.collect()} == {"row"}


def test_empty_tables(spark):
    none = edge_documents(spark, [])
    assert quality_rules.judge(none).count() == mixing.mix(none).count() == mixing.mixed_documents(none).count() == 0


CALLS = "conv_id long, call_id string, position long, name string, arguments string, after string, depth string, known string"
RESULTS = "call_id string, position long, content string, n_results string"
SCHEMAS = "name string, parameter string, type string, required boolean, tool string"


def test_tool_calls(spark):
    good = '{"n": 2, "q": "x"}'
    calls = [
        (1, "a", 1, "find", good, None), (1, "b", 2, "find", '{"q":"é\\n","n":1.0,"z":[{"d":1,"c":null}]}', "a"),
        (1, "c", 3, "find", '{"q": 5}', "b"), (1, "d", 4, "find", "oops", "nowhere"), (1, "e", 5, "lost", good, "f"),
        (1, "f", 6, "find", "[1]", "e"), (1, "g", 7, "find", None, "e"), (1, None, 8, "find", good, None), (2, "h", 1, None, good, "c"),
        (2, "h", 2, "find", good, None),
    ]
    results = [("a", 5, "late"), ("a", 2, "first"), ("b", 3, None), ("zz", 1, "alone"), (None, 1, "nobody")]
    schemas = [("find", "q", "string", True), ("find", "n", "integer", None), ("find", "z", "array", False)]
    got = tool_calls.link_calls(spark.createDataFrame([(*x, "x", "x") for x in calls], CALLS),
                                spark.createDataFrame([(*x, "x") for x in results], RESULTS),
                                spark.createDataFrame([(*x, "x") for x in schemas], SCHEMAS)).collect()
    told = defaultdict(list)
    for x in got:
        told[x.call_id].append(x)
    depth = {k: x[0].depth for k, x in told.items() if k and k != "zz"}
    assert depth == {"a": 0, "b": 1, "c": 2, "d": 0, "e": None, "f": None, "g": None, "h": 3}
    assert told["a"][0].problems == ["several results"] and told["a"][0].json == '{"arguments":{"n":2,"q":"x"},"id":"a","name":"find","result":"first"}'
    assert told["b"][0].problems in ([], ["wrong type n"]) and json.loads(told["b"][0].json)["arguments"]["z"] == [{"c": None, "d": 1}]
    assert told["c"][0].problems == ["no result", "wrong type q"]
    assert told["d"][0].problems == ["unknown reference", "no result", "no JSON"] and json.loads(told["d"][0].json)["arguments"] is None
    assert told["e"][0].problems == ["circle", "no result", "unknown tool"]
    assert told["f"][0].problems == ["circle", "no result", "no object"] and told["g"][0].problems == ["circle", "no result", "no JSON"]
    assert [x.problems[0] for x in told["h"]] == ["duplicate id"] * 2 and {x.depth for x in told["h"]} == {3}
    assert told["zz"][0].problems == ["no call"]
    assert sorted((x.position, x.problems) for x in told[None] if x.position) == [(8, ["no result"])]
    assert sum(x.problems == ["no call"] for x in got) == 2


def test_long_chains_and_transcript(spark):
    calls = [(k % 3, str(k), k, "t", "{}", str(k - 3) if k >= 3 else None, "", "") for k in range(200)]
    linked = tool_calls.link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), spark.createDataFrame([], SCHEMAS))
    assert {int(x.call_id): x.depth for x in linked.collect()} == {k: k // 3 for k in range(200)}
    lines = [json.loads(x.json)["id"] for x in tool_calls.transcript(linked).collect()]
    assert lines == [str(k) for r in range(3) for k in range(r, 200, 3)]


def test_conversation_calls_of_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", None), (None, 0, "user", "x"), (2, None, "user", ""), (3, 0, "assistant", "y"), (3, 1, None, "z")]
    table = spark.createDataFrame([(*x, "e") for x in rows], "conv_id long, turn long, role string, text string, call_id string")
    got = tool_calls.link_calls(*tool_calls.conversation_calls(table)).collect()
    assert sum(x.json is not None for x in got) == 3
    none = table.limit(0)
    assert tool_calls.link_calls(*tool_calls.conversation_calls(none)).count() == 0
    assert len(EXTRA) and got


def test_sources_with_null_keys_come_near_their_targets(spark):
    rows = [(None if k % 3 == 0 else k, prose(5000 + k, 5 + k % 30), "en", "ab"[k % 2]) for k in range(900)]
    got = mixing.mix(edge_documents(spark, rows)).groupBy("target").agg(F.sum("taken").alias("taken")).collect()
    assert len(got) == 2 and all(abs(x.taken - x.target) <= 40 for x in got)
