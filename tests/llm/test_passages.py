"""Repeated passages inside lines and across line ends, against all windows."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from llm_cases import edge_documents, prose, words
from pyspark.sql import functions as F

from podweave.llm import paragraph_dedup, passages
from podweave.llm.landing import landed
from podweave.llm.sieve import short
from podweave.llm.textarrays import word_hashes


def planted():
    """A passage of 60 words inside lines, one across a line end, one of 50 words and one of 49."""
    mid, over, least, short = prose(901, 60, 60), prose(902, 70, 70).split(" "), prose(903, 50, 50), prose(904, 49, 49)
    rows = []
    for k in range(3):
        a, b, c = (prose(1000 + 10 * k + j, 40 + 7 * k, 200) for j in range(3))
        turn = " ".join(over[:20 + 9 * k]) + "\n" + " ".join(over[20 + 9 * k:])
        rows.append((100 + k, f"{a} {mid} {b}\n{c} {turn} {a[:40]}\n{b[:50]} {least} {c[:30]} {short} x{k}", "en", "a"))
    return rows


def removed(rows, length=50):
    """Key to the places of the words that an earlier window has, by all windows in the order of keys and places."""
    first, lost = {}, {}
    for key, text in sorted({(k, t) for k, t, _, _ in rows}):
        own = [x.lower() for x in words(text)]
        for k in range(len(own) - length + 1):
            at = first.setdefault(tuple(own[k: k + length]), (key, k))
            if at != (key, k) and (at[0] != key or k - at[1] >= length):
                lost.setdefault(key, set()).update(range(k, k + length))
    return lost


def test_every_run_keeps_a_hash():
    rnd = random.Random(5)
    for _ in range(200):
        run = [rnd.choice("abcdefgh") * rnd.randrange(1, 4) for _ in range(50)]
        kept = []
        for _ in range(2):
            before, after = ([rnd.choice("klmn") for _ in range(rnd.randrange(30))] for _ in range(2))
            hashes, first, _ = word_hashes([" ".join(before + run + after)])
            spots, prints = passages.winnowed(hashes, first, 50)
            inside = (spots >= len(before)) & (spots <= len(before) + 25)
            kept.append(set(zip((spots[inside] - len(before)).tolist(), prints[inside].tolist(), strict=True)))
        assert kept[0] & kept[1]


def test_cut():
    text = "a b c\n\nd e f\ng h"
    assert passages.cut(text, [], [(1, 2)]) == "a c\n\nd e f\ng h"
    assert passages.cut(text, [], [(2, 4), (7, 8)]) == "a b\n\ne f\ng"
    assert passages.cut(text, [3], [(3, 6)]) == "a b c\n"
    assert passages.cut(text, None, []) == text and passages.cut(None, None, []) is None


def test_passages_inside_lines_and_across_line_ends(spark):
    rows = [*planted(), (200, prose(905, 80, 12), "en", "b"), (201, prose(905, 80, 12), "en", "b"), (202, "again " * 200, "en", "b")]
    lost = removed(rows)
    assert all(len(lost[k]) == 180 for k in (101, 102)) and len(lost[201]) == 80
    documents = edge_documents(spark, rows)
    report = {x.doc_id: x for x in paragraph_dedup.document_report(paragraph_dedup.paragraphs(documents)).collect()}
    found = {k: {w for s in x.passages for w in range(s.begin, s.begin + s.words)} for k, x in report.items()}
    assert {k: x for k, x in found.items() if x} == lost
    assert {k: x.words_removed for k, x in report.items() if k != 202} == {k: len(lost.get(k, ())) for k in report if k != 202}
    assert report[101].same_as == [100] and report[201].removed_lines == list(range(7))
    left = {x.doc_id: x.text for x in paragraph_dedup.without_repeats(documents).collect()}
    for key, text, _, _ in rows[:4]:
        own = words(text)
        assert words(left[key]) == [x for k, x in enumerate(own) if k not in lost.get(key, ())]
    assert left[100] == rows[0][1] and 201 not in left
    assert np.array_equal(words(left[202]), ["again"] * 50)


def test_short_lines_are_joined(spark):
    own = prose(906, 90, 200).split(" ")
    sizes = [19, 24, 14, 11, 12, 10]

    def wrapped(changes):
        text = [f"new{k}" if k in changes else x for k, x in enumerate(own)]
        return "\n".join(" ".join(text[sum(sizes[:k]): sum(sizes[:k + 1])]) for k in range(len(sizes)))

    alone = "\n".join(prose(907, 36, 12).split("\n"))  # 36 words in lines of 12: no passage of 50 words
    rows = [(300, wrapped(()), "en", "a"), (301, wrapped((40,)), "en", "a"),
            (302, f"{prose(908, 60, 60)}\n{alone}\n\n{prose(909, 60, 60)}", "en", "a"), (303, f"{prose(910, 60, 60)}\n{alone}\n{prose(911, 60, 60)}", "en", "a")]
    documents = edge_documents(spark, rows)
    report = {x.doc_id: x for x in paragraph_dedup.document_report(paragraph_dedup.paragraphs(documents)).collect()}
    assert report[300].n_paragraphs > 0 and report[301].n_removed > 0 and report[301].same_as == [300]
    assert report[303].removed_lines == [1, 2, 3] and report[303].words_removed == 36
    left = {x.doc_id: x.text for x in paragraph_dedup.without_repeats(documents).collect()}
    assert left[303] == f"{prose(910, 60, 60)}\n{prose(911, 60, 60)}" and left[302] == rows[2][1]


def test_joined_lines_of_shifted_copies_agree():
    rnd, body = random.Random(8), prose(912, 2000, 12)
    found = []
    for _ in range(2):
        text = prose(rnd.randrange(10**6), rnd.randrange(10, 200), 9) + "\n" + body
        lines = paragraph_dedup._lines([text])
        _, first, last, _, hashes, ends = paragraph_dedup._paragraphs(lines, 25)
        assert (np.diff(ends) >= 25).all() and (first[1:] == last[:-1] + 1).all() and ends[-1] == len(words(text))
        found.append({hashes[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)})
    assert len(found[0] & found[1]) >= len(found[0]) - 25 and len(found[0] & found[1]) > 20


def test_spans_hold_the_places_of_one_row_at_a_time(monkeypatch):
    monkeypatch.setattr(passages, "in_arrow", lambda rows, function, schema: function)
    stub = SimpleNamespace(schema={"key": SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "bigint"))})
    places, count = np.arange(10_000, dtype=np.int32), 60
    held = pa.ListArray.from_arrays(np.arange(count + 1, dtype=np.int32) * len(places), pa.array(np.tile(places, count)))
    keys = pa.array(range(count), pa.int64())
    batch = pa.RecordBatch.from_pydict({
        "key": keys, "text_hash": keys, "doc": keys, "n": pa.array([10_049] * count, pa.int64()), "at": held, "lines": held, "starts": held,
        "others": pa.array([[1]] * count, pa.list_(pa.int64()))})
    tracemalloc.start()
    try:
        rows = [x for b in passages._spans(stub, 50)(iter([batch])) for x in b.select(["key", "begin", "words"]).to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == [{"key": k, "begin": 0, "words": 10_049} for k in range(count)]
    assert peak < 20 << 20


def test_hashes_that_many_texts_share_are_no_rows_of_a_join(spark):
    # 300 texts share hashes 0 to 4 as their 3rd to 7th; hash 7 is in two texts, alone; all others occur once
    kept = spark.range(300).select(F.col("id").alias("key"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.when(
        k.between(3, 7), F.xxhash64(k)).otherwise(F.xxhash64(F.col("id") * 10 + k + 100)))).alias("nth", "print"))
    kept = kept.union(spark.createDataFrame([(400, 5), (401, 8), (401, 9)], "key long, nth int").withColumn("print", F.xxhash64(
        F.when(F.col("nth") == 9, F.lit(-1)).otherwise(F.lit(-7)))))
    kept = landed(kept.select("key", F.col("key").alias("text_hash"), "nth", (F.col("nth") * 13).alias("spot"), short(F.col("print")).alias("print")))
    twice = landed(kept.groupBy(F.col("print").alias("hash")).count().where("count > 1").select("hash"))
    assert twice.count() == 6
    texts = landed(passages._passed(kept, twice))
    assert passages._lone(texts).count() <= 10
    got = {x.key: sorted(x.spots) for x in passages._wanted(kept, twice, kept).collect()}
    assert got == {k: [39, 52, 65, 78, 91] for k in range(300)} | {400: [65], 401: [104]}


def test_band_keys_are_gone_when_passages_are_looked_for(spark, monkeypatch):
    seen, repeated = [], paragraph_dedup.repeated

    def noted(rows, given, length, stored):
        seen.append(stored.columns)
        return repeated(rows, given, length, stored)

    monkeypatch.setattr(paragraph_dedup, "repeated", noted)
    rows = spark.createDataFrame([(1, "a b " * 40), (2, "a b " * 40)], "doc_id long, text string")
    assert [r.doc_id for r in paragraph_dedup.without_repeats(rows).collect()] == [1]
    assert seen and not any("keys" in columns for columns in seen)
