"""N-gram join, paragraph dedup, embeddings and components against all pairs."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import TEXTS, classes, edge_documents, prose, shingles, words
from pyspark.sql import functions as F

from podweave.llm import embedding_dups, ngram_join, paragraph_dedup, sieve, tiles
from podweave.llm.components import components
from podweave.llm.landing import landed
from podweave.llm.textarrays import mixed


def edited(text, seed, changes):
    rnd = random.Random(seed)
    own = text.split(" ")
    for _ in range(changes):
        own[rnd.randrange(len(own))] = f"new{rnd.randrange(10**6)}"
    return " ".join(own)


def linked(a, b, percent):
    return bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    rnd = random.Random(seed)
    links = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(15 + 15 * seed)]
    nodes = sorted({x for pair in links for x in pair if pair[0] != pair[1]})
    pairs = {tuple(sorted(x)) for x in links}
    got = {x.id: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == classes(nodes, lambda a, b: (a, b) in pairs)


def test_components_of_a_long_chain(spark):
    links = [(k, k + 1) for k in range(300)] + [(1000, 7000)]
    got = {x.id: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 7000: 1000}


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 60), st.integers(0, 10**6), st.sampled_from([80, 90, 95]))
def test_similar_sets_share_a_cell(common, left, right, seed, percent):
    values = mixed(np.arange(common + left + right) + seed * 1000)
    a, b = np.sort(values[: common + left]), np.sort(np.concatenate((values[:common], values[common + left:])))
    if 100 * common >= percent * (common + left + right):
        (keys, loose), (others, also) = ngram_join.cell_keys(a, percent), ngram_join.cell_keys(b, percent)
        assert np.intersect1d(keys, others).size or set(loose) & set(also)


@pytest.mark.parametrize("percent", [80, 90])
@pytest.mark.parametrize("size", [10, 60, 300, 1000, 3000, 20_000])
def test_unrelated_sets_share_no_key(size, percent):
    rng = np.random.default_rng(size + percent)
    sets = [np.unique(rng.integers(0, 2**64, size, dtype=np.uint64)) for _ in range(max(6, min(300, 60_000 // size)))]
    keys, loose = zip(*(ngram_join.cell_keys(x, percent) for x in sets))
    assert len(np.unique(np.concatenate(keys))) == sum(map(len, keys))
    assert sum(map(bool, loose)) <= len(sets) // 20


def test_loose_sets_share_a_rare_entry(spark):
    rng, rows, pairs = np.random.default_rng(9), [], []
    common = rng.integers(0, 2**64, 3, dtype=np.uint64)
    while len(pairs) < 25:  # pairs of sets that are loose in one band, all with the same three entries
        a = np.unique(np.append(common, rng.integers(0, 2**64, int(rng.integers(5, 30)), dtype=np.uint64)))
        b = np.delete(a, 4)
        found = [ngram_join.cell_keys(x, 80)[1] for x in (a, b)]
        if 100 * len(b) >= 80 * len(a) and set(found[0]) & set(found[1]):
            pairs.append((len(rows), len(rows) + 1))
            for x, bands in zip((a, b), found):
                rows.append((len(rows), len(x), *([int(v) for v in k.view(np.int64)] for k in ngram_join._loose(x, bands))))
    sets = spark.createDataFrame(rows, "id long, n long, loose_a array<long>, loose_b array<long>")
    held = {}
    for key, k in ngram_join._loose_keys(sets, 80).collect():
        held.setdefault(k, set()).add(key)
    assert all(held[a] & held[b] for a, b in pairs)


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 60), st.integers(0, 10**6), st.sampled_from([50, 80, 90, 95]))
def test_similar_sets_are_found(common, left, right, seed, percent):
    values = mixed(np.arange(common + left + right) + seed * 1000)
    a, b = np.sort(values[: common + left]), np.sort(np.concatenate((values[:common], values[common + left:])))
    if 100 * common >= percent * (common + left + right):
        parts = [ngram_join.counted_part(x, percent) for x in (a, b)]
        for x, part in zip((a, b), parts):
            assert np.setdiff1d(part, np.intersect1d(*parts)).size <= len(x) * (100 - percent) // 100


@pytest.mark.parametrize("percent", [80, 90])
def test_unrelated_sets_do_not_go_on(spark, percent):
    rng = np.random.default_rng(percent)
    sizes = [300, 1000, 3000, 20_000] * 20 + [10, 30] * 50
    rows = []
    for k, size in enumerate(sizes):
        part = ngram_join.counted_part(np.unique(rng.integers(0, 2**64, size, dtype=np.uint64)), percent)
        rows.append((k, size, [int(v) for v in part.view(np.int64)]))
    table = landed(spark.createDataFrame(rows, "id long, n long, part array<long>"))
    found = {r.id for r in ngram_join._promising(table, percent, table).collect()}
    assert len([k for k in found if sizes[k] >= 300]) <= 2  # a small set may have too few entries in the counted part


def joins(plan):
    """For each join of an optimized plan, but those with a bitmap: (columns, text of the plan below) of both sides."""
    sides = [plan.children().apply(k) for k in range(plan.children().size())]
    here = [({x.split("#")[0] for x in s.output().mkString(",").split(",")}, s.toString()) for s in sides]
    found = [here] if plan.nodeName() == "Join" and not any("_bits" in c for c, _ in here) else []
    return found + [x for s in sides for x in joins(s)]


def test_sets_are_not_shuffled_unless_they_may_have_a_family(spark, monkeypatch):
    seen = []

    def noted(frame, like=None):
        seen.extend(joins(frame._jdf.queryExecution().optimizedPlan()))
        return landed(frame, like)

    monkeypatch.setattr(ngram_join, "landed", noted)
    monkeypatch.setattr(ngram_join, "LARGE", 4)
    assert ngram_join.ngram_join(edge_documents(spark, near_copies())).count() == len(near_copies())
    counts = [a | b for (a, _), (b, _) in seen if "met" in a | b]
    assert counts and not any("part" in c for c in counts)
    shipped = [below for join in seen for c, below in join if "set" in c]
    assert len(shipped) > 1 and all("_bits" in below for below in shipped)


def test_texts_are_shuffled_once_at_most(spark, monkeypatch):
    seen = []

    def noted(frame, like=None):
        seen.extend(joins(frame._jdf.queryExecution().optimizedPlan()))
        return landed(frame, like)

    monkeypatch.setattr(ngram_join, "landed", noted)
    rows = near_copies()
    assert ngram_join.ngram_join(edge_documents(spark, rows)).count() == len(rows)
    assert seen and not any("text" in c for join in seen for c, _ in join)  # the keys are made where the texts are


def test_short_sets_are_whole_again(spark):
    texts = [prose(5, 40), "a b c " * 50, "wide " + "x" * 900, "", None, "abcdefg abcdefg abcdefg 123456789012345"[:24], prose(6, 3)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    held = {r.id: r for r in ngram_join._sets(rows, 3, 90).select("id", "n", "set").collect()}
    stored = ngram_join._short_sets(rows, 3)
    got = stored.collect()
    assert all(len(r.set) <= max(8 * r.n, 12 * r.n) for r in got) and any(bytes(r.set) == texts[0].encode() for r in got)
    whole = ngram_join._whole_sets(stored.withColumn("family", F.lit(0).cast("long")), 3).collect()
    assert {(r.id, r.n, bytes(r.set)) for r in whole} == {(r.id, r.n, bytes(r.set)) for r in held.values()}
    assert not any(r.set for r in ngram_join._sets(rows, 3, 90, held=False).collect())


def test_rarest_entries_with_and_without_a_sieve(spark):
    rng = np.random.default_rng(4)
    rows = [(k, int(e)) for k in range(40) for e in {*rng.integers(0, 300, 20).tolist(), 1000 + k}]
    entries = spark.createDataFrame([(k, 0, sum(x == k for x, _ in rows), e) for k, e in rows], "id long, part int, n long, key long")
    entries = landed(entries.select("id", "part", "n", F.xxhash64("key").alias("key")))
    plain, sifted = ([*map(tuple, ngram_join._rarest(entries, 80, x).collect())] for x in (None, entries))
    assert plain and sorted(plain) == sorted(sifted)


def test_families_of_real_documents_are_small(spark):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rows = landed(ngram_join._sets(documents.select(F.col("doc_id").alias("id"), "text"), 5, 80).where("n > 0").dropDuplicates(["set"]))
    found = tiles.families(rows.select(F.explode("keys").alias("key"), "id"), rows)
    assert found.groupBy("family").count().agg(F.max("count")).first()[0] > 200  # by frequent passages
    divided = ngram_join._divided(found, rows, 80)
    assert 2 <= divided.groupBy("family").count().agg(F.max("count")).first()[0] < 100


def test_within_is_a_join(spark):
    rows = spark.createDataFrame([(k % 7 if k else None, k) for k in range(40)], "id long, n long")
    wanted = landed(spark.createDataFrame([(2, "a"), (5, "b"), (None, "c"), (90, "d"), (2, "e")], "id long, name string"))
    got = sieve.within(rows, wanted, "id")
    assert got.columns == ["id", "n", "name"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(wanted, "id").collect()))


def test_a_passage_in_all_documents_ties_none(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LARGE", 4)
    shared = prose(60, 40, 40)
    rows = [(k, f"{prose(3000 + k, 70)} {shared}", "en", "a") for k in range(60)]
    rows += [(100 + k, edited(rows[7][1], k, 1), "en", "a") for k in range(9)]
    sets = [shingles(t, 5) for _, t, _, _ in rows]
    group = classes(range(len(rows)), lambda a, b: linked(sets[a], sets[b], 80))
    got = ngram_join.ngram_join(edge_documents(spark, rows), width=5, percent=80)
    assert {r.doc_id: r.component_id for r in got.collect()} == {rows[k][0]: rows[x][0] for k, x in group.items()}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=30), min_size=2, max_size=12), st.sampled_from([50, 80, 90]))
def test_tiles_connect_what_all_pairs_connect(sets, percent):
    held = [np.sort(mixed(np.array(sorted(x)))) for x in sets]
    ids = np.arange(len(sets)) * 3
    links = tiles.tile_links(ids, np.zeros(len(sets), int), ids.copy(), held, percent)
    got = classes(ids.tolist(), lambda a, b: (a, b) in links or (b, a) in links)
    assert got == classes(ids.tolist(), lambda a, b: linked(sets[a // 3], sets[b // 3], percent))


def test_tiles_with_labels_and_sides():
    held = [np.arange(100, dtype=np.uint64)] * 5 + [np.arange(500, 600, dtype=np.uint64)]
    ids, labels = np.array([9, 4, 7, 5, 6, 8]), np.array([4, 4, 7, 5, 5, 8])
    sides = np.array([0, 0, 0, 1, 1, 1])
    links = tiles.tile_links(ids, sides, labels, held, 90)
    assert classes([4, 5, 6, 7, 8, 9], lambda a, b: (a, b) in links or (b, a) in links or (a, b) in ((4, 9), (5, 6))) == {
        4: 4, 5: 4, 6: 4, 7: 4, 8: 8, 9: 4}


def near_copies():
    rows = [(k, prose(500 + k, 60 + k), "en", "a") for k in range(12)]
    base = prose(77, 150)
    rows += [(100 + k, edited(base, k, k % 12), "en", "a") for k in range(60)]
    other = prose(78, 25)
    rows += [(200 + k, edited(other, k, k % 3), "en", "b") for k in range(30)]
    rows += [(300 + k, base, "en", "c") for k in range(20)]
    return [*rows, *TEXTS]


@pytest.mark.parametrize("block", [512, 5])
def test_ngram_join(spark, monkeypatch, block):
    monkeypatch.setattr(tiles, "BLOCK_SETS", block)
    rows = near_copies()
    sets = [shingles(t, 3) for _, t, _, _ in rows]
    group = classes(range(len(rows)), lambda a, b: linked(sets[a], sets[b], 90))
    names = {}
    for k, x in group.items():
        keys = [rows[y][0] for y in group if group[y] == x and rows[y][0] is not None]
        names[k] = min(keys) if keys and sets[k] else rows[k][0]
    got = ngram_join.ngram_join(edge_documents(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    want = [(rows[k][0], len(sets[k]), names[k]) for k in range(len(rows))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert len(set(names.values())) < len(rows) - 50


def test_one_of_each(spark):
    rows = near_copies()
    sets = [shingles(t, 3) for _, t, _, _ in rows]
    group = classes(range(len(rows)), lambda a, b: linked(sets[a], sets[b], 90))
    least = {}
    for k, x in group.items():
        if sets[k] and rows[k][0] is not None:
            least[x] = min(least.get(x, rows[k][0]), rows[k][0])
    got = ngram_join.one_of_each(edge_documents(spark, rows))
    assert got.columns == edge_documents(spark, rows).columns
    left = [(x.doc_id, x.text) for x in got.collect()]
    stay = [(rows[k][0], rows[k][1]) for k in group if rows[k][0] is None or not sets[k]]
    assert sorted(left, key=str)[: len(stay)] and all(left.count(x) == stay.count(x) for x in stay)
    rest = [x for x in left if x not in stay]
    assert sorted(d for d, _ in rest) == sorted(least.values())
    of = {(rows[k][0], rows[k][1]): x for k, x in group.items()}
    assert sorted(of[x] for x in rest) == sorted(least)  # one row of each component, its own text


def test_one_of_each_keeps_texts_that_only_share_a_key(spark):
    a, b, c = prose(41, 80), prose(42, 80), prose(43, 80)
    rows = [(5, a, "en", "x"), (5, b, "en", "x"), (9, b, "en", "x"), (5, a, "en", "x"), (9, c, "en", "x"), (None, c, "en", "x")]
    got = ngram_join.one_of_each(edge_documents(spark, rows))
    assert sorted(((x.doc_id, x.text) for x in got.collect()), key=str) == sorted([(5, a), (5, b), (9, c), (None, c)], key=str)


def plain_paragraphs(rows, percent=80, width=5, least=25):
    found = [(d, t, k, shingles(line, width)) for d, t in dict.fromkeys((d, t) for d, t, _, _ in rows) if t
             for k, line in enumerate(t.split("\n")) if len(words(line)) >= least]
    group = classes(range(len(found)), lambda a, b: linked(found[a][3], found[b][3], percent))
    return found, group


def passages():
    shared = prose(900, 60, 60)
    rows = [(k, f"{prose(600 + k, 45, 30)}\n{edited(shared, k, k % 3)}\n{prose(700 + k, 50, 50)}", "en", "a") for k in range(40)]
    rows += [(50, f"{shared}\nshort line\n{shared}", "en", "b"), (51, shared, "en", "b"), (52, "short line", "en", "b")]
    return [*rows, *TEXTS]


@pytest.mark.parametrize("block", [512, 7])
def test_paragraphs(spark, monkeypatch, block):
    monkeypatch.setattr(tiles, "BLOCK_SETS", block)
    rows = passages()
    found, group = plain_paragraphs(rows)
    size = {x: sum(y == x for y in group.values()) for x in group.values()}
    got = paragraph_dedup.paragraphs(edge_documents(spark, rows)).collect()
    clusters = {}
    for x in got:
        if x.line is not None and x.cluster is not None:
            clusters.setdefault(x.cluster, []).append((x.key, x.line, x.removed))
    same = {}
    for k, x in group.items():
        if size[x] > 1:
            same.setdefault(x, set()).add((found[k][0], found[k][2]))
    repeated = {(1, k) for k in range(3)}  # rows with key 1 are one document, twice in the table
    assert {frozenset(p[:2] for p in x) - repeated for x in clusters.values()} - {frozenset()} == {frozenset(x) - repeated for x in same.values()} - {frozenset()}
    for x in clusters.values():
        assert len({p[:2] for p in x if not p[2]}) == 1 and min(p[:2] for p in x) in {p[:2] for p in x if not p[2]}
    report = {x.doc_id: x for x in paragraph_dedup.document_report(paragraph_dedup.paragraphs(edge_documents(spark, rows[:43]))).collect()}
    assert len(report) == 43 and report[0].n_removed == 0 and report[3].same_as == [0] and report[50].removed_lines == [0, 2]
    assert report[52].n_paragraphs == 0


def test_without_repeats(spark):
    documents = edge_documents(spark, passages())
    got = paragraph_dedup.without_repeats(documents)
    assert got.columns == documents.columns
    texts = {}
    for x in got.collect():
        texts.setdefault(x.doc_id, []).append(x.text)
        assert x.gone == "gone"
    assert 51 not in texts and texts[50] == ["short line"] and texts[52] == ["short line"] and texts[0] == [passages()[0][1]]
    assert None in texts[2] and "" in texts[3] and " \n\t\r " in texts[4] and len(texts[1]) == 3


def test_bands_reach_their_recall():
    bands = paragraph_dedup.tuned_bands(80, 4, 0.001)
    rnd = np.random.default_rng(1)
    missed = 0
    for k in range(300):
        values = mixed(rnd.integers(0, 1 << 60, 100))
        a, b = values[:90], values[10:]  # similarity 0.8
        keys = paragraph_dedup.min_hashes(np.concatenate((a, b)), np.array([90, 90]), bands, 4)
        missed += not (keys[:, 0] == keys[:, 1]).any()
    assert missed <= 3


def vectors():
    rnd = np.random.default_rng(5)
    rows = [(k, rnd.standard_normal(16).tolist()) for k in range(200)]
    base = rnd.standard_normal(16)
    rows += [(300 + k, (base + rnd.standard_normal(16) * 0.03 * k / 5).tolist()) for k in range(60)]
    rows += [(400 + k, base.tolist()) for k in range(30)]
    rows += [(500, (2 * base).tolist()), (501, None), (502, []), (503, [0.0] * 16), (504, [1.0] * 15 + [None]), (505, [float("nan")] * 16),
             (506, [float("inf")] + [1.0] * 15), (507, base[:8].tolist()), (507, base[:8].tolist()), (None, base.tolist())]
    return rows


@pytest.mark.parametrize("block", [1024, 9])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dups, "BLOCK", block)
    rows = vectors()
    good = {k: np.array(v) for k, (_, v) in enumerate(rows)
            if v and None not in v and all(map(math.isfinite, v)) and any(v)}

    def near(a, b):
        return a in good and b in good and len(good[a]) == len(good[b]) and (
            good[a] @ good[b] / math.sqrt((good[a] @ good[a]) * (good[b] @ good[b])) >= 0.95 or (good[a] == good[b]).all())

    group = classes(range(len(rows)), near)
    want = []
    for k, (key, _) in enumerate(rows):
        links = sum(near(k, j) for j in range(len(rows)) if j != k)
        keys = [rows[j][0] for j in group if group[j] == group[k] and rows[j][0] is not None]
        name = min(keys) if keys else None
        want.append((key, links, name, key == name))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("print", F.lit(2))
    got = sorted(map(tuple, embedding_dups.near_duplicates(table, missed=1e-9).collect()), key=str)
    assert got == sorted(want, key=str)


def test_recall_right_at_the_cosine():
    bits, tables = embedding_dups.tables_for(50_000, 0.95, 0.001)
    rnd = np.random.default_rng(2)
    a = rnd.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = rnd.standard_normal((4000, 64))
    side -= (side * a).sum(axis=1)[:, None] * a
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * side / np.linalg.norm(side, axis=1)[:, None]
    planes = embedding_dups._planes(7, 64, bits * tables)
    met = (((a @ planes > 0) == (b @ planes > 0)).reshape(4000, tables, bits).all(axis=2)).any(axis=1)
    assert met.mean() > 0.995


def test_sieve(spark, monkeypatch):
    rows = spark.range(2000).select(F.when(F.col("id") % 10 != 3, F.col("id")).alias("key"), F.lit("x").alias("_note"))
    gone = landed(spark.range(0, 4000, 7).select(F.col("id").alias("key")))
    want = sorted((k for k in range(2000) if k % 10 != 3 and k % 7)) + [None] * 200
    for slots in (1 << 28, 1 << 15):  # the second is full enough to let many pass that have no partner
        monkeypatch.setattr(sieve, "MOST_SLOTS", slots)
        got = sieve.without(rows, gone, "key")
        assert got.columns == ["key", "_note"]
        assert sorted((r.key for r in got.collect()), key=lambda k: (k is None, k or 0)) == want
        told = sieve.sifted(rows, F.xxhash64("key"), sieve.sieve(gone.select(F.xxhash64("key").alias("h")), "h"))
        assert told.where("key % 7 = 0 AND NOT _may").count() == 0
        assert slots == 1 << 15 or told.where("key % 7 <> 0 AND _may").count() < 5


def test_empty_tables(spark):
    none = edge_documents(spark, [])
    assert ngram_join.ngram_join(none).count() == ngram_join.one_of_each(none).count() == 0
    assert paragraph_dedup.paragraphs(none).count() == paragraph_dedup.without_repeats(none).count() == 0
    assert embedding_dups.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_repeated_hashes(spark):
    values = np.random.default_rng(3).integers(-(1 << 63), 1 << 63, 20_000)
    values = np.concatenate((values, values[:500], np.full(3000, values[600]), [-1, -1, 0]))
    rows = landed(spark.createDataFrame([(int(x),) for x in values], "h long").repartition(7))
    short = values & ((1 << sieve.SHORT_BITS) - 1)
    found, n = np.unique(short, return_counts=True)
    got = [x.hash for x in sieve.repeated_hashes(rows, "h", rows).collect()]
    assert sorted(got) == found[n > 1].tolist() and len(got) >= 502
    assert not sieve.repeated_hashes(rows.limit(0), "h", rows).collect()


def test_a_hash_takes_four_bytes_of_the_shuffle():
    values = np.random.default_rng(4).integers(0, 1 << sieve.SHORT_BITS, 300_000)
    batches = [pa.RecordBatch.from_arrays([pa.array(x)], ["hash"]) for x in (values, np.full(300_000, 5), values[:0])]
    packs = list(sieve._packs(iter(batches)))
    assert sum(len(x) for b in packs for x in b.column("packed").to_pylist()) <= 4 * len(values) + 8 * len(packs)
    assert sum(b.num_rows for b in packs) <= 1024 * len(packs)


def test_beside(spark):
    rows = spark.createDataFrame([(k % 7 or None, k) for k in range(40)], "key long, at long")
    wanted = landed(spark.createDataFrame([(1, "a"), (3, "b"), (None, "c")], "key long, name string"))
    got = sorted((x.at, x.name) for x in sieve.beside(rows, wanted, "key").select("at", "name").collect())
    assert got == [(k, {1: "a", 3: "b"}.get(k % 7)) for k in range(40)]
