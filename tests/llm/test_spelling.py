"""Spelling variants against all pairs."""

import collections
import itertools
import random
import re
import zlib

from llm_cases import edge_documents

from podweave.llm import spelling

FOLD = str.maketrans(spelling.UPPER, spelling.LOWER)


def plain_counts(rows):
    counted = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            drawn = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counted[run[: drawn % len(run)] + run[drawn % len(run) + 1:] if drawn % 97 == 0 else run] += 1
    return {w: n for w, n in counted.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    """By the full table of edits."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1] == 1


def plain(counts):
    met = {w: [] for w in counts}
    for a, b in itertools.combinations(counts, 2):
        if near(a, b):
            met[a].append(b)
            met[b].append(a)
    form = {}
    for w in counts:
        best = min(met[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        yield w, form[w], root, counts[w], len(met[w]), counts[form[w]] if form[w] else None


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


def variants(spark, counts):
    return spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))


def test_one_edit():
    rnd = random.Random(1)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randrange(0, 6))) for _ in range(200)}
    for a, b in itertools.product(words, words):
        if len(a) <= len(b) <= len(a) + 1:
            assert spelling.one_edit(a, b) == near(a, b), (a, b)


def test_dense_words_of_few_letters(spark):
    rnd = random.Random(2)
    counts = {"".join(rnd.choice("abà") for _ in range(rnd.randrange(5, 9))): rnd.choice([3, 4, 8, 16, 50]) for _ in range(600)}
    got = variants(spark, counts)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert ordered(got.collect()) == ordered(plain(counts))


def test_tiles_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK_WORDS", 8)
    rnd = random.Random(3)
    counts = {"shared" + "".join(rnd.choice("xyz") for _ in range(rnd.randrange(5, 7))): rnd.randrange(3, 90) for _ in range(250)}
    assert ordered(variants(spark, counts).collect()) == ordered(plain(counts))


def test_long_chains_ties_and_long_words(spark):
    chain = {"aaaaaaaaaa"[:k] + "bbbbbbbbbb"[k:]: 3 * 2**k for k in range(11)}
    long = "x" * 30_000
    counts = chain | {long: 3, long + "y": 6, long[:-1] + "z": 6, "y" + long: 12, "tiesa": 3, "tiesb": 6, "tiesc": 6}
    rows = {r.word: r for r in variants(spark, counts).collect()}
    assert rows["bbbbbbbbbb"].root == "aaaaaaaaaa" and rows["tiesa"].form == "tiesb"
    assert rows[long].form == "y" + long and rows[long].n_near == 3 and rows[long + "y"].n_near == 1


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counts = plain_counts([tuple(r) for r in docs.select("doc_id", "text").collect()])
    words = spelling.word_counts(docs, slips=True)
    assert {r.word: r.n for r in words.collect()} == counts
    assert ordered(spelling.variants(words).collect()) == ordered(plain(counts))


def test_edge_rows(spark):
    docs = edge_documents(spark)
    counts = plain_counts([tuple(r) for r in docs.select("doc_id", "text").collect()])
    words = spelling.word_counts(docs, slips=True)
    assert {r.word: r.n for r in words.collect()} == counts
    assert spelling.variants(words).count() == len(counts)
    assert spelling.variants(spelling.word_counts(edge_documents(spark, []))).count() == 0
    assert spelling.variants(spark.createDataFrame([(None, 5), ("words", 3)], "word string, n long")).count() == 1
