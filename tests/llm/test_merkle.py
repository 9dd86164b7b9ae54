"""The manifest against a tree built in plain Python."""

import hashlib
import random
import zlib

import pytest
from llm_cases import edge_documents

from podweave.llm import merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i: i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, i):
    for level in tree[:-1]:
        first = i - i % 3
        yield "".join(level[first:i]), "".join(level[i + 1: first + 3])
        i //= 3


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = levels([leaf(r) for r in by[s]])
    top = levels([trees[s][-1][0] for s in names])
    for j, s in enumerate(names):
        for i, r in enumerate(by[s]):
            steps = [*siblings(trees[s], i), *siblings(top, j)]
            text = r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf((*r[:4], text))
            for a, b in steps:
                folded = digest(a, folded, b)
            yield r[0], trees[s][0][i], trees[s][-1][0], top[-1][0], digest(*(a + b for a, b in steps)), folded, folded == top[-1][0]


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("sizes", [[1], [2, 1], [3, 4, 9, 10, 27, 28], [243, 244, 81, 82], [1000, 730, 729, 1], [1] * 250])
def test_trees_of_all_shapes(spark, sizes):
    rnd, rows = random.Random(sum(sizes)), []
    for k, n in enumerate(sizes):
        rows += [(len(rows) + i, None if k == 1 else f"s{k}é", "en", i, f"line {i}\n{i}" if i % 3 else None) for i in range(n)]
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert ordered(merkle.manifest_report(docs).collect()) == ordered(plain(rows))


def test_edge_rows(spark):
    docs = edge_documents(spark)
    got = merkle.manifest_report(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert ordered(got.collect()) == ordered(plain([tuple(r) for r in docs.select(*COLUMNS).collect()]))
    empty = merkle.manifest_report(edge_documents(spark, []))
    assert empty.count() == 0 and empty.dtypes == got.dtypes


def test_equal_rows_have_places_of_their_own(spark):
    rows = [(None, None, None, None, None)] * 40 + [(7, "a", "en", 1, "x\ny")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert ordered(merkle.manifest_report(docs).collect()) == ordered(plain(rows))


def test_every_change_shows(spark):
    docs = edge_documents(spark)
    told = merkle.proofs(merkle.manifest(docs, fields=COLUMNS))
    assert {r.verified for r in told.collect()} == {True}
    from pyspark.sql import functions as F
    for column, value in {"lang": F.lit("xx"), "n_chars": F.coalesce("n_chars", F.lit(0)) + 1, "text": F.concat(F.coalesce("text", F.lit("")), F.lit("."))}.items():
        told = merkle.proofs(merkle.manifest(docs, changed={column: value}))
        assert {r.verified for r in told.collect()} == {False}


def test_reruns_and_other_partitions_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert ordered(merkle.manifest_report(docs).collect()) == ordered(merkle.manifest_report(docs.repartition(7)).collect())
