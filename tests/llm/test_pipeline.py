"""The pipeline's stages against plain versions, and the registered queries against their SQL."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from llm_cases import classes, edge_documents, shingles, words
from oracle_check import compare, database
from test_passages import removed

import __spark_entry__ as registered
import corpus_pipeline
from podweave.llm import byte_bpe, importance, mixing, oracle, paragraph_dedup

SF = "/root/testdata/sf0.001"


def encoding():
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.numbers, special_tokens={})


def test_stages(spark, tmp_path):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    made = [documents]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, made[-1], SF).write.parquet(str(tmp_path / str(k)))
        made.append(spark.read.parquet(str(tmp_path / str(k))))
        if k < 4:
            assert made[-1].dtypes == documents.dtypes
    texts = [{x.doc_id: x.text for x in m.collect()} if k < 5 else None for k, m in enumerate(made)]
    kept = {x.doc_id for x in importance.classify(documents, labels).where("kept").collect()}
    assert texts[1] == {k: texts[0][k] for k in kept} and len(kept) < len(texts[0])
    sets = {k: shingles(t, 5) for k, t in texts[1].items()}
    group = classes(sorted(sets), lambda a, b: bool(sets[a] & sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    assert texts[2] == {k: texts[1][k] for k, x in group.items() if k == x}
    gone = {}
    for x in paragraph_dedup.paragraphs(made[2]).where("removed").collect():  # by paragraph or by passage
        gone.setdefault(x.key, set()).update(range(x.begin, x.begin + x.words))
    passages = removed([(k, t, None, None) for k, t in texts[2].items()])
    assert all(places <= gone[k] for k, places in passages.items()) and gone
    left = {k: [x for i, x in enumerate(words(t)) if i not in gone.get(k, ())] for k, t in texts[2].items()}
    assert {k: words(t) for k, t in texts[3].items()} == {k: t for k, t in left.items() if t or k not in gone}
    assert all(texts[3][k] == texts[2][k] for k in texts[3].keys() - gone.keys())
    assert {x.doc_id: x.n_chars for x in made[3].collect()} == {k: len(t) for k, t in texts[3].items()}
    copies = {x.doc_id: x.copies for x in mixing.mix(made[3]).collect()}
    rows = [x.doc_id for x in made[4].collect()]
    assert sorted(rows) == sorted(k for k, n in copies.items() for _ in range(n)) and texts[4].items() <= texts[3].items()
    coder = encoding()
    final = made[5].collect()
    assert len(final) == len(rows)
    for x in final:
        ids = coder.encode_ordinary(texts[4][x.doc_id])
        assert x.n_tokens == len(ids) and bytes(x.ids) == np.array(ids, "<u4").tobytes()
        assert x.decoded_sha256 == hashlib.sha256(texts[4][x.doc_id].encode()).hexdigest()


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 50 and "n_tokens" in got.columns


@pytest.mark.parametrize("rows", [None, []])
def test_stages_survive_edge_rows(spark, tmp_path, rows):
    docs = edge_documents(spark, rows)
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert k == 4 or docs.columns == columns
    assert (docs.count() > 0) == (rows is None)


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_sql(spark, name):
    assert compare(spark, database(SF), name, SF) is None


def test_every_operator_is_registered():
    names = registered.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in names if x.startswith("op") and x[2].isdigit()}
    assert set(registered.oracle_sql()) <= set(names)
