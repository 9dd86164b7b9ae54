"""Quality classifier and language identification: held-out accuracy, exact selection, odd rows."""

import collections
import itertools
import math
import re
import unicodedata
import zlib

import numpy as np
import pytest
from llm_cases import TEXTS, edge_documents
from pyspark.sql import Window
from pyspark.sql import functions as F

from podweave.llm import importance, language_mix

SF = "/root/testdata/sf0.01"


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_labels_are_told_apart(spark):
    documents, labels = tables(spark)
    learn = labels.where(F.crc32(F.col("doc_id").cast("string")) % 2 == 0)
    judged = importance.classify(documents, learn).join(labels.where(F.crc32(F.col("doc_id").cast("string")) % 2 == 1), "doc_id").collect()
    good = [x.kept for x in judged if x.quality == 1 and not x.toxic]
    bad = [x.kept for x in judged if x.quality == 0]
    assert len(good) > 100 and np.mean(good) >= 0.99 and np.mean(bad) <= 0.05


def test_gumbel_top_k_is_exact(spark):
    documents, labels = tables(spark)
    found, scores = importance.resampling(documents, labels)
    rows = scores.collect()
    keys = sorted((x.gumbel_key for x in rows if x.score is not None), reverse=True)
    assert found.k == sum(x.score is not None and x.score > found.cut for x in rows)
    assert keys[found.k - 1] == found.least
    again = importance.classify(documents.repartition(5), labels)
    assert again.where("kept").count() == found.k


@pytest.mark.parametrize("bins", [4, 4096])
def test_kth_largest(spark, monkeypatch, bins):
    monkeypatch.setattr(importance, "BINS", bins)
    values = [float(x) for x in np.random.default_rng(3).standard_normal(500) ** 5] + [1.5] * 40 + [-1e300, 1e300]
    table = spark.createDataFrame([(x,) for x in values], "v double")
    for k in (1, 2, 25, 77, 300, len(values)):
        assert importance.kth_largest(table, "v", k) == sorted(values, reverse=True)[k - 1]


def test_buckets_do_not_depend_on_the_neighbours():
    texts = ["", "One two, two!! two two", "  ", "a", "Ünï 12 12 $$$ x"]
    buckets, first = importance.ngram_buckets(texts, 16)
    for k, text in enumerate(texts):
        alone, _ = importance.ngram_buckets([text], 16)
        assert sorted(buckets[first[k]: first[k + 1]]) == sorted(alone)
    assert first.tolist() == [0, 0, 13, 13, 14, 23]


def plain_ngrams(text):
    """Tokens and neighbouring tokens, by a loop over the characters."""
    tokens, last = [], None
    for c in text:
        kind = "gap" if c.isspace() or unicodedata.category(c) in ("Cc",) else "word" if unicodedata.category(c)[0] in "LN" else "mark"
        if kind != "gap" and kind == last:
            tokens[-1] += c
        elif kind != "gap":
            tokens.append(c)
        last = kind
    return tokens, [(a, b) for a, b in itertools.pairwise(tokens)]


def test_weights_are_those_of_a_plain_count(spark):
    documents, labels = tables(spark)
    rows = {x.doc_id: x.text for x in documents.where("doc_id % 7 = 0 AND n_chars < 4000").select("doc_id", "text").collect()}
    few = documents.where(F.col("doc_id").isin(*rows))
    good = {x.labelled for x in importance.labelled_sample(labels, 10**6).where("good = 1 AND fits").collect()}
    raw, target = collections.Counter(), collections.Counter()
    grams = {}
    for k, text in rows.items():
        tokens, pairs = plain_ngrams(text)
        names = [importance.ngram_buckets([t], 16)[0].tolist()[0] for t in tokens]
        names += [importance.ngram_buckets([f"{a} {b}"], 16)[0].tolist()[2] for a, b in pairs]
        grams[k] = names
        raw.update(names)
        if k in good:
            target.update(names)
    size, n, m = 1 << 16, sum(raw.values()), sum(target.values())
    log = {b: math.log((target[b] + 1) / (m + size)) - math.log((raw[b] + 1) / (n + size)) for b in raw}
    _, scores = importance.resampling(few, labels)
    found = scores.collect()
    assert len(found) == len(rows) > 50 and target
    for x in found:
        want = sum(log[b] for b in grams[x.doc_id])
        assert x.n_ngrams == len(grams[x.doc_id]) and x.log_weight == pytest.approx(want, abs=1e-6)
        assert x.score == pytest.approx(want / (len(grams[x.doc_id]) + importance.PRIOR), abs=1e-8)


def test_inclusion_follows_the_weights(spark):
    """Two of four documents, over many seeds, against drawing one after the other in proportion to the weights."""
    weights, temperature, seeds = [0.0, 0.02, 0.05, 0.1], 0.05, 4000
    chance = np.exp(np.array(weights) / temperature)
    want = chance / chance.sum()
    want = want + sum(want[k] * np.where(np.arange(4) == k, 0, chance / (chance.sum() - chance[k])) for k in range(4))
    drawn = spark.range(seeds).withColumnRenamed("id", "seed").crossJoin(
        spark.createDataFrame([(str(k), w) for k, w in enumerate(weights)], "name string, weight double"))
    keyed = drawn.withColumn("key", importance.gumbel_key(F.col("weight"), F.col("name"), temperature, F.col("seed")))
    place = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("key")))
    got = {r.name: r["count"] for r in keyed.withColumn("place", place).where("place <= 2").groupBy("name").count().collect()}
    assert np.allclose([got[str(k)] / seeds for k in range(4)], want, atol=0.03)


def test_chance_counts_near_the_cut(spark):
    documents, labels = tables(spark)
    kept = []
    for seed in (1, 2):
        found, scores = importance.resampling(documents, labels, seed=seed, fraction=0.5)
        total = scores.where("score IS NOT NULL").count()
        kept.append({x.doc_id for x in scores.where(importance._kept(found)).collect()})
        assert found.k == round(total / 2) == len(kept[-1])
    assert 0 < len(kept[0] - kept[1]) < len(kept[0])
    assert importance.resampling(documents, labels, k=10)[0].k == 10


def test_cut():
    assert importance.best_cut([1, 2, 3, 10, 11], [0, 0, 0, 1, 1]) == 6.5
    assert importance.best_cut([], []) == -np.inf and importance.best_cut([1.0], [1]) == -np.inf


def test_classifier_on_edge_rows(spark):
    documents = edge_documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, None), (12, 0, 0), (None, 1, 0), (9, None, 0), (11, 1, 0), (11, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    got = importance.classify(documents, labels).collect()
    assert len(got) == len(TEXTS)
    assert {(x.doc_id, x.kept) for x in got if x.doc_id in (2, 3, 4)} == {(2, False), (3, False), (4, False)}
    kept = importance.classified(documents, labels)
    assert kept.columns == documents.columns
    assert sorted((x.doc_id for x in kept.collect()), key=str) == sorted((x.doc_id for x in got if x.kept), key=str)
    none = labels.limit(0)
    assert all(x.kept for x in importance.classify(documents, none).collect() if x.n_ngrams)
    assert importance.classify(edge_documents(spark, []), labels).count() == 0
    assert importance.classified(edge_documents(spark, []), none).count() == 0


def test_held_out_languages(spark):
    documents, _ = tables(spark)
    got = language_mix.language_ids(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == documents.count()
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) and 0 <= x.score <= 1 for x in got)
    held = [x.lang == x.lang_pred for x in got if x.held_out]
    assert len(held) > 200 and np.mean(held) >= 0.98


def test_mixtures(spark):
    documents, _ = tables(spark)
    names, model = language_mix.learned(documents)
    text = {x.lang: x.text for x in documents.where("n_chars BETWEEN 1500 AND 3000").groupBy("lang").agg(F.min("text").alias("text")).collect()}
    mixed = [text["en"][:1000] + "\n" + text["fr"][:500], text["de"][:1200], "12 !!", "", text["es"][:400] + " " + text["de"][:800]]
    known, shares = language_mix.infer(mixed, model)
    assert known.tolist() == [0, 1, 4]
    told = [{names[k]: s for k, s in enumerate(row) if s > 0.05} for row in shares]
    assert set(told[0]) == {"en", "fr"} and 0.5 < told[0]["en"] < 0.8 and set(told[1]) == {"de"} and set(told[2]) == {"es", "de"}
    assert np.allclose(shares.sum(axis=1), 1)


def test_languages_of_edge_rows(spark):
    got = language_mix.language_ids(edge_documents(spark)).collect()
    assert len(got) == len(TEXTS)
    told = {x.doc_id: x for x in got}
    assert all(told[k].lang_pred == "und" and told[k].score == 0 and told[k].languages == [] for k in (2, 3, 4))
    assert not told[None].held_out and told[7].lang_pred in ("en", "fr")
    assert language_mix.language_ids(edge_documents(spark, [])).count() == 0
    nothing = edge_documents(spark, [(1, "some words", None, "a")])
    assert language_mix.language_ids(nothing).first().lang_pred == "und"


def plain_mixture(text, names, model, penalty=1.0):
    """Expectation-maximisation word by word, and the set of languages by penalised likelihood."""
    words = []
    for m in re.finditer(r"[^\W\d_]+", text):
        buckets, _, _ = language_mix.trigrams([m[0]])
        words.append((len(buckets), [sum(model[k][b] for b in buckets.tolist()) for k in range(len(names))]))

    def fitted(allowed, steps):
        shares = [1 / len(allowed) if k in allowed else 0.0 for k in range(len(names))]
        for _ in range(steps):
            sums = [0.0] * len(names)
            for size, logs in words:
                joint = [s * math.exp(x - max(logs)) for s, x in zip(shares, logs)]
                for k in range(len(names)):
                    sums[k] += size * joint[k] / max(sum(joint), 1e-300)
            shares = [x / sum(size for size, _ in words) for x in sums]
        value = sum(math.log(max(sum(s * math.exp(x - max(logs)) for s, x in zip(shares, logs)), 1e-300)) for _, logs in words)
        return shares, value

    shares, _ = fitted(set(range(len(names))), language_mix.STEPS)
    order = sorted(range(len(names)), key=lambda k: -shares[k])
    best, chosen = -math.inf, shares
    for m in range(1, len(names) + 1):
        found, value = fitted(set(order[:m]), language_mix.STEPS if m > 1 else 1)
        value -= penalty * (m - 1) / 2 * math.log(len(words) + 1)
        if value <= best:
            break
        best, chosen = value, found
    return chosen


def test_inference_is_that_of_a_plain_version(spark, monkeypatch):
    documents, _ = tables(spark)
    names, model = language_mix.learned(documents)
    texts = [x.text for x in documents.where("n_chars BETWEEN 200 AND 900").orderBy("doc_id").limit(12).collect()]
    texts += [a[:300] + " " + b[:200] for a, b in itertools.pairwise(texts)]
    texts = [re.sub(r"[^a-zA-ZÀ-ÿ]+", " ", t) for t in texts]
    for cells in (language_mix.CELLS, 64):  # also some letters at a time
        monkeypatch.setattr(language_mix, "CELLS", cells)
        known, shares = language_mix.infer(texts, model)
        for k, got in zip(known.tolist(), shares):
            assert np.allclose(got, plain_mixture(texts[k], names, model), atol=1e-6)


def test_no_language_is_left_out(spark, monkeypatch):
    rows = [(k, f"{chr(97 + k % 26)}{chr(97 + k // 26)}word " * 3, f"l{k:03d}", "a") for k in range(300)]
    names, model = language_mix.learned(edge_documents(spark, rows))
    assert names == [f"l{k:03d}" for k in range(300)] and model.shape == (300, 1 << 15)
    monkeypatch.setattr(language_mix, "MOST_LANGUAGES", 299)
    with pytest.raises(ValueError, match="more than 299"):
        language_mix.learned(edge_documents(spark, rows))
