"""The pipeline's n-gram join against all pairs at five words and 80 %."""

from llm_cases import classes, edge_documents, prose, shingles

import corpus_pipeline


def test_near_copies_by_five_words(spark):
    base = prose(950, 200).replace("\n", " ").split(" ")
    texts = {500: base, 501: [f"new{k}" if k in (20, 60, 100, 140) else x for k, x in enumerate(base)],
             502: [f"other{k}" if k % 20 == 3 else x for k, x in enumerate(base)]}
    rows = [(k, " ".join(x), "en", "a") for k, x in texts.items()]
    five, three = ({k: shingles(t, n) for k, t, _, _ in rows} for n in (5, 3))

    def alike(sets, percent):
        return lambda a, b: 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])

    want = classes(sorted(texts), alike(five, 80))
    assert want == {500: 500, 501: 500, 502: 502} != classes(sorted(texts), alike(three, 90))
    got = corpus_pipeline.near_copies(spark, edge_documents(spark, rows), "")
    assert {x.doc_id for x in got.collect()} == {500, 502}
