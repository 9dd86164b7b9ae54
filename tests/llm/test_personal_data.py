"""Personal data against plain regular expressions, on edge rows and on texts made of troublesome parts."""

import re
import time

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from llm_cases import EXTRA, edge_documents
from pyspark.sql import functions as F

from podweave.llm import personal_data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def plain(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                    "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def found(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [[tuple(s) for s in r.found] for r in personal_data.find(docs, **options).orderBy("doc_id").collect()]


PARTS = st.lists(st.sampled_from([
    "a@b.c", "_d@e.f", "@", ".", "..", "-", " ", "+", "+1 (017) 555-7713", "192.168.0.1", "256.1.1.1", "0001.2.3.4", "1.2.3.4.5.6.7.8",
    "4111 1111-1111 1111", "4111111111111112", "é", "😀", "\n", "(", ")", "7", "12", "x%y+z", "é@é.com", "٣", "a.b@c-d.e.f", "99999999999999999999.1.1.1"]), max_size=14)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(PARTS.map("".join), min_size=40, max_size=40))
def test_base_spans_are_those_of_plain_expressions(spark, texts):
    for text, spans in zip(texts, found(spark, texts, further=[]), strict=True):
        assert [s[:3] for s in spans] == plain(text), text


def test_checksums_boundaries_and_context(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00 and GB29NWBK60161331926819.", "DE88 3704 0044 0532 0130 00", "xGB29NWBK60161331926819",
             "my ssn: 123-45-6789", "part 123-45-6789", "ssn 000-45-6789, ssn 123-00-6789, ssn 123-45-0000, ssn 901-45-6789", "SSN 5123-45-6789",
             "tel (415) 555-2671", "(415) 555-2671", "call +1 (415) 555-2671", "tel" + " " * 60 + "415-555-2671", "hotel 415-555-2671"]
    kinds = [[(s[0], s[3]) for s in spans] for spans in found(spark, texts)]
    assert kinds == [[("iban", 1.0), ("iban", 0.8)], [], [], [("ssn", 0.7)], [], [], [], [("tel", 0.6)], [], [("phone", 0.9)], [], []]
    assert [len(x) for x in found(spark, texts, least=0.2)] == [2, 0, 0, 1, 1, 0, 0, 1, 1, 1, 1, 1]


def test_scores_of_base_spans_never_remove_them(spark):
    (spans,) = found(spark, ["write to a@b.cd or 1.2.3.4, card 4111111111111111"], least=1.0)
    assert [(s[0], s[3]) for s in spans] == [("email", 1.0), ("ip", 0.6), ("card", 1.0)]


def test_long_texts_take_linear_time(spark):
    texts = ["x" * 400_000, "0 " * 200_000, "1." * 200_000, "+" * 400_000, "a@b" + ".c" * 200_000, "A1" * 200_000, "a@b.c " * 50_000, "+1" + "(" * 400_000]
    begun = time.time()
    assert [len(x) for x in found(spark, texts)] == [0, 0, 50_000, 0, 1, 0, 50_000, 0]
    assert time.time() - begun < 60


def test_running_sums_over_several_groups(spark):
    sizes = [0, 1, 255, 256, 257, 1000]
    rows = spark.createDataFrame([(n, list(range(n))) for n in sizes], "n int, v array<bigint>")
    for r in rows.select("n", personal_data.running(F.col("v"), F.lit(0), lambda a, b: a + b).alias("s")).collect():
        assert r.s == [sum(range(k)) for k in range(r.n)]


def test_edge_rows_and_masks(spark):
    docs = edge_documents(spark)
    report = personal_data.report(personal_data.find(docs))
    assert report.count() == docs.count() and report.where("doc_id IS NULL").count() == 2
    assert personal_data.masked(docs).columns == docs.columns
    before = sorted(map(str, docs.collect()))
    assert sorted(map(str, personal_data.masked(docs).collect())) == before  # nothing to mask, nothing changed
    assert personal_data.report(personal_data.find(edge_documents(spark, []))).count() == 0
    texts = ["a@b.cd é😀 1.2.3.4!", None, "", "tel 415-555-2671, call +1 415 555 2671", "4111 1111 1111 1111" * 2, "x +4111111111111111"]
    rows = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, found string")
    got = [(r.text, r.found) for r in personal_data.masked(rows).orderBy("doc_id").collect()]
    assert [g[0] for g in got] == ["<EMAIL> é😀 <IP>!", None, "", "tel <TEL>, call <PHONE>", texts[4], "x +<CARD>"]
    assert all(g[1] == "c" for g in got) and "found" not in EXTRA
