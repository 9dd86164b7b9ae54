"""Token counts and byte-level BPE against the vocabularies' own libraries."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import EXTRA, TEXTS, edge_documents
from tokenizers import Tokenizer

from podweave.llm import byte_bpe, token_counts
from podweave.llm.merging import Pairs
from podweave.llm.textarrays import pieces

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PARTS = st.sampled_from(["a", "b", "I", "s", "t", "re", "ve", "ll", "'", "'s", " ", "  ", "\n", "\t", "1", "٣", "é", "ß", "日本", "!", "$$",
                         " ", " ", "😀", "Σ", "İ", "é", "<|endoftext|>", "m", "d", "\x1c", "\x85", "\r\n", "the", " and"])
ODD = st.lists(st.lists(PARTS, max_size=25).map("".join), min_size=1, max_size=8)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def counter():
    with open(WORDS, encoding="utf-8") as file:
        return token_counts._Counter(token_counts.WordVocabulary(file.read()))


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(RANKS)


@pytest.fixture(scope="module")
def encoding(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.numbers, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(texts=ODD)
def test_counts_are_the_librarys(library, counter, texts):
    assert counter(texts) == [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]


def test_whole_tokens_are_single(library, counter):
    whole = [x for x, n in counter.sizes.fixed.items()]
    assert len(whole) > 30_000 and set(counter.sizes.fixed.values()) == {1}
    for word in random.Random(3).sample(whole, 500):
        assert len(library.encode(word, add_special_tokens=False).ids) == 1


@settings(max_examples=200, deadline=None)
@given(texts=ODD)
def test_pre_tokens_are_the_patterns(texts):
    first, last, _ = byte_bpe.pre_tokens(texts)
    joined = "\n".join(texts)
    want = [x for t in texts for x in regex.findall(public_tokenizers.PATTERN, t)]
    assert [joined[a:b] for a, b in zip(first, last, strict=True)] == want


@settings(max_examples=100, deadline=None)
@given(texts=ODD)
def test_ids_are_the_librarys(ranks, encoding, texts):
    packed, sizes, first, starts = byte_bpe._encoded(texts, byte_bpe.Cache(ranks.encoded))
    assert packed.tolist() == [x for t in texts for x in encoding.encode_ordinary(t)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=150), max_size=6), st.permutations(range(9)))
def test_merging_in_batches_is_one_merge_after_the_other(words, order):
    pairs = [(k // 3, k % 3, order[k], 3 + k) for k in range(9)]  # every pair merges, into a symbol that no longer does
    found, left = Pairs(pairs).merge(np.array([x for w in words for x in w], np.int64), np.array([len(w) for w in words], np.int64))
    rank = {(a, b): (r, m) for a, b, r, m in pairs}
    at = 0
    for word, n in zip(words, left.tolist(), strict=True):
        while len(word) > 1:
            (r, _), k = min(((rank.get(x, (99, 0))), k) for k, x in enumerate(zip(word, word[1:], strict=False)))
            if r == 99:
                break
            word = [*word[:k], rank[word[k], word[k + 1]][1], *word[k + 2:]]
        assert found[at: at + n].tolist() == word
        at += n


def test_count_tokens_of_edge_rows(spark, library):
    rows = token_counts.count_tokens(edge_documents(spark), WORDS).collect()
    want = [(d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t, _, _ in TEXTS]
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)


def test_round_trip_of_edge_rows(spark, encoding):
    rows = byte_bpe.round_trip(edge_documents(spark), RANKS)
    assert set(rows.columns) == {"doc_id", "lang", "source", "n_chars", *EXTRA}
    got = sorted(map(tuple, rows.select("doc_id", "decoded", *byte_bpe.digests()).collect()), key=str)
    want = []
    for d, t, _, _ in TEXTS:
        ids, raw = encoding.encode_ordinary(t or ""), (t or "").encode()
        want.append((d, bytearray(raw), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest()))
    assert got == sorted(want, key=str)


def test_encode_keeps_offsets_and_decode_inverts(spark):
    encoded = byte_bpe.encode(edge_documents(spark), RANKS)
    for row in byte_bpe.decode(encoded, RANKS).collect():
        text = row.text or ""
        assert bytes(row.decoded).decode() == text
        starts = np.frombuffer(row.offsets, "<u4").tolist()
        assert starts == [x.start() for x in regex.finditer(public_tokenizers.PATTERN, text)]
        assert row.label == "label" and row.key == "key"


def test_empty_tables(spark):
    none = edge_documents(spark, [])
    assert token_counts.count_tokens(none, WORDS).count() == 0
    assert byte_bpe.round_trip(none, RANKS).count() == 0
    assert byte_bpe.decode(byte_bpe.encode(none, RANKS), RANKS).count() == 0


def test_pieces_hold_whole_texts():
    texts = ["a" * 10, None, "b" * 5, "c" * 100, ""]
    found = list(pieces(texts, 12))
    assert [x for _, part in found for x in part] == ["a" * 10, "", "b" * 5, "c" * 100, ""]
    assert [k for k, _ in found] == [0, 2, 3, 4] or all(texts[k] is None or texts[k] == part[0] for k, part in found)
