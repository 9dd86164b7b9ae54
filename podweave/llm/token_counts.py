"""Token counts under a word-end BPE vocabulary, by the whole-token shortcut.

Most pre-tokens of real text are vocabulary entries. Those that provably encode alone as one token are listed once,
offline, with the merges themselves; a matching pre-token then counts one without any merging, and only the rest is
merged. No shuffle, no join: texts go through one Arrow pass.
"""

from __future__ import annotations

import functools
import itertools
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podweave.llm.landing import in_arrow
from podweave.llm.merging import Cache, Pairs
from podweave.llm.textarrays import pieces

#: Fixed value: the vocabulary's own pre-token pattern.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordVocabulary:
    """A `tokenizers` JSON file of a lower-casing BPE with word ends: merges, special tokens and whole tokens."""

    def __init__(self, source: str):
        stored = json.loads(source)
        model = stored["model"]
        kinds = [x["type"] for x in stored["normalizer"]["normalizers"]]
        steps = stored["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or steps[0]["pattern"]["Regex"] != PRE_TOKEN:
            raise ValueError("only vocabularies with NFC, collapsed space, lower case and word ends are supported")
        ids, end = model["vocab"], model["end_of_word_suffix"]
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.pairs = Pairs((ids[a], ids[b], i, ids[a + b]) for i, (a, b) in enumerate(merges))
        self.special = [x["content"] for x in stored["added_tokens"]]
        letters = _byte_letters()
        self.inner = np.array([ids[x] for x in letters])
        self.last = np.array([ids[x + end] for x in letters])
        self.whole = self._whole([x.removesuffix(end) for x in ids if x.endswith(end)])

    def counts(self, pre_tokens: list[str]) -> list[int]:
        """Tokens of each pre-token, by merging."""
        coded = [x.encode() for x in pre_tokens]
        sizes = np.array([len(x) for x in coded], np.int64)
        raw = np.frombuffer(b"".join(coded), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(sizes)[sizes > 0] - 1
        symbols[ends] = self.last[raw[ends]]
        return self.pairs.merge(symbols, sizes)[1].tolist()

    def _whole(self, entries: list[str]) -> list[str]:
        """The pre-tokens whose merges end in a single token: shown for every word-end entry by carrying them out."""
        bytes_of = {letter: byte for byte, letter in enumerate(_byte_letters())}
        texts = []
        for entry in entries:
            try:
                texts.append(bytes(bytes_of[c] for c in entry).decode())
            except (KeyError, UnicodeDecodeError):
                continue  # part of a character: no pre-token is spelled so
        return [x for x, n in zip(texts, self.counts(texts), strict=True) if n == 1]


@functools.cache
def _byte_letters() -> tuple[str, ...]:
    """The printable stand-in of each byte: itself if it is printable Latin-1, else the next code point from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return tuple(chr(b) if b in shown else chr(next(hidden)) for b in range(256))


class _Counter:
    def __init__(self, vocabulary: WordVocabulary):
        self.pre_tokens = regex.compile(PRE_TOKEN).findall
        self.special = regex.compile("|".join(map(regex.escape, vocabulary.special)) or r"(?!)")
        self.sizes = Cache(vocabulary.counts, dict.fromkeys(vocabulary.whole, 1))

    def __call__(self, texts: list[str]) -> list[int]:
        special, found = [], []
        for text in texts:
            parts = self.special.split(text)
            special.append(len(parts) - 1)
            # a capital sigma is lowered like any other letter, wherever it stands
            found.append([x for part in parts for x in
                          self.pre_tokens(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())])
        self.sizes.fill(itertools.chain.from_iterable(found))
        size = self.sizes.__getitem__
        return [n + sum(map(size, x)) for n, x in zip(special, found, strict=True)]


def count_tokens(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes long, n_tokens long): UTF-8 size and token count of every whole text; row for row, nothing dropped.

    `path` names the vocabulary's JSON file; the driver reads it and sends it out (about 1.7 MB, whatever the input).
    A null or empty text has 0 bytes and 0 tokens; a null key and repeated rows stay; other columns are not looked at.
    Special strings in a text count as one token each, as the vocabulary's library has it by default.
    """
    with open(path, encoding="utf-8") as file:
        vocabulary = documents.sparkSession.sparkContext.broadcast(WordVocabulary(file.read()))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _Counter(vocabulary.value)
        for batch in batches:
            tokens = [n for _, texts in pieces(batch.column("text").to_pylist()) for n in count(texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("n_bytes"), pa.array(tokens, pa.int64())],
                ["key", "n_bytes", "n_tokens"])

    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"),
                            F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    kind = rows.schema["key"].dataType.simpleString()
    return in_arrow(rows, counts, f"key {kind}, n_bytes long, n_tokens long").withColumnRenamed("key", key)
