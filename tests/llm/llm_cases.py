"""Rows that every operator must survive, and plain versions of the shared definitions."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

SYLLABLES = ["ba", "ko", "ri", "tes", "um", "la", "den", "vo", "shi", "pra", "ne", "gul"]


def prose(seed: int, words: int, per_line: int = 40) -> str:
    rnd = random.Random(seed)
    out = ["".join(rnd.choice(SYLLABLES) for _ in range(rnd.randrange(1, 4))) for _ in range(words)]
    return "\n".join(" ".join(out[k: k + per_line]) for k in range(0, words, per_line))


#: The operators' own names, so that a column of the input clashes with each of them.
EXTRA = ["key", "text_hash", "id", "row", "family", "document", "own", "gone", "good", "score", "kept", "copies", "size",
         "_size", "_key", "ids", "offsets", "decoded", "n_ngrams", "log_weight", "lang_pred", "label", "name", "slice"]

TEXTS = [
    (1, prose(1, 120), "en", "a"), (1, prose(1, 120), "en", "a"),  # a repeated row
    (2, None, None, None), (3, "", "en", "a"), (4, " \n\t\r ", "fr", None), (None, prose(2, 90), "en", "b"),
    (None, None, "fr", "b"), (5, prose(3, 9000), "en", "a"), (6, "x" * 70000, "fr", "c"), (7, "Éa ßü 日本 ٣4 '''ll !!$$   x", "fr", "c"),
    (8, prose(1, 120).upper(), None, "a"), (9, "word", "en", "b"), (10, "two words", "en", "b"), (11, prose(1, 120) + " end", "en", "c"),
    (12, "again " * 200, "fr", "a"), (13, "tie", "en", "d"), (14, "tie", "en", "d"), (5, prose(4, 60), "en", "a"),
]


def edge_documents(spark, rows=None):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
    rows = TEXTS if rows is None else rows
    return spark.createDataFrame([(d, t, g, s, None if t is None else len(t), *EXTRA) for d, t, g, s in rows], schema)


def words(text):
    return WORD.findall(text or "")


def shingles(text, width):
    own = words((text or "").translate(FOLD))
    if not own:
        return frozenset()
    return frozenset(tuple(own[k: k + width]) for k in range(max(1, len(own) - width + 1)))


def classes(items, linked):
    """The smallest item reachable from each, by trying all pairs."""
    root = {x: x for x in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in items:
        for b in items:
            if a < b and find(a) != find(b) and linked(a, b):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {x: find(x) for x in items}
