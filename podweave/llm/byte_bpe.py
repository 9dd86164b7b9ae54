"""Byte-level BPE encoding and decoding.

Texts are cut into pre-tokens without a regular expression. Every character becomes a class that already knows what
follows it (the last space of a run, an apostrophe before `ll`); a small automaton over these classes says where a
pre-token begins. Transition functions compose associatively, so a whole batch is scanned at once: blocks of characters
are reduced to one function each, the functions are chained, and each block is replayed from its true first state. The
slices go through cached pair merging; their offsets are kept and come back with the ids.
"""

from __future__ import annotations

import base64
import functools
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from podweave.llm.landing import in_arrow
from podweave.llm.merging import Cache, Pairs
from podweave.llm.textarrays import codepoints, pieces, slice_hashes

LETTER, NUMBER, OTHER, SPACE, GAP, GAPS, SHORT, LONGER, RESET = range(9)
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_GAPS, AFTER_SPACE, ONE_LEFT, TWO_LEFT = range(8)

#: Characters of one block of the scan, and of the texts that are worked on together.
BLOCK, PIECE = 128, 1 << 19

#: Merged pre-tokens that a task keeps by default.
CACHED = 150_000


@functools.cache
def _classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or GAP of every code point; a GAP is white space."""
    table = np.full(0x110000, OTHER, np.uint8)
    for point in range(0x110000):
        category = unicodedata.category(chr(point))[0]
        if category == "L":
            table[point] = LETTER
        elif category == "N":
            table[point] = NUMBER
    # The code points with the property White_Space
    table[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = GAP
    return table


@functools.cache
def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a pre-token begins) by class and state."""
    after = np.zeros((9, 8), np.uint8)
    begins = np.ones((9, 8), bool)
    for kind, state in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS), (SHORT, IN_OTHERS), (LONGER, IN_OTHERS)):
        after[kind] = state
        begins[kind, [state, AFTER_SPACE]] = False
    # an apostrophe before s, t, m, d or re, ve, ll takes those letters along if a pre-token begins with it
    for kind, state in ((SHORT, ONE_LEFT), (LONGER, TWO_LEFT)):
        after[kind, [FRESH, IN_LETTERS, IN_NUMBERS, IN_GAPS, ONE_LEFT, TWO_LEFT]] = state
    after[LETTER, ONE_LEFT], after[LETTER, TWO_LEFT] = FRESH, ONE_LEFT
    begins[LETTER, [ONE_LEFT, TWO_LEFT]] = False
    after[SPACE] = AFTER_SPACE  # the last space before a word belongs to the word
    after[GAP] = FRESH  # other white space just before a word stands alone
    after[GAPS] = IN_GAPS
    begins[GAPS, IN_GAPS] = False
    after[RESET] = FRESH
    return after, begins


def character_kinds(points: np.ndarray) -> np.ndarray:
    """LETTER, NUMBER, OTHER or GAP of each code point."""
    return _classes()[points]


def _character_classes(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The automaton's class of each character; `ends` are the positions that separate texts."""
    kinds = character_kinds(points)
    gap = kinds == GAP
    gap[ends] = True
    later = np.ones(len(points) + 2, bool)
    later[: len(points)] = gap
    separators = np.zeros(len(points) + 1, bool)
    separators[ends] = True
    separators[len(points)] = True
    last = gap & ~later[1: len(points) + 1]  # the next character is in the same text and is no white space
    kinds[gap] = GAPS
    kinds[last] = GAP
    kinds[last & (points == 32)] = SPACE
    if len(marks := np.flatnonzero(points == 39)):
        padded = np.concatenate((points, np.zeros(2, np.uint32)))
        one, two = padded[marks + 1], padded[marks + 2]
        kinds[marks[np.isin(one, [*map(ord, "stmd")])]] = SHORT
        kinds[marks[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))]] = LONGER
    kinds[ends] = RESET
    return kinds


def _states_before(kinds: np.ndarray) -> np.ndarray:
    """The automaton's state before each character, by composing transition functions block by block."""
    after, _ = _automaton()
    table = after.ravel()
    blocks = -(-len(kinds) // BLOCK)
    padded = np.full(blocks * BLOCK, RESET, np.uint8)
    padded[: len(kinds)] = kinds
    columns = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T).astype(np.uint16) * 8
    functions = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))
    for column in columns:
        functions = table[column[:, None] + functions]
    # chain the blocks' functions: after round r each holds the composition of the 2^r blocks up to it
    step = 1
    while step < blocks:
        functions[step:] = np.take_along_axis(functions[step:], functions[:-step], axis=1)
        step *= 2
    state = np.concatenate(([FRESH], functions[:-1, FRESH])).astype(np.uint8)
    before = np.empty((BLOCK, blocks), np.uint8)
    for k, column in enumerate(columns):
        before[k] = state
        state = table[column + state]
    return before.T.ravel()[: len(kinds)]


def pre_tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each pre-token begins and ends in the texts joined with a line feed between them, and its 64-bit hash."""
    points, at = codepoints(texts)
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ends = at[1:-1] - 1
    kinds = _character_classes(points, ends)
    _, begins = _automaton()
    first = np.flatnonzero(begins.ravel()[kinds.astype(np.uint16) * 8 + _states_before(kinds)])
    last = np.append(first[1:], len(points))
    real = kinds[first] != RESET
    first, last = first[real], last[real]
    return first, last, slice_hashes(points, kinds == RESET, first, False) if len(first) else np.zeros(0, np.uint64)


class Ranks:
    """A rank file: token bytes by number, and every pair of tokens that joins to a third."""

    def __init__(self, source: bytes):
        lines = (line.split() for line in source.splitlines() if line.strip())
        self.numbers = {base64.b64decode(a): int(b) for a, b in lines}
        self.single = np.array([self.numbers[bytes([b])] for b in range(256)])
        self.pairs = Pairs(
            (left, right, number, number) for token, number in self.numbers.items() for cut in range(1, len(token))
            if (left := self.numbers.get(token[:cut])) is not None and (right := self.numbers.get(token[cut:])) is not None)

    def encoded(self, pre_tokens: list[str]) -> list[bytes]:
        """Packed ids of each pre-token; one that is itself a token needs no merging."""
        coded = [x.encode() for x in pre_tokens]
        whole = [self.numbers.get(x) for x in coded]
        rest = [x for x, n in zip(coded, whole, strict=True) if n is None]
        symbols, left = self.pairs.merge(
            self.single[np.frombuffer(b"".join(rest), np.uint8)], np.array([len(x) for x in rest], np.int64))
        packed = symbols.astype("<u4").tobytes()
        ends = (np.cumsum(left) * 4).tolist()
        merged = iter([packed[a:b] for a, b in zip([0, *ends], ends, strict=False)])
        return [next(merged) if n is None else n.to_bytes(4, "little") for n in whole]


def read_ranks(path: str) -> Ranks:
    with open(path, "rb") as file:
        return Ranks(file.read())


def _encoded(texts: list[str], cache: Cache) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All ids of the texts, the number of ids of each pre-token, where it begins, and where each text begins.

    Only the distinct pre-tokens become strings and are looked up; the ids are laid out from these by number.
    """
    joined = "\n".join(texts)
    first, last, hashes = pre_tokens(texts)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=starts[1:])
    _, one, which = np.unique(hashes, return_index=True, return_inverse=True)
    slices = [joined[a:b] for a, b in zip(first[one].tolist(), last[one].tolist(), strict=True)]
    cache.fill(slices)
    coded = list(map(cache.__getitem__, slices))
    flat = np.frombuffer(b"".join(coded), "<u4")
    size = np.array([len(x) for x in coded], np.int64) // 4
    sizes = size[which]
    begins = (np.cumsum(size) - size)[which]
    within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return flat[np.repeat(begins, sizes) + within], sizes, first, starts


def _encoder(ranks: Broadcast, text: str, cached: int) -> Callable:
    """Batches with ids and offsets added, one for each piece of text: little is held at a time."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Cache(ranks.value.encoded, size=cached)
        for batch in batches:
            for begun, texts in pieces(batch.column(text).to_pylist(), PIECE):
                ids, offsets = [], []
                packed, sizes, first, starts = _encoded(texts, cache)
                at = np.concatenate(([0], np.cumsum(sizes)))
                cuts = np.searchsorted(first, starts)
                for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                    ids.append(packed[at[a]: at[b]].tobytes())
                    offsets.append((first[a:b] - starts[k]).astype("<u4").tobytes())
                yield _added(batch.slice(begun, len(texts)), ids=ids, offsets=offsets)

    return encoded


def _decoder(ranks: Broadcast, ids: str) -> Callable:
    """Batches with the decoded bytes added."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = ranks.value.numbers
        pieces_of = [b""] * (max(numbers.values()) + 1)
        for piece, number in numbers.items():
            pieces_of[number] = piece
        for batch in batches:
            for begun in range(0, batch.num_rows, 256):
                part = batch.slice(begun, 256)
                yield _added(part, decoded=[
                    None if x is None else b"".join(map(pieces_of.__getitem__, np.frombuffer(x, "<u4").tolist()))
                    for x in part.column(ids).to_pylist()])

    return decoded


def _added(batch: pa.RecordBatch, **columns: list) -> pa.RecordBatch:
    names = [x for x in batch.schema.names if x not in columns]
    return pa.RecordBatch.from_arrays(
        [*(batch.column(x) for x in names), *(pa.array(x, pa.binary()) for x in columns.values())], [*names, *columns])


def encode(documents: DataFrame, path: str, text: str = "text", cached: int = CACHED) -> DataFrame:
    """All columns, then `ids` and `offsets` (binary: unsigned 32-bit little-endian numbers).

    ids: the text's tokens under the ranks in the file `path`, each pre-token merged by itself, no special tokens.
    offsets: the character at which each pre-token begins. Row for row; a null or empty text has empty ids; extra
    columns stay as they are, but for the two that are added: input columns of these names are replaced. The ranks and
    their pairs (some MB, whatever the input) are read on the driver and sent out. `cached`: merged pre-tokens that a
    task keeps.
    """
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(path))
    kept = documents.drop("ids", "offsets")
    return in_arrow(kept, _encoder(ranks, text, cached), _with(kept, ("ids", "offsets")))


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """All columns, then `decoded` (binary): the bytes that the packed `ids` stand for. Null ids give null."""
    ranks = rows.sparkSession.sparkContext.broadcast(read_ranks(path))
    kept = rows.drop("decoded")
    return in_arrow(kept, _decoder(ranks, ids), _with(kept, ("decoded",)))


def round_trip(documents: DataFrame, path: str, text: str = "text", cached: int = CACHED) -> DataFrame:
    """`encode`, then `decode` of its ids, in one pass: the ids don't leave the worker in between. The text goes, the
    other columns stay."""
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(path))
    kept = documents.drop("ids", "offsets", "decoded")
    rest = kept.drop(text)
    encoded, decoded = _encoder(ranks, text, cached), _decoder(ranks, "ids")

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in decoded(encoded(batches)):
            yield batch.drop_columns([text])

    return in_arrow(kept, both, _with(rest, ("ids", "offsets", "decoded")))


def _with(rows: DataFrame, added: tuple[str, ...]) -> StructType:
    return StructType([*rows.schema.fields, *(StructField(x, BinaryType()) for x in added)])


def digests() -> list:
    """Columns n_tokens, ids_sha256, decoded_sha256 of rows that were encoded and decoded."""
    return [F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
            F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256")]
