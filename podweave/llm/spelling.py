"""Spelling variants: words at one edit from each other, each tied to its most frequent near word.

Words are compared within tiles. One edit leaves the first or the second half of a word as it is, so words of one length
block and the next that share a half make a tile; without the halves, the work would grow with the square of the
vocabulary. In a tile, NumPy products of letter-count matrices, block by block, give the squared distances of the counts;
one edit changes at most two counts by one, so pairs at a squared distance of 1 or 2 are kept, and edits verify these. A
tile gives one row per word (how many are near, and the most frequent of them), never its pairs, and a large tile is cut
into blocks that meet two by two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podweave.llm.landing import dropped, in_arrow, landed
from podweave.llm.textarrays import grouped

#: What runs are made of, and of how many the runs one loses a letter.
RUNS = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOSES = 97

#: Words of a block, and letters: words together have so many code points at most, unless one has more by itself.
BLOCK_WORDS, BLOCK_LETTERS = 1024, 1 << 20

TILE = ["short", "side", "half", "i", "j"]

#: Tiles of fewer words than this are worked on several at a time.
SMALL = 64


def lowered(run: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(run, UPPER, LOWER)


def with_slips(run: Column, key: Column) -> Column:
    """The run, or the run without one letter where LOSES divides the CRC-32 of `<key>:<run>`: slips for tests, made the
    same way on every run."""
    drawn = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(drawn, F.length(run).cast("long")).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(F.pmod(drawn, F.lit(LOSES)) == 0, cut).otherwise(run)


def word_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", least_letters: int = 5, least_count: int = 3,
                slips: bool = False) -> DataFrame:
    """word, n: the distinct lowered runs of letters of at least so many code points that occur at least so often.

    A null text has none. With `slips`, runs go through `with_slips`; a null key is then written as nothing. Repeated rows
    count as often as they are there. Counts are summed up before the shuffle.
    """
    runs = documents.select(F.col(key).alias("key"), F.explode(F.regexp_extract_all(text, F.lit(RUNS), F.lit(0))).alias("run"))
    runs = runs.select("key", lowered(F.col("run")).alias("run"))
    words = runs.select((with_slips(F.col("run"), F.col("key")) if slips else F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _tiles(words: DataFrame) -> DataFrame:
    """short (the tile's smaller length), side (0: first half shared, 1: second half), half (hash), word, n, letters.

    Every word is in the tiles of its own length and of one less, as it may be the shorter or the longer of a pair."""
    size = F.length("word")
    spots = F.explode(F.array(*(F.struct((size - longer).alias("short"), F.lit(side).alias("side"))
                                for longer in (0, 1) for side in (0, 1)))).alias("spot")
    first = F.floor(F.col("spot.short") / 2).cast("int")
    half = F.when(F.col("spot.side") == 0, F.substring("word", F.lit(1), first)).otherwise(
        F.substring("word", F.length("word") - F.col("spot.short") + first + 1, F.length("word")))
    return words.select("word", "n", size.alias("letters"), spots).select(
        "spot.short", "spot.side", F.xxhash64("spot.short", "spot.side", half).alias("half"), "word", "n", "letters")


def _counts(points: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    """Letter counts: one row per word, one column per letter (a-z, and U+00C0 to U+00FF)."""
    column = np.where(points >= 0xC0, points.astype(np.int64) - 0xC0 + 26, points.astype(np.int64) - 97)
    return np.bincount(owner * 90 + column, minlength=size * 90).reshape(size, 90).astype(np.float64)


def one_edit(short: str, long: str) -> bool:
    """Whether `long` is `short` with one code point replaced (of equal length) or inserted."""
    at = next((k for k, (x, y) in enumerate(zip(short, long)) if x != y), len(short))
    return at < len(long) and short[at + (len(short) == len(long)):] == long[at + 1:]


def _near_pairs(words: list[str], tile: np.ndarray, short: np.ndarray, side: np.ndarray, block: np.ndarray) -> Iterator[tuple[int, int]]:
    """Index pairs (a, b), once each, of the words at one edit in the same tile.

    `tile` numbers the tiles, `short` and `side` are theirs, word by word. Where a tile's rows are of two blocks, only
    pairs across them count."""
    sizes = np.array([len(x) for x in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    counts = _counts(points, np.repeat(np.arange(len(words)), sizes), len(words))
    norms = (counts * counts).sum(axis=1)
    starts = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1])))
    for a, b in zip(starts, [*starts[1:], len(words)], strict=True):
        for c in range(a, b, BLOCK_WORDS):  # rows of the block against all of the tile's rows
            d = min(c + BLOCK_WORDS, b)
            distance = norms[c:d, None] + norms[None, a:b] - 2 * (counts[c:d] @ counts[a:b].T)
            i, j = np.nonzero((distance > 0.5) & (distance < 2.5))
            i, j = i + c, j + a
            two = block[a] != block[a:b].max() or block[a] != block[a:b].min()
            own, other = sizes[i], sizes[j]
            fits = (own == short[a]) & ((other == own + 1) | (other == own) & (i < j))
            if two:
                fits &= block[i] != block[j]
            for x, y in zip(i[fits].tolist(), j[fits].tolist(), strict=True):
                middle = int(short[a]) // 2
                same_first = words[x][:middle] == words[y][:middle]
                # a pair that shares both halves is the first half's; equal hashes of halves prove nothing
                if same_first != (side[a] == 1) and one_edit(words[x], words[y]):
                    if side[a] == 0 or words[x][middle:] == words[y][sizes[y] - (short[a] - middle):]:
                        yield x, y


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n_near, best, best_n of the words that have near words in a tile."""
    held: list[pa.Table] = []

    def done() -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables(held)
        words, n = table.column("word").to_pylist(), table.column("n").to_pylist()
        tile = np.repeat(np.arange(len(held)), [x.num_rows for x in held])
        near: dict[int, list] = {}
        for a, b in _near_pairs(words, tile, *(table.column(c).to_numpy() for c in ("short", "side", "block"))):
            for x, y in ((a, b), (b, a)):
                best = near.get(x)
                if best is None:
                    near[x] = [1, y]
                else:
                    best[0] += 1
                    if (-n[y], words[y]) < (-n[best[1]], words[best[1]]):
                        best[1] = y
        if near:
            rows = [(words[x], many, words[y], n[y]) for x, (many, y) in near.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)],
                ["word", "n_near", "best", "best_n"])

    waiting = 0
    for group in grouped(batches, TILE):
        if group.num_rows < 2:
            continue
        if held and (group.num_rows > SMALL or waiting > BLOCK_WORDS):
            yield from done()
            held, waiting = [], 0
        held.append(group)
        waiting += group.num_rows
        if group.num_rows > SMALL:
            yield from done()
            held, waiting = [], 0
    if held:
        yield from done()


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best (the most frequent near word, the least in code-point order of equal ones), best_n, of the words
    (a stored table: word, n; words distinct, null not among them) that have any."""
    spots = _tiles(words)
    sizes = spots.groupBy("short", "side", "half").agg(F.count(F.lit(1)).alias("words"), F.sum("letters").alias("letters"))
    blocks = F.greatest(F.ceil(F.col("words") / BLOCK_WORDS), F.ceil(F.col("letters") / BLOCK_LETTERS)).cast("int")
    sizes = landed(sizes.where("words > 1").select("short", "side", "half", blocks.alias("blocks")))
    spots = spots.join(sizes, ["short", "side", "half"])
    block = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    spots = spots.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = spots.select("half", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                        "short", "side", "block", "word", "n")
    tiles = rows.repartition(*TILE).sortWithinPartitions(*TILE)
    found = landed(in_arrow(tiles, _met, "word string, n_near long, best string, best_n long"))
    dropped(sizes)
    best = F.min(F.struct((-F.col("best_n")).alias("order"), F.col("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", F.col("b.best").alias("best"), (-F.col("b.order")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root (the last word on the way from form to form; of words without a form, themselves). `forms`: word, form; a
    stored table in which no way comes back to its start.

    Pointers double with every round: each word then knows the word twice as far up."""
    ways = forms.select("word", F.coalesce("form", "word").alias("root"))
    while True:
        ways = landed(ways)
        ups = ways.where("word <> root").select(F.col("word").alias("root"), F.col("root").alias("up"))
        longer = ways.join(ups, "root", "left")
        if longer.where("up IS NOT NULL").isEmpty():
            return ways
        ways = longer.select("word", F.coalesce("up", "root").alias("root"))


def variants(words: DataFrame, factor: int = 2) -> DataFrame:
    """One row per word of `words` (word, n): word, form, root, n, n_near, form_n.

    Words are near at exactly one inserted, deleted or replaced code point. form: the most frequent near word (of equal
    ones the least in code-point order) if it is at least `factor` (2 or more) times as frequent, else null; form_n its
    count. root: the last word on the way from form to form. n_near: the number of near words, 0 if none. Words are taken
    to be distinct, made of the lowered letters of `RUNS`; a null word is left out. Words of any length are compared
    whole. Needs the shared folder.
    """
    stored = landed(words.where("word IS NOT NULL").select("word", "n"))
    near = near_words(stored)
    form = F.col("best_n") >= factor * F.col("n")
    tied = landed(stored.join(near, "word", "left").select(
        "word", F.when(form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(form, F.col("best_n")).alias("form_n")))
    dropped(stored)
    return tied.join(roots(tied.select("word", "form")), "word").select("word", "form", "root", "n", "n_near", "form_n")
