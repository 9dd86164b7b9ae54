"""Byte-pair merging of many pre-tokens at once, and a cache of bounded size in front of it."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable

import numpy as np

#: From this many symbols on, a pre-token is merged with a heap, which keeps the work near linear for very long ones.
LONG = 64

_NEVER = np.iinfo(np.int64).max


class Pairs:
    """Which two symbols (numbers below 2^31) merge, in which order, and into what."""

    def __init__(self, pairs: Iterable[tuple[int, int, int, int]]):
        left, right, rank, merged = np.array(sorted(pairs), np.int64).reshape(-1, 4).T
        self.keys = left << 32 | right
        self.ranks, self.merged = rank.copy(), merged.copy()
        self._table: dict[int, tuple[int, int]] | None = None

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of each pair; the rank is the largest number if it never merges."""
        if not len(self.keys):
            return np.full(len(left), _NEVER), left
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], _NEVER), self.merged[at]

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges each word (the next `sizes` symbols): lowest rank first, of these the leftmost, until none has one.

        Returns the symbols left, in the same order, and their number in each word. Every round merges one pair in each
        word that still has one, for all words together.
        """
        sizes = np.asarray(sizes, np.int64)
        long = sizes >= LONG
        if long.any():
            begins = np.cumsum(sizes) - sizes
            parts, left = {}, sizes.copy()
            for k in np.flatnonzero(long).tolist():
                parts[k] = self._merge_long(symbols[begins[k]: begins[k] + sizes[k]].tolist())
                left[k] = len(parts[k])
            short, left[~long] = self.merge(symbols[np.repeat(~long, sizes)], sizes[~long])
            out = np.empty(int(left.sum()), symbols.dtype)
            keep = np.repeat(~long, left)
            out[keep] = short
            ends = np.cumsum(left)
            for k, part in parts.items():
                out[ends[k] - left[k]: ends[k]] = part
            return out, left
        done = sizes.copy()
        results: list[tuple[np.ndarray, np.ndarray]] = []
        words = np.flatnonzero(sizes)
        at_word = np.repeat(np.arange(len(words)), sizes[words])
        symbols, sizes = symbols.astype(np.int64), sizes[words]
        ranks = np.full(len(symbols), _NEVER)
        merged = symbols.copy()
        inner = np.flatnonzero(at_word[1:] == at_word[:-1])
        ranks[inner], merged[inner] = self.find(symbols[inner], symbols[inner + 1])
        while len(words):
            begins = np.cumsum(sizes) - sizes
            lowest = np.minimum.reduceat(ranks, begins)
            open_ = lowest != _NEVER
            if not open_.all():
                over = ~open_[at_word]
                results.append((np.repeat(words[~open_], sizes[~open_]), symbols[over]))
                done[words[~open_]] = sizes[~open_]
                symbols, ranks, merged = symbols[~over], ranks[~over], merged[~over]
                words, sizes, lowest = words[open_], sizes[open_], lowest[open_]
                at_word = np.repeat(np.arange(len(words)), sizes)
                if not len(words):
                    break
            hits = np.flatnonzero(ranks == lowest[at_word])
            hits = hits[np.append(True, at_word[hits[1:]] != at_word[hits[:-1]])]
            symbols[hits] = merged[hits]
            keep = np.ones(len(symbols), bool)
            keep[hits + 1] = False
            symbols, ranks, merged, at_word = symbols[keep], ranks[keep], merged[keep], at_word[keep]
            sizes = sizes - 1
            hits -= np.arange(len(hits))
            for place in (hits, hits[hits > 0] - 1):  # the pairs that the new symbols stand in
                pair = place[place + 1 < len(symbols)]
                same = at_word[pair] == at_word[pair + 1]
                ranks[place] = _NEVER if place is hits else ranks[place]
                pair = pair[same]
                ranks[pair], merged[pair] = self.find(symbols[pair], symbols[pair + 1])
        if not results:
            return symbols[:0], done
        owner = np.concatenate([a for a, _ in results])
        return np.concatenate([b for _, b in results])[np.argsort(owner, kind="stable")], done

    def _merge_long(self, symbols: list[int]) -> list[int]:
        if self._table is None:
            self._table = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged.tolist(), strict=True), strict=True))
        find = self._table.get
        size = len(symbols)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(hit[0], i, symbols[i], symbols[i + 1], hit[1]) for i in range(size - 1)
                if (hit := find(symbols[i] << 32 | symbols[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, left, right, joined = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= size or symbols[j] != right:
                continue  # one of the two has changed since
            symbols[i], symbols[j], after[i] = joined, -1, after[j]
            if (k := after[i]) < size:
                before[k] = i
                if hit := find(joined << 32 | symbols[k]):
                    heapq.heappush(heap, (hit[0], i, joined, symbols[k], hit[1]))
            if (h := before[i]) >= 0 and (hit := find(symbols[h] << 32 | joined)):
                heapq.heappush(heap, (hit[0], h, symbols[h], joined, hit[1]))
        return [x for x in symbols if x >= 0]


class Cache(dict):
    """Results by pre-token. `fill` computes those of a batch that are new, all together.

    It is emptied down to `fixed` once it holds `size` entries; very long pre-tokens are kept for one batch only.
    """

    def __init__(self, make: Callable[[list[str]], list], fixed: dict | None = None, size: int = 400_000, longest: int = 200):
        super().__init__(fixed or {})
        self.make, self.fixed, self.size, self.longest = make, fixed or {}, size, longest
        self.long: list[str] = []

    def fill(self, pre_tokens: Iterable[str]) -> None:
        for word in self.long:
            self.pop(word, None)
        if len(self) >= self.size:
            self.clear()
            self.update(self.fixed)
        new = [x for x in set(pre_tokens) if x not in self]
        self.long = [x for x in new if len(x) > self.longest]
        if new:
            self.update(zip(new, self.make(new), strict=True))
