"""Merging of byte pairs by rank, for many pre-tokens at once."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

#: Pre-tokens a worker remembers from batch to batch. It bounds memory and changes no result.
REMEMBERED = 400_000


class RankQueue:
    """Buckets of positions by rank; the lowest rank that has any is found by find-first-set.

    A level of the bitmap has a bit for each word of 64 bits of the level below; the bottom level
    has one for each rank.
    """

    def __init__(self, n_ranks: int):
        self.levels: list[list[int]] = []
        size = max(1, n_ranks)
        while size > 1 or not self.levels:
            size = (size + 63) // 64
            self.levels.append([0] * size)
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        for level in self.levels:
            word, bit = rank >> 6, 1 << (rank & 63)
            was = level[word]
            level[word] = was | bit
            if was:
                break
            rank = word

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Each position into the bucket of its rank; positions of a rank stay in order."""
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        starts = [0, *cuts.tolist()]
        ends = [*starts[1:], len(ranks)]
        for rank, a, b in zip(ranks[starts].tolist(), starts, ends, strict=True):
            self.push(rank, positions[a:b])

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The lowest rank and all its positions; None if nothing waits."""
        rank = 0
        for level in reversed(self.levels):
            word = level[rank]
            if not word:
                return None
            rank = rank << 6 | (word & -word).bit_length() - 1
        bucket, at = self.buckets.pop(rank), rank
        for level in self.levels:
            word = at >> 6
            level[word] &= ~(1 << (at & 63))
            if level[word]:
                break
            at = word
        return rank, bucket[0] if len(bucket) == 1 else np.concatenate(bucket)


class Merger:
    """Merges adjacent symbols: in each pre-token the pair of lowest rank, leftmost first.

    ``left``, ``right`` and ``rank`` list the pairs; ``result`` has the symbol each rank makes.
    ``bytes_`` has the symbol of each of the 256 bytes.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, result: np.ndarray, bytes_: np.ndarray):
        n = int(max(left.max(initial=0), right.max(initial=0), result.max(initial=0), bytes_.max())) + 1
        self.result, self.bytes_ = result, bytes_
        self.after = _by_symbol(left, right, rank, n)
        self.before = _by_symbol(right, left, rank, n)
        # Ranks whose result can be part of a pair of lower rank: their pairs merge one at a time.
        lowest = np.full(n, len(result), np.int64)
        np.minimum.at(lowest, left, rank)
        np.minimum.at(lowest, right, rank)
        self.careful = set(np.flatnonzero(lowest[result] < np.arange(len(result))).tolist())
        self.first = np.full((256, 256), -1, np.int32)
        of = {int(s): b for b, s in enumerate(bytes_)}
        for a, b, r in zip(left.tolist(), right.tolist(), rank.tolist(), strict=True):
            if a in of and b in of:
                self.first[of[a], of[b]] = r

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all pieces one after the other, and how many each piece has.

        Parts are a linked list over their first bytes. ``pair`` has the rank of the pair that
        starts at a part; a queued position with which it no longer agrees is stale.
        """
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(raw)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        symbol = np.append(self.bytes_[raw], -1).astype(np.int32)
        nxt, prv = np.arange(1, n + 2), np.arange(-1, n)
        filled = lengths > 0
        nxt[ends[filled] - 1] = n
        prv[(ends - lengths)[filled]] = n
        pair = np.full(n + 1, -1, np.int32)
        if n > 1:
            pair[: n - 1] = self.first[raw[:-1], raw[1:]]
            pair[ends[filled] - 1] = -1
        queue = RankQueue(len(self.result))
        at = np.flatnonzero(pair >= 0)
        if len(at):
            ranks = pair[at]
            queue.push_all(ranks.astype(np.uint16) if len(self.result) < 65536 else ranks, at)
        merged = np.zeros(n + 1, bool)
        gone = np.zeros(n + 1, bool)
        piece = np.repeat(np.arange(len(pieces)), lengths) if self.careful else None
        while entry := queue.pop():
            rank, at = entry
            at = at[pair[at] == rank]
            if not len(at):
                continue
            if len(at) > 1:
                at.sort()
                if rank in self.careful:
                    owner = piece[at]
                    later = np.append(False, owner[1:] == owner[:-1])
                    if later.any():
                        queue.push(rank, at[later])
                        at = at[~later]
                else:
                    at = _leftmost(at, nxt)
            new = int(self.result[rank])
            right = nxt[at]
            end = nxt[right]
            nxt[at], prv[end] = end, at
            pair[right], gone[right] = -1, True
            symbol[at] = new
            found = _ranks(self.after, new, symbol[end])
            pair[at] = found
            merged[at] = True
            left = prv[at]
            left = left[(left < n) & ~merged[left]]
            merged[at] = False
            known = _ranks(self.before, new, symbol[left])
            pair[left] = known
            ranks, places = np.concatenate((found, known)), np.concatenate((at, left))
            hit = ranks >= 0
            if hit.any():
                queue.push_all(ranks[hit], places[hit])
        stay = ~gone[:n]
        kept = np.append(0, np.cumsum(stay))
        return symbol[:n][stay], kept[ends] - kept[ends - lengths]


def _by_symbol(one: np.ndarray, other: np.ndarray, rank: np.ndarray, n: int) -> tuple:
    order = np.lexsort((other, one))
    return np.searchsorted(one[order], np.arange(n + 1)).tolist(), other[order].astype(np.int32), rank[order].astype(np.int32)


def _ranks(pairs: tuple, symbol: int, others: np.ndarray) -> np.ndarray:
    starts, partners, ranks = pairs
    a, b = starts[symbol], starts[symbol + 1]
    if a == b:
        return np.full(len(others), -1, np.int32)
    place = np.minimum(np.searchsorted(partners[a:b], others), b - a - 1)
    return np.where(partners[a:b][place] == others, ranks[a:b][place], -1).astype(np.int32)


def _leftmost(at: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Of positions whose pairs overlap in a row, every other one from the left."""
    chained = nxt[at[:-1]] == at[1:]
    if not chained.any():
        return at
    index = np.arange(len(at))
    start = np.maximum.accumulate(np.where(np.append(True, ~chained), index, 0))
    return at[(index - start) % 2 == 0]


class Pool:
    """What pre-tokens merge to, made in bulk when a batch first shows them.

    ``merge`` gives values of many pre-tokens, one after the other, and their counts.
    """

    def __init__(self, merge: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.merge = merge
        self.clear()

    def clear(self) -> None:
        self.numbers = _Numbers()
        self.values = np.empty(0, np.int32)
        self.starts = np.empty(0, np.int64)
        self.counts = np.empty(0, np.int64)

    def number(self, parts: Iterable[str], size: int) -> np.ndarray:
        return np.fromiter(map(self.numbers.__getitem__, parts), np.int32, size)

    def fill(self) -> None:
        """Merges all pre-tokens numbered since the last call."""
        known = len(self.counts)
        if len(self.numbers) > known:
            values, counts = self.merge(self.numbers.new)
            starts = len(self.values) + np.cumsum(counts) - counts
            self.values = np.concatenate((self.values, values))
            self.starts = np.concatenate((self.starts, starts))
            self.counts = np.concatenate((self.counts, counts))
            self.numbers.new = []

    def expand(self, numbers: np.ndarray) -> np.ndarray:
        """The values of numbered pre-tokens, one after the other."""
        counts = self.counts[numbers]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        shift = np.repeat(self.starts[numbers] - (ends - counts), counts)
        return self.values[shift + np.arange(total)]

    def trim(self) -> None:
        if len(self.numbers) > REMEMBERED:
            self.clear()


class _Numbers(dict):
    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self.new.append(key)
        number = self[key] = len(self)
        return number
