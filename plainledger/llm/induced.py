"""External induced sorting of the suffixes of one shard, with their common prefixes.

A suffix is of type S if it is smaller than the next one, else of type L; an S suffix
after an L suffix starts a substring that reaches to the next such place. These
substrings are sorted and named, the string of names is sorted by recursion (in memory
once it has at most `base` names), which gives the order of the starting suffixes.
Scanned in ascending order they induce all L suffixes: the suffix before a scanned one
goes into a priority queue under its first symbol. Scanned in descending order the L
suffixes induce all S suffixes the same way. Equal symbols leave the queue in the order
in which they came, so a queue needs no ranks. Each entry is a tuple of its place and
the symbols it has in common with the entry before it under the same symbol: one more
than the smallest common prefix scanned between the two that induced them. Common
prefixes are counted up to a cap.

Queues keep `memory` bytes and write the rest to an unlinked file of the task as runs
sorted by symbol, which are read back in blocks; a task that is lost leaves nothing and
is run again. The symbols themselves (one byte each), their types and the names stay in
memory, so that is about eight bytes a symbol against some forty for the tuples.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterator

import numpy as np

# Entries handled at once.
BLOCK = 1 << 18
MEMORY = 256 << 20
# Names that are sorted in memory.
BASE = 1 << 24
NONE = 255


class Queue:
    """Disk-backed priority queue: entries of a symbol come in the order in which they were pushed."""

    def __init__(self, kind: np.dtype, memory: int, largest_first: bool = False):
        self.kind, self.memory, self.sign = kind, memory, -1 if largest_first else 1
        self.held: dict[int, list[np.ndarray]] = {}
        self.bytes = 0
        self.runs: list[dict[int, list[int]]] = []
        self.file = None
        self.heap: list[int] = []
        self.known: set[int] = set()

    def push(self, symbols: np.ndarray, rows: np.ndarray) -> None:
        """Entries already grouped by symbol, in order within each."""
        borders = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
        for start, stop in zip(borders.tolist(), np.append(borders[1:], len(symbols)).tolist()):
            symbol = int(symbols[start])
            self.held.setdefault(symbol, []).append(rows[start:stop])
            if symbol not in self.known:
                self.known.add(symbol)
                heapq.heappush(self.heap, self.sign * symbol)
        self.bytes += rows.nbytes
        if self.bytes > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        run: dict[int, list[int]] = {}
        for symbol in sorted(self.held):
            count = 0
            for rows in self.held[symbol]:
                self.file.write(np.ascontiguousarray(rows).tobytes())
                count += len(rows)
            run[symbol] = [at, count]
            at += count * self.kind.itemsize
        self.runs.append(run)
        self.held, self.bytes = {}, 0

    def next_symbol(self) -> int | None:
        return self.sign * self.heap[0] if self.heap else None

    def finish(self, symbol: int) -> None:
        """The symbol has no more entries and will get none."""
        self.known.discard(symbol)
        if self.heap and self.heap[0] == self.sign * symbol:
            heapq.heappop(self.heap)

    def take(self, symbol: int) -> np.ndarray | None:
        """Next entries of the symbol, at most BLOCK of them; None if there are none now."""
        for run in self.runs:
            if symbol in run:
                at, count = run[symbol]
                n = min(count, BLOCK)
                self.file.seek(at)
                rows = np.frombuffer(self.file.read(n * self.kind.itemsize), dtype=self.kind)
                if n == count:
                    del run[symbol]
                else:
                    run[symbol] = [at + n * self.kind.itemsize, count - n]
                return rows
        blocks = self.held.pop(symbol, None)
        if blocks is None:
            return None
        rows = blocks[0] if len(blocks) == 1 else np.concatenate(blocks)
        if len(rows) > BLOCK:
            self.held[symbol] = [rows[BLOCK:]]
            rows = rows[:BLOCK]
        self.bytes -= rows.nbytes
        return rows


class Stack:
    """Disk-backed blocks per symbol, read from the last to the first."""

    def __init__(self, kind: np.dtype, memory: int):
        self.kind, self.memory, self.bytes = kind, memory, 0
        self.blocks: dict[int, list[np.ndarray | tuple[int, int]]] = {}
        self.file = None

    def push(self, symbol: int, rows: np.ndarray) -> None:
        if self.bytes + rows.nbytes > self.memory:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            at = self.file.seek(0, 2)
            self.file.write(np.ascontiguousarray(rows).tobytes())
            self.blocks.setdefault(symbol, []).append((at, len(rows)))
            return
        self.bytes += rows.nbytes
        self.blocks.setdefault(symbol, []).append(rows)

    def pop(self, symbol: int) -> np.ndarray | None:
        blocks = self.blocks.get(symbol)
        if not blocks:
            return None
        last = blocks.pop()
        if isinstance(last, tuple):
            self.file.seek(last[0])
            return np.frombuffer(self.file.read(last[1] * self.kind.itemsize), dtype=self.kind)
        self.bytes -= last.nbytes
        return last


def smaller_types(text: np.ndarray) -> np.ndarray:
    """Which suffixes are of type S; the end is smaller than any symbol."""
    out = np.zeros(len(text), dtype=bool)
    np.less(text[:-1], text[1:], out=out[:-1])
    equal = np.flatnonzero(text[:-1] == text[1:])
    if len(equal):
        # Equal neighbours are of the type of the last of them.
        final = np.append(equal[1:] != equal[:-1] + 1, True)
        out[equal] = out[equal[final] + 1][np.cumsum(final) - final]
    return out


def names(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, int]:
    """Rank of the substring from each start to the next one, equal substrings alike, and how many there are.

    Where one ends and the other goes on, the shorter is the larger: it ends in an S
    suffix, the other has an L suffix there.
    """
    n, count = len(text), len(starts)
    base = int(text.max()) + 3
    # Bytes are compared eight at a time. The end needs a zero of its own; a substring that goes on
    # where another ends goes on with a smaller symbol, so a largest one does for the ended.
    eight = text.dtype == np.uint8 and text.min() > 0
    width = 8 if eight else max(1, int(62 // np.log2(base)))
    stop = np.append(starts[1:], n)
    rank = np.zeros(count, dtype=np.int64)
    open_, at = np.arange(count), 0
    padded = np.append(text, np.zeros(16, dtype=np.uint8)) if eight else np.append(text.astype(np.int64) + 1, 0)
    words = np.lib.stride_tricks.as_strided(padded, (n + 8, 8), (1, 1)).view(">u8")[:, 0] if eight else None
    while len(open_):
        begin, end = starts[open_] + at, stop[open_]
        if eight:
            key = words[begin].astype(np.uint64)
            short = np.flatnonzero(end - begin < width - 1)
            key[short] |= (np.uint64(1) << (8 * (width - 1 - (end - begin)[short])).astype(np.uint64)) - np.uint64(1)
        else:
            key = np.zeros(len(open_), dtype=np.int64)
            for k in range(width):
                key *= base
                key += np.where(begin + k <= end, padded[np.minimum(begin + k, n)], base - 1)
        order = np.lexsort((key, rank[open_])) if at else np.argsort(key)
        open_, key, done = open_[order], key[order], (begin + width > end)[order]
        group = rank[open_]
        spot = np.arange(len(open_))
        new_group = np.append(True, group[1:] != group[:-1])
        new_key = np.append(True, key[1:] != key[:-1]) | new_group
        rank[open_] = group + np.maximum.accumulate(np.where(new_key, spot, 0)) - np.maximum.accumulate(np.where(new_group, spot, 0))
        sizes = np.diff(np.append(np.flatnonzero(new_key), len(open_)))
        open_ = open_[(np.repeat(sizes, sizes) > 1) & ~done]
        at += width
    used = np.zeros(count, dtype=bool)
    used[rank] = True
    return (np.cumsum(used) - 1)[rank], int(used.sum())


def doubled(text: np.ndarray) -> np.ndarray:
    """Suffix array in memory by doubling, for the names at the bottom of the recursion."""
    n, bits = len(text), (int(text.max()) + 1).bit_length()
    # As many names at once as one number holds.
    width = max(1, min(n, 63 // bits))
    key = np.zeros(n, dtype=np.int64)
    for k in range(width):
        key <<= bits
        key[:n - k] += text[k:] + 1
    order = np.argsort(key)
    key = key[order]
    fresh = np.append(True, key[1:] != key[:-1])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    sizes = np.diff(np.append(np.flatnonzero(fresh), n))
    open_ = order[np.repeat(sizes > 1, sizes)]
    while len(open_):
        # Rank and the rank that follows as one number: `base` names are far below the 2^31 that fit.
        key = rank[open_] * (n + 1) + np.where(open_ + width < n, rank[np.minimum(open_ + width, n - 1)] + 1, 0)
        by = np.argsort(key)
        open_, key = open_[by], key[by]
        group, spot = rank[open_], np.arange(len(open_))
        new_group = np.append(True, group[1:] != group[:-1])
        new_key = np.append(True, key[1:] != key[:-1])
        rank[open_] = group + np.maximum.accumulate(np.where(new_key, spot, 0)) - np.maximum.accumulate(np.where(new_group, spot, 0))
        sizes = np.diff(np.append(np.flatnonzero(new_key), len(open_)))
        open_ = open_[np.repeat(sizes > 1, sizes)]
        width *= 2
    out = np.empty(n, dtype=np.int64)
    out[rank] = np.arange(n)
    return out


class Common:
    """Equal symbols of pairs of suffixes, up to the cap."""

    def __init__(self, text: np.ndarray, cap: int):
        self.n, self.cap, self.width = len(text), cap, 8 if text.dtype == np.uint8 else 1
        if self.width == 8:
            # Eight symbols at a time; after the end of the text come bytes that the clip below takes off again.
            padded = np.append(text, np.zeros(cap + 16, dtype=np.uint8))
            self.words = np.lib.stride_tricks.as_strided(padded, (self.n + cap + 8, 8), (1, 1)).view("<u8")[:, 0]
        else:
            self.words = np.append(text, np.zeros(cap + 1, dtype=text.dtype))

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        words, width = self.words, self.width
        total = np.zeros(len(left), dtype=np.int64)
        open_, a, b = np.arange(len(left)), left, right
        for at in range(0, self.cap, width):
            differ = words[a] ^ words[b]
            same = differ == 0
            if width == 8:
                some = np.flatnonzero(~same)
                low = differ[some] & (~differ[some] + np.uint64(1))
                total[open_[some]] = at + (np.frexp(low.astype(np.float64))[1] - 1) // 8
            open_, a, b = open_[same], a[same] + width, b[same] + width
            total[open_] = at + width
            if not len(open_):
                break
        return np.minimum(total, np.minimum(self.cap, self.n - np.maximum(left, right)))


class Scan:
    """What the scan of suffixes in one direction pushes, with the common prefixes of its entries.

    `since` holds for each symbol the smallest common prefix scanned since its last entry.
    """

    def __init__(self, text: np.ndarray, small: np.ndarray, wanted: bool, queue: Queue, cap: int):
        self.text, self.queue, self.cap = text, queue, cap
        # Whether the suffix before a place is one that is pushed.
        self.pushed = np.append(False, small == wanted)
        # Symbols without an entry yet come out as zero.
        self.since = np.full(int(text.max()) + 1, -1, dtype=np.int16) if cap else None

    def __call__(self, at: np.ndarray, lcp: np.ndarray | None) -> None:
        chosen = np.flatnonzero(self.pushed[at])
        before = at[chosen] - 1
        symbols = self.text[before]
        order = np.argsort(symbols, kind="stable")
        chosen, symbols = chosen[order], symbols[order]
        rows = np.empty(len(chosen), dtype=self.queue.kind)
        rows["at"] = before[order]
        if self.cap:
            rows["lcp"] = self._prefixes(chosen, symbols, lcp)
        if len(chosen):
            self.queue.push(symbols, rows)

    def _prefixes(self, chosen: np.ndarray, symbols: np.ndarray, lcp: np.ndarray) -> np.ndarray:
        lowest, since = int(lcp.min()), self.since
        if not len(chosen):
            np.minimum(since, lowest, out=since)
            return lcp[:0]
        n = len(lcp)
        # The smallest of each run of 2^k neighbours, k after k.
        tables = np.empty((n.bit_length(), n), dtype=lcp.dtype)
        tables[0] = lcp
        for k in range(1, len(tables)):
            half = 1 << (k - 1)
            np.minimum(tables[k - 1, :n - 2 * half + 1], tables[k - 1, half:n - half + 1], out=tables[k, :n - 2 * half + 1])
        flat = tables.ravel()

        def smallest(start, stop):
            level = np.frexp((stop - start).astype(np.float64))[1] - 1
            row = level.astype(np.int64) * n
            return np.minimum(flat[row + start], flat[row + stop - (1 << level)])

        first = np.append(True, symbols[1:] != symbols[:-1])
        start = np.append(0, chosen[:-1] + 1)
        start[first] = 0
        least = smallest(start, chosen + 1).astype(np.int16)
        least[first] = np.minimum(least[first], since[symbols[first]])
        out = np.minimum(least + 1, self.cap)
        final = np.flatnonzero(np.append(first[1:], True))
        np.minimum(since, lowest, out=since)
        rest = np.full(len(final), NONE, dtype=np.int16)
        more = chosen[final] + 1 < n
        rest[more] = smallest(chosen[final][more] + 1, n)
        since[symbols[final]] = rest
        return out


def starting_suffixes(text: np.ndarray, small: np.ndarray, memory: int, base: int) -> np.ndarray:
    """Places of the S suffixes after an L suffix, in the order of the suffixes."""
    starts = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(starts) < 2:
        return starts
    named, different = names(text, starts)
    if different == len(starts):
        order = np.empty(len(starts), dtype=np.int64)
        order[named] = np.arange(len(starts))
    elif len(starts) <= base:
        order = doubled(named)
    else:
        order = np.concatenate([at for at, _ in descending(named, 0, memory, base)])[::-1]
    return starts[order]


def descending(text: np.ndarray, cap: int, memory: int = MEMORY, base: int = BASE) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """All suffixes from the largest to the smallest: places, and the symbols in common with the one before.

    Common prefixes count up to `cap` (at most 254); none are carried if it is 0.
    """
    n = len(text)
    if not n:
        return
    kind = np.dtype([("at", "<u4" if n < 1 << 32 else "<u8"), *([("lcp", "u1")] if cap else [])])
    small = smaller_types(text)
    stars = starting_suffixes(text, small, memory, base)
    heads = text[stars]
    common = Common(text, cap) if cap else None
    star_lcp = np.zeros(len(stars), dtype=np.uint8)
    if cap and len(stars) > 1:
        star_lcp[1:] = common(stars[:-1], stars[1:])
    symbols = np.unique(heads)
    borders = dict(zip(symbols.tolist(), zip(np.searchsorted(heads, symbols).tolist(), np.searchsorted(heads, symbols, "right").tolist())))
    waiting = sorted(borders, reverse=True)

    large, done = Queue(kind, memory // 2), Stack(kind, memory // 2)
    scan = Scan(text, small, False, large, cap)
    scan(np.array([n]), np.zeros(1, dtype=np.uint8))
    while (symbol := large.next_symbol()) is not None or waiting:
        if symbol is None or waiting and waiting[-1] < symbol:
            symbol = waiting[-1]
        last = None
        while (rows := large.take(symbol)) is not None:
            done.push(symbol, rows)
            scan(rows["at"].astype(np.int64), rows["lcp"] if cap else None)
            last = rows["at"][-1:]
        if waiting and waiting[-1] == symbol:
            start, stop = borders[waiting.pop()]
            for at in range(start, stop, BLOCK):
                block = slice(at, min(stop, at + BLOCK))
                lcp = star_lcp[block].copy()
                if at == start:
                    lcp[0] = common(last.astype(np.int64), stars[at:at + 1])[0] if cap and last is not None else 0
                scan(stars[block], lcp if cap else None)
        large.finish(symbol)

    small_queue = Queue(kind, memory // 2, largest_first=True)
    scan = Scan(text, small, True, small_queue, cap)
    for symbol in _largest_first(small_queue, sorted(done.blocks)):
        last = None
        while (rows := small_queue.take(symbol)) is not None:
            at, lcp = rows["at"].astype(np.int64), rows["lcp"] if cap else None
            scan(at, lcp)
            last = at[-1:]
            yield at, lcp
        link = 0
        while (rows := done.pop(symbol)) is not None:
            at, lcp = rows["at"][::-1].astype(np.int64), None
            if cap:
                # Each entry knows the one that is smaller; here it is wanted of the larger.
                if last is not None:
                    link = int(common(last, at[:1])[0])
                lcp = np.append(np.uint8(link), rows["lcp"][:0:-1])
                link = int(rows["lcp"][0])
            last = None
            scan(at, lcp)
            yield at, lcp
        small_queue.finish(symbol)


def _largest_first(queue: Queue, others: list[int]) -> Iterator[int]:
    while (symbol := queue.next_symbol()) is not None or others:
        if symbol is None or others and others[-1] > symbol:
            symbol = others[-1]
        if others and others[-1] == symbol:
            others.pop()
        yield symbol
