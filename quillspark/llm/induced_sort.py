"""Suffix arrays with common-prefix values by external induced sorting.

Suffixes wait in one disk-backed queue for each first symbol; as an ascending scan takes the queues in turn, each suffix
puts its longer neighbour into the queue of that neighbour's symbol, together with the common prefix it has with the
one put there before. Queues are monotone, so first-in-first-out files serve as priority queues. Common prefixes, and
so the order, are only followed up to ``depth`` symbols.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 18


class DiskQueue:
    """First in, first out, of (position, common prefix) arrays; arrays beyond the budget wait in a file."""

    def __init__(self, folder: str, budget: list[int]) -> None:
        self.folder, self.budget, self.parts, self.file, self.read_at, self.on_disk = folder, budget, deque(), None, 0, deque()
        self.used = False

    def put(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.used = True
        if self.on_disk or self.budget[0] < pos.nbytes + lcp.nbytes:
            if self.file is None:
                self.file = open(os.path.join(self.folder, os.urandom(8).hex()), "w+b")
            self.file.seek(0, 2)
            self.file.write(pos.tobytes())
            self.file.write(lcp.tobytes())
            self.on_disk.append(len(pos))
        else:
            self.budget[0] -= pos.nbytes + lcp.nbytes
            self.parts.append((pos, lcp))

    def take(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All suffixes, also those that are put in while this runs, in arrays of CHUNK at most or as they were put."""
        while self.parts or self.on_disk:
            got, n = [], 0
            while (self.parts or self.on_disk) and n < CHUNK:
                if self.parts:
                    pos, lcp = self.parts.popleft()
                    self.budget[0] += pos.nbytes + lcp.nbytes
                else:
                    size = self.on_disk.popleft()
                    self.file.seek(self.read_at)
                    self.read_at += 9 * size
                    pos, lcp = np.frombuffer(self.file.read(8 * size), np.int64), np.frombuffer(self.file.read(size), np.uint8)
                got.append((pos, lcp))
                n += len(pos)
            yield np.concatenate([p for p, _ in got]), np.concatenate([l for _, l in got])
        self._close()

    def take_back(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All suffixes from the last array that was put to the first; those on disk are read one array at a time."""
        end = 9 * sum(self.on_disk)
        while self.on_disk:
            size = self.on_disk.pop()
            end -= 9 * size
            self.file.seek(end)
            yield np.frombuffer(self.file.read(8 * size), np.int64), np.frombuffer(self.file.read(size), np.uint8)
        while self.parts:  # what is in memory was put before anything went to disk
            pos, lcp = self.parts.pop()
            self.budget[0] += pos.nbytes + lcp.nbytes
            yield pos, lcp
        self._close()

    def _close(self) -> None:
        if self.file is not None:
            self.file.close()
            os.remove(self.file.name)
            self.file = None


class InducedSorter:
    """Suffix order of ``text`` (uint8), which may be a file mapped into memory."""

    def __init__(self, text: np.ndarray, depth: int, folder: str, memory: int = 64 << 20) -> None:
        self.text, self.n, self.depth, self.folder, self.budget = text, len(text), depth, folder, [memory]
        # A suffix is S if smaller than the next one. Equal symbols take the type of what follows; the last is L.
        step = np.zeros(self.n, np.int8)
        step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
        step[-1] = -1
        known = np.flatnonzero(step)
        self.is_s = np.repeat(step[known] > 0, np.diff(np.concatenate([[-1], known])))
        lms = np.flatnonzero(self.is_s[1:] & ~self.is_s[:-1]) + 1
        self.lms = lms

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of pairs of suffixes, up to depth."""
        out = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        # Eight symbols at a time while both suffixes have as many.
        wide = np.ndarray((max(self.n - 7, 0),), "<u8", self.text, strides=(1,)) if self.n > 7 else np.zeros(0, "<u8")
        for d in range(0, self.depth, 8):
            x, y = a[live] + d, b[live] + d
            near = (x >= len(wide)) | (y >= len(wide))
            if near.any():
                out[live[near]] = d + self._common_at_end(x[near], y[near])
                live, x, y = live[~near], x[~near], y[~near]
            differs = wide[x] ^ wide[y]
            apart = differs != 0
            low = differs[apart] & (~differs[apart] + np.uint64(1))  # the lowest bit in which they differ
            out[live[apart]] = d + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
            live = live[~apart]
            if not len(live):
                break
            out[live] = d + 8
        return np.minimum(out, self.depth).astype(np.uint8)

    def _common_at_end(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """As common, symbol by symbol."""
        out = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        for d in range(self.depth):
            x, y = a[live] + d, b[live] + d
            inside = (x < self.n) & (y < self.n)
            same = inside.copy()
            same[inside] = self.text[x[inside]] == self.text[y[inside]]
            live = live[same]
            if not len(live):
                break
            out[live] = d + 1
        return out

    def _pass(self, seeds: dict[int, Iterator], to_s: bool, known: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
        """Scan all symbols, up for L suffixes or down for S suffixes; yields what it takes in order of the scan.

        seeds: for each symbol, arrays of (position, common prefix with the one before) that follow the queue's own.
        """
        queues = [DiskQueue(self.folder, self.budget) for _ in range(256)]
        pending = np.zeros(256, np.int16)
        if not to_s:  # the last suffix is an L suffix that no other puts
            queues[self.text[-1]].put(np.array([self.n - 1]), np.zeros(1, np.uint8))
        for c in range(255, -1, -1) if to_s else range(256):
            pending[:] = 0
            last = -1
            for own, parts in ((True, queues[c].take()), (False, seeds.get(c, ()))):
                begin = True
                for pos, lcp in parts:
                    for i in range(0, len(pos), CHUNK):
                        p, l = pos[i : i + CHUNK], lcp[i : i + CHUNK]
                        if begin and not own and last >= 0:
                            l = l.copy()
                            l[0] = 1 if known is None else self.common(np.array([last]), p[:1])[0]
                        begin, last = False, int(p[-1])
                        yield c, p, l, own
                        self._put(queues, pending, p, l, to_s)

    def _put(self, queues: list[DiskQueue], pending: np.ndarray, pos: np.ndarray, lcp: np.ndarray, to_s: bool) -> None:
        before = pos - 1
        good = np.flatnonzero((before >= 0) & (self.is_s[before] == to_s))
        symbols = self.text[before[good]]
        order = np.argsort(symbols, kind="stable")
        cut = np.flatnonzero(np.diff(symbols[order])) + 1
        low = int(lcp.min())
        old = pending.copy()
        np.minimum(pending, low, out=pending)
        for at in np.split(order, cut) if len(order) else []:
            c, idx = int(symbols[at[0]]), good[at]
            m = np.minimum.reduceat(lcp[: idx[-1] + 1], np.concatenate([[0], idx[:-1] + 1])).astype(np.int16)
            m[0] = min(m[0], old[c])
            new = np.minimum(m + 1, self.depth).astype(np.uint8)
            if not queues[c].used:
                new[0] = 0
            queues[c].put(before[idx], new)
            rest = lcp[idx[-1] + 1 :]
            pending[c] = rest.min() if len(rest) else self.depth + 1

    def _seeds(self, pos: np.ndarray, lcp: np.ndarray) -> dict[int, list]:
        """Sorted (position, common prefix) by first symbol."""
        symbols = self.text[pos]
        cut = np.flatnonzero(np.diff(symbols)) + 1
        out = {}
        for p, l in zip(np.split(pos, cut), np.split(lcp, cut)):
            l = l.copy()
            l[0] = 0
            out[int(self.text[p[0]])] = [(p, l)]
        return out

    def _induce(self, pos: np.ndarray, lcp: np.ndarray, known: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """From sorted LMS suffixes, all suffixes in descending order, each with the prefix shared with the one before."""
        mark = np.zeros(0) if known else None
        kept = {c: DiskQueue(self.folder, self.budget) for c in range(256)}
        for c, p, l, own in self._pass(self._seeds(pos, lcp) if len(pos) else {}, False, mark):
            if own:
                kept[c].put(p, l)
        seeds = {c: self._backwards(queue) for c, queue in kept.items() if queue.used}
        for _, p, l, _ in self._pass(seeds, True, mark):
            yield p, l

    def _backwards(self, queue: DiskQueue) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        follows = 0  # common prefix of the first suffix of the part above with the last of this part
        for p, l in queue.take_back():
            back = np.concatenate([[follows], l[:0:-1]]).astype(np.uint8)
            yield p[::-1], back
            follows = l[0]

    def order(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All suffixes in descending order, in arrays of positions and common prefixes with the one before."""
        lms = self.lms
        if len(lms) > 1:
            lms, lcp = self._sorted_lms()
        else:
            lcp = np.zeros(len(lms), np.uint8)
        yield from self._induce(lms, lcp, True)

    def _sorted_lms(self) -> tuple[np.ndarray, np.ndarray]:
        """LMS substrings are sorted by induction and named; the string of names is then sorted by doubling."""
        lms = self.lms
        rank_of = np.full(self.n, -1, np.int64)
        rank_of[lms] = np.arange(len(lms))
        size = np.diff(np.append(lms, self.n - 1)) + 1
        names = np.empty(len(lms), np.int64)
        by_symbol = lms[np.argsort(self.text[lms], kind="stable")]
        name, low, before = 0, self.depth + 1, -1
        for p, l in self._induce(by_symbol, np.ones(len(lms), np.uint8), False):
            hit = np.flatnonzero(rank_of[p] >= 0)
            if not len(hit):
                low = min(low, int(l.min()))
                continue
            m = np.minimum.reduceat(l[: hit[-1] + 1], np.concatenate([[0], hit[:-1] + 1])).astype(np.int64)
            m[0] = min(m[0], low)
            k = rank_of[p[hit]]
            earlier = np.concatenate([[before], k[:-1]])
            same = (m >= np.minimum(size[k], self.depth)) & (earlier >= 0) & (size[k] == size[earlier])
            names[k] = name - np.cumsum(~same)
            name, before = int(names[k[-1]]), int(k[-1])
            rest = l[hit[-1] + 1 :]
            low = int(rest.min()) if len(rest) else self.depth + 1
        names -= names.min() - 1
        span = 1
        while True:
            follow = np.zeros(len(names), np.int64)
            follow[:-span or None] = names[span:] if span < len(names) else 0
            pair = names * (int(names.max()) + 1) + follow
            order = np.argsort(pair, kind="stable")
            steps = np.concatenate([[1], (np.diff(pair[order]) != 0).astype(np.int64)])
            new = np.empty_like(names)
            new[order] = np.cumsum(steps)
            names, span = new, 2 * span
            if steps.all() or 2 * span > 2 * self.depth or span >= len(names):
                break
        pos = lms[order]
        return pos, np.concatenate([[0], self.common(pos[:-1], pos[1:])]).astype(np.uint8)
