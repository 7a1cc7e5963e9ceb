"""External induced sorting of suffixes with common-prefix values, in blocks of numpy; whatever exceeds a bound lies on disk."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np

#: Entries of a list or queue that stay in memory; the rest is on disk.
MEMORY = 1 << 20
#: Entries of a bucket of several symbols; a symbol with more has a bucket of its own.
BUCKET = 1 << 15
#: Entries that are induced from at once: from a bucket of several symbols, and of one.
FEW, MANY = 1 << 13, 1 << 16
#: Bits for a common prefix beside a place.
BITS = 7
_LOW = (1 << BITS) - 1
_NONE = np.iinfo(np.int64).max


def stored(n: int, kind: type, memory: int) -> np.ndarray:
    """An array of n zeros, mapped to a file if it is larger than `memory`."""
    if n <= memory:
        return np.zeros(n, kind)
    f = tempfile.TemporaryFile()
    f.truncate(n * np.dtype(kind).itemsize)
    return np.memmap(f, kind, "r+", shape=(n,))


class Tape:
    """Rows of `width` integers, appended and read in blocks, forward or backward; beyond `memory` rows they go to disk."""

    def __init__(self, width: int, memory: int):
        self.width, self.memory = width, memory
        self.held: list[np.ndarray] = []
        self.n_held = self.n_disk = 0
        self.file = None

    def __len__(self) -> int:
        return self.n_held + self.n_disk

    def append(self, rows: np.ndarray) -> None:
        if len(rows):
            self.held.append(rows)
            self.n_held += len(rows)
        if self.n_held > self.memory:
            if self.file is None:
                self.file = tempfile.TemporaryFile(buffering=0)
            self.file.seek(0, 2)
            np.concatenate(self.held).astype(np.int64).tofile(self.file)
            self.n_disk += self.n_held
            self.held, self.n_held = [], 0

    def _disk(self, at: int, n: int) -> np.ndarray:
        self.file.seek(8 * self.width * at)
        return np.fromfile(self.file, np.int64, n * self.width).reshape(-1, self.width)

    def forward(self, block: int = MANY) -> Iterator[np.ndarray]:
        for at in range(0, self.n_disk, block):
            yield self._disk(at, min(block, self.n_disk - at))
        yield from self.held

    def backward(self, block: int = MANY) -> Iterator[np.ndarray]:
        for x in reversed(self.held):
            yield x[::-1]
        for end in range(self.n_disk, 0, -block):
            at = max(0, end - block)
            yield self._disk(at, end - at)[::-1]


class BucketQueue:
    """A priority queue over buckets of symbols: blocks of entries come out of a bucket in the order they went in. Beyond `memory` entries all go to disk."""

    def __init__(self, buckets: int, memory: int):
        self.memory, self.held, self.file = memory, 0, None
        self.parts: list[list[np.ndarray]] = [[] for _ in range(buckets)]
        self.disk: list[list[tuple[int, int]]] = [[] for _ in range(buckets)]

    def push(self, bucket: int, rows: np.ndarray) -> None:
        self.parts[bucket].append(rows)
        self.held += len(rows)
        if self.held > self.memory:
            if self.file is None:
                self.file = tempfile.TemporaryFile(buffering=0)
            at = self.file.seek(0, 2)
            for b, parts in enumerate(self.parts):
                if parts:
                    rows = np.concatenate(parts)
                    rows.tofile(self.file)
                    for i in range(0, len(rows), MANY):
                        self.disk[b].append((at + 16 * i, min(MANY, len(rows) - i)))
                    at += 16 * len(rows)
                    self.parts[b] = []
            self.held = 0

    def more(self, bucket: int) -> bool:
        return bool(self.disk[bucket] or self.parts[bucket])

    def block(self, bucket: int) -> np.ndarray:
        """The bucket's next entries, those pushed meanwhile included; none if it is empty."""
        if self.disk[bucket]:
            at, n = self.disk[bucket].pop(0)
            self.file.seek(at)
            return np.fromfile(self.file, np.int64, 2 * n).reshape(-1, 2)
        if self.parts[bucket]:
            rows = np.concatenate(self.parts[bucket])
            self.parts[bucket] = []
            self.held -= len(rows)
            return rows
        return _EMPTY

    def whole(self, bucket: int) -> np.ndarray:
        """All entries of a bucket by symbol, equal symbols in the order they went in."""
        rows = [_EMPTY]
        while self.more(bucket):
            rows.append(self.block(bucket))
        return by_first(np.concatenate(rows))


_EMPTY = np.zeros((0, 2), np.int64)


def by_first(rows: np.ndarray) -> np.ndarray:
    return rows[np.argsort(rows[:, 0], kind="stable")]


def sorted_rows(blocks: Iterable[np.ndarray], keys: int, memory: int) -> Iterator[np.ndarray]:
    """Rows in the order of their first `keys` columns: runs sorted in memory, spilled, and merged block by block."""
    runs: list[Tape] = []
    part, n, width = [], 0, 1

    def spill() -> None:
        nonlocal part, n
        rows = np.concatenate(part)
        runs.append(Tape(rows.shape[1], 0))
        runs[-1].append(rows[np.lexsort(rows[:, :keys].T[::-1])])
        part, n = [], 0

    for rows in blocks:
        width = rows.shape[1]
        for i in range(0, len(rows), memory):
            part.append(rows[i : i + memory])
            n += len(part[-1])
            if n > memory:
                spill()
    if not runs:
        rows = np.concatenate(part) if part else np.zeros((0, width), np.int64)
        yield rows[np.lexsort(rows[:, :keys].T[::-1])]
        return
    if part:
        spill()
    yield from merged([r.forward(max(16, memory // len(runs))) for r in runs], keys)


def merged(streams: list[Iterator[np.ndarray]], keys: int) -> Iterator[np.ndarray]:
    """Rows of sorted streams in order: from the blocks at hand all rows up to the least of the blocks' last rows."""
    heads: list[np.ndarray | None] = [next(s, None) for s in streams]
    while True:
        live = [k for k, h in enumerate(heads) if h is not None]
        if not live:
            return
        if len(live) == 1:
            k = live[0]
            yield heads[k]
            yield from streams[k]
            return
        bound = min(tuple(heads[k][-1, :keys].tolist()) for k in live)
        out = []
        for k in live:
            low, high = 0, len(heads[k])
            for c in range(keys):  # rows before high are not over the bound
                column = heads[k][low:high, c]
                low, high = low + int(np.searchsorted(column, bound[c], "left")), low + int(np.searchsorted(column, bound[c], "right"))
            out.append(heads[k][:high])
            heads[k] = heads[k][high:] if high < len(heads[k]) else next(streams[k], None)
        rows = np.concatenate(out)
        yield rows[np.lexsort(rows[:, :keys].T[::-1])]


class Stream:
    """Rows of an iterator of blocks, looked at before they are taken."""

    def __init__(self, blocks: Iterator[np.ndarray]):
        self.blocks, self.rows = blocks, _EMPTY

    def peek(self, n: int, below: int) -> tuple[np.ndarray, bool]:
        """Up to n rows whose first column is under `below`, and whether such rows follow."""
        while len(self.rows) <= n and self.blocks is not None:
            block = next(self.blocks, None)
            if block is None:
                self.blocks = None
            elif len(block):
                self.rows = np.concatenate([self.rows, block]) if len(self.rows) else block
        fit = int(np.searchsorted(self.rows[: n + 1, 0], below))
        return self.rows[: min(fit, n)], fit > n

    def take(self, n: int) -> None:
        self.rows = self.rows[n:]


class Minima:
    """Least common prefix since an earlier entry; values are at most `cap`, so as many numbers hold all the history."""

    def __init__(self):
        self.count = 0
        self.index, self.value = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def since(self, before: np.ndarray, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Least value of the entries after `before` up to `at`; values are those of the entries from self.count on."""
        low, lately = np.minimum.accumulate(values), before >= self.count
        padded = np.append(self.value, _NONE)
        out = np.minimum(padded[np.searchsorted(self.index, before, "right")], low[at - self.count])
        if lately.any():
            x, y = before[lately] - self.count + 1, at[lately] - self.count
            width = y - x + 1
            steps = np.frexp(width.astype(np.float64))[1] - 1
            table = [values]
            for k in range(int(steps.max())):
                table.append(np.minimum(table[-1][: -(1 << k)], table[-1][1 << k :]))
            best = np.empty(len(x), np.int64)
            for k in np.unique(steps):
                own = steps == k
                best[own] = np.minimum(table[k][x[own]], table[k][y[own] - (1 << int(k)) + 1])
            out[lately] = best
        return out

    def extend(self, values: np.ndarray) -> None:
        low = np.minimum.accumulate(values[::-1])[::-1]
        new = np.flatnonzero(np.append(low[:-1] < low[1:], True))
        old = np.searchsorted(self.value, low[0])
        self.index, self.value = np.append(self.index[:old], self.count + new), np.append(self.value[:old], low[new])
        self.count += len(values)


def _bounds(counts: np.ndarray) -> np.ndarray:
    """First symbols of the buckets: symbols with BUCKET entries or so between them, and each more frequent one alone."""
    before, starts, heavy = 0, [np.zeros(1, np.int64)], []
    for i in range(0, len(counts), MANY):
        own = np.asarray(counts[i : i + MANY])
        sums = before + np.cumsum(own) - own
        place = sums // BUCKET
        starts.append(i + np.flatnonzero(np.diff(place, prepend=place[0])))
        many = i + np.flatnonzero(own > BUCKET)
        heavy += [many, many + 1]
        before += int(own.sum())
    out = np.unique(np.concatenate([*starts, *heavy]))
    return out[out < len(counts)]


class Sorter:
    """Sorted suffixes of a text of symbols whose last is the only smallest one, with the symbols each shares with the one before, up to `cap`.

    As in induced sorting, the leftmost S suffixes are sorted by the names of what
    reaches from each to the next, recursively if names repeat; then L suffixes are
    induced from them in ascending and S suffixes in descending order. The queue
    carries suffix tuples of symbol, place and the prefix common with the entry
    before of the same symbol: one more than the least among the parents in
    between. Common prefixes of the leftmost S suffixes come from the recursion, as
    numbers of names that agree; only the first names that differ are compared.
    Where L and S suffixes of a symbol meet, they share their shorter run of it.

    Entries are taken a block at a time, with all that they induce within the
    block's range. Text and names may be mapped files; queues, lists and runs of sorts beyond `memory` entries
    are on disk; what else is held is a few blocks and the first symbols of buckets.
    """

    def __init__(self, text: np.ndarray, cap: int, memory: int = MEMORY):
        if not 1 <= cap <= _LOW:
            raise ValueError(f"cap must be from 1 to {_LOW}")
        self.t, self.cap, self.memory, self.n = text, cap, memory, len(text)
        self.top = int(max(text[i : i + MANY].max() for i in range(0, self.n, MANY)))
        self.counts = stored(self.top + 1, np.int64, memory)
        for i in range(0, self.n, MANY):
            symbols, n = np.unique(text[i : i + MANY], return_counts=True)
            self.counts[symbols.astype(np.int64)] += n

    def _leftmost(self) -> np.ndarray:
        """Places of the leftmost S suffixes, ascending, found from the end block by block."""
        t, found = self.t, Tape(1, self.memory)
        end, small = self.n - 1, True  # the type of the suffix at `end`
        while end > 0:
            a = max(0, end - MANY)
            up = np.sign(np.diff(t[a : end + 1].astype(np.int64)))
            near = np.where(up != 0, np.arange(len(up)), len(up))
            near = np.minimum.accumulate(near[::-1])[::-1]  # equal symbols are as the first unequal pair behind them
            s = np.append(np.where(near < len(up), up[np.minimum(near, len(up) - 1)] > 0, small), small)
            found.append(a + 1 + np.flatnonzero(s[1:] & ~s[:-1])[::-1].reshape(-1, 1))
            end, small = a, bool(s[0])
        places, at = stored(len(found), np.int64, self.memory), 0
        for x in found.backward():
            places[at : at + len(x)] = x[:, 0]
            at += len(x)
        return places

    def _names(self, places: np.ndarray) -> tuple[np.ndarray, bool]:
        """Ranks of the substrings that reach from each place to the next one, equal for equal substrings, and whether some are.

        Sorted by as many symbols as fit a number, then those that tie by the next ones, and so on.
        """
        m, last, width = len(places), self.n - 1, (self.top + 1).bit_length()
        fit, pad = 63 // width, (1 << width) - 1  # a substring that another one begins with comes after it: there the other goes on with an L symbol

        def keyed(ranks: np.ndarray, own: np.ndarray, turn: int) -> np.ndarray:
            at = places[own] + turn * fit
            end = places[np.minimum(own + 1, m - 1)]
            key = np.zeros(len(own), np.int64)
            for i in range(fit):
                key = key << width | np.where(at + i <= end, self.t[np.minimum(at + i, last)].astype(np.int64), pad)
            return np.stack([ranks, key, own, end - at - fit], axis=1)

        names, repeated, turn = stored(m, np.int64, self.memory), False, 0
        todo: Iterable[np.ndarray] = (np.stack([np.zeros(min(MANY, m - i), np.int64), np.arange(i, min(i + MANY, m))], axis=1) for i in range(0, m, MANY))
        while True:
            ties = Tape(2, self.memory)
            pos = start = first = 0  # of the row, its substring and its former rank
            before = held = None
            for rows in _held_back(sorted_rows((keyed(x[:, 0], x[:, 1], turn) for x in todo), 2, self.memory)):
                rows, after = rows
                old, new = np.empty(len(rows), bool), np.empty(len(rows), bool)
                old[1:] = rows[1:, 0] != rows[:-1, 0]
                new[1:] = old[1:] | (rows[1:, 1] != rows[:-1, 1])
                old[0] = before is None or before[0] != rows[0, 0]
                new[0] = old[0] or before[1] != rows[0, 1]
                here = pos + np.arange(len(rows))
                starts = np.maximum.accumulate(np.where(new, here, start))
                firsts = np.maximum.accumulate(np.where(old, here, first))
                rank = rows[:, 0] + starts - firsts
                names[rows[:, 2]] = rank
                tied = ~new
                tied[:-1] |= ~new[1:]
                tied[-1] |= after is not None and after[0] == rows[-1, 0] and after[1] == rows[-1, 1]
                longer = tied & (rows[:, 3] >= -1)  # one that ends with the number may tie with one that goes on
                repeated |= bool((tied & ~longer).any())
                ties.append(np.stack([rank[longer], rows[longer, 2]], axis=1))
                pos, start, first, before = pos + len(rows), int(starts[-1]), int(firsts[-1]), rows[-1]
            if not len(ties):
                return names, repeated
            todo, turn = ties.forward(), turn + 1

    def _seeds(self) -> Iterator[np.ndarray]:
        """(2 symbol + 1, place and common prefix) of the leftmost S suffixes in order."""
        places = self._leftmost()
        m = len(places)
        names, repeated = self._names(places)
        if repeated:
            ordered = Sorter(names, max(1, -(-self.cap // 2)), self.memory).order()  # a name stands for two symbols at least
        else:
            order = stored(m, np.int64, self.memory)
            for i in range(0, m, MANY):
                order[names[i : i + MANY]] = np.arange(i, min(i + MANY, m))
            ordered = ((order[i : i + MANY], np.zeros(min(MANY, m - i), np.int64)) for i in range(0, m, MANY))
        before = -1
        for own, agreed in ordered:
            own = np.asarray(own)
            others = np.append(before, own[:-1])
            x = places[own]
            y = places[np.maximum(others, 0)]
            done = places[np.minimum(own + agreed, m - 1)] - x
            common = np.minimum(done, self.cap)
            common += self._compared(x + common, y + common, self.cap - common)
            common[others < 0] = 0
            yield np.stack([2 * self.t[x].astype(np.int64) + 1, x << BITS | common], axis=1)
            before = own[-1]

    def _compared(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Symbols that two suffixes share at the beginning, up to `most`."""
        out = np.zeros(len(x), np.int64)
        live = np.flatnonzero(most > 0)
        while len(live):
            a, b = x[live] + out[live], y[live] + out[live]
            same = (a < self.n) & (b < self.n) & (a != b)
            same &= self.t[np.minimum(a, self.n - 1)] == self.t[np.minimum(b, self.n - 1)]
            live = live[same]
            out[live] += 1
            live = live[out[live] < most[live]]
        return out

    def _runs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The shorter of the runs of one symbol with which two suffixes begin, up to cap."""
        out, live, k = np.ones(len(x), np.int64), np.arange(len(x)), 1
        while len(live) and k < self.cap:
            a, b = x[live] + k, y[live] + k
            same = (a < self.n) & (b < self.n)
            c = self.t[x[live]]
            same &= (self.t[np.minimum(a, self.n - 1)] == c) & (self.t[np.minimum(b, self.n - 1)] == c)
            live = live[same]
            k += 1
            out[live] = k
        return out

    def _induced(self, down: bool, seeds: Iterator[np.ndarray]) -> Tape:
        """(symbol, place and common prefix) of all suffixes induced from the seeds, in ascending order, or, with symbols counted from the top, in descending."""
        t, top, cap = self.t, self.top, self.cap
        symbols: Callable = (lambda p: top - t[p].astype(np.int64)) if down else (lambda p: t[p].astype(np.int64))
        starts = _bounds(self.counts[::-1] if down else self.counts)
        ends = np.append(starts[1:], top + 1)
        queue, out, least, seed = BucketQueue(len(starts), self.memory), Tape(2, self.memory), Minima(), Stream(seeds)
        last = stored(top + 1, np.int64, self.memory)  # 1 + the number of the entry that last induced a symbol
        latest = (-1, -1, 0)  # symbol, place and kind of the entry before
        for b in range(len(starts)):
            alone = ends[b] - starts[b] == 1
            chunk = MANY if alone else FEW
            base, near = (_EMPTY if alone else queue.whole(b)), _EMPTY
            while True:
                if alone and not len(base):
                    base = queue.block(b)
                later, own_seeds = seed.peek(chunk, 2 * int(ends[b]))[::-1]
                sources = [base[:chunk], near[:chunk], own_seeds]
                follow = [len(base) > chunk or alone and queue.more(b), len(near) > chunk, later]
                if not any(map(len, sources)):
                    break
                open_ends = [(int(x[-1, 0]), k) for k, (x, f) in enumerate(zip(sources, follow)) if f and len(x)]
                if open_ends:
                    bound, which = min(open_ends)
                    sources = [x[: np.searchsorted(x[:, 0], bound, "right" if k <= which else "left")] for k, x in enumerate(sources)]
                for_now = [x for x in sources if len(x)]
                rows = for_now[0] if len(for_now) == 1 else by_first(np.concatenate(for_now))
                base, near = base[len(sources[0]) :], near[len(sources[1]) :]
                seed.take(len(sources[2]))
                limit = int(rows[-1, 0]) if any(follow) else 2 * int(ends[b])
                rows, child, valid, home = _with_children(rows, symbols, limit)
                symbol, kind, place, common = rows[:, 0] >> 1, rows[:, 0] & 1, rows[:, 1] >> BITS, rows[:, 1] & _LOW
                meets = np.flatnonzero(kind & ~np.append(latest[2], kind[:-1]) & 1)  # seeds that come after an induced entry
                if len(meets):
                    s, p = np.append(latest[0], symbol[:-1])[meets], np.append(latest[1], place[:-1])[meets]
                    alike = s == symbol[meets]
                    common[meets] = 0
                    common[meets[alike]] = self._runs(p[alike], place[meets[alike]])
                v = np.flatnonzero(valid)
                if len(v):
                    v = v[np.argsort(child[v], kind="stable")]
                    c, at = child[v], least.count + v
                    new = np.append(True, c[1:] != c[:-1])
                    before = np.append(0, at[:-1])
                    before[new] = last[c[new]] - 1
                    final = np.append(new[1:], True)
                    last[c[final]] = at[final] + 1
                    to = home[v]
                    here = np.flatnonzero(to >= 0)
                    common[to[here]] = cap
                    while True:  # common prefixes follow from those of entries before, so this ends
                        shared = np.where(before >= 0, np.minimum(cap, 1 + least.since(before, at, common)), 0)
                        if (common[to[here]] == shared[here]).all():
                            break
                        common[to[here]] = shared[here]
                    pushed = np.stack([2 * c, (place[v] - 1) << BITS | shared], axis=1)[to < 0]
                    to = np.searchsorted(starts, c[to < 0], "right") - 1
                    edges = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(to)] if len(to) else [0]
                    for i, j in zip(edges, edges[1:]):
                        if to[i] == b and not alone:
                            near = by_first(np.concatenate([near, pushed[i:j]]))
                        else:
                            queue.push(int(to[i]), pushed[i:j])
                made = np.flatnonzero(kind == 0)
                if len(made):
                    out.append(np.stack([symbol[made], place[made] << BITS | common[made]], axis=1))
                least.extend(common)
                latest = (int(symbol[-1]), int(place[-1]), int(kind[-1]))
        return out

    def order(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, symbols shared with the suffix before) of all suffixes in order, in blocks."""
        yield np.array([self.n - 1]), np.array([0])
        if self.n == 1:
            return
        up = self._induced(False, self._seeds())

        def descending() -> Iterator[np.ndarray]:
            above = 0
            for x in up.backward():
                common = x[:, 1] & _LOW
                yield np.stack([2 * (self.top - x[:, 0]) + 1, x[:, 1] - common | np.append(above, common[:-1])], axis=1)
                above = common[-1]

        down = self._induced(True, descending())

        def ascending() -> Iterator[np.ndarray]:
            below = 0
            for x in down.backward():
                common = x[:, 1] & _LOW
                yield np.stack([2 * (self.top - x[:, 0]) + 1, x[:, 1] - common | np.append(below, common[:-1])], axis=1)
                below = common[-1]

        latest = (-1, -1)  # key and place of the entry before
        for rows in merged([(x * [2, 1] for x in up.forward()), ascending()], 1):
            key, place, common = rows[:, 0], rows[:, 1] >> BITS, rows[:, 1] & _LOW
            earlier = np.append(latest[0], key[:-1])
            meets = np.flatnonzero((key & 1 == 1) & (earlier == key - 1))  # the first S suffix after an L suffix of its symbol
            if len(meets):
                common[meets] = self._runs(np.append(latest[1], place[:-1])[meets], place[meets])
            latest = (int(key[-1]), int(place[-1]))
            yield place, common


def _with_children(rows: np.ndarray, symbols: Callable, limit: int) -> tuple[np.ndarray, ...]:
    """Sorted rows with all that they induce below `limit`, in order; the symbol that each induces, whether it does, and the row of what it induced here, or -1.

    What is induced stands by its symbol, after entries of that symbol that were there, and among its like in the order of parents.
    """
    parts, parents, offset = [rows], [np.full(len(rows), -1)], 0
    children, valids = [], []
    while True:
        new = parts[-1]
        symbol, kind, place = new[:, 0] >> 1, new[:, 0] & 1, new[:, 1] >> BITS
        child = symbols(np.maximum(place - 1, 0))
        valid = (place > 0) & (child >= symbol + kind)
        children.append(child)
        valids.append(valid)
        inner = np.flatnonzero(valid & (2 * child < limit))
        if not len(inner):
            break
        parts.append(np.stack([2 * child[inner], (place[inner] - 1) << BITS], axis=1))
        parents.append(offset + inner)
        offset += len(new)
    if len(parts) == 1:
        return rows, child, valid, np.full(len(rows), -1)
    rows, parent, child, valid = map(np.concatenate, (parts, parents, children, valids))
    own, m = np.flatnonzero(parent >= 0), len(rows)
    key, rank, order = (rows[:, 0] - rows[:, 0].min()) * (m + 1), np.arange(m), None
    while True:  # an entry's place follows from that of a smaller one, so this ends
        tie = key.copy()
        tie[own] += rank[parent[own]] + 1
        again = np.argsort(tie, kind="stable")
        if order is not None and (again == order).all():
            break
        order = again
        rank = np.empty(m, np.int64)
        rank[order] = np.arange(m)
    home = np.full(m, -1)
    home[rank[parent[own]]] = rank[own]
    return rows[order], child[order], valid[order], home


def _held_back(blocks: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Blocks with the row that comes next."""
    held = None
    for x in blocks:
        if len(x):
            if held is not None:
                yield held, x[0]
            held = x
    if held is not None:
        yield held, None
