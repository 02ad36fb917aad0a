"""Suffix order and common-prefix values by induced sorting with queues on disk.

The suffixes at S* positions (where a rising stretch begins after a falling one) are put in
order first: their substrings are named by one induction, and the string of names is ordered
recursively, or by prefix doubling once it fits in memory.  A second induction then carries
tuples (position, inducer) through one queue per symbol, first for the falling suffixes from
the smallest symbol up, then for the rising ones from the largest down.  What a queue receives
is already in the order of its inducers, so the queues together are a priority queue; each
spills to a file once the buffers exceed the memory given.  A tuple's common prefix with the one
before it is one more than the least common prefix between their inducers.

Symbol 0 ends a block; every 0 differs from every other.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np

#: Tuples taken from a queue at once.
CHUNK = 1 << 20


class Workspace:
    """Arrays and queues that go to files in a folder of this task beyond ``memory`` bytes."""

    def __init__(self, memory: int) -> None:
        self.memory = memory
        self._folder = tempfile.TemporaryDirectory(prefix="induced-")
        self._files = 0

    def path(self) -> Path:
        self._files += 1
        return Path(self._folder.name) / str(self._files)

    def array(self, n: int, kind: type) -> np.ndarray:
        if n * np.dtype(kind).itemsize > self.memory:
            return np.memmap(self.path(), kind, "w+", shape=(n,))
        return np.empty(n, kind)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_: object) -> None:
        self._folder.cleanup()


class Queues:
    """First-in first-out queues of (position, inducer), one per symbol."""

    def __init__(self, space: Workspace) -> None:
        self.space, self.held = space, 0
        self.buffers: dict[int, list[np.ndarray]] = {}
        self.files: dict[int, list] = {}  # symbol -> [path, tuples read, tuples written]

    def put(self, symbols: np.ndarray, rows: np.ndarray) -> None:
        """Append each row to its symbol's queue, in the order given."""
        if not len(rows):
            return
        order = np.argsort(symbols, kind="stable")
        symbols, rows = symbols[order], rows[order]
        edges = np.r_[0, np.flatnonzero(np.diff(symbols)) + 1, len(symbols)]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            self.buffers.setdefault(int(symbols[a]), []).append(rows[a:b])
        self.held += rows.nbytes
        if self.held > self.space.memory:
            self.spill()

    def spill(self) -> None:
        for symbol, parts in self.buffers.items():
            entry = self.files.setdefault(symbol, [self.space.path(), 0, 0])
            with entry[0].open("ab") as out:
                for part in parts:
                    out.write(part.tobytes())
                    entry[2] += len(part)
        self.buffers, self.held = {}, 0

    def take(self, symbol: int) -> np.ndarray | None:
        entry = self.files.get(symbol)
        if entry and entry[1] < entry[2]:
            n = min(CHUNK, entry[2] - entry[1])
            rows = np.fromfile(entry[0], np.int64, 2 * n, offset=16 * entry[1]).reshape(-1, 2)
            entry[1] += n
            if entry[1] == entry[2]:
                entry[0].unlink()
                del self.files[symbol]
            return rows
        parts = self.buffers.pop(symbol, None)
        if parts is None:
            return None
        rows = parts[0] if len(parts) == 1 else np.concatenate(parts)
        self.held -= rows.nbytes
        return rows

    def symbols(self) -> set[int]:
        return set(self.buffers) | set(self.files)


class _Names:
    """Marks tuples with classes: equal symbols whose inducers have equal classes."""

    def __init__(self) -> None:
        self.n, self.last = 0, None

    def bucket(self) -> None:
        self.last = None

    def induced(self, inducers: np.ndarray) -> np.ndarray:
        new = np.r_[self.last is None or inducers[0] != self.last, np.diff(inducers) != 0]
        marks = self.n + np.cumsum(new)
        self.n, self.last = int(marks[-1]), int(inducers[-1])
        return marks

    def given(self, values: np.ndarray) -> np.ndarray:
        """Marks for seeds: ``values`` tells which follow a different one."""
        marks = self.n + np.cumsum(values)
        self.n, self.last = int(marks[-1]), None
        return marks


class _Prefixes:
    """Marks tuples with their number in order and keeps their common prefix with the one before."""

    def __init__(self, n: int, space: Workspace, limit: int) -> None:
        self.values, self.limit = space.array(n, np.int32), limit
        self.n, self.last = 0, None

    def bucket(self) -> None:
        self.last = None

    def induced(self, inducers: np.ndarray) -> np.ndarray:
        if self.last is None:
            values = np.zeros(len(inducers), np.int32)
            if len(inducers) > 1:
                values[1:] = 1 + np.minimum.reduceat(self.values[: inducers[-1] + 1], inducers[:-1] + 1)
        else:
            starts = np.r_[self.last, inducers[:-1]] + 1
            values = 1 + np.minimum.reduceat(self.values[: inducers[-1] + 1], starts)
        self.last = int(inducers[-1])
        return self.given(np.minimum(values, self.limit))

    def given(self, values: np.ndarray) -> np.ndarray:
        marks = np.arange(self.n, self.n + len(values))
        self.values[self.n : self.n + len(values)] = values
        self.n += len(values)
        return marks


def falling(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is larger than the next one (the last one is not)."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int64)))
    at = np.where(step != 0, np.arange(n - 1), n)  # the next change decides
    following = np.minimum.accumulate(at[::-1])[::-1]
    out = np.zeros(n, bool)
    known = following < n
    out[:-1][known] = step[following[known]] < 0
    return out


def _induce(text: np.ndarray, seeds: np.ndarray, seed_values: np.ndarray, up, down, space: Workspace,
            run: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Both passes; yields (positions, marks) of all suffixes from the largest to the smallest.

    ``up`` and ``down`` mark the tuples of the two passes; ``run`` is the length of the run
    of equal symbols at each position, where common prefixes are wanted.
    """
    seed_symbols = text[seeds]
    starts = dict(zip(*(x.tolist() for x in np.unique(seed_symbols, return_index=True)), strict=True))
    ends = np.searchsorted(seed_symbols, list(starts), "right").tolist()
    seed_range = {s: (a, b) for (s, a), b in zip(starts.items(), ends, strict=True)}

    queues, fallen = Queues(space), {}
    symbols = set(np.unique(text).tolist())

    def lower(positions: np.ndarray, marks: np.ndarray, symbol: int, strict: bool, falls: bool) -> None:
        ok = positions > 0
        before = positions[ok] - 1
        mine, own = text[before], marks[ok]
        good = (mine > symbol if strict else mine >= symbol) if falls else (mine < symbol if strict else mine <= symbol)
        queues.put(mine[good], np.stack([before[good], own[good]], 1))

    for symbol in sorted(symbols):
        up.bucket()
        kept, last = [], None
        while (rows := queues.take(symbol)) is not None:
            marks = up.induced(rows[:, 1])
            values = up.values[marks] if run is not None else None
            kept.append((rows[:, 0], values))
            lower(rows[:, 0], marks, symbol, False, True)
            last = int(rows[-1, 0])
        if kept:
            fallen[symbol] = kept
        if symbol in seed_range:
            a, b = seed_range[symbol]
            values = seed_values[a:b].copy()
            if run is not None:
                values[0] = 0 if last is None else min(run[last], run[seeds[a]], up.limit)
            lower(seeds[a:b], up.given(values), symbol, True, True)
    queues = Queues(space)
    for symbol in sorted(symbols, reverse=True):
        down.bucket()
        last = None
        while (rows := queues.take(symbol)) is not None:
            marks = down.induced(rows[:, 1])
            lower(rows[:, 0], marks, symbol, False, False)
            yield rows[:, 0], marks
            last = int(rows[-1, 0])
        kept = fallen.pop(symbol, [])
        if kept:
            positions = np.concatenate([k[0] for k in kept])[::-1]
            if run is not None:
                common = np.concatenate([k[1] for k in kept])[::-1]
                values = np.r_[0 if last is None else min(run[last], run[positions[0]], up.limit), common[:-1]].astype(np.int32)
            else:
                values = np.ones(len(positions), np.int64)  # replaced below: classes of the first pass
            marks = down.given(values)
            lower(positions, marks, symbol, True, False)
            yield positions, marks


def _doubled(names: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes of a string of names, by prefix doubling."""
    rank, step, n = names.astype(np.int64), 1, len(names)
    while True:
        second = np.r_[rank[step:] + 1, np.zeros(min(step, n), np.int64)][:n]
        key = rank * (int(rank.max()) + 2) + second
        _, rank = np.unique(key, return_inverse=True)
        step *= 2
        if int(rank.max()) == n - 1 or step > n:
            return rank


class _Classes(_Names):
    """Classes of the second naming pass: falling suffixes bring those of the first pass."""

    def given(self, values: np.ndarray) -> np.ndarray:
        new = np.r_[True, np.diff(values) != 0]
        marks = self.n + np.cumsum(new)
        self.n, self.last = int(marks[-1]), None
        return marks


def _seed_names(text: np.ndarray, seeds: np.ndarray, space: Workspace) -> np.ndarray:
    """A name for each S* position, in the order of their substrings; equal ones share a name."""
    order = np.argsort(text[seeds], kind="stable")
    sorted_seeds = seeds[order]
    symbols = text[sorted_seeds]
    names = np.zeros(len(text), np.int64)
    is_seed = np.zeros(len(text), bool)
    is_seed[seeds] = True
    new = np.r_[True, (np.diff(symbols) != 0)] | (symbols == 0)
    for positions, marks in _named(text, sorted_seeds, new, space):
        mine = is_seed[positions]
        names[positions[mine]] = marks[mine]
    found = names[seeds]
    top = int(found.max(initial=0)) + 1
    found = top - found  # the pass went down
    ends = text[seeds] == 0
    found[ends] = np.arange(int(ends.sum())) - int(ends.sum())
    return np.unique(found, return_inverse=True)[1]


def _named(text: np.ndarray, seeds: np.ndarray, new: np.ndarray, space: Workspace) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The induction of classes; like ``_induce``, with the classes of falling suffixes kept."""
    up, down = _Names(), _Classes()
    queues, fallen = Queues(space), {}
    symbols = sorted(set(np.unique(text).tolist()))
    seed_symbols = text[seeds]

    def pass_on(positions: np.ndarray, marks: np.ndarray, good: np.ndarray) -> None:
        queues.put(text[positions[good] - 1], np.stack([positions[good] - 1, marks[good]], 1))

    for symbol in symbols:
        up.bucket()
        kept = []
        while (rows := queues.take(symbol)) is not None:
            marks = up.induced(rows[:, 1])
            kept.append((rows[:, 0], marks))
            pass_on(rows[:, 0], marks, (rows[:, 0] > 0) & (text[rows[:, 0] - 1] >= symbol))
        if kept:
            fallen[symbol] = kept
        a, b = np.searchsorted(seed_symbols, [symbol, symbol + 1])
        if b > a:
            marks = up.given(new[a:b])
            pass_on(seeds[a:b], marks, (seeds[a:b] > 0) & (text[seeds[a:b] - 1] > symbol))
    queues = Queues(space)
    for symbol in reversed(symbols):
        down.bucket()
        while (rows := queues.take(symbol)) is not None:
            marks = down.induced(rows[:, 1])
            pass_on(rows[:, 0], marks, (rows[:, 0] > 0) & (text[rows[:, 0] - 1] <= symbol))
            yield rows[:, 0], marks
        kept = fallen.pop(symbol, [])
        if kept:
            positions, classes = (np.concatenate([k[i] for k in kept])[::-1] for i in (0, 1))
            marks = down.given(classes)
            pass_on(positions, marks, (positions > 0) & (text[positions - 1] < symbol))


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix lengths, up to ``limit``, of pairs of suffixes; a 0 ends both."""
    out = np.zeros(len(a), np.int32)
    active, wide = np.arange(len(a)), 16
    padded = np.r_[text, np.zeros(wide, text.dtype)]
    reach = np.arange(wide)
    for at in range(0, limit, wide):
        if not len(active):
            break
        x = padded[np.minimum(a[active] + at, len(text))[:, None] + reach]
        y = padded[np.minimum(b[active] + at, len(text))[:, None] + reach]
        same = (x == y) & (x != 0)
        length = np.where(same.all(1), wide, same.argmin(1))
        out[active] += length.astype(np.int32)
        active = active[length == wide]
    return np.minimum(out, limit)


def suffix_order(text: np.ndarray, space: Workspace, in_memory: int, limit: int | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Suffix order of ``text``, and common prefixes with the suffix before (up to ``limit``, if given).

    ``text`` ends with 0.  Strings of names longer than ``in_memory`` are ordered recursively.
    """
    n = len(text)
    falls = falling(text)
    seeds = np.flatnonzero(~falls & np.r_[False, falls[:-1]])
    if not len(seeds):
        seeds = np.array([n - 1])
    names = _seed_names(text, seeds, space)
    if int(names.max()) == len(names) - 1:
        rank = names
    elif len(names) <= in_memory:
        rank = _doubled(names)
    else:
        order, _ = suffix_order(np.r_[names + 1, 0], space, in_memory)
        rank = np.empty(len(names), np.int64)
        rank[order[1:]] = np.arange(len(names))
    sorted_seeds = np.empty(len(seeds), np.int64)
    sorted_seeds[rank] = seeds
    order = space.array(n, np.int64)
    at = n
    if limit is None:
        for positions, _ in _induce(text, sorted_seeds, np.ones(len(seeds), np.int64), _Names(), _Names(), space, None):
            order[at - len(positions) : at] = positions[::-1]
            at -= len(positions)
        return _with_ends(text, order, at), None
    change = np.r_[np.flatnonzero(np.diff(text)) + 1, n]
    run = change[np.searchsorted(change, np.arange(n), "right")] - np.arange(n)
    values = np.r_[0, _common(text, sorted_seeds[:-1], sorted_seeds[1:], limit)].astype(np.int32)
    up, down = _Prefixes(n + 1, space, limit), _Prefixes(n + 1, space, limit)
    common = space.array(n, np.int32)
    common[:] = 0
    for positions, marks in _induce(text, sorted_seeds, values, up, down, space, run):
        k = len(positions)
        order[at - k : at] = positions[::-1]
        if at < n:
            common[at] = down.values[marks[0]]
        common[at - k + 1 : at] = down.values[marks[1:]][::-1]
        at -= k
    return _with_ends(text, order, at), common


def _with_ends(text: np.ndarray, order: np.ndarray, at: int) -> np.ndarray:
    """Block ends have no inducer of their own order: they stand first, by position."""
    ends = np.flatnonzero(text == 0)
    order[: len(ends)] = ends
    return order
