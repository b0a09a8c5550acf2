"""Suffixes of long texts in order, with common prefixes, by induced sorting in bounded memory.

A level of the sort names the pieces between two leftmost smaller symbols, orders the string of names by recursion if
names repeat, and induces the order of all suffixes from that of the pieces in two scans. Suffixes still to come wait
in queues on disk, each with the length it shares with the one before it; arrays that are read at random are files too.
"""

from __future__ import annotations

import os
import tempfile
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np

#: Records a queue holds in memory; suffixes handled at a time, of one symbol and of several rare ones.
QUEUE_RECORDS, STEP, NARROW_STEP = 1 << 20, 4096, 2048
#: Bytes of arrays that a sort holds in memory.
MEMORY_BYTES = 96 << 20
#: Suffixes of a symbol from which on it is handled alone; fewer in a row of one symbol are handled one by one.
WIDE, FEW = 1024, 16

#: Times before the first: nothing was passed on to a key, or the text's last suffix was.
_NEVER, _START = -2, -1

#: Columns of a record: the suffix's first symbol as a key, its position, what it shares with the one before.
_KEY, _POS, _LCP = range(3)
_NONE = np.empty((0, 3), np.int64)


def _turned(x: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before; the first does."""
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


def _places(size: int) -> type:
    """The type of a place in a text."""
    return np.int32 if size < 1 << 31 else np.int64


class Scratch:
    """Arrays of one sort: ``memory`` bytes of them at most, the others files in a folder of the task, which goes with
    the task as its shuffle spill does."""

    def __init__(self, memory: int = MEMORY_BYTES) -> None:
        self.folder = tempfile.TemporaryDirectory(prefix="suffixes-")
        self.count, self.memory = 0, memory

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.folder.cleanup()

    def path(self) -> str:
        self.count += 1
        return os.path.join(self.folder.name, str(self.count))

    def array(self, size: int, dtype) -> np.ndarray:
        """An array of zeros, in a file mapped into memory if there is no room for it."""
        bytes_ = size * np.dtype(dtype).itemsize
        if bytes_ <= self.memory:
            self.memory -= bytes_
            return np.zeros(size, dtype)
        return np.asarray(np.memmap(self.path(), dtype, "w+", shape=(size,)))


class DiskQueue:
    """A priority queue of records by ranges of keys; records of one key come out as they went in.

    Ranges are taken in ascending order. Beyond ``limit`` records in memory all of them are written as one run, in
    the order of their ranges.
    """

    def __init__(self, scratch: Scratch, range_of: np.ndarray, limit: int) -> None:
        self.scratch, self.range_of, self.limit = scratch, range_of, limit
        self.held: dict[int, list[np.ndarray]] = {}
        self.size = 0
        self.runs: list[tuple[str, dict[int, tuple[int, int]]]] = []

    def push(self, records: np.ndarray) -> None:
        if not len(records):
            return
        of = self.range_of[records[:, _KEY]]
        order = np.argsort(of, kind="stable")
        records, of = records.take(order, axis=0), of[order]
        cut = np.flatnonzero(_turned(of)).tolist()
        for low, high in zip(cut, [*cut[1:], len(of)], strict=True):
            self.held.setdefault(int(of[low]), []).append(records[low:high])
        self.size += len(records)
        if self.size > self.limit:
            self._spill()

    def _spill(self) -> None:
        path, index, at = self.scratch.path(), {}, 0
        with open(path, "wb") as file:
            for number in sorted(self.held):
                parts = self.held[number]
                count = sum(map(len, parts))
                index[number] = at, count
                for part in parts:
                    file.write(part.tobytes())
                at += count
        self.runs.append((path, index))
        self.held, self.size = {}, 0

    def pop(self, number: int) -> np.ndarray:
        """All records of a range by key, then arrival."""
        parts = []
        for path, index in self.runs:
            if number in index:
                at, count = index.pop(number)
                parts.append(np.fromfile(path, np.int64, 3 * count, offset=24 * at).reshape(-1, 3))
        inside = self.held.pop(number, [])
        self.size -= sum(map(len, inside))
        parts += inside
        if not parts:
            return _NONE
        records = np.concatenate(parts) if len(parts) > 1 else parts[0]
        return records.take(np.argsort(records[:, _KEY], kind="stable"), axis=0)


class LeastSince:
    """The least of the values added after a given time; holds only those below all later ones."""

    def __init__(self) -> None:
        self.times: list[int] = []
        self.values: list[int] = []
        self.now = 0

    def add_all(self, values: np.ndarray) -> None:
        least = np.minimum.accumulate(values[::-1])[::-1]
        record = np.flatnonzero(np.concatenate((values[:-1] < least[1:], [True])))
        while self.values and self.values[-1] >= least[0]:
            self.values.pop()
            self.times.pop()
        self.values += values[record].tolist()
        self.times += (record + self.now).tolist()
        self.now += len(values)

    def all_after(self, times: np.ndarray) -> np.ndarray:
        """Of each time; a large number if nothing came after it."""
        values = np.array([*self.values, np.iinfo(np.int32).max])
        return values[np.searchsorted(np.array(self.times, np.int64), times, "right")]


def ranges(counts: np.ndarray) -> np.ndarray:
    """The first key of each range, one more at the end: keys of many records alone, others up to NARROW_STEP records."""
    total = np.r_[0, np.cumsum(counts)]
    wide = np.flatnonzero(counts >= WIDE)
    edges = set(wide.tolist()) | set((wide + 1).tolist()) | {0, len(counts)}
    starts, low = [], 0
    for high in sorted(edges):
        while low < high:
            starts.append(low)
            low = min(high, max(low + 1, int(np.searchsorted(total, total[low] + NARROW_STEP, "right")) - 1))
    return np.array([*starts, len(counts)], np.int64)


class Scan:
    """One scan of a level: suffixes in ascending keys, each passing on the suffix before it if that one comes later.

    ``down`` scans from the largest symbol. Of one key, passed-on suffixes come first, then the given seeds.
    ``tell(positions, lcps, given)`` gets them in order, with what each shares with the one told before (at most cap).
    """

    def __init__(self, scratch: Scratch, text: np.ndarray, symbols: int, counts: np.ndarray, cap: int, down: bool,
                 tell: Callable[[np.ndarray, np.ndarray, np.ndarray], None], limit: int) -> None:
        self.text, self.cap, self.tell = text, cap, tell
        self.sign, self.base = (-1, symbols - 1) if down else (1, 0)
        self.starts = ranges(counts[::-1] if down else counts)
        self.queue = DiskQueue(scratch, np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts)), limit)
        self.last = scratch.array(symbols, np.int64)  # when a suffix was last passed on to each key
        self.last[:] = _NEVER
        self.least = LeastSince()

    def keys(self, at: np.ndarray) -> np.ndarray:
        found = self.text[at]
        return found.astype(np.int64) if self.sign > 0 else np.subtract(self.base, found, dtype=np.int64)

    def start(self, pos: int) -> None:
        """Pass on a suffix that nothing scanned leads to."""
        key = int(self.keys(np.array([pos]))[0])
        self.queue.push(np.array([(key, pos, 0)]))
        self.last[key] = _START

    def common(self, a: int, b: int) -> int:
        """What two suffixes share, at most cap."""
        text, end, n = self.text, len(self.text) - max(a, b), 0
        while n < 8 and n < end and text[a + n] == text[b + n]:
            n += 1
        if n == 8:
            one, two = text[a : a + min(end, self.cap)], text[b : b + min(end, self.cap)]
            other = np.flatnonzero(one != two)
            n = int(other[0]) if len(other) else len(one)
        return min(n, self.cap)

    def _step(self, key: np.ndarray, pos: np.ndarray, lcp: np.ndarray, given: np.ndarray) -> np.ndarray:
        """Scan suffixes with all in between; returns what they pass on, by arrival."""
        self.tell(pos, lcp, given)
        before = self.keys(np.maximum(pos - 1, 0))
        source = np.flatnonzero((pos > 0) & ((before > key) | ((before == key) & ~given)))
        passed = np.empty((len(source), 3), np.int64)
        if len(source):
            order = np.argsort(before[source], kind="stable")
            at = source[order]
            to = before[at]
            new = _turned(to)
            edges = np.zeros(2 * len(at), np.int64)
            edges[1::2] = at + 1
            edges[2::2] = edges[1:-1:2] * ~new[1:]
            shared = np.minimum.reduceat(np.concatenate((lcp, [self.cap])), edges)[::2]
            last = self.last[to[new]]
            first = np.minimum(shared[new], self.least.all_after(last))
            shared[new] = np.where(last == _NEVER, -1, first)
            ends = np.concatenate((new[1:], [True]))
            self.last[to[ends]] = self.least.now + at[ends]
            passed[:, _KEY], passed[:, _POS] = before[source], pos[source] - 1
            passed[order, _LCP] = np.minimum(shared + 1, self.cap)
        self.least.add_all(lcp)
        return passed

    def _wide(self, key: int, queued: np.ndarray, seeds: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """All suffixes of one key, many at a time; returns what they pass on to others."""
        end, fresh, out = -1, True, []

        def step(pos: np.ndarray, lcp: np.ndarray, given: bool) -> np.ndarray:
            passed = self._step(np.full(len(pos), key), pos, lcp, np.full(len(pos), given))
            own = passed[:, _KEY] == key
            out.append(passed[~own])
            return passed[own]

        while len(queued) >= FEW:
            end = int(queued[-1, _POS])
            queued = np.concatenate([step(p[:, _POS], p[:, _LCP], False) for p in np.split(queued, range(STEP, len(queued), STEP))])
        if len(queued):
            end, passed = self._one_by_one(key, queued)
            out.append(passed)
        for pos, lcp in seeds:
            if end >= 0 or fresh:
                lcp = lcp.copy()
                lcp[0] = self.common(end, int(pos[0])) if end >= 0 else 0
                end, fresh = -1, False
            step(pos, lcp, True)
        return np.concatenate(out) if out else _NONE

    def _one_by_one(self, key: int, queued: np.ndarray) -> tuple[int, np.ndarray]:
        """The last suffix of a key that few others of the same key lead to, and what they pass on to others."""
        text, sign, base, last, cap = self.text, self.sign, self.base, self.last, self.cap
        values, times, now = self.least.values, self.least.times, self.least.now
        line, out, at = queued[:, [_POS, _LCP]].tolist(), [], 0
        while at < len(line):
            pos, lcp = line[at]
            at += 1
            while values and values[-1] >= lcp:
                values.pop()
                times.pop()
            values.append(lcp)
            times.append(now)
            before = sign * int(text[pos - 1]) + base if pos else -1
            if before >= key:
                time = last[before]
                shared = 0 if time == _NEVER else min(values[bisect_right(times, time)] + 1, cap)
                last[before] = now
                if before == key:
                    line.append((pos - 1, shared))
                else:
                    out.append((before, pos - 1, shared))
            now += 1
            if at >= STEP:  # a very long run
                self._told(line[:at])
                del line[:at]
                at, end = 0, pos
        self.least.now = now
        self._told(line)
        return int(line[-1][0]) if line else end, np.array(out) if out else _NONE

    def _told(self, line: list[tuple[int, int]]) -> None:
        if line:
            pos, lcp = np.array(line).T
            self.tell(pos, lcp, np.zeros(len(line), bool))

    def _narrow(self, high: int, queued: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]) -> None:
        """All suffixes of keys below ``high``: as many at a time as lead to none of their own keys."""
        pos, lcp = (np.asarray(x) for x in seeds)
        rows = np.concatenate([queued, np.stack([self.keys(pos), pos, lcp], 1)])
        given = np.arange(len(rows)) >= len(queued)
        order = np.argsort(2 * rows[:, _KEY] + given, kind="stable")
        while len(order):
            rows, given = rows.take(order, axis=0), given[order]
            key, pos = rows[:, _KEY], rows[:, _POS]
            before = self.keys(np.maximum(pos - 1, 0))
            leads = (pos > 0) & ((before > key) | ((before == key) & ~given)) & (before < high)
            limit = int(before[leads].min()) if leads.any() else high
            cut = int(np.searchsorted(key, limit))
            if cut:
                lcp = rows[:cut, _LCP].copy()
                fresh = _turned(key[:cut])
                lcp[fresh] = 0
                turn = np.flatnonzero(~fresh[1:] & given[1:cut] & ~given[: cut - 1]) + 1
                if len(turn):
                    lcp[turn] = _extended(self.text, pos[turn - 1], pos[turn], np.zeros(len(turn), np.int64), self.cap)
                passed = self._step(key[:cut], pos[:cut], lcp, given[:cut])
            else:
                cut = int(np.searchsorted(key, limit, "right"))
                own = given[:cut]
                seeds = (pos[:cut][own], rows[:cut, _LCP][own])
                passed = self._wide(limit, rows[:cut][~own], iter([seeds] if own.any() else []))
            inside = passed[:, _KEY] < high
            self.queue.push(passed[~inside])
            if cut == len(rows) and not inside.any():
                break
            rows = np.concatenate([rows[cut:], passed[inside]])
            given = np.concatenate([given[cut:], np.zeros(len(rows) - len(given) + cut, bool)])
            order = np.argsort(2 * rows[:, _KEY] + given, kind="stable")

    def run(self, seeds: tuple[np.ndarray, np.ndarray]) -> None:
        """Scan all; ``seeds`` are positions in the order of the scan and what each shares with the seed before."""
        pos, lcp = seeds
        done = 0
        for number, (low, high) in enumerate(zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True)):
            end = done
            while end < len(pos):  # seeds come by key
                ahead = self.keys(np.asarray(pos[end : end + STEP])) >= high
                inside = int(ahead.argmax()) if ahead.any() else len(ahead)
                end += inside
                if inside < len(ahead):
                    break
            queued = self.queue.pop(number)
            if not len(queued) and end == done:
                continue
            if high == low + 1:
                self.queue.push(self._wide(low, queued, ((pos[i : min(i + STEP, end)], lcp[i : min(i + STEP, end)]) for i in range(done, end, STEP))))
            else:
                self._narrow(high, queued, (pos[done:end], lcp[done:end]))
            done = end


def _turns(text: np.ndarray, scratch: Scratch) -> np.ndarray:
    """The positions of symbols smaller than the one before that begin a rise: the leftmost of each valley."""
    out, size = scratch.array(len(text) // 2 + 1, _places(len(text))), 1 << 18
    at, rising = len(out), False  # whether the suffix just after the block is smaller than its own next
    for low in range((len(text) - 1) // size * size, -1, -size):
        part = text[low : low + size + 1].astype(np.int64)
        if low + size >= len(text):
            part = np.r_[part, -1]
        step = np.diff(part)
        known = np.where(step != 0, np.arange(len(step)), len(step))
        known = np.minimum.accumulate(known[::-1])[::-1]
        up = np.r_[step > 0, rising][known]
        before = np.r_[text[low - 1] if low else -1, part[: len(up) - 1]]
        found = np.flatnonzero(up & (before > part[: len(up)])) + low
        out[at - len(found) : at] = found
        at -= len(found)
        rising = bool(up[0])
    return out[at:]


def _symbols(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The symbols from 1 on, 0 for the end of the text."""
    return np.where(at < len(text), text[np.minimum(at, len(text) - 1)].astype(np.int64) + 1, 0)


def _refined(text: np.ndarray, turns: np.ndarray, active: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """These pieces in order, and of each the number of those that are smaller."""
    bits = (symbols + 1).bit_length()
    per = max(1, 60 // bits)
    after = np.minimum(active + 1, len(turns) - 1)
    length = np.where(active + 1 < len(turns), turns[after], len(text)) - turns[active] + 1  # the last includes the end
    begin, name = turns[active], np.zeros(len(active), np.int64)
    left, offset = np.arange(len(active)), 0
    while len(left):
        key = np.zeros(len(left), np.int64)
        for i in range(offset, offset + per):
            # a piece that ends goes after one that goes on: there the last symbol begins no rise
            key = (key << bits) | np.where(i < length[left], _symbols(text, begin[left] + i), symbols + 1)
        order = np.argsort(key, kind="stable") if not offset else np.lexsort((key, name[left]))
        was, key, ordered = name[left][order], key[order], left[order]
        fresh = _turned(was)
        new = fresh | _turned(key)
        # a name is the number of pieces before its group, so that later splits leave other names as they are
        first, group = np.flatnonzero(new), np.cumsum(new) - 1
        name[ordered] = was + first[group] - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        offset += per
        left = ordered[(np.diff(np.r_[first, len(new)])[group] > 1) & (length[ordered] >= offset)]
    order = np.argsort(name, kind="stable")
    return active[order], name[order]


def _names(text: np.ndarray, turns: np.ndarray, symbols: int, scratch: Scratch, limit: int) -> tuple[np.ndarray, int]:
    """The rank of the piece from each turn to the next, both included, among all; and how many differ.

    A queue deals the pieces by their first symbols to ranges of about ``limit``; each is sorted in memory.
    """
    count, step, base = len(turns), 1 << 18, symbols + 2
    two = base <= 1 << 11

    def begun(low: int) -> np.ndarray:
        at = turns[low : low + step]
        return _symbols(text, at) * base + _symbols(text, at + 1) if two else _symbols(text, at)

    counts = np.zeros(base * base if two else base, np.int64)
    for low in range(0, count, step):
        counts += np.bincount(begun(low), minlength=len(counts))
    range_of = (np.cumsum(counts) - counts) // limit
    queue = DiskQueue(scratch, range_of, limit)
    for low in range(0, count, step):
        part = np.zeros((min(step, count - low), 3), np.int64)
        part[:, _KEY], part[:, _POS] = begun(low), np.arange(low, low + len(part))
        queue.push(part)
    name, kinds = scratch.array(count, _places(count)), 0
    for number in range(int(range_of[-1]) + 1):
        inside = queue.pop(number)[:, _POS]
        if len(inside):
            ordered, smaller = _refined(text, turns, inside, symbols)
            new = _turned(smaller)
            name[ordered] = kinds + np.cumsum(new) - 1
            kinds += int(new.sum())
    return name, kinds


def _extended(text: np.ndarray, one: np.ndarray, two: np.ndarray, shared: np.ndarray, cap: int) -> np.ndarray:
    """How far the suffixes agree, given that they do so far; a few more symbols, as the pieces there differ."""
    shared = np.minimum(shared, cap)
    active = np.flatnonzero(shared < cap)
    while len(active):
        a, b = one[active] + shared[active], two[active] + shared[active]
        inside = np.maximum(a, b) < len(text)
        active, a, b = active[inside], a[inside], b[inside]
        active = active[text[a] == text[b]]
        shared[active] += 1
        active = active[shared[active] < cap]
    return shared


class Needs:
    """What the suffixes of a level must share with a neighbour, in units of the text below, to be of any use.

    ``offset(i)``: where symbol i begins there; ``need`` is a number for all, or one for each symbol.
    """

    def __init__(self, need: int | np.ndarray, offsets: np.ndarray | None = None) -> None:
        self.need, self.offsets = need, offsets

    def offset(self, at: np.ndarray) -> np.ndarray:
        return at.astype(np.int64) if self.offsets is None else self.offsets[at]

    def below(self, turns: np.ndarray, size: int) -> tuple[Needs, np.ndarray]:
        """The same for the pieces that begin at the turns, and up to where a piece's suffix must agree with another.

        The suffixes from the turn before up to a turn are induced from it, and share as much more as they begin
        earlier: what the least demanding of them needs is needed of the turn.
        """
        limit = np.empty(len(turns), np.int64)
        step, offsets = 1 << 18, np.empty(len(turns) + 1, np.int64)
        for low in range(0, len(turns), step):
            own = turns[low : low + step]
            offsets[low : low + len(own)] = self.offset(own)
            begin = int(turns[low - 1]) if low else 0
            inside = np.arange(begin, int(own[-1]))
            wanted = self.offset(inside) + (self.need if np.isscalar(self.need) else self.need[inside])
            starts = np.concatenate(([begin], own[:-1])) - begin
            limit[low : low + step] = np.minimum.reduceat(np.append(wanted, np.iinfo(np.int64).max), starts)[: len(own)]
        if turns[0] == 0:
            limit[0] = np.iinfo(np.int64).max  # nothing is induced from the first symbol
        offsets[-1] = self.offset(np.array([size]))[0]
        return Needs(limit - offsets[:-1], offsets), limit


def suffix_order(
    text: np.ndarray, symbols: int, cap: int, tell: Callable[[np.ndarray, np.ndarray], None], scratch: Scratch, limit: int = QUEUE_RECORDS,
    needs: Needs | None = None,
) -> None:
    """Tell suffixes of ``text`` (numbers below ``symbols``) from the largest down, many at a time.

    ``tell(positions, lcps)``: what each suffix shares with the one told before it, at most ``cap``; the first of all
    shares 0. An end of the text is smaller than any symbol. Without ``needs`` all suffixes are told. With it, at least
    all of those that share so much with another: what can't is not induced at any level.
    """
    if not len(text):
        return
    counts = np.bincount(text, minlength=symbols)
    turns = _turns(text, scratch)
    order, shared = scratch.array(len(turns), _places(len(text))), scratch.array(len(turns), np.int32)
    if len(turns):
        deeper, reach = needs.below(turns, len(text)) if needs else (None, None)
        names, kinds = _names(text, turns, symbols, scratch, limit)
        if kinds == len(turns):
            order[names] = np.arange(len(turns))
        else:
            at = len(turns)

            def ranked(pos: np.ndarray, lcp: np.ndarray) -> None:
                nonlocal at
                order[at - len(pos) : at] = pos[::-1]
                # shared with the one told before, the next larger: kept there
                shared[at - len(pos) + 1 : at + 1] = lcp[::-1][: len(shared) - (at - len(pos) + 1)]
                at -= len(pos)

            suffix_order(names, kinds, cap, ranked, scratch, limit, deeper)
            order, shared = order[at:], shared[at:]
            shared[:1] = 0
        for low in range(1, len(order), 1 << 16):
            part = slice(low, min(low + (1 << 16), len(order)))
            two, one = order[part], order[part.start - 1 : part.stop - 1]
            base = turns[np.minimum(one + shared[part], len(turns) - 1)] - turns[one]
            shared[part] = _extended(text, turns[one], turns[two], base, cap)
        if needs:
            at = turns[order]
            # with a suffix that is no turn it shares no more than the symbols equal to its first
            run = 1 + _extended(text, at, at + 1, np.zeros(len(at), np.int64), cap)
            most = np.maximum(np.maximum(shared, np.append(shared[1:], 0)), run)
            # pieces that differ still share a part; it ends before the third one from here
            most = most + (0 if needs.offsets is None else 3)
            useful = np.flatnonzero(needs.offset(np.minimum(at + most, len(text))) >= reach[order])
            if len(useful):
                starts = np.concatenate(([0], useful[:-1] + 1))
                shared = np.minimum.reduceat(shared[: useful[-1] + 1], starts)
            order = order[useful]
            shared = shared[: len(order)]
        for low in range(0, len(order), 1 << 16):
            order[low : low + (1 << 16)] = turns[order[low : low + (1 << 16)]]

    falling = scratch.array(len(text), _places(len(text)))
    falling_lcp = scratch.array(len(text) + 1, np.int32)
    held = 0

    def fall(pos: np.ndarray, lcp: np.ndarray, given: np.ndarray) -> None:
        nonlocal held
        pos, lcp = pos[~given], lcp[~given]
        falling[held : held + len(pos)], falling_lcp[held : held + len(pos)] = pos, lcp
        held += len(pos)

    scan = Scan(scratch, text, symbols, counts, cap, False, fall, limit)
    scan.start(len(text) - 1)
    scan.run((order, shared))
    # from the largest down, a suffix shares with the one before it what that one shared with it on the way up
    down = falling[:held][::-1], falling_lcp[1 : held + 1][::-1]
    Scan(scratch, text, symbols, counts, cap, True, lambda pos, lcp, given: tell(pos, lcp), limit).run(down)
