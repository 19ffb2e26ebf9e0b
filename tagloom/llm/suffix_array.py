"""Suffix arrays with common prefixes by external induced sorting.

Suffixes that begin where the text turns from falling to rising are sorted first, by recursion over the names of the
pieces between them; all others are induced from these in two scans. A scan takes suffixes out of a priority queue
in the order of (first symbol, arrival) and puts their predecessors in. The queue holds tuples (symbol, place, common
prefix) in sorted runs; what is over `room` tuples is in files, from which a scan reads on where it has stopped.

Each tuple carries the length, in symbols of the first text and up to `cap`, that its suffix has in common with the
one before it under its symbol. That is a symbol's weight more than the least such length among the suffixes that
the scan has passed between the two inductions; as lengths have cap + 1 values, the last place of each value is all
that is kept of what has been passed. A name weighs what its piece has of the first text, so the recursion counts
in that as well; the text itself is compared only where a scan goes on from one name to another, where a symbol's
induced suffixes meet the given ones, and where the recursion ends: at names that are all different, or at no more
than `base` names, which are few enough to be sorted in memory.

Arrays of more than `room` numbers are files too; numpy reads the parts of them that a scan is at. Places and symbols
take four bytes each where the text's length allows it, and a scan passes at most CHUNK suffixes at a time.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Numbers that an array or the queue may hold in memory; beyond it they are files.
ROOM = 4 << 20

#: Names at which the recursion ends; induction would take them in many small steps.
BASE = 1 << 21

#: Suffixes that a scan passes, or a comparison takes, at once.
CHUNK = 1 << 17

#: Runs of the queue; more are merged, neighbours with neighbours.
RUNS = 16


def _kind(n: int) -> type:
    """The type of places in a text of n symbols, and of its symbols."""
    return np.int32 if n < (1 << 31) - (1 << 16) else np.int64


def _find(x: np.ndarray, key: int) -> int:
    """searchsorted by a key of the array's own type: for another one numpy would copy the array."""
    return int(x.searchsorted(x.dtype.type(key)))


class Disk:
    """Arrays in memory while they are small, and in files of a folder beyond `room` numbers."""

    def __init__(self, folder: str | None, room: int = ROOM, base: int = BASE):
        self.folder, self.room, self.base = folder, room, min(base, room)

    def empty(self, n: int, kind) -> np.ndarray:
        if self.folder is None or n <= self.room:
            return np.empty(n, kind)
        with tempfile.NamedTemporaryFile(dir=self.folder) as f:
            return np.asarray(np.memmap(f, kind, "w+", shape=(n,)))

    def full(self, n: int, fill: int, kind) -> np.ndarray:
        out = self.empty(n, kind)
        out[:] = fill
        return out


class Queue:
    """A priority queue of tuples (key, place, common prefix); of equal keys the first that came goes first."""

    def __init__(self, disk: Disk):
        self.disk = disk
        self.runs: list[list] = []  # [keys, places, lengths, where to read on, where below() ended], by arrival

    def _run(self, parts: list[tuple]) -> list:
        """A sorted run of the parts, which are in order of arrival."""
        keys = np.concatenate([p[0] for p in parts])
        order = np.argsort(keys, kind="stable")
        out = []
        for column in range(3):
            x = self.disk.empty(len(keys), parts[0][column].dtype)
            x[:] = (keys if column == 0 else np.concatenate([p[column] for p in parts]))[order]
            out.append(x)
        return [*out, 0, 0]

    def push(self, keys: np.ndarray, places: np.ndarray, lengths: np.ndarray) -> None:
        """Add tuples that are sorted by key, equal keys in order of arrival."""
        if not len(keys):
            return
        self.runs.append([keys, places, lengths, 0, 0])
        if len(self.runs) > RUNS:
            # the last runs become one, and with them each run before that is no longer than they are together
            total, first = 0, len(self.runs)
            while first and (first > len(self.runs) - RUNS // 2 or len(self.runs[first - 1][0]) - self.runs[first - 1][3] <= total):
                first -= 1
                total += len(self.runs[first][0]) - self.runs[first][3]
            self.runs[first:] = [self._run([tuple(c[r[3] :] for c in r[:3]) for r in self.runs[first:]])]

    def below(self, key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tuples under `key`, in order, which stay."""
        parts = []
        for run in self.runs:
            keys, places, lengths, at, _ = run
            # most runs have nothing yet
            run[4] = end = at if keys[at] >= key else at + _find(keys[at:], key)
            if end > at:
                parts.append((keys[at:end], places[at:end], lengths[at:end]))
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int16)
        if len(parts) == 1:
            return tuple(np.asarray(x) for x in parts[0])
        keys, places, lengths = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(keys, kind="stable")
        return keys[order], places[order], lengths[order]

    def drop(self, key: int) -> None:
        """Take out all tuples under `key`, which is at most what below() was last asked for."""
        gone = False
        for run in self.runs:
            if run[4] > run[3]:
                run[3] += _find(run[0][run[3] : run[4]], key)
                gone = gone or run[3] == len(run[0])
        if gone:
            self.runs = [r for r in self.runs if r[3] < len(r[0])]


class Words:
    """The first text, for comparisons of several symbols at a time."""

    def __init__(self, text: np.ndarray, cap: int):
        self.cap, self.n = cap, len(text)
        # a comparison may read past the end, by less than cap and what it reads at once
        self.text = np.zeros(self.n + cap + 4 * self.WIDEST + 4, np.uint16)
        self.text[: self.n] = text
        self.four = np.ndarray((len(self.text) - 4,), "<u8", self.text, strides=(2,))

    #: Words of four symbols that are read at once, and how many in all places together.
    WIDEST, ROWS = 32, 1 << 17

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What the suffixes at a and b have in common, up to `cap`."""
        out = np.full(len(a), self.cap, np.int64)
        rows = None
        k, wide = 0, 1
        while len(a) and k < self.cap:
            if wide == 1:
                d = self.four[a + k] ^ self.four[b + k]
                first, same = k, d == 0
            else:
                steps = np.arange(k, k + 4 * wide, 4)
                d = self.four[a[:, None] + steps] ^ self.four[b[:, None] + steps]
                at = (d != 0).argmax(axis=1)
                d = d[np.arange(len(a)), at]
                first, same = k + 4 * at, d == 0
            ended = np.flatnonzero(~same)
            d = d[ended]
            past = (d & np.uint64(0xFFFF) == 0) * (1 + (d & np.uint64(0xFFFFFFFF) == 0) * (1 + (d & np.uint64(0xFFFFFFFFFFFF) == 0)).astype(np.int64))
            out[ended if rows is None else rows[ended]] = past + (first if wide == 1 else first[ended])
            k += 4 * wide
            left = np.flatnonzero(same)
            a, b, rows = a[left], b[left], left if rows is None else rows[left]
            # a suffix that ends has ended in a symbol that no other has
            wide = max(1, min(2 * wide, self.WIDEST, self.ROWS // max(1, len(a))))
        return np.minimum(out, self.cap)


def _least_between(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of x[first..last], first <= last, for each pair."""
    width = last - first + 1
    out = np.array(x[last])
    wide = np.flatnonzero(width > 1)
    if len(wide):
        top = int(width[wide].max()).bit_length()
        levels = [x]
        for k in range(1, top):
            half = 1 << (k - 1)
            levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]) if len(levels[-1]) > half else levels[-1][:0])
        bits = np.frexp(width[wide].astype(float))[1] - 1
        for k in np.unique(bits).tolist():
            own = wide[bits == k]
            out[own] = np.minimum(levels[k][first[own]], levels[k][last[own] - (1 << k) + 1])
    return out


class Scan:
    """One scan of induced sorting over keys in order; `given` suffixes follow the induced ones of their key."""

    def __init__(self, text, size: int, down: bool, member, disk: Disk, words: Words | None, weight=None, origin=None):
        self.text, self.size, self.down, self.member, self.disk, self.words = text, size, down, member, disk, words
        self.weight, self.origin, self.kind = weight, origin, _kind(max(len(text), size))
        self.queue, self.passed = Queue(disk), 0
        if words is not None:
            self.last = disk.full(size, -1, np.int64)  # when a symbol was last put in
            self.latest = np.full(words.cap + 1, -1, np.int64)  # when a length of at most so much was last passed
        self.before = None  # key, kind and place of the last suffix passed

    def _lengths(self, keys, kinds, places, own) -> np.ndarray:
        """What each suffix has in common with the one before it in the scan."""
        out = np.array(own)
        old = self.before or (keys[0], kinds[0], places[0])
        k0, d0, p0 = (np.append(x, y[:-1]) for x, y in zip(old, (keys, kinds, places)))
        first = self.origin is None
        if first:
            out[k0 != keys] = 0
        # names in order may share a beginning, up to where a run of one symbol ends in either
        seam = np.flatnonzero(((k0 == keys) | (not first)) & ((k0 != keys) | (d0 != kinds)))
        if len(seam):
            a, b = p0[seam], places[seam]
            out[seam] = self.words.common(*((a, b) if first else (self.origin[a], self.origin[b])))
        if self.before is None:
            out[0] = 0
        self.before = keys[-1], kinds[-1], places[-1]
        return out

    def process(self, keys, kinds, places, own) -> np.ndarray | None:
        """Pass these suffixes, put in what they induce, and return their lengths."""
        if not len(keys):
            return np.zeros(0, np.int16)
        lengths = None if self.words is None else self._lengths(keys, kinds, places, own)
        at = np.flatnonzero(places > 0)
        pred = places[at] - 1
        chosen = self.member[pred] == self.down
        at, pred = at[chosen], pred[chosen]
        symbols = self.text[pred].astype(self.kind)
        # larger symbols first on the way down, equal ones in order of arrival
        rank = self.size - 1 - symbols if self.down else symbols
        order = np.argsort(rank.astype(np.uint16) if self.size <= 1 << 16 else rank, kind="stable")
        at, pred, symbols = at[order], pred[order], symbols[order]
        found = np.zeros(len(at), np.int16)
        if lengths is not None and len(at):
            fresh = np.ones(len(at), bool)
            np.not_equal(symbols[1:], symbols[:-1], out=fresh[1:])
            again = np.flatnonzero(~fresh)
            least = np.zeros(len(at), np.int32)
            least[again] = _least_between(lengths, at[again - 1] + 1, at[again])
            first = np.flatnonzero(fresh)
            since = self.last[symbols[first]]
            least[first] = np.minimum(np.minimum.accumulate(lengths)[at[first]], self.latest.searchsorted(since, side="right"))
            found = np.minimum(least + (1 if self.weight is None else self.weight[symbols]), self.words.cap).astype(np.int16)
            # of equal places the last one written stays
            self.last[symbols] = self.passed + at
        if lengths is not None:
            seen = np.full(self.words.cap + 1, -1, np.int64)
            seen[lengths] = self.passed + np.arange(len(lengths))
            self.latest = np.maximum(self.latest, np.maximum.accumulate(seen))
        self.passed += len(keys)
        self.queue.push(-symbols if self.down else symbols, pred, found)
        return lengths

    def _pass(self, keys, kinds, places, own):
        """process() by chunks; what a chunk puts in under a later key, or the same, comes before what the next one does."""
        for a in range(0, len(keys), CHUNK):
            part = slice(a, a + CHUNK)
            yield kinds[part], places[part], own[part], self.process(keys[part], kinds[part], places[part], own[part])

    def run(self, given_keys, given_places, given_lengths):
        """Batches (kinds, places, own lengths, lengths) of all suffixes in order; kind 0 is induced, 1 given."""
        key, top, at = (1 - self.size, 1, 0) if self.down else (0, self.size, 0)
        width = 64
        while key < top:
            end = min(top, key + width)
            keys, places, own = self.queue.below(end)
            stop_at = at + _find(given_keys[at:], end)
            if end - key > 1:
                # up to the first key that these suffixes put something in under, none of them changes another's place
                pred = np.concatenate([places, given_places[at:stop_at]])
                pred = pred[pred > 0] - 1
                pred = pred[self.member[pred] == self.down]
                stop = end
                if len(pred):
                    symbols = self.text[pred]
                    stop = min(end, int(-symbols.max() if self.down else symbols.min()))
                if stop > key + 1 or stop == end:
                    m, upto = _find(keys, stop), at + _find(given_keys[at:stop_at], stop)
                    all_keys = np.concatenate([keys[:m], given_keys[at:upto]])
                    all_places = np.concatenate([places[:m], given_places[at:upto]])
                    all_own = np.concatenate([own[:m], given_lengths[at:upto]])
                    kinds = np.zeros(len(all_keys), np.int8)
                    kinds[m:] = 1
                    if 0 < m < len(all_keys):
                        # both are sorted, and of equal keys the induced ones come first
                        order = np.argsort(all_keys, kind="stable")
                        all_keys, all_places, all_own, kinds = all_keys[order], all_places[order], all_own[order], kinds[order]
                    self.queue.drop(stop)
                    at = upto
                    yield from self._pass(all_keys, kinds, all_places, all_own)
                    width = min(2 * width, 1 << 16) if stop == end else max(2, (stop - key) * 2)
                    key = stop
                    continue
                width = 2
            while True:
                keys, places, own = self.queue.below(key + 1)
                if not len(keys):
                    break
                self.queue.drop(key + 1)
                yield from self._pass(keys, np.zeros(len(keys), np.int8), places, own)
            stop_at = at + _find(given_keys[at:], key + 1)
            if stop_at > at:
                kinds = np.ones(stop_at - at, np.int8)
                places, own = np.asarray(given_places[at:stop_at]), np.asarray(given_lengths[at:stop_at])
                yield from self._pass(np.asarray(given_keys[at:stop_at]), kinds, places, own)
                at = stop_at
            key += 1


def _rising(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (the last counts as such)."""
    out = np.ones(len(text), bool)
    np.greater(text[1:], text[:-1], out=out[:-1])
    # of equal symbols, as the last of them
    tied = np.flatnonzero(text[1:] == text[:-1])
    if len(tied):
        lasts = np.append(np.flatnonzero(np.diff(tied) != 1), len(tied) - 1)
        out[tied] = np.repeat(out[tied[lasts] + 1], np.diff(lasts, prepend=-1))
    return out


def induce(text, size: int, seeds, seed_lengths, rising, disk: Disk, words: Words | None = None, **more) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order with their common prefixes, from the sorted `seeds` (turning points)."""
    n, kind = len(text), _kind(max(len(text), size))
    up = Scan(text, size, False, rising, disk, words, **more)
    # upwards: falling suffixes are induced, those under a symbol before the seeds
    up.member = rising
    count = int(n - rising.sum())
    falling, own_lengths, at = disk.empty(count, kind), disk.empty(count, np.int16), 0
    for kinds, places, own, _ in up.run(np.asarray(text[seeds]).astype(kind), seeds, seed_lengths):
        mine = kinds == 0
        m = int(mine.sum())
        falling[at : at + m], own_lengths[at : at + m] = places[mine], own[mine]
        at += m
    del up
    # downwards: rising suffixes are induced, those under a symbol behind the falling ones
    down = Scan(text, size, True, rising, disk, words, **more)
    down.queue.push(np.zeros(1, kind), np.array([n - 1], kind), np.zeros(1, np.int16))
    if words is not None:
        down.last[0] = 0
    given = falling[::-1]
    lengths_down = disk.full(count, 0, np.int16)
    lengths_down[1:] = own_lengths[::-1][:-1]
    order, common, at = disk.empty(n, kind), disk.full(n, 0, np.int16), n
    for _, places, _, lengths in down.run(-np.asarray(text[given]).astype(kind), given, lengths_down):
        m = len(places)
        order[at - m : at] = places[::-1]
        if lengths is not None:
            # lengths are between a suffix and the larger one before it in the scan
            upto = min(at + 1, n)
            common[at - m + 1 : upto] = lengths[::-1][: upto - (at - m + 1)]
        at -= m
    return order, common


def _names(text, turns, order) -> np.ndarray:
    """True for each piece (from one turning point to the next, inclusive) in `order` that differs from the one before."""
    ends = np.append(turns[1:], turns.dtype.type(len(text) - 1))
    at = np.searchsorted(turns, order)
    a, n = turns[at], ends[at] - turns[at] + 1
    same = n[1:] == n[:-1]
    rows = np.flatnonzero(same)
    k = 0
    while len(rows):
        rows = rows[n[rows] > k]
        differ = text[a[rows] + k] != text[a[rows + 1] + k]
        same[rows[differ]] = False
        rows = rows[~differ]
        k += 1
    return np.append(True, ~same)


def _doubled(text: np.ndarray) -> np.ndarray:
    """Places of the suffixes of a short text in order, by ranks of 1, 2, 4, ... symbols; what is alone stays."""
    n, k = len(text), 1
    kind = _kind(n)
    order = np.argsort(text, kind="stable").astype(kind)
    start = np.append(True, text[order[1:]] != text[order[:-1]])
    rank = np.empty(n, kind)  # of equals the first one's place in order
    rank[order] = np.maximum.accumulate(np.where(start, np.arange(n, dtype=kind), 0))
    while True:
        tied = np.flatnonzero(~(start & np.append(start[1:], True)))
        if not len(tied):
            return order
        places = order[tied]
        after = places + k
        key = rank[places].astype(np.int64) * (n + 1)
        inside = after < n
        key[inside] += rank[after[inside]] + 1
        by = np.argsort(key, kind="stable")
        places, key = places[by], key[by]
        order[tied] = places
        start[tied] = fresh = np.append(True, key[1:] != key[:-1])
        rank[places] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))]
        k *= 2


def _apart(words: Words, places: np.ndarray) -> np.ndarray:
    """What each of these suffixes of the first text has in common with the one before it."""
    out = np.zeros(len(places), np.int16)
    for a in range(1, len(places), CHUNK):
        both = places[a - 1 : a + CHUNK]
        out[a : a + CHUNK] = words.common(both[:-1], both[1:])
    return out


def _sorted(text, size: int, disk: Disk, words: Words, weight=None, origin=None) -> tuple[np.ndarray, np.ndarray]:
    if len(text) < 3:
        order = np.argsort(text, kind="stable").astype(_kind(len(text)))
        return order, np.zeros(len(text), np.int16)
    if origin is not None and len(text) <= disk.base:
        order = _doubled(text)
        return order, _apart(words, origin[order])
    more = dict(weight=weight, origin=origin)
    rising = _rising(text)
    kind = _kind(len(text))
    turns = (np.flatnonzero(rising[1:] & ~rising[:-1]) + 1).astype(kind)
    if len(turns) == 1:
        return induce(text, size, turns, np.zeros(1, np.int16), rising, disk, words, **more)
    # pieces in order: an induction without lengths from the turning points by first symbol
    seeds = turns[np.argsort(text[turns], kind="stable")]
    order, _ = induce(text, size, seeds, np.zeros(len(seeds), np.int16), rising, disk)
    turning = np.zeros(len(text), bool)
    turning[turns] = True
    order = order[turning[order]]
    new = _names(text, turns, order)
    place = turns if origin is None else origin[turns]
    count = int(new.sum())
    if count == len(turns):
        own = order if origin is None else origin[order]
        return induce(text, size, order, _apart(words, own), rising, disk, words, **more)
    names = disk.empty(len(turns), kind)
    names[np.searchsorted(turns, order)] = np.cumsum(new) - 1
    long = np.zeros(count, np.int16)
    long[names] = np.append(np.minimum(np.diff(place), words.cap), 1)
    del seeds, order, turning, new
    ranks, common = _sorted(names, count, disk, words, long, place)
    seeds = turns[ranks]
    del names, place, long, turns, ranks
    return induce(text, size, seeds, common, rising, disk, words, **more)


def suffix_array(text: np.ndarray, size: int, cap: int = 400, folder: str | None = None, room: int = ROOM, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """Places of the suffixes of `text` (numbers below `size` and 2^16, a lone 0 at the end) in order, and what each has in common with the one before it, up to `cap`."""
    if not len(text):
        return np.zeros(0, np.int64), np.zeros(0, np.int16)
    return _sorted(text, size, Disk(folder, room, base), Words(text, cap))
