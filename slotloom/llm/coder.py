"""An adaptive context-mixing range coder for token ids, for many independent blocks at once.

Every block starts from nothing. For each id, the last one seen after the same two ids and after the same one (hashed contexts, each
with a confidence) are predicted by orders 2 and 1; order 0 is the distribution of the block's ids so far, taken anew each time
the block has grown by half; what has not been seen is one of all ids. The orders' weights are adaptive and chosen by both
confidences. The probability of what order 2 predicts is the sum of what all orders give it: the weight of order 2, that of order 1 where
it predicts the same, and that of order 0 times the id's share of the block (counted in hashed cells). An id is coded in one step, the sums
of all ids being normalised; the weights then move towards the orders that were right.

The range coder has 64 bits, goes on 32 at a time, and carries into words already put out. Blocks advance together, one numpy
operation for all of them, with small tables for each.
"""

from __future__ import annotations

import zlib

import numpy as np

FIRST = 48
ONE, TWO, CELLS = 11, 12, 10  # bits of the hashed contexts and of the cells that count ids
SURE = 7
STEP, MOST = 32, 4096
SCALE = 14
_FIELDS = np.uint64(0x7FFF7FFF7FFF7FFF), np.uint64(0x0001000100010001)
#: What the weights of orders 2, 1, 0 and of the rest, 16 bits each, gain by what was right, as bits: 1 order 2, 2 order 1, 4 order 0 knows the id.
_ONES = [STEP << 48, STEP, STEP << 16, STEP // 2 << 16 | STEP // 2]
_GAIN = np.array([*_ONES, STEP << 32, *_ONES[1:]], np.uint64)
_START = np.uint64(24 | 12 << 16 | 16 << 32 | 16 << 48)
_FULL, _LEAST, _32 = np.uint64((1 << 64) - 1), np.uint64(1 << 32), np.uint64(32)
_u = np.uint32
_NONE = _u(0)
_HASH = _u(2654435761)
#: Lanes that are sorted or counted together: what they need stays in a core's cache.
_GROUP = 64


class _Model:
    """The predictions of all lanes. Lanes are sorted by length, the longest first, so that those that go on are the first n."""

    def __init__(self, lanes: int, size: int, vocabulary: int):
        self.ids, self.vocabulary = np.zeros((size, lanes), np.uint32), vocabulary  # a row for each place
        lane = np.arange(lanes, dtype=np.int64)
        self.base = np.stack([lane << ONE, (lanes << ONE) + (lane << TWO)])  # of orders 1 and 2 in one table
        self.cells, self.mixes = lane << CELLS, lane << 6
        self.table = np.zeros((lanes << ONE) + (lanes << TWO), np.uint32)
        self.seen, self.weights = np.zeros(lanes << CELLS, np.uint16), np.full(lanes << 6, _START)
        self.mixed = np.zeros(lanes, np.uint32)
        self.known, self.next = 0, FIRST

    def grow(self, t: int) -> None:
        """From now on order 0 is that of the first t ids."""
        for a in range(0, self.ids.shape[1], _GROUP):
            cells = self.ids[self.known : t, a : a + _GROUP] * _HASH >> _u(32 - CELLS)
            at = cells + self.cells[: cells.shape[1]]
            self.seen[a << CELLS : (a + _GROUP) << CELLS] += np.bincount(at.ravel(), minlength=cells.shape[1] << CELLS).astype(np.uint16)
        self.known, self.next = t, t + t // 2

    def at(self, t: int, n: int) -> None:
        """Moves to place t of the first n lanes: predictions of orders 1 and 2, and how the range is divided into them, order 0 and the rest."""
        own = self.ids[t - 1, :n] * _HASH if t else np.zeros(n, np.uint32)
        both = own ^ self.mixed[:n] * _u(5)
        self.mixed[:n] = own
        h = np.empty((2, n), np.uint32)
        np.right_shift(own, _u(32 - ONE), out=h[0])
        np.right_shift(both, _u(32 - TWO), out=h[1])
        self.h = self.base[:, :n] + h
        self.e = self.table[self.h]
        self.p, self.c = self.e >> _u(3), self.e & _u(7)
        self.mix = self.mixes[:n] + ((self.c[1] << _u(3)) + self.c[0])
        self.w = self.weights.take(self.mix)
        f = np.empty((4, n), np.uint32)
        f[...] = self.w.view(np.uint16).reshape(n, 4).T
        f2, f1, f0, rest = f
        self.sum = f2 + f1 + f0 + rest
        alike = np.where(self.p[0] == self.p[1], f1, _NONE)
        self.to2 = f2 + alike
        if self.known:
            often = self.seen.take(self.cells[:n] + (self.p[1] * _HASH >> _u(32 - CELLS))) * _u(65536 // self.known)
            often *= f0
            self.to2 += often >> _u(16)
        self.to2 <<= _u(SCALE)
        self.one = (f1 - alike) << _u(SCALE)
        self.to1 = self.to2 + self.one
        if self.known:
            self.unit0 = (f0 << _u(SCALE)) // _u(self.known)
            if self.known > 1 << SCALE:
                self.unit0 = np.maximum(self.unit0, _u(1))
            self.to0 = self.to1 + self.unit0 * _u(self.known)
        else:
            self.unit0, self.to0 = np.zeros(n, np.uint32), self.to1
        self.unit = np.maximum((rest << _u(SCALE)) // _u(self.vocabulary), _u(1))
        self.total = self.to0 + self.unit * _u(self.vocabulary)

    def hits(self, ids: np.ndarray) -> np.ndarray:
        """Whether orders 1 and 2 predict ``ids``."""
        return (self.e ^ (ids << _u(3))) < _u(8)

    def learn(self, t: int, n: int, ids: np.ndarray, hit: np.ndarray, old: np.ndarray) -> None:
        self.ids[t, :n] = ids
        one, two, old = hit[0].view(np.uint8), hit[1].view(np.uint8), old.view(np.uint8)
        w = self.w + _GAIN.take(two + (one << np.uint8(1)) + (old << np.uint8(2)))
        full = np.flatnonzero(self.sum > _u(MOST - STEP))
        if len(full):
            w[full] = ((w[full] >> np.uint64(1)) & _FIELDS[0]) + _FIELDS[1]
        self.weights[self.mix] = w
        # right: one surer; wrong: half as sure, or replaced
        right = np.minimum(self.e + _u(1), self.e | _u(SURE))
        wrong = np.where(self.c < _u(2), ids << _u(3), self.e - ((self.c + _u(1)) >> _u(1)))
        self.table[self.h] = np.where(hit, right, wrong)


def _growths(size: int) -> list[int]:
    """The places where order 0 is taken anew, and the end."""
    out = [FIRST]
    while out[-1] < size:
        out.append(out[-1] + out[-1] // 2)
    return [*out[:-1], size] if size > FIRST else []


def _counted(whole: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place (row) and lane: how many ids of the history that order 0 then knows are less than the lane's own, and how many equal it."""
    lanes, size = whole.shape
    kind = np.uint16 if size < 1 << 16 else np.uint32
    before, many = np.zeros((size, lanes), kind), np.zeros((size, lanes), kind)
    places = max(1, (size - 1).bit_length())
    width = np.uint32 if vocabulary << places <= 1 << 32 else np.uint64
    for a in range(0, lanes, _GROUP):
        ids = whole[a : a + _GROUP]
        order = np.sort(ids.astype(width) << width(places) | np.arange(size, dtype=width), axis=1)
        new = np.zeros(ids.shape, bool)
        np.not_equal(order[:, 1:] >> width(places), order[:, :-1] >> width(places), out=new[:, 1:])
        rank = new.cumsum(1, dtype=np.int32)
        different = int(rank[:, -1].max()) + 1
        rows = np.arange(len(ids))[:, None]
        rank += (rows * different).astype(np.int32)
        code = np.empty((size, len(ids)), np.int32)  # the place of each id among the lane's different ones
        code.ravel()[(order & width((1 << places) - 1)).astype(np.int64) * len(ids) + rows] = rank
        counts, seen, ends = np.zeros(len(ids) * different, np.int32), 0, _growths(size)
        for t, end in zip(ends, ends[1:]):
            counts += np.bincount(code[seen:t].ravel(), minlength=len(counts)).astype(np.int32)
            seen, ahead = t, code[t:end]
            upto = counts.reshape(len(ids), different).cumsum(1, dtype=np.int32).ravel() - counts
            many[t:end, a : a + len(ids)] = counts.take(ahead)
            before[t:end, a : a + len(ids)] = upto.take(ahead)
    return before, many


def encode(ids: np.ndarray, vocabulary: int, block: int) -> list[bytes]:
    """The ids in blocks of ``block`` (the last may be shorter), each with a header: ids, bytes, checksum of the ids."""
    lanes = -(-len(ids) // block)
    if not lanes:
        return []
    last, size = len(ids) - (lanes - 1) * block, min(block, len(ids))
    whole = np.zeros((lanes, size), np.uint32)
    whole.ravel()[: len(ids)] = ids
    before, many = _counted(whole, vocabulary)
    rows, lane = np.ascontiguousarray(whole.T), np.arange(lanes, dtype=np.int64)
    model = _Model(lanes, size, vocabulary)
    low, wide = np.zeros(lanes, np.uint64), np.full(lanes, _FULL)
    width = size + 8
    words, used = np.zeros(lanes * width, np.uint32), lane * width  # a lane's words, and the place of its next one
    for t in range(size):
        n = lanes if t < last else lanes - 1
        if t == model.next:
            model.grow(t)
        model.at(t, n)
        own, m = rows[t, :n], many[t, :n].astype(np.uint32)
        hit, old = model.hits(own), m > 0
        start = np.where(old, model.to1 + model.unit0 * before[t, :n], model.to0 + model.unit * own)
        share = np.where(old, model.unit0 * m, model.unit)
        start, share = np.where(hit[0], model.to2, start), np.where(hit[0], model.one, share)
        start, share = np.where(hit[1], _NONE, start), np.where(hit[1], model.to2, share)
        unit = wide[:n] // model.total
        add = unit * start
        low[:n] += add
        over = np.flatnonzero(low[:n] < add)
        at = used[over]
        while len(at):
            at -= 1
            words[at] += _u(1)
            at = at[words[at] == 0]
        now = unit * share
        move = np.flatnonzero(now < _LEAST)
        if len(move):
            rest, at = low[move], used[move]
            words[at] = rest >> _32
            used[move] = at + 1
            low[move] = rest << _32
            now[move] <<= _32
        wide[:n] = now
        model.learn(t, n, own, hit, old)
    for k in (32, 0):
        words[used] = (low >> np.uint64(k)) & np.uint64(0xFFFFFFFF)
        used += 1
    blocks = []
    for i in range(lanes):
        body = words[i * width : used[i]].astype("<u4").tobytes()
        own = whole[i, : size if i < lanes - 1 else last]
        blocks.append(np.array([len(own), len(body), zlib.crc32(own.astype("<u4").tobytes())], "<u4").tobytes() + body)
    return blocks


def blocks_of(data: bytes) -> list[tuple[int, int, bytes]]:
    """The blocks of ``data``: the number of ids, their checksum, the coded bytes."""
    at, out = 0, []
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("a block's header breaks off")
        n, size, check = np.frombuffer(data, "<u4", 3, at).tolist()
        if at + 12 + size > len(data):
            raise ValueError("a block breaks off")
        out.append((n, check, data[at + 12 : at + 12 + size]))
        at += 12 + size
    return out


def _runs(ids: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of each lane (a column of ``ids``) in order, as runs of equal ids: for each place its run, and of each run its first place and its id."""
    t, lanes = ids.shape
    run, starts, values = np.empty(lanes * t, np.int32), [], []
    runs = 0
    for a in range(0, lanes, _GROUP):
        own = np.sort(ids[:, a : a + _GROUP].T.astype(np.uint16 if vocabulary <= 1 << 16 else np.uint32), axis=1)
        new = np.ones(own.shape, bool)
        np.not_equal(own[:, 1:], own[:, :-1], out=new[:, 1:])
        at = np.flatnonzero(new)
        np.cumsum(new.ravel(), dtype=np.int32, out=run[a * t : a * t + own.size])
        run[a * t : a * t + own.size] += runs - 1
        runs += len(at)
        starts.append(at + a * t)
        values.append(own.ravel()[at])
    return run, np.concatenate([*starts, [lanes * t]]), np.concatenate(values)


def decode(data: bytes, vocabulary: int) -> np.ndarray:
    """The ids of all blocks of ``data``. A block whose checksum differs raises ValueError."""
    blocks = blocks_of(data)
    order = sorted(range(len(blocks)), key=lambda i: -blocks[i][0])
    counts = np.array([blocks[i][0] for i in order], np.int64)
    if not len(counts) or not counts[0]:
        return np.empty(0, np.int32)
    size, lanes = int(counts[0]), len(counts)
    width = max(len(b[2]) for b in blocks) // 4 + 8
    words = np.zeros((lanes, width), np.uint32)
    for k, i in enumerate(order):
        words[k, : len(blocks[i][2]) // 4] = np.frombuffer(blocks[i][2], "<u4", len(blocks[i][2]) // 4)
    model = _Model(lanes, size, vocabulary)
    code, wide, used = words[:, 0].astype(np.uint64) << _32 | words[:, 1], np.full(lanes, _FULL), np.arange(lanes) * width + 2
    words, most = words.ravel(), (np.arange(lanes) + 1) * width - 1
    for t, n in enumerate(np.searchsorted(-counts, -np.arange(size), side="left").tolist()):
        if t == model.next:
            run, starts, values = _runs(model.ids[:t, :n], vocabulary)
            model.grow(t)
        model.at(t, n)
        unit = wide[:n] // model.total
        now = np.minimum(code[:n] // unit, model.total - _u(1)).astype(np.uint32)
        is2, is1, old = now < model.to2, now < model.to1, now < model.to0
        ids = np.where(is2, model.p[1], model.p[0])
        start, share = np.where(is2, _NONE, model.to2), np.where(is2, model.to2, model.one)
        two, rest = np.flatnonzero(is1 != old), np.flatnonzero(~old)
        if len(two):
            unit0, to1 = model.unit0[two], model.to1[two]
            own = run.take((now[two] - to1) // unit0 + two * model.known)
            first = starts.take(own)
            ids[two], start[two], share[two] = values.take(own), to1 + unit0 * (first - two * model.known).astype(np.uint32), unit0 * (starts.take(own + 1) - first).astype(np.uint32)
        if len(rest):
            each, to0 = model.unit[rest], model.to0[rest]
            value = (now[rest] - to0) // each
            ids[rest], start[rest], share[rest] = value, to0 + each * value, each
        code[:n] -= unit * start
        now = unit * share
        move = np.flatnonzero(now < _LEAST)
        if len(move):
            at = used[move]
            code[move] = code[move] << _32 | words.take(np.minimum(at, most[move]))
            used[move] = at + 1
            now[move] <<= _32
        wide[:n] = now
        model.learn(t, n, ids, model.hits(ids), old)
    ids_of = np.ascontiguousarray(model.ids.T).astype(np.int32)
    parts: list[np.ndarray] = [np.empty(0, np.int32)] * lanes
    for k, i in enumerate(order):
        parts[i] = ids_of[k, : blocks[i][0]]
        if zlib.crc32(parts[i].astype("<u4").tobytes()) != blocks[i][1]:
            raise ValueError("a block's checksum differs")
    return np.concatenate(parts)
