"""An adaptive context-mixing range coder for token ids, in numpy.

A block is coded by itself: everything it adapts starts anew, and a decoder needs nothing but the block's bytes.

Model. Four predictors give a distribution over ids each: order 2 (the ids that followed the last two ids), order 1 (the ids that followed the last id), order 0 (the ids so far) and the uniform
distribution over the alphabet, which alone knows ids that have not come yet. All but the last are the exact counts of what the block has coded before. The mixture gives each predictor a share of the
coder's interval. Shares are learnt in classes of contexts, from how often each predictor has served in the class: a class says how much has been seen behind either context and how uniform that was. An id has
up to four sub-intervals, one for each predictor that knows it; the coder takes the widest.

Lanes. The ids of a block are cut into `lanes` runs of equal length, which share one model and have a range coder each. All lanes are coded in lock-step, so that a step is a few numpy calls
however many ids it codes. Counts are brought up to date when the ids coded so far have grown by GROWTH, shares every SHARE_STEPS steps; in between the model stands still, and so the decoder finds an id by one lookup: a
predictor's table holds one entry for every counted occurrence, in order of context and id, and the coder's value within the context points at one of them.

Order-2 contexts are hashed; both sides use the same hash, so that a collision costs bits and never correctness. The encoder finds an id's counts by a hash table without chains: what is displaced there is coded by another predictor.

Block (little-endian): u32 crc32 of all that follows, u32 number of ids, u32 alphabet, u32 lanes, then 16-bit words in the order in which the decoder wants them.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

GROWTH = 4
SHARE_STEPS = 64
#: The encoder looks ids up so many steps at a time, so that its working arrays stay small.
SLICE_STEPS = 8
MOST_LANES = 2048
#: log2 of the whole that is shared out between the predictors.
SHARE_BITS = 11
_SHARES = 1 << SHARE_BITS
_FIELD = SHARE_BITS + 1
_FIELDS = (1 << _FIELD) - 1
#: Bits of a packed entry: an occurrence is id << 44 | first << 22 | count; a context is base << 32 | total << 10 | class.
_PART = 22
_PARTS, _BOTH = (1 << _PART) - 1, (1 << 2 * _PART) - 1
#: Ids of a block at most, and the largest id.
MOST_IDS, MOST_ID = 1 << 20, (1 << 19) - 2
_CLASSES = 32
#: An order-2 context's class is kept times _CLASSES, so that it adds up with the order-1 context's.
_CLASS_BITS = 10
_CLASS = (1 << _CLASS_BITS) - 1
_HEAD = struct.Struct("<4I")
_LEAST, _WORD = np.uint64(1 << 48), np.uint64(16)
_U11, _U48 = np.uint64(SHARE_BITS), np.uint64(48)


def _shape(n: int) -> tuple[int, int]:
    """(lanes, steps): lane j codes the ids from j * steps on; the last may be shorter."""
    lanes = max(1, min(MOST_LANES, int(round((2 * n) ** 0.5))))
    steps = -(-n // lanes)
    return -(-n // steps), steps


def _epochs(steps: int) -> list[int]:
    """Steps before which the counts are brought up to date: the last time at half of the block."""
    out, at = [], steps // 2
    while at:
        out.append(at)
        at //= GROWTH
    return out


#: The first half of a context's class: by doublings of its occurrences.
_MUCH = np.minimum(np.frexp(np.arange(128, dtype=np.float32))[1], 7).astype(np.int64) * 4 - 3


def _context_class(total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Class of a context by its occurrences, at least one, and its different ids; class 0 is for contexts without any."""
    return _MUCH[np.minimum(total, 127)] + (kinds > 1) + (kinds * 4 > total) * (kinds > 1) + (kinds * 2 > total) * (kinds > 1)


class _Counts:
    """Counts of (context, id) over what has been coded: a table of occurrences, and an entry for each context."""

    def __init__(self, context: np.ndarray, ids: np.ndarray, contexts: int, base: int, times: int, lookup: bool):
        keys = np.sort(context << 20 | ids)
        new = np.empty(len(keys), bool)
        new[0] = True
        np.not_equal(keys[1:], keys[:-1], out=new[1:])
        first = np.flatnonzero(new)
        count = np.diff(first, append=len(keys))
        group = keys[first]
        of = group >> 20
        begin = np.flatnonzero(np.diff(of, prepend=-1))  # first group of each context that occurs
        start = first[begin]
        total = np.diff(start, append=len(keys))
        kinds = np.diff(begin, append=len(group))
        packed = (group & 0xFFFFF) << 2 * _PART | (first - np.repeat(start, kinds)) << _PART | count
        self.entries = np.zeros(contexts, np.int64)
        self.entries[of[begin]] = (start + base) << 32 | total << _CLASS_BITS | _context_class(total, kinds) * times
        if lookup:
            bits = max(4, int(len(group)).bit_length() + 1)
            self.shift = np.uint64(64 - bits)
            at = self._slot(group)
            # of groups that meet in a slot, both assignments keep the last one
            self.group, self.packed = np.full(1 << bits, -1), np.zeros(1 << bits, np.int64)
            self.group[at], self.packed[at] = group, packed & _BOTH
        else:
            self.occurrences = np.repeat(packed, count)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def find(self, context: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """first << 22 | count of each (context, id); 0 if unknown."""
        keys = context << 20
        keys |= ids
        at = self._slot(keys)
        p = self.packed.take(at, mode="clip")
        p *= self.group.take(at, mode="clip") == keys
        return p


class _Model:
    """What encoder and decoder keep alike."""

    def __init__(self, n: int, alphabet: int, lookup: bool):
        self.alphabet, self.lookup = alphabet, lookup
        known = np.arange(_CLASSES) > 0
        self.known = np.zeros((_CLASSES, _CLASSES, 4), bool)
        self.known[..., 0] = known[:, None]
        self.known[..., 1] = known[None, :]
        self.known[..., 3] = True
        self.served = np.zeros((_CLASSES * _CLASSES, 4), np.int64)
        self.uniform = np.arange(alphabet, dtype=np.int64) << 2 * _PART | np.arange(alphabet, dtype=np.int64) << _PART | 1
        self.refresh_counts(np.zeros((0, 0), np.int64))

    def slots(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        h = last * 0x9E3779B1
        h += before * 0x85EBCA6B
        h >>= 12
        h &= self.mask
        return h

    def refresh_counts(self, sym: np.ndarray) -> None:
        """sym[step, lane]: ids coded so far, of the lanes that are full."""
        steps = len(sym)
        self.mask = (1 << max(8, sym.size.bit_length() - 1)) - 1
        if not sym.size:
            self.order2 = self.order1 = None
            self.entries2, self.entries1 = np.zeros(self.mask + 1, np.int64), np.zeros(self.alphabet + 1, np.int64)
            self.entry0 = 0
            self.occurrences, self.base_uniform = self.uniform, 0
        else:
            flat = sym.ravel()
            last, before = np.full_like(sym, self.alphabet), np.full_like(sym, self.alphabet)
            last[1:] = sym[:-1]
            before[2:] = sym[: max(0, steps - 2)]
            last, before = last.ravel(), before.ravel()
            self.order2 = _Counts(self.slots(before, last), flat, self.mask + 1, 0, _CLASSES, self.lookup)
            self.order1 = _Counts(last, flat, self.alphabet + 1, len(flat), 1, self.lookup)
            count = np.bincount(flat, minlength=self.alphabet)
            first = np.cumsum(count) - count
            seen = np.flatnonzero(count)
            if self.lookup:
                self.packed0 = first << _PART | count
            else:
                order0 = np.repeat(seen << 2 * _PART | first[seen] << _PART | count[seen], count[seen])
                self.occurrences = np.concatenate([self.order2.occurrences, self.order1.occurrences, order0, self.uniform])
            self.entries2, self.entries1 = self.order2.entries, self.order1.entries
            self.entry0 = 2 * len(flat) << 32 | len(flat) << _CLASS_BITS
            self.base_uniform = 3 * len(flat)
            self.known[..., 2] = True
        self.entry_uniform = self.base_uniform << 32 | self.alphabet << _CLASS_BITS
        self.refresh_shares()

    def refresh_shares(self) -> None:
        """Bounds of the four shares in each class, packed; the uniform one never is empty."""
        known = self.known.reshape(-1, 4)
        weight = np.where(known, self.served * 16 + np.array([12, 8, 8, 1]), 0)
        room = _SHARES - 4
        share = weight * room // weight.sum(axis=1, keepdims=True) + known
        share[:, 3] += _SHARES - share.sum(axis=1)
        ends = np.cumsum(share, axis=1)
        if self.lookup:  # how wide a share is for one occurrence; the contexts' totals come later
            self.wide = share.T.astype(np.float32)
            self.wide[2] /= max(1, self.entry0 >> _CLASS_BITS & _PARTS)
            self.wide[3] /= self.alphabet
        self.bounds = ends[:, 0] << _FIELD | ends[:, 1] << 2 * _FIELD | ends[:, 2] << 3 * _FIELD | _SHARES << 4 * _FIELD

    def learn(self, served: np.ndarray) -> None:
        """served: class * 4 + predictor of each id."""
        self.served += np.bincount(served, minlength=self.served.size).reshape(-1, 4)


def _turns(steps: int) -> list[tuple[int, int, bool]]:
    """(first step, step behind the last, whether counts are brought up to date before it)."""
    fresh = set(_epochs(steps))
    cuts = sorted(fresh | set(range(0, steps, SHARE_STEPS)) | {steps})
    return [(a, b, a in fresh) for a, b in zip(cuts, cuts[1:])]


def encode_block(ids: np.ndarray) -> bytes:
    """ids: at most MOST_IDS whole numbers up to MOST_ID."""
    n = len(ids)
    if not n:
        return _sealed(_HEAD.pack(0, 0, 0, 0), b"")
    if n > MOST_IDS or int(ids.max()) > MOST_ID:
        raise ValueError("a block holds fewer or smaller ids")
    alphabet = int(ids.max()) + 1
    lanes, steps = _shape(n)
    sym = np.zeros(lanes * steps, np.int64)
    sym[:n] = ids
    sym = np.ascontiguousarray(sym.reshape(lanes, steps).T)
    full = n // steps
    model = _Model(n, alphabet, True)
    ctx = np.full((2 + steps, lanes), alphabet, np.int64)
    ctx[2:] = sym
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    out = np.zeros((lanes, 2 * steps + 8), np.uint16)
    pos = np.zeros(lanes, np.int64)
    emitted: list[np.ndarray] = []
    served = np.zeros((SHARE_STEPS, lanes), np.int64)
    for a, b, fresh in _turns(steps):
        if fresh:
            model.refresh_counts(sym[:a, :full])
        elif a:
            model.refresh_shares()
        for c in range(a, b, SLICE_STEPS):
            d = min(b, c + SLICE_STEPS)
            begin, share, first, count, total = _intervals(model, ctx[c : d + 2], sym[c:d], served[c - a : d - a])
            for k in range(d - c):
                live = -(-(n - c - k) // steps)  # lanes that have an id at this step
                lo, sp = low[:live], span[:live]
                r = sp >> _U11
                new = begin[k, :live] * r
                new += lo
                r *= share[k, :live]
                r //= total[k, :live]
                new += first[k, :live] * r
                over = np.flatnonzero(new < lo)
                if len(over):
                    _carry(out, over, pos)
                lo[:] = new
                np.multiply(count[k, :live], r, out=sp)
                need = np.flatnonzero(sp < _LEAST)
                while len(need):
                    x = lo[need]
                    at = pos[need]
                    out[need, at] = x >> _U48
                    pos[need] = at + 1
                    lo[need] = x << _WORD
                    s = sp[need] << _WORD
                    sp[need] = s
                    emitted.append(need)
                    need = need[s < _LEAST]
        model.learn(served[: b - a, :full].ravel())
    events = pos.copy()
    every = np.arange(lanes)
    for _ in range(4):
        out[every, pos] = (low >> np.uint64(48)).astype(np.uint16)
        low <<= _WORD
        pos += 1
    # the decoder starts with four words of each lane and wants one more for each word that was emitted, in that order
    parts = [out[:, :4].ravel()]
    if emitted:
        lane = np.concatenate(emitted)
        order = np.argsort(lane.astype(np.uint16), kind="stable")
        nth = np.empty(len(lane), np.int64)
        nth[order] = np.arange(len(lane)) - np.repeat(np.cumsum(events) - events, events)
        parts.append(out[lane, nth + 4])
    return _sealed(_HEAD.pack(0, n, alphabet, lanes), np.concatenate(parts).astype("<u2").tobytes())


def _sealed(head: bytes, words: bytes) -> bytes:
    body = head[4:] + words
    return struct.pack("<I", zlib.crc32(body)) + body


def _intervals(model: _Model, ctx: np.ndarray, sym: np.ndarray, served: np.ndarray):
    """For sym[step, lane] under the model as it stands: the interval of the predictor with the widest one. Puts class * 4 + predictor into served."""
    shape = sym.shape
    x, last, before = sym.ravel(), ctx[1:-1].ravel(), ctx[:-2].ravel()
    slot = model.slots(before, last)
    e2, e1 = model.entries2.take(slot, mode="clip"), model.entries1.take(last, mode="clip")
    classes = e2 + e1 & _CLASS
    if model.order1 is None:
        predictor, entry, found = np.full(len(x), 3, np.int64), np.full_like(x, model.entry_uniform), x << _PART | 1
    else:
        widest = model.wide[3].take(classes, mode="clip")
        predictor, entry, found = np.full(len(x), 3, np.int8), np.full_like(x, model.entry_uniform), x << _PART | 1
        for k, f, e in ((2, model.packed0.take(x, mode="clip"), model.entry0), (1, model.order1.find(last, x), e1), (0, model.order2.find(slot, x), e2)):
            wide = model.wide[k].take(classes, mode="clip")
            wide *= f & _PARTS
            if k < 2:
                wide /= np.maximum(e >> _CLASS_BITS & _PARTS, 1)
            better = wide > widest
            if k:  # the last one's width is not asked again
                np.copyto(widest, wide, where=better)
            np.copyto(predictor, k, where=better)
            np.copyto(entry, e, where=better)
            np.copyto(found, f, where=better)
        predictor = predictor.astype(np.int64)
    np.add((classes * 4).reshape(shape), predictor.reshape(shape), out=served)
    at = predictor * _FIELD
    ends = model.bounds.take(classes, mode="clip") >> at
    begin = ends & _FIELDS
    ends >>= _FIELD
    ends &= _FIELDS
    ends -= begin
    entry >>= _CLASS_BITS
    entry &= _PARTS
    u = lambda v: v.view(np.uint64).reshape(shape)
    return u(begin), u(ends), u(found >> _PART), u(found & _PARTS), u(entry)


def _carry(out: np.ndarray, lanes: np.ndarray, pos: np.ndarray) -> None:
    at = pos[lanes] - 1
    while len(lanes):
        out[lanes, at] += np.uint16(1)
        more = out[lanes, at] == 0
        lanes, at = lanes[more], at[more] - 1


def decode_block(data: bytes) -> np.ndarray:
    """The ids, u32. Raises ValueError where the checksum doesn't hold."""
    crc, n, alphabet, lanes = _HEAD.unpack_from(data)
    if zlib.crc32(memoryview(data)[4:]) != crc:
        raise ValueError("damaged block")
    if not n:
        return np.zeros(0, np.uint32)
    steps = -(-n // lanes)
    full = n // steps
    words = np.concatenate([np.frombuffer(data, "<u2", offset=_HEAD.size), np.zeros(8, np.uint16)]).astype(np.uint64)
    model = _Model(n, alphabet, False)
    first = words[: 4 * lanes].reshape(lanes, 4)
    off = first[:, 0] << np.uint64(48) | first[:, 1] << np.uint64(32) | first[:, 2] << _WORD | first[:, 3]
    at = 4 * lanes
    span = np.full(lanes, (1 << 64) - 1, np.uint64)
    sym = np.zeros((steps, lanes), np.int64)
    last = before = np.full(lanes, alphabet, np.int64)
    for a, b, fresh in _turns(steps):
        if fresh:
            model.refresh_counts(sym[:a, :full])
        elif a:
            model.refresh_shares()
        entries2, entries1, bounds, occurrences = model.entries2, model.entries1, model.bounds, model.occurrences
        entry0, entry_uniform = model.entry0, model.entry_uniform
        seen = np.zeros((b - a, lanes), np.int64)
        for k in range(a, b):
            live = -(-(n - k) // steps)
            l1, l2 = last[:live], before[:live]
            e2, e1 = entries2.take(model.slots(l2, l1), mode="clip"), entries1.take(l1, mode="clip")
            classes = e2 + e1 & _CLASS
            ends = bounds.take(classes, mode="clip")
            o, s = off[:live], span[:live]
            r = s >> _U11
            v = (o // r).view(np.int64)  # below _SHARES, as what the encoder leaves over is never used
            below1 = v >= (ends >> _FIELD & _FIELDS)
            below2 = v >= (ends >> 2 * _FIELD & _FIELDS)
            below3 = v >= (ends >> 3 * _FIELD & _FIELDS)
            entry = np.where(below1, e1, e2)
            entry[below2] = entry0
            entry[below3] = entry_uniform
            predictor = below1.view(np.int8) + below2.view(np.int8) + below3.view(np.int8)
            ends >>= predictor.astype(np.int64) * _FIELD
            begin = ends & _FIELDS
            o -= begin.view(np.uint64) * r
            ends >>= _FIELD
            ends &= _FIELDS
            ends -= begin
            r *= ends.view(np.uint64)
            total = (entry >> _CLASS_BITS & _PARTS).view(np.uint64)
            r //= total
            u = (o // r).view(np.int64)
            u += entry >> 32
            hit = occurrences.take(u, mode="clip")
            o -= (hit >> _PART & _PARTS).view(np.uint64) * r
            np.multiply((hit & _PARTS).view(np.uint64), r, out=s)
            x = sym[k, :live]
            np.right_shift(hit, 2 * _PART, out=x)
            seen[k - a, :live] = classes * 4 + predictor
            need = np.flatnonzero(s < _LEAST)
            while len(need):
                o[need] = o[need] << _WORD | words[at : at + len(need)]
                at += len(need)
                w = s[need] << _WORD
                s[need] = w
                need = need[w < _LEAST]
            before, last = last, sym[k]
        model.learn(seen[:, :full].ravel())
    return sym.T.reshape(-1)[:n].astype(np.uint32)
