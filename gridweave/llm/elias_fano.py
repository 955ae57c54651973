"""Elias-Fano sequences in memory-mapped files, searched in whole arrays of queries."""

from __future__ import annotations

import json
import os
import uuid

import numpy as np

_BLOCK = 512
#: One byte in each of a word's eight; and for every byte value and k, where its k-th one is (8: it has fewer).
_EVEN, _PAIRS, _HALVES, _EACH, _TOP = (np.uint64(x * 0x0101010101010101) for x in (0x55, 0x33, 0x0F, 0x01, 0x80))
_ONE = np.uint64(1)
_NTH = np.full((256, 8), 8, np.uint8)
for _b in range(256):
    _at = [i for i in range(8) if _b >> i & 1]
    _NTH[_b, : len(_at)] = _at


def save(path: str, arrays: dict[str, np.ndarray], **facts) -> None:
    """Arrays and facts in one file that can be mapped; written under another name first,
    so a task that is run again or twice leaves one whole file."""
    head, at = {"facts": facts, "arrays": {}}, 0
    for k, a in arrays.items():
        head["arrays"][k] = [at, len(a), a.dtype.str]
        at += -(-a.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 8)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(len(text).to_bytes(8, "little") + text)
        for a in arrays.values():
            f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
    os.replace(part, path)


def load(path: str) -> tuple[dict[str, np.ndarray], dict]:
    """The file's arrays, as views of the mapped file, and its facts."""
    raw = np.memmap(path, np.uint8, "r").view(np.ndarray)
    n = int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8 : 8 + n].tobytes())
    out = {}
    for k, (at, size, kind) in head["arrays"].items():
        kind = np.dtype(kind)
        out[k] = raw[8 + n + at : 8 + n + at + size * kind.itemsize].view(kind)
    return out, head["facts"]


def build(values: np.ndarray, name: str) -> tuple[dict[str, np.ndarray], dict]:
    """Arrays and facts of a non-decreasing sequence of unsigned 64-bit integers: the high
    halves as a bit string in unary, the low bits packed, and the ones before each block."""
    n, top = len(values), int(values[-1]) if len(values) else 0
    low = max(0, ((top + 1) // max(n, 1)).bit_length() - 1)
    high = (values >> np.uint64(low)).astype(np.int64)
    size = n + (top >> low) + 1
    bits = np.zeros(-(-size // _BLOCK) * _BLOCK, bool)
    bits[high + np.arange(n)] = True
    words = np.packbits(bits, bitorder="little").view(np.uint64)
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words).reshape(-1, _BLOCK // 64).sum(1, dtype=np.int64))])
    packed = []
    step = 8 * 65_536
    for at in range(0, n if low else 0, step):
        part = values[at : at + step]
        packed.append(np.packbits(((part[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(bool), bitorder="little"))
    lows = np.concatenate([*packed, np.zeros(16, np.uint8)])
    lows = lows[: len(lows) // 8 * 8].view(np.uint64)
    return {f"{name}.high": words, f"{name}.low": lows, f"{name}.ones": ones.astype(np.int64)}, {f"{name}.n": n, f"{name}.bits": low, f"{name}.top": top}


class EliasFano:
    """A sequence in mapped arrays."""

    def __init__(self, arrays: dict, facts: dict, name: str):
        self.words, self.lows, self.ones = (arrays[f"{name}.{k}"] for k in ("high", "low", "ones"))
        self.n, self.bits, self.top = (facts[f"{name}.{k}"] for k in ("n", "bits", "top"))
        self._upto: dict[bool, np.ndarray] = {}
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * _BLOCK - self.ones

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Where the k-th (from 0) one or zero of the high bits is."""
        if len(k) * 4 > len(self.words):  # as many as words: all of them are counted once
            if ones not in self._upto:
                self._upto[ones] = np.cumsum(np.bitwise_count(self.words if ones else ~self.words), dtype=np.int64)
            upto = self._upto[ones]
            at = np.searchsorted(upto, k, "right")
            left = k - np.where(at > 0, upto[np.maximum(at - 1, 0)], 0)
        else:
            before = self.ones if ones else self.zeros
            block = np.searchsorted(before, k, "right") - 1
            left = k - before[block]
            words = self.words[block[:, None] * (_BLOCK // 64) + np.arange(_BLOCK // 64)]
            upto = np.cumsum(np.bitwise_count(words if ones else ~words), 1, dtype=np.int64)
            at = (upto <= left[:, None]).sum(1)
            left = left - np.where(at > 0, upto[np.arange(len(k)), np.maximum(at - 1, 0)], 0)
            at += block * (_BLOCK // 64)
        word, left = self.words[at] if ones else ~self.words[at], left.astype(np.uint64)
        # ones up to each byte of a word, in the word's bytes, and how many of them are too few
        upto = word - ((word >> np.uint64(1)) & _EVEN)
        upto = (upto & _PAIRS) + ((upto >> np.uint64(2)) & _PAIRS)
        upto = ((upto + (upto >> np.uint64(4))) & _HALVES) * _EACH
        shift = np.bitwise_count(((left * _EACH | _TOP) - upto) & _TOP).astype(np.uint64) << np.uint64(3)
        left -= ((upto << np.uint64(8)) >> shift) & np.uint64(255)
        return at * 64 + shift.astype(np.int64) + _NTH[((word >> shift) & np.uint64(255)).astype(np.int64), left.astype(np.int64)]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        p = i * self.bits
        w, s = p >> 6, (p & 63).astype(np.uint64)
        out = self.lows[w] >> s
        more = np.minimum(w + 1, len(self.lows) - 1)
        out |= np.where(s > 0, self.lows[more] << ((np.uint64(64) - s) & np.uint64(63)), np.uint64(0))
        return out & np.uint64((1 << self.bits) - 1)

    def at(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, True) - i).astype(np.uint64) << np.uint64(self.bits)) | self._low(i)

    def _after(self, at: np.ndarray, k: np.ndarray, ones: bool) -> np.ndarray:
        """Where the k-th one or zero is, which is the first after the places ``at``: mostly in
        the same word."""
        at = at + 1
        word = self.words[np.minimum(at >> 6, len(self.words) - 1)]
        word = (word if ones else ~word) >> (at & 63).astype(np.uint64)
        out = at + np.bitwise_count((word & (~word + _ONE)) - _ONE)
        far = np.flatnonzero((word == 0) | (at >= len(self.words) * 64))
        if len(far):
            out[far] = self._select(k[far], ones)
        return out

    def range(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at i and at i + 1."""
        first = self._select(i, True)
        then, shift = self._after(first, i + 1, True), np.uint64(self.bits)
        return ((first - i).astype(np.uint64) << shift) | self._low(i), ((then - i - 1).astype(np.uint64) << shift) | self._low(i + 1)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the first value >= x is (the length, if none), and whether it equals x."""
        where, same = np.full(len(x), self.n, np.int64), np.zeros(len(x), bool)
        ask = np.flatnonzero(x <= np.uint64(self.top)) if self.n else np.zeros(0, np.int64)
        if not len(ask):
            return where, same
        q = x[ask]
        h, low = (q >> np.uint64(self.bits)).astype(np.int64), q & np.uint64((1 << self.bits) - 1)
        zero = self._select(np.maximum(h - 1, 0), False)
        zero[h == 0] = -1
        lo, hi = zero - (h - 1), self._after(zero, h, False) - h
        end, hit = hi.copy(), np.zeros(len(q), bool)
        # by halves where many values share their high bits, then one by one
        open_ = np.flatnonzero(hi - lo > 4)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < low[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[hi[open_] - lo[open_] > 4]
        open_ = np.flatnonzero(lo < end)
        while len(open_):
            got, want = self._low(lo[open_]), low[open_]
            hit[open_[got == want]] = True
            open_ = open_[got < want]
            lo[open_] += 1
            open_ = open_[lo[open_] < end[open_]]
        where[ask], same[ask] = lo, hit
        return where, same
