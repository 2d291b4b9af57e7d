"""Hashed-context bit predictors and their gated logistic mixing, in numpy over batches of words.

A word and its end mark are bytes; a byte is a path of bits in a prefix code made from the
training bytes, so frequent bytes take few bits. Each bit is predicted from several contexts
(the class of the place and the bytes before it in the word). A context and the bits before it in
the byte hash to a slot that counts zeros and ones. The predictions, stretched, are mixed with
weights that are chosen by how much the richest contexts know (the gate), learned online by
gradient steps, and refined by an adaptive map from (bits before, mixed prediction) to counts.

Every probability is of the next bit given what comes before it, so words' probabilities sum to 1.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

END = 32  # the end mark: never inside a word
#: log2 of the slots of each context's table; the last two see the whole word so far.
SLOTS = (20, 21, 22, 22, 22)
#: Rows of the table of words up to which these do; with each doubling all grow by one, at most GROWTH times (252 MB, broadcast).
ROWS, GROWTH = 1 << 22, 3
INPUTS = len(SLOTS)
LEVELS = 6  # levels of knowledge of one context
GATES = LEVELS * LEVELS * 3
BINS = 32
LIMIT, FORGET, RIDGE = 12.0, 0.98, 2.0
START = np.array([0.15, 0.15, 0.15, 0.3, 0.3])  # weights to begin with
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_R = np.uint64(0x2545F4914F6CDD1D)
_R_BACK = np.uint64(pow(0x2545F4914F6CDD1D, -1, 2**64))


def sizes_for(rows: int) -> tuple[int, ...]:
    """log2 of the slots of each context's table for so many distinct words."""
    more = min(GROWTH, max(0, (max(rows, 1) - 1) // ROWS).bit_length())
    return tuple(s + more for s in SLOTS)


def prefix_code(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length and bits of each byte's code (Huffman, every byte taken as seen once more)."""
    heap = [(int(c) + 1, b, (b,)) for b, c in enumerate(counts)]
    heapq.heapify(heap)
    code = {b: "" for b in range(256)}
    number = 256
    while len(heap) > 1:
        (c0, _, zero), (c1, _, one) = heapq.heappop(heap), heapq.heappop(heap)
        for b in zero:
            code[b] = "0" + code[b]
        for b in one:
            code[b] = "1" + code[b]
        heapq.heappush(heap, (c0 + c1, number, zero + one))
        number += 1
    return np.array([len(code[b]) for b in range(256)]), np.array([int(code[b], 2) for b in range(256)], np.uint64)


class Bits:
    """The bits of a batch of words, depth by depth of the code, with their hashed contexts."""

    def __init__(self, words: list[bytes], classes: np.ndarray, code: tuple[np.ndarray, np.ndarray], sizes: tuple[int, ...] = SLOTS):
        self.sizes = sizes
        self.raw = np.frombuffer(b" ".join(words) + b" ", np.uint8)
        size = np.array([len(w) + 1 for w in words])
        self.start = np.cumsum(size) - size
        self.word = np.repeat(np.arange(len(words)), size)
        inside = np.arange(len(self.raw)) - self.start[self.word]
        self.length, self.bits = code[0][self.raw], code[1][self.raw]
        byte = self.raw.astype(np.uint64) + np.uint64(1)
        before = [np.zeros(len(byte), np.uint64) for _ in range(5)]
        for k in range(5):
            before[k][k + 1 :] = byte[: -k - 1]
            before[k][inside <= k] = 0
        with np.errstate(over="ignore"):
            power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(byte) - 1, _R))), dtype=np.uint64)
            back = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(byte) - 1, _R_BACK))), dtype=np.uint64)
            total = np.concatenate(([np.uint64(0)], np.cumsum(byte * power, dtype=np.uint64)[:-1]))
            whole = (total - total[self.start][self.word]) * back[self.start][self.word]
            c = (classes.astype(np.uint64) + np.uint64(1))[self.word]
            b1, b2, b3, b4, b5 = before
            self.contexts = [
                ((b1 * _M[0] + b2) * _M[1] + c) * _M[2],
                (((b1 * _M[0] + b2) * _M[1] + b3) * _M[2] + c) * _M[3],
                (((((b1 * _M[0] + b2) * _M[1] + b3) * _M[2] + b4) * _M[3] + b5) * _M[0] + c) * _M[1],
                whole * _M[2] + np.minimum(inside, 15).astype(np.uint64),
                (whole * _M[0] + c) * _M[3],
            ]

    def depths(self):
        """(places, node, bit, slots of each context) for each depth of the code."""
        for d in range(int(self.length.max())):
            at = np.flatnonzero(self.length > d)
            rest = (self.length[at] - d - 1).astype(np.uint64)
            node = (self.bits[at] >> (rest + np.uint64(1))) | (np.uint64(1) << np.uint64(d))
            bit = ((self.bits[at] >> rest) & np.uint64(1)).astype(np.int64)
            with np.errstate(over="ignore"):
                mixed = node * _M[3]
                slots = [(((x[at] ^ mixed) * _M[0]) >> np.uint64(64 - s)).astype(np.int64) for x, s in zip(self.contexts, self.sizes, strict=True)]
            yield at, node, bit, slots


def count_bits(bits: Bits, weight: np.ndarray, tables: list[np.ndarray]) -> None:
    """Add the words' counts to each context's (zeros, ones) by slot."""
    for at, _, bit, slots in bits.depths():
        w = weight[bits.word[at]].astype(np.float32)
        for t, s in zip(tables, slots, strict=True):
            np.add.at(t, 2 * s + bit, w)


#: A count takes a byte: exact to 16, then eight steps to each doubling, to the nearest.
_VALUES = np.concatenate((np.arange(16), [(8 + m) * 2.0**e for e in range(1, 31) for m in range(8)])).astype(np.float32)


def pack_counts(n: np.ndarray) -> np.ndarray:
    """Zeros and ones (neighbours in ``n``) of each slot as one 16-bit number."""
    codes = np.searchsorted((_VALUES[1:] + _VALUES[:-1]) / 2, n).astype(np.uint8)
    return codes.view("<u2")


def _lookups() -> tuple[np.ndarray, np.ndarray]:
    """By (bit, packed slot), the bit's own occurrence taken out, and last by the slot as it is: prediction, level."""
    pair = np.arange(65536)
    zero, one = _VALUES[pair & 255], _VALUES[pair >> 8]
    cases = [(np.maximum(zero - (zero <= 16), 0), one), (zero, np.maximum(one - (one <= 16), 0)), (zero, one)]
    stretch = [np.clip(np.log((b + 0.05) / (a + 0.05)), -LIMIT, LIMIT) for a, b in cases]
    level = [np.minimum(np.log2(1 + a + b) / 2, LEVELS - 1) for a, b in cases]
    return np.concatenate(stretch).astype(np.float32), np.concatenate(level).astype(np.uint8)


_STRETCH, _LEVEL = _lookups()


@dataclass
class Mixer:
    code: tuple[np.ndarray, np.ndarray]
    tables: list[np.ndarray]  # packed slots of each context
    weights: np.ndarray  # by gate and input
    map_counts: np.ndarray  # zeros and ones by (place of the bits before, bin)
    curve: np.ndarray  # running curvature by gate, for the size of a step

    @staticmethod
    def start(code, tables) -> Mixer:
        centres = 1 / (1 + np.exp(-((np.arange(BINS) + 0.5) / BINS * 2 - 1) * LIMIT))
        first = np.stack([1 - centres, centres], axis=1) * 4
        return Mixer(code, tables, np.tile(START, (GATES, 1)), np.tile(first, (1024, 1, 1)), np.tile(RIDGE * np.eye(INPUTS), (GATES, 1, 1)))

    @property
    def sizes(self) -> tuple[int, ...]:
        return tuple(len(t).bit_length() - 1 for t in self.tables)

    def copy(self) -> Mixer:
        """The same tables, own weights and map."""
        return Mixer(self.code, self.tables, self.weights.copy(), self.map_counts.copy(), self.curve.copy())

    def _look(self, slots: list[np.ndarray], case: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """Stretched predictions by input, and the gate; case 0 or 1: less that bit once, 2: all that was counted."""
        x, level = np.empty((INPUTS, len(slots[0])), np.float32), []
        case = case * 65536
        for k, (t, s) in enumerate(zip(self.tables, slots, strict=True)):
            at = t[s].astype(np.int64) + case
            x[k] = _STRETCH[at]
            if k >= 2:
                level.append(_LEVEL[at].astype(np.int64))
        return x, (level[1] * LEVELS + level[2]) * 3 + np.minimum(level[0], 2)

    def _mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        weights = self.weights.astype(np.float32)
        return np.clip(sum(weights[:, k][gate] * x[k] for k in range(INPUTS)), -LIMIT, LIMIT)

    def _bin(self, node: np.ndarray, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            place = ((node * _M[0]) >> np.uint64(54)).astype(np.int64)
        return place, np.minimum(((mixed / LIMIT + 1) / 2 * BINS).astype(np.int64), BINS - 1)

    def learn(self, bits: Bits, weight: np.ndarray) -> None:
        """One online step on a batch: a damped Newton step for each gate's weights, with a curvature that forgets."""
        grad, curve = np.zeros((GATES, INPUTS)), np.zeros((GATES, INPUTS, INPUTS))
        for at, node, bit, slots in bits.depths():
            w = weight[bits.word[at]]
            x, gate = self._look(slots, bit)
            mixed = self._mixed(x, gate)
            p = 1 / (1 + np.exp(-mixed))
            error, bend = (bit - p) * w, np.maximum(p * (1 - p), 1e-4) * w
            for k in range(INPUTS):
                grad[:, k] += np.bincount(gate, error * x[k], minlength=GATES)
                for j in range(k + 1):
                    curve[:, k, j] += np.bincount(gate, bend * x[k] * x[j], minlength=GATES)
            np.add.at(self.map_counts, (*self._bin(node, mixed), bit), w)
        curve += np.tril(curve, -1).transpose(0, 2, 1)
        self.curve = FORGET * self.curve + curve
        self.weights += np.linalg.solve(self.curve + RIDGE * np.eye(INPUTS), grad[:, :, None])[:, :, 0]

    def bits_of(self, bits: Bits, n: int) -> np.ndarray:
        """Cost of each of the ``n`` words in bits."""
        cost = np.zeros(n)
        for at, node, bit, slots in bits.depths():
            x, gate = self._look(slots, 2)
            mixed = self._mixed(x, gate)
            place, bin_ = self._bin(node, mixed)
            seen = self.map_counts[place, bin_]
            p = 0.5 / (1 + np.exp(-mixed)) + 0.5 * seen[:, 1] / seen.sum(axis=1)
            p = np.clip(np.where(bit == 1, p, 1 - p), 1e-7, 1 - 1e-7)
            cost += np.bincount(bits.word[at], -np.log2(p), minlength=n)
        return cost
