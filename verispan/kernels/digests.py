"""MD5 of many short texts at once, in numpy: the first 32 bits of each digest.

The texts are prefixes, one per row, each followed by the same suffix. Rows of one
length share the layout of the block, so what is the same in all rows stays a
number and only words with bytes of a prefix are arrays. A comparison with a bound
is settled by 32 bits but for the rows that meet the bound's own 32 bits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa

_K = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_S = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_G = [[i, (5 * i + 1) % 16, (3 * i + 5) % 16, 7 * i % 16][i // 16] for i in range(64)]
_INIT = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
ROWS = 32768  # of a block at most: fewer pay for the calls, more leave the cache
_BYTES = 2**22  # of the texts of a block at most, as it is one value of a row on its way to Java
_MASK = 2**32 - 1
_NUMBER = lambda x: np.array(x & _MASK, np.uint32)
_LEFT = [_NUMBER(_S[i // 16][i % 4]) for i in range(64)]
_RIGHT = [_NUMBER(32 - _S[i // 16][i % 4]) for i in range(64)]


_TOP, _UNSETTLED = np.array(18, np.uint32), 255


class Bounds:
    """Bounds in (0, 1), at most 254, and how many of them the numbers with given first 14 bits reach."""

    def __init__(self, of: Sequence[float]):
        self.of = sorted(of)
        at = np.arange(2**14)
        low, high = (np.searchsorted(np.array(self.of), v, "right") for v in (at / 2**14, (at + 1) / 2**14 - 2**-53))
        self.table = np.where(low == high, low, _UNSETTLED).astype(np.uint8)


class Block:
    """Rows of one prefix length; ``rows`` are their places in the array they come from."""

    def __init__(self, rows: np.ndarray, prefixes: np.ndarray):
        self.rows, self.n, self.length, self.prefixes = rows, len(rows), prefixes.shape[1], prefixes
        padded = np.zeros((self.n, -(-self.length // 4) * 4), np.uint8)
        padded[:, : self.length] = prefixes
        self._words = list(np.ascontiguousarray(padded.view("<u4").T.astype(np.uint32))) if self.length else []
        self._own = [np.empty(self.n, np.uint32) for _ in range(4)]
        self._t, self._u, self._x = (np.empty(self.n, np.uint32) for _ in range(3))
        # steps that see words of the prefix alone are the same for all suffixes
        self._first = min(self.length // 4, 14)
        state = [np.full(self.n, v, np.uint32) for v in _INIT]
        self._state = self._steps(state, range(self._first), [0] * 16, [np.empty(self.n, np.uint32) for _ in range(4)])

    def _steps(self, state: Sequence[np.ndarray], steps: range, numbers: Sequence[int], own: Sequence[np.ndarray]) -> list[np.ndarray]:
        a, b, c, d = state
        t, u, x, words = self._t, self._u, self._x, self._words
        xor, both, either, plus, left, right = np.bitwise_xor, np.bitwise_and, np.bitwise_or, np.add, np.left_shift, np.right_shift
        for i in steps:
            j = _G[i]
            if i < 16:
                xor(c, d, t), both(t, b, t), xor(t, d, t)
            elif i < 32:
                xor(b, c, t), both(t, d, t), xor(t, c, t)
            elif i < 48:
                if i % 2:
                    xor(x, b, t)  # x is the xor of the two before
                else:
                    xor(b, c, x), xor(x, d, t)
            else:
                np.invert(d, t), either(t, b, t), xor(t, c, t)
            plus(t, a, t), plus(t, _NUMBER(_K[i] + numbers[j]), t)
            if j < len(words):
                plus(t, words[j], t)
            right(t, _RIGHT[i], u), left(t, _LEFT[i], t), either(t, u, t)
            out = own[i % 4]
            plus(t, b, out)
            a, b, c, d = d, out, b, c
        return [a, b, c, d]

    def heads(self, suffix: bytes) -> np.ndarray:
        """The first 32 bits of each row's digest as a number; good until the next call."""
        n = self.length + len(suffix)
        if n > 55:  # more than one block of MD5
            return np.array([int.from_bytes(hashlib.md5(p.tobytes() + suffix).digest()[:4]) for p in self.prefixes], np.uint32)
        rest = bytes(self.length) + suffix + b"\x80" + bytes(55 - n) + (8 * n).to_bytes(8, "little")
        numbers = [int(v) for v in np.frombuffer(rest, "<u4")]
        # the first word of the state is written for the last time in the 61st step
        _, b, _, _ = self._steps(self._state, range(self._first, 61), numbers, self._own)
        return np.add(b, _NUMBER(_INIT[0]), self._t).byteswap(inplace=True)

    def exact(self, row: int, suffix: bytes) -> float:
        """The uniform number of one row: the first 52 bits of its digest."""
        return int(hashlib.md5(self.prefixes[row].tobytes() + suffix).hexdigest()[:13], 16) / 2**52

    def counts(self, suffix: bytes, bounds: Bounds) -> np.ndarray:
        """For each row the number of bounds that its uniform number reaches."""
        h = self.heads(suffix)
        out = bounds.table[np.right_shift(h, _TOP, self._u)]
        for r in np.flatnonzero(out == _UNSETTLED):
            k = int(h[r])
            low, high = (sum(b <= v for b in bounds.of) for v in (k / 2**32, (k + 1) / 2**32 - 2**-53))
            out[r] = low if low == high else sum(self.exact(r, suffix) >= b for b in bounds.of)
        return out


def _by_length(prefixes: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places and bytes of the rows of each length of an Arrow array of texts (no nulls)."""
    a = prefixes.cast(pa.large_binary())
    if not len(a):
        return
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8)
    lengths = np.diff(offsets)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield rows, data[offsets[rows][:, None] + np.arange(n)] if n else np.empty((len(rows), 0), np.uint8)


def blocks(prefixes: pa.Array) -> Iterator[Block]:
    """The rows of an Arrow array of texts (no nulls) in blocks of one length."""
    for rows, data in _by_length(prefixes):
        for at in range(0, len(rows), ROWS):
            yield Block(rows[at : at + ROWS], data[at : at + ROWS])


def filled(parts: Iterable[tuple[pa.Array, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bytes and values of rows of one length, ROWS of them (of long texts fewer), from texts and values that come in parts.

    Rows of a length wait until they fill a block, so a task makes one unfilled block
    for each length and not one for each length and part.
    """
    waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for prefixes, values in parts:
        for rows, data in _by_length(prefixes):
            full = min(ROWS, max(1, _BYTES // (data.shape[1] + 1)))
            held = waiting.setdefault(data.shape[1], [])
            held.append((data, values[rows]))
            if sum(len(d) for d, _ in held) < full:
                continue
            all_data, all_values = (np.concatenate(x) for x in zip(*held))
            end = len(all_data) // full * full
            for at in range(0, end, full):
                yield all_data[at : at + full], all_values[at : at + full]
            waiting[data.shape[1]] = [(all_data[end:], all_values[end:])] if end < len(all_data) else []
    for held in waiting.values():
        if held:
            data, values = (np.concatenate(x) for x in zip(*held))
            yield data, values
