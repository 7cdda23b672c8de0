"""Bootstrap draws hashed by MD5, many at once: which row the draw j of a resample b takes."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Draws hashed at once: what they need stays in a core's cache.
AT_ONCE = 16_384


def adder() -> Callable:
    """The function `sums`, which takes the ones it needs to a worker along with it."""

    def first_word(lead: bytes, *numbers: tuple[np.ndarray, int]) -> np.ndarray:
        """The first 8 hex digits, as a number, of the MD5 of lead and the numbers in decimal, with a hyphen between them.

        numbers: arrays that broadcast together, each of numbers with so many digits.
        """
        text, digits = bytearray(lead), []
        for k, (values, width) in enumerate(numbers):
            text += b"-" * (k > 0)
            digits += [(len(text) + p, (values // 10 ** (width - 1 - p) % 10).astype(np.uint32) + np.uint32(48)) for p in range(width)]
            text += bytes(width)
        size = len(text)
        text += b"\x80" + bytes((55 - size) % 64) + (8 * size).to_bytes(8, "little")
        words = list(np.frombuffer(bytes(text), "<u4"))
        for at, digit in digits:
            words[at // 4] = words[at // 4] + (digit << np.uint32(8 * (at % 4)))
        shape = np.broadcast_shapes(*(values.shape for values, _ in numbers))
        state = [np.full(shape, x, np.uint32) for x in START]
        f, t = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
        for block in range(0, len(words), 16):
            a, b, c, d = (x.copy() for x in state)
            for i in range(64):
                if i < 16:
                    np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
                elif i < 32:
                    np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
                elif i < 48:
                    np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
                else:
                    np.bitwise_not(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
                word = words[block + (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16]
                # the sum of what is fixed is one number
                fixed = np.uint32((int(word) + SINES[i]) & 0xFFFFFFFF) if np.ndim(word) == 0 else word + np.uint32(SINES[i])
                np.add(a, f, out=a), np.add(a, fixed, out=a)
                np.right_shift(a, np.uint32(32 - TURNS[i]), out=t), np.left_shift(a, np.uint32(TURNS[i]), out=a)
                np.bitwise_or(a, t, out=a), np.add(a, b, out=a)
                a, b, c, d = d, a, b, c
            state = [x + y for x, y in zip(state, (a, b, c, d))]
        return state[0].byteswap()

    def by_width(low: int, high: int):
        """(first, last + 1, digits) of the stretches of low to high - 1 that have as many digits."""
        while low < high:
            width = len(str(low))
            yield low, min(high, 10**width), width
            low = min(high, 10**width)

    def sums(lead: bytes, resamples: tuple[int, int], n: int, values: np.ndarray, first: int = 0) -> np.ndarray:
        """For each resample from resamples[0] to resamples[1] - 1 the sum of what its n draws take of values, which are those of the rows from `first` on."""
        total = np.zeros(resamples[1] - resamples[0])
        for b0, b1, b_width in by_width(*resamples):
            for j0, j1, j_width in by_width(0, n):
                some = max(1, AT_ONCE // (j1 - j0))
                for b in range(b0, b1, some):
                    bs = np.arange(b, min(b + some, b1))[:, None]
                    for j in range(j0, j1, AT_ONCE):
                        at = first_word(lead, (bs, b_width), (np.arange(j, min(j + AT_ONCE, j1))[None, :], j_width))
                        at = at % np.uint32(n) if n < 2**32 else at.astype(np.int64)
                        if len(values) < n:
                            at = at.astype(np.int64) - first
                            taken = np.where((at >= 0) & (at < len(values)), values[np.clip(at, 0, len(values) - 1)], 0.0)
                        else:
                            taken = values[at]
                        total[b - resamples[0] : b - resamples[0] + len(bs)] += taken.sum(axis=1)
        return total

    return sums
