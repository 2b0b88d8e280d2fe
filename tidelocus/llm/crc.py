"""CRC-32 of joined bytes from the CRC-32 of their parts, for whole arrays.

``crc(a + b) = shift(crc(a), len(b)) ^ crc(b)``, where ``shift`` multiplies by a power of x modulo the polynomial.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Fixed value: the polynomial of CRC-32, lowest power in the highest bit.
POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo ``POLYNOMIAL``."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return out


@lru_cache(64)
def _tables(k: int) -> np.ndarray:
    """For each byte of a checksum, what it becomes after 2 ** k bytes more."""
    power = 1 << 31 - 8  # x to the eighth
    for _ in range(k):
        power = _times(power, power)
    bits = [_times(1 << i, power) for i in range(32)]
    out = np.zeros((4, 256), np.uint32)
    for part in range(4):
        for i in range(8):
            half = 1 << i
            out[part, half : 2 * half] = out[part, :half] ^ np.uint32(bits[8 * part + i])
    return out


def shift(checksums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksums as they are carried on over so many bytes to come."""
    out, lengths = np.array(checksums, np.uint32), np.asarray(lengths, np.int64)
    for k in range(int(lengths.max(initial=0)).bit_length()):
        some = np.flatnonzero(lengths >> k & 1)
        if len(some):
            x, t = out[some], _tables(k)
            out[some] = t[0][x & 255] ^ t[1][x >> 8 & 255] ^ t[2][x >> 16 & 255] ^ t[3][x >> 24]
    return out
