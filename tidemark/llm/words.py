"""Words and their 64-bit hashes for a whole block of texts at once, in numpy.

A word is a run of bytes other than \\x20 and \\x09-\\x0D of the UTF-8 text with A-Z
lower-cased.
"""

from __future__ import annotations

from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of unsigned 64-bit integers; one to one."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers below n, and their inverses modulo 2**64."""
    inverse = pow(int(_BASE), -1, 1 << 64)
    out = []
    for b in (int(_BASE), inverse):
        p = np.empty(n, np.uint64)
        p[0] = 1
        have = 1
        while have < n:
            more = min(have, n - have)
            p[have : have + more] = p[:more] * np.uint64(pow(b, have, 1 << 64))
            have += more
        out.append(p)
    return out[0], out[1]


class Words(NamedTuple):
    """Of a block: the bytes (lower-cased, texts one after another, a space after each), each text's first byte, each word's first byte and the one past it, each text's first word (one more entry than texts), each word's hash."""

    data: np.ndarray
    texts: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray


def block_words(texts: pa.Array, hashed: bool = True) -> Words:
    raw = [b"" if x is None else x for x in texts.cast(pa.large_binary()).to_pylist()]
    data = _LOWER[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    at = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(np.fromiter((len(x) + 1 for x in raw), np.int64, len(raw)), out=at[1:])
    space = _SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[0::2], edges[1::2]
    first = np.searchsorted(starts, at)
    if hashed and len(data):
        p, q = _powers(max(1 << 20, 1 << int(len(data)).bit_length()))
        sums = np.empty(len(data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTES[data] * p[: len(data)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(np.uint64))
    else:
        hashes = np.empty(0, np.uint64)
    return Words(data, at, starts, ends, first, hashes)
