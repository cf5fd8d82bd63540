"""Words, word hashes and word windows over Arrow text, in numpy on the UTF-8 bytes.

All separators used here are ASCII, so a byte of 0x80 or more is always part of a word and nothing is decoded.
A word hash mixes the length and then eight bytes at a time, each turn a full 64-bit mix, so it has no algebraic structure
over the letters; words of over `LONG` bytes are hashed with a keyed blake2b. The two streams use other keys and other
mixers; where one stream's collision would matter, both are compared (128 bits). Equal words have equal hashes everywhere.
"""

from __future__ import annotations

import hashlib

import numpy as np

#: Separators [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, all else unchanged.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20
#: Longest word that is hashed in numpy.
LONG = 64
_LANE = 8
_RNG = np.random.default_rng(20_240_101)
_KEY = _RNG.integers(1, 2**64 - 1, (2, 3), np.uint64, endpoint=True)
#: Shifts and multipliers of the two mixers.
_MIX = ((33, 0xFF51AFD7ED558CCD, 33, 0xC4CEB9FE1A85EC53, 33), (30, 0xBF58476D1CE4E5B9, 27, 0x94D049BB133111EB, 31))
_MASK = np.array([(1 << 8 * k) - 1 for k in range(_LANE + 1)], np.uint64)


def mix(x: np.ndarray, stream: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply), one to one."""
    a, m, b, n, c = (np.uint64(v) for v in _MIX[stream])
    x = x ^ (x >> a)
    x *= m
    x ^= x >> b
    x *= n
    x ^= x >> c
    return x


def spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text the n+1 bounds of its words in those arrays."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separator[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, *, fold: bool = False, stream: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; `fold` takes A-Z as a-z."""
    raw = np.zeros(len(data) + _LANE, np.uint8)
    raw[: len(data)] = FOLD[data] if fold else data
    lanes = np.ndarray(len(data) + 1, "<u8", raw, 0, (1,))  # the eight bytes from each byte on
    size = ends - starts
    out = mix(size.astype(np.uint64) + _KEY[stream, 0], stream)
    at, turn = np.flatnonzero(size <= LONG), 0
    while len(at):
        left = size[at] - turn
        lane = lanes[starts[at] + turn] & _MASK[np.minimum(left, _LANE)]
        out[at] = mix(out[at] ^ lane, stream)
        at, turn = at[left > _LANE], turn + _LANE
    key = _KEY[stream].tobytes()
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8, key=key).digest(), "little")
    return out


def windows(word: np.ndarray, width: int, stream: int = 0) -> np.ndarray:
    """A hash for each run of `width` words, as if all were one text: callers leave out those over a text's end."""
    n = len(word) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    base = _KEY[stream, 1] | np.uint64(1)
    for k in range(width):
        total ^= total >> np.uint64(29)
        total *= base
        total += word[k : k + n]
    return mix(total, stream)
