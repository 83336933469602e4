"""Sets of word shingles as 64-bit hashes, for many texts at once.

Words are runs of bytes other than white space, A-Z in lower case. A word is hashed eight bytes at a time,
each step a bijection of the bytes and of what came before: words of one length and at most eight bytes
never share a hash, longer ones do by chance alone (2**-64 a pair), whatever pattern their letters follow.
Words over SHORT bytes take a keyed BLAKE2b. Hashes of shingles are sums of their words' hashes, spread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

#: Bytes of text that are hashed together, but for a text that is longer alone.
CHUNK = 1 << 20

#: Bytes of the longest word that is hashed by lanes of eight.
SHORT = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_KEY, _SEED = b"words of a text", np.uint64(0x9E3779B97F4A7C15)
_STEP, _LENGTH, _SHORT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of data."""
    gap = np.concatenate([[True], _SPACE[data], [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edge[::2], edge[1::2]
    low = np.concatenate([_LOWER[data], np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) + 1, "<u8", low, 0, (1,))  # the eight bytes from each place on
    lengths = ends - starts
    hashes = mix((lengths.astype(np.uint64) * _LENGTH + _SEED) ^ (lanes[starts] & _MASKS[np.minimum(lengths, 8)]))
    rest = np.flatnonzero(lengths > 8)
    for k in range(8, SHORT, 8):
        left = lengths[rest] - k
        hashes[rest] = mix(hashes[rest] ^ (lanes[starts[rest] + k] & _MASKS[np.minimum(left, 8)]))
        rest = rest[left > 8]
    for i in rest.tolist():
        digest = hashlib.blake2b(low[starts[i] : ends[i]].tobytes(), digest_size=8, key=_KEY).digest()
        hashes[i] = np.frombuffer(digest, "<u8")[0]
    return hashes, starts


def shingle_sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text: of the whole sequence where it is shorter
    than a shingle, none without words."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(data) > CHUNK:
            yield from _sets(held, words)
            held, size = [], 0
        held.append(data)
        size += len(data) + 1
    if held:
        yield from _sets(held, words)


def _sets(held: list[bytes], words: int) -> Iterator[np.ndarray]:
    data = np.frombuffer(b"\n".join(held) + b"\n", np.uint8)
    hashes, starts = word_hashes(data)
    ends = np.cumsum([len(x) + 1 for x in held])
    cuts = np.searchsorted(starts, ends)
    n = max(0, len(hashes) - words + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(words):
        rolled = rolled * _STEP + hashes[k : k + n]
    rolled, at = mix(rolled), 0
    for cut in cuts.tolist():
        count = cut - at
        if count >= words:
            own = np.sort(rolled[at : cut - words + 1])
            yield own[np.append(True, own[1:] != own[:-1])]
        elif count:
            short = _SHORT + np.uint64(count)
            with np.errstate(over="ignore"):
                for h in hashes[at:cut]:
                    short = short * _STEP + h
            yield mix(np.array([short], np.uint64))
        else:
            yield np.empty(0, np.uint64)
        at = cut


def set_hash(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    with np.errstate(over="ignore"):
        total = mix(s + _LENGTH).sum(dtype=np.uint64) + np.uint64(len(s)) * _SHORT
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])
