"""Vectorised word hashes of whole texts, for the operators that run in Arrow batches.

A word's hash is a sum over its blocks of eight bytes, each block mixed and multiplied by an odd value of its place; so is
the hash of a run of words over the words' hashes. Places weigh by unrelated values, not by powers of one base, so no
sequence cancels out as it would in a polynomial modulo 2**64. Equal words always have equal hashes; different ones collide
with a probability of about 2**-63.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_SEED = np.uint64(0x9E3779B97F4A7C15)
_IS_SEPARATOR = np.zeros(256, bool)
_IS_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes hashed at a time: bounds what a Python worker holds.
PIECE = 1 << 21
#: Words of more blocks than this are hashed one by one.
_LONG = 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values; a bijection."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(32)
    return x


def _weights(n: int) -> np.ndarray:
    """An odd 64-bit value for each of n places."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _SEED) | np.uint64(1)


_WEIGHT = _weights(1 << 12)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _weight(n: int) -> np.ndarray:
    return _WEIGHT if n <= len(_WEIGHT) else _weights(n)


def _hash_piece(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _IS_SEPARATOR[buf], [True]))))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    length = end - start
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    block = np.ndarray((len(buf) + 1,), np.uint64, padded.data, strides=(1,))  # the eight bytes from each byte on
    total = mix(block[start] & _MASK[np.minimum(length, 8)]) * _WEIGHT[0]
    more = np.flatnonzero(length > 8)
    for k in range(1, _LONG):
        if not len(more):
            break
        total[more] += mix(block[start[more] + 8 * k] & _MASK[np.minimum(length[more] - 8 * k, 8)]) * _WEIGHT[k]
        more = more[length[more] > 8 * k + 8]
    for i in more.tolist():
        blocks = np.zeros(-(-int(length[i]) // 8), np.uint64)
        blocks.view(np.uint8)[: length[i]] = buf[start[i] : end[i]]
        total[i : i + 1] += (mix(blocks) * _weight(len(blocks))[: len(blocks)])[_LONG:].sum()
    return mix(total + length.astype(np.uint64) * _SEED), start


def hashes_and_starts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of UTF-8 bytes, in order."""
    if len(data) <= PIECE:
        return _hash_piece(np.frombuffer(data, np.uint8))
    buf, parts, at = np.frombuffer(data, np.uint8), [], 0
    while at < len(buf):
        end = min(len(buf), at + PIECE)
        if end < len(buf):  # cut at a separator; a word longer than a piece stays whole
            back = np.flatnonzero(_IS_SEPARATOR[buf[at:end]])
            if len(back):
                end = at + int(back[-1]) + 1
            else:
                ahead = np.flatnonzero(_IS_SEPARATOR[buf[end:]])
                end = end + int(ahead[0]) + 1 if len(ahead) else len(buf)
        hashes, start = _hash_piece(buf[at:end])
        parts.append((hashes, start + at))
        at = end
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def word_hashes(data: bytes) -> np.ndarray:
    """Hash of each word of UTF-8 bytes, in order."""
    return hashes_and_starts(data)[0]


def chunks(texts: Iterable[str | None], lower: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(word hashes of several texts one after another, offsets of each text's words, number of the first text).

    Texts are gathered up to PIECE bytes, so memory is bounded by that and the longest text.
    """
    for first, held in gathered(texts):
        data = b"\n".join(held)
        hashes, start = hashes_and_starts(data.lower() if lower else data)  # bytes.lower: A-Z alone
        ends = np.cumsum([len(x) + 1 for x in held])
        yield hashes, np.concatenate(([0], np.searchsorted(start, ends))), first


def gathered(texts: Iterable[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first text, UTF-8 bytes of texts) in runs of about PIECE bytes. Null is empty."""
    held: list[bytes] = []
    size, first, n = 0, 0, 0
    for text in texts:
        data = b"" if text is None else text.encode("utf-8", "surrogatepass")
        if held and size + len(data) > PIECE:
            yield first, held
            held, size, first = [], 0, n
        held.append(data)
        size += len(data) + 1
        n += 1
    if held:
        yield first, held


def run_hashes(hashes: np.ndarray, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Hash of each run of words hashes[start : start + length]."""
    if not len(start):
        return np.zeros(0, np.uint64)
    if isinstance(length, int) and length <= _LONG:
        n = len(hashes) - length + 1
        total = hashes[:n] * _WEIGHT[0]
        for k in range(1, length):
            total += hashes[k : k + n] * _WEIGHT[k]
        return mix(total[start] + np.uint64(length * int(_SEED) & 0xFFFFFFFFFFFFFFFF))
    length = np.broadcast_to(np.asarray(length, np.int64), (len(start),))
    out, first = np.empty(len(start), np.uint64), 0
    ends = np.cumsum(length)
    while first < len(start):  # runs of about a piece of words at a time
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PIECE)))
        own = length[first:last]
        begin = np.cumsum(own) - own
        place = np.arange(int(own.sum())) - np.repeat(begin, own)
        terms = hashes[np.repeat(start[first:last], own) + place] * _weight(int(own.max()))[place]
        out[first:last] = np.add.reduceat(terms, begin)
        first = last
    return mix(out + length.astype(np.uint64) * _SEED)


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as int64, the type that Spark has."""
    return np.ascontiguousarray(x).view(np.int64)
