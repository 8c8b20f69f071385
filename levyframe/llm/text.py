"""Words and word shingles of whole texts, as 64-bit hashes in NumPy arrays."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

SHINGLE_WORDS = 5

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BUFFER = 1 << 18  # bytes hashed at a time
_BLANK = re.compile(rb"[\x09-\x0D ]")


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    z = values + _FACTOR
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """Distinct shingles of texts, as sorted 64-bit hashes.

    Words are lower-cased (A-Z) runs without ASCII white space (0x09-0x0D, 0x20).  Their hashes are polynomials of their
    bytes, taken from running sums over a buffer of many texts; a long text is cut between words.
    """

    def __init__(self, size: int = SHINGLE_WORDS):
        self.size = size
        self._is_blank = np.zeros(256, bool)
        self._is_blank[[9, 10, 11, 12, 13, 32]] = True
        lower = np.arange(256, dtype=np.uint64)
        lower[65:91] += np.uint64(32)
        self._value = np.where(self._is_blank, np.uint64(0), mixed(lower))
        self._up, self._down = powers(_FACTOR, _BUFFER), powers(_INVERSE, _BUFFER)

    def _hashes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of each word."""
        n = len(data)
        up, down = (self._up, self._down) if n <= _BUFFER else (powers(_FACTOR, n), powers(_INVERSE, n))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self._value[data] * up[:n], out=sums[1:])
        edges = np.diff(self._is_blank[data].view(np.int8), prepend=np.int8(1), append=np.int8(1))
        starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        return starts, mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def _runs(self, hashes: np.ndarray, size: int) -> np.ndarray:
        total = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
        if len(total):
            for k in range(size):
                total = total * _FACTOR + hashes[k : len(hashes) - size + 1 + k]
        return mixed(total + np.uint64(size))

    def _distinct(self, hashes: np.ndarray, runs: np.ndarray) -> np.ndarray:
        """Fewer words than a shingle has make one shingle, no words none."""
        n = len(hashes)
        if n < self.size:
            return self._runs(hashes, n) if n else np.empty(0, np.uint64)
        values = np.sort(runs[: n - self.size + 1])
        new = np.ones(len(values), bool)
        np.not_equal(values[1:], values[:-1], out=new[1:])
        return values[new]

    def _long(self, text: bytes) -> np.ndarray:
        parts, at = [], 0
        data = np.frombuffer(text, np.uint8)
        while at < len(text):
            end = len(text)
            if end - at > _BUFFER:
                found = _BLANK.search(text, at + _BUFFER - 1)
                end = found.start() if found else end
            parts.append(self._hashes(data[at:end])[1])
            at = end
        hashes = np.concatenate(parts)
        return self._distinct(hashes, self._runs(hashes, self.size))

    def _together(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        starts, hashes = self._hashes(np.frombuffer(b" ".join(texts), np.uint8))
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        first = np.searchsorted(starts, bounds).tolist()
        runs = self._runs(hashes, self.size)
        for low, high in zip(first[:-1], first[1:], strict=True):
            yield self._distinct(hashes[low:high], runs[low:])

    def many(self, texts: Iterable[bytes | None]) -> Iterator[np.ndarray]:
        """The shingles of each text."""
        held: list[bytes] = []
        size = 0
        for text in texts:
            text = text or b""
            if held and size + len(text) >= _BUFFER:
                yield from self._together(held)
                held, size = [], 0
            if len(text) >= _BUFFER:
                yield self._long(text)
            else:
                held.append(text)
                size += len(text) + 1
        if held:
            yield from self._together(held)

    def of(self, text: str | bytes | None) -> np.ndarray:
        (values,) = self.many([text.encode() if isinstance(text, str) else text])
        return values


def digest64(values: np.ndarray) -> int:
    """A signed 64-bit key of an array's bytes."""
    return int.from_bytes(blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts of an Arrow string column as UTF-8 bytes."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()
