"""Word and shingle hashes of many texts at once, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Any odd numbers do; they only have to be the same everywhere.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD1342543DE82EF95)
_BYTE = np.random.Generator(np.random.PCG64(2024)).integers(0, 1 << 64, 256, "u8")
_LOWER = np.arange(256, dtype="u1")
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_powers = [np.ones(1, "u8"), np.ones(1, "u8")]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            full = np.full(n, base, "u8")
            full[0] = 1
            _powers[k] = np.cumprod(full, dtype="u8")
    return _powers[0][:n], _powers[1]


@dataclass
class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of several texts, A-Z in lower case.

    ``hashes`` has all words; text ``i`` owns ``hashes[bounds[i]:bounds[i + 1]]``.  ``begin``
    and ``end`` are byte positions in ``data``, the texts joined by line feeds.
    """

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray


def split_words(texts: list[str | None], gaps: np.ndarray = _SPACE) -> Words:
    """Words between the bytes that ``gaps`` marks; the line feed must be one of them."""
    encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(encoded) + b"\n", "u1")
    space = gaps[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    begin, end = edge[0::2], edge[1::2]
    power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, "u8")
    np.cumsum(_BYTE[_LOWER[data]] * power[:-1], dtype="u8", out=total[1:])
    hashes = mix((total[end] - total[begin]) * inverse[begin])
    limits = np.cumsum([0] + [len(e) + 1 for e in encoded])
    return Words(data, begin, end, hashes, np.searchsorted(begin, limits))


def shingle_sets(words: Words, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of ``width`` consecutive words per text.

    A text with fewer words has its whole sequence as one shingle; one without words none.
    """
    h, n = words.hashes, len(words.hashes)
    rolled = np.zeros(n, "u8")
    with np.errstate(over="ignore"):
        for k in range(width):
            rolled = rolled * _STEP
            rolled[: n - k] += h[k:]
        rolled = mix(rolled)
    out = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            short = np.uint64(b - a)
            for word in h[a:b]:
                short = np.uint64((int(short) * int(_STEP) + int(word)) & 0xFFFFFFFFFFFFFFFF)
            out.append(mix(np.array([short], "u8")))
        else:
            out.append(np.zeros(0, "u8"))
    return out
