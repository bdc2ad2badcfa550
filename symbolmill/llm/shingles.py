"""Token shingles of many texts at once, as 64-bit numbers, by whole-array arithmetic.

Tokens are the maximal runs of ASCII letters, digits and ``_``, and every other single character that is not ASCII white
space. A token's number is a polynomial over its bytes, a shingle's number mixes the numbers of its consecutive tokens.
"""

import numpy as np

CHUNK = 1 << 20
_WORD, _ONE, _REST = 1, 2, 3
_CLASS = np.zeros(256, np.uint8)
for _i in range(256):
    if chr(_i) in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_":
        _CLASS[_i] = _WORD
    elif 0x80 <= _i < 0xC0:
        _CLASS[_i] = _REST
    elif chr(_i) not in " \t\n\r\v\f":
        _CLASS[_i] = _ONE
_VALUE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_VALUE[_CLASS == 0] = 0
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2^64."""
    size = max(1 << (n - 1).bit_length(), 1024)
    if size not in _powers:
        with np.errstate(over="ignore"):
            up = np.full(size, _BASE, np.uint64)
            down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            np.multiply.accumulate(up, out=up)
            np.multiply.accumulate(down, out=down)
        _powers.clear()
        _powers[size] = up, down
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole number."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all tokens, and where each text's tokens begin in them (one more than texts)."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
    kinds = _CLASS[data]
    first = kinds == _ONE
    word = kinds == _WORD
    first |= word
    first[1:] &= ~(word[1:] & word[:-1])
    at = np.flatnonzero(first)
    cuts = np.concatenate([[0], np.searchsorted(at, ends)])
    if not len(at):
        return np.zeros(0, np.uint64), cuts
    up, down = powers(len(data))
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(_VALUE[data] * up[: len(data)], at)
        return mix(sums * down[at]), cuts


def shingles(texts: list[str], width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens and their cuts, and a shingle's number for every token at which one could begin (the last few of each text run into the next and must be left out)."""
    t, cuts = tokens(texts)
    n = max(len(t) - width + 1, 0)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            total = total * np.uint64(0xD6E8FEB86659FD93) + t[k : k + n]
    return t, cuts, mix(total), np.maximum(np.diff(cuts) - width + 1, 0)


def chunks(values: list, limit: int = CHUNK):
    """Runs of rows (from, to) whose texts together have about ``limit`` characters."""
    at, size = 0, 0
    for i, v in enumerate(values):
        size += len(v) + 1
        if size >= limit:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(values):
        yield at, len(values)
