"""64-bit hashes of the words of many texts at once, by numpy and without a dictionary of words.

A word's hash is a polynomial of its characters' hashes, taken from one running sum over all texts laid end to end, so memory
depends on the texts in hand alone, not on the words met so far.
"""

from __future__ import annotations

import re

import numpy as np

KINDS = {"word": r"\w+", "letters": r"[^\W_]+", "string": r"\S+"}
_R, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_kinds: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (wraps on purpose)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def _grown(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for k, r in enumerate((_R, _INVERSE)):
            steps = np.full(size, r, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def running(codes: np.ndarray) -> np.ndarray:
    """The running sum from which hash_spans takes its hashes."""
    return summed(character(codes.astype(np.uint64)))


def character(codes: np.ndarray) -> np.ndarray:
    return mix((codes + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))


def summed(values: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _grown(len(values) + 1)[0][: len(values)], out=total[1:])
    return total


def hash_spans(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the characters from each start up to its end."""
    return mix(mix((total[end] - total[start]) * _powers[1][start]))


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each run of marked characters."""
    flags = np.zeros(len(inside) + 2, np.int8)
    flags[1:-1] = inside
    edge = np.flatnonzero(flags[1:] != flags[:-1])
    return edge[::2], edge[1::2]


def laid(texts: list) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(lower-case texts, their code points laid end to end with a line feed between, where each text begins)."""
    low = [(t or "").lower() for t in texts]
    codes = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    return low, codes, np.cumsum([0, *(len(t) + 1 for t in low)])


def kind(name: str) -> np.ndarray:
    """For each code point, whether it belongs to a run of that kind."""
    if name not in _kinds:
        every = "".join(map(chr, range(0x110000)))
        out = np.zeros(0x110000, bool)
        for m in re.finditer(KINDS[name], every):
            out[m.start() : m.end()] = True
        _kinds[name] = out
    return _kinds[name]


def word_hashes(texts: list) -> list[np.ndarray]:
    """Hashes of the lower-case words (\\w+) of each text, in order; a text without any has those of its space-separated strings."""
    low, codes, begins = laid(texts)
    start, end = runs(kind("word")[codes])
    out = np.split(hash_spans(running(codes), start, end), np.searchsorted(start, begins[1:-1]))
    for k, t in enumerate(low):
        if t and not len(out[k]):
            own = codes[begins[k] : begins[k] + len(t)]
            out[k] = hash_spans(running(own), *runs(kind("string")[own]))
    return out


def slices(batch, column: int, most: int = 500_000, rows: int = 1000):
    """Parts of an Arrow batch of about `most` characters of text, and their texts; a longer text is a part of its own."""
    at = 0
    while at < batch.num_rows:
        texts, size = [], 0
        for t in batch.column(column).slice(at, rows).to_pylist():
            if texts and size + len(t or "") > most:
                break
            texts.append(t)
            size += len(t or "")
        yield batch.slice(at, len(texts)), texts
        at += len(texts)
