"""Periodic runs of words: stretches that repeat a short passage three times or more.

Every run (a maximal stretch with smallest period q) has a Lyndon root under one of two opposite orders of its words, and that root
is the longest Lyndon word at its place. So a stack scanned from right to left under either order gives, for each place, one period
to try, which is extended to both sides. Suffixes are compared by the longest common extension: rolling hashes and a binary search
find it, and the words themselves confirm it, so no result rests on a hash. No suffix array is built.

A document is one row and its runs are found within its task, so documents spread over tasks freely and no group is gathered. Only
stretches in which every window of eight words comes back can hold a run of at least 24 words and three periods; they are found by
sorting window hashes of the whole document, and the stack reads those stretches alone.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.hashing import slices
from memlake.llm.workers import task
from memlake.session import ship

LEAST, TIMES = 24, 3  # words and periods of a run
WINDOW = LEAST // TIMES
_P, _R = (1 << 61) - 1, 0x1F3D5B79A2C4E681 % ((1 << 61) - 1)
FOUND = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def words_of(text: str | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ in UTF-8; bytes.split() cuts at just these six characters."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def order_of(n: int, doc_id: int | None) -> np.ndarray | None:
    """Which original word stands at each place of a document of n words; None where every word keeps its own (also for a null doc_id)."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (TIMES + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place


class Words:
    """A sequence of word numbers with common extensions by rolling hash and binary search, confirmed by the words."""

    def __init__(self, ids: list[int]):
        self.ids, self.n = ids, len(ids)
        self.raw = np.array(ids, np.int32).tobytes()
        total, power = [0], [1]
        for x in ids:
            total.append((total[-1] * _R + x + 1) % _P)
            power.append(power[-1] * _R % _P)
        self.total, self.power = total, power

    def _alike(self, i: int, j: int, n: int) -> bool:
        t, f = self.total, self.power[n]
        return (t[i + n] - t[i] * f - t[j + n] + t[j] * f) % _P == 0

    def _same(self, i: int, j: int, n: int) -> bool:
        """The words themselves, laid out as bytes."""
        return self.raw[4 * i : 4 * (i + n)] == self.raw[4 * j : 4 * (j + n)]

    def ahead(self, i: int, j: int) -> int:
        """Common words from i and from j on (i < j)."""
        ids, most = self.ids, self.n - j
        low = 0
        while low < 4:  # most extensions end at once
            if low >= most or ids[i + low] != ids[j + low]:
                return low
            low += 1
        high = 8
        while high <= most and self._alike(i, j, high):
            low, high = high, 2 * high
        high = min(high, most + 1)
        while high - low > 1:
            half = (low + high) // 2
            if self._alike(i, j, half):
                low = half
            else:
                high = half
        return low if self._same(i, j, low) else self._walk(i, j, 1)

    def behind(self, i: int, j: int) -> int:
        """Common words before i and before j, going back (i < j)."""
        ids, most = self.ids, i
        low = 0
        while low < 4:
            if low >= most or ids[i - 1 - low] != ids[j - 1 - low]:
                return low
            low += 1
        high = 8
        while high <= most and self._alike(i - high, j - high, high):
            low, high = high, 2 * high
        high = min(high, most + 1)
        while high - low > 1:
            half = (low + high) // 2
            if self._alike(i - half, j - half, half):
                low = half
            else:
                high = half
        return low if self._same(i - low, j - low, low) else self._walk(i, j, -1)

    def _walk(self, i: int, j: int, step: int) -> int:
        """Word by word, for the case that two hashes agree by chance."""
        n = 0
        a, b = (i, j) if step > 0 else (i - 1, j - 1)
        while 0 <= a and b < self.n and self.ids[a] == self.ids[b]:
            a, b, n = a + step, b + step, n + 1
        return n


def runs_of(ids: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least `least` words and `times` periods (2 or more), by start, then period.

    The stretch last found to keep a distance answers all further extensions at that distance within it, so long runs are read once.
    """
    w, n, found = Words(ids), len(ids), set()
    known: dict[int, tuple[int, int]] = {}  # distance: the maximal stretch that keeps it, around the place looked at last

    def kept(i: int, j: int) -> tuple[int, int]:
        begin, end = known.get(j - i, (n, n))
        if not (begin <= i and j <= end):
            ahead = w.ahead(i, j) if j < n else 0
            begin, end = i - w.behind(i, j), j + ahead
            known[j - i] = begin, end
        return begin, end

    for sign in (1, -1):
        smaller = [0] * n  # where the next smaller suffix begins: up to there goes the longest Lyndon word
        for i in range(n - 1, -1, -1):
            j = i + 1
            while j < n:
                if ids[i] != ids[j]:
                    less = sign * ids[i] < sign * ids[j]
                else:
                    end = kept(i, j)[1]
                    less = end < n and sign * ids[end - j + i] < sign * ids[end]
                if not less:
                    break
                j = smaller[j]
            smaller[i] = j
            p = j - i
            if p * times > n:
                continue
            begin, end = kept(i, j)
            if end - begin >= max(least, times * p):
                found.add((begin, end - begin, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(ids: np.ndarray, window: int = WINDOW) -> list[tuple[int, int]]:
    """(start, end) of the places where every window of `window` words also stands elsewhere; a run lies within one of them."""
    if len(ids) < LEAST:
        return []
    n = len(ids) - window + 1
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
    order = np.argsort(h, kind="stable")
    s = h[order]
    twin = s[1:] == s[:-1]
    if not twin.any():
        return []
    back = np.zeros(n + 2, np.int8)
    back[1 + order[1:][twin]] = 1
    back[1 + order[:-1][twin]] = 1
    edge = np.flatnonzero(back[1:] != back[:-1])
    return [(a, b + window - 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if b + window - 1 - a >= LEAST]


def find(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a document's words."""
    if len(words) < LEAST:
        return []
    hashed = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    out = []
    for a, b in stretches(hashed):
        seen: dict[bytes, int] = {}
        ids = [seen.setdefault(w, len(seen)) for w in words[a:b]]
        out += [(a + s, n, p) for s, n, p in runs_of(ids)]
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    drop = np.zeros(len(words) + 1, np.int64)
    for s, n, p in runs:
        drop[s + p] += 1
        drop[s + n] -= 1
    inside = np.cumsum(drop[:-1])
    return [w for w, d in zip(words, inside.tolist()) if not d]


def describe(text: str | None, doc_id: int | None) -> tuple:
    """The row of one document after its doc_id."""
    words = words_of(text)
    place = order_of(len(words), doc_id)
    if place is not None:
        words = [words[k] for k in place.tolist()]
    runs = find(words)
    best = (None, None, None)
    for s, n, p in runs:  # by start, then period: a later run must be better
        if best[0] is None or n * best[2] > best[1] * p:
            best = s, n, p
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    kept = collapsed(words, runs) if runs else words
    return len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Per document of docs (doc_id, text): n_runs; start, length, period, exponent_milli of the run with the greatest exact length/period
    (ties: smallest start, then period); sha256 of all runs and of the words that stay when each run keeps its first period only.

    A null text has no words and no runs, as has an empty one; nulls then stand for the best run. A document whose crc32(doc_id) ends
    in 0 is read with its words repeated from a place on, as `order_of` says; one without doc_id is read as it is. Repeated rows are
    answered each; an empty table gives no rows; other columns, whatever their names, are ignored.
    """
    ship(docs.sparkSession)
    schema = pa.schema([(n, pa.string() if n.endswith("256") else pa.int64()) for n in re.findall(r"(\w+) (?:long|string)", FOUND)])

    @task("periodic_runs")
    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, 1):
                rows = [(d, *describe(t, d)) for d, t in zip(part.column(0).to_pylist(), texts)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FOUND)
