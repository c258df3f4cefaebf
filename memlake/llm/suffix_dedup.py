"""Removal of long byte strings that stand at more than one place, by two-stage suffix sorting.

One suffix array over all texts would be one task, so places that can share a string of LEAST bytes are brought together first. Each
window of LEAST bytes has an anchor: the first of its byte strings of ANCHOR bytes with the smallest hash. Equal windows have equal
anchors at the same offset. Windows of a text with the same anchor form a segment, and only segments whose anchors are equal can share
a window; the rest leave at once. Equal segments settle each other, and one of them goes on to meet the unequal ones of its anchor.

Segments of an anchor meet in one task, as many anchors together as make a good batch. There a suffix array is built in two stages:
suffixes smaller than their successors are sorted directly, the others are induced by scans through the buckets; neighbours with a
common prefix of LEAST bytes mark their windows. An anchor with many unequal segments (copies with many small changes, a passage within
many texts) is split: its windows are dealt anew by their offset range and the bytes all windows of that range have, then by the window.
So no anchor is one task, whatever part of the rows holds it, and no pair of copies is ever listed.

Texts are known by half of their SHA-256; equal texts are one text with a count. Windows are called equal by bytes within a task, and by
two 64-bit hashes where whole segments or the windows of a split anchor agree.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.hashing import hash_spans, mix, summed
from memlake.llm.workers import task
from memlake.session import bucketed, partitions, ship, written

LEAST = 400
ANCHOR = 96
MOST = 4_096  # unequal segments of an anchor that meet in one task: at most 4,096 x 705 bytes
RANGES = (32, 1)  # offsets in a range, at the first and the second split of an anchor
SLICE = 1 << 20  # bytes of text worked on at once
BATCH = 1 << 20  # bytes of a suffix array
PLACE = "h long, s long, n long, key binary, start int, end int, mid int"
_COLUMNS = [c.split()[0] for c in PLACE.split(", ")]
_VALUES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))


# ---- anchors and segments


def smallest(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values the place of its smallest, the first of equals, by running minima from both sides of fixed blocks."""
    n = len(h)
    keyed = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = keyed
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return (np.minimum(back[: n - width + 1], ahead[width - 1 : n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def segments(texts: list[bytes], least: int = LEAST, anchor: int = ANCHOR):
    """(text number, start, end, anchor's place, anchor's hash, segment's hash) of the segments of texts, as arrays; places within the text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"".join(texts), np.uint8)
    empty = tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    if len(raw) < least:
        return empty
    total = summed(_VALUES[raw])
    at = np.arange(len(raw) - anchor + 1)
    mid = smallest(hash_spans(total, at, at + anchor), least - anchor + 1)
    owner = np.searchsorted(begins, np.arange(len(mid)), "right") - 1
    inside = np.arange(len(mid)) + least <= begins[owner] + sizes[owner]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (mid[1:] != mid[:-1]) | (owner[1:] != owner[:-1])
    last = inside.copy()
    last[:-1] &= ~inside[1:] | (mid[1:] != mid[:-1]) | (owner[1:] != owner[:-1])
    start, end = np.flatnonzero(first), np.flatnonzero(last) + least
    if not len(start):
        return empty
    m, own = mid[start], owner[start]
    return own, start - begins[own], end - begins[own], m - begins[own], hash_spans(total, m, m + anchor), mix(hash_spans(total, start, end) + (m - start).astype(np.uint64))


def _sliced(batch, column: int):
    """Rows of an Arrow batch in parts of about SLICE bytes: (part, its binary values)."""
    at = 0
    while at < batch.num_rows:
        got, size = [], 0
        while at + len(got) < batch.num_rows and (not got or size < SLICE):
            got.append(batch.column(column)[at + len(got)].as_py())
            size += len(got[-1])
        yield batch.slice(at, len(got)), got
        at += len(got)


def _places(h, s, n, keys, start, end, mid) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(s.view(np.int64)), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), *(pa.array(x.astype(np.int32)) for x in (start, end, mid))], _COLUMNS)


@task("suffix_dedup")
def _cut(batches):
    """(key, text) rows to places of segments."""
    for batch in batches:
        for part, texts in _sliced(batch, 1):
            own, start, end, mid, h, s = segments(texts)
            keys = part.column(0).to_pylist()
            yield _places(h, s, np.ones(len(h), np.int64), [keys[k] for k in own.tolist()], start, end, mid)


def _split(step: int):
    """Segments with their bytes to places of the windows of each range of `step` anchor offsets, under a key of the bytes common to the range."""

    @task("suffix_dedup")
    def run(batches):
        for batch in batches:
            for part, texts in _sliced(batch, 6):
                column = lambda c, p=part: p.column(p.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                keys, base, mids, hs, ns = part.column(part.schema.get_field_index("key")).to_pylist(), column("start"), column("mid"), column("h"), column("n")
                sizes = np.array([len(t) for t in texts], np.int64)
                begins = np.cumsum(sizes) - sizes
                total = summed(_VALUES[np.frombuffer(b"".join(texts), np.uint8)])
                out = []
                for k in range(len(texts)):
                    m = int(mids[k] - base[k])  # the anchor's place in the segment
                    for r in range(max(0, m - (int(sizes[k]) - LEAST)) // step, m // step + 1):
                        low, high = max(0, m - (r * step + step - 1)), min(int(sizes[k]) - LEAST, m - r * step)  # first and last window of the range
                        out.append((k, r, low, high + LEAST, m - r * step, m - (r * step + step - 1) + LEAST))
                k, r, a, b, ca, cb = (np.array(x, np.int64) for x in zip(*out))
                at = begins[k]
                core = mix(hash_spans(total, at + ca, at + cb) + mix(hs[k].view(np.uint64) + r.astype(np.uint64)))
                s = mix(hash_spans(total, at + a, at + b) + (ca - a).astype(np.uint64))
                yield _places(core, s, ns[k], [keys[x] for x in k.tolist()], base[k] + a, base[k] + b, mids[k])

    return run


# ---- suffix sorting in two stages


def _ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each value: how many are smaller, which of them have equals)."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    at = np.flatnonzero(new)
    rank = np.empty(len(key), np.int64)
    rank[order] = np.repeat(at, np.diff(np.concatenate([at, [len(key)]])))
    tied = np.empty(len(key), bool)
    tied[order] = ~(new & np.concatenate([new[1:], [True]]))
    return rank, tied


def _refined(rank: np.ndarray, tied: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Ranks of the tied places told apart by a second value; returns those still tied."""
    r, s = rank[tied], second
    order = np.lexsort((s, r))
    tied, r, s = tied[order], r[order], s[order]
    group = np.concatenate([[True], r[1:] != r[:-1]])
    new = group | np.concatenate([[True], s[1:] != s[:-1]])
    idx = np.arange(len(r))
    rank[tied] = r + np.maximum.accumulate(np.where(new, idx, 0)) - np.maximum.accumulate(np.where(group, idx, 0))
    return tied[~(new & np.concatenate([new[1:], [True]]))]


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """The order of all suffixes of codes (1 to 256, and a 0 at the end of each part; parts are ordered among themselves at their ends).

    First stage: a suffix smaller than its successor is sorted by the stretches between such places, which never are prefixes of each
    other once each value carries its type, then by doubling over the sequence of stretches. Second stage: buckets are scanned upwards,
    and each suffix met puts its predecessor, if greater, at the head of that one's bucket.
    """
    t, n = codes.astype(np.int64), len(codes)
    step = np.sign(np.diff(t, append=1))
    changes = np.where(step != 0, np.arange(n), n)
    ahead = np.minimum(np.minimum.accumulate(changes[::-1])[::-1], n - 1)
    small = (step[ahead] > 0) | (t == 0)  # smaller than its successor
    pos = np.flatnonzero(small)
    reach = np.diff(pos, append=n) + 1
    typed = np.concatenate([2 * t + small, np.zeros(8, np.int64)])

    def word(of: np.ndarray, at: int) -> np.ndarray:
        """Six values of 10 bits of the stretches, from their value number `at` on; zeros after a stretch's end."""
        out = np.zeros(len(of), np.int64)
        for k in range(at, at + 6):
            out = (out << 10) | np.where(k < reach[of], typed[np.minimum(pos[of] + k, n + 7)], 0)
        return out

    every = np.arange(len(pos))
    key = word(every, 0)
    ends = t[pos] == 0
    key[ends] = np.arange(ends.sum())  # an end is like no other
    rank, mask = _ranks(key)
    tied, at = np.flatnonzero(mask), 6
    while (reach[tied] > at).any():
        tied = _refined(rank, tied, word(tied, at))
        at += 6
    hop = 1
    while len(tied):
        tied = _refined(rank, tied, rank[tied + hop])
        hop *= 2
    direct = np.empty(len(pos), np.int64)
    direct[rank] = pos

    size = np.bincount(t, minlength=257)
    start = np.cumsum(size) - size
    head, sorted_from = start.copy(), start + size - np.bincount(t[pos], minlength=257)
    order = np.empty(n, np.int64)
    by = t[direct]
    order[sorted_from[by] + np.arange(len(direct)) - (np.cumsum(np.bincount(by, minlength=257)) - np.bincount(by, minlength=257))[by]] = direct

    def induce(met: np.ndarray) -> None:
        before = met[met > 0] - 1
        before = before[~small[before]]
        if not len(before):
            return
        c = t[before]
        sort = np.argsort(c.astype(np.int16), kind="stable")
        before, c = before[sort], c[sort]
        many = np.bincount(c, minlength=257)
        order[head[c] + np.arange(len(c)) - (np.cumsum(many) - many)[c]] = before
        np.add(head, many, out=head)

    for c in np.flatnonzero(size).tolist():
        done = start[c]
        while done < head[c]:
            done, begin = head[c], done
            induce(order[begin:done].copy())
        induce(order[sorted_from[c] : start[c] + size[c]])
    return order


def shared_windows(parts: list[bytes], least: int = LEAST) -> list[np.ndarray]:
    """For each part, which of its windows of `least` bytes stand at another place of the parts too."""
    raw = np.frombuffer(b"\x00".join(parts) + b"\x00", np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    codes = raw.astype(np.int64) + 1
    codes[begins + sizes] = 0
    left = np.repeat(begins + sizes, sizes + 1) - np.arange(len(raw))
    order = suffix_array(codes)
    order = order[left[order] >= least]
    eight = np.zeros(len(raw), np.uint64)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    for k in range(8):
        eight = (eight << np.uint64(8)) | padded[k : k + len(raw)]
    alike = np.arange(len(order) - 1) if len(order) else np.zeros(0, np.int64)
    for k in [*range(0, least - 7, 8), least - 8]:  # common prefixes of neighbours, eight bytes at a time
        alike = alike[eight[order[alike] + k] == eight[order[alike + 1] + k]]
    hit = np.zeros(len(raw), bool)
    hit[order[alike]] = hit[order[alike + 1]] = True
    return [hit[b : b + max(0, s - least + 1)] for b, s in zip(begins.tolist(), sizes.tolist())]


def spans(hit: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """(start, end) of the bytes that marked windows cover."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    out: list[tuple[int, int]] = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], b - 1 + least
        else:
            out.append((a, b - 1 + least))
    return out


@task("suffix_dedup")
def _sorted_segments(batches):
    """Segments in the order of their anchors to (key, start, end) of shared bytes; batches end between anchors."""
    held: list[tuple] = []
    size = last = 0

    def out():
        rows = []
        for (key, start, n, part), hit in zip(held, shared_windows([x[3] for x in held])):
            if n == 1:  # equal segments are settled already
                rows += [(key, start + a, start + b) for a, b in spans(hit)]
        held.clear()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int32(), pa.int32()))], ["key", "start", "end"])

    for batch in batches:
        for h, key, start, n, part in zip(*(batch.column(c).to_pylist() for c in ("h", "key", "start", "n", "part"))):
            if h != last and size > BATCH:
                yield from out()
                size = 0
            held.append((key, start, n, part))
            size, last = size + len(part), h
    if held:
        yield from out()


# ---- the job


def _shared_spans(texts: DataFrame) -> list[DataFrame]:
    """(key, start, end) of bytes of texts (key, text) that a repeated window covers, in several tables."""
    spark = texts.sparkSession
    found = []
    places = written(texts.select("key", "text").mapInArrow(_cut, PLACE), "segments")
    for k in range(len(RANGES) + 1):
        often = places.groupBy("h").agg(F.sum("n").alias("__n")).where("__n > 1").select("h")
        again = written(places.join(often, "h").select(*_COLUMNS), "repeated")
        kinds = written(again.groupBy("h", "s").agg(F.sum("n").alias("n"), F.min(F.struct("key", "start", "end", "mid")).alias("one")), "kinds")
        found.append(again.join(kinds.where("n > 1").select("h", "s"), ["h", "s"]).select("key", "start", "end"))
        several = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("unequal")).where("unequal > 1")
        meet = kinds.join(several, "h").select("h", "s", "n", "one.*", "unequal")
        parts = written(texts.select("key", "text").join(meet, "key").select("h", "s", "n", "key", "start", "mid", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("part"), "unequal"), "parts")
        few = parts.where(F.col("unequal") <= MOST).select("h", "key", "start", "n", "part")
        found.append(few.repartition(partitions(spark), "h").sortWithinPartitions("h").mapInArrow(_sorted_segments, "key binary, start int, end int"))
        if k == len(RANGES):
            break
        many = parts.where(F.col("unequal") > MOST).drop("unequal")
        if many.isEmpty():
            break
        places = written(many.mapInArrow(_split(RANGES[k]), PLACE), "split")
    return found


def remove_repeats(docs: DataFrame, passages: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of docs (doc_id, text): every byte that a string of LEAST bytes covers which
    starts anywhere else too, in this or another row, is removed. With passages, n_shared_words follows: the words of the text in
    strings of more than 50 words that another row has too, whatever their bytes (see shared_passages); it removes nothing.

    A null text is empty. Rows are places of their own, also with equal ids or equal texts, so repeated long texts lose all their bytes.
    Texts below LEAST bytes lose nothing. Null ids stay; an empty table gives no rows; other columns, whatever their names, are ignored.
    """
    from memlake.llm import shared_passages

    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    digest = F.sha2("text", 256)
    keyed = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), digest.alias("digest"), F.substring(F.unhex(digest), 1, 16).alias("key"))
    long_ones = rows.where(F.octet_length("text") >= (min(LEAST, 2 * shared_passages.LEAST - 1) if passages else LEAST)).select(F.substring(F.unhex(digest), 1, 16).alias("key"), "text")
    every = bucketed(long_ones.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text")), "texts", "key")
    texts = every.where(F.octet_length("text") >= LEAST)
    found = None
    for part in _shared_spans(texts):
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))  # of one text: bounded by its length

    @task("suffix_dedup")
    def keep(batches):
        for batch in batches:
            for part, texts in _sliced(batch, 1):
                out = []
                for key, text, of in zip(part.column(0).to_pylist(), texts, part.column(2).to_pylist()):
                    kept, at, removed, n = hashlib.sha256(), 0, 0, 0
                    end = None
                    for s in sorted((x["start"], x["end"]) for x in of):
                        if end is None or s[0] > end:
                            n += 1
                            kept.update(text[at : s[0]])
                            removed += s[1] - s[0]
                            at = end = s[1]
                        elif s[1] > end:
                            removed += s[1] - end
                            at = end = s[1]
                    kept.update(text[at:])
                    out.append((key, removed, n, kept.hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.int64(), pa.string()))], ["key", "n_removed", "n_spans", "kept"])

    once = texts.where("copies = 1").select("key", "text").join(merged, "key").mapInArrow(keep, "key binary, n_removed long, n_spans long, kept string")
    whole = texts.where("copies > 1").select("key", F.octet_length("text").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept"))
    answers = once.unionByName(whole)
    zero = F.lit(0).cast("long")
    columns = ["doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept", "digest").alias("kept_sha256")]
    found = keyed.join(answers, "key", "left")
    if passages:
        found = found.join(shared_passages.shared_words(every), "key", "left")
        columns.append(F.coalesce("n_shared_words", zero).alias("n_shared_words"))
    return found.select(*columns)
