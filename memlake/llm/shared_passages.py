"""Words that stand in passages which other documents have too: every string of LEAST words that also starts in another document.

The bytes that suffix_dedup removes are strings of 400 bytes; passages of little over 50 words are mostly shorter. They are found by the
same dealing, with words for bytes: each window of LEAST words has an anchor, the first of its strings of ANCHOR words with the smallest
hash, and windows of a text with one anchor form a segment. Only segments of an anchor that several texts have go on. Equal segments of
different texts settle each other, and one of them goes on to meet the unequal ones of its anchor, where equal windows are found by their
hashes. An anchor with more than MOST segments left isn't met in one task: its windows are dealt by themselves.

Words are strings without ASCII white space, so passages are the same whatever white space stands between their words. Anchors, segments
and windows are called equal by 64-bit hashes (a window always beside its anchor's).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.hashing import hash_spans, mix, runs, summed
from memlake.llm.suffix_dedup import _VALUES, BATCH, _sliced, smallest
from memlake.llm.workers import task
from memlake.session import partitions, written

LEAST = 51
ANCHOR = 8
MOST = 4_096  # segments of an anchor that meet in one task
PLACE = "h long, s long, t long, key binary, first int, last int, start int, end int"
_COLUMNS = [c.split()[0] for c in PLACE.split(", ")]
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start and end within the text, hash) of the words of texts, as arrays."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    start, end = runs(~_SPACE[raw])
    own = np.searchsorted(begins, start, "right") - 1
    return own, start - begins[own], end - begins[own], hash_spans(summed(_VALUES[raw]), start, end)


def segments(texts: list[bytes], least: int = LEAST, anchor: int = ANCHOR):
    """(text number, first word, word after the last, start and end in bytes, anchor's hash, segment's hash) of the segments of texts, as arrays."""
    own, start, end, words = words_of(texts)
    if len(words) < least:
        return tuple(np.zeros(0, np.int64) for _ in range(5)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    total = summed(words)
    at = np.arange(len(words) - anchor + 1)
    mid = smallest(hash_spans(total, at, at + anchor), least - anchor + 1)
    inside = own[: len(mid)] == own[least - 1 :]
    breaks = (mid[1:] != mid[:-1]) | (own[1 : len(mid)] != own[: len(mid) - 1])
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | breaks
    last[:-1] &= ~inside[1:] | breaks
    a, b = np.flatnonzero(first), np.flatnonzero(last) + least
    m, text = mid[a], own[a]
    zero = np.searchsorted(own, text)  # the first word of the text
    return text, a - zero, b - zero, start[a], end[b - 1], hash_spans(total, m, m + anchor), mix(hash_spans(total, a, b) + (m - a).astype(np.uint64))


def windows(parts: list[bytes], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part number, number of its first word there, hash) of the windows of `least` words of parts, as arrays."""
    own, _, _, words = words_of(parts)
    at = np.flatnonzero(own[: max(0, len(own) - least + 1)] == own[least - 1 :])
    return own[at], at - np.searchsorted(own, own[at]), hash_spans(summed(words), at, at + least)


@task("shared_passages")
def _cut(batches):
    """(key, text) rows to places of segments."""
    for batch in batches:
        for part, texts in _sliced(batch, 1):
            text, first, last, start, end, h, s = segments(texts)
            keys = part.column(0).to_pylist()
            t = np.array([int.from_bytes(k[:8], "little", signed=True) for k in keys], np.int64)[text]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(s.view(np.int64)), pa.array(t), pa.array([keys[k] for k in text.tolist()], pa.binary()), *(pa.array(x.astype(np.int32)) for x in (first, last, start, end))], _COLUMNS
            )


def _several(w: np.ndarray, t: np.ndarray, settled: np.ndarray) -> np.ndarray:
    """Which windows equal one of another text, or of a segment that several texts have."""
    order = np.argsort(w)
    s = w[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    at = np.flatnonzero(new)
    t, settled = t[order], settled[order]
    hit = (np.minimum.reduceat(t, at) != np.maximum.reduceat(t, at)) | np.logical_or.reduceat(settled, at)
    out = np.empty(len(w), bool)
    out[order] = hit[np.cumsum(new) - 1]
    return out


@task("shared_passages")
def _met(batches):
    """Segments in the order of their anchors to (key, first, last) of shared words; batches end between anchors."""
    held: list[tuple] = []
    size = last = 0

    def out():
        keys, firsts, t, settled, parts = zip(*held)
        held.clear()
        part, word, w = windows(list(parts))
        if not len(w):
            return
        settled = np.array(settled)
        hit = _several(w, np.array(t, np.int64)[part], settled[part]) & ~settled[part]  # settled ones are known already
        begin = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1] & (part[1:] == part[:-1])]))
        end = np.flatnonzero(hit & ~np.concatenate([hit[1:] & (part[1:] == part[:-1]), [False]]))
        base = np.array(firsts, np.int64)[part[begin]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([keys[k] for k in part[begin].tolist()], pa.binary()), pa.array((base + word[begin]).astype(np.int32)), pa.array((base + word[end] + LEAST).astype(np.int32))], ["key", "first", "last"]
        )

    for batch in batches:
        for h, *row, part in zip(*(batch.column(c).to_pylist() for c in ("h", "key", "first", "t", "settled", "part"))):
            if h != last and size > BATCH:
                yield from out()
                size = 0
            held.append((*row, part))
            size, last = size + len(part), h
    if held:
        yield from out()


@task("shared_passages")
def _apart(batches):
    """Segments to a row for each of their windows."""
    for batch in batches:
        for rows, parts in _sliced(batch, batch.schema.get_field_index("part")):
            part, word, w = windows(parts)
            h, t, settled, first = (rows.column(rows.schema.get_field_index(c)).to_numpy(zero_copy_only=False)[part] for c in ("h", "t", "settled", "first"))
            keys = rows.column(rows.schema.get_field_index("key")).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), pa.array(w.view(np.int64)), pa.array(t), pa.array(settled), pa.array([keys[k] for k in part.tolist()], pa.binary()), pa.array((first + word).astype(np.int32))], ["h", "w", "t", "settled", "key", "first"]
            )


@task("shared_passages")
def _counted(batches):
    """(key, text) rows to (key, n): all words of a text that has LEAST of them."""
    for batch in batches:
        for part, texts in _sliced(batch, 1):
            n = np.bincount(words_of(texts)[0], minlength=len(texts))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.where(n < LEAST, 0, n))], ["key", "n_shared_words"])


def shared_words(texts: DataFrame) -> DataFrame:
    """(key, n_shared_words) of texts (key, copies, text; keys of 8 bytes or more, a row for each different text): how many words of the
    text are covered by strings of LEAST words that also start in another document, which is another text or another copy of this one.
    Texts without such words may be missing."""
    spark = texts.sparkSession
    places = written(texts.select("key", "text").mapInArrow(_cut, PLACE), "word_segments")
    often = places.groupBy("h").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo < hi").select("h")
    again = written(places.join(often, "h").select(*_COLUMNS), "word_repeated")
    one = F.min(F.struct("t", "key", "first", "start", "end")).alias("one")
    kinds = written(again.groupBy("h", "s").agg(F.count(F.lit(1)).alias("n"), (F.min("t") < F.max("t")).alias("settled"), one), "word_kinds")
    found = again.join(kinds.where("settled").select("h", "s"), ["h", "s"]).select("key", "first", "last")

    meeting = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("unequal"), F.sum(F.when(F.col("settled"), 1).otherwise(F.col("n"))).alias("rows")).where("unequal > 1").select("h", "rows")
    fields = ["h", "rows", "settled", "t", "key", "first", "start", "end"]
    met = kinds.where("n = 1 or settled").join(meeting, "h").select("h", "rows", "settled", "one.*").select(*fields)
    inner = kinds.where("n > 1 and not settled").join(meeting, "h").select("h", "s", "rows", "settled")  # equal segments of one text
    met = met.unionByName(again.join(inner, ["h", "s"]).select(*fields))
    part = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("part")
    parts = written(texts.select("key", "text").join(met, "key").select("h", "rows", "settled", "t", "key", "first", part), "word_parts")
    few = parts.where(F.col("rows") <= MOST).drop("rows")
    found = found.unionByName(few.repartition(partitions(spark), "h").sortWithinPartitions("h").mapInArrow(_met, "key binary, first int, last int"))
    many = parts.where(F.col("rows") > MOST)
    if not many.isEmpty():
        every = written(many.mapInArrow(_apart, "h long, w long, t long, settled boolean, key binary, first int"), "word_windows")
        shared = every.groupBy("h", "w").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.max("settled").alias("any")).where("lo < hi or any").select("h", "w")
        found = found.unionByName(every.where("not settled").join(shared, ["h", "w"]).select("key", "first", (F.col("first") + LEAST).alias("last")))

    spans = found.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans"))  # of one text: bounded by its length
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    covered = F.aggregate("spans", start, lambda x, y: F.struct((x["n"] + F.greatest(F.lit(0), y["last"] - F.greatest(x["reach"], y["first"]))).alias("n"), F.greatest(x["reach"], y["last"]).alias("reach")))
    once = texts.where("copies = 1").select("key").join(spans, "key").select("key", covered["n"].cast("long").alias("n_shared_words"))
    return once.unionByName(texts.where("copies > 1").select("key", "text").mapInArrow(_counted, "key binary, n_shared_words long"))
