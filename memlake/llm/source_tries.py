"""How far the sources of a language diverge, term by term, from mergeable radix tries.

A task counts the terms of its documents into one byte trie a language, whose leaves hold a counter for each source and the number of
documents. Tries are cut at common places of the byte order, so that the pieces of one range meet in one task and merge there: equal
paths add their counters. A walk through the merged leaves in UTF-8 order then adds up the divergence of each pair of sources and
streams the candidates of the term report, ties in their order. A term of any frequency is one leaf of a task's trie, so no source,
language or word makes a task heavy.

A trie is laid out in preorder: each leaf says at which depth its path leaves that of the leaf before, and the bytes from there on.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.hashing import slices
from memlake.llm.workers import task
from memlake.session import partitions, ship, written

SCALE = 1_000_000_000
HELD = 400_000  # counters of a task's tries before they are sent off
CHUNK = 4_096  # leaves of a row
RANGE = 200_000  # leaves that a range is cut for, before merging
MOST_CUTS = 20_000  # of at most 16 bytes and a language each: the driver and the tasks hold no more
CUT_BYTES = 16
MOST_SENT = 100_000  # (lang, source) groups, a name and a number each, that are sent to all tasks
TRIE = "names array<string>, shared array<int>, label array<binary>, docs array<long>, width array<int>, source array<int>, count array<long>"
#: Bytes that are no part of a term become spaces; A to Z become a to z.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms [^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+ of a text in UTF-8, only A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while a[low] == b[low]:
        low += 1
    return low


class Trie:
    """Sorted distinct terms with their document counts and counters by source, as arrays.

    width[k] counters belong to leaf k, in the order of the leaves; source is an index into names.
    """

    def __init__(self, names, terms, docs, width, source, count, layout=None):
        """layout: (shared, label) of row() if known."""
        self.names, self.terms, self.layout = names, terms, layout
        self.docs, self.width, self.source, self.count = (np.asarray(x, np.int64) for x in (docs, width, source, count))

    @classmethod
    def counted(cls, docs: Counter, by_source: dict[str, Counter]) -> Trie:
        names, terms = sorted(by_source), sorted(docs)
        at = {t: k for k, t in enumerate(terms)}
        leaf = np.fromiter((at[t] for n in names for t in by_source[n]), np.int64)
        count = np.fromiter((c for n in names for c in by_source[n].values()), np.int64)
        source = np.repeat(np.arange(len(names)), [len(by_source[n]) for n in names])
        order = np.argsort(leaf, kind="stable")
        return cls(names, terms, np.fromiter((docs[t] for t in terms), np.int64, len(terms)), np.bincount(leaf, minlength=len(terms)), source[order], count[order])

    @classmethod
    def merged(cls, tries: list[Trie]) -> Trie:
        """Equal paths add their counters."""
        if len(tries) == 1:
            return tries[0]
        names = sorted({n for t in tries for n in t.names})
        number = {n: k for k, n in enumerate(names)}
        every = [x for t in tries for x in t.terms]
        order = sorted(range(len(every)), key=every.__getitem__)  # merges runs that are sorted already
        terms, leaf = [], np.zeros(len(every), np.int64)
        for k in order:
            if not terms or terms[-1] != every[k]:
                terms.append(every[k])
            leaf[k] = len(terms) - 1
        docs = np.zeros(len(terms), np.int64)
        np.add.at(docs, leaf, np.concatenate([t.docs for t in tries]))
        source = np.concatenate([np.array([number[n] for n in t.names], np.int64)[t.source] for t in tries])
        key = np.repeat(leaf, np.concatenate([t.width for t in tries])) * len(names) + source
        count = np.concatenate([t.count for t in tries])
        by = np.argsort(key, kind="stable")
        key, count = key[by], count[by]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        return cls(names, terms, docs, np.bincount(key[first] // len(names), minlength=len(terms)), key[first] % len(names), np.add.reduceat(count, first) if len(key) else count)

    def ends(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.width)])

    def part(self, begin: int, end: int) -> Trie:
        """Leaves begin..end."""
        return self.parts([begin, end])[0]

    def parts(self, places: list[int]) -> list[Trie]:
        """Leaves from each place up to the next."""
        at, out = self.ends(), []
        for begin, end in zip(places, places[1:]):
            a, b = at[begin], at[end]
            layout = self.layout and ([0, *self.layout[0][begin + 1 : end]], [self.terms[begin], *self.layout[1][begin + 1 : end]])
            out.append(Trie(self.names, self.terms[begin:end], self.docs[begin:end], self.width[begin:end], self.source[a:b], self.count[a:b], layout))
        return out

    def frequent(self, least: int) -> Trie:
        """The leaves of terms in at least so many documents."""
        keep = self.docs >= least
        counter = np.repeat(keep, self.width)
        return Trie(self.names, [t for t, k in zip(self.terms, keep.tolist()) if k], self.docs[keep], self.width[keep], self.source[counter], self.count[counter])

    def row(self) -> dict:
        if self.layout:
            shared, label = self.layout
        else:
            shared = [0] + [_common(a, b) for a, b in zip(self.terms, self.terms[1:])]
            label = [t[s:] for t, s in zip(self.terms, shared)]
        return {"names": self.names, "shared": shared[: len(label)], "label": label, "docs": self.docs, "width": self.width.astype(np.int32), "source": self.source.astype(np.int32), "count": self.count}

    @classmethod
    def read(cls, batch: pa.RecordBatch, k: int) -> Trie:
        cell = lambda c: batch.column(c)[k]
        values = lambda c: cell(c).values.to_numpy(zero_copy_only=False)
        layout = cell("shared").as_py(), cell("label").as_py()
        terms, last = [], b""
        for s, rest in zip(*layout):
            last = last[:s] + rest
            terms.append(last)
        return cls(cell("names").as_py(), terms, values("docs"), values("width"), values("source"), values("count"), layout)


_TYPES = {"lang": pa.string(), "range": pa.int32(), "lo": pa.binary(), "names": pa.list_(pa.string()), "shared": pa.list_(pa.int32()), "label": pa.list_(pa.binary()), "docs": pa.list_(pa.int64()), "width": pa.list_(pa.int32()), "source": pa.list_(pa.int32()), "count": pa.list_(pa.int64())}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], _TYPES[c]) for c in rows[0]], list(rows[0]))


def count_tries(docs: DataFrame) -> DataFrame:
    """(lang, lo, trie): the tries of each task by language, in rows of at most CHUNK leaves; lo is the first leaf's beginning.

    A trie's first row is of a length of its own, and without lo, so that the others begin anywhere: each stands for CHUNK leaves. Were all first rows
    full, the rows of like tries would begin at like places, and the leaves between these could not be cut.
    """
    ship(docs.sparkSession)

    @task("source_tries")
    def run(batches):
        seen: dict[str, Counter] = {}
        counts: dict[str, dict[str, Counter]] = {}
        number, sent = TaskContext.get().partitionId(), 0

        def out():
            nonlocal sent
            for lang in sorted(seen):
                trie, sent = Trie.counted(seen[lang], counts[lang]), sent + 1
                n = len(trie.terms)
                for k, piece in enumerate(trie.parts([0, *range(1 + zlib.crc32(b"%d %d" % (number, sent)) % CHUNK, n, CHUNK), n]) if n else []):
                    yield _batch([{"lang": lang, "lo": piece.terms[0][:CUT_BYTES] if k else None, **piece.row()}])
            seen.clear()
            counts.clear()

        fed = 0
        for batch in batches:
            for part, texts in slices(batch, 2):
                for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts):
                    terms = terms_of(text)
                    seen.setdefault(lang, Counter()).update(set(terms))
                    counts.setdefault(lang, {}).setdefault(source, Counter()).update(terms)
                    fed += len(terms)
                if fed > HELD:  # counters grow no faster than tokens: looked at now and then
                    fed = 0
                    if sum(len(c) for of in counts.values() for c in of.values()) > HELD:
                        yield from out()
        yield from out()

    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text"))).mapInArrow(run, f"lang string, lo binary, {TRIE}")


def cut_places(tries: DataFrame) -> list[tuple[str, bytes]]:
    """Where ranges begin, in the order of (lang, bytes), so that each has about RANGE leaves.

    At most MOST_CUTS places reach the driver, of rows that are sampled if there are more than ten times as many; they decide how
    the work is dealt, not what comes out.
    """
    seen = tries.where("lo IS NOT NULL").select("lang", "lo")
    rows = seen.count()
    if not rows:
        return []
    if rows > 10 * MOST_CUTS:
        seen = seen.sample(10 * MOST_CUTS / rows, 7)
    los = sorted((r["lang"], bytes(r["lo"])) for r in seen.collect())
    n = min(MOST_CUTS, max(1, rows * CHUNK // RANGE))
    return sorted({los[len(los) * k // n] for k in range(1, n)})


def merge_tries(tries: DataFrame, least: int = 3) -> DataFrame:
    """(lang, trie) of the terms in at least `least` documents of their language, from tries cut at common places and merged by range."""
    cuts = cut_places(tries)
    keys = [c[0].encode("utf-8", "surrogatepass") + b"\x00" + c[1] for c in cuts]  # no term holds a zero byte

    @task("source_tries")
    def split(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                lang, trie = batch.column("lang")[k].as_py(), Trie.read(batch, k)
                head = lang.encode("utf-8", "surrogatepass") + b"\x00"
                first, last = bisect_right(keys, head + trie.terms[0]), bisect_right(keys, head + trie.terms[-1])
                places = [0, *(bisect_left(trie.terms, keys[r][len(head) :]) for r in range(first, last)), len(trie.terms)]
                yield _batch([{"range": r, "lang": lang, **piece.row()} for r, piece in enumerate(trie.parts(places), first) if piece.terms])

    @task("source_tries")
    def merge(batches):
        held: list[Trie] = []
        fresh, at = 0, None  # leaves since the last merging

        def out():
            trie = Trie.merged(held).frequent(least)
            for a in range(0, len(trie.terms), CHUNK):
                yield _batch([{"lang": at[1], **trie.part(a, min(a + CHUNK, len(trie.terms))).row()}])

        for batch in batches:
            for k in range(batch.num_rows):
                key = batch.column("range")[k].as_py(), batch.column("lang")[k].as_py()
                if key != at:
                    if held:
                        yield from out()
                    held, fresh, at = [], 0, key
                held.append(Trie.read(batch, k))
                fresh += len(held[-1].terms)
                if fresh > max(RANGE, len(held[0].terms)) and len(held) > 1:
                    held, fresh = [Trie.merged(held)], 0
        if held:
            yield from out()

    pieces = tries.mapInArrow(split, f"range int, lang string, {TRIE}").repartition(partitions(tries.sparkSession), "range", "lang")
    return pieces.sortWithinPartitions("range", "lang").mapInArrow(merge, f"lang string, {TRIE}")


def shares(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total) for each count, by whole numbers of any size."""
    if not count.size:
        return count
    values, back = np.unique(count, return_inverse=True)
    return np.array([1 + SCALE * (int(c) + 1) // total for c in values], np.int64)[back].reshape(np.shape(count))


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); fits 64 bits as no share exceeds 1 + SCALE."""
    return (p - q) * (p - q) // q


def pair_sums(trie: Trie, names: list[str], totals: list[int], v: int) -> np.ndarray:
    """For sources a (row) and b (column) of a language: the gap of a's share against b's, summed over the trie's leaves.

    Most terms miss most sources, so a leaf is looked at for the sources that have it; what two sources both lack counts at once.
    """
    n, leaves = len(names), len(trie.terms)
    number = {x: k for k, x in enumerate(names)}
    leaf, source = np.repeat(np.arange(leaves), trie.width), np.array([number[x] for x in trie.names], np.int64)[trie.source]
    zero = np.array([1 + SCALE // (t + v) for t in totals], np.int64)
    out = np.zeros((n, n), np.int64)
    mine = [np.flatnonzero(source == a) for a in range(n)]
    for a in range(n):  # as if no other source had any term
        counts, often = np.unique(trie.count[mine[a]], return_counts=True)
        p = shares(counts, totals[a] + v)
        out[a] = (leaves - len(mine[a])) * gap(zero[a], zero) + (gap(p[:, None], zero[None, :]) * often[:, None]).sum(0)
    step = max(1, 2_000_000 // max(1, n))
    ends = trie.ends()
    for begin in range(0, leaves, step):
        a, b = ends[begin], ends[min(begin + step, leaves)]
        p = np.repeat(zero[None, :], min(step, leaves - begin), 0)
        own, at, counts = source[a:b], leaf[a:b] - begin, trie.count[a:b]
        for s in range(n):
            k = own == s
            p[at[k], s] = shares(counts[k], totals[s] + v)
        for s in range(n):  # put right for the sources that do have the term
            rows = at[own == s]
            if len(rows):
                q = p[rows, s][:, None]
                out[:, s] += (gap(p[rows], q) - gap(p[rows], zero[s])).sum(0)
    return out


def candidates(trie: Trie, names: list[str], totals: list[int], v: int, most: int) -> dict[str, list[tuple[int, bytes]]]:
    """Per source its first `most` (-value, term) of the leaves it has and whose share is above the language's."""
    if not trie.terms:
        return {}
    number = dict(zip(names, totals))
    leaf = np.repeat(np.arange(len(trie.terms)), trie.width)
    whole = np.zeros(len(trie.terms), np.int64)
    np.add.at(whole, leaf, trie.count)
    q = shares(whole, sum(totals) + v)
    out = {}
    for s, name in enumerate(trie.names):
        k = np.flatnonzero(trie.source == s)
        p, base = shares(trie.count[k], number[name] + v), q[leaf[k]]
        above = p > base
        value, at = gap(p[above], base[above]), leaf[k][above]
        best = np.lexsort((at, -value))[:most]  # leaves are in UTF-8 order
        out[name] = [(-int(value[b]), trie.terms[at[b]]) for b in best]
    return out


def divergence(docs: DataFrame, least: int = 3, most: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank of docs (lang, source, text): part `pair` for each other source of the language, part
    `term` for the first `most` terms that the source uses more than its language does.

    A null lang, source or text is ''; rows are documents, so repeated rows count each; a text may be of any length. A (lang, source)
    group without terms has its pairs; a language of one source has no pair; an empty table gives no rows. Ties go by the item's UTF-8
    bytes. Other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    kept = written(merge_tries(written(count_tries(docs), "tries"), least), "kept-tries")
    groups = written(docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct(), "sources")
    leaves = kept.select("lang", F.explode(F.arrays_zip(F.transform("source", lambda k: F.element_at("names", k + 1)).alias("source"), F.col("count").alias("n"))).alias("c"))
    sums = leaves.groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n"))
    terms = kept.groupBy("lang").agg(F.sum(F.size("label")).alias("v"))
    known = groups.join(sums, ["lang", "source"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("of"))  # a row a language, as wide as it has sources
    sized = known.join(terms, "lang").select("lang", F.col("of.source").alias("all_names"), F.col("of.n").alias("totals"), "v")
    if groups.count() <= MOST_SENT:  # a join would deal by language, and one may hold nearly all; beyond this size adaptive execution splits it
        sized = F.broadcast(sized)

    @task("source_tries")
    def walk(batches):
        pairs: dict[str, tuple[list[str], np.ndarray]] = {}
        tops: dict[tuple[str, str], list[tuple[int, bytes]]] = {}

        def rows(found):
            for at in range(0, len(found), 10_000):
                cols = list(zip(*found[at : at + 10_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()))], ["lang", "source", "part", "item", "value"])

        def listed(lang, names, sums):
            for a, x in enumerate(names):
                yield from rows([(lang, x, "pair", y, int(sums[a, b])) for b, y in enumerate(names) if a != b])

        for batch in batches:
            for k in range(batch.num_rows):
                lang, names, totals, v = (batch.column(c)[k].as_py() for c in ("lang", "all_names", "totals", "v"))
                trie = Trie.read(batch, k)
                sums = pair_sums(trie, names, totals, v)
                if len(names) > 1000:  # too wide to be held
                    yield from listed(lang, names, sums)
                elif lang in pairs:
                    pairs[lang][1][:] += sums
                else:
                    pairs[lang] = names, sums
                for source, best in candidates(trie, names, totals, v, most).items():
                    held = tops.setdefault((lang, source), [])
                    held += best
                    if len(held) > 8 * most:
                        held.sort()
                        del held[most:]
        for lang, (names, sums) in pairs.items():
            yield from listed(lang, names, sums)
        for (lang, source), held in tops.items():
            yield from rows([(lang, source, "term", t.decode("utf-8", "surrogatepass"), -value) for value, t in sorted(held)[:most]])

    found = written(kept.join(sized, "lang").mapInArrow(walk, "lang string, source string, part string, item string, value long"), "divergence")
    added = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    other = groups.join(groups.withColumnRenamed("source", "item"), "lang").where("source <> item")
    pair = other.join(added, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = lambda df: df.select("lang", "source", "part", "item", "value", rank.alias("rank"))
    return ranked(pair).unionByName(ranked(found.where("part = 'term'")).where(F.col("rank") <= most))
