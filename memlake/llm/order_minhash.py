"""Near-duplicates by Order MinHash and banded alignment.

A text's k-mers are its five-word shingles, labelled by occurrence. Each sketch takes the `length` smallest of them under one
hash and keeps their text order, so texts collide when they share k-mers in the same order (edit similarity), not just as a set.
Sketches miss alike texts of few shingles, so those also collide by a prefix filter, which misses none.
Equal texts are one class from the start. Texts that collide are first compared with pivots of their bucket, which joins most of a
large group with few pairs; in the buckets whose texts have not become one component then, every pair of texts of different
components is compared, by tiles. A candidate pair is a link when a banded alignment of the two shingle sequences finds matches m
with m / (n_a + n_b - m) >= threshold.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.hashing import mix, slices, word_hashes
from memlake.llm.tiles import tile_links
from memlake.llm.workers import task
from memlake.operators.graph import connected_components
from memlake.session import ship, written

WORDS = 5
THRESHOLD = 0.8
SKETCHES, LENGTH = 28, 6
FIRST = 7  # sketches of the first turn; it joins most of a large group with few pairs
PIVOTS = 2
TURNS = 4  # turns of pivots before the buckets still open are compared in full
SHORT = 16  # a link with a text of fewer shingles is found for sure
TILE = 256  # texts of one side of a comparison in full
SALT = 1000  # members of a bucket that one task joins with its pivots

_MASK = (1 << 64) - 1


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the shingles of a text's word hashes, in order; a text of fewer words is one shingle, an empty one has none."""
    if len(words) == 0:
        return words
    n = max(1, len(words) - WORDS + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(words))):
        out = mix(out + words[k : k + n] + np.uint64(k + 1))
    return out


def labelled(s: np.ndarray) -> np.ndarray:
    """Shingles told apart by their occurrence number."""
    if len(s) < 2:
        return s
    order = np.argsort(s, kind="stable")
    same = np.append(False, s[order][1:] == s[order][:-1])
    if not same.any():
        return s
    at = np.arange(len(s))
    first = np.maximum.accumulate(np.where(same, 0, at))
    nth = np.empty(len(s), np.uint64)
    nth[order] = at - first
    return np.where(nth > 0, mix(s + nth * np.uint64(0x9E3779B97F4A7C15)), s)


_SEEDS = [np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) & _MASK) for k in range(256)]


def order_min_hash(s: np.ndarray, sketches: int = SKETCHES, length: int = LENGTH) -> list[int]:
    """One signed 64-bit signature a sketch: the `length` smallest labelled k-mers in text order. Empty for an empty text."""
    if len(s) == 0:
        return []
    x = labelled(s)
    n = len(x)
    rough = np.uint64(min(_MASK, int(_MASK / n * (length + 14)))) if n > 4 * length else np.uint64(_MASK)
    out = []
    for k in range(sketches):
        h = (x ^ _SEEDS[k]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        at = np.flatnonzero(h <= rough)
        if len(at) < min(length, n):
            at = np.arange(n)
        if len(at) > length:
            at = np.sort(at[np.lexsort((at, h[at]))[:length]])
        out.append(struct.unpack("<q", hashlib.blake2b(x[at].tobytes(), digest_size=8, key=bytes([k])).digest())[0])
    return out


def prefix(s: np.ndarray, threshold: float = THRESHOLD) -> list[int]:
    """Signatures of a text short enough to be alike one of under SHORT shingles: the first labelled shingles in the order of a hash.

    Alike texts have at least threshold * n labelled shingles in common with either of n, so one is among the first n - ceil(threshold * n) + 1 of both.
    """
    n = len(s)
    if not n or n > (SHORT - 1) / threshold + 1e-9:
        return []
    h = np.sort(mix((labelled(s) ^ np.uint64(0x2545F4914F6CDD1D)) * np.uint64(0xD6E8FEB86659FD93)))
    return h[: min(n, n - int(np.ceil(threshold * n - 1e-9)) + 1)].view(np.int64).tolist()


def most_edits(na: int, nb: int, threshold: float) -> int:
    """Most insertions and deletions between sequences that reach the threshold."""
    least = int(np.ceil(threshold / (1 + threshold) * (na + nb) - 1e-9))
    return na + nb - 2 * least


def banded_matches(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence whose matches lie within `band` of the diagonal, one bit a position of a."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    places: dict[int, list[int]] = {}
    for k, x in enumerate(a.tolist()):
        places.setdefault(x, []).append(k)
    full = (1 << len(a)) - 1
    v = full
    for j, y in enumerate(b.tolist()):
        if (at := places.get(y)) is not None:
            m = 0
            for k in at:
                if -band <= k - j <= band:
                    m |= 1 << k
            u = v & m
            v = ((v + u) | (v - u)) & full
    return head + tail + len(a) - v.bit_count()


def similar(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> bool:
    """Whether the banded alignment of two shingle sequences reaches the threshold; exact, as matches of such an alignment never leave the band."""
    edits = most_edits(len(a), len(b), threshold)
    if edits < 0 or abs(len(a) - len(b)) > edits:
        return False
    need = threshold / (1 + threshold) * (len(a) + len(b)) - 1e-9
    if len(a) > 64:  # a count of common shingles bounds the alignment from above and is cheaper
        ua, ca = np.unique(a, return_counts=True)
        ub, cb = np.unique(b, return_counts=True)
        _, i, j = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
        if np.minimum(ca[i], cb[j]).sum() < need:
            return False
    return banded_matches(a, b, edits) >= need


def sketch(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, row_key, digest, signatures) of each row of docs(doc_id, text).

    row_key is a hash of the text as it is, digest one of its words; the signatures are those of the sketches, then of the prefix of a short text.
    """
    ship(docs.sparkSession)

    @task("shingles")
    def run(batches):
        for b in batches:
            for part, texts in slices(b, 2):
                digests, found = [], []
                for words in word_hashes(texts):
                    digests.append(hashlib.md5(words.tobytes()).digest())
                    x = shingles(words)
                    found.append(order_min_hash(x) + prefix(x, threshold))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(digests, pa.binary()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "row_key", "digest", "signatures"])

    return _rows(docs).mapInArrow(run, "doc_id long, row_key long, digest binary, signatures array<long>")


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(text).alias("row_key"), text.alias("text"))


def row_key(text):
    """Tells apart the texts of rows that share a doc_id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _sequences(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(id, seq) of members(id, doc_id, row_key): the shingles of the text of a class. A row that docs repeats comes once."""

    @task("shingles")
    def run(batches):
        last = None  # rows of one id are neighbours
        for b in batches:
            for part, texts in slices(b, 1):
                ids = part.column(0).to_pylist()
                new = [k for k, i in enumerate(ids) if i != (ids[k - 1] if k else last)]
                last = ids[-1]
                words = word_hashes([texts[k] for k in new])
                yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in new], pa.int64()), pa.array([shingles(w).tobytes() for w in words], pa.binary())], ["id", "seq"])

    found = _rows(docs).join(members.hint("shuffle_merge"), ["doc_id", "row_key"])
    return found.select("id", "text").mapInArrow(run, "id long, seq binary")


def _links(pairs: DataFrame, seqs: DataFrame, threshold: float) -> DataFrame:
    @task("shingles")
    def run(batches):
        for b in batches:
            a, z = b.column(0), b.column(1)
            sa, sb = b.column(2), b.column(3)
            good = [similar(np.frombuffer(sa[k].as_buffer(), np.uint64), np.frombuffer(sb[k].as_buffer(), np.uint64), threshold) for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([a, z, pa.array(good, pa.bool_())], ["a", "b", "linked"])

    both = pairs.join(seqs.select(F.col("id").alias("a"), F.col("seq").alias("sa")), "a").join(seqs.select(F.col("id").alias("b"), F.col("seq").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, linked boolean").where("linked").select("a", "b")


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Number of labelled shingles in common of each text of a with each of b; no alignment has more matches."""
    out = np.zeros((len(a), len(b)), np.int64)
    x, of = np.concatenate(a), np.repeat(np.arange(len(a)), [len(v) for v in a])
    order = np.argsort(x, kind="stable")
    x, of = x[order], of[order]
    for j, v in enumerate(b):
        lo = np.searchsorted(x, v, "left")
        n = np.searchsorted(x, v, "right") - lo
        at = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        out[:, j] = np.bincount(of[at], minlength=len(a))
    return out


def cross_links(sketch: int, a: pa.StructArray, b: pa.StructArray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) between texts of different components, i < j within a alone, enough of them to join all that links join here.

    The rows are (component, marks, seq). A pair that has an earlier sketch in common is left to that sketch's bucket.
    """

    def ready(v):
        return v.field("component").to_numpy(zero_copy_only=False), v.field("marks").flatten().to_numpy(zero_copy_only=False).reshape(len(v), SKETCHES), [np.frombuffer(x, np.uint64) for x in v.field("seq").to_pylist()]

    ca, ma, sa = ready(a)
    cb, mb, sb = (ca, ma, sa) if b is None else ready(b)
    na, nb = np.array([len(x) for x in sa]), np.array([len(x) for x in sb])
    least = threshold / (1 + threshold) * (na[:, None] + nb) - 1e-9
    ask = (ca[:, None] != cb) & (np.minimum(na[:, None], nb) >= least)
    if b is None:
        ask &= np.arange(len(na))[:, None] < np.arange(len(nb))
    for k in range(sketch):
        ask &= ma[:, k, None] != mb[:, k]
    rows, columns = np.flatnonzero(ask.any(1)), np.flatnonzero(ask.any(0))
    if not len(rows):
        return rows, columns
    common = _common([labelled(sa[k]) for k in rows], [labelled(sb[k]) for k in columns])
    part = np.ix_(rows, columns)
    i, j = np.nonzero(ask[part] & (common >= least[part]))
    names = np.unique(np.concatenate([ca, cb]), return_inverse=True)[1]
    at, to = names[: len(ca)], names[len(ca) :]
    parent = list(range(len(names)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    for x, y in zip(rows[i].tolist(), columns[j].tolist()):
        p, q = root(at[x]), root(to[y])
        if p != q and similar(sa[x], sb[y], threshold):
            parent[p] = q
            found.append((x, y))
    both = np.array(found, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def bucket_components(bucket: DataFrame, marks: DataFrame, seqs: DataFrame, threshold: float = THRESHOLD, tile_rows: int = TILE) -> DataFrame:
    """(id, component) of the ids of bucket(id, sketch, sig, salts): the components of all links between ids that share a sig.

    marks(id, marks) has the first SKETCHES signatures of an id, seqs(id, seq) its shingles; salts is the number of parts in which a sig's
    members are joined, so that a bucket of any size spreads over the cluster.
    """
    component = bucket.select("id", F.col("id").alias("component")).distinct()
    bucket = bucket.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))

    def about(members, *aggregates):
        """A row a sig and salt with the aggregates of the whole sig."""
        return members.groupBy("sig", "salts").agg(*aggregates).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    def still_open(members):
        ends = about(members, F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size"))
        return members.join(ends.where("lo < hi").drop("lo", "hi"), ["sig", "salt"])

    def merged(links):
        joined = connected_components(links).select(F.col("id").alias("component"), F.col("component").alias("now"))
        return written(component.join(joined, "component", "left").select("id", F.coalesce("now", "component").alias("component")), "components")

    def between(links):
        ends = component.select(F.col("id").alias("x"), F.col("component").alias("of"))
        return links.join(ends.withColumnsRenamed({"x": "a", "of": "ca"}), "a").join(ends.withColumnsRenamed({"x": "b", "of": "cb"}), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()

    tested = None
    for turn in range(TURNS):
        members = (bucket.where(F.col("sketch") < FIRST) if turn == 0 else bucket).select("sig", "salts", "salt", "id").join(component, "id")
        if turn:
            members = still_open(members)
        # One order for all buckets of a turn: those of a group of copies have mostly the same pivots, so a text meets each but once.
        rank = [F.min(F.struct(F.xxhash64("id", F.lit(turn * PIVOTS + p)), "id", "component")).alias(f"p{p}") for p in range(PIVOTS)]
        chosen = F.array_distinct(F.array(*(F.struct(F.col(f"p{p}.id"), F.col(f"p{p}.component").alias("of")) for p in range(PIVOTS))))
        pivots = about(members, *rank).select("sig", "salt", F.explode(chosen).alias("pivot")).select("sig", "salt", F.col("pivot.id").alias("pivot"), "pivot.of")
        pairs = members.join(pivots, ["sig", "salt"]).where("component <> of").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
        pairs = written(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = _links(pairs, seqs, threshold)
        links = written(between(links) if turn else links, "links")
        if links.isEmpty():
            if turn:
                break  # the pivots find no more; all that is open is compared in full below
            continue
        component = merged(links)
    # What the pivots left: a bucket of two was tested by the first turn over all buckets, larger ones are compared in full.
    rest = still_open(bucket.select("sig", "salts", "salt", F.least("sketch", F.lit(SKETCHES)).alias("sketch"), "id").join(component, "id")).where("size > 2")
    rest = rest.join(marks, "id").join(seqs, "id").select("sketch", "sig", "id", F.lit(1).cast("long").alias("many"), F.struct("component", "marks", "seq").alias("payload"))
    compared = tile_links(rest, ["sketch", "sig"], lambda key, a, b: cross_links(key[0], a, b, threshold), tile_rows)
    links = written(between(compared.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))), "links")
    return component if links.isEmpty() else merged(links)


def classify(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, row_key, class_id) of every row of docs(doc_id, text); see near_duplicates. row_key is row_key(text)."""
    rows = written(sketch(docs, threshold), "sketches")
    known = rows.where("doc_id is not null").withColumn("id", F.xxhash64("digest"))
    classes = written(
        known.groupBy("id").agg(F.min(F.struct("doc_id", "row_key", "signatures")).alias("r")).select("id", "r.doc_id", "r.row_key", "r.signatures"),
        "text-classes",
    )
    entries = classes.select("id", F.posexplode("signatures").alias("sketch", "sig"))
    shared = entries.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sig", F.ceil(F.col("n") / SALT).cast("int").alias("salts"))
    bucket = written(entries.join(shared, "sig"), "buckets")
    seqs = written(_sequences(docs, classes.join(bucket.select("id").distinct(), "id", "left_semi").select("id", "doc_id", "row_key")), "sequences")
    marks = classes.select("id", F.slice("signatures", 1, SKETCHES).alias("marks"))
    component = bucket_components(bucket, marks, seqs, threshold)
    joined = classes.select("id", "doc_id").join(component, "id", "left").select("id", "doc_id", F.coalesce("component", "id").alias("component"))
    least = joined.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    named = known.select("doc_id", "row_key", "id").join(joined.join(least, "component").select("id", "class_id"), "id").select("doc_id", "row_key", "class_id")
    lone = rows.where("doc_id is null").select("doc_id", "row_key", F.lit(None).cast("long").alias("class_id"))
    return named.unionByName(lone)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, kept for every row of docs(doc_id, text): class_id is the smallest doc_id that links reach, kept marks it.

    Null and empty texts are equal to each other. A null doc_id joins no class: class_id null, kept true. Rows that share a doc_id are
    judged each by its own text, so they may be of different classes. An empty table gives no rows; other columns are ignored.
    """
    return classify(docs, threshold).select("doc_id", "class_id").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def representatives(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of docs for each class, with all its columns: a row of the smallest doc_id; of rows that repeat doc_id and class the first by row_key, then by a hash of their other columns.

    Rows with a null doc_id stay. An empty table gives no rows.
    """
    first = classify(docs, threshold).where("class_id is not null").groupBy("class_id").agg(F.min(F.struct("doc_id", "row_key")).alias("r")).select(F.col("r.doc_id").alias("of"), F.col("r.row_key").alias("key"))
    columns = docs.columns
    fit = F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)))
    whole = docs.select(fit.alias("row"), F.col("doc_id").cast("long").alias("of"), row_key(F.col("text").cast("string")).alias("key"))
    kept = whole.join(first, ["of", "key"], "left_semi")
    plain = [f"row.c{k}" for k, f in enumerate(docs.schema.fields) if "map<" not in f.dataType.simpleString()]
    nth = F.row_number().over(Window.partitionBy("of", "key").orderBy(F.xxhash64(*plain)))
    one = kept.withColumn("nth", nth).where("nth = 1").select("row")
    return one.unionByName(whole.where("of is null").select("row")).select(*(F.col(f"row.c{k}").alias(c) for k, c in enumerate(columns)))
