"""SimHash fingerprints and permuted block tables.

Each word's 128-bit hash votes on every bit with the word's weight, 1 + log2 of its count; the signs of
the sums are the fingerprint. To find all pairs within a Hamming radius r the bits are cut into r + 2
blocks and a table is keyed by each but the last: two fingerprints within r bits agree in at least two blocks. A pair is
counted in the first table in which it agrees, and large groups of a table are dealt again by the second block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.hashing import mix, slices, word_hashes
from memlake.llm.tiles import link_parts
from memlake.llm.workers import task
from memlake.operators.graph import connected_components
from memlake.session import partitions, ship, written

BITS = 128
RADIUS = 15  # of texts with 2 % of the words changed, 97 of 100 or more are this near; unrelated ones hardly ever are


def fingerprint(words: np.ndarray) -> bytes:
    """16 bytes from a text's word hashes; of no words: zeros."""
    if not len(words):
        return bytes(BITS // 8)
    u, n = np.unique(words, return_counts=True)
    raw = np.stack([mix(mix(u + np.uint64(0x9E3779B97F4A7C15))), mix(mix(u ^ np.uint64(0xD6E8FEB86659FD93)))], 1).view(np.uint8)
    weight = (1 + np.log2(n)).round(3).astype(np.float32)
    total = np.zeros(BITS, np.float64)
    for at in range(0, len(raw), 8192):
        bits = np.unpackbits(raw[at : at + 8192], axis=1)
        total += weight[at : at + 8192] @ (bits.astype(np.float32) * 2 - 1)
    return np.packbits(total > 0).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated cosine of the weighted word vectors, from 0 to 1."""
    if a == b:
        return 1.0
    differ = (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()
    return max(0.0, float(np.cos(np.pi * differ / BITS)))


def edited(text: str, following: str) -> str:
    """text with its last floor(n / 2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_neighbours(docs: DataFrame) -> DataFrame:
    """Rows (bucket, own, doc_id, text) dealt so that, by descending doc_id within a bucket, each own row is followed by its next document.

    Buckets are ranges of doc_id; the first row of a bucket is also sent, not own, to the end of the bucket before it, and the first of all
    to the end of the last.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("at", F.coalesce("doc_id", F.lit(-(1 << 62))))  # null doc_ids come last
    n = partitions(spark) * 4
    cuts = rows.where("doc_id is not null").agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 100 * n)).first()[0] or []
    cuts = sorted(set(cuts))
    numbered = spark.createDataFrame([(cuts,)], "cuts array<long>")  # four numbers for each partition
    bucketed = rows.join(F.broadcast(numbered)).withColumn("bucket", F.size("cuts") - _at_most(F.col("cuts"), F.col("at"), len(cuts))).drop("cuts")
    order = F.struct("at", F.coalesce("text", F.lit("")))
    heads = bucketed.groupBy("bucket").agg(F.max("at").alias("head")).collect()  # a row for each bucket
    heads = sorted((r["bucket"], r["head"]) for r in heads)
    sends = {}
    for k, (_, head) in enumerate(heads):
        before = heads[k - 1][0]
        sends.setdefault(head, []).append(before)
    copies = spark.createDataFrame([(h, b) for h, bs in sends.items() for b in bs], "head long, to int")
    tails = rows.join(F.broadcast(copies), F.col("at") == F.col("head"))  # four rows for each partition
    tails = tails.groupBy("head", "to").agg(F.max(F.struct(order.alias("o"), "doc_id", "text")).alias("r")).select(F.col("to").alias("bucket"), F.lit(False).alias("own"), "r.doc_id", "r.text")
    return bucketed.select("bucket", F.lit(True).alias("own"), "doc_id", "text").unionByName(tails)


def _at_most(cuts, value, n: int):
    """How many of n ascending cuts are at most the value, by halving: as many steps as n has binary digits, in an expression of fixed size."""
    if not n:
        return F.lit(0)

    def step(found, by):
        to = found + by
        return F.when((to <= n) & (F.try_element_at(cuts, to) <= value), to).otherwise(found)

    return F.aggregate(F.array(*(F.lit(1 << k) for k in reversed(range(n.bit_length())))), F.lit(0), step)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint (hex), edited text, its fingerprint and the next document's, of each row of docs(doc_id, text).

    The next document is the following one by descending doc_id (after the last: the first); equal doc_ids follow by descending text, null
    doc_ids come last. A null text is empty; a text of no words has the zero fingerprint; an only row is its own next. Other columns
    are ignored, an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = with_neighbours(docs)
    dealt = rows.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", F.desc("own"), F.desc_nulls_last("doc_id"), F.desc_nulls_last("text"))
    names = ["doc_id", "n_chars", "fingerprint", "edited", "edited_fingerprint", "next_fingerprint"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]

    @task("votes")
    def run(batches):
        held = None
        first = None  # of this bucket, for a table in one bucket

        def pairs(waiting):
            texts = [edited(mine[2], following[2]) for mine, following in waiting]
            prints = [fingerprint(w) for w in word_hashes(texts)]
            rows = [(m[1], len(m[2]), m[3].hex(), t, p.hex(), f[3].hex()) for (m, f), t, p in zip(waiting, texts, prints)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        for b in batches:
            for part, texts in slices(b, 3):
                waiting = []
                for bucket, own, doc, text, words in zip(*(part.column(c).to_pylist() for c in range(3)), texts, word_hashes(texts)):
                    row = (bucket, doc, text or "", fingerprint(words), own)
                    if held is not None:
                        if held[0] == bucket:
                            waiting.append((held, row))
                        else:
                            waiting.append((held, first))
                            held = None
                    if held is None or held[0] != bucket:
                        first = row
                    held = row if own else None
                if waiting:
                    yield pairs(waiting)
        if held is not None:
            yield pairs([(held, first)])

    return dealt.mapInArrow(run, "doc_id long, n_chars long, fingerprint string, edited string, edited_fingerprint string, next_fingerprint string")


def block_codes(prints: np.ndarray, blocks: int) -> np.ndarray:
    """(rows, blocks) numbers: the bits of each block of (rows, 16) fingerprint bytes."""
    bits = np.unpackbits(prints, axis=1)
    edge = np.linspace(0, BITS, blocks + 1).round().astype(int)
    weights = 1 << np.arange(BITS // blocks + 1, dtype=np.uint32)
    return np.stack([bits[:, x:y] @ weights[: y - x] for x, y in zip(edge, edge[1:])], 1).astype(np.uint32)


def near_pairs(a: np.ndarray, b: np.ndarray | None, block: int, radius: int, direct: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of (rows, 16) fingerprint bytes within the radius, all of one code in the block, that agree in no earlier block; i < j in a alone.

    There are radius + 2 blocks, so such a pair agrees in a second block. Where more than `direct` pairs would have to be compared the rows
    are dealt again by each later block, and a pair is taken where it first agrees.
    """
    same = b is None
    ca = block_codes(a, radius + 2)
    cb = ca if same else block_codes(b, radius + 2)
    va = a.view(np.uint64)
    vb = va if same else b.view(np.uint64)
    out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def compare(x, y, second):
        """x, y: places in a and b; second: the later block that both agree in, or None."""
        wide = max(1, 1_000_000 // len(y))
        for at in range(0, len(x), wide):
            part = x[at : at + wide]
            differ = np.bitwise_count(va[part, 0, None] ^ vb[y, 0])
            differ += np.bitwise_count(va[part, 1, None] ^ vb[y, 1])
            i, j = np.nonzero(differ <= radius)
            i, j = part[i], y[j]
            if same:
                keep = i < j
                i, j = i[keep], j[keep]
            agree = ca[i, : block if second is None else second] == cb[j, : block if second is None else second]
            if second is not None:
                agree[:, block] = False
            keep = ~agree.any(1)
            out_i.append(i[keep])
            out_j.append(j[keep])

    if len(va) * len(vb) <= direct:
        compare(np.arange(len(va)), np.arange(len(vb)), None)
    else:
        for second in range(block + 1, radius + 2):
            oa, ob = np.argsort(ca[:, second], kind="stable"), np.argsort(cb[:, second], kind="stable")
            sa, sb = ca[oa, second], cb[ob, second]
            for code in np.intersect1d(sa, sb):
                compare(oa[np.searchsorted(sa, code) : np.searchsorted(sa, code, "right")], ob[np.searchsorted(sb, code) : np.searchsorted(sb, code, "right")], second)
    return np.concatenate(out_i), np.concatenate(out_j)


def _numbers(prints: np.ndarray) -> np.ndarray:
    """A 63-bit number of each (rows, 16) fingerprint bytes."""
    v = prints.view(np.uint64)
    return (mix(mix(v[:, 0]) + v[:, 1]) >> np.uint64(1)).astype(np.int64)


def hamming_classes(prints: DataFrame, radius: int = RADIUS, tile_rows: int = 131_072) -> DataFrame:
    """(fingerprint in lower case, many, n_links, component) of each distinct fingerprint of prints(fingerprint hex).

    n_links counts the other rows within the radius, equal fingerprints among them; component is the number of the smallest fingerprint
    reached. Every pair within the radius is found, whatever the size of a block's group: a group goes to one task for each pair of its
    tiles of about tile_rows fingerprints. Null fingerprints are left out.
    """
    spark = prints.sparkSession
    ship(spark)
    blocks = radius + 2
    counted = prints.where("fingerprint is not null").groupBy(F.unhex("fingerprint").alias("print")).agg(F.count(F.lit(1)).alias("many"))

    def arrays(b, column):
        return np.frombuffer(b"".join(b.column(column).to_pylist()), np.uint8).reshape(-1, BITS // 8)

    @task("blocks")
    def named(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_numbers(arrays(b, 0))), b.column(0), b.column(1)], ["id", "print", "many"])

    classes = written(counted.mapInArrow(named, "id long, print binary, many long"), "fingerprints")
    width = 1 << (-(-BITS // blocks))

    def keys(v):  # the last block is no table: a pair that first agrees there agrees nowhere else
        return (block_codes(v, blocks)[:, :-1] + np.arange(blocks - 1, dtype=np.uint32) * np.uint32(width)).astype(np.int64)

    @task("blocks")
    def sizes(batches):
        n = np.zeros(blocks * width, np.int64)
        for b in batches:
            if b.num_rows:
                n += np.bincount(keys(arrays(b, 1)).ravel(), minlength=len(n))
        on = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(n[on])], ["key", "n"])

    tiles = np.ones(blocks * width, np.int32)
    for r in classes.mapInArrow(sizes, "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).collect():  # blocks * width rows at most
        tiles[r["key"]] = -(-r["n"] // tile_rows)
    form = "key int, u int, v int, tile int, prints binary, many binary"

    @task("blocks")
    def dealt(batches):
        held, size = [], 0

        def out():
            v = np.concatenate([x for x, _ in held])
            many = np.concatenate([y for _, y in held])
            key = keys(v)
            row, key = np.repeat(np.arange(len(v)), key.shape[1]), key.ravel()
            tile = (_numbers(v)[row] >> 20) % tiles[key]
            order = np.lexsort((tile, key))
            row, key, tile = row[order], key[order], tile[order]
            cut = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])))
            rows = []
            for lo, hi in zip(cut, np.append(cut[1:], len(key))):
                k, t, raw, n = int(key[lo]), int(tile[lo]), v[row[lo:hi]].tobytes(), many[row[lo:hi]].tobytes()
                rows += [(k, min(t, o), max(t, o), t, raw, n) for o in range(tiles[k])]
                if len(rows) >= 1000:
                    yield _table(rows, form_kinds, form_names)
                    rows = []
            if rows:
                yield _table(rows, form_kinds, form_names)

        for b in batches:
            if b.num_rows:
                held.append((arrays(b, 1), b.column(2).to_numpy(zero_copy_only=False)))
                size += b.num_rows
            if size > 100_000:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    form_names = [x.split()[0] for x in form.split(", ")]
    form_kinds = [pa.int32()] * 4 + [pa.binary()] * 2

    @task("blocks")
    def compared(batches):
        now, held = None, []

        def out():
            sides = []
            for t in dict.fromkeys(now[1:]):
                mine = [h for h in held if h[0] == t]
                sides.append((np.frombuffer(b"".join(h[1] for h in mine), np.uint8).reshape(-1, BITS // 8), np.frombuffer(b"".join(h[2] for h in mine), np.int64)))
            (a, na), (z, nz) = sides[0], sides[-1]
            i, j = near_pairs(a, None if len(sides) == 1 else z, now[0] // width, radius)
            if len(i):
                if len(sides) > 1:
                    j = j + len(a)
                    a, na = np.concatenate([a, z]), np.concatenate([na, nz])
                yield link_parts(_numbers(a), na, i, j)

        for b in batches:
            for key, u, v, tile, raw, n in zip(*(b.column(c).to_pylist() for c in range(6))):
                if (key, u, v) != now and held:
                    yield from out()
                    held = []
                now = (key, u, v)
                held.append((tile, raw, n))
        if held:
            yield from out()

    work = classes.mapInArrow(dealt, form).repartition(partitions(spark), "key", "u", "v").sortWithinPartitions("key", "u", "v")
    parts = written(work.mapInArrow(compared, "id long, links long, root long"), "hamming-links")
    component = connected_components(parts, "id", "root")
    links = parts.groupBy("id").agg(F.sum("links").alias("links"))
    return classes.join(links, "id", "left").join(component, "id", "left").select(F.lower(F.hex("print")).alias("fingerprint"), "many", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))


def _table(rows: list, kinds: list, names: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
