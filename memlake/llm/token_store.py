"""Token ids as directly addressable codes.

An id is split into chunks of a fixed number of bits; level k holds chunk k of every id that has one,
a bitmap that tells which of them go on to level k + 1, and a rank directory (ones before every 512th
bit). Any token is read by one step a level, without decoding its neighbours. Blocks of whole
documents are rows of a Parquet table, so that any store Spark writes to can hold them.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.session import partitions, ship, work_dir

MAGIC = b"DAC1"
RANK = 512
BLOCK = 2_000_000
STORED = "part int, block int, first long, n_docs int, n_tokens long, payload binary"


def encode_block(ids: np.ndarray, bits: int = 8) -> bytes:
    """One block; bits is 8 or 16. Layout: magic, bits, levels, n; per level its length, chunks, bitmap, rank directory (each padded to 8 bytes)."""
    kind = {8: np.dtype("<u1"), 16: np.dtype("<u2")}[bits]
    rest, levels = ids.astype("<u4"), []
    while True:
        more = rest >> bits
        goes = more > 0
        levels.append(((rest & ((1 << bits) - 1)).astype(kind), goes))
        if not goes.any():
            break
        rest = more[goes]
    out = [MAGIC, struct.pack("<HHq", bits, len(levels), len(ids))]
    for chunks, goes in levels:
        padded = np.zeros(-(-len(goes) // RANK) * RANK, bool)
        padded[: len(goes)] = goes
        ones = padded.reshape(-1, RANK).sum(1, dtype=np.int64)
        ranks = (np.cumsum(ones) - ones).astype("<u4")
        out.append(struct.pack("<q", len(chunks)))
        for raw in (chunks.tobytes(), np.packbits(padded, bitorder="little").tobytes(), ranks.tobytes()):
            out.append(raw + bytes(-len(raw) % 8))
    return b"".join(out)


class Block:
    """A block opened without decoding it."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a token block")
        bits, levels, self.n = struct.unpack_from("<HHq", payload, 4)
        self.bits, self.levels, at = bits, [], 16
        kind = {8: np.dtype("<u1"), 16: np.dtype("<u2")}[bits]
        for _ in range(levels):
            (n,) = struct.unpack_from("<q", payload, at)
            at += 8
            blocks = -(-n // RANK)
            parts = []
            for dtype, count in ((kind, n), (np.dtype("<u1"), blocks * RANK // 8), (np.dtype("<u4"), blocks)):
                parts.append(np.frombuffer(payload, dtype, count, at))
                at += -(-count * dtype.itemsize // 8) * 8
            self.levels.append(parts)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        """Token i, by a rank at each level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, shift = 0, 0
        for chunks, bitmap, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                return value
            start = i // RANK * RANK
            i = int(ranks[i // RANK]) + int(np.unpackbits(bitmap[start >> 3 : (i >> 3) + 1], bitorder="little")[: i - start].sum())
            shift += self.bits
        raise ValueError("broken block")

    def slice(self, begin: int, end: int) -> np.ndarray:
        """Tokens begin..end, touching only their own chunks at each level."""
        out = np.zeros(max(0, end - begin), "<u4")
        where, lo, hi = np.arange(len(out)), begin, end
        for level, (chunks, bitmap, ranks) in enumerate(self.levels):
            if hi <= lo:
                break
            out[where] |= chunks[lo:hi].astype("<u4") << np.uint32(level * self.bits)
            first = lo // RANK * RANK
            ones = np.unpackbits(bitmap[first >> 3 : -(-hi // 8)], bitorder="little")[: hi - first].view(bool)
            skipped = int(ones[: lo - first].sum())
            goes = ones[lo - first :]
            where = where[goes]
            lo = int(ranks[lo // RANK]) + skipped if level + 1 < len(self.levels) else 0
            hi = lo + len(where)
        return out


def document_block(docs: list[tuple[int | None, np.ndarray]]) -> bytes:
    """A directory (doc ids with a null flag, offsets) and the coded ids of whole documents."""
    ids = np.array([d or 0 for d, _ in docs], "<i8")
    null = np.array([d is None for d, _ in docs], "<u1")
    ends = np.cumsum([len(x) for _, x in docs]).astype("<i8")
    head = struct.pack("<q", len(docs)) + ids.tobytes() + ends.tobytes() + null.tobytes()
    return head + bytes(-len(head) % 8) + encode_block(np.concatenate([x for _, x in docs]) if docs else np.zeros(0, "<u4"))


def open_documents(payload: bytes) -> tuple[list, np.ndarray, Block]:
    (n,) = struct.unpack_from("<q", payload, 0)
    ids = np.frombuffer(payload, "<i8", n, 8)
    ends = np.frombuffer(payload, "<i8", n, 8 + 8 * n)
    null = np.frombuffer(payload, "<u1", n, 8 + 16 * n)
    head = 8 + 17 * n
    return [None if z else int(d) for d, z in zip(ids, null)], ends, Block(payload[head + -head % 8 :])


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, block_tokens: int = BLOCK) -> None:
    """Writes the ids of docs (doc_id, text) in ascending doc_id order: part, block and the order within a block follow doc_id.

    A null text is empty; null doc_ids come first; rows with the same doc_id stay apart, in order of their text. Other columns are ignored.
    A document is never split over blocks, so a block is at most block_tokens and one document.
    """
    spark = docs.sparkSession
    ship(spark)

    def run(batches):
        from pyspark import TaskContext

        from memlake.llm.chunk_bpe import shared

        enc, part = shared(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4")
        held: list = []
        size = first = block = 0

        def out():
            nonlocal held, size, first, block
            rows = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([len(held)], pa.int32()), pa.array([size], pa.int64()), pa.array([document_block(held)], pa.binary())],
                ["part", "block", "first", "n_docs", "n_tokens", "payload"],
            )
            first, block, held, size = first + size, block + 1, [], 0
            return rows

        for b in batches:
            for at in range(0, b.num_rows, 500):
                rows = b.slice(at, 500)
                for doc, raw in zip(rows.column(0).to_pylist(), enc.encode([t or "" for t in rows.column(1).to_pylist()])):
                    ids = np.concatenate([np.frombuffer(raw, enc.type).astype("<u4"), end])
                    held.append((doc, ids))
                    size += len(ids)
                    if size >= block_tokens:
                        yield out()
        if held:
            yield out()

    (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first())  # not by text: the range sample goes to the driver
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
        .mapInArrow(run, STORED)
        .write.option("compression", "uncompressed")
        .parquet(path)
    )


def read_tokens(spark, path: str) -> DataFrame:
    """Per document of the files at path, in no order: doc_id, start (ids of all documents before it), ids (little-endian unsigned 32-bit)."""
    ship(spark)
    stored = spark.read.schema(STORED).parquet(path)
    sizes = sorted((r["part"], r["n"]) for r in stored.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())  # a row for each partition of the write
    starts, total = {}, 0
    for part, n in sizes:
        starts[part] = total
        total += n

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                row = {c: b.column(c)[k].as_py() for c in ("part", "first", "payload")}
                ids, ends, block = open_documents(row["payload"])
                base, begin = starts[row["part"]] + row["first"], 0
                got: list = []
                for doc, end in zip(ids, ends.tolist()):
                    got.append((doc, base + begin, block.slice(begin, end).tobytes()))
                    begin = end
                    if len(got) == 1000 or end == len(block):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), (pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "start", "ids"])
                        got = []

    return stored.select("part", "first", "payload").mapInArrow(run, "doc_id long, start long, ids binary")


def store_and_read(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    path = work_dir(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer, path, end_id)
    return read_tokens(docs.sparkSession, path)
