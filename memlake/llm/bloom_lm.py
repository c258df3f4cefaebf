"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

A count c becomes the level 1 + floor(log_BASE c), and an n-gram is inserted once for each level up to its own; asking level
after level until one is missing gives the count back. The first level is asked for `checks` times and levels from HEAVY on twice, each time by bits of its own, so
that all V words together add less than STRAY absent continuations to a history; what higher levels answer too often on average is
taken off by their known rate of error. The filter is made of shards, each filled by one task from the counts of its own n-grams. The
bigram model is
    P(w | h) = (1 - new_q) v(h, w) / M_q + new_q P1(w),   P1(w) = (v(w) + 0.5) / (sum of v + 0.5 (V + 1)),
where v is the value of a level, from probes, q the history's level and M_q the mean over histories of level q of the sum of v(h, .), so that
the probabilities of a level's histories sum to 1 on average; a history's own sum differs as its counts are rounded to levels. new_q, the
share of unseen continuations after histories of level q, is Good-Turing's count of singletons over the whole training text. A bigram's
level is at most that of either word. Exact unigram counts serve the base score alone.

Filter and counts grow with the corpus, so neither is sent anywhere: the texts are cut into chunks, each chunk asks every shard once for its
own distinct n-grams, in the shuffle that brings their counts there, and the task that fills the shard answers. Answers come back by
chunk. So each text is read once and moved never, and the work grows with the corpus alone.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.hashing import character, hash_spans, mix, runs, summed
from memlake.llm.workers import task
from memlake.session import bucketed, ship, written

BASE = 1.35
HASHES = 5  # bits an entry sets, all in one 64-bit word
ROOM = 10.5  # bits of the filter an entry has; a missing entry is taken for one that is in with a chance of some 1.6 %
ERROR = 1 / 60
STRAY = 0.01
MAX_BROADCAST = 192_000_000  # bytes of keys that a task may hold at once; nothing is broadcast
SHARD_TEXT = 4_000_000  # bytes of text for each shard
FLUSH = 1_000_000  # tokens of a chunk
FOLDS, HELD = 5, 1
HEAVY = 8  # from this level on (counts of 8 and more) n-grams are few and each weighs much
CHECK = 128  # further entries of the first level have numbers above all levels
TOP = 119  # level of the start of a text, above all levels of counts
END, START = np.uint64(0x1D8AF6C1B5E0337F), np.uint64(0x5851F42D4C957F2D)


def bigrams(w: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(history, 64-bit bigram key) of each token of texts laid end to end; ends are the places after each text."""
    h = np.empty_like(w)
    h[1:] = w[:-1]
    h[:1] = START
    h[ends[:-1]] = START
    return h, mix(mix(h) + w)


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def level_of(count: np.ndarray) -> np.ndarray:
    return (1 + np.floor(np.log(np.maximum(count, 1)) / np.log(BASE) + 1e-9)).astype(np.int64)


def level_values(most: int = 120) -> np.ndarray:
    """The count that each level stands for: the middle of the whole numbers in it; 0 for level 0."""
    out = np.zeros(most)
    for k in range(1, most):
        low, high = np.ceil(BASE ** (k - 1) - 1e-9), np.ceil(BASE**k - 1e-9) - 1
        out[k] = (low + max(low, high)) / 2
    return out


def word_and_mask(key: np.ndarray, level: int, words) -> tuple[np.ndarray, np.ndarray]:
    """Word of an entry among `words` of 64 bits, so that one look answers for it, and its bits there."""
    a = mix(key + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    h = a * np.uint64(0xC2B2AE3D27D4EB4F)
    mask = np.uint64(1) << (h >> np.uint64(58))
    for k in range(1, HASHES):
        mask |= np.uint64(1) << (h >> np.uint64(58 - 6 * k) & np.uint64(63))
    return (a >> np.uint64(32)) * words >> np.uint64(32), mask


def checks_for(distinct: int) -> int:
    """How often the first level is asked for, so that among `distinct` words fewer than STRAY absent ones pass."""
    return max(1, int(np.ceil(np.log(STRAY / (distinct + 1)) / np.log(ERROR))))


def entries(level: int, checks: int) -> list[int]:
    """Numbers of the entries that stand for a level: `checks` for the first, two from HEAVY on, else one."""
    return [level + CHECK * k for k in range(checks if level == 1 else 2 if level >= HEAVY else 1)]


def build_filter(key: np.ndarray, level: np.ndarray, checks: int) -> bytes:
    """The words of one shard."""
    words = max(1, int((level + np.maximum(level - HEAVY + 1, 0) + (checks - 1)).sum() * ROOM / 64))
    out = np.zeros(words, np.uint64)
    step = 1
    while len(key):
        for number in entries(step, checks):
            word, mask = word_and_mask(key, number, np.uint64(words))
            np.bitwise_or.at(out, word.astype(np.int64), mask)
        step += 1
        keep = level >= step
        key, level = key[keep], level[keep]
    return out.tobytes()


class Filter:
    """Shards of the filter; answers for keys of the shards it holds."""

    def __init__(self, sizes: dict[int, int], shards: int, checks: int):
        """sizes: bytes of each shard; put() fills them in."""
        self.shards, self.checks = shards, checks
        self.words = np.zeros(shards, np.uint64)
        self.start = np.full(shards, -1, np.int64)
        at = 0
        for s in sorted(sizes):
            self.words[s], self.start[s] = sizes[s] // 8, at
            at += sizes[s] // 8
        self.whole = len(sizes) == shards
        self.bits = np.zeros(at, np.uint64)

    def put(self, shard: int, raw) -> None:
        self.bits[self.start[shard] : self.start[shard] + len(raw) // 8] = np.frombuffer(raw, np.uint64)

    def has(self, key: np.ndarray, level: int) -> np.ndarray:
        """Which keys reach the level, as places."""
        at = None
        for number in entries(level, self.checks):
            at = self._passed(key, number) if at is None else at[self._passed(key[at], number)]
        return at

    def _passed(self, key: np.ndarray, level: int) -> np.ndarray:
        """Which keys have the entry, as places."""
        shard = shard_of(key, self.shards)
        start, alive = self.start[shard], None
        if not self.whole and (start < 0).any():
            alive = np.flatnonzero(start >= 0)
            key, shard, start = key[alive], shard[alive], start[alive]
        word, mask = word_and_mask(key, level, self.words[shard])
        ok = np.flatnonzero(self.bits[start + word.astype(np.int64)] & mask == mask)
        return ok if alive is None else alive[ok]

    def levels(self, key: np.ndarray) -> np.ndarray:
        """Level of each key by repeated probes; 0 for one that is not in."""
        out = np.zeros(len(key), np.uint8)
        at = self.has(key, 1)
        out[at] = 1
        at = at[self.has(key[at], 2)]
        out[at] = 2
        if not len(at):
            return out
        rest, back = np.unique(key[at], return_inverse=True)
        found = np.full(len(rest), 2, np.uint8)
        alive, level = np.arange(len(rest)), 2
        while len(alive) and level < 119:
            level += 1
            alive = alive[self.has(rest[alive], level)]
            found[alive] = level
        out[at] = found[back]
        return out


def packed(x: np.ndarray) -> bytes:
    """Numbers as planes, first the lowest byte of all, then the next: what is alike in the high bytes compresses."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unpacked(raw: bytes, kind=np.uint64) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, len(raw) // size).T).view(kind).ravel()


def steps(key: np.ndarray) -> np.ndarray:
    """Differences of sorted keys, the first from zero; np.cumsum gives the keys back."""
    return np.diff(key, prepend=np.uint64(0))


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each byte its hash with A-Z lowered, and whether it belongs to a word."""
    byte = np.arange(256)
    low = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
    return character(low.astype(np.uint64)), (byte != 32) & ((byte < 9) | (byte > 13))


BYTE_HASH, IN_WORD = _letters()


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the tokens of the texts laid end to end, places after each text): the words of each text, then one end."""
    raw = [t or b"" for t in column.cast(pa.binary()).to_pylist()]
    data = np.frombuffer(b" ".join(raw), np.uint8)
    begins = np.cumsum([0, *(len(t) + 1 for t in raw)])
    start, end = runs(IN_WORD[data])
    word = hash_spans(summed(BYTE_HASH[data]), start, end)
    text = np.searchsorted(begins, start, "right") - 1
    out = np.full(len(word) + len(raw), END)
    out[np.arange(len(word)) + text] = word
    return out, np.cumsum(np.bincount(text, minlength=len(raw)) + 1)


def _slices(batch: pa.RecordBatch, column: int, most: int = 500_000):
    """Parts of a batch of about `most` bytes of text; a longer text is a part of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def _asked(chunk: int, key: np.ndarray, extra: list[np.ndarray], shards: int) -> list[tuple]:
    """(shard, chunk, key, *extra), packed, for each shard that has some of the sorted keys."""
    cut = np.searchsorted(shard_of(key, shards), np.arange(shards + 1)).tolist()
    step = steps(key)
    rows = []
    for s in range(shards):
        a, b = cut[s], cut[s + 1]
        if a < b:
            step[a] = key[a]
            rows.append((s, chunk, packed(step[a:b]), *(packed(x[a:b]) for x in extra)))
    return rows


def _merged(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their summed counts, the place of one of each, and for each key its place among the distinct ones."""
    u, first, back = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    out = np.zeros(len(u), np.int64)
    np.add.at(out, back, np.concatenate(counts).astype(np.int64))
    return u, out, first, back


def _cut(answer: np.ndarray, keys: list) -> list[bytes]:
    """The answers to each list of keys."""
    ends = np.cumsum([len(k) for k in keys]).tolist()
    return [packed(answer[a:b]) for a, b in zip([0, *ends], ends)]


def _by_shard(df: DataFrame, shards: int, merge, schema: str) -> DataFrame:
    """merge(shard, rows) for the rows of each shard; shards hold a bounded share of the n-grams."""

    @task("lexicon")
    def run(batches):
        now, held = None, []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in range(b.num_columns))):
                if row[0] != now and held:
                    yield merge(now, held)
                    held = []
                now = row[0]
                held.append(row[1:])
        if held:
            yield merge(now, held)

    return df.repartition(min(shards, 20_000), "shard").sortWithinPartitions("shard").mapInArrow(run, schema)


def _batch(names: list[str], kinds: list, rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names)


def chunked(rows: DataFrame, flush: int) -> DataFrame:
    """(chunk, doc_id, held_out, ends, words, taught, place) of rows(doc_id, text, held_out), a row for each chunk of some flush tokens.

    words: the sorted distinct tokens; taught: how often each is met in texts that teach; place: of each token among words, text after text;
    ends: the places after each text.
    """
    names = ["chunk", "doc_id", "held_out", "ends", "words", "taught", "place"]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 4]

    @task("lexicon")
    def run(batches):
        chunk, held, size = TaskContext.get().partitionId() << 32, [], 0

        def out():
            ids, outside = [x for p, _, _ in held for x in p.column(0).to_pylist()], np.array([x for p, _, _ in held for x in p.column(2).to_pylist()], bool)
            long = np.concatenate([np.diff(ends, prepend=0) for _, _, ends in held])
            words, place = np.unique(np.concatenate([w for _, w, _ in held]), return_inverse=True)
            taught = np.bincount(place[np.repeat(~outside, long)], minlength=len(words))
            return _batch(names, kinds, [(chunk, ids, outside.tolist(), packed(np.cumsum(long)), packed(steps(words)), packed(taught), packed(place.astype(np.uint32)))])

        for b in batches:
            for part in _slices(b, 1, min(500_000, 4 * flush)):
                w, ends = tokens(part.column(1))
                held.append((part, w, ends))
                size += len(w)
                if size > flush:
                    yield out()
                    chunk, held, size = chunk + 1, [], 0
        if held:
            yield out()

    schema = "chunk long, doc_id array<long>, held_out array<boolean>, ends binary, words binary, taught binary, place binary"
    return bucketed(rows.mapInArrow(run, schema), "lm-chunks", "chunk", moved=False)


def answered(chunks: DataFrame, *tables: DataFrame) -> DataFrame:
    """chunks with a column `answers`: (k, answer) of the k-th table(chunk, shard, answer) for each shard that was asked, in order."""
    every = reduce(DataFrame.unionAll, [t.where("chunk IS NOT NULL").select("chunk", F.struct(F.lit(k).alias("k"), "shard", "answer").alias("a")) for k, t in enumerate(tables)])
    return chunks.join(every.groupBy("chunk").agg(F.array_sort(F.collect_list("a")).alias("answers")), "chunk")


class Chunk:
    """A row of answered(): the tokens of its texts by their places among its words, and the words' exact counts."""

    def __init__(self, batch: pa.RecordBatch, k: int):
        cell = lambda c: batch.column(c)[k].as_py()
        self.number, self.ids, self.held_out = cell("chunk"), cell("doc_id"), np.array(cell("held_out"), bool)
        self.ends, self.words, self.place = unpacked(cell("ends"), np.int64), np.cumsum(unpacked(cell("words"))), unpacked(cell("place"), np.uint32).astype(np.int64)
        self.answers = [[], []]
        for a in cell("answers"):
            self.answers[a["k"]].append(a["answer"])
        self.count = np.zeros(len(self.words), np.int64)
        self.count[np.argsort(mix(self.words))] = np.concatenate([unpacked(x, np.int64) for x in self.answers[0]])

    def keys(self) -> np.ndarray:
        """The bigram of each token, then each word."""
        return np.concatenate([bigrams(self.words[self.place], self.ends)[1], mix(self.words)])


def count_unigrams(chunks: DataFrame, shards: int) -> DataFrame:
    """Two kinds of rows: (shard, key, count, tokens, words) of the texts that teach, one for each shard, counts with 64 bits; and
    (shard, chunk, answer), the counts of a chunk's words of a shard in the order of their keys."""
    names, kinds = ["shard", "chunk", "answer", "key", "count", "tokens", "words"], [pa.int32(), pa.int64(), *[pa.binary()] * 3, pa.int64(), pa.int64()]

    @task("lexicon")
    def run(batches):
        for b in batches:
            for chunk, words, taught in zip(*(b.column(c).to_pylist() for c in range(3))):
                key = mix(np.cumsum(unpacked(words)))
                order = np.argsort(key)
                yield _batch(["shard", "chunk", "key", "count"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()], _asked(chunk, key[order], [unpacked(taught, np.int64)[order]], shards))

    def merge(shard, rows):
        keys = [np.cumsum(unpacked(r[1])) for r in rows]
        u, n, _, back = _merged(keys, [unpacked(r[2], np.int64) for r in rows])
        own = n > 0
        return _batch(names, kinds, [(shard, None, None, packed(steps(u[own])), packed(n[own]), int(n.sum()), int(own.sum())), *((shard, r[0], a, None, None, None, None) for r, a in zip(rows, _cut(n[back], keys)))])

    asked = chunks.select("chunk", "words", "taught").mapInArrow(run, "shard int, chunk long, key binary, count binary")
    return _by_shard(asked, shards, merge, "shard int, chunk long, answer binary, key binary, count binary, tokens long, words long")


def before(levels: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Level of each token's history; the start of a text is a level of its own."""
    out = np.zeros(len(levels), np.int64)
    out[1:] = levels[:-1]
    out[:1] = TOP
    out[ends[:-1]] = TOP
    return out


def count_bigrams(chunks: DataFrame, unigrams: DataFrame, shards: int, checks: int) -> DataFrame:
    """Two kinds of rows: (shard, size, single, total, mass, words, error) of the texts that teach, one for each shard; and (shard, chunk,
    answer), the filter's levels of a chunk's bigrams and words of a shard in the order of their keys.

    size: bytes of the shard's filter, of its bigrams and unigrams. By level of the history: single, the bigrams met once; total, the tokens; mass,
    the sum of the bigrams' values. By level of a word: words, their number. error: the filter's chance to pass an absent entry, times its words of bits.
    """
    names, kinds = ["shard", "chunk", "key", "level", "count"], [pa.int32(), pa.int64(), *[pa.binary()] * 3]
    names_out = ["shard", "chunk", "answer", "size", "single", "total", "mass", "words", "error"]
    kinds_out = [pa.int32(), pa.int64(), pa.binary(), pa.int64(), *[pa.list_(t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.int64())], pa.float64()]
    value = level_values(TOP + 1)

    @task("lexicon")
    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                c = Chunk(b, k)
                u, first, back = np.unique(c.keys(), return_index=True, return_inverse=True)
                of_words = np.zeros(len(c.words), np.int64)
                level = np.concatenate([before(level_of(c.count)[c.place], c.ends), of_words])[first].astype(np.uint8)
                taught = np.repeat(~c.held_out, np.diff(c.ends, prepend=0))
                n = np.bincount(back[: len(taught)][taught], minlength=len(u)).astype(np.uint32)
                yield _batch(names, kinds, _asked(c.number, u, [level, n], shards))

    def merge(shard, rows):
        own = [r for r in rows if r[0] is None]
        rows = [r for r in rows if r[0] is not None]
        keys = [np.cumsum(unpacked(r[1])) for r in rows]
        every, met, first, back = _merged(keys, [unpacked(r[3], np.uint32) for r in rows]) if rows else [np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64)]
        q = np.concatenate([unpacked(r[2], np.uint8) for r in rows])[first] if rows else np.zeros(0, np.uint8)
        u, n, q = every[met > 0], met[met > 0], q[met > 0]
        single, total = np.bincount(q[n == 1], minlength=TOP + 1), np.bincount(q, n, TOP + 1).astype(np.int64)
        mass, pairs = np.bincount(q, value[level_of(n)], TOP + 1), len(u)
        u = np.concatenate([u, *(np.cumsum(unpacked(r[1])) for r in own)])
        level = level_of(np.concatenate([n, *(unpacked(r[3], np.int64) for r in own)]))
        bits = build_filter(u, level, checks)
        error = float(((np.bitwise_count(np.frombuffer(bits, np.uint64)) / 64.0) ** HASHES).sum())
        of_words = np.bincount(level[pairs:], minlength=TOP + 1)
        table = Filter({shard: len(bits)}, shards, checks)
        table.put(shard, bits)
        summary = (shard, None, None, len(bits), single.tolist(), total.tolist(), mass.tolist(), of_words.tolist(), error)
        return _batch(names_out, kinds_out, [summary, *((shard, r[0], a, *[None] * 6) for r, a in zip(rows, _cut(table.levels(every)[back], keys)))])

    pairs = answered(chunks, unigrams).mapInArrow(run, "shard int, chunk long, key binary, level binary, count binary")
    own = unigrams.where("chunk IS NULL").select("shard", "chunk", "key", F.lit(None).cast("binary").alias("level"), "count")
    return _by_shard(pairs.unionByName(own), shards, merge, "shard int, chunk long, answer binary, size long, single array<long>, total array<long>, mass array<double>, words array<long>, error double")


class Smoothing:
    """Probabilities from levels. total: N; distinct: V; single, every, mass and words as count_bigrams has them, summed; error: chance that a
    missing entry passes. Values are put right for it."""

    def __init__(self, total: int, distinct: int, single, every, mass, words, error: float):
        self.room = total + 0.5 * (distinct + 1)
        self.new = np.clip((single + 1.0) / (every + 2.0), 0.001, 0.999)
        value = level_values(TOP + 1)
        self.room_of_levels = float((words * value).sum()) + 0.5 * (distinct + 1)
        histories = words.astype(float)
        histories[TOP] = 1.0
        ends = int(every[TOP])
        if ends:
            histories[int(level_of(np.array([ends]))[0])] -= 1  # the end of a text is a word, but no history
        self.mass = np.where((histories > 0) & (mass > 0), mass / np.maximum(histories, 1), np.maximum(value, 1))
        # An answer k comes from level k, or from one below whose next entry passed by error; these values are right on average.
        self.value = value.copy()
        chance = np.where(np.arange(2, TOP + 1) >= HEAVY, error**2, error)  # of the next level's entries
        self.value[1:-1] = np.maximum((value[1:-1] - chance * value[2:]) / (1 - chance), 0)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / self.room)

    def probability(self, level: np.ndarray, past: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """P of tokens from their own level, their history's (TOP: the start of a text) and the bigram's."""
        fresh = np.where(past > 0, self.new[past], 1.0)
        pair = np.minimum(pair, np.minimum(level, past))
        return (1 - fresh) * np.minimum(1.0, self.value[pair] / self.mass[past]) + fresh * (self.value[level] + 0.5) / self.room_of_levels


def score(docs: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs(doc_id, text).

    Rows whose crc32(doc_id as text) mod 5 is 1 don't teach. A null text is empty and has one token, the end; a null doc_id is not held out;
    repeated rows teach and are scored each. An empty table gives no rows; other columns are ignored. The result is a written table.
    max_broadcast bounds the bytes of a chunk's keys (FLUSH does first); it changes how the work is cut, not what comes out.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD, F.lit(False)).alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(16, -(-size // SHARD_TEXT))
    chunks = chunked(rows, min(FLUSH, max(1, max_broadcast // 8)))
    unigrams = written(count_unigrams(chunks, shards), "unigrams")
    about = unigrams.agg(F.sum("tokens"), F.sum("words")).first()
    total, distinct = about[0] or 0, about[1] or 0
    grams = written(count_bigrams(chunks, unigrams, shards, checks_for(distinct)), "bigrams")
    by_level = F.posexplode(F.arrays_zip("single", "total", "mass", "words")).alias("q", "x")
    own = grams.where("chunk IS NULL")
    sums = own.select(by_level).groupBy("q").agg(*(F.sum(f"x.{c}") for c in ("single", "total", "mass", "words"))).collect()  # a row for each level
    single, every, mass, words = np.zeros(TOP + 1), np.zeros(TOP + 1), np.zeros(TOP + 1), np.zeros(TOP + 1)
    for q, *x in sums:
        single[q], every[q], mass[q], words[q] = x
    error = own.agg(F.sum("error") * 8 / F.sum("size")).first()[0] or 0.0
    model = Smoothing(total, distinct, single, every, mass, words, error)

    @task("lexicon")
    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                c = Chunk(b, k)
                _, back = np.unique(c.keys(), return_inverse=True)
                got = np.concatenate([unpacked(x, np.uint8) for x in c.answers[1]])[back]
                level = got[len(c.place) :][c.place]
                p = model.probability(level, before(level, c.ends), got[: len(c.place)])
                begin, count = np.append(0, c.ends[:-1]), c.count[c.place]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.ids, pa.int64()), pa.array(c.held_out), pa.array(c.ends - begin), pa.array(np.add.reduceat((count > 0).astype(np.int64), begin)), pa.array(np.full(len(c.ends), total, np.int64)), pa.array(np.add.reduceat(model.base(count), begin)), pa.array(np.add.reduceat(np.log10(p), begin))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return written(answered(chunks, unigrams, grams).mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "lm-scores")
