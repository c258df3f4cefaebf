"""BPE encoding and decoding by a pair occurrence index.

The pieces of a partition that are not known yet are laid end to end. An index maps each adjacent
pair of symbols to all its positions; the ranks that are active go through a heap in ascending
order, each merging all its positions and updating the lists of the pairs it breaks and makes.
Works on vocabularies of the tokenizers library with word ends: NFC, white space folded, lower case.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame

from memlake.llm.chunk_bpe import letters
from memlake.llm.workers import keep_cache, task
from memlake.session import ship

#: White space of the vocabulary's regular expressions (fixed values).
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"

_open: dict[str, PairIndexBpe] = {}
keep_cache("pairs", _open.clear)


def shared(path: str) -> PairIndexBpe:
    if path not in _open:
        _open[path] = PairIndexBpe(path)
    return _open[path]


def merge_pieces(pieces: list[list[int]], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[list[int]]:
    """Merges each piece's symbols as BPE does: its lowest rank first, at equal rank from the left. ranks: pair to (rank, merged symbol)."""
    symbol: list[int] = []
    for p in pieces:
        symbol += p
        symbol.append(-1)  # no pair crosses it
    n = len(symbol)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    places: dict[tuple[int, int], list[int]] = {}
    for at, pair in enumerate(zip(symbol, symbol[1:])):
        if pair in ranks:
            places.setdefault(pair, []).append(at)
    heap = [(ranks[p][0], p) for p in places]
    heapq.heapify(heap)
    pop, push, get = heapq.heappop, heapq.heappush, ranks.get
    while heap:
        rank, pair = pop(heap)
        todo = places.pop(pair, None)
        if todo is None:
            continue
        left, right = pair
        made = ranks[pair][1]
        todo.sort()
        for k, at in enumerate(todo):
            if symbol[at] != left:
                continue
            nxt = after[at]
            if symbol[nxt] != right:
                continue
            symbol[at] = made
            symbol[nxt] = -2
            after[at] = end = after[nxt]
            before[end] = at
            lower = False
            new = made, symbol[end]
            if (found := get(new)) is not None:
                if (list_ := places.get(new)) is None:
                    places[new] = [at]
                    push(heap, (found[0], new))
                    lower = found[0] < rank
                else:
                    list_.append(at)
                    lower = found[0] < rank
            prev = before[at]
            if prev >= 0:
                new = symbol[prev], made
                if (found := get(new)) is not None:
                    if (list_ := places.get(new)) is None:
                        places[new] = [prev]
                        push(heap, (found[0], new))
                    else:
                        list_.append(prev)
                    lower = lower or found[0] < rank
            if lower and k + 1 < len(todo):  # a lower rank has become active: it goes first
                places.setdefault(pair, []).extend(todo[k + 1 :])
                push(heap, (rank, pair))
                break
    out, own = [], []
    at = 0
    while at < n:
        if symbol[at] == -1:
            out.append(own)
            own = []
        else:
            own.append(symbol[at])
        at = after[at]
    return out


class PairIndexBpe:
    def __init__(self, path: str, max_entries: int = 500_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.ranks = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.name = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.name |= {i: t for t, i in self.special.items()}
        self.specials = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pieces = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+").findall
        self.byte = [vocab[c] for _, c in sorted(letters().items())]
        self.last = [vocab[c + self.end] for _, c in sorted(letters().items())]
        self.max = max_entries
        self.known: dict[str, tuple[bytes, str]] = {}
        self.piece: dict[str, tuple[bytes, str]] = {}

    def _learn(self, chunks: set[str]) -> None:
        """Ids and tokens of chunks without white space at ' ' or line feed."""
        split, new = {}, set()
        for c in chunks:
            if c.isascii():
                if c.isalpha():
                    ps = (c.lower(),)
                elif c[-1] in ".," and c[:-1].isalpha():
                    ps = (c[:-1].lower(), c[-1])
                else:
                    ps = self.pieces(c.lower())
            else:
                ps = self.pieces(unicodedata.normalize("NFC", c).replace("Σ", "σ").lower())
            split[c] = ps
            new.update(ps)
        piece = self.piece
        if len(piece) > self.max:
            piece.clear()
        own = list(new.difference(piece))
        byte, last, name, code = self.byte, self.last, self.name, array
        symbols = []
        for p in own:
            r = p.encode()
            s = [byte[x] for x in r]
            s[-1] = last[r[-1]]
            symbols.append(s)
        for p, got in zip(own, merge_pieces(symbols, self.ranks)):
            piece[p] = code("I", got).tobytes(), " ".join([name[i] for i in got])
        known = self.known
        for c, ps in split.items():
            if len(ps) == 1:
                known[c] = piece[ps[0]]
            else:
                got = [piece[p] for p in ps]
                known[c] = b"".join([g[0] for g in got]), " ".join([g[1] for g in got])

    def encode_decode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(little-endian unsigned 32-bit ids, decoded text) of each text."""
        parts: list[list] = []
        need: set[str] = set()
        for t in texts:
            mine: list = []
            for k, s in enumerate(self.specials.split(t) if self.specials and "<" in t else [t]):
                if k % 2:
                    mine.append(s)
                    continue
                chunks = [c for c in s.replace("\n", " ").split(" ") if c]
                mine.append(chunks)
                need.update(chunks)
            parts.append(mine)
        new = need.difference(self.known)
        if len(self.known) + len(new) > self.max:
            self.known.clear()
            new = need
        if new:
            self._learn(new)
        known, out = self.known, []
        for mine in parts:
            ids, words = [], []
            for p in mine:
                if isinstance(p, str):
                    ids.append(array("I", [self.special[p]]).tobytes())
                    words.append(p)
                elif p:
                    got = list(map(known.__getitem__, p))
                    ids += [g[0] for g in got]
                    words += [g[1] for g in got if g[1]]
            out.append((b"".join(ids), " ".join(words)))
        return out


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids (binary), decoded (string) of each row; a null text is empty, a null doc_id stays null, repeated rows are done each.

    An empty table gives no rows; other columns are ignored. Texts go through in batches of a bounded size, a long one alone.
    """
    ship(docs.sparkSession)

    @task("pairs")
    def run(batches):
        bpe = shared(tokenizer)
        for b in batches:
            at = 0
            while at < b.num_rows:
                texts, size = [], 0
                for t in b.column(1).slice(at, 2000).to_pylist():
                    texts.append(t or "")
                    size += len(texts[-1])
                    if size > 4_000_000:
                        break
                got = bpe.encode_decode(texts)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(texts)), pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.string())], ["doc_id", "ids", "decoded"]
                )
                at += len(texts)

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, "doc_id long, ids binary, decoded string")
