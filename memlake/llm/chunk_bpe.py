"""Byte-level BPE ids through the tokenizers library, with a cache of space-separated chunks.

The library's own split never lets a piece cross from a non-space to a following space, so a text
whose spaces are single can be encoded chunk by chunk (" word,") and the results joined. Texts with
double or trailing spaces or a special token's string go to the library whole.
"""

from __future__ import annotations

import json
from array import array
from collections import Counter

import numpy as np

from memlake.llm.workers import calm, keep_cache

_open: dict[str, ChunkBpe] = {}


def letters() -> dict[int, str]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from code point 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def shared(path: str) -> ChunkBpe:
    """One encoder per worker process and file."""
    calm("chunks")
    if path not in _open:
        _open[path] = ChunkBpe(path)
    return _open[path]


keep_cache("chunks", _open.clear)


class _Known(dict):
    """Ids by chunk; works out and keeps what it lacks."""

    def __init__(self, work):
        super().__init__()
        self.work = work

    def __missing__(self, c):
        ids = self[c] = self.work(c)
        return ids


class _Often(dict):
    """The chunks met often, in front of all known ones."""

    def __init__(self, start, known):
        super().__init__(start)
        self.known = known

    def __missing__(self, c):
        return self.known[c]


class ChunkBpe:
    def __init__(self, path: str, max_entries: int = 600_000):
        import regex
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.type = np.dtype("<u2" if self.lib.get_vocab_size() <= 65536 else "<u4")
        self.chunked = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and bool(pre.get("use_regex")) and not pre.get("add_prefix_space")
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.letters = letters()
        self.space = self.letters[32]
        self.tokenize = self.lib.model.tokenize
        self.code = "H" if self.type.itemsize == 2 else "I"
        self.max = max_entries
        self.known = _Known(self._chunk)
        self.often: dict = self.known
        self.met: Counter = Counter()
        self.seen, self.next_count = 0, 0
        self.small: dict = {}
        self.newline = self._whole("\n")
        self.ends = {c: self._whole(c) for c in ",."}

    def _whole(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, self.type).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece of the library's split, by its model."""
        if not piece.isascii() or not piece.isprintable():
            piece = piece.encode().decode("latin-1").translate(self.letters)
        elif piece[0] == " ":
            piece = self.space + piece[1:]
        return array(self.code, [t.id for t in self.tokenize(piece)]).tobytes()

    def _chunk(self, c) -> bytes:
        """Ids of a chunk; a tuple holds the chunk that starts a text or a line, without a space before it."""
        start = c.__class__ is tuple
        text = c[0] if start else " " + c
        body = c[0] if start else c
        if body.isalpha():
            return self._piece(text)
        if not start and body[-1:] in self.ends and body[:-1].isalpha():
            return self.known[body[:-1]] + self.ends[body[-1]]
        if not body.isprintable():
            left, sep, right = body.partition("\n")
            if sep and left.isprintable() and left[-1:] not in ("", " ") and right.isprintable() and right:
                return self._chunk((left,) if start else left) + self.newline + self._chunk((right,))
            return self._whole(text)
        out = []
        for p in self.pieces(text):
            if (ids := self.small.get(p)) is None:
                ids = self._piece(p)
                if len(self.small) < 100_000:
                    self.small[p] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text, of self.type."""
        out = []
        for t in texts:
            if not t:
                out.append(b"")
            elif not self.chunked or "  " in t or t[-1] == " " or any(s in t for s in self.specials):
                out.append(self._whole(t))
            else:
                first, *rest = t.split(" ")
                out.append(self._chunk((first,)) + b"".join(map(self.often.__getitem__, rest)))
                if len(self.known) > self.max:
                    self.known.clear()
                self.seen += len(t)
                if self.seen > self.next_count:
                    self._choose(rest)
        return out

    def _choose(self, chunks: list[str]) -> None:
        """Keeps the chunks met often in a small dictionary, which stays in the CPU's cache."""
        self.met.update(chunks)
        self.next_count = self.seen + 50_000
        if self.seen > 2_000_000:
            top = [c for c, _ in self.met.most_common(8000)]
            self.often = _Often({c: self.known[c] for c in top}, self.known)
            self.next_count = float("inf")
