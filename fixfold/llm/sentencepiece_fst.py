"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model file is compiled into three machines: the normaliser (the arcs of the
model's character map, the longest first; a blank becomes the word mark, a mark
is put in front), the piece lexicon, and a byte fallback for characters without
a piece.  Composed with an input they give a lattice of piece arcs between
character positions, and the encoding is its shortest path in the tropical
semiring.

* A unigram model weighs an arc with the piece's negative score.
* A merge (BPE) model weighs a pair of neighbouring arcs: 0 if the merges of the
  two pieces' joint text end in just these two pieces, else infinity.  Merging a
  text ends in a sequence exactly if every pair of neighbours is of weight 0,
  so the path of finite weight is the encoding.  Each prefix has one such
  path too, so one last piece for each position is all the state there is.

In most models no piece runs on from a letter to a word mark or to any character
that is no letter (both checked when compiling), so paths are cached for each
stretch between such places.  Where pieces run on over a mark, the whole text is
one stretch.

User-defined pieces of merge models stand in the text as they are: the normaliser
lets them pass, and the text is cut at them.  Refused with a ``ValueError``: word
and character models, marks behind words, unigram models with user-defined pieces,
and merge models with unused pieces.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from fixfold.llm.common import map_rows

MARK = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_UNIGRAM, _BPE = 1, 2
_SUFFIX_FIELD, _SURFACE_FIELD = 24, 44  # of the trainer's message
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_LETTER_END = re.compile(f"[{_LATIN}][^{_LATIN}]")
_INFINITY = float("inf")
#: What an unknown character costs beyond the worst piece of a unigram model.
_UNKNOWN_PENALTY = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[at:at + size]
        at += size


@functools.lru_cache(maxsize=8)
def character_map(blob: bytes) -> dict[str, str]:
    """{text: replacement} of a normaliser's map: a double-array trie of UTF-8 keys, then the replacements.

    A unit's low byte is its label, bit 8 tells that a key ends there, and the
    bits from 10 on (times 256 if bit 9 is set) lead to its children, whose place
    differs from there by their label.
    """
    size, = struct.unpack_from("<I", blob)
    units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).astype(np.int64)
    texts = blob[4 + size:]
    bases = np.arange(len(units)) ^ (units >> 10 << np.where(units & 0x200, 8, 0))
    labels = np.arange(1, 256)
    found: dict[str, str] = {}
    todo = [(np.zeros(1, dtype=np.int64), [b""])]
    while todo:  # up to 4096 nodes of one depth at a time
        at, keys = todo.pop()
        for i in np.flatnonzero(units[at] & 0x100).tolist():
            start = int(units[bases[at[i]]]) & 0x7FFFFFFF
            found[keys[i].decode()] = texts[start:texts.index(b"\0", start)].decode()
        places = bases[at][:, None] ^ labels
        inside = places < len(units)
        node, label = np.nonzero(inside & (units[np.where(inside, places, 0)] & 0x800000FF == labels))
        below = places[node, label]
        names = [keys[i] + bytes([c]) for i, c in zip(node.tolist(), labels[label].tolist())]
        todo += [(below[k:k + 4096], names[k:k + 4096]) for k in range(0, len(names), 4096)]
    return found


class Normaliser:
    """Rewrites a text from left to right: a kept text as it is, else the longest key of the map, else the character."""

    def __init__(self, rules: dict[str, str], keep: set[str], prefix: str, squeeze: bool, space: str):
        # an arc for every key; a kept text goes before keys of any length
        self.rules, self.keep = rules, keep
        self.prefix, self.squeeze, self.space = prefix, squeeze, space
        self.lengths: dict[str, list[tuple[int, dict[str, str]]]] = {}
        for arcs in ({k: k for k in keep}, rules):
            for first, size in sorted({(k[0], len(k)) for k in arcs}, key=lambda x: -x[1]):
                self.lengths.setdefault(first, []).append((size, arcs))
        self.starts = re.compile("[" + "".join(map(re.escape, sorted(self.lengths))) + "]") if self.lengths else None

    def chunks(self, text: str) -> Iterator[tuple[bool, str]]:
        """(rewritten as a whole, text) pieces of the output."""
        done = 0
        for m in self.starts.finditer(text) if self.starts else ():
            at = m.start()
            if at < done:
                continue
            for size, arcs in self.lengths[text[at]]:
                new = arcs.get(text[at:at + size])
                if new is not None and at + size <= len(text):
                    if done < at:
                        yield False, text[done:at]
                    yield True, new
                    done = at + size
                    break
        if done < len(text):
            yield False, text[done:]

    def __call__(self, text: str) -> str:
        if not text:
            return ""
        if not self.squeeze:
            if self.starts:
                text = "".join([c for _, c in self.chunks(text)])
            return self.prefix + text.replace(" ", self.space)
        out, blank = [], True
        for whole, c in self.chunks(text):
            if not whole:
                c = re.sub("  +", " ", c)
            if blank:
                c = c.lstrip(" ")
            if c:
                out.append(c)
                blank = c[-1] == " "
        return (self.prefix + "".join(out).replace(" ", self.space)).rstrip(self.space)


class Transducer:
    """A compiled model: ``encode(text) -> ids`` and ``decode(ids) -> text``."""

    def __init__(self, model: bytes, cache_size: int = 500_000):
        pieces, trainer, normaliser = [], {}, {}
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                pieces.append((f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, _NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        if trainer.get(3, _UNIGRAM) not in (_UNIGRAM, _BPE):
            raise ValueError("only unigram and merge models are supported")
        if trainer.get(_SUFFIX_FIELD):
            raise ValueError("models with marks behind words are not supported")
        self.merges = trainer.get(3, _UNIGRAM) == _BPE
        self.squeeze = bool(normaliser.get(4, 1))
        space = MARK if normaliser.get(5, 1) else " "
        prefix = space if normaliser.get(3, 1) else ""
        self.front = bool(prefix) or self.squeeze
        user = {p for p, _, kind in pieces if kind == _USER}
        if user and not self.merges:
            raise ValueError("unigram models with user-defined pieces are not supported")
        self.normalise = Normaliser(character_map(normaliser[2]) if normaliser.get(2) else {}, user, prefix, self.squeeze, space)
        lexical = (_NORMAL, _UNUSED, _USER)
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in lexical}
        self.marked = {i for i, (p, _, kind) in enumerate(pieces) if kind in lexical and p.startswith(MARK)}
        self.unknown = next(i for i, (_, _, kind) in enumerate(pieces) if kind == _UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == _BYTE}
        scores = {p: pieces[i][1] for p, i in self.ids.items()}
        self.rank = {p: -s for p, s in scores.items()}  # merges: the smaller first; unigram: the arc's weight
        self.unused = {p for p, i in self.ids.items() if pieces[i][2] == _UNUSED}
        plain = [scores[p] for p, _, kind in pieces if kind == _NORMAL]
        worst = min(plain, default=0.0)
        # the text is cut at user-defined pieces
        self.user = re.compile("(" + "|".join(map(re.escape, sorted(user, key=len, reverse=True))) + ")") if user else None
        self.trie: dict = {}
        for p in self.ids:
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = p
        self.unknown_weight = _UNKNOWN_PENALTY - worst
        if self.merges and self.unused:
            raise ValueError("merge models with unused pieces are not supported")
        inside = {c for p in self.ids if len(p) > 1 for c in p}
        alone = "".join(c for c in "\n\r\t" if c not in inside)  # never part of a longer piece
        other = f"[^{_LATIN}{MARK}{alone}]"
        if any(_LETTER_END.search(p) for p in self.ids):
            stretch = f"{MARK}*[^{MARK}{alone}]+"
        else:  # no piece goes on after a word's last letter
            stretch = f"{MARK}*{other}*[{_LATIN}]+|{MARK}*{other}+"
        run_on = any(space in p.lstrip(space) for p in self.ids if p not in user)
        self.stretch = re.compile("(?s:.+)" if run_on else f"{stretch}|{MARK}+" + (f"|[{alone}]" if alone else ""))
        surface = trainer.get(_SURFACE_FIELD, b" \xe2\x81\x87 ")
        self.texts = [b"" if kind == _CONTROL else surface if kind == _UNKNOWN
                      else bytes([int(p[3:5], 16)]) if kind == _BYTE else p.replace(MARK, " ").encode()
                      for p, _, kind in pieces]
        self.pairs: dict[str, dict[str, float]] = {}
        self.known_pairs = 0
        self.paths: dict[str, tuple[int, ...]] = {}
        self.cache_size = cache_size

    def merged(self, text: str) -> list[str]:
        """Merge neighbours, the best-ranked joint piece first, the leftmost of equals."""
        symbols = list(text)
        while True:
            best, at = _INFINITY, -1
            for i in range(len(symbols) - 1):
                rank = self.rank.get(symbols[i] + symbols[i + 1], _INFINITY)
                if rank < best:
                    best, at = rank, i
            if at < 0:
                return symbols
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]

    def pair_weight(self, left: str, right: str) -> float:
        """0 if the two pieces stay as they are side by side, else infinity."""
        return 0.0 if self.merged(left + right) == ([left, right] if left else [right]) else _INFINITY

    def shortest_path(self, text: str) -> list[str]:
        """Pieces (or single characters without one) of the cheapest path through the lattice."""
        return self._merge_path(text) if self.merges else self._unigram_path(text)

    def _merge_path(self, text: str) -> list[str]:
        """Weights are 0 or infinity, so the first arc of weight 0 into a position is its cheapest."""
        n, trie = len(text), self.trie
        last: list[str | None] = [""] + [None] * n
        back = [0] * (n + 1)
        for start in range(n):
            left = last[start]
            weights = self.pairs.get(left)
            if weights is None:
                weights = self.pairs[left] = {}
            node, end = trie, start
            while end < n:
                node = node.get(text[end])
                end += 1
                if node is None and end > start + 1:
                    break
                if last[end] is None:
                    piece = text[start] if end == start + 1 else node.get("")
                    if piece is not None:
                        weight = weights.get(piece)
                        if weight is None:
                            weight = weights[piece] = self.pair_weight(left, piece)
                            self.known_pairs += 1
                        if not weight:
                            last[end], back[end] = piece, start
                if node is None:
                    break
        if self.known_pairs > 2_000_000:
            self.pairs.clear()
            self.known_pairs = 0
        out, at = [], n
        while at:
            out.append(last[at])
            at = back[at]
        return out[::-1]

    def _unigram_path(self, text: str) -> list[str]:
        n = len(text)
        cost, last, back = [0.0] + [_INFINITY] * n, [""] * (n + 1), [0] * (n + 1)
        for start in range(n):
            node, end = self.trie, start
            while end < n:
                node = node.get(text[end])
                end += 1
                piece = node.get("") if node else None
                if piece in self.unused:
                    piece = None
                if piece is not None or end == start + 1:
                    weight = cost[start] + (self.unknown_weight if piece is None else self.rank[piece])
                    if weight < cost[end]:
                        cost[end], last[end], back[end] = weight, text[start:end], start
                if node is None:
                    break
        out, at = [], n
        while at:
            out.append(last[at])
            at = back[at]
        return out[::-1]

    def _path_ids(self, stretch: str) -> tuple[int, ...]:
        out: list[int] = []
        for piece in self.shortest_path(stretch):
            if piece in self.ids:
                out.append(self.ids[piece])
            elif self.bytes:
                out += [self.bytes[b] for b in piece.encode()]
            elif not out or out[-1] != self.unknown:  # unknown characters in a row are one piece
                out.append(self.unknown)
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        text = self.normalise(text)
        if self.user is None:
            return self._stretch_ids(text)
        out: list[int] = []
        for k, part in enumerate(self.user.split(text)):
            out += [self.ids[part]] if k % 2 else self._stretch_ids(part)
        return out

    def _stretch_ids(self, text: str) -> list[int]:
        out: list[int] = []
        paths, unknown = self.paths, self.unknown
        for stretch in self.stretch.findall(text):
            ids = paths.get(stretch)
            if ids is None:
                ids = self._path_ids(stretch)
                if len(stretch) <= 64:
                    if len(paths) >= self.cache_size:
                        paths.clear()
                    paths[stretch] = ids
            out += ids[1:] if out and ids[0] == unknown == out[-1] else ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The output side of the machines; marks in front are taken off: one, or all where blanks are squeezed."""
        texts = [self.texts[i] for i in ids]
        for k, i in enumerate(ids):
            if self.front and i in self.marked:
                texts[k] = texts[k][1:]
                if not self.squeeze:
                    break
            if texts[k]:
                break
        return b"".join(texts).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def load(path: str) -> Transducer:
    with open(path, "rb") as f:
        return Transducer(f.read())


def encode_documents(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "piece_ids") -> DataFrame:
    """``docs`` with the piece ids of each whole text.

    ``model_path`` must lie on every executor (an installed vocabulary file).
    Null text: null; empty text: no pieces.  Repeated rows: each its own.  Empty
    table: empty.  The column name is an argument; other columns pass unchanged.
    """
    def make():
        encode = load(model_path).encode
        return lambda texts: [(None if t is None else encode(t),) for t in texts]

    return map_rows(docs, [text_col], make, [(ids_col, "array<int>")])


def decode_documents(rows: DataFrame, model_path: str, ids_col: str = "piece_ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of their piece ids; null ids: null."""
    def make():
        decode = load(model_path).decode
        return lambda ids: [(None if x is None else decode(x),) for x in ids]

    return map_rows(rows, [ids_col], make, [(text_col, "string")])


def round_trip(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_pieces``, ``ids_crc32`` (little-endian 32-bit ids) and whether decoding gives the text back.

    Encodes and decodes in one task, so the ids need not be moved.  Null and
    empty texts: no pieces, and they come back as empty.
    """
    def make():
        machine = load(model_path)

        def fn(texts):
            out = []
            for t in texts:
                ids = machine.encode(t or "")
                plain = (t or "").replace(MARK, " ")
                out.append((len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()), machine.decode(ids) == plain))
            return out
        return fn

    return map_rows(docs, [text_col], make, [("n_pieces", "long"), ("ids_crc32", "long"), ("round_trip", "boolean")])
