"""Byte-level BPE encoding and decoding, in time linear in the text.

Bytes are mapped to the Latin-1 characters of the same numbers, so an
Aho-Corasick automaton over strings finds tokens of bytes.  A stretch of text
(one match of the split pattern) is encoded by backtracking: take the longest
token at a place; if it does not go with the token before, take the next
shorter one; if none is left, drop the token before and mark the place as dead.
Two tokens go together if the plain merges over their joined bytes give just
these two; this is looked up in a memo.  A sequence of which all neighbours go
together is the merges' result, and there is only one, so no merging over the
whole stretch is needed.  Every place is marked dead at most once, and the
candidates at a place are the tokens that begin there (at most the length of the longest
token), so the work grows with the text.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixfold.llm.common import free_name, map_rows

#: Bounds of the memos: pairs of tokens; stretches, and the characters of one that is kept.
_PAIRS_KEPT, _PARTS_KEPT, _LONGEST_KEPT = 1 << 19, 1 << 19, 64


def merged(part: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids by the definition: merge the neighbours of the least rank, the leftmost first, until none is left."""
    parts = [part[i:i + 1] for i in range(len(part))]
    none = 1 << 62  # above all ranks
    order = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while order and (least := min(order)) < none:
        k = order.index(least)
        parts[k:k + 2] = [parts[k] + parts[k + 1]]
        del order[k]
        if k:
            order[k - 1] = ranks.get(parts[k - 1] + parts[k], none)
        if k < len(order):
            order[k] = ranks.get(parts[k] + parts[k + 1], none)
    return [ranks[p] for p in parts]


class _Memo(dict):
    """Results of ``make``, filled on demand and emptied when it is full."""

    def __init__(self, make, bound: int, keep=lambda key: True):
        self.make, self.bound, self.keep = make, bound, keep

    def __missing__(self, key):
        value = self.make(key)
        if self.keep(key):
            if len(self) >= self.bound:
                self.clear()
            self[key] = value
        return value


class ByteBpe:
    """Encoder and decoder of one rank table; ``pattern`` splits the text first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"ranks lack the bytes {missing}")
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.token = {i: t for t, i in ranks.items()}
        self.size = {i: len(t) for t, i in ranks.items()}
        # tokens that the merges never make (possible in tables of other makers) are no candidates;
        # they stand only for a whole stretch
        made = {t: i for t, i in ranks.items() if merged(t, ranks) == [i]}
        #: the longest token that is a proper prefix of a token
        self.shorter = {i: next((made[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in made), None)
                        for t, i in made.items()}
        # over reversed bytes a match ends where the token begins
        self.automaton = ahocorasick.Automaton()
        for t, i in made.items():
            self.automaton.add_word(t[::-1].decode("latin-1"), i)
        self.automaton.make_automaton()
        #: whether the merges leave two neighbours (first id << 32 | second id) as they are
        self.together = _Memo(self._together, _PAIRS_KEPT)
        self.parts = _Memo(lambda p: pack(self.encode_part(p.encode())), _PARTS_KEPT, lambda p: len(p) <= _LONGEST_KEPT)

    def _together(self, pair: int) -> bool:
        a, b = pair >> 32, pair & 0xFFFFFFFF
        return merged(self.token[a] + self.token[b], self.ranks) == [a, b]

    def longest(self, part: bytes) -> dict[int, int]:
        """The longest token that begins at each byte, by the byte's distance from the last one.

        The automaton tells the matches with one end from the longest to the
        shortest, so in the backward list the longest comes last and stays.
        """
        return dict(list(self.automaton.iter(part[::-1].decode("latin-1")))[::-1])

    def encode_part(self, part: bytes) -> list[int]:
        """Ids of one stretch, by backtracking from the longest matches."""
        whole = self.ranks.get(part)
        if whole is not None:
            return [whole]
        longest, size, shorter, together = self.longest(part), self.size, self.shorter, self.together
        alive = bytearray(b"\x01") * (len(part) + 1)
        out: list[int] = []
        at, last, before = 0, len(part) - 1, None
        candidate = longest[last]
        while True:
            while candidate is not None:
                end = at + size[candidate]
                if alive[end] and (before is None or together[before << 32 | candidate]):
                    break
                candidate = shorter[candidate]
            if candidate is not None:
                out.append(candidate)
                if end > last:
                    return out
                at, before = end, candidate
                candidate = longest[last - at]
            else:  # nothing fits here: no way leads through this place
                alive[at] = 0
                dropped = out.pop()
                before = out[-1] if out else None
                at -= size[dropped]
                candidate = shorter[dropped]

    def encode_packed(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.parts.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return unpack(self.encode_packed(text))

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of the tokens; KeyError for an id that is not in the table."""
        return b"".join(map(self.token.__getitem__, ids))


def pack(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return np.array(ids, dtype="<u4").tobytes()


def unpack(packed: bytes) -> list[int]:
    return np.frombuffer(packed, dtype="<u4").tolist()


@functools.lru_cache(maxsize=4)
def load(ranks_path: str, pattern: str) -> ByteBpe:
    """The encoder of a rank file (a base64 token and its rank a line)."""
    with open(ranks_path, "rb") as f:
        return ByteBpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text",
                     ids_col: str = "ids", packed: bool = False) -> DataFrame:
    """``docs`` with the token ids of each whole text: an array of integers, or
    with ``packed`` a binary of little-endian unsigned 32-bit integers.

    The rank file has to be at ``ranks_path`` on every executor.  Null and empty
    texts have no ids (an empty array or binary, not null).  Repeated rows stay;
    an empty table gives an empty one.  Other columns pass through; a column
    named ``ids_col`` is a ValueError.  Texts of one long stretch take time in
    proportion to their length.
    """

    def make():
        bpe = load(ranks_path, pattern)
        if packed:
            return lambda texts: [(bpe.encode_packed(t or ""),) for t in texts]
        return lambda texts: [(bpe.encode(t or ""),) for t in texts]

    return map_rows(docs, [text_col], make, [(ids_col, "binary" if packed else "array<int>")])


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids",
                     bytes_col: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its ids (array or packed binary).

    Null ids give null, no ids give empty bytes.  An id that is not in the rank
    file ends the job with a KeyError.
    """
    is_packed = dict(encoded.dtypes)[ids_col] == "binary"

    def make():
        bpe = load(ranks_path, pattern)
        return lambda column: [(None if v is None else bpe.decode(unpack(v) if is_packed else v),) for v in column]

    return map_rows(encoded, [ids_col], make, [(bytes_col, "binary")])


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): encoded to packed ids and decoded from these; one row per row of ``docs``."""
    ids = free_name([id_col], "ids")
    encoded = encode_documents(docs.select(id_col, text_col), ranks_path, pattern, text_col, "packed_ids", packed=True)
    decoded = decode_documents(encoded.drop(text_col), ranks_path, pattern, "packed_ids", "decoded_bytes")
    return decoded.select(id_col, F.col("packed_ids").alias(ids), F.col("decoded_bytes").alias(free_name([id_col], "decoded")))
