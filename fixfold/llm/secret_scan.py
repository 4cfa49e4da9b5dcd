"""Secret scans through nested encodings: a recursive decoding worklist.

A text is layer 0.  Every layer is scanned for the secret kinds, then decoded
in three ways: escapes (percent, ``\\u``/``\\x``, character references),
base64 runs, and base64 runs wrapped over lines.  What holds zlib, gzip, bzip2
or xz data is inflated, all members, until it is no longer compressed.  Bytes
are read as Latin-1: all that is looked for is ASCII, so other letters, control
characters and broken bytes change nothing.  Each decoded text is a new layer
and goes back on the worklist until nothing new turns up; layers already seen
(by digest) are not followed again, so cycles end.  A layer keeps, piece by
piece, where its characters come from, and each finding is mapped back to a
span of the original text.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import html
import lzma
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixfold.llm.common import free_name, map_rows

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_WORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run of 24 and more starts where the run of any length starts, so this finds the same runs.
_HEX = re.compile(r"[0-9a-f]{24,}")

_ESCAPE = re.compile(r"(?:%[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2})+|(?:\\[0-3][0-7]{2})+|&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_OCTAL = re.compile(r"\\([0-3][0-7]{2})")
_UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\[uUx]([0-9A-Fa-f]+)")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: A run over two or more lines (line breaks may be escaped, lines indented).
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:[ \t]*+(?:\r?\n|\r|(?:\\r)?\\n)[ \t]*+[A-Za-z0-9+/_-]++)+={0,2}")
_LINE = re.compile(r"(?:(?<=\\n)|(?<![A-Za-z0-9+/_\\-]))[A-Za-z0-9+/_-]+")
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
#: Content that inflates beyond this many bytes is not one layer: it is scanned in overlapping windows (and counted).
MAX_INFLATED = 64 << 20
WINDOW, OVERLAP = 8 << 20, 2 << 20


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base findings, by start and kind."""
    found = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    found.sort()
    return found


class Layer:
    """A decoded text and the pieces it is made of: (start here, start and end in the parent, places).

    ``places`` is None where the parent's characters stand unchanged, empty where
    every character comes from the whole span, or else the positions in the parent
    of the base64 characters that the piece was decoded from.
    """

    def __init__(self, text: str, parent: Layer | None = None, pieces=(), depth: int = 0):
        self.text, self.parent, self.pieces, self.depth = text, parent, pieces, depth
        self.starts = [p[0] for p in pieces]

    def to_root(self, start: int, end: int) -> tuple[int, int]:
        layer = self
        while layer.parent is not None:
            a = layer.pieces[bisect_right(layer.starts, start) - 1]
            b = layer.pieces[bisect_right(layer.starts, end - 1) - 1]
            if a[3] is None:
                start = a[1] + start - a[0]
            else:
                start = a[3][4 * (start - a[0]) // 3] if a[3] else a[1]
            if b[3] is None:
                end = b[1] + end - b[0]
            else:
                end = b[3][min(-(-4 * (end - b[0]) // 3), len(b[3])) - 1] + 1 if b[3] else b[2]
            layer = layer.parent
        return start, end


def _escaped(m: re.Match) -> list[tuple[str, int, int]] | None:
    """(character, start, end) for each decoded character of an escape match."""
    s, at = m[0], m.start()
    if s[0] == "\\" and s[1] not in "uUx":
        raw = bytes(int(x, 8) for x in _OCTAL.findall(s))
        return _inside(raw, at, m.end()) or [(chr(b), at + 4 * k, at + 4 * k + 4) for k, b in enumerate(raw)]
    if s[0] == "%":
        raw = bytes.fromhex(s.replace("%", ""))
        if content := _inside(raw, at, m.end()):
            return content
        try:
            chars, out, i = raw.decode(), [], 0
        except UnicodeDecodeError:
            return [(chr(b), at + 3 * k, at + 3 * k + 3) for k, b in enumerate(raw)]
        for c in chars:
            n = len(c.encode())
            out.append((c, at + 3 * i, at + 3 * (i + n)))
            i += n
        return out
    if s[0] == "&":
        c = html.unescape(s)
        return [(c, at, m.end())] if c != s else None
    units = [(int(u[1] or u[2], 16), at + u.start(), at + u.end()) for u in _UNICODE.finditer(s)]
    if all(u[0] < 256 for u in units) and (content := _inside(bytes(u[0] for u in units), at, m.end())):
        return content
    out, i = [], 0
    while i < len(units):
        code, a, e = units[i]
        if 0xD800 <= code < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1][0] < 0xE000:
            code, e, i = 0x10000 + ((code - 0xD800) << 10) + units[i + 1][0] - 0xDC00, units[i + 1][2], i + 1
        out.append((chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�", a, e))
        i += 1
    return out


def _inside(raw: bytes, start: int, end: int) -> list[tuple[str, int, int]] | None:
    """The content of compressed bytes as one piece of the whole escape; None if they are not compressed or too large."""
    if not _decompressor(raw):
        return None
    content, _, opened = _opened(raw)
    return [(content.decode("latin-1"), start, end)] if opened and len(content) <= MAX_INFLATED else None


def _wide(raw: bytes) -> str | None:
    """UTF-16 text: by its mark, or if every other byte is zero nearly everywhere."""
    if len(raw) < 8 or len(raw) % 2:
        return None
    marked = raw[:2] in (b"\xff\xfe", b"\xfe\xff")
    even, odd = raw[::2].count(0), raw[1::2].count(0)
    if not marked and max(even, odd) * 4 < len(raw):  # at least half of that side
        return None
    try:
        return raw.decode("utf-16" if marked else "utf-16-le" if odd > even else "utf-16-be")
    except UnicodeDecodeError:
        return None


def _deflated(raw: bytes) -> bytes | None:
    """What a complete raw deflate stream without any header holds (up to ``MAX_INFLATED`` bytes)."""
    d = zlib.decompressobj(-15)
    try:
        out = d.decompress(raw, MAX_INFLATED)
    except zlib.error:
        return None
    return out if d.eof and len(d.unused_data) < 3 else None


def _escapes(text: str) -> list[tuple[int, int, list[tuple[str, int, int]]]]:
    if "%" not in text and "\\" not in text and "&" not in text:
        return []
    return [(m.start(), m.end(), got) for m in _ESCAPE.finditer(text) if (got := _escaped(m))]


def _decompressor(head: bytes):
    if head[:2] in (b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda", b"\x1f\x8b"):
        return zlib.decompressobj(47)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\0":
        return lzma.LZMADecompressor()
    return None


def _members(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """What compressed bytes hold, member by member, then what follows the last one; up to the first fault."""
    chunks = iter(chunks)
    data, d, members, got = next(chunks, b""), None, 0, False
    while True:
        if d is None:
            while len(data) < 6 and (more := next(chunks, None)) is not None:
                data += more
            d = _decompressor(data) or _decompressor(data.lstrip(b"\0"))
            if d is None:
                yield data
                yield from chunks
                return
            if not _decompressor(data):
                data = data.lstrip(b"\0")
            members, got = members + 1, False
        try:
            out = d.decompress(data, 1 << 20)
        except (zlib.error, OSError, EOFError, lzma.LZMAError):
            if members > 1 and not got:  # only looked like one more member
                yield data
                yield from chunks
            return
        if out:
            got = True
            yield out
        if d.eof:
            data, d = d.unused_data, None
            if not data and (data := next(chunks, None)) is None:
                return
            continue
        data = getattr(d, "unconsumed_tail", b"")
        if not data and not out and getattr(d, "needs_input", True) and (data := next(chunks, None)) is None:
            return


def _opened(raw: bytes) -> tuple[bytes, Iterator[bytes], bool]:
    """The first ``MAX_INFLATED`` bytes or more of what ``raw`` holds, the others, and whether it was compressed."""
    head, rest, opened, seen = raw, iter(()), False, set()
    while _decompressor(head):
        digest = hashlib.blake2b(head, digest_size=16).digest()
        if digest in seen:  # archives that hold themselves
            break
        seen.add(digest)
        stream, parts, size = _members(chain([head], rest)), [], 0
        for part in stream:
            parts.append(part)
            size += len(part)
            if size > MAX_INFLATED:
                break
        if not size:
            break
        head, rest, opened = b"".join(parts), stream, True
    return head, rest, opened


def _windows(chunks: Iterable[bytes]) -> Iterator[str]:
    held = bytearray()
    for c in chunks:
        held += c
        while len(held) > WINDOW:
            yield held[:WINDOW].decode("latin-1")
            del held[:WINDOW - OVERLAP]
    yield held.decode("latin-1")


def _worth(raw: bytes, out: str) -> bool:
    """True for texts in any script, and for other bytes that hold a sign of a secret or of a further layer."""
    if not _CONTROL.search(out):
        try:
            raw.decode()
            return True
        except UnicodeDecodeError:
            pass
    low = out.lower()
    return (any(w in low for w in _ASSIGN_WORDS) or "AKIA" in out or bool(_HEX.search(out))
            or bool(_ESCAPE.search(out)) or bool(_BASE64.search(out)))


def _packed(text: str, wrapped: bool) -> tuple[list, list]:
    """Base64 runs (one line each, or ``wrapped``) that hold text, or compressed text; and those too large for a layer."""
    edits, large = [], []
    for m in (_WRAPPED if wrapped else _BASE64).finditer(text):
        if wrapped:
            lines = [x.span() for x in _LINE.finditer(text, m.start(), m.end())]
            size = [e - s for s, e in lines]
            even = next((k for k in range(len(lines) - 1) if size[k] == size[k + 1]), 0)
            tries = [lines[k:] for k in sorted({0, 1, even})]  # a word may end the line before the run
        else:
            tries = [[(m.start(), m.start() + len(m[0].rstrip("=")))]]
        for lines in tries:
            body = "".join([text[s:e] for s, e in lines]).replace("-", "+").replace("_", "/")
            if len(body) % 4 == 1:
                body = body[:-1]
            content, rest, opened = _opened(base64.b64decode(body + "=" * (-len(body) % 4)))
            s, e = lines[0][0], m.end()
            if len(content) > MAX_INFLATED and opened:
                large.append((s, e, hashlib.blake2b(content, digest_size=16).digest(), chain([content], rest)))
                break
            out = content.decode("latin-1")
            if (wide := _wide(content)) is not None:
                out, opened = wide, True
            elif not out or not _worth(content, out):
                raw = None if opened else _deflated(content)
                if not raw or not _worth(raw, raw.decode("latin-1")):
                    continue
                out, opened = raw.decode("latin-1"), True
            if opened:
                places = ()
            elif len(lines) == 1:
                places = range(s, s + len(body))
            else:
                places = array("q", chain.from_iterable(range(*x) for x in lines))
            edits.append((s, e, [(out, s, e, places)]))
            break
    return edits, large


def _child(layer: Layer, edits) -> Layer:
    text, parts, pieces, at, size = layer.text, [], [], 0, 0
    for s, e, decoded in edits:
        if s > at:
            pieces.append((size, at, s, None))
            parts.append(text[at:s])
            size += s - at
        for c, a, b, *places in decoded:
            pieces.append((size, a, b, places[0] if places else ()))
            parts.append(c)
            size += len(c)
        at = e
    if at < len(text):
        pieces.append((size, at, len(text), None))
        parts.append(text[at:])
    return Layer("".join(parts), layer, pieces, layer.depth + 1)


def find_secrets(text: str | None) -> tuple[list[tuple[str, int, int, bool, int]], int]:
    """((kind, start, end, base, depth) by start and kind, runs too large for a layer).

    Content over ``MAX_INFLATED`` bytes is scanned and decoded in windows that
    overlap by ``OVERLAP``; an encoded run inside it that is longer than that may
    be cut by a window's end.
    """
    if not text:
        return [], 0
    base = scan(text)
    found = {f: (True, 0) for f in base}
    seen, streamed = set(), set()

    def visit(child: Layer, *where) -> bool:
        digest = (hashlib.blake2b(child.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), *where)
        if digest in seen or not child.text:
            return False
        seen.add(digest)
        for s, kind, e in scan(child.text):
            start, end = child.to_root(s, e)
            found.setdefault((start, kind, end), (False, child.depth))
        return True

    def follow(first: Layer):
        work = [first]
        while work:
            layer = work.pop()
            runs = [_packed(layer.text, wrapped) for wrapped in (False, True)]
            for s, e, digest, stream in chain.from_iterable(large for _, large in runs):
                where = layer.to_root(s, e)
                if (where, digest) in streamed:
                    continue
                streamed.add((where, digest))
                for window in _windows(stream):
                    part = Layer(window, layer, [(0, s, e, ())], layer.depth + 1)
                    if visit(part, where):
                        follow(part)
            for edits in (_escapes(layer.text), *(edits for edits, _ in runs)):
                if edits and visit(child := _child(layer, edits)):
                    work.append(child)

    follow(Layer(text))
    return [(KINDS[k], s, e, *found[s, k, e]) for s, k, e in sorted(found)], len({s for (s, _), _ in streamed})


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,depth:int>>"


def _finder():
    def fn(texts):
        return [find_secrets(t) for t in texts]
    return fn


def scan_documents(docs: DataFrame, text_col: str = "text", spans_col: str = "secret_spans",
                   shut_col: str = "layers_shut") -> DataFrame:
    """``docs`` with the secret spans of each text (code points, end exclusive).

    A span has its kind, whether it is a base finding of the plain text, and the
    number of layers it was under.  Null and empty texts: no spans.  Repeated
    rows: each its own.  Empty table: empty.  Whole texts are scanned.  The new
    columns' names are arguments; other columns pass unchanged.
    """
    return map_rows(docs, [text_col], _finder, [(spans_col, SPANS), (shut_col, "int")])


def _redactor(mark: str):
    def make():
        def fn(texts):
            out = []
            for t in texts:
                spans, _ = find_secrets(t)
                if not spans:
                    out.append((t,))
                    continue
                parts, at = [], 0
                for _, s, e, _, _ in spans:
                    if s >= at:
                        parts += [t[at:s], mark]
                    at = max(at, e)
                out.append(("".join([*parts, t[at:]]),))
            return out
        return fn
    return make


def redact_documents(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret span (overlaps united) replaced by ``mark``; same columns, same rows."""
    new = free_name(docs.columns, "redacted")
    out = map_rows(docs, [text_col], _redactor(mark), [(new, "string")])
    return out.select(*[F.col(f"`{new}`").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
