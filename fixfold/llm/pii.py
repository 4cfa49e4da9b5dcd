"""Personal data: candidate spans judged by gradient-boosted trees.

Base findings (four fixed patterns with their checks) are always kept.  Beyond
them, high-recall generators propose spans that may overlap: addresses written
around the at sign, numbers in groups, IPv6.  Boosted trees score each proposal
from its format and its context; thresholds calibrated on held-back examples
choose which proposals are added.

There are no labels for personal data, so the trees learn from passages of the
corpus (a bounded sample) into which seeded positives and look-alikes (dates,
versions, amounts, ids) are written, and from the base findings of these passages,
which are positives.  What else stands in a passage may be personal data or not, so
only proposals of the written-in stretch count.  Thresholds are calibrated on
formats that the training examples do not have.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixfold.llm.common import map_rows

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match never ends inside a run of digits, so it only starts at the beginning of one.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]|[(\[{]\s?at\s?[)\]}]", re.I)
_AT_WORD = re.compile(r"[(\[{]\s?at\s?[)\]}]", re.I)

_GENERATORS = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\s?(?:@|[(\[{]\s?(?:at|AT)\s?[)\]}])\s?[A-Za-z0-9-]+"
                         r"(?:\s?(?:\.|[(\[{]\s?(?:dot|DOT)\s?[)\]}])\s?[A-Za-z0-9-]+)*")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Fa-f:])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20./_-]{1,2}[0-9]{4,6}){2,3}(?:[\x20./_-]{1,2}[0-9]{1,5})?(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])(?:\+|00)?(?:[0-9]{1,3}[\x20./-]{1,2})?\(?[0-9]{2,5}\)?[\x20./-]{1,2}[0-9]{2,5}"
                         r"(?:[\x20./-]{1,2}[0-9]{2,5}){0,3}(?![0-9])")),
)
#: Words that announce each kind, and words that announce other numbers.
_CUES = (
    re.compile(r"e-?mail|mail|contact|write|correo|courriel|kontakt", re.I),
    re.compile(r"\bip\b|host|server|addr|client|gateway", re.I),
    re.compile(r"card|visa|credit|payment|amex|karte|carte|tarjeta", re.I),
    re.compile(r"phone|tel|call|mobile|fax|cell|whatsapp|number|anruf", re.I),
    re.compile(r"version|\bv\.?$|order|invoice|isbn|date|build|release|serial|sku|price|total|page|section|\bid\b", re.I))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _emails(text: str):
    """Each address has one at sign, so each is read from its at sign outwards."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base findings, by kind and start."""
    out = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def propose(text: str) -> list[tuple[int, int, int]]:
    """Candidate spans of all generators; they may overlap each other and the base findings."""
    out = []
    has_digit = any(c in text for c in "0123456789")
    for kind, (name, pattern) in enumerate(_GENERATORS):
        if name == "email":
            if "@" not in text and not _AT_WORD.search(text):
                continue
        elif not has_digit or name == "ip" and ":" not in text:
            continue
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    return out


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format of a span, and its context."""
    span = text[start:end]
    digits = "".join(c for c in span if c in "0123456789")
    groups = re.findall(r"[0-9]+", span)
    before, after = text[max(0, start - 40):start], text[end:end + 12]
    left, right = text[start - 1:start], text[end:end + 1]
    tail = re.split(r"[^A-Za-z]+", span)[-1]
    return [kind == 0, kind == 1, kind == 2, kind == 3, len(span), len(digits), len(groups),
            len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0, max(map(len, groups), default=0),
            min(map(len, groups), default=0), sum(c.isalpha() for c in span), span.count("."), span.count("-"),
            span.count(" "), span.count("/"), span.count(":"), "@" in span, bool(_AT_WORD.search(span)), span[:1] == "+",
            "(" in span, bool(digits) and luhn(digits), 2 <= len(tail) <= 6,
            bool(groups) and len(groups[0]) == 4 and groups[0][:2] in ("19", "20"),
            left.isalnum(), left in ("$", "€", "#", "=", "/"), right.isalnum(), right in ("%", "€", "$"),
            *[bool(cue.search(before)) for cue in _CUES], bool(re.match(r"[\s,.;)]|$", after))]


@dataclass
class Trees:
    """Gradient-boosted trees of a fixed depth, stored as arrays (complete binary trees)."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        depth = int(np.log2(self.leaf.shape[1]))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), dtype=int)
            for _ in range(depth):
                at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
            out += leaf[at - len(feature)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32,
          leaf_penalty: float = 1.0) -> Trees:
    """Second-order gradient boosting of the log loss over binned features."""
    cuts = [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for col in x.T]
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)], 1)
    start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    margin, inner = np.full(len(y), start), 2 ** depth - 1
    made = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        at = np.zeros(len(y), dtype=int)
        feature, cut = np.zeros(inner, dtype=int), np.full(inner, np.inf)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best, choice = 1e-6, None
            if len(rows) >= 10:
                gain0 = g[rows].sum() ** 2 / (h[rows].sum() + leaf_penalty)
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gs = np.bincount(binned[rows, f], g[rows], len(c) + 1).cumsum()
                    hs = np.bincount(binned[rows, f], h[rows], len(c) + 1).cumsum()
                    gain = gs[:-1] ** 2 / (hs[:-1] + leaf_penalty) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + leaf_penalty) - gain0
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best, choice = gain[k], (f, c[k])
            if choice:
                feature[node], cut[node] = choice
            at[rows] = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        where = at - inner
        gs, hs = np.bincount(where, g, inner + 1), np.bincount(where, h, inner + 1)
        leaf = -rate * gs / (hs + leaf_penalty)
        margin += leaf[where]
        made.append((feature, cut, leaf))
    return Trees(*(np.stack(part) for part in zip(*made)), start)


@dataclass
class PiiModel:
    trees: Trees
    thresholds: dict[int, float]  # margin from which a proposal of a kind is added

    def spans(self, text: str | None) -> list[tuple[str, int, int, bool, float]]:
        """(kind, start, end, base, margin) by kind and start; base findings always stay."""
        if not text or not _ANY.search(text):
            return []
        base = base_spans(text)
        out = [(k, s, e, True, 0.0) for k, s, e in base]
        taken = sorted((s, e) for _, s, e in base)
        new = [c for c in propose(text) if not any(s < c[2] and c[1] < e for s, e in taken)] if len(taken) < 16 else \
            _apart(propose(text), taken)
        if new:
            margin = self.trees.margin(np.array([features(text, *c) for c in new], dtype=float))
            chosen = sorted(((m, c) for m, c in zip(margin, new) if m >= self.thresholds[c[0]]),
                            key=lambda x: (-x[0], x[1]))
            used: dict[int, int] = {}
            for m, (k, s, e) in chosen:  # the surer of two that overlap
                if not any(i in used for i in range(s, e)):
                    used.update(dict.fromkeys(range(s, e), k))
                    out.append((k, s, e, False, float(m)))
        return [(KINDS[k], s, e, b, m) for k, s, e, b, m in sorted(out)]


def _apart(candidates, taken):
    """Candidates that overlap none of the sorted spans (whose ends may not be sorted)."""
    from bisect import bisect_left

    starts, ends, top = [s for s, _ in taken], [], 0
    for _, e in taken:
        top = max(top, e)
        ends.append(top)
    out = []
    for c in candidates:
        i = bisect_left(starts, c[2])
        if not i or ends[i - 1] <= c[1]:
            out.append(c)
    return out


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _positive(r: random.Random) -> tuple[int, str, str]:
    """(kind, announcing words, personal data) in one of many formats."""
    kind = r.randrange(4)
    name = "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(3, 9)))
    host = "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(3, 9)))
    if kind == 0:
        dot, at = r.choice([(".", " @ "), (" (dot) ", " (at) "), ("[dot]", "[at]"), (".", "(at)"), (".", "@"), (" . ", " @ ")])
        return 0, r.choice(["email ", "mail: ", "contact ", "write to ", ""]), f"{name}{at}{host}{dot}{r.choice(['com', 'org', 'net', 'de', 'fr', 'es'])}"
    if kind == 1:
        groups = [f"{r.randrange(65536):x}" for _ in range(8)]
        return 1, r.choice(["ip ", "host ", "server ", ""]), ":".join(groups)
    if kind == 2:
        body = r.choice("3456") + _digits(r, 14)
        body += next(d for d in "0123456789" if luhn(body + d))
        sep = r.choice([".", "/", "_", "  "])
        return 2, r.choice(["card ", "visa: ", "credit card ", "paid with ", ""]), sep.join(body[i:i + 4] for i in range(0, 16, 4))
    a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
    form = r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{a}/{b} {c}", f"00{_digits(r, 2)} {a} {b} {c}", f"{a} {b} {c}"])
    return 3, r.choice(["phone ", "tel. ", "call ", "mobile: ", "fax ", "phone number "]), form


def _lookalike(r: random.Random) -> tuple[str, str]:
    """(announcing words, something that is no personal data)."""
    year = r.randint(1950, 2030)
    return r.choice([
        ("date ", f"{year}-{r.randint(1, 12):02}-{r.randint(1, 28):02}"), ("on ", f"{r.randint(1, 28)}.{r.randint(1, 12)}.{year}"),
        ("version ", ".".join(_digits(r, r.randint(1, 3)) for _ in range(r.randint(2, 4)))),
        ("total ", f"{_digits(r, 3)}.{_digits(r, 3)}.{_digits(r, 3)}"), ("price $", f"{_digits(r, 3)} {_digits(r, 3)}"),
        ("isbn ", f"978-{_digits(r, 1)}-{_digits(r, 4)}-{_digits(r, 4)}-{_digits(r, 1)}"), ("order ", "-".join(_digits(r, 4) for _ in range(4))),
        ("at ", f"{r.randint(0, 23):02}:{r.randint(0, 59):02}:{r.randint(0, 59):02}"), ("pages ", f"{_digits(r, 3)}-{_digits(r, 3)}"),
        ("id ", " ".join(_digits(r, 4) for _ in range(4))), ("", f"{_digits(r, 4)} {_digits(r, 5)}"), ("", f"{_digits(r, 3)}-{_digits(r, 3)}-{_digits(r, 4)}"),
        ("", f"{_digits(r, 2)}/{_digits(r, 2)}/{_digits(r, 4)} {_digits(r, 2)}"), ("score ", f"{_digits(r, 2)}-{_digits(r, 2)}"),
        ("see @", "handle and more"), ("years ", f"{year}-{year + r.randint(1, 20)}"), ("mac ", ":".join(f"{r.randrange(256):02x}" for _ in range(6))),
        ("", f"{r.randint(1, 9)} 000 000 000"), ("user@", "localhost"), ("meet @ ", "noon today")])


def _other_positive(r: random.Random) -> tuple[int, str, str]:
    """(kind, announcing words, personal data) in formats and words of their own, for calibration."""
    kind, word = r.randrange(4), lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    if kind == 0:
        at, dot = r.choice([("{at}", "{dot}"), (" [AT] ", " [DOT] "), ("@ ", "."), (" ( at ) ", ".")])
        return 0, r.choice(["reply to ", "Kontakt: ", "correo ", "or "]), f"{word(5)}.{word(4)}{at}{word(7)}{dot}{r.choice(['it', 'info', 'co'])}"
    if kind == 1:
        return 1, r.choice(["client ", "gateway ", "from "]), ":".join(f"{r.randrange(4096):X}" for _ in range(8))
    if kind == 2:
        body = r.choice(["34", "37"]) + _digits(r, 12)
        body += next(d for d in "0123456789" if luhn(body + d))
        sep = r.choice([".", "/", "_"])
        return 2, r.choice(["amex ", "Karte: ", "charged to ", "payment "]), sep.join([body[:4], body[4:10], body[10:]])
    a, b, c = _digits(r, 4), _digits(r, 3), _digits(r, 3)
    return 3, r.choice(["Anruf ", "whatsapp ", "cell ", "reach us at "]), r.choice(
        [f"({a}) {b} {c}", f"{a}/{b}-{c}", f"00{_digits(r, 2)}.{_digits(r, 2)}.{b}.{c}", f"{_digits(r, 2)}-{a}-{c}"])


def _other_lookalike(r: random.Random) -> tuple[str, str]:
    """(announcing words, something that is no personal data), for calibration."""
    return r.choice([
        ("build ", f"{_digits(r, 4)}.{_digits(r, 2)}.{_digits(r, 4)}"), ("section ", f"{_digits(r, 2)}.{_digits(r, 2)}.{_digits(r, 3)}"),
        ("serial ", f"{_digits(r, 4)}-{_digits(r, 4)}-{_digits(r, 4)}-{_digits(r, 2)}"), ("sku ", f"{_digits(r, 4)} {_digits(r, 4)} {_digits(r, 4)}"),
        ("invoice ", f"{_digits(r, 4)}/{_digits(r, 4)}"), ("at ", f"{r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}:{_digits(r, 2)}"),
        ("between ", f"{_digits(r, 4)} - {_digits(r, 4)}"), ("", f"{_digits(r, 5)}.{_digits(r, 2)} {_digits(r, 5)}.{_digits(r, 2)}"),
        ("mass ", f"{_digits(r, 3)} {_digits(r, 3)} {_digits(r, 3)}"), ("look @ ", "home now"), ("", f"{_digits(r, 3)}.{_digits(r, 3)},{_digits(r, 2)}")])


def _written(r: random.Random, passages: list[str], true: bool, positive, lookalike):
    """One example: its text, the span of the data (or None), and the stretch that was written in."""
    words = r.choice(passages).split()
    cut = r.randint(0, len(words))
    left, right = " ".join(words[:cut]) + " ", " " + " ".join(words[cut:])
    kind, cue, data = positive(r) if true else (None, *lookalike(r))
    begin, end = len(left + cue), len(left + cue + data)
    return left + cue + data + right, (kind, begin, end) if true else None, (len(left), end + 1)


def fit(docs: DataFrame, text_col: str = "text", max_passages: int = 1500, examples: int = 8000, precision: float = 0.99,
        seed: int = 17) -> PiiModel:
    """Train on about ``max_passages`` corpus passages at most and ``examples`` written-in examples.

    A passage has at most 60 words and 600 characters.  Three quarters of the examples and the
    passages' base findings train; the last quarter has formats of its own, and
    each kind's threshold is the lowest margin, at even odds or above, that reaches ``precision`` on it.
    """
    share = min(1.0, max_passages / max(1, docs.count()))
    text = F.coalesce(F.col(text_col), F.lit(""))
    # a stretch of characters first: a text without blanks is one word
    start = (F.rand(seed + 1) * F.greatest(F.lit(1), F.length(text) - 599)).cast("int") + 1
    sample = docs.where(F.rand(seed) < share).select(F.substring(text, start, F.lit(600)).alias("t"))
    sample = sample.select(F.slice(F.split("t", r"\s+"), 1, 60).alias("w"))
    passages = sorted(" ".join(r["w"]) for r in sample.collect()) or [""]
    r = random.Random(seed)
    rows, labels, kinds, held = [], [], [], []
    for t in passages:
        for k, s, e in base_spans(t):
            rows.append(features(t, k, s, e))
            labels.append(1.0)
            kinds.append(k)
            held.append(False)
    for n in range(examples):
        last = n % 8 < 2
        text, true, (begin, end) = _written(r, passages, n % 2 == 1, *((_other_positive, _other_lookalike) if last else (_positive, _lookalike)))
        for c in propose(text):
            if begin <= c[1] and c[2] <= end:
                rows.append(features(text, *c))
                labels.append(float(c == true))
                kinds.append(c[0])
                held.append(last)
    x, y, kind, held = np.array(rows, dtype=float), np.array(labels), np.array(kinds), np.array(held)
    trees = boost(x[~held], y[~held])
    margin, thresholds = trees.margin(x[held]), {}
    for k in range(len(KINDS)):
        own = kind[held] == k
        order = np.argsort(-margin[own])
        m, hit = margin[own][order], y[held][own][order]
        good = np.flatnonzero(hit.cumsum() >= precision * np.arange(1, len(hit) + 1))
        limit = float(m[good[-1]]) if len(good) else float("inf")
        if len(good) and good[-1] + 1 < len(m) and m[good[-1] + 1] == limit:  # ties stay out together
            limit = float(np.nextafter(limit, np.inf))
        thresholds[k] = max(0.0, limit)  # never below even odds
    return PiiModel(trees, thresholds)


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,margin:double>>"


def scan_documents(docs: DataFrame, model: PiiModel, text_col: str = "text", spans_col: str = "pii_spans") -> DataFrame:
    """``docs`` with the personal-data spans of each whole text (code points, end exclusive), by kind and start.

    Null and empty texts: no spans.  Repeated rows: each its own.  Empty table:
    empty.  The column name is an argument; other columns pass unchanged.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        return lambda texts: [(m.spans(t),) for t in texts]

    return map_rows(docs, [text_col], make, [(spans_col, SPANS)])
