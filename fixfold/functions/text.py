"""Column functions over text: each takes and returns a ``Column``.

All are built from JVM-side built-ins so they stay inside whole-stage codegen.
Regexes use ``(?U)`` where the reference relied on Unicode ``\\s``/``\\w``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NL = "\n"

# The characters Python's str.split()/str.strip() treat as whitespace,
# written as a regex class both Java regex and RE2 read the same way.
PY_WS = (r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
         r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
PY_NON_WS = "[^" + PY_WS[1:]


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lines(c) -> Column:
    """Split text into lines on ``\\n`` (a trailing newline yields a last empty line)."""
    return F.split(col_(c), NL, -1)


def edit_lines(c) -> Column:
    """Lines of a patch that start with ``+`` or ``-``, in order, duplicates kept."""
    return F.filter(lines(c), lambda l: F.substring(l, 1, 1).isin("+", "-"))


def edit_line_set(c) -> Column:
    """The *set* of ``+``/``-`` lines, as a sorted distinct array (comparable)."""
    return F.array_sort(F.array_distinct(edit_lines(c)))


def count_chars(c, chars: str) -> Column:
    """Occurrences of any of ``chars`` in the text."""
    c = col_(c)
    total = F.lit(0)
    for ch in chars:
        total = total + (F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit(""))))
    return total


def strip(c) -> Column:
    """Python ``str.strip()``: Unicode whitespace at both ends."""
    return F.regexp_replace(col_(c), f"^{PY_WS}+|{PY_WS}+$", "")


def word_count(c) -> Column:
    """Whitespace-separated words, Unicode aware (``len(text.split())``)."""
    return F.size(F.regexp_extract_all(col_(c), F.lit(PY_NON_WS + "+"), 0))


def non_blank(c) -> Column:
    """Text with at least one non-whitespace character; NULL counts as blank."""
    return F.coalesce(col_(c).rlike(PY_NON_WS), F.lit(False))


def non_empty(c) -> Column:
    """NULL-safe ``len(x) > 0``."""
    return F.coalesce(F.length(col_(c)) > 0, F.lit(False))
