"""Text predicates of the task-curation filters.

Python's ``\\b`` and ``\\w`` are Unicode-aware; the patterns here spell word
characters out as ``[\\p{L}\\p{N}_]`` so the same text gives the same answer in
Spark (Java regex) and in the DuckDB twins (RE2), whatever the language.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fixfold.functions.text import col_, non_blank, non_empty, word_count

WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"

# A 40-hex commit id not preceded by '/', or a bracketed 23-hex id.
COMMIT_HASH = rf"(^|[^/\p{{L}}\p{{N}}_])[0-9a-f]{{40}}($|{NOT_WORD})"
SHORT_HASH = r"\[[0-9a-f]{23}\]"

# Image and video extensions.
IMAGE_EXTS = ("png", "jpg", "jpeg", "gif", "bmp", "tiff", "svg", "webp", "ico", "heif", "bpg", "avif")
VIDEO_EXTS = ("mp4", "avi", "mkv", "mov", "wmv", "flv", "webm", "mpeg")
MEDIA = rf"(?i){WORD}\.({'|'.join(IMAGE_EXTS + VIDEO_EXTS)})($|{NOT_WORD})"

# Keywords that close an issue.
ISSUE_KEYWORDS = ("close", "closes", "closed", "fix", "fixes", "fixed", "resolve", "resolves", "resolved")
ISSUE_REF = rf"({WORD}+)\s+#(\d+)"
# The same matches, tried only at word starts (a match never begins inside a word);
# Java regex reads the look-behind, so Spark skips the in-word retries.
ISSUE_REF_AT_WORD = rf"(?<!{WORD}){ISSUE_REF}"
GITLAB_ISSUES = r"https?://gitlab.com/(.*)/issues"
BARE_REF = r"#(\d+)"

URL_ANY = r"https?://(www\.)?\S+"
URL_TOKEN = r"https?://\S+|www\.\S+"
FORGE = "github.com/"

# Words that show a test checks error text.
MATCH_CALLS = ("pytest.raises", "pytest.warns", "pytest.deprecated_call")
ASSERT_WORDS = ("assertOutput", "assertRaises", "checks.Error")


def valid_pull(merged_at="merged_at", resolved="resolved_issues") -> Column:
    """merged, with at least one resolved issue (NULL list → not valid)."""
    return col_(merged_at).isNotNull() & F.coalesce(F.size(col_(resolved)) > 0, F.lit(False))


def valid_instance(patch="patch", statement="problem_statement") -> Column:
    """non-empty patch and problem statement."""
    return non_empty(patch) & non_empty(statement)


def has_tests(test_patch="test_patch") -> Column:
    """test patch not blank."""
    return non_blank(test_patch)


def contains_commit_hash(text) -> Column:
    """F4."""
    t = col_(text)
    return t.rlike(COMMIT_HASH) | t.rlike(SHORT_HASH)


def contains_hyperlink(text, repo=None, strict: bool = False) -> Column:
    """any URL; with ``repo``, URLs into the repository's own forge pages do
    not count.  ``strict=True`` keeps the original look-ahead, which never
    excludes anything (so any ``http(s)://`` or ``www.`` text counts)."""
    t = col_(text)
    if repo is None:
        return t.rlike(URL_ANY)
    if strict:
        return t.rlike(r"https?://.+|www\..+")
    own = [F.concat(F.lit(p + FORGE), col_(repo)) for p in ("http://", "https://", "http://www.",
                                                           "https://www.", "www.")]
    urls = F.regexp_extract_all(t, F.lit(URL_TOKEN), 0)

    def foreign(u):
        c = F.lit(True)
        for o in own:
            c = c & ~u.startswith(o)
        return c

    return F.exists(urls, foreign)


def contains_image(text) -> Column:
    """an image/video extension right after a word character, case-insensitive."""
    return col_(text).rlike(MEDIA)


def keyword_reference(text) -> Column:
    """F7 (a): ``<word> #n`` where the word is a closing keyword."""
    words = F.regexp_extract_all(col_(text), F.lit(ISSUE_REF_AT_WORD), 1)
    return F.exists(words, lambda w: F.lower(w).isin(*ISSUE_KEYWORDS))


def gitlab_reference(text) -> Column:
    """F7 (b)."""
    return col_(text).rlike(GITLAB_ISSUES)


def bare_references(text) -> Column:
    """F7 (c) candidates: the numbers of every bare ``#n`` (checked against known issues)."""
    return F.regexp_extract_all(col_(text), F.lit(BARE_REF), 1)


def contains_match_arg(test_patch) -> Column:
    """the first branch decides when any pytest call is present."""
    t = col_(test_patch)
    calls = F.lit(False)
    for c in MATCH_CALLS:
        calls = calls | t.contains(c)
    words = F.lit(False)
    for w in ASSERT_WORDS:
        words = words | t.contains(w)
    return F.when(calls, t.contains("match")).otherwise(words)


def max_words(text, n: int = 50) -> Column:
    """at most n whitespace-separated words."""
    return word_count(text) <= n


def length_band(ids, lo=None, hi=None) -> Column:
    """token length in [lo, hi)."""
    c = F.lit(True)
    if lo is not None:
        c = c & (F.size(col_(ids)) >= lo)
    if hi is not None:
        c = c & (F.size(col_(ids)) < hi)
    return c


def max_chars(text, n: int = 5_000_000) -> Column:
    """F18."""
    return F.length(col_(text)) <= n


def repeating_tail(ids, window: int = 100, max_distinct: int = 10) -> Column:
    """at least ``window`` ids and at most ``max_distinct`` distinct among the last ``window``."""
    a = col_(ids)
    tail = F.slice(a, -window, window)
    return (F.size(a) >= window) & (F.size(F.array_distinct(tail)) <= max_distinct)
