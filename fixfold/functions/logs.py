"""Per-line rules that turn a test log line into (test, status) emissions.

Each rule returns an ``array<struct<test string, status string>>`` column for
one line; several emissions on one line keep their order (later wins).  The
rule is chosen by a column, so logs of every dialect are parsed in a single
pass over the exploded lines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fixfold.functions.text import strip

# The status vocabulary of test runners.
STATUS_WORDS = ("FAILED", "PASSED", "SKIPPED", "ERROR", "XFAIL")

# Log parser rule per repository.
REPO_RULES = {
    "astropy/astropy": "ansi",
    "django/django": "verbose",
    "marshmallow-code/marshmallow": "pytest",
    "matplotlib/matplotlib": "rewrite",
    "mwaskom/seaborn": "mixed",
    "pallets/flask": "pytest",
    "psf/requests": "options",
    "pvlib/pvlib-python": "pytest",
    "pydata/xarray": "pytest",
    "pydicom/pydicom": "options",
    "pylint-dev/astroid": "pytest",
    "pylint-dev/pylint": "options",
    "pytest-dev/pytest": "pytest",
    "pyvista/pyvista": "pytest",
    "scikit-learn/scikit-learn": "ansi",
    "sqlfluff/sqlfluff": "pytest",
    "sphinx-doc/sphinx": "ansi",
    "sympy/sympy": "framed",
}

# Token rewrites of the "rewrite" rule.
REWRITES = (("MouseButton.LEFT", "1"), ("MouseButton.RIGHT", "3"))

# Multi-line passes of the verbose runner (matched on the whole log).
VERBOSE_BLOB_PATTERNS = (
    r"(?m)^(.*?)\s\.\.\.\sTesting\ against\ Django\ installed\ in\ ((?s:.*?))\ silenced\)\.\nok$",
    r"(?m)^(.*?)\s\.\.\.\sInternal\ Server\ Error:\ \/(.*)\/\nok$",
    r"(?m)^(.*?)\s\.\.\.\sSystem check identified no issues \(0 silenced\)\nok$",
)
VERSION_LINE = "--version is equivalent to version"
DJANGO_SPECIAL_PREFIX = "Applying sites.0002_alter_domain_unique...test_no_migrations"

# The framed-header pattern of the "framed" rule (whole log).
FRAMED_PATTERN = r"(_*) (.*)\.py:(.*) (_*)"

def _empty() -> Column:
    return F.array().cast("array<struct<test:string,status:string>>")


def _emit(test: Column, status) -> Column:
    status = F.lit(status) if isinstance(status, str) else status
    return F.array(F.struct(test.alias("test"), status.alias("status")))


def tokens(line: Column) -> Column:
    """``str.split()``: runs of non-whitespace."""
    return F.regexp_extract_all(line, F.lit(r"(?U)\S+"), 0)


def starts_with_status(line: Column) -> Column:
    cond = F.lit(False)
    for s in STATUS_WORDS:
        cond = cond | line.startswith(s)
    return cond


def ends_with_status(line: Column) -> Column:
    cond = F.lit(False)
    for s in STATUS_WORDS:
        cond = cond | line.endswith(s)
    return cond


def _failed_dash(line: Column) -> Column:
    return F.when(line.startswith("FAILED"), F.replace(line, F.lit(" - "), F.lit(" "))) \
        .otherwise(line)


def option_name(test: Column) -> Column:
    """``name[/a/b/c]`` → ``name[/c]`` unless the option has ``//`` or ``*``."""
    pat = r"^(.*?)\[(.*)\]"
    has = test.rlike(r"\[.*\]")
    # search semantics: the lazy main part stops at the first '['
    main = F.regexp_extract(test, pat, 1)
    opt = F.regexp_extract(test, pat, 2)
    keep_tail = opt.startswith("/") & ~opt.startswith("//") & ~opt.contains("*")
    opt2 = F.when(keep_tail, F.concat(F.lit("/"), F.try_element_at(F.split(opt, "/", -1), F.lit(-1)))) \
        .otherwise(opt)
    return F.when(has, F.concat(main, F.lit("["), opt2, F.lit("]"))).otherwise(test)


def clean_ansi(line: Column) -> Column:
    line = F.regexp_replace(line, r"\[(\d+)m", "")
    return F.regexp_replace(line, "[\u0001-\u001f]", "")


def _before_first(s: Column, sep: str) -> Column:
    return F.substring_index(s, sep, 1)


def _strip_suffix(s: Column, suffix: str) -> Column:
    """``s.rsplit(suffix, 1)[0]``: text before the last occurrence of suffix
    (found as the first occurrence of the reversed suffix in the reversed text)."""
    rs = F.reverse(s)
    at = F.instr(rs, suffix[::-1])
    return F.when(at > 0, F.reverse(F.substr(rs, at + len(suffix)))).otherwise(s)


def verbose_prev_marker(line: Column) -> Column:
    """Test named on a line holding `` ... `` (NULL otherwise)."""
    s = strip(line)
    return F.when(s.contains(" ... "), _before_first(s, " ... "))


# The rules run in three projections so that each generated method stays small
# and shared pieces (stripped line, tokens) are computed once per line:
#   stage 1  s (stripped line), pre (rule-specific rewrite of the line)
#   stage 2  tokens and the cut/pass variants
#   stage 3  the emissions, dispatched on the rule column


def stage1(rule: Column, line: Column) -> list[Column]:
    pre = line
    for a, b in REWRITES:
        pre = F.replace(pre, F.lit(a), F.lit(b))
    pre = (F.when(rule == "rewrite", pre)
           .when(rule == "ansi", clean_ansi(line))
           .otherwise(line))
    return [strip(line).alias("s"), pre.alias("pre")]


def stage2() -> list[Column]:
    s, pre = F.col("s"), F.col("pre")
    cut = F.when(s.endswith("[FAIL]") | s.endswith("[OK]"),
                 strip(F.regexp_replace(s, r"\[[^\[]*$", ""))).otherwise(s)
    special = s.startswith(DJANGO_SPECIAL_PREFIX)
    after_first = F.substr(s, F.instr(s, "...") + 3)
    return [
        starts_with_status(pre).alias("sw"),
        ends_with_status(pre).alias("ew"),
        tokens(_failed_dash(pre)).alias("tkd"),
        tokens(pre).alias("tk"),
        tokens(s).alias("tks"),
        cut.alias("cut"),
        F.when(special, strip(after_first)).otherwise(s).alias("s_pass"),
    ]


def _at(arr: str, i: int) -> Column:
    return F.try_element_at(F.col(arr), F.lit(i))


def _pytest(option: bool = False) -> Column:
    test = _at("tkd", 2)
    if option:
        test = option_name(test)
    return F.when(F.col("sw") & (F.size("tkd") > 1), _emit(test, _at("tkd", 1))).otherwise(_empty())


def _ansi() -> Column:
    return (F.when(F.col("sw"), F.when(F.size("tkd") > 1, _emit(_at("tkd", 2), _at("tkd", 1)))
                   .otherwise(_empty()))
            .when(F.col("ew") & (F.size("tk") > 1), _emit(_at("tk", 1), _at("tk", 2)))
            .otherwise(_empty()))


def _mixed(line: Column) -> Column:
    return (F.when(line.startswith("FAILED"),
                   F.when(F.size("tk") > 1, _emit(_at("tk", 2), "FAILED")).otherwise(_empty()))
            .when(line.contains(" PASSED "),
                  F.when(_at("tk", 2) == "PASSED", _emit(_at("tk", 1), "PASSED")).otherwise(_empty()))
            .when(line.startswith("PASSED") & (F.size("tk") > 1), _emit(_at("tk", 2), "PASSED"))
            .otherwise(_empty()))


def _framed() -> Column:
    s, cut = F.col("s"), F.col("cut")
    first = F.try_element_at(tokens(cut), F.lit(1))
    return F.when(
        s.startswith("test_"),
        F.when(cut.endswith(" E"), _emit(first, "ERROR"))
        .when(cut.endswith(" F"), _emit(first, "FAILED"))
        .when(cut.endswith(" ok"), _emit(first, "PASSED"))
        .otherwise(_empty()),
    ).otherwise(_empty())


def _verbose(prev_test: Column) -> Column:
    """Verbose-runner rules in their fixed order (several may fire on one line)."""
    s, s_pass = F.col("s"), F.col("s_pass")
    parts = [F.when(s.contains(VERSION_LINE), _emit(F.lit(VERSION_LINE), "PASSED"))]
    pass_emit = None
    for suffix in (" ... ok", " ... OK", " ...  OK"):
        e = F.when(s.endswith(suffix), _emit(_strip_suffix(s_pass, suffix), "PASSED"))
        pass_emit = e if pass_emit is None else F.coalesce(pass_emit, e)
    parts.append(pass_emit)
    parts.append(F.when(s.contains(" ... skipped"), _emit(_before_first(s, " ... skipped"), "SKIPPED")))
    parts.append(F.when(s.endswith(" ... FAIL"), _emit(_before_first(s, " ... FAIL"), "FAILED")))
    parts.append(F.when(s.startswith("FAIL:") & (F.size("tks") > 1), _emit(_at("tks", 2), "FAILED")))
    parts.append(F.when(s.endswith(" ... ERROR"), _emit(_before_first(s, " ... ERROR"), "ERROR")))
    parts.append(F.when(s.startswith("ERROR:") & (F.size("tks") > 1), _emit(_at("tks", 2), "ERROR")))
    parts.append(F.when(s.startswith("ok") & prev_test.isNotNull(), _emit(prev_test, "PASSED")))
    return F.concat(*[F.coalesce(p, _empty()) for p in parts])


def stage3(rule: Column, line: Column, prev_test: Column) -> Column:
    """Emissions of one line, dispatched on the rule column."""
    return (
        F.when(rule.isin("pytest", "rewrite"), _pytest())
        .when(rule == "options", _pytest(option=True))
        .when(rule == "ansi", _ansi())
        .when(rule == "mixed", _mixed(line))
        .when(rule == "framed", _framed())
        .when(rule == "verbose", _verbose(prev_test))
        .otherwise(_empty())
    )
