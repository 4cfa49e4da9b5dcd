"""Versions: release lists, as-of assignment, version text.

As-of join at scale: the version depends on (repository, date) only, so the
window runs over distinct dates and releases, never over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixfold.functions.text import col_

# Version-string patterns tried in order (first match wins), per repository.
DEFAULT_VERSION_PATTERNS = (r"""__version__ = ['"](.*)['"]""", r"VERSION = \((.*)\)")
VERSION_PATTERNS = {
    "pytest-dev/pytest": (r"""__version__ = ['"](.*)['"]""", r"""__version__ = version = ['"](.*)['"]""",
                          r"VERSION = \((.*)\)"),
    "matplotlib/matplotlib": (r"""__version__ = ['"](.*)['"]""",
                              r"""__version__ = version = ['"](.*)['"]""", r"VERSION = \((.*)\)"),
    "Qiskit/qiskit": (r"(.*)",),
    # no group: the whole match is the version text
    "pyvista/pyvista": (r"version_info = [\d]+,[\d\s]+,",),
}
DOCSTRING = r'(?s)""".*?"""'

# Tracker timestamp formats (prefix removed first).
TRACKER_PREFIX = "See timeline at "
TRACKER_FORMATS = ("MM/dd/yy HH:mm:ss", "MMM d, yyyy, h:mm:ss a")

# Where each site's release pages name a version and its date:
# (pattern, text of the version, text of the date, date formats, what a date in no format does).
CHANGELOG_ANCHOR = r'<a class="reference internal nav-link" href="#version-([^"]*)">Version ([^ <]*) \(([^)<]*)\)</a>'
SITES = {
    "anchors": (CHANGELOG_ANCHOR, 2, 3, ("yyyy-MM-dd", "MMMM d, yyyy", "d MMMM yyyy"), "raise"),
    "dashed": (r'<a class="reference internal nav-link(?: active)?" href="#v([^"\n]*)">v([^<\n]*) \(([^)\n]*)\)</a>', 1, 1,
               ("MMMM d yyyy", "d MMMM yyyy"), "drop"),
    "padded": (r'<a class="reference internal nav-link" href="#([^"\n]*)">\n\s+v([^\n]*)\n\s+</a>', 2, 2,
               ("MMMM d, yyyy",), "raise"),
    "notes": (r"""<a class="reference internal" href="prev_whats_new/whats_new_([^"\n]*)\.html">What's new in Matplotlib ([^<\n]*)</a>""",
              1, 2, ("MMM d, yyyy",), "raise"),
    "table": (r"(?s)<tr[^>]*>\s*<td[^>]*>(.*?)</td>\s*<td[^>]*>(.*?)</td>\s*<td[^>]*>.*?</td>\s*</tr>", 1, 2,
              ("MMMM yyyy", "MMM yyyy"), "raise"),
}
# Release names of the sixth site, whose date may stand in the name.
RELEASE_NAME_PREFIXES = ("SQLFluff ", "Bugfix Release ")
DATED_NAME = r"\[[\d.\w]*\] - \d*-\d*-\d*"
PLAIN_NAME = r"\d\.\d\.[\d.]*"

# Files that hold a repository's version, tried in order.
VERSION_PATHS = {
    "dbt-labs/dbt-core": ("core/dbt/version.py", "core/dbt/__init__.py"),
    "django/django": ("django/__init__.py",),
    "huggingface/transformers": ("src/transformers/__init__.py",),
    "marshmallow-code/marshmallow": ("src/marshmallow/__init__.py",),
    "mwaskom/seaborn": ("seaborn/__init__.py",),
    "pallets/flask": ("src/flask/__init__.py", "flask/__init__.py"),
    "psf/requests": ("requests/__version__.py", "requests/__init__.py"),
    "pyca/cryptography": ("src/cryptography/__about__.py", "src/cryptography/__init__.py"),
    "pylint-dev/astroid": ("astroid/__pkginfo__.py", "astroid/__init__.py"),
    "pylint-dev/pylint": ("pylint/__pkginfo__.py", "pylint/__init__.py"),
    "pytest-dev/pytest": ("src/_pytest/_version.py", "_pytest/_version.py"),
    "pyvista/pyvista": ("pyvista/_version.py", "pyvista/__init__.py"),
    "Qiskit/qiskit": ("qiskit/VERSION.txt",),
    "scikit-learn/scikit-learn": ("sklearn/__init__.py",),
    "sphinx-doc/sphinx": ("sphinx/__init__.py",),
    "sympy/sympy": ("sympy/release.py", "sympy/__init__.py"),
}


def major_minor(col, sep: str = ".") -> Column:
    """Keep the first two parts (joined with '.'), then only digits and dots."""
    parts = F.split(F.trim(col_(col)), "\\" + sep if sep in ".|" else sep, -1)
    return F.regexp_replace(F.array_join(F.slice(parts, 1, 2), "."), r"[^0-9.]", "")


def clean_version(raw) -> Column:
    """P7 tail: major.minor by '.' when present, else by ',', then digits/dots only."""
    r = col_(raw)
    mm_dot = F.array_join(F.slice(F.split(F.trim(r), r"\.", -1), 1, 2), ".")
    r2 = F.when(r.contains("."), mm_dot).otherwise(r)
    mm_comma = F.array_join(F.slice(F.split(F.trim(r2), ",", -1), 1, 2), ".")
    r3 = F.when(r2.contains(","), mm_comma).otherwise(r2)
    return F.regexp_replace(r3, r"[^0-9.]", "")


def version_candidates(files: DataFrame, key: str = "instance_id", path: str = "path") -> DataFrame:
    """The files that may hold the version, with ``file_pos``: the
    repository's listed paths in order; of other repositories all files, as given."""
    listed = files.sparkSession.createDataFrame(
        [(r, i, p) for r, ps in VERSION_PATHS.items() for i, p in enumerate(ps)], "repo string, file_pos int, _path string")
    known = listed.select("repo").distinct()
    hit = files.join(listed, "repo").where(F.col(path) == F.col("_path")).drop("_path")
    return hit.unionByName(files.join(known, "repo", "left_anti").withColumn("file_pos", F.lit(0)))


def spec_lookup(tasks: DataFrame, specs: DataFrame, key=("repo", "version")) -> DataFrame:
    """The installation spec of each task's (repo, version); ``specs`` is a
    table of one row per pair.  Tasks without a spec keep nulls."""
    return tasks.join(specs, list(key), "left")


def find_version(files: DataFrame, key: str = "instance_id", text: str = "text") -> DataFrame:
    """Version of each file text: docstrings removed, the first pattern of
    the repository's list that matches, its group 1 without spaces, cleaned.
    Candidate files of one key are tried in ``file_pos`` order when present."""
    lists = F.create_map(*[x for r, ps in VERSION_PATTERNS.items() for x in (F.lit(r), F.array(*map(F.lit, ps)))])
    default = F.array(*map(F.lit, DEFAULT_VERSION_PATTERNS))
    body = files.withColumn("_t", F.regexp_replace(F.col(text), DOCSTRING, "")).withColumn(
        "_patterns", F.coalesce(F.try_element_at(lists, F.col("repo")), default))
    # the patterns are tried in the row, so a text is never sent to them
    tried = F.expr("""transform(_patterns, (p, i) -> struct(i as pattern_pos,
        if(_t rlike p, replace(regexp_extract(_t, p, if(contains(p, '('), 1, 0)), ' ', ''), null) as raw))""")
    j = body.withColumn("_hit", F.try_element_at(F.filter(tried, lambda x: x["raw"].isNotNull()), F.lit(1)))
    j = j.where(F.col("_hit").isNotNull()).select("*", "_hit.raw", "_hit.pattern_pos")
    order = [F.col("file_pos"), F.col("pattern_pos")] if "file_pos" in files.columns else [F.col("pattern_pos")]
    best = j.groupBy(key).agg(F.min_by("raw", F.struct(*order)).alias("raw"))
    return files.select(key).distinct().join(best, key, "left").select(
        key, clean_version(F.col("raw")).alias("version"))


def parse_tracker_time(col) -> Column:
    """A tracker timestamp in one of two formats (prefix removed); neither
    format → error."""
    c = col_(col)
    s = F.when(c.startswith(TRACKER_PREFIX), F.substr(c, F.lit(len(TRACKER_PREFIX) + 1))).otherwise(c)
    a = F.when(s.contains("/"), F.try_to_timestamp(s, F.lit(TRACKER_FORMATS[0])))
    b = F.when(~s.contains("/") & s.contains(","), F.try_to_timestamp(s, F.lit(TRACKER_FORMATS[1])))
    parsed = F.coalesce(a, b)
    return F.when(parsed.isNotNull(), parsed).otherwise(
        F.raise_error(F.concat(F.lit("Timestamp format not recognized: "), s)))


def _parsed_date(text: Column, formats, otherwise: str) -> Column:
    """The date in the first format that fits (any case of month names)."""
    t = F.initcap(F.trim(text))
    found = F.coalesce(*[F.try_to_date(t, f) for f in formats])
    if otherwise == "drop":
        return found
    return F.when(found.isNotNull() | t.isNull(), found).otherwise(
        F.raise_error(F.concat(F.lit("Release date not recognized: "), text)).cast("date"))


def extract_releases(pages: DataFrame, repo: str = "repo", html: str = "html", site: str = "anchors") -> DataFrame:
    """(repo, version, released_at) of a site's release page: all matches of
    the site's pattern, deduplicated, version cut to major.minor, date parsed in
    any of the site's formats (a date in none is an error, or left out where the
    site mixes in other anchors)."""
    pattern, v, d, formats, otherwise = SITES[site]
    m = pages.select(repo, F.explode(F.arrays_zip(
        F.regexp_extract_all(F.col(html), F.lit(pattern), v).alias("v"),
        F.regexp_extract_all(F.col(html), F.lit(pattern), d).alias("d"))).alias("m"))
    m = m.select(repo, F.col("m.v").alias("v"), F.col("m.d").alias("d")).distinct()
    ver, date = F.col("v"), F.col("d")
    if site == "dashed":  # the anchor itself: 0-20-0-may-1-2021
        parts = F.split(date, "-", -1)
        ver = F.array_join(F.slice(parts, 1, 2), ".")
        date = F.array_join(F.slice(parts, 4, F.greatest(F.size(parts), F.lit(1))), " ")
    elif site == "padded":  # 0.9.0 (September 1, 2021)
        ver, date = F.substring_index(ver, " (", 1), F.regexp_extract(date, r" \((.*?)\)?$", 1)
        ver = F.regexp_replace(ver, r"\.[^.]*$", "")
    elif site == "notes":  # releases without a date are left out
        m = m.where(date.contains("("))
        date = F.regexp_extract(date, r"\(([^)]*)\)", 1)
    elif site == "table":  # cells of text; the month's first day
        tags = r"<[^>]*>"
        ver, date = F.trim(F.regexp_replace(ver, tags, "")), F.trim(F.regexp_replace(date, tags, ""))
        date = F.regexp_replace(date, r"^~+|~+$", "")
    out = m.select(repo, major_minor(ver).alias("version") if site not in ("padded", "table") else ver.alias("version"),
                   _parsed_date(date, formats, otherwise).alias("released_at"))
    return out.where(F.col("released_at").isNotNull())


def releases_from_names(releases: DataFrame, repo: str = "repo", name: str = "name",
                        published: str = "published_at") -> DataFrame:
    """P9, sixth site: (repo, version, released_at) from release names.  A name
    ``[1.2.3] - 2021-01-05`` holds its date, else the publication date counts;
    the version loses its last part; names without a version are left out; the
    latest date of each version.  A name whose date is none (month 13) counts by its publication."""
    n = F.regexp_replace(F.col(name), "^" + RELEASE_NAME_PREFIXES[0], "")
    dated, plain = n.rlike(DATED_NAME), F.regexp_extract(n, PLAIN_NAME, 0)
    first = F.regexp_replace(F.substring_index(n, " - ", 1), r"[\[\]]", "")
    ver = F.when(dated, first).when(plain != "", plain)
    ver = F.regexp_replace(F.regexp_replace(ver, r"\.[^.]*$", ""), "^" + RELEASE_NAME_PREFIXES[1], "")
    date = F.when(dated, F.try_element_at(F.split(n, " - ", -1), F.lit(2))).otherwise(F.col(published).cast("string"))
    got = releases.select(repo, ver.alias("version"), F.coalesce(
        F.try_to_date(F.substring(date, 1, 10)), F.try_to_date(F.substring(F.col(published).cast("string"), 1, 10))).alias("d"))
    return got.where(F.col("version").isNotNull()).groupBy(repo, "version").agg(F.max("d").alias("released_at"))


def version_cutoffs(releases: DataFrame) -> DataFrame:
    """The latest release date of each major.minor version."""
    return releases.groupBy("repo", major_minor(F.col("version")).alias("version")).agg(
        F.max("released_at").alias("released_at"))


def asof_version(tasks: DataFrame, releases: DataFrame, ts: str = "created_at",
                 policy: str = "null") -> DataFrame:
    """``version`` = the release with the latest date strictly before the
    task's date (same repository); equal dates pick the larger version.  With no
    earlier release: NULL (``policy='null'``) or the oldest release
    (``policy='oldest'``).

    The answer depends on (repository, date) alone: distinct pairs and releases
    meet in one window per repository (at most a row for each day and release),
    and the tasks join the answers by equality."""
    t = tasks.withColumn("_d", F.to_date(F.col(ts)))
    r = releases.groupBy("repo", F.col("released_at").cast("date").alias("_d")).agg(F.max("version").alias("_v"))
    days = t.select("repo", "_d").distinct()
    # days sort before releases of the same date (strictly before)
    both = days.withColumn("_k", F.lit(0)).withColumn("_v", F.lit(None).cast("string")).unionByName(
        r.withColumn("_k", F.lit(1)))
    w = Window.partitionBy("repo").orderBy("_d", "_k").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("version", F.last("_v", ignorenulls=True).over(w)).where("_k = 0").select("repo", "_d", "version")
    out = t.join(found, (t["repo"] == found["repo"]) & t["_d"].eqNullSafe(found["_d"]), "left").drop(found["repo"]).drop(found["_d"])
    if policy == "oldest":
        oldest = releases.groupBy("repo").agg(
            F.min(F.struct(F.col("released_at").cast("date").alias("d"), F.col("version").alias("v")))
            .alias("_old"))
        out = out.join(oldest, "repo", "left").withColumn(
            "version", F.coalesce("version", F.col("_old.v"))).drop("_old")
    return out.drop("_d")


def group_by_version(df: DataFrame) -> DataFrame:
    """Instances per (repo, version)."""
    return df.groupBy("repo", "version").agg(F.count(F.lit(1)).alias("n_instances"))


def latest_per_group(df: DataFrame, keys, ts: str, key: str) -> DataFrame:
    """The newest row per group (ties: larger id) — one aggregate, no window."""
    keys = list(keys)
    return df.groupBy(*keys).agg(F.max_by(F.col(key), F.struct(ts, key)).alias(key),
                                 F.max(ts).alias(ts))
