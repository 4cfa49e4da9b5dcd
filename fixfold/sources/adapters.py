"""Stand-in inputs built from the driver tables.

The driver tables hold no patches, logs or pull requests, so each operator is
fed a view with the schema it expects, derived row-by-row from a driver table
(plain column expressions — no filtering, sampling or capping: every view
grows with its source table).  The operators never look at how a view was
made; they are general over any data of the same schema.  Each view has a
DuckDB twin in ``fixfold.plans.views_sql`` built from the same expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixfold.sources.tables import Tables

NL = "\n"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents dealt over tasks, more of them the larger the table: the test table
    is one row group, which a scan cannot split.  Only stand-ins do this; the readers leave a table as it is."""
    return Tables(spark, sf_dir).documents.repartition("doc_id")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1 attempts(instance_id, run_id, patch, resolved) from ``lineitem``."""
    li = Tables(spark, sf_dir).lineitem
    run_no = F.col("l_suppkey") % 12
    first = F.concat(F.lit("+"), F.col("l_returnflag"))
    patch = F.when(
        F.col("l_linenumber") % 5 == 0,
        F.concat(first, F.lit(NL), first, F.lit(NL), F.lit("-"), F.col("l_linestatus")),
    ).otherwise(F.concat(first, F.lit(NL), F.lit("-"), F.col("l_linestatus")))
    return li.select(
        F.col("l_orderkey").alias("instance_id"),
        F.concat(F.when(run_no >= 10, F.lit("django_r")).otherwise(F.lit("r")),
                 run_no.cast("string")).alias("run_id"),
        patch.alias("patch"),
        (F.col("l_returnflag") == "R").alias("resolved"),
    )


def dataset_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluated set: one instance per order."""
    return Tables(spark, sf_dir).orders.select(F.col("o_orderkey").alias("instance_id"))


def subset_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reported subset of the evaluated set: the urgent orders."""
    o = Tables(spark, sf_dir).orders
    return o.where(F.col("o_orderpriority") == "1-URGENT").select(
        F.col("o_orderkey").alias("instance_id"))


# --- grading inputs (V2, V3): one instance per events user -------------------

# Stand-in repositories, one per log dialect, chosen by user_id % 7.
DIALECT_REPOS = ("pytest-dev/pytest", "psf/requests", "django/django", "astropy/astropy",
                 "mwaskom/seaborn", "sympy/sympy", "matplotlib/matplotlib")


def _s(c):
    return c.cast("string")


def _repo_for(key_col):
    return F.element_at(F.array(*[F.lit(r) for r in DIALECT_REPOS]), (key_col % 7 + 1).cast("int"))


def _instance_for(key_col):
    return F.concat(F.replace(_repo_for(key_col), F.lit("/"), F.lit("__")), F.lit("-"), _s(key_col))


def _event_status():
    et = F.col("event_type")
    return (F.when(et.isin("view", "click"), F.lit("PASSED"))
            .when(et == "purchase", F.lit("XFAIL"))
            .when(et == "signup", F.lit("SKIPPED"))
            .when(F.col("event_id") % 2 == 0, F.lit("ERROR"))
            .otherwise(F.lit("FAILED")))


def _test_name(dialect, n, rendered: bool):
    t = F.concat(F.lit("tests/test_m.py::t"), _s(n))
    opt = (F.concat(t, F.lit("[/tmp/d"), _s(F.col("event_id") % 5), F.lit("/case"), _s(n % 3), F.lit(".txt]"))
           if rendered else F.concat(t, F.lit("[/case"), _s(n % 3), F.lit(".txt]")))
    mouse = (F.concat(t, F.when(F.col("event_id") % 2 == 0, F.lit("[MouseButton.LEFT]"))
                      .otherwise(F.lit("[MouseButton.RIGHT]")))
             if rendered else F.concat(t, F.lit("[1]")))
    return (F.when(dialect == 1, opt)
            .when(dialect == 2, F.concat(F.lit("test_t"), _s(n), F.lit(" (m.T)")))
            .when(dialect == 5, F.concat(F.lit("test_t"), _s(n)))
            .when(dialect == 6, mouse)
            .otherwise(t))


def status_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2 status(instance_id, line_no, test_case, status) from ``events``."""
    ev = Tables(spark, sf_dir).events
    d = F.col("user_id") % 7
    return ev.select(_instance_for(F.col("user_id")).alias("instance_id"),
                     F.col("event_id").alias("line_no"),
                     _test_name(d, F.col("event_id") % 13, False).alias("test_case"),
                     _event_status().alias("status"))


def expected_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected tests (instance_id, category, test_case) from ``events``; some
    names never appear in any log (absent → failure)."""
    ev = Tables(spark, sf_dir).events
    n = (F.col("event_id") + 5) % 14
    cat = (F.when(n % 5 == 0, F.lit("FAIL_TO_PASS"))
           .when(n % 5 <= 2, F.lit("PASS_TO_PASS"))
           .when(n % 5 == 3, F.lit("FAIL_TO_FAIL"))
           .otherwise(F.lit("PASS_TO_FAIL")))
    return ev.select(_instance_for(F.col("user_id")).alias("instance_id"), cat.alias("category"),
                     _test_name(F.col("user_id") % 7, n, False).alias("test_case")).distinct()


def _rendered_line():
    d = F.col("user_id") % 7
    n = F.col("event_id") % 13
    st = _event_status()
    t = _test_name(d, n, True)
    nl = F.lit("\n")
    plain = F.concat(st, F.lit(" "), t)
    pytest = F.concat(plain, F.when(st == "FAILED", F.lit(" - AssertionError: boom")).otherwise(F.lit("")))
    verbose_word = (F.when(st == "PASSED", F.when(F.col("event_id") % 4 == 0, F.lit("noise\nok"))
                           .otherwise(F.lit("ok")))
                    .when(st == "FAILED", F.lit("FAIL"))
                    .when(st == "ERROR", F.lit("ERROR"))
                    .when(st == "SKIPPED", F.lit("skipped 'why'"))
                    .otherwise(F.lit("expected failure")))
    verbose = F.concat(t, F.lit(" ... "), verbose_word)
    esc = F.lit("\u001b")
    ansi = F.when(F.col("event_id") % 2 == 0,
                  F.concat(esc, F.lit("[32m"), st, esc, F.lit("[0m "), t)) \
        .otherwise(F.concat(t, F.lit(" "), st))
    mixed = (F.when(st == "PASSED", F.concat(t, F.lit(" PASSED [ 50%]")))
             .when(st == "FAILED", F.concat(F.lit("FAILED "), t, F.lit(" - y")))
             .otherwise(plain))
    framed = (F.when(st == "FAILED", F.concat(F.lit("____ p/test_m.py:"), t, F.lit(" ____"), nl, t, F.lit(" F")))
              .when(st == "ERROR", F.concat(t, F.lit(" E")))
              .when(st == "PASSED", F.concat(t, F.lit(" ok"),
                                             F.when(F.col("event_id") % 3 == 0, F.lit(" [OK]")).otherwise(F.lit(""))))
              .otherwise(F.concat(t, F.lit(" s"))))
    return (F.when(d == 2, verbose).when(d == 3, ansi).when(d == 4, mixed)
            .when(d == 5, framed).when(d == 0, pytest).otherwise(plain))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3 logs(instance_id, repo, content): one log per events user — a line
    before the marker, the marker (a failure marker for every 11th user), then
    one rendered line per event in event order."""
    ev = Tables(spark, sf_dir).events
    lines = ev.select("user_id", "event_id", _rendered_line().alias("line"))
    body = lines.groupBy("user_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))),
                                 lambda x: x["line"]), "\n").alias("body"))
    header = F.when(F.col("user_id") % 11 == 0, F.lit(">>>>> Patch Apply Failed")) \
        .otherwise(F.lit(">>>>> Applied Patch (pred)"))
    return body.select(
        _instance_for(F.col("user_id")).alias("instance_id"),
        _repo_for(F.col("user_id")).alias("repo"),
        F.concat(F.lit("PASSED tests/pre.py::ignored\n"), header, F.lit("\n"), F.col("body"))
        .alias("content"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions (instance_id, model_name_or_path, model_patch): one per events
    user; every 9th has no patch, the next one an empty patch."""
    users = Tables(spark, sf_dir).events.select("user_id").distinct()
    u = F.col("user_id")
    patch = (F.when(u % 9 == 0, F.lit(None).cast("string"))
             .when(u % 9 == 1, F.lit(""))
             .otherwise(F.concat(F.lit("diff --git a/f"), _s(u), F.lit(".py b/f"), _s(u), F.lit(".py"))))
    return users.select(_instance_for(u).alias("instance_id"),
                        F.lit("m1").alias("model_name_or_path"), patch.alias("model_patch"))


def eval_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluated dataset: one instance per customer, with a gold patch."""
    c = Tables(spark, sf_dir).customer
    k = F.col("c_custkey")
    return c.select(_instance_for(k).alias("instance_id"), _repo_for(k).alias("repo"),
                    F.repeat(F.lit("@@ -1 +1 @@\n"), (F.col("c_nationkey") % 4 + 1).cast("int"))
                    .alias("patch"),
                    (F.col("c_mktsegment") == "BUILDING").alias("in_subset"))


# --- curation and diff inputs (V4, V6): one task per document ----------------

def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6 patches(doc_id, patch): every line of a document becomes a diff line
    (prefix by position: ' ', '+', '-'), six lines per hunk, hunks dealt over
    1–3 files; every 7th file is a new file.  Headers are consistent."""
    d = _documents(spark, sf_dir).select("doc_id", "text")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    nf = F.col("doc_id") % 3 + 1
    h = F.expr("i div 6")
    pre = F.when(F.col("i") % 3 == 0, F.lit(" ")).when(F.col("i") % 3 == 1, F.lit("+")).otherwise(F.lit("-"))
    lines = lines.select("doc_id", "i", "line", pre.alias("pre"),
                         (h % nf).alias("f"), F.floor(h / nf).alias("k"))
    start = _s(F.col("k") * 10 + 1)
    hunks = lines.groupBy("doc_id", "f", "k").agg(
        F.count_if(F.col("pre").isin(" ", "-")).alias("src_len"),
        F.count_if(F.col("pre").isin(" ", "+")).alias("tgt_len"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.concat("pre", "line").alias("l")))),
                                 lambda x: x["l"]), "\n").alias("body"))
    hunks = hunks.select("doc_id", "f", "k", F.concat(
        F.lit("@@ -"), start, F.lit(","), _s(F.col("src_len")), F.lit(" +"), start, F.lit(","),
        _s(F.col("tgt_len")), F.lit(" @@\n"), F.col("body")).alias("htext"))
    files = hunks.groupBy("doc_id", "f").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "htext"))),
                                 lambda x: x["htext"]), "\n").alias("body"))
    path = F.when((F.col("doc_id") + F.col("f")) % 2 == 0,
                  F.concat(F.lit("src/pkg/mod"), _s(F.col("f")), F.lit(".py"))) \
        .otherwise(F.concat(F.lit("tests/test_mod"), _s(F.col("f")), F.lit(".py")))
    files = files.select("doc_id", "f", path.alias("path"), "body")
    src = F.when((F.col("doc_id") + F.col("f")) % 7 == 0, F.lit("--- /dev/null")) \
        .otherwise(F.concat(F.lit("--- a/"), F.col("path")))
    ftext = F.concat(F.lit("diff --git a/"), F.col("path"), F.lit(" b/"), F.col("path"), F.lit("\n"),
                     src, F.lit("\n+++ b/"), F.col("path"), F.lit("\n"), F.col("body"))
    return files.select("doc_id", "f", ftext.alias("ftext")).groupBy("doc_id").agg(
        F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "ftext"))),
                                          lambda x: x["ftext"]), "\n"), F.lit("\n")).alias("patch"))


def _doc_repo():
    return F.concat(F.col("source"), F.lit("/"), F.col("lang"))


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4 task instances: one per document.  The statement is the whole text
    plus an issue marker chosen by doc_id % 4; the test patch is one of five
    shapes by doc_id % 5; the patch is V6."""
    d = _documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    k = _s(F.col("doc_id") % 50)
    m = F.col("doc_id") % 4
    marker = (F.when(m == 0, F.concat(F.lit(" fixes #"), k))
              .when(m == 1, F.concat(F.lit(" Closes #"), k, F.lit(" <!-- closes #9 -->")))
              .when(m == 2, F.lit(" see http://x/y.png"))
              .otherwise(F.concat(F.lit(" see #"), k)))
    t5 = F.col("doc_id") % 5
    test_patch = (F.when(t5 == 0, F.lit(""))
                  .when(t5 == 1, F.lit('+    with pytest.raises(ValueError, match="bad"):'))
                  .when(t5 == 2, F.lit("+        self.assertRaises(KeyError)"))
                  .when(t5 == 3, F.lit("+    with pytest.raises(ValueError):"))
                  .otherwise(F.lit("+def test_ok():\n+    assert f() == 1")))
    repo = _doc_repo()
    base = d.select(
        F.concat(F.replace(repo, F.lit("/"), F.lit("__")), F.lit("-"), _s(F.col("doc_id"))).alias("instance_id"),
        repo.alias("repo"), F.col("doc_id").alias("pull_number"),
        F.concat(F.col("text"), marker).alias("problem_statement"),
        test_patch.alias("test_patch"),
        (F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
         + F.make_dt_interval(hours=F.col("doc_id"))).alias("created_at"),
        F.col("doc_id"))
    return base.join(patches(spark, sf_dir), "doc_id").drop("doc_id")


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known issues (repo, number): every document is an issue of its repo."""
    d = _documents(spark, sf_dir)
    return d.select(_doc_repo().alias("repo"), F.col("doc_id").alias("number"))


# --- collection inputs (V4 pulls, feeds; V5 releases and tasks) --------------

def _hours_from_2020(n):
    return F.lit("2020-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=n)


def pulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pull requests, one per document: title = first line, body = whole text
    plus a closing reference to the document's own number (doc_id % 3), every
    5th unmerged."""
    d = _documents(spark, sf_dir)
    n = F.col("doc_id")
    ref = (F.when(n % 3 == 0, F.concat(F.lit(" fixes #"), _s(n)))
           .when(n % 3 == 1, F.concat(F.lit(" Closes #"), _s(n), F.lit(" <!-- closes #9 -->")))
           .otherwise(F.lit("")))
    created = _hours_from_2020(n)
    src = F.concat(F.lit("src/"), F.col("source"), F.lit(".py"))
    return d.select(
        _doc_repo().alias("repo"), n.alias("number"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.concat(F.col("text"), ref).alias("body"),
        created.alias("created_at"),
        F.when(n % 5 == 0, F.lit(None).cast("timestamp_ntz"))
        .otherwise(created + F.make_dt_interval(days=F.lit(1))).alias("merged_at"),
        F.md5("text").alias("base_commit"),
        F.when(n % 3 == 0, F.lit(None).cast("string")).otherwise(F.md5(F.col("lang")))
        .alias("environment_setup_commit"),
        F.concat(F.lit("--- a/"), src, F.lit("\n+++ b/"), src, F.lit("\n@@ -1 +1 @@\n-a\n+b\n")).alias("patch"),
        F.when(n % 4 == 0, F.lit("")).otherwise(F.lit("+def test_x(): pass")).alias("test_patch"))


def _conv_with_repo(spark, sf_dir, role):
    t = Tables(spark, sf_dir)
    c = t.conversations.where(F.col("role") == role)
    d = t.documents.select(F.col("doc_id").alias("conv_id"), _doc_repo().alias("repo"))
    return c.join(d, "conv_id")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits of a pull: the assistant turns of the conversation with the same id."""
    c = _conv_with_repo(spark, sf_dir, "assistant")
    ref = (F.when(F.col("turn") % 4 == 1, F.concat(F.lit(" resolves #"), _s(F.col("conv_id"))))
           .when(F.col("turn") % 4 == 3, F.concat(F.lit(" fixes #"), _s(F.col("conv_id") + 1)))
           .otherwise(F.lit("")))
    return c.select("repo", F.col("conv_id").alias("number"), F.col("turn").alias("pos"),
                    F.concat(F.col("text"), ref).alias("message"),
                    (_hours_from_2020(F.col("conv_id")) + F.make_dt_interval(mins=F.col("turn") * 10))
                    .alias("author_date"))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue comments: the user turns of the conversation with the issue's id."""
    c = _conv_with_repo(spark, sf_dir, "user")
    return c.select("repo", F.col("conv_id").alias("issue_number"), F.col("turn").alias("pos"),
                    F.col("text").alias("body"),
                    (_hours_from_2020(F.col("conv_id")) + F.make_dt_interval(mins=(F.col("turn") * 7) % 20))
                    .alias("updated_at"))


def issue_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues (repo, number, title, body): every document."""
    d = _documents(spark, sf_dir)
    return d.select(_doc_repo().alias("repo"), F.col("doc_id").alias("number"),
                    F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"))


def changelog_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5 changelog pages (repo, html): one page per order priority with two
    anchors per (year, month, day-of-month tenth) release of its orders."""
    o = Tables(spark, sf_dir).orders
    d = F.col("o_orderdate")
    g = o.groupBy(F.col("o_orderpriority").alias("repo"), F.year(d).alias("y"), F.month(d).alias("m"),
                  F.floor(F.dayofmonth(d) / 10).alias("t")).agg(F.max(d).alias("last"))
    ver = F.concat_ws(".", _s(F.col("y")), _s(F.col("m")), _s(F.col("t")))
    anchor = F.concat(F.lit('<a class="reference internal nav-link" href="#version-'),
                      F.replace(ver, F.lit("."), F.lit("-")), F.lit('">Version '), ver, F.lit(" ("),
                      F.date_format("last", "yyyy-MM-dd"), F.lit(")</a>"))
    g = g.select("repo", "y", "m", "t", F.concat(anchor, F.lit("\n"), anchor).alias("a"))
    return g.groupBy("repo").agg(F.concat(
        F.lit("<html><body>\n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "m", "t", "a"))),
                                 lambda x: x["a"]), "\n"),
        F.lit("\n</body></html>")).alias("html"))


def _month_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, y, m, day): one release a month and order priority, on its last order's day."""
    o = Tables(spark, sf_dir).orders
    d = F.col("o_orderdate")
    return o.groupBy(F.col("o_orderpriority").alias("repo"), F.year(d).alias("y"), F.month(d).alias("m")).agg(
        F.max(d).cast("date").alias("day"))


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release pages (site, repo, html) in the markup of five sites; each entry stands there twice."""
    g = _month_releases(spark, sf_dir)
    ver = F.concat_ws(".", _s(F.col("y")), _s(F.col("m")), F.lit("0"))
    date = lambda f: F.date_format("day", f)
    nav = '<a class="reference internal nav-link" href="#'
    entry = {
        "anchors": F.concat(F.lit(nav + "version-x\">Version "), ver, F.lit(" ("), date("d MMMM yyyy"), F.lit(")</a>")),
        "dashed": F.concat(F.lit('<a class="reference internal nav-link active" href="#v'), F.replace(ver, F.lit("."), F.lit("-")),
                           F.lit("-"), F.lower(date("MMMM-d-yyyy")), F.lit('">v'), ver, F.lit(" ("), date("MMMM d, yyyy"), F.lit(")</a>")),
        "padded": F.concat(F.lit(nav + "v\">\n   v"), ver, F.lit(" ("), date("MMMM d, yyyy"), F.lit(")\n  </a>")),
        "notes": F.concat(F.lit('<a class="reference internal" href="prev_whats_new/whats_new_'), ver,
                          F.lit(".html\">What's new in Matplotlib "), ver, F.lit(" ("), date("MMM d, yyyy"), F.lit(")</a>")),
        "table": F.concat(F.lit("<tr class=\"row\"><td><p>"), ver, F.lit("</p></td>\n<td><p>~"), date("MMMM yyyy"),
                          F.lit("</p></td>\n<td><p>3.8, 3.9</p></td></tr>")),
    }
    out = None
    for site, e in entry.items():
        x = g.select(F.lit(site).alias("site"), "repo", F.struct("y", "m", F.concat(e, F.lit("\n"), e).alias("e")).alias("x"))
        out = x if out is None else out.unionByName(x)
    return out.groupBy("site", "repo").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list("x")), lambda v: v["e"]), "\n").alias("html"))


def release_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release names (repo, name, published_at): every other one holds its date itself."""
    g = _month_releases(spark, sf_dir)
    ver = F.concat_ws(".", _s(F.col("y") % 10), _s(F.col("m") % 10), F.lit("3"))
    dated = F.concat(F.lit("["), ver, F.lit("] - "), F.date_format("day", "yyyy-MM-dd"))
    return g.select("repo", F.when(F.col("m") % 2 == 0, dated).otherwise(F.concat(F.lit("SQLFluff "), ver)).alias("name"),
                    F.date_format("day", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"))


def release_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5 tasks: line items with their order's priority as repository and the
    ship date as creation time."""
    t = Tables(spark, sf_dir)
    o = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("repo"))
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.concat_ws("-", _s(F.col("l_orderkey")), _s(F.col("l_linenumber")), _s(F.col("l_partkey")),
                    _s(F.col("l_suppkey"))).alias("task_id"),
        "repo", F.col("l_shipdate").alias("created_at"))


def version_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files with version lines (instance_id, repo, file_pos, text): the
    document text plus a version assignment of one of four shapes."""
    d = _documents(spark, sf_dir)
    n = F.col("doc_id")
    tail = (F.when(n % 4 == 0, F.concat(F.lit('\n__version__ = "'), _s(n % 7), F.lit("."), _s(n % 11),
                                        F.lit("."), _s(n), F.lit('"')))
            .when(n % 4 == 1, F.concat(F.lit("\nVERSION = ("), _s(n % 5), F.lit(", "), _s(n % 9), F.lit(", 0)")))
            .when(n % 4 == 2, F.lit('\n"""\n__version__ = "9.9.9"\n"""'))
            .otherwise(F.lit("")))
    repo = _doc_repo()
    return d.select(F.concat(F.replace(repo, F.lit("/"), F.lit("__")), F.lit("-"), _s(n)).alias("instance_id"),
                    repo.alias("repo"), F.lit(0).alias("file_pos"), F.concat("text", tail).alias("text"))


def tracker_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracker timestamps (event_id, stamp) rendered from event times in the two
    tracker formats, a third with the "See timeline at" prefix."""
    e = Tables(spark, sf_dir).events
    f1 = F.date_format("ts", "MM/dd/yy HH:mm:ss")
    f2 = F.date_format("ts", "MMM d, yyyy, h:mm:ss a")
    k = F.col("event_id") % 3
    return e.select("event_id", F.when(k == 0, F.concat(F.lit("See timeline at "), f1))
                    .when(k == 1, f2).otherwise(f1).alias("stamp"))


# --- retrieval inputs (V7) -----------------------------------------------------

CORPORA = ("de", "en", "es", "fr")


def corpus_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7 corpus (corpus, docid, contents): documents grouped by language; every
    50th document is a README."""
    d = Tables(spark, sf_dir).documents  # not dealt anew: the index deals the texts itself
    n = F.col("doc_id")
    docid = F.when(n % 50 == 0, F.concat(F.col("source"), F.lit("/README_"), _s(n), F.lit(".md"))) \
        .otherwise(F.concat(F.col("source"), F.lit("/mod_"), _s(n), F.lit(".py")))
    return d.select(F.col("lang").alias("corpus"), docid.alias("docid"), F.col("text").alias("contents"))


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7 queries (qid, corpus, query): every benchmark item searches one
    language corpus; every 9th names a corpus that has no index."""
    b = Tables(spark, sf_dir).benchmark
    i = F.col("item_id")
    corpus = F.when(i % 9 == 0, F.lit("none")).otherwise(
        F.element_at(F.array(*[F.lit(c) for c in CORPORA]), (i % 4 + 1).cast("int")))
    return b.select(i.alias("qid"), corpus.alias("corpus"), F.col("text").alias("query"))


# --- code inputs (V8): documents rendered as small Python modules ------------

def _code_line():
    """One Python line per document line, by position in a 12-line cycle:
    class, docstring, method, body, return, method, return, constant,
    function, body, return, import."""
    i = F.col("i")
    k = i % 12
    n = _s(F.length("line"))
    clean = F.regexp_replace(F.col("line"), r"[^\p{L} ]", "")
    return (F.when(k == 0, F.concat(F.lit("class C"), _s(i), F.lit(":")))
            .when(k == 1, F.concat(F.lit('    """'), clean, F.lit('"""')))
            .when(k == 2, F.concat(F.lit("    def m"), _s(i), F.lit("(self):")))
            .when(k == 3, F.concat(F.lit("        x = "), n))
            .when(k == 4, F.lit("        return x"))
            .when(k == 5, F.concat(F.lit("    def m"), _s(i), F.lit("(self):")))
            .when(k == 6, F.concat(F.lit("        return "), n))
            .when(k == 7, F.concat(F.lit("V"), _s(i), F.lit(" = "), n))
            .when(k == 8, F.concat(F.lit("def f"), _s(i), F.lit("():")))
            .when(k == 9, F.concat(F.lit("    y = "), n))
            .when(k == 10, F.lit("    return y"))
            .otherwise(F.concat(F.lit("from pkg"), _s(F.floor(i / 12) % 5), F.lit(" import mod"))))


def _code_path():
    n = F.col("doc_id")
    k = _s(n % 5)
    return (F.when(n % 50 == 0, F.concat(F.lit("docs/README_"), _s(n), F.lit(".md")))
            .when(n % 7 == 0, F.concat(F.lit("pkg"), k, F.lit("/tests/test_"), _s(n), F.lit(".py")))
            .otherwise(F.concat(F.lit("pkg"), k, F.lit("/mod_"), _s(n), F.lit(".py"))))


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instance_id, repo, path, line_no, text): every line of every module."""
    d = _documents(spark, sf_dir)
    inst = F.concat(F.replace(_doc_repo(), F.lit("/"), F.lit("__")), F.lit("-"), _s(F.col("doc_id")))
    base = d.select(inst.alias("instance_id"), _doc_repo().alias("repo"), _code_path().alias("path"),
                    F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    return base.select("instance_id", "repo", "path", (F.col("i") + 1).alias("line_no"),
                       _code_line().alias("text"))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instance_id, repo, path, text): one module per document."""
    lines = code_lines(spark, sf_dir)
    return lines.groupBy("instance_id", "repo", "path").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"))


def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(instance_id, path, kind, cls, name, start, end): the classes, methods and
    functions of each module with their line spans (what a repository
    structure dump lists)."""
    d = _documents(spark, sf_dir)
    inst = F.concat(F.replace(_doc_repo(), F.lit("/"), F.lit("__")), F.lit("-"), _s(F.col("doc_id")))
    n = F.size(F.split("text", "\n", -1))
    base = d.select(inst.alias("instance_id"), _code_path().alias("path"), n.alias("n"),
                    F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    i, k = F.col("i"), F.col("i") % 12
    kind = (F.when(k == 0, F.lit("class")).when(k.isin(2, 5), F.lit("method")).when(k == 8, F.lit("function")))
    name = (F.when(k == 0, F.concat(F.lit("C"), _s(i))).when(k.isin(2, 5), F.concat(F.lit("m"), _s(i)))
            .when(k == 8, F.concat(F.lit("f"), _s(i))))
    cls = F.when(k.isin(2, 5), F.concat(F.lit("C"), _s(i - k)))
    span = F.when(k == 0, 6).when(k == 2, 2).when(k == 5, 1).otherwise(2)
    return base.where(kind.isNotNull()).select(
        "instance_id", "path", kind.alias("kind"), cls.alias("cls"), name.alias("name"),
        (i + 1).alias("start"), F.least(i + 1 + span, F.col("n")).alias("end"))


def locate_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Located-symbol answers (instance_id, answer): a non-Python location first,
    then for each cycle of twelve lines of the module a function, a class with one method, a
    constant and a whole class."""
    d = _documents(spark, sf_dir)
    inst = F.concat(F.replace(_doc_repo(), F.lit("/"), F.lit("__")), F.lit("-"), _s(F.col("doc_id")))
    p = _code_path()

    def block(k):
        c = k * 12
        return F.concat(F.lit("# "), p, F.lit("\nfunction: f"), _s(c + 8), F.lit("\n\n\n# "), p,
                        F.lit("\nclass: C"), _s(c), F.lit("\nmethod: m"), _s(c + 2), F.lit("\n\n\n# "), p,
                        F.lit("\nvariable: V"), _s(c + 7), F.lit("\n\n\n# "), p, F.lit("\nclass: C"), _s(c + 12))

    body = F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size(F.split("text", "\n", -1)) + 11) / 12).cast("int") - 1), block), "\n\n\n")
    return d.select(inst.alias("instance_id"),
                    F.concat(F.lit("Here:\n```\n# docs/README.md\nfunction: x\n\n\n"), body, F.lit("\n```\n"))
                    .alias("answer"))


def edit_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search/replace answers (instance_id, attempt, answer): two attempts per
    module.  For each cycle of twelve lines of the module a block renames the
    class line, and one changes the return line where the cycle has it; the
    first attempt searches an absent line in every third block.  Each answer also holds an
    edit of an unknown file and a blank search."""
    d = _documents(spark, sf_dir)
    inst = F.concat(F.replace(_doc_repo(), F.lit("/"), F.lit("__")), F.lit("-"), _s(F.col("doc_id")))
    base = d.select(inst.alias("instance_id"), _code_path().alias("p"), "doc_id", F.split("text", "\n", -1).alias("_l"))
    lengths = lambda k: F.transform(F.filter("_l", lambda x, i: i % 12 == k), lambda x: F.length(x))
    base = base.select("instance_id", "p", "doc_id", lengths(0).alias("c"), lengths(6).alias("r"))

    def block(search, repl):
        return F.concat(F.lit("```python\n### "), F.col("p"), F.lit("\n<<<<<<< SEARCH\n"), search, F.lit("\n=======\n"), repl,
                        F.lit("\n>>>>>>> REPLACE\n```\n"))

    def answer(attempt, mark):
        def searched(k, line):
            return F.when((F.col("doc_id") + k) % 3 == 0, F.lit("        not present")).otherwise(line) if attempt == 0 else line

        name = lambda k: F.concat(F.lit("class C"), _s(12 * k))
        back = lambda n: F.concat(F.lit("        return "), _s(n))
        classes = F.transform("c", lambda n, k: block(searched(k, F.concat(name(k), F.lit(":"))),
                                                      F.concat(name(k), F.lit("(B):  # "), _s(n), F.lit(mark))))
        returns = F.transform("r", lambda n, k: block(searched(k + 1, back(n)), F.concat(back(n), F.lit(mark))))
        return base.select("instance_id", F.lit(attempt).alias("attempt"), F.concat(
            F.lit("I will edit.\n"), F.array_join(F.concat(classes, returns), ""),
            F.lit("```python\n### other.py\n<<<<<<< SEARCH\nx\n=======\ny\n>>>>>>> REPLACE\n```\n"),
            block(F.lit("   "), F.lit("z"))).alias("answer"))

    return answer(0, " + 1").unionByName(answer(1, " * 2"))
