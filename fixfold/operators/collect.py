"""Pull requests → task instances.

Each pull's text work (issue references, statement assembly) is row-local:
higher-order functions over the arrays of one row, so nothing shuffles.  The
few per-pull gatherings (commit messages, resolved issues, comments) are
bounded by one pull's own feed, never by the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixfold.functions.criteria import ISSUE_KEYWORDS, WORD
from fixfold.functions.text import PY_WS, col_

COMMENT_BLOCK = r"(?s)<!--.*?-->"
REF_PAIR = rf"({WORD}+){PY_WS}+#(\d+)"
# tried only at word starts: the same matches, without retrying inside each word
REF_PAIR_AT_WORD = rf"(?<!{WORD}){REF_PAIR}"


def instance_id(repo, number) -> Column:
    """``owner__repo-number``."""
    return F.replace(F.concat_ws("-", col_(repo), col_(number).cast("string")), F.lit("/"), F.lit("__"))


def _ordered_join(struct_col: Column, field: str, sep: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(struct_col)), lambda x: x[field]), sep)


def reference_text(pulls: DataFrame, commits: DataFrame, keys=("repo", "number")) -> DataFrame:
    """Title, body and the pull's commit messages (feed order), newline-joined."""
    keys = list(keys)
    msgs = commits.groupBy(*keys).agg(
        _ordered_join(F.struct("pos", "message"), "message", "\n").alias("commit_text"))
    j = pulls.join(msgs, keys, "left")
    text = F.concat_ws("\n", F.coalesce(F.col("title"), F.lit("")), F.coalesce(F.col("body"), F.lit("")),
                       F.coalesce(F.col("commit_text"), F.lit("")))
    return j.select(*pulls.columns, text.alias("ref_text"))


def issue_refs(text, per_word: bool = True) -> Column:
    """Issue numbers that a closing keyword points at, comments removed.

    ``per_word`` keeps one number per distinct word spelling — the last one —
    in order of the word's first appearance ("fixes #1, fixes #2" → [2]);
    otherwise every keyword reference is kept in text order."""
    t = F.regexp_replace(col_(text), COMMENT_BLOCK, "")
    # one walk over the text; word and number are taken from the short matches
    pairs = F.transform(F.regexp_extract_all(t, F.lit(REF_PAIR_AT_WORD), 0), lambda m: F.struct(
        F.regexp_extract(m, f"^{WORD}+", 0).alias("w"), F.substring_index(m, "#", -1).alias("n")))
    refs = F.filter(pairs, lambda p: F.lower(p["w"]).isin(*ISSUE_KEYWORDS))
    if not per_word:
        return F.transform(refs, lambda p: p["n"])
    # bound as the only element of an array, or the text would be walked again for every word
    return F.transform(F.array(refs), lambda r: F.transform(
        F.array_distinct(F.transform(r, lambda p: p["w"])),
        lambda w: F.element_at(F.filter(r, lambda p: p["w"] == w), -1)["n"]))[0]


def resolved_issues(pulls: DataFrame, commits: DataFrame, keys=("repo", "number"),
                    per_word: bool = True) -> DataFrame:
    """P3 on a pulls table: adds ``resolved_issues array<string>``."""
    t = reference_text(pulls, commits, keys)
    return t.withColumn("resolved_issues", issue_refs(F.col("ref_text"), per_word)).drop("ref_text")


def problem_statements(pulls: DataFrame, issues: DataFrame) -> DataFrame:
    """``title\\nbody\\n`` of every resolved issue that exists, in reference
    order; NULL title/body become empty.  (repo, number, problem_statement)."""
    refs = pulls.select("repo", "number", F.posexplode("resolved_issues").alias("ref_pos", "issue"))
    iss = issues.select("repo", F.col("number").cast("string").alias("issue"), "title", "body")
    j = refs.join(iss, ["repo", "issue"], "inner")
    part = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit("")), F.lit("\n"))
    st = j.groupBy("repo", "number").agg(
        _ordered_join(F.struct("ref_pos", part.alias("p")), "p", "").alias("problem_statement"))
    return pulls.select("repo", "number").join(st, ["repo", "number"], "left").select(
        "repo", "number", F.coalesce("problem_statement", F.lit("")).alias("problem_statement"))


def hints_before(pulls: DataFrame, commits: DataFrame, comments: DataFrame, issues: DataFrame,
                 prefix: bool = True) -> DataFrame:
    """Per pull, for each resolved issue that exists (reference order), the
    issue's comments written before the pull's first commit — the first one in
    feed order.  ``prefix`` stops at the first comment at or after that time
    (feed order); otherwise it is a plain filter.  A pull without commits gives
    each issue an empty text.  Comments of one issue join with newlines, and the
    per-issue texts join with newlines too."""
    first = commits.groupBy("repo", "number").agg(F.min_by("author_date", "pos").alias("t0"))
    refs = pulls.select("repo", "number", F.posexplode("resolved_issues").alias("ref_pos", "issue"))
    known = issues.select("repo", F.col("number").cast("string").alias("issue")).distinct()
    refs = refs.join(known, ["repo", "issue"], "left_semi")
    com = comments.select("repo", F.col("issue_number").cast("string").alias("issue"),
                          F.col("pos").alias("c_pos"), "body", "updated_at")
    j = refs.join(first, ["repo", "number"], "inner").join(com, ["repo", "issue"], "inner")
    late = F.col("updated_at") >= F.col("t0")
    if prefix:
        stop = j.groupBy("repo", "number", "ref_pos").agg(
            F.min(F.when(late, F.col("c_pos"))).alias("stop_pos"))
        j = j.join(stop, ["repo", "number", "ref_pos"]).where(
            F.col("stop_pos").isNull() | (F.col("c_pos") < F.col("stop_pos")))
    else:
        j = j.where(~late)
    texts = j.groupBy("repo", "number", "ref_pos").agg(
        _ordered_join(F.struct("c_pos", "body"), "body", "\n").alias("h"))
    per_issue = refs.join(texts, ["repo", "number", "ref_pos"], "left") \
        .withColumn("h", F.coalesce("h", F.lit("")))
    per_pull = per_issue.groupBy("repo", "number").agg(
        _ordered_join(F.struct("ref_pos", "h"), "h", "\n").alias("hints_text"))
    return pulls.select("repo", "number").join(per_pull, ["repo", "number"], "left") \
        .select("repo", "number", F.coalesce("hints_text", F.lit("")).alias("hints_text"))


def bounded_feed(pulls: DataFrame, max_pulls: int | None = None, cutoff=None,
                 inclusive: bool = False) -> DataFrame:
    """The prefix of each repository's newest-first feed that a paging
    crawl keeps: at most ``max_pulls`` rows (``inclusive`` reproduces the one
    extra row), and nothing past the first pull older than ``cutoff`` (that
    pull kept).

    The cutoff stop is an aggregate (the newest pull older than the cutoff per
    repository) joined back; the count cap is a row_number filter that Spark
    turns into a per-partition group limit before the shuffle."""
    df = pulls
    if cutoff is not None:
        cut = F.lit(cutoff).cast("timestamp_ntz")
        stop = pulls.where(F.col("created_at") < cut).groupBy("repo").agg(
            F.max(F.struct("created_at", "number")).alias("stop"))
        df = df.join(stop, "repo", "left").where(
            F.col("stop").isNull() | (F.struct("created_at", "number") >= F.col("stop"))).drop("stop")
    if max_pulls is not None:
        n = max_pulls + 1 if inclusive else max_pulls
        w = Window.partitionBy("repo").orderBy(F.desc("created_at"), F.desc("number"))
        df = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
    return df


def make_instances(pulls: DataFrame, statements: DataFrame, hints: DataFrame) -> DataFrame:
    """Instance rows for valid pulls: id, repo, pull number, issue numbers,
    base commit, patch, test patch, problem statement, hints, created time."""
    from fixfold.functions.criteria import valid_pull

    base = pulls.where(valid_pull())
    return (base.join(statements, ["repo", "number"], "left")
            .join(hints, ["repo", "number"], "left")
            .select(instance_id(F.col("repo"), F.col("number")).alias("instance_id"),
                    "repo", F.col("number").alias("pull_number"),
                    F.col("resolved_issues").alias("issue_numbers"),
                    "base_commit", "patch", "test_patch",
                    F.coalesce("problem_statement", F.lit("")).alias("problem_statement"),
                    F.coalesce("hints_text", F.lit("")).alias("hints_text"),
                    "created_at"))


def parse_issue_url(url) -> list[Column]:
    """Owner, repo and issue number of a forge issue URL; a URL without
    that shape is an error."""
    pat = r"github\.com/(.+?)/(.+?)/issues/(\d+)"
    u = col_(url)
    ok = u.rlike(pat)

    def part(i, name):
        return F.when(ok, F.regexp_extract(u, pat, i)).otherwise(
            F.raise_error(F.concat(F.lit("not an issue url: "), u))).alias(name)

    return [part(1, "owner"), part(2, "repo_name"), part(3, "issue_number")]


def issue_text(issues: DataFrame, comments: DataFrame | None = None) -> DataFrame:
    """``title\nbody`` of each issue; with comments, a newline and
    ``Comment: c1\nComment:c2…`` (nothing after the newline when an issue has
    no comments).  (repo, number, text)."""
    base = issues.select("repo", "number", F.concat_ws("\n", F.coalesce("title", F.lit("")),
                                                       F.coalesce("body", F.lit(""))).alias("text"))
    if comments is None:
        return base
    c = comments.groupBy("repo", F.col("issue_number").alias("number")).agg(
        _ordered_join(F.struct("pos", "body"), "body", "\nComment:").alias("ctext"))
    return base.join(c, ["repo", "number"], "left").select(
        "repo", "number",
        F.concat(F.col("text"), F.lit("\n"),
                 F.when(F.col("ctext").isNotNull(), F.concat(F.lit("Comment: "), F.col("ctext")))
                 .otherwise(F.lit(""))).alias("text"))
