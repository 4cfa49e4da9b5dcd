"""Registered queries for collection and versioning, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixfold.functions import criteria as C
from fixfold.functions.harness import effective_commit
from fixfold.functions.text import PY_WS
from fixfold.operators import collect as CO
from fixfold.operators import ordering as OR
from fixfold.operators import versions as VE
from fixfold.operators.curate import funnel
from fixfold.plans.views_sql import VIEWS, with_views
from fixfold.sources import adapters as A
from fixfold.streaming.jobs import scratch

QUERIES = {}
ORACLE = {}


def _pulls_ri(spark, sf, per_word=True):
    return CO.resolved_issues(A.pulls(spark, sf), A.commits(spark, sf), per_word=per_word)


def _pulls_written(spark, sf):
    """Written without its texts, as plans read it several times."""
    path = scratch(spark, "pulls")
    _pulls_ri(spark, sf).drop("title", "body").write.parquet(path)
    return spark.read.parquet(path)


def _releases(spark, sf):
    return VE.extract_releases(A.changelog_pages(spark, sf))


def _versioned(spark, sf, policy="null"):
    return VE.asof_version(A.release_tasks(spark, sf), _releases(spark, sf), policy=policy)


def _made(spark, sf, p=None):
    p = _pulls_written(spark, sf) if p is None else p
    iss = A.issue_texts(spark, sf)
    return CO.make_instances(p, CO.problem_statements(p, iss),
                             CO.hints_before(p, A.commits(spark, sf), A.comments(spark, sf), iss))


def q_resolved_issues(spark, sf):
    return _pulls_ri(spark, sf).select("repo", "number",
                                       F.array_join("resolved_issues", ",").alias("issues"))


def q_resolved_issues_all(spark, sf):
    return _pulls_ri(spark, sf, per_word=False).select(
        "repo", "number", F.array_join("resolved_issues", ",").alias("issues"))


def q_valid_pulls(spark, sf):
    return _pulls_ri(spark, sf).where(C.valid_pull()).select("repo", "number")


def q_problem_statements(spark, sf):
    return CO.problem_statements(_pulls_written(spark, sf), A.issue_texts(spark, sf))


def q_hints_before(spark, sf):
    p = _pulls_written(spark, sf)
    return CO.hints_before(p, A.commits(spark, sf), A.comments(spark, sf), A.issue_texts(spark, sf))


def q_hints_filter(spark, sf):
    p = _pulls_written(spark, sf)
    return CO.hints_before(p, A.commits(spark, sf), A.comments(spark, sf), A.issue_texts(spark, sf),
                           prefix=False)


def q_make_instances(spark, sf):
    m = _made(spark, sf)
    return m.select("instance_id", "repo", "pull_number", F.array_join("issue_numbers", ",").alias("issue_numbers"),
                    "base_commit", "problem_statement", "hints_text",
                    F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


def q_funnel(spark, sf):
    p = _pulls_written(spark, sf)
    return funnel(p.withColumn("instance_id", CO.instance_id(F.col("repo"), F.col("number"))), _made(spark, sf, p))


def q_effective_commit(spark, sf):
    p = A.pulls(spark, sf)
    return p.select("repo", "number", effective_commit().alias("commit"))


def q_bounded_feed(spark, sf):
    return CO.bounded_feed(A.pulls(spark, sf), max_pulls=5, cutoff="2020-01-20 00:00:00").select("repo", "number")


def q_bounded_feed_inclusive(spark, sf):
    return CO.bounded_feed(A.pulls(spark, sf), max_pulls=5, inclusive=True).select("repo", "number")


def q_releases_from_pages(spark, sf):
    return _releases(spark, sf)


def q_releases_by_site(spark, sf):
    """All six sites' markup of the same releases, each read by its own rule."""
    pages = A.site_pages(spark, sf)
    out = None
    for site in VE.SITES:
        r = VE.extract_releases(pages.where(F.col("site") == site), site=site).withColumn("site", F.lit(site))
        out = r if out is None else out.unionByName(r)
    names = VE.releases_from_names(A.release_names(spark, sf)).withColumn("site", F.lit("names"))
    return out.unionByName(names).select("site", "repo", "version", "released_at")


def q_version_cutoffs(spark, sf):
    return VE.version_cutoffs(_releases(spark, sf))


def q_asof_version(spark, sf):
    return _versioned(spark, sf).select("task_id", "repo", "version")


def q_asof_version_oldest(spark, sf):
    return _versioned(spark, sf, "oldest").select("task_id", "repo", "version")


def q_group_by_version(spark, sf):
    return VE.group_by_version(_versioned(spark, sf))


def q_latest_per_group(spark, sf):
    v = _versioned(spark, sf)
    return VE.latest_per_group(v, ["repo", "version"], "created_at", "task_id").select("repo", "version", "task_id")


def q_find_version(spark, sf):
    return VE.find_version(A.version_files(spark, sf))


def q_parse_tracker_time(spark, sf):
    t = A.tracker_times(spark, sf)
    return t.select("event_id", F.date_format(VE.parse_tracker_time(F.col("stamp")), "yyyy-MM-dd HH:mm:ss")
                    .alias("parsed"))


def q_split_even(spark, sf):
    i = A.instances(spark, sf).select("instance_id")
    return OR.split_even(i, 7, ["instance_id"])


def q_shard_contiguous(spark, sf):
    i = A.instances(spark, sf).select("instance_id")
    return OR.shard(i, 4, 1, ["instance_id"], contiguous=True)


def q_shard_strided(spark, sf):
    i = A.instances(spark, sf).select("instance_id")
    return OR.shard(i, 4, 1, ["instance_id"], contiguous=False)


def q_merge_shards(spark, sf):
    i = A.instances(spark, sf).select("instance_id", "repo")
    parts = OR.split_even(i, 3, ["instance_id"])
    shards = [parts.where(F.col("part") == k).drop("part") for k in (1, 2, 3)]
    return OR.merge_shards(shards, expected=i.count())


QUERIES.update({
    "resolved_issues": q_resolved_issues,
    "resolved_issues_all": q_resolved_issues_all,
    "valid_pulls": q_valid_pulls,
    "problem_statements": q_problem_statements,
    "hints_before": q_hints_before,
    "hints_filter": q_hints_filter,
    "make_instances": q_make_instances,
    "funnel": q_funnel,
    "effective_commit": q_effective_commit,
    "bounded_feed": q_bounded_feed,
    "bounded_feed_inclusive": q_bounded_feed_inclusive,
    "releases_from_pages": q_releases_from_pages,
    "releases_by_site": q_releases_by_site,
    "version_cutoffs": q_version_cutoffs,
    "asof_version": q_asof_version,
    "asof_version_oldest": q_asof_version_oldest,
    "group_by_version": q_group_by_version,
    "latest_per_group": q_latest_per_group,
    "find_version": q_find_version,
    "parse_tracker_time": q_parse_tracker_time,
    "split_even": q_split_even,
    "shard_contiguous": q_shard_contiguous,
    "shard_strided": q_shard_strided,
    "merge_shards": q_merge_shards,
})

# ---------------------------------------------------------------- DuckDB twins

_REPO = "source || '/' || lang"
_T0 = "TIMESTAMP '2020-01-01 00:00:00'"

VIEWS["pulls"] = f"""
pulls AS (
  SELECT {_REPO} AS repo, doc_id AS number, split_part(text, chr(10), 1) AS title,
         text || CASE doc_id % 3 WHEN 0 THEN ' fixes #' || CAST(doc_id AS VARCHAR)
                                 WHEN 1 THEN ' Closes #' || CAST(doc_id AS VARCHAR) || ' <!-- closes #9 -->'
                                 ELSE '' END AS body,
         {_T0} + doc_id * INTERVAL 1 HOUR AS created_at,
         CASE WHEN doc_id % 5 = 0 THEN NULL ELSE {_T0} + doc_id * INTERVAL 1 HOUR + INTERVAL 1 DAY END AS merged_at,
         md5(text) AS base_commit,
         CASE WHEN doc_id % 3 = 0 THEN NULL ELSE md5(lang) END AS environment_setup_commit,
         '--- a/src/' || source || '.py' || chr(10) || '+++ b/src/' || source || '.py' || chr(10)
           || '@@ -1 +1 @@' || chr(10) || '-a' || chr(10) || '+b' || chr(10) AS patch,
         CASE WHEN doc_id % 4 = 0 THEN '' ELSE '+def test_x(): pass' END AS test_patch
  FROM documents)"""

VIEWS["commits"] = f"""
commits AS (
  SELECT {_REPO} AS repo, c.conv_id AS number, c.turn AS pos,
         c.text || CASE c.turn % 4 WHEN 1 THEN ' resolves #' || CAST(c.conv_id AS VARCHAR)
                                   WHEN 3 THEN ' fixes #' || CAST(c.conv_id + 1 AS VARCHAR) ELSE '' END AS message,
         {_T0} + c.conv_id * INTERVAL 1 HOUR + c.turn * 10 * INTERVAL 1 MINUTE AS author_date
  FROM conversations c JOIN documents d ON d.doc_id = c.conv_id WHERE c.role = 'assistant')"""

VIEWS["comments"] = f"""
comments AS (
  SELECT {_REPO} AS repo, c.conv_id AS issue_number, c.turn AS pos, c.text AS body,
         {_T0} + c.conv_id * INTERVAL 1 HOUR + ((c.turn * 7) % 20) * INTERVAL 1 MINUTE AS updated_at
  FROM conversations c JOIN documents d ON d.doc_id = c.conv_id WHERE c.role = 'user')"""

VIEWS["issue_texts"] = f"""
issue_texts AS (SELECT {_REPO} AS repo, doc_id AS number, split_part(text, chr(10), 1) AS title, text AS body
                FROM documents)"""

VIEWS["changelog_pages"] = """
changelog_pages AS (
  SELECT repo, '<html><body>' || chr(10) || string_agg(a, chr(10) ORDER BY y, m, t) || chr(10) || '</body></html>' AS html
  FROM (SELECT repo, y, m, t,
               anchor || chr(10) || anchor AS a
        FROM (SELECT repo, y, m, t,
                     '<a class="reference internal nav-link" href="#version-' || replace(ver, '.', '-') || '">Version '
                     || ver || ' (' || strftime(last, '%Y-%m-%d') || ')</a>' AS anchor
              FROM (SELECT o_orderpriority AS repo, year(o_orderdate) AS y, month(o_orderdate) AS m,
                           floor(day(o_orderdate) / 10) AS t, max(o_orderdate) AS last,
                           CAST(year(o_orderdate) AS VARCHAR) || '.' || CAST(month(o_orderdate) AS VARCHAR) || '.'
                           || CAST(CAST(floor(day(o_orderdate) / 10) AS BIGINT) AS VARCHAR) AS ver
                    FROM orders GROUP BY 1, 2, 3, 4, ver)))
  GROUP BY repo)"""

VIEWS["release_tasks"] = """
release_tasks AS (
  SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
                   CAST(l_suppkey AS VARCHAR)) AS task_id,
         o_orderpriority AS repo, l_shipdate AS created_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

VIEWS["version_files"] = f"""
version_files AS (
  SELECT replace({_REPO}, '/', '__') || '-' || CAST(doc_id AS VARCHAR) AS instance_id, {_REPO} AS repo,
         0 AS file_pos,
         text || CASE doc_id % 4
           WHEN 0 THEN chr(10) || '__version__ = "' || CAST(doc_id % 7 AS VARCHAR) || '.' || CAST(doc_id % 11 AS VARCHAR)
                       || '.' || CAST(doc_id AS VARCHAR) || '"'
           WHEN 1 THEN chr(10) || 'VERSION = (' || CAST(doc_id % 5 AS VARCHAR) || ', ' || CAST(doc_id % 9 AS VARCHAR) || ', 0)'
           WHEN 2 THEN chr(10) || '\"\"\"' || chr(10) || '__version__ = "9.9.9"' || chr(10) || '\"\"\"'
           ELSE '' END AS text
  FROM documents)"""

VIEWS["tracker_times"] = """
tracker_times AS (
  SELECT event_id, CASE event_id % 3
           WHEN 0 THEN 'See timeline at ' || strftime(ts, '%m/%d/%y %H:%M:%S')
           WHEN 1 THEN strftime(ts, '%b %-d, %Y, %-I:%M:%S %p')
           ELSE strftime(ts, '%m/%d/%y %H:%M:%S') END AS stamp
  FROM events)"""

_KW = ", ".join(f"'{w}'" for w in C.ISSUE_KEYWORDS)
_REF = rf"({C.WORD}+){PY_WS}+#(\d+)"

_RI = f"""
ctext AS (SELECT repo, number, string_agg(message, chr(10) ORDER BY pos) AS commit_text FROM commits GROUP BY ALL),
rtext AS (
  SELECT p.*, regexp_replace(concat_ws(chr(10), coalesce(title, ''), coalesce(body, ''), coalesce(commit_text, '')),
                             '(?s)<!--.*?-->', '', 'g') AS t
  FROM pulls p LEFT JOIN ctext c USING (repo, number)),
rwords AS (SELECT *, regexp_extract_all(t, '{_REF}', 1) AS words, regexp_extract_all(t, '{_REF}', 2) AS nums FROM rtext),
pulls_ri AS (
  SELECT * EXCLUDE (t, words, nums),
    list_transform(list_filter(words, lambda x, i: list_position(words, x) = i AND lower(x) IN ({_KW})),
                   lambda w: nums[len(words) - list_position(list_reverse(words), w) + 1]) AS resolved_issues,
    list_transform(list_filter(range(1, len(words) + 1), lambda i: lower(words[i]) IN ({_KW})),
                   lambda i: nums[i]) AS resolved_all
  FROM rwords)"""

_PS = """
prefs AS (SELECT repo, number, unnest(resolved_issues) AS issue, generate_subscripts(resolved_issues, 1) AS ref_pos
          FROM pulls_ri),
pstate AS (
  SELECT p.repo, p.number, coalesce(s.problem_statement, '') AS problem_statement
  FROM pulls_ri p LEFT JOIN (
    SELECT r.repo, r.number, string_agg(coalesce(i.title, '') || chr(10) || coalesce(i.body, '') || chr(10), '' ORDER BY ref_pos)
             AS problem_statement
    FROM prefs r JOIN issue_texts i ON i.repo = r.repo AND CAST(i.number AS VARCHAR) = r.issue
    GROUP BY r.repo, r.number) s USING (repo, number))"""


def _hints_sql(prefix: bool) -> str:
    cut = ("AND (stop_pos IS NULL OR c_pos < stop_pos)" if prefix else "AND NOT late")
    return f"""
hrefs AS (SELECT * FROM prefs r WHERE EXISTS (SELECT 1 FROM issue_texts i WHERE i.repo = r.repo
                                              AND CAST(i.number AS VARCHAR) = r.issue)),
first_commit AS (SELECT repo, number, arg_min(author_date, pos) AS t0 FROM commits GROUP BY ALL),
hj AS (
  SELECT r.repo, r.number, r.ref_pos, c.pos AS c_pos, c.body, c.updated_at >= f.t0 AS late
  FROM hrefs r JOIN first_commit f USING (repo, number)
  JOIN comments c ON c.repo = r.repo AND CAST(c.issue_number AS VARCHAR) = r.issue),
hstop AS (SELECT repo, number, ref_pos, min(CASE WHEN late THEN c_pos END) AS stop_pos FROM hj GROUP BY ALL),
htexts AS (
  SELECT repo, number, ref_pos, string_agg(body, chr(10) ORDER BY c_pos) AS h
  FROM hj JOIN hstop USING (repo, number, ref_pos) WHERE true {cut} GROUP BY ALL),
hints AS (
  SELECT p.repo, p.number, coalesce(x.hints_text, '') AS hints_text
  FROM pulls_ri p LEFT JOIN (
    SELECT repo, number, string_agg(coalesce(h, ''), chr(10) ORDER BY ref_pos) AS hints_text
    FROM hrefs LEFT JOIN htexts USING (repo, number, ref_pos) GROUP BY ALL) x USING (repo, number))"""


_MADE = """
made AS (
  SELECT replace(p.repo || '-' || CAST(p.number AS VARCHAR), '/', '__') AS instance_id, p.repo,
         p.number AS pull_number, array_to_string(p.resolved_issues, ',') AS issue_numbers, p.base_commit,
         p.patch, p.test_patch, coalesce(s.problem_statement, '') AS problem_statement,
         coalesce(h.hints_text, '') AS hints_text, p.created_at
  FROM pulls_ri p LEFT JOIN pstate s USING (repo, number) LEFT JOIN hints h USING (repo, number)
  WHERE p.merged_at IS NOT NULL AND coalesce(len(p.resolved_issues) > 0, false))"""

_PV = ["pulls", "commits", "comments", "issue_texts"]

ORACLE["resolved_issues"] = with_views(_PV, _RI) + \
    "\nSELECT repo, number, array_to_string(resolved_issues, ',') AS issues FROM pulls_ri"
ORACLE["resolved_issues_all"] = with_views(_PV, _RI) + \
    "\nSELECT repo, number, array_to_string(resolved_all, ',') AS issues FROM pulls_ri"
ORACLE["valid_pulls"] = with_views(_PV, _RI) + """
SELECT repo, number FROM pulls_ri WHERE merged_at IS NOT NULL AND coalesce(len(resolved_issues) > 0, false)"""
ORACLE["problem_statements"] = with_views(_PV, _RI, _PS) + "\nSELECT * FROM pstate"
ORACLE["hints_before"] = with_views(_PV, _RI, _PS, _hints_sql(True)) + "\nSELECT * FROM hints"
ORACLE["hints_filter"] = with_views(_PV, _RI, _PS, _hints_sql(False)) + "\nSELECT * FROM hints"
ORACLE["make_instances"] = with_views(_PV, _RI, _PS, _hints_sql(True), _MADE) + """
SELECT instance_id, repo, pull_number, issue_numbers, base_commit, problem_statement, hints_text,
       strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM made"""
ORACLE["funnel"] = with_views(_PV, _RI, _PS, _hints_sql(True), _MADE) + f"""
SELECT count(*) AS n_read, 0 AS n_seen,
       count(*) FILTER (WHERE vp) AS n_valid_pulls,
       count(*) FILTER (WHERE vp AND vi) AS n_valid_instances,
       count(*) FILTER (WHERE vp AND vi AND ht) AS n_with_tests
FROM (SELECT p.merged_at IS NOT NULL AND coalesce(len(p.resolved_issues) > 0, false) AS vp,
             coalesce(length(m.patch) > 0, false) AND coalesce(length(m.problem_statement) > 0, false) AS vi,
             coalesce(regexp_matches(m.test_patch, '[^' || '{PY_WS[1:]}'), false) AS ht
      FROM pulls_ri p LEFT JOIN made m ON m.instance_id = replace(p.repo || '-' || CAST(p.number AS VARCHAR), '/', '__'))"""
ORACLE["effective_commit"] = with_views(["pulls"]) + \
    "\nSELECT repo, number, coalesce(environment_setup_commit, base_commit) AS commit FROM pulls"
ORACLE["bounded_feed"] = with_views(["pulls"]) + """
SELECT repo, number FROM (
  SELECT p.*, row_number() OVER (PARTITION BY repo ORDER BY created_at DESC, number DESC) AS rn,
         (SELECT max((created_at, number)) FROM pulls q WHERE q.repo = p.repo
            AND q.created_at < TIMESTAMP '2020-01-20 00:00:00') AS stop
  FROM pulls p)
WHERE rn <= 5 AND (stop IS NULL OR (created_at, number) >= stop)"""
ORACLE["bounded_feed_inclusive"] = with_views(["pulls"]) + """
SELECT repo, number FROM (
  SELECT repo, number, row_number() OVER (PARTITION BY repo ORDER BY created_at DESC, number DESC) AS rn FROM pulls)
WHERE rn <= 6"""

_REL = r"""
rel_raw AS (
  SELECT DISTINCT repo, v, d FROM (
    SELECT repo, unnest(regexp_extract_all(html, '<a class="reference internal nav-link" href="#version-([^"]*)">Version ([^ <]*) \(([^)<]*)\)</a>', 2)) AS v,
                 unnest(regexp_extract_all(html, '<a class="reference internal nav-link" href="#version-([^"]*)">Version ([^ <]*) \(([^)<]*)\)</a>', 3)) AS d
    FROM changelog_pages)),
releases AS (
  SELECT repo, regexp_replace(array_to_string(string_split(trim(v), '.')[1:2], '.'), '[^0-9.]', '', 'g') AS version,
         CAST(try_strptime(d, '%Y-%m-%d') AS DATE) AS released_at
  FROM rel_raw WHERE try_strptime(d, '%Y-%m-%d') IS NOT NULL),
rel_day AS (SELECT repo, released_at, max(version) AS version FROM releases GROUP BY ALL),
versioned AS (
  SELECT t.task_id, t.repo, t.created_at, r.version
  FROM (SELECT *, CAST(created_at AS DATE) AS d FROM release_tasks) t
  ASOF LEFT JOIN rel_day r ON t.repo = r.repo AND t.d > r.released_at),
oldest AS (SELECT repo, arg_min(version, (released_at, version)) AS v0 FROM releases GROUP BY repo)"""

_RV = ["changelog_pages", "release_tasks"]
ORACLE["releases_from_pages"] = with_views(_RV, _REL) + "\nSELECT repo, version, released_at FROM releases"
_REL_DAY = """
WITH d AS (SELECT o_orderpriority AS repo, year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(max(o_orderdate) AS DATE) AS day
           FROM orders GROUP BY 1, 2, 3)"""
ORACLE["releases_by_site"] = _REL_DAY + """
SELECT site, repo, y || '.' || m AS version, day AS released_at
FROM d, (VALUES ('anchors'), ('dashed'), ('padded'), ('notes')) AS s(site)
UNION ALL SELECT 'table', repo, y || '.' || m || '.0', CAST(date_trunc('month', day) AS DATE) FROM d
UNION ALL SELECT 'names', repo, (y % 10) || '.' || (m % 10), max(day) FROM d GROUP BY repo, y % 10, m % 10"""
ORACLE["version_cutoffs"] = with_views(_RV, _REL) + """
SELECT repo, regexp_replace(array_to_string(string_split(trim(version), '.')[1:2], '.'), '[^0-9.]', '', 'g') AS version,
       max(released_at) AS released_at FROM releases GROUP BY ALL"""
ORACLE["asof_version"] = with_views(_RV, _REL) + "\nSELECT task_id, repo, version FROM versioned"
ORACLE["asof_version_oldest"] = with_views(_RV, _REL) + """
SELECT task_id, repo, coalesce(version, v0) AS version FROM versioned LEFT JOIN oldest USING (repo)"""
ORACLE["group_by_version"] = with_views(_RV, _REL) + \
    "\nSELECT repo, version, count(*) AS n_instances FROM versioned GROUP BY ALL"
ORACLE["latest_per_group"] = with_views(_RV, _REL) + """
SELECT repo, version, arg_max(task_id, (created_at, task_id)) AS task_id FROM versioned GROUP BY ALL"""

_P1, _P2 = VE.DEFAULT_VERSION_PATTERNS
FIND_VERSION_SELECT = f"""
SELECT instance_id,
  CASE WHEN raw IS NULL THEN NULL ELSE regexp_replace(
    CASE WHEN contains(r2, ',') THEN array_to_string(string_split(trim(r2), ',')[1:2], '.') ELSE r2 END,
    '[^0-9.]', '', 'g') END AS version
FROM (SELECT instance_id, raw,
        CASE WHEN contains(raw, '.') THEN array_to_string(string_split(trim(raw), '.')[1:2], '.') ELSE raw END AS r2
      FROM (SELECT instance_id, replace(CASE WHEN regexp_matches(t, $${_P1}$$) THEN regexp_extract(t, $${_P1}$$, 1)
                                             WHEN regexp_matches(t, $${_P2}$$) THEN regexp_extract(t, $${_P2}$$, 1) END,
                                        ' ', '') AS raw
            FROM (SELECT instance_id, regexp_replace(text, '(?s)\"\"\".*?\"\"\"', '', 'g') AS t FROM version_files)))"""
ORACLE["find_version"] = with_views(["version_files"]) + "\n" + FIND_VERSION_SELECT
ORACLE["parse_tracker_time"] = with_views(["tracker_times"]) + """
SELECT event_id, strftime(coalesce(
  CASE WHEN contains(s, '/') THEN try_strptime(s, '%m/%d/%y %H:%M:%S') END,
  CASE WHEN NOT contains(s, '/') AND contains(s, ',') THEN try_strptime(s, '%b %d, %Y, %I:%M:%S %p') END),
  '%Y-%m-%d %H:%M:%S') AS parsed
FROM (SELECT event_id, CASE WHEN starts_with(stamp, 'See timeline at ') THEN substr(stamp, 17) ELSE stamp END AS s
      FROM tracker_times)"""

_IV = ["patches", "instances"]
ORACLE["split_even"] = with_views(_IV) + """
SELECT instance_id, CAST(ntile(7) OVER (ORDER BY instance_id) AS INTEGER) AS part FROM instances"""
ORACLE["shard_contiguous"] = with_views(_IV) + """
SELECT instance_id FROM (SELECT instance_id, ntile(4) OVER (ORDER BY instance_id) AS p FROM instances) WHERE p = 2"""
ORACLE["shard_strided"] = with_views(_IV) + """
SELECT instance_id FROM (SELECT instance_id, row_number() OVER (ORDER BY instance_id) AS rn FROM instances)
WHERE (rn - 1) % 4 = 1"""
ORACLE["merge_shards"] = with_views(_IV) + "\nSELECT instance_id, repo FROM instances"
