"""Registered queries for curation and diff parsing, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixfold.functions import criteria as C
from fixfold.functions import paths as PTH
from fixfold.functions.text import PY_NON_WS, PY_WS
from fixfold.operators import curate as CU
from fixfold.operators import diff as D
from fixfold.operators import joins as J
from fixfold.plans.views_sql import with_views
from fixfold.sources import adapters as A
from fixfold.streaming.jobs import scratch

QUERIES = {}
ORACLE = {}
K = ["instance_id"]


def _inst(spark, sf):
    return A.instances(spark, sf)


def _lines(spark, sf):
    return D.patch_lines(_inst(spark, sf), K, "patch")


def _files(spark, sf):
    return D.patch_files(_lines(spark, sf), K)


def _flags(spark, sf):
    return CU.lite_flags(_inst(spark, sf), A.issues(spark, sf))


STAGES = ["ok_statement", "ok_patch", "ok_test_patch"]


def _survivors(spark, sf):
    return CU.apply_cascade(_flags(spark, sf), STAGES)


# ---------------------------------------------------------------- Spark side

def q_patch_files(spark, sf):
    return _files(spark, sf)


def q_patch_hunks(spark, sf):
    return D.patch_hunks(_lines(spark, sf), K)


def q_patch_stats(spark, sf):
    st = D.patch_stats(_files(spark, sf), K)
    return st.select("*", D.max_code_lines(st, 25).alias("leq_25_lines"),
                     D.max_files(1).alias("leq_1_file"), D.max_hunks(3).alias("hunks_1_to_3"))


def q_criteria(spark, sf):
    i = _inst(spark, sf)
    refs = CU.references_issue(i, A.issues(spark, sf))
    st = F.col("problem_statement")
    return i.join(refs, "instance_id", "left").select(
        "instance_id",
        C.valid_instance().alias("valid_instance"),
        C.has_tests().alias("has_tests"),
        C.contains_commit_hash(st).alias("commit_hash"),
        C.contains_hyperlink(st).alias("hyperlink_any"),
        C.contains_hyperlink(st, F.col("repo")).alias("hyperlink_foreign"),
        C.contains_hyperlink(st, F.col("repo"), strict=True).alias("hyperlink_strict"),
        C.contains_image(st).alias("image"),
        "refers_issue",
        C.contains_match_arg(F.col("test_patch")).alias("match_arg"),
        C.max_words(st, 40).alias("leq_40_words"),
        C.max_words(st, 50).alias("leq_50_words"),
        C.max_chars(st, 5000).alias("leq_5000_chars"),
    )


def q_lite_cascade_counts(spark, sf):
    return CU.cascade_counts(_flags(spark, sf), STAGES)


def q_lite_set(spark, sf):
    return _survivors(spark, sf).select("instance_id", "repo")


def q_sample_n(spark, sf):
    path = scratch(spark, "survivors")  # ids alone, written as the sample reads them twice
    _survivors(spark, sf).select("instance_id").write.parquet(path)
    return CU.sample_n(spark.read.parquet(path), 300, 42)


def q_cap_per_group(spark, sf):
    return CU.cap_per_group(_inst(spark, sf), "repo", 3, 42).select("instance_id", "repo")


def q_split_validation(spark, sf):
    return CU.split_validation(_inst(spark, sf), 0.1, 42).select("instance_id", "split")


def q_exclude_groups(spark, sf):
    return J.exclude_groups(_inst(spark, sf), _survivors(spark, sf), "repo").select("instance_id")


def _raw_line():
    return F.concat_ws("|", "instance_id", "repo", "test_patch").alias("line")


def q_exclude_exact(spark, sf):
    train = _inst(spark, sf).select("instance_id", _raw_line())
    ev = _survivors(spark, sf).select("instance_id", _raw_line())
    return J.exclude_exact(train, ev, "line").select("instance_id")


def q_order_by_id(spark, sf):
    return _inst(spark, sf).select("instance_id", "repo").orderBy("instance_id")


def q_split_patch(spark, sf):
    return D.split_patch(_lines(spark, sf), K)


def q_renumber_hunks(spark, sf):
    return D.renumber_hunks(D.patch_hunks(_lines(spark, sf), K), K)


def q_modified_files(spark, sf):
    return _inst(spark, sf).select("instance_id", F.array_join(D.modified_files("patch"), ",").alias("files"))


def q_test_paths(spark, sf):
    p = F.col("path")
    return _files(spark, sf).select(
        "instance_id", "file_idx", "path",
        PTH.is_test_path(p, "substring").alias("rule_substring"),
        PTH.is_test_path(p, "word").alias("rule_word"),
        PTH.is_test_path(p, "prefix").alias("rule_prefix"),
        PTH.is_test_path(p, "dir").alias("rule_dir"),
        PTH.keeps_test_target(p).alias("test_target"),
        PTH.is_python_source(p, F.col("instance_id")).alias("python_source"))


QUERIES.update({
    "patch_files": q_patch_files,
    "patch_hunks": q_patch_hunks,
    "patch_stats": q_patch_stats,
    "criteria": q_criteria,
    "lite_cascade_counts": q_lite_cascade_counts,
    "lite_set": q_lite_set,
    "sample_n": q_sample_n,
    "cap_per_group": q_cap_per_group,
    "split_validation": q_split_validation,
    "exclude_groups": q_exclude_groups,
    "exclude_exact": q_exclude_exact,
    "order_by_id": q_order_by_id,
    "split_patch": q_split_patch,
    "renumber_hunks": q_renumber_hunks,
    "modified_files": q_modified_files,
    "test_paths": q_test_paths,
})

# ---------------------------------------------------------------- DuckDB twins

_NONWS = PY_NON_WS
_WS = PY_WS

LINES_SQL = """
pl0 AS (
  SELECT instance_id, has_git, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS pos
  FROM (SELECT instance_id, regexp_matches(patch, '(?m)^diff --git ') AS has_git,
               string_split(patch, chr(10)) AS parts FROM instances WHERE patch IS NOT NULL)),
pl1 AS (
  SELECT *, sum(CASE WHEN (has_git AND starts_with(line, 'diff --git ')) OR (NOT has_git AND starts_with(line, '--- '))
                     THEN 1 ELSE 0 END) OVER (PARTITION BY instance_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS file_idx
  FROM pl0),
pl2 AS (
  SELECT *, sum(CASE WHEN starts_with(line, '@@ ') THEN 1 ELSE 0 END)
              OVER (PARTITION BY instance_id, file_idx ORDER BY pos ROWS UNBOUNDED PRECEDING) AS hunk_idx
  FROM pl1),
plines AS (
  SELECT instance_id, pos, line, file_idx, hunk_idx,
         CASE WHEN hunk_idx = 0 THEN 'header' WHEN starts_with(line, '@@ ') THEN 'hunk'
              WHEN left(line, 1) = '+' THEN 'added' WHEN left(line, 1) = '-' THEN 'removed'
              WHEN left(line, 1) = ' ' THEN 'context' ELSE 'other' END AS kind
  FROM pl2),
pfiles AS (
  SELECT instance_id, file_idx,
         coalesce(CASE WHEN tgt <> '/dev/null' THEN tgt END, CASE WHEN src <> '/dev/null' THEN src END,
                  CASE WHEN gitp <> '' THEN gitp END) AS path,
         CASE WHEN src = '/dev/null' OR new_mode THEN 'added'
              WHEN tgt = '/dev/null' OR deleted_mode THEN 'removed' ELSE 'modified' END AS change,
         n_hunks, added, removed
  FROM (SELECT instance_id, file_idx,
               max(CASE WHEN kind = 'header' AND starts_with(line, '--- ') THEN regexp_replace(substr(line, 5), '^a/', '') END) AS src,
               max(CASE WHEN kind = 'header' AND starts_with(line, '+++ ') THEN regexp_replace(substr(line, 5), '^b/', '') END) AS tgt,
               regexp_extract(max(CASE WHEN kind = 'header' AND starts_with(line, 'diff --git ') THEN line END), ' b/(.*)$', 1) AS gitp,
               bool_or(kind = 'header' AND starts_with(line, 'new file mode')) AS new_mode,
               bool_or(kind = 'header' AND starts_with(line, 'deleted file mode')) AS deleted_mode,
               max(hunk_idx) AS n_hunks,
               count(*) FILTER (WHERE kind = 'added') AS added,
               count(*) FILTER (WHERE kind = 'removed') AS removed
        FROM plines WHERE file_idx > 0 GROUP BY instance_id, file_idx)),
phunks AS (
  SELECT instance_id, file_idx, hunk_idx,
         CAST(nullif(regexp_extract(header, '^@@ -(\\d+)(?:,(\\d+))? \\+(\\d+)(?:,(\\d+))? @@', 1), '') AS BIGINT) AS src_start,
         coalesce(CAST(nullif(regexp_extract(header, '^@@ -(\\d+)(?:,(\\d+))? \\+(\\d+)(?:,(\\d+))? @@', 2), '') AS BIGINT), 1) AS src_len,
         CAST(nullif(regexp_extract(header, '^@@ -(\\d+)(?:,(\\d+))? \\+(\\d+)(?:,(\\d+))? @@', 3), '') AS BIGINT) AS tgt_start,
         coalesce(CAST(nullif(regexp_extract(header, '^@@ -(\\d+)(?:,(\\d+))? \\+(\\d+)(?:,(\\d+))? @@', 4), '') AS BIGINT), 1) AS tgt_len,
         added, removed, context
  FROM (SELECT instance_id, file_idx, hunk_idx, max(CASE WHEN kind = 'hunk' THEN line END) AS header,
               count(*) FILTER (WHERE kind = 'added') AS added,
               count(*) FILTER (WHERE kind = 'removed') AS removed,
               count(*) FILTER (WHERE kind = 'context' OR (kind = 'other' AND line <> '')) AS context
        FROM plines WHERE file_idx > 0 AND hunk_idx > 0 GROUP BY instance_id, file_idx, hunk_idx)),
pstats AS (
  SELECT instance_id, bool_or(change <> 'modified') AS has_added_or_removed,
         sum(added + removed) AS changed_lines,
         count(*) FILTER (WHERE change = 'modified') AS modified_files,
         sum(CASE WHEN change = 'modified' THEN n_hunks ELSE 0 END) AS modified_hunks
  FROM pfiles GROUP BY instance_id)"""

_KW = ", ".join(f"'{w}'" for w in C.ISSUE_KEYWORDS)


def _own_prefixes(u):
    return " OR ".join(f"starts_with({u}, '{p}{C.FORGE}' || repo)"
                       for p in ("http://", "https://", "http://www.", "https://www.", "www."))


CRITERIA_SQL = f"""
bare AS (
  SELECT DISTINCT b.instance_id FROM (
    SELECT instance_id, repo, CAST(unnest(regexp_extract_all(problem_statement, '{C.BARE_REF}', 1)) AS BIGINT) AS number
    FROM instances) b
  SEMI JOIN issues i ON i.repo = b.repo AND i.number = b.number),
crit AS (
  SELECT instance_id, repo,
    coalesce(length(patch) > 0, false) AND coalesce(length(problem_statement) > 0, false) AS valid_instance,
    coalesce(regexp_matches(test_patch, '{_NONWS}'), false) AS has_tests,
    regexp_matches(problem_statement, '{C.COMMIT_HASH}') OR regexp_matches(problem_statement, '{C.SHORT_HASH}') AS commit_hash,
    regexp_matches(problem_statement, '{C.URL_ANY}') AS hyperlink_any,
    len(list_filter(regexp_extract_all(problem_statement, '{C.URL_TOKEN}'), lambda u: NOT ({_own_prefixes('u')}))) > 0 AS hyperlink_foreign,
    regexp_matches(problem_statement, 'https?://.+|www\\..+') AS hyperlink_strict,
    regexp_matches(problem_statement, '{C.MEDIA}') AS image,
    len(list_filter(regexp_extract_all(problem_statement, '{C.ISSUE_REF}', 1), lambda w: lower(w) IN ({_KW}))) > 0
      OR regexp_matches(problem_statement, '{C.GITLAB_ISSUES}')
      OR instance_id IN (SELECT instance_id FROM bare) AS refers_issue,
    CASE WHEN contains(test_patch, 'pytest.raises') OR contains(test_patch, 'pytest.warns')
              OR contains(test_patch, 'pytest.deprecated_call') THEN contains(test_patch, 'match')
         ELSE contains(test_patch, 'assertOutput') OR contains(test_patch, 'assertRaises')
              OR contains(test_patch, 'checks.Error') END AS match_arg,
    len(regexp_extract_all(problem_statement, '{_NONWS}+')) <= 40 AS leq_40_words,
    len(regexp_extract_all(problem_statement, '{_NONWS}+')) <= 50 AS leq_50_words,
    length(problem_statement) <= 5000 AS leq_5000_chars
  FROM instances),
flags AS (
  SELECT c.instance_id, c.repo,
    NOT (leq_40_words OR hyperlink_foreign OR coalesce(refers_issue, false) OR commit_hash OR image) AS ok_statement,
    NOT coalesce(s.has_added_or_removed, false) AND coalesce(s.modified_files <= 1, true)
      AND coalesce(s.modified_hunks >= 1 AND s.modified_hunks <= 3, false) AS ok_patch,
    NOT match_arg AS ok_test_patch
  FROM crit c LEFT JOIN pstats s USING (instance_id)),
survivors AS (SELECT * FROM flags WHERE coalesce(ok_statement, false) AND coalesce(ok_patch, false)
              AND coalesce(ok_test_patch, false))"""

_V = ["patches", "instances", "issues"]

ORACLE["patch_files"] = with_views(_V, LINES_SQL) + "\nSELECT * FROM pfiles"
ORACLE["patch_hunks"] = with_views(_V, LINES_SQL) + "\nSELECT * FROM phunks"
ORACLE["patch_stats"] = with_views(_V, LINES_SQL) + """
SELECT *, changed_lines <= 25 AS leq_25_lines, modified_files <= 1 AS leq_1_file,
       modified_hunks >= 1 AND modified_hunks <= 3 AS hunks_1_to_3 FROM pstats"""
ORACLE["criteria"] = with_views(_V, LINES_SQL, CRITERIA_SQL) + """
SELECT instance_id, valid_instance, has_tests, commit_hash, hyperlink_any, hyperlink_foreign, hyperlink_strict,
       image, refers_issue, match_arg, leq_40_words, leq_50_words, leq_5000_chars FROM crit"""
ORACLE["lite_cascade_counts"] = with_views(_V, LINES_SQL, CRITERIA_SQL) + """
SELECT count(*) AS n_start,
       count(*) FILTER (WHERE coalesce(ok_statement, false)) AS after_ok_statement,
       count(*) FILTER (WHERE coalesce(ok_statement, false) AND coalesce(ok_patch, false)) AS after_ok_patch,
       count(*) FILTER (WHERE coalesce(ok_statement, false) AND coalesce(ok_patch, false)
                        AND coalesce(ok_test_patch, false)) AS after_ok_test_patch
FROM flags"""
ORACLE["lite_set"] = with_views(_V, LINES_SQL, CRITERIA_SQL) + "\nSELECT instance_id, repo FROM survivors"
ORACLE["sample_n"] = with_views(_V, LINES_SQL, CRITERIA_SQL) + """
SELECT instance_id FROM survivors ORDER BY md5('42:' || instance_id), instance_id LIMIT 300"""
ORACLE["cap_per_group"] = with_views(_V) + """
SELECT instance_id, repo FROM (
  SELECT instance_id, repo, row_number() OVER (PARTITION BY repo ORDER BY md5('42:' || instance_id), instance_id) AS rn
  FROM instances) WHERE rn <= 3"""
ORACLE["split_validation"] = with_views(_V) + """
SELECT instance_id,
       CASE WHEN CAST(('0x' || substr(md5('42:' || instance_id), 1, 8)) AS BIGINT) / 4294967296.0 < 0.1
            THEN 'validation' ELSE 'train' END AS split
FROM instances"""
ORACLE["exclude_groups"] = with_views(_V, LINES_SQL, CRITERIA_SQL) + """
SELECT instance_id FROM instances WHERE repo NOT IN (SELECT repo FROM survivors)"""
ORACLE["exclude_exact"] = with_views(_V, LINES_SQL, CRITERIA_SQL) + """
SELECT instance_id FROM instances
WHERE concat_ws('|', instance_id, repo, test_patch) NOT IN (
  SELECT concat_ws('|', i.instance_id, i.repo, i.test_patch) FROM instances i JOIN survivors s USING (instance_id))"""
ORACLE["order_by_id"] = with_views(_V) + "\nSELECT instance_id, repo FROM instances ORDER BY instance_id"
ORACLE["split_patch"] = with_views(_V, LINES_SQL, """
ftext AS (
  SELECT instance_id, file_idx, string_agg(line, chr(10) ORDER BY pos) AS text
  FROM plines WHERE file_idx > 0 AND NOT (kind = 'other' AND line = '') GROUP BY instance_id, file_idx)""") + """
SELECT instance_id,
       coalesce(string_agg(text || chr(10), '' ORDER BY file_idx) FILTER (WHERE NOT is_test), '') AS fix_patch,
       coalesce(string_agg(text || chr(10), '' ORDER BY file_idx) FILTER (WHERE is_test), '') AS test_patch
FROM (SELECT t.*, contains(f.path, 'test') OR contains(f.path, 'tests') OR contains(f.path, 'e2e')
                  OR contains(f.path, 'testing') AS is_test
      FROM ftext t JOIN pfiles f USING (instance_id, file_idx))
GROUP BY instance_id"""
ORACLE["renumber_hunks"] = with_views(_V, LINES_SQL) + """
SELECT instance_id, file_idx, hunk_idx, src_start, context + removed AS new_src_len,
       src_start + coalesce(sum(added - removed) OVER (PARTITION BY instance_id, file_idx ORDER BY hunk_idx
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS new_tgt_start,
       context + added AS new_tgt_len
FROM phunks"""
ORACLE["modified_files"] = with_views(_V) + """
SELECT instance_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS files
FROM (SELECT instance_id, regexp_extract_all(patch, '(?m)^--- a/(.*)$', 1) AS l FROM instances)"""
ORACLE["test_paths"] = with_views(_V, LINES_SQL) + """
SELECT instance_id, file_idx, path,
  contains(path, 'test') OR contains(path, 'tests') OR contains(path, 'e2e') OR contains(path, 'testing') AS rule_substring,
  list_has_any(string_split_regex(lower(path), ' |_|/|\\.'), ['test', 'tests', 'testing']) AS rule_word,
  len(list_filter(string_split(path, '/'), lambda s: starts_with(s, 'test'))) > 0 AS rule_prefix,
  len(list_filter(list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1),
                  lambda s: s IN ('test', 'tests'))) > 0 AS rule_dir,
  NOT (""" + " OR ".join(f"ends_with(path, '{e}')" for e in PTH.NON_TEST_EXTS) + """) AS test_target,
  ends_with(path, '.py') AND (starts_with(instance_id, 'pytest')
    OR NOT len(list_filter(string_split(path, '/'), lambda s: starts_with(s, 'test'))) > 0) AS python_source
FROM pfiles"""


# --- X4 / X5 -------------------------------------------------------------------

def q_repair_patch(spark, sf):
    return D.repair_patch(D.patch_lines(_inst(spark, sf), K, "patch", lenient=True), K)


def q_minimal_patch(spark, sf):
    return D.minimal_patch(D.patch_lines(_inst(spark, sf), K, "patch", lenient=True), K)


QUERIES.update({"repair_patch": q_repair_patch, "minimal_patch": q_minimal_patch})

_FULL = "'^@@\\s+-(\\d+),(\\d+)\\s+\\+(\\d+),(\\d+)\\s+@@(.*)$'"
_HUNKS_SQL = f"""
plast AS (SELECT instance_id, max(pos) AS last_pos FROM plines GROUP BY instance_id),
hhdr AS (
  SELECT instance_id, file_idx, hunk_idx, CAST(regexp_extract(line, {_FULL}, 1) AS BIGINT) AS a,
         regexp_extract(line, {_FULL}, 5) AS rest
  FROM plines WHERE kind = 'hunk' AND regexp_extract(line, {_FULL}, 1) <> ''),
hbody AS (
  SELECT p.instance_id, p.file_idx, p.hunk_idx, list(p.line ORDER BY p.pos) AS body
  FROM plines p JOIN plast USING (instance_id)
  WHERE p.file_idx > 0 AND p.hunk_idx > 0 AND p.kind <> 'hunk' AND NOT (p.pos = plast.last_pos AND p.line = '')
  GROUP BY ALL),
harr AS (SELECT h.*, coalesce(b.body, []::VARCHAR[]) AS body FROM hhdr h LEFT JOIN hbody b USING (instance_id, file_idx, hunk_idx)),
fhdr AS (
  SELECT instance_id, file_idx,
         max(CASE WHEN starts_with(line, '--- a/') THEN line END) AS src,
         max(CASE WHEN starts_with(line, '+++ b/') THEN line END) AS tgt,
         max(CASE WHEN starts_with(line, 'diff') AND starts_with(coalesce(nxt, ''), '--- a/') THEN line END) AS diff_line
  FROM (SELECT *, lead(line) OVER (PARTITION BY instance_id ORDER BY pos) AS nxt FROM plines WHERE kind = 'header')
  GROUP BY ALL
  HAVING max(CASE WHEN starts_with(line, '--- a/') THEN line END) IS NOT NULL
     AND max(CASE WHEN starts_with(line, '+++ b/') THEN line END) IS NOT NULL)"""

ORACLE["repair_patch"] = with_views(_V, LINES_SQL, _HUNKS_SQL) + """
, rc AS (
  SELECT *, len(body) - len(list_filter(body, lambda x: starts_with(x, '-'))) - len(list_filter(body, lambda x: starts_with(x, '+'))) AS ctx,
         len(list_filter(body, lambda x: starts_with(x, '+'))) AS n_add, len(list_filter(body, lambda x: starts_with(x, '-'))) AS n_sub
  FROM harr),
rn AS (
  SELECT *, ctx + n_sub AS pre_len, ctx + n_add AS post_len,
         a + coalesce(sum(n_add - n_sub) OVER (PARTITION BY instance_id, file_idx ORDER BY hunk_idx
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS post
  FROM rc),
ht AS (
  SELECT instance_id, file_idx, string_agg(array_to_string(
           ['@@ -' || CAST(a AS VARCHAR) || ',' || CAST(pre_len AS VARCHAR) || ' +' || CAST(post AS VARCHAR) || ','
            || CAST(post_len AS VARCHAR) || ' @@' || rest] || body, chr(10)), chr(10) ORDER BY hunk_idx) AS hunks
  FROM rn GROUP BY ALL),
ft AS (SELECT f.instance_id, f.file_idx, concat_ws(chr(10), f.diff_line, f.src, f.tgt, h.hunks) AS t
       FROM fhdr f LEFT JOIN ht h USING (instance_id, file_idx))
SELECT instance_id, string_agg(t, chr(10) ORDER BY file_idx) || chr(10) AS repaired FROM ft GROUP BY instance_id"""

ORACLE["minimal_patch"] = with_views(_V, LINES_SQL, _HUNKS_SQL) + f"""
, s0 AS (SELECT *, [rest] || body || [''] AS seq FROM harr),
s1 AS (
  SELECT *, len(seq) AS n,
         list_position(list_transform(seq, lambda x: starts_with(x, '+') OR starts_with(x, '-')), true) AS pf,
         list_position(list_transform(list_reverse(seq), lambda x: starts_with(x, '+') OR starts_with(x, '-')), true) AS pl
  FROM s0),
s2 AS (
  SELECT *, CASE WHEN coalesce(pf, 0) > 0 THEN pf - 1 ELSE n END AS fi,
         CASE WHEN coalesce(pl, 0) > 0 THEN n - (pl - 1) + 1 ELSE 1 END AS en
  FROM s1),
s3 AS (
  SELECT *, CASE WHEN fi < n THEN list_transform(seq[fi + 1:least(en, n)], lambda x: regexp_replace(x, '{PY_WS}+$', ''))
                 ELSE []::VARCHAR[] END AS kept,
         a + fi - 1 AS pre
  FROM s2),
s4 AS (SELECT *, string_split(regexp_replace(array_to_string(kept, chr(10)), '^\\n+|\\n+$', '', 'g'), chr(10)) AS cl FROM s3),
s5 AS (
  SELECT *, len(cl) - len(list_filter(cl, lambda x: starts_with(x, '-'))) - len(list_filter(cl, lambda x: starts_with(x, '+'))) AS ctx,
         len(list_filter(cl, lambda x: starts_with(x, '+'))) AS n_add, len(list_filter(cl, lambda x: starts_with(x, '-'))) AS n_sub
  FROM s4),
s6 AS (
  SELECT *, ctx + n_sub AS pre_len, ctx + n_add AS post_len,
         pre + coalesce(sum(n_add - n_sub) OVER (PARTITION BY instance_id, file_idx ORDER BY hunk_idx
                                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS post
  FROM s5),
ht AS (
  SELECT instance_id, file_idx, string_agg('@@ -' || CAST(pre AS VARCHAR) || ',' || CAST(pre_len AS VARCHAR) || ' +'
           || CAST(post AS VARCHAR) || ',' || CAST(post_len AS VARCHAR) || ' @@' || chr(10)
           || array_to_string(kept, chr(10)) || chr(10), '' ORDER BY hunk_idx) AS hunks
  FROM s6 GROUP BY ALL),
ft AS (SELECT f.instance_id, f.file_idx, f.src || chr(10) || f.tgt || chr(10) || coalesce(h.hunks, '') AS t
       FROM fhdr f LEFT JOIN ht h USING (instance_id, file_idx))
SELECT instance_id, string_agg(t, '' ORDER BY file_idx) AS minimal FROM ft GROUP BY instance_id"""


def q_edit_excerpt(spark, sf):
    from fixfold.operators.context import edit_excerpt

    lines = _lines(spark, sf)
    files = D.patch_files(lines, K).where(F.col("change") == "modified")
    hunks = D.patch_hunks(lines, K).join(files.select("instance_id", "file_idx", "path"), ["instance_id", "file_idx"])
    contents = files.select("instance_id", "path").join(
        _doc_contents(spark, sf), "instance_id")
    return edit_excerpt(contents, hunks.select("instance_id", "path", "hunk_idx", "src_start", "src_len"))


def _doc_contents(spark, sf):
    """Every file of a task is shown with its task's document text as content."""
    from fixfold.sources.tables import Tables

    d = Tables(spark, sf).documents
    inst = F.concat(F.replace(F.concat(F.col("source"), F.lit("/"), F.col("lang")), F.lit("/"), F.lit("__")),
                    F.lit("-"), F.col("doc_id").cast("string"))
    return d.select(inst.alias("instance_id"), F.col("text").alias("contents"))


QUERIES["edit_excerpt"] = q_edit_excerpt


def q_prompt_edits_only(spark, sf):
    from fixfold.operators.context import render_prompt

    df = _inst(spark, sf).select("instance_id", "problem_statement").join(q_edit_excerpt(spark, sf), "instance_id") \
        .withColumn("readmes_text", F.lit(""))
    return df.select("instance_id", render_prompt(df, "style-2-edits-only").alias("prompt"))


def q_oracle_files(spark, sf):
    return D.oracle_files(_lines(spark, sf), K).select("instance_id", F.array_join("files", ",").alias("files"))


QUERIES["prompt_edits_only"] = q_prompt_edits_only
QUERIES["oracle_files"] = q_oracle_files


def _num(c):
    return (f"list_transform(string_split({c}, chr(10)), lambda l, i: CAST(i AS VARCHAR) || ' ' || l)")


ORACLE["edit_excerpt"] = with_views(_V, LINES_SQL) + f"""
, fc AS (
  SELECT f.instance_id, f.file_idx, f.path, {_num('d.text')} AS nl
  FROM pfiles f JOIN (SELECT replace(source || '/' || lang, '/', '__') || '-' || CAST(doc_id AS VARCHAR) AS instance_id,
                             text FROM documents) d USING (instance_id)
  WHERE f.change = 'modified'),
hb AS (
  SELECT c.instance_id, c.path, h.hunk_idx, len(c.nl) AS n, c.nl,
         greatest(h.src_start - 1 - 15, 0) AS s, least(h.src_start - 1 + h.src_len + 15, len(c.nl)) AS e
  FROM phunks h JOIN fc c USING (instance_id, file_idx)),
blocks AS (
  SELECT instance_id, path, string_agg(CASE WHEN s > 0 THEN '...' || chr(10) ELSE '' END
           || array_to_string(nl[s + 1:e], chr(10)) || chr(10)
           || CASE WHEN e < n THEN '...' || chr(10) ELSE '' END, '' ORDER BY hunk_idx) AS body
  FROM hb GROUP BY ALL)
SELECT instance_id, regexp_replace(string_agg('[start of ' || path || ']' || chr(10)
         || regexp_replace(body, '^\\n+|\\n+$', '', 'g') || chr(10) || '[end of ' || path || ']' || chr(10), '' ORDER BY path),
       '^\\n+|\\n+$', '', 'g') AS code_text
FROM blocks GROUP BY instance_id"""


def _edits_only_sql():
    from fixfold.functions.prompts import TEMPLATES

    def text(v):
        return "'" + v.replace("'", "''") + "'"

    cols = {"problem_statement": "coalesce(i.problem_statement, '')", "readmes_text": "''", "code_text": "coalesce(e.code_text, '')"}
    parts = ", ".join(cols[p[1]] if isinstance(p, tuple) else text(p) for p in TEMPLATES["style-2-edits-only"])
    return f"concat_ws(chr(10), {parts})"


ORACLE["prompt_edits_only"] = with_views(_V) + f"""
SELECT i.instance_id, {_edits_only_sql()} AS prompt
FROM instances i JOIN ({ORACLE["edit_excerpt"]}) e USING (instance_id)"""
ORACLE["oracle_files"] = with_views(_V) + """
SELECT instance_id, array_to_string(list_sort(list_distinct(list_transform(
         list_filter(string_split(patch, chr(10)), lambda l, i: starts_with(l, '--- ')
                     AND starts_with(string_split(patch, chr(10))[i + 1], '+++ ')),
         lambda l: CASE WHEN strpos(l, 'a/') > 0 THEN substr(l, strpos(l, 'a/') + 2) ELSE substr(l, 5) END))), ',') AS files
FROM instances WHERE patch IS NOT NULL AND contains(patch, '--- ')"""
