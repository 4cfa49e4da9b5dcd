"""Registered queries for the grading slice, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixfold.functions.logs import FRAMED_PATTERN, REPO_RULES, VERBOSE_BLOB_PATTERNS
from fixfold.operators import grading as G
from fixfold.operators import joins as J
from fixfold.plans.views_sql import with_views
from fixfold.sources import adapters as A

QUERIES = {}
ORACLE = {}


def _applied(spark, sf):
    return G.applied_logs(G.with_rule(A.logs(spark, sf), spark))


def _parsed(spark, sf):
    return G.parse_logs(_applied(spark, sf))


def _status_map(spark, sf):
    return G.status_map(A.status_rows(spark, sf))


def _graded(spark, sf):
    return G.grade_tests(A.expected_tests(spark, sf), _status_map(spark, sf))


def _reports(spark, sf):
    return G.instance_reports(A.predictions(spark, sf), _applied(spark, sf),
                              A.expected_tests(spark, sf), _parsed(spark, sf))


def _run_classes(spark, sf):
    return G.run_report(A.eval_instances(spark, sf), A.predictions(spark, sf), _reports(spark, sf))


def q_applied_logs(spark, sf):
    return _applied(spark, sf).select("instance_id", "applied", "test_output")


def q_rule_lookup(spark, sf):
    return G.with_rule(A.logs(spark, sf), spark).select("instance_id", "repo", "rule")


def q_repo_of(spark, sf):
    return A.eval_instances(spark, sf).select("instance_id", G.repo_of("instance_id").alias("repo"))


def q_parse_logs(spark, sf):
    return _parsed(spark, sf)


def q_status_map(spark, sf):
    return _status_map(spark, sf)


def q_grade_tests(spark, sf):
    return _graded(spark, sf)


def q_test_rates(spark, sf):
    r = G.test_rates(_graded(spark, sf), A.predictions(spark, sf))
    return r.select("instance_id", F.round("f2p_rate", 6).alias("f2p_rate"),
                    F.round("p2p_rate", 6).alias("p2p_rate"))


def q_resolution(spark, sf):
    return G.resolution(G.test_rates(_graded(spark, sf), A.predictions(spark, sf))) \
        .select("instance_id", "resolution")


def q_instance_reports(spark, sf):
    r = _reports(spark, sf)
    lists = [F.array_join(F.col(c), ",").alias(c) for c in r.columns if c.endswith(("_success", "_failure"))]
    return r.select("instance_id", "patch_is_null", "patch_exists", "patch_applied", "resolved", *lists)


def q_run_report(spark, sf):
    return _run_classes(spark, sf)


def q_run_report_counts(spark, sf):
    return G.run_report_counts(A.eval_instances(spark, sf), A.predictions(spark, sf),
                               _run_classes(spark, sf))


def q_resolved_rate(spark, sf):
    inst = A.eval_instances(spark, sf)
    return G.resolved_rate(_reports(spark, sf), inst, inst.where("in_subset"))


def q_edit_histogram(spark, sf):
    return G.edit_histogram(_reports(spark, sf), A.eval_instances(spark, sf))


def q_gold_predictions(spark, sf):
    return G.gold_predictions(A.eval_instances(spark, sf))


def q_non_empty_predictions(spark, sf):
    return J.non_empty_predictions(A.predictions(spark, sf))


def q_select_work(spark, sf):
    done = _reports(spark, sf).select("instance_id")
    return J.select_work(A.eval_instances(spark, sf), A.predictions(spark, sf), done) \
        .select("instance_id", "model_patch")


def q_skip_existing(spark, sf):
    done = _reports(spark, sf).select("instance_id")
    return J.skip_existing(A.predictions(spark, sf), done).select("instance_id")


def q_missing_ids(spark, sf):
    return J.missing_ids(A.eval_instances(spark, sf), A.predictions(spark, sf))


def q_common_ids(spark, sf):
    return J.common_ids(A.predictions(spark, sf).select("instance_id"),
                        A.eval_instances(spark, sf).select("instance_id"))


QUERIES.update({
    "applied_logs": q_applied_logs,
    "rule_lookup": q_rule_lookup,
    "repo_of": q_repo_of,
    "parse_logs": q_parse_logs,
    "status_map": q_status_map,
    "grade_tests": q_grade_tests,
    "test_rates": q_test_rates,
    "resolution": q_resolution,
    "instance_reports": q_instance_reports,
    "run_report": q_run_report,
    "run_report_counts": q_run_report_counts,
    "resolved_rate": q_resolved_rate,
    "edit_histogram": q_edit_histogram,
    "gold_predictions": q_gold_predictions,
    "non_empty_predictions": q_non_empty_predictions,
    "select_work": q_select_work,
    "skip_existing": q_skip_existing,
    "missing_ids": q_missing_ids,
    "common_ids": q_common_ids,
})

# ----------------------------------------------------------------- DuckDB twins

_RULES_VALUES = ", ".join(f"('{r}', '{u}')" for r, u in sorted(REPO_RULES.items()))
_REPO_OF = "regexp_replace(replace({c}, '__', '/'), '-[^-]*$', '')"
_STRIP = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def _strip(c):
    return _STRIP.format(c=c)


def _em(test, status):
    return f"[{{'test': {test}, 'status': {status}}}]"


_E = "[]::STRUCT(test VARCHAR, status VARCHAR)[]"
_SW = "(starts_with({c}, 'FAILED') OR starts_with({c}, 'PASSED') OR starts_with({c}, 'SKIPPED') " \
      "OR starts_with({c}, 'ERROR') OR starts_with({c}, 'XFAIL'))"
_EW = "(ends_with({c}, 'FAILED') OR ends_with({c}, 'PASSED') OR ends_with({c}, 'SKIPPED') " \
      "OR ends_with({c}, 'ERROR') OR ends_with({c}, 'XFAIL'))"


def _strip_suffix(x, suf):
    return (f"(CASE WHEN contains({x}, '{suf}') THEN left({x}, length({x}) - strpos(reverse({x}), "
            f"reverse('{suf}')) - {len(suf)} + 1) ELSE {x} END)")


_OPT = """(CASE WHEN regexp_matches(XX, '\\[.*\\]') THEN regexp_extract(XX, '^(.*?)\\[(.*)\\]', 1) || '[' ||
   (CASE WHEN starts_with(regexp_extract(XX, '^(.*?)\\[(.*)\\]', 2), '/')
          AND NOT starts_with(regexp_extract(XX, '^(.*?)\\[(.*)\\]', 2), '//')
          AND NOT contains(regexp_extract(XX, '^(.*?)\\[(.*)\\]', 2), '*')
         THEN '/' || string_split(regexp_extract(XX, '^(.*?)\\[(.*)\\]', 2), '/')[-1]
         ELSE regexp_extract(XX, '^(.*?)\\[(.*)\\]', 2) END) || ']' ELSE XX END)"""

_SPECIAL = "Applying sites.0002_alter_domain_unique...test_no_migrations"

_PARSE_CTES = f"""
rules AS (SELECT * FROM (VALUES {_RULES_VALUES}) AS t(repo, rule)),
ruled AS (SELECT l.instance_id, l.repo, l.content, r.rule FROM logs l LEFT JOIN rules r USING (repo)),
applied AS (
  SELECT instance_id, rule, content,
         coalesce(NOT (contains(content, '>>>>> Patch Apply Failed') OR contains(content, '>>>>> Reset Failed')
                  OR contains(content, '>>>>> Tests Errored') OR contains(content, '>>>>> Tests Timed Out')
                  OR contains(content, 'Failed to reset task environment'))
                  AND contains(lower(content), 'applied patch'), false) AS applied
  FROM ruled),
outp AS (
  SELECT instance_id, rule, applied,
         CASE WHEN applied THEN string_split(content, '>>>>> Applied Patch (pred)')[-1] END AS test_output
  FROM applied),
lines0 AS (
  SELECT instance_id, rule, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS pos
  FROM (SELECT instance_id, rule, string_split(test_output, chr(10)) AS parts FROM outp
        WHERE test_output IS NOT NULL)),
lines1 AS (
  SELECT *, {_strip('line')} AS s,
         CASE rule WHEN 'rewrite' THEN replace(replace(line, 'MouseButton.LEFT', '1'), 'MouseButton.RIGHT', '3')
                   WHEN 'ansi' THEN regexp_replace(regexp_replace(line, '\\[(\\d+)m', '', 'g'), '[\\x01-\\x1f]', '', 'g')
                   ELSE line END AS pre
  FROM lines0),
lines2 AS (
  SELECT *,
         {_SW.format(c='pre')} AS sw, {_EW.format(c='pre')} AS ew,
         regexp_extract_all(CASE WHEN starts_with(pre, 'FAILED') THEN replace(pre, ' - ', ' ') ELSE pre END, '\\S+') AS tkd,
         regexp_extract_all(pre, '\\S+') AS tk,
         regexp_extract_all(s, '\\S+') AS tks,
         CASE WHEN ends_with(s, '[FAIL]') OR ends_with(s, '[OK]')
              THEN {_strip("regexp_replace(s, '\\[[^\\[]*$', '')")} ELSE s END AS cut,
         CASE WHEN starts_with(s, '{_SPECIAL}') THEN {_strip("substr(s, strpos(s, '...') + 3)")} ELSE s END AS s_pass,
         CASE WHEN rule = 'verbose' THEN last_value(CASE WHEN contains(s, ' ... ') THEN split_part(s, ' ... ', 1) END IGNORE NULLS)
              OVER (PARTITION BY instance_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS prev_test
  FROM lines1),
lines3 AS (
  SELECT instance_id, pos, CASE
    WHEN rule IN ('pytest', 'rewrite') THEN CASE WHEN sw AND len(tkd) > 1 THEN {_em('tkd[2]', 'tkd[1]')} ELSE {_E} END
    WHEN rule = 'options' THEN CASE WHEN sw AND len(tkd) > 1 THEN {_em(_OPT.replace('XX', 'tkd[2]'), 'tkd[1]')} ELSE {_E} END
    WHEN rule = 'ansi' THEN CASE WHEN sw THEN CASE WHEN len(tkd) > 1 THEN {_em('tkd[2]', 'tkd[1]')} ELSE {_E} END
                                 WHEN ew AND len(tk) > 1 THEN {_em('tk[1]', 'tk[2]')} ELSE {_E} END
    WHEN rule = 'mixed' THEN CASE WHEN starts_with(line, 'FAILED') THEN CASE WHEN len(tk) > 1 THEN {_em('tk[2]', "'FAILED'")} ELSE {_E} END
                                  WHEN contains(line, ' PASSED ') THEN CASE WHEN tk[2] = 'PASSED' THEN {_em('tk[1]', "'PASSED'")} ELSE {_E} END
                                  WHEN starts_with(line, 'PASSED') AND len(tk) > 1 THEN {_em('tk[2]', "'PASSED'")} ELSE {_E} END
    WHEN rule = 'framed' THEN CASE WHEN starts_with(s, 'test_') THEN CASE
                                  WHEN ends_with(cut, ' E') THEN {_em("regexp_extract_all(cut, '\\S+')[1]", "'ERROR'")}
                                  WHEN ends_with(cut, ' F') THEN {_em("regexp_extract_all(cut, '\\S+')[1]", "'FAILED'")}
                                  WHEN ends_with(cut, ' ok') THEN {_em("regexp_extract_all(cut, '\\S+')[1]", "'PASSED'")}
                                  ELSE {_E} END ELSE {_E} END
    WHEN rule = 'verbose' THEN
      (CASE WHEN contains(s, '--version is equivalent to version') THEN {_em("'--version is equivalent to version'", "'PASSED'")} ELSE {_E} END)
      || (CASE WHEN ends_with(s, ' ... ok') THEN {_em(_strip_suffix('s_pass', ' ... ok'), "'PASSED'")}
               WHEN ends_with(s, ' ... OK') THEN {_em(_strip_suffix('s_pass', ' ... OK'), "'PASSED'")}
               WHEN ends_with(s, ' ...  OK') THEN {_em(_strip_suffix('s_pass', ' ...  OK'), "'PASSED'")} ELSE {_E} END)
      || (CASE WHEN contains(s, ' ... skipped') THEN {_em("split_part(s, ' ... skipped', 1)", "'SKIPPED'")} ELSE {_E} END)
      || (CASE WHEN ends_with(s, ' ... FAIL') THEN {_em("split_part(s, ' ... FAIL', 1)", "'FAILED'")} ELSE {_E} END)
      || (CASE WHEN starts_with(s, 'FAIL:') AND len(tks) > 1 THEN {_em('tks[2]', "'FAILED'")} ELSE {_E} END)
      || (CASE WHEN ends_with(s, ' ... ERROR') THEN {_em("split_part(s, ' ... ERROR', 1)", "'ERROR'")} ELSE {_E} END)
      || (CASE WHEN starts_with(s, 'ERROR:') AND len(tks) > 1 THEN {_em('tks[2]', "'ERROR'")} ELSE {_E} END)
      || (CASE WHEN starts_with(s, 'ok') AND prev_test IS NOT NULL THEN {_em('prev_test', "'PASSED'")} ELSE {_E} END)
    ELSE {_E} END AS em
  FROM lines2),
line_em AS (
  SELECT instance_id, pos * 1000 + sub - 1 AS ord, e.test AS test_case, e.status AS status
  FROM (SELECT instance_id, pos, unnest(em) AS e, generate_subscripts(em, 1) AS sub FROM lines3)),
framed_em AS (
  SELECT instance_id, -1000000000 + sub - 1 AS ord, a || '.py:' || b AS test_case, 'FAILED' AS status
  FROM (SELECT instance_id, unnest(ga) AS a, unnest(gb) AS b, generate_subscripts(ga, 1) AS sub
        FROM (SELECT instance_id, regexp_extract_all(test_output, '{FRAMED_PATTERN}', 2) AS ga,
                     regexp_extract_all(test_output, '{FRAMED_PATTERN}', 3) AS gb
              FROM outp WHERE rule = 'framed' AND test_output IS NOT NULL))),
""" + ",\n".join(f"""verbose_em{i} AS (
  SELECT instance_id, {10 ** 12 * (i + 1)} + sub - 1 AS ord, test_case, 'PASSED' AS status
  FROM (SELECT instance_id, unnest(g) AS test_case, generate_subscripts(g, 1) AS sub
        FROM (SELECT instance_id, regexp_extract_all(test_output, '{p}', 1) AS g
              FROM outp WHERE rule = 'verbose' AND test_output IS NOT NULL)))"""
                 for i, p in enumerate(VERBOSE_BLOB_PATTERNS)) + """,
parsed AS (
  SELECT instance_id, test_case, arg_max(status, ord) AS status FROM (
    SELECT * FROM line_em UNION ALL SELECT * FROM framed_em
    UNION ALL SELECT * FROM verbose_em0 UNION ALL SELECT * FROM verbose_em1 UNION ALL SELECT * FROM verbose_em2)
  GROUP BY instance_id, test_case)"""

_STATUS_MAP = """
smap AS (SELECT instance_id, test_case, arg_max(status, line_no) AS status FROM status_rows GROUP BY ALL)"""


def _graded_cte(name, exp, st):
    return f"""
{name} AS (
  SELECT e.instance_id, e.category, e.test_case, s.status,
         CASE WHEN s.status IN ('PASSED', 'XFAIL') THEN 'success'
              WHEN s.status IS NULL OR s.status IN ('FAILED', 'ERROR') THEN 'failure' ELSE 'neither' END AS outcome
  FROM {exp} e LEFT JOIN {st} s USING (instance_id, test_case)
  WHERE e.category IN ('FAIL_TO_PASS', 'PASS_TO_PASS'))"""


def _rates_cte(name, graded, inst):
    return f"""
{name} AS (
  SELECT i.instance_id,
    CASE WHEN coalesce(f2p_s, 0) + coalesce(f2p_f, 0) = 0 THEN 1.0 ELSE f2p_s / (f2p_s + f2p_f) END AS f2p_rate,
    CASE WHEN coalesce(p2p_s, 0) + coalesce(p2p_f, 0) = 0 THEN 1.0 ELSE p2p_s / (p2p_s + p2p_f) END AS p2p_rate
  FROM (SELECT DISTINCT instance_id FROM {inst}) i LEFT JOIN (
    SELECT instance_id,
      count(*) FILTER (WHERE category = 'FAIL_TO_PASS' AND outcome = 'success') AS f2p_s,
      count(*) FILTER (WHERE category = 'FAIL_TO_PASS' AND outcome = 'failure') AS f2p_f,
      count(*) FILTER (WHERE category = 'PASS_TO_PASS' AND outcome = 'success') AS p2p_s,
      count(*) FILTER (WHERE category = 'PASS_TO_PASS' AND outcome = 'failure') AS p2p_f
    FROM {graded} GROUP BY instance_id) g USING (instance_id))"""


_RESOLUTION = """CASE WHEN f2p_rate = 1 AND p2p_rate = 1 THEN 'RESOLVED_FULL'
     WHEN f2p_rate < 1 AND f2p_rate > 0 AND p2p_rate = 1 THEN 'RESOLVED_PARTIAL' ELSE 'RESOLVED_NO' END"""

_LIST_COLS = [(c, n) for c, n in (("FAIL_TO_PASS", "f2p"), ("PASS_TO_PASS", "p2p"),
                                  ("FAIL_TO_FAIL", "f2f"), ("PASS_TO_FAIL", "p2f"))]

_REPORT_CTES = _PARSE_CTES + """,
base AS (
  SELECT p.instance_id, p.model_patch, o.applied FROM predictions p JOIN outp o USING (instance_id)),
applied_ids AS (SELECT instance_id FROM base WHERE applied AND model_patch IS NOT NULL),
""" + _graded_cte("rgraded", "(SELECT * FROM expected_tests WHERE instance_id IN (SELECT instance_id FROM applied_ids))",
                  "parsed").strip() + ",\n" + _rates_cte("rrates", "rgraded", "applied_ids").strip() + """,
rlists AS (
  SELECT instance_id, """ + ",\n    ".join(
    f"array_to_string(list_sort(list(test_case) FILTER (WHERE category = '{c}' AND outcome = '{o}')), ',') AS {n}_{o}"
    for c, n in _LIST_COLS for o in ("success", "failure")) + """
  FROM rgraded GROUP BY instance_id),
reports AS (
  SELECT b.instance_id, b.model_patch IS NULL AS patch_is_null, b.model_patch IS NOT NULL AS patch_exists,
         b.model_patch IS NOT NULL AND b.applied AS patch_applied,
         coalesce(b.model_patch IS NOT NULL AND b.applied AND """ + _RESOLUTION.replace("\n", " ") + """ = 'RESOLVED_FULL', false) AS resolved,
         """ + ",\n         ".join(f"coalesce({n}_{o}, '') AS {n}_{o}" for _, n in _LIST_COLS
                                   for o in ("success", "failure")) + """
  FROM base b LEFT JOIN rrates USING (instance_id) LEFT JOIN rlists USING (instance_id)),
classes AS (
  SELECT d.instance_id,
         CASE WHEN p.instance_id IS NULL THEN 'incomplete'
              WHEN coalesce(p.model_patch, '') = '' THEN 'empty_patch'
              WHEN r.resolved IS NULL THEN 'error'
              WHEN r.resolved THEN 'resolved' ELSE 'unresolved' END AS status
  FROM (SELECT DISTINCT instance_id FROM eval_instances) d
  LEFT JOIN predictions p USING (instance_id) LEFT JOIN reports r USING (instance_id))"""

_RV = ["logs", "predictions", "expected_tests", "eval_instances"]

ORACLE["applied_logs"] = with_views(["logs"], _PARSE_CTES) + \
    "\nSELECT instance_id, applied, test_output FROM outp"
ORACLE["rule_lookup"] = with_views(["logs"], _PARSE_CTES) + "\nSELECT instance_id, repo, rule FROM ruled"
ORACLE["repo_of"] = with_views(["eval_instances"]) + \
    f"\nSELECT instance_id, {_REPO_OF.format(c='instance_id')} AS repo FROM eval_instances"
ORACLE["parse_logs"] = with_views(["logs"], _PARSE_CTES) + "\nSELECT * FROM parsed"
ORACLE["status_map"] = with_views(["status_rows"], _STATUS_MAP) + "\nSELECT * FROM smap"
ORACLE["grade_tests"] = with_views(["status_rows", "expected_tests"], _STATUS_MAP,
                                   _graded_cte("graded", "expected_tests", "smap")) + "\nSELECT * FROM graded"
ORACLE["test_rates"] = with_views(
    ["status_rows", "expected_tests", "predictions"], _STATUS_MAP,
    _graded_cte("graded", "expected_tests", "smap"), _rates_cte("rates", "graded", "predictions")) + \
    "\nSELECT instance_id, round(f2p_rate, 6) AS f2p_rate, round(p2p_rate, 6) AS p2p_rate FROM rates"
ORACLE["resolution"] = with_views(
    ["status_rows", "expected_tests", "predictions"], _STATUS_MAP,
    _graded_cte("graded", "expected_tests", "smap"), _rates_cte("rates", "graded", "predictions")) + \
    f"\nSELECT instance_id, {_RESOLUTION} AS resolution FROM rates"
ORACLE["instance_reports"] = with_views(_RV, _REPORT_CTES) + "\nSELECT * FROM reports"
ORACLE["run_report"] = with_views(_RV, _REPORT_CTES) + "\nSELECT * FROM classes"
ORACLE["run_report_counts"] = with_views(_RV, _REPORT_CTES) + """
SELECT count(*) FILTER (WHERE in_ds) AS total_instances,
       count(*) FILTER (WHERE is_pred) AS submitted_instances,
       count(*) FILTER (WHERE is_pred AND in_ds) AS submitted_in_dataset,
       count(*) FILTER (WHERE status IN ('resolved', 'unresolved')) AS completed_instances,
       count(*) FILTER (WHERE status = 'resolved') AS resolved_instances,
       count(*) FILTER (WHERE status = 'unresolved') AS unresolved_instances,
       count(*) FILTER (WHERE status = 'empty_patch') AS empty_patch_instances,
       count(*) FILTER (WHERE status = 'error') AS error_instances,
       count(*) FILTER (WHERE status = 'incomplete') AS incomplete_instances,
       2 AS schema_version
FROM (SELECT coalesce(d.instance_id, p.instance_id) AS instance_id, d.in_ds, p.is_pred
      FROM (SELECT DISTINCT instance_id, true AS in_ds FROM eval_instances) d
      FULL OUTER JOIN (SELECT DISTINCT instance_id, true AS is_pred FROM predictions) p USING (instance_id)) x
LEFT JOIN classes USING (instance_id)"""
ORACLE["resolved_rate"] = with_views(_RV, _REPORT_CTES) + """
SELECT n_resolved, round(n_resolved / n_total, 6) AS rate, n_resolved_subset,
       round(n_resolved_subset / n_subset, 6) AS rate_subset
FROM (SELECT count(*) FILTER (WHERE ok) AS n_resolved, count(*) AS n_total,
             count(*) FILTER (WHERE ok AND in_subset) AS n_resolved_subset, count(*) FILTER (WHERE in_subset) AS n_subset
      FROM (SELECT DISTINCT e.instance_id, coalesce(e.in_subset, false) AS in_subset,
                   e.instance_id IN (SELECT instance_id FROM reports WHERE resolved) AS ok
            FROM eval_instances e))"""
ORACLE["edit_histogram"] = with_views(_RV, _REPORT_CTES) + """
SELECT length(patch) - length(replace(patch, '@', '')) AS n_marks, count(*) AS n_instances
FROM eval_instances WHERE instance_id IN (SELECT instance_id FROM reports WHERE resolved)
GROUP BY 1"""
ORACLE["gold_predictions"] = with_views(["eval_instances"]) + \
    "\nSELECT instance_id, patch AS model_patch, 'gold' AS model_name_or_path FROM eval_instances"
ORACLE["non_empty_predictions"] = with_views(["predictions"]) + \
    "\nSELECT * FROM predictions WHERE coalesce(model_patch, '') <> ''"
ORACLE["select_work"] = with_views(_RV, _REPORT_CTES) + """
SELECT p.instance_id, p.model_patch FROM eval_instances d JOIN predictions p USING (instance_id)
WHERE p.instance_id NOT IN (SELECT instance_id FROM reports) AND coalesce(p.model_patch, '') <> ''"""
ORACLE["skip_existing"] = with_views(_RV, _REPORT_CTES) + """
SELECT instance_id FROM predictions WHERE instance_id NOT IN (SELECT instance_id FROM reports)"""
ORACLE["missing_ids"] = with_views(["eval_instances", "predictions"]) + """
SELECT DISTINCT instance_id FROM eval_instances WHERE instance_id NOT IN (SELECT instance_id FROM predictions)"""
ORACLE["common_ids"] = with_views(["eval_instances", "predictions"]) + """
SELECT instance_id FROM predictions INTERSECT SELECT instance_id FROM eval_instances"""
