"""DuckDB twins of the stand-in views in ``fixfold.sources.adapters``.

Each constant is a CTE body (``name AS (...)``) that reads the pre-registered
driver views; oracle queries prepend the ones they need with ``with_views``.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {}

VIEWS["attempts"] = """
attempts AS (
  SELECT l_orderkey AS instance_id,
         CASE WHEN l_suppkey % 12 >= 10 THEN 'django_r' ELSE 'r' END || CAST(l_suppkey % 12 AS VARCHAR) AS run_id,
         CASE WHEN l_linenumber % 5 = 0
              THEN '+' || l_returnflag || chr(10) || '+' || l_returnflag || chr(10) || '-' || l_linestatus
              ELSE '+' || l_returnflag || chr(10) || '-' || l_linestatus END AS patch,
         l_returnflag = 'R' AS resolved
  FROM lineitem)"""

VIEWS["dataset_ids"] = """
dataset_ids AS (SELECT o_orderkey AS instance_id FROM orders)"""

VIEWS["subset_ids"] = """
subset_ids AS (SELECT o_orderkey AS instance_id FROM orders WHERE o_orderpriority = '1-URGENT')"""

_REPOS = ("['pytest-dev/pytest', 'psf/requests', 'django/django', 'astropy/astropy', "
          "'mwaskom/seaborn', 'sympy/sympy', 'matplotlib/matplotlib']")


def _repo(k: str) -> str:
    return f"({_REPOS})[{k} % 7 + 1]"


def _inst(k: str) -> str:
    return f"(replace({_repo(k)}, '/', '__') || '-' || CAST({k} AS VARCHAR))"


_STATUS = """(CASE WHEN event_type IN ('view', 'click') THEN 'PASSED' WHEN event_type = 'purchase' THEN 'XFAIL'
  WHEN event_type = 'signup' THEN 'SKIPPED' WHEN event_id % 2 = 0 THEN 'ERROR' ELSE 'FAILED' END)"""


def _test(d: str, n: str, rendered: bool) -> str:
    t = f"('tests/test_m.py::t' || CAST({n} AS VARCHAR))"
    if rendered:
        opt = (f"({t} || '[/tmp/d' || CAST(event_id % 5 AS VARCHAR) || '/case' || "
               f"CAST(({n}) % 3 AS VARCHAR) || '.txt]')")
        mouse = f"({t} || CASE WHEN event_id % 2 = 0 THEN '[MouseButton.LEFT]' ELSE '[MouseButton.RIGHT]' END)"
    else:
        opt = f"({t} || '[/case' || CAST(({n}) % 3 AS VARCHAR) || '.txt]')"
        mouse = f"({t} || '[1]')"
    return (f"(CASE WHEN {d} = 1 THEN {opt} WHEN {d} = 2 THEN 'test_t' || CAST({n} AS VARCHAR) || ' (m.T)' "
            f"WHEN {d} = 5 THEN 'test_t' || CAST({n} AS VARCHAR) WHEN {d} = 6 THEN {mouse} ELSE {t} END)")


VIEWS["status_rows"] = f"""
status_rows AS (
  SELECT {_inst('user_id')} AS instance_id, event_id AS line_no,
         {_test('user_id % 7', 'event_id % 13', False)} AS test_case, {_STATUS} AS status
  FROM events)"""

VIEWS["expected_tests"] = f"""
expected_tests AS (
  SELECT DISTINCT {_inst('user_id')} AS instance_id,
         CASE WHEN ((event_id + 5) % 14) % 5 = 0 THEN 'FAIL_TO_PASS'
              WHEN ((event_id + 5) % 14) % 5 <= 2 THEN 'PASS_TO_PASS'
              WHEN ((event_id + 5) % 14) % 5 = 3 THEN 'FAIL_TO_FAIL' ELSE 'PASS_TO_FAIL' END AS category,
         {_test('user_id % 7', '(event_id + 5) % 14', False)} AS test_case
  FROM events)"""

_T = _test("user_id % 7", "event_id % 13", True)
_SKIP_WORD = "'skipped ''why'''"
_LINE = f"""(CASE
  WHEN user_id % 7 = 2 THEN {_T} || ' ... ' || CASE {_STATUS}
        WHEN 'PASSED' THEN CASE WHEN event_id % 4 = 0 THEN 'noise' || chr(10) || 'ok' ELSE 'ok' END
        WHEN 'FAILED' THEN 'FAIL' WHEN 'ERROR' THEN 'ERROR' WHEN 'SKIPPED' THEN {_SKIP_WORD}
        ELSE 'expected failure' END
  WHEN user_id % 7 = 3 THEN CASE WHEN event_id % 2 = 0
        THEN chr(27) || '[32m' || {_STATUS} || chr(27) || '[0m ' || {_T}
        ELSE {_T} || ' ' || {_STATUS} END
  WHEN user_id % 7 = 4 THEN CASE {_STATUS} WHEN 'PASSED' THEN {_T} || ' PASSED [ 50%]'
        WHEN 'FAILED' THEN 'FAILED ' || {_T} || ' - y' ELSE {_STATUS} || ' ' || {_T} END
  WHEN user_id % 7 = 5 THEN CASE {_STATUS}
        WHEN 'FAILED' THEN '____ p/test_m.py:' || {_T} || ' ____' || chr(10) || {_T} || ' F'
        WHEN 'ERROR' THEN {_T} || ' E'
        WHEN 'PASSED' THEN {_T} || ' ok' || CASE WHEN event_id % 3 = 0 THEN ' [OK]' ELSE '' END
        ELSE {_T} || ' s' END
  WHEN user_id % 7 = 0 THEN {_STATUS} || ' ' || {_T}
        || CASE WHEN {_STATUS} = 'FAILED' THEN ' - AssertionError: boom' ELSE '' END
  ELSE {_STATUS} || ' ' || {_T} END)"""

VIEWS["logs"] = f"""
logs AS (
  SELECT {_inst('user_id')} AS instance_id, {_repo('user_id')} AS repo,
         'PASSED tests/pre.py::ignored' || chr(10)
         || CASE WHEN user_id % 11 = 0 THEN '>>>>> Patch Apply Failed' ELSE '>>>>> Applied Patch (pred)' END
         || chr(10) || string_agg(line, chr(10) ORDER BY event_id) AS content
  FROM (SELECT user_id, event_id, {_LINE} AS line FROM events)
  GROUP BY user_id)"""

VIEWS["predictions"] = f"""
predictions AS (
  SELECT {_inst('user_id')} AS instance_id, 'm1' AS model_name_or_path,
         CASE WHEN user_id % 9 = 0 THEN NULL WHEN user_id % 9 = 1 THEN ''
              ELSE 'diff --git a/f' || CAST(user_id AS VARCHAR) || '.py b/f' || CAST(user_id AS VARCHAR) || '.py'
         END AS model_patch
  FROM (SELECT DISTINCT user_id FROM events))"""

VIEWS["eval_instances"] = f"""
eval_instances AS (
  SELECT {_inst('c_custkey')} AS instance_id, {_repo('c_custkey')} AS repo,
         repeat('@@ -1 +1 @@' || chr(10), CAST(c_nationkey % 4 + 1 AS INTEGER)) AS patch,
         c_mktsegment = 'BUILDING' AS in_subset
  FROM customer)"""


VIEWS["patches"] = """
patches AS (
  WITH l0 AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS i
              FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)),
  l1 AS (SELECT doc_id, i, line, CASE i % 3 WHEN 0 THEN ' ' WHEN 1 THEN '+' ELSE '-' END AS pre,
                (i // 6) % (doc_id % 3 + 1) AS f, (i // 6) // (doc_id % 3 + 1) AS k FROM l0),
  hk AS (SELECT doc_id, f, k,
                '@@ -' || CAST(k * 10 + 1 AS VARCHAR) || ',' || CAST(count(*) FILTER (WHERE pre IN (' ', '-')) AS VARCHAR)
                || ' +' || CAST(k * 10 + 1 AS VARCHAR) || ',' || CAST(count(*) FILTER (WHERE pre IN (' ', '+')) AS VARCHAR)
                || ' @@' || chr(10) || string_agg(pre || line, chr(10) ORDER BY i) AS htext
         FROM l1 GROUP BY doc_id, f, k),
  fl AS (SELECT doc_id, f,
                CASE WHEN (doc_id + f) % 2 = 0 THEN 'src/pkg/mod' || CAST(f AS VARCHAR) || '.py'
                     ELSE 'tests/test_mod' || CAST(f AS VARCHAR) || '.py' END AS path,
                string_agg(htext, chr(10) ORDER BY k) AS body
         FROM hk GROUP BY doc_id, f)
  SELECT doc_id, string_agg('diff --git a/' || path || ' b/' || path || chr(10)
           || CASE WHEN (doc_id + f) % 7 = 0 THEN '--- /dev/null' ELSE '--- a/' || path END
           || chr(10) || '+++ b/' || path || chr(10) || body, chr(10) ORDER BY f) || chr(10) AS patch
  FROM fl GROUP BY doc_id)"""

VIEWS["instances"] = """
instances AS (
  SELECT replace(source || '/' || lang, '/', '__') || '-' || CAST(d.doc_id AS VARCHAR) AS instance_id,
         source || '/' || lang AS repo, d.doc_id AS pull_number,
         text || CASE d.doc_id % 4 WHEN 0 THEN ' fixes #' || CAST(d.doc_id % 50 AS VARCHAR)
                                  WHEN 1 THEN ' Closes #' || CAST(d.doc_id % 50 AS VARCHAR) || ' <!-- closes #9 -->'
                                  WHEN 2 THEN ' see http://x/y.png'
                                  ELSE ' see #' || CAST(d.doc_id % 50 AS VARCHAR) END AS problem_statement,
         CASE d.doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '+    with pytest.raises(ValueError, match="bad"):'
              WHEN 2 THEN '+        self.assertRaises(KeyError)' WHEN 3 THEN '+    with pytest.raises(ValueError):'
              ELSE '+def test_ok():' || chr(10) || '+    assert f() == 1' END AS test_patch,
         TIMESTAMP '2020-01-01 00:00:00' + d.doc_id * INTERVAL 1 HOUR AS created_at,
         p.patch
  FROM documents d JOIN patches p ON p.doc_id = d.doc_id)"""

VIEWS["issues"] = """
issues AS (SELECT source || '/' || lang AS repo, doc_id AS number FROM documents)"""

def with_views(names: list[str], *ctes: str) -> str:
    """``WITH`` clause holding the named views followed by extra CTEs."""
    parts = [VIEWS[n].strip() for n in names] + [c.strip() for c in ctes]
    return "WITH " + ",\n".join(parts)
