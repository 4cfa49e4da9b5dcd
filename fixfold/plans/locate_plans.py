"""Registered queries for locate → excerpt → edit and the code jobs, with
DuckDB twins where SQL can express them (the ``ast``/``difflib`` steps are
rows-only and covered by fixture tests)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixfold.functions.text import PY_WS
from fixfold.operators import code as CD
from fixfold.operators import locate as LC
from fixfold.plans.views_sql import VIEWS, with_views
from fixfold.sources import adapters as A
from fixfold.sources.tables import Tables

QUERIES = {}
ORACLE = {}


def _locs(spark, sf):
    return LC.parse_locations(A.locate_answers(spark, sf))


def _spans(spark, sf):
    locs = _locs(spark, sf)
    return LC.resolve_locations(LC.location_lines(locs), A.code_symbols(spark, sf), A.code_lines(spark, sf))


def _kept(spark, sf):
    return LC.kept_locations(_spans(spark, sf), _locs(spark, sf))


def _final_spans(spark, sf):
    spans = _spans(spark, sf).join(_kept(spark, sf), ["instance_id", "loc_pos"], "left_semi")
    return LC.drop_contained(spans)


def q_parse_locations(spark, sf):
    return _locs(spark, sf)


def q_resolve_locations(spark, sf):
    return _spans(spark, sf)


def q_kept_locations(spark, sf):
    return _kept(spark, sf)


def q_drop_contained(spark, sf):
    return _final_spans(spark, sf).select("instance_id", "file", "start", "end", "loc_pos", "line_pos")


def q_span_text(spark, sf):
    locs = _locs(spark, sf).join(_kept(spark, sf), ["instance_id", "loc_pos"], "left_semi")
    return LC.span_text(_final_spans(spark, sf), locs, A.code_lines(spark, sf))


def _edits(spark, sf):
    return LC.parse_edits(A.edit_answers(spark, sf), A.code_files(spark, sf))


def q_parse_edits(spark, sf):
    return _edits(spark, sf)


def q_apply_edits(spark, sf):
    return LC.apply_edits(_edits(spark, sf), A.code_files(spark, sf)).select("instance_id", "attempt", "file", "new")


def q_edit_diff(spark, sf):
    return LC.edit_diff(LC.apply_edits(_edits(spark, sf), A.code_files(spark, sf)))


def q_found_files(spark, sf):
    """P13 + L3 over file-localisation answers: each task's answer lists, inside
    a fence, its own module, a blank line and five more names."""
    f = A.code_files(spark, sf)
    others = F.concat_ws("\n", *[F.concat(F.lit(f"pkg{j}/__init__.py")) for j in range(4)])
    answers = f.select("instance_id", F.concat(F.lit("Files:\n```\n"), F.col("path"), F.lit("\n\n"), others,
                                                F.lit("\nsetup.py\n```\nDone.")).alias("answer"))
    return answers.select("instance_id", F.array_join(LC.top_files(LC.fenced_list(F.col("answer")), 5), ",")
                          .alias("files"))


def q_with_content(spark, sf):
    f = A.code_files(spark, sf)
    want = f.select("instance_id", "path")
    return LC.with_content(want, f.select("instance_id", "path", "text"))


def q_encode_documents(spark, sf):
    return CD.encode_documents(A.code_files(spark, sf)).select("instance_id", "path", "contents")


def q_encode_docstrings(spark, sf):
    return CD.encode_documents(A.code_files(spark, sf), style="docstrings").select("instance_id", "path", "contents")


def q_code_skeleton(spark, sf):
    return CD.code_skeleton(A.code_files(spark, sf)).select("instance_id", "path", "skeleton")


def q_skeleton_bundle(spark, sf):
    sk = CD.code_skeleton(A.code_files(spark, sf))
    return CD.skeleton_bundle(sk.select("instance_id", "path", "skeleton"), key="instance_id")


def q_import_edges(spark, sf):
    f = A.code_files(spark, sf).select("repo", "path", "text")
    return CD.import_edges(f, key="repo")


def _graph(spark, sf):
    """Orders as files that include each other: each by the order of a quarter of
    its key, neighbours mutually (cycles).  Grows with the orders."""
    o, k = Tables(spark, sf).orders, F.col("o_orderkey")
    edges = o.select(F.floor(k / 4).alias("src"), k.alias("dst")).unionByName(
        o.select(k.alias("src"), (k + 1 - 2 * (k % 2)).alias("dst")))
    return edges, o.select(k.alias("root"))


def q_reachable(spark, sf):
    e, r = _graph(spark, sf)
    return CD.reachable(e, r)


def q_tree_listing(spark, sf):
    return CD.tree_listing(A.code_files(spark, sf).select("repo", "path"), key="repo")


QUERIES.update({
    "parse_locations": q_parse_locations, "resolve_locations": q_resolve_locations,
    "kept_locations": q_kept_locations, "drop_contained": q_drop_contained, "span_text": q_span_text,
    "parse_edits": q_parse_edits, "apply_edits": q_apply_edits, "edit_diff": q_edit_diff,
    "found_files": q_found_files, "with_content": q_with_content, "encode_documents": q_encode_documents,
    "encode_docstrings": q_encode_docstrings, "code_skeleton": q_code_skeleton,
    "skeleton_bundle": q_skeleton_bundle, "import_edges": q_import_edges, "reachable": q_reachable,
    "tree_listing": q_tree_listing,
})

# ---------------------------------------------------------------- DuckDB twins

_INST = "replace(source || '/' || lang, '/', '__') || '-' || CAST(doc_id AS VARCHAR)"
_PATH = """(CASE WHEN doc_id % 50 = 0 THEN 'docs/README_' || CAST(doc_id AS VARCHAR) || '.md'
      WHEN doc_id % 7 = 0 THEN 'pkg' || CAST(doc_id % 5 AS VARCHAR) || '/tests/test_' || CAST(doc_id AS VARCHAR) || '.py'
      ELSE 'pkg' || CAST(doc_id % 5 AS VARCHAR) || '/mod_' || CAST(doc_id AS VARCHAR) || '.py' END)"""


def _strip(x):
    return f"regexp_replace({x}, '^{PY_WS}+|{PY_WS}+$', '', 'g')"


VIEWS["code_lines"] = f"""
code_lines AS (
  SELECT instance_id, repo, path, i + 1 AS line_no,
    CASE i % 12 WHEN 0 THEN 'class C' || CAST(i AS VARCHAR) || ':'
      WHEN 1 THEN '    \"\"\"' || regexp_replace(line, '[^\\p{{L}} ]', '', 'g') || '\"\"\"'
      WHEN 2 THEN '    def m' || CAST(i AS VARCHAR) || '(self):'
      WHEN 3 THEN '        x = ' || CAST(length(line) AS VARCHAR)
      WHEN 4 THEN '        return x'
      WHEN 5 THEN '    def m' || CAST(i AS VARCHAR) || '(self):'
      WHEN 6 THEN '        return ' || CAST(length(line) AS VARCHAR)
      WHEN 7 THEN 'V' || CAST(i AS VARCHAR) || ' = ' || CAST(length(line) AS VARCHAR)
      WHEN 8 THEN 'def f' || CAST(i AS VARCHAR) || '():'
      WHEN 9 THEN '    y = ' || CAST(length(line) AS VARCHAR)
      WHEN 10 THEN '    return y'
      ELSE 'from pkg' || CAST((i // 12) % 5 AS VARCHAR) || ' import mod' END AS text
  FROM (SELECT {_INST} AS instance_id, source || '/' || lang AS repo, {_PATH} AS path,
               unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
        FROM documents))"""

VIEWS["code_files"] = """
code_files AS (SELECT instance_id, repo, path, string_agg(text, chr(10) ORDER BY line_no) AS text
               FROM code_lines GROUP BY ALL)"""

VIEWS["code_symbols"] = f"""
code_symbols AS (
  SELECT instance_id, path,
         CASE WHEN i % 12 = 0 THEN 'class' WHEN i % 12 IN (2, 5) THEN 'method' ELSE 'function' END AS kind,
         CASE WHEN i % 12 IN (2, 5) THEN 'C' || CAST(i - i % 12 AS VARCHAR) END AS cls,
         CASE WHEN i % 12 = 0 THEN 'C' WHEN i % 12 IN (2, 5) THEN 'm' ELSE 'f' END || CAST(i AS VARCHAR) AS name,
         i + 1 AS start,
         least(i + 1 + CASE i % 12 WHEN 0 THEN 6 WHEN 2 THEN 2 WHEN 5 THEN 1 ELSE 2 END, n) AS "end"
  FROM (SELECT {_INST} AS instance_id, {_PATH} AS path, len(string_split(text, chr(10))) AS n,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)
  WHERE i % 12 IN (0, 2, 5, 8))"""


_BLOCK = """'# ' || p || chr(10) || 'function: f' || (k * 12 + 8) || chr(10) || chr(10) || chr(10) || '# ' || p || chr(10)
  || 'class: C' || (k * 12) || chr(10) || 'method: m' || (k * 12 + 2) || chr(10) || chr(10) || chr(10) || '# ' || p
  || chr(10) || 'variable: V' || (k * 12 + 7) || chr(10) || chr(10) || chr(10) || '# ' || p || chr(10)
  || 'class: C' || (k * 12 + 12)"""


VIEWS["locate_answers"] = f"""
locate_answers AS (
  SELECT instance_id, 'Here:' || chr(10) || '```' || chr(10) || '# docs/README.md' || chr(10) || 'function: x'
         || chr(10) || chr(10) || chr(10) || array_to_string(list_transform(range(0, n), lambda k: {_BLOCK}), chr(10) || chr(10) || chr(10))
         || chr(10) || '```' || chr(10) AS answer
  FROM (SELECT {_INST} AS instance_id, {_PATH} AS p, (len(string_split(text, chr(10))) + 11) // 12 AS n FROM documents))"""

def _block(search: str, repl: str) -> str:
    return f"""'```python' || chr(10) || '### ' || p || chr(10) || '<<<<<<< SEARCH' || chr(10) || {search}
  || chr(10) || '=======' || chr(10) || {repl} || chr(10) || '>>>>>>> REPLACE' || chr(10) || '```' || chr(10)"""


def _searched(k: str, line: str) -> str:
    return f"(CASE WHEN attempt = 0 AND (doc_id + {k}) % 3 = 0 THEN '        not present' ELSE {line} END)"


_NAME, _BACK = "'class C' || (12 * (k - 1))", "'        return ' || n"

VIEWS["edit_answers"] = f"""
edit_answers AS (
  WITH d AS (SELECT {_INST} AS instance_id, {_PATH} AS p, doc_id, string_split(text, chr(10)) AS l FROM documents),
  e AS (SELECT instance_id, p, doc_id, attempt, CASE attempt WHEN 0 THEN ' + 1' ELSE ' * 2' END AS mark,
               list_transform(list_filter(l, lambda x, i: (i - 1) % 12 = 0), lambda x: length(x)) AS c,
               list_transform(list_filter(l, lambda x, i: (i - 1) % 12 = 6), lambda x: length(x)) AS r
        FROM d, (SELECT unnest([0, 1]) AS attempt))
  SELECT instance_id, attempt, 'I will edit.' || chr(10)
         || array_to_string(list_concat(
              list_transform(c, lambda n, k: {_block(_searched("k - 1", _NAME + " || ':'"), _NAME + " || '(B):  # ' || n || mark")}),
              list_transform(r, lambda n, k: {_block(_searched("k", _BACK), _BACK + " || mark")})), '')
         || '```python' || chr(10) || '### other.py' || chr(10) || '<<<<<<< SEARCH' || chr(10) || 'x'
         || chr(10) || '=======' || chr(10) || 'y' || chr(10) || '>>>>>>> REPLACE' || chr(10) || '```' || chr(10)
         || {_block("'   '", "'z'")} AS answer
  FROM e)"""

_LOC = f"""
locs AS (
  SELECT instance_id, loc_pos, {_strip("replace(lines[1], '#', '')")} AS file, array_to_string(lines[2:], chr(10)) AS content
  FROM (SELECT instance_id, generate_subscripts(bl, 1) - 1 AS loc_pos,
               string_split({_strip("unnest(bl)")}, chr(10)) AS lines
        FROM (SELECT instance_id, list_filter(string_split(string_split(answer, '```')[2], chr(10) || chr(10)),
                                              lambda x: x <> '') AS bl FROM locate_answers))),
ll0 AS (
  SELECT instance_id, loc_pos, file, unnest(string_split(content, chr(10))) AS line,
         generate_subscripts(string_split(content, chr(10)), 1) - 1 AS line_pos
  FROM locs WHERE ends_with(file, '.py')),
ll1 AS (SELECT *, lead(line) OVER (PARTITION BY instance_id, loc_pos ORDER BY line_pos) AS nxt FROM ll0),
ll2 AS (
  SELECT instance_id, loc_pos, file, line_pos,
    CASE WHEN starts_with(line, 'function:') THEN 'function' WHEN starts_with(line, 'variable:') THEN 'variable'
         WHEN starts_with(line, 'class:') AND (nxt IS NULL OR NOT starts_with(nxt, 'method')) THEN 'class'
         WHEN starts_with(line, 'method:') THEN 'method' WHEN starts_with(line, 'class:') THEN 'class_context' END AS kind,
    CASE WHEN starts_with(line, 'function:') THEN {_strip("replace(line, 'function:', '')")}
         WHEN starts_with(line, 'variable:') THEN {_strip("replace(line, 'variable:', '')")}
         WHEN starts_with(line, 'class:') THEN {_strip("replace(line, 'class:', '')")}
         WHEN starts_with(line, 'method:') THEN {_strip("replace(line, 'method:', '')")} END AS name
  FROM ll1),
ll AS (
  SELECT * FROM (SELECT *, last_value(CASE WHEN kind = 'class_context' THEN name END IGNORE NULLS)
                   OVER (PARTITION BY instance_id, loc_pos ORDER BY line_pos ROWS UNBOUNDED PRECEDING) AS cls FROM ll2)
  WHERE kind IN ('function', 'variable', 'class', 'method')),
spans AS (
  SELECT l.instance_id, l.loc_pos, l.file, l.line_pos, s.start AS sub, s.start, s."end"
  FROM ll l JOIN code_symbols s ON s.instance_id = l.instance_id AND s.path = l.file AND s.kind = l.kind AND s.name = l.name
  WHERE l.kind IN ('function', 'class')
  UNION ALL
  SELECT l.instance_id, l.loc_pos, l.file, l.line_pos, s.start, s.start, s."end"
  FROM ll l JOIN code_symbols s ON s.instance_id = l.instance_id AND s.path = l.file AND s.kind = 'method'
       AND s.cls = l.cls AND s.name = l.name
  WHERE l.kind = 'method'
  UNION ALL
  SELECT l.instance_id, l.loc_pos, l.file, l.line_pos, c.line_no, c.line_no, c.line_no + 2
  FROM ll l JOIN code_lines c ON c.instance_id = l.instance_id AND c.path = l.file
  WHERE l.kind = 'variable' AND (contains(c.text, l.name || '=') OR contains(c.text, l.name || ' ='))),
kept AS (
  SELECT instance_id, loc_pos FROM (
    SELECT instance_id, loc_pos, coalesce(sum(p) OVER (PARTITION BY instance_id ORDER BY loc_pos
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM (SELECT DISTINCT l.instance_id, l.loc_pos,
                 CASE WHEN EXISTS (SELECT 1 FROM spans s WHERE s.instance_id = l.instance_id AND s.loc_pos = l.loc_pos)
                      THEN 1 ELSE 0 END AS p
          FROM locs l WHERE ends_with(l.file, '.py')))
  WHERE before <= 5),
fspans AS (
  SELECT * FROM (
    SELECT s.*, max(s."end") OVER (PARTITION BY s.instance_id, s.file ORDER BY s.start, s.loc_pos, s.line_pos, s.sub
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe
    FROM spans s SEMI JOIN kept k ON k.instance_id = s.instance_id AND k.loc_pos = s.loc_pos)
  WHERE pe IS NULL OR "end" > pe)"""

_LV = ["locate_answers", "code_symbols", "code_lines"]
ORACLE["parse_locations"] = with_views(["locate_answers"], _LOC.split(",\nll0 AS")[0]) + "\nSELECT * FROM locs"
ORACLE["resolve_locations"] = with_views(_LV, _LOC) + "\nSELECT * FROM spans"
ORACLE["kept_locations"] = with_views(_LV, _LOC) + "\nSELECT * FROM kept"
ORACLE["drop_contained"] = with_views(_LV, _LOC) + \
    '\nSELECT instance_id, file, start, "end", loc_pos, line_pos FROM fspans'
ORACLE["span_text"] = with_views(_LV, _LOC) + """
, files AS (SELECT instance_id, file, min(loc_pos) AS first FROM locs l SEMI JOIN kept k USING (instance_id, loc_pos)
            WHERE ends_with(file, '.py') GROUP BY ALL),
chunks AS (
  SELECT s.instance_id, s.file, s.start, s.loc_pos, s.line_pos, s.sub,
         string_agg(c.text, chr(10) ORDER BY c.line_no) AS t
  FROM fspans s JOIN code_lines c ON c.instance_id = s.instance_id AND c.path = s.file
       AND c.line_no >= s.start AND c.line_no <= s."end"
  GROUP BY ALL),
parts AS (
  SELECT f.instance_id, f.first,
         chr(10) || '#' || f.file || coalesce((SELECT string_agg(chr(10) || chr(10) || chr(10) || t, ''
                                                 ORDER BY start, loc_pos, line_pos, sub)
                                                FROM chunks c WHERE c.instance_id = f.instance_id AND c.file = f.file), '') AS part
  FROM files f)
SELECT instance_id, string_agg(part, chr(10) ORDER BY first) AS code_content FROM parts GROUP BY instance_id"""

_EDITS = f"""
eparts AS (
  SELECT instance_id, attempt, generate_subscripts(ps, 1) - 1 AS edit_pos, unnest(ps) AS r
  FROM (SELECT instance_id, attempt,
               list_filter(list_transform(flatten(list_transform(string_split(answer, '```python'),
                   lambda c: string_split(split_part(c, '```', 1), '>>>>>>> REPLACE'))), lambda r: {_strip('r')}),
                   lambda r: r <> '') AS ps
        FROM edit_answers)),
edits AS (
  SELECT instance_id, attempt, edit_pos, file, comp[1] AS original, comp[2] AS modified
  FROM (SELECT instance_id, attempt, edit_pos, {_strip("replace(string_split(r, chr(10))[1], '#', '')")} AS file,
               string_split(array_to_string(string_split(r, chr(10))[3:], chr(10)), '=======') AS comp FROM eparts)
  WHERE len(comp) = 2 AND {_strip('comp[1]')} <> ''
    AND EXISTS (SELECT 1 FROM code_files f WHERE f.instance_id = instance_id AND f.path = file)),
applied AS (
  SELECT e.instance_id, e.attempt, e.file,
         list_reduce(es, lambda t, x: replace(t, x.o, x.m), f.text) AS new
  FROM (SELECT instance_id, attempt, file,
               list({{'o': {_strip('original')}, 'm': {_strip('modified')}}} ORDER BY edit_pos) AS es
        FROM edits GROUP BY ALL) e
  JOIN code_files f ON f.instance_id = e.instance_id AND f.path = e.file)"""

_EV = ["code_lines", "code_files", "edit_answers"]
ORACLE["parse_edits"] = with_views(_EV, _EDITS) + "\nSELECT * FROM edits"
ORACLE["apply_edits"] = with_views(_EV, _EDITS) + "\nSELECT * FROM applied"
ORACLE["found_files"] = with_views(["code_lines", "code_files"]) + """
SELECT instance_id, array_to_string(list_filter(string_split(string_split(
         'Files:' || chr(10) || '```' || chr(10) || path || chr(10) || chr(10) || 'pkg0/__init__.py' || chr(10)
         || 'pkg1/__init__.py' || chr(10) || 'pkg2/__init__.py' || chr(10) || 'pkg3/__init__.py' || chr(10)
         || 'setup.py' || chr(10) || '```' || chr(10) || 'Done.', '```')[2], chr(10)), lambda x: x <> '')[1:5], ',') AS files
FROM code_files"""
ORACLE["with_content"] = with_views(["code_lines", "code_files"]) + "\nSELECT instance_id, path, text FROM code_files"
ORACLE["encode_documents"] = with_views(["code_lines", "code_files"]) + \
    "\nSELECT instance_id, path, concat_ws(chr(10), path, text) AS contents FROM code_files"
ORACLE["reachable"] = """
WITH RECURSIVE edges AS (SELECT o_orderkey // 4 AS src, o_orderkey AS dst FROM orders
  UNION SELECT o_orderkey, o_orderkey + 1 - 2 * (o_orderkey % 2) FROM orders),
roots AS (SELECT o_orderkey AS root FROM orders),
r(root, node) AS (
  SELECT root, root FROM roots
  UNION
  SELECT r.root, e.dst FROM r JOIN edges e ON e.src = r.node)
SELECT root, node FROM r"""
ORACLE["tree_listing"] = with_views(["code_lines", "code_files"]) + """
, items AS (
  SELECT DISTINCT repo, len(parts) - 1 AS depth, parts FROM (
    SELECT repo, unnest(list_transform(range(1, len(string_split(path, '/')) + 1),
                                       lambda i: string_split(path, '/')[1:i])) AS parts FROM code_files)),
shown AS (
  SELECT i.*, EXISTS (SELECT 1 FROM code_files f WHERE f.repo = i.repo AND string_split(f.path, '/') = i.parts) AS is_file
  FROM items i
  WHERE len(list_filter(parts, lambda s: (contains(s, '.') AND NOT contains(s, '.py')) OR s IN ('test', 'tests'))) = 0)
SELECT repo, string_agg(repeat(' ', CAST(depth * 4 AS INTEGER)) || parts[-1] || CASE WHEN is_file THEN '' ELSE '/' END,
                        chr(10) ORDER BY parts) AS tree
FROM shown GROUP BY repo"""
