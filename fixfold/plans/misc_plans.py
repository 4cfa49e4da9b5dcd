"""Registered queries for inference bookkeeping, harness helpers, pages,
re-validation and set operations, each with its DuckDB twin where SQL can
express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixfold.functions import criteria as C
from fixfold.functions import harness as H
from fixfold.functions.text import PY_WS
from fixfold.operators import collect as CO
from fixfold.operators import infer as I
from fixfold.operators import joins as J
from fixfold.operators import locate as LC
from fixfold.operators import ordering as OR
from fixfold.operators import pages as PG
from fixfold.operators import revalidate as RV
from fixfold.operators import versions as VE
from fixfold.operators.context import token_ids
from fixfold.plans.views_sql import VIEWS, with_views
from fixfold.sources import adapters as A
from fixfold.sources.tables import Tables

QUERIES = {}
ORACLE = {}

# Stand-in models (a subset of the fixed price/limit tables).
CALL_MODELS = ("claude-2", "gpt-4-0613", "gpt-3.5-turbo-0613", "claude-3-haiku-20240307", "gpt-4-1106-preview")
WORDS = r"\w+"
BUDGET_CAP = 0.3
WAVE_ROWS = 100


def _calls(spark, sf):
    """Model calls (call_id, model, prompt, response, tokens_in, tokens_out):
    one per conversation turn; the response wraps the text as a tagged
    block, a diff fence or raw text ending in an end-of-sequence marker."""
    c = Tables(spark, sf).conversations
    t = F.col("turn") % 3
    resp = (F.when(t == 0, F.concat(F.lit("<patch>"), F.col("text"), F.lit("</patch>")))
            .when(t == 1, F.concat(F.lit("Here:\n```diff\n"), F.col("text"), F.lit("\n```\n")))
            .otherwise(F.concat(F.col("text"), F.lit("</s>tail"))))
    model = F.element_at(F.array(*[F.lit(m) for m in CALL_MODELS]), (F.col("conv_id") % 5 + 1).cast("int"))
    words = lambda x: F.size(F.regexp_extract_all(x, F.lit(WORDS), 0))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("call_id"), model.alias("model"),
                    F.col("text").alias("prompt"), resp.alias("response"),
                    words(F.col("text")).alias("tokens_in"), words(resp).alias("tokens_out"))


def q_with_cost(spark, sf):
    return I.with_cost(_calls(spark, sf)).select("call_id", "model", F.round("cost", 9).alias("cost"))


def q_fits_model(spark, sf):
    return I.fits_model(_calls(spark, sf).withColumn("n_tokens", F.col("tokens_in") * 40)).select("call_id")


def q_order_by_length(spark, sf):
    return I.order_by_length(_calls(spark, sf), "prompt", "call_id").select(
        "call_id", F.length("prompt").alias("length"))


def q_length_summary(spark, sf):
    return I.length_summary(_calls(spark, sf).withColumnRenamed("tokens_in", "n_tokens"))


def q_total_cost(spark, sf):
    t = I.total_cost(I.with_cost(_calls(spark, sf)))
    return t.select("model", F.round("total_cost", 9).alias("total_cost"), "n_calls")


def q_within_budget(spark, sf):
    c = I.with_cost(_calls(spark, sf))
    return OR.within_budget(c, "cost", BUDGET_CAP, ["call_id"]).select("call_id")


def q_split_system_user(spark, sf):
    return _calls(spark, sf).select("call_id", *I.split_system_user(F.col("prompt")))


def q_extract_diff(spark, sf):
    return _calls(spark, sf).select("call_id", I.extract_diff(F.col("response")).alias("diff"))


def q_fenced_list(spark, sf):
    return _calls(spark, sf).select("call_id", F.array_join(LC.fenced_list(F.col("response")), "|").alias("items"))


def q_repeating_tail(spark, sf):
    return _calls(spark, sf).select("call_id", C.repeating_tail(token_ids(F.col("response")), 100, 60)
                                    .alias("degenerate"))


def q_length_band(spark, sf):
    return _calls(spark, sf).where(C.length_band(F.split(F.col("prompt"), " ", -1), 50, 300)).select("call_id")


def q_test_directives(spark, sf):
    i = A.instances(spark, sf)
    repo = F.when(F.col("pull_number") % 2 == 0, F.lit("django/django")).otherwise(F.col("repo"))
    return i.select("instance_id", F.array_join(H.test_directives(F.col("patch"), repo), ",").alias("directives"))


def q_json_list(spark, sf):
    e = A.expected_tests(spark, sf).where(F.col("category") == "FAIL_TO_PASS")
    enc = e.groupBy("instance_id").agg(F.to_json(F.array_sort(F.collect_set("test_case"))).alias("FAIL_TO_PASS"))
    return enc.select("instance_id", F.explode(H.json_list(F.col("FAIL_TO_PASS"))).alias("test_case"))


def _setup(spark, sf):
    c = Tables(spark, sf).customer
    script = F.concat(F.lit("conda create -n testbed python=3."), (F.col("c_nationkey") % 4 + 6).cast("string"),
                      F.lit(" -y\npip install "), F.lower("c_mktsegment"))
    return c.select(F.col("c_custkey").alias("instance_id"), script.alias("setup_script"),
                    F.col("c_acctbal"))


def q_fingerprint(spark, sf):
    return _setup(spark, sf).select("instance_id", H.fingerprint(F.col("setup_script")).alias("env_key"))


def q_env_groups(spark, sf):
    return RV.env_groups(_setup(spark, sf))


def q_route_by_list(spark, sf):
    s = _setup(spark, sf)
    return RV.route_by_list(s.select("instance_id"), s.where(F.col("c_acctbal") < 0).select("instance_id"))


def q_to_bool(spark, sf):
    e = Tables(spark, sf).events
    word = (F.when(F.col("event_type") == "view", F.lit("Yes")).when(F.col("event_type") == "click", F.lit("no"))
            .when(F.col("event_type") == "purchase", F.lit("T")).when(F.col("event_type") == "signup", F.lit("0"))
            .otherwise(F.lit("TRUE")))
    return e.select("event_id", H.to_bool(word).alias("flag"))


def q_rename_env(spark, sf):
    c = Tables(spark, sf).customer
    yml = F.concat(F.lit("name: base\nchannels:\n  - defaults\ndependencies:\n  - python=3."),
                   (F.col("c_nationkey") % 4 + 6).cast("string"), F.lit("\n"))
    return c.select(F.col("c_custkey").alias("instance_id"),
                    H.rename_env(yml, F.concat(F.lit("env_"), F.col("c_custkey").cast("string"))).alias("yml"))


def q_import_error_logs(spark, sf):
    lg = A.logs(spark, sf)
    extra = F.when(F.col("instance_id").rlike(r"-[0-9]*[05]$"), F.lit("\nImportError: cannot import name x")) \
        .otherwise(F.lit("\nimport ok"))
    return lg.select("instance_id", H.import_error_log(F.concat("content", extra)).alias("import_error"))


def q_extract_ticket(spark, sf):
    return Tables(spark, sf).pages.select("page_id", *PG.extract_ticket(F.col("html")))


def _tracker_pages(spark, sf):
    """Each page as a tracker shows it: its title in the ticket's heading, its text in a nested description,
    other boxes around."""
    p = Tables(spark, sf).pages
    title = F.regexp_extract("html", r"(?s)<h1[^>]*>(.*?)</h1>", 1)
    inner = F.regexp_extract("html", r"(?s)<article>(.*?)</article>", 1)
    deep = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<div>'), inner, F.lit('</div><div class="code"><div>x = 1</div></div>'))).otherwise(inner)
    return p.select("page_id", F.concat(
        F.lit('<html><div id="banner"><h1 class="searchable">Site</h1></div><!-- <div> --><div id="content">'
              '<div class="box" id="ticket"><div class="date">today</div><h1 id="t" class="searchable">\n  '), title,
        F.lit('\n</h1><div class="description">'), deep,
        F.lit('    end</div><div class="attachments"><div>none</div></div></div><div class="description">other</div></div></html>')
    ).alias("html"))


def q_tracker_tickets(spark, sf):
    return PG.tracker_tickets(_tracker_pages(spark, sf))


def _pages_with_links(spark, sf):
    p = Tables(spark, sf).pages
    link = F.when(F.col("page_id") % 3 == 0, F.concat(
        F.lit('<a class="tab" href="https://github.com/own'), F.col("page_id").cast("string"),
        F.lit('/pkg">Source</a><a href="https://github.com/x/y">Docs</a>'))).otherwise(F.lit(""))
    return p.select("page_id", "url", F.concat("html", link).alias("html"))


def q_pick_repo_link(spark, sf):
    return PG.pick_repo_link(_pages_with_links(spark, sf))


def q_top_packages(spark, sf):
    p = Tables(spark, sf).pages.select("page_id", "url")
    return PG.top_packages(p, p.where(F.col("url").contains(".net")), 100).select("page_id", "url", "rank")


def q_parse_issue_url(spark, sf):
    p = A.pulls(spark, sf)
    url = F.concat(F.lit("https://github.com/"), F.col("repo"), F.lit("/issues/"), F.col("number").cast("string"))
    return p.select("repo", "number", *CO.parse_issue_url(url))


def q_issue_text(spark, sf):
    return CO.issue_text(A.issue_texts(spark, sf), A.comments(spark, sf))


def q_with_columns(spark, sf):
    i = A.instances(spark, sf).select("instance_id", "repo", "problem_statement")
    return i.withColumns({"n_chars": F.length("problem_statement"), "repo": F.upper("repo")}) \
        .select("instance_id", "repo", "n_chars")


# --- re-validation: configs are rerun groups of events ------------------------

def _reval_inputs(spark, sf):
    ev = Tables(spark, sf).events
    inst_col = F.concat(F.lit("u-"), F.col("user_id").cast("string"))
    statuses_raw = ev.select(F.concat(F.lit("c"), (F.col("event_id") % 3).cast("string")).alias("config"),
                             inst_col.alias("instance_id"),
                             F.concat(F.lit("t"), (F.col("event_id") % 13).cast("string")).alias("test_case"),
                             F.when(F.col("event_type").isin("view", "click", "purchase"), F.lit("PASSED"))
                             .otherwise(F.lit("FAILED")).alias("status"), "event_id")
    statuses = statuses_raw.groupBy("config", "instance_id", "test_case").agg(
        F.max_by("status", "event_id").alias("status"))
    logs = statuses_raw.select("config", "instance_id").distinct()
    exp = ev.select(inst_col.alias("instance_id"), (F.col("user_id") % 5).alias("rk"),
                    F.concat(F.lit("t"), ((F.col("event_id") + 3) % 16).cast("string")).alias("t"),
                    ((F.col("event_id") + 3) % 16 % 4 == 0).alias("is_f2p"))
    inst = exp.groupBy("instance_id", "rk").agg(
        F.array_sort(F.collect_set(F.when(F.col("is_f2p"), F.col("t")))).alias("f2p"),
        F.array_sort(F.collect_set(F.when(~F.col("is_f2p"), F.col("t")))).alias("p2p"))
    inst = inst.select("instance_id", F.concat(F.lit("repo"), (F.col("rk") % 2).cast("string")).alias("repo"),
                       F.concat(F.lit("1."), F.col("rk").cast("string")).alias("version"), "f2p", "p2p")
    order = spark.createDataFrame([("c0", 0), ("c1", 1), ("c2", 2)], "config string, pos int")
    return inst, statuses, logs, order


def q_revalidate(spark, sf):
    inst, st, logs, _ = _reval_inputs(spark, sf)
    r = RV.revalidate(inst, st, logs)
    return r.select("config", "instance_id", "status", F.array_join("f2p_new", ",").alias("f2p_new"),
                    F.array_join("p2p_new", ",").alias("p2p_new"), "changed_f2p", "changed_p2p")


def q_revalidate_no_log(spark, sf):
    """A23 ``no_log`` class: each configuration of the sweep covers both stand-in
    repositories (a fourth configuration produced no logs at all); pairs without
    a log are reported."""
    inst, st, logs, _ = _reval_inputs(spark, sf)
    configs = spark.createDataFrame([(c, r) for c in ("c0", "c1", "c2", "c3") for r in ("repo0", "repo1")],
                                    "config string, repo string")
    return RV.no_log_pairs(inst, configs, logs).select("config", "instance_id", "status")


def q_best_config(spark, sf):
    inst, st, logs, order = _reval_inputs(spark, sf)
    return RV.best_config(RV.revalidate(inst, st, logs), order)


def q_rebuild_dataset(spark, sf):
    inst, st, logs, order = _reval_inputs(spark, sf)
    kept = RV.revalidate(inst, st, logs)
    return RV.rebuild_dataset(RV.best_config(kept, order), kept).select("instance_id", "repo", "version", "config")


def q_lost_pairs(spark, sf):
    inst, st, logs, order = _reval_inputs(spark, sf)
    kept = RV.revalidate(inst, st, logs)
    new = RV.rebuild_dataset(RV.best_config(kept, order), kept)
    return J.lost_pairs(inst, new, ["instance_id", "version"])


def q_distinct_pairs(spark, sf):
    v = VE.asof_version(A.release_tasks(spark, sf), VE.extract_releases(A.changelog_pages(spark, sf)))
    return v.select("repo", "version").distinct()


def q_union_ids(spark, sf):
    return J.union_ids(A.predictions(spark, sf), A.eval_instances(spark, sf))


def q_restrict_ids(spark, sf):
    ev = A.eval_instances(spark, sf).where("in_subset")
    return J.restrict_ids(A.predictions(spark, sf), ev).select("instance_id")


def q_unknown_ids(spark, sf):
    ev = A.eval_instances(spark, sf).where("in_subset")
    return J.unknown_ids(A.predictions(spark, sf), ev)


def q_drop_missing_text(spark, sf):
    return J.drop_missing(A.predictions(spark, sf)).select("instance_id")


def q_backfill(spark, sf):
    files = A.version_files(spark, sf)
    first = VE.find_version(files)
    inst = files.select("instance_id", "text")
    out = J.backfill(inst, first, lambda rest: rest.withColumn(
        "version", VE.major_minor(F.concat(F.lit("0."), F.length("text").cast("string"), F.lit(".9")))))
    return out.select("instance_id", "version", "method")


QUERIES.update({
    "with_cost": q_with_cost, "fits_model": q_fits_model, "order_by_length": q_order_by_length,
    "length_summary": q_length_summary, "total_cost": q_total_cost, "within_budget": q_within_budget,
    "split_system_user": q_split_system_user, "extract_diff": q_extract_diff, "fenced_list": q_fenced_list,
    "repeating_tail": q_repeating_tail, "length_band": q_length_band, "test_directives": q_test_directives,
    "json_list": q_json_list, "fingerprint": q_fingerprint, "env_groups": q_env_groups,
    "route_by_list": q_route_by_list, "to_bool": q_to_bool, "rename_env": q_rename_env,
    "import_error_logs": q_import_error_logs, "extract_ticket": q_extract_ticket, "tracker_tickets": q_tracker_tickets,
    "pick_repo_link": q_pick_repo_link, "top_packages": q_top_packages, "parse_issue_url": q_parse_issue_url,
    "issue_text": q_issue_text, "with_columns": q_with_columns, "revalidate": q_revalidate,
    "best_config": q_best_config, "revalidate_no_log": q_revalidate_no_log, "rebuild_dataset": q_rebuild_dataset, "lost_pairs": q_lost_pairs,
    "distinct_pairs": q_distinct_pairs, "union_ids": q_union_ids, "restrict_ids": q_restrict_ids,
    "unknown_ids": q_unknown_ids, "drop_missing_text": q_drop_missing_text, "backfill": q_backfill,
})

# ---------------------------------------------------------------- DuckDB twins

_MODELS = "[" + ", ".join(f"'{m}'" for m in CALL_MODELS) + "]"
VIEWS["calls"] = f"""
calls AS (
  SELECT call_id, model, prompt, response, len(regexp_extract_all(prompt, '\\w+')) AS tokens_in,
         len(regexp_extract_all(response, '\\w+')) AS tokens_out
  FROM (SELECT conv_id * 1000 + turn AS call_id, ({_MODELS})[conv_id % 5 + 1] AS model, text AS prompt,
               CASE turn % 3 WHEN 0 THEN '<patch>' || text || '</patch>'
                             WHEN 1 THEN 'Here:' || chr(10) || '```diff' || chr(10) || text || chr(10) || '```' || chr(10)
                             ELSE text || '</s>tail' END AS response
        FROM conversations))"""

_PRICES = ", ".join(f"('{m}', {I.MODEL_COST_PER_INPUT[m]!r}, {I.MODEL_COST_PER_OUTPUT[m]!r})"
                    for m in sorted(set(I.MODEL_COST_PER_INPUT) & set(I.MODEL_COST_PER_OUTPUT)))
_LIMITS = ", ".join(f"('{m}', {v})" for m, v in sorted(I.MODEL_LIMITS.items()))
_COST = f"""
prices AS (SELECT * FROM (VALUES {_PRICES}) AS t(model, price_in, price_out)),
limits AS (SELECT * FROM (VALUES {_LIMITS}) AS t(model, max_tokens)),
costed AS (SELECT c.*, c.tokens_in * p.price_in + c.tokens_out * p.price_out AS cost
           FROM calls c LEFT JOIN prices p USING (model))"""

ORACLE["with_cost"] = with_views(["calls"], _COST) + "\nSELECT call_id, model, round(cost, 9) AS cost FROM costed"
ORACLE["fits_model"] = with_views(["calls"], _COST) + \
    "\nSELECT call_id FROM calls JOIN limits USING (model) WHERE tokens_in * 40 <= max_tokens"
ORACLE["order_by_length"] = with_views(["calls"]) + "\nSELECT call_id, length(prompt) AS length FROM calls"
ORACLE["length_summary"] = with_views(["calls"]) + \
    "\nSELECT count(*) AS n_rows, min(tokens_in) AS min_tokens, max(tokens_in) AS max_tokens FROM calls"
ORACLE["total_cost"] = with_views(["calls"], _COST) + \
    "\nSELECT model, round(sum(cost), 9) AS total_cost, count(*) AS n_calls FROM costed GROUP BY model"
ORACLE["within_budget"] = with_views(["calls"], _COST) + f"""
SELECT call_id FROM (
  SELECT call_id, coalesce(sum(cost) OVER (ORDER BY call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM costed) WHERE before < {BUDGET_CAP}"""
ORACLE["split_system_user"] = with_views(["calls"]) + """
SELECT call_id, split_part(prompt, chr(10), 1) AS system,
       CASE WHEN strpos(prompt, chr(10)) > 0 THEN substr(prompt, strpos(prompt, chr(10)) + 1) ELSE '' END AS user
FROM calls"""
ORACLE["extract_diff"] = with_views(["calls"]) + """
SELECT call_id, CASE WHEN response IS NULL THEN NULL ELSE coalesce(
  list_filter(tag_b, lambda b, i: tag_c[i] IN ('diff', 'patch'))[1],
  list_filter(fen_b, lambda b, i: fen_c[i] IN ('diff', 'patch'))[1],
  list_filter(tag_b, lambda b, i: tag_c[i] NOT IN ('diff', 'patch'))[1],
  list_filter(fen_b, lambda b, i: coalesce(fen_c[i], '') NOT IN ('diff', 'patch'))[1],
  split_part(response, '</s>', 1)) END AS diff
FROM (SELECT call_id, response,
        list_transform(regexp_extract_all(response, '<([\\w-]+)>', 1), lambda t: t) AS tag_names,
        list_filter(regexp_extract_all(response, '<([\\w-]+)>', 1),
                    lambda t: contains(response, '</' || t || '>')) AS tag_c,
        list_transform(list_filter(regexp_extract_all(response, '<([\\w-]+)>', 1),
                                   lambda t: contains(response, '</' || t || '>')),
                       lambda t: regexp_extract(response, '(?s)<' || t || '>(.*?)</' || t || '>', 1)) AS tag_b,
        regexp_extract_all(response, '(?s)```(\\w+)?\\n(.*?)```', 1) AS fen_c,
        regexp_extract_all(response, '(?s)```(\\w+)?\\n(.*?)```', 2) AS fen_b
      FROM calls)"""
ORACLE["fenced_list"] = with_views(["calls"]) + """
SELECT call_id, array_to_string(list_filter(string_split(string_split(response, '```')[2], chr(10)), lambda x: x <> ''), '|') AS items
FROM calls"""
_TOKS = "list_transform(regexp_extract_all(response, '[\\p{L}\\p{N}_]+'), lambda w: CAST(('0x' || substr(md5(w), 1, 6)) AS INTEGER))"
ORACLE["repeating_tail"] = with_views(["calls"]) + f"""
SELECT call_id, len(t) >= 100 AND len(list_distinct(t[len(t) - 99:])) <= 60 AS degenerate
FROM (SELECT call_id, {_TOKS} AS t FROM calls)"""
ORACLE["length_band"] = with_views(["calls"]) + """
SELECT call_id FROM calls WHERE len(string_split(prompt, ' ')) >= 50 AND len(string_split(prompt, ' ')) < 300"""
_EXTS = " OR ".join(f"ends_with(d, '{e}')" for e in H.NON_TEST_EXTS)
ORACLE["test_directives"] = with_views(["patches", "instances"]) + f"""
SELECT instance_id, array_to_string(CASE WHEN repo2 = 'django/django'
         THEN list_transform(kept, lambda d: replace(regexp_replace(regexp_replace(d, '\\.py$', ''), '^tests/', ''), '/', '.'))
         ELSE kept END, ',') AS directives
FROM (SELECT instance_id, CASE WHEN pull_number % 2 = 0 THEN 'django/django' ELSE repo END AS repo2,
             list_filter(regexp_extract_all(patch, 'diff --git a/.* b/(.*)', 1), lambda d: NOT ({_EXTS})) AS kept
      FROM instances)"""
ORACLE["json_list"] = with_views(["expected_tests"]) + """
SELECT instance_id, test_case FROM expected_tests WHERE category = 'FAIL_TO_PASS'"""
_SETUP = """
setup AS (SELECT c_custkey AS instance_id,
                 'conda create -n testbed python=3.' || CAST(c_nationkey % 4 + 6 AS VARCHAR) || ' -y' || chr(10)
                 || 'pip install ' || lower(c_mktsegment) AS setup_script, c_acctbal FROM customer)"""
ORACLE["fingerprint"] = "WITH " + _SETUP.strip() + \
    "\nSELECT instance_id, substr(sha256(setup_script), 1, 22) AS env_key FROM setup"
ORACLE["env_groups"] = "WITH " + _SETUP.strip() + """
SELECT substr(sha256(setup_script), 1, 22) AS env_key, min(setup_script) AS setup_script, count(*) AS n_instances
FROM setup GROUP BY 1"""
ORACLE["route_by_list"] = "WITH " + _SETUP.strip() + """
SELECT instance_id, CASE WHEN instance_id IN (SELECT instance_id FROM setup WHERE c_acctbal < 0) THEN 'x86_64'
                         ELSE 'arm64' END AS arch FROM setup"""
ORACLE["to_bool"] = """
SELECT event_id, CASE event_type WHEN 'view' THEN true WHEN 'click' THEN false WHEN 'purchase' THEN true
                                 WHEN 'signup' THEN false ELSE true END AS flag FROM events"""
ORACLE["rename_env"] = """
SELECT c_custkey AS instance_id,
       'name: env_' || CAST(c_custkey AS VARCHAR) || chr(10) || 'channels:' || chr(10) || '  - defaults' || chr(10)
       || 'dependencies:' || chr(10) || '  - python=3.' || CAST(c_nationkey % 4 + 6 AS VARCHAR) || chr(10) AS yml
FROM customer"""
ORACLE["import_error_logs"] = with_views(["logs"]) + """
SELECT instance_id, len(list_filter(string_split(lower(c), chr(10)),
         lambda l: (contains(l, 'attribute') OR contains(l, 'import')) AND (contains(l, 'error') OR contains(l, 'fail')))) > 0
       AS import_error
FROM (SELECT instance_id, content || CASE WHEN regexp_matches(instance_id, '-[0-9]*[05]$')
                                          THEN chr(10) || 'ImportError: cannot import name x'
                                          ELSE chr(10) || 'import ok' END AS c FROM logs)"""
_WS = PY_WS


def _html_text(x):
    t = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for a, b in PG.ENTITIES:
        t = f"replace({t}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return t


def _strip(x):
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


ORACLE["extract_ticket"] = f"""
SELECT page_id,
  {_strip("regexp_replace(" + _html_text("regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)") + ", '" + _WS + "+', ' ', 'g')")} AS title,
  {_strip("regexp_replace(replace(regexp_replace(" + _html_text("regexp_extract(html, '(?s)<article>.*?</h1>(.*?)</article>', 1)") + ", '\\n+', chr(10), 'g'), '    ', chr(9)), '[ ]{2,}', ' ', 'g')")} AS body
FROM pages"""
_INNER = "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"
_DEEP = f"CASE WHEN page_id % 3 = 0 THEN {_INNER} || 'x = 1' ELSE {_INNER} END || '    end'"
ORACLE["tracker_tickets"] = f"""
SELECT page_id,
  {_strip("regexp_replace(" + _html_text("regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)") + ", '" + _WS + "+', ' ', 'g')")} AS title,
  {_strip("regexp_replace(replace(regexp_replace(" + _html_text(_DEEP) + ", '\n+', chr(10), 'g'), '    ', chr(9)), '[ ]{2,}', ' ', 'g')")} AS body
FROM pages"""
ORACLE["pick_repo_link"] = f"""
WITH p AS (
  SELECT page_id, html || CASE WHEN page_id % 3 = 0 THEN '<a class="tab" href="https://github.com/own'
           || CAST(page_id AS VARCHAR) || '/pkg">Source</a><a href="https://github.com/x/y">Docs</a>' ELSE '' END AS html
  FROM pages),
a AS (
  SELECT page_id, unnest(regexp_extract_all(html, '{PG.ANCHOR}', 1)) AS href,
         unnest(regexp_extract_all(html, '{PG.ANCHOR}', 2)) AS txt,
         unnest(range(len(regexp_extract_all(html, '{PG.ANCHOR}', 1)))) AS pos
  FROM p),
ok AS (SELECT page_id, arg_min(href, pos) AS github FROM a
       WHERE (contains(lower({_html_text('txt')}), 'source') OR contains(lower({_html_text('txt')}), 'code')
              OR contains(lower({_html_text('txt')}), 'homepage')) AND contains(lower(href), 'github')
       GROUP BY page_id)
SELECT p.page_id, ok.github, string_split(ok.github, '/')[-2] AS owner, string_split(ok.github, '/')[-1] AS name
FROM p LEFT JOIN ok USING (page_id)"""
ORACLE["top_packages"] = """
SELECT page_id, url, rank FROM (SELECT page_id, url, row_number() OVER (ORDER BY page_id) - 1 AS rank
                                FROM pages ORDER BY page_id LIMIT 100)
WHERE url NOT IN (SELECT url FROM pages WHERE contains(url, '.net'))"""
ORACLE["parse_issue_url"] = with_views(["pulls"]) + """
SELECT repo, number, regexp_extract(u, 'github\\.com/(.+?)/(.+?)/issues/(\\d+)', 1) AS owner,
       regexp_extract(u, 'github\\.com/(.+?)/(.+?)/issues/(\\d+)', 2) AS repo_name,
       regexp_extract(u, 'github\\.com/(.+?)/(.+?)/issues/(\\d+)', 3) AS issue_number
FROM (SELECT repo, number, 'https://github.com/' || repo || '/issues/' || CAST(number AS VARCHAR) AS u FROM pulls)"""
ORACLE["issue_text"] = with_views(["issue_texts", "comments"]) + """
SELECT i.repo, i.number, concat_ws(chr(10), coalesce(title, ''), coalesce(i.body, '')) || chr(10)
       || CASE WHEN c.ctext IS NOT NULL THEN 'Comment: ' || c.ctext ELSE '' END AS text
FROM issue_texts i LEFT JOIN (SELECT repo, issue_number AS number, string_agg(body, chr(10) || 'Comment:' ORDER BY pos) AS ctext
                              FROM comments GROUP BY ALL) c USING (repo, number)"""
ORACLE["with_columns"] = with_views(["patches", "instances"]) + """
SELECT instance_id, upper(repo) AS repo, length(problem_statement) AS n_chars FROM instances"""

_REVAL = """
st_raw AS (
  SELECT 'c' || CAST(event_id % 3 AS VARCHAR) AS config, 'u-' || CAST(user_id AS VARCHAR) AS instance_id,
         't' || CAST(event_id % 13 AS VARCHAR) AS test_case,
         CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'PASSED' ELSE 'FAILED' END AS status, event_id
  FROM events),
st AS (SELECT config, instance_id, test_case, arg_max(status, event_id) AS status FROM st_raw GROUP BY ALL),
rlogs AS (SELECT DISTINCT config, instance_id FROM st_raw),
rinst AS (
  SELECT instance_id, 'repo' || CAST(rk % 2 AS VARCHAR) AS repo, '1.' || CAST(rk AS VARCHAR) AS version,
         list_sort(list_distinct(list(t) FILTER (WHERE is_f2p))) AS f2p,
         list_sort(list_distinct(list(t) FILTER (WHERE NOT is_f2p))) AS p2p
  FROM (SELECT 'u-' || CAST(user_id AS VARCHAR) AS instance_id, user_id % 5 AS rk,
               't' || CAST((event_id + 3) % 16 AS VARCHAR) AS t, (event_id + 3) % 16 % 4 = 0 AS is_f2p FROM events)
  GROUP BY instance_id, rk),
passed AS (
  SELECT s.config, s.instance_id, s.test_case,
         EXISTS (SELECT 1 FROM (SELECT instance_id, unnest(f2p) AS t FROM rinst) o
                 WHERE o.instance_id = s.instance_id AND o.t = s.test_case) AS is_f2p
  FROM st s WHERE s.status = 'PASSED'),
per AS (
  SELECT config, instance_id, list_sort(list(test_case) FILTER (WHERE is_f2p)) AS f2p_new,
         list_sort(list(test_case) FILTER (WHERE NOT is_f2p)) AS p2p_new
  FROM passed GROUP BY ALL),
reval AS (
  SELECT l.config, l.instance_id, i.repo, i.version, i.f2p, i.p2p,
         CASE WHEN len(coalesce(p.f2p_new, [])) = 0 THEN 'reproduce_fail' ELSE 'kept' END AS status,
         coalesce(p.f2p_new, []) AS f2p_new, coalesce(p.p2p_new, []) AS p2p_new
  FROM rlogs l JOIN rinst i USING (instance_id) LEFT JOIN per p USING (config, instance_id)),
best AS (
  SELECT repo, version, arg_max(config, (n_kept, -pos)) AS config, max(n_kept) AS n_kept
  FROM (SELECT repo, version, config, count(*) AS n_kept,
               CASE config WHEN 'c0' THEN 0 WHEN 'c1' THEN 1 ELSE 2 END AS pos
        FROM reval WHERE status = 'kept' GROUP BY ALL)
  GROUP BY ALL),
rebuilt AS (SELECT r.* FROM reval r JOIN best b USING (repo, version, config) WHERE r.status = 'kept')"""

ORACLE["revalidate"] = "WITH " + _REVAL.strip() + """
SELECT config, instance_id, status,
       CASE WHEN status = 'kept' THEN array_to_string(f2p_new, ',') END AS f2p_new,
       CASE WHEN status = 'kept' THEN array_to_string(p2p_new, ',') END AS p2p_new,
       CASE WHEN status = 'kept' THEN list_sort(f2p) <> f2p_new END AS changed_f2p,
       CASE WHEN status = 'kept' THEN list_sort(p2p) <> p2p_new END AS changed_p2p
FROM reval"""
ORACLE["best_config"] = "WITH " + _REVAL.strip() + "\nSELECT * FROM best"
ORACLE["rebuild_dataset"] = "WITH " + _REVAL.strip() + "\nSELECT instance_id, repo, version, config FROM rebuilt"
ORACLE["lost_pairs"] = "WITH " + _REVAL.strip() + """
SELECT instance_id, version FROM rinst EXCEPT SELECT instance_id, version FROM rebuilt"""
ORACLE["union_ids"] = with_views(["predictions", "eval_instances"]) + """
SELECT instance_id FROM predictions UNION SELECT instance_id FROM eval_instances"""
ORACLE["restrict_ids"] = with_views(["predictions", "eval_instances"]) + """
SELECT instance_id FROM predictions WHERE instance_id IN (SELECT instance_id FROM eval_instances WHERE in_subset)"""
ORACLE["unknown_ids"] = with_views(["predictions", "eval_instances"]) + """
SELECT DISTINCT instance_id FROM eval_instances WHERE in_subset
  AND instance_id NOT IN (SELECT instance_id FROM predictions)"""
ORACLE["drop_missing_text"] = with_views(["predictions"]) + \
    "\nSELECT instance_id FROM predictions WHERE model_patch IS NOT NULL"

from fixfold.plans.collect_plans import _REL, FIND_VERSION_SELECT  # noqa: E402

ORACLE["distinct_pairs"] = with_views(["changelog_pages", "release_tasks"], _REL) + \
    "\nSELECT DISTINCT repo, version FROM versioned"
ORACLE["backfill"] = with_views(["version_files"], "fv AS (" + FIND_VERSION_SELECT + ")") + """
SELECT instance_id, version, 1 AS method FROM fv WHERE version IS NOT NULL
UNION ALL
SELECT f.instance_id,
       regexp_replace(array_to_string(string_split(trim('0.' || CAST(length(f.text) AS VARCHAR) || '.9'), '.')[1:2], '.'),
                      '[^0-9.]', '', 'g') AS version, 2 AS method
FROM version_files f WHERE f.instance_id NOT IN (SELECT instance_id FROM fv WHERE version IS NOT NULL)"""


def q_run_inference(spark, sf):
    """I2 over the model calls' prompts with a deterministic stand-in model that
    answers every prompt with a diff fence holding the whole prompt."""
    from fixfold.operators.repair import run_inference

    calls = _calls(spark, sf).select(F.col("call_id").alias("instance_id"), F.col("prompt").alias("text"))
    # a resumed run: every conversation's opening turn was answered before
    conv = Tables(spark, sf).conversations
    done = conv.where(F.col("turn") == 0).select((F.col("conv_id") * 1000 + F.col("turn")).alias("instance_id"))
    echo = lambda ts: ["```diff\n" + t + "\n```" for t in ts]
    out = run_inference(calls, echo, "gpt-4-0613", done=done, max_cost=BUDGET_CAP, wave_rows=WAVE_ROWS)
    return out.select("instance_id", "model_name_or_path", "model_patch", F.round("cost", 9).alias("cost"))


def q_run_inference_abort(spark, sf):
    """The stand-in model fails on prompts of a length divisible by seven; the run
    ends after the wave in which the third row has failed."""
    from fixfold.operators.repair import run_inference

    def moody(texts):
        if any(len(t) % 7 == 0 for t in texts):
            raise RuntimeError("no answer")
        return ["```diff\n" + t + "\n```" for t in texts]

    calls = _calls(spark, sf).select(F.col("call_id").alias("instance_id"), F.col("prompt").alias("text"))
    out = run_inference(calls, moody, "gpt-4-0613", max_failures=3, wave_rows=10)
    return out.select("instance_id", "model_patch", F.col("error").isNotNull().alias("failed"))


QUERIES["run_inference_abort"] = q_run_inference_abort
ORACLE["run_inference_abort"] = f"""
WITH r AS (
  SELECT conv_id * 1000 + turn AS instance_id, text, length(text) % 7 = 0 AS failed,
         (row_number() OVER (ORDER BY length(text), conv_id * 1000 + turn) - 1) // 10 AS wave
  FROM conversations WHERE len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) <= {I.MODEL_LIMITS["gpt-4-0613"]}),
s AS (SELECT wave, count(*) FILTER (failed) AS n FROM r GROUP BY wave),
b AS (SELECT wave, coalesce(sum(n) OVER (ORDER BY wave ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT instance_id, CASE WHEN NOT failed THEN text || chr(10) END AS model_patch, failed FROM r JOIN b USING (wave) WHERE before < 3"""

QUERIES["run_inference"] = q_run_inference
# waves of calls, shortest prompts first, while less than the cap is spent
ORACLE["run_inference"] = f"""
WITH w AS (
  SELECT conv_id * 1000 + turn AS instance_id, text, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS n
  FROM conversations WHERE turn <> 0),
r AS (
  SELECT *, CAST(floor((row_number() OVER (ORDER BY length(text), instance_id) - 1) / {WAVE_ROWS}) AS BIGINT) AS wave,
         n * {I.MODEL_COST_PER_INPUT["gpt-4-0613"]:.8f} + (n + 1) * {I.MODEL_COST_PER_OUTPUT["gpt-4-0613"]:.8f} AS cost
  FROM w WHERE n <= {I.MODEL_LIMITS["gpt-4-0613"]}),
s AS (SELECT wave, sum(CAST(cost AS DECIMAL(18, 8))) AS c FROM r GROUP BY wave),
b AS (SELECT wave, coalesce(sum(c) OVER (ORDER BY wave ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT instance_id, 'gpt-4-0613' AS model_name_or_path, text || chr(10) AS model_patch, round(CAST(cost AS DOUBLE), 9) AS cost
FROM r JOIN b USING (wave) WHERE before < {BUDGET_CAP}"""

ORACLE["revalidate_no_log"] = "WITH " + _REVAL.strip() + """
SELECT c.config, i.instance_id, 'no_log' AS status
FROM (SELECT * FROM (VALUES ('c0'), ('c1'), ('c2'), ('c3')) AS a(config), (VALUES ('repo0'), ('repo1')) AS b(repo)) c
JOIN rinst i ON i.repo = c.repo
WHERE NOT EXISTS (SELECT 1 FROM rlogs l WHERE l.config = c.config AND l.instance_id = i.instance_id)"""
