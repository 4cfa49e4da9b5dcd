"""Composed jobs: batch inference (I2) and the locate → edit repair chain (I4).

Both are plans made of the library's operators; the model is a caller-supplied
``fn(list[str]) -> list[str]`` run inside tasks by ``infer.complete``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixfold.functions.paths import is_python_source
from fixfold.functions.prompts import LOCATE_FILES_PROMPT, LOCATE_SYMBOLS_PROMPT, REPAIR_PROMPT
from fixfold.functions.text import strip
from fixfold.operators import code as CD
from fixfold.operators import infer as I
from fixfold.operators import joins as J
from fixfold.operators import locate as LC
from fixfold.operators import ordering as OR
from fixfold.operators.context import token_count


def fill(template: str, **cols: Column) -> Column:
    """A ``{name}`` template with each placeholder replaced by a column."""
    pieces = re.split(r"\{(\w+)\}", template)
    out = []
    for i, p in enumerate(pieces):
        if i % 2 == 0:
            if p:
                out.append(F.lit(p))
        else:
            out.append(F.coalesce(cols[p], F.lit("")))
    return F.concat(*out)


def _kept(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Written once to the shared folder (in folders ``by`` a column) and read back: what was paid for is not asked again."""
    from fixfold.streaming.jobs import scratch

    path = scratch(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.parquet(path)


def run_inference(df: DataFrame, fn, model: str, done: DataFrame | None = None, max_cost: float | None = None,
                  key: str = "instance_id", text: str = "text", wave_rows: int = 10_000, max_failures: int | None = None,
                  task_failures: int | None = None) -> DataFrame:
    """Shortest texts first (L1), skip ids already done (J1), keep texts
    that fit the model (F19), call the model in tasks (I1), extract the diff
    (P12) and price each call (P23).  Returns predictions with cost and error
    columns.

    With ``max_cost`` the calls go out in waves of ``wave_rows`` in that order;
    a wave starts only while less than the cap is spent, so what may be spent
    beyond it is bounded by one wave, and every paid answer is kept.  Each wave's
    answers are written before the next one starts, and a wave is a folder of its own, so it
    reads its own rows.  A model without a price is an error.

    With ``max_failures`` (I3) no wave starts once that many rows have failed, and
    with ``task_failures`` a task stops calling after so many: with a model that
    always fails the calls are bounded by the tasks of one wave.  Rows that were not
    called are not in the result, so a later run with ``done`` takes them up;
    ``infer.fail_budget`` of the result tells whether the run was aborted."""
    if max_cost is not None and (model not in I.MODEL_COST_PER_INPUT or model not in I.MODEL_COST_PER_OUTPUT):
        raise ValueError(f"no price for model {model!r}")
    d = df.select(key, text)
    if done is not None:
        d = J.skip_existing(d, done, key)
    d = d.withColumn("model", F.lit(model)).withColumn("n_tokens", token_count(F.col(text))) \
        .withColumn("_len", F.length(text))
    d = I.fits_model(d, "n_tokens", "model").select(key, text, "_len")

    def call(part: DataFrame) -> DataFrame:
        answered = I.complete(part, fn, text, key, give_up=task_failures)
        answered = answered.where(~F.col("error").eqNullSafe(I.NOT_CALLED))
        priced = I.with_cost(answered.withColumn("model", F.lit(model)))
        return priced.select(key, F.col("model").alias("model_name_or_path"), F.col("output").alias("full_output"),
                             I.extract_diff(F.col("output")).alias("model_patch"), "cost", "error")

    if max_cost is None and max_failures is None:
        return _kept(call(d), "answers")
    order = _kept(OR.global_row_number(d, ["_len", key], "_rn").withColumn(
        "_wave", F.floor((F.col("_rn") - 1) / wave_rows)), "waves", by="_wave")
    waves = order.agg(F.max("_wave")).first()[0]
    spent, failed, answers = 0.0, 0, []
    for wave in range(0 if waves is None else waves + 1):
        if (max_cost is not None and spent >= max_cost) or (max_failures is not None and failed >= max_failures):
            break
        answers.append(_kept(call(order.where(F.col("_wave") == wave)), f"answers-{wave}"))
        cost, errors = answers[-1].agg(F.sum(F.col("cost").cast("decimal(18,8)")), F.count("error")).first()
        spent += float(cost or 0)
        failed += errors
    if not answers:
        return call(order)  # no rows
    return answers[0] if len(answers) == 1 else J.union_all(answers)


def repair_chain(instances: DataFrame, files: DataFrame, symbols: DataFrame, file_lines: DataFrame, fn,
                 key: str = "instance_id", n_files: int = 5) -> DataFrame:
    """I4: tree listing of the Python sources (F16, X11) → file-localisation
    prompt → model → first ``n_files`` listed files (P13, L3) → their skeletons
    (X7, P20) → symbol-localisation prompt → model → locations (P15) → spans
    (J9, W3, W1, W2) → repair prompt → model → search/replace edits (P14) →
    patched files and their diff (X6).  Each of the three answers is written once,
    so the model is called once for each row and step.  ``instances``: (key, problem_statement);
    ``files``: (key, path, text); ``symbols`` and ``file_lines`` as for
    ``locate.resolve_locations``.  Returns (key, attempt, model_patch)."""
    src = files.where(is_python_source(F.col("path"), F.col(key)))
    tree = CD.tree_listing(src.select(key, "path"), key)
    p1 = instances.join(tree, key, "left").select(
        key, "problem_statement",
        strip(fill(LOCATE_FILES_PROMPT, structure=strip(F.col("tree")),
                   problem_statement=F.col("problem_statement"))).alias("prompt"))
    a1 = _kept(I.complete(p1, fn, "prompt", key), "files-answers")
    found = a1.select(key, F.posexplode(LC.top_files(LC.fenced_list(F.col("output")), n_files)).alias("pos", "path"))
    sk = CD.code_skeleton(src.join(found.select(key, "path"), [key, "path"]))
    bundle = CD.skeleton_bundle(sk.select(key, "path", "skeleton"), key)
    p2 = instances.join(bundle, key, "left").select(
        key, strip(fill(LOCATE_SYMBOLS_PROMPT, file_skeleton=F.col("file_skeleton"),
                        problem_statement=F.col("problem_statement"))).alias("prompt"))
    a2 = _kept(I.complete(p2, fn, "prompt", key), "symbols-answers").select(key, F.col("output").alias("answer"))
    locs = LC.parse_locations(a2, key)
    spans = LC.resolve_locations(LC.location_lines(locs, key), symbols, file_lines, key)
    kept = LC.kept_locations(spans, locs, 5, key)
    spans = LC.drop_contained(spans.join(kept, [key, "loc_pos"], "left_semi"), key)
    code = LC.span_text(spans, locs.join(kept, [key, "loc_pos"], "left_semi"), file_lines, key)
    p3 = instances.join(code, key, "left").select(
        key, fill(REPAIR_PROMPT, code_content=F.col("code_content"),
                  problem_statement=F.col("problem_statement")).alias("prompt"))
    a3 = _kept(I.complete(p3, fn, "prompt", key), "edits-answers").select(
        key, F.lit(0).alias("attempt"), F.col("output").alias("answer"))
    edits = LC.parse_edits(a3, files.select(key, "path"), key)
    return LC.edit_diff(LC.apply_edits(edits, files.select(key, "path", "text"), key), key)
