"""Batch generation bookkeeping: prices, limits, costs, response parsing and a
model-call operator that runs inside tasks (P12, P23, P27, P31, F19, F25, L1,
A28, A29, I1–I4).

The model itself is a caller-supplied function ``fn(list[str]) -> list[str]``
run by ``mapInPandas`` on Arrow batches, so calls are spread over partitions;
a failing row gets an error column instead of failing the batch.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixfold.functions.text import col_

# Context limits (tokens) per model.
MODEL_LIMITS = {
    "claude-instant-1": 100_000,
    "claude-2": 100_000,
    "claude-3-opus-20240229": 200_000,
    "claude-3-sonnet-20240229": 200_000,
    "claude-3-haiku-20240307": 200_000,
    "gpt-3.5-turbo-16k-0613": 16_385,
    "gpt-3.5-turbo-0613": 4_097,
    "gpt-3.5-turbo-1106": 16_385,
    "gpt-4-32k-0613": 32_768,
    "gpt-4-0613": 8_192,
    "gpt-4-1106-preview": 128_000,
    "gpt-4-0125-preview": 128_000,
}

# Price per input token and per output token, per model.
MODEL_COST_PER_INPUT = {
    "claude-instant-1": 0.00000163,
    "claude-2": 0.00001102,
    "claude-3-opus-20240229": 0.000015,
    "claude-3-sonnet-20240229": 0.000003,
    "claude-3-haiku-20240307": 0.00000025,
    "gpt-3.5-turbo-16k-0613": 0.0000015,
    "gpt-3.5-turbo-0613": 0.0000015,
    "gpt-3.5-turbo-1106": 0.000001,
    "gpt-35-turbo-0613": 0.0000015,
    "gpt-35-turbo": 0.0000015,
    "gpt-4-0613": 0.00003,
    "gpt-4-32k-0613": 0.00006,
    "gpt-4-32k": 0.00006,
    "gpt-4-1106-preview": 0.00001,
    "gpt-4-0125-preview": 0.00001,
}
MODEL_COST_PER_OUTPUT = {
    "claude-instant-1": 0.00000551,
    "claude-2": 0.00003268,
    "claude-3-opus-20240229": 0.000075,
    "claude-3-sonnet-20240229": 0.000015,
    "claude-3-haiku-20240307": 0.00000125,
    "gpt-3.5-turbo-16k-0613": 0.000002,
    "gpt-3.5-turbo-16k": 0.000002,
    "gpt-3.5-turbo-1106": 0.000002,
    "gpt-35-turbo-0613": 0.000002,
    "gpt-35-turbo": 0.000002,
    "gpt-4-0613": 0.00006,
    "gpt-4-32k-0613": 0.00012,
    "gpt-4-32k": 0.00012,
    "gpt-4-1106-preview": 0.00003,
    "gpt-4-0125-preview": 0.00003,
}


def prices_table(spark) -> DataFrame:
    """(model, price_in, price_out) — a fixed literal dimension, safe to broadcast."""
    rows = [(m, MODEL_COST_PER_INPUT[m], MODEL_COST_PER_OUTPUT[m])
            for m in sorted(set(MODEL_COST_PER_INPUT) & set(MODEL_COST_PER_OUTPUT))]
    return spark.createDataFrame(rows, "model string, price_in double, price_out double")


def limits_table(spark) -> DataFrame:
    """(model, max_tokens) — fixed literal dimension."""
    return spark.createDataFrame(sorted(MODEL_LIMITS.items()), "model string, max_tokens long")


def with_cost(df: DataFrame, tokens_in: str = "tokens_in", tokens_out: str = "tokens_out",
              model: str = "model") -> DataFrame:
    """cost = tokens in × input price + tokens out × output price."""
    p = F.broadcast(prices_table(df.sparkSession).withColumnRenamed("model", model))
    j = df.join(p, model, "left")
    return j.withColumn("cost", F.col(tokens_in) * F.col("price_in") + F.col(tokens_out) * F.col("price_out")) \
        .drop("price_in", "price_out")


def fits_model(df: DataFrame, n_tokens: str = "n_tokens", model: str = "model") -> DataFrame:
    """rows whose token count is within the model's context limit."""
    lim = F.broadcast(limits_table(df.sparkSession).withColumnRenamed("model", model))
    return df.join(lim, model, "inner").where(F.col(n_tokens) <= F.col("max_tokens")).drop("max_tokens")


def order_by_length(df: DataFrame, text: str = "text", key: str = "instance_id") -> DataFrame:
    """L1: ascending text length (id breaks ties, so the order is total)."""
    return df.orderBy(F.length(text), key)


def length_summary(df: DataFrame, n_tokens: str = "n_tokens") -> DataFrame:
    """Rows, min and max token count."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.min(n_tokens).alias("min_tokens"),
                  F.max(n_tokens).alias("max_tokens"))


def total_cost(df: DataFrame, group=("model",)) -> DataFrame:
    """Summed cost per group."""
    return df.groupBy(*group).agg(F.sum("cost").alias("total_cost"), F.count(F.lit(1)).alias("n_calls"))


def split_system_user(prompt) -> list[Column]:
    """The prompt's first line is the system message, the rest the user message."""
    p = col_(prompt)
    parts = F.split(p, "\n", 2)
    return [F.try_element_at(parts, F.lit(1)).alias("system"),
            F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("user")]


TAG_BLOCK = r"(?s)<([\w-]+)>(.*?)</\1>"
FENCE_BLOCK = r"(?s)```(\w+)?\n(.*?)```"
DIFF_CODES = ("diff", "patch")


def extract_diff(response) -> Column:
    """Diff text out of a model response: the first ``<diff>``/``<patch>``
    block, else the first diff/patch fence, else the first other tag block,
    else the first other fence, else the text before ``</s>``."""
    r = col_(response)

    def blocks(pat):
        return F.arrays_zip(F.regexp_extract_all(r, F.lit(pat), 1).alias("code"),
                            F.regexp_extract_all(r, F.lit(pat), 2).alias("body"))

    tags, fences = blocks(TAG_BLOCK), blocks(FENCE_BLOCK)
    is_diff = lambda b: b["code"].isin(*DIFF_CODES)
    first = lambda arr, cond: F.try_element_at(
        F.transform(F.filter(arr, cond), lambda b: b["body"]), F.lit(1))
    return F.when(r.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(
        first(tags, is_diff), first(fences, is_diff),
        first(tags, lambda b: ~is_diff(b)), first(fences, lambda b: ~is_diff(b)),
        F.substring_index(r, "</s>", 1)))


def parse_kv(col) -> Column:
    """``k=v,k2=v2`` → map<string,string> of typed JSON values: true/false,
    ints, floats, null, [], {}, quoted strings unquoted, anything else a string."""
    m = F.str_to_map(col_(col), F.lit(","), F.lit("="))

    def typed(v):
        return (F.when(v.isin("True", "False"), F.lower(v))
                .when(v.rlike(r"^[0-9]+$"), v)
                .when(v.rlike(r"^[0-9]*\.?[0-9]*$") & v.rlike("[0-9]"), v)
                .when(v == "None", F.lit("null"))
                .when(v.isin("[]", "{}"), v)
                .when((v.startswith("'") & v.endswith("'") & (F.length(v) >= 2))
                      | (v.startswith('"') & v.endswith('"') & (F.length(v) >= 2)),
                      F.to_json(F.array(F.substring(v, 2, F.length(v) - 2))).substr(F.lit(2), F.length(
                          F.to_json(F.array(F.substring(v, 2, F.length(v) - 2)))) - 2))
                .otherwise(F.to_json(F.array(v)).substr(F.lit(2), F.length(F.to_json(F.array(v))) - 2)))

    return F.transform_values(m, lambda k, v: typed(v))


#: Error of rows that a task did not call any more.
NOT_CALLED = "not called: too many failures"


def complete(df: DataFrame, fn, text: str = "text", key: str = "instance_id",
             retries: int = 3, backoff: float = 0.0, give_up: int | None = None) -> DataFrame:
    """Run ``fn(list[str]) -> list[str]`` over Arrow batches in the tasks.

    Each batch is retried up to ``retries`` times; if it still fails, rows are
    retried one by one and a row that keeps failing gets ``output`` NULL and its
    error message — one bad row never fails the batch.  A task in which ``give_up``
    rows have failed calls no more: its other rows get the error ``NOT_CALLED``.
    Output columns: key, output, error, tokens_in, tokens_out (word counts)."""
    import re

    import pandas as pd

    word = re.compile(r"\w+")

    def call(texts):
        last = None
        for attempt in range(retries):
            try:
                out = list(fn(texts))
                if len(out) != len(texts):
                    raise ValueError(f"{len(out)} answers for {len(texts)} texts")
                return out, None
            except Exception as e:  # noqa: BLE001
                last = e
                if backoff:
                    time.sleep(backoff * (2 ** attempt))
        return None, last

    def run(batches):
        failed = 0
        for pdf in batches:
            texts = pdf[text].fillna("").tolist()
            over = give_up is not None and failed >= give_up
            outs, err = (None, None) if over else call(texts)
            errors = [None] * len(texts)
            if outs is None:
                outs = []
                for i, t in enumerate(texts):
                    if give_up is not None and failed >= give_up:
                        outs.append(None)
                        errors[i] = NOT_CALLED
                        continue
                    o, e = call([t])
                    outs.append(o[0] if o is not None else None)
                    errors[i] = None if o is not None else f"{type(e).__name__}: {e}"
                    failed += o is None
            yield pd.DataFrame({
                key: pdf[key],
                "output": outs,
                "error": errors,
                "tokens_in": [len(word.findall(t)) for t in texts],
                "tokens_out": [len(word.findall(o)) if o else 0 for o in outs],
            })

    key_type = df.schema[key].dataType.simpleString()
    schema = f"{key} {key_type}, output string, error string, tokens_in long, tokens_out long"
    return df.select(key, text).mapInPandas(run, schema)


def fail_budget(results: DataFrame, n: int = 3) -> DataFrame:
    """One row telling whether the run stayed under ``n`` failed rows."""
    return results.agg(F.count_if(F.col("error").isNotNull()).alias("n_failed")) \
        .withColumn("aborted", F.col("n_failed") >= n)
