"""Re-validation over a configuration sweep and environment grouping.

Every step is a join or an aggregate keyed by (config, instance) or
(repo, version); the "best configuration" is a max over a small
(repo, version, config) count table, not a loop over files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixfold.functions.harness import fingerprint


def revalidate(instances: DataFrame, statuses: DataFrame, logs: DataFrame) -> DataFrame:
    """Per (config, instance): ``no_log`` when the config has no log for
    it; ``reproduce_fail`` when none of the old FAIL_TO_PASS tests passed;
    else ``kept`` with the new F2P (passed ∩ old F2P) and new P2P (passed ∖ old
    F2P) counts and whether each list changed.

    ``instances``: (instance_id, repo, version, f2p array<string>, p2p array<string>)
    ``statuses``: (config, instance_id, test_case, status) — last status per test
    ``logs``: (config, instance_id) pairs that have a log."""
    inst = instances.select("instance_id", "repo", "version", "f2p", "p2p")
    old = inst.select("instance_id", F.explode("f2p").alias("test_case")).withColumn("is_f2p", F.lit(True))
    passed = statuses.where(F.col("status") == "PASSED").select("config", "instance_id", "test_case") \
        .join(old, ["instance_id", "test_case"], "left") \
        .withColumn("is_f2p", F.coalesce("is_f2p", F.lit(False)))
    per = passed.groupBy("config", "instance_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("is_f2p"), F.col("test_case")))).alias("f2p_new"),
        F.array_sort(F.collect_list(F.when(~F.col("is_f2p"), F.col("test_case")))).alias("p2p_new"))
    base = logs.select("config", "instance_id").distinct().withColumn("has_log", F.lit(True))
    j = base.join(inst, "instance_id").join(per, ["config", "instance_id"], "left")
    empty = F.array().cast("array<string>")
    f2p_new, p2p_new = F.coalesce("f2p_new", empty), F.coalesce("p2p_new", empty)
    cls = F.when(F.size(f2p_new) == 0, F.lit("reproduce_fail")).otherwise(F.lit("kept"))
    out = j.select("config", "instance_id", "repo", "version", cls.alias("status"),
                   F.when(cls == "kept", f2p_new).alias("f2p_new"),
                   F.when(cls == "kept", p2p_new).alias("p2p_new"),
                   F.when(cls == "kept", F.array_sort("f2p") != f2p_new).alias("changed_f2p"),
                   F.when(cls == "kept", F.array_sort("p2p") != p2p_new).alias("changed_p2p"))
    return out


def no_log_pairs(instances: DataFrame, configs: DataFrame, logs: DataFrame) -> DataFrame:
    """A23 ``no_log`` class: (config, instance) pairs without a log.  ``configs``
    lists (config, repo): a config is expected to run every instance of the
    repositories it covers, so pairs come from an equi-join on repo."""
    pairs = configs.join(instances.select("instance_id", "repo", "version"), "repo")
    return pairs.join(logs.select("config", "instance_id"), ["config", "instance_id"], "left_anti") \
        .withColumn("status", F.lit("no_log"))


def best_config(kept: DataFrame, order: DataFrame) -> DataFrame:
    """Per (repo, version) the config that keeps the most instances; ties go
    to the config listed first (``order``: config, pos); no kept instance → none."""
    counts = kept.where(F.col("status") == "kept").groupBy("repo", "version", "config") \
        .agg(F.count(F.lit(1)).alias("n_kept")).join(order, "config")
    return counts.groupBy("repo", "version").agg(
        F.max_by("config", F.struct("n_kept", -F.col("pos"))).alias("config"),
        F.max("n_kept").alias("n_kept"))


def rebuild_dataset(best: DataFrame, kept: DataFrame) -> DataFrame:
    """The kept rows of each (repo, version)'s best config, ordered by id."""
    return kept.where(F.col("status") == "kept").join(best.select("repo", "version", "config"),
                                                      ["repo", "version", "config"]).orderBy("instance_id")


def env_groups(instances: DataFrame, script: str = "setup_script") -> DataFrame:
    """Distinct environments (first 22 hex of the setup script's sha256)
    and how many instances share each."""
    return instances.withColumn("env_key", fingerprint(F.col(script))).groupBy("env_key").agg(
        F.min(script).alias(script), F.count(F.lit(1)).alias("n_instances"))


def route_by_list(df: DataFrame, ids: DataFrame, key: str = "instance_id",
                  default: str = "arm64", listed: str = "x86_64", name: str = "arch") -> DataFrame:
    """Instances on the exception list get the other architecture."""
    flag = ids.select(F.col(ids.columns[0]).alias(key)).distinct().withColumn("_listed", F.lit(True))
    return df.join(flag, key, "left").withColumn(
        name, F.when(F.col("_listed"), F.lit(listed)).otherwise(F.lit(default))).drop("_listed")
