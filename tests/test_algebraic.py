"""Algebraic checks over the registered queries at sf0.001."""

import __spark_entry__ as entry
from pyspark.sql import functions as F

from fixfold.operators import diff as D

SF = "/root/testdata/sf0.001"


def q(spark, name):
    return entry.queries()[name](spark, SF)


def test_repair_is_idempotent(spark):
    once = q(spark, "repair_patch")
    again = D.repair_patch(D.patch_lines(once.withColumnRenamed("repaired", "patch"), ["instance_id"]),
                           ["instance_id"])
    diff = once.join(again.withColumnRenamed("repaired", "again"), "instance_id") \
        .where(F.col("repaired") != F.col("again"))
    assert once.count() > 0 and diff.count() == 0


def test_spans_are_containment_free(spark):
    s = q(spark, "drop_contained")
    a, b = s.alias("a"), s.alias("b")
    inside = a.join(b, ["instance_id", "file"]).where(
        (F.col("a.start") >= F.col("b.start")) & (F.col("a.end") <= F.col("b.end"))
        & ~((F.col("a.start") == F.col("b.start")) & (F.col("a.end") == F.col("b.end"))
            & (F.col("a.loc_pos") == F.col("b.loc_pos")) & (F.col("a.line_pos") == F.col("b.line_pos"))))
    assert inside.count() == 0


def test_packing_stays_under_budget(spark):
    from fixfold.plans.retrieve_plans import BUDGET

    p = q(spark, "pack_context")
    assert p.where(F.col("total") >= BUDGET).count() == 0


def test_decontaminated_train_has_no_eval_repo(spark):
    train = q(spark, "exclude_groups")
    ev = q(spark, "lite_set")
    inst = entry.queries()["order_by_id"](spark, SF)
    train_repos = train.join(inst, "instance_id").select("repo").distinct()
    assert train_repos.join(ev.select("repo").distinct(), "repo").count() == 0


def test_gold_patches_grade_consistently(spark):
    # every dataset id lands in exactly one run-report class (checked per id)
    r = q(spark, "run_report")
    assert r.groupBy("instance_id").count().where("count > 1").count() == 0
