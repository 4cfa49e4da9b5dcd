from conftest import rows
from pyspark.sql import functions as F

from fixfold.functions import criteria as C
from fixfold.functions.paths import is_test_path
from fixfold.operators import diff as D


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("v")).collect()[0]["v"]


def test_commit_hash(spark):
    h = "a" * 40
    assert _one(spark, C.contains_commit_hash, f"see {h} here") is True
    assert _one(spark, C.contains_commit_hash, f"see x/{h} here") is False
    assert _one(spark, C.contains_commit_hash, "[" + "b" * 23 + "]") is True


def test_image(spark):
    assert _one(spark, C.contains_image, "see a.png") is True
    assert _one(spark, C.contains_image, "see .png") is False
    assert _one(spark, C.contains_image, "see A.PNG now") is True


def test_match_arg_first_branch_returns(spark):
    assert _one(spark, C.contains_match_arg, "pytest.raises(E)\nassertRaises") is False
    assert _one(spark, C.contains_match_arg, "self.assertRaises(E)") is True


def test_test_path_rules(spark):
    assert _one(spark, lambda c: is_test_path(c, "substring"), "src/latest.py") is True
    assert _one(spark, lambda c: is_test_path(c, "word"), "src/latest.py") is False
    assert _one(spark, lambda c: is_test_path(c, "dir"), "a/tests/x.py") is True


def _patch(spark, text):
    df = spark.createDataFrame([("p", text)], "instance_id string, patch string")
    lines = D.patch_lines(df, ["instance_id"])
    return lines, D.patch_files(lines, ["instance_id"]), D.patch_hunks(lines, ["instance_id"])


def test_hunk_counts_and_renumber(spark):
    text = ("diff --git a/f.py b/f.py\n--- a/f.py\n+++ b/f.py\n"
            "@@ -1,2 +1,3 @@\n x\n y\n+z\n@@ -10,3 +11,1 @@\n k\n-l\n-m\n")
    lines, files, hunks = _patch(spark, text)
    got = rows(D.renumber_hunks(hunks, ["instance_id"]), "hunk_idx", "src_start", "new_src_len",
               "new_tgt_start", "new_tgt_len")
    assert got == [(1, 1, 2, 1, 3), (2, 10, 3, 11, 1)]
    f = files.collect()[0]
    assert (f["path"], f["change"], f["n_hunks"]) == ("f.py", "modified", 2)


def test_hunk_limits(spark):
    body = "".join(f"@@ -{i},1 +{i},1 @@\n-a\n+b\n" for i in range(1, 5))
    _, files, _ = _patch(spark, "diff --git a/f.py b/f.py\n--- a/f.py\n+++ b/f.py\n" + body)
    st = D.patch_stats(files, ["instance_id"]).select(D.max_hunks(3).alias("ok")).collect()[0]
    assert st["ok"] is False


def test_new_file_is_not_modified(spark):
    text = "diff --git a/n.py b/n.py\nnew file mode 100644\n--- /dev/null\n+++ b/n.py\n@@ -0,0 +1 @@\n+x\n"
    _, files, _ = _patch(spark, text)
    assert files.collect()[0]["change"] == "added"


def test_named_predicate_cascade(spark):
    from fixfold.functions import registry as REG
    from fixfold.operators.curate import cascade_counts

    df = spark.createDataFrame([("a " * 50, "x/y", "+t", "p"), ("short", "x/y", "+t", "p"),
                                ("b " * 50 + " see http://z", "x/y", "+t", "p")],
                               "problem_statement string, repo string, test_patch string, patch string")
    names = ["statement_long_enough", "statement_without_links", "has_tests"]
    c = cascade_counts(REG.with_predicates(df, names), names).collect()[0]
    assert (c["n_start"], c["after_statement_long_enough"], c["after_statement_without_links"],
            c["after_has_tests"]) == (3, 2, 1, 1)


def test_custom_tokenizer_registry(spark):
    from fixfold.functions import registry as REG

    REG.register_tokenizer("chars", fn=lambda t: [ord(ch) for ch in t])
    df = spark.createDataFrame([("ab",)], "t string")
    assert df.select(REG.TOKENIZERS["chars"](F.col("t")).alias("x")).collect()[0]["x"] == [97, 98]
