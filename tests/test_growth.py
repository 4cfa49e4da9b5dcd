"""Jobs whose cost has to grow with the input: one plan fact and the rows of each."""

import glob
import random

from conftest import rows
from fixfold.operators import code as CD
from fixfold.operators import curate as CU
from fixfold.operators import locate as LC
from fixfold.operators import retrieval as R
from test_closure import closure, search


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_edit_diff_makes_no_python_group_per_answer(spark):
    a = spark.createDataFrame([
        ("k", 0, "b.py", "x\n", "x\n"), ("k", 1, "b.py", "x\n", "y\n"), ("k", 1, "a.py", "1\n2", "1\n3"),
        ("k", 2, "a.py", "1\n", "2\n"), ("same", 0, "a.py", "1\n", "1\n")],
        "instance_id string, attempt int, file string, old string, new string")
    d = LC.edit_diff(a)
    assert "FlatMapGroupsInPandas" not in plan_of(d)
    assert rows(d.select("instance_id", "attempt", "model_patch")) == [("k", 1, (
        "diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n@@ -1,2 +1,2 @@\n 1\n-2\n\\ No newline at end of file\n"
        "+3\n\\ No newline at end of file\n"
        "diff --git a/b.py b/b.py\n--- a/b.py\n+++ b/b.py\n@@ -1 +1 @@\n-x\n+y\n"))]


def test_closure_of_nodes_that_include_each_other(spark):
    r = random.Random(7)
    edges = [(r.randrange(30), r.randrange(30)) for _ in range(25)]
    edges += [(b, a) for a, b in edges[::2]] + [(40 + k, 41 + k) for k in range(30)] + [(41 + k, 40 + k) for k in range(30)]
    roots = [0, 3, 5, 5, 12, 29, 47, 99]
    assert closure(spark, edges, roots) == search(edges, roots)


def test_closure_of_a_tree_of_pairs_takes_one_sweep(spark):
    base = spark.sparkContext.getCheckpointDir().replace("file:", "") + "/fixfold-stream/closure-*"
    before = set(glob.glob(base))
    k = range(2000)
    edges = [(x // 4, x) for x in k] + [(x, x ^ 1) for x in k]
    assert closure(spark, edges, [1, 2, 77]) == search(edges, [1, 2, 77])
    made = set(glob.glob(base)) - before
    assert len(made) == 1 and not glob.glob(made.pop() + "/sweep2-0")


def test_import_edges_of_a_hub_directory_are_made_in_parts(spark):
    files = [("r", f"pkg/m{k}.py", "import pkg\nfrom pkg import x") for k in range(9)] * 2 + [("r", "tool.py", "import pkg"), ("q", "pkg/m0.py", "import pkg")]
    f = spark.createDataFrame(files, "repo string, path string, text string")
    e = CD.import_edges(f, key="repo", part=2)
    want = [("q", "pkg/m0.py", "pkg/m0.py")] + [("r", s, f"pkg/m{k}.py") for s in [*(f"pkg/m{j}.py" for j in range(9)), "tool.py"] for k in range(9)]
    assert rows(e) == sorted(want)


def test_sample_reads_its_rows_twice_at_most(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(len(b))
            yield b

    ids = spark.range(500).selectExpr("id as instance_id")
    got = rows(CU.sample_n(ids.mapInPandas(count, "instance_id long"), 20, few=10))
    assert read.value <= 1000 and len(got) == 20 and got == rows(CU.sample_n(ids, 20))


def test_index_sends_texts_and_not_tokens(spark):
    d = spark.createDataFrame([("c", "a", "x y x"), ("c", "a", "y z w"), ("c", "b", "x"), (None, "n", "x")], "corpus string, docid string, contents string")
    f = R.frequencies(d)
    assert f._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert rows(f.where("corpus is not null")) == [("c", "a", 3, "w", 1), ("c", "a", 3, "x", 2), ("c", "a", 3, "y", 2), ("c", "a", 3, "z", 1), ("c", "b", 1, "x", 1)]
