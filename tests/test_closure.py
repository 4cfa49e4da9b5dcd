"""The closure of graphs: against a plain search, long chains in few rounds."""

import glob
import random

from conftest import rows
from fixfold.operators import code as CD


def search(edges, roots):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = set()
    for r in set(roots):
        todo, seen = [r], {r}
        while todo:
            for b in after.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out |= {(r, n) for n in seen}
    return sorted(out)


def closure(spark, edges, roots):
    e = spark.createDataFrame(edges, "src long, dst long")
    r = spark.createDataFrame([(x,) for x in roots], "root long")
    return rows(CD.reachable(e, r))


def test_graphs_side_by_side(spark):
    """Random graphs, a ring and a loop as one graph of many parts."""
    r = random.Random(4)
    edges, roots = [(k + 5000, (k + 1) % 40 + 5000) for k in range(40)] + [(9000, 9000)], [5003, 5004, 9000, 9999]
    for part, (n, m) in enumerate(((5, 4), (12, 14), (25, 60)) * 3):
        edges += [(r.randrange(n) + 100 * part, r.randrange(n) + 100 * part) for _ in range(m)]
        roots += [r.randrange(n + 3) + 100 * part for _ in range(n // 2)]
    assert closure(spark, edges, roots) == search(edges, roots)


def test_without_edges(spark):
    assert closure(spark, [], [1, 2]) == [(1, 1), (2, 2)]


def test_a_chain_of_100_000_edges_takes_tens_of_rounds(spark):
    base = spark.sparkContext.getCheckpointDir()
    before = set(glob.glob(base.replace("file:", "") + "/fixfold-stream/closure-*"))
    chain = spark.range(100_000).selectExpr("id as src", "id + 1 as dst")
    out = CD.reachable(chain, spark.createDataFrame([(0,), (99_990,)], "root long"))
    assert out.count() == 100_001 + 11 and out.distinct().count() == out.count()
    made = set(glob.glob(base.replace("file:", "") + "/fixfold-stream/closure-*")) - before
    assert len(made) == 1 and len(glob.glob(made.pop() + "/*")) < 60
