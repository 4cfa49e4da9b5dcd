from conftest import rows

from fixfold.operators import voting as V


def _attempts(spark, data):
    return spark.createDataFrame(data, "instance_id string, run_id string, patch string, resolved boolean")


def test_weighted_vote_and_pass_at_k(spark):
    # P by r1, r2 (unresolved); Q by r3, django_r4 (resolved): P 2 votes, Q 1.9
    a = _attempts(spark, [("i", "r1", "+P", False), ("i", "r2", "+P", False),
                          ("i", "r3", "+Q", True), ("i", "django_r4", "+Q", True)])
    votes = V.vote_counts(a)
    got = {r["patch"]: float(r["votes"]) for r in votes.collect()}
    assert got == {"+P": 2.0, "+Q": 1.9}
    d = V.decide(V.vote_leaders(votes)).collect()[0]
    assert d["pass1"] is False and d["best_resolved_rank"] == 2
    ds = spark.createDataFrame([("i",)], "instance_id string")
    pk = {r["k"]: r["n_pass"] for r in V.pass_at_k(V.decide(V.vote_leaders(votes)), ds, ds).collect()}
    assert pk[1] == 0 and pk[3] == 1 and pk[50] == 1


def test_decimal_weights_tie(spark):
    # ten 0.9 votes equal nine 1 votes exactly (a float sum would not)
    data = [("i", f"django_r{k}", "+A", False) for k in range(10)]
    data += [("i", f"r{k}", "+B\n-c", True) for k in range(9)]
    d = V.decide(V.vote_leaders(V.vote_counts(_attempts(spark, data)))).collect()[0]
    assert float(d["top_votes"]) == float(d["second_votes"]) == 9.0
    # tie → fewer +/- characters wins: "+A" (1) < "+B\n-c" (2) → rank 1 decides (unresolved)
    assert d["pass1"] is False


def test_same_line_set_branch(spark):
    # rank 1 "+a\n+a" (2 lines), rank 2 "+a": same set, rank 1 longer → rank 1 decides
    data = [("i", "r1", "+a\n+a", True), ("i", "r2", "+a\n+a", True), ("i", "r3", "+a", False)]
    d = V.decide(V.vote_leaders(V.vote_counts(_attempts(spark, data)))).collect()[0]
    assert d["pass1"] is True


def test_tie_prefers_rank_two_when_equal_chars(spark):
    data = [("i", "r1", "+a", False), ("i", "r2", "+b", True)]
    d = V.decide(V.vote_leaders(V.vote_counts(_attempts(spark, data)))).collect()[0]
    # equal votes, equal sign counts → rank 2 decides; rank 1 is r1's patch (lower run id)
    assert d["top_patch"] == "+a" and d["pass1"] is True


def test_pass_at_k_monotone(spark):
    import __spark_entry__ as e

    out = {r["k"]: r["n_pass"] for r in e.queries()["pass_at_k"](spark, "/root/testdata/sf0.001").collect()}
    ks = sorted(out)
    assert all(out[a] <= out[b] for a, b in zip(ks[1:], ks[2:]))


def test_dedupe_outputs(spark):
    df = spark.createDataFrame([("i", "x"), ("i", "x"), ("i", "y"), ("i", "z"), ("i", "z")],
                               "instance_id string, text string")
    got = rows(V.dedupe_outputs(df), "text", "n", "freq_rank")
    assert got == [("x", 2, 1), ("y", 1, 2), ("z", 2, 1)]
