"""Operators whose work must stay bounded: aborts, nested pages, gram index, name postings, samples."""

import hashlib
import os
import random
import time
import uuid


from conftest import rows
from fixfold.operators import curate as CU
from fixfold.operators import infer as I
from fixfold.operators import locate as LC
from fixfold.operators import pages as PG
from fixfold.operators import repair as RP
from fixfold.operators import retrieval as R


def counted(folder, answer):
    def fn(texts):
        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            f.write(str(len(texts)))
        return answer(texts)
    return fn


def test_a_model_that_always_fails_is_called_a_bounded_number_of_times(spark, tmp_path):
    def never(texts):
        raise RuntimeError("down")

    calls = []
    for n in (300, 1200):
        folder = tmp_path / str(n)
        folder.mkdir()
        df = spark.createDataFrame([(f"i{k:05d}", "some text") for k in range(n)], "instance_id string, text string")
        out = RP.run_inference(df, counted(str(folder), never), "gpt-4-0613", max_failures=3, task_failures=2, wave_rows=100)
        failed = out.where("error is not null").count()
        assert 3 <= failed <= 100 and out.where("error is null").count() == 0
        assert I.fail_budget(out, 3).first()["aborted"]
        calls.append(len(os.listdir(folder)))
    # a task: one batch of three tries, then two rows of three tries each
    assert max(calls) <= 9 * 100 and calls[1] <= calls[0] + 9 * 8


def test_rows_that_were_not_called_are_taken_up_later(spark):
    def moody(texts):
        if any(t == "bad" for t in texts):
            raise ValueError("no")
        return [t + "!" for t in texts]

    df = spark.createDataFrame([(k, "bad" if k < 4 else "longer text %d" % k) for k in range(12)], "instance_id long, text string")
    first = RP.run_inference(df, moody, "gpt-4-0613", max_failures=3, wave_rows=4)
    assert rows(first, "instance_id") == [(k,) for k in range(4)]
    later = RP.run_inference(df, moody, "gpt-4-0613", done=first, max_failures=3, wave_rows=4)
    assert rows(later.where("error is null"), "instance_id") == [(k,) for k in range(4, 12)]


def test_tracker_boxes_nest(spark):
    ticket = ('<div id="x"><h1 class="searchable">no</h1></div><div  class="a b" ID=ticket ><div><div></div></div>'
              '<h1 class="t searchable">\n A &lt;b&gt;\n  title </h1><div class="long description"><p>one</p>\n\n\n'
              '<div>two      three<div>  four</div></div>\n    five</div><div class="description">six</div></div><div class="description">seven</div>')
    pages = [(1, ticket), (2, "<div id='ticket'><div class='description'>open  end"), (3, "<p>none</p>"), (4, None), (5, ""),
             (6, '<!-- <div id="ticket"> --><div id="tickets"><div class="descriptions">no</div></div>'),
             (7, '<div id="ticket"></div><div class="description">outside</div>')]
    got = rows(PG.tracker_tickets(spark.createDataFrame(pages, "page_id int, html string")))
    assert got == [(1, "A <b> title", "one\ntwo\t three four\n\tfive"), (2, None, "open end"), (3, None, None), (4, None, None),
                   (5, None, None), (6, None, None), (7, None, None)]


def test_short_passages_against_brute_force(spark):
    r = random.Random(6)
    words = ["".join(r.choice("abcé") for _ in range(r.randrange(1, 7))) for _ in range(60)] + ["漢字🙂ab"]
    docs = [("c", f"d{k}", " ".join(r.choice(words) for _ in range(8))) for k in range(40)]
    d = spark.createDataFrame(docs, "corpus string, docid string, contents string")
    passages = [(k, "c", p) for k, p in enumerate(["a", "é", "ab", "abc", "cab a", "zzz", "字🙂", "bca", "aab bc", "b a"])]
    got = rows(R.containing_docs(R.bm25_index(d), d, spark.createDataFrame(passages, "qid int, corpus string, text string")).select("qid", "docid"))
    assert got == sorted((q, i) for q, _, p in passages for _, i, t in docs if p in t)


def test_a_long_term_costs_its_length(spark):
    def seconds(n):
        term = "".join(random.Random(1).choice("abcdefgh") for _ in range(n))
        d = spark.createDataFrame([("c", "x", f"say {term} twice"), ("c", "y", "other words")], "corpus string, docid string, contents string")
        p = spark.createDataFrame([("q", "c", term[n // 2:n // 2 + 9])], "qid string, corpus string, text string")
        begin = time.time()
        assert rows(R.containing_docs(R.bm25_index(d), d, p).select("docid")) == [("x",)]
        return time.time() - begin

    seconds(1_000)
    assert seconds(100_000) < 4 * seconds(1_000) + 5


def test_variables_meet_only_lines_of_their_ending(spark):
    lines = [(1, "x=1"), (2, "max =2"), (3, "x == y"), (4, "a.x = b=x"), (5, "nothing x"), (6, "xx= é=3"), (7, "==x =")]
    fl = spark.createDataFrame([("i", "m.py", n, t) for n, t in lines], "instance_id string, path string, line_no int, text string")
    names = ["x", "max", "a.x", "b", "é", "y", "xx", "==x", "x = b"]
    var = spark.createDataFrame([("i", 0, "m.py", k, "variable", n, None) for k, n in enumerate(names)],
                                "instance_id string, loc_pos int, file string, line_pos int, kind string, name string, cls string")
    sym = spark.createDataFrame([], "instance_id string, path string, kind string, cls string, name string, start int, end int")
    got = rows(LC.resolve_locations(var, sym, fl).select("line_pos", "sub"))
    assert got == sorted((k, n) for k, v in enumerate(names) for n, t in lines if v + "=" in t or v + " =" in t)


def test_sample_is_the_n_smallest(spark):
    ids = [f"id{k}" for k in range(3000)] + [None, None] + ["id7"] * 5
    df = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "instance_id string, v int").repartition(6)
    order = sorted(ids, key=lambda i: ("" if i is None else hashlib.md5(f"42:{i}".encode()).hexdigest(), i or ""))
    seventh = order.index("id7") + 1
    for n in (0, 1, 2, 3, 1500, seventh + 2, 3007, 9999):
        got = [r["instance_id"] for r in CU.sample_n(df, n, few=50).collect()]
        assert sorted(got, key=repr) == sorted(order[:n], key=repr), n
    plan = CU.sample_n(df, 1500)._jdf.queryExecution().executedPlan().toString()
    assert "Limit" not in plan and "TakeOrdered" not in plan


def test_a_search_reads_its_tables_anew(spark, tmp_path):
    """Two calls after the file has changed give the new answer."""
    from fixfold.plans.retrieve_plans import QUERIES

    def write(text):
        spark.createDataFrame([(k, t, "en", "web", len(t)) for k, t in enumerate([text, "other words here"], 1)],
                              "doc_id long, text string, lang string, source string, n_chars long").coalesce(1) \
            .write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")

    spark.createDataFrame([(k, "unique needle phrase") for k in range(1, 9)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    write("a unique needle phrase inside")
    first = QUERIES["bm25_search"](spark, str(tmp_path)).count()
    write("nothing of the kind")
    spark.catalog.refreshByPath(f"{tmp_path}/documents.parquet")
    assert QUERIES["bm25_search"](spark, str(tmp_path)).count() == 0 < first


def test_malformed_dates_and_versions_in_the_row(spark):
    from fixfold.operators import versions as VE

    names = [("r", "[1.2.3] - 2021-13-45", "2021-02-03 00:00:00"), ("r", "[1.3.0] - 2021-04-05", "2022-01-01 00:00:00")]
    got = VE.releases_from_names(spark.createDataFrame(names, "repo string, name string, published_at string"))
    assert [(r["version"], str(r["released_at"])) for r in got.orderBy("version").collect()] == [("1.2", "2021-02-03"), ("1.3", "2021-04-05")]
    files = spark.createDataFrame([("a", "nobody/else", '__version__ = "3.4.5"'), ("b", "nobody/else", "nothing"), ("c", None, "__version__ = '7.8'")],
                                  "instance_id string, repo string, text string")
    found = VE.find_version(files)
    assert rows(found)[:2] == [("a", "3.4"), ("b", None)]
