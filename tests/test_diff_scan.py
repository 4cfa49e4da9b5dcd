"""The line scan of patches: against a plain state machine, and its time."""

import random
import re
import time

from pyspark.sql import functions as F

from fixfold.operators import diff as D

HEADER = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def walk(patch, lenient=False):
    """(pos, line, file_idx, hunk_idx, kind) line by line."""
    lines = patch.split("\n")
    has_git = any(x.startswith("diff --git ") for x in lines)
    file = hunk = src = tgt = 0
    out = []
    for pos, line in enumerate(lines):
        after = lines[pos + 1] if pos + 1 < len(lines) else ""
        if has_git:
            starts = line.startswith("diff --git ")
        else:
            starts = line.startswith("--- ") and after.startswith("+++ ") and (lenient or not (src > 0 or tgt > 0))
        if starts:
            file, hunk, src, tgt = file + 1, 0, 0, 0
        elif line.startswith("@@ "):
            hunk += 1
            m = HEADER.match(line)
            src, tgt = ((int(m[2] or 1), int(m[4] or 1)) if m else (0, 0))
        else:
            src -= line[:1] not in ("+", "\\") and src > 0
            tgt -= line[:1] not in ("-", "\\") and tgt > 0
        kind = ("header" if hunk == 0 else "hunk" if line.startswith("@@ ") else
                {"+": "added", "-": "removed", " ": "context"}.get(line[:1], "other"))
        out.append((pos, line, file, hunk, kind))
    return out


def random_patch(r):
    line = lambda: r.choice(["+x", "-y", " z", "", "\\ No newline", "--- a/q", "+++ b/q", "--- gone", "@@ -1 +1 @@",
                             f"@@ -{r.randrange(9)},{r.randrange(5)} +1,{r.randrange(5)} @@ f", "@@ broken", "junk"]
                            + ["diff --git a/q b/q"] * (r.random() < 0.2))
    return "\n".join(line() for _ in range(r.randrange(1, 40)))


def test_scan_equals_the_state_machine(spark):
    r = random.Random(11)
    patches = [(k, random_patch(r)) for k in range(600)] + [(1000, ""), (1001, "\n"), (1002, "--- a\n+++ b")]
    df = spark.createDataFrame(patches + [(1003, None)], "id long, patch string")
    for lenient in (False, True):
        got = {}
        for x in D.patch_lines(df, ["id"], lenient=lenient).collect():
            got.setdefault(x["id"], []).append(tuple(x)[1:])
        assert set(got) == {k for k, _ in patches}
        for k, p in patches:
            assert sorted(got[k]) == walk(p, lenient), p


def big_patch(lines):
    files = []
    for k in range(lines // 100):
        files += [f"diff --git a/f{k}.py b/f{k}.py", f"--- a/f{k}.py", f"+++ b/f{k}.py", "@@ -1,48 +1,48 @@"]
        files += [" same", "-old", "+new"] * 32
    return "\n".join(files)


def test_a_patch_of_100_000_lines_takes_seconds(spark):
    def seconds(n):
        df = spark.createDataFrame([(1, big_patch(n))], "id long, patch string")
        begin = time.time()
        lines = D.patch_lines(df, ["id"])
        row = D.patch_files(lines, ["id"]).agg(F.count("*"), F.sum("added"), F.sum("removed")).first()
        assert tuple(row) == (n // 100, n // 100 * 32, n // 100 * 32)
        return time.time() - begin

    seconds(10_000)
    half, whole = min(seconds(100_000) for _ in range(2)), min(seconds(200_000) for _ in range(2))
    assert half < 20 and whole <= 2.5 * half


def test_text_is_sent_once(spark):
    lines = D.patch_lines(spark.createDataFrame([(1, "--- a\n+++ b")], "id long, patch string"), ["id"])
    for out in (D.split_patch(lines, ["id"]), D.minimal_patch(lines, ["id"]), D.repair_patch(lines, ["id"])):
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
