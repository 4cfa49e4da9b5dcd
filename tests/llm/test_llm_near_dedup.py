import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixfold.llm import near_dedup
from fixfold.llm.components import connected_components
from llm_fixtures import edge_docs, edge_rows, empty_docs, frame, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def closure(nodes, links):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def brute(rows, percent):
    sets = {d: shingle_set(t) for d, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, closure(sets, links)


def edited(text, r, share):
    w = text.split()
    for k in range(len(w)):
        if r.random() < share:
            w[k] = f"new{r.randrange(10 ** 6)}"
    return " ".join(w)


def corpus(seed, groups=12, copies=8):
    r, rows = random.Random(seed), []
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))  # many documents share it
    for g in range(groups):
        base = " ".join(r.choice(vocabulary) for _ in range(r.randint(5, 260)))
        if g % 3 == 0:
            base = passage + " " + base
        for _ in range(copies):
            rows.append((len(rows), edited(base, r, r.choice([0, 0.004, 0.01, 0.02, 0.04, 0.08])), "en"))
    r.shuffle(rows)
    return rows


def check(found, rows, percent):
    sets, root = brute([(d, t) for d, t, _ in rows], percent)
    got = {r["doc_id"]: r for r in found.collect()}
    assert set(got) == set(sets)
    for d, r in got.items():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[d]), root[d], root[d] == d)


@pytest.mark.parametrize("percent", [80, 85])
def test_against_brute_force(spark, percent):
    rows = corpus(percent)
    check(near_dedup.near_duplicates(frame(spark, rows), percent=percent), rows, percent)


def test_blocks_of_a_large_group(spark):
    """A component over many blocks: chains, hubs and leftovers are still exact."""
    r = random.Random(4)
    base = " ".join(f"b{r.randrange(2000)}" for _ in range(150))
    rows, text = [], base
    for k in range(60):
        text = edited(text, r, 0.005) if k % 2 else text
        rows.append((k, edited(text, r, r.choice([0, 0.01, 0.02, 0.03])), "en"))
    check(near_dedup.near_duplicates(frame(spark, rows), percent=85, block_rows=4), rows, 85)


def test_near_misses_are_dealt_as_pairs_of_blocks(spark, monkeypatch):
    """A component of near misses with few links: exact, and no group holds more than about two blocks."""
    r, sizes, whole = random.Random(21), [], near_dedup._confirmed
    base = [f"b{r.randrange(2000)}" for _ in range(150)]
    rows = []
    for k in range(90):  # one template, eight words filled in: about 0.6 alike
        text = list(base)
        for at in range(8, 150, 40):
            text[at] = f"own{k // 2 if k % 6 < 2 else k}"
        rows.append((k, " ".join(text), "en"))

    def counted(rows, *args):
        sizes.extend(x["count"] for x in rows.groupBy("component", "block").count().collect())
        return whole(rows, *args)

    monkeypatch.setattr(near_dedup, "_confirmed", counted)
    rows += [(100 + k, edited(" ".join(base), r, 0.002), "en") for k in range(40)]
    found = near_dedup.near_duplicates(frame(spark, rows), percent=85, block_rows=8)
    check(found, rows, 85)
    assert sum(n > 8 for n in sizes) > 20 and max(sizes) <= 2 * 2 * 8  # blocks are dealt by hash


def test_keys_of_many_rows_are_not_gathered(spark, monkeypatch):
    """Rows of a key over ``whole_run`` are connected without coming into one task."""
    r, gathered = random.Random(31), []
    base = " ".join(f"b{r.randrange(2000)}" for _ in range(150))
    docs = frame(spark, [(k, edited(base, r, 0.01), "en") for k in range(40)]
                + [(100 + k, prose(k, 150), "en") for k in range(5)])
    index = near_dedup.Index.for_threshold(0.85)
    signed = near_dedup.checkpointed(near_dedup.fingerprints(docs, "doc_id", "text", index, 5).select("id", "sig", "keys"))
    want = connected_components(near_dedup.candidate_edges(signed, index)).collect()
    kind = type(docs)
    whole = kind.mapInArrow

    def counted(df, *args, **kw):
        gathered.append(df.groupBy("key").count().agg(F.max("count")).first()[0])
        return whole(df, *args, **kw)

    monkeypatch.setattr(kind, "mapInArrow", counted)
    got = connected_components(near_dedup.candidate_edges(signed, index, whole_run=6)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert max(gathered) <= 6


def test_index_guarantee():
    """All signature pairs within the radius share a key, whichever positions differ."""
    index = near_dedup.Index.for_threshold(0.85)
    signer, r = near_dedup.Signer(index), np.random.default_rng(5)
    plan = index.plan()
    assert sorted(p for a, b, _ in plan for p in range(a, b)) == list(range(index.positions))
    value = r.integers(0, 1 << 16, index.positions).astype(np.uint64)

    def keys(v):
        return set((near_dedup._mix((v[signer.take] * signer.odd).sum(1) + signer.salts)).tolist())

    for _ in range(300):
        other = value.copy()
        at = r.choice(index.positions, index.radius, replace=False)
        other[at] += np.uint64(1)
        assert keys(value) & keys(other)


def test_shingles_take_ascii_case_and_white_space_only():
    s = near_dedup.Shingler()
    assert (s.shingles("A B\x0bC\x0cD e") == s.shingles("a b c d E")).all()
    assert len(s.shingles("É a b c d")) == 1 and (s.shingles("É a b c d") != s.shingles("é a b c d")).all()
    assert len(s.shingles("a b c")) == 1 and len(s.shingles(" \n")) == 0 and len(s.shingles(None)) == 0
    text = prose(9, 400)
    assert len(s.shingles(text)) == len(shingle_set(text))


def test_edge_rows(spark):
    got = near_dedup.near_duplicates(edge_docs(spark)).collect()
    assert len(got) == len(edge_rows())
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for d in (1, 2, 3):
        assert [(r["n_shingles"], r["component_id"], r["kept"]) for r in by[d]] == [(0, d, True)]
    assert len(by[5]) == 2 and all(r["component_id"] == 5 and r["kept"] for r in by[5])
    assert len(by[None]) == 2 and all(r["component_id"] is None for r in by[None])
    assert near_dedup.near_duplicates(empty_docs(spark)).count() == 0


def test_keep_one(spark):
    rows = corpus(77, groups=5, copies=5)
    docs = frame(spark, rows)
    kept = near_dedup.keep_one(docs.union(docs.limit(3)))
    assert kept.columns == docs.columns
    _, root = brute([(d, t) for d, t, _ in rows], 80)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d in root if root[d] == d)
    assert near_dedup.keep_one(edge_docs(spark)).count() == len(edge_rows()) - 1  # one repeated row goes


def test_components(spark):
    r = random.Random(8)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(40)] + [(7, 7)]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == closure(nodes, links + [(n, n) for n in nodes]) if 7 in nodes else True
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert connected_components(spark.createDataFrame([(1, None), (2, 2)], "a long, b long")).count() == 0
