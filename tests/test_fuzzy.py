"""Fuzzy title match against a brute-force edit distance."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(queries, items, d):
    groups = [defaultdict(list), defaultdict(list)]
    for group, rows in zip(groups, (queries, items)):
        for i, t in rows:
            if t is not None:
                group[t.lower()].append(i)
    return {(min(qs), len(qs), min(ts), len(ts), edits(q, t)) for q, qs in groups[0].items() for t, ts in groups[1].items()
            if abs(len(q) - len(t)) <= d and edits(q, t) <= d}


def change(rng, t, n):
    for _ in range(n):
        k = rng.randrange(len(t) + 1)
        t = rng.choice([t[:k] + rng.choice("abé") + t[k:], t[:k] + t[k + 1:], t[:k] + rng.choice("abé") + t[k + 1:]])
    return t


def make(seed):
    rng = random.Random(seed)
    titles = ["".join(rng.choices("abé ", k=rng.choice([0, 1, 2, 3, 4, 5, 6, 9, 14, 30]))) for _ in range(150)]
    # a third share their first segments
    titles += ["The Adventures of " + "".join(rng.choices("abc", k=rng.randint(0, 6))) for _ in range(75)]
    items = [(i, t) for i, t in enumerate(titles)] + [(900, None), (901, titles[200]), (902, titles[200].upper()), (903, "")]
    queries = [(i, change(rng, rng.choice(titles), rng.randint(0, 3))) for i in range(60)]
    return queries + [(70, None), (71, ""), (72, queries[3][1]), (73, queries[3][1])], items


@pytest.mark.parametrize("d,crowd,block", [(2, 1 << 16, 1 << 10), (2, 8, 4), (1, 4, 3), (3, 30, 7)])
def test_fuzzy_title_match(spark, monkeypatch, d, crowd, block):
    from trove.operators import fuzzy
    monkeypatch.setattr(fuzzy, "CROWD", crowd)
    monkeypatch.setattr(fuzzy, "BLOCK", block)
    queries, items = make(d + crowd)
    q = spark.createDataFrame(queries, "query_id long, text string")
    t = spark.createDataFrame(items, "item_id long, title string")
    got = [tuple(r) for r in fuzzy.fuzzy_title_match(q, t, d).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(queries, items, d)
    if crowd == 8:
        assert fuzzy.fuzzy_title_match(q.where("false"), t, d).count() == 0 == fuzzy.fuzzy_title_match(q, t.where("false"), d).count()
        assert {(r.item_id, r.title_id) for r in fuzzy.title_classes(t).collect()} == {
            (i, min(j for j, u in items if u is not None and u.lower() == s.lower())) for i, s in items if s is not None}


def test_crowded_segments_go_on_to_longer_keys(spark, monkeypatch):
    """A third of the titles share a segment: the join of the first keys leaves
    them out, and the candidates stay far below titles x queries."""
    from trove.operators import fuzzy
    monkeypatch.setattr(fuzzy, "CROWD", 200)
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=24))
    titles = [(i, "the collected works of " + word()) if i % 3 == 0 else (i, word() + word()) for i in range(1200)]
    queries = [(i, change(rng, t, 2)) for i, t in titles if i % 20 == 0]
    t = spark.createDataFrame([(i, x) for i, x in titles], "t long, text string")
    q = spark.createDataFrame(queries, "q long, text string")
    pairs = {tuple(r) for r in fuzzy.candidate_pairs(t, q, 2).collect()}
    assert {(i, i) for i, _ in queries} <= pairs and len(pairs) < 2 * len(queries)
    plan = fuzzy.fuzzy_title_match(q.withColumnRenamed("q", "query_id"), t.select(F.col("t").alias("item_id"), F.col("text").alias("title"))) \
        ._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_moves_are_what_d_edits_allow():
    from trove.operators.fuzzy import _moves
    assert _moves(2, 0, 1) == [(-1,), (0,), (1,)] and _moves(2, 2, 1) == [(0,), (1,), (2,)] and _moves(2, -1, 1) == [(-1,), (0,)]
    assert all(abs(a) + abs(b - a) + abs(1 - b) <= 2 for a, b in _moves(2, 1, 2))
