"""The stored substring index against brute force, its extension, and what a search reads."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F


def make(seed, n, first=0):
    rng = random.Random(seed)
    words = ["sun", "Sunny", "day", "rain-y", "x", "the", "50%", "a_b", "été", "storm.", "日本語", "𝔘ni", "\\"]
    text = lambda k: rng.choice([" ", "\n", "  "]).join(rng.choices(words, k=k))
    return [(f"i{i}", text(rng.randint(0, 5)), rng.choice([None, "", text(12)])) for i in range(first, first + n)]


def asked(seed, rows):
    rng = random.Random(seed)
    out = []
    for i in range(40):
        t = "".join(x or "" for x in rng.choice(rows)[1:])
        a = rng.randrange(max(1, len(t)))
        out.append((i, t[a:a + rng.choice([1, 2, 3, 4, 9, 30])]))
    return out + [(50, "nowhere at all"), (51, "\U0010ffff"), (52, "a"), (53, "本"), (54, "sunny day" * 50)]


def brute(rows, queries):
    return {(q, i) for q, t in queries if t.strip(" \t\n\r\x0b\x0c") for i, a, b in rows if t.lower() in a.lower() or t.lower() in (b or "").lower()}


@pytest.mark.parametrize("block", [(1 << 21, 1 << 16), (400, 7)])
def test_index_against_brute_force(spark, tmpdir_fresh, monkeypatch, block):
    from trove.operators import postings as op
    from trove.operators.keyword import keyword_matches
    monkeypatch.setattr(op, "BLOCK_TRIPLES", block[0])
    monkeypatch.setattr(op, "BLOCK_ITEMS", block[1])
    rows, more = make(1, 120), make(2, 60, first=120)
    schema = "item_id string, title string, description string"
    index = op.PostingIndex(spark, f"{tmpdir_fresh}/index").add(spark.createDataFrame(rows, schema).repartition(3))
    stored = {os.path.join(d, f) for d, _, fs in os.walk(tmpdir_fresh) for f in fs}
    index.add(spark.createDataFrame(more, schema))
    assert stored - {f"{tmpdir_fresh}/index/{t}/{f}" for t in ("postings", "blocks") for f in ("_SUCCESS", "._SUCCESS.crc")} <= \
        {os.path.join(d, f) for d, _, fs in os.walk(tmpdir_fresh) for f in fs}
    index.add(spark.createDataFrame(rows[:10], schema))                                 # again: found once
    items = spark.createDataFrame(rows + more, schema)
    for seed in (3, 4):                                                                 # one index, several query sets
        queries = asked(seed, rows + more)
        q = spark.createDataFrame(queries, "query_id long, text string")
        got = [tuple(r) for r in keyword_matches(items, q, ["item_id"], index=index).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows + more, queries)


def test_wildcards_and_queries_without_a_literal(spark, monkeypatch):
    from trove.operators import keyword as K
    monkeypatch.setattr(K, "BLOCK_ITEMS", 10)
    rows = make(5, 35)
    items = spark.createDataFrame(rows, "item_id string, title string, description string")
    queries = [(1, "%"), (2, "_"), (3, "s_n%y"), (4, "50\\%"), (5, "a\\_b"), (6, "%day%"), (7, "d_"), (8, "__%__"), (9, "x%"), (10, "sun%the%day")]
    q = spark.createDataFrame(queries, "query_id long, text string")
    m = K.keyword_matches(items, q, ["item_id"], wildcards=True)
    want = {(i, r["item_id"]) for i, t in queries for r in items.where(
        F.coalesce(F.lower("title").like(f"%{t}%"), F.lit(False)) | F.coalesce(F.lower("description").like(f"%{t}%"), F.lit(False))).collect()}
    assert {tuple(r) for r in m.collect()} == want and (1, "i0") in want
    for df in (m, K.candidates(items, q.select("query_id", F.lower("text").alias("_q")), wildcards=True)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_search_reads_postings_and_no_text(spark, tmpdir_fresh):
    from trove.operators.postings import PostingIndex
    items = spark.createDataFrame(make(6, 50), "item_id string, title string, description string")
    index = PostingIndex(spark, f"{tmpdir_fresh}/index").add(items)
    found = index.candidates(spark.createDataFrame([(1, "storm."), (2, "ny")], "query_id long, piece string"))
    read = found.inputFiles()
    assert found.count() and all(f"{tmpdir_fresh}/index/" in f or "posting-" in f for f in read)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan.replace("PartitionFilters: [isnotnull(part", "PartitionFilters: [part")


def test_postings_are_packed_differences():
    from trove.operators.postings import MARK, pack, triples, unpack
    rng = np.random.default_rng(1)
    lists = [np.sort(rng.choice(1 << 16, n, replace=False)) for n in (1, 500, 1, 1 << 16, 3)]
    ends = np.cumsum([len(x) for x in lists])
    packed = pack(np.concatenate(lists), ends - [len(x) for x in lists])
    for x, end in zip(lists, ends):
        assert unpack(packed[end - len(x):end].tobytes()).tolist() == x.tolist()
    assert packed.itemsize == 2 and len(pack(np.zeros(0, int), np.zeros(0, int))) == 0
    assert triples("").tolist() == [] and len(triples("aaaa")) == 3
    assert triples("a").tolist() == [(97 << 42) | (MARK << 21) | MARK]


def test_empty(spark, tmpdir_fresh):
    from trove.operators.keyword import keyword_matches
    items = spark.createDataFrame(make(7, 5), "item_id string, title string, description string")
    q = spark.createDataFrame([(1, "sun")], "query_id long, text string")
    assert keyword_matches(items.where("false"), q, ["item_id"]).count() == 0
    assert keyword_matches(items, q.where("false"), ["item_id"]).count() == 0
    assert keyword_matches(items.withColumn("title", F.lit(None).cast("string")).withColumn("description", F.lit("")), q, ["item_id"]).count() == 0
