import json
import os
import time

from pyspark.sql import functions as F

from trove.plans import rag as R


def test_fallback_split_parse_round_trip(spark):
    q = spark.createDataFrame([(1, "dragons"), (2, "nothing")], "query_id long, text string")
    res = spark.createDataFrame([(1, 1, "Dragon A", "2001-05-01", ["RPG"], "d1"),
                                 (1, 2, "Dragon B", None, [], "d2")],
                                "query_id long, rank int, title string, release_date string, genres array<string>, description string")
    ans = {r["query_id"]: r for r in R.rag_answers(q, res).collect()}
    assert ans[2]["n_games"] == 0 and ans[2]["response"] == "I couldn't find any games matching your search for 'nothing'."
    text = ans[1]["response"]
    assert text.startswith("Based on your query, I found 2 highly relevant games:")
    thinking = "Let me think carefully about which of these games fits best for dragons fans."
    df = spark.createDataFrame([(1, thinking + "\n\n" + text)], "id long, t string")
    s = df.select(R.split_reasoning(F.col("t")).alias("s")).first()["s"]
    assert s["thinking"] == thinking and s["analysis"] == text.strip()
    parsed = R.parse_recommendations(df.select("id", F.lit(s["analysis"]).alias("a")), "id", "a").collect()
    games = [(r["number"], r["title"], r["year"]) for r in parsed if r["kind"] == "game"]
    assert games == [(1, "Dragon A", "2001"), (2, "Dragon B", "Unknown")]
    assert parsed[0]["kind"] == "intro"


def test_short_thinking_not_split_and_note_removed(spark):
    df = spark.createDataFrame([(1, "Hmm. Based on your query x. I applied filters: a. These are ranked by relevance.")],
                               "id long, t string")
    s = df.select(R.split_reasoning(F.col("t")).alias("s")).first()["s"]
    assert s["thinking"] is None and s["analysis"] == "Hmm. Based on your query x. "


def test_drop_repeated_sentences(spark):
    df = spark.createDataFrame([("A. A. B. A",)], "t string")
    assert df.select(R.drop_repeated_sentences(F.col("t"))).first()[0] == "A. B. A"


def test_prompt_has_blocks(spark):
    q = spark.createDataFrame([(1, "cats")], "query_id long, text string")
    res = spark.createDataFrame([(1, 1, "Cat", "1999-01-01", ["Sim"], "x" * 400)],
                                "query_id long, rank int, title string, release_date string, genres array<string>, description string")
    p = R.rag_prompt(q, res).first()["prompt"]
    assert 'the query: "cats"' in p and "1. **Cat** (1999)" in p and ("x" * 300 + "...") in p


def test_repeated_sentences_split_a_text_once(spark):
    df = spark.createDataFrame([("A. A. B. " * 3 + "B",), ("",), (None,), (". ",)], "t string").select(R.drop_repeated_sentences(F.col("t")).alias("t"))
    assert [r.t for r in df.collect()] == ["A. B. A. B. A. B", "", None, ""]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1       # not again for every part


def test_stream_upsert(spark, tmpdir_fresh):
    from trove.streaming.upsert import latest_version, stream_upsert
    src = os.path.join(tmpdir_fresh, "in")
    os.makedirs(src)
    with open(os.path.join(src, "1.jsonl"), "w") as f:
        f.write(json.dumps({"id": 1, "title": "One"}) + "\n" + json.dumps({"id": 2, "title": "Two"}) + "\n")
    target = os.path.join(tmpdir_fresh, "items")
    q = stream_upsert(spark, src, target, checkpoint=os.path.join(tmpdir_fresh, "ck"))
    q.awaitTermination(120)
    with open(os.path.join(src, "2.jsonl"), "w") as f:
        f.write("oops\n" + json.dumps({"id": 2, "title": "Two v2"}) + "\n" + json.dumps({"id": 2, "title": "Two v3"}) + "\n")
    q = stream_upsert(spark, src, target, checkpoint=os.path.join(tmpdir_fresh, "ck"))
    q.awaitTermination(120)
    got = {r["item_id"]: r["title"] for r in latest_version(spark, target).collect()}
    assert got == {1: "One", 2: "Two v3"}


def test_entry_and_registry(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() >= 0 and "item_id" in df.columns
    assert set(e.oracle_sql()) <= set(e.queries())
