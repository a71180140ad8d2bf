from pyspark.sql import functions as F

from trove.functions import filters as FL
from trove.operators.keyword import keyword_matches


def test_min_score_semantics(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, 7.0)], "id long, score double")
    def ids(pred):
        return sorted(r["id"] for r in df.where(pred).collect())
    assert ids(FL.filter_min_score(F.col("score"), 6.0, False)) == [1, 3]
    assert ids(FL.filter_min_score(F.col("score"), 6.0, True)) == [3]
    assert ids(FL.filter_min_score(F.col("score"), None, True)) == [2, 3]
    assert ids(FL.filter_min_score(F.col("score"), None, False)) == [1, 2, 3]
    assert ids(FL.filter_min_score(F.col("score"), 0.0, False)) == [1, 2, 3]


def items(spark):
    return spark.createDataFrame(
        [(1, "Dragon Quest", "a 50% off deal"), (2, "Cat Cafe", "cute_cat game"), (3, "Other", None)],
        "item_id long, title string, description string")


def test_keyword_literal(spark):
    q = spark.createDataFrame([(10, "dragon"), (11, "50%"), (12, "cute_cat"), (13, "  "), (14, "o_f")],
                              "query_id long, text string")
    got = sorted((r["query_id"], r["item_id"]) for r in keyword_matches(items(spark), q, ["item_id"]).collect())
    assert got == [(10, 1), (11, 1), (12, 2)]


def test_keyword_wildcards(spark):
    q = spark.createDataFrame([(14, "o_f"), (15, "d%q")], "query_id long, text string")
    got = sorted((r["query_id"], r["item_id"]) for r in
                 keyword_matches(items(spark), q, ["item_id"], wildcards=True).collect())
    assert got == [(14, 1), (15, 1)]


def test_keyword_sets_match_brute_force(spark):
    """Several query sets in one session, few and many queries, string ids."""
    import random
    rng = random.Random(1)
    words = ["sun", "Sunny", "day", "rain-y", "x", "the", "50%", "a_b", "été", "storm."]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 5))), rng.choice([None, "  ".join(rng.choices(words, k=12)), "\n".join(rng.choices(words, k=6))]))
            for i in range(60)]
    df = spark.createDataFrame(rows, "item_id long, title string, description string")
    for n in (3, 31, 32, 80):
        texts = [rng.choice([" ", ""]) + " ".join(rng.choices(words, k=rng.randint(1, 4))) + rng.choice([" ", ""]) for _ in range(n - 3)] + ["u", "ny d", "\n"]
        queries = [(f"q{i}", t) for i, t in enumerate(texts)] + [("none", None), ("blank", "  ")]
        q = spark.createDataFrame(queries, "query_id string, text string")
        want = {(k, i) for k, t in queries if (t or "").strip() for i, title, text in rows
                if t.lower() in title.lower() or t.lower() in (text or "").lower()}
        got = [(r["query_id"], r["item_id"]) for r in keyword_matches(df, q, ["item_id"]).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_keyword_plan_has_no_nested_loop(spark):
    q = spark.createDataFrame([(i, f"word {i} end") for i in range(40)], "query_id long, text string")
    plan = keyword_matches(items(spark), q, ["item_id"])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
