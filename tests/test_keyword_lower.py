"""Keyword candidates are checked against texts that are lower-cased once an item."""


def test_candidates_meet_texts_that_are_lower_case_already(spark):
    from trove.operators.keyword import keyword_matches
    items = spark.createDataFrame([(1, "Big RED Fox", None), (2, None, "a red FOX ran"), (3, "Ein STRASSE", "x")], "item_id long, title string, description string")
    queries = spark.createDataFrame([(7, "rEd fOx"), (8, "strasse"), (9, "none")], "query_id long, text string")
    df = keyword_matches(items, queries, ["item_id"])
    assert {tuple(r) for r in df.collect()} == {(7, 1), (7, 2), (8, 3)}
    lines = [x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Contains" in x]
    assert lines and not any("lower(" in x for x in lines)
