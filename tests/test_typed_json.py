"""Typed JSON fields against Python's own json and int, and vectors that are refused."""

import json

import pytest

from trove.sources import jsonl as J

FORMS = ['1', '0', '-3', '6.0', '7.9', '-7.9', '0.0', '-0.0', '0.25', '1e3', '1.5E2', '12345678901234', '9223372036854775807', '9223372036854775808',
         '99999999999999999999', '1e30', '12345678901234567.25', 'true', 'false', 'null', '""', '" "', '"0"', '"7"', '" 7 "', '"+7"', '"-7"', '"7.0"', '"1_0"',
         '"1__0"', '"_1"', '"1_"', '"x"', '"true"', '[]', '[ ]', '[0]', '{}', '{"a": 1}', '"9223372036854775808"', '"\\t8\\n"', '"٣"']


def expected(rid, gid, citation="ok"):
    """(outcome, review_id, game_id) as a program with int() would have it."""
    rec = json.loads(f'{{"r": {rid}, "g": {gid}}}')
    if not rec["r"] or not rec["g"]:
        return "skipped", None, None
    try:
        r, g = int(rec["r"]), int(rec["g"])
        if not all(-2 ** 63 <= x < 2 ** 63 for x in (r, g)):
            raise OverflowError("no bigint")
    except (TypeError, ValueError, OverflowError):
        return "failed", None, None
    return "accepted", r, g


def test_review_ids_by_their_json_type(spark):
    cases = [(f, "5") for f in FORMS] + [("5", f) for f in FORMS]
    lines = spark.createDataFrame([(i, f' {{"review_id": {r}, "game_id":{g}, "citation": "ok"}} ') for i, (r, g) in enumerate(cases)], "line_no long, value string")
    for row in J.read_reviews_jsonl(lines).collect():
        r, g = cases[row.line_no]
        want = expected(r, g)
        if "٣" in r + g:
            want = ("failed", None, None)                     # digits of 0-9 only, as stated
        got = (row.outcome, row.review_id, row.item_id) if row.outcome == "accepted" else (row.outcome, None, None)
        assert got == want, (r, g, got, want)


def test_missing_and_broken_lines(spark):
    lines = spark.createDataFrame([(1, '{"game_id": 1, "citation": "x"}'), (2, '{"review_id": 1, "game_id": 2}'), (3, "{"), (4, ""), (5, "[]"), (6, "7"),
                                   (7, '{"review_id": 1, "game_id": 2, "citation": "x"} {}'), (8, '{"review_id": 1, "game_id": 2, "citation": "x"}')],
                                  "line_no long, value string")
    got = {r.line_no: (r.outcome, r.reason) for r in J.read_reviews_jsonl(lines).collect()}
    assert got == {1: ("skipped", "missing_field"), 2: ("skipped", "missing_field"), 3: ("skipped", "bad_json"), 5: ("skipped", "bad_json"),
                   6: ("skipped", "bad_json"), 7: ("skipped", "bad_json"), 8: ("accepted", None)}


def test_embedding_lines(spark):
    good = [('{"game_id": 7, "embedding": [1, 2.5]}', 7, [1.0, 2.5]), ('{"game_id": "8", "embedding": [0.5]}', 8, [0.5])]
    bad = [("{broken", "bad_json"), ('{"embedding": [1]}', "bad_id"), ('{"game_id": "x", "embedding": [1]}', "bad_id"), ('{"game_id": 1}', "bad_vector"),
           ('{"game_id": 1, "embedding": null}', "bad_vector"), ('{"game_id": 1, "embedding": []}', "bad_vector"), ('{"game_id": 1, "embedding": [1, null]}', "bad_vector"),
           ('{"game_id": 1, "embedding": [1, "x"]}', "bad_vector"), ('{"game_id": 1, "embedding": 3}', "bad_vector"), ("[1]", "bad_json")]
    lines = spark.createDataFrame([(x[0],) for x in good + bad] + [("  ",)], "value string")
    out = J.embeddings_ndjson_outcomes({"description": lines}).collect()
    assert {(r.value, r.reason) for r in out if r.reason} == set(bad)
    assert sorted((r.item_id, r.vec_id, r.embedding) for r in J.read_embeddings_ndjson({"description": lines}).collect()) == [(i, str(i), v) for _, i, v in good]
    review = spark.createDataFrame([('{"game_id": 1, "review_id": 2, "embedding": [1]}',), ('{"game_id": 1, "embedding": [1]}',)], "value string")
    assert [(r.vec_id, r.review_id, r.reason) for r in J.embeddings_ndjson_outcomes({"review": review}).orderBy("vec_id").collect()] == \
        [(None, None, "bad_id"), ("2", 2, None)]


@pytest.mark.parametrize("vector", [None, [1.0], []])
def test_vectors_of_another_length_or_none_raise(spark, tmpdir_fresh, vector):
    from trove.operators.tables import write_vectors
    df = spark.createDataFrame([("1", 1, "cover", [1.0, 2.0]), ("2", 2, "cover", vector), ("3", 3, "other", None)],
                               "vec_id string, item_id long, modality string, embedding array<double>")
    with pytest.raises(Exception, match="wrong length"):
        write_vectors(df, f"{tmpdir_fresh}/v", {"cover": 2})
    assert write_vectors(df.where("vec_id <> '2'"), f"{tmpdir_fresh}/w", {"cover": 2}).count() == 2


def test_passages_are_read_whole_unless_a_limit_is_given(spark):
    from pyspark.sql import functions as F

    from trove.operators.models import rerank_score_batch
    df = spark.createDataFrame([("late word", "filler " * 600 + "late word")], "q_text string, description string")
    assert [r.rerank_score for r in rerank_score_batch(df).collect()] == [1.0]
    assert rerank_score_batch(df, max_tokens=512).select(F.max("rerank_score")).first()[0] == 0.0
