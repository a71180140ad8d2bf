"""Scratch tables go when their scope ends, and nothing that is read later is lost."""

import os

import pytest
from pyspark.sql import functions as F

from trove import session as S


def folders(spark):
    top = S.checkpoint_dir(spark).removeprefix("file:")
    return {n for n in os.listdir(top) if len(n.rsplit("-", 1)[-1]) == 32}


def test_scope_drops_what_was_made_inside(spark):
    before = folders(spark)
    with S.scratch_scope(spark):
        S.write_scratch(spark.range(5), "a")
        with S.scratch_scope(spark):
            S.write_scratch(spark.range(5), "b")
            S.scratch_path(spark, "folder")
            assert len(folders(spark) - before) == 3
        assert {n.split("-")[0] for n in folders(spark) - before} == {"a"}
    assert folders(spark) == before
    with pytest.raises(ValueError):
        with S.scratch_scope(spark):
            S.write_scratch(spark.range(5), "c")
            raise ValueError
    assert folders(spark) == before and not S._SCOPES


def test_stored_result_keeps_the_result_alone(spark):
    before = folders(spark)

    def two(spark, n):
        return S.write_scratch(spark.range(n), "a").join(S.write_scratch(spark.range(n).select((F.col("id") * 2).alias("id")), "b"), "id")
    with S.scratch_scope(spark):
        df = S.stored_result(two, spark, 10)
        assert {n.split("-")[0] for n in folders(spark) - before} == {"result"} and sorted(r.id for r in df.collect()) == [0, 2, 4, 6, 8]
        lazy = S.stored_result(lambda s, n: s.range(n), spark, 3)
        assert lazy.count() == 3 and not hasattr(type(lazy), "scratch")
    assert folders(spark) == before
    df = S.write_scratch(spark.range(3), "own")
    S.drop_scratch(df)
    assert folders(spark) == before


SMALL = ["keyword_search", "fetch_by_ids", "semantic_search_display", "knn_approx", "upsert_items", "fuzzy_title_match", "table_upsert", "copy_table",
         "stream_upsert", "filter_batch_counts", "write_vectors", "page_slice", "facet_platforms"]


@pytest.mark.parametrize("name", SMALL)
def test_queries_leave_only_their_result(spark, name):
    import __spark_entry__ as e
    before = folders(spark)
    first = e.queries()[name](spark, e.SMOKE_DIR)
    rows = first.count()
    left = folders(spark) - before
    assert {n.split("-")[0] for n in left} <= {"result"} and len(left) <= 1
    # another run takes nothing away from the first one's result
    e.queries()[name](spark, e.SMOKE_DIR).count()
    assert first.count() == rows
