"""Encoders run once a row."""

from pyspark.sql import functions as F


def test_a_search_encodes_each_query_and_item_once(spark):
    from trove.operators import models as M
    from trove.plans import search as S
    seen = spark.sparkContext.accumulator(0)

    def encoder(texts):
        seen.add(len(texts))
        return [[float(len(t)), 1.0] for t in texts]
    items = spark.createDataFrame([(i, "t" * i, "d" * i) for i in range(12)], "item_id long, title string, description string")
    for c, t in (("release_date", "date"), ("score", "double"), ("platforms", "array<string>"), ("genres", "array<string>"), ("developers", "array<string>"),
                 ("publishers", "array<string>"), ("source_url", "string"), ("cover_url", "string"), ("screenshot_urls", "array<string>")):
        items = items.withColumn(c, F.lit(None).cast(t))
    texts = items.select(F.col("item_id").cast("string").alias("vec_id"), "item_id", F.lit("description").alias("modality"), "description")
    vectors = M.stored_vectors(M.with_text_embedding(texts, "description", encoder))
    queries = spark.createDataFrame([(1, "ddd"), (2, "ddddd")], "query_id long, text string")
    got = S.semantic_search(items, spark.createDataFrame([], "review_id long, item_id long, citation string"), vectors, queries, k=1, encoder=encoder)
    assert {(r.query_id, r.item_id) for r in got.select("query_id", "item_id").collect()} == {(1, 3), (2, 5)}
    assert seen.value == 14
