"""Registered queries: one callable per operator, each (spark, sf_dir) -> DataFrame.

Every query reads the driver tables of ``sf_dir`` whole. Array and struct
outputs are rendered as strings so results compare by value across engines.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources import fixtures as fx
from .plans import search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def list_str(c: Column, sep: str = ", ") -> Column:
    return F.array_join(c, sep)


def reviews_str(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda s: F.concat(s["source"], F.lit(": "), s["review"])), " | ")


def result_report(df: DataFrame, extra: list = ()) -> DataFrame:
    cols = ["query_id", "rank", "item_id", "title", "description", "release_date", "score",
            list_str(F.col("platforms")).alias("platforms"), list_str(F.col("genres")).alias("genres")]
    return df.select(*cols, *extra)


@register("keyword_search")
def q_keyword_search(spark: SparkSession, d: str) -> DataFrame:
    items, reviews = fx.items(spark, d), fx.reviews(spark, d)
    res = search.keyword_search(items, reviews, fx.keyword_queries(spark, d), texts=fx.item_texts(spark, d))
    return result_report(res, ["review_count", reviews_str(F.col("reviews")).alias("reviews")])


# ------------------------------------------------------------------ vectors

from .operators import knn as K  # noqa: E402
from .operators import models as M  # noqa: E402

FETCH = 20          # = 2 x 10: the over-fetch of a default search


def _vq(spark, d):
    return fx.vector_queries(spark, d)


def _knn_report(spark, d, modality: str, n: int = FETCH, absolute: bool = False) -> DataFrame:
    iv = fx.item_vectors(spark, d)
    hits = K.knn(_vq(spark, d), K.modality_corpus(iv, modality), n, carry=["item_id", "review_id"])
    sim = K.similarity_absolute(F.col("dist")) if absolute else K.similarity_relative(F.col("dist"))
    rid = ["review_id"] if modality == "review" else []
    return hits.select("query_id", "rank", "vec_id", "item_id", *rid,
                       F.round("dist", 6).alias("dist"), F.round(sim, 6).alias("similarity"))


@register("knn_descriptions")
def q_knn_descriptions(spark, d):
    return _knn_report(spark, d, "description")


@register("knn_reviews")
def q_knn_reviews(spark, d):
    return _knn_report(spark, d, "review", absolute=True)


@register("knn_covers")
def q_knn_covers(spark, d):
    return _knn_report(spark, d, "cover")


@register("knn_screenshots")
def q_knn_screenshots(spark, d):
    return _knn_report(spark, d, "screenshot")


@register("knn_by_vector")
def q_knn_by_vector(spark, d):
    # each query names its own search type: covers for even ids, else screenshots
    q = _vq(spark, d).withColumn("modality", K.search_type_column(
        F.when(F.col("query_id") % 2 == 0, F.lit("covers")).otherwise(F.lit("screenshots"))))
    hits = K.knn(q, fx.item_vectors(spark, d), FETCH, carry=["item_id"], by="modality")
    return hits.select("query_id", "rank", "vec_id", "item_id", F.round("dist", 6).alias("dist"),
                       F.round(K.similarity_relative(F.col("dist")), 6).alias("similarity"))


@register("similarity_relative")
def q_similarity_relative(spark, d):
    return _knn_report(spark, d, "description").select("query_id", "rank", "similarity")


@register("similarity_absolute")
def q_similarity_absolute(spark, d):
    return _knn_report(spark, d, "review", absolute=True).select("query_id", "rank", "similarity")


@register("hit_list_max")
def q_hit_list_max(spark, d):
    iv = fx.item_vectors(spark, d)
    hits = K.knn(_vq(spark, d), K.modality_corpus(iv, "description"), FETCH)
    return hits.groupBy("query_id").agg(F.round(F.max("dist"), 6).alias("max_dist"))


@register("dedupe_hits")
def q_dedupe_hits(spark, d):
    iv = fx.item_vectors(spark, d)
    hits = K.knn(_vq(spark, d), K.modality_corpus(iv, "review"), FETCH, carry=["item_id"])
    best = K.dedupe_hits(hits)
    return best.select("query_id", "item_id", "vec_id", F.round("dist", 6).alias("dist"))


@register("union_modalities")
def q_union_modalities(spark, d):
    iv = fx.item_vectors(spark, d)
    return iv.groupBy("modality").agg(F.count(F.lit(1)).cast("bigint").alias("vectors"),
                                      F.countDistinct("item_id").cast("bigint").alias("items"))


@register("modality_coverage")
def q_modality_coverage(spark, d):
    iv = fx.item_vectors(spark, d)
    return iv.groupBy("item_id", "modality").agg(F.count(F.lit(1)).cast("bigint").alias("vectors"))


@register("knn_approx")
def q_knn_approx(spark, d):
    from .operators.pq import knn_pq
    iv = fx.item_vectors(spark, d)
    return knn_pq(_vq(spark, d), K.modality_corpus(iv, "description"), FETCH) \
        .select("query_id", "rank", "vec_id", F.round("dist", 6).alias("dist"))


# ------------------------------------------------------------------ models

@register("encode_text_batch")
def q_encode_text_batch(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", "text")
    enc = M.encode_text_batch(docs, "doc_id", "text")
    ex = enc.select("doc_id", F.posexplode("embedding").alias("bucket", "weight")).where(F.col("weight") != 0)
    return ex.select("doc_id", F.col("bucket").cast("int").alias("bucket"), F.round("weight", 6).alias("weight"))


@register("encode_image_batch")
def q_encode_image_batch(spark, d):
    pages = fx.table(spark, d, "pages").select("page_id", F.col("html").cast("binary").alias("bytes"))
    enc = M.encode_image_batch(pages, "page_id", "bytes")
    bins = enc.select("page_id", F.posexplode("embedding").alias("bin", "share")).where("share > 0")
    return bins.select("page_id", F.col("bin").cast("int").alias("bin"),
                       F.round(F.col("share").cast("double"), 6).alias("share"))


def _semantic(spark, d, **kw):
    from .plans import search as S
    return S.semantic_search(fx.items(spark, d), fx.reviews(spark, d), fx.item_vectors(spark, d),
                             _vq(spark, d), **kw)


@register("rerank_score_batch")
def q_rerank_score_batch(spark, d):
    q = _vq(spark, d).select("query_id", F.col("text").alias("q_text"))
    items = fx.items(spark, d).select("item_id", "description")
    iv = fx.item_vectors(spark, d)
    hits = K.knn(_vq(spark, d), K.modality_corpus(iv, "description"), FETCH, carry=["item_id"])
    pairs = hits.join(items, "item_id").join(q, "query_id")
    out = M.rerank_score_batch(pairs, "q_text", "description")
    return out.select("query_id", "item_id", F.round("rerank_score", 6).alias("rerank_score"))


@register("semantic_search")
def q_semantic_search(spark, d):
    res = _semantic(spark, d)
    return result_report(res, [F.round("relevance_score", 6).alias("relevance_score")])


@register("rerank_fuse")
def q_rerank_fuse(spark, d):
    return _semantic(spark, d).select("query_id", "rank", "item_id",
                                      F.round("relevance_score", 6).alias("relevance_score"))


@register("top_k_per_query")
def q_top_k_per_query(spark, d):
    return _semantic(spark, d, k=5).select("query_id", "rank", "item_id")


@register("overfetch_then_cut")
def q_overfetch_then_cut(spark, d):
    from .functions.filters import Filters
    res = _semantic(spark, d, filters=Filters(min_score=5.0, scored_only=True))
    return res.select("query_id", "rank", "item_id", "score")


@register("rerank_fallback")
def q_rerank_fallback(spark, d):
    def failing_scorer(queries, passages):
        raise RuntimeError("scorer unavailable")
    res = _semantic(spark, d, scorer=failing_scorer)
    return res.select("query_id", "rank", "item_id", F.round("relevance_score", 6).alias("relevance_score"))


@register("semantic_search_text")
def q_semantic_search_text(spark, d):
    # End to end from texts: descriptions and query texts are encoded, no ready
    # vectors. Components are kept in steps of 2**-20: sums of their products
    # are exact, so equal distances tie whatever the order of summation.
    from .plans import search as S
    steps = F.transform("embedding", lambda x: F.floor(x * (1 << 20) + 0.5) / (1 << 20)).alias("embedding")
    items = fx.items(spark, d)
    texts = items.select(F.col("item_id").cast("string").alias("vec_id"), "item_id", F.lit("description").alias("modality"), "description")
    vectors = M.stored_vectors(M.with_text_embedding(texts, "description").select("vec_id", "item_id", "modality", steps))
    queries = S.with_embedding(_vq(spark, d).select("query_id", "text")).select("query_id", "text", steps)
    res = S.semantic_search(items, fx.reviews(spark, d), vectors, queries)
    return res.select("query_id", "rank", "item_id", F.round("relevance_score", 6).alias("relevance_score"))


@register("image_search_by_bytes")
def q_image_search_by_bytes(spark, d):
    # End to end from bytes: every page is the cover of its item, every
    # benchmark passage's bytes the query image.
    from .plans import search as S
    pages = fx.table(spark, d, "pages").select(
        F.col("page_id").cast("string").alias("vec_id"), F.col("page_id").alias("item_id"),
        F.lit("cover").alias("modality"), F.col("html").cast("binary").alias("bytes"))
    queries = fx.table(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").cast("binary").alias("bytes"))
    vectors = M.stored_vectors(M.with_image_embedding(pages).select("vec_id", "item_id", "modality", "embedding"))
    res = S.image_search_by_vector(fx.items(spark, d), vectors, queries, "covers")
    return res.select("query_id", "rank", "item_id", F.round("relevance_score", 6).alias("relevance_score"))


@register("semantic_search_display")
def q_semantic_search_display(spark, d):
    from .plans import search as S
    res = S.semantic_search_display(fx.items(spark, d), fx.reviews(spark, d), fx.item_vectors(spark, d), _vq(spark, d))
    return result_report(res, [F.round("relevance_score", 6).alias("relevance_score"), "review_count",
                               reviews_str(F.col("reviews")).alias("reviews")])


@register("image_search_by_text")
def q_image_search_by_text(spark, d):
    from .plans import search as S
    res = S.image_search_by_text(fx.items(spark, d), fx.item_vectors(spark, d), _vq(spark, d), "covers")
    return res.select("query_id", "rank", "item_id", "title", "score",
                      F.round("relevance_score", 6).alias("relevance_score"))


@register("image_search_by_vector")
def q_image_search_by_vector(spark, d):
    from .plans import search as S
    from .functions.filters import Filters
    res = S.image_search_by_vector(fx.items(spark, d), fx.item_vectors(spark, d), _vq(spark, d), "screenshots",
                                   filters=Filters(scored_only=True))
    return res.select("query_id", "rank", "item_id", "title", "score",
                      F.round("relevance_score", 6).alias("relevance_score"))


@register("hits_join_catalogue")
def q_hits_join_catalogue(spark, d):
    iv = fx.item_vectors(spark, d)
    hits = K.knn(_vq(spark, d), K.modality_corpus(iv, "cover"), FETCH, carry=["item_id"])
    return hits.join(fx.items(spark, d), "item_id").select("query_id", "rank", "item_id", "title")


@register("attach_hit_score")
def q_attach_hit_score(spark, d):
    # Score lookup by id with 0.0 for ids that have no hit: every item of the
    # catalogue that is in some query's keyword result gets its vector score.
    iv = fx.item_vectors(spark, d)
    hits = K.knn(_vq(spark, d), K.modality_corpus(iv, "review"), FETCH, carry=["item_id"])
    hits = K.dedupe_hits(hits.withColumn("vec_score", K.similarity_absolute(F.col("dist"))))
    per_item = hits.groupBy("item_id").agg(F.max("vec_score").alias("vec_score"))
    items = fx.items(spark, d).select("item_id")
    return items.join(per_item, "item_id", "left").select(
        "item_id", F.round(F.coalesce(F.col("vec_score"), F.lit(0.0)), 6).alias("vec_score"))


@register("rerank_join_back")
def q_rerank_join_back(spark, d):
    # Reranked rows are joined back by (query, item), so items that share a
    # description stay distinct: one row each.
    res = _semantic(spark, d)
    return res.groupBy("query_id").agg(F.count(F.lit(1)).cast("bigint").alias("results"),
                                       F.countDistinct("item_id").cast("bigint").alias("distinct_items"))


@register("search_summary")
def q_search_summary(spark, d):
    from .plans import search as S
    res = _semantic(spark, d)
    out = S.search_summary(_vq(spark, d).drop("embedding"), res)
    echo = F.concat_ws("; ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("None")))
                               for c in ("platform", "genre", "min_score", "min_year", "scored_only")])
    return out.select("query_id", "query", "total", echo.alias("filters"))


# Further query groups register themselves on import.
from . import catalogue_queries  # noqa: E402,F401
from . import rag_queries  # noqa: E402,F401
from . import ingest_queries  # noqa: E402,F401
from . import change_queries  # noqa: E402,F401
