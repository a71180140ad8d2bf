"""End-to-end searches as batch jobs: many queries x the whole catalogue per job."""

from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.filters import FILTER_COLUMNS, Filters, batch_predicate, filter_genre, filter_platform
from ..functions.shape import review_objects
from ..operators.catalogue import (attach_reviews, order_by_score, project_result, rank_results, top_by_score,
                                    top_k_per_query)
from ..operators.keyword import keyword_matches
from ..operators.postings import PostingIndex
from ..session import write_scratch

DEFAULT_LIMIT = 20          # fixed value: default result size of keyword search and the API
FILTER_TYPES = {"platform": "string", "genre": "string", "min_score": "double",
                "min_year": "int", "scored_only": "boolean"}


def with_filter_columns(queries: DataFrame, default: Optional[Filters] = None) -> DataFrame:
    """Make sure a queries table has every filter column; missing ones come
    from ``default`` (or NULL = no filter)."""
    default = default or Filters()
    vals = {"platform": default.platform, "genre": default.genre, "min_score": default.min_score,
            "min_year": default.min_year, "scored_only": bool(default.scored_only)}
    out = queries
    for name in FILTER_COLUMNS:
        if name not in queries.columns:
            out = out.withColumn(name, F.lit(vals[name]).cast(FILTER_TYPES[name]))
    return out


def _prefixed_filters(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", *[F.col(c).alias(f"q_{c}") for c in FILTER_COLUMNS])


def search_by_value(items: DataFrame, column: str, value: str, n: int = DEFAULT_LIMIT) -> DataFrame:
    """Items whose array ``column`` holds ``value`` (exact), top n by score."""
    pred = filter_genre(F.col(column), value) if column == "genres" else filter_platform(F.col(column), value)
    return top_by_score(items.where(pred), n)


def search_by_values(items: DataFrame, values: Optional[DataFrame], column: str, n: int = DEFAULT_LIMIT) -> DataFrame:
    """Batch form: for every row (query_id, value), the top n items whose
    ``column`` holds the value. Items are exploded once and equi-joined on
    the value (no per-query scan). Without ``values`` every value that occurs
    is searched, and is its own query."""
    ex = items.select("item_id", "score", F.explode(F.array_distinct(column)).alias("value"))
    if values is None:
        return top_k_per_query(ex.where(F.col("value").isNotNull()), n, order_by_score(), key="value")
    hits = ex.join(values.select("query_id", "value"), "value")
    return top_k_per_query(hits, n, order_by_score())


def keyword_search(items: DataFrame, reviews: DataFrame, queries: DataFrame,
                   limit: int = DEFAULT_LIMIT, filters: Optional[Filters] = None,
                   wildcards: bool = False, with_reviews: bool = True, texts: Optional[DataFrame] = None,
                   index: Optional[PostingIndex] = None) -> DataFrame:
    """Keyword search for every row of ``queries`` (query_id, text[, filters]).

    Plan: match -> shared ``filters`` on the catalogue (pushed to its scans)
    and per-query filters (row predicate after an equi-join on query_id) ->
    top ``limit`` per query by score desc NULLS LAST, item id -> reviews
    fetched for the surviving hits only. ``texts`` (item_id, title,
    description of all items) serves the match where it can be read without
    the rest of the catalogue; ``index`` is a kept index of the texts.
    """
    q = with_filter_columns(queries)
    if filters is not None:
        items = items.where(filters.predicate())
    if texts is None:
        m = keyword_matches(items, q, list(items.columns), wildcards=wildcards, index=index)
    else:
        m = keyword_matches(texts, q, ["item_id"], wildcards=wildcards, index=index).join(items, "item_id")
    m = m.join(_prefixed_filters(q), "query_id").where(batch_predicate("q_", ""))
    full = top_k_per_query(m, limit, order_by_score())
    if with_reviews:
        full = attach_reviews(full, reviews)
        full = full.withColumn("reviews", review_objects(F.col("reviews_array")))
        extra = ["review_count", "reviews"]
    else:
        extra = []
    return project_result(full, extra=["query_id", "rank", *extra])


def fetch_by_ids(items: DataFrame, reviews: DataFrame, ids: DataFrame,
                 filters: Optional[Filters] = None, with_reviews: bool = True) -> DataFrame:
    """Items for an id set (query_id, item_id) that pass the filters, ranked
    per query by score desc NULLS LAST, item id. The id set is joined, not
    broadcast blindly: AQE broadcasts it when its measured size is small."""
    q = with_filter_columns(ids.select("query_id").distinct(), filters)
    hits = ids.select("query_id", "item_id").distinct().join(items, "item_id")
    hits = hits.join(_prefixed_filters(q), "query_id").where(batch_predicate("q_", ""))
    # ids are distinct within a query, so ranks are settled on (query, item, score) alone
    ranked = rank_results(hits, order_by_score(), row="item_id", needs=["score"])
    if with_reviews:
        ranked = attach_reviews(ranked, reviews, ids)
        ranked = ranked.withColumn("reviews", review_objects(F.col("reviews_array")))
        extra = ["review_count", "reviews"]
    else:
        extra = []
    return project_result(ranked, extra=["query_id", "rank", *extra])


# ------------------------------------------------------------ vector searches

FETCH_FACTOR = 2            # fixed value: vector hits fetched per wanted result
MAX_FILTERS = 64            # different filters that are applied to the corpus before the search
GROWTH = 4                  # how many times more a round fetches than the one before
SEMANTIC_K = 10             # fixed value: default result size (API asks for 20)
DISPLAY_K = 5               # fixed value: result size of the display / RAG form


def with_embedding(queries: DataFrame, text_encoder=None, image_encoder=None) -> DataFrame:
    """Queries with an ``embedding`` column: given ready, or encoded here from
    the query's image bytes (``bytes``), else from its whole ``text``. Encoded
    ones are stored: a search counts its queries before it reads them."""
    from ..operators.models import with_image_embedding, with_text_embedding
    if "embedding" in queries.columns:
        return queries
    if "bytes" in queries.columns:
        return write_scratch(with_image_embedding(queries, "bytes", image_encoder), "encoded-queries")
    return write_scratch(with_text_embedding(queries, "text", text_encoder), "encoded-queries")


def _vector_hits(queries: DataFrame, item_vectors: DataFrame, modality: Optional[str], fetch: int,
                 items: DataFrame, filters: Optional[Filters], filter_mode: str, asked: Optional[DataFrame] = None) -> DataFrame:
    """Top ``fetch`` vectors per query with relative similarity, best hit per
    item (query_id, item_id, dist, vec_score). Without ``modality`` each query
    names its own in a column. With ``filter_mode='pre'`` only vectors of items
    that pass count: the shared ``filters``, or each query's own in ``asked``
    (query_id and the filter columns)."""
    from ..operators.knn import dedupe_hits, knn, modality_corpus, similarity_relative
    corpus = modality_corpus(item_vectors, modality) if modality else item_vectors
    by = None if modality else "modality"
    if filter_mode == "pre" and filters is None:
        hits = filtered_hits(queries, corpus, items, asked, fetch, by)
    elif filter_mode in ("pre", "post"):
        if filter_mode == "pre":
            corpus = corpus.join(items.where(filters.predicate()).select("item_id"), "item_id", "left_semi")
        hits = knn(queries, corpus, fetch, carry=["item_id"], by=by)
    else:
        raise ValueError("filter_mode must be 'post' or 'pre'")
    hits = hits.withColumn("vec_score", similarity_relative(F.col("dist")))
    return dedupe_hits(hits).select("query_id", "item_id", "dist", "vec_score")


def filtered_hits(queries: DataFrame, corpus: DataFrame, items: DataFrame, asked: DataFrame, fetch: int,
                  by: Optional[str] = None) -> DataFrame:
    """The ``fetch`` nearest vectors of every query among the items that pass
    the query's own filters (query_id, rank, vec_id, dist, item_id).

    Rounds: a round fetches further vectors only for queries that are still
    short, from their last distance onward, GROWTH times as many as the round
    before. A query is done when it has enough or has seen every vector, so
    there are at most log(corpus / fetch) rounds, and most queries leave after
    the first. From the second round on, as soon as the open queries have no
    more than MAX_FILTERS different filters, each filter is applied to the
    corpus once and its queries search what passes: that round is the last,
    and its hits are as many as it fetches, however few items a filter leaves.
    The rounds before it store ids, distances and filter columns only."""
    from ..operators.knn import AFTER, TILE_ROWS, knn
    facts = items.select("item_id", "platforms", "genres", "score", "release_date")
    own = F.to_json(F.struct(*FILTER_COLUMNS), {"ignoreNullFields": "false"}).alias("_filter")
    qcols = asked.select("query_id", own, *[F.col(c).alias(f"q_{c}") for c in FILTER_COLUMNS]) \
        .withColumn("_asked", F.to_json(F.struct("query_id", "_filter")))
    vectors = queries.select("query_id", "embedding", *([by] if by else []))
    # A filter without any value lets every item pass; queries without filters are done in one round as well.
    still, found, size, last = vectors, None, fetch, None
    while True:
        tile_rows = max(16, TILE_ROWS * fetch // size)
        if last is not None:
            open_filters = write_scratch(qcols.join(last.select("query_id"), "query_id", "left_semi")
                                         .drop("query_id", "_asked").distinct(), "filtered-filters")
            if open_filters.limit(MAX_FILTERS + 1).count() <= MAX_FILTERS:
                kind = F.concat_ws("|", "_filter", *([by] if by else [])).alias("_kind")
                passing = write_scratch(corpus.join(facts, "item_id").join(F.broadcast(open_filters), batch_predicate("q_", ""))
                                        .select(*corpus.columns, kind), "filtered-passing")
                searches = still.join(qcols.select("query_id", "_filter", "_asked").distinct(), "query_id").select("_asked", *still.columns, kind)
                hits = knn(searches, passing, size, qid="_asked", carry=["item_id"], by="_kind", tile_rows=tile_rows)
                more = hits.withColumnRenamed("query_id", "_asked").join(qcols.select("query_id", "_asked"), "_asked")
                return top_k_per_query(found.unionByName(more.select(*found.columns)), fetch, [F.col("dist"), F.col("vec_id")])
        hits = write_scratch(knn(still, corpus, size, carry=["item_id"], by=by, tile_rows=tile_rows), "filtered-round")
        passed = (hits.join(facts, "item_id").join(qcols, "query_id").where(batch_predicate("q_", ""))
                  .select("query_id", "vec_id", "dist", "item_id"))
        found = write_scratch(passed if found is None else found.unionByName(passed), "filtered-found")
        last = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("seen"), F.max_by(F.struct("dist", "vec_id"), "rank").alias("last"))
        enough = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= fetch).select("query_id")
        last = write_scratch(last.where(F.col("seen") == size).join(enough, "query_id", "left_anti")
                             .select("query_id", F.col("last.dist").alias(AFTER[0]), F.col("last.vec_id").alias(AFTER[1])), "filtered-open")
        if last.isEmpty():
            return top_k_per_query(found, fetch, [F.col("dist"), F.col("vec_id")])
        still, size = vectors.join(last, "query_id"), size * GROWTH


def _hits_with_items(hits: DataFrame, items: DataFrame, q: DataFrame, with_text: bool = False) -> DataFrame:
    """Hits joined to the catalogue (inner: hits without an item drop out)
    and filtered per query. Hits are queries x fetch rows, so AQE turns the
    join into a broadcast of the hits side when it measures them small. The
    query's filters (and text, for reranking) come in one join."""
    extra = [F.col("text").alias("q_text")] if with_text else []
    qcols = q.select("query_id", *[F.col(c).alias(f"q_{c}") for c in FILTER_COLUMNS], *extra)
    j = hits.join(items, "item_id").join(qcols, "query_id")
    return j.where(batch_predicate("q_", ""))


def semantic_search(items: DataFrame, reviews: DataFrame, item_vectors: DataFrame, queries: DataFrame,
                    k: int = SEMANTIC_K, filters: Optional[Filters] = None, filter_mode: str = "post",
                    scorer=None, with_reviews: bool = False, fetch_factor: int = FETCH_FACTOR,
                    encoder=None) -> DataFrame:
    """Vector search over description vectors, filters, rerank fusion, top k.

    ``queries``: query_id, text[, embedding][, filter columns]; texts without
    a ready embedding are encoded by ``encoder``. The candidate
    list is the ``fetch_factor`` x k nearest vectors; with ``filter_mode='post'``
    the filters run after the fetch, so fewer than k results may come back. With
    'pre' the list holds only items that pass the query's own (or the shared)
    filters.
    Relevance = 0.7 x relative vector similarity + 0.3 x rerank score, also
    for a single candidate; ties keep catalogue order (score desc, id).
    """
    from ..operators.models import rerank_fuse, rerank_score_batch
    q = with_embedding(with_filter_columns(queries, filters), encoder)
    hits = _vector_hits(q.select("query_id", "embedding"), item_vectors, "description",
                        fetch_factor * k, items, filters, filter_mode, q)
    cand = _hits_with_items(hits, items, q.select("query_id", "text", *FILTER_COLUMNS), with_text=True)
    cand = rerank_score_batch(cand, "q_text", "description", scorer=scorer)
    cand = cand.withColumn("relevance_score", rerank_fuse(F.col("vec_score"), F.col("rerank_score")))
    order = [F.col("relevance_score").desc(), *order_by_score()]
    top = top_k_per_query(cand, k, order)
    extra = ["query_id", "rank", "relevance_score"]
    if with_reviews:
        top = attach_reviews(top, reviews)
        top = top.withColumn("reviews", review_objects(F.col("reviews_array")))
        extra += ["review_count", "reviews"]
    return project_result(top, extra=extra)


def semantic_search_display(items, reviews, item_vectors, queries, k: int = DISPLAY_K, **kw) -> DataFrame:
    """The display / RAG form: k = 5 and reviews included."""
    return semantic_search(items, reviews, item_vectors, queries, k=k, with_reviews=True, **kw)


def image_search(items: DataFrame, item_vectors: DataFrame, queries: DataFrame, search_type: Optional[str] = "covers",
                 k: int = SEMANTIC_K, filters: Optional[Filters] = None, fetch_factor: int = FETCH_FACTOR,
                 scored_only_allowed: bool = True, encoder=None) -> DataFrame:
    """Image search for queries (ready vectors, image bytes or texts) against
    cover or screenshot vectors: relevance = relative similarity, top k.

    With ``search_type=None`` each query names its own in the column
    ``search_type``. Query vectors must have the corpus dimension; a mismatch
    raises.
    """
    from ..operators.knn import search_type_column, search_type_modality
    modality = search_type_modality(search_type) if search_type else None
    q = with_embedding(with_filter_columns(queries, filters), encoder, encoder)
    if not scored_only_allowed:
        q = q.withColumn("scored_only", F.lit(False))
    vectors = q.select("query_id", "embedding") if modality else q.select(
        "query_id", "embedding", search_type_column(F.col("search_type")).alias("modality"))
    hits = _vector_hits(vectors, item_vectors, modality, fetch_factor * k, items, filters, "post")
    cand = _hits_with_items(hits, items, q).withColumn("relevance_score", F.col("vec_score"))
    order = [F.col("relevance_score").desc(), *order_by_score()]
    top = top_k_per_query(cand, k, order)
    return project_result(top, extra=["query_id", "rank", "relevance_score"])


def image_search_by_text(items, item_vectors, queries, search_type: str = "covers", **kw) -> DataFrame:
    """Text-query form: no ``scored_only`` filter."""
    return image_search(items, item_vectors, queries, search_type, scored_only_allowed=False, **kw)


def image_search_by_vector(items, item_vectors, queries, search_type: str = "covers", **kw) -> DataFrame:
    return image_search(items, item_vectors, queries, search_type, scored_only_allowed=True, **kw)


def search_summary(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Per query: total results, the query text and the filters it asked
    for (echoed as given). Queries without results report 0."""
    q = with_filter_columns(queries)
    counts = results.groupBy("query_id").agg(F.count(F.lit(1)).cast("bigint").alias("total"))
    return q.join(counts, "query_id", "left").select(
        "query_id", F.col("text").alias("query"), F.coalesce(F.col("total"), F.lit(0)).cast("bigint").alias("total"),
        *FILTER_COLUMNS)

