"""Batch keyword matching: which queries occur (case-insensitively) in which items.

The items' texts are indexed once (``postings``): a query set reads the
postings of its rarest character triples, which gives the candidates, and only
these are checked against the texts (``contains``, or ``LIKE`` with
wildcards). An index that is kept serves any number of query sets and is
extended by new items only; without one it is made for the call.

A query without any literal character ("%") asks for every item: it meets the
items block by block, and no other way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import py_strip
from ..functions.filters import filter_keyword, has_keyword
from ..session import write_scratch
from .postings import BLOCK_ITEMS, PostingIndex


def candidates(items: DataFrame, queries: DataFrame, wildcards: bool = False, index: PostingIndex | None = None) -> DataFrame:
    """(query_id, item_id) pairs that may match; every match is among them.
    ``queries``: query_id, _q (lower-case text)."""
    index = index or PostingIndex(items.sparkSession).add(items)
    special = r"[%_\\]+"
    parts = F.filter(F.split("_q", special, -1), lambda x: x != "") if wildcards else F.array("_q")
    # all pieces of three characters or more, else the longest one
    long = F.filter(parts, lambda x: F.length(x) >= 3)
    longest = F.array_max(F.transform(parts, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    asked = queries.select("query_id", F.when(F.size(long) > 0, long).when(longest.isNotNull(), F.array(longest)).alias("pieces"))
    out = index.candidates(asked.select("query_id", F.explode("pieces").alias("piece")))
    everything = asked.where("pieces is null").select("query_id")
    if wildcards and not everything.isEmpty():
        blocks = max(1, items.count() // BLOCK_ITEMS)
        own = items.select("item_id", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int").alias("block"))
        every = everything.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        out = out.unionByName(own.join(every, "block").select("query_id", "item_id"))
    return out


def keyword_matches(items: DataFrame, queries: DataFrame, carry: list[str], wildcards: bool = False,
                    index: PostingIndex | None = None) -> DataFrame:
    """(query_id, *carry) for every item whose title or description contains
    the query text, case-insensitively. Queries of white space only match
    nothing. ``index`` must hold the items' titles and descriptions."""
    q = queries.where(py_strip(F.coalesce(F.col("text"), F.lit(""))) != "").select("query_id", F.lower("text").alias("_q"))
    found = write_scratch(candidates(items, q, wildcards, index), "keyword-candidates").join(q, "query_id")
    if not {"title", "description"} & set(carry):
        # lower-cased once an item, before the join, not once a candidate
        texts = items.select("item_id", F.lower("title").alias("_title"), F.lower("description").alias("_description"), *[c for c in dict.fromkeys(carry) if c != "item_id"])
        return found.join(texts, "item_id").where(has_keyword(F.col("_title"), F.col("_description"), F.col("_q"), wildcards)).select("query_id", *carry)
    cols = list(dict.fromkeys(["item_id", "title", "description", *carry]))
    hit = filter_keyword(F.col("title"), F.col("description"), F.col("_q"), wildcards=wildcards)
    return found.join(items.select(*cols), "item_id").where(hit).select("query_id", *carry)
