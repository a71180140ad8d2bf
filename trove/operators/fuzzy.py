"""Fuzzy title match: all pairs of a query and a title within ``max_edits``
insertions, deletions and substitutions of characters, by equi-joins.

A title cut into d + m segments keeps at least m of them unchanged under d
edits. So a pair within d edits meets in an equi-join on the title's length,
the numbers of m segments and their text; the query offers the places where
these segments may have moved to, which are few, as every move costs an edit.
The candidates are verified with ``levenshtein``.

m is 1 at first. Segments that many titles and queries share ("The Adventures
of ...") are not joined: the titles and queries that meet there go on to keys
of two segments, then three. What is still crowded after that, and titles too
short to be cut, is joined in bounded blocks of titles and tiles of queries,
so nothing is dropped and no key fills one task.

Equal texts are one title: results are pairs of representatives with the
number of rows behind each, so copies never multiply.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_scratch

#: Pairs (titles x queries) of one key above which it goes on to more segments.
CROWD = 1 << 16
#: Segments in a key, at most.
MOST_SEGMENTS = 3
#: Rows on each side of a block pair of the last join.
BLOCK = 1 << 10


def text_classes(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(t, text, id, n): the distinct lower-case texts with their smallest id
    and number of rows; null texts are left out."""
    classes = (rows.select(F.col(id_col).alias("id"), F.lower(text_col).alias("text")).where("text is not null")
               .groupBy("text").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    return write_scratch(classes.select(F.monotonically_increasing_id().alias("t"), "text", "id", "n"), "fuzzy-texts")


def _moves(d: int, delta: int, m: int) -> list[tuple[int, ...]]:
    """Shifts of m unchanged segments, from left to right, that d edits allow
    between texts whose lengths differ by ``delta``: each change of the shift
    costs its size, from 0 at the left end to ``delta`` at the right end."""
    found = [((), 0, 0)]
    for _ in range(m):
        found = [((*path, s), s, cost + abs(s - last)) for path, last, cost in found
                 for s in range(-d, d + 1) if cost + abs(s - last) <= d]
    return [path for path, last, cost in found if cost + abs(delta - last) <= d]


def _cut(length: Column, pieces: int, number: Column) -> tuple[Column, Column]:
    """(start from 0, length) of a segment; the last ones are one longer."""
    size, extra = F.floor(length / pieces), length % pieces
    longer = F.greatest(number - (F.lit(pieces) - extra), F.lit(0))
    return number * size + longer, size + (number >= F.lit(pieces) - extra).cast("int")


def _key(length: Column, which: Column, parts: list[Column]) -> Column:
    return F.xxhash64(length.cast("int"), which, F.array(*parts))


def _title_keys(titles: DataFrame, d: int, m: int) -> DataFrame:
    """(key, t): one key per choice of m of the d + m segments."""
    pieces, n = d + m, F.length("text")
    chosen = F.array(*[F.array(*[F.lit(i) for i in c]) for c in combinations(range(pieces), m)])
    df = titles.where(n >= pieces).select("t", "text", F.posexplode(chosen).alias("which", "seg"))
    parts = []
    for k in range(m):
        start, size = _cut(n, pieces, F.col("seg")[k])
        parts.append(F.substring(F.col("text"), (start + 1).cast("int"), size.cast("int")))
    return df.select(_key(n, F.col("which"), parts).alias("key"), "t")


def _query_keys(queries: DataFrame, d: int, m: int) -> DataFrame:
    """(key, q): the same keys at every place that d edits can move them to."""
    pieces = d + m
    probes = [(delta, w, c, path) for delta in range(-d, d + 1) for w, c in enumerate(combinations(range(pieces), m))
              for path in _moves(d, delta, m)]
    ints = lambda xs: F.array(*[F.lit(x) for x in xs])
    offered = F.array(*[F.struct(F.lit(delta).alias("delta"), F.lit(w).alias("which"), ints(c).alias("seg"), ints(path).alias("move"))
                        for delta, w, c, path in probes])
    df = queries.select("q", "text", F.explode(offered).alias("p"))
    n = F.length("text") - F.col("p.delta")                      # delta = query's length - title's length
    parts, inside = [], n >= pieces
    for k in range(m):
        start, size = _cut(n, pieces, F.col("p.seg")[k])
        at = start + F.col("p.move")[k]
        inside = inside & (at >= 0) & (at + size <= F.length("text"))
        parts.append(F.substring(F.col("text"), (at + 1).cast("int"), size.cast("int")))
    return df.where(inside).select(_key(n, F.col("p.which"), parts).alias("key"), "q").distinct()


def _in_blocks(titles: DataFrame, queries: DataFrame) -> DataFrame:
    """(t, q) of equal keys, every key cut into blocks of titles and tiles of
    queries that meet pair by pair."""
    many = lambda name: F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias(name)
    sizes = write_scratch(titles.groupBy("key").agg(many("blocks")).join(queries.groupBy("key").agg(many("tiles")), "key"), "fuzzy-sizes")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    some = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = titles.join(sizes, "key").select("key", "t", some("t", "blocks").alias("block"), every("tiles").alias("tile"))
    right = queries.join(sizes, "key").select("key", "q", every("blocks").alias("block"), some("q", "tiles").alias("tile"))
    return left.join(right, ["key", "block", "tile"]).select("t", "q")


def candidate_pairs(titles: DataFrame, queries: DataFrame, d: int) -> DataFrame:
    """(t, q) pairs that may be within d edits; every such pair is among them.
    ``titles``: t, text; ``queries``: q, text."""
    found = []
    more_titles, more_queries = titles, queries
    for m in range(1, MOST_SEGMENTS + 1):
        q_keys = write_scratch(_query_keys(more_queries, d, m), "fuzzy-probes")
        t_keys = write_scratch(_title_keys(more_titles, d, m).join(q_keys.select("key").distinct(), "key", "left_semi"), "fuzzy-keys")
        crowded = write_scratch(t_keys.groupBy("key").agg(F.count(F.lit(1)).alias("titles"))
                                .join(q_keys.groupBy("key").agg(F.count(F.lit(1)).alias("queries")), "key")
                                .where(F.col("titles") * F.col("queries") > CROWD).select("key"), "fuzzy-crowded")
        found.append(t_keys.join(crowded, "key", "left_anti").join(q_keys, "key").select("t", "q"))
        if crowded.isEmpty():
            break
        hot_t, hot_q = t_keys.join(crowded, "key", "left_semi"), q_keys.join(crowded, "key", "left_semi")
        if m == MOST_SEGMENTS:
            found.append(_in_blocks(hot_t, hot_q))
        else:
            more_titles = more_titles.join(hot_t.select("t").distinct(), "t", "left_semi")
            more_queries = more_queries.join(hot_q.select("q").distinct(), "q", "left_semi")
            # titles too short to be cut further meet their queries in blocks
            found.append(_short_pairs(more_titles, more_queries, d, d + m, d + m + 1))
    found.append(_short_pairs(titles, queries, d, 0, d + 1))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def _short_pairs(titles: DataFrame, queries: DataFrame, d: int, least: int, below: int) -> DataFrame:
    """Pairs by length alone, of titles of ``least`` up to ``below`` characters."""
    n = F.length("text")
    near = F.array(*[F.lit(x) for x in range(least, below)])
    t = titles.where((n >= least) & (n < below)).select(n.cast("long").alias("key"), "t")
    q = queries.select("q", n.alias("n"), F.explode(near).alias("key")).where(F.abs(F.col("n") - F.col("key")) <= d)
    return _in_blocks(t, q.select(F.col("key").cast("long").alias("key"), "q"))


def fuzzy_title_match(queries: DataFrame, items: DataFrame, max_edits: int = 2, query_id: str = "query_id", query_text: str = "text",
                      item_id: str = "item_id", title: str = "title") -> DataFrame:
    """query_id, n_queries, title_id, n_items, distance: for every distinct
    query text (named by its smallest id) all distinct titles within
    ``max_edits``, ignoring case. Null texts match nothing; an empty text is a
    text of length 0."""
    d = max_edits
    titles = text_classes(items, item_id, title)
    asked = text_classes(queries, query_id, query_text).withColumnRenamed("t", "q")
    pairs = candidate_pairs(titles.select("t", "text"), asked.select("q", "text"), d)
    # the distances are the work: few bytes, which Spark would otherwise put into a task or two
    spread = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (pairs.join(titles.select("t", F.col("text").alias("title"), F.col("id").alias("title_id"), F.col("n").alias("n_items")), "t")
            .join(asked.select("q", "text", F.col("id").alias("query_id"), F.col("n").alias("n_queries")), "q")
            .repartition(spread, "t", "q")
            .withColumn("distance", F.levenshtein("text", "title", d)).where("distance >= 0")
            .select("query_id", "n_queries", "title_id", "n_items", "distance"))


def title_classes(items: DataFrame, item_id: str = "item_id", title: str = "title") -> DataFrame:
    """item_id, title_id: every item with the item that names its title in the
    results of ``fuzzy_title_match``."""
    folded = items.select(F.col(item_id).alias("item_id"), F.lower(title).alias("text")).where("text is not null")
    first = folded.groupBy("text").agg(F.min("item_id").alias("title_id"))
    return folded.join(first, "text").select("item_id", "title_id")
