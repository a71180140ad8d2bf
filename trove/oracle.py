"""Independent DuckDB SQL for every SQL-checkable registered query.

The driver registers the raw tables as views; ``PRELUDE`` rebuilds the
catalogue model from them the same way ``trove.sources.fixtures`` does, and
each query appends its own CTEs and final SELECT.
"""

from __future__ import annotations

PRELUDE = r"""
plat AS (
  SELECT l.l_partkey AS item_id, list_sort(list_distinct(list(n.n_name))) AS platforms
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  GROUP BY l.l_partkey),
items AS (
  SELECT d.doc_id AS item_id,
         split_part(d.text, chr(10), 1) AS title,
         d.text AS description,
         CAST(o.o_orderdate AS DATE) AS release_date,
         CASE WHEN lb.doc_id IS NOT NULL THEN CAST(p.p_size AS DOUBLE) / 5.0 END AS score,
         pg.url AS source_url,
         pl.platforms AS platforms,
         [p.p_type, split_part(p.p_name, ' ', 1), split_part(p.p_name, ' ', 2)] AS genres,
         [p.p_brand] AS developers,
         [d.source] AS publishers,
         pg.url AS cover_url,
         CASE WHEN pg.url IS NOT NULL THEN [pg.url] END AS screenshot_urls
  FROM documents d
  LEFT JOIN orders o ON o.o_orderkey = d.doc_id
  LEFT JOIN part p ON p.p_partkey = d.doc_id
  LEFT JOIN labels lb ON lb.doc_id = d.doc_id
  LEFT JOIN pages pg ON pg.page_id = d.doc_id
  LEFT JOIN plat pl ON pl.item_id = d.doc_id),
reviews AS (
  SELECT conv_id * 100 + turn AS review_id, conv_id AS item_id, text AS citation FROM conversations),
rev_agg AS (
  SELECT item_id, count(review_id) AS review_count,
         list(citation ORDER BY review_id) AS reviews_array,
         nullif(string_agg(citation, ' | ' ORDER BY review_id), '') AS reviews_concat
  FROM reviews GROUP BY item_id),
item_vectors AS (
  SELECT CAST(vec_id AS VARCHAR) AS vec_id,
         CASE WHEN label >= 8 THEN vec_id // 5 ELSE vec_id END AS item_id,
         CASE WHEN label >= 8 THEN vec_id END AS review_id,
         CASE WHEN label <= 3 THEN 'description' WHEN label <= 5 THEN 'cover'
              WHEN label <= 7 THEN 'screenshot' ELSE 'review' END AS modality,
         embedding
  FROM embeddings),
kw_queries AS (
  SELECT item_id AS query_id, text FROM benchmark WHERE trim(coalesce(text, '')) <> ''),
vec_queries AS (
  SELECT v.review_id AS query_id, split_part(d.text, chr(10), 1) AS text, v.embedding
  FROM item_vectors v LEFT JOIN documents d ON d.doc_id = v.review_id
  WHERE v.modality = 'review')
"""

# The review objects of a result as one string: 'Critic i: text' joined by ' | '.
WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
REVIEWS_STR = ("array_to_string(list_transform(list_filter(list_transform(coalesce(ra.reviews_array, []::VARCHAR[]), "
               f"lambda x, i: {{'source': 'Critic ' || CAST(i AS VARCHAR), 'review': trim(x, {WS})}}), "
               "lambda s: s.review IS NOT NULL AND s.review <> ''), lambda s: s.source || ': ' || s.review), ' | ')")


def q(body: str) -> str:
    return "WITH " + PRELUDE.strip() + ",\n" + body.strip()


def with_body(ctes: str, select: str) -> str:
    return "WITH " + PRELUDE.strip() + ",\n" + ctes.strip() + "\n" + select.strip()


def _kw_result(filters_sql: str, limit: int = 20) -> str:
    return f"""
m AS (
  SELECT q.query_id, i.* FROM kw_queries q JOIN items i
    ON (contains(lower(i.title), lower(q.text)) OR contains(lower(i.description), lower(q.text)))
  WHERE {filters_sql}),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, item_id) AS rank FROM m)
SELECT r.query_id, CAST(r.rank AS INTEGER) AS rank, r.item_id, r.title, r.description,
       strftime(r.release_date, '%Y-%m-%d') AS release_date, r.score,
       array_to_string(r.platforms, ', ') AS platforms, array_to_string(r.genres, ', ') AS genres,
       CAST(coalesce(ra.review_count, 0) AS BIGINT) AS review_count,
       {REVIEWS_STR} AS reviews
FROM r LEFT JOIN rev_agg ra ON ra.item_id = r.item_id
WHERE r.rank <= {limit}
"""


SQL: dict[str, str] = {}

SQL["keyword_search"] = q(_kw_result("TRUE"))


# ------------------------------------------------------------------ vectors

def sqdist(a: str, b: str) -> str:
    return (f"list_sum(list_transform(list_zip({a}, {b}), lambda p: "
            f"(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))))")


def knn_ctes(modality: str, n: int = 20, name: str = "hits", queries: str = "vec_queries") -> str:
    """Top n vectors of a modality per query, with relative and absolute similarity."""
    return f"""
{name}_pairs AS (
  SELECT q.query_id, v.vec_id, v.item_id, v.review_id, {sqdist('q.embedding', 'v.embedding')} AS dist
  FROM {queries} q, item_vectors v WHERE v.modality = '{modality}'),
{name}_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM {name}_pairs),
{name} AS (
  SELECT *, CASE WHEN max(dist) OVER (PARTITION BY query_id) = 0 THEN 1.0
                 ELSE 1.0 - dist / max(dist) OVER (PARTITION BY query_id) END AS rel_sim,
         1.0 - dist AS abs_sim
  FROM {name}_ranked WHERE rank <= {n})"""


def knn_report(modality: str, absolute: bool = False) -> str:
    sim = "abs_sim" if absolute else "rel_sim"
    rid = " review_id," if modality == "review" else ""
    return q(knn_ctes(modality) + f"""
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, item_id,{rid}
       round(dist, 6) AS dist, round({sim}, 6) AS similarity FROM hits""")


SQL["knn_descriptions"] = knn_report("description")
SQL["knn_reviews"] = knn_report("review", absolute=True)
SQL["knn_covers"] = knn_report("cover")
SQL["knn_screenshots"] = knn_report("screenshot")
SQL["knn_by_vector"] = q("""
even AS (SELECT * FROM vec_queries WHERE query_id % 2 = 0),
odd AS (SELECT * FROM vec_queries WHERE query_id % 2 <> 0),
""" + knn_ctes("cover", name="c", queries="even").strip() + "," + knn_ctes("screenshot", name="s", queries="odd") + """
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, item_id, round(dist, 6) AS dist,
       round(rel_sim, 6) AS similarity FROM (SELECT * FROM c UNION ALL SELECT * FROM s)""")
# Product quantiser: 32 subspaces of 2 dimensions, up to 256 words each, three
# rounds of training on the sample; the 160 nearest codes are ranked exactly.


def _own_word(rows: str, words: str) -> str:
    return (f"SELECT r.s, r.vec_id, r.x, r.y, c.w, c.x AS cx, c.y AS cy FROM {rows} r JOIN {words} c ON c.s = r.s "
            "QUALIFY row_number() OVER (PARTITION BY r.s, r.vec_id ORDER BY (r.x - c.x) * (r.x - c.x) + (r.y - c.y) * (r.y - c.y), c.w) = 1")


def _rounds(n: int) -> str:
    out = []
    for i in range(n):
        out.append(f"""
a{i} AS MATERIALIZED ({_own_word('sampled', f'c{i}')}),
c{i + 1} AS MATERIALIZED (
  SELECT c.s, c.w, coalesce(m.x, c.x) AS x, coalesce(m.y, c.y) AS y
  FROM c{i} c LEFT JOIN (SELECT s, w, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM a{i} GROUP BY s, w) m ON m.s = c.s AND m.w = c.w),""")
    return "".join(out)


SQL["knn_approx"] = q(f"""
corpus AS MATERIALIZED (SELECT vec_id, embedding FROM item_vectors WHERE modality = 'description'),
ordered AS (SELECT vec_id, row_number() OVER (ORDER BY md5(vec_id), vec_id) - 1 AS w FROM corpus),
sub AS MATERIALIZED (
  SELECT vec_id, s, CAST(embedding[2 * s + 1] AS DOUBLE) AS x, CAST(embedding[2 * s + 2] AS DOUBLE) AS y
  FROM corpus, (SELECT unnest(range(32)) AS s)),
sampled AS MATERIALIZED (SELECT sub.*, o.w FROM sub JOIN ordered o USING (vec_id) WHERE o.w < 4096),
c0 AS MATERIALIZED (SELECT s, w, x, y FROM sampled WHERE w < 256),{_rounds(3)}
codes AS MATERIALIZED (
  SELECT vec_id, list(cx ORDER BY s) AS xs, list(cy ORDER BY s) AS ys FROM ({_own_word('sub', 'c3')}) GROUP BY vec_id),
asked AS MATERIALIZED (
  SELECT query_id, embedding, list_transform(range(32), lambda s: CAST(embedding[2 * s + 1] AS DOUBLE)) AS xs,
         list_transform(range(32), lambda s: CAST(embedding[2 * s + 2] AS DOUBLE)) AS ys FROM vec_queries),
near AS (
  SELECT a.query_id, a.embedding, c.vec_id FROM asked a, codes c
  QUALIFY row_number() OVER (PARTITION BY a.query_id ORDER BY
    list_sum(list_transform(list_zip(a.xs, c.xs, a.ys, c.ys), lambda z: (z[1] - z[2]) * (z[1] - z[2]) + (z[3] - z[4]) * (z[3] - z[4]))), c.vec_id) <= 160),
pairs AS (SELECT n.query_id, n.vec_id, {sqdist('n.embedding', 'c.embedding')} AS dist FROM near n JOIN corpus c USING (vec_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(dist, 6) AS dist FROM ranked WHERE rank <= 20""")
SQL["similarity_relative"] = q(knn_ctes("description") + """
SELECT query_id, CAST(rank AS INTEGER) AS rank, round(rel_sim, 6) AS similarity FROM hits""")
SQL["similarity_absolute"] = q(knn_ctes("review") + """
SELECT query_id, CAST(rank AS INTEGER) AS rank, round(abs_sim, 6) AS similarity FROM hits""")
SQL["hit_list_max"] = q(knn_ctes("description") + """
SELECT query_id, round(max(dist), 6) AS max_dist FROM hits GROUP BY query_id""")
SQL["dedupe_hits"] = q(knn_ctes("review") + """,
best AS (SELECT *, row_number() OVER (PARTITION BY query_id, item_id ORDER BY dist, vec_id) AS rn FROM hits)
SELECT query_id, item_id, vec_id, round(dist, 6) AS dist FROM best WHERE rn = 1""")
SQL["union_modalities"] = q("""
x AS (SELECT 1)
SELECT modality, CAST(count(*) AS BIGINT) AS vectors, CAST(count(DISTINCT item_id) AS BIGINT) AS items
FROM item_vectors GROUP BY modality""")
SQL["modality_coverage"] = q("""
x AS (SELECT 1)
SELECT item_id, modality, CAST(count(*) AS BIGINT) AS vectors FROM item_vectors GROUP BY item_id, modality""")

# ------------------------------------------------------------------ models

TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def tokens(x: str) -> str:
    return TOKENS.format(x=x)


def rerank(qtext: str, passage: str) -> str:
    qt = f"list_distinct({tokens(qtext)})"
    pt = f"({tokens(passage)})"
    return (f"CASE WHEN len({qt}) > 0 THEN CAST(len(list_intersect({qt}, {pt})) AS DOUBLE) / len({qt}) "
            f"ELSE 0.0 END")


SQL["encode_text_batch"] = q(f"""
toks AS (SELECT doc_id, unnest({tokens('text')}) AS tok FROM documents),
cnt AS (SELECT doc_id, CAST(('0x' || substr(md5(tok), 1, 8))::BIGINT % 64 AS INTEGER) AS bucket, count(*) AS c
        FROM toks GROUP BY ALL),
nrm AS (SELECT doc_id, sqrt(sum(c * c)) AS n FROM cnt GROUP BY doc_id)
SELECT cnt.doc_id, bucket, round(c / n, 6) AS weight FROM cnt JOIN nrm USING (doc_id)""")



def text_vectors(name: str, key: str, text: str, source: str) -> str:
    """CTE ``name`` (id, embedding): L2-normalised counts of hashed tokens in steps of 2**-20."""
    return f"""
{name}_t AS (SELECT {key} AS id, {tokens(text)} AS toks FROM {source}),
{name}_b AS (SELECT id, list_transform(toks, lambda t: CAST(('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS INTEGER)) AS bs
             FROM {name}_t),
{name}_c AS (SELECT id, list_transform(range(64), lambda i: CAST(len(list_filter(bs, lambda b: b = i)) AS DOUBLE)) AS cs
             FROM {name}_b),
{name} AS (SELECT id, list_transform(cs, lambda c: CASE WHEN list_sum(list_transform(cs, lambda y: y * y)) = 0 THEN 0.0
               ELSE floor(c / sqrt(list_sum(list_transform(cs, lambda y: y * y))) * 1048576 + 0.5) / 1048576 END) AS embedding FROM {name}_c)"""


def byte_vectors(name: str, key: str, text: str, source: str) -> str:
    """CTE ``name`` (id, embedding): share of bytes in each of 64 ranges of 4."""
    return f"""
{name}_h AS (SELECT {key} AS id, hex(encode(coalesce({text}, ''))) AS hx FROM {source}),
{name}_b AS (SELECT id, list_transform(range(length(hx) // 2), lambda i:
                 CAST(('0x' || substr(hx, 2 * i + 1, 2))::INTEGER // 4 AS INTEGER)) AS bs FROM {name}_h),
{name} AS (SELECT id, list_transform(range(64), lambda i: CASE WHEN len(bs) = 0 THEN 0.0::FLOAT
               ELSE CAST(CAST(len(list_filter(bs, lambda b: b = i)) AS DOUBLE) / len(bs) AS FLOAT) END) AS embedding
           FROM {name}_b)"""


SQL["encode_image_batch"] = q(byte_vectors("enc", "page_id", "html", "pages").strip() + """,
long AS (SELECT id, unnest(range(64)) AS bin, unnest(embedding) AS share FROM enc)
SELECT id AS page_id, CAST(bin AS INTEGER) AS bin, round(CAST(share AS DOUBLE), 6) AS share FROM long WHERE share > 0""")

SEM_CTES = knn_ctes("description", n=999999) + f""",
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, item_id ORDER BY dist, vec_id) AS rn
                        FROM hits) WHERE rn = 1),
cand AS (
  SELECT b.query_id, b.rel_sim AS vec_score, i.*, q.text AS q_text
  FROM best b JOIN items i ON i.item_id = b.item_id JOIN vec_queries q ON q.query_id = b.query_id
  WHERE {{where}}),
fused AS (SELECT *, {rerank('q_text', 'description')} AS rerank_score FROM cand),
fused2 AS (SELECT *, {{fuse}} AS relevance_score FROM fused),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC, score DESC NULLS LAST,
                                      item_id) AS rank FROM fused2)"""


def semantic(where: str = "TRUE", k: int = 10, select: str = "", fuse: str = "vec_score * 0.7 + rerank_score * 0.3",
             reviews: bool = False) -> str:
    ctes = SEM_CTES.replace("{where}", where).replace("{fuse}", fuse).replace("rank <= 999999", f"rank <= {2 * k}")
    sel = select or """SELECT t.query_id, CAST(t.rank AS INTEGER) AS rank, t.item_id, t.title, t.description,
       strftime(t.release_date, '%Y-%m-%d') AS release_date, t.score,
       array_to_string(t.platforms, ', ') AS platforms, array_to_string(t.genres, ', ') AS genres,
       round(t.relevance_score, 6) AS relevance_score"""
    if reviews:
        sel += f""",
       CAST(coalesce(ra.review_count, 0) AS BIGINT) AS review_count, {REVIEWS_STR} AS reviews
FROM top t LEFT JOIN rev_agg ra ON ra.item_id = t.item_id WHERE t.rank <= {k}"""
    else:
        sel += f"\nFROM top t WHERE t.rank <= {k}"
    return q(ctes + "\n" + sel)


SQL["rerank_score_batch"] = q(knn_ctes("description") + f"""
SELECT h.query_id, h.item_id, round({rerank('q.text', 'i.description')}, 6) AS rerank_score
FROM hits h JOIN items i ON i.item_id = h.item_id JOIN vec_queries q ON q.query_id = h.query_id""")
SQL["semantic_search"] = semantic()
SQL["rerank_fuse"] = semantic(select="SELECT t.query_id, CAST(t.rank AS INTEGER) AS rank, t.item_id, "
                                     "round(t.relevance_score, 6) AS relevance_score")
SQL["top_k_per_query"] = semantic(k=5, select="SELECT t.query_id, CAST(t.rank AS INTEGER) AS rank, t.item_id")
SQL["overfetch_then_cut"] = semantic(where="i.score >= 5.0",
                                     select="SELECT t.query_id, CAST(t.rank AS INTEGER) AS rank, t.item_id, t.score")
SQL["rerank_fallback"] = semantic(fuse="vec_score",
                                  select="SELECT t.query_id, CAST(t.rank AS INTEGER) AS rank, t.item_id, "
                                         "round(t.relevance_score, 6) AS relevance_score")
SQL["semantic_search_display"] = semantic(k=5, reviews=True)
SQL["rerank_join_back"] = semantic(select="SELECT t.query_id, CAST(count(*) AS BIGINT) AS results, "
                                          "CAST(count(DISTINCT t.item_id) AS BIGINT) AS distinct_items").replace(
    "WHERE t.rank <= 10", "WHERE t.rank <= 10 GROUP BY t.query_id")
SQL["search_summary"] = semantic(select="SELECT t.query_id, count(*) AS n").replace(
    "\nSELECT t.query_id, count(*) AS n\nFROM top t WHERE t.rank <= 10", """,
res AS (SELECT query_id, count(*) AS n FROM top WHERE rank <= 10 GROUP BY query_id)
SELECT q.query_id, q.text AS query, CAST(coalesce(res.n, 0) AS BIGINT) AS total,
       'platform=None; genre=None; min_score=None; min_year=None; scored_only=false' AS filters
FROM vec_queries q LEFT JOIN res ON res.query_id = q.query_id""")


def image(modality: str, where: str = "TRUE") -> str:
    return q(knn_ctes(modality) + f""",
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, item_id ORDER BY dist, vec_id) AS rn
                        FROM hits) WHERE rn = 1),
cand AS (SELECT b.query_id, b.rel_sim AS relevance_score, i.* FROM best b JOIN items i ON i.item_id = b.item_id
         WHERE {where}),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC, score DESC NULLS LAST,
                                      item_id) AS rank FROM cand)
SELECT query_id, CAST(rank AS INTEGER) AS rank, item_id, title, score, round(relevance_score, 6) AS relevance_score
FROM top WHERE rank <= 10""")


SQL["image_search_by_text"] = image("cover")
SQL["image_search_by_vector"] = image("screenshot", "i.score IS NOT NULL")
SQL["hits_join_catalogue"] = q(knn_ctes("cover") + """
SELECT h.query_id, CAST(h.rank AS INTEGER) AS rank, h.item_id, i.title FROM hits h JOIN items i ON i.item_id = h.item_id""")
SQL["attach_hit_score"] = q(knn_ctes("review") + """,
per_item AS (SELECT item_id, max(abs_sim) AS s FROM hits GROUP BY item_id)
SELECT i.item_id, round(coalesce(p.s, 0.0), 6) AS vec_score FROM items i LEFT JOIN per_item p ON p.item_id = i.item_id""")

# End-to-end searches: the same SQL on vectors encoded from texts or bytes.
_OWN = """,
item_vectors2 AS (SELECT CAST(id AS VARCHAR) AS vec_id, id AS item_id, CAST(NULL AS BIGINT) AS review_id,
                         '{modality}' AS modality, embedding FROM side),
vec_queries2 AS (SELECT s.id AS query_id, {text} AS text, s.embedding FROM asked s {join}),
"""


def _own_vectors(sql: str, vectors: str, modality: str, text: str = "''", join: str = "") -> str:
    head, body = sql[:len(q(""))], sql[len(q("")):]
    body = body.replace("item_vectors", "item_vectors2").replace("vec_queries", "vec_queries2")
    return head + vectors.strip() + _OWN.format(modality=modality, text=text, join=join).rstrip() + "\n" + body.strip()


SQL["semantic_search_text"] = _own_vectors(
    SQL["rerank_fuse"], text_vectors("side", "item_id", "description", "items") + "," +
    text_vectors("asked", "query_id", "text", "vec_queries"), "description",
    "v.text", "JOIN vec_queries v ON v.query_id = s.id")
SQL["image_search_by_bytes"] = _own_vectors(
    image("cover"), byte_vectors("side", "page_id", "html", "pages") + "," +
    byte_vectors("asked", "item_id", "text", "benchmark"), "cover").replace(
    "rank, item_id, title, score, round(", "rank, item_id, round(")
