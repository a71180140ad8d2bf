"""Registered retrieval-augmented text queries, each next to its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.filters import Filters
from .oracle import SQL, q, semantic
from .plans import rag as R
from .plans import search as SE
from .registry import register
from .sources import fixtures as fx

WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
EMPTYING = Filters(min_score=9.5, scored_only=True)   # leaves many queries without results


def _queries(spark, d) -> DataFrame:
    return fx.vector_queries(spark, d).withColumn("text", F.coalesce("text", F.lit("")))


def _display(spark, d, filters=None) -> DataFrame:
    return SE.semantic_search_display(fx.items(spark, d), fx.reviews(spark, d), fx.item_vectors(spark, d),
                                      _queries(spark, d), filters=filters)


def _display_sql(where: str = "TRUE") -> str:
    """CTE 'disp': the k=5 display results (query_id, rank, title, release_date, genres, description)."""
    body = semantic(k=5, where=where, select="SELECT 1")
    ctes = body.split("\nSELECT 1")[0]
    return ctes + """,
disp AS (SELECT query_id, rank, title, release_date, genres, description FROM top WHERE rank <= 5)"""


def _with(ctes_sql: str, tail: str) -> str:
    return ctes_sql + tail


YEAR_SQL = "CASE WHEN release_date IS NULL THEN 'Unknown' ELSE split_part(strftime(release_date, '%Y-%m-%d'), '-', 1) END"


@register("rag_context")
def q_rag_context(spark, d):
    ctx = R.rag_context(_display(spark, d))
    return ctx.select("query_id", "rank", "title", "year", F.array_join("genres", ", ").alias("genres"),
                      F.md5("description").alias("description_md5"))


SQL["rag_context"] = _with(_display_sql(), f"""
SELECT query_id, CAST(rank AS INTEGER) AS rank, coalesce(title, 'Unknown') AS title, {YEAR_SQL} AS year,
       array_to_string(genres, ', ') AS genres, md5(coalesce(description, '')) AS description_md5 FROM disp""")


def _block_sql() -> str:
    genres = "CASE WHEN coalesce(len(genres), 0) > 0 THEN array_to_string(genres, ', ') ELSE 'Unknown' END"
    desc = ("CASE WHEN length(coalesce(description, '')) > 300 THEN substring(description, 1, 300) || '...' "
            "ELSE coalesce(description, '') END")
    return (f"chr(10) || CAST(rank AS VARCHAR) || '. **' || coalesce(title, 'Unknown') || '** (' || {YEAR_SQL} || ')' || chr(10) || "
            f"'   Genres: ' || {genres} || chr(10) || '   Description: ' || {desc} || chr(10)")


def _sql_lit(s: str) -> str:
    """A Python string as a DuckDB expression (newlines as chr(10))."""
    parts = s.split("\n")
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts)


def _template_sql(template: str, **exprs: str) -> str:
    out, rest = [], template
    while "{" in rest:
        pre, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        if pre:
            out.append(_sql_lit(pre))
        out.append(f"CAST({exprs[name]} AS VARCHAR)")
    if rest:
        out.append(_sql_lit(rest))
    return " || ".join(out)


@register("rag_prompt")
def q_rag_prompt(spark, d):
    p = R.rag_prompt(_queries(spark, d), _display(spark, d))
    return p.select("query_id", F.length("prompt").alias("chars"), F.md5("prompt").alias("prompt_md5"))


SQL["rag_prompt"] = _with(_display_sql(), f""",
blocks AS (SELECT query_id, count(*) AS n, string_agg({_block_sql()}, '' ORDER BY rank) AS b FROM disp GROUP BY query_id),
p AS (SELECT blocks.query_id, {_template_sql(R.PROMPT_HEADER, query="coalesce(vq.text, '')", n='n')} || b || {_sql_lit(R.PROMPT_FOOTER)} AS prompt
      FROM blocks JOIN vec_queries vq ON vq.query_id = blocks.query_id)
SELECT query_id, CAST(length(prompt) AS INTEGER) AS chars, md5(prompt) AS prompt_md5 FROM p""")


def _answers_sql(where: str = "TRUE") -> str:
    entry = _template_sql(R.ANSWER_ENTRY, i="rank", title="coalesce(title, 'Unknown')", year=YEAR_SQL,
                          query="coalesce(vq.text, '')")
    return _with(_display_sql(where), f""",
ents AS (SELECT disp.query_id, count(*) AS n, string_agg({entry}, '' ORDER BY rank) AS e
         FROM disp JOIN vec_queries vq ON vq.query_id = disp.query_id GROUP BY disp.query_id),
ans AS (SELECT query_id, n, {_template_sql(R.ANSWER_HEADER, n='n')} || e AS answer FROM ents)""")


@register("rag_fallback_answer")
def q_rag_fallback_answer(spark, d):
    a = R.rag_fallback_answer(_queries(spark, d), _display(spark, d))
    return a.select("query_id", F.col("n").cast("bigint").alias("n"), "answer")


SQL["rag_fallback_answer"] = _answers_sql() + """
SELECT query_id, CAST(n AS BIGINT) AS n, answer FROM ans"""


def _rag_search_sql(where: str) -> str:
    empty = _template_sql(R.EMPTY_ANSWER, query="coalesce(vq.text, '')")
    return _answers_sql(where) + f"""
SELECT vq.query_id, CAST(coalesce(ans.n, 0) AS BIGINT) AS n_games,
       CASE WHEN ans.n IS NULL THEN {empty} ELSE ans.answer END AS response
FROM vec_queries vq LEFT JOIN ans ON ans.query_id = vq.query_id"""


@register("rag_search")
def q_rag_search(spark, d):
    return R.rag_answers(_queries(spark, d), _display(spark, d))


SQL["rag_search"] = _rag_search_sql("TRUE")


@register("rag_empty_answer")
def q_rag_empty_answer(spark, d):
    return R.rag_answers(_queries(spark, d), _display(spark, d, EMPTYING))


SQL["rag_empty_answer"] = _rag_search_sql("i.score >= 9.5")


@register("generate_answers_batch")
def q_generate_answers_batch(spark, d):
    def generator(prompts):
        # Stand-in model: answers with the size of the prompt it was given.
        return [f"Read {len(p)} characters." for p in prompts]
    return R.rag_answers(_queries(spark, d), _display(spark, d), generator=generator)


SQL["generate_answers_batch"] = _with(_display_sql(), f""",
blocks AS (SELECT query_id, count(*) AS n, string_agg({_block_sql()}, '' ORDER BY rank) AS b FROM disp GROUP BY query_id),
p AS (SELECT blocks.query_id, n, {_template_sql(R.PROMPT_HEADER, query="coalesce(vq.text, '')", n='n')} || b || {_sql_lit(R.PROMPT_FOOTER)} AS prompt
      FROM blocks JOIN vec_queries vq ON vq.query_id = blocks.query_id)
SELECT vq.query_id, CAST(coalesce(p.n, 0) AS BIGINT) AS n_games,
       CASE WHEN p.n IS NULL THEN {_template_sql(R.EMPTY_ANSWER, query="coalesce(vq.text, '')")}
            ELSE 'Read ' || length(p.prompt) || ' characters.' END AS response
FROM vec_queries vq LEFT JOIN p ON p.query_id = vq.query_id""")


@register("drop_repeated_sentences")
def q_drop_repeated_sentences(spark, d):
    docs = fx.table(spark, d, "documents")
    out = docs.select("doc_id", R.drop_repeated_sentences(F.col("text")).alias("t"))
    return out.select("doc_id", F.length("t").alias("chars"), F.md5("t").alias("text_md5"))


SQL["drop_repeated_sentences"] = q("""
s AS (SELECT doc_id, string_split(text, '. ') AS p FROM documents),
k AS (SELECT doc_id, array_to_string(list_filter(p, lambda x, i: i = 1 OR x <> p[i - 1]), '. ') AS t FROM s)
SELECT doc_id, CAST(length(t) AS INTEGER) AS chars, md5(t) AS text_md5 FROM k""")


def _answers_from_conversations(spark, d) -> DataFrame:
    """Answer texts derived from the conversations: the turn's text as the
    reasoning part, then a recommendation and the trailing filter note."""
    c = fx.table(spark, d, "conversations")
    t = F.concat(F.col("text"), F.lit("\n\nBased on your query, I found 1 highly relevant games:\n\n1. **"),
                 F.col("role"), F.lit("** ("), F.col("turn").cast("string"),
                 F.lit(")\n   🎯 **Why I recommend it**: "), F.col("text"),
                 F.lit("\n\nI applied filters: none. These are ranked by relevance."))
    return c.select("conv_id", "turn", t.alias("answer"))


ANSWERS_SQL = """
ans AS (SELECT conv_id, turn, text || chr(10) || chr(10) || 'Based on your query, I found 1 highly relevant games:'
               || chr(10) || chr(10) || '1. **' || role || '** (' || CAST(turn AS VARCHAR) || ')' || chr(10)
               || '   🎯 **Why I recommend it**: ' || text || chr(10) || chr(10)
               || 'I applied filters: none. These are ranked by relevance.' AS answer FROM conversations)"""


@register("split_reasoning")
def q_split_reasoning(spark, d):
    a = _answers_from_conversations(spark, d)
    s = a.select("conv_id", "turn", R.split_reasoning(F.col("answer")).alias("s"))
    return s.select("conv_id", "turn", F.coalesce(F.length("s.thinking"), F.lit(-1)).alias("thinking_chars"),
                    F.md5("s.thinking").alias("thinking_md5"), F.md5("s.analysis").alias("analysis_md5"))


LINE = r"[^\n\r\x{2028}\x{2029}]"


def _split_sql() -> str:
    pats = [r"(?i)Based on your query", r"(?i)Here are the games", r"(?i)I found \d+ games",
            r"(?m)^\d+\. \*\*" + LINE + r"*?\*\* \(", r"(?i)Recommendations:"]
    pre = [f"CASE WHEN regexp_matches(c, '{p}') THEN length(regexp_split_to_array(c, '{p}')[1]) END" for p in pats]
    note = r"I applied filters:" + LINE + r"*?\. These are ranked by relevance\.?\z"
    return ANSWERS_SQL + f""",
cl AS (SELECT conv_id, turn, regexp_replace(answer, '{note}', '') AS c FROM ans),
ix AS (SELECT *, least({', '.join(pre)}) AS idx FROM cl),
parts AS (SELECT *, trim(substring(c, 1, idx), {WS}) AS th, trim(substring(c, idx + 1), {WS}) AS an FROM ix),
res AS (SELECT conv_id, turn, CASE WHEN idx IS NOT NULL AND length(th) > 50 THEN th END AS thinking,
               CASE WHEN idx IS NOT NULL AND length(th) > 50 THEN an ELSE c END AS analysis FROM parts)"""


SQL["split_reasoning"] = q(_split_sql() + """
SELECT conv_id, turn, CAST(coalesce(length(thinking), -1) AS INTEGER) AS thinking_chars, md5(thinking) AS thinking_md5,
       md5(analysis) AS analysis_md5 FROM res""")


@register("parse_recommendations")
def q_parse_recommendations(spark, d):
    a = _answers_from_conversations(spark, d)
    s = a.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("answer_id"),
                 R.split_reasoning(F.col("answer"))["analysis"].alias("analysis"))
    p = R.parse_recommendations(s, "answer_id", "analysis")
    return p.select("answer_id", "pos", "kind", F.coalesce(F.col("number"), F.lit(-1)).alias("number"),
                    "title", "year", F.md5("text").alias("text_md5"))


def _parse_sql() -> str:
    game = r"^(\d+)\. \*\*(" + LINE + r"*?)\*\* \(([^)]+)\)\s*(" + LINE + r"*)"
    test = r"^\d+\. \*\*" + LINE + r"*?\*\* \(" + LINE + r"*?\)"
    reason = r"🎯 \*\*Why I recommend it\*\*: (" + LINE + r"*)"
    return _split_sql() + f""",
secs AS (SELECT CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS answer_id,
                list_filter(string_split(analysis, chr(10) || chr(10)), lambda s: trim(s, {WS}) <> '') AS l FROM res),
ex AS (SELECT answer_id, unnest(l) AS sec, unnest(generate_series(1, len(l))) AS pos FROM secs),
ex2 AS (SELECT answer_id, pos, trim(sec, {WS}) AS sec FROM ex),
k AS (SELECT *, CASE WHEN starts_with(sec, 'Based on your query') THEN 'intro'
                     WHEN regexp_matches(sec, '{test}') THEN 'game' ELSE 'other' END AS kind,
             regexp_extract(sec, '{game}', 4) AS rest FROM ex2)
SELECT answer_id, CAST(pos AS INTEGER) AS pos, kind,
       CASE WHEN kind = 'game' THEN CAST(regexp_extract(sec, '{game}', 1) AS INTEGER) ELSE -1 END AS number,
       CASE WHEN kind = 'game' THEN regexp_extract(sec, '{game}', 2) END AS title,
       CASE WHEN kind = 'game' THEN regexp_extract(sec, '{game}', 3) END AS year,
       md5(CASE WHEN kind = 'game' THEN (CASE WHEN regexp_matches(rest, '{reason}') THEN regexp_extract(rest, '{reason}', 1)
                                               ELSE rest END)
                ELSE sec END) AS text_md5
FROM k"""


SQL["parse_recommendations"] = q(_parse_sql())
