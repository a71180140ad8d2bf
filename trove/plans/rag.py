"""Retrieval-augmented text jobs: context, prompt, template answers, answer
clean-up and parsing, as column expressions over result tables.

Per-query text is assembled from at most k (= 5) ranked result rows, so the
per-query ``collect_list`` holds a bounded number of short blocks.
"""

from __future__ import annotations

from typing import Optional

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import py_strip
from ..functions.shape import DESC_CUT_LINE, UNKNOWN, truncate_text

# Prompt and answer texts (must equal the reference's wording).
PROMPT_HEADER = (
    'You are a knowledgeable gaming expert. A user is searching for games with the query: "{query}"\n'
    "\n"
    "I found {n} relevant games for them. Please provide intelligent recommendations explaining WHY each game "
    "matches their search, focusing on the reasoning rather than just listing facts.\n"
    "\n"
    "For each game, provide:\n"
    "1. The game title and year\n"
    "2. A thoughtful explanation of WHY this game matches their search query\n"
    "3. Focus on what makes this game special or relevant to what they're looking for\n"
    "\n"
    "Be insightful and explain the connection between their search intent and each game. Don't just repeat "
    "game descriptions - provide intelligent analysis.\n"
    "\n"
    "Here are the games:\n"
)
PROMPT_BLOCK = "\n{i}. **{title}** ({year})\n   Genres: {genres}\n   Description: {description}\n"
PROMPT_FOOTER = (
    "\n"
    "Please provide your recommendations in this format:\n"
    "\n"
    "Based on your query, I found X highly relevant games:\n"
    "\n"
    "1. **Game Title** (Year)\n"
    "   🎯 **Why I recommend it**: [Intelligent reasoning about why this matches their search]\n"
    "\n"
    "2. **Game Title** (Year)  \n"
    "   🎯 **Why I recommend it**: [Intelligent reasoning about why this matches their search]\n"
    "\n"
    "Continue for all games...\n"
    "\n"
    "IMPORTANT: Be concise and stop after listing all games. Do not repeat yourself or add extra explanations.\n"
)
ANSWER_HEADER = "Based on your query, I found {n} highly relevant games:\n\n"
ANSWER_ENTRY = ("{i}. **{title}** ({year})\n"
                "   🎯 **Why I recommend it**: This game appears relevant to your search for '{query}' "
                "based on its content and features.\n\n")
EMPTY_ANSWER = "I couldn't find any games matching your search for '{query}'."
SENTENCE_SEP = ". "
# Where the analysis part of an answer starts (earliest match wins),
# the trailing note removed first, and the parts of a recommendation section.
ANY_LINE_CHAR = r"[^\n\r\x{2028}\x{2029}]"
ANALYSIS_PATTERNS = (
    r"(?i)Based on your query",
    r"(?i)Here are the games",
    r"(?i)I found \d+ games",
    r"(?m)^\d+\. \*\*" + ANY_LINE_CHAR + r"*?\*\* \(",
    r"(?i)Recommendations:",
)
TRAILING_NOTE = r"I applied filters:" + ANY_LINE_CHAR + r"*?\. These are ranked by relevance\.?\z"
THINKING_MIN_CHARS = 50
SECTION_SEP = "\n\n"
INTRO_PREFIX = "Based on your query"
GAME_SECTION = (r"^(\d+)\. \*\*(" + ANY_LINE_CHAR + r"*?)\*\* \(([^)]+)\)\s*(" + ANY_LINE_CHAR + r"*)")
GAME_TEST = r"^\d+\. \*\*" + ANY_LINE_CHAR + r"*?\*\* \(" + ANY_LINE_CHAR + r"*?\)"
REASON = r"🎯 \*\*Why I recommend it\*\*: (" + ANY_LINE_CHAR + r"*)"


def _fmt(template: str, **cols: Column) -> Column:
    """Fill ``{name}`` slots of a fixed template with columns."""
    parts, rest = [], template
    while "{" in rest:
        pre, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        if pre:
            parts.append(F.lit(pre))
        parts.append(cols[name].cast("string"))
        if not rest:
            break
    if rest and "{" not in rest:
        parts.append(F.lit(rest))
    return F.concat(*parts)


def year_of(release_date: Column) -> Column:
    """Year shown in prompts: part before '-' of the ISO date; none -> Unknown."""
    s = F.date_format(release_date, "yyyy-MM-dd")
    return F.when(s.isNull() | (s == ""), F.lit(UNKNOWN)).otherwise(F.substring_index(s, "-", 1))


def rag_context(results: DataFrame) -> DataFrame:
    """rank, title, year, genres, description per query."""
    return results.select("query_id", "rank", F.coalesce("title", F.lit(UNKNOWN)).alias("title"),
                          year_of(F.col("release_date").cast("date")).alias("year"), "genres",
                          F.coalesce("description", F.lit("")).alias("description"))


def _per_query(ctx: DataFrame, block: Column, name: str) -> DataFrame:
    blocks = ctx.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(F.struct(F.col("rank"), block.alias("b")))).alias("_bs"))
    return blocks.select("query_id", "n", F.array_join(F.transform("_bs", lambda x: x["b"]), "").alias(name))


def rag_prompt(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Prompt text per query that has results: header, one block per item
    (genres joined or 'Unknown', description cut to 300), format footer."""
    ctx = rag_context(results)
    genres = F.when(F.coalesce(F.size("genres"), F.lit(0)) > 0, F.array_join("genres", ", ")).otherwise(F.lit(UNKNOWN))
    block = _fmt(PROMPT_BLOCK, i=F.col("rank"), title=F.col("title"), year=F.col("year"), genres=genres,
                 description=truncate_text(F.col("description"), DESC_CUT_LINE))
    per = _per_query(ctx, block, "blocks")
    j = per.join(queries.select("query_id", "text"), "query_id")
    head = _fmt(PROMPT_HEADER, query=F.col("text"), n=F.col("n"))
    return j.select("query_id", F.concat(head, F.col("blocks"), F.lit(PROMPT_FOOTER)).alias("prompt"))


def rag_fallback_answer(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Template answer per query with results."""
    ctx = rag_context(results).join(queries.select("query_id", F.col("text").alias("q_text")), "query_id")
    entry = _fmt(ANSWER_ENTRY, i=F.col("rank"), title=F.col("title"), year=F.col("year"), query=F.col("q_text"))
    per = _per_query(ctx, entry, "entries")
    return per.select("query_id", "n", F.concat(_fmt(ANSWER_HEADER, n=F.col("n")), F.col("entries")).alias("answer"))


def rag_answers(queries: DataFrame, results: DataFrame, generator=None) -> DataFrame:
    """Answer per query: generated (with template fallback) when the query
    has results, the empty-result sentence otherwise (left join from the
    queries, so every query gets a row)."""
    from ..operators.models import generate_answers_batch
    fb = rag_fallback_answer(queries, results)
    if generator is not None:
        pr = rag_prompt(queries, results)
        fb = generate_answers_batch(fb.join(pr, "query_id"), "answer", "prompt", generator, "generated") \
            .select("query_id", "n", F.col("generated").alias("answer"))
    q = queries.select("query_id", "text")
    j = q.join(fb, "query_id", "left")
    empty = _fmt(EMPTY_ANSWER, query=F.col("text"))
    return j.select("query_id", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n_games"),
                    F.when(F.col("n").isNull(), empty).otherwise(F.col("answer")).alias("response"))


def drop_repeated_sentences(text: Column) -> Column:
    """Split on '. ', drop a part equal to the one before it, join again."""
    # The parts are a lambda's variable: the text is split once, and not again for every part.
    once = F.array(F.split(text, r"\. "))
    kept = F.transform(once, lambda parts: F.filter(parts, lambda x, i: (i == 0) | (x != F.get(parts, i - 1))))
    return F.array_join(F.get(kept, 0), SENTENCE_SEP)


def _pre_match_len(text: Column, pattern: str) -> Column:
    """Characters before the first match of ``pattern``, NULL if none."""
    return F.when(text.rlike(pattern), F.length(F.get(F.split(text, pattern, 2), 0)))


def split_reasoning(text: Column) -> Column:
    """struct(thinking, analysis): the trailing filter note is removed, the
    earliest analysis pattern splits the text; the part before it counts as
    thinking only if longer than 50 characters (else thinking is NULL and
    the whole text is the analysis)."""
    clean = F.regexp_replace(text, TRAILING_NOTE, "")
    idx = F.least(*[_pre_match_len(clean, p) for p in ANALYSIS_PATTERNS])
    thinking = py_strip(F.substring(clean, F.lit(1), idx))
    analysis = py_strip(F.substring(clean, idx + 1, F.length(clean) + 1))
    has = idx.isNotNull() & (F.length(thinking) > THINKING_MIN_CHARS)
    return F.struct(F.when(has, thinking).alias("thinking"), F.when(has, analysis).otherwise(clean).alias("analysis"))


def parse_recommendations(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per non-blank section of an answer: kind intro / game / other,
    and for games the number, title, year and reason."""
    secs = F.filter(F.split(F.col(text_col), SECTION_SEP), lambda s: py_strip(s) != "")
    ex = df.select(id_col, F.posexplode(secs).alias("pos", "sec")).withColumn("sec", py_strip(F.col("sec")))
    is_intro = F.startswith(F.col("sec"), F.lit(INTRO_PREFIX))
    is_game = F.col("sec").rlike(GAME_TEST)
    rest = F.regexp_extract("sec", GAME_SECTION, 4)
    reason = F.when(rest.rlike(REASON), F.regexp_extract(rest, REASON, 1)).otherwise(rest)
    kind = F.when(is_intro, "intro").when(is_game, "game").otherwise("other")
    return ex.select(
        id_col, (F.col("pos") + 1).cast("int").alias("pos"), kind.alias("kind"),
        F.when(kind == "game", F.regexp_extract("sec", GAME_SECTION, 1).cast("int")).alias("number"),
        F.when(kind == "game", F.regexp_extract("sec", GAME_SECTION, 2)).alias("title"),
        F.when(kind == "game", F.regexp_extract("sec", GAME_SECTION, 3)).alias("year"),
        F.when(kind == "game", reason).otherwise(F.col("sec")).alias("text"))


def answer_texts(results_answers: DataFrame, id_col: str = "query_id", text_col: str = "response",
                 preface: Optional[Column] = None) -> DataFrame:
    """Attach an optional reasoning preface in front of answers."""
    t = F.col(text_col) if preface is None else F.concat(preface, F.lit("\n\n"), F.col(text_col))
    return results_answers.select(id_col, t.alias(text_col))
