"""Result-shaping expressions (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import py_strip

# Text lengths, labels and defaults of the result records.
DESC_CUT_LINE = 300        # text summary line and prompt
DESC_CUT_CARD = 200        # card
DESC_CUT_BROWSER = 150     # browser card
ELLIPSIS = "..."
UNKNOWN = "Unknown"
NOT_AVAILABLE = "N/A"
SCORE_BANDS = (("high", 8.0), ("medium", 6.0))   # >= 8 high, >= 6 medium, else low
CRITIC_LABEL = "Critic "
SCREENSHOTS_BROWSER = 10
SCREENSHOTS_DETAIL = 5
REVIEWS_DETAIL = 3
FACETS_CLIENT = 3


def date_str(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def release_year(c: Column) -> Column:
    """Year shown on cards from a date or date-like string.

    '-' in it -> part before the first '-'; '/' -> third part if non-empty,
    else the first; otherwise the first four characters; NULL/'' -> Unknown.
    """
    s = c.cast("string")
    third = F.get(F.split(s, "/"), 2)
    return (F.when(s.isNull() | (s == ""), F.lit(UNKNOWN))
             .when(F.contains(s, F.lit("-")), F.substring_index(s, "-", 1))
             .when(F.contains(s, F.lit("/")),
                   F.when(F.coalesce(third, F.lit("")) != "", third)
                    .otherwise(F.substring_index(s, "/", 1)))
             .otherwise(F.substring(s, 1, 4)))


def score_band(score: Column) -> Column:
    """high / medium / low; NULL or <= 0 -> NULL (no band)."""
    (hi, hi_min), (mid, mid_min) = SCORE_BANDS
    return (F.when(score.isNull() | (score <= 0), F.lit(None).cast("string"))
             .when(score >= hi_min, F.lit(hi))
             .when(score >= mid_min, F.lit(mid))
             .otherwise(F.lit("low")))


def truncate_text(c: Column, n: int) -> Column:
    """First n characters plus '...' when longer; NULL -> ''."""
    s = F.coalesce(c, F.lit(""))
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit(ELLIPSIS))).otherwise(s)


def join_list_default(c: Column, sep: str = ", ") -> Column:
    """', '.join(list); empty or missing -> 'Unknown'."""
    return F.when(F.coalesce(F.size(c), F.lit(-1)) > 0, F.array_join(c, sep)).otherwise(F.lit(UNKNOWN))


def slice_assets(c: Column, n: int) -> Column:
    return F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, n)


def fmt3(x: Column) -> Column:
    return F.call_function("format_number", x, F.lit("0.000"))


def format_result_line(title: Column, release_date: Column, score: Column, platforms: Column,
                       genres: Column, relevance: Column, description: Column) -> Column:
    """Multi-line text summary of one result.

    Relevance is shown (3 decimals) only when truthy; the description only
    when non-empty, cut to 300 characters.
    """
    year = F.when(release_date.isNull(), F.lit(UNKNOWN)).otherwise(F.year(release_date).cast("string"))
    score_txt = F.coalesce(score.cast("string"), F.lit("None"))
    lines = [
        F.concat(F.lit("🎮 "), F.coalesce(title, F.lit(UNKNOWN)), F.lit(" ("), year, F.lit(")\n")),
        F.concat(F.lit("📊 Score: "), score_txt, F.lit("/10\n")),
        F.concat(F.lit("🖥️ Platforms: "), F.array_join(F.coalesce(platforms, F.array()), ", "), F.lit("\n")),
        F.concat(F.lit("🎯 Genres: "), F.array_join(F.coalesce(genres, F.array()), ", "), F.lit("\n")),
        F.when(F.coalesce(relevance, F.lit(0.0)) != 0,
               F.concat(F.lit("🔍 Relevance: "), fmt3(relevance), F.lit("\n"))).otherwise(F.lit("")),
        F.when(F.coalesce(description, F.lit("")) != "",
               F.concat(F.lit("📝 "), truncate_text(description, DESC_CUT_LINE), F.lit("\n"))).otherwise(F.lit("")),
    ]
    return F.concat(*lines)


def display_score(relevance: Column, similarity: Column, score: Column) -> Column:
    """First truthy of relevance, similarity, catalogue score, 2 decimals; else N/A."""
    first = F.coalesce(F.nullif(relevance, F.lit(0.0)), F.nullif(similarity, F.lit(0.0)),
                       F.nullif(score, F.lit(0.0)))
    return F.when(first.isNull(), F.lit(NOT_AVAILABLE)).otherwise(F.call_function("format_number", first, F.lit("0.00")))


def review_objects(citations: Column) -> Column:
    """Array of citations -> array<struct<source, score, review>>.

    Blank or NULL entries are dropped but the 1-based position of the others
    is kept in the 'Critic i' label.
    """
    arr = F.coalesce(citations, F.array().cast("array<string>"))
    tagged = F.transform(arr, lambda x, i: F.struct(
        F.concat(F.lit(CRITIC_LABEL), (i + 1).cast("string")).alias("source"),
        F.lit("").alias("score"),
        py_strip(x).alias("review")))
    return F.filter(tagged, lambda s: s["review"].isNotNull() & (s["review"] != ""))
