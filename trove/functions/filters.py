"""Search filters as Column predicates.

Two forms: a ``Filters`` value folded into one predicate (one request), and
``batch_predicate`` which reads the filter values from columns of a queries
DataFrame already joined to the items (many requests in one job). A NULL
filter value means "no filter" in both forms; Catalyst folds the literal
form away, and the batch form stays a cheap row-level predicate after the
equi-join on item id.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Optional, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def filter_platform(platforms: Column, value) -> Column:
    """``value = ANY(platforms)``; case-sensitive exact."""
    return F.coalesce(F.array_contains(platforms, value), F.lit(False))


def filter_genre(genres: Column, value) -> Column:
    return F.coalesce(F.array_contains(genres, value), F.lit(False))


def filter_any_of(arr: Column, values: Sequence[str]) -> Column:
    """At least one of ``values`` is in ``arr``."""
    lit = F.array(*[F.lit(v) for v in values])
    return F.coalesce(F.arrays_overlap(arr, lit), F.lit(False))


def filter_min_score(score: Column, min_score, scored_only) -> Column:
    """score >= s, or NULL scores too unless ``scored_only``.

    With no minimum and ``scored_only`` the score must be present.
    ``min_score`` and ``scored_only`` may be Python values or Columns.
    """
    s = min_score if isinstance(min_score, Column) else F.lit(min_score).cast("double")
    so = scored_only if isinstance(scored_only, Column) else F.lit(bool(scored_only))
    so = F.coalesce(so, F.lit(False))
    return (F.when(s.isNull(), ~so | score.isNotNull())
             .otherwise(F.coalesce(score >= s, F.lit(False)) | (~so & score.isNull())))


def filter_min_year(release_date: Column, min_year) -> Column:
    """Release year >= y. Written as a bare date comparison (no coalesce) so
    Catalyst can push it into the Parquet scan and min/max statistics can
    prune; NULL dates give NULL, which a WHERE drops."""
    y = min_year if isinstance(min_year, Column) else F.lit(min_year)
    if not isinstance(min_year, Column):
        import datetime as _dt
        return release_date >= F.lit(_dt.date(int(min_year), 1, 1))
    return release_date >= F.make_date(y.cast("int"), F.lit(1), F.lit(1))


def like_escape(q: Column) -> Column:
    """Escape LIKE wildcards so the query matches literally."""
    return F.regexp_replace(q, r"([\\%_])", r"\\$1")


def filter_keyword(title: Column, description: Column, query, wildcards: bool = False) -> Column:
    """Case-insensitive substring match on title or description.

    Default: literal match. ``wildcards=True`` lets '%' and '_' in the query
    act as LIKE wildcards, as the plain ``LIKE '%q%'`` form does.
    """
    q = query if isinstance(query, Column) else F.lit(query)
    return has_keyword(F.lower(title), F.lower(description), F.lower(q), wildcards)


def has_keyword(title: Column, description: Column, query: Column, wildcards: bool = False) -> Column:
    """``filter_keyword`` on texts and a query that are lower-case already."""
    if wildcards:
        pat = F.concat(F.lit("%"), query, F.lit("%"))
        hit_t = F.like(title, pat)
        hit_d = F.like(description, pat)
    else:
        hit_t = F.contains(title, query)
        hit_d = F.contains(description, query)
    return F.coalesce(hit_t, F.lit(False)) | F.coalesce(hit_d, F.lit(False))


def filter_not_null(c: Column) -> Column:
    return c.isNotNull()


@dataclass(frozen=True)
class Filters:
    platform: Optional[str] = None
    genre: Optional[str] = None
    min_score: Optional[float] = None
    min_year: Optional[int] = None
    scored_only: bool = False
    platforms_any: Sequence[str] = field(default_factory=tuple)
    genres_any: Sequence[str] = field(default_factory=tuple)

    def predicate(self, prefix: str = "") -> Column:
        """Conjunction of the filters that are set (compose_filters)."""
        col = lambda n: F.col(f"{prefix}{n}")
        preds = []
        if self.platform:
            preds.append(filter_platform(col("platforms"), self.platform))
        if self.min_score is not None or self.scored_only:
            preds.append(filter_min_score(col("score"), self.min_score, self.scored_only))
        if self.genre:
            preds.append(filter_genre(col("genres"), self.genre))
        if self.min_year:
            preds.append(filter_min_year(col("release_date"), self.min_year))
        if self.platforms_any:
            preds.append(filter_any_of(col("platforms"), self.platforms_any))
        if self.genres_any:
            preds.append(filter_any_of(col("genres"), self.genres_any))
        out = F.lit(True)
        for p in preds:
            out = out & p
        return out

    def as_columns(self) -> list[Column]:
        """The filter values as literal columns (to attach to a queries table)."""
        return [F.lit(self.platform).cast("string").alias("platform"),
                F.lit(self.genre).cast("string").alias("genre"),
                F.lit(self.min_score).cast("double").alias("min_score"),
                F.lit(self.min_year).cast("int").alias("min_year"),
                F.lit(bool(self.scored_only)).alias("scored_only")]


FILTER_COLUMNS = ("platform", "genre", "min_score", "min_year", "scored_only")


def batch_predicate(q: str = "q_", i: str = "") -> Column:
    """Per-row predicate reading filter values from query columns.

    ``q`` / ``i`` are column-name prefixes of the query and item sides after
    the join. Unset (NULL / '' / 0 year) values mean no filter.
    """
    qc = lambda n: F.col(f"{q}{n}")
    ic = lambda n: F.col(f"{i}{n}")
    plat = F.nullif(qc("platform"), F.lit(""))
    gen = F.nullif(qc("genre"), F.lit(""))
    year = F.nullif(qc("min_year"), F.lit(0))
    return ((plat.isNull() | filter_platform(ic("platforms"), plat))
            & filter_min_score(ic("score"), qc("min_score"), qc("scored_only"))
            & (gen.isNull() | filter_genre(ic("genres"), gen))
            & (year.isNull() | filter_min_year(ic("release_date"), year)))
