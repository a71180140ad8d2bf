"""Registered ingest, table-maintenance and verification queries, each next
to its DuckDB oracle.

The JSON-lines inputs are derived by Spark from the driver tables (one
catalogue line per document, a later corrected line per labelled document,
raw HTML pages as broken lines; one review line per conversation turn, blank
and malformed lines from labels and pages), so every query's work grows
with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import shape as S
from .operators import tables as TB
from .operators import verify as V
from .oracle import SQL, q, with_body
from .registry import list_str, register
from .sources import fixtures as fx
from .sources import jsonl as J

WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
NEW_ID_BASE = 1_000_000_000     # ids of catalogue entries that are new to the target


# ------------------------------------------------------------ derived lines

def catalogue_lines(spark, d) -> DataFrame:
    i = fx.items(spark, d)
    pages = fx.side(spark, d, "pages", "page_id", "html").select(F.col("page_id").alias("item_id"), "html")
    labels = fx.side(spark, d, "labels", "doc_id").select(F.col("doc_id").alias("item_id"), F.lit(True).alias("lab"))
    j = i.join(pages, "item_id", "left").join(labels, "item_id", "left")
    date = F.when(F.col("cover_url").isNotNull(), F.date_format("release_date", "MM/dd/yyyy")) \
            .otherwise(F.date_format("release_date", "yyyy-MM-dd"))

    def rec(title: F.Column) -> F.Column:
        return F.to_json(F.struct(
            F.col("item_id").alias("id"), title.alias("title"),
            F.coalesce("html", "description").alias("description"), date.alias("release_date"),
            F.when(F.col("lab"), F.col("score").cast("string")).otherwise(F.lit("")).alias("moby_score"),
            F.col("source_url").alias("moby_url"), "platforms", "genres",
            F.get(F.col("developers"), 0).alias("developers"), "publishers",
            F.col("cover_url").alias("sample_cover_url"), F.col("screenshot_urls").alias("sample_screenshot_urls")))

    first = j.select((F.col("item_id") * 3).alias("line_no"),
                     rec(F.concat(F.lit(" "), F.col("title"), F.lit(" "))).alias("value"))
    again = j.where(F.col("lab")).select((F.col("item_id") * 3 + 1).alias("line_no"),
                                         rec(F.concat(F.lit(" v2 "), F.col("title"))).alias("value"))
    junk = pages.select((F.col("item_id") * 3 + 2).alias("line_no"), F.col("html").alias("value"))
    return first.unionByName(again).unionByName(junk)


CAT_LINES_SQL = """
cat_src AS (
  SELECT i.*, pg.html, lb.doc_id IS NOT NULL AS lab,
         CASE WHEN i.cover_url IS NOT NULL THEN strftime(i.release_date, '%m/%d/%Y')
              ELSE strftime(i.release_date, '%Y-%m-%d') END AS rd
  FROM items i LEFT JOIN pages pg ON pg.page_id = i.item_id LEFT JOIN labels lb ON lb.doc_id = i.item_id),
cat_lines AS (
  SELECT item_id * 3 AS line_no, CAST(json_object('id', item_id, 'title', ' ' || title || ' ',
         'description', coalesce(html, description), 'release_date', rd,
         'moby_score', CASE WHEN lab THEN CAST(score AS VARCHAR) ELSE '' END, 'moby_url', source_url,
         'platforms', platforms, 'genres', genres, 'developers', developers[1], 'publishers', publishers,
         'sample_cover_url', cover_url, 'sample_screenshot_urls', screenshot_urls) AS VARCHAR) AS value FROM cat_src
  UNION ALL
  SELECT item_id * 3 + 1, CAST(json_object('id', item_id, 'title', ' v2 ' || title,
         'description', coalesce(html, description), 'release_date', rd,
         'moby_score', CASE WHEN lab THEN CAST(score AS VARCHAR) ELSE '' END, 'moby_url', source_url,
         'platforms', platforms, 'genres', genres, 'developers', developers[1], 'publishers', publishers,
         'sample_cover_url', cover_url, 'sample_screenshot_urls', screenshot_urls) AS VARCHAR) FROM cat_src WHERE lab
  UNION ALL
  SELECT page_id * 3 + 2, html FROM pages),
cat_ok AS (
  SELECT line_no, value, TRY_CAST(json_extract(value, '$.id') AS BIGINT) AS id FROM cat_lines
  WHERE json_valid(value)),
cat_rec AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line_no DESC) AS rn FROM cat_ok
                 WHERE id IS NOT NULL AND id <> 0) WHERE rn = 1)"""


def _sl(path: str) -> str:
    """safe_list of a JSON field that may be a list, a scalar or missing."""
    return (f"list_filter(list_transform(CASE WHEN json_type(value, '{path}') = 'ARRAY' "
            f"THEN CAST(json_extract_string(value, '{path}[*]') AS VARCHAR[]) "
            f"WHEN json_extract_string(value, '{path}') IS NOT NULL THEN [json_extract_string(value, '{path}')] "
            f"ELSE []::VARCHAR[] END, lambda x: trim(x, {WS})), lambda x: x IS NOT NULL AND x <> '')")


def _records(spark, d):
    return J.read_catalogue_jsonl(catalogue_lines(spark, d))


@register("read_catalogue_jsonl")
def q_read_catalogue_jsonl(spark, d):
    rec, _ = _records(spark, d)
    return rec.select("id", "title", "release_date", "moby_score", list_str(F.col("developers")).alias("developers"),
                      list_str(F.col("platforms")).alias("platforms"),
                      list_str(F.col("sample_screenshot_urls")).alias("screenshots"))


SQL["read_catalogue_jsonl"] = q(CAT_LINES_SQL + f"""
SELECT id, json_extract_string(value, '$.title') AS title, json_extract_string(value, '$.release_date') AS release_date,
       json_extract_string(value, '$.moby_score') AS moby_score, array_to_string({_sl('$.developers')}, ', ') AS developers,
       array_to_string({_sl('$.platforms')}, ', ') AS platforms,
       array_to_string(CASE WHEN json_type(value, '$.sample_screenshot_urls') = 'ARRAY'
                       THEN CAST(json_extract_string(value, '$.sample_screenshot_urls[*]') AS VARCHAR[]) END, ', ') AS screenshots
FROM cat_rec""")


@register("count_input_lines")
def q_count_input_lines(spark, d):
    return J.count_input_lines(catalogue_lines(spark, d))


SQL["count_input_lines"] = q(CAT_LINES_SQL + f"""
SELECT CAST(count(*) AS BIGINT) AS lines, CAST(count_if(trim(value, {WS}) <> '') AS BIGINT) AS non_blank FROM cat_lines""")


@register("check_primary_key")
def q_check_primary_key(spark, d):
    lines = catalogue_lines(spark, d)
    ids = J._parsed(lines, ("id",)).where("_ok").select(F.col("_r.id").try_cast("bigint").alias("id")) \
        .where("id IS NOT NULL")
    return V.check_primary_key(ids, "id")


SQL["check_primary_key"] = q(CAT_LINES_SQL + """
SELECT id, CAST(count(*) AS BIGINT) AS count FROM cat_ok WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1""")


PREP_SQL = r"""
prep AS (
  SELECT id AS item_id, trim(coalesce(json_extract_string(value, '$.title'), ''), {ws}) AS title,
         coalesce(regexp_replace(regexp_replace(json_extract_string(value, '$.description'), '<[^\n]*?>', '', 'g'),
                                 '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g'), '') AS description,
         coalesce(try_strptime(trim(json_extract_string(value, '$.release_date')), '%Y-%m-%d'),
                  try_strptime(trim(json_extract_string(value, '$.release_date')), '%Y'),
                  try_strptime(trim(json_extract_string(value, '$.release_date')), '%m/%d/%Y'),
                  try_strptime(trim(json_extract_string(value, '$.release_date')), '%d/%m/%Y')) AS release_date,
         TRY_CAST(nullif(trim(json_extract_string(value, '$.moby_score')), '') AS DOUBLE) AS score,
         {dev} AS developers, {plat} AS platforms,
         nullif(json_extract_string(value, '$.sample_cover_url'), '') AS cover_url,
         CASE WHEN json_type(value, '$.sample_screenshot_urls') = 'ARRAY'
              THEN CAST(json_extract_string(value, '$.sample_screenshot_urls[*]') AS VARCHAR[]) END AS screenshot_urls
  FROM cat_rec)"""


def _prep_sql() -> str:
    return PREP_SQL.replace("{ws}", WS).replace("{dev}", _sl("$.developers")).replace("{plat}", _sl("$.platforms"))


def _prepared(spark, d):
    rec, _ = _records(spark, d)
    return J.prepare_items(rec)


@register("prepare_items")
def q_prepare_items(spark, d):
    p = _prepared(spark, d)
    return p.select("item_id", "title", F.md5("description").alias("description_md5"),
                    S.date_str(F.col("release_date")).alias("release_date"), "score",
                    list_str(F.col("developers")).alias("developers"), list_str(F.col("platforms")).alias("platforms"),
                    "cover_url", list_str(F.col("screenshot_urls")).alias("screenshots"))


SQL["prepare_items"] = q(CAT_LINES_SQL + "," + _prep_sql() + """
SELECT item_id, title, md5(description) AS description_md5, strftime(release_date, '%Y-%m-%d') AS release_date, score,
       array_to_string(developers, ', ') AS developers, array_to_string(platforms, ', ') AS platforms, cover_url,
       array_to_string(screenshot_urls, ', ') AS screenshots FROM prep""")


@register("enforce_schema")
def q_enforce_schema(spark, d):
    ok, bad = V.enforce_schema(_prepared(spark, d), V.ITEMS_SCHEMA)
    return ok.select("item_id", "title", S.date_str(F.col("release_date")).alias("release_date"), "score",
                     F.col("created_at").isNotNull().alias("has_created_at"))


SQL["enforce_schema"] = q(CAT_LINES_SQL + "," + _prep_sql() + """
SELECT item_id, title, strftime(release_date, '%Y-%m-%d') AS release_date, score, true AS has_created_at
FROM prep WHERE item_id IS NOT NULL AND title IS NOT NULL""")


@register("index_semi_assets")
def q_index_semi_assets(spark, d):
    rec, _ = _records(spark, d)
    folders = fx.table(spark, d, "pages").select(F.col("page_id").alias("id"))
    return rec.join(folders, "id", "left_semi").select("id")


SQL["index_semi_assets"] = q(CAT_LINES_SQL + """
SELECT id FROM cat_rec WHERE id IN (SELECT page_id FROM pages)""")


def review_lines(spark, d) -> DataFrame:
    c = fx.table(spark, d, "conversations")
    rid = (c.conv_id * 100 + c.turn).cast("string")
    # 'system' turns carry a review id that is not an integer (a failed row).
    rid_json = F.when(c.role == "system", F.to_json(F.array(F.concat(F.lit("R-"), rid))).substr(F.lit(2), F.length(rid) + 4)) \
                .otherwise(rid)
    rid_json = F.regexp_replace(rid_json, r"\]$", "")
    good = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("line_no"), F.to_json(F.struct(
        F.parse_json(rid_json).alias("review_id"), F.col("conv_id").alias("game_id"),
        F.col("text").alias("citation"))).alias("value"))
    blank = fx.table(spark, d, "labels").select(F.col("doc_id").alias("line_no"), F.lit("  ").alias("value"))
    junk = fx.table(spark, d, "pages").select(F.col("page_id").alias("line_no"), F.col("html").alias("value"))
    return good.unionByName(blank).unionByName(junk).unionByName(typed_id_lines(spark, d))


#: Forms of an id in JSON, with N for a number of its own.
ID_FORMS = ['"N.0"', 'N.9', 'true', '"1_N"', '[]', '[N]', '{}', '" N "', '"+N"', '0.0', '"0"', '1.5e2', '99999999999999999999', 'null',
            '{"a":N}', '0.5', '-7.9', '"abc"', '""', 'false', '"1__0"', '-N', '12345678901.25', '0', '"-N"', '[ ]']


def typed_id_lines(spark, d) -> DataFrame:
    """A review line per document whose id has one of the forms, as the
    review's or (every third) the game's."""
    k = F.col("doc_id")
    form = F.replace(F.get(F.array(*[F.lit(f) for f in ID_FORMS]), (k % len(ID_FORMS)).cast("int")), F.lit("N"), (k + 7).cast("string"))
    rid, gid = F.when(k % 3 == 0, (k + 1).cast("string")).otherwise(form), F.when(k % 3 == 0, form).otherwise((k + 1).cast("string"))
    return fx.table(spark, d, "documents").where(k.isNotNull()).select(k.alias("line_no"), F.concat(
        F.lit('{"review_id": '), rid, F.lit(', "game_id": '), gid, F.lit(', "citation": "typed"}')).alias("value"))


def _py_int_sql(field: str) -> tuple[str, str]:
    """(falsy, integer) of a JSON field in SQL, by its JSON type."""
    kind, text = f"json_type(value, '$.{field}')", f"json_extract_string(value, '$.{field}')"
    bare = f"trim({text}, {WS})"
    falsy = f"""CASE WHEN {kind} IS NULL OR {kind} = 'NULL' THEN true WHEN {kind} = 'VARCHAR' THEN {text} = ''
              WHEN {kind} = 'BOOLEAN' THEN {text} = 'false' WHEN {kind} IN ('BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE') THEN CAST({text} AS DOUBLE) = 0
              ELSE regexp_full_match({text}, '[\\[{{]\\s*[\\]}}]') END"""
    whole = f"""CASE WHEN {kind} = 'BOOLEAN' THEN CASE WHEN {text} = 'true' THEN 1 ELSE 0 END
              WHEN {kind} = 'VARCHAR' THEN CASE WHEN regexp_full_match({bare}, '[+-]?[0-9]+(_[0-9]+)*') THEN TRY_CAST(replace({bare}, '_', '') AS BIGINT) END
              WHEN {kind} IN ('BIGINT', 'UBIGINT', 'HUGEINT') THEN TRY_CAST({text} AS BIGINT)
              WHEN {kind} = 'DOUBLE' THEN CASE WHEN abs(CAST({text} AS DOUBLE)) < 9223372036854775808 THEN TRY_CAST(trunc(CAST({text} AS DOUBLE)) AS BIGINT) END END"""
    return falsy, whole


_RID, _GID = _py_int_sql("review_id"), _py_int_sql("game_id")
_FORMS_SQL = "[" + ", ".join("'" + f + "'" for f in ID_FORMS) + "]"
REV_LINES_SQL = f"""
forms AS (
  SELECT doc_id AS k, replace({_FORMS_SQL}[1 + doc_id % {len(ID_FORMS)}], 'N', CAST(doc_id + 7 AS VARCHAR)) AS f FROM documents WHERE doc_id IS NOT NULL),
rev_lines AS (
  SELECT CAST(json_object('review_id', CASE WHEN role = 'system' THEN to_json('R-' || CAST(conv_id * 100 + turn AS VARCHAR))
                                       ELSE to_json(conv_id * 100 + turn) END,
                     'game_id', conv_id, 'citation', text) AS VARCHAR) AS value FROM conversations
  UNION ALL SELECT '  ' FROM labels
  UNION ALL SELECT html FROM pages
  UNION ALL SELECT '{{"review_id": ' || CASE WHEN k % 3 = 0 THEN CAST(k + 1 AS VARCHAR) ELSE f END || ', "game_id": ' ||
                   CASE WHEN k % 3 = 0 THEN f ELSE CAST(k + 1 AS VARCHAR) END || ', "citation": "typed"}}' FROM forms),
rev_valid AS (SELECT value, json_valid(trim(value, {WS})) AS ok FROM rev_lines WHERE trim(value, {WS}) <> ''),
rev_good AS MATERIALIZED (SELECT value FROM rev_valid WHERE ok),
rev_parsed AS (
  SELECT value, false AS ok, NULL::BOOLEAN AS no_rid, NULL::BOOLEAN AS no_gid, NULL::BIGINT AS review_id, NULL::BIGINT AS item_id, '' AS cit
  FROM rev_valid WHERE NOT ok
  UNION ALL
  SELECT value, true, {_RID[0]}, {_GID[0]}, {_RID[1]}, {_GID[1]},
         coalesce(regexp_replace(regexp_replace(json_extract_string(value, '$.citation'), '<[^\\n]*?>', '', 'g'),
                                 '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g'), '')
  FROM rev_good),
rev_out AS (
  SELECT *, CASE WHEN NOT ok THEN 'bad_json' WHEN no_rid OR no_gid OR cit = '' THEN 'missing_field'
                 WHEN review_id IS NULL OR item_id IS NULL THEN 'bad_int' END AS reason
  FROM rev_parsed),
rev_res AS (SELECT *, CASE WHEN reason IS NULL THEN 'accepted' WHEN reason = 'bad_int' THEN 'failed'
                           ELSE 'skipped' END AS outcome FROM rev_out)"""


@register("read_reviews_jsonl")
def q_read_reviews_jsonl(spark, d):
    r = J.read_reviews_jsonl(review_lines(spark, d))
    return r.where(F.col("outcome") == "accepted").select("review_id", "item_id", F.md5("citation").alias("citation_md5"))


SQL["read_reviews_jsonl"] = q(REV_LINES_SQL + """
SELECT review_id, item_id, md5(cit) AS citation_md5 FROM rev_res WHERE outcome = 'accepted'""")


@register("ingest_outcome_stats")
def q_ingest_outcome_stats(spark, d):
    return V.ingest_outcome_stats(J.read_reviews_jsonl(review_lines(spark, d)))


SQL["ingest_outcome_stats"] = q(REV_LINES_SQL + """
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count_if(outcome <> 'skipped') AS BIGINT) AS processed,
       CAST(count_if(outcome = 'accepted') AS BIGINT) AS successful, CAST(count_if(outcome = 'failed') AS BIGINT) AS failed,
       CAST(count_if(outcome = 'skipped') AS BIGINT) AS skipped,
       round(count_if(outcome = 'accepted') * 100.0 / count(*), 1) AS success_pct FROM rev_res""")


def patch_lines(spark, d) -> DataFrame:
    pages = fx.table(spark, d, "pages")
    full = pages.select((F.col("page_id") * 2).alias("line_no"), F.to_json(F.struct(
        F.col("page_id").alias("id"), F.col("url").alias("sample_cover_url"),
        F.array("url").alias("sample_screenshot_urls"))).alias("value"))
    one = fx.table(spark, d, "labels").select((F.col("doc_id") * 2 + 1).alias("line_no"), F.to_json(F.struct(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("https://cdn.example/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("sample_cover_url")
    )).alias("value"))
    return full.unionByName(one)


PATCH_SQL = """
patch_lines AS (
  SELECT page_id * 2 AS line_no, CAST(json_object('id', page_id, 'sample_cover_url', url, 'sample_screenshot_urls', [url]) AS VARCHAR) AS value
  FROM pages
  UNION ALL
  SELECT doc_id * 2 + 1, CAST(json_object('id', doc_id, 'sample_cover_url', 'https://cdn.example/' || CAST(doc_id AS VARCHAR) || '.jpg') AS VARCHAR)
  FROM labels),
patch AS (
  SELECT id AS item_id, json_extract_string(value, '$.sample_cover_url') AS cover_url,
         CASE WHEN json_type(value, '$.sample_screenshot_urls') = 'ARRAY'
              THEN CAST(json_extract_string(value, '$.sample_screenshot_urls[*]') AS VARCHAR[]) END AS screenshot_urls FROM (
    SELECT *, TRY_CAST(json_extract(value, '$.id') AS BIGINT) AS id,
           row_number() OVER (PARTITION BY TRY_CAST(json_extract(value, '$.id') AS BIGINT) ORDER BY line_no DESC) AS rn
    FROM patch_lines WHERE json_valid(value)) WHERE rn = 1 AND id IS NOT NULL AND id <> 0)"""


@register("read_asset_patch_jsonl")
def q_read_asset_patch_jsonl(spark, d):
    p = J.read_asset_patch_jsonl(patch_lines(spark, d))
    return p.select("item_id", "cover_url", list_str(F.col("screenshot_urls")).alias("screenshots"))


SQL["read_asset_patch_jsonl"] = q(PATCH_SQL + """
SELECT item_id, cover_url, array_to_string(screenshot_urls, ', ') AS screenshots FROM patch""")


@register("patch_asset_urls")
def q_patch_asset_urls(spark, d):
    p = J.read_asset_patch_jsonl(patch_lines(spark, d))
    out = TB.patch_columns(fx.items(spark, d), p, "item_id", ["cover_url", "screenshot_urls"])
    return out.select("item_id", "cover_url", list_str(F.col("screenshot_urls")).alias("screenshots"), "_patched") \
              .withColumnRenamed("_patched", "patched")


SQL["patch_asset_urls"] = q(PATCH_SQL + """,
pj AS (SELECT i.item_id, i.cover_url AS old_cover, i.screenshot_urls AS old_shots, p.cover_url, p.screenshot_urls,
              p.item_id IS NOT NULL AND ((p.cover_url IS NOT NULL AND p.cover_url <> '')
                                         OR (p.screenshot_urls IS NOT NULL AND len(p.screenshot_urls) > 0)) AS patched
       FROM items i LEFT JOIN patch p ON p.item_id = i.item_id)
SELECT item_id, CASE WHEN patched THEN cover_url ELSE old_cover END AS cover_url,
       array_to_string(CASE WHEN patched THEN screenshot_urls ELSE old_shots END, ', ') AS screenshots, patched FROM pj""")


@register("match_before_update")
def q_match_before_update(spark, d):
    p = J.read_asset_patch_jsonl(patch_lines(spark, d))
    m = TB.match_before_update(fx.items(spark, d), p, "item_id")
    c = TB.patch_counts(p, ["cover_url", "screenshot_urls"])
    both = m.select(F.lit("matched").alias("count_of"), F.col("matched").alias("rows"))
    return both.unionByName(c.select(F.lit("with_value").alias("count_of"), F.col("updated").alias("rows")))


SQL["match_before_update"] = q(PATCH_SQL + """,
m AS (SELECT 'matched' AS count_of, CAST(count(*) AS BIGINT) AS rows FROM items WHERE item_id IN (SELECT item_id FROM patch)
      UNION ALL
      SELECT 'with_value', CAST(count_if((cover_url IS NOT NULL AND cover_url <> '') OR (screenshot_urls IS NOT NULL AND len(screenshot_urls) > 0)) AS BIGINT) FROM patch)
SELECT count_of, rows FROM m""")


# ------------------------------------------------------------ table upkeep

def _item_source(spark, d) -> DataFrame:
    """Corrections for labelled items plus new entries from the benchmark."""
    i = fx.items(spark, d)
    lab = fx.side(spark, d, "labels", "doc_id").select(F.col("doc_id").alias("item_id"))
    fixes = i.join(lab, "item_id", "left_semi").select(
        "item_id", F.concat(F.lit("v2 "), F.col("title")).alias("title"), "description", "release_date",
        (F.col("score") + F.lit(0.5)).alias("score"), "platforms", "genres", "developers", "publishers", "source_url")
    b = fx.table(spark, d, "benchmark")
    new = b.select((F.col("item_id") + NEW_ID_BASE).alias("item_id"),
                   fx.first_line(F.col("text")).alias("title"), F.col("text").alias("description"),
                   F.lit(None).cast("date").alias("release_date"), F.lit(None).cast("double").alias("score"),
                   F.lit(None).cast("array<string>").alias("platforms"), F.lit(None).cast("array<string>").alias("genres"),
                   F.lit(None).cast("array<string>").alias("developers"), F.lit(None).cast("array<string>").alias("publishers"),
                   F.lit(None).cast("string").alias("source_url"))
    return fixes.unionByName(new)


UPDATE_COLS = ["title", "description", "release_date", "score", "platforms", "genres", "developers", "publishers",
               "source_url"]


@register("upsert_items")
def q_upsert_items(spark, d):
    out = TB.upsert(fx.items(spark, d), _item_source(spark, d), "item_id", UPDATE_COLS)
    return out.select("item_id", "title", "score", "cover_url", F.coalesce(F.size("platforms"), F.lit(-1)).alias("n_platforms"))


SQL["upsert_items"] = q(f"""
src AS (
  SELECT i.item_id, 'v2 ' || i.title AS title, i.score + 0.5 AS score, i.platforms FROM items i
  WHERE i.item_id IN (SELECT doc_id FROM labels)
  UNION ALL
  SELECT item_id + {NEW_ID_BASE}, split_part(text, chr(10), 1), NULL, NULL FROM benchmark)
SELECT coalesce(i.item_id, s.item_id) AS item_id, CASE WHEN s.item_id IS NOT NULL THEN s.title ELSE i.title END AS title,
       CASE WHEN s.item_id IS NOT NULL THEN s.score ELSE i.score END AS score, i.cover_url,
       CAST(coalesce(len(CASE WHEN s.item_id IS NOT NULL THEN s.platforms ELSE i.platforms END), -1) AS INTEGER) AS n_platforms
FROM items i FULL OUTER JOIN src s ON s.item_id = i.item_id""")


@register("upsert_reviews")
def q_upsert_reviews(spark, d):
    r = fx.reviews(spark, d)
    c = fx.table(spark, d, "conversations").where(F.col("role") == "assistant")
    fixes = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("review_id"), F.col("conv_id").alias("item_id"),
                     F.concat(F.lit("[edited] "), F.col("text")).alias("citation"))
    b = fx.table(spark, d, "benchmark")
    new = b.select((F.col("item_id") + NEW_ID_BASE).alias("review_id"), "item_id", F.col("text").alias("citation"))
    out = TB.upsert(r, fixes.unionByName(new), "review_id", ["item_id", "citation"])
    return out.select("review_id", "item_id", F.md5("citation").alias("citation_md5"))


SQL["upsert_reviews"] = q(f"""
src AS (
  SELECT conv_id * 100 + turn AS review_id, conv_id AS item_id, '[edited] ' || text AS citation FROM conversations
  WHERE role = 'assistant'
  UNION ALL SELECT item_id + {NEW_ID_BASE}, item_id, text FROM benchmark)
SELECT coalesce(r.review_id, s.review_id) AS review_id, CASE WHEN s.review_id IS NOT NULL THEN s.item_id ELSE r.item_id END AS item_id,
       md5(CASE WHEN s.review_id IS NOT NULL THEN s.citation ELSE r.citation END) AS citation_md5
FROM reviews r FULL OUTER JOIN src s ON s.review_id = r.review_id""")


@register("insert_ignore")
def q_insert_ignore(spark, d):
    target = fx.items(spark, d).select("item_id", "title")
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.lit("dup").alias("title"),
                                                  F.lit(0).alias("ord"))
    b = fx.table(spark, d, "benchmark")
    first = b.select((F.col("item_id") + NEW_ID_BASE).alias("item_id"), F.lit("first").alias("title"), F.lit(1).alias("ord"))
    second = b.select((F.col("item_id") + NEW_ID_BASE).alias("item_id"), F.lit("second").alias("title"), F.lit(2).alias("ord"))
    return TB.insert_ignore(target, docs.unionByName(first).unionByName(second), "item_id", order="ord")


SQL["insert_ignore"] = q(f"""
x AS (SELECT 1)
SELECT item_id, title FROM items
UNION ALL SELECT item_id + {NEW_ID_BASE}, 'first' FROM benchmark""")


@register("delete_by_key")
def q_delete_by_key(spark, d):
    keys = fx.table(spark, d, "labels").select(F.col("doc_id").alias("item_id"))
    return TB.delete_by_key(fx.items(spark, d), keys, "item_id").select("item_id")


SQL["delete_by_key"] = q("""
x AS (SELECT 1)
SELECT item_id FROM items WHERE item_id NOT IN (SELECT doc_id FROM labels)""")


@register("cascade_delete")
def q_cascade_delete(spark, d):
    keys = fx.table(spark, d, "labels").select(F.col("doc_id").alias("item_id"))
    _, kids = TB.cascade_delete(fx.items(spark, d), fx.reviews(spark, d), keys, "item_id", "item_id")
    return kids.select("review_id", "item_id")


SQL["cascade_delete"] = q("""
x AS (SELECT 1)
SELECT review_id, item_id FROM reviews WHERE item_id NOT IN (SELECT doc_id FROM labels)""")


@register("copy_table")
def q_copy_table(spark, d):
    return TB.copy_table(fx.items(spark, d), ["item_id", "title", "score", "cover_url"])


SQL["copy_table"] = q("""
x AS (SELECT 1)
SELECT item_id, title, score, cover_url FROM items""")


@register("page_slice")
def q_page_slice(spark, d):
    return TB.page_slice(fx.items(spark, d).select("item_id"), [F.col("item_id").asc()], 100)


SQL["page_slice"] = q("""
r AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS rn FROM items)
SELECT item_id, CAST((rn - 1) // 100 AS BIGINT) AS page, CAST((rn - 1) % 100 AS INTEGER) AS pos_in_page FROM r""")


@register("reassign_surrogate_key")
def q_reassign_surrogate_key(spark, d):
    out = TB.reassign_surrogate_key(fx.reviews(spark, d), "review_id", "new_review_id")
    return out.select("new_review_id", "item_id", F.md5("citation").alias("citation_md5"))


SQL["reassign_surrogate_key"] = q("""
x AS (SELECT 1)
SELECT CAST(row_number() OVER (ORDER BY review_id) AS BIGINT) AS new_review_id, item_id, md5(citation) AS citation_md5
FROM reviews""")


@register("table_row_counts")
def q_table_row_counts(spark, d):
    return V.table_row_counts({"items": fx.items(spark, d), "reviews": fx.reviews(spark, d),
                               "item_vectors": fx.item_vectors(spark, d)})


SQL["table_row_counts"] = q("""
x AS (SELECT 1)
SELECT 'item_vectors' AS "table", CAST(count(*) AS BIGINT) AS rows FROM item_vectors
UNION ALL SELECT 'items', CAST(count(*) AS BIGINT) FROM items
UNION ALL SELECT 'reviews', CAST(count(*) AS BIGINT) FROM reviews""")


@register("verify_copy")
def q_verify_copy(spark, d):
    items, reviews = fx.items(spark, d), fx.reviews(spark, d)
    copy = TB.copy_table(items, ["item_id", "title", "description", "cover_url", "screenshot_urls"])
    return V.verify_copy(items, reviews, copy, TB.copy_table(reviews, ["item_id", "citation"]))


SQL["verify_copy"] = q("""
m AS (SELECT 'items' AS metric, CAST(count(*) AS BIGINT) AS v FROM items
      UNION ALL SELECT 'with_cover', CAST(count(cover_url) AS BIGINT) FROM items
      UNION ALL SELECT 'with_screenshots', CAST(count(screenshot_urls) AS BIGINT) FROM items
      UNION ALL SELECT 'item_bytes', CAST(coalesce(sum(strlen(coalesce(title, '')) + strlen(coalesce(description, ''))), 0) AS BIGINT) FROM items
      UNION ALL SELECT 'reviews', CAST(count(*) AS BIGINT) FROM reviews
      UNION ALL SELECT 'review_bytes', CAST(coalesce(sum(strlen(coalesce(citation, ''))), 0) AS BIGINT) FROM reviews)
SELECT metric, v AS source, v AS target, true AS match FROM m""")


@register("sample_rows")
def q_sample_rows(spark, d):
    return V.sample_rows(fx.items(spark, d))


SQL["sample_rows"] = q("""
x AS (SELECT 1)
SELECT item_id, substring(title, 1, 50) AS title, cover_url, CAST(coalesce(len(screenshot_urls), 0) AS INTEGER) AS screenshots
FROM items WHERE cover_url IS NOT NULL ORDER BY item_id LIMIT 3""")


@register("quarantine_orphans")
def q_quarantine_orphans(spark, d):
    parents = fx.table(spark, d, "labels").select(F.col("doc_id").alias("item_id"))
    ok, orphans = V.quarantine_orphans(fx.reviews(spark, d), parents, "item_id", "item_id")
    return ok.select("review_id", F.lit(True).alias("accepted")).unionByName(
        orphans.select("review_id", F.lit(False).alias("accepted")))


SQL["quarantine_orphans"] = q("""
x AS (SELECT 1)
SELECT review_id, item_id IN (SELECT doc_id FROM labels) AS accepted FROM reviews""")


def vector_lines(spark, d) -> dict[str, DataFrame]:
    """The lines of each modality: its vectors, and per supplier one line that
    is broken, has its id as a string, no vector, no id or no number."""
    iv, k = fx.item_vectors(spark, d), F.col("s_suppkey")
    odd = fx.table(spark, d, "supplier")
    sources = {}
    for modality, field in J.EMBEDDING_FILES.items():
        part = iv.where(F.col("modality") == modality)
        cols = [F.col("item_id").alias("game_id"), F.col("embedding").alias(field)]
        if modality == "review":
            cols.append(F.col("review_id"))
        own = F.concat(F.lit('{"game_id": "'), k + NEW_ID_BASE, F.lit('", "review_id": '), k, F.lit(f', "{field}": '))
        line = (F.when(k % 6 == 0, F.lit("{broken")).when(k % 6 == 1, F.concat(own, F.lit("[1.5, 2]}"))).when(k % 6 == 2, F.concat(own, F.lit("null}")))
                .when(k % 6 == 3, F.lit(f'{{"game_id": null, "{field}": [1]}}')).when(k % 6 == 4, F.concat(own, F.lit('[1, "x"]}')))
                .otherwise(F.concat(own, F.lit("[]}"))))
        sources[modality] = part.select(F.to_json(F.struct(*cols)).alias("value")).unionByName(odd.select(line.alias("value")))
    return sources


@register("read_embeddings_ndjson")
def q_read_embeddings_ndjson(spark, d):
    out = J.read_embeddings_ndjson(vector_lines(spark, d))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return out.select("modality", "vec_id", "item_id", F.size("embedding").alias("dim"), F.round(total, 4).alias("total"))


SQL["read_embeddings_ndjson"] = q(f"""
x AS (SELECT 1)
SELECT modality, vec_id, item_id, CAST(len(embedding) AS INTEGER) AS dim,
       round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM item_vectors
UNION ALL
SELECT m, CAST(CASE WHEN m = 'review' THEN s_suppkey ELSE s_suppkey + {NEW_ID_BASE} END AS VARCHAR), s_suppkey + {NEW_ID_BASE}, 2, 3.5
FROM supplier, (SELECT unnest(['description', 'cover', 'screenshot', 'review']) AS m) WHERE s_suppkey % 6 = 1""")


@register("embeddings_quarantine")
def q_embeddings_quarantine(spark, d):
    out = J.embeddings_ndjson_outcomes(vector_lines(spark, d))
    return out.where("reason is not null").groupBy("modality", "reason").agg(F.count(F.lit(1)).alias("lines"))


SQL["embeddings_quarantine"] = q("""
x AS (SELECT 1)
SELECT m AS modality, CASE s_suppkey % 6 WHEN 0 THEN 'bad_json' WHEN 3 THEN 'bad_id' ELSE 'bad_vector' END AS reason, count(*) AS lines
FROM supplier, (SELECT unnest(['description', 'cover', 'screenshot', 'review']) AS m) WHERE s_suppkey % 6 <> 1 GROUP BY ALL""")


@register("read_query_params")
def q_read_query_params(spark, d):
    b = fx.table(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"), F.concat(F.lit("  "), F.col("text"), F.lit(" ")).alias("q"),
        F.lit("All").alias("platform"), F.lit("").alias("genre"), F.lit(None).cast("string").alias("score"),
        F.lit("0").alias("year"), F.lit("TRUE").alias("scored_only"))
    lab = fx.table(spark, d, "labels").select(
        (F.col("doc_id") + NEW_ID_BASE).alias("query_id"), F.lit("   ").alias("q"),
        F.lit("NATION_3").alias("platform"), F.lit("PROMO").alias("genre"),
        F.col("quality").cast("string").alias("score"), F.lit("1999").alias("year"), F.lit("no").alias("scored_only"))
    out = J.read_query_params(b.unionByName(lab))
    return out.select("query_id", F.md5("text").alias("text_md5"), "platform", "genre",
                      F.col("min_score").cast("string").alias("min_score"),
                      F.col("min_year").cast("string").alias("min_year"), "scored_only", "error")


SQL["read_query_params"] = q(f"""
x AS (SELECT 1)
SELECT item_id AS query_id, md5(trim('  ' || text || ' ', {WS})) AS text_md5, NULL AS platform, NULL AS genre,
       CAST(NULL AS VARCHAR) AS min_score, CAST(NULL AS VARCHAR) AS min_year, true AS scored_only,
       CASE WHEN trim('  ' || text || ' ', {WS}) = '' THEN 'Query parameter is required' END AS error FROM benchmark
UNION ALL
SELECT doc_id + {NEW_ID_BASE}, md5(''), 'NATION_3', 'PROMO', CAST(CAST(quality AS DOUBLE) AS VARCHAR), '1999', false,
       'Query parameter is required' FROM labels""")


@register("write_vectors")
def q_write_vectors(spark, d):
    from .session import scratch_path
    path = scratch_path(spark, "item-vectors")
    dims = {"description": 64, "cover": 64, "screenshot": 64, "review": 64}
    out = TB.write_vectors(fx.item_vectors(spark, d), path + "/vectors", dims)
    return out.groupBy("modality").agg(F.count(F.lit(1)).cast("bigint").alias("vectors"))


SQL["write_vectors"] = q("""
x AS (SELECT 1)
SELECT modality, CAST(count(*) AS BIGINT) AS vectors FROM item_vectors GROUP BY modality""")


@register("result_json")
def q_result_json(spark, d):
    from .plans import search as SE
    res = SE.keyword_search(fx.items(spark, d), fx.reviews(spark, d), fx.keyword_queries(spark, d), with_reviews=False)
    return TB.result_json(res.select("query_id", "rank", "item_id", "title", "release_date", "score"))


SQL["result_json"] = with_body("""
m AS (
  SELECT q.query_id, i.* FROM kw_queries q JOIN items i
    ON (contains(lower(i.title), lower(q.text)) OR contains(lower(i.description), lower(q.text)))),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, item_id) AS rank FROM m)""", """
SELECT '{' || concat_ws(',', '"query_id":' || query_id, '"rank":' || rank, '"item_id":' || item_id,
                        '"title":' || CAST(to_json(title) AS VARCHAR),
                        '"release_date":"' || strftime(release_date, '%Y-%m-%d') || '"',
                        '"score":' || CAST(score AS VARCHAR)) || '}' AS json
FROM r WHERE rank <= 20""")


def _asset_paths(spark, d):
    """File paths of local assets: a cover for every page, two screenshots for
    every label, and files that are no assets."""
    pages, labels = fx.table(spark, d, "pages"), fx.table(spark, d, "labels")
    path = lambda c, name: F.concat(F.lit("assets/"), F.col(c).cast("string"), F.lit("/" + name)).alias("path")
    out = pages.select(path("page_id", "cover.jpg"))
    for name in ("screenshot_2.jpg", "screenshot_1.jpg", "notes.txt"):
        out = out.unionByName(labels.select(path("doc_id", name)))
    return out.unionByName(labels.select(F.concat(F.lit("assets/x"), F.col("doc_id").cast("string"),
                                                  F.lit("/cover.jpg")).alias("path")))


ASSETS_SQL = """
ids AS (SELECT page_id AS item_id FROM pages UNION SELECT doc_id FROM labels),
inv AS (SELECT item_id,
               CASE WHEN item_id IN (SELECT page_id FROM pages) THEN 'assets/' || item_id || '/cover.jpg' END AS cover_path,
               CASE WHEN item_id IN (SELECT doc_id FROM labels)
                    THEN ['assets/' || item_id || '/screenshot_1.jpg', 'assets/' || item_id || '/screenshot_2.jpg']
                    ELSE [] END AS screenshot_paths FROM ids)
"""


@register("scan_asset_inventory")
def q_scan_asset_inventory(spark, d):
    inv = J.asset_inventory(_asset_paths(spark, d))
    return inv.select("item_id", "cover_path", list_str(F.col("screenshot_paths")).alias("screenshots"))


SQL["scan_asset_inventory"] = q(ASSETS_SQL + """
SELECT item_id, cover_path, array_to_string(screenshot_paths, ', ') AS screenshots FROM inv""")
