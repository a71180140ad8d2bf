"""JSON-lines ingest with row-level quarantine.

Readers take a *lines* DataFrame (``value`` plus an order column ``line_no``
that gives file order) so the same code serves files (``read_lines``) and
lines Spark derives from other tables. Every input line ends up in exactly
one of: accepted records, or quarantine with a reason — accepted +
quarantined = input.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clean as C


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Text lines of one or more files with their file order.

    ``line_no`` orders lines by (file path, split start, position in split);
    the split position comes from ``monotonically_increasing_id``, which
    increases within a task's split, so the order is file order even when a
    large file is read by many tasks.
    """
    df = spark.read.text(paths if isinstance(paths, str) else list(paths))
    return df.select(
        "value",
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("pos")).alias("line_no"))


def count_input_lines(lines: DataFrame) -> DataFrame:
    """All lines and non-blank lines (Python ``strip``-blank) in one pass."""
    return lines.agg(F.count(F.lit(1)).cast("bigint").alias("lines"),
                     F.count_if(C.py_strip(F.col("value")) != "").cast("bigint").alias("non_blank"))


def _parsed(lines: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Parse each line as a JSON object with every field read as text.

    ``from_json`` (Jackson, streaming) returns scalars as their text and
    lists / objects as their raw JSON. The line is read as the only element
    of an array, so that anything after the object (or a second object) makes
    it invalid; single quotes are not JSON. Adds ``_r`` (the struct), ``_ok``
    (parsed as one object) and ``_blank``.
    """
    v = C.py_strip(F.col("value"))
    schema = "array<struct<" + ", ".join(f"`{f}`: string" for f in fields) + ">>"
    r = F.from_json(F.concat(F.lit("["), v, F.lit("]")), schema, {"mode": "PERMISSIVE", "allowSingleQuotes": "false"})
    out = lines.select("*", r.alias("_all"), (v == "").alias("_blank"))
    one = F.startswith(v, F.lit("{")) & (F.size("_all") == 1) & F.get("_all", F.lit(0)).isNotNull()
    return out.withColumn("_r", F.get("_all", F.lit(0))).withColumn("_ok", F.coalesce(one, F.lit(False))).drop("_all")


def _get(field: str) -> Column:
    return F.col(f"_r.`{field}`")


def _json_list(field: str) -> Column:
    """A JSON field that may be a list, a scalar or null -> list of strings
    (safe_list: trimmed, blanks dropped)."""
    raw = _get(field)
    is_list = F.startswith(F.ltrim(raw), F.lit("["))
    return C.safe_list(F.when(raw.isNull(), F.array().cast("array<string>"))
                        .when(is_list, F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>")))
                        .otherwise(F.array(raw)))


def _list_or_null(field: str) -> Column:
    raw = _get(field)
    return F.when(F.startswith(F.ltrim(raw), F.lit("[")), F.from_json(raw, "array<string>"))


def latest_by_key(df: DataFrame, key: str, order: str = "line_no") -> DataFrame:
    """Last line wins per key: ``max_by`` over the line order, one partial
    aggregate per task, so a key repeated on a third of all lines still
    ships one row per task."""
    cols = [c for c in df.columns if c != key]
    agg = df.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("_r"))
    return agg.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


CATALOGUE_FIELDS = ("title", "description", "release_date", "moby_score", "moby_url", "sample_cover_url")


def read_catalogue_jsonl(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine). Records: one per truthy id, last line wins.
    Quarantine: line_no, value, reason ('bad_json' or 'missing_id');
    blank lines are neither (they are not records)."""
    lists = ("platforms", "genres", "developers", "publishers")
    p = _parsed(lines, ("id", *CATALOGUE_FIELDS, *lists, "sample_screenshot_urls"))
    rid = _get("id").try_cast("bigint")
    good = p.where(F.col("_ok") & C.truthy_id(rid))
    rec = good.select(
        rid.alias("id"), "line_no",
        *[_get(f).alias(f) for f in CATALOGUE_FIELDS],
        *[_json_list(f).alias(f) for f in lists],
        _list_or_null("sample_screenshot_urls").alias("sample_screenshot_urls"))
    records = latest_by_key(rec, "id")
    bad = p.where(~F.col("_blank") & (~F.col("_ok") | ~F.coalesce(C.truthy_id(rid), F.lit(False)))).select(
        "line_no", "value", F.when(~F.col("_ok"), "bad_json").otherwise("missing_id").alias("reason"))
    return records, bad


def prepare_items(records: DataFrame, local_assets: DataFrame | None = None) -> DataFrame:
    """Clean catalogue records into the items schema.

    ``local_assets`` (item_id, cover_path, screenshot_paths) are preferred
    over the URLs of the record when present.
    """
    r = records
    if local_assets is not None:
        r = r.join(local_assets.withColumnRenamed("item_id", "id"), "id", "left")
    else:
        r = r.withColumn("cover_path", F.lit(None).cast("string")) \
             .withColumn("screenshot_paths", F.lit(None).cast("array<string>"))
    return r.select(
        F.col("id").alias("item_id"),
        C.trim_default(F.col("title")).alias("title"),
        C.strip_html(F.col("description")).alias("description"),
        C.parse_date_multi(F.col("release_date")).alias("release_date"),
        C.safe_float(F.col("moby_score")).alias("score"),
        C.trim_default(F.col("moby_url")).alias("source_url"),
        "platforms", "genres", "developers", "publishers",
        C.prefer_local(F.col("cover_path"), F.col("sample_cover_url")).alias("cover_url"),
        C.prefer_local_list(F.col("screenshot_paths"), F.col("sample_screenshot_urls")).alias("screenshot_urls"))


def _cut(x: Column) -> Column:
    """A double cut towards zero, if that is a long."""
    return F.when(F.abs(x) < F.lit(2.0 ** 63), x.cast("bigint"))


def _typed(field: str) -> tuple[Column, Column]:
    """(falsy, integer) of a field of ``_v``, the line as VARIANT, by the rules
    of a dynamic language: null, '', 0, false, [] and {} are falsy; an integer
    is itself, a fraction is cut towards zero, true is 1, and a string counts
    if it is an integer with white space around it, a sign, or single
    underscores between its digits. Anything else, or an integer that is no
    long, has no integer."""
    v = F.try_variant_get("_v", f"$.{field}", "variant")
    text = F.try_variant_get("_v", f"$.{field}", "string")
    kind = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL"))
    nested = F.startswith(kind, F.lit("ARRAY")) | F.startswith(kind, F.lit("OBJECT"))
    falsy = (F.when(kind == "VOID", True).when(kind == "STRING", text == "")
             .when(kind == "BOOLEAN", ~F.try_variant_get("_v", f"$.{field}", "boolean"))
             .when(number, F.try_variant_get("_v", f"$.{field}", "double") == 0)
             .when(nested, _get(field).rlike(r"^\s*(\[\s*\]|\{\s*\})\s*$")).otherwise(F.lit(False)))
    bare = C.py_strip(text)
    whole = (F.when(kind == "BOOLEAN", F.try_variant_get("_v", f"$.{field}", "boolean").cast("bigint"))
             .when(kind == "STRING", F.when(bare.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), F.replace(bare, F.lit("_"), F.lit("")).try_cast("bigint")))
             .when((kind == "BIGINT") | kind.rlike(r"^DECIMAL\([0-9]+,0\)$"), F.regexp_extract(text, r"^-?[0-9]+", 0).try_cast("bigint"))
             .when(number, _cut(F.try_variant_get("_v", f"$.{field}", "double"))))
    return F.coalesce(falsy, F.lit(True)), whole


def read_reviews_jsonl(lines: DataFrame) -> DataFrame:
    """Every non-blank line with its outcome.

    outcome 'accepted' (review_id, item_id, citation set), 'skipped'
    (bad JSON, or a falsy id / game / cleaned citation) or 'failed' (an id
    that is present but is no integer). The JSON type of an id decides, see
    ``_typed``: 7.9 is 7 and true is 1, but "6.0" fails. Blank lines are
    dropped, as the reference never counts them.
    """
    p = _parsed(lines, ("review_id", "game_id", "citation")).where(~F.col("_blank"))
    p = p.withColumn("_v", F.try_parse_json(C.py_strip(F.col("value"))))
    (no_rid, rid), (no_gid, gid) = _typed("review_id"), _typed("game_id")
    cit = C.strip_html(_get("citation"))
    reason = (F.when(~F.col("_ok"), "bad_json")
               .when(no_rid | no_gid | (cit == ""), "missing_field")
               .when(rid.isNull() | gid.isNull(), "bad_int"))
    outcome = F.when(reason.isNull(), "accepted").when(reason == "bad_int", "failed").otherwise("skipped")
    return p.select("line_no", "value", rid.alias("review_id"), gid.alias("item_id"),
                    cit.alias("citation"), outcome.alias("outcome"), reason.alias("reason"))


def read_asset_patch_jsonl(lines: DataFrame) -> DataFrame:
    """id -> (cover URL, screenshot URLs), truthy ids, last line wins."""
    p = _parsed(lines, ("id", "sample_cover_url", "sample_screenshot_urls"))
    rid = _get("id").try_cast("bigint")
    rec = p.where(F.col("_ok") & C.truthy_id(rid)).select(
        rid.alias("item_id"), "line_no",
        _get("sample_cover_url").alias("cover_url"),
        _list_or_null("sample_screenshot_urls").alias("screenshot_urls"))
    return latest_by_key(rec, "item_id")


EMBEDDING_FILES = {"description": "embedding", "cover": "cover_embedding",
                   "screenshot": "screenshot_embedding", "review": "embedding"}


def embeddings_ndjson_outcomes(sources: dict[str, DataFrame]) -> DataFrame:
    """Every non-blank line of the per-modality NDJSON line sets: vec_id,
    item_id, review_id, modality, embedding, and a reason if it is quarantined:
    'bad_json' (not one object), 'bad_id' (an id is missing or no integer) or
    'bad_vector' (missing, empty, or with an element that is no number).

    ``sources`` maps modality -> lines; the vector field name differs per
    file (fixed in ``EMBEDDING_FILES``); review lines carry review_id too. Ids
    may stand as numbers or as strings."""
    parts = []
    for modality, lines in sources.items():
        vec = EMBEDDING_FILES[modality]
        p = _parsed(lines, ("game_id", "review_id")).where(~F.col("_blank")).withColumn("_v", F.try_parse_json(C.py_strip(F.col("value"))))
        gid, rid = _typed("game_id")[1], _typed("review_id")[1]
        vector = F.try_variant_get("_v", f"$.{vec}", "array<float>")
        is_review = modality == "review"
        vid = rid if is_review else gid
        reason = (F.when(~F.col("_ok"), "bad_json")
                   .when(gid.isNull() | vid.isNull(), "bad_id")
                   .when(vector.isNull() | (F.size(vector) == 0) | F.exists(vector, lambda x: x.isNull()), "bad_vector"))
        parts.append(p.select(vid.cast("string").alias("vec_id"), gid.alias("item_id"),
                              (rid if is_review else F.lit(None).cast("bigint")).alias("review_id"),
                              F.lit(modality).alias("modality"), vector.alias("embedding"), reason.alias("reason"), "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_embeddings_ndjson(sources: dict[str, DataFrame]) -> DataFrame:
    """Union of the per-modality NDJSON line sets into item_vectors: the lines
    that ``embeddings_ndjson_outcomes`` does not quarantine."""
    return embeddings_ndjson_outcomes(sources).where("reason is null").drop("reason", "value")


def read_query_params(raw: DataFrame) -> DataFrame:
    """Normalise request parameters (all strings): trim; blank query -> row
    rejected (error); 'All' / '' -> no platform / genre; score parsed or
    NULL; year 0 / unparsable -> NULL; scored_only true only for 'true'."""
    qtext = C.py_strip(F.coalesce(F.col("q"), F.lit("")))
    none_if_all = lambda c: F.when(F.col(c).isNull() | F.col(c).isin("All", ""), None).otherwise(F.col(c))
    year = F.col("year").try_cast("int")
    return raw.select(
        "query_id", qtext.alias("text"),
        none_if_all("platform").alias("platform"), none_if_all("genre").alias("genre"),
        F.col("score").try_cast("double").alias("min_score"),
        F.when(year == 0, None).otherwise(year).alias("min_year"),
        (F.lower(F.coalesce(F.col("scored_only"), F.lit("false"))) == "true").alias("scored_only"),
        F.when(qtext == "", "Query parameter is required").alias("error"))


def asset_inventory(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """Per all-digit folder among the paths: its id, cover file (if any) and
    sorted screenshot files; other files are left out."""
    pattern = r"/(\d+)/(cover\.jpg|screenshot_[^/]*\.jpg)$"
    f = paths.select(F.regexp_extract(path_col, pattern, 1).alias("folder"),
                     F.regexp_extract(path_col, pattern, 2).alias("name"), F.col(path_col).alias("path"))
    return f.where(F.col("folder") != "").groupBy(F.col("folder").cast("bigint").alias("item_id")).agg(
        F.max(F.when(F.col("name") == "cover.jpg", F.col("path"))).alias("cover_path"),
        F.array_sort(F.collect_list(F.when(F.col("name") != "cover.jpg", F.col("path")))).alias("screenshot_paths"))


def scan_asset_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Asset inventory of the files under ``root``: listed only, contents not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    return asset_inventory(files)
