"""Catalog column functions: ``Column -> Column`` and exploded forms.

All are built-in Spark expressions (no Python UDF), so they stay inside
whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    MapType,
    StringType,
    StructField,
    StructType,
)

from lakeward.functions import vocab

# ---------------------------------------------------------------- search ---


def contains_pattern(q: str) -> str:
    """``%q%`` for ``ilike``, with ``%`` and ``_`` in ``q`` kept live.

    Backslash is literal in the catalog's matcher (no escape character);
    Spark's ``ilike`` escapes with backslash, so a backslash is doubled.
    """
    return "%" + q.replace("\\", "\\\\") + "%"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ------------------------------------------------------------------ tags ---


def split_tags(tags: Column | str) -> Column:
    """Comma-separated tags -> array of trimmed tags.

    '' or NULL -> no tags; inner blanks (``a,,b``) are kept as ''.
    """
    tags = _col(tags)
    return F.when(tags.isNull() | (tags == ""), F.array().cast("array<string>")).otherwise(
        F.transform(F.split(tags, ",", -1), lambda t: F.trim(t))
    )


def asset_tags(assets: DataFrame) -> DataFrame:
    """One row per (asset, tag position): ``asset_id, tag_pos, tag`` (1-based)."""
    return assets.select(
        F.col("id").alias("asset_id"),
        F.posexplode(split_tags("tags")).alias("tag_pos", "tag"),
    ).withColumn("tag_pos", (F.col("tag_pos") + 1).cast("int"))


# ----------------------------------------------------------- schema_json ---

COLUMN_STRUCT = StructType([
    StructField("name", StringType()),
    StructField("type", StringType()),
    StructField("nullable", BooleanType()),
    StructField("description", StringType()),
])

# Strict JSON, as a browser's JSON.parse reads it.
_STRICT_JSON = {
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
    "allowUnquotedFieldNames": "false",
    "allowNumericLeadingZeros": "false",
    "allowBackslashEscapingAnyCharacter": "false",
    "allowUnquotedControlChars": "false",
}


def parse_columns(schema_json: Column | str) -> Column:
    """Column descriptors of an asset as ``array<struct<name,type,nullable,description>>``.

    * a non-empty JSON array: its elements as they are (non-objects give an
      all-NULL descriptor but still count as a column);
    * a non-empty JSON object ``{name: type}``: one descriptor per name, in
      the order of first occurrence and with its last value, ``nullable``
      true and ``description`` ''; a null value's type is 'null', as text;
    * anything else (``{}``, ``[]``, scalars, NULL, and texts that are not
      one whole JSON document, so anything after its end too): NULL.

    The text is read as the only element of an array, so that the parser
    sees all of it; the branch is then taken on its first character, so an
    object never reaches the array parser.
    """
    text = _col(schema_json)
    whole = F.from_json(F.concat(F.lit("["), text, F.lit("]")), ArrayType(StringType()), _STRICT_JSON)
    doc = F.when(F.size(whole) == 1, F.get(whole, F.lit(0)))
    head = F.substring(F.regexp_replace(text, r"^\s+", ""), 1, 1)
    raw_items = F.from_json(doc, ArrayType(StringType()), _STRICT_JSON)
    as_array = F.transform(raw_items, lambda item: F.from_json(item, COLUMN_STRUCT, _STRICT_JSON))
    entries = F.map_entries(F.from_json(doc, MapType(StringType(), StringType()), _STRICT_JSON))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    as_object = F.transform(
        names,
        lambda name: F.struct(
            name.alias("name"),
            F.coalesce(F.element_at(F.filter(entries, lambda e: e["key"] == name), -1)["value"], F.lit("null")).alias("type"),
            F.lit(True).alias("nullable"),
            F.lit("").alias("description"),
        ),
    )
    return (
        F.when((head == "[") & (F.size(as_array) > 0), as_array)
        .when((head == "{") & (F.size(as_object) > 0), as_object)
    )


def asset_columns(assets: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per described column: ``asset_id, col_pos (1-based), name, type, nullable, description``
    (plus the asset columns named in ``keep``)."""
    return (
        assets.select(F.col("id").alias("asset_id"), *keep,
                      F.posexplode(parse_columns("schema_json")).alias("col_pos", "c"))
        .select(
            "asset_id", *keep,
            (F.col("col_pos") + 1).cast("int").alias("col_pos"),
            F.col("c.name").alias("name"),
            F.col("c.type").alias("type"),
            F.col("c.nullable").alias("nullable"),
            F.col("c.description").alias("description"),
        )
    )


def encode_columns(cols: Column | str) -> Column:
    """Column descriptors -> JSON array text, dropping blank names."""
    return F.to_json(F.filter(_col(cols), lambda c: F.trim(c["name"]) != ""))


# ----------------------------------------------------------------- names ---


def clean_name(name: Column | str, trim: bool = True) -> Column:
    """The stored form of a name: trimmed when ``trim`` (layers, profiles)."""
    name = _col(name)
    return F.trim(name) if trim else name


def name_ok(name: Column | str, max_len: int, trim: bool = True) -> Column:
    """Length 1..max_len after the optional trim; NULL names fail."""
    cleaned = clean_name(name, trim)
    return F.coalesce(F.char_length(cleaned).between(1, max_len), F.lit(False))


# --------------------------------------------------------------- sources ---


def source_family(source_type: Column | str) -> Column:
    """Icon family of a source type; unknown, '' and NULL -> 'cylinder'."""
    families = F.create_map(*[F.lit(x) for kv in vocab.SOURCE_FAMILIES.items() for x in kv])
    return F.coalesce(F.try_element_at(families, F.lower(_col(source_type))), F.lit(vocab.DEFAULT_FAMILY))


# --------------------------------------------------------- notification ---

# --- Fixed values: the sentences of a notification. ---
REVIEW_LINE = "Please review the request in the catalog UI."


def notification_subject(asset_name: Column | str) -> Column:
    return F.concat(F.lit("Access request for data asset: "), _col(asset_name))


def notification_body(requester: Column | str, asset_name: Column | str, message: Column | str,
                      review_line: str = REVIEW_LINE) -> Column:
    """Owner notification; a missing or empty message reads '(none)'."""
    msg = F.coalesce(F.nullif(_col(message), F.lit("")), F.lit("(none)"))
    return F.concat(
        F.lit("User "), _col(requester), F.lit(" has requested access to the data asset '"),
        _col(asset_name), F.lit("'.\n\nMessage: "), msg, F.lit("\n\n" + review_line),
    )
