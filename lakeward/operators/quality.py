"""Integrity checks the lake does not enforce (O-J11, O-J12, O-F7).

Parquet has no keys, so dangling references and duplicate keys are found
by jobs: one anti join of all references against all parent keys, one
grouped count of all keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward.functions import vocab
from lakeward.functions.columns import asset_columns

REFERENCE_COLUMNS = ["relation", "child_table", "child_id", "ref_value"]


def _refs(df: DataFrame, table: str, *refs: tuple[str, str]) -> DataFrame:
    """Reference rows of one table, one scan: (relation, child_table, child_id, parent_kind, ref_value)."""
    items = [F.struct(F.lit(f"{table}.{col}").alias("relation"), F.lit(kind).alias("parent_kind"),
                      F.col(col).alias("ref_value")) for col, kind in refs]
    return df.select(F.col("id").alias("child_id"), F.explode(F.array(*items)).alias("r")).select(
        "r.relation", F.lit(table).alias("child_table"), "child_id", "r.parent_kind", "r.ref_value")


def dangling_references(t: dict[str, DataFrame]) -> DataFrame:
    """O-J11: rows whose reference has no parent, one row per broken reference.

    Relations: member→team, domain→team, asset→domain, asset→layer (an
    unchecked column), request→asset, member e-mail→user account.  All
    references meet all parent keys in a single anti join.
    """
    refs = reduce(DataFrame.unionByName, [
        _refs(t["team_members"], "team_members", ("team_id", "team"), ("email", "user")),
        _refs(t["domains"], "domains", ("team_id", "team")),
        _refs(t["assets"], "assets", ("domain_id", "domain"), ("layer_id", "layer")),
        _refs(t["access_requests"], "access_requests", ("asset_id", "asset")),
    ]).filter(F.col("ref_value").isNotNull())
    keys = reduce(DataFrame.unionByName, [
        t["teams"].select(F.lit("team").alias("_kind"), F.col("id").alias("_key")),
        t["users"].select(F.lit("user").alias("_kind"), F.col("email").alias("_key")),
        t["domains"].select(F.lit("domain").alias("_kind"), F.col("id").alias("_key")),
        t["data_layers"].select(F.lit("layer").alias("_kind"), F.col("id").alias("_key")),
        t["assets"].select(F.lit("asset").alias("_kind"), F.col("id").alias("_key")),
    ])
    return refs.join(keys, (refs.parent_kind == keys._kind) & (refs.ref_value == keys._key), "left_anti").select(
        *REFERENCE_COLUMNS)


# Keys checked per table: (key name, SQL expressions of its parts).
UNIQUE_KEYS: dict[str, list[tuple[str, tuple[str, ...]]]] = {
    "teams": [("id", ("id",))],
    "team_members": [("id", ("id",)), ("team_id,email", ("team_id", "email"))],
    "domains": [("id", ("id",)), ("name", ("name",))],
    "assets": [("id", ("id",))],
    "data_layers": [("id", ("id",)), ("lower(name)", ("lower(name)",))],
    "access_requests": [("id", ("id",))],
    "users": [("id", ("id",)), ("email", ("email",))],
}


def duplicate_keys(t: dict[str, DataFrame]) -> DataFrame:
    """O-J12: primary and unique key violations: ``table_name, key_name, key_value, n_rows``.

    Every key of a row is emitted by one scan of its table, as an array of
    its parts (so parts that hold the separator do not collide); one
    aggregate (partial + final) counts all keys at once.  A key with a NULL
    part equals no other.  key_value joins the parts by ``|``.
    """
    parts = []
    for table, keys in UNIQUE_KEYS.items():
        items = ", ".join(f"named_struct('key_name', '{name}', 'parts', array({', '.join(exprs)}))" for name, exprs in keys)
        parts.append(t[table].selectExpr(f"'{table}' AS table_name", f"explode(array({items})) AS k")
                     .selectExpr("table_name", "k.key_name", "k.parts"))
    return (reduce(DataFrame.unionByName, parts).filter("NOT exists(parts, x -> x IS NULL)")
            .groupBy("table_name", "key_name", "parts").agg(F.count(F.lit(1)).alias("n_rows"))
            .filter(F.col("n_rows") > 1)
            .select("table_name", "key_name", F.array_join("parts", "|").alias("key_value"), "n_rows"))


def type_vocabulary(spark: SparkSession) -> DataFrame:
    """``vocab_key, type`` for every source list, file format list (``format:<name>``) and the default list (``''``)."""
    rows = [(src, ty) for src, types in vocab.SOURCE_TYPE_VOCABULARY.items() for ty in types]
    rows += [(f"format:{fmt}", ty) for fmt, types in vocab.FILE_FORMAT_VOCABULARY.items() for ty in types]
    rows += [("", ty) for ty in vocab.DEFAULT_TYPES]
    return spark.createDataFrame(rows, "vocab_key string, type string")


def unknown_types(assets: DataFrame, formats: DataFrame | None = None) -> DataFrame:
    """O-F7: described column types outside the vocabulary of the asset's source.

    Sources with their own list use it (exact, case-sensitive match).  Files
    in object storage (s3, gcs) use their file format's list, where
    ``formats`` (asset_id, file_format, one row an asset) knows it: the
    catalog does not store it.  All others use the default list.
    """
    spark = assets.sparkSession
    listed = list(vocab.SOURCE_TYPE_VOCABULARY)
    cols = asset_columns(assets, keep=("source_type",))
    key = F.when(F.col("source_type").isin(listed), F.col("source_type"))
    if formats is not None:
        known_formats = formats.where(F.col("file_format").isin(list(vocab.FILE_FORMAT_VOCABULARY))).select(
            F.col("asset_id").alias("_asset"), "file_format")
        cols = cols.join(known_formats, F.col("asset_id") == F.col("_asset"), "left")
        key = key.when(F.col("source_type").isin(*vocab.FILE_SOURCES), F.concat(F.lit("format:"), F.col("file_format")))
    cols = cols.withColumn("vocab_key", F.coalesce(key, F.lit("")))
    known = F.broadcast(type_vocabulary(spark))  # a fixed list
    return cols.join(known, ["vocab_key", "type"], "left_anti").select(
        "asset_id", "col_pos", "name", "type", "source_type")
