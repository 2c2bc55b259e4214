"""Typed catalog tables (O-S1) and schema upgrades (O-S3)."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeward.sources import schemas


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns of ``schema``, in its order and types (``try_cast``: bad values -> NULL)."""
    present = set(df.columns)
    cols = []
    for field in schema.fields:
        if field.name in present:
            cols.append(F.col(field.name).try_cast(field.dataType).alias(field.name))
        else:
            cols.append(F.lit(None).cast(field.dataType).alias(field.name))
    return df.select(*cols)


def catalog_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The seven catalog tables stored as ``root/<table>`` parquet, read with explicit schemas.

    No inference: a missing column reads as NULL and is then filled by
    ``add_missing_columns`` with the table's defaults.
    """
    out = {}
    for name, schema in schemas.CATALOG_SCHEMAS.items():
        df = spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{name}")
        out[name] = add_missing_columns(df, schema, TABLE_DEFAULTS.get(name, {}))
    return out


# Defaults of columns added to the catalog after its first version.
TABLE_DEFAULTS: dict[str, dict[str, Any]] = {
    "users": {"is_superadmin": False, "name": "", "avatar": ""},
    "assets": {"published": False, "description": "", "source_type": "", "connection_uri": "",
               "schema_json": "{}", "owner_email": "", "tags": "", "freshness": ""},
    "teams": {"description": "", "is_platform": False},
    "domains": {"description": "", "owner_email": ""},
    "data_layers": {"color": "#9CA3AF", "position": 0},
    "team_members": {"role": "member"},
    "access_requests": {"status": "pending"},
}


def add_missing_columns(df: DataFrame, schema: StructType, defaults: dict[str, Any] | None = None) -> DataFrame:
    """O-S3: bring an older table to ``schema``.

    Columns absent from ``df`` are added with their default (or NULL);
    columns present keep their values, NULLs included.  For a mix of old
    and new files, read each and ``unionByName(allowMissingColumns=True)``
    first, then apply this to fill the defaults.
    """
    defaults = defaults or {}
    present = set(df.columns)
    out = df
    for field in schema.fields:
        if field.name not in present:
            value = defaults.get(field.name)
            out = out.withColumn(field.name, F.lit(value).cast(field.dataType))
    return out.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def upgrade_union(old: DataFrame, new: DataFrame, schema: StructType,
                  defaults: dict[str, Any] | None = None) -> DataFrame:
    """Rows of an old-layout and a new-layout table as one table of ``schema``.

    Old rows get the defaults of the columns they lack; new rows keep
    theirs (an explicit NULL stays NULL).
    """
    return add_missing_columns(old, schema, defaults).unionByName(add_missing_columns(new, schema, defaults))
