"""Registered queries of sources: column harvesting (O-S5) and YAML schema files (O-S6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward.functions.columns import asset_columns
from lakeward.plans.registry import query
from lakeward.sources.harvest import harvest_parquet, yaml_columns, yaml_from_columns
from lakeward.sources.projection import catalog

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _harvest_sql() -> str:
    flags = "\nUNION ALL ".join(
        f"SELECT '{t}' AS dataset, name, nullable FROM "
        f"(UNPIVOT (SELECT bool_or(COLUMNS(*) IS NULL) FROM {t}) ON COLUMNS(*) INTO NAME name VALUE nullable)"
        for t in DRIVER_TABLES)
    tables = ", ".join(f"'{t}'" for t in DRIVER_TABLES)
    return f"""
WITH flags AS ({flags}),
cols AS (SELECT table_name AS dataset, column_name AS name, CAST(ordinal_position AS INTEGER) AS col_pos,
  CASE WHEN data_type LIKE '%[]' THEN 'ARRAY' WHEN data_type = 'VARCHAR' THEN 'STRING'
       ELSE data_type END AS type
  FROM information_schema.columns WHERE table_name IN ({tables}))
SELECT c.dataset, c.col_pos, c.name, c.type, f.nullable
FROM cols c JOIN flags f ON c.dataset = f.dataset AND c.name = f.name
"""


@query("harvest_columns", _harvest_sql())
def q_harvest_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-S5 over every driver table: one descriptor per column, nullability from the footers, or from the data of nested columns."""
    paths = {t: f"{sf_dir.rstrip('/')}/{t}.parquet" for t in DRIVER_TABLES}
    return harvest_parquet(spark, paths).select("dataset", "col_pos", "name", "type", "nullable")


@query("yaml_columns", """
SELECT a.id AS file_id, CAST(e.rn AS INTEGER) AS col_pos,
  CASE WHEN json_type(a.schema_json) = 'ARRAY' THEN json_extract_string(e.value, '$.name') ELSE e.key END AS name,
  coalesce(CASE WHEN json_type(a.schema_json) = 'ARRAY' THEN json_extract_string(e.value, '$.type')
       ELSE json_extract_string(e.value, '$') END, '') AS type,
  coalesce(CASE WHEN json_type(a.schema_json) = 'ARRAY' THEN CAST(json_extract(e.value, '$.nullable') AS BOOLEAN)
       ELSE true END, true) AS nullable,
  coalesce(CASE WHEN json_type(a.schema_json) = 'ARRAY' THEN json_extract_string(e.value, '$.description')
       ELSE '' END, '') AS description
FROM (SELECT * FROM assets WHERE json_valid(schema_json)
        AND json_type(schema_json) IN ('ARRAY', 'OBJECT')) a,
     LATERAL (SELECT key, value, row_number() OVER (ORDER BY id) AS rn FROM json_each(a.schema_json)) e
""")
def q_yaml_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-S6: YAML schema files (one per asset, rendered from its described columns as stand-in input) parsed back into
    column descriptors: a list for arrays, simple lines with comments for objects, and carriage returns in every third."""
    c = catalog(spark, sf_dir)
    listed = yaml_from_columns(asset_columns(c.assets.where(F.ltrim("schema_json").startswith("["))).withColumnRenamed("asset_id", "file_id"))
    rows = asset_columns(c.assets.where(F.ltrim("schema_json").startswith("{")))
    line = F.concat(F.lit("# the next column\n\n"), "name", F.lit(":   '"), "type", F.lit("' "))
    simple = rows.groupBy(F.col("asset_id").alias("file_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("col_pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    files = listed.unionByName(simple)
    third = F.pmod(F.crc32(F.col("file_id").cast("binary")), F.lit(3)) == 0
    return yaml_columns(files.withColumn("text", F.when(third, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text"))))
