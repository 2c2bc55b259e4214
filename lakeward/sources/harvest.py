"""Column descriptors harvested from datasets (O-S5) and schema files (O-S6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

READ_FORMATS = ("parquet", "orc", "json", "csv")


def catalog_type(dt: T.DataType) -> str:
    """The catalog's type word for a Spark type."""
    simple = {
        T.ByteType: "TINYINT", T.ShortType: "SMALLINT", T.IntegerType: "INTEGER", T.LongType: "BIGINT",
        T.FloatType: "FLOAT", T.DoubleType: "DOUBLE", T.StringType: "STRING", T.BooleanType: "BOOLEAN",
        T.DateType: "DATE", T.TimestampType: "TIMESTAMP", T.TimestampNTZType: "TIMESTAMP",
        T.BinaryType: "BINARY", T.DecimalType: "DECIMAL", T.ArrayType: "ARRAY", T.MapType: "MAP",
        T.StructType: "STRUCT", T.NullType: "NULL",
    }
    for cls, word in simple.items():
        if isinstance(dt, cls):
            return word
    return dt.simpleString().upper()


def read_dataset(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """A dataset to harvest.  Formats without a reader here fail clearly."""
    if fmt not in READ_FORMATS:
        raise ValueError(f"format {fmt!r} has no reader in this deployment (available: {READ_FORMATS})")
    reader = spark.read.options(**options)
    if fmt == "csv":
        reader = reader.option("header", options.get("header", "true")).option(
            "inferSchema", options.get("inferSchema", "true"))
    return reader.format(fmt).load(path)


def _descriptor(i: int, f: T.StructField, nullable: Column) -> Column:
    return F.struct(F.lit(i + 1).alias("col_pos"), F.lit(f.name).alias("name"), F.lit(catalog_type(f.dataType)).alias("type"),
                    F.lit(f.dataType.simpleString()).alias("spark_type"), nullable.alias("nullable"))


def harvest_columns(df: DataFrame, dataset: str) -> DataFrame:
    """One descriptor per column: ``dataset, col_pos, name, type, spark_type, nullable``.

    ``nullable`` is observed from the data: true when some row holds NULL.
    One pass, one row of flags (partial + final aggregation), then unpivoted.
    """
    fields = df.schema.fields
    flags = df.agg(*[F.coalesce(F.bool_or(F.col(f"`{f.name}`").isNull()), F.lit(False)).alias(f"c{i}")
                     for i, f in enumerate(fields)])
    # Names and types are known from the schema: the one-row result is
    # unpivoted with them as literals (no join, no second pass).
    rows = F.explode(F.array(*[_descriptor(i, f, F.col(f"c{i}")) for i, f in enumerate(fields)]))
    return flags.select(rows.alias("s")).select(F.lit(dataset).alias("dataset"), "s.*")


def harvest_many(frames: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [harvest_columns(df, name) for name, df in frames.items()])


#: Types whose NULLs Parquet footers count column by column.
_FLAT = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.StringType,
         T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType)


def harvest_parquet(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """``harvest_many`` of Parquet datasets (name to path), from their footers.

    Counts of flat columns are pushed into the scan, which answers them from
    the row groups' NULL counts; only nested columns, of which a footer
    tells nothing about the outer value, are read.
    """
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    key = "spark.sql.sources.useV1SourceList"
    v1 = spark.conf.get(key)
    try:
        # The version 2 reader is the one that takes aggregates.
        spark.conf.set(key, ",".join(x for x in v1.split(",") if x != "parquet"))
        footers = {name: spark.read.parquet(path) for name, path in paths.items()}
    finally:
        spark.conf.set(key, v1)
    parts = []
    for name, df in footers.items():
        fields = list(enumerate(df.schema.fields))
        flat = [(i, f) for i, f in fields if isinstance(f.dataType, _FLAT)]
        nested = [(i, f) for i, f in fields if not isinstance(f.dataType, _FLAT)]
        for some, source in ((flat, df), (nested, spark.read.parquet(paths[name]) if nested else None)):
            if some:
                counts = source.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in some])
                rows = F.explode(F.array(*[_descriptor(i, f, F.col("n") > F.col(f"c{i}")) for i, f in some]))
                parts.append(counts.select(rows.alias("s")).select(F.lit(name).alias("dataset"), "s.*"))
    return reduce(DataFrame.unionByName, parts)


# ------------------------------------------------------------------ O-S6 ---

_QUOTES = r"""^["']|["']$"""


def _strip(c: Column | str) -> Column:
    """Without white space of any kind at either end (carriage returns and tabs too)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _unquote(c: Column) -> Column:
    return _strip(F.regexp_replace(c, _QUOTES, ""))


def yaml_columns(files: DataFrame, id_col: str = "file_id", text_col: str = "text") -> DataFrame:
    """Column descriptors from YAML schema files, in file order.

    Two layouts: simple ``name: type`` lines, or a ``columns:`` list of
    ``- name:`` items with ``type``, ``nullable`` (anything but ``false`` is
    true) and ``description`` keys.  Output: ``file_id, col_pos, name, type,
    nullable, description``.  A file is read in its own row, by array
    functions over its lines: the list's items run from one ``- name:`` line
    to the next.  No window and no shuffle.
    """
    lines = F.transform(F.split(F.col(text_col), "\n", -1), lambda x: F.regexp_replace(x, r"\s+$", ""))
    files = files.select(F.col(id_col).alias("file_id"), lines.alias("lines"))
    is_list = F.exists("lines", lambda x: _strip(x).rlike(r"(?i)^columns\s*:"))

    pair = r"^([\w.]+)\s*:\s*(.+)"
    plain = F.filter(F.transform("lines", _strip), lambda x: (x != "") & ~x.startswith("#"))
    simple = F.filter(F.transform(plain, lambda x: F.struct(
        F.regexp_extract(x, pair, 1).alias("name"), _unquote(F.regexp_extract(x, pair, 2)).alias("type"),
        F.lit(True).alias("nullable"), F.lit("").alias("description"))),
        lambda c: (c["name"] != "") & (F.lower(c["name"]) != "columns"))

    n = F.size("lines")
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("lines", i).rlike(r"(?i)^\s+-\s+name\s*:"))
    items = F.transform("starts", lambda i, at: F.slice("lines", i, F.coalesce(F.get("starts", at + 1), F.size("lines") + 1) - i))
    key_line = r"^\s+(\w+)\s*:\s*(.*)"

    def last(item: Column, key: str) -> Column:
        found = F.filter(F.slice(item, 2, F.size(item)), lambda x: F.regexp_extract(x, key_line, 1) == key)
        return F.when(F.size(found) > 0, _unquote(F.regexp_extract(F.element_at(found, -1), key_line, 2)))

    listed = F.filter(F.transform("items", lambda item: F.struct(
        _unquote(F.regexp_replace(F.get(item, F.lit(0)), r"(?i).*name\s*:\s*", "")).alias("name"),
        F.coalesce(last(item, "type"), F.lit("")).alias("type"),
        F.coalesce(last(item, "nullable") != "false", F.lit(True)).alias("nullable"),
        F.coalesce(last(item, "description"), F.lit("")).alias("description"))), lambda c: c["name"] != "")

    return (files.where("lines is not null").withColumn("starts", starts).withColumn("items", items)
            .select("file_id", F.posexplode(F.when(is_list, listed).otherwise(simple)).alias("at", "c"))
            .select("file_id", (F.col("at") + 1).cast("int").alias("col_pos"), "c.name", "c.type", "c.nullable", "c.description"))


def yaml_from_columns(columns: DataFrame) -> DataFrame:
    """Render column descriptors as ``columns:`` YAML text per file (the inverse layout)."""
    item = F.concat(
        F.lit("  - name: "), F.col("name"), F.lit("\n    type: "), F.coalesce("type", F.lit("")),
        F.when(F.col("nullable").isNotNull(),
               F.concat(F.lit("\n    nullable: "), F.when(F.col("nullable"), "true").otherwise("false")))
        .otherwise(F.lit("")),
        F.when(F.col("description").isNotNull(),
               F.concat(F.lit("\n    description: "), F.col("description"))).otherwise(F.lit("")),
    )
    return columns.groupBy("file_id").agg(
        F.concat(F.lit("columns:\n"), F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("col_pos", item.alias("item")))), lambda s: s["item"]), "\n"))
        .alias("text"))
