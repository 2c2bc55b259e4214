"""Durable catalog state as versioned parquet (O-S2) and default rows (O-S4).

Layout under a shared root (never a machine-local folder on a cluster)::

    root/v=<N>/<table>/...parquet     one folder per table of version N
    root/v=<N>/commit/...parquet      written last: version N is complete

A new version never overwrites what readers may be reading; readers take
the highest committed version.  Writing a committed version again is
refused.  A commit can name the stream and batch that it came from and the
version it was made from, so that a replayed micro-batch is known again.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from lakeward.functions import vocab
from lakeward.sources import schemas
from lakeward.sources.catalog import TABLE_DEFAULTS, add_missing_columns


COMMIT = "version long, n_tables int, stream string, batch long, parent long, committed_at timestamp"


def _version_dir(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/v={int(version)}"


def committed_versions(spark: SparkSession, root: str) -> DataFrame:
    """The commit record of every snapshot under ``root`` (empty if there is none)."""
    try:
        return spark.read.schema(COMMIT).parquet(f"{root.rstrip('/')}/v=*/commit")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMIT)


def latest_version(spark: SparkSession, root: str) -> int | None:
    """Highest committed version (one small aggregate), or None."""
    row = committed_versions(spark, root).agg(F.max("version").alias("v")).first()
    return None if row is None or row["v"] is None else int(row["v"])


def batch_committed(spark: SparkSession, root: str, stream: str, batch: int) -> bool:
    """Whether a version made from this batch of this stream is committed."""
    return not committed_versions(spark, root).where(
        (F.col("stream") == stream) & (F.col("batch") == int(batch))).isEmpty()


def write_snapshot(tables: Mapping[str, DataFrame], root: str, version: int, stream: str | None = None,
                   batch: int | None = None, parent: int | None = None) -> str:
    """Write all tables of one version, then its commit record.  Returns the folder."""
    spark = next(iter(tables.values())).sparkSession
    if version in {r["version"] for r in committed_versions(spark, root)
                   .filter(F.col("version") == int(version)).collect()}:
        raise FileExistsError(f"snapshot version {version} is already committed under {root}")
    folder = _version_dir(root, version)
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark.createDataFrame([(int(version), len(tables), stream, batch, parent)],
                          "version long, n_tables int, stream string, batch long, parent long") \
        .withColumn("committed_at", F.current_timestamp()) \
        .write.mode("errorifexists").parquet(f"{folder}/commit")
    return folder


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """The seven catalog tables of a committed version (default: the latest), typed."""
    version = latest_version(spark, root) if version is None else version
    if version is None:
        raise FileNotFoundError(f"no committed snapshot under {root}")
    folder = _version_dir(root, version)
    out = {}
    for name, schema in schemas.CATALOG_SCHEMAS.items():
        df = spark.read.schema(schema).parquet(f"{folder}/{name}")
        out[name] = add_missing_columns(df, schema, TABLE_DEFAULTS.get(name, {}))
    return out


def read_versions(spark: SparkSession, root: str, name: str, schema: StructType, versions: list[int] | None = None,
                  defaults: Mapping[str, object] | None = None) -> DataFrame:
    """O-S3: the rows of one table in several versions of different layouts, as one table of ``schema``, by one scan.

    ``schema`` is the newest layout; older versions may lack columns or
    fields of nested columns and may have narrower types (Parquet widens
    them while reading).  A column that a version's files lack gets its
    default there (``defaults``, else NULL); where the files have it, a NULL
    stays NULL.  Only each version's footer schema is read beforehand.  The
    version is in the column ``version``.
    """
    if versions is None:
        versions = sorted(r["version"] for r in committed_versions(spark, root).select("version").collect())
    paths = {v: f"{_version_dir(root, v)}/{name}" for v in versions}
    if not paths:
        return spark.createDataFrame([], schema).withColumn("version", F.lit(None).cast("long"))
    own = {v: spark.read.parquet(path).schema for v, path in paths.items()}
    rows = spark.read.schema(schema).parquet(*paths.values()).withColumn(
        "version", F.regexp_extract(F.col("_metadata.file_path"), rf"/v=([0-9]+)/{name}/", 1).cast("long"))
    columns = []
    for f in schema.fields:
        lacking = [v for v in versions if f.name not in own[v].fieldNames()]
        default = F.lit((defaults or {}).get(f.name)).cast(f.dataType)
        value = F.col(f.name)
        columns.append((F.when(F.col("version").isin(lacking), default).otherwise(value) if lacking else value).alias(f.name))
    return rows.select(*columns, "version")


def seed_defaults(layers: DataFrame, teams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """O-S4: the four default layers only if there is no layer at all; a platform
    team only if no team is a platform team.  Ids are fixed, so seeding twice
    gives the same rows."""
    spark = layers.sparkSession
    defaults = spark.createDataFrame(
        [(f"layer-{name}", name, color, pos) for name, color, pos in vocab.DEFAULT_LAYERS],
        "id string, name string, color string, position int",
    ).withColumn("created_at", F.localtimestamp())
    new_layers = defaults.where(~layers.exists())
    name, description = vocab.PLATFORM_TEAM
    platform = spark.createDataFrame([("team-platform", name, description, True)],
                                     "id string, name string, description string, is_platform boolean")
    new_teams = platform.where(~teams.filter(F.col("is_platform")).exists())
    return (layers.unionByName(new_layers.select(*layers.columns)),
            teams.unionByName(new_teams.select(*teams.columns)))
