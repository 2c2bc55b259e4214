"""Counts and small aggregates (§2.4).  All use partial + final aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeward.functions.columns import parse_columns
from lakeward.operators.search import asc


def _source_type_set(assets: DataFrame) -> DataFrame:
    return assets.filter(F.col("source_type").isNotNull() & (F.col("source_type") != "")).select("source_type")


def dashboard_stats(visible_assets: DataFrame, visible_domains: DataFrame) -> DataFrame:
    """O-A1: ``n_domains, n_assets, n_source_types`` (distinct non-blank) of one viewer."""
    a = visible_assets.agg(
        F.count(F.lit(1)).alias("n_assets"),
        F.count_distinct(F.nullif(F.col("source_type"), F.lit(""))).alias("n_source_types"),
    )
    n_domains = visible_domains.select(F.count(F.lit(1))).scalar()
    return a.select(n_domains.alias("n_domains"), "n_assets", "n_source_types")


def source_types(assets: DataFrame) -> DataFrame:
    """O-A2: distinct non-blank source types, sorted."""
    return _source_type_set(assets).distinct().orderBy(*asc("source_type"))


def layer_counts(layers: DataFrame, assets: DataFrame) -> DataFrame:
    """O-A3: assets per layer, layers without assets kept with 0, by position."""
    counts = assets.filter(F.col("layer_id").isNotNull()).groupBy("layer_id").agg(
        F.count(F.lit(1)).alias("n_assets"))
    return (
        layers.select(F.col("id").alias("layer_id"), "name", "color", "position")
        .join(counts, "layer_id", "left")
        .withColumn("n_assets", F.coalesce("n_assets", F.lit(0)).cast("long"))
        .orderBy(*asc("position", "name", "layer_id"))
    )


def schema_width(assets: DataFrame) -> DataFrame:
    """O-A4: number of described columns per asset (0 when none parse)."""
    return assets.select(
        F.col("id").alias("asset_id"),
        F.coalesce(F.size(parse_columns("schema_json")), F.lit(0)).cast("int").alias("n_columns"),
    )


def next_position(layers: DataFrame) -> DataFrame:
    """O-A5: ``COALESCE(MAX(position), -1) + 1``."""
    return layers.agg((F.coalesce(F.max("position"), F.lit(-1)) + 1).cast("int").alias("next_position"))


def first_user(users: DataFrame) -> DataFrame:
    """O-A6: earliest account (ties by id) and whether it is to be promoted.

    Promotion happens only when no superadmin exists yet.
    """
    return users.agg(
        F.min_by("id", F.struct("created_at", "id")).alias("first_user_id"),
        F.coalesce(F.bool_or("is_superadmin"), F.lit(False)).alias("has_superadmin"),
    ).withColumn("promote", F.col("first_user_id").isNotNull() & ~F.col("has_superadmin"))
