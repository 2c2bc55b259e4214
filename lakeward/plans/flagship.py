"""The flagship query: one viewer's asset listing, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeward.operators import access, joins, search
from lakeward.plans import oracle_sql as o
from lakeward.plans import params as p
from lakeward.plans.registry import query
from lakeward.sources.projection import catalog


def asset_listing(spark: SparkSession, sf_dir: str, viewer: str | None = p.MEMBER, q: str = p.SEARCH_Q,
                  limit: int = p.PAGE_LIMIT, offset: int = 0) -> DataFrame:
    """Search -> visibility -> layer join -> first page by name."""
    c = catalog(spark, sf_dir)
    flags = access.effective_flags(c.users, c.team_members, c.teams, emails=[viewer] if viewer else [])
    visible = access.visible_assets(c.assets, c.domains, c.team_members, flags, viewer)
    found = search.search_assets(visible, q)
    page = search.page_assets(found, limit=limit, offset=offset)
    return joins.assets_with_layer(page, c.data_layers).select(
        "id", "name", "description", "domain_name", "source_type", "published", "layer_id", "layer_name")


@query("asset_listing", f"""
SELECT va.id, va.name, va.description, va.domain_name, va.source_type, va.published, va.layer_id,
       l.name AS layer_name
FROM (SELECT * FROM {o.visible_assets(p.MEMBER)} v
      WHERE name ILIKE {o.like_contains(p.SEARCH_Q)} OR description ILIKE {o.like_contains(p.SEARCH_Q)}
      ORDER BY name, id LIMIT {p.PAGE_LIMIT}) va
LEFT JOIN data_layers l ON va.layer_id = l.id
""")
def q_asset_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifecycle A: filters + search + visibility + layer join + page."""
    return asset_listing(spark, sf_dir)
