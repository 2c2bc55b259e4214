"""lakeward: data-catalog governance analytics as Spark jobs.

The catalog (teams, members, domains, assets, layers, users, access
requests) is a set of DataFrames.  Request-at-a-time catalog questions
are answered as set-based operators over many viewers, assets or change
records at once, built only from the DataFrame / SQL / Structured
Streaming APIs.
"""

from lakeward.functions.columns import asset_columns, asset_tags, parse_columns, source_family, split_tags
from lakeward.operators.access import (
    access_decisions,
    effective_flags,
    team_grants,
    visibility_scopes,
    visible_asset_counts,
    visible_assets,
    visible_domains,
    visible_teams,
)
from lakeward.operators.changes import apply_changes, decide, notifications
from lakeward.operators.quality import dangling_references, duplicate_keys, unknown_types
from lakeward.operators.search import filter_assets, page_assets, page_per_viewer, search_assets
from lakeward.session import checkpoint_dir, get_session
from lakeward.sources.catalog import add_missing_columns, catalog_tables
from lakeward.sources.harvest import harvest_columns, yaml_columns
from lakeward.sources.store import read_snapshot, seed_defaults, write_snapshot
from lakeward.streaming.streams import change_stream, request_stream

__all__ = [
    "access_decisions", "add_missing_columns", "apply_changes", "asset_columns", "asset_tags", "catalog_tables",
    "change_stream", "checkpoint_dir", "dangling_references", "decide", "duplicate_keys", "effective_flags",
    "filter_assets", "get_session", "harvest_columns", "notifications", "page_assets", "page_per_viewer",
    "parse_columns", "read_snapshot", "request_stream", "search_assets", "seed_defaults", "source_family",
    "split_tags", "team_grants", "unknown_types", "visibility_scopes", "visible_asset_counts", "visible_assets",
    "visible_domains", "visible_teams", "write_snapshot", "yaml_columns",
]
