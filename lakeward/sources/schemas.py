"""Explicit schemas of the catalog tables and of change records.

Credentials never enter the lake, so ``users`` has no password column.
Timestamps are zone-free (``timestamp_ntz``), as the catalog stores them.
"""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

S, B, D, I, L, TS = StringType(), BooleanType(), DoubleType(), IntegerType(), LongType(), TimestampNTZType()


def _schema(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields])


TEAMS = _schema(("id", S), ("name", S), ("description", S), ("is_platform", B))

TEAM_MEMBERS = _schema(("id", S), ("team_id", S), ("email", S), ("role", S))

DOMAINS = _schema(
    ("id", S), ("name", S), ("description", S), ("owner_email", S), ("team_id", S),
    ("created_at", TS), ("updated_at", TS),
)

ASSETS = _schema(
    ("id", S), ("domain_id", S), ("name", S), ("description", S), ("source_type", S),
    ("connection_uri", S), ("schema_json", S), ("owner_email", S), ("tags", S),
    ("quality_score", D), ("freshness", S), ("published", B), ("created_at", TS),
    ("updated_at", TS), ("layer_id", S),
)

DATA_LAYERS = _schema(("id", S), ("name", S), ("color", S), ("position", I), ("created_at", TS))

ACCESS_REQUESTS = _schema(
    ("id", S), ("asset_id", S), ("requester_email", S), ("status", S),
    ("created_at", TS), ("decision_at", TS),
)

USERS = _schema(
    ("id", S), ("email", S), ("is_superadmin", B), ("name", S), ("avatar", S), ("created_at", TS),
)

CATALOG_SCHEMAS: dict[str, StructType] = {
    "teams": TEAMS,
    "team_members": TEAM_MEMBERS,
    "domains": DOMAINS,
    "assets": ASSETS,
    "data_layers": DATA_LAYERS,
    "access_requests": ACCESS_REQUESTS,
    "users": USERS,
}

# One change record: who asks for what on which target.  ``fields`` holds
# the set fields of a partial update: key absent = keep, key present with a
# NULL value = set NULL.
CHANGES = StructType([
    StructField("seq", L, False),
    StructField("event_at", TS, True),
    StructField("actor_email", S, True),
    StructField("op", S, False),
    StructField("target_id", S, True),
    StructField("fields", MapType(S, S, True), True),
])

# One decision per change record.
DECISIONS = _schema(("seq", L), ("op", S), ("target_id", S), ("status", I), ("reason", S))

# Columns a change set may write per table (partial-update field lists).
UPDATABLE_FIELDS: dict[str, list[str]] = {
    "assets": ["name", "description", "source_type", "connection_uri", "schema_json",
               "owner_email", "tags", "quality_score", "freshness", "layer_id"],
    "domains": ["name", "description"],
    "teams": ["name", "description"],
    "data_layers": ["name", "color", "position"],
    "users": ["name", "avatar"],
}
