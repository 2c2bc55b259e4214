"""Fixed values the catalog's behaviour depends on.

These must equal the catalog application's own lists for results to match,
so they are stated plainly, in their natural order.
"""

from __future__ import annotations

# --- Fixed values: source type -> icon family (lower-cased source name). ---
# Anything not listed (including NULL and '') falls back to DEFAULT_FAMILY.
SOURCE_FAMILIES: dict[str, str] = {
    # warehouses / relational
    "snowflake": "snowflake",
    "bigquery": "cloud",
    "redshift": "cylinder",
    "synapse": "cylinder",
    "databricks": "cylinder",
    "postgres": "cylinder",
    "postgresql": "cylinder",
    "mysql": "cylinder",
    "clickhouse": "cylinder",
    "duckdb": "cylinder",
    # object storage
    "s3": "bucket",
    "gcs": "bucket",
    "minio": "bucket",
    "adls": "bucket",
    "azure_blob": "bucket",
    # streaming
    "kafka": "stream",
    "kinesis": "stream",
    "pubsub": "stream",
    # file formats
    "csv": "document",
    "tsv": "document",
    "json": "document",
    "xml": "document",
    "parquet": "document",
    "avro": "document",
    "orc": "document",
    # APIs
    "api": "api",
    "rest": "api",
    "graphql": "api",
}
DEFAULT_FAMILY = "cylinder"

# --- Fixed values: column type vocabulary per source system. ---
SOURCE_TYPE_VOCABULARY: dict[str, list[str]] = {
    "snowflake": [
        "VARCHAR", "NUMBER", "INTEGER", "FLOAT", "BOOLEAN",
        "DATE", "TIMESTAMP_NTZ", "TIMESTAMP_LTZ", "TIMESTAMP_TZ",
        "VARIANT", "ARRAY", "OBJECT", "BINARY",
    ],
    "bigquery": [
        "STRING", "INTEGER", "INT64", "FLOAT", "FLOAT64", "BOOLEAN", "BOOL",
        "DATE", "DATETIME", "TIMESTAMP", "BYTES", "NUMERIC", "BIGNUMERIC",
        "RECORD", "JSON",
    ],
    "redshift": [
        "VARCHAR", "CHAR", "INTEGER", "BIGINT", "SMALLINT",
        "FLOAT", "DOUBLE PRECISION", "BOOLEAN", "DATE",
        "TIMESTAMP", "TIMESTAMPTZ", "NUMERIC", "SUPER",
    ],
    "synapse": [
        "VARCHAR", "NVARCHAR", "INT", "BIGINT", "SMALLINT", "TINYINT",
        "FLOAT", "REAL", "BIT", "DATE", "DATETIME2", "DATETIMEOFFSET", "DECIMAL",
    ],
    "postgres": [
        "VARCHAR", "TEXT", "INTEGER", "BIGINT", "SMALLINT",
        "FLOAT", "DOUBLE PRECISION", "BOOLEAN", "DATE",
        "TIMESTAMP", "TIMESTAMPTZ", "NUMERIC", "UUID", "JSON", "JSONB",
    ],
}

# --- Fixed values: column type vocabulary per file format (s3 / gcs sources). ---
FILE_FORMAT_VOCABULARY: dict[str, list[str]] = {
    "csv": ["STRING", "INTEGER", "FLOAT", "BOOLEAN", "DATE", "TIMESTAMP"],
    "parquet": ["BOOLEAN", "INT32", "INT64", "FLOAT", "DOUBLE", "STRING", "BINARY", "DATE",
                "TIMESTAMP", "DECIMAL", "LIST", "MAP", "STRUCT"],
    "json": ["STRING", "NUMBER", "BOOLEAN", "ARRAY", "OBJECT", "NULL"],
    "avro": ["NULL", "BOOLEAN", "INT", "LONG", "FLOAT", "DOUBLE", "BYTES", "STRING", "ENUM",
             "ARRAY", "MAP"],
    "orc": ["BOOLEAN", "TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE", "STRING",
            "BINARY", "TIMESTAMP", "DATE", "DECIMAL", "LIST", "MAP", "STRUCT"],
}
FILE_SOURCES = ("s3", "gcs")

# --- Fixed values: types offered when the source has no list of its own. ---
DEFAULT_TYPES: list[str] = [
    "STRING", "VARCHAR", "TEXT", "INTEGER", "BIGINT",
    "FLOAT", "BOOLEAN", "DATE", "TIMESTAMP",
]

# --- Fixed values: default layers (name, colour, position). ---
DEFAULT_LAYERS: list[tuple[str, str, int]] = [
    ("landing", "#64748B", 0),
    ("bronze", "#B45309", 1),
    ("silver", "#9CA3AF", 2),
    ("gold", "#D97706", 3),
]
DEFAULT_LAYER_COLOR = "#9CA3AF"

# --- Fixed values: the platform team created when none exists. ---
PLATFORM_TEAM = ("Platform", "Data Platform Team with global access")

# --- Fixed values: roles. ---
MANAGER_ROLES = ("manager", "owner")
ASSIGNABLE_ROLES = ("manager", "member")

# --- Fixed values: name length limits. ---
NAME_LIMITS = {"layer": 64, "team": 128, "domain": 128, "profile": 128, "asset": 256}

# --- Fixed values: listing limits. ---
PAGE_DEFAULT, PAGE_MAX = 100, 1000
USER_SEARCH_LIMIT = 10
RECENT_ASSETS = 5

# --- Fixed values: why a change is turned down. ---
REASONS: dict[str, str] = {
    "authentication_required": "Authentication required",
    "invalid_asset_fields": "Invalid asset fields",
    "domain_not_found": "Domain not found",
    "not_authorized_to_create_assets_in_this_domain": "Not authorized to create assets in this domain",
    "quality_score_must_be_a_number": "quality_score must be a number",
    "asset_not_found": "Asset not found",
    "not_authorized_to_update_this_asset": "Not authorized to update this asset",
    "no_fields_to_update": "No fields to update",
    "not_authorized_to_delete_this_asset": "Not authorized to delete this asset",
    "not_authorized_to_publish_this_asset": "Not authorized to publish this asset",
    "not_authorized_to_unpublish_this_asset": "Not authorized to unpublish this asset",
    "invalid_domain_name": "Invalid domain name",
    "only_team_managers_can_create_domains": "Only team managers can create domains",
    "team_not_found": "Team not found",
    "domain_name_already_exists": "Domain name already exists",
    "only_team_managers_can_update_domains": "Only team managers can update domains",
    "only_team_managers_can_delete_domains": "Only team managers can delete domains",
    "invalid_team_name": "Invalid team name",
    "only_team_owners_can_modify_this_team": "Only team owners can modify this team",
    "cannot_modify_platform_team": "Cannot modify platform team",
    "cannot_delete_platform_team": "Cannot delete platform team",
    "email_is_required": "email is required",
    "only_team_managers_can_manage_members": "Only team managers can manage members",
    "role_must_be_manager_or_member": "Role must be 'manager' or 'member'",
    "no_user_account_found_for_that_email": "No user account found for that email",
    "user_is_already_a_member_of_this_team": "User is already a member of this team",
    "role_and_email_are_required": "role and email are required",
    "member_not_found": "Member not found",
    "team_id_is_required": "team_id is required",
    "superadmin_access_required": "Superadmin access required",
    "user_not_found": "User not found",
    "invalid_layer_name": "Invalid layer name",
    "name_is_required": "Name is required",
    "a_layer_with_that_name_already_exists": "A layer with that name already exists",
    "position_must_be_an_integer": "position must be an integer",
    "layer_not_found": "Layer not found",
    "invalid_e_mail": "Invalid e-mail",
    "email_already_registered": "Email already registered",
    "promote_must_be_a_boolean": "promote must be a boolean",
    "cannot_remove_your_own_superadmin_status": "Cannot remove your own superadmin status",
    "cannot_delete_your_own_account": "Cannot delete your own account",
    "invalid_profile_name": "Invalid profile name",
    "avatar_must_be_a_data_image_url": "avatar must be a data: image URL",
    "requester_email_is_required": "requester_email is required",
}
