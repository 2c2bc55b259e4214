"""Registered queries: scans, projections, filters, joins, sorts, rollups.

Each runs one operator over the whole projected catalog of ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward.functions import columns as fx
from lakeward.operators import access, joins, quality, rollups, search
from lakeward.plans import oracle_sql as o
from lakeward.plans import params as p
from lakeward.plans.registry import query
from lakeward.sources import schemas
from lakeward.sources.catalog import conform
from lakeward.sources.projection import catalog


def _flags(c) -> DataFrame:
    return access.effective_flags(c.users, c.team_members, c.teams)


def _viewer_flags(c, viewer: str | None) -> DataFrame:
    """Flags of one viewer only (the e-mail filter is pushed to the scans)."""
    return access.effective_flags(c.users, c.team_members, c.teams, emails=[viewer] if viewer else [])


def _visible(c, viewer: str | None) -> DataFrame:
    return access.visible_assets(c.assets, c.domains, c.team_members, _viewer_flags(c, viewer), viewer)


# ------------------------------------------------------------ scans (S) ---


@query("catalog_tables", """
SELECT 'teams' AS table_name, count(*) AS n_rows FROM teams
UNION ALL SELECT 'team_members', count(*) FROM team_members
UNION ALL SELECT 'domains', count(*) FROM domains
UNION ALL SELECT 'assets', count(*) FROM assets
UNION ALL SELECT 'data_layers', count(*) FROM data_layers
UNION ALL SELECT 'access_requests', count(*) FROM access_requests
UNION ALL SELECT 'users', count(*) FROM users
""")
def q_catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-S1: the seven tables, conformed to their schemas; rows per table."""
    c = catalog(spark, sf_dir)
    frames = [conform(df, schemas.CATALOG_SCHEMAS[name]).select(F.lit(name).alias("table_name"))
              for name, df in c.tables().items()]
    union = frames[0]
    for f in frames[1:]:
        union = union.unionByName(f)
    return union.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_rows"))


# ------------------------------------------------------ projections (P) ---


@query("asset_view", """
SELECT a.*, d.name AS domain_name FROM assets a JOIN domains d ON a.domain_id = d.id
""")
def q_asset_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return search.asset_view(access.assets_with_team(c.assets, c.domains))


@query("filter_assets", f"""
SELECT id, name, domain_id, source_type, layer_id FROM assets
WHERE source_type = {o.q(p.FILTER_SOURCE)} AND layer_id = {o.q(p.FILTER_LAYER)}
""")
def q_filter_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return search.filter_assets(c.assets, domain_id="", source_type=p.FILTER_SOURCE,
                                layer_id=p.FILTER_LAYER).select("id", "name", "domain_id", "source_type", "layer_id")


@query("search_assets", f"""
SELECT id, name, description FROM assets
WHERE name ILIKE {o.like_contains(p.SEARCH_Q)} OR description ILIKE {o.like_contains(p.SEARCH_Q)}
""")
def q_search_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return search.search_assets(c.assets, p.SEARCH_Q).select("id", "name", "description")


@query("search_users", f"""
SELECT id, email FROM users WHERE email ILIKE {o.like_contains(p.USER_Q)} ORDER BY email, id LIMIT 10
""")
def q_search_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return search.search_users(c.users, p.USER_Q)


@query("lookup", f"""
SELECT id, name, domain_id FROM assets WHERE id IN ({", ".join(o.q(i) for i in p.LOOKUP_IDS)})
""")
def q_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return search.lookup(c.assets, "id", p.LOOKUP_IDS).select("id", "name", "domain_id")


@query("published_only", "SELECT id, name FROM assets WHERE published")
def q_published_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return search.published_only(c.assets).select("id", "name")


@query("members_in_role", "SELECT id, team_id, email, role FROM team_members WHERE role IN ('manager', 'owner')")
def q_members_in_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return search.members_in_role(c.team_members)


@query("team_members_of", f"SELECT id, team_id, email, role FROM team_members WHERE team_id = {o.q(p.TEAM)}")
def q_team_members_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return search.team_members_of(c.team_members, p.TEAM)


@query("user_view", """
SELECT id, email, coalesce(is_superadmin, false) AS is_superadmin, coalesce(name, '') AS name,
       coalesce(avatar, '') AS avatar, created_at FROM users
""")
def q_user_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return search.user_view(c.users)


# ------------------------------------------------------------ joins (J) ---


@query("assets_with_domain", """
SELECT a.id, a.name, a.domain_id, d.name AS domain_name, d.team_id
FROM assets a JOIN domains d ON a.domain_id = d.id
""")
def q_assets_with_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return joins.assets_with_domain(c.assets, c.domains).select("id", "name", "domain_id", "domain_name", "team_id")


@query("user_teams", """
SELECT tm.email, t.id AS team_id, t.name AS team_name, tm.role
FROM team_members tm JOIN teams t ON tm.team_id = t.id WHERE NOT t.is_platform
""")
def q_user_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return joins.user_teams(c.team_members, c.teams)


@query("member_domains", f"""
SELECT d.id, d.name, d.team_id FROM domains d JOIN team_members tm ON d.team_id = tm.team_id
WHERE tm.email = {o.q(p.MEMBER)}
""")
def q_member_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return joins.member_domains(c.domains, c.team_members, p.MEMBER).select("id", "name", "team_id")


@query("users_with_teams", """
SELECT u.id, u.email, coalesce(u.is_superadmin, false) AS is_superadmin, coalesce(u.name, '') AS name,
       coalesce(u.avatar, '') AS avatar, u.created_at, m.team_id, m.team_name, m.role
FROM users u LEFT JOIN (
  SELECT tm.email, t.id AS team_id, t.name AS team_name, tm.role
  FROM team_members tm JOIN teams t ON tm.team_id = t.id WHERE NOT t.is_platform) m
ON u.email = m.email
""")
def q_users_with_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return joins.users_with_teams(c.users, c.team_members, c.teams)


@query("assets_with_layer", """
SELECT a.id, a.layer_id, l.name AS layer_name, l.color AS layer_color
FROM assets a LEFT JOIN data_layers l ON a.layer_id = l.id
""")
def q_assets_with_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return joins.assets_with_layer(c.assets, c.data_layers).select("id", "layer_id", "layer_name", "layer_color")


@query("domains_with_team", """
SELECT d.id, d.name, d.team_id, coalesce(t.name, d.team_id) AS team_name
FROM domains d LEFT JOIN teams t ON d.team_id = t.id
""")
def q_domains_with_team(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return joins.domains_with_team(c.domains, c.teams).select("id", "name", "team_id", "team_name")


@query("manageable_assets", f"""
SELECT a.id, a.name FROM assets a JOIN domains d ON a.domain_id = d.id
WHERE d.team_id IN (SELECT team_id FROM team_members WHERE email = {o.q(p.MEMBER)})
""")
def q_manageable_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return joins.manageable_assets(c.assets, c.domains, c.team_members, p.MEMBER).select("id", "name")


@query("assets_of_team", f"""
SELECT id, name, domain_id FROM assets
WHERE domain_id IN (SELECT id FROM domains WHERE team_id IN ({", ".join(o.q(t) for t in p.TEAMS)}))
""")
def q_assets_of_team(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return joins.assets_of_team(c.assets, c.domains, p.TEAMS).select("id", "name", "domain_id")


@query("member_candidates", f"""
SELECT id, email FROM (
  SELECT id, email FROM users WHERE email ILIKE {o.like_contains(p.USER_Q)} ORDER BY email, id LIMIT 10) s
WHERE lower(email) NOT IN (SELECT lower(email) FROM team_members WHERE team_id = {o.q("T1")})
""")
def q_member_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return joins.member_candidates(c.users, c.team_members, "T1", p.USER_Q)


@query("request_targets", """
SELECT r.id, r.asset_id, r.requester_email, a.name AS asset_name, a.owner_email
FROM access_requests r JOIN assets a ON r.asset_id = a.id
""")
def q_request_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return joins.request_targets(c.access_requests, c.assets).select(
        "id", "asset_id", "requester_email", "asset_name", "owner_email")


@query("dangling_references", """
SELECT 'team_members.team_id' AS relation, 'team_members' AS child_table, id AS child_id, team_id AS ref_value
  FROM team_members WHERE team_id IS NOT NULL AND team_id NOT IN (SELECT id FROM teams WHERE id IS NOT NULL)
UNION ALL SELECT 'domains.team_id', 'domains', id, team_id
  FROM domains WHERE team_id IS NOT NULL AND team_id NOT IN (SELECT id FROM teams WHERE id IS NOT NULL)
UNION ALL SELECT 'assets.domain_id', 'assets', id, domain_id
  FROM assets WHERE domain_id IS NOT NULL AND domain_id NOT IN (SELECT id FROM domains WHERE id IS NOT NULL)
UNION ALL SELECT 'assets.layer_id', 'assets', id, layer_id
  FROM assets WHERE layer_id IS NOT NULL AND layer_id NOT IN (SELECT id FROM data_layers WHERE id IS NOT NULL)
UNION ALL SELECT 'access_requests.asset_id', 'access_requests', id, asset_id
  FROM access_requests WHERE asset_id IS NOT NULL AND asset_id NOT IN (SELECT id FROM assets WHERE id IS NOT NULL)
UNION ALL SELECT 'team_members.email', 'team_members', id, email
  FROM team_members WHERE email IS NOT NULL AND email NOT IN (SELECT email FROM users WHERE email IS NOT NULL)
""")
def q_dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return quality.dangling_references(c.tables())


@query("duplicate_keys", """
SELECT table_name, key_name, key_value, n_rows FROM (
  SELECT 'teams' AS table_name, 'id' AS key_name, id AS key_value, count(*) AS n_rows FROM teams GROUP BY id
  UNION ALL SELECT 'team_members', 'id', id, count(*) FROM team_members GROUP BY id
  UNION ALL SELECT 'domains', 'id', id, count(*) FROM domains GROUP BY id
  UNION ALL SELECT 'assets', 'id', id, count(*) FROM assets GROUP BY id
  UNION ALL SELECT 'data_layers', 'id', id, count(*) FROM data_layers GROUP BY id
  UNION ALL SELECT 'access_requests', 'id', id, count(*) FROM access_requests GROUP BY id
  UNION ALL SELECT 'users', 'id', id, count(*) FROM users GROUP BY id
  UNION ALL SELECT 'domains', 'name', name, count(*) FROM domains GROUP BY name
  UNION ALL SELECT 'data_layers', 'lower(name)', lower(name), count(*) FROM data_layers GROUP BY lower(name)
  UNION ALL SELECT 'team_members', 'team_id,email', team_id || '|' || email, count(*)
    FROM team_members GROUP BY team_id || '|' || email
  UNION ALL SELECT 'users', 'email', email, count(*) FROM users GROUP BY email
) k WHERE n_rows > 1
""")
def q_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return quality.duplicate_keys(c.tables())


# ---------------------------------------------------------- rollups (A) ---


@query("dashboard_stats", f"""
SELECT (SELECT count(*) FROM {o.visible_domains(p.MEMBER)} vd) AS n_domains,
       count(*) AS n_assets, count(DISTINCT nullif(source_type, '')) AS n_source_types
FROM {o.visible_assets(p.MEMBER)} va
""")
def q_dashboard_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return rollups.dashboard_stats(
        _visible(c, p.MEMBER),
        access.visible_domains(c.domains, c.team_members, _viewer_flags(c, p.MEMBER), p.MEMBER))


@query("source_types", f"""
SELECT DISTINCT source_type FROM {o.visible_assets(p.MEMBER)} va
WHERE source_type IS NOT NULL AND source_type <> ''
""")
def q_source_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return rollups.source_types(_visible(c, p.MEMBER))


@query("layer_counts", f"""
SELECT l.id AS layer_id, l.name, l.color, l.position, coalesce(n.n_assets, 0) AS n_assets
FROM data_layers l LEFT JOIN (
  SELECT layer_id, count(*) AS n_assets FROM {o.visible_assets(p.MEMBER)} va
  WHERE layer_id IS NOT NULL GROUP BY layer_id) n ON l.id = n.layer_id
""")
def q_layer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return rollups.layer_counts(c.data_layers, _visible(c, p.MEMBER))


@query("schema_width", """
SELECT id AS asset_id, CAST(CASE
  WHEN NOT json_valid(schema_json) THEN 0
  WHEN json_type(schema_json) = 'ARRAY' THEN json_array_length(schema_json)
  WHEN json_type(schema_json) = 'OBJECT' THEN len(json_keys(schema_json))
  ELSE 0 END AS INTEGER) AS n_columns
FROM assets
""")
def q_schema_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return rollups.schema_width(c.assets)


@query("next_position", "SELECT CAST(coalesce(max(position), -1) + 1 AS INTEGER) AS next_position FROM data_layers")
def q_next_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return rollups.next_position(c.data_layers)


@query("first_user", """
SELECT (SELECT id FROM users ORDER BY created_at, id LIMIT 1) AS first_user_id,
       coalesce(bool_or(is_superadmin), false) AS has_superadmin,
       (SELECT id FROM users ORDER BY created_at, id LIMIT 1) IS NOT NULL
         AND NOT coalesce(bool_or(is_superadmin), false) AS promote
FROM users
""")
def q_first_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return rollups.first_user(c.users)


# ------------------------------------------------------------- sorts (T) ---


@query("page_assets", f"""
SELECT id, name, domain_name, source_type FROM {o.visible_assets(p.MEMBER)} va
ORDER BY name, id LIMIT {p.PAGE_LIMIT} OFFSET {p.PAGE_OFFSET}
""")
def q_page_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    page = search.page_assets(_visible(c, p.MEMBER), limit=p.PAGE_LIMIT, offset=p.PAGE_OFFSET)
    return page.select("id", "name", "domain_name", "source_type")


@query("first_assets", f"""
SELECT id, name FROM {o.visible_assets(None)} va ORDER BY name, id LIMIT 5
""")
def q_first_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return search.first_assets(_visible(c, None)).select("id", "name")


@query("ordered_layers", "SELECT id, name, color, position FROM data_layers")
def q_ordered_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return search.ordered_layers(c.data_layers)


@query("ordered_teams", f"""
SELECT t.id, t.name, t.description, t.is_platform FROM teams t
JOIN team_members tm ON t.id = tm.team_id WHERE tm.email = {o.q(p.MEMBER)} AND NOT t.is_platform
""")
def q_ordered_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return search.ordered_teams(access.visible_teams(c.teams, c.team_members, _viewer_flags(c, p.MEMBER),
                                                     p.MEMBER))


@query("page_per_viewer", f"""
SELECT viewer, asset_id, name, CAST(rnk AS INTEGER) AS rank FROM (
  SELECT v.viewer, a.id AS asset_id, a.name,
         row_number() OVER (PARTITION BY v.viewer ORDER BY a.name, a.id) AS rnk
  FROM {o.VIEWERS} v
  JOIN (SELECT a.*, d.team_id FROM assets a JOIN domains d ON a.domain_id = d.id) a
    ON a.published
    OR coalesce((SELECT f.is_global FROM {o.FLAGS} f WHERE f.email = v.viewer), false)
    OR a.team_id IN (SELECT team_id FROM team_members tm WHERE tm.email = v.viewer)
) x WHERE rnk <= {p.PER_VIEWER}
""")
def q_page_per_viewer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    flags = _flags(c)
    scopes = access.visibility_scopes(access.viewers_of(c.users), c.team_members, flags)
    return search.page_per_viewer(scopes, access.assets_with_team(c.assets, c.domains), p.PER_VIEWER)


# -------------------------------------------------------- functions (F) ---


@query("asset_tags", """
SELECT id AS asset_id, CAST(pos AS INTEGER) AS tag_pos, trim(parts[pos]) AS tag FROM (
  SELECT id, string_split(tags, ',') AS parts, generate_subscripts(string_split(tags, ','), 1) AS pos
  FROM assets WHERE tags IS NOT NULL AND tags <> '') s
""")
def q_asset_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return fx.asset_tags(c.assets)


@query("asset_columns", """
SELECT a.id AS asset_id, CAST(e.rn AS INTEGER) AS col_pos,
  CASE WHEN json_type(a.schema_json) = 'ARRAY' THEN json_extract_string(e.value, '$.name') ELSE e.key END AS name,
  CASE WHEN json_type(a.schema_json) = 'ARRAY' THEN json_extract_string(e.value, '$.type')
       ELSE json_extract_string(e.value, '$') END AS type,
  CASE WHEN json_type(a.schema_json) = 'ARRAY' THEN CAST(json_extract(e.value, '$.nullable') AS BOOLEAN)
       ELSE true END AS nullable,
  CASE WHEN json_type(a.schema_json) = 'ARRAY' THEN json_extract_string(e.value, '$.description')
       ELSE '' END AS description
FROM (SELECT * FROM assets WHERE json_valid(schema_json)
        AND json_type(schema_json) IN ('ARRAY', 'OBJECT')) a,
     LATERAL (SELECT key, value, row_number() OVER (ORDER BY id) AS rn FROM json_each(a.schema_json)) e
""")
def q_asset_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return fx.asset_columns(c.assets)


@query("source_family", f"SELECT id AS asset_id, source_type, {o.source_family('source_type')} AS family FROM assets")
def q_source_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return c.assets.select(F.col("id").alias("asset_id"), "source_type",
                           fx.source_family("source_type").alias("family"))


@query("notification_text", """
SELECT r.id AS request_id, a.owner_email AS notify_to,
  'Access request for data asset: ' || a.name AS subject,
  'User ' || r.requester_email || ' has requested access to the data asset ''' || a.name
    || '''.' || chr(10) || chr(10) || 'Message: (none)' || chr(10) || chr(10)
    || 'Please review the request in the catalog UI.' AS body
FROM access_requests r JOIN assets a ON r.asset_id = a.id
WHERE r.status = 'pending'
""")
def q_notification_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-F6 over every pending request (the projection carries no message)."""
    c = catalog(spark, sf_dir)
    pending = c.access_requests.filter(F.col("status") == "pending")
    t = joins.request_targets(pending, c.assets)
    return t.select(
        F.col("id").alias("request_id"), F.col("owner_email").alias("notify_to"),
        fx.notification_subject("asset_name").alias("subject"),
        fx.notification_body("requester_email", "asset_name", F.lit(None).cast("string")).alias("body"),
    )


@query("unknown_types", f"""
WITH cols AS (
  SELECT a.id AS asset_id, a.source_type, CAST(e.rn AS INTEGER) AS col_pos,
    CASE WHEN json_type(a.schema_json) = 'ARRAY' THEN json_extract_string(e.value, '$.name') ELSE e.key END AS name,
    CASE WHEN json_type(a.schema_json) = 'ARRAY' THEN json_extract_string(e.value, '$.type')
         ELSE json_extract_string(e.value, '$') END AS type
  FROM (SELECT * FROM assets WHERE json_valid(schema_json) AND json_type(schema_json) IN ('ARRAY', 'OBJECT')) a,
       LATERAL (SELECT key, value, row_number() OVER (ORDER BY id) AS rn FROM json_each(a.schema_json)) e),
vocab(vocab_key, type) AS (VALUES {o.type_vocabulary()})
SELECT asset_id, col_pos, name, type, source_type FROM cols
WHERE NOT EXISTS (SELECT 1 FROM vocab v WHERE v.type = cols.type AND v.vocab_key =
  CASE WHEN cols.source_type IN ({o.OWN_LIST}) THEN cols.source_type ELSE '' END)
""")
def q_unknown_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return quality.unknown_types(c.assets)


# ------------------------------------------------------------ access (X) ---


@query("effective_flags", f"SELECT * FROM {o.FLAGS} f")
def q_effective_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return _flags(c)


@query("team_grants", """
SELECT email, team_id, true AS is_member, bool_or(role IN ('manager', 'owner')) AS is_manager,
       bool_or(role = 'owner') AS is_owner
FROM team_members GROUP BY email, team_id
""")
def q_team_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return access.team_grants(c.team_members)


@query("visible_assets", f"SELECT id, name, published, team_id FROM {o.visible_assets(p.MEMBER)} va")
def q_visible_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return _visible(c, p.MEMBER).select("id", "name", "published", "team_id")


@query("visible_assets_batch", f"""
SELECT v.viewer, count(a.id) AS n_assets, CAST(coalesce(sum(CAST(substr(a.id, 2) AS BIGINT)), 0) AS BIGINT) AS id_sum,
  count(a.id) FILTER (a.published) AS n_published
FROM {o.VIEWERS} v
LEFT JOIN (SELECT a.*, d.team_id FROM assets a JOIN domains d ON a.domain_id = d.id) a
  ON a.published
  OR coalesce((SELECT f.is_global FROM {o.FLAGS} f WHERE f.email = v.viewer), false)
  OR a.team_id IN (SELECT team_id FROM team_members tm WHERE tm.email = v.viewer)
GROUP BY v.viewer
""")
def q_visible_assets_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-X4: the factorized visibility of every account and the anonymous viewer, summed up per viewer: how many assets,
    the sum of their numbers, how many of them published."""
    c = catalog(spark, sf_dir)
    scopes, scoped = access.visible_assets_batch(c.assets, c.domains, c.team_members, _flags(c), access.viewers_of(c.users))
    sums = access.summed_per_viewer(scopes, scoped, F.lit(1), F.substring("id", 2, 30).cast("long"), F.col("published").cast("int"))
    return sums.select("viewer", F.col("sum_0").alias("n_assets"), F.col("sum_1").alias("id_sum"), F.col("sum_2").alias("n_published"))


@query("visibility_scopes", f"""
SELECT viewer, 'published' AS scope, CAST(NULL AS VARCHAR) AS team_id FROM {o.VIEWERS} v
UNION ALL SELECT v.viewer, 'all', NULL FROM {o.VIEWERS} v JOIN {o.FLAGS} f ON v.viewer = f.email WHERE f.is_global
UNION ALL SELECT DISTINCT v.viewer, 'team', tm.team_id FROM {o.VIEWERS} v
  JOIN team_members tm ON v.viewer = tm.email
  WHERE v.viewer NOT IN (SELECT email FROM {o.FLAGS} f WHERE f.is_global AND email IS NOT NULL)
""")
def q_visibility_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scopes of every account and the anonymous viewer."""
    c = catalog(spark, sf_dir)
    return access.visibility_scopes(access.viewers_of(c.users), c.team_members, _flags(c))


@query("visible_asset_counts", f"""
SELECT v.viewer, count(a.id) AS n_assets FROM {o.VIEWERS} v
LEFT JOIN (SELECT a.*, d.team_id FROM assets a JOIN domains d ON a.domain_id = d.id) a
  ON a.published
  OR coalesce((SELECT f.is_global FROM {o.FLAGS} f WHERE f.email = v.viewer), false)
  OR a.team_id IN (SELECT team_id FROM team_members tm WHERE tm.email = v.viewer)
GROUP BY v.viewer
""")
def q_visible_asset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return access.visible_asset_counts(c.assets, c.domains, c.team_members, _flags(c), access.viewers_of(c.users))


@query("visible_domains", f"SELECT id, name, team_id FROM {o.visible_domains(p.MEMBER)} vd")
def q_visible_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return access.visible_domains(c.domains, c.team_members, _viewer_flags(c, p.MEMBER), p.MEMBER).select(
        "id", "name", "team_id")


@query("visible_domain_counts", f"""
SELECT v.viewer, CASE WHEN v.viewer IS NULL THEN 0
  WHEN coalesce((SELECT f.is_global FROM {o.FLAGS} f WHERE f.email = v.viewer), false)
    THEN (SELECT count(*) FROM domains)
  ELSE (SELECT count(*) FROM domains d JOIN team_members tm ON d.team_id = tm.team_id
        WHERE tm.email = v.viewer) END AS n_domains
FROM {o.VIEWERS} v
""")
def q_visible_domain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return access.visible_domain_counts(c.domains, c.team_members, _flags(c), access.viewers_of(c.users))


@query("visible_teams", f"""
SELECT t.id, t.name, t.description, t.is_platform FROM teams t
WHERE NOT t.is_platform AND ({o.is_global(p.GLOBAL)})
""")
def q_visible_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return access.visible_teams(c.teams, c.team_members, _viewer_flags(c, p.GLOBAL), p.GLOBAL)


@query("access_decisions", f"""
SELECT r.id, r.requester_email AS viewer, r.asset_id,
  (a.id IS NOT NULL AND (a.published OR coalesce(f.is_global, false) OR g.email IS NOT NULL)) AS allowed,
  CASE WHEN a.id IS NOT NULL AND (a.published OR coalesce(f.is_global, false) OR g.email IS NOT NULL)
       THEN 200 ELSE 404 END AS status
FROM access_requests r
LEFT JOIN (SELECT a.id, a.published, d.team_id FROM assets a JOIN domains d ON a.domain_id = d.id) a
  ON r.asset_id = a.id
LEFT JOIN (SELECT DISTINCT email, team_id FROM team_members) g
  ON g.email = r.requester_email AND g.team_id = a.team_id
LEFT JOIN (SELECT email, is_global FROM {o.FLAGS} f WHERE is_global) f ON f.email = r.requester_email
""")
def q_access_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-X8 over every access request: may the requester see the asset?"""
    c = catalog(spark, sf_dir)
    pairs = c.access_requests.select("id", F.col("requester_email").alias("viewer"), "asset_id")
    out = access.access_decisions(pairs, c.assets, c.domains, c.team_members, _flags(c))
    return out.withColumn("status", F.col("status").cast("int"))
