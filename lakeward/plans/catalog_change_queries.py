"""Registered queries of all 24 change ops (§2.10) over a change log that holds every op, and of the tables after it.

The log (``projection.full_log``) has missing actors, bad fields, unknown
targets, and names that several changes claim, free and take again.  Each
op's query decides that op's records, together with the ops whose claims and
deletes its names depend on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward.operators import changes as chg
from lakeward.plans import oracle_sql as o
from lakeward.plans.registry import query
from lakeward.sources.projection import catalog

ANON = "WHEN anon THEN '401 Authentication required'"
NOT_ADMIN = "WHEN NOT g THEN '403 Superadmin access required'"
BAD_SCORE = "f_quality_score IS NOT NULL AND TRY_CAST(f_quality_score AS DOUBLE) IS NULL"
BAD_ROLE = "'400 Role must be ''manager'' or ''member'' '"


def _asset_rule(verb: str) -> str:
    return (f"CASE {ANON} WHEN NOT a_ok THEN '404 Asset not found' "
            f"WHEN NOT (g OR member) THEN '403 Not authorized to {verb} this asset' END")


# DuckDB: every record with what its rules look up (c), its status by all rules but those on names (pre, NULL if they
# pass), the names claimed and freed, and the final status.
DECIDED_SQL = f"""
WITH fl AS (SELECT email, is_global, is_platform FROM {o.FLAGS} f),
gr AS (SELECT email, team_id, bool_or(role IN ('manager', 'owner')) AS mgr, bool_or(role = 'owner') AS owner FROM team_members GROUP BY email, team_id),
dom AS (SELECT id, min(team_id) AS team_id FROM domains GROUP BY id),
ast AS (SELECT a.id, a.name, a.owner_email, d.team_id, d.id IS NOT NULL AS has_domain FROM assets a LEFT JOIN dom d ON a.domain_id = d.id),
b AS (
  SELECT l.*, l.actor_email IS NULL AS anon, coalesce(fl.is_global, false) AS g, coalesce(fl.is_platform, false) AS p,
    a.id IS NOT NULL AND a.has_domain AS a_ok, a.id IS NOT NULL AS a_found, a.name AS a_name, a.owner_email AS a_owner,
    d.id IS NOT NULL AS d_ok, t.id IS NOT NULL AS t_ok, coalesce(t.is_platform, false) AS t_plat, u.id IS NOT NULL AS u_ok, u.email AS u_email,
    y.id IS NOT NULL AS y_ok, me.id AS me_id, rd.id IS NOT NULL AS rd_ok, rt.id IS NOT NULL AS rt_ok, ru.id IS NOT NULL AS ru_ok,
    CASE WHEN l.op IN ('update_asset', 'delete_asset', 'publish_asset', 'unpublish_asset') THEN a.team_id
         WHEN l.op IN ('update_domain', 'delete_domain') THEN d.team_id WHEN l.op = 'create_asset' THEN rd.team_id
         WHEN l.op = 'create_domain' THEN l.f_team_id ELSE l.target_id END AS g_team,
    CASE WHEN l.op IN ('assign_user', 'unassign_user') THEN l.f_team_id WHEN l.op IN ('add_member', 'change_role', 'remove_member') THEN l.target_id END AS m_team,
    CASE WHEN l.op IN ('assign_user', 'unassign_user') THEN u.email WHEN l.op IN ('add_member', 'change_role', 'remove_member') THEN l.f_email END AS m_email
  FROM full_log l
  LEFT JOIN fl ON fl.email = l.actor_email
  LEFT JOIN ast a ON a.id = l.target_id LEFT JOIN dom d ON d.id = l.target_id LEFT JOIN teams t ON t.id = l.target_id
  LEFT JOIN users u ON u.id = l.target_id LEFT JOIN data_layers y ON y.id = l.target_id LEFT JOIN users me ON me.email = l.actor_email
  LEFT JOIN dom rd ON rd.id = l.f_domain_id LEFT JOIN teams rt ON rt.id = l.f_team_id LEFT JOIN users ru ON ru.email = l.f_email),
c AS (
  SELECT b.*, gr.email IS NOT NULL AS member, coalesce(gr.mgr, false) AS mgr, coalesce(gr.owner, false) AS owner, m.email IS NOT NULL AS stood
  FROM b LEFT JOIN gr ON gr.email = b.actor_email AND gr.team_id = b.g_team
  LEFT JOIN (SELECT DISTINCT email, team_id FROM team_members) m ON m.email = b.m_email AND m.team_id = b.m_team),
pre AS (
  SELECT c.*, rtrim(CASE op
    WHEN 'create_asset' THEN CASE {ANON}
      WHEN f_domain_id IS NULL OR f_name IS NULL OR NOT length(f_name) BETWEEN 1 AND 256 OR {BAD_SCORE} THEN '422 Invalid asset fields'
      WHEN NOT rd_ok THEN '400 Domain not found' WHEN NOT (g OR member) THEN '403 Not authorized to create assets in this domain' END
    WHEN 'update_asset' THEN CASE {ANON} WHEN {BAD_SCORE} THEN '422 quality_score must be a number'
      WHEN NOT a_ok THEN '404 Asset not found' WHEN NOT (g OR member) THEN '403 Not authorized to update this asset'
      WHEN f_freshness IS NULL AND f_quality_score IS NULL THEN '400 No fields to update' END
    WHEN 'delete_asset' THEN {_asset_rule('delete')}
    WHEN 'publish_asset' THEN {_asset_rule('publish')}
    WHEN 'unpublish_asset' THEN {_asset_rule('unpublish')}
    WHEN 'create_domain' THEN CASE {ANON} WHEN NOT length(f_name) BETWEEN 1 AND 128 THEN '422 Invalid domain name'
      WHEN NOT (p OR mgr) THEN '403 Only team managers can create domains' WHEN NOT rt_ok THEN '400 Team not found' END
    WHEN 'update_domain' THEN CASE {ANON} WHEN NOT d_ok THEN '404 Domain not found'
      WHEN NOT (p OR mgr) THEN '403 Only team managers can update domains' WHEN f_name IS NULL AND f_description IS NULL THEN '400 No fields to update' END
    WHEN 'delete_domain' THEN CASE {ANON} WHEN NOT d_ok THEN '404 Domain not found' WHEN NOT (p OR mgr) THEN '403 Only team managers can delete domains' END
    WHEN 'create_team' THEN CASE {ANON} WHEN NOT length(f_name) BETWEEN 1 AND 128 THEN '422 Invalid team name' END
    WHEN 'update_team' THEN CASE {ANON} WHEN NOT (g OR owner) THEN '403 Only team owners can modify this team'
      WHEN NOT t_ok THEN '404 Team not found' WHEN t_plat THEN '403 Cannot modify platform team' WHEN f_name IS NULL AND f_description IS NULL THEN '400 No fields to update' END
    WHEN 'delete_team' THEN CASE {ANON} WHEN NOT (g OR owner) THEN '403 Only team owners can modify this team'
      WHEN NOT t_ok THEN '404 Team not found' WHEN t_plat THEN '403 Cannot delete platform team' END
    WHEN 'add_member' THEN CASE {ANON} WHEN f_email IS NULL THEN '422 email is required'
      WHEN NOT (p OR mgr) THEN '403 Only team managers can manage members' WHEN coalesce(f_role, 'member') NOT IN ('manager', 'member') THEN {BAD_ROLE}
      WHEN NOT ru_ok THEN '400 No user account found for that email' WHEN NOT t_ok THEN '404 Team not found' END
    WHEN 'change_role' THEN CASE {ANON} WHEN f_role IS NULL OR f_email IS NULL THEN '422 role and email are required'
      WHEN NOT (p OR mgr) THEN '403 Only team managers can manage members' WHEN f_role NOT IN ('manager', 'member') THEN {BAD_ROLE}
      WHEN NOT stood THEN '404 Member not found' END
    WHEN 'remove_member' THEN CASE {ANON} WHEN f_email IS NULL THEN '422 email is required' WHEN NOT (p OR mgr) THEN '403 Only team managers can manage members' END
    WHEN 'assign_user' THEN CASE WHEN f_team_id IS NULL THEN '422 team_id is required' {ANON} {NOT_ADMIN}
      WHEN coalesce(f_role, 'member') NOT IN ('manager', 'member') THEN {BAD_ROLE} WHEN NOT u_ok THEN '404 User not found' WHEN NOT rt_ok THEN '404 Team not found' END
    WHEN 'unassign_user' THEN CASE WHEN f_team_id IS NULL THEN '422 team_id is required' {ANON} {NOT_ADMIN} WHEN NOT u_ok THEN '404 User not found' END
    WHEN 'create_layer' THEN CASE WHEN NOT length(f_name) BETWEEN 1 AND 64 THEN '422 Invalid layer name' {ANON} {NOT_ADMIN}
      WHEN trim(f_name) = '' THEN '400 Name is required' END
    WHEN 'update_layer' THEN CASE WHEN f_position IS NOT NULL AND TRY_CAST(f_position AS INT) IS NULL THEN '422 position must be an integer' {ANON}
      {NOT_ADMIN} WHEN NOT y_ok THEN '404 Layer not found' WHEN f_name IS NULL AND f_color IS NULL AND f_position IS NULL THEN '400 No fields to update'
      WHEN trim(f_name) = '' THEN '400 Name is required' END
    WHEN 'delete_layer' THEN CASE {ANON} {NOT_ADMIN} WHEN NOT y_ok THEN '404 Layer not found' END
    WHEN 'register_user' THEN CASE WHEN coalesce(length(f_email), 0) < 1 THEN '422 Invalid e-mail' WHEN NOT anon AND NOT g THEN '403 Superadmin access required' END
    WHEN 'set_superadmin' THEN CASE WHEN f_promote IS NULL OR f_promote = 'maybe' THEN '422 promote must be a boolean' {ANON} {NOT_ADMIN}
      WHEN NOT u_ok THEN '404 User not found' WHEN u_email = actor_email AND f_promote <> 'true' THEN '400 Cannot remove your own superadmin status' END
    WHEN 'delete_user' THEN CASE {ANON} {NOT_ADMIN} WHEN NOT u_ok THEN '404 User not found' WHEN u_email = actor_email THEN '400 Cannot delete your own account' END
    WHEN 'update_profile' THEN CASE WHEN length(f_name) > 128 THEN '422 Invalid profile name' {ANON}
      WHEN f_avatar IS NOT NULL AND f_avatar <> '' AND f_avatar NOT LIKE 'data:image/%' THEN '400 avatar must be a data: image URL'
      WHEN f_name IS NULL AND f_avatar IS NULL THEN '400 No fields to update' WHEN me_id IS NULL THEN '404 User not found' END
    WHEN 'request_access' THEN CASE WHEN coalesce(f_requester_email, actor_email) IS NULL THEN '422 requester_email is required' WHEN NOT a_found THEN '404 Asset not found' END
    END) AS pre
  FROM c),
ok0 AS (SELECT * FROM pre WHERE pre IS NULL),
-- When the row that holds a name at batch start first goes away (renames are to names that nobody else claims).
leaves AS (
  SELECT 'd' AS k, target_id AS id, seq FROM ok0 WHERE op = 'delete_domain' OR op = 'update_domain' AND f_name IS NOT NULL
  UNION ALL SELECT 'd', d.id, x.seq FROM ok0 x JOIN domains d ON d.team_id = x.target_id WHERE x.op = 'delete_team'
  UNION ALL SELECT 'y', target_id, seq FROM ok0 WHERE op = 'delete_layer' OR op = 'update_layer' AND f_name IS NOT NULL
  UNION ALL SELECT 'u', target_id, seq FROM ok0 WHERE op = 'delete_user'),
free AS (
  SELECT h.k, h.name, coalesce(min(l.seq), 9223372036854775807) AS since
  FROM (SELECT 'd' AS k, name, id FROM domains UNION ALL SELECT 'y', lower(name), id FROM data_layers UNION ALL SELECT 'u', email, id FROM users) h
  LEFT JOIN leaves l ON l.k = h.k AND l.id = h.id GROUP BY h.k, h.name),
wants AS (
  SELECT seq, CASE op WHEN 'create_domain' THEN 'd' WHEN 'create_layer' THEN 'y' ELSE 'u' END AS k,
    CASE op WHEN 'create_domain' THEN f_name WHEN 'create_layer' THEN lower(trim(f_name)) ELSE f_email END AS name
  FROM ok0 WHERE op IN ('create_domain', 'create_layer', 'register_user')),
won AS (SELECT w.k, w.name, min(w.seq) AS seq FROM wants w LEFT JOIN free f ON f.k = w.k AND f.name = w.name WHERE w.seq > coalesce(f.since, -1) GROUP BY w.k, w.name),
-- A membership is there after every change that wants it there, and gone after every removal.
told AS (SELECT seq, op, lag(op) OVER (PARTITION BY m_team, m_email ORDER BY seq) AS last_op, stood
         FROM ok0 WHERE op IN ('add_member', 'assign_user', 'remove_member', 'unassign_user')),
lost AS (
  SELECT w.seq FROM wants w LEFT JOIN won ON won.seq = w.seq WHERE won.seq IS NULL
  UNION ALL SELECT seq FROM told WHERE op = 'add_member' AND CASE WHEN last_op IS NULL THEN stood ELSE last_op IN ('add_member', 'assign_user') END),
fin AS (
  SELECT p.*, coalesce(p.pre, CASE WHEN l.seq IS NULL THEN NULL WHEN p.op = 'create_domain' THEN '409 Domain name already exists'
      WHEN p.op = 'create_layer' THEN '409 A layer with that name already exists' WHEN p.op = 'register_user' THEN '400 Email already registered'
      ELSE '400 User is already a member of this team' END,
    CASE WHEN p.op IN ('create_asset', 'create_domain', 'create_team', 'add_member', 'assign_user', 'create_layer', 'register_user', 'request_access') THEN '201 ok'
         WHEN p.op IN ('delete_asset', 'delete_domain', 'delete_team', 'remove_member', 'unassign_user', 'delete_layer', 'delete_user') THEN '204 ok' ELSE '200 ok' END) AS said
  FROM pre p LEFT JOIN lost l ON l.seq = p.seq),
ok AS (SELECT * FROM fin WHERE said LIKE '20_ ok')"""

MADE = {"create_asset": "asset-", "create_domain": "domain-", "create_team": "team-", "add_member": "member-", "create_layer": "layer-",
        "register_user": "user-", "request_access": "request-"}

#: Ops whose claims, moves and removals the names of an op depend on.
_GROUPS = (("create_domain", "update_domain", "delete_domain", "delete_team"), ("create_layer", "update_layer", "delete_layer"),
           ("register_user", "delete_user"), ("add_member", "assign_user", "remove_member", "unassign_user"))
NEEDS = {op: set(group) for op in chg.CLAIM_OPS for group in _GROUPS if op in group}


def _decide_sql(op: str) -> str:
    made = f"CASE WHEN said LIKE '20_ ok' THEN '{MADE[op]}' || seq ELSE target_id END" if op in MADE else "target_id"
    return DECIDED_SQL + (f"\nSELECT seq, op, {made} AS target_id, CAST(left(said, 3) AS INTEGER) AS status, substr(said, 5) AS reason "
                          f"FROM fin WHERE op = '{op}'")


def _register(op: str, name: str) -> None:
    @query(name, _decide_sql(op))
    def decide_op(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = catalog(spark, sf_dir)
        log = c.full_log.where(F.col("op").isin(sorted(NEEDS.get(op, {op}))))
        decided = chg.decided(c.tables(), log, materialize=False)
        return chg.decisions_of(decided).filter(F.col("op") == op).select("seq", "op", "target_id", "status", "reason")

    decide_op.__doc__ = f"Decisions of every {op} record of the full log."


#: Ops that have a query of their own name over the smaller change log; here they are decided over the full log.
OTHER_LOG = ("update_asset", "delete_asset", "publish_asset", "unpublish_asset", "request_access")
for _op in chg.ALL_OPS:
    _register(_op, f"{_op}_full" if _op in OTHER_LOG else _op)


def _after(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    tables, _ = chg.apply_changes(c.tables(), c.full_log)
    return tables[name]


LAST = """
last_of AS (
  SELECT id, max_by(name, seq) FILTER (name IS NOT NULL) AS name, max_by(description, seq) FILTER (description IS NOT NULL) AS description,
    max_by(color, seq) FILTER (color IS NOT NULL) AS color, max_by(position, seq) FILTER (position IS NOT NULL) AS position,
    max_by(avatar, seq) FILTER (avatar IS NOT NULL) AS avatar, max_by(admin, seq) FILTER (admin IS NOT NULL) AS admin,
    max_by(freshness, seq) FILTER (freshness IS NOT NULL) AS freshness, max_by(score, seq) FILTER (score IS NOT NULL) AS score,
    max_by(flag, seq) FILTER (flag IS NOT NULL) AS flag, max(event_at) AS last_at
  FROM (SELECT seq, event_at, CASE WHEN op = 'update_profile' THEN me_id ELSE target_id END AS id,
          CASE WHEN op IN ('update_layer', 'update_profile') THEN trim(f_name) ELSE f_name END AS name, f_description AS description, f_color AS color,
          f_position AS position, f_avatar AS avatar, f_promote = 'true' AS admin, f_freshness AS freshness, f_quality_score AS score,
          CASE op WHEN 'publish_asset' THEN true WHEN 'unpublish_asset' THEN false END AS flag
        FROM ok WHERE op IN ('update_asset', 'publish_asset', 'unpublish_asset', 'update_domain', 'update_team', 'update_layer', 'set_superadmin', 'update_profile'))
  GROUP BY id),
went AS (SELECT target_id AS id FROM ok WHERE op IN ('delete_asset', 'delete_domain', 'delete_team', 'delete_layer', 'delete_user')),
new_domains AS (SELECT 'domain-' || seq AS id, f_name AS name, '' AS description, f_team_id AS team_id, event_at AS created_at, event_at AS updated_at
                FROM ok WHERE op = 'create_domain'),
all_domains AS (SELECT id, name, description, team_id, created_at, updated_at FROM domains UNION ALL SELECT * FROM new_domains),
gone_domains AS (SELECT id FROM all_domains WHERE id IN (SELECT id FROM went) OR team_id IN (SELECT id FROM went)),
all_assets AS (
  SELECT id, domain_id, name, freshness, published, quality_score, layer_id, updated_at FROM assets
  UNION ALL SELECT 'asset-' || seq, f_domain_id, f_name, '', false, CAST(f_quality_score AS DOUBLE), NULL, event_at FROM ok WHERE op = 'create_asset'),
gone_assets AS (SELECT id FROM all_assets WHERE id IN (SELECT id FROM went) OR domain_id IN (SELECT id FROM gone_domains))"""


@query("changed_domains", DECIDED_SQL + "," + LAST + """
SELECT d.id, coalesce(l.name, d.name) AS name, coalesce(l.description, d.description) AS description, d.team_id, d.created_at,
  coalesce(l.last_at, d.updated_at) AS updated_at
FROM all_domains d LEFT JOIN last_of l ON l.id = d.id WHERE d.id NOT IN (SELECT id FROM gone_domains)
""")
def q_changed_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains after the full log: created, renamed, deleted directly and with their teams."""
    return _after(spark, sf_dir, "domains").select("id", "name", "description", "team_id", "created_at", "updated_at")


@query("changed_teams", DECIDED_SQL + "," + LAST + """
SELECT t.id, coalesce(l.name, t.name) AS name, coalesce(l.description, t.description) AS description, t.is_platform
FROM (SELECT id, name, description, is_platform FROM teams
      UNION ALL SELECT 'team-' || seq, f_name, coalesce(f_description, ''), false FROM ok WHERE op = 'create_team') t
LEFT JOIN last_of l ON l.id = t.id WHERE t.id NOT IN (SELECT id FROM went)
""")
def q_changed_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teams after the full log."""
    return _after(spark, sf_dir, "teams").select("id", "name", "description", "is_platform")


@query("changed_layers", DECIDED_SQL + "," + LAST + """
SELECT y.id, coalesce(l.name, y.name) AS name, coalesce(l.color, y.color) AS color, CAST(coalesce(TRY_CAST(l.position AS INT), y.position) AS INTEGER) AS position
FROM (SELECT id, name, color, position FROM data_layers
      UNION ALL SELECT 'layer-' || seq, trim(f_name), coalesce(f_color, '#9CA3AF'),
        (SELECT max(position) FROM data_layers) + row_number() OVER (ORDER BY seq) FROM ok WHERE op = 'create_layer') y
LEFT JOIN last_of l ON l.id = y.id WHERE y.id NOT IN (SELECT id FROM went)
""")
def q_changed_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers after the full log: new ones appended in the order of seq."""
    return _after(spark, sf_dir, "data_layers").select("id", "name", "color", "position")


@query("changed_users", DECIDED_SQL + "," + LAST + """
SELECT u.id, u.email, coalesce(l.admin, u.is_superadmin) AS is_superadmin, coalesce(l.name, u.name) AS name, coalesce(l.avatar, u.avatar) AS avatar, u.created_at
FROM (SELECT id, email, is_superadmin, name, avatar, created_at FROM users
      UNION ALL SELECT 'user-' || seq, f_email, false, coalesce(f_name, ''), '', event_at FROM ok WHERE op = 'register_user') u
LEFT JOIN last_of l ON l.id = u.id WHERE u.id NOT IN (SELECT id FROM went)
""")
def q_changed_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts after the full log."""
    return _after(spark, sf_dir, "users").select("id", "email", "is_superadmin", "name", "avatar", "created_at")


@query("changed_members", DECIDED_SQL + "," + LAST + """,
ev AS (
  SELECT m_team AS t, m_email AS e, seq, op IN ('add_member', 'assign_user') AS put, op IN ('remove_member', 'unassign_user') AS cut,
    CASE WHEN op = 'change_role' THEN f_role WHEN op IN ('add_member', 'assign_user') THEN coalesce(f_role, 'member') END AS role, 'member-' || seq AS id
  FROM ok WHERE op IN ('add_member', 'assign_user', 'change_role', 'remove_member', 'unassign_user')
  UNION ALL SELECT 'team-' || seq, actor_email, seq, true, false, 'owner', 'owner-' || seq FROM ok WHERE op = 'create_team'),
net AS (
  SELECT t, e, max(seq) FILTER (put) AS put, max(seq) FILTER (cut) AS cut, max_by(role, seq) FILTER (role IS NOT NULL) AS role,
    min_by(id, seq) FILTER (put) AS first_id, max_by(id, seq) FILTER (put) AS last_id FROM ev GROUP BY t, e),
met AS (
  SELECT CASE WHEN m.id IS NOT NULL AND n.cut IS NULL THEN m.id WHEN n.cut IS NOT NULL THEN n.last_id ELSE n.first_id END AS id,
    coalesce(m.team_id, n.t) AS team_id, coalesce(m.email, n.e) AS email, coalesce(n.role, m.role) AS role
  FROM team_members m FULL OUTER JOIN net n ON n.t = m.team_id AND n.e = m.email
  WHERE CASE WHEN n.cut IS NOT NULL THEN coalesce(n.put > n.cut, false) ELSE m.id IS NOT NULL OR n.put IS NOT NULL END)
SELECT id, team_id, email, role FROM met
WHERE team_id NOT IN (SELECT id FROM went) AND email NOT IN (SELECT u_email FROM ok WHERE op = 'delete_user')
""")
def q_changed_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memberships after the full log: added, assigned, changed, removed, gone with their team or user."""
    return _after(spark, sf_dir, "team_members").select("id", "team_id", "email", "role")


@query("changed_assets_full", DECIDED_SQL + "," + LAST + """
SELECT a.id, a.domain_id, a.name, coalesce(l.freshness, a.freshness) AS freshness, coalesce(l.flag, a.published) AS published,
  coalesce(CAST(l.score AS DOUBLE), a.quality_score) AS quality_score, CASE WHEN a.layer_id IN (SELECT id FROM went) THEN NULL ELSE a.layer_id END AS layer_id,
  coalesce(l.last_at, a.updated_at) AS updated_at
FROM all_assets a LEFT JOIN last_of l ON l.id = a.id WHERE a.id NOT IN (SELECT id FROM gone_assets)
""")
def q_changed_assets_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets after the full log: with the cascades of teams and domains, and of layers."""
    return _after(spark, sf_dir, "assets").select("id", "domain_id", "name", "freshness", "published", "quality_score", "layer_id", "updated_at")


@query("changed_requests_full", DECIDED_SQL + "," + LAST + """
SELECT id, asset_id, requester_email, status FROM (
  SELECT id, asset_id, requester_email, status FROM access_requests
  UNION ALL SELECT 'request-' || seq, target_id, coalesce(f_requester_email, actor_email), 'pending' FROM ok WHERE op = 'request_access') r
WHERE asset_id NOT IN (SELECT id FROM gone_assets)
""")
def q_changed_requests_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access requests after the full log."""
    return _after(spark, sf_dir, "access_requests").select("id", "asset_id", "requester_email", "status")
