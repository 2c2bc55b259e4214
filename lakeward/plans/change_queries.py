"""Registered queries of change sets (§2.10) over the projected change log.

The change log holds update_asset, publish_asset, unpublish_asset,
delete_asset and request_access records; the whole log is one batch
decided against the projected catalog.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward.operators import changes as chg
from lakeward.plans import oracle_sql as o
from lakeward.plans.registry import query
from lakeward.sources.projection import catalog

# DuckDB: one decision per change record of the asset ops and requests.
DECISIONS_SQL = f"""
WITH fl AS (SELECT email, is_global FROM {o.FLAGS} f),
dom AS (SELECT id, min(team_id) AS team_id FROM domains GROUP BY id),
tgt AS (SELECT a.id, a.name, a.owner_email, d.team_id, d.id IS NOT NULL AS has_domain
        FROM assets a LEFT JOIN dom d ON a.domain_id = d.id),
gr AS (SELECT DISTINCT email, team_id FROM team_members),
dec AS (
  SELECT c.seq, c.op, c.target_id, c.actor_email, c.event_at, c.field_name, c.field_value,
    CASE
      WHEN c.op = 'request_access' THEN CASE WHEN c.actor_email IS NULL THEN 422
                                             WHEN t.id IS NULL THEN 404 ELSE 201 END
      WHEN c.actor_email IS NULL THEN 401
      WHEN t.id IS NULL OR NOT t.has_domain THEN 404
      WHEN NOT (coalesce(fl.is_global, false) OR g.email IS NOT NULL) THEN 403
      WHEN c.op = 'update_asset' AND c.field_name IS NULL THEN 400
      WHEN c.op = 'delete_asset' THEN 204
      ELSE 200 END AS status,
    CASE
      WHEN c.op = 'request_access' THEN CASE WHEN c.actor_email IS NULL THEN 'requester_email is required'
                                             WHEN t.id IS NULL THEN 'Asset not found' ELSE 'ok' END
      WHEN c.actor_email IS NULL THEN 'Authentication required'
      WHEN t.id IS NULL OR NOT t.has_domain THEN 'Asset not found'
      WHEN NOT (coalesce(fl.is_global, false) OR g.email IS NOT NULL) THEN
        'Not authorized to ' || CASE c.op WHEN 'update_asset' THEN 'update' WHEN 'delete_asset' THEN 'delete'
                                          WHEN 'publish_asset' THEN 'publish' ELSE 'unpublish' END || ' this asset'
      WHEN c.op = 'update_asset' AND c.field_name IS NULL THEN 'No fields to update'
      ELSE 'ok' END AS reason,
    t.name AS asset_name, t.owner_email
  FROM change_log c
  LEFT JOIN tgt t ON c.target_id = t.id
  LEFT JOIN fl ON fl.email = c.actor_email
  LEFT JOIN gr g ON g.email = c.actor_email AND g.team_id = t.team_id
)"""


def _decisions(spark: SparkSession, sf_dir: str, op: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    log = c.change_log.select("seq", "event_at", "actor_email", "op", "target_id", "fields")
    # Decisions alone read the decided frame once: no need to cut its lineage.
    decided = chg.decided(c.tables(), log, materialize=False)
    return chg.decisions_of(decided).filter(F.col("op") == op).select("seq", "op", "target_id", "status", "reason")


def _decision_sql(op: str) -> str:
    target = ("CASE WHEN status < 300 THEN 'request-' || CAST(seq AS VARCHAR) ELSE target_id END"
              if op == "request_access" else "target_id")
    return (DECISIONS_SQL + f"\nSELECT seq, op, {target} AS target_id, CAST(status AS INTEGER) AS status, reason "
            f"FROM dec WHERE op = '{op}'")


@query("update_asset", _decision_sql("update_asset"))
def q_update_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-C2 decisions: 401, 422, 404, 403, 400 or 200 per update record."""
    return _decisions(spark, sf_dir, "update_asset")


@query("delete_asset", _decision_sql("delete_asset"))
def q_delete_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-C3 decisions."""
    return _decisions(spark, sf_dir, "delete_asset")


@query("publish_asset", _decision_sql("publish_asset"))
def q_publish_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-C4 decisions."""
    return _decisions(spark, sf_dir, "publish_asset")


@query("unpublish_asset", _decision_sql("unpublish_asset"))
def q_unpublish_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-C5 decisions."""
    return _decisions(spark, sf_dir, "unpublish_asset")


@query("request_access", _decision_sql("request_access"))
def q_request_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-C24 decisions (new request id on success)."""
    return _decisions(spark, sf_dir, "request_access")


CHANGED_ASSETS_SQL = DECISIONS_SQL + """,
ok AS (SELECT * FROM dec WHERE status < 300),
fresh AS (SELECT target_id, field_value AS freshness FROM (
    SELECT target_id, field_value, row_number() OVER (PARTITION BY target_id ORDER BY seq DESC) AS rn
    FROM ok WHERE op = 'update_asset') x WHERE rn = 1),
flag AS (SELECT target_id, op = 'publish_asset' AS published FROM (
    SELECT target_id, op, row_number() OVER (PARTITION BY target_id ORDER BY seq DESC) AS rn
    FROM ok WHERE op IN ('publish_asset', 'unpublish_asset')) x WHERE rn = 1),
stamp AS (SELECT target_id, max(event_at) AS last_at FROM ok
          WHERE op IN ('update_asset', 'publish_asset', 'unpublish_asset') GROUP BY target_id),
gone AS (SELECT DISTINCT target_id FROM ok WHERE op = 'delete_asset')
SELECT a.id, CASE WHEN fr.target_id IS NOT NULL THEN fr.freshness ELSE a.freshness END AS freshness,
       coalesce(fg.published, a.published) AS published, coalesce(s.last_at, a.updated_at) AS updated_at
FROM assets a
LEFT JOIN fresh fr ON fr.target_id = a.id
LEFT JOIN flag fg ON fg.target_id = a.id
LEFT JOIN stamp s ON s.target_id = a.id
WHERE a.id NOT IN (SELECT target_id FROM gone)
"""


@query("changed_assets", CHANGED_ASSETS_SQL)
def q_changed_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assets table after the whole change log (updates, flags, deletes)."""
    c = catalog(spark, sf_dir)
    log = c.change_log.select("seq", "event_at", "actor_email", "op", "target_id", "fields")
    tables, _ = chg.apply_changes(c.tables(), log)
    return tables["assets"].select("id", "freshness", "published", "updated_at")


@query("changed_requests", DECISIONS_SQL + """
SELECT r.id, r.asset_id, r.requester_email, r.status FROM access_requests r
WHERE r.asset_id NOT IN (SELECT target_id FROM dec WHERE op = 'delete_asset' AND status < 300)
UNION ALL
SELECT 'request-' || CAST(seq AS VARCHAR), target_id, actor_email, 'pending' FROM dec
WHERE op = 'request_access' AND status < 300
  AND target_id NOT IN (SELECT target_id FROM dec WHERE op = 'delete_asset' AND status < 300)
""")
def q_changed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access requests after the log: new pending rows, deleted assets' requests cascaded away."""
    c = catalog(spark, sf_dir)
    log = c.change_log.select("seq", "event_at", "actor_email", "op", "target_id", "fields")
    tables, _ = chg.apply_changes(c.tables(), log)
    return tables["access_requests"].select("id", "asset_id", "requester_email", "status")


@query("request_notifications", DECISIONS_SQL + """
SELECT seq, owner_email AS notify_to, 'Access request for data asset: ' || asset_name AS subject,
  'User ' || actor_email || ' has requested access to the data asset ''' || asset_name || '''.'
    || chr(10) || chr(10) || 'Message: (none)' || chr(10) || chr(10)
    || 'Please review the request in the catalog UI.' AS body
FROM dec WHERE op = 'request_access' AND status < 300
""")
def q_request_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One owner notification per accepted access request."""
    c = catalog(spark, sf_dir)
    log = c.change_log.select("seq", "event_at", "actor_email", "op", "target_id", "fields")
    return chg.notifications(c.tables(), log)
