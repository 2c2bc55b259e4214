"""DuckDB text of the catalog projections (FIXTURES.md §2), used as CTEs.

Every oracle query reads the driver's tables through these CTEs, so the
oracle and the Spark job start from the same catalog rows.
"""

from __future__ import annotations

import re

from lakeward.sources.projection import FULL_LOG

# The projection rules of FIXTURES.md §2, as DuckDB SQL.
CTES: dict[str, str] = {
    "teams": """SELECT concat('T',n_nationkey) id, n_name name,
  concat('Team in ',r_name) description, n_nationkey = 0 is_platform
FROM nation JOIN region ON n_regionkey=r_regionkey""",
    "users": """SELECT concat('U',c_custkey) id,
  concat(lower(replace(c_name,'#','.')),'@example.com') email, c_custkey % 500 = 1 is_superadmin,
  CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END name, '' avatar,
  TIMESTAMP '2023-01-01 00:00:00' + c_custkey * INTERVAL '1' MINUTE created_at
FROM customer""",
    "team_members": """SELECT concat('M',c_custkey,'-0') id,
  concat('T',c_nationkey) team_id,
  concat(lower(replace(c_name,'#','.')),'@example.com') email,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'owner' WHEN 'BUILDING' THEN 'manager' ELSE 'member' END role
FROM customer WHERE c_custkey % 10 <> 9 UNION ALL SELECT concat('M',c_custkey,'-1'),
  concat('T',(c_nationkey+7)%25),
  concat(lower(replace(c_name,'#','.')),'@example.com'), 'member' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 10 <> 9""",
    "domains": """SELECT concat('D',s_suppkey) id, s_name name, '' description, '' owner_email,
  concat('T',s_nationkey) team_id, TIMESTAMP '2023-01-01 00:00:00' created_at, TIMESTAMP '2023-01-01 00:00:00' updated_at
FROM supplier""",
    "data_layers": """SELECT concat('L',r_regionkey) id, lower(r_name) name, '#9CA3AF' color, 4 - r_regionkey position,
  TIMESTAMP '2023-01-01 00:00:00' created_at
FROM region""",
    "assets": """SELECT concat('A',p_partkey) id,
  concat('D',p_partkey % (SELECT count(*)
FROM supplier)) domain_id, p_name name,
  concat(p_type,' ',p_brand) description,
  CASE WHEN p_size % 10 = 0 THEN '' ELSE CASE p_type WHEN 'STANDARD' THEN 'snowflake' WHEN 'PROMO' THEN 'bigquery' WHEN 'SMALL' THEN 'redshift' WHEN 'LARGE' THEN 'postgres' WHEN 'ECONOMY' THEN 's3' ELSE 'gcs' END END source_type,
  concat('dw.',lower(replace(p_brand,'#','_')),'.t',p_partkey) connection_uri,
  CASE p_partkey % 4 WHEN 0 THEN concat('[{"name":"id","type":"INT","nullable":false,"description":"key"},{"name":"c',p_size,'","type":"STRING"}]') WHEN 1 THEN concat('{"id":"INT","v',p_size,'":"DECIMAL"}') WHEN 2 THEN '{}' ELSE 'not json' END schema_json, '' owner_email,
  CASE WHEN p_size % 5 = 0 THEN '' ELSE concat(lower(p_type),', ',lower(replace(p_brand,'#','-')),',size',p_size % 3) END tags,
  CASE WHEN p_size % 7 = 0 THEN NULL ELSE (p_size % 21) / CAST(20 AS DOUBLE) END quality_score,
  CASE p_size % 6 WHEN 0 THEN '' WHEN 1 THEN 'real-time' WHEN 2 THEN 'hourly' WHEN 3 THEN 'daily' WHEN 4 THEN 'weekly' ELSE 'monthly' END freshness, (p_partkey + p_size) % 3 <> 0 published,
  c.created_at, c.updated_at,
  CASE WHEN p_partkey % 6 = 5 THEN NULL ELSE concat('L',p_partkey % 6) END layer_id
FROM part LEFT JOIN (SELECT l_partkey, min(l_shipdate) created_at, max(l_shipdate) updated_at FROM lineitem GROUP BY l_partkey) c ON l_partkey=p_partkey""",
    "access_requests": """SELECT concat('R',l_orderkey,'-',l_partkey) id,
  concat('A',l_partkey) asset_id,
  concat(lower(replace(c_name,'#','.')),'@example.com') requester_email,
  CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'denied' ELSE 'approved' END status, o_orderdate created_at,
  CASE WHEN o_orderstatus='P' THEN NULL ELSE greatest(o_orderdate, s) END decision_at
FROM (SELECT l_orderkey,l_partkey,max(l_shipdate) s FROM lineitem GROUP BY l_orderkey,l_partkey) l JOIN orders ON o_orderkey=l_orderkey JOIN customer ON c_custkey=o_custkey""",
    "change_log": """SELECT event_id seq, ts event_at,
  concat(lower(replace(c_name,'#','.')),'@example.com') actor_email,
  CASE event_type WHEN 'click' THEN 'update_asset' WHEN 'view' THEN 'publish_asset' WHEN 'error' THEN 'unpublish_asset' WHEN 'signup' THEN 'delete_asset' ELSE 'request_access' END op,
  concat('A',user_id*14 + CAST(json_extract_string(props,'$.k') AS INT)) target_id,
  CASE WHEN CAST(json_extract_string(props,'$.k') AS INT) % 10 = 0 OR event_type <> 'click' THEN NULL ELSE 'freshness' END field_name,
  CASE CAST(json_extract_string(props,'$.k') AS INT) % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'hourly' END field_value
FROM events JOIN customer ON c_custkey=user_id""",
}

CTES["full_log"] = """SELECT e seq, ts event_at, {columns}
FROM (SELECT event_id e, event_id // 24 m, user_id u, c_nationkey nat, ts,
        concat(lower(replace(c_name,'#','.')),'@example.com') own
      FROM events JOIN customer ON c_custkey=user_id),
     (SELECT count(*) n_cust, min(CASE WHEN c_nationkey = 0 AND c_custkey % 10 <> 9
        THEN concat(lower(replace(c_name,'#','.')),'@example.com') END) plat FROM customer),
     (SELECT count(*) n_supp FROM supplier)""".format(columns=",\n  ".join(f"{x} {c}" for c, x in FULL_LOG.items()))

_WORD = re.compile(r"[a-z_]+")


def with_catalog(sql: str) -> str:
    """Prefix ``sql`` with the CTEs of the catalog tables it names."""
    words = set(_WORD.findall(sql))
    names = [name for name in CTES if name in words]
    if not names:
        return sql
    body = ",\n".join(f"{name} AS (\n{CTES[name]}\n)" for name in names)
    head = sql.lstrip()
    if head[:4].upper() == "WITH" and not head[4:5].isalnum():
        return f"WITH {body},\n{head[4:].lstrip()}"
    return f"WITH {body}\n{sql}"
