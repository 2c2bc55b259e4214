"""Catalog tables projected from the driver's TPC-H-like parquet tables.

This module only builds stand-in input: rows in the catalog schema, derived
by Spark from the given tables so that every job's work grows with them.
It does none of the operators' work.  The projection rules are fixed by
FIXTURES.md §2 (the oracle SQL in ``lakeward.plans.oracle`` states the same
rules as DuckDB CTEs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward.sources import schemas

_READS: dict[tuple[str, int, str], DataFrame] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a lazy DataFrame.

    The definition (file listing and footer schema, no data) is kept per
    session and path, as a table registered in a catalog would be; the
    driver's folders are read-only.
    """
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, id(spark), path)
    if key not in _READS:
        _READS[key] = spark.read.parquet(path)
    return _READS[key]


EMAIL_SQL = "concat(lower(replace({c}, '#', '.')), '@example.com')"
TS0 = "TIMESTAMP_NTZ '2023-01-01 00:00:00'"


def _x(*exprs: str) -> list[Column]:
    return [F.expr(e) for e in exprs]


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(*_x(
        "concat('T', n_nationkey) AS id", "n_name AS name", "concat('Team in ', r_name) AS description",
        "n_nationkey = 0 AS is_platform"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer").select(*_x(
        "concat('U', c_custkey) AS id", EMAIL_SQL.format(c="c_name") + " AS email",
        "c_custkey % 500 = 1 AS is_superadmin", "CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END AS name",
        "'' AS avatar", f"timestampadd(MINUTE, c_custkey, {TS0}) AS created_at"))


def team_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = read_table(spark, sf_dir, "customer").filter("c_custkey % 10 <> 9")
    first = customer.select(*_x(
        "concat('M', c_custkey, '-0') AS id", "concat('T', c_nationkey) AS team_id",
        EMAIL_SQL.format(c="c_name") + " AS email",
        "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'owner' WHEN 'BUILDING' THEN 'manager' ELSE 'member' END AS role"))
    second = customer.filter("c_custkey % 3 = 0").select(*_x(
        "concat('M', c_custkey, '-1') AS id", "concat('T', (c_nationkey + 7) % 25) AS team_id",
        EMAIL_SQL.format(c="c_name") + " AS email", "'member' AS role"))
    return first.unionByName(second)


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "supplier").select(*_x(
        "concat('D', s_suppkey) AS id", "s_name AS name", "'' AS description", "'' AS owner_email",
        "concat('T', s_nationkey) AS team_id", f"{TS0} AS created_at", f"{TS0} AS updated_at"))


def data_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "region").select(*_x(
        "concat('L', r_regionkey) AS id", "lower(r_name) AS name", "'#9CA3AF' AS color",
        "CAST(4 - r_regionkey AS INT) AS position", f"{TS0} AS created_at"))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part")
    supplier = read_table(spark, sf_dir, "supplier")
    lineitem = read_table(spark, sf_dir, "lineitem")
    n_suppliers = supplier.select(F.count(F.lit(1))).scalar()
    ship = lineitem.groupBy("l_partkey").agg(
        F.min("l_shipdate").alias("created_at"), F.max("l_shipdate").alias("updated_at"))
    return part.join(ship, part.p_partkey == ship.l_partkey, "left").select(
        F.expr("concat('A', p_partkey) AS id"),
        F.concat(F.lit("D"), F.col("p_partkey") % n_suppliers).alias("domain_id"),
        *_x("p_name AS name", "concat(p_type, ' ', p_brand) AS description",
            "CASE WHEN p_size % 10 = 0 THEN '' ELSE CASE p_type WHEN 'STANDARD' THEN 'snowflake' "
            "WHEN 'PROMO' THEN 'bigquery' WHEN 'SMALL' THEN 'redshift' WHEN 'LARGE' THEN 'postgres' "
            "WHEN 'ECONOMY' THEN 's3' ELSE 'gcs' END END AS source_type",
            "concat('dw.', lower(replace(p_brand, '#', '_')), '.t', p_partkey) AS connection_uri",
            "CASE p_partkey % 4 WHEN 0 THEN concat('[{\"name\":\"id\",\"type\":\"INT\",\"nullable\":false,"
            "\"description\":\"key\"},{\"name\":\"c', p_size, '\",\"type\":\"STRING\"}]') "
            "WHEN 1 THEN concat('{\"id\":\"INT\",\"v', p_size, '\":\"DECIMAL\"}') WHEN 2 THEN '{}' "
            "ELSE 'not json' END AS schema_json",
            "'' AS owner_email",
            "CASE WHEN p_size % 5 = 0 THEN '' ELSE concat(lower(p_type), ', ', "
            "lower(replace(p_brand, '#', '-')), ',size', p_size % 3) END AS tags",
            "CASE WHEN p_size % 7 = 0 THEN NULL ELSE (p_size % 21) / CAST(20 AS DOUBLE) END AS quality_score",
            "CASE p_size % 6 WHEN 0 THEN '' WHEN 1 THEN 'real-time' WHEN 2 THEN 'hourly' WHEN 3 THEN 'daily' "
            "WHEN 4 THEN 'weekly' ELSE 'monthly' END AS freshness",
            "(p_partkey + p_size) % 3 <> 0 AS published", "created_at", "updated_at",
            "CASE WHEN p_partkey % 6 = 5 THEN NULL ELSE concat('L', p_partkey % 6) END AS layer_id"),
    )


def access_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = read_table(spark, sf_dir, "lineitem")
    orders = read_table(spark, sf_dir, "orders")
    customer = read_table(spark, sf_dir, "customer")
    # The lines, the largest side, are shuffled once: grouped within their order, and joined with orders that have their customer.
    lines = (lineitem.select("l_orderkey", "l_partkey", "l_shipdate").repartition("l_orderkey")
             .groupBy("l_orderkey", "l_partkey").agg(F.max("l_shipdate").alias("s")))
    ordered = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return (
        lines.join(ordered, lines.l_orderkey == ordered.o_orderkey)
        .select(*_x(
            "concat('R', l_orderkey, '-', l_partkey) AS id", "concat('A', l_partkey) AS asset_id",
            EMAIL_SQL.format(c="c_name") + " AS requester_email",
            "CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'denied' ELSE 'approved' END AS status",
            "o_orderdate AS created_at",
            "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE greatest(o_orderdate, s) END AS decision_at"))
    )


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change records in the ``schemas.CHANGES`` shape (plus flat field columns)."""
    events = read_table(spark, sf_dir, "events")
    customer = read_table(spark, sf_dir, "customer")
    k = "CAST(get_json_object(props, '$.k') AS INT)"
    return events.join(customer, customer.c_custkey == events.user_id).select(*_x(
        "event_id AS seq", "ts AS event_at", EMAIL_SQL.format(c="c_name") + " AS actor_email",
        "CASE event_type WHEN 'click' THEN 'update_asset' WHEN 'view' THEN 'publish_asset' "
        "WHEN 'error' THEN 'unpublish_asset' WHEN 'signup' THEN 'delete_asset' ELSE 'request_access' END AS op",
        f"concat('A', user_id * 14 + {k}) AS target_id",
        f"CASE WHEN {k} % 10 = 0 OR event_type <> 'click' THEN NULL ELSE 'freshness' END AS field_name",
        f"CASE {k} % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'hourly' END AS field_value",
    )).selectExpr("*", "CASE WHEN field_name IS NOT NULL THEN map(field_name, field_value) "
                       "ELSE CAST(map() AS MAP<STRING, STRING>) END AS fields")


# Change records of all 24 ops: the columns of ``full_log`` over an event (e its id, m = e div 24, u its user) and its
# customer (own e-mail, nat); n_cust, n_supp and plat (a platform member's e-mail) are the same for all.  The text is
# read by Spark and, as a CTE, by the oracle.
OPS_IN_ORDER = ("create_asset", "update_asset", "delete_asset", "publish_asset", "unpublish_asset", "create_domain", "update_domain",
                "delete_domain", "create_team", "update_team", "delete_team", "add_member", "change_role", "remove_member", "assign_user",
                "unassign_user", "create_layer", "update_layer", "delete_layer", "register_user", "set_superadmin", "delete_user",
                "update_profile", "request_access")
_CUSTOMER = "concat('customer.', lpad(CAST({k} AS STRING), 9, '0'), '@example.com')"


def _by_op(**values: str) -> str:
    whens = " ".join(f"WHEN {OPS_IN_ORDER.index(op)} THEN {value}" for op, value in values.items())
    return f"CASE e % 24 {whens} END"


_ROLE = "CASE m % 8 WHEN 0 THEN 'owner' WHEN 1 THEN NULL WHEN 2 THEN 'manager' ELSE 'member' END"
_SOME_TEAM = "concat('T', m % 27)"
_OWN_TEAM = "concat('T', nat)"
_SOME_ASSET = "concat('A', u * 14 + m % 16)"
FULL_LOG = {
    "actor_email": "CASE WHEN e % 24 = 22 AND m % 12 = 5 THEN 'ghost@example.com' ELSE CASE (m * 3 + e % 24) % 8 WHEN 0 THEN NULL "
                   f"WHEN 1 THEN {_CUSTOMER.format(k=1)} WHEN 2 THEN {_CUSTOMER.format(k=1)} WHEN 3 THEN plat WHEN 4 THEN plat ELSE own END END",
    "op": "CASE e % 24 " + " ".join(f"WHEN {k} THEN '{op}'" for k, op in enumerate(OPS_IN_ORDER)) + " END",
    "target_id": _by_op(
        update_asset=_SOME_ASSET, delete_asset=_SOME_ASSET, publish_asset=_SOME_ASSET, unpublish_asset=_SOME_ASSET,
        update_domain="concat('D', (m * 7) % (n_supp + 2))", delete_domain="concat('D', (m * 11 + 3) % 17 * 6)",
        update_team=_SOME_TEAM, delete_team="CASE WHEN m % 4 = 0 THEN 'T0' ELSE concat('T', 20 + m % 7) END",
        add_member=_SOME_TEAM, change_role=_OWN_TEAM, remove_member=_OWN_TEAM,
        assign_user="concat('U', (m * 17) % (n_cust + 2))", unassign_user="concat('U', CASE WHEN m % 9 = 0 THEN n_cust + 5 ELSE u END)",
        update_layer="concat('L', m % 7)", delete_layer="concat('L', 2 + m % 5)",
        set_superadmin="CASE WHEN m % 6 = 0 THEN 'U1' ELSE concat('U', (m * 5) % (n_cust + 2)) END",
        delete_user="CASE WHEN m % 7 = 0 THEN 'U1' ELSE concat('U', 2 + (m * 3) % (n_cust + 2)) END", request_access=_SOME_ASSET),
    "f_name": _by_op(
        create_asset="CASE WHEN m % 9 = 4 THEN '' ELSE concat('New asset ', e) END",
        create_domain="CASE WHEN m % 17 = 5 THEN '' WHEN m % 3 = 0 THEN concat('Supplier#', lpad(CAST(m % (n_supp + 3) AS STRING), 9, '0')) "
                      "ELSE concat('Name ', m % 40) END",
        update_domain="CASE WHEN m % 5 IN (2, 3) THEN concat('Renamed ', e) END",
        create_team="CASE WHEN m % 9 = 4 THEN '' ELSE concat('Team ', e) END", update_team="CASE WHEN m % 4 = 0 THEN concat('Team name ', e) END",
        create_layer="CASE m % 7 WHEN 0 THEN '' WHEN 1 THEN '   ' WHEN 2 THEN 'Asia' WHEN 3 THEN ' europe ' ELSE concat(' Layer ', m % 30, ' ') END",
        update_layer="CASE m % 6 WHEN 0 THEN concat('L name ', e) WHEN 1 THEN '  ' END",
        register_user="CASE WHEN m % 2 = 0 THEN concat('N ', e) END",
        update_profile="CASE m % 5 WHEN 0 THEN concat('  P ', e, ' ') WHEN 1 THEN repeat('x', 129) END"),
    "f_description": _by_op(update_domain="CASE WHEN m % 5 = 1 THEN concat('About ', e) END", create_team="CASE WHEN m % 2 = 0 THEN concat('D ', e) END",
                            update_team="CASE WHEN m % 4 = 1 THEN concat('D ', e) END"),
    "f_domain_id": _by_op(create_asset="concat('D', m % (n_supp + 2))"),
    "f_quality_score": _by_op(create_asset="CASE m % 7 WHEN 1 THEN 'abc' WHEN 2 THEN '0.5' END", update_asset="CASE m % 7 WHEN 3 THEN 'abc' WHEN 4 THEN '0.25' END"),
    "f_freshness": _by_op(update_asset="CASE m % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'hourly' END"),
    "f_team_id": _by_op(create_domain="CASE WHEN m % 6 = 1 THEN 'T99' ELSE concat('T', nat % 20) END",
                        assign_user=f"CASE WHEN m % 13 <> 0 THEN {_SOME_TEAM} END", unassign_user=f"CASE WHEN m % 13 <> 0 THEN {_OWN_TEAM} END"),
    "f_email": _by_op(add_member=f"CASE WHEN m % 15 <> 7 THEN {_CUSTOMER.format(k='(m * 13) % (n_cust + 2)')} END", change_role="own",
                      remove_member="CASE WHEN m % 10 <> 9 THEN own END",
                      register_user=f"CASE m % 8 WHEN 0 THEN '' WHEN 1 THEN {_CUSTOMER.format(k='m % n_cust')} "
                                    f"WHEN 2 THEN {_CUSTOMER.format(k='m % n_cust')} ELSE concat('new', m % 50, '@example.com') END"),
    "f_role": _by_op(add_member=_ROLE, assign_user=_ROLE,
                     change_role="CASE m % 6 WHEN 0 THEN 'owner' WHEN 1 THEN NULL WHEN 2 THEN 'manager' WHEN 3 THEN 'manager' ELSE 'member' END"),
    "f_color": _by_op(create_layer="CASE WHEN m % 2 = 0 THEN '#111111' END", update_layer="CASE WHEN m % 6 = 2 THEN '#222222' END"),
    "f_position": _by_op(update_layer="CASE m % 6 WHEN 3 THEN '7' WHEN 4 THEN 'x' END"),
    "f_promote": _by_op(set_superadmin="CASE m % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'no' WHEN 2 THEN 'maybe' WHEN 4 THEN 'false' END"),
    "f_avatar": _by_op(update_profile="CASE m % 5 WHEN 2 THEN 'http://x' WHEN 3 THEN 'data:image/png;base64,AA' END"),
    "f_requester_email": _by_op(request_access="CASE WHEN m % 4 = 0 THEN 'guest@example.com' END"),
}


def full_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change records of all 24 ops in the ``schemas.CHANGES`` shape, one per event."""
    events, customer = read_table(spark, sf_dir, "events"), read_table(spark, sf_dir, "customer")
    own = EMAIL_SQL.format(c="c_name")
    # Two counts and one e-mail, the same for all records.
    n_cust, plat = customer.agg(F.count(F.lit(1)), F.min(F.expr(
        f"CASE WHEN c_nationkey = 0 AND c_custkey % 10 <> 9 THEN {own} END"))).first()
    n_supp = read_table(spark, sf_dir, "supplier").count()
    rows = (events.join(customer, customer.c_custkey == events.user_id)
            .select(*_x("event_id AS e", "event_id div 24 AS m", "user_id AS u", "c_nationkey AS nat", f"{own} AS own", "ts"),
                    F.lit(n_cust).alias("n_cust"), F.lit(plat).cast("string").alias("plat"), F.lit(n_supp).alias("n_supp")))
    flat = rows.select(F.col("e").alias("seq"), F.col("ts").alias("event_at"), *[F.expr(x).alias(c) for c, x in FULL_LOG.items()])
    names = [c for c in FULL_LOG if c.startswith("f_")]
    fields = F.map_filter(F.create_map(*[x for c in names for x in (F.lit(c[2:]), F.col(c))]), lambda k, v: v.isNotNull())
    return flat.select("seq", "event_at", "actor_email", "op", "target_id", fields.alias("fields"))


PROJECTIONS = {
    "full_log": full_log,
    "teams": teams,
    "users": users,
    "team_members": team_members,
    "domains": domains,
    "data_layers": data_layers,
    "assets": assets,
    "access_requests": access_requests,
    "change_log": change_log,
}


class Catalog:
    """Lazily projected catalog tables for one driver data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in PROJECTIONS:
            raise AttributeError(name)
        if name not in self._frames:
            frame = PROJECTIONS[name](self.spark, self.sf_dir)
            if name in schemas.CATALOG_SCHEMAS:
                frame = frame.select(*schemas.CATALOG_SCHEMAS[name].fieldNames())
            self._frames[name] = frame
        return self._frames[name]

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in schemas.CATALOG_SCHEMAS}


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog(spark, sf_dir)
