"""Registered queries of stores and checks on tables that hold what the plain projection lacks: versions of older layouts,
broken references and keys, awkward schema texts, names to clean; and of ordered lists, with the place of each row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType

from lakeward.functions import columns as fx
from lakeward.functions import vocab
from lakeward.operators import joins, quality, search
from lakeward.plans import oracle_sql as o
from lakeward.plans.registry import query
from lakeward.session import materialize
from lakeward.sources import store
from lakeward.sources.catalog import catalog_tables
from lakeward.sources.projection import catalog
from lakeward.streaming.streams import stream_folder

# ------------------------------------------------------------ stores (S) ---

ALL_ROWS = """
SELECT 'teams' AS table_name, id, name AS some_value FROM teams
UNION ALL SELECT 'team_members', id, role FROM team_members
UNION ALL SELECT 'domains', id, team_id FROM domains
UNION ALL SELECT 'assets', id, freshness FROM assets
UNION ALL SELECT 'data_layers', id, CAST(position AS VARCHAR) FROM data_layers
UNION ALL SELECT 'access_requests', id, status FROM access_requests
UNION ALL SELECT 'users', id, email FROM users
"""
_SOME_VALUE = {"teams": "name", "team_members": "role", "domains": "team_id", "assets": "freshness", "data_layers": "position",
               "access_requests": "status", "users": "email"}


def _all_rows(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, column in _SOME_VALUE.items():
        rows = tables[name].select(F.lit(name).alias("table_name"), "id", F.col(column).cast("string").alias("some_value"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("catalog_rows", ALL_ROWS)
def q_catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-S1: the seven tables stored as Parquet, read through ``catalog_tables``; a value of every row."""
    root = stream_folder(spark, "catalog")
    for name, df in catalog(spark, sf_dir).tables().items():
        df.write.parquet(f"{root}/{name}")
    return _all_rows(catalog_tables(spark, root))


@query("write_snapshot", ALL_ROWS)
def q_write_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-S2: all tables committed as version 3, half of them before as version 1; the rows of the latest version."""
    root = stream_folder(spark, "snapshots")
    tables = catalog(spark, sf_dir).tables()
    store.write_snapshot({name: df.limit(5) for name, df in tables.items()}, root, 1)
    store.write_snapshot(tables, root, 3)
    return _all_rows(store.read_snapshot(spark, root))


def _fields(**types: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in types.items()])


#: The newest layout of the accounts, with a nested column; older versions lack columns and fields, and have narrower types.
ACCOUNTS = _fields(id=StringType(), email=StringType(), is_superadmin=BooleanType(), number=LongType(), score=DoubleType(),
                   profile=_fields(name=StringType(), avatar=StringType()), origin=StringType())


@query("add_missing_columns", """
SELECT id, email, CASE WHEN n % 3 = 0 THEN false ELSE is_superadmin END AS is_superadmin, n AS number,
  CASE WHEN n % 3 = 0 THEN CAST(n % 7 AS DOUBLE) WHEN n % 3 = 1 THEN (n % 7) / CAST(2 AS DOUBLE) ELSE (n % 7) / CAST(4 AS DOUBLE) END AS score,
  name AS profile_name, CASE WHEN n % 3 = 2 THEN 'a' || n END AS profile_avatar,
  CASE WHEN n % 3 < 2 THEN 'import' WHEN n % 2 = 0 THEN NULL ELSE 'form' END AS origin, CAST(n % 3 AS BIGINT) AS version
FROM (SELECT *, CAST(substr(id, 2) AS BIGINT) AS n FROM users)
""")
def q_add_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-S3: accounts in three versions of different layouts, all read by one scan: the first has no flag, int numbers and
    scores and a profile of a name; the second has the flag and float scores; the third all."""
    users = catalog(spark, sf_dir).users.withColumn("number", F.substring("id", 2, 30).cast("long"))
    n, number = F.col("number"), F.col("number").cast("int").alias("number")
    name = F.struct("name").alias("profile")
    layouts = [
        ["id", "email", number, (n % 7).cast("int").alias("score"), name],
        ["id", "email", "is_superadmin", number, ((n % 7) / 2).cast("float").alias("score"), name],
        ["id", "email", "is_superadmin", "number", ((n % 7) / 4).alias("score"),
         F.struct("name", F.concat(F.lit("a"), n.cast("string")).alias("avatar")).alias("profile"), F.when(n % 2 == 1, "form").alias("origin")]]
    root = stream_folder(spark, "layouts")
    for version, columns in enumerate(layouts):
        store.write_snapshot({"accounts": users.where(n % 3 == version).select(*columns)}, root, version)
    rows = store.read_versions(spark, root, "accounts", ACCOUNTS, defaults={"is_superadmin": False, "origin": "import"})
    return rows.select("id", "email", "is_superadmin", "number", "score", F.col("profile.name").alias("profile_name"),
                       F.col("profile.avatar").alias("profile_avatar"), "origin", "version")


_DEFAULT_LAYERS = ", ".join(f"('{name}', '{color}', {position})" for name, color, position in vocab.DEFAULT_LAYERS)


@query("seed_defaults", f"""
SELECT 'whole' AS given, 'layer' AS kind, id, name, color AS detail, position FROM data_layers
UNION ALL SELECT 'whole', 'team', id, name, description, CASE WHEN is_platform THEN 1 ELSE 0 END FROM teams
UNION ALL SELECT 'bare', 'layer', 'layer-' || name, name, color, position FROM (VALUES {_DEFAULT_LAYERS}) d(name, color, position)
UNION ALL SELECT 'bare', 'team', id, name, description, 0 FROM teams WHERE NOT is_platform
UNION ALL SELECT 'bare', 'team', 'team-platform', {o.q(vocab.PLATFORM_TEAM[0])}, {o.q(vocab.PLATFORM_TEAM[1])}, 1
""")
def q_seed_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-S4: nothing is added to the whole catalog; without layers and without a platform team the defaults are, once."""
    c = catalog(spark, sf_dir)
    out = None
    bare = (c.data_layers.where("position < 0"), c.teams.where("NOT is_platform"))
    for given, (layers, teams) in (("whole", (c.data_layers, c.teams)), ("bare", bare)):
        # Seeding twice adds nothing more.
        layers, teams = store.seed_defaults(*store.seed_defaults(layers, teams))
        rows = layers.select(F.lit(given).alias("given"), F.lit("layer").alias("kind"), "id", "name", F.col("color").alias("detail"), "position").unionByName(
            teams.select(F.lit(given).alias("given"), F.lit("team").alias("kind"), "id", "name", F.col("description").alias("detail"),
                         F.col("is_platform").cast("int").alias("position")))
        out = rows if out is None else out.unionByName(rows)
    return out


# --------------------------------------------------------- functions (F) ---

# Schema texts that a parser easily gets wrong, one kind for each fifth of the assets.
_AWKWARD = """CASE n % 5 WHEN 0 THEN concat(schema_json, ' x')
  WHEN 1 THEN concat('{"c', n % 9, '":"INT","d":null}')
  WHEN 2 THEN concat('{"a":"INT","b":"X', n % 9, '","a":"STRING"}')
  WHEN 3 THEN '[{"name":"n","type":"T"}] []'
  ELSE concat(chr(10), chr(9), ' {"z', n % 9, '":"DATE"} ') END"""


@query("asset_columns_awkward", """
WITH a AS (SELECT id, CAST(substr(id, 2) AS BIGINT) AS n FROM assets)
SELECT id AS asset_id, CAST(1 AS INTEGER) AS col_pos, 'c' || (n % 9) AS name, 'INT' AS type FROM a WHERE n % 5 = 1
UNION ALL SELECT id, 2, 'd', 'null' FROM a WHERE n % 5 = 1
UNION ALL SELECT id, 1, 'a', 'STRING' FROM a WHERE n % 5 = 2
UNION ALL SELECT id, 2, 'b', 'X' || (n % 9) FROM a WHERE n % 5 = 2
UNION ALL SELECT id, 1, 'z' || (n % 9), 'DATE' FROM a WHERE n % 5 = 4
""")
def q_asset_columns_awkward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-F2: text after the document's end, repeated keys (the last value counts), null types, white space before it."""
    assets = catalog(spark, sf_dir).assets.withColumn("n", F.substring("id", 2, 30).cast("long")).withColumn("schema_json", F.expr(_AWKWARD))
    return fx.asset_columns(assets).select("asset_id", "col_pos", "name", "type")


@query("encode_columns", """
SELECT id AS asset_id, CASE WHEN n % 3 = 0 THEN '[]' ELSE
  '[{"name":"c' || (n % 9) || '","type":"INT","nullable":true,"description":""}' ||
  CASE WHEN n % 3 = 1 THEN '' ELSE ',{"name":" x ","type":"' || coalesce(source_type, '') || '","nullable":false,"description":"' || freshness || '"}' END || ']' END AS schema_json
FROM (SELECT *, CAST(substr(id, 2) AS BIGINT) AS n FROM assets)
""")
def q_encode_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-F3: described columns as JSON text; those without a name are left out."""
    n = F.col("n")
    one = F.struct(F.when(n % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit("c"), (n % 9).cast("string"))).alias("name"), F.lit("INT").alias("type"),
                   F.lit(True).alias("nullable"), F.lit("").alias("description"))
    two = F.struct(F.when(n % 3 == 2, F.lit(" x ")).otherwise(F.lit("")).alias("name"), F.coalesce("source_type", F.lit("")).alias("type"),
                   F.lit(False).alias("nullable"), F.col("freshness").alias("description"))
    assets = catalog(spark, sf_dir).assets.withColumn("n", F.substring("id", 2, 30).cast("long"))
    return assets.select(F.col("id").alias("asset_id"), fx.encode_columns(F.array(one, two)).alias("schema_json"))


@query("clean_name", """
SELECT id, trim(s) AS layer_name, length(trim(s)) BETWEEN 1 AND 64 AS layer_ok, s AS team_name, length(s) BETWEEN 1 AND 128 AS team_ok
FROM (SELECT id, repeat(' ', CAST(n % 4 AS BIGINT)) || CASE WHEN n % 11 = 0 THEN '' ELSE repeat(name, CAST(n % 9 AS BIGINT)) END || ' ' AS s
      FROM (SELECT *, CAST(substr(id, 2) AS BIGINT) AS n FROM assets))
""")
def q_clean_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-F4: names of blanks, too long, or with blanks around them: their stored form, and whether they may be stored."""
    n = F.substring("id", 2, 30).cast("long")
    name = F.concat(F.repeat(F.lit(" "), (n % 4).cast("int")), F.when(n % 11 == 0, "").otherwise(F.repeat("name", (n % 9).cast("int"))), F.lit(" "))
    rows = catalog(spark, sf_dir).assets.select("id", name.alias("s"))
    limit = vocab.NAME_LIMITS
    return rows.select("id", fx.clean_name("s").alias("layer_name"), fx.name_ok("s", limit["layer"]).alias("layer_ok"),
                       fx.clean_name("s", trim=False).alias("team_name"), fx.name_ok("s", limit["team"], trim=False).alias("team_ok"))


@query("unknown_types_by_format", f"""
WITH a AS (SELECT *, CAST(substr(id, 2) AS BIGINT) AS n FROM assets WHERE source_type IN ('s3', 'gcs', 'postgres')),
cols AS (
  SELECT id, source_type, 1 AS col_pos, 'x' AS name, 'INT64' AS type, n FROM a UNION ALL SELECT id, source_type, 2, 'y', 'STRING', n FROM a
  UNION ALL SELECT id, source_type, 3, 'z', 'NUMBER', n FROM a),
vocab(vocab_key, type) AS (VALUES {o.type_vocabulary()})
SELECT id AS asset_id, CAST(col_pos AS INTEGER) AS col_pos, name, type, source_type FROM cols c
WHERE NOT EXISTS (SELECT 1 FROM vocab v WHERE v.type = c.type AND v.vocab_key = CASE WHEN c.source_type = 'postgres' THEN 'postgres'
  WHEN n % 4 = 0 THEN 'format:parquet' WHEN n % 4 = 1 THEN 'format:json' ELSE '' END)
""")
def q_unknown_types_by_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-F7 with the file formats of three quarters of the assets, one of them without a list."""
    n = F.substring("id", 2, 30).cast("long")
    assets = catalog(spark, sf_dir).assets.where("source_type IN ('s3', 'gcs', 'postgres')").withColumn(
        "schema_json", F.lit('{"x":"INT64","y":"STRING","z":"NUMBER"}'))
    formats = assets.select(F.col("id").alias("asset_id"), F.when(n % 4 == 0, "parquet").when(n % 4 == 1, "json").when(n % 4 == 2, "xlsx").alias("file_format"))
    return quality.unknown_types(assets, formats)


@query("notification_text_all", """
SELECT r.id AS request_id, 'Access request for data asset: ' || a.name AS subject,
  'User ' || r.requester_email || ' has requested access to the data asset ' || chr(39) || a.name || chr(39) || '.' || chr(10) || chr(10) || 'Message: '
    || CASE r.status WHEN 'approved' THEN 'please, for ' || r.id ELSE '(none)' END || chr(10) || chr(10) || 'Please review the request in the catalog UI.' AS body
FROM access_requests r JOIN assets a ON r.asset_id = a.id
""")
def q_notification_text_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-F6 for every request: with a message, with an empty one, and without."""
    c = catalog(spark, sf_dir)
    message = F.when(F.col("status") == "approved", F.concat(F.lit("please, for "), "id")).when(F.col("status") == "denied", "")
    t = joins.request_targets(c.access_requests, c.assets)
    return t.select(F.col("id").alias("request_id"), fx.notification_subject("asset_name").alias("subject"),
                    fx.notification_body("requester_email", "asset_name", message).alias("body"))


# ----------------------------------------------------- checks (J11, J12) ---


@query("dangling_references_found", """
SELECT 'assets.layer_id' AS relation, 'assets' AS child_table, id AS child_id, 'L9' AS ref_value FROM assets WHERE CAST(substr(id, 2) AS BIGINT) % 10 = 7
UNION ALL SELECT 'assets.domain_id', 'assets', id, 'x' || domain_id FROM assets WHERE CAST(substr(id, 2) AS BIGINT) % 10 = 3
UNION ALL SELECT 'team_members.team_id', 'team_members', id, 'T77' FROM team_members WHERE role = 'owner'
UNION ALL SELECT 'team_members.email', 'team_members', id, upper(email) FROM team_members WHERE role = 'manager'
UNION ALL SELECT 'domains.team_id', 'domains', id, 'T88' FROM domains WHERE CAST(substr(id, 2) AS BIGINT) % 5 = 0
UNION ALL SELECT 'access_requests.asset_id', 'access_requests', id, 'B' || asset_id FROM access_requests WHERE status = 'denied'
""")
def q_dangling_references_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-J11 on tables of which a part of every reference is broken, and another part is NULL."""
    t = catalog(spark, sf_dir).tables()
    n = F.substring("id", 2, 30).cast("long")
    change = lambda name, column, when, to: t.update({name: t[name].withColumn(column, F.when(when, to).otherwise(F.col(column)))})
    change("assets", "layer_id", n % 10 == 7, F.lit("L9"))
    change("assets", "layer_id", n % 10 == 8, F.lit(None))
    change("assets", "domain_id", n % 10 == 3, F.concat(F.lit("x"), "domain_id"))
    change("team_members", "team_id", F.col("role") == "owner", F.lit("T77"))
    change("team_members", "email", F.col("role") == "manager", F.upper("email"))
    change("domains", "team_id", n % 5 == 0, F.lit("T88"))
    change("access_requests", "asset_id", F.col("status") == "denied", F.concat(F.lit("B"), "asset_id"))
    return quality.dangling_references(t)


@query("duplicate_keys_found", """
SELECT 'team_members' AS table_name, 'team_id,email' AS key_name, team_id || '|' || email AS key_value, 2 * count(*) AS n_rows
  FROM team_members WHERE role = 'owner' GROUP BY team_id, email
UNION ALL SELECT 'domains', 'name', 'x' || (CAST(substr(id, 2) AS BIGINT) % 4), count(*) FROM domains GROUP BY 3
UNION ALL SELECT 'users', 'id', id, 3 FROM users WHERE is_superadmin
UNION ALL SELECT 'users', 'email', email, 3 FROM users WHERE is_superadmin
UNION ALL SELECT 'data_layers', 'lower(name)', lower(name), 2 FROM data_layers
""")
def q_duplicate_keys_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-J12 on tables with repeated keys, NULL keys, and keys whose parts hold the separator (these are no duplicates)."""
    t = catalog(spark, sf_dir).tables()
    members = t["team_members"]
    none = F.lit(None).cast("string")
    # ("a|b", "c") and ("a", "b|c") are different memberships.
    split = members.limit(1).select(F.explode(F.array(*[F.struct(F.lit(i).alias("id"), F.lit(a).alias("team_id"), F.lit(b).alias("email"))
                                                        for i, a, b in (("s1", "a|b", "c"), ("s2", "a", "b|c"))])).alias("x")).select("x.*", F.lit("member").alias("role"))
    t["team_members"] = (members.unionByName(members.where("role = 'owner'").withColumn("id", F.concat(F.lit("again-"), "id"))).unionByName(split)
                         .unionByName(members.withColumn("id", none).withColumn("team_id", none)))
    t["domains"] = t["domains"].withColumn("name", F.concat(F.lit("x"), (F.substring("id", 2, 30).cast("long") % 4).cast("string")))
    admins = t["users"].where("is_superadmin")
    t["users"] = t["users"].unionByName(admins).unionByName(admins)
    t["data_layers"] = t["data_layers"].unionByName(t["data_layers"].withColumn("id", F.concat(F.lit("up-"), "id")).withColumn("name", F.upper("name")))
    return quality.duplicate_keys(t)


# --------------------------------------------------------- ordered lists ---


def _placed(df: DataFrame) -> DataFrame:
    """Rows of a short ordered list with their place in it: the list as a caller gets it, numbered afterwards."""
    ordered = materialize(df.coalesce(1), "ordered-list")
    return ordered.withColumn("place", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).cast("int"))


@query("ordered_layers_placed", """
SELECT id, name, position, CAST(row_number() OVER (ORDER BY position NULLS LAST, name NULLS LAST, id) AS INTEGER) AS place FROM data_layers
""")
def q_ordered_layers_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-T3: the place of every layer in the ordered list."""
    return _placed(search.ordered_layers(catalog(spark, sf_dir).data_layers).select("id", "name", "position"))


@query("ordered_teams_placed", """
SELECT id, name, CAST(row_number() OVER (ORDER BY name NULLS LAST, id) AS INTEGER) AS place FROM teams WHERE NOT is_platform
""")
def q_ordered_teams_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-T4: the place of every team that is shown to a superadmin."""
    teams = catalog(spark, sf_dir).teams
    return _placed(search.ordered_teams(teams.where("NOT is_platform")).select("id", "name"))


@query("users_with_team_lists", """
SELECT u.email, CAST(row_number() OVER (PARTITION BY u.email ORDER BY t.name, t.id, m.role) AS INTEGER) AS place, t.id AS team_id, m.role
FROM users u JOIN team_members m ON m.email = u.email JOIN teams t ON t.id = m.team_id WHERE NOT t.is_platform
UNION ALL SELECT u.email, 0, NULL, NULL FROM users u
WHERE NOT EXISTS (SELECT 1 FROM team_members m JOIN teams t ON t.id = m.team_id WHERE m.email = u.email AND NOT t.is_platform)
""")
def q_users_with_team_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-J4, nested form: each user's teams in their order, with their place in the list; 0 for a user without one."""
    c = catalog(spark, sf_dir)
    lists = joins.users_with_team_lists(joins.users_with_teams(c.users, c.team_members, c.teams))
    return (lists.select("email", F.posexplode_outer("teams").alias("at", "t"))
            .select("email", F.coalesce(F.col("at") + 1, F.lit(0)).cast("int").alias("place"), "t.team_id", "t.role"))
