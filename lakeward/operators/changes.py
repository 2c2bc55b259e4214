"""Catalog changes as batches: ``apply_changes(tables, changes) -> (tables, decisions)``.

Input rows (``schemas.CHANGES``): ``seq, event_at, actor_email, op,
target_id, fields map<string,string>``; ``seq`` is unique within a batch.
In ``fields`` an absent key means "keep", a present key with a NULL value
means "set NULL".

Semantics of a batch:

* every change is decided against the snapshot at batch start; the first
  failing rule (in the order of ``_rules``) gives the status, else the
  op's success status (``OK_STATUS``); unknown ops get 400;
* unique names (of domains and layers, e-mails, memberships) go in the
  order of ``seq``: a name is taken by the first accepted change that claims
  it while it is free, and is free again after an accepted rename or delete
  of its holder with a lower ``seq`` (``claims``); a name that several rows
  of the snapshot hold already stays taken;
* inside a batch, inserts are applied first, then field updates and flags
  (the last ``seq`` per field wins), then deletes with their cascades; a
  membership is what its last change by ``seq`` says, unless its team or
  user goes;
* new ids are derived from ``seq`` (deterministic, so a replayed or
  recomputed batch writes the same rows); times are the change's
  ``event_at``.

The decision frame is built in a few passes: one entity table (each
catalog table scanned once), one exploded lookup join for the target row,
the referenced row, the unique-name owner and the actor's flags
(regrouped per ``seq``), two joins with the grant table (actor's role on
the relevant team, the membership addressed), and a per-key minimum for
in-batch claims.  Rules are SQL ``CASE`` text.  Effects are collapsed per
key with partial aggregates and applied with left / anti joins and unions.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeward.functions import vocab
from lakeward.operators.access import team_grants
from lakeward.session import discard, scratch
from lakeward.session import materialize as write_and_read
from lakeward.sources import schemas

ASSET_OPS = ("create_asset", "update_asset", "delete_asset", "publish_asset", "unpublish_asset")
DOMAIN_OPS = ("create_domain", "update_domain", "delete_domain")
TEAM_OPS = ("create_team", "update_team", "delete_team")
MEMBER_OPS = ("add_member", "change_role", "remove_member", "assign_user", "unassign_user")
LAYER_OPS = ("create_layer", "update_layer", "delete_layer")
USER_OPS = ("register_user", "set_superadmin", "delete_user", "update_profile")
REQUEST_OPS = ("request_access",)
ALL_OPS = ASSET_OPS + DOMAIN_OPS + TEAM_OPS + MEMBER_OPS + LAYER_OPS + USER_OPS + REQUEST_OPS

# Ops that may claim a unique name.
CLAIM_OPS = ("create_domain", "update_domain", "create_layer", "update_layer", "register_user", "add_member")

# Ops that insert a row; their decision carries the new id.
CREATE_OPS = ("create_asset", "create_domain", "create_team", "add_member", "create_layer", "register_user",
              "request_access")

ID_PREFIX = {
    "create_asset": "asset-", "create_domain": "domain-", "create_team": "team-",
    "add_member": "member-", "assign_user": "member-", "create_team_owner": "owner-",
    "create_layer": "layer-", "register_user": "user-", "request_access": "request-",
}


def f(key: str) -> Column:
    """Value of a field (NULL when absent or explicitly NULL)."""
    return F.try_element_at(F.col("fields"), F.lit(key))


def has(key: str) -> Column:
    return F.coalesce(F.map_contains_key(F.col("fields"), F.lit(key)), F.lit(False))


#: Reserved field: the batch that a change came in, set by ``apply_changes``; part of every new id.
BATCH_FIELD = "_batch"


def new_id(op: str) -> Column:
    """Ids of created rows: seq is unique within a batch, the batch's name makes it unique across batches."""
    batch = F.coalesce(F.concat(f(BATCH_FIELD), F.lit("-")), F.lit(""))
    return F.concat(F.lit(ID_PREFIX[op]), batch, F.col("seq").cast("string"))


def _op(*ops: str) -> Column:
    return F.col("op").isin(*ops)


def _pick(mapping: dict[tuple[str, ...], Column], default: Column | None = None) -> Column:
    """``CASE op WHEN ... THEN expr`` over groups of ops."""
    expr = None
    for ops, value in mapping.items():
        expr = F.when(_op(*ops), value) if expr is None else expr.when(_op(*ops), value)
    if expr is None:
        return default if default is not None else F.lit(None)
    return expr.otherwise(default) if default is not None else expr


# ------------------------------------------------------------- lookups ---

ENTITY_COLUMNS = ["e_team", "e_email", "e_name", "e_owner", "e_uid"]
ENTITY_FLAGS = ["e_flag", "e_admin", "e_platform"]


def _entity(kind: str, key: str, team: str = "NULL", email: str = "NULL", name: str = "NULL",
            owner: str = "NULL", uid: str = "NULL", flag: str = "false", admin: str = "false",
            platform: str = "false") -> str:
    """SQL for one lookup row (a named struct); arguments are SQL expressions."""
    return (f"named_struct('e_kind', '{kind}', 'e_id', CAST({key} AS STRING), "
            f"'e_team', CAST({team} AS STRING), 'e_email', CAST({email} AS STRING), "
            f"'e_name', CAST({name} AS STRING), 'e_owner', CAST({owner} AS STRING), "
            f"'e_uid', CAST({uid} AS STRING), 'e_flag', coalesce({flag}, false), "
            f"'e_admin', coalesce({admin}, false), 'e_platform', coalesce({platform}, false))")


def _explode(*structs: str) -> str:
    return f"explode(array({', '.join(structs)})) AS e"


def entities(t: dict[str, DataFrame], wanted: DataFrame | None = None) -> DataFrame:
    """Every row a change can look up, one row per (kind, key), from one scan per table.

    Kinds: ``asset`` (team via its domain; flag = has a domain), ``domain``,
    ``team`` (flag = platform), ``user``, ``user_email``, ``layer``, the
    unique names ``domain_name`` / ``layer_name`` (lower-cased) with their
    owners, and ``flag`` (actor e-mail: superadmin / platform member).
    ``e_count`` counts the rows behind a key (a name taken twice, a key
    violation); aggregation per key keeps one lookup row per key.

    With ``wanted`` (columns ``kind, key``: what a batch asks for) the asset
    and user rows (the sources that grow with the catalog) are cut to the
    asked keys before anything is shuffled: a small batch's key set is
    broadcast by AQE, so those tables are scanned once and only the rows the
    batch refers to reach the aggregate.
    """
    doms = t["domains"]
    dom_team = doms.groupBy("id").agg(F.min("team_id").alias("_dteam")).withColumnRenamed("id", "domain_id")
    assets = t["assets"].join(dom_team, "domain_id", "left")
    platform_teams = t["teams"].filter(F.col("is_platform")).select(F.col("id").alias("team_id"))
    platform_members = t["team_members"].join(platform_teams, "team_id", "left_semi")
    asset_rows = assets.selectExpr(_explode(_entity("asset", "id", team="_dteam", name="name", owner="owner_email",
                                                    flag="_dteam IS NOT NULL"))).selectExpr("e.*")
    user_rows = t["users"].selectExpr(_explode(_entity("user", "id", email="email", name="name", uid="id"),
                                               _entity("user_email", "email", email="email", name="name", uid="id"),
                                               _entity("flag", "email", admin="is_superadmin"))).selectExpr("e.*")
    if wanted is not None:
        # The two sources that grow with the catalog keep only the asked keys
        # (the small ones are taken whole).
        w = wanted.select(F.col("kind").alias("_wk"), F.col("key").alias("_wid"))
        asset_rows = asset_rows.join(w, (asset_rows.e_kind == w._wk) & (asset_rows.e_id == w._wid), "left_semi")
        user_rows = user_rows.join(w, (user_rows.e_kind == w._wk) & (user_rows.e_id == w._wid), "left_semi")
    parts = [
        asset_rows,
        doms.selectExpr(_explode(_entity("domain", "id", team="team_id", flag="true"),
                                 _entity("domain_name", "name", team="team_id", uid="id"))).selectExpr("e.*"),
        t["teams"].selectExpr(_explode(_entity("team", "id", team="id", name="name",
                                               flag="is_platform"))).selectExpr("e.*"),
        user_rows,
        platform_members.selectExpr(_explode(_entity("flag", "email", platform="true"))).selectExpr("e.*"),
        t["data_layers"].selectExpr(_explode(_entity("layer", "id", name="name"),
                                             _entity("layer_name", "lower(name)", uid="id"))).selectExpr("e.*"),
    ]
    union = reduce(DataFrame.unionByName, parts).filter("e_id IS NOT NULL")
    aggs = ([f"min({c}) AS {c}" for c in ENTITY_COLUMNS] + [f"bool_or({c}) AS {c}" for c in ENTITY_FLAGS]
            + ["count(1) AS e_count"])
    # Grouped by a struct of the key: the lookup join has an exchange of its own on both sides, and AQE can split a hot key's asks.
    return (union.groupBy(F.struct("e_kind", "e_id").alias("k")).agg(*[F.expr(a) for a in aggs])
            .select("k.e_kind", "k.e_id", *ENTITY_COLUMNS, *ENTITY_FLAGS, "e_count"))


# ------------------------------------------------------------ decision ---


def _sql_f(key: str) -> str:
    return f"try_element_at(fields, '{key}')"


def _sql_has(key: str) -> str:
    return f"coalesce(map_contains_key(fields, '{key}'), false)"


def _sql_case(branches: dict[tuple[str, ...], str], default: str = "NULL") -> str:
    whens = " ".join(
        f"WHEN op IN ({', '.join(repr(o) for o in ops)}) THEN {value}" for ops, value in branches.items())
    return f"CASE {whens} ELSE {default} END"


# Which rows each op looks up: target row (kind, key), referenced row,
# the team on which the actor's role matters, the membership it
# addresses, and the unique name it claims.
TARGET_KIND = _sql_case({
    ("update_asset", "delete_asset", "publish_asset", "unpublish_asset", "request_access"): "'asset'",
    ("update_domain", "delete_domain"): "'domain'",
    ("update_team", "delete_team", "add_member", "change_role", "remove_member"): "'team'",
    ("assign_user", "unassign_user", "set_superadmin", "delete_user"): "'user'",
    ("update_layer", "delete_layer"): "'layer'",
    ("update_profile",): "'user_email'",
})
TARGET_KEY = _sql_case({("update_profile",): "actor_email"}, "target_id")
REF_KIND = _sql_case({
    ("create_asset",): "'domain'", ("create_domain", "assign_user"): "'team'", ("add_member",): "'user_email'"})
REF_KEY = _sql_case({
    ("create_asset",): _sql_f("domain_id"), ("create_domain", "assign_user"): _sql_f("team_id"),
    ("add_member",): _sql_f("email")})
NAME_KIND = _sql_case({
    ("create_domain",): "'domain_name'",
    ("update_domain",): f"CASE WHEN {_sql_has('name')} THEN 'domain_name' END",
    ("create_layer",): "'layer_name'",
    ("update_layer",): f"CASE WHEN {_sql_has('name')} THEN 'layer_name' END",
    ("register_user",): "'user_email'"})
NAME_KEY = _sql_case({
    ("create_domain", "update_domain"): _sql_f("name"),
    ("create_layer", "update_layer"): f"lower(trim({_sql_f('name')}))",
    ("register_user",): _sql_f("email")})
GRANT_TEAM = _sql_case({
    ("update_asset", "delete_asset", "publish_asset", "unpublish_asset", "update_domain", "delete_domain"): "tg_team",
    ("create_asset",): "rf_team", ("create_domain",): _sql_f("team_id"),
    ("update_team", "delete_team", "add_member", "change_role", "remove_member"): "target_id"})
MEMBER_TEAM = _sql_case({("add_member", "change_role", "remove_member"): "target_id",
                         ("assign_user", "unassign_user"): _sql_f("team_id")})
MEMBER_EMAIL = _sql_case({("add_member", "change_role", "remove_member"): _sql_f("email"),
                          ("assign_user", "unassign_user"): "tg_email"})
CLAIM_KEY = _sql_case({
    ("create_domain", "update_domain", "create_layer", "update_layer", "register_user"):
        "CASE WHEN n_key_ IS NOT NULL THEN concat(n_kind_, '|', n_key_) END",
    ("add_member",): "concat('member|', char_length(m_team), '|', m_team, '|', m_email)"})


#: The condition of the rules on unique names: the name is not free when the change claims it (``claims``).
LOST = "claim_lost"


def _rules() -> dict[str, list[tuple[str, int, str]]]:
    """Rules per op, in order: (SQL condition, status, reason).  Conditions read the columns ``decide`` looks up."""
    F_, H, R = _sql_f, _sql_has, vocab.REASONS
    actor = "actor_email IS NULL"
    t_found, r_found = "tg_id IS NOT NULL", "rf_id IS NOT NULL"
    asset_found = "(tg_id IS NOT NULL AND coalesce(tg_flag, false))"
    platform_team = "coalesce(tg_flag, false)"

    def bad_len(x: str, hi: int) -> str:
        return f"({x} IS NULL OR NOT char_length({x}) BETWEEN 1 AND {hi})"

    def no_fields(table: str) -> str:
        allowed = ", ".join(f"'{c}'" for c in schemas.UPDATABLE_FIELDS[table])
        return f"size(map_filter(fields, (k, v) -> k IN ({allowed}))) = 0"

    lim = vocab.NAME_LIMITS
    roles = ", ".join(f"'{r}'" for r in vocab.ASSIGNABLE_ROLES)
    role_bad = f"coalesce({F_('role')}, 'member') NOT IN ({roles})"
    role_set_bad = f"({F_('role')} IS NULL OR {F_('role')} NOT IN ({roles}))"
    score_bad = (f"({H('quality_score')} AND {F_('quality_score')} IS NOT NULL "
                 f"AND try_cast({F_('quality_score')} AS DOUBLE) IS NULL)")
    self_target = "tg_email = actor_email"
    promote = f"lower({F_('promote')}) IN ('true', '1', 'yes', 'on')"
    promote_bad = (f"({F_('promote')} IS NULL OR lower({F_('promote')}) NOT IN "
                   f"('true', 'false', '1', '0', 'yes', 'no', 'on', 'off'))")
    missing = lambda key: f"{F_(key)} IS NULL"
    mgr = "(is_platform OR a_manager)"
    auth = (actor, 401, R["authentication_required"])
    return {
        "create_asset": [
            auth,
            (f"{missing('domain_id')} OR {bad_len(F_('name'), lim['asset'])} OR {score_bad}", 422,
             R["invalid_asset_fields"]),
            (f"NOT {r_found}", 400, R["domain_not_found"]),
            ("NOT (is_global OR a_member)", 403, R["not_authorized_to_create_assets_in_this_domain"]),
        ],
        "update_asset": [
            auth,
            (score_bad, 422, R["quality_score_must_be_a_number"]),
            (f"NOT {asset_found}", 404, R["asset_not_found"]),
            ("NOT (is_global OR a_member)", 403, R["not_authorized_to_update_this_asset"]),
            (no_fields("assets"), 400, R["no_fields_to_update"]),
        ],
        "delete_asset": [
            auth,
            (f"NOT {asset_found}", 404, R["asset_not_found"]),
            ("NOT (is_global OR a_member)", 403, R["not_authorized_to_delete_this_asset"]),
        ],
        "publish_asset": [
            auth,
            (f"NOT {asset_found}", 404, R["asset_not_found"]),
            ("NOT (is_global OR a_member)", 403, R["not_authorized_to_publish_this_asset"]),
        ],
        "unpublish_asset": [
            auth,
            (f"NOT {asset_found}", 404, R["asset_not_found"]),
            ("NOT (is_global OR a_member)", 403, R["not_authorized_to_unpublish_this_asset"]),
        ],
        "create_domain": [
            auth,
            (bad_len(F_("name"), lim["domain"]), 422, R["invalid_domain_name"]),
            (f"NOT {mgr}", 403, R["only_team_managers_can_create_domains"]),
            (f"NOT {r_found}", 400, R["team_not_found"]),
            (LOST, 409, R["domain_name_already_exists"]),
        ],
        "update_domain": [
            auth,
            (f"NOT {t_found}", 404, R["domain_not_found"]),
            (f"NOT {mgr}", 403, R["only_team_managers_can_update_domains"]),
            (no_fields("domains"), 400, R["no_fields_to_update"]),
            (LOST, 409, R["domain_name_already_exists"]),
        ],
        "delete_domain": [
            auth,
            (f"NOT {t_found}", 404, R["domain_not_found"]),
            (f"NOT {mgr}", 403, R["only_team_managers_can_delete_domains"]),
        ],
        "create_team": [
            auth,
            (bad_len(F_("name"), lim["team"]), 422, R["invalid_team_name"]),
        ],
        "update_team": [
            auth,
            ("NOT (is_global OR a_owner)", 403, R["only_team_owners_can_modify_this_team"]),
            (f"NOT {t_found}", 404, R["team_not_found"]),
            (platform_team, 403, R["cannot_modify_platform_team"]),
            (no_fields("teams"), 400, R["no_fields_to_update"]),
        ],
        "delete_team": [
            auth,
            ("NOT (is_global OR a_owner)", 403, R["only_team_owners_can_modify_this_team"]),
            (f"NOT {t_found}", 404, R["team_not_found"]),
            (platform_team, 403, R["cannot_delete_platform_team"]),
        ],
        "add_member": [
            auth,
            (missing("email"), 422, R["email_is_required"]),
            (f"NOT {mgr}", 403, R["only_team_managers_can_manage_members"]),
            (role_bad, 400, R["role_must_be_manager_or_member"]),
            (f"NOT {r_found}", 400, R["no_user_account_found_for_that_email"]),
            (f"NOT {t_found}", 404, R["team_not_found"]),
            (LOST, 400, R["user_is_already_a_member_of_this_team"]),
        ],
        "change_role": [
            auth,
            (f"{missing('role')} OR {missing('email')}", 422, R["role_and_email_are_required"]),
            (f"NOT {mgr}", 403, R["only_team_managers_can_manage_members"]),
            (role_set_bad, 400, R["role_must_be_manager_or_member"]),
            ("NOT m_exists", 404, R["member_not_found"]),
        ],
        "remove_member": [
            auth,
            (missing("email"), 422, R["email_is_required"]),
            (f"NOT {mgr}", 403, R["only_team_managers_can_manage_members"]),
        ],
        "assign_user": [
            (missing("team_id"), 422, R["team_id_is_required"]),
            auth,
            ("NOT is_global", 403, R["superadmin_access_required"]),
            (role_bad, 400, R["role_must_be_manager_or_member"]),
            (f"NOT {t_found}", 404, R["user_not_found"]),
            (f"NOT {r_found}", 404, R["team_not_found"]),
        ],
        "unassign_user": [
            (missing("team_id"), 422, R["team_id_is_required"]),
            auth,
            ("NOT is_global", 403, R["superadmin_access_required"]),
            (f"NOT {t_found}", 404, R["user_not_found"]),
        ],
        "create_layer": [
            (bad_len(F_("name"), lim["layer"]), 422, R["invalid_layer_name"]),
            auth,
            ("NOT is_global", 403, R["superadmin_access_required"]),
            (f"trim({F_('name')}) = ''", 400, R["name_is_required"]),
            (LOST, 409, R["a_layer_with_that_name_already_exists"]),
        ],
        "update_layer": [
            (f"{H('name')} AND {bad_len(F_('name'), lim['layer'])}", 422, R["invalid_layer_name"]),
            (f"{H('position')} AND {F_('position')} IS NOT NULL AND try_cast({F_('position')} AS INT) IS NULL",
             422, R["position_must_be_an_integer"]),
            auth,
            ("NOT is_global", 403, R["superadmin_access_required"]),
            (f"NOT {t_found}", 404, R["layer_not_found"]),
            (LOST, 409, R["a_layer_with_that_name_already_exists"]),
            (no_fields("data_layers"), 400, R["no_fields_to_update"]),
            (f"{H('name')} AND trim({F_('name')}) = ''", 400, R["name_is_required"]),
        ],
        "delete_layer": [
            auth,
            ("NOT is_global", 403, R["superadmin_access_required"]),
            (f"NOT {t_found}", 404, R["layer_not_found"]),
        ],
        "register_user": [
            (f"coalesce(char_length({F_('email')}), 0) < 1", 422, R["invalid_e_mail"]),
            ("actor_email IS NOT NULL AND NOT is_global", 403, R["superadmin_access_required"]),
            (LOST, 400, R["email_already_registered"]),
        ],
        "set_superadmin": [
            (promote_bad, 422, R["promote_must_be_a_boolean"]),
            auth,
            ("NOT is_global", 403, R["superadmin_access_required"]),
            (f"NOT {t_found}", 404, R["user_not_found"]),
            (f"{self_target} AND NOT {promote}", 400, R["cannot_remove_your_own_superadmin_status"]),
        ],
        "delete_user": [
            auth,
            ("NOT is_global", 403, R["superadmin_access_required"]),
            (f"NOT {t_found}", 404, R["user_not_found"]),
            (self_target, 400, R["cannot_delete_your_own_account"]),
        ],
        "update_profile": [
            (f"{H('name')} AND ({F_('name')} IS NULL OR char_length({F_('name')}) > {lim['profile']})", 422,
             R["invalid_profile_name"]),
            auth,
            (f"{H('avatar')} AND coalesce({F_('avatar')}, '') <> '' "
             f"AND NOT startswith(coalesce({F_('avatar')}, ''), 'data:image/')", 400,
             R["avatar_must_be_a_data_image_url"]),
            (no_fields("users"), 400, R["no_fields_to_update"]),
            (f"NOT {t_found}", 404, R["user_not_found"]),
        ],
        "request_access": [
            (f"coalesce({F_('requester_email')}, actor_email) IS NULL", 422, R["requester_email_is_required"]),
            (f"NOT {t_found}", 404, R["asset_not_found"]),
        ],
    }


OK_STATUS = {
    "create_asset": 201, "update_asset": 200, "delete_asset": 204, "publish_asset": 200, "unpublish_asset": 200,
    "create_domain": 201, "update_domain": 200, "delete_domain": 204,
    "create_team": 201, "update_team": 200, "delete_team": 204,
    "add_member": 201, "change_role": 200, "remove_member": 204, "assign_user": 201, "unassign_user": 204,
    "create_layer": 201, "update_layer": 200, "delete_layer": 204,
    "register_user": 201, "set_superadmin": 200, "delete_user": 204, "update_profile": 200,
    "request_access": 201,
}


def _numbered() -> tuple[dict[str, list[tuple[int, str]]], list[tuple[int, str]]]:
    """Per op its rules as (number, condition), and by number (from 1) each rule's status and reason; 1: no such op."""
    outcomes, numbers = [(400, "Unknown operation")], {}
    for op, rules in _rules().items():
        for cond, status, reason in rules:
            outcomes.append((status, reason))
            numbers.setdefault(op, []).append((len(outcomes), cond))
    return numbers, outcomes


def _failed_sql() -> str:
    """The number of the first failing rule, those on names left out; NULL if all pass.

    The conditions are evaluated here and nowhere else: statuses and reasons
    follow from the number and the outcome of the claims.
    """
    branches = {}
    for op, rules in _numbered()[0].items():
        whens = " ".join(f"WHEN {cond} THEN {n}" for n, cond in rules if cond != LOST)
        branches[(op,)] = f"CASE {whens} END" if whens else "CAST(NULL AS INT)"
    return _sql_case(branches, "1")


def _name_rule_sql() -> str:
    """The number of an op's rule on names; NULL if it has none."""
    return _sql_case({(op,): str(n) for op, rules in _numbered()[0].items() for n, cond in rules if cond == LOST}, "CAST(NULL AS INT)")


def _outcome_sql() -> tuple[str, str]:
    """Status and reason of the number in ``rule`` (NULL: accepted)."""
    outcomes = _numbered()[1]
    statuses = ", ".join(str(status) for status, _ in outcomes)
    reasons = ", ".join(_lit(reason) for _, reason in outcomes)
    ok = _sql_case({(op,): str(status) for op, status in OK_STATUS.items()}, "400")
    return (f"CASE WHEN rule IS NULL THEN {ok} ELSE element_at(array({statuses}), rule) END",
            f"CASE WHEN rule IS NULL THEN 'ok' ELSE element_at(array({reasons}), rule) END")


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# Columns each lookup role brings back: target row, referenced row, name owner, actor flags.
LOOKUP_ROLES = {
    "tg": ["e_id", "e_team", "e_flag", "e_email", "e_name", "e_owner", "e_uid"],
    "rf": ["e_id", "e_team"],
    "nm": ["e_count", "e_uid", "e_team"],
    "fl": ["e_admin", "e_platform"],
}


def _lookup_all(ch: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """All first-round lookups of every change in one join with the entity table.

    Each change asks for up to four (kind, key) rows; the entity table keeps
    only the asked keys; the answers are regrouped per change (``seq`` is
    unique within a batch) and joined back.
    """
    def ask(role: str, kind, key):
        return F.struct(F.lit(role).alias("role"), kind.alias("kind"), key.alias("key"))

    asks = ch.select("seq", F.explode(F.array(
        ask("tg", F.col("t_kind"), F.col("t_key")),
        ask("rf", F.col("r_kind"), F.col("r_key")),
        ask("nm", F.col("n_kind_"), F.col("n_key_")),
        ask("fl", F.lit("flag"), F.col("actor_email")),
    )).alias("a")).select("seq", "a.*").filter(F.col("kind").isNotNull() & F.col("key").isNotNull())
    ents = entities(t, asks.select("kind", "key").distinct())
    hits = asks.join(ents, (asks.kind == ents.e_kind) & (asks.key == ents.e_id))
    found = hits.groupBy(F.col("seq").alias("_seq")).agg(*[
        F.max(F.when(F.col("role") == role, F.col(c))).alias(f"{role}_{c[2:]}")
        for role, cols in LOOKUP_ROLES.items() for c in cols])
    return ch.join(found, ch.seq == found._seq, "left").drop("_seq").withColumnsRenamed(
        {"nm_count": "n_count", "nm_uid": "n_any_id", "nm_team": "n_team", "fl_admin": "a_admin", "fl_platform": "a_platform"})


def decide(t: dict[str, DataFrame], changes: DataFrame) -> DataFrame:
    """Every change with ``status``, ``reason`` and the looked-up columns it used."""

    ch = changes.select(
        "seq", "event_at", "actor_email", "op", "target_id",
        F.coalesce("fields", F.create_map().cast("map<string,string>")).alias("fields"),
    ).selectExpr("*", f"{TARGET_KIND} AS t_kind", f"{TARGET_KEY} AS t_key", f"{REF_KIND} AS r_kind",
                 f"{REF_KEY} AS r_key", f"{NAME_KIND} AS n_kind_", f"{NAME_KEY} AS n_key_")
    ch = _lookup_all(ch, t)
    ch = ch.selectExpr("*", f"{GRANT_TEAM} AS g_team", f"{MEMBER_TEAM} AS m_team", f"{MEMBER_EMAIL} AS m_email")
    grants = team_grants(t["team_members"])
    # Their key goes through a struct, so that the joins below have exchanges of their own and AQE can split a hot (actor, team).
    grants = grants.groupBy(F.struct("email", "team_id").alias("k")).agg(
        *[F.bool_or(c).alias(c) for c in ("is_member", "is_manager", "is_owner")]).select("k.email", "k.team_id", "is_member", "is_manager", "is_owner")

    # Second round (needs the target's team / e-mail): the actor's grant on a
    # team and the membership a change addresses; both joins key the grant
    # table by (e-mail, team) so its shuffle is shared.
    g = grants.select(F.col("email").alias("_g_email"), F.col("team_id").alias("_g_team"),
                      F.col("is_member").alias("_member"), F.col("is_manager").alias("_manager"),
                      F.col("is_owner").alias("_owner"))
    mem = grants.select(F.col("email").alias("_m_email"), F.col("team_id").alias("_m_team"),
                        F.lit(True).alias("_m_exists"))
    # Most changes address no membership: they join by their seq with a NULL
    # e-mail, which matches nothing and spreads them over the tasks.
    m_email = F.when(ch.m_team.isNotNull(), ch.m_email)
    m_team = F.coalesce(ch.m_team, F.concat(F.lit("#"), ch.seq.cast("string")))
    ch = (
        ch.join(g, (ch.actor_email == g._g_email) & (ch.g_team == g._g_team), "left")
        .join(mem, (m_email == mem._m_email) & (m_team == mem._m_team), "left")
    )
    ch = ch.select(
        *[c for c in ch.columns if not c.startswith("_") and c not in ("a_admin", "a_platform")],
        (F.coalesce("a_admin", F.lit(False)) | F.coalesce("a_platform", F.lit(False))).alias("is_global"),
        F.coalesce("a_platform", F.lit(False)).alias("is_platform"),
        F.coalesce("_member", F.lit(False)).alias("a_member"),
        F.coalesce("_manager", F.lit(False)).alias("a_manager"),
        F.coalesce("_owner", F.lit(False)).alias("a_owner"),
        F.coalesce("_m_exists", F.lit(False)).alias("m_exists"),
    ).selectExpr("*", f"{_failed_sql()} AS failed", f"{_name_rule_sql()} AS name_rule", f"{CLAIM_KEY} AS claim_key")
    if changes.where(_op(*CLAIM_OPS)).isEmpty():
        ch = ch.withColumn(LOST, F.lit(False))
    else:
        # The fixpoint's rounds read the looked-up changes, so they are written once.
        ch = write_and_read(ch, "looked-up-changes")
        # Claims that win need no row: changes join those that lost by their seq.
        lost = claims(ch).where("not won").select(F.col("seq").alias("_lost"))
        ch = ch.join(lost, F.col("seq") == F.col("_lost"), "left").withColumn(LOST, F.col("_lost").isNotNull()).drop("_lost")
    status, reason = _outcome_sql()
    # A name that is lost counts unless a rule before it fails; ops without a rule on names lose none.
    ch = ch.selectExpr("*", f"CASE WHEN {LOST} AND coalesce(failed > name_rule, name_rule IS NOT NULL) THEN name_rule ELSE failed END AS rule")
    return ch.selectExpr("*", f"{status} AS status", f"{reason} AS reason")


# -------------------------------------------------------------- claims ---


def _moves(ch: DataFrame, claim: DataFrame) -> DataFrame:
    """(who, at): the accepted changes that take a holder of a claimed name away, other than renames."""
    ok = ch.where("failed IS NULL")
    direct = ok.selectExpr(_sql_case({
        ("delete_domain",): "concat('domain_name|', target_id)", ("delete_layer",): "concat('layer_name|', target_id)",
        ("delete_user",): "concat('user_email|', target_id)",
        ("remove_member", "unassign_user"): "concat('member|', char_length(m_team), '|', m_team, '|', m_email)"}) + " AS who", "seq AS at")
    # A team takes its domains with it: those that hold a claimed name, or claim one.
    theirs = claim.select(F.explode(F.array(F.struct("who", F.col("who_team").alias("team")),
                                            F.struct(F.col("holder").alias("who"), F.col("n_team").alias("team")))).alias("x"))
    theirs = theirs.select("x.*").where("who IS NOT NULL AND team IS NOT NULL").distinct()
    teams = ok.where("op = 'delete_team'").groupBy(F.col("target_id").alias("_team")).agg(F.min("seq").alias("at"))
    cascade = theirs.join(teams, F.col("team") == F.col("_team")).select("who", "at")
    return direct.where("who IS NOT NULL").union(cascade)


def claims(ch: DataFrame) -> DataFrame:
    """(seq, won): every claim on a unique name, in the order of seq, as a fixpoint over the names still open.

    ``ch`` holds the looked-up changes.  A claim is a create, or a rename of
    its target; it holds the name if all other rules pass and its target is
    not deleted by a lower seq.  A round takes each name's first open claim:
    the name's holder is the last claim that won and holds, or the
    snapshot's row.  If the holder has moved away since, the claim wins; if
    it may yet turn out to have moved (a rename that is open itself), the
    name waits; else the claim loses unless the holder renames itself.  All
    later claims up to the next possible move of the holder lose in the same
    round, so a name that a third of all changes claim takes one round, and
    the rounds grow with the chain of moves, not with the claims.  Rounds
    are written tables; only a count comes to the driver.
    """
    rename = F.col("op").isin("update_domain", "update_layer")
    kind = F.when(F.col("op") == "add_member", "member").otherwise(F.col("n_kind_"))
    holder = (F.when(F.col("op") == "add_member", F.when(F.col("m_exists"), F.col("claim_key")))
              .when(F.col("n_count") == 1, F.concat(F.col("n_kind_"), F.lit("|"), F.col("n_any_id")))
              # Held by several rows: nobody's move frees it.
              .when(F.col("n_count") > 1, F.lit("several")))
    who = (F.when(F.col("op") == "add_member", F.col("claim_key")).when(rename, F.concat(kind, F.lit("|"), F.col("target_id")))
           .otherwise(F.concat(F.lit("new|"), F.col("op"), F.lit("|"), F.col("seq").cast("string"))))
    undecided = F.lit(None).cast("boolean")
    claim = ch.where("claim_key IS NOT NULL AND (failed IS NULL OR failed > name_rule)").select(
        "seq", F.col("claim_key").alias("key"), who.alias("who"), rename.alias("rename"), holder.alias("holder"),
        F.col("failed").isNull().alias("holds"), F.when(F.col("n_count") == 1, F.col("n_team")).alias("n_team"),
        F.when(rename, F.col("tg_team")).when(F.col("op") == "create_domain", F.col("rf_team")).alias("who_team"), undecided.alias("won"))
    # An assignment sets a membership whether it is free or not.
    put = F.concat(F.lit("member|"), F.char_length("m_team").cast("string"), F.lit("|"), "m_team", F.lit("|"), "m_email")
    none = F.lit(None).cast("string")
    puts = ch.where("op = 'assign_user' AND failed IS NULL").select(
        "seq", put.alias("key"), put.alias("who"), F.lit(False).alias("rename"), F.when(F.col("m_exists"), put).alias("holder"),
        F.lit(True).alias("holds"), none.alias("n_team"), none.alias("who_team"), F.lit(True).alias("won"))
    claim = claim.union(puts.join(claim.select(F.col("key").alias("_key")).distinct(), F.col("key") == F.col("_key"), "left_semi"))
    with scratch(ch.sparkSession) as keep:
        moves = write_and_read(_moves(ch, claim), "claims-moves")
        gone = moves.groupBy(F.col("who").alias("_who")).agg(F.min("at").alias("gone_at"))
        claim = claim.join(gone, F.col("who") == F.col("_who"), "left")
        # A membership's removal frees it; a renamed row's removal before the rename voids the rename's hold.
        holds = F.col("holds") & ~(F.col("rename") & F.coalesce(F.col("gone_at") < F.col("seq"), F.lit(False)))
        claim = write_and_read(claim.withColumn("holds", holds)
                               .select("seq", "key", "who", "rename", "holder", "holds", "won"), "claims-open")
        while not claim.where("won IS NULL").isEmpty():
            seq, holds = F.col("seq"), F.when(F.col("holds"), F.col("seq"))
            # Each name's first open claim (s, by w), and its first that would hold it (hs, by wh).
            first = claim.where("won IS NULL").groupBy("key").agg(
                F.min(seq).alias("s"), F.min_by("who", seq).alias("w"), F.min_by("holds", seq).alias("h"), F.min_by("rename", seq).alias("ren"),
                F.min(holds).alias("hs"), F.min_by("who", holds).alias("wh"))
            # The holder before s: the last claim that won and holds, else the snapshot's.
            begun = F.when(F.col("won") & F.col("holds") & (seq < F.col("s")), seq)
            held = claim.join(first.select(F.col("key").alias("_key"), "s"), F.col("key") == F.col("_key")).groupBy("key").agg(
                F.max_by("who", begun).alias("last"), F.max(begun).alias("since"), F.max("holder").alias("holder"))
            state = first.join(held, "key").withColumn("owner", F.coalesce("last", "holder")).withColumn(
                "since", F.coalesce("since", F.lit(-2 ** 63)))
            # Moves away: deletes, and renames that won (sure) or are open.
            going = moves.select("who", "at", F.lit(True).alias("sure")).union(
                claim.where("rename AND holds AND (won IS NULL OR won)").select("who", "seq", F.coalesce("won", F.lit(False))))
            side = lambda name, x, after: F.struct(F.lit(name).alias("side"), F.col(x).alias("x"), F.col(after).alias("after"))
            asked = state.select("key", "s", "since", F.inline(F.array(side("o", "owner", "s"), side("w", "w", "s"), side("h", "wh", "hs"))))
            before = (F.col("at") > F.col("since")) & (F.col("at") < F.col("s"))
            seen = asked.join(going, F.col("x") == F.col("who")).groupBy(F.col("key").alias("_key")).agg(
                F.min(F.when((F.col("side") == "o") & before & F.col("sure"), F.col("at"))).alias("moved"),
                F.min(F.when((F.col("side") == "o") & before & ~F.col("sure"), F.col("at"))).alias("maybe"),
                *[F.min(F.when((F.col("side") == x) & (F.col("at") > F.col("after")), F.col("at"))).alias(f"next_{x}") for x in "owh"])
            state = state.join(seen, F.col("key") == F.col("_key"), "left").drop("_key")
            free = F.col("owner").isNull() | F.col("moved").isNotNull()
            own = ~free & F.col("ren") & (F.col("owner") == F.col("w"))
            ever = F.lit(2 ** 63 - 1)
            state = state.where(free | own | F.col("maybe").isNull()).select(
                F.col("key").alias("_key"), F.when(free, "free").when(own, "own").otherwise("held").alias("is"), "s", "h",
                F.coalesce("hs", ever).alias("hs"), *[F.coalesce(f"next_{x}", ever).alias(f"next_{x}") for x in "owh"])
            now = claim.join(state, F.col("key") == F.col("_key"), "left")
            # A free name goes to the first that would hold it; an own one stays; then all lose until the holder may move.
            wins = F.when(F.col("is") == "free", seq <= F.col("hs")).when(F.col("is") == "own", seq == F.col("s")).otherwise(F.lit(False))
            loses = (F.when(F.col("is") == "free", seq < F.col("next_h")).when(F.col("is") == "own", F.col("h") & (seq < F.col("next_w")))
                     .when(F.col("is") == "held", seq < F.col("next_o")).otherwise(F.lit(False)))
            won = F.when(F.col("won").isNull() & F.col("_key").isNotNull() & wins, F.lit(True)).when(
                F.col("won").isNull() & F.col("_key").isNotNull() & loses, F.lit(False)).otherwise(F.col("won"))
            now = write_and_read(now.select("seq", "key", "who", "rename", "holder", claim.holds, won.alias("won")), "claims-open")
            discard(claim)
            claim = now
        keep(claim)
    return claim.select("seq", "won")


# -------------------------------------------------------------- effects ---


def _last_values(accepted: DataFrame, key_cols: list[str], fields_: list[str]) -> DataFrame:
    """Per key: for every field, was it set (``has_<f>``) and its last value by seq (``new_<f>``)."""
    aggs = []
    for name in fields_:
        present = F.map_contains_key("fields", F.lit(name))
        aggs.append(F.bool_or(present).alias(f"has_{name}"))
        aggs.append(F.max_by(f(name), F.when(present, F.col("seq"))).alias(f"new_{name}"))
    aggs.append(F.max("event_at").alias("last_at"))
    return accepted.groupBy(*key_cols).agg(*aggs)


def _apply_updates(table: DataFrame, updates: DataFrame, key_cols: list[str], fields_: list[str],
                   types: dict[str, str], stamp: str | None = None) -> DataFrame:
    """Left join ``updates`` onto ``table``; a set field replaces the old value."""
    renamed = updates.select(*[F.col(k).alias(f"_k_{k}") for k in key_cols],
                             *[c for c in updates.columns if c not in key_cols])
    cond = reduce(lambda a, b: a & b, [table[k] == renamed[f"_k_{k}"] for k in key_cols])
    joined = table.join(renamed, cond, "left")
    out = []
    for c in table.columns:
        if c in fields_:
            new = F.col(f"new_{c}")
            if types.get(c, "string") != "string":
                new = new.try_cast(types[c])
            out.append(F.when(F.coalesce(F.col(f"has_{c}"), F.lit(False)), new).otherwise(table[c]).alias(c))
        elif stamp is not None and c == stamp:
            out.append(F.coalesce(F.col("last_at"), table[c]).alias(c))
        else:
            out.append(table[c])
    return joined.select(*out)


# Columns of the decided frame that the effects read.
DECIDED_COLUMNS = ["seq", "event_at", "actor_email", "op", "target_id", "fields", "status", "reason",
                   "tg_id", "tg_email", "tg_uid", "tg_name", "tg_owner", "m_team", "m_email", "m_exists"]


def decided(tables: dict[str, DataFrame], changes: DataFrame, materialize: bool = True) -> DataFrame:
    """The decided change frame, cut from its lineage once.

    Every table's effects and the decisions read it, so it is computed
    once and written as a table under the shared checkpoint folder (it
    survives a lost executor; nothing is kept on one machine).
    """
    if not materialize:
        return decide(tables, changes).select(*DECIDED_COLUMNS)
    with scratch(changes.sparkSession) as keep:
        # The records are asked several times (their lookups, their claims, themselves): what makes them runs once.
        changes = write_and_read(changes, "changes")
        return keep(write_and_read(decide(tables, changes).select(*DECIDED_COLUMNS), "decided-changes"))


#: What a change removes directly, as (kind, key): rows of that kind, and in ``gone`` all that hangs on them.
GONE_KIND = _sql_case({("delete_team",): "'teams'", ("delete_domain",): "'domains'", ("delete_asset",): "'assets'",
                       ("delete_layer",): "'data_layers'", ("delete_user",): "'users'"})


class ChangedTables(Mapping):
    """The catalog after a batch; each table's plan is built when first read.

    ``base`` may hold the tables cut to some of their rows, those that the
    result is wanted for (``touched`` tells which rows change); lookups over
    whole tables read ``snapshot``.
    """

    def __init__(self, snapshot: dict[str, DataFrame], ok: DataFrame, base: Mapping[str, DataFrame] | None = None,
                 gone: dict[str, DataFrame] | None = None):
        self._snap, self._ok, self._base, self._gone = snapshot, ok, base or snapshot, {} if gone is None else gone
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            if name not in self._base:
                raise KeyError(name)
            builder = getattr(self, f"_{name}", None)
            frame = builder() if builder else self._base[name]
            if name in schemas.CATALOG_SCHEMAS:
                frame = frame.select(*schemas.CATALOG_SCHEMAS[name].fieldNames())
            self._built[name] = frame
        return self._built[name]

    def __iter__(self):
        return iter(self._base)

    def __len__(self) -> int:
        return len(self._base)

    def acc(self, *ops: str) -> DataFrame:
        """Accepted changes of these ops."""
        return self._ok.filter(_op(*ops))

    # --- what goes away (deletes and cascades) ---------------------------

    def gone(self, name: str) -> DataFrame:
        """The rows of a table that the batch's deletes take, cascades and rows made in the batch included.

        (id) for most tables, (team_id, email) for memberships; requests go
        with their assets and have no frame of their own.  A table's frame
        is made when it is first asked for: it reads that table and what
        goes before it in the order teams, domains, assets, and is written
        once if it scans a table.
        """
        if name not in self._gone:
            found = {"domains": self._gone_domains, "assets": self._gone_assets, "team_members": self._gone_members}.get(name)
            if found is None:
                self._gone[name] = self._seeds().where(F.col("kind") == name).select(F.col("key").alias("id")).distinct()
            else:
                self._gone[name] = write_and_read(found(), f"gone-{name}")
        return self._gone[name]

    def _seeds(self) -> DataFrame:
        """(kind, key): what is deleted directly; the accounts' e-mails too."""
        deletes = self._ok.withColumn("kind", F.expr(GONE_KIND)).where("kind IS NOT NULL")
        return deletes.select("kind", F.col("target_id").alias("key")).union(self.acc("delete_user").select(F.lit("emails"), "tg_email"))

    @staticmethod
    def _hanging(rows: DataFrame, hangs_on: Mapping[str, str], known: DataFrame, found: list[str]) -> DataFrame:
        """Distinct ``found`` of the rows that hang on a known (kind, key) by a column of theirs (kind: column)."""
        # Grouped by a struct of the key: the semi join has an exchange of its own, and AQE can split a hot parent's rows.
        known = known.where("key IS NOT NULL").groupBy(F.struct("kind", "key").alias("k")).agg(F.count("*").alias("n"))
        known = known.select(F.col("k.kind").alias("_kind"), F.col("k.key").alias("_key"))
        keys = [F.struct(F.lit(kind).alias("kind"), F.col(c).alias("key")) for kind, c in hangs_on.items()]
        asked = rows.select(*found, F.explode(F.array(*keys)).alias("a"))
        return asked.join(known, (F.col("a.kind") == F.col("_kind")) & (F.col("a.key") == F.col("_key")), "left_semi").drop("a").distinct()

    def _gone_domains(self) -> DataFrame:
        domains = self._snap["domains"].select("id", "team_id").unionByName(self._domain_inserts().select("id", "team_id"))
        return self._hanging(domains, {"domains": "id", "teams": "team_id"}, self._seeds(), ["id"])

    def _gone_assets(self) -> DataFrame:
        assets = self._snap["assets"].select("id", "domain_id").unionByName(self._asset_inserts().select("id", "domain_id"))
        return self._hanging(assets, {"assets": "id", "domains": "domain_id"},
                             self._seeds().union(self.gone("domains").select(F.lit("domains"), "id")), ["id"])

    def _gone_members(self) -> DataFrame:
        members = self._snap["team_members"].select("team_id", "email").unionByName(
            self._memberships().where("id IS NOT NULL").select("team_id", "email"))
        return self._hanging(members, {"teams": "team_id", "emails": "email"}, self._seeds(), ["team_id", "email"])

    def _left(self, name: str, table: DataFrame) -> DataFrame:
        """``table`` without its gone rows."""
        gone = self.gone(name).select(F.col("id").alias("_gone"))
        return table.join(gone, table.id == F.col("_gone"), "left_anti")

    def on(self, base: Mapping[str, DataFrame]) -> ChangedTables:
        """The same changes on tables cut to some of their rows."""
        return ChangedTables(self._snap, self._ok, base, self._gone)

    def touched(self) -> DataFrame:
        """(table, key): what changes, by the key that the store buckets the table by; a superset, distinct."""
        parts = [self.gone(name).select(F.lit(name).alias("table"), F.col("id").alias("key"))
                 for name in ("teams", "domains", "assets", "data_layers", "users")]
        parts.append(self.gone("team_members").select(F.lit("team_members"), "team_id"))
        went = self.gone("assets").select(F.col("id").alias("_id"))
        requests = self._snap["access_requests"].select("asset_id").join(went, F.col("asset_id") == F.col("_id"), "left_semi")
        layers = self.gone("data_layers").select(F.col("id").alias("_layer"))
        unclassified = self._snap["assets"].select("id", "layer_id").join(layers, F.col("layer_id") == F.col("_layer"), "left_semi")
        parts += [requests.select(F.lit("access_requests"), "asset_id"), unclassified.select(F.lit("assets"), "id"),
                  self._memberships().select(F.lit("team_members"), "team_id")]
        for name, ops, key in (("assets", ("update_asset", "publish_asset", "unpublish_asset"), F.col("target_id")),
                               ("domains", ("update_domain",), F.col("target_id")), ("teams", ("update_team",), F.col("target_id")),
                               ("data_layers", ("update_layer",), F.col("target_id")), ("users", ("set_superadmin",), F.col("target_id")),
                               ("users", ("update_profile",), F.col("tg_uid")), ("access_requests", ("request_access",), F.col("target_id")),
                               ("assets", ("create_asset",), new_id("create_asset")), ("domains", ("create_domain",), new_id("create_domain")),
                               ("teams", ("create_team",), new_id("create_team")), ("data_layers", ("create_layer",), new_id("create_layer")),
                               ("users", ("register_user",), new_id("register_user"))):
            parts.append(self.acc(*ops).select(F.lit(name), key))
        return reduce(DataFrame.union, parts).where("key IS NOT NULL").distinct()

    # --- inserts ---------------------------------------------------------

    def _asset_inserts(self) -> DataFrame:
        return self.acc("create_asset").select(
            new_id("create_asset").alias("id"), f("domain_id").alias("domain_id"), f("name").alias("name"),
            *[F.coalesce(f(c), F.lit(d)).alias(c) for c, d in (
                ("description", ""), ("source_type", ""), ("connection_uri", ""), ("schema_json", "{}"),
                ("owner_email", ""), ("tags", ""))],
            f("quality_score").try_cast("double").alias("quality_score"),
            F.coalesce(f("freshness"), F.lit("")).alias("freshness"),
            F.lit(False).alias("published"), F.col("event_at").alias("created_at"),
            F.col("event_at").alias("updated_at"), f("layer_id").alias("layer_id"),
        )

    def _domain_inserts(self) -> DataFrame:
        return self.acc("create_domain").select(
            new_id("create_domain").alias("id"), f("name").alias("name"),
            F.coalesce(f("description"), F.lit("")).alias("description"), F.lit("").alias("owner_email"),
            f("team_id").alias("team_id"), F.col("event_at").alias("created_at"),
            F.col("event_at").alias("updated_at"))

    def _request_inserts(self) -> DataFrame:
        return self.acc("request_access").select(
            new_id("request_access").alias("id"), F.col("target_id").alias("asset_id"),
            F.coalesce(f("requester_email"), F.col("actor_email")).alias("requester_email"),
            F.lit("pending").alias("status"), F.col("event_at").alias("created_at"),
            F.lit(None).cast("timestamp_ntz").alias("decision_at"))

    def _memberships(self) -> DataFrame:
        """(team_id, email, id, role, put, removed): what the batch's changes say of each membership.

        id is a new row's: the first one made, or after a removal the last
        (null if the membership stood at batch start and was not removed);
        ``put`` is the seq of the last change that makes or sets it,
        ``removed`` that of the last that removes it; role is the last one
        set.
        """
        team, email, role = F.col("m_team").alias("team_id"), F.col("m_email").alias("email"), F.coalesce(f("role"), F.lit("member"))
        no_id, no_seq, seq = F.lit(None).cast("string").alias("id"), F.lit(None).cast("long"), F.col("seq")

        def said(ops: tuple, team: Column, email: Column, id_: Column, role: Column, put: Column, removed: Column) -> DataFrame:
            stood = F.lit(False) if ops == ("create_team",) else F.col("m_exists")
            return self.acc(*ops).select(team, email, id_, role.alias("role"), put.alias("put"), removed.alias("removed"),
                                         stood.alias("stood"), seq.alias("at"))

        events = [
            said(("create_team",), new_id("create_team").alias("team_id"), F.col("actor_email").alias("email"),
                 new_id("create_team_owner").alias("id"), F.lit("owner"), seq, no_seq),
            said(("add_member",), team, email, new_id("add_member").alias("id"), role, seq, no_seq),
            said(("assign_user",), team, email, new_id("assign_user").alias("id"), role, seq, no_seq),
            said(("change_role",), team, email, no_id, f("role"), no_seq, no_seq),
            said(("remove_member", "unassign_user"), team, email, no_id, F.lit(None).cast("string"), no_seq, seq)]
        made = F.when(F.col("id").isNotNull(), F.col("at"))
        return (reduce(DataFrame.unionByName, events).groupBy("team_id", "email").agg(
            F.max_by("role", F.when(F.col("role").isNotNull(), F.col("at"))).alias("role"), F.max("put").alias("put"),
            F.max("removed").alias("removed"), F.bool_or("stood").alias("stood"), F.max_by("id", made).alias("last_id"),
            F.min_by("id", made).alias("first_id"))
            .select("team_id", "email", F.when(F.col("removed").isNotNull(), F.col("last_id")).when(~F.col("stood"), F.col("first_id")).alias("id"),
                    "role", "put", "removed"))

    # --- tables ----------------------------------------------------------

    def _assets(self) -> DataFrame:
        fields_ = schemas.UPDATABLE_FIELDS["assets"]
        table = self._base["assets"].unionByName(self._asset_inserts())
        flag_rows = self.acc("publish_asset", "unpublish_asset").withColumn(
            "fields", F.create_map(F.lit("published"), F.when(_op("publish_asset"), "true").otherwise("false")))
        upd = self.acc("update_asset").withColumn("fields", F.map_filter("fields", lambda k, v: k.isin(*fields_)))
        updates = _last_values(upd.unionByName(flag_rows).select(
            F.col("target_id").alias("id"), "seq", "event_at", "fields"), ["id"], fields_ + ["published"])
        table = _apply_updates(table, updates, ["id"], fields_ + ["published"],
                               {"quality_score": "double", "published": "boolean"}, stamp="updated_at")
        table = self._left("assets", table)
        # Assets of a removed layer become unclassified.
        lay = self.acc("delete_layer").select(F.col("target_id").alias("_gone_layer")).distinct()
        joined = table.join(lay, table.layer_id == lay._gone_layer, "left")
        return joined.select(*[
            F.when(F.col("_gone_layer").isNotNull(), F.lit(None).cast("string")).otherwise(table[c]).alias(c)
            if c == "layer_id" else table[c] for c in table.columns])

    def _access_requests(self) -> DataFrame:
        """Requests whose asset stays: they meet the gone assets by asset, so no list of their own ids is made."""
        table = self._base["access_requests"].unionByName(self._request_inserts())
        gone = self.gone("assets").select(F.col("id").alias("_gone"))
        return table.join(gone, (table.asset_id == F.col("_gone")) & table.id.isNotNull(), "left_anti")

    def _domains(self) -> DataFrame:
        fields_ = schemas.UPDATABLE_FIELDS["domains"]
        table = self._base["domains"].unionByName(self._domain_inserts())
        updates = _last_values(self.acc("update_domain").select(
            F.col("target_id").alias("id"), "seq", "event_at", "fields"), ["id"], fields_)
        table = _apply_updates(table, updates, ["id"], fields_, {}, stamp="updated_at")
        return self._left("domains", table)

    def _teams(self) -> DataFrame:
        fields_ = schemas.UPDATABLE_FIELDS["teams"]
        inserts = self.acc("create_team").select(
            new_id("create_team").alias("id"), f("name").alias("name"),
            F.coalesce(f("description"), F.lit("")).alias("description"), F.lit(False).alias("is_platform"))
        table = self._base["teams"].unionByName(inserts)
        updates = _last_values(self.acc("update_team").select(
            F.col("target_id").alias("id"), "seq", "event_at", "fields"), ["id"], fields_)
        table = _apply_updates(table, updates, ["id"], fields_, {})
        return self._left("teams", table)

    def _team_members(self) -> DataFrame:
        """One full outer join of the memberships with what the batch says of them, removals and cascades included."""
        said = self._memberships().select("team_id", "email", F.col("id").alias("new_id"), F.col("role").alias("new_role"), "put", "removed",
                                          F.lit(False).alias("went"))
        gone = self.gone("team_members").withColumn("_went", F.lit(True))
        said = said.unionByName(gone.select("team_id", "email", F.lit(None).cast("string").alias("new_id"),
                                            F.lit(None).cast("string").alias("new_role"), F.lit(None).cast("long").alias("put"),
                                            F.lit(None).cast("long").alias("removed"), F.col("_went").alias("went")))
        said = said.groupBy(F.struct(F.col("team_id").alias("t"), F.col("email").alias("e")).alias("k")).agg(
            *[F.max(c).alias(c) for c in ("new_id", "new_role", "put", "removed")], F.bool_or("went").alias("went"))
        table = self._base["team_members"]
        out = table.join(said, (table.team_id == F.col("k.t")) & (table.email == F.col("k.e")), "full_outer")
        # A removal ends the row that stood before it; a later change makes the row anew.
        ended = F.col("removed").isNotNull()
        stays = ~F.coalesce("went", F.lit(False)) & (~ended | F.coalesce(F.col("put") > F.col("removed"), F.lit(False)))
        made = F.col("new_id").isNotNull() & (ended | table.id.isNull())
        return out.where(stays & (table.id.isNotNull() | table.team_id.isNotNull() | table.email.isNotNull() | made)).select(
            F.when(made, F.col("new_id")).otherwise(table.id).alias("id"), F.coalesce(table.team_id, F.col("k.t")).alias("team_id"),
            F.coalesce(table.email, F.col("k.e")).alias("email"), F.coalesce("new_role", table.role).alias("role"))

    def _data_layers(self) -> DataFrame:
        fields_ = schemas.UPDATABLE_FIELDS["data_layers"]
        last = self._snap["data_layers"].agg(F.coalesce(F.max("position"), F.lit(-1)).alias("p")).select(
            "p").scalar()
        # New layers are appended after the current last position, in seq order.
        inserts = ordinal(self.acc("create_layer").select(
            new_id("create_layer").alias("id"), F.trim(f("name")).alias("name"),
            F.coalesce(f("color"), F.lit(vocab.DEFAULT_LAYER_COLOR)).alias("color"), "seq",
            F.col("event_at").alias("created_at")), "seq", "_ord").select(
            "id", "name", "color", (last + F.col("_ord")).cast("int").alias("position"), "created_at")
        table = self._base["data_layers"].unionByName(inserts)
        rows = self.acc("update_layer").withColumn(
            "fields", F.transform_values("fields", lambda k, v: F.when(k == "name", F.trim(v)).otherwise(v)))
        updates = _last_values(rows.select(F.col("target_id").alias("id"), "seq", "event_at", "fields"),
                               ["id"], fields_)
        table = _apply_updates(table, updates, ["id"], fields_, {"position": "int"})
        return self._left("data_layers", table)

    def _users(self) -> DataFrame:
        signups = self.acc("register_user")
        first_ever = self._snap["users"].select(F.count(F.lit(1))).scalar() == 0
        first_signup = signups.filter(F.col("actor_email").isNull()).select(F.min("seq")).scalar()
        inserts = signups.select(
            new_id("register_user").alias("id"), f("email").alias("email"),
            (first_ever & F.col("actor_email").isNull() & (F.col("seq") == first_signup)).alias("is_superadmin"),
            F.coalesce(f("name"), F.lit("")).alias("name"), F.lit("").alias("avatar"),
            F.col("event_at").alias("created_at"))
        table = self._base["users"].unionByName(inserts)
        admin_rows = self.acc("set_superadmin").select(
            F.col("target_id").alias("id"), "seq", "event_at",
            F.create_map(F.lit("is_superadmin"),
                         F.when(F.lower(f("promote")).isin("true", "1", "yes", "on"), "true")
                         .otherwise("false")).alias("fields"))
        profile_rows = self.acc("update_profile").select(
            F.col("tg_uid").alias("id"), "seq", "event_at",
            F.transform_values(F.map_filter("fields", lambda k, v: k.isin("name", "avatar")),
                               lambda k, v: F.when(k == "name", F.trim(v)).otherwise(v)).alias("fields"))
        updates = _last_values(admin_rows.unionByName(profile_rows), ["id"], ["is_superadmin", "name", "avatar"])
        table = _apply_updates(table, updates, ["id"], ["is_superadmin", "name", "avatar"],
                               {"is_superadmin": "boolean"})
        return self._left("users", table)


def decisions_of(ch: DataFrame) -> DataFrame:
    """``seq, op, target_id, status, reason``; a created row's decision carries its new id."""
    return ch.select(
        "seq", "op",
        F.coalesce(F.when(F.col("status") < 300, _pick({(op,): new_id(op) for op in CREATE_OPS})),
                   F.col("target_id")).alias("target_id"),
        F.col("status").cast("int").alias("status"), "reason",
    )


def apply_changes(tables: dict[str, DataFrame], changes: DataFrame,
                  materialize: bool = True, batch: str | None = None) -> tuple[ChangedTables, DataFrame]:
    """Decide every change against the snapshot; return the new tables and the decisions.

    ``batch`` names the change set: ids of created rows hold it, so two sets
    with equal seqs create different rows.
    """
    # A record's own field of that name never gets into an id.
    own = F.map_filter(F.coalesce("fields", F.create_map().cast("map<string,string>")), lambda k, _: k != BATCH_FIELD)
    if batch is not None:
        own = F.map_concat(own, F.create_map(F.lit(BATCH_FIELD), F.lit(batch)))
    changes = changes.withColumn("fields", own)
    ch = decided(tables, changes, materialize)
    return ChangedTables(tables, ch.filter(F.col("status") < 300)), decisions_of(ch)


def ordinal(df: DataFrame, order_col: str, out_col: str) -> DataFrame:
    """1-based position of each row by ``order_col`` (unique), whatever its values, without a window over all rows.

    The rows are written in range partitions of the order; a row's position
    is its rank in its range plus the rows of the ranges before.  Only the
    count of each range comes to the driver.
    """
    ranged = write_and_read(df.repartitionByRange(F.col(order_col)).withColumn("_range", F.spark_partition_id()), "ranged-rows")
    earlier, before = 0, {}
    for r in sorted(ranged.groupBy("_range").count().collect()):
        before[r["_range"]] = earlier
        earlier += r["count"]
    offsets = df.sparkSession.createDataFrame(sorted(before.items()), "_in int, _offset long")
    within = F.row_number().over(Window.partitionBy("_range").orderBy(order_col))
    return (ranged.withColumn("_within", within).join(F.broadcast(offsets), F.col("_range") == F.col("_in"))
            .withColumn(out_col, F.col("_offset") + F.col("_within")).drop("_range", "_in", "_within", "_offset"))


def notifications(tables: dict[str, DataFrame], changes: DataFrame,
                  decided_frame: DataFrame | None = None) -> DataFrame:
    """One owner notification per accepted access request: ``seq, notify_to, subject, body``."""
    from lakeward.functions.columns import notification_body, notification_subject

    ch = decided_frame if decided_frame is not None else decide(tables, changes)
    ok = ch.filter((F.col("op") == "request_access") & (F.col("status") < 300))
    requester = F.coalesce(f("requester_email"), F.col("actor_email"))
    return ok.select(
        "seq", F.col("tg_owner").alias("notify_to"),
        notification_subject(F.col("tg_name")).alias("subject"),
        notification_body(requester, F.col("tg_name"), f("message")).alias("body"),
    )
