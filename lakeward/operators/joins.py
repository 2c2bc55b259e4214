"""Catalog joins (§2.3).  All are equi-joins; none pairs a group with itself.

No broadcast hints: dimension sides (teams, layers, domains) are left to
adaptive execution, which broadcasts a side only after measuring it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeward.functions.columns import contains_pattern
from lakeward.operators.access import assets_with_team
from lakeward.operators.search import asc


def assets_with_domain(assets: DataFrame, domains: DataFrame) -> DataFrame:
    """O-J1: assets carrying their domain name and owning team (inner)."""
    return assets_with_team(assets, domains)


def user_teams(members: DataFrame, teams: DataFrame, emails: list[str] | None = None) -> DataFrame:
    """O-J2: non-platform memberships ``email, team_id, team_name, role`` by team name."""
    m = members if emails is None else members.filter(F.col("email").isin(emails))
    t = teams.filter(~F.coalesce(F.col("is_platform"), F.lit(False))).select(
        F.col("id").alias("team_id"), F.col("name").alias("team_name"))
    return m.join(t, "team_id").select("email", "team_id", "team_name", "role").orderBy(
        *asc("email", "team_name", "team_id"))


def member_domains(domains: DataFrame, members: DataFrame, email: str) -> DataFrame:
    """O-J3: domains of one user's teams (one row per membership row), by name."""
    mine = members.filter(F.col("email") == email).select("team_id")
    return domains.join(mine, "team_id").select(*domains.columns).orderBy(*asc("name", "id"))


def users_with_teams(users: DataFrame, members: DataFrame, teams: DataFrame) -> DataFrame:
    """O-J4: every user with its non-platform memberships, flat.

    One row per (user, membership), or one row with NULL team columns for a
    user without one.  The flat form never gathers a user's memberships
    into one value; order a user's teams by ``team_name`` when reading.
    """
    t = teams.filter(~F.coalesce(F.col("is_platform"), F.lit(False))).select(
        F.col("id").alias("team_id"), F.col("name").alias("team_name"))
    ms = members.join(t, "team_id").select("email", "team_id", "team_name", "role")
    return users.select(
        "id", "email",
        F.coalesce("is_superadmin", F.lit(False)).alias("is_superadmin"),
        F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("avatar", F.lit("")).alias("avatar"),
        "created_at",
    ).join(ms, "email", "left")


def users_with_team_lists(users_flat: DataFrame) -> DataFrame:
    """O-J4, nested form: ``teams`` as an array per user, ordered by team name.

    A user's list is bounded by the number of teams (one membership per
    team and e-mail).
    """
    keys = ["id", "email", "is_superadmin", "name", "avatar", "created_at"]
    return users_flat.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(
            F.col("team_id").isNotNull(),
            F.struct("team_name", "team_id", "role")))).alias("teams")
    )


def assets_with_layer(assets: DataFrame, layers: DataFrame) -> DataFrame:
    """O-J5: layer name and colour when ``layer_id`` resolves (left outer)."""
    lay = layers.select(F.col("id").alias("layer_id"), F.col("name").alias("layer_name"),
                        F.col("color").alias("layer_color"))
    return assets.join(lay, "layer_id", "left")


def domains_with_team(domains: DataFrame, teams: DataFrame) -> DataFrame:
    """O-J6: team name of each domain, falling back to the team id."""
    t = teams.select(F.col("id").alias("team_id"), F.col("name").alias("_team_name"))
    return domains.join(t, "team_id", "left").withColumn(
        "team_name", F.coalesce("_team_name", "team_id")).drop("_team_name")


def manageable_assets(assets: DataFrame, domains: DataFrame, members: DataFrame, email: str) -> DataFrame:
    """O-J7: assets whose team has this member (semi join)."""
    mine = members.filter(F.col("email") == email).select("team_id")
    return assets_with_team(assets, domains).join(mine, "team_id", "left_semi")


def assets_of_team(assets: DataFrame, domains: DataFrame, team_ids: list[str] | DataFrame) -> DataFrame:
    """O-J8: assets whose domain belongs to one of the teams (``IN (subquery)``)."""
    if isinstance(team_ids, DataFrame):
        teams = team_ids.select(F.col(team_ids.columns[0]).alias("team_id"))
    else:
        teams = assets.sparkSession.createDataFrame([(t,) for t in team_ids], "team_id string")
    dom = domains.join(teams, "team_id", "left_semi").select(F.col("id").alias("domain_id"))
    return assets.join(dom, "domain_id", "left_semi")


def member_candidates(users: DataFrame, members: DataFrame, team_id: str, q: str, n: int = 10) -> DataFrame:
    """O-J9: of the first ``n`` e-mail matches, those not yet in the team (case-insensitive)."""
    matches = (
        users.filter(F.col("email").ilike(contains_pattern(q)))
        .select("id", "email").orderBy(*asc("email", "id")).limit(n)
    )
    taken = members.filter(F.col("team_id") == team_id).select(F.lower("email").alias("_lower"))
    return matches.join(taken, F.lower(matches.email) == taken._lower, "left_anti")


def request_targets(requests: DataFrame, assets: DataFrame) -> DataFrame:
    """O-J10: owner e-mail and asset name per request (both sides large)."""
    a = assets.select(F.col("id").alias("asset_id"), F.col("name").alias("asset_name"), "owner_email")
    return requests.join(a, "asset_id")
