"""Access control as set-based jobs (many viewers at once).

A viewer is an e-mail, or NULL for an anonymous caller.  Rules:

* anonymous: published assets only; no domains, no teams;
* global (superadmin flag, or member of a platform team): everything;
* otherwise: published assets plus the assets of the viewer's own teams;
  domains and teams of the viewer's own teams.

Visibility of many viewers is kept *factorized*: a viewer is given scopes
(``published``, ``all``, or one ``team`` scope per membership) instead of one
row per (viewer, asset).  Published assets form one shared set; a team's
drafts are reached through the team key.  No job pairs every member of a
team with every asset of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeward.functions import vocab

SCOPE_PUBLISHED, SCOPE_ALL, SCOPE_TEAM = "published", "all", "team"


# --------------------------------------------------------------- O-X1/X2 ---


def effective_flags(users: DataFrame, members: DataFrame, teams: DataFrame,
                    emails: list[str] | None = None) -> DataFrame:
    """Per e-mail: ``email, is_superadmin, is_platform, is_global``.

    Members of a platform team count even without a user account.  With
    ``emails`` only those e-mails are computed, and the filter reaches the
    scans of users and members before any join or aggregation.
    """
    if emails is not None:
        users = users.filter(F.col("email").isin(emails))
        members = members.filter(F.col("email").isin(emails))
    admins = users.groupBy("email").agg(F.bool_or(F.coalesce("is_superadmin", F.lit(False))).alias("is_superadmin"))
    platform_teams = teams.filter(F.col("is_platform")).select(F.col("id").alias("team_id"))
    platform = (
        members.join(platform_teams, "team_id", "left_semi")
        .select("email").distinct()
        .withColumn("is_platform", F.lit(True))
    )
    return (
        admins.join(platform, "email", "full_outer")
        .select(
            "email",
            F.coalesce("is_superadmin", F.lit(False)).alias("is_superadmin"),
            F.coalesce("is_platform", F.lit(False)).alias("is_platform"),
        )
        .withColumn("is_global", F.col("is_superadmin") | F.col("is_platform"))
    )


def team_grants(members: DataFrame) -> DataFrame:
    """Per (e-mail, team): ``email, team_id, is_member, is_manager, is_owner``.

    Manager means role manager or owner.  Duplicate membership rows (a key
    violation the lake does not prevent) collapse into one grant.
    """
    return members.groupBy("email", "team_id").agg(
        F.lit(True).alias("is_member"),
        F.bool_or(F.col("role").isin(*vocab.MANAGER_ROLES)).alias("is_manager"),
        F.bool_or(F.col("role") == "owner").alias("is_owner"),
    )


# ----------------------------------------------------------------- O-X3 ---


def assets_with_team(assets: DataFrame, domains: DataFrame) -> DataFrame:
    """Assets that reach a domain, with ``team_id`` and ``domain_name``.

    An asset whose domain is missing is invisible to everyone (inner join).
    """
    d = domains.select(F.col("id").alias("domain_id"), "team_id", F.col("name").alias("domain_name"))
    return assets.join(d, "domain_id")


def viewer_is_global(flags: DataFrame, viewer: str | None) -> Column:
    """Scalar subquery: is this one viewer global (false when unknown/anonymous)."""
    if viewer is None:
        return F.lit(False)
    return F.coalesce(
        flags.filter(F.col("email") == viewer).agg(F.bool_or("is_global")).scalar(), F.lit(False)
    )


def _own_teams(members: DataFrame, viewer: str, key: str = "team_id") -> DataFrame:
    """The viewer's teams as a set (flag column ``_own``); the e-mail filter reaches the scan."""
    return (members.filter(F.col("email") == viewer).select(F.col("team_id").alias(key)).distinct()
            .withColumn("_own", F.lit(True)))


def visible_assets(assets: DataFrame, domains: DataFrame, members: DataFrame, flags: DataFrame,
                   viewer: str | None) -> DataFrame:
    """Assets one viewer may see (with ``team_id``, ``domain_name``).

    One pass over the assets: a left join with the viewer's own team set
    and one filter (published, or the viewer is global, or the asset's
    team is the viewer's).
    """
    rows = assets_with_team(assets, domains)
    if viewer is None:
        return rows.filter(F.col("published"))
    is_global = viewer_is_global(flags, viewer)
    own = _own_teams(members, viewer)
    return (rows.join(own, "team_id", "left")
            .filter(F.coalesce(F.col("published"), F.lit(False)) | is_global | F.col("_own").isNotNull())
            .drop("_own"))


# ----------------------------------------------------------------- O-X4 ---


def viewers_of(users: DataFrame, include_anonymous: bool = True) -> DataFrame:
    """The viewer list: every account e-mail, plus NULL for anonymous."""
    v = users.select(F.col("email").alias("viewer")).distinct()
    if include_anonymous:
        v = v.unionByName(users.sparkSession.range(1).select(F.lit(None).cast("string").alias("viewer")))
    return v


def visibility_scopes(viewers: DataFrame, members: DataFrame, flags: DataFrame) -> DataFrame:
    """Factorized visibility of many viewers: ``viewer, scope, team_id``.

    * every viewer: (``published``, NULL);
    * global viewers: (``all``, NULL) — drafts of every team;
    * other viewers: (``team``, team_id) per membership — drafts of that team.

    The visible assets of a viewer are the union over its scopes; published
    rows are never paired with viewers.
    """
    v = viewers.select("viewer")
    g = flags.filter(F.col("is_global")).select(F.col("email").alias("viewer"))
    published = v.select("viewer", F.lit(SCOPE_PUBLISHED).alias("scope"), F.lit(None).cast("string").alias("team_id"))
    global_v = v.join(g, "viewer", "left_semi")
    everything = global_v.select("viewer", F.lit(SCOPE_ALL).alias("scope"), F.lit(None).cast("string").alias("team_id"))
    own = (
        v.join(g, "viewer", "left_anti")
        .join(members.select(F.col("email").alias("viewer"), "team_id").distinct(), "viewer")
        .select("viewer", F.lit(SCOPE_TEAM).alias("scope"), "team_id")
    )
    return published.unionByName(everything).unionByName(own)


def scope_assets(assets: DataFrame, domains: DataFrame) -> DataFrame:
    """The assets behind the scopes: ``scope, team_id`` and the asset's columns, one row per asset.

    Published assets are in the scope ``published`` (team_id NULL), drafts
    in their team's scope; the scope ``all`` is the drafts of every team.
    """
    rows = assets_with_team(assets, domains)
    shown = F.coalesce(F.col("published"), F.lit(False))
    team = F.when(~shown, F.col("team_id"))
    return rows.select(F.when(shown, SCOPE_PUBLISHED).otherwise(SCOPE_TEAM).alias("scope"), team.alias("scope_team"),
                       *[c for c in rows.columns])


def visible_assets_batch(assets: DataFrame, domains: DataFrame, members: DataFrame, flags: DataFrame,
                         viewers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """O-X4: (scopes of the viewers, assets of the scopes): which assets each viewer sees, without pairing them.

    ``expand`` pairs them for the viewers that are asked for.
    """
    return visibility_scopes(viewers, members, flags), scope_assets(assets, domains)


def expand(scopes: DataFrame, scoped: DataFrame) -> DataFrame:
    """``viewer, asset_id`` of some viewers' scopes (cut ``scopes`` to the viewers that are asked for)."""
    hit = ((F.col("s") == SCOPE_PUBLISHED) & (F.col("scope") == SCOPE_PUBLISHED)) | (
        (F.col("scope") == SCOPE_TEAM) & ((F.col("s") == SCOPE_ALL) | ((F.col("s") == SCOPE_TEAM) & (F.col("t") == F.col("scope_team")))))
    asked = scopes.select("viewer", F.col("scope").alias("s"), F.col("team_id").alias("t"))
    return scoped.select("id", "scope", "scope_team").join(asked, hit).select("viewer", F.col("id").alias("asset_id"))


def summed_per_viewer(scopes: DataFrame, scoped: DataFrame, *sums: Column) -> DataFrame:
    """Per viewer the sums over its visible assets, from one aggregate per scope (``sums`` over the columns of ``scoped``)."""
    names = [f"_s{i}" for i in range(len(sums))]
    # Grouped by a struct of the key, so that the join back has an exchange of its own and AQE can split a large team.
    per = scoped.groupBy(F.struct("scope", "scope_team").alias("k")).agg(*[F.sum(c).alias(n) for c, n in zip(sums, names, strict=True)])
    per = per.select(F.col("k.scope").alias("_scope"), F.col("k.scope_team").alias("_team"), *names)
    published = per.where(F.col("_scope") == SCOPE_PUBLISHED)
    drafts = per.where(F.col("_scope") == SCOPE_TEAM)
    own = (scopes.where(F.col("scope") == SCOPE_TEAM).join(drafts, F.col("team_id") == F.col("_team")).select("viewer", *names))
    # The two scopes that many viewers share come as scalars: no key is met by all of them.
    shared = scopes.where(F.col("scope") != SCOPE_TEAM).select("viewer", *[
        F.when(F.col("scope") == SCOPE_ALL, drafts.agg(F.sum(n).alias(n)).scalar()).otherwise(published.agg(F.sum(n).alias(n)).scalar()).alias(n)
        for n in names])
    return shared.unionByName(own).groupBy("viewer").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(f"sum_{i}") for i, n in enumerate(names)])


# ----------------------------------------------------------------- O-X5 ---


def visible_asset_counts(assets: DataFrame, domains: DataFrame, members: DataFrame, flags: DataFrame,
                         viewers: DataFrame) -> DataFrame:
    """Per viewer the number of visible assets, without pairing viewers and assets.

    published count + drafts of the viewer's teams (a draft has one team, so
    per-team counts add up), or the full count for a global viewer.
    """
    scopes, scoped = visible_assets_batch(assets, domains, members, flags, viewers)
    counts = summed_per_viewer(scopes, scoped, F.lit(1))
    return counts.select("viewer", F.col("sum_0").cast("long").alias("n_assets"))


# ----------------------------------------------------------- O-X6 / O-X7 ---


def visible_domains(domains: DataFrame, members: DataFrame, flags: DataFrame, viewer: str | None) -> DataFrame:
    """Domains one viewer may list: global all; member own teams'; anonymous none (one pass)."""
    if viewer is None:
        return domains.limit(0)
    is_global = viewer_is_global(flags, viewer)
    own = _own_teams(members, viewer)
    return (domains.join(own, "team_id", "left").filter(is_global | F.col("_own").isNotNull())
            .select(*domains.columns))


def visible_teams(teams: DataFrame, members: DataFrame, flags: DataFrame, viewer: str | None) -> DataFrame:
    """Teams one viewer may list; the platform team is always hidden (one pass)."""
    if viewer is None:
        return teams.limit(0)
    shown = teams.filter(~F.coalesce(F.col("is_platform"), F.lit(False)))
    is_global = viewer_is_global(flags, viewer)
    own = _own_teams(members, viewer, key="id")
    return shown.join(own, "id", "left").filter(is_global | F.col("_own").isNotNull()).select(*teams.columns)


def visible_domain_counts(domains: DataFrame, members: DataFrame, flags: DataFrame, viewers: DataFrame) -> DataFrame:
    """Per viewer the number of listable domains (factorized through team keys)."""
    # Grouped by a struct of the key, so that the join back has an exchange of its own and AQE can split a large team.
    per_team = domains.groupBy(F.struct("team_id").alias("k")).agg(F.count(F.lit(1)).alias("n")).select(F.col("k.team_id").alias("_team"), "n")
    scopes = visibility_scopes(viewers, members, flags)
    own = (
        scopes.filter(F.col("scope") == SCOPE_TEAM).join(per_team, F.col("team_id") == F.col("_team"))
        .groupBy("viewer").agg(F.sum("n").alias("n_own"))
    )
    glob = scopes.filter(F.col("scope") == SCOPE_ALL).select("viewer", F.lit(True).alias("is_global"))
    n_all = domains.select(F.count(F.lit(1))).scalar()
    return (
        viewers.select("viewer")
        .join(own, "viewer", "left")
        .join(glob, "viewer", "left")
        .select(
            "viewer",
            F.when(F.col("viewer").isNull(), F.lit(0))
            .when(F.col("is_global"), n_all)
            .otherwise(F.coalesce("n_own", F.lit(0))).cast("long").alias("n_domains"),
        )
    )


# ----------------------------------------------------------------- O-X8 ---


def access_decisions(pairs: DataFrame, assets: DataFrame, domains: DataFrame, members: DataFrame,
                     flags: DataFrame, viewer_col: str = "viewer", asset_col: str = "asset_id") -> DataFrame:
    """Decide (viewer, asset) pairs: 200 when visible, 404 when unknown *or* hidden.

    Equi-joins only: pair -> asset(+team) on asset id, -> grant on
    (viewer, team), -> flags on viewer.  One output row per input pair.
    """
    rows = assets_with_team(assets, domains).select(
        F.col("id").alias("_asset"), F.col("team_id").alias("_team"), F.col("published").alias("_published"))
    # Distinct by a struct of the pair: the join has an exchange of its own on both sides, and AQE can split a hot pair.
    grants = members.groupBy(F.struct("email", "team_id").alias("k")).agg(F.count(F.lit(1)).alias("_n")).select(
        F.col("k.email").alias("_member"), F.col("k.team_id").alias("_gteam"))
    gflags = flags.filter(F.col("is_global")).select(F.col("email").alias("_global"))
    joined = (
        pairs.join(rows, pairs[asset_col] == rows._asset, "left")
        .join(grants, (F.col(viewer_col) == grants._member) & (F.col("_team") == grants._gteam), "left")
        .join(gflags, F.col(viewer_col) == gflags._global, "left")
    )
    allowed = (
        F.col("_asset").isNotNull()
        & (F.coalesce(F.col("_published"), F.lit(False))
           | (F.col(viewer_col).isNotNull() & (F.col("_global").isNotNull() | F.col("_member").isNotNull())))
    )
    return joined.select(
        *pairs.columns,
        allowed.alias("allowed"),
        F.when(allowed, F.lit(200)).otherwise(F.lit(404)).alias("status"),
    )
