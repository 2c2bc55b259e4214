"""Projections, filters, search and ordered listings (§2.2, §2.6).

Orderings are total: the catalog orders by name only, so ``id`` is added as
a tie-break, and NULLs sort last as in the catalog's store.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeward.functions import vocab
from lakeward.functions.columns import contains_pattern
from lakeward.sources import schemas

ASSET_COLUMNS = schemas.ASSETS.fieldNames()


def asc(*names: str) -> list[Column]:
    return [F.col(n).asc_nulls_last() for n in names]


# ----------------------------------------------------------------- O-P1 ---


def asset_view(assets_with_team: DataFrame, detail: bool = False) -> DataFrame:
    """The 15 asset columns + ``domain_name`` (+ ``team_id`` in the detail view)."""
    extra = ["domain_name", "team_id"] if detail else ["domain_name"]
    return assets_with_team.select(*ASSET_COLUMNS, *extra)


# ----------------------------------------------------------------- O-P2 ---


def filter_assets(df: DataFrame, domain_id: str | None = None, source_type: str | None = None,
                  layer_id: str | None = None) -> DataFrame:
    """AND of the given equalities; None or '' adds no condition."""
    conds = [F.col(c) == v for c, v in
             (("domain_id", domain_id), ("source_type", source_type), ("layer_id", layer_id)) if v]
    return df.filter(reduce(lambda a, b: a & b, conds)) if conds else df


# ----------------------------------------------------------------- O-P3 ---


def search_assets(df: DataFrame, q: str | None) -> DataFrame:
    """Case-insensitive contains on name OR description; None or '' = no filter."""
    if not q:
        return df
    p = contains_pattern(q)
    return df.filter(F.col("name").ilike(p) | F.col("description").ilike(p))


# ----------------------------------------------------------------- O-P4 ---


def search_users(users: DataFrame, q: str = "", n: int = vocab.USER_SEARCH_LIMIT) -> DataFrame:
    """``id, email`` of accounts whose e-mail contains ``q``; first ``n`` by e-mail."""
    return (
        users.filter(F.col("email").ilike(contains_pattern(q or "")))
        .select("id", "email")
        .orderBy(*asc("email", "id"))
        .limit(n)
    )


# ----------------------------------------------------------------- O-P5 ---


def lookup(df: DataFrame, key: str, ids: str | list[str] | DataFrame) -> DataFrame:
    """Rows whose ``key`` is one id, a list of ids, or the ids of a frame."""
    if isinstance(ids, str):
        return df.filter(F.col(key) == ids)
    if isinstance(ids, DataFrame):
        wanted = ids.select(F.col(ids.columns[0]).alias(key)).distinct()
        return df.join(wanted, key, "left_semi")
    return df.filter(F.col(key).isin(list(ids)))


# ------------------------------------------------------------ O-P6..P9 ---


def published_only(assets: DataFrame) -> DataFrame:
    return assets.filter(F.col("published"))


def members_in_role(members: DataFrame, roles: tuple[str, ...] = vocab.MANAGER_ROLES) -> DataFrame:
    return members.filter(F.col("role").isin(*roles))


def team_members_of(members: DataFrame, team_id: str) -> DataFrame:
    """``id, team_id, email, role`` of one team, by e-mail."""
    return (
        members.filter(F.col("team_id") == team_id)
        .select("id", "team_id", "email", "role")
        .orderBy(*asc("email", "id"))
    )


def user_view(users: DataFrame) -> DataFrame:
    """Account rows without credentials; NULL name/avatar read as ''."""
    return users.select(
        "id", "email",
        F.coalesce(F.col("is_superadmin"), F.lit(False)).alias("is_superadmin"),
        F.coalesce(F.col("name"), F.lit("")).alias("name"),
        F.coalesce(F.col("avatar"), F.lit("")).alias("avatar"),
        "created_at",
    )


# ----------------------------------------------------------- O-T1..T4 ---


def page_assets(df: DataFrame, limit: int = vocab.PAGE_DEFAULT, offset: int = 0) -> DataFrame:
    """One page by name (then id): limit 1..1000, offset >= 0."""
    if not 1 <= limit <= vocab.PAGE_MAX:
        raise ValueError(f"limit must be within 1..{vocab.PAGE_MAX}")
    if offset < 0:
        raise ValueError("offset must be >= 0")
    ordered = df.orderBy(*asc("name", "id"))
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def first_assets(df: DataFrame, n: int = vocab.RECENT_ASSETS) -> DataFrame:
    """The first ``n`` by name: the home page's "recent" list."""
    return df.orderBy(*asc("name", "id")).limit(n)


def ordered_layers(layers: DataFrame) -> DataFrame:
    return layers.select("id", "name", "color", "position").orderBy(*asc("position", "name", "id"))


def ordered_teams(visible_teams: DataFrame) -> DataFrame:
    return visible_teams.select("id", "name", "description", "is_platform").orderBy(*asc("name", "id"))


# ----------------------------------------------------------------- O-T5 ---


def page_per_viewer(scopes: DataFrame, assets_with_team: DataFrame, n: int = vocab.PAGE_DEFAULT) -> DataFrame:
    """First ``n`` visible assets by name for many viewers at once.

    Works on the factorized visibility (``access.visibility_scopes``).  Each
    scope's first ``n`` assets are one sorted array: those of the published
    set and of all drafts come as scalars, so no key is shared by all
    viewers; those of a team's drafts are joined to its members' scopes.
    A viewer merges its arrays, keeps ``n`` and only then becomes rows:
    nothing pairs a viewer with the whole catalog, and no window runs over
    viewers.
    """
    rows = assets_with_team.select("id", "name", "published", "team_id")
    order = [F.col("name").asc_nulls_last(), F.col("id").asc_nulls_last()]
    # Sorts as the order does: NULLs last.
    item = F.struct(F.col("name").isNull().alias("no_name"), "name", F.col("id").isNull().alias("no_id"), "id")
    draft = ~F.coalesce(F.col("published"), F.lit(False))

    def first(df: DataFrame) -> Column:
        # Per-partition top n, then one merge of the survivors.
        return df.orderBy(*order).limit(n).agg(F.array_sort(F.collect_list(item)).alias("top")).scalar()

    # Top n per team: the rank filter lets Spark cut each team to n rows
    # per input partition before the shuffle, so a hot team stays small.
    w = Window.partitionBy("team_id").orderBy(*order)
    team_top = (rows.filter(draft).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n)
                .groupBy(F.struct("team_id").alias("k")).agg(F.array_sort(F.collect_list(item)).alias("top"))
                .select(F.col("k.team_id").alias("_team"), "top"))
    team = (scopes.filter(F.col("scope") == "team").join(team_top, F.col("team_id") == F.col("_team"))
            .select("viewer", "top"))
    others = scopes.filter(F.col("scope") != "team").select(
        "viewer", F.when(F.col("scope") == "all", first(rows.filter(draft))).otherwise(first(rows.filter(~draft))).alias("top"))
    merged = (others.unionByName(team).groupBy("viewer")
              .agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, n).alias("top")))
    return (merged.select("viewer", F.posexplode("top").alias("at", "a"))
            .select("viewer", F.col("a.id").alias("asset_id"), F.col("a.name").alias("name"), (F.col("at") + 1).cast("int").alias("rank")))
