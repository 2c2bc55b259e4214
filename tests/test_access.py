"""Access control (§2.9) on the sample catalog, and the factorized batch
operators against a brute-force Python model."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeward.operators import access, rollups, search
from tests.conftest import ADMIN, F_LEAD, GHOST, LONER, M_ANALYST, M_LEAD, PLATFORM, sample_rows


def _flags(t):
    return access.effective_flags(t["users"], t["team_members"], t["teams"])


def _visible_ids(t, viewer):
    return sorted(r.id for r in access.visible_assets(t["assets"], t["domains"], t["team_members"], _flags(t),
                                                      viewer).collect())


def test_sample_visibility_counts(sample):
    # anonymous -> 2, finance lead -> 2, marketing analyst -> 3, global -> 3
    assert _visible_ids(sample, None) == ["A1", "A3"]
    assert _visible_ids(sample, F_LEAD) == ["A1", "A3"]
    assert _visible_ids(sample, M_ANALYST) == ["A1", "A2", "A3"]
    assert _visible_ids(sample, ADMIN) == ["A1", "A2", "A3"]
    assert _visible_ids(sample, PLATFORM) == ["A1", "A2", "A3"]
    assert _visible_ids(sample, LONER) == ["A1", "A3"]
    assert _visible_ids(sample, "nobody@example.com") == ["A1", "A3"]


def test_effective_flags(sample):
    rows = {r.email: (r.is_superadmin, r.is_platform, r.is_global) for r in _flags(sample).collect()}
    assert rows[ADMIN] == (True, False, True)
    assert rows[PLATFORM] == (False, True, True)
    assert rows[M_LEAD] == (False, False, False)
    assert GHOST not in rows or rows[GHOST] == (False, False, False)


def test_team_grants(sample):
    g = {(r.email, r.team_id): (r.is_member, r.is_manager, r.is_owner)
         for r in access.team_grants(sample["team_members"]).collect()}
    assert g[(M_LEAD, "TM")] == (True, True, True)
    assert g[("marketing-mgr@example.com", "TM")] == (True, True, False)
    assert g[(M_ANALYST, "TM")] == (True, False, False)


def test_visible_domains_and_teams(sample):
    flags = _flags(sample)
    doms = lambda v: sorted(r.id for r in access.visible_domains(
        sample["domains"], sample["team_members"], flags, v).collect())
    teams = lambda v: sorted(r.id for r in access.visible_teams(
        sample["teams"], sample["team_members"], flags, v).collect())
    assert doms(None) == [] and doms(ADMIN) == ["D1", "D2"] and doms(M_ANALYST) == ["D1"] and doms(LONER) == []
    assert teams(ADMIN) == ["TF", "TM"] and teams(M_LEAD) == ["TM"] and teams(PLATFORM) == ["TF", "TM"]


def _model(rows):
    """Plain-Python visibility: viewer -> set of visible asset ids."""
    users = rows["users"]
    members = rows["team_members"]
    platform = {t[0] for t in rows["teams"] if t[3]}
    dom_team = {d[0]: d[4] for d in rows["domains"]}
    emails = sorted({u[1] for u in users})
    glob = {u[1] for u in users if u[2]} | {m[2] for m in members if m[1] in platform}
    out = {}
    for v in emails + [None]:
        teams = {m[1] for m in members if m[2] == v}
        seen = set()
        for a in rows["assets"]:
            if a[1] not in dom_team:
                continue
            if a[11] or (v is not None and (v in glob or dom_team[a[1]] in teams)):
                seen.add(a[0])
        out[v] = seen
    return out


def test_counts_and_pages_match_brute_force(spark, sample):
    rows = sample_rows()
    model = _model(rows)
    flags = _flags(sample)
    viewers = access.viewers_of(sample["users"])
    counts = {r.viewer: r.n_assets for r in access.visible_asset_counts(
        sample["assets"], sample["domains"], sample["team_members"], flags, viewers).collect()}
    assert counts == {v: len(s) for v, s in model.items()}

    scopes = access.visibility_scopes(viewers, sample["team_members"], flags)
    awt = access.assets_with_team(sample["assets"], sample["domains"])
    names = {a[0]: a[2] for a in rows["assets"]}
    for n in (1, 2, 5):
        got = {}
        for r in search.page_per_viewer(scopes, awt, n).collect():
            got.setdefault(r.viewer, []).append((r.rank, r.asset_id))
        want = {v: [(i + 1, a) for i, a in enumerate(sorted(s, key=lambda x: (names[x], x))[:n])]
                for v, s in model.items() if s}
        assert {v: sorted(p) for v, p in got.items()} == want


def test_access_decisions(spark, sample):
    pairs = spark.createDataFrame(
        [(None, "A2"), (M_ANALYST, "A2"), (F_LEAD, "A2"), (ADMIN, "A2"), (LONER, "A1"), (LONER, "AX")],
        "viewer string, asset_id string")
    out = access.access_decisions(pairs, sample["assets"], sample["domains"], sample["team_members"], _flags(sample))
    got = [(r.viewer, r.asset_id, r.status) for r in out.orderBy(F.col("viewer").asc_nulls_first(), "asset_id")
           .collect()]
    assert got == [(None, "A2", 404), (ADMIN, "A2", 200), (F_LEAD, "A2", 404), (LONER, "A1", 200),
                   (LONER, "AX", 404), (M_ANALYST, "A2", 200)]


def test_rollups(spark, sample):
    flags = _flags(sample)
    va = access.visible_assets(sample["assets"], sample["domains"], sample["team_members"], flags, M_ANALYST)
    vd = access.visible_domains(sample["domains"], sample["team_members"], flags, M_ANALYST)
    s = rollups.dashboard_stats(va, vd).first()
    assert (s.n_domains, s.n_assets, s.n_source_types) == (1, 3, 2)
    lc = [(r.layer_id, r.n_assets) for r in rollups.layer_counts(sample["data_layers"], sample["assets"]).collect()]
    assert lc == [("L0", 0), ("L1", 1), ("L2", 1), ("L3", 0)]
    assert rollups.next_position(sample["data_layers"]).first()[0] == 4
    fu = rollups.first_user(sample["users"]).first()
    assert (fu.first_user_id, fu.has_superadmin, fu.promote) == ("U0", True, False)
    assert [r[0] for r in rollups.source_types(sample["assets"]).collect()] == ["bigquery", "snowflake"]
    widths = {r.asset_id: r.n_columns for r in rollups.schema_width(sample["assets"]).collect()}
    assert widths == {"A1": 1, "A2": 0, "A3": 0}


def test_page_assets_bounds(spark, sample):
    import pytest

    with pytest.raises(ValueError):
        search.page_assets(sample["assets"], limit=0)
    with pytest.raises(ValueError):
        search.page_assets(sample["assets"], limit=1001)
    page = [r.id for r in search.page_assets(sample["assets"], limit=2, offset=1).collect()]
    assert page == ["A2", "A3"]  # by name: Customer.., Raw.., Revenue..


def test_users_with_teams_flat_and_nested(spark, sample):
    from lakeward.operators import joins

    flat = joins.users_with_teams(sample["users"], sample["team_members"], sample["teams"])
    rows = {(r.email, r.team_id) for r in flat.collect()}
    assert (M_LEAD, "TM") in rows and (LONER, None) in rows
    assert all(t != "TP" for _, t in rows)          # platform team hidden
    nested = {r.email: [(t.team_name, t.role) for t in r.teams]
              for r in joins.users_with_team_lists(flat).collect()}
    assert nested[LONER] == [] and nested[M_LEAD] == [("Marketing", "owner")]


def test_batch_visibility_expands_to_each_viewers_assets(spark, sample):
    flags = access.effective_flags(sample["users"], sample["team_members"], sample["teams"])
    viewers = access.viewers_of(sample["users"])
    scopes, scoped = access.visible_assets_batch(sample["assets"], sample["domains"], sample["team_members"], flags, viewers)
    pairs = {}
    for r in access.expand(scopes, scoped).collect():
        pairs.setdefault(r.viewer, set()).add(r.asset_id)
    for viewer in [r.viewer for r in viewers.collect()]:
        one = access.visible_assets(sample["assets"], sample["domains"], sample["team_members"], flags, viewer)
        assert pairs[viewer] == {r.id for r in one.collect()}, viewer
    assert scoped.count() == sample["assets"].count()
