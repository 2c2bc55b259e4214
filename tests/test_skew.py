"""A hot team (most members and assets) and a hot asset (most changes):
results stay whole and equal a brute-force model."""

from __future__ import annotations

import random

from lakeward.operators import access, search
from lakeward.operators.changes import apply_changes
from tests.conftest import T0, change_frame, frames
from tests.test_access import _model


def skewed_rows(seed: int = 7):
    rnd = random.Random(seed)
    teams = [("TP", "Platform", "", True)] + [(f"T{i}", f"Team {i}", "", False) for i in range(1, 10)]
    users, members = [], []
    for u in range(400):
        email = f"u{u}@x"
        users.append((f"U{u}", email, u % 97 == 0, f"user {u}", "", T0))
        team = "T1" if u < 250 else f"T{2 + u % 8}"          # T1 holds most members
        members.append((f"m{u}", team, email, ["member", "manager", "owner"][u % 3]))
        if u % 50 == 1:
            members.append((f"p{u}", "TP", email, "member"))
    domains = [(f"D{i}", f"Domain {i}", "", "", f"T{i}", T0, T0) for i in range(1, 10)]
    assets = []
    for a in range(900):
        dom = "D1" if a < 600 else f"D{2 + a % 8}"            # T1 owns most assets
        assets.append((f"A{a}", dom, f"asset {rnd.randint(0, 300):03d}", "", "", "", "{}", "", "", None, "",
                       rnd.random() < 0.4, T0, T0, None))
    return {"teams": teams, "users": users, "team_members": members, "domains": domains, "assets": assets,
            "data_layers": [], "access_requests": []}


def test_hot_team_counts_and_pages(spark):
    rows = skewed_rows()
    t = frames(spark, rows)
    model = _model(rows)
    flags = access.effective_flags(t["users"], t["team_members"], t["teams"])
    viewers = access.viewers_of(t["users"])
    counts = {r.viewer: r.n_assets for r in access.visible_asset_counts(
        t["assets"], t["domains"], t["team_members"], flags, viewers).collect()}
    assert counts == {v: len(s) for v, s in model.items()}
    scopes = access.visibility_scopes(viewers, t["team_members"], flags)
    awt = access.assets_with_team(t["assets"], t["domains"])
    names = {a[0]: a[2] for a in rows["assets"]}
    got = {}
    for r in search.page_per_viewer(scopes, awt, 7).collect():
        got.setdefault(r.viewer, []).append((r.rank, r.asset_id))
    want = {v: [(i + 1, a) for i, a in enumerate(sorted(s, key=lambda x: (names[x], x))[:7])]
            for v, s in model.items() if s}
    assert {v: sorted(p) for v, p in got.items()} == want


def test_hot_asset_changes(spark):
    rows = skewed_rows()
    t = frames(spark, rows)
    rnd = random.Random(3)
    member_of = {m[2]: m[1] for m in rows["team_members"] if m[1] != "TP"}
    glob = {u[1] for u in rows["users"] if u[2]} | {m[2] for m in rows["team_members"] if m[1] == "TP"}
    changes, want_status, last = [], {}, None
    for seq in range(1, 601):
        actor = f"u{rnd.randrange(400)}@x"
        target = "A5" if seq % 3 else f"A{rnd.randrange(900)}"   # A5 (team T1) gets two thirds
        value = f"v{seq}"
        changes.append(dict(seq=seq, actor=actor, op="update_asset", target=target, fields={"freshness": value}))
        team = "T1" if int(target[1:]) < 600 else f"T{2 + int(target[1:]) % 8}"
        ok = actor in glob or member_of.get(actor) == team
        want_status[seq] = 200 if ok else 403
        if ok and target == "A5":
            last = value
    new, decisions = apply_changes(t, change_frame(spark, changes))
    assert {r.seq: r.status for r in decisions.collect()} == want_status
    assert {r.id: r.freshness for r in new["assets"].filter("id = 'A5'").collect()} == {"A5": last}
    assert new["assets"].count() == 900


SPLIT = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
         "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
         "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}


def final_plan(spark, df) -> str:
    """The plan as it ran, with partitions counted as skewed at a small size and nothing broadcast."""
    before = {k: spark.conf.get(k) for k in SPLIT}
    try:
        for k, v in SPLIT.items():
            spark.conf.set(k, v)
        df = df.select("*")
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_hot_keys_are_split(spark):
    rows = skewed_rows()
    rows["access_requests"] = [(f"R{k}", f"A{k % 3}" if k % 2 else f"A{k % 900}", "u3@x" if k % 3 else f"u{k % 400}@x", "pending", T0, None)
                               for k in range(6000)]
    t = frames(spark, rows)
    # Written, so that the scan has several files and AQE sees their shuffled sizes.
    from lakeward.session import materialize
    t = {name: materialize(df.repartition(4), f"skew-{name}") for name, df in t.items()}
    flags = access.effective_flags(t["users"], t["team_members"], t["teams"])
    pairs = t["access_requests"].select("id", t["access_requests"].requester_email.alias("viewer"), "asset_id")
    decided = access.access_decisions(pairs, t["assets"], t["domains"], t["team_members"], flags)
    assert "SortMergeJoin(skew=true)" in final_plan(spark, decided)
    viewers = access.viewers_of(t["users"])
    counts = access.visible_asset_counts(t["assets"], t["domains"], t["team_members"], flags, viewers)
    # The shared scopes come as scalars: no join key is met by all viewers.
    text = final_plan(spark, counts)
    assert "published" in text and "Cartesian" not in text and "NestedLoop" not in text


def test_a_hot_actor_of_changes_is_split(spark):
    t = frames(spark, skewed_rows())
    from lakeward.operators.changes import decided
    from lakeward.session import materialize
    log = [dict(seq=k, actor="u3@x" if k % 3 else f"u{k % 400}@x", op="update_asset", target=f"A{k % 900}", fields={"freshness": f"v{k}"}) for k in range(1, 6001)]
    changes = materialize(change_frame(spark, log).repartition(4), "skew-changes")
    assert "SortMergeJoin(skew=true)" in final_plan(spark, decided(t, changes, materialize=False))
