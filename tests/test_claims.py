"""Unique names inside a batch: random batches against a model that goes through them change by change."""

from __future__ import annotations

import random

import pytest

from lakeward.operators import changes
from lakeward.operators.changes import apply_changes
from tests.conftest import PLATFORM, T0, change_frame, frames, sample_rows

NAMES = ["Alpha", "Beta", "Gamma", "Delta", "Twice"]
EMAILS = [f"u{k}@example.com" for k in range(5)]
LAYERS = ["Raw", "raw", " Clean ", "clean", "Gold"]


def catalog_rows():
    rows = sample_rows()
    rows["domains"] = [(f"D{k}", n, "", "", "TM" if k % 2 else "TF", T0, T0) for k, n in enumerate(["Alpha", "Beta", "Gamma", "Twice", "Twice"])]
    rows["users"] += [(f"X{k}", e, False, "", "", T0) for k, e in enumerate(EMAILS[:3])]
    rows["team_members"] += [("x1", "TM", EMAILS[0], "member"), ("x2", "TF", EMAILS[1], "manager")]
    rows["data_layers"] = [("L0", "raw", "#0", 0, T0), ("L1", "Silver", "#1", 1, T0), ("L2", "clean", "#2", 2, T0)]
    return rows


def random_batch(rng, n):
    out = []
    for seq in rng.sample(range(1, 10 * n), n):
        op = rng.choice(["create_domain", "update_domain", "delete_domain", "delete_team", "register_user", "delete_user", "add_member",
                         "remove_member", "assign_user", "change_role", "create_layer", "update_layer", "delete_layer"] + ["update_domain", "update_layer"] * 3)
        target, fields = None, {}
        if op == "delete_team" and rng.random() < .6:
            op = "update_domain"
        if op == "create_domain":
            fields = {"name": rng.choice(NAMES), "team_id": rng.choice(["TM", "TF"])}
        elif op in ("update_domain", "delete_domain"):
            target = f"D{rng.randint(0, 4)}"
            fields = {"name": rng.choice(NAMES)} if op == "update_domain" else {}
        elif op == "delete_team":
            target = rng.choice(["TM", "TF"])
        elif op == "register_user":
            fields = {"email": rng.choice(EMAILS)}
        elif op == "delete_user":
            target = f"X{rng.randint(0, 2)}"
        elif op in ("add_member", "remove_member", "change_role"):
            target, fields = rng.choice(["TM", "TF"]), {"email": rng.choice(EMAILS[:3])}
            if op != "remove_member":
                fields["role"] = rng.choice(["member", "manager"])
        elif op == "assign_user":
            target, fields = f"X{rng.randint(0, 2)}", {"team_id": rng.choice(["TM", "TF"]), "role": rng.choice(["member", "manager"])}
        elif op == "create_layer":
            fields = {"name": rng.choice(LAYERS)}
        else:
            target = f"L{rng.randint(0, 2)}"
            fields = {"name": rng.choice(LAYERS + ["  "])} if op == "update_layer" else {}
        out.append(dict(seq=seq, actor=PLATFORM, op=op, target=target, fields=fields))
    return out


class Model:
    """One change after another: names as they are then, everything else as at batch start."""

    def __init__(self, rows):
        self.rows = rows
        self.held = {}
        for kind, table, key in (("domain", "domains", lambda r: r[1]), ("layer", "data_layers", lambda r: r[1].lower()),
                                 ("user", "users", lambda r: r[1])):
            for r in rows[table]:
                self.held.setdefault((kind, key(r)), []).append(r[0])
        # A name that several rows hold stays taken.
        self.stuck = {k for k, v in self.held.items() if len(v) > 1}
        self.pairs = {(r[1], r[2]): (r[0], r[3]) for r in rows["team_members"]}
        self.stood = set(self.pairs)
        self.at = {}
        for (kind, name), ids in self.held.items():
            for i in ids:
                self.at[kind, i] = name
        self.gone = set()
        self.team = {r[0]: r[4] for r in rows["domains"]}
        self.dead_teams, self.dead_emails, self.made = set(), set(), {}

    def leave(self, kind, i):
        name = self.at.pop((kind, i), None)
        if name is not None and (kind, name) not in self.stuck:
            self.held[kind, name].remove(i)

    def claim(self, kind, name, i, new):
        others = [h for h in self.held.get((kind, name), []) if new or h != i]
        if others:
            return False
        if new or (kind, i) not in self.gone:
            self.leave(kind, i)
            self.held.setdefault((kind, name), []).append(i)
            self.at[kind, i] = name
        return True

    def step(self, c):
        op, target, fields, seq = c["op"], c["target"], c["fields"], c["seq"]
        if op == "create_domain":
            self.team[f"domain-{seq}"] = fields["team_id"]
            if not self.claim("domain", fields["name"], f"domain-{seq}", True):
                return 409
            return 201
        if op == "update_domain":
            return 200 if self.claim("domain", fields["name"], target, False) else 409
        if op in ("delete_domain", "delete_layer"):
            kind = op.split("_")[1]
            self.leave(kind, target)
            self.gone.add((kind, target))
            return 204
        if op == "delete_team":
            for (kind, i) in list(self.at):
                if kind == "domain" and self.team[i] == target:
                    self.leave(kind, i)
                    self.gone.add((kind, i))
            for r in self.rows["domains"]:
                if r[4] == target:
                    self.gone.add(("domain", r[0]))
            self.dead_teams.add(target)
            return 204
        if op == "register_user":
            return 201 if self.claim("user", fields["email"], f"user-{seq}", True) else 400
        if op == "delete_user":
            self.leave("user", target)
            self.dead_emails.add(next(r[1] for r in self.rows["users"] if r[0] == target))
            return 204
        if op == "create_layer":
            return 201 if self.claim("layer", fields["name"].strip().lower(), f"layer-{seq}", True) else 409
        if op == "update_layer":
            name = fields["name"].strip().lower()
            if not name:
                return 409 if self.held.get(("layer", "")) else 400
            return 200 if self.claim("layer", name, target, False) else 409
        email = fields.get("email") or next(r[1] for r in self.rows["users"] if r[0] == target)
        pair = (fields.get("team_id") or target, email)
        if op == "add_member":
            if pair in self.pairs:
                return 400
            self.pairs[pair] = (f"member-{seq}", fields["role"])
            return 201
        if op == "assign_user":
            self.pairs[pair] = (self.pairs[pair][0] if pair in self.pairs else f"member-{seq}", fields["role"])
            return 201
        if op == "change_role":
            if pair not in self.stood:
                return 404
            if pair in self.pairs:
                self.pairs[pair] = (self.pairs[pair][0], fields["role"])
            return 200
        self.pairs.pop(pair, None)
        return 204


@pytest.mark.parametrize("seed", range(6))
def test_claims_equal_the_model(spark, seed):
    rng = random.Random(seed)
    rows = catalog_rows()
    batch = random_batch(rng, 60)
    new, decisions = apply_changes(frames(spark, rows), change_frame(spark, batch))
    got = {r.seq: r.status for r in decisions.collect()}
    model = Model(rows)
    want = {c["seq"]: model.step(c) for c in sorted(batch, key=lambda c: c["seq"])}
    assert got == want
    dead = model.dead_teams
    names = {i: n for (kind, i), n in model.at.items() if kind == "domain" and model.team[i] not in dead}
    assert {r.id: r.name for r in new["domains"].collect()} == names
    assert sorted(r.email for r in new["users"].collect()) == sorted(n for (kind, _), n in model.at.items() if kind == "user")
    assert {r.id: r.name.lower() for r in new["data_layers"].collect()} == {i: n for (kind, i), n in model.at.items() if kind == "layer"}
    pairs = {p: role for p, (_, role) in model.pairs.items() if p[0] not in dead and p[1] not in model.dead_emails}
    members = new["team_members"].collect()
    assert {(r.team_id, r.email): r.role for r in members} == pairs and len(members) == len(pairs)


def test_a_contested_name_takes_few_rounds(spark, monkeypatch):
    batch = [dict(seq=k, actor=PLATFORM, op="create_domain", fields={"name": "Hot", "team_id": "TM"}) for k in range(1, 200)]
    batch += [dict(seq=1000 + k, actor=PLATFORM, op="update_domain", target="D1", fields={"name": f"N{k}"}) for k in range(5)]
    batch += [dict(seq=2000, actor=PLATFORM, op="create_domain", fields={"name": "Customer Analytics", "team_id": "TM"}),
              dict(seq=900, actor=PLATFORM, op="create_domain", fields={"name": "Customer Analytics", "team_id": "TM"})]
    written = []
    real = changes.write_and_read
    monkeypatch.setattr(changes, "write_and_read", lambda df, label: written.append(label) or real(df, label))
    _, decisions = apply_changes(frames(spark, sample_rows()), change_frame(spark, batch))
    status = {r.seq: r.status for r in decisions.collect()}
    assert [k for k, v in status.items() if v == 201] == [1, 2000] or sorted(k for k, v in status.items() if v == 201) == [1, 2000]
    assert status[900] == 409 and all(status[1000 + k] == 200 for k in range(5)) and written.count("claims-open") <= 4
