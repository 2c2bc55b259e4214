"""Shared fixtures: one local session and a small sample catalog."""

from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lakeward.session import get_session  # noqa: E402
from lakeward.sources import schemas  # noqa: E402

T0 = dt.datetime(2024, 1, 1)

ADMIN = "admin@example.com"            # superadmin
PLATFORM = "platform@example.com"      # member of the platform team
M_LEAD = "marketing-lead@example.com"  # owner of Marketing
M_MGR = "marketing-mgr@example.com"    # manager of Marketing
M_ANALYST = "marketing-analyst@example.com"  # member of Marketing
F_LEAD = "finance-lead@example.com"    # owner of Finance
LONER = "loner@example.com"            # account, no team
GHOST = "ghost@example.com"            # member without an account


@pytest.fixture(scope="session")
def spark():
    return get_session(cores=4, shuffle_partitions=4)


def sample_rows() -> dict[str, list[tuple]]:
    return {
        "teams": [
            ("TP", "Platform", "Data Platform Team with global access", True),
            ("TM", "Marketing", "Marketing team", False),
            ("TF", "Finance", "Finance team", False),
        ],
        "team_members": [
            ("m1", "TP", PLATFORM, "member"),
            ("m2", "TM", M_LEAD, "owner"),
            ("m3", "TM", M_MGR, "manager"),
            ("m4", "TM", M_ANALYST, "member"),
            ("m5", "TF", F_LEAD, "owner"),
            ("m6", "TF", GHOST, "member"),
        ],
        "domains": [
            ("D1", "Customer Analytics", "", "", "TM", T0, T0),
            ("D2", "Revenue", "", "", "TF", T0, T0),
        ],
        "assets": [
            ("A1", "D1", "Customer Segments", "segments of customers", "bigquery", "", '{"customer_id":"INT"}', "",
             "customer,segments,audience", 0.95, "daily", True, T0, T0, "L1"),
            ("A2", "D1", "Raw Events (Internal)", "raw click events", "bigquery", "", "{}", "", "", 0.80,
             "real-time", False, T0, T0, None),
            ("A3", "D2", "Revenue Transactions", "all revenue", "snowflake", "", "[]", "", "finance", 0.98,
             "hourly", True, T0, T0, "L2"),
        ],
        "data_layers": [
            ("L0", "landing", "#64748B", 0, T0), ("L1", "bronze", "#B45309", 1, T0),
            ("L2", "silver", "#9CA3AF", 2, T0), ("L3", "gold", "#D97706", 3, T0),
        ],
        "access_requests": [
            ("R1", "A1", LONER, "pending", T0, None),
            ("R2", "A2", LONER, "pending", T0, None),
            ("R3", "A3", M_ANALYST, "approved", T0, T0),
        ],
        "users": [
            ("U0", ADMIN, True, "Admin", "", T0),
            ("U1", PLATFORM, False, "Plat", "", T0 + dt.timedelta(minutes=1)),
            ("U2", M_LEAD, False, "Lead", "", T0 + dt.timedelta(minutes=2)),
            ("U3", M_MGR, False, "Mgr", "", T0 + dt.timedelta(minutes=3)),
            ("U4", M_ANALYST, False, "Analyst", "", T0 + dt.timedelta(minutes=4)),
            ("U5", F_LEAD, False, "Fin", "", T0 + dt.timedelta(minutes=5)),
            ("U6", LONER, False, None, None, T0 + dt.timedelta(minutes=6)),
        ],
    }


def frames(spark, rows: dict[str, list[tuple]]):
    return {name: spark.createDataFrame(rows.get(name, []), schemas.CATALOG_SCHEMAS[name])
            for name in schemas.CATALOG_SCHEMAS}


@pytest.fixture(scope="session")
def sample(spark):
    return frames(spark, sample_rows())


def change_frame(spark, rows: list[dict]):
    """Change records from dicts: seq, actor, op, target, fields; event_at = T0 + seq seconds."""
    data = [(r["seq"], T0 + dt.timedelta(seconds=r["seq"]), r.get("actor"), r["op"], r.get("target"),
             r.get("fields", {})) for r in rows]
    return spark.createDataFrame(data, schemas.CHANGES)
