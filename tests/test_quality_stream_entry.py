"""Integrity jobs and the driver contract."""

from __future__ import annotations

import os

from lakeward.operators import quality
from tests.conftest import GHOST, LONER, T0, frames, sample_rows

SF_SMALL = "/root/testdata/sf0.001"


def test_dangling_and_duplicates(spark):
    rows = sample_rows()
    rows["assets"].append(("A9", "DX", "Orphan", "", "", "", "{}", "", "", None, "", True, T0, T0, "LX"))
    rows["access_requests"].append(("R9", "AX", LONER, "pending", T0, None))
    rows["domains"].append(("D9", "Revenue", "", "", "TX", T0, T0))
    rows["data_layers"].append(("L9", "GOLD", "#000", 9, T0))
    rows["team_members"].append(("m9", "TM", "marketing-analyst@example.com", "member"))
    t = frames(spark, rows)
    dangling = sorted((r.relation, r.child_id, r.ref_value) for r in quality.dangling_references(t).collect())
    assert dangling == [
        ("access_requests.asset_id", "R9", "AX"),
        ("assets.domain_id", "A9", "DX"),
        ("assets.layer_id", "A9", "LX"),
        ("domains.team_id", "D9", "TX"),
        ("team_members.email", "m6", GHOST),
    ]
    dupes = sorted((r.table_name, r.key_name, r.key_value, r.n_rows) for r in quality.duplicate_keys(t).collect())
    assert dupes == [
        ("data_layers", "lower(name)", "gold", 2),
        ("domains", "name", "Revenue", 2),
        ("team_members", "team_id,email", "TM|marketing-analyst@example.com", 2),
    ]


def test_unknown_types(spark):
    rows = sample_rows()
    rows["assets"] = [
        ("A1", "D1", "a", "", "snowflake", "", '[{"name":"x","type":"INT"},{"name":"y","type":"INTEGER"}]', "", "",
         None, "", True, T0, T0, None),
        ("A2", "D1", "b", "", "s3", "", '{"p":"INT64","q":"STRING"}', "", "", None, "", True, T0, T0, None),
        ("A3", "D1", "c", "", "mysql", "", '{"r":"TEXT","s":"integer"}', "", "", None, "", True, T0, T0, None),
    ]
    t = frames(spark, rows)
    got = sorted((r.asset_id, r.name, r.type) for r in quality.unknown_types(t["assets"]).collect())
    assert got == [("A1", "x", "INT"), ("A2", "p", "INT64"), ("A3", "s", "integer")]


def test_entry_contract(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() >= 0 and df.columns[0] == "id"
    qs, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 55


def test_small_oracle_sample(spark):
    """A few registered queries against DuckDB on the smallest driver folder."""
    import duckdb

    import __spark_entry__ as entry

    if not os.path.isdir(SF_SMALL):
        return
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_SMALL}/{name}.parquet')")
    qs, sqls = entry.queries(), entry.oracle_sql()
    for name in ("visible_asset_counts", "page_per_viewer", "layer_counts", "update_asset", "changed_assets"):
        got = sorted(tuple(str(v) for v in r) for r in qs[name](spark, SF_SMALL).toPandas()
                     .sort_index(axis=1).itertuples(index=False))
        want = sorted(tuple(str(v) for v in r) for r in con.execute(sqls[name]).df()
                      .sort_index(axis=1).itertuples(index=False))
        assert got == want, name
