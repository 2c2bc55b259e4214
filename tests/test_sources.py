"""Sources: typed tables, schema upgrades, snapshots, seeding, harvesting, YAML files."""

from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import functions as F

from lakeward.sources import schemas, store
from lakeward.sources.catalog import add_missing_columns, catalog_tables, conform, upgrade_union
from lakeward.sources.harvest import harvest_columns, read_dataset, yaml_columns
from tests.conftest import frames, sample_rows


def test_add_missing_columns_defaults(spark):
    old = spark.createDataFrame([("U9", "old@x", None)], "id string, email string, created_at timestamp_ntz")
    new = spark.createDataFrame([("U8", "new@x", None, None, None, None)], schemas.USERS)
    both = upgrade_union(old, new, schemas.USERS, {"is_superadmin": False, "name": "", "avatar": ""})
    rows = {r.id: r for r in both.collect()}
    assert (rows["U9"].is_superadmin, rows["U9"].name, rows["U9"].avatar) == (False, "", "")
    assert rows["U8"].name is None  # an explicit NULL in new data stays NULL
    assert both.schema == schemas.USERS


def test_conform_try_casts(spark):
    df = spark.createDataFrame([("L1", "gold", "#fff", "x")], "id string, name string, color string, position string")
    out = conform(df, schemas.DATA_LAYERS).first()
    assert out.position is None and out.created_at is None


def test_snapshot_roundtrip_and_refusal(spark, sample):
    root = tempfile.mkdtemp(prefix="lakeward-store-")
    assert store.latest_version(spark, root) is None
    store.write_snapshot(sample, root, 0)
    store.write_snapshot(sample, root, 3)
    assert store.latest_version(spark, root) == 3
    with pytest.raises(FileExistsError):
        store.write_snapshot(sample, root, 3)
    back = store.read_snapshot(spark, root)
    assert back["assets"].count() == 3 and back["users"].schema == schemas.USERS
    tables = catalog_tables(spark, f"{root}/v=0")
    assert tables["teams"].count() == 3


def test_seed_defaults(spark, sample):
    empty = frames(spark, {})
    layers, teams = store.seed_defaults(empty["data_layers"], empty["teams"])
    assert sorted((r.name, r.position) for r in layers.collect()) == [
        ("bronze", 1), ("gold", 3), ("landing", 0), ("silver", 2)]
    assert [(r.name, r.is_platform) for r in teams.collect()] == [("Platform", True)]
    layers2, teams2 = store.seed_defaults(sample["data_layers"], sample["teams"])
    assert layers2.count() == 4 and teams2.count() == 3   # nothing added when present


def test_harvest_observes_nulls(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, "b", 3.0)], "a bigint, b string, c double")
    rows = [(r.col_pos, r.name, r.type, r.nullable) for r in harvest_columns(df, "t").orderBy("col_pos").collect()]
    assert rows == [(1, "a", "BIGINT", False), (2, "b", "STRING", True), (3, "c", "DOUBLE", False)]


def test_harvest_formats(spark):
    root = tempfile.mkdtemp(prefix="lakeward-harvest-")
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, v string")
    df.write.csv(f"{root}/csv", header=True)
    df.write.json(f"{root}/json")
    df.write.orc(f"{root}/orc")
    for fmt in ("csv", "json", "orc"):
        out = {r.name: r.nullable for r in harvest_columns(read_dataset(spark, f"{root}/{fmt}", fmt), fmt).collect()}
        assert out == {"id": False, "v": True}, fmt
    with pytest.raises(ValueError):
        read_dataset(spark, root, "avro")


YAML_SIMPLE = """# comment
user_id: INTEGER
email: "VARCHAR"
created.at: TIMESTAMP
columns_x: STRING

not a column
"""

YAML_LIST = """columns:
  - name: user_id
    type: INTEGER
    nullable: false
    description: Primary key
  - name: 'email'
    type: VARCHAR
  - name:
    type: ORPHAN
  - name: flag
    nullable: FALSE
    type: BOOL
    type: BOOLEAN
"""


def test_yaml_columns(spark):
    files = spark.createDataFrame([("s", YAML_SIMPLE), ("l", YAML_LIST), ("e", ""), ("n", "  - name: x\n")],
                                  "file_id string, text string")
    rows = [(r.file_id, r.col_pos, r.name, r.type, r.nullable, r.description)
            for r in yaml_columns(files).orderBy("file_id", "col_pos").collect()]
    assert rows == [
        ("l", 1, "user_id", "INTEGER", False, "Primary key"),
        ("l", 2, "email", "VARCHAR", True, ""),
        ("l", 3, "flag", "BOOLEAN", True, ""),
        ("s", 1, "user_id", "INTEGER", True, ""),
        ("s", 2, "email", "VARCHAR", True, ""),
        ("s", 3, "created.at", "TIMESTAMP", True, ""),
        ("s", 4, "columns_x", "STRING", True, ""),
    ]


def test_yaml_columns_of_odd_files(spark):
    from lakeward.sources.harvest import yaml_columns

    files = spark.createDataFrame([(1, "columns:\r\n  - Name: a\r\n    type: INT\r\n  - name: b\r\n    type: STRING\r\n"),
                                   (2, "\tuser_id: INT\n\tname: STRING\n")], "file_id int, text string")
    got = sorted((r.file_id, r.name, r.type) for r in yaml_columns(files).collect())
    assert got == [(1, "a", "INT"), (1, "b", "STRING"), (2, "name", "STRING"), (2, "user_id", "INT")]


def test_schema_text_after_white_space(spark):
    from lakeward.functions.columns import parse_columns

    df = spark.createDataFrame([('\n\t {"a": "INT"}',)], "schema_json string")
    assert [c.name for c in df.select(parse_columns("schema_json").alias("c")).first().c] == ["a"]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_yaml_files_are_read_in_their_own_rows(spark):
    from lakeward.sources.harvest import yaml_columns

    files = spark.createDataFrame([("a", "columns:\r\n  - name: x\r\n    type: INT\r\n    nullable: false\r\n  - name: \"\"\r\n  - name: y\r\n    description: 'd: e'"),
                                   ("b", "# c\nid: 'INT'\n\nbad line\n columns : x\n"), ("c", "columns : none\n"), ("d", None), ("e", ""),
                                   ("f", "id: INT\nColumns:\n  - name: z\n    type: A\n    type: B\n    other: 1")], "file_id string, text string")
    out = yaml_columns(files)
    assert "Exchange" not in plan_of(out) and "Window" not in plan_of(out)
    got = sorted((r.file_id, r.col_pos, r.name, r.type, r.nullable, r.description) for r in out.collect())
    assert got == [("a", 1, "x", "INT", False, ""), ("a", 2, "y", "", True, "d: e"), ("f", 1, "z", "B", True, "")]


def test_harvest_reads_footers_not_data(spark, tmp_path):
    from lakeward.sources.harvest import harvest_many, harvest_parquet

    rows = [(k, None if k == 3 else "x" * 200 + str(k), [float(k)] if k else None, (k, None)) for k in range(5000)]
    spark.createDataFrame(rows, "a long, b string, c array<double>, d struct<x:long,y:string>").repartition(3).write.parquet(f"{tmp_path}/t")
    out = harvest_parquet(spark, {"t": f"{tmp_path}/t"})
    text = plan_of(out)
    assert "PushedAggregation: [COUNT(*), COUNT(a), COUNT(b)]" in text
    # Only the nested columns are read, by the other reader.
    assert "ReadSchema: struct<c:array<double>,d:struct<" in text and "b:string" not in text.split("FileScan")[1].split("ReadSchema")[1].split("\n")[0]
    key = lambda r: (r.dataset, r.col_pos, r.name, r.type, r.spark_type, r.nullable)
    assert sorted(map(key, out.collect())) == sorted(map(key, harvest_many({"t": spark.read.parquet(f"{tmp_path}/t")}).collect()))
    assert {r.name: r.nullable for r in out.collect()} == {"a": False, "b": True, "c": True, "d": False}
    empty = harvest_parquet(spark, {"e": _empty(spark, f"{tmp_path}/e")})
    assert [r.nullable for r in empty.collect()] == [False, False]


def _empty(spark, path):
    spark.createDataFrame([], "a long, b array<int>").write.parquet(path)
    return path


def test_versions_of_other_layouts_are_one_scan(spark, tmp_path):
    from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

    root = str(tmp_path)
    store.write_snapshot({"t": spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")}, root, 0)
    store.write_snapshot({"t": spark.createDataFrame([(3, None, 7)], "id long, name string, level int")}, root, 2)
    schema = StructType([StructField("id", LongType()), StructField("name", StringType()), StructField("level", IntegerType()),
                         StructField("kind", StringType())])
    out = store.read_versions(spark, root, "t", schema, defaults={"level": 5, "name": "never", "kind": "k"})
    assert plan_of(out).count("FileScan") == 1
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a", 5, "k", 0), (2, None, 5, "k", 0), (3, None, 7, "k", 2)]
    assert store.read_versions(spark, root, "t", schema, versions=[2]).count() == 1
    assert store.read_versions(spark, root, "t", schema, versions=[]).count() == 0
