"""The bucketed store and the streams that commit to it."""

from __future__ import annotations

import datetime as dt
import glob

import pytest

from lakeward.sources import buckets, files, schemas
from lakeward.streaming.streams import change_stream, request_decisions, request_stream
from tests.conftest import ADMIN, LONER, M_ANALYST, M_LEAD, PLATFORM, T0, frames, sample_rows


def add_records(spark, folder, rows):
    spark.createDataFrame(rows, schemas.CHANGES).coalesce(1).write.mode("append").parquet(folder)


def records(spark, folder):
    return spark.readStream.schema(schemas.CHANGES).option("maxFilesPerTrigger", 1).parquet(folder)


def data_files(root):
    return {f.removeprefix(f"{root}/data/") for f in glob.glob(f"{root}/data/*/v=*/bucket=*/*.parquet")}


def ids(df):
    return sorted(r.id for r in df.collect())


def test_a_flag_writes_one_bucket_of_one_table(spark, sample, tmp_path):
    root, src = f"{tmp_path}/store", f"{tmp_path}/src"
    buckets.create(spark, root, sample, 8)
    before = data_files(root)
    add_records(spark, src, [(1, T0, M_ANALYST, "publish_asset", "A2", {})])
    change_stream(records(spark, src), root, f"{tmp_path}/ckpt").awaitTermination()
    new = {f for f in data_files(root) - before if not f.startswith("decisions/")}
    assert len(new) == 1 and next(iter(new)).startswith("assets/v=1/bucket=")
    tables = buckets.read(spark, root)
    assert {r.id: r.published for r in tables["assets"].collect()} == {"A1": True, "A2": True, "A3": True}
    for name in sample:
        assert ids(tables[name]) == ids(sample[name])
    assert {r.seq: r.status for r in tables["decisions"].collect()} == {1: 200}
    # The version before is still whole.
    assert {r.id: r.published for r in buckets.read(spark, root, 0)["assets"].collect()}["A2"] is False


def test_cascades_over_buckets_equal_the_whole_tables(spark, sample, tmp_path):
    from lakeward.operators.changes import apply_changes
    from tests.conftest import change_frame

    root, src = f"{tmp_path}/store", f"{tmp_path}/src"
    buckets.create(spark, root, sample, {name: 3 + k for k, name in enumerate(sample)})
    steps = [dict(seq=1, actor=M_LEAD, op="create_domain", fields={"name": "New", "team_id": "TM"}),
             dict(seq=2, actor=ADMIN, op="delete_layer", target="L1"),
             dict(seq=3, actor=LONER, op="create_team", fields={"name": "Mine"}),
             dict(seq=4, actor=ADMIN, op="delete_user", target="U5"),
             dict(seq=5, actor=LONER, op="request_access", target="A3"),
             dict(seq=6, actor=PLATFORM, op="delete_team", target="TM"),
             dict(seq=7, actor=ADMIN, op="create_layer", fields={"name": "Ruby"}),
             dict(seq=8, actor=ADMIN, op="assign_user", target="U6", fields={"team_id": "TF"})]
    change_frame(spark, steps).coalesce(1).write.parquet(src)
    change_stream(records(spark, src), root, f"{tmp_path}/ckpt").awaitTermination()
    whole, _ = apply_changes(sample, change_frame(spark, steps), batch="1")
    stored = buckets.read(spark, root)
    for name in sample:
        assert sorted(map(str, stored[name].collect())) == sorted(map(str, whole[name].collect())), name


def test_every_batch_is_one_commit_and_replays_write_nothing(spark, sample, tmp_path):
    root, src = f"{tmp_path}/store", f"{tmp_path}/src"
    buckets.create(spark, root, sample, 4)
    add_records(spark, src, [(1, T0, M_ANALYST, "publish_asset", "A2", {})])
    add_records(spark, src, [(1, T0 + dt.timedelta(seconds=1), ADMIN, "delete_asset", "A3", {})])
    change_stream(records(spark, src), root, f"{tmp_path}/ckpt").awaitTermination()
    assert buckets.versions(spark, root) == [0, 1, 2]
    tables = buckets.read(spark, root)
    assert ids(tables["assets"]) == ["A1", "A2"] and ids(tables["access_requests"]) == ["R1", "R2"]
    # The same stream without its checkpoint replays batches that the store knows.
    change_stream(records(spark, src), root, f"{tmp_path}/lost", stream_id=f"{tmp_path}/ckpt").awaitTermination()
    assert buckets.versions(spark, root) == [0, 1, 2]
    # Another stream's batches are its own.
    change_stream(records(spark, src), root, f"{tmp_path}/other").awaitTermination()
    assert buckets.versions(spark, root) == [0, 1, 2, 3, 4]
    assert buckets.head(spark, root).streams == {f"{tmp_path}/ckpt": 1, f"{tmp_path}/other": 1}


def test_one_of_two_writers_fails(spark, sample, tmp_path):
    root = f"{tmp_path}/store"
    at = buckets.create(spark, root, sample, 4)
    first = buckets.commit(spark, root, at, "one", {"assets": (sample["assets"].limit(1), range(4))})
    with pytest.raises(buckets.Conflict, match="version 1 .* 'one'"):
        buckets.commit(spark, root, at, "two", {"assets": (sample["assets"].limit(0), range(4))})
    assert buckets.versions(spark, root) == [0, 1] and buckets.read(spark, root)["assets"].count() == 1
    # A writer that was stopped before its commit goes on with its own claim; what it left is not read.
    buckets.claim(spark, root, 2, "three")
    sample["assets"].withColumn("bucket", buckets.bucket_of(sample["assets"].id, 4)).write.partitionBy("bucket").parquet(f"{root}/data/assets/v=2")
    with pytest.raises(buckets.Conflict):
        buckets.commit(spark, root, first, "four", {})
    assert buckets.read(spark, root)["assets"].count() == 1
    buckets.commit(spark, root, first, "three", {"assets": (sample["assets"].limit(0), range(4))})
    assert buckets.read(spark, root)["assets"].count() == 0
    with pytest.raises(buckets.Conflict):
        buckets.commit(spark, root, first, "three", {})
    with pytest.raises(ValueError, match="not rewritten"):
        buckets.commit(spark, root, buckets.head(spark, root), "five", {"assets": (sample["assets"], [99])})


def test_retire_keeps_what_the_last_versions_need(spark, sample, tmp_path):
    root, src = f"{tmp_path}/store", f"{tmp_path}/src"
    buckets.create(spark, root, sample, 4)
    for k, op in enumerate(["publish_asset", "unpublish_asset", "publish_asset"]):
        add_records(spark, src, [(k, T0, M_ANALYST, op, "A2", {})])
    change_stream(records(spark, src), root, f"{tmp_path}/ckpt", keep=2).awaitTermination()
    assert buckets.versions(spark, root) == [2, 3]
    kept = {f.split("/")[1] for f in data_files(root) if f.startswith("assets/") and "A2"}
    assert {"v=2", "v=3"} <= kept and "v=1" not in kept
    for version, flag in ((2, False), (3, True)):
        tables = buckets.read(spark, root, version)
        assert {r.id: r.published for r in tables["assets"].collect()} == {"A1": True, "A2": flag, "A3": True}
        assert ids(tables["users"]) == ids(sample["users"])
    assert files.names(spark, f"{root}/nowhere") == []


def test_request_stream_drops_what_comes_again(spark, sample, tmp_path):
    root, src = f"{tmp_path}/store", f"{tmp_path}/src"
    buckets.create(spark, root, {"assets": sample["assets"], "access_requests": sample["access_requests"]}, 4)
    first = [(1, T0, LONER, "request_access", "A1", {"message": "hi"}), (2, T0, LONER, "request_access", "AX", {}),
             (3, T0, M_ANALYST, "publish_asset", "A2", {}), (4, T0, None, "request_access", "A2", None)]
    add_records(spark, src, first + first[:1])
    # Another batch has another request of the same seq; an old one comes late.
    later = [(1, T0 - dt.timedelta(days=400), LONER, "request_access", "A2", {"requester_email": "x@y", "message": None})]
    add_records(spark, src, later + first[:1])
    request_stream(records(spark, src), root, f"{tmp_path}/ckpt").awaitTermination()

    def state():
        tables = buckets.read(spark, root)
        rows = sorted((r.asset_id, r.requester_email, r.status, str(r.created_at)) for r in tables["access_requests"].collect() if r.id[:8] == "request-")
        return rows, sorted(r.request_id for r in tables["notifications"].collect()), sorted((r.seq, r.status) for r in tables["decisions"].collect())

    rows, told, decisions = state()
    assert rows == [("A1", LONER, "pending", "2024-01-01 00:00:00"), ("A2", "x@y", "pending", "2022-11-27 00:00:00")]
    assert len(told) == 2 and decisions == [(1, 201), (1, 201), (2, 404), (4, 422)]
    # A replay into the same checkpoint is dropped by the state.
    add_records(spark, src, first + later)
    request_stream(records(spark, src), root, f"{tmp_path}/ckpt").awaitTermination()
    assert state() == (rows, told, decisions)
    # A stream that forgot all finds its requests committed; those turned down are decided again.
    request_stream(records(spark, src), root, f"{tmp_path}/lost").awaitTermination()
    assert state()[:2] == (rows, told)


def test_batch_and_stream_decide_alike(spark, sample):
    rows = [(1, T0, LONER, "request_access", "A1", {}), (2, T0, LONER, "request_access", "AX", {})]
    batch = request_decisions(spark.createDataFrame(rows, schemas.CHANGES), sample["assets"])
    assert {r.seq: r.status for r in batch.collect()} == {1: 201, 2: 404}


def test_rows_without_a_key_stay(spark, tmp_path):
    rows = sample_rows()
    rows["team_members"].append(("m9", None, "nobody@example.com", "member"))
    tables = frames(spark, rows)
    buckets.create(spark, f"{tmp_path}/store", tables, 4)
    assert ids(buckets.read(spark, f"{tmp_path}/store")["team_members"]) == ids(tables["team_members"])


def test_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    # a bucket was one task's work, and all rows of a few buckets one task's memory.
    rows = spark.range(0, 40000, 1, 8).selectExpr("concat('R', id) AS id", "concat('A', id % 5) AS asset_id", "uuid() AS requester_email",
                                                  "'pending' AS status", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS created_at",
                                                  "CAST(NULL AS TIMESTAMP_NTZ) AS decision_at")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64KB")
    try:
        buckets.create(spark, f"{tmp_path}/store", {"access_requests": rows}, 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    stored = buckets.read(spark, f"{tmp_path}/store")["access_requests"]
    assert len(stored.inputFiles()) >= 6 and stored.select("id").distinct().count() == stored.count() == 40000


def test_micro_batch_is_read_by_several_tasks(spark, tmp_path):
    # F1, F2, F6: a micro-batch was one file.
    from lakeward.plans.stream_queries import write_batches

    spark.range(3000).selectExpr("id AS event_id", "'x' AS props").coalesce(1).write.parquet(f"{tmp_path}/sf/events.parquet")
    write_batches(spark, f"{tmp_path}/sf", f"{tmp_path}/in", 3, [1])
    written = spark.read.parquet(f"{tmp_path}/in")
    assert len(written.inputFiles()) > 1 and sorted(r[0] for r in written.select("event_id").collect()) == list(range(1000, 2000))
