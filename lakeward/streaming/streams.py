"""Catalog changes as streams (§2.11).

* ``request_stream``: access requests decided continuously.  Replayed and
  duplicated requests are dropped by a stateful operator and by what is
  committed; each micro-batch adds its request rows, notifications and
  decisions to the store in one commit.
* ``change_stream``: every micro-batch is one change set (``apply_changes``);
  its commit rewrites the buckets that the change set touches and points to
  the others.

Both write to a bucketed store (``sources.buckets``).  A commit carries the
stream's batch, so a replayed micro-batch commits nothing again.  Stores and
checkpoints live under the session's shared checkpoint folder
(``spark.checkpoint.dir``), never on one machine's local disk.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakeward.functions import vocab
from lakeward.functions.columns import notification_body, notification_subject
from lakeward.operators.changes import apply_changes
from lakeward.session import checkpoint_dir, materialize, scratch
from lakeward.sources import buckets


def stream_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one stream's store and checkpoint, under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/lakeward-streams/{name}-{uuid.uuid4().hex[:12]}"


def request_id() -> Column:
    """An id made of all that a request says: a record that comes again has it again, in whatever batch; others differ."""
    def told(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.char_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    fields = F.array_sort(F.map_entries(F.coalesce("fields", F.create_map().cast("map<string,string>"))))
    said = F.array_join(F.transform(fields, lambda e: F.concat(told(e["key"]), F.lit("="), told(e["value"]))), "&")
    at = F.unix_micros(F.col("event_at").cast("timestamp_ltz"))
    parts = [told(c) for c in (F.col("seq"), at, F.col("actor_email"), F.col("target_id"), said)]
    return F.concat(F.lit("request-"), F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, 32))


def request_decisions(requests: DataFrame, assets: DataFrame) -> DataFrame:
    """Decide access-request change records (stream or batch) against the asset table.

    ``requests`` has the change-record columns; the requester is
    ``fields['requester_email']`` or the actor.  Output per request: the
    decision (``seq, op, target_id, status, reason``), and when accepted the
    row of ``access_requests`` (``request``) and the owner notification
    (``notify_to, subject, body``).
    """
    a = assets.select(F.col("id").alias("_asset_id"), F.col("name").alias("_asset_name"),
                      F.col("owner_email").alias("_owner"))
    fields = F.coalesce(F.col("fields"), F.create_map().cast("map<string,string>"))
    requester = F.coalesce(F.try_element_at(fields, F.lit("requester_email")), F.col("actor_email"))
    named = requests.withColumn("_id", request_id())
    joined = named.join(a, named.target_id == a._asset_id, "left")
    status = (F.when(requester.isNull(), F.lit(422))
              .when(F.col("_asset_id").isNull(), F.lit(404)).otherwise(F.lit(201)))
    reason = (F.when(requester.isNull(), F.lit(vocab.REASONS["requester_email_is_required"]))
              .when(F.col("_asset_id").isNull(), F.lit(vocab.REASONS["asset_not_found"])).otherwise(F.lit("ok")))
    ok = status == 201
    row = F.struct(F.col("_id").alias("id"), F.col("target_id").alias("asset_id"), requester.alias("requester_email"),
                   F.lit("pending").alias("status"), F.col("event_at").cast("timestamp_ntz").alias("created_at"),
                   F.lit(None).cast("timestamp_ntz").alias("decision_at"))
    return joined.select(
        "seq", "op", F.when(ok, F.col("_id")).otherwise(F.col("target_id")).alias("target_id"),
        status.cast("int").alias("status"), reason.alias("reason"), F.when(ok, row).alias("request"),
        F.when(ok, F.col("_owner")).alias("notify_to"),
        F.when(ok, notification_subject(F.col("_asset_name"))).alias("subject"),
        F.when(ok, notification_body(requester, F.col("_asset_name"),
                                     F.try_element_at(fields, F.lit("message")))).alias("body"),
    )


def _started(writer, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def request_stream(requests: DataFrame, store_root: str, checkpoint: str, available_now: bool = True,
                   stream_id: str | None = None, remember: str = "1 day") -> StreamingQuery:
    """O-R1: start the request stream into the bucketed store.

    A request that comes again within ``remember`` of its arrival is dropped
    by ``dropDuplicatesWithinWatermark`` on its id.  The watermark runs on
    the arrival, not on the request's own time: a late request is decided
    like any other.  One that comes again later than that meets its own
    committed row or decision and is dropped there, so state stays bounded
    and nothing is written twice.
    """
    stream = stream_id or checkpoint
    arrived = requests.filter(F.col("op") == "request_access").withColumn("_id", request_id()).withColumn("_arrived_at", F.current_timestamp())
    fresh = arrived.withWatermark("_arrived_at", remember).dropDuplicatesWithinWatermark(["_id"]).drop("_arrived_at")

    def apply_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = buckets.head(spark, store_root)
        if at.streams.get(stream, -1) >= batch_id:
            return  # replay of a committed batch
        with scratch(spark):
            batch = materialize(batch, "request-batch")
            if batch.isEmpty():
                return
            # Only the buckets of the asked assets are read: their assets, their requests.
            n = at.buckets
            asked = batch.select(*[buckets.bucket_of(F.col("target_id"), n[name]).alias(name) for name in ("assets", "access_requests")])
            found = asked.distinct().collect()
            of = {name: {r[name] for r in found} for name in asked.columns}
            tables = buckets.read(spark, store_root, at, only=of)
            known = tables["access_requests"].select(F.col("id").alias("_known"))
            # A record that was turned down before and comes again is decided anew, and may then be accepted.
            batch = batch.join(known, F.col("_id") == F.col("_known"), "left_anti")
            decided = materialize(request_decisions(batch, tables["assets"]), "request-decisions")
            ok = decided.where("status = 201")
            out = {"access_requests": ok.select("request.*"),
                   "notifications": ok.select(F.col("target_id").alias("request_id"), "notify_to", "subject", "body"),
                   "decisions": decided.select(F.lit(f"{stream}#{batch_id}").alias("batch"), "seq", "op", "target_id", "status", "reason")}
            buckets.commit(spark, store_root, at, f"{stream}#{batch_id}", {}, out, stream, batch_id)

    return _started(fresh.writeStream.foreachBatch(apply_batch), checkpoint, available_now)


def change_stream(changes: DataFrame, store_root: str, checkpoint: str, available_now: bool = True,
                  stream_id: str | None = None, keep: int | None = None) -> StreamingQuery:
    """O-R2: apply each micro-batch of change records as one change set.

    The store must hold a committed version.  A batch is decided against the
    latest one; then the keys that it touches are found, the buckets of
    these keys are read, rewritten and committed with the batch's decisions.
    ``stream_id`` (default: the checkpoint's path) and the batch id make up
    the identity by which a replay is skipped.  Ids of created rows hold the
    version.  Of two streams that commit at once one fails with ``Conflict``
    and can be started again.  With ``keep`` files that the last ``keep``
    versions do not need are removed after each batch.
    """
    stream = stream_id or checkpoint

    def apply_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = buckets.head(spark, store_root)
        if at.streams.get(stream, -1) >= batch_id:
            return  # replay of a committed batch
        owner = f"{stream}#{batch_id}"
        with scratch(spark):
            tables = {name: df for name, df in buckets.read(spark, store_root, at).items() if name in buckets.BUCKET_KEYS}
            new, decisions = apply_changes(tables, batch, batch=str(at.version + 1))
            # One job finds the touched buckets of all tables.
            many = F.create_map(*[F.lit(x) for name in tables for x in (name, at.buckets[name])])
            found = new.touched().select("table", buckets.bucket_of(F.col("key"), many[F.col("table")]).alias("b")).distinct().collect()
            which = {name: b for name in tables if (b := {r["b"] for r in found if r["table"] == name})}
            cut = new.on(buckets.read(spark, store_root, at, only=which))
            decided = decisions.withColumn("batch", F.lit(owner))
            buckets.commit(spark, store_root, at, owner, {name: (cut[name], which[name]) for name in which},
                           {"decisions": decided.select(buckets.EVENT_TABLES["decisions"].fieldNames())}, stream, batch_id)
        if keep is not None:
            buckets.retire(spark, store_root, keep)

    return _started(changes.writeStream.foreachBatch(apply_batch), checkpoint, available_now)
