"""Registered streaming queries over the driver's events, cut into micro-batches.

Access requests go through the stateful request stream (O-R1), the whole
change log through the change stream (O-R2); both commit to a bucketed
store that holds the projected catalog.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward.plans.change_queries import CHANGED_ASSETS_SQL, DECISIONS_SQL
from lakeward.plans.registry import query
from lakeward.session import scratch
from lakeward.sources import buckets
from lakeward.sources.projection import catalog, read_table
from lakeward.streaming.streams import change_stream, request_stream, stream_folder

BATCHES = 5
#: The micro-batch of a change record: its place among the event ids, in five equal ranges.
BATCH_SQL = ("CAST(floor((event_id - (SELECT min(event_id) FROM events)) * CAST({n} AS DOUBLE) "
             "/ ((SELECT max(event_id) FROM events) - (SELECT min(event_id) FROM events) + 1)) AS INT)").format(n=BATCHES)


def write_batches(spark: SparkSession, sf_dir: str, folder: str, of: int = BATCHES, batches: list[int] | None = None) -> None:
    """The events table in ``of`` equal ranges of ids, written one after the other; ``batches`` names some of them.

    A range is written by as many tasks as there are cores, so that a stream
    reads it in as many; a stream that is started between the ranges takes
    one a micro-batch.
    """
    events = read_table(spark, sf_dir, "events")
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    if low is None:
        events.write.mode("append").parquet(folder)
        return
    batch = F.floor((F.col("event_id") - low) * float(of) / (high - low + 1)).cast("int")
    for k in range(of) if batches is None else batches:
        events.where(batch == k).repartition(spark.sparkContext.defaultParallelism, "event_id").write.mode("append").parquet(folder)


def change_records_stream(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The files of ``write_batches`` read as a stream, all new ones in a micro-batch, and projected to change records
    (stand-in input: a stream-static join with the customer table)."""
    events_schema = read_table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(events_schema).parquet(folder)
    customer = read_table(spark, sf_dir, "customer")
    k = F.get_json_object(F.col("props"), "$.k").cast("int")
    etype = F.col("event_type")
    op = (F.when(etype == "click", "update_asset").when(etype == "view", "publish_asset")
          .when(etype == "error", "unpublish_asset").when(etype == "signup", "delete_asset")
          .otherwise("request_access"))
    field_name = F.when((k % 10 == 0) | (etype != "click"), F.lit(None).cast("string")).otherwise("freshness")
    field_value = F.when(k % 3 == 0, "daily").when(k % 3 == 1, "hourly")
    return events.join(customer, customer.c_custkey == events.user_id).select(
        F.col("event_id").alias("seq"), F.col("ts").alias("event_at"),
        F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@example.com"))
        .alias("actor_email"),
        op.alias("op"), F.concat(F.lit("A"), F.col("user_id") * 14 + k).alias("target_id"),
        F.when(field_name.isNotNull(), F.create_map(field_name, field_value))
        .otherwise(F.create_map().cast("map<string,string>")).alias("fields"),
    )


# The id that ``streams.request_id`` makes of a request without fields.
REQUEST_ID_SQL = """'request-' || left(sha256(concat_ws('|', length(CAST(seq AS VARCHAR)) || ':' || seq,
  length(CAST(epoch_us(event_at) AS VARCHAR)) || ':' || epoch_us(event_at), length(actor_email) || ':' || actor_email,
  length(target_id) || ':' || target_id, '0:')), 32)"""


@query("request_stream", DECISIONS_SQL + f"""
SELECT {REQUEST_ID_SQL} AS id, target_id AS asset_id, actor_email AS requester_email, 'pending' AS status, event_at AS created_at,
  owner_email AS notify_to, 'Access request for data asset: ' || asset_name AS subject
FROM dec WHERE op = 'request_access' AND status < 300
""")
def q_request_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-R1: two micro-batches of events as a stream of access requests, then the first once more; the request rows and
    notifications in the store: every accepted request once."""
    c = catalog(spark, sf_dir)
    folder = stream_folder(spark, "requests")
    root = f"{folder}/store"
    buckets.create(spark, root, {"assets": c.assets, "access_requests": c.access_requests}, 8)
    for k in (0, 1, 0):
        write_batches(spark, sf_dir, f"{folder}/in", 2, [k])
        request_stream(change_records_stream(spark, sf_dir, f"{folder}/in"), root, f"{folder}/checkpoint").awaitTermination()
    tables = buckets.read(spark, root)
    told = tables["notifications"].withColumnRenamed("request_id", "id")
    return tables["access_requests"].join(told, "id").select("id", "asset_id", "requester_email", "status", "created_at", "notify_to", "subject")


def _streamed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    c = catalog(spark, sf_dir)
    folder = stream_folder(spark, "changes")
    root = f"{folder}/store"
    with scratch(spark):
        buckets.create(spark, root, c.tables(), 8)
    for k in range(BATCHES):
        write_batches(spark, sf_dir, f"{folder}/in", batches=[k])
        change_stream(change_records_stream(spark, sf_dir, f"{folder}/in"), root, f"{folder}/checkpoint").awaitTermination()
    return buckets.read(spark, root)


@query("change_stream", CHANGED_ASSETS_SQL)
def q_change_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-R2: the projected catalog as version 0 of a bucketed store, the events in five micro-batches applied as
    change sets, one commit each; the assets of the last version."""
    return _streamed(spark, sf_dir)["assets"].select("id", "freshness", "published", "updated_at")


# A batch meets the deletes of the batches before it: its asset is not found any more.
@query("change_stream_decisions", DECISIONS_SQL + f""",
nth AS (SELECT event_id AS seq, {BATCH_SQL} AS batch FROM events),
dropped AS (SELECT target_id, min(batch) AS batch FROM dec JOIN nth USING (seq) WHERE op = 'delete_asset' AND status < 300 GROUP BY target_id),
late AS (SELECT d.*, n.batch, x.batch < n.batch AS missing FROM dec d JOIN nth n USING (seq) LEFT JOIN dropped x USING (target_id))
SELECT CAST(batch AS INTEGER) AS batch, seq, op,
  CASE WHEN missing IS TRUE AND actor_email IS NOT NULL THEN target_id
       WHEN op = 'request_access' AND status < 300 THEN 'request-' || (batch + 1) || '-' || seq ELSE target_id END AS target_id,
  CAST(CASE WHEN missing IS TRUE AND actor_email IS NOT NULL THEN 404 ELSE status END AS INTEGER) AS status,
  CASE WHEN missing IS TRUE AND actor_email IS NOT NULL THEN 'Asset not found' ELSE reason END AS reason
FROM late
""")
def q_change_stream_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-R2: every decision of the five micro-batches, each against the store as the batches before left it."""
    return _streamed(spark, sf_dir)["decisions"].select(
        F.substring_index("batch", "#", -1).cast("int").alias("batch"), "seq", "op", "target_id", "status", "reason")
