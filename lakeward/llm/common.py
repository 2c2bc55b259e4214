"""What the operators share: the tables of a run, written intermediates, connected components."""

from __future__ import annotations

import contextlib
import gc
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeward.session import discard, materialize, scratch

#: Rows and bytes per Arrow batch: a batch of long texts stays at some MB in a Python worker, or is one text.
ARROW_ROWS = 256
ARROW_BYTES = 16 << 20
#: Links per written file of a round of ``components``.
LINKS_PER_FILE = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark (any file system Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def python_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get, by rows and by bytes, for the session's later plans too."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def held_out(doc_id="doc_id"):
    """The fold rule: crc32 of the id as text, mod 5, is 0. A null id is in the held-out fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def document_key():
    """One string for a document row: its id and its text's hash (rows equal in both are one document)."""
    return F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64("text").cast("string"))


def first_of_each(rows: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group by ``order``, the same whatever the partitioning.

    A group is cut within shares of it first (dealt by a hash of the order),
    then within few larger shares, then as a whole: a task gets a share of a
    group, or at most ``n`` rows of each of its smaller shares.
    """
    shares = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for many in dict.fromkeys([shares, math.isqrt(shares), 1]):
        share = F.pmod(F.xxhash64(*order), F.lit(many))
        window = Window.partitionBy(group, share) if many > 1 else Window.partitionBy(group)
        rows = rows.withColumn("_n", F.row_number().over(window.orderBy(*order))).where(F.col("_n") <= n).drop("_n")
    return rows


def distinct_texts(rows: DataFrame, group: str, n: int) -> DataFrame:
    """(group, h, doc_id): the first ``n`` distinct texts of each group by text hash, each with its smallest doc_id.

    ``rows`` has the group, h (text hash) and doc_id; copies of a text take one place.
    """
    return first_of_each(rows.groupBy(group, "h").agg(F.min("doc_id").alias("doc_id")), group, ["h"], n)


def written(df: DataFrame, label: str, bucket: str | None = None) -> DataFrame:
    """``df`` written once under the shared checkpoint folder and read back (survives lost executors)."""
    return materialize(df, label, bucket)


@contextlib.contextmanager
def step(spark: SparkSession):
    """A ``scratch`` scope for a step of an operator: at its end all it wrote is dropped but what it keeps.

    Then the driver collects its garbage, upon which Spark drops the shuffle
    files of the finished plans.
    """
    with scratch(spark) as keep:
        yield keep
    free_shuffles(spark)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffles that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def told_apart(rows: DataFrame, key: str, proof: str, label: str) -> DataFrame:
    """``rows`` with a key of its own for each (key, proof): things are one if both hashes of theirs agree."""
    clash = rows.where(F.col(key).isNotNull()).groupBy(F.struct(key).alias("k")).agg(F.min(proof).alias("_low"), F.max(proof).alias("_high"))
    clash = written(clash.where("_low < _high").select(F.col(f"k.{key}").alias("_key"), "_low"), f"{label}-clashes")
    if clash.isEmpty():
        return rows
    other = F.col("_low").isNotNull() & (F.col(proof) > F.col("_low"))
    return written(rows.join(clash, F.col(key) == F.col("_key"), "left")
                   .withColumn(key, F.when(other, F.xxhash64(key, proof)).otherwise(F.col(key))).select(rows.columns), f"{label}-apart")


def _min_neighbour(edges: DataFrame) -> DataFrame:
    """(u, v, m): m is the smallest of u and all its neighbours.

    The minimum is grouped by a struct of the key, so the join back gets an
    exchange of its own, and AQE can split a hub's rows.
    """
    low = (edges.groupBy(F.struct("u").alias("k")).agg(F.min("v").alias("low"))
           .select(F.col("k.u").alias("u"), "low"))
    return edges.join(low, "u").select("u", "v", F.least("u", "low").alias("m"))


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root) of an undirected graph given as rows (u, v) of longs; root is the component's smallest node.

    Distributed union-find by alternating large-star and small-star steps
    until the edges are stars; every round is written to the shared folder,
    in as many files as its links need.
    Only a count and a checksum come to the driver.  Isolated nodes and
    self-links are absent; an empty table gives an empty result.
    """
    with step(edges.sparkSession) as keep:
        edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
        edges = written(edges, f"{label}-edges")
        mark = None
        while True:
            now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
            if now == mark or now[0] == 0:
                break
            mark = now
            both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = _min_neighbour(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            large = large.where("u <> v").distinct()
            small = _min_neighbour(large)
            small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
                small.select("u", F.col("m").alias("v")))
            files = max(edges.sparkSession.sparkContext.defaultParallelism, math.ceil(now[0] / LINKS_PER_FILE))
            last, edges = edges, written(small.where("u <> v").distinct().coalesce(files), f"{label}-edges")
            discard(last)
        keep(edges)
    # Stars: every node but the roots is the u of one row.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
