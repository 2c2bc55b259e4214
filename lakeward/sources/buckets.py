"""Catalog tables in key buckets: a commit writes the buckets it changes and points to the others (O-R2, O-R1).

Layout under a shared root (never a machine-local folder on a cluster)::

    root/claims/<N>                             made once, by the writer of version N
    root/data/<table>/v=<N>/bucket=<b>/...      rows of a bucket written by version N
    root/commits/v=<N>/...parquet               written last: version N is complete

A commit record has a row per (table, bucket, part): the version whose files
hold (part of) the bucket.  Rewritten buckets point to the new version alone;
appended rows add a part.  So readers see one whole version, a batch writes
what it touches, and old files stay until ``retire`` removes those that no
kept version points to.  A commit also carries each stream's last batch, by
which a replayed micro-batch is known again.

A version is claimed before its data is written, so of two writers of one
version the second fails at once (``Conflict``).  The claim names its owner:
a stream that is started again may go on with its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lakeward.sources import files, schemas
from lakeward.sources.catalog import TABLE_DEFAULTS, add_missing_columns

#: The column a table is bucketed by: what its changes and cascades ask for.
BUCKET_KEYS = {"teams": "id", "team_members": "team_id", "domains": "id", "assets": "id", "data_layers": "id",
               "access_requests": "asset_id", "users": "id"}
#: Tables that are only appended to, beside the catalog.
EVENT_TABLES = {
    "decisions": StructType([StructField("batch", StringType()), *schemas.DECISIONS.fields]),
    "notifications": StructType([StructField(c, StringType()) for c in ("request_id", "notify_to", "subject", "body")]),
}
COMMIT = "version long, parent long, name string, bucket int, part long, buckets int, streams map<string,long>, committed_at timestamp"


class Conflict(RuntimeError):
    """Another writer has the version."""


@dataclass
class Head:
    """A committed version: its parts per table, number of buckets, and each stream's last batch."""

    version: int
    parts: dict[str, set[tuple[int, int]]] = field(default_factory=dict)
    buckets: dict[str, int] = field(default_factory=dict)
    streams: dict[str, int] = field(default_factory=dict)


def schema_of(name: str) -> StructType:
    return schemas.CATALOG_SCHEMAS.get(name) or EVENT_TABLES[name]


def bucket_of(key: Column, buckets: int | Column) -> Column:
    """The bucket of a key; rows without one are in bucket 0."""
    return F.coalesce(F.pmod(F.xxhash64(key), buckets if isinstance(buckets, Column) else F.lit(buckets)), F.lit(0)).cast("int")


def _data(root: str, name: str, version: int) -> str:
    return f"{root.rstrip('/')}/data/{name}/v={version}"


def _commits(root: str) -> str:
    return f"{root.rstrip('/')}/commits"


def versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions, oldest first."""
    found = [int(n[2:]) for n in files.names(spark, _commits(root)) if n.startswith("v=")]
    return sorted(v for v in found if "_SUCCESS" in files.names(spark, f"{_commits(root)}/v={v}"))


def head(spark: SparkSession, root: str, version: int | None = None) -> Head:
    """A committed version's record (default: the latest)."""
    if version is None:
        known = versions(spark, root)
        if not known:
            raise FileNotFoundError(f"no committed version under {root}")
        version = known[-1]
    out = Head(version)
    for r in spark.read.schema(COMMIT).parquet(f"{_commits(root)}/v={version}").collect():
        out.buckets[r["name"]] = r["buckets"]
        parts = out.parts.setdefault(r["name"], set())
        if r["part"] is not None:
            parts.add((r["bucket"], r["part"]))
        out.streams = dict(r["streams"] or {})
    return out


def read(spark: SparkSession, root: str, at: Head | int | None = None, only: Mapping[str, Iterable[int]] | None = None) -> dict[str, DataFrame]:
    """The tables of a version; with ``only`` just the named tables' buckets."""
    at = at if isinstance(at, Head) else head(spark, root, at)
    out = {}
    for name in at.parts if only is None else only:
        wanted = None if only is None else set(only[name])
        paths = [f"{_data(root, name, part)}/bucket={b}" for b, part in sorted(at.parts.get(name, ())) if wanted is None or b in wanted]
        schema = schema_of(name)
        df = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
        out[name] = add_missing_columns(df, schema, TABLE_DEFAULTS.get(name, {}))
    return out


def _write_rows(spark: SparkSession, root: str, name: str, version: int, rows: DataFrame, buckets: int) -> set[int]:
    """Write rows by bucket; the buckets that got any (their number bounds what comes to the driver)."""
    folder = _data(root, name, version)
    # What an owner wrote before it was stopped is not committed.
    files.remove(spark, folder)
    key = BUCKET_KEYS.get(name)
    # Rows are brought together by bucket, but a large bucket is cut into several tasks (and files): neither a task's memory
    # nor the number of tasks hangs on the number of buckets.
    by_bucket = (rows.withColumn("bucket", bucket_of(F.col(key), buckets)).hint("rebalance", "bucket") if key else
                 rows.withColumn("bucket", F.lit(0)).hint("rebalance"))
    by_bucket.write.partitionBy("bucket").parquet(folder)
    return {int(n[7:]) for n in files.names(spark, folder) if n.startswith("bucket=")}


def claim(spark: SparkSession, root: str, version: int, owner: str) -> None:
    """Take a version for writing; ``Conflict`` if it is committed or another owner's."""
    path = f"{root.rstrip('/')}/claims/{version}"
    if not files.create_once(spark, path, owner):
        other = files.read_once(spark, path)
        if other != owner or version in versions(spark, root):
            raise Conflict(f"version {version} of {root} belongs to {other!r}; if that writer is gone for good and the version is not "
                           f"committed, remove {path}")


def commit(spark: SparkSession, root: str, parent: Head | None, owner: str, rewritten: Mapping[str, tuple[DataFrame, Iterable[int]]],
           appended: Mapping[str, DataFrame] | None = None, stream: str | None = None, batch: int | None = None,
           buckets: Mapping[str, int] | None = None) -> Head:
    """Write the version after ``parent``.

    ``rewritten``: per table the rows of whole buckets and which buckets
    these are (rows of other buckets must not be there); ``appended``: rows
    to add.  ``buckets`` gives the number for tables that the parent lacks.
    """
    version = 0 if parent is None else parent.version + 1
    claim(spark, root, version, owner)
    new = Head(version, *(({k: set(v) for k, v in parent.parts.items()}, dict(parent.buckets), dict(parent.streams)) if parent else ()))
    for name, (rows, which) in rewritten.items():
        n = new.buckets.setdefault(name, (buckets or {}).get(name, 1))
        which = set(which)
        got = _write_rows(spark, root, name, version, rows, n) if which else set()
        if not got <= which:
            raise ValueError(f"{name}: rows of buckets {sorted(got - which)[:5]} that are not rewritten")
        new.parts[name] = {(b, part) for b, part in new.parts.get(name, ()) if b not in which} | {(b, version) for b in got}
    for name, rows in (appended or {}).items():
        n = new.buckets.setdefault(name, (buckets or {}).get(name, 1))
        got = _write_rows(spark, root, name, version, rows, n)
        new.parts[name] = new.parts.get(name, set()) | {(b, version) for b in got}
    if stream is not None:
        new.streams[stream] = int(batch)
    rows = [(version, None if parent is None else parent.version, name, b, part, new.buckets[name], new.streams or None)
            for name, parts in sorted(new.parts.items()) for b, part in sorted(parts) or [(None, None)]]
    spark.createDataFrame(rows, COMMIT.rsplit(", ", 1)[0]).withColumn("committed_at", F.current_timestamp()).coalesce(1) \
        .write.mode("overwrite").parquet(f"{_commits(root)}/v={version}")
    return new


def create(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], buckets: int | Mapping[str, int] = 16, owner: str = "create") -> Head:
    """Version 0: all tables, in ``buckets`` buckets each (about 128 MB a bucket is a good size)."""
    n = {name: buckets if isinstance(buckets, int) else buckets[name] for name in tables}
    return commit(spark, root, None, owner, {name: (df, range(n[name])) for name, df in tables.items()}, buckets=n)


def retire(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Remove the commits before the last ``keep`` and all data folders that no kept version points to; the folders removed."""
    known = versions(spark, root)
    kept = [head(spark, root, v) for v in known[-keep:]]
    alive = {(name, b, part) for h in kept for name, parts in h.parts.items() for b, part in parts}
    gone = []
    for v in known[:-keep]:
        files.remove(spark, f"{_commits(root)}/v={v}")
    for name in files.names(spark, f"{root.rstrip('/')}/data"):
        for folder in files.names(spark, f"{root.rstrip('/')}/data/{name}"):
            part = int(folder[2:])
            if part > known[-1]:
                continue
            for b in files.names(spark, _data(root, name, part)):
                if b.startswith("bucket=") and (name, int(b[7:]), part) not in alive:
                    gone.append(f"{_data(root, name, part)}/{b}")
                    files.remove(spark, gone[-1])
    return gone
