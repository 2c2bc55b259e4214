"""Prefix trie of rebuilt conversations by whole-sequence collapse.

A rebuilt conversation c is the first h turns of its base conversation
c - c % 5 (all if the base has fewer, none if there is no such
conversation), then c's own turns after its first h; h = crc32(decimal c)
% 9.  Every distinct sequence of first d turns (role, text) is a node.

1. Turns become a 128-bit digest and a byte count; their texts are not
   moved again.  A turn's place is its rank inside a span of ``SPAN`` turn
   numbers plus the turns of the spans before, so a conversation that holds
   a third of all turns is ordered by many tasks.
2. A prefix's key is the XOR of its turns' digests, each hashed together
   with its place, in two 64-bit lanes; running keys are found span by span
   in the same way.
3. Collapse: identical rebuilt conversations become one weighted sequence
   with its smallest conversation and its list of ends.  The list is hashed
   as a stream of sorted pieces of ``PIECE`` ids: the pieces are made apart,
   and nothing holds the whole list.
4. Sequences that are a proper prefix of another are dropped by an anti-join
   on the prefix keys: the others are the leaves.
5. Prefixes of the weighted sequences are aggregated to nodes.  The bytes
   saved below a node are its members' bytes from there on, less the bytes
   of the distinct nodes of its subtree.  For these each node belongs to the
   smallest leaf below it; a leaf then owns the nodes from some depth on,
   and adds to an ancestor the smaller of its bytes below and its own bytes.

Defined results: a null role or text is empty; turns are ordered by turn
(null first), equal turns by digest, so repeated rows count as turns and
their order does not matter; rows without a conv_id belong to no
conversation and are left out; a conversation whose rebuilt form has no
turn ends at the root; an empty table has no node; other columns are
ignored.  Turns of equal number are ranked in one task, sorted with spill.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeward.llm.common import python_batches, table, written

BASE = 5
HEAD = 9
SPAN = 1024
PIECE = 4096
KEY = ["depth", "k1", "k2"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv, turn, digest, bytes) of every row that has a conv_id."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    known = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(known.cast("binary"))).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))


def numbered(turns: DataFrame) -> DataFrame:
    """``turns`` with place, from 1, in the order of turn (null first) and digest within a conversation."""
    spans = turns.withColumn("span", F.floor(F.col("turn") / SPAN).cast("long")).withColumn(
        "part", F.when(F.col("turn").isNull(), F.substring("digest", 1, 1)))
    before = Window.partitionBy("conv").orderBy(F.asc_nulls_first("span"), F.asc_nulls_first("part")).rowsBetween(
        Window.unboundedPreceding, -1)
    counts = spans.groupBy("conv", "span", "part").agg(F.count("*").alias("n"))
    earlier = (counts.withColumn("earlier", F.sum("n").over(before)).where("earlier > 0")
               .select(F.col("conv").alias("_c"), F.col("span").alias("_s"), F.col("part").alias("_p"), "earlier"))
    own = Window.partitionBy("conv", "span", "part").orderBy(F.asc_nulls_first("turn"), "digest")
    ranked = spans.withColumn("rank", F.row_number().over(own))
    same = ((F.col("conv") == F.col("_c")) & F.col("span").eqNullSafe(F.col("_s")) & F.col("part").eqNullSafe(F.col("_p")))
    return ranked.join(earlier, same, "left").select(
        "conv", "digest", "bytes", (F.col("rank") + F.coalesce("earlier", F.lit(0))).alias("place"))


def rebuilt(conversations: DataFrame, base: int = BASE, head: int = HEAD) -> DataFrame:
    """(conv, depth, a1, a2, bytes): the turns of every rebuilt conversation, and its textless start at depth 0."""
    turns = written(numbered(turns_of(conversations)), "trie-turns")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % head
    starts = (turns.where((F.col("place") < head) & (F.col("conv") % base == 0)).groupBy("conv")
              .agg(F.sort_array(F.collect_list(F.struct("place", "digest", "bytes"))).alias("start")))
    convs = turns.select("conv").distinct().withColumn("base", F.col("conv") - F.col("conv") % base).withColumn("h", h)
    convs = convs.join(starts.withColumnRenamed("conv", "base"), "base", "left").select(
        "conv", "h", F.coalesce(F.expr("slice(start, 1, cast(h as int))"),
                                F.expr("array()").cast("array<struct<place:long,digest:binary,bytes:long>>")).alias("start"))
    # Turns after the first h stand where they stood, unless the base has fewer than h.
    short = convs.select(F.col("conv").alias("_c"), (F.col("h") - F.size("start")).alias("missing")).where("missing > 0")
    own = (turns.where(F.col("place") > h).join(short, F.col("conv") == F.col("_c"), "left")
           .select("conv", (F.col("place") - F.coalesce("missing", F.lit(0))).alias("depth"), "digest", "bytes"))
    lent = convs.select("conv", F.posexplode("start").alias("at", "t")).select(
        "conv", (F.col("at") + 1).cast("long").alias("depth"), "t.digest", "t.bytes")
    rows = own.union(lent).select("conv", "depth", F.xxhash64("depth", "digest").alias("a1"),
                                  F.xxhash64("digest", "depth").alias("a2"), "bytes")
    zero = F.lit(0).cast("long")
    return rows.union(convs.select("conv", zero, zero, zero, zero))


def _prefixes(rows: DataFrame) -> DataFrame:
    """``rows`` (conv, depth, a1, a2, bytes) with k1, k2 (key of the prefix that ends here) and upto (its bytes)."""
    spans = rows.withColumn("span", F.floor(F.col("depth") / SPAN).cast("long"))
    sums = spans.groupBy("conv", "span").agg(*_sums("a1", "a2", "bytes"))
    before = Window.partitionBy("conv").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    earlier = sums.select(F.col("conv").alias("_c"), F.col("span").alias("_s"), F.bit_xor("k1").over(before).alias("e1"),
                          F.bit_xor("k2").over(before).alias("e2"), F.sum("total").over(before).alias("eb"),
                          ).where("_s > 0")
    run = Window.partitionBy("conv", "span").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    here = spans.select("*", *[c.over(run).alias(n) for c, n in (
        (F.bit_xor("a1"), "r1"), (F.bit_xor("a2"), "r2"), (F.sum("bytes"), "rb"))])
    zero = F.lit(0).cast("long")
    return here.join(earlier, (F.col("conv") == F.col("_c")) & (F.col("span") == F.col("_s")), "left").select(
        *rows.columns, F.col("r1").bitwiseXOR(F.coalesce("e1", zero)).alias("k1"),
        F.col("r2").bitwiseXOR(F.coalesce("e2", zero)).alias("k2"), (F.col("rb") + F.coalesce("eb", zero)).alias("upto"))


def _sums(a1: str, a2: str, size: str) -> list:
    return [F.bit_xor(a1).alias("k1"), F.bit_xor(a2).alias("k2"), F.sum(size).alias("total")]


def _ends(whole: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends): the SHA-256 of the sorted, comma-joined ids of the conversations ``whole`` that end there."""
    pieces = (whole.groupBy(*KEY, F.floor(F.col("conv") / PIECE).alias("piece"))
              .agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids")))
    pieces = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "piece").select(*KEY, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for *k, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids.encode())
            if out:
                yield _rows(out)
        if key is not None:
            yield _rows([(*key, state.hexdigest())])

    return pieces.mapInArrow(run, "depth long, k1 long, k2 long, ends string")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:-1]] + [pa.array(columns[-1], pa.string())],
                                      [*KEY, "ends"])


def prefix_trie(conversations: DataFrame, base: int = BASE, head: int = HEAD) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (bytes of UTF-8) and ends_sha256."""
    python_batches(conversations.sparkSession)
    rows = written(rebuilt(conversations, base, head), "trie-rebuilt")
    whole = written(rows.groupBy("conv").agg(F.max("depth").alias("depth"), *_sums("a1", "a2", "bytes")), "trie-whole")
    # Collapse: one weighted sequence for all identical conversations.
    sequences = written(whole.groupBy(*KEY).agg(F.min("conv").alias("seq"), F.count("*").alias("weight"),
                                                F.max("total").alias("total")), "trie-sequences")
    theirs = sequences.select("seq", "weight", "total", F.col("depth").alias("length"))
    prefixes = written(_prefixes(rows.join(theirs.select(F.col("seq").alias("conv")), "conv", "left_semi"))
                       .join(theirs, F.col("conv") == F.col("seq")).drop("conv"), "trie-prefixes")
    leaves = written(sequences.join(prefixes.where("depth < length").select(*KEY).distinct(), KEY, "left_anti")
                     .select(F.col("seq").alias("leaf")), "trie-leaves")
    below = F.col("total") - F.col("upto") + F.col("bytes")
    marked = prefixes.join(leaves, F.col("seq") == F.col("leaf"), "left").withColumn("below", below)
    nodes = written(marked.groupBy(*KEY).agg(
        F.min("seq").alias("conv_id"), F.sum("weight").alias("n_convs"), F.count("leaf").alias("n_leaves"),
        F.min("leaf").alias("owner"), F.sum(F.col("weight") * F.col("below")).alias("gross"), F.max("bytes").alias("bytes"),
        F.max(F.col("k1").bitwiseXOR(F.col("a1"))).alias("p1"), F.max(F.col("k2").bitwiseXOR(F.col("a2"))).alias("p2")),
        "trie-nodes")
    owned = nodes.groupBy("owner").agg(F.sum("bytes").alias("owned"))
    distinct = (prefixes.join(owned, F.col("seq") == F.col("owner")).groupBy(*KEY)
                .agg(F.sum(F.least(below, "owned")).alias("net")))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"),
                                                F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                           F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(parents, ["depth", "p1", "p2"], "left")
    out = out.join(distinct, KEY).join(children, KEY, "left").join(_ends(whole.select("conv", *KEY)), KEY, "left")
    zero = F.lit(0).cast("long")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
                      "n_leaves", (F.col("gross") - F.col("net")).alias("saved_tokens"),
                      F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def op13(spark, sf_dir):
    """The nodes of the prefix trie of all rebuilt ``conversations``."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP13_SQL = r"""
WITH crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8],
                          lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256)))),
turns AS (
  SELECT conv_id AS c, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m,
         CAST(strlen(coalesce(text, '')) AS BIGINT) AS b, turn
  FROM conversations WHERE conv_id IS NOT NULL),
conv AS (SELECT c, list({'m': m, 'b': b} ORDER BY turn NULLS FIRST, m) AS s FROM turns GROUP BY c),
cut AS (
  SELECT c, s, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
                                            list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                               lambda a, x: xor(a >> 8, t[CAST((xor(a, x) & 255) + 1 AS BIGINT)])), 4294967295) % 9 AS h
  FROM conv, crc),
full_ AS (
  SELECT k.c, list_concat(coalesce(b.s[1:k.h], []), k.s[k.h + 1:]) AS s
  FROM cut k LEFT JOIN conv b ON b.c = k.c - k.c % 5),
pre AS (
  SELECT c, d, md5(array_to_string(list_transform(s[1:d], lambda x: x.m), ',')) || d AS k,
         md5(array_to_string(list_transform(s[1:d - 1], lambda x: x.m), ',')) || (d - 1) AS pk,
         CASE WHEN d = 0 THEN 0 ELSE s[d].b END AS b, len(s) = d AS ends
  FROM (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM full_)),
node AS (
  SELECT k, any_value(CASE WHEN d > 0 THEN pk END) AS pk, any_value(d) AS d, min(c) AS c, count(*) AS n, any_value(b) AS b,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS e
  FROM pre GROUP BY k),
kids AS (SELECT pk AS k, count(*) AS n FROM node WHERE pk IS NOT NULL GROUP BY pk),
under AS (SELECT DISTINCT u.k AS k, v.k AS v FROM pre u JOIN pre v ON u.c = v.c AND v.d >= u.d),
sub AS (
  SELECT u.k, count(*) FILTER (kids.k IS NULL) AS leaves, sum((v.n - 1) * v.b) AS saved
  FROM under u JOIN node v ON v.k = u.v LEFT JOIN kids ON kids.k = u.v GROUP BY u.k)
SELECT node.c AS conv_id, node.d AS depth, p.c AS parent_conv_id, node.n AS n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children,
       sub.leaves AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens, node.e AS ends_sha256
FROM node JOIN sub USING (k) LEFT JOIN kids USING (k) LEFT JOIN node p ON p.k = node.pk
"""
