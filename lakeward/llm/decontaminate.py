"""Benchmark decontamination: a broadcast hash set of test n-grams against the token windows of every document.

DataFrame functions only.  Words of a text: A-Z lower-cased, then the
longest runs of anything but ASCII non-alphanumerics.  A window is ``n``
consecutive words of an item; an item of fewer words (but not none) is one
window.  A window of a document that hashes to a window's hash is verified
word by word, then all its words are hit.

Defined results: null and empty texts have no words; null item ids hit
words but are not counted as items; repeated document rows each get their
row; documents may share an id with different texts; other columns of the
inputs are ignored (only the named ones are read).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeward.llm.common import table, written

#: Fixed by the contract: words of a text whose A-Z are lower-cased, and the same words before lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10

#: The windows are broadcast up to this size; a larger benchmark is joined by shuffle with equal results.
BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def item_windows(items: DataFrame, n: int = WINDOW) -> DataFrame:
    """(item_id, gram array<string>, wid): the windows of every item that has words."""
    tokens = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (n - 1)))
    return (tokens.select("item_id", "w", F.explode(starts).alias("i"))
            .select("item_id", F.expr(f"slice(w, i, {n})").alias("gram"))
            .select("item_id", "gram", F.xxhash64("gram").alias("wid")).distinct())


def find_hits(docs: DataFrame, items: DataFrame, n: int = WINDOW,
              broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, th, n_words, i, len, wid): the windows of the documents that are a benchmark's.

    Every occurrence of a window, at 1-based word i; and for every document
    row one row with i = 0 that carries the text's number of words.  th is
    the text's hash.  One pass over the documents while the windows can be
    broadcast; beyond that see ``_shuffled_hits``.
    """
    grams = item_windows(items, n).select("wid", "gram").distinct()
    size, lengths = grams.agg(F.sum(F.length(F.array_join("gram", " ")) * 4 + 32 * F.size("gram")),
                              F.collect_set(F.size("gram"))).first()
    if (size or 0) > broadcast_bytes:
        return _shuffled_hits(docs, grams, sorted(lengths))
    # The document's own row passes the join by an entry that no window of words equals: the empty one.
    grams = grams.union(items.sparkSession.range(1).select(F.xxhash64(F.array()).alias("wid"),
                                                           F.array().cast("array<string>").alias("gram")))
    each = F.array(*[F.lit(x) for x in [0, *sorted(lengths)]])
    tokens = docs.select("doc_id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("w"))
    windows = (tokens.select("doc_id", "th", "w", F.explode(each).alias("len")).where("size(w) >= len")
               .select("doc_id", "th", "w", "len", F.explode(F.expr(
                   "sequence(if(len = 0, 0, 1), if(len = 0, 0, size(w) - len + 1))")).alias("i"))
               .withColumn("g", F.expr("slice(w, greatest(i, 1), len)")).withColumn("wid", F.xxhash64("g")))
    return (windows.join(F.broadcast(grams), "wid").where("g = gram")
            .select("doc_id", "th", F.size("w").cast("long").alias("n_words"), "i", "len", "wid"))


def _shuffled_hits(docs: DataFrame, grams: DataFrame, lengths: list[int]) -> DataFrame:
    """``find_hits`` for windows too large to broadcast: no shuffled row holds a document's words.

    The documents' windows go by their hash alone; what meets a benchmark's
    hash comes back to its text (once for each document), and only those
    windows are shuffled as words and verified.  The documents' own rows
    stand beside.
    """
    tokens = docs.select("doc_id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("w"))
    own = tokens.select("doc_id", "th", F.size("w").cast("long").alias("n_words"), F.lit(0).alias("i"), F.lit(0).alias("len"),
                        F.xxhash64(F.array()).alias("wid"))
    each = F.array(*[F.lit(x) for x in lengths])
    hashed = (tokens.select("doc_id", "th", "w", F.explode(each).alias("len")).where("size(w) >= len")
              .select("doc_id", "th", "w", "len", F.explode(F.expr("sequence(1, size(w) - len + 1)")).alias("i"))
              .select("doc_id", "th", "i", "len", F.xxhash64(F.expr("slice(w, i, len)")).alias("wid")))
    met = (hashed.join(grams.select("wid"), "wid", "left_semi").groupBy("doc_id", "th")
           .agg(F.collect_set(F.struct("i", "len", "wid")).alias("met"))
           .select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "met"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    found = (texts.join(met, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
             .select("doc_id", "th", words(F.col("text")).alias("w"), "met")
             .select("doc_id", "th", "w", F.explode("met").alias("m"))
             .select("doc_id", "th", F.size("w").cast("long").alias("n_words"), "m.i", "m.len", "m.wid",
                     F.expr("slice(w, m.i, m.len)").alias("g")))
    return own.union(found.join(grams, "wid").where("g = gram").select("doc_id", "th", "n_words", "i", "len", "wid"))


def covered(spans: Column) -> Column:
    """How many words sorted (i, len) spans cover."""
    return F.aggregate(
        spans, F.struct(F.lit(0).alias("c"), F.lit(0).alias("e")),
        lambda a, s: F.struct(
            (a["c"] + F.greatest(F.lit(0), s["i"] + s["len"] - F.greatest(a["e"], s["i"]))).alias("c"),
            F.greatest(a["e"], s["i"] + s["len"]).alias("e")),
        lambda a: a["c"].cast("long"))


def contamination(docs: DataFrame, items: DataFrame, n: int = WINDOW) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = written(find_hits(docs, items, n), "decontaminate-hits")
    # Two windows of one hash (both verified above) would only add up here; their items are told apart by the pair.
    of_window = item_windows(items, n).where("item_id is not null").select("wid", F.col("item_id").cast("string").alias("id"))
    per_item = (found.where("i > 0").select("doc_id", "th", "wid").distinct().join(of_window.distinct(), "wid")
                .groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("id")).alias("ids"))
                .select(F.col("doc_id").alias("i_id"), F.col("th").alias("i_th"), "ids"))
    per_doc = found.groupBy("doc_id", "th").agg(
        F.max("n_words").alias("n_words"), F.count_if(F.col("i") == 0).alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("i") > 0, F.struct("i", "len")))).alias("spans"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    n_hit = covered(F.col("spans"))
    return (per_doc.join(per_item, F.col("doc_id").eqNullSafe(F.col("i_id")) & (F.col("th") == F.col("i_th")), "left")
            .select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
                    F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
                    (n_hit > 0).alias("contaminated"), F.explode(F.expr("sequence(1, copies)")).alias("copy")).drop("copy"))


def decontaminate(docs: DataFrame, items: DataFrame, n: int = WINDOW, action: str = "document") -> DataFrame:
    """``docs`` without its contaminated documents, or (``action="span"``) with their hit words cut out.

    Clean rows come back unchanged.  A cut keeps what stands between the words.
    """
    if action not in ("document", "span"):
        raise ValueError("action: document or span")
    hits = (written(find_hits(docs, items, n).where("i > 0"), "decontaminate-hits").groupBy("doc_id", "th")
            .agg(F.collect_set(F.struct("i", "len")).alias("spans"))
            .select(F.col("doc_id").alias("_id"), F.col("th").alias("_bad"), F.array_distinct(F.flatten(F.transform(
                "spans", lambda s: F.sequence(s["i"], s["i"] + s["len"] - 1)))).alias("_hit")))
    keyed = docs.withColumn("_th", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_bad"))
    if action == "document":
        return keyed.join(hits, same, "left_anti").select(docs.columns)
    gaps, own = F.split("text", ANY_CASE_WORD), F.regexp_extract_all("text", F.lit(ANY_CASE_WORD), F.lit(0))
    cut = F.concat(F.get(gaps, F.lit(0)), F.array_join(F.transform(
        F.sequence(F.lit(1), F.size(own)),
        lambda i: F.concat(F.when(F.array_contains("_hit", i), F.lit("")).otherwise(F.get(own, i - 1)), F.get(gaps, i))), ""))
    return (keyed.join(hits, same, "left")
            .withColumn("text", F.when(F.col("_hit").isNotNull(), cut).otherwise(F.col("text"))).select(docs.columns))


def op9(spark, sf_dir):
    """Every word window of ``documents`` against every window of ``benchmark``."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS g, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT k, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT DISTINCT dw.k, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
pos AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM hit) GROUP BY k),
its AS (SELECT k, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
        FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (k) LEFT JOIN its USING (k)
"""
