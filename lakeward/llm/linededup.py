"""Fuzzy line dedup by MinHash: signatures, banding, exact verification, union-find.  DataFrame functions only.

A line is what stands between newlines; blank lines (white space only) are
left alone.  Its shingles are all its ``SHINGLE``-character runs (a shorter
line is one shingle).  Two lines are near-duplicates if the Jaccard
similarity of their shingle sets is at least ``SIMILARITY``.

1. Equal lines are one: grouped by a 64-bit hash, with their first place.
2. Signature: MinHash over all the line's shingles, whatever its length.  A
   value is the minimum of hash XOR a constant; ``BANDS`` bands of ``ROWS``
   values.
3. Lines that share a band meet in a bucket.  Every member is compared with
   the bucket's smallest line on the full shingle sets; the links found give
   components (distributed union-find).
4. Buckets whose lines are in several components go on: members of the
   bucket's largest component (its main one) and the rest are dealt into
   blocks of about ``BLOCK`` lines or ``BLOCK_CHARS`` characters.  A task row
   holds two blocks, of the rest or of the rest and the main component, and
   compares every pair of lines of different components, in the first band
   that they share, on the full shingle sets.  It gives out which components
   are linked, never pairs of lines.  So a large group of near copies costs
   its size; only lines unlike each other that still share a bucket are
   compared pair by pair.
5. Verified links give components; of each one line stays, the one with the
   first place by (doc_id, text hash, line number), null ids last.

Two tests spare most sets: sizes that differ too much; and the words of a
bitmap of ``WORDS`` x 64 bits a line, whose common bits bound the common
shingles from above.  Both are exact.  Lines of one 64-bit hash are told
apart by a second one, so that only equal lines are one.

Recall is that of the banding (0.997 at 0.8): every pair that shares a band
is compared, unless its lines are in one component already.

Defined results: a document that had lines and keeps only blank ones is
dropped; one that had none (null, empty or blank text) stays as it is.  Rows
equal in doc_id and text are one document and come back as one row.  Other
columns come back unchanged.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeward.llm.common import components, document_key, free_shuffles, step, table, written
from lakeward.session import discard

SHINGLE = 8
SIMILARITY = 0.8
BANDS, ROWS = 8, 3
BLOCK = 128
BLOCK_CHARS = 1 << 20
WORDS = 16
#: Shingles that one exploded row hashes.
RUN = 16


#: What ``measured`` tells of a line: its sizes and its bitmap.
_SKETCH = ["n", "ones", *[f"b{w}" for w in range(WORDS)]]


def _constants(count: int) -> list[int]:
    rng = random.Random(20240229)
    return [rng.getrandbits(64) - 2 ** 63 for _ in range(count)]


def _points(line: Column) -> Column:
    """The characters of a line, four bytes each, so that a shingle is cut out without a walk."""
    return F.encode(line, "UTF-32")


def _last(points: Column) -> Column:
    """The last shingle's first byte, from 1; a line shorter than a shingle has one."""
    return F.greatest(F.lit(1), F.octet_length(points) + 1 - 4 * SHINGLE)


def _shingle(points: Column, byte: Column) -> Column:
    return F.xxhash64(F.substring(points, byte, F.lit(4 * SHINGLE)))


def _exploded(lines: DataFrame) -> tuple[DataFrame, list[str]]:
    """The shingles of ``lines`` (lid, line), RUN of them in a row, and their columns; the last run repeats the last shingle."""
    runs = lines.select("lid", _points(F.col("line")).alias("p")).select("lid", "p", _last(F.col("p")).alias("last"))
    runs = runs.select("lid", "p", "last", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(4 * RUN))).alias("i"))
    names = [f"h{k}" for k in range(RUN)]
    return runs.select("lid", *[_shingle(F.col("p"), F.least(F.col("i") + 4 * k, F.col("last"))).alias(h)
                                for k, h in enumerate(names)]), names


def banded_lines(lines: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(lid, bands array<long>) of ``lines`` (lid, line)."""
    c = _constants(bands * rows)
    runs, names = _exploded(lines)
    low = runs.groupBy("lid").agg(
        *[F.min(F.least(*[F.col(h).bitwiseXOR(F.lit(k)) for h in names])).alias(f"m{j}") for j, k in enumerate(c)])
    return low.select("lid", F.array(*[F.xxhash64(F.lit(b), *[f"m{b * rows + r}" for r in range(rows)])
                                       for b in range(bands)]).alias("bands"))


def shingles(line: Column) -> Column:
    """array<long>: hashes of all character shingles, in their order."""
    # The array of one element binds the characters, so that they are made once.
    each = F.transform(F.array(_points(line)), lambda p: F.transform(F.sequence(F.lit(1), _last(p), F.lit(4)), lambda i: _shingle(p, i)))
    return F.get(each, F.lit(0))


def measured(lines: DataFrame) -> DataFrame:
    """``lines`` (lid, line) with n (distinct shingles), b0, b1 .. (a bitmap of them) and ones (its set bits)."""
    runs, names = _exploded(lines)

    def word(w):
        bits = [F.when(F.shiftright(h, 6).bitwiseAND(F.lit(WORDS - 1)) == w,
                       F.call_function("shiftleft", F.lit(1).cast("long"), F.col(h).bitwiseAND(F.lit(63)).cast("int")))
                .otherwise(F.lit(0).cast("long")) for h in names]
        return F.bit_or(functools.reduce(Column.bitwiseOR, bits)).alias(f"b{w}")

    maps = runs.groupBy("lid").agg(*[word(w) for w in range(WORDS)])
    ones = sum((F.bit_count(f"b{w}") for w in range(WORDS)), F.lit(0))
    return lines.join(maps.select("*", ones.alias("ones")), "lid").select(
        "lid", "line", F.size(F.array_distinct(shingles(F.col("line")))).alias("n"), "ones", *_SKETCH[2:])


def places(docs: DataFrame) -> DataFrame:
    """(doc_id, th, _key, pos, line, lid, proof): every line that is not blank."""
    return (docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("th"), document_key().alias("_key"),
                                                  F.posexplode(F.split("text", "\n")).alias("pos", "line"))
            .where(F.col("line").rlike(r"\S")).select("*", F.xxhash64("line").alias("lid"), F.xxhash64(F.lit(1), "line").alias("proof")))


def told_apart(found: DataFrame, clash: DataFrame) -> DataFrame:
    """``found`` with a lid of its own for each (lid, proof) of ``clash`` (_lid, least): lids that different lines share."""
    other = F.col("least").isNotNull() & (F.col("proof") > F.col("least"))
    return found.join(clash, F.col("lid") == F.col("_lid"), "left").withColumn(
        "lid", F.when(other, F.xxhash64("lid", "proof")).otherwise(F.col("lid"))).select(found.columns)


def distinct_lines(found: DataFrame) -> DataFrame:
    """(lid, line, first, n, least, most): each line once, with its first place, its places, and its smallest and largest proof."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "pos")
    lines = found.groupBy("lid").agg(F.first("line").alias("line"), F.min(place).alias("first"), F.count("*").alias("n"),
                                     F.min("proof").alias("least"), F.max("proof").alias("most"))
    # In buckets of the key: later joins on it move only the other side.
    return written(lines, "lines-distinct", bucket="lid")


def _may_be_alike(x: dict, y: dict, similarity: float) -> Column:
    """False only for lines that can't be alike, by their sizes and bitmaps (the columns of _SKETCH)."""
    sizes = F.least(x["n"], y["n"]) >= similarity * F.greatest(x["n"], y["n"]) - 1e-9
    common = sum((F.bit_count(x[b].bitwiseAND(y[b])) for b in _SKETCH[2:]), F.lit(0))
    # Shingles that share a bit with another of their line may be common without adding to the common bits.
    most = common + F.least(x["n"] - x["ones"], y["n"] - y["ones"])
    return sizes & _enough(most, x, y, similarity)


def _enough(both: Column, x: dict, y: dict, similarity: float) -> Column:
    """Whether so many common shingles make the lines alike: both / (n + n - both) >= similarity."""
    return both * (1 + similarity) >= similarity * (x["n"] + y["n"]) - 1e-9


def _with_first(members: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(u, v): the links between the members of buckets (band, lid) and their smallest lines."""
    # Grouped by a struct of the key, as above.
    low = members.groupBy(F.struct("band").alias("k")).agg(F.min("lid").alias("low")).select(F.col("k.band").alias("band"), "low")
    pairs = members.join(low, "band").where("lid <> low").select(F.col("lid").alias("u"), F.col("low").alias("v")).distinct()
    for k in "uv":
        pairs = pairs.join(texts.select(F.col("lid").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in _SKETCH]), k)
    x, y = ({c: F.col(f"{c}_{k}") for c in _SKETCH} for k in "uv")
    pairs = pairs.where(_may_be_alike(x, y, similarity)).select("u", "v", "n_u", "n_v")
    # Only the lines that the bitmaps leave meet with their texts.
    for k in "uv":
        pairs = pairs.join(texts.select(F.col("lid").alias(k), F.col("line").alias(f"line_{k}")), k)
    both = F.size(F.array_intersect(shingles(F.col("line_u")), shingles(F.col("line_v"))))
    return pairs.where(_enough(both, x, y, similarity)).select("u", "v")


def _between(members: DataFrame, signed: DataFrame, texts: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """(u, v): roots of components that a verified link joins, among all pairs that share a band.

    ``groups`` (node, root) has the components so far; a line that is in
    none is its own root.
    """
    with step(members.sparkSession) as keep:
        found = written(members.join(groups, F.col("lid") == F.col("node"), "left").join(texts.select("lid", "n"), "lid")
                        .select("band", "lid", F.coalesce("root", "lid").alias("root"), "n"), "lines-rooted")
        # Grouped by structs of the keys, so that the join back has an exchange of its own and AQE can split a large bucket.
        parts = found.groupBy(F.struct("band", "root").alias("k")).agg(F.count("*").alias("m"), F.sum("n").alias("chars"))
        blocks = lambda m, chars: F.ceil(F.greatest(m / BLOCK, chars / BLOCK_CHARS)).cast("int")
        wide = (parts.groupBy(F.struct("k.band").alias("b"))
                .agg(F.max(F.struct("m", "chars", "k.root")).alias("main"), F.sum("m").alias("m"), F.sum("chars").alias("chars"))
                .where("m > main.m")
                .select(F.col("b.band").alias("band"), F.col("main.root").alias("main"), blocks(F.col("main.m"), F.col("main.chars")).alias("nm"),
                        blocks(F.col("m") - F.col("main.m"), F.col("chars") - F.col("main.chars")).alias("nr")))
        h = F.xxhash64("lid", F.lit(1))
        dealt = written(found.join(wide, "band").select(
            "band", "lid", "root", "nm", "nr", (F.col("root") == F.col("main")).alias("in_main"),
            F.when(F.col("root") == F.col("main"), F.col("nr") + F.pmod(h, "nm")).otherwise(F.pmod(h, "nr")).cast("int").alias("block")),
            "lines-open")
        # Blocks 0 to nr - 1 are the rest's, nr to nr + nm - 1 the main component's.
        other = F.when(F.col("in_main"), F.expr("sequence(0, nr - 1)")).otherwise(F.expr("sequence(0, nr + nm - 1)"))
        # A pair is compared in the first band that it shares: that none before this one is shared.
        before = F.slice("bands", F.lit(1), (F.array_position("bands", F.col("band")) - 1).cast("int"))
        tasks = (dealt.join(signed, "lid").join(texts, "lid").select("*", before.alias("before"), F.explode(other).alias("x"))
                 .groupBy("band", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"))
                 .agg(F.collect_list(F.struct("block", "lid", "root", "before", "line", *_SKETCH)).alias("m")))

        def candidates(x, y):
            return ((x["root"] != y["root"]) & ((F.col("i") < F.col("j")) | (x["lid"] < y["lid"]))
                    & ~F.arrays_overlap(x["before"], y["before"]) & _may_be_alike(x, y, similarity))

        def side(block):
            return F.filter("m", lambda x: x["block"] == F.col(block))

        # near: for each line of a the places in b of those that it may be like; only lines of such pairs get their shingles.
        sides = tasks.select("i", "j", side("i").alias("a"), side("j").alias("b"))
        sides = sides.select("a", "b", F.transform("a", lambda x: F.filter(
            F.transform("b", lambda y, k: F.when(candidates(x, y), k)), lambda k: k.isNotNull())).alias("near"))
        of_a = F.zip_with("a", "near", lambda x, k: F.struct(
            x["root"].alias("root"), x["n"].alias("n"), F.when(F.size(k) > 0, shingles(x["line"])).alias("s"), k.alias("near")))
        # The array of one element binds the places, so that they are gathered once.
        of_b = F.get(F.transform(F.array(F.array_distinct(F.flatten("near"))), lambda met: F.transform("b", lambda y, k: F.struct(
            y["root"].alias("root"), y["n"].alias("n"), F.when(F.array_contains(met, k), shingles(y["line"])).alias("s")))), F.lit(0))

        def alike(x, y):
            return _enough(F.size(F.array_intersect(x["s"], y["s"])), x, y, similarity)

        def joined(x, y):
            return F.struct(F.least(x["root"], y["root"]).alias("u"), F.greatest(x["root"], y["root"]).alias("v"))

        links = F.transform("a", lambda x: F.transform(F.filter(x["near"], lambda k: alike(x, F.get("b", k))), lambda k: joined(x, F.get("b", k))))
        out = sides.select(of_a.alias("a"), of_b.alias("b")).select(F.explode(F.array_distinct(F.flatten(links))).alias("p"))
        out = out.select("p.u", "p.v").distinct()
        return keep(written(out, "lines-between"))


def similar_lines(lines: DataFrame, similarity: float = SIMILARITY, read: Callable[[], None] = lambda: None) -> DataFrame:
    """(node, root) over ``lines`` (lid, line): components of near-duplicate lines; lines without any are absent.

    ``read`` is called when the lines are not needed any more.
    """
    with step(lines.sparkSession) as keep:
        signed = written(banded_lines(lines), "lines-bands")
        banded = signed.select("lid", F.explode("bands").alias("band"))
        # Grouped by a struct of the key, so that the join back has an exchange of its own and AQE can split a large bucket.
        shared = banded.groupBy(F.struct("band").alias("k")).agg(F.count("*").alias("m")).where("m > 1").select(F.col("k.band").alias("band"))
        members = written(banded.join(shared, "band").select("band", "lid"), "lines-members")
        open_ = written(lines.join(members.select("lid").distinct(), "lid", "left_semi").select("lid", "line"), "lines-shared", bucket="lid")
        read()
        texts = written(measured(open_), "lines-texts")
        discard(open_)
        free_shuffles(lines.sparkSession)
        groups = components(written(_with_first(members, texts, similarity), "lines-links"), "lines-groups")
        more = _between(members, signed, texts, groups, similarity)
        if not more.isEmpty():
            groups = components(groups.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more), "lines-groups")
        return keep(written(groups, "lines-similar"))


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one line of each group of equal or similar lines; adds _lines and _gone (counts).

    Documents that lose all their lines are still here, with a null text;
    ``without_repeats`` drops them.
    """
    found = places(docs)
    with step(docs.sparkSession) as keep:
        lines = distinct_lines(found)
        clash = written(lines.where("least < most").select(F.col("lid").alias("_lid"), "least"), "lines-clashes")
        if not clash.isEmpty():
            found = told_apart(found, keep(clash))
            discard(lines)
            lines = distinct_lines(found)
        # The texts of the lines are dropped once they have been read.
        whole, spots = lines, written(lines.select("lid", "first", "n"), "lines-spots", bucket="lid")
        free_shuffles(docs.sparkSession)
        groups = similar_lines(whole.select("lid", "line"), similarity, lambda: discard(whole))
        grouped = spots.join(groups, spots["lid"] == groups["node"]).select("lid", "root", "first")
        # Grouped by a struct of the key, so that the join back has an exchange of its own and AQE can split a large group.
        best = grouped.groupBy(F.struct("root").alias("k")).agg(F.min("first").alias("keep")).select(F.col("k.root").alias("root"), "keep")
        fuzzy = grouped.join(best, "root").select("lid", "keep")
        repeated = spots.where("n > 1").join(fuzzy.select("lid"), "lid", "left_anti").select("lid", F.col("first").alias("keep"))
        decided = keep(written(fuzzy.union(repeated), "lines-decided"))
    here = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "pos")
    gone = (found.select("lid", here.alias("here"), "_key", "pos").join(decided, "lid").where("here <> keep")
            .groupBy(F.struct("_key").alias("k")).agg(F.collect_set("pos").alias("_pos")).select(F.col("k._key").alias("_key"), "_pos"))
    joined = docs.withColumn("_key", document_key()).join(gone, "_key", "left")
    parts = F.split("text", "\n")
    kept = F.filter(F.transform(parts, lambda x, i: F.when(~F.array_contains("_pos", i), x)), lambda x: x.isNotNull())
    full = F.size(F.filter(parts, lambda x: x.rlike(r"\S")))
    cut = F.when(F.size("_pos") < full, F.array_join(kept, "\n"))
    return (joined.withColumn("_lines", F.coalesce(full, F.lit(0))).withColumn("_gone", F.coalesce(F.size("_pos"), F.lit(0)))
            .withColumn("text", F.when(F.col("_pos").isNull(), F.col("text")).otherwise(cut))
            .select(*docs.columns, "_lines", "_gone", "_key"))


def without_repeats(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with their repeated lines cut out; documents left without any line are dropped."""
    found = dedup_lines(docs, similarity).where((F.col("_lines") == 0) | (F.col("_gone") < F.col("_lines")))
    return found.dropDuplicates(["_key"]).select(docs.columns)


def op3(spark, sf_dir):
    """All lines of all ``documents``: per document its lines, how many went, and the text that stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", F.col("_lines").alias("n_lines"), F.col("_gone").alias("n_removed"), "text")
