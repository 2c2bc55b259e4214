"""Collocations of two or three words by weighted acyclic automata of n-gram counts.

1. Shards: a task reads whole texts until it has about ``TOKENS`` words and
   writes them as a sequence of places in its sorted alphabet.  Pieces of a
   text are kept apart by breaks, and a text longer than a shard goes on in
   the next one with its last two words as context.  Words are 64-bit codes
   of (language, word), so one automaton serves all languages.
2. Union, level by level (one word, two, three): each shard's sorted n-grams
   make a count automaton, which is cut into prefix ranges; a task unites a
   range's pieces, summing weights.  The bounds are quantiles of n-grams
   shown by the shards and only balance the work: a prefix that holds a
   third of all n-grams spans several ranges.  Paths below ``MIN`` are left
   out after the union, and each shard is told which of its n-grams stayed;
   at the next level it counts only n-grams all of whose parts did (a phrase
   occurs no more often than its parts), so nothing is lost.  A word that
   stayed is from then on known by its path's number, as dense numbers pack
   better than codes.
3. Composition: the automata of all levels are united by prefix range.  A
   range asks the ranges of its phrases' parts, by an automaton of the
   parts; there it is composed with the counts.  A part asked for by many is
   asked once a range.  The parts' automaton carries the largest count of
   the longer phrase that asks, so a phrase that a longer one covers is
   found in the same step.
4. Scores are exact (Python integers), and the first ``TOP`` phrases of each
   language are ranked from the best of its shares.  The words of all found
   phrases are looked up in the shards; if two words share a code there, all
   is done again with another salt.

Defined results: a null text is empty, a null language ``und``; a phrase
cut in several ways is scored by its lowest cut, the shortest first part in
ties; repeated rows count again; an empty table has no phrases; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeward.llm.automata import Automaton, N
from lakeward.llm.common import first_of_each, python_batches, step, table, written
from lakeward.session import discard

MIN = 10
COVER = 50
TOP = 2000
TOKENS = 500_000
#: Bytes of a text that are split into words at once.
SLICE = 1 << 19
#: n-grams of a prefix range, before equal ones of several shards are united.
RANGE = 750_000
#: n-grams that a shard shows for the ranges' bounds, and about how many shards are looked at.
SHOWN, SHARDS = 64, 1024

#: Fixed by the contract: pieces end at .,;:!? and \x0A-\x0D; words at spaces and tabs.  Pieces end in "\n" here.
_BREAKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")


def words_of(text: bytes) -> list[bytes]:
    """The words, with A-Z lower-cased; "\\n" between pieces, and empty words where spaces meet."""
    return text.lower().translate(_BREAKS).replace(b"\n", b" \n ").split(b" ")


def slices(text: bytes, size: int = SLICE) -> Iterator[bytes]:
    """A text in parts of about ``size``, cut at spaces."""
    start = 0
    while len(text) - start > size:
        cut = text.rfind(b" ", start, start + size) + 1 or text.find(b" ", start + size) + 1
        if cut <= start:
            break
        yield text[start:cut]
        start = cut
    yield text[start:] if start else text


class Shard:
    """Words of many texts, as places in the order of their first occurrence; 0 is a break."""

    def __init__(self, salt: int):
        self.salt = salt
        self.places: dict[str, dict[bytes, int]] = {}
        self.words: list[tuple[str, bytes]] = [("", b"")]
        self.parts: list[np.ndarray] = []
        self.size = self.skip = 0
        self.counts: dict[str, int] = {}

    def _of(self, lang: str) -> dict[bytes, int]:
        words = self.words

        class Places(dict):
            def __missing__(self, word):
                self[word] = len(words)
                words.append((lang, word))
                return self[word]

        return self.places.setdefault(lang, Places({b"": -1, b"\n": 0}))

    def begin(self, lang: str, context: list[bytes]) -> None:
        """Go on in the middle of a text: the context's words are not counted again."""
        self.parts.append(np.array([self._of(lang)[w] for w in context], np.int32))
        self.size = self.skip = len(context)

    def add(self, lang: str, text: bytes) -> None:
        places = self._of(lang)
        found = words_of(text)
        ids = np.fromiter(map(places.__getitem__, found), np.int32, len(found))
        ids = ids[ids >= 0]
        self.parts.append(ids)
        self.size += len(ids)
        self.counts[lang] = self.counts.get(lang, 0) + int(np.count_nonzero(ids))

    def end_text(self) -> None:
        self.parts.append(np.zeros(1, np.int32))

    def context(self) -> list[bytes]:
        """The last two words of the piece that is open."""
        tail: list[int] = []
        for part in reversed(self.parts):
            tail = part[-2:].tolist() + tail
            if len(tail) >= 2:
                break
        tail = tail[-2:]
        if 0 in tail:
            tail = tail[len(tail) - tail[::-1].index(0):]
        return [self.words[k][1] for k in tail]

    def row(self) -> dict:
        codes = np.array([0] + [_code(lang, word, self.salt) for lang, word in self.words[1:]], np.uint64)
        # Codes that meet are one place here; the check of the found words sees them.
        alphabet, place = np.unique(codes, return_inverse=True)
        sequence = place[np.concatenate([p for p in self.parts if len(p)] or [np.zeros(0, np.int32)])]
        return {"sequence": _packed(sequence.astype("<u4")), "alphabet": _packed(alphabet), "skip": self.skip,
                "counts": self.counts, "words": _said(self.words[1:], codes[1:])}


def _said(words: list[tuple[str, bytes]], codes: np.ndarray) -> bytes:
    """The words with their codes and languages, packed."""
    batch = pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array([x for x, _ in words], pa.string()),
                                        pa.array([w for _, w in words], pa.binary()).cast(pa.string())], ["code", "lang", "word"])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def _packed(a: np.ndarray) -> bytes:
    return (a.nbytes).to_bytes(8, "little") + pa.compress(a.tobytes(), codec="zstd", asbytes=True)


def _loose(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), kind)


_codes: dict[tuple[str, bytes, int], int] = {}


def _code(lang: str, word: bytes, salt: int) -> int:
    """64 bits of a word of a language; 0 is kept for no word."""
    key = (lang, word, salt)
    code = _codes.get(key)
    if code is None:
        head = f"{salt}|{lang}|".encode("utf-8", "replace")
        code = int.from_bytes(blake2b(head + word, digest_size=8).digest(), "little") or 1
        if len(word) <= 64:
            if len(_codes) > 50_000:
                _codes.clear()
            _codes[key] = code
    return code


_SHARD = ("shard long, sequence binary, alphabet binary, skip int, langs array<string>, counts array<long>, "
          "words binary")


def shards(docs: DataFrame, salt: int = 0, tokens: int = TOKENS, size: int = SLICE) -> DataFrame:
    """The words of all texts of ``docs`` (text, lang): one row for about ``tokens`` words of a task."""
    python_batches(docs.sparkSession)

    def batch_of(number: int, row: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([(TaskContext.get().partitionId() << 32) + number], pa.int64()), pa.array([row["sequence"]], pa.binary()),
             pa.array([row["alphabet"]], pa.binary()), pa.array([row["skip"]], pa.int32()),
             pa.array([list(row["counts"])], pa.list_(pa.string())), pa.array([list(row["counts"].values())], pa.list_(pa.int64())),
             pa.array([row["words"]], pa.binary())],
            ["shard", "sequence", "alphabet", "skip", "langs", "counts", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = Shard(salt), 0
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                lang = lang.as_py()
                for part in slices(text.as_py(), size):
                    shard.add(lang, part)
                    if shard.size >= tokens:
                        context = shard.context()
                        yield batch_of(number, shard.row())
                        shard, number = Shard(salt), number + 1
                        shard.begin(lang, context)
                shard.end_text()
        if shard.counts:
            yield batch_of(number, shard.row())

    return docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"),
                       F.coalesce("lang", F.lit("und")).alias("lang")).mapInArrow(run, _SHARD)


def bounds(shards_: DataFrame, per_range: int = RANGE) -> np.ndarray:
    """Sorted n-grams that cut all n-grams of the automata (n_grams, shown) into about equal prefix ranges."""
    total, n = shards_.agg(F.sum("n_grams"), F.count("*")).first()
    ranges = math.ceil((total or 0) / per_range)
    if ranges < 2:
        return np.zeros((0, 3), np.uint64)
    share = min(1.0, SHARDS / n)
    shown = shards_.select("n_grams", "shown").where(F.pmod(F.xxhash64("shown"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    grams, weights = [], []
    for count, data in shown.collect():
        g = np.frombuffer(data, np.uint64).reshape(-1, 3)
        grams.append(g)
        weights.append(np.full(len(g), count / max(1, len(g))))
    if not grams:
        return np.zeros((0, 3), np.uint64)
    g, w = np.concatenate(grams), np.concatenate(weights)
    order = np.lexsort(g.T[::-1])
    g, w = g[order], np.cumsum(w[order])
    at = np.searchsorted(w, w[-1] * np.arange(1, ranges) / ranges)
    return np.unique(g[np.minimum(at, len(g) - 1)], axis=0)


def _by_range(rows: DataFrame, key: str, then: list[str], close, schema: str) -> DataFrame:
    """``close(range, iterator of its rows)`` for every range, its rows in the order of ``then``; it yields result rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        rows, ahead = flat(), None
        ahead = next(rows, None)
        while ahead is not None:
            number = ahead[0]

            def mine():
                nonlocal ahead
                while ahead is not None and ahead[0] == number:
                    row, ahead = ahead, next(rows, None)
                    yield row

            for out in close(number, mine()):
                yield _batch(out, schema)

    return rows.repartition(key).sortWithinPartitions(key, *then).mapInArrow(run, schema)


def level(rows: DataFrame, length: int, stayed: DataFrame | None, least: int, per_range: int) -> DataFrame:
    """The n-grams of one length that occur at least ``least`` times, united by prefix range.

    Rows (shard, length, blob, n_grams, shown, codes, number): a range's
    automaton over the numbers of words (shard is null; for length 1 also the
    words' codes and the first one's number), and for every shard the paths of its own that are in it, for
    length 1 over codes and with the words' numbers as weights.  ``stayed``
    has such paths (shard, length, blob) of the levels before.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, sequence, alphabet, skip, known in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sequence, alphabet, pairs = _loose(sequence, "<u4"), _loose(alphabet, "<u8"), None
                if length > 1:
                    words, pairs = (Automaton.union([Automaton.from_bytes(k["blob"]) for k in known if k["length"] == n]) for n in (1, 2))
                    place = np.zeros(len(alphabet), np.int64)
                    place[np.searchsorted(alphabet, words.grams[:, 0])] = np.arange(1, len(words) + 1)
                    sequence, alphabet = place[sequence], np.append(np.uint64(0), words.weights.astype(np.uint64))
                    pairs = pairs.grams
                grams = Automaton.count(sequence, alphabet, length, skip, pairs)
                if len(grams):
                    yield _batch([(shard, *_columns(grams))], _COUNTS)

    rows = rows.select("shard", "sequence", "alphabet", "skip")
    if stayed is None:
        rows = rows.withColumn("known", F.expr("array()").cast("array<struct<length:int,blob:binary>>"))
    else:
        known = stayed.groupBy(F.col("shard").alias("_s")).agg(F.collect_list(F.struct("length", "blob")).alias("known"))
        rows = rows.join(known, F.col("shard") == F.col("_s")).drop("_s")
    counted = written(rows.mapInArrow(count, _COUNTS), f"phrases-counts-{length}")
    splits = bounds(counted, per_range)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pieces = _pieces(Automaton.from_bytes(blob), splits)
                yield pa.RecordBatch.from_arrays([pieces.column(0), pa.array([shard] * len(pieces), pa.int64()), pieces.column(1)],
                                                 ["range", "shard", "blob"])

    def close(number, rows):
        kept: list[tuple[int, bytes]] = []

        def blobs():
            for _, shard, blob in rows:
                kept.append((shard, blob))
                yield blob

        whole = _sum(blobs(), least)
        if not len(whole):
            return
        codes, out = None, whole
        if length == 1:
            codes = whole.grams[:, 0]
            numbers = (number << 32) + 1 + np.arange(len(whole), dtype=np.int64)
            out = Automaton(np.append(np.uint64(0), numbers.astype(np.uint64)), np.zeros((len(whole), N), np.int32), whole.weights)
            out.ids[:, 0] = np.arange(1, len(whole) + 1)
            whole = Automaton(whole.alphabet, whole.ids, numbers)
        yield [(None, length, *_columns(out), None if codes is None else codes.astype(np.int64).tolist(), (number << 32) + 1)]
        if length == N:
            return
        for shard, blob in kept:
            part = Automaton.from_bytes(blob)
            weights = whole.weights_of(part)
            part = Automaton(part.alphabet, part.ids, weights).take(weights > 0)
            if len(part):
                yield [(shard, length, part.to_bytes(), len(part), None, None, None)]

    pieces = counted.select("shard", "blob").mapInArrow(cut, "range int, shard long, blob binary")
    out = written(_by_range(pieces, "range", [], close, _LEVEL), f"phrases-level-{length}")
    discard(counted)
    return out


_COUNTS = "shard long, blob binary, n_grams long, shown binary"
_LEVEL = "shard long, length int, blob binary, n_grams long, shown binary, codes array<long>, number long"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _columns(a: Automaton) -> tuple[bytes, int, bytes]:
    return a.to_bytes(), len(a), a.grams[:: max(1, len(a) // SHOWN)].tobytes()


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, types = zip(*(c.split(" ") for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(names))


def _sum(blobs: Iterator[bytes], least: int) -> Automaton:
    """The union of automata, of the paths that weigh ``least`` in all; they are taken in as they come."""
    whole, more, size = Automaton.empty(), [], 0
    for blob in blobs:
        more.append(Automaton.from_bytes(blob))
        size += len(more[-1])
        if size > max(RANGE // 4, len(whole)):
            whole, more, size = Automaton.union([whole, *more]), [], 0
    whole = Automaton.union([whole, *more])
    return whole.take(whole.weights >= least)


def united(rows: DataFrame, splits: np.ndarray) -> DataFrame:
    """(range, blob): the automaton of each prefix range, of all automata of ``rows`` (blob)."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                yield _pieces(Automaton.from_bytes(blob), splits)

    def close(number, rows):
        yield [(number, _sum((blob for _, blob in rows), 1).to_bytes())]

    pieces = rows.select("blob").mapInArrow(cut, "range int, blob binary")
    return _by_range(pieces, "range", [], close, "range int, blob binary")


def _pieces(grams: Automaton, splits: np.ndarray) -> pa.RecordBatch:
    at = grams.cuts(splits)
    out = [(r, grams.take(slice(at[r], at[r + 1])).to_bytes()) for r in range(len(at) - 1) if at[r] < at[r + 1]]
    return pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())],
                                      ["range", "blob"])


def _parts(grams: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(which phrases, first part, rest) for each way to cut the phrases of two or three words, shortest first part first."""
    none = np.zeros(len(grams), np.uint64)
    every, three = np.arange(len(grams)), np.flatnonzero(grams[:, 2])
    one = np.stack([grams[:, 0], none, none], axis=1)
    rest = np.stack([grams[:, 1], grams[:, 2], none], axis=1)
    two = np.stack([grams[:, 0], grams[:, 1], none], axis=1)[three]
    last = np.stack([grams[:, 2], none, none], axis=1)[three]
    return [(every, one, rest), (three, two, last)]


def scored(ranges: DataFrame, splits: np.ndarray, cover: int = COVER) -> DataFrame:
    """(c1, c2, c3, a, l, r, score) of all phrases that no longer one covers; c3 is 0 for two words."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                phrases = Automaton.from_bytes(blob)
                phrases = phrases.take(phrases.ids[:, 1] > 0)
                grams = phrases.grams
                parts, longer = [np.zeros((0, 3), np.uint64)], [np.zeros(0, np.int64)]
                for which, first, rest in _parts(grams):
                    parts += [first, rest]
                    longer += [phrases.weights[which]] * 2
                asked = Automaton.build(np.concatenate(parts), np.concatenate(longer), np.maximum)
                pieces = _pieces(asked, splits)
                yield pa.RecordBatch.from_arrays([pieces.column(0), pa.array([number] * len(pieces), pa.int32()), pieces.column(1)],
                                                 ["range", "whence", "blob"])

    def answer(number, rows):
        own, covered = Automaton.empty(), []
        for _, whence, blob in rows:
            other = Automaton.from_bytes(blob)
            if whence < 0:
                own = other
                continue
            counts = own.weights_of(other)
            lies = (other.ids[:, 1] > 0) & (100 * other.weights >= cover * counts)
            if lies.any():
                covered.append(other.take(lies))
            yield [(whence, 1, Automaton(other.alphabet, other.ids, counts).to_bytes())]
        if covered:
            yield [(number, 2, Automaton.union(covered, np.maximum).to_bytes())]

    def close(number, rows):
        own, answers, covered = Automaton.empty(), [], Automaton.empty()
        for _, kind, blob in rows:
            other = Automaton.from_bytes(blob)
            if kind == 0:
                own = other
            elif kind == 1:
                answers.append(other)
            else:
                covered = other
        counts = Automaton.union(answers)
        phrases = own.take(own.ids[:, 1] > 0)
        grams = phrases.grams
        phrases = phrases.take(covered.compose(grams) == 0)
        grams, best = phrases.grams, {}
        for which, first, rest in _parts(grams):
            for k, a, l, r in zip(which.tolist(), phrases.weights[which].tolist(), counts.compose(first).tolist(),  # noqa: E741
                                  counts.compose(rest).tolist(), strict=True):
                score = 1_000_000 * a * a // (l * r)
                if k not in best or score < best[k][3]:
                    best[k] = (a, l, r, score)
        codes = grams.astype(np.int64).tolist()
        if best:
            yield [(*codes[k], *best[k]) for k in range(len(codes))]

    asked = ranges.select("range", "blob").mapInArrow(ask, "range int, whence int, blob binary")
    asked = ranges.select("range", F.lit(-1).alias("whence"), "blob").union(asked)
    answered = _by_range(asked, "range", ["whence"], answer, "range int, kind int, blob binary")
    answered = ranges.select("range", F.lit(0).alias("kind"), "blob").union(answered)
    return _by_range(answered, "range", ["kind"], close, "c1 long, c2 long, c3 long, a long, l long, r long, score long")


def _words_of(rows: DataFrame, first: DataFrame, found: DataFrame) -> DataFrame:
    """(number, w, other) of all words of the phrases: the smallest and the largest (lang, word) of a word's code."""
    used = found.select(F.explode(F.array("c1", "c2", "c3")).alias("number")).distinct()
    codes = first.where("shard is null").select(F.posexplode("codes").alias("k", "code"), "number").select(
        (F.col("number") + F.col("k")).alias("number"), "code").join(used, "number", "left_semi")
    word = F.struct("lang", "word")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in batch.column(0):
                whole = pa.ipc.open_stream(words.as_buffer()).read_next_batch()
                for k in range(0, len(whole), 10_000):
                    yield whole.slice(k, 10_000)

    said = rows.select("words").mapInArrow(spell, "code long, lang string, word string")
    return (said.join(codes, "code").groupBy("number").agg(F.min(word).alias("w"), F.max(word).alias("other")))


def collocations(docs: DataFrame, top: int = TOP, least: int = MIN, cover: int = COVER, tokens: int = TOKENS,
                 per_range: int = RANGE, size: int = SLICE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases."""
    salt = 0
    with step(docs.sparkSession) as keep:
        while True:
            # In buckets of the shard: the joins with what stayed move only that.
            rows = written(shards(docs, salt, tokens, size), "phrases-shards", bucket="shard")
            levels: list[DataFrame] = []
            for length in range(1, N + 1):
                stayed = [x.where("shard is not null").select("shard", "length", "blob") for x in levels]
                levels.append(level(rows, length, reduce(DataFrame.union, stayed) if stayed else None, least, per_range))
            heavy = reduce(DataFrame.union, [x.where("shard is null") for x in levels])
            splits = bounds(heavy, per_range)
            ranges = written(united(heavy, splits), "phrases-ranges")
            found = written(scored(ranges, splits, cover), "phrases-scored")
            words = written(_words_of(rows, levels[0], found), "phrases-words")
            if words.where("w <> other").isEmpty():
                break
            salt += 1
        keep(found), keep(words)
        totals = keep(written(rows.select(F.explode(F.arrays_zip("langs", "counts")).alias("e")).groupBy(
            F.col("e.langs").alias("lang")).agg(F.sum("e.counts").alias("n")), "phrases-totals"))
    words = words.select("number", "w.lang", "w.word")
    for k in (1, 2, 3):
        theirs = words.select(F.col("number").alias("_c"), F.col("word").alias(f"w{k}"), *(["lang"] if k == 1 else []))
        found = found.join(theirs, F.col(f"c{k}") == F.col("_c"), "left").drop("_c")
    found = found.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "l", "r", "score",
                         (-F.col("score")).alias("by_score"), (-F.col("a")).alias("by_a"))
    order = ["by_score", "by_a", "phrase"]
    best = first_of_each(found, "lang", order, top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11(spark, sf_dir):
    """The first 2,000 collocations of each language of all ``documents``."""
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH piece AS (
  SELECT row_number() OVER () AS k, lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[.,;:!?\x0A-\x0D]')) AS p
        FROM documents)),
gram AS (
  SELECT lang, d, array_to_string(w[i:i + d - 1], ' ') AS g, count(*) AS f
  FROM (SELECT lang, w, d, unnest(range(1, len(w) - d + 2)) AS i FROM piece, (SELECT unnest([1, 2, 3]) AS d) WHERE len(w) >= d)
  GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM gram WHERE d = 1 GROUP BY lang),
cand AS (SELECT lang, d, g, f AS a, string_split(g, ' ') AS w FROM gram WHERE d > 1 AND f >= 10),
part AS (
  SELECT c.*, k, array_to_string(w[1:k], ' ') AS first_, array_to_string(w[k + 1:d], ' ') AS rest
  FROM (SELECT *, unnest(range(1, d)) AS k FROM cand) c),
scored AS (
  SELECT p.lang, p.d, p.g, p.a, k, x.f AS l, y.f AS r,
         CAST(CAST(1000000 AS HUGEINT) * p.a * p.a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM part p JOIN gram x ON x.lang = p.lang AND x.g = first_ AND x.d = k JOIN gram y ON y.lang = p.lang AND y.g = rest AND y.d = p.d - k),
cut AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS nth FROM scored),
covered AS (
  SELECT DISTINCT s.lang, s.g
  FROM cand s JOIN (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS g FROM cand WHERE d = 3) b
       ON b.lang = s.lang AND b.g = s.g AND 100 * b.a >= 50 * s.a
  WHERE s.d = 2),
ranked AS (
  SELECT c.*, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, c.g) AS rank
  FROM cut c LEFT JOIN covered v ON v.lang = c.lang AND v.g = c.g WHERE nth = 1 AND v.g IS NULL)
SELECT lang, rank, g AS phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
