"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds spans.

Base spans come from the contract's patterns, leftmost and non-overlapping
per kind; matches that fail their check are dropped without another try.
The CRF is trained on ``LABELLED`` (a small fixed table of marked lines) by
gradient ascent on the exact log-likelihood, and decoded by Viterbi in numpy
over batches of lines.  Its tokens are runs of letters, runs of digits and
single signs; features are the shapes of the token and of two neighbours on
either side, nothing of the words themselves.  A CRF span counts if it
holds an @ (email) or as many digits as the kind has, and no letter or digit
touches it; so lines without an @ or a digit of any script cannot have one
and are not decoded.  CRF spans
that touch a base span are dropped.

Offsets are code points, end exclusive.  Defined results: a null or empty
text has no spans; repeated rows each get their row; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lakeward.llm.common import python_batches, table

KINDS = ("email", "ip", "card", "phone")

#: Fixed by the contract.  The lookbehinds only skip starts that no leftmost match can have; the possessive
#: forms match the same strings, as what follows them never starts with what they take.
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches: from each @, back over its local part, then the domain."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        found = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            free = found.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        x = int(ch) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


#: The training table, marked as {kind|span}.
LABELLED = """
call me at {phone|555-123-4567} today
my number is {phone|(212) 555-0188} thanks
reach us on {phone|020 7946 0958} or write
Tel. {phone|030 901820-11} office
phone: {phone|415.555.2671}
ring {phone|0171 555 8899} after six
fax {phone|(030) 5550-1234} please
mobile {phone|07700 900123}
and then {phone|555 867 5309} he said
the line {phone|800-555-0199} is open
tel {phone|(051) 555-0588} now
call {phone|1-800-555-0123} free
numero {phone|01 55 50 12 34} merci
write to {email|jane.doe @ mail.example.com} soon
write {email|jane @ example.org} now
mail {email|bob_1@ example.net} please
contact {email|info @example.com} for more
my mail is {email|peter99 @ mail.example.org} ok
pay with {card|4111/1111/1111/1111} now
card {card|5500.0000.0000.0004} valid
my card {card|3782_822463_10005} expired
number {card|4012.8888.8888.1881} on file
card no {card|6011/0009/9013/9424} here
from host {ip|10 . 0 . 0 . 12} seen
address {ip|192,168,1,20} blocked
server {ip|172.16.254 .1} down
the year 1998 was good
on 12.05.2021 we met
version 2.10.4 is out
pages 12-18 and 33
it cost 1,250.00 in 2019
room 404, floor 3
chapter 3.2.1 on page 17
about 100 people and 20 dogs
id 5927243074273351 in the log
key a9cd9723e1f4eafc27395915e6868 used
order 20210512-77 shipped
from 9:30 to 17:45
at 3.14159 or 2.71828
see section 12 (1999) again
between 1914-1918 and 1939-1945
score 3-2 or 10-0
it weighs 75 kg and 300 g
ISBN 978-3-16-148410-0 printed
the ratio was 1/2 or 3/4
the user @ the desk
license, Version 2.0.
a 16 digit number 4637089055456426 there
2353820953013749 4550997810720808 and so on
log 2023-01-15 10:22:33 error 500
token = "f231efbfd1fdb295f161be24c505140e"
64 bits, 128 bits, 256 bits
http://example.com/en/7817?page=2
7 days, 24 hours
""".strip().splitlines()

_TOKENS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
_DECIMAL = re.compile(r"[\d@]").search
_SIGNS = "@+-.()/:,_"
_LENGTHS = ("1", "2", "3", "4", "5", "6", "9", "z")
SHAPES = ["pad"] + [a + b for a in (
    [f"{c}{n}" for c in ("x", "X", "d") for n in _LENGTHS] + list(_SIGNS) + ["other"]) for b in ("", " ")]
_SHAPE = {s: k for k, s in enumerate(SHAPES)}
TAGS = ["O"] + [f"{p}-{k}" for k in KINDS for p in ("B", "I")]
REACH = 2
#: Tokens from which on a line is decoded alone, in pieces of as many.
LONG = 1 << 14


def shape(token: str, spaced: bool) -> int:
    """The token's word shape, and whether white space or the line's start stands before it."""
    first = token[0]
    if first.isalpha() or first.isdigit():
        kind = "d" if first.isdigit() else "X" if token[:1].isupper() else "x"
        n = len(token)
        name = kind + (_LENGTHS[n - 1] if n <= 6 else "9" if n <= 9 else "z")
    else:
        name = first if first in _SIGNS else "other"
    return _SHAPE[name + " " * spaced]


def tokens(line: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The starts, ends and shapes of a line's tokens (nine bytes a token, whatever the line's length)."""
    starts, ends, shapes = array("i"), array("i"), array("B")
    for m in _TOKENS.finditer(line):
        s = m.start()
        starts.append(s)
        ends.append(m.end())
        shapes.append(shape(m[0], s == 0 or line[s - 1].isspace()))
    return np.frombuffer(starts, np.int32), np.frombuffer(ends, np.int32), np.frombuffer(shapes, np.uint8)


class Crf:
    """Emissions from the shapes around a token (one table for each offset), transitions between tags."""

    def __init__(self):
        self.emit = np.zeros((2 * REACH + 1, len(SHAPES), len(TAGS)))
        self.move = np.zeros((len(TAGS), len(TAGS)))
        self.banned = np.zeros_like(self.move)
        for j, tag in enumerate(TAGS):
            if tag.startswith("I"):
                for i, before in enumerate(TAGS):
                    if before[1:] != tag[1:]:
                        self.banned[i, j] = -1e9
        self.start = np.array([-1e9 if t.startswith("I") else 0.0 for t in TAGS])

    def scores(self, shapes: np.ndarray) -> np.ndarray:
        """(..., length, tags) from (..., length) shapes, 0 beyond the ends."""
        wide = np.zeros((*shapes.shape[:-1], shapes.shape[-1] + 2 * REACH), np.int64)
        wide[..., REACH:REACH + shapes.shape[-1]] = shapes
        return sum(self.emit[k][wide[..., k:k + shapes.shape[-1]]] for k in range(2 * REACH + 1))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], steps: int = 150, rate: float = 0.3, l2: float = 0.01) -> Crf:
        """Adagrad on the log-likelihood; marginals by forward-backward."""
        sums = [np.full_like(self.emit, 1e-6), np.full_like(self.move, 1e-6)]
        for _ in range(steps):
            g_emit, g_move = -l2 * self.emit, -l2 * self.move
            move = self.move + self.banned
            for shapes, tags in rows:
                n = len(tags)
                s = self.scores(shapes)
                a, b = np.zeros_like(s), np.zeros_like(s)
                a[0] = s[0] + self.start
                for t in range(1, n):
                    a[t] = s[t] + np.logaddexp.reduce(a[t - 1][:, None] + move, axis=0)
                for t in range(n - 2, -1, -1):
                    b[t] = np.logaddexp.reduce(move + s[t + 1] + b[t + 1], axis=1)
                z = np.logaddexp.reduce(a[-1])
                gap = -np.exp(a + b - z)
                gap[np.arange(n), tags] += 1
                wide = np.pad(shapes, REACH)
                for k in range(2 * REACH + 1):
                    np.add.at(g_emit[k], wide[k:k + n], gap)
                for t in range(1, n):
                    g_move -= np.exp(a[t - 1][:, None] + move + s[t] + b[t] - z)
                np.add.at(g_move, (tags[:-1], tags[1:]), 1)
            for w, g, q in ((self.emit, g_emit, sums[0]), (self.move, g_move, sums[1])):
                q += g * g
                w += rate * g / np.sqrt(q)
        return self

    def decode(self, lines: list[np.ndarray]) -> list[np.ndarray]:
        """The best tags of each line (Viterbi), lines of like length together; very long ones alone."""
        out: list = [self.decode_long(x) if len(x) > LONG else None for x in lines]
        order = sorted((k for k in range(len(lines)) if out[k] is None), key=lambda k: len(lines[k]))
        move = self.move + self.banned
        k = 0
        while k < len(order):
            longest, pick = 0, []
            while k < len(order) and (not pick or (len(pick) + 1) * len(lines[order[k]]) <= 1 << 16):
                pick.append(order[k])
                longest = len(lines[order[k]])
                k += 1
            shapes = np.zeros((len(pick), longest), np.int64)
            size = np.array([len(lines[i]) for i in pick])
            for r, i in enumerate(pick):
                shapes[r, :size[r]] = lines[i]
            s = self.scores(shapes)
            back = np.zeros((longest, len(pick), len(TAGS)), np.int8)
            best = s[:, 0] + self.start
            final = best.copy()
            for t in range(1, longest):
                through = best[:, :, None] + move
                back[t] = through.argmax(axis=1)
                best = np.take_along_axis(through, back[t][:, None, :].astype(np.int64), axis=1)[:, 0] + s[:, t]
                final[size > t] = best[size > t]
            tag = final.argmax(axis=1)
            path = np.zeros((len(pick), longest), np.int64)
            for t in range(longest - 1, -1, -1):
                live = size > t
                path[live, t] = tag[live]
                if t:
                    tag = np.where(live, back[t][np.arange(len(pick)), tag], tag)
            for r, i in enumerate(pick):
                out[i] = path[r, :size[r]]
        return out


    def decode_long(self, shapes: np.ndarray) -> np.ndarray:
        """The best tags of one line: scores are made in pieces, and only a byte a tag and token stays."""
        move, tags = self.move + self.banned, len(TAGS)
        back, best, column = np.zeros((len(shapes), tags), np.int8), None, np.arange(tags)
        for k in range(0, len(shapes), LONG):
            left = max(0, k - REACH)
            part = self.scores(shapes[left:k + LONG + REACH].astype(np.int64))[k - left:][:LONG]
            for t, s in enumerate(part, k):
                if t == 0:
                    best = s + self.start
                    continue
                through = best[:, None] + move
                back[t] = came = through.argmax(axis=0)
                best = through[came, column] + s
        path = np.zeros(len(shapes), np.int8)
        tag = int(best.argmax())
        for t in range(len(shapes) - 1, -1, -1):
            path[t] = tag
            tag = back[t, tag]
        return path


def training_rows() -> list[tuple[np.ndarray, np.ndarray]]:
    rows = []
    for marked in LABELLED:
        text, spans = "", []
        for part in re.split(r"(\{\w+\|[^}]*\})", marked):
            m = re.fullmatch(r"\{(\w+)\|([^}]*)\}", part)
            if m:
                spans.append((len(text), len(text) + len(m[2]), m[1]))
            text += m[2] if m else part
        found = tokens(text)
        tags = []
        for s, e in zip(found[0].tolist(), found[1].tolist(), strict=True):
            own = next(((a, k) for a, b, k in spans if a <= s and e <= b), None)
            tags.append(TAGS.index(f"{'B' if own[0] == s else 'I'}-{own[1]}") if own else 0)
        rows.append((found[2].astype(np.int64), np.array(tags)))
    return rows


def _counts(kind: str, span: str) -> bool:
    digits = sum(c.isdigit() for c in span)
    if kind != "email" and any(c.isalpha() for c in span):
        return False
    return {"email": "@" in span and any(c.isalpha() for c in span), "ip": 4 <= digits <= 12,
            "card": 13 <= digits <= 19, "phone": 7 <= digits <= 15}[kind]


def crf_spans(crf: Crf, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """The CRF's spans of each text, decoded line by line in one batch."""
    out: list[list] = [[] for _ in texts]
    lines, places = [], []
    for k, text in enumerate(texts):
        at = 0
        for line in text.split("\n"):
            if _DECIMAL(line) or not line.isascii() and any(map(str.isdigit, set(line))):
                found = tokens(line)
                lines.append(found[2])
                places.append((k, at, found))
            at += len(line) + 1
    for tags, (k, at, (starts, ends, _)) in zip(crf.decode(lines), places, strict=True):
        for t in np.flatnonzero(tags % 2 == 1).tolist():
            # B tags are odd, each followed by its I tag.
            e = t + 1
            while e < len(tags) and tags[e] == tags[t] + 1:
                e += 1
            s, end, kind = at + int(starts[t]), at + int(ends[e - 1]), TAGS[tags[t]][2:]
            alone = not (texts[k][s - 1:s].isalnum() or texts[k][end:end + 1].isalnum())
            if alone and _counts(kind, texts[k][s:end]):
                out[k].append((kind, s, end))
    return out


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (base spans), spans (all spans), n_added of every row."""
    spark = docs.sparkSession
    python_batches(spark)
    shared = spark.sparkContext.broadcast(Crf().fit(training_rows()))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def listed(spans):
        return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = []
            for text, more in zip(texts, crf_spans(crf, texts), strict=True):
                base = base_spans(text)
                taken = sorted((s, e) for _, s, e in base)
                added = [x for x in more if not any(s < x[2] and x[1] < e for s, e in taken)] if more else []
                rows.append((*(sum(x[0] == k for x in base) for k in KINDS),
                             hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + added), len(added)))
            cols = list(zip(*rows, strict=True)) or [[] for _ in names[1:]]
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names)

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def op5(spark, sf_dir):
    """Personal data in every whole text of ``documents``."""
    return personal_data(table(spark, sf_dir, "documents"))
