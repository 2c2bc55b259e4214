"""Prefix trie, URL filters and collocations against brute force; nulls, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeward.llm import phrases, trie, urls
from lakeward.llm.automata import Automaton

# ---------------------------------------------------------------- trie ---

TURNS = "conv_id long, turn long, role string, text string, digest string, depth long, conv long"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, 8) for r in rows], TURNS)


def digest_of(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest_of(role or "", text or ""), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(x)] for c, x in own.items()}
    full = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = tuple(own.get(c - c % 5, [])[:h] + mine[h:])
    members = defaultdict(list)
    for c, s in full.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = Counter(s[:-1] for s in members if s)
    out = []
    for s, m in members.items():
        below = [v for v in members if v[:len(s)] == s]
        ends = sorted(c for c in m if full[c] == s)
        out.append((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), kids[s], sum(not kids[v] for v in below),
                    sum((len(members[v]) - 1) * len(v[-1][1].encode()) for v in below if v),
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("span,piece", [(1024, 4096), (3, 2)])
def test_trie_equals_brute_force(spark, monkeypatch, span, piece):
    monkeypatch.setattr(trie, "SPAN", span)
    monkeypatch.setattr(trie, "PIECE", piece)
    rng = random.Random(span)
    said = ["hi", "héllo", None, "", "x" * 50]
    rows = [(c, t, rng.choice(["user", "bot", None]) if rng.random() < .2 else "user", said[min(4, int(rng.expovariate(1)))])
            for c in range(80) for t in range(rng.choice([0, 1, 2, 5, 9, 14]))]
    rows += [(c, t, "user", "same") for c in range(200, 240) for t in range(4)]
    rows += [(301, None, "user", "a"), (301, None, "user", "a"), (301, 1, "bot", "b"), (301, 1, "bot", "a"), (301, -5, None, None),
             (None, 1, "user", "nobody"), (400, 7, "user", "only turn"), (2 ** 40, 1, "user", "far"), (rows[0][0], 99, "user", "same")]
    found = sorted(map(tuple, trie.prefix_trie(turns(spark, rows)).collect()), key=str)
    assert found == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert trie.prefix_trie(turns(spark, [(None, 1, "user", "x")]).limit(0)).collect() == []
    # The conversation's own turn is within its first h, and there is no base: only the root is left.
    c = next(k for k in range(1, 99) if k % 5 and zlib.crc32(str(k).encode()) % 9)
    (root,) = trie.prefix_trie(turns(spark, [(c, 0, "user", "x")])).collect()
    assert tuple(root) == (c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())


# ---------------------------------------------------------------- urls ---


def pages(spark, rows):
    return spark.createDataFrame([(*r, "<p>", "x", 1, 2.0) for r in rows],
                                 "page_id long, url string, html string, host string, label int, score double")


def test_rules(spark):
    rows = [(1, "http://a.example.net/en/1"), (2, "HTTP://Example.NET/en/x?q"), (3, "http://example.net/de"), (4, "http://x.org/fr/1"),
            (5, "http://x.org/fr"), (6, "http://example.com/de/#a"), (7, "http://anexample.com/de/"), (8, None), (9, ""), (10, "net/en"),
            (11, "http://net"), (12, "http://NET/"), (13, "http://b.example.net?/en/"), (14, "http://É.Net/x\ny://z"), (1, "http://a.example.net/en/1")]
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages(spark, rows)).collect()), key=str)
    known = {(i, h, p, rule, v) for i, h, p, rule, v in got if rule}
    assert known == {(1, "a.example.net", "/en/1", "example.net/en/", "allow"), (2, "example.net", "/en/x", "example.net/en/", "allow"),
                     (3, "example.net", "/de", "net/", "block"), (4, "x.org", "/fr/1", "org/fr/", "allow"),
                     (6, "example.com", "/de/", "example.com/de/", "block"), (12, "net", "/", "net/", "block"),
                     (14, "É.net", "/x\ny://z", "net/", "block")}
    rest = {i: (h, p) for i, h, p, rule, v in got if not rule}
    assert rest == {5: ("x.org", "/fr"), 7: ("anexample.com", "/de/"), 8: ("", ""), 9: ("", ""), 10: ("", ""), 11: ("net", ""),
                    13: ("b.example.net", "")}
    assert len(got) == len(rows) and {v for *_, v in got} <= {"allow", "block"}


def test_features_and_long_urls(spark):
    long = "http://h.example.com/" + "ab1" * 100_000
    row = {r.page_id: r for r in urls.judge(pages(spark, [(1, "http://a.b.com/x//y/?p=1&&q#z?w=2"), (2, long), (3, "😀😀é")])).collect()}
    assert (row[1].n_params, row[1].depth, row[1].host_length, row[1].length) == (2, 2, 7, 33)
    assert row[1].digit_ratio == pytest.approx(2 / 33) and row[3].entropy == pytest.approx(math.log2(3) - 2 / 3)
    counts = Counter(long)
    assert row[2].entropy == pytest.approx(-sum(n / len(long) * math.log2(n / len(long)) for n in counts.values()))


def test_no_labels_or_one_kind(spark):
    plain = [(k, f"http://h{k}.com/{k}") for k in range(5)]
    assert {(r.verdict, r.score) for r in urls.judge(pages(spark, plain)).collect()} == {("allow", 0.5)}
    assert {r.verdict for r in urls.judge(pages(spark, plain + [(9, "http://x.net/")])).collect()} == {"block"}
    assert urls.judge(pages(spark, plain).limit(0)).collect() == []


def brute_trees(rows, weights, y, thresholds, trees, depth):
    """The same boosting with numpy, row by row: margins of the rows."""
    bins = {f: np.array([sum(r[f] > t for t in thresholds[f]) for r in rows]) for f in urls.FEATURES}
    f0 = math.log((weights @ y + .5) / (weights @ (1 - y) + .5))
    out = np.full(len(rows), f0)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-out))
        g, h = np.round(weights * (y - p) * urls.FIXED_POINT), np.round(weights * p * (1 - p) * urls.FIXED_POINT)

        def worth(m, g=g, h=h):
            return (g[m].sum() / urls.FIXED_POINT) ** 2 / (h[m].sum() / urls.FIXED_POINT + urls.RIDGE)

        nodes, leaves = [np.ones(len(rows), bool)], []
        for _ in range(depth):
            grown = []
            for m in nodes:
                best, choice = 1e-9, None
                for f in urls.FEATURES:
                    for k in sorted(set(bins[f][m]))[:-1]:
                        low = m & (bins[f] <= k)
                        gain = worth(low) + worth(m & ~low) - worth(m)
                        if gain > best + 1e-9:
                            best, choice = gain, low
                if choice is None:
                    leaves.append(m)
                else:
                    grown += [choice, m & ~choice]
            nodes = grown
        for m in leaves + nodes:
            out = out + np.where(m, urls.RATE * (g[m].sum() / urls.FIXED_POINT) / (h[m].sum() / urls.FIXED_POINT + urls.RIDGE), 0)
    return out


def test_trees_equal_brute_force_and_learn(spark):
    rng = random.Random(3)
    rows = []
    for k in range(400):
        bad = rng.random() < .4
        path = "/".join(str(rng.randint(0, 10 ** 6)) if bad else rng.choice(["about", "news", "team"]) for _ in range(rng.randint(1, 4)))
        rows.append((f"http://h{rng.randint(0, 9)}.example.com/{path}{'?a=1&b=2' if rng.random() < .5 else ''}", int(bad != (rng.random() < .05))))
    labelled = spark.createDataFrame(rows, "url string, label int")
    seen = pages(spark, [(k, u) for k, (u, _) in enumerate(rows)])
    judged = {r.page_id: r for r in urls.judge(seen, rules=(), labelled=labelled).collect()}
    assert len(judged) == 400
    assert sum((judged[k].verdict == "block") == y for k, (_, y) in enumerate(rows)) >= 360

    features = urls.with_suffixes(urls.lexical(labelled.withColumn("page_id", F.lit(0))))
    sample = urls.sample_of(features, urls.SAMPLE)
    base, trees = urls.train(sample, trees=3)
    mine = sample.withColumn("margin", urls.margin(base, trees)).collect()
    cuts = [k / urls.BINS for k in range(1, urls.BINS)]
    q = sample.agg(*[F.percentile_approx(f, cuts, 10_000).alias(f) for f in urls.FEATURES]).first()
    want = brute_trees(mine, np.array([r.repeats for r in mine], float), np.array([r.label for r in mine], float),
                       {f: sorted(set(q[f])) for f in urls.FEATURES}, 3, urls.DEPTH)
    assert np.abs(want - np.array([r.margin for r in mine])).max() < 1e-6


def test_a_bounded_sample_is_the_same_for_any_partitioning(spark):
    rows = spark.createDataFrame([(f"http://h{k % 7}.com/{k}", k % 2) for k in range(300)], "url string, label int")
    def pick(df):
        return sorted(map(tuple, urls.sample_of(urls.with_suffixes(urls.lexical(df.withColumn("page_id", F.lit(0)))), 40).collect()))
    assert len(pick(rows)) == 40 and pick(rows) == pick(rows.repartition(9))


# ------------------------------------------------------------- phrases ---


def texts(spark, rows):
    return spark.createDataFrame([(k, *r, "x", 1, "y") for k, r in enumerate(rows)],
                                 "doc_id long, text string, lang string, word string, code long, phrase string")


def brute_phrases(rows, least=10, cover=50, top=2000):
    f, n, out = defaultdict(Counter), Counter(), []
    for text, lang in rows:
        lower = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for d in (1, 2, 3):
                f[lang or "und"].update(tuple(w[i:i + d]) for i in range(len(w) - d + 1))
    for lang, c in f.items():
        cand = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        gone = {part for g, a in cand.items() if len(g) == 3 for part in (g[:2], g[1:]) if 100 * a >= cover * c[part]}
        scored = []
        for g, a in cand.items():
            if g not in gone:
                s, k = min((1_000_000 * a * a // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
                scored.append((-s, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        out += [(lang, i + 1, g.decode(), -a, x, y, n[lang], -s) for i, (s, a, g, x, y) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def corpus(rng):
    words = ["the", "The", "of", "état", "x y", "a", "b", "new", "york", "city"]
    rows = [(" ".join(rng.choice(words[:rng.randint(2, 10)]) + rng.choice(["", "", "", ".", ",", "\n", "\t", "  "]) for _ in range(rng.randint(0, 80))),
             rng.choice(["en", "fr", None])) for _ in range(60)]
    rows += [("new york city " * 12 + "!" + "los angeles\r" * 15, "en")] * 3 + [(None, "en"), ("", None), (" \t. ,", "de"), ("solo", "it")]
    return rows + [(" ".join(f"w{k % 40} q{k % 7}" for k in range(3000)), "en")]


@pytest.mark.parametrize("how", [{}, {"tokens": 50, "per_range": 60, "size": 40}])
def test_phrases_equal_brute_force(spark, how):
    rows = corpus(random.Random(5))
    assert sorted(map(tuple, phrases.collocations(texts(spark, rows), **how).collect())) == brute_phrases(rows)
    assert sorted(map(tuple, phrases.collocations(texts(spark, rows), top=5, **how).collect())) == brute_phrases(rows, top=5)


def test_phrases_of_nothing(spark):
    assert phrases.collocations(texts(spark, [("a b", "en")]).limit(0)).collect() == []
    assert phrases.collocations(texts(spark, [(None, None)])).collect() == []


def test_words_with_one_code_are_told_apart(spark, monkeypatch):
    rows = [("aa bb. cc bb. " * 12, "en")]
    real = phrases._code
    docs = texts(spark, rows)
    got = []
    monkeypatch.setattr(phrases, "shards", lambda d, salt, tokens, size, keep=phrases.shards: got.append(salt) or keep(d, salt, tokens, size))
    found = phrases._words_of

    def others(rows, first, phrases_):
        out = found(rows, first, phrases_)
        return out if len(got) > 1 else out.withColumn("other", F.struct(F.col("other.lang").alias("lang"), F.lit("other").alias("word")))

    monkeypatch.setattr(phrases, "_words_of", others)
    assert sorted(map(tuple, phrases.collocations(docs).collect())) == brute_phrases(rows) and got == [0, 1]
    assert real("en", b"x", 0) != real("en", b"x", 1) != real("fr", b"x", 1)


def test_scores_beyond_64_bits(spark):
    big = 3 * 10 ** 12
    c = np.array([[5, 0, 0], [7, 0, 0], [5, 7, 0]], np.uint64)
    blob = Automaton.build(c, [big, big + 1, big - 1]).to_bytes()
    ranges = spark.createDataFrame([(0, bytearray(blob))], "range int, blob binary")
    (row,) = phrases.scored(ranges, np.zeros((0, 3), np.uint64)).collect()
    assert tuple(row) == (5, 7, 0, big - 1, big, big + 1, 1_000_000 * (big - 1) ** 2 // (big * (big + 1)))


def test_automata():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 700):
        g = rng.integers(1, 9, (n, 3)).astype(np.uint64) * np.uint64(2 ** 60 + 7)
        for i in range(n):
            g[i, 3 - i % 3:] = 0 if i % 3 else g[i, 3:]
        a, want = Automaton.build(g, rng.integers(1, 300, n)), Counter()
        back = Automaton.from_bytes(a.to_bytes())
        assert (back.grams == a.grams).all() and (back.weights == a.weights).all()
        paths = list(map(tuple, a.grams.tolist()))
        assert paths == sorted(set(map(tuple, g.tolist())))
        for part in (slice(0, n // 2), slice(n // 3, n)):
            want.update(dict(zip(paths[part], a.weights[part].tolist(), strict=True)))
        both = Automaton.union([a.take(slice(0, n // 2)), a.take(slice(n // 3, n))])
        assert dict(zip(map(tuple, both.grams.tolist()), both.weights.tolist(), strict=True)) == want
        asked = np.concatenate([g[:50], rng.integers(0, 9, (50, 3)).astype(np.uint64)])
        known = dict(zip(paths, a.weights.tolist(), strict=True))
        assert a.compose(asked).tolist() == [known.get(tuple(x), 0) for x in asked.tolist()]
        other = Automaton.build(asked, np.ones(len(asked), int))
        assert a.weights_of(other).tolist() == [known.get(tuple(x), 0) for x in other.grams.tolist()]
