"""Each operator on nulls, empty and long texts, repeated rows, empty tables and clashing columns; and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeward.llm import bpe, decontaminate, jaccard, language, linededup, pii, quality, tokencount, toxicity, vectors

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, th string, cls string, line string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "x", "y", "z", "w") for i, t, lang in rows], SCHEMA)


def prose(rng, n, words="alpha beta gamma delta epsilon zeta eta theta iota kappa lambda sigma omega rho tau".split()):
    return " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    base = [prose(rng, 120) for _ in range(6)]
    rows = [(k, t, "en") for k, t in enumerate(base)]
    rows += [(10, base[0], "en"), (11, base[0].replace(" ", "  ", 3), "en"), (12, base[1] + " one more", "en"), (13, None, None),
             (14, "", "en"), (15, " \n ", None), (16, "123 !!", "en"), (None, base[2], "en"), (17, base[3], "en"), (17, base[3], "en"),
             (18, prose(rng, 30_000), "en"), (19, "short one", "en")]
    return documents(spark, rows)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, k % 3 == 0 and 1 or 0) for k in range(20)], "doc_id long, quality int, toxic int")


def test_near_duplicates_equal_brute_force(spark, corpus):
    found = jaccard.near_duplicates(corpus).collect()
    rows = corpus.select("doc_id", "text", F.xxhash64("text").alias("th")).collect()
    sets = [set(jaccard.shingles(r.text).tolist()) for r in rows]
    want = {}
    for r, s in zip(rows, sets, strict=True):
        want[r.doc_id, r.th] = sum(bool(s) and bool(t) and len(s & t) / len(s | t) >= 0.8 for t in sets) - bool(s)
    assert {(r.doc_id, r.th): r.n_links for r in found} == want and len(found) == len(rows)
    kept = jaccard.one_of_each(corpus).collect()
    assert sorted((r.doc_id for r in kept if r.doc_id is not None)) == [0, 1, 2, 3, 4, 5, 13, 14, 15, 16, 18, 19]
    assert kept[0].asDict().keys() == set(corpus.columns)


@pytest.mark.parametrize("how", [{"BLOCK": 3}, {"BLOCK_GRAMS": 300}])
def test_near_duplicates_over_several_blocks(spark, monkeypatch, how):
    for name, value in how.items():
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(8)
    base = [prose(rng, 80).split() for _ in range(3)]
    docs = documents(spark, [(k, " ".join(w if rng.random() > .004 * (k % 8) else "new" + str(k) for w in base[k % 3]), "en") for k in range(60)])
    sets = [set(jaccard.shingles(r.text).tolist()) for r in docs.orderBy("doc_id").collect()]
    links = {k: [j for j, t in enumerate(sets) if j != k and len(s & t) / len(s | t) >= 0.8] for k, s in enumerate(sets)}
    found = {r.doc_id: (r.n_links, r.group_id) for r in jaccard.near_duplicates(docs).collect()}
    assert {k: v[0] for k, v in found.items()} == {k: len(v) for k, v in links.items()} and sum(map(len, links.values())) > 200
    assert all(found[k][1] == found[j][1] for k, v in links.items() for j in v)


def test_vectors_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 5)
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(4, 16))
    rows = [(k, [float(v) for v in centre[k % 4] + rng.normal(size=16) * .15 * (k % 5)], k % 2, "x", 1) for k in range(90)]
    rows += [(200, rows[0][1], 0, "x", 1), (201, [2 * v for v in rows[0][1]], 0, "x", 1), (202, rows[0][1], None, "x", 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string, proof int")
    unit = {r[0]: np.array(r[1]) / np.linalg.norm(r[1]) for r in rows}
    linked = {i: [j for j, _, lab, *_ in rows if j != i and lab is not None and lab == label and unit[i] @ unit[j] >= 0.93] for i, _, label, *_ in rows}
    found = {r.vec_id: r for r in vectors.near_vectors(frame).collect()}
    assert {k: r.n_links for k, r in found.items()} == {k: len(v) for k, v in linked.items()} and sum(map(len, linked.values())) > 100
    for k, v in linked.items():
        assert all(found[k].component_id == found[j].component_id <= k for j in v) and found[k].kept == (found[k].component_id == k)


def test_different_sets_of_one_hash_are_no_copies(spark):
    signed = spark.createDataFrame([(1, 5, 7, 10, [1]), (2, 6, 7, 10, [1]), (3, 7, 7, 11, [1]), (4, 8, 7, 12, [1]), (5, 9, 8, 10, [1]),
                                    (6, 9, None, None, None)], "doc_id long, th long, cls long, proof long, bands array<long>")
    cls = {r.doc_id: r.cls for r in jaccard.told_apart(signed).collect()}
    assert cls[1] == cls[2] == 7 and len({cls[k] for k in (1, 3, 4, 5)}) == 4 and cls[6] is None
    docs = documents(spark, [(1, "plumless", "en"), (2, "buckeroo", "en"), (3, "Plumless!", "en")])
    assert {r.doc_id: r.class_id for r in jaccard.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1}
    assert sorted(r.doc_id for r in jaccard.one_of_each(docs).collect()) == [1, 2]


def test_lines_keep_one_of_each_group(spark):
    rng = random.Random(9)
    line = prose(rng, 60)
    near = line.replace(line.split()[30], "changed", 1)
    other = prose(rng, 60)
    unspaced = "".join(chr(0x4E00 + rng.randint(0, 2000)) for _ in range(120))
    docs = documents(spark, [(1, f"{line}\n{other}\n\nshort", "en"), (2, f"{near}\nown line here", "en"), (3, line, "en"),
                             (4, None, "en"), (5, " \n", "en"), (6, "short\nshort", "en"), (7, other + "\nlast", "en"),
                             (7, other + "\nlast", "en"), (8, unspaced, "ja"), (9, unspaced + "x", "ja")])
    got = {r.doc_id: r.text for r in linededup.without_repeats(docs).collect()}
    assert got == {1: f"{line}\n{other}\n\nshort", 2: "own line here", 4: None, 5: " \n", 7: "last", 8: unspaced}


def edited_pairs(rng, sep, lengths, n, edits):
    """(line, the same line with some letters changed), of similarity at least 0.8."""
    out = []
    while len(out) < n:
        line = sep.join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(*lengths))) for _ in range(300))[:200]
        other = list(line)
        for at in rng.sample(range(200), edits):
            other[at] = rng.choice("ABCDEFGHIJ") if other[at] != sep else sep
        other = "".join(other)
        a, b = ({x[k:k + 8] for k in range(193)} for x in (line, other))
        if line != other and 0.8 <= len(a & b) / len(a | b) < 0.9:
            out.append((line, other))
    return out


@pytest.mark.parametrize("sep,lengths", [(" ", (2, 8)), (" ", (10, 20)), ("\t", (2, 8)), ("\t", (10, 20))])
def test_line_signatures_reach_the_bandings_recall(spark, sep, lengths):
    pairs = edited_pairs(random.Random(12), sep, lengths, 300, 3)
    frame = spark.createDataFrame([(2 * k + j, x) for k, p in enumerate(pairs) for j, x in enumerate(p)], "lid long, line string")
    rows = {}
    for r in linededup.banded_lines(frame).collect():
        rows.setdefault(r.lid, set()).update(r.bands)
    assert sum(bool(rows[2 * k] & rows[2 * k + 1]) for k in range(300)) >= 294


def test_shingles_are_hashed_in_runs_and_none_is_lost(spark):
    lines = ["".join(chr(0x1F300 + (k * j) % 90) if k % 3 else chr(97 + (k * j) % 26) for k in range(j)) for j in (1, 7, 8, 22, 23, 24, 39, 40, 70)]
    frame = spark.createDataFrame(list(enumerate(lines)), "lid long, line string")
    runs, names = linededup._exploded(frame)
    got, rows = {}, {}
    for r in runs.collect():
        got.setdefault(r.lid, set()).update(r[h] for h in names)
        rows[r.lid] = rows.get(r.lid, 0) + 1
    F = linededup.F
    each = spark.createDataFrame([(k, x[j:j + 8]) for k, x in enumerate(lines) for j in range(max(1, len(x) - 7))], "lid long, s string")
    want = {r.lid: set(r.s) for r in each.groupBy("lid").agg(F.collect_set(F.xxhash64(F.encode("s", "UTF-32"))).alias("s")).collect()}
    assert got == want and rows == {k: -(-max(1, len(x) - 7) // linededup.RUN) for k, x in enumerate(lines)}
    sets = {r.lid: r.s for r in frame.select("lid", linededup.shingles(F.col("line")).alias("s")).collect()}
    assert {k: set(v) for k, v in sets.items()} == want
    assert {r.lid: r.n for r in linededup.measured(frame).collect()} == {k: len(v) for k, v in want.items()}


def test_settled_lines_still_meet_the_others_of_their_buckets(spark, monkeypatch):
    rng = random.Random(21)

    def changed(line, places):
        return "".join("#" if k in places else x for k, x in enumerate(line))

    def alike(x, y):
        a, b = ({z[k:k + 8] for k in range(len(z) - 7)} for z in (x, y))
        return len(a & b) / len(a | b) >= 0.8

    base = [prose(rng, 60)[:300] for _ in range(30)]
    # Chains of ever more changed letters: neighbours are alike, the ends are not.
    lines = [changed(x, range(20, 20 + 30 * k, 30)) for x in base for k in range(9)]
    lines += [prose(rng, 40) for _ in range(150)]
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(rng.sample(lines, len(lines)))], "lid long, line string")
    rows = frame.collect()
    # One band for all: every pair is a candidate, and the result is that of brute force.
    one = linededup.F.array(*[linededup.F.lit(b) for b in range(2)])
    monkeypatch.setattr(linededup, "banded_lines", lambda lines: lines.select("lid", one.cast("array<long>").alias("bands")))
    root = {r.lid: r.lid for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in rows:
        for b in rows:
            if a.lid < b.lid and abs(len(a.line) - len(b.line)) < 70 and alike(a.line, b.line):
                low, high = sorted((find(a.lid), find(b.lid)))
                root[high] = low
    want = {r.lid: find(r.lid) for r in rows}
    got = {r.node: r.root for r in linededup.similar_lines(frame).collect()}
    sizes = list(want.values())
    assert got == {k: v for k, v in want.items() if sizes.count(v) > 1} and len(got) >= 200


def test_decontamination(spark, corpus):
    items = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog and runs away"), (2, "tiny item"), (None, "null id"),
                                   (3, None), (4, "!!")], "item_id long, text string")
    docs = documents(spark, [(1, "xx THE quick, brown fox jumps over the lazy dog AND runs yy", "en"), (2, "a tiny item here", "en"),
                             (3, "clean", "en"), (4, None, "en"), (5, "null id", "en"), (3, "clean", "en")])
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in decontaminate.contamination(docs, items).collect())
    assert got == [(1, 13, 11, 1), (2, 4, 2, 1), (3, 1, 0, 0), (3, 1, 0, 0), (4, 0, 0, 0), (5, 2, 2, 0)]
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, items).collect()) == [3, 3, 4]
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, items, action="span").collect()}
    assert cut[2] == "a   here" and cut[3] == "clean"
    assert decontaminate.contamination(docs, items.limit(0)).where("contaminated").count() == 0


def test_a_large_benchmark_is_joined_without_the_documents_words(spark, corpus):
    rng = random.Random(17)
    texts = [r.text for r in corpus.collect()]
    items = spark.createDataFrame([(1, " ".join(texts[0].split()[5:40])), (2, "short one"), (None, prose(rng, 15)), (3, texts[10][900:1200])],
                                  "item_id long, text string")
    small = decontaminate.find_hits(corpus, items)
    large = decontaminate.find_hits(corpus, items, broadcast_bytes=0)
    rows = [sorted(map(tuple, x.distinct().collect()), key=str) for x in (small, large)]
    assert rows[0] == rows[1] and sum(r[3] > 0 for r in rows[1]) > 40
    own = [sorted(map(str, x.where("i = 0").collect())) for x in (small, large)]
    assert own[0] == own[1] and len(own[1]) == corpus.count()

    def sides(plan):
        if plan.nodeName() == "Join":
            yield plan.left()
        for k in range(plan.children().length()):
            yield from sides(plan.children().apply(k))

    # No window row is shuffled with the words of its document: words are a window's own, in rows without a longer array.
    for side in sides(large._jdf.queryExecution().optimizedPlan()):
        names = [side.output().apply(k).name() for k in range(side.output().length())]
        assert "w" not in names, names


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.1], 0), (4, [1.0, 0.0], 1), (5, [0.0, 0.0], 0), (6, None, 0),
            (7, [1.0, None], 0), (8, [1.0, float("nan")], 0), (9, [1.0, 0.0], None), (10, [0.0, 1.0], 0), (1, [1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect())
    alone = [(k, 0, k, True) for k in (4, 5, 6, 7, 8, 9, 10)]
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), *alone])
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_models_give_a_row_each(spark, corpus, labels):
    n = corpus.count()
    lang = {r.doc_id: r for r in language.languages_of(corpus).collect()}
    assert {lang[k].lang_pred for k in (13, 14, 15, 16)} == {"und"} and lang[0].lang_pred == "en"
    assert lang[1].held_out == (zlib.crc32(b"1") % 5 == 0)
    tox = toxicity.toxicity(corpus, labels).collect()
    assert len(tox) == n and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in tox)
    good = quality.site_scores(quality.evidence(corpus, labels, "source", "lang")).collect()
    assert len(good) == n and all(0 <= r.score <= 1 for r in good)
    assert pii.personal_data(corpus).count() == n
    counted = tokencount.apply_edits(tokencount.masking_edits(tokencount.build_trees(corpus))).collect()
    whole = {(r.doc_id, r.n_tokens) for r in bpe.digests(corpus).collect()}
    assert {(r.doc_id, r.n_before) for r in counted} == whole
    back = bpe.decode(bpe.encode(corpus)).join(corpus.select("doc_id", "text"), "doc_id").where("doc_id <> 17")
    assert back.where("decode(bytes, 'UTF-8') <> coalesce(text, '')").count() == 0


def test_toxicity_thresholds_count_all_labelled_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PER_CLASS", 5)
    monkeypatch.setattr(toxicity.labelled_sample, "__defaults__", (5,))
    rng = random.Random(8)
    rows = [(k, prose(rng, 12) + (" vile" * (rng.random() < (0.8 if k % 3 == 0 else 0.1))), ("en", "fi", None)[k % 5 % 3]) for k in range(600)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(600)], "doc_id long, toxic int")
    got = toxicity.toxicity(documents(spark, rows), labels).collect()
    lang, outside = {k: x for k, _, x in rows}, [r for r in got if not r.held_out]

    def least(found):
        good = [s for s in {r.score for r in found}
                if sum(r.doc_id % 3 == 0 for r in found if r.score >= s) / sum(r.score >= s for r in found) >= toxicity.PRECISION]
        return min(good, default=1.0)

    for x in ("en", "fi", None):
        assert sum(lang[r.doc_id] == x and r.doc_id % 3 == 0 for r in outside) >= toxicity.MIN_TOXIC
        want = least([r for r in outside if x is None or lang[r.doc_id] == x])
        assert {r.threshold for r in got if lang[r.doc_id] == x} == {want}
    assert all(r.flagged == (r.score >= r.threshold) for r in got)


def test_copies_take_one_place_of_a_sample(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(k, f"copy {k % 5}", "en") for k in range(400)] + [(400 + k, prose(rng, 9), "en") for k in range(60)]
    rows += [(401, rows[401][1], "en")] * 300 + [(1000 + k, "yksi teksti", "fi") for k in range(2)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(k, 1, 1) for k in range(460)], "doc_id long, quality int, toxic int")
    outside = {t for k, t, _ in rows if k < 1000 and zlib.crc32(str(k).encode()) % 5}
    for part in (toxicity, quality):
        found = part.labelled_sample(docs, labels, 200)
        found = found if part is toxicity else [(r.doc_id, r.h, r.quality) for r in found.collect()]
        assert len(found) == len({x[1] if part is quality else x[1].tobytes() for x in found}) == len(outside)
    found = language.labelled_sample(docs, 30)
    assert sum(x[0] == "en" for x in found) == len({x for x in found if x[0] == "en"}) == 30
    monkeypatch.setattr(language, "SAMPLE", 10)
    # Fewer texts of each language, but no language without any.
    found = language.labelled_sample(docs, 30)
    assert sorted({x[0] for x in found}) == ["en", "fi"] and sum(x[0] == "en" for x in found) == 5


def test_training_sees_whole_texts(spark, monkeypatch):
    rng = random.Random(31)
    rows = [(k, prose(rng, 6000) + (" wretchedly" * (k % 2)), "en") for k in range(30)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(30)], "doc_id long, quality int, toxic int")
    outside = sorted(k for k, _, _ in rows if zlib.crc32(str(k).encode()) % 5)
    found = toxicity.labelled_sample(docs, labels)
    word = toxicity.symbols("wretchedly")[0].astype("<u2")
    assert [any((w == word).all(axis=2).any() for w in windows[None]) for _, windows in found] == [bool(t) for t, _ in found]
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(sorted(x.tolist())) or [0.0] * 14)
    quality.evidence(docs, labels, "source", "lang")
    assert seen == [sorted(quality.features(rows[k][1]).tolist() for k in outside)]
    late = [(k, "x" * 2000 + "y" * 40_000, "en") for k in range(3, 4)]
    assert any(b"y" * 128 in w for _, w in language.labelled_sample(documents(spark, late)))


def test_empty_tables(spark, corpus, labels):
    none, no_labels = corpus.limit(0), labels.limit(0)
    items = spark.createDataFrame([], "item_id long, text string")
    for frame in (language.languages_of(none), language.identified(none), toxicity.toxicity(none, no_labels), bpe.digests(none),
                  jaccard.one_of_each(none), linededup.without_repeats(none), decontaminate.contamination(none, items),
                  pii.personal_data(none), quality.site_scores(quality.evidence(none, no_labels, "source", "lang"))):
        assert frame.count() == 0
    assert toxicity.toxicity(corpus, no_labels).select("score").distinct().count() == 1


def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "line_dedup", "ngram_jaccard", "benchmark_decontamination", "byte_bpe"]
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    ids = [r.doc_id for r in out.collect()]
    assert 100 < len(ids) <= 200 and len(set(ids)) == len(ids)


def test_ids_may_be_strings(spark, corpus, labels):
    named = corpus.withColumn("doc_id", F.concat(F.lit("d-"), F.col("doc_id").cast("string")))
    theirs = labels.withColumn("doc_id", F.concat(F.lit("d-"), F.col("doc_id").cast("string")))
    n = corpus.count()
    assert toxicity.toxicity(named, theirs).where("doc_id is null or doc_id like 'd-%'").count() == n
    assert quality.site_scores(quality.evidence(named, theirs, "source", "lang")).count() == n
    assert language.languages_of(named).count() == n and pii.personal_data(named).count() == n
    assert jaccard.near_duplicates(named).count() == n and bpe.digests(named).count() == n
    assert linededup.without_repeats(named).count() > 0


def test_site_posteriors_leave_the_document_out(spark):
    rng = random.Random(2)
    rows = [(k, f"h{k % 4}", f"p{k % 3}", min(.98, max(.02, rng.gauss(.2 + .2 * (k % 4), .1)))) for k in range(60)]
    # A path of one document, a host of one, a host that is null.
    rows += [(100, "h0", "alone", .9), (101, "lonely", "p0", .1), (102, None, None, .5), (103, None, None, .7)]
    frame = spark.createDataFrame(rows, "doc_id long, host string, path string, p double")
    got = {r.doc_id: r for r in quality.site_scores(frame).collect()}
    p = {r[0]: r[3] for r in rows}
    mean = sum(p.values()) / len(rows)

    def groups(key):
        out = {}
        for r in rows:
            out.setdefault(key(r), []).append(r[3])
        return out

    def kappa(found):
        live = [np.array(v) for v in found.values() if len(v) > 1]
        spread = np.mean([(v.mean() - mean) ** 2 for v in live]) - np.mean([v.var(ddof=1) / len(v) for v in live])
        return min(quality.MOST_KAPPA, max(0.0, mean * (1 - mean) / spread - 1)) if spread > 0 else quality.MOST_KAPPA

    hosts, paths = groups(lambda r: r[1]), groups(lambda r: (r[1], r[2]))
    top, low = kappa(hosts), kappa(paths)
    for i, host, path, own in rows:
        h, t = hosts[host], paths[host, path]
        of_host = (sum(h) - own + top * mean) / (len(h) - 1 + top)
        of_path = (sum(t) - own + low * of_host) / (len(t) - 1 + low)
        odds = np.log(own / (1 - own)) + np.log(of_path / (1 - of_path)) - np.log(mean / (1 - mean))
        assert got[i].host_posterior == pytest.approx(of_host) and got[i].path_posterior == pytest.approx(of_path)
        assert got[i].score == pytest.approx(1 / (1 + np.exp(-odds)))
    assert got[100].path_posterior == pytest.approx(got[100].host_posterior) and got[101].host_posterior == pytest.approx(mean)
    one = quality.site_scores(frame.where("doc_id = 100")).first()
    assert one.host_posterior == one.path_posterior == pytest.approx(.9)


def test_a_very_long_line_is_decoded_like_a_short_one(spark, monkeypatch):
    rng = random.Random(11)
    words = "mail me at jane @ example.org or card 4111/1111/1111/1111 from 10 . 0 . 0 . 12 the year 1998 room 404 call".split(" ")
    line = " ".join(rng.choice(words) for _ in range(4000)) + " contact jane @ example.org now"
    crf = pii.Crf().fit(pii.training_rows(), steps=60)
    short = pii.crf_spans(crf, [line, "x 1 y"])
    monkeypatch.setattr(pii, "LONG", 100)
    assert pii.crf_spans(crf, [line, "x 1 y"]) == short and len(short[0]) > 5
