"""URL filters: rules on host and path, and gradient-boosted trees on lexical features.  DataFrame functions only.

A rule is ``host/path`` with a verdict; it fits its host and all
subdomains if the URL's path starts with the rule's path, and the longest
fitting rule decides.  URLs that no rule fits are judged by the trees,
which are trained from labelled URLs.

Features of a URL: its length, its host's length, its path's depth, the
share of digits, the entropy of its characters, its number of parameters;
and statistics of its suffixes (the last label of the host, and the last
two): the logarithm of the number of URLs, and the smoothed share of
blocked ones among the labelled.  URLs are dealt into ``FOLDS`` by hash; a
labelled URL gets the share of the other folds' URLs, so that its own label
does not show in it (leaving out one URL alone would give it away).

Training: at most ``SAMPLE`` distinct labelled URLs, chosen by hash and
counted with their repetitions there.  Each feature is cut at up to
``BINS`` - 1 quantiles of the sample.  ``TREES`` trees of ``DEPTH`` levels
are grown level by level with second-order gains: one aggregation per level
sums gradients and curvatures per (node, feature, bin), in fixed point so
that the order of rows does not matter, and only these sums (at most
2^DEPTH x features x BINS rows) come to the driver.  Scoring is a CASE
expression in the scan's stage.

Defined results: a null URL or one without ``://`` has an empty host and
path, no rule, and the trees' verdict; without labelled URLs all scores are
0.5, which allows; with labels of one kind that label's verdict follows;
repeated rows each get their row, null page ids included; other columns of
pages are ignored; rules of equal length that fit one URL are decided by
their order in the list.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeward.llm.common import table, written

#: Fixed by the contract.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

SAMPLE = 20_000
TREES, DEPTH, BINS = 12, 2, 16
RATE, RIDGE = 0.4, 1.0
FOLDS = 5
#: Weight of the overall share in a suffix's share of blocked URLs.
PRIOR = 20.0
FIXED_POINT = 1 << 30
FEATURES = ("length", "host_length", "depth", "digit_ratio", "entropy", "n_params", "top_count", "site_count", "top_share",
            "site_share")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Between the first ``://`` and the next ``/ ? #``, A-Z lower-cased; and from there to ``?``, ``#`` or the end."""
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.  ``rules`` is a list of (verdict, host/path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decides, text in sorted(rules, key=lambda r: len(r[1])):
        of_host, _, of_path = text.partition("/")
        fits = ((host == of_host) | F.endswith(host, F.lit("." + of_host))) & F.startswith(path, F.lit("/" + of_path))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(decides)).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Bits per character; 0 for an empty text."""
    n = F.char_length(text)
    ordered = F.array_join(F.array_sort(F.split(text, "")), "")
    runs = F.regexp_extract_all(ordered, F.lit(r"(?s)(.)\1*+"), F.lit(0))
    spread = F.aggregate(runs, F.lit(0.0), lambda a, r: a + F.char_length(r) * F.log2(F.char_length(r).cast("double")))
    return F.when(n > 0, F.log2(n.cast("double")) - spread / n).otherwise(F.lit(0.0))


def lexical(pages: DataFrame) -> DataFrame:
    """``pages`` (url and others) with host, path, site (last two labels), top (last label) and the lexical features."""
    url = F.coalesce("url", F.lit(""))
    host, path = host_and_path(F.col("url"))
    rows = pages.withColumn("host", host).withColumn("path", path)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    digits = F.char_length(F.regexp_replace(url, r"[^0-9]+", ""))
    return rows.select(
        "*", F.substring_index("host", ".", -2).alias("site"), F.substring_index("host", ".", -1).alias("top"),
        F.char_length(url).cast("double").alias("length"), F.char_length("host").cast("double").alias("host_length"),
        F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double").alias("depth"),
        (digits / F.greatest(F.char_length(url), F.lit(1))).alias("digit_ratio"), entropy(url).alias("entropy"),
        F.size(F.filter(F.split(query, "&"), lambda x: x != "")).cast("double").alias("n_params"))


def with_suffixes(rows: DataFrame) -> DataFrame:
    """``rows`` (site, top, label and others) with the counts and shares of their suffixes.

    label is 1 (block), 0 (allow) or null.  Counts are grouped by a struct
    of the key, so that the joins back have exchanges of their own and AQE
    can split a hot suffix.
    """
    fold = F.pmod(F.xxhash64("url"), F.lit(FOLDS))
    labels = [F.sum(F.when(fold == k, F.col("label"))).alias(f"b{k}") for k in range(FOLDS)]
    labels += [F.count(F.when(fold == k, F.col("label"))).alias(f"m{k}") for k in range(FOLDS)]
    sites = written(rows.groupBy("top", "site").agg(F.count("*").alias("n"), *labels), "urls-sites")
    summed = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sites.columns[3:]]
    whole = sites.agg(*summed).first()
    known, blocked = sum(whole[FOLDS:]), sum(whole[:FOLDS])
    overall = blocked / known if known else 0.5
    others = [F.col("label").isNull() | (fold != k) for k in range(FOLDS)]
    for name in ("site", "top"):
        found = (sites.groupBy(F.struct(name).alias("k")).agg(F.sum("n").alias("n"), *summed)
                 .select(F.col(f"k.{name}").alias("_key"), "n", *sites.columns[3:]))
        rows = rows.join(found, F.col(name) == F.col("_key"))
        b, m = (sum((F.when(o, F.col(f"{c}{k}")).otherwise(0) for k, o in enumerate(others)), F.lit(0)) for c in "bm")
        rows = rows.withColumn(f"{name}_count", F.log(F.col("n").cast("double"))).withColumn(
            f"{name}_share", (b + F.lit(PRIOR * overall)) / (m + F.lit(PRIOR))).drop("_key", "n", *sites.columns[3:])
    return rows


def sample_of(labelled: DataFrame, bound: int) -> DataFrame:
    """(label, repeats, features): at most ``bound`` distinct labelled URLs, the same whatever the partitioning.

    The count decides a range of hashes that holds about twice the bound;
    only that is ranked.
    """
    distinct = labelled.groupBy("url", "label").agg(F.count("*").alias("repeats"), *[F.max(f).alias(f) for f in FEATURES])
    distinct = written(distinct.withColumn("place", F.shiftrightunsigned(F.xxhash64("url", "label"), 1)), "urls-labelled")
    n = distinct.count()
    if n > 2 * bound:
        near = distinct.where(F.col("place") < int(2.0 ** 63 * (2 * bound / n)))
        distinct = near if near.count() >= bound else distinct
    return distinct.orderBy("place", "url", "label").limit(bound).select("label", "repeats", *FEATURES)


def train(sample: DataFrame, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> tuple[float, list[list[tuple]]]:
    """(base margin, trees).  A tree is a list of (path, value); a path is a tuple of (feature, threshold, above)."""
    weight = F.col("repeats")
    n, blocked = sample.agg(F.sum(weight), F.sum(weight * F.col("label"))).first()
    base = math.log(((blocked or 0) + 0.5) / ((n or 0) - (blocked or 0) + 0.5))
    if not n or not 0 < blocked < n:
        return base if n else 0.0, []
    cuts = [k / bins for k in range(1, bins)]
    row = sample.agg(*[F.percentile_approx(f, cuts, 10_000).alias(f) for f in FEATURES]).first()
    thresholds = {f: sorted(set(row[f])) for f in FEATURES}
    places = [sum((F.when(F.col(f) > t, 1).otherwise(0) for t in thresholds[f]), F.lit(0)).alias(f) for f in FEATURES]
    binned = sample.select("label", "repeats", *places).groupBy("label", *FEATURES).agg(F.sum("repeats").alias("repeats"))
    binned = written(binned.coalesce(1), "urls-binned")
    grown: list[list[tuple]] = []
    for _ in range(trees):
        # In bins: a path's test is bin > k, where threshold k is passed by the bins above k.
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin(base, grown)))
        fixed = lambda x: F.round(x * FIXED_POINT).cast("long")
        rows = binned.select(*FEATURES, fixed(weight * (F.col("label") - p)).alias("g"), fixed(weight * p * (F.lit(1.0) - p)).alias("h"))
        paths: list[tuple] = [()]
        values: dict[tuple, tuple[float, float]] = {}
        for _ in range(depth):
            node = F.lit(None)
            for k, path in enumerate(paths):
                node = F.when(_on(path), k).otherwise(node)
            each = F.explode(F.array(*[F.struct(F.lit(j).alias("f"), F.col(f).alias("bin")) for j, f in enumerate(FEATURES)]))
            sums = (rows.select(node.alias("node"), "g", "h", each.alias("e")).where("node is not null")
                    .groupBy("node", "e.f", "e.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect())
            paths, settled = _split(paths, sums)
            for path in paths:
                values.pop(path[:-1], None)
            values.update(settled)
            if not paths:
                break
        grown.append([(path, RATE * (g / FIXED_POINT) / (h / FIXED_POINT + RIDGE)) for path, (g, h) in values.items()])
        if list(values) == [()]:
            break
    return base, [[(tuple((f, thresholds[f][k], above) for f, k, above in path), value) for path, value in tree] for tree in grown]


def _split(paths: list[tuple], sums: list) -> tuple[list[tuple], dict[tuple, tuple]]:
    """The next level's paths, and the sums of its nodes and of those that stay leaves, from the sums per (node, feature, bin).

    The best split has the greatest gain; ties go to the first feature and
    the lowest bin.
    """
    table_: dict[tuple[int, int], dict[int, tuple[int, int]]] = {}
    for node, f, k, g, h in sums:
        table_.setdefault((node, f), {})[k] = (g, h)

    def worth(g, h):
        return (g / FIXED_POINT) ** 2 / (h / FIXED_POINT + RIDGE)

    nxt, settled = [], {}
    for node, path in enumerate(paths):
        if (node, 0) not in table_:
            continue
        total = [sum(x) for x in zip(*table_[node, 0].values(), strict=True)]
        best, choice = 1e-9, None
        for j, f in enumerate(FEATURES):
            g = h = 0
            per_bin = table_[node, j]
            for k in sorted(per_bin)[:-1]:
                g, h = g + per_bin[k][0], h + per_bin[k][1]
                gain = worth(g, h) + worth(total[0] - g, total[1] - h) - worth(*total)
                if gain > best + 1e-9:
                    best, choice = gain, (f, k, (g, h))
        if choice is None:
            settled[path] = tuple(total)
            continue
        f, k, (g, h) = choice
        for above, pair in ((False, (g, h)), (True, (total[0] - g, total[1] - h))):
            nxt.append((*path, (f, k, above)))
            settled[nxt[-1]] = pair
    return nxt, settled


def _on(path: tuple) -> Column:
    out = F.lit(True)
    for f, threshold, above in path:
        test = F.col(f) > F.lit(threshold)
        out = out & (test if above else ~test)
    return out


def margin(base: float, trees: list[list[tuple]]) -> Column:
    """The trees' sum: one CASE a tree."""
    total = F.lit(float(base))
    for tree in trees:
        leaves = F.lit(0.0)
        for path, value in tree:
            leaves = F.when(_on(path), F.lit(value)).otherwise(leaves)
        total = total + leaves
    return total


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labelled: DataFrame | None = None,
          sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict, score and the features of every row of ``pages`` (page_id, url).

    ``labelled`` (url, label 1 for block) trains the trees; by default the
    URLs of ``pages`` that a rule decides, labelled with its verdict.
    score is the trees' probability of a block, for URLs with a rule too.
    """
    rows = lexical(pages.select("page_id", "url"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("given", verdict)
    if labelled is None:
        rows = rows.withColumn("label", F.when(F.col("given") == "block", 1).when(F.col("given") == "allow", 0))
    else:
        rows = rows.withColumn("label", F.lit(None).cast("int")).withColumn("_theirs", F.lit(False))
        theirs = lexical(labelled.select(F.lit(None).cast(pages.schema["page_id"].dataType).alias("page_id"), "url",
                                         F.col("label").cast("int").alias("label")))
        nothing = F.lit(None).cast("string")
        rows = rows.unionByName(theirs.withColumn("rule", nothing).withColumn("given", nothing).withColumn("_theirs", F.lit(True)))
    rows = written(with_suffixes(rows), "urls-features")
    base, trees = train(written(sample_of(rows.where("label is not null"), sample), "urls-sample"))
    if labelled is not None:
        rows = rows.where("not _theirs")
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin(base, trees)))
    rows = rows.withColumn("score", score)
    return rows.select("page_id", "host", "path", "rule",
                       F.coalesce("given", F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"),
                       "score", *FEATURES)


def op12(spark, sf_dir):
    """The verdict on every url of ``pages``: a rule's, else the trees'."""
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")
