"""The parts that need no Spark, against brute force."""

import random
import re

import numpy as np
import pytest

from lakeward.llm import bpe, jaccard, pii, tokencount, vectors

public_tokenizers = pytest.importorskip("public_tokenizers")
ALPHABET = ["a", "'", " ", "\n", "  ", "'r", "e", "12", "é", "!!", "x y", "'ll", "\t", "hello world ", "日本", "🙂"]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken_and_round_trips(ranks, reference):
    coder = bpe.Coder(ranks, public_tokenizers.PATTERN, cache=50)
    rng = random.Random(1)
    texts = ["", "a" * 20_000, "!" * 3000, "é" * 3000, "<|endoftext|>"]
    texts += ["".join(rng.choice(ALPHABET) for _ in range(60)) for _ in range(200)]
    for text in texts:
        ids = np.frombuffer(coder.encode(text), "<u4").tolist()
        assert ids == reference.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()
    assert coder.queue.top == 0 and not coder.queue.buckets


def test_edited_trees_count_as_a_whole_encoding(ranks, reference):
    counter, rng = tokencount.Counter(ranks, public_tokenizers.PATTERN), random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.choice([0, 3, 50, 900])))
        tree = tokencount.Tree.build(counter, text)
        for _ in range(3):
            s = rng.randint(0, len(text))
            e, new = min(len(text), s + rng.choice([0, 1, 5, 300])), "".join(rng.choice(ALPHABET) for _ in range(rng.choice([0, 1, 9])))
            want = text[:s] + new + text[e:]
            text, _ = tree.edit(counter, text, s, e, new)
            assert text == want and tree.tokens[1] == len(reference.encode_ordinary(want)) and tree.chars[1] == len(want)


def test_edit_encodes_only_near_it(ranks):
    counter = tokencount.Counter(ranks, public_tokenizers.PATTERN)
    text = "one two three " * 5000
    _, again = tokencount.Tree.build(counter, text).edit(counter, text, 30_000, 30_003, "X")
    assert again < 400


def test_base_spans_follow_the_patterns():
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    rng = random.Random(3)
    for _ in range(3000):
        t = "".join(rng.choice("ab.@-1 9é+") for _ in range(rng.randint(0, 40)))
        want = [("email", *m.span()) for m in email.finditer(t)]
        want += [("ip", *m.span()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        assert [x for x in pii.base_spans(t) if x[0] in ("email", "ip")] == want, t
    found = pii.base_spans("card 4111 1111 1111 1111, not 4111 1111 1111 1112; +1 (212) 555-0188")
    assert [k for k, _, _ in found] == ["card", "phone"]


def test_crf_adds_spans_and_leaves_plain_numbers():
    crf = pii.Crf().fit(pii.training_rows())
    found = pii.crf_spans(crf, ["please call 555-321-7654 soon", "in 1999 we had 20 dogs", "", "mail kim @ mail.example.com ok"])
    assert [[k for k, _, _ in x] for x in found] == [["phone"], [], [], ["email"]]


def test_block_comparison_equals_brute_force():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2 ** 62, 300).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(300) < rng.choice([0.02, 0.1, 0.3]), rng.integers(0, 2 ** 62, 300).astype(np.uint64), base))
            for _ in range(40)]
    alike, right, forest = jaccard.compare_block(list(range(40)), sets, np.full(40, True), 0.8, columns=500)
    want = [[i != j and len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8 for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    assert (alike == np.array(want)).all() and len(forest) <= 39
    assert jaccard.recall(0.8) > 0.999 and jaccard.plan_bands(0.8, 0.99)[0] <= 16


def test_crf_reads_lines_with_digits_of_any_script():
    crf = pii.Crf().fit(pii.training_rows())
    line = "please call 555-321-7654 soon"
    for zero in (0x660, 0xFF10, 0x966):
        other = "".join(chr(zero + int(c)) if c.isdigit() else c for c in line)
        assert pii.crf_spans(crf, [other, "no digits here"]) == pii.crf_spans(crf, [line, ""]) == [[("phone", 12, 24)], []]


def test_words_of_one_crc_are_different_words():
    assert not set(jaccard.shingles("plumless").tolist()) & set(jaccard.shingles("buckeroo").tolist())
    assert jaccard.digest(jaccard.shingles("a plumless day")) != jaccard.digest(jaccard.shingles("a buckeroo day"))
    first, second = jaccard.word_runs("one two three four five six")
    assert sorted(first.tolist()) == jaccard.shingles("one two three four five six").tolist() and not set(first.tolist()) & set(second.tolist())


def test_codes_drop_no_close_pair():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 64))
    x = np.concatenate([x, x + rng.normal(size=x.shape) * 0.38])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    coded = vectors.codes(x, vectors.rotation(64))
    i, j = vectors.candidate_pairs(coded, coded, 0.93)
    close = set(zip(*np.nonzero(x @ x.T >= 0.93), strict=True))
    assert len(close) > 650 and close <= set(zip(i, j, strict=True)) and len(i) < 0.2 * len(x) ** 2
