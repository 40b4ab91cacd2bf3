"""The quality classifier's features, loss, threshold and scores against plain versions."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from terraspan.llm import quality


def plain_shares(text: bytes) -> list[float]:
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", text) if w]
    if not words:
        return [0.0] * 16
    m, n, lines = len(words), len(text), text.split(b"\n")
    kind = {c: ("letter" if c >= 128 or chr(c).isalpha() else "digit" if chr(c).isdigit() else "symbol" if chr(c) in "#$%&*+<=>@\\^_`{}~" else "space" if c in (9, 10, 32) else "other") for c in range(256)}
    count = Counter(kind[c] for c in text)
    letters = max(1, count["letter"])
    times = Counter(words)
    return [
        math.log1p(n) / 16, math.sqrt(min(1, text.count(b"!") / m)), math.sqrt(min(1, text.count(b"|") / m)), math.sqrt(min(1, count["symbol"] / m)), math.sqrt(sum(65 <= c <= 90 for c in text) / letters),
        math.sqrt(count["digit"] / n), math.sqrt(count["other"] / n), min(m, text.count(b".") + text.count(b",")) / m, math.sqrt(sum(a == b for a, b in zip(words, words[1:])) / m), len(times) / m,
        max(times.values()) / m, min(1, sum(map(len, words)) / m / 16), sum(len(w) > 20 for w in words) / m, 1 - len(set(lines)) / len(lines), sum(len(w) == 1 for w in words) / m, min(1, len(lines) * 8 / m),
    ]


def plain_bags(text: bytes) -> list[float]:
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in text)
    words = Counter(int(quality.hasher().words(np.frombuffer(w, np.uint8), np.zeros(1, np.int64), np.array([len(w)]))[0]) >> 56 for w in re.split(rb"[\x20\x09-\x0d]+", low) if w)
    triples = Counter((((a * 0x9E3779B1 ^ b * 0x85EBCA77 ^ c * 0xC2B2AE3D) & 0xFFFFFFFF) * 0x27D4EB2F & 0xFFFFFFFF) >> 24 for a, b, c in zip(low, low[1:], low[2:]))
    bag = lambda c: [math.sqrt(c[k] / max(1, sum(c.values()))) for k in range(256)]
    return bag(words) + bag(triples)


def odd_texts(some):
    texts = [(r.text or "").encode() for r in some.limit(60).collect()]
    return [*texts, b"", b" \n ", b"x", b"AAA aaa\naaa aaa!!", "naïve 日本 | 42%".encode(), b"ab" * 40_000, b"\xc3\xa9 " * 70_000]


def test_features_are_those_of_the_rule(some):
    for text in odd_texts(some):
        got = quality.features(text)
        assert np.allclose(got[:16], plain_shares(text), atol=1e-5) and np.allclose(got[16:], plain_bags(text), atol=1e-5)


def labelled(n=240, d=12, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)).astype(np.float32)
    good = x @ r.normal(size=d) + r.normal(0, 1.5, n) > 0.3
    return x, good


def test_the_fit_minimises_the_loss_of_pairs():
    x, good = labelled()
    n = quality.PAIRS * max(good.sum(), (~good).sum())
    draw = np.random.default_rng(0)
    better = np.resize(draw.permutation(np.flatnonzero(good)), n)
    worse = np.resize(draw.permutation(np.flatnonzero(~good)), n)[draw.permutation(n)]
    apart = (x[better] - x[worse]).astype(float)
    loss = lambda w: float(np.mean(np.log1p(np.exp(-(apart @ w)))) + quality.RIDGE / 2 * w @ w)
    w = np.zeros(x.shape[1])
    for _ in range(4000):  # plain gradient descent on pairs of feature differences
        w -= 0.5 * (quality.RIDGE * w - (apart / (1 + np.exp(apart @ w))[:, None]).mean(axis=0))
    got = quality.Ranking._fitted(x, good).astype(float)
    assert loss(w) <= loss(got) <= loss(w) + 0.002 and loss(got) < 0.8 * math.log(2)
    assert set(better) == set(np.flatnonzero(good)) and set(worse) == set(np.flatnonzero(~good))


def test_the_threshold_has_the_least_error():
    r = np.random.default_rng(1)
    x = np.zeros((300, 16 + quality.WORDS + quality.TRIPLES), np.float32)
    x[:, :16] = r.normal(size=(300, 16))
    good = x[:, 3] + r.normal(0, 0.7, 300) > 0.5
    model = quality.Ranking(x, good)
    scores = (x - model.mean) @ model.weights
    error = lambda at: (good & (scores < at)).sum() / good.sum() + (~good & (scores >= at)).sum() / (~good).sum()
    assert error(model.threshold) <= min(error(s) for s in [*scores, scores.max() + 1]) + 2 / min(good.sum(), (~good).sum())
    assert ((model(x) >= 0.5) == (scores >= model.threshold)).mean() > 0.995


@pytest.mark.parametrize("which", ["odd", "some"])
def test_scores_of_documents(spark, request, which):
    docs = request.getfixturevalue(which)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality.fit(request.getfixturevalue("some"), labels)
    want = Counter()
    for r in docs.collect():
        x = np.array([*plain_shares((r.text or "").encode()), *plain_bags((r.text or "").encode())])
        s = ((x - model.mean) @ model.weights - model.threshold) / model.width
        want[r.doc_id, round(1 / (1 + math.exp(-max(-30, min(30, s)))), 3)] += 1
    got = Counter((r.doc_id, round(r.score, 3)) for r in quality.scored(docs, model).collect())
    near = sum((got & want).values())
    assert sum(got.values()) == sum(want.values()) and near >= 0.97 * sum(want.values())  # but for the third digit's rounding
