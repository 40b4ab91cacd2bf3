"""Clusters, near-duplicate vectors and periodic runs against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraspan.llm import clustering, embedding_dedup, periodic

from .conftest import odd_vectors


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ---- clusters


def plain_clusters(rows, count, rounds, size=64, scale=256):
    """[(vec_id, vector)] -> [(vec_id, cluster, distance)], centroids; all distances."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, sha(f"2:{r[0]}"), r[1]))[:count]
    centroids = [v for _, v in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min((far(v, c), k) for k, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        of = assign()
        for k in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, of, strict=True) if c == k]
            if own:
                centroids[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [(i, c, d) for (i, _), (d, c) in zip(kept, assign(), strict=True)], centroids


@pytest.mark.parametrize("count", [40, 7, 500])
def test_clusters(spark, vectors, count):
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    want, centroids = plain_clusters(rows, count, 5)
    table, found = clustering.cluster(vectors, count=count)
    assert Counter((r.vec_id, r.cluster, r.distance) for r in table.collect()) == Counter(want)
    assert found.tolist() == centroids


def test_cluster_query(spark, vectors, tmp_path):
    vectors.write.parquet(f"{tmp_path}/embeddings.parquet")
    want, centroids = plain_clusters([(r.vec_id, r.embedding) for r in vectors.collect()], 40, 5)
    total = Counter()
    for _, c, d in want:
        total[c] += d
    rows = Counter((i, c, d, total[c], sum(total.values()), sha(",".join(map(str, centroids[c])))) for i, c, d in want)
    assert Counter(map(tuple, clustering.query(spark, str(tmp_path)).collect())) == rows


def test_annulus_keeps_ties_and_leaves_out_others():
    r = np.random.default_rng(3)
    for size, most in ((2, 3), (3, 40), (64, 300)):
        x, c = r.integers(-most, most + 1, (500, size)), r.integers(-most, most + 1, (30, size))
        c[7], c[20] = c[3], -c[3]  # equal centroids, and equal norms
        every = ((x[:, None] - c[None]) ** 2).sum(2)
        for before in (None, r.integers(0, 30, 500), every.argmin(1)):
            best, least, _ = clustering.nearest(x, c, before)
            assert (best == every.argmin(1)).all() and (least == every.min(1)).all()
    shells = c * np.arange(1, 31)[:, None]  # norms far apart: few are compared
    assert clustering.nearest(shells, shells, np.arange(30))[2] < 30 * 30 / 4


def test_clusters_of_no_vectors_and_of_too_large_ones(spark, vectors):
    table, centroids = clustering.cluster(vectors.limit(0))
    assert table.count() == 0 and centroids.shape == (0, 64)
    huge = spark.createDataFrame([(1, [3e38] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="too large"):
        clustering.cluster(huge)


# ---- near-duplicate vectors


def plain_links(rows, similarity=0.93):
    """Counter of (vec_id, n_links, component_id, kept), by all pairs."""
    good = [k for k, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, root = {k: set() for k in range(len(rows))}, list(range(len(rows)))
    for n, a in enumerate(good):
        for b in good[:n]:
            x, y = rows[a][1], rows[b][1]
            if rows[a][2] == rows[b][2] and len(x) == len(y) and np.dot(x, y) / math.sqrt(np.dot(x, x) * np.dot(y, y)) >= similarity:
                links[a].add(b)
                links[b].add(a)
                old, new = root[a], root[b]
                root = [new if z == old else z for z in root]
    least = lambda k: min((rows[j][0] for j in range(len(rows)) if root[j] == root[k] and rows[j][0] is not None), default=None)
    return Counter((i, len(links[k]), least(k), least(k) == i) for k, (i, _, _) in enumerate(rows))


def stored(vectors):
    return [(r.vec_id, r.embedding, r.label) for r in vectors.collect()]


@pytest.mark.parametrize("block, chunk", [(4096, 1 << 16), (3, 2), (2, 5)])
def test_near_vectors(vectors, monkeypatch, block, chunk):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)  # forces many blocks of a list, and chunks that look into them
    monkeypatch.setattr(embedding_dedup, "CHUNK", chunk)
    assert Counter(map(tuple, embedding_dedup.near_duplicates(vectors).collect())) == plain_links(stored(vectors))


def planted(n, seed, groups=40):
    """Vectors at random, and groups whose members lie around one, at all distances."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 64))
    for g in range(groups):
        x[g * 12 : g * 12 + 12] = x[g * 12] + np.linspace(0, 0.5, 12)[:, None] * r.normal(size=(12, 64))
    return [(k, v, int(k) % 2 if k >= groups * 12 else 0) for k, v in zip(r.permutation(n).tolist(), x.tolist(), strict=True)]


def test_all_links_with_full_reach_and_most_with_the_usual(spark):
    rows = planted(3000, 1)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = plain_links(rows)
    assert Counter(map(tuple, embedding_dedup.near_duplicates(table, reach=1).collect())) == want
    found, every = (sum(n * k for (_, n, _, _), k in x.items()) for x in (Counter(map(tuple, embedding_dedup.near_duplicates(table).collect())), want))
    assert every > 1000 and 0.99 * every <= found <= every


def test_no_candidate_within_a_list_is_lost():
    r = np.random.default_rng(5)
    x = r.normal(size=(2000, 64))
    x[1000:] = x[:1000] + r.normal(size=(1000, 64)) * r.uniform(0, 0.5, (1000, 1))
    unit = embedding_dedup.units(x)
    model = embedding_dedup.fit(x[:1500], 6)
    own, codes, error = model.coded(unit)
    for k in range(6):
        inside = np.flatnonzero(own == k)
        a, b = model.candidates(unit, k, codes[inside], error[inside])
        seen = set(zip(a.tolist(), inside[b].tolist(), strict=True))
        near = np.argwhere(unit @ unit[inside].T >= 0.93)
        assert {(p, int(inside[q])) for p, q in near.tolist()} <= seen
        assert len(seen) < 0.2 * len(x) * len(inside)


def test_near_vectors_of_none_and_of_other_types(spark, vectors):
    assert embedding_dedup.near_duplicates(vectors.limit(0)).count() == 0
    other = spark.createDataFrame([("b", [1, 2], "x"), ("a", [10, 21], "x"), ("c", [1, 2], "y,1"), ("d", [1, -2], "x")], "key string, v array<int>, kind string")
    assert {tuple(r) for r in embedding_dedup.near_duplicates(other, "key", "v", "kind").collect()} == {("a", 1, "a", True), ("b", 1, "a", False), ("c", 0, "c", True), ("d", 0, "d", True)}
    large = spark.createDataFrame([(1, [1e200, 2e200], 0), (2, [1e-200, 2e-200], 0)], "vec_id long, embedding array<double>, label int")
    assert {r.n_links for r in embedding_dedup.near_duplicates(large).collect()} == {1}


# ---- periodic runs


def plain_runs(words):
    """By trying each period at each place; of periods of one stretch the least."""
    found, n = {}, len(words)
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p), p)
            i = j + 1 if j == i else j
    return sorted((a, b - a, p) for (a, b), p in found.items())


def odd_words(r):
    n, kinds = r.randrange(150), r.choice([1, 2, 2, 3, 4, 30])
    words = [f"w{r.randrange(kinds)}" for _ in range(n)]
    for _ in range(r.randrange(3)):
        if n:
            a, p = r.randrange(n), 1 + r.randrange(max(1, n // 5))
            b = r.randrange(a, n) + 1
            words[a:b] = [words[min(a + (i - a) % p, n - 1)] for i in range(a, b)]
    return words


def plain_collapsed(words, runs):
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_against_all_periods():
    r = random.Random(2)
    for _ in range(400):
        texts = [[w.encode() for w in odd_words(r)] for _ in range(r.randrange(1, 6))]
        for words, runs in zip(texts, periodic.texts_runs(texts), strict=True):
            assert sorted(map(tuple, runs.tolist())) == plain_runs(words)


def test_runs_by_blocks(monkeypatch):
    r = random.Random(3)
    monkeypatch.setattr(periodic, "PLACES", 5)
    for _ in range(60):
        words = [w.encode() for w in odd_words(r)]
        assert sorted(map(tuple, periodic.texts_runs([words])[0].tolist())) == plain_runs(words)


def test_a_very_long_run():
    runs = periodic.runs_of(np.arange(400_000) % 7919)
    assert runs.tolist() == [[0, 400_000, 7919]]
    assert periodic.runs_of(np.zeros(100_000, np.int64)).tolist() == [[0, 100_000, 1]]


def words_of(text):
    return (text or "").encode().split()


def test_periodic_runs_of_documents(spark, odd):
    r = random.Random(4)
    more = spark.createDataFrame([(1000 + k, "\t".join(odd_words(r)) + " \n") for k in range(80)], "doc_id long, text string")
    for docs in (odd, more, more.limit(0)):
        want = Counter()
        for x in docs.select("doc_id", "text").collect():
            words = [w.decode() for w in words_of(x.text)]
            runs = plain_runs(words) if len(words) < 2000 else None
            want[x.doc_id, tuple(runs) if runs is not None else None, plain_collapsed(words, runs) if runs is not None else None] += 1
        got = Counter()
        for x in periodic.periodic_runs(docs).collect():
            runs = tuple(map(tuple, x.runs))
            long = (x.doc_id, None, None) in want
            got[(x.doc_id, None, None) if long else (x.doc_id, tuple(sorted(runs)), x.collapsed)] += 1
            assert list(runs) == sorted(runs, key=lambda q: (q[0], q[2]))
        assert got == want


def test_periodic_query(spark, tmp_path):
    r = random.Random(6)
    rows = [(k, " ".join(odd_words(r))) for k in range(-20, 380)] + [(None, "a " * 9), (None, None), (7, None), (8, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    changed = 0
    for i, text in rows:
        words, n = [w.decode() for w in words_of(text)], len(words_of(text))
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
            changed += 1
        runs = sorted(plain_runs(words), key=lambda q: (q[0], q[2]))
        top = max(runs, key=lambda q: (Fraction(q[1], q[2]), -q[0], -q[2]), default=(None, None, None))
        want[i, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(plain_collapsed(words, runs))] += 1
    assert changed > 20 and Counter(map(tuple, periodic.query(spark, str(tmp_path)).collect())) == want


def test_strongest_of_equals_is_the_first(spark):
    runs = "array(named_struct('start', 0L, 'length', 8L, 'period', 2L), named_struct('start', 1L, 'length', 13L, 'period', 3L), named_struct('start', 5L, 'length', 26L, 'period', 6L))"
    assert spark.range(1).select(periodic.strongest(F.expr(runs)).alias("t")).first().t.start == 1


def test_odd_vectors_have_links():
    assert sum(n for (_, n, _, _), _ in plain_links([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], k) for i, v, k in odd_vectors()]).items()) > 50
