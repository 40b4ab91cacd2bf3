"""Each operator against a plain version of the same rule."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from tokenizers import Tokenizer

from terraspan.llm import bpe, exact_dedup, licenses, packing, quality, sharding, shingles, simhash, substring_dedup, syncmers, tokens, wavelet
from tests.llm.conftest import CLASHING

TABLES = ["odd", "some"]
sha = lambda b: hashlib.sha256(b).hexdigest()


@pytest.fixture(params=TABLES)
def docs(request):
    return request.getfixturevalue(request.param)


@pytest.fixture(scope="module")
def tokenizer():
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    own.no_truncation()
    own.no_padding()
    return own


def rows_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def id_key(i):
    return (i is not None, i or 0)


def test_sharding(docs):
    out = sharding.shard_by_bytes(docs, shards=5).collect()
    rows = rows_of(docs)
    assert Counter((r.doc_id, r.text or "") for r in out) == Counter(rows)
    sizes, slots, texts = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in out:
        sizes[r.shard] += len((r.text or "").encode()) + 8
        slots[r.shard].append(r.slot)
        texts[r.text or ""].add(r.shard)
    assert set(sizes) <= set(range(5)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    largest, mean = max(len(t.encode()) + 8 for _, t in rows), sum(sizes.values()) / 5
    assert all(abs(s - mean) <= largest + mean * 0.01 for s in sizes.values())


def test_sharding_in_many_parts_and_a_hot_text(spark):
    docs = spark.createDataFrame([(i, "same text" if i % 3 == 0 else f"text {i} " * (i % 7)) for i in range(3000)], "doc_id long, text string")
    out = sharding.shard_by_bytes(docs, shards=6, part_bytes=4000).collect()
    sizes, slots = Counter(), defaultdict(list)
    for r in out:
        sizes[r.shard] += len(r.text) + 8
        slots[r.shard].append(r.slot)
    assert len(out) == 3000 and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(sizes.values()) / min(sizes.values()) < 1.03


def test_quality_learns_and_keeps_columns(spark, some):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality.fit(some, labels)
    held = quality.scored(some, model).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in held]) >= 0.9 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in held)
    assert {r.doc_id for r in held} == {r.doc_id for r in held if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}


def test_quality_fit_ignores_held_out_labels(spark, some):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    other = labels.withColumn("quality", quality.F.when(quality.held_out("doc_id"), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    assert np.array_equal(quality.fit(some, labels).weights, quality.fit(some, other).weights)


def test_quality_odd(spark, odd, empty):
    labels = spark.createDataFrame([(0, 1), (3, 0), (4, 1), (6, None), (None, 1), (999, 0), (0, 1)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    out = quality.scored(odd, model)
    assert out.count() == odd.count() and out.where("score is null or predicted is null or held_out is null").count() == 0
    assert quality.keep_good(odd, model).columns == odd.columns
    nothing = quality.fit(empty, labels)
    assert quality.scored(empty, nothing).count() == 0 and quality.keep_good(odd, nothing).count() == odd.count()


def check_pieces(out, rows, tokenizer, length):
    want = Counter((i, tuple(tokenizer.encode(t, add_special_tokens=False).ids + [2])) for i, t in rows)
    by_sequence, by_document = defaultdict(list), defaultdict(list)
    for r in out:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        assert r.length == len(r.ids) // 4
        by_document[r.doc_id, r.doc_tokens].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= length
    assert sum(len(x[1]) for p in by_document.values() for x in p) == sum(len(k[1]) * n for k, n in want.items())
    unique = {i: ids for (i, ids), n in want.items() if i is not None and sum(v for k, v in want.items() if k[0] == i) == 1}
    for (i, n), pieces in by_document.items():
        if i in unique:
            joined = [x for _, ids in sorted(pieces) for x in ids]
            assert tuple(joined) == unique[i] and len(joined) == n
    return sum(n for p in by_sequence.values() for _, n in p) / len(by_sequence) / length


def test_packing(docs, tokenizer):
    fill = check_pieces(packing.pack(docs, length=512).collect(), rows_of(docs), tokenizer, 512)
    assert fill > 0.9


def test_packing_beyond_the_open_windows(spark, tokenizer):
    docs = spark.createDataFrame([(i, "word " * (i * 37 % 200)) for i in range(900)], "doc_id long, text string").repartition(40)
    assert check_pieces(packing.pack(docs, length=256).collect(), rows_of(docs), tokenizer, 256) > 0.97


def test_exact_dedup(docs):
    rows = rows_of(docs)
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    keep = {t: max(x, key=id_key) for t, x in groups.items()}
    want, seen = Counter(), set()
    for i, t in sorted(rows, key=lambda x: (x[1], id_key(x[0]))):
        stays = i == keep[t] and (i, t) not in seen
        seen |= {(i, t)} if stays else set()
        want[i, keep[t], len(groups[t]), stays, sha(t.encode())] += 1
    assert Counter(tuple(r) for r in exact_dedup.decisions(docs).collect()) == want
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns and Counter((r.doc_id, r.text or "") for r in kept.collect()) == Counter((i, t) for t, i in keep.items())


def test_quotient_filters_round_trip_and_merge():
    r = np.random.default_rng(1)
    a, b = (np.unique(r.integers(0, 1 << 20, n)) for n in (5000, 300))
    ca, cb = r.integers(1, 600, len(a)), r.integers(1, 4, len(b))
    x, n = exact_dedup.filter_content(exact_dedup.filter_bytes(a, ca, 20), 20)
    assert np.array_equal(x, a) and np.array_equal(n, ca)
    fps, counts = exact_dedup.merged([(a, ca), exact_dedup.filter_content(exact_dedup.filter_bytes(b, cb, 20), 20)])
    want = Counter(dict(zip(a.tolist(), ca.tolist()))) + Counter(dict(zip(b.tolist(), cb.tolist())))
    assert dict(zip(fps.tolist(), counts.tolist())) == dict(want)


def test_wavelet_files(docs, tokenizer):
    each, base = wavelet.read_shards(wavelet.write_shards(docs))
    out = wavelet.with_starts(each, base).orderBy("start").collect()
    rows = sorted(rows_of(docs), key=lambda x: (id_key(x[0]), x[1]))
    at = 0
    for r, (i, t) in zip(out, rows, strict=True):
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens) == (i, at, len(ids)) and np.frombuffer(r.ids, "<u4").tolist() == ids
        at += len(ids)


def test_wavelet_questions(spark, some, tokenizer, monkeypatch):
    monkeypatch.setattr(wavelet, "SHARD", 2000)
    docs = some.limit(60)
    shards = wavelet.write_shards(docs).cache()
    line = [x for i, t in sorted(rows_of(docs)) for x in tokenizer.encode(t, add_special_tokens=False).ids + [2]]
    places = [0, 1, 1999, 2000, len(line) - 1, len(line), 5000 % len(line)]
    got = wavelet.tokens_at(shards, spark.createDataFrame([(p,) for p in places], "place long"))
    assert sorted(map(tuple, got.collect())) == sorted((p, line[p]) for p in places if p < len(line))
    assert shards.count() > 3
    common = [t for t, _ in Counter(line).most_common(3)]
    sums = wavelet.counts(shards, [*common, 49407]).groupBy("token").sum("n").collect()
    assert {r[0]: r[1] for r in sums} == {t: line.count(t) for t in [*common, 49407]}
    wanted = [(t, k) for t in common for k in (0, 5, line.count(t) - 1, line.count(t))]
    of = {t: [k for k, x in enumerate(line) if x == t] for t in common}
    assert sorted(map(tuple, wavelet.occurrences(shards, wanted).collect())) == sorted((t, k, of[t][k]) for t, k in wanted if k < len(of[t]))


def test_wavelet_matrix():
    x = np.random.default_rng(2).integers(0, 3000, 5000)
    m = wavelet.WaveletMatrix.from_bytes(b"12345678" + wavelet.WaveletMatrix.build(x, 12).to_bytes(), 8)
    assert np.array_equal(m.symbols(), x) and all(m.access(i) == x[i] for i in range(0, 5000, 37))
    for s in x[:40].tolist():
        places = np.flatnonzero(x == s)
        assert m.count(s) == len(places) and m.count(s, 100, 4000) == ((places >= 100) & (places < 4000)).sum()
        assert [m.occurrence(s, k) for k in range(len(places))] == places.tolist()
    assert m.count(4096) == 0
    with pytest.raises(IndexError):
        m.occurrence(int(x[0]), 10**6)
    assert len(wavelet.WaveletMatrix.build(x[:0], 12).symbols()) == 0


def test_bpe(docs, tokenizer):
    want = Counter((i, tuple(tokenizer.encode(t, add_special_tokens=False).ids)) for i, t in rows_of(docs))
    coded = bpe.encode(docs)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in coded.collect()) == want
    assert Counter((r.doc_id, r.text) for r in bpe.decode(coded).collect()) == Counter((i, tokenizer.decode(list(ids), skip_special_tokens=False)) for i, ids in want.elements())
    digest = Counter((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tokenizer.decode(list(ids), skip_special_tokens=False).encode())) for i, ids in want.elements())
    assert Counter(tuple(r) for r in bpe.round_trip(docs).collect()) == digest


@pytest.mark.parametrize("text", ["don't stop", "Straße ÀÉ", "a<|endoftext|>b <|startoftext|>", "x" * 3000, " nbsp em", "é ́", "中文，字", "1234.5-6", "퟿🙂🙂", "it's we'll 's", "\x1c\x85 a\x00b", "ﬁ Ⅷ ½"])
def test_bpe_odd_texts(text, tokenizer):
    encoder, decoder = bpe.codec(public_tokenizers.path("word_bpe_49k.json"))
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    got = encoder.ids(text.encode())
    assert tokens.library_encoder(public_tokenizers.path("word_bpe_49k.json")).ids(text.encode()) == got
    assert np.frombuffer(got, "<u4").tolist() == ids and b"".join(decoder.pieces(got)).decode() == tokenizer.decode(ids, skip_special_tokens=False)


def plain_licenses(rows):
    """Counter of (doc_id, n_lines, licenses, whole_license), text by text."""

    def canonical(line):
        line = line.lower()
        for a, b in licenses.SPELLINGS:
            line = line.replace(a, b)
        return regex.sub(r"[^\p{L}\p{N}]+", " ", line).strip()

    def units(text):
        lines = [(x, canonical(x)) for x in text.split("\n")]
        names = lambda x, f: re.search(licenses.HOLDER, x.lower()) or (re.search(licenses.NAMED, f) and not re.search(licenses.NOT_NAMED, f))
        return [f for _, f in lines if f], " ".join(f for x, f in lines if f and not names(x, f))

    known, several = {}, {}
    for name, text in licenses.every_text():
        form = units(text)[1] if "\n" in text.strip() else units(text)[0][0]
        known[form] = min(name, known.get(form, name))
        several[form] = several.get(form, False) or "\n" in text.strip()
    want = Counter()
    for i, t in rows:
        lines, whole = units(t)
        hits = [known[x] for x in lines if x in known]
        inside = {known[x] for x, more in several.items() if more and f" {x} " in f" {whole} "}
        want[i, len(hits), ",".join(sorted({*hits, *inside} | ({known[whole]} if whole in known else set()))), known.get(whole)] += 1
    return want


def planted_licenses():
    """Every known text by itself, within others, with its lines broken elsewhere, with holders of all kinds, in capitals, and cut short."""
    rows = []
    for k, (_, t) in enumerate(licenses.every_text()):
        w = t.split()
        broken = " ".join(w) if k % 3 else "\n".join(" ".join(w[i : i + 9]) for i in range(0, len(w), 9))
        rows += [t, f"Some words before.\n{t}\nand after it", f"intro text {broken} end", f"Copyright (c) 2020 Jane Doe\n{t.upper()}", f"copyright jane doe\n\n{t}", "© Jane\n" + t.replace("license", "licence"), t[:-20]]
    mit = next(t for n, t in licenses.full_texts() if n == "MIT")
    rows += [f"The MIT License (MIT)\n\nCopyright (c) 2015 X\n\n{mit}", "Licensed under the MIT License. See LICENSE for details.", "", "copyright law\nMIT", f"MIT License {mit} {dict(licenses.full_texts())['GPL-3.0']}"]
    return list(enumerate(rows))


def test_licenses(spark, docs):
    assert Counter(tuple(r) for r in licenses.scan(docs).collect()) == plain_licenses(rows_of(docs))


def test_planted_licenses_by_a_plain_version_and_by_sql(spark, tmp_path):
    rows = planted_licenses()
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in licenses.scan(table).collect())
    assert got == plain_licenses(rows) and sum(n for (_, _, found, _), n in got.items() if found) > 450
    of = {r[0]: r[1:] for r in got}
    last = len(rows) - 5
    assert [of[last + k] for k in range(5)] == [(0, "MIT", "MIT"), (1, "MIT", "MIT"), (0, "", None), (0, "", None), (0, "GPL-3.0,MIT", None)]
    table.write.parquet(f"{tmp_path}/documents.parquet")
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    names = [d[0] for d in con.sql(licenses.SQL).description]
    assert names == ["doc_id", "n_lines", "licenses", "whole_license"] and Counter(con.sql(licenses.SQL).fetchall()) == got


def test_full_licenses_whole_and_inside(spark):
    full = dict(licenses.full_texts()[:11])
    mit = licenses.KNOWN[4][1]
    rows = [("© 2020 X\n" + mit, "MIT", "MIT"), ("Copyright (c) X\n" + mit, "MIT", "MIT"), ("Copyright X 2020\n" + mit, "MIT", "MIT"), ("Copyright Jane Doe\n" + mit, "MIT", "MIT"), ("Автор All rights reserved. Иван", "", None)]
    rows += [(t, n, n) for n, t in full.items()]
    rows += [("# code\n" + "\n".join("# " + x for x in t.split("\n")) + "\nx = 1", n, None) for n, t in [*full.items(), ("MIT", mit)]]
    rows += [(full["GPL-2.0"][:9000], "", None), ("All rights reserved.", "Proprietary", "Proprietary")]
    out = licenses.scan(spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(rows)], "doc_id long, text string")).collect()
    # the line "All rights reserved." is a notice by itself, within a licence too
    want = {k: (f"{a},Proprietary" if a and a != "Proprietary" and re.search(r"^[\W_]*All rights reserved\W*$", t, re.M | re.I) else a, b) for k, (t, a, b) in enumerate(rows)}
    assert {r.doc_id: (r.licenses, r.whole_license) for r in out} == want


def test_license_of_a_whole_text(spark):
    text = "Copyright (c) 2019 Someone\n" + licenses.KNOWN[4][1].replace("sublicense", "sub-license").upper()
    out = licenses.scan(spark.createDataFrame([(1, text), (2, "MIT")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.whole_license) for r in out} == {(1, "MIT"), (2, None)}


def removed(rows, width):
    """rows in order; the words that stay, and how many there were."""
    seen, out = set(), []
    for _, t in rows:
        words = t.encode().split()
        gone = set()
        for k in range(len(words) - width + 1):
            w = tuple(words[k : k + width])
            if w in seen:
                gone.update(range(k, k + width))
            seen.add(w)
        out.append((words, gone))
    return out


def test_substring_dedup(docs, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK", 20_000)  # many blocks
    rows = sorted(rows_of(docs), key=lambda x: (id_key(x[0]), x[1].encode()))
    want = Counter((i, len(w), len(g), b" ".join(x for k, x in enumerate(w) if k not in g).decode()) for (i, _), (w, g) in zip(rows, removed(rows, 20), strict=True))
    out = substring_dedup.remove_repeats(docs)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out.select("doc_id", "n_words", "n_removed", "kept_text").collect()) == want
    plain = substring_dedup.without_repeats(docs)
    assert plain.columns == docs.columns and plain.count() == docs.count()
    originals = Counter(t for _, t in rows)
    for r in plain.collect():  # a text that lost nothing is the one that came
        if (r.text or "") not in originals:
            assert r.n_chars == len(r.text)


def test_syncmers(docs):
    rows = sorted(rows_of(docs), key=lambda x: id_key(x[0]))
    out = syncmers.fingerprints(docs).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows)
    texts = dict(rows)
    if len(texts) == len(rows):
        order = [i for i, _ in rows]
        for r in out:
            t, n = texts[r.doc_id], texts[order[(order.index(r.doc_id) + 1) % len(order)]]
            assert r.n_chars == len(t) and r.edited_sha256 == sha((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode())
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    of = defaultdict(set)
    for r in out:
        if r.doc_id is not None and Counter(i for i, _ in rows)[r.doc_id] == 1:
            of[texts[r.doc_id]].add(r.fingerprint)
    assert all(len(x) == 1 for x in of.values())


def spark_hash(*values):
    """Spark's xxhash64 of strings' bytes and longs, one after the other."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else v.to_bytes(8, "little", signed=True), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain_anchors(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    line = [1, 2, 3, *(spark_hash(w.encode()) for w in words)] if words else []
    p = [spark_hash(a, b) for a, b in zip(line, line[1:])]
    return [(i, spark_hash(p[i], p[i + 2])) for i in range(len(p) - 2) if min(p[i], p[i + 2]) <= p[i + 1]]


def plain_sketch(text):
    return sorted({(h & (1 << 64) - 1) >> 32 for _, h in plain_anchors(text)})[: syncmers.SKETCH]


def plain_likeness(a, b):
    least = sorted({*a, *b})[: syncmers.SKETCH]
    return 2 * len({*a} & {*b} & {*least}) / (len({*a} & {*least}) + len({*b} & {*least})) if least else 1.0


def plain_placed(a, b):
    x, y = plain_anchors(a), plain_anchors(b)
    return 2 * len({*x} & {*y}) / (len(x) + len(y)) if x or y else 1.0


def test_syncmers_are_those_of_the_rule(spark, some):
    docs = some.limit(120)
    rows = sorted(rows_of(docs), key=lambda x: id_key(x[0]))
    want = {}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        s, e, n = map(plain_sketch, (t, edited, after))
        want[i] = len(t), sha(edited.encode()), "".join(f"{x:08x}" for x in s), "".join(f"{x:08x}" for x in e), plain_likeness(s, e), plain_likeness(s, n), plain_placed(t, edited)
    assert {r[0]: tuple(r[1:]) for r in syncmers.fingerprints(docs).collect()} == want


@pytest.mark.parametrize(("partitions", "range_"), [(3, 16 << 20), (4, 2000)])
def test_syncmers_in_many_ranges(spark, some, monkeypatch, partitions, range_):
    """The next document is found across ranges, counted ones and steps within them, wherever the cuts are."""
    monkeypatch.setattr(syncmers, "RANGE", range_)
    monkeypatch.setattr(syncmers, "COARSE", 5)
    monkeypatch.setattr(syncmers, "GROUP", 4)
    gaps = some.where("doc_id % 7 <> 3").withColumn("doc_id", syncmers.F.expr("if(doc_id > 100, doc_id * 1000003, doc_id)")).repartition(partitions)
    rows = sorted(rows_of(gaps), key=lambda x: id_key(x[0]))
    want = {i: sha((t[: len(t) - len(t) // 2] + rows[(k + 1) % len(rows)][1][: len(t) // 2]).encode()) for k, (i, t) in enumerate(rows)}
    assert {r.doc_id: r.edited_sha256 for r in syncmers.fingerprints(gaps).collect()} == want


def test_anchors_match_by_position(spark):
    r = np.random.default_rng(3)
    words = [f"w{x}" for x in r.integers(0, 400, 300)]
    moved = ["new"] * 17 + words[40:]
    rows = [(0, " ".join(words), " ".join(moved)), (1, " ".join(words), " ".join(words)), (2, " ".join(words), "nothing of this is there at all"), (3, None, "one two three"), (4, "", None)]
    out = {x.pair: x for x in syncmers.matched(spark.createDataFrame(rows, "pair int, left string, right string")).collect()}
    for k, a, b in rows:
        first = [{h: i for i, h in reversed(plain_anchors(t or ""))} for t in (a, b)]
        shifts = Counter(first[1][h] - i for h, i in first[0].items() if h in first[1])
        best = min(shifts.items(), key=lambda x: (-x[1], x[0])) if shifts else (None, 0)
        assert (out[k].n_left, out[k].n_right, out[k].shift, out[k].n_shift) == (len(first[0]), len(first[1]), *best)
    assert out[0].shift == -23 and out[0].n_shift > 100 and out[1].shift == 0


def test_syncmers_one_document(spark):
    out = syncmers.fingerprints(spark.createDataFrame([(7, "a b c d e f g h")], "doc_id long, text string")).collect()
    assert len(out) == 1 and out[0].near_next == 1 and out[0].edited_sha256 == sha(b"a b c d a b c d"[:0] + ("a b c d e f g h"[:8] + "a b c d e f g h"[:7]).encode())


def plain_simhash(t, width=3):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    if not words:
        return 0
    grams = [" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] or [" ".join(words)]
    bits = sum((np.array([xxhash.xxh64_intdigest(x.encode(), 42) >> b & 1 for b in range(64)]) for x in grams), np.zeros(64, int))
    return sum(1 << b for b in range(64) if bits[b] * 2 > len(grams))


def linked(values, budget):
    n, root = len(values), list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in np.flatnonzero(np.bitwise_count(values[a] ^ values[a + 1 :]) <= budget):
            root[max(find(a), find(a + 1 + int(b)))] = min(find(a), find(a + 1 + int(b)))
    return [find(x) for x in range(n)]


def test_simhash(docs):
    rows = sorted(rows_of(docs), key=lambda x: (x[0] is None, x[0] or 0))
    values = np.array([plain_simhash(t) for _, t in rows], np.uint64)
    root = linked(values, 3)
    want = Counter((i, f"{v:016x}", rows[r][0]) for (i, _), v, r in zip(rows, values.tolist(), root, strict=True))
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == want


def shingle_set(t, n=5):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def near_groups(rows, similarity=0.8):
    """The group of each row, by both rules: fingerprints within three bits, and similar sets of shingles."""
    values, sets = np.array([plain_simhash(t) for _, t in rows], np.uint64), [shingle_set(t) for _, t in rows]
    root = linked(values, 3)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if (not x and not y) or (x and y and len(x & y) >= similarity * len(x | y)):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(rows))]


def test_near_dedup(docs):
    rows = sorted(rows_of(docs), key=lambda x: (x[0] is None, x[0] or 0))
    root = near_groups(rows)
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text or "") for r in kept.collect()) == Counter(rows[r] for r in set(root))


def test_near_dedup_finds_edited_copies_and_keeps_others(spark):
    r = np.random.default_rng(4)
    base = [[f"w{x}" for x in r.integers(0, 3000, 250)] for _ in range(60)]
    edited = [[w if k % 60 else f"new{n}" for k, w in enumerate(words, 1)] for n, words in enumerate(base)]  # 4 of 250 words: 0.85
    other = [[w if k % 12 else f"other{n}" for k, w in enumerate(words, 1)] for n, words in enumerate(base[:20])]  # 0.4
    docs = spark.createDataFrame([(n, " ".join(w)) for n, w in enumerate(base + edited + other)], "doc_id long, text string")
    kept = {x.doc_id for x in simhash.near_dedup(docs).collect()}
    assert set(range(60)) <= kept and set(range(120, 140)) <= kept and len(kept & set(range(60, 120))) <= 3


@pytest.mark.parametrize("kind", ["appended", "truncated", "block"])
def test_near_dedup_finds_block_edits(spark, kind):
    r = np.random.default_rng(6)
    base = [[f"w{x}" for x in r.zipf(1.3, 150 + 10 * n) % 5000] for n in range(40)]
    new = lambda n: [f"new{x}" for x in r.integers(0, 5000, n)]
    edit = {"appended": lambda w: w + new(len(w) // 5 - 4), "truncated": lambda w: w[: -(len(w) // 6)], "block": lambda w: w[:40] + new(len(w) // 12 - 4) + w[40 + len(w) // 12 - 4 :]}[kind]
    rows = [(n, " ".join(w)) for n, w in enumerate(base + [edit(w) for w in base])]
    root = near_groups(rows)
    kept = {x.doc_id for x in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(root) and len(kept) <= 42


def test_near_dedup_goes_on_behind_failing_pairs(spark):
    r = np.random.default_rng(8)
    words = [f"w{x}" for x in range(200)]
    order = [words[x] for x in r.permutation(200)]
    trio = [words, order, order[:2] + order[3:6] + order[2:3] + order[6:]]  # one set of words; only the last two are near
    drift = [[f"d{x}" for x in range(300)]]
    for n in range(12):  # each is near the one before only
        drift.append([f"e{n}x{x}" if 25 * n <= x < 25 * n + 15 else w for x, w in enumerate(drift[-1])])
    shared = [f"s{x}" for x in range(150)]
    frames = [shared + [f"f{n}x{x}" for x in range(50)] for n in range(30)]  # 0.59 to each other
    copies = [f[:-1] + [f"end{n}"] for n, f in enumerate(frames[:10])]
    groups = [*trio, *drift, *frames, *copies]
    rows = [(n, " ".join(groups[k])) for n, k in enumerate([0, 1, 2, *(3 + r.permutation(len(groups) - 3)).tolist()])]
    root = near_groups(rows)
    assert root[1] == root[2] == 1 and len(set(root)) == 33
    assert {x.doc_id for x in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == set(root)


def test_pairs_of_a_shingle_in_many_texts(spark):
    n = 12
    posts = spark.createDataFrame([(7, (100 << 32) + 2, k) for k in range(n)] + [(8, (k << 32), k) for k in (10, 20, 40)], "h long, size long, row long")
    first = shingles.candidates(posts, 0.8).collect()
    near = {(r.a, r.b) for r in first if r.b is not None}
    assert near == {(a, b) for a in range(n) for b in range(a + 1, n) if b - a <= shingles.FIRST}
    more = spark.createDataFrame([(r.h, r.size, r.a, int(r.a > 5)) for r in first if r.b is None], "h long, size long, row long, root long")
    assert more.count() == n
    rest = {(r.a, r.b) for r in shingles.candidates(more, 0.8, rest=True).collect()}
    assert rest == {(a, b) for a in range(6) for b in range(6, n) if b - a > shingles.FIRST}


def test_pairs_across_roots_of_a_large_shingle(spark):
    r = np.random.default_rng(9)
    rows = sorted((9, (int(n) << 32) + int(p), k) for k, (n, p) in enumerate(zip(r.integers(90, 140, 150), r.integers(0, 12, 150), strict=True)))
    rows += [(10, (100 << 32) + k % 3, 1000 + k) for k in range(90)]
    roots = [int(r.choice([1, 1, 1, 1, 1, 1, 2, 3])) if h == 9 else 7 for h, _, _ in rows]
    posts = spark.createDataFrame([(*x, y) for x, y in zip(rows, roots, strict=True)], "h long, size long, row long, root long")
    want = set()
    for a in range(150):
        for b in range(a + shingles.FIRST + 1, 150):
            (n, p), (m, q) = (divmod(rows[k][1], 1 << 32) for k in (a, b))
            if roots[a] != roots[b] and n >= 0.8 * m - 1e-9 and min(n - p, m - q) >= 0.8 / 1.8 * (n + m) - 1e-9:
                want.add((min(rows[a][2], rows[b][2]), max(rows[a][2], rows[b][2])))
    got = [(x.a, x.b) for x in shingles.candidates(posts, 0.8, rest=True).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500


def test_a_large_group_of_near_copies_takes_few_pairs(spark, monkeypatch):
    r = np.random.default_rng(12)
    base, seen = [f"w{x}" for x in range(150)], []
    edits = [0, 0, *[1] * 100, *[2] * 80, *[3] * 60, *[4] * 30]  # of 150 words; 3 are near the unchanged ones, 4 hardly any
    rows = []
    for n, k in enumerate(edits):
        words = [f"end{n}" if not k and x == 149 else w for x, w in enumerate(base)]
        for x in r.choice(np.arange(8, 140, 9), k, replace=False):
            words[x] = f"new{n}x{x}"
        rows.append((int(r.integers(1 << 40)), " ".join(words)))
    rows.sort()
    not_ruled_out = simhash.not_ruled_out
    monkeypatch.setattr(simhash, "not_ruled_out", lambda pairs, *more: seen.append(pairs.distinct().count()) or not_ruled_out(pairs, *more))
    root = near_groups(rows)
    kept = {x.doc_id for x in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {rows[k][0] for k in set(root)} and len(kept) < 40
    assert sum(seen) < 4000, seen


def test_rows_of_a_large_shingle_meet_central_ones_first(spark):
    n, roots = 100, [7] * 80 + [k for k in range(80, 100)]
    posts = spark.createDataFrame([(9, (100 << 32) + (k * 7) % 10 + (k >= 80), k, root) for k, root in enumerate(roots)] + [(10, 100 << 32, k, root) for k, root in enumerate(roots[70:90], 70)] + [(11, 100 << 32, k, 7) for k in range(80)], "h long, size long, row long, root long")
    got = shingles.candidates(posts, 0.8, rest=True, central=3).collect()
    again = Counter((x.h, x.a) for x in got if x.b is None)
    assert again == Counter((9, k) for k in range(n))  # not those of small shingles, or of one root
    pairs = {(x.a, x.b) for x in got if x.b is not None}
    small = {(a, b) for a in range(70, 90) for b in range(max(80, a + shingles.FIRST + 1), 90)}
    assert small <= pairs and len(pairs - small) <= 20 * 3
    assert all(min((x * 7) % 10 for x in p if x < 80) == 0 for p in pairs - small if min(p) < 80)
    more = spark.createDataFrame([(x.h, x.size, x.a, roots[x.a]) for x in got if x.b is None], "h long, size long, row long, root long")
    last = {(x.a, x.b) for x in shingles.candidates(more, 0.8, rest=True).collect()}
    assert pairs - small <= last and len(last) > 1000


@pytest.mark.parametrize(("bits", "budget"), [(12, 1), (16, 3), (20, 2)])
def test_trie_join_in_subtries(spark, monkeypatch, bits, budget):
    """Dense values, cut in many subtries: the components are those of all pairs."""
    monkeypatch.setattr(simhash, "SUBTRIE", 20)
    r = np.random.default_rng(bits)
    values = np.unique(r.integers(0, 1 << bits, 700).astype(np.uint64) << np.uint64(64 - bits) | r.integers(0, 3, 700).astype(np.uint64))
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "__fp long")
    pairs = simhash.links(df, budget)
    assert all(bin((p.a ^ p.b) & (1 << 64) - 1).count("1") <= budget for p in pairs.collect())
    found = {r.node: r.root for r in simhash.components(pairs).collect()}
    root = linked(values, budget)
    mine = {}
    for k, v in enumerate(values.view(np.int64).tolist()):
        mine.setdefault(found.get(v, v), set()).add(root[k])
    assert all(len(x) == 1 for x in mine.values()) and len(mine) == len(set(root))


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(200, 200), (300, 301), (301, 300)]
    out = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {out[k] for k in range(61)} == {0} and {out[k] for k in range(100, 160)} == {100} and out[301] == 300


@pytest.mark.parametrize("run", [
    lambda d: sharding.shard_by_bytes(d), lambda d: packing.pack(d), exact_dedup.decisions, exact_dedup.exact_dedup, lambda d: wavelet.read_shards(wavelet.write_shards(d))[0], bpe.encode, bpe.round_trip, licenses.scan,
    substring_dedup.remove_repeats, substring_dedup.without_repeats, syncmers.fingerprints, simhash.near_duplicates, simhash.near_dedup,
])
def test_empty_tables(empty, run):
    assert run(empty).collect() == []


def test_clashing_names_are_kept(odd):
    assert set(CLASHING) <= set(odd.columns)
    for out in (exact_dedup.exact_dedup(odd), simhash.near_dedup(odd), substring_dedup.without_repeats(odd)):
        rows = {r.doc_id: r for r in out.where("doc_id = 3").collect()}
        assert out.columns == odd.columns and all(rows[3][c] == f"{c}3" for c in CLASHING)
