"""Numbers of slices, ranges and buckets that follow the size: with tiny limits there are many, and results stay."""

from collections import Counter

from pyspark.sql import functions as F

from terraspan.llm import exact_dedup, substring_dedup, tokens, wavelet


def rows_of(out):
    return Counter(map(tuple, out.collect()))


def test_slices_follow_the_rows(odd, some, monkeypatch):
    for docs in (odd, some):
        whole = rows_of(exact_dedup.decisions(docs))
        monkeypatch.setattr(exact_dedup, "SLICE", 3)
        assert rows_of(exact_dedup.decisions(docs)) == whole
        monkeypatch.undo()


def test_ranges_follow_the_rows(some, monkeypatch):
    columns = lambda shards: rows_of(wavelet.with_starts(*wavelet.read_shards(shards)).select("doc_id", "start", "n_tokens", F.crc32("ids")))
    few = wavelet.write_shards(some)
    monkeypatch.setattr(wavelet, "RANGE", 9)
    many = wavelet.write_shards(some)
    n = some.count() // 9
    assert few.select("part").distinct().count() <= 4 and n * 0.7 <= many.select("part").distinct().count() <= n
    assert columns(many) == columns(few)


def test_buckets_are_bounded_and_follow_the_bytes(odd, monkeypatch):
    whole = rows_of(substring_dedup.remove_repeats(odd.select("doc_id", "text")))
    for bucket, most in ((500, 50_000), (500, 3)):
        monkeypatch.setattr(substring_dedup, "BUCKET", bucket)
        monkeypatch.setattr(substring_dedup, "BUCKETS", most)
        monkeypatch.setattr(substring_dedup, "BLOCK", 3000)
        assert rows_of(substring_dedup.remove_repeats(odd.select("doc_id", "text"))) == whole


def test_memory_of_pieces_is_bounded_by_bytes_and_keeps_no_long_ones(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBER_BYTES", 10_000)
    memory = tokens.Memory()
    for k in range(1000):
        assert memory.put(f"key{k}", b"1234" * (k % 5)) == b"1234" * (k % 5)
        held = sum(2 * len(a) + len(b) + tokens.EACH for g in (memory.young, memory.old) for a, b in g.items())
        assert held <= 20_000 + 1000 and memory.young[f"key{k}"] == b"1234" * (k % 5)
    assert memory.put("x" * 65, b"long") == b"long" and "x" * 65 not in memory.young
