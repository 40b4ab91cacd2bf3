"""Token ids in wavelet matrices, one file a shard.

A shard file holds the ids of neighbouring documents, in ascending doc_id order. The matrix keeps the ids as bit planes,
the highest bit first, each plane stably parted by the one before; ranks at block bounds make rank and select one
lookup and a count within a block. So one file gives single tokens, counts of an id in a range, and the places of its
occurrences, without the tokens being unpacked. In the file each plane is compressed by itself.

tokens_at(), counts() and occurrences() ask all shards at once; a question goes to the shard that can answer it.

Files are the rows of a table in the shared folder, so that any store Spark writes to will do; each row's bytes are a
file by itself (see ShardFile).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraspan.llm import common
from terraspan.llm.tokens import END, library_encoder, vocabulary_path

MAGIC = b"WMTX0001"
#: Bits between kept ranks.
BLOCK = 512
#: Tokens in a shard, about; a longer document is a shard by itself.
SHARD = 1 << 20
#: Documents in a range, which one task encodes, about.
RANGE = 1 << 14


class WaveletMatrix:
    """Bit planes with ranks, over n symbols of so many bits."""

    def __init__(self, n: int, planes: np.ndarray, ranks: np.ndarray, zeros: np.ndarray):
        self.n, self.planes, self.ranks, self.zeros = n, planes, ranks, zeros

    @classmethod
    def build(cls, symbols: np.ndarray, bits: int) -> WaveletMatrix:
        """symbols: unsigned, each under 2**bits."""
        now, n = symbols.astype(np.uint16 if bits <= 16 else np.uint32), len(symbols)
        width = -(-n // BLOCK) * (BLOCK // 8)
        planes, ranks, zeros = np.zeros((bits, width), np.uint8), np.zeros((bits, width * 8 // BLOCK + 1), np.uint32), np.zeros(bits, np.uint64)
        for level in range(bits):
            bit = (now >> now.dtype.type(bits - 1 - level)) & now.dtype.type(1) != 0
            own = np.packbits(bit)
            planes[level, : len(own)] = own
            np.cumsum(np.bitwise_count(planes[level].view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1), out=ranks[level, 1:])
            zeros[level] = n - int(ranks[level, -1])
            if 0 < zeros[level] < n:
                now = np.concatenate([now[~bit], now[bit]])
        return cls(n, planes, ranks, zeros)

    def ones(self, level: int, at: int) -> int:
        """Ones among the first `at` bits of a plane."""
        block = at // BLOCK
        rest = self.planes[level, block * BLOCK // 8 : -(-at // 8)]
        return int(self.ranks[level, block]) + int(np.unpackbits(rest, count=at - block * BLOCK).sum())

    def bit(self, level: int, at: int) -> int:
        return int(self.planes[level, at // 8]) >> (7 - at % 8) & 1

    def access(self, at: int) -> int:
        """The symbol at a place."""
        value = 0
        for level in range(len(self.planes)):
            one = self.bit(level, at)
            value = value << 1 | one
            before = self.ones(level, at)
            at = int(self.zeros[level]) + before if one else at - before
        return value

    def _range(self, symbol: int, low: int, high: int) -> tuple[int, int]:
        bits = len(self.planes)
        for level in range(bits):
            a, b = self.ones(level, low), self.ones(level, high)
            low, high = (int(self.zeros[level]) + a, int(self.zeros[level]) + b) if symbol >> (bits - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def count(self, symbol: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences of a symbol in places low to high."""
        if symbol >> len(self.planes):
            return 0
        a, b = self._range(symbol, low, self.n if high is None else high)
        return b - a

    def _select(self, level: int, one: int, k: int) -> int:
        """The place of the k-th (from 0) one or zero of a plane."""
        have = self.ranks[level].astype(np.int64) if one else np.arange(self.ranks.shape[1]) * BLOCK - self.ranks[level].astype(np.int64)
        block = int(np.searchsorted(have, k, "right")) - 1
        own = np.unpackbits(self.planes[level, block * BLOCK // 8 : (block + 1) * BLOCK // 8])
        return block * BLOCK + int(np.flatnonzero(own == one)[k - int(have[block])])

    def occurrence(self, symbol: int, k: int) -> int:
        """The place of the k-th occurrence (from 0) of a symbol."""
        low, high = self._range(symbol, 0, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        at, bits = low + k, len(self.planes)
        for level in reversed(range(bits)):
            one = symbol >> (bits - 1 - level) & 1
            at = self._select(level, one, at - int(self.zeros[level]) if one else at)
        return at

    def symbols(self) -> np.ndarray:
        """All symbols, from the lowest plane up."""
        bits = len(self.planes)
        kind = np.uint16 if bits <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for level in reversed(range(bits)):
            one = np.unpackbits(self.planes[level], count=self.n).astype(bool)
            zeros = int(self.zeros[level])
            if zeros == self.n:
                continue
            up = np.empty(self.n, kind)
            up[~one] = now[:zeros]
            up[one] = now[zeros:] | kind(1 << (bits - 1 - level))
            now = up
        return now

    def to_bytes(self) -> bytes:
        head = np.array([self.n, len(self.planes)], "<u8").tobytes() + self.zeros.astype("<u8").tobytes()
        planes = [zstandard.compress(p.tobytes(), 1) for p in self.planes]
        return head + np.array([len(p) for p in planes], "<u8").tobytes() + self.ranks.astype("<u4").tobytes() + b"".join(planes)

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> WaveletMatrix:
        n, bits = (int(x) for x in np.frombuffer(data, "<u8", 2, at))
        width = -(-n // BLOCK)
        zeros = np.frombuffer(data, "<u8", bits, at + 16)
        sizes = np.frombuffer(data, "<u8", bits, at + 16 + 8 * bits).astype(np.int64)
        at += 16 + 16 * bits
        ranks = np.frombuffer(data, "<u4", bits * (width + 1), at).reshape(bits, width + 1)
        ends = at + ranks.nbytes + np.cumsum(sizes)
        planes = b"".join(zstandard.decompress(data[b - size : b]) for size, b in zip(sizes.tolist(), ends.tolist(), strict=True))
        return cls(n, np.frombuffer(planes, np.uint8).reshape(bits, width * (BLOCK // 8)), ranks, zeros)


class ShardFile:
    """One file: magic, length of the index, the index (doc ids, a flag for null ids, ends of documents), the matrix."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a shard file")
        size = int.from_bytes(data[8:16], "little")
        index = zstandard.decompress(data[16 : 16 + size])
        n = len(index) // 17
        self.ids, self.null, self.ends = np.frombuffer(index, "<i8", n), np.frombuffer(index, np.uint8, n, 8 * n).astype(bool), np.frombuffer(index, "<u8", n, 9 * n).astype(np.int64)
        self.matrix = WaveletMatrix.from_bytes(data, 16 + size)

    @staticmethod
    def written(ids: list[int | None], lengths: list[int], symbols: np.ndarray, bits: int) -> bytes:
        index = np.array([i or 0 for i in ids], "<i8").tobytes() + bytes(i is None for i in ids) + np.cumsum(np.array(lengths, "<u8"), dtype="<u8").tobytes()
        index = zstandard.compress(index, 3)
        return MAGIC + len(index).to_bytes(8, "little") + index + WaveletMatrix.build(symbols, bits).to_bytes()


@lru_cache(1)
def symbol_bits(path: str) -> int:
    return max(1, (library_encoder(path).tokenizer.get_vocab_size() - 1).bit_length())


def write_shards(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Write the shard files of docs and return their table: part, number (files go by both), n_tokens, n_docs, file.

    Each document's ids (null text: none) are followed by the end id. Documents are in ascending doc_id order, null
    ids first, rows of one id by their text; doc_id is a whole number. Other columns are ignored; an empty table gives
    no files.
    """
    path = vocabulary or vocabulary_path()
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("__id"), common.text_or_empty(text).alias("__text"))
    # counted without the texts; a range of long ones is sorted on disk, and encoded as it is read
    ordered = rows.repartitionByRange(max(common.shuffle_partitions(spark), docs.count() // RANGE), "__id").sortWithinPartitions("__id", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, bits, part, number = library_encoder(path), symbol_bits(path), TaskContext.get().partitionId(), 0
        end = np.array([END], "<u4").tobytes()
        ids, parts, total = [], [], 0

        def close() -> pa.RecordBatch:
            file = ShardFile.written(ids, [len(x) // 4 for x in parts], np.frombuffer(b"".join(parts), "<u4"), bits)
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([number]), pa.array([total]), pa.array([len(ids)]), pa.array([file], pa.binary())], names=["part", "number", "n_tokens", "n_docs", "file"])

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), common.texts(b.column(1)), strict=True):
                own = encoder.ids(x) + end
                if ids and total + len(own) // 4 > SHARD:
                    yield close()
                    ids, parts, total, number = [], [], 0, number + 1
                ids.append(i)
                parts.append(own)
                total += len(own) // 4
        if ids:
            yield close()

    return common.save(ordered.mapInArrow(run, "part long, number long, n_tokens long, n_docs long, file binary"), "wavelet")


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document, from the files; start counts the ids of all documents before it."""
    base = bases(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, number, data in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                file = ShardFile(data)
                ids = file.matrix.symbols().astype("<u4").tobytes()
                starts = np.append(0, file.ends[:-1])
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part)), pa.array(np.full(n, number)), pa.array(file.ids, mask=file.null), pa.array(starts), pa.array(file.ends - starts), pa.array([ids[4 * a : 4 * b] for a, b in zip(starts.tolist(), file.ends.tolist(), strict=True)], pa.binary())],
                    names=["part", "number", "doc_id", "start", "n_tokens", "ids"],
                )

    each = shards.select("part", "number", "file").mapInArrow(run, "part long, number long, doc_id long, start long, n_tokens long, ids binary")
    return each, base


def bases(shards: DataFrame) -> DataFrame:
    """(part, number, __base): how many tokens are before each shard."""
    sizes = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.select("part", F.coalesce(F.sum("n").over(before("part")), F.lit(0)).alias("__part"))  # a row a partition
    within = shards.select("part", "number", F.coalesce(F.sum("n_tokens").over(before("part", "number")), F.lit(0)).alias("__within"))
    return within.join(parts, "part").select("part", "number", (F.col("__part") + F.col("__within")).alias("__base"))


def _asked(shards: DataFrame, questions: DataFrame, answer, schema: str) -> DataFrame:
    """What answer(matrix, table of questions) gives for each shard that is asked; a shard meets its questions in one group."""

    def run(key: tuple, files: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(files) or not len(asked):
            return pa.table({f.name: pa.array([], f.type) for f in kinds})
        return answer(ShardFile(files.column("file")[0].as_py()).matrix, asked)

    questions = questions.select(*(F.col(c).alias(c) for c in questions.columns))  # columns of its own, as both sides come from the shards
    kinds = pa.schema([(c.split()[0], pa.int64()) for c in schema.split(", ")])
    return shards.select("part", "number", "file").groupBy("part", "number").cogroup(questions.groupBy("part", "number")).applyInArrow(run, schema)


def tokens_at(shards: DataFrame, places: DataFrame) -> DataFrame:
    """(place, token) of places(place), counted over all documents; places beyond the end, and null ones, are left out."""
    base = bases(shards).join(shards.select("part", "number", "n_tokens"), ["part", "number"])
    spans = base.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("__base") / SHARD), F.floor((F.col("__base") + F.col("n_tokens") - 1) / SHARD))))
    own = places.select("place", F.floor(F.col("place") / SHARD).alias("__bin")).join(spans, "__bin").where("place >= __base and place < __base + n_tokens")

    def answer(matrix: WaveletMatrix, asked: pa.Table) -> pa.Table:
        at = (asked.column("place").to_numpy() - asked.column("base").to_numpy()).tolist()
        return pa.table({"place": asked.column("place"), "token": pa.array([matrix.access(k) for k in at], pa.int64())})

    return _asked(shards, own.select("part", "number", "place", F.col("__base").alias("base")), answer, "place long, token long")


def counts(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """(part, number, token, n): how often each of some tokens occurs in each shard."""
    wanted = sorted(set(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, number, data in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                n = [ShardFile(data).matrix.count(t) for t in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(n)), pa.array([number] * len(n)), pa.array(wanted, pa.int64()), pa.array(n, pa.int64())], names=["part", "number", "token", "n"])

    return shards.select("part", "number", "file").mapInArrow(run, "part long, number long, token long, n long")


def occurrences(shards: DataFrame, wanted: list[tuple[int, int]]) -> DataFrame:
    """(token, k, place): where the k-th occurrence (from 0) of a token is, over all documents; those that aren't there are left out."""
    per = counts(shards, [t for t, _ in wanted])
    w = Window.partitionBy("token").orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("__before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    asked = F.broadcast(shards.sparkSession.createDataFrame(list(wanted), "token long, k long"))
    own = per.join(asked, "token").where("k >= __before and k < __before + n").join(bases(shards), ["part", "number"])

    def answer(matrix: WaveletMatrix, asked: pa.Table) -> pa.Table:
        tokens, k, before, base = (asked.column(c).to_pylist() for c in ("token", "k", "before", "base"))
        return pa.table({"token": asked.column("token"), "k": asked.column("k"), "place": pa.array([b + matrix.occurrence(t, n - m) for t, n, m, b in zip(tokens, k, before, base, strict=True)], pa.int64())})

    return _asked(shards, own.select("part", "number", "token", "k", F.col("__before").alias("before"), F.col("__base").alias("base")), answer, "token long, k long, place long")


def with_starts(each: DataFrame, base: DataFrame) -> DataFrame:
    return each.join(base, ["part", "number"]).withColumn("start", F.col("start") + F.col("__base")).drop("part", "number", "__base")


def query(spark, sf_dir):
    each, base = read_shards(write_shards(common.documents(spark, sf_dir)))
    return with_starts(each.select("part", "number", "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")), base).select("doc_id", "start", "n_tokens", "ids_crc32")
