"""Substring deduplication by level-wise doubling.

Windows of a first length that occur more than once, and they alone, are extended to twice that length, and so on to
the full window. Of the full windows, those whose words also start earlier (lesser doc_id, or same document, earlier
start) are covered, and the words they cover are removed.

Documents are dealt once to blocks of neighbouring rows, in a table bucketed by block. A level then is: each block
sends, for every slice of the hash space, its sorted distinct window hashes (differences, packed); a slice finds which
of them other blocks have too, and answers each block with one bit a hash. The block table isn't shuffled again: the
answers come to its buckets, and a block meets its answers in one group. Hashes of inner levels are only as long as the
number of windows asks for, since a false repeat there costs work, not correctness; full windows are compared by 128 bits.

What is sent is at most one row for each distinct window of a block, and a task holds one block, or one slice, at a time.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraspan.llm import common
from terraspan.llm.words import Hasher, U, spans

#: Bytes of text in a block; a longer text is a block by itself.
BLOCK = 2 << 20
#: Bytes of text in a bucket of the block table, about.
BUCKET = 64 << 20
#: Buckets of the block table, at most: Spark has a limit of 100 000. Beyond it buckets are larger; a task holds one block at a time still.
BUCKETS = 50_000
#: Windows in a slice of the hash space, about, over all blocks.
SLICE = 2_000_000


def packed(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as differences, byte plane by byte plane, compressed."""
    gaps = np.diff(values, prepend=U(0)).astype("<u8")
    return zstandard.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel(), dtype=U)


def blocks(docs: DataFrame, text: str, size: int) -> tuple[DataFrame, str, str]:
    """The block table, bucketed by __block: the rows of docs, each with its block; its name in the catalogue, and its folder."""
    names, place = docs.columns, docs.columns.index(text)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 24, 0
        for b in batches:
            lengths = pc.binary_length(b.column(place)).fill_null(0).to_pylist()
            own = np.empty(len(lengths), np.int64)
            for k, n in enumerate(lengths):
                if held and held + n > BLOCK:
                    number, held = number + 1, 0
                held += n + 1
                own[k] = number
            yield pa.RecordBatch.from_arrays([pa.array(own), *b.columns], names=["__block", *names])

    spark, name = docs.sparkSession, f"substring_blocks_{uuid.uuid4().hex}"
    path = f"{common.shared_folder(spark)}/{name}"
    schema = T.StructType([T.StructField("__block", T.LongType()), *docs.schema.fields])
    docs.mapInArrow(deal, schema).write.bucketBy(min(BUCKETS, max(4, common.shuffle_partitions(spark), size // BUCKET)), "__block").option("path", path).saveAsTable(name)
    return spark.table(name), name, path


@dataclass(frozen=True)
class Plan:
    """How a run works; the same for all its blocks and passes."""

    id: str  # names of the columns
    text: str
    window: int
    levels: tuple[int, ...]
    bits: int  # of a hash of an inner level
    slices: int  # log2 of the slices of the hash space


class Block:
    """A block's words and what the answered levels tell of them; each pass works it out anew and alike."""

    def __init__(self, plan: Plan, table: pa.Table, answers: list[dict]):
        self.plan, self.answers, self.table = plan, answers, table
        ids, texts = table.column(plan.id).to_pylist(), common.texts(table.column(plan.text))
        # null ids come first; rows of one id go by their text, so that the order doesn't depend on how they came
        self.order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0, texts[k]))
        self.ids, self.texts = [ids[i] for i in self.order], [texts[i] for i in self.order]
        ends = np.cumsum([len(x) + 1 for x in self.texts])
        data = np.frombuffer(b"\n".join(self.texts), np.uint8)
        starts, lengths = spans(data)
        self.counts = np.diff(np.searchsorted(starts, ends), prepend=0)
        self.hashes = hasher(1).words(data, starts, lengths)
        self.second = hasher(2).words(data, starts, lengths) if answers else self.hashes[:0]
        self.left = np.repeat(np.cumsum(self.counts), self.counts) - np.arange(len(self.hashes))  # words from here to the document's end
        self.flags, self.last = None, 0
        for level in plan.levels:
            bits = answered([x for x in answers if x["level"] == level])
            if bits is None:
                break
            start, h, values, times = self.inner(level)
            flags = np.zeros(len(self.hashes), bool)
            flags[start] = members(values[(times > 1) | same_size(bits, values)], h, plan.bits)
            self.flags, self.last = flags, level

    def starts(self, level: int) -> np.ndarray:
        """Words at which a window of the level starts, if the windows of the last level in it are all repeated."""
        start = np.flatnonzero(self.left >= level)
        if self.flags is not None:
            for at in range(0, level, self.last):
                start = start[self.flags[start + at]]
        return start

    def inner(self, level: int) -> tuple[np.ndarray, ...]:
        """Starts of the windows and their hashes; the sorted distinct hashes, and how often each occurs."""
        start = self.starts(level)
        h = hasher(1).windows(self.hashes, level)[start] >> U(64 - self.plan.bits) if len(start) else np.zeros(0, U)
        ordered = np.sort(h)
        new = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(h) else start
        return start, h, ordered[new], np.diff(new, append=len(h))

    def outer(self) -> tuple[np.ndarray, ...]:
        """Starts of the full windows; of each distinct one, in the order of its two hashes: the hashes, its first start; and for each start the place of its hashes."""
        start = self.starts(self.plan.window)
        if not len(start):
            return start, self.hashes[:0], self.hashes[:0], start, start
        one, two = (hasher(k).windows(h, self.plan.window)[start] for k, h in ((1, self.hashes), (2, self.second)))
        by = np.lexsort((start, two, one))
        new = np.append(True, (one[by][1:] != one[by][:-1]) | (two[by][1:] != two[by][:-1]))
        back = np.empty(len(by), np.int64)
        back[by] = np.cumsum(new) - 1
        first = by[new]
        return start, one[first], two[first], start[first], back


@lru_cache(4)
def hasher(seed: int) -> Hasher:
    return Hasher(seed)


def answered(answers: list[dict]) -> np.ndarray | None:
    """The bits of a level's slices one after the other, as the sorted hashes follow each other. None: no answer."""
    if not answers:
        return None
    return np.concatenate([np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=x["n"]) for x in sorted(answers, key=lambda x: x["slice"])]).astype(bool)


def same_size(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    if len(bits) != len(values):
        raise ValueError(f"a block has {len(values)} hashes, its answers {len(bits)} bits")
    return bits


def by_block(table: DataFrame, known: DataFrame | None, plan: Plan, work, schema: str | T.StructType) -> DataFrame:
    """What work(number, Block) gives for each block, with its answers where there are any."""
    own = table.groupBy("__block")

    def run(key: tuple, rows: pa.Table, told: pa.Table | None = None) -> pa.Table:
        out = work(key[0].as_py(), Block(plan, rows, told.to_pylist() if told else []))
        common.give_back()
        return out

    if known is None:
        return own.applyInArrow(lambda key, rows: run(key, rows), schema)

    return own.cogroup(known.groupBy("__block")).applyInArrow(run, schema)


def sent(table: DataFrame, known: DataFrame | None, plan: Plan, level: int) -> DataFrame:
    """What blocks send: (__block, slice, data), the distinct window hashes of a level that fall in a slice; for full windows also their second hashes and first documents."""

    def send(number: int, block: Block) -> pa.Table:
        if level == plan.window:
            _, one, two, first, _ = block.outer()
            doc = np.searchsorted(np.cumsum(block.counts), first, "right")
            ids = np.array([np.iinfo(np.int64).min if i is None else i for i in block.ids], np.int64)
            at = (one >> U(64 - plan.slices)).astype(np.int64)
        else:
            one = block.inner(level)[2]
            at = (one >> U(plan.bits - plan.slices)).astype(np.int64)
        cuts = np.searchsorted(at, np.arange((1 << plan.slices) + 1))
        filled = np.flatnonzero(cuts[1:] > cuts[:-1])
        data = []
        for s in filled:
            own = slice(cuts[s], cuts[s + 1])
            body = packed(one[own])
            if level == plan.window:
                docs, of = np.unique(doc[own], return_inverse=True)
                parts = [body, two[own].tobytes(), zstandard.compress(ids[docs].tobytes(), 1), zstandard.compress(of.astype("<u4").tobytes(), 1)]
                body = np.array([len(x) for x in parts], "<u8").tobytes() + b"".join(parts)
            data.append(body)
        return pa.table({"__block": pa.array(np.full(len(filled), number)), "slice": pa.array(filled.astype(np.int32)), "data": pa.array(data, pa.binary())})

    return by_block(table, known, plan, send, "__block long, slice int, data binary")


def answer_inner(data: list[bytes], bits: int) -> list[np.ndarray]:
    """For each block's hashes, of so many bits: does another block have them too?"""
    lists = [unpacked(x) for x in data]
    every = np.concatenate(lists)
    every.sort()
    shared = np.unique(every[1:][every[1:] == every[:-1]])
    del every
    return [members(shared, x, bits) for x in lists]


def members(ordered: np.ndarray, x: np.ndarray, bits: int) -> np.ndarray:
    """Is each x, a number of so many bits, among the ordered ones? A table of first bits answers most without a search."""
    if not len(ordered):
        return np.zeros(len(x), bool)
    first = min(bits, len(ordered).bit_length() + 4)
    maybe = np.zeros(1 << first, bool)
    maybe[(ordered >> U(bits - first)).astype(np.int64)] = True
    out = maybe[(x >> U(bits - first)).astype(np.int64)]
    some = x[out]
    out[out] = ordered[np.minimum(np.searchsorted(ordered, some), len(ordered) - 1)] == some
    return out


def answer_full(data: list[bytes], blocks_: np.ndarray) -> list[np.ndarray]:
    """For each block's full windows: has another block an earlier start of the same words (lesser document; of one document's rows, lesser block)?"""
    ones, twos, ids = [], [], []
    for x in data:
        lengths, at, parts = np.frombuffer(x, "<u8", 4).astype(int), 32, []
        for n in lengths:
            parts.append(x[at : at + n])
            at += n
        ones.append(unpacked(parts[0]))
        twos.append(np.frombuffer(parts[1], U))
        ids.append(np.frombuffer(zstandard.decompress(parts[2]), np.int64)[np.frombuffer(zstandard.decompress(parts[3]), "<u4")])
    one, two, doc = map(np.concatenate, (ones, twos, ids))
    block = np.repeat(blocks_, [len(x) for x in ones])
    by = np.lexsort((block, doc, two, one))
    new = np.append(True, (one[by][1:] != one[by][:-1]) | (two[by][1:] != two[by][:-1]))
    later = np.empty(len(by), bool)
    later[by] = ~new
    return np.split(later, np.cumsum([len(x) for x in ones])[:-1])


def answers(messages: DataFrame, plan: Plan, level: int) -> DataFrame:
    """(__block, level, slice, n, bits): each block's answer of a level from each slice."""

    def run(key: tuple, sent_: pa.Table) -> pa.Table:
        blocks_, data = sent_.column("__block").to_numpy(), sent_.column("data").to_pylist()
        bits = answer_full(data, blocks_) if level == plan.window else answer_inner(data, plan.bits)
        n = len(bits)
        common.give_back()
        return pa.table({"__block": blocks_, "level": pa.array([level] * n, pa.int32()), "slice": pa.array([key[0].as_py()] * n, pa.int32()), "n": pa.array([len(x) for x in bits], pa.int32()), "bits": pa.array([np.packbits(x).tobytes() for x in bits], pa.binary())})

    return messages.groupBy("slice").applyInArrow(run, "__block long, level int, slice int, n int, bits binary")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 20, first: int = 10, digest: bool = False) -> DataFrame:
    """The documents with n_words, n_removed, and kept_text: the words that stay, joined by one space.

    Each word that a window of `window` words covers, whose words also start earlier (lesser doc_id, or same document,
    earlier start), is removed; windows are judged on the input. doc_id is a whole number; null ids come before all
    others. Rows that share an id count as one document after the other, so of repeated rows the first stays whole.
    Null and empty texts have no words; texts under `window` words keep all. `first` times a power of two is `window`.
    digest: kept_sha256 instead of kept_text, and of the columns of docs only doc_id. Columns that have the names of
    new ones are replaced. An empty table gives no rows. The result is written to the shared folder and read back.
    """
    levels = [first]
    while levels[-1] < window:
        levels.append(levels[-1] * 2)
    if levels[-1] != window:
        raise ValueError("window has to be first times a power of two")
    new = ("n_words", "n_removed", "kept_sha256" if digest else "kept_text")
    docs = docs.select(doc_id, text) if digest else docs.drop(*(c for c in new if c not in (doc_id, text)))
    docs = docs.withColumn(text, F.col(text).cast("string"))
    size = int(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)
    table, name, path = blocks(docs, text, size)
    slices = max(common.shuffle_partitions(docs.sparkSession), size // 6 // SLICE, 2).bit_length()
    plan = Plan(doc_id, text, window, tuple(levels[:-1]), min(64, max(20, (size // 4).bit_length()) + 10), slices)
    known = None
    for level in levels:
        told = common.save(answers(sent(table, known, plan, level), plan, level), "answers")
        known = told if known is None else known.unionByName(told)
    kept = [f for f in docs.schema.fields if not digest or f.name == doc_id]
    schema = T.StructType([*kept, T.StructField(new[0], T.LongType()), T.StructField(new[1], T.LongType()), T.StructField(new[2], T.StringType())])
    out = common.save(by_block(table, known, plan, lambda _, block: cut(block, plan, digest), schema), "substring")
    docs.sparkSession.sql(f"DROP TABLE {name}")
    common.discard(docs.sparkSession, path)  # the result is written, so nothing reads the blocks again
    return out


def cut(block: Block, plan: Plan, digest: bool) -> pa.Table:
    """The block's documents without their covered words."""
    start, _, _, firsts, back = block.outer()
    bits = answered([x for x in block.answers if x["level"] == plan.window])
    covered = np.zeros(len(block.hashes) + 1, np.int64)
    if len(start):
        here = start[same_size(bits, firsts)[back] | (firsts[back] != start)]
        np.add.at(covered, here, 1)
        np.add.at(covered, here + plan.window, -1)
    gone = np.cumsum(covered)[:-1] > 0
    ends = np.cumsum(block.counts)
    n = len(block.order)
    counts, removed, words = np.zeros(n, np.int64), np.zeros(n, np.int64), [None] * n
    for k, i in enumerate(block.order):
        own, flags = block.texts[k].split(), gone[ends[k] - block.counts[k] : ends[k]]
        counts[i], removed[i] = len(own), int(flags.sum())
        line = b" ".join([w for w, f in zip(own, flags.tolist(), strict=True) if not f] if removed[i] else own)
        words[i] = hashlib.sha256(line).hexdigest() if digest else line.decode()
    names = [plan.id] if digest else [c for c in block.table.column_names if c != "__block"]
    return pa.table([*(block.table.column(c) for c in names), pa.array(counts), pa.array(removed), pa.array(words, pa.string())], names=[*names, "n_words", "n_removed", "kept_sha256" if digest else "kept_text"])


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars", window: int = 20, first: int = 10) -> DataFrame:
    """The documents with their columns, the text cut as remove_repeats() says; n_chars, if docs has it, follows the text.

    A text of which nothing is removed stays as it is, white space and null included.
    """
    new = ("n_words", "n_removed", "kept_text")
    clash = {c: f"__own_{c}" for c in new if c in docs.columns and c not in (doc_id, text)}
    cut_ = remove_repeats(docs.withColumnsRenamed(clash), doc_id, text, window, first)
    changed = F.col("n_removed") > 0
    out = cut_.withColumn(text, F.when(changed, F.col("kept_text")).otherwise(F.col(text)))
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.when(changed, F.length(text)).otherwise(F.col(n_chars)).cast(docs.schema[n_chars].dataType))
    return out.drop(*new).withColumnsRenamed({v: k for k, v in clash.items()}).select(*docs.columns)


def query(spark, sf_dir):
    return remove_repeats(common.documents(spark, sf_dir), digest=True)


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM d),
s AS (SELECT doc_id, p, word, CASE WHEN count(*) OVER r = 20 THEN md5(string_agg(word, ' ') OVER r) END AS win FROM w
      WINDOW r AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
a AS (SELECT doc_id, p, word, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, p) > 1 AS again FROM s),
g AS (SELECT doc_id, p, word, max(again::INT) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 1 AS gone FROM a),
k AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
