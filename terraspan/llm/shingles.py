"""Pairs of texts whose sets of word shingles are similar, all of them, by a prefix join.

Each text gives its first shingles in one order that all texts share (common ones last), so many that two similar texts
share one. Of the pairs that meet so, those are ruled out whose sizes, places in the order, or parity bits are too far
apart; none of these tests can rule out a similar pair. Every pair left is verified on the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraspan.llm import common
from terraspan.llm.words import Hasher, U, spans

#: Neighbours in size that a text is compared with, among those that share a shingle, before components are formed.
FIRST = 4
#: One of SAMPLE texts tells which shingles are common: those in COMMON or more of them, LATE at most. They only set the
#: order of a text's shingles; any order finds all pairs.
SAMPLE, COMMON, LATE = 16, 8, 100_000
#: Rows of a shingle from which on only those without the root of most are paired with others one by one.
LARGE = 64
#: Rows of such a shingle that each of those is paired with before all others: those in which it comes earliest.
CENTRAL = 8
#: Rows that are looked at together for pairs, at least.
ROWS = 1 << 15
#: Bytes of text whose shingles are worked out together.
STEP = 1 << 20
#: Rounding of the limits on sizes.
SLACK = 1e-9


@lru_cache(1)
def hasher() -> Hasher:
    return Hasher(3)


def shingle_sets(texts: list[bytes], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of neighbouring texts: the first one's place, their sorted distinct shingle hashes one set after the other, and the sets' sizes.

    A-Z are lower-cased. Of fewer words than a shingle has, the whole sequence is the one shingle; no words, no shingle.
    """
    at = 0
    while at < len(texts):
        to, size = at + 1, len(texts[at])
        while to < len(texts) and size + len(texts[to]) <= STEP:
            size += len(texts[to])
            to += 1
        data = np.frombuffer(b"\n".join(texts[at:to]).lower(), np.uint8)  # on bytes, lower() changes A-Z alone
        starts, lengths = spans(data)
        ends = np.cumsum([len(x) + 1 for x in texts[at:to]])
        words = np.diff(np.searchsorted(starts, ends), prepend=0)
        h = hasher().words(data, starts, lengths)
        last = np.cumsum(words)
        left = np.repeat(last, words) - np.arange(len(h))
        every, inside = hasher().windows(h, width), left[: max(0, len(h) - width + 1)] >= width
        short = np.flatnonzero((words > 0) & (words < width))
        sizes = np.where(words >= width, words - width + 1, words > 0)
        bounds = np.append(0, np.cumsum(sizes))
        out = np.empty(bounds[-1], U)
        long = np.ones(len(out), bool)
        long[bounds[short]] = False
        out[long] = every[inside]
        for k in short:
            out[bounds[k]] = hasher().windows(h[last[k] - words[k] : last[k]], int(words[k]))[0]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out[a:b].sort()
        new = np.ones(len(out), bool)
        new[1:] = out[1:] != out[:-1]
        new[bounds[:-1][sizes > 0]] = True
        yield at, out[new], np.diff(np.append(0, np.cumsum(new))[bounds])
        at = to


def jaccard(a: bytes, b: bytes, width: int) -> float:
    """Of the sets of word shingles; 1 if both have no words."""
    x, y = (next(shingle_sets([t], width))[1] for t in (a, b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def common_shingles(slim: DataFrame, width: int) -> np.ndarray:
    """Sorted hashes of the shingles that many texts of a sample have (slim: __row, __text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, hashes, _ in shingle_sets(common.texts(b.column(0)), width):
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], names=["h"])

    sample = slim.select("__text").where(F.pmod(F.xxhash64("__text"), F.lit(SAMPLE)) == 0)
    often = sample.mapInArrow(each, "h long").groupBy("h").count().where(F.col("count") >= COMMON)
    return np.sort(np.array([r.h for r in often.orderBy(F.desc("count"), "h").limit(LATE).collect()], np.int64).view(U))


def parity_bits(hashes: np.ndarray) -> np.ndarray:
    """A set's parity bits: each hash flips one of as many bits as the set has members, about.

    Two sets differ in as many members as their bits do, at least; sets with twice the bits are folded first.
    """
    bits = max(64, 1 << (len(hashes) - 1).bit_length()) if len(hashes) else 64
    odd = np.bincount((hashes & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def signatures(slim: DataFrame, width: int) -> DataFrame:
    """(row, n, bits): the size and the parity bits of each text's set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, hashes, sizes in shingle_sets(common.texts(b.column(1)), width):
                bits = [parity_bits(x) for x in np.split(hashes, np.cumsum(sizes)[:-1])]
                offsets = np.append(0, np.cumsum([len(x) for x in bits])).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(sizes)), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(bits)))], names=["row", "n", "bits"])

    return slim.select(F.col("__row").alias("row"), "__text").mapInArrow(run, "row long, n long, bits array<long>")


def prefixes(slim: DataFrame, width: int, similarity: float) -> DataFrame:
    """(h, size, row): each text's first shingles, so many that two similar texts share one of them.

    The order is by hash, common shingles last. Of n shingles a similar text shares n * similarity at least, so all but
    that many, and one more, are enough. size: the number of shingles and, in the lower 32 bits, the place in the order.
    """
    late = common_shingles(slim, width)
    maybe = np.zeros(1 << 22, bool)  # by the first bits of a hash: may it be a common one?
    maybe[(late >> U(42)).astype(np.int64)] = True
    packed = np.packbits(maybe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = np.unpackbits(packed).astype(bool)
        for b in batches:
            rows = b.column(0).to_numpy()
            for at, x, sizes in shingle_sets(common.texts(b.column(1)), width):
                last = maybe[(x >> U(42)).astype(np.int64)]
                if last.any():
                    some = x[last]
                    last[last] = late[np.minimum(np.searchsorted(late, some), len(late) - 1)] == some
                of = np.repeat(np.arange(len(sizes)), sizes)
                first = np.cumsum(sizes) - sizes
                if last.any():  # a set's common shingles go behind its others, both in order
                    rare = np.bincount(of[~last], minlength=len(sizes))
                    place = np.empty(len(x), np.int64)
                    place[~last] = np.arange(len(x) - last.sum()) - np.repeat(np.cumsum(rare) - rare, rare)
                    often = sizes - rare
                    place[last] = np.arange(last.sum()) - np.repeat(np.cumsum(often) - often, often) + rare[of[last]]
                else:
                    place = np.arange(len(x)) - first[of]
                enough = (sizes - np.ceil(similarity * sizes - SLACK) + 1).astype(np.int64)
                kept = place < enough[of]
                yield pa.RecordBatch.from_arrays([pa.array(x[kept].view(np.int64)), pa.array((sizes[of] << 32)[kept] + place[kept]), pa.array(rows[at + of[kept]])], names=["h", "size", "row"])
        common.give_back()

    return slim.select("__row", "__text").mapInArrow(run, "h long, size long, row long")


def candidates(posts: DataFrame, similarity: float, rest: bool = False, central: int | None = None) -> DataFrame:
    """(a, b, h, size) from prefixes(): pairs of rows that share a shingle, unless their sizes or its places rule out the similarity.

    First, a text is paired with the FIRST next larger ones of each shingle. If more can be paired, all rows of that shingle
    are returned, too (b is null), for the second time (rest): then all other pairs whose `root` differs are returned. A
    shingle whose rows have one root costs nothing then, and one with a root that most rows have only what the others need.

    With `central`, a row of a large shingle is paired with so many at most, and the rows of large shingles that have several
    roots are returned once more (b is null), for a last time without it. Near copies of one text are nearest to those with
    few edits of their own; in these a common shingle comes early. So most rows that belong to a large group join it by a few
    pairs, and only those that don't are compared with all.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("h", pa.int64()), ("size", pa.int64())])
    columns = ["h", "size", "row", *(["root"] if rest else [])]

    def out(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), *[pa.nulls(len(x), pa.int64())] * 2], schema=schema)

    def again(h: np.ndarray, size: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(row), pa.nulls(len(row), pa.int64()), pa.array(h), pa.array(size)], schema=schema)

    def across(h: np.ndarray, size: np.ndarray, row: np.ndarray, root: np.ndarray) -> Iterator[pa.RecordBatch]:
        """For rest: pairs of rows of different roots; of large shingles, those of each row that hasn't the root of most."""
        if not len(h):
            return
        starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        lengths = np.diff(starts, append=len(h))
        mixed = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
        few = np.repeat(mixed & (lengths <= LARGE), lengths)
        yield from pairs(h[few], size[few], row[few], root[few])
        if central is not None:
            more = np.repeat(mixed & (lengths > LARGE), lengths)
            yield again(h[more], size[more], row[more])
        for a, b in zip(starts[mixed & (lengths > LARGE)].tolist(), (starts + lengths)[mixed & (lengths > LARGE)].tolist(), strict=True):
            n, place, own, of = size[a:b] >> 32, size[a:b] & 0xFFFFFFFF, row[a:b], root[a:b]
            roots, times = np.unique(of, return_counts=True)
            other = of != roots[times.argmax()]
            for k in np.flatnonzero(other).tolist():
                to = np.arange(np.searchsorted(n, similarity * n[k] - SLACK), np.searchsorted(n, (n[k] + SLACK) / similarity, "right"))
                to = to[(of[to] != of[k]) & (np.abs(to - k) > FIRST) & (~other[to] | (to > k))]
                to = to[np.minimum(n[k] - place[k], n[to] - place[to]) >= similarity / (1 + similarity) * (n[k] + n[to]) - SLACK]
                if central is not None and len(to) > central:
                    to = to[np.argsort(place[to], kind="stable")[:central]]
                if len(to):
                    yield out(np.full(len(to), own[k]), own[to])

    def pairs(h: np.ndarray, size: np.ndarray, row: np.ndarray, root: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        n, place = size >> 32, size & 0xFFFFFFFF
        at, d = np.arange(len(h)), FIRST + 1 if rest else 1
        while True:
            at = at[: np.searchsorted(at, len(h) - d)]
            # within a shingle sizes ascend: one too large is followed by larger ones
            at = at[(h[at] == h[at + d]) & (n[at] >= similarity * n[at + d] - SLACK)]
            if not len(at) or (not rest and d > FIRST):
                break
            to = at + d
            ok = np.minimum(n[at] - place[at], n[to] - place[to]) >= similarity / (1 + similarity) * (n[at] + n[to]) - SLACK
            if rest:
                ok &= root[at] != root[to]
            x, y = row[at[ok]], row[to[ok]]
            if len(x):
                yield out(x, y)
            d += 1
        if len(at) and not rest:
            more = np.isin(h, np.unique(h[at]))
            yield again(h[more], size[more], row[more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = across if rest else pairs
        parts, rows = [], 0
        for b in batches:
            parts.append([x.to_numpy() for x in b.columns])
            rows += len(b)
            if rows >= ROWS:
                held = [np.concatenate(x) for x in zip(*parts, strict=True)]
                cut = np.searchsorted(held[0], held[0][-1])  # the last shingle's rows may go on
                yield from found(*(x[:cut] for x in held))
                parts, rows = [[x[cut:] for x in held]], len(held[0]) - cut
        if parts:
            yield from found(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        del parts
        common.give_back()

    return posts.select(*columns).repartition("h").sortWithinPartitions("h", "size", "row").mapInArrow(run, "a long, b long, h long, size long")


def not_ruled_out(pairs: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """The distinct pairs (a, b) whose parity bits (signatures()) allow for the similarity."""
    both = pairs.select("a", "b").distinct()
    for c in ("a", "b"):
        both = both.join(marks.select(F.col("row").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")), c)
    # sizes are close, so one side has twice the bits of the other at most
    half = lambda x: F.floor(F.size(x) / 2).cast("int")
    folded = lambda x, y: F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, 1, half(x)), F.slice(x, half(x) + 1, half(x)), lambda p, q: p.bitwiseXOR(q))).otherwise(x)
    apart = F.aggregate(F.zip_with(folded(F.col("bits_a"), F.col("bits_b")), folded(F.col("bits_b"), F.col("bits_a")), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, x: s + x)
    most = (1 - similarity) / (1 + similarity) * (F.col("n_a") + F.col("n_b")) + SLACK
    return both.where(apart <= most).select("a", "b")


def verified(pairs: DataFrame, rows: DataFrame, text: str, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of rows whose texts have the similarity. Only texts that stand in a pair are moved to pairs."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("__row")).distinct()
    texts_ = common.save(rows.select("__row", common.text_or_empty(text).alias("__text")).join(needed, "__row", "left_semi"), "texts")
    side = lambda c: texts_.select(F.col("__row").alias(c), F.col("__text").alias(f"__text_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "__text_a", "__text_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            near = pa.array([jaccard(p, q, width) >= similarity for p, q in zip(common.texts(x.column(2)), common.texts(x.column(3)), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(x.columns[:2], names=["a", "b"]).filter(near)
        common.give_back()

    return both.mapInArrow(compare, "a long, b long")
