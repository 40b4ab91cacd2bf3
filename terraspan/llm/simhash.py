"""SimHash near-duplicates by a self-join of the fingerprints' binary trie.

Fingerprints are made where the texts are and written once; after that only distinct fingerprints move. They are dealt to
subtries by some of their bits, in so many ways that each linked pair shares a subtrie, and so finely that each subtrie is
small (measured, not assumed). In a subtrie, pairs of nodes go down together, a bit at a time, carrying the bits that
differ so far; a pair over the budget is pruned, and so is a pair whose leaves are known to be one component. A task
returns a spanning forest, never all links of a group. Components of the forests are found by star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraspan.llm import common
from terraspan.llm.shingles import CENTRAL, candidates, not_ruled_out, prefixes, signatures, verified

#: Distinct fingerprints in a subtrie, at most, unless the cut is the finest; and in the subtries that a task joins, about.
SUBTRIE, TOGETHER = 5_000, 100_000
#: Fingerprints of a subtrie from which on single differing bits are looked up first.
DENSE = 256
SEED = 42
#: Shingles that are held as bits at a time.
STEP = 1 << 15
ONE = np.uint64(1)


def simhash(text: bytes, shingle: int = 3) -> int:
    """The 64-bit fingerprint of a whole text; 0 if it has no words.

    A-Z are lower-cased. Of fewer words than a shingle has, the whole sequence is the one shingle.
    """
    words = text.lower().split()  # on bytes, lower() changes A-Z alone
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, STEP):
        ones += np.unpackbits(hashes[i : i + STEP].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def with_simhash(docs: DataFrame, text: str = "text", shingle: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep and __fp, the fingerprint as a signed long."""
    slim = docs.select(*keep, common.text_or_empty(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash(x, shingle) for x in common.texts(b.column(len(keep)))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(fps)], names=[*keep, "__fp"])

    schema = slim.drop("__text").schema.add("__fp", "long")
    return slim.mapInArrow(run, schema)


class Forest:
    """Union-find over the positions of an array, with the least position as the root."""

    def __init__(self, n: int):
        self.root, self.edges = np.arange(n), []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join a[i] with b[i] for all i, in vectors; keep the pairs that joined two trees."""
        while len(a):
            x, y = self.root[a], self.root[b]
            differ = x != y
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            if not len(a):
                return
            high, low = np.maximum(x, y), np.minimum(x, y)
            chosen = np.unique(high, return_index=True)[1]
            self.edges.append((a[chosen], b[chosen]))
            self.root[high[chosen]] = low[chosen]
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def trie_join(values: np.ndarray, depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs that join all sorted distinct values that are linked, in each subtrie below the depth by itself.

    A pair's differing bits are at most the budget. The pairs make a forest with the components of all links.
    """
    forest = Forest(len(values))
    roots = np.flatnonzero(np.append(True, values[1:] >> np.uint64(64 - depth) != values[:-1] >> np.uint64(64 - depth)))
    ends = np.append(roots[1:], len(values))
    # cheap first links in large subtries: values that differ in one bit, so that dense clusters are one component early
    many = np.flatnonzero(np.repeat(ends - roots > DENSE, ends - roots))
    for k in range(64 - depth if len(many) else 0):
        other = values[many] ^ (ONE << np.uint64(k))
        at = np.minimum(np.searchsorted(values, other), len(values) - 1)
        hit = (values[at] == other) & (at > many)
        forest.join(many[hit], at[hit])
    roots, ends = roots[ends - roots > 1], ends[ends - roots > 1]
    # frontier: two nodes (ranges of positions) and the differing bits so far, taken last first to bound memory
    stack = [(depth, roots, ends, roots, ends, np.zeros(len(roots), np.int64))]
    while stack:
        d, al, ah, bl, bh, diff = stack.pop()
        if len(al) > 200_000:
            h = len(al) // 2
            stack += [(d, *(x[:h] for x in (al, ah, bl, bh, diff))), (d, *(x[h:] for x in (al, ah, bl, bh, diff)))]
            continue
        pair = (ah - al == 1) & (bh - bl == 1)
        if pair.any():
            a, b = al[pair], bl[pair]
            near = (np.bitwise_count(values[a] ^ values[b]) <= budget) & (a != b)
            forest.join(a[near], b[near])
            al, ah, bl, bh, diff = (x[~pair] for x in (al, ah, bl, bh, diff))
        # a pair of nodes whose leaves are one component has nothing to add
        if len(al):
            change = np.append(0, np.cumsum(forest.root[1:] != forest.root[:-1]))
            one = (change[ah - 1] == change[al]) & (change[bh - 1] == change[bl]) & (forest.root[al] == forest.root[bl])
            al, ah, bl, bh, diff = (x[~one] for x in (al, ah, bl, bh, diff))
        if not len(al):
            continue
        bit = np.uint64(63 - d)
        middle = lambda low, high, bit=bit: np.clip(np.searchsorted(values, (values[low] >> bit | ONE) << bit), low, high)
        am, bm = middle(al, ah), middle(bl, bh)
        same = (al == bl) & (ah == bh)
        nexts = [(al, am, bl, bm, diff, None), (am, ah, bm, bh, diff, None), (al, am, bm, bh, diff + 1, None), (am, ah, bl, bm, diff + 1, ~same)]
        parts = []
        for x, y, u, v, w, only in nexts:
            ok = (x < y) & (u < v) & (w <= budget)
            ok = ok if only is None else ok & only
            parts.append([z[ok] for z in (x, y, u, v, w)])
        stack.append((d + 1, *(np.concatenate(x) for x in zip(*parts, strict=True))))
    return tuple(np.concatenate(x) for x in zip(*forest.edges, strict=True)) if forest.edges else (roots[:0], roots[:0])


class Cut:
    """The 64 bits in so many blocks. A pair within the budget differs in that many blocks at most, so it agrees on all
    blocks of one of the choices; each choice makes a trie of its own, with the bits of its blocks first."""

    def __init__(self, blocks: int, budget: int):
        edges = [64 * k // blocks for k in range(blocks + 1)]
        self.choices = []
        for own in combinations(range(blocks), blocks - budget):
            order = [*own, *(k for k in range(blocks) if k not in own)]
            self.choices.append([(edges[k], edges[k + 1] - edges[k]) for k in order])
        self.agree = blocks - budget

    def depth(self, choice: int) -> int:
        return sum(n for _, n in self.choices[choice][: self.agree])

    def mask(self, choice: int) -> int:
        """Of the bits that a subtrie shares, as a signed long."""
        mask = sum(((1 << n) - 1) << (64 - at - n) for at, n in self.choices[choice][: self.agree])
        return mask - (1 << 64) if mask >> 63 else mask

    def moved(self, values: np.ndarray, choice: int) -> np.ndarray:
        out = np.zeros(len(values), np.uint64)
        for at, n in self.choices[choice]:
            out = out << np.uint64(n) | (values >> np.uint64(64 - at - n)) & np.uint64((1 << n) - 1)
        return out

    def dealt(self, fps: DataFrame) -> DataFrame:
        """(c, root, __fp): each fingerprint in its subtrie of each choice."""
        roots = F.array(*(F.struct(F.lit(c).alias("c"), F.col("__fp").bitwiseAND(F.lit(self.mask(c)).cast("long")).alias("root")) for c in range(len(self.choices))))
        return fps.select("__fp", F.explode(roots).alias("at")).select("at.c", "at.root", "__fp")


def links(fps: DataFrame, budget: int = 3) -> DataFrame:
    """A forest (a, b) with the components of all links between distinct fingerprints (column __fp, each once).

    Each fingerprint goes to as many subtries as the cut has choices: 4 for a budget of 3, 20 at most, by what the
    largest subtrie holds. A task joins whole subtries, about TOGETHER fingerprints in all.
    """
    finest = budget + 3
    for blocks in range(budget + 1, finest + 1):
        cut = Cut(blocks, budget)
        sizes = cut.dealt(fps).groupBy("c", "root").count().agg(F.max("count").alias("most"), F.sum("count").alias("n")).first()
        if blocks == finest or (sizes.most or 0) <= SUBTRIE:
            break
    tasks = max(-(-(sizes.n or 0) // TOGETHER), common.shuffle_partitions(fps.sparkSession))
    slices = -(-tasks // len(cut.choices))
    dealt = cut.dealt(fps).select("c", F.pmod(F.xxhash64("c", "root"), F.lit(slices)).alias("slice"), "__fp")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        c = key[0].as_py()
        values = table.column("__fp").to_numpy()
        moved = cut.moved(values.view(np.uint64), c)
        by = np.argsort(moved)
        a, b = trie_join(moved[by], cut.depth(c), budget)
        return pa.table({"a": values[by[a]], "b": values[by[b]]})

    return dealt.groupBy("c", "slice").applyInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, for all nodes of the edges (a, b).

    Large-star and small-star steps in turn (Kiveris et al., 2014); each round's edges are written, so that lineage
    stays short. A hub's neighbours are never gathered: a step needs only the least neighbour of each node.
    """
    now = common.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        small = common.save(small, "edges")
        # done when every node points to a node that points nowhere
        parents = small.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        again = small.join(parents.withColumnRenamed("a", "b"), "b", "left_semi").limit(1).count() or parents.where("n > 1").limit(1).count()
        if not again:
            return small.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(small.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        now = small


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, budget: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable).

    Null and empty texts have fingerprint zero, linked like any other. Null ids are larger than all others, so a
    component has a null id only if all its ids are null. Repeated rows each have their row. Other columns are ignored.
    """
    marked = common.save(with_simhash(docs, text, shingle, (doc_id,)), "simhash")
    each = marked.groupBy("__fp").agg(F.min(doc_id).alias("__least"))
    linked = components(links(each.select("__fp"), budget)).withColumnRenamed("node", "__fp")
    labels = each.join(linked, "__fp", "left").select("__fp", "__least", F.coalesce("root", "__fp").alias("__root"))
    roots = labels.groupBy("__root").agg(F.min("__least").alias("component_id"))
    of = labels.select("__fp", "__root").join(roots, "__root").select("__fp", "component_id")
    return marked.join(of, "__fp").select(doc_id, F.lpad(F.lower(F.hex("__fp")), 16, "0").alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, budget: int = 3) -> DataFrame:
    """One document of each group of near copies, that with the least id, with all its columns.

    Two documents are linked by near_duplicates()' rule (fingerprints of three-word shingles within the budget), and by a
    Jaccard similarity of five-word shingles of 0.8 or more. The latter pairs all share one of their first shingles
    (prefixes()), so each is found, and verified on the whole texts, unless verified links already join its two texts.
    Null and empty texts have no words and are near copies of each other. Null ids count as the largest; of rows that repeat
    an id and a text one stays. Columns keep their values, whatever their names.
    """
    rows = common.save(docs.withColumn("__row", F.monotonically_increasing_id()), "near")
    slim = rows.select("__row", common.text_or_empty(text).alias("__text"))
    signed = common.save(with_simhash(slim, "__text", keep=("__row",)), "signs")
    each = common.save(signed.groupBy("__fp").agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n")), "first")
    same = signed.join(each.where("__n > 1").drop("__n"), "__fp").where("__row > __first").select(F.col("__first").alias("a"), F.col("__row").alias("b"))
    found = links(each.select("__fp"), budget)
    for c in ("a", "b"):
        found = found.join(each.select(F.col("__fp").alias(c), F.col("__first").alias(f"__{c}")), c)
    sure = same.unionByName(found.select(F.col("__a").alias("a"), F.col("__b").alias("b")))
    marks = common.save(signatures(slim, shingle), "signatures")
    maybe = common.save(candidates(prefixes(slim, shingle, similarity), similarity), "candidates")
    near = lambda pairs: verified(common.save(not_ruled_out(pairs, marks, similarity), "pairs"), rows, text, shingle, similarity)
    linked = components(sure.unionByName(near(maybe.where("b IS NOT NULL"))))
    for central in (CENTRAL, None):
        more = maybe.where("b IS NULL").select("h", "size", F.col("a").alias("row"))
        if not more.limit(1).count():
            break
        more = more.join(linked.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
        joined = linked.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
        maybe = common.save(candidates(more, similarity, rest=True, central=central), "candidates")
        linked = components(joined.unionByName(near(maybe.where("b IS NOT NULL"))))
    ids = linked.join(rows.select(F.col("__row").alias("node"), F.col(doc_id).alias("__id")), "node")
    keep = ids.groupBy("root").agg(F.min(F.struct(F.col("__id").isNull(), "__id", "node")).alias("__keep")).select(F.col("__keep.node").alias("node"))
    lost = linked.select("node").join(keep, "node", "left_anti").select(F.col("node").alias("__row"))
    return rows.join(lost, "__row", "left_anti").select(*docs.columns)


def query(spark, sf_dir):
    return near_duplicates(common.documents(spark, sf_dir))
