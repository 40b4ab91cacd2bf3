"""Near-duplicate vectors by product quantisation.

Equal vectors of a label are one class; only classes move from there on. A model of bounded size, fitted on a bounded
sample, gives each class a list (its nearest coarse centroid) and a code of its residual, one byte a subspace, with the
code's error. A class is stored in its list, and looks into every list that can hold a near one of it: those whose border
it is close to. In a list, distances come from tables of its subspaces. The true distance differs from that by the stored
code's error at most, so a candidate is lost only where a list isn't looked into; each is then compared exactly.

Large lists are split into blocks, and what looks into a block into chunks, so a task holds a bounded number of vectors. It
returns the links of each class as a number and a spanning forest of them, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from terraspan.llm import common
from terraspan.llm.simhash import Forest, components

SIMILARITY = 0.93
#: Lists of the coarse quantiser, at most; vectors of the sample: for each list, and at least.
LISTS, EACH, SAMPLE = 1024, 64, 8192
#: Subspaces, and codes of each (a byte).
SUBSPACES, CODES = 16, 256
#: How far beyond a border a class looks, as a part of the largest distance of a link: REACH over the root of the number of
#: components, 1 at most. For differences of no preferred direction that is so many standard deviations. 1 finds all pairs.
REACH = 3.5
#: Classes of a block of a list; classes that look into a block in one task; those that are compared with it at a time.
BLOCK, CHUNK, STEP = 4096, 1 << 16, 128
#: Pairs that are compared exactly at a time.
PAIRS = 1 << 15
#: For sums that are rounded to 32 bits.
SLACK = 1e-3


def means(x: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Centroids of the rows of x, count at most, by Lloyd's rounds from evenly spaced rows."""
    c = x[np.linspace(0, len(x) - 1, min(count, len(x))).astype(np.int64)]
    for _ in range(rounds):
        of = nearest(x, c)
        by = np.argsort(of, kind="stable")
        own, starts, n = np.unique(of[by], return_index=True, return_counts=True)
        c = c.copy()
        c[own] = np.add.reduceat(x[by], starts) / n[:, None]
    return c


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of c."""
    return np.einsum("ij,ij->i", x, x)[:, None] - 2 * (x @ c.T) + np.einsum("ij,ij->i", c, c)


def nearest(x: np.ndarray, c: np.ndarray, step: int = 4096) -> np.ndarray:
    return np.concatenate([squares(x[k : k + step], c).argmin(1) for k in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


@dataclass
class Model:
    """The coarse centroids, the codebooks of the subspaces, and how near is near."""

    coarse: np.ndarray
    books: list[np.ndarray]
    similarity: float
    reach: float

    @property
    def size(self) -> int:
        return self.coarse.shape[1]

    @property
    def radius(self) -> float:
        """The largest distance of unit vectors that are linked."""
        return math.sqrt(max(0.0, 2 - 2 * self.similarity))

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return np.array_split(x, len(self.books), axis=1)

    def coded(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, code and code's error of unit vectors."""
        own = nearest(unit, self.coarse)
        rest = unit - self.coarse[own]
        codes = np.stack([nearest(x, b) for x, b in zip(self.parts(rest), self.books, strict=True)], 1).astype(np.uint8)
        made = np.concatenate([b[codes[:, k]] for k, b in enumerate(self.books)], 1)
        return own, codes, np.sqrt(np.einsum("ij,ij->i", rest - made, rest - made))

    def probes(self, unit: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists below its own that a vector looks into: a link to a higher list is found from there.

        A vector in another list lies beyond the plane halfway between the two centroids; so does one within the radius only
        if that plane is within the radius.
        """
        d = squares(unit, self.coarse)
        between = np.sqrt(np.maximum(squares(self.coarse, self.coarse), 0))[own]
        least = np.take_along_axis(d, own[:, None], 1)
        near = (d - least <= 2 * between * (self.radius * self.reach) + SLACK) & (np.arange(len(self.coarse)) < own[:, None])
        return np.nonzero(near)

    def candidates(self, unit: np.ndarray, number: int, codes: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) of a list's vectors that may be near, by tables of the distances of each subspace's codes."""
        total = np.zeros((len(unit), len(codes)), np.float32)
        for k, (x, book) in enumerate(zip(self.parts(unit - self.coarse[number]), self.books, strict=True)):
            total += squares(x, book).astype(np.float32)[:, codes[:, k]]
        return np.nonzero(total <= ((self.radius + error + SLACK) ** 2).astype(np.float32) + SLACK)


def fit(sample: np.ndarray, lists: int, similarity: float = SIMILARITY, reach: float | None = None) -> Model:
    unit = units(sample)
    coarse = means(unit, lists)
    rest = unit - coarse[nearest(unit, coarse)]
    books = [means(x, CODES) for x in np.array_split(rest, min(SUBSPACES, unit.shape[1]), axis=1)]
    return Model(coarse, books, similarity, min(1.0, REACH / math.sqrt(unit.shape[1])) if reach is None else reach)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that their squares are neither too large nor too small; cosines stay as they are."""
    return np.ldexp(x.astype(float), -np.frexp(np.abs(x).max(1))[1][:, None].astype(np.int64))


def units(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the rows of two arrays of scaled() vectors, one by one, in double precision."""
    return np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))


def comparable(vectors: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """(id, label, vector, good): good vectors can be linked. -0.0 counts as 0.0."""
    kind = "float" if vectors.schema[vector].dataType.elementType.simpleString() == "float" else "double"
    v = F.transform(vector, lambda x: x.cast(kind) + F.lit(0.0).cast(kind))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("label").isNotNull() & F.col("vector").isNotNull() & ~bad & F.exists("vector", lambda x: x != 0)
    return vectors.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), v.alias("vector")).withColumn("good", F.coalesce(good, F.lit(False)))


def rows_of(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(float)


def coded(classes: DataFrame, model: Model | None) -> DataFrame:
    """classes (cls, n, label, vector) with size, own (the list), code, error and probes. Vectors of a size that the model
    isn't made for have one list, -1, and no code."""
    columns = ["cls", "n", "label", "vector", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = len(b)
            own, error, code, probes = np.full(n, -1, np.int32), np.zeros(n), [b""] * n, [()] * n
            fits = np.flatnonzero(b.column(4).to_numpy() == (model.size if model else -1))
            if len(fits):
                unit = units(rows_of(b.column(3).take(pa.array(fits)), model.size))
                own[fits], codes, error[fits] = model.coded(unit)
                row, to = model.probes(unit, own[fits])
                for k, (i, c, p) in enumerate(zip(fits.tolist(), codes, np.split(to, np.searchsorted(row, np.arange(1, len(fits)))), strict=True)):
                    code[i], probes[i] = c.tobytes(), p
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own), pa.array(code, pa.binary()), pa.array(error), pa.array(probes, pa.list_(pa.int32()))], names=[*columns, "own", "code", "error", "probes"])

    table = classes.select("cls", "n", "label", "vector", F.size("vector").alias("size"))
    more = StructType().add("own", "integer").add("code", "binary").add("error", "double").add("probes", ArrayType(IntegerType()))
    return table.mapInArrow(run, StructType([*table.schema.fields, *more.fields]))


def dealt(table: DataFrame) -> DataFrame:
    """coded() classes where they are compared: (place, looks, cls, n, vector, code, error). place names a label, size,
    list, block and chunk; looks is false for what the block holds.

    A class is in one block of its list and looks into the blocks before it, and into all blocks of the lists that it
    probes. So each pair of a list and a class meets in one task.
    """
    key = ["label", "size", "list"]
    held = table.select("label", "size", F.col("own").alias("list"), F.lit(1).alias("holds"))
    looking = table.select("label", "size", F.explode("probes").alias("list"), F.lit(0).alias("holds"))
    counts = held.unionByName(looking).groupBy(*key).agg(F.sum("holds").alias("holds"), F.count(F.lit(1)).alias("all"))
    blocks, chunks = F.ceil(F.col("holds") / BLOCK).cast("int"), F.ceil(F.col("all") / CHUNK).cast("int")
    # of lists that need no split there is no row; Spark broadcasts this table if its files are small enough
    large = common.save(counts.select(*key, blocks.alias("blocks"), chunks.alias("chunks")).where("blocks > 1 OR chunks > 1").coalesce(8), "large")
    everywhere = F.concat(F.array(F.struct(F.col("own").alias("list"), F.lit(False).alias("probed"))), F.transform("probes", lambda p: F.struct(p.alias("list"), F.lit(True).alias("probed"))))
    at = table.withColumn("at", F.explode(everywhere)).select("*", "at.list", "at.probed").drop("at", "probes")
    at = at.join(large, key, "left").fillna(1, ["blocks", "chunks"])
    block, chunk = F.pmod(F.xxhash64("cls"), F.col("blocks")), F.pmod(F.xxhash64("cls", F.lit(1)), F.col("chunks"))
    holds = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(block.cast("int").alias("block"), c.alias("chunk"), F.lit(False).alias("looks")))
    before = F.when(F.col("probed"), F.col("blocks")).otherwise(block).cast("int")
    looks = F.transform(F.sequence(F.lit(0), before), lambda b: F.struct(b.alias("block"), chunk.cast("int").alias("chunk"), F.lit(True).alias("looks")))
    looks = F.slice(looks, F.lit(1), before)
    at = at.withColumn("to", F.explode(F.when(F.col("probed"), looks).otherwise(F.concat(holds, looks))))
    place = F.concat_ws(",", "size", "list", "to.block", "to.chunk", F.col("label").cast("string"))
    return at.select(place.alias("place"), F.col("to.looks").alias("looks"), "cls", "n", "vector", "code", "error")


class Block:
    """What one task place holds, and the links found in it so far."""

    def __init__(self, place: str, model: Model | None, similarity: float):
        size, number, _, chunk, _ = place.split(",", 4)
        self.size, self.list, self.first, self.model, self.similarity = int(size), int(number), chunk == "0", model, similarity
        self.parts: list[pa.RecordBatch] = []

    def hold(self, rows: pa.RecordBatch) -> None:
        self.parts.append(rows)

    def ready(self) -> None:
        """All that it holds is there: put it together, and link it with itself (in one chunk only)."""
        self.cls, self.n = (np.concatenate([p.column(k).to_numpy() for p in self.parts] or [np.zeros(0, np.int64)]) for k in (2, 3))
        self.x = scaled(np.concatenate([rows_of(p.column(4), self.size) for p in self.parts])) if self.parts else np.zeros((0, self.size))
        if self.list >= 0 and self.parts:
            self.codes = np.stack([np.frombuffer(c, np.uint8) for p in self.parts for c in p.column(5).to_pylist()])
            self.error = np.concatenate([p.column(6).to_numpy() for p in self.parts])
        self.parts, self.links, self.root = [], np.zeros(len(self.cls), np.int64), np.arange(len(self.cls))
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        if self.first:
            for at in range(0, len(self.cls), STEP):
                mine = np.arange(at, min(at + STEP, len(self.cls)))
                for a, b in self.found(self.x[mine], after=mine):
                    self.count(self.links, mine[a], self.n[b])
                    self.count(self.links, b, self.n[mine[a]])
                    self.join(mine[a], b, self.cls)

    @staticmethod
    def count(links: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        links += np.bincount(at, weights=n, minlength=len(links)).astype(np.int64)

    def join(self, a: np.ndarray, b: np.ndarray, cls: np.ndarray) -> None:
        """cls: the classes of all places, beyond this block's those that look into it."""
        forest = Forest(len(cls))
        forest.root[: len(self.root)] = self.root
        forest.join(a, b)
        self.root = forest.root[: len(self.cls)]
        self.edges += [(cls[x], cls[y]) for x, y in forest.edges]

    def found(self, x: np.ndarray, after: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Linked (row of x, place in the block), some at a time. after: the rows' own places, for pairs with later ones only."""
        if not len(self.cls) or not len(x):
            return
        if self.list >= 0:
            a, b = self.model.candidates(x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], self.list, self.codes, self.error)
        else:
            a, b = np.indices((len(x), len(self.cls))).reshape(2, -1)
        if after is not None:
            later = b > after[a]
            a, b = a[later], b[later]
        for k in range(0, len(a), PAIRS):
            p, q = a[k : k + PAIRS], b[k : k + PAIRS]
            near = cosines(x[p], self.x[q]) >= self.similarity
            if near.any():
                yield p[near], q[near]

    def look(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Link more classes with those in the block; their numbers of links."""
        cls, n, x = rows.column(2).to_numpy(), rows.column(3).to_numpy(), scaled(rows_of(rows.column(4), self.size))
        for at in range(0, len(cls), STEP):
            own = cls[at : at + STEP]
            links, every = np.zeros(len(own), np.int64), np.concatenate([self.cls, own])
            for a, b in self.found(x[at : at + STEP]):
                self.count(links, a, self.n[b])
                self.count(self.links, b, n[at : at + STEP][a])
                self.join(a + len(self.cls), b, every)
            yield counted(own, links)

    def joined(self) -> Iterator[pa.RecordBatch]:
        """The forest's edges since the last call."""
        for a, b in self.edges:
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.zeros(len(a), np.int64))], names=["a", "b", "links"])
        self.edges = []

    def results(self) -> Iterator[pa.RecordBatch]:
        yield counted(self.cls, self.links)
        yield from self.joined()


def counted(cls: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
    some = links > 0
    return pa.RecordBatch.from_arrays([pa.array(cls[some]), pa.nulls(int(some.sum()), pa.int64()), pa.array(links[some])], names=["a", "b", "links"])


def compared(places: DataFrame, model: Model | None, similarity: float) -> DataFrame:
    """(a, b, links): a spanning forest of the links between classes, and (b is null) numbers of links to add up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, looks = None, None, False
        for b in batches:
            names = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            at = 0
            for (place, looking), same in groupby(names):
                n = sum(1 for _ in same)
                rows, at = b.slice(at, n), at + n
                if place != now:
                    if block:
                        if not looks:
                            block.ready()
                        yield from block.results()
                    now, block, looks = place, Block(place, model, similarity), False
                if looking and not looks:
                    block.ready()
                    looks = True
                if looking:
                    yield from block.look(rows)
                    yield from block.joined()
                else:
                    block.hold(rows)
        if block:
            if not looks:
                block.ready()
            yield from block.results()

    return places.repartition("place").sortWithinPartitions("place", "looks").mapInArrow(run, "a long, b long, links long")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", similarity: float = SIMILARITY, reach: float | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row. Vectors are linked if their labels are equal and not null, they
    have as many components, and their cosine is at least the similarity.

    Vectors that are null, empty or zero, or have null or non-finite components, link with nothing. n_links counts rows, so
    copies too; component_id is the least vec_id that links reach, null only if all are null. Rows that repeat an id each
    have their row; kept is whether component_id is the row's own (null for null counts). An empty table gives an empty one.
    Other columns are ignored. Vectors of another size than most have no index: they are compared one with another.

    reach: see REACH; with 1 no pair is lost. Rows find their class by two 64-bit hashes of label and vector.
    """
    spark = vectors.sparkSession
    common.small_batches(spark)
    all_rows = comparable(vectors, vec_id, vector, label)
    good = all_rows.where("good").select("id", "label", "vector")
    hashes = F.xxhash64("label", "vector").alias("h1"), F.xxhash64(F.lit("b"), "vector", "label").alias("h2")
    grouped = good.groupBy("label", "vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    classes = common.save(grouped.select(F.monotonically_increasing_id().alias("cls"), "id", "n", "label", "vector", *hashes), "classes")
    usual = classes.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    model = None
    if usual:
        lists = min(LISTS, math.ceil(math.sqrt(usual["count"]) / 4))
        drawn = classes.where(F.size("vector") == usual["size"]).select("vector").orderBy(F.xxhash64("vector"), "vector").limit(max(SAMPLE, EACH * lists)).collect()
        model = fit(np.array([r.vector for r in drawn]), lists, similarity, reach)
    links = common.save(compared(dealt(common.save(coded(classes, model), "coded")), model, similarity), "links")
    numbers = links.where("b IS NULL").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    roots = components(links.where("b IS NOT NULL").select("a", "b")).select(F.col("node").alias("cls"), "root")
    every = classes.drop("vector", "label").join(numbers, "cls", "left").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    every = common.save(every.select("h1", "h2", "id", "n", "root", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "linked")
    least = every.groupBy("root").agg(F.min("id").alias("component_id"))
    every = every.join(least, "root").select("h1", "h2", "n_links", "component_id")
    found = good.select("id", *hashes).join(every, ["h1", "h2"]).select("id", "n_links", "component_id")
    alone = all_rows.where("NOT good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return found.unionByName(alone).select(F.col("id").alias(vec_id), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def query(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs of a label, and what they reach.
SQL = f"""WITH RECURSIVE good AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= {SIMILARITY} ELSE false END),
reach(v, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.b, r.r FROM reach r JOIN pairs p ON p.a = r.v),
least AS (SELECT v AS vec_id, min(r) AS component_id FROM reach GROUP BY v),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN least USING (vec_id) LEFT JOIN n USING (vec_id)"""
