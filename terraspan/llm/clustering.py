"""Clusters of integer vectors around centroids, by annulus search.

A round assigns all vectors in tasks that hold the centroids alone, sorted by their norms. A vector's distance to the
centroid it had before (in the first round: to that with the nearest norm) bounds its distance to the nearest from above.
So the nearest centroid's norm lies within that bound of the vector's norm: binary search finds the centroids of that
annulus, and only they are compared, exactly, in integers. Each round's table is written, and holds the assignments that
the next one starts from. Sums of vectors are made in tasks and added up by cluster; only centroids come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraspan.llm import common

#: Components of a vector, steps of a component's unit, centroids, and rounds.
SIZE, SCALE, CENTROIDS, ROUNDS = 64, 256, 40, 5
#: Largest absolute component, in steps: squared distances of 64 components then fit a long.
MOST = 1 << 27
#: Vectors that are compared at a time.
STEP = 4096


def whole_vector(vector: str, size: int) -> Column:
    """Has the vector as many components, none null, infinite or not a number?"""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(vector) == size) & ~bad, F.lit(False))


def quantised(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(id, v): the whole vectors, in steps. A component of over MOST steps is an error."""
    steps = F.transform(vector, lambda x: F.when(F.abs(x.cast("double")) * scale <= MOST, F.floor(x.cast("double") * scale).cast("int")).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("int")))
    return vectors.where(whole_vector(vector, size)).select(F.col(vec_id).alias("id"), steps.alias("v"))


def first_centroids(quantised: DataFrame, count: int, seed: str) -> np.ndarray:
    """The vectors with the least SHA-256 of seed and id; ids that are null come last, equal ones go by their vectors."""
    order = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    rows = quantised.select(order.alias("o"), "v").orderBy(F.col("o").asc_nulls_last(), "v").limit(count).collect()
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), len(rows[0].v) if rows else 0)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of two arrays of integers, one by one."""
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def nearest(x: np.ndarray, centroids: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of x the nearest centroid (of equally near ones the least number), the squared distance, and how many were compared.

    before: a centroid of each row, the nearest of the last round.
    """
    norms = np.sqrt(np.einsum("ij,ij->i", centroids, centroids).astype(float))
    by = np.lexsort((np.arange(len(norms)), norms))
    ordered, own = norms[by], np.sqrt(np.einsum("ij,ij->i", x, x).astype(float))
    if before is None:
        at = np.searchsorted(ordered, own).clip(0, len(by) - 1)
        left = np.maximum(at - 1, 0)
        before = by[np.where(np.abs(ordered[left] - own) < np.abs(ordered[at] - own), left, at)]
    best, least = before.astype(np.int64), distances(x, centroids[before])
    # norms and bounds are rounded: wider by more than that, so that centroids on the edge are compared, too
    bound = np.sqrt(least.astype(float))
    slack = 1e-9 * (own + bound + 1)
    low, high = np.searchsorted(ordered, own - bound - slack), np.searchsorted(ordered, own + bound + slack, "right")
    for k in range(int(low.min(initial=len(by))), int(high.max(initial=0))):
        rows = np.flatnonzero((low <= k) & (k < high))
        d = distances(x[rows], centroids[by[k]])
        better = (d < least[rows]) | (d == least[rows]) & (by[k] < best[rows])
        best[rows[better]], least[rows[better]] = by[k], d[better]
    return best, least, int((high - low).sum())


def matrix(column: pa.ListArray, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.int64)


def assigned(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, v, cluster, distance) of a table (id, v), or of such a result for the centroids of the round before."""
    again = "cluster" in table.columns
    table = table.select("id", "v", *(["cluster"] if again else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), STEP):
                b = whole.slice(at, STEP)
                best, least, _ = nearest(matrix(b.column(1), centroids.shape[1]), centroids, b.column(2).to_numpy() if again else None)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best.astype(np.int32)), pa.array(least)], names=["id", "v", "cluster", "distance"])

    id_type = table.schema["id"].dataType.simpleString()
    return table.mapInArrow(run, f"id {id_type}, v array<int>, cluster int, distance long")


def moved(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after a round: the floor of each cluster's mean, component by component; those without vectors stay."""
    count, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((count, size), np.int64), np.zeros(count, np.int64)
        for b in batches:
            c, x = b.column(0).to_numpy(), matrix(b.column(1), size)
            by = np.argsort(c, kind="stable")
            clusters, starts, times = np.unique(c[by], return_index=True, return_counts=True)
            if len(clusters):
                sums[clusters] += np.add.reduceat(x[by], starts)
                n[clusters] += times
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(n[seen]), pa.array(list(sums[seen]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = table.select("cluster", "v").mapInArrow(run, "cluster int, n long, sums array<long>")
    # decimals, since the sum of all vectors' components may be larger than a long
    total = parts.select("cluster", "n", F.posexplode("sums").alias("k", "s")).groupBy("cluster", "k").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = centroids.copy()
    for r in total.collect():  # a row for each component of each centroid
        out[r.cluster, r.k] = int(r.s) // r.n
    return out


def cluster(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", count: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: str = "2:") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, vector in steps, cluster, distance) for each whole vector, and the centroids; distances are squared.

    Vectors that are null, have null or non-finite components, or another number of components, are left out. A null id is
    kept, but only makes a centroid if too few others do; repeated rows each have their row. With fewer vectors than
    centroids there are as many centroids as vectors, and none for an empty table. Other columns are ignored.
    """
    spark = vectors.sparkSession
    table, path = common.saved(quantised(vectors, vec_id, vector, size, scale), "steps")
    centroids = first_centroids(table, count, seed)
    if not len(centroids):
        return table.select("id", "v", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).toDF(vec_id, "vector", "cluster", "distance"), np.zeros((0, size), np.int64)
    for k in range(rounds + 1):
        before, (table, path) = path, common.saved(assigned(table, centroids), "assigned")
        common.discard(spark, before)
        centroids = moved(table, centroids) if k < rounds else centroids
    return table.toDF(vec_id, "vector", "cluster", "distance"), centroids


def query(spark, sf_dir):
    common.small_batches(spark)
    table, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    sums = {r.cluster: r.d for r in table.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    of = [(c, d, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in sums.items()]
    clusters = spark.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return table.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql() -> str:
    """The rounds one after the other, each with all distances."""
    steps = f"""RECURSIVE kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE}),
parts AS MATERIALIZED (SELECT vec_id, unnest(range({SIZE})) AS k, unnest(v) AS x FROM kept),
c0 AS MATERIALIZED (SELECT n, unnest(range({SIZE})) AS k, unnest(v) AS x FROM (SELECT v, CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS INTEGER) AS n FROM kept QUALIFY n < {CENTROIDS}))"""
    for r in range(ROUNDS + 1):
        steps += f""",
a{r} AS MATERIALIZED (SELECT vec_id, arg_min(n, d * {CENTROIDS} + n) AS cluster, min(d) AS distance FROM (SELECT p.vec_id, c.n, CAST(sum((p.x - c.x) * (p.x - c.x)) AS BIGINT) AS d FROM parts p JOIN c{r} c USING (k) GROUP BY p.vec_id, c.n) GROUP BY vec_id)"""
        if r < ROUNDS:
            steps += f""",
m{r} AS MATERIALIZED (SELECT a.cluster AS n, p.k, CAST(floor(sum(p.x) / count(*)) AS BIGINT) AS x FROM a{r} a JOIN parts p USING (vec_id) GROUP BY 1, 2),
c{r + 1} AS MATERIALIZED (SELECT c.n, c.k, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (n, k))"""
    return f"""WITH {steps},
h AS (SELECT n AS cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY k)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY n)
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{ROUNDS} JOIN h USING (cluster)"""


SQL = sql()
