"""Exact deduplication by counting quotient filters.

Each partition puts the 48-bit fingerprints of its texts into counting quotient filters, one for each slice of the
fingerprint space. A filter holds, for every quotient that occurs, the sorted run of its remainders with counts; so
filters of one slice merge without loss by merging sorted remainders. Fingerprints with a merged count above one send
their rows to byte verification, where the texts themselves are the grouping key. All other rows are unique.

Shuffled: the filters (about 5 bytes a distinct text and partition), ids with digests, and the texts of candidates. (All
texts move only if more than BROADCAST fingerprints are repeated, so that most texts are candidates anyway, or are many.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraspan.llm import common

#: Bits of a fingerprint. More bits only make fewer unique texts go to byte verification.
BITS = 48
#: Fingerprints that a task gathers before it closes a set of filters.
GATHER = 2_000_000
#: Fingerprints in a slice, about.
SLICE = 2_000_000
#: Fingerprints, or keys of copies, that are broadcast at most (some 40 bytes each); more are joined by a shuffle.
BROADCAST = 1_000_000


def filter_bytes(fingerprints: np.ndarray, counts: np.ndarray, low: int) -> bytes:
    """A counting quotient filter of sorted distinct fingerprints, all below 2**low.

    Header: n, quotient bits. Then a bit for each occupied quotient, a bit for each slot that ends a run, the
    remainders in slot order, and a counter for each slot (255: the true count follows in a list of longs).
    """
    n = len(fingerprints)
    q = min(low, max(3, int(n * 4 // 3).bit_length()))
    r = low - q
    quotients = fingerprints >> r
    occupied = np.zeros(1 << q, np.uint8)
    occupied[quotients] = 1
    ends = np.append(quotients[1:] != quotients[:-1], True) if n else np.zeros(0, bool)
    remainders = (fingerprints & ((1 << r) - 1)).astype("<u8").view(np.uint8).reshape(n, 8)[:, : (r + 7) // 8]
    head = np.array([n, q], "<u8").tobytes()
    over = counts[counts >= 255].astype("<u8")
    return head + np.packbits(occupied).tobytes() + np.packbits(ends).tobytes() + remainders.tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes() + over.tobytes()


def filter_content(blob: bytes, low: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted fingerprints and counts that filter_bytes was given."""
    n, q = (int(x) for x in np.frombuffer(blob, "<u8", 2))
    r, at = low - q, 16
    width = (r + 7) // 8
    size = ((1 << q) + 7) // 8
    quotients = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, size, at), count=1 << q))
    at += size
    ends = np.unpackbits(np.frombuffer(blob, np.uint8, (n + 7) // 8, at), count=n)
    at += (n + 7) // 8
    remainders = np.zeros((n, 8), np.uint8)
    remainders[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(n, width)
    at += n * width
    counts = np.frombuffer(blob, np.uint8, n, at).astype(np.int64)
    counts[counts == 255] = np.frombuffer(blob, "<u8", int((counts == 255).sum()), at + n).astype(np.int64)
    run = np.cumsum(ends) - ends
    return (quotients[run] << r) | remainders.view("<u8").ravel().astype(np.int64), counts


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs merged into one; counts of equal fingerprints are added."""
    fps, counts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 2
    order = np.argsort(fps, kind="stable")
    fps, counts = fps[order], counts[order]
    first = np.flatnonzero(np.append(True, fps[1:] != fps[:-1])) if len(fps) else np.zeros(0, np.int64)
    return fps[first], np.add.reduceat(counts, first) if len(fps) else counts


def repeated_fingerprints(rows: DataFrame) -> DataFrame:
    """Fingerprints (column __fp) that occur more than once, by merging the partitions' filters.

    A slice of the fingerprints is merged in one group, so there are as many as the rows ask for.
    """
    top = max(2, common.shuffle_partitions(rows.sparkSession) - 1, rows.count() // SLICE).bit_length()
    low = BITS - top
    schema = pa.schema([("__slice", pa.int32()), ("__filter", pa.binary())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(gathered: list[np.ndarray]) -> pa.RecordBatch:
            fps, counts = np.unique(np.concatenate(gathered), return_counts=True)
            cuts = np.searchsorted(fps, np.arange((1 << top) + 1, dtype=np.int64) << low)
            filled = np.flatnonzero(cuts[1:] > cuts[:-1])
            mask = (1 << low) - 1
            return common.batch(schema, __slice=filled, __filter=[filter_bytes(fps[cuts[s] : cuts[s + 1]] & mask, counts[cuts[s] : cuts[s + 1]], low) for s in filled])

        gathered: list[np.ndarray] = []
        for b in batches:
            gathered.append(b.column(0).to_numpy(zero_copy_only=False))
            if sum(map(len, gathered)) >= GATHER:
                yield close(gathered)
                gathered = []
        if sum(map(len, gathered)):
            yield close(gathered)

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fps, counts = merged([filter_content(x, low) for x in pdf["__filter"]])
        return pd.DataFrame({"__fp": fps[counts > 1] | (int(key[0]) << low)})

    filters = rows.select("__fp").mapInArrow(build, "__slice int, __filter binary")
    return filters.groupBy("__slice").applyInPandas(merge, "__fp long")


def with_digest(docs: DataFrame, text: str) -> DataFrame:
    digest = F.sha2(common.text_or_empty(text).cast("binary"), 256)
    return docs.withColumn("__sha", digest).withColumn("__fp", F.conv(F.substring("__sha", 1, BITS // 4), 16, 10).cast("long"))


def counted(table: DataFrame, what: str) -> DataFrame:
    """A table, written and counted; to be broadcast if it has few rows."""
    table = common.save(table, what)
    return F.broadcast(table) if table.limit(BROADCAST + 1).count() <= BROADCAST else table


def copy_groups(rows: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(__sha, __keep, __size) of each text that several rows hold; rows as with_digest gives them."""
    repeated = counted(repeated_fingerprints(rows), "fingerprints")
    candidates = rows.select(doc_id, common.text_or_empty(text).alias("__text"), "__sha", "__fp").join(repeated, "__fp", "left_semi")
    # the text is in the key: rows are counted together only if their bytes are the same
    return candidates.groupBy("__sha", "__text").agg(F.max(doc_id).alias("__keep"), F.count(F.lit(1)).alias("__size")).where("__size > 1").drop("__text")


def decisions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; texts are compared whole, unchanged. The row with the largest id of a group stays; null
    ids come before all others, and of rows with the same text and id exactly one is kept. Other columns are ignored.
    An empty table gives no rows.
    """
    rows = with_digest(docs.select(doc_id, text), text)
    ids = rows.groupBy("__sha", doc_id).agg(F.count(F.lit(1)).alias("__rows"))
    joined = ids.join(copy_groups(rows, doc_id, text), "__sha", "left")
    alone = F.col("__size").isNull()
    each = joined.select(F.col(doc_id), F.when(alone, F.col(doc_id)).otherwise(F.col("__keep")).alias("keep_id"), F.coalesce("__size", F.lit(1)).cast("long").alias("group_size"), F.col("__sha").alias("text_sha256"), F.explode(F.sequence(F.lit(1), F.col("__rows").cast("int"))).alias("__copy"))
    return each.select(doc_id, "keep_id", "group_size", (F.col(doc_id).eqNullSafe(F.col("keep_id")) & (F.col("__copy") == 1)).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; the rules are those of decisions()."""
    rows = with_digest(docs, text).withColumn("__key", common.key_of(doc_id))
    groups = copy_groups(rows, doc_id, text)
    copies = rows.groupBy("__sha", "__key").agg(F.max(doc_id).alias("__id"), F.count(F.lit(1)).alias("__rows")).join(groups, "__sha")
    stays = F.col("__id").eqNullSafe(F.col("__keep"))
    odd = counted(copies.where((F.col("__rows") > 1) | ~stays).select("__sha", "__key", stays.alias("__stays")), "copies")
    once = rows.join(odd, ["__sha", "__key"], "left_anti")
    # rows that repeat the id and the text of a row that stays are told apart by a number
    number = F.row_number().over(Window.partitionBy("__sha", "__key").orderBy(F.lit(1)))
    again = rows.join(odd.where("__stays"), ["__sha", "__key"], "left_semi").withColumn("__n", number).where("__n = 1")
    return once.select(*docs.columns).unionByName(again.select(*docs.columns))


def query(spark, sf_dir):
    return decisions(common.documents(spark, sf_dir))


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
