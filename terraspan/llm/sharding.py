"""Sharding by histogram sort.

Rows are ordered by a hash of the text, then a hash of the id. The splitters between shards are sought all at once: exact
bytes are counted below candidate key boundaries across all rows, and each round probes finer inside the bins that hold
the wanted boundaries, until every splitter is within the tolerance. Then rows are exchanged once.

Equal texts are neighbours in this order, and a splitter is first sought between texts; only where one group of equal
texts is heavier than the tolerance allows is it cut, between ids. A round is one job for all splitters; what comes to the
driver is counts of bins, at most 2**ROUND for each splitter and round, however large the table is.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraspan.llm import common

#: Bits of the key that a round of probes resolves, at most.
ROUND = 12
KEY_BITS = 48
#: A splitter may miss its place by this share of a shard.
TOLERANCE = 0.002
#: Bytes that one partition of a shard has, about, so that large shards are placed by several tasks.
PART = 64 << 20
#: Rows of a lookup table that are broadcast, at most (16 bytes each); more are joined by a shuffle.
BROADCAST = 1_000_000
#: What each row weighs besides its text.
ROW_BYTES = 8


def size_of(text: str) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(ROW_BYTES)


def text_key(text: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(common.text_or_empty(text)), 64 - KEY_BITS)


def id_key(doc_id: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(common.key_of(doc_id)), 64 - KEY_BITS)


def small(table: DataFrame, rows: int) -> DataFrame:
    """A lookup table, to be broadcast if it has few rows."""
    return F.broadcast(table) if rows <= BROADCAST else table


def below(keys: DataFrame, group: Column | None, key: str, places: list[tuple[int, int]], have: int, bits: int) -> dict[tuple[int, int], list[tuple[int, int, int]]]:
    """For each place (a group of rows, and a prefix of `have` bits of their key): the bins of the next `bits` bits that have rows, with their bytes and rows. Without a group all rows are group 0."""
    own = ([group.alias("g")] if group is not None else []) + ([F.shiftright(key, KEY_BITS - have).alias("p")] if have else [])
    on = ["g"] * (group is not None) + ["p"] * bool(have)
    rows = keys.select(*own, F.shiftright(key, KEY_BITS - have - bits).alias("bin"), "size")
    if on:
        wanted = dict(zip("gp", (pa.array(x, pa.int64()) for x in zip(*places, strict=True)), strict=True))
        rows = rows.join(small(keys.sparkSession.createDataFrame(pa.table({c: wanted[c] for c in on})), len(places)), on)
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {p: [] for p in places}
    for r in rows.groupBy(*on, "bin").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect():
        found[r.g if group is not None else 0, r.p if have else 0].append((r.bin, r.bytes, r.n))
    return {p: sorted(x) for p, x in found.items()}


def refine(keys: DataFrame, group: Column | None, key: str, targets: list[tuple[int, int, int]], slack: int) -> list[tuple[int, int, bool]]:
    """For each target, (group of rows, bytes wanted, bytes before the group): the boundary (the group's rows with a key
    under it come first), the bytes before it, and whether it can't be bettered within the slack by looking inside one key.
    """
    out: list = [None] * len(targets)
    work = [(k, 0, base) for k, (_, _, base) in enumerate(targets)]  # target, prefix, bytes before the prefix
    have = 0
    while work:
        bits, after = min(ROUND, KEY_BITS - have), []
        left = KEY_BITS - have - bits
        bins = below(keys, group, key, sorted({(targets[k][0], p) for k, p, _ in work}), have, bits)
        sums = {}
        for k, prefix, base in work:
            of, want, _ = targets[k]
            own = bins[of, prefix]
            if (of, prefix) not in sums:
                sums[of, prefix] = [base, *(base + int(x) for x in accumulate(size for _, size, _ in own))]
            ends = sums[of, prefix]
            j = max(0, min(bisect_left(ends, want) - 1, len(own) - 1))  # the bin that spans the target
            near = min(range(j, min(j + 2, len(ends))), key=lambda n: (abs(ends[n] - want), n))
            if abs(ends[near] - want) <= slack or own[j][2] == 1:
                out[k] = ((own[near][0] if near < len(own) else own[-1][0] + 1 if own else prefix << bits) << left, ends[near], True)
            elif left:
                after.append((k, own[j][0], ends[j]))
            else:
                out[k] = (own[j][0], ends[j], False)
        have, work = have + bits, after
    return out


def splitters(keys: DataFrame, total: int, parts: int, slack: int) -> list[tuple[int, int]]:
    """parts - 1 ascending boundaries (text key, id key); rows whose pair of keys is not under a boundary come after it."""
    wanted = [total * k // parts for k in range(1, parts)]
    found = refine(keys, None, "major", [(0, w, 0) for w in wanted], slack)
    out = [(key, 0) for key, _, _ in found]
    hot = [k for k, (_, _, ok) in enumerate(found) if not ok]  # in a text that is heavier than the slack
    if hot:
        for k, (cut, _, _) in zip(hot, refine(keys, F.col("major"), "minor", [(found[k][0], wanted[k], found[k][1]) for k in hot], slack), strict=True):
            out[k] = out[k][0], cut
    return sorted(out)


def part_of(rows: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """rows with __part: the number of cuts that are not above the row's keys. The cuts are looked up by the first bits of the key."""
    spark, bits = rows.sparkSession, max(1, len(cuts).bit_length() + 1)
    shift, at, bins = KEY_BITS - bits, 0, []
    for b in range(1 << bits):
        own, low = [], at
        while at < len(cuts) and min(cuts[at][0] >> shift, (1 << bits) - 1) == b:
            own.append(cuts[at])
            at += 1
        bins.append((b, low, own))
    cut = pa.list_(pa.struct([("t", pa.int64()), ("i", pa.int64())]))
    table = spark.createDataFrame(pa.table({"__bin": pa.array([b for b, _, _ in bins], pa.int64()), "__low": pa.array([n for _, n, _ in bins], pa.int32()), "__cuts": pa.array([[{"t": t, "i": i} for t, i in own] for _, _, own in bins], cut)}))
    text, id_ = F.col("__major"), F.col("__minor")
    passed = F.size(F.filter("__cuts", lambda c: (c["t"] < text) | ((c["t"] == text) & (c["i"] <= id_))))
    return rows.withColumn("__bin", F.shiftright(text, shift)).join(small(table, len(bins)), "__bin").withColumn("__part", F.col("__low") + passed).drop("__bin", "__low", "__cuts")


def shard_by_bytes(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text", tolerance: float = TOLERANCE, part_bytes: int = PART) -> DataFrame:
    """docs with `shard` (0 to shards - 1, sizes in bytes near equal) and `slot` (gapless from 0 in each shard).

    A row's size is size_of() its text, so null and empty texts have a size too. Equal texts share a shard unless their
    group is so heavy that a boundary must cut it (null and empty count as equal). A shard of more than part_bytes is
    placed by several tasks, dealt by a hash of text and id; what each of them places is in the order of the keys. Rows of
    one text and one id are in any order. Columns named shard or slot are replaced. Shards may be empty if there are fewer
    rows than shards; an empty table gives no rows.
    """
    docs = docs.drop(*(c for c in ("shard", "slot") if c not in (doc_id, text)))
    keyed = docs.select("*", size_of(text).alias("__size"), text_key(text).alias("__major"), id_key(doc_id).alias("__minor"))
    keys = common.save(keyed.select(F.col("__size").alias("size"), F.col("__major").alias("major"), F.col("__minor").alias("minor")), "keys")
    total = int(keys.agg(F.sum("size")).first()[0] or 0)
    cuts = splitters(keys, total, shards, int(total / shards * tolerance)) if shards > 1 else []
    each = max(1, -(-total // (shards * part_bytes)))  # partitions of a shard
    parts = shards * each
    dealt = lambda rows: part_of(rows, cuts).withColumn("__part", F.col("__part") * each + F.pmod(F.xxhash64("__major", "__minor"), F.lit(each)).cast("int"))
    # rows before each partition of a shard, counted without the texts
    counts = dealt(keys.select(F.col("major").alias("__major"), F.col("minor").alias("__minor"))).groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    of_shard = Window.partitionBy(F.floor(F.col("__part") / each)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("__part", F.coalesce(F.sum("n").over(of_shard), F.lit(0)).alias("__before"))
    moved = dealt(keyed).repartitionById(parts, "__part")
    placed = moved.withColumn("slot", F.row_number().over(Window.partitionBy("__part").orderBy("__major", "__minor")).cast("long") - 1)
    placed = placed.join(small(before, parts), "__part").withColumn("slot", F.col("slot") + F.col("__before")).withColumn("shard", F.floor(F.col("__part") / each).cast("int"))
    return placed.select(*docs.columns, "shard", "slot")


def query(spark, sf_dir):
    placed = shard_by_bytes(common.documents(spark, sf_dir))
    return placed.select("doc_id", size_of("text").alias("size"), F.crc32(common.text_or_empty("text")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
