"""Runs of words that repeat with a period, in whole texts.

Karp, Miller and Rosenberg's names: at level 0 equal words have equal names; two stretches of 2**k words have one name at
level k if their halves' names at level k - 1 are equal. A stretch that occurs once in its text has no name, nor has any
longer one around it, so a level holds only what repeats, and levels end where nothing does. From two places the length of
equal words is found by descending levels, to either side; no hashes, and no sorting of suffixes.

A run has four periods at least. So with period p, and 2**k <= p < 2**(k + 1), it holds a place i, a multiple of 2 * p,
where the stretches of 2**k words at i and i + p have one name, and more than 3 * p places in a row have a name. Only that
grid is looked at, only in such rows of places; each candidate is then extended to both sides as far as it goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraspan.functions.lambdas import let
from terraspan.llm import common

#: A run has LEAST words, and TIMES of its period, at least.
LEAST, TIMES = 6, 4
#: Words that are looked at together; a longer text is looked at by itself. Grid places that are held at a time.
STEP, PLACES = 1 << 17, 1 << 20


def levels(words: np.ndarray) -> list[np.ndarray]:
    """Names of the stretches of 1, 2, 4 ... neighbouring words, by where they start; -1 where a stretch occurs once."""

    def named(at: np.ndarray, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(words), -1, np.int32)
        if len(at):
            _, names, times = np.unique(keys, return_inverse=True, return_counts=True)
            again = times[names] > 1
            out[at[again]] = names[again]
        return out

    now, k, found = named(np.arange(len(words)), words), 0, []
    while (now >= 0).any():
        found.append(now)
        at = np.flatnonzero(now[: len(now) - (1 << k)] >= 0)
        at = at[now[at + (1 << k)] >= 0]
        now = named(at, now[at].astype(np.int64) << 32 | now[at + (1 << k)])
        k += 1
    return found


def extended(names: list[np.ndarray], i: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the stretch around each place i in which words p apart are equal."""
    a, b = i.copy(), i.copy()
    for k in range(len(names) - 1, -1, -1):  # no stretch of 2 ** len(names) words occurs twice
        name, width = names[k], 1 << k
        ok = b + p + width <= len(name)
        x, y = name[b[ok]], name[b[ok] + p[ok]]
        b[ok] += np.where((x >= 0) & (x == y), width, 0)
        ok = a >= width
        x, y = name[a[ok] - width], name[a[ok] - width + p[ok]]
        a[ok] -= np.where((x >= 0) & (x == y), width, 0)
    return a, b + p


def runs_of(words: np.ndarray) -> np.ndarray:
    """(start, length, period) of all runs, by start, then period. words: numbers, of which equal words have the same.

    Texts can be joined by numbers that occur once; no run holds those.
    """
    names, found = levels(words), []
    for k, name in enumerate(names):
        edges = np.flatnonzero(np.diff(np.concatenate([[False], name >= 0, [False]]).astype(np.int8)))
        begin, end = edges[::2], edges[1::2]
        wide = end - begin > 3 << k
        begin, end = begin[wide], end[wide]
        # (row of places, period): periods of this level that the row is wide enough for
        most = np.minimum((2 << k) - 1, (end - begin - 1) // 3)
        for lo, hi in blocks(np.maximum(most - (1 << k) + 1, 0)):
            first, last, n = begin[lo:hi], end[lo:hi], (most - (1 << k) + 1)[lo:hi]
            of, p = spread(n)
            p += 1 << k
            at = -(-first[of] // (2 * p))
            times = np.maximum(-(-last[of] // (2 * p)) - at, 0)
            for l2, h2 in blocks(times):
                which, step = spread(times[l2:h2])
                period = p[l2:h2][which]
                i = (at[l2:h2][which] + step) * 2 * period
                i, period = i[(ok := i + period < len(name))], period[ok]
                same = name[i] == name[i + period]  # places of the row have names
                i, period = i[same], period[same]
                if len(i):
                    a, b = extended(names, i, period)
                    ok = b - a >= np.maximum(LEAST, TIMES * period)
                    if ok.any():
                        found.append(np.unique(np.stack([a, b - a, period], 1)[ok], axis=0))
    if not found:
        return np.zeros((0, 3), np.int64)
    runs = np.unique(np.concatenate(found), axis=0)
    # multiples of a period give the same stretch: the least stays
    runs = runs[np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(1))]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def spread(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place as often as it says, and the number of the repeat."""
    of = np.repeat(np.arange(len(times)), times)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)


def blocks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Neighbouring entries whose sizes are PLACES together, or one that is larger."""
    sums, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + PLACES, "right")))
        yield at, to
        at = to


def texts_runs(texts: list[list[bytes]]) -> list[np.ndarray]:
    """runs_of() the words of each text; starts count from the text's first word."""
    number: dict[bytes, int] = {}
    sizes = np.array([len(x) for x in texts], np.int64)
    ids = np.fromiter((number.setdefault(w, len(number)) for x in texts for w in x), np.int64, int(sizes.sum()))
    # names of a text are its own, so that what other texts repeat has none; a number that occurs once ends each
    first = np.cumsum(sizes + 1) - sizes - 1
    words = np.empty(int(sizes.sum()) + len(texts), np.int64)
    inside = np.ones(len(words), bool)
    inside[first + sizes] = False
    words[inside] = np.repeat(np.arange(len(texts)), sizes) * max(1, len(number)) + ids
    words[~inside] = -1 - np.arange(len(texts))
    runs = runs_of(words)
    of = np.searchsorted(first, runs[:, 0], "right") - 1
    runs[:, 0] -= first[of]
    return np.split(runs, np.searchsorted(of, np.arange(1, len(texts))))


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words but those that a run holds after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, runs, collapsed): one row per document, with its runs (start, length, period) by start, then period, and
    its text without their repeats, words joined by one space.

    Words are what lies between spaces and the control characters 9 to 13. A run is a stretch of at least 6 words and of 4
    times its least period, that can't be made longer. Null and empty texts have no runs and an empty collapsed text. Null
    ids stay, repeated rows each have their row, other columns are ignored. A task holds one Arrow batch of texts at a
    time, and some 100 bytes a word of the texts that it looks at together, or of one long text.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), common.text_or_empty(text).alias("text"))
    fields = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, out, held, n, last = [], [], [], 0, len(b) - 1
            for at, text in enumerate(common.texts(b.column(1))):
                held.append(text.split())
                n += len(held[-1])
                if n >= STEP or at == last:
                    own = texts_runs(held)
                    found += own
                    out += map(collapsed, held, own)
                    held, n = [], 0
            flat = np.concatenate([*found, np.zeros((0, 3), np.int64)])
            runs = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in found])).astype(np.int32)), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], fields=list(fields)))
            yield pa.RecordBatch.from_arrays([b.column(0), runs, pa.array(out, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    id_type = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {id_type}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string").withColumnRenamed("doc_id", doc_id)


def strongest(runs: Column) -> Column:
    """The run with the most periods; of those with as many the first, then the one with the least period. Null if there is none."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda best, x: F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best))


def planted(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The text, or, for a tenth of the ids, its words with a run from some word on: the query's own check of its operator."""
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        period = F.slice(words, (a + 1).cast("int"), p)
        tail = F.slice(F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")).otherwise("")

    return F.when(h % 10 == 0, let(F.filter(F.split(common.text_or_empty(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != ""), repeated)).otherwise(common.text_or_empty(text))


def query(spark, sf_dir):
    docs = common.documents(spark, sf_dir).select("doc_id", planted().alias("text"))
    top = F.col("top")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n"))))
    found = periodic_runs(docs).withColumn("top", strongest(F.col("runs")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), top["start"].alias("start"), top["length"].alias("length"), top["period"].alias("period"),
        F.expr("1000 * top.length div top.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
