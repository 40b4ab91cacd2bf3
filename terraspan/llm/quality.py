"""A quality classifier by Bradley-Terry ranking.

Labelled documents make preference pairs: one marked good is preferred to one marked bad. Scores are linear in the
features of a text, and the weights minimise the logistic loss on the feature differences of the pairs. The threshold
is the quantile of the training scores that parts good from bad best; a score is the logistic function of the
distance from it, so 0.5 is the threshold.

Features are shares of kinds of bytes and words, and hashed bags of words and of byte triples, so that what parts good
from bad is learnt from the labels and not only from marks chosen by hand. They are worked out where the texts are, from
the whole text; nothing is shuffled to score. To the driver come the features of at most TRAIN labelled documents, taken
in the order of a hash of their ids.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraspan.llm import common
from terraspan.llm.words import Hasher, U, spans

#: Labelled documents that the model is fitted on, at most, and pairs for each of them.
TRAIN, PAIRS = 20_000, 8
RIDGE, STEPS = 1e-3, 150
#: Texts that are scored at a time.
STEP = 256
#: Bytes whose triples are counted at a time.
BYTES = 1 << 16
#: Bins of the bags of words, and of byte triples.
WORDS, TRIPLES = 256, 256
NAMES = ("size", "exclaim", "bar", "symbol", "upper", "digit", "other", "stop", "again", "distinct", "top", "length", "long", "line", "mixed", "capital")
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
UPPER, DIGITS, SYMBOLS = np.zeros((3, 256), bool)
UPPER[65:91], DIGITS[48:58], SYMBOLS[[ord(c) for c in "#$%&*+<=>@\\^_`{}~"]] = True, True, True


def bag(counts: np.ndarray) -> np.ndarray:
    """Square roots of the bins' counts, of length 1 in all."""
    return np.sqrt(counts / max(1, counts.sum()))


def bags(text: bytes) -> np.ndarray:
    """Of the words and of the byte triples, A-Z lower-cased."""
    data = np.frombuffer(text.lower(), np.uint8)
    words = hasher().words(data, *spans(data)) >> U(64 - WORDS.bit_length() + 1)
    triples = np.zeros(TRIPLES, np.int64)
    for at in range(0, len(data) - 2, BYTES):  # a long text some bytes at a time
        wide = data[at : at + BYTES + 2].astype(np.uint32)
        mixed = (wide[:-2] * np.uint32(0x9E3779B1) ^ wide[1:-1] * np.uint32(0x85EBCA77) ^ wide[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
        triples += np.bincount((mixed >> np.uint32(32 - TRIPLES.bit_length() + 1)).astype(np.int64), minlength=TRIPLES)
    return np.concatenate([bag(np.bincount(words.astype(np.int64), minlength=WORDS)), bag(triples)])


@lru_cache(1)
def hasher() -> Hasher:
    return Hasher(5)


def features(text: bytes) -> np.ndarray:
    return np.concatenate([shares(text), bags(text)]).astype(np.float32)


def shares(text: bytes) -> list[float]:
    """Of kinds of bytes and words, each between about 0 and 1."""
    words, n = text.split(), len(text)
    if not words:
        return [0.0] * len(NAMES)
    bytes_ = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters = max(1, int(bytes_[LETTERS].sum()))
    m = len(words)
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, m)
    lines = text.split(b"\n")
    share = lambda x: float(x) / m
    return [
        np.log1p(n) / 16,
        np.sqrt(min(1, bytes_[33] / m)),
        np.sqrt(min(1, bytes_[124] / m)),
        np.sqrt(min(1, bytes_[SYMBOLS].sum() / m)),
        np.sqrt(bytes_[UPPER].sum() / letters),
        np.sqrt(bytes_[DIGITS].sum() / n),
        np.sqrt(max(0, n - bytes_[LETTERS].sum() - bytes_[DIGITS].sum() - bytes_[SYMBOLS].sum() - bytes_[[9, 10, 32]].sum()) / n),
        share(min(m, bytes_[46] + bytes_[44])),
        np.sqrt(share(sum(map(eq, words, words[1:])))),
        len(counts) / m,
        share(counts.most_common(1)[0][1]),
        min(1.0, float(lengths.mean()) / 16),
        share((lengths > 20).sum()),
        1 - len(set(lines)) / len(lines),
        share((lengths == 1).sum()),
        min(1.0, len(lines) * 8 / m),
    ]


def squeezed(x: np.ndarray) -> bytes:
    """Features for the way to the driver: shares in two bytes, bags in one."""
    return x[: len(NAMES)].astype("<f2").tobytes() + np.rint(x[len(NAMES) :] * 255).astype(np.uint8).tobytes()


def unsqueezed(rows: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), 2 * len(NAMES) + WORDS + TRIPLES)
    shares_ = np.ascontiguousarray(data[:, : 2 * len(NAMES)]).view("<f2").astype(np.float32)
    return np.concatenate([shares_, data[:, 2 * len(NAMES) :].astype(np.float32) / 255], axis=1)


def with_features(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    slim = docs.select(*keep, common.text_or_empty(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [features(x) for x in common.texts(b.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array([squeezed(x) for x in own], pa.binary())], names=[*keep, "__features"])

    return slim.mapInArrow(run, slim.drop("__text").schema.add("__features", "binary"))


class Ranking:
    """Weights, and the threshold with the scale of scores around it. Without both kinds of labels all documents are good."""

    def __init__(self, x: np.ndarray, good: np.ndarray):
        size = len(NAMES) + WORDS + TRIPLES
        self.weights, self.mean, self.threshold, self.width = np.zeros(size, np.float32), np.zeros(size, np.float32), 0.0, 1.0
        if not good.any() or good.all():
            return
        self.mean = x.mean(axis=0)
        # shares are brought to one scale; bags have one already
        scale = np.concatenate([x[:, : len(NAMES)].std(axis=0) + 1e-6, np.full(WORDS + TRIPLES, 0.1)]).astype(np.float32)
        self.weights = self._fitted((x - self.mean) / scale, good) / scale
        scores = (x - self.mean) @ self.weights
        # quantiles of the scores, each halfway between two documents; the one with the least error over both kinds
        order = np.argsort(scores, kind="stable")
        ranked = good[order]
        wrong = np.append(0, np.cumsum(ranked)) / good.sum() + ((~good).sum() - np.append(0, np.cumsum(~ranked))) / (~good).sum()
        at = int(np.flatnonzero(wrong == wrong.min()).mean().round())
        at = min(max(at, 1), len(scores) - 1)
        self.threshold = float(scores[order[at - 1 : at + 1]].mean())
        self.width = max(1e-6, float(np.std(scores)) / 4)

    @staticmethod
    def _fitted(x: np.ndarray, good: np.ndarray) -> np.ndarray:
        """Gradient steps (Adam) on the logistic loss of pairs; each document is in PAIRS of them at least."""
        n = PAIRS * max(good.sum(), (~good).sum())
        draw = np.random.default_rng(0)
        better = np.resize(draw.permutation(np.flatnonzero(good)), n)
        worse = np.resize(draw.permutation(np.flatnonzero(~good)), n)[draw.permutation(n)]
        w, m, v = (np.zeros(x.shape[1], np.float32) for _ in range(3))
        for step in range(1, STEPS + 1):
            s = x @ w
            p = 1 / (1 + np.exp(np.clip(s[better] - s[worse], -30, 30)))  # how sure the loss is that the pair is wrong
            pull = np.bincount(better, p, len(x)) - np.bincount(worse, p, len(x))
            g = RIDGE * w - (pull.astype(np.float32) @ x) / np.float32(n)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w - np.float32(0.1) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return w

    def __call__(self, x: np.ndarray) -> np.ndarray:
        s = ((x - self.mean) @ self.weights - self.threshold) / self.width
        return 1 / (1 + np.exp(-np.clip(s.astype(float), -30, 30)))


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3, F.lit(0)) == 1


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Ranking:
    """Learn from the labelled documents that are not held out; labels that are null, and ids that docs lacks, are left out."""
    marks = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id)).groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).alias("__good"))
    some = marks.orderBy(F.xxhash64("__id"), "__id").limit(TRAIN)
    rows = docs.select(doc_id, text).join(F.broadcast(some), F.col(doc_id) == F.col("__id")).select(F.col("__id"), F.col("__good").cast("int").alias("__good"), text)
    # rows that repeat an id would be as many as they like, so no more than TRAIN rows come back
    found = with_features(rows, ["__id", "__good"], text).orderBy(F.xxhash64("__id"), "__id").limit(TRAIN).toArrow()
    x = unsqueezed(found.column("__features").to_pylist())
    return Ranking(x, np.array(found.column("__good").to_pylist(), int) == 1)


def scored(docs: DataFrame, model: Ranking, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with held_out, score (0 to 1) and predicted (1 if score >= 0.5, else 0), replaced where docs has them.

    Null and empty texts are scored as a text without words. Rows stay as they are, repeated ones too; an empty table
    gives no rows.
    """
    docs = docs.drop(*(c for c in ("held_out", "score", "predicted") if c not in (doc_id, text)))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = common.texts(b.column(names.index(text)).cast(pa.string()))
            scores = np.concatenate([np.zeros(0), *(model(np.stack([features(x) for x in texts[k : k + STEP]])) for k in range(0, len(texts), STEP))])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    out = docs.mapInArrow(run, docs.select(*names).schema.add("score", "double").add("predicted", "integer"))
    return out.withColumn("held_out", held_out(doc_id))


def keep_good(docs: DataFrame, model: Ranking, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that the model doesn't reject, with all their columns as they were."""
    marks = ("held_out", "score", "predicted")
    clash = {c: f"__own_{c}" for c in marks if c in docs.columns and c not in (doc_id, text)}
    found = scored(docs.withColumnsRenamed(clash), model, doc_id, text)
    return found.where(F.col("predicted") == 1).drop(*marks).withColumnsRenamed({v: k for k, v in clash.items()}).select(*docs.columns)


def query(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs.select("doc_id", "text"), model).select("doc_id", "held_out", "score", "predicted")
