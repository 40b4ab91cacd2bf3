"""BPE encoding by backtracking, and decoding by an offset table.

An Aho-Corasick automaton of all tokens finds, for each place of a word, the tokens that start there. The encoder takes
the longest, and keeps it if it may stand next to the token before it; two tokens may if merging them would not cross
the place where they meet, which the pair table says. Otherwise it tries shorter tokens and then steps back. A place
that failed is never tried again, so the time is linear, and the result is what the merges give.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terraspan.llm import common
from terraspan.llm.tokens import Encoder, byte_letters, vocabulary_path

#: Ids that are decoded at a time.
STEP = 1 << 16
#: Pairs that the table remembers at most.
PAIRS = 1_000_000


class Backtracker:
    """Ids of one piece; a piece's last byte carries the mark of a word's end."""

    def __init__(self, model: dict):
        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        code = {letter: b for b, letter in enumerate(byte_letters())}

        def symbols(token: str) -> str:
            """A token over 512 symbols: the bytes, and the bytes that end a word."""
            end = token.endswith(suffix) and token != suffix
            body = token[: -len(suffix)] if end else token
            own = [chr(code[c]) for c in body]
            return "".join(own[:-1]) + chr(ord(own[-1]) + 256 * end)

        self.halves: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        for r, (a, b) in enumerate(map(tuple, model["merges"])):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if (x, y) not in self.merge:
                self.merge[x, y] = r
                self.halves.setdefault(z, (x, y))
                self.rank.setdefault(z, r)
        self.size: dict[int, int] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            own = symbols(token)
            if len(own) == 1 or i in self.halves:
                self.size[i] = len(own)
                self.automaton.add_word(own, i)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Do the merges leave these neighbours as they are?

        The tokens are taken apart from the latest merge back. If at some time the two that touch could merge, and no
        merge inside them came first, then the merges would have joined them.
        """
        key = left, right
        if (known := self.pairs.get(key)) is not None:
            return known
        limit, a, b, ok = 1 << 62, left, right, True
        while True:
            joins = self.merge.get((a, b))
            if joins is not None and joins < limit:
                ok = False
                break
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                break
            # the later merge is undone first; a left token's own merge came before one of the same rank to its right
            if ra > rb:
                limit, a = ra, self.halves[a][1]
            else:
                limit, b = rb + 1, self.halves[b][0]
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    def __call__(self, piece: bytes) -> list[int]:
        line = piece[:-1].decode("latin-1") + chr(piece[-1] + 256)
        starts: list[list[int]] = [[] for _ in line]
        size = self.size
        for end, token in self.automaton.iter(line):
            starts[end + 1 - size[token]].append(token)  # the shorter ones come first
        out: list[int] = []
        left: list[list[int]] = []  # what is still to try at the place of each token put out
        failed = set()
        at, options = 0, starts[0][:]
        while at < len(line):
            while options:
                token = options.pop()
                if at + size[token] not in failed and (not out or self.compatible(out[-1], token)):
                    out.append(token)
                    left.append(options)
                    at += size[token]
                    options = starts[at][:] if at < len(line) else []
                    break
            else:
                failed.add(at)
                if not out:
                    raise ValueError("no tokens make this piece")
                at -= size[out.pop()]
                options = left.pop()
        return out


class Decoder:
    """The text of ids, as the library gives it for a tokenizer without a decoder: tokens joined by a space."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        tokens = spec["model"]["vocab"] | {x["content"]: x["id"] for x in spec["added_tokens"]}
        known = {i: t for t, i in tokens.items()}
        parts = [known[i].encode() + b" " if i in known else b"" for i in range(max(known) + 1)]
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.offsets = np.append(0, np.cumsum([len(x) for x in parts]))

    def pieces(self, ids: bytes) -> Iterator[bytes]:
        """The text, some ids at a time."""
        every = np.frombuffer(ids, "<u4")
        for at in range(0, len(every), STEP):
            own = every[at : at + STEP]
            low, size = self.offsets[own], self.offsets[own + 1] - self.offsets[own]
            total = np.cumsum(size)
            place = np.arange(total[-1]) + np.repeat(low - (total - size), size)
            out = self.data[place].tobytes()
            yield out if at + STEP < len(every) else out[:-1]


@lru_cache(1)
def codec(path: str) -> tuple[Encoder, Decoder]:
    model = json.load(open(path, encoding="utf-8"))["model"]
    return Encoder(path, Backtracker(model)), Decoder(path)


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids): the ids of each whole text as little-endian unsigned 32-bit integers; none for null and empty texts.

    vocabulary is the path of a tokenizer file that every executor can open. Rows keep their order and repeat as they
    do in docs; other columns are ignored; an empty table gives no rows.
    """
    return _coded(docs, doc_id, text, vocabulary, "ids binary", lambda ids, _: [ids])


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode() and its decoding in one pass, as digests; same rules."""

    def digests(ids: bytes, decoder: Decoder) -> list:
        decoded = hashlib.sha256()
        for piece in decoder.pieces(ids):
            decoded.update(piece)
        return [len(ids) // 4, hashlib.sha256(ids).hexdigest(), decoded.hexdigest()]

    return _coded(docs, doc_id, text, vocabulary, "n_tokens long, ids_sha256 string, decoded_sha256 string", digests)


def decode(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) of encode()'s rows; null ids count as none."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = codec(path)[1]
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([b"".join(decoder.pieces(x or b"")).decode(errors="replace") for x in b.column(1).to_pylist()], pa.string())], names=[doc_id, "text"])

    return encoded.select(doc_id, ids).mapInArrow(run, encoded.select(doc_id).schema.add("text", "string"))


def _coded(docs: DataFrame, doc_id: str, text: str, vocabulary: str | None, more: str, of) -> DataFrame:
    path, names = vocabulary or vocabulary_path(), [x.split()[0] for x in more.split(", ")]
    slim = docs.select(doc_id, common.text_or_empty(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = codec(path)
        for b in batches:
            rows = [of(encoder.ids(x), decoder) for x in common.texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows]) if rows else pa.array([], f) for k, f in enumerate(types))], names=[doc_id, *names])

    types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in more.split(", ")]
    schema = docs.select(doc_id).schema
    for x in more.split(", "):
        schema = schema.add(*x.split())
    return slim.mapInArrow(run, schema)


def query(spark, sf_dir):
    return round_trip(common.documents(spark, sf_dir))
