"""Token ids of whole texts, word by word.

The word-level tokenizer's rules never look across white space, and the special tokens hold none. So a text's ids are
those of its white-space separated chunks in order. Texts, and chunks of other texts, of ASCII and Latin-1 letters,
digits and marks are split here as the tokenizer's pattern does; other chunks by the tokenizer's own normaliser and
pre-tokenizer. The ids of all pieces come from piece_ids; a piece, or chunk, that has been seen needs only a lookup.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

#: The tokenizer's pattern, over lower-case chunks of the characters that PLAIN allows.
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: The same for whole texts of such characters and white space.
TEXT_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\t-\r ]+")
PLAIN_TEXT = re.compile("[!-~À-ÖØ-öø-ÿ\t-\r ]*")
#: The id that ends a document.
END = 2
#: A worker remembers chunks, and pieces, of LONGEST letters at most; of each it keeps two generations, of so many bytes
#: by an upper estimate (its own, and EACH for the entry) and so many entries at most.
LONGEST, REMEMBER, REMEMBER_BYTES, EACH = 64, 200_000, 36 << 20, 200


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: visible Latin-1 as it is, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Memory:
    """What has been worked out lately: when a generation is full, the one before it is forgotten. What is used stays.

    Long keys are never kept, so a generation is bounded in bytes, whatever the texts.
    """

    def __init__(self):
        self.young, self.old, self.bytes = {}, {}, 0

    def put(self, key, value):
        if len(key) > LONGEST:
            return value
        self.bytes += 2 * len(key) + len(value) + EACH
        if len(self.young) >= REMEMBER or self.bytes > REMEMBER_BYTES:
            self.young, self.old, self.bytes = {}, self.young, 2 * len(key) + len(value) + EACH
        self.young[key] = value
        return value


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers. piece_ids gives the ids of one lower-case piece."""

    def __init__(self, path: str, piece_ids: Callable[[bytes], list[int]] | None = None):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.letters = byte_letters()
        self.bytes = {letter: b for b, letter in enumerate(self.letters)}
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = {t: np.array([i], "<u4").tobytes() for t, i in special.items()}
        self.around = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")" if special else "(?!)")
        self.piece_ids = piece_ids or self._by_library
        self.chunks, self.pieces = Memory(), Memory()

    def _by_library(self, piece: bytes) -> list[int]:
        text = piece.decode("latin-1")
        if not (text.isascii() and text.isprintable()):  # visible ASCII stands for itself
            text = "".join(map(self.letters.__getitem__, piece))
        return [t.id for t in self.tokenizer.model.tokenize(text)]

    def _piece(self, piece: str) -> bytes:
        if (ids := self.pieces.young.get(piece)) is None:
            ids = self.pieces.old.get(piece)
            ids = self.pieces.put(piece, b"".join([i.to_bytes(4, "little") for i in self.piece_ids(piece.encode())]) if ids is None else ids)
        return ids

    def _chunk(self, chunk: bytes) -> bytes:
        if (ids := self.chunks.old.get(chunk)) is not None:
            return self.chunks.put(chunk, ids)
        text = chunk.decode()
        if PLAIN.fullmatch(text) and "<|" not in text:
            pieces = PIECES.findall(text.lower())
            ids = self._piece(pieces[0]) if len(pieces) == 1 else b"".join(map(self._piece, pieces))
        else:
            ids = b"".join(self.special[x] if x in self.special else self._split(x) for x in self.around.split(text) if x)
        return self.chunks.put(chunk, ids)

    def _split(self, text: str) -> bytes:
        """By the tokenizer's rules; a piece then has a letter for each of its bytes."""
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))
        return b"".join(self._piece(bytes(map(self.bytes.__getitem__, x)).decode()) for x, _ in pieces)

    def ids(self, text: bytes) -> bytes:
        whole = text.decode()
        if PLAIN_TEXT.fullmatch(whole) and "<|" not in whole:
            known, new = self.pieces.young.get, self._piece
            return b"".join([known(p) or new(p) for p in TEXT_PIECES.findall(whole.lower())])
        known, new = self.chunks.young.get, self._chunk
        return b"".join([known(c) or new(c) for c in text.split()])


@lru_cache(2)
def library_encoder(path: str) -> Encoder:
    return Encoder(path)


def crc(ids: bytes) -> int:
    return zlib.crc32(ids)
