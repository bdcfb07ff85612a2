"""Ids of a word-based byte-pair tokenizer, encoded once per distinct word.

White space never reaches the ids of such a tokenizer, so a text's ids are those of its
space-separated chunks, one after the other. Each task keeps the ids of chunks it has met.
"""

import sys
from array import array

import numpy as np
import regex

from feedbackmill.llm.common import worker_store

#: Chunks of which a Python worker keeps the ids, twice: those met lately and the ones before them.
#: It keeps as many pieces. A worker that forgets encodes anew, which costs time only.
KEPT_CHUNKS = 250_000

# Of such chunks NFC is the chunk itself, and lower-casing is the same letter by letter.
_LAST_PLAIN = "\u024f"
_PLAIN = regex.compile("[\x21-\x7e\u00c0-\u024f]+")
# The pattern by which the tokenizer's file splits a lower-cased text.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordTokens:
    """Encodes texts with the tokenizer in ``path``; ids come as little-endian bytes of ``dtype``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        if sys.byteorder != "little":
            raise RuntimeError("ids are kept as little-endian bytes")
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.chunks: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        # Byte-level vocabularies write all bytes but those of printable ASCII as other letters.
        plain = piece.isascii() and piece.isprintable()
        shown = piece if plain else "".join(map(self.letters.__getitem__, piece.encode()))
        found = array(self.code, [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()
        if len(self.pieces) >= KEPT_CHUNKS:
            self.pieces.clear()
        self.pieces[piece] = found
        return found

    def _chunk(self, chunk: str) -> bytes:
        if max(chunk) > _LAST_PLAIN or min(chunk) <= " " or (
            "<" in chunk and any(s in chunk for s in self.specials)
        ) or not (chunk.isascii() or _PLAIN.fullmatch(chunk)):
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
            return array(self.code, ids).tobytes()
        lowered = chunk.lower()
        if lowered.isalpha():
            pieces = [lowered]
        elif lowered[-1] in ".,;" and lowered[:-1].isalpha():
            pieces = [lowered[:-1], lowered[-1]]
        else:
            pieces = _PIECES.findall(lowered)
        return b"".join([self.pieces.get(p) or self._piece(p) for p in pieces])

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of the whole text; none for null and empty texts."""
        if not text:
            return np.zeros(0, self.dtype)
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        known = self.chunks
        found = list(map(known.get, words))
        if None in found:
            if len(known) > KEPT_CHUNKS:
                self.older, self.chunks = known, {"": b""}
                known, found = self.chunks, [None] * len(words)
            for i, ids in enumerate(found):
                if ids is None:
                    word = words[i]
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = self.older.get(word) or self._chunk(word)
                    found[i] = ids
        return np.frombuffer(b"".join(found), self.dtype)


def word_tokens(path: str) -> WordTokens:
    """The tokenizer of this Python worker, loaded once."""
    store = worker_store("word tokens")
    if path not in store:
        store[path] = WordTokens(path)
    return store[path]
