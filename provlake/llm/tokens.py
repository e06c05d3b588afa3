"""Encoding texts with a public tokenizer, one distinct word at a time.

Running text repeats its words, and a byte-pair encoding never crosses the
borders used here, so each distinct piece is encoded once per worker and texts
are joined from the encoded pieces.  The ids are those of the whole text.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

CACHE_ENTRIES = 1_500_000  # pieces kept by one worker; the cache is emptied beyond

# how byte-level vocabularies write the 256 bytes: printable ones as themselves, the others as letters from U+0100 on
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}

assert sys.byteorder == "little" and array("I").itemsize == 4, "ids are written as the machine holds them"

_encoders: dict[tuple[str, str], "PieceEncoder"] = {}


class PieceEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    ``mode`` names where a text may be cut without changing its ids:

    * ``spaced`` (byte-level vocabularies): before a space that begins a word, since a
      piece takes at most the one space before it.  Runs of white space around a
      space are cut only where printable ASCII follows.
    * ``words`` (vocabularies that drop white space): at spaces and line ends.

    A text that holds the string of an added token is encoded whole.
    """

    AMBIGUOUS = re.compile(r"\s \s")
    SAFE_CUT = re.compile(r"(?= [!-~])")
    SIGNS = (".", ",", ";", ":", "!", "?")

    def __init__(self, path: str, mode: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        self.tok = tokenizers.Tokenizer.from_file(path)
        self.mode, self.model = mode, self.tok.model
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.cache: dict[str, bytes] = {}
        import numpy as np

        # spaced: tokens that begin with the space byte, so where a word begins; words: tokens that end a word
        mark = (lambda t: t.startswith("\u0120")) if mode == "spaced" else (lambda t: t.endswith("</w>"))
        vocabulary = self.tok.get_vocab(with_added_tokens=True)
        self.marks = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.marks[[i for t, i in vocabulary.items() if mark(t)]] = True

    def _whole(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, text: str) -> tuple[str, list[str]]:
        """The first piece and the others; in ``spaced`` mode the one space before each of the others is left out."""
        if self.mode == "words":
            return "", text.replace("\n", " ").split(" ")
        if self.AMBIGUOUS.search(text):
            head, *rest = self.SAFE_CUT.split(text)
            return head, [p[1:] for p in rest]
        head, *rest = text.split(" ")
        return head, rest

    def _parts(self, piece: str) -> int:
        """Marked tokens that a piece has at least, or 0 if it must be encoded alone."""
        if self.mode == "spaced":  # one that ends in white space would lend it to the next
            return 1 if piece and not piece[-1].isspace() else 0
        return 1 if piece.isalpha() else 2 if piece[-1:] in self.SIGNS and piece[:-1].isalpha() else 0

    def _letters(self, piece: str) -> str | None:
        """A piece of Latin letters as the vocabulary spells it, which is one word to the model; None for others.

        Such letters have one form only, so the normaliser changes nothing but their case.
        """
        word = piece.lower() if self.mode == "words" else piece
        if not word.isalpha() or not (word.isascii() or max(word) <= "\u024f"):
            return None
        spelt = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LETTERS)
        return "\u0120" + spelt if self.mode == "spaced" else spelt

    def _learn(self, missing: list[str]) -> None:
        """Encode unseen pieces: words of letters by the model itself, others many at a time, parted at the marked tokens."""
        import numpy as np

        lead, left = " " if self.mode == "spaced" else "", []
        for p in missing:
            if (word := self._letters(p)) is None:
                left.append(p)
            else:
                self.cache[p] = array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
        missing = left
        parts = [self._parts(p) for p in missing]
        alone = [p for p, n in zip(missing, parts, strict=True) if not n]
        self.cache.update(zip(alone, self._whole([lead + p for p in alone]), strict=True))
        together = [(p, n) for p, n in zip(missing, parts, strict=True) if n]
        for i in range(0, len(together), 1024):
            part, counts = zip(*together[i:i + 1024], strict=True)
            ids = np.array(self.tok.encode_batch_fast(["".join([" " + p for p in part])], add_special_tokens=False)[0].ids, dtype="<u4")
            at, upto = np.flatnonzero(self.marks[ids]), np.cumsum(counts)
            if len(at) != upto[-1]:  # some piece has more marked tokens than it must have
                self.cache.update(zip(part, self._whole([lead + p for p in part]), strict=True))
                continue
            begin = at if self.mode == "spaced" else np.concatenate(([0], at[upto - 1][:-1] + 1))
            end = np.append(begin[1:], len(ids))
            raw = ids.tobytes()
            self.cache.update((p, raw[4 * x:4 * y]) for p, x, y in zip(part, begin.tolist(), end.tolist(), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        cut = [None if any(a in text for a in self.added) else self.pieces(text) for text in texts]
        # each distinct piece of the group is looked for once; then every text is joined in one pass
        self._learn([p for p in set().union(*[c[1] for c in cut if c is not None]) if p not in self.cache])
        ids = self.cache.__getitem__
        heads = iter(self._whole([t if c is None else c[0] for t, c in zip(texts, cut, strict=True)]))
        return [next(heads) if c is None else next(heads) + b"".join(map(ids, c[1])) for c in cut]


def encoder(path: str, mode: str) -> PieceEncoder:
    """The worker's encoder for this vocabulary; it outlives a task."""
    if (path, mode) not in _encoders:
        _encoders[path, mode] = PieceEncoder(path, mode)
    return _encoders[path, mode]


def encoded_rows(batches, path: str, mode: str, end_id: int, rows: int = 256):
    """Arrow batches of (doc_id, text) -> (doc_id, ids with the end id as bytes), ``rows`` texts at a time."""
    end = end_id.to_bytes(4, "little")
    enc = encoder(path, mode)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            texts = [t or "" for t in part.column(1).to_pylist()]
            for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode(texts), strict=True):
                yield doc_id, ids + end
