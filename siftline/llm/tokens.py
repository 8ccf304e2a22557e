"""Token ids of whole texts, by a public tokenizer with caches of words.

The tokenizer drops white space and nothing it does reaches across it, so a text's ids are its
words' ids in order. Each word is given to the tokenizer once and then found in a cache of bounded
size. Words of ASCII and Latin-1 letters go straight to the tokenizer's BPE model, all others
through the whole tokenizer.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np

#: Words held, and the longest word held (code points).
HELD, LONGEST = 600_000, 40

# The vocabulary's way to split a word and to write bytes as characters.
LETTERS = "a-z\xdf-\xf6\xf8-\xff"
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+")
PLAIN = re.compile("[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
#: What Python and the tokenizer may not both take for white space.
ODD_SPACE = re.compile("[\x1c-\x1f\x85]")


def _byte_characters() -> list[str]:
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordTokenizer:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.held: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.byte = _byte_characters()

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            written = piece if piece.isascii() else "".join(map(self.byte.__getitem__, piece.encode()))
            ids = np.array([t.id for t in self.model.tokenize(written)], "<u4").tobytes()
            if len(piece) <= LONGEST:
                if len(self.pieces) >= HELD:
                    self.pieces.clear()
                self.pieces[piece] = ids
        return ids

    def word(self, word: str) -> bytes:
        if len(word) <= LONGEST and "<|" not in word and PLAIN.fullmatch(word):
            ids = b"".join(map(self._piece, PIECES.findall(word.lower())))
            if len(self.held) >= HELD:
                self.held.clear()
            self.held[word] = ids
            return ids
        return np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def text(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        words = re.split("[ \t\n\x0b\x0c\r]+", text) if ODD_SPACE.search(text) else text.split()
        get, word = self.held.get, self.word
        return b"".join([ids if (ids := get(w)) is not None else word(w) for w in words])


def nfc_stable(word: str) -> bool:
    """For tests: what PLAIN lets through is left as it is by NFC."""
    return unicodedata.normalize("NFC", word) == word
