"""Token ids of whole texts, by a cache of the pieces between which no token can reach."""

import json
import re
import struct
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

# A piece is white space and what follows it up to the next white space; a Latin word that
# ends at white space, a full stop or a comma is one by itself. Both kinds of tokenizer file
# split there before any merge, so the ids of a text are those of its pieces in order.
_LATIN = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
_PIECE = re.compile(rf"[ \n]*{_LATIN}(?=[ \n.,]|\Z)|[ \n]*[^ \n]+|[ \n]+")
# The same, where blanks are left out of the ids.
_BARE_PIECE = re.compile(rf"{_LATIN}(?=[ \n.,]|\Z)|[^ \n]+")
# Other white space can join the blanks before and after it; such texts are encoded whole.
_OTHER_SPACE = re.compile(r"[^\S \n]")
# A piece that both kinds take for a single word, ready for the merges.
_WORD = re.compile(f" ?{_LATIN}")
_CACHED_PIECES = 400_000
_LONGEST_CACHED = 64


def _byte_letters() -> dict[int, int]:
    """Return the letter that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves, the others, in order, for letters from 256 on.
    """
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [byte for byte in range(256) if byte not in shown]
    return {byte: byte for byte in shown} | {byte: 256 + at for at, byte in enumerate(hidden)}


_LETTERS = _byte_letters()
_PACKERS = [struct.Struct(f"<{size}I").pack for size in range(32)]


class PieceEncoder(dict):
    """Encodes texts to little-endian unsigned 32-bit ids; itself a bounded cache of pieces.

    Byte-level BPE files are known with words as they are, and with words in lower case and
    blanks left out. Texts are encoded whole with any other file.
    """

    def __init__(self, path: str, most: int | None = None):
        super().__init__()
        self.most = most
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        parts = json.loads(self.tokenizer.to_str())
        before, split = parts["normalizer"], parts["pre_tokenizer"]
        steps = [step["type"] for step in (before or {}).get("normalizers", [])]
        self.special = [token["content"] for token in parts["added_tokens"]]
        is_bpe = parts["model"]["type"] == "BPE"
        self.as_is = is_bpe and before is None and split["type"] == "ByteLevel"
        self.lower = is_bpe and steps == ["NFC", "Replace", "Lowercase"]

    def __missing__(self, piece: str) -> bytes:
        """Encode a piece, and remember it unless it is long."""
        blank = piece[:1] == " "
        word = piece[1:] if blank else piece
        if word.isascii() and word.isalpha():
            # A single word goes to the merges as the steps before them would leave it.
            shown = "\u0120" + word if blank and self.as_is else word
            ids = self._merged(shown.lower() if self.lower else shown)
        elif _WORD.fullmatch(piece):
            shown = (word.lower() if self.lower else piece).encode().decode("latin-1")
            ids = self._merged(shown.translate(_LETTERS))
        else:
            ids = self._whole([piece])[0]
        if len(piece) <= _LONGEST_CACHED:
            if len(self) >= (self.most or _CACHED_PIECES):
                self.clear()
            self[piece] = ids
        return ids

    def _merged(self, shown: str) -> bytes:
        found = [token.id for token in self.merges.tokenize(shown)]
        return _PACKERS[len(found)](*found) if len(found) < 32 else np.array(found, "<u4").tobytes()

    def _whole(self, texts: list[str]) -> list[bytes]:
        done = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(one.ids, dtype="<u4").tobytes() for one in done]

    def _pieces(self, text: str) -> bytes:
        if self.as_is:
            return b"".join(map(self.__getitem__, _PIECE.findall(text)))
        # Up to this code point, lower case and normal form treat each letter by itself.
        if text.isascii() or max(text) <= "\xff":
            lower = text.lower()
            # A special token is one only as it is written.
            text = text if any(token in lower for token in self.special) else lower
        return b"".join(map(self.__getitem__, _BARE_PIECE.findall(text)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Return the ids of each text."""
        if not (self.as_is or self.lower):
            return self._whole(texts)
        return [
            self._whole([text])[0] if _OTHER_SPACE.search(text) else self._pieces(text)
            for text in texts
        ]


@lru_cache(maxsize=2)
def encoder(path: str, most: int | None = None) -> PieceEncoder:
    """Return the encoder of a tokenizer file, one for each Python worker.

    It remembers up to ``most`` pieces, by default ``_CACHED_PIECES``.
    """
    return PieceEncoder(path, most)
