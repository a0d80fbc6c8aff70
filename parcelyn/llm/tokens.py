"""Exact piecewise use of a tokenizers file: every distinct piece of text goes through the library once.

Byte-pair tokenizers encode each pre-token on its own. A text is cut where no pre-token can cross, and each distinct
piece is looked up in a bounded memo, filled by the library. The ids are those of encode() on the whole text, for which
the library reads the marks of special tokens in a text as these tokens, unless special_as_text is set.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

import numpy as np

#: ASCII characters that are neither letters, digits nor white space.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: A memo starts anew at so many entries (about 200 bytes each).
MEMO_ENTRIES = 500_000
LITTLE = sys.byteorder == "little"
#: Longer pieces aren't kept.
MEMO_PIECE = 40


def byte_symbols() -> list[str]:
    """The printable stand-in for each byte that byte-level BPE files use."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class _Memo(dict):
    """piece -> packed ids; frequent pieces are soon back when it starts anew."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece):
        packed = self.make(piece)
        if len(piece) <= MEMO_PIECE:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[piece] = packed
        return packed


class PieceEncoder:
    """ids of whole texts as packed little-endian integers of `dtype`."""

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.model = self.tokenizer.model
        # Every word comes here once; a cache of the library's own would only cost.
        getattr(self.model, "_resize_cache", lambda _: None)(0)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.symbols = byte_symbols()
        self.kind = self._kind(spec)
        added = spec.get("added_tokens") or []
        self.marks = {} if special_as_text and all(x["special"] for x in added) else {x["content"]: self._bytes([x["id"]]) for x in added}
        if self.marks and any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in added):
            self.kind = "whole"
        self.at_marks = re.compile("(" + "|".join(map(re.escape, sorted(self.marks, key=len, reverse=True))) + ")") if self.marks else None
        self.bare, self.spaced = _Memo(self._bare), _Memo(self._spaced)

    @staticmethod
    def _kind(spec: dict) -> str:
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            return "spaced"
        steps = [x["type"] for x in (norm or {}).get("normalizers", [])]
        cut = (pre.get("pretokenizers") or [{}])[0]
        if steps == ["NFC", "Replace", "Lowercase"] and cut.get("behavior") == "Removed" and cut.get("invert"):
            return "dropped"
        return "whole"

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes() if LITTLE else np.array(ids, self.dtype).tobytes()

    def _library(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str, lead: str) -> bytes:
        """One pre-token of letters up to U+00FF, straight to the model."""
        if self.kind == "dropped":
            word = word.lower()
        if not word.isascii():
            word = "".join(map(self.symbols.__getitem__, word.encode()))
        return self._bytes([t.id for t in self.model.tokenize(lead + word)])

    def _piece(self, piece: str, memo: _Memo, lead: str) -> bytes:
        if piece.isalpha():
            if piece.isascii() or max(piece) <= "\xff":
                return self._word(piece, lead)
        else:
            stem = piece.rstrip(PUNCTUATION)
            if len(stem) < len(piece) and stem.isalpha() and (stem.isascii() or max(stem) <= "\xff"):
                return memo[stem] + self.bare[piece[len(stem) :]]
        return self._library(" " + piece if lead else piece)

    def _bare(self, piece: str) -> bytes:
        return self._piece(piece, self.bare, "") if piece else b""

    def _spaced(self, piece: str) -> bytes:
        if piece[0] == "\n":
            return self.bare["\n"] + self.bare[piece[1:]]
        return self._piece(piece, self.spaced, self.symbols[0x20])

    def packed(self, text: str) -> bytes:
        if self.at_marks and self.kind != "whole" and self.at_marks.search(text):
            # Marks are cut out first; what stands between two of them is a text of its own.
            return b"".join(self.marks[x] if k % 2 else self._plain(x) for k, x in enumerate(self.at_marks.split(text)) if x)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if self.kind == "dropped":
            return b"".join(map(self.bare.__getitem__, text.replace("\n", " ").split(" ")))
        if self.kind == "whole":
            return self._library(text)
        # Line ends join the piece that follows; single blanks cut, where none but words stand around them.
        spread = text.replace("\n", " \n")
        if "  " in spread or " \n " in spread or spread[:1] == " " or spread[-1:] in (" ", "\n") or not text.replace("\n", "").isprintable():
            return self._by_line(text)
        head, *rest = spread.split(" ")
        return self.bare[head] + b"".join(map(self.spaced.__getitem__, rest))

    def _by_line(self, text: str) -> bytes:
        """Text with runs of white space, or other white space than blanks and line ends."""
        out: list[bytes] = []
        lines = text.split("\n")
        safe = [bool(x) and not x[0].isspace() and not x[-1].isspace() for x in lines]
        k = 0
        while k < len(lines):
            first = k
            while k + 1 < len(lines) and not (safe[k] and safe[k + 1]):
                k += 1
            if first:
                out.append(self.bare["\n"])
            if k == first and safe[k]:
                self._line(lines[k], out)
            elif k > first or lines[k]:
                out.append(self._library("\n".join(lines[first : k + 1])))
            k += 1
        return b"".join(out)

    def _line(self, line: str, out: list[bytes]) -> None:
        if "  " in line or not line.isprintable():
            self._odd_line(line, out)
            return
        head, *rest = line.split(" ")
        out.append(self.bare[head])
        out.extend(map(self.spaced.__getitem__, rest))

    def _odd_line(self, line: str, out: list[bytes]) -> None:
        """A line with white space besides single blanks: runs of it stay with both their neighbours."""
        parts = line.split(" ")
        fits = [bool(x) and not x[0].isspace() and not x[-1].isspace() for x in parts]
        k = 0
        while k < len(parts):
            first = k
            while k + 1 < len(parts) and not (fits[k] and fits[k + 1]):
                k += 1
            piece = " ".join(parts[first : k + 1])
            out.append(self.spaced[piece] if first else self.bare[piece])
            k += 1


_encoders: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, special_as_text: bool = False) -> PieceEncoder:
    """One encoder for each file and worker process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (path, special_as_text) not in _encoders:
        _encoders[path, special_as_text] = PieceEncoder(path, special_as_text)
    return _encoders[path, special_as_text]
