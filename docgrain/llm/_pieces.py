"""Tokenizer files of /opt/tokenizers, and texts cut where no token can cross."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

#: White space by the widest reading (Python's).
SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace() and c != 0x20)
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Letters that every Unicode version calls letters, then ASCII marks other than the apostrophe; a line break may part two such.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)(?:\n([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*))?")


def words(text: str) -> list[str]:
    """Cut at every single space between two characters that aren't white space.

    Neither tokenizer family has a match that spans such a place, so the words (all but the first with one space in
    front) can be encoded one by one. The cut drops that space.
    """
    if "  " in text or text[:1] == " " or text[-1:] == " " or any(c in text and (f" {c}" in text or f"{c} " in text) for c in SPACES):
        return _CUT.split(text)
    return text.split(" ")


#: A letter that every Unicode version calls one (ASCII and Latin-1 letters, kana, Chinese characters, Korean syllables),
#: before white space or a mark that is no apostrophe: byte-level patterns end a match there. White space that follows white
#: space, and a letter after a mark, are no such places.
_ENDS = re.compile(r"(?<=[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3])(?=[ \t\n\r\x0b\x0c\u3000!-&(-/:-@\[-`{-~\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])")


def safe_parts(text: str, size: int, special: tuple[str, ...] = ()) -> list[str]:
    """`text` cut into parts of about `size` characters where byte-level patterns end a match; a text with one of the
    special strings isn't cut inside of them, and one without such places not at all."""
    if len(text) <= size:
        return [text]
    parts, start = [], 0
    for m in _ENDS.finditer(text):
        at = m.start()
        if at - start >= size and not any(s in text[max(at - len(s) + 1, 0) : at + len(s) - 1] for s in special):
            parts.append(text[start:at])
            start = at
    return [*parts, text[start:]]


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordIds(dict):
    """Little-endian unsigned 32-bit ids of words, encoded by the tokenizers library at the first sight of each.

    The memory is bounded: at `limit` words no more are kept, which changes no result. Words of letters and plain marks
    go to the library's model directly, as their pre-tokens are known; all others through the whole encoder.
    """

    def __init__(self, path: str, space: bool, fold: bool = False, limit: int = 150_000):
        super().__init__()
        self.encoder, self.space, self.fold, self.limit = tokenizer(path), space, fold, limit
        self.tokenize, self.letters = self.encoder.model.tokenize, byte_letters()
        self.packed = [i.to_bytes(4, "little") for i in range(self.encoder.get_vocab_size())]
        self.gap = self.letters[0x20] if space else ""
        self.parts: dict[str, bytes] = {"": b""}

    def part(self, text: str) -> bytes:
        """Ids of one pre-token in byte letters."""
        found = self.parts.get(text)
        if found is None:
            plain = text if text.isascii() and text.isprintable() else "".join([self.letters[b] for b in text.encode()])
            packed = self.packed
            found = b"".join([packed[t.id] for t in self.tokenize(plain)])
            if len(self.parts) < self.limit:
                self.parts[text] = found
        return found

    def spaced(self, text: str) -> bytes:
        """Ids of letters with a space in front."""
        if not self.space:
            return self.part(text)
        found = self.parts.get(key := " " + text)
        if found is None:
            plain = text if text.isascii() else "".join([self.letters[b] for b in text.encode()])
            packed = self.packed
            found = b"".join([packed[t.id] for t in self.tokenize(self.gap + plain)])
            if len(self.parts) < self.limit:
                self.parts[key] = found
        return found

    def encoded(self, text: str) -> bytes:
        return np.array(self.encoder.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(word) <= 64 and (m := _PLAIN.fullmatch(word)):
            head, tail, next_head, next_tail = m.groups()
            ids = self.spaced(head.lower() if self.fold else head) + self.part(tail)
            if next_head:
                ids += (self.part("\n") if self.space else b"") + self.part(next_head.lower() if self.fold else next_head) + self.part(next_tail)
        else:
            ids = self.encoded((" " if self.space else "") + word)
            if len(word) > 64:
                return ids
        if len(self) < self.limit:
            self[word] = ids
        return ids

    def text(self, text: str) -> bytes:
        """Ids of a whole text."""
        head, *rest = words(text)
        return self.encoded(head) + b"".join(map(self.__getitem__, rest)) if rest else self.encoded(text)
