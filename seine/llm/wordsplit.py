"""Normaliser and pre-tokeniser of word-level BPE vocabularies with word ends (tokenizers JSON files)."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from functools import lru_cache

from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

#: The contractions that the pre-tokeniser keeps together, in its order.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
#: Unicode white space.
SPACE = "\t-\r \x85\xa0  -     　"
END = "</w>"
_SEPARATOR = re.compile("[\x1c-\x1f]").search


@lru_cache(None)
def char_class(initial: str) -> str:
    """Ranges of the code points whose general category starts with the letter, for use inside [...]."""
    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    # versions of Unicode differ in what is a letter; the regular expressions of the tokenizers library decide
    runs = Split(Regex(f"\\p{{{initial}}}+"), "removed", invert=True).pre_tokenize_str(every)
    return "".join(f"\\U{ord(t[0]):08x}-\\U{ord(t[-1]):08x}" for t, _ in runs)


def byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stays, every other byte gets the next character from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return {b: chr(b if b in set(plain) else next(rest)) for b in range(256)}


class WordSplitter:
    """Cuts a text as the vocabulary file says: special strings, then NFC and lower case, then pieces."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.added = {t["content"]: t["id"] for t in self.spec.get("added_tokens", [])}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.spaced = re.compile(f"[^{SPACE}]+").findall
        letter, number = char_class("L"), char_class("N")
        self.ascii = re.compile(f"{CONTRACTIONS}|[a-z]+|[0-9]|[^\t-\r a-z0-9]+").findall
        self.piece = re.compile(f"{CONTRACTIONS}|[{letter}]+|[{number}]|[^{SPACE}{letter}{number}]+").findall

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        # Rust lower-cases each character by itself: no final sigma
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def pieces(self, normal: str) -> list[str]:
        """Pieces of a normalised text without special strings."""
        return self.ascii(normal) if normal.isascii() else self.piece(normal)

    def segments(self, text: str) -> list[str]:
        """The text cut at special strings, which stay as items of their own."""
        return self.special.split(text) if self.special else [text]

    def chunks(self, text: str) -> list[str]:
        """Special strings, and runs of other characters than white space, normalised; pieces never cross their ends.

        In a run that looks like a special string but is none, a line break goes before it, so that the two differ."""
        if "<|" in text:
            out = []
            for s in self.segments(text):
                out.extend([s] if s in self.added else ["\n" + c if c in self.added else c for c in self.chunks_of(self.normal(s))])
            return out
        return self.chunks_of(self.normal(text))

    def chunks_of(self, normal: str) -> list[str]:
        # str.split() also cuts at the four separators \x1c-\x1f, which are no white space to the vocabulary
        return normal.split() if not _SEPARATOR(normal) else self.spaced(normal)
