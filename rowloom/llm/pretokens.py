"""Pre-tokens of a byte-level BPE file, exactly as its library splits them."""

from __future__ import annotations

import json
import re
from functools import lru_cache

#: The byte-level pattern with built-in classes, for characters on which both agree; letters come first as they are most.
PLAIN = re.compile(r" ?[^\W\d_]+| ?\d+|'(?:s|t|re|ve|m|ll|d)| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: A space that is not followed by a character that is surely no white space.
UNSURE_SPACE = re.compile(r" (?![\w!-~])")


class PreTokens:
    """Splits texts into special strings and pre-tokens.

    Characters are probed once against the library: where the plain pattern puts it in the same class, the fast pattern
    splits; a text with any other character is split by the library itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            self.spec = json.load(file)
        shape = self.spec["pre_tokenizer"] or {}
        if shape.get("type") != "ByteLevel" or shape.get("add_prefix_space") or not shape.get("use_regex") or self.spec["normalizer"]:
            raise ValueError("a byte-level file without prefix space and normalizer is expected")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in self.spec["added_tokens"]):
            raise ValueError("added tokens that take their surroundings are not supported")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        longest = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.same: set[str] = set()
        self.other: set[str] = set()

    def plain(self, text: str) -> bool:
        """Whether the fast pattern gives this text's pre-tokens."""
        seen = set(text) - self.same
        for c in seen - self.other:
            probe = f"a{c}1{c}! {c} b{c}{c}"
            spans = [span for _, span in self.library.pre_tokenizer.pre_tokenize_str(probe)]
            (self.same if spans == [m.span() for m in PLAIN.finditer(probe)] else self.other).add(c)
        return not seen & self.other

    def segments(self, text: str) -> list[str]:
        """The text cut at special strings, which stand at the odd places."""
        if self.cut is None or not any(s in text for s in self.special):
            return [text]
        return self.cut.split(text)

    def split(self, segment: str) -> list[str]:
        if self.plain(segment):
            return PLAIN.findall(segment)
        return [segment[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(segment)]


@lru_cache(maxsize=2)
def pre_tokens(path: str) -> PreTokens:
    """One splitter per worker and file."""
    return PreTokens(path)
