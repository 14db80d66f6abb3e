"""Ids of texts by a file of the tokenizers library, word by word.

Many tokenizers cut a text into words by a pattern before they merge bytes, so
a word has the same ids wherever it stands. A worker remembers the ids of words
it has met, has the library encode only the others, and joins them; the library
itself takes 10 to 18 microseconds a word, met before or not.

This way is open only to files whose normalizer and pattern are known here, and
to texts in which every code point is below U+0250: those are all assigned, none
changes in normal form C, and their classes are the same in every version of
Unicode. All other files and texts go to the library whole. The ids are the
library's in both cases.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterable, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np

ID = np.dtype("<u4")

#: Words whose ids a worker remembers before it forgets all of them.
REMEMBERED = 400_000

#: Words given to the library as one text.
TOGETHER = 512

#: Code points under this one are cut into words here.
KNOWN_POINTS = 0x250

# The white space that the library knows under U+0250, and the two
# patterns of words that are known here, in the library's own notation.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0"
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTERS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LOWER_CASE = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
    {"type": "Lowercase"},
]


def _points(category: str) -> str:
    """The code points of a class, lower-cased ones too, as the inside of a bracket."""
    known = [chr(point) for point in range(KNOWN_POINTS)]
    return "".join(
        f"\\u{ord(char):04x}"
        for char in sorted({*known, *chain.from_iterable(map(str.lower, known))})
        if unicodedata.category(char)[0] == category
    )


def _own(pattern: str) -> re.Pattern[str]:
    """A pattern of the library for texts under U+0250, without property classes."""
    inside = {r"\p{L}": _points("L"), r"\p{N}": _points("N"), r"\s": SPACE}
    for name, points in inside.items():
        pattern = re.sub(rf"(\[[^\]]*){re.escape(name)}", lambda m: m[1] + points, pattern)
        pattern = re.sub(rf"(\[[^\]]*){re.escape(name)}", lambda m: m[1] + points, pattern)
        pattern = pattern.replace(name, f"[{points}]")
    return re.compile(pattern.replace(r"\S", f"[^{SPACE}]"))


def _words_of(parts: dict) -> tuple[Callable[[str], list[str]], bool] | None:
    """How a file cuts texts into words, and whether words may be joined by spaces."""
    if parts["model"]["type"] != "BPE" or parts["post_processor"] is not None:
        return None
    cut = parts["pre_tokenizer"] or {}
    if parts["normalizer"] is None:
        plain = cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"]
        return (_own(BYTE_LEVEL).findall, False) if plain else None
    steps = cut.get("pretokenizers", [])
    if (
        parts["normalizer"].get("normalizers") == LOWER_CASE
        and [step["type"] for step in steps] == ["Split", "ByteLevel"]
        and steps[0] | {"type": "Split"}
        == {
            "type": "Split",
            "pattern": {"Regex": LETTERS},
            "behavior": "Removed",
            "invert": True,
        }
        and not steps[1]["use_regex"]
        and not steps[1]["add_prefix_space"]
    ):
        split = _own(LETTERS).findall
        return lambda text: split(text.lower()), True
    return None


class WordIds:
    """Encodes texts by the JSON of a tokenizers file, without special tokens added.

    ``plain`` says whether the strings of special tokens inside texts are
    ordinary text; else they are those tokens.
    """

    def __init__(self, file: str, plain: bool = True):
        # One task, one core: the library's own threads would only compete.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        parts = json.loads(file)
        self.library = Tokenizer.from_str(file)
        self.library.encode_special_tokens = plain
        special = [] if plain else [added["content"] for added in parts["added_tokens"]]
        found = _words_of(parts)
        self.split, self.spaced = found or (None, False)
        self.here = re.compile(f"[\0-{chr(KNOWN_POINTS - 1)}]*").fullmatch
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)").search
        suffix = parts["model"].get("end_of_word_suffix") or "\n"
        tokens = self.library.get_vocab()
        self.sizes = np.zeros(1 + max(tokens.values(), default=0), np.int64)
        self.ends_word = np.zeros(len(self.sizes), bool)
        for token, number in tokens.items():
            self.sizes[number] = len(token)
            self.ends_word[number] = token.endswith(suffix)
        self.known: dict[str, bytes] = {}

    def whole(self, texts: Sequence[str]) -> list[bytes]:
        """The packed ids of texts, by the library."""
        coded = self.library.encode_batch_fast(list(texts), add_special_tokens=False)
        return [np.array(found.ids, ID).tobytes() for found in coded]

    def learn(self, words: Iterable[str]) -> None:
        """Remembers the ids of words, most of them encoded as one text.

        Joined by spaces, or beginning with one, words stay the words they are.
        """
        apart, joined = [], []
        for word in words:
            begins = word[0] == " " and not word[1:2].isspace() and len(word) > 1
            (joined if self.spaced or begins else apart).append(word)
        self.known.update(zip(apart, self.whole(apart)))
        for at in range(0, len(joined), TOGETHER):
            part = joined[at : at + TOGETHER]
            ids = np.frombuffer(self.whole([(" " if self.spaced else "").join(part)])[0], ID)
            stops = self._stops(ids, part) * ID.itemsize
            packed, stops = ids.tobytes(), stops.tolist()
            self.known.update(zip(part, [packed[a:b] for a, b in zip([0, *stops], stops)]))

    def _stops(self, ids: np.ndarray, words: list[str]) -> np.ndarray:
        """After how many ids each of the joined words ends."""
        if self.spaced:
            return np.flatnonzero(self.ends_word[ids]) + 1
        # In a byte-level vocabulary each character of a token is one byte.
        ends = np.cumsum([len(word.encode()) for word in words])
        return np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """The packed ids of each text, unsigned 32-bit little-endian."""
        if self.split is None:
            return self.whole(texts)
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        own = [self.here(text) is not None and not self.special(text) for text in texts]
        words = [self.split(text) if is_own else [] for text, is_own in zip(texts, own)]
        self.learn(set(chain.from_iterable(words)).difference(self.known))
        known = self.known.__getitem__
        coded = [b"".join(map(known, of_text)) for of_text in words]
        others = [at for at, is_own in enumerate(own) if not is_own]
        for at, found in zip(others, self.whole([texts[at] for at in others])):
            coded[at] = found
        return coded


@lru_cache(maxsize=4)
def word_ids(file: str, plain: bool = True) -> WordIds:
    """The worker's encoder of a file; later tasks of a worker find its words known."""
    return WordIds(file, plain)
