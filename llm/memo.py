"""Ids of words that a task has encoded before, for tokenizers whose pre-tokenizer is one pattern of words.

Only texts of settled characters are split here, those whose classes no Unicode version has changed; their letters and
numbers are spelled out in the pattern, so that the standard library's engine can match it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np

#: words that a task remembers, in two generations: words not met since the older one was young are forgotten
KNOWN = 500_000
#: longest of them
SHORT = 48
SETTLED = re.compile("[\t\n\r -~¡-ɏ]*")


def _spelled(kind: str) -> str:
    """Settled characters of a general category, as the inside of a class."""
    points = [c for c in (*range(0x20, 0x7F), *range(0xA1, 0x250)) if unicodedata.category(chr(c))[0] == kind]
    breaks = [0, *(i for i in range(1, len(points)) if points[i] != points[i - 1] + 1), len(points)]
    return "".join(f"\\u{points[a]:04x}-\\u{points[b - 1]:04x}" for a, b in zip(breaks, breaks[1:]))


def settled_pattern(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace("[\\p{L}]", "\\p{L}").replace("[\\p{N}]", "\\p{N}")
                      .replace("[^\\s\\p{L}\\p{N}]", f"[^\\s{_spelled('L')}{_spelled('N')}]")
                      .replace("\\p{L}", f"[{_spelled('L')}]").replace("\\p{N}", f"[{_spelled('N')}]"))


class WordMemo:
    """``encode`` maps different words to all their ids and the places where each word's begin, and the end; ``spell``, if
    given, ids to the words' decoded texts; ``known`` words are remembered, else ``KNOWN``."""

    def __init__(self, pattern: str, encode: Callable[[list[str]], tuple[list[int], list[int]]],
                 spell: Callable[[list[int]], str] | None = None, known: int | None = None):
        self.most = KNOWN if known is None else known
        self.split = settled_pattern(pattern).findall
        self.encode, self.spell = encode, spell
        self.known: dict[str, bytes] = {}
        self.spelled: dict[str, str] = {}
        self.older, self.older_spelled = self.known, self.spelled

    def words(self, text: str) -> list[str] | None:
        """Words of a settled text, all of them known from then on; None for any other text, or one with a long word."""
        if not SETTLED.fullmatch(text):
            return None
        words = self.split(text)
        new = set(words).difference(self.known)
        if new:
            if max(map(len, new)) > SHORT:
                return None
            if len(self.known) + len(new) > self.most // 2:
                self.older, self.older_spelled = self.known, self.spelled
                self.known, self.spelled = {}, {}
                new = set(words)
            again = {w for w in new if w in self.older}
            self.known.update((w, self.older[w]) for w in again)
            if self.spell:
                self.spelled.update((w, self.older_spelled[w]) for w in again)
            self._learn(list(new - again))
        return words

    def _learn(self, new: list[str]) -> None:
        if not new:
            return
        ids, borders = self.encode(new)
        data = np.array(ids, "<u4").tobytes()
        self.known.update((w, data[4 * b:4 * e]) for w, b, e in zip(new, borders, borders[1:], strict=False))
        if self.spell:
            self.spelled.update((w, self.spell(ids[b:e])) for w, b, e in zip(new, borders, borders[1:], strict=False))

    def pieces(self, words: list[str]) -> list[bytes]:
        """Ids of each word, four bytes an id."""
        return list(map(self.known.__getitem__, words))

    def ids(self, words: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.uint32)
