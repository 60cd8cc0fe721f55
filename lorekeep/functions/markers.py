"""F-11: many literals at token boundaries in one pass over a text, by an automaton of all of them."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import ahocorasick


@lru_cache(maxsize=1 << 16)
def fold(c: str) -> str:
    """One character for all cases of a character, as a search that ignores case has it; those that grow stay as they are.

    A capital i with a dot is the exception: its small form is a plain i.
    """
    if c == "\u0130":
        return "i"
    up = c.upper() if len(c.upper()) == 1 else c
    return up.lower() if len(up.lower()) == 1 else up


def folded(text: str) -> str:
    return text.lower() if text.isascii() else "".join(map(fold, text))


@lru_cache(maxsize=1 << 16)
def joins(c: str) -> bool:
    """Whether a character continues a token: a letter that has a case, or a number."""
    return unicodedata.category(c) in ("Lu", "Ll", "Lt", "Nd", "Nl", "No")


def bounded(marker: str, text: str, start: int, end: int) -> bool:
    """Whether ``marker``, found at text[start:end] in any case, stands at token boundaries there, as ``text.marker_pattern`` has them."""
    first, last = marker[0], marker[-1]
    open_left, open_right = start == 0 or not joins(text[start - 1]), end == len(text) or not joins(text[end])
    after_lower = start > 0 and unicodedata.category(text[start - 1]) == "Ll"
    if len(marker) == 1:
        return open_right and (open_left or (first.isupper() and after_lower and text[start] == first))
    left = open_left or (first.lower() != first.upper() and after_lower and text[start] == first.upper())
    right = open_right or (last.lower() != last.upper() and text[end - 1] == last.lower() and unicodedata.category(text[end]) == "Lu")
    return left and right


class Markers:
    """An automaton of (marker, client) pairs; ``clients(text)`` are those of whose markers one stands in the text."""

    def __init__(self, pairs: Iterable[tuple[str, int]]):
        self.automaton = ahocorasick.Automaton()
        found: dict[str, dict[str, set[int]]] = {}
        for marker, client in pairs:
            found.setdefault(folded(marker), {}).setdefault(marker, set()).add(client)
        for key, own in found.items():
            self.automaton.add_word(key, (len(key), [(m, frozenset(c)) for m, c in own.items()]))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def clients(self, text: str | None) -> set[int]:
        out: set[int] = set()
        if text and not self.empty:
            for last, (length, own) in self.automaton.iter(folded(text)):
                for marker, clients in own:
                    if not clients <= out and bounded(marker, text, last + 1 - length, last + 1):
                        out |= clients
        return out
