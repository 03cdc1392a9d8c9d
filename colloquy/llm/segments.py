"""Exact cuts of a text for tokenizers, and a bounded memo of what short parts give."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

# A segment longer than this is not remembered, so the memo's size is bounded.
LONGEST_KEPT = 48
# Entries of one memo; beyond, it starts anew.
MOST_KEPT = 150_000
# Marks that the split pattern always takes apart from letters before them.
MARKS = frozenset(".,;:!?")


def clean(segment: str) -> bool:
    """Whether blanks on both sides of `segment` are cut points of the split pattern.

    The pattern joins a blank only to what follows it, and looks no further
    than the next character. So a single blank between two characters that are
    no white space always starts a new match.
    """
    return bool(segment) and not segment[0].isspace() and not segment[-1].isspace()


def units(text: str) -> list[str]:
    """Parts of `text`, in order, that a tokenizer with the blank-prefix pattern treats separately."""
    parts = text.split(" ")
    out, safe = [parts[0]], clean(parts[0])
    for part in parts[1:]:
        here = clean(part)
        if safe and here:
            out.append(" " + part)
        else:
            # only a blank between two other characters is a cut
            left = out[-1]
            if left and not left[-1].isspace() and part and not part[0].isspace():
                out.append(" " + part)
            else:
                out[-1] = left + " " + part
        safe = here
    return out


def plain_pieces(unit: str) -> list[str] | None:
    """The pattern's pieces of a word, with or without one mark after it; None for anything else."""
    word = unit[1:] if unit[:1] == " " else unit
    if word.isalpha():
        return [unit]
    if word[-1:] in MARKS and word[:-1].isalpha():
        return [unit[:-1], unit[-1]]
    return None


def byte_characters() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary.

    Bytes that print in Latin-1 stand for themselves, the others for the
    characters from 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Memo:
    """Values of short strings in two generations, so that what is common stays known."""

    def __init__(self, value: Callable[[str], Any], most: int = MOST_KEPT):
        self.value, self.most, self.known, self.older = value, most, {}, {}

    def __call__(self, key: str) -> Any:
        value = self.known.get(key)
        if value is None:
            value = self.older.get(key)
            if value is None:
                value = self.value(key)
            if len(key) <= LONGEST_KEPT:
                if len(self.known) >= self.most // 2:
                    self.older, self.known = self.known, {}
                self.known[key] = value
        return value
