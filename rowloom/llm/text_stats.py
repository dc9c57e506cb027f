"""Per-document counts used by the quality rules (plain helpers, one text at a time)."""

from __future__ import annotations

import numpy as np

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice in the text."""
    n = len(words)
    if n < 4:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    v = len(index)
    if v < 2_000_000:
        keys = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
    else:  # the product would overflow: number the pairs first
        pairs = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)[1]
        keys = pairs[:-1] * v + ids[2:]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    often = np.zeros(n - 2, bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    inside[:-2] |= often
    inside[1:-1] |= often
    inside[2:] |= often
    return int(inside.sum())


def duplicate_lines(raw: bytes) -> int:
    """Lines holding a word that equal an earlier line."""
    seen: set[bytes] = set()
    n = 0
    for line in raw.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip():
            seen.add(line)
    return n


def count_text(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - sum(map(text.count, BLANKS))
    return len(words), chars, sum(map(text.count, SYMBOLS)), duplicate_lines(raw), repeated_words(words)
