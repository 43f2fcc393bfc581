"""Listings taken apart: three dimensions in millimetres, an article code, and the words that are left."""

from __future__ import annotations

import re

NUMBER = r"\d+-\d+/\d+|\d+/\d+|\d+(?:\.\d+)?"
UNIT = r"(?:mm|cm|\"|″|''|[a-z]{2,6}\b)"
#: Units of length in millimetres.
UNITS = {"mm": 1.0, "cm": 10.0, '"': 25.4, "″": 25.4, "''": 25.4, "in": 25.4, "inch": 25.4, "inches": 25.4}
TRIPLE = re.compile(rf"(?<![\w.])({NUMBER})\s*({UNIT})?\s*[x×*]\s*({NUMBER})\s*({UNIT})?\s*[x×*]\s*({NUMBER})\s*({UNIT})?", re.I)
LABELLED = re.compile(rf"\b([lwhd])\s*=?\s*({NUMBER})\s*({UNIT})?", re.I)
CODE = re.compile(r"(?:\b(?:art\.?|ref\.?|no\.?|item|sku|mpn)\s*:?\s*)?\b([a-z]{2})[- ]?(\d{6,9})([a-z])?\b", re.I)
WORDS = re.compile(r"[^\W_]+(?:\.\d+)?")


def value(number: str) -> float:
    whole, _, part = number.rpartition("-") if "/" in number and "-" in number else ("0", "", number)
    if "/" in part:
        above, below = part.split("/")
        return float(whole) + (float(above) / float(below) if float(below) else 0.0)
    return float(number)


def slips(word: str) -> set[str]:
    """The word with two neighbouring letters swapped, or one letter lost."""
    return {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)} | {word[:i] + word[i + 1 :] for i in range(len(word))}


#: Units of four letters or more are known with one slip, too.
SLIPS = {slip: size for word, size in UNITS.items() if len(word) >= 4 for slip in slips(word)}


def unit(text: str | None) -> float | None:
    return None if not text else UNITS.get(text.lower()) or SLIPS.get(text.lower())


def take_apart(text: str) -> tuple[list[float], str, list[str]]:
    """(dimensions in mm, longest first; code; words). Without three dimensions the list is empty; the last unit
    holds for figures without one, and millimetres where none is given."""
    sizes: list[float] = []
    rest = text
    m = TRIPLE.search(text)
    if m:
        figures = [(m[1], m[2]), (m[3], m[4]), (m[5], m[6])]
        stop = m.start(6) if m[6] and not unit(m[6]) else m.end()
        rest = text[: m.start()] + " , " + text[stop:]
    else:
        found = list(LABELLED.finditer(text))
        by = {}
        for f in found:
            by.setdefault(f[1].lower(), f)
        if len(by) == 3:
            figures = [(f[2], f[3]) for f in sorted(by.values(), key=lambda f: f.start())]
            for f in sorted(by.values(), key=lambda f: -f.start()):
                rest = rest[: f.start()] + " , " + rest[f.start(3) if f[3] and not unit(f[3]) else f.end() :]
        else:
            figures = []
    if figures:
        known = [unit(u) for _, u in figures]
        last = next((u for u in reversed(known) if u), 1.0)
        sizes = sorted((value(n) * (u or last) for (n, _), u in zip(figures, known)), reverse=True)
    m = CODE.search(rest)
    code = ""
    if m:
        code = (m[1] + m[2] + (m[3] or "")).upper()
        rest = rest[: m.start()] + " , " + rest[m.end() :]
    return sizes, code, WORDS.findall(rest.lower())
