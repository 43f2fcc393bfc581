"""One consistent form of text that looks the same but is stored with different characters.

The canonical form composes removal of default-ignorable characters, mapped white space, look-alike
letters brought to the script of their text, compatibility normalisation (NFKC) and full case folding,
computed once for each distinct value of a batch. Its first stage, same_look(), stops short of letter
case and of the characters whose compatibility form looks different (superscripts, fractions, ordinals,
trade marks); a text is stored with other characters than it shows if this stage changes it.

Defined results: null stays null, an empty text empty. A text in another script as a whole is clean.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm import encoding_repair
from quotemill.runtime import code_points, materialise

WIDE, LIGATURE, ACCENT, IGNORED, SPACE, ALIKE = (1 << k for k in range(6))
#: Cyrillic and Greek letters that look like Latin ones, with those.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеорсухіјѕԁԛԝһ", "ABESIJKMHOPCTYXaeopcyxijsdqwh"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲν", "ABEZHIKMNOPTYXocv"))
TO_LATIN = {ord(k): v for k, v in (CYRILLIC | GREEK).items()}
TO_CYRILLIC = {ord(v): k for k, v in CYRILLIC.items() if v in "ABEKMHOPCTYXaeopcyx"}
#: Default-ignorable characters beyond the format characters (category Cf).
OTHER_IGNORED = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0))
_TABLE: list[np.ndarray] = []


def properties() -> np.ndarray:
    if not _TABLE:
        table = np.zeros(0x110000, np.uint8)
        for code in (*range(0x80, 0xD800), *range(0xE000, 0x20000), *range(0xE0000, 0xE0200)):
            c = chr(code)
            category, form = unicodedata.category(c), unicodedata.decomposition(c)
            if form.startswith("<wide>") or form.startswith("<narrow>"):
                table[code] = WIDE
            elif 0xFB00 <= code <= 0xFB06 or 0xFB13 <= code <= 0xFB17 or code in (0x132, 0x133, 0x1C4, 0x1C5, 0x1C6, 0x1C7, 0x1C8, 0x1C9, 0x1CA, 0x1CB, 0x1CC):
                table[code] = LIGATURE
            elif 0x300 <= code < 0x370 or 0x1AB0 <= code < 0x1B00 or 0x1DC0 <= code < 0x1E00 or 0x20D0 <= code < 0x2100 or 0xFE20 <= code < 0xFE30:
                table[code] = ACCENT
            elif category == "Zs":
                table[code] = SPACE
            elif category == "Cf" and not 0x600 <= code <= 0x6DD:
                table[code] = IGNORED
        table[list(OTHER_IGNORED)] = IGNORED
        table[0x3000] = SPACE
        table[list(TO_LATIN)] = ALIKE
        table[0x370:0x530][table[0x370:0x530] == 0] = ALIKE  # any letter of these scripts, beside which Latin look-alikes may stand
        _TABLE.append(table)
    return _TABLE[0]


def kinds(texts: pa.Array) -> np.ndarray:
    """The properties that occur in each text, as bits."""
    codes, lengths = code_points(texts)
    bits = properties()[codes]
    ends = np.cumsum(lengths)
    out = np.zeros(len(lengths), np.uint8)
    for bit in (WIDE, LIGATURE, ACCENT, IGNORED, SPACE, ALIKE):
        sums = np.concatenate([[0], np.cumsum((bits & bit) > 0)])
        out |= np.where(sums[ends] > sums[ends - lengths], bit, 0).astype(np.uint8)
    return out


WORD = re.compile(r"[^\W\d_]+(?:[​-‍⁠﻿­̀-ͯ]+[^\W\d_]+)*")


def script(c: str) -> str:
    code = ord(c)
    if 0x370 <= code < 0x400 or 0x1F00 <= code < 0x2000:
        return "G"
    if 0x400 <= code < 0x530:
        return "C"
    return "L" if code < 0x250 or 0x1E00 <= code < 0x1F00 or 0xFF21 <= code <= 0xFF5A else "O"


def scripts(text: str) -> tuple[bool, bool, bool]:
    """(Latin, Cyrillic, Greek) letters of the text that look like no other script's. Symbols such as kΩ or µ, a single
    Greek letter without look-alikes, say nothing about the text."""
    latin = cyrillic = greek = 0
    for word in WORD.findall(text):
        marks = {script(c) for c in word if c.isalpha() and ord(c) not in TO_LATIN and ord(c) not in TO_CYRILLIC}
        latin += "L" in marks
        cyrillic += "C" in marks
        greek += "G" in marks and sum(script(c) == "G" for c in word) > 1
    return latin > 0, cyrillic > 0, greek > 0


def to_script(text: str) -> str:
    """Look-alike letters as letters of the script of their word, or of the text where a word leaves it open."""
    latin, cyrillic, greek = scripts(text)

    def word(m: re.Match) -> str:
        w = m[0]
        own = {script(c) for c in w if c.isalpha() and ord(c) not in TO_LATIN and ord(c) not in TO_CYRILLIC}
        used = {script(c) for c in w if c.isalpha()}
        if used == {"L"} or not used & {"L", "C", "G"}:
            # a Latin-looking word inside a text of another script stays, unless single letters replace look-alikes
            return w
        if "C" in own and "L" not in own:
            return w.translate(TO_CYRILLIC)
        if "L" in own and not own & {"C", "G"}:
            return w.translate(TO_LATIN)
        if own == {"G"} and used == {"G"}:
            return w
        if not own:  # every letter has a look-alike
            if len(used) > 1:
                return w.translate(TO_CYRILLIC) if cyrillic and not latin and "C" in used else w.translate(TO_LATIN)
            alone = "C" if "C" in used else "G"
            home = cyrillic if alone == "C" else greek
            return w.translate(TO_LATIN) if latin and not home else w
        return w

    return WORD.sub(word, text)


def same_look(text: str) -> str:
    """The text in the characters that it shows: no ignorable ones, one space for each, composed letters, full-width forms
    and ligatures as plain letters, look-alikes in the script of their word. Only what looks the same is changed."""
    if text.isascii():
        return text
    out = []
    for c in text:
        own = properties()[ord(c)] if c > "\x7f" else 0
        if own & IGNORED:
            continue
        out.append(" " if own & SPACE else unicodedata.normalize("NFKC", c) if own & (WIDE | LIGATURE) else c)
    return to_script(unicodedata.normalize("NFC", "".join(out)))


def canonical(text: str) -> str:
    """The one form of a text."""
    form = unicodedata.normalize("NFKC", same_look(text))
    form = "".join(" " if unicodedata.category(c) == "Zs" or c in "\t\n\r\v\f" else c for c in form)
    return unicodedata.normalize("NFKC", re.sub(" +", " ", form).strip().casefold())


def _canonical_rows(batches):
    for batch in batches:
        texts = batch.column("description").dictionary_encode()
        forms = pa.array([None if t is None else canonical(t) for t in texts.dictionary.to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), forms.take(texts.indices)], names=["item_id", "canonical"])


def canonical_items(items: DataFrame) -> DataFrame:
    """(item_id, canonical) of every item."""
    return items.select(F.col("item_id").cast("long").alias("item_id"), "description").mapInArrow(_canonical_rows, "item_id long, canonical string")


def _dirty_rows(batches):
    for batch in batches:
        texts = batch.column("description").dictionary_encode()
        perhaps = kinds(texts.dictionary) > 0 if len(texts.dictionary) else []  # all that same_look() can change
        dirty = pa.array([bool(p) and (t := v.as_py()) != same_look(t) for p, v in zip(perhaps, texts.dictionary)], pa.bool_())
        keep = dirty.take(texts.indices).fill_null(False)
        yield pa.RecordBatch.from_arrays([batch.column("item_id").filter(keep), batch.column("description").filter(keep)], names=["item_id", "description"])


def lookalike_items(items: DataFrame) -> DataFrame:
    """item_id of every item whose description is stored with other characters than it seems to hold; texts that were
    decoded wrongly are another problem's cases."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "description")
    dirty = materialise(items.where(F.col("description").rlike(encoding_repair.NOT_ASCII)).mapInArrow(_dirty_rows, "item_id long, description string"), "dirty")
    labels = encoding_repair.labelled_words(items, encoding_repair.placed_words(dirty).select("word"))[1]
    return dirty.select("item_id").join(encoding_repair.garbled_ids(dirty, labels), "item_id", "left_anti")
