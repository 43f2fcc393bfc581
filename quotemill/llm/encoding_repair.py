"""Text that was decoded with the wrong character encoding: found, and put right as far as it can be known.

A hidden Markov model labels the characters of a word. One state is clean; every other state stands for
an encoding pair (how the bytes were written, how they were read) and emits what that pair makes of a
clean character. All states score the clean characters they stand for by one model of character
trigrams, so a garbled word is explained best by the pair that turns it into likely text. A path that
turns the whole word into one the corpus knows gets the emission of that word, too. Each labelled span
gets its state's inverse transform; the words of one text are put right by one pair where one explains
them all, for a text was decoded wrongly as a whole.

Every distinct word is labelled once, and the words found garbled are joined back to the texts. Counts
of words are exact: the words that garbled ones may stand for are looked up by a join. The trigrams are
sums over BUCKETS hashed places an order in each of two tables, of which the lesser sum counts: the size of
the model, which is sent to every task. They are learnt by Viterbi training: words that decode strictly as UTF-8 read wrongly are left out at first, then
all words that the model itself calls garbled.

Defined results: null and empty texts are no case. A text with U+FFFD is always a case; a single lost
letter is filled in where the trigrams around it leave little doubt. Later changes of letter case, and
invisible or full-width characters within a garbled word, do not hide it. A no-break space or soft hyphen
alone is read as a letter only if that makes a known word.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.runtime import materialise, spread

#: Places of the trigram model an order, whatever the corpus: trigrams are bounded by the alphabets, words are not.
BUCKETS, ORDERS, TABLES = 1 << 18, 3, 2
#: A reading that makes a word seen KNOWN times or more, and VOCABULARY times as often as the word itself, has its emission.
VOCABULARY, KNOWN, LEXICON = 8, 5, 5.5
ENTER, LEAVE, CONTROL, HIDDEN, BLANK = -4.5, -0.7, -15.0, -7.0, -9.0
#: Where a garbled sequence may stand: anywhere; at a word's end only; anywhere, if the word has a longer one besides.
ANYWHERE, AT_END, BESIDE = range(3)
#: Trigrams with capitals count like those in small letters, at a cost.
CAPITAL = -2.0
#: UTF-8 is what most text is written in.
USUAL = 2.0
#: Readings so far below the clean one still count in a text that another word shows to be garbled the same way.
WEAKEST = ENTER
LOST = "�"
#: Read wrongly from UTF-8, and from one single-byte encoding as another (written, read).
MULTI = ("cp1252", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "koi8_r")
SINGLE = (
    ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1250"), ("cp1252", "cp1251"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"),
    ("cp1251", "cp1252"), ("koi8_r", "cp1251"), ("koi8_r", "cp1252"), ("cp1251", "koi8_r"), ("cp866", "cp1251"), ("cp866", "cp1252"), ("cp1250", "cp1252"), ("iso8859_2", "cp1252"), ("cp437", "mac_roman"), ("mac_roman", "cp437"), ("cp1251", "mac_roman"), ("cp1251", "cp866"),
)
#: Invisible characters that may have been put into a garbled word later on; U+00AD and U+00A0 are not among
#: them, for they are bytes of garbled letters.
INVISIBLE = dict.fromkeys([0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])


def read_as(raw: bytes, encoding: str) -> str:
    """Bytes as read in an encoding; bytes without a character become C1 controls, as lenient readers do."""
    out = []
    for b in raw:
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def alphabet() -> list[str]:
    """Letters and signs of the languages that the encodings above cover."""
    wanted = [*range(0xA0, 0x180), *range(0x218, 0x21C), *range(0x386, 0x3CF), *range(0x400, 0x460), 0x490, 0x491, *range(0x2010, 0x2030), 0x2030, 0x2039, 0x203A, 0x20AC, 0x2116, 0x2122, 0x2126, 0x2190, 0x2192, 0x2205, 0x2206, 0x2211, 0x221A, 0x221E, 0x2248, 0x2260, 0x2264, 0x2265, 0x2300, 0xFEFF]
    return [chr(c) for c in wanted if unicodedata.category(chr(c)) != "Cn"]


def clean_form(c: str) -> str:
    """What a decoded character stands for: spaces become one space, a byte order mark nothing."""
    if c == "﻿":
        return ""
    return " " if unicodedata.category(c) == "Zs" else c


@lru_cache(maxsize=1)
def states() -> list[tuple[str, dict[str, list[tuple[str, str, int]]]]]:
    """(name, first character -> [(garbled, clean, where it may stand)], longest first) of every garbled state. One garbled
    sequence may stand for several characters, where bytes were lost."""
    found = []

    def add(name: str, *pairs: list[tuple[str, str]]) -> None:
        table: dict[str, dict[tuple[str, str, int], None]] = {}
        for form in (lambda x: x, str.lower, str.upper):  # as read, or its letter case changed later
            for where, some in enumerate(pairs):
                for garbled, clean in some:
                    g = form(garbled)
                    if g and not g.isascii() and g != clean:
                        table.setdefault(g[0], {}).setdefault((g, clean, where))
        found.append((name, {k: sorted(v, key=lambda p: -len(p[0])) for k, v in table.items()}))

    letters = alphabet()
    for wrong in MULTI:
        pairs, cut, short = [(read_as(c.encode(), wrong), clean_form(c)) for c in letters], [], []
        if wrong == "cp1252":  # also with undefined bytes dropped, with all bytes as in Latin-1, and with a last byte, a no-break space, lost
            pairs += [(read_as(c.encode(), "latin-1"), clean_form(c)) for c in letters]
            short = [("".join(x for x in g if not 0x80 <= ord(x) < 0xA0), c) for g, c in pairs if any(0x80 <= ord(x) < 0xA0 for x in g)]
            pairs, short = pairs + [(g, c) for g, c in short if len(g) > 1], [(g, c) for g, c in short if len(g) == 1 and c.isalpha()]
            cut = [(g[:-1], c) for g, c in pairs if len(g) == 2 and g[-1] == "\xa0" and c.isalpha()]
        add(f"utf-8 as {wrong}", [(g, c) for g, c in pairs if len(g) > 1], cut, short)
    for wrong in ("cp1252", "latin-1"):
        twice = [(read_as(read_as(c.encode(), wrong).encode(), wrong), clean_form(c)) for c in letters]
        add(f"utf-8 as {wrong}, twice", twice)
        add(f"utf-8 as {wrong}, three times", [(read_as(g.encode(), wrong), c) for g, c in twice])
    mixed = [(read_as(read_as(c.encode(), "latin-1").encode(), "cp1252"), clean_form(c)) for c in letters]
    add("utf-8 as latin-1, then as cp1252", mixed)
    for written, wrong in SINGLE:
        pairs = []
        for b in range(0x80, 0x100):
            try:
                c = bytes([b]).decode(written)
            except UnicodeDecodeError:
                continue
            if unicodedata.category(c)[0] != "C" and read_as(bytes([b]), wrong) != c:
                pairs.append((read_as(bytes([b]), wrong), clean_form(c)))
        add(f"{written} as {wrong}", pairs)
    return found


#: Ligatures that single-byte encodings hold.
LIGATURES = {"\ufb01": "fi", "\ufb02": "fl"}
SPACES = "\xa0\u2002\u2007\u2009\u202f\u3000\u2003\u2004\u2005\u2006\u2008\u200a\u205f\u1680"
#: Letters of other scripts for which clean text is read as their Latin look-alikes, at a cost.
ALIKE = dict(zip("АВЕКМНОРСТУХаеорсухіјѕΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEKMHOPCTYXaeopcyxijsABEZHIKMNOPTYXo"))
ALIKE_BACK = dict(zip("ABEKMHOPCTYXaeopcyx", "АВЕКМНОРСТУХаеорсух"))


def visible(word: str) -> str:
    """The word without what later changes may have put in: invisible characters, full-width forms, accents apart. The
    ligatures that an encoding holds stay, for a pair may have made them of other letters."""
    word = word.translate(INVISIBLE)
    if any(0xFF01 <= ord(c) <= 0xFF5E or 0xFB00 <= ord(c) <= 0xFB06 or 0x300 <= ord(c) < 0x370 for c in word):
        word = "".join(unicodedata.normalize("NFKC", c) if 0xFF01 <= ord(c) <= 0xFF5E or 0xFB00 <= ord(c) <= 0xFB06 and c not in LIGATURES else c for c in word)
        word = unicodedata.normalize("NFC", word)
    letters = {c for c in word if c.isalpha()}
    foreign = {c for c in letters if c in ALIKE}
    if foreign and foreign != letters and all(c in ALIKE or c < "\u0250" for c in letters) and not any(c in word for c in "°±№‚„…‹›"):
        word = word.translate({ord(k): v for k, v in ALIKE.items()})  # look-alikes put into a Latin word
    elif any("\u0400" <= c < "\u0460" and c not in ALIKE for c in letters) and all(c in ALIKE_BACK or c >= "\u0370" for c in letters):
        word = word.translate({ord(k): v for k, v in ALIKE_BACK.items()})
    return word


def folded(word: str) -> str:
    return word.lower().strip(",.;:()")


def places(gram: str) -> tuple[int, int]:
    """Where the gram is counted in the two tables of its order."""
    h = zlib.crc32(gram.encode("utf-8", "surrogatepass"))
    return h & (BUCKETS - 1), BUCKETS + (h >> 14)


def usable(word: str, tables: list[tuple[str, dict]] | None = None) -> list[tuple[str, dict]]:
    """The garbled states that could have made some of the word's characters."""
    return [(name, table) for name, table in (states() if tables is None else tables) if any(c in table and any(word.startswith(g, i) and (where != AT_END or i + len(g) == len(word)) for g, _, where in table[c]) for i, c in enumerate(word) if c > "\x7f")]


def whole(word: str, table: dict) -> tuple[str, list[tuple[int, int, str]]]:
    """(the word with every character read by one state, its spans); of several readings of a sequence the first."""
    at, out, spans = 0, [], []
    while at < len(word):
        g, clean = next(((g, c) for g, c, where in table.get(word[at], ()) if word.startswith(g, at) and (where != AT_END or at + len(g) == len(word))), (word[at], word[at]))
        if g != clean:
            spans.append((at, at + len(g), clean))
        out.append(clean)
        at += len(g)
    return "".join(out), spans


#: A reading of a word: how much likelier it is than the word as it stands, its state, and its spans (start, end, clean text).
Reading = tuple[float, str, tuple[tuple[int, int, str], ...]]


class Model:
    """Character trigrams with back-off, from hashed counts of orders 1 to 3."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts  # ORDERS x (TABLES * BUCKETS)
        self.total = max(1.0, float(counts[0].sum()) / TABLES)
        self.words = self.count("^^")
        #: The states with the characters that the corpus holds at all; no likely path goes through another one.
        self.tables = [(name, {k: own for k, v in table.items() if (own := [e for e in v if e[1] in ("", " ") or self.count(e[1])])}) for name, table in states()]
        self.log_p = lru_cache(maxsize=1 << 18)(self._log_p)

    def count(self, gram: str) -> float:
        a, b = places(gram)
        return float(min(self.counts[len(gram) - 1, a], self.counts[len(gram) - 1, b]))

    def _log_p(self, a: str, b: str, c: str) -> float:
        p1 = (self.count(c) + 0.02) / (self.total + 5000)
        p2 = (self.count(b + c) + 2 * p1) / (self.count(b) + 2)
        p3 = (self.count(a + b + c) + 2 * p2) / (self.count(a + b) + 2)
        score, low = math.log(min(1.0, p3)), (a + b + c).lower()
        return score if low == a + b + c or len(low) != 3 else max(score, self.log_p(*low) + CAPITAL)

    def clean(self, a: str, b: str, c: str) -> tuple[float, str, str]:
        """(score, the two characters before the next one) of a character as it stands."""
        if c in LIGATURES:
            f, second = LIGATURES[c]
            return self.log_p(a, b, f) + self.log_p(b, f, second) - 2.0, f, second
        score = self.log_p(a, b, c)
        if "\x80" <= c < "\xa0":
            return min(score, CONTROL), b, c
        if c == "\xad":
            return max(score, HIDDEN), a, b
        if c in SPACES:
            return max(score, HIDDEN), "^", "^"
        other = ALIKE.get(c) or ALIKE_BACK.get(c)
        if other and score < -6:
            score = max(score, self.log_p(a, b, other) - 5)
        return score, b, c

    def path(self, word: str, table: dict | None, enter: float = ENTER) -> tuple[float, tuple[tuple[int, int, str], ...]]:
        """(score, garbled spans) of the likeliest path through the clean state and the one of the table (Viterbi)."""
        n = len(word)
        # best[i][s]: score, the two clean characters before, back pointer; s = 0 is clean
        best: list[list[tuple | None]] = [[None, None] for _ in range(n + 1)]
        best[0][0] = (0.0, "^", "^", None)

        def put(at: int, state: int, score: float, a: str, b: str, back: tuple) -> None:
            if best[at][state] is None or score > best[at][state][0]:
                best[at][state] = (score, a, b, back)

        for i in range(n):
            c = word[i]
            for s in (0, 1):
                if best[i][s] is None:
                    continue
                score, a, b, _ = best[i][s]
                if c == LOST:
                    put(i + 1, 0, score + s * LEAVE - 8.0, b, c, (i, s, c))
                    continue
                own, x, y = self.clean(a, b, c)
                put(i + 1, 0, score + s * LEAVE + own, x, y, (i, s, c))
                if s and c <= "\x7f":
                    put(i + 1, 1, score + self.log_p(a, b, c), b, c, (i, s, c))
                if table and c in table:
                    move = 0.0 if s else enter
                    for g, clean, where in table[c]:
                        if not word.startswith(g, i) or (where == AT_END and i + len(g) < n):
                            continue
                        if g in "\xa0\xad" and not clean.isalpha():
                            continue  # a space or hyphen put in is likelier than a sign
                        if clean in ("", " "):
                            put(i + len(g), 1, score + move + (BLANK if len(g) == 1 else -3.0), a, b, (i, s, clean))
                        else:
                            put(i + len(g), 1, score + move + self.log_p(a, b, clean), b, clean, (i, s, clean))
        ends = [(f[0] + self.log_p(f[1], f[2], "$"), s) for s, f in enumerate(best[n]) if f is not None]
        score, state = max(ends)
        at, spans = n, []
        while at:
            before, previous, clean = best[at][state][3]
            if state and word[before:at] != clean:
                spans.append((before, at, clean))
            at, state = before, previous
        return score, tuple(reversed(spans))

    def readings(self, word: str, own: float, known: dict[str, float]) -> list[Reading]:
        """Readings of a word (digits are all 0) by the states that could have made it, the likeliest first, down to WEAKEST.
        own: how often the corpus holds the word; known: how often, in folded form, what it may stand for."""
        plain, _ = self.path(word, None)
        out: list[Reading] = []
        for name, table in usable(word, self.tables):
            enter = ENTER + USUAL * name.startswith("utf-8")
            score, spans = self.path(word, table, enter)
            decoded, all_spans = whole(word, table)
            times = known.get(folded(decoded), 0.0)
            sure = all_spans and times >= KNOWN and times > VOCABULARY * own
            if sure:
                known_score = enter + max(self.path(decoded, None)[0], math.log(times / (self.words + times))) + LEXICON + 0.5 * math.log((times + 1) / (own + 1))
                if known_score > score or not spans:
                    score, spans = known_score, tuple(all_spans)
            elif all(word[a:b].strip("\xa0\xad") == "" for a, b, _ in spans):
                continue  # nothing but spaces or hyphens
            if not spans:  # the likeliest path is clean, but the state may still be that of the text
                if all(word[a:b].strip("\xa0\xad") == "" for a, b, _ in all_spans):
                    continue
                score, spans = enter + self.path(decoded, None)[0], tuple(all_spans)
            if not sure and name.startswith("utf-8") and all(b - a == 1 and (word[a], c, AT_END) not in table[word[a]] for a, b, c in spans):
                score = min(score, plain - 0.5)  # first bytes alone are no evidence, but may be read so in a text that has some
            if spans and score - plain > WEAKEST:
                out.append((score - plain, name, spans))
        return sorted(out, key=lambda r: -r[0])

    def fill(self, word: str, at: int) -> str:
        """The letter that was lost at `at`, if the trigrams around it leave little doubt."""
        a, b, d, e = ("^^" + word + "$$")[at], ("^^" + word)[at + 1], (word + "$$")[at + 1], (word + "$$")[at + 2]
        if LOST in (a, b, d, e):
            return LOST
        scores = {c: self.log_p(a, b, c) + self.log_p(b, c, d) + self.log_p(c, d, e) for c in alphabet()[1:] if self.count(c)}
        if not scores:
            return LOST
        top = max(scores, key=scores.get)
        share = 1 / sum(math.exp(max(-50.0, v - scores[top])) for v in scores.values())
        return top if share > 0.9 and scores[top] > -12 else LOST

    def repair(self, text: str, found: dict[int, list[Reading]]) -> str:
        """The text as it was written; found: readings of its words by their place. All words are read by the state that
        explains most; words for which it has no reading by their own best one, if that is likelier than the word."""
        total: dict[str, float] = {}
        for readings in found.values():
            for gain, name, _ in readings:
                total[name] = total.get(name, 0.0) + max(0.0, gain - ENTER)
        proven = {name for readings in found.values() for gain, name, _ in readings[:1] if gain > 0}
        first = max(proven, key=lambda n: total[n], default=None)
        explains = {n: sum(any(r[1] == n for r in readings) for readings in found.values() if readings and readings[0][0] > 0) for n in total}
        if explains:
            most = max(explains.values())
            first = max((n for n in total if explains[n] == most), key=lambda n: (total[n], n), default=first)
        words = text.split(" ")
        for place, word in enumerate(words):
            if LOST not in word and place not in found:
                continue
            seen, readings = visible(word), found.get(place, [])
            use = next((r for r in readings if r[1] == first and r[0] > 0.8 * ENTER), None) or next((r for r in readings if r[0] > 0), None)
            if use is None and LOST not in seen:
                continue
            done, last = [], 0
            for start, end, clean in use[2] if use else ():
                done += [seen[last:start], clean]
                last = end
            fixed = "".join(done) + seen[last:]
            while LOST in fixed:
                at = fixed.index(LOST)
                letter = self.fill(fixed, at)
                if letter == LOST:
                    break
                fixed = fixed[:at] + letter + fixed[at + 1 :]
            words[place] = fixed
        return " ".join(words)


def strictly_garbled(word: str) -> bool:
    """Whether a word holds a letter that reads as UTF-8 decoded wrongly, by tables alone."""
    multi = [t for name, t in states() if name.startswith("utf-8")]
    return LOST in word or any(c in t and any(len(g) > 1 and word.startswith(g, i) for g, _, _ in t[c]) for t in multi for i, c in enumerate(word) if c > "\x7f")


NOT_ASCII = "[^\\x00-\\x7F]"
KNOWN_WORDS = "word string, n long, own long, known array<struct<text:string,n:long>>"
LABELS = "word string, gain double, readings array<struct<gain:double,state:string,spans:array<struct<start:int,stop:int,clean:string>>>>"
_MODELS: dict[int, Model] = {}


def model_of(counts: np.ndarray) -> Model:
    """One model a worker and table of counts, so that what it knows is kept between batches."""
    key = zlib.crc32(counts.tobytes())
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(counts)
    return _MODELS[key]


def _add(counts: np.ndarray, word: str, n: int) -> None:
    padded = f"^^{word}$$"
    for i in range(len(padded)):
        for k in range(min(ORDERS, len(padded) - i)):
            for at in places(padded[i : i + k + 1]):
                counts[k, at] += n


def _sums(counts: np.ndarray) -> pa.RecordBatch:
    order, at = np.nonzero(counts)
    return pa.RecordBatch.from_arrays([pa.array(order.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[order, at])], names=["kind", "bucket", "n"])


def _plain_grams(batches):
    counts = np.zeros((ORDERS, TABLES * BUCKETS), np.int64)
    for batch in batches:
        for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
            _add(counts, word, n)
    yield _sums(counts)


def _other_grams(model_counts: np.ndarray | None):
    def run(batches):
        model = model_of(model_counts) if model_counts is not None else None
        counts = np.zeros((ORDERS, TABLES * BUCKETS), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                seen = visible(row["word"])
                if LOST in seen or (best(model, row) > 0 if model else strictly_garbled(seen)):
                    continue
                _add(counts, "".join(LIGATURES.get(c, c) for c in seen), row["n"])
        yield _sums(counts)

    return run


def best(model: Model, row: dict) -> float:
    found = model.readings(visible(row["word"]), row["own"], {k["text"]: k["n"] for k in row["known"]})
    return found[0][0] if found else -math.inf


def _forms(batches):
    """(word, n, form, own): the folded form of each word, and of all that a word beyond ASCII may stand for."""
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
            seen = visible(word)
            forms = {folded(whole(seen, table)[0]): False for _, table in usable(seen)} | {folded(seen): True}
            for form, own in forms.items():
                for column, value in zip(out, (word, n, form, own)):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.string(), pa.bool_()))], names=["word", "n", "form", "own"])


def _folded_words(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([folded(w) for w in batch.column("word").to_pylist()], pa.string()), batch.column("n")], names=["form", "n"])


def _strict(batches):
    for batch in batches:
        yield batch.filter(pa.array([not strictly_garbled(visible(w)) for w in batch.column("word").to_pylist()], pa.bool_()))


def words_of(texts: DataFrame, column: str = "description") -> DataFrame:
    """(word, n) of all texts, digits as 0."""
    return texts.select(F.explode(F.split(F.regexp_replace(column, "[0-9]", "0"), " ")).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def train(texts: DataFrame, column: str = "description") -> tuple[np.ndarray, DataFrame]:
    """(trigram counts, KNOWN_WORDS of every word beyond ASCII). What reaches the driver are at most ORDERS x TABLES x BUCKETS sums."""
    words = materialise(words_of(texts, column), "words")
    plain = spread(words.where(~F.col("word").rlike(NOT_ASCII)))
    other = spread(words.where(F.col("word").rlike(NOT_ASCII)))
    counted = plain.mapInArrow(_folded_words, "form string, n long").unionByName(other.mapInArrow(_strict, "word string, n long").mapInArrow(_folded_words, "form string, n long"))
    counted = counted.groupBy("form").agg(F.sum("n").alias("times"))
    forms = other.mapInArrow(_forms, "word string, n long, form string, own boolean").join(counted, "form", "left")
    times = F.coalesce("times", F.lit(0))
    known = forms.groupBy("word", "n").agg(F.max(F.when(F.col("own"), times)).alias("own"), F.collect_list(F.when(~F.col("own") & (times >= KNOWN), F.struct(F.col("form").alias("text"), times.alias("n")))).alias("known"))
    known = spread(materialise(known.select("word", "n", "own", "known"), "known"))
    kind = "kind int, bucket int, n long"

    def gathered(rows: DataFrame) -> np.ndarray:
        sums = rows.groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros((ORDERS, TABLES * BUCKETS), np.float64)
        counts[sums["kind"].to_numpy(int), sums["bucket"].to_numpy(int)] = sums["n"].to_numpy(float)
        return counts

    fixed = gathered(plain.mapInArrow(_plain_grams, kind))
    first = fixed + gathered(known.mapInArrow(_other_grams(None), kind))
    return fixed + gathered(known.mapInArrow(_other_grams(first), kind)), known


def _labels(counts: np.ndarray):
    spans = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("clean", pa.string())]))
    schema = pa.schema([("word", pa.string()), ("gain", pa.float64()), ("readings", pa.list_(pa.struct([("gain", pa.float64()), ("state", pa.string()), ("spans", spans)])))])

    def run(batches):
        model = model_of(counts)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [])
            for row in batch.to_pylist():
                seen = visible(row["word"])
                found = model.readings(seen, row["own"], {k["text"]: k["n"] for k in row["known"]})
                if found or LOST in seen:
                    out[0].append(row["word"])
                    out[1].append(math.inf if LOST in seen else found[0][0])
                    out[2].append([{"gain": g, "state": s, "spans": [{"start": a, "stop": b, "clean": c} for a, b, c in spans]} for g, s, spans in found])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return run


def labelled_words(texts: DataFrame, asked: DataFrame | None = None) -> tuple[np.ndarray, DataFrame]:
    """(the model's counts, LABELS of the distinct words that could be garbled; they are if gain > 0), of all words or of
    those asked for (a column `word`)."""
    counts, known = train(texts)
    known = known if asked is None else spread(known.join(asked.distinct(), "word", "left_semi"))
    return counts, materialise(known.mapInArrow(_labels(counts), LABELS), "labels")


def placed_words(items: DataFrame) -> DataFrame:
    """(item_id, place, word) of the words beyond ASCII of every item."""
    words = items.where(F.col("description").rlike(NOT_ASCII)).select("item_id", F.posexplode(F.split("description", " ")).alias("place", "word"))
    return words.where(F.col("word").rlike(NOT_ASCII)).withColumn("word", F.regexp_replace("word", "[0-9]", "0"))


def garbled_ids(items: DataFrame, labels: DataFrame) -> DataFrame:
    """item_id of the items that hold a garbled word. Labels are few words; if they are many, the join is by word."""
    return placed_words(items).join(labels.where("gain > 0").select("word"), "word").select("item_id").distinct()


def _repaired_rows(counts: np.ndarray):
    def run(batches):
        model = model_of(counts)
        for batch in batches:
            fixed = []
            for text, hits in zip(batch.column("description").to_pylist(), batch.column("hits").to_pylist()):
                found = {h["place"]: [(r["gain"], r["state"], tuple((s["start"], s["stop"], s["clean"]) for s in r["spans"])) for r in h["readings"]] for h in hits}
                fixed.append(model.repair(text, found))
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(fixed, pa.string())], names=["item_id", "fixed"])

    return run


def repaired(items: DataFrame) -> DataFrame:
    """(item_id, restored, garbled) of every item; texts without a garbled word are as they were."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "description")
    counts, labels = labelled_words(items)
    hits = placed_words(items).join(labels, "word").groupBy("item_id").agg(F.max("gain").alias("gain"), F.collect_list(F.struct("place", "readings")).alias("hits")).where("gain > 0")
    fixed = items.join(hits, "item_id").select("item_id", "description", "hits").mapInArrow(_repaired_rows(counts), "item_id long, fixed string")
    return items.join(fixed, "item_id", "left").select("item_id", F.coalesce("fixed", "description").alias("restored"), F.col("fixed").isNotNull().alias("garbled"))


def garbled_items(items: DataFrame) -> DataFrame:
    """item_id of every item whose description, wholly or in part, was decoded wrongly."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "description")
    return garbled_ids(items, labelled_words(items)[1])
