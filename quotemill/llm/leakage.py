"""Evaluation passages inside training text, by spaced-seed hashing.

Words (maximal runs of letters or decimal digits, case folded) become 64-bit hashes. A window of
twelve words gives one hash for each mask; a mask looks at six of the twelve positions and ignores
the others. The six masks are all pairs of four blocks of three positions, so any two substituted
words inside a window leave one mask that still hits; for windows without a substitution one mask is
enough. Hashes of the test items meet those of the documents in a join. A row of it holds, beside its
place, a hash of the whole window and 32 bits of each ignored word, by which every hit is checked.

Windows of the corpus that no test window can meet are left out before the shuffle by a table of bits
of fixed size, filled with all test hashes. It only lets too many through when the test items are many.

Defined results: null texts, texts without words and items under twelve words match nothing; a
repeated passage or item gives one row a pair. Case is folded character by character, so that ß and SS differ.
"""

from __future__ import annotations

import unicodedata
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.rolling import CHUNK, ROLLING, mix
from quotemill.runtime import blocks, code_points, materialise

WINDOW = 12
BLOCK = 3
MASKS = [sorted(p for b in pair for p in range(b * BLOCK, b * BLOCK + BLOCK)) for pair in combinations(range(WINDOW // BLOCK), 2)]
REST = [[p for p in range(WINDOW) if p not in mask] for mask in MASKS]
#: Bits of the table of test hashes, a mask: the first FILTER_BITS of a hash are a place in it.
FILTER_BITS = 22
_TABLES: dict[str, np.ndarray] = {}


def tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its folded form, and whether it belongs to a word."""
    if not _TABLES:
        fold, word = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
        for code in (*range(0xD800), *range(0xE000, 0x323B0)):
            c = chr(code)
            category = unicodedata.category(c)
            word[code] = category[0] == "L" or category == "Nd"
            low = c.lower()
            low = low if len(low) == 1 else c
            low = f if len(f := low.casefold()) == 1 else low
            fold[code] = ord(low)
        _TABLES.update(fold=fold, word=word)
    return _TABLES["fold"], _TABLES["word"]


def words(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, hash, text number) of every word of the texts laid end to end; codes are folded in place."""
    fold, word = tables()
    codes = fold[codes]
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = word[codes]
    step = np.diff(inside)
    ends = np.cumsum(lengths)
    edge = ends[:-1][(ends[:-1] > 0) & (ends[:-1] < len(codes))]
    edge = edge[(inside[edge] == 1) & (inside[edge + 1] == 1)]  # a word must not run on into the next text
    first, last = np.sort(np.concatenate([np.flatnonzero(step == 1), edge])), np.sort(np.concatenate([np.flatnonzero(step == -1), edge]))
    hashes = ROLLING.between(ROLLING.prefix(codes), first, last)
    return first, last, hashes, np.searchsorted(ends, first, side="right")


def seeds(hashes: np.ndarray, mask: int) -> np.ndarray:
    """One hash for each window of twelve words, of the positions that the mask looks at."""
    n = len(hashes) - WINDOW + 1
    total = np.full(n, np.uint64(mask + 1))
    factor = 0x9E3779B97F4A7C15
    for p in MASKS[mask]:
        total += hashes[p : p + n] * np.uint64(factor)
        factor = factor * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF | 1
    return mix(total)


SEED_SCHEMA = "id long, mask int, seed long, at int, whole long, r0 long, r1 long, r2 long, n_words int"


def _seed_rows(masks: list[int], wanted: dict[int, np.ndarray] | None):
    """Rows of SEED_SCHEMA for batches (id, text); only seeds whose bit in `wanted` is set, if it is given."""
    schema = pa.schema([("id", pa.int64()), ("mask", pa.int32()), ("seed", pa.int64()), ("at", pa.int32()), *((c, pa.int64()) for c in ("whole", "r0", "r1", "r2")), ("n_words", pa.int32())])

    def run(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            codes, lengths = code_points(batch.column("text"))
            ends = np.cumsum(lengths)
            for lo, hi in blocks(lengths, CHUNK):
                part = codes[ends[lo] - lengths[lo] : ends[hi - 1]]
                if not len(part):
                    continue
                _, _, hashes, text = words(part, lengths[lo:hi])
                if len(hashes) < WINDOW:
                    continue
                n = len(hashes) - WINDOW + 1
                inside = text[:n] == text[WINDOW - 1 :]
                count = np.bincount(text, minlength=hi - lo)
                begin = np.cumsum(count) - count
                whole = None
                for mask in masks:
                    value = seeds(hashes, mask)
                    if wanted is None:
                        at = np.flatnonzero(inside)
                    else:
                        at = np.flatnonzero(inside & wanted[mask][value >> np.uint64(64 - FILTER_BITS)])
                    if not len(at):
                        continue
                    whole = ROLLING.grams(hashes, WINDOW).view(np.int64) if whole is None else whole
                    rest = [(hashes[at + a] & np.uint64(0xFFFFFFFF) | (hashes[at + b] << np.uint64(32))).view(np.int64) for a, b in zip(REST[mask][::2], REST[mask][1::2])]
                    own = text[at]
                    columns = [ids[lo:hi][own], np.full(len(at), mask, np.int32), value[at].view(np.int64), (at - begin[own]).astype(np.int32), whole[at], *rest, count[own].astype(np.int32)]
                    for a in range(0, len(at), 1 << 16):
                        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + (1 << 16)]) for c in columns], schema=schema)

    return run


def seed_bits(tests: DataFrame, masks: list[int]) -> dict[int, np.ndarray]:
    """For each mask the places of the tests' hashes in a table of 2 ** FILTER_BITS; 2 ** (FILTER_BITS - 6) rows a mask reach the driver at most."""
    place = F.shiftrightunsigned("seed", 64 - FILTER_BITS)
    packed = tests.select("mask", place.alias("p")).groupBy("mask", F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toPandas()
    out = {}
    for mask in masks:
        own = packed[packed["mask"] == mask]
        table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
        table[own["word"].to_numpy(np.int64)] = own["bits"].to_numpy(np.int64)
        out[mask] = np.unpackbits(table.view(np.uint8), bitorder="little").view(bool)
    return out


def seed_hits(docs: DataFrame, items: DataFrame, masks: list[int]) -> DataFrame:
    """(doc_id, item_id, mask, doc_at, item_at, equal, same, n_words): windows that share a seed, whether they are equal, and
    the number of equal words. A seed that very many documents hold is split by the skew join of adaptive execution."""
    tests = materialise(items.select(F.col("item_id").cast("long").alias("id"), "text").mapInArrow(_seed_rows(masks, None), SEED_SCHEMA), "tests")
    corpus = docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(_seed_rows(masks, seed_bits(tests, masks)), SEED_SCHEMA)
    tests = tests.select(F.col("id").alias("item_id"), "mask", "seed", F.col("at").alias("item_at"), "n_words", *(F.col(c).alias(f"t_{c}") for c in ("whole", "r0", "r1", "r2")))
    hits = corpus.drop("n_words").join(tests, ["mask", "seed"])
    same = F.lit(WINDOW // 2)
    for c in ("r0", "r1", "r2"):
        differ = F.col(c).bitwiseXOR(F.col(f"t_{c}"))
        same = same + (differ.bitwiseAND(F.lit(0xFFFFFFFF)) == 0).cast("int") + (F.shiftrightunsigned(differ, 32) == 0).cast("int")
    return hits.select(F.col("id").alias("doc_id"), "item_id", "mask", F.col("at").alias("doc_at"), "item_at", (F.col("whole") == F.col("t_whole")).alias("equal"), same.alias("same"), "n_words")


def leaked_pairs(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of documents and items that share twelve or more consecutive words."""
    return seed_hits(docs, items, [0]).where(F.col("equal") & (F.col("same") == WINDOW)).select("doc_id", "item_id").distinct()


def overlaps(docs: DataFrame, items: DataFrame, most_changed: int = 2) -> DataFrame:
    """(doc_id, item_id, leaked_words, item_words, leaked_share): how much of an item stands in a document, windows of
    twelve words with at most `most_changed` substituted words counting as leaked."""
    hits = seed_hits(docs, items, list(range(len(MASKS)))).where(F.col("same") >= WINDOW - most_changed)
    places = hits.select("doc_id", "item_id", "n_words", F.explode(F.sequence("item_at", F.col("item_at") + WINDOW - 1)).alias("place")).distinct()
    found = places.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).cast("int").alias("leaked_words"), F.max("n_words").alias("item_words"))
    return found.withColumn("leaked_share", F.col("leaked_words") / F.col("item_words"))
