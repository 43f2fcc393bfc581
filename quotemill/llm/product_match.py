"""Listings of the same product brought together.

A title encoder sums the vectors of a listing's words, and of short or numeric words with their neighbour.
A word's vector is the mean over its subwords, which are the word itself and its character trigrams (the
letters of each in order of the alphabet, so that swapped letters change few), so that a misspelt word is
near the right one. The encoder is trained by contrast: listings with the same
article code are pulled together, which takes marketing words to nought and synonyms onto each other;
listings of equal dimensions with different codes are pushed apart.

Vectors are kept in an inverted file: each goes to the nearest of the centroids, and looks into as many
cells as a check against exact neighbours asks for. Candidates within the radius pass the vetoes of
numeric variants: other dimensions, other article codes. Of them a listing's neighbours are those hardly
farther than its nearest; two listings that are each other's neighbours are of one product.

Bounds: encoder, centroids and probes are fitted on at most SAMPLE listings with a code and a quarter as
many without (those of the lowest hashes); every listing is indexed and searched. A cell and size with
more than HOT listings is searched in blocks, each pair of blocks a task of its own.

Equal descriptions, letter case apart, are one listing until the end.
Defined results: null and empty descriptions match nothing. Listings without three dimensions match each
other only, and only with the same numbers in their text.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.listing_text import take_apart
from quotemill.runtime import materialise, spread

SAMPLE = 40_000
SUBWORDS, PLACES, WIDTH = 1 << 14, 1 << 15, 48  # the places of subwords come first, then those of two words together
OFTEN = 20  # a subword, or two words together, says something of its own if it stands in so many listings of the sample
TOLERANCE = 0.05  # mm
GRID = 0.5  # mm, of the sum of dimensions
NO_SIZE = -1  # the bucket of listings without three dimensions
RADIUS = 1.1  # between pairs of one code (99.9 % under 0.11) and pairs of equal size with other codes (none under 1.49)
FARTHER = 1.0  # a neighbour may be so much farther than the nearest one
RECALL = 0.999
CELL_ROWS = 2000
TILE = 1 << 16
SHARD_ROWS = 20_000
HOT = 20_000
#: So many hot cells and sizes (16 bytes each) go to every task; more of them are joined by a shuffle.
MOST_HOT = 100_000


def place(feature: str, two: bool = False) -> int:
    return zlib.crc32(feature.encode()) % SUBWORDS + two * SUBWORDS


@lru_cache(maxsize=1 << 16)
def subwords(unit: str) -> tuple[int, ...]:
    """Places of a word's subwords, the word itself first; numbers, short words and pairs of words have themselves alone."""
    if "_" in unit:
        return (place(unit, True),)
    if len(unit) <= 3 or any(c.isdigit() for c in unit):
        return (place(unit),)
    edged = f"<{unit}>"
    return tuple(dict.fromkeys([place(unit), *(place("".join(sorted(edged[i : i + 3]))) for i in range(len(edged) - 2))]))


def units(words: list[str]) -> list[str]:
    """The words of a listing, and short or numeric ones with their neighbour. A word that stands twice counts once."""
    found = dict.fromkeys(words)
    for a, b in zip(words, words[1:]):
        if len(a) <= 2 or len(b) <= 2 or a[0].isdigit() or b[0].isdigit():
            found[f"{a}_{b}"] = None
    return list(found)


class Encoder:
    """Vectors of titles. A subword counts if the sample held it often; of a word of which few do, the word itself does,
    untrained, so that unknown words stay apart. Pairs of words that the sample held seldom count nothing."""

    def __init__(self, vectors: np.ndarray, known: np.ndarray) -> None:
        self.vectors, self.known = vectors, known
        self.word: dict[str, np.ndarray] = {}

    def counted(self, unit: str) -> list[int]:
        own = subwords(unit)
        some = [p for p in own if self.known[p]]
        return some if 5 * len(some) >= 2 * len(own) else [] if "_" in unit else [own[0]]

    def of_unit(self, unit: str) -> np.ndarray:
        if unit not in self.word:
            if len(self.word) > 1 << 18:
                self.word.clear()
            at = self.counted(unit)
            self.word[unit] = self.vectors[at].mean(0) if at else np.zeros(self.vectors.shape[1], np.float32)
        return self.word[unit]

    def encode(self, rows: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(rows), self.vectors.shape[1]), np.float32)
        for i, row in enumerate(rows):
            for unit in row:
                out[i] += self.of_unit(unit)
        return out


def train(rows: list[list[str]], codes: np.ndarray, sizes: np.ndarray, seed: int = 7, epochs: int = 12) -> Encoder:
    """The encoder, from the units, article codes and dimensions of listings."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.25, (PLACES, WIDTH)).astype(np.float32)
    seen = np.zeros(PLACES, np.int64)
    for row in rows:
        seen[list({p for u in row for p in subwords(u)})] += 1
    encoder = Encoder(vectors, seen >= OFTEN)
    if len(rows) < 2:
        return encoder
    vocabulary = {u: k for k, u in enumerate(dict.fromkeys(u for row in rows for u in row))}
    count = np.array([len(row) for row in rows])
    start, flat = np.cumsum(count) - count, np.array([vocabulary[u] for row in rows for u in row], np.int64)
    spelt = [encoder.counted(u) for u in vocabulary]
    pieces = np.array([len(s) for s in spelt])
    first, places = np.cumsum(pieces) - pieces, np.array([p for s in spelt for p in s], np.int64)
    open_place = encoder.known
    _, code = np.unique(codes, return_inverse=True)
    _, size = np.unique(np.round(sizes, 0), axis=0, return_inverse=True)
    pulled = neighbours_in_order(code, 4)
    pushed = neighbours_in_order(size.ravel(), 12)
    pushed = pushed[code[pushed[:, 0]] != code[pushed[:, 1]]]
    step = np.full((PLACES, 1), 1e-2, np.float32)
    for _ in range(epochs):
        other = rng.permutation(len(rows))[: len(pulled) // 2]
        loose = np.stack([other, rng.integers(0, len(rows), len(other))], 1)
        apart = np.concatenate([pushed, loose[code[loose[:, 0]] != code[loose[:, 1]]]])
        pairs = np.concatenate([pulled, apart])
        same = np.concatenate([np.ones(len(pulled), bool), np.zeros(len(apart), bool)])
        for batch in np.array_split(rng.permutation(len(pairs)), max(1, len(pairs) // 512)):
            at, unit, sign = [], [], []
            for side, value in ((0, 1.0), (1, -1.0)):
                r, u = flattened(flat, start, count, pairs[batch, side])
                at.append(r)
                unit.append(u)
                sign.append(np.full(len(r), value, np.float32))
            at, unit, sign = np.concatenate(at), np.concatenate(unit), np.concatenate(sign)
            used, column = np.unique(unit, return_inverse=True)
            part = np.zeros((len(batch), len(used)), np.float32)
            np.add.at(part, (at, column), sign)
            # units that stand in both listings say nothing about the pair
            row, piece = flattened(places, first, pieces, used)
            share = (1 / np.maximum(pieces[used], 1)).astype(np.float32)
            words = np.zeros((len(used), WIDTH), np.float32)
            np.add.at(words, row, vectors[piece])
            words *= share[:, None]
            gap = part @ words
            square = (gap * gap).sum(1)
            pull = np.where(same[batch], 1.0, np.where(square < 1.5, -1.0, 0.0)).astype(np.float32)
            slope = (part.T @ (gap * pull[:, None])) * share[:, None]
            own, back = np.unique(piece, return_inverse=True)
            total = np.zeros((len(own), WIDTH), np.float32)
            np.add.at(total, back, slope[row])
            total *= open_place[own, None]
            step[own] += (total * total).mean(1, keepdims=True)
            vectors[own] -= 0.2 * total / np.sqrt(step[own])
    return encoder


def flattened(flat: np.ndarray, start: np.ndarray, count: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in which, value) of all values of the rows `which`."""
    n = count[which]
    at = np.repeat(np.arange(len(which)), n)
    return at, flat[np.repeat(start[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def neighbours_in_order(group: np.ndarray, reach: int) -> np.ndarray:
    """Pairs of members of one group that stand at most `reach` places apart."""
    order = np.argsort(group, kind="stable")
    out = []
    for k in range(1, reach + 1):
        a, b = order[:-k], order[k:]
        keep = group[a] == group[b]
        out.append(np.stack([a[keep], b[keep]], 1))
    return np.concatenate(out) if out else np.empty((0, 2), np.int64)


def centroids(points: np.ndarray, cells: int, seed: int = 7, rounds: int = 6) -> np.ndarray:
    rng = np.random.default_rng(seed)
    if not len(points):
        return np.zeros((1, WIDTH), np.float32)
    middle = points[rng.choice(len(points), min(cells, len(points)), replace=False)].copy()
    for _ in range(rounds):
        nearest = cells_of(points, middle, 1)[:, 0]
        total = np.zeros_like(middle)
        np.add.at(total, nearest, points)
        n = np.bincount(nearest, minlength=len(middle))
        middle[n > 0] = total[n > 0] / n[n > 0, None]
    return middle


def cells_of(points: np.ndarray, middle: np.ndarray, probes: int) -> np.ndarray:
    """The nearest cells of each point, nearest first."""
    out = np.empty((len(points), min(probes, len(middle))), np.int32)
    norm = (middle * middle).sum(1)
    for a in range(0, len(points), 4096):
        distance = norm - 2 * points[a : a + 4096] @ middle.T
        if out.shape[1] == 1:
            out[a : a + 4096, 0] = distance.argmin(1)
        else:
            some = np.argpartition(distance, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
            order = np.take_along_axis(distance, some, 1).argsort(1, kind="stable")
            out[a : a + 4096] = np.take_along_axis(some, order, 1)
    return out


def tuned_probes(points: np.ndarray, middle: np.ndarray, radius: float = RADIUS, sizes: np.ndarray | None = None) -> int:
    """The fewest probes, up to all cells, with which at least RECALL of the exact neighbours within the radius are found;
    where sizes are given, of those that are of one size, for others are vetoed."""
    index = cells_of(points, middle, 1)[:, 0]
    asked = np.arange(0, len(points), max(1, len(points) // 2000))
    square = (points * points).sum(1)
    want = []
    for a in range(0, len(asked), 256):
        some = asked[a : a + 256]
        near = square[some, None] + square - 2 * points[some] @ points.T <= radius
        near[np.arange(len(some)), some] = False
        if sizes is not None:
            for k in range(sizes.shape[1]):
                near &= np.abs(sizes[some, k, None] - sizes[:, k]) <= TOLERANCE
        q, hit = np.nonzero(near)
        want.append(np.stack([some[q], hit], 1))
    want = np.concatenate(want) if want else np.empty((0, 2), np.int64)
    if not len(want):
        return 1
    norm, rank = (middle * middle).sum(1), np.empty(len(want), np.int64)  # cells nearer to a point than its neighbour's
    for a in range(0, len(want), 4096):
        q, home = want[a : a + 4096, 0], index[want[a : a + 4096, 1]]
        distance = norm - 2 * points[q] @ middle.T
        rank[a : a + 4096] = (distance < distance[np.arange(len(q)), home][:, None]).sum(1)
    found = np.cumsum(np.bincount(rank, minlength=len(middle))) / len(want)
    return int(np.argmax(found >= RECALL)) + 1


def parsed(texts: list[str | None]) -> list[tuple[list[float], str, list[str]]]:
    return [([], "", []) if not t else (lambda s, c, w: (s, c, units(w)))(*take_apart(t)) for t in texts]


CODE = r"\b([A-Za-z]{2}[- ]?[0-9]{6,9})[A-Za-z]?\b"


def fit(listings: DataFrame) -> tuple[Encoder, np.ndarray, int, int]:
    """(encoder, centroids, probes, listings) of a table, from its sample of at most SAMPLE listings with a code and a
    quarter as many without. Cells grow with the table; probes are tuned with and without those that hold a code."""
    total = listings.count()
    code = F.upper(F.regexp_replace(F.regexp_extract("description", CODE, 1), "[- ]", ""))
    keyed = listings.where(F.length("description") > 0).select("description", F.xxhash64(code).alias("h"), (code != "").alias("coded"))
    coded = keyed.where("coded").orderBy("h", "description").limit(SAMPLE).select("description").toPandas()["description"].tolist()
    plain = keyed.where(~F.col("coded")).orderBy(F.xxhash64("description"), "description").limit(SAMPLE // 4).select("description").toPandas()["description"].tolist()
    rows = [r for r in parsed(coded) if r[0] and r[1]]
    encoder = train([r[2] for r in rows], np.array([r[1] for r in rows]), np.array([r[0] for r in rows]))
    sample = [*rows, *(r for r in parsed(plain) if r[0])]
    points = encoder.encode([r[2] for r in sample])
    middle = centroids(points, max(1, min(total // CELL_ROWS, len(points) // 20)))
    sizes = np.array([r[0] for r in sample]).reshape(-1, 3)
    return encoder, middle, max(tuned_probes(points[a:], middle, sizes=sizes[a:]) for a in (0, len(rows))), total


ENTRY = "cell int, bucket long, home boolean, text_id long, code string, numbers string, sizes binary, vector binary"


def _index_rows(encoder: Encoder, middle: np.ndarray, probes: int):
    schema = pa.schema([("cell", pa.int32()), ("bucket", pa.int64()), ("home", pa.bool_()), ("text_id", pa.int64()), ("code", pa.string()), ("numbers", pa.string()), ("sizes", pa.binary()), ("vector", pa.binary())])

    def run(batches):
        own = Encoder(encoder.vectors, encoder.known)
        for batch in batches:
            rows = parsed(batch.column("description").to_pylist())
            if not rows:
                continue
            ids = batch.column("text_id").to_numpy()
            sizes = np.array([r[0] or [0.0] * 3 for r in rows])
            sized = np.array([bool(r[0]) for r in rows])
            points = own.encode([r[2] for r in rows])
            cells = cells_of(points, middle, probes)
            total, slack = sizes.sum(1) / GRID, 3 * TOLERANCE / GRID
            low, high = (np.where(sized, np.floor(x), NO_SIZE).astype(np.int64) for x in (total - slack, total + slack))
            n, p = cells.shape
            row, rank = np.repeat(np.arange(n), p), np.tile(np.arange(p), n)
            twice = np.flatnonzero(low[row] != high[row])
            row, rank, bucket = np.concatenate([row, row[twice]]), np.concatenate([rank, rank[twice]]), np.concatenate([low[row], high[row[twice]]])
            take = pa.array(row)
            numbers = [" ".join(sorted(u for u in r[2] if u[0].isdigit() and "_" not in u)) if not r[0] else "" for r in rows]
            texts = [pa.array(v, pa.string()).take(take) for v in ([r[1] for r in rows], numbers)]
            packed = [pa.array([v.tobytes() for v in values], pa.binary()).take(take) for values in (sizes, points)]
            yield pa.RecordBatch.from_arrays([pa.array(cells[row, rank]), pa.array(bucket), pa.array(rank == 0), pa.array(ids[row]), *texts, *packed], schema=schema)

    return run


def _shard_pairs(radius: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("distance", pa.float32())])

    def run(table: pa.Table) -> pa.Table:
        n = table.num_rows
        ids, cell, bucket, block, pair = (table.column(c).to_numpy() for c in ("text_id", "cell", "bucket", "block", "pair"))
        home = table.column("home").to_numpy(zero_copy_only=False)
        sizes = np.frombuffer(b"".join(table.column("sizes").to_pylist()), np.float64).reshape(n, 3)
        points = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float32).reshape(n, -1)
        codes, numbers = (pd.factorize(table.column(c).to_pandas()) for c in ("code", "numbers"))
        blank = (table.column("code").to_pandas() == "").to_numpy()
        codes, numbers = codes[0], numbers[0]
        # sizes fit if all three lie within the tolerance: in order of the first, then within runs of the second
        order = np.lexsort((sizes[:, 0], bucket, pair, cell))
        square = (points * points).sum(1)
        out, left, k = [], np.arange(n - 1), 1
        while len(left):  # sizes are in order: once a later entry is too long, all behind it are
            left = left[left + k < n]
            i, j = order[left], order[left + k]
            go = (cell[i] == cell[j]) & (pair[i] == pair[j]) & (bucket[i] == bucket[j]) & (sizes[j, 0] - sizes[i, 0] <= TOLERANCE)
            left, i, j = left[go], i[go], j[go]
            fits = (np.abs(sizes[i] - sizes[j]).max(1) <= TOLERANCE) & (home[i] | home[j]) & (ids[i] != ids[j]) & (numbers[i] == numbers[j])
            fits &= (codes[i] == codes[j]) | blank[i] | blank[j]  # another code is another product
            fits &= (block[i] != block[j]) | (pair[i] == block[i])  # a block by itself is searched in one place
            i, j = i[fits], j[fits]
            for a in range(0, len(i), TILE):
                q, h = i[a : a + TILE], j[a : a + TILE]
                distance = square[q] + square[h] - 2 * np.einsum("ij,ij->i", points[q], points[h])
                near = distance <= radius
                q, h = ids[q[near]], ids[h[near]]
                out.append((np.minimum(q, h), np.maximum(q, h), np.maximum(distance[near], 0).astype(np.float32)))
            k += 1
        if not out:
            return schema.empty_table()
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=schema)

    return run


def blocked(entries: DataFrame, hot: int) -> DataFrame:
    """entries with block and pair: those of a (cell, bucket) with more than `hot` of them fall into blocks, and every two
    blocks meet under a pair of their own; the others are one block, 0. Nothing is dropped."""
    many = entries.groupBy("cell", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot)
    many = materialise(many.select(F.col("cell").alias("c"), F.col("bucket").alias("b"), F.ceil(F.col("n") / hot).cast("int").alias("blocks")), "hot")
    n = many.count()
    if n == 0:
        return entries.withColumns({"block": F.lit(0), "pair": F.lit(0)})
    many = F.broadcast(many) if n <= MOST_HOT else many
    e = entries.join(many, (F.col("cell") == F.col("c")) & (F.col("bucket") == F.col("b")), "left").drop("c", "b").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    e = e.withColumn("block", F.pmod(F.xxhash64("text_id"), F.col("blocks")).cast("int"))
    # the pair of blocks x <= y is x + y * blocks, but a block with itself is x
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    e = e.withColumn("other", other)
    pair = F.when(F.col("other") == F.col("block"), F.col("block")).otherwise(F.least("block", "other") + F.greatest("block", "other") * F.col("blocks"))
    return e.withColumn("pair", pair.cast("int")).drop("blocks", "other")


def product_links(listings: DataFrame, radius: float = RADIUS) -> tuple[DataFrame, DataFrame]:
    """(links, members): links(a, b) of two different texts that are each other's neighbours, and members(text_id,
    listing_id, n) of all texts, n listings each."""
    listings = listings.select(F.col("listing_id").cast("long").alias("listing_id"), "description").where(F.length("description") > 0)
    encoder, middle, probes, total = fit(listings)
    owned = materialise(listings.select("listing_id", F.lower("description").alias("low"), "description"), "listings")
    texts = materialise(owned.groupBy("low").agg(F.min("listing_id").alias("text_id"), F.count(F.lit(1)).alias("n")), "texts")
    shards = max(int(listings.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // SHARD_ROWS)
    indexed = spread(texts.select("text_id", F.col("low").alias("description"))).mapInArrow(_index_rows(encoder, middle, probes), ENTRY)
    entries = blocked(materialise(indexed, "entries"), HOT).withColumn("shard", F.pmod(F.xxhash64("cell", "bucket", "pair"), F.lit(shards)))
    near = entries.groupBy("shard").applyInArrow(_shard_pairs(radius), "a long, b long, distance float")
    near = materialise(near.groupBy("a", "b").agg(F.min("distance").alias("distance")), "near")
    ends = near.select(F.col("a").alias("t"), "distance").unionByName(near.select(F.col("b").alias("t"), "distance"))
    reach = ends.groupBy("t").agg((F.min("distance") + FARTHER).alias("reach"))
    links = near.join(reach.withColumnRenamed("t", "a"), "a").where("distance <= reach").drop("reach").join(reach.withColumnRenamed("t", "b"), "b").where("distance <= reach").select("a", "b")
    return links, owned.join(texts, "low").select("text_id", "listing_id", "n")


def same_product(listings: DataFrame, radius: float = RADIUS) -> DataFrame:
    """(listing_id_a, listing_id_b), a < b, of every two listings of one product."""
    links, members = product_links(listings, radius)
    a, b = members.select(F.col("text_id").alias("a"), F.col("listing_id").alias("x")), members.select(F.col("text_id").alias("b"), F.col("listing_id").alias("y"))
    between = links.join(a, "a").join(b, "b").select("x", "y")
    more = members.where("n > 1")
    copies = more.select("text_id", F.col("listing_id").alias("x")).join(more.select("text_id", F.col("listing_id").alias("y")), "text_id").where("x < y").select("x", "y")
    both = between.unionByName(copies)
    return both.select(F.least("x", "y").alias("listing_id_a"), F.greatest("x", "y").alias("listing_id_b"))
