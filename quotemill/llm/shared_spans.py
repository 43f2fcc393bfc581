"""Long exact spans shared between records, by FM-indexes over shards.

Streaming every document past every shard would cost documents x shards. Text is therefore routed
first: winnowed anchors (the least hash of the 100-character grams in every window of `span`
characters) guarantee that two texts with `span` equal characters hold the same anchor inside them.
Anchors seen in one text only are dropped; around each of the rest a segment of at most
2 * span - gram characters goes to the shard of its anchor. A shard sorts its segments' suffixes,
keeps the Burrows-Wheeler transform in a wavelet matrix of packed bits, and runs all its segments
through a backward search in step; the matching statistics above the threshold give intervals of
suffixes, whose occurrences are located and extended to their exact ends.

Defined results: null texts and texts shorter than `span` share nothing. Exact copies are one text
until the end, where membership brings back every document. Repeats inside one text are no case.
Texts are told apart by 64-bit digests (xxhash64).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotemill.llm.rolling import CHUNK, ROLLING
from quotemill.runtime import blocks, code_points, materialise

GRAM = 100
INDEX_SEGMENTS = 8192
REFINE_FROM = 64
#: Different segments of one key that meet in one place; more of them fall into blocks that all segments of the key pass.
BLOCK_FROM = 4096
SHARD_SEGMENTS = 20_000


def winnow(codes: np.ndarray, lengths: np.ndarray, span: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, gram hash) of every anchor of the texts laid end to end in codes."""
    n = len(codes)
    if n < span:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    hashes = ROLLING.grams(codes, gram)
    bits = np.uint64(max(1, int(len(hashes)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    width, want = 1, span - gram + 1
    while width * 2 <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if want > width:
        least = np.minimum(least[: -(want - width)], least[want - width :])
    ends = np.cumsum(lengths)
    starts = ends - lengths
    inside = np.zeros(n + 1, np.int8)
    whole = lengths >= span
    np.add.at(inside, starts[whole], 1)
    np.add.at(inside, ends[whole] - span + 1, -1)
    good = np.cumsum(inside[: len(least)]) > 0
    at = (least & low)[good].astype(np.int64)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
    text = np.searchsorted(ends, at, side="right")
    return text, at - starts[text], hashes[at]


def _anchor_rows(span: int):
    schema = pa.schema([("anchor", pa.int64()), ("digest", pa.int64()), ("pos", pa.int32()), ("doc_id", pa.int64())])

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            ids, texts, digests = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("text"), batch.column("digest").to_numpy(zero_copy_only=False)
            fresh = np.zeros(len(ids), bool)
            for i, d in enumerate(digests.tolist()):  # copies inside one partition send their anchors once
                if d not in seen:
                    seen.add(d)
                    fresh[i] = True
            keep = np.flatnonzero(fresh)
            ids, digests = ids[keep], digests[keep]
            codes, lengths = code_points(texts.take(pa.array(keep)))
            ends = np.cumsum(lengths)
            for lo, hi in blocks(lengths, CHUNK):
                text, pos, value = winnow(codes[ends[lo] - lengths[lo] : ends[hi - 1]], lengths[lo:hi], span)
                if len(text):
                    yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(digests[lo:hi][text]), pa.array(pos.astype(np.int32)), pa.array(ids[lo:hi][text])], schema=schema)

    return run


def _segment_rows(span: int, gram: int = GRAM):
    schema = pa.schema([("key", pa.int64()), ("digest", pa.int64()), ("start", pa.int32()), ("segment", pa.string())])
    side = span - gram

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for text, digest, marks in zip(batch.column("text").to_pylist(), batch.column("digest").to_pylist(), batch.column("marks").to_pylist()):
                for m in marks:
                    pos, n = m["pos"], m["n"]
                    start = max(0, pos - side)
                    segment = text[start : pos + gram + side]
                    keys = [m["anchor"]]
                    if n > REFINE_FROM:  # a span of `span` characters covers half of one side beside the anchor
                        half = side // 2
                        parts = [b"L" + text[pos - half : pos + gram].encode("utf-8", "surrogatepass")] * (pos >= half) + [b"R" + text[pos : pos + gram + half].encode("utf-8", "surrogatepass")] * (pos + gram + half <= len(text))
                        keys = [signed(xxhash.xxh64_intdigest(p)) for p in parts]
                    for key in keys:
                        for column, value in zip(out, (key, digest, start, segment)):
                            column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return run


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class FMIndex:
    """FM-index of many short texts: suffix array, Burrows-Wheeler transform, wavelet matrix of packed bits.

    Each text ends in its own separator, smaller than every character; a search never crosses one.
    """

    def __init__(self, codes: np.ndarray, lengths: np.ndarray) -> None:
        m = len(lengths)
        self.starts = np.cumsum(lengths + 1) - (lengths + 1)
        n = int(lengths.sum()) + m
        place = np.ones(n, bool)
        place[self.starts + lengths] = False
        self.alphabet = np.unique(codes)
        text = np.zeros(n, np.int64)
        text[place] = np.searchsorted(self.alphabet, codes) + 1
        self.n = n
        rank = text + (m - 1)
        rank[~place] = np.arange(m)
        order = suffixes(rank, int(lengths.max(initial=0)) + 1)
        bwt = text[order - 1]
        self.sa = order.astype(np.int32)  # a shard's index is far under 2 ** 31 characters
        self.text = text.astype(np.uint16 if len(self.alphabet) < 1 << 16 else np.int32)
        counts = np.bincount(text, minlength=len(self.alphabet) + 1)
        self.first = np.cumsum(counts) - counts
        self.levels = max(1, int(len(self.alphabet)).bit_length())
        self.words, self.before, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (bwt >> level) & 1 > 0
            packed = np.packbits(np.concatenate([bit, np.zeros(-len(bit) % 64 + 64, bool)]), bitorder="little").view(np.uint64)
            ones = np.zeros(len(packed) + 1, np.int32)
            np.cumsum(np.bitwise_count(packed), out=ones[1:])
            self.words.append(packed)
            self.before.append(ones)
            self.zeros.append(int(n - ones[-1]))
            bwt = np.concatenate([bwt[~bit], bwt[bit]])

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of symbol + match, for the intervals [lo, hi) of match."""
        at = np.concatenate([lo, hi])
        both = np.concatenate([symbol, symbol])
        base = np.zeros(len(symbol), np.int64)
        for depth, level in enumerate(range(self.levels - 1, -1, -1)):
            words, before, zeros = self.words[depth], self.before[depth], self.zeros[depth]
            word = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[word] + np.bitwise_count(words[word] & mask)
            up = (both >> level) & 1 > 0
            at = np.where(up, zeros + ones, at - ones)
            # where the symbol's own run begins at this depth: the image of position 0
            lift = before[base >> 6] + np.bitwise_count(words[base >> 6] & ((np.uint64(1) << (base & 63).astype(np.uint64)) - np.uint64(1)))
            base = np.where(up[: len(symbol)], zeros + lift, base - lift)
        k = len(symbol)
        start = self.first[symbol] - base
        return at[:k] + start, at[k:] + start

    def matching(self, ends: np.ndarray, limit: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics for the text positions `ends` (exclusive): the longest match ending there that
        stands at two places of the index or more, at most `limit` long; and the interval at depth `need`."""
        k = len(ends)
        length, kept_lo, kept_hi = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
        who, lo, hi = np.arange(k), np.zeros(k, np.int64), np.full(k, self.n, np.int64)
        step = 0
        while len(who):
            go = limit[who] > step
            who, lo, hi = who[go], lo[go], hi[go]
            if not len(who):
                break
            symbol = self.text[ends[who] - 1 - step].astype(np.int64)
            lo, hi = self.extend(symbol, lo, hi)
            alive = hi - lo > 1
            who, lo, hi = who[alive], lo[alive], hi[alive]
            step += 1
            length[who] = step
            if step == need:
                kept_lo[who], kept_hi[who] = lo, hi
                # the interval is all that is asked for beyond the threshold; its members are extended exactly
                break
        return length, kept_lo, kept_hi


def suffixes(rank: np.ndarray, longest: int) -> np.ndarray:
    """Suffix array by prefix doubling; ranks of separators are unique, so `longest` characters decide."""
    n = len(rank)
    bits = int(rank.max(initial=1)).bit_length()
    packed, width = rank.copy(), 1
    while (width + 1) * bits <= 62 and width < 3:
        shifted = np.zeros(n, np.int64)
        shifted[:-width] = rank[width:]
        packed = (packed << bits) | shifted
        width += 1
    order = np.argsort(packed, kind="stable")
    rank = ranked(packed, order)
    while width < longest and rank[order[-1]] < n - 1:
        second = np.zeros(n, np.int64)
        second[:-width] = rank[width:] + 1
        packed = rank * (n + 1) + second
        order = np.argsort(packed, kind="stable")
        rank = ranked(packed, order)
        width *= 2
    return order


def ranked(packed: np.ndarray, order: np.ndarray) -> np.ndarray:
    value = packed[order]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(value[1:] != value[:-1])])
    return rank


def spans_of(segments: list[str], own: np.ndarray, span: int, step: int | None = None) -> tuple[np.ndarray, ...]:
    """(query, hit, query offset, hit offset, length) of the maximal equal spans of `span` characters or
    more between different segments; hits are taken among the segments with `own` set.

    Ends are sampled every `step` characters: a span of `span` characters that ends between two samples
    still matches span - step + 1 characters up to the sample before its end.
    """
    step = step or max(1, span // 4)
    none = tuple(np.empty(0, np.int64) for _ in range(5))
    keep = np.array([len(s) >= span for s in segments], bool)
    if keep.sum() < 2:
        return none
    back = np.flatnonzero(keep)
    codes, lengths = code_points(pa.array([segments[i] for i in back], pa.large_string()))
    index = FMIndex(codes, lengths)
    need = span - step + 1
    query, end = [], []
    for e in range(need, int(lengths.max()) + 1, step):
        q = np.flatnonzero(lengths >= e)
        query.append(q)
        end.append(np.full(len(q), e))
    query, end = np.concatenate(query), np.concatenate(end)
    length, lo, hi = index.matching(index.starts[query] + end, end, need)
    hot = length >= need
    query, end, lo, hi = query[hot], end[hot], lo[hot], hi[hot]
    out: list[tuple] = []
    budget = 1 << 20
    for a, b in blocks(hi - lo, budget):
        count = (hi - lo)[a:b]
        which = np.repeat(np.arange(a, b), count)
        offset = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        spot = index.sa[lo[which] + offset].astype(np.int64)
        hit = np.searchsorted(index.starts, spot, side="right") - 1
        q, qs = query[which], end[which] - need
        hs = spot - index.starts[hit]
        fine = (hit != q) & own[back[hit]]
        q, qs, hit, hs = q[fine], qs[fine], hit[fine], hs[fine]
        left = reach(index.text, index.starts[q] + qs - 1, index.starts[hit] + hs - 1, -1, np.minimum(qs, hs))
        right = reach(index.text, index.starts[q] + qs + need, index.starts[hit] + hs + need, 1, np.minimum(lengths[q] - qs - need, lengths[hit] - hs - need))
        size = left + right + need
        good = size >= span
        out.append((back[q[good]], back[hit[good]], (qs - left)[good], (hs - left)[good], size[good]))
    if not out:
        return none
    rows = np.unique(np.stack([np.concatenate(c) for c in zip(*out)]), axis=1)
    return tuple(rows)


def reach(text: np.ndarray, a: np.ndarray, b: np.ndarray, way: int, most: np.ndarray) -> np.ndarray:
    """How many characters from a and b on, going `way`, are equal, at most `most`."""
    done = np.zeros(len(a), np.int64)
    who = np.flatnonzero(most > 0)
    while len(who):
        d = done[who]
        same = text[a[who] + way * d] == text[b[who] + way * d]
        who = who[same]
        done[who] += 1
        who = who[done[who] < most[who]]
    return done


def _shard_rows(span: int):
    schema = pa.schema([("key", pa.int64()), ("first", pa.int64()), ("second", pa.int64()), ("at_first", pa.int32()), ("at_second", pa.int32()), ("length", pa.int32())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("salt", "ascending")])
        keys, salts = table.column("key").to_numpy(), table.column("salt").to_numpy()
        parts, classes, own, members = table.column("segment").to_pylist(), table.column("class").to_numpy(), table.column("own").to_numpy(zero_copy_only=False), table.column("members").to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (salts[1:] != salts[:-1])]))
        sizes = np.diff(np.append(edges, len(keys)))
        out = []
        alone = np.array([len(p) >= span for p in parts], bool) & own & (members > 1)
        z = np.zeros(alone.sum(), np.int64)
        out.append((keys[alone], classes[alone], classes[alone], z, z, np.array([len(p) for p, a in zip(parts, alone) if a], np.int64)))
        for a, b in blocks(sizes, INDEX_SEGMENTS):
            lo, hi = edges[a], edges[b - 1] + sizes[b - 1]
            q, h, qo, ho, size = spans_of(parts[lo:hi], own[lo:hi], span)
            same = keys[lo:hi][q] == keys[lo:hi][h]
            q, h, qo, ho, size = q[same], h[same], qo[same], ho[same], size[same]
            out.append((keys[lo:hi][q], classes[lo:hi][q], classes[lo:hi][h], qo, ho, size))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)).cast(f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def texts_with_digest(docs: DataFrame, span: int) -> DataFrame:
    return docs.where(F.length("text") >= span).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("digest"))


def class_pairs(docs: DataFrame, span: int = 200) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, members, texts). Segments of one key with the same text are one class.

    pairs(key, first, second, at_first, at_second, length): maximal spans of a class in another one, or of a class with
    several members in itself; members(key, class, digest, start): where each class stands; texts(doc_id, digest).
    """
    spark = docs.sparkSession
    texts = texts_with_digest(docs, span)
    anchors = materialise(texts.mapInArrow(_anchor_rows(span), "anchor long, digest long, pos int, doc_id long"), "anchors")
    # counted first, so that an anchor of very many texts meets its count in a join that can be split
    counts = anchors.groupBy("anchor").agg(F.min("digest").alias("least"), F.max("digest").alias("most"), F.count(F.lit(1)).cast("int").alias("n")).where("least < most").select("anchor", "n")
    shared = anchors.join(counts, "anchor").groupBy("anchor", "digest", "pos").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
    marks = shared.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "pos", "n")).alias("marks"))
    segments = texts.join(marks, "doc_id").mapInArrow(_segment_rows(span), "key long, digest long, start int, segment string")
    segments = materialise(segments.withColumn("class", F.xxhash64("segment")), "segments")
    classes = segments.groupBy("key", "class").agg(F.first("segment").alias("segment"), F.count(F.lit(1)).alias("members"))
    hot = segments.select("key", "class").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK_FROM).select("key", F.ceil(F.col("n") / BLOCK_FROM).cast("int").alias("salts"))
    blocked = classes.join(hot, "key", "left").withColumn("salts", F.coalesce("salts", F.lit(1))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    blocked = blocked.withColumn("own", F.pmod(F.xxhash64("class"), F.col("salts")) == F.col("salt")).drop("salts")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), segments.count() // SHARD_SEGMENTS)
    pairs = (
        blocked.withColumn("shard", F.pmod(F.xxhash64("key", "salt"), F.lit(shards)))
        .groupBy("shard")
        .applyInArrow(_shard_rows(span), "key long, first long, second long, at_first int, at_second int, length int")
    )
    return pairs, segments.select("key", "class", "digest", "start"), texts.select("doc_id", "digest")


def text_links(docs: DataFrame, span: int = 200) -> tuple[DataFrame, DataFrame]:
    """(links, texts): maximal shared spans between different texts, and the texts with their documents.

    links(first, second, at_first, at_second, length): digests of two texts, offsets in code points.
    A span longer than a segment comes as several overlapping rows that cover it together.
    """
    pairs, members, texts = class_pairs(docs, span)
    a = members.select("key", F.col("class").alias("first"), F.col("digest").alias("da"), F.col("start").alias("sa"))
    b = members.select("key", F.col("class").alias("second"), F.col("digest").alias("db"), F.col("start").alias("sb"))
    links = (
        pairs.join(a, ["key", "first"]).join(b, ["key", "second"]).where(F.col("da") < F.col("db"))
        .select(F.col("da").alias("first"), F.col("db").alias("second"), (F.col("sa") + F.col("at_first")).alias("at_first"), (F.col("sb") + F.col("at_second")).alias("at_second"), "length")
    )
    return links, texts


def shared_pairs(docs: DataFrame, span: int = 200) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: every two documents with `span` equal consecutive characters or more."""
    links, texts = text_links(docs, span)
    linked = links.select("first", "second").distinct()
    a = texts.select(F.col("digest").alias("first"), F.col("doc_id").alias("x"))
    b = texts.select(F.col("digest").alias("second"), F.col("doc_id").alias("y"))
    between = linked.join(a, "first").join(b, "second").select("x", "y")
    copied = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    left = texts.join(copied, "digest")
    copies = left.alias("l").join(texts.alias("r"), (F.col("l.digest") == F.col("r.digest")) & (F.col("l.doc_id") < F.col("r.doc_id"))).select(F.col("l.doc_id").alias("x"), F.col("r.doc_id").alias("y"))
    return between.unionByName(copies).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))


def shared_share(docs: DataFrame, span: int = 200) -> DataFrame:
    """One row per document: (doc_id, n_chars, shared_chars, shared_share) of its text that stands in other documents too.

    Null text: null counts. A document with an exact copy is shared as a whole if it has `span` characters.
    """
    pairs, members, texts = class_pairs(docs, span)
    # a span of a class is shared for a text if any other text holds the other class: its least and greatest digest tell
    held = members.groupBy("key", "class").agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
    spans = pairs.join(held.withColumnRenamed("class", "second"), ["key", "second"]).groupBy("key", F.col("first").alias("class"), "at_first", "length").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    sides = members.join(spans, ["key", "class"]).where((F.col("low") != F.col("digest")) | (F.col("high") != F.col("digest"))).select("digest", (F.col("start") + F.col("at_first")).alias("start"), "length")
    sides = sides.withColumn("stop", F.col("start") + F.col("length")).distinct()
    order = Window.partitionBy("digest").orderBy("start", "stop")
    before = F.coalesce(F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = sides.withColumn("new", F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("start"), before))).groupBy("digest").agg(F.sum("new").alias("covered"))
    copied = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    known = texts.join(copied, "digest").join(covered, "digest", "left").select("doc_id", "n", "covered")
    full = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length("text").cast("long").alias("n_chars")).join(known, "doc_id", "left")
    shared = F.when(F.col("n_chars").isNull(), F.lit(None)).when(F.col("n") > 1, F.col("n_chars")).otherwise(F.coalesce(F.col("covered"), F.lit(0)))
    return full.select("doc_id", "n_chars", shared.cast("long").alias("shared_chars"), F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).when(F.col("n_chars") == 0, F.lit(0.0)).alias("shared_share"))
