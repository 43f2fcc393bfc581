"""Encoding of a whole corpus by a public byte-level BPE tokenizer, without special tokens.

Texts are split by the tokenizer's own pattern, stated here as rules over runs of character classes
so that a batch of texts is split in one go; equal pieces are encoded once. A text longer than
PART_CHARS is cut into parts that different tasks encode, and a piece that the pattern does not split
is encoded in halves. Both are put together by tree concatenation, neighbours first, in tasks of their
own level by level: windows around each join are encoded again and grow until both sides agree. Pieces
are looked up by a hash and compared with the ones that were learnt.

Defined ids: null and empty texts have no ids (an empty list). Strings that look like special tokens
are ordinary text. Characters that this Python's Unicode tables do not know are left to the
tokenizer library, text by text.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.rolling import CHUNK, ROLLING
from quotemill.runtime import blocks, code_points

PART_CHARS = 1 << 13
FAN_IN = 16  # parts that one task joins
LONG_PIECE = 256
CACHED_PIECES = 1 << 20
SLOTS = 1 << 20
OTHER, LETTER, NUMBER, SPACE, UNKNOWN = range(5)
#: The pattern that splits text for this vocabulary, and Unicode's white space.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WHITE = (0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


#: A part of a text: its characters, where its pieces begin, the number of ids of each, and the ids.
Part = tuple[str, np.ndarray, np.ndarray, np.ndarray]


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"/opt/tokenizers/{name}"


def classes() -> np.ndarray:
    table = np.full(0x110000, UNKNOWN, np.uint8)
    kind = {"L": LETTER, "N": NUMBER}
    for code in (*range(0x323B0), *range(0xE0000, 0xE0200)):
        category = unicodedata.category(chr(code))
        if category not in ("Cn", "Cs"):
            table[code] = kind.get(category[0], OTHER)
    table[list(WHITE)] = SPACE
    return table


class Encoder:
    """Ids of texts; keeps what it has learnt about pieces while a worker lives."""

    def __init__(self, ranks_file: bytes, pattern: str = PATTERN) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        self.own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.word = {v: k for k, v in ranks.items()}
        self.table = classes()
        self.forget()

    def forget(self) -> None:
        self.index: dict[int, int] = {}
        self.slot_key, self.slot_at = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.offset, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.pool, self.used = np.zeros(4096, np.int32), 0
        self.text, self.text_used, self.text_at, self.text_size = np.zeros(4096, np.uint32), 0, np.zeros(1024, np.int64), np.zeros(1024, np.int64)

    # pieces

    def starts(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Where the pieces of the texts laid end to end in codes begin."""
        n = len(codes)
        kind = self.table[codes]
        ends = np.cumsum(lengths)
        begin = np.zeros(n + 1, bool)
        begin[(ends - lengths)[lengths > 0]] = True
        begin[n] = True
        edge = begin.copy()
        edge[1:n] |= kind[1:] != kind[:-1]
        runs = np.flatnonzero(edge)
        first, last = runs[:-1], runs[1:]
        white = kind[first] == SPACE
        piece = edge.copy()
        inner = white & ~begin[last]  # white space with something behind it: its last character stands apart
        piece[last[inner] - 1] = True
        tail = last[inner]
        piece[tail[codes[tail - 1] == 0x20]] = False
        mark = first[(codes[first] == 0x27) & (last - first == 1) & piece[first] & ~begin[last]]
        if len(mark):
            stop = ends[np.searchsorted(ends, mark, side="right")]
            one = codes[mark + 1]
            two = np.where(mark + 2 < stop, codes[np.minimum(mark + 2, n - 1)], 0)
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            for size, which in ((2, short), (3, long)):
                at = mark[which]
                piece[at + 1] = False
                rest = at + size
                piece[rest[rest < stop[which]]] = True
        piece[n] = True
        return np.flatnonzero(piece)

    def piece_ids(self, raw: bytes) -> np.ndarray:
        """Ids of one piece; a long one by halves."""
        if len(raw) <= LONG_PIECE:
            return np.array(self.own._encode_single_piece(raw), np.int32)
        half = len(raw) // 2
        return self.concatenate(self.piece_ids(raw[:half]), self.piece_ids(raw[half:]))

    def concatenate(self, left: Sequence[int], right: Sequence[int]) -> Sequence[int]:
        """Ids of the bytes of left and right as one piece. A window around the join is encoded again; once it
        begins with left's id and ends with right's id at its rims, every two neighbouring ids are as in an
        encoding of their own, which makes the whole the encoding."""
        k = 4
        while True:
            a, b = min(k, len(left)), min(k, len(right))
            raw = b"".join(self.word[int(t)] for t in (*left[len(left) - a :], *right[:b]))
            window = self.own._encode_single_piece(raw)
            if (a == len(left) or window[0] == left[-a]) and (b == len(right) or window[-1] == right[b - 1]):
                return np.concatenate([left[: len(left) - a], window, right[b:]]).astype(np.int32)
            k *= 2

    # texts

    def encode(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text)."""
        ids, counts, _ = self.encode_pieces(codes, lengths)
        return ids, counts

    def encode_pieces(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        if not len(codes):
            return np.empty(0, np.int32), np.zeros(len(lengths), np.int64), (np.empty(0, np.int64), np.empty(0, np.int64))
        cut = self.starts(codes, lengths)
        first, last = cut[:-1], cut[1:]
        keys = ROLLING.between(ROLLING.prefix(codes), first, last)
        slot = (keys >> np.uint64(44)).astype(np.int64)
        at = self.slot_at[slot]
        missing = np.flatnonzero(self.slot_key[slot] != keys)
        if len(missing):
            new, where, back = np.unique(keys[missing], return_index=True, return_inverse=True)
            found = np.fromiter((self.index.get(k, -1) for k in new.tolist()), np.int64, len(new))
            for j in np.flatnonzero(found < 0).tolist():
                p = missing[where[j]]
                raw = codes[first[p] : last[p]].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
                found[j] = self.learn(int(new[j]), self.piece_ids(raw), codes[first[p] : last[p]])
            at[missing] = found[back]
            self.slot_key[(new >> np.uint64(44)).astype(np.int64)] = new
            self.slot_at[(new >> np.uint64(44)).astype(np.int64)] = found
        if not self.same_pieces(codes, first, last, at):  # two pieces with one hash: none is looked up
            own = [self.piece_ids(codes[a:b].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")) for a, b in zip(first, last)]
            count, ids = np.array([len(x) for x in own], np.int64), np.concatenate(own).astype(np.int32)
            done = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(first, np.cumsum(lengths), side="left")]
            return ids, np.diff(np.concatenate([[0], done])), (first, count)
        count = self.count[at].astype(np.int64)
        total = np.cumsum(count)
        ids = self.pool[np.repeat(self.offset[at] - (total - count), count) + np.arange(total[-1])]
        ends = np.cumsum(lengths)
        done = np.concatenate([[0], total])[np.searchsorted(first, ends, side="left")]
        counts = np.diff(np.concatenate([[0], done]))
        if len(self.index) > CACHED_PIECES:
            self.forget()
        return ids, counts, (first, count)

    def same_pieces(self, codes: np.ndarray, first: np.ndarray, last: np.ndarray, at: np.ndarray) -> bool:
        """Whether the pieces, which make up all of codes, are the very ones that were learnt."""
        size = last - first
        if (self.text_size[at] != size).any():
            return False
        return bool((self.text[np.repeat(self.text_at[at] - first, size) + np.arange(len(codes))] == codes).all())

    def learn(self, key: int, ids: Sequence[int], codes: np.ndarray) -> int:
        at = len(self.index)
        self.index[key] = at
        if at >= len(self.offset):
            self.offset, self.count, self.text_at, self.text_size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.offset, self.count, self.text_at, self.text_size))
        while self.text_used + len(codes) > len(self.text):
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        self.text_at[at], self.text_size[at] = self.text_used, len(codes)
        self.text[self.text_used : self.text_used + len(codes)] = codes
        self.text_used += len(codes)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.offset[at], self.count[at] = self.used, len(ids)
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return at

    def encode_column(self, column: pa.Array) -> pa.ListArray:
        codes, lengths = code_points(column)
        ends = np.cumsum(lengths)
        ids, counts = [], []
        for lo, hi in blocks(lengths, CHUNK):
            part = codes[ends[lo] - lengths[lo] : ends[hi - 1]]
            if (self.table[part] == UNKNOWN).any():
                for text in column.slice(lo, hi - lo).to_pylist():
                    own = self.own.encode_ordinary(text or "")
                    ids.append(np.array(own, np.int32))
                    counts.append([len(own)])
                continue
            i, c = self.encode(part, lengths[lo:hi])
            ids.append(i)
            counts.append(c)
        offsets = np.zeros(len(lengths) + 1, np.int32)
        if counts:
            np.cumsum(np.concatenate(counts), out=offsets[1:])
        values = np.concatenate(ids) if ids else np.empty(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))

    # parts of one long text: (text, piece starts, ids per piece, ids)

    def part(self, text: str) -> Part:
        """A part scanned as if the text began and ended with it."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        ids, _, (first, count) = self.encode_pieces(codes, np.array([len(codes)]))
        return text, first.astype(np.int32), count.astype(np.int32), ids

    def join_parts(self, parts: list[Part]) -> Part:
        """The part that neighbouring parts, in order, make together: pairs of them, then pairs of pairs."""
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def join(self, a: Part, b: Part) -> Part:
        """A piece start inside a part holds for the whole text; the last piece of a part may go on in the next. So the
        pieces are found again from there, over more and more of the next part, until a start of the window is also a
        start of that part: from there on both agree."""
        text, starts, counts, ids = a
        text_b, starts_b, counts_b, ids_b = b
        if not text or not text_b:
            return b if not text else a
        last = -2 if len(starts) > 1 and text[starts[-1] - 1] == "'" else -1  # 'r may go on as 're
        open_ = int(starts[last])
        tail, kept = text[open_:], int(counts[last:].sum())
        held = ids[len(ids) - kept :]
        look, meet = 64 if len(starts_b) > 1 else len(text_b), None
        while True:
            _, first, count, window = self.window(tail, text_b[:look], held, starts_b, counts_b, ids_b)
            spot = first[:-1] - len(tail)
            inside = np.flatnonzero(spot > 0)
            found = inside[np.isin(spot[inside], starts_b, assume_unique=True)]
            if len(found):
                meet = int(found[0])
                break
            if look >= len(text_b):  # the next part belongs to the window as a whole: its last piece stays open
                break
            look *= 4
        head = [starts[: len(starts) + last], counts[: len(counts) + last], ids[: len(ids) - kept]]
        if meet is None:
            new = [first + open_, count, window]
        else:
            k = int(np.searchsorted(starts_b, spot[meet]))
            new = [
                np.concatenate([first[:meet] + open_, starts_b[k:] + len(text)]), np.concatenate([count[:meet], counts_b[k:]]), np.concatenate([window[: int(count[:meet].sum())], ids_b[int(counts_b[:k].sum()) :]])
            ]
        return (text + text_b, *(np.concatenate([x, y]).astype(np.int32) for x, y in zip(head, new)))

    def window(self, tail: str, head: str, held: np.ndarray, starts_b: np.ndarray, counts_b: np.ndarray, ids_b: np.ndarray) -> Part:
        """Pieces of tail + head; a first piece that is the tail and the next part's first piece joins their ids."""
        text = tail + head
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        cut = self.starts(codes, np.array([len(codes)]))
        stop = len(tail) + (int(starts_b[1]) if len(starts_b) > 1 else len(head))
        if int(cut[1]) == stop and stop > LONG_PIECE and (len(starts_b) == 1 or len(cut) > 2):
            joined = np.array(self.concatenate(held, ids_b[: int(counts_b[0])]), np.int32)
            if stop == len(text):
                return text, np.zeros(1, np.int32), np.array([len(joined)], np.int32), joined
            _, first, count, ids = self.part(text[stop:])
            return text, np.concatenate([[0], first + stop]), np.concatenate([[len(joined)], count]), np.concatenate([joined, ids])
        return self.part(text)


_ENCODERS: dict[int, Encoder] = {}


def encoder(ranks_file: bytes) -> Encoder:
    key = hash(ranks_file)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(ranks_file)
    return _ENCODERS[key]


def _whole(ranks_file: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks_file)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), own.encode_column(batch.column("text"))], names=["doc_id", "ids"])

    return run


PART_SCHEMA = "doc_id long, part int, piece string, starts array<int>, counts array<int>, ids array<int>"


def _part_table(rows: list[tuple[int, int, Part]]) -> pa.RecordBatch:
    lists = [pa.array([r[2][k] for r in rows], pa.list_(pa.int32())) for k in (1, 2, 3)]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2][0] for r in rows], pa.string()), *lists], names=["doc_id", "part", "piece", "starts", "counts", "ids"])


def _parts(ranks_file: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks_file)
        for batch in batches:
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), batch.column("piece").to_pylist())
            yield _part_table([(d, p, own.part(t)) for d, p, t in rows])

    return run


def _join(ranks_file: bytes):
    def run(table: pa.Table) -> pa.Table:
        own = encoder(ranks_file)
        table = table.sort_by("part")
        lists = [[x.values.to_numpy() for x in table.column(c)] for c in ("starts", "counts", "ids")]
        joined = own.join_parts(list(zip(table.column("piece").to_pylist(), *lists)))
        return pa.Table.from_batches([_part_table([(table.column("doc_id")[0].as_py(), table.column("part")[0].as_py() // FAN_IN, joined)])])

    return run


def encode_documents(docs: DataFrame, ranks_path: str | None = None, part_chars: int = PART_CHARS) -> DataFrame:
    """(doc_id, ids) for every row of docs(doc_id, text); other columns are ignored. doc_id is unique. The parts of a long
    text are joined level by level, FAN_IN neighbours a task."""
    ranks_file = open(ranks_path or vocabulary_path(), "rb").read()  # under 1 MB whatever the corpus is
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    long = F.coalesce(F.length("text"), F.lit(0)) > part_chars
    whole = docs.where(~long).mapInArrow(_whole(ranks_file), "doc_id long, ids array<int>")
    longest = docs.agg(F.max(F.length("text")).alias("n")).first()["n"] or 0
    size = F.length("text")
    cuts = F.sequence(F.lit(0), ((size - 1) / part_chars).cast("int"))
    parts = (
        docs.where(long).select("doc_id", F.posexplode(F.transform(cuts, lambda k: F.substring("text", k * part_chars + 1, F.lit(part_chars)))).alias("part", "piece"))
        .repartition("doc_id", "part")
        .mapInArrow(_parts(ranks_file), PART_SCHEMA)
    )
    n = -(-longest // part_chars)
    while n > 1:
        parts = parts.groupBy("doc_id", F.floor(F.col("part") / FAN_IN).alias("level")).applyInArrow(_join(ranks_file), PART_SCHEMA)
        n = -(-n // FAN_IN)
    return whole.unionByName(parts.select("doc_id", "ids"))
