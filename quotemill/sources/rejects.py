"""Loading of delimited rows as received: valid rows become line items, the others keep the reason.

A row has six fields (doc_id, line_no, description, quantity, unit_price, cost) separated by its
feed's delimiter. The quoting of a row is checked first, for a broken quote would swallow the rows
behind it; the rest of a batch is one CSV text a delimiter, whose structural rejects pyarrow's
invalid-row callback gives; all fields are read as strings and then checked and cast as vectors.

Reasons, the first that applies: quoting, columns, quantity, unit_price, cost.
Defined results: a null or empty row has no six fields (columns); a row without a known delimiter is
one field. One carriage return at the end is not part of the row. Spaces around a value are ignored.
Values too long for their type load as null, the row stays valid.
"""

from __future__ import annotations

import io
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ["doc_id", "line_no", "description", "quantity", "unit_price", "cost"]
PARSED = "raw_id long, reason string, failing string, doc_id long, line_no int, description string, quantity decimal(38,0), unit_price decimal(38,4), cost decimal(38,4)"
SCHEMA = pa.schema(
    [("raw_id", pa.int64()), ("reason", pa.string()), ("failing", pa.string()), ("doc_id", pa.int64()), ("line_no", pa.int32()), ("description", pa.string()), ("quantity", pa.decimal128(38, 0)), ("unit_price", pa.decimal128(38, 4)), ("cost", pa.decimal128(38, 4))]
)
#: Noncharacters and private characters that may stand for line breaks while a batch is one CSV text.
STAND_INS = [*map(chr, range(0xFDD0, 0xFDF0)), *map(chr, range(0xE000, 0xE100))]


def well_quoted(rows: pa.Array, delim: str) -> np.ndarray:
    own = re.escape(delim)
    field = rf'(?:"(?:[^"]|"")*"|[^"{own}]*)'
    return np.asarray(pc.match_substring_regex(rows, rf"(?s)\A{field}(?:{own}{field})*\z"))


def split_fields(rows: pa.Array, delim: str) -> tuple[np.ndarray, pa.Table]:
    """(which rows have six fields, their fields as strings); the quoting of all rows is right."""
    text = "".join(rows.to_pylist())
    line, ret = [c for c in STAND_INS if c not in text][:2]
    flat = pc.replace_substring(pc.replace_substring(rows, "\n", line), "\r", ret)
    wrong: list[int] = []

    def invalid(row: csv.InvalidRow) -> str:
        wrong.append(row.number)
        return "skip"

    lines = delim.join("x" * 6) + "\n" + "\n".join(flat.to_pylist()) + "\n"  # a first row that holds no byte order mark
    raw = lines.encode("utf-8", "surrogatepass")
    table = csv.read_csv(
        io.BytesIO(raw),
        csv.ReadOptions(column_names=FIELDS, use_threads=False, block_size=len(raw) + 1),
        csv.ParseOptions(delimiter=delim, ignore_empty_lines=False, invalid_row_handler=invalid),
        csv.ConvertOptions(column_types={f: pa.string() for f in FIELDS}, strings_can_be_null=False),
    ).slice(1)
    good = np.ones(len(rows), bool)
    good[np.array(wrong, int) - 2] = False  # numbered from 1, and the first is ours
    back = lambda c: pc.replace_substring(pc.replace_substring(c, line, "\n"), ret, "\r")
    return good, pa.table({f: back(table.column(f)) for f in FIELDS})


def number(values: pa.Array, pattern: str, mark: str, kind: pa.DataType, digits: int) -> tuple[np.ndarray, pa.Array]:
    """(which values are empty or match, their numbers)."""
    values = pc.utf8_trim(values, " ")
    fine = pc.match_substring_regex(values, rf"\A(?:{pattern})?\z")
    plain = pc.replace_substring(values, mark, ".") if mark else values
    fits = pc.and_(fine, pc.match_substring_regex(plain, rf"\A-?[0-9]{{1,{digits}}}(?:\.[0-9]*)?\z"))
    return np.asarray(fine), pc.if_else(fits, plain, None).cast(kind)


def parse_rows(ids: pa.Array, rows: pa.Array, delim: str | None, mark: str | None) -> pa.RecordBatch:
    """The rows of one delimiter and decimal mark as a batch of SCHEMA."""
    n = len(rows)
    rows = pc.fill_null(rows, "")
    rows = pc.replace_substring_regex(rows, r"(?s)\r\z", "")
    reason, failing = np.full(n, None, object), np.full(n, None, object)
    quoted = well_quoted(rows, delim) if delim else np.asarray(pc.match_substring_regex(rows, r'(?s)\A(?:"(?:[^"]|"")*"|[^"]*)\z'))
    reason[~quoted] = "quoting"
    filled = quoted & np.asarray(pc.greater(pc.binary_length(rows), 0)) & bool(delim)
    reason[quoted & ~filled] = "columns"
    at = np.flatnonzero(filled)
    columns: dict[str, pa.Array] = {}
    if len(at):
        good, fields = split_fields(rows.take(pa.array(at)), delim)
        reason[at[~good]] = "columns"
        at = at[good]
        own = re.escape(mark) if mark else None
        price = r"-?[0-9]+" + (rf"(?:{own}[0-9]{{1,4}})?" if own else "")
        checks = [("quantity", r"[0-9]+", "", pa.decimal128(38, 0), 38), ("unit_price", price, mark or "", pa.decimal128(38, 4), 34), ("cost", price, mark or "", pa.decimal128(38, 4), 34)]
        for name, pattern, m, kind, digits in reversed(checks):  # the first that applies is set last
            text = fields.column(name).combine_chunks()
            fine, columns[name] = number(text, pattern, m, kind, digits)
            bad = np.flatnonzero(~fine)
            reason[at[bad]] = name
            failing[at[bad]] = text.take(pa.array(bad)).to_pylist()
        for name, kind, digits in (("doc_id", pa.int64(), 18), ("line_no", pa.int32(), 9)):
            text = pc.utf8_trim(fields.column(name).combine_chunks(), " ")
            columns[name] = pc.if_else(pc.match_substring_regex(text, rf"\A[0-9]{{1,{digits}}}\z"), text, None).cast(kind)
        columns["description"] = fields.column("description").combine_chunks()
    index = np.full(n, -1)
    valid = np.array([r is None for r in reason], bool)
    index[at] = np.arange(len(at))
    index[~valid] = -1
    take = pa.array(index, mask=index < 0)
    out = [ids, pa.array(reason, pa.string()), pa.array(failing, pa.string())]
    for f in SCHEMA.names[3:]:
        out.append(columns[f].take(take) if f in columns else pa.nulls(n, SCHEMA.field(f).type))
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in out], schema=SCHEMA)


def _parse(batches):
    for batch in batches:
        table = pa.table(batch)
        keys = pc.binary_join_element_wise(pc.fill_null(table.column("delim"), ""), pc.fill_null(table.column("decimal_mark"), ""), "\x00").dictionary_encode().combine_chunks()
        for k, key in enumerate(keys.dictionary.to_pylist()):
            own = table.filter(pc.equal(keys.indices, k)).combine_chunks()
            delim, mark = key.split("\x00")
            yield parse_rows(own.column("raw_id").combine_chunks(), own.column("raw_text").combine_chunks(), delim or None, mark or None)


def load_rows(raw: DataFrame, feeds: DataFrame) -> DataFrame:
    """Every row of raw(raw_id, feed_id, raw_text) parsed by its feed: columns of PARSED, reason null for valid rows."""
    rules = feeds.select(F.col("feed_id").alias("rule_id"), "delim", "decimal_mark")
    rows = raw.select(F.col("raw_id").cast("long").alias("raw_id"), "feed_id", "raw_text").join(rules, F.col("feed_id") == F.col("rule_id"), "left")
    return rows.select("raw_id", "raw_text", "delim", "decimal_mark").mapInArrow(_parse, PARSED)


def valid_items(raw: DataFrame, feeds: DataFrame) -> DataFrame:
    return load_rows(raw, feeds).where(F.col("reason").isNull()).drop("reason", "failing")


def rejected(raw: DataFrame, feeds: DataFrame) -> DataFrame:
    """(raw_id, reason) of every row that is not valid."""
    return load_rows(raw, feeds).where(F.col("reason").isNotNull()).select("raw_id", "reason")
