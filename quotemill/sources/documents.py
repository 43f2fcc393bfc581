"""Documents from files: binary PDFs through a chain of extractors, plain text, and templates of known issuers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes of a file -> its pages' texts; an extractor that cannot read a file returns no pages.
Extractor = Callable[[bytes], list[str]]
WORD = r"[\p{L}\p{N}]+"
PAGES = "path string, extractor string, page_no int, text string"


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of the readable PDFs of a folder, in any letter case of the suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.lower("path").endswith(".pdf") & (F.col("length") > 0) & (F.substring(F.col("content").cast("binary"), 1, 5) == F.lit("%PDF-").cast("binary")))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one document a file."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def pypdf_pages(content: bytes) -> list[str]:
    """Pages by an optional library; without it there are none."""
    try:
        import io

        from pypdf import PdfReader
    except ImportError:
        return []
    return [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]


def utf8_pages(content: bytes) -> list[str]:
    """The content as text, parted by form feeds, if it is UTF-8 text at all."""
    try:
        return content.decode("utf-8").split("\f")
    except UnicodeDecodeError:
        return []


def extract(files: DataFrame, extractors: dict[str, Extractor]) -> DataFrame:
    """PAGES of files(path, content) by every extractor; an extractor that fails on a file gives no rows for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                for name, extractor in extractors.items():
                    try:
                        pages = extractor(content or b"")
                    except Exception:  # noqa: BLE001 - a broken file must not end the job
                        pages = []
                    rows += [(path, name, n, text) for n, text in enumerate(pages, 1)]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.string()))], names=["path", "extractor", "page_no", "text"])

    return files.select("path", "content").mapInArrow(run, PAGES)


def first_long_enough(pages: DataFrame, order: list[str], least: int = 100) -> DataFrame:
    """(path, extractor, text): of each file the first extractor, in order, with `least` characters; else the longest text."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("extractor"))
    text = pages.groupBy("path", "extractor").agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("p")).select("path", "extractor", place.alias("place"), F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    key = F.struct((F.length("text") >= least).alias("enough"), F.when(F.length("text") >= least, -F.col("place")).otherwise(F.length("text")).alias("n"))
    return text.groupBy("path").agg(F.max_by(F.struct("extractor", "text"), key).alias("b")).select("path", "b.extractor", "b.text")


def by_template(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc_id, issuer, field, value) for templates(issuer, keyword, field, pattern): the first group of each pattern in the
    documents that hold the issuer's keyword. Documents and templates meet by the keyword's first word."""
    first = F.try_element_at(F.regexp_extract_all(F.lower("keyword"), F.lit(WORD), 0), F.lit(1))
    keyed = templates.select(first.alias("w"), "issuer", "keyword", "field", "pattern").where("w is not null")
    words = docs.where(F.col("text").isNotNull()).select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), 0))).alias("w"))
    held = words.join(keyed.select("w").distinct(), "w", "left_semi")
    hits = held.join(docs, "doc_id").join(keyed, "w").where(F.contains(F.lower("text"), F.lower("keyword")))
    value = F.expr("regexp_extract(text, pattern, 1)")
    return hits.select("doc_id", "issuer", "field", F.nullif(value, F.lit("")).alias("value")).where("value is not null").distinct()
