"""Extractors that need outside programs or optional libraries; without them they give no pages.

Each is a function of a file's bytes for documents.extract(). Pages are read one after the other within a file; files are
spread over tasks.
"""

from __future__ import annotations

import io
import shutil
import subprocess
import tempfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.operators import cleanup
from quotemill.sources.documents import Extractor

#: Page segmentation of the three readings of the finer scan, in the order in which equals are preferred.
MODES = (6, 4, 11)
#: Glyph numbers in a text beyond which a second pass reads the page anew.
MOST_GLYPHS = 10
KEPT = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz$.,:;()-_/\\@#%&+= "


def scan(dpi: int = 300, mode: int = 6, options: Sequence[str] = (), most_pages: int | None = None, wait: int = 600) -> Extractor:
    """Pages drawn at `dpi` and read by an outside program with page segmentation `mode`; none without the programs."""

    def run(content: bytes) -> list[str]:
        if not (shutil.which("pdftoppm") and shutil.which("tesseract")):
            return []
        with tempfile.TemporaryDirectory() as folder:
            Path(folder, "in.pdf").write_bytes(content)
            last = ["-l", str(most_pages)] if most_pages else []
            subprocess.run(["pdftoppm", "-png", "-r", str(dpi), *last, f"{folder}/in.pdf", f"{folder}/page"], check=True, capture_output=True, timeout=wait)
            read = lambda p: subprocess.run(["tesseract", str(p), "stdout", "--psm", str(mode), *options], check=True, capture_output=True, timeout=wait).stdout.decode("utf-8", "replace")
            return [read(p) for p in sorted(Path(folder).glob("page*.png"))]

    return run


#: The plain scan, the finer one in three ways, and the second pass with its own engine and characters.
PLAIN = {"scan": scan()}
FINE = {f"scan_{mode}": scan(600, mode) for mode in MODES}
SECOND = {"second_pass": scan(300, 6, ("--oem", "3", "-c", f"tessedit_char_whitelist={KEPT}")), "second_pass_all": scan(300, 6, ("--oem", "3"))}


def text_and_tables(content: bytes) -> list[str]:
    """Pages with their tables below, cells parted by tabs; tables of one row are left out."""
    try:
        import pdfplumber
    except ImportError:
        return []
    with pdfplumber.open(io.BytesIO(content)) as pdf:
        return ["\n".join([p.extract_text() or "", *("\t".join(c or "" for c in row) for table in p.extract_tables() if len(table) > 1 for row in table)]) for p in pdf.pages]


def text_and_spans(content: bytes) -> list[str]:
    """Pages with their lines put together from spans below."""
    try:
        import fitz
    except ImportError:
        return []
    pages = []
    for page in fitz.open(stream=content, filetype="pdf"):
        lines = [" ".join(s["text"] for s in line["spans"]) for block in page.get_text("dict")["blocks"] for line in block.get("lines", ())]
        pages.append("\n".join([page.get_text(), *lines]))
    return pages


def best_readings(pages: DataFrame, order: Sequence[str]) -> DataFrame:
    """PAGES with the best reading of each page: of the extractors in `order` the one with the most that looks like items."""
    lines = pages.where(F.col("extractor").isin(*order)).select(F.col("path").alias("doc_id"), "page_no", F.col("extractor").alias("method"), F.explode(F.split("text", "\n", -1)).alias("line"))
    best = cleanup.best_pages(lines, list(order)).select(F.col("doc_id").alias("path"), "page_no", F.col("method").alias("extractor"))
    return pages.join(best, ["path", "page_no", "extractor"]).select("path", "extractor", "page_no", "text")


def with_second_pass(pages: DataFrame, second: DataFrame) -> DataFrame:
    """PAGES in which a page with more than MOST_GLYPHS glyph numbers is replaced by its second reading, if there is one."""
    again = second.groupBy("path", "page_no").agg(F.min_by(F.struct("extractor", "text"), F.struct((F.length("text") == 0), "extractor")).alias("b"))
    bad = F.regexp_count("text", F.lit("cid:")) > MOST_GLYPHS
    t = pages.join(again, ["path", "page_no"], "left")
    use = bad & F.col("b").isNotNull()
    return t.select("path", F.when(use, F.col("b.extractor")).otherwise(F.col("extractor")).alias("extractor"), "page_no", F.when(use, F.col("b.text")).otherwise(F.col("text")).alias("text"))
