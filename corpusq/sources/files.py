"""File sources: discovery, DOCX, and readers that need tools which may be absent."""

from __future__ import annotations

import io
import re
import shutil
import subprocess
import tempfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename
from ..runtime import ship

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def discover(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """path, name, length of the folder's files by name; contents aren't read."""
    got = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length")
    return got.withColumn("name", basename(F.col("path"))).orderBy("name")


def docx_text(data: bytes) -> str:
    """Non-empty paragraphs, then each table's rows with ' | ' between non-empty cells."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    if body is None:
        return ""
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    blocks = [p for e in body if e.tag == f"{_W}p" and (p := text(e))]
    for t in body.iter(f"{_W}tbl"):
        for row in t.iter(f"{_W}tr"):
            cells = [c for x in row.findall(f"{_W}tc") if (c := text(x))]
            if cells:
                blocks.append(" | ".join(cells))
    return "\n".join(blocks)


def djvu_text(data: bytes) -> str | None:
    """By the djvutxt tool; None where it's absent or fails."""
    if not shutil.which("djvutxt"):
        return None
    with tempfile.NamedTemporaryFile(suffix=".djvu") as f:
        f.write(data)
        f.flush()
        got = subprocess.run(["djvutxt", f.name], capture_output=True, timeout=300)
    return got.stdout.decode("utf8", "replace") if got.returncode == 0 else None


def pdf_pages(data: bytes) -> list[str] | None:
    """Page texts by whichever PDF library is installed; None without one."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return None
    return [(p.extract_text() or "").strip() for p in PdfReader(io.BytesIO(data)).pages]


def image_name(stem: str, page: int) -> str:
    return f"{stem}_p{page:04d}.jpg"


def _read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        rows = []
        for path, data in zip(pdf["path"], pdf["content"]):
            kind = re.sub(r".*\.", "", path).lower()
            error, texts = None, []
            try:
                if kind == "docx":
                    texts = [(None, docx_text(data))]
                elif kind == "djvu":
                    t = djvu_text(data)
                    texts, error = ([(None, t)], None) if t is not None else ([], "no djvu reader")
                elif kind == "pdf":
                    p = pdf_pages(data)
                    texts, error = (list(enumerate(p, 1)), None) if p is not None else ([], "no pdf reader")
                else:
                    error = f"unsupported: {kind}"
            except Exception as e:  # a broken file is a row with an error, not a failed job
                error = f"{type(e).__name__}: {e}"[:1000]
            rows += [(path, n, t, None) for n, t in texts] or [(path, None, None, error)]
        yield pd.DataFrame(rows, columns=["path", "page", "text", "error"]).astype({"page": "Int32"})


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """path, page (null for texts without pages), text, error. .doc and unknown kinds give an error row."""
    ship(spark)
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,docx,doc,djvu}").load(folder)
    return raw.select("path", "content").mapInPandas(_read, "path string, page int, text string, error string")
