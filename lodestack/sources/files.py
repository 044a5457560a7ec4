"""Library files as rows: discovery, type checks, and pages of text by file type."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.text import MIME, extension, mime_type, safe_filename, valid_content

WORD_XML = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PAGES = "array<struct<page:int,text:string>>"


def discover(spark: SparkSession, *roots: str) -> DataFrame:
    """path, filename, mime_type, length, modified, content, valid of the supported files below the roots; a path counts once."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{pdf,docx,txt,md,PDF,DOCX,TXT,MD}").load(list(roots))
    name = safe_filename(F.col("path"))
    return files.dropDuplicates(["path"]).select("path", name.alias("filename"), mime_type(F.col("path")).alias("mime_type"), "length", F.col("modificationTime").alias("modified"), "content", valid_content(F.col("path"), F.col("content")).alias("valid"))


def text_pages(content: bytes) -> list[dict]:
    return [{"page": 1, "text": content.decode("utf-8", "replace").strip()}]


def docx_pages(content: bytes) -> list[dict]:
    """Non-empty paragraphs outside tables, then table rows with cells joined by bars, as one page."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD_XML}body")
    plain = lambda node: "".join(t.text or "" for t in node.iter(f"{WORD_XML}t")).strip()
    lines = [plain(p) for p in body.findall(f"{WORD_XML}p")]
    for row in body.iter(f"{WORD_XML}tr"):
        lines.append(" | ".join(filter(None, (plain(c) for c in row.findall(f"{WORD_XML}tc")))))
    return [{"page": 1, "text": "\n".join(filter(None, lines))}]


Extractor = Callable[[bytes], list[dict]]
EXTRACTORS: dict[str, Extractor] = {".txt": text_pages, ".md": text_pages, ".docx": docx_pages}


def extract(files: DataFrame, extractors: dict[str, Extractor] | None = None, ocr: Callable[[bytes, int], str] | None = None, min_chars: int = 20) -> DataFrame:
    """path, pages and error of files(path, content): one row for each; a type without an extractor, or a failure, gives an error and no pages.

    A PDF reader is passed in extractors. ocr(content, page) reads pages of fewer than min_chars characters again; where it fails the page stays as it is.
    """
    by_type = EXTRACTORS | (extractors or {})

    def read(path: str, content: bytes) -> tuple[list[dict] | None, str | None]:
        found = re.search(r"\.[^./\\]+$", path)
        reader = by_type.get(found[0].lower() if found else "")
        if reader is None:
            return None, "unsupported type"
        try:
            pages = reader(content)
        except Exception as e:  # one broken file is a row with an error
            return None, f"{type(e).__name__}: {e}"[:500]
        for page in pages if ocr else []:
            if len(page["text"].strip()) < min_chars:
                try:
                    page["text"] = ocr(content, page["page"]) or page["text"]
                except Exception:
                    continue
        return pages, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *read(p, c)) for p, c in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "pages", "error"])

    return files.select("path", "content").mapInPandas(run, f"path string, pages {PAGES}, error string")


def supported(name) -> object:
    return extension(name).isin(*MIME)
