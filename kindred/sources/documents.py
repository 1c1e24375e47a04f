"""Text of documents by extension: plain text, Markdown, DOCX, and PDF where a reader is installed."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.functions.hashing import by_path

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class UnsupportedFormat(ValueError):
    pass


def _blocks(node: ElementTree.Element) -> str:
    """Paragraphs with a line end after each; tables row by row, cell by cell."""
    out = []
    for child in node:
        if child.tag == _W + "p":
            out.append("".join(t.text or "" for t in child.iter(_W + "t")) + "\n")
        elif child.tag == _W + "tbl":
            out += [_blocks(cell) for row in child.iter(_W + "tr") for cell in row.iter(_W + "tc")]
    return "".join(out)


def docx_text(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(_W + "body")
    return _blocks(body) if body is not None else ""


def pdf_text(content: bytes) -> str:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise UnsupportedFormat("pdf") from e
    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)


def extract(name: str, content: bytes) -> str:
    kind = name.rpartition(".")[2].lower()
    if kind in ("txt", "md"):
        return content.decode("utf-8")
    if kind == "docx":
        return docx_text(content)
    if kind == "pdf":
        return pdf_text(content)
    raise UnsupportedFormat(kind)


def read(path):
    """A column of paths as struct of their documents' text and an error; a file that holds no text
    that can be had has neither."""
    def of(path, f):
        try:
            return extract(path, f.read())
        except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError):
            return None

    return by_path(of)(path)


@F.pandas_udf(T.StringType())
def extracted(names: pd.Series, contents: pd.Series) -> pd.Series:
    """The text, or null where there is none to be had."""
    def one(name, content):
        try:
            return extract(name, bytes(content)) if content is not None else None
        except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError):
            return None

    return pd.Series([one(n, c) for n, c in zip(names, contents)], dtype=object)
