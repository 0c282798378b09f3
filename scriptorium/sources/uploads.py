"""Texts of uploaded documents: zipped XML, Markdown and plain text; what cannot be read goes to a quarantine.

Files come as (path, content), of a folder by the ``binaryFile`` source as a batch or a stream.  A document of zipped XML is
parsed as it is unpacked, element by element, and never unpacks to more than ``UNPACKED`` bytes.  A file is one row; larger ones
than ``LARGEST`` are not even opened, and files of no bytes are left out by the source itself.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.session import ship_code

LARGEST, UNPACKED = 10 << 20, 100 << 20
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_BODY = "word/document.xml"


class Unreadable(ValueError):
    """A file that gives no text."""


class _Bounded(io.RawIOBase):
    """A stream that ends with an error behind a number of bytes."""

    def __init__(self, source, most: int):
        self.source, self.left = source, most

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.source.read(len(buffer))
        self.left -= len(data)
        if self.left < 0:
            raise Unreadable("unpacks to too much")
        buffer[: len(data)] = data
        return len(data)


def docx_text(content: bytes, most: int = UNPACKED) -> str:
    """The paragraphs of the body that aren't blank, an empty line between them; paragraphs inside tables are not of the body."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(_BODY) as packed:
            out: list[str] = []
            parts: list[str] = []
            path: list[str] = []
            for event, e in ET.iterparse(_Bounded(packed, most), events=("start", "end")):
                if event == "start":
                    path.append(e.tag)
                    continue
                path.pop()
                body = f"{_W}tbl" not in path and f"{_W}p" in path
                if body and e.tag == f"{_W}t":
                    parts.append(e.text or "")
                elif body and e.tag == f"{_W}tab" and path[-1] == f"{_W}r":
                    parts.append("\t")
                elif body and e.tag in (f"{_W}br", f"{_W}cr"):
                    parts.append("\n")
                elif e.tag == f"{_W}p" and path[-1:] == [f"{_W}body"]:
                    text = "".join(parts)
                    if text.strip():
                        out.append(text)
                    parts = []
                    e.clear()
            return "\n\n".join(out)
    except (zipfile.BadZipFile, zlib.error, KeyError, ET.ParseError, EOFError, OSError, NotImplementedError, RuntimeError) as e:
        raise Unreadable(f"damaged: {type(e).__name__}") from e


def docx_bytes(text: str) -> bytes:
    """A document whose paragraphs are the parts of ``text`` between empty lines."""
    from xml.sax.saxutils import escape

    line = lambda t: f'<w:r><w:t xml:space="preserve">{escape(t, {chr(13): "&#13;"})}</w:t></w:r>'
    paragraphs = "".join(f"<w:p>{'<w:r><w:br/></w:r>'.join(map(line, p.split(chr(10))))}</w:p>" for p in text.split("\n\n"))
    body = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_W[1:-1]}"><w:body>{paragraphs}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("[Content_Types].xml"), '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>')
        z.writestr(zipfile.ZipInfo(_BODY), body.encode(), zipfile.ZIP_DEFLATED)
    return out.getvalue()


def text_of(path: str, content: bytes | None) -> str:
    """The text of a file by the end of its name; raises :class:`Unreadable`."""
    name = path.lower()
    if content is None:
        raise Unreadable("no content")
    if len(content) > LARGEST:
        raise Unreadable("too large")
    if name.endswith(".docx"):
        return docx_text(content)
    if name.endswith((".md", ".txt")):
        try:
            return content.decode("utf-8")
        except UnicodeDecodeError as e:
            raise Unreadable("damaged: UnicodeDecodeError") from e
    raise Unreadable("unsupported")


def extracted(files: DataFrame) -> DataFrame:
    """All columns of ``files`` but the content, with text and error; one of the two is null.  A text that is empty is an error too."""
    ship_code(files.sparkSession)

    @F.pandas_udf("text string, error string")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for paths, contents in batches:
            made = []
            for path, content in zip(paths, contents, strict=True):
                try:
                    text = text_of(path or "", content)
                    made.append((text, None) if text.strip() else (None, "empty"))
                except Unreadable as e:
                    made.append((None, str(e)))
            yield pd.DataFrame(made, columns=["text", "error"])

    small = F.when(F.coalesce(F.octet_length("content"), F.lit(0)) <= LARGEST + 1, F.col("content")).otherwise(F.substring("content", 1, LARGEST + 1))
    return files.withColumn("_read", read("path", small)).select(*[c for c in files.columns if c != "content"], "_read.text", "_read.error")


def read_uploads(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """path, length, text, error of the files below a folder."""
    reader = (spark.readStream if stream else spark.read).format("binaryFile").option("recursiveFileLookup", "true")
    if stream:
        reader = reader.schema("path string, modificationTime timestamp, length long, content binary")
    return extracted(reader.load(folder).select("path", "length", "content"))
