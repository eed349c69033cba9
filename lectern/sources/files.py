"""Office and web archive files as rows, read by Spark's binary source and cut by the standard library."""

from __future__ import annotations

import email
import email.policy
import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _read(spark: SparkSession, path: str, rows, schema: pa.Schema, ddl: str) -> DataFrame:
    """rows(content) of each file below path, with the file's path before them; a file is one piece of work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                found = [(name, *r) for r in rows(content.as_py())]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), schema.types, strict=True)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, ddl)


def docx_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """(path, no, style, text, in_table): the paragraphs of word-processor files in order, empty ones counted but left out. A file that is damaged, or of another kind, has no row."""

    def rows(content: bytes) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                root = ElementTree.fromstring(z.read("word/document.xml"))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return
        cells = {p for c in root.iter(f"{WORD}tc") for p in c.iter(f"{WORD}p")}
        for no, p in enumerate(root.iter(f"{WORD}p")):
            text = "".join("\t" if e.tag == f"{WORD}tab" else "\n" if e.tag == f"{WORD}br" else e.text or "" for e in p.iter() if e.tag in (f"{WORD}t", f"{WORD}tab", f"{WORD}br"))
            style = p.find(f"{WORD}pPr/{WORD}pStyle")
            if text.strip():
                yield no, None if style is None else style.get(f"{WORD}val"), text, p in cells

    schema = pa.schema([("path", pa.string()), ("no", pa.int64()), ("style", pa.string()), ("text", pa.string()), ("in_table", pa.bool_())])
    return _read(spark, path, rows, schema, "path string, no long, style string, text string, in_table boolean")


def mhtml_parts(spark: SparkSession, path: str) -> DataFrame:
    """(path, no, type, location, text, content): the parts of web archives in order; text is decoded by the part's own charset, or UTF-8, and null for parts that aren't text."""

    def rows(content: bytes) -> Iterator[tuple]:
        message = email.message_from_bytes(content, policy=email.policy.compat32)
        parts = [p for p in message.walk() if not p.is_multipart()]
        for no, p in enumerate(parts):
            data = p.get_payload(decode=True) or b""
            text = None
            if p.get_content_maintype() == "text":
                try:
                    text = data.decode(p.get_content_charset() or "utf-8", "replace")
                except LookupError:
                    text = data.decode("utf-8", "replace")
            yield no, p.get_content_type(), p.get("Content-Location"), text, data

    schema = pa.schema([("path", pa.string()), ("no", pa.int64()), ("type", pa.string()), ("location", pa.string()), ("text", pa.string()), ("content", pa.binary())])
    return _read(spark, path, rows, schema, "path string, no long, type string, location string, text string, content binary")
