"""PDF files to pages of text, by whichever parser is at hand.

Files are read by Spark's binary source, one row a file, and parsed where they are read.  ``plain`` needs no library: it
reads the text operators of pages whose streams are plain or deflated, in fonts with a one-byte encoding.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalise


def _pypdf(data: bytes) -> list[str]:
    from pypdf import PdfReader

    return [p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages]


def _pdfplumber(data: bytes) -> list[str]:
    import pdfplumber

    with pdfplumber.open(io.BytesIO(data)) as pdf:
        return [p.extract_text() or "" for p in pdf.pages]


def _pymupdf(data: bytes) -> list[str]:
    import fitz

    with fitz.open(stream=data, filetype="pdf") as pdf:
        return [p.get_text() or "" for p in pdf]


OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\[|\]|[-+.\d]+|[A-Za-z'\"*]+", re.S)
ESCAPE = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(raw: bytes) -> str:
    if raw.startswith(b"<"):
        digits = re.sub(rb"\s", b"", raw[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("cp1252", "replace")
    one = lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else b"" if m[1] in b"\r\n" else ESCAPE.get(m[1], m[1])
    return re.sub(rb"\\([0-7]{1,3}|.)", one, raw[1:-1], flags=re.S).decode("cp1252", "replace")


def _shown(content: bytes) -> str:
    """The text of a content stream; a move to another line is a line feed, a wide gap a blank."""
    out, held, numbers, listed = [], [], [], False
    for m in SHOWN.finditer(content):
        t = m[0]
        if t[:1] in b"(<":
            held.append(_string(t))
        elif t == b"[" or t == b"]":
            listed = t == b"["
        elif re.fullmatch(rb"[-+.\d]+", t):
            numbers.append(float(t) if t.strip(b"+-.") else 0.0)
            if listed and numbers[-1] < -200 and held:
                held.append(" ")
        else:
            if t in (b"Tj", b"TJ"):
                out += held
            elif t in (b"'", b'"'):
                out += ["\n", *held]
            elif t in (b"T*", b"BT") or t in (b"Td", b"TD") and len(numbers) > 1 and numbers[-1] != 0:
                out.append("\n")
            held, numbers = [], []
    return "".join(out).strip("\n")


def _plain(data: bytes) -> list[str]:
    objects = {int(m[1]): m[3] for m in OBJECT.finditer(data)}

    def refs(name: bytes, body: bytes) -> list[int]:
        m = re.search(rb"/" + name + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []

    def content(body: bytes) -> bytes:
        m = STREAM.search(body)
        if not m:
            return b""
        return zlib.decompressobj().decompress(m[1]) if b"/FlateDecode" in body[: m.start()] else m[1]

    def pages(number: int, seen: frozenset = frozenset()) -> list[int]:
        body = objects.get(number, b"")
        kids = refs(b"Kids", body) if number not in seen else []
        return [p for k in kids for p in pages(k, seen | {number})] if kids else [number] if re.search(rb"/Type\s*/Page\b", body) else []

    roots = [n for n, b in objects.items() if re.search(rb"/Type\s*/Catalog\b", b)]
    tree = refs(b"Pages", objects[roots[-1]]) if roots else []
    return [_shown(b"\n".join(content(objects.get(c, b"")) for c in refs(b"Contents", objects[p]))) for t in tree for p in pages(t)]


PDF_PARSERS: dict[str, Callable[[bytes], list[str]]] = {"pypdf": _pypdf, "pdfplumber": _pdfplumber, "pymupdf": _pymupdf, "plain": _plain}


def parse_pdfs(spark: SparkSession, path: str, parser: str = "plain") -> DataFrame:
    """(path, page, text, raw_chars, parser): the pages of all PDF files under ``path``, counted from 1, normalised; a
    page without text is empty.  A parser whose library is missing fails with its name."""
    if parser not in PDF_PARSERS:
        raise ValueError(f"unknown parser {parser!r}; known: {sorted(PDF_PARSERS)}")
    extract = PDF_PARSERS[parser]

    @F.arrow_udf("array<string>")
    def pages(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for files in batches:
            yield pa.array([extract(f.as_py()) for f in files], pa.list_(pa.string()))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    rows = files.select("path", F.posexplode(pages("content")).alias("p", "raw"))
    return rows.select("path", (F.col("p") + 1).alias("page"), normalise(F.col("raw")).alias("text"), F.length("raw").alias("raw_chars"), F.lit(parser).alias("parser"))
