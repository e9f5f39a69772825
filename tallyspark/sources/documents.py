"""Uploaded documents: the gate that looks at their bytes, the stored blobs of an organization, the text layer of PDFs.

A document is one row (file, content binary, name), as `spark.read.format("binaryFile")` gives path and content.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.text import let, safe_filename
from tallyspark.operators.extract import extract_receipts

MAX_UPLOAD_BYTES = 15 * 1024 * 1024
TEXT_MIMES = ("text/plain", "text/csv", "application/json")
#: Letters that a text layer has at least, and a gap between glyphs that reads as two spaces.
LEAST_GLYPHS, WIDE_KERN = 12, -180


def read_blobs(spark: SparkSession, root: str, org: str) -> DataFrame:
    """(file, content) of the blobs under an organization's folder."""
    if not re.fullmatch(r"[A-Za-z0-9_\-]+", org):
        raise ValueError("no folder of an organization")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/{org}")
    return files.select(F.col("path").alias("file"), "content")


def own_key(key: Column, org: Column) -> Column:
    """Whether a storage key lies in the organization's folder and does not climb out of it."""
    return key.startswith(F.concat(org, F.lit("/"))) & ~F.contains(key, F.lit(".."))


def sniffed_mime(content: Column) -> Column:
    """The type that the first bytes tell: JPEG, PNG, WebP or PDF; null for others."""
    head = lambda start, n: F.hex(F.substring(content, start, n))
    return (
        F.when(head(1, 3) == "FFD8FF", "image/jpeg").when(head(1, 8) == "89504E470D0A1A0A", "image/png")
        .when((head(1, 4) == "52494646") & (head(9, 4) == "57454250"), "image/webp").when(head(1, 5) == "255044462D", "application/pdf")
    )


def gate(uploads: DataFrame, limit: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """`uploads` (file, content, name) with mime, name (cleaned), size, checksum, active (a PDF with scripts), and problem:
    empty, too large or unknown type; null for those that may be stored. A null content is empty."""
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    mime = sniffed_mime(F.col("content"))
    head = F.decode(F.substring("content", 1, 4096), "ISO-8859-1")
    problem = F.when(size == 0, "empty").when(size > limit, "too large").when(mime.isNull(), "unknown type")
    active = F.coalesce((mime == "application/pdf") & head.rlike(r"/JavaScript|/JS(?![A-Za-z0-9_])|/Launch|/OpenAction"), F.lit(False))
    return uploads.withColumns({"mime": mime, "name": safe_filename(F.coalesce("name", F.lit("receipt"))), "size": size, "checksum": F.sha2("content", 256), "active": active, "problem": problem})


# the text layer of a PDF

_TOKEN = re.compile(r"""\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]+>|\[[^\]]*\]|T[djDJ*]|'|"|BT|ET""", re.S)
_IN_ARRAY = re.compile(r"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]+>|-?\d+(?:\.\d+)?", re.S)
_ESCAPE = re.compile(r"\\(n|r|t|b|f|\(|\)|\\|[0-7]{1,3})")
_NAMED = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "(": "(", ")": ")", "\\": "\\"}


def _shown(token: str) -> str:
    """The characters of a string token: escapes and octal codes, or hexadecimal pairs without control characters."""
    if token[0] == "(":
        return _ESCAPE.sub(lambda m: _NAMED[m[1]] if m[1] in _NAMED else chr(int(m[1], 8) & 0xFFFF), token[1:-1])
    digits = re.sub("[^0-9A-Fa-f]", "", token)
    codes = [int(digits[i : i + 2], 16) for i in range(0, len(digits) - 1, 2)]
    return "".join(chr(c) for c in codes if c >= 32 or c in (10, 13))


def _lines(content: str) -> list[str]:
    out, line = [], ""
    for token in _TOKEN.findall(content) + ["ET"]:
        if token[0] in "(<":
            line += _shown(token)
        elif token[0] == "[":
            for part in _IN_ARRAY.findall(token[1:-1]):
                line += _shown(part) if part[0] in "(<" else "  " if float(part) < WIDE_KERN else ""
        elif token in ("Td", "TD", "T*", "'", '"', "ET"):
            if line.strip():
                out.append(line.rstrip())
            line = ""
    return out


def _inflated(raw: bytes) -> bytes:
    for bits in (zlib.MAX_WBITS, -zlib.MAX_WBITS, zlib.MAX_WBITS | 16):
        try:
            return zlib.decompress(raw, bits)
        except zlib.error:
            continue
    return raw


def pdf_text(content: bytes | None) -> str | None:
    """The lines of a PDF's text layer, or null where it has none worth reading."""
    found = []
    for m in re.finditer(rb"stream\r?\n?(.*?)\r?\n?endstream", content or b"", re.S):
        shown = _inflated(m[1]).decode("latin-1")
        if re.search(r"\b(?:Tj|TJ|BT)\b", shown):
            found += _lines(shown)
    text = "\n".join(found).replace("\0", "").strip()
    return text if len(re.sub(r"\s", "", text)) >= LEAST_GLYPHS else None


def pdf_text_column(content: Column) -> Column:
    """`pdf_text` of each document, in Arrow batches."""

    def run(documents: pd.Series) -> pd.Series:
        return pd.Series([pdf_text(d) for d in documents], dtype=object)

    return F.pandas_udf(run, "string")(content)


def document_text(content: Column, mime: Column, name: Column) -> Column:
    """The text of a document: a PDF's layer, or the bytes of a text file as UTF-8; null for others and blank ones."""
    pdf = F.hex(F.substring(content, 1, 5)) == "255044462D"
    plain = mime.isin(*TEXT_MIMES) | name.rlike(r"(?i)\.(?:txt|text)\z")
    read = F.when(pdf, pdf_text_column(F.when(pdf, content))).when(plain, F.try_validate_utf8(content.cast("string")))
    return let(read, lambda t: F.when(F.trim(t) != "", t))


def extract_documents(documents: DataFrame, remote: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """`documents` (file, content, mime, name) with the fields of their texts and provider: a service that `remote` calls,
    else local. Without readable text all fields are null and overall is 0.

    The service gets (document, file, content, mime, name) and gives (document, text), where it can read one; document
    is a hash of the other four, so that files of one name keep their own answers and equal ones are asked once.
    """
    local = document_text(F.col("content"), F.col("mime"), F.col("name"))
    if remote is None:
        read = documents.withColumn("text", local).withColumn("provider", F.lit("local"))
    else:
        parts = [F.coalesce(F.sha2(F.col(c).cast("binary" if c == "content" else "string").cast("binary"), 256), F.lit("-")) for c in ("file", "content", "mime", "name")]
        keyed = documents.withColumn("document", F.sha2(F.concat(*parts).cast("binary"), 256))
        asked = keyed.select("document", "file", "content", "mime", "name").dropDuplicates(["document"])
        answers = remote(asked).select("document", F.nullif(F.trim("text"), F.lit("")).alias("_said")).groupBy("document").agg(F.max("_said").alias("_said"))
        read = keyed.join(answers, "document", "left").withColumn("text", F.coalesce("_said", local)).withColumn("provider", F.when(F.col("_said").isNotNull(), "remote").otherwise("local")).drop("_said", "document")
    return extract_receipts(read)


def receipt_pdf(text: Column) -> Column:
    """A small PDF that shows the lines of a text, for demonstrations and tests."""
    escaped = F.regexp_replace(text, r"([\\()])", r"\\$1")
    shows = F.transform(F.split(escaped, "\n"), lambda line, i: F.concat(F.lit("BT /F1 11 Tf 56 "), (F.lit(780) - i * 15).cast("string"), F.lit(" Td ("), line, F.lit(") Tj ET")))
    return F.encode(F.concat(F.lit("%PDF-1.4\n4 0 obj\nstream\nq\n"), F.array_join(shows, "\n"), F.lit("\nQ\nendstream\nendobj\n%%EOF\n")), "ISO-8859-1")
