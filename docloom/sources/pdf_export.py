"""Texts as PDF files, one for each row: pages of lines in a font whose codes a ToUnicode map tells."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

LINES = 50


def file_of(objects: dict[int, bytes], root: int = 1, more: bytes = b"") -> bytes:
    """A file of numbered objects with a table of cross-references."""
    out, at = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), {}
    for n, body in sorted(objects.items()):
        at[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    place, size = len(out), max(objects) + 1
    out += b"xref\n0 %d\n0000000000 65535 f \n" % size
    for n in range(1, size):
        out += b"%010d 00000 n \n" % at[n] if n in at else b"0000000000 65535 f \n"
    return bytes(out + b"trailer\n<< /Size %d /Root %d 0 R %s >>\nstartxref\n%d\n%%%%EOF\n" % (size, root, more, place))


def stream(data: bytes, entries: bytes = b"", pack: bool = True) -> bytes:
    data = zlib.compress(data) if pack else data
    return b"<< /Length %d %s %s >>\nstream\n%s\nendstream" % (len(data), b"/Filter /FlateDecode" if pack else b"", entries, data)


def unicode_map(codes: dict[int, str]) -> bytes:
    """The ToUnicode map of two-byte codes."""
    rows = [b"<%04X> <%s>" % (c, t.encode("utf-16-be", "replace").hex().upper().encode()) for c, t in codes.items()]
    blocks = [b"%d beginbfchar\n%s\nendbfchar" % (len(part), b"\n".join(part)) for part in (rows[i : i + 100] for i in range(0, len(rows), 100))]
    return b"/CIDInit /ProcSet findresource begin begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange\n" + b"\n".join(blocks) + b"\nendcmap end"


def text_pdf(text: str, lines: int = LINES) -> bytes:
    """``text`` line by line, ``lines`` on a page; a file has one page at least. Characters that a text has are the codes of its font; a text has at most 65,000 different ones."""
    rows = text.split("\n")
    code = {c: i for i, c in enumerate(sorted(set(text) - {"\n"}), 1)}
    pages = [rows[i : i + lines] for i in range(0, len(rows), lines)]
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>"}
    kids = [6 + 2 * i for i in range(len(pages))]
    objects[2] = b"<< /Type /Pages /Count %d /Kids [%s] /Resources << /Font << /F1 3 0 R >> >> >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    objects[3] = b"<< /Type /Font /Subtype /Type0 /BaseFont /Own /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 5 0 R >>"
    objects[4] = b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Own /DW 600 >>"
    objects[5] = stream(unicode_map({i: c for c, i in code.items()}))
    for k, page in zip(kids, pages, strict=True):
        shown = b" T*\n".join(b"<%s> Tj" % b"".join(b"%04X" % code[c] for c in row) if row else b"" for row in page)
        objects[k] = b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Contents %d 0 R >>" % (k + 1)
        objects[k + 1] = stream(b"BT /F1 10 Tf 14 TL 40 800 Td\n" + shown + b" ET")
    return file_of(objects)


@F.pandas_udf(BinaryType())
def pdf_of(text: pd.Series) -> pd.Series:
    """Each text as a PDF file; null for a null."""
    return text.map(lambda t: None if t is None else text_pdf(t))
