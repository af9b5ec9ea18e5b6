"""Text of PDF files: objects, cross-references, filters, fonts and text operators, read within a task one file at a time."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

#: Bytes that a stream may unpack to, and forms within forms.
MOST_BYTES, MOST_DEPTH = 1 << 28, 12
SPACE, DELIMITERS = b"\0\t\n\f\r ", b"()<>[]{}/%"
_TOKEN = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]+")
_SKIP = re.compile(rb"(?:[\0\t\n\f\r ]+|%[^\r\n]*)*")
_REF = re.compile(rb"(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+R(?![A-Za-z0-9])")
_OBJ = re.compile(rb"(?<!\d)(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+obj\b")

# Names of glyphs that no rule gives.
GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+",
    "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\",
    "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~", "quoteleft": "\u2018", "quoteright": "\u2019", "quotedblleft": "\u201c",
    "quotedblright": "\u201d", "quotesinglbase": "\u201a", "quotedblbase": "\u201e", "guillemotleft": "\u00ab", "guillemotright": "\u00bb", "guilsinglleft": "\u2039", "guilsinglright": "\u203a", "endash": "\u2013", "emdash": "\u2014",
    "bullet": "\u2022", "ellipsis": "\u2026", "dagger": "\u2020", "daggerdbl": "\u2021", "section": "\u00a7", "paragraph": "\u00b6", "copyright": "\u00a9", "registered": "\u00ae", "trademark": "\u2122", "degree": "\u00b0", "Euro": "\u20ac",
    "sterling": "\u00a3", "yen": "\u00a5", "cent": "\u00a2", "germandbls": "\u00df", "ae": "\u00e6", "AE": "\u00c6", "oe": "\u0153", "OE": "\u0152", "oslash": "\u00f8", "Oslash": "\u00d8", "dotlessi": "\u0131", "lslash": "\u0142", "Lslash": "\u0141",
    "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl", "exclamdown": "\u00a1", "questiondown": "\u00bf", "ordfeminine": "\u00aa", "ordmasculine": "\u00ba", "multiply": "\u00d7", "divide": "\u00f7", "minus": "\u2212", "nbspace": " ",
}
DIGITS = {name: str(n) for n, name in enumerate("zero one two three four five six seven eight nine".split())}
ACCENTS = {"acute": "\u0301", "grave": "\u0300", "circumflex": "\u0302", "dieresis": "\u0308", "tilde": "\u0303", "ring": "\u030a", "cedilla": "\u0327", "caron": "\u030c", "macron": "\u0304", "breve": "\u0306", "ogonek": "\u0328", "dotaccent": "\u0307"}


class Name(str):
    """A PDF name, apart from a string."""


class Ref(tuple):
    """(number, generation) of an object."""


class Stream(dict):
    """A dictionary with ``raw`` data."""

    raw = b""


class BadPdf(ValueError):
    pass


def parse(data: bytes, at: int = 0) -> tuple[Any, int]:
    """(object or bare word as bytes, place behind it); None and the end where nothing is left."""
    at = _SKIP.match(data, at).end()
    c = data[at : at + 1]
    if not c:
        return None, len(data)
    if c == b"/":
        m = _TOKEN.match(data, at + 1)
        raw = m[0] if m else b""
        return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), raw).decode("latin-1")), at + 1 + len(raw)
    if c == b"(":
        return _string(data, at + 1)
    if data[at : at + 2] == b"<<":
        found, at = _listed(data, at + 2, b">>")
        return {k: v for k, v in zip(found[::2], found[1::2]) if isinstance(k, Name)}, at
    if c == b"<":
        end = data.find(b">", at)
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end if end >= 0 else len(data)])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), (end if end >= 0 else len(data)) + 1
    if c == b"[":
        return _listed(data, at + 1, b"]")
    if c in b")>]{}":
        width = 2 if data[at : at + 2] == b">>" else 1
        return data[at : at + width], at + width
    if c.isdigit() and (m := _REF.match(data, at)):
        return Ref((int(m[1]), int(m[2]))), m.end()
    word = _TOKEN.match(data, at)[0]
    at += len(word)
    if re.fullmatch(rb"[+-]?\d+", word):
        return int(word), at
    if re.fullmatch(rb"[+-]*\d*\.?\d*(?:-\d*)?", word) and re.search(rb"\d", word):
        return float(re.match(rb"[+-]?\d*\.?\d*", word.lstrip(b"+-") if word[:2] == b"--" else word)[0] or 0), at
    return {b"true": True, b"false": False}.get(word, word), at


def _listed(data: bytes, at: int, end: bytes) -> tuple[list, int]:
    out: list = []
    while at < len(data):
        x, at = parse(data, at)
        bare = x if isinstance(x, bytes) and data[at - len(x) : at] == x else None  # a word, not a string of the same bytes
        if bare == end:
            return out, at
        if bare in (b"endobj", b"stream"):
            return out, at - len(bare)
        if x is None:
            break
        out.append(None if bare == b"null" else x)
    return out, at


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at]
        if c == 92:
            m = re.compile(rb"\\([0-7]{1,3}|\r\n|[\s\S])").match(data, at)
            if not m:
                break
            x = m[1]
            if x[:1].isdigit() and x[0] < 56:
                out.append(int(x, 8) & 255)
            elif x not in (b"\n", b"\r", b"\r\n"):
                out += {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}.get(x, x)
            at = m.end()
            continue
        depth += (c == 40) - (c == 41)
        at += 1
        if not depth:
            break
        out.append(c)
    return bytes(out), at


def _ascii85(x: bytes) -> bytes:
    x = re.sub(rb"\s", b"", x.split(b"~>")[0].removeprefix(b"<~"))
    out, group = bytearray(), []
    for c in x:
        if c == 122 and not group:
            out += bytes(4)
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += (sum(d * 85 ** (4 - i) for i, d in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
    if len(group) > 1:
        n = len(group)
        group += [84] * (5 - n)
        out += (sum(d * 85 ** (4 - i) for i, d in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")[: n - 1]
    return bytes(out)


def _flate(x: bytes) -> bytes:
    d = zlib.decompressobj()
    try:
        out = d.decompress(x, MOST_BYTES)
    except zlib.error:  # what can be read of a damaged stream, without its checks
        d, out = zlib.decompressobj(-15), b""
        try:
            for i in range(2, len(x), 256):
                out += d.decompress(x[i : i + 256], MOST_BYTES - len(out))
        except zlib.error:
            pass
    if d.unconsumed_tail:
        raise BadPdf("a stream unpacks to too much")
    return out


def _lzw(x: bytes, early: int = 1) -> bytes:
    table: list[bytes] = []
    out, bits, have, width, last = bytearray(), 0, 0, 9, b""
    for c in x:
        bits, have = (bits << 8 | c) & 0xFFFFFFFF, have + 8
        if have < width:
            continue
        have -= width
        code = bits >> have & (1 << width) - 1
        if code == 257 or len(out) > MOST_BYTES:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        table = table or [bytes([i]) for i in range(256)] + [b"", b""]
        entry = table[code] if code < len(table) else last + last[:1]
        if last:
            table.append(last + entry[:1])
        out += entry
        last = entry
        size = len(table) + early
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    return bytes(out)


def _runs(x: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(x) and x[at] != 128:
        n = x[at]
        out += x[at + 1 : at + 2 + n] if n < 128 else x[at + 1 : at + 2] * (257 - n)
        at += n + 2 if n < 128 else 2
    return bytes(out)


def _predicted(x: bytes, parms: dict) -> bytes:
    """Undoes the row filters of PNG, or of TIFF at 8 bits."""
    kind, size = parms.get("Predictor", 1), max(1, parms.get("Colors", 1) * parms.get("BitsPerComponent", 8) // 8)
    width = (parms.get("Colors", 1) * parms.get("BitsPerComponent", 8) * parms.get("Columns", 1) + 7) // 8
    if kind < 2:
        return x
    out, above = bytearray(), bytearray(width)
    step = width + (kind >= 10)
    for i in range(0, len(x), step):
        row = bytearray(x[i + (kind >= 10) : i + step])
        how = x[i] if kind >= 10 else 1
        for j in range(len(row)):
            a, b, c = (row[j - size] if j >= size else 0), above[j], (above[j - size] if j >= size else 0)
            if how == 4:
                p = a + b - c
                best = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            row[j] = row[j] + (0, a, b, (a + b) // 2, best if how == 4 else 0)[min(how, 4)] & 255
        out += row
        above = row + bytes(width - len(row))
    return bytes(out)


class Pdf:
    """The objects of a file, by its cross-references, or by all that looks like an object where these are broken."""

    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise BadPdf("not a PDF file")
        self.data, self.cache, self.packed = data, {}, {}
        self.at: dict[int, int | tuple[int, int]] = {}
        self.trailer: dict = {}
        try:
            self._follow(int(re.findall(rb"startxref\s+(\d+)", data[-2048:])[-1]))
            if not isinstance(self.get(self.get(self.trailer["Root"])["Pages"]), dict):
                raise BadPdf("no pages")
        except (BadPdf, LookupError, ValueError, TypeError, zlib.error, RecursionError):
            self._search()
        if "Encrypt" in self.trailer:
            raise BadPdf("encrypted")

    def _follow(self, place: int) -> None:
        seen: set[int] = set()
        while isinstance(place, int) and place not in seen:
            seen.add(place)
            m = _SKIP.match(self.data, place)
            if self.data[m.end() : m.end() + 4] == b"xref":
                at = m.end() + 4
                while head := re.compile(rb"\s*(\d+)\s+(\d+)\s*").match(self.data, at):
                    at = head.end()
                    for number in range(int(head[1]), int(head[1]) + int(head[2])):
                        row = re.compile(rb"\s*(\d{1,10})\s+(\d{1,5})\s+([nf])").match(self.data, at)
                        if not row:
                            raise BadPdf("cross-references")
                        at = row.end()
                        if row[3] == b"n" and int(row[1]):
                            self.at.setdefault(number, int(row[1]))
                word, at = parse(self.data, at)
                if word != b"trailer":
                    raise BadPdf("no trailer")
                trailer = parse(self.data, at)[0]
                if isinstance(trailer.get("XRefStm"), int):
                    self._table(trailer["XRefStm"])
            else:
                trailer = self._table(place)
            self.trailer = trailer | self.trailer
            place = trailer.get("Prev")

    def _table(self, place: int) -> dict:
        found = self._object(place)[1]
        if not isinstance(found, Stream) or found.get("Type") != "XRef":
            raise BadPdf("no cross-reference stream")
        rows, w = self.unpacked(found), found["W"]
        index = found.get("Index") or [0, found["Size"]]
        at = 0
        for first, n in zip(index[::2], index[1::2]):
            for number in range(first, first + n):
                kind, a, b = (int.from_bytes(rows[at + sum(w[:i]) : at + sum(w[: i + 1])], "big") if w[i] else int(i == 0) for i in range(3))
                at += sum(w)
                if kind:
                    self.at.setdefault(number, a if kind == 1 else (a, b))
        return dict(found)

    def _search(self) -> None:
        """Every object of the file by looking for it; of the same number the last."""
        self.at, self.cache, self.packed, old = {}, {}, {}, self.trailer
        for m in _OBJ.finditer(self.data):
            self.at[int(m[1])] = m.start()
        for number in list(self.at):
            x = self.get(Ref((number, 0)))
            if isinstance(x, Stream) and x.get("Type") == "ObjStm":
                for i, (inner, _) in enumerate(self._pack(number)):
                    self.at.setdefault(inner, (number, i))
        for m in re.finditer(rb"trailer", self.data):
            found = parse(self.data, m.end())[0]
            old = old | (found if isinstance(found, dict) else {})
        for number in self.at:
            x = self.get(Ref((number, 0)))
            if isinstance(x, dict) and x.get("Type") == "Catalog":
                old = old | {"Root": Ref((number, 0))}
            if isinstance(x, Stream) and x.get("Type") == "XRef":
                old = {k: v for k, v in x.items() if k in ("Info", "Encrypt", "Root")} | old
        self.trailer = old
        if not isinstance(self.get(self.trailer.get("Root")), dict):
            raise BadPdf("no catalogue")

    def _object(self, place: int) -> tuple[int, Any]:
        m = _OBJ.match(self.data, _SKIP.match(self.data, place).end())
        if not m:
            raise BadPdf(f"no object at {place}")
        x, at = parse(self.data, m.end())
        if not isinstance(x, dict):
            return int(m[1]), None if x == b"null" else x
        word = _SKIP.match(self.data, at).end()
        if self.data[word : word + 6] != b"stream":
            return int(m[1]), x
        begin = word + 6 + (2 if self.data[word + 6 : word + 8] == b"\r\n" else self.data[word + 6 : word + 7] in (b"\n", b"\r"))
        size = self.get(x.get("Length"))
        out = Stream(x)
        if not isinstance(size, int) or not re.compile(rb"\s*endstream").match(self.data, begin + size):
            end = self.data.find(b"endstream", begin)
            out.raw = self.data[begin : end if end >= 0 else len(self.data)]
        else:
            out.raw = self.data[begin : begin + size]
        return int(m[1]), out

    def _pack(self, number: int) -> list[tuple[int, Any]]:
        """The objects (number, object) of an object stream."""
        if number not in self.packed:
            s = self.get(Ref((number, 0)))
            data, first = self.unpacked(s), s["First"]
            heads, at = [], 0
            for _ in range(2 * s["N"]):
                x, at = parse(data, at)
                heads.append(x)
            self.packed[number] = [(n, parse(data, first + o)[0]) for n, o in zip(heads[::2], heads[1::2])]
        return self.packed[number]

    def get(self, x: Any) -> Any:
        """``x``, or the object that it refers to; None where there is none."""
        for _ in range(32):
            if not isinstance(x, Ref):
                return x
            if x[0] not in self.cache:
                place = self.at.get(x[0])
                self.cache[x[0]] = None
                try:
                    if isinstance(place, tuple):
                        self.cache[x[0]] = next((o for n, o in self._pack(place[0]) if n == x[0]), None)
                    elif place is not None:
                        number, self.cache[x[0]] = self._object(place)
                        if number != x[0]:
                            raise BadPdf("cross-references point elsewhere")
                except KeyError as e:
                    raise BadPdf(f"object {x[0]}: {e}") from e
            x = self.cache[x[0]]
        raise BadPdf("references in a circle")

    def unpacked(self, s: Stream) -> bytes:
        """The data of a stream through its filters."""
        listed = lambda x: x if isinstance(x, list) else [] if x is None else [x]
        names, parms = listed(self.get(s.get("Filter"))), listed(self.get(s.get("DecodeParms")))
        data = s.raw
        for i, name in enumerate(names):
            p = {k: self.get(v) for k, v in (self.get(parms[i]) or {}).items()} if i < len(parms) else {}
            match self.get(name):
                case "FlateDecode" | "Fl":
                    data = _predicted(_flate(data), p)
                case "LZWDecode" | "LZW":
                    data = _predicted(_lzw(data, p.get("EarlyChange", 1)), p)
                case "ASCII85Decode" | "A85":
                    data = _ascii85(data)
                case "ASCIIHexDecode" | "AHx":
                    digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
                    data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
                case "RunLengthDecode" | "RL":
                    data = _runs(data)
                case other:
                    raise BadPdf(f"unknown filter: {other}")
        return data

    def pages(self) -> Iterator[dict]:
        """The pages in their order, with the resources that they inherit."""
        todo, seen = [(self.get(self.trailer["Root"]).get("Pages"), None)], set()
        while todo:
            ref, inherited = todo.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or (isinstance(ref, Ref) and ref in seen):
                continue
            seen.add(ref if isinstance(ref, Ref) else None)
            resources = node.get("Resources", inherited)
            if "Kids" in node:
                todo += [(k, resources) for k in reversed(self.get(node["Kids"]) or [])]
            else:
                yield node | {"Resources": resources}


def glyph(name: str) -> str:
    """The text of a glyph by its name; empty where no rule knows it."""
    base = name.split(".")[0]
    if len(base) == 1 or base in GLYPHS or base in DIGITS:
        return GLYPHS.get(base) or DIGITS.get(base) or base
    if m := re.fullmatch(r"uni((?:[0-9A-Fa-f]{4})+)", base):
        return bytes.fromhex(m[1]).decode("utf-16-be", "replace")
    if m := re.fullmatch(r"u([0-9A-Fa-f]{4,6})", base):
        return chr(int(m[1], 16)) if int(m[1], 16) < 0x110000 else ""
    accent = next((a for a in ACCENTS if base.endswith(a) and len(base) == len(a) + 1), None)
    return unicodedata.normalize("NFC", base[0] + ACCENTS[accent]) if accent else ""


class Font:
    """Codes of a font as text and widths."""

    def __init__(self, pdf: Pdf, d: dict):
        self.wide = d.get("Subtype") == "Type0"
        self.text: dict[int, str] = {}
        self.sizes: list[int] = [2] if self.wide else [1]
        self.width: dict[int, float] = {}
        self.default = 500.0
        if self.wide:
            below = pdf.get((pdf.get(d.get("DescendantFonts")) or [{}])[0]) or {}
            self.default = pdf.get(below.get("DW", 1000)) or 1000
            w = [pdf.get(x) for x in pdf.get(below.get("W")) or []]
            while len(w) > 1:
                if isinstance(w[1], list):
                    self.width |= {w[0] + i: pdf.get(x) for i, x in enumerate(w[1])}
                    w = w[2:]
                else:
                    self.width |= dict.fromkeys(range(w[0], min(w[1], 65535) + 1), w[2]) if len(w) > 2 else {}
                    w = w[3:]
        else:
            first = pdf.get(d.get("FirstChar")) or 0
            self.width = {first + i: pdf.get(x) for i, x in enumerate(pdf.get(d.get("Widths")) or [])}
            encoding = pdf.get(d.get("Encoding"))
            base = pdf.get(encoding.get("BaseEncoding")) if isinstance(encoding, dict) else encoding
            codec = {"WinAnsiEncoding": "cp1252", "MacRomanEncoding": "mac_roman"}.get(base, "latin-1")
            self.text = {i: bytes([i]).decode(codec, "ignore") for i in range(32, 256)}
            if base is None or base == "StandardEncoding":
                self.text |= {39: "\u2019", 96: "\u2018"} if base else {}
            at = 0
            for x in (pdf.get(encoding.get("Differences")) or []) if isinstance(encoding, dict) else []:
                x = pdf.get(x)
                if isinstance(x, int):
                    at = x
                else:
                    self.text[at] = glyph(x)
                    at += 1
        known = pdf.get(d.get("ToUnicode"))
        if isinstance(known, Stream):
            self._map(pdf.unpacked(known))

    def _map(self, data: bytes) -> None:
        to = lambda x: x.decode("utf-16-be", "replace") if len(x) > 1 else x.decode("latin-1")
        spaces = [x for part in re.findall(rb"begincodespacerange(.*?)endcodespacerange", data, re.S) for x in re.findall(rb"<([0-9A-Fa-f\s]*)>", part)]
        self.sizes = sorted({(len(re.sub(rb"\s", b"", x)) + 1) // 2 for x in spaces} - {0}) or self.sizes
        for kind, part in re.findall(rb"beginbf(char|range)(.*?)endbf", data, re.S):
            found = _listed(part + b" ", 0, b"\xff")[0]
            if kind == b"char":
                self.text |= {int.from_bytes(a, "big"): to(b) for a, b in zip(found[::2], found[1::2]) if isinstance(a, bytes) and isinstance(b, bytes)}
                continue
            for a, b, c in zip(found[::3], found[1::3], found[2::3]):
                low, high = int.from_bytes(a, "big"), min(int.from_bytes(b, "big"), int.from_bytes(a, "big") + 65535)
                if isinstance(c, list):
                    self.text |= {low + i: to(x) for i, x in enumerate(c[: high - low + 1])}
                else:
                    head, last = c[:-2], int.from_bytes(c[-2:], "big")
                    self.text |= {low + i: to(head + (last + i & 0xFFFF).to_bytes(max(1, len(c[-2:])), "big")) for i in range(high - low + 1)}

    def read(self, s: bytes) -> list[tuple[int, str]]:
        """(code, text) one after the other; a code without text stands for none."""
        out, at = [], 0
        while at < len(s):
            size = next((n for n in self.sizes if int.from_bytes(s[at : at + n], "big") in self.text), self.sizes[-1])
            code = int.from_bytes(s[at : at + size], "big")
            out.append((code, self.text.get(code, "")))
            at += size
        return out


def _times(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


ONE = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


class Page:
    """What a page shows as text: a new line where the baseline moves, a blank where a gap is wide enough for one."""

    def __init__(self, pdf: Pdf):
        self.pdf, self.out, self.last, self.fonts, self.images = pdf, [], None, {}, False

    def show(self, data: bytes, resources: dict, matrix: tuple = ONE, depth: int = 0) -> None:
        get = self.pdf.get
        fonts, forms = (get((get(resources) or {}).get(k)) or {} for k in ("Font", "XObject"))
        self.images = self.images or any(isinstance(x := get(v), dict) and x.get("Subtype") == "Image" for v in forms.values())
        font, size, lead, char, word, scale, rise = None, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0
        ctm, saved, tm, line, args, at = matrix, [], ONE, ONE, [], 0

        def put(s: bytes) -> None:
            nonlocal tm
            for code, text in font.read(s) if font else []:
                place = _times((size * scale, 0, 0, size, 0, rise), _times(tm, ctm))
                high = max(abs(place[3]), abs(place[1]), 1e-6)
                if text:
                    if self.last:
                        x, y, before = self.last
                        if abs(place[5] - y) > 0.5 * min(high, before):
                            self.out.append("\n")
                        elif place[4] - x > 0.2 * high and self.out and not self.out[-1].endswith((" ", "\n")) and not text.startswith(" "):
                            self.out.append(" ")
                    self.out.append(text)
                step = ((font.width.get(code) or font.default) / 1000 * size + char + (word if s and code == 32 and not font.wide else 0)) * scale
                tm = _times((1, 0, 0, 1, step, 0), tm)
                if text:
                    end = _times(tm, ctm)
                    self.last = (end[4], end[5], high)

        def move(x: float, y: float) -> None:
            nonlocal tm, line
            line = tm = _times((1, 0, 0, 1, x, y), line)

        while at < len(data):
            x, at = parse(data, at)
            if not isinstance(x, bytes) or data[at - 1 : at] in (b")", b">") or isinstance(x, (Name, bool)):
                args.append(x)
                continue
            try:
                match x:
                    case b"q":
                        saved.append((ctm, font, size, lead, char, word, scale, rise))
                    case b"Q" if saved:
                        ctm, font, size, lead, char, word, scale, rise = saved.pop()
                    case b"cm":
                        ctm = _times(tuple(args[-6:]), ctm)
                    case b"BT":
                        tm = line = ONE
                    case b"Tf":
                        key = args[-2]
                        ref = fonts.get(key)
                        known = ref if isinstance(ref, Ref) else (id(fonts), key)
                        if known not in self.fonts:
                            self.fonts[known] = Font(self.pdf, d) if isinstance(d := get(ref), dict) else None
                        font, size = self.fonts[known], args[-1]
                    case b"Tc":
                        char = args[-1]
                    case b"Tw":
                        word = args[-1]
                    case b"Tz":
                        scale = args[-1] / 100
                    case b"TL":
                        lead = args[-1]
                    case b"Ts":
                        rise = args[-1]
                    case b"Td":
                        move(args[-2], args[-1])
                    case b"TD":
                        lead = -args[-1]
                        move(args[-2], args[-1])
                    case b"Tm":
                        tm = line = tuple(args[-6:])
                    case b"T*":
                        move(0, -lead)
                    case b"Tj":
                        put(args[-1])
                    case b"'":
                        move(0, -lead)
                        put(args[-1])
                    case b'"':
                        word, char = args[-3], args[-2]
                        move(0, -lead)
                        put(args[-1])
                    case b"TJ":
                        for part in args[-1]:
                            if isinstance(part, bytes):
                                put(part)
                            else:
                                tm = _times((1, 0, 0, 1, -part / 1000 * size * scale, 0), tm)
                    case b"Do" if depth < MOST_DEPTH:
                        form = get(forms.get(args[-1]))
                        if isinstance(form, Stream) and form.get("Subtype") == "Form":
                            own = tuple(get(form.get("Matrix")) or ONE)
                            self.show(self.pdf.unpacked(form), form.get("Resources", resources), _times(own, ctm), depth + 1)
                    case b"BI":  # an image within the page
                        self.images = True
                        end = re.compile(rb"[\s]EI(?=[\s]|$)").search(data, at)
                        at = end.end() if end else len(data)
            except (IndexError, TypeError, ValueError, AttributeError):
                pass  # an operator with other operands than it takes does nothing
            args = []


def _plain(x: Any) -> str | None:
    if not isinstance(x, bytes):
        return None
    for mark, codec in ((b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le"), (b"\xef\xbb\xbf", "utf-8")):
        if x.startswith(mark):
            return x[len(mark) :].decode(codec, "replace").strip("\0 ") or None
    return x.decode("cp1252", "replace").strip("\0 ") or None


def read(data: bytes) -> dict[str, Any]:
    """text (pages joined by line ends), pages, title, author, creation_date, has_images of a file; BadPdf where it cannot be read."""
    try:
        pdf = Pdf(data)
        texts, images = [], False
        for node in pdf.pages():
            page = Page(pdf)
            parts = pdf.get(node.get("Contents"))
            streams = [pdf.get(p) for p in parts] if isinstance(parts, list) else [parts]
            page.show(b"\n".join(pdf.unpacked(s) for s in streams if isinstance(s, Stream)), node["Resources"])
            texts.append("".join(page.out))
            images = images or page.images
        info = pdf.get(pdf.trailer.get("Info"))
        info = info if isinstance(info, dict) else {}
        return {"text": "\n".join(texts), "pages": len(texts), "title": _plain(pdf.get(info.get("Title"))), "author": _plain(pdf.get(info.get("Author"))), "creation_date": _plain(pdf.get(info.get("CreationDate"))), "has_images": images}
    except (LookupError, TypeError, ValueError, AttributeError, zlib.error, RecursionError) as e:
        raise BadPdf(str(e) or type(e).__name__) from e


_READ = StructType([StructField("text", StringType()), StructField("pages", IntegerType()), StructField("title", StringType()), StructField("author", StringType()), StructField("creation_date", StringType()), StructField("has_images", BooleanType()), StructField("error", StringType())])


@F.pandas_udf(_READ)
def contents(content: pd.Series) -> pd.DataFrame:
    """struct<text, pages, title, author, creation_date, has_images, error> of PDF files; a bad file has an error and fails nothing else, a null has nothing."""
    out = []
    for raw in content:
        try:
            out.append((read(bytes(raw)) if raw is not None else {}) | {"error": None})
        except BadPdf as e:
            out.append({"error": f"BadPdf: {e}"})
    return pd.DataFrame([[x.get(f.name) for f in _READ] for x in out], columns=[f.name for f in _READ], dtype=object)
