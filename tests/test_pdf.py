"""PDF files of several kinds, and broken ones."""

import base64
import random
import zlib

import pytest
from pyspark.sql import functions as F

from docloom.sources import files, pdf, pdf_export
from docloom.sources.pdf_export import file_of, stream

FONT = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"


def simple(content, font=FONT, resources=b"/Font << /F1 4 0 R >>", pack=True, more=None, trailer=b""):
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: b"<< /Type /Page /Parent 2 0 R /Resources << %s >> /Contents 5 0 R >>" % resources, 4: font, 5: content if content.startswith(b"<<") else stream(content, pack=pack)}
    return file_of(objects | (more or {}), more=trailer)


def text(data):
    return pdf.read(data)["text"]


def test_lines_gaps_and_strings():
    shown = rb"BT /F1 12 Tf 14 TL 50 700 Td (One \(two\) \164hree\\) Tj T* [(Wo) 20 (rd) -600 (gap)] TJ (next) ' 0 -14 Td <4142> Tj ET BT /F1 12 Tf 300 658 Td (right) Tj ET"
    assert text(simple(shown)) == "One (two) three\\\nWord gap\nnext\nAB right"
    assert text(simple(b"BT /F1 12 Tf 50 700 Td (caf\xe9 \x93q\x94) Tj ET")) == "café “q”"
    assert text(simple(b"BT /F1 9 Tf 2 0 0 2 50 700 Tm (big) Tj 1 0 0 1 50 690 Tm (low) Tj ET")) == "big\nlow"


def test_differences_and_glyph_names():
    font = b"<< /Type /Font /Subtype /Type1 /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [1 /A /eacute /uni20AC /u1F600 200 /fi /quoteright /Ccedilla /three] >> >>"
    assert text(simple(b"BT /F1 12 Tf 0 0 Td <01020304C8C9CACB> Tj ET", font)) == "Aé€\U0001f600fi’Ç3"


def test_to_unicode_ranges_and_code_lengths():
    cmap = b"1 begincodespacerange <00> <7F> <8000> <FFFF> endcodespacerange 2 beginbfrange <01> <03> <0061> <8001> <8002> [<00660066> <D83DDE00>] endbfrange 1 beginbfchar <10> <0020> endbfchar"
    font = b"<< /Type /Font /Subtype /Type0 /Encoding /X /ToUnicode 6 0 R /DescendantFonts [<< /DW 600 /W [1 [500 500] 3 4 700] >>] >>"
    assert text(simple(b"BT /F1 12 Tf 0 0 Td <01020310 8001 8002> Tj ET", font, more={6: stream(cmap)})) == "abc ff\U0001f600"


@pytest.mark.parametrize("kind", ["flate", "a85", "hex", "chain", "runs", "lzw"])
def test_filters(kind):
    raw = b"BT /F1 12 Tf 0 0 Td (filtered) Tj ET"
    if kind == "lzw":  # nine-bit codes, none from the table
        bits = "".join(f"{c:09b}" for c in [256, *raw, 257])
        data, names = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big"), b"/LZWDecode"
    else:
        data, names = {
            "flate": (zlib.compress(raw), b"/FlateDecode"),
            "a85": (base64.a85encode(raw) + b"~>", b"/ASCII85Decode"),
            "hex": (raw.hex().encode() + b">", b"/ASCIIHexDecode"),
            "chain": (base64.a85encode(zlib.compress(raw)) + b"~>", b"[/ASCII85Decode /FlateDecode]"),
            "runs": (bytes([len(raw) - 1]) + raw + bytes([128]), b"/RunLengthDecode"),
        }[kind]
    assert text(simple(b"<< /Length %d /Filter %s >>\nstream\n%s\nendstream" % (len(data), names, data))) == "filtered"


def with_object_streams(break_it=False):
    """Catalogue, pages, page and font within an object stream; cross-references as a stream with PNG predictors."""
    inner = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: b"<< /Type /Page /Resources << /Font << /F1 4 0 R >> >> /Contents 5 0 R >>", 4: FONT, 8: b"<< /Title (\xfe\xff\x00T\x00\xe9) /Author (Jane) /CreationDate (D:20240102) >>"}
    heads, body = [], b""
    for n, x in inner.items():
        heads.append(b"%d %d" % (n, len(body)))
        body += x + b" "
    head = b" ".join(heads) + b" "
    out, at = bytearray(b"%PDF-1.5\n"), {}
    for n, x in {5: stream(b"BT /F1 12 Tf 0 0 Td (packed) Tj ET"), 6: stream(head + body, b"/Type /ObjStm /N %d /First %d" % (len(inner), len(head)))}.items():
        at[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, x)
    place = len(out)
    rows = []
    for n in range(9):
        kind = (2, 6, list(inner).index(n)) if n in inner else (1, at.get(n, place), 0) if n else (0, 0, 0)
        rows.append(bytes([kind[0]]) + kind[1].to_bytes(3, "big") + bytes([kind[2]]))
    packed, above = b"", bytes(5)
    for r in rows:
        packed += b"\x02" + bytes((a - b) & 255 for a, b in zip(r, above, strict=True))
        above = r
    out += b"7 0 obj\n" + stream(packed, b"/Type /XRef /W [1 3 1] /Size 9 /Root 1 0 R /Info 8 0 R /DecodeParms << /Predictor 12 /Columns 5 >>") + b"\nendobj\nstartxref\n%d\n%%%%EOF" % (7 if break_it else place)
    return bytes(out)


@pytest.mark.parametrize("broken", [False, True])
def test_object_streams_and_what_the_file_says_of_itself(broken):
    got = pdf.read(with_object_streams(broken))
    assert (got["text"], got["pages"], got["title"], got["author"], got["creation_date"], got["has_images"]) == ("packed", 1, "Té", "Jane", "D:20240102", False)


def test_broken_tables_lengths_and_data():
    good = simple(b"BT /F1 12 Tf 0 0 Td (still here) Tj ET")
    assert text(good.replace(b"startxref\n", b"startxref\n9")) == "still here"
    assert text(good[: good.rindex(b"xref\n0")]) == "still here"  # no table at all
    assert text(b"%PDF-1.4 junk\n" + good) == "still here"  # every offset is wrong
    plain = simple(b"BT /F1 12 Tf 0 0 Td (still here) Tj ET", pack=False)
    assert text(plain.replace(b"/Length 38", b"/Length 99").replace(b"/Length 37", b"/Length 99").replace(b"/Length 39", b"/Length 99")) == "still here"
    bad = good.replace(b"/Kids [3 0 R]", b"/Kids [3 0 R 2 0 R 9 0 R]")
    assert text(bad) == "still here"  # a page tree with a circle and a hole


def test_forms_images_and_nested_pages():
    form = stream(b"BT /F1 10 Tf 0 50 Td (inside) Tj ET", b"/Type /XObject /Subtype /Form /Matrix [1 0 0 1 0 0]")
    again = stream(b"/X1 Do", b"/Type /XObject /Subtype /Form /Resources << /XObject << /X1 7 0 R >> >>")
    image = stream(b"\0", b"/Type /XObject /Subtype /Image")
    data = simple(b"BT /F1 10 Tf 0 90 Td (before) Tj ET /X0 Do /X1 Do", resources=b"/Font << /F1 4 0 R >> /XObject << /X0 6 0 R /X1 7 0 R /I 8 0 R >>", more={6: form, 7: again, 8: image})
    got = pdf.read(data)
    assert got["text"] == "before\ninside" and got["has_images"]


@pytest.mark.parametrize("bad", [b"", b"hello", b"%PDF-1.4\n", b"%PDF-1.4\n1 0 obj << /Type /Catalog >> endobj", simple(b"x", trailer=b"/Encrypt << /Filter /Standard >>")])
def test_bad_files_say_so(bad):
    if b"Catalog >>" in bad:
        assert pdf.read(bad)["pages"] == 0
    else:
        with pytest.raises(pdf.BadPdf):
            pdf.read(bad)


def test_damaged_files_never_do_worse_than_an_error():
    rnd, whole = random.Random(5), with_object_streams()
    for _ in range(300):
        x = bytearray(whole)
        for _ in range(rnd.randint(1, 12)):
            x[rnd.randrange(len(x))] = rnd.randrange(256)
        try:
            pdf.read(bytes(x[: rnd.randint(10, len(x))]))
        except pdf.BadPdf:
            pass


def test_texts_come_back_in_spark(spark):
    texts = ["One line.", "Zwei Zeilen:\nÄrger \U0001f600  ok", "\n".join(f"line {i}" for i in range(120)), "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("raw", pdf_export.pdf_of("text"))
    got = {r.id: r.c for r in rows.select("id", pdf.contents("raw").alias("c")).collect()}
    assert [got[i].text for i in range(4)] == texts[:4] and [got[i].pages for i in range(4)] == [1, 1, 3, 1] and got[4].text is None and got[4].error is None
    bad = spark.createDataFrame([(1, b"junk"), (2, pdf_export.text_pdf("fine"))], "id int, raw binary").withColumn("ext", F.lit("pdf"))
    read = {r.id: (r.c.error, r.p.text, r.p.error) for r in bad.select("id", pdf.contents("raw").alias("c"), files.parsed("raw", "ext").alias("p")).collect()}
    assert "not a PDF" in read[1][0] and "not a PDF" in read[1][2] and read[2] == (None, "fine", None)
