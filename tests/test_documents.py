import io
import struct
import zipfile
import zlib

from quern.sources import files as S
from quern.sources import pdf as P


def make_pdf(pages, compress=True, info=b"/Title (A \\(b\\)) /Author <FEFF00C9> /CreationDate (D:20240102030405Z)", cmap=None):
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages))) + b"] /MediaBox [0 0 600 800] /Resources << /Font << /F1 3 0 R >> >> >>"}
    objects[3] = b"<< /Type /Font /Subtype /Type1" + (b" /ToUnicode 4 0 R" if cmap else b"") + b" >>"
    if cmap:
        objects[4] = b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap)
    objects[5] = b"<< " + info + b" >>"
    for i, content in enumerate(pages):
        raw = zlib.compress(content) if compress else content
        objects[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * i)
        objects[11 + 2 * i] = b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(raw), b" /Filter /FlateDecode" if compress else b"", raw)
    body = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % kv for kv in objects.items())
    return body + b"trailer\n<< /Root 1 0 R /Info 5 0 R >>\nstartxref\n0\n%%EOF"


PAGE = b"BT /F1 12 Tf 50 700 Td (Hello \\(world\\)) Tj 0 -20 Td [(Sec) -20 (ond)] TJ ET"
TABLE = b"BT /F1 10 Tf " + b" ".join(b"1 0 0 1 %d %d Tm (%s) Tj" % (x, y, t) for y, row in ((700, (b"Name", b"Size")), (680, (b"a", b"1")), (660, (b"b", b"2"))) for x, t in zip((50, 300), row, strict=True)) + b" ET"


def test_pdf(spark):
    cmap = b"1 begincodespacerange <00> <FF> endcodespacerange 1 beginbfrange <41> <43> <0391> endbfrange 1 beginbfchar <44> <00660069> endbfchar"
    rows = [("a.pdf", make_pdf([PAGE, TABLE])), ("b.pdf", make_pdf([PAGE], False)), ("c.pdf", make_pdf([b"BT /F1 9 Tf 10 10 Td <41424344> Tj ET"], cmap=cmap)), ("d.pdf", b"no"), ("e.pdf", None), ("f.txt", b"x")]
    df = spark.createDataFrame([(p, bytearray(b) if b is not None else None) for p, b in rows], "relative_path string, content binary")
    got = {(r.relative_path, r.page_number): r for r in P.pdf_pages(df).collect()}
    assert got["a.pdf", 1].text == "Hello (world)\nSecond" and got["a.pdf", 2].text.split() == ["Name", "Size", "a", "1", "b", "2"] and got["b.pdf", 1].word_count == 3
    assert (got["a.pdf", 1].title, got["a.pdf", 1].author, got["a.pdf", 1].page_count, str(got["a.pdf", 1].created_at)) == ("A (b)", "É", 2, "2024-01-02 03:04:05")
    assert got["c.pdf", 1].text == "ΑΒΓfi" and got["d.pdf", None].error and got["e.pdf", None].error
    tables = P.pdf_tables(df).collect()
    assert [(r.relative_path, r.page_number, r.row_index, r.cells, r.confidence) for r in sorted(tables, key=lambda r: r.row_index)] == [("a.pdf", 2, i, c, 1.0) for i, c in enumerate([["Name", "Size"], ["a", "1"], ["b", "2"]])]
    assert P.pdf_pages(df.limit(0)).count() == 0


def test_docx_tables_and_properties(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda t, merge="": f"<w:tc><w:tcPr>{merge}</w:tcPr><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    table = f"<w:tbl><w:tr>{cell('a', '<w:vMerge w:val=\"restart\"/>')}{cell('b')}</w:tr><w:tr>{cell('', '<w:vMerge/>')}{cell('c', '<w:gridSpan w:val=\"2\"/>')}</w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>Hi</w:t></w:r></w:p>{table}</w:body></w:document>")
        z.writestr("docProps/core.xml", '<c:coreProperties xmlns:c="c" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>T</dc:title><dc:creator>Me</dc:creator></c:coreProperties>')
    df = spark.createDataFrame([("a.docx", bytearray(out.getvalue())), ("b.docx", bytearray(b"zz"))], "relative_path string, content binary")
    rows = {r.row_index: [(c.content, c.colSpan, c.rowSpan) for c in r.cells] for r in S.docx_tables(df).collect()}
    assert rows == {0: [("a", 1, 2), ("b", 1, 1)], 1: [("", 1, 0), ("c", 2, 1)]}
    texts = {r.relative_path: (r.title, r.author, r.n_tables) for r in S.docx_texts(df).collect()}
    assert texts["a.docx"] == ("T", "Me", 1) and texts["b.docx"] == (None, None, None)


def test_photos(spark):
    fields = [(0x100, 4, 1, struct.pack("<I", 40)), (0x101, 3, 1, struct.pack("<HH", 30, 0)), (0x132, 2, 20, struct.pack("<I", 100))]
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 3) + b"".join(struct.pack("<HHI", t, k, n) + v for t, k, n, v in fields)
    tiff = tiff.ljust(100, b"\0") + b"2024:05:06 07:08:09\0"
    exif = b"\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff
    jpeg = b"\xff\xd8" + exif + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 5, 6, 1) + b"\0" * 12
    df = spark.createDataFrame([("a.tif", 1, None, bytearray(tiff)), ("b.jpg", 1, None, bytearray(jpeg)), ("c.png", 1, None, bytearray(b"x"))], "relative_path string, size long, modified_at timestamp, content binary")
    got = {r.relative_path: (r.format, r.width, r.height, str(r.taken_at)) for r in S.images(df).collect()}
    assert got == {"a.tif": ("tiff", 40, 30, "2024-05-06 07:08:09"), "b.jpg": ("jpeg", 6, 5, "2024-05-06 07:08:09")}
