"""The PDF reader on generated files: tables and streams of references, filters, fonts, positions, damage."""

import zlib

import pytest

from corpusweave.sources import files, pdf


def stream(head: bytes, data: bytes) -> bytes:
    return b"<< %s /Length %d >>\nstream\n%s\nendstream" % (head, len(data), data)


def classic(objects: dict[int, bytes], root: int = 1, extra: bytes = b"") -> bytes:
    """A file with a cross-reference table."""
    out, places = b"%PDF-1.4\n", {}
    for n, body in objects.items():
        places[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    size = max(objects) + 1
    table = b"".join(b"%010d 00000 n \n" % places[n] if n in places else b"0000000000 65535 f \n" for n in range(size))
    return out + b"xref\n0 %d\n%strailer\n<< /Size %d /Root %d 0 R %s >>\nstartxref\n%d\n%%%%EOF" % (size, table, size, root, extra, len(out))


def pages(*contents: bytes, font: bytes = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>", more: dict | None = None, resources: bytes = b"") -> dict[int, bytes]:
    kids = b" ".join(b"%d 0 R" % (10 + 2 * k) for k in range(len(contents)))
    out = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [ %s ] /Count %d /Resources << /Font << /F1 3 0 R >> %s >> >>" % (kids, len(contents), resources), 3: font}
    for k, c in enumerate(contents):
        out[10 + 2 * k] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * k)
        out[11 + 2 * k] = c if c.startswith(b"<<") else stream(b"", c)
    return out | (more or {})


TWO = [b"BT /F1 12 Tf 72 700 Td (Second) Tj 0 20 Td (First \\(row\\) caf\\351) Tj ET", b"BT /F1 12 Tf 1 0 0 1 200 500 Tm (right) Tj 1 0 0 1 100 500 Tm [(le) 20 (ft) -400 (gap)] TJ 14 TL T* (below) Tj (line) ' ET"]


def test_rows_and_pages():
    assert pdf.text(classic(pages(*TWO))) == "First (row) café\nSecond\n\fleft gap right\nbelow\nline\n"


def test_empty_and_bad_pages_keep_their_place():
    bad = stream(b"/Filter /FlateDecode", b"this is not deflated")
    odd = stream(b"/Filter /DCTDecode", b"\xff\xd8")
    assert pdf.text(classic(pages(TWO[0], b"", bad, odd, TWO[0]))).split("\f") == ["First (row) café\nSecond\n", "", "", "", "First (row) café\nSecond\n"]
    assert pdf.text(classic({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [ 2 0 R 9 0 R ] >>"})) == ""


@pytest.mark.parametrize("how", ["flate", "hex", "a85", "lzw", "both"])
def test_filters(how):
    import base64

    data = TWO[0]
    lzw = "".join(f"{x:09b}" for x in [256, *data[:200], 256, *data[200:], 257])
    made = {
        "flate": stream(b"/Filter /FlateDecode", zlib.compress(data)), "hex": stream(b"/Filter /ASCIIHexDecode", data.hex().encode() + b">"), "a85": stream(b"/Filter [ /ASCII85Decode ]", base64.a85encode(data) + b"~>"),
        "lzw": stream(b"/Filter /LZWDecode", bytes(int(lzw[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(lzw), 8))), "both": stream(b"/Filter [ /A85 /Fl ]", base64.a85encode(zlib.compress(data)) + b"~>"),
    }
    assert pdf.text(classic(pages(made[how]))) == "First (row) café\nSecond\n"


CMAP = b"/CIDInit begincmap 1 begincodespacerange <0000> <ffff> endcodespacerange 2 beginbfchar <0001> <00480069> <0002> <D83DDE00> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<0078> <0079>] endbfrange endcmap"


def packed() -> bytes:
    """A file with an object stream and a cross-reference stream under a predictor."""
    inner = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [ 4 0 R ] /Count 1 >>", 3: b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 6 0 R >>", 4: b"<< /Type /Page /Parent 2 0 R /Contents [ 5 0 R ] /Resources << /Font << /F1 3 0 R >> >> >>"}
    table, body = [], b""
    for n, x in inner.items():
        table.append(b"%d %d" % (n, len(body)))
        body += x + b"\n"
    head = b" ".join(table) + b"\n"
    objects = {5: stream(b"/Filter /FlateDecode", zlib.compress(b"q 2 0 0 2 0 0 cm BT /F1 9 Tf 10 10 Td <000100020010001100120020> Tj ET Q BT /F1 9 Tf 0 300 Td <0021> Tj ET")), 6: stream(b"/Filter /FlateDecode", zlib.compress(CMAP)), 7: stream(b"/Type /ObjStm /N %d /First %d /Filter /FlateDecode" % (len(inner), len(head)), zlib.compress(head + body))}
    out, places = b"%PDF-1.5\n", {}
    for n, x in objects.items():
        places[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, x)
    at = len(out)
    rows = [(0, 0, 0)] + [(2, 7, n - 1) for n in inner] + [(1, places[n], 0) for n in objects] + [(1, at, 0)]
    rows = [bytes([a]) + b.to_bytes(3, "big") + bytes([c]) for a, b, c in rows]
    up = b"".join(b"\x02" + bytes((x - y) & 255 for x, y in zip(r, rows[k - 1] if k else bytes(5))) for k, r in enumerate(rows))
    x = stream(b"/Type /XRef /W [ 1 3 1 ] /Size 9 /Root 1 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 5 >>", zlib.compress(up))
    return out + b"8 0 obj\n%s\nendobj\nstartxref\n%d\n%%%%EOF" % (x, at)


def test_object_streams_and_unicode_maps():
    assert pdf.text(packed()) == "y\nHi😀abcx\n"


def test_damaged_references_are_scanned_for():
    for whole, want in ((classic(pages(*TWO)), "First (row) café\nSecond\n\fleft gap right\nbelow\nline\n"), (packed(), "y\nHi😀abcx\n")):
        assert pdf.text(whole.replace(b"startxref", b"startxxxx")) == want
        assert pdf.text(b"%PDF-1.4 junk\n" + whole) == want
        at = whole.rfind(b"startxref")
        assert pdf.text(whole[:at] + b"startxref\n7\n%%EOF") == want


def test_newer_revision_wins():
    old = classic(pages(TWO[0]))
    at = len(old)
    body = b"11 0 obj\n" + stream(b"", b"BT /F1 9 Tf (new) Tj ET") + b"\nendobj\n"
    prev = int(old.rsplit(b"startxref\n", 1)[1].split(b"\n")[0])
    new = old + b"\n" + body + b"xref\n11 1\n%010d 00000 n \ntrailer\n<< /Size 12 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (at + 1, prev, at + 1 + len(body))
    assert pdf.text(new) == "new\n"


def test_encodings_forms_and_images():
    font = b"<< /Type /Font /Subtype /TrueType /Encoding << /BaseEncoding /MacRomanEncoding /Differences [ 65 /eacute /fi /uni20AC 97 /scaron ] >> >>"
    form = stream(b"/Subtype /Form /Matrix [ 1 0 0 1 0 100 ] /Resources << /Font << /F1 3 0 R >> >>", b"BT /F1 9 Tf (D) Tj ET")
    own = b"BT /F1 9 Tf 0 50 Td (ABCa\\212) Tj ET /X Do BI /W 1 /H 1 ID \x00(Tj\xff) Tj EI BT /F1 9 Tf (E) Tj ET"
    assert pdf.text(classic(pages(own, font=font, more={30: form}, resources=b"/XObject << /X 30 0 R >>"))) == "D\néfi€šä\nE\n"


def test_refused_and_through_the_reader(spark):
    assert files.read_document("pdf", classic(pages(*TWO)))[0].count("\f") == 1
    text, error = files.read_document("pdf", b"not a pdf")
    assert text is None and error
    assert files.read_document("pdf", classic(pages(*TWO), extra=b"/Encrypt << /V 1 >>"))[0] is None
    for cut in range(0, len(packed()), 41):  # broken files end with a text or an error
        files.read_document("pdf", packed()[:cut])
        files.read_document("pdf", classic(pages(*TWO))[:cut])
    rows = files.document_text(spark.createDataFrame([("pdf", bytearray(packed()))], "extension string, content binary")).collect()
    assert [(r["text"], r["error"]) for r in rows] == [("y\nHi😀abcx\n", None)]
