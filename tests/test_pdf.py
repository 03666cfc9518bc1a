"""The PDF core without Spark: syntax, filters, encryption, fonts, content, documents, writing."""

import re
import sys
import time
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folia import api, cli, render
from folia.errors import DocumentClosed, Encrypted, FileData, FileNotFound, FoliaError, Malformed, PageNotFound, RenderingUnavailable
from folia.pdf import crypto, filters, fonts
from folia.pdf import layout as L
from folia.pdf.assemble import Writer, build, encode_text, font_object
from folia.pdf.content import glyphs
from folia.pdf.document import Document, PdfFile, text_string
from folia.pdf.images import Image, Pixmap, cmyk_to_rgb, png, unpng
from folia.pdf.syntax import END, Name, Ref, Scanner, Stream, number, serialize, unhex

near = lambda *v: pytest.approx(v, abs=1e-3)


def simple(text="Hello PDFS", width=595, height=842, content=None, info=None, **page):
    body = content if content is not None else b"BT /F1 24 Tf 72 %d Td (%s) Tj ET" % (height - 100, text.encode("latin-1"))
    objects = {1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}, 2: {"Type": Name("Pages"), "Kids": [Ref(3, 0)], "Count": 1}}
    objects[3] = {"Type": Name("Page"), "Parent": Ref(2, 0), "MediaBox": [0, 0, width, height], "Resources": {"Font": {"F1": Ref(5, 0)}}, "Contents": Ref(4, 0)} | page
    objects |= {4: Stream({}, body), 5: {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica")}, 6: info or {"Title": b"A title"}}
    return build(objects, {"Root": Ref(1, 0), "Info": Ref(6, 0)})


def words(data, page=0):
    return [(*[round(v, 3) for v in w[:4]], *w[4:]) for w in api.from_bytes(data)[page].get_text("words")]


# syntax


@pytest.mark.parametrize(
    "source, value",
    [
        (b"12", 12), (b"-3.50", -3.5), (b"+.5", 0.5), (b"--7", 7), (b"true", True), (b"null", None), (b"/A#20b", "A b"), (b"3 0 R", Ref(3, 0)), (b"[1 2 0 R 3]", [1, Ref(2, 0), 3]),
        (b"(a(b)c)", b"a(b)c"), (b"(\\101\\n\\(\\\r\nx)", b"A\n(x"), (b"(a\rb)", b"a\nb"), (b"<48 6>", b"H`"), (b"<</A 1/B<</C(x)>>>>", {"A": 1, "B": {"C": b"x"}}), (b"% note\n 5", 5), (b"[1 % x\n2", [1, 2]), (b"(open", b"open"),
    ],
)
def test_values(source, value):
    assert Scanner(source).next() == value


def test_stray_delimiters_are_passed():
    s = Scanner(b") > ] >> } { x")
    seen = []
    while (t := s.next()) != END:
        seen.append(bytes(t))
    assert seen == [b")", b">", b"]", b">>", b"}", b"{", b"x"] or seen[-1] == b"x"


def test_deep_nesting_is_an_error():
    with pytest.raises(Malformed):
        Scanner(b"[" * 5000).next()


values = st.recursive(st.none() | st.booleans() | st.integers(-10**9, 10**9) | st.binary(max_size=20) | st.builds(Name, st.text("abcXYZ #/()", min_size=1, max_size=6)) | st.builds(Ref, st.integers(0, 999), st.integers(0, 9)), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text("abc /", min_size=1, max_size=4), x, max_size=4), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(values)
def test_serialize_round_trip(value):
    assert Scanner(serialize(value)).next() == value


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=300))
def test_scanner_ends_on_any_bytes(data):
    s, n = Scanner(data), 0
    try:
        while s.next() != END and n <= len(data) + 1:
            n += 1
    except Malformed:
        pass
    assert n <= len(data) + 1


def test_numbers():
    assert [number(x) for x in (1.0, 0.5, -0.0000001, 1.23456789, 100.25)] == ["1", "0.5", "0", "1.234568", "100.25"]
    assert unhex(b"4 8z5") == b"HP"


# filters


def test_filters():
    data = bytes(range(256)) * 3
    flate = {"Filter": Name("FlateDecode")}
    assert filters.decode(flate, zlib.compress(data)) == data
    raw = zlib.compressobj(wbits=-15)
    assert filters.decode(flate, raw.compress(data) + raw.flush()) == data
    assert filters.decode({"Filter": Name("AHx")}, b"48 65 6C6 >junk") == b"Hel`"
    assert filters.decode({"Filter": [Name("A85"), Name("Fl")]}, __import__("base64").a85encode(zlib.compress(data)) + b"~>") == data
    assert filters.unbase85(b"<~z87cURD]i,\"Ebo80~>") == b"\0\0\0\0Hello World!"
    with pytest.raises(Malformed):
        filters.decode({"Filter": Name("LZWDecode")}, b"")
    with pytest.raises(Malformed):
        filters.decode(flate, b"not zlib at all")


def test_predictors():
    from folia.plans.corpora import _predicted

    data = bytes((i * i + 7 * i) % 256 for i in range(160))
    assert filters.unpredict(_predicted(data, 16), 15, 1, 8, 16) == data
    assert filters.unpredict(data, 2) == data
    rgb = b"\x01" + bytes([1, 2, 3, 1, 1, 1])
    assert filters.unpredict(rgb, 11, 3, 8, 2) == bytes([1, 2, 3, 2, 3, 4])


# encryption


def test_ciphers():
    assert crypto.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    key, block = bytes(range(16)), bytes.fromhex("00112233445566778899aabbccddeeff")
    assert crypto.Aes(key).encrypt(block).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert crypto.Aes(key).decrypt(crypto.Aes(key).encrypt(block)) == block
    assert crypto.aes_data(key, b"short") == b""


def test_needs_a_password():
    locked = b"%PDF-1.4\n2 0 obj\n<</Filter /Standard /V 2 /R 3 /Length 128 /P -4 /O (o) /U (uuuuuuuuuuuuuuuuuuuuuuuuuuuuuuuu)>>\nendobj\ntrailer\n<</Encrypt 2 0 R>>"
    with pytest.raises(Encrypted):
        PdfFile(locked)


# fonts


def test_widths():
    assert (fonts.char_width("Helvetica", 65), fonts.char_width("hebo", 65), fonts.char_width("Courier", 233), fonts.char_width("helv", 233)) == (667, 722, 600, 556)
    assert fonts.text_width("Helvetica", "AA", 20) == pytest.approx(26.68)
    assert fonts.is_bold("HEBO") and not fonts.is_bold("tiro")


def test_glyph_names():
    assert [fonts.glyph_char(n) for n in ("A", "fi", "uni00E9", "u1F600", "Euro", "cid12", "")] == ["A", "ﬁ", "é", "😀", "€", None, None]


def test_cmap():
    c = fonts.CMap(b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <0048> <0002> <0066006C> endbfchar 2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<0058> <0059>] endbfrange")
    assert (c.code_bytes, c.lookup(1), c.lookup(2), c.lookup(0x12), c.lookup(0x21), c.lookup(99)) == (2, "H", "fl", "C", "Y", None)
    assert fonts.CMap(b"beginbfchar ) > ] endbfchar").lookup(1) is None


def test_encodings():
    make = lambda spec: fonts.Font(spec, lambda v: v, lambda s: s.raw)
    assert [t for _, t, _ in make({"Encoding": Name("WinAnsiEncoding")}).decode(b"\x80\xe9")] == ["€", "é"]
    assert [t for _, t, _ in make({"Encoding": Name("MacRomanEncoding")}).decode(b"\x8e")] == ["é"]
    assert [t for _, t, _ in make({}).decode(b"\xe9")] == ["é"]
    assert [t for _, t, _ in make({"Encoding": {"Differences": [65, Name("eacute"), Name("B"), Name("nothing"), Name("uni00DF")]}}).decode(b"ABCD")] == ["é", "B", "C", "ß"]
    wide = make({"Subtype": Name("Type0"), "DescendantFonts": [{"W": [1, [100, 200], 5, 7, 300]}]})
    assert [w for _, _, w in wide.decode(b"\0\x01\0\x02\0\x06\0\x09")] == [0.1, 0.2, 0.3, 0.5]
    assert wide.decode(b"\0\x01")[0][1] == "�"
    assert [w for _, _, w in make({"FirstChar": 65, "Widths": [700]}).decode(b"AB")] == [0.7, 0.667]


# content


def shown(content, height=800.0):
    font = fonts.Font({"BaseFont": Name("Courier")}, lambda v: v, lambda s: s.raw)
    return [(g[1], round(g[6], 3), round(height - g[7], 3)) for g in glyphs(content, lambda n: font if n == "F1" else None, height)]


@pytest.mark.parametrize(
    "content, expected",
    [
        (b"BT /F1 10 Tf 5 7 Td (ab) Tj ET", [("a", 5, 7), ("b", 11, 7)]),
        (b"/F1 10 Tf BT 1 0 0 1 5 7 Tm [(a) -1000 (b)] TJ ET", [("a", 5, 7), ("b", 21, 7)]),
        (b"/F1 10 Tf 12 TL BT 5 100 Td (a) Tj T* (b) Tj (c) ' ET", [("a", 5, 100), ("b", 5, 88), ("c", 5, 76)]),
        (b"/F1 10 Tf BT 5 100 TD 0 -14 TD (a) Tj T* (b) Tj ET", [("a", 5, 86), ("b", 5, 72)]),
        (b"/F1 10 Tf 2 Tc 3 Tw BT (a b) Tj ET", [("a", 0, 0), (" ", 8, 0), ("b", 19, 0)]),
        (b"/F1 10 Tf 50 Tz BT (ab) Tj ET", [("a", 0, 0), ("b", 3, 0)]),
        (b"/F1 10 Tf 4 Ts BT (a) Tj ET", [("a", 0, 4)]),
        (b'/F1 10 Tf 10 TL BT 3 2 (a b) " ET', [("a", 0, -10), (" ", 8, -10), ("b", 19, -10)]),
        (b"/F1 10 Tf q 2 0 0 2 10 10 cm BT 5 5 Td (a) Tj ET Q BT 5 5 Td (b) Tj ET", [("a", 20, 20), ("b", 5, 5)]),
        (b"/F1 10 Tf Q q q 1 0 0 1 5 0 cm Q BT (a) Tj ET", [("a", 0, 0)]),
        (b"/F1 10 Tf /Fm Do 1 0 0 RG BT (a) Tj ET ) > ] BT (b) Tj ET", [("a", 0, 0), ("b", 0, 0)]),
        (b"/No 10 Tf BT (a) Tj ET", []),
        (b"/F1 10 Tf BI /W 1 ID (x) Tj EI BT (a) Tj ET", [("a", 0, 0)]),
        (b"/F1 10 Tf BT (a) TJ 5 Tj [(b) /x] TJ ET", [("b", 0, 0)]),
    ],
)
def test_operators(content, expected):
    assert shown(content) == expected


# documents


def test_simple_document():
    d = api.from_bytes(simple(info={"Title": b"\xfe\xff\x00\xe9\xd8\x00", "Author": b"\xe9", "Producer": Ref(99, 0)}))
    assert (d.page_count, d[0].rect, d[0].rotation, d[0].number, d.encrypted, d.toc()) == (1, (0, 0, 595, 842), 0, 0, False, [])
    assert d.metadata["format"] == "PDF 1.7" and d.metadata["author"] == "é" and d.metadata["title"] == "é�" and d.metadata["producer"] is None
    first, second = words(simple())
    assert first == (72, 80.8, 126.672, 104.8, "Hello", 0, 0, 0) and second[0] == 133.344 and second[4:] == ("PDFS", 0, 0, 1)
    assert d[-1] is d[0] and str(d) == "Document(<stream>)" and len(d) == 1 and [p.number for p in d] == [0]
    with pytest.raises(PageNotFound):
        d[5]
    with pytest.raises(ValueError):
        d[0].get_text("nope")
    d.close()
    with pytest.raises(DocumentClosed):
        d.page_count  # noqa: B018


def test_opening(tmp_path):
    with pytest.raises(FileData):
        api.from_bytes(b"not a pdf")
    with pytest.raises(FileNotFound):
        api.open_pdf(str(tmp_path / "none.pdf"))
    with pytest.raises(ValueError):
        api.Document()
    path = tmp_path / "a.pdf"
    path.write_bytes(b"junk\n" + simple())
    with api.open_pdf(str(path)) as d:
        assert "Hello" in d[0].get_text()


def test_boxes():
    d = Document(simple(MediaBox=[600, 800, 0, 0], CropBox=[10, 20, 110, 220], Rotate=-90))
    p = d.pages[0]
    assert (p.mediabox, p.cropbox, p.rotation, p.rect) == ((0, 0, 600, 800), (10, 20, 110, 220), 270, (0, 0, 200, 100))
    assert Document(simple(MediaBox=None, Rotate=450)).pages[0].mediabox == (0, 0, 612, 792)


def test_text_modes():
    page = api.from_bytes(simple(content=b"BT /F1 20 Tf 72 700 Td (Hi!) Tj 0 -24 Td (you) Tj 0 -100 Td (far) Tj ET"))[0]
    assert page.get_text() == "Hi!\nyou\n\nfar"
    assert [(b[4], b[5], b[6]) for b in page.get_text("blocks")] == [("Hi!\nyou", 0, 0), ("far", 1, 0)]
    d = page.get_text("dict")
    assert d == page.get_text("rawdict") and d["blocks"][0]["lines"][0]["spans"][0]["size"] == 20 and len(d["blocks"][0]["lines"]) == 2


def test_malformed_documents_end():
    base = simple()
    for data in [base[:n] for n in range(60, len(base), 37)]:
        d = Document(data)
        [p.contents for p in d.pages]
    cyclic = build({1: {"Type": Name("Catalog"), "Pages": Ref(2, 0), "Outlines": {"First": Ref(4, 0)}, "Names": {"Dests": Ref(5, 0)}}, 2: {"Type": Name("Pages"), "Kids": [Ref(2, 0), Ref(3, 0), Ref(3, 0)]}, 3: {"Type": Name("Page"), "Contents": [Ref(6, 0), Ref(9, 0)]}, 4: {"Title": b"x", "Next": Ref(4, 0), "First": Ref(4, 0), "Dest": b"none"}, 5: {"Kids": [Ref(5, 0)]}, 6: Ref(6, 0)}, {"Root": Ref(1, 0)})
    d = Document(cyclic)
    assert len(d.pages) == 1 and d.outline() == [{"level": 1, "title": "x", "page1": -1, "kind": "goto", "page": None, "to": None, "uri": None}] and d.pages[0].contents == b""
    loop = b"%PDF-1.4\n1 0 obj\n<</Length 1 0 R>>\nstream\nabc\nendstream\nendobj\n"
    assert PdfFile(loop).object(1).raw == b"abc" and PdfFile(loop).object(7) is None
    assert text_string(None) is None


def test_no_trailer_and_wrong_length():
    data = simple().split(b"xref")[0].replace(b"/Length 4", b"/Length 999")
    assert "Hello" in api.from_bytes(data)[0].get_text()


# images


def test_images():
    assert unpng(png(2, 2, bytes(range(12))))[:4] == (2, 2, 2, 8)
    assert cmyk_to_rgb(bytes([0, 128, 255, 10])) == bytes([245, 122, 0])
    one = Image(Stream({"Width": 8, "Height": 1, "BitsPerComponent": 1, "ColorSpace": Name("G")}, b"\xa5"), lambda v: v, lambda s: s.raw)
    assert one.info() == {"width": 8, "height": 1, "bpc": 1, "colorspace": "DeviceGray", "filter": None} and unpng(one.extract()["image"])[2:] == (0, 1, b"\xa5")
    bad = Image(Stream({"Filter": Name("CCITTFaxDecode")}, b"x"), lambda v: v, lambda s: filters.decode(s.dict, s.raw))
    assert bad.extract()["ext"] == "bin"
    for space, label in (([Name("ICCBased"), Stream({"N": 4}, b"")], "DeviceCMYK"), ([Name("Lab")], "DeviceRGB"), (None, "DeviceGray"), ([Name("I"), Name("RGB"), 1, b""], "Indexed"), (Name("Pattern"), "Pattern")):
        assert one.label(space) == label
    with pytest.raises(FoliaError):
        api.from_bytes(simple()).image(1)


def test_pixmap(tmp_path):
    p = Pixmap(2, 2, 3, bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 255, 255, 255]))
    assert p.pixel(0, 0) == (255, 0, 0) and p.pixel(1, 1) == (255, 255, 255) and p.stride == 6 and not p.alpha and p.colorspace == "DeviceRGB" and str(p)
    assert Pixmap(1, 1, 4, bytes(4)).alpha and unpng(Pixmap(1, 1, 2, b"ab").to_png())[2] == 4
    with pytest.raises(FoliaError):
        p.pixel(5, 5)
    with pytest.raises(FoliaError):
        p.save(str(tmp_path / "a.bmp"))
    p.save(str(tmp_path / "a.png"))
    assert (tmp_path / "a.png").read_bytes()[:8] == b"\x89PNG\r\n\x1a\n"


# writing


def test_writer(tmp_path):
    w = Writer()
    page = w.add_page(400, 600)
    used = page.insert_textbox((0, 200, 400, 260), "CENTERED BOLD", 28, "Helvetica-Bold", color=(1, 0, 0))
    assert used == near(79.446, 213.2, 320.554, 246.8)
    page.insert_text((72, 72), "Hello (x) é")
    found = words(w.to_bytes())
    assert [x[4] for x in found] == ["Hello", "(x)", "é", "CENTERED", "BOLD"] and found[3][:4] == near(79.446, 213.2, 233.446, 241.2)
    w.save(str(tmp_path / "w.pdf"))
    assert api.open_pdf(str(tmp_path / "w.pdf")).page_count == 1
    assert encode_text("漢a") == b"?a"


def test_wrap():
    assert L.wrap(None, "helv", 10, 50) == [""] and L.wrap("a\n\nb", "helv", 10, 50) == ["a", "", "b"] and L.wrap(" a  b ", "helv", 10, 500) == ["a  b"]
    assert L.wrap("wide words wrap here", "helv", 10, 51) == ["wide words", "wrap here"]
    assert L.wrap("abcdefghijkl x", "helv", 10, 20) == ["abcdefghijkl", "x"] and L.wrap("a b", "helv", 10, 0) == ["a b"]
    assert L.tenth(0.25) == 0.3 and L.tenth(-0.25) == -0.3


def test_stamping(tmp_path):
    data = simple("Original body", 400, 600)
    d = api.from_bytes(data)
    assert d.save() == data
    d.insert_textbox(0, (0, 40, 400, 90), "STAMPED", fontsize=24, fontname="hebo")
    d.insert_text(0, (10, 500), "more", fontname="tiro")
    out = d.save(str(tmp_path / "s.pdf"))
    assert out.startswith(data) and len(out) > len(data)
    found = words(out)
    assert {"STAMPED", "Original", "body", "more"} <= {w[4] for w in found}
    assert next(w for w in found if w[4] == "STAMPED")[:4] == near(141.332, 50.6, 258.668, 74.6)
    assert next(w for w in found if w[4] == "Original")[:4] == near(72, 80.8, 154.68, 104.8)
    again = api.from_bytes(out)
    assert again.metadata["title"] == "A title"
    with pytest.raises(PageNotFound):
        d.insert_text(7, (0, 0), "x")


def test_stamping_contents_by_reference_to_an_array():
    data = build({1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}, 2: {"Type": Name("Pages"), "Kids": [Ref(3, 0)], "Resources": {"Font": {"F1": Ref(5, 0)}}}, 3: {"Type": Name("Page"), "Contents": Ref(6, 0)}, 4: Stream({}, b"BT /F1 12 Tf 50 700 Td (kept) Tj ET"), 5: font_object("Helvetica"), 6: [Ref(4, 0)]}, {"Root": Ref(1, 0)})
    d = api.from_bytes(data)
    d.insert_text(0, (50, 300), "added")
    assert [w[4] for w in words(d.save())] == ["kept", "added"]


def test_encrypted_documents_are_not_stamped(spark):
    import pandas as pd

    from folia.plans import corpora

    made = spark.createDataFrame(pd.DataFrame({"doc_id": ["a", "b"], "method": ["rc4", "aesv2"], "name": ["Secret one", "Secret two"]}))
    for r in corpora.encrypted(made).collect():
        d = api.from_bytes(bytes(r.content))
        assert d.encrypted and "Secret" in d[0].get_text() and d.metadata["title"].startswith("Secret")
        with pytest.raises(FoliaError):
            d.insert_text(0, (0, 0), "x")


def test_rendering_is_unavailable():
    assert not render.available() and render.unavailable_reason() and render.zoom((2, 0, 0, 2, 0, 0), 300)[0] == 2 and render.zoom()[0] == 1
    with pytest.raises(RenderingUnavailable):
        api.from_bytes(simple())[0].pixmap(dpi=144)


def test_command_line(tmp_path, capsys):
    path = tmp_path / "a.pdf"
    path.write_bytes(simple())
    assert cli.main(["info", str(path)]) == 0 and "pages: 1" in capsys.readouterr().out
    assert cli.main(["text", str(path), "0"]) == 0 and "Hello" in capsys.readouterr().out
    assert cli.main(["text", str(path)]) == 0 and "===== page 0" in capsys.readouterr().out
    assert cli.main(["pages", str(path)]) == 0 and "rotation=0" in capsys.readouterr().out
    assert cli.main(["--version"]) == 0 and cli.main([]) == 0
    assert cli.main(["text", str(tmp_path / "none")]) == 1 and cli.main(["what", "x"]) == 1 and cli.main(["info"]) == 1 and cli.main(["text", str(path), "9"]) == 1


# what can't be read or edited says so


def test_undecodable_contents_raise():
    import zlib

    from folia.sources.tables import parse

    good = b"BT /F1 12 Tf 72 700 Td (whole) Tj ET"
    for bad in (Stream({"Filter": Name("LZWDecode")}, b"x"), Stream({"Filter": Name("FlateDecode")}, zlib.compress(good)[:12])):
        pages = {k: {"Type": Name("Page"), "Parent": Ref(2, 0), "Resources": {"Font": {"F1": Ref(3, 0)}}, "Contents": Ref(k + 10, 0)} for k in (4, 5)}
        data = build({1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}, 2: {"Type": Name("Pages"), "Kids": [Ref(4, 0), Ref(5, 0)], "Count": 2}, 3: {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica")}, **pages, 14: bad, 15: Stream({}, good)}, {"Root": Ref(1, 0)})
        d = Document(data)
        with pytest.raises(Malformed):
            d.pages[0].contents  # noqa: B018
        assert d.pages[1].contents == good
        assert [(r["page"], r.get("error_class")) for r in parse("contents", "d", data)] == [(0, "Malformed"), (1, None)]
        assert {r[1] for r in parse("glyphs", "d", data)} == {1}
        assert [(r["page"], r["part"], r["error_class"]) for r in parse("errors", "d", data)] == [(0, "contents", "Malformed")]


def test_stamping_a_page_without_an_object_raises():
    data = build({1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}, 2: {"Type": Name("Pages"), "Kids": [{"Type": Name("Page")}], "Count": 1}}, {"Root": Ref(1, 0)})
    d = api.from_bytes(data)
    assert d.page_count == 1
    with pytest.raises(PageNotFound):
        d.insert_text(0, (10, 10), "lost")


def test_operands():
    """Of surplus operands the first count; a matrix of 0, 1 or 2 numbers is zeros, a turn, a scaling, one of 3 to 5 an error."""
    font = type("F", (), {"decode": lambda self, data: [(c, chr(c), 0.5) for c in data]})()

    def at(content):
        return [(round(g[6], 6), round(g[7], 6)) for g in glyphs(content, lambda name: font, 0.0)]

    assert at(b"BT /F1 10 99 Tf 1 2 3 Td (a) (b) Tj ET") == [(1, -2)]
    assert at(b"90 cm BT /F1 10 Tf 3 0 Td (a) Tj ET") == [(0, -3)]
    assert at(b"2 3 cm BT /F1 10 Tf 3 4 Td (a) Tj ET") == [(6, -12)]
    assert at(b"cm BT /F1 10 Tf 3 4 Td (a) Tj ET") == [(0, 0)]
    assert at(b"BT /F1 10 Tf 1 0 0 1 5 6 7 8 Tm (a) Tj ET") == [(5, -6)]
    with pytest.raises(Malformed):
        at(b"1 2 3 cm BT ET")


def test_predictors_and_base85_by_a_plain_version():
    import base64
    import random

    from folia.pdf.filters import unbase85

    r = random.Random(1)
    for n in range(40):
        data = r.randbytes(n) + bytes(4 * (n % 3))
        text = base64.a85encode(data)
        assert unbase85(text + b"~>") == data == unbase85(b"<~" + text[: n // 2] + b" \n" + text[n // 2 :] + b"~>rest")
    assert unbase85(b"87cUR\x7f~>") == b"Hell"


def test_deep_documents():
    """References, forms and arrays nested further than any fixed bound."""
    n = 3000
    chain = {k: Ref(k + 1, 0) for k in range(100, 100 + n)} | {100 + n: 7}
    f = PdfFile(build({1: {"Type": Name("Catalog")}, **chain}, {"Root": Ref(1, 0)}))
    assert f.resolve(Ref(100, 0)) == 7
    forms = {k: Stream({"Subtype": Name("Form"), "Resources": {"XObject": {"X": Ref(k + 1, 0)}}}, b"") for k in range(10, 60)} | {60: Stream({"Subtype": Name("Image"), "Width": 1, "Height": 1, "BitsPerComponent": 8, "ColorSpace": Name("DeviceGray")}, b"x")}
    d = Document(build({1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}, 2: {"Type": Name("Pages"), "Kids": [Ref(3, 0)]}, 3: {"Type": Name("Page"), "Resources": {"XObject": {"X": Ref(10, 0)}}}, **forms}, {"Root": Ref(1, 0)}))
    assert [x["xref"] for x in d.pages[0].images()] == [60]


def test_native_facade():
    assert not render.Native.available() and render.Native.version() is None and render.Native.reason()
    for call in (render.Native.render, render.Native.text):
        with pytest.raises(RenderingUnavailable):
            call(b"", 0)


def test_long_arrays_of_whole_numbers():
    """They are read at once, as the numbers one by one would be; so are objects by the word obj."""
    for source in (b"[1 2 0 R 3]", b"[ 1 -2 +3\n007]", b"[1 2.5 3]", b"[1 2 /A]", b"[12+3 4]", b"[1 2", b"[1%x\n2]", b"[--1 2]", b"[[1 2][3]]", b"[1\x002]"):
        slow = Scanner(b"[null " + source[1:]).next()  # a null in front keeps to the way of single objects
        assert Scanner(source).next() == slow[1:], source
    assert serialize([1, -2, 10**400]) == b"[1 -2 1" + b"0" * 400 + b"]" and serialize([True, 1]) == b"[true 1]" and serialize([1, Ref(2, 0)]) == b"[1 2 0 R]"
    data = b"%PDF-1.7\n1 0 obj 5 endobj 12345678901 0 obj 6 endobj 3 000000 obj 7 endobj 4\x00\n1\x00obj 8 endobj 5 0obj 9 endobj 6 0 object 0 0 obj 1 0 0 0 7 0 obj 2"
    plain = re.finditer(rb"(?<![0-9])(\d{1,10})[\x00\t\n\x0c\r ]+(\d{1,5})[\x00\t\n\x0c\r ]+obj(?![A-Za-z])", data)
    assert PdfFile(data).places == {int(m[1]): (int(m[2]), m.start(), m.end()) for m in plain}


def test_long_arrays_take_no_call_for_each_number():
    calls, values = 0, list(range(200_000))

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        found = Scanner(serialize(values)).next()
    finally:
        sys.setprofile(None)
    assert found == values and calls < 1000


def test_files_of_many_objects_take_linear_time():
    """40,000 objects of 16 MB in all: with the file copied for each of them, this took minutes."""
    start = time.process_time()
    data = build({n: b"x" * 400 for n in range(1, 40_001)}, {"Root": Ref(1, 0)})
    assert time.process_time() - start < 10 and len(PdfFile(data).places) == 40_000
