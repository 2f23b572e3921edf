import io
import json
import struct
import wave
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from quern.functions import binary_parsers as B
from quern.sources import files


def png(width=3, height=2):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"tEXt", b"Author\0Ada") + chunk(b"IEND", b"")


def wav():
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(b"\0" * 32_000)
    return out.getvalue()


def jpeg_with_exif():
    ascii_ = b"Maker\0"
    ifd = struct.pack("<H", 2) + struct.pack("<HHII", 0x010F, 2, len(ascii_), 38) + struct.pack("<HHIHH", 0x0112, 3, 1, 6, 0) + struct.pack("<I", 0)
    tiff = b"II*\0" + struct.pack("<I", 8) + ifd + ascii_
    app1 = b"Exif\0\0" + tiff
    return b"\xff\xd8" + b"\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, 40, 60, 3) + b"\0" * 9


def mp3():
    frame = lambda name, text: name + struct.pack(">I", len(text) + 1) + b"\0\0" + b"\x03" + text
    body = frame(b"TIT2", b"Song") + frame(b"TPE1", b"Ada")
    return b"ID3\x03\0\0" + bytes([0, 0, len(body) >> 7, len(body) & 127]) + body + b"\xff\xfb\x90\x00" + b"\0" * 16_000


def mp4():
    box = lambda kind, body: struct.pack(">I", 8 + len(body)) + kind + body
    mvhd = box(b"mvhd", b"\0" * 12 + struct.pack(">II", 1000, 2500) + b"\0" * 80)
    tkhd = box(b"tkhd", b"\0" * 76 + struct.pack(">II", 640 << 16, 360 << 16))
    hdlr = box(b"hdlr", b"\0" * 8 + b"vide" + b"\0" * 12)
    stsd = box(b"stsd", b"\0" * 8 + struct.pack(">I", 16) + b"avc1" + b"\0" * 8)
    return box(b"ftyp", b"isom\0\0\0\0") + box(b"moov", mvhd + box(b"trak", tkhd + box(b"mdia", hdlr + box(b"minf", box(b"stbl", stsd)))))


def pdf():
    stream = zlib.compress(b"BT (Hello \\(world\\)) Tj [(a) -20 (b)] TJ ET")
    return b"%PDF-1.4\n1 0 obj <</Type /Pages /Count 1>> endobj\n2 0 obj <</Type /Page>> endobj\n3 0 obj <</Title (My \\101 title) /Author <416461> /CreationDate (D:20240102030405Z)>> endobj\n4 0 obj <</Filter /FlateDecode>>\nstream\n" + stream + b"\nendstream endobj"


def office(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


DOCX = office({"word/document.xml": '<w:d xmlns:w="u"><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p><w:t>Two</w:t></w:p></w:d>', "docProps/core.xml": '<c xmlns:d="u"><d:title>T</d:title><d:creator>Ada</d:creator></c>'})
XLSX = office({"xl/workbook.xml": '<w><sheets><sheet name="S1"/><sheet name="S2"/></sheets></w>', "xl/sharedStrings.xml": "<s><si><t>x</t></si><si><t>y</t></si></s>"})
ODT = office({"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": '<o xmlns:t="u"><t:h>Head</t:h><t:p>Body</t:p></o>', "meta.xml": '<m xmlns:e="u"><e:title>T</e:title><e:keyword>a</e:keyword><e:keyword>b</e:keyword><e:document-statistic e:word-count="2"/></m>'})


@pytest.mark.parametrize(("name", "body", "expected"), [
    ("a.png", png(), {"format": "png", "width": 3, "height": 2, "color_type": "rgba", "has_alpha": True, "text_metadata": {"Author": "Ada"}}),
    ("a.jpg", jpeg_with_exif(), {"format": "jpeg", "width": 60, "height": 40, "exif": {"make": "Maker", "orientation": 6}}),
    ("a.gif", b"GIF89a" + struct.pack("<HH", 5, 7), {"format": "gif", "width": 5, "height": 7}),
    ("a.bmp", b"BM" + b"\0" * 16 + struct.pack("<iiHH", 9, -4, 1, 24), {"format": "bmp", "width": 9, "height": 4, "bit_depth": 24}),
    ("a.svg", b'<svg width="10px" height="20" viewBox="0 0 1 1">', {"format": "svg", "width": 10, "height": 20, "viewbox": "0 0 1 1"}),
    ("a.webp", b"RIFF\0\0\0\0WEBPVP8X\0\0\0\0\x10\0\0\0\x09\0\0\x13\0\0", {"format": "webp", "width": 10, "height": 20, "has_alpha": True}),
    ("a.wav", wav(), {"format": "wav", "channels": 2, "sample_rate": 8000, "bits_per_sample": 16, "duration_seconds": 1.0}),
    ("a.mp3", mp3(), {"format": "mp3", "bitrate": 128_000, "sample_rate": 44_100, "channels": 2, "tags": {"title": "Song", "artist": "Ada"}}),
    ("a.mp4", mp4(), {"format": "mp4", "brand": "isom", "duration_seconds": 2.5, "width": 640, "height": 360, "has_video": True, "has_audio": False, "video_codec": "avc1"}),
    ("a.flv", b"FLV\x01\x05" + b"\0" * 9, {"format": "flv", "has_audio": True, "has_video": True}),
    ("a.pdf", pdf(), {"format": "pdf", "version": "1.4", "page_count": 1, "author": "Ada", "creation_date": "2024-01-02T03:04:05"}),
    ("a.docx", DOCX, {"format": "docx", "paragraph_count": 2, "author": "Ada"}), ("a.xlsx", XLSX, {"format": "xlsx", "sheet_count": 2, "sheet_names": ["S1", "S2"]}),
    ("a.odt", ODT, {"format": "odt", "keywords": ["a", "b"], "statistics": {"word-count": "2"}}),
])
def test_formats(name, body, expected):
    assert expected.items() <= B.parse(body, name)["metadata"].items()


def test_texts_of_documents():
    assert B.parse(pdf(), "a.pdf")["text"] == "Hello (world) ab" and B.parse(pdf(), "a.pdf")["title"] == "My A title"
    assert B.parse(DOCX, "a.docx")["text"] == "One\nTwo" and B.parse(XLSX, "a.xlsx")["text"] == "x\ny" and B.parse(ODT, "a.odt")["text"] == "Head\nBody"


def test_folder_round_trip(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    for name, body in (("a.txt", b"\nTitle\nbody"), ("sub/p.html", b"<html><title>H</title>x</html>"), ("sub/i.png", png()), ("sub/bad.pdf", b"nothing"), ("n.bin", b"\xff\xfe\0")):
        (tmp_path / "in" / name).write_bytes(body)
    rows = files.read_folder(spark, str(tmp_path / "in"), base="/docs").cache()
    assert sorted(r.path for r in rows.collect()) == ["/docs/a.txt", "/docs/n.bin", "/docs/sub/bad.pdf", "/docs/sub/i.png", "/docs/sub/p.html"]
    got = {r.path: r for r in files.parsed(rows).collect()}
    assert got["/docs/a.txt"].title == "Title" and got["/docs/sub/p.html"].title == "H" and json.loads(got["/docs/sub/i.png"].metadata)["width"] == 3
    assert "/docs/n.bin" not in got and got["/docs/sub/bad.pdf"].text == ""
    files.store(rows, str(tmp_path / "store"))
    back = spark.read.parquet(str(tmp_path / "store"))
    assert back.where("path = '/docs/a.txt'").first().content == b"\nTitle\nbody"
    names = [n for r in files.write_archives(rows, 2).collect() for n in zipfile.ZipFile(io.BytesIO(r.zip)).namelist()]
    assert len(names) == 5 and "docs/sub/i.png" in names


def test_backups(spark, tmp_path):
    old = spark.createDataFrame([("/a", "1", 1), ("/b", "1", 5)], "path string, content_hash string, updated_at int")
    files.export_backup(old, str(tmp_path / "b"))
    now = spark.createDataFrame([("/a", "2", 2), ("/b", "0", 2), ("/c", "9", 1)], "path string, content_hash string, updated_at int")
    assert sorted(files.import_backup(spark, str(tmp_path / "b")).collect()) == sorted(old.collect())
    assert {r.path: r.content_hash for r in files.import_backup(spark, str(tmp_path / "b"), now, "merge").collect()} == {"/a": "2", "/b": "1", "/c": "9"}


def test_user_functions(spark):
    own = files.Functions()
    own.parsers["length"] = lambda b: {"n": len(b)}
    own.mappers["upper"] = str.upper
    own.queries["first"] = lambda df, n: df.limit(n)
    df = spark.createDataFrame([(b"abc", "x"), (None, None)], "b binary, s string")
    rows = df.select(own.parser("length", F.col("b")).alias("p"), own.mapper("upper", F.col("s")).alias("m")).collect()
    assert [(r.p, r.m) for r in rows] == [('{"n": 3}', "X"), (None, None)] and own.query("first", df, 1).count() == 1
