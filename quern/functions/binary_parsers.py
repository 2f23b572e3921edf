"""Parsers of binary documents: images, audio, video, PDF, office files.

There is no column form for these formats, so they run as one Arrow-batched
function over (path, content). Each parser returns a dictionary with text,
title and metadata; a file that cannot be read gives an error text and never
fails the job.
"""

from __future__ import annotations

import io
import json
import re
import struct
import zipfile
import zlib
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Format by extension.
FORMATS = {
    "png": "image", "jpg": "image", "jpeg": "image", "gif": "image", "bmp": "image", "webp": "image", "tif": "image", "tiff": "image", "svg": "image",
    "mp3": "audio", "wav": "audio", "ogg": "audio", "mp4": "video", "mov": "video", "avi": "video", "webm": "video", "mkv": "video", "flv": "video",
    "pdf": "pdf", "docx": "office", "xlsx": "office", "odt": "office", "ods": "office",
}


def _answer(format_: str, text: str = "", title: str = "", **metadata) -> dict:
    return {"text": text, "title": title, "metadata": {"format": format_} | {k: v for k, v in metadata.items() if v is not None}}


# --- images ----------------------------------------------------------------

# EXIF tags that are reported.
EXIF_TAGS = {0x010F: "make", 0x0110: "model", 0x0112: "orientation", 0x0131: "software", 0x0132: "date_time", 0x829A: "exposure_time", 0x829D: "f_number", 0x8827: "iso", 0x9003: "date_time_original", 0x920A: "focal_length"}
PNG_COLORS = {0: "grayscale", 2: "rgb", 3: "indexed", 4: "grayscale_alpha", 6: "rgba"}


def _tiff_entries(data: bytes, order: str, at: int) -> dict[int, object]:
    """Values of one directory of a TIFF structure."""
    out: dict[int, object] = {}
    sizes = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        size = sizes.get(kind, 0) * n
        if not size or n > 4096:
            continue
        place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
        raw = data[place : place + size]
        if len(raw) < size:
            continue
        if kind == 2:
            out[tag] = raw.rstrip(b"\0 ").decode("latin-1")
        elif kind in (5, 10):
            pairs = struct.unpack(order + ("II" if kind == 5 else "ii") * n, raw)
            values = [a / b if b else 0.0 for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
            out[tag] = values[0] if n == 1 else values
        elif kind in (3, 4, 9):
            values = list(struct.unpack(order + {3: "H", 4: "I", 9: "i"}[kind] * n, raw))
            out[tag] = values[0] if n == 1 else values
    return out


def _exif(data: bytes) -> dict | None:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order:
        return None
    top = _tiff_entries(data, order, struct.unpack_from(order + "I", data, 4)[0])
    every = dict(top)
    if isinstance(top.get(0x8769), int):
        every |= _tiff_entries(data, order, top[0x8769])
    out = {name: every[tag] for tag, name in EXIF_TAGS.items() if tag in every}
    if isinstance(top.get(0x8825), int):
        gps = _tiff_entries(data, order, top[0x8825])
        for name, ref, value in (("gps_latitude", 1, 2), ("gps_longitude", 3, 4)):
            parts = gps.get(value)
            if isinstance(parts, list) and len(parts) == 3:
                degrees = parts[0] + parts[1] / 60 + parts[2] / 3600
                out[name] = -degrees if gps.get(ref) in ("S", "W") else degrees
    return out or None


def _jpeg(data: bytes) -> dict:
    at, exif = 2, None
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            exif = _exif(data[at + 10 : at + 2 + size])
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            depth, height, width, parts = struct.unpack_from(">BHHB", data, at + 4)
            return _answer("jpeg", width=width, height=height, bit_depth=depth, color_type={1: "grayscale", 3: "ycbcr", 4: "cmyk"}.get(parts, "unknown"), exif=exif)
        at += 2 + size
    return _answer("jpeg", exif=exif)


def image(data: bytes) -> dict:
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        width, height, depth, color = struct.unpack_from(">IIBB", data, 16)
        at, text, animated = 8, {}, False
        while at + 8 <= len(data):
            size, kind = struct.unpack_from(">I", data, at)[0], data[at + 4 : at + 8]
            if kind == b"tEXt":
                key, _, value = data[at + 8 : at + 8 + size].partition(b"\0")
                text[key.decode("latin-1")] = value.decode("latin-1")
            animated |= kind == b"acTL"
            at += 12 + size
        return _answer("png", width=width, height=height, bit_depth=depth, color_type=PNG_COLORS.get(color, "unknown"), has_alpha=color in (4, 6), is_animated=animated, text_metadata=text or None)
    if data[:3] == b"\xff\xd8\xff":
        return _jpeg(data)
    if data[:6] in (b"GIF87a", b"GIF89a"):
        width, height = struct.unpack_from("<HH", data, 6)
        return _answer("gif", width=width, height=height, is_animated=data.count(b"\x21\xf9\x04") > 1)
    if data[:2] == b"BM":
        width, height, _, depth = struct.unpack_from("<iiHH", data, 18)
        return _answer("bmp", width=width, height=abs(height), bit_depth=depth)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        kind = data[12:16]
        if kind == b"VP8X":
            flags, w, h = data[20], int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
            return _answer("webp", width=w, height=h, has_alpha=bool(flags & 16), is_animated=bool(flags & 2))
        if kind == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return _answer("webp", width=(bits & 0x3FFF) + 1, height=(bits >> 14 & 0x3FFF) + 1, has_alpha=bool(bits >> 28 & 1))
        w, h = struct.unpack_from("<HH", data, 26)
        return _answer("webp", width=w & 0x3FFF, height=h & 0x3FFF, has_alpha=False)
    if data[:4] in (b"II*\0", b"MM\0*"):
        order = "<" if data[:2] == b"II" else ">"
        tags = _tiff_entries(data, order, struct.unpack_from(order + "I", data, 4)[0])
        depth = tags.get(258)
        return _answer("tiff", width=tags.get(256), height=tags.get(257), bit_depth=depth[0] if isinstance(depth, list) else depth, byte_order="little" if order == "<" else "big", exif=_exif(data))
    head = data[:4096].decode("utf-8", "replace")
    if m := re.search(r"<svg\b[^>]*>", head):
        get = lambda name: (x := re.search(rf'\b{name}\s*=\s*"([^"]*)"', m[0])) and x[1]
        size = lambda v: int(float(x[0])) if v and (x := re.match(r"[\d.]+", v)) else None
        return _answer("svg", width=size(get("width")), height=size(get("height")), viewbox=get("viewBox"))
    return _answer("unknown")


# --- audio -----------------------------------------------------------------

# Frames of ID3v2, bit rates (kbit/s) and sample rates of MPEG 1 layer 3.
ID3_FRAMES = {"TIT2": "title", "TPE1": "artist", "TALB": "album", "TYER": "year", "TDRC": "year", "TRCK": "track", "TCON": "genre", "COMM": "comment"}
MP3_RATES = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
MP3_SAMPLES = (44100, 48000, 32000)


def _id3_text(raw: bytes) -> str:
    codec = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(raw[0] if raw else 0, "latin-1")
    return raw[1:].decode(codec, "replace").strip("\0 ")


def _mp3(data: bytes) -> dict:
    tags, at = {}, 0
    if data[:3] == b"ID3":
        version, end = data[3], 10 + sum(b << s for b, s in zip(data[6:10], (21, 14, 7, 0), strict=True))
        at = 10
        while at + 10 <= min(end, len(data)) and data[at]:
            name = data[at : at + 4].decode("latin-1")
            size = sum(b << s for b, s in zip(data[at + 4 : at + 8], (21, 14, 7, 0), strict=True)) if version >= 4 else struct.unpack_from(">I", data, at + 4)[0]
            raw = data[at + 10 : at + 10 + size]
            if name in ID3_FRAMES:
                value = _id3_text(raw[:1] + raw[4:].split(b"\0", 1)[-1]) if name == "COMM" else _id3_text(raw)
                tags.setdefault(ID3_FRAMES[name], value)
            at += 10 + size
        at = end
    if len(data) >= 128 and data[-128:-125] == b"TAG":
        t = data[-125:]
        for name, a, b in (("title", 0, 30), ("artist", 30, 60), ("album", 60, 90), ("year", 90, 94), ("comment", 94, 122)):
            if value := t[a:b].split(b"\0")[0].decode("latin-1").strip():
                tags.setdefault(name, value)
        if not t[122] and t[123]:
            tags.setdefault("track", str(t[123]))
    m = re.compile(rb"\xff[\xfa\xfb][\x10-\xef]").search(data, at)
    if not m:
        return _answer("mp3", title=tags.get("title", ""), tags=tags or None)
    head = data[m.start() : m.start() + 4]
    rate, sample = MP3_RATES[head[2] >> 4] * 1000, (*MP3_SAMPLES, None)[head[2] >> 2 & 3]
    channels = 1 if len(head) > 3 and head[3] >> 6 == 3 else 2
    return _answer("mp3", title=tags.get("title", ""), bitrate=rate, sample_rate=sample, channels=channels, duration_seconds=round((len(data) - m.start()) * 8 / rate, 3) if rate else None, tags=tags or None)


def _wav(data: bytes) -> dict:
    at, out, rate, tags = 12, {}, 0, {}
    names = {"INAM": "title", "IART": "artist", "IPRD": "album", "ICRD": "year", "ICMT": "comment", "IGNR": "genre"}
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"fmt " and size >= 16:
            _, channels, sample, rate, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            out |= {"channels": channels, "sample_rate": sample, "bitrate": rate * 8, "bits_per_sample": bits}
        elif kind == b"data" and rate:
            out["duration_seconds"] = round(size / rate, 3)
        elif kind == b"LIST" and data[at + 8 : at + 12] == b"INFO":
            k = at + 12
            while k + 8 <= min(at + 8 + size, len(data)):
                n = struct.unpack_from("<I", data, k + 4)[0]
                name = names.get(data[k : k + 4].decode("latin-1"))
                if name:
                    tags[name] = data[k + 8 : k + 8 + n].rstrip(b"\0").decode("utf-8", "replace")
                k += 8 + n + n % 2
        at += 8 + size + size % 2
    return _answer("wav", title=tags.get("title", ""), tags=tags or None, **out)


def _ogg(data: bytes) -> dict:
    out, tags = {}, {}
    at = data.find(b"\x01vorbis")
    if at >= 0:
        channels, sample, _, nominal = struct.unpack_from("<xxxxBIii", data, at + 7)
        out = {"channels": channels, "sample_rate": sample, "bitrate": nominal if nominal > 0 else None}
        last = data.rfind(b"OggS")
        if last >= 0 and sample:
            out["duration_seconds"] = round(struct.unpack_from("<q", data, last + 6)[0] / sample, 3)
    at = data.find(b"\x03vorbis")
    if at >= 0:
        k = at + 7
        k += 4 + struct.unpack_from("<I", data, k)[0]
        n, k = struct.unpack_from("<I", data, k)[0], k + 4
        for _ in range(min(n, 1000)):
            size = struct.unpack_from("<I", data, k)[0]
            key, _, value = data[k + 4 : k + 4 + size].decode("utf-8", "replace").partition("=")
            tags[key.lower()] = value
            k += 4 + size
    return _answer("ogg", title=tags.get("title", ""), tags=tags or None, **out)


def audio(data: bytes) -> dict:
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        return _wav(data)
    if data[:4] == b"OggS":
        return _ogg(data)
    return _mp3(data) if data[:3] == b"ID3" or data[:1] == b"\xff" or data[-128:-125] == b"TAG" else _answer("unknown")


# --- video -----------------------------------------------------------------


def _boxes(data: bytes, at: int, end: int):
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1 and at + 16 <= end:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        size = size or end - at
        if size < head:
            return
        yield kind, at + head, min(at + size, end)
        at += size


def _mp4(data: bytes) -> dict:
    out = {"has_audio": False, "has_video": False}

    def walk(at: int, end: int) -> None:
        for kind, a, b in _boxes(data, at, end):
            if kind in (b"moov", b"trak", b"mdia", b"minf", b"stbl"):
                walk(a, b)
            elif kind == b"mvhd":
                scale, length = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
                out["duration_seconds"] = round(length / scale, 3) if scale else None
            elif kind == b"tkhd":
                w, h = struct.unpack_from(">II", data, b - 8)
                if w and h:
                    out.update(width=w >> 16, height=h >> 16)
            elif kind == b"hdlr":
                out["has_audio"] |= data[a + 8 : a + 12] == b"soun"
                out["has_video"] |= data[a + 8 : a + 12] == b"vide"
            elif kind == b"stsd" and b - a >= 16:
                code = data[a + 12 : a + 16].decode("latin-1")
                out["audio_codec" if code in ("mp4a", "ac-3", "Opus", "alac") else "video_codec"] = code

    walk(0, len(data))
    brand = data[8:12].decode("latin-1")
    return _answer("mov" if brand.strip() == "qt" else "mp4", brand=brand.strip(), **out)


def video(data: bytes) -> dict:
    if data[4:8] == b"ftyp":
        return _mp4(data)
    if data[:4] == b"RIFF" and data[8:12] == b"AVI ":
        at, out = data.find(b"avih"), {}
        if at >= 0:
            step, frames, w, h = (struct.unpack_from("<I", data, at + 8 + k)[0] for k in (0, 16, 32, 36))
            out = {"width": w, "height": h, "frame_rate": round(1e6 / step, 3) if step else None, "duration_seconds": round(frames * step / 1e6, 3)}
        return _answer("avi", has_video=b"vids" in data[:8192], has_audio=b"auds" in data[:8192], **out)
    if data[:4] == b"\x1a\x45\xdf\xa3":
        return _answer("webm" if b"webm" in data[:64] else "mkv")
    if data[:3] == b"FLV":
        numbers = {m[1].decode(): struct.unpack(">d", m[2])[0] for m in re.finditer(rb"(duration|width|height|framerate)\x00(.{8})", data[:8192], re.S)}
        return _answer("flv", has_audio=bool(data[4] & 4), has_video=bool(data[4] & 1), duration_seconds=numbers.get("duration"), width=numbers.get("width"), height=numbers.get("height"), frame_rate=numbers.get("framerate"))
    return _answer("unknown")


# --- PDF -------------------------------------------------------------------

_PDF_STRING = rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>"
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_string(raw: bytes) -> str:
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        body = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        body = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1].strip() == b"" and m[1] != b" " else _ESCAPES.get(m[1], m[1]), raw[1:-1], flags=re.S)
    return body[2:].decode("utf-16-be", "replace") if body[:2] == b"\xfe\xff" else body.decode("latin-1")


def _pdf_date(value: str) -> str:
    m = re.match(r"(?:D:)?(\d{4})(\d\d)?(\d\d)?(\d\d)?(\d\d)?(\d\d)?", value)
    return f"{m[1]}-{m[2] or '01'}-{m[3] or '01'}T{m[4] or '00'}:{m[5] or '00'}:{m[6] or '00'}" if m else value


def pdf(data: bytes) -> dict:
    if data[:5] != b"%PDF-":
        raise ValueError("not a PDF file")
    info = {}
    for name in ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate"):
        m = re.search(rb"/" + name.encode() + rb"\s*(" + _PDF_STRING + rb")", data, re.S)
        info[name] = _pdf_string(m[1]) if m else ""
    text = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\n?endstream", data, re.S):
        body = m[1]
        if b"/FlateDecode" in data[max(0, m.start() - 512) : m.start()]:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        for block in re.findall(rb"\bBT\b(.*?)\bET\b", body, re.S):
            words = []
            for shown in re.finditer(rb"(\[(?:[^\]\\]|\\.)*\]|" + _PDF_STRING + rb")\s*(TJ|Tj|'|\")", block, re.S):
                words.append("".join(_pdf_string(s) for s in re.findall(_PDF_STRING, shown[1], re.S)))
            if words:
                text.append(" ".join(words))
    pages = len(re.findall(rb"/Type\s*/Page(?![A-Za-z])", data))
    if not pages and (m := re.search(rb"/Count\s+(\d+)", data)):
        pages = int(m[1])
    version = data[5:8].decode("latin-1")
    return _answer("pdf", "\n".join(text), info["Title"], version=version, page_count=pages, author=info["Author"], subject=info["Subject"], keywords=info["Keywords"], creator=info["Creator"], producer=info["Producer"], creation_date=_pdf_date(info["CreationDate"]), mod_date=_pdf_date(info["ModDate"]))


# --- office ----------------------------------------------------------------


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _fields(xml: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for e in ElementTree.fromstring(xml).iter():
        if e.text and e.text.strip():
            name = _local(e.tag)
            out[name] = f"{out[name]}, {e.text.strip()}" if name == "keyword" and name in out else e.text.strip()
    return out


def _paragraphs(xml: bytes, kinds: tuple[str, ...]) -> list[str]:
    return ["".join(e.itertext()) for e in ElementTree.fromstring(xml).iter() if _local(e.tag) in kinds]


def office(data: bytes) -> dict:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        if "word/document.xml" in names or "xl/workbook.xml" in names:
            core = _fields(z.read("docProps/core.xml")) if "docProps/core.xml" in names else {}
            about = {"author": core.get("creator", ""), "subject": core.get("subject", ""), "description": core.get("description", ""), "keywords": core.get("keywords", ""), "created": core.get("created", ""), "modified": core.get("modified", "")}
            if "word/document.xml" in names:
                parts = _paragraphs(z.read("word/document.xml"), ("p",))
                return _answer("docx", "\n".join(p for p in parts if p), core.get("title", ""), paragraph_count=len(parts), **about)
            shared = _paragraphs(z.read("xl/sharedStrings.xml"), ("si",)) if "xl/sharedStrings.xml" in names else []
            sheets = [e.get("name", "") for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(e.tag) == "sheet"]
            return _answer("xlsx", "\n".join(shared), core.get("title", ""), sheet_count=len(sheets), sheet_names=sheets, **about)
        meta = _fields(z.read("meta.xml")) if "meta.xml" in names else {}
        kind = z.read("mimetype").decode() if "mimetype" in names else ""
        parts = _paragraphs(z.read("content.xml"), ("p", "h"))
        statistics = next((dict((_local(k), v) for k, v in e.attrib.items()) for e in ElementTree.fromstring(z.read("meta.xml")).iter() if _local(e.tag) == "document-statistic"), None) if "meta.xml" in names else None
        return _answer("ods" if "spreadsheet" in kind else "odt", "\n".join(p for p in parts if p), meta.get("title", ""), author=meta.get("initial-creator") or meta.get("creator"), subject=meta.get("subject"), description=meta.get("description"), keywords=[k.strip() for k in meta["keyword"].split(",")] if "keyword" in meta else None, created=meta.get("creation-date"), modified=meta.get("date"), statistics=statistics)


PARSERS = {"image": image, "audio": audio, "video": video, "pdf": pdf, "office": office}


def parse(content: bytes, name: str) -> dict:
    kind = FORMATS.get(name.rsplit(".", 1)[-1].lower())
    if kind is None:
        raise ValueError("no parser for this format")
    return PARSERS[kind](content)


def parse_files(files: DataFrame, content: str = "content") -> DataFrame:
    """(path, format, title, text, metadata as JSON, error) of binary files (path, content)."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    out, error = parse(body.as_py() or b"", path or ""), None
                except Exception as e:  # noqa: BLE001  a file that cannot be read has no content, and says why
                    out, error = _answer("unknown"), f"{type(e).__name__}: {e}"
                rows.append({"path": path, "format": out["metadata"]["format"], "title": out["title"], "text": out["text"], "metadata": json.dumps(out["metadata"], ensure_ascii=False), "error": error})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([(n, pa.string()) for n in ("path", "format", "title", "text", "metadata", "error")]))

    return files.select("path", F.col(content).cast("binary")).mapInArrow(run, "path string, format string, title string, text string, metadata string, error string")
