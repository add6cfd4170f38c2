"""File parsers: bytes of one file -> (body text or None, attributes).

Each family has one function; whatever goes wrong inside leaves the file with no
attributes, never without its row.
"""

from __future__ import annotations

import ast
import csv
import email
import email.policy
import email.utils
import io
import json
import mailbox
import plistlib
import re
import sqlite3
import struct
import tarfile
import tempfile
import tomllib
import zipfile
import zlib
from datetime import datetime, timezone
from html.parser import HTMLParser
from xml.etree import ElementTree

from quarry.sources import symbols

# The attributes that parsers can find.
ATTRIBUTES = """
title author language tags categories draft date frontmatter frontmatter_format word_count csv_columns column_count
yaml_kind yaml_document_count email_message_id email_in_reply_to email_to email_cc sent_at attachment_count email_count
page_count entry_count uncompressed_size top_level_entries has_root_dir kernel cell_count code_cell_count
markdown_cell_count functions type_names imports references max_complexity module go_version base_image package_name
package_version img_width img_height sample_rate channels bit_depth duration binary_format bitness architectures
entry_point camera_make camera_model lens orientation iso exposure_time f_stop focal_length taken_at gps_lat gps_lon
artist album album_artist composer genre year track bitrate video_width video_height video_codec audio_codec frame_rate section_count is_dynamically_linked class_name runtime_version bytecode_format wasm_version python_version
plist_format plist_root_kind plist_bundle_identifier plist_bundle_name plist_bundle_version plist_label plist_program
database_format sqlite_page_size sqlite_page_count sqlite_text_encoding sqlite_user_version sqlite_application_id
sqlite_table_count sqlite_view_count sqlite_index_count sqlite_trigger_count sqlite_table_names bitpix naxis naxis1
naxis2 object telescope instrument observer date_obs science_format hdf5_format_version vertex_count face_count
model3d_format materials font_format font_family font_subfamily font_full_name font_glyph_count font_units_per_em
chat_message_count chat_participants chat_channel bookmark_count bookmark_urls bookmark_titles package_format
disk_image_format virtual_size
""".split()


def _text(data: bytes) -> str:
    return data[: 1 << 20].decode("utf-8", "replace")


class _Words(HTMLParser):
    """Text of a page: no script or style, a line end after each block."""

    BLOCKS = {"p", "div", "li", "tr", "br", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table", "ul", "ol"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag == "br":
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def html_words(markup: str) -> str:
    p = _Words()
    p.feed(markup)
    return re.sub(r"\s*\n\s*", "\n", "".join(p.parts)).strip()


def _scalar(x: str):
    x = x.strip()
    if x[:1] in "\"'" and x[-1:] == x[:1] and len(x) > 1:
        return x[1:-1]
    if x.startswith("[") and x.endswith("]"):
        return [_scalar(y) for y in x[1:-1].split(",") if y.strip()]
    if x.lower() in ("true", "false"):
        return x.lower() == "true"
    if re.fullmatch(r"-?\d+", x):
        return int(x)
    if re.fullmatch(r"-?\d+\.\d+", x):
        return float(x)
    return None if x in ("", "~", "null") else x


def simple_yaml(text: str) -> dict:
    """Top-level keys with scalars, flow lists or dashed lists: what front matter holds."""
    out: dict = {}
    key = None
    for line in text.splitlines():
        if m := re.match(r"^([A-Za-z_][\w-]*)\s*:\s*(.*)$", line):
            key = m[1]
            out[key] = _scalar(re.sub(r"\s+#.*$", "", m[2]))
        elif (m := re.match(r"^\s*-\s+(.*)$", line)) and key:
            if not isinstance(out[key], list):
                out[key] = []
            out[key].append(_scalar(m[1]))
    return out


def _when(x) -> datetime | None:
    if isinstance(x, datetime):
        return x.astimezone(timezone.utc).replace(tzinfo=None) if x.tzinfo else x
    m = re.match(r"^(\d{4}-\d\d-\d\d)(?:[T ](\d\d:\d\d(?::\d\d)?))?", str(x))
    return datetime.fromisoformat(f"{m[1]}T{m[2] or '00:00:00'}") if m else None


def markdown(name: str, data: bytes):
    text, found, attrs = _text(data), {}, {}
    if m := re.match(r"\A---\r?\n(.*?)\r?\n---\r?(?:\n|\Z)", text, re.S):
        found, attrs["frontmatter_format"] = simple_yaml(m[1]), "yaml"
    elif m := re.match(r"\A\+\+\+\r?\n(.*?)\r?\n\+\+\+\r?(?:\n|\Z)", text, re.S):
        found, attrs["frontmatter_format"] = tomllib.loads(m[1]), "toml"
    elif m := re.match(r"\A(\{.*?\n\})\s*\n", text, re.S):
        found, attrs["frontmatter_format"] = json.loads(m[1]), "json"
    body = text[m.end() :] if m else text
    if found:
        attrs["frontmatter"] = json.dumps(found, default=str)
        for k in ("title", "author", "language"):
            if isinstance(found.get(k), str):
                attrs[k] = found[k]
        for k in ("tags", "categories"):
            if found.get(k):
                attrs[k] = [str(x) for x in (found[k] if isinstance(found[k], list) else [found[k]])]
        if isinstance(found.get("draft"), bool):
            attrs["draft"] = found["draft"]
        if found.get("date"):
            attrs["date"] = _when(found["date"])
    if "title" not in attrs and (m := re.search(r"^# +(.+?)\s*$", body, re.M)):
        attrs["title"] = m[1]
    attrs["word_count"] = len(body.split())
    return body, attrs


def table(name: str, data: bytes):
    text = _text(data)
    first = next((x for x in text.splitlines() if x.strip()), "")
    mark = "\t" if name.lower().endswith(".tsv") else ","
    try:
        columns = next(csv.reader([first], delimiter=mark, strict=True), [])
    except csv.Error:
        columns = first.split(mark)
    return text, {"csv_columns": [c.strip() for c in columns], "column_count": len(columns)}


def yaml(name: str, data: bytes):
    text = _text(data)
    parts = [p for p in re.split(r"^---\s*$", text, flags=re.M) if p.strip()]
    line = next((x for x in (parts[0] if parts else "").splitlines() if x.strip() and not x.lstrip().startswith("#")), "")
    kind = "sequence" if re.match(r"\s*(-\s|\[)", line) else "mapping" if re.match(r"\s*(\{|[^\s#][^:]*:(\s|$))", line) else "scalar"
    return text, {"yaml_kind": kind, "yaml_document_count": len(parts)}


def _message(m) -> tuple[str, dict]:
    bodies = [p for p in m.walk() if p.get_content_maintype() == "text" and not p.get_filename()]
    plain = next((p for p in bodies if p.get_content_subtype() == "plain"), bodies[0] if bodies else None)
    body = (plain.get_payload(decode=True) or b"").decode(plain.get_content_charset() or "utf-8", "replace") if plain is not None else ""
    if plain is not None and plain.get_content_subtype() == "html":
        body = html_words(body)
    people = lambda h: [a for _, a in email.utils.getaddresses([str(x) for x in m.get_all(h, [])])]
    attrs = {
        "title": str(m["subject"] or ""),
        "author": str(m["from"] or ""),
        "email_message_id": str(m["message-id"] or "").strip("<> "),
        "email_in_reply_to": str(m["in-reply-to"] or "").strip("<> "),
        "email_to": people("to"),
        "email_cc": people("cc"),
        "attachment_count": sum(1 for p in m.walk() if p.get_content_disposition() == "attachment"),
    }
    if m["date"]:
        attrs["sent_at"] = _when(email.utils.parsedate_to_datetime(str(m["date"])))
    return body, attrs


def mail(name: str, data: bytes):
    return _message(email.message_from_bytes(data, policy=email.policy.compat32))


def mbox(name: str, data: bytes):
    with tempfile.NamedTemporaryFile(suffix=".mbox") as f:
        f.write(data)
        f.flush()
        found = [_message(m) for m in mailbox.mbox(f.name)]
    attrs = dict(found[0][1]) if found else {}
    attrs["email_count"] = len(found)
    return "\n\n".join(b for b, _ in found), attrs


_DC = "{http://purl.org/dc/elements/1.1/}"


def office(name: str, data: bytes):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        attrs: dict = {}
        for meta in ("docProps/core.xml", "meta.xml"):
            if meta in names:
                root = ElementTree.fromstring(z.read(meta))
                for k, tag in (("title", "title"), ("author", "creator"), ("language", "language")):
                    if (e := root.find(f".//{_DC}{tag}")) is not None and e.text:
                        attrs[k] = e.text
        parts = [n for n in sorted(names) if re.fullmatch(r"word/document\.xml|ppt/slides/slide\d+\.xml|xl/sharedStrings\.xml|content\.xml", n)]
        slides = [n for n in parts if n.startswith("ppt/")]
        if slides:
            attrs["page_count"] = len(slides)
        lines = []
        for n in parts:
            for e in ElementTree.fromstring(z.read(n)).iter():
                if e.tag.rsplit("}", 1)[-1] in ("p", "si", "h"):
                    lines.append("".join(e.itertext()))
        return "\n".join(lines), attrs


def epub(name: str, data: bytes):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        attrs, parts = {}, []
        for n in z.namelist():
            if n.endswith(".opf"):
                root = ElementTree.fromstring(z.read(n))
                for k, tag in (("title", "title"), ("author", "creator"), ("language", "language")):
                    if (e := root.find(f".//{_DC}{tag}")) is not None and e.text:
                        attrs[k] = e.text
            elif n.lower().endswith((".xhtml", ".html", ".htm")):
                parts.append(html_words(z.read(n).decode("utf-8", "replace")))
        return "\n".join(parts), attrs


def pdf(name: str, data: bytes):
    """Title, author and pages from the uncompressed parts; the words that content streams show, plain or deflated, as their codes stand."""
    attrs: dict = {"page_count": len(re.findall(rb"/Type\s*/Page[^s]", data))}
    for k, tag in (("title", rb"/Title"), ("author", rb"/Author")):
        if m := re.search(tag + rb"\s*\(((?:\\.|[^\\)])*)\)", data):
            attrs[k] = m[1].decode("latin-1")
    return _pdf_words(data) or None, attrs


_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]+>|\[|\]|-?\d+\.?\d*|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\n", b"t": b"\t", b"b": b"", b"f": b"\n"}


def _pdf_string(token: bytes) -> str:
    if token[:1] == b"<":
        raw = bytes.fromhex(re.sub(rb"\s", b"", token[1:-1]).decode() + "0" * (len(re.sub(rb"\s", b"", token[1:-1])) % 2))
        return raw.decode("utf-16-be", "replace") if raw[:1] == b"\0" else raw.decode("latin-1")
    plain = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
    return plain.decode("latin-1")


def _pdf_words(data: bytes) -> str:
    """The text that the streams of a PDF show, a line for each move to a new one."""
    out: list[str] = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S):
        body = m[1]
        if b"FlateDecode" in data[max(0, m.start() - 400) : m.start()].rsplit(b"obj", 1)[-1]:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        if b"BT" not in body:
            continue
        held: list[bytes] = []
        for t in _SHOWN.findall(body):
            if t[:1] in b"(<[]" or t[:1].isdigit() or t[:1] == b"-":
                held.append(t)
                continue
            if t in (b"Tj", b"TJ", b"'", b'"'):
                if t in (b"'", b'"'):
                    out.append("\n")
                for x in held:
                    if x[:1] in b"(<":
                        out.append(_pdf_string(x))
                    elif t == b"TJ" and x[:1] == b"-" and float(x) < -200:
                        out.append(" ")
            elif t in (b"Td", b"TD", b"T*", b"ET", b"Tm"):
                out.append("\n")
            held = []
    return re.sub(r"\s*\n\s*", "\n", "".join(out)).strip()


def archive(name: str, data: bytes):
    if data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            items = [(i.filename, i.file_size) for i in z.infolist() if not i.is_dir()]
    else:
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            items = [(m.name.removeprefix("./"), m.size) for m in t if m.isfile()]
    tops = sorted({n.split("/")[0] for n, _ in items})
    return None, {"entry_count": len(items), "uncompressed_size": sum(s for _, s in items), "top_level_entries": tops, "has_root_dir": len(tops) == 1 and all("/" in n for n, _ in items)}


def notebook(name: str, data: bytes):
    book = json.loads(data)
    cells = book.get("cells") or book.get("paragraphs") or []
    kind = lambda c: c.get("cell_type") or ("markdown" if str(c.get("text", "")).startswith("%md") else "code")
    source = lambda c: "".join(c["source"]) if isinstance(c.get("source"), list) else c.get("source") or c.get("text") or ""
    kernel = (book.get("metadata") or {}).get("kernelspec") or {}
    attrs = {"cell_count": len(cells), "code_cell_count": sum(kind(c) == "code" for c in cells), "markdown_cell_count": sum(kind(c) == "markdown" for c in cells), "kernel": kernel.get("name", ""), "language": kernel.get("language") or ""}
    return "\n\n".join(source(c) for c in cells), attrs


def source(name: str, data: bytes, language: str):
    text, attrs = _text(data), {}
    found = symbols.extract(text, language)
    if language == "python":
        ast.parse(text)  # a file that does not parse has no attributes
    attrs = {k: found[k] for k in ("functions", "type_names", "imports")}
    attrs["references"] = sorted({u["symbol"] for u in found["uses"]})
    attrs["max_complexity"] = max((s["complexity"] for s in found["spans"]), default=0)
    return text, attrs


def build(name: str, data: bytes):
    text, attrs = _text(data), {}
    if m := re.search(r"^FROM\s+(?:--\S+\s+)*(\S+)", text, re.M | re.I):
        attrs["base_image"] = m[1]
    return text, attrs


def manifest(name: str, data: bytes):
    text, attrs = _text(data), {}
    if name == "go.mod":
        for k, rule in (("module", r"^module\s+(\S+)"), ("go_version", r"^go\s+(\S+)")):
            if m := re.search(rule, text, re.M):
                attrs[k] = m[1]
    elif name.endswith(".json"):
        found = json.loads(text)
        attrs = {"package_name": found.get("name"), "package_version": found.get("version")}
    elif name == "Cargo.toml":
        found = tomllib.loads(text).get("package", {})
        attrs = {"package_name": found.get("name"), "package_version": str(found.get("version", ""))}
    return text, attrs


_TIFF_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 9: 4, 10: 8}


def _tiff(data: bytes) -> dict:
    """Tags of a TIFF block by number; those of the Exif and GPS folders come as (folder, number)."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    found: dict = {}

    def value(kind: int, n: int, at: int):
        raw = data[at : at + _TIFF_SIZES[kind] * n]
        if kind == 2:
            return raw.split(b"\0")[0].decode("utf-8", "replace").strip()
        if kind in (5, 10):
            parts = struct.unpack(f"{order}{2 * n}{'I' if kind == 5 else 'i'}", raw)
            own = [a / b if b else 0.0 for a, b in zip(parts[::2], parts[1::2])]
        else:
            own = list(struct.unpack(f"{order}{n}{ {1: 'B', 3: 'H', 4: 'I', 6: 'b', 7: 'B', 9: 'i'}[kind] }", raw))
        return own[0] if n == 1 else own

    def folder(at: int, of: int) -> None:
        (count,) = struct.unpack(order + "H", data[at : at + 2])
        for k in range(min(count, 512)):
            tag, kind, n = struct.unpack(order + "HHI", data[at + 2 + 12 * k : at + 10 + 12 * k])
            if kind not in _TIFF_SIZES or n > 4096:
                continue
            place = at + 10 + 12 * k
            if _TIFF_SIZES[kind] * n > 4:
                (place,) = struct.unpack(order + "I", data[place : place + 4])
            found[(of, tag) if of else tag] = value(kind, n, place)

    (first,) = struct.unpack(order + "I", data[4:8])
    folder(first, 0)
    for of in (0x8769, 0x8825):
        if isinstance(found.get(of), int):
            folder(found[of], of)
    return found


def exif(data: bytes) -> dict:
    """Camera attributes of a TIFF block (of a JPEG or a raw photo)."""
    tags = _tiff(data)
    names = {0x010F: "camera_make", 0x0110: "camera_model", 0x0112: "orientation", (0x8769, 0xA434): "lens", (0x8769, 0x8827): "iso", (0x8769, 0x829A): "exposure_time", (0x8769, 0x829D): "f_stop", (0x8769, 0x920A): "focal_length"}
    attrs = {n: tags[t] for t, n in names.items() if t in tags}
    taken = str(tags.get((0x8769, 0x9003)) or "")
    if re.match(r"\d{4}:\d\d:\d\d \d\d:\d\d:\d\d", taken):
        attrs["taken_at"] = datetime.strptime(taken[:19], "%Y:%m:%d %H:%M:%S")
    for name, mark, at, low in (("gps_lat", 1, 2, "S"), ("gps_lon", 3, 4, "W")):
        parts = tags.get((0x8825, at))
        if isinstance(parts, list) and len(parts) == 3:
            degrees = parts[0] + parts[1] / 60 + parts[2] / 3600
            attrs[name] = -degrees if tags.get((0x8825, mark)) == low else degrees
    return attrs


def image(name: str, data: bytes):
    if data[:4] in (b"II*\0", b"MM\0*"):
        tags = _tiff(data)
        size = {n: tags[t] for t, n in ((0x0100, "img_width"), (0x0101, "img_height")) if isinstance(tags.get(t), int)}
        return None, size | exif(data)
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        w, h, depth = struct.unpack(">IIB", data[16:25])
        return None, {"img_width": w, "img_height": h, "bit_depth": depth}
    if data[:4] == b"GIF8":
        w, h = struct.unpack("<HH", data[6:10])
        return None, {"img_width": w, "img_height": h}
    if data[:2] == b"BM":
        w, h = struct.unpack("<ii", data[18:26])
        return None, {"img_width": w, "img_height": abs(h)}
    if data[:2] == b"\xff\xd8":
        at, attrs = 2, {}
        while at + 9 < len(data) and data[at] == 0xFF:
            mark, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if mark == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                try:
                    attrs = exif(data[at + 10 : at + 2 + size])
                except (struct.error, KeyError, ValueError):
                    attrs = {}
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return None, {"img_width": w, "img_height": h} | attrs
            at += 2 + size
        return None, attrs
    if data[:4] == b"RIFF" and data[12:16] == b"VP8X":
        return None, {"img_width": int.from_bytes(data[24:27], "little") + 1, "img_height": int.from_bytes(data[27:30], "little") + 1}
    return None, {}


# Names of tag frames and of comment fields.
_ID3 = {"TIT2": "title", "TPE1": "artist", "TALB": "album", "TPE2": "album_artist", "TCOM": "composer", "TCON": "genre", "TYER": "year", "TDRC": "year", "TRCK": "track"}
_COMMENTS = {"title": "title", "artist": "artist", "album": "album", "albumartist": "album_artist", "composer": "composer", "genre": "genre", "date": "year", "tracknumber": "track"}
_MP3_RATES = {1: [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320], 2: [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]}


def _tags(pairs) -> dict:
    attrs: dict = {}
    for name, text in pairs:
        if name in ("year", "track"):
            m = re.match(r"\d+", text)
            text = int(m[0]) if m else None
        if text:
            attrs.setdefault(name, text)
    return attrs


def _id3(data: bytes) -> tuple[dict, int]:
    """Tags of an ID3 version 2 block, and where the sound begins."""
    if data[:3] != b"ID3":
        return {}, 0
    packed = lambda b: (b[0] & 127) << 21 | (b[1] & 127) << 14 | (b[2] & 127) << 7 | (b[3] & 127)
    end, at, pairs = 10 + packed(data[6:10]), 10, []
    while at + 10 <= end and data[at : at + 4].strip(b"\0"):
        size = packed(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        frame, body = data[at : at + 4].decode("latin-1"), data[at + 10 : at + 10 + size]
        if frame in _ID3 and body:
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            pairs.append((_ID3[frame], body[1:].decode(code, "replace").split("\0")[0].strip()))
        at += 10 + size
    return _tags(pairs), end


def _comments(block: bytes) -> dict:
    """Tags of a Vorbis comment block."""
    (vendor,) = struct.unpack("<I", block[:4])
    (count,) = struct.unpack("<I", block[4 + vendor : 8 + vendor])
    at, pairs = 8 + vendor, []
    for _ in range(min(count, 1000)):
        (size,) = struct.unpack("<I", block[at : at + 4])
        key, _, text = block[at + 4 : at + 4 + size].decode("utf-8", "replace").partition("=")
        if key.lower() in _COMMENTS:
            pairs.append((_COMMENTS[key.lower()], text.strip()))
        at += 4 + size
    return _tags(pairs)


def _mp3(data: bytes) -> dict:
    attrs, at = _id3(data)
    while at + 4 <= len(data):
        at = data.find(b"\xff", at)
        if at < 0 or at + 4 > len(data):
            return attrs
        head = int.from_bytes(data[at : at + 4], "big")
        version, layer, rate, hertz = head >> 19 & 3, head >> 17 & 3, head >> 12 & 15, head >> 10 & 3
        if head >> 21 == 0x7FF and version != 1 and layer == 1 and 0 < rate < 15 and hertz < 3:
            bits = _MP3_RATES[1 if version == 3 else 2][rate] * 1000
            attrs |= {"bitrate": bits, "sample_rate": [44100, 48000, 32000][hertz] >> {3: 0, 2: 1, 0: 2}[version], "channels": 1 if head >> 6 & 3 == 3 else 2, "duration": (len(data) - at) * 8 / bits}
            return attrs
        at += 1
    return attrs


def audio(name: str, data: bytes):
    if data[:3] == b"ID3" or (data[:1] == b"\xff" and data[1:2] >= b"\xe0"):
        return None, _mp3(data)
    if data[:4] == b"OggS" and (at := data.find(b"\x03vorbis")) > 0:
        attrs = _comments(data[at + 7 :])
        if (h := data.find(b"\x01vorbis")) > 0:
            attrs["channels"], attrs["sample_rate"] = data[h + 11], struct.unpack("<I", data[h + 12 : h + 16])[0]
        return None, attrs
    if data[:4] == b"RIFF" and (at := data.find(b"fmt ")) > 0:
        _, channels, rate, per_second, _, bits = struct.unpack("<HHIIHH", data[at + 8 : at + 24])
        size = struct.unpack("<I", data[d + 4 : d + 8])[0] if (d := data.find(b"data")) > 0 else 0
        return None, {"channels": channels, "sample_rate": rate, "bit_depth": bits, "duration": size / per_second if per_second else 0.0}
    if data[:4] == b"fLaC":
        packed = int.from_bytes(data[18:26], "big")
        rate, samples = packed >> 44, packed & ((1 << 36) - 1)
        at, tags = 4, {}
        while at + 4 <= len(data):
            kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
            if kind & 127 == 4:
                tags = _comments(data[at + 4 : at + 4 + size])
            if kind & 128:
                break
            at += 4 + size
        return None, tags | {"sample_rate": rate, "channels": (packed >> 41 & 7) + 1, "bit_depth": (packed >> 36 & 31) + 1, "duration": samples / rate if rate else 0.0}
    return None, {}


def _boxes(data: bytes, at: int, end: int):
    """(kind, begin, end) of the boxes of an MP4 or QuickTime file."""
    while at + 8 <= end:
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        head = 8
        if size == 1:
            size, head = struct.unpack(">Q", data[at + 8 : at + 16])[0], 16
        size = size or end - at
        if size < head:
            return
        yield kind, at + head, min(at + size, end)
        at += size


def _mp4(data: bytes) -> dict:
    attrs: dict = {}

    def walk(at: int, end: int, track: dict) -> None:
        for kind, a, b in _boxes(data, at, end):
            if kind in (b"moov", b"trak", b"mdia", b"minf", b"stbl"):
                own = {} if kind == b"trak" else track
                walk(a, b, own)
                if kind == b"trak" and own.get("kind") == b"vide":
                    attrs.setdefault("video_width", own.get("width"))
                    attrs.setdefault("video_height", own.get("height"))
                    attrs.setdefault("video_codec", own.get("codec"))
                elif kind == b"trak" and own.get("kind") == b"soun":
                    attrs.setdefault("audio_codec", own.get("codec"))
            elif kind == b"mvhd":
                scale, length = struct.unpack(">II", data[a + 12 : a + 20]) if data[a] == 0 else struct.unpack(">IQ", data[a + 20 : a + 32])
                attrs["duration"] = length / scale if scale else 0.0
            elif kind == b"tkhd":
                track["width"], track["height"] = (x >> 16 for x in struct.unpack(">II", data[b - 8 : b]))
            elif kind == b"hdlr":
                track["kind"] = data[a + 8 : a + 12]
            elif kind == b"stsd":
                track["codec"] = data[a + 12 : a + 16].decode("latin-1").strip()

    walk(0, len(data), {})
    return attrs


def video(name: str, data: bytes):
    if data[:4] == b"RIFF" and data[8:12] == b"AVI ":
        at = data.find(b"avih")
        micros, frames, width, height = (struct.unpack("<I", data[at + 8 + k : at + 12 + k])[0] for k in (0, 16, 32, 36))
        code = data[s + 12 : s + 16].decode("latin-1").strip() if (s := data.find(b"strh")) > 0 else ""
        return None, {"video_width": width, "video_height": height, "duration": micros * frames / 1e6, "frame_rate": 1e6 / micros if micros else 0.0, "video_codec": code}
    return None, _mp4(data) if data[4:8] in (b"ftyp", b"moov", b"mdat", b"wide", b"free") else {}


def binary(name: str, data: bytes):
    if data[:4] == b"\x7fELF":
        wide, little = data[4] == 2, "<" if data[5] == 1 else ">"
        machine = struct.unpack(little + "H", data[18:20])[0]
        entry = struct.unpack(little + ("Q" if wide else "I"), data[24 : 32 if wide else 28])[0]
        sections = struct.unpack(little + "H", data[60:62] if wide else data[48:50])[0]
        return None, {"binary_format": "elf", "bitness": 64 if wide else 32, "architectures": [{3: "x86", 62: "x86_64", 40: "arm", 183: "arm64", 243: "riscv"}.get(machine, str(machine))], "entry_point": entry & ((1 << 63) - 1), "section_count": sections, "is_dynamically_linked": b"/ld-" in data[:8192]}
    if data[:2] == b"MZ":
        at = struct.unpack("<I", data[60:64])[0]
        machine, sections = struct.unpack("<HH", data[at + 4 : at + 8])
        return None, {"binary_format": "pe", "bitness": 64 if machine in (0x8664, 0xAA64) else 32, "architectures": [{0x14C: "x86", 0x8664: "x86_64", 0xAA64: "arm64"}.get(machine, hex(machine))], "section_count": sections}
    cpu = struct.unpack("<I", data[4:8])[0]
    return None, {"binary_format": "mach-o", "bitness": 64 if data[:4] == b"\xcf\xfa\xed\xfe" else 32, "architectures": [{0x1000007: "x86_64", 0x100000C: "arm64", 7: "x86"}.get(cpu, hex(cpu))]}


def bytecode(name: str, data: bytes):
    if data[:4] == b"\xca\xfe\xba\xbe":
        return None, {"bytecode_format": "jvm", "runtime_version": f"Java {struct.unpack('>H', data[6:8])[0] - 44}"}
    if data[:4] == b"\0asm":
        return None, {"bytecode_format": "wasm", "wasm_version": struct.unpack("<I", data[4:8])[0]}
    return None, {"bytecode_format": "python", "python_version": str(struct.unpack("<H", data[:2])[0])}


def plist(name: str, data: bytes):
    found = plistlib.loads(data)
    attrs = {"plist_format": "binary" if data[:6] == b"bplist" else "xml", "plist_root_kind": "dict" if isinstance(found, dict) else "array" if isinstance(found, list) else "scalar"}
    if isinstance(found, dict):
        for k, key in (("plist_bundle_identifier", "CFBundleIdentifier"), ("plist_bundle_name", "CFBundleName"), ("plist_bundle_version", "CFBundleVersion"), ("plist_label", "Label"), ("plist_program", "Program")):
            if isinstance(found.get(key), str):
                attrs[k] = found[key]
    return None, attrs


def sqlite(name: str, data: bytes):
    con = sqlite3.connect(":memory:")
    con.deserialize(data)
    rows = con.execute("SELECT type, name FROM sqlite_master").fetchall()
    tables = sorted(n for t, n in rows if t == "table" and not n.startswith("sqlite_"))
    count = lambda k: sum(t == k for t, _ in rows)
    one = lambda q: con.execute(f"PRAGMA {q}").fetchone()[0]
    attrs = {"database_format": "sqlite", "sqlite_page_size": one("page_size"), "sqlite_page_count": one("page_count"), "sqlite_text_encoding": one("encoding"), "sqlite_user_version": one("user_version"), "sqlite_application_id": one("application_id")}
    attrs |= {"sqlite_table_names": tables, "sqlite_table_count": len(tables), "sqlite_view_count": count("view"), "sqlite_index_count": count("index"), "sqlite_trigger_count": count("trigger")}
    con.close()
    return None, attrs


def science(name: str, data: bytes):
    if data[:6] == b"SIMPLE":
        cards = [data[i : i + 80].decode("ascii", "replace") for i in range(0, min(len(data), 28800), 80)]
        found = {c[:8].strip(): c[10:].split(" /")[0].strip().strip("'").strip() for c in cards if c[8:10] == "= "}
        attrs: dict = {"science_format": "fits"}
        for k in ("BITPIX", "NAXIS", "NAXIS1", "NAXIS2"):
            if k in found:
                attrs[k.lower()] = int(found[k])
        for k, key in (("object", "OBJECT"), ("telescope", "TELESCOP"), ("instrument", "INSTRUME"), ("observer", "OBSERVER"), ("date_obs", "DATE-OBS")):
            if key in found:
                attrs[k] = found[key]
        return None, attrs
    if data[:4] == b"\x89HDF":
        return None, {"science_format": "hdf5", "hdf5_format_version": data[8]}
    return None, {}


def model(name: str, data: bytes):
    low = name.lower()
    if low.endswith(".obj"):
        text = _text(data)
        return None, {"model3d_format": "obj", "vertex_count": len(re.findall(r"^v ", text, re.M)), "face_count": len(re.findall(r"^f ", text, re.M)), "materials": sorted(set(re.findall(r"^usemtl\s+(\S+)", text, re.M)))}
    if low.endswith(".stl"):
        if data[:5] == b"solid" and b"facet" in data[:1024]:
            return None, {"model3d_format": "stl", "face_count": data.count(b"endfacet"), "vertex_count": data.count(b"vertex")}
        n = struct.unpack("<I", data[80:84])[0]
        return None, {"model3d_format": "stl", "face_count": n, "vertex_count": n * 3}
    return None, {"model3d_format": "gltf"}


def font(name: str, data: bytes):
    kind = {b"OTTO": "otf", b"wOFF": "woff", b"wOF2": "woff2", b"ttcf": "collection"}.get(data[:4], "ttf")
    attrs: dict = {"font_format": kind}
    if kind in ("otf", "ttf"):
        tables = {data[12 + 16 * i : 16 + 16 * i]: struct.unpack(">II", data[20 + 16 * i : 28 + 16 * i]) for i in range(struct.unpack(">H", data[4:6])[0])}
        if b"head" in tables:
            attrs["font_units_per_em"] = struct.unpack(">H", data[tables[b"head"][0] + 18 : tables[b"head"][0] + 20])[0]
        if b"maxp" in tables:
            attrs["font_glyph_count"] = struct.unpack(">H", data[tables[b"maxp"][0] + 4 : tables[b"maxp"][0] + 6])[0]
        if b"name" in tables:
            base = tables[b"name"][0]
            _, count, strings = struct.unpack(">HHH", data[base : base + 6])
            for i in range(count):
                platform, _, _, what, length, offset = struct.unpack(">6H", data[base + 6 + 12 * i : base + 18 + 12 * i])
                if field := {1: "font_family", 2: "font_subfamily", 4: "font_full_name"}.get(what):
                    attrs.setdefault(field, data[base + strings + offset : base + strings + offset + length].decode("utf-16-be" if platform in (0, 3) else "latin-1", "replace"))
    return None, attrs


def chat(name: str, data: bytes):
    found = json.loads(data)
    turns = found if isinstance(found, list) else found.get("messages", [])
    who = lambda t: (t.get("author") or {}).get("name") if isinstance(t.get("author"), dict) else t.get("user") or (t.get("envelope") or {}).get("sourceName") or ""
    what = lambda t: t.get("content") or t.get("text") or ((t.get("envelope") or {}).get("dataMessage") or {}).get("message") or ""
    when = lambda t: str(t.get("timestamp") or t.get("ts") or (t.get("envelope") or {}).get("timestamp") or "")
    turns = turns[:10_000]
    attrs = {"chat_message_count": len(turns), "chat_participants": sorted({who(t) for t in turns if who(t)})}
    if isinstance(found, dict) and isinstance(found.get("channel"), dict):
        attrs["chat_channel"] = found["channel"].get("name")
    return "\n".join(f"{when(t)}\t{who(t)}\t{what(t)}" for t in turns), attrs


def bookmarks(name: str, data: bytes):
    found: list[tuple[str, str]] = []

    def walk(x):
        if isinstance(x, dict):
            if x.get("url") or x.get("URLString"):
                found.append((x.get("url") or x["URLString"], x.get("name") or (x.get("URIDictionary") or {}).get("title") or ""))
            for y in x.values():
                walk(y)
        elif isinstance(x, list):
            for y in x:
                walk(y)

    walk(json.loads(data) if name == "Bookmarks" else plistlib.loads(data))
    return None, {"bookmark_count": len(found), "bookmark_urls": [u for u, _ in found], "bookmark_titles": [t for _, t in found]}


def package(name: str, data: bytes):
    kind = {b"!<ar": "deb", b"\xed\xab\xee\xdb": "rpm", b"xar!": "pkg", b"\x7fELF": "appimage"}.get(data[:4], "")
    attrs = {"package_format": kind}
    if kind == "rpm" and (label := data[10:76].split(b"\0")[0].decode("ascii", "replace")).count("-") >= 2:
        attrs["package_name"], attrs["package_version"], _ = label.rsplit("-", 2)
    return None, attrs


def disk(name: str, data: bytes):
    if data[:4] == b"QFI\xfb":
        return None, {"disk_image_format": "qcow2", "virtual_size": struct.unpack(">Q", data[24:32])[0]}
    return None, {"disk_image_format": name.rsplit(".", 1)[-1].lower()}


_EXACT = {"markdown": markdown, "csv": table, "yaml": yaml, "email/rfc822": mail, "email/mbox": mbox, "epub": epub, "pdf": pdf, "system/plist": plist, "database/sqlite": sqlite, "build/dockerfile": build}
_FAMILIES = {"office": office, "archive": archive, "notebook": notebook, "manifest": manifest, "image": image, "audio": audio, "video": video, "binary": binary, "bytecode": bytecode, "science": science, "model3d": model, "font": font, "chat": chat, "browser": bookmarks, "install": package, "disk-image": disk}


#: How the types begin whose files a parser reads.
PARSED = (*_EXACT, *(f"{family}/" for family in _FAMILIES), "source/")


def parse(content_type: str, name: str, data: bytes) -> tuple[str | None, dict]:
    """Body and attributes of one file; nothing where it is malformed or has no parser."""
    data = bytes(data or b"")
    family = content_type.split("/")[0]
    parser = _EXACT.get(content_type) or _FAMILIES.get(family)
    try:
        if family == "source":
            return source(name, data, content_type[7:])
        return parser(name, data) if parser and data else (None, {})
    except Exception:  # a file of any shape must keep its row  # noqa: BLE001
        return None, {}
