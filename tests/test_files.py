import io
import json
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.operators import search
from quarry.sources import files, parsers

EML = b"From: Ann <ann@x.org>\nTo: bob@x.org\nSubject: Hello\nDate: Tue, 02 Jan 2024 10:00:00 +0100\nMessage-ID: <1@x>\nContent-Type: text/plain\n\nbody words\n"


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE t (a)")
    con.commit()
    content = {
        "a.md": b"---\ntitle: Hi\ntags: [a, b]\ndraft: true\ndate: 2024-01-02\n---\n# Head\nsome words\n",
        "b.csv": b"id,name\n1,2\n",
        "c.json": b' [{"a": 1}]',
        "chat.json": json.dumps([{"ts": "1700000000.1", "user": "u1", "text": "hey"}]).encode(),
        "sub/d.py": b"# c\nimport os\ndef f(x):\n    if x and 1:\n        return os.path\n\nclass K: pass\n",
        "sub/.git/z": b"x",
        "e.html": b'<html lang="en"><title>T</title><p>hi</p></html>',
        "LICENSE": b"Apache License\nVersion 2.0",
        "node_modules/q.js": b"x",
        "package.json": b'{"name": "p", "version": "1.0"}',
        "f.png": b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR\0\0\0\x02\0\0\0\x03\x08",
        "g.txt": b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR\0\0\0\x02\0\0\0\x03\x08",
        "m.eml": EML,
        "h.ipynb": b"broken {",
        "s.db": con.serialize(),
        "t.xml": b"<?xml version='1.0'?><library/>",
        "z.zip": zipped({"in/a.md": "# Inner\nx", "in/b.txt": "y"}),
        "empty.yaml": b"",
    }
    for name, data in content.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(root)


@pytest.fixture(scope="module")
def scanned(spark, tree):
    return files.scan(spark, tree).cache()


def names(df):
    return sorted(r.name for r in df.select("name").collect())


def test_scan_attributes(scanned):
    row = {r.name: r for r in scanned.collect()}
    assert "z" not in row
    assert row["a.md"].title == "Hi" and row["a.md"].word_count == 4 and row["a.md"].draft and row["a.md"].tags == ["a", "b"]
    assert row["b.csv"].csv_columns == ["id", "name"] and row["c.json"].json_kind == "array"
    assert row["d.py"].functions == ["f"] and row["d.py"].max_complexity == 3 and row["d.py"].loc == 5 and row["d.py"].comment_loc == 1
    assert row["e.html"].title == "T" and row["e.html"].language == "en"
    assert row["LICENSE"].license_id == "Apache-2.0" and row["package.json"].package_name == "p"
    assert (row["f.png"].img_width, row["f.png"].img_height) == (2, 3) and row["g.txt"].is_disguised
    assert row["m.eml"].title == "Hello" and row["m.eml"].email_to == ["bob@x.org"] and row["m.eml"].sent_at.hour == 9
    assert row["s.db"].sqlite_table_names == ["t"] and row["t.xml"].root_element == "library"
    assert row["chat.json"].content_type == "chat/slack-export" and row["chat.json"].chat_message_count == 1
    assert row["h.ipynb"].content_type == "notebook/jupyter" and row["h.ipynb"].cell_count is None


def test_every_file_matches_true(scanned):
    assert search.where(scanned, "true").count() == scanned.count() == 17


def test_search_over_scan(scanned):
    assert names(search.where(scanned, 'is_markdown && draft && "a" in tags && frontmatter.title == "Hi"')) == ["a.md"]
    assert names(search.preset(scanned, "suspicious_files")) == ["g.txt"]
    assert names(search.where(scanned, "is_image && img_width < 3")) == ["f.png"]


def test_excludes(spark, tree):
    walked = files.walk(spark, tree)
    assert "q.js" not in names(files.exclude(walked, ["node_*"]))
    assert "z" not in names(walked) and "z" in names(files.walk(spark, tree, git_dir=True))
    assert "q.js" not in names(files.walk(spark, tree, exclude_globs=["node_*"]))
    assert "q.js" not in names(files.without_artefacts(walked))
    kept = names(files.gitignore(walked, "*.html\n/sub/\n*.json\n!package.json\n"))
    assert "e.html" not in kept and "d.py" not in kept and "c.json" not in kept and "package.json" in kept
    assert [r.project_type for r in files.projects(walked).collect()] == ["node"]


def test_archive_entries(spark, tree):
    entries = files.archive_entries(files.detected(files.walk(spark, tree)))
    found = {r.path.rsplit("#")[1]: r for r in files.attributes(files.detected(entries)).collect()}
    assert found["in/a.md"].title == "Inner" and set(found) == {"in/a.md", "in/b.txt"}
    one = files.read_entry(files.detected(files.walk(spark, tree)), f"{tree}/z.zip", "in/b.txt").collect()
    assert [bytes(r.content) for r in one] == [b"y"]


def test_cache_parses_once(spark, tree, tmp_path):
    walked = files.detected(files.exclude(files.walk(spark, tree), []))
    folder = str(tmp_path / "cache")
    first = files.cached(walked, folder)
    n = first.count()
    files.cached(walked, folder)
    assert spark.read.parquet(folder).count() == n == 17
    assert files.cache_stats(spark, folder).agg(F.sum("entries")).first()[0] == 17


@pytest.mark.parametrize("kind", ["markdown", "csv", "yaml", "email/rfc822", "epub", "pdf", "system/plist", "database/sqlite", "office/docx", "archive/zip", "notebook/jupyter", "manifest/node", "image/png", "audio/wav", "binary/elf", "bytecode/jvm", "science/fits", "model3d/stl", "font/ttf", "chat/slack-export", "browser/bookmarks-chromium", "install/rpm", "disk-image/qcow2", "source/python", "source/go"])
@pytest.mark.parametrize("data", [b"", b"\x00\x01broken", b"PK\x03\x04xx"])
def test_malformed_files_keep_their_row(kind, data):
    body, attrs = parsers.parse(kind, "x.bin", data)
    assert isinstance(attrs, dict) and set(attrs) <= set(parsers.ATTRIBUTES)


def test_ignore_classes_and_pruned_walk(spark, tmp_path):
    for name in ("a1.txt", "a2.txt", "ab.txt", "p/package.json", "p/node_modules/x/y.js", "p/dist/z.js", "q/dist/z.js"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("{}")
    walked = files.walk(spark, str(tmp_path))
    assert names(files.gitignore(walked, "a[0-9].txt\n*.js\n")) == ["ab.txt", "package.json"]
    assert names(files.gitignore(walked, "a[!0-9].txt\n*.js*\n")) == ["a1.txt", "a2.txt"]
    assert [r.path[len(str(tmp_path)) :] for r in files.walk(spark, str(tmp_path), prune_artefacts=True).where("name like '%.js'").collect()] == ["/q/dist/z.js"]


def box(kind, *parts):
    body = b"".join(parts)
    return (len(body) + 8).to_bytes(4, "big") + kind + body


def test_video_headers():
    word = lambda *x: b"".join(n.to_bytes(4, "big") for n in x)
    track = lambda handler, codec, w, h: box(b"trak", box(b"tkhd", b"\0" * 76, word(w << 16, h << 16)), box(b"mdia", box(b"hdlr", b"\0" * 8, handler, b"\0" * 12), box(b"minf", box(b"stbl", box(b"stsd", word(0, 1, 16), codec)))))
    data = box(b"ftyp", b"isom") + box(b"moov", box(b"mvhd", word(0, 0, 0, 1000, 2500)), track(b"vide", b"avc1", 640, 480), track(b"soun", b"mp4a", 0, 0))
    assert parsers.parse("video/mp4", "a.mp4", data)[1] == {"duration": 2.5, "video_width": 640, "video_height": 480, "video_codec": "avc1", "audio_codec": "mp4a"}
    assert parsers.parse("video/mp4", "a.mp4", data[:60])[1] is not None


def png(pixels):
    import struct
    import zlib

    import numpy as np

    h, w = pixels.shape[:2]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows, above = [], np.zeros((w, 3), np.int64)
    for y in range(h):
        line = pixels[y].astype(np.int64)
        left, corner = np.vstack([np.zeros((1, 3), np.int64), line[:-1]]), np.vstack([np.zeros((1, 3), np.int64), above[:-1]])
        guess = left + above - corner
        by = np.stack([abs(guess - left), abs(guess - above), abs(guess - corner)])
        paeth = np.take_along_axis(np.stack([left, above, corner]), by.argmin(0)[None], 0)[0]
        sub = {0: 0, 1: left, 2: above, 3: (left + above) // 2, 4: paeth}[y % 5]
        rows.append(bytes([y % 5]) + ((line - sub) % 256).astype(np.uint8).tobytes())
        above = line
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")


def test_perceptual_hashes(spark):
    import numpy as np

    from quarry.sources import images

    rng = np.random.default_rng(1)
    field = lambda: np.stack([np.kron(rng.integers(0, 256, (9, 12)), np.ones((10, 10)))] * 3, 2).astype(np.uint8)
    scene, other = field(), field()
    assert np.array_equal(images.grey(png(scene)), scene @ np.array([0.299, 0.587, 0.114]))
    noisy = (scene.astype(int) + rng.integers(-8, 9, scene.shape)).clip(0, 255).astype(np.uint8)
    bits = lambda d: int(images.phash(d), 16)
    apart = lambda a, b: (bits(a) ^ bits(b)).bit_count()
    ppm = lambda p: b"P6\n%d %d\n255\n" % (p.shape[1], p.shape[0]) + p.tobytes()
    assert bits(png(scene)) == bits(ppm(scene)) and apart(png(scene), png(noisy)) <= 6 and apart(png(scene), ppm(scene[::2, ::2])) <= 6 and apart(png(scene), png(other)) > 12
    assert images.phash(b"") is None and images.phash(png(scene)[:80]) is None and images.phash(ppm(scene[:1, :1])) is not None
    rows = spark.createDataFrame([("a.png", bytearray(png(scene))), ("b.txt", bytearray(b"x")), ("c.png", bytearray(b"\x89PNG\r\n\x1a\nbroken"))], "name string, content binary")
    got = {r.name: r.phash for r in images.with_phash(files.detected(rows)).collect()}
    assert got["a.png"] == images.phash(png(scene)) and got["b.txt"] is None and got["c.png"] is None
    near = search.where(images.with_phash(files.detected(rows)), f'image_similar_to("{got["a.png"]}", 0.9)')
    assert names(near) == ["a.png"]


def tiff(entries, exif, gps):
    """A little-endian TIFF block: each entry is (tag, kind, count, value or bytes)."""
    import struct

    def folder(rows, at):
        body, extra, end = struct.pack("<H", len(rows)), b"", at + 2 + 12 * len(rows) + 4
        for tag, kind, n, value in rows:
            if isinstance(value, bytes):
                body += struct.pack("<HHI", tag, kind, n) + (value.ljust(4, b"\0") if len(value) <= 4 else struct.pack("<I", end + len(extra)))
                extra += value if len(value) > 4 else b""
            else:
                body += struct.pack("<HHI", tag, kind, n) + (struct.pack("<HH", value, 0) if kind == 3 else struct.pack("<I", value))
        return body + b"\0" * 4 + extra

    size = lambda rows: len(folder(rows, 0))
    main = [*entries, (0x8769, 4, 1, 0), (0x8825, 4, 1, 0)]
    first = 8 + size(main)
    main[-2:] = [(0x8769, 4, 1, first), (0x8825, 4, 1, first + size(exif))]
    return b"II*\0\x08\0\0\0" + folder(main, 8) + folder(exif, first) + folder(gps, first + size(exif))


def test_camera_attributes():
    import struct

    ratio = lambda *x: b"".join(struct.pack("<II", a, b) for a, b in x)
    block = tiff(
        [(0x010F, 2, 6, b"Canon\0"), (0x0110, 2, 3, b"R5\0"), (0x0112, 3, 1, 6)],
        [(0x829A, 5, 1, ratio((1, 250))), (0x829D, 5, 1, ratio((28, 10))), (0x8827, 3, 1, 400), (0x9003, 2, 20, b"2024:05:06 07:08:09\0"), (0x920A, 5, 1, ratio((50, 1))), (0xA434, 2, 6, b"RF 50\0")],
        [(1, 2, 2, b"S\0"), (2, 5, 3, ratio((33, 1), (30, 1), (0, 1))), (3, 2, 2, b"E\0"), (4, 5, 3, ratio((18, 1), (15, 1), (36, 1)))],
    )
    photo = b"\xff\xd8\xff\xe1" + (len(block) + 8).to_bytes(2, "big") + b"Exif\0\0" + block + b"\xff\xc0\0\x11\x08\0\x03\0\x02" + b"\0" * 12
    for kind, data in (("image/jpeg", photo), ("image/raw-cr2", block)):
        got = parsers.parse(kind, "x", data)[1]
        assert (got["camera_make"], got["camera_model"], got["lens"], got["orientation"], got["iso"], got["f_stop"], got["exposure_time"], got["focal_length"]) == ("Canon", "R5", "RF 50", 6, 400, 2.8, 0.004, 50.0)
        assert got["taken_at"].isoformat() == "2024-05-06T07:08:09" and (got["gps_lat"], round(got["gps_lon"], 6)) == (-33.5, 18.26)
    assert parsers.parse("image/jpeg", "x", photo)[1]["img_width"] == 2
    for n in range(0, len(photo), 7):
        assert isinstance(parsers.parse("image/jpeg", "x", photo[:n])[1], dict)


def test_sound_tags():
    frame = lambda name, text: name + len(text).to_bytes(4, "big") + b"\0\0" + text
    body = frame(b"TIT2", b"\x03Song") + frame(b"TPE1", b"\x01" + "Bänd".encode("utf-16")) + frame(b"TYER", b"\x001999") + frame(b"TRCK", b"\x003/12")
    data = b"ID3\x03\0\0" + bytes([0, 0, len(body) >> 7, len(body) & 127]) + body + b"\xff\xfb\x90\x00" + b"\0" * 16_000
    got = parsers.parse("audio/mpeg", "a.mp3", data)[1]
    assert (got["title"], got["artist"], got["year"], got["track"], got["bitrate"], got["sample_rate"], got["channels"], round(got["duration"])) == ("Song", "Bänd", 1999, 3, 128_000, 44_100, 2, 1)
    field = lambda x: len(x).to_bytes(4, "little") + x
    notes = field(b"v") + (2).to_bytes(4, "little") + field("TITLE=Übung".encode()) + field(b"DATE=2001-02-03")
    stream = (44_100 << 44 | 1 << 41 | 15 << 36 | 88_200).to_bytes(8, "big")
    flac = b"fLaC\0\0\0\x22" + b"\0" * 10 + stream + b"\0" * 16 + b"\x84" + len(notes).to_bytes(3, "big") + notes
    got = parsers.parse("audio/flac", "a.flac", flac)[1]
    assert (got["title"], got["year"], got["duration"], got["channels"], got["bit_depth"]) == ("Übung", 2001, 2.0, 2, 16)


def test_pdf_words():
    import zlib

    shown = b"BT /F1 12 Tf 72 700 Td (Hello \\(big\\)) Tj 0 -14 Td [(W) -20 (orld) -300 (again)] TJ T* <48692021> Tj ET"
    packed = zlib.compress(b"BT (deflated words) Tj ET")
    data = b"%PDF-1.4\n1 0 obj <</Type /Page /Title (T)>> endobj\n2 0 obj <</Length 9>>\nstream\n" + shown + b"\nendstream endobj\n3 0 obj <</Filter /FlateDecode>>\nstream\n" + packed + b"\nendstream endobj\n"
    body, attrs = parsers.parse("pdf", "a.pdf", data)
    assert body == "Hello (big)\nWorld again\nHi !\ndeflated words" and attrs["title"] == "T" and attrs["page_count"] == 1


def test_parsed_rows_are_held_a_slice_at_a_time():
    """Of a batch of 5,000 mails, wide rows come 1,024 at a time, all and in order; large contents alone."""
    import pandas as pd

    contents = [f"Subject: s{i}\n\nx".encode() for i in range(5000)]
    contents[7], contents[9] = b"Subject: s7\n\n" + b"y" * (9 << 20), None
    pdf = pd.DataFrame({"content_type": "email/rfc822", "name": "a.eml", "content": contents}, index=range(3, 5003))
    found = list(files._parse(iter([pdf])))
    assert [len(x) for x in found][:3] == [7, 1, 1024] and max(map(len, found)) <= 1024
    assert [t for x in found for t in x["title"]] == [None if i == 9 else f"s{i}" for i in range(5000)]
    assert list(files._parse(iter([pdf[:0]]))) == []
