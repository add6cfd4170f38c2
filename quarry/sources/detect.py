"""Content types by name, ending, JSON shape and magic bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Content types and the endings that tell them.
SUFFIXES = {
    "archive/zip": ["zip", "jar", "war", "ear"],
    "archive/tar": ["tar"],
    "archive/tar+gzip": ["tar.gz", "tgz"],
    "archive/gzip": ["gz"],
    "audio/mpeg": ["mp3"],
    "audio/mp4": ["m4a", "m4b", "m4p", "aac"],
    "audio/flac": ["flac"],
    "audio/ogg": ["ogg", "oga", "opus"],
    "audio/wav": ["wav", "wave"],
    "binary/elf": ["elf", "so", "o"],
    "binary/mach-o": ["dylib", "bundle"],
    "binary/pe": ["exe", "dll", "sys"],
    "bytecode/jvm": ["class"],
    "bytecode/python": ["pyc", "pyo"],
    "bytecode/wasm": ["wasm"],
    "csv": ["csv", "tsv"],
    "database/sqlite": ["db", "sqlite", "sqlite3", "db3"],
    "database/sqlite-shm": ["db-shm", "sqlite-shm", "sqlite3-shm"],
    "database/sqlite-wal": ["db-wal", "sqlite-wal", "sqlite3-wal"],
    "disk-image/dmg": ["dmg"],
    "disk-image/iso9660": ["iso"],
    "disk-image/vhd": ["vhd"],
    "disk-image/vhdx": ["vhdx"],
    "disk-image/vmdk": ["vmdk"],
    "disk-image/qcow2": ["qcow2", "qcow"],
    "disk-image/wim": ["wim"],
    "office/docx": ["docx"],
    "office/odt": ["odt"],
    "office/pptx": ["pptx"],
    "office/xlsx": ["xlsx"],
    "email/rfc822": ["eml", "email"],
    "email/mbox": ["mbox"],
    "epub": ["epub"],
    "font/collection": ["ttc", "otc"],
    "font/otf": ["otf"],
    "font/ttf": ["ttf"],
    "font/woff": ["woff"],
    "font/woff2": ["woff2"],
    "html": ["html", "htm", "xhtml"],
    "image/raw-cr2": ["cr2"],
    "image/raw-cr3": ["cr3"],
    "image/raw-nef": ["nef", "nrw"],
    "image/raw-arw": ["arw", "srf", "sr2"],
    "image/raw-dng": ["dng"],
    "image/raw-raf": ["raf"],
    "image/raw-orf": ["orf", "ori"],
    "image/raw-rw2": ["rw2", "raw"],
    "image/jpeg": ["jpg", "jpeg"],
    "image/png": ["png"],
    "image/gif": ["gif"],
    "image/webp": ["webp"],
    "image/svg+xml": ["svg", "svgz"],
    "image/tiff": ["tif", "tiff"],
    "image/bmp": ["bmp"],
    "image/heic": ["heic", "heif"],
    "install/pkg": ["pkg"],
    "install/deb": ["deb"],
    "install/rpm": ["rpm"],
    "install/appimage": ["appimage"],
    "json": ["json", "jsonl", "geojson"],
    "markdown": ["md", "markdown", "mdown", "mkd"],
    "model3d/stl": ["stl"],
    "model3d/obj": ["obj"],
    "model3d/gltf": ["gltf", "glb"],
    "notebook/jupyter": ["ipynb"],
    "notebook/zeppelin": ["zpln"],
    "pdf": ["pdf"],
    "system/plist": ["plist"],
    "science/cdf": ["cdf"],
    "science/hdf5": ["h5", "hdf5", "hdf", "he5"],
    "science/pds3": ["lbl"],
    "science/pds4": ["lblx"],
    "science/votable": ["vot", "votable"],
    "science/fits": ["fits", "fit", "fts"],
    "text": ["txt", "text", "log"],
    "toml": ["toml"],
    "video/mp4": ["mp4", "m4v"],
    "video/quicktime": ["mov", "qt"],
    "video/x-matroska": ["mkv"],
    "video/webm": ["webm"],
    "video/x-msvideo": ["avi"],
    "xml": ["xml", "xsl", "xslt", "xsd", "rss", "atom"],
    "yaml": ["yaml", "yml"],
}
# Source languages and their endings.
LANGUAGES = {
    "go": ["go"],
    "javascript": ["js", "mjs", "cjs", "jsx"],
    "typescript": ["ts", "tsx"],
    "rust": ["rs"],
    "c": ["c", "h"],
    "cpp": ["cpp", "cc", "cxx", "hpp", "hh", "hxx"],
    "java": ["java"],
    "swift": ["swift"],
    "kotlin": ["kt", "kts"],
    "scala": ["scala", "sc"],
    "zig": ["zig"],
    "python": ["py", "pyi"],
    "shell": ["sh", "bash", "zsh"],
    "elixir": ["ex", "exs"],
    "ruby": ["rb"],
    "lua": ["lua"],
    "haskell": ["hs"],
    "ocaml": ["ml", "mli"],
    "clojure": ["clj", "cljs", "cljc", "edn"],
    "csharp": ["cs"],
    "php": ["php", "phtml", "php3", "php4", "php5", "php7", "phps"],
    "perl": ["pl", "pm", "t"],
    "r": ["r"],
    "ada": ["adb", "ads"],
    "sql": ["sql"],
    "vb": ["vb", "bas", "vbs", "cls", "frm"],
    "fortran": ["f", "f90", "f95", "f03", "f08", "for", "ftn", "fpp"],
    "matlab": ["m"],
    "assembly": ["asm", "s", "nasm"],
    "pascal": ["pas", "pp", "dpr", "lpr"],
}
# Content types told by the whole file name.
NAMES = {
    "browser/bookmarks-chromium": ["Bookmarks"],
    "browser/bookmarks-safari": ["Bookmarks.plist"],
    "build/dockerfile": ["Dockerfile", "Containerfile"],
    "build/makefile": ["Makefile", "GNUmakefile", "BSDmakefile", "makefile"],
    "build/justfile": ["Justfile", "justfile"],
    "build/rakefile": ["Rakefile"],
    "ignore/git": [".gitignore", ".gitattributes"],
    "ignore/docker": [".dockerignore"],
    "manifest/gomod": ["go.mod", "go.sum"],
    "manifest/node": ["package.json", "package-lock.json"],
    "manifest/cargo": ["Cargo.toml", "Cargo.lock"],
    "manifest/pipfile": ["Pipfile", "Pipfile.lock"],
    "manifest/python-reqs": ["requirements.txt"],
    "manifest/gemfile": ["Gemfile", "Gemfile.lock"],
    "platform/procfile": ["Procfile"],
    "platform/vagrant": ["Vagrantfile"],
    "repo/license": ["LICENSE", "LICENCE", "COPYING", "UNLICENSE"],
    "repo/changelog": ["CHANGELOG", "HISTORY"],
    "repo/contributing": ["CONTRIBUTING"],
    "repo/codeowners": ["CODEOWNERS", "OWNERS"],
    "system/macos-ds-store": [".DS_Store"],
    "system/macos-localized": [".localized"],
    "system/windows-thumbs-db": ["Thumbs.db", "ehthumbs.db", "ehthumbs_vista.db"],
    "system/windows-desktop-ini": ["Desktop.ini"],
    "system/linux-directory": [".directory"],
}
# Content types told by their first bytes (hexadecimal, at an offset).
MAGIC = [
    ("pdf", 0, "255044462D"),
    ("image/png", 0, "89504E470D0A1A0A"),
    ("image/jpeg", 0, "FFD8FF"),
    ("image/gif", 0, "47494638"),
    ("image/bmp", 0, "424D"),
    ("image/tiff", 0, "49492A00"),
    ("image/tiff", 0, "4D4D002A"),
    ("audio/flac", 0, "664C6143"),
    ("audio/ogg", 0, "4F676753"),
    ("audio/mpeg", 0, "494433"),
    ("binary/elf", 0, "7F454C46"),
    ("binary/pe", 0, "4D5A"),
    ("binary/mach-o", 0, "CFFAEDFE"),
    ("binary/mach-o", 0, "CEFAEDFE"),
    ("bytecode/jvm", 0, "CAFEBABE"),
    ("bytecode/wasm", 0, "0061736D"),
    ("database/sqlite", 0, "53514C69746520666F726D6174203300"),
    ("archive/zip", 0, "504B0304"),
    ("archive/gzip", 0, "1F8B"),
    ("archive/tar", 257, "7573746172"),
    ("install/deb", 0, "213C617263683E0A"),
    ("install/rpm", 0, "EDABEEDB"),
    ("font/woff", 0, "774F4646"),
    ("font/woff2", 0, "774F4632"),
    ("font/otf", 0, "4F54544F"),
    ("font/collection", 0, "74746366"),
    ("font/ttf", 0, "0001000000"),
    ("science/hdf5", 0, "894844460D0A1A0A"),
    ("science/fits", 0, "53494D504C4520203D"),
    ("disk-image/qcow2", 0, "514649FB"),
    ("disk-image/vhdx", 0, "7668647866696C65"),
    ("disk-image/wim", 0, "4D5357494D000000"),
    ("video/x-matroska", 0, "1A45DFA3"),
    ("video/mp4", 4, "66747970"),
]
BY_SUFFIX = {e: kind for kind, ends in SUFFIXES.items() for e in ends} | {e: f"source/{kind}" for kind, ends in LANGUAGES.items() for e in ends}
BY_NAME = {n: kind for kind, names in NAMES.items() for n in names}


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def by_name(name: Column) -> Column:
    """The content type that a file name tells: whole name, then the longest ending; null if none."""
    low = F.lower(name)
    two, one = F.regexp_extract(low, r"\.([^.]+\.[^.]+)$", 1), F.regexp_extract(low, r"\.([^.]+)$", 1)
    ends = _map(BY_SUFFIX)
    return F.coalesce(F.try_element_at(_map(BY_NAME), name), F.try_element_at(ends, two), F.try_element_at(ends, one))


def by_magic(head: Column) -> Column:
    """The content type of a file's first 512 bytes; null if unknown.  RIFF files are told by their inner name."""
    out = F.when((F.substring(head, 1, 4) == F.unhex(F.lit("52494646"))) & (F.substring(head, 9, 4) == F.unhex(F.lit("57454250"))), "image/webp")
    out = out.when((F.substring(head, 1, 4) == F.unhex(F.lit("52494646"))) & (F.substring(head, 9, 4) == F.unhex(F.lit("57415645"))), "audio/wav")
    out = out.when((F.substring(head, 1, 4) == F.unhex(F.lit("52494646"))) & (F.substring(head, 9, 4) == F.unhex(F.lit("41564920"))), "video/x-msvideo")
    for kind, at, magic in MAGIC:
        out = out.when(F.substring(head, at + 1, len(magic) // 2) == F.unhex(F.lit(magic)), kind)
    return out


def json_shape(head: Column) -> Column:
    """Which chat export a JSON file's first bytes look like; null if none."""
    return (
        F.when(head.rlike(r'"guild"\s*:') & head.rlike(r'"channel"\s*:'), "chat/discord-export")
        .when(head.rlike(r'"envelope"\s*:') & head.rlike(r'"(dataMessage|syncMessage)"'), "chat/signal-cli")
        .when(head.rlike(r'"ts"\s*:\s*"[0-9]{9,}\.[0-9]+"') & head.rlike(r'"user"\s*:'), "chat/slack-export")
    )


def content_type(name: Column, content: Column) -> Column:
    """Name, then ending (a .json by its shape), then magic bytes; '' if nothing tells."""
    named = by_name(name)
    shape = F.when((named == "json") & F.lower(name).endswith(".json"), json_shape(F.decode(F.substring(content, 1, 65536), "ISO-8859-1")))
    return F.coalesce(shape, named, by_magic(F.substring(content, 1, 512)), F.lit(""))
