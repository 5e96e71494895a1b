"""Text of files by format: plain and marked-up text, feeds, office packages, PDF, images, audio, archives.

Each parser takes bytes and gives (title, text). Archives are read member by member to a
bounded depth. parse_files applies the parsers to a binaryFile source in Arrow batches.
"""

from __future__ import annotations

import gzip
import io
import re
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

from webloom.sources.html import parse_page

Parsed = tuple[str | None, str]
MEMBERS, DEPTH, MEMBER_BYTES = 1000, 3, 50_000_000


def _decoded(body: bytes) -> str:
    for encoding in ("utf-8-sig", "utf-16") if body[:2] in (b"\xff\xfe", b"\xfe\xff") else ("utf-8-sig", "cp1252"):
        try:
            return body.decode(encoding)
        except UnicodeDecodeError:
            continue
    return body.decode("utf-8", "replace")


def plain(body: bytes) -> Parsed:
    return None, _decoded(body).strip()


def markdown(body: bytes) -> Parsed:
    text = _decoded(body)
    title = re.search(r"^#\s+(.+)$", text, re.M)
    text = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", text)
    text = re.sub(r"^[#>\s]*[-*+]?\s*|[*_`]{1,3}", lambda m: "" if m.group().strip() else m.group(), text, flags=re.M)
    return title.group(1) if title else None, text.strip()


def tex(body: bytes) -> Parsed:
    text = re.sub(r"(?<!\\)%.*", "", _decoded(body))
    title = re.search(r"\\title\{([^}]*)\}", text)
    text = re.sub(r"\\(?:begin|end|documentclass|usepackage)(?:\[[^\]]*\])?\{[^}]*\}", " ", text)
    text = re.sub(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?", " ", text)
    return title.group(1) if title else None, " ".join(re.sub(r"[{}$&~]", " ", text).split())


def rtf(body: bytes) -> Parsed:
    text = body.decode("latin-1")
    text = re.sub(r"\{\\(?:fonttbl|colortbl|stylesheet|info|\*)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", text)
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes([int(m.group(1), 16)]).decode("cp1252", "replace"), text)
    text = re.sub(r"\\u(-?\d+)\??", lambda m: chr(int(m.group(1)) % 65536), text)
    text = re.sub(r"\\(?:par|line)\b ?", "\n", text)
    return None, re.sub(r"\\[a-z]+-?\d* ?|[{}]", "", text).strip()


def html(body: bytes) -> Parsed:
    page = parse_page("", _decoded(body))
    return page["title"], page["text"]


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower()


def feed(body: bytes) -> Parsed:
    """RSS, Atom or any XML: the first title, and the text of its elements."""
    root = ElementTree.fromstring(body)
    titles = [" ".join("".join(e.itertext()).split()) for e in root.iter() if _local(e.tag) == "title"]
    texts = [" ".join(t.split()) for e in root.iter() for t in (e.text or "",) if t and t.strip()]
    return titles[0] if titles else None, "\n".join(re.sub(r"<[^>]+>", " ", t) for t in texts)


def feed_entries(body: bytes) -> list[dict]:
    """title, link, date and summary of each entry of an RSS or Atom feed."""
    out = []
    for item in ElementTree.fromstring(body).iter():
        if _local(item.tag) not in ("item", "entry"):
            continue
        found = {_local(e.tag): e for e in item}
        text = lambda *names: next((" ".join("".join(found[n].itertext()).split()) for n in names if n in found and "".join(found[n].itertext()).strip()), None)
        link = text("link") or (found["link"].get("href") if "link" in found else None)
        out.append({"title": text("title"), "link": link, "date": text("pubdate", "published", "updated", "date"), "summary": text("description", "summary", "content")})
    return out


def sitemap(body: bytes, most: int = 50_000) -> tuple[list[str], bool]:
    """Addresses of a urlset, a sitemap index or a plain list, and whether the list was cut."""
    text = _decoded(body).strip()
    if text.startswith("<"):
        urls = [e.text.strip() for e in ElementTree.fromstring(text.encode()).iter() if _local(e.tag) == "loc" and e.text and e.text.strip()]
    else:
        urls = [line.strip() for line in text.splitlines() if re.match(r"https?://", line.strip())]
    return urls[:most], len(urls) > most


def robots_sitemaps(body: bytes) -> list[str]:
    return re.findall(r"(?im)^\s*sitemap:\s*(\S+)", _decoded(body))


_OFFICE = re.compile(r"^(?:word/document|word/(?:header|footer|footnotes)\d*|xl/sharedStrings|ppt/slides/slide\d+|ppt/notesSlides/notesSlide\d+|content|docProps/core|meta)\.xml$")


def package(body: bytes) -> Parsed:
    """Office packages: paragraphs of the known XML parts, the title of the core properties."""
    title, out = None, []
    with zipfile.ZipFile(io.BytesIO(body)) as parts:
        names = sorted((n for n in parts.namelist() if _OFFICE.match(n)), key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)])
        for name in names:
            root = ElementTree.fromstring(parts.read(name))
            if name in ("docProps/core.xml", "meta.xml"):
                title = title or next((e.text for e in root.iter() if _local(e.tag) == "title" and e.text), None)
                continue
            for paragraph in (e for e in root.iter() if _local(e.tag) in ("p", "h", "si")):
                line = "".join(e.text or "" for e in paragraph.iter() if _local(e.tag) in ("t", "p", "h", "span") and e.text)
                if line.strip():
                    out.append(line.strip())
    return title, "\n".join(out)


def pdf(body: bytes) -> Parsed:
    """Strings that are shown on pages, of plain and Flate streams."""
    out = []
    for stream in re.findall(rb"stream\r?\n(.*?)\r?\nendstream", body, re.S):
        try:
            stream = zlib.decompress(stream)
        except zlib.error:
            pass
        if b"BT" not in stream:
            continue
        for shown in re.findall(rb"\[((?:[^\]\\]|\\.)*)\]\s*TJ|(\((?:[^()\\]|\\.)*\))\s*(?:Tj|'|\")", stream, re.S):
            parts = re.findall(rb"\(((?:[^()\\]|\\.)*)\)|<([0-9A-Fa-f]+)>", shown[0] or shown[1])
            text = b"".join(re.sub(rb"\\([nrt()\\])", lambda m: {b"n": b"\n", b"r": b"\r", b"t": b"\t"}.get(m.group(1), m.group(1)), p) if p else bytes.fromhex(h.decode() + "0" * (len(h) % 2)) for p, h in parts)
            out.append(text.decode("utf-16-be", "replace") if text[:2] == b"\xfe\xff" else text.decode("cp1252", "replace"))
    title = re.search(rb"/Title\s*\(((?:[^()\\]|\\.)*)\)", body)
    return title.group(1).decode("cp1252", "replace") if title else None, " ".join(" ".join(out).split())


def svg(body: bytes) -> Parsed:
    root = ElementTree.fromstring(body)
    texts = [" ".join("".join(e.itertext()).split()) for e in root.iter() if _local(e.tag) in ("text", "desc")]
    return next((e.text for e in root.iter() if _local(e.tag) == "title"), None), "\n".join(t for t in texts if t)


def png(body: bytes) -> Parsed:
    """Text chunks of a PNG image."""
    found, at = {}, 8
    while at + 8 <= len(body):
        size, kind = int.from_bytes(body[at : at + 4], "big"), body[at + 4 : at + 8]
        data = body[at + 8 : at + 8 + size]
        if kind == b"tEXt" and b"\0" in data:
            key, value = data.split(b"\0", 1)
            found[key.decode("latin-1")] = value.decode("latin-1")
        at += 12 + size
    return found.get("Title"), "\n".join(f"{k}: {v}" for k, v in sorted(found.items()))


def mp3(body: bytes) -> Parsed:
    """ID3 tags of either version."""
    tags: dict[str, str] = {}
    if body[:3] == b"ID3":
        size = sum((b & 127) << s for b, s in zip(body[6:10], (21, 14, 7, 0)))
        at = 10
        while at + 10 <= 10 + size and body[at : at + 4].strip(b"\0"):
            n = int.from_bytes(body[at + 4 : at + 8], "big")
            data = body[at + 10 : at + 10 + n]
            if body[at : at + 1] == b"T" and data:
                tags[body[at : at + 4].decode("latin-1")] = data[1:].decode("utf-16" if data[0] == 1 else "utf-8" if data[0] == 3 else "latin-1", "replace").strip("\0")
            at += 10 + n
    elif body[-128:-125] == b"TAG":
        for name, begin, end in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93)):
            tags[name] = body[-128:][begin:end].decode("latin-1").strip("\0 ")
    return tags.get("TIT2"), "\n".join(v for _, v in sorted(tags.items()) if v)


def vcard(body: bytes) -> Parsed:
    lines = re.sub(r"\r?\n[ \t]", "", _decoded(body)).splitlines()
    fields = [(line.split(":", 1)[0].split(";")[0].upper(), line.split(":", 1)[1]) for line in lines if ":" in line]
    kept = [(k, v) for k, v in fields if k in ("FN", "ORG", "TITLE", "EMAIL", "TEL", "ADR", "NOTE", "URL")]
    return next((v for k, v in kept if k == "FN"), None), "\n".join(re.sub(r"[;\\]+", " ", v).strip() for _, v in kept)


def bencoded(body: bytes, at: int = 0):
    """A bencoded value and the place behind it."""
    head = body[at : at + 1]
    if head == b"i":
        end = body.index(b"e", at)
        return int(body[at + 1 : end]), end + 1
    if head in (b"l", b"d"):
        out, at = [], at + 1
        while body[at : at + 1] != b"e":
            value, at = bencoded(body, at)
            out.append(value)
        return (dict(zip(out[::2], out[1::2])) if head == b"d" else out), at + 1
    colon = body.index(b":", at)
    size = int(body[at:colon])
    return body[colon + 1 : colon + 1 + size], colon + 1 + size


def torrent(body: bytes) -> Parsed:
    info = bencoded(body)[0].get(b"info", {})
    name = info.get(b"name", b"").decode("utf-8", "replace")
    files = [b"/".join(f[b"path"]).decode("utf-8", "replace") for f in info.get(b"files", [])]
    return name or None, "\n".join([name, *files])


def archive(body: bytes, depth: int = 0) -> Parsed:
    """Members of zip, tar and gzip files, each by its own format."""
    members: list[tuple[str, bytes]] = []
    if body[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(body)) as z:
            members = [(i.filename, z.read(i)) for i in z.infolist()[:MEMBERS] if not i.is_dir() and i.file_size <= MEMBER_BYTES]
    elif body[:2] == b"\x1f\x8b":
        with gzip.GzipFile(fileobj=io.BytesIO(body)) as g:
            inner = g.read(MEMBER_BYTES)
        return archive(inner, depth) if inner[257:262] == b"ustar" else plain(inner)
    elif body[257:262] == b"ustar":
        with tarfile.open(fileobj=io.BytesIO(body)) as t:
            members = [(m.name, t.extractfile(m).read()) for m in t.getmembers()[:MEMBERS] if m.isfile() and m.size <= MEMBER_BYTES]
    texts = []
    for name, data in members:
        parser = parser_of(name, "")
        try:
            texts.append(f"{name}\n" + ((archive(data, depth + 1) if depth < DEPTH else (None, ""))[1] if parser is archive else parser(data)[1] if parser else ""))
        except Exception:  # noqa: BLE001  a broken member does not spoil its archive
            texts.append(name)
    return None, "\n".join(texts)


#: Parsers by extension and by MIME type.
BY_EXTENSION: dict[str, Callable[[bytes], Parsed]] = (
    dict.fromkeys("txt csv log json".split(), plain)
    | dict.fromkeys("md markdown".split(), markdown)
    | dict.fromkeys("html htm xhtml".split(), html)
    | dict.fromkeys("rss atom xml".split(), feed)
    | dict.fromkeys("docx xlsx pptx odt ods odp".split(), package)
    | dict.fromkeys("zip tar gz tgz apk jar".split(), archive)
    | {"tex": tex, "rtf": rtf, "pdf": pdf, "svg": svg, "png": png, "mp3": mp3, "vcf": vcard, "torrent": torrent}
)
BY_TYPE = {
    "text/plain": plain, "text/csv": plain, "text/markdown": markdown, "text/html": html, "application/xhtml+xml": html, "application/rss+xml": feed, "application/atom+xml": feed, "text/xml": feed,
    "application/pdf": pdf, "application/rtf": rtf, "image/svg+xml": svg, "image/png": png, "audio/mpeg": mp3, "text/vcard": vcard, "application/x-bittorrent": torrent, "application/zip": archive,
}


def parser_of(path: str, content_type: str) -> Callable[[bytes], Parsed] | None:
    """The parser of a MIME type, else of an extension."""
    kind = (content_type or "").split(";")[0].strip().lower()
    if kind in BY_TYPE:
        return BY_TYPE[kind]
    return BY_EXTENSION.get(path.rsplit(".", 1)[-1].lower()) if "." in path else None


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, content in zip(batch["path"], batch["content"]):
            parser = parser_of(path, "")
            try:
                title, text = parser(bytes(content)) if parser else (None, None)
                rows.append((path, title, text, None if parser else "no parser"))
            except Exception as e:  # noqa: BLE001  one broken file is one row with an error
                rows.append((path, None, None, type(e).__name__))
        yield pd.DataFrame(rows, columns=["path", "title", "text", "error"])


def parse_files(files: DataFrame) -> DataFrame:
    """path, title, text and error of the files of spark.read.format("binaryFile")."""
    return files.select("path", "content").mapInPandas(_parsed, "path string, title string, text string, error string")
