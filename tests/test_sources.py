import gzip
import io
import struct
import tarfile
import zipfile
import zlib

import pytest

from webloom.sources import formats as f
from webloom.sources.html import main_content, parse_page, read_pages


def test_page():
    page = parse_page(
        "https://h.test/dir/page",
        '<html lang="DE"><head><title> A  title </title><link rel="canonical" href="/c"><meta name="author" content="Ann"><meta itemprop="datePublished" content="2024-01-02">'
        '<script type="application/ld+json">{"@graph": [{"datePublished": "2024-05-06"}]}</script></head><body><h1>Head</h1><p>Text <a href="x?y#z" rel="nofollow">one</a> '
        '<a href="//other.test/">two</a><a href="mailto:a@b.c">no</a></p><style>hidden</style><img src="i.png" alt="pic"></body></html>',
    )
    assert page["title"] == "A title" and page["language"] == "de" and page["canonical"] == "https://h.test/c" and page["author"] == "Ann"
    assert page["links"] == ["https://h.test/dir/x?y", "https://other.test/"] and page["local_links"] == 1
    assert page["anchors"][0] == {"url": "https://h.test/dir/x?y", "text": "one", "nofollow": True}
    assert page["text"] == "Head\nText one twono" and page["headings"] == ["Head"]
    assert (page["published"], page["date_confidence"]) == ("2024-05-06", 1.0)
    assert page["images"] == [{"url": "https://h.test/dir/i.png", "alt": "pic"}]


@pytest.mark.parametrize("body", ["", None, "<", "<a href=", "<script>x", "</p></p>", "<title>"])
def test_broken_pages(body):
    assert parse_page("http://h.test/", body)["links"] == []


def test_read_pages(spark):
    rows = read_pages(spark.createDataFrame([("http://h.test/", "<title>T</title>"), (None, None)], "url string, html string")).collect()
    assert sorted((r.title or "") for r in rows) == ["", "T"]
    kept = spark.createDataFrame([("Menu\nA whole sentence stands here.",), ("Menu",)], "t string").select(main_content(__import__("pyspark").sql.functions.col("t")).alias("x")).collect()
    assert [r.x for r in kept] == ["A whole sentence stands here.", "Menu"]


def _zip(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def _tar(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def _pdf(text):
    stream = zlib.compress(f"BT /F1 12 Tf ({text}) Tj [(sec) -20 (ond)] TJ ET".encode())
    return b"%PDF-1.4\n1 0 obj<</Title (My title)>>endobj\nstream\n" + stream + b"\nendstream"


def _png(text):
    data = b"Title\0" + text
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", len(data)) + b"tEXt" + data + b"\0\0\0\0"


DOCX = _zip({"word/document.xml": '<w:document xmlns:w="w"><w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>world</w:t></w:r></w:p></w:document>', "docProps/core.xml": '<c xmlns:dc="d"><dc:title>Doc</dc:title></c>'})
ID3 = b"ID3\x03\0\0" + bytes([0, 0, 0, 15]) + b"TIT2" + struct.pack(">I", 5) + b"\0\0" + b"\0Song"


@pytest.mark.parametrize(
    "name,body,title,text",
    [
        ("a.txt", "Grüße".encode("cp1252"), None, "Grüße"),
        ("a.md", b"# Top\n\nSome *bold* [link](http://x)", "Top", "Top"),
        ("a.tex", rb"\title{T}\begin{document}Hello \textbf{you}% note", "T", "Hello"),
        ("a.rtf", rb"{\rtf1{\fonttbl{\f0 Arial;}}Caf\'e9\par end}", None, "Café"),
        ("a.html", b"<title>T</title><body><p>Hi</p>", "T", "Hi"),
        ("a.rss", b"<rss><channel><title>Feed</title><item><title>One</title></item></channel></rss>", "Feed", "One"),
        ("a.docx", DOCX, "Doc", "Hello world"),
        ("a.pdf", _pdf("First"), "My title", "First second"),
        ("a.svg", b'<svg xmlns="s"><title>Pic</title><text>label</text></svg>', "Pic", "label"),
        ("a.png", _png(b"Shot"), "Shot", "Title: Shot"),
        ("a.mp3", ID3, "Song", "Song"),
        ("a.vcf", b"BEGIN:VCARD\nFN:Ann Lee\nORG:Web;Lab\nEND:VCARD", "Ann Lee", "Web Lab"),
        ("a.torrent", b"d4:infod4:name3:abc5:filesld4:pathl1:x1:yeeeee", "abc", "x/y"),
        ("a.zip", _zip({"in.txt": "inside", "deep.zip": _zip({"d.md": "# deep"})}), None, "inside"),
        ("a.tar", _tar({"t.txt": b"tarred"}), None, "tarred"),
        ("a.gz", gzip.compress(_tar({"t.txt": b"both"})), None, "both"),
    ],
)
def test_formats(name, body, title, text):
    got_title, got = f.parser_of(name, "")(body)
    assert got_title == title and text in got


def test_feeds_and_sitemaps():
    atom = b'<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>E</title><link href="http://h/1"/><updated>2024</updated></entry></feed>'
    assert f.feed_entries(atom) == [{"title": "E", "link": "http://h/1", "date": "2024", "summary": None}]
    assert f.sitemap(b"<urlset><url><loc> http://h/1 </loc></url><url><loc>http://h/2</loc></url></urlset>", 1) == (["http://h/1"], True)
    assert f.sitemap(b"http://h/1\nnot a link\nhttps://h/2") == (["http://h/1", "https://h/2"], False)
    assert f.robots_sitemaps(b"User-agent: *\nSitemap: http://h/s.xml") == ["http://h/s.xml"]
    assert f.parser_of("x.bin", "application/pdf") is f.pdf and f.parser_of("x.bin", "") is None


def test_parse_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain")
    (tmp_path / "b.docx").write_bytes(b"broken")
    (tmp_path / "c.bin").write_bytes(b"?")
    rows = {r.path.rsplit("/", 1)[1]: r for r in f.parse_files(spark.read.format("binaryFile").load(f"file://{tmp_path}")).collect()}
    assert rows["a.txt"].text == "plain" and rows["b.docx"].error and rows["c.bin"].error == "no parser"
