import pytest
from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.functions import urls as U


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).collect()[0].x


@pytest.mark.parametrize(
    "raw,normal",
    [
        ("https://example.org/p?b=2&a=1", "https://example.org/p?a=1&b=2"),
        ("HTTPS://Example.ORG:443/a//b/./c#top", "https://example.org/a/b/c"),
        ("http://example.org:80", "http://example.org/"),
        ("http://example.org:8080/x/", "http://example.org:8080/x/"),
        ("https://example.org/?utm_source=x&ref=y&gclid=1", "https://example.org/?ref=y"),
        ("https://example.org/?sid=0123456789abcdef0123456789abcdef", "https://example.org/"),
        ("https://example.org/?sid=short", "https://example.org/?sid=short"),
        ("ftp://example.org/x", None),
        ("mailto:a@b.c", None),
        (None, None),
        ("", None),
    ],
)
def test_normalized(spark, raw, normal):
    assert one(spark, U.normalized, raw) == normal


@pytest.mark.parametrize("url,trap", [("http://h.test/a/b/a/b", False), ("http://h.test/a/b/a/b/a/b/a/b", True), ("http://h.test/" + "x" * 2050, True), ("http://h.test/" + "/".join(map(str, range(25))), True), ("nonsense", True)])
def test_traps(spark, url, trap):
    assert one(spark, U.is_trap, url) is trap


@pytest.mark.parametrize("host,site", [("a.b.example.co.uk", "example.co.uk"), ("www.example.org", "example.org"), ("localhost", "localhost"), ("10.0.0.1", "10.0.0.1")])
def test_registrable(spark, host, site):
    assert one(spark, U.registrable, host) == site


@pytest.mark.parametrize("text,script", [("Привет, мир", "cyrillic"), ("hello мир", "latin"), ("123", None), ("", None)])
def test_script(spark, text, script):
    assert one(spark, T.dominant_script, text) == script


def test_snippet_and_highlight(spark):
    assert one(spark, lambda c: T.snippet(c, ["needle"], 40), "x " * 60 + "needle here").startswith("…")
    assert one(spark, lambda c: T.snippet(c, ["none"], 10), "short text") == "short text"
    assert one(spark, lambda c: T.highlight(c, ["foo", "bar"]), "Foobar foo") == "<b>Foobar</b> <b>foo</b>"


@pytest.mark.parametrize("value,most", [("ää", 3), ("abc", 2), ("日本語", 7), ("", 5)])
def test_truncated_bytes(spark, value, most):
    cut = one(spark, lambda c: T.truncated_bytes(c, most), value)
    assert value.startswith(cut) and len(cut.encode()) <= most and len(value[: len(cut) + 1].encode()) > most or cut == value


def test_word_hash_and_stop_words(spark):
    assert len(one(spark, T.word_hash, "Crawler")) == 12
    assert one(spark, T.word_hash, "Crawler") == one(spark, T.word_hash, "crawler")
    assert one(spark, T.is_stop, "the") and not one(spark, T.is_stop, "crawler")
