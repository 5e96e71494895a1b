"""Reading pages, feeds and sitemaps: round trips through the formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.registry import query
from webloom.session import table
from webloom.sources.html import read_pages, robots_directives


def _escaped(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def written_html(spark, folder) -> DataFrame:
    """crawled_pages as HTML, each page under its own address."""
    pages = table(spark, folder, "crawled_pages").where("url IS NOT NULL")
    links = F.array_join(F.transform(F.coalesce("links", F.array().cast("array<string>")), lambda x: F.concat(F.lit('<a href="'), _escaped(x), F.lit('">link</a> '))), "")
    body = F.concat(
        F.lit("<html><head><title>"), _escaped(F.coalesce("title", F.lit(""))), F.lit('</title><meta name="robots" content="noindex"><script type="application/ld+json">{"datePublished": "'),
        F.coalesce(F.date_format("fetched_at", "yyyy-MM-dd"), F.lit("")), F.lit('"}</script><script>var hidden = 1;</script></head><body><h1>'), _escaped(F.coalesce("title", F.lit(""))),
        F.lit("</h1>"), links, F.lit("</body></html>"),
    )
    return pages.select("page_id", F.concat(F.lit("http://page.test/"), F.col("page_id").cast("string")).alias("url"), body.alias("html"))


@query("""SELECT 'http://page.test/' || page_id AS url, nullif(trim(regexp_replace(coalesce(title, ''), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), '') AS title, len(list_distinct(list_transform(coalesce(links, []), lambda x: string_split(x, '#')[1])))::int AS links, strftime(fetched_at, '%Y-%m-%d') AS published FROM crawled_pages WHERE url IS NOT NULL""")
def s8_html_reader(spark, folder):
    """Pages written as HTML and read again."""
    return read_pages(written_html(spark, folder)).select("url", "title", F.size("links").alias("links"), "published")


@query("SELECT 'http://page.test/' || page_id AS url, 1.0::double AS confidence FROM crawled_pages WHERE url IS NOT NULL AND fetched_at IS NOT NULL")
def s10_page_dates(spark, folder):
    return read_pages(written_html(spark, folder)).where("published <> ''").select("url", F.col("date_confidence").alias("confidence"))


@query("SELECT page_id, true AS noindex, false AS nofollow FROM crawled_pages WHERE url IS NOT NULL")
def s11_robots_directives(spark, folder):
    meta = F.regexp_extract("html", '<meta name="robots" content="([^"]*)"', 1)
    found = written_html(spark, folder).select("page_id", robots_directives(meta).alias("d"))
    return found.select("page_id", "d.noindex", "d.nofollow")


@query(f"SELECT page_id, CASE WHEN {U.extension_sql('url')} = '' OR {U.extension_sql('url')} IN ('html', 'htm', 'php') THEN 'html' WHEN {U.extension_sql('url')} IN ('xml', 'rss', 'atom') THEN 'feed' ELSE 'other' END AS parser FROM crawled_pages WHERE url IS NOT NULL")
def s12_format_dispatch(spark, folder):
    e = U.extension(F.col("url"))
    parser = F.when((e == "") | e.isin("html", "htm", "php"), "html").when(e.isin("xml", "rss", "atom"), "feed").otherwise("other")
    return table(spark, folder, "crawled_pages").where("url IS NOT NULL").select("page_id", parser.alias("parser"))


@query("SELECT doc_id, title FROM documents WHERE title IS NOT NULL")
def s14_feed_entries(spark, folder):
    """Titles written as feed items and read with XPath."""
    documents = table(spark, folder, "documents").where("title IS NOT NULL")
    item = F.concat(F.lit("<rss><channel><item><title>"), _escaped(F.col("title")), F.lit("</title></item></channel></rss>"))
    return documents.select("doc_id", F.xpath_string(item, F.lit("/rss/channel/item/title")).alias("title"))


@query("SELECT page_id, links[1] AS first, len(links)::bigint AS entries FROM crawled_pages WHERE len(links) > 0")
def s19_sitemaps(spark, folder):
    """Links written as a urlset and read back."""
    pages = table(spark, folder, "crawled_pages").where(F.size("links") > 0)
    entries = F.array_join(F.transform("links", lambda x: F.concat(F.lit("<url><loc>"), _escaped(x), F.lit("</loc></url>"))), "")
    found = pages.select("page_id", F.xpath(F.concat(F.lit("<urlset>"), entries, F.lit("</urlset>")), F.lit("/urlset/url/loc/text()")).alias("locs"))
    return found.select("page_id", F.get("locs", F.lit(0)).alias("first"), F.size("locs").cast("long").alias("entries"))


@query("SELECT page_id, url, length(text)::bigint AS size, strftime(fetched_at, '%Y%m%d') AS fresh FROM crawled_pages WHERE url IS NOT NULL AND fetched_at IS NOT NULL AND text IS NOT NULL")
def s21_metadata_codec(spark, folder):
    """Metadata rows {k=v,...} with a base64 address, written and read again; numbers are validated."""
    pages = table(spark, folder, "crawled_pages").where("url IS NOT NULL AND fetched_at IS NOT NULL AND text IS NOT NULL")
    coded = F.regexp_replace(F.base64(F.encode("url", "utf-8")), "[\\r\\n]", "")
    line = F.concat(F.lit("{id="), F.col("page_id").cast("string"), F.lit(",url=b|"), F.translate(coded, "=", "."), F.lit(",size="), F.length("text").cast("string"), F.lit(",fresh="), F.date_format("fetched_at", "yyyyMMdd"), F.lit("}"))
    fields = pages.select(F.str_to_map(F.regexp_extract(line, "^\\{(.*)\\}$", 1), F.lit(","), F.lit("=")).alias("f"))
    number = lambda k: F.col("f")[k].try_cast("bigint")
    address = F.decode(F.unbase64(F.translate(F.substring(F.col("f")["url"], 3, 1 << 20), ".", "=")), "utf-8")
    return fields.select(number("id").alias("page_id"), address.alias("url"), number("size").alias("size"), F.col("f")["fresh"].alias("fresh"))
