"""Predicates on documents, pages and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.functions import urls as U
from webloom.operators.postings import _OCC, documents_of, postings
from webloom.registry import query
from webloom.session import table


def at_least(index: DataFrame, terms: list[str], least: int, key: str = "doc_id") -> DataFrame:
    """Documents with at least that many of the terms."""
    return index.where(F.col("word").isin(*terms)).groupBy(key).agg(F.countDistinct("word").alias("matched")).where(F.col("matched") >= least)


def minimum_should_match(n: int) -> int:
    """All of up to two terms, else three fifths rounded up, but never all."""
    return n if n < 3 else max(1, min(n - 1, -(-6 * n // 10)))


_FIVE = ["crawler", "index", "language", "redirect", "robots"]
_IN5 = ", ".join(f"'{w}'" for w in _FIVE)


@query(f"WITH {_OCC} SELECT doc_id FROM postings WHERE word IN ('crawler', 'redirect') GROUP BY doc_id HAVING count(DISTINCT word) = 2")
def f4_all_words(spark, folder):
    return at_least(postings(documents_of(spark, folder)), ["crawler", "redirect"], 2).select("doc_id")


@query(f"WITH {_OCC} SELECT doc_id, count(DISTINCT word)::bigint AS matched FROM postings WHERE word IN ({_IN5}) GROUP BY doc_id HAVING count(DISTINCT word) >= 3")
def f5_minimum_should_match(spark, folder):
    return at_least(postings(documents_of(spark, folder)), _FIVE, minimum_should_match(len(_FIVE)))


def is_identifier(term: Column) -> Column:
    """Only letters, numbers and marks, at least one letter and one number."""
    return term.rlike("^[\\p{L}\\p{N}\\p{M}]+$") & term.rlike("\\p{L}") & term.rlike("\\p{N}")


@query(f"""WITH {_OCC} SELECT DISTINCT word FROM postings WHERE regexp_matches(word, '^[\\p{{L}}\\p{{N}}\\p{{M}}]+$') AND regexp_matches(word, '\\p{{L}}') AND regexp_matches(word, '\\p{{N}}')""")
def z6_identifier_test(spark, folder):
    return postings(documents_of(spark, folder)).where(is_identifier(F.col("word"))).select("word").distinct()


@query(f"""WITH {_OCC}, ids AS (SELECT DISTINCT doc_id FROM postings WHERE regexp_matches(word, '\\p{{L}}') AND regexp_matches(word, '\\p{{N}}'))
SELECT doc_id FROM postings WHERE word IN ('crawler', 'redirect', 'index') AND doc_id IN (SELECT doc_id FROM ids) GROUP BY doc_id HAVING count(DISTINCT word) >= 2""")
def f6_identifier_clause(spark, folder):
    """An identifier stays mandatory, the other terms need their minimum."""
    index = postings(documents_of(spark, folder))
    mandatory = index.where(is_identifier(F.col("word"))).select("doc_id").distinct()
    return at_least(index, ["crawler", "redirect", "index"], minimum_should_match(3)).join(mandatory, "doc_id", "left_semi").select("doc_id")


def edit_budget(term: str) -> tuple[int, int]:
    """Edits a term may differ by, and the beginning that must agree."""
    n = len(term)
    edits = 0 if n <= 2 or n > 64 else 2 if n >= 8 else 1
    return edits, 4 if n >= 8 else 2 if n >= 6 else 1 if n >= 4 else 0


def fuzzy(words: DataFrame, term: str) -> DataFrame:
    edits, shared = edit_budget(term)
    near = F.col("word").startswith(term[:shared]) & (F.abs(F.length("word") - len(term)) <= edits)
    return words.where(near & (F.levenshtein(F.col("word"), F.lit(term)) <= edits))


@query(f"""WITH {_OCC} SELECT word, levenshtein(word, 'redirektion')::int AS edits FROM (SELECT DISTINCT word FROM postings) WHERE starts_with(word, 'redi') AND levenshtein(word, 'redirektion') <= 2
UNION ALL SELECT word, levenshtein(word, 'langauge')::int FROM (SELECT DISTINCT word FROM postings) WHERE starts_with(word, 'lang') AND levenshtein(word, 'langauge') <= 2""")
def f7_fuzzy_match(spark, folder):
    words = postings(documents_of(spark, folder)).select("word").distinct()
    parts = [fuzzy(words, t).select("word", F.levenshtein(F.col("word"), F.lit(t)).alias("edits")) for t in ("redirektion", "langauge")]
    return parts[0].unionAll(parts[1])


@query(f"WITH {_OCC} SELECT DISTINCT doc_id FROM postings WHERE word = 'crawler' AND doc_id NOT IN (SELECT doc_id FROM postings WHERE word IN ('index', 'robots'))")
def f8_excluded_terms(spark, folder):
    index = postings(documents_of(spark, folder))
    return index.where("word = 'crawler'").select("doc_id").distinct().join(index.where("word IN ('index', 'robots')").select("doc_id"), "doc_id", "left_anti")


@query(f"""WITH {_OCC}, base AS (SELECT doc_id, hits FROM postings WHERE word = 'crawler'), extra AS (SELECT doc_id, sum(hits) AS more FROM postings WHERE word IN ('robots', 'redirect') GROUP BY doc_id)
SELECT doc_id, hits + 0.5 * coalesce(more, 0)::double AS score FROM base LEFT JOIN extra USING (doc_id)""")
def f9_optional_terms(spark, folder):
    """Expansion terms add half their hits and never admit a document."""
    index = postings(documents_of(spark, folder))
    extra = index.where("word IN ('robots', 'redirect')").groupBy("doc_id").agg(F.sum("hits").alias("more"))
    return index.where("word = 'crawler'").join(extra, "doc_id", "left").select("doc_id", (F.col("hits") + 0.5 * F.coalesce("more", F.lit(0))).cast("double").alias("score"))


def has_phrase(tokens: Column, words: list[str]) -> Column:
    """Do the words stand side by side?"""
    return F.contains(F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")), F.lit(" " + " ".join(words) + " "))


@query(f"""SELECT doc_id FROM (SELECT doc_id, {T.tokens_sql('text')} AS t FROM documents) WHERE contains(' ' || array_to_string(t, ' ') || ' ', ' redirect chain ')""")
def f10_phrase(spark, folder):
    return documents_of(spark, folder).where(has_phrase(T.tokens(F.col("text")), ["redirect", "chain"])).select("doc_id")


def near_words(documents: DataFrame, words: list[str], window: int = 8, key: str = "doc_id", body: str = "text") -> DataFrame:
    """Documents with all words (as a multiset) inside one window of that many tokens."""
    places = documents.select(key, F.posexplode(T.tokens(F.col(body))).alias("position", "word")).where(F.col("word").isin(*words))
    frame = Window.partitionBy(key).orderBy("position").rangeBetween(1 - window, 0)
    test = F.lit(True)
    for w in set(words):
        test = test & (F.sum((F.col("word") == w).cast("int")).over(frame) >= words.count(w))
    return places.select(key, test.alias("inside")).where("inside").select(key).distinct()


@query(f"""WITH o AS (SELECT doc_id, unnest(t) AS word, unnest(range(len(t))) AS p FROM (SELECT doc_id, {T.tokens_sql('text')} AS t FROM documents))
SELECT DISTINCT a.doc_id FROM o a JOIN o b ON a.doc_id = b.doc_id AND abs(a.p - b.p) <= 7 WHERE a.word = 'crawler' AND b.word = 'index'""")
def f11_near_filter(spark, folder):
    return near_words(documents_of(spark, folder), ["crawler", "index"])


def pages_of(spark, folder) -> DataFrame:
    return table(spark, folder, "crawled_pages")


_HOST = U.host_sql("url")


@query(f"SELECT page_id FROM crawled_pages WHERE regexp_replace({_HOST}, '^www\\.', '') = 'nelven2.test'")
def f12_site(spark, folder):
    return pages_of(spark, folder).where(U.bare_host(F.col("url")) == "nelven2.test").select("page_id")


def in_domain(host: Column, domain: str) -> Column:
    plain = domain.removeprefix("*.").lower()
    return (host == plain) | host.endswith("." + plain)


@query(f"SELECT page_id FROM crawled_pages WHERE ({_HOST} = 'orvanet.example' OR ends_with({_HOST}, '.orvanet.example')) AND NOT ({_HOST} = 'invalid' OR ends_with({_HOST}, '.invalid'))")
def f13_domains(spark, folder):
    h = U.host(F.col("url"))
    return pages_of(spark, folder).where(in_domain(h, "*.orvanet.example") & ~in_domain(h, "invalid")).select("page_id")


@query(f"SELECT page_id FROM crawled_pages WHERE {_HOST} = 'test' OR ends_with({_HOST}, '.test')")
def f14_tld(spark, folder):
    return pages_of(spark, folder).where(in_domain(U.host(F.col("url")), "test")).select("page_id")


@query("SELECT page_id FROM crawled_pages WHERE contains(lower(url), 'thread')")
def f15_inurl(spark, folder):
    return pages_of(spark, folder).where(F.contains(F.lower("url"), F.lit("thread"))).select("page_id")


@query(f"SELECT page_id, {U.extension_sql('url')} AS extension FROM crawled_pages WHERE {U.extension_sql('url')} IN ('html', 'htm')")
def f16_filetype(spark, folder):
    return pages_of(spark, folder).withColumn("extension", U.extension(F.col("url"))).where("extension IN ('html', 'htm')").select("page_id", "extension")


@query("SELECT doc_id FROM documents WHERE title ILIKE '%crawler%'")
def f17_author(spark, folder):
    """A case-insensitive part of a metadata field."""
    return documents_of(spark, folder).where(F.col("title").ilike("%crawler%")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE lower(trim(lang)) = 'de'")
def f18_language(spark, folder):
    return documents_of(spark, folder).where(F.lower(F.trim("lang")) == "de").select("doc_id")


@query("SELECT doc_id FROM documents WHERE coalesce(created_at, TIMESTAMP '1970-01-01') < TIMESTAMP '2025-01-01'")
def f19_until(spark, folder):
    """Undated rows compare as the oldest."""
    return documents_of(spark, folder).where(F.coalesce("created_at", F.lit("1970-01-01").cast("timestamp")) < F.lit("2025-01-01").cast("timestamp")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE created_at BETWEEN TIMESTAMP '2025-02-01' AND TIMESTAMP '2025-06-30'")
def f20_date_bounds(spark, folder):
    """Bounds reject undated rows."""
    return documents_of(spark, folder).where(F.col("created_at").between(F.lit("2025-02-01").cast("timestamp"), F.lit("2025-06-30").cast("timestamp"))).select("doc_id")


@query(f"""SELECT result_id, {U.family_sql(U.extension_sql('url'))} AS family, coalesce(len(images), 0) > 0 AS has_images FROM crawl_results WHERE url IS NOT NULL""")
def f21_content_domain(spark, folder):
    rows = table(spark, folder, "crawl_results").where("url IS NOT NULL")
    return rows.select("result_id", U.family(U.extension(F.col("url"))).alias("family"), F.coalesce(F.size("images") > 0, F.lit(False)).alias("has_images"))


@query("SELECT explain_id FROM explain_results WHERE NOT (spam_risk_known AND spam_risk > 0.5) AND NOT (source <> 'local' AND NOT spam_risk_known)")
def f22_safe_search(spark, folder):
    """Risky rows are dropped, and rows from other nodes whose risk is unknown."""
    risky = F.coalesce(F.col("spam_risk_known") & (F.col("spam_risk") > 0.5), F.lit(None))
    foreign = (F.col("source") != "local") & ~F.col("spam_risk_known")
    return table(spark, folder, "explain_results").where(~risky & ~foreign).select("explain_id")


@query("""SELECT page_id, CASE WHEN regexp_matches(url, '/(docs|kb)/') THEN 0 ELSE 1 END AS mask_rank FROM crawled_pages WHERE regexp_matches(url, '^https?://[^/]+/')""")
def f24_url_masks(spark, folder):
    """A mask filters; a preference mask only orders."""
    pages = pages_of(spark, folder).where(F.col("url").rlike("^https?://[^/]+/"))
    return pages.select("page_id", F.when(F.col("url").rlike("/(docs|kb)/"), 0).otherwise(1).alias("mask_rank"))


@query("""SELECT event_id FROM events WHERE (event_id & 6) <> 0 AND event_type <> 'view'""")
def f25_property_flags(spark, folder):
    """Any overlap of flag bits, with kinds left out."""
    return table(spark, folder, "events").where((F.col("event_id").bitwiseAND(6) != 0) & (F.col("event_type") != "view")).select("event_id")


@query(f"SELECT e.explain_id FROM explain_results e JOIN crawled_pages p ON e.url = p.url WHERE p.title ILIKE '%why%' AND {U.extension_sql('e.url')} = 'html' AND starts_with(e.url, 'https:')")
def f26_metadata_filter(spark, folder):
    hits, pages = table(spark, folder, "explain_results").select("explain_id", "url"), pages_of(spark, folder).select("url", "title")
    wanted = hits.where((U.extension(F.col("url")) == "html") & F.col("url").startswith("https:"))
    return wanted.join(pages.where(F.col("title").ilike("%why%")), "url").select("explain_id")


@query(f"SELECT explain_id FROM explain_results WHERE source = 'web' AND contains(lower(url), 'docs') AND ({_HOST} = 'test' OR ends_with({_HOST}, '.test') OR ends_with({_HOST}, '.invalid'))")
def f27_web_constraints(spark, folder):
    rows = table(spark, folder, "explain_results").where("source = 'web'")
    h = U.host(F.col("url"))
    return rows.where(F.contains(F.lower("url"), F.lit("docs")) & (in_domain(h, "test") | in_domain(h, "invalid"))).select("explain_id")


@query(f"""WITH deny AS (SELECT {_HOST} AS h FROM crawled_pages GROUP BY 1 HAVING count(*) < 100) SELECT page_id FROM crawled_pages WHERE {_HOST} NOT IN (SELECT h FROM deny)""")
def f28_denylist(spark, folder):
    pages = pages_of(spark, folder).withColumn("h", U.host(F.col("url")))
    deny = pages.groupBy("h").count().where("count < 100").select("h")
    return pages.join(deny, "h", "left_anti").select("page_id")


_TRAP_SEG = f"list_filter(string_split({U.path_sql('url')}, '/'), lambda x: x <> '')"


@query(f"""SELECT page_id, (length(url) > 2048 OR len({_TRAP_SEG}) > 24 OR len(list_filter(string_split(regexp_extract(trim(url), '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '')) > 16
OR coalesce(list_max(list_transform({_TRAP_SEG}, lambda s: len(list_filter({_TRAP_SEG}, lambda x: x = s)))), 0) > 3 OR {_HOST} = '') AS trap FROM crawled_pages WHERE url IS NOT NULL""")
def f30_url_traps(spark, folder):
    return pages_of(spark, folder).where("url IS NOT NULL").select("page_id", U.is_trap(F.col("url")).alias("trap"))


@query(f"""SELECT page_id FROM crawled_pages WHERE url IS NOT NULL AND NOT contains(url, '?') AND {U.path_sql('url')} LIKE '/docs/%' AND NOT regexp_matches(url, '\\.php')""")
def f29_link_admission(spark, folder):
    """Scope, query policy and patterns of a crawl profile, and no trap."""
    u = F.col("url")
    return pages_of(spark, folder).where(u.isNotNull() & ~F.contains(u, F.lit("?")) & U.path(u).startswith("/docs/") & ~u.rlike("\\.php") & ~U.is_trap(u)).select("page_id")


@query("""SELECT event_id, CASE WHEN value IS NULL THEN 'no value' WHEN value < 5 THEN 'too small' WHEN event_type = 'error' THEN 'closed kind' WHEN ts < TIMESTAMP '2024-01-03' THEN 'too old' ELSE 'open' END AS gate FROM events""")
def f32_gates(spark, folder):
    """Named gates in order; the first closed one is the reason."""
    closed = [(F.col("value").isNull(), "no value"), (F.col("value") < 5, "too small"), (F.col("event_type") == "error", "closed kind"), (F.col("ts") < F.lit("2024-01-03").cast("timestamp"), "too old")]
    reason = F.coalesce(*[F.when(test, F.lit(name)) for test, name in closed], F.lit("open"))
    return table(spark, folder, "events").select("event_id", reason.alias("gate"))


@query(f"""SELECT page_id, {_HOST} AS host, {U.path_sql('url')} AS path, regexp_extract({U.path_sql('url')}, '([^/]*)$', 1) AS file, strftime(fetched_at, '%Y%m%d') AS day FROM crawled_pages WHERE url IS NOT NULL""")
def f33_result_projection(spark, folder):
    u = F.col("url")
    return pages_of(spark, folder).where(u.isNotNull()).select(
        "page_id", U.host(u).alias("host"), U.path(u).alias("path"), F.regexp_extract(U.path(u), "([^/]*)$", 1).alias("file"), F.date_format("fetched_at", "yyyyMMdd").alias("day")
    )


@query("SELECT page_id, title, substring(text, 1, 200) AS head FROM crawled_pages WHERE length(text) > 0")
def f34_candidate_projection(spark, folder):
    """A bounded stored part stands in for whole bodies."""
    return pages_of(spark, folder).where(F.length("text") > 0).select("page_id", "title", F.substring("text", 1, 200).alias("head"))


@query("SELECT page_id, url FROM crawled_pages WHERE contains(lower(coalesce(title, '')), 'host') AND contains(lower(url), 'docs')")
def z13_document_browser(spark, folder):
    return pages_of(spark, folder).where(F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit("host")) & F.contains(F.lower("url"), F.lit("docs"))).select("page_id", "url")


@query(f"""SELECT page_id FROM crawled_pages WHERE NOT (({_HOST} = 'orvanet.example' OR ends_with({_HOST}, '.orvanet.example')) AND starts_with({U.path_sql('url')}, '/tag/'))""")
def z5_redirect_sweep(spark, folder):
    """Rows of a tracking host and path are swept."""
    u = F.col("url")
    return pages_of(spark, folder).where(~(in_domain(U.host(u), "orvanet.example") & U.path(u).startswith("/tag/"))).select("page_id")


@query("""SELECT doc_id, strftime(created_at, '%Y%m%d') AS day FROM documents WHERE created_at IS NOT NULL AND CAST(created_at AS DATE) >= DATE '2025-03-15'""")
def z17_remote_date_bounds(spark, folder):
    """Day-truncated bounds; undated rows drop."""
    return documents_of(spark, folder).where(F.col("created_at").isNotNull() & (F.to_date("created_at") >= F.lit("2025-03-15").cast("date"))).select("doc_id", F.date_format("created_at", "yyyyMMdd").alias("day"))


@query("""SELECT doc_id, title FROM documents WHERE lower(title) LIKE '%redirect%' AND n_chars > 500""")
def k8_export_filter(spark, folder):
    return documents_of(spark, folder).where(F.contains(F.lower("title"), F.lit("redirect")) & (F.col("n_chars") > 500)).select("doc_id", "title")
