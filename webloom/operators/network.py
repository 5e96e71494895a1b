"""What nodes exchange and schedule: merges, admission, leases, retirements and selections."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.functions import urls as U
from webloom.operators.filters import in_domain
from webloom.operators.postings import _OCC, documents_of, posting_text, postings
from webloom.operators.ranking import _LISTS, results_of
from webloom.registry import query
from webloom.session import table


@query(f"""WITH {_LISTS}, known AS (SELECT DISTINCT query_id, url FROM l WHERE list <> 'web') SELECT l.explain_id, known.url IS NOT NULL AS duplicate FROM l LEFT JOIN known USING (query_id, url) WHERE list = 'web'""")
def j19_merged_web_rows(spark, folder):
    """Web rows that another branch already holds, by which the total is corrected."""
    rows = results_of(spark, folder)
    known = rows.where("list <> 'web'").select("query_id", "url").distinct().withColumn("duplicate", F.lit(True))
    return rows.where("list = 'web'").join(known, ["query_id", "url"], "left").select("explain_id", F.coalesce("duplicate", F.lit(False)).alias("duplicate"))


@query("""SELECT e.explain_id, coalesce(j.grade, CASE WHEN e.quality_known AND e.quality > 0.5 THEN 2 ELSE 1 END)::int AS grade FROM explain_results e LEFT JOIN (SELECT query, url, max(grade) AS grade FROM judgments GROUP BY query, url) j ON e.query = j.query AND e.url = j.url""")
def j18_page_evidence(spark, folder):
    """Fresh evidence overlays what a row came with."""
    fresh = table(spark, folder, "judgments").groupBy("query", "url").agg(F.max("grade").alias("grade"))
    own = F.when(F.coalesce(F.col("quality_known"), F.lit(False)) & (F.col("quality") > 0.5), 2).otherwise(1)
    return table(spark, folder, "explain_results").join(fresh, ["query", "url"], "left").select("explain_id", F.coalesce("grade", own).cast("int").alias("grade"))


@query("""SELECT explain_id FROM explain_results WHERE coalesce(source, 'none') = 'local' OR (spam_risk_known AND spam_risk <= 0.5)""")
def f23_safe_search_merged(spark, folder):
    """After the merge, rows of other nodes with unknown risk are dropped too."""
    local = F.coalesce("source", F.lit("none")) == "local"
    return table(spark, folder, "explain_results").where(local | (F.col("spam_risk_known") & (F.col("spam_risk") <= 0.5))).select("explain_id")


@query(f"""WITH {_LISTS}, p AS (SELECT l.explain_id, list_distinct({T.tokens_sql('l.query')}) AS terms, lower(coalesce(c.title, '') || ' ' || l.url) AS shown FROM l LEFT JOIN (SELECT url, max(title) AS title FROM crawled_pages GROUP BY url) c ON c.url = l.url WHERE list = 'peer')
SELECT explain_id, len(list_filter(terms, lambda t: contains(shown, t))) = len(terms) AS admitted FROM p""")
def z8_peer_admission(spark, folder):
    """A peer's row is admitted at once when all terms are visible in its title or address."""
    titles = table(spark, folder, "crawled_pages").groupBy("url").agg(F.max("title").alias("title"))
    rows = results_of(spark, folder).where("list = 'peer'").join(titles, "url", "left")
    shown = rows.select("explain_id", F.array_distinct(T.tokens(F.col("query"))).alias("terms"), F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), "url")).alias("shown"))
    return shown.select("explain_id", F.forall("terms", lambda t: F.contains(F.col("shown"), t)).alias("admitted"))


@query(f"""SELECT page_id FROM crawled_pages WHERE url IS NOT NULL AND NOT contains(url, '?') AND ({U.host_sql('url')} = 'test' OR ends_with({U.host_sql('url')}, '.test')) ORDER BY fetched_at NULLS FIRST, page_id LIMIT 40""")
def z9_crawl_lease(spark, folder):
    """The first pending rows that the policy lets pass."""
    u = F.col("url")
    allowed = table(spark, folder, "crawled_pages").where(u.isNotNull() & ~F.contains(u, F.lit("?")) & in_domain(U.host(u), "test"))
    return allowed.orderBy(F.col("fetched_at").asc_nulls_first(), "page_id").limit(40).select("page_id")


@query("""SELECT j.url, max(p.page_id)::bigint AS page_id, max(p.fetched_at) AS fetched_at FROM (SELECT DISTINCT url FROM judgments) j JOIN crawled_pages p USING (url) GROUP BY j.url ORDER BY j.url LIMIT 100""")
def z10_crawl_feed(spark, folder):
    """Metadata of asked addresses, their number clamped."""
    asked = table(spark, folder, "judgments").select("url").distinct()
    pages = table(spark, folder, "crawled_pages").join(asked, "url", "left_semi")
    return pages.groupBy("url").agg(F.max("page_id").alias("page_id"), F.max("fetched_at").alias("fetched_at")).orderBy("url").limit(100)


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal >= 1000 AND contains(lower(s_name), '1') ORDER BY s_acctbal DESC, s_suppkey LIMIT 25")
def z11_seed_list(spark, folder):
    """Peers above a floor whose name holds a part."""
    return table(spark, folder, "supplier").where((F.col("s_acctbal") >= 1000) & F.contains(F.lower("s_name"), F.lit("1"))).orderBy(F.desc("s_acctbal"), "s_suppkey").limit(25).select("s_suppkey", "s_name")


@query("""SELECT DISTINCT e.url FROM explain_results e WHERE e.url IS NOT NULL AND e.url NOT IN (SELECT url FROM judgments WHERE url IS NOT NULL)""")
def z4_rows_without_metadata(spark, folder):
    known = table(spark, folder, "judgments").where("url IS NOT NULL").select("url")
    return table(spark, folder, "explain_results").where("url IS NOT NULL").select("url").distinct().join(known, "url", "left_anti")


@query("""SELECT p.url, max(p.title) AS title FROM crawled_pages p WHERE p.url IN (SELECT url FROM judgments WHERE grade = 3) GROUP BY p.url""")
def z3_metadata_by_key(spark, folder):
    wanted = table(spark, folder, "judgments").where("grade = 3").select("url").distinct()
    return table(spark, folder, "crawled_pages").join(wanted, "url", "left_semi").groupBy("url").agg(F.max("title").alias("title"))


@query(f"""WITH {_OCC} SELECT doc_id, hits::bigint AS hits, position::bigint AS position FROM postings WHERE hits > 1 AND word = 'index'""")
def z1_typed_appearances(spark, folder):
    """Posting lines to typed rows; rows with a malformed hash or number are discarded."""
    index = postings(documents_of(spark, folder)).where("word = 'index'")
    lines = index.select(posting_text(index).alias("line")).unionAll(index.select(F.lit("broken{h=x,c=2,t=1}").alias("line")).limit(3))
    fields = F.str_to_map(F.regexp_extract("line", "\\{(.*)\\}$", 1), F.lit(","), F.lit("="))
    number = lambda k: F.try_element_at(fields, F.lit(k)).try_cast("bigint")
    typed = lines.where(F.col("line").rlike("^[A-Za-z0-9_-]{12}\\{")).select(number("h").alias("doc_id"), number("c").alias("hits"), number("t").alias("position"))
    return typed.dropna().where("hits > 1")


def shard_of(c: Column, shards: int = 4) -> Column:
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long") % shards


@query(f"""WITH {_OCC}, s AS (SELECT word, doc_id, ('0x' || substring(md5(word), 1, 8))::bigint % 4 AS target FROM postings) SELECT target, count(*)::bigint AS moved, count(DISTINCT word)::bigint AS words FROM s GROUP BY target""")
def k5_outbound_selection(spark, folder):
    """Postings by the target that their word belongs to; each target's part goes out as one batch."""
    moved = postings(documents_of(spark, folder)).select("word", "doc_id", shard_of(F.col("word")).alias("target"))
    return moved.groupBy("target").agg(F.count("*").alias("moved"), F.countDistinct("word").alias("words"))


_V = f"v AS (SELECT page_id, {U.host_sql('url')} AS host, fetched_at, md5(url) AS h FROM crawled_pages WHERE url IS NOT NULL)"


@query(f"""WITH {_V}, o AS (SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY fetched_at NULLS FIRST, h, page_id) AS turn FROM v) SELECT page_id, turn::int AS turn, (turn * 2)::int AS due FROM o WHERE turn <= 20""")
def m5_frontier_dispatch(spark, folder):
    """Each host's next addresses with the second at which its pace allows them."""
    pages = table(spark, folder, "crawled_pages").where("url IS NOT NULL").withColumn("host", U.host(F.col("url")))
    order = Window.partitionBy("host").orderBy(F.col("fetched_at").asc_nulls_first(), F.md5("url"), "page_id")
    return pages.select("page_id", F.row_number().over(order).alias("turn")).where("turn <= 20").select("page_id", "turn", (F.col("turn") * 2).alias("due"))


@query("""SELECT user_id, count(*)::bigint AS failures, count(*) >= 5 AS retired FROM events WHERE event_type = 'error' GROUP BY user_id""")
def m9_failure_retirement(spark, folder):
    failed = table(spark, folder, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("failures"))
    return failed.select("user_id", "failures", (F.col("failures") >= 5).alias("retired"))


@query("""SELECT page_id, CASE WHEN length(trim(coalesce(text, ''))) = 0 THEN 'remove' ELSE 'store' END AS action FROM crawled_pages""")
def m11_tombstones(spark, folder):
    """An observation without content removes what is stored."""
    empty = F.length(F.trim(F.coalesce("text", F.lit("")), F.lit(" "))) == 0
    return table(spark, folder, "crawled_pages").select("page_id", F.when(empty, "remove").otherwise("store").alias("action"))


@query("""SELECT user_id, max(event_id)::bigint AS sequence, count(*)::bigint AS applied FROM (SELECT DISTINCT user_id, event_id FROM events) GROUP BY user_id""")
def m16_observation_batches(spark, folder):
    """Batches that arrive twice count once by their sequence."""
    events = table(spark, folder, "events").select("user_id", "event_id")
    return events.unionAll(events.where("event_id % 3 = 0")).distinct().groupBy("user_id").agg(F.max("event_id").alias("sequence"), F.count("*").alias("applied"))


@query("SELECT source, count(*)::bigint AS rows, count(DISTINCT query_id)::bigint AS runs FROM explain_results GROUP BY source")
def s25_engine_rows(spark, folder):
    """Rows per engine as a table; the network is the caller's."""
    return table(spark, folder, "explain_results").groupBy("source").agg(F.count("*").alias("rows"), F.countDistinct("query_id").alias("runs"))


@query("""SELECT page_id, title, coalesce(language, 'en') AS language, coalesce(len(links), 0)::bigint AS outlinks, coalesce(strftime(fetched_at, '%Y%m%d'), '19700101') AS fresh FROM crawled_pages""")
def s22_word_reference(spark, folder):
    """Fixed columns with their defaults."""
    return table(spark, folder, "crawled_pages").select(
        "page_id", "title", F.coalesce("language", F.lit("en")).alias("language"), F.coalesce(F.when(F.col("links").isNotNull(), F.size("links")), F.lit(0)).cast("long").alias("outlinks"),
        F.coalesce(F.date_format("fetched_at", "yyyyMMdd"), F.lit("19700101")).alias("fresh"),
    )


@query("""SELECT cluster_id, max(grade) AS grade, count(*)::bigint AS support, count(DISTINCT query)::bigint AS queries, min(url) AS representative FROM judgments WHERE cluster_id IS NOT NULL GROUP BY cluster_id""")
def a15_cluster_evidence(spark, folder):
    return table(spark, folder, "judgments").where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(
        F.max("grade").alias("grade"), F.count("*").alias("support"), F.countDistinct("query").alias("queries"), F.min("url").alias("representative")
    )


@query("""SELECT cluster_id, url FROM (SELECT cluster_id, url, row_number() OVER (PARTITION BY cluster_id ORDER BY max(grade) DESC, count(*) DESC, url) AS nth FROM judgments WHERE cluster_id IS NOT NULL GROUP BY cluster_id, url) WHERE nth = 1""")
def a16_representative(spark, folder):
    """Best grade, then most support, then the least address."""
    sums = table(spark, folder, "judgments").where("cluster_id IS NOT NULL").groupBy("cluster_id", "url").agg(F.max("grade").alias("g"), F.count("*").alias("n"))
    return sums.groupBy("cluster_id").agg(F.min_by("url", F.struct((-F.col("g")).alias("a"), (-F.col("n")).alias("b"), "url")).alias("url"))


def registered(spark) -> list[str]:
    """The engine's functions under SQL names, for spark.sql."""
    from pyspark.sql.types import ArrayType, BooleanType, StringType

    names = []
    for name, function, kind in (("url_host", _host, StringType()), ("search_tokens", _tokens, ArrayType(StringType())), ("is_stop_word", _is_stop, BooleanType())):
        spark.udf.register(name, F.pandas_udf(function, kind))
        names.append(name)
    return names


def _host(urls: pd.Series) -> pd.Series:
    return urls.str.strip().str.extract(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^/:?#]*)", expand=False).str.lower()


def _tokens(texts: pd.Series) -> pd.Series:
    return texts.fillna("").str.lower().str.findall(r"[^\W_]+")


def _is_stop(words: pd.Series) -> pd.Series:
    return words.isin(T.STOP_WORDS)


@query(f"SELECT page_id, {U.host_sql('url')} AS host FROM crawled_pages WHERE url IS NOT NULL")
def x8_sql_functions(spark, folder):
    """A function of the engine called from SQL text."""
    registered(spark)
    table(spark, folder, "crawled_pages").createOrReplaceTempView("pages_for_sql")
    return spark.sql("SELECT page_id, url_host(url) AS host FROM pages_for_sql WHERE url IS NOT NULL")


def decorated(*stages):
    """A search stage that wraps others: each takes and gives a DataFrame of results."""

    def run(df: DataFrame) -> DataFrame:
        for stage in stages:
            df = df.transform(stage)
        return df

    return run


@query(f"""WITH {_LISTS} SELECT explain_id, round(score * (CASE list WHEN 'local' THEN 1.0 ELSE 0.5 END), 9)::double AS score FROM l WHERE score > 0.5""")
def x1_decorated_search(spark, folder):
    """Stages as functions of DataFrames, here a filter and a scorer hook."""
    keep = lambda df: df.where("score > 0.5")
    weigh = lambda df: df.withColumn("score", F.round(F.col("score") * F.when(F.col("list") == "local", 1.0).otherwise(0.5), 9))
    return decorated(keep, weigh)(results_of(spark, folder)).select("explain_id", "score")


@query("SELECT l_returnflag FROM lineitem WHERE l_quantity > 49 EXCEPT ALL SELECT l_returnflag FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.05")
def u6_multiset_except(spark, folder):
    rows = table(spark, folder, "lineitem").where("l_quantity > 49")
    return rows.select("l_returnflag").exceptAll(rows.where("l_discount > 0.05").select("l_returnflag"))


@query("SELECT doc_id, created_at FROM documents WHERE created_at IS NOT NULL AND created_at <= (SELECT max(created_at) FROM documents)")
def c30_publication_date(spark, folder):
    """A date counts only when it is known and not in the future of the collection."""
    documents = documents_of(spark, folder)
    now = documents.agg(F.max("created_at").alias("now"))
    return documents.where("created_at IS NOT NULL").crossJoin(F.broadcast(now)).where("created_at <= now").select("doc_id", "created_at")


@query("""SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}][\\p{L}\\p{N}\\p{M}]*'), lambda t: length(t) <= 48))::bigint AS tokens FROM documents WHERE text IS NOT NULL""")
def c12_feedback_tokens(spark, folder):
    kept = F.filter(T.word_tokens(F.col("text")), lambda t: F.length(t) <= 48)
    return documents_of(spark, folder).where("text IS NOT NULL").select("doc_id", F.size(kept).cast("long").alias("tokens"))


@query("""SELECT doc_id, substring(text, greatest(1, strpos(text, 'crawler') - 256), 512 + 7) AS passage FROM documents WHERE strpos(text, 'crawler') > 0""")
def c37_cached_passage(spark, folder):
    """A match with 256 characters on either side."""
    at = F.locate("crawler", F.col("text"))
    return documents_of(spark, folder).where(at > 0).select("doc_id", F.col("text").substr(F.greatest(F.lit(1), at - 256), F.lit(512 + 7)).alias("passage"))


def web_tokens(c: Column) -> Column:
    """Words with inner hyphens, numbers with inner separators, and single punctuation marks; lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit("\\p{L}+(?:-\\p{L}+)*|[0-9]+(?:[.,:][0-9]+)*|[!-/:-@]"), F.lit(0))


@query("""SELECT doc_id, len(regexp_extract_all(lower(title), '\\p{L}+(?:-\\p{L}+)*|[0-9]+(?:[.,:][0-9]+)*|[!-/:-@]'))::bigint AS tokens FROM documents WHERE title IS NOT NULL""")
def c9_web_tokens(spark, folder):
    return documents_of(spark, folder).where("title IS NOT NULL").select("doc_id", F.size(web_tokens(F.col("title"))).cast("long").alias("tokens"))


#: Endings that a light analyzer takes off, by language.
ENDINGS = {"en": "ations|ation|ings|ing|ers|ed|es|s", "de": "ungen|ung|ern|em|en|er|es|e", "fr": "ements|ement|ations|ation|es|s", "es": "aciones|ación|mente|os|as|es|s"}


@query(f"""SELECT doc_id, lang, len(list_distinct(list_transform({T.tokens_sql('title')}, lambda w: CASE lang WHEN 'en' THEN regexp_replace(w, '^(.{{4,}}?)({ENDINGS['en']})$', '\\1') WHEN 'de' THEN regexp_replace(w, '^(.{{4,}}?)({ENDINGS['de']})$', '\\1')
WHEN 'fr' THEN regexp_replace(w, '^(.{{4,}}?)({ENDINGS['fr']})$', '\\1') WHEN 'es' THEN regexp_replace(w, '^(.{{4,}}?)({ENDINGS['es']})$', '\\1') ELSE w END)))::bigint AS stems FROM documents WHERE title IS NOT NULL""")
def c15_language_analyzers(spark, folder):
    """Tokens of each language by its own endings; other languages pass unchanged. r2 fans queries out alike."""
    documents = documents_of(spark, folder).where("title IS NOT NULL").select("doc_id", "lang", T.tokens(F.col("title")).alias("w"))
    stems = F.col("w")
    for code, endings in ENDINGS.items():
        stems = F.when(F.col("lang") == code, _stems("w", endings)).otherwise(stems)
    return documents.select("doc_id", "lang", F.size(F.array_distinct(stems)).cast("long").alias("stems"))


def _stems(column: str, endings: str) -> Column:
    return F.transform(column, lambda w: F.regexp_replace(w, f"^(.{{4,}}?)({endings})$", "$1"))


def inflections(word: Column, language: str = "en") -> Column:
    """The forms that share a word's stem by the endings of its language."""
    stem = F.regexp_replace(word, f"^(.{{4,}}?)({ENDINGS[language]})$", "$1")
    return F.array_distinct(F.array(stem, *[F.concat(stem, F.lit(e)) for e in ENDINGS[language].split("|")]))


@query(f"""WITH v AS (SELECT DISTINCT unnest({T.tokens_sql('text')}) AS word FROM documents), s AS (SELECT word, regexp_replace(word, '^(.{{4,}}?)({ENDINGS['en']})$', '\\1') AS stem FROM v WHERE length(word) >= 4),
e AS (SELECT word, unnest(list_concat([stem], list_transform(string_split('{ENDINGS['en']}', '|'), lambda x: stem || x))) AS form FROM s) SELECT DISTINCT e.word, e.form FROM e JOIN v ON e.form = v.word WHERE e.form <> e.word""")
def c20_inflections(spark, folder):
    """Known words that are inflections of each other."""
    words = documents_of(spark, folder).select(F.explode(T.tokens(F.col("text"))).alias("word")).distinct()
    made = words.where(F.length("word") >= 4).select("word", F.explode(inflections(F.col("word"))).alias("form"))
    return made.join(words.select(F.col("word").alias("form")), "form", "left_semi").where("form <> word").select("word", "form").distinct()
