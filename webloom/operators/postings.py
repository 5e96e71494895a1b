"""Inverted index: building, scanning, intersecting and hydrating postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.functions import urls as U
from webloom.registry import query
from webloom.session import table

#: Bounds at which the hits and positions of postings saturate.
MOST_HITS, LAST_POSITION = 255, 65_535
TERMS = ("crawler", "index", "language")


def occurrences(documents: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """One row per token that is no stop word; stop words still take up a position."""
    return documents.select(key, F.posexplode(T.tokens(F.col(body))).alias("position", "word")).where(~T.is_stop(F.col("word")))


def postings(documents: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """word, key, hits and first position, over all words of a page. The tokens of a page are combined before they are shuffled."""
    counted = occurrences(documents, key, body).groupBy(key, "word").agg(F.count("*").alias("hits"), F.min("position").alias("position"))
    return counted.select(
        "word", key, F.least("hits", F.lit(MOST_HITS)).cast("int").alias("hits"), F.least("position", F.lit(LAST_POSITION)).cast("int").alias("position")
    )


_OCC = f"""occ AS (SELECT doc_id, unnest(toks) AS word, unnest(range(len(toks))) AS position FROM (SELECT doc_id, {T.tokens_sql('text')} AS toks FROM documents)),
kept AS (SELECT * FROM occ WHERE NOT ({T.stop_sql('word')})),
postings AS (SELECT word, doc_id, least(count(*), {MOST_HITS})::int AS hits, least(min(position), {LAST_POSITION})::int AS position FROM kept GROUP BY word, doc_id)"""


def documents_of(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


@query("SELECT doc_id, title, n_chars, source FROM documents")
def s1_document_scan(spark, folder):
    return documents_of(spark, folder).select("doc_id", "title", "n_chars", "source")


@query(f"SELECT page_id, title FROM crawled_pages WHERE {U.normalized_sql('url')} = (SELECT min({U.normalized_sql('url')}) FROM crawled_pages)")
def s2_point_read(spark, folder):
    pages = table(spark, folder, "crawled_pages").withColumn("normal", U.normalized(F.col("url")))
    wanted = pages.agg(F.min("normal").alias("normal"))
    return pages.join(F.broadcast(wanted), "normal", "left_semi").select("page_id", "title")


def by_word(index: DataFrame, word: str) -> DataFrame:
    """Postings of one word; in a table bucketed by word this reads one bucket."""
    return index.where(F.col("word") == word)


@query(f"WITH {_OCC} SELECT doc_id, hits, position FROM postings WHERE word = 'crawler'")
def s3_posting_scan(spark, folder):
    return by_word(postings(documents_of(spark, folder)), "crawler").select("doc_id", "hits", "position")


def page_after(index: DataFrame, keys: list[str], after: tuple, size: int) -> DataFrame:
    """The next page of a key-ordered scan."""
    cursor = F.struct(*[F.col(k) for k in keys])
    last = F.struct(*[F.lit(v).cast(index.schema[k].dataType) for k, v in zip(keys, after)])
    return index.where(cursor > last).orderBy(*keys).limit(size)


@query(f"WITH {_OCC} SELECT word, doc_id, hits FROM postings WHERE word > 'index' OR (word = 'index' AND doc_id > 100) ORDER BY word, doc_id LIMIT 200")
def s4_posting_page(spark, folder):
    return page_after(postings(documents_of(spark, folder)), ["word", "doc_id"], ("index", 100), 200).select("word", "doc_id", "hits")


@query(f"WITH {_OCC} SELECT word, count(*)::bigint AS documents, sum(hits)::bigint AS hits FROM postings GROUP BY word")
def s5_word_counts(spark, folder):
    return postings(documents_of(spark, folder)).groupBy("word").agg(F.count("*").alias("documents"), F.sum("hits").alias("hits"))


@query("SELECT page_id, url, fetched_at FROM crawled_pages ORDER BY fetched_at NULLS FIRST, url, page_id LIMIT 100")
def s6_stalest_urls(spark, folder):
    return table(spark, folder, "crawled_pages").orderBy(F.col("fetched_at").asc_nulls_first(), "url", "page_id").limit(100).select("page_id", "url", "fetched_at")


@query("""SELECT page_id, fetched_at + INTERVAL 30 DAY AS due FROM crawled_pages WHERE fetched_at + INTERVAL 30 DAY <= (SELECT max(fetched_at) FROM crawled_pages)
ORDER BY due, page_id LIMIT 100""")
def s7_due_urls(spark, folder):
    pages = table(spark, folder, "crawled_pages")
    now = pages.agg(F.max("fetched_at").alias("now"))
    due = pages.select("page_id", (F.col("fetched_at") + F.expr("INTERVAL 30 DAYS")).alias("due"))
    return due.crossJoin(F.broadcast(now)).where("due <= now").orderBy("due", "page_id").limit(100).select("page_id", "due")


@query(f"WITH {_OCC} SELECT word, doc_id, hits, position FROM postings")
def a3_posting_build(spark, folder):
    return postings(documents_of(spark, folder))


@query(f"WITH {_OCC} SELECT word, count(*)::bigint AS total, max(hits)::bigint AS most FROM postings GROUP BY word HAVING count(*) >= 2")
def a4_term_totals(spark, folder):
    return postings(documents_of(spark, folder)).groupBy("word").agg(F.count("*").alias("total"), F.max("hits").cast("long").alias("most")).where("total >= 2")


def intersection(index: DataFrame, terms: tuple[str, ...], excluded: tuple[str, ...] = (), key: str = "doc_id") -> DataFrame:
    """Documents with all terms: summed hits and the spread of first positions; none with an excluded term."""
    rows = index.where(F.col("word").isin(*terms)).dropDuplicates(["word", key])
    joined = (
        rows.groupBy(key)
        .agg(F.countDistinct("word").alias("terms"), F.sum("hits").alias("hits"), F.min("position").alias("first"), F.max("position").alias("last"))
        .where(F.col("terms") == len(set(terms)))
        .select(key, "hits", (F.col("last") - F.col("first")).alias("spread"))
    )
    if excluded:
        joined = joined.join(index.where(F.col("word").isin(*excluded)).select(key), key, "left_anti")
    return joined


_JOIN = """joined AS (SELECT doc_id, sum(hits)::bigint AS hits, max(position) - min(position) AS spread FROM postings WHERE word IN ('crawler', 'index', 'language')
GROUP BY doc_id HAVING count(DISTINCT word) = 3)"""


@query(f"WITH {_OCC}, {_JOIN} SELECT doc_id, hits, spread FROM joined")
def j1_term_intersection(spark, folder):
    return intersection(postings(documents_of(spark, folder)), TERMS)


@query(f"WITH {_OCC}, {_JOIN} SELECT doc_id, hits FROM joined WHERE doc_id NOT IN (SELECT doc_id FROM postings WHERE word = 'redirect')")
def j3_excluded_documents(spark, folder):
    return intersection(postings(documents_of(spark, folder)), TERMS, ("redirect",)).select("doc_id", "hits")


@query(f"WITH {_OCC} SELECT word, doc_id, hits FROM postings WHERE word = 'crawler' AND doc_id IN (SELECT doc_id FROM documents WHERE doc_kind = 'howto')")
def j4_required_documents(spark, folder):
    documents = documents_of(spark, folder)
    wanted = documents.where("doc_kind = 'howto'").select("doc_id")
    return by_word(postings(documents), "crawler").join(wanted, "doc_id", "left_semi").select("word", "doc_id", "hits")


@query("""SELECT query, url, min(explain_id)::bigint AS explain_id FROM explain_results GROUP BY query, url""")
def j2_first_appearance(spark, folder):
    rows = table(spark, folder, "explain_results")
    order = Window.partitionBy("query", "url").orderBy("explain_id")
    return rows.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("query", "url", "explain_id")


@query("""SELECT e.explain_id, p.page_id, p.title FROM explain_results e JOIN crawled_pages p ON e.url = p.url WHERE p.title IS NOT NULL""")
def j5_hydration(spark, folder):
    hits, pages = table(spark, folder, "explain_results").select("explain_id", "url"), table(spark, folder, "crawled_pages").select("url", "page_id", "title")
    return hits.join(pages, "url").where("title IS NOT NULL").select("explain_id", "page_id", "title")


@query("""SELECT DISTINCT url FROM judgments WHERE url NOT IN (SELECT url FROM crawled_pages WHERE url IS NOT NULL) AND url IS NOT NULL""")
def j6_orphans(spark, folder):
    stored = table(spark, folder, "crawled_pages").select("url")
    return table(spark, folder, "judgments").where("url IS NOT NULL").join(stored, "url", "left_anti").select("url").distinct()


@query(f"WITH {_OCC} SELECT doc_id, count(DISTINCT {T.word_hash_sql('word')})::bigint AS words, min({T.word_hash_sql('word')}) AS first_hash FROM postings GROUP BY doc_id")
def j11_words_of_documents(spark, folder):
    hashed = postings(documents_of(spark, folder)).select("doc_id", T.word_hash(F.col("word")).alias("word_hash"))
    return hashed.groupBy("doc_id").agg(F.countDistinct("word_hash").alias("words"), F.min("word_hash").alias("first_hash"))


@query(f"WITH {_OCC}, {_JOIN} SELECT doc_id, hits, spread FROM joined ORDER BY hits DESC, spread, doc_id LIMIT 50")
def t1_top_matches(spark, folder):
    return intersection(postings(documents_of(spark, folder)), TERMS).orderBy(F.desc("hits"), "spread", "doc_id").limit(50)


@query(f"WITH {_OCC}, {_JOIN} SELECT doc_id, spread FROM joined WHERE spread <= 40")
def t2_term_spread(spark, folder):
    return intersection(postings(documents_of(spark, folder)), TERMS).where("spread <= 40").select("doc_id", "spread")


@query("SELECT doc_id, created_at FROM documents ORDER BY created_at DESC NULLS LAST, doc_id LIMIT 20 OFFSET 40")
def t4_result_page(spark, folder):
    return documents_of(spark, folder).orderBy(F.col("created_at").desc_nulls_last(), "doc_id").offset(40).limit(20).select("doc_id", "created_at")


@query(f"WITH {_OCC} SELECT (doc_id % 8)::bigint AS shard, count(*)::bigint AS postings, count(DISTINCT word)::bigint AS words FROM postings GROUP BY 1")
def k4_index_shards(spark, folder):
    sharded = postings(documents_of(spark, folder)).withColumn("shard", F.col("doc_id") % 8)
    return sharded.groupBy("shard").agg(F.count("*").alias("postings"), F.countDistinct("word").alias("words"))


@query("""SELECT e.query AS word, e.url, max(e.explain_id)::bigint AS latest, (max(p.url) IS NULL) AS unknown_url FROM explain_results e
LEFT JOIN (SELECT DISTINCT url FROM crawled_pages) p ON e.url = p.url GROUP BY e.query, e.url""")
def k3_posting_insert(spark, folder):
    """Newest entry per word and url, with those whose url has no metadata marked."""
    rows = table(spark, folder, "explain_results").groupBy(F.col("query").alias("word"), "url").agg(F.max("explain_id").alias("latest"))
    known = table(spark, folder, "crawled_pages").select("url").distinct().withColumn("known", F.lit(True))
    return rows.join(known, "url", "left").select("word", "url", "latest", F.col("known").isNull().alias("unknown_url"))


def posting_text(index: DataFrame) -> Column:
    """wordhash{h=..,c=..,t=..} as postings travel between nodes."""
    return F.concat(T.word_hash(F.col("word")), F.lit("{h="), F.col("doc_id"), F.lit(",c="), F.col("hits"), F.lit(",t="), F.col("position"), F.lit("}"))


def parsed_posting(line: Column) -> Column:
    """The fields of a posting line; null where the hash or a number is malformed."""
    fields = F.str_to_map(F.regexp_extract(line, "\\{(.*)\\}$", 1), F.lit(","), F.lit("="))
    ok = line.rlike("^[A-Za-z0-9_-]{12}\\{[^{}]*\\}$")
    number = lambda k: F.try_element_at(fields, F.lit(k)).try_cast("bigint")
    return F.when(ok, F.struct(F.substring(line, 1, 12).alias("word_hash"), number("h").alias("doc_id"), number("c").alias("hits"), number("t").alias("position")))


@query(f"WITH {_OCC} SELECT {T.word_hash_sql('word')} AS word_hash, doc_id, hits::bigint AS hits, position::bigint AS position FROM postings")
def s20_posting_codec(spark, folder):
    index = postings(documents_of(spark, folder))
    lines = index.select(posting_text(index).alias("line"))
    return lines.select(parsed_posting(F.col("line")).alias("p")).select("p.*")


@query(f"""WITH {_OCC}, h AS (SELECT DISTINCT {T.word_hash_sql("word")} AS word_hash, doc_id FROM postings WHERE word IN ('crawler', 'index', 'language'))
SELECT word_hash, (doc_id % 16)::bigint AS host_suffix, count(*)::bigint AS n, string_agg(doc_id::varchar, ',' ORDER BY doc_id) AS urls FROM h GROUP BY 1, 2""")
def s23_index_abstract(spark, folder):
    """Documents of each word, grouped by the tail of their key as abstracts are exchanged."""
    index = postings(documents_of(spark, folder)).where(F.col("word").isin(*TERMS))
    grouped = index.select(T.word_hash(F.col("word")).alias("word_hash"), "doc_id", (F.col("doc_id") % 16).alias("host_suffix")).distinct()
    listed = grouped.groupBy("word_hash", "host_suffix").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("doc_id")).alias("ids"))
    return listed.select("word_hash", "host_suffix", "n", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("urls"))


@query(f"""WITH {_OCC}, a AS (SELECT doc_id FROM postings WHERE word = 'crawler'), b AS (SELECT doc_id FROM postings WHERE word = 'index')
SELECT doc_id FROM a INTERSECT SELECT doc_id FROM b""")
def j7_abstract_intersection(spark, folder):
    index = postings(documents_of(spark, folder))
    return by_word(index, "crawler").select("doc_id").intersect(by_word(index, "index").select("doc_id"))


@query(f"""WITH {_OCC} SELECT doc_id FROM postings WHERE word = 'crawler' EXCEPT SELECT doc_id FROM postings WHERE word = 'redirect'""")
def u4_except(spark, folder):
    index = postings(documents_of(spark, folder))
    return by_word(index, "crawler").select("doc_id").subtract(by_word(index, "redirect").select("doc_id"))


@query("""SELECT word, count(*)::bigint AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(coalesce(title, '')), '[^a-z]+'), lambda x: length(x) >= 3)) AS word FROM crawled_pages)
WHERE word NOT IN ('the', 'and', 'why', 'how', 'notes') GROUP BY word ORDER BY n DESC, word LIMIT 5""")
def a5_topic_words(spark, folder):
    words = F.explode(F.filter(F.split(F.lower(F.coalesce("title", F.lit(""))), "[^a-z]+"), lambda x: F.length(x) >= 3)).alias("word")
    counted = table(spark, folder, "crawled_pages").select(words).where(~F.col("word").isin("the", "and", "why", "how", "notes")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "word").limit(5)


@query(f"""SELECT word, count(*)::bigint AS frequency FROM (SELECT unnest(list_filter({T.tokens_sql('text')}, lambda w: length(w) BETWEEN 4 AND 32)) AS word FROM documents) GROUP BY word HAVING count(*) >= 2""")
def a6_vocabulary(spark, folder):
    return vocabulary(documents_of(spark, folder))


def vocabulary(documents: DataFrame, least: int = 2, body: str = "text") -> DataFrame:
    """Words of 4 to 32 characters with their frequency; rare ones are pruned."""
    words = documents.select(F.explode(F.filter(T.tokens(F.col(body)), lambda w: F.length(w).between(4, 32))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("frequency")).where(F.col("frequency") >= least)
